"""Every operator against a plain version of its rule, on rows with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from conftest import SF
from odd_tables import none, odd, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from scenetab.llm import collocations, components, decontamination, jaccard, langid, lines, mixing, quality, sharding, substrings, suffixes, warc

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOW))


# --- 1


def plain_lines(table, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    seen = Counter(k for _, t, *_ in table for k in {key(x) for x in (t or "").split("\n")} if k)
    out = Counter()
    for i, t, *_ in table:
        ls = (t or "").split("\n")
        kept = [x for x in ls if seen[key(x)] < least]
        out[i, len(ls), len(ls) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(odd, odd_rows, least):
    assert rows(lines.line_dedup(odd, min_docs=least)) == plain_lines(odd_rows, least)


def test_line_dedup_with_a_hot_line(spark, monkeypatch):
    table = [(k, f"hot\nown {k}\nhot") for k in range(500)]
    assert rows(lines.line_dedup(spark.createDataFrame(table, "doc_id long, text string"), min_docs=10)) == plain_lines(table, 10)


# --- 2


def plain_substrings(table, width):
    texts = sorted({(math.inf if i is None else i, (t or "").encode()) for i, t, *_ in table})
    seen, out = set(), {}
    for i, b in texts:
        gone = set()
        for p in range(len(b) - width + 1):
            if b[p : p + width] in seen:
                gone.update(range(p, p + width))
            seen.add(b[p : p + width])
        spans = sum(p - 1 not in gone for p in gone)
        out[i, b] = (len(b), len(gone), spans, bytes(c for p, c in enumerate(b) if p not in gone))
    return Counter((i, *out[math.inf if i is None else i, (t or "").encode()]) for i, t, *_ in table)


def unique_ids(table):
    """Order among rows of one id is by hash: leave one of each for a plain comparison."""
    return list({r[0]: r for r in table}.values())


@pytest.mark.parametrize("crowd", [4096, 0])
def test_substring_dedup(spark, odd_rows, crowd, monkeypatch):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    table = [(*r[:2],) for r in unique_ids(odd_rows)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = Counter((r[0], *r[1:4], bytes(r[4])) for r in substrings.substring_dedup(df).collect())
    assert got == plain_substrings(table, 100)


def test_repeated_rows_are_one_document(odd, odd_rows):
    got = [r for r in substrings.substring_dedup(odd).collect() if r["doc_id"] == 6]
    assert len(got) == 3 and len({tuple(r) for r in got}) == 1 and got[0]["n_removed"] == 0


def test_shards_look_back_by_binary_search():
    rng = np.random.default_rng(1)
    pool = [rng.integers(97, 100, 130, dtype=np.uint8).tobytes() for _ in range(9)]
    strings = [pool[k] for k in rng.integers(0, 9, 60)]
    shards, found = suffixes.Shards(100, 500), []
    for s in strings:
        shards.add(5, s)
        if shards.full():
            found += shards.close()
    found += shards.close()
    seen = set()
    for s, repeat in zip(strings, found):
        own = [s[p : p + 100] for p in range(31)]
        assert [w in seen for w in own] == list(repeat)
        seen.update(own)


@pytest.mark.parametrize("width", [1, 8, 100])
def test_runs_of_repeats_of_a_shard(width):
    rng = np.random.default_rng(2)
    pool = [rng.integers(97, 99 if width < 100 else 123, 160).astype(np.uint8).tobytes() for _ in range(4)]
    one, two, want = suffixes.Shards(width), suffixes.Shards(width), []
    for _ in range(3):
        for _ in range(30):
            a = int(rng.integers(0, 60))
            string = pool[rng.integers(4)][a : a + max(width, 100)]
            one.add(1, string), two.add(1, string)
        got = [set() for _ in range(30)]
        for s, at, n in zip(*two.close_runs()):
            got[s] |= set(range(at, at + n))
        assert got == [set(np.flatnonzero(r).tolist()) for r in one.close()]
    assert not len(two.close_runs()[0])


def test_suffix_array_and_prefixes():
    data = np.frombuffer(b"banana" * 40 + b"\0\0\0" + b"ab" * 30, np.uint8)
    w = suffixes.words_of(data)
    sa = suffixes.suffix_array(w, len(data))
    text = data.tobytes()
    assert list(sa) == sorted(range(len(text)), key=lambda p: text[p:])
    lcp = suffixes.common_prefixes(w, sa, np.array([0, 150]), np.array([150, len(text) - 150]), 100)
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert [min(common(text[i:], text[j:]), 100) for i, j in zip(sa, sa[1:])] == list(np.minimum(lcp[1:], [len(text) - max(i, j) for i, j in zip(sa, sa[1:])]))


# --- 4


def test_mixing(odd, odd_rows):
    got = mixing.mix_sizes(odd, [5.0, 2.0, 1.0]).collect()
    size = defaultdict(int)
    for _, t, _, s, *_ in odd_rows:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        left, open_ = left - sum(3 * size[s] for s in over), open_ - over
    target |= {s: level * weight[s] for s in open_}
    assert Counter(r["source_size"] for r in got) == Counter(size[r[3]] for r in odd_rows)
    assert {round(r["target"], 6) for r in got} == {round(target[s], 6) for s in names}
    assert all(r["taken"] == r["size"] * r["copies"] and r["copies"] in (math.floor(r["target"] / r["source_size"]), math.floor(r["target"] / r["source_size"]) + 1) for r in got)
    assert rows(mixing.mix_sizes(odd, [5.0, 2.0, 1.0])) == Counter(tuple(r) for r in got)
    full = mixing.mix(odd, [5.0, 2.0, 1.0])
    assert full.columns == odd.columns and full.count() == sum(r["copies"] for r in got)
    # columns named like the operator's own keep their values
    clash = mixing.mix(odd.withColumn("_mix_a", F.lit("a")).withColumn("_row", F.lit("r")), [5.0, 2.0, 1.0])
    assert rows(clash.select(*odd.columns)) == rows(full) and rows(clash.select("_mix_a", "_row").distinct()) == Counter([("a", "r")])


def test_mixing_comes_near_its_targets(spark):
    got = mixing.mix_sizes(spark.read.parquet(f"{SF}/documents.parquet"), [5.0, 2.0, 1.0])
    per = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert max(abs(r["taken"] / r["target"] - 1) for r in per) < 0.1


# --- 5


def test_warc_round_trip(spark, odd_rows, tmp_path):
    table = [(i, f"http://x/{i}?a=%20 é", t) for i, t, *_ in unique_ids(odd_rows)] + [(100, None, None), (101, "u", "one"), (102, "u", "one")]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    folder = str(tmp_path / "archive")
    index = warc.write_archives(pages, folder)
    got = {r["page_id"]: r for r in warc.read_archives(spark, folder, index).collect()}
    best = defaultdict(lambda: None)
    for i, _, t in table:
        if i is not None:
            best[t or ""] = max(i, best[t or ""] if best[t or ""] is not None else i)
    assert len(got) == len(table)
    for i, u, t in table:
        r = got[i]
        first = best[t or ""] is None or i == best[t or ""]
        assert (r["url"], r["payload_bytes"], r["payload_digest"]) == (u, len((t or "").encode()), warc.digest((t or "").encode()))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", best[t or ""]))
        assert bytes(r["payload"] or b"") == ((t or "").encode() if first else b"")
    for e in index.collect():
        with open(f"{folder}/{e['bundle']}", "rb") as f:
            data = f.read()
        one = warc.fetch(data, e["frame_at"], e["offset"], e["length"])
        assert one["record_id"] == e["record_id"] and warc.seek_table(data)[e["frame"]][0] == e["frame_at"]


def plain_records(data):
    """The records of unpacked archive bytes by the rules of the format alone: named fields, then a block of the stated length."""
    found = []
    while data:
        assert data.startswith(b"WARC/1.1\r\n")
        head, data = data.split(b"\r\n\r\n", 1)
        fields = [line.split(b": ", 1) for line in head.split(b"\r\n")[1:]]
        names = [k for k, _ in fields]
        assert len(names) == len(set(names)) and all(v and v.isascii() for _, v in fields)
        fields = {k.decode(): v.decode() for k, v in fields}
        n = int(fields["Content-Length"])
        found.append((fields, data[:n]))
        assert data[n : n + 4] == b"\r\n\r\n"
        data = data[n + 4 :]
    return found


def test_other_readers_find_addresses_and_messages(spark, tmp_path):
    pages = [(1, "http://a.b/x%20y?q=%C3%A9#z", "one"), (2, "http://a.b/x y\u00e9", "two"), (3, None, "one"), (4, "http://c.d/", ""), (5, "http://e.f/", "three\r\n\r\nlines"), (5, "http://e.f/", "three\r\n\r\nlines"), (5, "http://g.h/", "other"), (6, "http://i.j/", "three\r\n\r\nlines")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("_k1", F.lit(1)).withColumn("revisit", F.lit("x"))
    folder = str(tmp_path / "archive")
    index = warc.write_archives(df, folder, date="2020-02-03T04:05:06Z")
    assert index.select("record_id").distinct().count() == len(pages)
    raw = b""
    for name in {e["bundle"] for e in index.collect()}:
        with open(f"{folder}/{name}", "rb") as f:
            raw += zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    got = plain_records(raw)
    ids = [f["WARC-Record-ID"] for f, _ in got]
    assert len(set(ids)) == len(pages) and all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", i) for i in ids)
    assert {f["WARC-Date"] for f, _ in got} == {"2020-02-03T04:05:06Z"}
    assert Counter(f.get("WARC-Target-URI") for f, _ in got) == Counter("http://a.b/x%20y%C3%A9" if i == 2 else u for i, u, _ in pages)
    for fields, block in got:
        if fields["WARC-Type"] == "response":
            assert fields["Content-Type"] == "application/http; msgtype=response"
            head, payload = block.split(b"\r\n\r\n", 1)
            assert head.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(payload)}".encode() in head
            assert fields["WARC-Payload-Digest"] == "sha1:" + warc.digest(payload)
        else:
            assert not block and fields["WARC-Profile"] == warc.REVISIT_PROFILE
    # page 1 repeats page 3, whose record it names; pages 5 repeat page 6, but their ids are not theirs alone
    referred = {f["X-Page-ID"]: f.get("WARC-Refers-To") for f, _ in got if f["WARC-Type"] == "revisit"}
    assert referred == {"1": next(f["WARC-Record-ID"] for f, _ in got if f["X-Page-ID"] == "3"), "5": None}
    assert Counter((r["page_id"], r["url"], r["refers_to"]) for r in warc.read_archives(spark, folder, index).collect()) == Counter(
        (i, u, {1: 3}.get(i, 6 if i == 5 and t != "other" else None)) for i, u, t in pages
    )


def test_warc_small_payloads_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.round_trip(pages.where("page_id < 0")).count() == 0


# --- 6


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs, langid.fit_on_split(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where(langid.split_of() == 1)
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()


def test_language_of_odd_rows(odd, odd_rows):
    got = Counter((r[0], r[1] == "und") for r in langid.identify(odd, langid.fit_on_split(odd)).collect())
    assert got == Counter((i, not any(c.isalpha() for c in t or "")) for i, t, *_ in odd_rows)
    assert langid.kept_languages(odd).columns == odd.columns


def test_codewords_are_apart():
    for n in (2, 3, 6, 7, 20):
        code = langid.codewords(n)
        assert all((code[i] != code[j]).sum() >= max(1, code.shape[1] // 5) for i in range(n) for j in range(i))


def test_language_without_labels(odd):
    model = langid.fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r[1] for r in langid.identify(odd, model).collect()} == {"und"}


# --- 7


def plain_classes(table, n, percent):
    sets = []
    for _, t, *_ in table:
        w = words(t)
        sets.append({tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set())
    root = list(range(len(table)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = defaultdict(lambda: None)
    for k, r in enumerate(table):
        if r[0] is not None:
            least[top(k)] = r[0] if least[top(k)] is None else min(least[top(k)], r[0])
    return Counter((r[0], len(s), least[top(k)]) for k, (r, s) in enumerate(zip(table, sets)))


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_classes(odd, odd_rows, n, percent):
    got = jaccard.classes(odd, n, percent).select("doc_id", "n_shingles", "component_id")
    assert rows(got) == plain_classes(odd_rows, n, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_near_copies_around_the_bound(spark, percent):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(140)]
    table = []
    for k in range(160):
        w = list(base[: 100 + k % 40])
        for at in rng.integers(0, len(w), k % 9):
            w[at] = f"x{rng.integers(0, 60)}"
        table.append((k, " ".join(w)))
    got = jaccard.classes(spark.createDataFrame(table, "doc_id long, text string").repartition(5), 3, percent)
    assert rows(got.select("doc_id", "n_shingles", "component_id")) == plain_classes(table, 3, percent)


def test_one_of_each_class(odd, odd_rows):
    kept = jaccard.one_of_each(odd)
    classes = plain_classes(odd_rows, 5, 80)
    wordless = sum(not words(r[1]) for r in odd_rows)
    assert kept.columns == odd.columns
    # id 5 stands for two texts that are far apart, so two classes have it as their least id
    assert kept.count() == wordless + len({c for (_, n, c), _ in classes.items() if n}) + 1


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1050)]
    got = dict(components.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect())
    assert got == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1050)}}


# --- 8


def plain_hits(table, items):
    find = lambda t: words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = Counter()
    for i, t, *_ in table:
        w, hit, named = find(t), set(), set()
        for item, text in items:
            q = find(text)
            n = min(13, len(q))
            windows = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if q else set()
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    named.add(item)
        names = sorted(str(x) for x in named if x is not None)
        out[i, len(w), len(hit), tuple(names), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    return out


def test_contamination(spark, odd, odd_rows):
    text = next(r[1] for r in odd_rows if r[0] == 9)
    w = text.split()
    items = [(1, " ".join(w[5:40])), (2, "Two words"), (3, None), (4, "..."), (None, " ".join(w[20:33])), (6, " ".join(w[58:75])), (7, "one"), (7, "one"), (8, " ".join(["a"] * 20)), (10, " ".join(w[30:42]) + " other words than those")]
    table = [*odd_rows, (50, "a " * 30, *[None] * 5), (51, "b " + "a " * 12, *[None] * 5), (52, "a " * 13 + " ".join(w[:45]), *[None] * 5)]
    docs = spark.createDataFrame(table, odd.schema).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = Counter((*r[:3], tuple(r[3]), r[4]) for r in decontamination.contamination(docs, bench).collect())
    assert got == plain_hits(table, items)
    bad = {k[0] for k, n in got.items() if k[4]}
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in got.items() if not k[4]) and bad


# --- 9


def plain_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    ls, times = text.split("\n"), Counter(zip(w, w[1:], w[2:]))
    inside = {p + d for p in range(len(w) - 2) if times[w[p], w[p + 1], w[p + 2]] > 1 for d in range(3)}
    dups = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in ls[:k] for k, x in enumerate(ls))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def test_quality_counts(odd, odd_rows):
    chain = quality.train([])
    got = Counter(tuple(r)[:7] for r in quality.judge(odd, chain).collect())
    assert got == Counter((r[0], *plain_quality(r[1])) for r in odd_rows)
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(odd, chain).collect())


def test_best_path_is_the_best():
    rng = np.random.default_rng(2)
    chain = quality.Chain(rng.normal(size=(quality.STARTS[-1], 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    codes = list(rng.integers(0, np.prod(quality.SIZES), 9))
    e = chain.scores(np.array(codes))

    def score(path):
        return chain.first[path[0]] + e[range(9), path].sum() + sum(chain.steps[a, b] for a, b in zip(path, path[1:]))

    best = max((tuple((k >> t) & 1 for t in range(9)) for k in range(512)), key=lambda p: score(list(p)))
    assert tuple(quality.viterbi(chain, codes)) == best


def test_training_is_the_gradient_of_the_likelihood():
    rng = np.random.default_rng(4)
    data = [(list(rng.integers(0, np.prod(quality.SIZES), n)), int(n % 2)) for n in (1, 2, 5, 3, 4)]
    one = quality.train(data, rounds=1, rate=1e-3, decay=0)

    def likelihood(chain):
        total = 0
        for codes, state in data:
            e = chain.scores(np.array(codes))
            score = lambda p: chain.first[p[0]] + sum(e[t, s] for t, s in enumerate(p)) + sum(chain.steps[a, b] for a, b in zip(p, p[1:]))
            paths = [[(k >> t) & 1 for t in range(len(codes))] for k in range(2 ** len(codes))]
            total += score([state] * len(codes)) - np.log(sum(np.exp(score(p)) for p in paths))
        return total

    zero = quality.Chain(np.zeros((quality.STARTS[-1], 2)), np.zeros((2, 2)), np.zeros(2))
    base, lines_ = likelihood(zero), sum(len(c) for c, _ in data)
    for name in ("bins", "steps", "first"):
        step = getattr(one, name) / 1e-2 * lines_  # rate 1e-3 times 10, averaged over the lines
        for at in list(zip(*np.nonzero(step)))[:6]:
            moved = quality.Chain(zero.bins.copy(), zero.steps.copy(), zero.first.copy())
            getattr(moved, name)[at] += 1e-5
            assert abs((likelihood(moved) - base) / 1e-5 - step[at]) < 1e-3


def test_quality_of_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) >= 0.9 * len(got)


def test_quality_without_labels(odd, none):
    chain = quality.fit(odd, none.select("doc_id", F.lit(1).alias("quality")))
    assert not chain.bins.any()


# --- 10


def test_sharding(odd, odd_rows):
    got = sharding.assign_shards(odd, [1.0] * 24).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)

    def best(i, n):
        key = "" if i is None else str(i)
        return min((-math.log((int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52), s) for s in range(n))[1]

    for r in got:
        assert (r["shard"], r["grown_shard"]) == (best(r["doc_id"], 24), best(r["doc_id"], 25)) and r["grown_shard"] in (r["shard"], 24)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["doc_id"], r["shard"]) for r in sharding.with_shard(odd, [1.0] * 24).collect()} == {(r["doc_id"], r["shard"]) for r in got}


def test_weighted_shards(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = Counter(r["shard"] for r in sharding.assign_shards(ids, [1.0, 3.0]).collect())
    assert abs(got[1] / 20000 - 0.75) < 0.02


# --- all


def test_empty_tables(none, spark):
    bench = none.select(F.col("doc_id").alias("item_id"), "text")
    model = langid.fit_on_split(none)
    results = [
        lines.line_dedup(none), substrings.substring_dedup(none), mixing.mix_sizes(none, [1.0]), mixing.mix(none, [1.0]), langid.identify(none, model), langid.kept_languages(none), jaccard.classes(none),
        jaccard.one_of_each(none), decontamination.contamination(none, bench), decontamination.clean(none, bench), quality.judge(none, quality.fit(none, none.withColumn("quality", F.lit(1)))), sharding.assign_shards(none, [1.0, 1.0]),
    ]
    assert [df.count() for df in results] == [0] * len(results)


def test_streams_come_in_small_batches(spark, monkeypatch):
    """Rows of streams are long; however many a task reads, few are in Python at a time, and the session's own bound comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    docs = spark.createDataFrame([("en", " ".join(["one two three"] * 50))] * 40, "lang string, text string").coalesce(1)
    want = [tuple(r) for r in collocations.collocations(docs, least=2).collect()]
    seen = spark.sparkContext.accumulator(0)
    real = collocations._count_pairs

    def counting(k):
        run = real(k)

        def counted(batches):
            def each():
                for batch in batches:
                    if batch.num_rows > 4:
                        seen.add(1)
                    yield batch

            yield from run(each())

        return counted

    monkeypatch.setattr(collocations, "STREAM", 256)
    monkeypatch.setattr(collocations, "BATCH", 2048)
    monkeypatch.setattr(collocations, "_count_pairs", counting)
    assert [tuple(r) for r in collocations.collocations(docs, least=2).collect()] == want and want
    assert seen.value == 0
    assert spark.conf.get(name, None) == before
