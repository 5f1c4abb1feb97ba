"""Search, collocations and language-model scores against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from odd_tables import none, odd, odd_rows, prose  # noqa: F401
from pyspark.sql import functions as F

from scenetab.llm import collocations, corpus_queries, neural, search

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ---- search ------------------------------------------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain_search(docs, items, k):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in counted:
            m = 50 + (50 * sum(c.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, prose(1, 80)), (2, "same line OTHER"), (3, prose(99, 9) + " Ähren straße"), (4, None), (5, ""), (6, "zzz"), (1, prose(1, 80)), (1, "rain wall wall"), (None, "boats Stone")]
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "item_id long, text string, m int, score string"), rows


@pytest.mark.parametrize("block,first,k", [(1 << 21, 16, 50), (60, 1, 3), (1, 1, 1)])
def test_search(odd, odd_rows, items, block, first, k, monkeypatch):
    monkeypatch.setattr(search, "FIRST", first)
    monkeypatch.setattr(search, "BLOCK", block)
    found = search.search(search.build_index(odd), items[0], k=k)
    got = Counter((r["item_id"], r["rank"], r["id"], r["score"]) for r in found.collect())
    assert got == plain_search([r[:2] for r in odd_rows], items[1], k)


def test_search_in_groups_of_items(odd, odd_rows, items, monkeypatch):
    monkeypatch.setattr(search, "ITEMS", 2)
    monkeypatch.setattr(search, "TOGETHER", 1)
    found = search.search(search.build_index(odd), items[0], k=5)
    assert Counter((r["item_id"], r["rank"], r["id"], r["score"]) for r in found.collect()) == plain_search([r[:2] for r in odd_rows], items[1], 5)


def test_search_without_rows(odd, none, items):
    assert search.search(search.build_index(none), items[0]).count() == 0
    assert search.search(search.build_index(odd), items[0].where("item_id = 9")).count() == 0


def test_a_long_text_is_searched_as_a_whole(spark):
    words = " ".join(f"w{k % 5000}" for k in range(1_500_000))
    docs = spark.createDataFrame([(1, words + " needle"), (2, "needle"), (3, "w1")], "doc_id long, text string")
    index = search.build_index(docs)
    assert index.n == 3 and index.total == 1_500_003
    got = search.search(index, spark.createDataFrame([(1, "needle w1")], "item_id long, text string"))
    want = plain_search([(1, words + " needle"), (2, "needle"), (3, "w1")], [(1, "needle w1")], 50)
    assert Counter((r["item_id"], r["rank"], r["id"], r["score"]) for r in got.collect()) == want


# ---- collocations ------------------------------------------------------------------------------------------------


def plain_collocations(rows, longest, least, cover, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in many.items():
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= cover * a for q, b in many.items()):
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("head,top,stream", [(1 << 20, 2000, 1 << 18), (3, 2000, 50), (0, 5, 1)])
def test_collocations(odd, odd_rows, head, top, stream, monkeypatch):
    monkeypatch.setattr(collocations, "STREAM", stream)
    got = collocations.collocations(odd, longest=4, least=3, top=top, head=head)
    assert sorted(map(tuple, got.collect())) == plain_collocations([(r[2], r[1]) for r in odd_rows], 4, 3, 80, top)


def test_collocations_of_five_words_and_without_rows(odd, odd_rows, none):
    got = collocations.collocations(odd, longest=5, least=4, cover=60, top=50)
    assert sorted(map(tuple, got.collect())) == plain_collocations([(r[2], r[1]) for r in odd_rows], 5, 4, 60, 50)
    assert collocations.collocations(none).count() == 0


def test_tiles_count_every_pair():
    rng = np.random.default_rng(1)
    for size, high in ((0, 5), (10, 5), (200_000, 300), (300_000, 3000)):
        x, y = (np.minimum(rng.geometric(0.01, size), high).astype(np.int32) for _ in range(2))
        code, n = (c.tolist() for c in collocations.tile_counts(x, y))
        assert len(code) == len(set(code)) and {(c >> 31, c & ((1 << 31) - 1)): k for c, k in zip(code, n)} == Counter(zip(x.tolist(), y.tolist()))


def test_products_beyond_64_bits(spark):
    big = (1 << 62) - 5
    row = spark.createDataFrame([(big, [big + 3], [big + 1])], "a long, heads array<long>, tails array<long>").select(F.expr(collocations._CUT).alias("c")).first()["c"]
    assert row["score"] == 2000000 * big // (2 * big + 4)


# ---- language model ----------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def learns(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


def plain_base(rows):
    c = Counter(w for i, t in rows if learns(i) for w in [*words_of(t), ""])
    share = sum(c.values()) + len(c) + 1
    return Counter(
        (i, len(words_of(t)) + 1, sum(w in c for w in [*words_of(t), ""]), sum(c.values()), round(sum(math.log10((c[w] + 1) / share) for w in [*words_of(t), ""]), 6)) for i, t in rows
    )


def scored(docs, **names):
    return neural.score(docs, neural.fit(docs.where(neural.split_of() != 2), **names))


@pytest.mark.parametrize("known", [1 << 20, 20])
def test_base_scores(odd, odd_rows, known):
    got = scored(odd, known=known, rounds=1).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == plain_base([r[:2] for r in odd_rows])


def plain_score(text, model, counts):
    """Token by token: the class after the words before it, normalised by a loop, and the word's share of its class."""
    known, class_of = model.known.value
    words = len(model.dens) - neural.ENDINGS
    p, before, total = model.parameters, [len(model.dens)] * neural.CONTEXT, 0.0
    for w in [*(w.encode() for w in words_of(text)), b""]:
        c = 0 if not w else int(class_of[known[w]]) if w in known else words + zlib.crc32(w[-3:]) % neural.ENDINGS
        guess = sum(p["context"][before[-1 - j]] * p["place"][j] for j in range(neural.CONTEXT))
        scores = [float(guess @ p["target"][k] + p["bias"][k]) for k in range(len(model.dens))]
        total += (scores[c] - math.log(sum(map(math.exp, scores)))) / math.log(10)
        if c >= words:
            total += math.log10(counts[w.decode()] + 1) - model.dens[c]
        before.append(c)
    return total


@pytest.mark.parametrize("known", [1 << 20, 20])
def test_scores_are_the_models_probabilities(odd, odd_rows, known):
    learned = odd.where(neural.split_of() != 2)
    model = neural.fit(learned, words=12, known=known)
    counts = Counter(w for r in odd_rows if learns(r[0]) for w in words_of(r[1]))
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in neural.score(odd, model).collect()}
    for i, t in {r[:2] for r in odd_rows if len(r[1] or "") < 5000}:
        assert got[i, len(words_of(t)) + 1] == pytest.approx(plain_score(t, model, counts), abs=1e-3)


def test_probabilities_sum_to_one(odd):
    model = neural.fit(odd, words=10)
    before = list(np.random.default_rng(0).integers(0, len(model.dens) + 1, (neural.CONTEXT, 40)))
    each = [neural.log_probabilities(model.parameters, before, np.full(40, c)) for c in range(len(model.dens))]
    assert np.allclose((10 ** np.array(each)).sum(0), 1)
    # within the classes: every counted word and one place for all others
    known, class_of = model.known.value
    for c in range(10, len(model.dens)):
        shares = [10 ** (model.logs[n] - model.dens[c]) for n in known.values() if class_of[n] == c]
        assert math.isclose(sum(shares) + 10 ** -model.dens[c], 1)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    shares = rng.dirichlet(np.ones(12))
    p = {name: v + rng.normal(0, 0.2, v.shape) for name, v in neural.initial(shares).items()}
    before, target, noise = list(rng.integers(0, 13, (neural.CONTEXT, 9))), rng.integers(0, 12, 9), rng.integers(0, 12, 7)

    def loss():
        guess = sum(p["context"][b] * p["place"][j] for j, b in enumerate(before))
        delta = guess @ p["target"].T + p["bias"] - np.log(len(noise) * shares)
        true = np.log1p(np.exp(-delta[np.arange(9), target]))
        return (true + np.log1p(np.exp(delta[:, noise])).sum(1)).mean()

    found = neural.gradients(p, before, target, noise, shares)
    for name, v in p.items():
        for at in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(12)]:
            kept = v[at]
            v[at] = kept + 1e-5
            up = loss()
            v[at] = kept - 1e-5
            down = loss()
            v[at] = kept
            assert found[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_held_out_texts_score_better_than_by_counts(spark):
    got = corpus_queries.op13_lm_scoring(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_scores_without_rows(odd, none):
    assert scored(none).count() == 0
    assert neural.score(odd, neural.fit(none)).where("n_known = 0 and train_tokens = 0 and base_score = 0 and score < 0").count() == odd.count()


def test_equal_texts_score_equally(spark):
    long = " ".join(f"w{k % 977} the of" for k in range(400_000))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([long, "the of", long, "the of", None, ""])], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in neural.score(docs, neural.fit(docs, rounds=1)).collect()}
    assert got[0]["n_tokens"] == 1_200_001
    for a, b in ((0, 2), (1, 3), (4, 5)):
        assert got[a]["score"] == pytest.approx(got[b]["score"], rel=1e-6)
