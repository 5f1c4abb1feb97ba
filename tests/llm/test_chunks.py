"""Content-defined chunks against a byte-by-byte version."""

import hashlib
import math
import random

from conftest import SF
from odd_tables import none, odd, odd_rows, prose  # noqa: F401

from scenetab.llm import chunks
from scenetab.llm.model_queries import op3_chunk_dedup


def plain_cuts(text, least=16, most=1024, bits=4):
    ends, last, h = [], 0, 0
    for p, b in enumerate(text, 1):
        h = ((h << 1) + int(chunks._GEAR[b])) % (1 << 32)
        if p - last >= least and h >> (32 - bits) == 0 or p - last >= most and p < len(text):
            ends.append(p)
            last = p
    if last < len(text):
        if len(text) - last < least and ends:
            ends[-1] = len(text)
        else:
            ends.append(len(text))
    return ends


def plain_dedup(table, chain=100):
    """(removed, kept) by document: of equal chains of adjacent chunks all but the first go."""
    seen, out = set(), {}
    for i, t in sorted(table, key=lambda r: math.inf if r[0] is None else r[0]):
        b = (t or "").encode()
        ends, gone = plain_cuts(b), set()
        for s in [0, *ends[:-1]] if b else []:
            whole = len(b) < chain
            e = len(b) if whole else next((e for e in ends if e - s >= chain), None)
            if e is None or whole and s:
                continue
            if (b[s:e], whole) in seen:
                gone.update(range(s, e))
            seen.add((b[s:e], whole))
        out[i] = len(gone), bytes(x for p, x in enumerate(b) if p not in gone)
    return out


def test_cuts():
    for text in (b"", b"x" * 3000, b"a", prose(5, 900).encode(), prose(6, 40).encode(), b"z" * 16, b"z" * 1025):
        assert chunks.cuts(text) == plain_cuts(text)


def test_insertions_shift_few_chunks():
    text = prose(7, 3000).encode()
    parts = lambda t: {t[a:b] for a, b in zip([0, *chunks.cuts(t)], chunks.cuts(t))}
    assert len(parts(text) - parts(text[:5000] + b"inserted" + text[5000:])) <= 4


def test_chunk_dedup(spark, odd_rows):
    table = list({r[0]: r[:2] for r in odd_rows}.values())
    want = plain_dedup(table)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert {r[0]: (r[2], bytes(r[4])) for r in chunks.chunk_dedup(df).collect()} == want
    assert sum(n for n, _ in want.values()) > 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in op3_chunk_dedup(spark, SF).collect()}
    assert got == {i: (n, hashlib.sha256(kept).hexdigest()) for i, (n, kept) in want.items()}


def test_clean_documents_are_left_alone(spark):
    """A document loses bytes only if a string of 100 bytes of it, or all of it, occurs earlier."""
    docs = sorted((r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    seen, whole, repeats = set(), set(), set()
    for i, b in docs:
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                repeats.add(i)
            seen.add(b[s : s + 100])
        if b in whole:
            repeats.add(i)
        whole.add(b)
    changed = {r["doc_id"] for r in op3_chunk_dedup(spark, SF).collect() if r["n_removed"]}
    assert changed and changed <= repeats


def test_repeated_rows_and_empty_tables(odd, none):
    got = chunks.chunk_dedup(odd)
    assert got.count() == odd.count() and chunks.chunk_dedup(none).count() == 0


def test_passages_of_51_words_in_other_surroundings(spark, tmp_path):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 7))) for _ in range(5000)]
    words = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    rows, size = [], 0
    for k in range(300):
        passage = words(51)
        size += len(passage)
        rows += [(2 * k + i, f"{words(60)} {passage} {words(60)}") for i in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    gone = {r["doc_id"]: r["n_removed"] for r in op3_chunk_dedup(spark, str(tmp_path)).collect()}
    assert sum(gone[2 * k] for k in range(300)) == 0
    assert sum(gone[2 * k + 1] > 0 for k in range(300)) >= 297
    assert 0.7 * size <= sum(gone.values()) <= size


def test_copies_of_short_texts(spark):
    texts = ["a", "short text", "short text", "a", "", "", None, "x" * 47, "x" * 47, "x" * 48, "x" * 48, "short texts", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    gone = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in chunks.chunk_dedup(df).collect()}
    copies = {2, 3, 8, 10, 12}
    assert gone == {k: (len(t or ""), b"") if k in copies else (0, (t or "").encode()) for k, t in enumerate(texts)}
