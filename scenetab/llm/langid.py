"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetab.llm.common import fresh, key128, stored

FEATURES = 1 << 14
PIECE = 1 << 20
UNDECIDED = "und"

# letters A-Z lowered, everything below them in the table that is no letter becomes a space; bytes of other scripts stay
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, text number of each) for runs of texts of about PIECE bytes; long texts come in several runs."""
    data, owner, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text), 1), PIECE):
            part = b" " + text[at : at + PIECE + 2] + b" "
            data.append(part)
            owner.append(k)
            size += len(part)
            if size >= PIECE:
                yield np.frombuffer(b"".join(data), np.uint8), np.repeat(owner, [len(p) for p in data])
                data, owner, size = [], [], 0
    if data:
        yield np.frombuffer(b"".join(data), np.uint8), np.repeat(owner, [len(p) for p in data])


def _features(data: np.ndarray) -> np.ndarray:
    """A feature number for each trigram of folded bytes, FEATURES (none) for trigrams of spaces only."""
    b = _FOLD[data]
    gram = b[:-2] | (b[1:-1] << 8) | (b[2:] << 16)
    hashed = (gram * np.uint32(2654435761)) >> np.uint32(32 - 14)
    return np.where((b[:-2] == 32) & (b[1:-1] == 32), FEATURES, hashed).astype(np.int64)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """An (n, bits) matrix of -1 and 1, no two rows equal or opposite columns: all splits of up to six classes, else random
    columns drawn until there are enough; of 20 such draws the one whose closest rows are farthest apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        return np.array([(1, *c) for c in product((1, -1), repeat=n - 1)][1:]).T
    rng, best = np.random.default_rng(seed), None
    for _ in range(20):
        code = np.where(rng.random((n, max(16, int(np.ceil(10 * np.log2(n)))))) < 0.5, -1, 1)
        code = code[:, np.abs(code.sum(0)) < n]
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def _counter(names: list[str]):
    """Sums of feature counts by class, one row per class and task."""
    at = {x: i for i, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), FEATURES + 1), np.int64)
        for batch in batches:
            classes = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64)
            for data, owner in _pieces([t.encode() for t in batch.column("text").to_pylist()]):
                if len(data) < 3:
                    continue
                cells = classes[owner[:-2]] * (FEATURES + 1) + _features(data)
                total += np.bincount(cells[owner[:-2] == owner[2:]], minlength=total.size).reshape(total.shape)
        yield pa.RecordBatch.from_pydict({"lang": names, "counts": [row[:FEATURES] for row in total]})

    return count


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_classes: int = 1000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, codewords, weights): one linear classifier per bit of the code, weights of shape (features, bits).

    Each bit's classifier is the log odds of every trigram between the pooled texts of the languages that have the bit and
    those that don't. They need only the trigram counts of each language, which tasks sum over all labelled rows; what the
    driver receives is languages x 16384 numbers per task at most, summed by Spark first. More than ``max_classes``
    different labels are an error, as they are no languages.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(max_classes + 1).collect())
    if len(names) > max_classes:
        raise ValueError(f"more than {max_classes} languages")
    if not names:
        return [], np.ones((0, 1)), np.zeros((FEATURES + 1, 1), np.float32)
    parts = rows.mapInArrow(_counter(names), "lang string, counts array<bigint>").select("lang", F.posexplode("counts").alias("feature", "n")).where("n > 0")
    table = np.zeros((len(names), FEATURES))
    at = {x: i for i, x in enumerate(names)}
    for lang, found in parts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("feature", "n"))).toLocalIterator():
        for feature, n in found:
            table[at[lang], feature] = n
    code = codewords(len(names))
    freq = table / np.maximum(table.sum(1, keepdims=True), 1)
    weights = np.zeros((FEATURES + 1, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        yes, no = freq[code[:, bit] > 0], freq[code[:, bit] < 0]
        if len(yes) and len(no):
            weights[:FEATURES, bit] = np.log(yes.mean(0) + 1e-6) - np.log(no.mean(0) + 1e-6)
    return names, code, weights


def decode(margins: np.ndarray, code: np.ndarray, scale: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """(nearest codeword, its share of the weight): the logistic loss of each bit's margin against each codeword's bit."""
    loss = np.logaddexp(0, -scale * margins[:, None, :] * code[None, :, :]).sum(2)
    order = np.argmin(loss, 1)
    near = np.exp(loss.min(1, keepdims=True) - loss)
    return order, 1 / near.sum(1)


def _predictor(names: list[str], code: np.ndarray, weights: np.ndarray):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            sums, seen = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
            for data, owner in _pieces(texts):
                if len(data) < 3:
                    continue
                f = _features(data)
                f[owner[:-2] != owner[2:]] = FEATURES
                begins = np.flatnonzero(np.r_[True, owner[1:-2] != owner[:-3]])
                np.add.at(sums, owner[begins], np.add.reduceat(weights[f], begins, axis=0, dtype=np.float64))
                np.add.at(seen, owner[begins], np.add.reduceat((f < FEATURES).astype(np.int64), begins))
            nearest, share = decode(sums / np.maximum(seen, 1)[:, None], code) if names else (np.zeros(len(texts), int), np.zeros(len(texts)))
            lettered = np.array(batch.column("lettered").to_pylist(), bool) & bool(names)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "lang_pred": [names[i] if ok else UNDECIDED for i, ok in zip(nearest, lettered)],
                    "score": pa.array(np.where(lettered, share, 0.0), pa.float64()),
                }
            )

    return predict


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", doubt: float = 0.4) -> DataFrame:
    """Per row of ``docs``: (id_col, lang_pred, score, ambiguous).

    The whole text's mean log odds per trigram give each bit a margin; the codeword with the least logistic loss wins and
    ``score`` is its share among all codewords. ``ambiguous`` says that the share is below ``doubt``. A text that is null or
    has no letter is ``und`` with score 0, and so is every text under a model without languages. Equal texts get equal
    answers; other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), text.rlike(r"\p{L}").alias("lettered"))
    out = rows.mapInArrow(_predictor(*model), f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", (F.col("score") < doubt).alias("ambiguous"))


def split_of(id_col: str = "doc_id"):
    """0, 1 or 2 from the id alone; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def fit_on_split(docs: DataFrame, id_col: str = "doc_id", **names) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A model that has seen no row of split 1."""
    return fit(docs.where(split_of(id_col) != 1), **names)


def kept_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is decided and not in doubt.

    Null and empty texts and others without a letter go, and so do all rows if no row to learn from has a language. Equal rows stay or go
    together, whatever their id; texts of any length are read as a whole; an empty table stays empty; columns that are named like those
    of this module are kept.
    """
    names, row = docs.columns, fresh(docs, "_row")
    keyed = docs.withColumn(row, F.struct(*key128(F.col(id_col), F.col(text_col))))
    verdict = identify(keyed, fit_on_split(docs, id_col, text_col=text_col), row, text_col)
    bad = stored(verdict.where((F.col("lang_pred") == UNDECIDED) | F.col("ambiguous")).select(row).distinct(), "languages")
    return keyed.join(bad, row, "left_anti").select(*names)
