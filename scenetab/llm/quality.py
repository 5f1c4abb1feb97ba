"""Quality rules: base counts of a document, and a line labelling by a linear-chain conditional random field."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of the contract
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
MARKS = bytes(b for b in range(33, 127) if b not in LETTERS + DIGITS + b".,;:'\"()-?")
ENDS = (b".", b"!", b"?", b":", b";")

# A line is described by one choice from each group; the limits cut the group's number into bins.
LIMITS = (
    (0.5, 2.5, 5.5, 10.5, 20.5, 50.5),  # words
    (0.001, 0.1, 0.3, 0.6, 0.9),  # marks that prose lacks, per word
    (0.001, 0.1, 0.3, 0.6),  # capitals among ASCII letters
    (0.001, 0.1, 0.3),  # digits among bytes
    (0.5,),  # equal to an earlier line
    (3, 5, 8, 12),  # bytes per word
    (0.5,),  # ends a sentence
    (0.001, 0.1, 0.3),  # share of the document's words that repeat
)
SIZES = [len(x) + 1 for x in LIMITS]
STARTS = np.cumsum([0, *SIZES])
JUNK, CONTENT = 0, 1


def _share(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, n, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            n += i + 3 - max(end, i)
            end = i + 3
    return n


def describe(text: str) -> tuple[tuple[int, int, int, int, int], list[int], list[int]]:
    """((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), code of each line, words of each line)."""
    data = text.encode()
    lines = data.split(b"\n")
    words, counts, dups, seen, repeats = [], [], [], set(), 0
    for line in lines:
        own = line.split()
        words += own
        counts.append(len(own))
        dups.append(bool(own) and line in seen)
        seen.add(line)
    repeats = repeated_words(words)
    ratio = repeats / max(len(words), 1)
    codes = []
    for line, n, dup in zip(lines, counts, dups):
        letters = _share(line, LETTERS)
        values = (
            n,
            _share(line, MARKS) / n if n else 0,
            _share(line, UPPER) / letters if letters else 0,
            _share(line, DIGITS) / len(line) if line else 0,
            dup,
            (len(line) - n) / n if n else 0,
            line.rstrip().endswith(ENDS),
            ratio,
        )
        code = 0
        for v, limits in zip(values, LIMITS):
            code = code * (len(limits) + 1) + sum(v > x for x in limits)
        codes.append(code)
    return (len(words), len(text) - _share(data, SPACES), _share(data, SYMBOLS), sum(dups), repeats), codes, counts


@dataclass
class Chain:
    """Weights of a two-state chain: of the bins, of the steps between states, and of the first state."""

    bins: np.ndarray
    steps: np.ndarray
    first: np.ndarray

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Score of each state for each line code, of any shape."""
        rest, total = codes.copy(), np.zeros((*codes.shape, 2))
        for k in reversed(range(len(SIZES))):
            total += self.bins[STARTS[k] + rest % SIZES[k]]
            rest //= SIZES[k]
        return total


def viterbi(chain: Chain, codes: list[int]) -> np.ndarray:
    """The best state of every line; ties go to content."""
    e = chain.scores(np.array(codes))
    back = np.zeros((len(codes), 2), np.int8)
    (j, c), st = chain.first + e[0], chain.steps
    for t in range(1, len(codes)):
        jj, cj, jc, cc = j + st[0, 0], c + st[1, 0], j + st[0, 1], c + st[1, 1]
        back[t] = cj >= jj, cc >= jc
        j, c = max(jj, cj) + e[t, 0], max(jc, cc) + e[t, 1]
    path = np.zeros(len(codes), np.int8)
    path[-1] = c >= j
    for t in range(len(codes) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def train(rows: list[tuple[list[int], int]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-3, cut: int = 64) -> Chain:
    """Maximum conditional likelihood by gradient steps; ``rows`` are (line codes, state of the document's lines).

    Documents longer than ``cut`` lines are trained on as several chains, so that one of them can't hold up all others.
    """
    chain = Chain(np.zeros((STARTS[-1], 2)), np.zeros((2, 2)), np.zeros(2))
    runs = [(codes[i : i + cut], state) for codes, state in rows for i in range(0, len(codes), cut)]
    if not runs:
        return chain
    lengths = np.array([len(c) for c, _ in runs])
    codes = np.zeros((len(runs), lengths.max()), np.int64)
    for k, (c, _) in enumerate(runs):
        codes[k, : len(c)] = c
    truth = np.array([s for _, s in runs])
    there = np.arange(codes.shape[1]) < lengths[:, None]
    n, total, everyone = codes.shape[1], there.sum(), np.arange(len(runs))
    bins, rest = [], codes.copy()
    for k in reversed(range(len(SIZES))):
        bins.append(STARTS[k] + rest % SIZES[k])
        rest //= SIZES[k]
    want = np.zeros((*codes.shape, 2))
    want[everyone, :, truth] = there
    momentum = [np.zeros_like(chain.bins), np.zeros((2, 2)), np.zeros(2)]
    for _ in range(rounds):
        e = chain.scores(codes)
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = chain.first + e[:, 0]
        for t in range(1, n):
            step = np.logaddexp(ahead[:, t - 1, 0, None] + chain.steps[0], ahead[:, t - 1, 1, None] + chain.steps[1]) + e[:, t]
            ahead[:, t] = np.where(there[:, t, None], step, ahead[:, t - 1])
        for t in range(n - 2, -1, -1):
            near = behind[:, t + 1] + e[:, t + 1]
            step = np.logaddexp(near[:, 0, None] + chain.steps[:, 0], near[:, 1, None] + chain.steps[:, 1])
            behind[:, t] = np.where(there[:, t + 1, None], step, 0)
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        state = np.exp(ahead + behind - whole[:, None, None]) * there[..., None]
        pair = ahead[:, :-1, :, None] + chain.steps + (e + behind)[:, 1:, None, :] - whole[:, None, None, None]
        pairs = (np.exp(np.where(there[:, 1:, None, None], pair, -np.inf))).sum((0, 1))
        gap = want - state
        grads = [np.zeros_like(chain.bins), -pairs, gap[:, 0].sum(0)]
        for b in bins:
            for s in (0, 1):
                grads[0][:, s] += np.bincount(b[there], weights=gap[..., s][there], minlength=len(chain.bins))
        for s in (0, 1):
            grads[1][s, s] += there[truth == s, 1:].sum()
        for g, m, w in zip(grads, momentum, (chain.bins, chain.steps, chain.first)):
            m *= 0.8
            m += g / total - decay * w
            w += rate * 10 * m
    return chain


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, text in enumerate(batch.column("text").to_pylist()):
            yield pa.RecordBatch.from_pydict({"label": batch.column("label")[k : k + 1], "codes": pa.array([describe(text)[1]], pa.list_(pa.int32()))})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 2000) -> Chain:
    """A chain trained on the whole texts of ``max_docs`` labelled documents, those with the smallest hash of the id.

    Every line of a document takes the document's label (1: content, 0: junk). Without labelled documents all weights are 0
    and everything is content.
    """
    key = F.xxhash64("_id")
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    # labels of ids that have no document don't use up the sample
    some = texts.select("_id").join(named, "_id").select("_id", "label").distinct().orderBy(key, "_id").limit(max_docs)
    rows = texts.join(F.broadcast(some), "_id").orderBy(key, "_id", F.xxhash64("text")).limit(max_docs)
    found = rows.select("label", "text").mapInArrow(_sample, "label int, codes array<int>").collect()
    return train([(r["codes"], CONTENT if r["label"] > 0 else JUNK) for r in found])


def _judge(chain: Chain, share: float, min_words: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                counts, codes, words = describe(text or "")
                path = viterbi(chain, codes)
                part = float(np.dot(path, words) / max(counts[0], 1))
                failed = counts[0] < min_words or 100 * counts[4] > 50 * counts[0]
                rows.append((*counts, failed, part, not failed and part >= share))
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["id", *OUT])

    return judge


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")


def judge(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5, min_words: int = 50) -> DataFrame:
    """Per row of ``docs``: (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    content_share, kept).

    A document fails the base rules with fewer than ``min_words`` words or if more than half of its words lie in three-word
    windows that repeat. Otherwise it is kept if at least ``share`` of its words are in lines that the chain's best path
    labels as content. A null text counts as an empty one: no words, one empty line, failed. Equal texts get equal answers;
    an empty table gives an empty result; other columns are ignored. Nothing is shuffled.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(
        _judge(chain, share, min_words),
        f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean",
    )
    return out.select(F.col("id").alias(id_col), *OUT)
