"""Language-model scores: a log-bilinear model over word classes, trained with noise-contrastive estimation."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetab.llm.collocations import ranked
from scenetab.llm.common import stored
from scenetab.llm.tokens import BLANKS, runs, texts_of

# words with a class of their own, classes of the other words, words before a word that predict it, and numbers per word
WORDS, ENDINGS, CONTEXT, WIDTH = 256, 64, 4, 16
# the most frequent words, whose counts every task holds; the others are looked up by a join
KNOWN = 1 << 17
# tokens of a step and its noise words, tokens that are shuffled or scored together, distinct words a task counts at once
STEP, NOISE, BUFFER, SCORED, DISTINCT = 4096, 32, 1 << 18, 1 << 10, 1 << 19
ROUNDS = 1


class Model(NamedTuple):
    """``known``: words to numbers, and the class of each number; ``logs``: log10(count + 1) by number; ``dens``: log10 of what a
    class is divided by to get the share of each of its words, one of which is for all words not seen. ``tail``: (word, n) of
    the other counted words, or None. ``ends``: learned texts."""

    known: Broadcast
    logs: np.ndarray
    dens: np.ndarray
    parameters: dict[str, np.ndarray]
    total: int
    distinct: int
    ends: int
    tail: DataFrame | None


def ending_class(word: bytes) -> int:
    """Words without a class of their own share one by their last three bytes."""
    return zlib.crc32(word[-3:]) % ENDINGS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        words = [*counts]
        ends = pa.array([ending_class(w) for w in words], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), ends, pa.array(counts.values(), pa.int64())], ["word", "ending", "n"])
        counts.clear()

    for batch in batches:
        for text in texts_of(batch):
            for words in runs(text, BLANKS):
                counts.update(words)
            counts[b""] += 1  # the end of the text
            if len(counts) > DISTINCT:
                yield from out()
    if counts:
        yield from out()


class Stream:
    """Classes of the tokens of texts, each run after the CONTEXT classes that come before it. Class 0 is the end of a text."""

    def __init__(self, known: dict[bytes, int], class_of: np.ndarray, words: int):
        self.get, self.class_of, self.words, self.start = known.get, np.r_[class_of, 0], words, words + ENDINGS
        self.parts, self.ends, self.owners, self.size = [], [], [], 0

    def add(self, text: bytes | None, owner: int, seen=None) -> int:
        """Append a text, and call ``seen(words, numbers, classes)`` for each run of words; returns the number of tokens."""
        before, n, get = np.full(CONTEXT, self.start, np.int64), 0, self.get
        for words in runs(text, BLANKS):
            numbers = np.array([get(w, -1) for w in words], np.int64)
            classes = self.class_of[numbers]
            for i in np.flatnonzero(numbers < 0).tolist():
                classes[i] = self.words + ending_class(words[i])
            if seen:
                seen(words, numbers, classes)
            before, n = self._put(before, classes, owner), n + len(words)
        self._put(before, np.zeros(1, np.int64), owner)
        return n + 1

    def _put(self, before: np.ndarray, classes: np.ndarray, owner: int) -> np.ndarray:
        if len(classes):
            self.parts += [before, classes]
            self.owners += [-1, owner]
            self.ends += [CONTEXT, len(classes)]
            self.size += len(classes)
        return np.r_[before, classes][-CONTEXT:]

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(classes, places of the tokens among them, owner of each token), and begin anew."""
        classes, owner = np.concatenate(self.parts), np.repeat(self.owners, self.ends)
        places = np.flatnonzero(owner >= 0)
        self.parts, self.ends, self.owners, self.size = [], [], [], 0
        return classes, places, owner[places]


def initial(shares: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters under which every class has its share of the corpus, whatever stands before."""
    rng = np.random.default_rng(seed)
    n = len(shares)
    return {
        "context": rng.normal(0, 0.3, (n + 1, WIDTH)),
        "place": np.full((CONTEXT, WIDTH), 1 / math.sqrt(CONTEXT)),
        "target": np.zeros((n, WIDTH)),
        "bias": np.log(shares),
    }


def _scattered(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    wide = values.shape[1]
    cells = (rows[:, None] * wide + np.arange(wide)).ravel()
    return np.bincount(cells, values.ravel(), size * wide).reshape(size, wide).astype(values.dtype)


def guesses(p: dict[str, np.ndarray], before: list[np.ndarray]) -> np.ndarray:
    """The sum of the context words' numbers, each weighed by its place; ``before``: the classes one place back, two places, ..."""
    table = p["context"] * p["place"][:, None, :]  # small, unlike the rows that are taken from it
    guess = table[0].take(before[0], 0)
    for j in range(1, len(table)):
        guess += table[j].take(before[j], 0)
    return guess


def gradients(p: dict[str, np.ndarray], before: list[np.ndarray], target: np.ndarray, noise: np.ndarray, shares: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss with which tokens are told from ``noise`` words drawn by ``shares``; all tokens share the noise."""
    n, k = len(target), len(noise)
    guess = guesses(p, before)
    expected = np.log(k * shares).astype(guess.dtype)
    own = p["target"][target]
    true = np.einsum("ij,ij->i", guess, own) + (p["bias"] - expected)[target]
    false = guess @ p["target"][noise].T
    false += (p["bias"] - expected)[noise]
    g_true = (-1 / (1 + np.exp(np.clip(true, -60, 60)))) / n
    np.clip(false, -60, 60, out=false)
    np.exp(-false, out=false)
    false += 1
    g_false = np.divide(1 / n, false, out=false)
    g_target = _scattered(target, np.c_[g_true[:, None] * guess, g_true], len(shares))
    np.add.at(g_target, noise, np.c_[g_false.T @ guess, g_false.sum(0)])
    own *= g_true[:, None]
    g_guess = own + g_false @ p["target"][noise]
    g_table = np.stack([_scattered(b, g_guess, len(p["context"])) for b in before])
    return {
        "context": (g_table * p["place"][:, None, :]).sum(0),
        "place": (g_table * p["context"]).sum(1),
        "target": g_target[:, :-1],
        "bias": g_target[:, -1],
    }


def _trainer(known: Broadcast, words: int, start: Broadcast, shares: np.ndarray, turn: int, rate: float):
    """Learn from the texts of a task, beginning with the common parameters; pass on its own ones times its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([turn, TaskContext.get().partitionId()])
        p = {name: v.astype(np.float32) for name, v in start.value.items()}
        squares = {name: np.full_like(v, 1e-6) for name, v in p.items()}
        stream = Stream(*known.value, words)
        limits = np.cumsum(shares)
        learned = 0

        def learn():
            classes, places, _ = stream.take()
            places = rng.permutation(places)
            for at in range(0, len(places), STEP):
                some = places[at : at + STEP]
                noise = np.minimum(np.searchsorted(limits, rng.random(NOISE)), len(shares) - 1)
                for name, g in gradients(p, [classes[some - j] for j in range(1, CONTEXT + 1)], classes[some], noise, shares).items():
                    squares[name] += g * g
                    p[name] -= rate * g / np.sqrt(squares[name])
            return len(places)

        for batch in batches:
            for text in texts_of(batch):
                stream.add(text, 0)
                if stream.size >= BUFFER:
                    learned += learn()
        if stream.size:
            learned += learn()
        if learned:
            flat = np.concatenate([p[name].ravel() for name in start.value]).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(flat)), "v": flat * learned, "n": np.full(len(flat), learned)})

    return run


def split_of(id_col: str = "doc_id") -> Column:
    """0 to 6 from the id alone; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7


def fit(docs: DataFrame, text_col: str = "text", words: int = WORDS, rounds: int = ROUNDS, known: int = KNOWN) -> Model:
    """Learn from every row of ``docs``; a null text is an empty one.

    Words are counted over all rows. The ``words`` - 1 most frequent ones and the end of a text have a class each, all others share
    classes by their endings. Then each task learns from its texts with noise-contrastive estimation, and the tasks' parameters are
    averaged by their tokens, ``rounds`` times. The driver receives the ``known`` most frequent words with their counts and the
    parameters, both of bounded size; counts and parameters of the tasks are summed by Spark.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    counted = texts.mapInArrow(_count, "word string, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))
    counted = ranked(counted, "word")
    sums = counted.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = int(sums[0] or 0), int(sums[1])
    found = counted.where((F.col("id") < known) | (F.col("word") == "")).select(F.col("word").cast("binary").alias("word"), "id", "ending", "n").toArrow()
    numbers = np.argsort(found.column("id").to_numpy())
    ends, n = found.column("ending").to_numpy()[numbers], found.column("n").to_numpy()[numbers]
    listed = found.column("word").take(pa.array(numbers)).to_pylist()
    own = [w for w in listed[:words] if w][: words - 1]
    words = len(own) + 1
    classes = ends.astype(np.int64) + words
    place = {w: i for i, w in enumerate(own, 1)}
    for i, w in enumerate(listed[: words + 1]):
        if w in place:
            classes[i] = place[w]
    # tokens and distinct words of every class
    size = np.zeros((2, words + ENDINGS))
    for word, number in zip(listed, n):
        if word in place:
            size[:, place[word]] = number, 1
    ends_of_texts = int(n[listed.index(b"")]) if b"" in listed else 0
    size[:, 0] = ends_of_texts, 1
    for ending, tokens, different in counted.where(~F.col("word").isin([w.decode() for w in own] + [""])).groupBy("ending").agg(F.sum("n"), F.count(F.lit(1))).collect():
        size[:, words + ending] = tokens, different
    shares = (size[0] + 1) / (size[0] + 1).sum()
    dens = np.where(np.arange(size.shape[1]) < words, 0.0, np.log10(size.sum(0) + 1))
    table = context.broadcast(({w: i for i, w in enumerate(listed) if w}, classes))
    p = initial(shares)
    for turn in range(rounds if total else 0):
        trained = texts.mapInArrow(_trainer(table, words, context.broadcast(p), shares, turn, 0.05 / (turn + 1)), "i long, v double, n long")
        sums = stored(trained.groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")), "parameters").toArrow()
        flat = np.empty(sums.num_rows)
        flat[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
        cuts = np.cumsum([v.size for v in p.values()])[:-1]
        p = {name: part.reshape(v.shape) for (name, v), part in zip(p.items(), np.split(flat, cuts))}
    tail = counted.where(F.col("id") >= known).select("word", "n")
    return Model(table, np.log10(n + 1.0), dens, p, total, distinct, ends_of_texts, None if distinct <= known else tail)


def log_probabilities(p: dict[str, np.ndarray], before: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """log10 of the class probabilities, which sum to 1 over all classes."""
    scores = guesses(p, before) @ p["target"].T
    scores += p["bias"]
    true = scores[np.arange(len(target)), target]
    if np.abs(scores).max(initial=0) > 60:  # beyond what single numbers bear
        top = scores.max(1, keepdims=True)
        scores -= top
        true = true - top[:, 0]
    np.exp(scores, out=scores)
    return (true - np.log(scores.sum(1))) / math.log(10)


def _scorer(known: Broadcast, logs: np.ndarray, dens: np.ndarray, parameters: Broadcast, tail: bool):
    words = len(dens) - ENDINGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = {name: v.astype(np.float32) for name, v in parameters.value.items()}
        log = np.r_[logs, 0.0]  # the last one is for words without number
        for batch in batches:
            size = batch.num_rows
            tokens, hits, base, model = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
            opened, stream = [], Stream(*known.value, words)

            def score():
                classes, places, owner = stream.take()
                found = np.zeros(len(classes))
                # a run of places at a time, with those of the context among them, whose results aren't used
                for at in range(CONTEXT, len(classes), SCORED):
                    end = min(at + SCORED, len(classes))
                    target = np.minimum(classes[at:end], words + ENDINGS - 1)
                    found[at:end] = log_probabilities(p, [classes[at - j : end - j] for j in range(1, CONTEXT + 1)], target)
                np.add.at(model, owner, found[places])

            for k, text in enumerate(texts_of(batch)):
                rare: Counter = Counter()

                def seen(run, numbers, classes):
                    hits[k] += np.count_nonzero(numbers >= 0)
                    base[k] += log[numbers].sum()
                    shared = classes >= words
                    model[k] += (log[numbers[shared]] - dens[classes[shared]]).sum()
                    if tail:
                        rare.update(run[i] for i in np.flatnonzero(numbers < 0))

                tokens[k] = stream.add(text, k, seen)
                opened.append([{"word": w, "times": n} for w, n in rare.items()])
                if stream.size >= BUFFER:
                    score()
            if stream.size:
                score()
            kind = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, (tokens, hits, base, model)), pa.array(opened, kind)], ["id", "tokens", "hits", "base", "model", "open"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (id_col, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are the words of the whole text and its end; ``n_known`` of them occur in the learned texts. ``base_score`` sums
    log10((c + 1) / (N + V + 1)). ``score`` sums the log10 probabilities of the model: that of the token's class after the words
    before it, normalised over all classes, times the word's share of its class. A null text is empty and has one token, its end; equal
    texts get equal scores; an empty table gives an empty result; other columns are ignored.

    Tasks hold the counts of the most frequent words; the others are looked up by a join on the word.
    """
    kind = dict(docs.dtypes)[id_col]
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    run = _scorer(model.known, model.logs, model.dens, context.broadcast(model.parameters), model.tail is not None)
    out = rows.mapInArrow(run, f"id {kind}, tokens long, hits long, base double, model double, open array<struct<word: binary, times: long>>")
    tokens, hits, base, scored = F.col("tokens"), F.col("hits"), F.col("base"), F.col("model")
    if model.tail is not None:
        out = stored(out.withColumn("key", F.monotonically_increasing_id()), "scores")
        rare = out.select("key", F.inline("open")).select("key", F.col("word").cast("string").alias("word"), "times")
        rare = rare.join(model.tail, "word").groupBy("key").agg(F.sum("times").alias("also"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
        out = out.join(rare, "key", "left")
        more = F.coalesce("more", F.lit(0.0))
        hits, base, scored = hits + F.coalesce("also", F.lit(0)), base + more, scored + more
    share = math.log10(model.total + model.distinct + 1)
    return out.select(
        F.col("id").alias(id_col),
        tokens.alias("n_tokens"),
        (hits + (1 if model.ends else 0)).cast("bigint").alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (base + math.log10(model.ends + 1) - tokens * share).alias("base_score"),
        scored.alias("score"),
    )
