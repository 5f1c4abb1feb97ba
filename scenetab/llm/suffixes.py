"""Suffix arrays of shards: sorting by refinement, common prefixes, and look-up across shards by binary search.

A shard is a run of short byte strings laid end to end in one array. Everything here works on whole arrays.
"""

from __future__ import annotations

import numpy as np

PAD = 256


def words_of(data: np.ndarray, pad: int = PAD) -> np.ndarray:
    """The eight bytes from every place as one big-endian number; zeros follow the end."""
    w = np.concatenate([data, np.zeros(pad + 8, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        w = (w[:-shift] << np.uint64(8 * shift)) | w[shift:]
    return w[: len(data) + pad]


def suffix_array(words: np.ndarray, n: int) -> np.ndarray:
    """Starts of the ``n`` suffixes in order.

    Suffixes are sorted by their first eight bytes; then only groups that are still equal are sorted again, by the rank of the
    suffix that begins where the known equal part ends, and that part doubles.
    """
    sa = np.argsort(words[:n], kind="stable")
    first = np.r_[True, words[sa[1:]] != words[sa[:-1]]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    depth, open_ = 8, np.arange(n)
    while True:
        alone = first & np.r_[first[1:], True] if n else first
        open_ = open_[~alone[open_]]
        if not len(open_):
            return sa
        s = sa[open_]
        after = s + depth
        key = rank[s] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        s, key = s[order], key[order]
        sa[open_] = s
        begins = np.r_[True, key[1:] != key[:-1]]
        first[open_] = begins
        rank[s] = np.maximum.accumulate(np.where(begins, open_, 0))
        depth *= 2


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading bytes in which two words agree, from their exclusive or."""
    return sum((x < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8)) + (x == 0)


def common_prefixes(words: np.ndarray, sa: np.ndarray, starts: np.ndarray, lengths: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, counted up to ``limit``.

    The string's next suffix shares at least one byte less with its own predecessor than the last one did, so comparing goes
    on from there. All strings of the shard step forward together.
    """
    n = len(sa)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    found = np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    h = np.zeros(len(starts), np.int64)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -t))
        at = starts[:live] + t
        where = place[at]
        before = sa[np.maximum(where - 1, 0)]
        own = np.maximum(h[:live] - 1, 0)
        own[where == 0] = 0
        go = np.flatnonzero((own < limit) & (where > 0))
        while len(go):
            same = _equal_bytes(words[at[go] + own[go]] ^ words[before[go] + own[go]])
            own[go] += same
            go = go[(same == 8) & (own[go] < limit)]
        own = np.minimum(own, limit)
        found[where] = own
        h[:live] = own
    return found


def keys_at(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each place as rows of numbers that sort like the bytes."""
    whole, rest = divmod(width, 8)
    columns = [words[at + 8 * k] for k in range(whole)]
    if rest:
        columns.append(words[at + 8 * whole] >> np.uint64(64 - 8 * rest))
    return np.stack(columns, 1) if len(at) else np.zeros((0, whole + bool(rest)), np.uint64)


def search(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted row, whether it is among the sorted ``keys``."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
    rows = np.arange(len(wanted))
    while (low < high).any():
        mid = (low + high) // 2
        probe = keys[np.minimum(mid, len(keys) - 1)]
        column = (probe != wanted).argmax(1)
        less = probe[rows, column] < wanted[rows, column]
        busy = low < high
        low = np.where(busy & less, mid + 1, low)
        high = np.where(busy & ~less, mid, high)
    inside = low < len(keys)
    return inside & (keys[np.minimum(low, max(len(keys) - 1, 0))] == wanted).all(1) if len(keys) else np.zeros(len(wanted), bool)


class Shards:
    """Finds, in strings that come group by group and within a group in order, the windows that an earlier string has.

    Strings are gathered into shards of about ``size`` bytes. A group that goes on in the next shard leaves its distinct
    windows behind in order, and the next shard's are looked up among them.
    """

    def __init__(self, width: int = 100, size: int = 1 << 20):
        self.width, self.size = width, size
        self.strings: list[bytes] = []
        self.groups: list[int] = []
        self.left: tuple[int, np.ndarray] | None = None

    def add(self, group: int, string: bytes) -> None:
        self.strings.append(string)
        self.groups.append(group)

    def full(self) -> bool:
        return sum(map(len, self.strings)) >= self.size

    def close(self) -> list[np.ndarray]:
        """For each string of the shard, which of its windows are repeats."""
        repeat, starts, lengths = self._repeats()
        return [repeat[s : s + max(n - self.width + 1, 0)] for s, n in zip(starts, lengths)]

    def close_runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, start in it, windows) of each run of repeats in the shard."""
        repeat, starts, lengths = self._repeats()
        # windows only, so the last byte of a string is none and no run goes on in the next string, unless windows are single bytes
        opens = repeat & ~np.r_[False, repeat[:-1]]
        if self.width == 1:
            opens[starts[lengths > 0]] = repeat[starts[lengths > 0]]
        begin = np.flatnonzero(opens)
        stop = np.flatnonzero(repeat & np.r_[~repeat[1:] | opens[1:], True]) + 1 if len(repeat) else begin
        owner = np.searchsorted(starts, begin, "right") - 1
        return owner, begin - starts[owner], stop - begin

    def _repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.strings:
            return np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.array([len(s) for s in self.strings])
        starts = np.cumsum(lengths) - lengths
        groups = np.array(self.groups)
        data = np.frombuffer(b"".join(self.strings), np.uint8)
        words = words_of(data)
        sa = suffix_array(words, len(data))
        same = common_prefixes(words, sa, starts, lengths, self.width) >= self.width
        owner = np.repeat(np.arange(len(lengths)), lengths)
        window = np.arange(len(data)) - starts[owner] + self.width <= lengths[owner]
        run = np.cumsum(~same)
        inside = window[sa]
        at, run = sa[inside], run[inside]
        repeat = np.zeros(len(data), bool)
        if len(at):
            begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            first = np.minimum.reduceat(at, begins)
            repeat[at] = True
            repeat[first] = False
            # the earliest window of each run, in the order of their bytes
            if self.left and (groups == self.left[0]).any():
                mine = first[groups[owner[first]] == self.left[0]]
                known = search(self.left[1], keys_at(words, mine, self.width))
                repeat[mine[known]] = True
            last = first[(groups[owner[first]] == groups[-1]) & ~repeat[first]]
            keys = keys_at(words, last, self.width)
            if self.left and self.left[0] == groups[-1]:
                keys = np.concatenate([self.left[1], keys])
                keys = keys[np.lexsort(keys.T[::-1])]
            self.left = (int(groups[-1]), keys)
        self.strings, self.groups = [], []
        return repeat, starts, lengths
