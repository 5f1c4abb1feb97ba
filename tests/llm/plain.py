"""Plain versions that more than one test file needs: loops over rows, without the library's arrays or joins."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from scenetab.llm import langid

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOW))


def trigrams(text):
    """Numbers of a text's trigrams of folded bytes; those that begin with two blanks have none."""
    b = b" " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()) + b" "
    return [((b[k] | b[k + 1] << 8 | b[k + 2] << 16) * 2654435761 % 2**32) >> 18 for k in range(len(b) - 2) if b[k] != 32 or b[k + 1] != 32]


def languages(table, doubt=0.4):
    """(language, score, ambiguous) of each (id, text, lang): counts, one log odds per bit and trigram, logistic losses."""
    counts = defaultdict(Counter)
    for i, t, lang in table:
        if t is not None and lang is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 3 != 1:
            counts[lang].update(trigrams(t))
    names = sorted(counts)
    code = langid.codewords(len(names))
    share = {n: {f: c / max(sum(counts[n].values()), 1) for f, c in counts[n].items()} for n in names}
    odds = {}

    def weight(f):
        if f not in odds:
            odds[f] = []
            for bit in range(code.shape[1]):
                yes = [share[n].get(f, 0) for n, c in zip(names, code) if c[bit] > 0]
                no = [share[n].get(f, 0) for n, c in zip(names, code) if c[bit] < 0]
                odds[f].append(math.log(sum(yes) / len(yes) + 1e-6) - math.log(sum(no) / len(no) + 1e-6) if yes and no else 0.0)
        return odds[f]

    out = []
    for _, t, _ in table:
        if not names or not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0, True))
            continue
        grams = [weight(f) for f in trigrams(t)]
        margins = [sum(g[bit] for g in grams) / max(len(grams), 1) for bit in range(code.shape[1])]
        losses = [sum(math.log1p(math.exp(-4 * m * c)) for m, c in zip(margins, row)) for row in code]
        best = min(range(len(names)), key=lambda k: losses[k])
        score = 1 / sum(math.exp(losses[best] - x) for x in losses)
        out.append((names[best], score, score < doubt))
    return out


def components(table, n, percent):
    """(number of the class or None, words?) of each (id, text): documents linked by the similarity of their shingles."""
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
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= percent * large and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    return [top(k) if s else None for k, s in enumerate(sets)]


def contaminated(text, items):
    """Is a twentieth of the words inside 13 words in a row of an item, or inside all of a shorter item?"""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit = words(text, pattern), set()
    for item in items:
        q = words(item, pattern)
        n = min(13, len(q))
        windows = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if q else set()
        hit.update(x for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in windows for x in range(p, p + n))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def shard(i, n):
    key = "" if i is None else str(i)
    return min((-math.log((int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52), s) for s in range(n))[1]
