"""A true edit metric, one pair at a time and for many strings in numpy, and a BK-tree over it."""

from __future__ import annotations

import numpy as np

CHUNK = 2048


def edit_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insertions, deletions, substitutions and transpositions cost one each.

    Unlike the 'optimal string alignment' form it obeys the triangle inequality, which metric pruning needs.
    """
    if a == b:
        return 0
    if not a or not b:
        return len(a) or len(b)
    n, m = len(a), len(b)
    top = n + m
    last: dict[str, int] = {}
    d = [[top] * (m + 2)]
    d.append([top, *range(m + 1)])
    for i in range(1, n + 1):
        row = [top, i] + [0] * m
        prev = d[i]
        ca, at = a[i - 1], 0
        for j in range(1, m + 1):
            cb = b[j - 1]
            k = last.get(cb, 0)
            if ca == cb:
                best = prev[j]
            else:
                best = 1 + min(prev[j], row[j], prev[j + 1])
            t = d[k][at] + (i - k - 1) + 1 + (j - at - 1)
            if t < best:
                best = t
            if ca == cb:
                at = j
            row[j + 1] = best
        d.append(row)
        last[ca] = i
    return d[n + 1][m + 1]


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, one row each, zero-filled, and their lengths."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    out = np.zeros((len(words), int(sizes.max(initial=0))), dtype=np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), dtype=np.int32)
    return out, sizes


def distances(word: str, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """`edit_distance` of one word to every row of `codes`, by the same recurrence over whole columns."""
    n, width = codes.shape
    m = len(word)
    if not m or not width:
        return np.maximum(sizes, m)
    ar, top = np.arange(n), width + m
    d = np.full((width + 2, m + 2, n), top, dtype=np.int16)
    d[1, 1:] = np.arange(m + 1, dtype=np.int16)[:, None]
    d[1:, 1] = np.arange(width + 1, dtype=np.int16)[:, None]
    last = {c: np.zeros(n, dtype=np.int64) for c in set(word)}
    for i in range(1, width + 1):
        ci = codes[:, i - 1]
        at = np.zeros(n, dtype=np.int64)
        same = {c: ci == ord(c) for c in last}
        for j in range(1, m + 1):
            eq, k = same[word[j - 1]], last[word[j - 1]]
            best = np.minimum(d[i + 1, j], d[i, j + 1]) + 1
            np.minimum(best, d[i, j] + ~eq, out=best)
            np.minimum(best, d[k, at, ar] + (i - k + j - at - 1), out=best, casting="unsafe")
            d[i + 1, j + 1] = best
            at = np.where(eq, j, at)
        for c, eq in same.items():
            last[c] = np.where(eq, i, last[c])
    return d[sizes + 1, m + 1, ar].astype(np.int64)


class BKTree:
    """Burkhard-Keller tree: `within(q, r)` gives every entry at distance r or less, by triangle-inequality pruning."""

    def __init__(self, words):
        self.root = None
        self.size = 0
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root, self.size = (word, {}), 1
            return
        node = self.root
        while True:
            d = edit_distance(word, node[0])
            if d == 0:
                return
            if d in node[1]:
                node = node[1][d]
            else:
                node[1][d] = (word, {})
                self.size += 1
                return

    def within(self, q: str, r: int) -> list[tuple[int, str]]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            word, kids = todo.pop()
            d = edit_distance(q, word)
            if d <= r:
                out.append((d, word))
            todo.extend(kid for k, kid in kids.items() if d - r <= k <= d + r)
        return out

    def within_many(self, words: list[str], r: int) -> list[list[tuple[int, str]]]:
        """`within` for many words: each node is compared with all words that reach it at once."""
        out: list[list[tuple[int, str]]] = [[] for _ in words]
        for start in range(0, len(words), CHUNK):
            codes, sizes = codes_of(words[start : start + CHUNK])
            todo = [(self.root, np.arange(len(sizes)))] if self.root else []
            while todo:
                (word, kids), here = todo.pop()
                d = distances(word, codes[here], sizes[here])
                for i in np.nonzero(d <= r)[0]:
                    out[start + int(here[i])].append((int(d[i]), word))
                for k, kid in kids.items():
                    reach = here[np.abs(d - k) <= r]
                    if len(reach):
                        todo.append((kid, reach))
        return out
