"""Evaluation passages inside a corpus (problem 8), found with one FM-index per shard of the corpus.

Method: each task cuts its documents into shards of about `shard_words` words and builds an FM-index of each: suffix array by
prefix doubling, Burrows-Wheeler transform, wavelet matrix for ranks, suffix positions sampled every `sample` places.
All windows of `n` words of the held-out passages are searched backward at once (the rank queries of all windows are one
numpy call per step and level); occurrences are located by LF-walking to a sampled position; the windows found in a
document merge into removal spans.

Words are what is compared: markup and entities are dropped, the rest is case-folded and composed, words are runs of
letters and digits (an apostrophe or hyphen joins its sides). A word no passage has is a break, as is a document's end; runs
of fewer than `n` known words can't hold a window and are left out of the index. That loses no match.

Nothing is shuffled: the passages are broadcast, the corpus is mapped once. Their size is checked first: held-out sets of more
than `slice_bytes` of text are cut into slices by the hash of the item, each gathered, broadcast and searched by itself, so
there is no limit to their number. A text repeated in a third of the documents makes many occurrences in every shard, each
handled where it lies.

Defined results: NULL and empty texts hold nothing; passages of fewer than `n` words can't be found; repeated documents are
found each; very long texts are indexed whole, a shard is closed after the document that fills it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.session import spread

WINDOW = 12
SHARD_WORDS = 400_000
SAMPLE = 16
SLICE_BYTES = 32_000_000
AT_ONCE = 100_000

_TAG = re.compile(r"<[^<>]+>")
_JOIN = re.compile(r"(?<=\w)['’‘ʼ`´\-‐‑­​‌‍⁠﻿]+(?=\w)|[­​‌‍⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The words of a text whatever its case, punctuation, markup, blanks and line breaks."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = unicodedata.normalize("NFC", text).casefold()
    return _WORD.findall(_JOIN.sub("", text))


class FMIndex:
    """FM-index over a sequence of symbols 1..sigma-1; symbol 0 ends it."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        seq = np.append(seq, 0).astype(np.int64)
        self.n, self.sample = len(seq), sample
        sa = self._suffix_array(seq)
        bwt = seq[sa - 1]
        sigma = int(seq.max()) + 1
        counts = np.bincount(seq, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros, self.ranks = [], []
        level = bwt.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            self.ranks.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.bwt = bwt.astype(np.int32)
        marked = sa % sample == 0
        self.marked = marked
        self.mark_rank = np.concatenate([[0], np.cumsum(marked)]).astype(np.int32)
        self.samples = sa[marked].astype(np.int32)

    @staticmethod
    def _suffix_array(seq: np.ndarray) -> np.ndarray:
        n = len(seq)
        rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
        k = 1
        while True:
            nxt = np.zeros(n, dtype=np.int64)
            nxt[: n - k] = rank[k:] + 1 if k < n else 0
            key = rank * (n + 2) + nxt
            sa = np.argsort(key, kind="stable")
            srt = key[sa]
            new = np.empty(n, dtype=np.int64)
            new[sa] = np.concatenate([[0], np.cumsum(srt[1:] != srt[:-1])])
            rank = new
            if int(rank[sa[-1]]) == n - 1 or k >= n:
                return sa
            k *= 2

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often `symbol` stands in the transform before place i, for arrays of both, through the wavelet levels."""
        lo = np.zeros_like(i)
        hi = i.copy()
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            ones, z = self.ranks[level], self.zeros[level]
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(bit == 1, z + lo1, lo - lo1)
            hi = np.where(bit == 1, z + hi1, hi - hi1)
        return hi - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row interval [lo, hi) of every row of `patterns`, by backward search of all of them together."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        sigma = len(self.first) - 1
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            inside = c < sigma
            hi[alive[~inside]] = lo[alive[~inside]] = 0
            alive, c = alive[inside], c[inside]
            if not len(alive):
                break
            a = self.first[c] + self.rank(c, lo[alive])
            b = self.first[c] + self.rank(c, hi[alive])
            lo[alive], hi[alive] = a, b
            alive = alive[a < b]
        dead = np.ones(len(patterns), dtype=bool)
        dead[alive] = False
        hi[dead] = lo[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of transform rows: LF-walk until a sampled one."""
        rows = rows.astype(np.int64)
        out = np.zeros(len(rows), dtype=np.int64)
        walking, steps = np.arange(len(rows)), 0
        while len(walking):
            at = rows[walking]
            hit = self.marked[at]
            done = walking[hit]
            out[done] = self.samples[self.mark_rank[rows[done]]] + steps
            walking = walking[~hit]
            at = rows[walking]
            c = self.bwt[at].astype(np.int64)
            rows[walking] = self.first[c] + self.rank(c, at)
            steps += 1
        return out


class Windows:
    """All windows of n words of the passages, as symbols, with the item each belongs to.

    The passages are kept as one row of symbols; windows are cut out of it as they are needed.
    """

    def __init__(self, passages: list[tuple[int, str]], n: int):
        self.n = n
        self.vocab: dict[str, int] = {}
        seq, starts, owner, self.names = [], [], [], []
        place: dict = {}
        for item, text in passages:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 2) for w in words_of(text)]
            k = place.setdefault(item, len(place))
            windows = range(len(seq), len(seq) + len(ids) - n + 1)
            starts += windows
            owner += [k] * len(windows)
            seq += ids
        self.names = list(place)
        self.seq, self.starts, self.owner = (np.array(x, dtype=np.int32) for x in (seq, starts, owner))

    def cut(self, a: int, b: int) -> np.ndarray:
        return self.seq[self.starts[a:b, None] + np.arange(self.n)].astype(np.int64)

    @property
    def patterns(self) -> np.ndarray:
        return self.cut(0, len(self.starts)).reshape(-1, self.n)

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Symbols of the runs of n known words or more, each run closed by the break 1, and the word places they stand at."""
        seq, places, run, start = [], [], [], 0
        get = self.vocab.get
        for i, w in enumerate(words_of(text)):
            s = get(w)
            if s is None:
                if len(run) >= self.n:
                    seq += [*run, 1]
                    places += [*range(start, start + len(run)), -1]
                run = []
            else:
                if not run:
                    start = i
                run.append(s)
        if len(run) >= self.n:
            seq += [*run, 1]
            places += [*range(start, start + len(run)), -1]
        return seq, places


def _search_shard(docs: list, starts: list[int], seq: list[int], places: list[int], win: Windows) -> Iterator[tuple]:
    if not seq or not len(win.starts):
        return
    index = FMIndex(np.array(seq, dtype=np.int64))
    first, word = np.array(starts), np.array(places)
    hits: list[np.ndarray] = []
    for a in range(0, len(win.starts), AT_ONCE):
        lo, hi = index.search(win.cut(a, a + AT_ONCE))
        found = np.nonzero(hi > lo)[0]
        if not len(found):
            continue
        reps = (hi - lo)[found]
        rows = np.repeat(lo[found], reps) + (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
        at = index.locate(rows)
        hits.append(np.stack([np.searchsorted(first, at, side="right") - 1, np.repeat(win.owner[a + found], reps), word[at]], axis=1))
    if not hits:
        return
    # by document and item, in order of the words; a window that starts behind the last one's end opens a new span
    got = np.unique(np.concatenate(hits), axis=0)
    new = np.ones(len(got), dtype=bool)
    new[1:] = (got[1:, :2] != got[:-1, :2]).any(axis=1)
    fresh = new.copy()
    fresh[1:] |= got[1:, 2] > got[:-1, 2] + win.n
    opens = np.nonzero(fresh)[0]
    ends = np.append(opens[1:], len(got)) - 1
    spans = np.stack([got[opens, 2], got[ends, 2] + win.n], axis=1).tolist()
    groups = np.nonzero(new[opens])[0]
    for a, b in zip(groups, [*groups[1:], len(opens)], strict=True):
        d, k, _ = got[opens[a]]
        yield docs[d], win.names[k], spans[a:b]


def leaked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           passage: str = "passage", n: int = WINDOW, shard_words: int = SHARD_WORDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(key, item, spans): the documents that hold n consecutive words of an item, and the word spans to remove.

    `spans` is an array of [first word, word after the last], in words of the document.
    """
    held = items.select(F.col(item), F.col(passage)).where(F.col(passage).isNotNull())
    size = held.agg(F.sum(F.octet_length(passage))).first()[0] or 0
    slices = max(1, -(-int(size) // slice_bytes))
    rows = spread(docs.select(key, text).where(F.col(text).isNotNull()))
    kinds = dict(docs.dtypes) | {item: dict(items.dtypes)[item]}
    schema = f"`{key}` {kinds[key]}, `{item}` {kinds[item]}, spans array<array<int>>"
    # an item stands in one slice; one slice at a time is gathered
    parts = []
    for i in range(slices):
        mine = held.where(F.pmod(F.xxhash64(F.col(item).cast("string")), F.lit(slices)) == i) if slices > 1 else held
        parts.append(rows.mapInPandas(_searcher(docs, [(r[0], r[1]) for r in mine.collect()], key, text, item, n, shard_words), schema))
    return reduce(DataFrame.unionByName, parts)


def leaked_spans(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """(key, item, first_word, end_word): one row per span to remove."""
    got = leaked(docs, items, **names)
    key, item = got.columns[:2]
    return got.select(key, item, F.explode("spans").alias("s")).select(key, item, F.col("s")[0].alias("first_word"), F.col("s")[1].alias("end_word"))


def leaked_items(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """(item, documents, words): in how many documents an item stands, and how many of their words are its own."""
    got = leaked(docs, items, **names)
    words = F.aggregate("spans", F.lit(0), lambda a, s: a + s[1] - s[0])
    return got.groupBy(got.columns[1]).agg(F.count(F.lit(1)).alias("documents"), F.sum(words).alias("words"))


def _searcher(docs: DataFrame, held: list[tuple[int, str]], key: str, text: str, item: str, n: int, shard_words: int):
    shared = docs.sparkSession.sparkContext.broadcast(Windows(held, n))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        win = shared.value
        ids, starts, seq, places, out = [], [], [], [], []

        def flush():
            out.extend(_search_shard(ids, starts, seq, places, win))
            ids.clear(), starts.clear(), seq.clear(), places.clear()

        for pdf in batches:
            for k, t in zip(pdf[key], pdf[text], strict=True):
                s, p = win.encode(t)
                if not s:
                    continue
                ids.append(k), starts.append(len(seq))
                seq += s
                places += p
                if len(seq) >= shard_words:
                    flush()
            if out:
                yield pd.DataFrame(out, columns=[key, item, "spans"])
                out.clear()
        flush()
        if out:
            yield pd.DataFrame(out, columns=[key, item, "spans"])

    return search
