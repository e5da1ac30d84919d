"""Language of documents and of each stretch of them, with a confidence (problem 4).

Method: a sentence's words and their character n-grams are hashed to embeddings, averaged, and classified by a linear
softmax; everything is trained by stochastic gradient descent in numpy on labelled rows. Rejection is calibrated: on
held-out sentences a temperature is fitted and the threshold chosen above which `PRECISION` of them are right (at least
`LEAST`); below it a sentence gets no language of its own.

Labels are noisy, so training is two-fold first: each half is predicted by a model of the other half, rows whose label the
other model contradicts are left out, and so are labels that are mostly contradicted. What stays trains the final model.

The sample is bounded by `sample` rows (a documented parameter; those of smallest id hash among the rows with a label and a
text) and, so that no language drops out, what each label lacks of `LABEL_LEAST` rows; it is the one thing collected. Every
row is classified, in an Arrow-batched function with the model broadcast, without a shuffle.

Text decoded wrongly is restored first; the places given are those in the text as stored. Quoted titles and bracketed
citations don't count as sentences, quoted sentences do.

Defined results: NULL, blank and wordless texts have no language; a sentence below the threshold belongs to the stretch around
it; very long texts are read whole; with no labelled rows there is no model and no language.
"""

from __future__ import annotations

import re
from html import unescape
from uuid import uuid4
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.llm.canon import with_reference
from stackroom.llm.mojibake import Garbled, built, patterns_of
from stackroom.llm.sampling import smallest_hashes_by
from stackroom.session import spread

SAMPLE = 4000
LABEL_LEAST = 40
BITS = 16
DIM = 16
SEED = 5
MIN_WORDS = 4
PRECISION = 0.998
LEAST = 0.75

_BREAK = re.compile(r"<\s*/?\s*(?:p|br|div|li|h\d)\b[^>]*>|\n+|\r+", re.I)
_TAG = re.compile(r"<[/!?A-Za-z][^<>]*>")
_QUOTED = re.compile(r"\([^()]{0,300}\)|«[^«»]{0,200}»|“[^“”]{0,200}”|„[^„“”]{0,200}[“”]|\"[^\"]{0,200}\"")
_END = re.compile(r"(?<=[.!?…])[\"”’»)]*\s+(?=[^\s])")
# Abbreviations whose dot ends no sentence, besides single letters.
_INITIAL = re.compile(r"(?:^|[\s(])(?:\w|dr|mr|mrs|ms|st|prof|nr|no|núm|vol|bd|cap|pp|ed|eds|hrsg|vgl|cf|bzw|ca|etc)\.$", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")


_ENTITY = re.compile(r"&(?:#\d+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)")


def unescaped(text: str) -> tuple[str, list[int] | None]:
    """The text with its references read, and where each character (and the end) stood; None if at the same places."""
    if "&" not in text:
        return text, None
    parts, places, at = [], [], 0
    for m in _ENTITY.finditer(text):
        u = unescape(m[0])
        parts += [text[at : m.start()], u]
        places += [*range(at, m.start()), *[m.start()] * len(u)]
        at = m.end()
    return "".join(parts) + text[at:], [*places, *range(at, len(text) + 1)]


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, words) of the sentences of a text.

    Quoted titles and bracketed citations don't count, but quotations of whole sentences do, and so does what stands in
    quotes or brackets in a text that has nothing else.
    """
    blank = lambda m: " " * len(m[0])
    plain = _TAG.sub(blank, _BREAK.sub(lambda m: "\n" * len(m[0]), text))

    def hidden(m: re.Match) -> str:
        inner, before = m[0][1:-1].rstrip(), plain[: m.start()].rstrip(" ")
        whole = m[0][0] != "(" and inner.endswith((".", "!", "?", "…")) and (not before or before[-1] in ".!?…\n")
        return m[0] if whole else " " * len(m[0])

    return _sentences(_QUOTED.sub(hidden, plain)) or _sentences(plain)


def _sentences(plain: str) -> list[tuple[int, int, str]]:
    out = []
    for line in re.finditer(r"[^\n]+", plain):
        at, part = line.start(), line[0]
        cuts, last = [], 0
        for m in _END.finditer(part):
            head = part[last : m.start()].rstrip("\"”’»)")
            if not _INITIAL.search(head):
                cuts.append((last, m.end()))
                last = m.end()
        cuts.append((last, len(part)))
        for a, b in cuts:
            words = _WORD.findall(part[a:b])
            if words:
                out.append((at + a, at + b, " ".join(words).casefold()))
    return out


class Embedder:
    """Hashed words and n-grams; the buckets of each word are kept, for words come again and again."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def buckets(self, word: str) -> np.ndarray:
        got = self.kept.get(word)
        if got is None:
            if len(self.kept) > 200_000:
                self.kept.clear()
            w = f"<{word}>"
            grams = [w, *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))]
            got = self.kept[word] = np.array([crc32(g.encode()) & ((1 << BITS) - 1) for g in grams], dtype=np.int64)
        return got

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat buckets and how many each row has; a text has a word at least."""
        parts, sizes = [], []
        for t in texts:
            own = [self.buckets(w) for w in t.split()]
            parts += own
            sizes.append(sum(map(len, own)))
        return np.concatenate(parts), np.array(sizes)


class LangModel:
    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.emb = (rng.random((1 << BITS, DIM)).astype(np.float32) - 0.5) / DIM
        self.out = np.zeros((DIM, len(labels)), dtype=np.float32)
        self.bias = np.zeros(len(labels), dtype=np.float32)
        self.heat, self.least = 1.0, 0.5

    def _mean(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(self.emb[flat], starts, axis=0) / sizes[:, None].astype(np.float32)

    def logits(self, texts: list[str], e: Embedder) -> np.ndarray:
        out = np.zeros((len(texts), len(self.labels)), dtype=np.float32)
        for k in range(0, len(texts), 512):
            part = texts[k : k + 512]
            h = self._mean(*e.rows(part))
            out[k : k + 512] = h @ self.out + self.bias
        return out

    def proba(self, texts: list[str], e: Embedder) -> np.ndarray:
        z = self.logits(texts, e) / self.heat
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def fit(self, texts: list[str], y: np.ndarray, e: Embedder, epochs: int = 4, rate: float = 0.6, seed: int = SEED) -> LangModel:
        rng = np.random.default_rng(seed)
        steps, step, batch = epochs * (len(texts) // 32 + 1), 0, 32
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), batch):
                lr = rate * (1 - step / steps)
                step += 1
                part = order[k : k + batch]
                flat, sizes = e.rows([texts[i] for i in part])
                h = self._mean(flat, sizes)
                z = h @ self.out + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(part)), y[part]] -= 1
                gh = p @ self.out.T
                self.out -= lr * (h.T @ p)
                self.bias -= lr * p.sum(axis=0) / len(part)
                np.add.at(self.emb, flat, np.repeat(-lr * gh / sizes[:, None], sizes, axis=0).astype(np.float32))
        return self

    def calibrate(self, texts: list[str], y: np.ndarray, e: Embedder) -> LangModel:
        """Temperature of least log loss, then the threshold above which sentences are right `PRECISION` of the time."""
        if not len(texts):
            return self
        z = self.logits(texts, e)
        best = None
        for heat in np.geomspace(0.2, 5, 25):
            s = z / heat
            s = s - s.max(axis=1, keepdims=True)
            loss = float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))
            if best is None or loss < best[0]:
                best = (loss, float(heat))
        self.heat = best[1]
        p = self.proba(texts, e)
        conf, right = p.max(axis=1), p.argmax(axis=1) == y
        order = np.argsort(-conf)
        good = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
        ok = np.nonzero(good >= PRECISION)[0]
        # above the surest sentence that had to be left out, and never below what the held-out sentences can say nothing about
        out = conf[order][ok[-1] + 1 :] if len(ok) else conf[order]
        self.least = max(LEAST, float(np.nextafter(out[0], 2))) if len(out) else LEAST
        return self


def train(rows: list[tuple[str, str]], seed: int = SEED) -> LangModel | None:
    """A model from (text, label) rows with some wrong labels."""
    e = Embedder()
    # a row's sentences share its label and its fold
    parts = [(i, s, lab) for i, (text, lab) in enumerate(rows) for _, _, s in sentences(text) if len(s.split()) >= MIN_WORDS]
    if not parts:
        return None
    labels = sorted({p[2] for p in parts})
    place = {x: i for i, x in enumerate(labels)}
    texts, y = [p[1] for p in parts], np.array([place[p[2]] for p in parts])
    fold = np.array([crc32(str(p[0]).encode()) % 2 for p in parts])
    keep = np.ones(len(parts), dtype=bool)
    if len(labels) > 1 and 0 < fold.sum() < len(fold):
        guess = np.zeros(len(parts), dtype=np.int64)
        for f in (0, 1):
            tr, te = np.nonzero(fold != f)[0], np.nonzero(fold == f)[0]
            m = LangModel(labels, seed).fit([texts[i] for i in tr], y[tr], e)
            guess[te] = m.logits([texts[i] for i in te], e).argmax(axis=1)
        keep = guess == y
        sound = {c for c in range(len(labels)) if (y == c).any() and keep[y == c].mean() >= 0.5}
        if sound:
            keep &= np.isin(y, list(sound))
    if not keep.any():
        keep[:] = True
    left = sorted({labels[c] for c in set(y[keep].tolist())})
    again = {x: i for i, x in enumerate(left)}
    texts = [t for t, k in zip(texts, keep, strict=True) if k]
    y = np.array([again[labels[c]] for c in y[keep]])
    held = np.array([crc32(t.encode()) % 8 == 0 for t in texts])
    m = LangModel(left, seed).fit([t for t, h in zip(texts, held, strict=True) if not h] or texts, y[~held] if (~held).any() else y, e)
    return m.calibrate([t for t, h in zip(texts, held, strict=True) if h], y[held], e)


def stretches(text: str, m: LangModel, e: Embedder) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the stretches of one language in a text, in order."""
    parts = sentences(text)
    if not parts:
        return []
    p = m.proba([s for _, _, s in parts], e)
    best, conf = p.argmax(axis=1), p.max(axis=1)
    sizes = np.array([len(s.split()) for _, _, s in parts])
    sure = (conf >= m.least) & (sizes >= MIN_WORDS)
    # what isn't sure follows the text's main language, by the words of all its sentences
    main = int((p * sizes[:, None] * np.where(sure, 1.0, 0.2)[:, None]).sum(axis=0).argmax())
    lang = np.where(sure, best, main)
    out: list[tuple[int, int, str, float, int]] = []
    for (a, b, _), c, q, n in zip(parts, lang, p, sizes, strict=True):
        k = m.labels[c]
        if out and out[-1][2] == k:
            w = out[-1][4] + n
            out[-1] = (out[-1][0], b, k, (out[-1][3] * out[-1][4] + float(q[c]) * n) / w, w)
        else:
            out.append((a, b, k, float(q[c]), int(n)))
    return [s[:4] for s in out]


_embedders: dict[str, Embedder] = {}


def embedder(token: str) -> Embedder:
    """The words met so far, kept in a worker process."""
    if token not in _embedders:
        _embedders.clear()
        _embedders[token] = Embedder()
    return _embedders[token]


def language_spans(df: DataFrame, languages: DataFrame, key: str = "file_id", text: str = "description",
                   label: str = "language", sample: int = SAMPLE) -> DataFrame:
    """(key, label, code, spans) of every row with a text: `code` is the label's language ('' if none), `spans` its stretches.

    A stretch has the places of its start and end in the text as stored, its language and a confidence.
    """
    rows = df.select(F.col(key), F.col(text).alias("__t"), F.col(label).alias("__l")).where(F.col("__t").isNotNull())
    rows = with_reference(rows, "__l", languages, True, "code").withColumn("code", F.coalesce("code", F.lit("")))
    words = patterns_of(df, [text])
    garbled = Garbled(patterns=words)
    labelled = rows.where((F.col("code") != "") & F.col("__t").rlike(r"\p{L}")).select(key, "__t", "code")
    taught = smallest_hashes_by(labelled, key, "code", sample, LABEL_LEAST).collect()
    model = train([(garbled.check(r["__t"])[1], r["code"]) for r in taught])
    shared, token = df.sparkSession.sparkContext.broadcast((model, words)), uuid4().hex

    @F.pandas_udf("array<struct<start:int,end:int,lang:string,confidence:double>>")
    def spans(texts: pd.Series) -> pd.Series:
        m, lex = shared.value
        if m is None:
            return pd.Series([[] for _ in texts], dtype=object)
        e, fix = embedder(token), built(token, lex)
        out = []
        for t in texts:
            _, right, first = fix.restored(t)
            read, second = unescaped(right)
            at = lambda i: (lambda j: j if first is None else first[j])(i if second is None else second[i])  # noqa: B023, E731
            out.append([{"start": at(a), "end": at(b), "lang": c, "confidence": q} for a, b, c, q in stretches(read, m, e)])
        return pd.Series(out, dtype=object)

    # 'not deterministic' keeps filters on its result from running it a second time
    once = spans.asNondeterministic()
    return spread(rows).select(key, F.col("__l").alias(label), "code", once("__t").alias("spans"))


def stretch_rows(df: DataFrame, languages: DataFrame, **names) -> DataFrame:
    """(key, pos, start, end, lang, confidence): one row per stretch of one language, in order."""
    s = language_spans(df, languages, **names)
    key = s.columns[0]
    return s.select(key, F.posexplode("spans").alias("pos", "v")).select(key, "pos", "v.*")


def relabelled(df: DataFrame, languages: DataFrame, **names) -> DataFrame:
    """(key, lang, confidence): one row per language of each text whose label is missing, wrong, or whose text is mixed."""
    s = language_spans(df, languages, **names)
    key = s.columns[0]
    langs = F.array_distinct(F.transform("spans", lambda x: x["lang"]))
    wrong = (F.size(langs) > 1) | (F.col("code") == "") | ~F.array_contains(langs, F.col("code"))
    rows = s.where(F.size("spans") > 0).withColumn("langs", langs).where(wrong)
    best = lambda l: F.array_max(F.transform(F.filter("spans", lambda x: x["lang"] == l), lambda x: x["confidence"]))  # noqa: E731, E741
    return rows.select(key, F.explode(F.transform("langs", lambda l: F.struct(l.alias("lang"), best(l).alias("confidence")))).alias("v")).select(key, "v.*")  # noqa: E741
