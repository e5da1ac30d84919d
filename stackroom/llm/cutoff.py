"""Texts cut off by field limits or in transfer (problem 10).

Method: intact texts are cut artificially to make positives; a hashed logistic regression over closing characters,
punctuation, the last words and the length against the source's limit is trained on them and scores every record.

* Limits: different texts are counted per source and length, in characters and in bytes, over all rows (sketches of fixed
  size, pre-aggregated). A length is a limit if far more texts end there than at the lengths around it; at a source's greatest
  length fewer will do. A source may have several.
* Training sample: the `sample` texts of smallest id hash among those that look intact (not at a limit, closed by a mark, a
  signature, a list of keywords or verse lines). It is bounded by that documented parameter whatever the data's size, and
  is the one thing collected. Every text is scored.
* Positives: the text cut at random places inside a sentence and at limits that sources have, a third of them with dots added.
  Negatives: the text itself, prefixes of it that end with a sentence, some with their stop replaced by dots - so dots alone
  decide nothing, the words before them do - and cuts at a limit that happen to end with a sentence. Whether an example
  stands at a limit or near one is read off its length, as it is for the records.

Defined results: NULL and blank texts aren't cut (probability 0); texts that end with a whole sentence can't be told from
texts cut there and count as complete; repeated texts get the same score; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackroom.llm.linear import Logistic, hashed
from stackroom.llm.sampling import smallest_hashes
from stackroom.operators.joins import broadcast_checked
from stackroom.session import ensure_checkpoint_dir, spread

SAMPLE = 5000
NEAR = 3
AROUND = 25
BITS = 18
SEED = 11

_CLOSE_TAGS = re.compile(r"(?:\s*</\w+\s*>)+\s*$")
_DOTS = re.compile(r"\s*(?:\.{2,}|…+)$")
_WORDS = re.compile(r"[^\W_]+(?:[’'-][^\W_]+)*|[^\w\s]")
_STOPPED = re.compile(r"[.!?。](?:[\"”’»)\]]|</\w+>|\s)*$")
_SIGNED = re.compile(r"^\s*[—–-]\s*\w")
_LABELLED = re.compile(r"^\s*\w[\w ]{0,30}:\s.*;")
_RULED = re.compile(r"^\s*(?:[*#~=_-]\s*){3,}$")
_BOUNDARY = re.compile(r"[.!?][\"”’»)]*(?=\s)")


def _shape(w: str) -> str:
    """A word as it is, or for capitalised ones and numbers their kind and length."""
    if w.isdigit():
        return f"#{len(w)}"
    if w[:1].isupper():
        return f"A{len(w)}{'' if w[-1:].lower() in 'aeiouyаеиоуыэюя' else 'c'}"
    return w


def _kind(c: str) -> str:
    if not c:
        return "none"
    if c.isalpha():
        return "upper" if c.isupper() else "lower"
    return "digit" if c.isdigit() else c


def vocabulary(texts: list[str]) -> frozenset[str]:
    """The words that stand in two texts or more of the sample: whole words, as a cut word seldom does."""
    often = Counter(w for t in texts for w in set(re.findall(r"[^\W\d_]+", t[:-1])))
    return frozenset(w for w, n in often.items() if n >= 2)


def features(text: str, at_limit: bool, near: int, known: frozenset[str] = frozenset()) -> list[str]:
    """Feature strings of one text. `near` is a small class of the distance to the source's limit."""
    body = text.rstrip()
    broken = body.endswith("\ufffd")
    body = body.rstrip("\ufffd") if broken else body
    tagged = _CLOSE_TAGS.search(body)
    if tagged:
        body = body[: tagged.start()].rstrip()
    dots = _DOTS.search(body)
    ended = body[: dots.start()] if dots else body
    lines = [x for x in body.split("\n") if x.strip()]
    last = lines[-1] if lines else ""
    form = (
        "signed" if _SIGNED.match(last) and len(last) < 80
        else "labelled" if _LABELLED.match(last)
        else "ruled" if _RULED.match(last)
        else "verse" if len(lines) > 1 and "." not in body
        else "prose"
    )
    end = _kind(ended[-1:])
    before = _kind(ended.rstrip("”’»\"')]")[-1:]) if end in "”’»\"')]" else ""
    d = "dots" if dots else "bare"
    words = [_shape(w) for w in _WORDS.findall(ended[-200:])[-4:]]
    w1, w2, w3 = (words[::-1] + ["", "", ""])[:3]
    f = [
        "bias", f"broken={broken}", f"end={end}", f"end={end}{before}/{d}", f"form={form}", f"form={form}/{end}/{d}", f"dots={d}",
        f"lim={at_limit}", f"near={near}/{end}", f"tag={bool(tagged)}/{'<p>' in text[:5]}",
        f"open={body.count('“') > body.count('”')}", f"open={body.count('(') > body.count(')')}",
    ]
    if form == "prose":
        f += [f"{d}/w1={w1}", f"{d}/w2={w2} {w1}", f"{d}/w3={w3} {w2} {w1}"]
        if end in ("lower", "upper", "digit"):
            raw = re.search(r"[^\W\d_]*$", ended)[0]
            f += [f"w1={w1}", f"w2={w2} {w1}", f"w3={w3} {w2} {w1}", f"len={min(len(raw), 12)}", f"tail={raw[-3:].lower()}",
                  f"tail2={raw[-2:].lower()}/{raw[:1].isupper()}"]
            if not raw[:1].isupper():
                f += [f"known={raw in known}", f"known={raw in known}/{d}"]
            f += [f"k2={_shape(w2) if w2 else ''} ?{w1[:1] == 'A'}", f"cap={raw[:1].isupper()}/{len(raw)}"]
    return f


def looks_intact(text: str) -> bool:
    body = _CLOSE_TAGS.sub("", text.rstrip())
    lines = [x for x in body.split("\n") if x.strip()]
    if not lines or _DOTS.search(body):  # dots may stand for what was cut
        return False
    return bool(
        _STOPPED.search(body) or body.endswith(")") or _RULED.match(lines[-1]) or _SIGNED.match(lines[-1])
        or _LABELLED.match(lines[-1]) or (len(lines) > 1 and "." not in body)
    )


def place(text: str, chars: list[int], octets: list[int]) -> tuple[bool, int]:
    """(whether the text is as long as a limit, 0 at a limit, 1 up to `NEAR` below one, 2 elsewhere)."""
    gaps = [c - len(text) for c in chars]
    if octets:
        size = len(text.encode("utf-8", "surrogatepass"))
        gaps += [o - size for o in octets]
    at = 0 in gaps
    return at, 0 if at else 1 if any(0 < g <= NEAR for g in gaps) else 2


def examples(texts: list[str], known: frozenset[str], limits: list[int], seed: int = SEED) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature rows and labels made of intact texts: 1 = cut. `limits` are lengths in characters that sources have."""
    rng = np.random.default_rng(seed)
    rows, y = [], []

    def add(text: str, cut: int, limit: int | None = None) -> None:
        rows.append(hashed(features(text, *place(text, [] if limit is None else [limit], []), known), BITS))
        y.append(cut)

    def marked(p: str) -> str:
        mark = rng.random()
        return p.rstrip() + "…" if mark < 0.25 else p.rstrip() + "..." if mark < 0.4 else p + "\ufffd" if mark < 0.45 else p

    for t in texts:
        add(t, 0)
        ends = [m.end() for m in _BOUNDARY.finditer(t)]
        stop = re.match(r"(?s).*\.$", _CLOSE_TAGS.sub("", t.rstrip()))
        for e in [ends[i] for i in rng.permutation(len(ends))[:3]] + ([len(stop[0])] if stop else []):
            p = t[:e]
            add(p, 0)
            if p.endswith("."):
                add(p[:-1] + ("…" if rng.random() < 0.6 else "..."), 0)
        if "." not in t:
            continue
        tail = ends[-1] if ends else 0
        places = [*rng.integers(1, max(2, len(t) - 1), 3), *([int(rng.integers(tail + 1, len(t)))] if len(t) - tail > 3 else [])]
        for e in places:
            p = t[: int(e)]
            if len(p.strip()) >= 2 and not whole(p):
                add(marked(p), 1)
        mine = [c for c in limits if c < len(t)]
        for c in [mine[i] for i in rng.permutation(len(mine))[:3]]:
            p = t[: c - 1] + "…" if rng.random() < 0.2 else t[:c]
            p = p.rstrip() if rng.random() < 0.3 else p
            add(p, 0 if whole(p.rstrip("…")) else 1, c)
    return rows, np.array(y, dtype=np.float32)


def whole(p: str) -> bool:
    """Whether a prefix ends where a text may end: after a sentence, a mark that closes, or within what has no sentences."""
    last = p.rstrip().rsplit("\n", 1)[-1]
    return bool(_STOPPED.search(p) or p.rstrip().endswith((")", ">", "*", "—")) or _SIGNED.match(last) or _LABELLED.match(last) or re.match(r"^\s*\w[\w ]{0,30}:", last))


def limits_of(docs: DataFrame, text: str, source: str) -> DataFrame:
    """(__s, unit, limit): the lengths, in characters and bytes, where far more of a source's different texts end than around."""
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(source).alias("__s"), F.xxhash64(F.col(text)).alias("h"),
        F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), size(F.col(text)).alias("len")) for u, size in (("chars", F.length), ("bytes", F.octet_length))])).alias("v"),
    )
    hist = rows.groupBy("__s", "v.unit", "v.len").agg(F.approx_count_distinct("h", 0.05).alias("n"))
    per = Window.partitionBy("__s", "unit")
    around = per.orderBy("len").rangeBetween(-AROUND, AROUND)
    hist = hist.withColumns(
        {
            "usual": (F.sum("n").over(around) - F.col("n")) / (2 * AROUND),
            "mean": F.avg("n").over(per),
            "top": F.col("len") == F.max("len").over(per),
        }
    )
    last = F.col("top") & (F.col("n") >= 3) & (F.col("n") >= 5 * F.col("mean"))
    spike = (F.col("n") >= 8) & (F.col("n") >= 5 * F.col("usual")) & (F.col("n") >= 5 * F.col("mean"))
    return hist.where(last | spike).select("__s", "unit", F.col("len").alias("limit"))


def length_limits(docs: DataFrame, text: str, source: str) -> DataFrame:
    """(source, limit): the limits in characters."""
    return limits_of(docs, text, source).where("unit = 'chars'").select("__s", "limit")


def _shortly_above(n: Column):
    return lambda c: (c - n).between(1, NEAR)


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", sample: int = SAMPLE) -> DataFrame:
    """(key, source, p_cut) for every row of `docs`."""
    ensure_checkpoint_dir(docs.sparkSession)
    of = lambda u: F.sort_array(F.collect_list(F.when(F.col("unit") == u, F.col("limit"))))
    limits = limits_of(docs, text, source).groupBy("__s").agg(of("chars").alias("chars"), of("bytes").alias("octets")).checkpoint()
    none = F.array().cast("array<int>")
    rows = docs.select(F.col(key), F.col(text).alias("__t"), F.col(source).alias("__s")).join(broadcast_checked(limits), "__s", "left")
    sizes = [(F.coalesce("chars", none), F.length("__t")), (F.coalesce("octets", none), F.octet_length("__t"))]
    at = reduce(or_, [F.array_contains(ls, n) for ls, n in sizes])
    near = reduce(or_, [F.exists(ls, _shortly_above(n)) for ls, n in sizes])
    rows = rows.select(
        key, "__s", "__t", "chars", F.coalesce(at, F.lit(False)).alias("at"),
        F.when(at, 0).when(near, 1).otherwise(2).alias("near"),
    )
    # the sample: texts of smallest id hash; twice as many are read as are kept, for those that don't look intact
    pool = smallest_hashes(rows.where(~F.col("at") & F.col("__t").isNotNull()).select(key, "__t", "chars"), key, 2 * sample, docs.count()).collect()
    intact = [r["__t"] for r in pool if looks_intact(r["__t"])][:sample]
    seen = sorted({c for r in pool for c in r["chars"] or []})
    model, known = Logistic(BITS), vocabulary(intact)
    if intact:
        model.fit(*examples(intact, known, seen))
    shared = docs.sparkSession.sparkContext.broadcast((model, known))

    @F.pandas_udf("double")
    def score(t: pd.Series, at: pd.Series, near: pd.Series) -> pd.Series:
        m, words = shared.value
        known = [i for i, x in enumerate(t) if x is not None and x.strip()]
        out = np.zeros(len(t))
        if known and m.w.any():
            tv, av, nv = t.to_numpy(), at.to_numpy(), near.to_numpy()
            out[known] = m.proba([hashed(features(tv[i], bool(av[i]), int(nv[i]), words), m.bits) for i in known])
        return pd.Series(out)

    return spread(rows.drop("chars")).select(key, F.col("__s").alias(source), score("__t", "at", "near").alias("p_cut"))


def cut_rates(docs: DataFrame, threshold: float = 0.5, **names: str) -> DataFrame:
    """(source, texts, cut, share): how often each source truncates."""
    s = scored(docs, **names)
    source = s.columns[1]
    cut = (F.col("p_cut") >= threshold).cast("bigint")
    return s.groupBy(source).agg(F.count(F.lit(1)).alias("texts"), F.sum(cut).alias("cut"), F.avg(cut).alias("share"))
