"""Text decoded with the wrong encoding: found and restored span by span (problem 3).

Method: the garbled sequences of the encodings and characters listed below are precomputed and matched by multi-pattern automata (Aho-Corasick);
only matched spans are replaced, so correct text in the same field stays as it is.

Three kinds of sequences:

* characters: every character of the repertoire written in UTF-8 and read in each single-byte encoding, once or twice;
* words: text of one single-byte encoding read in another garbles letters to letters, so single characters prove nothing.
  All of the corpus's own words with accented or non-Latin letters are garbled by every pair, as a table, and joined with
  what stands in the texts; a form is a pattern if the clean word is at least `RATIO` times as frequent (words seen fewer
  than `SEEN` times: if its letter pairs are more usual);
* mixed scripts: a Latin letter next to what an accented Latin letter becomes when read as Cyrillic or Greek, or in an
  encoding of two bytes a character;
* ideographs, kana and Hangul in UTF-8 read in a Western encoding, two of them side by side.

A replacement character is found but can't be restored. Numeric character references are read before matching.

Defined results: NULL and empty fields hold nothing; repeated rows are found each; a field whose garbled part was cut within
a sequence is found by its other sequences; very long texts are matched in one pass, linear in their length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from html import unescape
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.session import ensure_checkpoint_dir, spread

RATIO = 3
SEEN = 3
MARGIN = 0.5

# The encodings text is read in by mistake, and those it was written in, by script.
READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "iso8859-7", "koi8-r", "cp437", "cp850", "cp866", "mac-roman", "iso8859-5", "cp1257"]
READ_WIDE = ["gbk", "big5", "shift_jis", "euc_kr"]
WRITTEN = {
    "latin": ["cp1252", "cp1250", "iso8859-2", "mac-roman", "cp850", "cp437"],
    "cyrillic": ["cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic"],
    "greek": ["cp1253", "iso8859-7"],
}
# The characters whose UTF-8 form is looked for, as ranges of code points.
REPERTOIRE = [
    (0xA0, 0x17F), (0x192, 0x192), (0x218, 0x21B), (0x2C6, 0x2C7), (0x2D8, 0x2DD), (0x386, 0x3CE), (0x401, 0x45F), (0x490, 0x491), (0x1E00, 0x1EFF), (0x2010, 0x2015), (0x2018, 0x2022), (0x2026, 0x2026),
    (0x2030, 0x2030), (0x2039, 0x203A), (0x20AC, 0x20AC), (0x2116, 0x2116), (0x2122, 0x2122), (0x2190, 0x2193),
    (0x2600, 0x266F), (0x1F300, 0x1F64F), (0x3041, 0x30FE), (0xFB01, 0xFB02), (0xFEFF, 0xFEFF),
]
IDEOGRAPHS = [(0x3001, 0x3002), (0x3041, 0x30FE), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E)]

_C1 = {b: chr(b) for b in range(256)}
_MARKS = "«»¿¡“”’‘‚„–—…\u00a0\u00ad\u200b\u2009"
_CLOSERS = "»”’›…  \"'"


def misread(data: bytes, encoding: str) -> str:
    """Bytes read in an encoding; bytes it doesn't define become the control characters of their number."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        out = []
        for b in data:
            try:
                out.append(bytes([b]).decode(encoding))
            except UnicodeDecodeError:
                out.append(_C1[b])
        return "".join(out)


def _script(word: str) -> str | None:
    kinds = {"cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin" for c in word if c.isalpha()}
    return kinds.pop() if len(kinds) == 1 else None


def character_patterns() -> dict[str, str]:
    """Garbled sequence -> character, for UTF-8 read in a single-byte encoding once or twice."""
    out: dict[str, str] = {}
    for lo, hi in REPERTOIRE:
        for cp in range(lo, hi + 1):
            c = chr(cp)
            if unicodedata.category(c) == "Cn":
                continue
            for enc in READ_AS:
                g = misread(c.encode(), enc)
                if any(x < "\u0080" for x in g) or (g.isalpha() and g.islower()) or not set(g) - set(_MARKS):
                    continue
                if ("\u00a0" in g or "\u00ad" in g) and any("\u0370" <= x <= "\u04ff" for x in g):
                    continue
                out.setdefault(g, c)
                if enc in ("cp1252", "latin-1"):
                    for again in ("cp1252", "latin-1"):
                        out.setdefault(misread(g.encode(), again), c)
    return out


def ideograph_patterns() -> dict[str, str]:
    """Garbled sequence -> character, for ideographs, kana and Hangul in UTF-8 read in the Western encodings."""
    out: dict[str, str] = {}
    for lo, hi in IDEOGRAPHS:
        for c in map(chr, range(lo, hi + 1)):
            for enc in ("cp1252", "latin-1"):
                out.setdefault(misread(c.encode(), enc), c)
    return out


def wide_patterns() -> dict[str, str]:
    """Garbled sequence -> text, for Latin letters and marks in UTF-8 read in a double-byte encoding; a mark of three bytes
    takes the letter behind it along."""
    letters = [chr(cp) for cp in range(0xC0, 0x180) if chr(cp).isalpha()]
    marks = [m + a for m in "‘’“”–—…" for a in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    out: dict[str, str] = {}
    for enc in READ_WIDE:
        for c in letters + marks:
            try:
                g = c.encode().decode(enc)
            except UnicodeDecodeError:
                continue
            if not any(_wide(x) for x in g):
                continue
            out.setdefault(g, c)
    return out


def _wide(c: str) -> bool:
    return c >= "\u2e80" and c.isalpha()


def word_patterns(lexicon: dict[str, int]) -> dict[str, str]:
    """Garbled word -> word, for the words of a single-byte encoding read in another."""
    out: dict[str, str] = {}
    ranked = sorted(lexicon.items(), key=lambda x: (-x[1], x[0]))

    def often(g: str) -> int:
        """How often the least frequent of the garbled form's own words stands in the corpus; plain words are frequent."""
        bare = g.strip(_MARKS)
        if bare.isascii():
            return 1 << 60
        return min(max(lexicon.get(f, 0) for f in (w, w.lower(), w.swapcase(), w.capitalize())) for w in re.findall(r"[^\W\d_]+", bare) or [""])

    for word, n in ranked:
        if len(word) < 2 or (script := _script(word)) is None or re.search(r"[^\W\d_]", word[1:]) and not (word[1:].islower() or word.isupper()):
            continue  # capitals inside a word are no clean word
        for form in dict.fromkeys((word, word.upper(), word.capitalize(), word.swapcase())):
            for written in WRITTEN[script]:
                try:
                    data = form.encode(written)
                except UnicodeEncodeError:
                    continue
                for read in READ_AS:
                    if read == written:
                        continue
                    g = misread(data, read)
                    if g == form or g.isascii() or g in out or g.casefold() == word.casefold() or often(g) * RATIO > n:
                        continue
                    out[g] = form
    return out


def mixed_patterns() -> dict[str, str]:
    """Pairs of a plain Latin letter and a Cyrillic or Greek one that an accented Latin letter is misread as."""
    out: dict[str, str] = {}
    plain = "abcdefghijklmnopqrstuvwxyz"
    plain += plain.upper()
    for read in ("cp1251", "cp1253", "iso8859-7", "koi8-r", "cp866", "iso8859-5"):
        for b in range(0xC0, 0x100):
            c = bytes([b]).decode("cp1252")
            g = misread(bytes([b]), read)
            if c.isalpha() and g.isalpha() and _script(g) in ("cyrillic", "greek"):
                for a in plain:
                    out.setdefault(a + g, a + c)
                    out.setdefault(g + a, c + a)
    return out


_REFERENCE = re.compile(r"&(?:#x?[0-9A-Fa-f]+|[A-Za-z]{3,8});")


def references(text: str) -> tuple[str, list[int] | None]:
    """The text with its references to characters beyond ASCII read, and where each of its characters (and its end) starts
    in the text as written; None if that is the same place."""
    if "&" not in text:
        return text, None
    parts, places, at = [], [], 0
    for m in _REFERENCE.finditer(text):
        u = unescape(m[0])
        if u.isascii():
            continue
        parts += [text[at : m.start()], u]
        places += [*range(at, m.start()), *[m.start()] * len(u)]
        at = m.end()
    if not parts:
        return text, None
    return "".join(parts) + text[at:], [*places, *range(at, len(text) + 1)]


def replaced(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    parts, at = [], 0
    for a, b, c, _ in spans:
        parts += [text[at:a], c]
        at = b
    return "".join(parts) + text[at:]


def moved(places: list[int], spans: list[tuple[int, int, str, bool]]) -> list[int]:
    """Where each character of the replaced text starts, given where each of the text before did."""
    out, at = [], 0
    for a, b, c, _ in spans:
        out += [*places[at:a], *[places[a]] * len(c)]
        at = b
    return out + places[at:]


# What a text must have for any sequence of a kind to stand in it; most texts are spared the automaton.
_PAIR = re.compile(r"[^\x00-\x7f]{2}")
_LEAD = re.compile(r"[\u00e3-\u00ed\u00ef][^\x00-\x7f]{2}[\u00e3-\u00ed\u00ef]")
_EAST = re.compile(r"[\u2e80-\uffff]")
_MIXED = re.compile(r"[A-Za-z][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z]")


class Garbled:
    """The automata and what they replace."""

    def __init__(self, lexicon: dict[str, int] | None = None, patterns: dict[str, str] | None = None):
        import ahocorasick

        def automaton(patterns: dict[str, str]):
            a = ahocorasick.Automaton()
            for g, c in patterns.items():
                a.add_word(g, (len(g), c))
            if len(patterns):
                a.make_automaton()
            return a

        self.characters = automaton(character_patterns())
        self.words = automaton(word_patterns(lexicon or {}) if patterns is None else patterns)
        self.mixed = automaton(mixed_patterns())
        self.ideographs = automaton(ideograph_patterns())
        self.wide = automaton(wide_patterns())

    def spans(self, text: str) -> list[tuple[int, int, str, bool]]:
        """(start, end, replacement, strong), leftmost longest, not overlapping."""
        found: list[tuple[int, int, str, bool]] = []
        taken = bytearray(len(text))
        first = []
        for end, (n, c) in self.characters.iter(text) if _PAIR.search(text) else ():
            a, b = end - n + 1, end + 1
            if n == 2 and text[end] in _CLOSERS and a and text[a - 1].isupper():
                continue  # an upper-case word before a closing mark
            g = text[a:b]
            if g.isalpha() and (script := _script(g)) in ("cyrillic", "greek"):
                # letters of one script may be part of a word of it: only next to Latin letters or as a mark of their own
                sides = [_script(x) if x.isalpha() else "" for x in (text[a - 1 : a], text[b : b + 1])]
                if "latin" not in sides and (script in sides or n < 3 or g.islower() or g.isupper() or g.istitle()):
                    continue
            first.append((a, b, c, True))
        # two marks behind one letter may be right text: an ideograph counts beside another
        rows = [(end - n + 1, end + 1, c, True) for end, (n, c) in (self.ideographs.iter(text) if _LEAD.search(text) else ())]
        starts, ends = {r[0] for r in rows}, {r[1] for r in rows}
        first += [r for r in rows if r[0] in ends or r[1] in starts]
        for end, (n, c) in self.wide.iter(text) if _EAST.search(text) else ():
            a, b = end - n + 1, end + 1
            sides = [text[a - 1 : a], text[b : b + 1]]
            # a character of East Asia inside a word of Latin letters
            if not any(x and _wide(x) for x in sides) and any(x.isalpha() and x < "\u0250" for x in sides):
                first.append((a, b, c, True))
        first.sort(key=lambda s: (s[0], -s[1]))
        last = 0
        for s in first:
            if s[0] >= last:
                found.append(s)
                last = s[1]
                taken[s[0] : s[1]] = b"\1" * (s[1] - s[0])
        if len(self.words):
            for end, (n, w) in self.words.iter(text):
                a, b = end - n + 1, end + 1
                if (a and text[a - 1].isalpha()) or (b < len(text) and text[b].isalpha()) or any(taken[a:b]):
                    continue
                strong = n >= 4 or not text[a:b].isalpha() or (_script(text[a:b]) is None)
                found.append((a, b, w, strong))
        for end, (n, c) in self.mixed.iter(text) if _MIXED.search(text) else ():
            if not any(taken[end - n + 1 : end + 1]):
                found.append((end - n + 1, end + 1, c, True))
        found.sort(key=lambda s: (s[0], -s[1]))
        out, last = [], 0
        for s in found:
            if s[0] >= last:
                out.append(s)
                last = s[1]
        return out

    def restored(self, text: str) -> tuple[bool, str, list[int] | None]:
        """Whether the text holds garbled spans, the text with only these replaced, and where its characters stood before
        (None: at the same places). What was garbled more than once is restored until nothing garbled is left."""
        if text.isascii() and "&" not in text:
            return False, text, None
        hit, places, fixed, met = "\ufffd" in text, None, text, {text}
        while True:
            read, back = references(fixed)
            hit |= "\ufffd" in read
            spans = self.spans(read)
            if not sum(s[3] for s in spans) and len(spans) < 2:
                return hit, fixed, places
            if back:
                spans = [(back[a], back[b], c, strong) for a, b, c, strong in spans]
            new = replaced(fixed, spans)
            hit = True
            if new in met:  # two words that are each other's garbled form
                return hit, fixed, places
            places = moved(list(range(len(fixed) + 1)) if places is None else places, spans)
            fixed = new
            met.add(new)

    def check(self, text: str) -> tuple[bool, str]:
        """Whether the text holds garbled spans, and the text with them restored."""
        return self.restored(text)[:2]


_RUN = re.compile(r"[^\W\d_]+")


def anchors(text: str) -> set[str]:
    """What a garbled word can be joined by: non-ASCII runs of letters, runs with a mark beside them, pairs of marks."""
    out, at = set(), 0
    for m in [*_RUN.finditer(text), None]:
        a = m.start() if m else len(text)
        out.update(text[i : i + 2] for i in range(at, a - 1) if not text[i : i + 2].isascii())
        if m:
            if not m[0].isascii():
                out.add(m[0])
            if a and text[a - 1] > "\x7f":
                out.add(text[a - 1] + m[0])
            if m.end() < len(text) and text[m.end()] > "\x7f":
                out.add(m[0] + text[m.end()])
            at = m.end()
    return out


def anchor(g: str) -> str:
    """The longest of a garbled word's anchors that stands in every text the word stands in, bounded by other letters."""
    runs = _RUN.findall(g)
    whole = [r for r in runs if not r.isascii()]
    return max(whole or anchors(g), key=lambda x: (len(x), x))


def _clean(word: str) -> bool:
    """Whether a word may be what was garbled: letters of one script, without capitals inside."""
    return len(word) >= 2 and _script(word) is not None and not (re.search(r"[^\W\d_]", word[1:]) and not (word[1:].islower() or word.isupper()))


def garbled_forms(word: str) -> dict[str, str]:
    """Garbled form -> form, of one clean word under every pair of single-byte encodings."""
    out: dict[str, str] = {}
    if not _clean(word):
        return out
    for form in dict.fromkeys((word, word.upper(), word.capitalize(), word.swapcase())):
        for written in WRITTEN[_script(word)]:
            try:
                data = form.encode(written)
            except UnicodeEncodeError:
                continue
            for read in READ_AS:
                g = misread(data, read)
                if read != written and g != form and not g.strip(_MARKS).isascii() and g.casefold() != word.casefold():
                    out.setdefault(g, form)
    return out


def patterns_of(df: DataFrame, fields: list[str]) -> dict[str, str]:
    """Garbled word -> word, of all words of the table whose garbled form stands in it.

    Every distinct word with a letter beyond ASCII is garbled, distributed, and joined with what stands in the texts; only
    the forms that do stand there are collected. A form is a pattern if the word is `RATIO` times as frequent as it; words
    seen fewer than `SEEN` times can't be told apart by frequency: their letter pairs must be more usual than the form's.
    """
    cores = max(2, df.sparkSession.sparkContext.defaultParallelism)
    ensure_checkpoint_dir(df.sparkSession)
    words = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(F.col(f), F.lit("")), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)) for f in fields]))
    counts = (
        df.select(F.explode(F.filter(words, lambda w: w.rlike(r"[^\x00-\x7F]"))).alias("w"))
        .groupBy("w").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    )

    def forms(batches):
        for pdf in batches:
            rows = [(w, n, i, g, c, anchor(g)) for w, n in zip(pdf["w"], pdf["n"], strict=True) for i, (g, c) in enumerate(garbled_forms(w).items())]
            yield pd.DataFrame(rows, columns=["w", "n", "i", "g", "form", "anchor"])

    def standing(batches):
        plain = Garbled({})
        seen: set[str] = set()
        for pdf in batches:
            new: set[str] = set()
            for text in pdf["text"]:
                text, met = references(text)[0], set()
                while text not in met:  # as restored by characters, too
                    met.add(text)
                    new |= anchors(text)
                    text = replaced(text, plain.spans(text))
            yield pd.DataFrame({"anchor": sorted(new - seen)}, dtype=object)
            seen = new | seen if len(seen) < 1_000_000 else new

    there = _texts(df, fields).mapInPandas(standing, "anchor string").distinct()
    made = counts.repartition(2 * cores, "w").mapInPandas(forms, "w string, n long, i int, g string, form string, anchor string")
    met = made.join(there, "anchor").drop("anchor").checkpoint()

    # how often the least frequent of a form's own words stands in the table, in the case it is most frequent in
    bare = F.udf(lambda g: [[r, v] for r in _RUN.findall(g.strip(_MARKS)) for v in {r, r.lower(), r.swapcase(), r.capitalize()}], "array<array<string>>")
    own = met.select("g").distinct().select("g", F.explode_outer(bare("g")).alias("v")).select("g", F.col("v")[0].alias("run"), F.col("v")[1].alias("w"))
    own = own.join(counts, "w", "left").groupBy("g", "run").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).groupBy("g").agg(F.min("n").alias("often"))
    frequent = F.when(F.col("often") >= SEEN, F.col("often")).otherwise(0)
    met = met.join(own, "g").where((F.col("n") >= RATIO * frequent) & ((F.col("n") >= SEEN) | (F.col("often") < SEEN)))
    best = met.groupBy("g").agg(F.min_by(F.struct("form", "w", "n", "often"), F.struct(-F.col("n"), "w", "i")).alias("b")).select("g", "b.*").collect()
    if all(r["n"] >= SEEN for r in best):
        return {r["g"]: r["form"] for r in best}

    # pairs of letters: as many as the scripts' letters have, whatever the table's size
    low = F.concat(F.lit("^"), F.lower("w"), F.lit("$"))
    pairs = counts.where(F.col("w").rlike(r"^[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]+$")).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)))).alias("p"), "n"
    )
    usual = {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    firsts: dict[str, int] = {}
    for p, n in usual.items():
        firsts[p[0]] = firsts.get(p[0], 0) + n

    def usualness(word: str, n: int) -> float:
        """Mean log share of its letter pairs in all other words."""
        x = f"^{word.lower()}$"
        return sum(math.log((max(0, usual.get(x[i : i + 2], 0) - n) + 0.1) / (max(0, firsts.get(x[i], 0) - n) + 10)) for i in range(len(x) - 1)) / (len(x) - 1)

    return {r["g"]: r["form"] for r in best if r["n"] >= SEEN or not r["often"] or not _clean(r["g"]) or usualness(r["w"], r["n"]) > usualness(r["g"], r["often"]) + MARGIN}


def _texts(df: DataFrame, fields: list[str], *keep: str) -> DataFrame:
    """(keep, field, text) of all that can be garbled: plain ASCII without references can't, it never goes to Python."""
    rows = spread(df.select(*keep, *fields))
    rows = rows.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("v"))
    return rows.select(*keep, "v.field", "v.text").where(F.col("text").rlike(r"[^\x00-\x7F]|&(#|[A-Za-z])"))


_built: dict[str, Garbled] = {}


def built(token: str, patterns: dict[str, str]) -> Garbled:
    """The automata of a table, made once a worker process; `token` names its word patterns."""
    if token not in _built:
        _built.clear()
        _built[token] = Garbled(patterns=patterns)
    return _built[token]


def garbled_fields(df: DataFrame, key: str = "file_id", fields: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """(key, field, text, restored) for each field value that holds garbled text."""
    shared, token = df.sparkSession.sparkContext.broadcast(patterns_of(df, list(fields))), uuid4().hex

    @F.pandas_udf(T.StructType([T.StructField("hit", T.BooleanType()), T.StructField("restored", T.StringType())]))
    def check(texts: pd.Series) -> pd.DataFrame:
        g = built(token, shared.value)
        got = [(False, None) if t is None else g.check(t) for t in texts]
        return pd.DataFrame({"hit": [h for h, _ in got], "restored": pd.Series([r for _, r in got], dtype=object)})

    rows = _texts(df, list(fields), key).withColumn("c", check("text"))
    return rows.where("c.hit").select(key, "field", "text", F.col("c.restored").alias("restored"))
