"""Free-entered values mapped to a canonical list (problem 1).

Method: a BK-tree over the reference entries under a true edit metric (unrestricted Damerau-Levenshtein). A tree returns
every entry within the threshold, by triangle-inequality pruning.

* A list of at most `SHARD_SIZE` entries is broadcast as one tree. Values are mapped row by row inside an Arrow-batched
  function that looks each distinct value of a batch up once, so a value that holds a third of all rows costs one lookup a
  batch and nothing is shuffled.
* A longer list is never gathered: it is cut into shards of about `SHARD_SIZE` references by hash, the distinct values go to
  every shard in parts of about `PART_VALUES`, each (shard, part) is searched in a task of its own, and the shards' winners
  merge by their smallest (distance, first letter, kind, reference).

A value is looked up in several written forms, all folded to bare letters and digits: as it is; turned round at a comma
('History, maritime'); with '&' for 'and'; for languages also without 'language', 'in' and brackets. The
threshold of a form is one edit per three letters, two at most; forms under three letters must match exactly. Values no
tree entry is near are tried as abbreviations (each word a prefix ending in a dot, or the consonants, of one entry's
word, in order); only a unique reading counts. What stays is reported with an empty reference.

Defined results: NULL and blank values give no row; ties go to names of the same first letter, to the label before
other names, then to the smallest reference (the shorter one first, so numbers by value); repeated values give one row each; an empty list leaves every value unmatched;
list rows without a reference, and NULL labels or names in them, are passed over.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.llm.edit import BKTree
from stackroom.operators.joins import broadcast_checked
from stackroom.session import ensure_checkpoint_dir

MAX_EDITS = 2
LETTERS_PER_EDIT = 3
SHARD_SIZE = 20_000
PART_VALUES = 100_000

# Names of languages in other languages than their own and English, by code.
EXONYMS = {
    "en": "anglais englisch inglés inglese angielski английский",
    "es": "espagnol spanisch castellano castilian spagnolo espanhol hiszpański испанский",
    "fr": "französisch francés francese francês francuski французский",
    "de": "allemand alemán tedesco alemão niemiecki немецкий",
    "it": "italien italienisch włoski итальянский",
    "pt": "portugais portugiesisch portoghese portugués portugalski португальский",
    "pl": "polonais polnisch polaco polacco польский",
    "ru": "russe russisch ruso russo rosyjski",
    "nl": "néerlandais niederländisch holandés neerlandés olandese holandês flemish",
    "sv": "suédois schwedisch sueco svedese",
    "da": "danois dänisch danés danese dinamarquês",
    "fi": "finnois finnisch finés finlandés finlandese",
    "hu": "hongrois ungarisch húngaro ungherese",
    "cs": "tchèque tschechisch checo ceco",
    "el": "grec griechisch griego greco grego",
    "tr": "turc türkisch turco",
    "ca": "catalan katalanisch catalán catalano catalão",
    "eu": "basque baskisch vasco basco",
    "gl": "galicien galicisch gallego",
    "ro": "roumain rumänisch rumano rumeno romeno",
    "uk": "ukrainien ukrainisch ucraniano ucraino",
    "ja": "japonais japanisch japonés giapponese japonês nihongo",
    "is": "islandais isländisch islandés islandese",
    "ga": "irlandais irisch irlandés irlandese gaelic",
}


def fold(text: str) -> str:
    """Bare lower-case letters and digits: no accents, blanks, punctuation or invisible characters."""
    text = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if c.isalnum())


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w.’']+", text) if fold(w)]


class Canon:
    """One shard of a reference list: entries (ref, rank, name); rank 0 is the label itself."""

    def __init__(self, entries: list[tuple[str, int, str]], language: bool):
        self.language = language
        self.by_form: dict[str, tuple[int, int, str]] = {}
        self.codes: dict[str, str] = {}
        # entries by the first letters of their words, all an abbreviation keeps
        self.initials: dict[tuple[str, ...], list[tuple[str, list[str]]]] = {}
        for ref, rank, name in sorted(entries, key=lambda e: (e[1], len(e[0]), e[0])):
            if language and rank == 0:
                self.codes.setdefault(name.casefold(), ref)
                continue
            for form in {fold(name), fold(name.replace("&", " and "))} - {""}:
                self.by_form.setdefault(form, (rank, len(ref), ref))
            words = [fold(w) for w in words_of(name)]
            self.initials.setdefault(tuple(w[0] for w in words), []).append((ref, words))
        self.tree = BKTree(w for w in self.by_form if len(w) >= LETTERS_PER_EDIT)
        self.longest = max((len(w) for w in self.by_form), default=0)

    def forms(self, value: str) -> list[str]:
        v = value.strip()
        texts = [v]
        if self.language:
            bare = re.sub(r"\(.*?\)|\[.*?\]", " ", v)
            bare = re.sub(r"(?i)^\s*(?:in|written in)\s+|\s+language\b|\blanguage\s*:", " ", bare)
            texts.append(bare)
            inner = re.findall(r"[(\[]\s*(.*?)\s*[)\]]", v)
            texts.extend(inner)
        if "," in v:
            head, _, tail = v.partition(",")
            texts.append(f"{tail} {head}")
        texts.extend([t.replace("&", " and ") for t in texts if "&" in t])
        return [f for f in dict.fromkeys(fold(t) for t in texts) if f]

    def code(self, value: str) -> str | None:
        """A language code alone, or with a region or script after it."""
        m = re.fullmatch(r"([A-Za-z]{2,3})(?:[-_]([A-Za-z]{2}|[A-Za-z]{4}|\d{3}))*", value.strip().strip(";.,:/ "))
        return self.codes.get(m[1].casefold()) if m else None

    def near(self, values: list[str]) -> list[tuple[int, bool, int, int, str] | None]:
        """(distance, whether the first letters differ, rank, length of ref, ref) of each value's closest entry within the threshold; the tree sees all values at once."""
        out: list[tuple[int, bool, int, int, str] | None] = [None] * len(values)
        asked: dict[str, list[int]] = {}
        for i, value in enumerate(values):
            if self.language and (ref := self.code(value)):
                out[i] = (0, False, 0, len(ref), ref)
                continue
            forms = self.forms(value)
            exact = [(0, False, *self.by_form[f]) for f in forms if f in self.by_form]
            if exact:
                out[i] = min(exact)
                continue
            for f in forms:
                if LETTERS_PER_EDIT <= len(f) <= self.longest + MAX_EDITS:
                    asked.setdefault(f, []).append(i)
        for (f, at), hits in zip(asked.items(), self.tree.within_many(list(asked), MAX_EDITS), strict=True):
            for d, name in hits:
                if d * LETTERS_PER_EDIT <= max(len(f), len(name)):
                    got = (d, f[0] != name[0], *self.by_form[name])
                    for i in at:
                        out[i] = got if out[i] is None or got < out[i] else out[i]
        return out

    def abbreviated(self, value: str) -> set[str]:
        """The entries whose words the value's words shorten, in order."""
        ws = words_of(value)
        if not ws or not (any(w.endswith(".") for w in ws) or len(ws) > 1):
            return set()
        ws2 = [(fold(w), w.endswith(".")) for w in ws]
        alike = self.initials.get(tuple(w[0] for w, _ in ws2), [])
        return {ref for ref, names in alike if all(_shortens(w, dot, n) for (w, dot), n in zip(ws2, names, strict=True))}


def _shortens(w: str, dot: bool, name: str) -> bool:
    if w == name:
        return True
    if dot and name.startswith(w):
        return True
    bare = re.sub(r"[aeiou]", "", name)
    if len(w) >= 3 and w[0] == name[0] and not re.search(r"[aeiou]", w[1:]):
        it = iter(bare if name[0] not in "aeiou" else name[0] + bare)
        return all(c in it for c in w)
    return False


def shards_of(entries: list[tuple[str, int, str]], language: bool, shard_size: int) -> list[Canon]:
    refs = sorted({e[0] for e in entries}, key=lambda r: (len(r), r))
    cut = [set(refs[i : i + shard_size]) for i in range(0, len(refs), shard_size)] or [set()]
    return [Canon([e for e in entries if e[0] in part], language) for part in cut]


def lookup_many(shards: list[Canon], values: list[str]) -> list[str]:
    """The reference of each value, '' if none: the smallest of the shards' winners, else a unique abbreviation."""
    won = [min((x for x in xs if x), default=None) for xs in zip(*(s.near(values) for s in shards), strict=True)]
    out = []
    for value, best in zip(values, won, strict=True):
        if best:
            out.append(best[-1])
            continue
        short = set().union(*(s.abbreviated(value) for s in shards))
        out.append(short.pop() if len(short) == 1 else "")
    return out


def lookup(shards: list[Canon], value: str) -> str:
    return lookup_many(shards, [value])[0]


def subject_entries(rows) -> list[tuple[str, int, str]]:
    return [(str(r["subject_id"]), rank, n) for r in rows if r["subject_id"] is not None for rank, n in
            [(0, r["label"]), *((1, x) for x in (() if r["also"] is None else r["also"]))] if n]


def language_entries(rows) -> list[tuple[str, int, str]]:
    out = []
    for r in (r for r in rows if r["code"]):
        out += [(r["code"], 0, r["code"]), (r["code"], 0, r["code3"]), (r["code"], 1, r["name"]), (r["code"], 2, r["native_name"])]
        out += [(r["code"], 3, x) for x in EXONYMS.get(r["code"], "").split()]
    return [e for e in out if e[2]]


def entry_table(rows: DataFrame, language: bool) -> DataFrame:
    """(ref, rank, name) of a list of languages (code, code3, name, native_name) or subjects (subject_id, label, also)."""
    make, columns = (language_entries, ["code", "code3", "name", "native_name"]) if language else (subject_entries, ["subject_id", "label", "also"])

    def entries(batches):
        for pdf in batches:
            plain = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
            yield pd.DataFrame(make(plain), columns=["ref", "rank", "name"])

    ids = [F.col(columns[0]).cast("string").alias(columns[0]), *columns[1:]]
    return rows.select(*ids).mapInPandas(entries, "ref string, rank int, name string")


def searched_in_shards(values: DataFrame, entries: DataFrame, language: bool) -> DataFrame:
    """(value, ref) of the distinct values of a column `value`, against a list of any length, shard by shard."""
    ensure_checkpoint_dir(values.sparkSession)
    known = values.select("value").distinct().checkpoint()
    entries = entries.checkpoint()
    shards = max(1, -(-entries.select("ref").distinct().count() // SHARD_SIZE))
    parts = max(1, -(-known.count() // PART_VALUES))
    left = known.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(parts))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = entries.withColumn("shard", F.pmod(F.xxhash64("ref"), F.lit(shards)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        shard = Canon(list(zip(held["ref"], held["rank"].tolist(), held["name"], strict=True)), language)
        known = asked["value"].tolist()
        rows = []
        for value, best in zip(known, shard.near(known), strict=True):
            short = sorted(shard.abbreviated(value)) if best is None else []
            if best or short:
                rows.append((value, *(best or (None,) * 5), *([short[0], short[-1]] if short else [None, None])))
        kinds = {"d": "Int32", "other": "boolean", "rank": "Int32", "size": "Int32"}
        return pd.DataFrame(rows, columns=["value", *kinds, "ref", "lo", "hi"]).astype(kinds)

    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(
        search, "value string, d int, other boolean, rank int, size int, ref string, lo string, hi string"
    )
    won = found.groupBy("value").agg(
        F.min(F.when(F.col("ref").isNotNull(), F.struct("d", "other", "rank", "size", "ref"))).alias("best"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    return won.select("value", F.coalesce("best.ref", F.when(F.col("lo") == F.col("hi"), F.col("lo")), F.lit("")).alias("ref"))


def with_reference(rows: DataFrame, value: str, listed: DataFrame, language: bool, ref: str = "ref") -> DataFrame:
    """`rows` with a column `ref`: the list's entry that the column `value` means, '' if none, NULL for NULL."""
    entries = entry_table(listed, language)
    few = entries.limit(SHARD_SIZE + 1).collect()
    if len(few) > SHARD_SIZE:
        got = searched_in_shards(rows.select(F.col(value).alias("value")).where(F.col(value).isNotNull()), entries, language)
        got = got.select(F.col("value").alias(value), F.col("ref").alias(ref))
        return rows.join(got, value, "left").withColumn(ref, F.when(F.col(value).isNotNull(), F.coalesce(ref, F.lit(""))))
    shared = rows.sparkSession.sparkContext.broadcast(Canon([tuple(e) for e in few], language))

    @F.pandas_udf("string")
    def find(v: pd.Series) -> pd.Series:
        known = v.dropna().unique().tolist()
        got = dict(zip(known, lookup_many([shared.value], known), strict=True))
        return pd.Series([got.get(x) for x in v], dtype=object)  # never a column of NaN

    return rows.withColumn(ref, find.asNondeterministic()(F.col(value)))  # else a filter on the result runs it twice


def map_catalogue(meta: DataFrame, subjects: DataFrame, languages: DataFrame) -> DataFrame:
    """(file_id, field, pos, value, ref) for each value of `subjects` and `language` that isn't literally a label or a code."""
    blank = r"^[\s\u00A0\u2000-\u200B\u3000]*$"

    def entered(rows: DataFrame, listed: DataFrame, exact: str, language: bool) -> DataFrame:
        asked = rows.where(F.col("value").isNotNull() & ~F.col("value").rlike(blank))
        known = listed.select(F.col(exact).alias("value")).where(F.col(exact).isNotNull()).distinct()
        return with_reference(asked.join(broadcast_checked(known), "value", "left_anti"), "value", listed, language)

    s = meta.select("file_id", F.posexplode("subjects").alias("pos", "value")).select("file_id", F.lit("subjects").alias("field"), "pos", "value")
    g = meta.select("file_id", F.lit("language").alias("field"), F.lit(0).alias("pos"), F.col("language").alias("value"))
    order = ["file_id", "field", "pos", "value", "ref"]
    return entered(s, subjects, "label", False).select(*order).unionByName(entered(g, languages, "code", True).select(*order))
