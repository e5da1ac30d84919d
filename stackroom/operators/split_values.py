"""Several values packed in one field (problem 6): quoted spans become indexed placeholders, the rest is split.

Everything is built-in Spark SQL (regex, higher-order functions, posexplode): no Python worker, no shuffle. Only where more than
`MAX_LABELS` listed labels hold a delimiter they are no longer one pattern: the labels that stand in a record are then found by
a join, and each record is split by a pattern of its own labels. The values are the same.

How one element is taken apart:

1. spans that are one value whatever they hold (a quoted string, a listed label, an organisation's "of X & Y") are cut
   out; span i is replaced by START i END, two private-use characters. Such characters that the text itself holds are
   escaped first, so a placeholder can't collide with text;
2. what is left is split at the delimiters;
3. each piece that is a placeholder is looked up in the array of spans; quotes and escapes go, blanks are trimmed,
   blank pieces don't count.

Defined results: a NULL or empty array gives no rows; a NULL or blank element gives no rows; an element with one value
gives no rows from `packed_values` (keep_single=True keeps it); repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ESC = "\ue000", "\ue001", "\ue002"

BLANK_ENDS = r"^[\s\u00A0\u2009\u200B]+|[\s\u00A0\u2009\u200B]+$"
QUOTED = r'"(?:[^"\\]|\\.|"")*"'

# The words that join two names in the languages of the catalogue.
NAME_JOINERS = ["and", "with", "y", "et", "und", "e"]


def _escape(c: Column) -> Column:
    """Make the private-use characters of the text itself harmless: ESC c stands for c."""
    return F.regexp_replace(c, f"([{START}{END}{ESC}])", f"{ESC}$1")


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, f"{ESC}([{START}{END}{ESC}])", "$1")


def _hide(c: Column, span_pattern: Column) -> tuple[Column, Column]:
    """The text with span i as START i END, and the array of spans."""
    spans = F.regexp_extract_all(c, span_pattern, F.lit(0))
    pieces = F.split(c, span_pattern, -1)
    hidden = F.concat_ws(
        "",
        F.transform(
            pieces,
            lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(START), (i - 1).cast("string"), F.lit(END), p)),
        ),
    )
    return hidden, spans


def _bare(v: Column) -> Column:
    """A value without surrounding blanks, enclosing quotes and escapes."""
    v = F.regexp_replace(v, BLANK_ENDS, "")
    quoted = v.rlike(r'(?s)^".*"$') & (F.length(v) >= 2)
    inner = F.substring(v, F.lit(2), F.length(v) - 2)
    inner = F.regexp_replace(F.replace(inner, F.lit('""'), F.lit('"')), r"\\(.)", "$1")
    v = F.when(quoted, inner).otherwise(v)
    return F.regexp_replace(v, BLANK_ENDS, "")


def _restore(piece: Column, spans: Column) -> Column:
    """Put span i back for START i END; text around a placeholder stays."""
    at = F.regexp_extract_all(piece, F.lit(f"(?<!{ESC}){START}([0-9]+){END}"), F.lit(1))
    parts = F.split(piece, f"(?<!{ESC}){START}[0-9]+{END}", -1)
    return F.concat_ws(
        "",
        F.transform(
            parts,
            lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get(spans, F.get(at, i - 1).cast("int")), p)),
        ),
    )


def _values(c: Column, span_pattern: Column, delimiters: str) -> Column:
    c = _escape(c)
    c = F.regexp_replace(c, r'(?s)^\s*\[(\s*".*"\s*)\]\s*$', "$1")
    hidden, spans = _hide(c, span_pattern)
    values = F.transform(F.split(hidden, delimiters, -1), lambda p: _bare(_unescape(_restore(p, spans))))
    return F.filter(values, lambda v: v != "")


DELIMITERS = r"[;,|/•·\n\t]"
MAX_LABELS = 5000
_META = r"([\\.\[\]{}()*+\-?^$|/&#~])"


def split_subjects(c: Column, labels: list[str] | Column) -> Column:
    """The subjects in one element. `labels` stay whole in any case, as do quoted values: a list of them, or a column with an
    array of those that may stand in the row."""
    edge_l, edge_r = r'(?<![^;,|/•·\n\t\[\s])', r'(?=\s*(?:$|[;,|/•·\n\t\]]))'
    if isinstance(labels, Column):
        longest_first = F.array_sort(labels, lambda a, b: F.length(b) - F.length(a))
        listed = F.array_join(F.transform(longest_first, lambda x: F.regexp_replace(x, _META, r"\\$1")), "|")
        span = F.concat(F.lit(f"{edge_l}(?:{QUOTED}"), F.when(F.size(labels) > 0, F.concat(F.lit("|(?iu:"), listed, F.lit(")"))).otherwise(""), F.lit(f"){edge_r}"))
    else:
        holding = sorted((x for x in labels if x and re.search(DELIMITERS, x)), key=len, reverse=True)
        pattern = "|".join(re.sub(_META, r"\\\1", x) for x in holding)
        span = F.lit(f"{edge_l}(?:{QUOTED}" + (f"|(?iu:{pattern})" if pattern else "") + f"){edge_r}")
    return _values(c, span, DELIMITERS)


def labels_in(rows: DataFrame, key: str, elements: str, labels: DataFrame) -> DataFrame:
    """(key, labels): the labels (column `label`) with a delimiter that may stand in the elements of each row, by a join.

    What a label may be in a text is cut out between the places where a span may start and end, at most as long as the longest
    label; distinct elements only are looked at.
    """
    listed = labels.where(F.col("label").rlike(DELIMITERS)).select("label", F.lower("label").alias("form")).distinct()
    longest = listed.agg(F.max(F.length("label"))).first()[0] or 0

    @F.pandas_udf("array<string>")
    def stretches(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            starts = [0, *(m.end() for m in re.finditer(r"[;,|/•·\[\s]", t))]
            ends = [*(m.start() for m in re.finditer(r"\s*(?:[;,|/•·\n\t\]]|$)", t)), len(t)]
            out.append(sorted({t[a:b].lower() for a in starts for b in ends if a < b <= a + longest and re.search(DELIMITERS, t[a:b])}))
        return pd.Series(out, dtype=object)

    each = rows.select(key, F.explode(elements).alias("e")).where(F.col("e").rlike(DELIMITERS))
    found = each.select("e").distinct().select("e", F.explode(stretches("e")).alias("form")).join(listed, "form")
    found = found.groupBy("e").agg(F.collect_set("label").alias("ls"))
    return each.join(found, "e").groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set("ls"))).alias("labels"))


def split_names(c: Column) -> Column:
    """The names in one element. 'Surname, Given' and an organisation are one value each.

    A comma divides two names only where every side of it is a full name (two words or more); otherwise the comma is
    that of 'Surname, Given', and of an even row of such halves each pair is one name.
    """
    edge_l, edge_r = r'(?<![^;,|/&\n\t\[\s])', r'(?=\s*(?:$|[;,|/&\n\t\]]))'
    organisation = r"(?<=\b(?:of|for)\s)\p{Lu}[\p{L}’'-]+\s+(?:&|and)\s+\p{Lu}[\p{L}’'-]+"
    span = f"(?:{edge_l}{QUOTED}{edge_r}|{organisation})"
    joiners = "|".join(NAME_JOINERS)
    c = _escape(c)
    c = F.regexp_replace(c, r'(?s)^\s*\[(\s*".*"\s*)\]\s*$', "$1")
    hidden, spans = _hide(c, F.lit(span))
    strong = F.split(hidden, rf"\s*[;|\n\t]\s*|\s*,?\s*&\s*|\s+/\s+|\s*,?\s+(?:{joiners})\s+", -1)

    def commas(chunk: Column) -> Column:
        parts = F.filter(F.transform(F.split(chunk, ",", -1), lambda p: F.trim(p)), lambda p: p != "")
        n = F.size(parts)
        whole = F.array(chunk)
        full = F.forall(parts, lambda p: p.rlike(r"\S\s+\S") | p.rlike(f"^{START}[0-9]+{END}$"))
        # 'von Surname, Given': a lower-case particle leads the first half
        particle = F.get(parts, F.lit(0)).rlike(r"^(?:\p{Ll}+\s+)+\S+$") & (n == 2)
        # 'Institute of Things, Place': an organisation turned round
        turned = (n == 2) & F.get(parts, F.lit(0)).rlike(r"\b(?:of|for)\b") & ~F.get(parts, F.lit(1)).rlike(r"\S\s+\S")
        pairs = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")),
            lambda i: F.concat_ws(", ", F.get(parts, 2 * i), F.get(parts, 2 * i + 1)),
        )
        halves = (n % 2 == 0) & (n > 2) & F.exists(parts, lambda p: ~p.rlike(r"\S\s+\S"))
        return (
            F.when((n <= 1) | particle | turned, whole)
            .when(full, parts)
            .when(halves, pairs)
            .when(n == 2, whole)
            .otherwise(parts)
        )

    values = F.transform(F.flatten(F.transform(strong, commas)), lambda p: _bare(_unescape(_restore(p, spans))))
    return F.filter(values, lambda v: v != "")


def packed_values(
    df: DataFrame, key: str, fields: dict[str, tuple[Column, Callable[[Column], Column]]], keep_single: bool = False
) -> DataFrame:
    """Rows (key, field, elem, pos, val) for the elements of the array columns in `fields`.

    `fields` maps a field name to (array of strings, function from an element to its array of values). All fields are
    exploded in one pass over the input: narrow columns, one scan, no shuffle, so a hot key costs nothing extra.
    """

    def elements(name: str, arr: Column, fn) -> Column:
        return F.transform(
            F.coalesce(arr, F.array().cast("array<string>")),
            lambda e, i: F.struct(F.lit(name).alias("field"), i.alias("elem"), fn(e).alias("vals")),
        )

    per_field = [elements(name, arr, fn) for name, (arr, fn) in fields.items()]
    rows = df.select(F.col(key).alias(key), F.explode(F.concat(*per_field)).alias("__e"))
    rows = rows.where(F.col("__e.vals").isNotNull())
    if not keep_single:
        rows = rows.where(F.size("__e.vals") >= 2)
    return rows.select(
        key, F.col("__e.field").alias("field"), F.col("__e.elem").alias("elem"), F.posexplode("__e.vals").alias("pos", "val")
    )


def packed_epub_values(epub: DataFrame, labels: list[str] | DataFrame) -> DataFrame:
    """Problem 6 over package records: `subject` elements and the creators' `full_name`. `labels`, a list or a table of any
    length (column label), stay whole."""
    rows = epub.select("info_id", "subject", F.col("creator.full_name").alias("creator"))
    known: list[str] | Column = labels
    if isinstance(labels, DataFrame):
        whole = labels.where(F.col("label").rlike(DELIMITERS)).select("label").distinct()
        known = [r[0] for r in whole.limit(MAX_LABELS + 1).collect()]
        if len(known) > MAX_LABELS:
            rows = rows.join(labels_in(rows, "info_id", "subject", whole), "info_id", "left")
            known = F.coalesce("labels", F.array().cast("array<string>"))
    return packed_values(
        rows,
        "info_id",
        {
            "subject": (F.col("subject"), lambda c: split_subjects(c, known)),
            "creator": (F.col("creator"), split_names),
        },
    )
