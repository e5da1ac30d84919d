"""Rows that differ only in formatting (problem 2): one row per work with its number of copies.

Method: every field-name/value pair is normalised and hashed, the hashes of a row are combined by addition (a
commutative multiset hash, so authors in any order give the same sum, without sorting), rows are grouped by the sums, and
the equality of the fields is verified against the group's representative by counting, again without sorting.

* Normal form: upper case of the composed form (NFC), letters, digits and their marks only. Composition is the one thing
  the JVM functions lack; only the values that hold marks or other decomposable characters reach the Arrow-batched
  function, the rest never leave the JVM.
* Fingerprint: two 64-bit hashes with different seeds per pair, summed exactly as decimals: no wrap-around, no order. The
  normal forms and sums are made once and written to the shared checkpoint folder.
* Skew: the sums are counted with partial aggregation before the shuffle. The rows of a group of more than a thousandth of all
  rows are dealt out over several tasks by the hash of their key, and the group's representative is sent to each of these;
  only the sums and sizes of such groups (a thousand at most, whatever the data) are broadcast, no fields.
* Verification: title keys must be equal and every author key must occur equally often on both sides. Rows that fail it
  (a collision of both hashes) are grouped again by their fields themselves, so none is lost.

Defined results: rows without a title (NULL, blank or without letters and digits) are no copies; NULL, empty and blank
authors count as none; repeated rows are copies; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.session import ensure_checkpoint_dir

HOT_SHARE = 1000

# Characters that composition can change: marks, conjoining jamo and the letters with a canonical singleton.
COMPOSABLE = r"[\p{M}\x{1100}-\x{11FF}\x{212A}\x{212B}\x{2126}\x{F900}-\x{FAFF}]"
# Marks that show nothing of their own: variation selectors and the grapheme joiner.
INVISIBLE_MARKS = r"[\x{FE00}-\x{FE0F}\x{034F}\x{180B}-\x{180D}]"


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize("NFC", x) for x in s], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _compose_all(s: pd.Series) -> pd.Series:
    nfc = lambda x: None if x is None else unicodedata.normalize("NFC", x)
    return pd.Series([None if xs is None else [nfc(x) for x in xs] for xs in s], dtype=object)


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}]+", "")


def _cased(c: Column) -> Column:
    """Upper case without invisible characters: soft hyphens and joiners inside a letter sequence must not hide a mark."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, INVISIBLE_MARKS, ""), r"\p{Cf}", ""))


def keyed(df: DataFrame, key: str, text: str, names: str) -> DataFrame:
    """(key, t, a): the normal forms of the text and of each name that isn't blank."""
    rows = df.select(
        F.col(key).alias(key),
        _cased(F.col(text)).alias("t"),
        F.transform(F.coalesce(F.col(names), F.array().cast("array<string>")), _cased).alias("a"),
    )
    # 'not deterministic' keeps the filter on their results from running the functions a second time
    marked = F.exists("a", lambda x: x.rlike(COMPOSABLE))
    rows = rows.select(
        key,
        F.coalesce(_compose.asNondeterministic()(F.when(F.col("t").rlike(COMPOSABLE), F.col("t"))), F.col("t")).alias("t"),
        F.coalesce(_compose_all.asNondeterministic()(F.when(marked, F.col("a"))), F.col("a")).alias("a"),
    )
    rows = rows.select(key, _bare(F.col("t")).alias("t"), F.filter(F.transform("a", _bare), lambda x: x != "").alias("a"))
    return rows.where(F.col("t") != "")


def fingerprinted(rows: DataFrame) -> DataFrame:
    """Adds f1 and f2: the sums of the hashes of all (field, value) pairs under two seeds."""

    def total(seed: str) -> Column:
        wide = lambda c: c.cast("decimal(38,0)")
        authors = F.aggregate(
            "a", wide(F.lit(0)), lambda s, x: wide(s + wide(F.xxhash64(F.lit(seed), F.lit("authors"), x)))
        )
        return wide(authors + wide(F.xxhash64(F.lit(seed), F.lit("title"), F.col("t"))))

    return rows.withColumns({"f1": total("first"), "f2": total("second")})


def _same_names(a: Column, b: Column) -> Column:
    """Equal as multisets, by counting."""
    often = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return (F.size(a) == F.size(b)) & F.forall(a, lambda x: often(a, x) == often(b, x))


def _checked(df: DataFrame, key: str, text: str, names: str) -> tuple[DataFrame, DataFrame]:
    """(f1, f2, n, first_id) of each sum, and (f1, f2, key, first_id, same, t, a) of the rows whose sum several rows have.

    `same` says whether a row's fields equal those of the row of the sum's smallest key; t and a are kept only where not.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = fingerprinted(keyed(df, key, text, names)).checkpoint()
    groups = rows.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).checkpoint()
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot_rows = max(1000, total // HOT_SHARE)
    # more than a thousandth of all rows each: a thousand groups at most, of three numbers each
    hot = F.broadcast(groups.where(F.col("n") > hot_rows).select("f1", "f2", F.ceil(F.col("n") / hot_rows).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))

    def in_parts(per_group: DataFrame) -> DataFrame:
        return per_group.join(hot, ["f1", "f2"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")

    dealt = rows.join(hot, ["f1", "f2"], "left").withColumn("part", F.pmod(F.xxhash64(key), parts).cast("int")).drop("parts")
    several = in_parts(groups.where("n > 1").drop("n"))
    members = dealt.join(several, ["f1", "f2", "part"])
    # one row a group, whose key may be repeated
    first = members.where(F.col(key) == F.col("first_id")).groupBy("f1", "f2").agg(F.min(F.struct("t", "a")).alias("first"))
    both = members.join(in_parts(first), ["f1", "f2", "part"])
    same = (F.col("t") == F.col("first.t")) & _same_names(F.col("a"), F.col("first.a"))
    # read twice: what agrees keeps its keys only
    own = [F.when(~same, F.col("t")).alias("t"), F.when(~same, F.array_sort("a")).alias("a")]
    return groups, both.select("f1", "f2", key, "first_id", same.alias("same"), *own).checkpoint()


def copies(df: DataFrame, key: str = "file_id", text: str = "title", names: str = "authors") -> DataFrame:
    """(first_id, key): every copy but the one with the smallest key, which is first_id."""
    _, checked = _checked(df, key, text, names)
    good = checked.where(F.col("same") & (F.col(key) != F.col("first_id"))).select("first_id", key)
    # collisions of both hashes: grouped by the fields themselves
    odd = checked.where(~F.col("same")).select(key, "t", "a")
    again = odd.groupBy("t", "a").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rest = odd.join(again, ["t", "a"]).where(F.col(key) != F.col("first_id")).select("first_id", key)
    return good.unionByName(rest)


def works(df: DataFrame, key: str = "file_id", text: str = "title", names: str = "authors") -> DataFrame:
    """(first_id, copies): one row per work with a title; `copies` counts its rows, verified as in copies()."""
    groups, checked = _checked(df, key, text, names)
    often = F.count(F.lit(1)).alias("copies")
    good = checked.where("same").groupBy("f1", "f2").agg(F.min("first_id").alias("first_id"), often).select("first_id", "copies")
    # collisions of both hashes: grouped by the fields themselves
    odd = checked.where(~F.col("same")).groupBy("t", "a").agg(F.min(key).alias("first_id"), often).select("first_id", "copies")
    return groups.where("n = 1").select("first_id", F.col("n").alias("copies")).unionByName(good).unionByName(odd)
