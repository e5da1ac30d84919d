"""Related documents: same subjects, same authors, same series.

Each takes the catalogue of `with_slugs` and one reference slug. The reference row is read first (a point lookup on the
slug, pushed to the scan); candidates are then one filtered scan with a top-k, not a self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions.text import fold


def _reference(df: DataFrame, key: str):
    cols = ["slug", "authors_slugs", "subjects_slugs", "series_slug", "publication"]
    return df.where(F.col("slug") == key).select(*cols).first()


def _others(df: DataFrame, ref) -> DataFrame:
    out = df.where(F.col("slug") != ref["slug"])
    return out.where(F.col("series_slug") != ref["series_slug"]) if ref["series_slug"] else out


def _idf_score(df: DataFrame, column: str, keys: list[str]) -> Column:
    """Sum of the inverse document frequencies of the shared keys; one aggregate row gives the frequencies."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.array_contains(column, k).cast("bigint")).alias(f"d{i}") for i, k in enumerate(keys)]).first()
    score = F.lit(0.0)
    for i, k in enumerate(keys):
        d = float(row[f"d{i}"] or 0)
        score = score + F.when(F.array_contains(column, k), F.log(F.lit(1 + (row["n"] - d + 0.5) / (d + 0.5)))).otherwise(0.0)
    return F.round(score, 6)


def _series_order() -> list[Column]:
    return [F.coalesce(fold(F.col("series")), F.lit("")).asc(), F.coalesce(F.col("series_index"), F.lit(0.0)).asc(), F.col("slug").asc()]


def same_subjects(df: DataFrame, key: str, k: int = 4) -> DataFrame:
    """Documents that share subjects, by score, then by nearness in time.

    A dated reference takes the best k published before it and the best k not before it, and of those the best k; an
    undated one takes the best k by score. No author in common, not of the same series, not itself.
    """
    ref = _reference(df, key)
    none = df.limit(0).withColumn("score", F.lit(0.0))
    if ref is None or not ref["subjects_slugs"]:
        return none
    found = _others(df, ref).where(F.arrays_overlap("subjects_slugs", F.array(*[F.lit(s) for s in ref["subjects_slugs"]])))
    if ref["authors_slugs"]:
        found = found.where(~F.arrays_overlap("authors_slugs", F.array(*[F.lit(a) for a in ref["authors_slugs"]])))
    found = found.withColumn("score", _idf_score(df, "subjects_slugs", list(dict.fromkeys(ref["subjects_slugs"]))))
    days = F.coalesce(F.col("publication.days"), F.lit(0))
    at = ref["publication"]["days"] if ref["publication"] else 0
    if not at:
        return found.orderBy(F.col("score").desc(), "slug").limit(k)
    order = [F.col("score").desc(), F.abs(days - at).asc(), F.col("slug").asc()]
    older, newer = found.where(days < at).orderBy(*order).limit(k), found.where(days >= at).orderBy(*order).limit(k)
    return older.unionByName(newer).orderBy(*order).limit(k)


def same_authors(df: DataFrame, key: str, k: int = 4) -> DataFrame:
    """Documents that share an author, not of the same series."""
    ref = _reference(df, key)
    if ref is None or not ref["authors_slugs"]:
        return df.limit(0).withColumn("score", F.lit(0.0))
    mine = list(dict.fromkeys(ref["authors_slugs"]))
    found = _others(df, ref).where(F.arrays_overlap("authors_slugs", F.array(*[F.lit(a) for a in mine])))
    return found.withColumn("score", _idf_score(df, "authors_slugs", mine)).orderBy(F.col("score").desc(), *_series_order()).limit(k)


def same_series(df: DataFrame, key: str, k: int = 4) -> DataFrame:
    ref = _reference(df, key)
    if ref is None or not ref["series_slug"]:
        return df.limit(0).withColumn("score", F.lit(0.0))
    found = df.where((F.col("series_slug") == ref["series_slug"]) & (F.col("slug") != key))
    return found.withColumn("score", F.lit(0.0)).orderBy(*_series_order()).limit(k)


