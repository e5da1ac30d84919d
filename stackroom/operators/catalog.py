"""The catalogue as the engine sees it: library_metadata with its derived slugs, and facets, browsing and lookups over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions.text import slug, subject_name

PAGE = 10
MAX_PAGE = 100
FACET_LIMIT = 10_000


def slugs(c: Column) -> Column:
    """Slugs of an array's values, blank ones dropped; NULL gives an empty array."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), slug), lambda s: s != "")


def with_slugs(meta: DataFrame) -> DataFrame:
    """Adds authors_slugs, illustrators_slugs, subjects_slugs and series_slug."""
    return meta.withColumns(
        {
            "authors_slugs": slugs(F.col("authors")),
            "illustrators_slugs": slugs(F.col("illustrators")),
            "subjects_slugs": slugs(F.col("subjects")),
            "series_slug": F.coalesce(slug(F.col("series")), F.lit("")),
        }
    )


def by_slug(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col("slug") == key)


def by_slugs(df: DataFrame, keys: list[str]) -> DataFrame:
    """The documents of a list of slugs; blank ones are skipped, missing ones left out."""
    return df.where(F.col("slug").isin([k for k in keys if k.strip()]))


def browse_author(df: DataFrame, key: str) -> DataFrame:
    """Documents whose authors or illustrators have that slug (columns of `with_slugs`)."""
    return df.where(F.array_contains("authors_slugs", key) | F.array_contains("illustrators_slugs", key))


def browse_series(df: DataFrame, key: str) -> DataFrame:
    return df.where((F.col("series_slug") == key) & (F.col("series_slug") != ""))


def latest_added(df: DataFrame, now: str, k: int = 6) -> DataFrame:
    """The k newest documents by added_on, not later than `now`; bulk loads have none and are left out."""
    seen = df.where(F.col("added_on").isNotNull() & (F.col("added_on") <= F.lit(now).cast("timestamp")))
    return seen.orderBy(F.col("added_on").desc(), "slug").limit(k)


def facet_languages(df: DataFrame) -> DataFrame:
    """The distinct first two letters of the language labels."""
    code = F.substring("language", 1, 2)
    return df.select(code.alias("language")).where((F.col("language") != "") & F.col("language").isNotNull()).distinct()


def languages_present(df: DataFrame) -> DataFrame:
    """(language): the two-letter codes the labels begin with, sorted; labels of one letter and the default analyzer's name are none."""
    label = F.col("language")
    return df.where((F.length(label) >= 2) & (label != "default_analyzer")).select(F.substring(label, 1, 2).alias("language")).distinct().orderBy("language")


def facet_subjects(df: DataFrame, limit: int = FACET_LIMIT) -> DataFrame:
    """(subject_slug, names, documents) of the `limit` most used subjects: their display names and how many documents have them.

    A document's repeated subject is counted where it stands first, so one partial aggregation and one shuffle do, without a
    distinct count.
    """
    kept = F.filter(F.coalesce("subjects", F.array().cast("array<string>")), lambda s: F.trim(s) != "")
    pairs = F.transform(kept, lambda s: F.struct(slug(s).alias("slug"), subject_name(F.trim(s)).alias("name")))
    one = df.select(pairs.alias("p")).select(F.col("p.slug").alias("slugs"), F.posexplode("p").alias("pos", "v"))
    one = one.select(F.col("v.slug").alias("subject_slug"), F.col("v.name").alias("name"), (F.array_position("slugs", F.col("v.slug")) == F.col("pos") + 1).alias("first"))
    return (
        one.where(F.col("subject_slug") != "").groupBy("subject_slug")
        .agg(F.array_sort(F.collect_set("name")).alias("names"), F.sum(F.col("first").cast("bigint")).alias("documents"))
        .orderBy(F.col("documents").desc(), "subject_slug").limit(limit)
    )


def word_total(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The words of a list of slugs, a slug listed twice counting twice."""
    return keys.join(df.select("slug", "words"), "slug").agg(F.coalesce(F.sum("words"), F.lit(0.0)).alias("words"))


def page(df: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """A page of an ordered result; numbers under 1 mean the first."""
    return df.offset((max(1, number) - 1) * size).limit(size)


def page_bounds(number: int, size: int) -> tuple[int, int]:
    """Clamped page number and size of the relational lists."""
    return max(1, number), PAGE if size <= 0 else min(size, MAX_PAGE)


def total_pages(total: int, size: int) -> int:
    return -(-total // size) if size > 0 else 0


def clamp_page(number: int, total: int, size: int) -> int:
    return max(1, min(number, total_pages(total, size)))


def page_navigator(number: int, pages: int, width: int = 5) -> list[int]:
    """The page numbers shown around the current one."""
    first = max(1, min(number - width // 2, pages - width + 1))
    return list(range(first, min(pages, first + width - 1) + 1))
