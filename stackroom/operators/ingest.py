"""From package records to the catalogue: metadata fields, slugs, authors, incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions.dates import publication_date
from stackroom.functions.people import is_author, is_illustrator
from stackroom.functions.text import author_list, base_slug, file_title, sanitize_description, slug, subject_list
from stackroom.operators.joins import numbered


def _people(persons: Column, keep) -> Column:
    """The names of the persons a predicate keeps; one field may hold several."""
    none = F.array().cast("array<string>")
    names = F.flatten(F.transform(F.filter(persons, keep), lambda p: author_list(p["full_name"])))
    return F.coalesce(F.filter(names, lambda n: n != ""), none)


def catalogue_fields(epub: DataFrame) -> DataFrame:
    """Package records (path, title, creator, contributor, description, language, subject, date, series, series_index) as
    catalogue rows: one row in, one row out, all built-in expressions."""
    none = F.array().cast("array<string>")
    creators = _people(F.col("creator"), lambda p: is_author(p["role"], True))
    helpers = _people(F.col("contributor"), lambda p: is_author(p["role"], False))
    authors = F.concat(creators, helpers)
    drawers = F.concat(*[_people(F.col(c), lambda p: is_illustrator(p["role"])) for c in ("creator", "contributor")])
    subjects = F.coalesce(F.flatten(F.transform(F.filter("subject", lambda s: s.isNotNull()), subject_list)), none)
    return epub.select(
        F.col("path").alias("id"),
        file_title(F.get("title", F.lit(0)), F.col("path")).alias("title"),
        F.when(F.size(authors) == 0, F.array(F.lit(""))).otherwise(authors).alias("authors"),
        drawers.alias("illustrators"),
        F.coalesce(sanitize_description(F.get("description", F.lit(0))), F.lit("")).alias("description"),
        F.coalesce(F.get("language", F.lit(0)), F.lit("")).alias("language"),
        publication_date(F.col("date")).alias("publication"),
        F.coalesce("series", F.lit("")).alias("series"),
        F.coalesce(F.expr("try_cast(series_index AS DOUBLE)"), F.lit(0.0)).alias("series_index"),
        subjects.alias("subjects"),
        F.lit("EPUB").alias("format"),
    )


def with_unique_slugs(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Adds slug: the base slug, with --2, --3 ... for further documents of the same base in path order.

    `taken` are slugs in use (column slug): the numbers they leave free are given out, the smallest first, so no slug stands
    twice. A base slug has no double hyphen, so what follows one is a number. Untitled works without authors share one base,
    however many they are: groups are numbered by `numbered`, which splits large ones.
    """
    base = rows.withColumn("__base", base_slug(F.col("authors"), F.col("title"), F.col("language")))
    base = numbered(base, "__base", ["id"], "__n")
    if taken is not None:
        used = taken.where(F.col("slug").rlike(r"^(?:(?!--).)*(?:--[1-9]\d{0,8})?$")).select(
            F.substring_index("slug", "--", 1).alias("__base"),
            F.coalesce(F.nullif(F.regexp_extract("slug", r"--(\d+)$", 1), F.lit("")).cast("int"), F.lit(1)).alias("t"),
        ).distinct()
        used = numbered(used.join(base.select("__base").distinct(), "__base", "left_semi"), "__base", ["t"], "r")
        # t - r numbers below t are free, so the k-th document comes behind all used ones with t - r < k: its place among both is its number
        slots = used.select("__base", (F.col("t") - F.col("r")).alias("at"), F.lit(1).alias("used"))
        slots = slots.unionByName(base.select("__base", F.col("__n").alias("at"), F.lit(0).alias("used")))
        placed = numbered(slots, "__base", ["at", "used"], "__f").where("used = 0").select("__base", F.col("at").alias("__n"), "__f")
        base = base.join(placed, ["__base", "__n"]).withColumn("__n", F.col("__f")).drop("__f")
    named = F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat_ws("--", "__base", F.col("__n").cast("string")))
    return base.withColumn("slug", named).drop("__base", "__n")


def new_records(epub: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Records whose path isn't indexed yet."""
    return epub.join(catalogue.select(F.col("id").alias("path")), "path", "left_anti")


def with_slug_columns(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Catalogue rows with their own slug and those of authors, illustrators, subjects and series."""
    none = F.array().cast("array<string>")
    each = lambda c: F.transform(F.coalesce(F.col(c), none), slug)
    return with_unique_slugs(rows, taken).withColumns(
        {"authors_slugs": each("authors"), "illustrators_slugs": each("illustrators"), "subjects_slugs": each("subjects"), "series_slug": slug(F.col("series"))}
    )


def build_catalogue(epub: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """The catalogue rows of records (only new ones, if a catalogue is given), with slugs."""
    fresh = epub if catalogue is None else new_records(epub, catalogue)
    return with_slug_columns(catalogue_fields(fresh), None if catalogue is None else catalogue.select("slug"))


def author_rows(catalogue: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(slug, name) of authors and illustrators that aren't known yet; the smallest spelling names a slug."""
    one = catalogue.select(F.explode(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("authors", "illustrators")])).alias("name"))
    rows = one.select(slug(F.col("name")).alias("slug"), F.trim("name").alias("name")).where((F.col("slug") != "") & (F.col("name") != ""))
    rows = rows.groupBy("slug").agg(F.min("name").alias("name"))
    return rows if known is None else rows.join(known.select("slug"), "slug", "left_anti")


def bulk_write(rows: DataFrame, errors: DataFrame, folder: str) -> None:
    """Writes good rows and what failed side by side; failures don't stop a load."""
    rows.write.mode("append").parquet(f"{folder}/documents")
    errors.write.mode("append").parquet(f"{folder}/quarantine")
