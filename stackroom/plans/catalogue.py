"""Registry of the core's queries: name -> (callable(spark, sf_dir), SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.operators.split_values import packed_epub_values
from stackroom.operators.timestamps import epub_publication_stamps, normalise_stamps
from stackroom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name` with its SQL twin."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value out of an element of epub_info that holds two or more."""
    return packed_epub_values(table(spark, sf_dir, "epub_info"), table(spark, sf_dir, "subject_list"))


@query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of each record's publication stamp that states a date and isn't in normal form yet."""
    out = normalise_stamps(
        epub_publication_stamps(table(spark, sf_dir, "epub_info")), "info_id", "stamp", "shelf", table(spark, sf_dir, "shelves")
    )
    return out.where(F.col("norm").isNotNull() & (F.col("norm") != F.col("stamp"))).select("info_id", "norm")


@query("p7_status")
def p7_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure the reading of each record's publication stamp is: ok, ambiguous or invalid, with the posterior where readings compete."""
    out = normalise_stamps(
        epub_publication_stamps(table(spark, sf_dir, "epub_info")), "info_id", "stamp", "shelf", table(spark, sf_dir, "shelves")
    )
    return out.select("info_id", "norm", "status", F.round("p", 6).alias("p"))


def load() -> None:
    """Registers the queries of the other plan modules."""
    from stackroom.plans import library, records  # noqa: F401


load()
