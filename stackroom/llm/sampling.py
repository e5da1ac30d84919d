"""Bounded samples of rows for training, the same at every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPARE = 3


def smallest_hashes(df: DataFrame, key: str, k: int, rows: int) -> DataFrame:
    """The k rows of smallest key hash of a table of about `rows` rows.

    Only the lowest `SPARE` * k / rows of the hash range is sorted at all, so what reaches the last task is a few times k
    however many partitions the table has.
    """
    h = F.xxhash64(F.col(key).cast("string"))
    share = min(1.0, SPARE * k / max(1, rows))
    low = df.withColumn("__h", h)
    if share < 1.0:
        low = low.where(F.col("__h") < int(-(2**63) + share * 2**64))
    return low.orderBy("__h", key).limit(k).drop("__h")


def smallest_hashes_by(df: DataFrame, key: str, label: str, k: int, least: int) -> DataFrame:
    """The k rows of smallest key hash, and besides them those a label needs to have `least` rows (all, if it has fewer).

    The rows are counted by label here, so both hash bounds hold for the rows sampled from, whatever was left out before.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    h = F.xxhash64(F.col(key).cast("string"))

    def bound(want: int, rows: int) -> int:
        share = min(1.0, SPARE * (want + 10) / max(1, rows))  # the ten keep small samples whole
        return 2**63 - 1 if share == 1.0 else int(-(2**63) + share * 2**64)

    low = df.withColumn("__h", h)
    overall = bound(k, sum(counts.values()))
    if counts:
        own = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, bound(least, n))])
        low = low.where(F.col("__h") <= F.greatest(F.lit(overall), own[F.col(label)]))
    # the first k of all, and what a label is still short of: one pass over what is left
    ranks = {
        "__own": F.row_number().over(Window.partitionBy(label).orderBy("__h", key)),
        "__all": F.row_number().over(Window.orderBy("__h", key)),
    }
    return low.withColumns(ranks).where((F.col("__all") <= k) | (F.col("__own") <= least)).drop("__h", "__own", "__all")
