"""Join and numbering helpers that hold at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackroom.session import ensure_checkpoint_dir

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64_000_000
GROUP_ROWS = 1_000_000


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows of at most `max_bytes` (as JSON), else as it is, for a
    shuffle join.

    The check reads no more than `max_rows` + 1 rows.
    """
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    n, octets = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if n <= max_rows and (octets or 0) <= max_bytes else df


def numbered(df: DataFrame, by: str, order: list[str], name: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`df` with the row number from 1 within `by` in the order of `order`, which must be unique in a group.

    Groups of up to `group_rows` rows are numbered in a window each. Larger ones are range-partitioned by (by, order), numbered
    within each range, and the ranges' counts added up, so no task holds such a group.
    """
    large = df.groupBy(by).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > group_rows).select(by, F.lit(True).alias("__large"))
    rank = F.row_number()
    if large.limit(1).count() == 0:
        return df.withColumn(name, rank.over(Window.partitionBy(by).orderBy(*order)))
    ensure_checkpoint_dir(df.sparkSession)
    both = df.join(broadcast_checked(large), by, "left")
    small = both.where("__large IS NULL").drop("__large").withColumn(name, rank.over(Window.partitionBy(by).orderBy(*order)))
    cut = both.where("__large").drop("__large").repartitionByRange(by, *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    sizes = cut.groupBy(by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(by, "__range", (F.sum("__n").over(Window.partitionBy(by).orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = cut.withColumn("__in", rank.over(Window.partitionBy(by, "__range").orderBy(*order)))
    parts = inside.join(broadcast_checked(before), [by, "__range"]).withColumn(name, (F.col("__before") + F.col("__in")).cast("int"))
    return small.unionByName(parts.select(*small.columns))
