"""Continuous ingestion: new files and file events keep the catalogue current; progress; windowed event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stackroom.sources.store import Store

# What a file event means.
INDEX_EVENTS, REMOVE_EVENTS = ["create", "close_write", "moved_to"], ["delete", "moved_from"]


def _started(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    """Micro-batches to `merge`: every so often without end, or (None) until all that is there is read."""
    when = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**when).start()


def watch_records(spark: SparkSession, folder: str, schema: str, merge: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Reads package records that arrive as JSON files and hands each micro-batch to `merge`."""
    return _started(spark.readStream.schema(schema).json(folder), merge, checkpoint, every)


def watch_files(spark: SparkSession, folder: str, merge: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """New library files as (path, length, modificationTime, content) micro-batches."""
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("path string, modificationTime timestamp, length bigint, content binary")
    stream = spark.readStream.format("binaryFile").schema(schema).options(recursiveFileLookup="true", ignoreMissingFiles="true").load(folder)
    return _started(stream, merge, checkpoint, every)


def ingest_files(store: Store, folder: str, files: DataFrame, now: str | None = None) -> None:
    """Adds the documents and authors of new files; what can't be read goes to the quarantine table. A file that is indexed
    already is left alone, so a micro-batch that runs twice adds nothing twice."""
    from stackroom.operators.ingest import author_rows, with_slug_columns
    from stackroom.sources import library

    known = store.read("documents")
    records = library.read_records(library.pending(library.relative(files, folder), known)).checkpoint()
    documents = with_slug_columns(library.metadata(records), known.select("slug"))
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    documents = documents.withColumn("added_on", at).checkpoint()
    store.append("documents", documents)
    store.append("authors", author_rows(documents, store.read("authors")))
    library.failures(records).write.mode("append").parquet(f"{store.folder}/quarantine")


def remove_missing(store: Store, folder: str) -> int:
    """Deletes the documents whose files are gone; returns how many."""
    from stackroom.sources import library

    listed = library.listing(store.spark, folder)
    gone = removed_paths(store.read("documents"), listed)
    slugs = store.read("documents").join(gone.select(F.col("path").alias("id")), "id", "left_semi").select("slug")
    return store.delete(slugs) if slugs.limit(1).count() else 0


def _locked(store: Store, change: Callable[[DataFrame], object]) -> Callable[[DataFrame, int], None]:
    """A change to the store as a micro-batch's function; the two queries of a library take turns."""

    def run(batch: DataFrame, _: int) -> None:
        with store.lock:
            change(batch)

    return run


def watch_library(spark: SparkSession, store: Store, folder: str, checkpoint: str, every: str | None = None) -> list[StreamingQuery]:
    """Keeps a store's catalogue in step with a folder: one query indexes new files, one removes what is gone.

    With `every` ('10 seconds') both run until they are stopped; without, new files are indexed and gone ones removed once.
    """
    queries = [watch_files(spark, folder, _locked(store, lambda df: ingest_files(store, folder, df)), f"{checkpoint}/files", every)]
    if every is None:
        queries[0].awaitTermination()
        remove_missing(store, folder)
        return queries
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return [*queries, _started(ticks, _locked(store, lambda _: remove_missing(store, folder)), f"{checkpoint}/removals", every)]


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths to index, paths to remove) of file events (path, event, at): the last event of a path decides."""
    last = events.groupBy("path").agg(F.max_by("event", F.struct("at", "event")).alias("event"))
    return last.where(F.col("event").isin(INDEX_EVENTS)).select("path"), last.where(F.col("event").isin(REMOVE_EVENTS)).select("path")


def removed_paths(catalogue: DataFrame, listing: DataFrame) -> DataFrame:
    """Indexed files that a listing lacks: a source of files reports no removals, so this runs from time to time."""
    return catalogue.select(F.col("id").alias("path")).join(listing.select("path"), "path", "left_anti")


def latest_by_key(batch: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row per key of a micro-batch, the last by `at`."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("r")).select(*keys, "r.*")


def progress(done: int, total: int, elapsed: float) -> tuple[int, float]:
    """(percentage up to 100, seconds that remain at this pace)."""
    if total <= 0 or done <= 0:
        return 0, 0.0
    return min(100, int(100 * done / total + 0.5)), max(0.0, elapsed * (total - done) / done)


def windowed_counts(events: DataFrame, at: str, size: str, by: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Events per window and kind, tumbling or, with `slide`, sliding; with a watermark on a stream."""
    src = events.withWatermark(at, late) if late else events
    out = src.groupBy(F.window(at, size, slide), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), by, "n")


def session_counts(events: DataFrame, at: str, gap: str, by: str, late: str | None = None) -> DataFrame:
    """(by, start, end, n): events of one key that follow each other within `gap`."""
    src = events.withWatermark(at, late) if late else events
    out = src.groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
