"""A folder of files as a source: recursive scan, incremental scan, metadata of EPUB and PDF files, covers, raw files.

The scan lists files with `binaryFile`; extraction runs per file in mapInPandas, since zip and PDF parsing have no built-in
form. A file that can't be read becomes a row with an error instead of stopping the load. Files are spread over all cores
before they are parsed; output order doesn't matter, slugs are numbered by path later.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions.dates import pdf_date
from stackroom.functions.text import author_list, file_title, sanitize_description
from stackroom.operators.ingest import catalogue_fields

READABLE = r"\.(epub|pdf)$"
CONTENT_TYPES = {"epub": "application/epub+zip", "pdf": "application/pdf"}

PERSONS = "array<struct<full_name:string,role:string>>"
RECORD = (
    f"path string, format string, title array<string>, creator {PERSONS}, contributor {PERSONS}, description array<string>, "
    "language array<string>, subject array<string>, date array<struct<stamp:string,event:string>>, series string, series_index string, "
    "words double, pages double, illustrations int, pdf struct<title:string,author:string,subject:string,created:string,modified:string,language:string>, error string"
)


def relative(files: DataFrame, folder: str) -> DataFrame:
    """The readable ones of some files, with `path` relative to the folder."""
    return files.where(F.lower("path").rlike(READABLE)).withColumn("path", F.regexp_replace("path", "^.*?" + re.escape(folder.rstrip("/")) + "/", ""))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime, content) of the readable files under a folder; `path` is relative to it."""
    return relative(spark.read.format("binaryFile").options(recursiveFileLookup="true", ignoreMissingFiles="true").load(folder), folder)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the readable files, without reading them."""
    return scan(spark, folder).select("path", "length")


def pending(files: DataFrame, catalogue: DataFrame | None) -> DataFrame:
    """Files not in the catalogue yet; without one (a forced load) all files."""
    if catalogue is None:
        return files
    return files.join(catalogue.select(F.col("id").alias("path")), "path", "left_anti")


def read_records(files: DataFrame, min_megapixels: float = 0.25) -> DataFrame:
    """Each file's record by its extension, or its error."""
    names = [f.split(" ", 1)[0] for f in re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", RECORD).split(", ")]

    def one(path: str, content: bytes) -> dict:
        from stackroom.sources.epub import Epub
        from stackroom.sources.pdf import Pdf

        row: dict = dict.fromkeys(names) | {"path": path, "words": 0.0, "pages": 0.0, "illustrations": 0}
        try:
            if path.lower().endswith(".epub"):
                e = Epub(bytes(content))
                row |= e.information() | {"format": "EPUB", "words": float(e.words()), "illustrations": e.illustrations(min_megapixels)}
            else:
                p = Pdf(bytes(content))
                row |= {"format": "PDF", "pdf": p.information(), "pages": float(p.pages()), "illustrations": p.illustrations(min_megapixels)}
        except Exception as x:  # any broken file goes to quarantine
            row["error"] = f"{type(x).__name__}: {x}"[:500]
        return row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(p, c) for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=names)

    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "content").repartition(2 * cores, "path").mapInPandas(run, RECORD)


def metadata(records: DataFrame) -> DataFrame:
    """Catalogue rows of readable records of both formats."""
    good = records.where(F.col("error").isNull())
    counts = good.select(F.col("path").alias("id"), "words", "pages", "illustrations")
    epub = catalogue_fields(good.where(F.col("format") == "EPUB"))
    p = F.col("pdf")
    none = F.array().cast("array<string>")
    pdf = good.where(F.col("format") == "PDF").select(
        F.col("path").alias("id"), file_title(p["title"], F.col("path")).alias("title"), author_list(p["author"]).alias("authors"),
        none.alias("illustrators"), F.coalesce(sanitize_description(p["subject"]), F.lit("")).alias("description"),
        F.coalesce(p["language"], F.lit("")).alias("language"), pdf_date(p["created"], p["modified"]).alias("publication"),
        F.lit("").alias("series"), F.lit(0.0).alias("series_index"), none.alias("subjects"), F.lit("PDF").alias("format"),
    )
    return epub.unionByName(pdf).join(counts, "id")


def failures(records: DataFrame) -> DataFrame:
    return records.where(F.col("error").isNotNull()).select("path", "error")


def covers(files: DataFrame) -> DataFrame:
    """(path, cover) of the files that have one, as stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from stackroom.sources.epub import Epub
        from stackroom.sources.pdf import Pdf

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    got = Epub(bytes(content)).cover() if path.lower().endswith(".epub") else Pdf(bytes(content)).cover()
                except Exception:
                    got = None
                if got:
                    out.append((path, got))
            yield pd.DataFrame(out, columns=["path", "cover"])

    return files.select("path", "content").mapInPandas(run, "path string, cover binary")


def raw_file(files: DataFrame, path: str) -> DataFrame:
    """(path, content_type, content) of one file."""
    kinds = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    ext = F.lower(F.regexp_extract("path", r"([^.]+)$", 1))
    return files.where(F.col("path") == path).select("path", F.try_element_at(kinds, ext).alias("content_type"), "content")
