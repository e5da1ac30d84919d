"""The library's tables in a folder: schemas, opening with defaults, version check, upload, delete, JSON results."""

from __future__ import annotations

from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.session import ensure_checkpoint_dir

SCHEMA_VERSION = "1"

SCHEMAS = {
    "documents": "id string, slug string, title string, authors array<string>, authors_slugs array<string>, illustrators array<string>, "
    "illustrators_slugs array<string>, description string, language string, publication struct<days:int,precision:int>, words double, "
    "pages double, illustrations int, series string, series_slug string, series_index double, subjects array<string>, "
    "subjects_slugs array<string>, format string, added_on timestamp",
    "authors": "slug string, name string, birth_name string, entity_id string, website string, image string, retrieved_on timestamp, "
    "wikipedia_link map<string,string>, description map<string,string>, instance_of int, gender int, "
    "date_of_birth struct<days:int,precision:int>, date_of_death struct<days:int,precision:int>, pseudonyms array<string>",
    "readings": "created_at timestamp, updated_at timestamp, completed_on timestamp, user_id bigint, slug string, position string, percentage int",
    "highlights": "created_at timestamp, updated_at timestamp, user_id bigint, slug string, shared_by_id bigint, comment string",
    "users": "id bigint, uuid string, name string, username string, email string, role int, words_per_minute double, private_profile int, "
    "language string, last_request timestamp",
    "invitations": "id bigint, email string, uuid string, valid_until timestamp",
}


class Store:
    """Tables as Parquet folders, each with numbered versions and a pointer to the current one.

    A new version is written aside whole; then the pointer is renamed over the old one, which is atomic. A failure before that
    leaves the old version current, one after it the new one. The version before the current one is kept for running readers.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.lock = RLock()  # held by what reads a version and writes the next
        ensure_checkpoint_dir(spark)

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(SCHEMAS[name])

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write_bytes(self, path: str, data: bytes) -> None:
        out = self._fs(path).create(self._path(path), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def remove(self, path: str) -> bool:
        return self._fs(path).delete(self._path(path), True)

    def _version(self, name: str) -> int:
        """The current version's number, 0 if there is none."""
        pointer = f"{self.folder}/{name}/_current"
        fs = self._fs(pointer)
        if not fs.exists(self._path(pointer)):
            return 0
        stream = fs.open(self._path(pointer))
        try:
            return int(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, name: str, version: int) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        aside, pointer = f"{self.folder}/{name}/_next", f"{self.folder}/{name}/_current"
        self.write_bytes(aside, str(version).encode())
        over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs(pointer).getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self._path(aside), self._path(pointer), over)

    def read(self, name: str) -> DataFrame:
        version = self._version(name)
        if not version:
            return self.spark.createDataFrame([], self.schema(name))
        return self.spark.read.schema(self.schema(name)).parquet(f"{self.folder}/{name}/v{version}")

    def _typed(self, name: str, df: DataFrame) -> DataFrame:
        fields = self.schema(name)
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def replace(self, name: str, df: DataFrame) -> None:
        """Makes `df`, which may read the current version, the table's next one."""
        version = self._version(name) + 1
        self._typed(name, df).write.mode("overwrite").parquet(f"{self.folder}/{name}/v{version}")
        self._point(name, version)
        self.remove(f"{self.folder}/{name}/v{version - 2}")

    def append(self, name: str, df: DataFrame) -> None:
        version = self._version(name)
        self._typed(name, df).write.mode("append").parquet(f"{self.folder}/{name}/v{version or 1}")
        if not version:
            self._point(name, 1)

    def open(self, illustrated_min_size: float = 0.25, words_per_minute: float = 250) -> bool:
        """Creates what is missing, seeds the first administrator, and says whether the index must be rebuilt."""
        meta = f"{self.folder}/_meta"
        wanted = {"schema_version": SCHEMA_VERSION, "illustrated_min_size": str(illustrated_min_size)}
        known = {}
        if self._fs(meta).exists(self._path(meta)):
            known = {r["key"]: r["value"] for r in self.spark.read.parquet(meta).collect()}
        stale = bool(known) and known != wanted
        if stale:
            for name in ("documents", "authors"):
                self.remove(f"{self.folder}/{name}")
        if known != wanted:
            self.spark.createDataFrame(sorted(wanted.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(meta)
        if self.read("users").limit(1).count() == 0:
            admin = [(1, None, "Administrator", "admin", "admin@example.com", 2, float(words_per_minute), 0, "en", None)]
            self.append("users", self.spark.createDataFrame(admin, self.schema("users")))
        return stale or not known

    def upload(self, record: DataFrame, now: str) -> None:
        """Adds one document row, dated."""
        self.append("documents", record.withColumn("added_on", F.lit(now).cast("timestamp")))

    def upload_file(self, library: str, name: str, contents: bytes, now: str) -> str:
        """Writes a file into the library's folder, adds its document and new authors, and returns the document's slug.

        The slug is free among those in use. If the file can't be read the file is removed again, nothing is added, and
        ValueError says why.
        """
        from stackroom.operators.ingest import author_rows, with_slug_columns
        from stackroom.sources import library as files

        path = f"{library.rstrip('/')}/{name}"
        if self._fs(path).exists(self._path(path)):
            raise ValueError(f"{name} is in the library already")
        self.write_bytes(path, contents)
        try:
            one = files.scan(self.spark, library).where(F.col("path") == name)
            records = files.read_records(one).checkpoint()
            wrong = files.failures(records).first()
            if wrong or not records.limit(1).count():
                raise ValueError(wrong["error"] if wrong else f"{name} is no file the library reads")
            document = with_slug_columns(files.metadata(records), self.read("documents").select("slug")).checkpoint()
            self.upload(document, now)
            self.append("authors", author_rows(document, self.read("authors")))
        except BaseException:
            self.remove(path)
            raise
        return document.first()["slug"]

    def delete(self, slugs: DataFrame, library: str | None = None) -> int:
        """Deletes documents with their readings and highlights and, given the library's folder, their files; returns how many.

        Rows go first, so a failure leaves a file without a document, which the next scan finds again.
        """
        slugs = slugs.select("slug").distinct().checkpoint()
        gone = self.read("documents").join(slugs, "slug", "left_semi").select("id").checkpoint()
        for name in ("documents", "readings", "highlights"):
            self.replace(name, self.read(name).join(slugs, "slug", "left_anti"))
        n = 0
        for r in gone.toLocalIterator():
            n += 1
            if library is not None:
                self.remove(f"{library.rstrip('/')}/{r['id']}")
        return n


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


