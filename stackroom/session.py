"""Session and table helpers shared by all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stackroom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point the checkpoint folder at the shared one the cluster names, and return it.

    A folder of this machine is made only where the setting is unset and the master is local; it goes with the process. On a
    cluster without the setting this raises: executors could neither read it nor survive each other.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = _own_folder("stackroom-ckpt-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def _own_folder(prefix: str) -> str:
    """A temporary folder that is removed when the process ends."""
    import atexit
    import shutil
    import tempfile

    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of few files over all cores before a CPU-heavy step.

    A Parquet file of one row group gives one task with rows, however it is split. Where there are fewer files than cores
    the projected columns are dealt out round-robin (one shuffle of them); otherwise the scan stays as it is.
    """
    cores = max(2, df.sparkSession.sparkContext.defaultParallelism)
    if df.rdd.getNumPartitions() > 1000 or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(2 * cores)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once a context.

    Workers then have it whatever their path is; Spark's own file server distributes the archive.
    """
    sc = spark.sparkContext
    if getattr(sc, "_stackroom_shipped", False):
        return
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    archive = Path(_own_folder("stackroom-")) / "stackroom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(archive))
    sc._stackroom_shipped = True
