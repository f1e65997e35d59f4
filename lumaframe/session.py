"""Session helpers shared by every operator: shared folders, staged tables, code shipping."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(app: str = "lumaframe", cores: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, where all is one process, may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir isn't set: executors and driver need a folder that they share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lumaframe-")
    return _own_dirs[app]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lumaframe/{what}-{uuid.uuid4().hex}"


#: Spark then deletes a query's shuffle files when it ends; a written table is read from its files, so they aren't used again.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def put(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Write a table to a path and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """put() in the shared folder."""
    return put(df, new_path(df.sparkSession, what), compression)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it; nothing that still has to be read may be in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """stage() for an operator's own tables, in one folder of the shared folder that is deleted at the end of a with block.

    What the operator returns has to be staged outside, or must not need the tables any more.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.path, self.tables = spark, new_path(spark, what), {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        found = put(df, path)
        self.tables[id(found)] = found, path
        return found

    def drop(self, table: DataFrame) -> None:
        """Delete one of the tables now."""
        discard(self.spark, self.tables.pop(id(table))[1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        discard(self.spark, self.path)


#: Bytes of a batch that goes to a Python worker, and Spark's own setting, which it replaces unless a user has chosen another:
#: ten thousand long texts are held by the JVM and by the worker at once.
_BATCH, _BATCH_BYTES, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "8m", "67108864b"


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package even where it is on no worker's path, and send them batches of bounded size."""
    if spark.conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, _BATCH_BYTES)
    app = spark.sparkContext.applicationId
    on_path = [os.path.realpath(p or ".") for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if app in _shipped or str(ROOT) in on_path:
        return
    folder = tempfile.mkdtemp(prefix="lumaframe-code-")
    tree = Path(folder, "tree")
    shutil.copytree(ROOT / "lumaframe", tree / "lumaframe", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/lumaframe-code", "zip", tree))
    _shipped.add(app)
