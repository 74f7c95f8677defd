"""Session helpers: shipping the package, shared scratch storage, arrow batch limits."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SHIPPED: set[str] = set()
_MADE: dict[str, SparkSession] = {}


def local_session(cpus: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="docsift-"), "docsift.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("docsift", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Ship the package and bound Arrow batches, so that long texts don't pile up in a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; on a local master alone (tests), one is made where none is set."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = found.get() if found.isDefined() else ""
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="docsift-scratch-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in list(_MADE.items()):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended
            pass


atexit.register(_clean)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/docsift/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back; this cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Remove a table made by stash that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are no longer referred to."""
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def dealt(spark: SparkSession, rows: int, most: int) -> Iterator[bool]:
    """Shuffles planned inside have partitions of `most` rows or so at most; whether that needs more of them than are set.
    If it does, adaptive execution doesn't join them again: it goes by compressed bytes, which grow tenfold and more in a task."""
    n = -(-rows // most)
    more = n > partitions(spark)
    new = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"} if more else {}
    before = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield more
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def extend(schema: T.StructType, *fields: tuple[str, str | T.DataType]) -> T.StructType:
    """A new schema with further fields."""
    out = T.StructType(list(schema.fields))
    for name, kind in fields:
        out.add(name, kind)
    return out
