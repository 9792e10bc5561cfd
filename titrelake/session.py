"""Session factory with the settings the library expects, and the shared folder for what a job writes in between."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def session(app: str = "titrelake", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings win where it sets them."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def spread(df: DataFrame, bytes_a_core: int = 16 << 20) -> DataFrame:
    """df dealt out over all cores if it is small, by the optimizer's estimate: a small table is often one file and so one
    task, however costly the work on its rows. A large one has many splits and stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_a_core else df


_LOCAL: list[str] = []
_WRITTEN: list[str] = []
_KEPT: dict[tuple, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or one folder of our own for this process if Spark runs in it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="titrelake-"))
    return _LOCAL[0]


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, which clear() removes."""
    _WRITTEN.append(f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: later reads neither repeat its plan nor depend on executors."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(df: DataFrame) -> str:
    """Names, sizes and times of the files that df reads: another stamp means other data."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))  # names come encoded
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha1("\n".join(out).encode()).hexdigest()


def kept(df: DataFrame, kind: str, build: Callable[[DataFrame], T]) -> T:
    """build(df), which writes tables, once for each state of the files that df reads; kept until clear()."""
    key = (df.sparkSession.sparkContext.applicationId, kind, stamp(df))
    if key not in _KEPT:
        _KEPT[key] = build(df)
    return _KEPT[key]


def clear(spark: SparkSession) -> int:
    """Remove what this process has written to the shared folder; how much. Results are lazy and need it until they are read."""
    n = len(_WRITTEN)
    _KEPT.clear()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
