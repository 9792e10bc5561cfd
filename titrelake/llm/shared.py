"""Lineage cuts and naming rules shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textarrays import slices


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of checkpoints: the cluster's, or one of our own if Spark runs in this process alone (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="titrelake-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so later reads survive lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """Like cut, as a Parquet table in the checkpoint folder: for wide intermediates, which it compresses."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the checkpoint folder, which clear() removes."""
    _WRITTEN.append(f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def clear(spark: SparkSession) -> int:
    """Remove all that this application has in its checkpoint folder (tables, checkpoints, the pipeline's stages); how many
    folders. For when results are no longer read: they are lazy and need these until then."""
    _WRITTEN.clear()
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        return 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)  # Spark makes one with a name of its own for each application
    fs = path.getFileSystem(conf)
    inside = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
    for x in inside:
        fs.delete(x, True)
    return len(inside)


def bounded(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A materialised df with narrow rows, marked for broadcast if it has at most `most` rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= most else df


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add (case-insensitive, as Spark resolves)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def map_rows(df: DataFrame, text: str, added: dict[str, str], run: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list]]) -> DataFrame:
    """Rows of df that run(bytes, offsets of the texts) keeps, a mask, with the added columns (name to type) whose values it
    gives. Columns travel under numbers, so that any names will do."""
    names, at = df.columns, df.columns.index(text)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    more = [f"n{i}" for i in range(len(added))]
    out = [*plain.columns, *more]
    spec = ", ".join([f"{c} {t}" for c, t in plain.dtypes] + [f"{c} {t}" for c, t in zip(more, added.values())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in slices(batches, f"c{at}"):
            ok, values = run(raw, offs)
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, values)], names=out).filter(pa.array(ok))

    return plain.mapInArrow(each, spec).toDF(*names, *added)


def row_hash(df: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    """64-bit hash of a row's columns; maps are hashed as JSON because Spark does not hash maps."""
    cols = [F.to_json(f"`{c}`") if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes if c not in skip]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("long")


def number_array(values: list, kind: str = "bigint") -> Column:
    """A literal array from one string, so that long arrays cost one expression, not one per element."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
