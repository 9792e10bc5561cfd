"""Tables that grow by batches: parts in a shared folder, named by a manifest that is swapped once a batch is whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACE = T.StructType([T.StructField("batch", T.LongType()), T.StructField("at", T.LongType())])
EMPTY = {"schema": None, "parts": [], "batches": [], "next": 0}


class Kept:
    """Rows by key under a path that driver and executors share; one writer at a time, any number of readers.

    A batch is written as a new part, then a manifest that names it is moved into place. A batch that dies before leaves
    a part that no manifest names: readers never see it, and the batch can be run again. A batch whose name is in the
    manifest has no effect. Parts hold only rows that are new or replace others, so a batch never rewrites the table.

    gives_way: SQL condition on `old`, a row at hand, under which a batch's row of its key replaces it; never by default.
    Rows keep the place of their key's first row (column `ord`: batch number, order within it). Within a batch the row of
    least order counts; rows without a key are not kept, as nothing could find them again.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, gives_way: str = "false", parts: int = 32) -> None:
        self.spark, self.path, self.key, self.gives_way, self.parts = spark, path, key, gives_way, parts

    def _fs(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def manifest(self) -> dict:
        """The last whole version."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        if not names:
            return dict(EMPTY)
        fs, path = self._fs(f"manifests/{names[-1]}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, state: dict) -> None:
        fs, draft = self._fs(f"manifests/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, final = self._fs(f"manifests/{state['next']:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"another writer has made version {state['next']} of {self.path}")

    def _rows(self, state: dict) -> DataFrame:
        kind = T.StructType.fromJson(state["schema"]).add("ord", PLACE).add("seq", "long")
        rows = self.spark.read.schema(kind).parquet(*[f"{self.path}/{p['folder']}" for p in state["parts"]])
        if not any(p["replaces"] for p in state["parts"]):
            return rows.drop("seq")
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (self.key, "seq")]), "seq").alias("r"))
        return last.select(self.key, "r.*")

    def read(self) -> DataFrame | None:
        """The table's rows, one for each key, with `ord`; None before the first batch."""
        state = self.manifest()
        return self._rows(state) if state["parts"] else None

    def upsert(self, df: DataFrame, batch: str, order: str) -> bool:
        """Take in a batch; False if it was taken in before. order: column whose least row counts where keys repeat."""
        state = self.manifest()
        if batch in state["batches"]:
            return False
        cols = [c for c in df.columns if c not in (self.key, order)]
        fields = {f.name: f for f in df.schema}
        kind = T.StructType([T.StructField(n, fields[n].dataType) for n in (self.key, *cols)])
        known = state["schema"] and T.StructType.fromJson(state["schema"])
        if known:
            if {(f.name, f.dataType.simpleString()) for f in known} != {(f.name, f.dataType.simpleString()) for f in kind}:
                raise ValueError(f"the table has {known.simpleString()}, the batch {kind.simpleString()}")
            cols, kind = [f.name for f in known if f.name != self.key], known
        row = F.struct(F.col(order).cast("long").alias("at"), *cols)
        new = df.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min_by(row, F.struct(F.col(order), F.to_json(row))).alias("new"))
        if state["parts"]:
            at_hand = self._rows(state).select(self.key, F.struct(self.key, "ord", *cols).alias("old"))
            new = new.join(at_hand, self.key, "left").where(f"old IS NULL OR ({self.gives_way})")
            place, replaces = F.coalesce("old.ord", F.struct(F.lit(state["next"]).cast("long").alias("batch"), F.col("new.at").alias("at"))), F.col("old").isNotNull()
        else:
            place, replaces = F.struct(F.lit(state["next"]).cast("long").alias("batch"), F.col("new.at").alias("at")), F.lit(False)
        part = new.select(self.key, *[F.col(f"new.`{c}`").alias(c) for c in cols], place.alias("ord"), F.lit(state["next"]).cast("long").alias("seq"), replaces.alias("replaces"))
        folder = f"part-{uuid.uuid4().hex}"
        part.write.parquet(f"{self.path}/{folder}")
        replaced = bool(state["parts"]) and not self.spark.read.parquet(f"{self.path}/{folder}").where("replaces").isEmpty()
        parts = [*state["parts"], {"folder": folder, "replaces": replaced}]
        self._swap({"schema": json.loads(kind.json()), "parts": parts, "batches": [*state["batches"], batch], "next": state["next"] + 1})
        if len(parts) > self.parts:
            self.compact()
        return True

    def compact(self) -> None:
        """All parts as one, so that reading needs no shuffle again."""
        state = self.manifest()
        if len(state["parts"]) < 2:
            return
        folder = f"part-{uuid.uuid4().hex}"
        self._rows(state).withColumn("seq", F.lit(state["next"]).cast("long")).write.parquet(f"{self.path}/{folder}")
        self._swap(state | {"parts": [{"folder": folder, "replaces": False}], "next": state["next"] + 1})

    def vacuum(self) -> int:
        """Remove parts and manifests of older versions and of batches that died, once nobody reads them; how many."""
        state = self.manifest()
        stay = {p["folder"] for p in state["parts"]}
        last = f"{state['next']:012d}.json"
        old = [n for n in self._names("") if n.startswith("part-") and n not in stay] + [f"manifests/{n}" for n in self._names("manifests") if n != last]
        for name in old:
            fs, path = self._fs(name)
            fs.delete(path, True)
        return len(old)

    def sink(self, name: str, order: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch of a stream: each micro-batch once, however often it is tried."""
        return lambda df, number: self.upsert(df, f"{name}-{number}", order) and None


def evidence(spark: SparkSession, path: str) -> Kept:
    """Studies by id; a study still to be verified gives way to the next of its id."""
    return Kept(spark, path, "study_id", "old.level = 'to_verify'")


def embeddings(spark: SparkSession, path: str) -> Kept:
    """Vectors by key of model and text, never replaced."""
    return Kept(spark, path, "key")
