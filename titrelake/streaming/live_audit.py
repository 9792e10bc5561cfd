"""Incremental audit of measurement files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructField, StructType, TimestampType

from ..operators.comparability import series_key
from ..schema import MEASUREMENT


def arrivals(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream over a folder of measurement Parquet files with an event time column `ts`."""
    schema = StructType([*MEASUREMENT.fields, StructField("ts", TimestampType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_audit(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by series and window; rows later than the watermark are dropped, and state with them."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", window), series_key(stream).alias("series"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.coalesce(F.col("below_lloq"), F.lit(False))).alias("below_lloq"), F.approx_count_distinct("subject_id").alias("subjects"))
    )


def with_verdicts(stream: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Stream-static join: each arriving row with the series it must not be compared with."""
    bad = verdicts.where("level = 2").select("key_a", "key_b")
    both = bad.unionByName(bad.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))
    apart = both.groupBy("key_a").agg(F.array_sort(F.collect_set("key_b")).alias("not_with"))
    return stream.withColumn("series", series_key(stream)).join(apart, F.col("series") == F.col("key_a"), "left").drop("key_a")
