"""Telemetry as a stream: the batch functions over windows with a watermark, and exactly-once files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.operators.telemetry import usable
from srcgraph.schemas import TELEMETRY_DDL


def read(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON lines that arrive in a folder; broken lines and those without a usable time are skipped, as in batch."""
    rows = spark.readStream.schema(TELEMETRY_DDL + ", broken STRING").option("columnNameOfCorruptRecord", "broken").option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return usable(rows.where("broken IS NULL").drop("broken"))


def weekly(rows: DataFrame, late: str = "1 day", at: str = "at") -> DataFrame:
    """Calls and hits by week from Monday (the epoch was a Thursday); state older than the watermark is dropped."""
    hit = F.coalesce("cache_hit", F.lit(False))
    out = rows.withWatermark(at, late).groupBy(F.window(at, "7 days", "7 days", "4 days").alias("w")).agg(F.count("*").alias("calls"), F.count_if(hit).alias("hits"))
    return out.select(F.col("w.start").cast("date").alias("week"), "calls", "hits")


def sessions(rows: DataFrame, at: str, keys: list[str], gap: str, late: str = "1 day") -> DataFrame:
    """Runs of calls of one key without a pause of ``gap``; the same in batch, where the watermark has no effect."""
    own = rows.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    out = own.groupBy(*keys, F.session_window("__at", gap).alias("w")).agg(F.count("*").alias("calls"))
    return out.select(*keys, "calls", F.col("w.start").alias("started"))


def write(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Start writing to Parquet; the checkpoint makes each batch count once."""
    return rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", folder).trigger(availableNow=True).start()


def upsert_into(rows: DataFrame, apply, checkpoint: str):
    """Run ``apply(batch, id)`` on every micro-batch, such as a cache upsert; it has to be idempotent by id."""
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
