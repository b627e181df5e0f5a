"""Response cache as a table: lookup, upsert, purge and size."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assemble import first_wins


def split(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses)."""
    return requests.join(cache, key, "inner"), requests.join(cache.select(key), key, "left_anti")


def touch(cache: DataFrame, hits: DataFrame, now: datetime, key: str = "cache_key") -> DataFrame:
    """The cache after these hits: counts raised, time of the last hit set."""
    counts = hits.groupBy(key).agg(F.count("*").alias("__n"))
    rows = cache.join(counts, key, "left")
    hit = F.col("__n").isNotNull()
    return rows.withColumns({"hit_count": F.col("hit_count") + F.coalesce("__n", F.lit(0)).cast("int"), "last_hit_at": F.when(hit, F.lit(now)).otherwise(F.col("last_hit_at"))}).drop("__n").select(*cache.columns)


def upsert(cache: DataFrame, entries: DataFrame, key: str = "cache_key") -> DataFrame:
    """New entries replace old ones of their key; of several new ones the latest counts."""
    latest = first_wins(entries.withColumn("__age", -F.unix_micros("created_at")), [key], ["__age"]).drop("__age")
    return cache.join(latest.select(key), key, "left_anti").unionByName(latest)


def purge(cache: DataFrame, now: datetime | None = None, older_than_days: float | None = None, model: str | None = None, prompt_version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed). Conditions are joined by AND; without any all goes."""
    gone = F.lit(True)
    if older_than_days is not None:
        gone = gone & (F.col("created_at") < F.lit(now) - F.expr(f"INTERVAL {int(older_than_days)} DAYS"))
    if prompt_version is not None:
        gone = gone & (F.col("prompt_version") == prompt_version)
    if model is not None:
        gone = gone & (F.col("model") == model)
    gone = F.coalesce(gone, F.lit(False))
    return cache.where(~gone), cache.where(gone)


def stats(cache: DataFrame) -> DataFrame:
    size = F.length("input_body") + F.length("output_body")
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("body_chars"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"))
