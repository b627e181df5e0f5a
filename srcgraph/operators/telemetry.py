"""Telemetry of model calls: reading, per-pass and cross-run statistics. Batch and stream share the functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from srcgraph.functions.keys import instant, since, week_of
from srcgraph.schemas import TELEMETRY_DDL

PASSES = {"annotate": "pass_1", "synthesize": "pass_2"}


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON lines. The tolerant reader skips what isn't JSON or has no usable time, the strict one raises."""
    if strict:
        return spark.read.schema(TELEMETRY_DDL).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(TELEMETRY_DDL + ", broken STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return usable(rows.where("broken IS NULL").drop("broken"))


def usable(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", instant("ts")).where("at IS NOT NULL")


def pass_of(purpose) -> Column:
    out = F.lit(None).cast("string")
    for key, name in PASSES.items():
        out = F.when(F.col(purpose) == key, name).otherwise(out)
    return out


def pass_stats(rows: DataFrame) -> DataFrame:
    """Calls, hits and hit rate (unrounded) of each pass that has calls."""
    hit = F.count_if(F.coalesce("cache_hit", F.lit(False)))
    return rows.withColumn("pass", pass_of("purpose")).where("pass IS NOT NULL").groupBy("pass").agg(F.count("*").alias("calls"), hit.alias("hits"), (hit / F.count("*")).alias("hit_rate"))


def recent(rows: DataFrame, now, days: int) -> DataFrame:
    return rows.where(since("at", now, days))


def totals(rows: DataFrame) -> DataFrame:
    """Calls, hits and hit rate in percent, and estimated cost saved by hits and incurred by misses."""
    hit, usd = F.coalesce("cache_hit", F.lit(False)), F.coalesce("cost_usd_est", F.lit(0.0))
    out = rows.agg(F.count("*").alias("total_calls"), F.count_if(hit).alias("cache_hits"), F.coalesce(F.sum(F.when(hit, usd)), F.lit(0.0)).alias("cost_saved"), F.coalesce(F.sum(F.when(~hit, usd)), F.lit(0.0)).alias("cost_incurred"))
    return out.withColumn("hit_rate", F.coalesce(F.try_divide(100.0 * F.col("cache_hits"), "total_calls"), F.lit(0.0)))


def weekly(rows: DataFrame, at: str = "at") -> DataFrame:
    """Calls and hits by week, from Monday."""
    return rows.groupBy(week_of(at).alias("week")).agg(F.count("*").alias("calls"), F.count_if(F.coalesce("cache_hit", F.lit(False))).alias("hits"))


def prompt_key(id_="prompt_id", version="prompt_version") -> Column:
    return F.concat_ws(" ", F.coalesce(id_, F.lit("unknown")), F.coalesce(version, F.lit("unknown")))


def by_prompt(rows: DataFrame, first: str = "at") -> DataFrame:
    """Hits and misses of each prompt and version, and when each was first seen."""
    hit = F.coalesce("cache_hit", F.lit(False))
    return rows.groupBy(prompt_key().alias("prompt")).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.min(F.when(hit, F.col(first))).alias("first_hit"), F.min(F.when(~hit, F.col(first))).alias("first_miss"))


def top(counts: DataFrame, count: str, first: str, key: str, n: int = 5) -> DataFrame:
    """The n most frequent; ties go to the one seen first."""
    return counts.where(F.col(count) > 0).orderBy(F.desc(count), first, key).limit(n)


def ceiling(rows: DataFrame, run: str = "run_id", order: str = "seq", tokens: str = "tokens", max_tokens: float | None = None, max_calls: int | None = None) -> DataFrame:
    """Running calls and tokens of each run and whether the call is still allowed.

    Calls are checked before a call and tokens after it, so the call that exceeds the token ceiling is the first that
    isn't allowed, and a call past the call ceiling adds nothing.
    """
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({"calls": F.count("*").over(w), "tokens_so_far": F.sum(tokens).over(w)})
    ok = F.lit(True)
    if max_calls is not None:
        ok = ok & (F.col("calls") <= max_calls)
    if max_tokens is not None:
        ok = ok & (F.col("tokens_so_far") <= max_tokens)
    return out.withColumn("allowed", ok)
