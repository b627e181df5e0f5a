"""Cost estimates before any call is made."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASS_IN, CLASS_OUT, SYNTHESIS_IN, SYNTHESIS_OUT, WINDOW_DAYS = 2000, 400, 8000, 1000, 90


def with_prices(rows: DataFrame, prices: DataFrame, label: str = "label", model: str = "model") -> DataFrame:
    """Left-join prices by provider label and model, in lower case and trimmed. The price table is a small
    dimension; the planner broadcasts it by its size."""
    own = rows.withColumn("__key", F.lower(F.concat_ws(".", F.trim(label), F.trim(model))))
    return own.join(prices.withColumn("__key", F.lower("key")).drop("key"), "__key", "left").drop("__key")


def estimate(rows: DataFrame, prices: DataFrame, today: date, price_date: date | None, nodes: str = "nodes", window_days: int = WINDOW_DAYS) -> DataFrame:
    """One call per node and one for the synthesis; unknown models have no cost."""
    priced = with_prices(rows, prices)
    n = F.col(nodes)
    annotate = n * CLASS_IN / 1e6 * F.col("input_usd_per_million") + n * CLASS_OUT / 1e6 * F.col("output_usd_per_million")
    total = annotate + SYNTHESIS_IN / 1e6 * F.col("input_usd_per_million") + SYNTHESIS_OUT / 1e6 * F.col("output_usd_per_million")
    stale = (today - price_date).days > window_days if price_date else False
    return priced.select(*rows.columns, (n + 1).alias("total_calls"), total.alias("estimated_cost_usd"), F.coalesce(total == 0, F.lit(False)).alias("is_free"), total.isNull().alias("is_unknown_model"), F.lit(stale).alias("is_stale"), F.lit(str(price_date) if price_date else None).alias("price_date"))


def proceed(calls: int, threshold: int = 100, yes: bool = False, interactive: bool = False, ask=None) -> bool:
    """Gate on the number of calls: few, or agreed to, or nobody there to ask; else the answer."""
    if calls <= threshold or yes or not interactive:
        return True
    return bool(ask and ask(f"{calls} calls. Go on?"))
