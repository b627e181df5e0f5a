"""Annotating classes with a model that the caller provides, and what surrounds the calls.

The model is a callable from a batch of requests to responses; caching, retries, failure gates and telemetry
are DataFrame operations around it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.keys import backoff, cache_key
from srcgraph.functions.text import line_slice
from srcgraph.schemas import ANNOTATIONS_DDL, CACHE_DDL, TYPE_KINDS
from srcgraph.session import durable

from . import cache as cache_table
from . import telemetry
from .regex_extract import signatures

BEYOND = "beyond the ceiling"
MOST_CHARS, FLOOR, FEW_FAILURES, RATIO, SAMPLES = 240_000, 10, 3, 0.10, 5


class CallError(Exception):
    """A failed call; ``transient`` ones are tried again, after ``retry_after`` seconds if given."""

    def __init__(self, message: str, transient: bool = False, retry_after: float | None = None):
        super().__init__(message)
        self.transient, self.retry_after = transient, retry_after


def source_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind").isin(*TYPE_KINDS))


def with_source(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Add source_code: the node's lines of its file, or null where the file isn't there.

    A merge join: texts can be made of a small table, by whose size the planner would broadcast all of them.
    """
    text = files.select(F.col("path").alias("source_file"), F.col("text").alias("__text"))
    code = line_slice("__text", F.get("line_range", 0), F.get("line_range", 1))
    return nodes.join(text.hint("merge"), "source_file", "left").withColumn("source_code", code).drop("__text")


def oversized(source, most: int = MOST_CHARS) -> Column:
    return F.coalesce(F.length(source) > most, F.lit(False))


def requests(nodes: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """(node_id, degraded, extraction_mode, input): whole sources, or only the signatures of oversized ones."""
    big = oversized("source_code", most)
    body = F.when(big, F.array_join(signatures(F.col("source_code")), "\n")).otherwise(F.coalesce("source_code", F.lit("")))
    return nodes.select(F.col("id").alias("node_id"), big.alias("degraded"), F.when(big, "signatures_only").alias("extraction_mode"), body.alias("input"))


def call(requests_: DataFrame, model: Callable[[list[str]], list[str]], concurrency: int = 5, attempts: int = 3, sleep: Callable[[float], None] = time.sleep, threads: int = 1) -> DataFrame:
    """Add output and error. ``concurrency`` tasks with ``threads`` threads each call the model side by side, in
    the order of their rows; failures become rows, and transient ones are repeated with growing pauses."""

    def once(text: str) -> tuple[str | None, str | None, int]:
        for k, pause in enumerate([*backoff(attempts - 1), None]):
            try:
                return model([text])[0], None, k + 1
            except CallError as e:
                if not e.transient or pause is None:
                    return None, str(e), k + 1
                sleep(pause if e.retry_after is None else e.retry_after)
        raise AssertionError

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in frames:
                done = list(pool.map(once, pdf["input"]))
                yield pdf.assign(output=[d[0] for d in done], error=[d[1] for d in done], attempts=[d[2] for d in done])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests_.schema.fields)
    return requests_.repartition(concurrency).mapInPandas(run, fields + ", output string, error string, attempts int")


def cached_call(requests_: DataFrame, cache: DataFrame, model, **options) -> DataFrame:
    """As ``call``, but requests whose cache_key is known take the cached output. Adds cache_hit."""
    hits, misses = cache_table.split(requests_, cache.select("cache_key", F.col("output_body").alias("output")))
    none = F.lit(None)
    hit = hits.select(*requests_.columns, "output", none.cast("string").alias("error"), F.lit(0).alias("attempts"), F.lit(True).alias("cache_hit"))
    return hit.unionByName(call(misses, model, **options).withColumn("cache_hit", F.lit(False)))


def failure_gate(results: DataFrame, by: list[str] | None = None, ratio: float = RATIO, floor: int = FLOOR, few: int = FEW_FAILURES) -> DataFrame:
    """Whether too many of ``results(failed)`` failed: by share from ``floor`` on, by number below it."""
    counts = results.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"))
    return counts.withColumn("abort", F.when(F.col("n") >= floor, F.col("failures") / F.col("n") > ratio).otherwise(F.col("failures") > few))


def failure_samples(results: DataFrame, most: int = SAMPLES) -> DataFrame:
    """The first few distinct reasons and where each was first seen; a report, hence its limit."""
    return results.where("error IS NOT NULL").groupBy("error").agg(F.min("node_id").alias("node_id")).orderBy("node_id").limit(most)


def records(results: DataFrame) -> DataFrame:
    """Annotation records of the results, failures and oversized nodes marked as degraded."""
    kind = ANNOTATIONS_DDL.split("annotation ", 1)[1].removeprefix("STRUCT").strip()
    parsed = F.from_json("output", "STRUCT" + kind)
    return results.select("node_id", (F.col("degraded") | F.col("error").isNotNull()).alias("degraded"), "extraction_mode", F.when(F.col("error").isNull(), parsed).alias("annotation"))


def within_ceilings(requests_: DataFrame, max_calls: int | None, max_tokens: int | None) -> DataFrame:
    """Add ``allowed``: whether a request, in order of nodes, is made before the calls and tokens of the run are
    used up. Tokens are estimated at four characters each."""
    if max_calls is None and max_tokens is None:
        return requests_.withColumn("allowed", F.lit(True))
    rows = requests_.withColumns({"__run": F.lit(0), "__tokens": F.ceil(F.length("input") / 4)})
    out = telemetry.ceiling(rows, run="__run", order="node_id", tokens="__tokens", max_tokens=max_tokens, max_calls=max_calls)
    return out.select(*requests_.columns, "allowed")


def ask(requests_: DataFrame, model, cache: DataFrame | None = None, max_calls: int | None = None, max_tokens: int | None = None, **options) -> DataFrame:
    """The whole stack around the calls: known responses from the cache, ceilings, retries, errors as rows.

    Returns the requests with cache_key, output, error, attempts and cache_hit. Requests beyond a ceiling aren't
    made and have an error.
    """
    keyed = requests_.withColumn("cache_key", cache_key(F.lit(options.pop("model_name", "")), "input"))
    known = keyed.sparkSession.createDataFrame([], "cache_key string, output_body string") if cache is None else cache.select("cache_key", "output_body")
    hits, misses = cache_table.split(keyed, known.withColumnRenamed("output_body", "output"))
    misses = durable(within_ceilings(misses, max_calls, max_tokens))
    text = F.lit(None).cast("string")
    made = call(misses.where("allowed").drop("allowed"), model, **options).withColumn("cache_hit", F.lit(False))
    over = misses.where("NOT allowed").drop("allowed").withColumns({"output": text, "error": F.lit(BEYOND), "attempts": F.lit(0), "cache_hit": F.lit(False)})
    hit = hits.select(*keyed.columns, "output", text.alias("error"), F.lit(0).alias("attempts"), F.lit(True).alias("cache_hit"))
    return hit.unionByName(made).unionByName(over)


def cache_entries(results: DataFrame, model: str, purpose: str) -> DataFrame:
    """Entries of the response cache for the calls that were made and went well."""
    given = {"cache_key": F.col("cache_key"), "model": F.lit(model), "purpose": F.lit(purpose), "input_hash": F.sha2("input", 256), "input_body": F.col("input"), "output_body": F.col("output"), "created_at": F.current_timestamp(), "hit_count": F.lit(0)}
    made = results.where("NOT cache_hit AND error IS NULL")
    return made.select(*(given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (c.split() for c in CACHE_DDL.split(", "))))


def annotate(nodes: DataFrame, files: DataFrame, model, ratio: float = RATIO, **options) -> DataFrame:
    """Records of all nodes that have a source. Raises when too many whole sources failed."""
    return checked(durable(call(requests(with_source(source_nodes(nodes), files)), model, **options)), ratio)


def checked(results: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Records of the results, unless too many whole sources failed."""
    gate = failure_gate(results.where("NOT degraded").select(F.col("error").isNotNull().alias("failed")), ratio=ratio).first()
    if gate and gate.abort:
        reasons = [r.error for r in failure_samples(results).collect()]
        raise CallError(f"{gate.failures} of {gate.n} calls failed: {reasons}")
    return records(results)


def domains(annotations: DataFrame) -> DataFrame:
    """Summary block of each domain: its classes in order of node, one line each."""
    domain = F.coalesce("annotation.domain_hint", F.lit("unknown"))
    name = F.coalesce("annotation.class_name", F.lit("?"))
    line = F.when(F.col("degraded"), F.concat(F.lit("  "), name, F.lit(" [DEGRADED]"))).otherwise(F.concat(F.lit("  "), name, F.lit(" ["), F.coalesce(F.nullif("annotation.stereotype", F.lit("")), F.lit("UNKNOWN")), F.lit("]: "), F.coalesce("annotation.description", F.lit(""))))
    rows = annotations.select(domain.alias("domain"), F.struct("node_id", line.alias("line")).alias("x"))
    return rows.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("classes"))


def synthesise(annotations: DataFrame, model: Callable[[list[str]], list[str]]) -> dict:
    """One call over the domain summaries; the overview is a value of its own, the graph stays as it is.

    The summary of all domains is one prompt, so it is as small as a model's window.
    """
    rows = domains(annotations).orderBy("domain").collect()
    text = "\n\n".join(f"Domain: {r.domain}\n{r.lines}" for r in rows)
    return json.loads(model([f"Domains: {', '.join(r.domain for r in rows)}\n\n{text}"])[0])


def telemetry_rows(results: DataFrame, run_id: str, purpose: str, model: str) -> DataFrame:
    """Telemetry of the calls, in the schema that the statistics read."""
    return results.select(
        F.lit(run_id).alias("run_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit(purpose).alias("purpose"), F.lit(model).alias("model"), F.sha2("input", 256).alias("input_hash"), F.sha2(F.coalesce("output", F.lit("")), 256).alias("output_hash"),
        F.coalesce("cache_hit", F.lit(False)).alias("cache_hit") if "cache_hit" in results.columns else F.lit(False).alias("cache_hit"), F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), F.col("error").alias("error_message"), F.lit("1.1").alias("schema_version"),
    )
