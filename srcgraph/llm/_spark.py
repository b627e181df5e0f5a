"""Shared Spark helpers: column picking, durable cuts, skew-safe lookups and components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows, so at most 1/HOT_SHARE keys are hot.
HOT_SHARE = 1 / 1000
HOT_ROWS = 2000
SALTS = 4096
#: Rows of an Arrow batch.
BATCH_ROWS = 2048
#: Up to so many edges are closed by one union-find task; more take the star iterations.
SMALL_EDGES = 500_000


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by exact name under new names, whatever else the table holds.

    Going by position keeps names that differ only in case, or clash with ours, from being ambiguous.
    """
    names = df.columns
    plain = df.toDF(*(f"__c{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"__c{names.index(src)}").alias(out) for out, src in columns.items()))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority of its file system, as every process of the cluster understands it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or a temporary one on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return qualified(spark, found.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and go on from there (survives lost executors).

    Meanwhile Python workers get at most BATCH_ROWS rows at once, since a row may hold a whole text and both
    sides keep the buffers of the largest batch.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(key, before)


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, values: list[str], salt_by: str, total: int) -> DataFrame:
    """Left-join rows to a table with one row per key, when one key may hold a third of the rows.

    ``count`` is the number of rows of the key. Keys above the hot limit number at most 1/HOT_SHARE, so they
    are broadcast; their rows get a salt that no cold table row has, so the shuffle spreads them evenly.
    Keys must not be null.
    """
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = table.where(F.col(count) > limit).select(F.col(key), *(F.col(v).alias(f"__hot_{v}") for v in values), F.lit(True).alias("__hot"))
    cold = table.where(F.col(count) <= limit).select(F.col(key), *(F.col(v).alias(f"__cold_{v}") for v in values), F.lit(0).alias("__salt"))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.when(F.col("__hot"), 1 + F.pmod(F.xxhash64(salt_by), F.lit(SALTS))).otherwise(0).cast("int"))
    joined = marked.join(cold, [key, "__salt"], "left")
    return joined.select(*(F.col(c) for c in rows.columns), *(F.coalesce(f"__hot_{v}", f"__cold_{v}").alias(v) for v in values))


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and, for each, the smallest vertex that it is connected with."""
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = np.arange(len(ids))
    x, y = where[: len(a)], where[len(a) :]
    while True:
        small = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], small)
        np.minimum.at(new, low[y], small)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == low).all():
            return ids, ids[low]
        low = new


def _contract(batches):
    """Replace a partition's edges by stars around the smallest vertex of each local component."""
    held: list[pa.RecordBatch] = []
    size = 0

    def shrink():
        table = pa.Table.from_batches(held)
        ids, low = union_find(table["a"].to_numpy(), table["b"].to_numpy())
        keep = ids != low
        return pa.RecordBatch.from_pydict({"a": ids[keep], "b": low[keep]})

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > 2_000_000:
            held = [shrink()]
            size = 0
    if held:
        yield shrink()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest vertex reachable from every vertex of ``edges(a, b)``.

    Partitions are first contracted to stars. A small remainder is closed by one union-find task (its size is
    checked); a larger one by alternating large-star and small-star steps, whose per-vertex minima are
    partially aggregated and looked up skew-safely, so no vertex's neighbours meet in one task.
    """
    stars = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_contract, "a long, b long"))
    while (total := stars.count()) > SMALL_EDGES:
        before = stars.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count("*")).first()
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = lookup(both, low, "a", "n", ["m"], "b", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = lookup(down, low, "a", "n", ["m"], "b", total)
        stars = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        after = stars.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count("*")).first()
        if before == after:
            return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    closed = stars.coalesce(1).mapInArrow(_contract, "a long, b long")
    return closed.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), "b"))).alias("e")).select(F.col("e.a").alias("id"), F.col("e.b").alias("component")).distinct()
