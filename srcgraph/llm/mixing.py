"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._spark import cut, pick

WEIGHTS = (5, 2, 1)
#: No source or document is taken more often than this.
REPEATS = 3
#: Words of a block: the mix divided by BLOCKS, within these bounds.
BLOCKS, BLOCK_WORDS = 1 << 16, (64, 1 << 16)
#: Words of a source per mixing shard, and the most shards of a source.
SHARD_WORDS, MOST_SHARDS = 64_000_000, 4096
#: Sources are a dimension of the corpus that the driver holds; more of them is an error.
MOST_SOURCES = 1_000_000


def targets(sizes: list[int], weights: list[float], repeats: float = REPEATS) -> list[float]:
    """Shares of the summed size by weight, none above ``repeats`` times its size; excess is shared again."""
    size, weight = np.array(sizes, float), np.array(weights, float)
    out, open_ = np.zeros(len(size)), np.ones(len(size), bool)
    while open_.any():
        rest = size.sum() - out[~open_].sum()
        share = rest * weight / weight[open_].sum()
        over = open_ & (share > repeats * size)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = repeats * size[over]
        open_ &= ~over
    return out.tolist()


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes/1, votes/3, votes/5 ..., none above its cap; ties to the first.

    The seats down to a common quotient are found by bisection and the few still open handed out one by one,
    which gives what handing out all of them would.
    """
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    at = lambda d: np.where(votes > 0, np.minimum(caps, np.floor(votes / d + 0.5)), 0).astype(np.int64)
    if not seats:
        return np.zeros(len(votes), np.int64)
    low, high = votes[votes > 0].min() / (2.0 * caps.max() + 2), 2 * votes.max() + 1
    for _ in range(200):
        middle = (low * high) ** 0.5
        if at(middle).sum() > seats:
            low = middle
        else:
            high = middle
    got = at(high)
    heap = [(-v / (2 * g + 1), k) for k, (v, g, c) in enumerate(zip(votes.tolist(), got.tolist(), caps.tolist(), strict=True)) if v > 0 and g < c]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, k = heapq.heappop(heap)
        got[k] += 1
        if got[k] < caps[k]:
            heapq.heappush(heap, (-votes[k] / (2 * got[k] + 1), k))
    return got


def block_words(total: int) -> int:
    return min(max(total // BLOCKS, BLOCK_WORDS[0]), BLOCK_WORDS[1])


def drawn_blocks(skey: str, shard: int, count: int, quota: int, seed: int) -> np.ndarray:
    """Which of a shard's ``count`` blocks are in the last pass: the seeded draw of ``quota`` modulo ``count``."""
    out = np.zeros(count, bool)
    if count:
        order = np.random.default_rng([seed, shard, *skey.encode()]).permutation(count)
        out[order[: quota % count]] = True
    return out


def _quotas(block: int, repeats: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        words = pdf["words"].to_numpy(np.int64)
        quota = sainte_lague(words, int(pdf["blocks"].iloc[0]), repeats * -(-words // block))
        return pd.DataFrame({"skey": pdf["skey"], "shard": pdf["shard"], "words": words, "quota": quota})

    return run


def _take(block: int, seed: int):
    """Words of each row within the blocks of its shard's quota."""

    def run(batches):
        held: tuple = ()
        for batch in batches:
            skey, shard, words, quota, before, size = (batch.column(batch.schema.get_field_index(c)) for c in ("skey", "shard", "words", "quota", "before", "size"))
            shard, words, quota, before, size = (c.to_numpy() for c in (shard, words, quota, before, size))
            key = pc.dictionary_encode(skey)
            code = key.indices.to_numpy()
            taken = np.zeros(len(shard), np.int64)
            new = np.ones(len(shard), bool)
            new[1:] = (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])
            starts = np.flatnonzero(new).tolist()
            for a, b in zip(starts, [*starts[1:], len(shard)], strict=True):
                own = (key.dictionary[int(code[a])].as_py(), int(shard[a]))
                count = int(-(-words[a] // block))
                if not count:
                    continue
                if not held or held[0] != own:
                    held = (own, drawn_blocks(*own, count, int(quota[a]), seed))
                inside = held[1]
                full = np.concatenate([[0], np.cumsum(inside)]) * block
                upto = lambda x: full[np.minimum(x // block, count)] + np.where(inside[np.minimum(x // block, count - 1)], x % block, 0) * (x // block < count)  # noqa: E731, B023
                taken[a:b] = int(quota[a]) // count * size[a:b] + upto(before[a:b] + size[a:b]) - upto(before[a:b])
            keep = {c: batch.column(k) for k, c in enumerate(batch.schema.names) if c in ("doc_id", "size", "source_size", "target", "source")}
            yield pa.RecordBatch.from_pydict(keep | {"taken": pa.array(taken)})

    return run


def spread_of(seed: int):
    return F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))


def turn_of(seed: int):
    return F.xxhash64(F.lit(seed + 1), "spread")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 1, block: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words to take of every document so that each source comes to its target.

    Sources in code-point order, null last, get the weights in turn. The mix is as many words as all documents
    have. It is divided into equal blocks (``block`` words, from 64 to 65,536 by the size of the corpus), which
    go to the sources by Sainte-Laguë, and a source's blocks to its hashed shards in the same way by their
    words. A shard's documents in seeded order are a stream of blocks, the last of which may be shorter. Its
    quota of blocks is as many whole passes as it holds, and a seeded draw of distinct blocks for the rest.

    A null text, or one without words, has size 0 and nothing is taken of it. A document is taken at most
    ``repeats`` times. Repeated rows take part each for itself. Ties of the seeded order go by id and size. Null
    ids are spread by their texts. A very long document is a stretch of the stream like any other
    and may be taken in part. An empty table gives an empty result. A source that holds most rows is spread
    over as many shards as its words need.
    Returns doc_id, size, source_size, target, source, taken.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = cut(pick(docs, doc_id=id_col, text=text_col, source=source_col).select("doc_id", "source", words.alias("size"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("skey"), spread_of(seed).alias("spread")))
    spark = rows.sparkSession
    sums = rows.groupBy("skey").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sums.sort(key=lambda r: (r.skey == "n", r.skey))
    size = [r["size"] for r in sums]
    target = targets(size, [weights[k % len(weights)] for k in range(len(sums))], repeats)
    total = sum(size)
    block = block or block_words(total)
    seats = sainte_lague(np.array(target), round(total / block), repeats * -(-np.array(size, np.int64) // block)) if sums else []
    fields = [("skey", T.StringType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("blocks", T.LongType()), ("shards", T.LongType())]
    table = spark.createDataFrame([(r.skey, int(r["size"]), float(t), int(b), min(MOST_SHARDS, max(1, r["size"] // SHARD_WORDS))) for r, t, b in zip(sums, target, seats, strict=True)], T.StructType([T.StructField(*f) for f in fields]))
    rows = rows.join(table, "skey").withColumn("shard", F.pmod("spread", "shards").cast("int"))
    stock = rows.groupBy("skey", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    quotas = stock.groupBy("skey").applyInPandas(_quotas(block, repeats), "skey string, shard int, words long, quota long")
    order = Window.partitionBy("skey", "shard").orderBy(turn_of(seed), "doc_id", "size")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = rows.join(quotas, ["skey", "shard"]).withColumn("before", before)
    kind = docs.schema[source_col].dataType.simpleString()
    ready = placed.select("skey", "shard", "words", "quota", "before", "doc_id", "size", "source_size", "target", "source")
    return ready.mapInArrow(_take(block, seed), f"doc_id {docs.schema[id_col].dataType.simpleString()}, size long, source_size long, target double, source {kind}, taken long")


def op10(spark, sf_dir: str) -> DataFrame:
    """``mix`` of all documents with the weights 5, 2, 1 and at most three repeats."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
