"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import bisect
import hashlib
import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._spark import cut, exists, pick, shared_dir

#: Virtual slots: fixed for the life of a data set, so that the map is at most so many rows.
SLOTS = 16_384
#: Share of the mean that shards may differ by before a stored map is edited.
SLACK = 0.005


@dataclass
class SlotMap:
    """Shard of each virtual slot. Every edit makes the next version and logs the slots that it moved."""

    shards: int
    of: list[int]
    version: int = 1
    moves: list[dict] = field(default_factory=list)

    @classmethod
    def start(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(shards, [k % shards for k in range(slots)])

    def edit(self, of: list[int], shards: int | None = None) -> SlotMap:
        moved = [[k, a, b] for k, (a, b) in enumerate(zip(self.of, of, strict=True)) if a != b]
        return SlotMap(shards or self.shards, list(of), self.version + 1, [*self.moves, {"version": self.version + 1, "moved": moved}])

    def balance(self, weight: list[int]) -> SlotMap:
        """Largest slots first, each to the lightest shard; ties go to the smaller shard number."""
        heap, of = [(0, s) for s in range(self.shards)], list(self.of)
        for k in sorted(range(len(of)), key=lambda k: (-weight[k], k)):
            if not weight[k]:
                break
            load, s = heapq.heappop(heap)
            of[k] = s
            heapq.heappush(heap, (load + weight[k], s))
        return self.edit(of)

    def rebalance(self, weight: list[int], slack: float = SLACK) -> SlotMap:
        """Move slots from the heaviest shard to the lightest, each about half of what they differ by.

        That goes on until they differ by at most ``slack`` of the mean, or no slot is small enough to help. Where
        that holds already the map stays as it is, in the same version.
        """
        load, held, of = [0] * self.shards, [[] for _ in range(self.shards)], list(self.of)
        for k, s in enumerate(of):
            load[s] += weight[k]
            held[s].append((weight[k], k))
        for h in held:
            h.sort()
        while True:
            high, low = max(range(self.shards), key=lambda s: (load[s], -s)), min(range(self.shards), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            at = bisect.bisect_right(held[high], (gap / 2, len(of))) - 1
            if at < 0 or not held[high][at][0]:
                at += 1
                while at < len(held[high]) and not held[high][at][0]:
                    at += 1
            if gap <= slack * sum(load) / self.shards or at >= len(held[high]) or held[high][at][0] >= gap:
                return self if of == self.of else self.edit(of)
            w, k = held[high].pop(at)
            bisect.insort(held[low], (w, k))
            load[high], load[low], of[k] = load[high] - w, load[low] + w, low

    def grow(self, weight: list[int]) -> SlotMap:
        """Add one shard; slots move only into it, from the heaviest shards, until it has its share."""
        load, held = [0] * self.shards, [[] for _ in range(self.shards)]
        for k, s in enumerate(self.of):
            load[s] += weight[k]
            held[s].append(k)
        for h in held:
            h.sort(key=lambda k: (weight[k], -k))
        share, new, of = sum(load) / (self.shards + 1), 0, list(self.of)
        heap = [(-x, s) for s, x in enumerate(load)]
        heapq.heapify(heap)
        while heap and new < share:
            x, s = heapq.heappop(heap)
            if not held[s]:
                continue
            k = held[s].pop()
            if new + weight[k] <= share * 1.01 and weight[k]:
                of[k] = self.shards
                new += weight[k]
                x += weight[k]
            heapq.heappush(heap, (x, s))
        return self.edit(of, self.shards + 1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version as one row; earlier versions stay readable."""
        spark.createDataFrame([(self.version, self.shards, self.of, json.dumps(self.moves))], "version int, shards int, of array<int>, moves string").write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        rows = spark.read.parquet(path)
        row = (rows.where(F.col("version") == version) if version else rows.orderBy(F.desc("version"))).first()
        return cls(row.shards, list(row.of), row.version, json.loads(row.moves))


def stored_map(spark: SparkSession, path: str, weight: list[int], shards: int) -> SlotMap:
    """The newest version at ``path``, edited where the bytes of its slots ask for it; the edit is stored as the next.

    Without a stored version the first one is balanced afresh. A map of fewer shards grows, one at a time.
    """
    found = SlotMap.load(spark, path) if exists(spark, path) else None
    if found is None:
        used = SlotMap.start(shards, len(weight)).balance(weight)
    else:
        if found.shards > shards or len(found.of) != len(weight):
            raise ValueError(f"the map at {path} has {len(found.of)} slots and {found.shards} shards")
        used = found
        while used.shards < shards:
            used = used.grow(weight)
        used = used.rebalance(weight)
    if found is None or used.version > found.version:
        used.save(spark, path)
    return used


def slot_of(slots: int = SLOTS) -> F.Column:
    """The fixed slot of a record: by its id, or by its text where it has none."""
    return F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(slots)).cast("int")


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, slot_map: SlotMap | None = None, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, SlotMap]:
    """Shard and gapless place of every row, and the map that was used.

    Rows hash by id into ``slots`` virtual slots, and bytes and rows are summed per slot (at most ``slots`` rows
    reach the driver). The map is ``slot_map`` as it is, or the one stored at ``map_path`` after the edits that
    these bytes ask for, or without either a fresh one. Places are the slot's first place in its shard plus the
    rank within the slot, so no shard meets in one task.

    A size is the UTF-8 length of the text plus 16; null text has no bytes and the CRC of nothing. Null ids
    are hashed by their texts. Repeated rows each get a place of their own. An empty table gives an empty result.
    Hot sources don't matter here, as only the id is hashed. The law is ``bytes``: equal texts (a group) have ids
    of their own and need not meet in one shard.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = cut(pick(docs, doc_id=id_col, text=text_col).select("doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), slot_of(slots).alias("vslot")))
    weight, count = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("w"), F.count("*").alias("c")).collect():  # at most ``slots`` rows
        weight[r.vslot], count[r.vslot] = r.w, r.c
    used = slot_map or (stored_map(rows.sparkSession, map_path, weight, shards) if map_path else SlotMap.start(shards, slots).balance(weight))
    first, at = [0] * slots, [0] * used.shards
    for k, s in enumerate(used.of):
        first[k] = at[s]
        at[s] += count[k]
    schema = T.StructType([T.StructField("vslot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("first", T.LongType())])
    table = rows.sparkSession.createDataFrame([(k, used.of[k], first[k]) for k in range(slots)], schema)
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("rank", rank).join(F.broadcast(table), "vslot")  # ``slots`` rows, fixed
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).alias("slot"), "vslot", F.lit(used.version).alias("map_version")), used


def op5(spark, sf_dir: str) -> DataFrame:
    """``shard`` of all documents into 40 shards of near equal bytes, by the map stored for this folder."""
    path = f"{shared_dir(spark)}/slot-maps/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    out, _ = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), map_path=path)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")
