"""Exact dedup through a minimal perfect hash over the distinct digests of earlier documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, lookup, pick
from ._text import mix

#: Digests per index shard; a shard's slots take about 50 bytes each.
SHARD_DIGESTS = 200_000
_GAMMA, _LEVELS = 2, 48


def normal_digest(text) -> F.Column:
    """SHA-256 of the UTF-8 text after each run of [\\x20\\x09-\\x0D] became one space; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), "UTF-8"), 256))


class PerfectHash:
    """Minimal perfect hash of 32-byte digests: levels of bit arrays, slot = rank of the key's bit.

    At each level keys that are alone at their position settle there and the others go on, so construction
    and lookup are whole-array operations. Keys still left after the last level take the final slots in order.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.rank = np.concatenate([[0], np.cumsum(bits)])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    @staticmethod
    def words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        return both[:, 0], both[:, 1]

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) ^ mix(b * np.uint64(2 * level + 1))) % np.uint64(size)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        a, b = cls.words(digests)
        left, sizes, bits = np.arange(len(a)), [], []
        for level in range(_LEVELS):
            if not len(left):
                break
            size = max(8, _GAMMA * len(left))
            at = cls.place(a[left], b[left], level, size)
            seen = np.bincount(at.astype(np.int64), minlength=size)
            sizes.append(size)
            bits.append(seen == 1)
            left = left[seen[at] > 1]
        rest = np.sort(digests[left].copy().view("V32").ravel().astype(object)) if len(left) else np.zeros(0, object)
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool), rest)

    def slot(self, digests: np.ndarray) -> np.ndarray:
        """The slot of a member; some slot, or -1, for anything else (callers compare the digest there)."""
        a, b = self.words(digests)
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.starts[level] + self.place(a[left], b[left], level, int(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        if len(self.rest):
            known = {bytes(x): int(self.rank[-1]) + k for k, x in enumerate(self.rest)}
            for k in left:
                out[k] = known.get(digests[k].tobytes(), -1)
        return out


def _matrix(digests) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), np.uint8).reshape(-1, 32)


INDEX = "shard long, sizes binary, bits binary, rest binary, digests binary, winners binary, counts binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(pdf["digest"])
    phf = PerfectHash.build(digests)
    order = np.empty(len(pdf), np.int64)
    order[phf.slot(digests)] = np.arange(len(pdf))
    row = (int(pdf["shard"].iloc[0]), phf.sizes.tobytes(), np.packbits(phf.bits).tobytes(), b"".join(map(bytes, phf.rest)), digests[order].tobytes(), pdf["winner"].to_numpy(np.int64)[order].tobytes(), pdf["n"].to_numpy(np.int64)[order].tobytes())
    return pd.DataFrame([row], columns=["shard", "sizes", "bits", "rest", "digests", "winners", "counts"])


def load_shard(row) -> tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray]:
    """The hash function and, by slot, digests, winners and counts."""
    sizes = np.frombuffer(row.sizes, np.int64)
    bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), count=int(sizes.sum())).astype(bool)
    rest = np.array([row.rest[k : k + 32] for k in range(0, len(row.rest), 32)], object)
    return PerfectHash(sizes, bits, rest), np.frombuffer(row.digests, np.uint8).reshape(-1, 32), np.frombuffer(row.winners, np.int64), np.frombuffer(row.counts, np.int64)


def _probe(batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    fresh = np.ones(len(batch), bool)
    parts = []
    if len(index):
        phf, slots, winners, counts = load_shard(index.iloc[0])
        winners, counts = winners.copy(), counts.copy()
        if len(batch):
            digests = _matrix(batch["digest"])
            at = phf.slot(digests)
            fresh = (at < 0) | (slots[np.maximum(at, 0)] != digests).any(axis=1)
            own = at[~fresh]
            np.minimum.at(winners, own, batch["winner"].to_numpy(np.int64)[~fresh])
            np.add.at(counts, own, batch["n"].to_numpy(np.int64)[~fresh])
        parts.append(pd.DataFrame({"digest": [x.tobytes() for x in slots], "winner": winners, "n": counts, "member": True}))
    if fresh.any():
        parts.append(batch.loc[fresh, ["digest", "winner", "n"]].assign(member=False))
    return pd.concat(parts) if parts else pd.DataFrame({"digest": [], "winner": [], "n": [], "member": []})


def shard_of(shards: int) -> F.Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")


def distinct_digests(rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest, partially aggregated before the shuffle. A group without any id gets the largest long."""
    return rows.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1)).alias("winner"), F.count("*").alias("n")).select(shard_of(shards), "digest", "winner", "n")


def build_index(groups: DataFrame) -> DataFrame:
    """One row per shard: the hash function, and per slot the full digest, the winner's id and its copies."""
    return groups.groupBy("shard").applyInPandas(_build, INDEX)


def probe(groups: DataFrame, index: DataFrame) -> DataFrame:
    """Byte-checked lookups of distinct digests, and all groups that they leave.

    A member adds its rows to its slot, whose winner and count are given back; nonmembers are groups of their
    own. The two are disjoint, so nothing is grouped again.
    """
    return groups.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_probe, "digest binary, winner long, n long, member boolean")


def exact_dedup(docs: DataFrame, history_below: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """Keep the smallest id of each group of equal texts.

    Rows with an id up to ``history_below`` (the middle of the ids when None) are the history that the index is
    built over; later rows are looked up in it by distinct digest, and those that it lacks are grouped
    separately. The split changes the work, not the result.

    Null and empty texts are one group. Repeated rows with the smallest id all stay; null ids never win unless
    a whole group has none, then keep_id is null and all its rows stay. An empty table gives an empty result.
    Returns doc_id, keep_id, group_size, kept, text_sha256, known (its text is in the history).
    """
    rows = cut(pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), normal_digest(F.col("text")).alias("digest")))
    total, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    if history_below is None:
        history_below = ((low or 0) + (high or 0)) // 2
    shards = max(1, -(-total // shard_digests))
    old = F.coalesce(F.col("doc_id") <= history_below, F.lit(False))
    groups = cut(probe(distinct_digests(rows.where(~old), shards), build_index(distinct_digests(rows.where(old), shards))))
    groups = groups.select("digest", "winner", F.col("n").alias("group_size"), F.col("member").alias("known"))
    out = lookup(rows, groups, "digest", "group_size", ["winner", "group_size", "known"], "doc_id", total)
    keep = F.when(F.col("winner") < (1 << 63) - 1, F.col("winner"))
    return out.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "known")


def op3(spark, sf_dir: str) -> DataFrame:
    """``exact_dedup`` of all documents, the older half of the ids as history."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("known")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
