"""Best-two-fit packing of token sequences, planned over the histogram of lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._bpe import bpe
from ._spark import cut, pick
from ._text import chunks

WINDOW = 1024
#: Ranks are counted in groups of about so many pieces of one length.
RANK_ROWS = 500_000
#: Shares of the window; a plan improves the bins whose gap is at least so large. All plans improve some.
GAPS = (1024, 128, 32, 16)


def _tokens(path: str, window: int, end_id: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            model = bpe(path)
            ids_of = batch.column(0)
            for i, j, data, off in chunks(batch.column(1)):
                flat, at = model.ids(data, off)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                flat, at = flat.astype("<u4"), at.tolist()
                for k in range(j - i):
                    own = np.append(flat[at[k] : at[k + 1]], np.uint32(end_id))
                    n, a, p = len(own), 0, 0
                    while a < n:
                        b = a + ((n - a) % window or window)
                        row.append(i + k)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b]))
                        if with_ids:
                            ids.append(own[a:b])
                        a, p = b, p + 1
                columns = {"doc_id": ids_of.take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def tokenize(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``window`` ids; of a longer document only the first may be shorter."""
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_tokens(path, window, end_id, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies), ...]) of each kind of bin, by best-two-fit.

    Replacing pieces in almost full bins may use up small ones that others need more, so the plan is made
    with several gaps from which on a bin is improved (GAPS), and the one with the fewest bins is taken.
    """
    return min((_plan(counts, window, max(1, window // share)) for share in GAPS), key=lambda kinds: sum(t for t, _ in kinds))


def _plan(counts: dict[int, int], window: int, least_gap: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """A bin takes the longest piece that still fits, again and again. Then its smallest piece is replaced, as
    long as that helps, by the two unpacked pieces that fill the gap so widened most tightly, and more than
    it did. A kind of bin is repeated while the counts allow, so the work depends on the number of distinct
    lengths, at most ``window``, and not on the number of pieces.
    """
    left = np.zeros(window + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    sizes, kinds = np.arange(window + 1), []
    while left.any():
        free, used, gap = left.copy(), {}, window
        below = np.maximum.accumulate(np.where(free > 0, sizes, 0))
        while (n := int(below[gap])) > 0:
            k = min(int(free[n]), gap // n)
            used[n] = used.get(n, 0) + k
            free[n] -= k
            gap -= n * k
            if not free[n]:
                below = np.maximum.accumulate(np.where(free > 0, sizes, 0))
        while gap >= max(1, least_gap) and used:
            small = min(used)
            room = gap + small
            first = np.flatnonzero(free[: room] > 0)
            if not len(first):
                break
            second = below[room - first]
            lower = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            alone = (second == first) & (free[first] < 2)
            second = np.where(alone, lower[np.maximum(first - 1, 0)], second)
            both = np.where(second > 0, first + second, 0)
            best = int(len(both) - 1 - np.argmax(both[::-1]))
            if both[best] <= small:
                break
            used[small] -= 1
            if not used[small]:
                del used[small]
            for n in (int(first[best]), int(second[best])):
                used[n] = used.get(n, 0) + 1
                free[n] -= 1
            free[small] += 1
            below = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            gap = room - int(both[best])
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
        kinds.append((times, sorted(used.items(), reverse=True)))
    return kinds


def _places(kinds: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, bins, first sequence and offset of each run of places."""
    rank: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for times, used in kinds:
        at = 0
        for n, k in used:
            runs.setdefault(n, []).append((rank.get(n, 0), times, sequence, at))
            rank[n] = rank.get(n, 0) + times * k
            at += n * k
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


def _assign(places: dict[int, tuple[np.ndarray, ...]]):
    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                first, times, base, at = places[n]
                k = np.searchsorted(first, rank[own], "right") - 1
                copy, turn = np.divmod(rank[own] - first[k], times[k])
                sequence[own], offset[own] = base[k] + turn, at[k] + copy * n
            columns = {c: batch.column(k) for k, c in enumerate(batch.schema.names) if c != "__rank"}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return run


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to pieces that have a ``length`` up to ``window``.

    Only a histogram of at most ``window`` lengths reaches the driver, and the plan made of it, some rows for
    each kind of bin, goes back with the tasks. A piece finds its bin by its rank among those of its length.
    Ranks are counted within hashed groups whose number follows the input and shifted by the groups before,
    so a length that a third of all pieces share stays spread. Equal rows are interchangeable.
    """
    rows = cut(pieces)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``window``
    places = _places(plan(counts, window))
    groups = max(1, -(-max(counts.values(), default=0) // RANK_ROWS))
    rows = rows.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("length", "__group").agg(F.count("*").alias("n")).select("length", "__group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__group").orderBy("doc_id", "piece"))
    ranked = rows.withColumn("__n", rank).join(shift, ["length", "__group"])
    named = ranked.select(*pieces.columns, (F.col("__before") + F.col("__n") - 1).alias("__rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return named.mapInArrow(_assign(places), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, **options) -> DataFrame:
    """Tokenize whole texts (null: empty, so the end id alone) and pack all pieces.

    Every document gives at least one piece. Repeated rows are packed each for itself; null ids are kept. A
    very long text becomes full pieces, each its own sequence, and one shorter first piece. An empty table
    gives an empty result.
    """
    return pack(tokenize(docs, path, **options), options.get("window", WINDOW))


def op1(spark, sf_dir: str) -> DataFrame:
    """``pack_documents`` of all documents into sequences of 1024 ids."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
