"""MinHash near-dedup with tensored banding: table keys are pairs from two small sketch collections."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import HOT_SHARE, components, cut, lookup, pick
from ._text import chunks, hashes, mix, words

#: Sketches in each collection, and minhashes in each sketch. SIDE * SIDE tables need only 2 * SIDE * WIDTH
#: minhashes. A pair at the threshold 0.85 shares no table with probability 2 * (1 - 0.85**2)**8 = 7e-5.
SIDE, WIDTH = 8, 2
#: Up to so many ids (8 bytes each) are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A bucket of more than so many rows (or HOT_SHARE of all) isn't sent to one task. One of DRAWN rows shows which.
HOT_BUCKET, DRAWN = 200_000, 64
#: Members that are compared with one copy of their leader's text.
GROUP = 10_000
#: Counts of shingles that order them: up to MOST_COUNTS of them (12 bytes each) go to the tasks, without the
#: small ones as long as these are at most MOST_LIGHT; more are joined by a shuffle.
MOST_COUNTS, MOST_LIGHT = 1_000_000, 64
PERCENT = 85

_rng = np.random.default_rng(88)
_XOR, _MUL = (_rng.integers(1, 1 << 63, 2 * SIDE * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 3-word shingles of lower-cased words, row by row, and their offsets.

    A row with one or two words has one shingle, the whole sequence; a row without words has none.
    """
    start, end, row = words(data, off)
    rows = len(off) - 1
    h = hashes(data, start, end)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    if len(h) >= 3:
        triple = mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix(h[1:-1] + np.uint64(0x1234567)) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F))
        inside = row[:-2] == row[2:]
        triple, owner = triple[inside], row[:-2][inside]
    else:
        triple, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    one, two = np.flatnonzero(count == 1), np.flatnonzero(count == 2)
    short = np.concatenate([mix(h[first[one]] ^ np.uint64(1)), mix(h[first[two]] * np.uint64(3) + h[first[two] + 1] * np.uint64(5) + np.uint64(2))])
    if len(short):
        triple, owner = np.concatenate([triple, short]), np.concatenate([owner, one, two])
        order = np.argsort(owner, kind="stable")
        triple, owner = triple[order], owner[order]
    return triple, np.searchsorted(owner, np.arange(rows + 1))


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    h, at = shingles(data, off)
    at = at.tolist()
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


SIGNATURE = "doc_id long, n_shingles long, digest binary, mins array<int>"


def _signatures(batches):
    for batch in batches:
        for i, j, data, off in chunks(batch.column(1)):
            sets = shingle_sets(data, off)
            size = np.array([len(s) for s in sets])
            full = np.flatnonzero(size)
            mins = np.zeros((j - i, len(_XOR)), np.uint64)
            if len(full):
                flat = np.concatenate([sets[k] for k in full])
                at = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                for k in range(len(_XOR)):
                    mins[full, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], at)
            short = (mix(mins) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, short.size + 1, short.shape[1]), pa.int32()), pa.array(short.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), lists],
                names=["doc_id", "n_shingles", "digest", "mins"],
            )


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, rep): SIDE * SIDE table keys of each class, every pair of a sketch of either collection."""
    sketches = lambda first: F.transform(F.sequence(F.lit(first), F.lit(first + SIDE - 1)), lambda k: F.xxhash64(k, *(F.get("mins", k * WIDTH + w) for w in range(WIDTH))))
    one = classes.select("rep", F.explode(sketches(0)).alias("x"), sketches(SIDE).alias("v"))
    return one.select("rep", "x", F.explode("v").alias("y")).select(F.xxhash64("x", "y").alias("key"), "rep")


def _stars(batches):
    """(smallest member, other member) of every bucket of rows that are sorted by key and member."""
    key, lead = None, 0
    for batch in batches:
        k, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        new[0] = key is None or k[0] != key
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        leader = np.where(at >= 0, r[np.maximum(at, 0)], lead)
        key, lead = k[-1], leader[-1]
        other = leader != r
        yield pa.RecordBatch.from_arrays([pa.array(leader[other]), pa.array(r[other])], names=["a", "b"])


def candidates(classes: DataFrame, total: int) -> DataFrame:
    """(a, b, n): b shares n buckets whose smallest member is a.

    Key rows are shuffled once and a bucket streams through its task. Buckets of very many rows, at most
    2 * SIDE**2 / HOT_SHARE, show in a sample; their smallest members are found by partial aggregation and
    joined by broadcast, so their rows aren't shuffled at all.
    """
    limit = max(HOT_BUCKET, int(total * HOT_SHARE))
    keys = table_keys(classes)
    hot = cut(keys.where(F.pmod(F.xxhash64(F.lit(8), "rep"), F.lit(DRAWN)) == 0).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit / (2 * DRAWN)).select("key"))
    cold, pairs = keys, None
    if hot.count():
        cold = keys.join(F.broadcast(hot), "key", "left_anti")
        leaders = cut(keys.join(F.broadcast(hot), "key", "left_semi").groupBy("key").agg(F.min("rep").alias("a")))
        pairs = keys.join(F.broadcast(leaders), "key").where("rep <> a").select("a", F.col("rep").alias("b"))
    found = cold.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_stars, "a long, b long")
    return (found.union(pairs) if pairs is not None else found).groupBy("a", "b").agg(F.count("*").alias("n"))


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents with these ids; each distinct text of a repeated id."""
    found = cut(docs.withColumnRenamed("doc_id", "id").join(_few(ids), "id", "left_semi"))
    return cut(found.dropDuplicates(["id", "text"])) if found.count() > ids.count() else found


def _with(pairs: DataFrame, side: str, table: DataFrame, columns: list[str], total: int) -> DataFrame:
    """Add a vertex's columns to pairs; a vertex that is in very many pairs is looked up skew-safely."""
    counts = pairs.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("__n"))
    keyed = table.join(counts, "id").withColumnRenamed("id", side)
    return lookup(pairs, keyed.select(side, "__n", *(F.col(c).alias(f"{c}_{side}") for c in columns)), side, "__n", [f"{c}_{side}" for c in columns], "b" if side == "a" else "a", total)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted hashes) have 100 * intersection >= percent * union."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) * 100 < len(y) * percent or not len(x):
        return False
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(percent: int):
    """Members stream past their leader, which comes first in each group; a group is never held."""

    def run(batches):
        group, leaders = None, []
        for batch in batches:
            a, salt, role, ids = (batch.column(k).to_numpy() for k in range(4))
            keep = np.zeros(len(a), bool)
            for i, j, data, off in chunks(batch.column(4)):
                for k, own in enumerate(shingle_sets(data, off), i):
                    if group != (a[k], salt[k]):
                        group, leaders = (a[k], salt[k]), []
                    if role[k] == 0:
                        leaders.append(own)
                    else:
                        keep[k] = any(similar(x, own, percent) for x in leaders)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(ids[keep])], names=["a", "b"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The text of a member travels once for each of its pairs and that of a leader once for GROUP members, whose
    groups are salted, and sets are made again where they are compared.
    """
    pairs = cut(pairs.select("a", "b"))
    total = pairs.count()
    if not total:
        return pairs
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / GROUP).cast("int")
    members = lookup(pairs, counts, "a", "n", ["n"], "b", total).select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"), F.lit(1).alias("role"))
    leaders = counts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("role"))
    ready = texts.join(members.union(leaders), "id").select("a", "salt", "role", "id", "text")
    return cut(ready.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(_confirm(percent), "a long, b long"))


def _tally(batches):
    """How many sets of the batch have each shingle, by the upper half of its hash."""
    for batch in batches:
        for _, _, data, off in chunks(batch.column(1)):
            token, count = np.unique(np.concatenate([s >> np.uint64(32) for s in shingle_sets(data, off)] or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.uint32).view(np.int32)), pa.array(count)], names=["half", "n"])


def _prefix(n: int, percent: int) -> int:
    """So many of the first elements of a set of n hold one of any similar enough set."""
    return n - -(-percent * n // 100) + 1


PREFIX = "id long, variant long, n int, token long, place int"


def _prefixes(half: np.ndarray | None, count: np.ndarray | None, percent: int):
    """The rarest shingles of each set and their places from 1; without ``half`` all shingles, without places."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, _, data, off in chunks(batch.column(1)):
                columns = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int32, np.int64, np.int32)]
                for k, own in enumerate(shingle_sets(data, off), i):
                    if not len(own):
                        continue
                    n, variant = len(own), int(np.bitwise_xor.reduce(own).view(np.int64))
                    if half is not None:
                        own_half, weight = (own >> np.uint64(32)).astype(np.uint32).view(np.int32), np.zeros(n, np.int64)
                        if len(half):
                            at = np.minimum(np.searchsorted(half, own_half), len(half) - 1)
                            weight = np.where(half[at] == own_half, count[at], 0)
                        own = own[np.lexsort((own.view(np.int64), weight))[: _prefix(n, percent)]]
                    for c, x in zip(columns, (np.full(len(own), ids[k]), np.full(len(own), variant), np.full(len(own), n, np.int32), own.view(np.int64), np.arange(1, len(own) + 1, dtype=np.int32)), strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["id", "variant", "n", "token", "place"])

    return run


def prefixes(texts: DataFrame, percent: int) -> DataFrame:
    """(id, variant, n, token, place): the rarest shingles of each set, enough for every similar pair to share one.

    Two sets that are similar enough share so much that, in any common order of the shingles, the first few
    of both can't be apart (prefix filtering). Shingles are ordered by the number of texts that have them, so
    what a template or a quoted passage brings to very many texts comes last.
    """
    counts = cut(texts.mapInArrow(_tally, "half int, n long").groupBy("half").agg(F.sum("n").alias("f")).where("f > 1"))
    sizes = {r.f: r.n for r in counts.groupBy(F.least("f", F.lit(MOST_LIGHT + 1)).alias("f")).agg(F.count("*").alias("n")).collect()}
    light = next((k for k in range(1, MOST_LIGHT + 1) if sum(n for f, n in sizes.items() if f > k) <= MOST_COUNTS), None)
    if light:
        got = counts.where(F.col("f") > light).orderBy("half").toArrow()  # at most MOST_COUNTS
        return texts.mapInArrow(_prefixes(got["half"].to_numpy(), got["f"].to_numpy(), percent), PREFIX)
    every = texts.mapInArrow(_prefixes(None, None, percent), PREFIX).drop("place").withColumn("half", F.shiftright("token", 32).cast("int")).join(counts, "half", "left")
    place = F.row_number().over(Window.partitionBy("id", "variant").orderBy(F.coalesce("f", F.lit(0)), "token"))
    return every.withColumn("place", place).where(F.col("place") <= F.expr(f"n - CAST(ceil({percent} * n / 100D) AS INT) + 1")).select("id", "variant", "n", "token", "place")


def unresolved(star: DataFrame, parts: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) that the stars leave open.

    A bucket is open when its members aren't all in one component. Members of open buckets are paired when
    they are in different components and their prefixes share a shingle, so documents of one template that
    aren't similar enough give no pairs, however many they are.
    """
    total = star.count()
    placed = cut(_with(_with(star.select("a", "b"), "a", parts, ["component"], total), "b", parts, ["component"], total))
    far = F.coalesce("component_a", "a") != F.coalesce("component_b", "b")
    open_ = cut(placed.where(far).select("a").distinct())
    if not open_.count():
        return star.select("a", "b").limit(0)
    inside = placed.join(_few(open_), "a", "left_semi")
    members = cut(inside.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.coalesce("component_a", "a").alias("component")), F.struct(F.col("b").alias("id"), F.coalesce("component_b", "b").alias("component")))).alias("m")).select("m.*").distinct())
    own = cut(texts.join(_few(members.select("id")), "id", "left_semi"))
    rows = cut(prefixes(own, percent).join(members, "id"))
    one = lambda k: rows.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "variant", "n", "place", "component")))
    x, y = one("x").where(F.col("place_x") <= F.expr(f"n_x - CAST(ceil({2 * percent} * n_x / {100 + percent}D) AS INT) + 1")), one("y")
    near = (F.col("component_x") != F.col("component_y")) & ((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") != F.col("id_y")))) & (F.col("n_x") * 100 >= F.col("n_y") * percent)
    shared = x.join(y, "token").where(near).groupBy("id_x", "variant_x", "id_y", "variant_y").agg(F.count("*").alias("k"), F.max("place_x").alias("px"), F.max("place_y").alias("py"), F.first("n_x").alias("nx"), F.first("n_y").alias("ny"))
    most = F.col("k") + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    found = shared.where(most * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
    return found.join(star.select("a", "b"), ["a", "b"], "left_anti")


def near_dedup(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Connected groups of documents whose 3-word shingle sets have a Jaccard similarity of percent/100.

    Documents with equal sets are one class, represented by its smallest id, before anything is paired. A
    representative has a key in each table, and a bucket gives pairs with its smallest member only. Of these a
    representative's pair with the leader of most of its buckets is verified first, then those that still join
    different components. Buckets that then span several components give further pairs (``unresolved``), so no
    link is lost to a dissimilar smallest member. Pairs are confirmed on the full sets of whole texts.

    Null and empty texts and those without words have no set, are linked with nothing, and stay. Null ids are
    never linked; they stay with a null component unless their class has an id. Repeated rows with one id share
    its fate. An empty table gives an empty result. A very long text is one set like any other.
    Returns doc_id, n_shingles, component_id, kept.
    """
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    rows = cut(texts.mapInArrow(_signatures, SIGNATURE))
    total = rows.count()
    filled = rows.where("n_shingles > 0")
    classes = cut(filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("mins").alias("mins")))
    linked = classes.where("rep IS NOT NULL")
    sizes = linked.groupBy(F.col("rep").alias("id")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    star = cut(candidates(linked, total))
    star = _with(_with(star, "a", sizes, ["low", "high"], n_star := star.count()), "b", sizes, ["low", "high"], n_star)
    star = cut(star.select("a", "b", "n", ((F.col("high_a") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low_a") * percent)).alias("fits")))
    ids = cut(star.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    held = _texts(texts, ids)

    best = cut(star.where("fits").groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b"))
    links = verify(best, held, percent)
    parts = cut(components(links))
    left = star.where("fits").join(best, ["a", "b"], "left_anti").select("a", "b")
    placed = _with(_with(left, "a", parts, ["component"], n_star), "b", parts, ["component"], n_star)
    links = links.union(verify(placed.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")), held, percent))
    parts = cut(components(links))
    more = verify(unresolved(star, parts, held, percent), held, percent)

    final = components(links.union(more)).withColumnRenamed("id", "rep")
    table = classes.select("digest", "rep", "copies").join(final, "rep", "left").select("digest", "copies", F.coalesce("component", "rep").alias("component"))
    out = lookup(filled.select("doc_id", "n_shingles", "digest"), table, "digest", "copies", ["component"], "doc_id", total)
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    both = out.select("doc_id", "n_shingles", F.col("component").alias("component_id")).union(alone)
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8(spark, sf_dir: str) -> DataFrame:
    """``near_dedup`` of all documents, at a Jaccard similarity of 0.85."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
  ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END AS g FROM w),
c AS (SELECT list_sort(g) AS g, min(doc_id) AS rep, len(any_value(g)) AS n FROM s WHERE len(g) > 0 GROUP BY 1),
e AS (SELECT rep, n, unnest(g) AS x FROM c),
p AS (SELECT l.rep AS a, r.rep AS b FROM e l JOIN e r ON l.x = r.x AND l.rep < r.rep AND least(l.n, r.n) * 100 >= 85 * greatest(l.n, r.n)
  GROUP BY l.rep, r.rep, l.n, r.n HAVING 100 * count(*) >= 85 * (l.n + r.n - count(*))),
k AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, low) AS (SELECT rep, rep FROM c UNION SELECT k.b, r.low FROM r JOIN k ON k.a = r.id WHERE r.low < k.b),
m AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(m.low, s.doc_id) AS component_id, coalesce(m.low, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.g) = c.g LEFT JOIN m ON m.id = c.rep
"""
