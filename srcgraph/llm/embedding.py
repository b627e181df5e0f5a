"""Embedding near-dedup on robust-pruned flat graphs with range-expanding greedy search."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import components, cut, lookup, pick

COSINE = 0.93
#: Vectors of a cluster on average, clusters that a vector belongs to, and the most vectors that a graph is built over.
CLUSTER, OVERLAP, SHARD = 500, 3, 2500
#: Clusters of all labels that are fitted at once; larger ones are split again, each into at most SPLIT, with
#: SPLIT_OVERLAP of these for each vector, up to LEVELS times.
MOST_CLUSTERS, SPLIT, SPLIT_OVERLAP, LEVELS = 4096, 256, 2, 3
#: Vectors, and bytes of them, that the clusters of all labels are fitted on; vectors that a split is fitted on.
SAMPLE, SAMPLE_BYTES, SPLIT_SAMPLE = 50_000, 64 << 20, 8000
DEGREE, POOL, ALPHA, BEAM = 24, 48, 1.2, 48
#: Queries that the recall is audited with, the recall that is asked for, and rounds with a doubled beam.
AUDIT, RECALL, ROUNDS = 1000, 0.98, 3
_SLACK = 0.06

CLASS = "label long, dim int, rep long, copies long, e array<double>"


def unit(e: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaling by the largest component first keeps tiny and huge vectors exact."""
    e = e / np.abs(e).max(axis=1, keepdims=True)
    return e / np.sqrt((e * e).sum(axis=1, keepdims=True))


def _keys(batches):
    for batch in batches:
        ids, vectors, labels = (batch.column(k) for k in range(3))
        flat = vectors.values.to_numpy(zero_copy_only=False) + 0.0  # a null component becomes NaN
        off, missing = vectors.offsets.to_numpy(), (pc.is_null(c).to_numpy(zero_copy_only=False) for c in (vectors, labels))
        count = lambda ok: np.diff(np.concatenate([[0], np.cumsum(ok)])[off])
        size = np.diff(off)
        good = (count(np.isfinite(flat)) == size) & (count(flat != 0) > 0) & ~np.logical_or(*missing)
        key = [hashlib.blake2b(flat[off[k] : off[k + 1]].tobytes(), digest_size=16, key=str(labels[k]).encode()[:64]).digest() if good[k] else None for k in range(len(ids))]
        kept = pa.array(np.where(good, np.arange(len(ids)), 0), mask=~good)
        e = pa.ListArray.from_arrays(vectors.offsets, pa.array(flat)).take(kept)
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(key, pa.binary()), e], names=["vec_id", "label", "key", "e"])


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means on rows of length 1."""
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(8):
        own = (x @ centres.T).argmax(axis=1)
        new = np.zeros_like(centres)
        np.add.at(new, own, x)
        norm = np.sqrt((new * new).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-6, new / np.maximum(norm, 1e-6), centres)
    return centres


def fit_clusters(classes: DataFrame, seed: int = 5) -> dict[tuple[int, int], np.ndarray]:
    """Centroids of each label and dimension with more than CLUSTER vectors, fitted on a sample."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > CLUSTER).orderBy(F.desc("n"), "label", "dim").limit(MOST_CLUSTERS).collect()
    total = sum(r.n for r in sizes)
    if not total:
        return {}
    scale = min(1.0, MOST_CLUSTERS * CLUSTER / (OVERLAP * total))
    wanted = {(r.label, r.dim): max(1, round(OVERLAP * r.n * scale / CLUSTER)) for r in sizes}
    most = min(SAMPLE, SAMPLE_BYTES // (8 * max(r.dim for r in sizes)))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30)) < min(1.0, most / total) * (1 << 30)
    table = classes.where(drawn).limit(2 * most).select("label", "dim", "rep", "e").toPandas().sort_values("rep")
    out, rng = {}, np.random.default_rng(seed)
    for group, pdf in table.groupby(["label", "dim"]):
        if (k := min(wanted.get(group, 1), len(pdf))) > 1:
            out[(int(group[0]), int(group[1]))] = centroids(unit(_stack(pdf["e"])).astype(np.float32), k, rng)
    return out


def _nearest(own: pd.DataFrame, centres: np.ndarray, overlap: int) -> list[pd.DataFrame]:
    near = np.argsort(-(unit(_stack(own["e"])).astype(np.float32) @ centres.T), axis=1, kind="stable")[:, :overlap]
    return [own.assign(cluster=near[:, k].astype(np.int64)) for k in range(near.shape[1])]


def _assign(centres: dict[tuple[int, int], np.ndarray], overlap: int):
    def run(frames):
        for pdf in frames:
            parts = []
            for group, own in pdf.groupby(["label", "dim"]):
                c = centres.get((int(group[0]), int(group[1])))
                parts += [own.assign(cluster=0)] if c is None else _nearest(own, c, overlap)
            if parts:
                yield pd.concat(parts)

    return run


GROUP = ["label", "dim", "cluster"]
PLACED = CLASS + ", cluster long"


def _fit_split(cluster: int, most: int, overlap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        x = unit(_stack(pdf["e"])).astype(np.float32)
        k = min(most, len(pdf), int(pdf["n"].iloc[0]) * overlap // cluster + 1)
        return pdf[GROUP].head(1).assign(centres=[centroids(x, k, np.random.default_rng(5)).tobytes()])

    return run


def _split(most: int, overlap: int, first: int):
    """``first`` keeps the numbers of new clusters apart from those of all levels before."""

    def run(rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["label", "dim", "rep", "copies", "e", "cluster"]]
        if not len(rows) or not len(fitted):
            return rows
        centres = np.frombuffer(fitted["centres"].iloc[0], np.float32).reshape(-1, int(rows["dim"].iloc[0]))
        return pd.concat([p.assign(cluster=rows["cluster"].to_numpy() * most + p["cluster"].to_numpy() + first) for p in _nearest(rows, centres, overlap)])

    return run


def place(classes: DataFrame, centres: dict[tuple[int, int], np.ndarray], overlap: int = OVERLAP) -> DataFrame:
    """A row for each vector and cluster that it belongs to, its nearest ones.

    A cluster that is too large for one graph, as the number of centroids is bounded, is split by centroids
    fitted on a sample of its own, and so on, so clusters stay small however many vectors there are. What
    no centroid divides is left to hashed parts.
    """
    placed = cut(classes.mapInPandas(_assign(centres, overlap), PLACED))
    for _ in range(LEVELS):
        large = cut(placed.groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") > SHARD))
        if not (count := large.count()):
            break
        large = F.broadcast(large) if count <= 100_000 else large
        inside = placed.join(large, GROUP)
        drawn = F.pmod(F.xxhash64(F.lit(6), "rep"), F.lit(1 << 30)) < F.least(F.lit(1.0), SPLIT_SAMPLE / F.col("n")) * (1 << 30)
        fitted = cut(inside.where(drawn).groupBy(*GROUP).applyInPandas(_fit_split(CLUSTER, SPLIT, SPLIT_OVERLAP), "label long, dim int, cluster long, centres binary"))
        salts = F.ceil(F.col("n") / (4 * SHARD)).cast("int")
        salted = inside.withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int"))
        each = fitted.join(large, GROUP).select(*GROUP, "centres", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        split = salted.groupBy(*GROUP, "salt").cogroup(each.groupBy(*GROUP, "salt")).applyInPandas(_split(SPLIT, SPLIT_OVERLAP, MOST_CLUSTERS), PLACED)
        placed = cut(placed.join(large, GROUP, "left_anti").unionByName(split))
    return placed


def robust_graph(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """Neighbours of each row (padded with -1): a robust-pruned pool of near and random rows, both ways.

    The pruning keeps the nearest candidate again and again and drops those that ALPHA times its distance
    reaches, for all rows at once.
    """
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1, np.int32)
    x = x.astype(np.float32)
    near, some = min(POOL, n - 1), min(8, n - 1)
    pool = np.empty((n, near + some), np.int32)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        pool[a : a + 512, :near] = np.argpartition(-s, near - 1, axis=1)[:, :near]
    own = np.arange(n)
    pool[:, near:] = (own[:, None] + np.random.default_rng(seed).integers(1, n, (n, some))) % n
    kept = np.full((n, DEGREE), -1, np.int32)
    for a in range(0, n, 512):
        rows = np.arange(len(pool[a : a + 512]))
        own_pool = pool[a : a + 512]
        away = np.maximum(2 - 2 * np.matmul(x[own_pool], x[a : a + 512, :, None])[:, :, 0], 0)
        order = np.argsort(away, axis=1, kind="stable")
        own_pool, away = np.take_along_axis(own_pool, order, 1), np.take_along_axis(away, order, 1)
        near_x = x[own_pool]
        between = np.maximum(2 - 2 * np.matmul(near_x, near_x.transpose(0, 2, 1)), 0)
        alive = np.ones(own_pool.shape, bool)
        for r in range(DEGREE):
            first = alive.argmax(axis=1)
            live = alive[rows, first]
            if not live.any():
                break
            kept[a + rows[live], r] = own_pool[rows, first][live]
            alive &= ALPHA * ALPHA * between[rows, first] > away
            alive &= own_pool != own_pool[rows, first][:, None]
    source, slot = np.nonzero(kept >= 0)
    target = kept[source, slot]
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    rank = np.concatenate([slot, slot + DEGREE])
    return _padded(a, b, rank, n, 3 * DEGREE)


def _padded(a: np.ndarray, b: np.ndarray, rank: np.ndarray, n: int, most: int) -> np.ndarray:
    """Distinct neighbours per row, those of small rank first, at most ``most``."""
    code = a.astype(np.int64) * n + b
    order = np.lexsort((rank, code))
    first = np.ones(len(code), bool)
    first[1:] = code[order][1:] != code[order][:-1]
    keep = order[first]
    keep = keep[np.lexsort((rank[keep], a[keep]))]
    a, b = a[keep], b[keep]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    ok = place < most
    out = np.full((n, max(1, int(place[ok].max(initial=0)) + 1)), -1, np.int32)
    out[a[ok], place[ok]] = b[ok]
    return out


def range_search(queries: np.ndarray, x: np.ndarray, graph: np.ndarray, cosine: float, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs with a cosine of at least ``cosine``, among those that the search visits.

    A greedy beam search runs for all queries at once, from the medoid and from the query's ``own`` row (-1: it
    has none), so a group that no path from the medoid reaches still finds itself. Then every visited row near
    enough is expanded, and so on from what that finds, until no new row is near enough. Found pairs are
    verified in double precision.
    """
    n, count = len(x), len(queries)
    q32, x32 = queries.astype(np.float32), x.astype(np.float32)
    medoid = int((x32 @ x32.mean(axis=0)).argmax())
    seen, done = np.zeros((count, n), bool), np.zeros((count, n), bool)
    seen[:, medoid] = True
    ids, sims = np.full((count, beam), medoid, np.int32), np.full((count, beam), -2, np.float32)
    sims[:, 0] = q32 @ x32[medoid]
    own = np.full(count, -1) if own is None else own
    there = np.flatnonzero((own >= 0) & (own != medoid))
    seen[there, own[there]] = True
    ids[there, 1], sims[there, 1] = own[there], np.einsum("nd,nd->n", q32[there], x32[own[there]])
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    near = cosine - _SLACK

    def note(q, r, s):
        ok = s >= near
        if ok.any():
            hits.append((q[ok].astype(np.int32), r[ok].astype(np.int32)))

    note(np.arange(count), np.full(count, medoid), sims[:, 0])
    note(there, own[there], sims[there, 1])
    active = np.arange(count)
    while len(active):
        open_ = np.where(done[active[:, None], ids[active]] | (sims[active] < -1.5), -3, sims[active])
        best = open_.argmax(axis=1)
        go = open_[np.arange(len(active)), best] > -1.5
        active, best = active[go], best[go]
        for a in range(0, len(active), 512):
            rows = active[a : a + 512]
            node = ids[rows, best[a : a + 512]]
            done[rows, node] = True
            found = graph[node]
            fresh = (found >= 0) & ~seen[rows[:, None], np.maximum(found, 0)]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            got, who = found[r, c], rows[r]
            seen[who, got] = True
            s = np.einsum("nd,nd->n", q32[who], x32[got])
            note(who, got, s)
            wide_s, wide_i = np.full(found.shape, -2, np.float32), np.maximum(found, 0)
            wide_s[r, c] = s
            all_s, all_i = np.concatenate([sims[rows], wide_s], axis=1), np.concatenate([ids[rows], wide_i], axis=1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[rows], ids[rows] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
    k = 0
    while k < len(hits):
        q, r = hits[k]
        k += 1
        for a in range(0, len(q), 4096):
            qq, rr = q[a : a + 4096], r[a : a + 4096]
            todo = ~done[qq, rr]
            qq, rr = qq[todo], rr[todo]
            if not len(qq):
                continue
            done[qq, rr] = True
            found = graph[rr]
            i, c = np.nonzero((found >= 0) & ~seen[qq[:, None], np.maximum(found, 0)])
            who, got = qq[i], found[i, c]
            code = np.unique(who.astype(np.int64) * n + got)
            who, got = code // n, code % n
            seen[who, got] = True
            note(who, got, np.einsum("nd,nd->n", q32[who], x32[got]))
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, r = np.concatenate([h[0] for h in hits]).astype(np.int64), np.concatenate([h[1] for h in hits]).astype(np.int64)
    ok = np.concatenate([np.einsum("nd,nd->n", queries[q[a : a + 65536]], x[r[a : a + 65536]]) >= cosine for a in range(0, len(q), 65536)])
    return q[ok], r[ok]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    reps = pdf["rep"].to_numpy()
    graph = robust_graph(unit(_stack(pdf["e"])))
    return pd.DataFrame({"rep": reps, "near": [reps[g[g >= 0]] for g in graph]})


def _search(cosine: float, beam: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        index, query = pdf[pdf["is_index"]], pdf[pdf["is_query"]]
        if not len(index) or not len(query):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        reps = index["rep"].to_numpy()
        sizes = np.array([len(v) for v in index["near"]])
        target = np.concatenate(index["near"].to_list()) if sizes.sum() else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(reps, target), len(reps) - 1)
        ok = reps[at] == target
        source = np.repeat(np.arange(len(reps)), sizes)
        rank = np.arange(len(target)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        graph = _padded(source[ok], at[ok], rank[ok], len(reps), 9 * DEGREE)
        asked = query["rep"].to_numpy()
        place = np.minimum(np.searchsorted(reps, asked), len(reps) - 1)
        q, r = range_search(unit(_stack(query["e"])), unit(_stack(index["e"])), graph, cosine, beam, np.where(reps[place] == asked, place, -1))
        a, b = asked[q], reps[r]
        out = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    return run


def find_pairs(classes: DataFrame, centres: dict[tuple[int, int], np.ndarray], cosine: float = COSINE, beam: int = BEAM, overlap: int = OVERLAP) -> DataFrame:
    """Verified pairs (a, b) of class representatives.

    Vectors go to their ``overlap`` nearest clusters and are searched for in all of them. A cluster that still has
    more than SHARD vectors is hashed into parts; graphs are built over parts, the adjacency lists of a vector are
    united over its parts, and the cluster's queries search every part in blocks, so neither a graph nor a
    block outgrows a task.
    """
    placed, group = place(classes, centres, overlap), GROUP
    parts = placed.groupBy(*group).agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    sized = lookup_parts(placed, parts, group).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    graphs = sized.groupBy(*group, "part").applyInPandas(_build, "rep long, near array<long>")
    near = cut(graphs.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))  # a list for each cluster of the vector
    full = sized.join(near, "rep")
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    as_index = F.transform(each, lambda k: F.struct(F.col("part").alias("p"), k.alias("block"), F.lit(True).alias("is_index"), (k == F.col("part")).alias("is_query")))
    as_query = F.transform(F.filter(each, lambda k: k != F.col("part")), lambda k: F.struct(k.alias("p"), F.col("part").alias("block"), F.lit(False).alias("is_index"), F.lit(True).alias("is_query")))
    roles = full.select(*group, "rep", "e", "near", F.explode(F.concat(as_index, as_query)).alias("r")).select(*group, "rep", "e", "near", "r.*")
    found = roles.groupBy(*group, "p", "block").applyInPandas(_search(cosine, beam), "a long, b long")
    return cut(found.distinct())


def lookup_parts(placed: DataFrame, parts: DataFrame, group: list[str]) -> DataFrame:
    """Join the number of parts of each cluster; only clusters with several parts, a bounded number, are sent."""
    several = parts.where("parts > 1")
    few = several.count() <= 100_000
    return placed.join(F.broadcast(several) if few else several, group, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _brute(sample: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], cosine: float):
    def run(frames):
        for pdf in frames:
            out = []
            for group, own in pdf.groupby(["label", "dim"]):
                if (s := sample.get((int(group[0]), int(group[1])))) is None:
                    continue
                reps = own["rep"].to_numpy()
                q, r = np.nonzero(s[1] @ unit(_stack(own["e"])).T >= cosine)
                keep = s[0][q] != reps[r]
                out.append(pd.DataFrame({"q": s[0][q][keep], "r": reps[r][keep]}))
            if out:
                yield pd.concat(out)

    return run


def audit(classes: DataFrame, pairs: DataFrame, cosine: float = COSINE, queries: int = AUDIT, seed: int = 9) -> float:
    """Recall of hashed sample queries, by comparison with all vectors: the least of the strata's means.

    The recall of a query is the share of its true links that ``pairs`` holds. Queries are averaged within
    strata of equal decimal digits of their number of links, so neither a large group's links nor its many
    queries outweigh what small groups miss.
    """
    total = classes.count()
    drawn = classes.where(F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30)) < min(1.0, queries / max(total, 1)) * (1 << 30)).limit(2 * queries).select("label", "dim", "rep", "e").toPandas()
    sample = {(int(g[0]), int(g[1])): (own["rep"].to_numpy(), unit(_stack(own["e"]))) for g, own in drawn.groupby(["label", "dim"])}
    truth = classes.mapInPandas(_brute(sample, cosine), "q long, r long").select("q", F.least("q", "r").alias("a"), F.greatest("q", "r").alias("b"))
    each = truth.join(pairs.withColumn("hit", F.lit(1)), ["a", "b"], "left").groupBy("q").agg(F.count("*").alias("n"), F.count("hit").alias("found"))
    strata = each.groupBy(F.length(F.col("n").cast("string"))).agg(F.avg(F.col("found") / F.col("n")).alias("recall"))
    least = strata.agg(F.min("recall")).first()[0]
    return 1.0 if least is None else least


def _compare(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["is_left"]], pdf[pdf["is_right"]]
        found = [np.zeros((2, 0), np.int64)]
        if len(left) and len(right):
            x, y = unit(_stack(left["e"])), unit(_stack(right["e"]))
            lrep, rrep = left["rep"].to_numpy(), right["rep"].to_numpy()
            for k in range(0, len(x), 512):
                q, r = np.nonzero(x[k : k + 512] @ y.T >= cosine)
                a, b = lrep[k + q], rrep[r]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b])
        out = np.unique(np.concatenate(found, axis=1), axis=1)
        return pd.DataFrame({"a": out[0], "b": out[1]})

    return run


def exact_pairs(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """All pairs (a, b), by comparing each hashed block of about SHARD vectors of a label with each other one.

    The work is quadratic in the vectors of a label, so this is for what the search can't find.
    """
    group = ["label", "dim"]
    parts = classes.groupBy(*group).agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    sized = lookup_parts(classes, parts, group).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    role = lambda k: F.struct(F.least(k, "part").alias("p"), F.greatest(k, "part").alias("block"), (F.col("part") <= k).alias("is_left"), (F.col("part") >= k).alias("is_right"))
    roles = sized.select(*group, "part", "rep", "e", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k")).select(*group, "rep", "e", role(F.col("k")).alias("r")).select(*group, "rep", "e", "r.*")
    return cut(roles.groupBy(*group, "p", "block").applyInPandas(_compare(cosine), "a long, b long"))


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Direct links and connected groups of vectors of one label with a cosine of at least ``cosine``.

    Equal vectors of a label are one class, so copies are never expanded into pairs; they count in n_links.
    The recall of the search is audited by brute force on sample queries, and below RECALL the search is
    repeated with a wider beam and more overlap. If the last round is below it too, all vectors of a label
    are compared.

    Null labels, and vectors that are null, empty or zero or hold null or non-finite components, link with
    nothing: no links, a component of their own. Vectors of different dimensions aren't compared. Repeated
    rows with one id count as copies of each other. Null ids take part in no class. An empty table gives an
    empty result. Returns vec_id, n_links, component_id, kept.
    """
    rows = cut(pick(vectors, vec_id=id_col, embedding=vector_col, label=label_col).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long")).mapInArrow(_keys, "vec_id long, label long, key binary, e array<double>"))
    total = rows.count()
    good = F.col("key").isNotNull() & F.col("vec_id").isNotNull()
    grouped = cut(rows.where(good).groupBy("key").agg(F.first("label").alias("label"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("e").alias("e")))
    classes = grouped.select("label", F.size("e").alias("dim"), "rep", "copies", "e")
    pairs = None
    centres = fit_clusters(classes)
    for k in range(ROUNDS):
        found = find_pairs(classes, centres, cosine, beam << k, OVERLAP << k)
        pairs = found if pairs is None else cut(pairs.union(found).distinct())
        if audit(classes, pairs, cosine) >= RECALL:
            break
    else:
        pairs = exact_pairs(classes, cosine)
    small = classes.select(F.col("rep").alias("b"), "copies")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(small, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    final = components(pairs)
    table = grouped.select("key", "rep", "copies").join(linked.withColumnRenamed("a", "rep"), "rep", "left").join(final.withColumnRenamed("id", "rep"), "rep", "left")
    table = table.select("key", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = lookup(rows.where(good).select("vec_id", "key"), table, "key", "copies", ["n_links", "component"], "vec_id", total).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = out.union(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7(spark, sf_dir: str) -> DataFrame:
    """``embedding_dedup`` of all embeddings, at a cosine of 0.93."""
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
k AS (SELECT l.vec_id AS a, r.vec_id AS b FROM v l JOIN v r ON l.label = r.label AND l.vec_id <> r.vec_id AND len(l.e) = len(r.e)
  WHERE list_cosine_similarity(l.e, r.e) >= 0.93),
t(id, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT k.b, t.low FROM t JOIN k ON k.a = t.id WHERE t.low < k.b),
m AS (SELECT id, min(low) AS low FROM t GROUP BY id), n AS (SELECT a, count(*) AS n FROM k GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, m.low AS component_id, vec_id = m.low AS kept
FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
