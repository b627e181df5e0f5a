"""Connected components: of the methods of each class (LCOM4), and of graphs of any size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.session import durable


def callee_name(call) -> Column:
    """Name right before the first parenthesis of a call."""
    return F.trim(F.substring_index(F.substring_index(call, "(", 1), ".", -1))


def spread(edges: DataFrame, vertices: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges(a, b)``, for every vertex.

    Labels go to neighbours and then jump to their label's label, so the rounds grow with the logarithm of the
    longest path. Each round is cut by a checkpoint in the folder that executors share.
    """
    both = durable(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = durable(vertices.select("id", F.col("id").alias("component")).distinct())
    for _ in range(rounds):
        offered = both.join(label, both["a"] == label["id"]).groupBy(F.col("b").alias("id")).agg(F.min("component").alias("low"))
        near = label.join(offered, "id", "left").select("id", F.least("component", F.coalesce("low", "component")).alias("component"), F.col("component").alias("was"))
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = durable(near.join(jump, "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component"), "was"))
        moved = new.where("component <> was").limit(1).count()
        label = new.drop("was")
        if not moved:
            return label
    raise RuntimeError(f"components not closed after {rounds} rounds")


def method_links(methods: DataFrame) -> DataFrame:
    """(class_id, a, b): methods of one class that share a field or of which one names the other.

    ``methods(class_id, name, accessed_fields, callees)``. A field links its methods to the first of them
    rather than all to each other, which leaves the components as they are.
    """
    uses = methods.select("class_id", "m", F.explode("accessed_fields").alias("field"))
    first = uses.groupBy("class_id", "field").agg(F.min("m").alias("a"), F.max("m").alias("last")).where("a <> last").drop("last")
    shared = uses.join(first, ["class_id", "field"]).where("m <> a").select("class_id", "a", F.col("m").alias("b"))
    calls = methods.select("class_id", F.col("m").alias("a"), F.explode("callees").alias("name"))
    named = calls.join(methods.select("class_id", "name", F.col("m").alias("b")), ["class_id", "name"]).where("a <> b").select("class_id", "a", "b")
    return shared.union(named).distinct()


#: A class with up to so many distinct methods, and names of fields and callees in them, is closed by one
#: union-find, which holds them all in a worker; larger ones go through ``spread``.
MOST_METHODS = 5000
MOST_NAMES = 100_000


def _union_find(pdf: pd.DataFrame) -> pd.DataFrame:
    root = list(range(len(pdf)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first: dict[str, int] = {}
    by_name: dict[str, list[int]] = {}
    for k, name in enumerate(pdf["name"]):
        by_name.setdefault(name, []).append(k)
    for k, (fields, callees) in enumerate(zip(pdf["accessed_fields"], pdf["callees"], strict=True)):
        for f in fields:
            root[find(k)] = find(first.setdefault(f, k))
        for other in {x for c in callees for x in by_name.get(c, [])}:
            root[find(k)] = find(other)
    return pd.DataFrame({"class_id": pdf["class_id"].head(1), "found": len({find(k) for k in range(len(pdf))})})


def class_components(methods: DataFrame) -> DataFrame:
    """(class_id, methods, components) over the given, non-static methods; a class without any has no row.

    Methods of a class that are alike in name, fields and callees are one vertex that counts as often as they
    are there. Such overloads are in one component if they share a field or name each other, or another
    method joins them; else each is a component of its own. Null names, fields and callees count as none.
    """
    empty = F.array().cast("array<string>")
    tidy = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, empty)))).alias(c)
    alike = methods.select("class_id", F.coalesce("name", F.lit("")).alias("name"), tidy("accessed_fields"), tidy("callees")).groupBy("class_id", "name", "accessed_fields", "callees").agg(F.count("*").alias("n"))
    alike = alike.withColumn("m", F.struct("class_id", F.xxhash64("name", "accessed_fields", "callees").alias("h"), "name"))
    sizes = alike.groupBy("class_id").agg(F.sum("n").alias("methods"), F.count("*").alias("vertices"), F.sum(F.size("accessed_fields") + F.size("callees")).alias("names"))
    fits = (F.col("vertices") <= MOST_METHODS) & (F.col("names") <= MOST_NAMES)
    called = alike.select("class_id", F.explode("callees").alias("name"), F.col("m").alias("by")).groupBy("class_id", "name").agg(F.count_distinct("by").alias("callers"))
    named = alike.select("class_id", F.col("name").alias("callee")).distinct()
    calling = alike.select("class_id", "m", F.explode("callees").alias("callee")).join(named, ["class_id", "callee"]).select("m").distinct().withColumn("calls", F.lit(True))
    apart = alike.where("n > 1 AND size(accessed_fields) = 0").join(called, ["class_id", "name"], "left").join(calling, "m", "left").where("callers IS NULL AND calls IS NULL")
    extra = apart.groupBy("class_id").agg(F.sum(F.col("n") - 1).alias("extra"))
    small = alike.join(sizes.where(fits).select("class_id"), "class_id", "left_semi")
    kind = methods.schema["class_id"].dataType.simpleString()
    found = small.select("class_id", "name", "accessed_fields", "callees").groupBy("class_id").applyInPandas(_union_find, f"class_id {kind}, found long")
    large = alike.join(sizes.where(~fits).select("class_id"), "class_id", "left_semi")
    if not large.isEmpty():
        low = spread(method_links(large).select("a", "b"), large.select(F.col("m").alias("id")))
        found = found.union(low.select("id.class_id", "component").groupBy("class_id").agg(F.count_distinct("component")))
    both = sizes.join(found, "class_id").join(extra, "class_id", "left")
    return both.select("class_id", "methods", (F.col("found") + F.coalesce("extra", F.lit(0))).alias("components"))


def lcom4(parsed: DataFrame) -> DataFrame:
    """(id, lcom4) of classes with non-static methods, from the members that the parser found."""
    empty = F.array().cast("array<string>")
    m = parsed.where("kind = 'class'").select("id", F.posexplode("methods").alias("k", "m")).where(~F.array_contains(F.coalesce("m.modifiers", empty), "static"))
    rows = m.select(F.col("id").alias("class_id"), F.col("m.name").alias("name"), F.coalesce("m.accessed_fields", empty).alias("accessed_fields"), F.transform(F.coalesce("m.calls", empty), callee_name).alias("callees"), "k")
    links = method_links(rows.withColumn("m", F.struct("class_id", "k"))).select("a", "b")
    low = spread(links, rows.select(F.struct("class_id", "k").alias("id")))
    return low.groupBy(F.col("id.class_id").alias("id")).agg(F.count_distinct("component").cast("int").alias("lcom4"))
