"""Grouping of classes and selection within a budget per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from srcgraph.functions.text import group_after, package_of
from srcgraph.schemas import RENDERABLE
from srcgraph.session import durable

CAP, HIGH_CBO, HIGH_WMC, LOW_CBO, LOW_WMC = 3, 5, 20, 1, 5


def renderable(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind").isin(*RENDERABLE))


def common_prefix(packages: DataFrame, column: str = "package") -> DataFrame:
    """One row with the common prefix of all dotted names, by whole segments.

    The only name of a one-row table loses its last segment. Counts per position are aggregated, so no name
    list is gathered.
    """
    rows = packages.select(F.split(column, r"\.").alias("s"))
    total = rows.agg(F.count("*").alias("n"), F.max(F.size("s")).alias("longest"))
    at = rows.select(F.posexplode("s").alias("k", "part")).groupBy("k").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("c"))
    joined = at.crossJoin(F.broadcast(total))  # one row
    same = (F.col("low") == F.col("high")) & (F.col("c") == F.col("n")) & ((F.col("n") > 1) | (F.col("k") < F.col("longest") - 1))
    parts = joined.select(F.struct("k", same.alias("same"), F.col("low").alias("part")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))  # one element per depth
    stop = F.get(F.filter("xs", lambda x: ~x["same"]), 0)["k"]
    kept = F.filter("xs", lambda x: stop.isNull() | (x["k"] < stop))
    return parts.select(F.array_join(F.transform(kept, lambda x: x["part"]), ".").alias("prefix"))


def prefix_groups(rows: DataFrame, fqcn: str = "id") -> DataFrame:
    """Add ``group_name``: the first package segment after the prefix that all rows share, or misc."""
    named = rows.withColumn("__package", package_of(fqcn))
    prefix = common_prefix(named.select(F.col("__package").alias("package")))
    return named.crossJoin(F.broadcast(prefix)).withColumn("group_name", group_after("__package", F.length("prefix"))).drop("__package", "prefix")  # one row


def manual_groups(rows: DataFrame, mapping: dict[str, str], fqcn: str = "id") -> DataFrame:
    """Add ``group_name``: of the longest given package prefix, or misc. The mapping is configuration and becomes one expression."""
    package, out = package_of(fqcn), F.lit("misc")
    for prefix, label in sorted(mapping.items(), key=lambda kv: (len(kv[0]), kv[0])):
        out = F.when((package == prefix) | F.startswith(package, F.lit(prefix + ".")), label).otherwise(out)
    return rows.withColumn("group_name", out)


def longest_prefix(rows: DataFrame, prefixes: DataFrame, text: str, deepest: int = 16) -> DataFrame:
    """Longest match against a table ``prefixes(prefix, label)`` of any size, as an equi-join.

    A row looks up each of its own dotted ancestors, at most ``deepest``, instead of being compared with every
    prefix; a deeper name is an error.
    """
    parts = F.split(text, r"\.")
    checked = F.when(F.size(parts) > deepest, F.raise_error(F.lit(f"more than {deepest} segments"))).otherwise(F.size(parts))
    tries = F.transform(F.sequence(F.lit(1), checked), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    found = rows.select("*", F.explode(tries).alias("prefix")).join(prefixes, "prefix").groupBy(text).agg(F.max_by("label", F.length("prefix")).alias("group_name"))
    return rows.join(found, text, "left").withColumn("group_name", F.coalesce("group_name", F.lit("misc")))


def bucket(cbo: Column, wmc: Column) -> Column:
    known = cbo.isNotNull() & wmc.isNotNull()
    return F.when(known & ((cbo >= HIGH_CBO) | (wmc >= HIGH_WMC)), "high").when(known & (cbo <= LOW_CBO) & (wmc <= LOW_WMC), "low").otherwise("mid")


#: The largest group that a window may hold in one task.
MOST_IN_WINDOW = 1_000_000


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str, largest: int) -> DataFrame:
    """Add the place of each row in its group, from 1, in ascending order.

    Where a group is too large for one task, rows are range-partitioned by group and order, so it spans many
    tasks; each numbers its own stretch, and the lengths of the stretches before are added.
    """
    if largest <= MOST_IN_WINDOW:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    own = [f"__o{k}" for k in range(len(order))]
    plain = rows.withColumns(dict(zip(own, order, strict=True)))
    parts = durable(plain.repartitionByRange(*keys, *own).withColumn("__p", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy(*keys, "__p").agg(F.count("*").alias("__c")).select(*keys, "__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    joined = parts.join(shift, [*keys, "__p"])
    place = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*own)) + F.col("__before")
    return joined.withColumn(name, place.cast("int")).drop("__p", "__before", *own)


def ladder(members: DataFrame, cap: int = CAP, group: str = "group_name", order: str = "id") -> DataFrame:
    """Mark what each group keeps within its cap.

    Up to ``cap`` members all stay; below twice that the largest by WMC; else one after the other from the
    high, mid and low buckets, each by WMC. Null WMC comes last, ties go by ``order``; members without a group
    are left out. Adds strategy, bucket,
    rank (place in the selection order of the group) and selected.
    """
    # nulls last and large first, as an ascending pair
    wmc = [F.col("wmc").isNull(), -F.col("wmc")]
    sizes = members.groupBy(group).agg(F.count("*").alias("__n"))
    largest = sizes.agg(F.max("__n")).first()[0] or 0
    rows = members.join(sizes, group).withColumn("__b", bucket(F.col("cbo"), F.col("wmc")))
    strategy = F.when(F.col("__n") <= cap, "take_all").when(F.col("__n") < 2 * cap, "top_n_v1").otherwise("stratified_threshold_v1")
    place = F.when(F.col("__b") == "high", 0).when(F.col("__b") == "mid", 1).otherwise(2)
    rows = ranked(rows.withColumn("strategy", strategy), [group, "__b"], [*wmc, F.col(order)], "__turn", largest)
    mixed, all_ = F.col("strategy") == "stratified_threshold_v1", F.col("strategy") == "take_all"
    by = [F.when(mixed, F.col("__turn")).otherwise(0), F.when(mixed, place).otherwise(0), *(F.when(~all_, x) for x in wmc), F.col(order)]
    rows = ranked(rows, [group], by, "rank", largest)
    return rows.withColumns({"bucket": F.col("__b"), "selected": F.col("rank") <= cap}).drop("__n", "__b", "__turn")


def selections(marked: DataFrame, cap: int = CAP, group: str = "group_name", id_: str = "id") -> DataFrame:
    """One row per group. Excluded members keep the WMC order for the middle tier, else the original one."""
    stratified = F.col("strategy") == "stratified_threshold_v1"
    chosen = lambda yes, by: F.transform(F.array_sort(F.collect_list(F.when(F.col("selected") == yes, F.struct(by.alias("o"), F.col(id_).alias("id"))))), lambda x: x["id"])
    later = F.when(stratified, F.struct(F.lit(0).alias("k"), F.col(id_).alias("i"))).otherwise(F.struct(F.col("rank").alias("k"), F.col(id_).alias("i")))
    return marked.groupBy(group).agg(
        F.first("strategy").alias("strategy"), F.lit(cap).alias("cap"), F.count("*").alias("total_in_group"),
        F.count_if(F.col("cbo").isNull() | F.col("wmc").isNull()).alias("metrics_missing_count"), F.count_if(stratified & (F.col("bucket") == "high")).alias("high_count"),
        chosen(True, F.col("rank")).alias("selected"), chosen(False, later).alias("excluded"),
    )


def with_policies(selected: DataFrame, decisions: DataFrame, group: str = "group_name", id_: str = "id") -> DataFrame:
    """Per group the members that policies refuse or turn into stubs, and the policies that were active."""
    rows = decisions.groupBy(group).agg(
        F.array_sort(F.collect_list(F.when(F.col("decision") == "refuse", F.col(id_)))).alias("refused"),
        F.array_sort(F.collect_list(F.when(F.col("stub"), F.col(id_)))).alias("stub_todos"),
        F.array_sort(F.collect_set("reason")).alias("feature_policies_active"),
    )
    empty = F.array().cast("array<string>")
    return selected.join(rows, group, "left").withColumns({c: F.coalesce(c, empty) for c in ("refused", "stub_todos", "feature_policies_active")})
