"""Corpus-wide assembly: first-wins dedup, import-aware resolution of types and calls, derived edges.

Every lookup is an equi-join and every "first" an explicit ordinal, so results don't depend on partitioning.
Lookups are merge joins: the planner's sizes come from the tables that the rows began as, which may be a
hundredth of what was parsed from them, and a side that is broadcast by them can be more than the driver holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from srcgraph.functions.text import after_last, called_method, callee, element_type, starts_upper
from srcgraph.schemas import CARDINALITY, EDGE_FIELDS


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. The minimum of (order, row) is partially aggregated, so a key that holds most
    rows doesn't meet in one task, as it would in a window."""
    rest = [c for c in rows.columns if c not in key]
    ahead = [*order, *(c for c in rest if c not in order)]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*ahead), F.struct(*order)).alias("__first"))
    return first.select(*(c if c in key else F.col("__first")[c].alias(c) for c in rows.columns))


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    return first_wins(nodes, ["id"], ["file_ord", "node_ord"])


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Distinct by kind, source, target and cardinality, where two nulls are equal."""
    return first_wins(edges, ["kind", "source", "target", "cardinality"], ["file_ord", "edge_ord"])


def import_map(parsed: DataFrame) -> DataFrame:
    """(id, simple, fqcn): what a simple name means in a file; of several imports the last counts."""
    rows = parsed.select("id", "file_ord", F.posexplode("imports").alias("k", "fqcn")).withColumn("simple", after_last("fqcn"))
    return rows.groupBy("id", "simple").agg(F.max_by("fqcn", F.struct("file_ord", "k")).alias("fqcn"))


def _imported(rows: DataFrame, imports: DataFrame, owner: str, simple: str) -> DataFrame:
    """Left-join the imported name of column ``simple`` in the file of ``owner`` as ``imported``."""
    table = imports.select(F.col("id").alias(owner), F.col("simple").alias(simple), F.col("fqcn").alias("imported"))
    return rows.join(table.hint("merge"), [owner, simple], "left")


def in_corpus(candidates: DataFrame, ids: DataFrame, column: str = "target") -> DataFrame:
    return candidates.join(ids.select(F.col("id").alias(column)).distinct().hint("merge"), column, "left_semi")


def _edges(rows: DataFrame, kind: str, **more: Column) -> DataFrame:
    columns = {"source": F.col("source"), "target": F.col("target"), "kind": F.lit(kind)} | more
    return rows.select("file_ord", "edge_ord", *(columns.get(k, F.lit(None)).cast(t).alias(k) for k, t in EDGE_FIELDS.items()))


#: Derived edges come after all edges of the fragments.
_AFTER = 1 << 60


def depends_on(parsed: DataFrame, ids: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct corpus types that a type's imports, fields, methods, parameters and supertypes name."""
    method = parsed.select("id", "file_ord", F.explode("methods").alias("m"))
    simple = (
        parsed.select("id", "file_ord", F.explode("fields.type").alias("name"))
        .union(method.select("id", "file_ord", F.col("m.return_type").alias("name")))
        .union(method.select("id", "file_ord", F.explode("m.parameters.type").alias("name")))
    )
    empty = F.array().cast("array<string>")
    above = parsed.select("id", "file_ord", F.explode(F.concat(F.filter(F.array("superclass"), lambda x: x.isNotNull()), F.coalesce("implements", empty), F.coalesce("extends_interfaces", empty))).alias("name"))
    named = _imported(simple.distinct().withColumn("own", F.lit(False)).union(above.withColumn("own", F.lit(True))), imports, "id", "name")
    target = F.coalesce("imported", F.when(F.col("own"), F.col("name")))
    found = parsed.select("id", "file_ord", F.explode("imports").alias("target")).union(named.select("id", "file_ord", target.alias("target")))
    pairs = found.where("target IS NOT NULL AND target <> '' AND target <> id").groupBy("id", "target").agg(F.min("file_ord").alias("file_ord"))
    return _edges(in_corpus(pairs, ids).withColumns({"source": F.col("id"), "edge_ord": F.lit(_AFTER)}), "depends_on")


def cardinality(annotations) -> Column:
    """Of the first relationship annotation, in the order they are written."""
    first = F.get(F.filter(annotations, lambda a: a.isin(*CARDINALITY)), 0)
    out = F.lit(None).cast("string")
    for name, value in CARDINALITY.items():
        out = F.when(first == name, value).otherwise(out)
    return out


def relations(parsed: DataFrame, ids: DataFrame, imports: DataFrame) -> DataFrame:
    """Entity relations from annotated fields to what their type holds."""
    rows = parsed.select("id", "file_ord", F.posexplode("fields").alias("k", "f"))
    rows = rows.select("id", "file_ord", "k", element_type("f.type").alias("name"), cardinality(F.col("f.annotations")).alias("cardinality")).where("cardinality IS NOT NULL")
    found = _imported(rows, imports, "id", "name").where("imported IS NOT NULL").withColumnRenamed("imported", "target")
    first = in_corpus(found, ids).groupBy("id", "target", "cardinality").agg(F.min(F.struct("file_ord", "k")).alias("o"))
    return _edges(first.select(F.col("id").alias("source"), "target", "cardinality", "o.file_ord", (F.lit(_AFTER) + 1 + F.col("o.k")).alias("edge_ord")), "relation", cardinality=F.col("cardinality"))


def resolve_calls(calls: DataFrame, fields: DataFrame, parameters: DataFrame | None, methods: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls with their targets: one row per overload, or one with a null target where none is known.

    ``calls(source, raw_call_expr, ..)``, ``fields(owner, name, type, ord)``, ``parameters(method, name, type, ord)``,
    ``methods(owner, name, method)``, ``imports(id, simple, fqcn)``. The owner of a call is its own type, a
    capitalised name by import, a field's type, or a parameter's type, in this order; a field whose type isn't
    imported ends the search, which is why this is a CASE and not a coalesce. Without parameters they are None,
    which saves a shuffle of the calls.
    """
    first_field = fields.groupBy(F.col("owner"), F.col("name").alias("var")).agg(F.min_by("type", "ord").alias("field_type"))
    rows = calls.withColumns({"owner": F.substring_index("source", "#", 1), "var": callee("raw_call_expr"), "called": called_method("raw_call_expr")})
    rows = rows.join(first_field.hint("merge"), ["owner", "var"], "left")
    simple = F.when(starts_upper("var"), F.col("var")).when(F.col("field_type").isNotNull(), F.col("field_type"))
    if parameters is not None:
        first_parameter = parameters.groupBy(F.col("method").alias("source"), F.col("name").alias("var")).agg(F.min_by("type", "ord").alias("parameter_type"))
        rows = rows.join(first_parameter.hint("merge"), ["source", "var"], "left")
        simple = simple.otherwise(F.col("parameter_type"))
    rows = _imported(rows.withColumn("simple_type", simple), imports, "owner", "simple_type")
    rows = rows.withColumn("callee_type", F.when(F.col("var").isNull(), F.col("owner")).otherwise(F.col("imported")))
    known = methods.select(F.col("owner").alias("callee_type"), F.col("name").alias("called"), F.col("method").alias("resolved")).distinct()
    return rows.join(known.hint("merge"), ["callee_type", "called"], "left").select(*calls.columns, "resolved")


def promote_calls(edges: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges in which every resolvable call has become one edge per target method."""
    calls = edges.where("kind = 'calls_unresolved'")
    expr = F.coalesce("raw_call_expr", "target")
    member = lambda kind: nodes.where(F.col("kind") == kind)
    place = F.struct("file_ord", "node_ord")
    fields = member("field").select(F.regexp_replace("id", r"(?s)\.[^.]*$", "").alias("owner"), "name", "type", place.alias("ord"))
    parameters = member("method").select(F.col("id").alias("method"), F.posexplode("parameters").alias("ord", "p")).select("method", "p.name", "p.type", "ord")
    methods = member("method").select(F.substring_index("id", "#", 1).alias("owner"), "name", F.col("id").alias("method"))
    found = resolve_calls(calls.withColumn("raw_call_expr", expr), fields, parameters, methods, imports)
    resolved = found.where("resolved IS NOT NULL").select("file_ord", "edge_ord", "source", F.col("resolved").alias("target"))
    unresolved = found.where("resolved IS NULL").select(*edges.columns)
    return edges.where("kind <> 'calls_unresolved'").unionByName(unresolved).unionByName(_edges(resolved.withColumn("edge_ord", F.col("edge_ord") + 2 * _AFTER), "calls_resolved"))


def assemble(parsed: DataFrame, nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the whole corpus from the fragments of its files.

    With ``kinds`` only those edges are made, and lookups that no other kind needs: a filter on the kind afterwards
    doesn't save them, as the planner keeps joins of rows that come out of an empty list.
    """
    imports = import_map(parsed)
    wanted = lambda *own: not kinds or any(k in kinds for k in own)
    if wanted("depends_on"):
        edges = edges.unionByName(depends_on(parsed, nodes, imports))
    if wanted("relation"):
        edges = edges.unionByName(relations(parsed, nodes, imports))
    if wanted("calls_resolved", "calls_unresolved"):
        edges = promote_calls(edges, nodes, imports)
    return dedup_nodes(nodes), dedup_edges(edges.where(F.col("kind").isin(kinds)) if kinds else edges)
