"""From parsed files to graph fragments: rows of nodes and edges tagged with the place of their file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.text import none_if_empty, one_of, only
from srcgraph.schemas import BINDINGS, EDGE_FIELDS, GENERATIONS, HTTP_METHODS, INJECTIONS, MODIFIERS, NODE_FIELDS, STEREOTYPES, TYPE_KINDS

#: A node's place within its file: the type, then fields, then methods, each in their order.
ORIGIN = ["file_ord", "node_ord"]


def _as(rows: DataFrame, fields: dict[str, str], order: list[str], **columns: Column) -> DataFrame:
    return rows.select(*order, *(columns.get(k, F.lit(None)).cast(t).alias(k) for k, t in fields.items()))


def _range(x: Column) -> Column:
    return F.coalesce(x, F.array(F.lit(0), F.lit(0)))


def extraction_mode(x) -> Column:
    return F.when(F.col(x) == "ast", "ast").otherwise("regex_fallback")


def type_nodes(parsed: DataFrame) -> DataFrame:
    """One node per file of a known kind. Unknown literals are dropped, not their rows; empty lists become null
    where the schema has it so."""
    c, kind = F.col, F.col("kind")
    modifiers = F.lit(None).cast("array<string>")
    for name in ("class", "interface", "enum", "annotation_type"):
        modifiers = F.when(kind == name, only("modifiers", MODIFIERS[name])).otherwise(modifiers)
    of = lambda x, *kinds: F.when(kind.isin(*kinds), x)
    return _as(
        parsed.where(kind.isin(*TYPE_KINDS)).withColumn("node_ord", F.lit(0).cast("long")), NODE_FIELDS, ORIGIN,
        id=c("id"), kind=kind, name=c("name"), source_file=c("source_file"), line_range=_range(c("line_range")), modifiers=modifiers,
        annotations=of(none_if_empty("annotations"), "class", "interface", "enum", "record"), implements=of(none_if_empty("implements"), "class", "enum", "record"),
        extends_interfaces=of(none_if_empty("extends_interfaces"), "interface"), extraction_mode=of(extraction_mode("extraction_mode"), "class"),
        stereotype=of(one_of("stereotype", STEREOTYPES), "class"), superclass=of(c("superclass"), "class"), is_inner_class=of(c("is_inner_class"), "class"),
        table_name=of(c("table_name"), "class"), entry_point=of(c("entry_point"), "class"), fqcn_resolved=of(F.coalesce("fqcn_resolved", F.lit(True)), "class"),
        wmc=of(c("wmc"), "class"), cbo=of(c("cbo"), "class"), lcom4=of(c("lcom4"), "class"), constants=of(F.coalesce("constants", F.array()), "enum"),
        components=of(F.coalesce("components", F.array()), "record"), elements=of(none_if_empty("elements"), "annotation_type"),
    )


def field_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'class'").select("file_ord", F.col("id").alias("owner"), F.posexplode("fields").alias("k", "f")).withColumn("node_ord", F.col("k").cast("long") + 1)


def method_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.where(F.col("kind").isin("class", "interface")).select("file_ord", F.col("id").alias("owner"), F.posexplode("methods").alias("k", "m"))
    return rows.withColumn("node_ord", F.col("k").cast("long") + 1_000_000)


def field_nodes(fields: DataFrame) -> DataFrame:
    f = lambda k: F.col("f." + k)
    generation = one_of(F.substring_index(f("generation"), ".", -1), GENERATIONS)
    return _as(fields, NODE_FIELDS, ORIGIN, id=f("id"), kind=F.lit("field"), name=f("name"), type=f("type"), modifiers=only(f("modifiers"), MODIFIERS["field"]), annotations=none_if_empty(f("annotations")), is_autowired=f("is_autowired"), is_id=f("is_id"), generation=generation, column=f("column"), constraints=none_if_empty(f("constraints")))


def parameter(p: Column) -> Column:
    """A parameter as a method's node has it: a binding of unknown kind is no binding, defaults aren't kept."""
    kind = one_of(p["binding"]["kind"], BINDINGS)
    binding = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), p["binding"]["name"].alias("name"), p["binding"]["required"].alias("required")))
    return F.struct(binding.alias("binding"), none_if_empty(p["constraints"]).alias("constraints"), p["name"].alias("name"), p["type"].alias("type"), p["validate"].alias("validate"))


def method_nodes(methods: DataFrame) -> DataFrame:
    m = lambda k: F.col("m." + k)
    verb = one_of(m("http_metadata.method"), HTTP_METHODS)
    http = F.when(verb.isNotNull(), F.struct(verb.alias("method"), F.coalesce(m("http_metadata.path"), F.lit("")).alias("path")))
    same = {k: m(k) for k in ("id", "name", "return_type", "is_constructor", "is_bean_factory", "exception_handler", "response_body", "cyclomatic_complexity", "cognitive_complexity", "method_loc")}
    parameters = F.transform(F.coalesce(m("parameters"), F.array().cast("array<struct<name:string,type:string,validate:boolean,constraints:array<string>,binding:struct<kind:string,name:string,required:boolean,default_value:string>>>")), parameter)
    return _as(methods, NODE_FIELDS, ORIGIN, kind=F.lit("method"), modifiers=only(m("modifiers"), MODIFIERS["method"]), annotations=none_if_empty(m("annotations")), line_range=_range(m("line_range")), parameters=parameters, http_metadata=http, **same)


def module_nodes(modules: DataFrame) -> DataFrame:
    """Nodes of the modules themselves, which edges from them need in order not to dangle; opt-in."""
    rows = modules.withColumns({"file_ord": F.lit(-1).cast("long"), "node_ord": F.col("module_ord").cast("long")})
    return _as(rows, NODE_FIELDS, ORIGIN, id=F.col("module_id"), kind=F.lit("module"), name=F.col("name"), build_tool=F.col("build_tool"), source_roots=F.col("source_roots"), pom_path=F.col("pom_path"))


def nodes(parsed: DataFrame) -> DataFrame:
    return type_nodes(parsed).unionByName(field_nodes(field_rows(parsed))).unionByName(method_nodes(method_rows(parsed)))


EDGE_ORIGIN = ["file_ord", "edge_ord"]


def _edge(rows: DataFrame, ord_: Column, kind: str, source, target, **more: Column) -> DataFrame:
    return _as(rows.withColumn("edge_ord", ord_.cast("long")), EDGE_FIELDS, EDGE_ORIGIN, source=F.col(source), target=F.col(target), kind=F.lit(kind), **more)


def contains_edges(parsed: DataFrame) -> DataFrame:
    types = parsed.where(F.col("kind").isin(*TYPE_KINDS))
    return (
        _edge(types, F.lit(0), "contains", "module_id", "id")
        .unionByName(_edge(field_rows(parsed), 10 * F.col("node_ord"), "contains", "owner", "f.id"))
        .unionByName(_edge(method_rows(parsed), 1000 * F.col("node_ord"), "contains", "owner", "m.id"))
    )


def autowires_edges(parsed: DataFrame) -> DataFrame:
    """From a field to its declared type as written."""
    rows = field_rows(parsed).where("f.is_autowired")
    return _edge(rows, 10 * F.col("node_ord") + 1, "autowires", "f.id", "f.type", injection_type=one_of("f.injection_type", INJECTIONS), qualifier=F.col("f.qualifier"))


def bean_factory_edges(parsed: DataFrame) -> DataFrame:
    """From a factory method to its return type as written."""
    return _edge(method_rows(parsed).where("m.is_bean_factory"), 1000 * F.col("node_ord") + 1, "bean_factory", "m.id", "m.return_type")


def call_edges(parsed: DataFrame) -> DataFrame:
    """Every call of every method, unresolved yet."""
    calls = method_rows(parsed).select("file_ord", "node_ord", F.col("m.id").alias("caller"), F.posexplode("m.calls").alias("n", "call"))
    return _edge(calls, 1000 * F.col("node_ord") + 2 + F.col("n"), "calls_unresolved", "caller", "call", raw_call_expr=F.col("call"))


def edges(parsed: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges of the fragments, of all kinds or some; calls are what resolved ones are made from."""
    found = [of(parsed) for of, kind in ((contains_edges, "contains"), (autowires_edges, "autowires"), (bean_factory_edges, "bean_factory"), (call_edges, "calls")) if not kinds or any(k.startswith(kind) for k in kinds)]
    return reduce(DataFrame.unionByName, found or [contains_edges(parsed).where("false")])
