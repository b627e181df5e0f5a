"""Canonical JSON of a graph and its digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.schemas import EDGE_KINDS, NODE_KINDS

SCHEMA_VERSION = "1.0.0"
UNORDERED = set("annotations constants constraints extends_interfaces implements modifiers".split())


def tidy(array) -> Column:
    """Sorted, without nulls."""
    return F.array_sort(F.filter(array, lambda x: x.isNotNull()))


def _value(name: str) -> Column:
    x = F.col(name)
    if name in UNORDERED:
        x = tidy(x)
    elif name == "parameters":
        x = F.transform(x, lambda p: F.struct(p["binding"].alias("binding"), tidy(p["constraints"]).alias("constraints"), p["name"].alias("name"), p["type"].alias("type"), p["validate"].alias("validate_")))
    elif name == "column":
        x = F.when(x.isNotNull(), F.struct(x["length"].alias("length"), x["name"].alias("name"), x["nullable"].alias("nullable")))
    return x.alias(name)


def _json(kinds: dict[str, list[str]]) -> Column:
    """JSON of a row by its kind: keys sorted at every level, nulls kept."""
    out = F.lit(None).cast("string")
    for kind, names in kinds.items():
        body = F.to_json(F.struct(*(_value(k) for k in sorted([*names, "kind"]))), {"ignoreNullFields": "false"})
        out = F.when(F.col("kind") == kind, body).otherwise(out)
    return out


def node_lines(nodes: DataFrame) -> DataFrame:
    """(id, line), to be ordered by id."""
    return nodes.select("id", _json(NODE_KINDS).alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """Edges as JSON, to be ordered by kind, source, target and, for ties, their origin."""
    return edges.select("kind", "source", "target", "file_ord", "edge_ord", _json(EDGE_KINDS).alias("line"))


def canonical(nodes: DataFrame, edges: DataFrame) -> Iterator[str]:
    """The document in pieces. Rows are sorted by Spark and streamed partition by partition; the driver never
    holds more than one partition."""
    yield '{"edges":['
    for k, row in enumerate(edge_lines(edges).orderBy("kind", "source", "target", "file_ord", "edge_ord").select("line").toLocalIterator()):
        yield ("," if k else "") + row.line
    yield '],"nodes":['
    for k, row in enumerate(node_lines(nodes).orderBy("id").select("line").toLocalIterator()):
        yield ("," if k else "") + row.line
    yield '],"projectOverview":null}\n'


def digest(nodes: DataFrame, edges: DataFrame) -> str:
    sha = hashlib.sha256()
    for piece in canonical(nodes, edges):
        sha.update(piece.encode())
    return sha.hexdigest()


def block_digest(lines: DataFrame, keys: list[str], blocks: int = 64) -> DataFrame:
    """Distributed fingerprint of a table of lines: per hashed block the count and a sum over line digests that
    doesn't depend on order. Two tables with equal rows agree whatever their partitioning."""
    part = F.conv(F.substring(F.sha2("line", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return lines.groupBy(F.pmod(F.crc32(F.concat_ws("\0", *keys)), F.lit(blocks)).alias("block")).agg(F.count("*").alias("n"), F.sum(part).alias("digest"))
