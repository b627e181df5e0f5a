"""Class metrics as aggregates over members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.text import without_generics
from srcgraph.schemas import UNCOUPLED


def weighted(methods: DataFrame) -> DataFrame:
    """WMC: the summed cyclomatic complexity; a type without methods has no row, hence a null."""
    return methods.groupBy("id").agg(F.count("*").alias("methods"), F.sum("cyclomatic_complexity").alias("wmc"))


def coupling(types: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """CBO: distinct outer names of the declared types, without those that tell nothing."""
    rows = types.select("id", without_generics("type").alias("name")).where("name <> ''")
    return rows.where(~F.col("name").isin(*(sorted(UNCOUPLED) if excluded is None else excluded))).groupBy("id").agg(F.count_distinct("name").alias("cbo"))


def declared_types(parsed: DataFrame) -> DataFrame:
    """(id, type) of fields, method returns and parameters, constructors' included."""
    m = parsed.select("id", F.explode("methods").alias("m"))
    return (
        parsed.select("id", F.explode("fields.type").alias("type"))
        .union(m.where(~F.col("m.is_constructor")).select("id", "m.return_type"))
        .union(m.select("id", F.explode("m.parameters.type")))
    )
