"""The corpus pipeline: language, exact dedup, near-dedup, mixing and packing, each on all that the last kept.

All stages but the last return the columns that ``docs`` has. Columns are reached by position, so extra
columns, also with names that clash with ours, pass through untouched.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.llm._spark import cut, fresh_dir
from srcgraph.llm._text import chunks
from srcgraph.llm.exact_dedup import exact_dedup, normal_digest
from srcgraph.llm.language import LanguageModel, fit_language, has_letter
from srcgraph.llm.minhash import near_dedup
from srcgraph.llm.mixing import mix
from srcgraph.llm.packing import pack_documents

#: Up to so many decisions (some 50 bytes each) are broadcast to the documents; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Text bytes that Python workers hand back at once.
SLICE_BYTES = 4 << 20


def _plain(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The documents under positional names, and their id and text."""
    plain = docs.toDF(*(f"__c{k}" for k in range(len(docs.columns))))
    return plain, F.col(f"__c{docs.columns.index('doc_id')}"), F.col(f"__c{docs.columns.index('text')}")


def _sized(table: DataFrame) -> DataFrame:
    """A decision table, broadcast when it is small enough; it must be cut already."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _known(model: LanguageModel, at: int):
    def run(batches):
        for batch in batches:
            for i, j, _, _ in chunks(batch.column(at), SLICE_BYTES):
                part = batch.slice(i, j - i)
                if model.languages:
                    best, _ = model.predict(part.column(at))
                    yield part.filter(pa.array(best >= 0))
                else:
                    yield part.filter(pa.array(has_letter(part.column(at))))

    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language: null, empty or without a letter. All others stay, also when none is learnt."""
    plain, _, _ = _plain(docs)
    return plain.mapInArrow(_known(fit_language(docs), docs.columns.index("text")), plain.schema).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the rows with the smallest id (null ids only where a group has no other)."""
    out = exact_dedup(docs)
    gone = cut(out.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest")).distinct())
    plain, doc_id, text = _plain(docs)
    return plain.join(_sized(gone), doc_id.cast("long").eqNullSafe(F.col("__id")) & (normal_digest(text) == F.col("__digest")), "left_anti").toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the document with the smallest id; a repeated id stays if any of its rows does."""
    out = near_dedup(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = cut(out.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id")))
    plain, doc_id, _ = _plain(docs)
    return plain.join(_sized(gone), doc_id.cast("long") == F.col("__id"), "left_anti").toDF(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the sources to their target weights: a document appears once for each time it is taken.

    One that is taken in part appears with its first words, joined by single spaces, and with their length as
    n_chars. One that isn't taken goes. Rows with one id and size share equally what is taken of them.
    """
    rows = cut(mix(docs).groupBy("doc_id", "size").agg(F.expr("sum(taken) DIV count(*)").alias("taken")).where("taken > 0"))
    rows = rows.select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    plain, doc_id, text = _plain(docs)
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    whole, rest = F.expr("__taken DIV __size"), F.col("__taken") % F.col("__size")
    copies = plain.join(_sized(rows), doc_id.eqNullSafe(F.col("__id")) & (size == F.col("__size"))).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), whole + (rest > 0).cast("long"))))
    cut_short = F.col("__copy") > whole
    first = F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), rest.cast("int")), " ")
    out = []
    for k, name in enumerate(docs.columns):
        own = F.col(f"__c{k}")
        if name == "text":
            own = F.when(cut_short, first).otherwise(own)
        elif name == "n_chars":
            own = F.when(cut_short, F.length(first).cast(docs.schema.fields[k].dataType)).otherwise(own)
        out.append(own.alias(f"__o{k}"))
    return copies.select(*out).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; a document that the mix repeats is packed as often."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]

#: Language identification and near-dedup by hashing aren't SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
