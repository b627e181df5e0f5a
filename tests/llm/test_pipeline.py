"""The pipeline against a brute-force version of its stages."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from srcgraph.llm import language

from .test_llm import PATH, SF, check_packing, near_brute, norm, words_of


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage, with repeated, null and clashing extras in the input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "12 34"), (9004, "Only here once"), (None, "no id for this one"), (9005, "Only  here\nonce")], "doc_id long, text string")
    docs = docs.unionByName(odd.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})).withColumn("kept", F.lit("x")).withColumn("score", F.lit(1))
    docs = docs.toDF(*docs.columns[:-1], "DOC_ID").persist()
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).persist())
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1]) and all(df.dtypes == stages[0].dtypes for df in stages[:-1])


def test_language_keeps_all_with_letters(stages):
    assert Counter(rows(stages[1])) == Counter(r for r in rows(stages[0]) if any(map(str.isalpha, r[1] or "")))


def test_exact(stages):
    before = rows(stages[1])
    low = {}
    for r in before:
        if r[0] is not None:
            low[norm(r[1])] = min(r[0], low.get(norm(r[1]), r[0]))
    assert Counter(rows(stages[2])) == Counter(r for r in before if low.get(norm(r[1])) == r[0])


def test_near(stages):
    before = rows(stages[2])
    kept = {i for i, _, _, ok in near_brute([(r[0], r[1]) for r in before]) if ok}
    assert Counter(rows(stages[3])) == Counter(r for r in before if r[0] is None or r[0] in kept)


def test_mixing(stages):
    before, after = rows(stages[3]), rows(stages[4])
    total = sum(len(words_of(r[1])) for r in before)
    assert abs(sum(len(words_of(r[1])) for r in after) - total) <= len({r[3] for r in before}) * 2
    whole = {r[0]: r for r in before}
    for r in after:
        own = whole[r[0]]
        assert r == own or (words_of(own[1])[: len(words_of(r[1]))] == words_of(r[1]) and r[4] == len(r[1]))
    assert max(Counter(r[0] for r in after).values()) <= 4


def test_packing(stages):
    used, usual = check_packing(stages[5].collect(), [(r[0], r[1]) for r in rows(stages[4])])
    assert used <= usual


def test_run_is_the_stages(spark, stages, tmp_path):
    """run() on real rows gives what its stages give, one after the other."""
    spark.read.parquet(f"{SF}/documents.parquet").limit(80).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    used, usual = check_packing(pipeline.run(spark, str(tmp_path)).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= usual


def test_repeated_rows_share_the_mix(spark):
    """Rows with one id and size don't overshoot what is taken of them."""
    rows = [(7, f"{k} " + "word " * 40, "a") for k in range(10)] + [(k + 100, "other words here " * 30, "b") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    out = pipeline.mixing(spark, docs, SF).collect()
    taken = sum(len(words_of(r.text)) for r in out if r.doc_id == 7)
    from srcgraph.llm.mixing import mix

    want = sum(r.taken for r in mix(docs).collect() if r.doc_id == 7)
    assert want - 10 < taken <= want


def test_run_on_nothing(spark, stages, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_unlabelled_corpus_stays(spark, stages, tmp_path):
    """Without any label no language is learnt, and still only texts without a letter go."""
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    plain = plain.withColumn("lang", F.lit(None).cast("string")).limit(60)
    plain = plain.unionByName(plain.limit(1).withColumns({"doc_id": F.lit(9003).cast("long"), "text": F.lit("12 34")})).persist()
    got = Counter(rows(pipeline.language(spark, plain, SF)))
    want = Counter(r for r in rows(plain) if any(map(str.isalpha, r[1] or "")))
    assert got == want and sum(want.values()) > 50 and 9003 not in {r[0] for r in got}
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() > 0


def test_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is pipeline.run and len(pipeline.STAGES) == 5
    assert sum(name.startswith("op") for name in __spark_entry__.queries()) == 10
    assert PATH and language.UNKNOWN == "und"
