"""Checks of a graph, verdicts, scorecards and reports across corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.schemas import EDGE_KINDS, NODE_KINDS, THRESHOLD, TYPE_KINDS

GRAPH_CHECKS = ["reproducibility", "schema_validity", "structural_completeness", "relationship_correctness", "internal_consistency", "golden_graph_agreement", "semantic_accuracy"]
CODE_CHECKS = ["compile", "coverage", "llm_judge"]
DECLARATIONS = [*TYPE_KINDS, "method", "field"]


def threshold(kind: str, expected: bool | None = None, pass_at: float | None = None, fail_at: float | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(expected).cast("boolean").alias("expected"), F.lit(pass_at).cast("double").alias("pass_at"), F.lit(fail_at).cast("double").alias("fail_at"))


def verdict(value, limit, reason=None) -> Column:
    """pass, fail or skip of a value under a threshold struct.

    Without a value, or with a stated reason to skip, it is a skip; between two bounds too (see ``in_band``).
    """
    v, t = (F.col(x) if isinstance(x, str) else x for x in (value, limit))
    high, low = v >= t["pass_at"], v <= t["pass_at"]
    ratio = F.when(high, "pass").when(v < F.coalesce(t["fail_at"], t["pass_at"]), "fail").otherwise("skip")
    count = F.when(low, "pass").when(v > F.coalesce(t["fail_at"], t["pass_at"]), "fail").otherwise("skip")
    score = F.when(F.coalesce(high, F.lit(False)), "pass").when(F.coalesce(v < t["fail_at"], F.lit(False)), "fail").otherwise("skip")
    out = F.when(t["kind"] == "boolean", F.when((v != 0) == t["expected"], "pass").otherwise("fail")).when(t["kind"] == "min_ratio", ratio).when(t["kind"] == "max_count", count).otherwise(score)
    skipped = v.isNull()
    if reason is not None:
        skipped = skipped | F.col(reason).isNotNull()
    return F.when(skipped, "skip").otherwise(out)


def in_band(value, result) -> Column:
    """Why a check with a value was skipped: it lies between the bounds."""
    return F.when(F.col(value).isNotNull() & (F.col(result) == "skip"), "band_gap")


def _row(df: DataFrame, check: str, category: str, limit: Column, *details: str) -> DataFrame:
    rows = df.select(F.lit(check).alias("id"), F.lit(category).alias("category"), F.col("value").cast("double"), limit.cast(THRESHOLD).alias("threshold"), F.to_json(F.struct(*details) if details else F.struct(F.lit(None).alias("none"))).alias("details"))
    return rows.withColumn("result", verdict("value", "threshold"))


def completeness(nodes: DataFrame) -> DataFrame:
    """Share of declarations extracted from syntax trees; those that state no mode count as such."""
    own = nodes.where(F.col("kind").isin(*DECLARATIONS))
    tree = F.count_if(F.coalesce("extraction_mode", F.lit("ast")) == "ast")
    return own.agg(F.count("*").alias("total_nodes"), tree.alias("ast_nodes")).withColumn("value", F.coalesce(F.try_divide("ast_nodes", "total_nodes"), F.lit(1.0)))


def relationship(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of resolved calls with both ends in the graph; other edges are counted only."""
    ids = nodes.select("id").distinct()
    calls = edges.where("kind = 'calls_resolved'").select("source", "target")
    known = calls.join(ids.withColumnRenamed("id", "source").withColumn("s", F.lit(1)), "source", "left").join(ids.withColumnRenamed("id", "target").withColumn("t", F.lit(1)), "target", "left")
    good = known.agg(F.count_if(F.col("s").isNotNull() & F.col("t").isNotNull()).alias("resolved_call_edges"), F.count_if(F.col("s").isNull() | F.col("t").isNull()).alias("broken_resolved_call_edges"))
    every = edges.agg(F.count("*").alias("total_edges"), F.count_if(F.col("kind") == "calls_unresolved").alias("unresolved_call_edges"))
    both = every.crossJoin(F.broadcast(good))  # one row each
    return both.withColumn("value", F.coalesce(F.try_divide("resolved_call_edges", F.col("resolved_call_edges") + F.col("broken_resolved_call_edges")), F.lit(1.0)))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, subject): one row per broken invariant, and per extra row of an id within its kind."""
    extra = nodes.groupBy("kind", "id").count().where("count > 1").select(F.lit("duplicate_id").alias("rule"), F.explode(F.array_repeat("id", F.col("count").cast("int") - 1)).alias("subject"))
    bare = nodes.where("kind = 'class' AND instr(id, '.') = 0").select(F.lit("class_without_package"), "id")
    types = nodes.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("parent")).distinct()
    orphan = nodes.where("kind = 'method'").withColumn("parent", F.substring_index("id", "#", 1)).join(types, "parent", "left_anti").select(F.lit("method_without_type"), "id")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    open_ = edges.where((F.col("kind") == "calls_unresolved") & (blank("source") | blank("target"))).select(F.lit("call_without_end"), F.concat_ws(" -> ", F.coalesce("source", F.lit("")), F.coalesce("target", F.lit(""))))
    return extra.union(bare).union(orphan).union(open_)


_REQUIRED = {"class": ["name", "source_file", "line_range", "extraction_mode", "modifiers"], "interface": ["name", "source_file", "line_range", "modifiers"], "enum": ["name", "modifiers", "constants"], "record": ["name", "components"], "annotation_type": ["name", "modifiers"], "method": ["name", "return_type", "modifiers", "parameters", "is_constructor", "line_range"], "field": ["name", "type", "modifiers"], "module": ["name", "build_tool"]}


def schema_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, subject) of rows that the graph schema doesn't allow."""
    known = lambda df, kinds, key: df.where(F.col("kind").isNull() | ~F.col("kind").isin(*kinds)).select(F.lit("unknown_kind").alias("rule"), F.col(key).alias("subject"))
    missing = F.lit(None).cast("string")
    for kind, names in _REQUIRED.items():
        for name in names:
            if name in nodes.columns:
                missing = F.when((F.col("kind") == kind) & F.col(name).isNull(), f"{kind}.{name}").otherwise(missing)
    out = known(nodes, NODE_KINDS, "id").union(known(edges, EDGE_KINDS, "source"))
    out = out.union(nodes.where("id IS NULL OR id = ''").select(F.lit("empty_id"), "name")).union(nodes.withColumn("__m", missing).where("__m IS NOT NULL").select(F.concat(F.lit("missing "), "__m"), "id"))
    if "line_range" in nodes.columns:
        out = out.union(nodes.where("line_range IS NOT NULL AND size(line_range) <> 2").select(F.lit("line_range"), "id"))
    return out.union(nodes.where("kind = 'module' AND NOT id RLIKE '^mod:.+'").select(F.lit("module_id"), "id"))


def schema_validity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return schema_errors(nodes, edges).agg((F.count("*") == 0).cast("double").alias("value"), F.count("*").alias("errors"), F.min(F.concat_ws(": ", "rule", "subject")).alias("first_error"))


def agreement(spark, digest: str, golden: str | None) -> DataFrame:
    """Equality with a golden digest; no value, hence a skip, when there is none."""
    return spark.createDataFrame([(None if golden is None else float(digest == golden), digest, golden)], "value double, digest string, golden string")


def reproducibility(spark, digests: list[str | None]) -> DataFrame:
    """Whether all runs gave one digest; a run that crashed (None) fails."""
    return spark.createDataFrame([(float(None not in digests and len(set(digests)) == 1), len(digests), len(set(digests)))], "value double, runs int, distinct_digests int")


def compile_rate(results: DataFrame) -> DataFrame:
    """Of ``results(check, status)`` the share passed; those skipped before they ran don't count, and if all
    were there is no value."""
    counts = results.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "preflight_skip").alias("skipped"), F.count_if(F.col("status") == "pass").alias("passed"))
    return counts.withColumn("value", F.when((F.col("total") > 0) & (F.col("skipped") == F.col("total")), F.lit(None)).otherwise(F.coalesce(F.try_divide("passed", F.col("total") - F.col("skipped")), F.lit(1.0))))


def coverage(selections: DataFrame) -> DataFrame:
    """Selected members that aren't stubs, of those selected or refused."""
    size = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0)))
    sums = selections.agg(size("selected").alias("selected"), size("refused").alias("refused_count"), size("stub_todos").alias("stub_todo_count"), F.count("*").alias("groups"))
    return sums.withColumn("value", F.when(F.col("selected") + F.col("refused_count") > 0, F.greatest(F.lit(0.0), F.try_divide(F.col("selected") - F.col("stub_todo_count"), F.col("selected") + F.col("refused_count")))))


def limits() -> dict[str, Column]:
    """Thresholds by check. Columns need a running session, so they are made on demand."""
    ratio, exact = threshold("min_ratio", pass_at=1.0), threshold("boolean", True)
    return {
        "structural_completeness": ratio, "relationship_correctness": ratio, "compile": ratio, "internal_consistency": threshold("max_count", pass_at=0.0), "coverage": threshold("min_ratio", pass_at=0.95, fail_at=0.85),
        "schema_validity": exact, "golden_graph_agreement": exact, "reproducibility": exact, "semantic_accuracy": threshold("score_band"), "llm_judge": threshold("score_band"),
    }


def code_scorecard(spark, results: DataFrame | None, selections: DataFrame | None, include: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """All checks of generated code as rows; what there is nothing to check of, or isn't asked for, is a skip row."""
    limit = limits()
    none = lambda: spark.createDataFrame([(None,)], "value double")
    found = {"compile": lambda: none() if results is None else compile_rate(results), "coverage": lambda: none() if selections is None else coverage(selections), "llm_judge": none}
    rows = None
    for check in CODE_CHECKS:
        df = found[check]() if (check in include if include else check not in (skip or [])) else none()
        own = _row(df, check, "code", limit[check], *(c for c in df.columns if c != "value"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def graph_scorecard(nodes: DataFrame, edges: DataFrame, digest: str | None = None, golden: str | None = None, digests: list[str | None] | None = None, include: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """All graph checks as rows. An include list beats a skip list, and a check that isn't run is a skip row."""
    spark, limit = nodes.sparkSession, limits()
    none = lambda: spark.createDataFrame([(None,)], "value double")
    found = {
        "reproducibility": lambda: reproducibility(spark, digests) if digests else none(),
        "schema_validity": lambda: schema_validity(nodes, edges),
        "structural_completeness": lambda: completeness(nodes),
        "relationship_correctness": lambda: relationship(nodes, edges),
        "internal_consistency": lambda: violations(nodes, edges).agg(F.count("*").alias("value"), F.min(F.concat_ws(": ", "rule", "subject")).alias("first_violation")),
        "golden_graph_agreement": lambda: agreement(spark, digest or "", golden),
        "semantic_accuracy": none,
    }
    active = [c for c in GRAPH_CHECKS if (c in include if include else c not in (skip or []))]
    rows = None
    for check in GRAPH_CHECKS:
        df = found[check]() if check in active else none()
        own = _row(df, check, "graph", limit[check], *(c for c in df.columns if c != "value"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def overall(checks: DataFrame, by: list[str]) -> DataFrame:
    """pass when every check passed or was skipped."""
    return checks.groupBy(*by).agg(F.when(F.bool_and(F.col("result").isin("pass", "skip")), "pass").otherwise("fail").alias("overall"))


def report(checks: DataFrame) -> DataFrame:
    """Each check across corpora: its outcome and the aggregate that suits its threshold, unrounded.

    A failure anywhere fails the check, else a pass passes it. Skips have no part in means and sums but count
    in totals.
    """
    ran = (F.col("result") != "skip") & F.col("value").isNotNull()
    kind = F.col("threshold_kind")
    number = F.when(ran, F.col("value"))
    rows = checks.withColumn("threshold_kind", F.col("threshold.kind")).groupBy("scorecard_kind", "id").agg(
        F.min("category").alias("category"), F.min("threshold_kind").alias("threshold_kind"), F.count("*").alias("n"), F.count_if(F.col("result") == "pass").alias("passes"),
        F.when(F.bool_or(F.col("result") == "fail"), "fail").when(F.bool_or(F.col("result") == "pass"), "pass").otherwise("skip").alias("overall_result"),
        F.avg(number).alias("m"), F.min(number).alias("lo"), F.max(number).alias("hi"), F.sum(number).alias("s"),
    )
    of = lambda name, column: F.when(kind == name, F.col(column))
    return rows.select("scorecard_kind", "id", "category", "threshold_kind", "overall_result", of("boolean", "passes").alias("pass_count"), of("boolean", "n").alias("total"), of("min_ratio", "m").alias("mean"), of("min_ratio", "lo").alias("min"), F.when(kind.isin("min_ratio", "max_count"), F.col("hi")).alias("max"), of("max_count", "s").alias("sum"))


def report_overall(aggregated: DataFrame) -> DataFrame:
    """mixed when some checks fail and others pass; only skips, or nothing at all, is a pass."""
    failed, passed = (F.coalesce(F.bool_or(F.col("overall_result") == x), F.lit(False)) for x in ("fail", "pass"))
    return aggregated.agg(F.when(failed & passed, "mixed").when(failed, "fail").otherwise("pass").alias("overall"))


def per_corpus(checks: DataFrame) -> DataFrame:
    """Every check id of a kind against every corpus of it; a missing one has nulls."""
    ids = checks.select("scorecard_kind", "id").distinct()
    corpora = checks.select("scorecard_kind", "corpus_id").distinct()
    return ids.join(corpora, "scorecard_kind").join(checks.select("scorecard_kind", "id", "corpus_id", "result", "value"), ["scorecard_kind", "id", "corpus_id"], "left")


_MARK = {"pass": "PASS", "fail": "FAIL", "skip": "SKIP", "mixed": "MIXED"}


def markdown(checks: DataFrame) -> str:
    """Report as tables, one per scorecard kind with a column per corpus. Checks times corpora are few."""
    aggregated = report(checks)
    out = [f"# Evaluation\n\nOverall: {_MARK[report_overall(aggregated).first().overall]}\n"]
    cells = {(r.scorecard_kind, r.id, r.corpus_id): r for r in per_corpus(checks).collect()}
    rows = aggregated.orderBy("scorecard_kind", "id").collect()
    table_row = lambda values: f"| {' | '.join(values)} |"
    for kind in sorted({r.scorecard_kind for r in rows}):
        corpora = sorted({k[2] for k in cells if k[0] == kind})
        out += [f"## {kind}\n", table_row(["Check", *corpora, "Aggregate"]), table_row(["---"] * (len(corpora) + 2))]
        for r in (r for r in rows if r.scorecard_kind == kind):
            shown = [("-" if (c := cells[kind, r.id, x]).result is None else _MARK[c.result] + (f" ({c.value:g})" if c.value is not None else "")) for x in corpora]
            total = {"boolean": f"{r.pass_count}/{r.total} pass", "min_ratio": "N/A" if r["mean"] is None else f"mean {r['mean']:.4g}", "max_count": "N/A" if r["sum"] is None else f"sum {r['sum']:g}"}.get(r.threshold_kind, "")
            out.append(table_row([r.id, *shown, f"{_MARK[r.overall_result]} {total}".strip()]))
        out.append("")
    return "\n".join(out)


def collapsed(paths: DataFrame) -> DataFrame:
    """Whether generated files all fell into one domain: a warning when more than five do."""
    from srcgraph.functions.text import domain_dir

    rows = paths.select(domain_dir("path").alias("d"), F.col("path").endswith(".ts").alias("ts"))
    return rows.agg(F.count_distinct("d").alias("domains"), F.count_if("ts").alias("files")).withColumn("collapsed", (F.col("domains") == 1) & (F.col("files") > 5))
