"""From a source tree to graph, selection and scorecards."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.operators import assemble, build, policy, quality, select

log = logging.getLogger("srcgraph")


def graph_of(parsed: DataFrame, modules: DataFrame | None = None, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed files, with edges of some kinds only if they are named. Building is narrow; only
    dedup and lookups of the assembly shuffle."""
    nodes, edges = build.nodes(parsed), build.edges(parsed, kinds)
    if modules is not None:
        nodes = nodes.unionByName(build.module_nodes(modules))
    return assemble.assemble(parsed, nodes, edges, kinds)


def selection_of(nodes: DataFrame, cap: int = select.CAP, mapping: dict[str, str] | None = None) -> DataFrame:
    """Selected and excluded classes of each domain group."""
    rows = select.renderable(nodes)
    grouped = select.manual_groups(rows, mapping) if mapping else select.prefix_groups(rows)
    return select.selections(select.ladder(grouped, cap), cap)


def decisions_of(nodes: DataFrame, annotations: DataFrame, **policies: str) -> DataFrame:
    """Policy decision of each renderable class, with the return types that its annotation record lists."""
    types = annotations.selectExpr("node_id AS id", "annotation.methods.return_type AS return_types")
    return policy.decide(select.renderable(nodes).join(types, "id", "left"), **policies)


def scorecard_of(nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    return quality.graph_scorecard(nodes, edges, **options)


def sources_of(spark, root: str, corpus: str) -> tuple[DataFrame, DataFrame]:
    """(files, modules) of a folder, without what the corpus' and the modules' own .gitignore leave out."""
    from pathlib import Path

    from srcgraph.session import durable
    from srcgraph.sources import acquire, discover

    modules = durable(discover.modules(acquire.all_paths(spark, root), corpus))
    lines = lambda p: p.read_text().splitlines() if p.exists() else []
    # modules are few: each has a build file of its own
    own = {m.module_id: found for m in modules.where("root <> ''").select("module_id", "root").collect() if (found := lines(Path(root) / m.root / ".gitignore"))}
    return discover.source_files(acquire.local_files(spark, root), modules, lines(Path(root) / ".gitignore"), own), modules


def digests_of(spark, spec: str, corpus: str, times: int = 3) -> list[str | None]:
    """Digest of the graph made afresh ``times`` times, each with another number of shuffle partitions.

    A run that fails has none.
    """
    from srcgraph.operators import canonical, java_scan
    from srcgraph.session import durable, shared_folder
    from srcgraph.sources import acquire

    before, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    for k in range(times):
        try:
            spark.conf.set("spark.sql.shuffle.partitions", str(k + 2))
            with acquire.folder_of(spec, shared=shared_folder(spark)) as root:
                parsed = durable(java_scan.extract(sources_of(spark, root, corpus)[0]))
            out.append(canonical.digest(*graph_of(parsed)))
        except Exception:  # noqa: BLE001 a crash is what this check looks for
            out.append(None)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    return out


class Declined(Exception):
    """The number of calls wasn't agreed to."""


def annotate_run(spark, folder: str, nodes: DataFrame, model, settings, run: str, yes: bool = False, interactive: bool = False, ask=None, cache_folder: str | None = None) -> dict:
    """Annotations, overview, telemetry and cache of one run; returns the manifest's parts.

    Before anything is called, the number of calls has to be agreed to where it is beyond the threshold.
    """
    from srcgraph.operators import annotate, cache, estimate, telemetry
    from srcgraph.session import durable
    from srcgraph.sources import readers, sinks

    asked = durable(annotate.requests(annotate.with_source(annotate.source_nodes(nodes), spark.read.parquet(f"{folder}/files"))))
    calls = asked.count() + 1
    if not estimate.proceed(calls, settings.confirm_threshold, yes, interactive, ask):
        raise Declined(f"{calls} calls")
    stored = readers.cache(spark, cache_folder) if cache_folder else None
    name = settings.models.get("default", "")
    options = {"concurrency": settings.max_concurrent, "max_calls": settings.max_calls, "max_tokens": settings.max_tokens, "model_name": name}
    results = durable(annotate.ask(asked, model, stored, **options))
    sinks.append_json(annotate.telemetry_rows(results, run, "annotate", name), f"{folder}/telemetry")
    if cache_folder:
        from datetime import UTC, datetime

        table = stored if stored is not None else spark.createDataFrame([], readers.CACHE_DDL)
        hit = cache.touch(table, results.where("cache_hit").select("cache_key"), datetime.now(UTC))
        sinks.replace_table(cache.upsert(hit, annotate.cache_entries(results, name, "annotate")), cache_folder)
    # what was answered is kept, but a run that isn't allowed to finish doesn't pretend to
    if over := results.where(F.col("error") == annotate.BEYOND).count():
        raise annotate.CallError(f"{over} of {calls} calls are beyond the ceilings")
    records = durable(annotate.checked(results, settings.max_failure_ratio))
    sinks.write_json(records, f"{folder}/annotations")
    artefacts = {"annotations": {"path": f"{folder}/annotations", "schema_version": "1.0.0"}}
    overview = annotate.synthesise(records, model)
    artefacts["overview"] = sinks.write_overview(overview, folder)
    stats = {r["pass"]: {"calls": r.calls, "hits": r.hits, "hit_rate": r.hit_rate} for r in telemetry.pass_stats(telemetry.read(spark, f"{folder}/telemetry")).collect()}
    return {"artefacts": artefacts, "cache_stats": stats}


def run(spark, spec: str, out: str, name: str | None = None, force: bool = False, evaluate: bool = False, model=None, settings=None, with_modules: bool = False, cache_folder: str | None = None, **gate) -> dict:
    """From a folder, archive or repository to graph.json, its tables and manifest; returns the manifest's parts.

    With a ``model`` the classes are annotated as well, and with ``evaluate`` the graph is scored. Modules become
    nodes ``with_modules``; else edges from them have no node at their source.
    """
    from pathlib import Path

    from srcgraph.functions.keys import run_id
    from srcgraph.logs import to_file
    from srcgraph.operators import java_scan
    from srcgraph.session import shared_folder
    from srcgraph.sources import acquire, readers, sinks

    settings = settings or readers.Settings()
    folder = sinks.prepare(out, force, clear=force)
    this, corpus = run_id(), name or Path(spec).stem
    handler = to_file(f"{folder}/run.log.jsonl", this)
    try:
        with acquire.folder_of(spec, shared=shared_folder(spark)) as root:
            files, modules = sources_of(spark, root, corpus)
            parsed = java_scan.extract(files, settings.timeout_seconds)
            # everything after reads what is written here, not the tree, which may be temporary
            parsed.write.mode("overwrite").parquet(f"{folder}/parsed")
            files.write.mode("overwrite").parquet(f"{folder}/files")
        parsed = spark.read.parquet(f"{folder}/parsed")
        log.info("parsed", extra={"context": {"area": "parser"}})
        nodes, edges = graph_of(parsed, modules if with_modules else None)
        sinks.write_tables(nodes, edges, f"{folder}/tables")
        nodes, edges = (spark.read.schema(df.schema).parquet(f"{folder}/tables/{name}") for name, df in (("nodes", nodes), ("edges", edges)))
        parts = {"run_id": this, "acquisition_source": spec, "corpus_id": corpus, "ast_only": model is None, "artefacts": {"graph": sinks.write_graph(nodes, edges, str(folder))}}
        if model is not None:
            made = annotate_run(spark, str(folder), nodes, model, settings, this, cache_folder=cache_folder, **gate)
            parts["artefacts"] |= made["artefacts"]
            parts["cache_stats"] = made["cache_stats"]
        if evaluate:
            checks = scorecard_of(nodes, edges, digest=parts["artefacts"]["graph"]["sha256"])
            parts["evals"] = {"graph": sinks.write_scorecard(checks, str(folder), "graph", corpus)}
        sinks.write_manifest(str(folder), **parts)
        log.info("finished", extra={"context": {"area": "run"}})
        return parts
    finally:
        log.removeHandler(handler)
        handler.close()


def render(spark, source: str, out: str, model, target: str = "typescript", cap: int = select.CAP, db_layer: str = "typeorm", scaffold: bool = True, force: bool = False, settings=None, check: bool = False) -> dict:
    """Generate code for the selected classes of a run; returns what was made.

    Policies see the return types of the run's annotations, where there are any. Beside the code are the
    selections, what came of the target's checks, and a warning when everything fell into one domain.
    """
    from pathlib import Path

    from srcgraph.operators import render as code
    from srcgraph.session import durable
    from srcgraph.sources import readers, sinks

    settings, goal = settings or readers.Settings(), code.target(target)
    nodes, _ = readers.graph(spark, f"{source}/graph.json")
    nodes = durable(nodes)
    notes = spark.read.schema(readers.ANNOTATIONS_DDL).json(f"{source}/annotations") if (Path(source) / "annotations").exists() else spark.createDataFrame([], readers.ANNOTATIONS_DDL)
    decided = durable(decisions_of(nodes, notes, security=settings.security_policy, webflux=settings.webflux_policy))
    chosen = durable(selection_of(nodes, cap, settings.domain_mapping or None))
    picked = chosen.select("group_name", F.explode("selected").alias("id"))
    made = durable(code.generate(code.requests(picked, nodes, decided, goal).withColumn("input", F.concat("input", F.lit(f"\n\nDatabase layer: {db_layer}"))), model))
    folder = str(sinks.prepare(out, force, clear=force))
    count = sinks.write_files(code.files(made, goal, "app", scaffold), folder)
    state = picked.join(decided.select("id", "decision", "stub"), "id", "left").groupBy("group_name").agg(
        *(F.collect_list(F.when(ok, F.col("id"))).alias(n) for n, ok in (("selected", F.col("decision") == "render"), ("refused", F.col("decision") == "refuse"), ("stub_todos", (F.col("decision") == "render") & F.coalesce("stub", F.lit(False)))))
    )
    sinks.write_json(state, f"{folder}/selections")
    one = quality.collapsed(made.where("content IS NOT NULL").select("path")).first()
    if one.collapsed:
        log.warning("all %d files are in one domain", one.files)
    result = {"files": count, "failed": made.where("error IS NOT NULL").count(), "collapsed": one.collapsed, "compile": sinks.compile_checks(goal.checks, folder, run=check)}
    if (Path(source) / "manifest.json").exists():
        sinks.add_to_manifest(source, "renders", {target: {"path": folder, "schema_version": "1.0.0", "sha256": result["compile"]["sha256"]}})
    return result
