"""Command line: run, render, eval and cache."""

from __future__ import annotations

import argparse
import logging
import sys
from datetime import UTC, datetime

from srcgraph.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("srcgraph")
    p.add_argument("--version", action="version", version="srcgraph 0.1")
    p.add_argument("--log-level", choices=["debug", "info", "warning", "error"])
    loud = p.add_mutually_exclusive_group()
    loud.add_argument("-v", "--verbose", action="store_true")
    loud.add_argument("-q", "--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    run = sub.add_parser("run", help="build the graph of a source tree")
    run.add_argument("input")
    run.add_argument("--out", required=True)
    for flag in ("--ast-only", "--force", "--eval", "--yes", "--non-interactive"):
        run.add_argument(flag, action="store_true")
    run.add_argument("--max-llm-calls", type=int)
    run.add_argument("--max-tokens-total", type=int)
    run.add_argument("--llm-call-confirm-threshold", type=int)
    run.add_argument("--settings", help="TOML, YAML or JSON file")
    run.add_argument("--cache", help="folder of the response cache")
    run.add_argument("--modules", action="store_true", help="make nodes of the modules too")

    render = sub.add_parser("render", help="select classes and generate code")
    render.add_argument("--from", dest="source")
    render.add_argument("--out")
    render.add_argument("--target", default="typescript")
    render.add_argument("--db-layer", choices=["typeorm", "prisma"], default="typeorm")
    number = {"type": int, "default": 3}
    render.add_argument("--max-classes-per-domain", **number)
    render.add_argument("--settings", help="TOML, YAML or JSON file")
    for flag in ("--force", "--no-scaffold", "--list-targets", "--compile"):
        render.add_argument(flag, action="store_true")

    ev = sub.add_parser("eval", help="score graphs").add_subparsers(dest="action", required=True)
    one = ev.add_parser("run")
    one.add_argument("folder")
    one.add_argument("--scorecard", action="append", choices=["graph", "code"], help="graph if none is given")
    one.add_argument("--golden", help="graph.json to agree with")
    one.add_argument("--rendered", help="folder of the generated code")
    which = one.add_mutually_exclusive_group()
    which.add_argument("--check", action="append")
    which.add_argument("--skip-check", action="append")
    many = ev.add_parser("report")
    many.add_argument("folders", nargs="+")
    form = many.add_mutually_exclusive_group()
    form.add_argument("--output-md")
    form.add_argument("--output-json")

    cache = sub.add_parser("cache", help="inspect the response cache").add_subparsers(dest="action", required=True)
    cache.add_parser("stats").add_argument("folder")
    purge = cache.add_parser("purge")
    purge.add_argument("folder")
    purge.add_argument("--older-than", type=int)
    purge.add_argument("--prompt-version")
    purge.add_argument("--model")
    purge.add_argument("--all", action="store_true")
    purge.add_argument("--force", action="store_true")
    report = cache.add_parser("report")
    report.add_argument("folder")
    report.add_argument("--since", type=int, default=30)
    return p


def _settings(a, **given):
    from srcgraph.sources import readers

    return readers.Settings.load(a.settings, dotenv=".env", **given)


def _run(spark, a, model=None) -> int:
    from srcgraph.operators.annotate import CallError
    from srcgraph.plans.pipeline import Declined, run

    settings = _settings(a, max_calls=a.max_llm_calls, max_tokens=a.max_tokens_total, confirm_threshold=a.llm_call_confirm_threshold)
    if a.ast_only:
        model = None
    elif model is None:
        print("no model given: the graph only", file=sys.stderr)
    question = lambda text: input(f"{text} [y/N] ").strip().lower() == "y"
    gate = {"yes": a.yes, "interactive": not a.non_interactive and sys.stdin.isatty(), "ask": question}
    try:
        parts = run(spark, a.input, a.out, force=a.force, evaluate=a.eval, model=model, settings=settings, with_modules=a.modules, cache_folder=a.cache, **gate)
    except (Declined, CallError) as e:
        print(f"stopped: {e}", file=sys.stderr)
        return 1
    print(f"graph {parts['artefacts']['graph']['sha256']}")
    return int(any(x["overall"] == "fail" for x in parts.get("evals", {}).values()))


def _render(spark, a, model=None) -> int:
    from srcgraph.operators import render
    from srcgraph.plans import pipeline

    if "typescript" not in render.targets():
        render.register(render.nest())
    if a.list_targets:
        print("\n".join(render.targets()))
        return 0
    if model is None:
        print("render needs a model; call srcgraph.cli.main with one", file=sys.stderr)
        return 2
    made = pipeline.render(spark, a.source, a.out, model, a.target, a.max_classes_per_domain, a.db_layer, not a.no_scaffold, a.force, _settings(a), a.compile)
    print(f"{made['files']} files, {made['failed']} failed" + ", all in one domain" * made["collapsed"])
    return int(made["failed"] > 0)


def _eval(spark, a) -> int:
    import hashlib
    import json
    from pathlib import Path

    from srcgraph.operators import quality
    from srcgraph.plans.pipeline import digests_of, scorecard_of
    from srcgraph.sources import readers, sinks

    if a.action == "report":
        folders = [f"{f}/evals" for f in a.folders if (Path(f) / "evals").exists()]
        if not folders:
            print("Overall: PASS")
            return 0
        checks = readers.scorecards(spark, folders)
        overall = sinks.write_report(checks, a.output_md, a.output_json)
        print(f"Overall: {overall.upper()}")
        return int(overall != "pass")
    folder, written = Path(a.folder), {}
    manifest = json.loads((folder / "manifest.json").read_text()) if (folder / "manifest.json").exists() else {}
    asked = a.scorecard or ["graph"]
    sha = lambda path: hashlib.sha256(Path(path).read_bytes()).hexdigest()
    if "graph" in asked:
        if not (folder / "graph.json").exists():
            print(f"no graph in {a.folder}", file=sys.stderr)
            return 2
        nodes, edges = readers.graph(spark, f"{a.folder}/graph.json")
        wanted = "reproducibility" in a.check if a.check else "reproducibility" not in (a.skip_check or [])
        source = manifest.get("acquisition_source")
        digests = digests_of(spark, source, manifest.get("corpus_id") or folder.name) if wanted and source else None
        checks = scorecard_of(nodes, edges, digest=sha(folder / "graph.json"), golden=sha(a.golden) if a.golden else None, digests=digests, include=a.check, skip=a.skip_check)
        written["graph"] = sinks.write_scorecard(checks, a.folder, "graph", folder.name)
    if "code" in asked:
        code = Path(a.rendered or next((x["path"] for x in manifest.get("renders", {}).values()), a.folder))
        results = spark.read.schema("`check` STRING, status STRING").option("multiLine", "true").json(str(code / "compile-checks.json")) if (code / "compile-checks.json").exists() else None
        chosen = spark.read.schema("group_name STRING, selected ARRAY<STRING>, refused ARRAY<STRING>, stub_todos ARRAY<STRING>").json(str(code / "selections")) if (code / "selections").exists() else None
        written["code"] = sinks.write_scorecard(quality.code_scorecard(spark, results, chosen, a.check, a.skip_check), a.folder, "code", folder.name)
    if manifest:
        sinks.add_to_manifest(a.folder, "evals", written)
    overall = "fail" if any(x["overall"] == "fail" for x in written.values()) else "pass"
    print(f"Overall: {overall.upper()}")
    return int(overall == "fail")


def _cache(spark, a) -> int:
    from srcgraph.operators import cache, telemetry
    from srcgraph.sources import sinks

    if a.action == "report":
        from pyspark.sql import functions as F

        rows = telemetry.recent(telemetry.read(spark, a.folder), F.lit(datetime.now(UTC)), a.since)
        telemetry.totals(rows).show(truncate=False)
        telemetry.weekly(rows).orderBy("week").show(1000, truncate=False)
        counts = telemetry.by_prompt(rows)
        telemetry.top(counts, "hits", "first_hit", "prompt").show(truncate=False)
        telemetry.top(counts, "misses", "first_miss", "prompt").show(truncate=False)
        return 0
    table = spark.read.parquet(a.folder)
    if a.action == "stats":
        cache.stats(table).show(truncate=False)
        return 0
    if not (a.all or a.older_than is not None or a.prompt_version or a.model):
        print("say what to purge, or --all", file=sys.stderr)
        return 2
    kept, gone = cache.purge(table, datetime.now(UTC), a.older_than, a.model, a.prompt_version)
    n = gone.count()
    if not a.force and input(f"Remove {n} entries? [y/N] ").lower() != "y":
        return 1
    sinks.replace_table(kept, a.folder)
    print(f"{n} entries removed")
    return 0


def main(args: list[str] | None = None, model=None) -> int:
    a = parser().parse_args(args)
    level = a.log_level or ("debug" if a.verbose else "error" if a.quiet else "info")
    logging.basicConfig(level=level.upper())
    logging.getLogger("srcgraph").setLevel(level.upper())
    spark = session()
    if a.command in ("run", "render"):
        return {"run": _run, "render": _render}[a.command](spark, a, model)
    return {"eval": _eval, "cache": _cache}[a.command](spark, a)


if __name__ == "__main__":
    raise SystemExit(main())
