"""Sinks: canonical graph, JSON, telemetry, cache, scorecards, manifest, reports and rendered files."""

from __future__ import annotations

import hashlib
import json
import shutil
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.operators import canonical, quality

SCORECARD_VERSION, MANIFEST_VERSION = "1.0.0", "2.0.0"


def prepare(folder: str, force: bool = False, clear: bool = False) -> Path:
    """Output folder. The working folder and those above it are refused, and one with files unless forced."""
    path = Path(folder).resolve()
    here = Path.cwd().resolve()
    if path == here or path in here.parents:
        raise ValueError(f"{path} holds the working folder")
    if path.exists() and any(path.iterdir()):
        if not force:
            raise FileExistsError(f"{path} isn't empty")
        if clear:
            for child in path.iterdir():
                shutil.rmtree(child) if child.is_dir() and not child.is_symlink() else child.unlink()
    path.mkdir(parents=True, exist_ok=True)
    return path


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> dict:
    """graph.json in canonical form, streamed, and its artefact (path, schema_version, sha256)."""
    path, sha = Path(folder) / "graph.json", hashlib.sha256()
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("wb") as out:
        for piece in canonical.canonical(nodes, edges):
            out.write(piece.encode())
            sha.update(piece.encode())
    return {"path": str(path), "schema_version": canonical.SCHEMA_VERSION, "sha256": sha.hexdigest()}


def write_tables(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The graph as Parquet, by kind: what a large corpus is kept in."""
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edges")


def append_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def replace_table(rows: DataFrame, folder: str) -> None:
    """Replace a table that the rows may be read from: written aside first, then swapped."""
    aside = f"{folder}.new"
    rows.write.mode("overwrite").parquet(aside)
    rows.sparkSession.read.parquet(aside).write.mode("overwrite").parquet(folder)


def write_scorecard(checks: DataFrame, folder: str, kind: str, corpus_id: str) -> dict:
    """One scorecard file; checks are a handful of rows."""
    rows = [json.loads(x) for x in checks.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toPandas()["j"]]
    overall = "pass" if all(r["result"] in ("pass", "skip") for r in rows) else "fail"
    path = Path(folder) / "evals" / f"{kind}-scorecard.json"
    path.parent.mkdir(exist_ok=True, parents=True)
    body = json.dumps({"checks": rows, "corpus_id": corpus_id, "kind": kind, "overall": overall, "schema_version": SCORECARD_VERSION}, indent=2, sort_keys=True) + "\n"
    path.write_text(body)
    return {"overall": overall, "path": str(path), "schema_version": SCORECARD_VERSION, "sha256": hashlib.sha256(body.encode()).hexdigest()}


def write_overview(overview: dict, folder: str) -> dict:
    """The overview beside the graph, which stays as it is."""
    path, body = Path(folder) / "overview.json", json.dumps(overview, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    path.write_text(body)
    return {"path": str(path), "schema_version": canonical.SCHEMA_VERSION, "sha256": hashlib.sha256(body.encode()).hexdigest()}


def compile_checks(checks: dict[str, list[str]], folder: str, timeout: float = 120, tail: int = 100, run: bool = True) -> dict:
    """Run the commands that a target declares on a rendering, and write what came of each beside it.

    Without ``run`` all are skipped. A tool that isn't there is skipped before it runs; one that fails or takes too long fails, and those after it
    aren't run, as they build on it.
    """
    rows, failed = [], False
    for name, command in checks.items():
        row = {"check": name, "command": command, "status": "preflight_skip", "output": ""}
        if run and shutil.which(command[0]) and not failed:
            try:
                done = subprocess.run(command, cwd=folder, capture_output=True, text=True, timeout=timeout)
                row |= {"status": "pass" if done.returncode == 0 else "fail", "output": "\n".join((done.stdout + done.stderr).splitlines()[-tail:])}
            except subprocess.TimeoutExpired:
                row |= {"status": "fail", "output": f"more than {timeout:g} seconds"}
            failed = row["status"] == "fail"
        rows.append(row)
    path = Path(folder) / "compile-checks.json"
    path.write_text(json.dumps(rows, indent=2) + "\n")
    return {"path": str(path), "schema_version": SCORECARD_VERSION, "sha256": hashlib.sha256(path.read_bytes()).hexdigest()}


def write_manifest(folder: str, **parts) -> Path:
    """manifest.json, written once at the end of a run."""
    path = Path(folder) / "manifest.json"
    if path.exists() and json.loads(path.read_text()).get("run_id") == parts.get("run_id"):
        raise FileExistsError("the manifest of this run is written already")
    path.write_text(json.dumps({"schema_version": MANIFEST_VERSION, "created_at": datetime.now(UTC).isoformat(timespec="seconds")} | parts, indent=2, sort_keys=True) + "\n")
    return path


def add_to_manifest(folder: str, part: str, entries: dict) -> None:
    path = Path(folder) / "manifest.json"
    doc = json.loads(path.read_text())
    doc.setdefault(part, {}).update(entries)
    path.write_text(json.dumps(doc, indent=2, sort_keys=True) + "\n")


def write_report(checks: DataFrame, markdown: str | None = None, as_json: str | None = None) -> str:
    """Report as Markdown or JSON; returns the overall outcome."""
    aggregated = quality.report(checks)
    overall = quality.report_overall(aggregated).first().overall
    if markdown:
        Path(markdown).write_text(quality.markdown(checks))
    if as_json:
        rows = [r.asDict() for r in aggregated.orderBy("scorecard_kind", "id").collect()]
        Path(as_json).write_text(json.dumps({"overall": overall, "checks": rows}, indent=2) + "\n")
    return overall


def write_files(files: DataFrame, folder: str) -> int:
    """Rendered files (path, content) into a folder; two rows with one path are an error. Streamed one by one."""
    twice = files.groupBy("path").count().where("count > 1").orderBy("path").limit(5).collect()
    if twice:
        raise ValueError(f"written twice: {[r.path for r in twice]}")
    n, base = 0, Path(folder).resolve()
    for row in files.toLocalIterator():
        path = (base / row.path).resolve()
        if base not in path.parents:
            raise ValueError(f"{row.path} leaves the folder")
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(row.content)
        n += 1
    return n
