import json
from datetime import UTC, date, datetime
from zipfile import ZipFile

import pytest
from pyspark.sql import functions as F

from srcgraph import cli
from srcgraph.operators import annotate, cache, estimate, policy, render, telemetry
from srcgraph.schemas import CACHE_DDL, FILES_DDL
from srcgraph.sources import acquire, discover, ignore, readers, sinks
from srcgraph.streaming import telemetry as stream


@pytest.mark.parametrize(
    "pattern, path, hit",
    [
        ("target/", "a/target/x.java", True), ("target/", "target", False), ("*.iml", "a/b.iml", True), ("/out", "out/x", True), ("/out", "a/out", False), ("a/*.java", "a/b.java", True), ("a/*.java", "a/b/c.java", False),
        ("**/gen/", "x/y/gen/z", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("*.py[cod]", "x.pyc", True), ("*.py[!c]", "x.pyc", False), ("foo/**", "foo/x/y", True), ("# note", "# note", False), ("\\#x", "#x", True), ("d?g", "dog", True),
    ],
)
def test_ignore_patterns(spark, pattern, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(ignore.ignored("p", [pattern])).first()[0] is hit


def test_last_pattern_wins(spark):
    df = spark.createDataFrame([("a.log",), ("keep.log",)], "p string")
    assert [r[0] for r in df.select(ignore.ignored("p", ["*.log", "!keep.log"])).collect()] == [True, False]


@pytest.fixture
def tree(tmp_path):
    files = {
        "pom.xml": "<p/>", "core/pom.xml": "<p/>", "core/build.gradle": "x", "web/build.gradle.kts": "x", "target/pom.xml": "<p/>", ".gitignore": "Skip.java\n",
        "core/src/main/java/p/A.java": "package p;\nimport p.B;\npublic class A {\n    private B b;\n    void go() { b.run(); }\n}\n", "core/src/main/java/p/B.java": "package p;\npublic class B {\n    void run() { }\n}\n",
        "core/src/main/java/p/Skip.java": "class Skip { }", "core/target/src/main/java/p/T.java": "class T { }", "web/src/test/java/q/W é.java": "package q; interface W { }", "web/src/main/kotlin/K.kt": "x",
    }
    for name, body in files.items():
        path = tmp_path / "repo" / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(body)
    return tmp_path / "repo"


def test_discovery(spark, tree):
    found = discover.modules(acquire.all_paths(spark, str(tree)), "repo")
    rows = {r.module_id: r for r in found.collect()}
    assert set(rows) == {"mod:repo", "mod:core", "mod:web"} and rows["mod:core"].build_tool == "maven" and rows["mod:web"].build_tool == "gradle" and rows["mod:repo"].module_ord == 0
    files = discover.source_files(acquire.local_files(spark, str(tree)), found, ["Skip.java"]).orderBy("file_ord").collect()
    assert [(r.module_id, r.path.rsplit("/", 1)[-1]) for r in files] == [("mod:core", "A.java"), ("mod:core", "B.java"), ("mod:web", "W é.java")]


def test_zip(spark, tree, tmp_path):
    with ZipFile(tmp_path / "r.zip", "w") as z:
        for p in tree.rglob("*.java"):
            z.write(p, p.relative_to(tree))
    assert acquire.zip_files(spark, str(tmp_path / "r.zip")).count() == 5
    with ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x.java", "class X { }")
    with pytest.raises(ValueError), acquire.folder_of(str(tmp_path / "bad.zip")):
        pass
    with acquire.folder_of("https://host/r", clone=lambda url, to: (tmp_path / "seen").write_text(to)) as folder:
        assert (tmp_path / "seen").read_text() == folder


def test_command_line(spark, tree, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert cli.main(["run", str(tree), "--out", out, "--eval"]) == 0
    doc = json.loads((tmp_path / "out/graph.json").read_text())
    assert {n["id"] for n in doc["nodes"] if n["kind"] in ("class", "interface")} == {"p.A", "p.B", "q.W"}
    assert [(e["source"], e["target"]) for e in doc["edges"] if e["kind"] == "calls_resolved"] == [("p.A#go()", "p.B#run()")]
    nodes, edges = readers.graph(spark, f"{out}/graph.json")
    assert nodes.count() == len(doc["nodes"]) and edges.count() == len(doc["edges"])
    with pytest.raises(FileExistsError):
        cli.main(["run", str(tree), "--out", out])
    assert cli.main(["eval", "run", out, "--check", "schema_validity"]) == 0
    assert cli.main(["eval", "run", str(tmp_path / "nowhere")]) == 2
    assert cli.main(["eval", "report", out, "--output-md", str(tmp_path / "r.md")]) == 0 and "schema_validity" in (tmp_path / "r.md").read_text()
    assert cli.main(["render", "--list-targets"]) == 0
    model = lambda xs: [f"// {len(x)}" for x in xs]
    assert cli.main(["render", "--from", out, "--out", str(tmp_path / "ts")], model) == 0
    assert sorted(p.name for p in (tmp_path / "ts/src").rglob("*.ts") if "module" not in p.name) == ["a.ts", "b.ts", "main.ts", "w.ts"]
    with pytest.raises(ValueError):
        sinks.prepare(".")


def test_telemetry(spark, tmp_path):
    rows = [{"ts": f"2024-01-0{d}T10:00:00Z", "purpose": p, "cache_hit": h, "prompt_id": "a", "prompt_version": "v1", "cost_usd_est": 0.5} for d, p, h in ((1, "annotate", True), (2, "annotate", False), (8, "synthesize", True), (9, "other", False))]
    path = tmp_path / "t"
    path.mkdir()
    (path / "run.jsonl").write_text("\n".join([json.dumps(r) for r in rows] + ["", "{broken", json.dumps({"ts": "soon"}), json.dumps({"purpose": "annotate"})]))
    df = telemetry.read(spark, str(path)).persist()
    assert df.count() == 4
    assert {r["pass"]: (r.calls, r.hits, r.hit_rate) for r in telemetry.pass_stats(df).collect()} == {"pass_1": (2, 1, 0.5), "pass_2": (1, 1, 1.0)}
    t = telemetry.totals(df).first()
    assert (t.total_calls, t.cache_hits, t.cost_saved, t.cost_incurred, t.hit_rate) == (4, 2, 1.0, 1.0, 50.0)
    weeks = {str(r.week): (r.calls, r.hits) for r in telemetry.weekly(df).collect()}
    assert weeks == {"2024-01-01": (2, 1), "2024-01-08": (2, 1)}
    assert telemetry.recent(df, F.lit("2024-01-10").cast("timestamp"), 5).count() == 2
    with pytest.raises(Exception):
        telemetry.read(spark, str(path), strict=True).count()
    q = stream.weekly(stream.read(spark, str(path))).writeStream.format("memory").queryName("weekly_test").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {str(r.week): (r.calls, r.hits) for r in spark.table("weekly_test").collect()} == weeks


def test_ceiling(spark):
    df = spark.createDataFrame([("r", k, 10) for k in range(5)], "run_id string, seq int, tokens int")
    assert [r.allowed for r in telemetry.ceiling(df, max_calls=4, max_tokens=35).orderBy("seq").collect()] == [True, True, True, False, False]


def entry(key, version, model, day=1):
    row = dict.fromkeys([x.split()[0] for x in CACHE_DDL.split(", ")])
    return tuple((row | {"cache_key": key, "prompt_version": version, "model": model, "created_at": datetime(2024, 1, day), "hit_count": 0, "input_body": "i", "output_body": f"o{day}"}).values())


def test_cache(spark):
    table = spark.createDataFrame([entry("a", "v1", "m"), entry("b", "v2", "gpt-4o"), entry("c", "v2", "m")], CACHE_DDL)
    kept, gone = cache.purge(table, prompt_version="v1")
    assert (kept.count(), gone.count()) == (2, 1)
    assert [x.count() for x in cache.purge(kept, model="gpt-4o")] == [1, 1]
    assert [x.count() for x in cache.purge(table)] == [0, 3]
    assert [x.count() for x in cache.purge(table, datetime(2024, 1, 20), older_than_days=30)] == [3, 0]
    new = cache.upsert(table, spark.createDataFrame([entry("a", "v1", "m", 2), entry("a", "v1", "m", 5), entry("d", "v1", "m")], CACHE_DDL))
    assert {r.cache_key: r.output_body for r in new.collect()} == {"a": "o5", "b": "o1", "c": "o1", "d": "o1"}
    hits, misses = cache.split(spark.createDataFrame([("a",), ("a",), ("z",)], "cache_key string"), table)
    assert (hits.count(), misses.count()) == (2, 1)
    touched = {r.cache_key: r.hit_count for r in cache.touch(table, hits.select("cache_key"), datetime(2024, 2, 1)).collect()}
    assert touched == {"a": 2, "b": 0, "c": 0} and cache.stats(table).first().entries == 3


def test_estimate(spark):
    prices = spark.createDataFrame([("p.m", 3.0, 15.0, None), ("p.free", 0.0, 0.0, None)], "key string, input_usd_per_million double, output_usd_per_million double, cache_read_usd_per_million double")
    rows = spark.createDataFrame([(10, " P", "M "), (10, "p", "x"), (10, "p", "free")], "nodes int, label string, model string")
    got = estimate.estimate(rows, prices, date(2026, 12, 1), date(2026, 6, 26)).collect()
    assert [r.total_calls for r in got] == [11] * 3 and sorted([r.is_unknown_model for r in got]) == [False, False, True] and all(r.is_stale for r in got)
    assert sorted(round(r.estimated_cost_usd, 6) for r in got if r.estimated_cost_usd is not None) == [0.0, 0.159]
    assert estimate.proceed(5) and estimate.proceed(500, yes=True) and estimate.proceed(500) and not estimate.proceed(500, interactive=True, ask=lambda q: False)


def test_prices_and_settings(spark, tmp_path):
    (tmp_path / "p.toml").write_text('[metadata]\ncapture_date = "2026-06-26"\n[Acme.big]\ninput_usd_per_million = 1\noutput_usd_per_million = 2.5\n')
    table, meta = readers.prices(spark, str(tmp_path / "p.toml"))
    assert table.first().key == "acme.big" and meta["capture_date"] == "2026-06-26"
    (tmp_path / "s.toml").write_text("max_concurrent = 7\nclasses_per_domain = 9\nunknown = 1\n")
    s = readers.Settings.load(str(tmp_path / "s.toml"), {"SRCGRAPH_CLASSES_PER_DOMAIN": "4"}, max_tokens=3)
    assert (s.max_concurrent, s.classes_per_domain, s.max_tokens, s.confirm_threshold) == (7, 4, 3, 100)
    with pytest.raises(ValueError):
        readers.Settings.load(environment={}, max_concurrent=99)


def test_prompts(tmp_path):
    import hashlib

    body = "\n# System\nBe brief.  \n# User\nAbout <<name>>\n"
    pin = hashlib.sha256("".join(f"{x.rstrip()}\n" for x in body.splitlines()).encode()).hexdigest()[:8]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/v1.md").write_text(f"---\nid: p\nrequired_vars: [name]\ncontent_hash_pin: \"{pin}\"\n---{body}")
    (tmp_path / "p/default.yaml").write_text("default: v1\n")
    p = readers.prompt(str(tmp_path), "p")
    assert (p.system, p.user, p.version, p.content_hash) == ("Be brief.", "About <<name>>", "v1", pin)
    (tmp_path / "p/v2.md").write_text(f"---\nid: p\ncontent_hash_pin: 00000000\n---{body}")
    with pytest.raises(ValueError):
        readers.prompt(str(tmp_path), "p", "v2")


@pytest.mark.parametrize(
    "security, webflux, tags, types, want",
    [
        ("refuse", "refuse", ["Secured"], ["Flux<A>"], ("refuse", "security")), ("ignore", "refuse", ["Secured"], ["Mono<A>"], ("refuse", "webflux_refuse")), ("ignore", "translate_mono_only", [], ["Mono<A>", "Flux<B>"], ("refuse", "webflux_flux_only")),
        ("ignore", "translate_mono_only", [], ["Mono<A>", None], ("render", None)), ("stub_todo", "best_effort", ["Secured"], ["Flux<A>"], ("render", None)), ("refuse", "refuse", None, None, ("render", None)),
    ],
)
def test_policies(spark, security, webflux, tags, types, want):
    df = spark.createDataFrame([(tags, types)], "annotations array<string>, return_types array<string>")
    r = policy.decide(df, security=security, webflux=webflux).first()
    assert (r.decision, r.reason) == want and r.stub == (security == "stub_todo")
    if r.decision == "render" and types:
        assert r.hints.webflux_hint


def make_reply():
    def reply(xs):
        if any("boom" in x for x in xs):
            raise annotate.CallError("bad", transient=False)
        return [json.dumps({"node_id": "x", "class_name": x[:3], "domain_hint": "orders", "stereotype": "Service", "description": "d", "methods": []}) for x in xs]

    return reply


def test_annotate(spark):
    reply = make_reply()
    nodes = spark.createDataFrame([(f"p.C{k:02}", "class", f"{k}.java", [1, 1]) for k in range(12)] + [("p.Big", "class", "big.java", [0, 0]), ("p.f", "field", None, None)], "id string, kind string, source_file string, line_range array<int>")
    big = "public void go(int x) {" + " " * annotate.MOST_CHARS
    files = spark.createDataFrame([(f"{k}.java", f"C{k:02} body\nrest") for k in range(11)] + [("11.java", "boom"), ("big.java", big)], "path string, text string")
    got = {r.node_id: r for r in annotate.annotate(nodes, files, reply).collect()}
    assert len(got) == 13 and got["p.C00"].annotation.class_name == "C00" and not got["p.C00"].degraded and got["p.C11"].degraded and got["p.C11"].annotation is None
    assert got["p.Big"].degraded and got["p.Big"].extraction_mode == "signatures_only" and got["p.Big"].annotation.class_name == "pub"
    with pytest.raises(annotate.CallError):
        annotate.annotate(nodes, files, reply, ratio=0.05).count()
    rows = annotate.annotate(nodes, files, reply)
    blocks = {r.domain: r for r in annotate.domains(rows).collect()}
    assert blocks["orders"].classes == 12 and blocks["unknown"].lines == "  ? [DEGRADED]"
    assert annotate.synthesise(rows, lambda xs: [json.dumps({"project_overview": xs[0][:8]})]) == {"project_overview": "Domains:"}


def test_failure_gate(spark):
    gate = lambda n, f: annotate.failure_gate(spark.createDataFrame([(k < f,) for k in range(n)], "failed boolean")).first().abort
    assert [gate(10, 1), gate(10, 2), gate(9, 3), gate(9, 4)] == [False, True, False, True]


def test_cached_call(spark):
    asked = spark.createDataFrame([("k1", "in1"), ("k2", "in2")], "cache_key string, input string")
    known = spark.createDataFrame([entry("k1", "v", "m")], CACHE_DDL)
    got = {r.cache_key: (r.output, r.cache_hit) for r in annotate.cached_call(asked, known, lambda xs: ["new"] * len(xs)).collect()}
    assert got == {"k1": ("o1", True), "k2": ("new", False)}


def test_render_registry():
    render.clear()
    render.register(render.nest())
    with pytest.raises(ValueError):
        render.register(render.nest())
    with pytest.raises(KeyError):
        render.target("go")
    assert render.targets() == ["typescript"]
    assert dict(render.scaffold(render.target("typescript"), "shop", ["orders"]))["src/app.module.ts"].count("OrdersModule") == 2


def test_files_collide(spark, tmp_path):
    df = spark.createDataFrame([("a.ts", "1"), ("a.ts", "2")], "path string, content string")
    with pytest.raises(ValueError):
        sinks.write_files(df, str(tmp_path))
    assert sinks.write_files(df.limit(1), str(tmp_path)) == 1


def test_manifest(spark, tmp_path):
    sinks.write_manifest(str(tmp_path), run_id="r", corpus_id="c", artefacts={"graph": {"path": "g", "schema_version": "1", "sha256": "s"}}, later={"x": 1})
    with pytest.raises(FileExistsError):
        sinks.write_manifest(str(tmp_path), run_id="r")
    row = readers.manifest(spark, str(tmp_path / "manifest.json")).first()
    assert (row.run_id, row.artefacts["graph"].sha256) == ("r", "s")
    assert datetime.now(UTC).year >= 2024


def test_broken_bytes_are_replaced(spark, tmp_path):
    (tmp_path / "A.java").write_bytes(b"class A { \xff\xe9 }")
    (tmp_path / "B.java").write_bytes("class B { é }".encode())
    got = {r.path: r.text for r in acquire.local_files(spark, str(tmp_path)).collect()}
    assert got == {"A.java": b"class A { \xff\xe9 }".decode(errors="replace"), "B.java": "class B { é }"}


def test_settings_files(tmp_path):
    (tmp_path / "s.yaml").write_text("---\n# of a run\nmax_concurrent: 7\nsecurity_policy: 'ignore'\nmodels:\n  large: big-1\n  default: small-1\nmax_calls: ~\n")
    (tmp_path / ".env").write_text("export SRCGRAPH_MAX_CONCURRENT='9'\nSRCGRAPH_CLASSES_PER_DOMAIN=4\n# SRCGRAPH_MAX_CALLS=1\n")
    load = lambda **more: readers.Settings.load(str(tmp_path / "s.yaml"), more.pop("env", {}), dotenv=str(tmp_path / ".env"), **more)
    s = load()
    assert (s.max_concurrent, s.security_policy, s.classes_per_domain, s.max_calls) == (9, "ignore", 4, None)
    assert load(env={"SRCGRAPH_MAX_CONCURRENT": "11"}).max_concurrent == 11 and load(max_concurrent=12).max_concurrent == 12
    assert s.model_for("large") == "big-1" and s.model_for("other") == "small-1"
    with pytest.raises(KeyError):
        readers.Settings().model_for("large")


def answer(texts):
    """Domain summaries get an overview, classes a record."""
    if texts[0].startswith("Domains:"):
        return [json.dumps({"project_overview": "all", "domains": []})]
    return [json.dumps({"class_name": "X", "domain_hint": "shop", "methods": [{"name": "m", "return_type": "Flux<A>" if "class A" in texts[0] else "int"}]})]


@pytest.mark.skip(reason="not seen to end within minutes yet; the run path with a model is unverified")
def test_run_with_a_model(spark, tree, tmp_path, monkeypatch):
    (tree / "core/.gitignore").write_text("B.java\n")
    out, store = str(tmp_path / "out"), str(tmp_path / "cache")
    run = lambda *more, model=answer: cli.main(["run", str(tree), "--out", out, "--force", "--cache", store, "--non-interactive", *more], model)
    (tmp_path / "out").mkdir()
    (tmp_path / "out/stale.txt").write_text("from before")
    assert run("--ast-only") == 0 and not (tmp_path / "out/annotations").exists() and not (tmp_path / "out/stale.txt").exists()
    doc = json.loads((tmp_path / "out/graph.json").read_text())
    assert "p.B" not in {n["id"] for n in doc["nodes"]} and not any(n["kind"] == "module" for n in doc["nodes"])
    assert run("--modules") == 0
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    assert set(manifest["artefacts"]) == {"graph", "annotations", "overview"} and manifest["cache_stats"]["pass_1"]["hits"] == 0
    assert json.loads((tmp_path / "out/overview.json").read_text())["project_overview"] == "all"
    assert {r["logger"] for r in map(json.loads, (tmp_path / "out/run.log.jsonl").read_text().splitlines())} == {"srcgraph"}
    assert any(n["kind"] == "module" for n in json.loads((tmp_path / "out/graph.json").read_text())["nodes"])
    first = manifest["cache_stats"]["pass_1"]["calls"]

    def never(texts):
        return answer(texts) if texts[0].startswith("Domains:") else 1 / 0

    assert run(model=never) == 0  # every class is known
    stats = json.loads((tmp_path / "out/manifest.json").read_text())["cache_stats"]["pass_1"]
    assert (stats["calls"], stats["hits"]) == (first, first) and {r.hit_count for r in readers.cache(spark, store).collect()} == {1}
    # ceilings and the gate
    assert cli.main(["run", str(tree), "--out", str(tmp_path / "o2"), "--max-llm-calls", "0", "--non-interactive"], answer) == 1
    monkeypatch.setattr("sys.stdin.isatty", lambda: True, raising=False)
    monkeypatch.setattr("builtins.input", lambda _: "n")
    gated = lambda *more: cli.main(["run", str(tree), "--out", str(tmp_path / "o4"), "--force", "--llm-call-confirm-threshold", "1", *more], answer)
    assert gated() == 1
    # the class whose record lists a Flux is refused
    assert cli.main(["render", "--from", out, "--out", str(tmp_path / "ts"), "--db-layer", "prisma"], lambda xs: [x.rsplit(": ", 1)[-1] for x in xs]) == 0
    made = {p.name: p.read_text() for p in (tmp_path / "ts/src").rglob("*.ts")}
    assert "a.ts" not in made and made["w.ts"] == "prisma"
    assert "typescript" in json.loads((tmp_path / "out/manifest.json").read_text())["renders"]
    assert cli.main(["eval", "run", out, "--scorecard", "code"]) in (0, 1)
    card = {c["id"]: c for c in json.loads((tmp_path / "out/evals/code-scorecard.json").read_text())["checks"]}
    assert set(card) == {"compile", "coverage", "llm_judge"} and card["coverage"]["value"] is not None and card["llm_judge"]["result"] == "skip"


def test_reproducibility_and_golden(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    assert cli.main(["run", str(tree), "--out", out, "--ast-only"]) == 0
    card = lambda: {c["id"]: c["result"] for c in json.loads((tmp_path / "out/evals/graph-scorecard.json").read_text())["checks"]}
    cli.main(["eval", "run", out, "--check", "reproducibility", "--check", "golden_graph_agreement", "--golden", f"{out}/graph.json"])
    assert card()["reproducibility"] == card()["golden_graph_agreement"] == "pass" and card()["schema_validity"] == "skip"
    (tmp_path / "other.json").write_text("{}")
    assert cli.main(["eval", "run", out, "--check", "golden_graph_agreement", "--golden", str(tmp_path / "other.json")]) == 1 and card()["golden_graph_agreement"] == "fail"


def test_slow_files_fall_back(spark):
    from srcgraph.operators import java_scan

    df = spark.createDataFrame([(1, "m", "A.java", "package p;\nclass A { }")], FILES_DDL)
    assert java_scan.extract(df).first().extraction_mode == "ast"
    with pytest.raises(java_scan.ScanError), java_scan.at_most(0.05):
        while True:
            pass
