import json
import random

import pytest
from pyspark.sql import functions as F

from srcgraph.operators import assemble, build, canonical, components, java_scan, metrics, quality, regex_extract, select
from srcgraph.plans.pipeline import graph_of
from srcgraph.schemas import PARSED_DDL


def parsed(spark, *rows):
    full = []
    for k, r in enumerate(rows):
        base = {"kind": "class", "name": r["id"].rsplit(".", 1)[-1], "source_file": f"{k}.java", "extraction_mode": "ast"} | {k: [] for k in ("imports", "fields", "methods")}
        full.append({"file_ord": k, "module_id": "mod:m"} | base | r)
    return spark.read.schema("file_ord BIGINT, module_id STRING, " + PARSED_DDL).json(spark.sparkContext.parallelize([json.dumps(r) for r in full]))


def field(owner, name, type_, **more):
    return {"id": f"{owner}.{name}", "name": name, "type": type_, "annotations": [], "constraints": [], "is_autowired": False, "modifiers": []} | more


def method(owner, name, calls=(), parameters=(), returns="void", **more):
    ps = [{"name": n, "type": t, "constraints": []} for n, t in parameters]
    return {"id": f"{owner}#{name}({','.join(t for _, t in parameters)})", "name": name, "return_type": returns, "annotations": [], "is_constructor": False, "modifiers": [], "parameters": ps, "calls": list(calls)} | more


A, B = "com.example.A", "com.example.B"


def edges_of(df, kind):
    return sorted((r.source, r.target) for r in df.where(F.col("kind") == kind).collect())


def resolve(spark, a, b=None):
    b = b or {"id": B, "methods": [method(B, "process")]}
    return graph_of(parsed(spark, {"id": A, "imports": [B]} | a, b))[1].persist()


@pytest.mark.parametrize(
    "a, resolved, unresolved",
    [
        ({"fields": [field(A, "b", "B")], "methods": [method(A, "doIt", ["b.process()"])]}, [(f"{A}#doIt()", f"{B}#process()")], []),
        ({"methods": [method(A, "doIt", ["b.process()"], [("b", "B")])]}, [(f"{A}#doIt(B)", f"{B}#process()")], []),
        ({"methods": [method(A, "doIt", ["doIt()"])]}, [(f"{A}#doIt()", f"{A}#doIt()")], []),
        ({"methods": [method(A, "doIt", ["B.process(1)"])]}, [(f"{A}#doIt()", f"{B}#process()")], []),
        ({"methods": [method(A, "doIt", ["localVar.process()"])]}, [], [(f"{A}#doIt()", "localVar.process()")]),
        ({"fields": [field(A, "b", "B")], "methods": [method(A, "doIt", ["b.nonExistentMethod()"])]}, [], [(f"{A}#doIt()", "b.nonExistentMethod()")]),
        ({"fields": [field(A, "b", "Unknown")], "methods": [method(A, "doIt", ["b.process()"], [("b", "B")])]}, [], [(f"{A}#doIt(B)", "b.process()")]),
    ],
)
def test_calls(spark, a, resolved, unresolved):
    edges = resolve(spark, a)
    assert edges_of(edges, "calls_resolved") == resolved and edges_of(edges, "calls_unresolved") == unresolved


def test_overloads(spark):
    b = {"id": B, "methods": [method(B, "process"), method(B, "process", parameters=[("x", "int")])]}
    assert len(edges_of(resolve(spark, {"fields": [field(A, "b", "B")], "methods": [method(A, "doIt", ["b.process()"])]}, b), "calls_resolved")) == 2


def test_depends_on(spark):
    edges = resolve(spark, {"imports": [B, A, "org.Other"], "fields": [field(A, "b", "B")]})
    assert edges_of(edges, "depends_on") == [(A, B)]
    assert edges_of(graph_of(parsed(spark, {"id": A, "superclass": B, "implements": ["C"]}, {"id": B}, {"id": "C"}))[1], "depends_on") == [(A, "C"), (A, B)]


def test_relations(spark):
    fields = [field(A, "x", "List<B>", annotations=["Id", "OneToMany"]), field(A, "y", "B", annotations=["ManyToOne", "OneToMany"]), field(A, "z", "List<B>", annotations=["OneToMany"]), field(A, "w", "Map<String, B>", annotations=["OneToMany"])]
    edges = resolve(spark, {"fields": fields}).where("kind = 'relation'").collect()
    assert sorted(r.cardinality for r in edges) == ["MANY_TO_ONE", "ONE_TO_MANY"]


def test_import_map_keeps_the_last(spark):
    got = assemble.import_map(parsed(spark, {"id": A, "imports": ["x.B", "y.B", "z.C"]})).collect()
    assert sorted((r.simple, r.fqcn) for r in got) == [("B", "y.B"), ("C", "z.C")]


def test_empty(spark):
    nodes, edges = graph_of(parsed(spark, {"id": A}).limit(0))
    assert nodes.count() == 0 and edges.count() == 0


def test_build(spark):
    m = method(A, "get", returns="Foo", modifiers=["public", "strictfp"], is_bean_factory=True, http_metadata={"method": "GET", "path": "/x"}, response_status="HttpStatus.OK")
    m["parameters"] = [{"name": "p", "type": "T", "validate": True, "constraints": [], "binding": {"kind": "path", "name": "id", "required": True}}, {"name": "q", "type": "T", "constraints": ["Min"], "binding": {"kind": "strange"}}]
    rows = parsed(
        spark,
        {"id": A, "modifiers": ["public", "weird"], "stereotype": "Nope", "annotations": [], "fields": [field(A, "f", "B", is_autowired=True, injection_type="field", qualifier="q", generation="GenerationType.IDENTITY", modifiers=["private", "sealed"])], "methods": [m]},
        {"id": "E", "kind": "enum", "constants": ["X"], "fields": [field("E", "f", "B")]}, {"id": "R", "kind": "record", "components": [{"name": "a", "type": "int"}]}, {"id": "T", "kind": "annotation_type", "elements": []}, {"id": "Z", "kind": "mystery"},
    )
    nodes = {r.id: r for r in build.nodes(rows).collect()}
    assert set(nodes) == {A, f"{A}.f", m["id"], "E", "R", "T"}
    a, g = nodes[A], nodes[m["id"]]
    assert a.modifiers == ["public"] and a.stereotype is None and a.annotations is None and a.line_range == [0, 0] and a.fqcn_resolved and a.extraction_mode == "ast"
    assert nodes[f"{A}.f"].generation == "IDENTITY" and nodes[f"{A}.f"].modifiers == ["private"]
    assert g.response_status is None and g.http_metadata.path == "/x" and [p.binding and p.binding.kind for p in g.parameters] == ["path", None] and g.parameters[0].constraints is None
    assert nodes["T"].elements is None and nodes["E"].extraction_mode is None
    edges = build.edges(rows)
    assert edges_of(edges, "autowires") == [(f"{A}.f", "B")] and edges_of(edges, "bean_factory") == [(m["id"], "Foo")] and ("mod:m", A) in edges_of(edges, "contains")


def test_first_wins_is_the_sequential_one(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abcde"), rng.randrange(9), k, rng.choice(["x", None])) for k in range(300)]
    want = {}
    for i, f, n, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(i, (f, n, v))
    got = assemble.dedup_nodes(spark.createDataFrame(rows, "id string, file_ord int, node_ord int, v string")).collect()
    assert {r.id: (r.file_ord, r.node_ord, r.v) for r in got} == want


def test_canonical(spark):
    rows = parsed(spark, {"id": "b.B", "modifiers": ["public", "abstract"], "annotations": ["Z", "A"]}, {"id": A, "methods": [method(A, "m", ["x.y()", "é()"], [("p", "int")])]})
    nodes, edges = graph_of(rows)
    text = "".join(canonical.canonical(nodes, edges))
    doc = json.loads(text)
    assert text.endswith('"projectOverview":null}\n') and [n["id"] for n in doc["nodes"]] == sorted(n["id"] for n in doc["nodes"])
    assert json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n" == text
    b = next(n for n in doc["nodes"] if n["id"] == "b.B")
    assert b["modifiers"] == ["abstract", "public"] and b["annotations"] == ["A", "Z"] and b["wmc"] is None
    assert [(e["kind"], e["source"], e["target"]) for e in doc["edges"]] == sorted((e["kind"], e["source"], e["target"]) for e in doc["edges"])
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), set()
    for n in ("1", "5", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(canonical.digest(*graph_of(rows.repartition(int(n)))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


SNIPPETS = [
    ("int getX() {\n return x;\n}", 1, 0, 3),
    ("void f() { if (a) { g(); } else { h(); } }", 2, 2, 1),
    ("void f() { if (a) { } else if (b) { } else { } }", 3, 3, 1),
    ("void f() { for (var o : os) { if (o.x) { g(); } } }", 3, 3, 1),
    ("void f() { if (a && b && c) { g(); } }", 4, 1, 1),
    ("void f() { switch (x) { case 1: g(); break; case 2: break; default: h(); } }", 3, 1, 1),
    ("boolean f() { return a && b || c && d; }", 4, 3, 1),
    ("void f() { xs.forEach(x -> { if (x) { } }); }", 2, 3, 1),
    ("void f() { do { x(); } while (a); try { } catch (E e) { } }", 3, 2, 1),
    ("void f() { int y = a ? 1 : 2; List<?> l; }", 2, 0, 1),
    ("void f() { if (a) if (b) g(); }", 3, 1, 1),
]


@pytest.mark.parametrize("body, cc, cognitive, loc", SNIPPETS)
def test_method_metrics(body, cc, cognitive, loc):
    m = java_scan.scan("A.java", "class A { " + body + " }")["methods"][0]
    assert (m["cyclomatic_complexity"], m["cognitive_complexity"], m["method_loc"]) == (cc, cognitive, loc)


def test_class_metrics(spark):
    account = "class A { int balance; void in(int x) { balance += x; } int get() { return balance; } }"
    mixed = "class A { int a; int b; void f() { a = 1; } void g() { f(); } void h() { b = 1; } static void s() { } }"
    facade = "class A { X x; Y y; Z z; void f() { x.go(); } void g() { y.go(); } void h() { z.go(); } }"
    assert [java_scan.scan("A.java", s)["lcom4"] for s in (account, mixed, facade)] == [1, 2, 3]
    service = java_scan.scan("A.java", "class A { OwnerRepository r; List<Owner> all; Owner find(String n, Long id) { return null; } void x() { if (a) { } } }")
    assert (service["cbo"], service["wmc"]) == (2, 3)
    empty = java_scan.scan("A.java", "class A { int x; }")
    assert (empty["wmc"], empty["lcom4"], empty["cbo"]) == (None, None, 0)
    only = java_scan.scan("A.java", "class A { A() { } }")
    assert (only["wmc"], only["lcom4"]) == (1, 1)
    interface = java_scan.scan("A.java", "interface A extends B<C>, D { void f(); default int g() { return 1; } }")
    assert interface["methods"][0]["cyclomatic_complexity"] is None and interface["methods"][1]["method_loc"] == 1 and interface["extends_interfaces"] == ["B", "D"]
    files = spark.createDataFrame([(0, "mod:m", f"{n}.java", s.replace("class A", f"class {n}").replace("A()", f"{n}()")) for n, s in (("P", mixed), ("Q", facade), ("R", account))], "file_ord long, module_id string, path string, text string")
    rows = java_scan.extract(files).persist()
    assert {r.id: r.lcom4 for r in components.lcom4(rows).collect()} == {"P": 2, "Q": 3, "R": 1} == {r.id: r.lcom4 for r in rows.collect()}
    assert {r.id: r.cbo for r in metrics.coupling(metrics.declared_types(rows)).collect()} == {"Q": 3}


def test_scanner_details():
    source = """
package a.b;
import java.util.*;
import static x.Y.z;
@Entity @Table(name = "owners") public class Owner extends Base<T> implements I, J<K> {
  @Id @GeneratedValue(strategy = GenerationType.IDENTITY) private Long id;
  @Autowired @Qualifier("q") Repo repo, other;
  @Column(name = "n", nullable = false, length = X) String n;
  @PostMapping(path = "/p", consumes = "x") @ResponseStatus(HttpStatus.CREATED) public Map<String, List<A>> f(@Valid @NotNull @RequestParam(name = "k", required = false, defaultValue = "z") final int[] v, String... rest) { return repo.a(1).b(); }
  @RequestMapping(value = "/r", method = RequestMethod.PUT) void g() { this.id = new Owner.Key(1).id(); }
  static class Nested { int no; }
}
"""
    r = java_scan.scan("x/Owner.java", source)
    assert (r["id"], r["table_name"], r["superclass"], r["implements"], r["imports"]) == ("a.b.Owner", "owners", "Base", ["I", "J"], ["java.util", "x.Y.z"])
    fields = {f["name"]: f for f in r["fields"]}
    assert fields["id"]["is_id"] and fields["id"]["generation"] == "GenerationType.IDENTITY" and fields["other"]["qualifier"] == "q" and fields["repo"]["injection_type"] == "field"
    assert fields["n"]["column"] == {"name": "n", "nullable": False, "length": None} and "no" not in fields
    f, g = r["methods"]
    assert f["id"] == "a.b.Owner#f(int[],String)" and f["return_type"] == "Map<String, List<A>>" and f["http_metadata"] == {"method": "POST", "path": "/p"} and f["response_status"] == "HttpStatus.CREATED"
    p = f["parameters"][0]
    assert p["validate"] and p["constraints"] == ["NotNull"] and p["binding"] == {"kind": "query", "name": "k", "required": False, "default_value": "z"}
    assert f["calls"] == ["repo.a(1).b()", "repo.a(1)"] and g["http_metadata"] == {"method": "PUT", "path": "/r"} and g["calls"] == ["new Owner.Key(1).id()"] and g["accessed_fields"] == ["id"]
    enum = java_scan.scan("E.java", "enum E implements I { @X A(1), B { void f() { } }; int z; }")
    assert enum["constants"] == ["A", "B"] and enum["fields"] == []
    assert java_scan.scan("R.java", "record R(int a, List<B> b) implements I { R { } }")["components"] == [{"name": "a", "type": "int"}, {"name": "b", "type": "List<B>"}]
    assert java_scan.scan("T.java", '@interface T { int x() default 1; String y(); }')["elements"] == [{"name": "x", "type": "int", "default_value": "1"}, {"name": "y", "type": "String", "default_value": None}]


@pytest.mark.parametrize(
    "head, names, constructors",
    [
        ("@Data", ["getA", "setA", "isOk", "getF", "toString", "equals", "hashCode"], [1]),
        ("@Getter", ["getA", "isOk", "getF"], []),
        ("@Value", ["getA", "isOk", "getF"], [3]),
        ("@Builder @NoArgsConstructor @AllArgsConstructor", ["builder"], [0, 3]),
        ("@RequiredArgsConstructor", [], [1]),
    ],
)
def test_lombok(head, names, constructors):
    r = java_scan.scan("A.java", head + " class A { int a; static int s; boolean ok; final B f = null; void setOk(boolean x) { } }")
    made = [m for m in r["methods"] if m["is_synthesised"]]
    assert [m["name"] for m in made if not m["is_constructor"]] == names
    assert [len(m["parameters"]) for m in made if m["is_constructor"]] == constructors


def test_fallback(spark):
    files = spark.createDataFrame([(0, "mod:m", "src/Bad.java", "package p;\n@Service @Service\npublic class Bad {\n    private int xx = 1;\n    public Bad(int x) {\n    void go( {\n"), (1, "mod:m", "src/None.java", None), (2, "mod:m", "src/Foo.java", "class Foo {\n}")], "file_ord long, module_id string, path string, text string")
    got = {r.source_file: r for r in java_scan.extract(files).collect()}
    bad = got["src/Bad.java"]
    assert (bad.id, bad.extraction_mode, bad.annotations, bad.stereotype) == ("p.Bad", "regex", ["Service"], "Service")
    assert [(m.name, m.return_type, m.id) for m in bad.methods] == [("Bad", "public", "p.Bad#Bad()"), ("go", "void", "p.Bad#go()")] and [f.name for f in bad.fields] == ["xx"]
    assert (got["src/None.java"].id, got["src/None.java"].kind) == ("file:src/None.java#None", "class") and got["src/Foo.java"].extraction_mode == "ast"
    plain = regex_extract.extract(files.where("file_ord = 2")).first()
    assert plain.id == "file:src/Foo.java#Foo" and plain.fqcn_resolved is False
    wild = spark.createDataFrame([("import a.*;\nimport static b.C.d;\n",)], "t string").select(regex_extract.imports(F.col("t"))).first()[0]
    assert wild == ["a.*", "b.C.d"]
    comment = spark.createDataFrame([("/* the class name is here */ class Real {}",)], "t string").select(regex_extract.type_name(F.col("t"))).first()[0]
    assert comment == "name"


LADDER = [
    ([(f"C{k}", 0, k) for k in range(6)], 4, "top_n_v1", {"C5", "C4", "C3", "C2"}),
    ([("C1", None, 10), ("C2", None, 8), ("C3", None, None), ("C4", None, None)], 3, "top_n_v1", {"C1", "C2", "C3"}),
    ([("H0", 5, 25), ("H1", 5, 24), ("H2", 5, 23), ("M0", 2, 10), ("M1", 2, 10), ("M2", 2, 10), ("L0", 0, 1), ("L1", 0, 1), ("L2", 0, 1)], 3, "stratified_threshold_v1", {"H0", "M0", "L0"}),
    ([("H0", 5, 20), ("H1", 5, 20), ("H2", 5, 20), ("M0", 2, 10), ("M1", 2, 10), ("M2", 2, 10), ("L0", 0, 1)], 3, "stratified_threshold_v1", {"H0", "M0", "L0"}),
    ([("A", None, None), ("B", None, None), ("C", 1, 1)], 10, "take_all", {"A", "B", "C"}),
    ([("H0", 9, 9), ("H1", 9, 8), ("H2", 9, 7), ("L0", 0, 1)], 2, "stratified_threshold_v1", {"H0", "L0"}),
]


@pytest.mark.parametrize("members, cap, strategy, chosen", LADDER)
def test_ladder(spark, members, cap, strategy, chosen):
    df = spark.createDataFrame([("g", *m) for m in members], "group_name string, id string, cbo int, wmc int")
    r = select.selections(select.ladder(df, cap), cap).first()
    assert (r.strategy, set(r.selected), r.total_in_group) == (strategy, chosen, len(members))
    assert set(r.excluded) == {m[0] for m in members} - chosen and r.metrics_missing_count == sum(None in m for m in members)
    if strategy == "stratified_threshold_v1":
        assert r.excluded == sorted(r.excluded)


GROUPS = [
    ({"com.example.orders.OrderService": "orders", "com.example.orders.OrderController": "orders", "com.example.inventory.ItemService": "inventory"}),
    ({"com.example.Root": "misc", "com.example.Other": "misc"}),
    ({"com.acme.platform.billing.A": "billing", "com.acme.platform.billing.B": "billing", "com.acme.platform.auth.C": "auth"}),
    ({"com.example.orders.OrderService": "orders"}),
]


@pytest.mark.parametrize("want", GROUPS)
def test_prefix_groups(spark, want):
    got = select.prefix_groups(spark.createDataFrame([(k,) for k in want], "id string")).collect()
    assert {r.id: r.group_name for r in got} == want


def test_manual_groups(spark):
    df = spark.createDataFrame([("com.example.orders.X",), ("com.example.Y",), ("com.exampleother.Z",)], "id string")
    got = select.manual_groups(df, {"com.example": "app", "com.example.orders": "orders"}).collect()
    assert [r.group_name for r in got] == ["orders", "app", "misc"]
    assert [r.group_name for r in select.manual_groups(df, {}).collect()] == ["misc"] * 3


def test_checks(spark):
    rows = parsed(spark, {"id": A, "methods": [method(A, "m")]}, {"id": "Bare", "extraction_mode": "regex"})
    nodes, edges = graph_of(rows)
    orphan = nodes.where("kind = 'method'").withColumn("id", F.lit("x.Gone#m()"))
    broken = nodes.unionByName(orphan).unionByName(nodes.where(F.col("id") == A))
    rules = {(r.rule, r.subject) for r in quality.violations(broken, edges).collect()}
    assert rules == {("duplicate_id", A), ("class_without_package", "Bare"), ("method_without_type", "x.Gone#m()")}
    card = {r.id: r for r in quality.graph_scorecard(nodes, edges, digest="d", golden="d", digests=["d", "d"]).collect()}
    assert set(card) == set(quality.GRAPH_CHECKS)
    assert {k: r.result for k, r in card.items()} == {"reproducibility": "pass", "schema_validity": "pass", "structural_completeness": "fail", "relationship_correctness": "pass", "internal_consistency": "fail", "golden_graph_agreement": "pass", "semantic_accuracy": "skip"}
    only = {r.id: r.result for r in quality.graph_scorecard(nodes, edges, include=["schema_validity"], skip=["schema_validity"]).collect()}
    assert only["schema_validity"] == "pass" and sum(v == "skip" for v in only.values()) == 6


@pytest.mark.parametrize("groups, value, result", [([(6, 4, 0)], 0.6, "fail"), ([(9, 1, 0)], 0.9, "skip"), ([(3, 0, 0), (2, 1, 0)], 5 / 6, "fail"), ([], None, "skip")])
def test_coverage(spark, groups, value, result):
    rows = [(["s"] * a, ["r"] * b, ["t"] * c) for a, b, c in groups]
    df = quality.coverage(spark.createDataFrame(rows, "selected array<string>, refused array<string>, stub_todos array<string>"))
    r = df.withColumn("threshold", quality.limits()["coverage"]).withColumn("result", quality.verdict("value", "threshold")).first()
    assert r.value == (value if value is None else pytest.approx(value)) and r.result == result


def test_compile_rate(spark):
    rate = lambda *s: quality.compile_rate(spark.createDataFrame([(str(k), x) for k, x in enumerate(s)], "check string, status string")).first().value
    assert (rate("pass", "fail", "preflight_skip"), rate("preflight_skip"), rate()) == (0.5, None, 1.0)


def test_report(spark):
    limit = ("min_ratio", None, 1.0, None)
    rows = [("graph", "c1", "completeness", "graph", "pass", 1.0, limit, 1, None), ("graph", "c2", "completeness", "graph", "fail", 0.8, limit, 1, None)]
    from srcgraph.schemas import CHECKS_DDL

    df = spark.createDataFrame(rows, CHECKS_DDL)
    r = quality.report(df).first()
    assert (r.overall_result, r["min"], r["max"], quality.report_overall(quality.report(df)).first().overall) == ("fail", 0.8, 1.0, "fail") and r["mean"] == pytest.approx(0.9)
    assert quality.report_overall(quality.report(df.limit(0))).first().overall == "pass"
    assert "| completeness | PASS (1) | FAIL (0.8) | FAIL mean 0.9 |" in quality.markdown(df)


def test_spread_closes_long_paths(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101)], "a long, b long")
    vertices = spark.createDataFrame([(k,) for k in [*range(1, 61), 100, 101, 200]], "id long")
    got = {r.id: r.component for r in components.spread(edges, vertices).collect()}
    assert set(got[k] for k in range(1, 61)) == {1} and got[101] == 100 and got[200] == 200


def brute_components(rows):
    """Of (class, name, fields, callees), the groups of each class, every row a method of its own."""
    out = {}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        low = list(range(len(own)))
        for _ in own:
            for a, x in enumerate(own):
                for b, y in enumerate(own):
                    if a != b and (set(x[2]) & set(y[2]) or y[1] in x[3] or x[1] in y[3]):
                        low[a] = low[b] = min(low[a], low[b])
        out[c] = (len(own), len(set(low)))
    return out


@pytest.mark.parametrize("most", [5000, 2])
def test_overloads_are_methods_of_their_own(spark, monkeypatch, most):
    monkeypatch.setattr(components, "MOST_METHODS", most)
    rows = [(1, "get", ["a"], []), (1, "get", ["a"], []), (1, "put", ["b"], []), (2, "get", [], []), (2, "get", [], []), (2, "put", [], []), (3, "get", [], ["get"]), (3, "get", [], ["get"]), (4, "get", [], []), (4, "get", [], []), (4, "put", [], ["get"]), (5, "get", [], ["put"]), (5, "get", [], ["put"]), (5, "put", [], []), (6, "x", [], ["nowhere"]), (6, "x", [], ["nowhere"])]
    rng = random.Random(5)
    rows += [(10 + k % 7, f"m{rng.randrange(5)}", rng.sample("abcdefgh", rng.randrange(3)), rng.sample(["m1", "m2", "q"], rng.randrange(2))) for k in range(60)]
    df = spark.createDataFrame(rows, "class_id int, name string, accessed_fields array<string>, callees array<string>")
    assert {r.class_id: (r.methods, r.components) for r in components.class_components(df).collect()} == brute_components(rows)


def test_ladder_of_a_large_group_is_the_same(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"c{k:04}", rng.choice(["big", "big", "big", "small", None]), rng.choice([None, *range(30)]), rng.choice([None, *range(8)])) for k in range(300)] + [("x1", "tiny", 3, 3), ("x2", "tiny", None, 1), ("y1", "mid", 5, 1), ("y2", "mid", 5, 1), ("y3", "mid", None, 1), ("y4", "mid", 9, 1)]
    df = spark.createDataFrame(rows, "id string, group_name string, wmc int, cbo int").where("group_name IS NOT NULL")
    want = sorted(map(tuple, select.ladder(df).select("id", "strategy", "bucket", "rank", "selected").collect()))
    monkeypatch.setattr(select, "MOST_IN_WINDOW", 10)
    assert sorted(map(tuple, select.ladder(df.repartition(7)).select("id", "strategy", "bucket", "rank", "selected").collect())) == want and len(want) == df.count()


def test_no_filter_is_computed_from_the_text_again(spark):
    files = spark.createDataFrame([("A.java", "class A {\n    int a;\n    int f() { }\n}\n")], "path string, text string")
    for found in (regex_extract.extract(files), java_scan.extract(files)):
        plan = found.select(F.explode("methods").alias("m")).where("m.name <> ''")._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Filter" in x and "regexp" in x]


def test_scanned_files_keep_no_text_and_come_in_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    files = spark.createDataFrame([], "path string, text string, ast struct<id: string>")
    batch = pa.RecordBatch.from_pydict({"path": ["A.java"] * 600, "text": ["class A { }", "class A { ((; }"] * 300})
    out = list(java_scan._scan_batches(to_arrow_schema(files.schema), 30.0)(iter([batch])))
    assert max(b.num_rows for b in out) <= 256 and [x for b in out for x in b.column("text").to_pylist()] == [None, "class A { ((; }"] * 300
    assert [x for b in out for x in b.column("ast").to_pylist()] == [{"id": "A"}, None] * 300


def test_no_cycles_are_searched_for_while_files_are_scanned(spark, monkeypatch):
    import gc

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    files, during = spark.createDataFrame([], "path string, text string, ast struct<id: string>"), []
    monkeypatch.setattr(java_scan, "scan", lambda path, source: during.append(gc.isenabled()) or {"id": path})
    batch = pa.RecordBatch.from_pydict({"path": ["A.java"] * 300, "text": ["class A { }"] * 300})
    after = [gc.isenabled() for _ in java_scan._scan_batches(to_arrow_schema(files.schema), 30.0)(iter([batch]))]
    assert during == [False] * 300 and after == [True, True]


def test_only_columns_asked_for_leave_the_worker(spark):
    files = spark.createDataFrame([("A.java", "class A {\n    private int a;\n    int f() { return a; }\n}\n"), ("B.java", "class B {\n    private int b = ((;\n}\n"), ("C.java", None)], "path string, text string")
    some = java_scan.extract(files, columns=["id", "fields"])
    assert sorted(map(str, some.collect())) == sorted(map(str, java_scan.extract(files).select("id", "fields").collect())) and some.columns == ["id", "fields"]
    assert "accessed_fields" not in some._jdf.queryExecution().optimizedPlan().toJSON()


@pytest.mark.parametrize("source", ["", " \n", "a", "é$ ɑ_1 _é a$b $1", "x//y\n/*z*/.5e+3...;", 'c("\\"", \'"\') + """a"b""";', "a #b", 'a "b', "/* a", "a\u000bb", "1..2", "٣x"])
def test_pieces_are_the_whole_source(source):
    pieces = java_scan._PIECE.findall(source)
    assert "".join(pieces) == source
    kinds = [java_scan._KINDS[p] for p in pieces]
    assert None not in kinds[:-1]
    if None in kinds:
        with pytest.raises(java_scan.ScanError, match=f"unreadable at {source.index(pieces[-1])}"):
            java_scan.Java(source)
    else:
        j = java_scan.Java(source)
        assert [source[a : a + len(x)] for a, x in zip(j.at, j.t, strict=True)] == j.t == [p for p, kind in zip(pieces, kinds, strict=True) if kind]


def test_parts_are_dealt_to_many_tasks(spark):
    from srcgraph import queries

    assert queries.spread(spark.range(100_000, numPartitions=1).toDF("k")).rdd.getNumPartitions() == 12
    assert queries.spread(spark.range(0).toDF("k")).count() == 0


def test_lookups_are_not_broadcast_by_the_size_of_their_table(spark, tmp_path):
    small = parsed(spark, {"id": A, "imports": [B], "fields": [field(A, "b", "B", annotations=["OneToMany"])], "methods": [method(A, "doIt", ["b.process()"])]}, {"id": B, "methods": [method(B, "process")]})
    small.write.parquet(f"{tmp_path}/parsed")
    assert "Broadcast" not in graph_of(spark.read.parquet(f"{tmp_path}/parsed"))[1]._jdf.queryExecution().sparkPlan().toString()


def test_edges_of_some_kinds_need_no_other_lookups(spark, tmp_path):
    b = {"id": B, "methods": [method(B, "process"), method(B, "make", is_bean_factory=True)]}
    parsed(spark, {"id": A, "imports": [B], "fields": [field(A, "b", "B", annotations=["OneToMany"], is_autowired=True)], "methods": [method(A, "doIt", ["b.process()", "c.f()"])]}, b).write.parquet(f"{tmp_path}/parsed")
    rows = spark.read.parquet(f"{tmp_path}/parsed")
    every = graph_of(rows)[1].collect()
    for kinds, joins in ((["contains"], 0), (["autowires", "bean_factory"], 0), (["relation"], 2), (["depends_on"], 3), (["calls_resolved"], 4), (["calls_unresolved", "relation"], 6)):
        own = graph_of(rows, kinds=kinds)[1]
        want = sorted(repr(r) for r in every if r.kind in kinds)
        assert sorted(map(repr, own.collect())) == want and want, kinds
        assert sum(" Join " in x or "- Join" in x for x in own._jdf.queryExecution().optimizedPlan().toString().splitlines()) == joins, kinds


def test_calls_without_parameters(spark):
    frame = lambda row, schema: spark.createDataFrame([row], schema)
    calls = frame(("a.A#f()", "b.g(1)"), "source string, raw_call_expr string")
    rest = frame(("a.A", "b", "B", 0), "owner string, name string, type string, ord long"), frame(("a.B", "g", "a.B#g(int)"), "owner string, name string, method string"), frame(("a.A", "B", "a.B"), "id string, simple string, fqcn string")
    assert [r.resolved for r in assemble.resolve_calls(calls, rest[0], None, *rest[1:]).collect()] == ["a.B#g(int)"]


def test_classes_of_many_names_are_not_gathered(spark, monkeypatch):
    rows = spark.createDataFrame([("C", f"m{k}", [f"f{k // 2}", f"g{k}"], []) for k in range(20)] + [("D", "m", ["f"], [])], "class_id string, name string, accessed_fields array<string>, callees array<string>")
    gathered = lambda df: "FlatMapGroupsInPandas" in df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(components, "MOST_NAMES", 30)
    seen = []
    spread = components.spread
    monkeypatch.setattr(components, "spread", lambda edges, vertices: seen.append(vertices.count()) or spread(edges, vertices))
    got = components.class_components(rows)
    assert sorted(map(tuple, got.collect())) == [("C", 20, 10), ("D", 1, 1)] and seen == [20] and gathered(got)
