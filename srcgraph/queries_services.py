"""What surrounds the graph: discovery, decoding, keys and texts, model calls, the cache, checks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.functions import keys, text
from srcgraph.operators import annotate, build, cache, canonical, quality, telemetry
from srcgraph.queries import GRAPH_SQL, TELEMETRY_SQL, Tables, _graph, _id, _telemetry, query
from srcgraph.sources import acquire, discover


@query("SELECT doc_id, text || chr(65533) || chr(65533) || 'é' AS text FROM documents")
def decoded_files(t):
    """Bytes that aren't UTF-8 become replacement characters, one for each that can't begin a character."""
    content = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FFE9")), F.encode(F.lit("é"), "UTF-8"))
    return t.documents.select("doc_id", acquire.decoded(content).alias("text"))


_PATHS_SQL = """
WITH b AS (SELECT DISTINCT replace(p_brand, '#', '-') AS brand FROM part),
f AS (SELECT 'shop/' || replace(p_brand, '#', '-') || CASE p_partkey % 4 WHEN 0 THEN '/src/main/java/a/P' WHEN 1 THEN '/src/test/java/P' WHEN 2 THEN '/target/src/main/java/P' ELSE '/src/main/java/gen/P' END || p_partkey || CASE WHEN p_size = 1 THEN '.kt' ELSE '.java' END AS path, replace(p_brand, '#', '-') AS brand, p_partkey AS k, p_size AS size FROM part)
"""


def _paths(t: Tables) -> DataFrame:
    brand, k = F.replace("p_brand", F.lit("#"), F.lit("-")), F.col("p_partkey")
    middle = F.when(k % 4 == 0, "/src/main/java/a/P").when(k % 4 == 1, "/src/test/java/P").when(k % 4 == 2, "/target/src/main/java/P").otherwise("/src/main/java/gen/P")
    files = t.part.select(F.concat(F.lit("shop/"), brand, middle, k, F.when(F.col("p_size") == 1, ".kt").otherwise(".java")).alias("path"))
    builds = t.part.select(brand.alias("b")).distinct().select(F.explode(F.when(F.col("b").endswith("1"), F.array(F.lit("pom.xml"))).when(F.col("b").endswith("2"), F.array(F.lit("build.gradle"), F.lit("pom.xml"))).when(F.col("b").endswith("3"), F.array(F.lit("build.gradle.kts"), F.lit("target/pom.xml"))).otherwise(F.array(F.lit("README.md")))).alias("file"), "b")
    return files.union(builds.select(F.concat(F.lit("shop/"), "b", F.lit("/"), "file"))).union(t.spark.createDataFrame([("pom.xml",)], "path string"))


@query(_PATHS_SQL + """, r AS (SELECT '' AS root, 'mod:corpus' AS module_id, 'maven' AS build_tool, 'pom.xml' AS pom_path UNION ALL
SELECT 'shop/' || brand, 'mod:' || brand, CASE WHEN brand LIKE '%3' THEN 'gradle' ELSE 'maven' END, CASE WHEN brand NOT LIKE '%3' THEN 'shop/' || brand || '/pom.xml' END FROM b WHERE right(brand, 1) IN ('1', '2', '3')),
s AS (SELECT 'shop/' || brand AS root, string_agg(DISTINCT CASE k % 4 WHEN 1 THEN 'src/test/java' ELSE 'src/main/java' END, ',' ORDER BY CASE k % 4 WHEN 1 THEN 'src/test/java' ELSE 'src/main/java' END) AS source_roots FROM f WHERE k % 4 <> 2 GROUP BY brand)
SELECT module_id, build_tool, pom_path, coalesce(source_roots, '') AS source_roots, row_number() OVER (ORDER BY CASE root WHEN '' THEN '' ELSE root || '/' END) - 1 AS module_ord FROM r LEFT JOIN s USING (root)""")
def module_discovery(t):
    """Folders with a build file, parents first; pruned folders have none, and a Maven file wins."""
    return discover.modules(_paths(t)).select("module_id", "build_tool", "pom_path", F.array_join("source_roots", ",").alias("source_roots"), F.col("module_ord").cast("long").alias("module_ord"))


@query(_PATHS_SQL + """, x AS (SELECT path, 'mod:' || brand AS module_id, brand, k % 4 = 1 AS test FROM f WHERE right(brand, 1) IN ('1', '2', '3') AND size > 1 AND k % 4 <> 2 AND NOT (k % 4 = 3 AND brand = 'Brand-11') AND NOT regexp_matches(path, '7[.]java$'))
SELECT path, module_id, row_number() OVER (ORDER BY brand, test, path) AS place FROM x""")
def source_discovery(t):
    """Java files below the source roots of modules that neither the corpus' nor the module's patterns ignore, in order."""
    from pyspark.sql.window import Window

    paths = _paths(t)
    files = discover.source_files(paths, discover.modules(paths), ["*7.java"], {"mod:Brand-11": ["gen/"]})
    return files.select("path", "module_id", F.row_number().over(Window.orderBy("file_ord")).cast("long").alias("place"))


@query(r"""SELECT doc_id, substr(sha256(array_to_string(list_transform(regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n'), lambda x: regexp_replace(x, '[\s\x0b]+$', '') || chr(10)), '')), 1, 8) AS prompt_hash,
array_to_string(string_split(text, chr(10))[-3:], chr(10)) AS tail FROM documents""")
def prompt_hashes(t):
    return t.documents.select("doc_id", keys.prompt_hash("text").alias("prompt_hash"), text.last_lines("text", 3).alias("tail"))


@query("""
WITH e AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS s, event_id % 5 AS k FROM events)
SELECT event_id, CASE k WHEN 3 THEN NULL WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOURS ELSE date_trunc('second', ts) END AS at, k <> 4 AS is_run_id, CASE WHEN k <> 3 THEN date_diff('day', ts::DATE, DATE '2024-02-01') > 20 END AS stale FROM e
""")
def timestamps(t):
    """Times with Z, with an offset, with neither, and none; identifiers of runs; the age of prices."""
    k, day, clock = F.col("event_id") % 5, F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    written = F.when(k == 0, F.concat(day, F.lit("T"), clock, F.lit("Z"))).when(k == 1, F.concat(day, F.lit("T"), clock, F.lit("+02:00"))).when(k == 3, F.concat(F.lit("at "), clock)).otherwise(F.concat(day, F.lit(" "), clock))
    run = F.concat(day, F.lit("T"), F.replace(clock, F.lit(":"), F.lit("-")), F.lit("Z-"), F.when(k == 4, "XYZ123").otherwise("0a1b2c"))
    stale = F.when(k != 3, keys.is_stale(F.col("ts").cast("date"), F.lit("2024-02-01").cast("date"), F.lit(20)))
    return t.events.select("event_id", keys.instant(written).cast("timestamp_ntz").alias("at"), keys.is_run_id(run).alias("is_run_id"), stale.alias("stale"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Estimated cost: ' || c_custkey || ' calls (no price for this model)' ELSE printf('Estimated cost: $%.2f USD (%d calls, prices of 2024-05-01)', c_custkey * 0.25, c_custkey) END
|| CASE WHEN c_custkey % 3 = 0 THEN ' WARNING: the prices may be stale.' ELSE '' END AS message, (c_custkey * 3.0 + 1000 * 15.0) / 1000000 AS usd FROM customer""")
def cost_messages(t):
    n = F.col("c_custkey")
    message = keys.cost_text(n, F.when(n % 5 != 0, n * 0.25), F.lit("2024-05-01"), n % 3 == 0)
    return t.customer.select("c_custkey", F.substring_index(message, " - ", 1).alias("message"), keys.cost(n, F.lit(1000), F.lit(3.0), F.lit(15.0)).alias("usd"))


@query("""
WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://API.openai.com/v1' WHEN 1 THEN 'https://api.minimaxi.com:443/x' ELSE url END AS url, CASE WHEN page_id % 7 = 0 THEN 'mine' WHEN page_id % 7 = 1 THEN '' END AS given FROM pages)
SELECT page_id, CASE WHEN given = 'mine' THEN given WHEN page_id % 5 = 0 THEN 'openai' WHEN page_id % 5 = 1 THEN 'minimax' ELSE lower(regexp_extract(url, '^https?://([^/:]+)', 1)) END AS label FROM p
""")
def provider_labels(t):
    k = F.col("page_id")
    url = F.when(k % 5 == 0, "https://API.openai.com/v1").when(k % 5 == 1, "https://api.minimaxi.com:443/x").otherwise(F.col("url"))
    return t.pages.select("page_id", text.provider_label(F.when(k % 7 == 0, "mine").when(k % 7 == 1, ""), url).alias("label"))


@query("""
WITH p AS (SELECT page_id, url, page_id % 4 AS k FROM pages), q AS (SELECT *, CASE k WHEN 0 THEN 'out/src/' || page_id || '/x.ts' WHEN 1 THEN 'out/src/main.ts' WHEN 2 THEN 'out/' || page_id ELSE '/else/' || page_id END AS path FROM p)
SELECT page_id, CASE WHEN k = 3 THEN path ELSE substr(path, 5) END AS relative, CASE WHEN k = 0 THEN page_id::VARCHAR END AS domain, CASE k WHEN 0 THEN 'a"b' WHEN 1 THEN 'x' ELSE '' END AS plain FROM q
""")
def generated_paths(t):
    k, s = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("out\\src/"), s, F.lit("/x.ts"))).when(k == 1, "out/src/main.ts").when(k == 2, F.concat(F.lit("out/"), s)).otherwise(F.concat(F.lit("/else/"), s))
    quoted = F.when(k == 0, '"a"b"').when(k == 1, '"x').otherwise('""')
    rows = t.pages.select("page_id", text.relative_path(path, F.lit("out/")).alias("relative"), text.unquoted(quoted).alias("plain"))
    return rows.select("page_id", "relative", text.domain_dir("relative").alias("domain"), "plain")


@query("SELECT count(DISTINCT p_size) AS domains, count(*) FILTER (p_partkey % 3 > 0) AS files, false AS collapsed FROM part UNION ALL SELECT 1, count(*), count(*) > 5 FROM nation")
def generated_collapse(t):
    """Whether what was generated fell into one folder."""
    path = lambda d, n, k: F.concat(F.lit("src/"), d, F.lit("/"), n, F.when(k, ".ts").otherwise(".md")).alias("path")
    one = quality.collapsed(t.part.select(path("p_size", "p_partkey", F.col("p_partkey") % 3 > 0)))
    return one.union(quality.collapsed(t.nation.select(path(F.lit("all"), "n_nationkey", F.lit(True)))))


def _model(texts: list[str]) -> list[str]:
    """A model that answers in capitals, and fails for good on what begins with N and once more each time on I."""
    if texts[0].startswith("N"):
        raise annotate.CallError(f"refused {texts[0][:3]}")
    if texts[0].startswith("I"):
        raise annotate.CallError("busy", transient=True)
    return [x.upper() for x in texts]


def _asked(t: Tables) -> DataFrame:
    first = F.when(F.col("c_custkey") % 11 == 0, "N").when(F.col("c_custkey") % 13 == 0, "I").otherwise("a")
    return t.customer.select(_id("c", "c_custkey").alias("node_id"), F.concat(first, F.pmod("c_custkey", F.lit(7)), F.lit(" "), "c_mktsegment").alias("input"), (F.col("c_custkey") % 5 == 0).alias("degraded"), F.col("c_custkey").alias("k"))


CALLS_MADE_SQL = """
WITH a AS (SELECT 'c:' || c_custkey AS node_id, c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'N' WHEN c_custkey % 13 = 0 THEN 'I' ELSE 'a' END AS first, c_custkey % 7 || ' ' || c_mktsegment AS rest FROM customer),
r AS (SELECT *, CASE first WHEN 'a' THEN upper(first || rest) END AS output, CASE first WHEN 'N' THEN 'refused N' || substr(rest, 1, 2) WHEN 'I' THEN 'busy' END AS error, CASE first WHEN 'I' THEN 3 ELSE 1 END AS attempts FROM a)
"""


@query(CALLS_MADE_SQL + "SELECT node_id, output, error, attempts FROM r")
def model_calls(t):
    """Calls of a model side by side: failures become rows, transient ones are repeated with pauses."""
    return annotate.call(_asked(t).select("node_id", "input"), _model, sleep=_no_pause).select("node_id", "output", "error", "attempts")


def _no_pause(seconds: float) -> None:
    pass


@query(CALLS_MADE_SQL + "SELECT error, min(node_id) AS node_id FROM r WHERE error IS NOT NULL GROUP BY error ORDER BY 2 LIMIT 5")
def failure_samples(t):
    """The first reasons why calls failed, a report of at most five."""
    return annotate.failure_samples(annotate.call(_asked(t).select("node_id", "input"), _model, sleep=_no_pause)).select("error", "node_id")


@query(CALLS_MADE_SQL + """SELECT node_id, CASE WHEN k % 2 = 0 THEN 'stored ' || k ELSE output END AS output, k % 2 = 0 AS cache_hit, CASE WHEN k % 2 = 0 OR error IS NULL THEN 'ok' ELSE 'error' END AS status FROM r""")
def cached_calls(t):
    """Requests with a stored response don't reach the model; telemetry tells which."""
    asked = _asked(t).withColumn("cache_key", keys.cache_key("node_id", "input"))
    stored = asked.where("k % 2 = 0").select("cache_key", F.concat(F.lit("stored "), "k").alias("output_body"))
    made = annotate.cached_call(asked, stored, _model, sleep=_no_pause)
    rows = annotate.telemetry_rows(made, "run", "annotate", "m")
    return made.select("node_id", "output", F.sha2("input", 256).alias("input_hash"), F.sha2(F.coalesce("output", F.lit("")), 256).alias("output_hash")).join(rows.select("input_hash", "output_hash", "cache_hit", "status").distinct(), ["input_hash", "output_hash"]).select("node_id", "output", "cache_hit", "status")


@query("""
WITH d AS (SELECT 'p:' || p_partkey AS node_id, CASE WHEN p_size % 9 = 0 THEN 'unknown' ELSE p_brand END AS domain, CASE WHEN p_partkey % 10 = 0 THEN '  ' || p_name || ' [DEGRADED]' ELSE '  ' || p_name || ' [' || CASE WHEN p_size % 2 = 0 THEN 'Service' ELSE 'UNKNOWN' END || ']: ' || p_type END AS line FROM part)
SELECT domain, string_agg(line, chr(10) ORDER BY node_id) AS lines, count(*) AS classes FROM d GROUP BY domain
""")
def domain_summaries(t):
    """A block of lines for each domain, its classes in order."""
    note = F.struct(F.when(F.col("p_size") % 9 != 0, F.col("p_brand")).alias("domain_hint"), F.col("p_name").alias("class_name"), F.when(F.col("p_size") % 2 == 0, "Service").otherwise("").alias("stereotype"), F.col("p_type").alias("description"))
    return annotate.domains(t.part.select(_id("p", "p_partkey").alias("node_id"), (F.col("p_partkey") % 10 == 0).alias("degraded"), note.alias("annotation")))


@query("""
WITH s AS (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN 'Service' WHEN 1 THEN '' END AS role, CASE WHEN p_size > 25 THEN 'A, B' ELSE 'none' END AS tags FROM part)
SELECT p_partkey, 'Resolved role: ' || coalesce(nullif(role, ''), 'unknown') AS role_line, 'Class name: ' || p_name AS name_line, 'Top-level annotations: ' || tags AS tags_line, 'Superclass: ' || CASE WHEN p_partkey % 2 = 0 THEN 'Base' ELSE 'null' END AS super_line FROM s
""")
def class_summaries(t):
    """What a code generator is told of a class, also of what it lacks."""
    k, empty = F.col("p_partkey"), F.array().cast("array<string>")
    block = text.class_summary("p_name", F.when(k % 3 == 0, "Service").when(k % 3 == 1, ""), F.when(F.col("p_size") > 25, F.array(F.lit("A"), F.lit("B"))).otherwise(empty), F.when(k % 2 == 0, "Base"), empty, F.lit(2))
    line = lambda n: F.get(F.split("b", "\n"), n)
    return t.part.select("p_partkey", block.alias("b")).select("p_partkey", line(0).alias("role_line"), line(1).alias("name_line"), line(2).alias("tags_line"), line(3).alias("super_line"))


@query("""
WITH c AS (SELECT user_id AS key, min(ts) AS created, count(*) AS hits FROM events GROUP BY user_id), t AS (SELECT *, key % 3 AS model, key % 2 AS version FROM c),
g AS (SELECT *, created < TIMESTAMP '2024-01-20' - INTERVAL 10 DAYS AND model = 1 AS gone FROM t)
SELECT key::VARCHAR AS cache_key, hits + CASE WHEN key % 4 = 0 THEN 2 ELSE 0 END AS hit_count, key % 4 = 0 AS touched, version::VARCHAR AS prompt_version FROM g WHERE NOT gone
""")
def cache_lifecycle(t):
    """Hits raise the counts of their entries; a purge removes what is old and of one model."""
    from datetime import datetime

    key = F.col("user_id")
    table = t.events.groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("created_at"), F.count("*").cast("int").alias("hit_count"))
    table = table.select(key.cast("string").alias("cache_key"), "created_at", "hit_count", F.lit(None).cast("timestamp").alias("last_hit_at"), (key % 3).cast("string").alias("model"), (key % 2).cast("string").alias("prompt_version"))
    hits = table.where("cache_key % 4 = 0").select("cache_key")
    kept, _ = cache.purge(cache.touch(table, hits.union(hits), datetime(2024, 1, 20)), datetime(2024, 1, 20), older_than_days=10, model="1")
    return kept.select("cache_key", F.col("hit_count").cast("long").alias("hit_count"), F.col("last_hit_at").isNotNull().alias("touched"), "prompt_version")


@query("SELECT o_orderpriority AS kind, count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS skipped, count(*) FILTER (o_orderstatus = 'F') AS passed, CASE WHEN o_orderpriority <> '5-LOW' THEN count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus <> 'P') END AS value FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 1")
def compile_rates(t):
    """Of the checks that ran the share passed; where none ran there is no value."""
    status = F.when((F.col("o_orderstatus") == "P") | (F.col("o_orderpriority") == "5-LOW"), "preflight_skip").when(F.col("o_orderstatus") == "F", "pass").otherwise("fail")
    rows, out = t.orders.select("o_orderpriority", F.col("o_orderkey").alias("check"), status.alias("status")), None
    for kind in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        own = quality.compile_rate(rows.where(F.col("o_orderpriority") == kind)).select(F.lit(kind).alias("kind"), "total", "skipped", "passed", "value")
        out = own if out is None else out.union(own)
    return out.where("total > 0")


@query("""
WITH s AS (SELECT s_nationkey, count(*) AS n, count(*) FILTER (s_suppkey % 5 = 0) AS refused, count(*) FILTER (s_suppkey % 7 = 0) AS stubs FROM supplier GROUP BY 1), x AS (SELECT sum(n - refused)::BIGINT AS selected, sum(refused)::BIGINT AS refused_count, sum(stubs)::BIGINT AS stub_todo_count, count(*) AS groups FROM s)
SELECT selected, refused_count, stub_todo_count, groups, (selected - stub_todo_count) / (selected + refused_count) AS value,
CASE WHEN (selected - stub_todo_count) / (selected + refused_count) >= 0.95 THEN 'pass' WHEN (selected - stub_todo_count) / (selected + refused_count) < 0.85 THEN 'fail' ELSE 'skip' END AS result FROM x
""")
def render_coverage(t):
    """Selected members that are no stubs, of those selected or refused."""
    k = F.col("s_suppkey")
    of = lambda ok, name: F.collect_list(F.when(ok, k)).alias(name)
    groups = t.supplier.groupBy("s_nationkey").agg(of(k % 5 != 0, "selected"), of(k % 5 == 0, "refused"), of(k % 7 == 0, "stub_todos"))
    return quality.coverage(groups).withColumn("limit", quality.limits()["coverage"]).withColumn("result", quality.verdict("value", "limit")).drop("limit")


@query(GRAPH_SQL + """, v(id, value, kind) AS (SELECT 'reproducibility', 0.0, 'boolean' UNION ALL SELECT 'schema_validity', NULL, 'boolean' UNION ALL SELECT 'structural_completeness', count(*) FILTER (coalesce(mode, 'ast') = 'ast') / count(*), 'min_ratio' FROM n
UNION ALL SELECT 'relationship_correctness', count(*) FILTER (source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)) / count(*), 'min_ratio' FROM e WHERE kind = 'calls_resolved'
UNION ALL SELECT 'internal_consistency', (SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM n GROUP BY kind, id)) + (SELECT count(*) FROM n WHERE kind = 'class' AND NOT contains(id, '.')) + (SELECT count(*) FROM n WHERE kind = 'method' AND split_part(id, '#', 1) NOT IN (SELECT id FROM n WHERE kind = 'class')) + (SELECT count(*) FROM e WHERE kind = 'calls_unresolved' AND (source = '' OR target = '')), 'max_count'
UNION ALL SELECT 'golden_graph_agreement', 1.0, 'boolean' UNION ALL SELECT 'semantic_accuracy', NULL, 'score_band')
SELECT id, value, kind AS threshold_kind, CASE WHEN value IS NULL THEN 'skip' WHEN kind = 'boolean' THEN CASE WHEN value <> 0 THEN 'pass' ELSE 'fail' END WHEN kind = 'min_ratio' THEN CASE WHEN value >= 1 THEN 'pass' ELSE 'fail' END WHEN value <= 0 THEN 'pass' ELSE 'fail' END AS result FROM v""")
def graph_scorecard(t):
    """All checks of a graph: two runs that differ, a golden digest that agrees, one check left out."""
    nodes, edges = _graph(t)
    rows = quality.graph_scorecard(nodes.withColumn("name", F.lit("x")), edges, digest="d", golden="d", digests=["d", "e", "d"], skip=["schema_validity"])
    return rows.select("id", "value", F.col("threshold.kind").alias("threshold_kind"), "result")


@query("""
WITH m AS (SELECT 'region:' || r_regionkey AS id, r_name AS name, 'maven' AS tool FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'gradle' FROM nation),
e AS (SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target FROM nation)
SELECT sha256('{"edges":[' || (SELECT string_agg('{"kind":"contains","source":"' || source || '","target":"' || target || '"}', ',' ORDER BY source, target) FROM e) || '],"nodes":['
|| (SELECT string_agg('{"build_tool":"' || tool || '","id":"' || id || '","kind":"module","name":"' || name || '","pom_path":null,"source_roots":["src/main/java"]}', ',' ORDER BY id) FROM m) || '],"projectOverview":null}' || chr(10)) AS digest
""")
def canonical_document(t):
    """Digest of a whole canonical document, streamed in order."""
    row = lambda df, prefix, key, name, tool: df.select(F.col(key).cast("int").alias("module_ord"), _id(prefix, key).alias("module_id"), F.col(name).alias("name"), F.lit(tool).alias("build_tool"), F.lit(None).cast("string").alias("pom_path"), F.array(F.lit("src/main/java")).alias("source_roots"))
    nodes = build.module_nodes(row(t.region, "region", "r_regionkey", "r_name", "maven").union(row(t.nation, "nation", "n_nationkey", "n_name", "gradle")))
    rows = t.nation.select(_id("region", "n_regionkey").alias("source"), _id("nation", "n_nationkey").alias("target"), F.lit(0).cast("long").alias("file_ord"), F.lit(0).alias("n"))
    edges = build._edge(rows, F.col("n"), "contains", "source", "target")
    return t.spark.createDataFrame([(canonical.digest(nodes, edges),)], "digest string")


@query("""
WITH n AS (SELECT 's.S' || s_suppkey AS id, s_suppkey AS k, CASE WHEN s_suppkey % 6 = 5 THEN 'annotation_type' ELSE 'class' END AS kind FROM supplier)
SELECT id, CASE WHEN k % 4 = 1 THEN 'refuse' ELSE 'render' END AS decision, CASE WHEN k % 4 = 1 THEN 'webflux_flux_only' END AS reason FROM n WHERE kind = 'class'
""")
def annotated_decisions(t):
    """Decisions over the return types that the annotation record of a class lists, where it has one."""
    from srcgraph.plans.pipeline import decisions_of

    k = F.col("s_suppkey")
    nodes = t.supplier.select(F.concat(F.lit("s.S"), k).alias("id"), F.when(k % 6 == 5, "annotation_type").otherwise("class").alias("kind"), F.array(F.lit("Service")).alias("annotations"))
    returns = F.when(k % 4 == 1, F.array(F.lit("Flux<A>"))).otherwise(F.array(F.lit("Mono<A>")))
    notes = t.supplier.where("s_suppkey % 4 < 3").select(F.concat(F.lit("s.S"), k).alias("node_id"), F.struct(F.transform(returns, lambda r: F.struct(r.alias("return_type"))).alias("methods")).alias("annotation"))
    return decisions_of(nodes, notes).select("id", "decision", "reason")


@query(TELEMETRY_SQL + "SELECT pass, count(*) AS calls, count(*) FILTER (hit) AS hits FROM t WHERE pass IS NOT NULL AND seq % 10 < 8 GROUP BY pass")
def telemetry_lines(t):
    """Telemetry written as lines and read back; lines that aren't JSON or have no time are passed over."""
    from srcgraph.session import shared_folder

    folder = f"{shared_folder(t.spark)}/telemetry"
    rows = _telemetry(t).withColumn("ts", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    line = F.to_json(F.struct(F.when(F.col("seq") % 10 != 9, F.col("ts")).alias("ts"), "purpose", "cache_hit", "prompt_id"))
    rows.select(F.when(F.col("seq") % 10 == 8, F.lit('{"ts": ')).otherwise(line).alias("value")).write.mode("overwrite").text(folder)
    return telemetry.pass_stats(telemetry.read(t.spark, folder)).select("pass", "calls", "hits")
