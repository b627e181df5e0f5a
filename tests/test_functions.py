from pyspark.sql import Row
from pyspark.sql import functions as F

from srcgraph.functions import keys, text


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(expression.alias("y")).collect()]


def test_calls(spark):
    given = ["ownerRepo.findById(id)", "findById(id)", "this.findById(id)", "Collections.sort(list)", "A.b().c().d()", "a\n  .b(x)"]
    assert column(spark, given, text.callee("x")) == ["ownerRepo", None, None, "Collections", "A", "a"]
    assert column(spark, given, text.called_method("x")) == ["findById", "findById", "findById", "sort", "b", "b"]


def test_types(spark):
    given = ["List<Pet>", "Set<Item>", "Collection<User>", "Optional<Owner>", "Map<String,List<Pet>>", "Owner", "List<Set<A>>"]
    assert column(spark, given, text.element_type("x")) == ["Pet", "Item", "User", "Owner", "Map<String,List<Pet>>", "Owner", "Set<A>"]
    assert column(spark, given, text.without_generics("x"))[4:6] == ["Map", "Owner"]


def test_names(spark):
    assert column(spark, ["OrderService", "HTTPServerError", "a1B"], text.kebab("x")) == ["order-service", "http-server-error", "a1-b"]
    assert column(spark, ["orders", "order-items", "ORDER_x"], text.pascal("x")) == ["Orders", "OrderItems", "OrderX"]
    assert column(spark, ["RestController", "Entity", None, "Component"], text.role_suffix("x")) == [".controller.ts", ".entity.ts", ".ts", ".ts"]
    assert column(spark, ["a.b.C", "C"], text.package_of("x")) == ["a.b", ""]
    assert column(spark, ["/tmp/x.ZIP", "https://h/r.git", "git@h:r", "/src"], text.input_kind("x")) == ["zip", "git", "git", "local"]
    assert column(spark, ["src/orders/a.ts", "src/main.ts", "README.md"], text.domain_dir("x")) == ["orders", None, None]


def test_line_slice(spark):
    rows = [("a\nb\nc\nd", 2, 3), ("a\nb", 0, 0), ("a\nb", None, None), ("a\nb", 5, 9), ("a\x0bb\r\nc", 2, 3)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, b int, e int")
    assert [r[0] for r in df.orderBy("k").select(text.line_slice("t", "b", "e")).collect()] == ["b\nc", "a\nb", "a\nb", "a\nb", "b\nc"]


def test_tail(spark):
    assert column(spark, ["a\nb\nc", "a"], text.last_lines("x", 2)) == ["b\nc", "a"]


def test_cache_key_uses_every_part(spark):
    import hashlib

    parts = ["p", "m", "id", "v", "h", "i", "s", "1"]
    df = spark.createDataFrame([tuple(parts)] + [tuple(p + "!" if k == j else p for j, p in enumerate(parts)) for k in range(8)], [f"c{k}" for k in range(8)])
    got = [r[0] for r in df.select(keys.cache_key(*df.columns)).collect()]
    assert got[0] == hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16] and len(set(got)) == 9


def test_prompt_hash(spark):
    import hashlib

    body = "a  \nb\t\n\nc"
    want = hashlib.sha256(("\n".join(x.rstrip() for x in body.splitlines()) + "\n").encode()).hexdigest()[:8]
    assert column(spark, [body, body + "\n"], keys.prompt_hash("x")) == [want, want]


def test_times(spark):
    got = column(spark, ["2024-01-03T10:00:00Z", "2024-01-03T10:00:00+02:00", "2024-01-03 10:00:00", "soon", None], F.date_format(keys.instant("x"), "yyyy-MM-dd HH:mm"))
    assert got == ["2024-01-03 10:00", "2024-01-03 08:00", "2024-01-03 10:00", None, None]
    assert str(column(spark, ["2024-01-03T10:00:00Z"], keys.week_of(keys.instant("x")))[0]) == "2024-01-01"


def test_retry(spark):
    assert keys.backoff(6) == [1, 2, 4, 8, 16, 30]
    assert column(spark, [0, 2, 6], keys.backoff_column("x"), "int") == [[], [1.0, 2.0], [1.0, 2.0, 4.0, 8.0, 16.0, 30.0]]
    assert column(spark, ["3", "1.5", "Wed, 21 Oct 2015", None], keys.retry_after("x")) == [3.0, 1.5, None, None]
    assert column(spark, [429, 400, 403, 418], keys.error_class("x"), "int") == ["transient", "bad_input", "auth", "unclassified"]


def test_provider(spark):
    df = spark.createDataFrame([("mine", "https://api.openai.com/v1"), ("", "https://api.openai.com/v1"), (None, "http://Box:11434/v1")], "l string, u string")
    assert [r[0] for r in df.select(text.provider_label("l", "u")).collect()] == ["mine", "openai", "box"]


def test_run_id(spark):
    assert column(spark, [keys.run_id(), "x"], keys.is_run_id("x")) == [True, False]


def test_render():
    assert keys.render("a <<x>> b", {"x": "1"}) == "a 1 b"
    assert keys.template_names("<<x>> <<y>>") == {"x", "y"}


def test_log_area(spark):
    df = spark.createDataFrame([Row(c={"area": "io"}, n="a.b"), Row(c={"k": "v"}, n="a.b")])
    assert [r[0] for r in df.select(text.log_area("c", "n")).collect()] == ["io", "b"]
