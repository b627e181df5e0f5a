"""The Java scanner and what is built on it, over sources whose facts SQL knows: every part is written as a file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.operators import build, java_scan
from srcgraph.queries import Tables, query, spread
from srcgraph.schemas import PARSED_FIELDS
from srcgraph.session import durable

_SERVICE = '''package shop.s$size;

import java.util.List;
import shop.dep.Dep$dep;
import static shop.base.Util.help;
import shop.all.*;

$first$tags
public class Part$p extends Base$base implements Runnable, Named<Part$p> {
    @Autowired @Qualifier("q$size")
    private Dep$dep dep;
    @Id @GeneratedValue(strategy = GenerationType.IDENTITY)
    @Column(name = "c$size", nullable = $even, length = $size)
    @NotNull @Size(max = 3)
    protected Long id;
    @Column("marker")
    private final List<String> all = null, more[] = null;
    static int count;

    public Part$p(Dep$dep dep) {
        this.dep = dep;
    }

    @$verb("/parts/$size")
    @ResponseBody
    @ResponseStatus(HttpStatus.OK)
    public List<String> find(@PathVariable("k") @Valid String key, @RequestParam(name = "n", required = false, defaultValue = "3") int n, @NotBlank Dep$dep other) {
        // if (this) { comment && counts(); }
        if (n > 1 && key != null) {
            for (String s : all) {
                dep.use(s);
            }
        } else {
            help(more.size(), "a.b(c)");
        }
        return n > 2 ? all : other.list(key);
    }

    @Bean
    Dep$dep make() {
        return dep.make(find("a", 1, null));
    }

    @ExceptionHandler
    abstract void fail(int... xs);

    static void tick() { count++; }
}
'''
_LOMBOK = '''package shop.s$size;

import lombok.*;

$lombok
public class Part$p {
    private boolean open;
    private final String label = null;
    @NonNull private Integer size;
    static int total;

    public String getLabel() { return label; }
}
'''
_INTERFACE = '''package shop.s$size;

@FunctionalInterface
public interface Part$p extends Alpha, Beta<String> {
    @RequestMapping(path = "/run", method = RequestMethod.POST)
    String run(@RequestBody Part$p body, @RequestHeader("h") String h, @ModelAttribute String m);

    default int two() {
        return a || b && c ? 1 : 2;
    }
}
'''
_ENUM = '''package shop.s$size;

public enum Part$p implements Named {
    RED, @Deprecated GREEN(1), BLUE { void x() { } };

    private int code;
}
'''
_RECORD = '''package shop.s$size;

public record Part$p(String name, List<Map<String, Integer>> sizes) implements Named {
    int twice() { return 2 * sizes.size(); }
}
'''
_ANNOTATION = '''package shop.s$size;

public @interface Part$p {
    String value() default "x";
    int size();
}
'''
_BROKEN = '''package shop.s$size;

@Service
public class Part$p {
    private String name = ((;
}
'''


def _fill(template: str, **columns: Column) -> Column:
    pieces = re.split(r"\$(\w+?)(?=\W|[A-Z]|\$|$)", template)
    return F.concat(*(columns[x] if k % 2 else F.lit(x) for k, x in enumerate(pieces)))


def _files(t: Tables) -> DataFrame:
    """Parts as Java files, (file_ord, module_id, path, text), of every kind; some can't be parsed."""
    k, p = F.col("p_partkey"), F.col("p_partkey").cast("string")
    of = lambda n, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (k % n + 1).cast("int"))
    fills = {
        "p": p, "size": F.col("p_size").cast("string"), "dep": (k % 7).cast("string"), "base": (k % 3).cast("string"), "even": of(2, "true", "false"),
        "first": F.when(k % 4 == 0, F.concat(F.lit("class Helper"), p, F.lit(" { int x; }\n\n"))).otherwise(""),
        "tags": of(5, "@Entity\n@Table(name = \"t_parts\")", "@Entity @Service", "@RestController\n@SpringBootApplication", "@Component @Repository", "@Audited"),
        "verb": of(11, "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping"),
        "lombok": of(5, "@Data", "@Getter @Setter", "@Value", "@NoArgsConstructor @AllArgsConstructor @RequiredArgsConstructor", "@Builder"),
    }
    text = F.when(k % 23 == 0, _fill(_BROKEN, **fills))
    for n, template in enumerate((_SERVICE, _SERVICE, _LOMBOK, _INTERFACE, _ENUM, _RECORD, _ANNOTATION)):
        text = text.when(k % 7 == n, _fill(template, **fills))
    return spread(t.part.select("p_partkey", "p_size")).select(k.cast("long").alias("file_ord"), F.lit("mod:shop").alias("module_id"), F.concat(F.lit("src/Part"), p, F.lit(".java")).alias("path"), text.alias("text"))


def _parsed(t: Tables, *columns: str) -> DataFrame:
    return java_scan.extract(_files(t), columns=columns or tuple(PARSED_FIELDS))


#: What a type says of itself, without its members.
_OWN = tuple(k for k in PARSED_FIELDS if k not in ("fields", "methods"))


def _list(column, by=None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.transform(c, by) if by else c, ",")


JAVA_SQL = """
WITH j AS (SELECT p_partkey AS k, p_size AS size, 'Part' || p_partkey AS name, 'shop.s' || p_size || '.Part' || p_partkey AS id, 'Dep' || p_partkey % 7 AS dep,
  CASE WHEN p_partkey % 23 = 0 THEN 'broken' ELSE ['service', 'service', 'lombok', 'interface', 'enum', 'record', 'annotation_type'][p_partkey % 7 + 1] END AS form,
  ['Data', 'Getter,Setter', 'Value', 'NoArgsConstructor,AllArgsConstructor,RequiredArgsConstructor', 'Builder'][p_partkey % 5 + 1] AS lombok, p_partkey % 5 AS tag,
  2 * (p_partkey % 4 = 0)::INT AS shift, (p_partkey % 5 IN (0, 2))::INT AS more FROM part)
"""


@query(JAVA_SQL + """SELECT id, CASE WHEN form IN ('service', 'lombok', 'broken') THEN 'class' ELSE form END AS kind, name, CASE form WHEN 'broken' THEN 'regex' ELSE 'ast' END AS extraction_mode,
CASE form WHEN 'service' THEN ['Entity,Table', 'Entity,Service', 'RestController,SpringBootApplication', 'Component,Repository', 'Audited'][tag + 1] WHEN 'lombok' THEN lombok WHEN 'interface' THEN 'FunctionalInterface' WHEN 'broken' THEN 'Service' ELSE '' END AS annotations,
CASE form WHEN 'service' THEN 'java.util.List,shop.dep.' || dep || ',shop.base.Util.help,shop.all' WHEN 'lombok' THEN 'lombok' ELSE '' END AS imports,
CASE form WHEN 'service' THEN ['Entity', 'Entity', 'RestController', 'Component', NULL][tag + 1] WHEN 'broken' THEN 'Service' END AS stereotype,
CASE WHEN form = 'service' AND tag = 0 THEN 't_parts' WHEN form = 'service' AND tag = 1 THEN lower(name) END AS table_name, CASE WHEN form IN ('service', 'lombok', 'broken') THEN form = 'service' AND tag = 2 END AS entry_point,
CASE form WHEN 'service' THEN 'Base' || k % 3 END AS superclass, CASE WHEN form = 'service' THEN 'Runnable,Named' WHEN form IN ('enum', 'record') THEN 'Named' WHEN form = 'lombok' THEN '' END AS implements,
CASE form WHEN 'interface' THEN 'Alpha,Beta' END AS extends_interfaces, CASE form WHEN 'enum' THEN 'RED,GREEN,BLUE' END AS constants, CASE form WHEN 'record' THEN 'name:String,sizes:List<Map<String, Integer>>' END AS components,
CASE form WHEN 'annotation_type' THEN 'value:String:"x",size:int:' END AS elements,
CASE form WHEN 'service' THEN (8 + shift) || '-' || (48 + shift + more) WHEN 'lombok' THEN '5-13' WHEN 'interface' THEN '3-11' WHEN 'enum' THEN '3-7' WHEN 'record' THEN '3-5' WHEN 'annotation_type' THEN '3-6' END AS lines FROM j""")
def java_types(t):
    """The type that a file stands for, of each kind: the public one of the file's name, not a helper before it."""
    rows = _parsed(t, *_OWN)
    pair = lambda p: F.concat(p["name"], F.lit(":"), p["type"])
    return rows.select("id", "kind", "name", "extraction_mode", F.coalesce(_list("annotations"), F.lit("")).alias("annotations"), F.coalesce(_list("imports"), F.lit("")).alias("imports"), "stereotype", "table_name", "entry_point", "superclass", _list("implements").alias("implements"), _list("extends_interfaces").alias("extends_interfaces"), _list("constants").alias("constants"), _list("components", pair).alias("components"), _list("elements", lambda e: F.concat(pair(e), F.lit(":"), F.coalesce(e["default_value"], F.lit("")))).alias("elements"), F.array_join(F.col("line_range").cast("array<string>"), "-").alias("lines"))


@query(JAVA_SQL + """, f(form, name, type, modifiers, annotations, constraints, wired, is_id) AS (VALUES
  ('service', 'dep', NULL, 'private', 'Autowired,Qualifier', '', true, false), ('service', 'id', 'Long', 'protected', 'Id,GeneratedValue,Column,NotNull,Size', 'NotNull,Size', false, true),
  ('service', 'all', 'List<String>', 'private,final', 'Column', '', false, false), ('service', 'more', 'List<String>[]', 'private,final', 'Column', '', false, false), ('service', 'count', 'int', 'static', '', '', false, false),
  ('lombok', 'open', 'boolean', 'private', '', '', false, false), ('lombok', 'label', 'String', 'private,final', '', '', false, false), ('lombok', 'size', 'Integer', 'private', 'NonNull', '', false, false), ('lombok', 'total', 'int', 'static', '', '', false, false))
SELECT j.id || '.' || f.name AS id, coalesce(f.type, dep) AS type, modifiers, f.annotations, constraints, wired AS is_autowired, is_id, CASE WHEN wired THEN 'field' END AS injection_type, CASE WHEN wired THEN 'q' || size END AS qualifier,
CASE WHEN is_id THEN 'GenerationType.IDENTITY' END AS generation, CASE WHEN is_id THEN 'c' || size END AS column_name, CASE WHEN is_id THEN k % 2 = 0 END AS nullable, CASE WHEN is_id THEN size END AS length FROM j JOIN f USING (form)""")
def java_fields(t):
    """A row for each declarator, with injection, identity, column and constraints."""
    f = _parsed(t, "extraction_mode", "fields").where("extraction_mode = 'ast'").select(F.explode("fields").alias("f")).select("f.*")
    return f.select("id", "type", _list("modifiers").alias("modifiers"), _list("annotations").alias("annotations"), _list("constraints").alias("constraints"), "is_autowired", "is_id", "injection_type", "qualifier", "generation", F.col("column.name").alias("column_name"), F.col("column.nullable").alias("nullable"), F.col("column.length").alias("length"))


_METHODS_SQL = """, m(form, place, name, parameters, returns, modifiers, annotations, bean, handler, body, status, lines, loc, cc, cog, calls, fields) AS (VALUES
  ('service', 0, 'find', 'String,int,@', 'List<String>', 'public', '*,ResponseBody,ResponseStatus', false, false, true, 'HttpStatus.OK', 24, 14, 5, 4, 'dep.use(s)|help(more.size(), "a.b(c)")|more.size()|other.list(key)', 'all,dep,more'),
  ('service', 1, 'make', '', '@', '', 'Bean', true, false, false, NULL, 39, 4, 1, 0, 'dep.make(find("a", 1, null))|find("a", 1, null)', 'dep'),
  ('service', 2, 'fail', 'int', 'void', 'abstract', 'ExceptionHandler', false, true, false, NULL, 44, NULL, NULL, NULL, '', ''),
  ('service', 3, 'tick', '', 'void', 'static', '', false, false, false, NULL, 47, 1, 1, 0, '', 'count'),
  ('service', 4, '#', '@', '#', 'public', '', false, false, false, NULL, 20, 3, 1, 0, '', 'dep'),
  ('lombok', 0, 'getLabel', '', 'String', 'public', '', false, false, false, NULL, 12, 1, 1, 0, '', 'label'),
  ('interface', 0, 'run', '#,String,String', 'String', '', 'RequestMapping', false, false, false, NULL, 5, NULL, NULL, NULL, '', ''),
  ('interface', 1, 'two', '', 'int', 'default', '', false, false, false, NULL, 8, 3, 4, 2, '', '')),
x AS (SELECT j.*, m.* EXCLUDE (form, name), replace(replace(m.name, '#', j.name), '@', dep) AS method, replace(replace(m.parameters, '#', j.name), '@', dep) AS given, replace(replace(m.returns, '#', j.name), '@', dep) AS return_type,
  ['GetMapping', 'PostMapping', 'PutMapping', 'DeleteMapping', 'PatchMapping', 'RequestMapping', 'GetMapping', 'PostMapping', 'PutMapping', 'DeleteMapping', 'PatchMapping'][k % 11 + 1] AS verb FROM j JOIN m USING (form)),
y AS (SELECT *, id || '#' || method || '(' || given || ')' AS method_id FROM x)
"""


def _methods(t: Tables) -> DataFrame:
    return _parsed(t, "extraction_mode", "id", "name", "methods").where("extraction_mode = 'ast'").select("id", "name", F.posexplode("methods").alias("place", "m")).where("NOT m.is_synthesised")


@query(JAVA_SQL + _METHODS_SQL + """SELECT method_id, CASE WHEN form = 'lombok' THEN 0 ELSE place END::INT AS place, return_type, modifiers, replace(annotations, '*', verb) AS annotations, place = 4 AS is_constructor, bean AS is_bean_factory, handler AS exception_handler, body AS response_body, status AS response_status,
CASE WHEN place = 0 AND form = 'service' THEN CASE verb WHEN 'RequestMapping' THEN NULL ELSE upper(replace(verb, 'Mapping', '')) END WHEN place = 0 AND form = 'interface' THEN 'POST' END AS http_method, CASE WHEN place = 0 AND form = 'service' THEN '/parts/' || size WHEN place = 0 AND form = 'interface' THEN '/run' END AS http_path FROM y""")
def java_methods(t):
    """Methods, then constructors, in source order, with their flags and HTTP mapping."""
    return _methods(t).select(F.col("m.id").alias("method_id"), "place", "m.return_type", _list("m.modifiers").alias("modifiers"), _list("m.annotations").alias("annotations"), *(F.col(f"m.{c}") for c in ("is_constructor", "is_bean_factory", "exception_handler", "response_body", "response_status")), F.col("m.http_metadata.method").alias("http_method"), F.col("m.http_metadata.path").alias("http_path"))


@query(JAVA_SQL + _METHODS_SQL + """SELECT method_id, loc::INT AS method_loc, cc::INT AS cyclomatic, cog::INT AS cognitive, CASE form WHEN 'service' THEN lines + shift + more ELSE lines END::INT AS first_line FROM y""")
def java_metrics(t):
    """Length, cyclomatic and cognitive complexity of each method; a method without a body has none."""
    return _methods(t).select(F.col("m.id").alias("method_id"), "m.method_loc", F.col("m.cyclomatic_complexity").alias("cyclomatic"), F.col("m.cognitive_complexity").alias("cognitive"), F.get("m.line_range", F.lit(0)).alias("first_line"))


@query(JAVA_SQL + _METHODS_SQL + """SELECT method_id, (generate_subscripts(string_split(calls, '|'), 1) - 1)::INT AS place, unnest(string_split(calls, '|')) AS call FROM y WHERE calls <> ''""")
def java_calls(t):
    """Every call of every method as text, also those within the arguments of others."""
    return _methods(t).select(F.col("m.id").alias("method_id"), F.posexplode("m.calls").alias("place", "call"))


@query(JAVA_SQL + _METHODS_SQL + """SELECT method_id, unnest(string_split(fields, ',')) AS field FROM y WHERE fields <> ''""")
def java_accessed_fields(t):
    return _methods(t).select(F.col("m.id").alias("method_id"), F.explode("m.accessed_fields").alias("field"))


_PARAMETERS_SQL = """, p(form, method, place, parameter, type, valid, constraints, kind, bound, required, fallback) AS (VALUES
  ('service', 'find', 0, 'key', 'String', true, '', 'path', 'k', true, NULL), ('service', 'find', 1, 'n', 'int', false, '', 'query', 'n', false, '3'), ('service', 'find', 2, 'other', '@', false, 'NotBlank', NULL, NULL, NULL, NULL),
  ('service', 'fail', 0, 'xs', 'int', false, '', NULL, NULL, NULL, NULL), ('service', '#', 0, 'dep', '@', false, '', NULL, NULL, NULL, NULL),
  ('interface', 'run', 0, 'body', '#', false, '', 'body', NULL, true, NULL), ('interface', 'run', 1, 'h', 'String', false, '', 'header', 'h', true, NULL), ('interface', 'run', 2, 'm', 'String', false, '', 'model_attribute', NULL, true, NULL)),
z AS (SELECT y.id, method_id, y.form, p.* EXCLUDE (form, method, type), replace(replace(p.type, '#', y.name), '@', dep) AS type FROM y JOIN p ON p.form = y.form AND replace(p.method, '#', y.name) = y.method)
"""


@query(JAVA_SQL + _METHODS_SQL + _PARAMETERS_SQL + "SELECT method_id, place::INT AS place, parameter, type, valid AS validate, constraints, kind, bound AS bound_name, required, fallback AS default_value FROM z")
def java_parameters(t):
    """Parameters with their constraints and what of a request they are bound to."""
    rows = _methods(t).select(F.col("m.id").alias("method_id"), F.posexplode("m.parameters").alias("place", "p"))
    return rows.select("method_id", "place", F.col("p.name").alias("parameter"), F.col("p.type").alias("type"), F.col("p.validate").alias("validate"), _list("p.constraints").alias("constraints"), F.col("p.binding.kind").alias("kind"), F.col("p.binding.name").alias("bound_name"), F.col("p.binding.required").alias("required"), F.col("p.binding.default_value").alias("default_value"))


@query(JAVA_SQL + """, s(lombok, place, name, parameters, returns, modifiers) AS (VALUES
  ('Data', 1, 'isOpen', '', 'boolean', 'public'), ('Data', 2, 'setOpen', 'boolean', 'void', 'public'), ('Data', 3, 'getSize', '', 'Integer', 'public'), ('Data', 4, 'setSize', 'Integer', 'void', 'public'),
  ('Data', 5, 'toString', '', 'String', 'public'), ('Data', 6, 'equals', 'Object', 'boolean', 'public'), ('Data', 7, 'hashCode', '', 'int', 'public'), ('Data', 8, '#', 'String,Integer', '#', 'public'),
  ('Getter,Setter', 1, 'isOpen', '', 'boolean', 'public'), ('Getter,Setter', 2, 'setOpen', 'boolean', 'void', 'public'), ('Getter,Setter', 3, 'getSize', '', 'Integer', 'public'), ('Getter,Setter', 4, 'setSize', 'Integer', 'void', 'public'),
  ('Value', 1, 'isOpen', '', 'boolean', 'public'), ('Value', 2, 'getSize', '', 'Integer', 'public'), ('Value', 3, '#', 'boolean,String,Integer', '#', 'public'),
  ('NoArgsConstructor,AllArgsConstructor,RequiredArgsConstructor', 1, '#', '', '#', 'public'), ('NoArgsConstructor,AllArgsConstructor,RequiredArgsConstructor', 2, '#', 'boolean,String,Integer', '#', 'public'), ('NoArgsConstructor,AllArgsConstructor,RequiredArgsConstructor', 3, '#', 'String,Integer', '#', 'public'),
  ('Builder', 1, 'builder', '', '#.Builder', 'public,static'))
SELECT id || '#' || replace(s.name, '#', j.name) || '(' || parameters || ')' AS method_id, place::INT AS place, replace(returns, '#', j.name) AS return_type, modifiers, s.name = '#' AS is_constructor FROM j JOIN s USING (lombok) WHERE form = 'lombok'""")
def java_lombok(t):
    """Members that annotations stand for, none of which is there already by name and number of parameters."""
    rows = _parsed(t, "extraction_mode", "methods").where("extraction_mode = 'ast'").select(F.posexplode("methods").alias("place", "m")).where("m.is_synthesised")
    return rows.select(F.col("m.id").alias("method_id"), "place", "m.return_type", _list("m.modifiers").alias("modifiers"), "m.is_constructor")


@query(JAVA_SQL + """, v(lombok, wmc, lcom4) AS (VALUES ('Data', 9, 9), ('Getter,Setter', 5, 5), ('Value', 4, 4), ('NoArgsConstructor,AllArgsConstructor,RequiredArgsConstructor', 4, 4), ('Builder', 2, 1))
SELECT id, CASE form WHEN 'service' THEN 8 ELSE wmc END AS wmc, CASE form WHEN 'service' THEN 1 WHEN 'lombok' THEN CASE j.lombok WHEN 'Builder' THEN 1 ELSE 0 END END AS cbo, CASE form WHEN 'service' THEN 2 ELSE v.lcom4 END AS lcom4
FROM j LEFT JOIN v ON v.lombok = j.lombok AND form = 'lombok' WHERE form IN ('service', 'lombok')""")
def java_class_metrics(t):
    """Weighted methods, coupling and lack of cohesion of each class."""
    return _parsed(t, "extraction_mode", "kind", "id", "wmc", "cbo", "lcom4").where("extraction_mode = 'ast' AND kind = 'class'").select("id", "wmc", "cbo", "lcom4")


_DEP = '''package shop.dep;

import java.util.List;

public class Dep$d {
    void use(String s) { }
    Object make(Object a) { return a; }
    List<String> list(String key) { return null; }
    List<String> list(int key) { return null; }
}
'''
_BASE = '''public abstract class Base$d {
}
'''
_OWNER = '''package shop.rel;

import java.util.*;
import shop.dep.Dep$d;

@Entity
public class Owner$p {
    @OneToMany(mappedBy = "x") @NotNull
    private List<Dep$d> many;
    @Basic @ManyToOne
    Optional<Dep$d> one;
    @OneToOne
    Unknown other;
    @Basic
    private Dep$d plain;
    @Inject
    private Dep$d wired;
}
'''


def _more_files(t: Tables) -> DataFrame:
    """The types that the parts' files name, and entities with relations to them."""
    file = lambda df, key, folder, name, text: df.select((F.col(key) + 100_000_000).cast("long").alias("file_ord"), F.lit("mod:shop").alias("module_id"), F.concat(F.lit(f"src/{folder}{name}"), F.col(key), F.lit(".java")).alias("path"), text.alias("text"))
    s = lambda c: F.col(c).cast("string")
    deps = file(t.nation, "n_nationkey", "dep/", "Dep", _fill(_DEP, d=s("n_nationkey")))
    bases = file(t.region, "r_regionkey", "", "Base", _fill(_BASE, d=s("r_regionkey")))
    return deps.union(bases).union(file(t.supplier, "s_suppkey", "rel/", "Owner", _fill(_OWNER, d=s("s_nationkey"), p=s("s_suppkey"))))


def _edges(t: Tables, *kinds: str) -> DataFrame:
    from srcgraph.plans.pipeline import graph_of

    return graph_of(durable(java_scan.extract(_files(t).union(_more_files(t)))), kinds=list(kinds))[1]


@query(JAVA_SQL + _METHODS_SQL + _PARAMETERS_SQL + """, r AS (SELECT method_id AS source, k, id, dep, name FROM y WHERE form = 'service' AND method = 'find'), o AS (SELECT id || '#make()' AS source, method_id AS target FROM y WHERE form = 'service' AND method = 'find')
SELECT source, 'shop.dep.' || dep || '#' || m AS target FROM r, (VALUES ('use(String)'), ('list(String)'), ('list(int)')) v(m)
UNION ALL SELECT id || '#make()', 'shop.dep.' || dep || '#make(Object)' FROM r UNION ALL SELECT source, target FROM o""")
def java_resolved_calls(t):
    """Calls through fields and parameters of imported types, with all overloads, and calls on the own type."""
    return _edges(t, "calls_resolved").select("source", "target")


@query(JAVA_SQL + _METHODS_SQL + """SELECT method_id AS source, call AS raw_call_expr FROM y, (VALUES ('help(more.size(), "a.b(c)")'), ('more.size()')) v(call) WHERE form = 'service' AND method = 'find'""")
def java_unresolved_calls(t):
    """Calls of what no import, field or parameter tells the type of."""
    return _edges(t, "calls_unresolved").select("source", "raw_call_expr")


@query(JAVA_SQL + """SELECT id AS source, target FROM j, (VALUES (0), (1)) v(n), LATERAL (SELECT CASE n WHEN 0 THEN 'shop.dep.' || dep ELSE 'Base' || k % 3 END AS target) x WHERE form = 'service'
UNION ALL SELECT 'shop.rel.Owner' || s_suppkey, 'shop.dep.Dep' || s_nationkey FROM supplier""")
def java_depends_on(t):
    """Types of the corpus that imports, fields and parameters name, and supertypes by import or as they are written."""
    return _edges(t, "depends_on").select("source", "target")


@query("SELECT 'shop.rel.Owner' || s_suppkey AS source, 'shop.dep.Dep' || s_nationkey AS target, c AS cardinality FROM supplier, (VALUES ('ONE_TO_MANY'), ('MANY_TO_ONE')) v(c)")
def java_relations(t):
    """Relations of entities to what their fields hold, out of collections and optionals."""
    return _edges(t, "relation").select("source", "target", "cardinality")


@query(JAVA_SQL + """SELECT id || '.dep' AS source, dep AS target, 'autowires' AS kind, 'q' || size AS qualifier FROM j WHERE form = 'service' UNION ALL SELECT id || '#make()', dep, 'bean_factory', NULL FROM j WHERE form = 'service'
UNION ALL SELECT 'shop.rel.Owner' || s_suppkey || '.wired', 'Dep' || s_nationkey, 'autowires', NULL FROM supplier""")
def java_injections(t):
    """From injected fields to their types and from factory methods to what they make, both as written."""
    return _edges(t, "autowires", "bean_factory").select("source", "target", "kind", "qualifier")


@query(JAVA_SQL + """, k(form, fields, methods) AS (VALUES ('service', 5, 5), ('lombok', 4, 1), ('interface', 0, 2), ('enum', 0, 0), ('record', 0, 0), ('annotation_type', 0, 0), ('broken', 1, 0)),
s AS (SELECT j.*, fields + methods + CASE WHEN form = 'lombok' THEN CASE lombok WHEN 'Data' THEN 8 WHEN 'Getter,Setter' THEN 4 WHEN 'Builder' THEN 1 ELSE 3 END ELSE 0 END AS members FROM j JOIN k USING (form))
SELECT source, count(*)::BIGINT AS n FROM (SELECT 'mod:shop' AS source FROM part UNION ALL SELECT 'mod:shop' FROM nation UNION ALL SELECT 'mod:shop' FROM region UNION ALL SELECT 'mod:shop' FROM supplier
  UNION ALL SELECT id FROM s, range(members) UNION ALL SELECT 'shop.dep.Dep' || n_nationkey FROM nation, range(4) UNION ALL SELECT 'shop.rel.Owner' || s_suppkey FROM supplier, range(5)) GROUP BY source""")
def java_contains(t):
    """How many types a module, and members a type, contains; members are named after their type."""
    own = F.when(F.col("source").startswith("mod:"), True).otherwise(F.col("target").startswith(F.concat("source", F.lit("."))) | F.col("target").startswith(F.concat("source", F.lit("#"))))
    return _edges(t, "contains").groupBy("source").agg(F.count_if(own).alias("n"))


@query(JAVA_SQL + _METHODS_SQL + _PARAMETERS_SQL + """SELECT method_id, place::INT AS place, parameter AS name, type, nullif(constraints, '') AS constraints, kind AS bound_to, bound AS bound_name, CASE WHEN kind IS NOT NULL THEN required END AS required FROM z""")
def java_node_parameters(t):
    """Parameters as the nodes of methods hold them, without defaults and with empty lists as null."""
    rows = build.method_nodes(build.method_rows(_parsed(t))).select(F.col("id").alias("method_id"), F.posexplode("parameters").alias("place", "p"), "cyclomatic_complexity", "method_loc").where("method_loc IS NULL OR method_loc > 0")
    return rows.select("method_id", "place", "p.name", "p.type", _list("p.constraints").alias("constraints"), F.col("p.binding.kind").alias("bound_to"), F.col("p.binding.name").alias("bound_name"), F.col("p.binding.required").alias("required"))


@query(JAVA_SQL + """SELECT id, CASE form WHEN 'broken' THEN 'regex_fallback' ELSE 'ast' END AS extraction_mode, form <> 'broken' AS scanned, CASE form WHEN 'service' THEN 'IDENTITY' END AS generation FROM j WHERE form IN ('service', 'lombok', 'broken')""")
def java_class_nodes(t):
    """Classes as nodes: where they come from, and the strategy of their identity, both from closed lists."""
    parsed = _parsed(t)
    of = build.field_nodes(build.field_rows(parsed)).where("is_id").select(F.regexp_replace("id", r"\.[^.]*$", "").alias("id"), "generation")
    return build.type_nodes(parsed).where("kind = 'class'").drop("generation").join(of.hint("merge"), "id", "left").select("id", "extraction_mode", (F.col("line_range")[0] > 0).alias("scanned"), "generation")


def _sql_text(template: str, first: int, last: int) -> str:
    """Lines of a template as an SQL expression over the columns of ``j``."""
    lines = "\n".join(template.split("\n")[first - 1 : last])
    return "'" + lines.replace("'", "''").replace("$p", "' || k || '").replace("$size", "' || size || '").replace("\n", "' || chr(10) || '") + "'"


@query(JAVA_SQL + f"""SELECT id, CASE form WHEN 'enum' THEN '{{"annotations":null,"constants":["BLUE","GREEN","RED"],"id":"' || id || '","implements":["Named"],"kind":"enum","line_range":[3,7],"modifiers":["public"],"name":"' || name || '","source_file":"src/' || name || '.java"}}'
WHEN 'record' THEN '{{"annotations":null,"components":[{{"name":"name","type":"String"}},{{"name":"sizes","type":"List<Map<String, Integer>>"}}],"id":"' || id || '","implements":["Named"],"kind":"record","line_range":[3,5],"name":"' || name || '","source_file":"src/' || name || '.java"}}'
WHEN 'annotation_type' THEN '{{"elements":[{{"name":"value","type":"String","default_value":"\\"x\\""}},{{"name":"size","type":"int","default_value":null}}],"id":"' || id || '","kind":"annotation_type","line_range":[3,6],"modifiers":["public"],"name":"' || name || '","source_file":"src/' || name || '.java"}}'
WHEN 'interface' THEN '{{"annotations":["FunctionalInterface"],"extends_interfaces":["Alpha","Beta"],"id":"' || id || '","kind":"interface","line_range":[3,11],"modifiers":["public"],"name":"' || name || '","source_file":"src/' || name || '.java"}}' END AS line FROM j WHERE form IN ('enum', 'record', 'annotation_type', 'interface')""")
def java_node_json(t):
    """Nodes as canonical JSON: keys and unordered lists sorted, nulls kept."""
    from srcgraph.operators.canonical import node_lines

    return node_lines(build.type_nodes(_parsed(t, *_OWN)).where("kind <> 'class'"))


@query(JAVA_SQL + f"""SELECT id AS node_id, form = 'service' AS degraded, CASE WHEN form = 'service' THEN 'signatures_only' END AS extraction_mode, CASE form WHEN 'enum' THEN sha256({_sql_text(_ENUM, 3, 7)}) WHEN 'record' THEN sha256({_sql_text(_RECORD, 3, 5)}) WHEN 'annotation_type' THEN sha256({_sql_text(_ANNOTATION, 3, 6)})
WHEN 'interface' THEN sha256({_sql_text(_INTERFACE, 3, 11)}) WHEN 'service' THEN NULL END AS input_hash FROM j WHERE form NOT IN ('lombok', 'broken')""")
def java_requests(t):
    """What a model is asked about each type: its lines of its file, or of a long one only the signatures."""
    from srcgraph.operators.annotate import requests, source_nodes, with_source

    files, parsed = _files(t), _parsed(t, *_OWN).where("extraction_mode = 'ast'")
    nodes = build.type_nodes(parsed).where("kind <> 'class' OR size(coalesce(implements, array())) > 0")
    rows = requests(with_source(source_nodes(nodes), files), 500)
    return rows.select("node_id", "degraded", "extraction_mode", F.when(~F.col("degraded"), F.sha2("input", 256)).alias("input_hash"))
