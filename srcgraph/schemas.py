"""Fixed schemas. Nothing is inferred; unknown keys are dropped when JSON is read with these."""

from __future__ import annotations




COLUMN = "STRUCT<name: STRING, nullable: BOOLEAN, length: INT>"
BINDING = "STRUCT<kind: STRING, name: STRING, required: BOOLEAN, default_value: STRING>"
PARAMETER = f"STRUCT<name: STRING, type: STRING, validate: BOOLEAN, constraints: ARRAY<STRING>, binding: {BINDING}>"
HTTP = "STRUCT<method: STRING, path: STRING>"
FIELD = f"STRUCT<id: STRING, name: STRING, type: STRING, modifiers: ARRAY<STRING>, annotations: ARRAY<STRING>, is_autowired: BOOLEAN, is_id: BOOLEAN, injection_type: STRING, qualifier: STRING, generation: STRING, column: {COLUMN}, constraints: ARRAY<STRING>>"
METHOD = f"STRUCT<id: STRING, name: STRING, return_type: STRING, modifiers: ARRAY<STRING>, annotations: ARRAY<STRING>, is_constructor: BOOLEAN, line_range: ARRAY<INT>, parameters: ARRAY<{PARAMETER}>, is_bean_factory: BOOLEAN, exception_handler: BOOLEAN, response_body: BOOLEAN, response_status: STRING, http_metadata: {HTTP}, cyclomatic_complexity: INT, cognitive_complexity: INT, method_loc: INT, calls: ARRAY<STRING>, accessed_fields: ARRAY<STRING>, is_synthesised: BOOLEAN>"
PAIR = "STRUCT<name: STRING, type: STRING>"
ELEMENT = "STRUCT<name: STRING, type: STRING, default_value: STRING>"

#: What an extractor says about one source file; columns that a kind lacks are null.
PARSED_FIELDS = {
    "kind": "STRING", "id": "STRING", "name": "STRING", "source_file": "STRING", "extraction_mode": "STRING", "annotations": "ARRAY<STRING>", "imports": "ARRAY<STRING>", "line_range": "ARRAY<INT>", "modifiers": "ARRAY<STRING>", "stereotype": "STRING", "superclass": "STRING", "implements": "ARRAY<STRING>", "extends_interfaces": "ARRAY<STRING>", "is_inner_class": "BOOLEAN", "table_name": "STRING", "entry_point": "BOOLEAN", "fqcn_resolved": "BOOLEAN", "wmc": "INT", "cbo": "INT", "lcom4": "INT", "constants": "ARRAY<STRING>",
    "components": f"ARRAY<{PAIR}>", "elements": f"ARRAY<{ELEMENT}>", "fields": f"ARRAY<{FIELD}>", "methods": f"ARRAY<{METHOD}>",
}
PARSED_DDL = ", ".join(f"{k} {v}" for k, v in PARSED_FIELDS.items())

#: Position of a file in the corpus, carried so that "first seen" stays defined after any shuffle.
ORIGIN_DDL = "file_ord BIGINT, module_id STRING"
FILES_DDL = "file_ord BIGINT, module_id STRING, path STRING, text STRING"

GRAPH_PARAMETER = "STRUCT<binding: STRUCT<kind: STRING, name: STRING, required: BOOLEAN>, constraints: ARRAY<STRING>, name: STRING, type: STRING, validate: BOOLEAN>"
NODE_FIELDS = {
    "id": "STRING", "kind": "STRING", "name": "STRING", "source_file": "STRING", "line_range": "ARRAY<INT>", "modifiers": "ARRAY<STRING>", "annotations": "ARRAY<STRING>", "extraction_mode": "STRING", "stereotype": "STRING", "superclass": "STRING", "implements": "ARRAY<STRING>", "extends_interfaces": "ARRAY<STRING>", "is_inner_class": "BOOLEAN", "table_name": "STRING", "entry_point": "BOOLEAN", "fqcn_resolved": "BOOLEAN", "wmc": "INT", "cbo": "INT", "lcom4": "INT", "constants": "ARRAY<STRING>", "components": f"ARRAY<{PAIR}>", "elements": f"ARRAY<{ELEMENT}>",
    "type": "STRING", "is_autowired": "BOOLEAN", "is_id": "BOOLEAN", "generation": "STRING", "column": COLUMN, "constraints": "ARRAY<STRING>",
    "return_type": "STRING", "is_constructor": "BOOLEAN", "parameters": f"ARRAY<{GRAPH_PARAMETER}>", "is_bean_factory": "BOOLEAN", "exception_handler": "BOOLEAN", "response_body": "BOOLEAN", "response_status": "INT", "http_metadata": HTTP, "cyclomatic_complexity": "INT", "cognitive_complexity": "INT", "method_loc": "INT",
    "build_tool": "STRING", "source_roots": "ARRAY<STRING>", "pom_path": "STRING",
}
NODE_DDL = ", ".join(f"`{k}` {v}" for k, v in NODE_FIELDS.items())
EDGE_FIELDS = {"source": "STRING", "target": "STRING", "kind": "STRING", "raw_call_expr": "STRING", "call_count": "INT", "injection_type": "STRING", "qualifier": "STRING", "cardinality": "STRING", "join_column": "STRING"}
EDGE_DDL = ", ".join(f"`{k}` {v}" for k, v in EDGE_FIELDS.items())

#: Properties of each kind as they are written, besides the kind itself.
NODE_KINDS = {
    "module": ["id", "name", "build_tool", "source_roots", "pom_path"],
    "class": ["id", "name", "source_file", "line_range", "extraction_mode", "modifiers", "annotations", "stereotype", "superclass", "implements", "is_inner_class", "table_name", "entry_point", "fqcn_resolved", "wmc", "cbo", "lcom4"],
    "interface": ["id", "name", "source_file", "line_range", "modifiers", "annotations", "extends_interfaces"],
    "enum": ["id", "name", "source_file", "line_range", "modifiers", "constants", "annotations", "implements"],
    "record": ["id", "name", "source_file", "line_range", "components", "annotations", "implements"],
    "annotation_type": ["id", "name", "source_file", "line_range", "modifiers", "elements"],
    "method": ["id", "name", "return_type", "modifiers", "annotations", "is_constructor", "line_range", "parameters", "is_bean_factory", "exception_handler", "response_body", "response_status", "http_metadata", "cyclomatic_complexity", "cognitive_complexity", "method_loc"],
    "field": ["id", "name", "type", "modifiers", "annotations", "is_autowired", "is_id", "generation", "column", "constraints"],
}
EDGE_KINDS = {
    "contains": ["source", "target"],
    "calls_resolved": ["source", "target", "call_count"],
    "calls_unresolved": ["source", "target", "raw_call_expr"],
    "depends_on": ["source", "target"],
    "autowires": ["source", "target", "injection_type", "qualifier"],
    "relation": ["source", "target", "cardinality", "join_column"],
    "bean_factory": ["source", "target"],
}
TYPE_KINDS = "annotation_type class enum interface record".split()
RENDERABLE = "class enum interface record".split()

_ACCESS = "private protected public"
MODIFIERS = {
    kind: f"{_ACCESS} {more}".split()
    for kind, more in {"class": "abstract final static", "interface": "abstract static", "enum": "", "annotation_type": "", "method": "abstract default final native static synchronized", "field": "final static transient volatile"}.items()
}
STEREOTYPES = "Component Configuration Controller ControllerAdvice Entity Repository RestController Service SpringBootApplication".split()
GENERATIONS = "AUTO IDENTITY SEQUENCE TABLE UUID".split()
INJECTIONS = ["field", "constructor", "setter"]
HTTP_METHODS = "DELETE GET HEAD OPTIONS PATCH POST PUT".split()
BINDINGS = "body header model_attribute path query request_param".split()
CONSTRAINTS = "Email Max Min NotBlank NotEmpty NotNull Pattern Size".split()
CARDINALITY = {"OneToOne": "ONE_TO_ONE", "OneToMany": "ONE_TO_MANY", "ManyToOne": "MANY_TO_ONE", "ManyToMany": "MANY_TO_MANY"}
#: Types that say nothing about coupling.
UNCOUPLED = set("""
ArrayList BiFunction boolean Boolean byte Byte char Character Class Cloneable Collection
Comparable Consumer double Double Enum float Float Function HashMap HashSet int
Integer Iterable LinkedHashMap LinkedList List long Long Map Number Object Optional
Predicate Record Set short Short Stream String Supplier var void
""".split())

TELEMETRY_DDL = "run_id STRING, ts STRING, trace_id STRING, pipeline_name STRING, pipeline_run_id STRING, corpus_id STRING, provider STRING, model STRING, override_model STRING, tier STRING, purpose STRING, prompt_id STRING, prompt_version STRING, prompt_content_hash STRING, input_hash STRING, output_hash STRING, input_tokens BIGINT, output_tokens BIGINT, cached_tokens BIGINT, input_estimated BIGINT, cache_hit BOOLEAN, status STRING, error_class STRING, error_message STRING, total_latency_ms BIGINT, attempts ARRAY<STRUCT<attempt: INT, latency_ms: INT, status: STRING, error_class: STRING>>, cost_usd_est DOUBLE, schema_version STRING"
CACHE_DDL = "cache_key STRING, provider STRING, model STRING, tier STRING, purpose STRING, prompt_id STRING, prompt_version STRING, prompt_content_hash STRING, input_hash STRING, schema_hash STRING, max_tokens INT, input_body STRING, output_body STRING, token_usage_json STRING, created_at TIMESTAMP, hit_count INT, last_hit_at TIMESTAMP"
THRESHOLD = "STRUCT<kind: STRING, expected: BOOLEAN, pass_at: DOUBLE, fail_at: DOUBLE>"
CHECKS_DDL = f"scorecard_kind STRING, corpus_id STRING, id STRING, category STRING, result STRING, value DOUBLE, threshold {THRESHOLD}, duration_ms INT, details STRING"
PRICES_DDL = "key STRING, input_usd_per_million DOUBLE, output_usd_per_million DOUBLE, cache_read_usd_per_million DOUBLE"
ANNOTATIONS_DDL = "node_id STRING, degraded BOOLEAN, extraction_mode STRING, annotation STRUCT<node_id: STRING, class_name: STRING, stereotype: STRING, domain_hint: STRING, description: STRING, conversion_notes: STRING, methods: ARRAY<STRUCT<name: STRING, signature: STRING, kind: STRING, return_type: STRING, method_annotations: ARRAY<STRING>, description: STRING, conversion_difficulty: STRING, conversion_notes: STRING, http_metadata: STRUCT<http_method: STRING, path: STRING, request_body_type: STRING, response_type: STRING>>>>"
SYNTHESIS_DDL = "project_overview STRING, domains ARRAY<STRING>, cross_domain_dependencies ARRAY<STRUCT<source: STRING, target: STRING, reason: STRING>>"
LOGS_DDL = "ts STRING, level STRING, run_id STRING, logger STRING, context MAP<STRING, STRING>, msg STRING"
