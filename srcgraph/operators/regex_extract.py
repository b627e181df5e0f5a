"""Structure of Java sources by regular expressions alone, as columns; nothing leaves code generation.

Best effort: the first declaration counts even inside a comment, constructors come out as methods of type
``public`` and method ids have no parameter types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.text import blank_to_null, first_in
from srcgraph.schemas import PARSED_FIELDS, STEREOTYPES

_FLAGS = "(?mdU)"
PACKAGE = _FLAGS + r"^\s*package\s+(\w[.\w]*)\s*;"
IMPORT = _FLAGS + r"^\s*import(?:\s+static)?\s+([*.\w]+)\s*;"
TAG = r"(?U)@(\w+)"
TYPE = _FLAGS + r"(?<![^\s])(?:(?:sealed|static|final|abstract|private|protected|public)\s+)*(record|enum|class|@?interface)\s+(\w+)"
_MEMBER = _FLAGS + r"^\s{4,}(?:(?:%s)\s+)%s(\w[<>\[\]\w]*)\s+(\w+)\s*%s"
FIELD = _MEMBER % ("transient|volatile|final|static|protected|private|public", "+", r"(?:[=;,]|//)")
METHOD = _MEMBER % ("default|native|synchronized|abstract|final|static|private|protected|public", "*", r"\(")
SIGNATURE = r"(?U)(?:native|synchronized|abstract|final|static|protected|private|public)\s+[ ,?<>\[\]\w]+\s+\w+\s*[(](?:[^)])*[)](?:\s*throws\s+[,\s\w]+)?\s*[;{]"
NOISE = "assert case catch default do else for if new return switch throw try while".split()


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _zip(types: Column, names: Column) -> Column:
    return F.zip_with(types, names, lambda t, n: F.struct(t.alias("t"), n.alias("n")))


def package(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, PACKAGE, 1))


def imports(text: Column) -> Column:
    return _all(text, IMPORT, 1)


def type_kind(text: Column) -> Column:
    word = F.regexp_extract(text, TYPE, 1)
    return F.when(word == "@interface", "annotation_type").otherwise(blank_to_null(word))


def type_name(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, TYPE, 2))


def preamble_tags(text: Column) -> Column:
    """Annotation names before the first type declaration, each once."""
    at = F.regexp_instr(text, F.lit(TYPE))
    before = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
    return F.array_distinct(_all(before, TAG, 1))


def signatures(text: Column) -> Column:
    """Method signatures, for sources too long to be shown whole."""
    return F.transform(_all(text, SIGNATURE, 0), F.trim)



def fields(text: Column, owner: Column) -> Column:
    pairs = _zip(_all(text, FIELD, 1), _all(text, FIELD, 2))
    usable = F.filter(pairs, lambda p: ~p["t"].isin(*NOISE) & (F.length(p["t"]) >= 2))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    make = lambda p: F.struct(F.concat(owner, F.lit("."), p["n"]).alias("id"), p["n"].alias("name"), p["t"].alias("type"), empty.alias("modifiers"), empty.alias("annotations"), F.lit(False).alias("is_autowired"), F.lit(False).alias("is_id"), none.alias("injection_type"), none.alias("qualifier"), none.alias("generation"), F.lit(None).alias("column"), empty.alias("constraints"))
    return F.transform(usable, make).cast(PARSED_FIELDS["fields"])


def methods(text: Column, owner: Column) -> Column:
    pairs = _zip(_all(text, METHOD, 1), _all(text, METHOD, 2))
    usable = F.filter(pairs, lambda p: ~p["t"].isin(*NOISE) & ~p["n"].isin(*NOISE))
    none, empty, zero = F.lit(None), F.array().cast("array<string>"), F.lit(0)
    make = lambda p: F.struct(F.concat(owner, F.lit("#"), p["n"], F.lit("()")).alias("id"), p["n"].alias("name"), p["t"].alias("return_type"), empty.alias("modifiers"), empty.alias("annotations"), F.lit(False).alias("is_constructor"), F.array(zero, zero).alias("line_range"), F.array().alias("parameters"), F.lit(False).alias("is_bean_factory"), F.lit(False).alias("exception_handler"), F.lit(False).alias("response_body"), none.alias("response_status"), none.alias("http_metadata"), none.alias("cyclomatic_complexity"), none.alias("cognitive_complexity"), none.alias("method_loc"), empty.alias("calls"), none.alias("accessed_fields"), none.alias("is_synthesised"))
    return F.transform(usable, make).cast(PARSED_FIELDS["methods"])


def extract(files: DataFrame) -> DataFrame:
    """One parsed row per file (path, text, and whatever else it has).

    A null text, or one without a declaration, gives a class named after the file, whose id says so.
    """
    text, path = F.col("text"), F.col("path")
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.java$", "")
    found = files.withColumns({"__kind": type_kind(text), "__name": type_name(text), "__package": package(text)})
    stub = lambda name: F.concat(F.lit("file:"), path, F.lit("#"), name)
    known = F.col("__kind").isNotNull()
    own = F.when(known & F.col("__package").isNotNull(), F.concat_ws(".", "__package", "__name")).otherwise(stub(F.coalesce("__name", stem)))
    found = found.withColumn("__id", own)
    tags = F.coalesce(preamble_tags(text), F.array().cast("array<string>"))
    columns = {
        "kind": F.coalesce("__kind", F.lit("class")), "id": F.col("__id"), "name": F.coalesce("__name", stem), "source_file": path, "extraction_mode": F.lit("regex"),
        "annotations": F.when(known, tags).otherwise(F.array().cast("array<string>")), "imports": F.when(known, imports(text)).otherwise(F.array().cast("array<string>")),
        "stereotype": F.when(known, first_in(tags, STEREOTYPES)), "entry_point": F.when(known, F.array_contains(tags, "SpringBootApplication")),
        "fqcn_resolved": known & F.col("__package").isNotNull(), "fields": F.when(known, fields(text, F.col("__id"))), "methods": F.when(known, methods(text, F.col("__id"))),
    }
    rest = [c for c in files.columns if c not in ("text", "path")]
    # always true, but as it isn't deterministic no filter on these columns is computed from the text again below them
    once = F.spark_partition_id() >= 0
    return found.select(*rest, *((F.when(once, columns[k]) if k in columns else F.lit(None)).cast(t).alias(k) for k, t in PARSED_FIELDS.items()))
