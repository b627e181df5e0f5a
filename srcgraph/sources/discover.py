"""Modules, source roots and the ordered list of source files of a tree, from its paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ignore import corpus_patterns, ignored

BUILD_FILES = ["pom.xml", "build.gradle", "build.gradle.kts"]
PRUNED = ".git .idea .vscode build target".split()
SOURCE_ROOTS = [f"src/{part}/java" for part in ("main", "test")]


def modules(paths: DataFrame, corpus: str = "corpus") -> DataFrame:
    """(module_id, name, root, build_tool, pom_path, source_roots, module_ord): folders with a build file, parents first.

    A Maven file wins over a Gradle one. Modules are ordered by path, so the order doesn't depend on a file system.
    """
    base, root = F.substring_index("path", "/", -1), F.regexp_replace("path", "/?[^/]*$", "")
    kept = paths.where(~F.regexp_like(F.concat(F.lit("/"), "path"), F.lit("/(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/")))
    found = kept.select("path", base.alias("base"), root.alias("root")).where(F.col("base").isin(*BUILD_FILES))
    own = found.groupBy("root").agg(F.bool_or(F.col("base") == "pom.xml").alias("maven"))
    name = F.when(F.col("root") == "", corpus).otherwise(F.substring_index("root", "/", -1))
    under = kept.select(F.regexp_extract("path", r"^(?:(.*)/)?(src/(?:main|test)/java)/", 1).alias("root"), F.regexp_extract("path", r"^(?:(.*)/)?(src/(?:main|test)/java)/", 2).alias("source_root")).where("source_root <> ''")
    roots = under.groupBy("root").agg(F.array_sort(F.collect_set("source_root")).alias("source_roots"))  # two at most
    rows = own.join(roots, "root", "left")
    # a corpus has far fewer modules than files, and their order is global
    order = F.row_number().over(Window.orderBy(F.when(F.col("root") == "", F.lit("")).otherwise(F.concat("root", F.lit("/"))))) - 1
    return rows.select(
        F.concat(F.lit("mod:"), name).alias("module_id"), name.alias("name"), "root", F.when(F.col("maven"), "maven").otherwise("gradle").alias("build_tool"),
        F.when(F.col("maven"), F.concat(F.when(F.col("root") == "", "").otherwise(F.concat("root", F.lit("/"))), F.lit("pom.xml"))).alias("pom_path"), F.coalesce("source_roots", F.array().cast("array<string>")).alias("source_roots"), order.alias("module_ord"),
    )


def source_files(files: DataFrame, modules_: DataFrame, own_patterns: list[str] | None = None, module_patterns: dict[str, list[str]] | None = None, suffix: str = ".java") -> DataFrame:
    """(file_ord, module_id, path, ...) of the files below a module's source roots that no pattern ignores.

    A file belongs to the module whose root comes right before its source root, which is an equi-join and
    leaves each file to one module. Ordinals follow module, source root and path; they come from a distributed
    sort, and only their order counts.
    """
    split = r"^(?:(.*)/)?(src/(?:main|test)/java)/"
    rows = files.where(F.col("path").endswith(suffix)).withColumns({"root": F.regexp_extract("path", split, 1), "__src": F.regexp_extract("path", split, 2)}).where("__src <> ''")
    rows = rows.where(~ignored("path", corpus_patterns(own_patterns or [])))
    joined = rows.join(modules_.select("root", "module_id", "module_ord"), "root")
    gone = F.lit(False)
    for module, patterns in (module_patterns or {}).items():
        inside = F.when(F.col("root") == "", F.col("path")).otherwise(F.substr(F.col("path"), F.length("root") + 2))
        gone = F.when(F.col("module_id") == module, ignored(inside, patterns)).otherwise(gone)
    kept = joined.where(~gone)
    # ordered by partition of the sort first, so the ordinals grow with it
    place = kept.orderBy("module_ord", "__src", "path").withColumn("file_ord", F.monotonically_increasing_id())
    return place.select("file_ord", "module_id", *files.columns)


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.count_distinct("module_id").alias("modules"))
