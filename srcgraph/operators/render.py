"""Code generation for selected classes: targets as plug-ins, one request per class, scaffold around them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.keys import render as fill
from srcgraph.functions.text import class_summary, kebab, role_suffix

from .annotate import call

_targets: dict[str, Target] = {}


@dataclass(frozen=True)
class Target:
    """How one language is rendered: the files around the classes, by template, and the checks of the result."""

    name: str
    prompt: str
    scaffold: dict[str, str] = field(default_factory=dict)
    domain_module: str | None = None
    checks: dict[str, list[str]] = field(default_factory=dict)


def register(target: Target) -> Target:
    if target.name in _targets:
        raise ValueError(f"target {target.name} is registered already")
    _targets[target.name] = target
    return target


def target(name: str) -> Target:
    try:
        return _targets[name]
    except KeyError:
        raise KeyError(f"unknown target {name}; known: {', '.join(targets())}") from None


def targets() -> list[str]:
    return sorted(_targets)


def clear() -> None:
    _targets.clear()


def nest() -> Target:
    """The TypeScript target."""
    return Target(
        "typescript", "Translate this class to TypeScript for NestJS.\n\n<<summary>>\n\n<<hints>>",
        {
            "package.json": '{\n  "name": "<<name>>",\n  "scripts": {"build": "tsc --noEmit"}\n}\n', "tsconfig.json": '{"compilerOptions": {"strict": true, "experimentalDecorators": true}}\n',
            "src/main.ts": "import { NestFactory } from '@nestjs/core';\nimport { AppModule } from './app.module';\n\nNestFactory.create(AppModule).then((app) => app.listen(3000));\n",
            "src/app.module.ts": "import { Module } from '@nestjs/common';\n<<imports>>\n\n@Module({ imports: [<<modules>>] })\nexport class AppModule {}\n", ".gitignore": "node_modules/\ndist/\n", "README.md": "# <<name>>\n",
        },
        "import { Module } from '@nestjs/common';\n\n@Module({ controllers: [<<controllers>>], providers: [<<providers>>] })\nexport class <<domain>>Module {}\n",
        {"install": "npm install --prefer-offline".split(), "types": "npx tsc --noEmit".split()},
    )


def requests(selected: DataFrame, nodes: DataFrame, decisions: DataFrame, target_: Target) -> DataFrame:
    """(node_id, path, degraded, extraction_mode, input): a prompt for each selected class that isn't refused.

    ``selected(group_name, id)``, ``decisions(id, decision, hints)``. Nodes are joined by id, never by position.
    """
    kept = selected.join(decisions.where("decision = 'render'").select("id", "hints"), "id").join(nodes, "id")
    methods = nodes.where("kind = 'method'").groupBy(F.substring_index("id", "#", 1).alias("id")).agg(F.count("*").alias("methods"))
    rows = kept.join(methods, "id", "left")
    summary = class_summary("name", "stereotype", F.coalesce("annotations", F.array().cast("array<string>")), "superclass", F.coalesce("implements", "extends_interfaces", F.array().cast("array<string>")), "methods")
    hints = F.concat_ws("\n", "hints.security_hint", "hints.webflux_hint")
    body = F.replace(F.replace(F.lit(target_.prompt), F.lit("<<summary>>"), summary), F.lit("<<hints>>"), hints)
    path = F.concat(F.lit("src/"), F.col("group_name").cast("string"), F.lit("/"), kebab("name"), role_suffix("stereotype"))
    return rows.select(F.col("id").alias("node_id"), "group_name", path.alias("path"), F.lit(False).alias("degraded"), F.lit(None).cast("string").alias("extraction_mode"), body.alias("input"))


def generate(requests_: DataFrame, model: Callable[[list[str]], list[str]], **options) -> DataFrame:
    """(path, content, group_name, node_id, error): a failed class has an error and no content."""
    return call(requests_, model, **options).select("path", F.col("output").alias("content"), "group_name", "node_id", "error")


def domain_modules(generated: DataFrame, target_: Target) -> DataFrame:
    """One module file per domain, which lists its controllers and providers by file stem."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.ts$", "")
    names = lambda suffixes: F.array_join(F.array_sort(F.collect_set(F.when(F.regexp_like("path", F.lit(suffixes)), stem))), ", ")
    rows = generated.where("content IS NOT NULL").groupBy("group_name").agg(names(r"\.controller\.ts$").alias("c"), names(r"\.(service|repository|filter)\.ts$").alias("p"))
    body = F.lit(target_.domain_module or "")
    for mark, value in (("controllers", F.col("c")), ("providers", F.col("p")), ("domain", F.initcap("group_name"))):
        body = F.replace(body, F.lit(f"<<{mark}>>"), value)
    return rows.select(F.concat(F.lit("src/"), "group_name", F.lit("/"), "group_name", F.lit(".module.ts")).alias("path"), body.alias("content"))


def scaffold(target_: Target, name: str, groups: list[str]) -> list[tuple[str, str]]:
    """Files around the domains; groups are few."""
    modules = ", ".join(f"{g.title()}Module" for g in groups)
    imports = "\n".join(f"import {{ {g.title()}Module }} from './{g}/{g}.module';" for g in groups)
    return [(path, fill(body, {"name": name, "modules": modules, "imports": imports})) for path, body in target_.scaffold.items()]


def files(generated: DataFrame, target_: Target, name: str, with_scaffold: bool = True) -> DataFrame:
    """All (path, content) of a rendering."""
    out = generated.where("content IS NOT NULL").select("path", "content")
    if target_.domain_module:
        out = out.unionByName(domain_modules(generated, target_))
    if with_scaffold:
        groups = sorted(r.group_name for r in generated.where("content IS NOT NULL").select("group_name").distinct().collect())
        out = out.union(generated.sparkSession.createDataFrame(scaffold(target_, name, groups), "path string, content string"))
    return out
