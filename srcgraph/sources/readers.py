"""Readers of graphs, annotations, scorecards, manifests, prices, settings and prompts."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions.keys import template_names
from srcgraph.operators.assemble import first_wins
from srcgraph.schemas import ANNOTATIONS_DDL, CACHE_DDL, EDGE_DDL, LOGS_DDL, NODE_DDL, PRICES_DDL

CHECK_JSON = "id STRING, category STRING, result STRING, value STRING, threshold STRUCT<kind: STRING, expected: BOOLEAN, pass_at: DOUBLE, fail_at: DOUBLE>, duration_ms INT, details STRING"
MANIFEST_DDL = "schema_version STRING, run_id STRING, tool_version STRING, acquisition_source STRING, corpus_id STRING, created_at STRING, ast_only BOOLEAN, cache_stats MAP<STRING, STRUCT<calls: BIGINT, hits: BIGINT, hit_rate: DOUBLE>>, artefacts MAP<STRING, STRUCT<path: STRING, schema_version: STRING, sha256: STRING>>, evals MAP<STRING, STRUCT<path: STRING, schema_version: STRING, sha256: STRING>>, renders MAP<STRING, STRUCT<path: STRING, schema_version: STRING, sha256: STRING>>"


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a canonical document; keys that the schema doesn't have are dropped."""
    node = NODE_DDL.replace("validate: BOOLEAN", "validate_: BOOLEAN")
    doc = spark.read.schema(f"nodes ARRAY<STRUCT<{_struct(node)}>>, edges ARRAY<STRUCT<{_struct(EDGE_DDL)}>>").option("multiLine", "true").json(path)
    return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))


def _struct(ddl: str) -> str:
    """Top-level columns of a DDL list as struct fields."""
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            word = ""
        else:
            word += c
    return ", ".join(out)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation records, of one node's the last in the file."""
    rows = spark.read.schema(ANNOTATIONS_DDL).option("multiLine", "true").json(path)
    return first_wins(rows.withColumn("__o", -F.monotonically_increasing_id()), ["node_id"], ["__o"]).drop("__o")


def scorecards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Checks of scorecard files; one that isn't a scorecard is skipped."""
    rows = spark.read.schema(f"kind STRING, corpus_id STRING, checks ARRAY<STRUCT<{_struct(CHECK_JSON)}>>").option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", "*-scorecard.json").json(paths)
    checks = rows.where("kind IS NOT NULL AND checks IS NOT NULL").select(F.col("kind").alias("scorecard_kind"), "corpus_id", F.inline("checks"))
    number = F.when(F.lower("value") == "true", 1.0).when(F.lower("value") == "false", 0.0).otherwise(F.col("value").try_cast("double"))
    return checks.withColumn("value", number)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest row; top-level keys of later versions are dropped."""
    return spark.read.schema(MANIFEST_DDL).option("multiLine", "true").json(path)


def cache(spark: SparkSession, folder: str) -> DataFrame | None:
    """The stored responses, or None where none are stored yet."""
    return spark.read.schema(CACHE_DDL).parquet(folder) if Path(folder).exists() else None


def logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOGS_DDL).json(path)


def prices(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(price table, metadata) of a TOML file with a table per provider and model."""
    doc = tomllib.loads(Path(path).read_text())
    meta, rows = doc.pop("metadata", {}), []
    for label, models in doc.items():
        for model, record in models.items():
            own = {k: record[k] for k in ("input_usd_per_million", "output_usd_per_million")} | {"cache_read_usd_per_million": record.get("cache_read_usd_per_million")}
            if not all(isinstance(v, int | float) for v in own.values() if v is not None):
                raise ValueError(f"price of {label}.{model} isn't a number")
            rows.append((f"{label}.{model}".strip().lower(), *(None if v is None else float(v) for v in own.values())))
    return spark.createDataFrame(rows, PRICES_DDL), meta


def _dotenv(path: str | None) -> dict[str, str]:
    """NAME=value lines; quotes around a value and an export before a name are dropped."""
    out = {}
    for line in Path(path).read_text().splitlines() if path and Path(path).exists() else []:
        name, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return out


def _scalar(raw: str):
    raw = raw.split(" #", 1)[0].strip()
    if raw[:1] in ("'", '"'):
        return raw[1:-1]
    if raw.lower() in ("", "~", "null"):
        return None
    try:
        return json.loads(raw.lower() if raw.lower() in ("true", "false") else raw)
    except ValueError:
        return raw


def _yaml(text: str) -> dict:
    """Scalars, lists of scalars and mappings of one level below the top, which is what settings need."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        body = line.strip()
        if not body or body.startswith(("#", "---")):
            continue
        if line[0] not in " \t-":
            key, _, raw = (x.strip() for x in body.partition(":"))
            out[key] = _scalar(raw)
        elif body.startswith("- "):
            out[key] = [*(out[key] or []), _scalar(body[2:])]
        else:
            name, _, raw = body.partition(":")
            out[key] = (out[key] or {}) | {_scalar(name): _scalar(raw)}
    return out


@dataclass
class Settings:
    """Values given in code win over the environment, that over a .env file, that over a settings file (TOML,
    YAML or JSON), that over the defaults."""

    max_concurrent: int = 5
    max_failure_ratio: float = 0.10
    confirm_threshold: int = 100
    max_calls: int | None = None
    max_tokens: int | None = None
    classes_per_domain: int = 3
    security_policy: str = "refuse"
    webflux_policy: str = "translate_mono_only"
    domain_mapping: dict[str, str] = field(default_factory=dict)
    models: dict[str, str] = field(default_factory=dict)
    provider: str = ""
    timeout_seconds: float = 30.0

    def model_for(self, tier: str) -> str:
        """Model of a tier, else the default one; an unknown tier without a default is an error."""
        found = self.models.get(tier) or self.models.get("default")
        if not found:
            raise KeyError(f"no model for tier {tier}")
        return found

    @classmethod
    def load(cls, file: str | None = None, environment: dict[str, str] | None = None, prefix: str = "SRCGRAPH_", dotenv: str | None = None, **given) -> Settings:
        env, known = os.environ if environment is None else environment, {f.name: f for f in fields(cls)}
        env = _dotenv(dotenv) | dict(env)
        stored = {}
        if file and Path(file).exists():
            text = Path(file).read_text()
            stored = tomllib.loads(text) if file.endswith(".toml") else _yaml(text) if file.endswith((".yaml", ".yml")) else json.loads(text)
        values = {k: v for k, v in stored.items() if k in known}
        for name in known:
            if (raw := env.get(prefix + name.upper())) is not None:
                try:
                    values[name] = json.loads(raw)
                except ValueError:
                    values[name] = raw
        out = cls(**(values | {k: v for k, v in given.items() if v is not None}))
        if not 1 <= out.max_concurrent <= 50:
            raise ValueError("max_concurrent is 1 to 50")
        if not 1 <= out.classes_per_domain <= 500:
            raise ValueError("classes_per_domain is 1 to 500")
        return out


@dataclass(frozen=True)
class Prompt:
    """A loaded prompt: where it is from, its two parts and the hash of both."""

    id: str
    version: str
    system: str
    user: str
    content_hash: str
    meta: dict


_prompts: dict[tuple[str, str, str | None], Prompt] = {}


def _front_matter(text: str) -> dict:
    """Scalars and lists, inline or dashed, of a flat front matter."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        if line.strip().startswith("- ") and key:
            out[key] = [*(out[key] or []), line.strip()[2:].strip("\"' ")]
        elif ":" in line and not line.startswith(" "):
            key, raw = (x.strip() for x in line.split(":", 1))
            out[key] = [x.strip("\"' ") for x in raw[1:-1].split(",") if x.strip()] if raw.startswith("[") else raw.strip("\"'") if raw else []
    return out


def prompt(folder: str, id_: str, version: str | None = None) -> Prompt:
    """A prompt file: front matter with a pinned content hash, then a system and a user part.

    Every placeholder has to be declared, and every declared name used. Loaded prompts are remembered.
    """
    if known := _prompts.get((folder, id_, version)):
        return known
    wanted = version
    if wanted is None:
        wanted = _front_matter((Path(folder) / id_ / "default.yaml").read_text()).get("default")
        if not wanted:
            raise ValueError(f"no default version of {id_}")
    content = (Path(folder) / id_ / f"{wanted}.md").read_text()
    parts = content.split("---", 2)
    if not content.startswith("---") or len(parts) < 3:
        raise ValueError(f"front matter missing in {id_} {wanted}")
    meta = _front_matter(parts[1].strip())
    body = "".join(f"{line.rstrip()}\n" for line in parts[2].splitlines())
    pin = hashlib.sha256(body.encode()).hexdigest()[:8]
    if meta.get("content_hash_pin") != pin:
        raise ValueError(f"content hash of {id_} {wanted} is {pin}, not {meta.get('content_hash_pin')}")
    system, user = "", body.strip()
    if "# System" in body and "# User" in body:
        rest = body.partition("# System")[2]
        system, user = (x.strip() for x in rest.partition("# User")[::2])
    declared, used = {*meta.get("required_vars", []), *meta.get("optional_vars", [])}, template_names(system + user)
    if used - declared or set(meta.get("required_vars", [])) - used:
        raise ValueError(f"variables of {id_}: undeclared {sorted(used - declared)}, unused {sorted(set(meta.get('required_vars', [])) - used)}")
    found = _prompts[folder, id_, version] = Prompt(id_, wanted, system, user, pin, meta)
    return found
