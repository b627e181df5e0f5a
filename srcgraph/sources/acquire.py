"""Source trees as a ``files`` table: local folders, zip archives and git repositories."""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from io import BytesIO
from pathlib import Path, PurePosixPath
from zipfile import ZipFile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kind_of(spec: str) -> str:
    """zip, git or local, in this order."""
    low = spec.strip().lower()
    return "zip" if low.endswith(".zip") else "git" if low.startswith(("http://", "https://", "git@", "git://")) else "local"


def _clone(url: str, target: str):
    subprocess.run([*"git clone --depth 1 --".split(), url, target], check=True, capture_output=True)


@contextmanager
def folder_of(spec: str, clone: Callable[[str, str], None] = _clone, shared: str | None = None) -> Iterator[str]:
    """A folder with the tree; one made for it is removed afterwards.

    What is made for a repository or an archive goes below ``shared``, which all executors see; without it into a
    temporary folder of this machine, for a local master only.
    """
    if kind_of(spec) == "local":
        path = Path(spec)
        if not path.exists():
            raise FileNotFoundError(spec)
        if not path.is_dir():
            raise NotADirectoryError(spec)
        yield str(path.resolve())
        return
    base = re.sub("^file:/*", "/", shared) if shared else None
    if base and "://" in base:
        raise ValueError(f"{spec} is unpacked through a mounted folder, which {shared} isn't")
    if base:
        Path(base).mkdir(parents=True, exist_ok=True)
    made = tempfile.mkdtemp(prefix="source-", dir=base)
    try:
        if kind_of(spec) == "git":
            clone(spec, made)
        else:
            with ZipFile(spec) as z:
                for name in z.namelist():
                    _safe(name)
                z.extractall(made)
        yield made
    finally:
        shutil.rmtree(made, ignore_errors=True)


def _safe(name: str) -> str:
    path = PurePosixPath(name.replace("\\", "/"))
    if path.is_absolute() or ".." in path.parts:
        raise ValueError(f"path leaves the archive: {name}")
    return str(path)


def decoded(content) -> F.Column:
    """UTF-8 with broken sequences replaced; nothing raises."""
    return F.make_valid_utf8((F.col(content) if isinstance(content, str) else content).cast("string"))


def local_files(spark: SparkSession, root: str, glob: str = "*.java") -> DataFrame:
    """(path, text) of the files below a folder, listed and read by the executors. Paths are relative, POSIX."""
    base = root if "://" in root else Path(root).resolve().as_uri()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base)
    plain = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/*", "/")
    prefix = "/" + base.split("://", 1)[1].strip("/") + "/"
    return rows.select(F.substr(plain, F.lit(len(prefix) + 1)).alias("path"), decoded("content").alias("text"))


def _unzip(suffix: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                with ZipFile(BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.endswith(suffix):
                            yield pd.DataFrame({"path": [_safe(name)], "text": [z.read(name).decode("utf-8", "replace")]})

    return run


def zip_files(spark: SparkSession, path: str, suffix: str = ".java") -> DataFrame:
    """(path, text) of archive members, one archive per task, one member in memory at a time."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_unzip(suffix), "path string, text string")


def all_paths(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every file below a folder; contents aren't read."""
    return local_files(spark, root, "*").select("path")
