"""Ignore patterns as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULTS = "*.iml *.py[cod] **/generated-sources/ **/generated-test-sources/ .git/ .idea/ .venv/ .vscode/ __pycache__/ build/ out/ target/ venv/".split()


def pattern_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression over a relative POSIX path, whether it re-includes), or None for a comment or blank.

    A pattern with a slash that isn't its last character is anchored; ``**`` spans directories; a trailing
    slash stands for a directory, so something has to come below it.
    """
    if pattern.startswith("#") or not pattern.strip():
        return None
    negated = pattern.startswith("!")
    pattern = pattern[negated:]
    pattern = pattern[1:] if pattern.startswith(("\\#", "\\!")) else re.sub(r"(?<!\\) +$", "", pattern)
    folder = pattern.endswith("/")
    body = pattern.rstrip("/")
    anchored = "/" in body
    body, out, k = body.lstrip("/"), "", 0
    while k < len(body):
        if body.startswith("**/", k) and (k == 0 or body[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif body.startswith("/**", k) and k + 3 == len(body):
            out, k = out + "/.+", k + 3
        elif body[k] == "*":
            while k + 1 < len(body) and body[k + 1] == "*":
                k += 1
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        elif body[k] == "[" and (end := body.find("]", k + 2)) > 0:
            inner = body[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, k = out + "[" + ("^/" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif body[k] == "\\" and k + 1 < len(body):
            out, k = out + re.escape(body[k + 1]), k + 2
        else:
            out, k = out + re.escape(body[k]), k + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.+' if folder else '(?:/.*)?'}$", negated


def ignored(path, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a path excludes it. Patterns are configuration and become one CASE."""
    out = F.lit(False)
    for compiled in map(pattern_regex, patterns):
        if compiled:
            out = F.when((F.col(path) if isinstance(path, str) else path).rlike("(?s)" + compiled[0]), not compiled[1]).otherwise(out)
    return out


def corpus_patterns(own: list[str]) -> list[str]:
    """Defaults and the corpus's own patterns, each once, in order."""
    return list(dict.fromkeys([*DEFAULTS, *own]))
