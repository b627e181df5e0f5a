"""Secret scanning with multipart credential linking."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import pick

KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
#: Code points between parts of one credential, at most, where no other reach is asked for.
REACH = 240
WEAK_ENTROPY = 3.2

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WEAK_ID = re.compile(r"""(?:access[_-]?key(?:[_-]?id)?|key[_-]?id|client[_-]?id|account[_-]?(?:id|name)?|user[_-]?name|username|user|login)["']?\x20{0,4}[:=]\x20{0,4}["']?([A-Za-z0-9_.@+-]{3,})""", re.ASCII | re.IGNORECASE)
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}(?![A-Za-z0-9+/_-])")
_ENDPOINT = re.compile(r"(?:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}|(?<![\w.-])(?:[a-z0-9-]+\.)+[a-z]{2,}:\d{2,5}\b|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}:\d{2,5}\b)", re.ASCII | re.IGNORECASE)
_BLANK = re.compile(r"\n[ \t\r]*\n")
# Which texts to look at more closely; these may say yes too often, never too seldom.
_MAYBE_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_MAYBE_ID = r"""(?i)AKIA[A-Z0-9]{16}|(key(?:[_-]?id)?|client[_-]?id|account[_-]?(?:id|name)?|user[_-]?name|user|login)["']?\x20{0,4}[:=]"""


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the whole matches by kind, leftmost and without overlap, in code points."""
    return {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6],
        "access": [m.span() for m in _ACCESS.finditer(text)],
        "hex": [m.span() for m in _HEX.finditer(text)],
    }


def _clear(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of ``taken``."""
    taken = sorted(taken)
    starts = [a for a, _ in taken]
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else []
    out = []
    for a, b in spans:
        k = int(np.searchsorted(starts, b)) - 1
        if k < 0 or ends[k] <= a:
            out.append((a, b))
    return out


def _near(parts: list[tuple[int, int]], others: list[tuple[int, int]], edges: np.ndarray, reach: int | None = REACH) -> np.ndarray:
    """Interval join: whether each part has another within ``reach`` (None: any) and within its scope.

    Both sides are sorted and free of overlap, so a part's partners are a stretch of the others, found by
    bisection; partners aren't enumerated.
    """
    if not parts or not others:
        return np.zeros(len(parts), bool)
    p, o = np.array(parts), np.array(others)
    scope = np.searchsorted(edges, p[:, 0], "right")
    reach = 1 << 60 if reach is None else reach
    low = np.maximum(p[:, 0] - reach, np.concatenate([[0], edges])[scope])
    high = np.minimum(p[:, 1] + reach, np.append(edges, 1 << 60)[scope])
    first = np.searchsorted(o[:, 1], low, "right")
    return (first < len(o)) & (o[np.minimum(first, len(o) - 1), 0] < high)


def _merge(*lists: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans as sorted spans without overlap."""
    out: list[list[int]] = []
    for a, b in sorted(x for y in lists for x in y):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def link(text: str, base: dict[str, list[tuple[int, int]]], reach: int | None = REACH) -> dict[str, list[tuple[int, int]]]:
    """Weak parts that complement each other within a scope, the lines between two blank ones.

    A weak identifier counts beside a secret, a weak secret beside an identifier, and an endpoint beside both;
    alone none is reported.
    """
    strong = base["assign"] + base["access"] + base["hex"]
    ids = _clear([m.span() for m in _WEAK_ID.finditer(text)], strong)
    every_id = _merge(ids, base["access"])
    if not every_id:
        return {"weak_id": [], "weak_secret": [], "endpoint": []}
    ends = [m.span() for m in _ENDPOINT.finditer(text)]
    ends = _clear(ends, strong + ids)
    weak = []
    for m in _WEAK_SECRET.finditer(text):
        s = m.group().rstrip("=")
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and _entropy(s) >= WEAK_ENTROPY:
            weak.append(m.span())
    weak = _clear(weak, strong + ids + ends)
    edges = np.array([m.start() for m in _BLANK.finditer(text)], np.int64)
    secrets = _merge(base["assign"], base["hex"], weak)
    pick_ = lambda spans, ok: [s for s, k in zip(spans, ok, strict=True) if k]
    return {
        "weak_id": pick_(ids, _near(ids, secrets, edges, reach)),
        "weak_secret": pick_(weak, _near(weak, every_id, edges, reach)),
        "endpoint": pick_(ends, _near(ends, secrets, edges, reach) & _near(ends, every_id, edges, reach)),
    }


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(reach: int | None):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            if texts.null_count:
                texts = pc.fill_null(texts, "")
            assign = pc.match_substring_regex(texts, _MAYBE_ASSIGN).to_numpy(zero_copy_only=False)
            hexes = pc.match_substring_regex(texts, "[0-9a-f]{24}").to_numpy(zero_copy_only=False)
            ids = pc.match_substring_regex(texts, _MAYBE_ID).to_numpy(zero_copy_only=False)
            found: list[list[dict]] = [[] for _ in range(len(texts))]
            for k in np.flatnonzero(assign | hexes | ids).tolist():
                text = texts[k].as_py()
                base = base_spans(text)
                spans = base | (link(text, base, reach) if ids[k] else {})
                found[k] = sorted(({"kind": kind, "start": a, "end": b} for kind, own in spans.items() for a, b in own), key=lambda s: (s["start"], KINDS.index(s["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "found"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = REACH) -> DataFrame:
    """All spans of every whole text: (doc_id, found: array of kind, start, end in code points).

    Null and empty texts have none. Ties of the start go by the order of KINDS. Repeated rows are scanned each
    for itself; very long texts are scanned whole. Nothing is shuffled. An empty table gives an empty result.
    Parts of a credential are joined within a scope up to ``reach`` code points apart (None: wherever they stand).
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_scan(reach), "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def mask(text: str, spans: list[tuple[int, int]], by: str = "<SECRET>") -> str:
    """The text with the (merged) spans replaced."""
    out, at = [], 0
    for a, b in _merge(spans):
        out += [text[at:a], by]
        at = b
    return "".join([*out, text[at:]])


def _listed(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def base_digest(spans: list[dict]) -> str:
    return hashlib.sha256(_listed([s for s in spans if s["kind"] in KINDS[:3]]).encode()).hexdigest()


def op2(spark, sf_dir: str) -> DataFrame:
    """``scan`` all documents, parts of a credential joined over whole scopes."""
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), reach=None)
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin(KINDS[:3]))
    return rows.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
