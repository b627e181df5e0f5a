"""WARC archives: a writer with revisit records and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, fresh_dir, lookup, pick

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES, SPLIT_BYTES = 256 << 20, 32 << 20
_READ = 1 << 20
MOST_TASKS = 100_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with the payload, or a revisit that only refers to one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def _writer(folder: str, file_bytes: int):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        out, path, size, count = None, "", 0, 0

        def row():
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "records": pa.array([count], pa.int64())})

        for batch in batches:
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    path, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                member = record(page_id, url, payload, refers)
                out.write(member)
                size += len(member)
                count += 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield row()
        if out is not None:
            out.close()
            yield row()

    return run


def write_warc(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per page; returns the manifest (path, bytes, records), which alone tells valid files.

    Of pages with equal payloads of at least ``least`` bytes, those with the smallest id are responses and
    the others revisit it. Every attempt of a task writes files of its own name, and only those of the attempt that
    succeeded are in the manifest, so a lost executor leaves nothing but unlisted files.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    small = rows.select("page_id", "digest", F.length("payload").alias("n"))
    groups = cut(small.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    refers = F.when(F.col("first") < F.coalesce("page_id", F.lit((1 << 63) - 1)), F.col("first"))
    ready = lookup(rows, groups, "digest", "copies", ["first"], "page_id", total).select("page_id", "url", "payload", refers.alias("refers_to"))
    return cut(ready.mapInArrow(_writer(folder, file_bytes), "path string, bytes long, records long"))


class _Reader:
    """A window over a file that is read forwards; ``base`` is the place of its first byte."""

    def __init__(self, stream, start: int):
        self.stream = stream
        self.jump(start)

    def jump(self, to: int):
        self.stream.seek(to)
        self.base, self.data = to, b""

    def more(self) -> bool:
        got = self.stream.read(_READ)
        self.data += got
        return bool(got)

    def drop(self, to: int):
        self.data, self.base = self.data[to - self.base :], to


def _member(window: _Reader, at: int) -> bytes | None:
    """Content of the WARC member at ``at``, with the window moved behind it; None when the bytes there aren't one.

    A member is read in steps that aren't kept, so a very long one costs no more than its length.
    """
    window.drop(at)
    unpack, out, checked, data, end = zlib.decompressobj(31), [], False, window.data, at + len(window.data)
    try:
        while not unpack.eof:
            if not data:
                data = window.stream.read(_READ)
                end += len(data)
                if not data:
                    break
            if checked:
                out.append(unpack.decompress(data))
                data = b""
            else:
                out.append(unpack.decompress(data, 64))
                data = unpack.unconsumed_tail
                if sum(map(len, out)) >= 7 or unpack.eof:
                    checked = b"".join(out).startswith(b"WARC/1.")
                    if not checked:
                        break
    except zlib.error:
        checked = False
    if not (checked and unpack.eof):
        window.jump(at + 1)
        return None
    window.data, window.base = unpack.unused_data, end - len(unpack.unused_data)
    return b"".join(out)


def members(stream, start: int, end: int):
    """Contents of the members that start in [start, end)."""
    window = _Reader(stream, start)
    while window.base < end:
        found = window.data.find(MAGIC)
        if found < 0:
            window.drop(max(window.base, window.base + len(window.data) - 2))
            if not window.more():
                return
        elif window.base + found >= end:
            return
        elif (got := _member(window, window.base + found)) is not None:
            yield got


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "None" else int(value)


def _splits(folder: str, with_payload: bool):
    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with fs.open_input_file(path) as stream:
                    for content in members(stream, start, end):
                        fields, payload = parse(content)
                        kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (digest32(payload) != stated or len(payload) != int(fields["X-Payload-Length"])):
                            raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {path}")
                        rows.append((_page(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), stated, kind, _page(fields["WARC-Refers-To"]) if kind == "revisit" else None, payload if with_payload and kind == "response" else None))
                        held += len(payload) if with_payload else 100
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    return run


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def read_warc(manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Records of the files in a manifest (path, bytes), read in parallel byte ranges.

    A task looks for the gzip magic in its range, takes a place for a member only when it decodes to a WARC
    header, and owns the records that start in the range, wherever they end. Magic bytes within compressed
    data don't decode and are passed over. Response payloads are checked against their digest and length.
    There are as many tasks as ranges, up to MOST_TASKS.
    """
    last = F.greatest(F.col("bytes") - 1, F.lit(0))
    count = manifest.agg(F.coalesce(F.sum(F.expr(f"CAST(greatest(bytes - 1, 0) DIV {split_bytes} AS BIGINT) + 1")), F.lit(0))).first()[0]
    at = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(split_bytes).cast("long")))
    ranges = manifest.select("path", "bytes", at.alias("start")).select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    return ranges.repartition(min(MOST_TASKS, max(1, count))).mapInArrow(_splits(folder, payload), SCHEMA)


def archive(pages: DataFrame, folder: str, payload: bool = True, **options) -> DataFrame:
    """Write pages and read them back.

    Null html is an empty payload, and empty payloads are deduplicated like others. A null id is kept and never a response
    that others refer to, unless its group has no other id. Repeated rows are a record each; those with the
    smallest id of the group are all responses. Null urls are written empty. An empty table writes no file.
    """
    return read_warc(write_warc(pages, folder, **options), folder, payload=payload)


def op9(spark, sf_dir: str) -> DataFrame:
    """``archive`` of all pages: a record each, and what is read back of it, without the payload."""
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_dir(spark, "warc"), payload=False).drop("payload")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS low FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::INTEGER) AS v FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32768) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 1024) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM b
"""
