"""WARC archives: writing, normalising whole-file gzip, and reading by offset.

A monolithic archive is one gzip stream over all records, so nothing in it can be
reached without inflating what stands before. The normaliser inflates such a stream
once, writes each record as a gzip member of its own, and a sidecar index of offsets.

Archives go to a folder that all executors share. A task's files carry the id of its
attempt, and only a finished attempt's names get into the manifest, so a lost or doubled
task harms nothing; its own files stay behind unread.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact, others, packed, ready, saved, scratch, unpacked

#: Groups of equal payloads that are broadcast; more of them are joined by a shuffle.
MAX_BROADCAST = 100_000
#: Parts of a group's rows where groups are joined by a shuffle.
SALTS = 16
CHUNK = 1 << 20
MONOLITHIC_LEVEL, MEMBER_LEVEL = 1, 4
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _open(uri: str, mode: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    store, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_file(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line: control characters and blanks as percent codes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id, url: str | None, payload: bytes, record_type: str, refers_to=None) -> bytes:
    """A WARC record. A revisit has the HTTP header but no payload; both name length and digest of the full one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    head = ["WARC/1.0", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(lines: bytes) -> dict[str, str]:
    """Fields of a header block, names in lower case."""
    fields = (x.partition(":") for x in lines.decode().split("\r\n")[1:] if x)
    return {k.lower(): v.strip() for k, _, v in fields}


def inflated(read) -> Iterator[bytes]:
    """Contents of a gzip stream of one or more members, in parts. read(n) gives the next bytes."""
    engine = zlib.decompressobj(31)
    while data := read(CHUNK):
        while data:
            if engine.eof:
                engine = zlib.decompressobj(31)
            yield engine.decompress(data, CHUNK)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, CHUNK)
            data = engine.unused_data
    if not engine.eof:
        raise ValueError("the gzip stream ends too early")


def records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Records of WARC contents in parts: header fields, the block, and the whole record."""
    held = bytearray()

    def have(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while have(1):
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(held) - 3)
            if not have(len(held) + 1):
                raise ValueError("a WARC header ends too early")
        fields = headers(bytes(held[:end]))
        start, size = end + 4, int(fields["content-length"])
        if not have(start + size + 4) or held[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record ends too early")
        yield fields, bytes(held[start : start + size]), bytes(held[: start + size + 4])
        del held[: start + size + 4]


def member(data: bytes, level: int = MEMBER_LEVEL) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def with_record_types(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 0, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """pages with `payload`, `record_type` and `refers_to`.

    Of rows with equal payloads of at least min_bytes, the one of the largest id is the
    response and the others revisit it; of repeated rows of that id one is the response.
    Smaller payloads are responses. Null html is the empty payload; a null id is less
    than any other. The input has to give its rows in the same partitions each time, as
    a table does. Columns of the new names are replaced, all others stay.
    """
    keep = others(pages, ["payload", "record_type", "refers_to"])
    payload = F.coalesce(exact(html_col), F.lit("")).cast("binary")
    rows = pages.select(packed(keep), exact(id_col).alias("_id"), payload.alias("payload"), F.sha1(payload).alias("_sha1"), F.monotonically_increasing_id().alias("_at"))
    copies = rows.filter(F.octet_length("payload") >= min_bytes).select("_sha1", F.struct(F.col("_id").alias("id"), F.col("_at").alias("at")).alias("w"))
    first = saved(copies.groupBy("_sha1").agg(F.max("w").alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "copies")
    few = first.count() <= max_broadcast
    if not few:  # a common payload's rows in SALTS parts, each with a copy of the group's row
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(SALTS)).cast("int"))
        first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.join(F.broadcast(first) if few else first, ["_sha1", *([] if few else ["_salt"])], "left")
    own = F.col("_first").isNull() | (F.col("_first.at") == F.col("_at"))
    return rows.select(*unpacked(keep), "payload", F.when(own, "response").otherwise("revisit").alias("record_type"), F.when(~own, F.col("_first.id")).alias("refers_to"))


def _per_task(folder: str, suffix: str) -> str:
    t = TaskContext.get()
    return f"{folder}/part-{t.partitionId():06d}-{t.taskAttemptId()}{suffix}"


def write_archives(typed: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """An archive in one gzip stream for each partition of typed pages; a row (path, records) each."""
    ready(typed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, engine, n, path = None, zlib.compressobj(MONOLITHIC_LEVEL, zlib.DEFLATED, 31), 0, ""
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    path = _per_task(folder, ".warc.gz")
                    out = _open(path, "w")
                out.write(engine.compress(record(*row)))
                n += 1
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    rows = typed.select(exact(id_col).alias("id"), exact(url_col).alias("url"), "payload", "record_type", "refers_to")
    return saved(rows.mapInArrow(run, "path string, records long"), "archives")


def _spread(paths: DataFrame) -> DataFrame:
    """An archive for each task, about."""
    n = max(1, paths.count())
    return paths.select("path").repartition(n, "path")


def normalise(paths: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of a column `path`, a gzip member for each record, with a sidecar index.

    A row for each archive: path, normal_path, index_path, records. The sidecar has a
    JSON line for each record: id, type, offset and length of its member. An archive is
    inflated once, record by record, in the memory that its largest record takes.
    Broken archives fail the task.
    """
    ready(paths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                normal = _per_task(folder, f"-{k}.normal.warc.gz")
                index, offset, n, k = normal + ".idx", 0, 0, k + 1
                with _open(path, "r") as source, _open(normal, "w") as out, _open(index, "w") as side:
                    for fields, _, whole in records(inflated(source.read)):
                        packed = member(whole)
                        out.write(packed)
                        side.write(json.dumps({"id": fields["warc-record-id"], "type": fields["warc-type"], "offset": offset, "length": len(packed)}).encode() + b"\n")
                        offset, n = offset + len(packed), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([normal]), pa.array([index]), pa.array([n], pa.int64())], names=["path", "normal_path", "index_path", "records"])

    return saved(_spread(paths).mapInArrow(run, "path string, normal_path string, index_path string, records long"), "normalised")


def read_archives(normalised: DataFrame) -> DataFrame:
    """A row for each record of normalised archives, each reached by its offset in the sidecar.

    page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type
    and refers_to. A payload that doesn't have the digest of its header fails the task.
    """
    ready(normalised.sparkSession)
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def number(urn: str | None):
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text not in ("", "None") else None

    def read_one(source, offset: int, length: int) -> tuple:
        source.seek(offset)
        packed = source.read(length)
        (fields, block, _), *more = list(records(iter([zlib.decompress(packed, 31)])))
        if more:
            raise ValueError("a member holds more than a record")
        http, _, payload = block.partition(b"\r\n\r\n")
        size, digest = int(headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
        response = fields["warc-type"] == "response"
        if response and (len(payload) != size or payload_digest(payload) != digest):
            raise ValueError(f"{fields['warc-record-id']}: the payload isn't that of its header")
        return number(fields["warc-record-id"]), fields.get("warc-target-uri"), payload if response else None, size, digest, fields["warc-type"], number(fields.get("warc-refers-to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        for batch in batches:
            for normal, index in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows, held = [], 0
                with _open(index, "r") as side:
                    places = [json.loads(x) for x in side.read().splitlines()]
                with _open(normal, "r") as source:
                    for p in places:
                        rows.append(read_one(source, p["offset"], p["length"]))
                        held += rows[-1][3]
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    n = max(1, normalised.count())
    return normalised.select("normal_path", "index_path").repartition(n, "normal_path").mapInArrow(run, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to monolithic archives, normalised, and read back by offset."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = scratch(spark, "warc")
    archives = write_archives(with_record_types(pages), f"{folder}/monolithic")
    back = read_archives(normalise(archives, f"{folder}/normal"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT t, max(page_id) AS last FROM p GROUP BY t),
d AS (SELECT page_id, strlen(p.t)::BIGINT AS payload_bytes, last,
        list_transform([1, 6, 11, 16, 21, 26, 31, 36], lambda i: ('0x' || substr(h, i, 5))::BIGINT) AS parts FROM p JOIN g ON p.t = g.t)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
