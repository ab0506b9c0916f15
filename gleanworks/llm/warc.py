"""WARC archives: a writer, and a Python data source that reads headers first (operator 2).

``write_archives`` writes one ``.warc.gz`` per task, a gzip member per record, into a folder that executors
share, with a revisit record for every payload that an earlier one equals. Each member says its length in
a gzip extra field (``sl``, skip lengths), so that a reader gets past it without inflating it. An index
beside the data (a row for about ``SPLIT`` bytes) holds offsets of members, so that partitions can be planned
within files. Task attempts write under names of their own; only the files that the index names are read.

``warc`` (the data source) plans those partitions, takes predicates on ``warc_type``, ``target_uri``,
``record_id``, ``refers_to`` and ``payload_digest`` into the scan, inflates a record's first bytes, parses its header,
and seeks past the rest of a record that isn't wanted. Blocks are inflated only for columns that need them
(``payload``, ``computed_digest``, ``payload_length``). Archives without an index are read whole, and members
without skip lengths, or plain ``.warc`` files, as a stream.

Defined results: null html is an empty payload; a null page_id gets a record without a page (its rows come
back with null page_id; it is a revisit where a numbered page has its payload); rows that share the
smallest page_id of a payload are all responses; null url becomes an empty target; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from gleanworks.llm.common import as_bytes, materialize, new_path

SPLIT = 32 << 20
#: Digests of several pages that go to all tasks (about 100 bytes each).
SHARED = 500_000
SCHEMA = "warc_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, http_length long, content_length long, payload binary, payload_length long, computed_digest string"
#: Columns for which a record's whole block is inflated.
WHOLE = {"payload", "payload_length", "computed_digest"}
#: Header fields by column.
FIELDS = {
    "warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """Where a folder is, for workers without a JVM; a plain path is local."""
    return pafs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


def record(kind: str, record_id: str, target: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member with skip lengths: the lengths of the member and of what it holds."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def page_uri(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest (SHA-1, hex), first: the smallest page_id of several with an equal payload, else null.

    Payloads don't move: what several pages share goes to all tasks, and beyond ``SHARED`` such digests, is
    joined by page, so that no digest's pages meet in one task."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("digest"))
    slim = rows.select("page_id", "digest")
    shared = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    shared = materialize(shared, "digests")
    if shared.count() <= SHARED:
        return rows.join(F.broadcast(shared), "digest", "left")
    again = slim.join(shared, "digest").where("page_id is null or page_id <> first").distinct()
    again = materialize(again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first"), "revisits")
    return rows.join(again, rows.page_id.eqNullSafe(again["_page"]) & (rows.digest == again["_digest"]), "left").drop("_page", "_digest")


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per row; payloads under min_revisit_bytes are never revisits."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(f"{base}/data", recursive=True)
        name = f"{base}/data/{uuid.uuid4().hex}.warc.gz"
        starts, at, count = [0], 0, 0
        with fs.open_output_stream(name, compression=None) as out:
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "first"))
                for page_id, url, digest, first, html in zip(*columns, as_bytes(batch.column("html")), strict=True):
                    payload = html or b""
                    again = first is not None and page_id != first and len(payload) >= min_revisit_bytes
                    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                    data = member(
                        record(
                            "revisit" if again else "response", page_uri(page_id), target, payload,
                            base64.b32encode(bytes.fromhex(digest)).decode(), page_uri(first) if again else None, date
                        )
                    )
                    out.write(data)
                    at += len(data)
                    count += 1
                    if at - starts[-1] >= SPLIT:
                        starts.append(at)
        if not count:
            fs.delete_file(name)
            return
        ends = [*starts[1:], at]
        rows = [(a, b) for a, b in zip(starts, ends, strict=True) if b > a]
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(rows)), pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())],
            names=["file", "first", "last"]
        )

    with_digests(pages).mapInArrow(write, "file string, first long, last long").write.parquet(f"{folder}/index")


class Slice(InputPartition):
    def __init__(self, file: str, first: int, last: int | None) -> None:
        self.file, self.first, self.last = file, first, last


def parse_header(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The next record's header fields by lower-case name; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts here: {line[:40]!r}")
    fields, last = {}, ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        if line[:1] in b" \t" and last:  # a folded line
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        last = name.strip().lower()
        fields[last] = value.strip()
    return fields


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = schema.fieldNames()
        self.path = options["path"]
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in FIELDS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Slice]:
        fs, base = filesystem(self.path)
        index = f"{base}/index"
        if fs.get_file_info(index).type == pafs.FileType.Directory:
            import pyarrow.dataset as ds

            files = [x.path for x in fs.get_file_info(pafs.FileSelector(index)) if x.path.endswith(".parquet")]
            rows = ds.dataset(files, filesystem=fs, format="parquet").to_table().to_pylist() if files else []
            return [Slice(r["file"], r["first"], r["last"]) for r in rows] or [Slice("", 0, 0)]
        info = fs.get_file_info(base)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True))
        return [Slice(x.path, 0, None) for x in files if x.path.endswith((".warc", ".warc.gz"))] or [Slice("", 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        fs, _ = filesystem(self.path)
        kinds = {"http_length": pa.int64(), "content_length": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        rows: list[list] = []
        held = 0
        with fs.open_input_file(part.file) as raw:
            raw.seek(part.first)
            for fields, block_of in self.records(io.BufferedReader(raw, 1 << 17), part):
                if any(fields.get(FIELDS[c]) not in values for c, values in self.wanted.items()):
                    continue  # nothing of its block is inflated or read
                length = int(fields.get("content-length", 0))
                row = {c: fields.get(f) for c, f in FIELDS.items()} | {"content_length": length}
                if WHOLE & set(self.columns):
                    block = block_of(length)
                    row["http_length"], row["payload"] = split_block(fields, block)
                    row["payload_length"] = len(row["payload"])
                    if "computed_digest" in self.columns:
                        row["computed_digest"] = "sha1:" + payload_digest(row["payload"])
                    held += len(block) if "payload" in self.columns else 0
                elif "http_length" in self.columns:
                    row["http_length"], _ = split_block(fields, http_head(block_of, length))
                rows.append([row.get(c) for c in self.columns])
                held += 500
                if held > 8 << 20:
                    yield self.batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows, schema)

    def records(self, stream: io.BufferedReader, part: Slice) -> Iterator[tuple[dict[str, str], Callable[[int], bytes]]]:
        """Each record's header, and a function that reads the first bytes of its block."""
        packed = part.file.endswith(".gz")
        at = part.first
        while part.last is None or at < part.last:
            stream.seek(at)
            head = stream.read(24)
            if not packed or len(head) < 24 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"sl\x08\x00":
                if head:
                    stream.seek(at)
                    yield from self.streamed(gzip.GzipFile(fileobj=stream) if packed else stream)
                return
            (size,) = struct.unpack("<I", head[16:20])
            unpacker = zlib.decompressobj(-15)
            done = bytearray()

            def upto(n: int, end: int = at + size, unpacker: object = unpacker, done: bytearray = done) -> bool:
                """Inflate until n bytes are there; false if the record ends before."""
                while len(done) < n:
                    data = unpacker.unconsumed_tail or stream.read(min(1 << 14, max(0, end - 8 - stream.tell())))
                    if not data or unpacker.eof:
                        return False
                    done.extend(unpacker.decompress(data, n - len(done)))
                return True

            while (end := bytes(done).find(b"\r\n\r\n")) < 0 and upto(len(done) + 1024):
                pass
            end = bytes(done).find(b"\r\n\r\n") if end < 0 else end
            fields = parse_header(io.BytesIO(bytes(done[: end + 4])))

            def block(n: int, start: int = end + 4, upto: Callable[[int], bool] = upto, done: bytearray = done) -> bytes:
                upto(start + n)
                return bytes(done[start : start + n])

            if fields is not None:
                yield fields, block
            at += size

    @staticmethod
    def streamed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], Callable[[int], bytes]]]:
        """Records one after another, where lengths aren't said in advance."""
        while (fields := parse_header(stream)) is not None:
            length = int(fields.get("content-length", 0))
            done = bytearray()

            def block(n: int, length: int = length, done: bytearray = done) -> bytes:
                if len(done) < min(n, length):
                    done.extend(stream.read(min(n, length) - len(done)))
                return bytes(done[:n])

            yield fields, block
            stream.seek(length - len(done), 1)

    @staticmethod
    def batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def http_head(block_of: Callable[[int], bytes], length: int) -> bytes:
    """As much of a block as its HTTP header takes, however long that is."""
    n = 1 << 12
    while n < length and b"\r\n\r\n" not in (data := block_of(n)):
        n *= 4
    return data if n < length else block_of(length)


def split_block(fields: dict[str, str], block: bytes) -> tuple[int | None, bytes]:
    """The HTTP header's Content-Length, and the payload behind it; other blocks are all payload."""
    if not fields.get("content-type", "").startswith("application/http"):
        return None, block
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value), body
    return None, body


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); ask for fewer columns by .schema(...)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)


def read_archives(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(schema).load(folder)


def archived(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    What is told of a response comes from its payload, and has to agree with its header; of a revisit, from
    its header. Payloads stay within the scan."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_archives(pages, folder, min_revisit_bytes)
    responses = read_archives(
        spark, folder,
        "warc_type string, record_id string, payload_digest string, refers_to string, payload_length long, computed_digest string"
    ).where("warc_type = 'response'")
    revisits = read_archives(
        spark, folder, "warc_type string, record_id string, payload_digest string, refers_to string, http_length long"
    ).where("warc_type = 'revisit'")
    differs = F.raise_error(F.concat(F.lit("payload and digest differ: "), F.col("record_id")))
    checked = responses.select(
        "record_id", "warc_type", "refers_to", F.col("payload_length").alias("payload_bytes"),
        F.when(F.col("computed_digest") == F.col("payload_digest"), F.col("computed_digest")).otherwise(differs).alias("digest")
    )
    both = checked.unionByName(
        revisits.select("record_id", "warc_type", "refers_to", F.col("http_length").alias("payload_bytes"), F.col("payload_digest").alias("digest"))
    )
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as long)")
    return both.select(
        page("record_id").alias("page_id"), "payload_bytes", F.expr("substring(digest, 6)").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to")
    )
