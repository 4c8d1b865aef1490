"""WARC archives as a PySpark Python data source, and a deduplicating archive of pages.

Format: WARC/1.1, one gzip member per record. The writer notes each member's compressed length in the gzip
header's extra field ("sl"), so a reader can step over a member without inflating it. The reader
* plans partitions from the committed files' sizes (small files together, each file whole),
* takes equality, IN and prefix predicates on its header columns (pushFilters),
* inflates a record only as far as the end of its headers, tests the predicates, and
* inflates, checks and decodes a payload only for records that pass, if the payload is wanted at all.
Members without the extra field (other writers') are read too: inflated to find their end, payload not kept.

Files go through pyarrow's file systems, so a path may be in any store that pyarrow opens. A task writes
under names of its own; the driver's commit lists the files of successful attempts in a manifest of its own, and only
files that some manifest lists are read, so lost executors and repeated attempts leave no double rows, and appending to
an archive keeps what it had. A folder without a manifest (another writer's) is read whole.

Options: path; payload = return (default), verify (inflate and check the digest, return null) or skip.
Nulls: a null html is an empty payload; a null url leaves its header out; a null page_id gives a response with a
null id, which nothing refers to. Repeated rows are written and read as often as they come: rows with the response's page_id and payload
are all responses. A page_id with several payloads has a role in each payload's group. Payloads of any length are held whole, one
at a time. No pages give an empty archive. Other columns of the pages are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .common import shared_dir

SCHEMA = "record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
HEADERS = ("record_type", "target_uri", "payload_digest", "page_id", "refers_to")
ROLL = 64 << 20  # bytes after which a task begins another file
PLAN = 32 << 20  # bytes of files to a partition
ARROW = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """The plain bytes of one record; a revisit carries the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[%\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(plain: bytes) -> bytes:
    """A gzip member whose extra field "sl" holds the length of its deflated part."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHQ", 12, b"sl", 8, len(body))
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


class Files(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        names: list[str] = []
        out, held = None, 0
        for batch in iterator:
            for row in batch.select(["record_type", "page_id", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload"]).to_pylist():
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, held = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = member(record(row["record_type"], row["page_id"], row["target_uri"], row["payload"] or b"", row["payload_digest"], row["payload_bytes"], row["refers_to"]))
                out.write(data)
                held += len(data)
                if held >= ROLL:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Files(names)

    def commit(self, messages: list[Files | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        done = "".join(f"{n}\n" for m in messages if m for n in m.names)
        with fs.open_output_stream(f"{root}/_MANIFEST-{uuid.uuid4().hex}") as out:
            out.write(done.encode())

    def abort(self, messages: list[Files | None]) -> None:
        fs, root = file_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/{name}")


class Part(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class Headers(NamedTuple):
    fields: dict[str, str]
    at: int  # where the block begins in the plain record

    def row(self) -> dict:
        ident = lambda name: (m := re.fullmatch(r"<urn:page:(-?\d+)>", self.fields.get(name, ""))) and int(m[1])
        uri = self.fields.get("warc-target-uri")
        return {
            "record_type": self.fields.get("warc-type"),
            "page_id": ident("warc-record-id"),
            "target_uri": uri if uri is None else re.sub(r"(?:%[0-7][0-9A-F])+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(), uri),
            "payload_digest": self.fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "refers_to": ident("warc-refers-to"),
        }


def headers_of(plain: bytes) -> Headers | None:
    """The named fields of a record's head, if all of it is there."""
    end = plain.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = plain[:end].decode("utf-8", "surrogatepass").split("\r\n")
    return Headers({k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters) -> Iterator:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        from pyarrow import fs as pafs

        fs, root = file_system(self.path)
        infos = [x for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file]
        listed = [x for x in infos if x.base_name.startswith("_MANIFEST")]
        if listed:
            done: set[str] = set()
            for x in listed:
                with fs.open_input_stream(x.path, compression=None) as f:
                    done.update(f.read().decode().split())
            infos = [x for x in infos if x.base_name in done]
        parts, held = [], PLAN
        for x in sorted((x for x in infos if x.base_name.endswith(".warc.gz")), key=lambda x: x.base_name):
            if held + x.size > PLAN and (held or not parts):
                parts.append(Part([]))
                held = 0
            parts[-1].names.append(x.path)
            held += x.size
        return parts or [Part([])]

    def passes(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            own = row[name]
            if own is None or not (own == value if kind == "EqualTo" else own in value if kind == "In" else own.startswith(value)):
                return False
        return True

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        rows, held = [], 0
        for name in partition.names:
            with fs.open_input_file(name) as f:
                for row in self.records(f):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def records(self, f) -> Iterator[dict]:
        """Rows of one file that pass the predicates."""
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            head = f.read(12)
            if head[:3] != b"\x1f\x8b\x08":
                raise ValueError(f"not a gzip member at byte {at}")
            size, start = None, at + 10
            if head[3] & 4:
                extra = f.read(struct.unpack("<H", head[10:12])[0])
                start = at + 12 + len(extra)
                if extra[:2] == b"sl":
                    size = struct.unpack("<Q", extra[4:12])[0]
            if size is None:
                plain, at = self.whole(f, at)
                head_of, inflate, rest = headers_of(plain), None, b""
            else:
                inflate, at = zlib.decompressobj(-15), start + size + 8
                rest, plain, head_of = f.read(min(size, 2048)), b"", None
                left = size - len(rest)
                while head_of is None:
                    plain += inflate.decompress(rest, 1024)
                    rest = inflate.unconsumed_tail
                    head_of = headers_of(plain)
                    if head_of is None and not rest:
                        rest = f.read(min(left, 65536))
                        left -= len(rest)
                        if not rest and inflate.eof:
                            raise ValueError("a record without an end of its headers")
            row = head_of.row()
            if not self.passes(row):
                continue
            kind = row["record_type"]
            if inflate is not None and (self.payload != "skip" and kind == "response" or plain.find(b"\r\n\r\n", head_of.at) < 0):
                plain += inflate.decompress(rest) + inflate.decompress(f.read(left))
            length = int(head_of.fields.get("content-length", 0))
            http_end = plain.find(b"\r\n\r\n", head_of.at)
            said = re.search(rb"(?i)\r\nContent-Length: *(\d+)", plain[head_of.at : http_end + 2])
            row |= {"payload": None, "payload_bytes": int(said[1]) if said else None}
            if kind == "response" and self.payload != "skip":
                payload = plain[http_end + 4 : head_of.at + length]
                if sha1_base32(payload) != row["payload_digest"]:
                    raise ValueError(f"payload of {row['page_id']} does not have the digest of its header")
                row |= {"payload_bytes": len(payload), "payload": payload if self.payload == "return" else None}
            yield row

    @staticmethod
    def whole(f, at: int) -> tuple[bytes, int]:
        """A member without a noted length: its plain bytes and the next member's place."""
        f.seek(at)
        inflate, plain, read = zlib.decompressobj(31), b"", 0
        while not inflate.eof:
            data = f.read(1 << 16)
            if not data:
                raise ValueError(f"a gzip member without an end at byte {at}")
            plain += inflate.decompress(data)
            read += len(data)
        return plain, at + read - len(inflate.unused_data)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "return"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32(digest):
    """RFC 4648 base 32 of a 20-byte digest given as hex."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 2), 20, "0") for i in range(8)])
    return F.concat(*[F.substring(F.lit(letters), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)])


def deduplicated(pages: DataFrame, least: int = 0) -> DataFrame:
    """WARC rows of pages(page_id, url, html): the smallest page_id of equal payloads of at least `least` bytes is
    the response, the others revisit it. Digests are grouped on ids alone; html moves once, by page_id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    keyed = rows.select("page_id", "sha1").filter("page_id is not null").distinct()
    first = keyed.groupBy("sha1").agg(F.min("page_id").alias("first"))
    roles = keyed.join(first, "sha1").filter("page_id != first")
    size = F.octet_length("payload")
    revisit = F.col("first").isNotNull() & (size >= least)
    return rows.join(roles, ["page_id", "sha1"], "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "page_id",
        "target_uri",
        base32(F.hex("sha1")).alias("payload_digest"),
        size.cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str | None = None) -> str:
    """Write records(SCHEMA) as an archive; returns its path (by default a new one in the shared folder)."""
    spark = records.sparkSession
    register(spark)
    path = path or f"{shared_dir(spark)}/stakeweave/warc-{uuid.uuid4().hex}"
    records.write.format("warc").mode("append").save(path)
    return path


def read_warc(spark: SparkSession, path: str, payload: str = "return") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)
