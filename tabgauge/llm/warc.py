"""WARC archives as a Python data source, for reading and writing.

Reading. Partitions are files, small ones together. In a folder with manifests of this writer, its own files are those
that any of the manifests names; archives under other names, and all of a folder without a manifest, are read too. Filters on header columns (``warc_type``, ``record_id``, ``target_uri``, ``content_type``, ``payload_digest``,
``refers_to``: equality, membership, prefix, being there) are pushed down. For every record the head is parsed first,
from the first few kilobytes; a record that fails a filter, or whose payload no column asks for, is skipped without
inflating the rest: compressed records say their length in the gzip extra field ``sl``, uncompressed ones in their head.
Files of other writers without that field are read through.

Writing. Every task writes its own files of at most about ``max_file_bytes``, one gzip member a record, and names
them in its commit message; the driver writes one manifest for each commit, so that appends add up; overwriting deletes
what the folder held before. Files of lost or repeated tasks are in no manifest and are never read. Paths go through pyarrow's file systems, so a folder in any store they know will do.

Cases: a null payload is empty; a null header is left out and read back as null; control characters and blanks in
header values are percent-encoded; repeated rows are records of their own; no rows give an archive without records;
columns are found by name and further ones are refused.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tabgauge.llm.common import shared_path, table

SCHEMA = (
    "warc_type string, record_id string, target_uri string, warc_date string, content_type string, "
    "payload_digest string, refers_to string, payload_length long, payload binary, file string, offset long"
)
COLUMNS = [column.split()[0] for column in SCHEMA.split(", ")]
#: header columns and the header that each one is read from
HEADERS = {
    "warc_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
#: one for each commit; earlier versions left one without an id
MANIFEST = re.compile(r"_manifest(-[0-9a-f]{32})?\.json")
OWN_FILE = re.compile(r"part-[0-9a-f]{32}\.warc\.gz")
ARCHIVES = (".warc", ".warc.gz")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD_BYTES = 4096
UNKNOWN = 0xFFFFFFFF


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, inside = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return store, inside


# --- records -------------------------------------------------------------------------------------------------------


def header_value(value: str) -> str:
    """The value without characters that would end or fold a header."""
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in value)


def head(version: str, fields: list[tuple[str, str | None]]) -> bytes:
    lines = [version, *[f"{name}: {value}" for name, value in fields if value is not None]]
    return "\r\n".join([*lines, "", ""]).encode()


def record(row: dict) -> bytes:
    """The bytes of one record; a revisit has the HTTP head of its payload and no payload."""
    payload = row.get("payload") or b""
    kind = row["warc_type"] or "response"
    revisit = kind == "revisit"
    digest = row.get("payload_digest") or hashlib.sha1(payload).hexdigest()
    length = row.get("payload_length")
    http = head(
        "HTTP/1.1 200 OK",
        [
            ("Content-Type", row.get("content_type") or "text/html; charset=utf-8"),
            ("Content-Length", str(len(payload) if length is None else length)),
        ],
    )
    block = http if revisit else http + payload
    safe = {k: None if row.get(k) is None else header_value(row[k]) for k in ("record_id", "target_uri", "refers_to", "warc_date")}
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", safe["record_id"]),
        ("WARC-Date", safe["warc_date"]),
        ("WARC-Target-URI", safe["target_uri"]),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", safe["refers_to"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return head("WARC/1.1", fields) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member whose extra field ``sl`` holds the lengths of the member and of its content."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    lengths = b"".join(min(x, UNKNOWN).to_bytes(4, "little") for x in (whole, len(data)))
    extra = b"sl" + (8).to_bytes(2, "little") + lengths
    return (
        b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
        + len(extra).to_bytes(2, "little")
        + extra
        + body
        + zlib.crc32(data).to_bytes(4, "little")
        + (len(data) & UNKNOWN).to_bytes(4, "little")
    )


def fields_of(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined."""
    found: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def digest_hex(value: str | None) -> str | None:
    """A ``sha1:`` digest as bare lower-case hex; others as they are."""
    if value is None or not value.lower().startswith("sha1:"):
        return value
    bare = value[5:]
    return base64.b32decode(bare.upper()).hex() if len(bare) == 32 else bare.lower()


# --- reading -------------------------------------------------------------------------------------------------------


def _matches(value: str | None, checks: list[tuple[str, object]]) -> bool:
    for kind, wanted in checks:
        if value is None or not {
            "equal": lambda: value == wanted,
            "in": lambda: value in wanted,
            "prefix": lambda: value.startswith(wanted),
            "there": lambda: True,
        }[kind]():
            return False
    return True


class Source:
    """Bytes of one file from a place on, compressed or not, read as far as they are asked for."""

    def __init__(self, stream, at: int, size: int) -> None:
        self.stream, self.at, self.size = stream, at, size

    def raw(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(min(n, max(0, self.size - at)))


class Member(Source):
    """The record in the gzip member at ``at``."""

    def __init__(self, stream, at: int, size: int) -> None:
        super().__init__(stream, at, size)
        self.inflate, self.next, self.data = zlib.decompressobj(31), at, b""
        start = self.raw(at, 24)
        known = start[3:4] == b"\x04" and start[12:14] == b"sl"
        length = int.from_bytes(start[16:20], "little") if known else UNKNOWN
        self.length = None if length == UNKNOWN else length

    def more(self, n: int) -> bool:
        """Inflate up to about ``n`` further bytes."""
        if self.inflate.eof:
            return False
        fed = self.inflate.unconsumed_tail or self.raw(self.next, HEAD_BYTES if n <= HEAD_BYTES else 1 << 18)
        if not fed:
            raise EOFError("a compressed record is cut off")
        if not self.inflate.unconsumed_tail:
            self.next += len(fed)
        self.data += self.inflate.decompress(fed, n)
        return True

    def end(self) -> int:
        """Where the next record starts; without a stated length the member is inflated to find out."""
        if self.length is None:
            while not self.inflate.eof:
                self.data = b""
                self.more(1 << 18)
            return self.next - len(self.inflate.unused_data)
        return self.at + self.length


class Plain(Source):
    """The uncompressed record at ``at``."""

    def __init__(self, stream, at: int, size: int) -> None:
        super().__init__(stream, at, size)
        self.next, self.data, self.total = at, b"", None

    def more(self, n: int) -> bool:
        got = self.raw(self.next, n)
        self.next += len(got)
        self.data += got
        return bool(got)

    def end(self) -> int:
        return self.at + self.total


def records(stream, name: str, size: int, checks: dict[str, list], payload: bool) -> Iterator[dict]:
    """Records of one file that pass the checks; payloads are inflated only where asked for."""
    at = 0
    while at < size:
        stream.seek(at)
        source = (Member if stream.read(2) == b"\x1f\x8b" else Plain)(stream, at, size)
        while (split := source.data.find(b"\r\n\r\n")) < 0:
            if not source.more(HEAD_BYTES):
                raise ValueError(f"no record at byte {at} of {name}")
        fields = fields_of(source.data[:split])
        length = int(fields.get("content-length", 0))
        if isinstance(source, Plain):
            source.total = split + 4 + length + 4
        values = {column: fields.get(header) for column, header in HEADERS.items()}
        values["payload_digest"] = digest_hex(values["payload_digest"])
        if all(_matches(values[column], wanted) for column, wanted in checks.items()):
            http = (fields.get("content-type") or "").lower().startswith("application/http")
            whole = split + 4 + length
            values |= {"payload": None, "payload_length": length, "file": name, "offset": at}
            cut = split + 4
            if http:
                while (found := source.data.find(b"\r\n\r\n", split + 4)) < 0 and len(source.data) < whole:
                    source.more(HEAD_BYTES)
                if found >= 0:
                    inner = fields_of(source.data[split + 4 : found])
                    values["content_type"] = inner.get("content-type", values["content_type"])
                    cut = found + 4
                    stated = inner.get("content-length", "")
                    values["payload_length"] = int(stated) if stated.isdigit() and values["warc_type"] == "revisit" else whole - cut
            if payload and values["warc_type"] != "revisit":
                pieces = [source.data]
                have = len(source.data)
                while have < whole:
                    source.data = b""
                    if not source.more(1 << 20):
                        raise EOFError(f"the record at byte {at} of {name} is cut off")
                    pieces.append(source.data)
                    have += len(source.data)
                values["payload"] = b"".join(pieces)[cut:whole]
            yield values
        at = source.end()


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]

    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(None)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int, batch_bytes: int) -> None:
        self.path, self.schema = path, schema
        self.partition_bytes, self.batch_bytes = partition_bytes, batch_bytes
        self.checks: dict[str, list] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            # content_type is that of the payload and known only after the HTTP head
            check = None
            if column in HEADERS and column != "content_type":
                if isinstance(f, EqualTo) and isinstance(f.value, str):
                    check = ("equal", f.value)
                elif isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                    check = ("in", frozenset(f.value))
                elif isinstance(f, StringStartsWith):
                    check = ("prefix", f.value)
                elif isinstance(f, IsNotNull):
                    check = ("there", None)
            if check is None:
                yield f
            else:
                self.checks.setdefault(column, []).append(check)

    def partitions(self) -> list[Files]:
        store, inside = _store(self.path)
        here = store.get_file_info(inside)
        infos = [here] if here.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
        named: dict[str, set[tuple[str, int]]] = {}
        for i in infos:
            folder = posixpath.dirname(i.path)
            if i.is_file and here.type != fs.FileType.File and MANIFEST.fullmatch(i.base_name):
                with store.open_input_stream(i.path) as f:
                    files = {(posixpath.join(folder, name), size) for name, size in json.loads(f.read())["files"]}
                named.setdefault(folder, set()).update(files)
        others = {
            (i.path, i.size)
            for i in infos
            if i.is_file
            and i.path.endswith(ARCHIVES)
            and not (posixpath.dirname(i.path) in named and OWN_FILE.fullmatch(i.base_name))
        }
        listed = sorted(others.union(*named.values()))
        parts: list[Files] = []
        room = 0
        for name, size in listed:
            if not parts or size > room:
                parts.append(Files([]))
                room = self.partition_bytes
            parts[-1].files.append((name, size))
            room -= size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        names = self.schema.fieldNames()
        kinds = {"payload_length": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        rows: list[dict] = []
        held = 0
        for name, size in partition.files:
            with store.open_input_file(name) as stream:
                for values in records(stream, name, size, self.checks, "payload" in names):
                    rows.append(values)
                    held += 200 + len(values["payload"] or b"")
                    if held >= self.batch_bytes:
                        yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)


# --- writing -------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, max_file_bytes: int, overwrite: bool) -> None:
        self.path, self.max_file_bytes, self.overwrite = path, max_file_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, inside = _store(self.path)
        store.create_dir(inside, recursive=True)
        files: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(posixpath.join(inside, name), compression=None)
                    size += out.write(member(record(row)))
                    if size >= self.max_file_bytes:
                        out.close()
                        files.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, inside = _store(self.path)
        store.create_dir(inside, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        before = store.get_file_info(fs.FileSelector(inside, recursive=True)) if self.overwrite else []
        with store.open_output_stream(posixpath.join(inside, f"_manifest-{uuid.uuid4().hex}.json")) as f:
            f.write(json.dumps({"files": files}).encode())
        new = {posixpath.join(inside, name) for name, _ in files}
        for i in before:
            if i.is_file and i.path not in new and (i.path.endswith(ARCHIVES) or MANIFEST.fullmatch(i.base_name)):
                store.delete_file(i.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, inside = _store(self.path)
        for name, _ in (f for m in messages if m is not None for f in m.files):
            store.delete_file(posixpath.join(inside, name))


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        unknown = set(schema.fieldNames()) - set(COLUMNS)
        if unknown:
            raise ValueError(f"a WARC record has no {sorted(unknown)}")
        return WarcReader(
            self.options["path"],
            schema,
            int(self.options.get("partition_bytes", 64 << 20)),
            int(self.options.get("batch_bytes", 4 << 20)),
        )

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        unknown = set(schema.fieldNames()) - set(COLUMNS)
        if unknown or "warc_type" not in schema.fieldNames():
            raise ValueError(f"columns of a record are {SCHEMA}; not known: {sorted(unknown)}")
        return WarcWriter(self.options["path"], int(self.options.get("max_file_bytes", 32 << 20)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """Add digest, length, warc_type and refers_to_key: of equal payloads the one with the largest key is the response.

    Only keys and digests are grouped and joined; equal payloads are counted before the shuffle, and the payload itself
    meets its verdict by key, so that a payload of very many copies loads no single task.
    """
    full = pages.withColumn("_payload", F.coalesce(F.col(payload), F.lit("").cast("binary")))
    full = full.withColumn("digest", F.sha1("_payload")).withColumn("length", F.octet_length("_payload").cast("bigint"))
    slim = full.filter(F.col("length") >= min_bytes).select(F.col(key).alias("k"), "digest", "length")
    last = slim.groupBy("digest", "length").agg(F.max("k").alias("last"), F.min("k").alias("first")).filter("first < last")
    revisits = (
        slim.join(last.drop("first"), ["digest", "length"])
        .filter(F.col("k") < F.col("last"))
        .select("k", F.col("digest").alias("d"), "last")
        .distinct()
    )
    return (
        full.join(revisits, (full[key] == revisits["k"]) & (full["digest"] == revisits["d"]), "left")
        .withColumn("warc_type", F.when(F.col("last").isNull(), "response").otherwise("revisit"))
        .withColumnRenamed("last", "refers_to_key")
        .drop("k", "d")
    )


PAGE_ID = "<urn:page:%s>"


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages as records into the shared folder, read the archives back, and report every record."""
    register(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    sorted_out = with_revisits(pages, "page_id", "payload", 1000)
    urn = lambda c: F.format_string(PAGE_ID, F.col(c).cast("string"))
    path = shared_path(spark, "warc")
    sorted_out.select(
        "warc_type",
        F.when(F.col("page_id").isNotNull(), urn("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.col("digest").alias("payload_digest"),
        F.when(F.col("refers_to_key").isNotNull(), urn("refers_to_key")).alias("refers_to"),
        F.col("length").alias("payload_length"),
        F.when(F.col("warc_type") == "response", F.col("_payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path).filter(F.col("warc_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, "([0-9-]+)>$", 1).try_cast("bigint")
    revisit = F.col("warc_type") == "revisit"
    return back.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("payload")).cast("bigint").alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(revisit, number("refers_to")).alias("refers_to"),
    )


SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest
  from pages
), l as (
  select payload_digest, payload_bytes, max(page_id) as last from p where payload_bytes >= 1000 group by all
)
select page_id, payload_bytes, payload_digest,
  case when page_id < last then 'revisit' else 'response' end as record_type,
  case when page_id < last then last end as refers_to
from p left join l using (payload_digest, payload_bytes)
"""
