"""WARC archives as a Spark data source, read and written.

Writing: each task writes its records to a file of its own under a passing name; the driver gives the files of the tasks that
succeeded their final names, so a lost executor or a task run twice leaves nothing that a reader sees. Every record is
a gzip member whose extra field holds its compressed size.

Reading: the driver plans partitions of whole files up to ``partition_bytes``. Filters on record type and header fields are pushed down:
a task inflates just the start of a member, parses the header, and steps over the rest of a member that no filter wants. With the option
``payload=false`` payloads stay unread. Plain ``.warc`` files are read too.

Records of equal payloads of at least ``least_revisit`` bytes are written once: that of the largest page is a
response, the others revisit it. Defined results: null html is an empty payload, null url an empty one; rows that share the largest page id and the payload are each a response; null page ids are responses unless another page has their payload, and read back as null;
empty tables write no record; other columns, whatever their names, are not looked at; payloads of any length are written whole.

Foreign archives: header values are read as UTF-8 and not decoded further; digests become lower-case hex where they are SHA-1 in base 32 or 16; a
missing or malformed length is null, and its block is what its member holds; members and lines that begin no record are stepped over; a file that breaks
off, or goes on as something else, gives the records before that.
"""

from __future__ import annotations

import base64
import io
import struct
import sys
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)

from .support import Store, ship, small_batches

SCHEMA = "warc_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, content_length bigint, payload_length bigint, payload binary"
#: Names of the format.
FIELDS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_length": "Content-Length"}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ESCAPED = "X-Target-URI-Escapes"  # a field of our own
DATE = "2024-01-01T00:00:00Z"
HEAD_BYTES = 2048
BATCH_BYTES = 4 << 20
BATCH_ROWS = 256


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a folder that all executors reach."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def member(block: bytes, level: int) -> bytes:
    """A gzip member whose extra field ``sl`` holds its compressed and its plain size."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(block) + squeeze.flush()
    total = 10 + 14 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(block) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def _plain(url: str) -> bool:
    """Whether a header line can hold the url as it is."""
    return url == url.strip() and all(ord(c) >= 32 and ord(c) != 127 for c in url) and "\x85" not in url


def record_bytes(record_id: str, url: str, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """One response, or one revisit without payload; ``digest`` is hexadecimal. A url that a line can't hold is escaped, and the record says so."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    plain = _plain(url)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url if plain else url.encode('unicode_escape').decode().replace(' ', chr(92) + 'x20')}", *([] if plain else [f"{ESCAPED}: unicode"]),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <{refers_to}>"] if refers_to else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _sha1(value: str) -> str:
    """A SHA-1 digest as lower-case hex, be it given in base 32 or 16, in whatever case; anything else as it is."""
    algorithm, _, digest = value.partition(":")
    if algorithm.lower() == "sha1":
        try:
            if len(digest) == 32:
                return base64.b32decode(digest.upper()).hex()
            if len(digest) == 40:
                return bytes.fromhex(digest).hex()
        except ValueError:
            pass
    return value


def parse_header(head: bytes) -> dict | None:
    """The fields of a record's header, null where they are missing or aren't what the format asks for; None if it is no record's."""
    if not head.startswith(b"WARC/"):
        return None
    names = {v.lower(): k for k, v in FIELDS.items()} | {ESCAPED.lower(): "escaped"}
    found: dict = {}
    last = None
    for line in head.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:  # a value may go on in the next line
            found[last] = f"{found[last]} {text.strip()}"
            continue
        name, mark, value = text.partition(":")
        last = names.get(name.strip().lower()) if mark else None
        if last:
            found[last] = value.strip()
    out: dict = {k: found.get(k) for k in FIELDS}
    for key in ("record_id", "refers_to"):
        out[key] = out[key] and out[key].strip("<>")
    if out["target_uri"] is not None and "escaped" in found:
        out["target_uri"] = out["target_uri"].encode("ascii", "backslashreplace").decode("unicode_escape")
    out["payload_digest"] = out["payload_digest"] and _sha1(out["payload_digest"])
    length = out["content_length"]
    out["content_length"] = int(length) if length and length.isascii() and length.isdigit() and len(length) < 19 else None
    return out


TESTS = {
    "=": lambda a, b: a == b, "in": lambda a, b: a in b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    "starts": lambda a, b: a.startswith(b),
}


def wanted(header: dict, tests: list[tuple[str, str, object]]) -> bool:
    return all(header[column] is not None and TESTS[op](header[column], value) for op, column, value in tests)


def finish(header: dict, block: bytes | None) -> tuple:
    """A row: payload and its length from the block, which holds an HTTP message if the record has one."""
    payload, size = None, None
    if block is not None:
        head, mark, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        lengths = [line.split(b":", 1)[1].strip() for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size = int(lengths[0]) if lengths and lengths[0].isdigit() and len(lengths[0]) < 19 else len(body)
        payload = None if header["warc_type"] == "revisit" else body
    return (*(header[k] for k in FIELDS if k != "content_length"), header["content_length"], size, payload)


def read_members(f, tests: list, payload: bool):
    """Rows of a gzip file, member by member; ``f`` can seek. What follows a member that is broken off or no gzip can't be found and is left out."""
    while True:
        start = f.tell()
        fixed = f.read(12)
        if len(fixed) < 12 or fixed[:2] != b"\x1f\x8b":
            return
        size = None
        if fixed[3] == 4:
            extra = f.read(struct.unpack("<H", fixed[10:])[0])
            at = 0
            while at + 4 <= len(extra):
                name, length = struct.unpack_from("<2sH", extra, at)
                if name == b"sl" and length >= 4 and at + 8 <= len(extra):
                    size = struct.unpack_from("<I", extra, at + 4)[0]
                at += 4 + length
        f.seek(start)
        try:
            row = _member(f, start, size, tests, payload)
        except zlib.error:
            return
        if row is False:
            return
        if row:
            yield row


def _member(f, start: int, size: int | None, tests: list, payload: bool) -> tuple | None | bool:
    """The row of the member at ``start``, None if it isn't wanted, False if the file ends in its header; leaves ``f`` behind the member."""
    inflate = zlib.decompressobj(31)
    raw = f.read(min(HEAD_BYTES, size) if size else HEAD_BYTES)
    plain = inflate.decompress(raw, HEAD_BYTES)
    while b"\r\n\r\n" not in plain and not inflate.eof:
        more = inflate.unconsumed_tail or f.read(HEAD_BYTES)
        if not more:
            return False
        plain += inflate.decompress(more, HEAD_BYTES)
    head, _, rest = plain.partition(b"\r\n\r\n")
    header = parse_header(head)
    take = header is not None and wanted(header, tests)
    reads = take and (payload or header["warc_type"] == "revisit")
    whole = reads and header["content_length"] is None  # without a length the block is what the member holds
    need = (1 << 62 if whole else header["content_length"]) if reads else 0
    parts, got = [rest], len(rest)
    if need > got or size is None:
        while not inflate.eof:
            more = inflate.unconsumed_tail or f.read(max(0, start + size - f.tell()) if size else 1 << 16)
            if not more:
                break
            part = inflate.decompress(more, 1 << 20)
            if got < need:
                parts.append(part)
            got += len(part)
    if size is None:
        f.seek(f.tell() - len(inflate.unused_data))
    else:
        f.seek(start + size)  # the rest of the member stays undecoded
    if not take:
        return None
    block = b"".join(parts)[:need] if need else None
    return finish(header, block.removesuffix(b"\r\n\r\n") if whole else block)


def read_plain(f, tests: list, payload: bool):
    """Rows of an uncompressed file. Lines that begin no record are stepped over; what follows a record without a length can't be found and is left out."""
    while True:
        head = b""
        for line in iter(f.readline, b""):
            if line == b"\r\n" and head:
                break
            if head or line.startswith(b"WARC/"):
                head += line
        if not head:
            return
        header = parse_header(head.rstrip(b"\r\n"))
        take, length = wanted(header, tests), header["content_length"]
        if length is None:
            if take:
                yield finish(header, None)
            return
        if take and (payload or header["warc_type"] == "revisit"):
            block = f.read(length)
        else:
            block = None
            f.seek(length, io.SEEK_CUR)
        if take:
            yield finish(header, block)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, partition_bytes: int):
        self.path, self.payload, self.partition_bytes, self.tests = path, payload, partition_bytes, []

    def pushFilters(self, filters):
        kinds = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", StringStartsWith: "starts"}
        for f in filters:
            name = getattr(f, "attribute", (None,))[0]
            if type(f) in kinds and len(f.attribute) == 1 and name in FIELDS:
                self.tests.append((kinds[type(f)], name, f.value))
            else:
                yield f

    def partitions(self):
        fs, inner = open_fs(self.path)
        files = sorted((i.path, i.size or 0) for i in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if i.path.endswith((".warc", ".warc.gz")) and not i.base_name.startswith(("_", ".")))
        out, size = [], 0
        for path, n in files:
            if not out or size + n > self.partition_bytes:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [Files(p) for p in out] or [Files([])]

    def read(self, partition):
        fs, _ = open_fs(self.path)
        schema = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (x.split() for x in SCHEMA.split(", "))])
        rows, size = [], 0
        for path in partition.paths:
            with io.BufferedReader(fs.open_input_file(path), 1 << 20) as f:
                for row in (read_members if path.endswith(".gz") else read_plain)(f, self.tests, self.payload):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), schema)], schema=schema)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Rows of (record_id, url, payload, size, digest, refers_to)."""

    def __init__(self, path: str, level: int, file_bytes: int):
        self.path, self.level, self.file_bytes = path, level, file_bytes

    def write(self, iterator):
        fs, inner = open_fs(self.path)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or size >= self.file_bytes:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{inner}/_passing-{names[-1]}", compression=None), 0
                data = member(record_bytes(*row), self.level)
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages):
        fs, inner = open_fs(self.path)
        for message in messages:
            for name in message.names if message else []:
                fs.move(f"{inner}/_passing-{name}", f"{inner}/{name}")

    def abort(self, messages):
        fs, inner = open_fs(self.path)
        for message in messages:
            for name in message.names if message else []:
                fs.delete_file(f"{inner}/_passing-{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", int(self.options.get("partition_bytes", 32 << 20)))

    def writer(self, schema, overwrite):
        fs, inner = open_fs(self.options["path"])
        fs.create_dir(inner, recursive=True)
        return WarcWriter(self.options["path"], int(self.options.get("level", 4)), int(self.options.get("file_bytes", 256 << 20)))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(WarcSource)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    return register(spark).read.format("warc").option("payload", str(payload).lower()).load(path)


def plan_records(pages: DataFrame, least_revisit: int = 1000) -> DataFrame:
    """``pages(page_id, url, html)`` with size, digest and the page each one revisits.

    Sizes and largest ids combine before the shuffle; a digest that very many pages have is split when joined.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    firsts = rows.where(F.col("size") >= least_revisit).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(firsts, ["digest", "size"], "left").withColumn("refers_to", F.when(revisits, F.col("first"))).drop("first")


def write(pages: DataFrame, path: str, store: Store, least_revisit: int = 1000) -> None:
    """Archives of all pages under ``path``."""
    spark = small_batches(register(pages.sparkSession))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    records = plan_records(pages, least_revisit).select(
        name("page_id").alias("record_id"), "url", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "size", "digest",
        F.when(F.col("refers_to").isNotNull(), name("refers_to")).alias("refers_to"))
    records.write.format("warc").mode("append").save(path)


def page_report(spark: SparkSession, path: str) -> DataFrame:
    """What the archives hold, page by page: responses from their payloads, revisits from their headers alone."""
    page = lambda c: F.regexp_extract(c, "^urn:page:(.+)$", 1).try_cast("long")
    responses = read(spark, path).where("warc_type = 'response'").select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = read(spark, path).where("warc_type = 'revisit'").select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)


ship(sys.modules[__name__])
