"""WARC archives: a PySpark data source, and archiving with revisit records.

Reading (`format("warc")`): the driver plans partitions of whole files up to `split_bytes`.
Predicates on header columns (record_type, target_uri, payload_digest and the like) are pushed
into the scan: a record's headers are parsed first, and the block of an unwanted record is
neither decompressed nor read where its length is known (the `sl` extra field of the gzip
member, or Content-Length in a file that isn't compressed). With option payload=false no
block is decoded. With verify=true (the default) a decoded payload must have its header's
length and digest; digests of algorithms that hashlib doesn't have are taken as they are.

Writing: a task writes drafts of about `file_bytes`, one gzip member a record. Only the drafts of
the tasks that Spark accepted get names of archives, when all have ended, and the names have the
writing's own id: a task that ran twice leaves one of its sets, an append nothing of others' less.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from sketchloom.llm import store
from sketchloom.llm.common import join_spread, shared_folder, written

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, content_length long, file string, offset long, payload binary"
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "date", "payload_digest", "payload_bytes", "refers_to", "content_length", "file", "offset")
#: Columns that the writer takes; others are refused.
WRITTEN = ("record_id", "record_type", "target_uri", "date", "payload_digest", "payload_bytes", "refers_to", "payload")
ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("content_length", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())])
#: Fixed values of the format.
VERSION, REVISIT_PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLANK = b"\r\n\r\n"
PEEK = 1 << 14
BATCH_BYTES = 8 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _base32(sha1: str) -> str:
    """A SHA-1 in base 32, from there or from hexadecimal digits."""
    return base64.b32encode(bytes.fromhex(sha1)).decode() if len(sha1) == 40 else sha1


def agrees(kind: str, value: str, body: bytes) -> bool:
    """Whether a header's digest, in hexadecimal digits, base 32 or base 64, is the body's; so it counts if the algorithm isn't known."""
    name = kind.lower().replace("-", "")
    if name not in hashlib.algorithms_guaranteed or name.startswith("shake"):
        return True
    own = hashlib.new(name, body, usedforsecurity=False).digest()
    return value.lower() == own.hex() or value.rstrip("=") in {base64.b32encode(own).decode().rstrip("="), base64.b64encode(own).decode().rstrip("=")} or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _clean(value: str) -> str:
    """A header value without line breaks or other controls: these are percent-encoded."""
    return value if value.isprintable() else "".join(quote(c) if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(row: dict) -> bytes:
    """A record in the WARC format; a revisit has no payload."""
    revisit, payload = row["record_type"] == "revisit", row.get("payload") or b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"] + (b"" if revisit else payload)
    lines = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["date"]), ("WARC-Target-URI", row.get("target_uri")), ("WARC-Payload-Digest", f"sha1:{_base32(row['payload_digest'])}"), ("WARC-Payload-Length", row["payload_bytes"])]
    if revisit:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {_clean(str(v))}\r\n".encode() for k, v in lines if v is not None) + b"\r\n" + block + BLANK


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field `sl` tells its length and that of the data."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, 24 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member_length(head: bytes) -> int | None:
    if len(head) < 24 or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"sl" and size == 8:
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return None


def parsed(head: bytes) -> dict[str, str]:
    """Names (lower case) and values of a header; folded lines are joined."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    found, name = {}, ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def columns_of(headers: dict[str, str], file: str, offset: int) -> dict:
    plain = lambda x: x[1:-1] if x and x[:1] == "<" and x[-1:] == ">" else x
    told = headers.get("warc-payload-digest") or ""
    value = told[5:] if told[:5].lower() == "sha1:" else told
    number = lambda x: int(x) if x and x.isdigit() else None
    return {"record_id": plain(headers.get("warc-record-id")), "record_type": headers.get("warc-type"), "target_uri": plain(headers.get("warc-target-uri")), "date": headers.get("warc-date"), "payload_digest": value or None, "payload_bytes": number(headers.get("warc-payload-length")), "refers_to": plain(headers.get("warc-refers-to")), "content_length": number(headers.get("content-length")), "file": file, "offset": offset}


def holds(f: Filter, row: dict) -> bool | None:
    """Whether a pushed filter holds for a record's header columns; None as in SQL."""
    if isinstance(f, Not):
        inner = holds(f.child, row)
        return None if inner is None else not inner
    x = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return x is None
    if isinstance(f, IsNotNull):
        return x is not None
    if x is None:
        return None
    match f:
        case EqualTo():
            return None if f.value is None else x == f.value
        case In():
            return True if x in f.value else None if None in f.value else False
        case GreaterThan():
            return x > f.value
        case GreaterThanOrEqual():
            return x >= f.value
        case LessThan():
            return x < f.value
        case LessThanOrEqual():
            return x <= f.value
        case StringStartsWith():
            return x.startswith(f.value)
        case StringEndsWith():
            return x.endswith(f.value)
        case StringContains():
            return f.value in x
    raise TypeError(f)


def can_push(f: Filter) -> bool:
    if isinstance(f, Not):
        return can_push(f.child)
    kinds = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains, IsNull, IsNotNull)
    return isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS


def scan(f, size: int, file: str, wanted, payload: bool, verify: bool) -> Iterator[dict]:  # noqa: ANN001
    """The wanted records of an open file, with their payloads if asked for."""
    at = 0
    while at < size:
        f.seek(at)
        data = f.read(min(PEEK, size - at))
        if data[:2] == b"\x1f\x8b":
            length, unpack, taken = _member_length(data), zlib.decompressobj(31), len(data)
            head, rest = b"", data
            while BLANK not in head and not unpack.eof:
                if not rest:
                    rest = f.read(min(PEEK, size - at - taken))
                    taken += len(rest)
                    if not rest:
                        raise ValueError(f"{file}: a record at {at} has no end")
                head += unpack.decompress(rest, 4096)
                rest = unpack.unconsumed_tail
            at_block = head.find(BLANK) + 4
            row = columns_of(parsed(head[: at_block - 4]), file, at)
            take = wanted(row)
            if length is None or (take and payload):
                parts = [head]
                while not unpack.eof:
                    if not rest:
                        rest = f.read(min(1 << 20, size - at - taken))
                        taken += len(rest)
                        if not rest:
                            raise ValueError(f"{file}: a record at {at} has no end")
                    parts.append(unpack.decompress(rest))
                    rest = unpack.unconsumed_tail
                whole = b"".join(parts)
                length = length or taken - len(unpack.unused_data)
                block = whole[at_block : at_block + (row["content_length"] or 0)]
            at += length
        else:
            skip = len(data) - len(data.lstrip(b"\r\n"))
            if skip:
                at += skip
                continue
            while BLANK not in data:
                more = f.read(PEEK)
                if not more:
                    raise ValueError(f"{file}: a record at {at} has no end")
                data += more
            at_block = data.find(BLANK) + 4
            row = columns_of(parsed(data[: at_block - 4]), file, at)
            take, n = wanted(row), row["content_length"] or 0
            if take and payload:
                f.seek(at + at_block)
                block = f.read(n)
            at += at_block + n
        if take:
            row["payload"] = _payload(row, block, verify) if payload else None
            yield row


def _verified(told: str | None, body: bytes) -> bool:
    kind, colon, value = (told or "").rpartition(":")
    return not told or agrees(kind if colon else "sha1", value, body)


def _payload(row: dict, block: bytes, verify: bool) -> bytes | None:
    """The body of a response's HTTP block; a revisit has none; other records' blocks as they are."""
    if row["record_type"] == "revisit":
        return None
    body = block.partition(BLANK)[2] if row["record_type"] == "response" else block
    if verify and ((row["payload_bytes"] is not None and len(body) != row["payload_bytes"]) or not _verified(row["payload_digest"], body)):
        raise ValueError(f"{row['file']}: the payload at {row['offset']} isn't what its header says")
    return body


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]

    def __post_init__(self) -> None:
        super().__init__(None)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"
        self.split = int(options.get("split_bytes", 16 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if can_push(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        found, held = [], self.split
        for path, size in store.listed(self.folder, ".warc.gz") + store.listed(self.folder, ".warc"):
            if held + size > self.split:
                found.append(Files([]))
                held = 0
            found[-1].files.append((path, size))
            held += size
        return found or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = store.opened(self.folder)
        filters = self.filters
        wanted = lambda row: all(holds(f, row) for f in filters)
        rows, held = [], 0
        for path, size in partition.files:
            with files.open_input_file(path) as f:
                for row in scan(f, size, path, wanted, self.payload, self.verify):
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class Wrote(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.folder, self.level = options["path"], int(options.get("level", 3))
        self.file_bytes = int(options.get("file_bytes", 64 << 20))
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        files, path = store.opened(self.folder)
        files.create_dir(path, recursive=True)
        done, out, held, task = Wrote(), None, 0, TaskContext.get().partitionId()

        def finish() -> None:
            out.close()
            done.files.append(draft)

        for batch in iterator:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if out is None:
                        draft = f"{path}/part-{task:06d}-{len(done.files):05d}-{self.run}.warc.gz.{uuid.uuid4().hex}.draft"
                        out, held = files.open_output_stream(draft), 0
                    data = member(record(row), self.level)
                    out.write(data)
                    held += len(data)
                    if held >= self.file_bytes:
                        finish()
                        out = None
        if out is not None:
            finish()
        return done

    def commit(self, messages: list[Wrote | None]) -> None:
        files, path = store.opened(self.folder)
        files.create_dir(path, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda draft: store.settle(files, draft, draft.rpartition(".warc.gz.")[0] + ".warc.gz"), [x for m in messages if m for x in m.files]))
        self._clear()
        store.put(files, f"{path}/_SUCCESS", b"")

    def abort(self, messages: list[Wrote | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Deletes this writing's drafts that are left."""
        files, _ = store.opened(self.folder)
        for path, _ in store.listed(self.folder, ".draft"):
            if f"-{self.run}.warc.gz." in path:
                files.delete_file(path)


class WarcDataSource(DataSource):
    """`spark.read.format("warc")`, once registered."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:  # noqa: ANN001
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:  # noqa: ANN001
        if unknown := set(schema.names) ^ set(WRITTEN):
            raise ValueError(f"columns {', '.join(WRITTEN)} are written; not so: {sorted(unknown)}")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_archive(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def archive(df: DataFrame, folder: str, id_column: str, payload: str, url: str | None = None, min_bytes: int = 0, prefix: str = "urn:page:", date: str | None = None) -> str:
    """Writes a record for each row of df to WARC files in `folder`, and returns the folder.

    Of rows with equal payloads (text, in UTF-8; null: empty) of at least `min_bytes` bytes, that
    with the largest id is the response and the others revisit it; rows that repeat its id are
    responses too. Shorter ones are all responses. A null id counts as smaller than any;
    payloads that only rows with null ids have are all responses. A null url is left out, and
    control characters in one are percent-encoded. An empty table gives an empty folder.
    """
    register(df.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{id_column}`").alias("id"), (F.col(f"`{url}`") if url else F.lit(None)).cast("string").alias("target_uri"), body.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "sha1": F.sha1("payload")})
    largest = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    told = join_spread(rows, written(largest), "sha1", "left")
    revisits = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    name = lambda c: F.concat(F.lit(prefix), F.coalesce(c.cast("string"), F.lit("null")))
    told = told.select(name(F.col("id")).alias("record_id"), F.when(revisits, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"), F.col("sha1").alias("payload_digest"), "payload_bytes", F.when(revisits, name(F.col("largest"))).alias("refers_to"), F.when(~revisits, F.col("payload")).alias("payload"))
    told.write.format("warc").mode("append").save(folder)
    return folder


def archive_round_trip(df: DataFrame, id_column: str, payload: str, url: str | None = None, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Archives df by archive(), in a new shared folder by default, and reads the archives back, every payload decoded and verified."""
    folder = folder or shared_folder(df.sparkSession)
    return read_archive(df.sparkSession, archive(df, folder, id_column, payload, url, min_bytes))
