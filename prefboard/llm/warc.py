"""WARC archives as a Spark data source, and web pages written as WARC records.

Reading: the driver lists the files and plans partitions of about equal bytes. A
task parses the headers of a record first, tests them against the predicates that
were pushed down, and goes past the body of a record that is not wanted; the
payload is only decoded if the chosen schema has a column that needs it.

`read_warc` takes predicates on any header. With `pushdown`, conditions of `where`
on `record_type`, `record_id` and `target_uri` (equal, in, not null, starts with)
reach the reader as well. That is off by default: Spark 4.1 keeps the conditions
first pushed into a frame for every later use of the same frame.

Files are reached through Arrow's file systems (local, HDFS, S3, GCS).
"""

import base64
import gzip
import hashlib
import io
import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from prefboard.session import fresh_path, materialise

_PAIRS = T.MapType(T.StringType(), T.StringType())
#: All columns; a reader may be given any of them as its schema.
RECORDS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("headers", _PAIRS),
        T.StructField("http_headers", _PAIRS),
        T.StructField("payload_length", T.LongType()),
        T.StructField("payload_sha1", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
_ARROW = {
    "file": pa.string(),
    "offset": pa.int64(),
    "headers": pa.map_(pa.string(), pa.string()),
    "http_headers": pa.map_(pa.string(), pa.string()),
    "payload_length": pa.int64(),
    "payload": pa.binary(),
}
_PAYLOAD_COLUMNS = {"payload_length", "payload_sha1", "payload"}
_HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri"}
_MANIFEST = "_committed"
PARTITION_BYTES = 32 << 20
FILE_BYTES = 32 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# reading


@dataclass
class Files(InputPartition):
    paths: tuple


def _headers(lines) -> dict:
    """Lower-cased names; a line that begins with a blank continues the one before."""
    found, last = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            found[last] = value.strip()
    return found


def _head(stream) -> list:
    """Lines up to the blank one; empty at the end of the file."""
    lines = []
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if line:
            lines.append(line.decode("utf-8", "replace"))
        elif lines:
            break
    return lines


def _skip(stream, length):
    if stream.seekable():
        stream.seek(length, io.SEEK_CUR)
    else:
        while length > 0 and (part := stream.read(min(length, 1 << 20))):
            length -= len(part)


def read_records(stream, wanted=lambda headers: True, payloads=True):
    """`(offset, headers, http headers, payload)` of the wanted records of a file.

    The payload of an HTTP record is what follows its HTTP headers, of others the
    whole block; None where payloads are not asked for, or where the record holds
    none of its own (`revisit`). A file that ends within a record is an error.
    """
    while True:
        at = stream.tell()
        lines = _head(stream)
        if not lines:
            return
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}: {lines[0][:40]!r}")
        headers = _headers(lines[1:])
        length = int(headers.get("content-length", 0))
        if not wanted(headers):
            _skip(stream, length)
            continue
        block_start, http, payload = stream.tell(), {}, None
        if headers.get("content-type", "").startswith("application/http") and length:
            http = _headers(_head(stream)[1:])
        rest = length - (stream.tell() - block_start)
        if payloads and headers.get("warc-type") != "revisit":
            payload = stream.read(rest)
            if len(payload) != rest:
                raise ValueError(f"record at {at} is cut off")
        else:
            _skip(stream, rest)
        yield at, headers, http, payload


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self._columns = [f.name for f in schema.fields]
        unknown = set(self._columns) - set(RECORDS.names)
        if unknown:
            raise ValueError(f"no such WARC columns: {sorted(unknown)}")
        self._path = options["path"]
        self._bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self._tests = [(name.lower(), In((), tuple(values))) for name, values in json.loads(options.get("headers", "{}")).items()]

    def _wanted(self, headers):
        return all(name in headers and _passes(test, headers[name]) for name, test in self._tests)

    def partitions(self):
        groups, size = [[]], 0
        for path, length in sorted(_files(self._path)):
            if groups[-1] and size + length > self._bytes:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += length
        return [Files(tuple(g)) for g in groups if g] or [Files(())]

    def read(self, partition):
        system, _ = fs.FileSystem.from_uri(self._path)
        payloads = bool(_PAYLOAD_COLUMNS.intersection(self._columns))
        schema = pa.schema([(c, _ARROW.get(c, pa.string())) for c in self._columns])
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(_Raw(raw), 1 << 20)
                for record in read_records(stream, self._wanted, payloads):
                    rows.append(self._row(path, *record))
                    size += len(record[3] or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _row(self, path, offset, headers, http, payload):
        row = {"file": path, "offset": offset, "payload": payload}
        row |= {column: headers.get(name) for column, name in _HEADER_OF.items()}
        if "headers" in self._columns:
            row["headers"] = list(headers.items())
        if "http_headers" in self._columns:
            row["http_headers"] = list(http.items())
        if payload is not None:
            row["payload_length"] = len(payload)
            if "payload_sha1" in self._columns:
                row["payload_sha1"] = base32_sha1(payload)
        return {c: row.get(c) for c in self._columns}


class PushingWarcReader(WarcReader):
    """A reader that takes conditions on header columns from the optimizer."""

    def pushFilters(self, filters):
        for one in filters:
            attribute = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            if attribute in _HEADER_OF and isinstance(one, (EqualTo, In, IsNotNull, StringStartsWith)):
                self._tests.append((_HEADER_OF[attribute], one))
            else:
                yield one


class _Raw(io.RawIOBase):
    """An Arrow file for Python's buffered reader, which keeps small seeks cheap."""

    def __init__(self, file):
        self._file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset, whence=io.SEEK_SET):
        return self._file.seek(offset, whence)

    def tell(self):
        return self._file.tell()

    def readinto(self, buffer):
        data = self._file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _passes(test, value):
    if isinstance(test, EqualTo):
        return value == test.value
    if isinstance(test, In):
        return value in test.value
    return not isinstance(test, StringStartsWith) or value.startswith(test.value)


def _manifests(system, top):
    """Lists of committed files, one of each commit to a folder."""
    inside = system.get_file_info(fs.FileSelector(top))
    return sorted(x.path for x in inside if x.base_name.startswith(_MANIFEST) and x.base_name.endswith(".json"))


def _files(uri):
    """`(path, bytes)` of a folder's committed files, or of all archives below it."""
    system, top = fs.FileSystem.from_uri(uri)
    info = system.get_file_info(top)
    if info.type == fs.FileType.File:
        return [(top, info.size)]
    if manifests := _manifests(system, top):
        found = []
        for manifest in manifests:
            with system.open_input_stream(manifest) as f:
                found += [(f"{top}/{name}", size) for name, size in json.loads(f.read())]
        return found
    found = system.get_file_info(fs.FileSelector(top, recursive=True))
    return [(x.path, x.size) for x in found if x.path.endswith((".warc", ".warc.gz"))]


# writing


@dataclass
class Written(WriterCommitMessage):
    files: tuple


def _safe(value) -> str:
    """A header value without line ends."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(headers, http, payload) -> bytes:
    """One record; `http` None for a block that is the payload itself."""
    head = b""
    if http is not None:
        head = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {_safe(v)}\r\n" for k, v in http) + "\r\n").encode()
    named = "".join(f"{k}: {_safe(v)}\r\n" for k, v in headers if v is not None)
    start = f"WARC/1.1\r\n{named}Content-Length: {len(head) + len(payload)}\r\n\r\n".encode()
    return b"".join([start, head, payload, b"\r\n\r\n"])


class WarcWriter(DataSourceArrowWriter):
    """Rows `record_type, headers, http_headers, payload` as records.

    Headers are lists of pairs `(k, v)`; http headers may be null. Each task writes files under new names; only what is committed is listed in a
    manifest, so what a lost or repeated task wrote is never read. Every commit adds a
    manifest to the folder's; one that overwrites removes the earlier ones.
    """

    def __init__(self, options, overwrite=False):
        self._overwrite = overwrite
        self._path = options["path"]
        self._gzip = options.get("compress", "false") == "true"
        self._bytes = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator):
        system, top = fs.FileSystem.from_uri(self._path)
        system.create_dir(top, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in zip(*[batch.column(c).to_pylist() for c in ("headers", "http_headers", "payload")]):
                headers, http = [part and [(h["k"], h["v"]) for h in part] for part in row[:2]]
                record = record_bytes(headers or [], http, row[2] or b"")
                data = gzip.compress(record, 6) if self._gzip else record
                if out is not None and size + len(data) > self._bytes:
                    out.close()
                    files[-1][1], out = size, None
                if out is None:
                    files.append([f"part-{uuid.uuid4().hex}.warc" + ".gz" * self._gzip, 0])
                    out, size = system.open_output_stream(f"{top}/{files[-1][0]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            files[-1][1] = size
        return Written(tuple(map(tuple, files)))

    def commit(self, messages):
        system, top = fs.FileSystem.from_uri(self._path)
        system.create_dir(top, recursive=True)
        earlier = _manifests(system, top) if self._overwrite else []
        with system.open_output_stream(f"{top}/{_MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([file for m in messages if m for file in m.files]).encode())
        for manifest in earlier:
            system.delete_file(manifest)

    def abort(self, messages):
        system, top = fs.FileSystem.from_uri(self._path)
        for name, _ in (file for m in messages if m for file in m.files):
            system.delete_file(f"{top}/{name}")


class WarcDataSource(DataSource):
    """`spark.read.format("warc")` and `df.write.format("warc")`."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return RECORDS

    def reader(self, schema):
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushingWarcReader if options.get("pushdown") == "true" else WarcReader)(schema, options)

    def writer(self, schema, overwrite):
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession):
    """Makes the format known to a session."""
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path, columns=None, headers=None, pushdown=False) -> DataFrame:
    """Records of a file or folder.

    `columns` chooses what is parsed and decoded. `headers` maps names to the values
    that a record must have one of; other records are passed over unread. A frame
    made with `pushdown` is for one use.
    """
    register(spark)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    chosen = T.StructType([RECORDS[c] for c in columns or RECORDS.names])
    reader = spark.read.format("warc").schema(chosen).option("headers", json.dumps(headers or {}))
    return reader.option("pushdown", str(pushdown).lower()).load(path)


# pages as records


def page_records(pages: DataFrame, row_id="page_id", url="url", html="html", least_bytes=0, date=None) -> DataFrame:
    """`record_type, headers, http_headers, payload`: a record per page.

    Of pages with equal payloads of at least `least_bytes` bytes the one with the
    largest id is the response and the others revisit it. Payloads do not move:
    only digests and ids are grouped, and the groups of several pages come back.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    own = pages.select(
        F.col(row_id).cast("long").alias("id"), F.col(url).cast("string").alias("uri"), payload.alias("payload")
    )
    own = own.withColumn("digest", F.sha1("payload"))
    groups = own.where(F.octet_length("payload") >= least_bytes).groupBy("digest")
    several = groups.agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = own.join(materialise(several, "equal-payloads"), "digest", "left")
    named = marked.withColumn("revisits", F.coalesce(~F.col("id").eqNullSafe(F.col("first")), F.lit(False)) & F.col("first").isNotNull())
    pairs = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))

    @F.arrow_udf(returnType=T.StructType([T.StructField("headers", pairs), T.StructField("http_headers", pairs)]))
    def heads(ids, uris, digests, firsts, revisits, lengths):
        rows = [
            _page_headers(*row, date)
            for row in zip(*[c.to_pylist() for c in (ids, uris, digests, firsts, revisits, lengths)])
        ]
        kind = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))
        as_dicts = [{n: [{"k": k, "v": v} for k, v in part] for n, part in zip(("headers", "http_headers"), r)} for r in rows]
        return pa.array(as_dicts, pa.struct([("headers", kind), ("http_headers", kind)]))

    head = heads.asNondeterministic()("id", "uri", "digest", "first", "revisits", F.octet_length("payload"))
    records = named.withColumn("head", head)
    kind = F.when(F.col("revisits"), "revisit").otherwise("response")
    body = F.when(~F.col("revisits"), F.col("payload"))
    return records.select(kind.alias("record_type"), "head.headers", "head.http_headers", body.alias("payload"))


def _record_id(page, uri):
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {uri}')}>" if page is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _page_headers(page, uri, digest, first, revisits, length, date):
    headers = [
        ("WARC-Type", "revisit" if revisits else "response"),
        ("WARC-Record-ID", _record_id(page, uri)),
        ("WARC-Target-URI", uri),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Page-ID", page),
    ]
    if revisits:
        # Fixed value: the profile's name in the standard.
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("X-Refers-To-Page-ID", first),
        ]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", length)]
    named = [(k, _safe(v)) for k, v in headers if v is not None]
    return named, [(k, str(v)) for k, v in http]


def write_pages(pages: DataFrame, path=None, compress=False, **columns) -> str:
    """Writes a record per page below `path` (a new shared folder) and returns it.

    Null html is an empty payload; null urls and ids have no header. Pages with one
    id and one payload, the largest, are all responses. No pages: no records.
    """
    path = path or fresh_path(pages.sparkSession, "warc")
    register(pages.sparkSession)
    records = page_records(pages, **columns)
    records.write.format("warc").mode("append").option("compress", str(compress).lower()).save(path)
    return path


def archived_pages(spark: SparkSession, path) -> DataFrame:
    """`page_id, payload_bytes, payload_digest, record_type, refers_to`, from the archives.

    Of a response, size and digest are those of the payload as read back; of a
    revisit, those that its headers state for the payload it stands for.
    """
    columns = ["record_type", "headers", "http_headers", "payload_length", "payload_sha1"]
    records = read_warc(spark, path, columns, pushdown=True).where(F.col("record_type").isin("response", "revisit"))
    header = lambda name: F.col("headers")[name]
    stated = F.regexp_replace(header("warc-payload-digest"), "^sha1:", "")
    return records.select(
        header("x-page-id").cast("long").alias("page_id"),
        F.coalesce("payload_length", F.col("http_headers")["content-length"].cast("long")).alias("payload_bytes"),
        F.coalesce("payload_sha1", stated).alias("payload_digest"),
        "record_type",
        header("x-refers-to-page-id").cast("long").alias("refers_to"),
    )
