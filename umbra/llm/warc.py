"""A Python data source for WARC files, one gzip member a record.

Reading plans partitions of whole files of about ``maxPartitionBytes``, parses a record's
headers before anything else and decides on them: predicates on the record type and the other
header columns are pushed down, and a record that fails them, or whose payload nobody asked for
(option ``payload`` is ``false``: a Python source is not told which columns are read), is
stepped over without inflating its block.  Members written
here say their length in the gzip extra field ``SL``; others are inflated to find their end.
Plain (uncompressed) files are stepped over by Content-Length.

Files are opened by their URI with Arrow's file systems on driver and executors alike.  Writing
tasks write under ``_temporary`` names of their own; only the commit renames the files, so that
failed or repeated attempts leave nothing behind that is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import join_small, materialise, shared_dir

#: What a reader returns and a writer takes; every column but the last two is a header.
COLUMNS = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
HEADERS = {
    "record_id": b"warc-record-id",
    "record_type": b"warc-type",
    "target_uri": b"warc-target-uri",
    "date": b"warc-date",
    "refers_to": b"warc-refers-to",
    "payload_digest": b"warc-payload-digest",
}
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A revisit has no payload; this header of our own keeps the length of the one it stands for.
LENGTH = b"X-Payload-Length"
DATE = "2000-01-01T00:00:00Z"
REVISIT_BYTES = 1000
#: Lengths from here on do not fit into the extra field; such members are inflated to find their end.
SAID_BELOW = 1 << 32
#: A writing task begins another file beyond so many bytes, as a file is read by one task.
FILE_BYTES = 256 << 20


# ---- bytes --------------------------------------------------------------------------------


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member that says its own length, if the field's 32 bits can hold it."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    total = 12 + 12 + len(body) + 8
    if max(total, len(record)) < SAID_BELOW:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<HII", 8, total, len(record))
    else:
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """A record's bytes; the payload follows an HTTP head.  Line ends in header values become spaces."""
    clean = lambda v: str(v).replace("\r", " ").replace("\n", " ").encode("utf-8", "surrogatepass")
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    length = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    if not revisit:
        block += payload
    lines = [b"WARC/1.1", b"WARC-Type: " + clean(row["record_type"]), b"WARC-Record-ID: " + clean(row["record_id"]), b"WARC-Date: " + clean(row["date"] or DATE)]
    for name, header in (("target_uri", b"WARC-Target-URI"), ("refers_to", b"WARC-Refers-To"), ("payload_digest", b"WARC-Payload-Digest")):
        if row[name] is not None:
            lines.append(header + b": " + clean(row[name]))
    if revisit:
        lines += [b"WARC-Profile: " + PROFILE, LENGTH + b": %d" % length]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[bytes, bytes]:
    found = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


CUT = "the file ends within a record"


class Stream:
    """Records of one open file: first the headers, then, if wanted, the block.

    A file that ends within a record is an error, whether that record's block is wanted or not:
    neither is the record left out nor its payload given short.
    """

    FIRST = 4096

    def __init__(self, file, size: int):
        self.file, self.size, self.at = file, size, 0

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __iter__(self) -> Iterator[tuple[dict[bytes, bytes], "Stream"]]:
        while self.at < self.size:
            self.start = self._read(self.at, self.FIRST)
            step = self._gzip() if self.start[:2] == b"\x1f\x8b" else self._plain()
            if step is None:  # blank lines at the end
                return
            if self.next is not None and self.next - self.slack > self.size:
                raise ValueError(CUT)
            yield step, self
            self._advance()

    def _gzip(self) -> dict[bytes, bytes] | None:
        if len(self.start) < 28:  # shorter than any member with a record in it
            raise ValueError(CUT)
        flags = self.start[3]
        at, self.next = 10, None
        if flags & 4:
            (extra,) = struct.unpack_from("<H", self.start, 10)
            k = 12
            while k + 4 <= 12 + extra:
                name, n = self.start[k : k + 2], struct.unpack_from("<H", self.start, k + 2)[0]
                if name == b"SL" and n == 8:
                    self.next = self.at + struct.unpack_from("<I", self.start, k + 4)[0]
                k += 4 + n
            at = 12 + extra
        self.inflate, self.text = zlib.decompressobj(zlib.MAX_WBITS | 16), b""
        self.pending = self.start
        while b"\r\n\r\n" not in self.text:
            more = self._more(self.FIRST)
            if not more:
                raise ValueError(CUT)
            self.text += more
        self.headers, _, self.body = self.text.partition(b"\r\n\r\n")
        self.gzip, self.slack = True, 0
        return parse_head(self.headers)

    def _more(self, most: int) -> bytes:
        """The next inflated bytes of this member, empty at its end."""
        while not self.inflate.eof:
            if not self.pending:
                chunk = self._read(self._next_chunk, 1 << 16)
                if not chunk:
                    raise ValueError(CUT)
                self._next_chunk += len(chunk)
                self.pending = chunk
            elif self.pending is self.start:
                self._next_chunk = self.at + len(self.start)
            out = self.inflate.decompress(self.pending, most)
            self.pending = self.inflate.unconsumed_tail
            if out:
                return out
        return b""

    def _plain(self) -> dict[bytes, bytes] | None:
        text = self.start.lstrip(b"\r\n")
        self.at += len(self.start) - len(text)
        if not text:
            return None
        while b"\r\n\r\n" not in text:
            more = self._read(self.at + len(text), self.FIRST)
            if not more:
                raise ValueError(CUT)
            text += more
        self.headers, _, _ = text.partition(b"\r\n\r\n")
        self.gzip, self.slack = False, 4  # the blank lines behind the block may be missing
        found = parse_head(self.headers)
        self.block_at = self.at + len(self.headers) + 4
        self.length = int(found.get(b"content-length", b"0"))
        self.next = self.block_at + self.length + 4
        return found

    def block(self, length: int) -> bytes:
        if not self.gzip:
            return self._read(self.block_at, length)
        parts, have = [self.body], len(self.body)
        while have < length and (more := self._more(1 << 20)):
            parts.append(more)
            have += len(more)
        if have < length:
            raise ValueError(CUT)
        return b"".join(parts)[:length]

    def _advance(self) -> None:
        if self.next is None:  # no length in the member: inflate to its end
            while self._more(1 << 20):
                pass
            self.at = self._next_chunk - len(self.inflate.unused_data)
        else:
            self.at = self.next


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP head, if there is one."""
    if block[:5] != b"HTTP/":
        return block
    return block.partition(b"\r\n\r\n")[2]


# ---- the data source ----------------------------------------------------------------------


def _files(path: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, root


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]
    records: int


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> "WarcReader":
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> "WarcWriter":
        return WarcWriter(self.options, overwrite)


class WarcReader(DataSourceReader):
    ROWS = 256

    def __init__(self, schema: StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.most = int(options.get("maxPartitionBytes", 64 << 20))
        self.schema = to_arrow_schema(schema)
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, (IsNotNull, StringStartsWith)):
                self.tests.append((column, "starts", ("" if isinstance(f, IsNotNull) else f.value,)))
            else:
                self.tests.append((column, "in", tuple(f.value) if isinstance(f, In) else (f.value,)))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = _files(self.path)
        kind = system.get_file_info(root)
        found = [kind] if kind.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and "/_" not in f.path[len(root) :] and not f.base_name.startswith("."))
        groups: list[Files] = []
        room = 0
        for path, size in files:
            if not groups or size > room:
                groups.append(Files([]))
                room = self.most
            groups[-1].paths.append((path, size))
            room -= size
        return groups or [Files([])]

    def wants(self, values: dict[str, str | None]) -> bool:
        return all(
            values[column] is not None and (values[column].startswith(of[0]) if how == "starts" else values[column] in of) for column, how, of in self.tests
        )

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _files(self.path)
        rows: dict[str, list] = {f.name: [] for f in self.schema}
        held = 0
        for path, size in partition.paths:
            with system.open_input_file(path) as file:
                for head, stream in Stream(file, size):
                    values = {c: head[h].decode("utf-8", "replace") if h in head else None for c, h in HEADERS.items()}
                    if values["record_type"] == "warcinfo" or not self.wants(values):
                        continue
                    length = int(head.get(b"content-length", b"0"))
                    payload = payload_of(stream.block(length)) if self.payload and values["record_type"] != "revisit" else None
                    stated = head.get(LENGTH.lower())
                    values |= {"payload": payload, "payload_bytes": int(stated) if stated is not None else None if payload is None else len(payload)}
                    for name, column in rows.items():
                        column.append(values.get(name))
                    held += 1
                    if held == self.ROWS:
                        yield pa.RecordBatch.from_pydict(rows, self.schema)
                        rows, held = {f.name: [] for f in self.schema}, 0
        if held:
            yield pa.RecordBatch.from_pydict(rows, self.schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level, self.most = int(options.get("level", 1)), int(options.get("maxFileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _files(self.path)
        names, out, count, size = [], None, 0, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.most:
                    if out is not None:
                        out.close()
                    system.create_dir(f"{root}/_temporary", recursive=True)
                    names.append(f"{root}/_temporary/{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(names[-1], compression=None), 0
                    info = b"software: umbra\r\nformat: WARC File Format 1.1\r\n"
                    out.write(member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (str(uuid.uuid4()).encode(), DATE.encode(), len(info), info)))
                data = member(record(row), self.level)
                out.write(data)
                count, size = count + 1, size + len(data)
        if out is not None:
            out.close()
        return Written(names, count)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _files(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda p: system.move(p, f"{root}/{p.rpartition('/')[2]}"), [p for m in messages if m for p in m.paths]))
        self._clean(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_files(self.path))

    @staticmethod
    def _clean(system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary")


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session and allow it to take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- pages --------------------------------------------------------------------------------


def records(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as records: of equal payloads of ``REVISIT_BYTES`` bytes or more, the one of the largest page_id is a response, the others revisit it.

    Null html is an empty payload, a null url is left out of the record.  Rows that repeat that
    largest page_id are responses too; a null page_id revisits any other and is a response if
    there is none.  An empty table gives no records; other columns, whatever their names, are
    ignored; a payload of any length is one record.

    Who revisits whom is worked out on ids and digests alone, so that the copies of a common page
    do not meet with their html; revisits have no payload and never fetch one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.length("payload").cast("long"))
    ids = materialise(rows.where(F.col("n") >= REVISIT_BYTES).drop("payload"))
    latest = ids.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1 and keeper is not null").select("digest", "keeper")
    copies = join_small(ids, materialise(latest), "digest").where(F.coalesce(F.col("page_id") < F.col("keeper"), F.lit(True)))
    copies = materialise(copies.select("page_id", "url", "digest", "n", "keeper"))
    gone = copies.select(F.col("page_id").alias("gone_id"), F.col("digest").alias("gone")).distinct()
    kept = join_small(rows, gone, (F.col("digest") == F.col("gone")) & F.col("page_id").eqNullSafe(F.col("gone_id")), "left_anti")
    urn = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">")), F.lit("<urn:page:null>"))
    every = kept.withColumn("keeper", F.lit(None).cast("long")).unionByName(copies.withColumn("payload", F.lit(None).cast("binary")))
    revisit = F.col("keeper").isNotNull()
    return every.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"),
        F.when(revisit, urn(F.col("keeper"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
        F.col("n").alias("payload_bytes"),
        "payload",
    )


def archive(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    records(pages).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = shared_dir(spark)
    archive(pages, path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    # Partitions of files as large as those of the session's other sources.
    read = spark.read.format("warc").option("maxPartitionBytes", spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()).load(path)
    response = F.col("record_type") == "response"
    return read.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )


def oracle() -> str:
    return f"""
with rows as (select page_id, encode(coalesce(html, '')) as p from pages),
d as (select page_id, octet_length(p) as n, sha1(p) as digest from rows),
k as (select digest, max(page_id) as keeper from d where n >= {REVISIT_BYTES} group by digest having count(*) > 1)
select page_id, n as payload_bytes, d.digest as payload_digest,
  case when page_id < keeper then 'revisit' else 'response' end as record_type,
  case when page_id < keeper then keeper end as refers_to
from d left join k on n >= {REVISIT_BYTES} and d.digest = k.digest
"""
