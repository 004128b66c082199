"""WARC archives as a PySpark Python data source.

Writing: each task writes one file of gzip members, one per record and a `warcinfo` first; a file appears under its own name only when the
job commits, and what failed attempts left is deleted then. A member's header tells its length (the "sl" field of the WARC standard's annex on
compression), so that readers can go on to the next record without unpacking this one. Reading: the driver plans partitions from the
list of files, small files together. Predicates on headers are taken over by the source. A task parses a record's header block first; where
that rules the record out, or the payload isn't asked for (option `payload` = false), the payload is neither unpacked (if the member's length is told,
or the file isn't compressed) nor decoded.

Paths go through pyarrow's file systems, so any store that it knows will do; other stores need a path that is mounted on all machines.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from lintel.llm.common import saved, shared_folder

SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, record_id string, date string"
#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 100
#: Bytes of small files that share a partition, and bytes that a reader asks its store for.
PARTITION_BYTES, STEP = 64 << 20, 1 << 16
HTTP = "application/http"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path)


def _uri(path: str) -> str:
    return path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else path


def _record(head: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member: version line, headers, blank line, block, two line ends."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": str(len(block))}).items())
    data = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    told = len(body) + 32 < 1 << 32 > len(data)
    extra = struct.pack("<HccHII", 12, b"s", b"l", 8, len(body) + 32, len(data)) if told else b""
    return struct.pack("<BBBBIBB", 31, 139, 8, 4 if told else 0, 0, 0, 255) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _page_record(row: dict, date: str) -> bytes:
    payload = bytes(row["payload"]) if row["payload"] is not None else b""
    revisit = row["record_type"] == "revisit"
    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(row["payload_bytes"]).encode() + b"\r\n\r\n"
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        "WARC-Date": date,
        "WARC-Target-URI": (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "X-Payload-Length": str(row["payload_bytes"]),
        **({"WARC-Refers-To": f"<urn:page:{row['refers_to']}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} if revisit else {}),
        "Content-Type": f"{HTTP}; msgtype=response",
    }
    return _record(head, answer if revisit else answer + payload)


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


@dataclass
class WarcWriter(DataSourceWriter):
    path: str
    job: str = field(default_factory=lambda: uuid.uuid4().hex[:12])

    def write(self, rows):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name, out = f"{root}/part-{self.job}-{uuid.uuid4().hex}.warc.gz", None
        date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        for row in rows:
            if out is None:
                out = store.open_output_stream(name + ".open", compression=None)
                out.write(_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
            out.write(_page_record(row.asDict(), date))
        if out is None:
            return _Written(None)
        out.close()
        return _Written(name)

    def commit(self, messages):
        store, _ = _store(self.path)
        for m in messages:
            if m is not None and m.path:
                store.move(m.path + ".open", m.path)
        self.abort(())

    def abort(self, messages):
        """Also after a commit: what attempts of this job left that did not count."""
        from pyarrow import fs

        store, root = _store(self.path)
        for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(f"part-{self.job}-") and x.path.endswith(".open"):
                store.delete_file(x.path)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in NAMES and name not in ("payload", "payload_bytes"):
                self.wanted.setdefault(name, []).append({f.value} if isinstance(f, EqualTo) else set(f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.path)
        parts, room = [_Files([])], PARTITION_BYTES
        for x in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda x: x.path):
            if x.path.endswith((".warc.gz", ".warc")):
                if x.size > room and parts[-1].paths:
                    parts.append(_Files([]))
                    room = PARTITION_BYTES
                parts[-1].paths.append(x.path)
                room -= x.size
        return parts

    def read(self, partition):
        store, _ = _store(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as file:
                yield from self.rows((_Zipped if path.endswith(".gz") else _Plain)(_Input(file)))

    def rows(self, source):
        while (head := source.head()) is not None:
            row = self._row(head)
            length, http = int(head.get("content-length", 0)), head.get("content-type", "").replace(" ", "").startswith(HTTP)
            if not all(row[NAMES.index(name)] in s for name, sets in self.wanted.items() for s in sets):
                source.skip(length)
                continue
            if self.payload:
                block = source.take(length)
                payload = block.partition(b"\r\n\r\n")[2] if http else block
                row[PAYLOAD] = None if row[2] == "revisit" else payload
                if row[PAYLOAD - 1] is None and row[2] != "revisit":
                    row[PAYLOAD - 1] = len(payload)
            else:
                source.skip(length)
            yield tuple(row)

    @staticmethod
    def _row(head: dict) -> list:
        page = lambda x: int(x[10:-1]) if x and x.startswith("<urn:page:") and x[10:-1].lstrip("-").isdigit() else None
        length = head.get("x-payload-length", "")
        return [
            page(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-type"), page(head.get("warc-refers-to")),
            head.get("warc-payload-digest", "").removeprefix("sha256:"), int(length) if length.isdigit() else None, None, head.get("warc-record-id"), head.get("warc-date"),
        ]


NAMES = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "record_id", "date")
PAYLOAD = NAMES.index("payload")


class _Input:
    """A file read in steps from the place `at` on."""

    def __init__(self, file):
        self.file, self.data, self.at = file, b"", 0

    def peek(self, n: int) -> bytes:
        """What is read ahead, n bytes at least unless the file ends."""
        while len(self.data) < n and (more := self.file.read(max(STEP, n - len(self.data)))):
            self.data += more
        return self.data

    def drop(self, n: int) -> None:
        self.at += n
        if n > len(self.data):
            self.file.seek(self.at)
        self.data = self.data[n:]


class _Plain:
    """Records of an uncompressed archive."""

    def __init__(self, source: _Input):
        self.source = source

    def peek(self, n: int) -> bytes:
        return self.source.peek(n)

    def drop(self, n: int) -> None:
        self.source.drop(n)

    def head(self) -> dict[str, str] | None:
        """Headers of the next record, names in lower case; None at the end of the file."""
        n = 1
        while blank := len(data := self.peek(n)) - len(data.lstrip(b"\r\n")):
            self.drop(blank)
        while data and (end := data.find(b"\r\n\r\n")) < 0:
            n = len(data) + 1
            data = self.peek(n)
            if len(data) < n:
                raise EOFError("a record's headers break off")
        if not data:
            return None
        lines = data[:end].decode("utf-8", "replace").replace("\r\n ", " ").split("\r\n")[1:]
        self.drop(end + 4)
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    def take(self, n: int) -> bytes:
        data = self.peek(n)
        if len(data) < n:
            raise EOFError("a record breaks off")
        self.drop(n)
        return data[:n]

    def skip(self, n: int) -> None:
        self.drop(n)


class _Zipped(_Plain):
    """Records of gzip members."""

    def __init__(self, source: _Input):
        super().__init__(source)
        self.unzip, self.data, self.end = None, b"", None

    def more(self) -> bool:
        """Unpack a little further: of a member at first no more than headers take."""
        size = STEP
        if self.unzip is None:
            size = 4096
            start = self.source.peek(24)
            if not start:
                return False
            told = len(start) >= 24 and start[3] & 4 and start[12:16] == b"sl\x08\x00"
            self.end = self.source.at + struct.unpack_from("<I", start, 16)[0] if told else None
            self.unzip = zlib.decompressobj(31)
        packed = self.source.peek(1)
        if not packed:
            raise EOFError("a record breaks off")
        self.data += self.unzip.decompress(packed, size)
        self.source.drop(len(packed) - len(self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail))
        if self.unzip.eof:
            self.unzip = None
        return True

    def peek(self, n: int) -> bytes:
        while len(self.data) < n and self.more():
            pass
        return self.data

    def drop(self, n: int) -> None:
        while n > len(self.data):
            n -= len(self.data)
            self.data = b""
            if not self.more():
                raise EOFError("a record breaks off")
        self.data = self.data[n:]

    def skip(self, n: int) -> None:
        """Where a member tells its length it holds one record, and what is left of it needs no unpacking."""
        if n > len(self.data) and self.unzip is not None and self.end is not None:
            self.source.drop(self.end - self.source.at)
            self.unzip, self.data = None, b""
        else:
            self.drop(n)


class WarcSource(DataSource):
    """format("warc"): options path, payload (true).

    Reads *.warc.gz and *.warc of any origin, all record types; page_id and refers_to are null where a record's id isn't of the form
    urn:page:N, payload_bytes where neither header nor payload tells it. Revisits have no payload.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(_uri(self.options["path"]), self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(_uri(self.options["path"]))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame) -> DataFrame:
    """WARC records of pages (page_id, url, html), in the columns of SCHEMA.

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least LEAST_BYTES bytes, the one with the
    least page_id is a response, the others are revisits that refer to it; smaller ones are all responses. A null page_id comes after all others; if
    all are null, all are responses. Rows with one page_id and equal payloads are all responses. Other columns are ignored. An empty table gives no
    records. Very long payloads are written and read whole, one at a time.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    # Saved, so that the join has two plain sides and a payload that very many pages have can be split.
    marked = rows.join(saved(first, "first"), "payload_digest", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return marked.select("page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"))


def write(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    records(pages).write.format("warc").mode("append").save(path)


def read(spark, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as archives and read them back: SCHEMA, with digest and length of full payloads from the payload itself where there is one."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex[:12]}"
    write(pages, path)
    found = read(spark, path).where(F.col("record_type").isin("response", "revisit"))
    response = F.col("record_type") == "response"
    return found.withColumns({"payload_digest": F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")), "payload_bytes": F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))})


