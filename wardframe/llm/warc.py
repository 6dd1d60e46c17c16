"""WARC archives written and read as streams of chunks.

Writing: Spark deals the rows to archives; each task turns its rows into rows of a chunked record
table (record identifier, chunk number, bytes) one after another and writes them to a file in the
shared folder, under a name of its own until it is complete, so that a repeated task after a lost
executor does no harm. Reading: each archive is read front to back in bounded blocks; a payload is
handed on as chunk rows whose digest is carried along, so no record is ever whole in memory there.

The records are plain WARC/1.1: ``response`` records hold an HTTP header and the payload,
``revisit`` records (identical payload digest profile) hold no payload and name the record they
refer to.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.session import cut_lineage, scratch_path

CHUNK = 262_144
#: Payload bytes of an archive, about; a longer payload has an archive that is longer.
ARCHIVE_BYTES = 64 * 2**20
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = b"\r\n\r\n"


@dataclass
class Record:
    """Header of one record; ``digest`` and ``size`` are complete once its chunks are consumed."""

    headers: dict[str, str]
    size: int = 0
    digest: "hashlib._Hash" = field(default_factory=hashlib.sha256)

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


def utf8_chunks(text: str, chunk: int = CHUNK) -> Iterator[bytes]:
    """The text's bytes, a bounded number of characters at a time."""
    for start in range(0, len(text), chunk):
        yield text[start:start + chunk].encode("utf-8", "replace")


def record_chunks(page_id: str, url: str, size: int, digest: str, refers_to: str | None, text: str) -> Iterator[tuple[str, int, bytes]]:
    """Rows (record, chunk number, bytes) that make up one record; chunk 0 is its header."""
    body = HTTP if refers_to is None else b""
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(size),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body) + (size if refers_to is None else 0)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    yield page_id, 0, b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body
    number = 1
    if refers_to is None:
        for data in utf8_chunks(text):
            yield page_id, number, data
            number += 1
    yield page_id, number, _END


class Reader:
    """Records of an archive, read in blocks of bounded size."""

    def __init__(self, stream: BinaryIO, chunk: int = CHUNK):
        self.stream = stream
        self.chunk = chunk
        self.rest = b""

    def _until(self, mark: bytes) -> bytes | None:
        """Bytes up to ``mark`` (consumed too); None at the clean end of the archive."""
        searched = 0  # a header may be as long as its url
        while (at := self.rest.find(mark, max(0, searched - len(mark)))) < 0:
            searched = len(self.rest)
            more = self.stream.read(self.chunk)
            if not more:
                if self.rest.strip():
                    raise ValueError("archive ends inside a header")
                return None
            self.rest += more
        found, self.rest = self.rest[:at], self.rest[at + len(mark):]
        return found

    def _take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.rest:
                self.rest = self.stream.read(self.chunk)
                if not self.rest:
                    raise ValueError("archive ends inside a record")
            part, self.rest = self.rest[:size], self.rest[size:]
            size -= len(part)
            yield part

    def chunks(self) -> Iterator[tuple[Record, int, bytes, bool]]:
        """(record, chunk number, payload bytes, last): at least one row per record."""
        while (head := self._until(b"\r\n\r\n")) is not None:
            lines = head.decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
            record = Record(headers)
            left = int(headers["content-length"])
            if left and headers.get("content-type", "").startswith("application/http"):
                http = self._until(b"\r\n\r\n")
                left -= len(http) + 4
            number = 0
            for part in self._take(left):
                record.size += len(part)
                record.digest.update(part)
                left -= len(part)
                yield record, number, part, left == 0
                number += 1
            if number == 0:
                yield record, 0, b"", True
            if b"".join(self._take(4)) != _END:
                raise ValueError("record not closed")


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Archive:
    """One archive file, a gzip member per record; it has its name only when it is complete."""

    def __init__(self, system, path: str):
        self.system, self.path, self.size, self.records = system, path, 0, 0
        self.stream = system.open_output_stream(f"{path}.open", compression=None)

    def add(self, chunks: Iterator[tuple[str, int, bytes]]) -> None:
        packed = zlib.compressobj(1, wbits=31)
        for _, _, data in chunks:
            self.stream.write(packed.compress(data))
            self.size += len(data)
        self.stream.write(packed.flush())
        self.records += 1

    def close(self) -> tuple[str, int]:
        self.stream.close()
        self.system.move(f"{self.path}.open", self.path)
        return self.path, self.records


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        system, base = _file_system(folder)
        context = TaskContext.get()
        archive, done = None, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if archive is not None and archive.size >= archive_bytes:
                    done.append(archive.close())
                    archive = None
                if archive is None:
                    system.create_dir(base, recursive=True)
                    archive = Archive(system, f"{base}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(done)}.warc.gz")
                refers = None if pd.isna(r.refers_to) else r.refers_to
                text = "" if pd.isna(r.html) or refers is not None else r.html
                url = "" if pd.isna(r.url) else r.url
                archive.add(record_chunks(str(r.page_id), url, int(r.payload_bytes), r.payload_digest, refers, text))
        if archive is not None:
            done.append(archive.close())
        yield pd.DataFrame({"archive": pd.Series([d[0] for d in done], dtype=object), "records": pd.Series([d[1] for d in done], dtype="int64")})

    return run


def _reader(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _file_system(folder)
        for batch in batches:
            for archive in batch["archive"]:
                rows = []
                with system.open_input_stream(archive, compression=None) as stream, gzip.GzipFile(fileobj=stream) as plain:
                    for record, _, _, last in Reader(plain).chunks():
                        if not last:
                            continue
                        response = record.kind == "response"
                        refers = record.headers.get("warc-refers-to")
                        declared = record.headers["warc-payload-digest"].removeprefix("sha256:")
                        if response and record.digest.hexdigest() != declared:
                            raise ValueError(f"damaged record in {archive}")
                        rows.append((
                            record.headers["warc-record-id"][10:-1], int(record.headers["warc-payload-length"]) if not response else record.size,
                            record.digest.hexdigest() if response else declared, record.kind, refers[10:-1] if refers else None,
                        ))
                        if len(rows) >= 5000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def with_references(pages: DataFrame, minimum: int = REVISIT_BYTES) -> DataFrame:
    """Adds payload_bytes, payload_digest and refers_to; equal long payloads refer to the smallest page_id.

    The digest of a long payload is the key of the join, each other row has a key of its own, so no
    key gathers rows that do not belong together; a hot payload's rows are counted down to one
    minimum before the shuffle, and the join may be split by the adaptive planner.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select(
        "page_id", "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(F.encode(payload, "utf-8"), 256).alias("payload_digest"),
    )
    long = F.col("payload_bytes") >= minimum
    first = known.where(long).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.when(long, F.col("payload_digest")).otherwise(F.concat(F.lit("page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    joined = known.withColumn("k", own).join(first.select(F.col("payload_digest").alias("k"), "first"), "k", "left").drop("k")
    return joined.withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("first")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``records`` (as of ``with_references``) and returns the archives, one row each."""
    plain = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return plain.mapInPandas(_writer(folder, archive_bytes), "archive string, records long")


def read_archives(archives: DataFrame, folder: str, kind: str = "long") -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    found = archives.select("archive").mapInPandas(_reader(folder), schema)
    return found.withColumns({c: F.expr(f"try_cast({c} AS {kind})") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes an archive record per row of page_id, url, html and reads the archives back.

    Defined results: NULL html is an empty payload; a NULL url is written empty; a NULL page_id stays
    NULL and never is the first of a group; rows that repeat the smallest page_id of their payload
    are responses each; an empty table gives an empty table; other columns are ignored.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    archives = cut_lineage(write_archives(with_references(pages), folder))
    spread = archives.repartition(max(1, archives.count()))
    return read_archives(spread, folder, pages.schema["page_id"].dataType.simpleString())
