"""A Spark data source for gzipped WARC 1.1 archives.

Writing: each task writes its archives under a folder of the job, and the driver moves
the files of committed tasks to their place, so a task that runs twice leaves no double
records. Reading: a partition an archive, one record in memory at a time.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "page_id long, target_uri string, warc_type string, refers_to long, refers_to_uri string, payload_digest string, payload_bytes long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 64 << 20


def _record_id(page_id: int | None, uri: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri} {digest}')}>"


def record(row: dict, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record: fresh headers, and for a response the HTTP block with its payload."""
    clean = lambda s: (s or "").replace("\r", "%0D").replace("\n", "%0A")
    payload, kind, uri = row["payload"] or b"", row["warc_type"], clean(row["target_uri"])
    head = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(row["page_id"], row["target_uri"], row["payload_digest"])), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("WARC-Payload-Length", row["payload_bytes"])]
    head += [("WARC-Target-URI", uri)] if row["target_uri"] is not None else []
    head += [("WARC-Page-ID", row["page_id"])] if row["page_id"] is not None else []
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(row["refers_to"], row["refers_to_uri"], row["payload_digest"]))]
        head += [("WARC-Refers-To-Page-ID", row["refers_to"])] if row["refers_to"] is not None else []
        head += [("WARC-Refers-To-Target-URI", clean(row["refers_to_uri"]))] if row["refers_to_uri"] is not None else []
    block = http if kind == "revisit" else http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(stream) -> Iterator[dict]:
    """Records of an unzipped archive."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        number = lambda k: int(head[k]) if k in head else None
        payload = block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None
        yield {"page_id": number("WARC-Page-ID"), "target_uri": head.get("WARC-Target-URI"), "warc_type": head["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID"), "refers_to_uri": head.get("WARC-Refers-To-Target-URI"), "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": number("WARC-Payload-Length"), "payload": payload}


@dataclass
class Files(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


@dataclass
class Archive(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{base}/{self.job}", recursive=True)
        done, out, size = Files(), None, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if out is None:
                        done.names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{base}/{self.job}/{done.names[-1]}", compression=None), 0
                    size += out.write(gzip.compress(record(row), 4, mtime=0)) or 0
                    size = out.tell()
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list[Files | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        for i, name in enumerate(sorted(n for m in messages if m for n in m.names)):
            store.move(f"{base}/{self.job}/{name}", f"{base}/part-{i:05}-{name}")
        self.abort(messages)

    def abort(self, messages: list[Files | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{base}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.job}")


class WarcReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def partitions(self) -> list[Archive]:
        store, base = fs.FileSystem.from_uri(self.path)
        found = [f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".warc.gz")]
        return [Archive(p) for p in sorted(found)] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[tuple]:
        if partition.path:
            store, _ = fs.FileSystem.from_uri(self.path)
            with store.open_input_stream(partition.path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                for x in parse(stream):
                    yield tuple(x.values())


class WarcSource(DataSource):
    """``format("warc")``: option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])
