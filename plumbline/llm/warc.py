"""WARC archives: writing, normalising monolithic gzip files, and reading by index.

write_archives writes each partition's rows as one archive that is a single gzip
stream. The normaliser inflates such a stream once, from front to back, rewrites
every record as a gzip member of its own, and writes a sidecar index of JSON lines
with each member's offset and length. read_archives reads records through the
index. Everything streams: a writing task holds a slice of rows of some 16 MB (one row,
if it is larger) and the Arrow batch around it, a normalising or reading task one record.

Payloads are not shuffled: which digests repeat is found from digests alone, and that
list is broadcast while it is short. Beyond FEW digests only those of at least a HOT
share of all rows are; the other rows meet the rest of the list by a shuffled join,
which then has no hot key.

Archives live in the shared folder. A task writes under a name of its attempt and
then renames it to the partition's name, so a repeated attempt replaces the file.

Null payloads are empty. Payloads are equal if their SHA-1 and length are. Of equal
payloads of at least `least` bytes the row with the largest page_id is the response
(rows that tie with it are responses too) and the others are revisits; without any
page_id in the group all are responses. A row with null page_id revisits the group's
response. Null urls leave the target header out. Rows with equal page_id each get a
record. An empty table gives no records. Very long payloads are one record each. Other
columns have no effect, whatever their names.
"""

from __future__ import annotations

import atexit
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import chunks, cut, removed, shared_dir

GZIP = 31  # zlib's window bits for a gzip wrapper
BLOCK = 1 << 16
LEVEL = 6
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def header(fields: dict[str, str | int | None], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def record_head(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> dict:
    return {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]"),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": REVISIT if kind == "revisit" else None,
        "WARC-Refers-To": None if refers_to is None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>",
        "X-Page-Id": page_id,
        "X-Refers-To-Page-Id": refers_to,
        "X-Payload-Length": size,
    }


class Inflated(io.RawIOBase):
    """The bytes of a gzip file (one member or many), inflated once as they are read."""

    def __init__(self, source: BinaryIO):
        self.source, self.inflater, self.held, self.clean = source, zlib.decompressobj(GZIP), b"", True

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if not self.held:
                self.held = self.source.read(BLOCK)
                if not self.held:
                    if not self.clean:
                        raise EOFError("the gzip stream is cut short")
                    return 0
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(GZIP)
            self.clean = False
            out = self.inflater.decompress(self.held, len(into))
            self.held = self.inflater.unconsumed_tail or (self.inflater.unused_data if self.inflater.eof else b"")
            self.clean = self.inflater.eof
            if out:
                into[: len(out)] = out
                return len(out)


def records(stream: io.BufferedReader) -> Iterator[tuple[bytes, dict[str, str], int]]:
    """(head as it stands, fields in lower case, block length) of each record; the caller reads the block before going on."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
        head, fields = [line], {}
        while True:
            line = stream.readline()
            if not line:
                raise EOFError("the archive ends inside a head")
            head.append(line)
            if line in (b"\r\n", b"\n"):
                break
            key, _, value = line.decode().partition(":")
            fields[key.strip().lower()] = value.strip()
        yield b"".join(head), fields, int(fields["content-length"])


def blocks(stream: io.BufferedReader, length: int) -> Iterator[bytes]:
    while length:
        got = stream.read(min(BLOCK, length))
        if not got:
            raise EOFError("the archive ends inside a block")
        length -= len(got)
        yield got


def normalise(source: BinaryIO, target: BinaryIO, index: BinaryIO, level: int = LEVEL) -> int:
    """Rewrite a gzip archive with a member for each record, and its index; returns the number of records."""
    stream = io.BufferedReader(Inflated(source), BLOCK)
    offset = n = 0
    for head, fields, length in records(stream):
        packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
        written = 0
        for part in chain((head,), blocks(stream, length), (b"\r\n\r\n", None)):
            out = packer.flush() if part is None else packer.compress(part)
            target.write(out)
            written += len(out)
        entry = {"offset": offset, "length": written, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
        index.write(json.dumps(entry).encode() + b"\n")
        offset += written
        n += 1
    return n


def member(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Fields and payload of the record in one member."""
    source.seek(offset)
    whole = io.BytesIO(zlib.decompress(source.read(length), GZIP))
    _, fields, n = next(records(whole))
    block = whole.read(n)
    _, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    return fields, payload


#: Hadoop's names of stores that Arrow knows by others.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def _fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme, mark, rest = uri.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")


def _out(fs, path: str):
    return fs.open_output_stream(path, compression=None)


def _settle(fs, made: str, final: str) -> None:
    """Give a finished file its name; on stores that don't replace, the old one goes first."""
    try:
        fs.move(made, final)
    except OSError:
        fs.delete_file(final)
        fs.move(made, final)


#: Repeated digests up to which they are broadcast (some 100 bytes each), and the share of repeats from which one is beyond that.
FEW, HOT = 200_000, 1 / 1024


def with_revisits(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", few: int = FEW) -> DataFrame:
    """page_id, url, payload (null for revisits), digest, size, refers_to of each row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("size"))
    own = F.col("size") >= least
    found = rows.where(own).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = cut(found.select(F.col("digest").alias("d"), F.col("size").alias("s"), "first", "n"))
    meets = (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s"))
    if same.count() <= few:
        joined = rows.join(F.broadcast(same), meets, "left")
    else:
        hot = F.col("n") >= same.agg(F.sum("n")).first()[0] * HOT
        first = rows.join(F.broadcast(same.where(hot)), meets, "left")  # at most 1 / HOT rows
        rest = first.where(own & F.col("d").isNull()).drop("d", "s", "first", "n").join(same.where(~hot), meets, "left")
        joined = first.where(~own | F.col("d").isNotNull()).unionByName(rest)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """One monolithic archive for each partition of rows; (name) of those that hold a record."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}"
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        draft, n = f"{root}/{name}.{task.taskAttemptId()}.draft", 0
        packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
        with _out(fs, draft) as out:
            for b in chunks(batches, rows=64):
                for r in b.to_pylist():
                    kind = "response" if r["refers_to"] is None else "revisit"
                    parts = (HTTP,) if kind == "revisit" else (HTTP, r["payload"])
                    head = header(record_head(kind, r["page_id"], r["url"], r["digest"], r["size"], r["refers_to"]), sum(map(len, parts)))
                    for part in (head, *parts, b"\r\n\r\n"):
                        out.write(packer.compress(part))
                    n += 1
            out.write(packer.flush())
        _settle(fs, draft, f"{root}/{name}.whole.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([name] if n else [], pa.string())], ["name"])

    return rows.mapInArrow(run, "name string")


def normalise_archives(names: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Normalise each named archive of the folder; (name, records)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        mark = TaskContext.get().taskAttemptId()
        for b in batches:
            counts = []
            for name in b.column(0).to_pylist():
                drafts = [f"{root}/{name}.{mark}.{x}.draft" for x in ("warc", "index")]
                with fs.open_input_stream(f"{root}/{name}.whole.warc.gz", compression=None) as source, _out(fs, drafts[0]) as target, _out(fs, drafts[1]) as index:
                    counts.append(normalise(source, target, index, level))
                _settle(fs, drafts[0], f"{root}/{name}.warc.gz")
                _settle(fs, drafts[1], f"{root}/{name}.index.jsonl")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["name", "records"])

    return names.select("name").mapInArrow(run, "name string, records bigint")


def read_archives(names: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the normalised archives, found through their indexes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())][: 7 if with_payload else 6]

        def batch(rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds)], [k for k, _ in kinds])

        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}.index.jsonl", compression=None) as index, fs.open_input_file(f"{root}/{name}.warc.gz") as source:
                    rows, room = [], 0
                    for line in io.TextIOWrapper(io.BufferedReader(index), "utf-8"):
                        entry = json.loads(line)
                        fields, payload = member(source, entry["offset"], entry["length"])
                        kind = fields["warc-type"]
                        digest = hashlib.sha1(payload).hexdigest() if kind == "response" else fields["warc-payload-digest"].removeprefix("sha1:")
                        if f"sha1:{digest}" != fields["warc-payload-digest"]:
                            raise ValueError(f"a payload of {name} at {entry['offset']} differs from its digest")
                        size = len(payload) if kind == "response" else int(fields["x-payload-length"])
                        page, refers = (int(x) if (x := fields.get(k)) is not None else None for k in ("x-page-id", "x-refers-to-page-id"))
                        rows.append((page, size, digest, kind, refers, fields.get("warc-target-uri"), payload if kind == "response" else None))
                        room += len(payload) * with_payload
                        if len(rows) >= 4096 or room > 16 << 20:
                            yield batch(rows)
                            rows, room = [], 0
                    if rows:
                        yield batch(rows)

    return names.select("name").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + ", payload binary" * with_payload)


def archive_pages(pages: DataFrame, least: int = 1000, folder: str | None = None, with_payload: bool = False, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as archives, normalise them, and read every record back.

    folder: where to leave the archives; by default one in the shared folder that is
    removed when the program ends.
    """
    spark = pages.sparkSession
    if folder is None:
        folder = f"{shared_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
        atexit.register(removed, spark, folder)
    names = cut(write_archives(with_revisits(pages, least, id_col, url_col, html_col), folder))
    done = cut(normalise_archives(names, folder))
    return read_archives(done, folder, with_payload)
