"""WARC files: from one gzip stream to a member a record, with an offset index."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweir.llm._common import filesystem, materialise, pick, put, remove, shared_dir, ship

CHUNK = 1 << 20
GZIP = 31  # zlib's window bits for a gzip wrapper
ROWS = 10_000  # of an index that are held at once
INDEX = "record_id string, url string, file string, offset bigint, length bigint, n_bytes bigint, digest string"
TYPES = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in INDEX.split(", ")])


class Member:
    """A gzip member written piece by piece; counts its bytes."""

    def __init__(self, sink, level: int):
        self.sink, self.z, self.size = sink, zlib.compressobj(level, zlib.DEFLATED, GZIP), 0

    def write(self, data: bytes) -> None:
        self._put(self.z.compress(data))

    def close(self) -> int:
        self._put(self.z.flush())
        return self.size

    def _put(self, out: bytes) -> None:
        if out:
            self.sink.write(out)
            self.size += len(out)


def inflate(source) -> Iterator[bytes]:
    """The inflated bytes of a gzip file, one member or many, in pieces of bounded size."""
    z, data = zlib.decompressobj(GZIP), source.read(CHUNK)
    while data:
        out = z.decompress(data, CHUNK)
        if out:
            yield out
        data = z.unconsumed_tail
        if z.eof:
            data = z.unused_data
            if not data:
                data = source.read(CHUNK)
            data = data.lstrip(b"\0")  # padding between members
            if data:
                z = zlib.decompressobj(GZIP)
        elif not data:
            data = source.read(CHUNK)
            if not data and not z.eof:
                rest = z.flush()
                if rest:
                    yield rest
                if not z.eof:
                    raise EOFError("the gzip stream is cut short")


class Reader:
    """Reads a stream of pieces by line and by length."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    def line(self) -> bytes | None:
        """The next line with its end, or None at the end of the stream."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self.more():
                rest, self.held, self.at = self.held[self.at :], b"", 0
                return rest or None
        line, self.at = self.held[self.at : end + 1], end + 1
        return line

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.held) and not self.more():
                raise EOFError("a record is cut short")
            piece = self.held[self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            yield piece


def records(reader: Reader) -> Iterator[tuple[bytes, dict[str, str], int]]:
    """Of each record: its head as it is, its fields, its content's length. The caller takes the content."""
    while (line := reader.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head, fields = [line], {}
        while (line := reader.line()) is not None:
            head.append(line)
            if not line.strip():
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield b"".join(head), fields, int(fields.get("content-length", 0))


def normalised(source_uri: str, target_uri: str, level: int = 1) -> Iterator[pa.RecordBatch]:
    """Rewrite one WARC file; its index rows, ROWS at a time. The file and its sidecar appear under their names only when
    they are whole, so an attempt that is lost leaves nothing that could be mistaken for them."""
    fs, source = filesystem(source_uri)
    to, target = filesystem(target_uri)
    part = f"{target}.{uuid.uuid4().hex}.part"
    rows, offset, name = [], 0, target_uri.rsplit("/", 1)[-1]
    with fs.open_input_stream(source, compression=None) as f, to.open_output_stream(part, compression=None) as out, pq.ParquetWriter(f"{part}.idx", TYPES, filesystem=to) as sidecar:

        def handed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES.types)], schema=TYPES)
            sidecar.write_batch(batch)
            rows.clear()
            return batch

        reader = Reader(inflate(f))
        for head, fields, length in records(reader):
            member, digest = Member(out, level), hashlib.md5(usedforsecurity=False)
            member.write(head)
            for piece in reader.take(length):
                digest.update(piece)
                member.write(piece)
            member.write(b"\r\n\r\n")
            size = member.close()
            rows.append((fields.get("warc-record-id"), fields.get("warc-target-uri"), name, offset, size, length, digest.hexdigest()))
            offset += size
            if len(rows) == ROWS:
                yield handed()
        if rows:
            yield handed()
    put(to, part, target)
    put(to, f"{part}.idx", f"{target}.idx.parquet")


def read_record(uri: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record's fields and content, by its index row: one seek, one member."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        data = zlib.decompress(f.read(length), GZIP)
    reader = Reader(iter([data]))
    _, fields, n = next(records(reader))
    return fields, b"".join(reader.take(n))


def target_names(files: list[str]) -> dict[str, str]:
    """Of each file, its name below the target: its path from the folder that all have in common, with "__" for "/"."""
    paths = {f: f.split("/") for f in dict.fromkeys(files)}
    common = 0
    while len({tuple(p[: common + 1]) for p in paths.values()}) == 1 and all(len(p) > common + 1 for p in paths.values()):
        common += 1
    names = {f: "__".join(x for x in p[common:] if x) for f, p in paths.items()}
    if len(set(names.values())) < len(names):
        twice = sorted(f for f, n in names.items() if list(names.values()).count(n) > 1)
        raise ValueError(f"files would get the same name: {twice[:4]}")
    return names


def normalise(spark: SparkSession, files: list[str], target: str, level: int = 1) -> DataFrame:
    """Normalise WARC files: each is inflated once as one stream, every record is written as a gzip member of its own
    to a file below `target`, and a sidecar index (<name>.idx.parquet) is written beside it. The work is done at once, and
    once; the result is the index of all, read from the shared folder: record_id, url, file, offset, length, n_bytes,
    digest (MD5 of the content).

    A file keeps its name; files of several folders have the folders' names before theirs, and two that would get one
    name are refused before any work. A file named twice is one file. Memory is bounded whatever the file's or the
    record's size or the number of records. A file is one task, as a gzip stream can't be split. Files of many members
    are taken too. An empty file gives no rows; one that is cut short fails. Fields that a record lacks are null.
    """
    fs, path = filesystem(target)
    fs.create_dir(path, recursive=True)
    names = target_names(files)
    rows = spark.createDataFrame(list(names.items()), "path string, name string").repartition(max(1, len(names)), "path") if names else spark.createDataFrame([], "path string, name string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, name in zip(*(c.to_pylist() for c in batch.columns)):
                yield from normalised(source, f"{target}/{name}", level)

    return materialise(rows.mapInArrow(work, INDEX), "warc-index")


def write_monolithic(pages: DataFrame, target: str, level: int = 1) -> DataFrame:
    """Write pages as WARC files of one gzip stream each, a file a partition: (file, n). A page's record holds its html
    (empty for null, marked by the field X-Null), its url where there is one, and its page_id as the record's id."""
    fs, path = filesystem(target)
    fs.create_dir(path, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        to, p = filesystem(target)
        part, n = f"{p}/{name}.{uuid.uuid4().hex}.part", 0
        with to.open_output_stream(part, compression=None) as out:
            member = Member(out, level)
            for batch in batches:
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    body = (html or "").encode()
                    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: {'' if page is None else page}"]
                    if url is not None:
                        head.append("WARC-Target-URI: " + " ".join(url.split()))
                    if html is None:
                        head.append("X-Null: 1")
                    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
                    member.write("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")
                    n += 1
            member.close()
        put(to, part, f"{p}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{target}/{name}"]), pa.array([n], pa.int64())], ["file", "n"])

    return pick(pages, "page_id", "url", "html").mapInArrow(work, "file string, n bigint")


def pages_index(pages: DataFrame) -> DataFrame:
    """Pages through the whole way: written as monolithic WARC files to the shared folder, normalised there, indexed.

    page_id, url, file, offset, length, n_bytes, digest; one row a page, in no order. A null html is an empty record, a
    null url or page_id stays null; white space in a url is put as single spaces, as a header line can't hold others.
    Repeated rows are records of their own; nothing depends on order, so ties decide nothing. A html of any length is
    written whole. An empty table gives no rows. Other columns are ignored. The files stay in the shared folder, in
    "normal"; those they were made of go."""
    spark = pages.sparkSession
    at = shared_dir(spark, "warc")
    files = [r["file"] for r in write_monolithic(pages, f"{at}/monolithic").collect()]  # one name a file
    index = normalise(spark, sorted(files), f"{at}/normal")
    remove(f"{at}/monolithic")
    return index.select(F.when(F.col("record_id") != "", F.col("record_id")).cast("bigint").alias("page_id"), "url", "file", "offset", "length", "n_bytes", "digest")


ship(__name__)
