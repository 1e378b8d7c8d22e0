"""Operator 1: WARC normaliser: whole-file gzip streams become one gzip member a record, with a sidecar offset index.

A monolithic .warc.gz can't be entered in the middle. Each file is inflated once, from front to back; every record is written as a member of its own, so
the new file is the same WARC to any reader, and the index (file, record, offset, length, ...) lets a single range read get any record.

Scale: a gzip stream can't be split, so a file is the unit of work: one task a file, spread by Spark over the cluster, with blocks of 1 MB in memory and never
more than one record's body. Only the index, some 200 bytes a record, goes through Spark. A task writes under a name of its own and renames at the end, so a
task that runs twice leaves one whole file. Paths are URIs that pyarrow.fs opens (file, hdfs, s3, ...).

Defined results: an empty file gives an empty file and no index rows. A file that is cut off, damaged or isn't gzip gives the records that are whole before the fault, and one
row with record -1 and the reason in `error`. Files that already have many members are read through. A record without Content-Length, or with one that isn't a number, is a
fault. Records may repeat, headers may repeat (the first counts) and be in any case; those that the record lacks are null in the index. Bodies may be empty and of any length.

pages_to_monolithic writes such files from the pages table: a null html gives an empty body, a null url no target, a null page_id no id; control characters in a url are percent-encoded.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
INDEX = "file string, record long, offset long, length long, start long, body_length long, warc_type string, record_id string, target_uri string, body_sha256 string, error string"


def _open(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    return where, path


# == reading


class Fault(Exception):
    pass


def inflate(read):
    """Blocks of the whole stream, over all its members."""
    inflater, fresh = zlib.decompressobj(31), True
    while data := read(BLOCK):
        while data:
            if inflater.eof:
                inflater, fresh = zlib.decompressobj(31), True
            before = inflater.copy()
            try:
                out = inflater.decompress(data, BLOCK)
            except zlib.error as e:
                try:  # what comes before the fault is still good
                    for k in range(len(data)):
                        if out := before.decompress(data[k : k + 1]):
                            yield out
                except zlib.error:
                    pass
                raise Fault(f"not gzip: {e}") from e
            fresh = False
            if out:
                yield out
            data = inflater.unconsumed_tail or inflater.unused_data
            while not data and not inflater.eof:  # what the inflater still holds
                out = inflater.decompress(b"", BLOCK)
                if not out:
                    break
                yield out
    if not fresh and not inflater.eof:
        raise Fault("stream is cut off")


class _Reader:
    def __init__(self, parts):
        self.parts, self.have, self.at = parts, bytearray(), 0

    def fill(self) -> bool:
        part = next(self.parts, b"")
        self.have += part
        return bool(part)

    def take(self, n: int) -> bytes:
        out = bytes(self.have[:n])
        del self.have[:n]
        self.at += len(out)
        return out


def records(read):
    """(start in the inflated stream, header bytes, headers, iterator of body blocks) of each record; the iterator must be used up."""
    r = _Reader(inflate(read))
    while True:
        while not r.have.lstrip(b"\r\n"):
            r.take(len(r.have))
            if not r.fill():
                return
        r.take(len(r.have) - len(r.have.lstrip(b"\r\n")))
        looked = 0
        while (end := r.have.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(r.have) - 3)
            if not r.fill():
                raise Fault("header is cut off")
        start, head = r.at, r.take(end + 4)
        if not head.startswith(b"WARC/"):
            raise Fault("no WARC record")
        headers: dict[str, str] = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                headers.setdefault(name.strip().lower(), value.strip())
        size = headers.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            raise Fault("no Content-Length")
        left = int(size)

        def body(left=left):
            while left:
                if not r.have and not r.fill():
                    raise Fault("body is cut off")
                part = r.take(min(left, len(r.have)))
                left -= len(part)
                yield part

        yield start, head, headers, body()


# == normalising


def normalise_file(source: str, target: str) -> list[tuple]:
    """Rewrites one file; returns its index rows."""
    (from_fs, from_path), (to_fs, to_path) = _open(source), _open(target)
    made = f"{to_path}.{uuid.uuid4().hex}.part"
    rows: list[tuple] = []
    with from_fs.open_input_stream(from_path, compression=None) as src, to_fs.open_output_stream(made, compression=None) as out:
        offset = 0
        try:
            for number, (start, head, headers, body) in enumerate(records(src.read)):
                deflater, sha, size = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha256(), 0
                # a record's member is written only when its body is whole
                member = [deflater.compress(head)]
                for part in body:
                    sha.update(part)
                    size += len(part)
                    member.append(deflater.compress(part))
                member += [deflater.compress(b"\r\n\r\n"), deflater.flush()]
                length = sum(map(len, member))
                for part in member:
                    out.write(part)
                rows.append((target, number, offset, length, start, size, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), sha.hexdigest(), None))
                offset += length
        except Fault as e:
            rows.append((target, -1, offset, 0, None, None, None, None, None, None, str(e)))
    to_fs.move(made, to_path)
    return rows


def normalise(spark: SparkSession, files: list[str], target: str) -> DataFrame:
    """Rewrites the files below the folder `target` and gives their index. The index is a plan: write it (write_index) to do the work once."""
    where, path = _open(target)
    where.create_dir(path, recursive=True)
    names = [f.rstrip("/").rsplit("/", 1)[-1] for f in files]
    if len(set(names)) < len(names):
        raise ValueError("two files have one name")
    # the list of files is all that is on the driver; each row is a task of its own
    x = spark.createDataFrame([(f, f"{target}/{n}") for f, n in zip(files, names)], "source string, target string").repartition(max(1, len(files)))

    def run(batches):
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                rows = normalise_file(a, b)
                columns = list(zip(*rows)) if rows else [[]] * 11
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    return x.mapInArrow(run, INDEX)


_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in INDEX.split(", ")]


def write_index(index: DataFrame, path: str) -> DataFrame:
    """Does the rewriting and writes the sidecar index; a table to be read."""
    index.write.parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def read_records(index: DataFrame) -> DataFrame:
    """index rows with the record's body, each by one range read; a file is opened once for rows of it that follow each other."""

    def run(batches):
        opened, f = None, None
        try:
            for batch in batches:
                bodies = []
                for name, offset, length, record in zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length", "record"))):
                    if record is None or record < 0:
                        bodies.append(None)
                        continue
                    if name != opened:
                        if f:
                            f.close()
                        where, path = _open(name)
                        opened, f = name, where.open_input_file(path)
                    member = zlib.decompress(f.read_at(length, offset), 31)
                    bodies.append(member[member.index(b"\r\n\r\n") + 4 : -4])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.binary())], names=[*batch.schema.names, "body"])
        finally:
            if f:
                f.close()

    return index.mapInArrow(run, INDEX + ", body binary")


# == files to normalise


def pages_to_monolithic(pages: DataFrame, target: str) -> list[str]:
    """Writes one whole-stream gzip WARC for each partition of pages below the folder `target`; the files' URIs."""
    where, path = _open(target)
    where.create_dir(path, recursive=True)

    def run(batches):
        name = f"{target}/{uuid.uuid4().hex}.warc.gz"
        to_fs, to_path = _open(name)
        deflater, out = zlib.compressobj(1, zlib.DEFLATED, 31), None
        for batch in batches:
            for i, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or to_fs.open_output_stream(to_path, compression=None)
                body = (html or "").encode()
                head = ["WARC/1.0", "WARC-Type: resource"]
                head += [] if i is None else [f"WARC-Record-ID: <urn:page:{i}>"]
                head += [] if url is None else ["WARC-Target-URI: " + "".join(urllib.parse.quote(c) if c < " " or c == "\x7f" else c for c in url)]
                head += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
                out.write(deflater.compress("\r\n".join(head).encode() + body + b"\r\n\r\n"))
        if out:
            out.write(deflater.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    # the names that tasks report are the files that count: those of lost attempts are never read
    return [r.file for r in pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "file string").collect()]
