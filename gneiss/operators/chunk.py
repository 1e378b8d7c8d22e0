"""The chunker: bounded runs of lines.

A chunk takes lines until the next would go beyond `max_bytes` (each line counts one byte more) or `max_lines`. Chunks of white space only are left
out, their lines are used up; a line of 4 x max_bytes or more ends the file. Chunk borders are found by binary search in the
running sum of line lengths: steps for each chunk, not for each line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Config
from ..functions import paths as P
from ..functions.batches import SLICE, slices

#: Unicode white space.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Bytes of a text that are taken into lines at once, at least.
WINDOW = 1 << 18
CHUNKS = "path string, language string, start_line int, end_line int, content string"


def _each(data: bytes | memoryview, max_lines: int, max_bytes: int) -> Iterator[tuple[int, int, str]]:
    """The chunks of a text in UTF-8, one by one. Only a window is copied and its lines held; it has room for any chunk and a line after it, and the next begins behind the last chunk that can't go on."""
    width = max(WINDOW, 8 * max_bytes + 16)
    pos, before, last = 0, 0, False
    while pos < len(data) and not last:
        window = bytes(data[pos : pos + width])
        raw = window.split(b"\n")
        rest, last = raw.pop(), pos + width >= len(data)
        if last and rest:
            raw.append(rest)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        if len(long := np.flatnonzero(size >= 4 * max_bytes)):
            raw, size = raw[: long[0]], size[: long[0]]
        last = last or len(long) > 0 or len(rest) >= 4 * max_bytes
        lines = [x[:-1] if x.endswith(b"\r") else x for x in raw] if b"\r" in window else raw
        ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
        i, n = 0, len(lines)
        while i < n:
            used = ends[i - 1] if i else 0
            j = max(i + 1, min(i + max_lines, int(np.searchsorted(ends, used + max_bytes, "right"))))
            if j == n and not last:
                break
            body = b"\n".join(lines[i:j]).decode("utf-8", "surrogatepass").rstrip("\n")
            if body.strip(SPACE):
                yield before + i + 1, before + j, body + "\n"
            i = j
        before, pos = before + i, pos + int(size[:i].sum()) + i


def chunk_text(text: str, max_lines: int, max_bytes: int) -> list[tuple[int, int, str]]:
    """(first line, last line, content) of each chunk, lines from 1."""
    return list(_each(text.encode("utf-8", "surrogatepass"), max_lines, max_bytes))


def _chunked(most_lines: int, most_bytes: int):
    """Over batches of path, language and text: the chunks, in a batch for each slice, in several for a text that is larger. Texts are read where Arrow has them."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "language", "start_line", "end_line", "content"])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows, held = [], 0
                for p, lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    for c in _each(memoryview(t.as_buffer() or b""), most_lines, most_bytes):
                        if held > SLICE:
                            yield made(rows)
                            rows, held = [], 0
                        rows.append((p, lang, *c))
                        held += len(c[2])
                yield made(rows)

    return run


def chunks(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    """chunks of files (path, content): one pass, no shuffle; a worker holds a batch of files and of its chunks up to a slice's size."""
    return files.select("path", P.language("path").alias("language"), "content").mapInArrow(_chunked(cfg.max_chunk_lines, cfg.max_chunk_bytes), CHUNKS)
