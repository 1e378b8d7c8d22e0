"""Operator 5: HTML text extraction with removal of site templates.

Every element's subtree is hashed (tag, attributes, text with white space folded, hashes of the children). Spark counts on how many
pages of its host each subtree occurs; subtrees on many pages are deleted, the text of the rest is extracted.

Many pages: `min_pages`, whatever the size of the host.

Scale: parsing takes time in proportion to the page, however broken it is. Three passes over the pages. The first adds up counts within each batch before the one grouped aggregation on (host, subtree). The number of templates of a host
grows with it, so there is no list a host: the second pass joins the (page, subtree) rows with the templates, and the third joins each page with its own ones, by a hash of host and html. A
table of bits of the templates' hashes, of fixed size, leaves most other rows out before they are shuffled; AQE splits hot subtrees and pages.

Defined results: a null html has null text; an empty one has empty text. Pages whose URL has no host (null, relative, broken) count as one host with the name ''. Rows with equal page_id or url are
pages of their own. Unclosed elements end with their parent; stray end tags are skipped; tags that never end are text; comments, scripts and styles have no text. Elements without text are never
templates. Empty tables give no rows. Columns besides url and html pass through.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_name, materialise


@dataclass(frozen=True)
class TemplateParams:
    min_pages: int = 4


_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript".split())
_SILENT = frozenset("script style noscript template head".split())
_BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tr ul br title td th".split())
#: Start tags that end an open element of the kinds named.
_ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_P_ENDERS = _BLOCK - {"br", "body", "html", "td", "th", "tr", "title", "li", "dd", "dt"}


class _Tags:
    """Tags of a page in one pass. A tag ends at the first > outside quotes; one that never ends is text, as is one with an open quote."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")  # nothing ends beyond
        self.seen = (-1, -1)  # from where a special character was looked for, and where it is
        self.dead: set[int] = set()  # special characters from which no end is reached

    def special(self, at: int) -> int:
        a, b = self.seen
        if not a <= at <= b:
            m = _SPECIAL.search(self.source, at)
            self.seen = (at, b := m.start() if m else len(self.source))
        return b

    def end(self, at: int) -> int:
        """After the > that ends the tag whose name ends at `at`; -1: there is none. No character is passed twice in vain."""
        source, passed = self.source, []
        while at <= self.last:
            k = self.special(at)
            if k in self.dead or k >= len(source):
                break
            if source[k] == ">":
                return k + 1
            passed.append(k)
            close = source.find(source[k], k + 1)
            if close < 0:
                break
            at = close + 1
        self.dead.update(passed)
        return -1

    def __iter__(self):
        """(start, end, 1 for an end tag, name or None, attributes); send() goes on from another place."""
        source, at = self.source, 0
        while m := _OPEN.search(source, at):
            at = m.end()
            if m[2]:
                end = self.end(at) if at <= self.last else -1
            elif source.startswith("<!--", m.start()):
                end = source.find("-->", at)
                end = len(source) if end < 0 else end + 3
            else:
                end = source.find(">", at) + 1 if at <= self.last else -1
            if end < 0:
                continue
            go_on = yield m.start(), end, bool(m[1]), m[2], source[at:end - 1] if m[2] else ""
            at = end
            while go_on is not None:
                at = go_on
                go_on = yield None


def parse(source: str) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, str, bool]]]:
    """(elements: hash, start, end, characters of text), (pieces in order: start, end, tag, /tag or '' for text, silent)."""
    elements, pieces = [], []
    stack: list[list] = []  # tag, start, parts of the hash, characters of text, silent
    opened: Counter = Counter()  # tags of the stack
    at = 0

    def text(a: int, b: int) -> None:
        if a < b:
            silent = bool(stack) and stack[-1][4]
            pieces.append((a, b, "", silent))
            if stack:
                folded = " ".join(source[a:b].split())
                stack[-1][2].append(folded)
                stack[-1][3] += 0 if silent else len(folded)

    def close(end: int) -> None:
        tag, start, parts, chars, _ = stack.pop()
        opened[tag] -= 1
        h = xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))
        elements.append((h - (1 << 63), start, end, chars))
        pieces.append((end, end, f"/{tag}", False))
        if stack:
            stack[-1][2].append(f"\x1e{h:x}")
            stack[-1][3] += chars

    tags = iter(_Tags(source))
    for start, end, ending, tag, rest in tags:
        text(at, start)
        at = end
        if tag is None:
            continue
        tag = tag.lower()
        if ending:
            if opened[tag]:
                while stack[-1][0] != tag:
                    close(start)
                close(end)
            continue
        while stack and (stack[-1][0] in _ENDS.get(tag, ()) or (stack[-1][0] == "p" and tag in _P_ENDERS)):
            close(start)
        attributes = sorted((k.lower(), v.strip("\"'")) for k, v in _ATTRIBUTE.findall(rest))
        silent = tag in _SILENT or bool(stack) and stack[-1][4]
        stack.append([tag, start, [tag, *(f"{k}={v}" for k, v in attributes)], 0, silent])
        opened[tag] += 1
        pieces.append((start, start, tag, silent))
        if tag in _VOID or rest.endswith("/"):
            close(end)
        elif tag in _RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            stop, after = (stop.start(), stop.end()) if stop else (len(source), len(source))
            text(at, stop)
            at = after
            close(after)
            tags.send(after)
    text(at, len(source))
    while stack:
        close(len(source))
    return elements, pieces


def subtrees(source: str) -> set[int]:
    return {h for h, _, _, chars in parse(source)[0] if chars}


def extract(source: str, templates: frozenset) -> tuple[str, int]:
    """(text without the templates, number of subtrees deleted: the outermost)."""
    elements, pieces = parse(source)
    cut = sorted((a, -b) for h, a, b, chars in elements if chars and h in templates)
    spans: list[tuple[int, int]] = []
    for a, b in cut:
        if not spans or a >= spans[-1][1]:
            spans.append((a, -b))
    out, k = [], 0
    for a, b, tag, silent in pieces:
        ends = tag.startswith("/")
        # what begins where a template ends lies outside, as does what ends where it begins
        while k < len(spans) and (spans[k][1] < a if ends else spans[k][1] <= a):
            k += 1
        if k < len(spans) and (spans[k][0] < a if ends else spans[k][0] <= a):
            if a == spans[k][0] and tag in _BLOCK:  # a deleted block still parts the lines around it
                out.append("\n")
            continue
        if tag:
            if tag.removeprefix("/") in _BLOCK:
                out.append("\n")
        elif not silent:
            out.append(" ".join(re.sub(r"\s", " ", _html.unescape(source[a:b])).split(" ")))
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), len(spans)


def host(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def _count(batches):
    for batch in batches:
        seen = Counter()
        for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.update((name, h) for h in subtrees(source or ""))
        a, b = zip(*seen) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(seen.values(), pa.int64())], names=["host", "subtree", "n"])


def templates(pages: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """(host, subtree, n): the subtrees that are deleted, with the number of their pages."""
    bounded_batches(pages.sparkSession)
    counts = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_count, "host string, subtree long, n long")
    return counts.groupBy("host", "subtree").agg(F.sum("n").alias("n")).where(F.col("n") >= params.min_pages)


#: Bits of the table of templates: it fills up with very many, and then leaves fewer rows out.
_BITS = 24


def _bits(batches):
    bits = np.zeros(1 << _BITS, bool)
    for batch in batches:
        bits[batch.column(0).to_numpy() & ((1 << _BITS) - 1)] = True
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bits"])


def _rows(bits):
    def run(batches):
        table = np.unpackbits(np.frombuffer(zlib.decompress(bits.value), np.uint8)).view(bool)
        for batch in batches:
            pages, names, found = [], [], []
            for page, name, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h = np.fromiter(subtrees(source or ""), np.int64)
                h = h[table[h & ((1 << _BITS) - 1)]]
                pages += [page] * len(h)
                names += [name] * len(h)
                found.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(names, pa.string()), pa.array(np.concatenate(found) if found else [], pa.int64())], names=["page", "host", "subtree"])

    return run


def page_key(pages: DataFrame):
    return F.xxhash64(host(F.col("url")), F.col("html"))


def page_templates(pages: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """(page, known): the templates in each page that has any; page is its key."""
    spark = pages.sparkSession
    known = materialise(templates(pages, params), "html-templates")
    table = 0
    for r in known.select("subtree").coalesce(8).mapInArrow(_bits, "bits binary").toLocalIterator():
        table |= int.from_bytes(zlib.decompress(r.bits), "big")
    bits = spark.sparkContext.broadcast(zlib.compress(table.to_bytes((1 << _BITS) // 8, "big"), 1))
    rows = pages.select(page_key(pages).alias("page"), host(F.col("url")).alias("host"), "html").mapInArrow(_rows(bits), "page long, host string, subtree long")
    # one number for host and subtree: fewer bytes a row
    site = F.xxhash64("host", "subtree").alias("site")
    rows = rows.select("page", "subtree", site).join(known.select(site), "site")
    return rows.groupBy("page").agg(F.array_sort(F.collect_set("subtree")).alias("known"))


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())])


@F.arrow_udf(_RESULT)
def _extract(source: pa.Array, known: pa.Array) -> pa.Array:
    sets: dict[tuple, frozenset] = {}
    texts, removed = [], []
    for s, t in zip(source.to_pylist(), known.to_pylist()):
        if s is None:
            texts.append(None), removed.append(None)
            continue
        t = tuple(t or ())
        if t not in sets:
            sets[t] = frozenset(t)
        x, n = extract(s, sets[t])
        texts.append(x), removed.append(n)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["text", "removed"])


def extract_text(pages: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """pages without html, with `text` and `removed`, the number of template subtrees deleted (underscores in front where pages has such columns)."""
    text, removed = (free_name(pages.columns, n) for n in ("text", "removed"))
    key = free_name(pages.columns, "site")
    x = pages.withColumn(key, page_key(pages)).join(page_templates(pages, params).select(F.col("page").alias(key), F.col("known").alias(f"{key}_known")), key, "left")
    x = x.withColumn(f"{key}_x", _extract(F.col("html"), F.col(f"{key}_known")))
    return x.select(*(c for c in pages.columns if c != "html"), F.col(f"{key}_x.text").alias(text), F.col(f"{key}_x.removed").alias(removed))
