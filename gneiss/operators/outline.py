"""Outlines (declarations without bodies) and summaries (a line for each symbol).

Go is read by a line scanner, not a parser: it follows brackets, comments and string literals, and falls back to the generic outline where a
file has no package clause or its brackets don't close. Runs as an Arrow function over whole files; no shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions.batches import slices

_JS = re.compile(r"[ \t\n\f\r]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:(?:class|interface|type|enum|const|let|var)[ \t]+\w|function[ \t]*\*?[ \t]+\w)", re.A)
_GENERIC = re.compile(r"[ \t\n\f\r]*(?:pub[ \t]+)?(?:class|def|enum|fn|func|function|impl|interface|module|object|struct|trait|type)[ \t]+\w", re.A | re.I)


def generic(text: str) -> str:
    """The first three lines that aren't blank, then each line that begins a declaration with its number."""
    lines = text.split("\n")
    head = [x for x in lines if x.strip()][:3]
    return "".join(f"{x}\n" for x in head) + "".join(f"L{i}: {x.strip()}\n" for i, x in enumerate(lines, 1) if _GENERIC.match(x))


def js_outline(text: str) -> str:
    """Declaration lines, each with the doc comment right before it."""
    out: list[str] = []
    doc: list[str] = []
    inside = False
    for line in text.split("\n"):
        t = line.strip()
        if not inside and t.startswith("/**"):
            doc, inside = [line], "*/" not in t
        elif inside:
            doc.append(line)
            inside = "*/" not in t
        elif _JS.match(line):
            out += [*doc, line]
            doc = []
        elif t:
            doc = []
    return "".join(f"{x}\n" for x in out) or generic(text)


def js_summary(text: str) -> str:
    return "".join(f"L{i}: {x.strip()}\n" for i, x in enumerate(text.split("\n"), 1) if _JS.match(x)) or generic(text)


class _Broken(Exception):
    pass


_SKIP = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\'', re.S)


def _masked(text: str) -> str:
    """Comments and literals blanked, so that brackets and key words are real."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " " if m[0][0] == "/" else "_", m[0]), text)


def _close(mask: str, at: int) -> int:
    """Place of the bracket that closes the one at `at`."""
    pair, depth = {"(": ")", "{": "}", "[": "]"}, []
    for i in range(at, len(mask)):
        c = mask[i]
        if c in pair:
            depth.append(pair[c])
        elif c in ")}]":
            if not depth or depth.pop() != c:
                raise _Broken
            if not depth:
                return i
    raise _Broken


_DECL = re.compile(r"^(package|import|func|type|const|var)\b", re.M)
_TOP = re.compile(r"^[ \t]*(\w+(?:[ \t]*,[ \t]*\w+)*)")


def _go(text: str):
    """(kind, start, end, doc) of each top-level declaration."""
    mask = _masked(text)
    if not re.search(r"^package[ \t]+\w+", mask, re.M):
        raise _Broken
    at = 0
    while m := _DECL.search(mask, at):
        start, kind, i = m.start(), m[1], m.end()
        end = None
        while i < len(mask) and end is None:
            c = mask[i]
            if c in "([{":
                i = _close(mask, i) + 1
            elif c in ")]}":
                raise _Broken
            elif c == "\n":
                end = i
            else:
                i += 1
        end = len(mask) if end is None else end
        doc: list[str] = []
        before = text[:start].split("\n")[:-1]
        while before and (b := before[-1].strip()) and (b.startswith("//") or b.endswith("*/")):
            doc.insert(0, before.pop())
            if b.endswith("*/") and "/*" not in b:
                while before and "/*" not in doc[0]:
                    doc.insert(0, before.pop())
        yield kind, start, end, doc, mask
        at = end


def _body(mask: str, start: int, end: int) -> int:
    """Where a function's body begins: the brace at the top level that isn't part of its types."""
    i, found = start, end
    while i < end:
        c = mask[i]
        if c == "{":
            word = re.search(r"(\w*)\s*$", mask[start:i])[1]
            if word not in ("interface", "struct"):
                found = i
                break
            i = _close(mask, i) + 1
        elif c in "([":
            i = _close(mask, i) + 1
        else:
            i += 1
    return found


def _specs(mask: str, text: str, start: int, end: int):
    """(start, end) of the specs of a type, const or var declaration."""
    i = start
    while i < end and mask[i] in " \t":
        i += 1
    if i < end and mask[i] == "(":
        stop = _close(mask, i)
        i += 1
        while i < stop:
            while i < stop and mask[i] in " \t\n;":
                i += 1
            j = i
            while j < stop and mask[j] not in "\n;":
                j = _close(mask, j) + 1 if mask[j] in "([{" else j + 1
            if mask[i:j].strip():
                yield i, j
            i = j
    elif i < end:
        yield i, end


def _fields(mask: str) -> int:
    n = 0
    for a, b in _specs("(" + mask + ")", "", 0, len(mask) + 2):
        line = ("(" + mask + ")")[a:b]
        names = re.match(r"\s*(\w+(?:\s*,\s*\w+)*)\s+[^\s_]", line)
        n += len(names[1].split(",")) if names and not re.match(r"\s*\*?[\w.]+\s*_*\s*$", line) else 1
    return n


def go_outline(text: str) -> str:
    try:
        out = []
        for kind, start, end, doc, mask in _go(text):
            if kind == "package":
                out.append("package " + re.match(r"package[ \t]+(\w+)", mask[start:end])[1])
            elif kind == "func":
                out += [d.strip() for d in doc] + [text[start : _body(mask, start, end)].rstrip()]
            elif kind != "import":
                out += [d.strip() for d in doc]
                for a, b in _specs(mask, text, start + len(kind), end):
                    m = _TOP.match(mask[a:b])
                    if not m:
                        continue
                    if kind == "type":
                        name, rest = re.split(r"[,\s]", m[1])[0], mask[a + m.end() : b]
                        k = re.match(r"(?:\[[^\]]*\])?\s*=?\s*(struct|interface)\s*\{", rest)
                        if not k:
                            out.append("type " + name + " " + text[a + m.end() : b].strip())
                            continue
                        o = a + m.end() + k.end() - 1
                        inner = slice(o + 1, _close(mask, o))
                        if k[1] == "struct":
                            out.append(f"type {name} struct {{ /* {_fields(mask[inner])} fields */ }}")
                        else:
                            methods = [x.strip() for x, y in zip(text[inner].split("\n"), mask[inner].split("\n")) if y.strip()]
                            out += [f"type {name} interface {{", *(f"\t{x}" for x in methods), "}"]
                    else:
                        kind_of = mask[a + m.end() : b].split("=")[0]
                        names = ", ".join(x.strip() for x in m[1].split(","))
                        out.append(f"{kind} {names} {text[a + m.end() : a + m.end() + len(kind_of)].strip()}".rstrip())
        return "".join(f"{x}\n" for x in out)
    except _Broken:
        return generic(text)


def go_summary(text: str) -> str:
    line = lambda i: text.count("\n", 0, i) + 1
    try:
        out = []
        for kind, start, end, _, mask in _go(text):
            if kind == "package":
                out.append("package " + re.match(r"package[ \t]+(\w+)", mask[start:end])[1])
            elif kind == "func":
                m = re.match(r"func\s*(?:\(\s*(?:\w+\s+)?([^)]+?)\s*\)\s*)?(\w+)", mask[start:end])
                if m:
                    out.append(f"L{line(start)}: func " + (f"({m[1]}) " if m[1] else "") + m[2])
            elif kind != "import":
                for a, b in _specs(mask, text, start + len(kind), end):
                    m = _TOP.match(mask[a:b])
                    if m and kind == "type":
                        k = re.match(r"(?:\[[^\]]*\])?\s*=?\s*(struct|interface)\s*\{", mask[a + m.end() : b])
                        out.append(f"L{line(a)}: type {re.split(r'[,\s]', m[1])[0]} {k[1] if k else 'type'}")
                    elif m:
                        out += [f"L{line(a)}: {kind} {x.strip()}" for x in m[1].split(",")]
        return "".join(f"{x}\n" for x in out)
    except _Broken:
        return generic(text)


_OUTLINE = {"go": go_outline, "javascript": js_outline, "typescript": js_outline, "": generic}
_SUMMARY = {"go": go_summary, "javascript": js_summary, "typescript": js_summary, "": generic}


def _each(makers: dict, language: pa.Array, content: pa.Array) -> pa.Array:
    """Of a batch only a slice's texts and outlines are Python strings at a time."""
    parts = [pa.array([None if c is None else makers[k](c) for k, c in zip(*(a.to_pylist() for a in part.columns))], pa.string()) for part in slices(pa.RecordBatch.from_arrays([language, content], names=["k", "c"]))]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def _outline(language: pa.Array, content: pa.Array) -> pa.Array:
    return _each(_OUTLINE, language, content)


@F.arrow_udf(T.StringType())
def _summary(language: pa.Array, content: pa.Array) -> pa.Array:
    return _each(_SUMMARY, language, content)


def outlines(files: DataFrame) -> DataFrame:
    """(path, outline)."""
    return files.select("path", _outline(P.outline_language("path"), F.col("content")).alias("outline"))


def summaries(files: DataFrame) -> DataFrame:
    return files.select("path", _summary(P.outline_language("path"), F.col("content")).alias("outline"))


def generic_declarations(files: DataFrame) -> DataFrame:
    """(path, line, text) of lines that begin a declaration: the relational form of the generic outline."""
    x = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("i", "text"))
    x = x.where(F.col("text").rlike(r"(?i)^[\t\n\f\r ]*(pub[\t\n\f\r ]+)?(class|def|enum|fn|func|function|impl|interface|module|object|struct|trait|type)[\t\n\f\r ]+\w+"))
    return x.select("path", (F.col("i") + 1).alias("line"), P.trim_space("text").alias("text"))
