"""Path expressions: all built from column functions, so they stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that indexing skips; tools skip the same but for the engine's own.
OWN_DIR = ".gneiss"
IGNORED_DIRS = ("build", "dist", "out", "vendor", "node_modules", ".idea", ".vscode")
#: Extensions of JavaScript and TypeScript modules.
_JS, _TS = ([f".{e}" for e in k.split()] for k in ("cjs js jsx mjs", "cts mts ts tsx"))
JS_FAMILY = tuple(f".{e}" for e in "cjs js jsx mjs ts tsx".split())
_MEDIA = r"\.(?:gif|jpe?g|pdf|png|zip)$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def dirname(path) -> Column:
    """'.' for a file at the root."""
    p = col(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit("."))


def ext(path) -> Column:
    """From the last dot of the base name, in lower case; '' without a dot."""
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]*)$", 1))


def walk_key(path) -> Column:
    """Sorts as a walk does that goes through each directory in the order of names: a/b comes before a.txt."""
    return F.split(col(path), "/")


def language(path) -> Column:
    e = ext(path)
    return F.when(e == ".go", "go").when(e.isin(*JS_FAMILY), "ts/js").when(e == ".php", "php").otherwise("text")


def outline_language(path) -> Column:
    e = ext(path)
    return F.when(e == ".go", "go").when(e.isin(*_JS), "javascript").when(e.isin(*_TS), "typescript").otherwise("")


def clean(path) -> Column:
    """Shortest equal path: without '.', 'x/..' and double slashes; '.' for an empty one."""
    p = col(path)
    rooted = p.startswith("/")

    def step(done: Column, part: Column) -> Column:
        up = F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.concat(done, F.array(F.lit(".."))))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    text = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(text == "", ".").otherwise(text)


def safe(path) -> Column:
    """The cleaned path below the root, null where it leads out of the root or is the root."""
    p = clean(F.regexp_replace(F.trim(col(path)), r"^(?:\./|/)+", ""))
    return F.when((p == ".") | (p == "..") | p.startswith("../"), F.lit(None)).otherwise(p)


def glob_regex(glob: str) -> str | None:
    """Anchored regex: * and ? stay within a segment, classes are kept; None for a bad pattern."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out.append(re.escape(glob[i]))
        elif c == "[":
            j = i + 1
            inner = ""
            if j < len(glob) and glob[j] == "^":
                inner, j = "^/", j + 1
            start = j
            while j < len(glob) and (glob[j] != "]" or j == start):
                if glob[j] == "\\" and j + 1 < len(glob):
                    inner += "\\" + glob[j + 1]
                    j += 2
                else:
                    inner += "\\" + glob[j] if glob[j] in "[&~]^" else glob[j]
                    j += 1
            if j >= len(glob) or j == start:
                return None
            out.append(f"[{inner}]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def matches_any(path, globs) -> Column:
    """A glob matches the whole path or the base name; bad and empty patterns match nothing."""
    hit = F.lit(False)
    for g in globs:
        if g.strip() and (r := glob_regex(g.strip())):
            hit = hit | col(path).rlike(r) | basename(path).rlike(r)
    return hit


def _bad_dir(own: bool, extra=()):
    names = [*IGNORED_DIRS, *extra] + ([OWN_DIR] if own else [])
    return lambda s: s.isin(*names) | s.startswith(".git")


def in_ignored_dir(path, own: bool = True, extra=()) -> Column:
    parts = F.split(col(path), "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), _bad_dir(own, extra))


def ignored_change(path, own: bool = True) -> Column:
    """For change feeds: the rule holds for any segment, the file's name too."""
    return F.exists(F.split(col(path), "/"), _bad_dir(own))


def ignored_file(path, extra=(), any_case: bool = True) -> Column:
    """Media and archives, files named server and those of extra globs; indexing folds case, the tools don't."""
    b = basename(path)
    hit = (b == "") | (b == "server") | b.rlike(("(?i)" if any_case else "") + _MEDIA)
    for g in extra:
        if r := glob_regex(g):
            hit = hit | b.rlike(r)
    return hit


def should_index(path, cfg) -> Column:
    return ~matches_any(path, cfg.deny_globs) & (matches_any(path, cfg.allow_globs) | ext(path).isin(*cfg.preferred_exts))


def short_hash(c) -> Column:
    """128 bits of SHA-256, hex."""
    return F.substring(F.sha2(col(c), 256), 1, 32)


def trim_space(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def normalise_paths(paths) -> Column:
    p = F.transform(F.filter(F.transform(col(paths), trim_space), lambda x: x != ""), clean)
    return F.array_sort(F.array_distinct(F.filter(p, lambda x: x != ".")))


def normalise_tags(tags) -> Column:
    """Trimmed, lower case, without empty ones, each once in the order of first sight."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(col(tags), F.array().cast("array<string>")), lambda t: F.lower(trim_space(t))), lambda t: t != ""))
