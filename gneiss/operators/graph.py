"""Import graphs: edges (lang, src, dst) between files, from the text of their imports.

Each specifier gives a short list of paths that it may mean; they are joined with the files in one equi-join, and the first that exists wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import paths as P
from .pairs import pairs

JS_EXTS = tuple(f".{e}" for e in "ts tsx js jsx d.ts mjs cjs".split())
_Q = r"""["']([^"']+)["']"""
#: (?d): only \n ends a line; \s without the vertical tab.
_S = r"[\t\n\f\r ]"
JS_PATTERNS = (
    rf"(?dm)^{_S}*(?:import|export){_S}+[^;]*?{_S}from{_S}+{_Q}",
    rf"(?dm)^{_S}*import{_S}+{_Q}",
    rf"(?dm)\brequire{_S}*\({_S}*{_Q}{_S}*\)",
    rf"(?dm)\bimport{_S}*\({_S}*{_Q}{_S}*\)",
)
PHP_PATTERN = rf"(?dim)\b(?:include|require)(?:_once)?{_S}*\(?{_S}*{_Q}{_S}*\)?"
PY_IMPORT = rf"(?dm)^{_S}*import{_S}+([^#\n]+)"
_NAME = r"[A-Za-z_][\w.]*"
PY_FROM = rf"(?dm)^{_S}*from{_S}+({_NAME}|\.+{_NAME}|\.+){_S}+import{_S}+([^#\n]+)"
GO_IMPORT = r'(?dm)^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"'
GO_BLOCK = r"(?ds)(?:^|\n)\s*import\s*\((.*?)\)"


def _sources(files: DataFrame, exts: tuple[str, ...], most: int) -> DataFrame:
    x = files.where(P.ext("path").isin(*exts) & (F.col("size") <= most) & ~P.in_ignored_dir("path", False) & ~P.ignored_file("path", any_case=False))
    return x.select(F.col("path").alias("src"), P.dirname("path").alias("dir"), "content")


def _extract(pattern: str, group: int = 1):
    return F.regexp_extract_all("content", F.lit(pattern), F.lit(group))


def _resolve(specs: DataFrame, files: DataFrame, lang: str) -> DataFrame:
    """specs: src, spec, tries (array of paths in order of preference)."""
    x = specs.select("src", "spec", F.posexplode("tries").alias("place", "dst")).where("dst IS NOT NULL AND dst <> '.' AND NOT startswith(dst, '../')")
    x = x.join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    x = x.groupBy("src", "spec").agg(F.min_by("dst", "place").alias("dst"))
    return x.select(F.lit(lang).alias("lang"), "src", "dst").distinct()


def _join(directory, spec):
    return P.clean(F.concat_ws("/", directory, spec))


def js_specifiers(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    x = _sources(files, P.JS_FAMILY, cfg.js_file_bytes)
    return x.select("src", "dir", F.explode(F.array_distinct(F.concat(*map(_extract, JS_PATTERNS)))).alias("spec")).select("src", "dir", P.trim_space("spec").alias("spec")).where("spec <> ''").distinct()


def js_edges(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    x = js_specifiers(files, cfg).where(F.col("spec").startswith("."))
    x = x.withColumn("to", _join(F.col("dir"), F.col("spec")))
    tries = F.array("to", *(F.concat("to", F.lit(e)) for e in JS_EXTS), *(P.clean(F.concat("to", F.lit(f"/index{e}"))) for e in JS_EXTS))
    return _resolve(x.withColumn("tries", tries), files, "js")


def php_edges(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    x = _sources(files, (".php",), cfg.script_file_bytes).select("src", "dir", F.explode(F.array_distinct(_extract(PHP_PATTERN))).alias("spec"))
    x = x.select("src", "dir", P.trim_space("spec").alias("spec")).where("spec <> '' AND NOT spec RLIKE '[$`]' AND NOT startswith(spec, '/')")
    x = x.withColumn("to", _join(F.col("dir"), F.col("spec")))
    more = F.when(~F.lower("to").endswith(".php"), F.concat("to", F.lit(".php")))
    return _resolve(x.withColumn("tries", F.array("to", more)), files, "php")


def _py_token(c):
    t = F.regexp_replace(P.trim_space(c), r"^[()]+|[()]+$", "")
    return P.trim_space(F.regexp_replace(t, r"(?is) as .*$", ""))


def py_modules(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(src, spec): the dotted modules that a file imports; of `from b import x` both b and b.x."""
    x = _sources(files, (".py",), cfg.script_file_bytes)
    plain = x.select("src", F.explode(_extract(PY_IMPORT)).alias("items")).select("src", F.explode(F.split("items", ",")).alias("t")).select("src", _py_token("t").alias("spec"))
    both = F.arrays_zip(_extract(PY_FROM, 1).alias("base"), _extract(PY_FROM, 2).alias("items"))
    y = x.select("src", "dir", F.explode(both).alias("m")).select("src", "dir", F.col("m.base").alias("base"), F.col("m.items").alias("items"))
    dots = F.length(F.regexp_extract("base", r"^(\.*)", 1))
    parts = F.when(F.col("dir") == ".", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    up = dots - 1
    rest = F.regexp_replace("base", r"^\.+", "")
    lead = F.slice(parts, 1, F.greatest(F.size(parts) - up, F.lit(0)))
    full = F.concat(lead, F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, r"\.")))
    relative = F.when((up <= F.size(parts)) & (F.size(full) > 0), F.array_join(full, "."))
    y = y.withColumn("module", F.when(dots > 0, relative).otherwise(F.col("base"))).where("module IS NOT NULL")
    items = y.select("src", "module", F.explode(F.split("items", ",")).alias("t")).select("src", "module", _py_token("t").alias("t")).where("t NOT IN ('', '*')")
    out = plain.union(y.select("src", F.col("module").alias("spec"))).union(items.select("src", F.concat_ws(".", "module", "t").alias("spec")))
    return out.where("spec <> '' AND NOT startswith(spec, '.')").distinct()


def py_edges(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    to = F.replace(F.col("spec"), F.lit("."), F.lit("/"))
    x = py_modules(files, cfg).withColumn("tries", F.array(P.clean(F.concat(to, F.lit(".py"))), P.clean(F.concat(to, F.lit("/__init__.py")))))
    return _resolve(x, files, "py")


def import_edges(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    return js_edges(files, cfg).unionByName(php_edges(files, cfg)).unionByName(py_edges(files, cfg))


def importers(edges: DataFrame) -> DataFrame:
    """The reverse view."""
    return edges.select("lang", F.col("dst").alias("src"), F.col("src").alias("dst"))


def go_imports(files: DataFrame) -> DataFrame:
    """(src, spec) of Go files, one row an import line. From the text, so a string that looks like an import line counts as one."""
    x = files.where(F.col("path").endswith(".go")).select(F.col("path").alias("src"), "content")
    inner = F.flatten(F.transform(_extract(GO_BLOCK), lambda b: F.regexp_extract_all(b, F.lit(r'(?m)^\s*(?:[\w.]+\s+)?"([^"]+)"'), F.lit(1))))
    return x.select("src", F.explode(F.concat(_extract(GO_IMPORT), inner)).alias("spec"))


def go_module(files: DataFrame) -> DataFrame:
    """One row: the module path of go.mod at the root, '' without one."""
    found = files.where(F.col("path") == "go.mod").select(F.regexp_extract("content", r"(?dm)^\s*module[ ]+(\S+)", 1).alias("m"))
    return found.agg(F.coalesce(F.max("m"), F.lit("")).alias("module"))


def go_package_edges(files: DataFrame) -> DataFrame:
    """(src, dst, n): files of the packages that a file imports from its own module, n for that many import lines."""
    x = go_imports(files).crossJoin(go_module(files)).where("module <> '' AND startswith(spec, module)")
    x = x.withColumn("dir", F.regexp_replace(F.expr("substring(spec, length(module) + 1)"), "^/", "")).where("dir <> ''")
    go = files.where(F.col("path").endswith(".go")).select(F.col("path").alias("dst"), P.dirname("path").alias("dir"))
    # counted before the join: a file is in one directory, so no pair comes twice
    x, go = x.groupBy("src", "dir").agg(F.count("*").alias("_lines")), go.groupBy("dst", "dir").agg(F.count("*").alias("_rows"))
    return pairs(x, go, "dir").select("src", "dst", (F.col("_lines") * F.col("_rows")).alias("n"))


def go_importers(files: DataFrame) -> DataFrame:
    """(target, src): non-test files that import the package of a target file."""
    x = go_imports(files).where("NOT endswith(src, '_test.go')").where(~P.in_ignored_dir("src", False)).distinct().crossJoin(go_module(files)).where("module <> ''")
    d = P.dirname("path")
    go = files.where(F.col("path").endswith(".go")).select(F.col("path").alias("target"), d.alias("dir")).crossJoin(go_module(files))
    go = go.withColumn("spec", F.when(F.col("dir") == ".", F.col("module")).otherwise(F.concat_ws("/", "module", "dir"))).select("target", "spec").distinct()
    # both sides are distinct and a target has one spec, so no pair comes twice
    return pairs(x.select("src", "spec"), go, "spec").where("src <> target").select("target", "src")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href): link targets of raw pages."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"""href=["']([^"']+)["']"""), F.lit(1))).alias("href"))
