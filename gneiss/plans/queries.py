"""Queries over the driver's tables, and the same in SQL.

Documents stand for files: `files` derives a path with directories and extensions that make every selection rule fire.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import paths as P
from ..operators import chunk, context, graph, notes, outline, related, search, select
from ..streaming import changes
from ..sources.store import Store

_EXTS = [".go", ".ts", ".md", ".txt", ".py", ".json", ".PNG", ".yaml", "", ".php", ".key", ".js", ".db"]
_EXT = "CASE doc_id % 13 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXTS)) + " END"
_DIR = "CASE WHEN doc_id % 17 = 0 THEN 'vendor/' WHEN doc_id % 19 = 0 THEN '.github/workflows/' ELSE '' END || source || '/' || lang || '/'"
_PATH = f"{_DIR} || CASE WHEN doc_id % 23 = 0 THEN 'README' || CAST(doc_id AS VARCHAR(20)) ELSE CAST(doc_id AS VARCHAR(20)) || {_EXT} END"
SMALL = Config(max_chunk_bytes=1024, max_chunk_lines=20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PATH} AS path", "CAST(octet_length(text) AS BIGINT) AS size", "doc_id * 1000 AS mod_time", "text AS content")


FILES = f"files AS (SELECT doc_id, {_PATH} AS path, CAST(strlen(text) AS BIGINT) AS size, doc_id * 1000 AS mod_time, text AS content FROM documents)"
# documents as source files: each imports the one 13 ids before it, which has the same extension, and declares a few things; what a language can't read is in comments
_UP = "repeat('../', length(path) - length(replace(path, '/', '')))"
_N = "CAST(doc_id AS VARCHAR(20))"
_NL = "chr(10)"


def _lines(*parts: str) -> str:
    return " || ".join(f"{x} || {_NL}" for x in parts)


_TS = ("'/** File ' || {n} || '. */'", "'export function f' || {n} || '(a) {{'", "'  return a;'", "'}}'")
_GO = (
    "'// F' || {n} || ' says so.'", "'func F' || {n} || '(a int, b string) (int, error) {{'", "chr(9) || 'return a, nil'", "'}}'", "''", "'// T' || {n} || ' has three.'", "'type T' || {n} || ' struct {{'",
    "chr(9) || 'x, y int'", "chr(9) || 'Name string'", "'}}'", "''", "'type I' || {n} || ' interface {{'", "chr(9) || 'Do(a int) error'", "'}}'", "''", "'const K' || {n} || ' int = 3'", "''",
)
_of = lambda parts: tuple(x.format(n=_N) for x in parts)
_IMPORT = {
    ".ts": f"'import {{ a }} from ' || chr(34) || {_UP} || regexp_replace(dst, '[.]ts$', '') || chr(34) || ';' || {_NL}",
    ".js": f"'const a = require(' || chr(34) || {_UP} || dst || chr(34) || ');' || {_NL}",
    ".php": f"'require ' || chr(34) || {_UP} || dst || chr(34) || ';' || {_NL}",
    ".py": f"'import ' || replace(regexp_replace(dst, '[.]py$', ''), '/', '.') || {_NL}",
    ".go": f"'import ' || chr(34) || 'm/' || regexp_replace(dst, '/[^/]*$', '') || chr(34) || {_NL} || {_NL}",
}
_REST = f"'// ' || replace(text, {_NL}, {_NL} || '// ') || {_NL}"
_HEAD = {".php": f"'<?php' || {_NL}", ".go": f"'package p' || {_NL} || {_NL}"}
_BODY = {
    ".ts": f"{_lines(*_of(_TS))} || {_REST}", ".js": f"{_lines(*_of(_TS))} || {_REST}", ".php": f"'function f' || {_N} || '() {{}}' || {_NL} || text", ".py": f"'def f' || {_N} || '(x): pass' || {_NL} || text",
    ".go": f"{_lines(*_of(_GO))} || {_REST}",
}
_EMPTY = "''"
_CODE = "CASE " + " ".join(f"WHEN path LIKE '%{e}' THEN {_HEAD.get(e, _EMPTY)} || coalesce({_IMPORT[e]}, '') || {_BODY[e]}" for e in _IMPORT) + " ELSE text END"


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PATH} AS path", "text")
    x = x.join(x.selectExpr("doc_id + 13 AS doc_id", "path AS dst"), "doc_id", "left").selectExpr("doc_id", "path", f"{_CODE} AS content")
    mod = spark.range(1).selectExpr("CAST(-1 AS BIGINT) AS doc_id", "'go.mod' AS path", "'module m' || chr(10) AS content")
    return x.unionByName(mod).selectExpr("*", "CAST(octet_length(content) AS BIGINT) AS size", "doc_id AS mod_time")


CODE = f"""{FILES}, nx AS (SELECT f.doc_id, f.path, f.content AS text, p.path AS dst FROM files f LEFT JOIN files p ON p.doc_id = f.doc_id - 13), code AS (SELECT doc_id, path, dst, {_CODE} AS content FROM nx)"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# == selection

_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_SQL_EXT = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
_IN_BAD_DIR = "regexp_matches(path, '(^|/)(build|dist|out|vendor|node_modules|\\.vscode|\\.idea{own}|\\.git[^/]*)/')"
_DENY = f"regexp_matches({_BASE}, '^.*\\.(key|pem|p12|pfx|crt|der|ppk|sqlite|db|bin|exe)$')"
_ALLOW = f"(regexp_matches({_BASE}, '^(README.*|Makefile|Dockerfile|go\\.mod|go\\.sum|Taskfile\\.ya?ml)$') OR regexp_matches(path, '^\\.github/workflows/[^/]*$'))"
_CANDIDATES = f"""cand AS (SELECT * FROM files WHERE size > 0 AND size <= 1048576 AND NOT {_IN_BAD_DIR.format(own='|\\.gneiss')}
 AND NOT regexp_matches({_BASE}, '(?i)\\.(png|jpg|jpeg|gif|zip|pdf)$') AND {_BASE} NOT IN ('', 'server')
 AND NOT {_DENY} AND ({_ALLOW} OR {_SQL_EXT} IN ('.yml', '.yaml', '.json', '.md', '.php', '.jsx', '.js', '.tsx', '.ts', '.go')))"""
_PRIORITY = f"coalesce(list_position(string_split('.go .ts .tsx .js .jsx .php .md .json .yaml .yml', ' '), {_SQL_EXT}) - 1, 0)"
_LISTED = f"""NOT {_IN_BAD_DIR.format(own='')} AND NOT regexp_matches({_BASE}, '\\.(png|jpg|jpeg|gif|zip|pdf)$') AND {_BASE} NOT IN ('', 'server')"""


@query(f"WITH {FILES}, {_CANDIDATES} SELECT path, size, CAST({_PRIORITY} AS INT) AS priority FROM cand")
def select_candidates(spark, sf_dir):
    return select.candidates(files(spark, sf_dir)).select("path", "size", select.priority("path").alias("priority"))


@query(f"WITH {FILES} SELECT path FROM files WHERE {_LISTED} ORDER BY string_split(path, '/') LIMIT 2000")
def list_files(spark, sf_dir):
    return select.listing(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM files WHERE {_LISTED} ORDER BY string_split(path, '/') LIMIT 100")
def list_files_first(spark, sf_dir):
    """The first of the walk, in its order."""
    from pyspark.sql import Window

    return select.listing(files(spark, sf_dir), most=100).withColumn("place", F.row_number().over(Window.orderBy(P.walk_key("path"))).cast("long"))


@query(f"WITH {FILES} SELECT path FROM files WHERE {_LISTED} AND regexp_matches(path, '^src1[0-4]/[^/]*/[^/]*1[^/]\\.md$') ORDER BY string_split(path, '/') LIMIT 2000")
def list_files_glob(spark, sf_dir):
    return select.listing(files(spark, sf_dir), "src1[0-4]/*/*1?.md")


@query(f"""WITH RECURSIVE {FILES}, {_CANDIDATES},
o AS (SELECT path, size, split_part(path, '/', 1) AS source, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY {_PRIORITY}, size, path) AS place FROM cand),
f AS (SELECT source, path, size, place, size <= 30000 AS fits, CASE WHEN size <= 30000 THEN size ELSE 0 END AS used FROM o WHERE place = 1
 UNION ALL SELECT o.source, o.path, o.size, o.place, f.used + o.size <= 30000, CASE WHEN f.used + o.size <= 30000 THEN f.used + o.size ELSE f.used END FROM f JOIN o ON o.source = f.source AND o.place = f.place + 1)
SELECT source, path, size, fits FROM f""")
def first_fit_budget(spark, sf_dir):
    x = select.candidates(files(spark, sf_dir)).select("path", "size", F.split_part("path", F.lit("/"), F.lit(1)).alias("source"))
    return select.first_fit_by_class(x, 30_000, "size", select.priority("path"), ["path"], ["source"]).select("source", "path", "size", "fits")


@query(f"""WITH RECURSIVE {FILES},
o AS (SELECT path, size, split_part(path, '/', 1) AS source, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path) AS place FROM files),
f AS (SELECT source, path, size, place, size <= 30000 AS fits, CASE WHEN size <= 30000 THEN size ELSE 0 END AS used FROM o WHERE place = 1
 UNION ALL SELECT o.source, o.path, o.size, o.place, f.used + o.size <= 30000, CASE WHEN f.used + o.size <= 30000 THEN f.used + o.size ELSE f.used END FROM f JOIN o ON o.source = f.source AND o.place = f.place + 1)
SELECT source, path, size, fits FROM f""")
def first_fit_by_path(spark, sf_dir):
    x = files(spark, sf_dir).select("path", "size", F.split_part("path", F.lit("/"), F.lit(1)).alias("source"))
    return select.first_fit(x, 30_000, "size", ["path"], ["source"]).select("source", "path", "size", "fits")


@query(f"""WITH {FILES}, r AS (SELECT split_part(path, '/', 1) AS source, path, size, sum(size) OVER (PARTITION BY split_part(path, '/', 1) ORDER BY size DESC, path ROWS UNBOUNDED PRECEDING) AS total FROM files)
SELECT source, path, CAST(total AS BIGINT) AS total, total <= 60000 AS fits FROM r""")
def prefix_budget(spark, sf_dir):
    x = files(spark, sf_dir).select("path", "size", F.split_part("path", F.lit("/"), F.lit(1)).alias("source"))
    return select.prefix_budget(x, 60_000, "size", [F.desc("size"), "path"], ["source"]).select("source", "path", "total", "fits")


def _indexed(x: DataFrame) -> DataFrame:
    """An older state of the files: some missing, some of another size, some that are gone since."""
    return x.where("NOT contains(path, '/es/')").selectExpr("CASE WHEN endswith(path, '.md') THEN path || '.old' ELSE path END AS path", "CASE WHEN contains(path, '/fr/') THEN size + 1 ELSE size END AS size", "mod_time")


_INDEXED = "idx AS (SELECT CASE WHEN suffix(path, '.md') THEN path || '.old' ELSE path END AS path, CASE WHEN contains(path, '/fr/') THEN size + 1 ELSE size END AS size, mod_time FROM files WHERE NOT contains(path, '/es/'))"


@query(f"WITH {FILES}, {_INDEXED} SELECT f.path, f.size FROM files f LEFT JOIN idx USING (path) WHERE idx.size IS DISTINCT FROM f.size OR idx.mod_time IS DISTINCT FROM f.mod_time")
def manifest_changed(spark, sf_dir):
    x = files(spark, sf_dir)
    return select.changed(x.select("path", "size", "mod_time"), _indexed(x)).select("path", "size")


@query(f"WITH {FILES}, {_INDEXED} SELECT path FROM idx WHERE path NOT IN (SELECT path FROM files)")
def manifest_deleted(spark, sf_dir):
    x = files(spark, sf_dir)
    return select.deleted(_indexed(x), x).select("path")


@query(f"WITH {FILES}, {_CANDIDATES} SELECT count(*) > 0 AS ready, count(*) AS files_indexed, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_indexed FROM cand")
def index_status(spark, sf_dir):
    return select.status(select.candidates(files(spark, sf_dir)))


@query(f"""WITH {FILES} SELECT path, {_SQL_EXT} AS ext, {_BASE} AS base, regexp_replace(path, '/[^/]*$', '') AS dir, substr(sha256(path), 1, 32) AS id,
CASE WHEN {_SQL_EXT} = '.go' THEN 'go' WHEN {_SQL_EXT} IN ('.ts', '.js') THEN 'ts/js' WHEN {_SQL_EXT} = '.php' THEN 'php' ELSE 'text' END AS language,
CASE WHEN {_SQL_EXT} = '.go' THEN 'go' WHEN {_SQL_EXT} = '.js' THEN 'javascript' WHEN {_SQL_EXT} = '.ts' THEN 'typescript' ELSE '' END AS outline_language,
path AS clean, path AS safe, CAST(NULL AS VARCHAR) AS outside FROM files""")
def path_parts(spark, sf_dir):
    dirty = F.concat(F.lit("./x/../"), F.regexp_replace("path", "/", "/.//"))
    return files(spark, sf_dir).select(
        "path", P.ext("path").alias("ext"), P.basename("path").alias("base"), P.dirname("path").alias("dir"), P.short_hash("path").alias("id"), P.language("path").alias("language"),
        P.outline_language("path").alias("outline_language"), P.clean(dirty).alias("clean"), P.safe(F.concat(F.lit("/"), dirty)).alias("safe"),
        P.safe(F.concat(F.lit("a/../../"), F.col("path"))).alias("outside"),
    )


_GLOBS = {"star": ("src1*/en/*", "^src1[^/]*/en/[^/]*$"), "name": ("*.md", "^[^/]*\\.md$"), "question": ("1?.go", "^1[^/]\\.go$"), "class": ("[0-4]*.ts", "^[0-4][^/]*\\.ts$"), "not_class": ("[^0-8]*", "^[^0-8/][^/]*$")}


@query(f"WITH {FILES} SELECT path, " + ", ".join(f"regexp_matches(path, '{r}') OR regexp_matches({_BASE}, '{r}') AS g_{k}" for k, (_, r) in _GLOBS.items()) + ", false AS g_bad FROM files")
def glob_matches(spark, sf_dir):
    return files(spark, sf_dir).select("path", *(P.matches_any("path", [g]).alias(f"g_{k}") for k, (g, _) in _GLOBS.items()), P.matches_any("path", ["[a"]).alias("g_bad"))


# == chunks and search


def _chunk_sql(lines: int, size: int) -> str:
    return f"""{FILES},
ln AS MATERIALIZED (SELECT path, i, l, strlen(l) + 1 AS b FROM (SELECT path, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i, len(string_split(content, chr(10))) AS n FROM files)
  WHERE NOT (i = n AND l = '')),
ok AS MATERIALIZED (SELECT * FROM ln WHERE i < coalesce((SELECT min(x.i) FROM ln x WHERE x.path = ln.path AND x.b > {4 * size}), 1000000000)),
st AS (SELECT path, i, b, 1 AS start, 1 AS k, b AS used FROM ok WHERE i = 1
  UNION ALL SELECT o.path, o.i, o.b, CASE WHEN s.used + o.b > {size} OR s.k >= {lines} THEN o.i ELSE s.start END, CASE WHEN s.used + o.b > {size} OR s.k >= {lines} THEN 1 ELSE s.k + 1 END,
  CASE WHEN s.used + o.b > {size} OR s.k >= {lines} THEN o.b ELSE s.used + o.b END FROM st s JOIN ok o ON o.path = s.path AND o.i = s.i + 1),
chunks AS MATERIALIZED (SELECT st.path, CASE WHEN {_SQL_EXT.replace('path', 'st.path')} = '.go' THEN 'go' WHEN {_SQL_EXT.replace('path', 'st.path')} IN ('.ts', '.js') THEN 'ts/js' WHEN {_SQL_EXT.replace('path', 'st.path')} = '.php' THEN 'php' ELSE 'text' END AS language,
  CAST(start AS INT) AS start_line, CAST(max(st.i) AS INT) AS end_line, rtrim(string_agg(l, chr(10) ORDER BY st.i), chr(10)) || chr(10) AS content FROM st JOIN ln ON ln.path = st.path AND ln.i = st.i GROUP BY st.path, start
  HAVING regexp_matches(string_agg(l, ''), '\\S'))"""


@query(f"WITH RECURSIVE {_chunk_sql(200, 8192)} SELECT * FROM chunks")
def chunk_default(spark, sf_dir):
    return chunk.chunks(files(spark, sf_dir))


@query(f"WITH RECURSIVE {_chunk_sql(20, 1024)} SELECT path, start_line, end_line, md5(content) AS content_md5 FROM chunks")
def chunk_small(spark, sf_dir):
    return chunk.chunks(files(spark, sf_dir), SMALL).select("path", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query(f"""WITH RECURSIVE {_chunk_sql(20, 1024)} SELECT path, start_line, end_line, CAST(10 + (length(lower(content)) - length(replace(lower(content), 'src1', ''))) // 4 + CASE WHEN contains(lower(path), 'src1') THEN 5 ELSE 0 END AS INT) AS score
FROM chunks WHERE contains(lower(content), 'src1') ORDER BY score DESC, path, start_line LIMIT 20""".replace("'src1'", "'the'").replace("// 4", "// 3"))
def chunk_search(spark, sf_dir):
    return search.search_chunks(chunk.chunks(files(spark, sf_dir), SMALL), " The ").select("path", "start_line", "end_line", "score")


@query(f"""WITH RECURSIVE {_chunk_sql(20, 1024)} SELECT path, start_line, CAST(10 + (length(lower(content)) - length(replace(lower(content), 'inth', ''))) // 4 AS INT) AS score
FROM chunks WHERE contains(lower(content), 'inth') AND path IN (SELECT path FROM files JOIN labels USING (doc_id) WHERE quality = 1)""")
def chunk_search_restricted(spark, sf_dir):
    x = files(spark, sf_dir)
    good = x.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")
    return search.search_chunks(chunk.chunks(x, SMALL), "inth", 0, good).select("path", "start_line", "score")


@query(f"WITH RECURSIVE {_chunk_sql(200, 8192)} SELECT f.path, substr(sha256(f.path), 1, 32) AS id, f.size, f.mod_time, substr(sha256(f.content), 1, 32) AS hash, CASE WHEN {_SQL_EXT.replace('path', 'f.path')} = '.go' THEN 'go' WHEN {_SQL_EXT.replace('path', 'f.path')} IN ('.ts', '.js') THEN 'ts/js' WHEN {_SQL_EXT.replace('path', 'f.path')} = '.php' THEN 'php' ELSE 'text' END AS language, CAST(count(c.path) AS INT) AS chunks FROM files f LEFT JOIN chunks c ON c.path = f.path GROUP BY ALL")
def files_index(spark, sf_dir):
    x = files(spark, sf_dir)
    return select.index_rows(x, chunk.chunks(x))


_HITS = f"""{FILES}, ln AS (SELECT path, i, l FROM (SELECT path, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i, len(string_split(content, chr(10))) AS n FROM files
  WHERE {_LISTED}) WHERE NOT (i = n AND l = '')),
h AS (SELECT *, contains({{fold}}, '{{q}}') AS hit FROM ln),
g AS (SELECT *, coalesce(sum(hit::INT) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM h),
s AS (SELECT path, i, hit, l, list(l) OVER (PARTITION BY path, grp ORDER BY i ROWS BETWEEN {{n}} PRECEDING AND CURRENT ROW) AS ls FROM g)"""


@query("WITH " + _HITS.format(fold="lower(l)", q="inth", n=2) + " SELECT path, CAST(i AS INT) AS line, array_to_string(ls, chr(10)) AS snippet FROM s WHERE hit")
def search_with_context(spark, sf_dir):
    return search.search_lines(files(spark, sf_dir), "InTh", 0, context=2)


@query("WITH " + _HITS.format(fold="l", q="an", n=0) + " SELECT path, CAST(i AS INT) AS line, l AS snippet FROM s WHERE hit ORDER BY string_split(path, '/'), i LIMIT 50")
def search_case_sensitive(spark, sf_dir):
    return search.search_lines(files(spark, sf_dir), "an", case_sensitive=True)


@query(f"""WITH {FILES}, ln AS (SELECT unnest(string_split(content, chr(10))) AS text, CAST(unnest(range(1, len(string_split(content, chr(10))) + 1)) AS INT) AS line FROM files WHERE doc_id = 14),
w AS (SELECT *, sum(strlen(text) + 1) OVER (ORDER BY line) AS total FROM ln WHERE line >= 2) SELECT line, text FROM w WHERE total <= 5000""")
def read_file(spark, sf_dir):
    x = files(spark, sf_dir)
    path = x.where("doc_id = 14").select("path").first()[0]
    return search.read_lines(x, path, 2, 0, 5000)


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'an', ''))) // 2 AS INT) AS n FROM documents")
def occurrence_counts(spark, sf_dir):
    from ..functions.text import occurrences

    return table(spark, sf_dir, "documents").select("doc_id", occurrences("text", "an").alias("n"))


# == graphs and relations


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=[\"'']([^\"'']+)[\"'']', 1)) AS href FROM pages")
def page_links(spark, sf_dir):
    return graph.links(table(spark, sf_dir, "pages"))


_SRC = f"NOT {_IN_BAD_DIR.format(own='')}"
_EDGES = f"""e AS (SELECT CASE WHEN path LIKE '%.php' THEN 'php' WHEN path LIKE '%.py' THEN 'py' ELSE 'js' END AS lang, path AS src, dst FROM code WHERE {_SRC} AND dst IS NOT NULL AND strlen(content) <= 400000
  AND (path LIKE '%.ts' OR path LIKE '%.js' OR path LIKE '%.php' OR (path LIKE '%.py' AND dst LIKE '%.py' AND dst NOT LIKE '.%')))"""


@query(f"WITH {CODE}, {_EDGES} SELECT * FROM e WHERE lang = 'js'")
def js_edges(spark, sf_dir):
    return graph.js_edges(code(spark, sf_dir))


@query(f"WITH {CODE}, {_EDGES} SELECT * FROM e WHERE lang = 'php'")
def php_edges(spark, sf_dir):
    return graph.php_edges(code(spark, sf_dir))


@query(f"WITH {CODE}, {_EDGES} SELECT * FROM e WHERE lang = 'py'")
def py_edges(spark, sf_dir):
    return graph.py_edges(code(spark, sf_dir))


_GO_DIRS = "g AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_replace(dst, '/[^/]*$', '') AS imported FROM code WHERE path LIKE '%.go')"


@query(f"WITH {CODE}, {_GO_DIRS} SELECT a.path AS src, b.path AS dst, count(*) AS n FROM g a JOIN g b ON b.dir = a.imported GROUP BY ALL")
def go_package_edges(spark, sf_dir):
    return graph.go_package_edges(code(spark, sf_dir))


@query(f"WITH {CODE}, {_GO_DIRS} SELECT DISTINCT a.path AS target, b.path AS src FROM g a JOIN g b ON b.imported = a.dir WHERE a.path <> b.path AND NOT {_IN_BAD_DIR.format(own='').replace('path', 'b.path')}")
def go_importers(spark, sf_dir):
    return graph.go_importers(code(spark, sf_dir))


@query(f"""WITH {CODE}, {_EDGES}, d AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM code),
t AS (SELECT * FROM d WHERE path LIKE '%.ts' OR path LIKE '%.js' OR path LIKE '%.php' OR path LIKE '%.py'),
c AS (SELECT t.path AS target, e.dst AS path, 9 AS w, CASE WHEN lang = 'php' THEN 'includes' ELSE 'imports' END AS reason FROM t JOIN e ON e.src = t.path
 UNION ALL SELECT t.path, e.src, 10, CASE WHEN lang = 'php' THEN 'included_by' ELSE 'imported_by' END FROM t JOIN e ON e.dst = t.path
   AND CASE lang WHEN 'php' THEN t.path LIKE '%.php' WHEN 'py' THEN t.path LIKE '%.py' ELSE t.path LIKE '%.ts' OR t.path LIKE '%.js' END
 UNION ALL SELECT t.path, d.path, 5, 'same_dir' FROM t JOIN d USING (dir) WHERE d.path <> t.path AND NOT regexp_matches(d.path, '\\.(png|jpg|jpeg|gif|zip|pdf)$')),
s AS (SELECT target, path, sum(w) AS score, list_sort(list(DISTINCT reason)) AS reasons FROM c GROUP BY ALL)
SELECT target, path, CAST(score AS BIGINT) AS score, reasons FROM s QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, path) <= 20""")
def related_files(spark, sf_dir):
    """The best related files of every JS, TypeScript, PHP and Python file."""
    x = code(spark, sf_dir)
    targets = x.where(P.ext("path").isin(".ts", ".js", ".php", ".py")).select(F.col("path").alias("target"))
    return related.related(x, targets, related.RelatedOptions(20)).select("target", "path", "score", "reasons")


@query("""WITH u AS (SELECT CAST(l_orderkey AS VARCHAR) AS package, CAST(l_suppkey AS VARCHAR) AS file, CAST(l_partkey AS VARCHAR) AS def_file, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
t AS (SELECT DISTINCT def_file AS target FROM u), per AS (SELECT package, def_file, sum(n) AS n FROM u GROUP BY ALL), f AS (SELECT DISTINCT package, file FROM u)
SELECT target, file AS path, CAST(sum(12 + least(3, n)) AS BIGINT) AS w, 'go_types_refs_target' AS reason FROM per JOIN t ON def_file = target JOIN f USING (package) WHERE file <> target GROUP BY target, file
UNION ALL SELECT target, def_file, CAST(sum(7 + least(5, n)) AS BIGINT), 'go_types_used_by_target' FROM f JOIN t ON file = target JOIN per USING (package) WHERE def_file <> target GROUP BY target, def_file""")
def go_symbol_uses(spark, sf_dir):
    """Orders as packages, suppliers as their files, parts as the files that define what is used."""
    u = table(spark, sf_dir, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS package", "CAST(l_suppkey AS STRING) AS file", "CAST(l_partkey AS STRING) AS def_file", "CAST(l_quantity AS BIGINT) AS n")
    return related.go_uses(u.select(F.col("def_file").alias("target")).distinct(), u)


@query("""WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst, 9 AS w, 'imports' AS reason FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, 10, 'imported_by' FROM lineitem),
s AS (SELECT src AS target, dst AS path, sum(w) AS score, list_sort(list(DISTINCT reason)) AS reasons FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, path) AS rank FROM s)
SELECT target, path, CAST(score AS BIGINT) AS score, reasons, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def related_at_scale(spark, sf_dir):
    """Scores over the line items as edges."""
    x = table(spark, sf_dir, "lineitem")
    rows = lambda c, w, reason: x.select(F.col("l_orderkey").alias("target"), F.col(c).alias("path"), F.lit(w).cast("long").alias("w"), F.lit(reason).alias("reason"))
    return related.top(related.scores(rows("l_partkey", 9, "imports").unionByName(rows("l_suppkey", 10, "imported_by"))), 5)


@query(f"""WITH {FILES}, d AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM files)
SELECT a.path AS target, b.path, CAST(5 AS BIGINT) AS w, 'same_dir' AS reason FROM d a JOIN d b USING (dir) WHERE a.path <> b.path AND NOT regexp_matches(b.path, '\\.(png|jpg|jpeg|gif|zip|pdf)$')""")
def same_directory(spark, sf_dir):
    x = files(spark, sf_dir).select("path")
    return related.same_dir(x, x.select(F.col("path").alias("target")))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def mentions(spark, sf_dir):
    hay = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("hay"))
    needle = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("needle"))
    return related.find_all(hay, "doc_id", "hay", needle, "needle").join(needle, "needle").select("doc_id", "item_id")


@query("WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem) SELECT dst AS node, count(*) AS importers FROM e GROUP BY dst")
def importer_counts(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.lit("x").alias("lang"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return graph.importers(e).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("importers"))


# == outlines and context

_DECL_SQL = "(?i)^\\s*(pub\\s+)?(class|def|enum|fn|func|function|impl|interface|module|object|struct|trait|type)\\s+\\w+"


@query(f"""WITH {CODE}, ln AS (SELECT path, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM code)
SELECT path, CAST(i AS INT) AS line, trim(l) AS text FROM ln WHERE regexp_matches(l, '{_DECL_SQL}')""")
def declarations(spark, sf_dir):
    return outline.generic_declarations(code(spark, sf_dir).where("doc_id >= 0"))


@query(f"""WITH {FILES}, ln AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files),
h AS (SELECT doc_id, string_agg(l || chr(10), '' ORDER BY i) AS head FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM ln WHERE regexp_matches(l, '\\S')) WHERE r <= 3 GROUP BY doc_id),
d AS (SELECT doc_id, string_agg('L' || i || ': ' || trim(l) || chr(10), '' ORDER BY i) AS decl FROM ln WHERE regexp_matches(l, '{_DECL_SQL}') GROUP BY doc_id)
SELECT doc_id, coalesce(head, '') || coalesce(decl, '') AS outline FROM files LEFT JOIN h USING (doc_id) LEFT JOIN d USING (doc_id)""")
def generic_outlines(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return outline.outlines(x.withColumn("path", F.concat(F.col("path").cast("string"), F.lit(".txt")))).select(F.regexp_replace("path", r"\.txt$", "").cast("long").alias("doc_id"), "outline")


_TS_DECL = f"'export function f' || {_N} || '(a) {{' || {_NL}"
_REQUIRE = f"CASE WHEN path LIKE '%.js' AND dst IS NOT NULL THEN {_IMPORT['.js']} ELSE '' END"
_TS_LINE = "CASE WHEN dst IS NULL THEN '2' ELSE '3' END"
_GO_OUT = (
    "'package p'", "'// F' || {n} || ' says so.'", "'func F' || {n} || '(a int, b string) (int, error)'", "'// T' || {n} || ' has three.'", "'type T' || {n} || ' struct {{ /* 3 fields */ }}'",
    "'type I' || {n} || ' interface {{'", "chr(9) || 'Do(a int) error'", "'}}'", "'const K' || {n} || ' int'",
)
_go_line = lambda k: f"'L' || CASE WHEN dst IS NULL THEN '{k}' ELSE '{k + 2}' END || ': "
_GO_SUM = ("'package p'", f"{_go_line(4)}func F' || {_N}", f"{_go_line(9)}type T' || {_N} || ' struct'", f"{_go_line(14)}type I' || {_N} || ' interface'", f"{_go_line(18)}const K' || {_N}")
_IS_CODE = "(path LIKE '%.go' OR path LIKE '%.ts' OR path LIKE '%.js')"


@query(f"""WITH {CODE} SELECT path, CASE WHEN path LIKE '%.go' THEN {_lines(*_of(_GO_OUT))} ELSE {_REQUIRE} || '/** File ' || {_N} || '. */' || {_NL} || {_TS_DECL} END AS outline FROM code WHERE {_IS_CODE}""")
def code_outlines(spark, sf_dir):
    return outline.outlines(code(spark, sf_dir).where(P.ext("path").isin(".go", ".ts", ".js")))


@query(f"""WITH {CODE} SELECT path, CASE WHEN path LIKE '%.go' THEN {_lines(*_GO_SUM)} ELSE CASE WHEN {_REQUIRE} = '' THEN '' ELSE 'L1: ' || {_REQUIRE} END || 'L' || {_TS_LINE} || ': ' || {_TS_DECL} END AS outline FROM code WHERE {_IS_CODE}""")
def code_summaries(spark, sf_dir):
    return outline.summaries(code(spark, sf_dir).where(P.ext("path").isin(".go", ".ts", ".js")))


_SCORED = """sc AS (SELECT *, CAST(CASE WHEN contains(lower(content), 'inth') THEN 10 + (length(lower(content)) - length(replace(lower(content), 'inth', ''))) // 4 ELSE 0 END + CASE WHEN start_line <= 5 THEN 1 ELSE 0 END AS INT) AS score FROM chunks),
best AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, start_line) AS place FROM sc QUALIFY place <= 2)"""


@query(f"WITH RECURSIVE {_chunk_sql(20, 1024)}, {_SCORED} SELECT path, start_line, end_line, score, CAST(place AS INT) AS place FROM best")
def best_chunks(spark, sf_dir):
    return context.best_chunks(chunk.chunks(files(spark, sf_dir), SMALL), context.ContextOptions(focus="inth")).select("path", "start_line", "end_line", "score", "place")


_CONTEXT = f"""d AS (SELECT path, doc_id, regexp_replace(path, '/[^/]*$', '') AS dir FROM files),
rel AS (SELECT a.path AS target, b.path, row_number() OVER (PARTITION BY a.path ORDER BY b.path) AS rank FROM d a JOIN d b USING (dir) WHERE a.path <> b.path AND NOT regexp_matches(b.path, '\\.(png|jpg|jpeg|gif|zip|pdf)$') QUALIFY rank <= 30),
allp AS (SELECT target, path, rank FROM rel UNION ALL SELECT path, path, 0 FROM d),
pl AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY rank) AS file_place FROM allp WHERE path NOT IN (SELECT path FROM files JOIN labels USING (doc_id) WHERE toxic = 1) QUALIFY file_place <= 10)"""


def _context_inputs(spark, sf_dir):
    x = files(spark, sf_dir)
    targets = x.select(F.col("path").alias("target"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    near = related.top(related.scores(related.same_dir(x.select("path"), targets, 30)), 30)
    return x, context.file_list(targets, near, exclude=x.join(toxic, "doc_id", "left_semi"))


@query(f"""WITH RECURSIVE {_chunk_sql(20, 1024)}, {_SCORED}, {_CONTEXT},
rk AS (SELECT pl.target, pl.path, pl.file_place, start_line, end_line, content, score * CASE WHEN pl.path = target THEN 2 ELSE 1 END + CASE WHEN pl.path = target THEN 0 ELSE 2 END AS rank FROM best JOIN pl USING (path)),
tt AS (SELECT *, sum(strlen(content)) OVER (PARTITION BY target ORDER BY rank DESC, path, start_line ROWS UNBOUNDED PRECEDING) AS total FROM rk)
SELECT target, path, CAST(file_place AS INT) AS file_place, start_line, end_line, md5(content) AS content_md5, CAST(rank AS INT) AS rank, CAST(total AS BIGINT) AS total, total <= 6000 AS fits FROM tt""")
def context_full(spark, sf_dir):
    x, paths = _context_inputs(spark, sf_dir)
    out = context.full(paths, chunk.chunks(x, SMALL), context.ContextOptions(focus="inth", max_bytes=6000))
    return out.select("target", "path", "file_place", "start_line", "end_line", F.md5("content").alias("content_md5"), "rank", "total", "fits")


@query(f"""WITH RECURSIVE {_chunk_sql(20, 1024)}, {_SCORED}, {_CONTEXT}, own AS (SELECT path AS target, sum(strlen(content)) AS b FROM best GROUP BY path),
al AS (SELECT path, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files),
hd AS (SELECT path, string_agg(l || chr(10), '' ORDER BY i) AS head FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i) AS r FROM al WHERE regexp_matches(l, '\\S')) WHERE r <= 3 GROUP BY path),
dc AS (SELECT path, string_agg('L' || i || ': ' || trim(l) || chr(10), '' ORDER BY i) AS decl FROM al WHERE regexp_matches(l, '{_DECL_SQL}') GROUP BY path),
ol AS (SELECT path, coalesce(head, '') || coalesce(decl, '') AS outline FROM files LEFT JOIN hd USING (path) LEFT JOIN dc USING (path)),
tt AS (SELECT pl.target, pl.path, file_place, outline, sum(strlen(outline)) OVER (PARTITION BY pl.target ORDER BY file_place) + coalesce(own.b, 0) AS total FROM pl JOIN ol USING (path) LEFT JOIN own ON own.target = pl.target AND pl.target IN (SELECT path FROM pl WHERE path = target) WHERE pl.target <> pl.path AND outline <> '')
SELECT target, path, CAST(file_place AS INT) AS file_place, md5(outline) AS outline_md5, CAST(total AS BIGINT) AS total, total <= 4000 AS fits FROM tt""")
def context_auto(spark, sf_dir):
    """Packs in auto mode: outlines of the related files within what the targets' own chunks leave of 4000 bytes."""
    x, paths = _context_inputs(spark, sf_dir)
    _, rest = context.auto(paths, x, chunk.chunks(x, SMALL), context.ContextOptions(focus="inth", max_bytes=4000))
    return rest.select("target", "path", "file_place", F.md5("outline").alias("outline_md5"), "total", "fits")


# == notes


def _writes(spark, sf_dir):
    x = table(spark, sf_dir, "conversations")
    return x.select(
        F.expr("CAST(conv_id AS BIGINT) * 1000000 + turn").alias("seq"), F.col("conv_id").cast("string").alias("key"), "text", F.array(F.concat(F.lit(" "), F.upper("role")), "role", F.lit("")).alias("tags"), F.lit("./docs/../n.md").alias("path")
    )


_NOTES = """w AS (SELECT CAST(conv_id AS BIGINT) * 1000000 + turn AS seq, CAST(conv_id AS VARCHAR) AS key, text, role FROM conversations),
notes AS (SELECT key, min(seq) AS pos, arg_max(text, seq) AS text, [lower(arg_max(role, seq))] AS tags, 'n.md' AS path FROM w WHERE regexp_matches(text, '\\S') GROUP BY key)"""


@query(f"WITH {_NOTES} SELECT * FROM notes")
def notes_upsert(spark, sf_dir):
    return notes.upsert(_writes(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_NOTES} SELECT key, pos FROM notes WHERE list_contains(tags, 'user') AND (contains(lower(text), 'an') OR contains(key, 'an')) ORDER BY pos LIMIT 20")
def notes_search(spark, sf_dir):
    return notes.search(notes.upsert(_writes(spark, sf_dir)), " An ", ["USER "]).select("key", F.col("pos").cast("long").alias("pos"))


# == sets and hashes


@query("SELECT substr(sha256(text), 1, 32) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def exact_copies(spark, sf_dir):
    x = table(spark, sf_dir, "documents").groupBy(P.short_hash("text").alias("hash"))
    return x.agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def restrict_and_exclude(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels.where("quality = 1"), "doc_id", "left_semi").join(labels.where("toxic = 1"), "doc_id", "left_anti")


@query("SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE value > 1e9 INTERSECT SELECT user_id FROM events")
def set_operations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ids = lambda cond: e.where(cond).select("user_id")
    return ids("event_type = 'click'").union(ids("event_type = 'purchase'")).distinct().subtract(ids("value > 1e9").intersect(e.select("user_id")))


# == streams

_OPS = "CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'add' WHEN event_type IN ('purchase', 'logout') THEN 'del' END"


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, t, i, t AS start, 1 AS batch FROM o WHERE i = 1
 UNION ALL SELECT o.user_id, o.event_id, o.t, o.i, CASE WHEN o.t > f.start + 21600000000 THEN o.t ELSE f.start END, CASE WHEN o.t > f.start + 21600000000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, event_id, CAST(batch AS BIGINT) AS batch FROM f""")
def fixed_delay_batches(spark, sf_dir):
    x = changes.fixed_delay_batches(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 6 * 3600 * 1_000_000)
    return x.select("user_id", "event_id", F.col("batch").cast("long").alias("batch"))


_STATE = f"""WITH e AS (SELECT event_id // 500 AS batch, {_OPS} AS op, user_id AS path FROM events), b AS (SELECT path, batch, max(CASE WHEN op = 'add' THEN 1 ELSE 0 END) AS add FROM e WHERE op IS NOT NULL GROUP BY ALL)
SELECT CAST(path AS VARCHAR) AS path, arg_max(add, batch) AS present, max(batch) AS batch FROM b GROUP BY path"""


@query(_STATE)
def change_replay(spark, sf_dir):
    x = table(spark, sf_dir, "events").selectExpr("event_id div 500 AS batch", f"{_OPS} AS op", "CAST(user_id AS STRING) AS path").where("op IS NOT NULL")
    return changes.replay(x, [])


@query(f"SELECT DISTINCT CAST(user_id AS VARCHAR) AS path FROM events WHERE {_OPS} = 'add'")
def stream_flush(spark, sf_dir):
    """The events as a stream: each micro-batch deletes, then adds; a path in both sets ends present."""
    from ..sources.work import work_folder

    folder = work_folder(spark, "stream")
    feed = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    feed = feed.selectExpr(f"{_OPS} AS op", "CAST(user_id AS STRING) AS path").where("op IS NOT NULL")
    store = Store(spark, folder, "feed")

    def flush(add: DataFrame, gone: DataFrame) -> None:
        store.remove_paths("present", "path string", gone)
        store.upsert_paths("present", "path string", add, add)

    changes.run_stream(feed, flush, f"{folder}/checkpoint", once=True).awaitTermination()
    return store.read("present", "path string")


@query(f"""WITH {FILES} SELECT path, regexp_matches(path, '(^|/)(build|dist|out|vendor|node_modules|\\.vscode|\\.idea|\\.gneiss|\\.git[^/]*)(/|$)') AS ignored, {_SQL_EXT} = '.go' AS go, {_SQL_EXT} IN ('.ts', '.js') AS js, {_SQL_EXT} = '.php' AS php FROM files""")
def change_classes(spark, sf_dir):
    x = files(spark, sf_dir)
    return x.select("path", P.ignored_change("path").alias("ignored"), *(c.alias(k) for k, c in changes.class_flags("path").items()))


_CODES = {"view": " M", "click": "??", "purchase": "D ", "signup": "R ", "logout": "C "}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODES.items()) + " END"


@query("""WITH e AS (SELECT user_id, event_type AS t, 'f' || event_id AS p, 'g' || event_id AS q FROM events)
SELECT DISTINCT user_id, op, path FROM (SELECT user_id, 'add' AS op, p AS path FROM e WHERE t IN ('view', 'click') UNION ALL SELECT user_id, 'del', p FROM e WHERE t IN ('purchase', 'signup')
UNION ALL SELECT user_id, 'add', q FROM e WHERE t IN ('signup', 'logout'))""")
def git_status(spark, sf_dir):
    """The events of each user as the answer of one status call: changed, new, deleted, renamed and copied files."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"{_CASE} AS code").where("code IS NOT NULL")
    entry = F.concat("code", F.lit(" f"), F.col("event_id").cast("string"), F.lit("\0"), F.when(F.col("code").isin("R ", "C "), F.concat(F.lit("g"), F.col("event_id").cast("string"), F.lit("\0"))).otherwise(F.lit("")))
    blob = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("x")))), lambda s: s["x"]), "").alias("blob"))
    return blob.select("user_id", F.inline(changes.status_paths("blob")))
