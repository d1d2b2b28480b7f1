"""Queries over whole tables for every operator of the core, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcloom.functions import paths as P
from srcloom.functions import text as T
from srcloom.functions.vectors import l2_normalize
from srcloom.operators import answer as A
from srcloom.operators import chunking, files, graph, imports, lookup, search, symbols
from srcloom.operators import impact as I
from srcloom.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _list(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


REPO = "quillmark-core"

# Paths -----------------------------------------------------------------------------------

_SUFFIX = r"lower(regexp_extract(file_path, '[^/](\.[^./]+)$', 1))"
_PATHS = "(SELECT DISTINCT repo_id, file_path FROM source_files WHERE file_path IS NOT NULL)"
_LANG = f"CASE {_SUFFIX} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " ELSE 'unknown' END"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where("file_path IS NOT NULL").select("repo_id", "file_path").distinct()


@_q(f"""SELECT repo_id, file_path FROM {_PATHS} WHERE {_SUFFIX} IN ({_list(P.INCLUDE_SUFFIXES)})
    AND len(list_filter(list_slice(string_split(file_path, '/'), 1, -2), lambda p: p IN ({_list(P.SKIP_DIRS)}) OR starts_with(p, '.'))) = 0""")
def scan_walk_filter(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("file_path")
    return _paths(spark, d).where(P.is_included(p) & ~P.in_skipped_dir(p))


@_q(f"SELECT repo_id, file_path, {_SUFFIX} AS suffix, {_SUFFIX} IN ({_list(P.INCLUDE_SUFFIXES)}) AS kept FROM {_PATHS}")
def scan_ext_filter(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("file_path")
    return _paths(spark, d).select("repo_id", p, P.suffix(p).alias("suffix"), P.is_included(p).alias("kept"))


@_q(f"SELECT repo_id, file_path, {_LANG} AS language FROM {_PATHS}")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("repo_id", "file_path", P.language(F.col("file_path")).alias("language"))


@_q(f"SELECT repo_id, file_path, CASE WHEN starts_with(file_path, 'src/') THEN substr(file_path, 5) ELSE file_path END AS rel_path FROM {_PATHS}")
def rel_path(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("repo_id", "file_path", P.relative(F.col("file_path"), "src").alias("rel_path"))


# Texts -----------------------------------------------------------------------------------


@_q(r"""SELECT doc_id, CASE WHEN instr(text, chr(0)) = 0 THEN regexp_replace(text, '\r\n?', chr(10), 'g') END AS loaded FROM documents""")
def load_text_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.load_text(F.col("text").cast("binary")).alias("loaded"))


@_q("""SELECT doc_id, CAST(length(substr(text, 1, n_chars // 2)) - length(replace(substr(text, 1, n_chars // 2), chr(10), '')) + 1 AS INTEGER) AS line_no
    FROM documents WHERE text IS NOT NULL""")
def line_of_offset(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", T.line_of_offset(F.col("text"), F.floor(F.col("n_chars") / 2)).alias("line_no"))


_STRIP = r"[\s\x{1c}-\x{1f}\x{85}\x{0b}\p{Z}]+"


@_q(f"""SELECT chunk_id, regexp_replace(regexp_replace(substr(content, 1, 200), '^{_STRIP}', ''), '{_STRIP}$', '') AS line FROM (SELECT DISTINCT chunk_id, content FROM chunks)""")
def cli_snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "content").distinct().select("chunk_id", T.cli_snippet(F.col("content")).alias("line"))


@_q("SELECT chunk_id, symbols, imports FROM (SELECT DISTINCT chunk_id, symbols, imports FROM chunks)")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "symbols", "imports").distinct()
    back = lambda n: F.from_json(F.to_json(n), "array<string>").alias(n)
    return c.select("chunk_id", back("symbols"), back("imports"))


_RANKED = f"""(SELECT repo_id || '/' || file_path AS question, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY start_line, chunk_id) AS rank, file_path, start_line, end_line, content
    FROM (SELECT DISTINCT chunk_id, repo_id, file_path, start_line, end_line, content FROM chunks WHERE content IS NOT NULL))"""
_BLOCK = "'[' || rank || '] File: ' || file_path || ' (lines ' || start_line || '–' || end_line || ')' || chr(10) || '```' || chr(10) || substr(content, 1, 800) || chr(10) || '```'"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("content IS NOT NULL").select("chunk_id", "repo_id", "file_path", "start_line", "end_line", "content").distinct()
    w = Window.partitionBy("repo_id", "file_path").orderBy("start_line", "chunk_id")
    return c.select(F.concat_ws("/", "repo_id", "file_path").alias("question"), F.row_number().over(w).alias("rank"), "file_path", "start_line", "end_line", "content")


@_q(f"SELECT question, rank, {_BLOCK} AS block FROM {_RANKED}")
def prompt_blocks(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d)
    return r.select("question", F.col("rank").cast("long").alias("rank"), T.prompt_block(F.col("rank"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("block"))


_PROMPT = f"""SELECT question, count(*) AS n_chunks, 'Code excerpts from the repository:' || chr(10) || string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || question
    || chr(10) || chr(10) || 'Answer based strictly on the excerpts above. Cite by [N] number.' AS prompt FROM {_RANKED} GROUP BY question"""


@_q(_PROMPT)
def build_prompt(spark: SparkSession, d: str) -> DataFrame:
    return A.build_prompts(_ranked(spark, d))


# Answers are the document texts with citation marks from their ids behind them.
_ANSWER = "coalesce(text, '') || ' [' || (doc_id % 7) || '][' || (doc_id % 3 + 1) || ', 2][' || (doc_id % 7) || '] [99]' || CASE WHEN doc_id % 5 = 0 THEN ' This is Not Shown.' ELSE '' END"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", f"{_ANSWER} AS answer")


_CITED = r"""list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda s: CAST(right(s, 18) AS BIGINT)), lambda k: k >= 1 AND k <= 5)))"""


@_q(f"SELECT doc_id, {_CITED} AS cited FROM (SELECT doc_id, {_ANSWER} AS answer FROM documents)")
def parse_citations(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("doc_id", T.cited(F.col("answer"), F.lit(5)).alias("cited"))


@_q(f"""SELECT doc_id, CASE WHEN {' OR '.join(f"contains(lower(answer), '{p.replace(chr(39), chr(39) * 2)}')" for p in T.UNCERTAIN)} THEN '{T.UNCERTAIN_NOTE}' END AS uncertainty
    FROM (SELECT doc_id, {_ANSWER} AS answer FROM documents)""")
def uncertainty_flag(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("doc_id", T.uncertainty(F.col("answer")).alias("uncertainty"))


_FILE_ANSWER = "'See [1] and [' || n_chunks || '], not [0] or [' || (n_chunks + 1) || '].'"


@_q(f"""WITH r AS (SELECT * FROM {_RANKED}), a AS (SELECT question, count(*) AS n_chunks FROM r GROUP BY question)
    SELECT r.question, CAST(rank AS BIGINT) AS rank, file_path, start_line, end_line, 'Cited as [' || rank || '] in the answer' AS relevance FROM r JOIN a USING (question) WHERE rank = 1 OR rank = n_chunks""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d).withColumn("rank", F.col("rank").cast("long"))
    a = r.groupBy("question").agg(F.count(F.lit(1)).alias("n_chunks")).withColumn("answer", F.expr(_FILE_ANSWER))
    return A.citations(a, r)


_FIRST = "any_value(file_path || ' (lines ' || start_line || '–' || end_line || ')') FILTER (WHERE rank = 1)"


@_q(f"""SELECT *, CASE WHEN {' OR '.join(f"contains(lower(answer), '{p.replace(chr(39), chr(39) * 2)}')" for p in T.UNCERTAIN)} THEN '{T.UNCERTAIN_NOTE}' END AS uncertainty
    FROM (SELECT question, count(*) AS n_chunks, 'The most relevant excerpt is ' || {_FIRST} || ' [1].' AS answer FROM {_RANKED} GROUP BY question)""")
def ask_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return A.answer(A.build_prompts(_ranked(spark, d)))


# Chunks and symbols ----------------------------------------------------------------------

_BLANK = r"^[\s\x{1c}-\x{1f}\x{85}\x{0b}\p{Z}]*$"


@_q(rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS x FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, x, CAST(length(x) AS BIGINT) AS l FROM t WHERE NOT regexp_full_match(x, '{_BLANK}')),
    w AS (SELECT doc_id, x, l, CAST(0 AS BIGINT) AS st, CAST(-1 AS BIGINT) AS en, false AS blank, CAST(0 AS BIGINT) AS nxt FROM f
      UNION ALL
      SELECT doc_id, x, l, st, en, blank, CASE WHEN blank OR n <= st THEN en ELSE n END FROM (
        SELECT doc_id, x, l, st, en, blank, CASE WHEN en - 200 > st AND en - 200 < l AND q > 0 AND en - 200 + q - 1 < en THEN en - 200 + q ELSE en - 200 END AS n FROM (
          SELECT *, instr(substr(x, en - 200 + 1), chr(10)) AS q, regexp_full_match(substr(x, st + 1, en - st), '{_BLANK}') AS blank FROM (
            SELECT doc_id, x, l, st, CASE WHEN st + 1600 < l AND k >= 2 THEN st + k ELSE least(st + 1600, l) END AS en FROM (
              SELECT doc_id, x, l, nxt AS st, 1600 - length(regexp_extract(substr(x, nxt + 1, 1600), '[^\n]*$')) AS k FROM w WHERE nxt < l))))),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS no FROM w WHERE en >= 0 AND NOT blank)
    SELECT doc_id, CAST(no AS INTEGER) AS chunk_no, CAST(length(substr(x, 1, st)) - length(replace(substr(x, 1, st), chr(10), '')) + 1 AS INTEGER) AS start_line,
      CAST(length(substr(x, 1, en)) - length(replace(substr(x, 1, en), chr(10), '')) + 1 AS INTEGER) AS end_line, substr(x, st + 1, en - st) AS content FROM c""")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("docs").alias("repo_id"), F.col("doc_id").cast("string").alias("file_path"), "text")
    return chunking.chunk_files(docs).select(F.col("file_path").cast("long").alias("doc_id"), "chunk_no", "start_line", "end_line", "content")


def _files(spark: SparkSession, d: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Whole files, put together from their chunks."""
    whole = files.assemble(table(spark, d, "chunks"), tuple(s[1:] for s in suffixes))
    return whole.select("repo_id", "file_path", P.language(F.col("file_path")).alias("language"), "text")


_PY, _JS = (".py",), (".ts", ".tsx", ".js", ".jsx")


def _file_sql(suffixes: tuple[str, ...]) -> str:
    return f"""(SELECT repo_id, file_path, {_LANG} AS language, string_agg(CASE WHEN nxt IS NULL THEN content ELSE array_to_string(list_slice(string_split(content, chr(10)), 1, nxt - start_line), chr(10)) || chr(10) END, '' ORDER BY start_line) AS text
        FROM (SELECT *, lead(start_line) OVER (PARTITION BY repo_id, file_path ORDER BY start_line) AS nxt FROM (
            SELECT repo_id, file_path, start_line, max(content) AS content FROM chunks WHERE content IS NOT NULL AND file_path IS NOT NULL AND start_line IS NOT NULL AND {_SUFFIX} IN ({_list(suffixes)}) GROUP BY ALL)) GROUP BY ALL)"""


def _line_sql(suffixes: tuple[str, ...]) -> str:
    return f"(SELECT repo_id, file_path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM {_file_sql(suffixes)})"


def _symbols_sql(suffixes: tuple[str, ...], fn: str, cl: str) -> str:
    return f"""SELECT repo_id, file_path, CASE WHEN f != '' THEN f ELSE c END AS symbol_name, CASE WHEN f != '' THEN 'function' ELSE 'class' END AS kind, CAST(no AS INTEGER) AS start_line
        FROM (SELECT *, {fn} AS f, {cl} AS c FROM {_line_sql(suffixes)}) WHERE f != '' OR c != ''"""


@_q(_symbols_sql(_PY, r"regexp_extract(line, '^def\s+(\w+)\s*\(', 1)", r"regexp_extract(line, '^class\s+(\w+)', 1)"))
def symbols_regex_py(spark: SparkSession, d: str) -> DataFrame:
    return symbols.regex_symbols(_files(spark, d, _PY), True)


_TSF = r"^\s*(?:export\s+)?(?:async\s+)?(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\()"


@_q(_symbols_sql(_JS, f"regexp_extract(line, '{_TSF}', 1) || regexp_extract(line, '{_TSF}', 2)", r"regexp_extract(line, '^\s*(?:export\s+)?class\s+(\w+)', 1)"))
def symbols_regex_ts(spark: SparkSession, d: str) -> DataFrame:
    return symbols.regex_symbols(_files(spark, d, _JS), False)


def _imports_sql(suffixes: tuple[str, ...], pattern: str) -> str:
    return f"SELECT repo_id, file_path, m AS imported_module, starts_with(m, '.') AS is_relative FROM (SELECT repo_id, file_path, unnest(regexp_extract_all(text, '{pattern}', 1)) AS m FROM {_file_sql(suffixes)})"


@_q(_imports_sql(_PY, r"(?m)^(?:import|from)\s+([\w.]+)"))
def imports_regex_py(spark: SparkSession, d: str) -> DataFrame:
    return symbols.regex_imports(_files(spark, d, _PY), True)


@_q(_imports_sql(_JS, r"""(?:import|from)\s+[''"]([^''"]+)[''"]"""))
def imports_regex_ts(spark: SparkSession, d: str) -> DataFrame:
    return symbols.regex_imports(_files(spark, d, _JS), False)


@_q(rf"""SELECT repo_id, file_path, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS names FROM (SELECT repo_id, file_path, CASE WHEN language = 'python' THEN regexp_extract_all(text, '(?m)^(?:def|class)\s+(\w+)', 1)
    ELSE regexp_extract_all(text, '(?m)^(?:export\s+)?(?:function|class|const|let|var)\s+(\w+)', 1) END AS raw FROM {_file_sql(_PY + _JS)})""")
def prescan_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d, _PY + _JS).select("repo_id", "file_path", symbols.prescan(F.col("text"), F.col("language")).alias("names"))


@_q()
def symbols_python(spark: SparkSession, d: str) -> DataFrame:
    return symbols.extract(_files(spark, d, _PY)).where("what != 'import'")


@_q()
def symbols_ts(spark: SparkSession, d: str) -> DataFrame:
    return symbols.extract(_files(spark, d, _JS)).where("what != 'import'")


@_q()
def imports_python(spark: SparkSession, d: str) -> DataFrame:
    return symbols.extract(_files(spark, d, _PY)).where("what = 'import'")


_KNOWN_IMPORTS = """(SELECT DISTINCT repo_id, file_path AS source_file, unnest(imports) AS imported_module FROM chunks WHERE imports IS NOT NULL AND {suffix} IN ({these}))"""


def _known_imports(spark: SparkSession, d: str, suffixes: tuple[str, ...]) -> DataFrame:
    c = table(spark, d, "chunks").where(P.suffix(F.col("file_path")).isin(*suffixes))
    return c.select("repo_id", F.col("file_path").alias("source_file"), F.explode("imports").alias("imported_module")).distinct()


@_q(rf"""WITH i AS {_KNOWN_IMPORTS.format(suffix=_SUFFIX, these=_list(_PY))},
    p AS (SELECT *, translate(regexp_replace(imported_module, '^\.+', ''), '.', '/') AS m, regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS dir FROM i WHERE imported_module IS NOT NULL AND imported_module != ''),
    b AS (SELECT *, CASE WHEN m = '' THEN dir WHEN dir = '' THEN m ELSE dir || '/' || m END AS here FROM p),
    c AS (SELECT repo_id, source_file, imported_module, unnest([here || CASE WHEN m = '' THEN '/.py' ELSE '.py' END, CASE WHEN here = '' THEN '' ELSE here || '/' END || '__init__.py', m || '.py', CASE WHEN m = '' THEN '' ELSE m || '/' END || '__init__.py']) AS t, unnest([0, 1, 2, 3]) AS rank FROM b)
    SELECT repo_id, source_file, imported_module, arg_min(t, rank) AS target_file FROM c WHERE (repo_id, t) IN (SELECT repo_id, file_path FROM source_files) GROUP BY ALL""")
def resolve_py_imports(spark: SparkSession, d: str) -> DataFrame:
    return imports.resolve_python(_known_imports(spark, d, _PY), _paths(spark, d))


@_q(rf"""WITH RECURSIVE i AS (SELECT row_number() OVER () AS n, * FROM {_KNOWN_IMPORTS.format(suffix=_SUFFIX, these=_list(_JS))} WHERE starts_with(imported_module, '.')),
    s AS (SELECT n, string_split(CASE WHEN contains(source_file, '/') THEN regexp_extract(source_file, '^(.*)/[^/]*$', 1) || '/' ELSE '' END || imported_module, '/') AS parts FROM i),
    w AS (SELECT n, parts, 1 AS k, CAST([] AS VARCHAR[]) AS acc FROM s UNION ALL
      SELECT n, parts, k + 1, CASE WHEN parts[k] IN ('', '.') THEN acc WHEN parts[k] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_append(acc, parts[k]) END FROM w WHERE k <= len(parts)),
    b AS (SELECT n, array_to_string(acc, '/') AS base FROM w WHERE k = len(parts) + 1),
    e AS (SELECT n, base, regexp_replace(base, '([^/])\.[^./]+$', '\1') AS stem FROM b),
    c AS (SELECT n, unnest([stem || '.ts', base || '/index.ts', stem || '.tsx', base || '/index.tsx', stem || '.js', base || '/index.js', stem || '.jsx', base || '/index.jsx']) AS t, unnest(range(8)) AS rank FROM e)
    SELECT repo_id, source_file, imported_module, arg_min(t, rank) AS target_file FROM c JOIN i USING (n) WHERE (repo_id, t) IN (SELECT repo_id, file_path FROM source_files) GROUP BY ALL""")
def resolve_ts_imports(spark: SparkSession, d: str) -> DataFrame:
    return imports.resolve_script(_known_imports(spark, d, _JS), _paths(spark, d))


# Lookups ---------------------------------------------------------------------------------


def _first_chunk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").agg(F.min("chunk_id").alias("chunk_id"))


@_q("SELECT DISTINCT chunk_id, file_path, language, start_line, end_line, symbols, imports, content FROM chunks WHERE chunk_id = (SELECT min(chunk_id) FROM chunks)")
def get_chunk(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "file_path", "language", "start_line", "end_line", "symbols", "imports", "content")
    return c.join(F.broadcast(_first_chunk(spark, d)), "chunk_id").distinct()  # one row


@_q(f"""SELECT DISTINCT chunk_id, start_line, end_line, content FROM chunks WHERE repo_id = '{REPO}' AND file_path = (SELECT min(file_path) FROM chunks WHERE repo_id = '{REPO}') ORDER BY start_line, chunk_id""")
def chunks_by_file(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where(F.col("repo_id") == REPO)
    f = F.broadcast(c.agg(F.min("file_path").alias("file_path")))  # one row
    return c.join(f, "file_path").select("chunk_id", "start_line", "end_line", "content").distinct().orderBy("start_line", "chunk_id")


_LATEST = """(SELECT symbol_name, repo_id, file_path, start_line, kind FROM (SELECT *, row_number() OVER (PARTITION BY symbol_name, repo_id, file_path
    ORDER BY ingested_at DESC NULLS LAST, start_line DESC NULLS LAST, kind DESC NULLS LAST) AS rn FROM symbols) WHERE rn = 1)"""


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return lookup.latest_symbols(table(spark, d, "symbols"))


@_q(f"SELECT * FROM {_LATEST}")
def upsert_symbol_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d)


_NAME_SQL = f"(SELECT min(symbol_name) FROM symbols WHERE repo_id = '{REPO}')"


@_q(f"SELECT * FROM {_LATEST} WHERE repo_id = '{REPO}' AND symbol_name = {_NAME_SQL} ORDER BY file_path")
def find_symbol(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where(F.col("repo_id") == REPO)
    one = F.broadcast(s.agg(F.min("symbol_name").alias("symbol_name")))  # one row
    return lookup.latest_symbols(s.join(one, "symbol_name", "left_semi")).orderBy("file_path")


_OK = "coalesce(kind IN ('function', 'class', 'method'), false)"


@_q(f"""WITH s AS {_LATEST}, o AS (SELECT *, row_number() OVER (PARTITION BY repo_id, symbol_name ORDER BY NOT {_OK}, file_path) AS rn FROM s)
    SELECT o.repo_id, o.symbol_name, o.file_path AS defining_file, o.start_line, r.refs AS "references" FROM o
    JOIN (SELECT repo_id, symbol_name, list_sort(list_distinct(list(file_path))) AS refs FROM s GROUP BY ALL) r ON o.repo_id IS NOT DISTINCT FROM r.repo_id AND o.symbol_name = r.symbol_name WHERE rn = 1""")
def definition_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.definitions(_latest(spark, d))


@_q(f"SELECT repo_id, symbol_name, list_sort(list_distinct(list(file_path))) AS files FROM {_LATEST} GROUP BY ALL")
def symbol_references(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).groupBy("repo_id", "symbol_name").agg(F.array_sort(F.collect_set("file_path")).alias("files"))


@_q(f"SELECT repo_id, symbol_name, list_slice(list_sort(list_distinct(list(file_path))), 1, 10) AS listed, count(DISTINCT file_path) AS n_files FROM {_LATEST} GROUP BY ALL")
def listed_references(spark: SparkSession, d: str) -> DataFrame:
    """The ten references a definition lists, and how many there are."""
    r = symbol_references(spark, d)
    return r.select("repo_id", "symbol_name", F.slice("files", 1, 10).alias("listed"), F.size("files").cast("long").alias("n_files"))


@_q(f"""WITH s AS {_LATEST}, d AS (SELECT repo_id, symbol_name, min(file_path) AS definer FROM s WHERE {_OK} GROUP BY ALL)
    SELECT s.repo_id, s.symbol_name, s.file_path FROM s LEFT JOIN d ON s.repo_id IS NOT DISTINCT FROM d.repo_id AND s.symbol_name = d.symbol_name WHERE s.file_path IS DISTINCT FROM d.definer""")
def symbol_refs(spark: SparkSession, d: str) -> DataFrame:
    s = _latest(spark, d)
    definer = lookup.definitions(s, strict=True).select("repo_id", "symbol_name", "defining_file")
    return s.join(definer, ["repo_id", "symbol_name"], "left").where(~F.col("file_path").eqNullSafe(F.col("defining_file"))).select("repo_id", "symbol_name", "file_path")


@_q(f"SELECT repo_id, count(*) AS n_symbols FROM {_LATEST} GROUP BY repo_id")
def count_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_symbols"))


# Graph -----------------------------------------------------------------------------------

_EDGES = "(SELECT DISTINCT repo_id, source_file, target_file, edge_type FROM edges WHERE source_file IS NOT NULL AND target_file IS NOT NULL)"
_IMPORTS = "(SELECT DISTINCT repo_id, source_file, target_file FROM edges WHERE source_file IS NOT NULL AND target_file IS NOT NULL AND edge_type = 'import')"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.distinct_edges(table(spark, d, "edges"))


def _imports_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.distinct_edges(table(spark, d, "edges"), "import")


@_q(f"SELECT * FROM {_EDGES}")
def distinct_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@_q(f"SELECT repo_id, count(*) AS n_edges FROM {_EDGES} GROUP BY repo_id")
def count_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_edges"))


_NODES = "(SELECT repo_id, source_file AS node FROM edges WHERE source_file IS NOT NULL UNION SELECT repo_id, target_file FROM edges WHERE target_file IS NOT NULL UNION SELECT repo_id, file_path FROM source_files WHERE file_path IS NOT NULL)"


@_q(f"""SELECT n.repo_id, n_nodes, coalesce(n_edges, 0) AS n_edges FROM (SELECT repo_id, count(*) AS n_nodes FROM {_NODES} GROUP BY repo_id) n
    LEFT JOIN (SELECT repo_id, count(*) AS n_edges FROM (SELECT DISTINCT repo_id, source_file, target_file FROM {_EDGES}) GROUP BY repo_id) e ON n.repo_id IS NOT DISTINCT FROM e.repo_id""")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    n = graph.nodes(table(spark, d, "edges"), table(spark, d, "source_files")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = _edges(spark, d).select("repo_id", "source_file", "target_file").distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_edges"))
    e = e.withColumnRenamed("repo_id", "r")
    return n.join(e, F.col("repo_id").eqNullSafe(F.col("r")), "left").select("repo_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def _edge_point(spark: SparkSession, d: str, column: str) -> DataFrame:
    e = _edges(spark, d).where(F.col("repo_id") == REPO)
    one = F.broadcast(e.agg(F.min(column).alias(column)))  # one row
    return e.join(one, column, "left_semi").select("repo_id", "source_file", "target_file", "edge_type")


@_q(f"SELECT * FROM {_EDGES} WHERE repo_id = '{REPO}' AND source_file = (SELECT min(source_file) FROM {_EDGES} WHERE repo_id = '{REPO}')")
def edges_from(spark: SparkSession, d: str) -> DataFrame:
    return _edge_point(spark, d, "source_file")


@_q(f"SELECT * FROM {_EDGES} WHERE repo_id = '{REPO}' AND target_file = (SELECT min(target_file) FROM {_EDGES} WHERE repo_id = '{REPO}')")
def edges_to(spark: SparkSession, d: str) -> DataFrame:
    return _edge_point(spark, d, "target_file")


def _bfs_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE e AS {_IMPORTS}, r AS (SELECT DISTINCT repo_id, {a} AS start, {b} AS node, 1 AS depth FROM e
        UNION SELECT r.repo_id, r.start, e.{b}, r.depth + 1 FROM r JOIN e ON e.repo_id = r.repo_id AND e.{a} = r.node WHERE r.depth < 3)
        SELECT repo_id, start, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL"""


@_q(_bfs_sql("target_file", "source_file"))
def dependents_bfs(spark: SparkSession, d: str) -> DataFrame:
    e = _imports_of(spark, d)
    return graph.in_order(graph.reach(e, e.select("repo_id", F.col("target_file").alias("start")), 3))


@_q(_bfs_sql("source_file", "target_file"))
def dependencies_bfs(spark: SparkSession, d: str) -> DataFrame:
    e = _imports_of(spark, d)
    return graph.in_order(graph.reach(e, e.select("repo_id", F.col("source_file").alias("start")), 3, reverse=False))


# Search ----------------------------------------------------------------------------------


@_q("SELECT vec_id, list_transform(e, lambda x: round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 9)) AS unit FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)")
def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    unit = F.transform(l2_normalize(F.col("embedding")), lambda x: F.round(x, 9))
    return table(spark, d, "embeddings").select("vec_id", unit.alias("unit"))


_VECTORS = "(SELECT chunk_id, max(embedding)::DOUBLE[] AS e FROM vectors WHERE len(embedding) = 64 GROUP BY chunk_id)"
_COS = "CASE WHEN list_sum(list_transform({a}, lambda x: x * x)) = 0 OR list_sum(list_transform({b}, lambda x: x * x)) = 0 THEN 0 ELSE list_cosine_similarity({a}, {b}) END"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vectors").where("chunk_id IS NOT NULL AND size(embedding) = 64")


def _first(vectors: DataFrame) -> DataFrame:
    """The vector of the smallest id: one row, found without a shuffle."""
    return vectors.orderBy("chunk_id", F.desc("embedding")).limit(1)


@_q(f"""WITH v AS {_VECTORS}, q AS (SELECT e AS qe FROM v ORDER BY chunk_id LIMIT 1),
    t AS (SELECT chunk_id, {_COS.format(a='e', b='qe')} AS score FROM v, q ORDER BY score DESC, chunk_id LIMIT 10)
    SELECT DISTINCT t.chunk_id, file_path, start_line, end_line, round(score, 6) AS score, substr(content, 1, 300) AS snippet FROM t JOIN chunks c USING (chunk_id)""")
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _rows(spark, d)
    return search.with_chunks(search.top_k(v, _first(v), 10), table(spark, d, "chunks"))


@_q("""SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0)) WHERE rank <= 10""")
def search_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.batch_top_k(e.select(F.col("vec_id").alias("id"), "embedding"), q, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@_q("""SELECT vec_id, printf('%.3f', round(e[1], 6)) AS three, printf('%.2f', round(e[2], 6)) AS two FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def score_format(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", T.score_text(F.round(F.col("e")[0], 6)).alias("three"), T.score_text(F.round(F.col("e")[1], 6), 2).alias("two"))


@_q()
def embed_hash(spark: SparkSession, d: str) -> DataFrame:
    return search.embed(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text"))


@_q(f"""WITH v AS {_VECTORS}, q AS (SELECT e AS qe FROM v ORDER BY chunk_id LIMIT 1),
    t AS (SELECT chunk_id, {_COS.format(a='e', b='qe')} AS score FROM v, q ORDER BY score DESC, chunk_id LIMIT 8),
    r AS (SELECT row_number() OVER (ORDER BY score DESC, chunk_id) AS rank, chunk_id FROM t JOIN (SELECT DISTINCT chunk_id FROM chunks) USING (chunk_id) JOIN (SELECT chunk_id, score AS s FROM t) USING (chunk_id))
    SELECT CAST(rank AS BIGINT) AS rank, chunk_id, any_value(content) AS content FROM r JOIN chunks USING (chunk_id) GROUP BY ALL""".replace(" JOIN (SELECT chunk_id, score AS s FROM t) USING (chunk_id)", ""))
def ask_context(spark: SparkSession, d: str) -> DataFrame:
    v = _rows(spark, d)
    found = search.hit_rows(search.top_k(v, _first(v), 8), table(spark, d, "chunks").select("chunk_id", "content"))
    return found.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "chunk_id")).cast("long").alias("rank"), "chunk_id", "content")


# Impact ----------------------------------------------------------------------------------


def _impact_sql(targets: str, similar: str = "SELECT NULL AS repo_id, NULL AS target, NULL AS file_path WHERE false") -> str:
    return f"""WITH RECURSIVE e AS {_IMPORTS}, n AS {_NODES}, s AS {_LATEST}, t AS ({targets}),
    f AS (SELECT repo_id, target, target AS root FROM t WHERE (repo_id, target) IN (SELECT repo_id, node FROM n)),
    nm AS (SELECT * FROM t WHERE (repo_id, target) NOT IN (SELECT repo_id, node FROM n)),
    ro AS (SELECT * FROM f UNION ALL SELECT nm.repo_id, target, min(file_path) FROM nm JOIN s ON s.repo_id = nm.repo_id AND s.symbol_name = target WHERE {_OK} GROUP BY ALL),
    w AS (SELECT DISTINCT ro.repo_id, root, e.source_file AS node, 1 AS depth FROM ro JOIN e ON e.repo_id = ro.repo_id AND e.target_file = root
        UNION SELECT w.repo_id, w.root, e.source_file, w.depth + 1 FROM w JOIN e ON e.repo_id = w.repo_id AND e.target_file = w.node WHERE w.depth < 3),
    b AS (SELECT repo_id, root, node, min(depth) AS depth FROM w GROUP BY ALL),
    g AS (SELECT ro.repo_id, target, node AS file_path, CASE WHEN depth = 1 THEN 'direct import' ELSE 'transitive import (' || depth || ' hops)' END AS reason,
        CAST(CASE depth WHEN 1 THEN 0.95 WHEN 2 THEN 0.75 WHEN 3 THEN 0.5 ELSE 0.3 END AS DOUBLE) AS confidence, depth, 1 AS signal FROM ro JOIN b ON b.repo_id = ro.repo_id AND b.root = ro.root),
    x AS (SELECT DISTINCT nm.repo_id, nm.target, s.file_path, 'references symbol' AS reason, CAST(0.7 AS DOUBLE) AS confidence, 0 AS depth, 2 AS signal FROM nm JOIN s ON s.repo_id = nm.repo_id AND s.symbol_name = nm.target
        LEFT JOIN ro ON ro.repo_id = nm.repo_id AND ro.target = nm.target WHERE s.file_path IS DISTINCT FROM ro.root),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, target, file_path ORDER BY confidence DESC, signal) AS rn FROM (SELECT * FROM g UNION ALL SELECT * FROM x)) WHERE rn = 1),
    z AS ({similar}),
    y AS (SELECT repo_id, target, file_path, reason, confidence, depth FROM m UNION ALL SELECT DISTINCT repo_id, target, file_path, 'semantically related', CAST(0.35 AS DOUBLE), 0 FROM z
        WHERE (repo_id, target, file_path) NOT IN (SELECT repo_id, target, file_path FROM m) AND (repo_id, target, file_path) NOT IN (SELECT repo_id, target, root FROM ro))
    SELECT repo_id, target, file_path, reason, confidence, CAST(depth AS INTEGER) AS depth, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'related' END AS bucket FROM y"""


_FILE_TARGETS = "SELECT DISTINCT repo_id, target_file AS target FROM e WHERE repo_id IS NOT NULL"
_SYMBOL_TARGETS = "SELECT DISTINCT repo_id, symbol_name AS target FROM s WHERE repo_id IS NOT NULL"


def _impact(spark: SparkSession, d: str, targets: DataFrame, similar: DataFrame | None = None, repo: str | None = None) -> DataFrame:
    """Impact of targets; with repo, where all targets lie, nothing else is read."""
    of = lambda name: table(spark, d, name).where(F.lit(True) if repo is None else F.col("repo_id") == repo)
    every = graph.nodes(of("edges"), of("source_files"))
    return I.impact(targets.where("repo_id IS NOT NULL"), graph.distinct_edges(of("edges"), "import"), every, lookup.latest_symbols(of("symbols")), similar)


@_q(_impact_sql(_SYMBOL_TARGETS))
def impact_symbol_target(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, _latest(spark, d).select("repo_id", F.col("symbol_name").alias("target")))


@_q(_impact_sql(_FILE_TARGETS))
def impact_all_files(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, _imports_of(spark, d).select("repo_id", F.col("target_file").alias("target")))


_ONE_TARGET = f"SELECT repo_id, min(target_file) AS target FROM e WHERE repo_id = '{REPO}' GROUP BY repo_id"
_SIMILAR = f"""SELECT t.repo_id, t.target, h.file_path FROM t, (SELECT DISTINCT file_path FROM (
    SELECT v.chunk_id, {_COS.format(a='v.e', b='q.qe')} AS score FROM {_VECTORS} v JOIN (SELECT DISTINCT chunk_id FROM chunks WHERE repo_id = '{REPO}') USING (chunk_id),
      (SELECT e AS qe FROM {_VECTORS} ORDER BY chunk_id LIMIT 1) q ORDER BY score DESC, v.chunk_id LIMIT 5) JOIN chunks USING (chunk_id)) h"""


@_q(_impact_sql(_ONE_TARGET, _SIMILAR))
def impact_file_target(spark: SparkSession, d: str) -> DataFrame:
    t = _imports_of(spark, d).where(F.col("repo_id") == REPO).groupBy("repo_id").agg(F.min("target_file").alias("target"))
    c = table(spark, d, "chunks").where(F.col("repo_id") == REPO)
    v = _rows(spark, d)
    hits = search.top_k(v.join(c.select("chunk_id").distinct(), "chunk_id", "left_semi"), _first(v), I.SIMILAR_CHUNKS)
    files = F.broadcast(hits).join(c.select("chunk_id", "file_path"), "chunk_id").select("file_path").distinct()
    return _impact(spark, d, t, t.join(F.broadcast(files)), REPO)  # at most five files beside one target


@_q(_impact_sql(_FILE_TARGETS).replace("SELECT repo_id, target, file_path, reason, confidence, CAST(depth AS INTEGER) AS depth,", "SELECT repo_id, target,").replace(" AS bucket FROM y", " AS bucket, count(*) AS n_files, max(confidence) AS best FROM y GROUP BY ALL"))
def impact_buckets(spark: SparkSession, d: str) -> DataFrame:
    return impact_all_files(spark, d).groupBy("repo_id", "target", "bucket").agg(F.count(F.lit(1)).alias("n_files"), F.max("confidence").alias("best"))


@_q("SELECT repo_id, target, file_path, CAST(row_number() OVER (PARTITION BY repo_id, target ORDER BY confidence DESC, depth, file_path) AS INTEGER) AS rank FROM (" + _impact_sql(_FILE_TARGETS) + ")")
def impact_ranked(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("repo_id", "target").orderBy(F.desc("confidence"), "depth", "file_path")
    return impact_all_files(spark, d).select("repo_id", "target", "file_path", F.row_number().over(w).alias("rank"))


_SIGNALS = f"""SELECT repo_id, source_file AS target, target_file AS file_path, CAST(0.95 AS DOUBLE) AS confidence, 1 AS signal FROM {_IMPORTS}
    UNION ALL SELECT repo_id, target_file, source_file, CAST(0.75 AS DOUBLE), 2 FROM {_IMPORTS}"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    e = _imports_of(spark, d)
    one = e.select("repo_id", F.col("source_file").alias("target"), F.col("target_file").alias("file_path"), F.lit(0.95).alias("confidence"), F.lit(1).alias("signal"))
    two = e.select("repo_id", F.col("target_file").alias("target"), F.col("source_file").alias("file_path"), F.lit(0.75).alias("confidence"), F.lit(2).alias("signal"))
    return one.unionByName(two)


@_q(_SIGNALS)
def signal_union(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d)


@_q(f"SELECT repo_id, target, file_path, max(confidence) AS confidence FROM ({_SIGNALS}) GROUP BY ALL")
def impact_merge(spark: SparkSession, d: str) -> DataFrame:
    s = _signals(spark, d).withColumns({"depth": F.lit(1), "reason": F.lit("x")})
    return I.merge_signals(s).select("repo_id", "target", "file_path", "confidence")


@_q(f"""WITH f AS (SELECT repo_id, count(DISTINCT file_path) AS files_indexed FROM source_files GROUP BY repo_id), c AS (SELECT repo_id, count(DISTINCT chunk_id) AS chunks_indexed FROM chunks GROUP BY repo_id),
    s AS (SELECT repo_id, count(*) AS symbols_extracted FROM symbols GROUP BY repo_id), e AS (SELECT repo_id, count(*) AS edges_in_graph FROM {_EDGES} GROUP BY repo_id)
    SELECT repo_id, files_indexed, coalesce(chunks_indexed, 0) AS chunks_indexed, coalesce(symbols_extracted, 0) AS symbols_extracted, coalesce(edges_in_graph, 0) AS edges_in_graph
    FROM f LEFT JOIN c USING (repo_id) LEFT JOIN s USING (repo_id) LEFT JOIN e USING (repo_id)""")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").groupBy("repo_id").agg(F.countDistinct("file_path").alias("files_indexed"))
    c = table(spark, d, "chunks").groupBy("repo_id").agg(F.countDistinct("chunk_id").alias("chunks_indexed"))
    s = table(spark, d, "symbols").groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols_extracted"))
    e = _edges(spark, d).groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges_in_graph"))
    j = f.join(c, "repo_id", "left").join(s, "repo_id", "left").join(e, "repo_id", "left")
    return j.fillna(0, ["chunks_indexed", "symbols_extracted", "edges_in_graph"])
