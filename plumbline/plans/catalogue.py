"""The catalogue: every operator of the engine as a query over a data folder, with DuckDB SQL beside it."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import terms as T
from plumbline.functions import text as X
from plumbline.functions.languages import BY_SUFFIX, SUFFIXES
from plumbline.operators import facts, filters, graph, retrieval, snapshots, vectors, windows
from plumbline.session import shared_dir, ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _in(values: list[str]) -> str:
    return "(" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return facts.clean_files(table(spark, d, "files"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return facts.clean_chunks(table(spark, d, "chunks"))


def _fresh(spark: SparkSession, d: str) -> DataFrame:
    """(repo, path) of the files that retrieval may show."""
    return facts.fresh(table(spark, d, "files")).select("repo", "path").distinct()


def _live(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    """Ids of the chunks of these files."""
    return chunks.select("chunk_id", "repo", F.col("file_path").alias("path")).join(_fresh(spark, d), ["repo", "path"], "left_semi").select("chunk_id")


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of fresh files."""
    r = facts.clean_regions(table(spark, d, "regions")).where(F.col("symbol").isNotNull())
    rows = r.select(F.col("region_id").alias("symbol_id"), "repo", F.col("file_path").alias("path"), F.col("symbol").alias("name"), "start_line", "end_line")
    return rows.join(_fresh(spark, d), ["repo", "path"], "left_semi")


# SQL that several queries share: clean views of the tables ---------------------------------------------------------------

_SUFFIX = r"CASE lower(regexp_extract({p}, '\.([^./\\]*)$', 1)) " + " ".join(f"WHEN '{s}' THEN '{x}'" for s, x in BY_SUFFIX.items()) + " END"
_FILES = f"f AS (SELECT DISTINCT * REPLACE (CASE WHEN language IN {_in(list(SUFFIXES))} THEN language ELSE {_SUFFIX.format(p='path')} END AS language) FROM files)"
_CHUNKS = "c AS (SELECT DISTINCT * FROM chunks), ff AS (SELECT DISTINCT repo, path FROM files WHERE provenance = 'source' AND NOT stale), cf AS (SELECT c.* FROM c JOIN ff ON ff.repo = c.repo AND ff.path = c.file_path)"
_FRESH_FILES = _FILES.removesuffix(")") + " WHERE provenance = 'source' AND NOT stale)"
_REGIONS = "r AS (SELECT DISTINCT * FROM regions)"
_USABLE = "u AS (SELECT DISTINCT * FROM regions WHERE start_line >= 1 AND end_line >= start_line)"
_N = "(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - (CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END) END)"
_LINES = f"l AS (SELECT file_id, repo, path, language, {_N} AS n_lines, unnest(range(1, {_N} + 1)) AS line, unnest(string_split(text, chr(10))[1:{_N}]) AS content FROM f WHERE text IS NOT NULL)"
_BASE = "lower(regexp_extract({p}, '[^/]*$'))"
_GROUP = "CASE WHEN contains({p}, '/') THEN split_part({p}, '/', 1) ELSE '(repository root)' END"
_TOKENS = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+')"
_WORDS = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+(?:_[\p{{L}}\p{{N}}]+)*')"
_SUBS = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(coalesce({c}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_STOP = _in(T.STOP_WORDS)
_QS = "q AS (SELECT chunk_id AS qid, symbol AS question, language AS q_language FROM c WHERE chunk_id % 20 = 0 AND symbol <> '')"
_IGNORED = f"(len(list_filter(string_split(lower(path), '/'), lambda p: p IN {_in(filters.IGNORED_DIRS)})) > 0 OR {_BASE.format(p='path')} IN {_in(filters.IGNORED_FILES)} OR {' OR '.join(f'''suffix(lower(path), '{s}')''' for s in filters.IGNORED_SUFFIXES)})"
_NAME = _BASE.format(p="path")
_SENSITIVE = (
    f"((({_NAME} = '.env' OR starts_with({_NAME}, '.env.')) AND {_NAME} NOT IN {_in(filters.ENV_TEMPLATES)}) OR {_NAME} IN {_in(filters.SENSITIVE_NAMES)} OR "
    + " OR ".join(f"suffix({_NAME}, '{s}')" for s in filters.SENSITIVE_SUFFIXES)
    + rf" OR (list_contains(string_split(lower(path), '/'), '.ssh') AND NOT suffix({_NAME}, '.pub')) OR regexp_matches(lower(path), '(^|/)\.aws/credentials$') OR regexp_matches({_NAME}, '^(service[-_]?account.*|.*credentials?.*)\.json$'))"
)
_CONTROL = r"(length(text) - length(regexp_replace(text, '[\x00-\x07\x0b\x0e-\x1f\x7f]', '', 'g')))"


# Sources, manifests, aggregates --------------------------------------------------------------------------------------------


@query(f"WITH {_FILES}, {_CHUNKS}, {_REGIONS} SELECT f.file_id, f.repo, f.path, f.language, f.size_bytes, f.sha256, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_regions, 0) AS n_regions FROM f LEFT JOIN (SELECT repo, file_path, count(*) AS n_chunks FROM c GROUP BY ALL) x ON x.repo = f.repo AND x.file_path = f.path LEFT JOIN (SELECT file_id, count(*) AS n_regions FROM r GROUP BY ALL) y ON y.file_id = f.file_id")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    return facts.manifest(table(spark, d, "files"), table(spark, d, "chunks"), table(spark, d, "regions"))


@query(f"WITH {_FILES} SELECT language, count(*) AS n_files, coalesce(sum(size_bytes), 0)::BIGINT AS total_bytes FROM f GROUP BY language")
def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


@query("SELECT (SELECT count(DISTINCT file_id) FROM files) AS n_files, (SELECT sum(size_bytes)::BIGINT FROM (SELECT DISTINCT file_id, size_bytes FROM files)) AS total_bytes, (SELECT count(DISTINCT chunk_id) FROM chunks) AS n_chunks, (SELECT count(DISTINCT region_id) FROM regions) AS n_regions, (SELECT count(*) FROM (SELECT DISTINCT term, chunk_id FROM chunk_terms)) AS n_pairs")
def table_totals(spark: SparkSession, d: str) -> DataFrame:
    return facts.totals(*(table(spark, d, t) for t in ("files", "chunks", "regions", "chunk_terms")))


@query(f"WITH {_FILES} SELECT repo, path FROM f WHERE provenance = 'source' AND NOT stale")
def fresh_files(spark: SparkSession, d: str) -> DataFrame:
    return facts.clean_files(facts.fresh(table(spark, d, "files"))).select("repo", "path")


# Filters ---------------------------------------------------------------------------------------------------------------------

_SKIP = rf"""CASE WHEN {_IGNORED} THEN 'default_ignored' WHEN {_SENSITIVE} THEN 'sensitive_filename'
  WHEN {_SUFFIX.format(p="path")} IS NULL AND NOT ({_NAME} IN {_in(filters.CONFIG_FILE_NAMES + filters.ENV_TEMPLATES)} OR regexp_matches({_NAME}, '^requirements.*\.txt$') OR regexp_replace({_NAME}, '\.[^.]*$', '') IN {_in(filters.MARKDOWN_STEMS)}) THEN 'unsupported'
  WHEN size_bytes > 8000 THEN 'oversize' WHEN text IS NULL THEN 'unreadable' WHEN length(text) > 0 AND {_CONTROL} / length(text)::DOUBLE > 0.02 THEN 'binary'
  WHEN regexp_matches(text, '{filters.HIGH_CONFIDENCE}') THEN 'likely_secret' END"""


@query(f"WITH {_FILES}, s AS (SELECT {_SKIP} AS reason FROM f) SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n_files FROM s GROUP BY ALL")
def skip_reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    reason = filters.skip_reason(F.col("path"), F.col("size_bytes"), F.col("text"), 8000)
    return _files(spark, d).select(F.coalesce(reason, F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"WITH p AS (SELECT DISTINCT repo, path FROM file_snapshots) SELECT * FROM p WHERE {_IGNORED}")
def default_ignored_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_snapshots").where(filters.default_ignored(F.col("path"))).select("repo", "path").distinct()


@query(f"WITH p AS (SELECT DISTINCT repo, path FROM file_snapshots UNION SELECT DISTINCT '-', path FROM preview_fragments) SELECT * FROM p WHERE {_SENSITIVE}")
def sensitive_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "file_snapshots").select("repo", "path").unionByName(table(spark, d, "preview_fragments").select(F.lit("-").alias("repo"), "path"))
    return p.where(filters.sensitive_path(F.col("path"))).distinct()


@query(f"SELECT doc_id, round({_CONTROL} / length(text)::DOUBLE, 6) AS ratio FROM documents WHERE length(text) > 0 AND {_CONTROL} > 0")
def control_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.round(filters.control_ratio(F.col("text")), 6).alias("ratio"))
    return rows.where("ratio > 0")


@query(f"SELECT DISTINCT fragment_id FROM preview_fragments WHERE regexp_matches(content, '{filters.HIGH_CONFIDENCE}')")
def secret_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "preview_fragments").where(filters.likely_secret(F.col("content"))).select("fragment_id").distinct()


@query(f"SELECT DISTINCT fragment_id, md5(regexp_replace(content, '{filters.TOKEN_FORMS}', '[REDACTED]', 'g')) AS digest FROM preview_fragments WHERE regexp_matches(content, '{filters.TOKEN_FORMS}')")
def secret_redacted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "preview_fragments").where(F.col("content").rlike(filters.TOKEN_FORMS))
    return rows.select("fragment_id", F.md5(filters.redact_tokens(F.col("content"))).alias("digest")).distinct()


@query(f"WITH {_FILES}, p AS (SELECT repo, path, max(size_bytes) AS size_bytes FROM f GROUP BY ALL), s AS (SELECT repo, path, sum(size_bytes) OVER (PARTITION BY repo ORDER BY string_split(path, '/') ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM p) SELECT * FROM s WHERE running <= 20000")
def scan_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    shared_dir(spark)
    rows = _files(spark, d).groupBy("repo", "path").agg(F.max("size_bytes").alias("size_bytes"))
    return windows.running_sum(rows, "repo", [F.split("path", "/")], "size_bytes").where("running <= 20000").select("repo", "path", "running")


@query(f"WITH {_FILES}, i AS (SELECT DISTINCT repo, regexp_replace(path, '/[^/]*$', '') AS dir FROM f WHERE stale) SELECT DISTINCT f.repo, f.path FROM f JOIN i ON i.repo = f.repo AND starts_with(f.path, i.dir || '/')")
def incomplete_prefix_retained(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    partial = f.where("stale").select("repo", F.regexp_replace("path", "/[^/]*$", "").alias("prefix")).distinct()
    above = f.select("repo", "path", F.explode(X.ancestors(F.col("path"))).alias("prefix"))
    return above.join(partial, ["repo", "prefix"], "left_semi").where("path <> prefix").select("repo", "path").distinct()


@query(f"WITH {_FILES} SELECT file_id, depth FROM (SELECT file_id, len(string_split(path, '/')) - 1 AS depth FROM f) WHERE depth > 2")
def deep_paths(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file_id", (F.size(F.split("path", "/")) - 1).cast("long").alias("depth")).where("depth > 2")


# Lines, sections, chunks -----------------------------------------------------------------------------------------------------


@query(f"WITH {_FILES}, {_LINES} SELECT language, count(*) AS n_lines, sum(length(content))::BIGINT AS n_chars FROM l GROUP BY language")
def line_table(spark: SparkSession, d: str) -> DataFrame:
    rows = facts.line_rows(_files(spark, d).where(F.col("text").isNotNull()), "language")
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("content")).alias("n_chars"))


@query(f"WITH {_FILES}, {_LINES}, m AS (SELECT file_id, min(line) AS line FROM l WHERE trim(regexp_replace(content, '[\\t\\r\\f\\x0b]', ' ', 'g')) <> '' GROUP BY file_id) SELECT f.file_id, coalesce(m.line, 1) AS line FROM f LEFT JOIN m USING (file_id) WHERE f.text IS NOT NULL")
def first_nonblank_line(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(F.col("text").isNotNull()).select("file_id", X.first_nonblank_line(F.col("text")).cast("long").alias("line"))


@query(rf"""WITH {_FILES}, {_LINES}, h AS (SELECT file_id, n_lines, line, length(regexp_extract(content, '^(#+)', 1)) AS level, trim(regexp_replace(content, '^#+[ \t]+|[ \t]+#*[ \t]*$', '', 'g')) AS title FROM l WHERE language = 'markdown' AND regexp_matches(content, '^#{{1,6}}[ \t]+[^ \t]'))
SELECT h.file_id, h.title, h.level, h.line AS start_line, coalesce(min(n.line) - 1, h.n_lines) AS end_line FROM h LEFT JOIN h n ON n.file_id = h.file_id AND n.line > h.line AND n.level <= h.level GROUP BY h.file_id, h.title, h.level, h.line, h.n_lines""")
def section_ranges(spark: SparkSession, d: str) -> DataFrame:
    r = facts.section_ranges(_files(spark, d))
    return r.select("file_id", "title", *[F.col(c).cast("long").alias(c) for c in ("level", "start_line", "end_line")])


_KEY = r"""^[ \t]*(?:\[+([^\[\]]+)\]+|["'']?([A-Za-z_][A-Za-z0-9_.-]*)["'']?[ \t]*[:=])"""


@query(rf"WITH {_FILES}, {_LINES}, k AS (SELECT file_id, n_lines, line, regexp_extract(content, '{_KEY}', 1) AS s, regexp_extract(content, '{_KEY}', 2) AS k FROM l WHERE language = 'config') SELECT file_id, CASE WHEN s <> '' THEN s ELSE k END AS name, CASE WHEN s <> '' THEN 'section' ELSE 'key' END AS kind, line AS start_line, coalesce(lead(line) OVER (PARTITION BY file_id ORDER BY line) - 1, n_lines) AS end_line FROM k WHERE s <> '' OR k <> ''")
def config_key_ranges(spark: SparkSession, d: str) -> DataFrame:
    r = facts.config_keys(_files(spark, d))
    return r.select("file_id", "name", "kind", *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")])


@query(f"WITH {_FILES}, {_USABLE}, s AS (SELECT file_id, {_N} AS n FROM f WHERE text IS NOT NULL), x AS (SELECT u.file_id, n, start_line, least(end_line, n) AS end_line FROM u JOIN s USING (file_id) WHERE start_line <= n), y AS (SELECT * FROM x UNION ALL SELECT DISTINCT file_id, n, n + 1, n + 1 FROM x), g AS (SELECT file_id, start_line, coalesce(max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM y) SELECT file_id, (done + 1)::BIGINT AS gap_start, (start_line - 1)::BIGINT AS gap_end FROM g WHERE done + 1 <= start_line - 1")
def chunk_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = facts.gaps(table(spark, d, "regions"), _files(spark, d))
    return g.select("file_id", F.col("gap_start").cast("long").alias("gap_start"), F.col("gap_end").cast("long").alias("gap_end"))


@query(f"WITH {_FILES}, s AS (SELECT file_id, {_N} AS n FROM f WHERE length(text) > 0), o AS (SELECT file_id, n, unnest(range(0, ((n - 1) // 160) + 1)) AS ordinal FROM s) SELECT file_id, ordinal, ordinal * 160 + 1 AS start_line, least(ordinal * 160 + 160, n) AS end_line FROM o")
def fixed_line_chunks(spark: SparkSession, d: str) -> DataFrame:
    g = facts.fixed_chunks(_files(spark, d))
    return g.select("file_id", *[F.col(c).cast("long").alias(c) for c in ("ordinal", "start_line", "end_line")])


@query(f"WITH {_USABLE} SELECT a.file_id, a.region_id AS first_id, b.region_id AS second_id FROM u a JOIN u b ON a.file_id = b.file_id AND a.start_line < b.start_line AND b.start_line <= a.end_line AND a.end_line < b.end_line")
def chunk_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    return facts.crossing_regions(table(spark, d, "regions"))


def _by_language(of: Callable[[str], str]) -> str:
    return "CASE language " + " ".join(f"WHEN '{x}' THEN {of(x)}" for x in facts.STATEMENTS) + " END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_ALL_TARGETS = _by_language(lambda x: f"regexp_extract_all(stm, {_quoted(facts.TARGETS[x])}, 1)" if x in facts.TARGETS else "CASE WHEN origin = '' THEN names WHEN regexp_matches(origin, '^\\.+$') THEN list_transform(names, lambda n: origin || n) ELSE [origin] END")
_DEPS = rf"""mk AS (SELECT repo, path, language, string_split({_by_language(lambda x: rf"regexp_replace(text, {_quoted(facts.STATEMENTS[x])}, chr(1) || '\0' || chr(2), 'g')")}, chr(1)) AS ps FROM f WHERE text IS NOT NULL AND language IN {_in(list(facts.STATEMENTS))}),
 pi AS (SELECT repo, path, language, ps, unnest(range(2, len(ps) + 1)) AS i FROM mk),
 sx AS (SELECT repo, path, language, split_part(ps[i], chr(2), 1) AS stm, 1 + list_sum(list_transform(ps[1:i - 1], lambda x: length(x) - length(replace(x, chr(10), '')))) AS line FROM pi),
 sn AS (SELECT *, regexp_replace(regexp_replace(stm, '#[^\n]*', '', 'g'), '[\s\\()]+', ' ', 'g') AS flat FROM sx),
 so AS (SELECT *, regexp_extract(flat, '^ *from ([.A-Za-z_][A-Za-z0-9_.]*) import', 1) AS origin, list_filter(list_transform(string_split(regexp_replace(flat, '^ *(?:from [^ ]+ )?import', ''), ','), lambda x: regexp_extract(x, '^ *([A-Za-z_*][A-Za-z0-9_.]*)', 1)), lambda x: x <> '') AS names FROM sn),
 dep AS (SELECT repo, path AS source_path, language, line::BIGINT AS line, target FROM (SELECT *, unnest({_ALL_TARGETS}) AS target FROM so) WHERE target <> '')"""


@query(f"WITH {_FILES}, {_DEPS} SELECT * FROM dep")
def dependencies(spark: SparkSession, d: str) -> DataFrame:
    return facts.dependencies(_files(spark, d)).withColumn("line", F.col("line").cast("long"))


@query(rf"""WITH {_FILES} SELECT file_id, path FROM f WHERE coalesce(CASE WHEN language = 'python' THEN regexp_matches(text, '(?m)^if[ \t]+__name__[ \t]*==[ \t]*["'']__main__["'']') OR {_NAME} IN ('__main__.py','main.py','manage.py','app.py','cli.py')
 WHEN language IN ('javascript','typescript') THEN regexp_matches({_NAME}, '^(index|main|server|app|cli)\.(js|mjs|ts|mts)$') WHEN language = 'go' THEN regexp_matches(text, '(?m)^package[ \t]+main[ \t]*$') AND regexp_matches(text, '(?m)^func[ \t]+main\(')
 WHEN language = 'rust' THEN regexp_matches(text, '(?m)^[ \t]*(pub[ \t]+)?(async[ \t]+)?fn[ \t]+main[ \t]*\(') WHEN language = 'java' THEN regexp_matches(text, 'public[ \t]+static[ \t]+void[ \t]+main[ \t]*\(')
 WHEN language IN ('c','cpp') THEN regexp_matches(text, '(?m)^[A-Za-z_][A-Za-z0-9_ \t*]*[ \t]main[ \t]*\(') ELSE false END, false)""")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    return facts.entry_points(_files(spark, d))


# Terms -------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_CHUNKS}, w AS (SELECT unnest({_WORDS.format(c='content')}) AS term FROM c) SELECT term, count(*) AS n FROM w WHERE term NOT IN {_STOP} GROUP BY term")
def word_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).select(F.explode(T.word_terms(F.coalesce("content", F.lit("")))).alias("term"))
    return rows.where(~F.col("term").isin(*T.STOP_WORDS)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CHUNKS}, w AS (SELECT unnest({_SUBS.format(c='content')}) AS term FROM c) SELECT term, count(*) AS n FROM w GROUP BY term")
def sub_terms(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select(F.explode(T.sub_terms(F.coalesce("content", F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_CJK = T.CJK


@query(rf"WITH r AS (SELECT unnest(regexp_extract_all(text, '{_CJK}')) AS run FROM documents), g AS (SELECT unnest(CASE WHEN length(run) = 1 THEN [run] ELSE list_concat(list_transform(range(1, length(run)), lambda i: substring(run, i, 2)), list_transform(range(1, length(run) - 1), lambda i: substring(run, i, 3))) END) AS gram FROM r) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def cjk_bigrams(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.col("text").isNotNull())
    return rows.select(F.explode(T.cjk_grams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


_STEM = "CASE WHEN substring(b, length(b), 1) = substring(b, length(b) - 1, 1) THEN [b, b || 'e', left(b, length(b) - 1)] ELSE [b, b || 'e'] END"


_KIND = "CASE WHEN NOT regexp_matches(term, '^[a-zA-Z0-9]+$') THEN NULL WHEN suffix(term, 'ies') AND length(term) >= 5 THEN 'y' WHEN suffix(term, 'ing') AND length(term) >= 7 THEN 'i' WHEN suffix(term, 'ed') AND length(term) >= 6 THEN 'd' WHEN suffix(term, 's') AND NOT suffix(term, 'ss') AND length(term) >= 5 THEN 's' END"
_CUT = "left(term, length(term) - CASE k WHEN 'y' THEN 3 WHEN 'i' THEN 3 WHEN 'd' THEN 2 ELSE 1 END)"
_FORMS = f"unnest(CASE k WHEN 'y' THEN [b || 'y'] WHEN 's' THEN [b] ELSE {_STEM} END)"


@query(f"WITH {_CHUNKS}, w AS (SELECT DISTINCT unnest({_SUBS.format(c='content')}) AS term FROM c), b AS (SELECT term, {_KIND} AS k FROM w), v AS (SELECT term, k, {_CUT} AS b FROM b WHERE k IS NOT NULL) SELECT term, {_FORMS} AS variant FROM v")
def morph_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).select(F.explode(T.sub_terms(F.coalesce("content", F.lit("")))).alias("term")).distinct()
    return rows.select("term", F.explode(T.morph_variants(F.col("term"))).alias("variant"))


# Retrieval ---------------------------------------------------------------------------------------------------------------------

_WEIGHTED = " UNION ALL ".join(f"SELECT chunk_id, unnest({_TOKENS.format(c=c)}) AS token, {w}::DOUBLE AS w FROM c" for c, w in retrieval.WEIGHTS.items())
_BM25 = f"""{_QS}, tok AS (@SRC@), post AS (SELECT chunk_id, token, sum(w) AS f FROM tok GROUP BY ALL), dl AS (SELECT chunk_id, count(*) AS d FROM tok GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM c) AS n, (SELECT sum(d) FROM dl)::DOUBLE / (SELECT count(*) FROM c) AS avg_d), ask AS (SELECT DISTINCT qid, unnest({_TOKENS.format(c="question")}) AS token FROM q),
df AS (SELECT token, count(*) AS n_p FROM post GROUP BY token), idf AS (SELECT token, CASE WHEN ln((n - n_p + 0.5e0) / (n_p + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((n - n_p + 0.5e0) / (n_p + 0.5e0)) END AS idf FROM df, st),
bm AS (SELECT qid, chunk_id, round(sum(idf * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * d / avg_d))), 6) AS score FROM ask JOIN idf USING (token) JOIN post USING (token) JOIN dl USING (chunk_id) JOIN (SELECT chunk_id FROM cf) USING (chunk_id), st GROUP BY ALL)"""
_BM_W, _BM_1 = _BM25.replace("@SRC@", _WEIGHTED), _BM25.replace("@SRC@", f"SELECT chunk_id, unnest({_TOKENS.format(c='content')}) AS token, 1e0 AS w FROM c")
_TOP5 = "SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 5"


@query(f"WITH {_CHUNKS}, {_BM_1} {_TOP5}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return retrieval.bm25_top(retrieval.questions(c), c, 5, {"content": 1.0}, _live(spark, d, c))


@query(f"WITH {_CHUNKS}, {_BM_W} {_TOP5}")
def weighted_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return retrieval.bm25_top(retrieval.questions(c), c, 5, fresh=_live(spark, d, c))


@query(f"WITH {_CHUNKS}, tok AS ({_WEIGHTED}), dl AS (SELECT chunk_id, count(*) AS d FROM tok GROUP BY ALL) SELECT (SELECT count(*) FROM c) AS n, round((SELECT sum(d) FROM dl)::DOUBLE / (SELECT count(*) FROM c), 6) AS avg_d")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.corpus_stats(_chunks(spark, d)).select("n", F.round("avg_d", 6).alias("avg_d"))


_GRAMS = "flatten(list_transform(regexp_extract_all(lower(coalesce({c}, '')), '" + _CJK.replace("{", "{{").replace("}", "}}") + "'), lambda run: CASE WHEN length(run) = 1 THEN [run] ELSE list_concat(list_transform(range(1, length(run)), lambda i: substring(run, i, 2)), list_transform(range(1, length(run) - 1), lambda i: substring(run, i, 3))) END))"
_SAID = f"list_concat(list_concat({_WORDS}, {_SUBS}), {_GRAMS})"
_TERMS = "ct AS (SELECT DISTINCT chunk_id, term FROM (" + " UNION ALL ".join(f"SELECT chunk_id, unnest({_SAID.format(c=c)}) AS term FROM cf" for c in ("file_path", "symbol", "content")) + f") WHERE term NOT IN {_STOP})"
_ASK = f"said AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({_SAID.format(c='question')}) AS term FROM q) WHERE term NOT IN {_STOP}), kinds AS (SELECT qid, term, {_KIND} AS k FROM said), more AS (SELECT DISTINCT qid, term FROM (SELECT qid, {_FORMS} AS term FROM (SELECT qid, k, {_CUT} AS b FROM kinds WHERE k IS NOT NULL)) WHERE term NOT IN {_STOP} EXCEPT SELECT * FROM said), qt AS (SELECT * FROM said UNION ALL SELECT * FROM more)"
_MATCH = "tm AS (SELECT qid, chunk_id, count(*) AS matches FROM qt JOIN ct USING (term) GROUP BY ALL)"
_COVER = f"ws AS (SELECT qid, question, list_filter({_WORDS.format(c='question')}, lambda x: x NOT IN {_STOP}) AS w FROM q), gr AS (SELECT DISTINCT qid, unnest(CASE WHEN NOT regexp_matches(trim(question), '\\s') AND (contains(question, '_') OR regexp_matches(question, '[a-z0-9][A-Z]')) THEN w[1:1] ELSE w END) AS grp FROM ws), lit AS (SELECT DISTINCT qid, grp, unnest(CASE WHEN regexp_matches(grp, '{_CJK}') THEN {_GRAMS.format(c='grp')} ELSE [grp] END) AS term FROM gr), need AS (SELECT qid, least(2, count(DISTINCT grp)) AS need FROM lit GROUP BY qid), cov AS (SELECT qid, chunk_id FROM lit JOIN ct USING (term) JOIN need USING (qid) GROUP BY qid, chunk_id, need HAVING count(DISTINCT grp) >= need)"
_LEX = "mg AS (SELECT qid, chunk_id, max(s) AS strength FROM (SELECT qid, chunk_id, score AS s FROM bm UNION ALL SELECT qid, chunk_id, matches::DOUBLE FROM tm) GROUP BY ALL), lex AS (SELECT * FROM (SELECT qid, chunk_id, strength, row_number() OVER (PARTITION BY qid ORDER BY strength DESC, file_path, start_line, chunk_id) AS position FROM mg JOIN cov USING (qid, chunk_id) JOIN cf USING (chunk_id)) WHERE position <= 64)"


@query(f"WITH {_CHUNKS}, {_QS}, {_TERMS}, {_ASK}, {_MATCH} SELECT qid, chunk_id, matches, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY matches DESC, chunk_id) AS rank FROM tm) WHERE rank <= 5")
def term_postings_topk(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return retrieval.term_top(retrieval.questions(c), retrieval.chunk_terms(c.join(_live(spark, d, c), "chunk_id", "left_semi")), 5, c.select("chunk_id").count())


@query(f"WITH {_CHUNKS}, {_QS}, {_TERMS}, {_COVER} SELECT * FROM cov")
def literal_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return retrieval.covered(retrieval.questions(c), retrieval.chunk_terms(c.join(_live(spark, d, c), "chunk_id", "left_semi")))


@query(f"WITH {_CHUNKS}, {_BM_W}, {_TERMS}, {_ASK}, {_MATCH}, {_COVER}, {_LEX} SELECT * FROM lex")
def lexical_merge(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return retrieval.lexical(retrieval.questions(c), c, fresh=_live(spark, d, c))


_SYM = f"{_USABLE}, sy AS (SELECT region_id AS symbol_id, u.repo, file_path AS path, symbol AS name, start_line, end_line FROM u JOIN ff ON ff.repo = u.repo AND ff.path = u.file_path WHERE symbol IS NOT NULL)"
_SM = """eq AS (SELECT qid, lower(trim(question)) AS name, 0 AS priority FROM q UNION SELECT qid, term, 0 FROM said UNION SELECT qid, term, 1 FROM more),
pt AS (SELECT qid, term AS p, 2 AS priority FROM more WHERE length(term) >= 4 UNION SELECT qid, term, 3 FROM said WHERE length(term) >= 4 UNION SELECT qid, lower(trim(question)), 3 FROM q),
smb AS (SELECT qid, symbol_id, min(priority)::BIGINT AS priority FROM (SELECT qid, symbol_id, priority FROM eq JOIN sy ON lower(sy.name) = eq.name UNION ALL SELECT qid, symbol_id, priority FROM pt JOIN sy ON contains(lower(sy.name), p)) GROUP BY ALL),
sm AS (SELECT qid, symbol_id, priority FROM (SELECT qid, symbol_id, priority, row_number() OVER (PARTITION BY qid ORDER BY priority, lower(name), path, start_line, symbol_id) AS k FROM smb JOIN sy USING (symbol_id)) WHERE k <= 64)"""
_SC = "sc AS (SELECT symbol_id, chunk_id, pref::BIGINT AS pref FROM (SELECT symbol_id, chunk_id, CASE WHEN c.symbol = sy.name THEN 0 WHEN c.start_line <= sy.start_line AND c.end_line >= sy.start_line THEN 1 ELSE 2 END AS pref, row_number() OVER (PARTITION BY symbol_id ORDER BY CASE WHEN c.symbol = sy.name THEN 0 WHEN c.start_line <= sy.start_line AND c.end_line >= sy.start_line THEN 1 ELSE 2 END, c.start_line, c.ordinal, chunk_id) AS k FROM sy JOIN cf c ON c.repo = sy.repo AND c.file_path = sy.path) WHERE k = 1)"


@query(f"WITH {_CHUNKS}, {_QS}, {_ASK}, {_SYM}, {_SM} SELECT qid, symbol_id, priority, CASE WHEN priority = 0 THEN 'exact' WHEN priority < 3 THEN 'expanded' ELSE 'partial' END AS match FROM sm")
def symbol_match(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.symbol_matches(retrieval.questions(_chunks(spark, d)), _symbols(spark, d))


@query(f"WITH {_CHUNKS}, {_SYM}, {_SC} SELECT * FROM sc")
def symbol_to_chunk(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return retrieval.symbol_chunks(_symbols(spark, d), c.join(_live(spark, d, c), "chunk_id", "left_semi"))


_TAIL = "list_transform(range(1, len(string_split({p}, '/')) + 1), lambda i: array_to_string(string_split({p}, '/')[i:], '.'))"
_BARE, _PKG = r"regexp_replace(lower(path), '\.[^./]*$', '')", r"regexp_replace(regexp_replace(lower(path), '\.[^./]*$', ''), '/__init__$', '')"
_ALIAS = rf"al AS (SELECT DISTINCT repo, alias, path FROM (SELECT repo, path, unnest(list_concat([lower(path), {_NAME}, {_BARE}, regexp_extract({_BARE}, '[^/]*$')], list_concat({_TAIL.format(p=_BARE)}, {_TAIL.format(p=_PKG)}))) AS alias FROM f))"
_FOLD = "ltrim(list_reduce(list_prepend('', list_filter({x}, lambda p: p <> '' AND p <> '.')), lambda acc, p: CASE WHEN p = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || p END), '/')"
_NEAR, _ABOVE = _FOLD.format(x="list_concat(dir, string_split(t, '/'))"), _FOLD.format(x="list_concat(dir[1:greatest(len(dir) - length(regexp_extract(t, '^(\\.*)', 1)) + 1, 0)], string_split(regexp_replace(t, '^\\.+', ''), '.'))")
_EDGES = rf"""{_ALIAS}, lo AS (SELECT DISTINCT repo, source_path, line, target, lower(replace(regexp_replace(trim(target), '^["'']+|["'']+$', '', 'g'), '\', '/')) AS t, string_split(lower(source_path), '/')[1:-2] AS dir FROM dep),
bs AS (SELECT repo, source_path, line, target, unnest([CASE WHEN regexp_matches(t, '^\.\.?/') THEN {_NEAR} END, CASE WHEN starts_with(t, '.') AND NOT regexp_matches(t, '^\.\.?/') THEN {_ABOVE} END,
 CASE WHEN NOT starts_with(t, '.') THEN t END, CASE WHEN regexp_matches(t, '^(crate|self|super)::') THEN replace(regexp_replace(t, '^((crate|self|super)::)+', ''), '::', '.') END]) AS b FROM lo),
want AS (SELECT DISTINCT repo, source_path, line, target, unnest([b, regexp_replace(b, '::|/', '.', 'g'), CASE WHEN contains(b, '/') THEN b ELSE regexp_replace(b, '\.|::', '/', 'g') END, regexp_replace(b, '\.py$', '')]) AS alias FROM bs WHERE b <> ''),
edl AS (SELECT DISTINCT want.repo, source_path, line, target, al.path AS target_path FROM want JOIN al ON al.repo = want.repo AND al.alias = want.alias WHERE source_path <> al.path), ed AS (SELECT DISTINCT repo, source_path, target_path FROM edl)"""


@query(f"WITH {_FILES}, {_ALIAS} SELECT * FROM al")
def path_aliases(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.aliases(_files(spark, d)).distinct()


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between fresh files."""
    f = facts.fresh(_files(spark, d))
    return retrieval.resolved_edges(facts.dependencies(f), f)


@query(f"WITH {_FRESH_FILES}, {_DEPS}, {_EDGES} SELECT * FROM ed")
def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(f"WITH {_FRESH_FILES}, {_DEPS}, {_EDGES} SELECT repo, target_path AS path, count(*) AS n_dependents FROM ed GROUP BY ALL")
def reverse_dependents(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("repo", F.col("target_path").alias("path")).agg(F.count(F.lit(1)).alias("n_dependents"))


_NB = """nb AS (SELECT qid, repo, path, min(struct_pack(direction := direction, seed_path := seed_path)) AS m FROM (
 SELECT qid, ed.repo, target_path AS path, seed_path, 'dependency of' AS direction FROM seed JOIN ed ON ed.repo = seed.repo AND ed.source_path = seed.seed_path
 UNION ALL SELECT qid, ed.repo, source_path, seed_path, 'dependent of' FROM seed JOIN ed ON ed.repo = seed.repo AND ed.target_path = seed.seed_path) x
 WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.qid = x.qid AND s.repo = x.repo AND s.seed_path = x.path) GROUP BY ALL)"""


@query(f"WITH {_CHUNKS}, {_FRESH_FILES}, {_DEPS}, {_EDGES}, seed AS (SELECT chunk_id AS qid, repo, file_path AS seed_path FROM c WHERE chunk_id % 20 = 0), {_NB} SELECT qid, repo, path, m.seed_path AS seed_path, m.direction AS direction FROM nb")
def dependency_neighbors(spark: SparkSession, d: str) -> DataFrame:
    seeds = _chunks(spark, d).where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), "repo", F.col("file_path").alias("seed_path"))
    return retrieval.neighbours(seeds, _edges(spark, d))


_HYBRID = f"""{_BM_W}, {_TERMS}, {_ASK}, {_MATCH}, {_COVER}, {_LEX}, {_SYM}, {_SM}, {_SC}, {_FRESH_FILES}, {_DEPS}, {_EDGES},
a AS (SELECT qid, chunk_id, 8 * greatest(strength, 0e0) / greatest(max(strength) OVER (PARTITION BY qid), 1e-12) + 2e0 / position AS score, 'full-text match' AS reason FROM lex),
b AS (SELECT qid, chunk_id, CASE WHEN m.priority = 0 THEN 24e0 WHEN m.priority < 3 THEN 10e0 ELSE 12e0 END AS score, CASE WHEN m.priority = 0 THEN 'exact symbol match: ' WHEN m.priority < 3 THEN 'query-expansion symbol match: ' ELSE 'partial symbol match: ' END || m.name AS reason FROM (SELECT qid, chunk_id, min(struct_pack(priority := priority, name := name)) AS m FROM sm JOIN sc USING (symbol_id) JOIN sy USING (symbol_id) GROUP BY ALL)),
dir AS (SELECT * FROM a UNION ALL SELECT * FROM b), bp AS (SELECT qid, repo, file_path AS path, round(max(score), 6) AS score FROM (SELECT qid, chunk_id, sum(score) AS score FROM dir GROUP BY ALL) JOIN cf USING (chunk_id) GROUP BY ALL),
seed AS (SELECT qid, repo, path AS seed_path, score AS seed_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path, repo) AS k FROM bp) WHERE k <= 8), {_NB},
fc AS (SELECT repo, file_path AS path, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY ordinal, start_line, chunk_id) AS k FROM cf) WHERE k = 1),
n1 AS (SELECT qid, repo, path, m, chunk_id FROM (SELECT nb.*, fc.chunk_id, row_number() OVER (PARTITION BY nb.qid ORDER BY nb.path, nb.repo) AS k FROM nb JOIN fc ON fc.repo = nb.repo AND fc.path = nb.path) WHERE k <= 64),
n2 AS (SELECT nb.qid, nb.chunk_id, greatest(1e0, 0.25e0 * seed_score) AS score, m.direction || ' ' || m.seed_path AS reason FROM n1 nb JOIN seed ON seed.qid = nb.qid AND seed.repo = nb.repo AND seed.seed_path = m.seed_path),
al2 AS (SELECT qid, chunk_id, round(sum(score), 6) AS score, array_to_string(list_sort(list_distinct(list(reason))), '; ') AS reason FROM (SELECT * FROM dir UNION ALL SELECT * FROM n2) GROUP BY ALL),
hy AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_path, start_line, chunk_id) AS rank, chunk_id, file_path AS path, start_line, end_line, score, reason FROM al2 JOIN cf USING (chunk_id)) WHERE rank <= 8)"""


def _hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    shared_dir(spark)
    c, f = _chunks(spark, d), facts.fresh(_files(spark, d))
    qs = retrieval.questions(c)
    return retrieval.hybrid(qs, c, f, _symbols(spark, d), facts.dependencies(f), fresh=_live(spark, d, c)), qs


@query(f"WITH {_CHUNKS}, {_HYBRID} SELECT * FROM hy")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)[0]


@query(f"WITH {_CHUNKS}, {_HYBRID} SELECT qid, CASE WHEN contains(reason, 'exact symbol match') THEN 'confirmed' ELSE 'inferred' END AS confidence FROM hy WHERE rank = 1")
def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)[0].where("rank = 1").select("qid", F.when(F.contains("reason", F.lit("exact symbol match")), "confirmed").otherwise("inferred").alias("confidence"))


# Evaluation --------------------------------------------------------------------------------------------------------------------

_RES = "(SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM bm)"
_RM = f"rt AS (SELECT qid, min(rank) AS r FROM {_RES} WHERE rank <= 5 AND chunk_id = qid GROUP BY qid), rm AS (SELECT q.qid, q_language, (r IS NOT NULL)::BIGINT AS hit, round(coalesce(1e0 / r, 0e0), 6) AS mrr, round(coalesce(1e0 / log2(r + 1), 0e0), 6) AS ndcg FROM q LEFT JOIN rt USING (qid))"


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _chunks(spark, d)
    qs = retrieval.questions(c)
    return retrieval.bm25_top(qs, c, 5, fresh=_live(spark, d, c)), qs


@query(f"WITH {_CHUNKS}, {_BM_W}, {_RM} SELECT * FROM rm")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return graph.retrieval_metrics(*_ranked(spark, d))


@query(f"WITH {_CHUNKS}, {_BM_W}, {_RM} SELECT CASE WHEN grouping(q_language) = 1 THEN '*' ELSE coalesce(q_language, '?') END AS bucket, count(*) AS n_questions, round(avg(hit), 6) AS hit_rate, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM rm GROUP BY GROUPING SETS ((q_language), ())")
def metrics_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return graph.metric_buckets(graph.retrieval_metrics(*_ranked(spark, d)))


@query(f"WITH {_CHUNKS}, {_QS}, {_TERMS}, {_COVER}, x AS (SELECT q.qid, EXISTS (SELECT 1 FROM cov WHERE cov.qid = q.qid AND cov.chunk_id <> q.qid) AS answered, EXISTS (SELECT 1 FROM c c2 WHERE c2.chunk_id <> q.qid AND c2.symbol = q.question) AS answerable FROM q), s AS (SELECT sum((NOT answered AND NOT answerable)::INT) AS tp, sum((NOT answered AND answerable)::INT) AS fp, sum((answered AND NOT answerable)::INT) AS fn, sum((answered AND answerable)::INT) AS tn FROM x) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM s")
def no_answer_confusion(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    qs = retrieval.questions(c)
    got = retrieval.covered(qs, retrieval.chunk_terms(c.join(_live(spark, d, c), "chunk_id", "left_semi"))).where("chunk_id <> qid").select("qid").distinct().withColumn("answered", F.lit(True))
    same = c.groupBy(F.col("symbol").alias("question")).agg(F.count(F.lit(1)).alias("n"))
    rows = qs.join(got, "qid", "left").join(same, "question", "left")
    return rows.agg(*graph.confusion(F.coalesce("answered", F.lit(False)), F.coalesce(F.col("n") > 1, F.lit(False))))


@query(f"WITH {_CHUNKS}, {_USABLE} SELECT c.chunk_id, count(*) AS n_contained FROM c JOIN u ON u.repo = c.repo AND u.file_path = c.file_path AND c.start_line <= u.start_line AND u.end_line <= c.end_line GROUP BY c.chunk_id")
def citation_containment(spark: SparkSession, d: str) -> DataFrame:
    u = facts.clean_regions(table(spark, d, "regions")).select("repo", "file_path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    return _chunks(spark, d).join(u, ["repo", "file_path"]).where("start_line <= s AND e <= end_line").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_contained"))


@query(f"WITH {_CHUNKS}, {_FILES}, {_BM_W} SELECT qid, chunk_id FROM {_RES} JOIN c USING (chunk_id) WHERE rank <= 5 AND NOT EXISTS (SELECT 1 FROM f WHERE f.repo = c.repo AND f.path = c.file_path AND f.provenance = 'source' AND NOT f.stale)")
def forbidden_hits(spark: SparkSession, d: str) -> DataFrame:
    good = facts.clean_files(facts.fresh(table(spark, d, "files"))).select("repo", F.col("path").alias("file_path"))
    hits = _ranked(spark, d)[0].join(_chunks(spark, d).select("chunk_id", "repo", "file_path"), "chunk_id")
    return hits.join(good, ["repo", "file_path"], "left_anti").select("qid", "chunk_id")


# Graph and reports ---------------------------------------------------------------------------------------------------------------

_PARTS = "string_split({p}, '/')"
_FIRST = "(CASE WHEN {s}[1] IN ('src', 'lib') AND len({s}) > 1 THEN {s}[2:len({s}) - 1] ELSE {s}[1:len({s}) - 1] END)"


def _mod(p: str) -> str:
    first = _FIRST.format(s=_PARTS.format(p=p))
    return rf"CASE WHEN len({first}) = 0 THEN regexp_replace(regexp_extract({p}, '[^/]*$'), '\.[^.]*$', '') ELSE array_to_string({first}[1:2], '.') END"


@query(f"WITH {_FILES}, g AS (SELECT repo, {_mod('path')} AS label, count(*) AS n_files, min(path) AS witness FROM f GROUP BY ALL) SELECT repo, label, 'n_' || left(sha1(label), 10) AS node_id, n_files, witness FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n_files DESC, label) AS k FROM g) WHERE k <= 20")
def module_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.module_nodes(_files(spark, d))


_TARGETS_OF = rf"""nm AS (SELECT repo, name, min(path) AS target_path FROM (SELECT repo, path, replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(path), '\.[^./]*$', ''), '^(src|lib)/', ''), '/?__init__$', ''), '-', '_'), '/', '.') AS name FROM f WHERE language IN {_in(list(retrieval.MODULES))}) WHERE name <> '' GROUP BY ALL),
tp AS (SELECT repo, source_path, line, target, string_split(regexp_replace(replace(regexp_replace(lower(trim(target)), '^[./]+', ''), '-', '_'), '/|::', '.', 'g'), '.') AS ps FROM dep),
px AS (SELECT *, array_to_string(ps[1:size], '.') AS name FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS size FROM tp)),
mt AS (SELECT repo, source_path, line, target, target_path FROM (SELECT px.*, target_path, row_number() OVER (PARTITION BY px.repo, source_path, line, target ORDER BY size DESC) AS k FROM px JOIN nm ON nm.repo = px.repo AND nm.name = px.name) WHERE k = 1 AND source_path <> target_path)"""


@query(f"WITH {_FRESH_FILES}, {_DEPS}, {_TARGETS_OF} SELECT * FROM mt")
def module_targets(spark: SparkSession, d: str) -> DataFrame:
    f = facts.fresh(_files(spark, d))
    return retrieval.module_targets(facts.dependencies(f), f)


@query(f"WITH {_FRESH_FILES}, {_DEPS}, {_EDGES}, {_TARGETS_OF}, g AS (SELECT repo, {_mod('source_path')} AS source, {_mod('target_path')} AS target, count(*) AS n_edges, min(struct_pack(source_path := source_path, line := line, target := target)) AS w FROM (SELECT * FROM mt UNION SELECT * FROM edl) GROUP BY ALL) SELECT repo, source, target, n_edges, w.source_path AS witness, w.line AS line, w.target AS import_target FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n_edges DESC, source, target) AS k FROM g WHERE source <> target) WHERE k <= 40")
def module_edges(spark: SparkSession, d: str) -> DataFrame:
    f = facts.fresh(_files(spark, d))
    return graph.module_edges(retrieval.import_edges(facts.dependencies(f), f))


@query(f"WITH {_FILES}, a AS (SELECT repo, {_GROUP.format(p='path')} AS area, language, path FROM f), l AS (SELECT repo, area, language, row_number() OVER (PARTITION BY repo, area ORDER BY count(*) DESC, min(path), language) AS k FROM a WHERE language IS NOT NULL GROUP BY repo, area, language), n AS (SELECT repo, area, string_agg(language, ', ' ORDER BY k) AS languages FROM l WHERE k <= 3 GROUP BY ALL) SELECT a.repo, a.area, count(*) AS n_files, min(path) AS witness, coalesce(languages, '') AS languages FROM a LEFT JOIN n ON n.repo = a.repo AND n.area = a.area GROUP BY ALL")
def layout_table(spark: SparkSession, d: str) -> DataFrame:
    return graph.layout(_files(spark, d))


@query(f"WITH {_FILES}, {_REGIONS}, s AS (SELECT file_id, count(*) AS n FROM r WHERE symbol IS NOT NULL GROUP BY file_id), a AS (SELECT repo, {_GROUP.format(p='path')} AS area, path, coalesce(n, 0) AS n FROM f LEFT JOIN s USING (file_id)), g AS (SELECT repo, area, count(*) AS n_files, sum(n)::BIGINT AS n_symbols, min(struct_pack(a := -n, b := length(path), path := path)).path AS witness FROM a GROUP BY ALL) SELECT repo, area, n_files, n_symbols, witness FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n_files DESC, area) AS k FROM g) WHERE k <= 12")
def core_modules(spark: SparkSession, d: str) -> DataFrame:
    return graph.core_modules(_files(spark, d), table(spark, d, "regions"))


_STDLIB = sorted(x.lower() for x in sys.stdlib_module_names)


@query(rf"WITH {_FILES}, {_DEPS}, own AS (SELECT DISTINCT repo, lower(CASE WHEN {_PARTS.format(p='path')}[1] IN ('src', 'lib') AND len({_PARTS.format(p='path')}) > 1 THEN {_PARTS.format(p='path')}[2] ELSE regexp_replace({_PARTS.format(p='path')}[1], '(.)\.[^.]*$', '\1') END) AS root FROM f), x AS (SELECT repo, source_path, line, target, lower(regexp_extract(target, '^([^./]*)', 1)) AS root FROM dep), g AS (SELECT repo, target, count(*) AS n_refs, min(struct_pack(p := source_path, l := line)) AS w FROM x WHERE root <> '' AND root NOT IN {_in(_STDLIB)} AND NOT EXISTS (SELECT 1 FROM own WHERE own.repo = x.repo AND own.root = x.root) GROUP BY ALL) SELECT repo, target, n_refs, w.p || ':' || w.l AS witness FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n_refs DESC, target) AS k FROM g) WHERE k <= 20")
def external_dependencies(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return graph.external_dependencies(facts.dependencies(f), f, _STDLIB)


@query(f"WITH {_FILES} SELECT repo, path, line_count, rank FROM (SELECT repo, path, line_count, row_number() OVER (PARTITION BY repo ORDER BY line_count DESC, path) AS rank FROM f WHERE line_count IS NOT NULL) WHERE rank <= 5")
def largest_files(spark: SparkSession, d: str) -> DataFrame:
    return windows.top_k(_files(spark, d).where("line_count IS NOT NULL"), ["repo"], [F.desc("line_count"), F.col("path")], 5).select("repo", "path", "line_count", "rank")


_LOW = "lower(path)"
_TEST = rf"(len(list_filter(string_split({_LOW}, '/')[1:len(string_split({_LOW}, '/')) - 1], lambda p: p IN ('test','tests','spec','specs','__tests__'))) > 0 OR starts_with({_NAME}, 'test_') OR regexp_matches({_NAME}, '(_test\.py|\.(test|spec)\.(ts|js))$'))"
_CONF = rf"({_NAME} IN {_in(X.CONFIG_NAMES)} OR regexp_matches({_NAME}, '\.(yaml|yml|toml)$'))"


@query(f"WITH {_FILES}, {_REGIONS}, s AS (SELECT file_id, count(*) AS n FROM r WHERE symbol IS NOT NULL GROUP BY file_id), x AS (SELECT f.file_id, repo, path, coalesce(n, 0) AS n, CASE WHEN starts_with({_NAME}, 'readme') THEN 0 WHEN {_NAME} IN {_in(X.CONFIG_NAMES)} THEN 1 WHEN coalesce(is_entry_point, false) THEN 2 WHEN NOT {_TEST} AND NOT {_CONF} THEN 3 END AS step FROM f LEFT JOIN s USING (file_id)) SELECT repo, rank, path, step::BIGINT AS step FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY step, CASE WHEN step = 3 THEN -n ELSE 0 END, path, file_id) AS rank FROM x WHERE step IS NOT NULL) WHERE rank <= 12")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return graph.reading_order(_files(spark, d), table(spark, d, "regions"))


@query(f"WITH {_FILES} SELECT repo, {_GROUP.format(p='path')} AS area, count(*) AS n_tests, min(path) AS witness FROM f WHERE {_TEST} GROUP BY ALL")
def test_files_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = _files(spark, d).where(X.is_test(F.col("path"))).select("repo", X.top_group(F.col("path")).alias("area"), "path")
    return rows.groupBy("repo", "area").agg(F.count(F.lit(1)).alias("n_tests"), F.min("path").alias("witness"))


@query(f"WITH {_FILES} SELECT repo, path FROM f WHERE {_CONF}")
def config_files(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(X.is_config(F.col("path"))).select("repo", "path")


@query(f"WITH {_FILES}, {_DEPS}, e AS (SELECT repo, path FROM f WHERE is_entry_point), x AS (SELECT e.repo, e.path, line, target, row_number() OVER (PARTITION BY e.repo, e.path ORDER BY line, target) AS k FROM e JOIN dep ON dep.repo = e.repo AND dep.source_path = e.path) SELECT repo, path, string_agg(target, ', ' ORDER BY k) AS targets FROM x WHERE k <= 4 GROUP BY ALL")
def runtime_flow(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    e = f.where("is_entry_point").select("repo", F.col("path").alias("source_path"))
    x = windows.top_k(facts.dependencies(f).join(e, ["repo", "source_path"]), ["repo", "source_path"], [F.col("line"), F.col("target")], 4)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda s: s["target"]), ", ")
    return x.groupBy("repo", F.col("source_path").alias("path")).agg(names.alias("targets"))


# Versions ------------------------------------------------------------------------------------------------------------------------

_LATEST = "p AS (SELECT repo, snapshot_no, path, lower(sha256) AS sha, size_bytes FROM file_snapshots WHERE sha256 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, snapshot_no, path ORDER BY delivered_at DESC, lower(sha256) DESC, size_bytes DESC) = 1)"


def _states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_snapshots").where("sha256 IS NOT NULL").withColumn("sha", F.lower("sha256"))
    return snapshots.latest(rows, ["repo", "snapshot_no", "path"], "delivered_at", ["sha", "size_bytes"])


@query(f"WITH {_LATEST}, s AS (SELECT repo, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS prev FROM snapshots), j AS (SELECT s.repo, s.snapshot_no, CASE WHEN b.path IS NULL THEN 'added' WHEN a.sha <> b.sha THEN 'changed' ELSE 'unchanged' END AS status FROM s JOIN p a ON a.repo = s.repo AND a.snapshot_no = s.snapshot_no LEFT JOIN p b ON b.repo = s.repo AND b.snapshot_no = s.prev AND b.path = a.path WHERE s.prev IS NOT NULL UNION ALL SELECT s.repo, s.snapshot_no, 'removed' FROM s JOIN p b ON b.repo = s.repo AND b.snapshot_no = s.prev WHERE NOT EXISTS (SELECT 1 FROM p a WHERE a.repo = s.repo AND a.snapshot_no = s.snapshot_no AND a.path = b.path)) SELECT repo, snapshot_no, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'removed') AS removed FROM j WHERE status <> 'unchanged' GROUP BY ALL")
def update_counters(spark: SparkSession, d: str) -> DataFrame:
    diff = snapshots.diff_consecutive(_states(spark, d), table(spark, d, "snapshots"), "repo", "snapshot_no", "path", F.col("sha"), F.lit("-"))
    return diff.groupBy("repo", "snapshot_no").agg(*[F.count(F.when(F.col("change") == x, 1)).alias(x) for x in ("added", "changed", "removed")])


@query(f"WITH {_LATEST}, s AS (SELECT repo, max(snapshot_no) AS last FROM snapshots GROUP BY repo), l AS (SELECT p.* FROM p JOIN s ON s.repo = p.repo AND s.last = p.snapshot_no), {_FILES}, k AS (SELECT repo, path, max(sha256) AS sha FROM f GROUP BY ALL) SELECT coalesce(l.repo, k.repo) AS repo, count(*) AS n_paths, count(*) FILTER (l.sha = lower(k.sha)) AS n_hits, bool_and(coalesce(l.sha = lower(k.sha), false)) AS cache_hit FROM l FULL OUTER JOIN k ON k.repo = l.repo AND k.path = l.path GROUP BY ALL")
def cache_hit_check(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "snapshots").groupBy("repo").agg(F.max("snapshot_no").alias("snapshot_no"))
    a = _states(spark, d).join(last, ["repo", "snapshot_no"]).select("repo", "path", "sha")
    b = _files(spark, d).groupBy("repo", "path").agg(F.max("sha256").alias("now"))
    same = F.coalesce(F.col("sha") == F.lower("now"), F.lit(False))
    j = a.join(b, ["repo", "path"], "full_outer")
    return j.groupBy("repo").agg(F.count(F.lit(1)).alias("n_paths"), F.count(F.when(same, 1)).alias("n_hits"), F.bool_and(same).alias("cache_hit"))


@query(f"WITH {_FILES}, h AS (SELECT DISTINCT repo, sha256(path || '|' || lower(sha256)) AS h FROM f), k AS (SELECT repo, left(h, 3) AS k, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL) SELECT repo, sha256(string_agg(k || d, '' ORDER BY k)) AS digest FROM k GROUP BY repo")
def scan_digest(spark: SparkSession, d: str) -> DataFrame:
    return facts.scan_digest(_files(spark, d))


@query(f"WITH {_FILES}, {_USABLE}, x AS (SELECT DISTINCT file_id, start_line::INT || ':' || end_line::INT || ':' || coalesce(symbol, '') AS item FROM u), g AS (SELECT file_id, string_agg(item, ',' ORDER BY item) AS facts FROM x GROUP BY ALL) SELECT f.file_id, sha256(path || '|' || lower(sha256) || '|' || coalesce(facts, '')) AS digest FROM f LEFT JOIN g USING (file_id)")
def fact_digest(spark: SparkSession, d: str) -> DataFrame:
    return facts.fact_digest(_files(spark, d), table(spark, d, "regions"))


# Answers, previews -----------------------------------------------------------------------------------------------------------------


@query("WITH p AS (SELECT DISTINCT * FROM preview_fragments), t AS (SELECT preview_id, fragment_id, length(coalesce(content, '')) + length(path) + 40 AS cost FROM p), s AS (SELECT preview_id, fragment_id, sum(cost) OVER (PARTITION BY preview_id ORDER BY fragment_id)::BIGINT AS running FROM t) SELECT * FROM s WHERE running <= 2000")
def evidence_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    shared_dir(spark)
    rows = table(spark, d, "preview_fragments").dropDuplicates(["fragment_id"]).withColumn("cost", F.length(F.coalesce("content", F.lit(""))) + F.length("path") + 40)
    return windows.running_sum(rows.select("preview_id", "fragment_id", "cost"), "preview_id", [F.col("fragment_id")], "cost").where("running <= 2000").select("preview_id", "fragment_id", "running")


@query("WITH p AS (SELECT DISTINCT * FROM preview_fragments) SELECT preview_id, greatest(1, ceil(sum(length(coalesce(content, '')) + length(path) + 40) / 4e0))::BIGINT AS tokens FROM p GROUP BY preview_id")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "preview_fragments").dropDuplicates(["fragment_id"])
    cost = F.sum(F.length(F.coalesce("content", F.lit(""))) + F.length("path") + 40)
    return rows.groupBy("preview_id").agg(F.greatest(F.lit(1), F.ceil(cost / 4)).cast("long").alias("tokens"))


@query("WITH p AS (SELECT DISTINCT * FROM preview_fragments), s AS (SELECT DISTINCT * FROM send_previews) SELECT s.provider, count(DISTINCT s.preview_id) AS n_previews, count(p.fragment_id) AS n_fragments, count(DISTINCT p.path) AS n_paths, coalesce(sum(strlen(p.content)), 0)::BIGINT AS n_bytes FROM s LEFT JOIN p USING (preview_id) GROUP BY s.provider")
def preview_totals(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "preview_fragments").dropDuplicates(["fragment_id"]).select("preview_id", "fragment_id", "path", F.octet_length("content").alias("b"))
    s = table(spark, d, "send_previews").dropDuplicates(["preview_id"]).select("preview_id", "provider")
    return s.join(p, "preview_id", "left").groupBy("provider").agg(F.count_distinct("preview_id").alias("n_previews"), F.count("fragment_id").alias("n_fragments"), F.count_distinct("path").alias("n_paths"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes"))


@query("WITH p AS (SELECT DISTINCT * FROM preview_fragments WHERE reason IS NOT NULL), x AS (SELECT preview_id, fragment_id, array_to_string(list_transform(list(reason) OVER (PARTITION BY preview_id ORDER BY fragment_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), lambda t: left(t, 600)), ' | ') AS context FROM p) SELECT * FROM x")
def followup_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "preview_fragments").where("reason IS NOT NULL").dropDuplicates(["fragment_id"]).select("preview_id", "fragment_id", "reason")
    return graph.last_turns(rows, "preview_id", [F.col("fragment_id")], "reason").select("preview_id", "fragment_id", "context")


@query(f"WITH {_CHUNKS} SELECT chunk_id, file_path || ':' || start_line || CASE WHEN end_line = start_line THEN '' ELSE '-' || end_line END AS citation FROM c")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", X.citation(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("citation"))


# Extensions: windows over the event stream, vectors ----------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 4) AS mean_norm FROM embeddings GROUP BY label")
def embedding_norms(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(norm), 4).alias("mean_norm"))


@query("WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e), s AS (SELECT q.vec_id AS qid, n.vec_id AS id, round(CASE WHEN q.norm > 0 AND n.norm > 0 THEN list_dot_product(q.v, n.v) / (q.norm * n.norm) ELSE 0 END, 6) + 0.0::DOUBLE AS score FROM n q JOIN n ON q.vec_id <> n.vec_id WHERE q.vec_id % 20 = 0) SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5")
def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding")


# Send previews ------------------------------------------------------------------------------------------------------------------


@query(r"SELECT DISTINCT preview_id, lower(regexp_extract(endpoint, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, rtrim(lower(regexp_extract(endpoint, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)', 1)), '.') AS host, coalesce(endpoint IS NULL OR regexp_matches(rtrim(lower(regexp_extract(endpoint, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)', 1)), '.'), '^(localhost|127\.[0-9]+\.[0-9]+\.[0-9]+|\[::1\])$'), false) AS is_local FROM send_previews")
def preview_endpoints(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "send_previews").select("preview_id", "endpoint").distinct()
    return rows.select("preview_id", X.url_scheme(F.col("endpoint")).alias("scheme"), X.url_host(F.col("endpoint")).alias("host"), X.is_local(F.col("endpoint")).alias("is_local")).distinct()


@query("WITH p AS (SELECT DISTINCT preview_id, provider, fragment_count FROM send_previews), g AS (SELECT preview_id, count(*) AS n, sum(octet_length(encode(coalesce(content, ''))))::BIGINT AS n_bytes FROM (SELECT DISTINCT * FROM preview_fragments) GROUP BY ALL) SELECT p.preview_id, p.provider, coalesce(n, 0) AS n_fragments, coalesce(n_bytes, 0) AS content_bytes, coalesce(coalesce(n, 0) = fragment_count, false) AS complete FROM p LEFT JOIN g USING (preview_id)")
def preview_contents(spark: SparkSession, d: str) -> DataFrame:
    """What a send preview would send: its fragments against the number it states."""
    p = table(spark, d, "send_previews").select("preview_id", "provider", "fragment_count").distinct()
    g = table(spark, d, "preview_fragments").dropDuplicates(["fragment_id"]).groupBy("preview_id").agg(F.count(F.lit(1)).alias("n_fragments"), F.sum(F.octet_length(F.coalesce("content", F.lit("")))).cast("long").alias("content_bytes"))
    rows = p.join(g, "preview_id", "left").fillna(0, ["n_fragments", "content_bytes"])
    return rows.select("preview_id", "provider", "n_fragments", "content_bytes", F.coalesce(F.col("n_fragments") == F.col("fragment_count"), F.lit(False)).alias("complete"))


# More of the evaluation ---------------------------------------------------------------------------------------------------------

_GRADE = "CASE WHEN cc.chunk_id = q.qid THEN 3 WHEN cc.repo = q.repo AND cc.file_path = q.file_path THEN 2 WHEN cc.symbol = q.question THEN 1 ELSE 0 END"


@query(f"WITH {_CHUNKS}, {_BM_W}, qg AS (SELECT q.*, c.repo, c.file_path FROM q JOIN c ON c.chunk_id = q.qid), r5 AS (SELECT * FROM {_RES} WHERE rank <= 5), gd AS (SELECT q.qid, cc.chunk_id, {_GRADE} AS grade FROM qg q JOIN cf cc ON cc.chunk_id = q.qid OR (cc.repo = q.repo AND cc.file_path = q.file_path) OR cc.symbol = q.question), got AS (SELECT r5.qid, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM r5 JOIN gd USING (qid, chunk_id) GROUP BY r5.qid), best AS (SELECT qid, sum((pow(2, grade) - 1) / log2(k + 1)) AS ideal FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC) AS k FROM gd) WHERE k <= 5 GROUP BY qid) SELECT q.qid, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM q LEFT JOIN got USING (qid) LEFT JOIN best USING (qid)")
def graded_ndcg(spark: SparkSession, d: str) -> DataFrame:
    results, qs = _ranked(spark, d)
    c = _chunks(spark, d)
    live = c.join(_live(spark, d, c), "chunk_id", "left_semi").select("chunk_id", "repo", "file_path", "symbol")
    home = qs.join(c.select(F.col("chunk_id").alias("qid"), "repo", "file_path"), "qid")
    grades = graph.grades(home.select("qid", "question", "repo", "file_path"), live)
    return graph.graded_ndcg(results, grades, qs.select("qid"))
