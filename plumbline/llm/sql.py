"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

#: Folding as far as SQL knows it: full-width forms, NFC, lower case and the one letter that case folding makes two of.
_FOLDED = "trim(replace(lower(nfc_normalize(array_to_string(list_transform(string_split(term, ''), lambda c: CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) ELSE c END), ''))), 'ß', 'ss'))"
_COUNTED = f"""r AS (SELECT DISTINCT term, chunk_id, n_occ, repo FROM chunk_terms WHERE term IS NOT NULL AND chunk_id IN (SELECT chunk_id FROM chunks)),
tf AS (SELECT term, chunk_id, sum(n)::BIGINT AS tf FROM (SELECT {_FOLDED} AS term, chunk_id, coalesce(n_occ, 1) AS n FROM r) WHERE term <> '' GROUP BY ALL),
t AS (SELECT term, sum(tf)::BIGINT AS n_occ, count(*) AS n_chunks FROM tf GROUP BY term),
m AS (SELECT *, CASE WHEN n_chunks < 3 THEN 'rare' WHEN n_chunks > 0.2 * (SELECT count(DISTINCT chunk_id) FROM chunks) THEN 'common' END AS mark FROM t)"""

SQL = {
    "p3_found": f"WITH {_COUNTED} SELECT chunk_id, term FROM tf JOIN t USING (term) WHERE tf >= 3 AND n_chunks >= 2 AND 2 * tf >= n_occ",
    "p6_frequencies": f"WITH {_COUNTED} SELECT term, n_occ, n_chunks, mark FROM m",
    "p6_found": f"WITH {_COUNTED} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p5_found": r"""
WITH f AS (
  SELECT file_id, max(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END) AS n
  FROM files WHERE text IS NOT NULL GROUP BY file_id),
r AS (
  SELECT DISTINCT region_id, file_id, repo, start_line, end_line,
    CASE WHEN language IN ('python','javascript','typescript','go','rust','java','c','cpp','markdown','config') THEN language
      ELSE CASE lower(regexp_extract(file_path, '\.([^./]*)$', 1))
        WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript'
        WHEN 'ts' THEN 'typescript' WHEN 'mts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java'
        WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'cxx' THEN 'cpp' WHEN 'hpp' THEN 'cpp'
        WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' WHEN 'json' THEN 'config' WHEN 'toml' THEN 'config' WHEN 'ini' THEN 'config' END END AS language
  FROM regions WHERE start_line >= 1 AND end_line >= start_line)
SELECT r.region_id FROM r JOIN f USING (file_id)
LEFT JOIN parse_limits g ON g.language = r.language AND g.repo IS NULL
LEFT JOIN parse_limits s ON s.language = r.language AND s.repo = r.repo
WHERE n > 0 AND least(end_line, n) - least(start_line, n) + 1 > coalesce(s.max_chunk_lines, g.max_chunk_lines)
""",
}
