"""Queries of the two general data problems: orphan references (p2) and hot keys (p5)."""

from __future__ import annotations

from loomdex.common import table
from loomdex.operators import hotkeys, orphans


def sql_norm(p: str) -> str:
    """SQL for the normal form of the path expression ``p``."""
    step = (
        "CASE WHEN x IN ('', '.') THEN a WHEN x <> '..' THEN a || '/' || x "
        f"WHEN a = '' AND starts_with({p}, '/') THEN a WHEN a = '' OR a = '/..' OR ends_with(a, '/../..') THEN a || '/..' "
        "ELSE regexp_replace(a, '/[^/]*$', '') END"
    )
    body = f"list_reduce(list_concat([''], string_split({p}, '/')), lambda a, x: {step})"
    return f"CASE WHEN {p} IS NULL THEN NULL WHEN starts_with({p}, '/') THEN '/' || substr({body}, 2) ELSE substr({body}, 2) END"


def sql_tag(t: str) -> str:
    """SQL condition that ``t`` is a usable tag."""
    return rf"({t} IS NOT NULL AND {t} <> '' AND NOT regexp_matches({t}, '[ \t\n\x0B\f\r]') AND octet_length(encode({t})) < 512)"


def _found(spark, d):
    t = lambda n: table(spark, d, n)
    return orphans.index_orphans(t("gtp"), t("parsefile_data"), t("defs"), t("files"))


QUERIES = {
    "p2_found": lambda s, d: _found(s, d).select("ref_table", "field", "ref_id"),
    "p2_report": lambda s, d: orphans.orphan_counts(_found(s, d)),
    "p5_found": lambda s, d: hotkeys.hot_keys(table(s, d, "gtp")).select("key_field", "key_value"),
    "p5_tag_profile": lambda s, d: hotkeys.tag_profile(table(s, d, "gtp")),
    "p5_line_profile": lambda s, d: hotkeys.line_profile(table(s, d, "gtp")),
}

_ORPHANS = rf"""
WITH life AS (
    SELECT DISTINCT 1 AS kind, tag AS k, loaded_at, removed_at FROM defs
    UNION SELECT DISTINCT 2, {sql_norm('path')}, loaded_at, removed_at FROM files
    UNION SELECT DISTINCT 3, CAST(fid AS VARCHAR), loaded_at, removed_at FROM files),
refs AS (
    SELECT DISTINCT 'gtp' AS ref_table, 'tag' AS field, 1 AS kind, gtp_id AS ref_id, tag AS k, read_at AS t FROM gtp WHERE db IN (1, 2) AND {sql_tag('tag')}
    UNION ALL SELECT DISTINCT 'gtp', 'path', 2, gtp_id, {sql_norm('path')}, read_at FROM gtp WHERE path IS NOT NULL
    UNION ALL SELECT DISTINCT 'parsefile_data', 'fid', 3, run_id, regexp_extract(fid, '^\s*0*([0-9]+)\s*$', 1), parsed_at FROM parsefile_data WHERE regexp_matches(fid, '^\s*[0-9]+\s*$')),
found AS (
    SELECT ref_table, field, ref_id, t FROM refs ANTI JOIN life
    ON refs.kind = life.kind AND refs.k = life.k AND life.loaded_at <= refs.t AND (life.removed_at IS NULL OR refs.t < life.removed_at))
"""
_TAG_ROWS = f"SELECT DISTINCT gtp_id, tag, {sql_norm('path')} AS path, lineno FROM gtp WHERE {sql_tag('tag')}"

ORACLE = {
    "p2_found": _ORPHANS + "SELECT ref_table, field, ref_id FROM found",
    "p2_report": _ORPHANS + "SELECT ref_table, field, strftime(t, '%Y-%m') AS month, count(*) AS orphans FROM found GROUP BY ALL",
    "p5_found": f"""
WITH r AS (SELECT DISTINCT gtp_id, tag, lineno FROM gtp), n AS (SELECT count(*) AS total FROM r)
SELECT 'tag' AS key_field, tag AS key_value FROM r, n WHERE {sql_tag('tag')} GROUP BY tag, total HAVING count(*) > 0.01 * total
UNION ALL SELECT 'lineno', CAST(lineno AS VARCHAR) FROM r, n WHERE lineno IS NOT NULL GROUP BY lineno, total HAVING count(*) > 0.01 * total""",
    "p5_tag_profile": f"""
WITH r AS ({_TAG_ROWS}),
a AS (SELECT tag, count(*) AS n_records, count(DISTINCT path) AS n_paths, count(DISTINCT lineno) AS n_lines,
    quantile_disc(lineno, 0.5) AS line_p50, quantile_disc(lineno, 0.9) AS line_p90 FROM r GROUP BY tag),
p AS (SELECT tag, path FROM r WHERE path IS NOT NULL GROUP BY tag, path QUALIFY row_number() OVER (PARTITION BY tag ORDER BY count(*) DESC, path) = 1),
l AS (SELECT tag, lineno FROM r WHERE lineno IS NOT NULL GROUP BY tag, lineno QUALIFY row_number() OVER (PARTITION BY tag ORDER BY count(*) DESC, lineno) = 1)
SELECT a.tag, n_records, n_paths, p.path AS top_path, n_lines, l.lineno AS top_line, line_p50, line_p90
FROM a LEFT JOIN p ON a.tag = p.tag LEFT JOIN l ON a.tag = l.tag""",
    "p5_line_profile": f"""
WITH r AS (SELECT DISTINCT gtp_id, lineno, CASE WHEN {sql_tag('tag')} THEN tag END AS tag FROM gtp WHERE lineno IS NOT NULL),
a AS (SELECT lineno, count(*) AS n_records, count(DISTINCT tag) AS n_tags FROM r GROUP BY lineno),
m AS (SELECT lineno, tag FROM r WHERE tag IS NOT NULL GROUP BY lineno, tag QUALIFY row_number() OVER (PARTITION BY lineno ORDER BY count(*) DESC, tag) = 1)
SELECT a.*, m.tag AS top_tag FROM a LEFT JOIN m ON a.lineno = m.lineno""",
}
