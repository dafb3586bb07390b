"""The queries of the index's own operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.common import table
from loomdex.functions import formats, text
from loomdex.functions.paths import is_tag, normal_path
from loomdex.operators import grep, incremental, reports, search
from loomdex.plans.general import sql_norm, sql_tag
from loomdex.parsers import tables
from loomdex.sources import index
from loomdex.sources.languages import LANGUAGE_MAP, language_in, language_of, skipped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# --- common table expressions of the SQL ---
KEY = "CASE WHEN contains(tag, '.') THEN string_split(tag, '.')[-1] WHEN contains(tag, '::') THEN string_split(tag, '::')[-1] ELSE tag END"
F_ = "f AS (SELECT DISTINCT fid, path, kind, lang, repo, mtime, size FROM files)"
D_ = "d AS (SELECT key, tag, fid, p.path, p.repo, lineno, image FROM defs JOIN (SELECT DISTINCT fid, path, repo FROM files) p USING (fid))"
R_ = f"r AS (SELECT DISTINCT {KEY} AS key, tag, './' || {sql_norm('path')} AS path, lineno FROM gtp WHERE db IN (2, 3) AND {sql_tag('tag')} AND path IS NOT NULL AND lineno IS NOT NULL)"
L_ = rf"""p0 AS (SELECT param_id, any_value(file) AS file, any_value(content) AS content FROM parser_param WHERE content <> '' AND file IS NOT NULL GROUP BY param_id),
a AS (SELECT param_id, './' || {sql_norm('file')} AS path, ends_with(content, chr(10)) AS t,
    CASE WHEN ends_with(content, chr(10)) THEN list_slice(string_split(content, chr(10)), 1, -2) ELSE string_split(content, chr(10)) END AS x FROM p0),
l AS (SELECT param_id, path, i AS lineno, CASE WHEN i < len(x) OR t THEN regexp_replace(x[i], '\r$', '') ELSE x[i] END AS image FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a))"""


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query and its SQL."""

    def put(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return put


def _defs(where: Callable[[DataFrame], DataFrame]) -> Callable:
    return lambda s, d: where(index.definitions(s, d)).select("key", "tag", "path", "lineno", "image")


COLS = "key, tag, path, lineno, image"
# --- lookup ---
query("def_exact", f"WITH {D_} SELECT {COLS} FROM d WHERE key = 'base_read'")(_defs(lambda x: search.search(x, "base_read")))
query("def_anchored", f"WITH {D_} SELECT {COLS} FROM d WHERE key = 'sys_read'")(_defs(lambda x: search.search(x, "^sys_read$")))
query("def_prefix", f"WITH {D_} SELECT {COLS} FROM d WHERE starts_with(key, 'read_')")(_defs(lambda x: search.search(x, "^read_.*")))
query("def_regex", f"WITH {D_} SELECT {COLS} FROM d WHERE regexp_matches(key, '^[sg]et.*_[a-z]+o')")(_defs(lambda x: search.search(x, "^[sg]et.*_[[:lower:]]+o")))
query("def_regex_prefix", f"WITH {D_} SELECT {COLS} FROM d WHERE regexp_matches(key, '^pop.*[ae]$')")(_defs(lambda x: search.search(x, "^pop.*[ae]$")))
query("def_icase", f"WITH {D_} SELECT {COLS} FROM d WHERE lower(key) = 'base_read'")(_defs(lambda x: search.search(x, "BASE_Read", icase=True)))
query("def_icase_prefix", f"WITH {D_} SELECT {COLS} FROM d WHERE starts_with(lower(key), 'get')")(_defs(lambda x: search.search(x, "^GET", icase=True)))
query("def_scan", f"WITH {D_} SELECT {COLS} FROM d")(_defs(lambda x: search.search(x, ".*")))
query("def_empty", f"WITH {D_} SELECT {COLS} FROM d WHERE false")(_defs(lambda x: search.search(x, "")))
query("def_literal", f"WITH {D_} SELECT {COLS} FROM d WHERE key = '^sys_read$'")(_defs(lambda x: search.search(x, "^sys_read$", literal=True)))
query("def_scope", f"WITH {D_} SELECT {COLS} FROM d WHERE starts_with(key, 'open') AND starts_with(path, './tarnbrook/')")(_defs(lambda x: search.search(x, "^open", scope="./tarnbrook/")))
query("def_keys", "SELECT DISTINCT key FROM defs")(lambda s, d: table(s, d, "defs").select("key").distinct())
query("ref_semi", f"WITH {R_} SELECT * FROM r SEMI JOIN defs USING (key)")(lambda s, d: search.resolved(index.references(s, d), table(s, d, "defs")))
query("sym_anti", f"WITH {R_} SELECT * FROM r ANTI JOIN defs USING (key)")(lambda s, d: search.unresolved(index.references(s, d), table(s, d, "defs")))
query("ref_sym_union", f"WITH {R_} SELECT * FROM r WHERE starts_with(key, 'list')")(lambda s, d: search.search(index.references(s, d), "^list"))
query("find_symbol_all", f"WITH {D_}, {R_} SELECT key, tag, path, lineno FROM d WHERE starts_with(key, 'sys_') UNION ALL SELECT * FROM r WHERE starts_with(key, 'sys_')")(lambda s, d: search.everything(index.definitions(s, d), index.references(s, d), "^sys_"))
query("callers", f"WITH {R_} SELECT * FROM r SEMI JOIN defs USING (key) WHERE key = 'base_read'")(lambda s, d: search.search(search.resolved(index.references(s, d), table(s, d, "defs")), "base_read"))
query("complete_prefix", "SELECT DISTINCT key FROM defs WHERE starts_with(key, 'read_')")(lambda s, d: search.complete(table(s, d, "defs"), "read_"))
query("complete_icase", "SELECT DISTINCT key FROM defs WHERE starts_with(lower(key), 'get')")(lambda s, d: search.complete(table(s, d, "defs"), "GET", icase=True))
query("limit_first_n", "SELECT DISTINCT key FROM defs WHERE starts_with(key, 'read_') ORDER BY key LIMIT 20")(lambda s, d: search.complete(table(s, d, "defs"), "read_").orderBy("key").limit(20))
LIBS = ["ostrava-db", "tarnbrook", "varnhold"]
_LIB = f"WITH {D_}, h AS (SELECT *, CAST(list_position({LIBS}, repo) AS BIGINT) AS lib_rank FROM d WHERE regexp_matches(key, '^(base|sys|util)_') AND repo IN {tuple(LIBS)})"
query("library_first", _LIB + " SELECT key, tag, path, lineno, lib_rank FROM h WHERE lib_rank = (SELECT min(lib_rank) FROM h)")(lambda s, d: search.first_library(index.definitions(s, d), LIBS, "^(base|sys|util)_").select("key", "tag", "path", "lineno", "lib_rank"))
query("library_through", _LIB + " SELECT key, tag, path, lineno, lib_rank FROM h")(lambda s, d: search.first_library(index.definitions(s, d), LIBS, "^(base|sys|util)_", through=True).select("key", "tag", "path", "lineno", "lib_rank"))


query("complete_library", f"WITH {D_}, h AS (SELECT *, list_position({LIBS}, repo) AS r FROM d WHERE starts_with(key, 'read_') AND repo IN {tuple(LIBS)}) SELECT DISTINCT key FROM h WHERE r = (SELECT min(r) FROM h)")(lambda s, d: search.complete(index.definitions(s, d), "read_", libraries=LIBS))


def _contexts(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "gtp").filter(is_tag(F.col("tag")) & F.col("path").isNotNull() & F.col("lineno").isNotNull())
    return g.select(text.method_key(F.col("tag")).alias("key"), F.concat(F.lit("./"), normal_path(F.col("path"))).alias("path"), "lineno").distinct()


query(
    "context_resolve",
    f"""WITH {D_}, c AS (SELECT DISTINCT {KEY} AS key, './' || {sql_norm('path')} AS path, lineno FROM gtp WHERE {sql_tag('tag')} AND path IS NOT NULL AND lineno IS NOT NULL)
    SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.key = c.key AND d.path = c.path AND d.lineno = c.lineno) THEN 'references'
        WHEN EXISTS (SELECT 1 FROM d WHERE d.key = c.key) THEN 'definitions' ELSE 'symbols' END AS target FROM c""",
)(lambda s, d: search.resolve_context(_contexts(s, d), index.definitions(s, d)))
query(
    "context_library",
    f"""WITH {D_}, c AS (SELECT DISTINCT {KEY} AS key, './' || {sql_norm('path')} AS path, lineno FROM gtp WHERE {sql_tag('tag')} AND path IS NOT NULL AND lineno IS NOT NULL)
    SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM d WHERE repo = 'tarnbrook' AND d.key = c.key AND d.path = c.path AND d.lineno = c.lineno) THEN 'references'
        WHEN EXISTS (SELECT 1 FROM d WHERE repo IN ('tarnbrook', 'varnhold') AND d.key = c.key) THEN 'definitions' ELSE 'symbols' END AS target FROM c WHERE starts_with(path, './tarnbrook/')""",
)(lambda s, d: (lambda x: search.resolve_context(_contexts(s, d).filter(F.col("path").startswith("./tarnbrook/")), x.filter("repo = 'tarnbrook'"), x.filter("repo = 'varnhold'")))(index.definitions(s, d)))
BASE = "./tarnbrook/path/"
query(
    "near_sort",
    f"""WITH {D_}, p AS (SELECT tag, path, lineno, string_split(path, '/') AS a, string_split('{BASE}', '/') AS b FROM d WHERE starts_with(key, 'scan'))
    SELECT tag, path, lineno, len(list_filter(range(1, greatest(least(len(a), len(b)), 1)), lambda i: a[1:i] = b[1:i])) AS score FROM p""",
)(lambda s, d: search.near(search.search(index.definitions(s, d), "^scan"), BASE).select("tag", "path", "lineno", "score"))
query("file_tags", f"WITH {D_}, m AS (SELECT min(path) AS path FROM d WHERE starts_with(path, './tarnbrook/')) SELECT tag, lineno, image FROM d SEMI JOIN m USING (path)")(
    lambda s, d: (lambda x: x.join(x.filter(F.col("path").startswith("./tarnbrook/")).agg(F.min("path").alias("path")), "path", "left_semi").select("tag", "lineno", "image"))(index.definitions(s, d))
)
query("hit_counts", f"WITH {D_} SELECT count(*) AS objects, count(DISTINCT path) AS files FROM d WHERE starts_with(key, 'scan')")(lambda s, d: search.search(index.definitions(s, d), "^scan").agg(F.count("*").alias("objects"), F.countDistinct("path").alias("files")))
query("distinct_paths", f"WITH {D_} SELECT DISTINCT path FROM d WHERE starts_with(key, 'scan')")(lambda s, d: search.search(index.definitions(s, d), "^scan").select("path").distinct())

# --- lines and paths ---
query("line_scan", f"WITH {L_} SELECT * FROM l")(index.lines)
query("grep_literal", f"WITH {L_} SELECT * FROM l WHERE contains(image, 'return acc')")(lambda s, d: grep.grep(index.lines(s, d), "return acc"))
query("grep_alternatives", f"WITH {L_} SELECT * FROM l WHERE contains(image, 'switch') OR contains(image, '[] = {{')")(lambda s, d: grep.grep(index.lines(s, d), "switch\n[] = {", literal=True))
query("grep_icase", f"WITH {L_} SELECT * FROM l WHERE contains(lower(image), 'licensed under')")(lambda s, d: grep.grep(index.lines(s, d), "LICENSED under", icase=True))
query("grep_regex", rf"WITH {L_} SELECT * FROM l WHERE regexp_matches(image, '^[ \t]*for \(.*n; [a-z]+\+\+\) \{{')")(lambda s, d: grep.grep(index.lines(s, d), r"^[ 	]*for \(.*n; [[:lower:]]+\+\+\) \{"))
query("grep_basic", rf"WITH {L_} SELECT * FROM l WHERE regexp_matches(image, '^(static|long)$')")(lambda s, d: grep.grep(index.lines(s, d), r"^\(static\|long\)$", basic=True))
query("grep_invert", f"WITH {L_} SELECT * FROM l WHERE NOT contains(image, ';')")(lambda s, d: grep.grep(index.lines(s, d), ";", literal=True, invert=True))
query("grep_files", f"WITH {L_} SELECT DISTINCT path FROM l WHERE contains(image, 'while')")(lambda s, d: grep.grep_files(index.lines(s, d), "while"))
query("assign_lines", rf"WITH {L_} SELECT * FROM l WHERE regexp_matches(image, '\bacc\b[ \t]*=[^=]')")(lambda s, d: grep.grep(index.lines(s, d), r"\bacc\b[ 	]*=[^=]"))
query("include_lines", rf"WITH {L_} SELECT * FROM l WHERE regexp_matches(image, '^[ \t]*#[ \t]*include[ \t].*[\"</]r[a-z]*\.h[\">]')")(lambda s, d: grep.grep(index.lines(s, d), r'^[ 	]*#[ 	]*include[ 	].*["</]r[[:lower:]]*\.h[">]'))
query("colour_lines", rf"WITH {L_} SELECT param_id, lineno, regexp_replace(image, '(acc)', chr(27) || '[01;31m\1' || chr(27) || '[m', 'g') AS image FROM l WHERE contains(image, 'acc')")(lambda s, d: grep.grep(index.lines(s, d), "acc").select("param_id", "lineno", text.highlight(F.col("image"), "acc").alias("image")))
_TOK = f"WITH {L_}, w AS (SELECT DISTINCT unnest(regexp_extract_all(image, '[A-Za-z_\\x{{80}}-\\x{{10FFFF}}][A-Za-z0-9_\\x{{80}}-\\x{{10FFFF}}]*')) AS token, path, lineno FROM l)"
query("token_lookup", _TOK + " SELECT * FROM w WHERE token = 'return'")(lambda s, d: grep.tokens(index.lines(s, d)).filter("token = 'return'"))
query("token_complete", _TOK + " SELECT DISTINCT token FROM w WHERE starts_with(token, 'sc')")(lambda s, d: grep.tokens(index.lines(s, d)).filter(F.col("token").startswith("sc")).select("token").distinct())
_FILES = f"WITH {F_} SELECT DISTINCT path FROM f WHERE "
query("path_match", _FILES + r"kind = 'source' AND regexp_matches(path[2:], '\.c$')")(lambda s, d: grep.find_paths(index.files(s, d), r"\.c$"))
query("path_anchor", _FILES + "kind = 'source' AND starts_with(path[2:], '/tarn')")(lambda s, d: grep.find_paths(index.files(s, d), "^tarn"))
query("path_icase", _FILES + "kind = 'source' AND contains(lower(path[2:]), 'score')")(lambda s, d: grep.find_paths(index.files(s, d), "SCORE", icase=True))
query("path_invert", _FILES + r"kind = 'source' AND NOT regexp_matches(path[2:], '\.c$')")(lambda s, d: grep.find_paths(index.files(s, d), r"\.c$", invert=True))
query("path_scope", _FILES + "kind = 'source' AND starts_with(path, './tarnbrook/') AND contains(path[12:], 'a')")(lambda s, d: grep.find_paths(index.files(s, d), "a", scope="./tarnbrook/", literal=True))
query("path_other", _FILES + "kind = 'other' AND contains(path[2:], 'e')")(lambda s, d: grep.find_paths(index.files(s, d), "e", kinds=("other",)))
query("path_both", _FILES + "kind IN ('source', 'other')")(lambda s, d: grep.find_paths(index.files(s, d), None, kinds=("source", "other")))
query("path_complete", f"WITH {F_}, e AS (SELECT path[3:] AS r, unnest(range(1, length(path) - 1)) AS i FROM f) SELECT DISTINCT r[i:] AS completion FROM e WHERE starts_with(r[i:], 'sco')")(lambda s, d: grep.complete_paths(index.files(s, d), "sco"))
query("path_norm", f"SELECT DISTINCT path, {sql_norm('path')} AS normal FROM gtp WHERE path IS NOT NULL")(lambda s, d: table(s, d, "gtp").filter("path IS NOT NULL").select("path").distinct().withColumn("normal", normal_path(F.col("path"))))
_REL = """list_filter(string_split({}, '/'), lambda x: x <> '')"""
query(
    "path_relative",
    f"""WITH {F_}, p AS (SELECT DISTINCT path, {_REL.format("'/src/' || path[3:]")} AS a, {_REL.format("'/src/tarnbrook/path'")} AS b FROM f),
    q AS (SELECT path, a, b, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS n FROM p)
    SELECT path, repeat('../', len(b) - n) || array_to_string(a[n + 1:], '/') AS rel FROM q""",
)(lambda s, d: index.files(s, d).select("path").distinct().withColumn("rel", text.relative(F.concat(F.lit("/src/"), F.substring("path", 3, 1 << 30)), F.lit("/src/tarnbrook/path"))))
query("path_absolute", f"SELECT DISTINCT path, {sql_norm('a')} AS full_path FROM (SELECT path, '/home/src/' || path AS a FROM gtp WHERE path IS NOT NULL AND NOT starts_with(path, '/'))")(lambda s, d: table(s, d, "gtp").filter("path IS NOT NULL").select("path").distinct().withColumn("full_path", text.absolute(F.col("path"), F.lit("/home/src"))))
query("path_in_root", f"WITH {F_} SELECT DISTINCT path, CASE WHEN starts_with(path, './tarnbrook/') THEN '.' || path[12:] END AS inner_path FROM f")(lambda s, d: index.files(s, d).select("path").distinct().withColumn("inner_path", text.in_root(F.col("path"), F.lit("/src/tarnbrook"), F.lit("/src"))))
query("path_encode", f"WITH {F_} SELECT DISTINCT path, replace(replace(replace(path, '%', '%25'), '_', '%5f'), 'a', '%61') AS coded, path AS decoded FROM f")(
    lambda s, d: index.files(s, d).select("path").distinct().withColumn("coded", text.encode_path(F.col("path"), "_a")).withColumn("decoded", text.decode_path(F.col("coded")))
)
query("path_parts", f"WITH {F_} SELECT DISTINCT path, string_split(path, '/')[-1] AS base, regexp_replace(path, '/[^/]*$', '') AS dir, array_to_string(string_split(path, '/')[-2:], '/') AS last_two, CASE WHEN starts_with(path, './tarnbrook/') THEN path[13:] END AS local FROM f")(
    lambda s, d: index.files(s, d).select("path").distinct().select("path", text.base_name(F.col("path")).alias("base"), text.dir_name(F.col("path")).alias("dir"), text.last_parts(F.col("path"), 2).alias("last_two"), text.local_path(F.col("path"), F.lit("./tarnbrook")).alias("local"))
)

# --- formats ---
_IMG = "coalesce(image, '')"
_LEFT = r"regexp_replace(coalesce(image, ''), '^[ \t]+', '')"
_X = "printf('%-16s %4d %-16s %s', tag, lineno, path, coalesce(image, ''))"
for _kind, _sql in {
    "path": "path",
    "ctags": "tag || chr(9) || path || chr(9) || lineno",
    "ctags-x": _X,
    "ctags-xid": f"fid || ' ' || {_X}",
    "ctags-mod": f"path || chr(9) || lineno || chr(9) || {_IMG}",
    "grep": f"path || ':' || lineno || ':' || {_IMG}",
    "cscope": f"path || ' ' || tag || ' ' || lineno || ' ' || CASE WHEN {_LEFT} = '' THEN '<unknown>' ELSE {_LEFT} END",
}.items():
    query(f"fmt_{_kind.replace('-', '_')}", f"WITH {D_} SELECT {_sql} AS line FROM d WHERE tag IS NOT NULL")(lambda s, d, k=_kind: formats.render(index.definitions(s, d).filter("tag IS NOT NULL"), k))
query("fmt_reparsed", f"WITH {D_} SELECT tag || chr(9) || path || chr(9) || lineno AS line FROM d WHERE tag IS NOT NULL")(
    lambda s, d: formats.render(formats.render(index.definitions(s, d).filter("tag IS NOT NULL"), "ctags-x").select(formats.parse_x(F.col("line")).alias("x")).select("x.*"), "ctags")
)
query("fmt_nosource", f"WITH {D_} SELECT path || ':' || lineno || ': ' AS line FROM d")(lambda s, d: formats.render(index.definitions(s, d).withColumn("image", F.lit(" ")), "grep"))
query("dump", "SELECT key || chr(9) || fid || ' ' || tag || ' ' || lineno || ' ' || coalesce(image, '') AS line FROM defs")(lambda s, d: table(s, d, "defs").select(F.concat_ws("\t", "key", F.concat_ws(" ", F.col("fid").cast("string"), "tag", F.col("lineno").cast("string"), F.coalesce("image", F.lit("")))).alias("line")))
query("method_key", f"SELECT DISTINCT tag, {KEY} AS key FROM gtp WHERE {sql_tag('tag')}")(lambda s, d: table(s, d, "gtp").filter(is_tag(F.col("tag"))).select("tag").distinct().withColumn("key", text.method_key(F.col("tag"))))
query("html_lines", f"WITH {L_} SELECT param_id, lineno, replace(replace(replace(image, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM l")(lambda s, d: index.lines(s, d).select("param_id", "lineno", text.html_escape(F.col("image")).alias("html")))
query("url_decode", f"WITH {F_} SELECT DISTINCT path, path AS decoded FROM f")(lambda s, d: index.files(s, d).select("path").distinct().withColumn("decoded", F.url_decode(F.url_encode("path"))))
query("urls", f"WITH {D_} SELECT tag, 'S/' || fid || '.html#L' || lineno AS source_url, 'file://' || path || '#L' || lineno AS file_url FROM d")(
    lambda s, d: index.definitions(s, d).select("tag", F.format_string("S/%d.html#L%d", "fid", "lineno").alias("source_url"), F.concat(F.lit("file://"), "path", F.lit("#L"), F.col("lineno").cast("string")).alias("file_url"))
)
query("locate", f"""WITH {F_} SELECT DISTINCT path, nullif(instr(path, 'e'), 0) - 1 AS first_e, CASE WHEN contains(path, 'e') THEN length(path) - instr(reverse(path), 'e') END AS last_e,
    CASE WHEN starts_with(path, './t') THEN CAST(3 AS BIGINT) END AS at_start, CASE WHEN ends_with(path, '.c') THEN length(path) - 2 END AS at_end FROM f""")(
    lambda s, d: index.files(s, d).select("path").distinct().select("path", text.locate(F.col("path"), "e", "first").alias("first_e"), text.locate(F.col("path"), "e", "last").alias("last_e"), text.locate(F.col("path"), "./t", "start").alias("at_start"), text.locate(F.col("path"), ".c", "end").alias("at_end"))
)
query("file_sizes", f"WITH {F_} SELECT fid, size, format('{{:,}}', size) AS shown FROM f")(lambda s, d: index.files(s, d).select("fid", "size", F.format_number("size", 0).alias("shown")))
query("detab", f"WITH {L_} SELECT param_id, lineno, replace(image, chr(9), '        ') AS image FROM l WHERE regexp_matches(image, '^\t+[^\t]*$')")(lambda s, d: index.lines(s, d).filter(F.col("image").rlike(r"^\t+[^\t]*$")).select("param_id", "lineno", text.detab("image").alias("image")))
query("image_codec", f"WITH {D_} SELECT tag, lineno, path, image FROM d WHERE image IS NOT NULL AND tag IS NOT NULL")(
    lambda s, d: index.definitions(s, d).filter("image IS NOT NULL AND tag IS NOT NULL").select("tag", "lineno", "path", text.long_image(text.short_image("image", "tag"), "tag").alias("image"))
)
query(
    "split_fields",
    rf"""WITH {L_}, t AS (SELECT param_id, lineno, ltrim(image, ' ') AS x FROM l) SELECT param_id, lineno, CASE WHEN regexp_matches(x, '^[^ \t]*[ \t]+[^ \t]+[ \t]') THEN regexp_replace(x, '^([^ \t]*)[ \t]+([^ \t]+)[ \t]+(.*)$', '\1|\2|\3', 's')
    WHEN regexp_matches(x, '[ \t]') THEN regexp_replace(x, '^([^ \t]*)[ \t]+(.*)$', '\1|\2', 's') ELSE x END AS fields FROM t""",
)(lambda s, d: index.lines(s, d).select("param_id", "lineno", F.array_join(text.split_fields(F.col("image"), 3), "|").alias("fields")))

# --- reports ---
_DUP = "SELECT tag, count(*) AS entries, (min({'path': path, 'lineno': lineno})).path AS first_path, (min({'path': path, 'lineno': lineno})).lineno AS first_lineno FROM d GROUP BY tag"
query("dup_index", f"WITH {D_} {_DUP}")(lambda s, d: reports.duplicates(index.definitions(s, d)))
query("dup_number", "SELECT tag, dense_rank() OVER (ORDER BY tag) AS number FROM (SELECT DISTINCT tag FROM defs)")(lambda s, d: search.number_groups(table(s, d, "defs")))
query("def_index", f"WITH {D_}, u AS ({_DUP}) SELECT tag, CASE WHEN entries = 1 THEN 'Defined at ' || first_lineno || ' in ' || first_path || '.' ELSE 'Multiple defined in ' || entries || ' places.' END AS title FROM u")(lambda s, d: reports.tooltip(reports.duplicates(index.definitions(s, d))))
query("alpha_index", "SELECT CASE WHEN regexp_matches(tag[1], '^[A-Za-z_]$') OR unicode(tag[1]) > 127 THEN tag[1] ELSE CAST(unicode(tag[1]) AS VARCHAR) END AS bucket, count(*) AS tags FROM (SELECT DISTINCT tag FROM defs) GROUP BY 1")(lambda s, d: reports.alphabet(table(s, d, "defs")))
query("dup_entries", f"WITH {D_} SELECT tag, path, lineno, image FROM d WHERE tag IN (SELECT tag FROM d GROUP BY tag HAVING count(*) > 1)")(lambda s, d: reports.duplicate_entries(index.definitions(s, d)))
query("key_count", "SELECT count(DISTINCT key) AS keys, count(*) AS entries FROM defs")(lambda s, d: table(s, d, "defs").agg(F.countDistinct("key").alias("keys"), F.count("*").alias("entries")))
_DIRS = f"WITH {F_}, p AS (SELECT DISTINCT path, string_split(path, '/') AS a FROM f), e AS (SELECT array_to_string(a[1:i], '/') AS directory FROM (SELECT a, unnest(range(1, len(a))) AS i FROM p)) "
query("dir_rollup", _DIRS + "SELECT directory, count(*) AS files FROM e GROUP BY 1")(lambda s, d: reports.directories(index.files(s, d)))
query("dir_ids", _DIRS + "SELECT directory, row_number() OVER (ORDER BY directory) + (SELECT max(fid) FROM files) AS fid FROM (SELECT DISTINCT directory FROM e)")(lambda s, d: reports.directory_ids(index.files(s, d)))
_INC = rf"""{L_}, i AS (SELECT DISTINCT path, lineno, string_split(coalesce(nullif(regexp_extract(image, '^[ \t]*#[ \t]*(include|import|include_next)\b[ \t]*[<"]([^">]+)[">]', 2), ''),
    nullif(regexp_extract(image, '^[ \t]*(include|include_once|require|require_once)\b[ \t(]*[''"]([^''"]+)[''"]', 2), '')), '/')[-1] AS name FROM l),
n AS (SELECT path, lineno, name FROM i WHERE name IS NOT NULL),
c AS (SELECT DISTINCT path AS target, string_split(path, '/')[-1] AS name FROM files WHERE regexp_matches(path, '(\.h|\.hh|\.hxx|\.hpp|\.H|\.inc\.php)$'))"""
_K = "k AS (SELECT name, count(*) AS k, min(target) AS target FROM c GROUP BY name)"
query("include_edges", f"WITH {_INC}, {_K} SELECT n.path, lineno, n.name, coalesce(k, 0) AS candidates, CASE WHEN k = 1 THEN target END AS target FROM n LEFT JOIN k ON n.name = k.name")(lambda s, d: reports.includes(index.lines(s, d), index.files(s, d)))
query("include_counts", f"WITH {_INC} SELECT w.name, coalesce(k, 0) AS candidates, includers FROM (SELECT name, count(*) AS includers FROM n GROUP BY 1) w LEFT JOIN (SELECT name, count(*) AS k FROM c GROUP BY 1) t ON w.name = t.name")(lambda s, d: reports.include_counts(index.lines(s, d), index.files(s, d)))
KIND = r"CASE WHEN starts_with(ltrim(image, ' '), '#') THEN 'M' WHEN regexp_matches(ltrim(image, ' '), '^typedef\b') THEN 'T' WHEN contains(regexp_replace(image, '[ \t]+\(', '(', 'g'), tag || '(') THEN 'D' ELSE 'T' END"
ANCHORS_ = f"an AS (SELECT path, lineno, tag, {KIND} AS kind FROM d UNION ALL SELECT path, lineno, tag, CASE WHEN EXISTS (SELECT 1 FROM defs WHERE defs.key = r.key) THEN 'R' ELSE 'Y' END FROM r)"


def _anchors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r, f = index.references(s, d), table(s, d, "defs")
    return index.definitions(s, d), search.resolved(r, f), search.unresolved(r, f)


query(
    "anchor_nav",
    f"""WITH {D_}, x AS (SELECT DISTINCT path, lineno FROM d WHERE {KIND} = 'D'), y AS (SELECT path, lineno, lag(lineno) OVER w AS previous, lead(lineno) OVER w AS next, min(lineno) OVER (PARTITION BY path) AS a, max(lineno) OVER (PARTITION BY path) AS z FROM x WINDOW w AS (PARTITION BY path ORDER BY lineno))
    SELECT path, lineno, previous, next, nullif(a, lineno) AS first, nullif(z, lineno) AS last FROM y""",
)(lambda s, d: reports.navigation(index.definitions(s, d)))
query(
    "enclosing_def",
    f"""WITH {D_}, {R_}, x AS (SELECT './' || {sql_norm('path')} AS path, lineno, max(tag) AS enclosing FROM d GROUP BY 1, 2)
    SELECT r.path, r.tag, r.lineno, x.enclosing, x.lineno AS def_lineno FROM r ASOF LEFT JOIN x ON r.path = x.path AND r.lineno >= x.lineno""",
)(lambda s, d: reports.enclosing(index.references(s, d), index.definitions(s, d)))
query(
    "anchor_kind",
    r"SELECT tag, lineno, image, CASE WHEN starts_with(ltrim(image, ' '), '#') THEN 'M' WHEN regexp_matches(ltrim(image, ' '), '^typedef\b') THEN 'T' WHEN contains(regexp_replace(image, '[ \t]+\(', '(', 'g'), tag || '(') THEN 'D' ELSE 'T' END AS kind FROM defs WHERE image IS NOT NULL",
)(lambda s, d: table(s, d, "defs").filter("image IS NOT NULL").select("tag", "lineno", "image", text.anchor_kind(F.lit(1), F.col("tag"), F.col("image")).alias("kind")))
query(
    "anchor_links",
    f"""WITH {D_}, {R_}, {ANCHORS_}, e AS (SELECT list, tag, count(*) AS n, min({{'path': path, 'lineno': lineno}}) AS f FROM (SELECT CASE kind WHEN 'R' THEN 'references' WHEN 'Y' THEN 'symbols' ELSE 'definitions' END AS list, * FROM an) GROUP BY list, tag)
    SELECT an.tag, path, lineno, kind, CASE WHEN n > 1 THEN list || '/' || an.tag WHEN n = 1 AND kind <> 'Y' THEN f.path || '#L' || f.lineno END AS link
    FROM an LEFT JOIN e ON an.tag = e.tag AND list = CASE kind WHEN 'R' THEN 'definitions' WHEN 'Y' THEN 'symbols' ELSE 'references' END""",
)(lambda s, d: (lambda x: reports.linked(reports.anchors(*x), *x))(_anchors(s, d)))
query("anchor_stream", f"WITH {D_}, {R_}, {ANCHORS_} SELECT * FROM an")(lambda s, d: reports.anchors(*_anchors(s, d)))
query("line_clusters", f"WITH {D_}, {R_}, {ANCHORS_} SELECT path, lineno, count(*) AS anchors, max(kind = 'D') AS defines FROM an GROUP BY ALL")(lambda s, d: reports.line_clusters(reports.anchors(*_anchors(s, d))))
query(
    "line_ranges",
    f"""WITH {R_}, x AS (SELECT DISTINCT path, tag, lineno FROM r), y AS (SELECT *, lineno - row_number() OVER (PARTITION BY path, tag ORDER BY lineno) AS island FROM x),
    z AS (SELECT path, tag, min(lineno) AS lo, max(lineno) AS hi FROM y GROUP BY path, tag, island), q AS (SELECT *, lo - coalesce(lag(hi) OVER (PARTITION BY path, tag ORDER BY lo), 0) AS step FROM z)
    SELECT path, tag, CAST(sum(hi - lo + 1) AS BIGINT) AS n, string_agg(step || CASE WHEN hi > lo THEN '-' || (hi - lo) ELSE '' END, ',' ORDER BY lo) AS coded FROM q GROUP BY path, tag""",
)(lambda s, d: reports.line_lists(index.references(s, d)))
query("line_ranges_decoded", f"WITH {R_} SELECT DISTINCT path, tag, lineno FROM r")(lambda s, d: reports.line_lists(index.references(s, d)).select("path", "tag", F.explode(text.decode_lines(F.col("coded"))).alias("lineno")))
query("ref_minus_def", f"WITH {D_}, {R_} SELECT key, tag, path, lineno FROM r ANTI JOIN (SELECT tag, './' || {sql_norm('path')} AS path, lineno FROM d) USING (tag, path, lineno)")(
    lambda s, d: index.references(s, d).join(index.definitions(s, d).select("tag", F.concat(F.lit("./"), normal_path(F.col("path"))).alias("path"), "lineno"), ["tag", "path", "lineno"], "left_anti").select("key", "tag", "path", "lineno")
)
query("path_of_fid", "SELECT DISTINCT run_id, path FROM parsefile_data p JOIN (SELECT DISTINCT fid, path FROM files) f ON try_cast(trim(p.fid) AS BIGINT) = f.fid")(
    lambda s, d: table(s, d, "parsefile_data").select("run_id", F.regexp_extract("fid", r"^\s*(\d+)\s*$", 1).alias("f")).filter("f <> ''").withColumn("fid", F.expr("try_cast(f AS BIGINT)")).join(index.files(s, d).select("fid", "path").distinct(), "fid").select("run_id", "path").distinct()
)
SYMBOL_SQL = r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*"
query(
    "sym_scan",
    rf"WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '{SYMBOL_SQL}')) AS tag FROM documents WHERE text <> '') SELECT doc_id, tag, count(*) AS n FROM x WHERE octet_length(encode(tag)) < 512 GROUP BY ALL",
)(lambda s, d: table(s, d, "documents").filter(F.length("text") > 0).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(text.SYMBOL), F.lit(0))).alias("tag")).filter(is_tag(F.col("tag"))).groupBy("doc_id", "tag").agg(F.count("*").alias("n")))

# --- languages, skipping, binaries ---
_LANG = "CASE " + " ".join(f"WHEN regexp_matches(base, '{pattern}') THEN '{lang}'" for lang, pattern in LANGUAGE_MAP) + " END"
query("lang_of_path", f"WITH {F_}, b AS (SELECT DISTINCT path, string_split(path, '/')[-1] AS base FROM f) SELECT path, {_LANG} AS lang FROM b")(lambda s, d: index.files(s, d).select("path").distinct().withColumn("lang", language_of(F.col("path"))))
query("skip_paths", _FILES + r"NOT (regexp_matches(path, '/node_modules/') OR regexp_matches(path, '\.min\.js$') OR regexp_matches(path, '/\.'))")(lambda s, d: index.files(s, d).select("path").distinct().filter(~skipped(F.col("path"), ["node_modules/", "*.min.js"])))
query("binary_flag", r"SELECT param_id, (starts_with(c, '!<arch>') OR starts_with(c, '%PDF') OR regexp_matches(c, '[\x00-\x08\x0E-\x1A\x1C-\x1F]')) AS is_binary FROM (SELECT DISTINCT param_id, content[1:512] AS c FROM parser_param WHERE content IS NOT NULL)")(
    lambda s, d: table(s, d, "parser_param").filter("content IS NOT NULL").select("param_id", F.substring("content", 1, 512).alias("c")).distinct().select("param_id", (F.col("c").startswith("!<arch>") | F.col("c").startswith("%PDF") | F.col("c").rlike(r"[\x00-\x08\x0E-\x1A\x1C-\x1F]")).alias("is_binary"))
)

# --- incremental maintenance over the lives of paths ---
AS_OF, THEN, NOW = "2024-06-01 00:00:00", "2025-04-01 00:00:00", "2025-09-01 00:00:00"
_ALIVE = "SELECT path, max(mtime) AS mtime, max(kind) AS kind, max(fid) AS fid FROM files WHERE loaded_at <= TIMESTAMP '{0}' AND (removed_at IS NULL OR removed_at > TIMESTAMP '{0}') GROUP BY path"


def _alive(s: SparkSession, d: str, at: str) -> DataFrame:
    t = F.lit(at).cast("timestamp_ntz")
    return table(s, d, "files").filter((F.col("loaded_at") <= t) & (F.col("removed_at").isNull() | (F.col("removed_at") > t))).groupBy("path").agg(F.max("mtime").alias("mtime"), F.max("kind").alias("kind"), F.max("fid").alias("fid"))


def _changes(s: SparkSession, d: str) -> DataFrame:
    return incremental.change_set(_alive(s, d, THEN), _alive(s, d, NOW), AS_OF)


_CHANGES = f"""WITH k AS ({_ALIVE.format(THEN)}), n AS ({_ALIVE.format(NOW)}),
c AS (SELECT path, CASE WHEN k.path IS NULL THEN 'add' WHEN n.path IS NULL THEN 'delete' WHEN n.mtime > TIMESTAMP '{AS_OF}' AND coalesce(n.kind, 'source') = 'source' THEN 'modify' END AS action FROM k FULL JOIN n USING (path))"""
LAST = 1_000_000
_NEW = f"SELECT path, {LAST} + row_number() OVER (ORDER BY path) AS fid FROM c WHERE action = 'add'"
query("change_set", _CHANGES + " SELECT * FROM c WHERE action IS NOT NULL")(_changes)
query("id_alloc", _CHANGES + " " + _NEW)(lambda s, d: incremental.allocate(_changes(s, d).filter("action = 'add'").select("path"), LAST))
query("apply_update", _CHANGES + f" SELECT path, fid FROM k WHERE path NOT IN (SELECT path FROM c WHERE action = 'delete') UNION ALL {_NEW}")(lambda s, d: incremental.apply_changes(_alive(s, d, THEN), _changes(s, d), LAST))
query(
    "upsert",
    "SELECT path, fid, mtime FROM (SELECT DISTINCT path, fid, mtime FROM files WHERE path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY path ORDER BY fid DESC) = 1",
)(lambda s, d: (lambda f: incremental.upsert(f.filter("fid % 2 = 0"), f.filter("fid % 2 = 1"), ["path"], "fid"))(table(s, d, "files").filter("path IS NOT NULL").select("path", "fid", "mtime").distinct()))


# --- parsers: no SQL for them ---
def _parsed(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "parser_param").filter((F.length("content") > 0) & F.col("file").isNotNull()).dropDuplicates(["param_id"])
    rows = p.select(F.concat(F.lit("./"), normal_path(F.col("file"))).alias("path"), language_in(F.col("file"), F.col("langmap")).alias("lang"), "content", "flags")
    return tables.parse_files(rows.filter("lang IS NOT NULL"))


query("parse_definitions")(lambda s, d: tables.definitions_of(_parsed(s, d)))
query("parse_references")(lambda s, d: tables.references_of(_parsed(s, d)))
query("parse_languages")(lambda s, d: _parsed(s, d).groupBy("kind").agg(F.count("*").alias("events"), F.countDistinct("tag").alias("tags"), F.countDistinct("path").alias("files")))
