"""Queries of parsers, formats and storage: over worked examples given inline, and over tables written to the shared folder and read
again. Each has SQL with the rows expected."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.common import shared_dir, table
from loomdex.engine import Index
from loomdex.functions import text
from loomdex.operators import incremental, reports, search
from loomdex.parsers import tables
from loomdex.plans.general import sql_norm
from loomdex.plans.index_queries import AS_OF, D_, F_, NOW, THEN, _alive, _ALIVE, _changes, _CHANGES
from loomdex.sources import catalog, index, listing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def put(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLE[name] = run, sql
        return run

    return put


def values(rows: list[tuple], columns: str) -> str:
    """SQL of a table of constants."""
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


def folder(s: SparkSession) -> str:
    return f"{shared_dir(s)}/query-{uuid.uuid4().hex}"


# --- parsers: worked examples ---
PROJECT = [
    ("./README", None, "The function of\n"),
    ("./DIR1/fileA.c", "c", "main(){\n        func1();\n        func2();\n}\n"),
    ("./DIR1/fileB.c", "c", "func1(){ ... }\n"),
    ("./DIR2/fileC.c", "c", "#ifdef X\nfunc2(){ i++; }\n#else\nfunc2(){ i--; }\n#endif\nfunc3(){\n        func1();\n}\n"),
]
SOURCES = [
    ("./alias.cc", "cpp", "using my_type1 = double;\ntypedef std::map<DomainId_t, int> map_t2;\n"),
    ("./debug.cc", "cpp", "extern void dump_stack(void) __cold;\n#define pr_debug() printk()\n"),
    ("./class.cc", "cpp", "namespace n {\nclass A { A(); ~A() {} int m() { return g(); } };\n}\n"),
    ("./types.c", "c", "struct s { int x; } v;\nenum e { A, B };\ntypedef struct { int a; } T, *P;\nint old(a, b)\n int a; char *b;\n{ return g(a); }\n#undef Q\n"),
    ("./C.java", "java", "package a;\npublic class C {\n  C() {}\n  int f(int x) { return g(x); }\n  interface I { }\n}\n"),
    ("./f.php", "php", "function no() {}\n<?php function f() {}\nclass A {}\ndefine('K', 1);\n$v = f(); ?> class B\n"),
    ("./e.s", "asm", "ENTRY(f)\n\tcall _g\n.macro m\nlabel:\n"),
    ("./g.y", "yacc", "%%\na : b { act(1); } ;\n%%\nint tail(void) { return 1; }\n"),
]
SOURCE = "path string, lang string, content string"


def _events(s: SparkSession, rows: list[tuple], notfunctions: frozenset[str] = frozenset()) -> DataFrame:
    return tables.parse_files(s.createDataFrame(rows, SOURCE), notfunctions)


query("parse_project", values([("main", "./DIR1/fileA.c", 1), ("func1", "./DIR1/fileB.c", 1), ("func2", "./DIR2/fileC.c", 2), ("func2", "./DIR2/fileC.c", 4), ("func3", "./DIR2/fileC.c", 6)], "tag, path, lineno"))(
    lambda s, d: tables.definitions_of(_events(s, PROJECT)).select("tag", "path", "lineno")
)
query("parse_project_references", values([("func1", "./DIR1/fileA.c", 2), ("func2", "./DIR1/fileA.c", 3), ("func1", "./DIR2/fileC.c", 7)], "tag, path, lineno"))(
    lambda s, d: (lambda e: tables.symbols_of(e, tables.definitions_of(e).withColumn("key", F.col("tag")), "references").select("tag", "path", "lineno"))(_events(s, PROJECT))
)
query("parse_project_symbols", values([("X", "./DIR2/fileC.c", 1), ("i", "./DIR2/fileC.c", 2), ("i", "./DIR2/fileC.c", 4)], "tag, path, lineno"))(
    lambda s, d: (lambda e: tables.symbols_of(e, tables.definitions_of(e).withColumn("key", F.col("tag")), "symbols").select("tag", "path", "lineno"))(_events(s, PROJECT))
)
_GOLDEN = [
    ("./alias.cc", "my_type1", 1), ("./alias.cc", "map_t2", 2), ("./debug.cc", "pr_debug", 2), ("./class.cc", "n", 1), ("./class.cc", "A", 2), ("./class.cc", "m", 2),
    ("./types.c", "s", 1), ("./types.c", "e", 2), ("./types.c", "A", 2), ("./types.c", "B", 2), ("./types.c", "T", 3), ("./types.c", "P", 3), ("./types.c", "old", 4), ("./types.c", "Q", 7),
    ("./C.java", "C", 2), ("./C.java", "f", 4), ("./C.java", "I", 5), ("./f.php", "f", 2), ("./f.php", "A", 3), ("./f.php", "K", 4), ("./e.s", "f", 1), ("./e.s", "m", 3), ("./e.s", "label", 4), ("./g.y", "tail", 4),
]
query("parse_languages_defs", values(_GOLDEN, "path, tag, lineno"))(lambda s, d: tables.definitions_of(_events(s, SOURCES)).select("path", "tag", "lineno"))
query("parse_languages_refs", values([("./class.cc", "g", 2), ("./debug.cc", "printk", 2), ("./types.c", "v", 1), ("./types.c", "g", 6), ("./C.java", "g", 4), ("./f.php", "v", 5), ("./e.s", "g", 2), ("./g.y", "act", 2)], "path, tag, lineno"))(
    lambda s, d: tables.references_of(_events(s, SOURCES)).filter("tag IN ('g', 'printk', 'v', 'act')").select("path", "tag", "lineno")
)
_MACRO = [("./m.c", "c", "MODULE(a) { }\nint f() { return 1; }\n")]
query("parse_notfunction", values([("f", 2)], "tag, lineno"))(lambda s, d: tables.definitions_of(_events(s, _MACRO, frozenset({"MODULE"}))).select("tag", "lineno"))


@query("parse_udtf", values([("func3", 6), ("func2", 2), ("func2", 4)], "tag, lineno"))
def _udtf(s: SparkSession, d: str) -> DataFrame:
    tables.register_udtf(s)
    view = f"project_{uuid.uuid4().hex}"
    s.createDataFrame(PROJECT, SOURCE).createOrReplaceTempView(view)
    return s.sql(f"SELECT tag, lineno FROM {view}, LATERAL parse_symbols(lang, content) AS e WHERE e.kind = 1 AND path = './DIR2/fileC.c'")


# --- formats and functions: worked examples ---
_IMAGES = [("#define macro(c) a;      b;", "macro", "#@d @n(c) a;@6b;"), ("typedef int n;  // @ define", "n", "@t int @n;@2// @@ @d"), ("x            y", "x", "@n@{12}y"), ("macros macro", "macro", "macros @n"), ("", "t", "")]
query("codec_examples", values([(a, c, a) for a, _, c in _IMAGES], "image, coded, decoded"))(
    lambda s, d: s.createDataFrame(_IMAGES, "image string, tag string, want string").withColumn("coded", text.short_image("image", "tag")).select("image", "coded", text.long_image("coded", "tag").alias("decoded"))
)
query("detab_examples", values([("a\tb", "a       b"), ("\t\tx\ty", "                x       y"), ("12345678\t.", "12345678        ."), ("none", "none")], "image, plain"))(
    lambda s, d: s.createDataFrame([("a\tb",), ("\t\tx\ty",), ("12345678\t.",), ("none",)], "image string").withColumn("plain", text.detab("image"))
)
query("xid_fields", f"WITH {F_} SELECT DISTINCT fid, path AS rest FROM f")(lambda s, d: index.files(s, d).select(text.parse_xid(F.concat_ws("  ", F.col("fid").cast("string"), "path")).alias("x")).select("x.*").distinct())
_TREE = [(1, "main() <int main (void) at> <./a.c 3>"), (2, "    sub: void, <./dir/../b.c 7>"), (3, "    gone: <>"), (4, "")]
query("call_tree", values([(1, 0, "main", "./a.c", 3, None), (2, 4, "sub", "./dir/../b.c", 7, 9), (3, 4, "gone", None, None, None)], "seq, depth, name, path, lineno, fid"))(
    lambda s, d: reports.call_tree(s.createDataFrame(_TREE, "seq int, line string"), s.createDataFrame([(9, "./b.c")], "fid int, path string"))
)
_CONF = "# note\ncommon:skip=a,b:langmap=c\\:.c:\\\n  colour:\ndefault|own:tc=common:skip=$EXTRA:depth#3:\n"
query("config_settings", values([("skip", "['a,b', 'z']"), ("langmap", "['c:.c']"), ("colour", "True"), ("depth", "3")], "name, value"))(lambda s, d: s.createDataFrame([(k, str(v)) for k, v in listing.read_config(_CONF, "own", {"EXTRA": "z"}).items()], "name string, value string"))

# --- over the tables ---
query("def_titles", f"WITH {D_} SELECT tag, CASE WHEN count(*) = 1 THEN 'Defined at ' || min(lineno) || ' in ' || min(path) || '.' ELSE 'Multiple defined in ' || count(*) || ' places.' END AS title FROM d GROUP BY tag")(
    lambda s, d: Index.of_tables(s, d).pages()["titles"]
)
_EXPLAIN = "CASE WHEN regexp_matches(path, '/\\.[^./]') OR regexp_matches(path, '/vendor/') THEN 'on the skip list' WHEN lang IS NULL THEN 'no language for the suffix' END"
query(
    "explain_paths",
    rf"""WITH {F_}, b AS (SELECT DISTINCT path, regexp_extract(path, '(\.[^./]+)$', 1) AS x FROM f), l AS (SELECT path, CASE WHEN x IN ('.c', '.h') THEN 'c' WHEN x = '.y' THEN 'yacc' WHEN x IN ('.s', '.S') THEN 'asm' WHEN x = '.java' THEN 'java'
    WHEN x IN ('.c++', '.cc', '.hh', '.cpp', '.cxx', '.hxx', '.hpp', '.C', '.H') THEN 'cpp' WHEN x IN ('.php', '.php3', '.phtml') THEN 'php' END AS lang FROM b) SELECT path, lang, CASE WHEN lang IS NULL THEN 'other' ELSE 'source' END AS kind, {_EXPLAIN} AS reason FROM l""",
)(lambda s, d: listing.explained(index.files(s, d).select("path").distinct(), skip=["vendor/"]).select("path", "lang", "kind", "reason"))
query("path_list", f"WITH {F_} SELECT DISTINCT './' || {sql_norm('path')} AS path FROM f WHERE kind = 'other' UNION SELECT './added.c'")(lambda s, d: _listed(s, d, ["x/../added.c", "/elsewhere/z.c"]))
query("path_list_default", f"WITH {F_} SELECT DISTINCT path FROM f WHERE kind = 'source'")(lambda s, d: listing.sources(s, "/src", files=index.files(s, d)))
_FAR, _NEAR = "'../../../src/deep/er' || path[2:]", "'/src/deep/er' || path[2:]"
query("path_shorter", f"WITH {F_} SELECT DISTINCT path, CASE WHEN length({_FAR}) > length({_NEAR}) THEN {_NEAR} ELSE {_FAR} END AS shown FROM f")(
    lambda s, d: index.files(s, d).select("path").distinct().withColumn("shown", text.styled(F.col("path"), "/src/deep/er", "/home/of/one", "shorter"))
)


def _listed(s: SparkSession, d: str, arguments: list[str]) -> DataFrame:
    """Names given as arguments and as a list in a file."""
    at = folder(s)
    names = index.files(s, d).filter("kind = 'other'").select(F.substring("path", 3, 1 << 30).alias("value")).distinct()
    names.unionByName(s.createDataFrame([("",), (". a note",), ("../out.c",)], "value string")).write.text(at)
    return listing.sources(s, "/src", arguments, at)


_LINES = [("./a.c", 1, "int row = 1;"), ("./a.c", 2, "row == 2;"), ("./a.c", 3, "grow = row;"), ("./b.c", 1, "row\t= 3;"), ("./b.c", 2, "row = 4; /* not in the index */")]


@query("assign_symbol", values([("./a.c", 1), ("./b.c", 1)], "path, lineno"))
def _assigned(s: SparkSession, d: str) -> DataFrame:
    lines = s.createDataFrame(_LINES, "path string, lineno int, image string")
    refs = s.createDataFrame([("row", "row", p, n) for p, n in (("./a.c", 2), ("./a.c", 3), ("./b.c", 1))], "key string, tag string, path string, lineno int")
    defs = s.createDataFrame([("row", "row", "./a.c", 1, "int row = 1;")], "key string, tag string, path string, lineno int, image string")
    return Index(lines.select("path"), defs, refs, lines).assignments("row").select("path", "lineno")


query("include_choices", values([("u.h", "./a/u.h"), ("u.h", "./b/u.h")], "name, target"))(lambda s, d: reports.include_targets(s.createDataFrame([("./a/u.h",), ("./b/u.h",), ("./b/u.h",), ("./c/u.c",), ("./d/u.c",), ("./v.h",)], "path string")))


@query("replace_rows", f"WITH {D_}, {_CHANGES[5:]}, t AS (SELECT DISTINCT f.fid FROM files f JOIN c USING (path) WHERE action <> 'add') SELECT key, tag, fid FROM defs ANTI JOIN t USING (fid) UNION ALL SELECT 'fresh', 'fresh', fid FROM t")
def _replaced(s: SparkSession, d: str) -> DataFrame:
    touched = table(s, d, "files").join(_changes(s, d).filter("action <> 'add'"), "path", "left_semi").select("fid").distinct()
    return incremental.replace_rows(table(s, d, "defs").select("key", "tag", "fid"), touched.selectExpr("'fresh' AS key", "'fresh' AS tag", "fid"), touched)


# --- storage: written and read again ---
@query("catalog_round_trip", f"WITH {D_} SELECT key, tag, fid, path, lineno FROM d")
def _stored(s: SparkSession, d: str) -> DataFrame:
    c = catalog.Catalog(s, folder(s))
    files = index.files(s, d).select("path", "fid", "kind").distinct()
    rel = index.definitions(s, d).select("key", "tag", "fid", "path", "lineno")
    c.create(files, rel, rel.limit(0), AS_OF)
    return c.read("defs")


@query(
    "catalog_update",
    f"WITH {_CHANGES[5:]}, e AS ({_ALIVE.format(THEN)}), o AS (SELECT path FROM e WHERE path NOT IN (SELECT path FROM c WHERE action IS NOT NULL)) SELECT path, 'old' AS tag FROM o UNION ALL SELECT path, 'new' FROM c WHERE action IN ('add', 'modify')",
)
def _updated(s: SparkSession, d: str) -> DataFrame:
    """A version from the paths of one time, brought up to those of a later one: which rows were made anew."""
    c = catalog.Catalog(s, folder(s))
    known, listed = _alive(s, d, THEN), _alive(s, d, NOW)
    made = lambda f, tag: f.select(F.lit("k").alias("key"), F.lit(tag).alias("tag"), "fid", "path", F.lit(1).alias("lineno"))
    files = known.groupBy("path").agg(F.max("fid").alias("fid"), F.max("kind").alias("kind"))
    c.create(files, made(files, "old"), made(files, "old").limit(0), AS_OF)
    c.update(listed, lambda fresh: (made(fresh, "new"), made(fresh, "new").limit(0)), NOW)
    return c.read("defs").select("path", "tag")


@query("catalog_settings", values([("format", "1"), ("current", "1"), ("as_of", AS_OF)], "name, value"))
def _settings(s: SparkSession, d: str) -> DataFrame:
    c = catalog.Catalog(s, folder(s))
    files = s.createDataFrame([("./a.c", 7, "source")], "path string, fid long, kind string")
    rel = s.createDataFrame([("f", "f", 7, "./a.c", 1)], "key string, tag string, fid long, path string, lineno int")
    c.create(files, rel, rel, AS_OF)
    return s.createDataFrame([(k, v) for k, v in c.meta().items() if k != "next_fid"], "name string, value string")


@query("result_round_trip", f"WITH {D_} SELECT path || ':' || lineno || ':' || coalesce(image, '') AS line FROM d WHERE starts_with(key, 'read_') UNION ALL SELECT path || ':' || lineno || ':' || coalesce(image, '') FROM d WHERE starts_with(key, 'scan')")
def _saved(s: SparkSession, d: str) -> DataFrame:
    """A saved result and one appended to it."""
    at = folder(s)
    for p in ("^read_", "^scan"):
        catalog.write_lines(search.search(index.definitions(s, d), p), "grep", at, mode="append", compression="gzip")
    return catalog.read_result(s, at)


@query("map_round_trip", f"WITH {F_} SELECT DISTINCT path AS name, 'S/' || fid || '.html' AS target FROM f")
def _mapped(s: SparkSession, d: str) -> DataFrame:
    at = folder(s)
    catalog.write_map(index.files(s, d).select("path", F.format_string("S/%d.html", "fid").alias("page")).distinct(), "path", "page", at)
    return catalog.read_map(s, at)


@query("map_lookup", "SELECT path AS name, min('S/' || fid || '.html') AS target FROM files WHERE path = (SELECT min(path) FROM files) GROUP BY path")
def _looked_up(s: SparkSession, d: str) -> DataFrame:
    return catalog.first_target(_mapped(s, d), index.files(s, d).agg(F.min("path")).first()[0])


@query("scan_folder", f"WITH {F_} SELECT count(*) AS files, sum(length(path) + 1) AS bytes FROM (SELECT DISTINCT path FROM f WHERE starts_with(path, './tarnbrook/'))")
def _scanned(s: SparkSession, d: str) -> DataFrame:
    """The listing of a folder of text files: their number aside, all bytes are there."""
    at = folder(s)
    names = index.files(s, d).filter(F.col("path").startswith("./tarnbrook/")).select("path").distinct()
    names.write.text(at)
    found = listing.scan(s, at, content=True).filter(F.col("path").endswith(".txt"))
    lines = found.select(F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("x")).filter("x <> ''")
    return lines.agg(F.count("*").alias("files"), F.sum(F.length("x") + 1).alias("bytes"))
