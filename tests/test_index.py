"""Worked examples: a project of three files, completion, libraries; storage, updates and the change feed."""

import os
import time

import pytest
from pyspark.sql import functions as F

from loomdex.functions import formats
from loomdex.operators import grep, incremental, reports, search
from loomdex.parsers import symbols, tables
from loomdex.plans import index_queries
from loomdex.sources import catalog, listing
from loomdex.sources.index import split_lines
from loomdex.streaming import feed

PROJECT = {
    "./README": "The function of\n",
    "./DIR1/fileA.c": "main(){\n        func1();\n        func2();\n}\n",
    "./DIR1/fileB.c": "func1(){ ... }\n",
    "./DIR2/fileC.c": "#ifdef X\nfunc2(){ i++; }\n#else\nfunc2(){ i--; }\n#endif\nfunc3(){\n        func1();\n}\n",
}


@pytest.fixture(scope="module")
def project(spark):
    f = spark.createDataFrame([(i + 1, p, "source" if p.endswith(".c") else "other", "c" if p.endswith(".c") else None, t) for i, (p, t) in enumerate(PROJECT.items())], "fid int, path string, kind string, lang string, content string")
    events = tables.parse_files(f)
    defs = tables.definitions_of(events).withColumn("key", F.col("tag"))
    refs = tables.references_of(events).withColumn("key", F.col("tag"))
    lines = f.select("path", "kind", F.posexplode(split_lines(F.col("content"))).alias("pos", "image")).withColumn("lineno", F.col("pos") + 1)
    return f, defs, refs, lines


def paths(df):
    return sorted({x.path for x in df.collect()})


def test_definitions_of_the_project(project):
    _, defs, _, _ = project
    got = sorted((x.tag, x.path, x.lineno) for x in defs.collect())
    assert got == [("func1", "./DIR1/fileB.c", 1), ("func2", "./DIR2/fileC.c", 2), ("func2", "./DIR2/fileC.c", 4), ("func3", "./DIR2/fileC.c", 6), ("main", "./DIR1/fileA.c", 1)]


def test_lookups_of_the_project(project):
    f, defs, refs, lines = project
    assert paths(search.search(defs, "func1")) == ["./DIR1/fileB.c"]
    assert paths(search.search(defs, "func[1-3]")) == ["./DIR1/fileB.c", "./DIR2/fileC.c"]
    assert paths(search.search(search.resolved(refs, defs), "func2")) == ["./DIR1/fileA.c"]
    assert [(x.path, x.lineno) for x in search.search(search.unresolved(refs, defs), "X").collect()] == [("./DIR2/fileC.c", 1)]
    assert [(x.path, x.lineno) for x in grep.grep(lines, "#ifdef").collect()] == [("./DIR2/fileC.c", 1)]
    assert paths(grep.find_paths(f, "fileB")) == ["./DIR1/fileB.c"]
    assert paths(grep.find_paths(f, "1/")) == ["./DIR1/fileA.c", "./DIR1/fileB.c"]
    assert len(paths(grep.find_paths(f, r"\.c$", kinds=("source", "other")))) == 3
    assert sorted((x.tag, x.lineno) for x in search.file_tags(defs, "./DIR2/fileC.c").collect()) == [("func2", 2), ("func2", 4), ("func3", 6)]
    assert paths(search.search(defs, "func[1-3]", scope="./DIR1/")) == ["./DIR1/fileB.c"]
    assert grep.grep(lines, "", invert=True).count() == 0


def test_context(project, rows):
    _, defs, _, _ = project
    c = rows([("func2", "./DIR2/fileC.c", 2), ("func2", "./DIR1/fileA.c", 3), ("i", "./DIR2/fileC.c", 2)], "key string, path string, lineno int")
    assert {(x.key, x.path): x.target for x in search.resolve_context(c, defs).collect()} == {("func2", "./DIR2/fileC.c"): "references", ("func2", "./DIR1/fileA.c"): "definitions", ("i", "./DIR2/fileC.c"): "symbols"}


def test_completion(rows):
    names = "kmem_alloc kmem_alloc_pageable kmem_alloc_wait kmem_free kmem_free_wakeup kmem_init kmem_malloc kmem_suballoc".split()
    rel = rows([(x,) for x in [*names, *names, "kmalloc", None]], "key string")
    assert [x.key for x in search.complete(rel, "kmem").orderBy("key").collect()] == names
    assert search.complete(rel, "KMEM", icase=True).count() == 8


def test_libraries(rows):
    d = rows([("mhl", "project", "./a.c"), ("strlen", "lib", "libc/string/strlen.c"), ("access", "sys", "kern/vfs_syscalls.c"), ("strlen", "sys", "libkern/strlen.c")], "key string, repo string, path string")
    libs = ["project", "lib", "sys"]
    assert paths(search.first_library(d, libs, "strlen")) == ["libc/string/strlen.c"]
    assert len(paths(search.first_library(d, libs, "strlen", through=True))) == 2


def test_parsers():
    def defs(f, t):
        return [(a, n) for k, a, n in f(t) if k == symbols.DEF]

    assert defs(symbols.parse_c, "struct s { int x; } v;\nenum e { A, B };\ntypedef struct { int a; } T, *P;\nint old(a, b)\n int a; char *b;\n{ return g(a); }\nextern void dump_stack(void) __cold;\n#define pr_debug() printk()\n#undef Q") == [("s", 1), ("e", 2), ("A", 2), ("B", 2), ("T", 3), ("P", 3), ("old", 4), ("pr_debug", 8), ("Q", 9)]
    assert defs(symbols.parse_cpp, "using my_type1 = double;\ntypedef std::map<DomainId_t, int> map_t2;\nclass A { A(); ~A() {} int m() { return 1; } };") == [("my_type1", 1), ("map_t2", 2), ("A", 3), ("m", 3)]
    assert defs(symbols.parse_java, "package a;\npublic class C { C() {} int f(int x) { return g(x); } }") == [("C", 2), ("f", 2)]
    assert defs(symbols.parse_php, "function no() {}\n<?php function f() {}\nclass A {}\ndefine('K', 1); ?> class B") == [("f", 2), ("A", 3), ("K", 4)]
    assert symbols.parse_asm("ENTRY(f)\n call _g\n.macro m") == [(1, "f", 1), (2, "g", 2), (1, "m", 3)]
    assert symbols.parse("c", "") == symbols.parse(None, "x") == [] and all(symbols.parse(x, "{{{((('\"/*") is not None for x in symbols.PARSERS)


def test_language_of_the_record_map(spark, tmp_path):
    maps = "cpp:.h.cc,c:.c.inc,asm:.asm"
    recs = [(1, "/a/x.inc", maps, "int f() { return 1; }\n"), (2, "/a/y.asm", maps, "ENTRY(g)\n"), (3, "/a/z.h", maps, "namespace n { class K { int m() { return 1; } }; }\n")]
    recs += [(4, "/a/w.c", None, "int h() { return 1; }\n"), (5, "/a/v.h", None, "int no() { return 1; }\n"), (6, "/a/u.cpp", maps, "int no() { return 1; }\n")]
    rows = [(i, f, m, 0, t) for i, f, m, t in recs]
    spark.createDataFrame(rows, "param_id long, file string, langmap string, flags int, content string").write.parquet(f"{tmp_path}/parser_param.parquet")
    got = {x.tag for x in index_queries.QUERIES["parse_definitions"](spark, str(tmp_path)).collect()}
    assert got == {"f", "g", "n", "K", "m", "h"}


def test_flags_force_the_level(spark, tmp_path):
    text = "int f()\n{\n if (x) {\n}\n\nint g()\n{\n return 1;\n}\n"
    late = "int f() {\n if (x) {\n\nint k;\n{\n }\n}\nint g() { return 1; }\n"

    def defs(lang, t, flags):
        return [x[1] for x in symbols.parse(lang, t, flags) if x[0] == symbols.DEF]

    for lang in ("c", "cpp", "yacc"):
        assert defs(lang, text, 0) == defs(lang, text, None) == defs(lang, text, 4) == ["f"] and defs(lang, text, 8) == ["f", "g"]
        assert defs(lang, late, 0) == ["f"] and defs(lang, late, 16) == ["f", "g"]
    # name spaces have no level
    inside = "namespace n {\nint f()\n{\n if (x) {\n}\nint g()\n{\n}\n}\n"
    assert defs("cpp", inside, 0) == ["n", "f"] and defs("cpp", inside, 8) == ["n", "f", "g"]
    spark.createDataFrame([(1, "a.c", None, 8, text), (2, "b.c", None, None, text)], "param_id long, file string, langmap string, flags int, content string").write.parquet(f"{tmp_path}/parser_param.parquet")
    got = sorted((x.path, x.tag) for x in index_queries.QUERIES["parse_definitions"](spark, str(tmp_path)).collect())
    assert got == [("./a.c", "f"), ("./a.c", "g"), ("./b.c", "f")]
    tables.register_udtf(spark)
    assert [x.tag for x in spark.sql(f"SELECT tag FROM (SELECT content AS t FROM parquet.`{tmp_path}/parser_param.parquet` WHERE param_id = 1), LATERAL parse_symbols('c', t, 8) WHERE kind = 1").collect()] == ["f", "g"]


def test_udtf(spark, project):
    tables.register_udtf(spark)
    project[0].createOrReplaceTempView("project_files")
    got = spark.sql("SELECT path, tag FROM project_files, LATERAL parse_symbols(lang, content) AS e WHERE project_files.kind = 'source' AND tag = 'func3'").collect()
    assert [(x.path, x.tag) for x in got] == [("./DIR2/fileC.c", "func3")]


def test_formats(rows):
    d = rows([("main", "./a.c", 10, "\tmain() {", 3), ("x", "./b.c", 2, None, 4)], "tag string, path string, lineno int, image string, fid int")
    got = {k: [x.line for x in formats.render(d, k).collect()][0] for k in ("ctags", "ctags-x", "ctags-xid", "ctags-mod", "grep", "cscope", "path")}
    assert got["ctags-x"] == "main               10 ./a.c            \tmain() {" and got["ctags-xid"].startswith("3 main")
    assert (got["ctags"], got["grep"], got["cscope"], got["path"]) == ("main\t./a.c\t10", "./a.c:10:\tmain() {", "./a.c main 10 main() {", "./a.c")
    assert formats.render(d, "cscope").collect()[1].line == "./b.c x 2 <unknown>"


def test_call_tree(rows):
    t = rows([(1, "main() <int main (void) at> <./a.c 3>"), (2, "    sub: void, <./dir/../b.c 7>"), (3, "    gone: <>")], "seq int, line string")
    f = rows([(9, "./b.c")], "fid int, path string")
    got = {x.name: (x.depth, x.lineno, x.fid) for x in reports.call_tree(t, f).collect()}
    assert got["sub"] == (4, 7, 9) and got["gone"] == (4, None, None)


def test_changes_equal_rebuild(rows):
    known = rows([("./a", "source", 1), ("./b", "source", 2), ("./c", "other", 3), ("./d", "source", 5)], "path string, kind string, fid long")
    new = rows([("./a", "2025-01-02", "source"), ("./b", "2025-03-01", "source"), ("./c", "2025-03-01", "other"), ("./e", "2025-01-01", "source"), ("./e", "2025-01-01", "source")], "path string, mtime timestamp, kind string")
    ch = incremental.change_set(known, new, "2025-02-01 00:00:00")
    assert {(x.path, x.action) for x in ch.collect()} == {("./b", "modify"), ("./d", "delete"), ("./e", "add")}
    assert sorted((x.path, x.fid) for x in incremental.apply_changes(known, ch, 5).collect()) == [("./a", 1), ("./b", 2), ("./c", 3), ("./e", 6)]


def test_catalog(spark, rows, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "idx"))
    files = rows([("./a.c", 1, "source"), ("./b.c", 2, "source")], "path string, fid long, kind string")
    rel = lambda v: rows(v, "key string, tag string, fid long, path string, lineno int")
    c.create(files, rel([("f", "f", 1, "./a.c", 1), ("g", "g", 2, "./b.c", 1)]), rel([]), "2025-01-01 00:00:00")
    new = rows([("./a.c", "2025-02-01", "source"), ("./c.c", "2025-02-01", "source")], "path string, mtime timestamp, kind string")
    parse = lambda f: (f.selectExpr("'new' key", "'new' tag", "fid", "path", "1 lineno"), rel([]))
    assert c.update(new, parse, "2025-02-02 00:00:00") == {"add": 1, "modify": 1, "delete": 1}
    assert sorted((x.key, x.fid) for x in c.read("defs").collect()) == [("new", 1), ("new", 3)]
    assert c.meta()["next_fid"] == "4" and c.update(new, parse, "2025-02-03 00:00:00") == {} and c.meta()["current"] == "2"
    c.put_meta(9, format=99)
    with pytest.raises(ValueError):
        c.meta()


def test_text_outputs(spark, rows, tmp_path):
    d = rows([("t", "./a.c", 1, "t()")], "tag string, path string, lineno int, image string")
    for _ in range(2):
        catalog.write_lines(d, "grep", str(tmp_path / "saved"), mode="append")
    assert [x.line for x in catalog.read_result(spark, str(tmp_path / "saved")).collect()] == ["./a.c:1:t()"] * 2
    catalog.write_map(d, "tag", "path", str(tmp_path / "map"))
    assert catalog.first_target(catalog.read_map(spark, str(tmp_path / "map")), "t").first().target == "./a.c"


def test_listings(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.c").write_text("int x;\n")
    (tmp_path / "y.bin").write_bytes(b"a\x00b")
    os.symlink(tmp_path, tmp_path / "d" / "loop")
    assert paths(listing.walk(spark, str(tmp_path))) == ["./d/x.c", "./y.bin"]
    scanned = listing.scan(spark, str(tmp_path), content=True).select("path", listing.is_binary(F.col("content")).alias("b"))
    assert {(x.path, x.b) for x in scanned.collect()} >= {("./d/x.c", False), ("./y.bin", True)}
    (tmp_path / "names").write_text("d/x.c\n\n. note\n./d/../d/x.c\n../out.c\n/elsewhere/z.c\n")
    assert paths(listing.from_names(spark, str(tmp_path / "names"), str(tmp_path))) == ["./d/x.c"]
    why = {x.path: (x.kind, x.reason) for x in listing.explained(listing.walk(spark, str(tmp_path)), skip=["d/"]).collect()}
    assert why["./d/x.c"] == ("source", "on the skip list") and why["./y.bin"][1] == "no language for the suffix"


def test_config():
    text = "# note\ncommon:skip=a,b:langmap=c\\:.c:\\\n  colour:\ndefault|own:tc=common:skip=$EXTRA:depth#3:\nloop:tc=loop:\n"
    got = listing.read_config(text, "own", {"EXTRA": "z"})
    assert got == {"skip": ["a,b", "z"], "langmap": ["c:.c"], "colour": True, "depth": 3}
    with pytest.raises(ValueError):
        listing.read_config(text, "loop")
    with pytest.raises(KeyError):
        listing.read_config(text, "none")


def test_feed_equals_batch(spark, rows, tmp_path):
    ev = [("./a", "add", "2025-01-01"), ("./b", "add", "2025-01-01"), ("./a", "modify", "2025-01-03"), ("./b", "delete", "2025-01-02"), ("./a", "delete", "2025-01-02"), ("./a", "modify", "2025-01-03")]
    schema = feed.EVENT
    for part in (ev[:3], ev[3:]):
        rows(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    q = feed.maintain(feed.read_feed(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    last = max(int(x[1:]) for x in os.listdir(tmp_path / "out"))
    got = {(x.path, x.alive) for x in spark.read.parquet(str(tmp_path / "out" / f"v{last}")).collect()}
    empty = spark.createDataFrame([], "path string, mtime timestamp, alive boolean")
    assert got == {(x.path, x.alive) for x in feed.apply_events(empty, rows(ev, schema)).collect()} == {("./a", True), ("./b", False)}


def test_upsert(rows):
    old = rows([("a", 1, "x"), ("b", 5, "y")], "k string, n int, v string")
    new = rows([("a", 2, "z"), ("b", 5, "w"), ("c", 1, None)], "k string, n int, v string")
    assert {(x.k, x.v) for x in incremental.upsert(old, new, ["k"], "n").collect()} == {("a", "z"), ("b", "w"), ("c", None)}
