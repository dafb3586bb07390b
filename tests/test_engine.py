from dataclasses import replace

import pytest

from loomdex.engine import Index, Menu


@pytest.fixture(scope="module")
def idx(rows_module):
    r = rows_module
    return Index(
        r([(1, "./a.c", "source"), (2, "./b.h", "source"), (3, "./n.txt", "other")], "fid long, path string, kind string"),
        r([("f", "f", 1, "./a.c", "r", 3, "int f(int x) {"), ("v", "v", 1, "./a.c", "r", 2, "int v;")], "key string, tag string, fid long, path string, repo string, lineno int, image string"),
        r([("f", "f", "./b.h", 1), ("q", "q", "./a.c", 4), ("v", "v", "./a.c", 4)], "key string, tag string, path string, lineno int"),
        r([("./a.c", 1, '#include "sys/b.h"'), ("./a.c", 2, "int v;"), ("./a.c", 3, "int f(int x) {"), ("./a.c", 4, "v = q;"), ("./b.h", 1, "int f(int);"), ("./n.txt", 1, "f and v")], "path string, lineno int, image string"),
    )


@pytest.fixture(scope="module")
def rows_module(spark):
    return spark.createDataFrame


def at(df):
    return sorted((x.path, x.lineno) for x in df.collect())


def test_menu(idx):
    assert at(idx.command("0v")) == [("./a.c", 2), ("./a.c", 4)]
    assert at(idx.command("1 f")) == [("./a.c", 3)]
    assert at(idx.command("3f")) == [("./b.h", 1)]
    assert at(idx.command("4f(int")) == [("./a.c", 3), ("./b.h", 1)]
    assert at(idx.command("6^int.*\\(")) == [("./a.c", 3), ("./b.h", 1)]
    assert [x.path for x in idx.command("7\\.h$").collect()] == ["./b.h"]
    assert at(idx.command("8b.h")) == [("./a.c", 1)]
    assert at(idx.command("9v")) == [("./a.c", 4)]
    assert [x.image for x in idx.command("5 v;").collect()] == ["int \x1b[01;31mv;\x1b[m"]
    assert [(x.tag, x.lineno) for x in idx.command("2f").collect()] == [("v", 4)]
    assert idx.command("1") is None and idx.command("zx") is None
    m = Menu(idx, lambda: idx)
    assert at(m.run("1F")) == [] and m.run("c") is None and at(m.run("1F")) == [("./a.c", 3)]
    m.run("r")
    assert at(m.run("1F")) == [] and m.run("q") is None and m.run("1f") is None and not m.open


def test_libraries(idx):
    d = idx.defs.sparkSession.createDataFrame([("f", "f", 1, "./a.c", "own", 3, "int f() {"), ("g", "g", 2, "./l.c", "lib", 1, "int g() {"), ("g", "g", 3, "./m.c", "more", 1, "int g() {"), ("f2", "f2", 2, "./l.c", "lib", 5, "int f2() {")], idx.defs.schema)
    i = replace(idx, defs=d).with_libraries("own", "lib", "more")
    assert at(i.definitions("^f")) == [("./a.c", 3)] and at(i.definitions("g")) == [("./l.c", 1)] and at(i.definitions("none")) == []
    assert [x.key for x in i.complete("g").collect()] == ["g"] and [x.key for x in i.complete("f").collect()] == ["f"]
    assert at(i.from_here("g", "./a.c", 9)) == [("./l.c", 1)]


def test_places(idx):
    assert at(idx.from_here("f", "./a.c", 3)) == [("./b.h", 1)]
    assert at(idx.from_here("f", "./b.h", 1)) == [("./a.c", 3)]
    assert at(idx.from_here("q", "./a.c", 4)) == [("./a.c", 4)]
    with pytest.raises(ValueError):
        idx.from_here("f.*", "./a.c", 1)


def test_case_kinds_and_output(idx):
    assert at(idx.with_case(True).definitions("F")) == [("./a.c", 3)] and at(idx.definitions("F")) == []
    assert at(idx.grep("f and", kinds=("other",))) == [("./n.txt", 1)] and at(idx.grep("f and")) == []
    assert [x.line for x in idx.show(idx.references("f"), "grep").collect()] == ["./b.h:1:int f(int);"]
    assert [x.line for x in idx.show(idx.paths("a.c"), "path").collect()] == ["./a.c"]
    assert idx.single(idx.definitions("f")).first().lineno == 3 and idx.single(idx.definitions(None)) is None
    assert [x.key for x in idx.complete("", 1).collect()] == ["f"]
    assert {k: v.count() for k, v in idx.pages().items()} == {"duplicates": 2, "titles": 2, "alphabet": 2, "directories": 1, "entries": 0, "includes": 1, "navigation": 1}


def test_over_tables(spark, data):
    assert Index.of_tables(spark, data).definitions("^read_").count() > 0
