import posixpath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.functions.paths import fid_number, is_tag, normal_path
from loomdex.operators.patterns import access, java_regex, literal_prefix, trim_anchors
from loomdex.operators.search import nearness
from loomdex.sources import languages
from loomdex.sources.index import split_lines


def column(spark, values, expr, schema="v string"):
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema).select("i", expr.alias("x")).orderBy("i").collect()
    return [r.x for r in got]


def test_normal_path(spark):
    table = {"/a": "/a", "./a/./b/c": "a/b/c", "a////b///c": "a/b/c", "../a/b/c": "../a/b/c", "a/d/../b/c": "a/b/c", "a/../b/../c/../d": "d", "a/../../d": "../d", "/a/../../d": "/d", ".//x/y.c": "x/y.c", "a..b/..c/d..": "a..b/..c/d..", None: None}
    assert column(spark, list(table), normal_path(F.col("v"))) == list(table.values())


def test_normal_path_against_library(spark):
    import random

    r = random.Random(3)
    paths = ["/".join(r.choice(["a", "bb", "..", ".", "", "c.d"]) for _ in range(r.randint(1, 8))) for _ in range(600)]
    paths = [p for p in paths if p.strip("/")]
    want = [x if (x := posixpath.normpath(p)) != "." else "" for p in paths]
    assert column(spark, paths, normal_path(F.col("v"))) == [w[1:] if w.startswith("//") else w for w in want]


def test_tags_and_fids(spark):
    assert column(spark, ["a", "", "a b", "a\n", "é" * 255, "é" * 256, None, "x" * 511, "\x0b"], is_tag(F.col("v"))) == [True, False, False, False, True, False, False, True, False]
    assert column(spark, ["7", " 007 ", "0", "000", "", "?", None, "4.5", "-3", "\t12\n"], fid_number(F.col("v"))) == ["7", "7", "0", "0", None, None, None, None, None, "12"]


def test_patterns():
    a = access
    assert [(a(p).mode, a(p).text) for p in ("abc", "^abc", "^abc.*", "^abc.*$", "^abc$", ".*", "^", "")] == [("exact", "abc"), ("prefix", "abc"), ("prefix", "abc"), ("prefix", "abc"), ("exact", "abc"), ("scan", ""), ("scan", ""), ("none", "")]
    assert a("a[bc]").mode == "regex" and a(None).mode == "scan" and a("a[bc]", literal=True).mode == "exact"
    assert a("^foo.*x").prefix == "foo" and a("^foo?x").prefix is None and a("^a|b").prefix is None
    assert trim_anchors("^a$") == "a" and trim_anchors("^a.$") == "^a.$" and literal_prefix("abc") is None


@pytest.mark.parametrize("pattern, basic, yes, no", [("[[:alpha:]]+z", False, "qz", "1z"), (r"\(ab\)*c", True, "ababc", "ab"), (r"a(b)", True, "a(b)", "ab"), ("[]x]", False, "]", "y"), ("[^[:space:]]$", False, "a", "a "), ("a.b", False, "a\rb", "ab"), ("[a&&b]", False, "&", "c"), (r"a\{2\}", True, "aa", "a{2}")])
def test_dialects(spark, pattern, basic, yes, no):
    assert column(spark, [yes, no], F.col("v").rlike(java_regex(pattern, basic))) == [True, False]


@pytest.mark.parametrize("pattern", ["a\\", "[a", "[[:none:]]", "\\d", "[[.a.]]"])
def test_what_has_no_counterpart(pattern):
    with pytest.raises(ValueError):
        java_regex(pattern)


def test_lines(spark):
    cases = {"a\nb\n": ["a", "b"], "a\r\nb\r": ["a", "b\r"], "\n": [""], "a": ["a"], "a\n\nb": ["a", "", "b"], "a\rb\r\r\n": ["a\rb\r"]}
    assert column(spark, list(cases), split_lines(F.col("v"))) == list(cases.values())


def test_line_codec(spark):
    lists = {"10,3,2": [10, 13, 15], "10-3": [10, 11, 12, 13], "1-1,4,2-2": [1, 2, 6, 8, 9, 10], "5": [5]}
    assert column(spark, list(lists.values()), text.encode_lines(F.col("v")), "v array<int>") == list(lists)
    assert column(spark, list(lists), text.decode_lines(F.col("v"))) == list(lists.values())


def test_image_codec_round_trip(spark):
    import random

    r = random.Random(9)
    parts = ["a", " ", "  ", "@", "n", "d", "t", "1", "{", "}", "_", "define", "typedef", "macro", "\u00e9", " " * 11, "\\E"]
    rows = [("".join(r.choice(parts) for _ in range(r.randint(0, 14))), r.choice(["macro", "n", "a", "define", "", "d", "@x"])) for _ in range(600)] + [(None, "a"), ("a", None)]
    got = spark.createDataFrame(rows, "image string, tag string").withColumn("s", text.short_image("image", "tag")).withColumn("l", text.long_image("s", "tag")).collect()
    assert [(x.image, x.tag, x.s, x.l) for x in got if x.l != (x.image if x.tag is not None else None)] == []


def test_tabs_against_library(spark):
    import random

    r = random.Random(8)
    rows = [("".join(r.choice("ab\t \u00e9") for _ in range(r.randint(0, 30))),) for _ in range(400)] + [(None,)]
    assert all(x.d == (None if x.v is None else x.v.expandtabs(8)) for x in spark.createDataFrame(rows, "v string").withColumn("d", text.detab("v")).collect())


def test_locate(spark):
    at = lambda p, m, i=False: column(spark, ["ABC XYZ XYZ ABC"], text.locate(F.col("v"), p, m, i))[0]
    assert (at("XYZ", "first"), at("XYZ", "last"), at("XYZ", "start"), at("ABC", "start"), at("ABC", "end"), at("xyZ", "first", True)) == (4, 8, None, 3, 12, 4)


def test_relative_and_absolute(spark):
    rel = lambda p: column(spark, [p], text.relative(F.col("v"), F.lit("/a/b")))[0]
    assert [rel(x) for x in ("/a/b/c", "/a/x", "/x", "/a/b", "/")] == ["c", "../x", "../../x", "./", "../../"]
    assert column(spark, ["../x", "/y", "z/../w"], text.absolute(F.col("v"), F.lit("/a/b"))) == ["/a/x", "/y", "/a/b/w"]
    assert column(spark, ["x", "../..", "/other"], text.in_root(F.col("v"), F.lit("/r"), F.lit("/r/s"))) == ["./s/x", None, None]


def test_encode_path(spark):
    values = ["a b%c", "./é/ü", "100%", "%41"]
    coded = column(spark, values, text.encode_path(F.col("v"), " é./"))
    assert coded[0] == "a%20b%25c" and coded[1] == "./%c3%a9/ü"
    assert column(spark, coded, text.decode_path(F.col("v"))) == values


def test_anchor_kinds(spark):
    got = [column(spark, [i], text.anchor_kind(F.lit(db), F.lit("f"), F.col("v")))[0] for db, i in ((1, "#define f(x)"), (1, "typedef int f;"), (1, "f (int a)"), (1, "struct f {"), (2, "f()"), (3, "f"))]
    assert got == ["M", "T", "D", "T", "R", "Y"]


def test_nearness(spark):
    assert column(spark, ["./a/b/x", "./a/y", "./z"], nearness(F.col("v"), "./a/b/")) == [3, 2, 1]
    assert column(spark, ["./a/b"], nearness(F.col("v"), "./a/b")) == [3]


def test_includes(spark):
    v = ['#include "a/b.h"', "  # include <c.h>", "require_once 'x/y.php';", "#import <z>", "int include;", '#includes "q"']
    assert column(spark, v, text.include_name(F.col("v"))) == ["b.h", "c.h", "y.php", "z", None, None]


def test_language_maps(spark):
    assert languages.map_text(languages.merge_map("C++:.cpp.c++,Java:.java.cpp,C++:.inl")) == "C++:.cpp.c++.inl,Java:.java"
    got = column(spark, ["./a.c", "./Makefile", "./x.C", "./y"], languages.language_of(F.col("v"), "c:.c.h,make:(Make*)(*.mk),cpp:.C"))
    assert got == ["c", "make", "cpp", None]
    assert languages.glob_regex("a?[!b]*.c") == r"a[^/][^b][^/]*\.c"
    assert column(spark, ["./.git/x", "./a/y.o", "./b/z.c", "./tmp/q.c", "./b/tmp"], languages.skipped(F.col("v"), ["*.o", "/tmp/"])) == [True, True, False, True, False]


def test_small_functions(spark):
    assert column(spark, ["a.b.c", "a::b::c", "a::b.c", "x"], text.method_key(F.col("v"))) == ["c", "c", "c", "x"]
    assert column(spark, ["<a & b>"], text.html_escape(F.col("v"))) == ["&lt;a &amp; b&gt;"]
    assert column(spark, ["a\tb", "\t"], text.detab("v")) == ["a       b", "        "]
    assert column(spark, ["  a  b c d"], text.split_fields(F.col("v"), 3)) == [["a", "b", "c d"]]
    assert tuple(column(spark, ["12 rest of it"], text.parse_xid(F.col("v")))[0]) == (12, "rest of it")
