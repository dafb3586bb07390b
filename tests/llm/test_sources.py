"""Syntax, origin and term counts."""

import ast

import pytest
from pyspark.sql import functions as F

from loomdex.common import table
from loomdex.llm import frequency, handwritten, queries, syntax
from loomdex.llm.gll import END, Grammar
from loomdex.llm.syntax import well_formed
from tests.oracle import canonical, connect


# --- the recogniser ---
def test_ambiguous_left_recursive_and_empty_rules():
    g = Grammar("s = s s | 'a' | ; t = t '+' t | N ; u = ( 'x' | 'x' 'y' )* 'y'? ;")
    assert g.accepts(("s",), ["a"] * 6 + [END]) and not g.accepts(("s",), ["a", "b", END])
    assert g.accepts(("t",), ["N", "+", "N", "+", "N", END]) and not g.accepts(("t",), ["N", "+", END])
    assert g.accepts(("u",), ["x", "y", "x", "y", END])


def test_against_brute_force():
    import itertools

    g = Grammar("s = 'a' s 'b' s | 'c'? ;")

    def brute(t):
        if t in ("", "c"):
            return True
        return t[:1] == "a" and any(t[i] == "b" and brute(t[1:i]) and brute(t[i + 1 :]) for i in range(1, len(t)))

    for n in range(7):
        for t in map("".join, itertools.product("abc", repeat=n)):
            assert (n in g.ends(("s",), (*t, END), 0)[0]) == brute(t), t


GOOD = {
    "c": ["", "int x;", "#if 0\nnot (code\n#endif\nint x;\n#if 0\n{\n#else\nint y;\n#endif\n#ifndef H\n#define H\nint z;\n#endif", "int f(a, b) int a; char *b; { return a ? b[0] : -1; }", '#if A\nint f(int a)\n#else\nint f(long a)\n#endif\n{ return 0; } // "', "struct s { int a : 3; struct { int b; } c; } *p = &(struct s){ .a = 1 }, q[2] = { [0] = { 1 } };", "typedef int (*fp)(int, ...); fp t[] = { f, g };", "void f(void) { for (int i = 0, *p = q; i < (int)sizeof(int); i++) { switch (i) { case 1: default: x: goto x; } } do ; while (0); }", "#define F(x) do { x } while (\nint y;", "static const char *s = \"a\" \"b\" PRI \"c\";", "MODULE(\"x\");\nint class, new;", "enum { A = 1, B, };", "static API int f(u32 x, const T *y);\nunsigned long int x; const struct s *p; T a; T *b(T c);\nint (*g(int a))(char) { return 0; }", "__attribute__((noreturn)) void f(void);"],
    "cpp": ["template <typename T, int N = 3> class A : public B<T>, private C { public: A() : x(1), y{2} {} virtual ~A() = default; T operator+(const A& o) const noexcept { return x + o.x; } private: T x; int y; };", "namespace a::b { using namespace std; using X = vector<vector<int>>; auto f = [&](auto x) mutable -> int { return x; }; }", "int main() { for (auto& [k, v] : m) std::cout << k << static_cast<int>(v) << std::endl; try { throw 1; } catch (...) { } if (auto p = f(); p) return 0; return a < b && c > d; }", "enum class E : int { A, B = 2 };", "int A::f(int x) const { delete[] p; p = new int[3]; return a->b<int>(x); }", 'auto s = R"x(")x";'],
    "java": ["package a.b; import static c.D.*; @Ann(x = 1) public class A<T extends B> extends C implements D<T> { int[] x = {1, 2}, y; static { f(); } A() { super(); } <U> U f(final List<? super U> a, int... b) throws E { for (String s : a) { x.y(z -> z + 1, A::new); } switch (b) { case 1: case 2 -> g(); default: } return (U) a.get(0); } enum Q { X(1) { }, Y; int z; } interface I { default void h() {} } record R(int a) { } }", "import vavo.record.*; class record { int record; }"],
    "javascript": ["'use strict'; const {a, b = 1, ...c} = d, [e] = f; export default class X extends Y { static #p = 1; get q() { return `a${b + `c${d}`}` } async *r() { yield* s } }", "a = b\nc = d\nfor (const x of y) if (/[/]\\//g.test(x)) continue\nlabel: while (1) break label", "!function(a){return a?1:{b:2,'c':[,1,],d(){}}}([]);var x=async(y)=>({...y});x?.y?.[z]??1", "return_ = a / b / c; x = y ? z : w => w;"],
    "python": ["x = 1\nif x:\n    pass\nelif y: z\nelse:\n\treturn_ = [a for b in c if d]\n", "def f(a, *b, c=1, **d) -> int:\n    '''x\n<<<<<<<\n'''\n    return lambda y: (yield)\n\n@x.y(1)\nclass A(B, metaclass=C): ...\n", "print 'a', b\nexec 'c' in d\nraise E, 'x'\n", "async def f():\n    async with a as b, c: await d\n    x: int = y[1:2, ::3]\n    z = w = {**a, 'b': 1}\n", "match x:\n    case [1, y] if y: pass\n", "type = 1; match = type(2); print(match)\n"],
    "php": ["no php at all <<<<<<<", "<?php function f(int $a, ?B &...$c): array { return ['x' => 1, ...$y][0] ?? null; }", "<html><?= $x ?><?php if ($a): ?>b<?php elseif ($c): ?>d<?php endif ?></html>", "<?php $x = <<<EOT\n<<<<<<< a {$b['c']}\nEOT;\nclass A extends B implements C { use T; const X = 1; public static ?int $y = 2; abstract function f(); } $f = fn($x) => $x->{'a'}()::B;", "<?php switch ($a) { case 1: default: echo 'x', \"y\"; } try { } catch (A | B $e) { } finally { }"],
    "asm": [" .text\n .globl f\nf:\tmovl %edi, -4(%rbp) # x (((\n\taddl $1, %eax; ret\n.Lm:\n\t.asciz \"a b\"\n", "# <<<<<<< x\n#define A(x) x\n\tmov r0, #5\n\tldr r1, [r2, #4]!\n\tjmp *%rax\n\tmovl foo+4(,%ebx,4), %eax\n", "x = 1 + 2\n\t.byte 0x1,0x2\n1:\tjmp 1b\n"],
    "yacc": ["%{\n#include <x>\n%}\n%token A B\n%left '+'\n%union { int i; }\n%%\na : b '+' c { $$ = f($1, @2); } | /* none */ | error ';' ;\nb: A %prec B { if ($1) { x(); } } c\n%%\nint main(void) { return yyparse(); }\n"],
}
BAD = {
    "c": ["int f(void) {", "int x", "int f(void) { return 1 }", "<<<<<<< HEAD\nint x;\n=======\n", "#if A\nint x;", "#endif", '#include "a', "int f(void) { int a = (1; }", 'char *s = "a;\n', "/* x", "import java.util.List;", "Some words of prose.", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-int x;\n+int y;\n", "int f(void) { } }", "struct s { int a; }\nstatic int f(void) { return 1; }", "int f\n{ return 1; }", "# python comment\nx = 1", "#ifndef H\n#define H\nint f(void) {\n#endif", "#ifdef A\nint x = (;\n#endif\nint y;"],
    "cpp": ["class A { int f() { };", "class A { int x; }\nclass B { int y; };", "class A { int x; }\n\ntemplate <typename T> int f();", "namespace a {", "template <typename T int f();", "int f() { return a <; }", "<!DOCTYPE html>\n<html></html>"],
    "java": ["public class A { int f( { } }", "class A { void f() { x = ; } }", "class A { void f() { g() } }", "#include <x>\nint f() { }", "package a"],
    "javascript": ["function f( { }", "var x = ;", "if (x) { y", "a b", "x = 'abc\n", "x = `a${b", "package a.b;\nclass X { }", "<html></html>"],
    "python": ["def f():\n", "if x:\npass\n", "x = (1\n", "try:\n    pass\n", "  x = 1\n", "x = 'a\n", "'''", "def f():\n    a\n  b\n", "int x = 1;", "x = = 1\n", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n"],
    "php": ["<?php function f( { }", "<?php $x = 1", "<?php if ($a) { ", "<?php <<<<<<< HEAD", "<?php $x = 'a", "<?php return 1; }", "<?php $a $b;"],
    "asm": ["\tmovl ((( %eax\n", "\t.asciz \"abc\n", "<<<<<<< HEAD\n", "int main(void) { return 0; }\n", "Words of a text that goes on and on.\n"],
    "yacc": ["%token A\n", "%%\na : b { $$ = ( }\n ;\n", "%%\na : b { x(); \n", "%{\nint x\n", "int main() { }\n"],
}


@pytest.mark.parametrize("lang, text", [(k, t) for k, v in GOOD.items() for t in v if t])
def test_well_formed(lang, text):
    assert well_formed(lang, text)
    assert well_formed(lang, "\ufeff" + text.replace("\n", "\r\n"))


@pytest.mark.parametrize("lang, text", [(k, t) for k, v in BAD.items() for t in v])
def test_malformed(lang, text):
    assert not well_formed(lang, text)


def test_long_tables_and_nests():
    numbers = ", ".join(["0x1f", "-2"] * 60_000)
    assert well_formed("c", f"int t[] = {{ {numbers}, }};") and not well_formed("c", f"int t[] = {{ {numbers} , , }};")
    pairs = ", ".join(["'k' => 1"] * 30_000)
    assert well_formed("php", f"<?php return array({pairs});") and not well_formed("php", f"<?php return array({pairs}, 'k' => );")
    assert Grammar("s = 'a' ;").shortened("a , b , b , b , b , c , b , c , b , b".split()) == "a , b , b , b , c , b , c , b , b".split()
    deep = "{" * 300 + "}" * 300
    assert well_formed("c", f"void f(void) {deep}") and not well_formed("c", f"void f(void) {{ {deep}")
    assert well_formed("c", "int x = " + "(" * 300 + "1" + ")" * 300 + ";")


def test_nests_in_texts_of_many_tokens():
    def both(lang, good, bad):
        for n in (1, 2_000):
            filler = "x = 1\n" * 15 * n if lang == "python" else "int x = 1;\n" * 5 * n
            assert well_formed(lang, filler + good) and not well_formed(lang, filler + bad)

    both("c", "int f() { return max(a, max(b, max(c, max(d, max(e, 1))))); }", "int f() { return max(a, max(b, max(c, max(d, max(e, 1)))); }")
    both("c", "int y = f(f(f(f(f(1), 1), 1), 1), 1);", "int y = f(f(f(f(1), 1), 1), 1), 1);")
    both("c", "int y = q ? a, q ? a, q ? a, q ? a, q ? a : b : b : b : b : b;", "int y = q ? a, q ? a, q ? a, q ? a, q ? a : b : b : b : b;")
    both("c", "int y = q ? q ? q ? q ? q ? a : b, a : b, a : b, a : b, a : b;", "int y = (q ? q ? q ? q ? a : b, a : b, a : b, a : b, a : b);")
    both("cpp", "map<a, map<a, map<a, map<a, map<a, b>>>>> y;", "map<a, map<a, map<a, map<a, map<a, b>>>>>> y;")
    both("python", "y = lambda p=lambda p=lambda p=lambda p=lambda: 1, q=1: 1, q=1: 1, q=1: 1, q=1: 1\n", "y = lambda p=lambda p=lambda p=lambda: 1, q=1: 1, q=1: 1, q=1: 1, q=1: 1\n")



def test_every_branch_is_read():
    w = lambda t, lang="c": well_formed(lang, t)
    assert not w("#if A\nint x;\n#elif B\nint ((( y;\n#else\nint z;\n#endif\n") and not w("#if A\nint x;\n#else\nint ((( y;\n#endif\n")
    assert w("#if A\nint x;\n#elif B\nint y;\n#else\nint z;\n#endif\n")
    # a condition that stands twice has one value, whichever way it is asked
    pair = "int f(int a)\n{\n#ifdef A\nif (a) {\n#endif\na++;\n%s\n}\n#endif\nreturn a;\n}\n"
    assert w(pair % "#ifdef A") and w(pair % "#if defined(A)") and w(pair.replace("#ifdef A", "#if !defined A") % "#ifndef A")
    assert w("#ifdef A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n#ifndef A\na++;\n#else\na--;\n#endif\n}")
    assert w("#ifndef H\n#define H\n#ifdef H\nint x;\n#endif\n#endif") and not w("#ifndef H\n#define H\n#ifdef H\nint x\n#endif\n#endif")
    assert w("#if 1\nint x;\n#else\n((\n#endif\n#if 0\n((\n#elif B\nint y;\n#endif") and not w("#if 0\n((\n#elif B\nint y\n#endif")
    nested = "#if A\n#if B\nint x;\n#else\n%s\n#endif\n#else\n#if B\nint y;\n#else\n%s\n#endif\n#endif\n"
    assert w(nested % ("int z;", "int u;")) and not w(nested % ("int z", "int u;")) and not w(nested % ("int z;", "int u"))
    assert w("%%\na : b\n#if A\n { x(); }\n#else\n { y(); }\n#endif\n ;\n", "yacc") and not w("%%\na : b\n#if A\n { x(); }\n#else\n { y() }\n#endif\n ;\n", "yacc")
    assert w('auto s = R"x(\n#if (((\n)x";\n', "cpp")


def test_what_stands_in_strings_of_expressions():
    assert well_formed("javascript", "x = `a${b + `c${ {d: 1}.d }`}e${f}` / 2\ny = `${\n z\n}`") and not well_formed("javascript", "x = `a${ (((( }`") and not well_formed("javascript", "x = `a${b} ${`")
    assert well_formed("python", "x = f'{a!r:>{w}} {{}} {b[\"k\"]:%d} {c=}' rf\"{d}\"\n") and not well_formed("python", "x = f'{a b}'\n") and not well_formed("python", "x = f'{a'\n") and not well_formed("python", "x = f'}'\n")


def test_one_dialect_for_the_whole_text():
    both = [("python", 'print "x"\n', "async def f():\n    if (y := 1): pass\n"), ("python", "try:\n    x\nexcept E, e:\n    y\n", "match z:\n    case 1: pass\n"), ("python", "x = 0777\n", "def f(a: int): pass\n"), ("python", "print `x`, 10L, ur'a'\n", "x = 1_000\n"), ("javascript", "with (a) b()\n", "import c from 'c'\n"), ("php", "<?php $a{0}; ", "enum E: int { case A = 1; }")]
    for lang, a, b in both:
        assert well_formed(lang, a) and well_formed(lang, b if lang != "php" else "<?php " + b) and not well_formed(lang, a + b), (a, b)


def test_a_list_reads_alike_at_any_size():
    for n in (1, 3_000):
        filler = "x = y + 1;\n" * n
        assert not well_formed("javascript", filler + "x = [,[,[,[,[,[,[,[,1]]];") and well_formed("javascript", filler + "x = [,[,[,[,[,[,[,[,1]]]]]]]];")
    choices = ", ".join(["a ? 1 : 2"] * 30_000)
    assert well_formed("c", f"int t[] = {{ {choices} }};") and not well_formed("c", f"int t[] = {{ {choices}, a ? 1 }};")


def test_python_against_its_own_parser(spark, data):
    p = table(spark, data, "parser_param").filter("file LIKE '%.py' AND content <> ''").select("content").distinct().collect()
    for (text,) in p:
        try:
            ast.parse(text.replace("\r\n", "\n").replace("\r", "\n"))
            want = True
        except SyntaxError:
            want = False
        assert well_formed("python", text) == want


LANGS = "lang_name string, parser_name string, bad int"
PARAMS = "param_id long, file string, langmap string, flags int, content string, bad string"


def test_records_and_rates(rows):
    m = "c:.c,cpp:.h.c,python:.py"
    recs = [(1, "./r/a.c", m, 0, "int x;", "z"), (2, "r//b.c", m, 0, "int x", "z"), (2, "r//b.c", m, 0, "int x", "z"), (3, "./r/c.py", m, 0, None, "z"), (4, "./r/d.py", m, 0, "", "z"), (5, "./r/e", m, 0, "(", "z"), (6, "./r/f.c", None, 0, "{", "z"), (7, "./r/g.py", None, 0, "(", "z"), (8, None, m, 0, "(", "z"), (9, "./r/h.rb", "ruby:.rb", 0, "(", "z"), (10, "./r/i.py", "lua:.py", 0, "(", "z")]
    p, langs = rows(recs, PARAMS), rows([("c", "C", 0), ("cpp", "C", 0), ("python", "P", 0), ("python", "P", 0), ("ruby", "R", 0)], LANGS)
    assert sorted(x.param_id for x in syntax.malformed(p, langs).collect()) == [2, 6]
    files = rows([(1, "./r/./b.c", "repo"), (2, "./r/a.c", "repo"), (2, "./r/a.c", "repo")], "fid long, path string, repo string")
    got = {(x.repo, x.lang): (x.records, x.malformed, x.rate) for x in syntax.malformed_rates(p, langs, files).collect()}
    assert got == {("repo", "c"): (2, 1, 0.5), (None, "c"): (1, 1, 1.0), (None, "ruby"): (1, 0, 0.0)}
    assert syntax.malformed(rows([], PARAMS), langs).count() == 0


# --- hand-written or not ---
NOTES = [
    ("./a.c", "/* Generated by tool 1.2 from x.y. DO NOT EDIT */\nint x;", "generated"),
    ("./a.c", "// This file was generated by foo.\nint x;", "generated"),
    ("./a.py", "import x\n# @generated\n", "generated"),
    ("./a.c", "int x;\n/* Created by foo v1.0 from a.spec */\n", "generated"),
    ("./a.c", "#line 3 \"scan.l\"\nint x;", "generated"),
    ("./a.c", "/* Automatisch erzeugte Datei, nicht bearbeiten */", "generated"),
    ("./a.c", "/*\n * Imported from zlib, release 1.2.3.\n */\nint x;", "vendored"),
    ("./third_party/z/a.c", "int x;", "vendored"),
    ("./a_pb2.py", "x = 1", "generated"),
    ("./a.min.js", None, "generated"),
    ("./Auto_row_key.java", "class A { }", "generated"),
    ("./a.c", "/* Writes the file that foo reads. The generated output must not be edited. */\nint x;", None),
    ("./a.c", 'int f() { log("This file was generated by foo"); /* This file was generated by foo. */ return 1; }', None),
    ("./a.c", "/* Do not edit the table below without running gen. */\nint x;", None),
    ("./a.c", "/* Inspired by zlib, but written from scratch here. */\nint x;", None),
    ("./thirdparty_billing/gen_min.c", "int x;", None),
    ("./a.c", "const unsigned char x[] = { " + ", ".join(["0x1f"] * 100) + " };", "data"),
    ("./a.py", "X = (\n" + "".join(f"    '{'Ab0/' * 16}'\n" for _ in range(5)) + ")", "data"),
    ("./a.js", "!function(a){for(var b=0;b<9;b++)a.push(b^3)}([]);" * 12, "minified"),
    ("./a.c", "/* " + "a long note " * 200 + "*/\nint f(int n)\n{\n    return n;\n}\n", None),
    ("./a.c", "", None),
    ("./a.c", None, None),
]


def test_kinds(rows):
    said = rows([(i, p) for i, (p, _, _) in enumerate(NOTES)], "i int, path string").select("i", handwritten.kind_of_path(F.col("path")).alias("k")).collect()
    by = {x.i: x.k for x in said}
    for i, (path, text, want) in enumerate(NOTES):
        assert (by[i] or handwritten.kind_of_text(text, "hash" if path.endswith("py") else "slash")) == want, (path, text)


def copies(rows, recs):
    """The paths of copies among (path, repo, born, content)."""
    d = rows(recs, "path string, repo string, born timestamp, content string").withColumn("born", F.col("born").cast("timestamp_ntz"))
    t = handwritten.read_texts(d.selectExpr("coalesce(path, '/none') AS file", "NULL AS langmap", "content"))
    m = d.withColumn("norm", F.coalesce("path", F.lit("/none"))).join(t.select("norm", "lines", "whole").distinct(), "norm")
    return {x.path for x in handwritten.copies(m, t.select("lines", "h")).collect()}


FILES = "fid long, path string, kind string, lang string, repo string, mtime timestamp, content int"


def test_copies_between_repositories(rows):
    def text(tag, n=20):
        return "\n".join(f"int {tag}_function_number_{i}(void);" for i in range(n))

    edited = text("lib").replace("number_3(", "number_three(") + "\nint a_line_of_its_own_here(void);"
    recs = [("./a/x.c", "a", "2025-01-01", text("lib")), ("./b/x.c", "b", "2025-02-01", edited), ("./c/y.c", "c", "2025-03-01", text("own")), ("./a/z.c", "a", "2025-03-01", text("lib")), ("./d/s.c", "d", "2025-03-01", text("lib", 3)), ("./e/n.c", "e", None, None), ("./f/half.c", "f", "2025-04-01", text("lib", 8) + "\n" + text("more", 12))]
    recs = [(p.strip("."), *x) for p, *x in recs]
    assert copies(rows, recs) == {"/b/x.c", "/d/s.c"}


@pytest.mark.parametrize("earliest", [64, 1])
def test_many_edited_and_short_copies(rows, monkeypatch, earliest):
    monkeypatch.setattr(handwritten, "EARLIEST", earliest)
    lib = [f"int lib_function_number_{i}(void);" for i in range(20)]
    lines = {f"r{k:02}": lib[: k % 20] + [f"int an_edit_of_repository_{k}(void);"] + lib[k % 20 + 1 :] for k in range(80)}
    recs = [(f"/{r}/zip.c", r, f"2025-01-{1 + k // 4:02}", "\n".join(x)) for k, (r, x) in enumerate(lines.items())]
    # a text of lines that stand under all names is none
    recs += [(f"/{r}/file{k}.c", r, "2025-01-01", "\n".join(f"int usual_line_number_{i}(void);" for i in range(12)) + f"\nint a_line_of_{r}_alone(void);") for k, r in enumerate(lines)]
    # nobody before held all of this but by two repositories together; the second to hold it all has one edit
    late = [f"int late_function_number_{i}(void);" for i in range(20)]
    recs += [(f"/x{k}/late.c", f"x{k}", f"2025-02-0{k + 1}", "\n".join(x)) for k, x in enumerate([late[:10], late[10:], late, ["int a_late_line_of_its_own(void);", *late[1:]]])]
    recs += [("/s/short.c", "s", "2025-01-02", "int short_text(void);\r\nx\r\n"), ("/t/short.c", "t", "2025-01-03", "int short_text(void);\nx\n"), ("/t/other.c", "t", "2025-01-03", "int short_text(void);\ny\n"), (None, None, None, "int short_text(void);\nx\n"), ("/s/tiny.c", "s", "2025-01-02", "x"), ("/t/tiny.c", "t", "2025-01-03", "x")]
    assert copies(rows, recs) == {f"/{r}/zip.c" for r in lines if r != "r00"} | {"/x3/late.c", "/t/short.c", "/t/tiny.c"}


def test_recall_of_planted_copies_by_step(rows):
    """Vendored files with local edits among hand-written files that share boilerplate: what each step finds."""
    import random

    r = random.Random(11)
    words = [f"{a}{b}" for a in "read list node path scan open sort hash join walk".split() for b in "er s ing _all _one _by".split()]
    common = ["}", "return 0;", "int i;", "#include <stdio.h>", "for (i = 0; i < n; i++) {", "/* see the manual */"]

    def source(n):
        return [r.choice(common) if r.random() < 0.4 else f"{r.choice(words)}({r.choice(words)}, {r.randint(0, 999)});" for _ in range(n)]

    recs, planted = [], set()
    for k in range(60):  # libraries of one size each, from five lines on
        lines = source(5 + 3 * k)
        recs.append((f"/lib{k % 7}/src/l{k}.c", f"lib{k % 7}", "2024-01-01", "\n".join(lines)))
        for c in range(4):
            copy = list(lines)
            for at in r.sample(range(len(copy)), int(len(copy) * r.choice([0, 0.03, 0.06, 0.1]))):
                copy[at] = f"local_edit_{k}_{c}_{at}();"
            if r.random() < 0.3:
                copy.insert(r.randint(0, len(copy)), f"added_{k}_{c}();")
            path = f"/app{(k + 11 * c) % 23}/deep/l{k}_{c}.c"
            planted.add(path)
            recs.append((path, path.split("/")[1], f"2024-02-{1 + c:02}", ("\r\n" if c == 3 else "\n").join("  " * (c == 2) + x for x in copy)))
    own = [(f"/app{k % 23}/own/o{k}.c", f"app{k % 23}", "2024-03-01", "\n".join(source(r.randint(3, 120)))) for k in range(250)]
    got = copies(rows, recs + own)
    found = got & planted
    assert len(found) >= 0.95 * len(planted) and not got - planted, (len(found), len(planted), sorted(got - planted)[:5])
    said = [handwritten.kind_of_text(t, "slash") for *_, t in own]
    assert not any(said)


def test_paths_nulls_and_repeats(rows):
    gen = "/* Generated by t 1.0 from x.y */\nint x;"
    f = [(1, "./r/a.c", "source", "c", "r", "2025-01-01", 0), (1, "./r/a.c", "source", "c", "r", "2025-01-01", 0), (2, "./r/b.txt", "other", None, "r", None, 0), (3, "./r/n.c", None, None, "r", None, 0), (4, "./r/q.min.js", "source", "javascript", "r", None, 0), (5, None, "source", "c", None, None, 0), (6, "./r/h.c", "source", None, "r", None, 0)]
    p = [(1, "r/./a.c", "c:.c", 0, gen, "z"), (1, "r/./a.c", "c:.c", 0, gen, "z"), (2, "./r/b.txt", "c:.c", 0, gen, "z"), (3, "./r/n.c", None, 0, gen, "z"), (4, "./r/h.c", "c:.c", 0, None, "z"), (5, None, None, 0, gen, "z")]
    got = sorted((x.path, x.kind) for x in handwritten.not_handwritten(rows(f, FILES), rows(p, PARAMS)).collect())
    assert got == [("./r/a.c", "generated"), ("./r/n.c", "generated"), ("./r/q.min.js", "generated")]
    assert handwritten.not_handwritten(rows([], FILES), rows([], PARAMS)).count() == 0


# --- frequency ---
GTP = "gtp_id long, tag string, path string, id int"


def test_counts_and_marks(rows, monkeypatch):
    recs = [(i, "hot", f"./p{i}", 0) for i in range(50)] + [(100, "two", "./p1", 0), (101, "two", ".//p1", 0), (101, "two", ".//p1", 0), (102, "x y", "./only", 0), (103, None, "./q", 0), (104, "nopath", None, 0), (105, "nopath", None, 0), (106, "nopath", "./p1", 0)]
    got = {x.tag: (x.records, x.files, x.all_files) for x in frequency.tag_frequency(rows(recs, GTP)).collect()}
    assert got == {"hot": (50, 50, 52), "two": (2, 1, 52), "nopath": (3, 1, 52)}
    marks = {(x.tag, x.mark) for x in frequency.marked_tags(rows(recs, GTP)).collect()}
    assert marks == {("hot", "common"), ("two", "rare"), ("nopath", None)}
    assert frequency.tag_frequency(rows([], GTP)).count() == 0


def test_dictionary_is_dense(rows):
    d = frequency.dictionary(rows([(f"t{i % 300}",) for i in range(900)], "term string"))
    ids = {x.term: x.id for x in d.collect()}
    assert sorted(ids.values()) == list(range(300))
    spark, width = d.sparkSession, d.sparkSession.conf.get("spark.sql.files.maxPartitionBytes")
    try:  # read by other splits, the terms have the same ids
        spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
        assert {x.term: x.id for x in d.select("*").repartition(7).collect()} == ids
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", width)


def test_blocks_add_up_past_what_is_held(monkeypatch):
    monkeypatch.setattr(frequency, "HELD", 32)
    import numpy as np
    import pyarrow as pa

    n = frequency.BLOCK
    ids = np.array([b * n + b for b in range(80)] * 2)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), 3))], names=["id", "n"])
    sent = [x for out in frequency._blocks(iter([batch, batch])) for x in zip(*(out.column(i).to_pylist() for i in range(4)), strict=True)]
    total = {}
    for block, at, occ, pres in sent:
        for a, o, p in zip(at, occ, pres, strict=True):
            x = total.setdefault(block * n + a, [0, 0])
            x[0] += o
            x[1] += p
    assert total == {b * n + b: [12, 4] for b in range(80)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, data, name):
    got, want = queries.QUERIES[name](spark, data).toPandas(), connect(data).execute(queries.ORACLE[name]).df()
    assert canonical(got) == canonical(want)
