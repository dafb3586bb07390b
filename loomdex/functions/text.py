"""Text functions of the index as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.paths import normal_path

#: A symbol: letters, digits, underscores and any character beyond ASCII, not beginning with a digit.
SYMBOL = r"[A-Za-z_\u0080-\x{10FFFF}][A-Za-z0-9_\u0080-\x{10FFFF}]*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over the value, which is computed once for a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def method_key(tag: Column) -> Column:
    """The name in a scoped tag: what follows the last dot, else the last double colon, else the tag."""
    return F.when(tag.contains("."), F.substring_index(tag, ".", -1)).when(tag.contains("::"), F.substring_index(tag, "::", -1)).otherwise(tag)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """All before the last slash; null without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def local_path(path: Column, directory: Column) -> Column:
    """The path below the directory, null if it isn't there."""
    return F.when(path.startswith(F.concat(directory, F.lit("/"))), F.substring(path, F.length(directory) + 2, F.length(path)))


def last_parts(path: Column, n: int) -> Column:
    """The last n components."""
    return F.substring_index(path, "/", -n)


def relative(path: Column, base: Column) -> Column:
    """An absolute path seen from an absolute directory: ``../`` for each part of the base that isn't shared, then the rest.

    Both are taken in normal form; the directory itself is ``./``."""
    parts = lambda c: F.filter(F.split(normal_path(c), "/"), lambda x: x != "")

    def seen(x: Column) -> Column:
        p, b = x["p"], x["b"]
        shared = F.size(F.filter(F.sequence(F.lit(0), F.least(F.size(p), F.size(b))), lambda i: (i > 0) & (F.slice(p, F.lit(1), i) == F.slice(b, F.lit(1), i))))
        return F.concat(F.repeat(F.lit("../"), F.size(b) - shared), F.array_join(F.slice(p, shared + 1, F.size(p)), "/"))

    out = let(F.struct(parts(path).alias("p"), parts(base).alias("b")), seen)
    return F.when(out == "", F.lit("./")).otherwise(out)


def absolute(path: Column, base: Column) -> Column:
    """A relative path below an absolute directory; an absolute one in its normal form."""
    return normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path)))


def in_root(path: Column, root: Column, cwd: Column) -> Column:
    """The path as ``./...`` from the root, null outside it."""
    full, top = absolute(path, cwd), normal_path(root)
    top = F.when(top == "/", F.lit("")).otherwise(top)
    return F.when(full == top, F.lit("./")).when(full.startswith(F.concat(top, F.lit("/"))), F.concat(F.lit("."), F.substring(full, F.length(top) + 1, F.length(full))))


def encode_path(path: Column, chars: str) -> Column:
    """``%`` and each of the given characters as ``%`` and two hexadecimal digits; dots and slashes always stay."""
    out = F.replace(path, F.lit("%"), F.lit("%25"))
    for c in dict.fromkeys(chars):
        if c not in "%./":
            out = F.replace(out, F.lit(c), F.lit("".join(f"%{b:02x}" for b in c.encode())))
    return out


def decode_path(path: Column) -> Column:
    """The inverse: each ``%hh`` as the byte it stands for; other percent signs stay."""
    parts = F.regexp_extract_all(path, F.lit(r"%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    hexes = F.transform(parts, lambda x: F.when(x.rlike(r"^%[0-9A-Fa-f]{2}$"), F.substring(x, 2, 2)).otherwise(F.hex(F.encode(x, "utf-8"))))
    return F.unhex(F.array_join(hexes, "")).cast("string")


def locate(text: Column, pattern: str, mode: str, icase: bool = False) -> Column:
    """Where a pattern stands, as an offset from 0, null if nowhere: ``first``, ``last``, ``complete`` (0), ``start``
    (the offset after it) or ``end`` (its offset)."""
    t, p = (F.lower(text), pattern.lower()) if icase else (text, pattern)
    at = {
        "first": F.nullif(F.instr(t, p), F.lit(0)) - 1,
        "last": F.when(t.contains(p), F.length(t) - F.length(F.substring_index(t, p, -1)) - len(p)),
        "start": F.when(t.startswith(p), F.lit(len(p))),
        "end": F.when(t.endswith(p), F.length(t) - len(p)),
        "complete": F.when(t == p, F.lit(0)),
    }[mode]
    return at.cast("long")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlight(text: Column, regex: str) -> Column:
    """Every match between the codes for bold red and normal."""
    return F.regexp_replace(text, F.lit(f"({regex})"), F.lit("\u001b[01;31m$1\u001b[m"))


def split_fields(text: Column, n: int) -> Column:
    """At most n fields parted by blanks; the last keeps the rest of the line."""
    return F.split(F.ltrim(text), r"[ \t]+", n)


def parse_xid(text: Column) -> Column:
    """A leading number and what follows it."""
    return F.struct(F.try_to_number(F.regexp_extract(text, r"^(\d+)", 1), F.lit("999999999999999999")).cast("long").alias("fid"), F.regexp_extract(text, r"^\d+[ \t]+([\s\S]*)$", 1).alias("rest"))


def encode_lines(linenos: Column) -> Column:
    """A sorted list of distinct line numbers as text: distances from number to number, runs as ``first-length``."""
    def runs(n: Column) -> Column:
        first = F.filter(n, lambda x, i: (i == 0) | (F.get(n, i - 1) != x - 1))
        last = F.filter(n, lambda x, i: (i == F.size(n) - 1) | (F.get(n, i + 1) != x + 1))
        return F.arrays_zip(first.alias("a"), last.alias("b"))

    def told(runs: Column) -> Column:
        tail = lambda r: F.when(r["b"] > r["a"], F.concat(F.lit("-"), (r["b"] - r["a"]).cast("string"))).otherwise("")
        return F.array_join(F.transform(runs, lambda r, i: F.concat((r["a"] - F.coalesce(F.get(runs, i - 1)["b"], F.lit(0))).cast("string"), tail(r))), ",")

    return let(let(linenos.cast("array<int>"), runs).cast("array<struct<a:int,b:int>>"), told)


def decode_lines(text: Column) -> Column:
    """The inverse of encode_lines."""
    def step(acc: Column, token: Column) -> Column:
        first = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.split(token, "-")[0].cast("int")
        return F.concat(acc, F.sequence(first, first + F.coalesce(F.get(F.split(token, "-"), 1).cast("int"), F.lit(0))))

    return F.aggregate(F.filter(F.split(text, ","), lambda x: x != ""), F.array().cast("array<int>"), step)


def anchor_kind(db: Column, tag: Column, image: Column) -> Column:
    """M, T, D for definitions (a macro, a type, a function), R for references, Y for other symbols."""
    called = F.contains(F.regexp_replace(image, r"[ \t]+\(", "("), F.concat(tag, F.lit("(")))
    return F.when(db == 2, "R").when(db == 3, "Y").when(F.ltrim(image).startswith("#"), "M").when(F.ltrim(image).rlike(r"^typedef\b"), "T").when(called, "D").otherwise("T")


def include_name(image: Column) -> Column:
    """The last component of what an include or import line names; null for other lines."""
    target = F.regexp_extract(image, r"""^[ \t]*#[ \t]*(?:include|import|include_next)\b[ \t]*[<"]([^">]+)[">]""", 1)
    php = F.regexp_extract(image, r"""^[ \t]*(?:include|include_once|require|require_once)\b[ \t(]*['"]([^'"]+)['"]""", 1)
    return F.when(target != "", base_name(target)).when(php != "", base_name(php))


def detab(text: Column | str) -> Column:
    """Tabs of a line as blanks up to the next multiple of eight columns."""
    line = F.col(text) if isinstance(text, str) else text

    def step(acc: Column, part: Column) -> Column:
        return let(F.concat(acc, part), lambda x: F.rpad(x, ((F.floor(F.length(x) / 8) + 1) * 8).cast("int"), F.lit(" ")))

    def whole(parts: Column) -> Column:
        return F.concat(F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lit(""), step), F.element_at(parts, -1))

    return F.when(line.contains("\t"), let(F.split(line, "\t", -1), whole)).otherwise(line)


#: Words that line images are shortened by, with the letter that stands for each (fixed values).
SHORT = {"d": "define", "t": "typedef"}
_NAME = r"[A-Za-z0-9_\u0080-\x{10FFFF}]"


def short_image(image: Column | str, tag: Column | str) -> Column:
    """A line image in the index's short form: @n for the tag, @d and @t for ``define`` and ``typedef``, @ and a digit
    (or a number in braces) for a run of blanks, @@ for an at sign. Null where either is null."""
    image, tag = (F.col(x) if isinstance(x, str) else x for x in (image, tag))
    out = F.replace(image, F.lit("@"), F.lit("@@"))
    own = F.concat(F.lit(rf"(?<!{_NAME})\Q"), F.replace(tag, F.lit("@"), F.lit("@@")), F.lit(rf"\E(?!{_NAME})"))
    out = F.when(tag == "", out).otherwise(F.regexp_replace(out, own, F.lit("@n")))
    for letter, word in SHORT.items():
        out = F.regexp_replace(out, rf"(?<!{_NAME}){word}(?!{_NAME})", f"@{letter}")
    pieces = F.regexp_extract_all(out, F.lit(" {2,}| |[^ ]+"), F.lit(0))
    size = lambda x: F.length(x).cast("string")
    blanks = lambda x: F.when(F.length(x) < 10, F.concat(F.lit("@"), size(x))).otherwise(F.concat(F.lit("@{"), size(x), F.lit("}")))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.startswith("  "), blanks(x)).otherwise(x)), "")


def long_image(image: Column | str, tag: Column | str) -> Column:
    """The inverse of short_image."""
    image, tag = (F.col(x) if isinstance(x, str) else x for x in (image, tag))
    pieces = F.regexp_extract_all(image, F.lit(r"@@|@[ndt]|@[0-9]|@\{[0-9]+\}|[^@]+|@"), F.lit(0))

    def one(x: Column) -> Column:
        out = F.when(x == "@@", "@").when(x == "@n", tag)
        for letter, word in SHORT.items():
            out = out.when(x == f"@{letter}", word)
        run = F.regexp_extract(x, r"^@\{?([0-9]+)\}?$", 1)
        return out.when(run != "", F.repeat(F.lit(" "), run.cast("int"))).otherwise(x)

    return F.when(tag.isNotNull(), F.array_join(F.transform(pieces, one), ""))


def styled(path: Column, root: str, base: str, style: str) -> Column:
    """A path ``./x`` of the project at ``root`` as output shows it: ``through`` as it is, ``absolute``, ``relative`` to the directory
    ``base``, or ``shorter``, whichever of the last two has fewer characters (relative if they have as many)."""
    full = F.concat(F.lit(root.rstrip("/")), F.substring(path, 2, 1 << 30))
    near = relative(full, F.lit(base))
    return {"through": path, "absolute": full, "relative": near, "shorter": F.when(F.length(near) > F.length(full), full).otherwise(near)}[style]
