"""Language maps and skip lists: plain Python that ends in one expression on the path."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.text import base_name

#: The default map (fixed values): languages with suffixes, and globs in parentheses.
DEFAULT = "c:.c.h,yacc:.y,asm:.s.S,java:.java,cpp:.c++.cc.hh.cpp.cxx.hxx.hpp.C.H,php:.php.php3.phtml"

#: The map of a file that comes without one.
NO_MAP = "c:.c"


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression for one path component."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (j := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = j
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return out


def merge_map(text: str) -> list[tuple[str, list[str]]]:
    """Languages in order with their suffixes and globs; one language's lists are joined, and of a suffix listed again the
    first stands."""
    seen, out = set(), {}
    for entry in filter(None, text.split(",")):
        lang, _, spec = entry.partition(":")
        for item in re.findall(r"\([^)]*\)|\.[^.(]+", spec):
            if item not in seen:
                seen.add(item)
                out.setdefault(lang, []).append(item)
    return list(out.items())


def map_text(merged: list[tuple[str, list[str]]]) -> str:
    return ",".join(f"{lang}:{''.join(items)}" for lang, items in merged)


def _pattern(items: list[str]) -> str:
    return "^(" + "|".join(glob_regex(x[1:-1]) if x[0] == "(" else ".*" + re.escape(x) for x in items) + ")$"


#: Language and the expression its file names fit, in order.
LANGUAGE_MAP = [(lang, _pattern(items)) for lang, items in merge_map(DEFAULT)]


def language_of(path: Column, text: str = DEFAULT) -> Column:
    """The first language of the map that the path's base name fits; null if none."""
    base = base_name(path)
    return reduce(lambda rest, x: F.when(base.rlike(_pattern(x[1])), x[0]).otherwise(rest), reversed(merge_map(text)), F.lit(None).cast("string"))


def language_in(file: Column, langmap: Column) -> Column:
    """First language of the row's own map, from left to right, that lists the file's suffix; null if none does. Case matters."""
    suffix = F.regexp_extract(file, r"[^/](\.[^./]+)$", 1)
    entries = F.split(F.coalesce(langmap, F.lit(NO_MAP)), ",")
    fits = F.filter(entries, lambda e: F.contains(F.concat(F.substring_index(e, ":", -1), F.lit(".")), F.concat(suffix, F.lit("."))))
    return F.when(suffix != "", F.substring_index(F.get(fits, 0), ":", 1))


def source_pattern(text: str = DEFAULT) -> str:
    """One expression for every path that has a language."""
    return "/(" + "|".join(_pattern(items)[2:-2] for _, items in merge_map(text)) + ")$"


def skipped(path: Column, globs: list[str]) -> Column:
    """Whether a path is left out: hidden files and directories, and the globs; a leading slash binds one to the root, a
    trailing one means a directory."""
    tests = [path.rlike(r"/\.[^./]")]
    for g in globs:
        body = glob_regex(g.strip("/"))
        tests.append(path.rlike(("^\\." if g.startswith("/") else "") + "/" + body + ("/" if g.endswith("/") else "$")))
    return reduce(lambda a, b: a | b, tests)
