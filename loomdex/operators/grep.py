"""Search in lines and in paths."""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import SYMBOL
from loomdex.operators.patterns import is_plain, java_regex


LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def ascii_lower(text: Column) -> Column:
    """The text with A to Z as small letters; other characters stay."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def line_matches(image: Column, pattern: str, literal: bool = False, icase: bool = False, basic: bool = False) -> Column:
    """Whether a line holds the pattern. Literal patterns, and those of letters, digits and blanks only, are looked for as
    they are, a line end parting alternatives and icase meaning ASCII letters; an empty pattern matches nothing."""
    if not pattern:
        return F.lit(False)
    if literal or is_plain(pattern):
        one = lambda p: ascii_lower(image).contains(p.translate(LOWER)) if icase else image.contains(p)
        return reduce(lambda a, b: a | b, [one(p) for p in pattern.split("\n") if p], F.lit(False))
    return image.rlike(java_regex(pattern, basic, icase))


def grep(lines: DataFrame, pattern: str, invert: bool = False, **kw: object) -> DataFrame:
    """Matching lines, or with ``invert`` the others (none where there is no pattern)."""
    if not pattern:
        return lines.limit(0)
    hit = line_matches(F.col("image"), pattern, **kw)
    return lines.filter(~hit if invert else hit)


def grep_files(lines: DataFrame, pattern: str, **kw: object) -> DataFrame:
    """Paths with a matching line, each once."""
    return grep(lines, pattern, **kw).select("path").distinct()


def find_paths(files: DataFrame, pattern: str | None, invert: bool = False, literal: bool = False, icase: bool = False, scope: str = "./", kinds: tuple[str, ...] = ("source",)) -> DataFrame:
    """Distinct paths of the given kinds under the scope whose part after it matches; ``^a`` means ``^/a``."""
    out = files.filter(F.col("kind").isin(list(kinds)) & F.col("path").startswith(scope))
    if not pattern:
        return out.select("path").distinct() if pattern is None and not invert else out.limit(0).select("path")
    rest = F.substring(F.col("path"), len(scope.rstrip("/")) + 1, 1 << 30)
    if literal:
        hit = F.lower(rest).contains(pattern.lower()) if icase else rest.contains(pattern)
    else:
        if pattern.startswith("^") and not pattern.startswith("^/"):
            pattern = "^/" + pattern[1:]
        hit = rest.rlike(java_regex(pattern, icase=icase))
    return out.filter(~hit if invert else hit).select("path").distinct()


def complete_paths(files: DataFrame, prefix: str) -> DataFrame:
    """Distinct ends of paths that begin with the prefix, from each place where it stands."""
    rest = F.substring("path", 3, 1 << 30)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(rest), F.lit(1))), lambda i: F.substring(rest, i, F.lit(len(prefix))) == prefix)
    return files.select(F.explode(F.transform(starts, lambda i: F.substring(rest, i, F.length(rest)))).alias("completion")).distinct()


def tokens(lines: DataFrame) -> DataFrame:
    """The token index of the lines: (token, path, lineno), each once. Written sorted by token it answers exact and
    prefix lookups from the files' statistics."""
    words = F.array_distinct(F.regexp_extract_all("image", F.lit(SYMBOL), F.lit(0)))
    return lines.select(F.explode(words).alias("token"), "path", "lineno").distinct()
