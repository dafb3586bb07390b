"""Which way a pattern is looked up, decided before the plan is built: key, prefix, regular expression or full scan.

Catalyst pushes equality and prefixes down to the files but no regular expression, so a pattern is turned into the
narrowest predicate that has the same rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that make a pattern a regular expression.
META = set("$()*+.?[\\]^{|}")
# Patterns that match every key.
MATCH_ALL = {".*", "^.*$", "^", "$", "^.*", ".*$"}
# POSIX classes and the Java classes of the same ASCII characters.
POSIX = {"alpha": "\\p{Alpha}", "digit": "\\p{Digit}", "alnum": "\\p{Alnum}", "upper": "\\p{Upper}", "lower": "\\p{Lower}", "space": "\\s\\x0B", "blank": " \\t", "punct": "\\p{Punct}", "print": "\\p{Print}", "graph": "\\p{Graph}", "cntrl": "\\p{Cntrl}", "xdigit": "\\p{XDigit}"}


def is_regex(pattern: str) -> bool:
    """True if any character of the pattern is special."""
    return any(c in META for c in pattern)


def trim_anchors(pattern: str) -> str:
    """``^name$`` with a plain name stands for the name."""
    if len(pattern) > 2 and pattern[0] == "^" and pattern[-1] == "$" and not is_regex(pattern[1:-1]):
        return pattern[1:-1]
    return pattern


def literal_prefix(pattern: str) -> str | None:
    """The prefix that ``^abc``, ``^abc.*``, ``^abc.*$`` and ``^abc$`` ask for; null for other patterns."""
    m = re.fullmatch(r"\^(.+?)(?:\.\*\$?|\$)?", pattern, re.S)
    return m[1] if m and not is_regex(m[1]) else None


def quote(text: str) -> str:
    """The text with every character but letters, digits and blanks made literal."""
    return re.sub(r"[^\w\s]", lambda m: "\\" + m[0], text)


def is_plain(pattern: str) -> bool:
    """Only letters, digits, blanks and underscores: searched for as it is."""
    return re.fullmatch(r"[A-Za-z0-9_ \t]+", pattern) is not None


def java_regex(pattern: str, basic: bool = False, icase: bool = False) -> str:
    """A POSIX extended (or basic) expression in Java's dialect; ValueError for what has no counterpart there.

    Character classes become Java classes, brackets lose Java's set operations, a dot stands for any character, a
    dollar for the very end, and in basic expressions the plain and the escaped forms of ( ) { } + ? | change places."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise ValueError("the pattern ends in a backslash")
            n = pattern[i + 1]
            if basic and n in "(){}+?|":
                out.append(n)
            elif n.isalpha() and n not in "wWsSbB":
                raise ValueError(f"\\{n} has no meaning here")
            else:
                out.append("\\" + n)
            i += 2
        elif c == "[":
            j = i + 1
            neg = pattern[j : j + 1] == "^"
            j += neg
            body, first = [], True
            while True:
                if j >= len(pattern):
                    raise ValueError("a bracket is not closed")
                if pattern[j] == "]" and not first:
                    break
                first = False
                if pattern.startswith("[:", j):
                    k = pattern.find(":]", j)
                    if k < 0 or pattern[j + 2 : k] not in POSIX:
                        raise ValueError("unknown character class")
                    body.append(POSIX[pattern[j + 2 : k]])
                    j = k + 2
                elif pattern[j : j + 2] in ("[.", "[="):
                    raise ValueError("collating elements have no counterpart")
                else:
                    body.append("\\" + pattern[j] if pattern[j] in "[]\\&^" else pattern[j])
                    j += 1
            out.append("[" + "^" * neg + "".join(body) + "]")
            i = j + 1
        else:
            if basic and c in "(){}+?|" or basic and c == "*" and (i == 0 or pattern[:i] in ("^", "\\(")):
                out.append("\\" + c)
            elif c == "$" and i + 1 == len(pattern):
                out.append("\\z")
            else:
                out.append(c)
            i += 1
    return ("(?iu)" if icase else "") + "(?s)" + "".join(out)


@dataclass(frozen=True)
class Access:
    """How a pattern is looked up: ``none`` no rows, ``scan`` all, ``exact``, ``prefix`` or ``regex`` on ``text``;
    prefix: what every match begins with, if known, for a regular expression."""

    mode: str
    text: str = ""
    icase: bool = False
    prefix: str | None = None

    def on(self, key: Column) -> Column:
        """The predicate on the key column."""
        col, text = (F.lower(key), self.text.lower()) if self.icase else (key, self.text)
        if self.mode == "none":
            return F.lit(False)
        if self.mode == "scan":
            return key.isNotNull()
        if self.mode == "exact":
            return self._either(key, text) & (col == text)
        if self.mode == "prefix":
            return self._either(key, text) & col.startswith(text)
        hit = key.rlike(self.text)
        if self.prefix:
            hit = self._either(key, self.prefix) & col.startswith(self.prefix.lower() if self.icase else self.prefix) & hit
        return hit

    def _either(self, key: Column, text: str) -> Column:
        """Where case doesn't matter, the two beginnings a key may have, which reach the files; no lower-case key does."""
        if not self.icase or not text[:1].isascii() or not text[:1].isalpha() or text[0].lower() in "ks":
            return F.lit(True)  # k and s are also what other letters become
        return key.startswith(text[0].lower()) | key.startswith(text[0].upper())


def access(pattern: str | None, literal: bool = False, icase: bool = False, basic: bool = False) -> Access:
    """The lookup for a pattern: null scans, an empty one has no rows."""
    if pattern is None:
        return Access("scan")
    if pattern == "":
        return Access("none")
    if not literal:
        pattern = trim_anchors(pattern)
        if pattern in MATCH_ALL:
            return Access("scan")
    if literal or not is_regex(pattern):
        return Access("exact", pattern, icase)
    if (p := literal_prefix(pattern)) is not None and not pattern.endswith(p + "$"):
        return Access("prefix", p, icase)
    m = re.match(r"\^(\w+)(?![*?{\w|])", pattern)
    known = m[1] if m and "|" not in pattern else None
    return Access("regex", java_regex(pattern, basic, icase), icase, known)
