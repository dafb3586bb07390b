"""Scanners: a source text to the token kinds its grammar reads. Each asks ``good`` about the readings of the text; a text that can't be
split into tokens is none."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

_ESCAPED = r"(?:\\[\s\S]|[^{q}\\\n])*"
_STR, _CHR = '"' + _ESCAPED.format(q='"') + '"', "'" + _ESCAPED.format(q="'") + "'"
_WORD = r"[^\W\d]\w*"
_PUNCT = {
    "c": "<<= >>= ... -> ++ -- && || <= == != += -= *= /= %= &= |= ^= ::",
    "java": "... -> ++ -- && || <= == != += -= *= /= %= &= |= ^= ::",
    "python": "**= //= ... -> := ** // <= >= == != += -= *= /= %= @= &= |= ^=",
    "javascript": "=== !== **= &&= ||= ??= ... => ?. ?? ** ++ -- && || <= >= == != += -= *= /= %= &= |= ^=",
    "php": "=== !== **= ??= ... ?-> -> => :: ?? ** ++ -- && || <= >= == != += -= *= /= .= %= &= |= ^= #[",
    "asm": "== != &&",
}


def _ops(lang: str) -> str:
    ops = [x for x in _PUNCT[lang].split() if x not in ("<<=", ">>=")]
    return "|".join(map(re.escape, sorted(ops, key=len, reverse=True))) + r"|[^\w\s]"


def _scanner(lang: str, *parts: tuple[str, str]) -> Callable[[str], Iterator[re.Match]]:
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in (*parts, ("op", _ops(lang)), ("bad", r"[\s\S]")))).finditer


def _splitter(lang: str, skip: str, *parts: str) -> Callable[[str], list[str]]:
    """All tokens of a text as strings; what is skipped comes before a token, and an empty token ends the text.

    The most frequent tokens are tried first: brackets and separators, and words that nothing follows which may belong to them."""
    frequent = r"[(){}\[\];,]|[^\W\d]\w*+(?![$\\\"'`\u200c\u200d])"
    return re.compile(rf"(?>(?:{skip})*)({frequent}|{'|'.join((*parts, _ops(lang)))}|\S|\Z)").findall


class _Kinds(dict):
    """The kind of each token's text, found out once; BAD for what is no token."""

    def __init__(self, words: set[str], tokens: set[str]) -> None:
        super().__init__({"": ""})
        self.words, self.tokens = words, tokens

    def __missing__(self, x: str) -> str:
        c = x[0]
        if x in self.tokens and x not in self.words and not x.isalnum():
            kind = x
        elif x[-1] in "\"'" and len(x) > 1:
            kind = "CHR" if x[-1] == "'" else "STR"
        elif c.isdigit() or c == "." and x[1:2].isdigit():
            kind = "NUM"
        elif c == "_" or c == "$" or c.isalpha():
            kind = x if x in self.words else "ID"
        else:
            kind = "BAD" if c in "\"'`\\" or c.isspace() or c.isalnum() else "OTHER"
        if len(self) > 50_000:
            self.clear()
            self[""] = ""
        self[x] = kind
        return kind


@cache
def _c_split(cpp: bool) -> Callable:
    number = r"\.?\d(?:[eEpP][+-]|'?[\w.])*" if cpp else r"\.?\d(?:[eEpP][+-]|[\w.])*"
    return _splitter("c", r"\s+", rf"(?:u8|[uUL])?{_STR}", rf"(?:u8|[uUL])?{_CHR}", number, r"(?:[^\W\d]|\$)[\w$]*")


@cache
def _c(cpp: bool, yacc: bool) -> Callable:
    number = r"\.?\d(?:[eEpP][+-]|'?[\w.])*" if cpp else r"\.?\d(?:[eEpP][+-]|[\w.])*"
    own = (("MARK", r"%%|%\{|%\}"), ("PCT", r"%[a-z][\w-]*"), ("VALUE", r"[$@](?:<\w+>)?(?:\$|-?\d+|\[\w+\]|\w+)")) if yacc else ()
    return _scanner("c", ("skip", r"\s+"), *own, ("STR", rf"(?:u8|[uUL])?{_STR}"), ("CHR", rf"(?:u8|[uUL])?{_CHR}"), ("NUM", number), ("ID", r"(?:[^\W\d]|\$)[\w$]*"))


def _kinds(text: str, scan: Callable, words: set[str], tokens: set[str]) -> list[str] | None:
    out = []
    for m in scan(text):
        kind = m.lastgroup
        if kind == "ID":
            out.append(x if (x := m[0]) in words else "ID")
        elif kind == "op":
            out.append(x if (x := m[0]) in tokens else "OTHER")
        elif kind in ("bad", "bad2"):
            return None
        elif kind != "skip":
            out.append(kind)
    return out


_COMMENT = re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|(?P<open>/\*)|(?P<keep>{_STR}|{_CHR})")
_RAW_COMMENT = re.compile(rf'(?P<raw>R"(?P<d>[^ ()\\\t\v\f\n]{{0,16}})\([\s\S]*?\)(?P=d)")|' + _COMMENT.pattern)


def without_comments(text: str, raw: bool = False) -> str | None:
    """C comments as blanks, their line ends kept, raw strings as plain ones; None if a comment isn't closed."""
    bad = False

    def put(m: re.Match) -> str:
        nonlocal bad
        if m["keep"]:
            return m[0]
        if raw and m["raw"]:
            return '""' + "\\\n" * m[0].count("\n")
        bad |= bool(m["open"])
        return " " + "\n" * m[0].count("\n")

    text = (_RAW_COMMENT if raw else _COMMENT).sub(put, text)
    return None if bad else text


# Names of preprocessor directives.
_DIRECTIVES = set("define undef include include_next import if ifdef ifndef elif elifdef elifndef else endif line error warning pragma ident sccs assert unassert embed".split())
_INCLUDE = re.compile(r'\s*(?:"[^"\n]+"|<[^>\n]+>|[A-Za-z_]\w*.*)\s*$')
_DIRECTIVE = re.compile(r"(?m)^[^\S\n]*#([^\n]*)\n?")
_DEFINED = re.compile(r"(!?)\s*defined\s*(?:\(\s*(\w+)\s*\)|(\w+))\s*$")


class Section(NamedTuple):
    """A conditional section: the branch it stands in, as (section, number) from outside in, and its branches' conditions,
    each a fixed truth value or (name, whether it is to be true); a branch without one (else) is always true."""

    inside: tuple[tuple[int, int], ...]
    conditions: list


def _condition(word: str, rest: str, version: dict[str, int]) -> object:
    rest = " ".join(rest.split())
    if word.endswith("def"):
        name = re.match(r"\w*", rest)[0]
        return (name, version.get(name, 0)), not word.endswith("ndef")
    if re.fullmatch(r"\d+", rest):
        return int(rest) != 0
    m = _DEFINED.match(rest)
    name = (m[2] or m[3]) if m else rest
    return (name, version.get(name, 0)), not (m and m[1])


def preprocessed(text: str) -> tuple[list[tuple[str, tuple[tuple[int, int], ...]]], list[Section]] | None:
    """The pieces of a text without its directives, each with the branch it stands in, and the conditional sections.

    None where directives are malformed or conditions don't close. Line ends must be plain, comments gone."""
    text = text.replace("\\\n", " ")
    pieces, sections, open_, version, at = [], [], [], {}, 0
    here: tuple[tuple[int, int], ...] = ()
    for d in _DIRECTIVE.finditer(text):
        if d.start() > at:
            pieces.append((text[at : d.start()], here))
        at = d.end()
        y = d[1].lstrip()
        m = re.match(r"[A-Za-z_]\w*|\d+|", y)
        word, rest = m[0], y[m.end() :]
        if not word and rest.strip() or word and not word.isdigit() and word not in _DIRECTIVES:
            return None
        if word in ("include", "import", "include_next") and not _INCLUDE.match(rest) or word in ("define", "undef", "ifdef", "ifndef") and not re.match(r"\s+[A-Za-z_$]\w*", rest) or word in ("if", "elif") and not rest.strip():
            return None
        if word in ("define", "undef"):
            name = re.match(r"\s+(\w*)", rest)[1]
            version[name] = version.get(name, 0) + 1
        elif word in ("if", "ifdef", "ifndef"):
            open_.append((len(sections), here))
            here = (*here, (len(sections), 0))
            sections.append(Section(open_[-1][1], [_condition(word, rest, version)]))
        elif word in ("elif", "else", "elifdef", "elifndef"):
            if not open_ or sections[open_[-1][0]].conditions[-1] is None:
                return None
            k, outer = open_[-1]
            here = (*outer, (k, len(sections[k].conditions)))
            sections[k].conditions.append(None if word == "else" else _condition(word, rest, version))
        elif word == "endif":
            if not open_:
                return None
            here = open_.pop()[1]
    if open_:
        return None
    if at < len(text):
        pieces.append((text[at:], here))
    return pieces, sections


def chosen(sections: list[Section], last: bool, target: tuple[tuple[int, int], ...] = ()) -> dict[int, int] | None:
    """A choice of branches, by section: those that lead to ``target``, elsewhere the first, or with ``last`` the last, that the
    conditions allow; a condition that stands twice has one value. A section without an alternative is read
    where its condition is still free. None if no values lead to the target."""
    asked, value, out = dict(target), {}, {}
    for k, s in enumerate(sections):
        if any(out.get(a) != b for a, b in s.inside):
            continue
        n = len(s.conditions)
        for i, c in enumerate(s.conditions):
            if c is None or isinstance(c, bool):
                holds = c is None or c
            elif c[0] in value:
                holds = value[c[0]] == c[1]
            else:
                holds = i == asked[k] if k in asked else i == n - 1 or not last
                value[c[0]] = c[1] if holds else not c[1]
            if k in asked and holds != (i == asked[k]):
                return None
            if holds:
                out[k] = i
                break
        else:
            if k in asked:
                return None
    return out


def every_branch(pieces: list, sections: list[Section], good: Callable[[list], bool]) -> bool:
    """Whether each branch of each section stands in some reading that is good. good gets the pieces of one reading.

    Branches no values of the conditions lead to, such as those under ``#if 0``, are not compiled and not read."""
    tried: dict[tuple, bool] = {}

    def read(choice: dict[int, int]) -> bool:
        key = tuple(sorted(choice.items()))
        if key not in tried:
            tried[key] = good([x for x, at in pieces if all(choice.get(a) == b for a, b in at)])
            if tried[key]:
                seen.update(key)
        return tried[key]

    seen: set[tuple[int, int]] = set()
    first = [read(c) for last in (False, True) if (c := chosen(sections, last)) is not None]
    if not any(first):
        return False
    for k, s in enumerate(sections):
        for i in range(len(s.conditions)):
            if (k, i) not in seen:
                ways = [c for last in (False, True) if (c := chosen(sections, last, (*s.inside, (k, i)))) is not None]
                if ways and not any(read(c) for c in ways):
                    return False
    return True


# Words of C++ that are names in C.
_CPP_WORDS = set("and or not this class virtual explicit friend mutable constexpr consteval constinit decltype wchar_t alignas thread_local".split())


def c_like(text: str, g, good: Callable[[list[str]], bool], cpp: bool = False, yacc: bool = False) -> bool:
    """C, C++ and yacc: whether all branches of the text stand in readings that are good."""
    text = without_comments(text, cpp)
    if text is None or (found := preprocessed(text)) is None:
        return False
    words = g.words if cpp else g.words - _CPP_WORDS
    if yacc:
        return every_branch(*found, lambda p: (t := _yacc("".join(p), words, g.tokens)) is not None and good(t))
    kinds, split = _kinds_of(g, cpp), _c_split(cpp)
    pieces = [([k for x in split(piece) if (k := kinds[x])], at) for piece, at in found[0]]
    return every_branch(pieces, found[1], lambda p: not any("BAD" in x for x in p) and good([k for x in p for k in x]))


_OWN: dict[int, _Kinds] = {}


def _kinds_of(g, all_words: bool = True) -> _Kinds:
    """The token kinds of a grammar, kept as long as the worker lives."""
    if id(g) not in _OWN:
        _OWN[id(g)] = _Kinds(g.words if all_words else g.words - _CPP_WORDS, g.tokens)
    return _OWN[id(g)]


def _yacc(text: str, words: set[str], tokens: set[str]) -> list[str] | None:
    out, depth, part = [], 0, 0
    at, scan, code = 0, _c(False, True), _c(False, False)
    for m in scan(text):
        kind, x = m.lastgroup, m[0]
        if kind == "MARK":
            out.append(x)
            part += x == "%%"
            if part == 2:
                rest = _kinds(text[m.end() :], code, words, tokens)
                return None if rest is None else out + rest
            depth += (x == "%{") - (x == "%}")
        elif kind == "PCT":
            out += ["PCT"] if not depth else ["%", "ID"]
        elif kind == "VALUE":
            out.append("ID")
        elif kind == "bad":
            return None
        elif kind == "ID":
            out.append(x if depth and x in words else "ID")
        elif kind == "op":
            depth += (x == "{") - (x == "}")
            out.append(x if x in tokens else "OTHER")
        elif kind != "skip":
            out.append(kind)
    return out


@cache
def _java() -> Callable:
    return _splitter("java", r"\s+|//[^\n]*|/\*(?>[\s\S]*?\*/)", rf'"""(?:\\[\s\S]|[^\\])*?"""|(?!""){_STR}|""(?!")', _CHR, r"\.?\d(?:[eEpP][+-]|[\w.])*", r"(?:[^\W\d]|\$)[\w$]*", r"/\*")


def java(text: str, g, good: Callable[[list[str]], bool]) -> bool:
    own = _kinds_of(g)
    own["/*"] = "BAD"
    kinds = [k for x in _java()(text) if (k := own[x])]
    if "BAD" in kinds:
        return False
    # words that are keywords in one place only
    after = {"record": "ID", "permits": "ID", "module": "ID", "open": "module", "sealed": "class interface abstract public static", "non": "-", "yield": "ID NUM STR new this ! ( switch"}
    if not after.keys().isdisjoint(kinds):
        for i, k in enumerate(kinds):
            if k in after and not (i + 1 < len(kinds) and kinds[i + 1] in after[k].split() and (k != "record" or kinds[i + 2 : i + 3] in (["("], ["<"]))):
                kinds[i] = "ID"
    return good(kinds)


_PREFIX = r"(?:[bB][rR]?|[rR][bB]?|[uU][rR]?)?"
_PY_STR = rf'{_PREFIX}(?:"""(?:\\[\s\S]|[^\\])*?"""|\'\'\'(?:\\[\s\S]|[^\\])*?\'\'\'|(?!"""){_STR}|(?!\'\'\'){_CHR})'
_FORMAT = re.compile(rf'(?<!\w)(?P<f>(?:[rR][fFtT]|[fFtT][rR]?))(?P<q>"""|\'\'\'|"|\')|#[^\n]*|{_PY_STR}')
_FORMATTED = re.compile(r"(?<!\w)(?:[rR][fFtT]|[fFtT][rR]?)[\"']")


def _fields(text: str, at: int, quote: str) -> tuple[int, list[str]] | None:
    """Where the format string whose text begins at ``at`` ends, and the expressions in its braces; None if it isn't whole."""
    out: list[str] = []

    def literal(at: int, spec: bool) -> int:
        while at < len(text):
            c = text[at]
            if not spec and text.startswith(quote, at):
                return at + len(quote)
            if spec and c == "}":
                return at
            if c == "\\":
                at += 2
            elif not spec and text[at : at + 2] in ("{{", "}}"):
                at += 2
            elif c == "{":
                at = field(at + 1)
                if at < 0:
                    return -1
            elif c == "}" or c == "\n" and len(quote) == 1:
                return -1
            else:
                at += 1
        return -1

    def field(at: int) -> int:
        begin, depth = at, 0
        while at < len(text):
            c = text[at]
            if c in "\"'" and (m := re.compile(_PY_STR).match(text, at)):
                at = m.end()
                continue
            if c in "([{":
                depth += 1
            elif c in ")]}" and depth:
                depth -= 1
            elif not depth and (c in "}:" or c == "!" and text[at + 1 : at + 2] != "="):
                inner = re.sub(r"(?<![=!<>])=\s*$", "", text[begin:at])
                out.append(inner)
                if c == "!":
                    m = re.compile(r"!\s*\w+\s*").match(text, at)
                    if not m:
                        return -1
                    at, c = m.end(), text[m.end() : m.end() + 1]
                if c == ":":
                    at = literal(at + 1, True)
                    if at < 0:
                        return -1
                return at + 1 if text[at : at + 1] == "}" else -1
            at += 1
        return -1

    end = literal(at, False)
    return None if end < 0 else (end, out)


def _unformatted(text: str) -> str | None:
    """The text with each format string as its expressions in brackets between two control characters."""
    out, at = [], 0
    while m := _FORMAT.search(text, at):
        out.append(text[at : m.start()])
        if m["f"]:
            found = _fields(text, m.end(), m["q"])
            if found is None:
                return None
            at = found[0]
            inner = [x if not _FORMATTED.search(x) else _unformatted(x) for x in found[1]]
            if None in inner:
                return None
            out.append("\x01" + "".join(f"({x})" for x in inner) + "\x02")
        else:
            out.append(m[0])
            at = m.end()
    return "".join(out) + text[at:]


@cache
def _python() -> Callable:
    return _splitter("python", r"[ \t\f]+|#[^\n]*|\\\n", r"\n[ \t\f]*", _PY_STR, r"\.?\d(?:[eE][+-]|[\w.])*", _WORD)


class _PythonKinds(_Kinds):
    """Marks numbers and strings that only one dialect has."""

    def __missing__(self, x: str) -> str:
        kind = super().__missing__(x)
        if kind == "CHR":
            kind = "STR"
        if kind == "STR" and re.match(r"[uU][rR]", x):
            kind = "OLDSTR"
        elif kind == "NUM" and re.fullmatch(r"0\d*[1-7]\d*|0[xX][\da-fA-F]+[lL]|\d+[lL]", x):
            kind = "OLDNUM"
        elif kind == "NUM" and "_" in x:
            kind = "NEWNUM"
        self[x] = kind
        return kind


def python(text: str, g, good: Callable[[list[str]], bool]) -> bool:
    """Python, with NEWLINE, INDENT and DEDENT; the first line that is indented otherwise than any open block ends it. The expressions
    in format strings are read, too."""
    if _FORMATTED.search(text) and (text := _unformatted(text)) is None:
        return False
    if id(g) not in _OWN:
        _OWN[id(g)] = _PythonKinds(g.words, g.tokens)
        _OWN[id(g)] |= {"\x01": "FHEAD", "\x02": "FTAIL"}
    kinds = _OWN[id(g)]
    if "\x01" not in kinds:  # cleared
        kinds |= {"\x01": "FHEAD", "\x02": "FTAIL"}
    out, depth, stack, fresh, before = [], 0, [0], True, ""
    put = out.append
    for x in _python()("\n" + text + "\n"):
        if x[:1] == "\n":
            if depth == 0:
                before = x
                if not fresh:
                    put("NEWLINE")
                    fresh = True
            continue
        if not x:
            continue
        k = kinds[x]
        if fresh:
            fresh = False
            width = len(before[1:].replace("\f", "").expandtabs(8))
            if width > stack[-1]:
                stack.append(width)
                put("INDENT")
            while width < stack[-1]:
                stack.pop()
                put("DEDENT")
            if width != stack[-1]:
                return False
        if k in ("(", "[", "{"):
            depth += 1
        elif k in (")", "]", "}"):
            depth -= 1
            if depth < 0:
                return False
        elif k == "BAD":
            return False
        put(k)
    return not depth and good(out + ["DEDENT"] * (len(stack) - 1))


@cache
def _javascript() -> Callable:
    return _scanner(
        "javascript", ("skip", r"[^\S\n  ]+|//[^\n]*|<!--[^\n]*"), ("LINE", r"[\n  ]+|/\*[\s\S]*?\*/"), ("bad2", r"/\*"), ("STR", f"{_STR}|{_CHR}"), ("TICK", "`"),
        ("NUM", r"\.?\d(?:[eE][+-]|[\w.])*"), ("ID", r"(?:[^\W\d]|[$\\])(?:[\w$\\]|‌|‍)*"),
    )


_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
#: After these a slash divides.
_VALUE = {"ID", "NUM", "STR", "TEMPLATE", "TAIL", "REGEX", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"}
#: A line end before these ends nothing.
_GOES_ON = set("( [ . , ; : ? + - * / % & | ^ < > = ! ) ] => ?. ?? ** && || <= >= == != === !== += -= *= /= in instanceof TEMPLATE HEAD MIDDLE TAIL".split()) - {"!"}


#: A template from its begin or from a closing brace to its end or the next expression.
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^\\`$])*(`|\$\{)")


@cache
def _javascript_split() -> Callable:
    return _splitter("javascript", r"[^\S\n\u2028\u2029]+|//[^\n]*|<!--[^\n]*", r"[\n\u2028\u2029]+|/\*(?>[\s\S]*?\*/)", _STR, _CHR, r"\.?\d(?:[eE][+-]|[\w.])*", r"(?:[^\W\d]|[$\\])(?:[\w$\\]|\u200c|\u200d)*", r"/\*")


class _ScriptKinds(_Kinds):
    def __missing__(self, x: str) -> str:
        if x[0] == "\\" and len(x) > 1:
            kind = "ID"
        elif x[0] in "\n\u2028\u2029" or x[:2] == "/*" and len(x) > 2:
            kind = "LINE" if "\n" in x else ""
        else:
            kind = super().__missing__(x)
            kind = "STR" if kind == "CHR" else "BAD" if x == "/*" else kind
        self[x] = kind
        return kind


def javascript(text: str, g, good: Callable[[list[str]], bool]) -> bool:
    """JavaScript, with NL where a line end, a closing brace or the end may end a statement. What stands in a template's ``${ }`` is
    read, too."""
    if text.startswith("#!"):
        text = text[text.find("\n") + 1 or len(text) :]
    tokens = _javascript_split()(text)
    if "/" in tokens or "/=" in tokens or "`" in tokens:  # a slash may begin an expression: the tokens depend on each other
        tokens = _script_kinds(text, g)
    else:
        if id(g) not in _OWN:
            _OWN[id(g)] = _ScriptKinds(g.words, g.tokens)
        kinds = _OWN[id(g)]
        tokens = [k for x in tokens if (k := kinds[x])]
    if tokens is None or "BAD" in tokens:
        return False
    out, last, line = [], "", False
    put = out.append
    for k in tokens:
        if k == "LINE":
            line = True
            continue
        if (k == "}" or line) and last and last not in (";", "{") and (k == "}" or k not in _GOES_ON):
            put("NL")
        put(k)
        last, line = k, False
    return good(out + ["NL"])


def _script_kinds(text: str, g) -> list[str] | None:
    """The kinds of the tokens of a text with slashes or templates, LINE for line ends."""
    out, last, at = [], "", 0
    braces: list[bool] = []  # of open braces: whether a template goes on after it
    scan = _javascript().__self__.match
    while at < len(text):
        m = scan(text, at)
        kind, x, at = m.lastgroup, m[0], m.end()
        if kind == "skip":
            continue
        if kind == "LINE":
            if "\n" in x:
                out.append("LINE")
            continue
        if kind in ("bad", "bad2"):
            return None
        goes_on = x == "}" and kind == "op" and braces and braces.pop()
        if kind == "TICK" or goes_on:
            m = _TEMPLATE.match(text, at)
            if not m:
                return None
            at, kind = m.end(), ("TAIL" if goes_on else "TEMPLATE") if m[1] == "`" else "MIDDLE" if goes_on else "HEAD"
            if m[1] != "`":
                braces.append(True)
        elif x == "{" and kind == "op":
            braces.append(False)
        if kind == "op" and x in ("/", "/=") and last not in _VALUE and (r := _REGEX.match(text, m.start())):
            kind, at = "REGEX", r.end()
        last = x if kind == "op" and x in g.tokens or kind == "ID" and x in g.words else "OTHER" if kind == "op" else kind
        out.append(last)
    return out


@cache
def _php() -> Callable:
    return _scanner(
        "php", ("skip", r"\s+|/\*[\s\S]*?\*/|(?://|#(?!\[))(?:(?!\?>)[^\n])*"), ("bad2", r"/\*"), ("CLOSE", r"\?>\n?"),
        ("STR", r"""b?"(?:\\[\s\S]|[^"\\])*"|b?'(?:\\[\s\S]|[^'\\])*'|`(?:\\[\s\S]|[^`\\])*`|<<<[ \t]*(?P<q>["']?)(?P<h>[A-Za-z_]\w*)(?P=q)\n(?:[\s\S]*?\n)?[ \t]*(?P=h)\b"""),
        ("VAR", r"\$[^\W\d]\w*"), ("NUM", r"\.?\d(?:[eE][+-]|[\w]|\.(?=\d)|\.(?![.\w]))*"), ("ID", _WORD),
    )


_PHP_OPEN = re.compile(r"<\?(?:php\b|=|(?!xml))", re.I)


# Words of PHP that are keywords in one place only.
_CASTS = set("int integer string bool boolean float double object binary".split())


def _php_names(out: list[str]) -> list[str]:
    for i, k in enumerate(out):
        last, then = out[i - 1] if i else "", out[i + 1] if i + 1 < len(out) else ""
        if k in _CASTS and (last, then) != ("(", ")") or k == "from" and last != "yield" or k == "enum" and then != "ID" or k == "match" and then != "(" or k == "fn" and then not in ("(", "&"):
            out[i] = "ID"
    return out


@cache
def _php_split() -> Callable:
    return _splitter("php", r"\s+|/\*(?>[\s\S]*?\*/)|//[^\n]*|#(?!\[)[^\n]*", r"""b?"(?:\\[\s\S]|[^"\\])*"|b?'(?:\\[\s\S]|[^'\\])*'|`(?:\\[\s\S]|[^`\\])*`""", r"\$[^\W\d]\w*", r"\.?\d(?:[eE][+-]|[\w]|\.(?=\d)|\.(?![.\w]))*", _WORD, r"/\*")


class _PhpKinds(_Kinds):
    def __missing__(self, x: str) -> str:
        c = x[0]
        if c == "$" and len(x) > 1:
            kind = "VAR"
        elif x[-1] in "\"'`" and len(x) > 1:
            kind = "STR"
        elif c == "_" or c.isalpha():
            kind = y if (y := x.lower()) in self.words else "ID"
        else:
            kind = "BAD" if x == "/*" else x if x in self.tokens else super().__missing__(x)
        self[x] = kind
        return kind


def php(text: str, g, good: Callable[[list[str]], bool]) -> bool:
    """PHP; HTML is the text between blocks. Keywords are known in any case. A text without a block is all HTML."""
    opens = list(_PHP_OPEN.finditer(text))
    if len(opens) == 1 and opens[0][0] != "<?=" and "?>" not in text and "<<<" not in text:
        if id(g) not in _OWN:
            _OWN[id(g)] = _PhpKinds(g.words, g.tokens)
        kinds = _OWN[id(g)]
        tokens = [k for x in _php_split()(text[opens[0].end() :]) if (k := kinds[x])]
        if "__halt_compiler" in tokens:
            tokens = tokens[: tokens.index("__halt_compiler")]
        return "BAD" not in tokens and good(_php_names(["HTML"] * (opens[0].start() > 0) + tokens))
    out, at = [], 0
    scan = _php().__self__.match
    while True:
        m = _PHP_OPEN.search(text, at)
        if at or (m.start() if m else len(text)):
            out.append("HTML")
        if not m:
            return good(_php_names(out))
        if m[0] == "<?=":
            out.append("echo")
        at = m.end()
        while at < len(text):
            m = scan(text, at)
            kind, x, at = m.lastgroup, m[0], m.end()
            if kind == "h":
                kind = "STR"
            if kind == "CLOSE":
                break
            if kind in ("bad", "bad2"):
                return False
            if kind == "ID":
                kind = y if (y := x.lower()) in g.words else "ID"
                if kind == "__halt_compiler":
                    return good(_php_names(out))
            elif kind == "op":
                kind = x if x in g.tokens else "OTHER"
            if kind != "skip":
                out.append(kind)
        else:
            return good(_php_names(out))


@cache
def _asm() -> Callable:
    return _scanner(
        "asm", ("skip", r"[^\S\n]+|//[^\n]*|#(?:[ \t#][^\n]*|(?=\n)|$)"), ("LINE", r"\n|;"), ("STR", _STR), ("CHR", r"'(?:\\[^\n]|[^\n\\'])'?"),
        ("NUM", r"\d[\w.]*"), ("DOT", r"\.[A-Za-z_][\w.$]*"), ("ID", r"(?:[^\W\d]|[$](?=[A-Za-z_])|\\[A-Za-z@(])[\w.$\\]*"),
    )


def asm(text: str, g, good: Callable[[list[str]], bool]) -> bool:
    """Assembler, with NEWLINE after each statement; lines whose first character is # are comments or directives."""
    text = without_comments(re.sub(r"(?m)^[ \t]*#.*$", "", text))
    if text is None:
        return False
    out = []
    for m in _asm()(text.replace("\\\n", " ") + "\n"):
        kind = m.lastgroup
        if kind == "bad" or kind == "op" and m[0] == '"':
            return False
        if kind == "LINE":
            if out and out[-1] != "NEWLINE":
                out.append("NEWLINE")
        elif kind == "op":
            out.append(m[0] if m[0] in g.tokens else "OTHER")
        elif kind != "skip":
            out.append(kind)
    return good(out)


LEXERS = {"c": c_like, "cpp": lambda t, g, good: c_like(t, g, good, cpp=True), "yacc": lambda t, g, good: c_like(t, g, good, yacc=True), "java": java, "python": python, "javascript": javascript, "php": php, "asm": asm}
