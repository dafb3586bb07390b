"""Definitions and references of C, C++, Java, PHP and assembler sources.

Each parser works on the tokens of a whole file: comments, strings and numbers are no tokens. It yields
(kind, tag, lineno), kind DEF or REF. Other symbols are references; whether a reference is defined anywhere is a join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

DEF, REF = 1, 2
#: Flags of a parse request: in C, C++ and yacc a closing brace in column 0 ends, an opening one begins the outermost block.
END_BLOCK, BEGIN_BLOCK = 8, 16
Event = tuple[int, str, int]
Token = tuple[str, str, int]  # kind (w word, p punctuation, d directive, s string, v variable), text, line

# Reserved words, which are no symbols.
C_WORDS = set("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex __attribute__ __extension__ __asm__ asm __inline __inline__ __const __volatile__ __restrict".split())
CPP_WORDS = C_WORDS | set("alignas alignof and bool catch char16_t char32_t class const_cast constexpr decltype delete dynamic_cast explicit export false friend mutable namespace new noexcept not nullptr operator or override final private protected public reinterpret_cast static_assert static_cast template this throw true try typeid typename using virtual wchar_t".split())
JAVA_WORDS = set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
PHP_WORDS = set("abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield true false null".split())

_C = re.compile(
    r"""(?P<skip>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|(?:u8|[uUL])?"(?:\\[\s\S]|[^"\\\n])*"?|'(?:\\[\s\S]|[^'\\\n])*'?|\.?\d(?:[eEpP][+-]|[\w.])*)"""
    r"""|(?P<line>\n)|(?P<d>(?m:^)[ \t]*\#[ \t]*(?:\\\n|[^\n])*)|(?P<w>[^\W\d][\w]*)|(?P<p>::|->|[^\s\w])"""
)
_PHP = re.compile(
    r"""(?P<skip>/\*[\s\S]*?(?:\*/|\Z)|(?://|\#)(?:(?!\?>)[^\n])*|\.?\d[\w.]*)|(?P<s>"(?:\\[\s\S]|[^"\\])*"|'(?:\\[\s\S]|[^'\\])*')|(?P<v>\$[^\W\d]\w*)|(?P<w>[^\W\d]\w*)|(?P<line>\n)|(?P<p>->|::|[^\s\w])"""
)


def _tokens(text: str, scan: re.Pattern, line: int = 1) -> Iterator[Token]:
    for m in scan.finditer(text):
        kind = m.lastgroup
        if kind not in ("skip", "line"):
            yield kind, m[0], line
        line += m[0].count("\n")


def _macro(directive: str) -> tuple[str, str] | None:
    m = re.match(r"\s*#\s*(define|undef|if|ifdef|ifndef|elif|else|endif|include|pragma)\b\s*(\w*)", directive)
    return (m[1], m[2]) if m else None


def _words(directive: str, skip: set[str]) -> Iterator[str]:
    body = re.sub(r"""/\*.*?\*/|//.*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'""", " ", directive)
    for x in re.findall(r"(?<![\w.])[^\W\d]\w*", body):
        if x not in skip:
            yield x


def _close(t: list[Token], i: int, a: str, b: str) -> int:
    """Index of the bracket that closes the one at i, or the end."""
    depth = 0
    while i < len(t):
        if t[i][1] == a:
            depth += 1
        elif t[i][1] == b:
            depth -= 1
            if not depth:
                return i
        i += 1
    return len(t)


class _CLike:
    """C and C++ in one pass over the tokens; the stack of open braces tells what may be defined where."""

    def __init__(self, text: str, words: set[str], cpp: bool, flags: int = 0, notfunctions: frozenset[str] = frozenset()) -> None:
        self.notfunctions = notfunctions
        self.t, self.words, self.cpp, self.out = list(_tokens(text, _C)), words, cpp, []
        self.begins, self.ends = set(), set()  # braces in column 0 that force the level
        if flags & (BEGIN_BLOCK | END_BLOCK):
            at = [m for m in _C.finditer(text) if m.lastgroup not in ("skip", "line")]
            first = [i for i, m in enumerate(at) if m[0] in ("{", "}") and (not m.start() or text[m.start() - 1] == "\n")]
            self.begins = {i for i in first if flags & BEGIN_BLOCK and self.t[i][1] == "{"}
            self.ends = {i for i in first if flags & END_BLOCK and self.t[i][1] == "}"}

    def put(self, kind: int, i: int) -> None:
        self.out.append((kind, self.t[i][1], self.t[i][2]))

    def run(self) -> list[Event]:
        t, n, i = self.t, len(self.t), 0
        stack: list[tuple[str, str]] = []  # of open braces: what for (space, class, enum, body) and its name
        saved: list[int] = []
        want: tuple[str, str] | None = None  # what the next brace opens
        defined: set[int] = set()
        while i < n:
            kind, x, line = t[i]
            if kind == "d":
                self.directive(x, line, stack, saved)
                i += 1
                continue
            outer = all(k in ("space", "class") for k, _ in stack)
            if x == "{":
                if i in self.begins:
                    self.force(stack)
                stack.append(want or ("body", ""))
                want = None
            elif x == "}":
                if stack:
                    stack.pop()
                if i in self.ends:
                    self.force(stack)
                want = None
            elif x == ";":
                want = None
            elif kind == "w" and x == "typedef":
                defined |= self.typedef(i)
            elif kind == "w" and x in ("struct", "union", "enum", "class"):
                j = i + 1
                if j < n and t[j][1] == "class":
                    j += 1
                while j < n and t[j][1] in ("__attribute__", "alignas", "__declspec"):
                    j = _close(t, j + 1, "(", ")") + 1
                name = j if j < n and t[j][0] == "w" and t[j][1] not in self.words else None
                k = j + 1 if name is not None else j
                if self.cpp and k < n and t[k][1] in (":", "final"):
                    while k < n and t[k][1] not in ("{", ";", ")", ">"):
                        k += 1
                if k < n and t[k][1] == "{" and not (self.cpp and i and t[i - 1][1] in ("<", ",")):
                    want = ("enum" if x == "enum" else "class" if self.cpp else "record", t[name][1] if name is not None else "")
                    if name is not None:
                        self.put(DEF, name)
                        defined.add(name)
            elif self.cpp and x == "namespace":
                if i + 1 < n and t[i + 1][0] == "w":
                    self.put(DEF, i + 1)
                    defined.add(i + 1)
                want = ("space", "")
            elif x == "extern" and i + 1 < n and t[i + 1][1] == "{":
                want = ("space", "")
            elif self.cpp and x == "using" and i + 2 < n and t[i + 2][1] == "=":
                self.put(DEF, i + 1)
                defined.add(i + 1)
            elif kind == "w" and x not in self.words and i not in defined:
                if stack and stack[-1][0] == "enum" and t[i - 1][1] in ("{", ","):
                    self.put(DEF, i)
                elif outer and self.function(i, stack):
                    self.put(DEF, i)
                    want = ("body", "")
                else:
                    self.put(REF, i)
            i += 1
        return self.out

    def force(self, stack: list) -> None:
        """Level 0: what is open but name spaces and linkage blocks, which have no level, is closed."""
        stack[:] = [x for x in stack if x[0] == "space"]

    def directive(self, x: str, line: int, stack: list, saved: list) -> None:
        found = _macro(x)
        if not found:
            return
        word, name = found
        if word in ("define", "undef") and name:
            self.out.append((DEF, name, line))
            rest = x.split(name, 1)[1]
            params = re.match(r"\(([^)]*)\)", rest)
            own = set(re.findall(r"\w+", params[1])) if params else set()
            self.out += [(REF, w, line) for w in _words(rest[params.end() :] if params else rest, self.words | own)]
        elif word in ("if", "ifdef", "ifndef"):
            saved.append(list(stack))
            self.out += [(REF, w, line) for w in _words(x.split(word, 1)[1], self.words | {"defined"})]
        elif word in ("elif", "else") and saved:
            stack[:] = saved[-1]  # each branch begins at the level of the first
            if word == "elif":
                self.out += [(REF, w, line) for w in _words(x.split(word, 1)[1], self.words | {"defined"})]
        elif word == "endif" and saved:
            saved.pop()

    def function(self, i: int, stack: list) -> bool:
        """Whether the name at i is that of a function whose body follows."""
        t, n = self.t, len(self.t)
        if i + 1 >= n or t[i + 1][1] != "(" or t[i][1] in self.notfunctions:
            return False
        if self.cpp and (stack and stack[-1] == ("class", t[i][1]) or i and t[i - 1][1] == "~" or i > 1 and t[i - 1][1] == "::" and t[i - 2][1] == t[i][1]):
            return False  # constructors and destructors
        if i and t[i - 1][1] in (".", "->", "=", ",", "(", "return", "new", ":") and not (self.cpp and t[i - 1][1] == ":" and i > 1 and t[i - 2][1] in ("public", "private", "protected")):
            return False
        end = _close(t, i + 1, "(", ")")
        k = end + 1
        while k < n and (t[k][0] == "d" or t[k][1] in ("const", "volatile", "noexcept", "override", "final", "throw", "__attribute__", "&", "->", "asm", "__asm__")):
            k += 1
            if k < n and t[k][1] == "(":
                k = _close(t, k, "(", ")") + 1
            if k < n and t[k - 1][1] == "->":
                while k < n and t[k][1] not in ("{", ";"):
                    k += 1
        if k < n and t[k][1] == "{":
            return True
        inner = t[i + 2 : end]
        if not self.cpp and inner and all(x[0] == "w" and x[1] not in self.words or x[1] == "," for x in inner):
            while k < n and (t[k][0] == "w" or t[k][1] in ("*", ",", ";", "[", "]")):  # declarations of old-style parameters
                k += 1
            return k < n and t[k][1] == "{" and t[k - 1][1] == ";"
        return False

    def typedef(self, i: int) -> set[int]:
        """Defines the names of a typedef; returns their places."""
        t, n, j, names, last = self.t, len(self.t), i + 1, set(), None
        while j < n and t[j][1] != ";":
            x = t[j][1]
            if x == "{":
                j, last = _close(t, j, "{", "}"), None
            elif x == "(" and j + 2 < n and t[j + 1][1] in ("*", "^") and last is not None:
                while j < n and not (t[j][0] == "w" and t[j][1] not in self.words):
                    j += 1
                last = j
                while j < n and t[j][1] != ")":
                    j += 1
                if j + 1 < n and t[j + 1][1] == "(":
                    j = _close(t, j + 1, "(", ")")
                names.add(last)
                last = None
            elif x == "(":
                j = _close(t, j, "(", ")")
            elif self.cpp and x == "<":
                j = _close(t, j, "<", ">")
            elif x == "[":
                j = _close(t, j, "[", "]")
            elif x == ",":
                if last is not None:
                    names.add(last)
                last = None
            elif t[j][0] == "w" and t[j][1] not in ("__attribute__",):
                last = j
            j += 1
        if last is not None and t[last][1] not in self.words:
            names.add(last)
        for k in sorted(names):
            if k < n:
                self.put(DEF, k)
        return names


def parse_c(text: str, flags: int = 0, notfunctions: frozenset[str] = frozenset()) -> list[Event]:
    """Functions, macros (also where they are undefined), tags of structures, unions and enumerations with a body,
    enumerators and typedef names are definitions. Members are not."""
    return _CLike(text, C_WORDS, False, flags, notfunctions).run()


def parse_cpp(text: str, flags: int = 0, notfunctions: frozenset[str] = frozenset()) -> list[Event]:
    """As C, with classes, namespaces, aliases and methods with a body; constructors and destructors are no definitions."""
    return _CLike(text, CPP_WORDS, True, flags, notfunctions).run()


def parse_java(text: str) -> list[Event]:
    """Classes, interfaces, enumerations and methods (but constructors) are definitions; the rest are references."""
    t, out, stack, want = list(_tokens(text, _C)), [], [], None
    for i, (kind, x, line) in enumerate(t):
        if x == "{":
            stack.append(want or "")
            want = None
        elif x == "}":
            stack and stack.pop()
        elif kind == "w" and x in ("class", "interface", "enum", "record") and i + 1 < len(t) and t[i + 1][0] == "w" and (i == 0 or t[i - 1][1] != "."):
            want = t[i + 1][1]
        elif kind == "w" and x not in JAVA_WORDS:
            before = t[i - 1][1] if i else ""
            if before in ("class", "interface", "enum", "record") and want == x:
                out.append((DEF, x, line))
            elif stack and stack[-1] and x != stack[-1] and before not in (".", "new", "=", "(", ",", "return", "@") and i + 1 < len(t) and t[i + 1][1] == "(":
                out.append((DEF, x, line))
            else:
                out.append((REF, x, line))
    return out


def parse_php(text: str) -> list[Event]:
    """Inside PHP blocks: define() names, classes, interfaces, traits and functions are definitions; variables (but
    $this) and other names are references."""
    out = []
    for block in re.finditer(r"<\?(?:php\b|=|(?!xml))([\s\S]*?)(?:\?>|\Z)", text, re.I):
        t = list(_tokens(block[1], _PHP, text.count("\n", 0, block.start(1)) + 1))
        for i, (kind, x, line) in enumerate(t):
            before = t[i - 1][1].lower() if i else ""
            if kind == "v" and x != "$this":
                out.append((REF, x[1:], line))
            elif kind == "w" and x.lower() == "define" and i + 2 < len(t) and t[i + 1][1] == "(" and t[i + 2][0] == "s":
                out.append((DEF, t[i + 2][1][1:-1], line))
            elif kind == "w" and x.lower() not in PHP_WORDS:
                declared = before in ("class", "interface", "trait") and not (i > 1 and t[i - 2][1] == "::") or before == "function" or before == "&" and i > 1 and t[i - 2][1].lower() == "function"
                out.append((DEF if declared else REF, x, line))
    return out


def parse_asm(text: str) -> list[Event]:
    """ENTRY-style names, .macro, .equ and .set names, labels and macros are definitions; call targets are references, a
    leading underscore aside."""
    out = []
    for line, raw in enumerate(re.sub(r"/\*[\s\S]*?\*/", lambda m: "\n" * m[0].count("\n"), text).split("\n"), 1):
        found = _macro(raw)
        if found and found[0] == "define" and found[1]:
            out.append((DEF, found[1], line))
            continue
        for part in re.split(r"//|(?:^|\s)#|;", raw)[:1]:
            if m := re.match(r"\s*(?:\w*ENTRY|ALTENTRY|NENTRY|SYSENTRY)\s*\(\s*(\w+)", part):
                out.append((DEF, m[1], line))
            elif m := re.match(r"\s*\.(?:macro|equ|set|equiv)\s+([A-Za-z_][\w$]*)", part):
                out.append((DEF, m[1], line))
            elif m := re.match(r"([A-Za-z_][\w$]*):", part):
                out.append((DEF, m[1], line))
            if m := re.search(r"\b(?:l?call[lq]?|jsr|bsr|bl|jal)\s+\*?(_?)([A-Za-z_]\w*)", part):
                out.append((REF, m[2], line))
    return out


#: Built-in parsers by language; ``register`` adds to them or takes their place.
PARSERS: dict[str, Callable[[str], list[Event]]] = {"c": parse_c, "yacc": parse_c, "cpp": parse_cpp, "java": parse_java, "php": parse_php, "asm": parse_asm}


def register(lang: str, parser: Callable[[str], list[Event]]) -> None:
    """A plug-in parser goes before the built-in one of its language. Call it where the workers import it, too."""
    PARSERS[lang] = parser


#: Parsers that take the flags.
FLAGGED = {parse_c, parse_cpp}


def parse(lang: str | None, text: str, flags: int | None = 0, notfunctions: frozenset[str] = frozenset()) -> list[tuple[int, str, int, str]]:
    """(kind, tag, lineno, image) of a text; names in ``notfunctions`` define no function in C, C++ and yacc; languages without a parser have none. Tags of 512 bytes and more are dropped."""
    if lang not in PARSERS or not text:
        return []
    lines = text.replace("\r\n", "\n").split("\n")
    run = PARSERS[lang]
    events = run("\n".join(lines), flags or 0, notfunctions) if run in FLAGGED else run("\n".join(lines))
    return [(k, tag, n, lines[n - 1]) for k, tag, n in events if 0 < len(tag.encode()) < 512]
