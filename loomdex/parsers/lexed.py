"""A plug-in parser for any language a lexer library knows; it is used only where that library is installed."""

from __future__ import annotations

from loomdex.parsers.symbols import DEF, REF, Event, register

try:
    from pygments.lexers import get_lexer_by_name
    from pygments.token import Token
    from pygments.util import ClassNotFound
except ImportError:  # optional
    get_lexer_by_name = None


def parse_lexed(name: str, text: str) -> list[Event]:
    """Names the lexer marks as those of functions, classes or namespaces are definitions, other names references; a
    reference on the line of a definition of the same name is left out."""
    if get_lexer_by_name is None:
        return []
    try:
        lexer = get_lexer_by_name(name, stripnl=False, ensurenl=False)
    except ClassNotFound:
        return []
    out, line = [], 1
    for kind, value in lexer.get_tokens(text):
        if kind in Token.Name and value.strip():
            is_def = kind in Token.Name.Function or kind in Token.Name.Class
            out.append((DEF if is_def else REF, value.strip(), line))
        line += value.count("\n")
    defined = {(tag, n) for k, tag, n in out if k == DEF}
    return [x for x in out if x[0] == DEF or (x[1], x[2]) not in defined]


def register_lexed(*langs: str) -> list[str]:
    """Uses lexers for these languages; returns those that can be."""
    if get_lexer_by_name is None:
        return []
    for lang in langs:
        register(lang, lambda text, name=lang: parse_lexed(name, text))
    return list(langs)
