"""A generalised LL recogniser with a graph-structured stack, over grammars written as recursive transition networks.

A grammar is text: ``rule = body ;`` where a body has alternatives (|), groups ( ), repetition (* + ?), quoted terminals,
token classes in capitals and rule names in small letters. ``NOT[' a b ']`` is any token but those, ``GROUP`` any group. ``@name`` in an alternative
restricts it to the dialect of that name. Rules are compiled to automata; all dialects run together over one stack: every
descriptor carries the set of dialects that reach it, as bits.

Texts are contracted from the inside out: a group in braces (or an indented block) is recognised by itself and becomes one token that
says which rules accept it and in which dialects. So the tokens of a statement are few and most statements are known.
"""

from __future__ import annotations

import re
from collections import defaultdict

END = "<end>"
#: Rules whose texts are parsed apart and remembered.
PARTS = {"statement", "unit", "member", "field", "rule"}
OPENERS, CLOSERS, PART_ENDS = {"(", "[", "{", "INDENT"}, {")", "]", "}", "DEDENT"}, {";", "}", "NEWLINE", "DEDENT"}
#: Tokens of the longest part or group that is remembered, how many are, and how deep parts nest at most before the one stack
#: goes on by itself.
LONGEST, REMEMBERED, DEPTH = 96, 50_000, 60
PAIRS = {"(": ")", "[": "]", "{": "}", "INDENT": "DEDENT"}
BRACKETS = OPENERS | CLOSERS
#: Elements at either end of a list that are always kept; no rule tells apart more.
ENDMOST = 3
#: What a list element that is taken out doesn't hold outside brackets.
ENTANGLED = {";", "NEWLINE", "INDENT", "DEDENT", "%%", "%{", "%}"}
_PART = re.compile(r"\s*(NOT\['[^']*'\]|'[^']*'|@\w+|[A-Za-z_]\w*|[|()*+?=;])")


class _Rules:
    """Reads the text of a grammar into automata with empty moves."""

    def __init__(self, text: str) -> None:
        text = re.sub(r"(?m)^\s*--.*$", "", text).strip()
        self.parts, at = [], 0
        while at < len(text):
            m = _PART.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at : at + 40]!r}")
            self.parts.append(m[1])
            at = m.end()
        self.moves: list[list[tuple[str, object, int]]] = []
        self.rules: dict[str, tuple[int, int]] = {}
        self.at = 0
        while self.at < len(self.parts):
            name = self.parts[self.at]
            assert self.parts[self.at + 1] == "=", name
            self.at += 2
            ends = self.state(), self.state()
            self.rules[name] = ends
            self.choice(*ends)
            assert self.parts[self.at] == ";", (name, self.parts[self.at])
            self.at += 1

    def state(self) -> int:
        self.moves.append([])
        return len(self.moves) - 1

    def choice(self, a: int, b: int) -> None:
        while True:
            x = a
            while self.parts[self.at] not in ("|", ")", ";"):
                x = self.item(x)
            self.moves[x].append(("", None, b))
            if self.parts[self.at] != "|":
                return
            self.at += 1

    def item(self, a: int) -> int:
        p = self.parts[self.at]
        self.at += 1
        x, y = self.state(), self.state()
        self.moves[a].append(("", None, x))
        if p == "(":
            self.choice(x, y)
            self.at += 1
        elif p.startswith("NOT["):
            self.moves[x].append(("not", frozenset(p[5:-2].split()), y))
        elif p[0] == "@":
            self.moves[x].append(("", p[1:], y))
        elif p[0] == "'":
            self.moves[x].append(("token", p[1:-1], y))
        elif p.isupper():
            self.moves[x].append(("token", "@" if p == "GROUP" else p, y))
        else:
            self.moves[x].append(("call", p, y))
        mark = self.parts[self.at]
        if mark in "*+?":
            self.at += 1
            if mark in "*+":
                self.moves[y].append(("", None, x))
            if mark in "*?":
                self.moves[x].append(("", None, y))
        return y


class Grammar:
    """Tables of a grammar: by state and token, what to read and what to call, each with its dialects.

    groups: rules whose texts stand between the brackets ``pair``; ``@rule`` is the token of a group such a rule accepts, ``@`` that of
    any group. angles: ``<`` and ``>`` are brackets, too, so list elements that hold them stay."""

    def __init__(self, text: str, groups: tuple[str, ...] = (), pair: tuple[str, str] = ("{", "}"), dialects: tuple[str, ...] = ("",), angles: bool = False) -> None:
        g = _Rules(text)
        self.groups, self.pair, self.entangled = groups, pair, ENTANGLED | ({"<", ">"} if angles else set())
        self.all = (1 << len(dialects)) - 1
        bit = {None: self.all} | {name: 1 << i for i, name in enumerate(dialects)}
        near = [self._reach(g.moves, s, bit) for s in range(len(g.moves))]
        rule_of = {}
        for name, (a, _) in g.rules.items():
            todo = [a]
            while todo:
                s = todo.pop()
                if s not in rule_of:
                    rule_of[s] = name
                    todo += [t for _, _, t in g.moves[s]]
        self.tokens = {END} | {label for s in g.moves for kind, label, _ in s if kind == "token"} | {x for s in g.moves for kind, label, _ in s if kind == "not" for x in label}
        self.words = {t for t in self.tokens if re.fullmatch(r"[A-Za-z_]\w*", t) and not t.isupper()}
        self.tokens |= {"OTHER", "@", *("@" + r for r in groups)}
        self.parts = PARTS & set(g.rules)
        self.items = {r: m[1] for r in groups if (m := re.search(rf"(?m)^{r} = \S+ (\w+)[*+] \S+ ;$", text)) and m[1] in self.parts}
        self.known: dict[tuple, tuple[list[tuple[int, int]], int]] = {}
        self.grouped: dict[tuple, str] = {}
        self.made: dict[str, str] = {}
        self.start = {name: a for name, (a, _) in g.rules.items()}
        self.final = [near[s].get(g.rules[rule_of[s]][1], 0) if s in rule_of else 0 for s in range(len(g.moves))]
        moves = [[(kind, label, t, mask) for x, mask in near[s].items() for kind, label, t in g.moves[x] if kind] for s in range(len(g.moves))]
        first: dict[str, set[str]] = defaultdict(set)
        for r in groups:
            first[r].add("@" + r)
        empty: set[str] = set()
        changed = True
        heads = lambda kind, label: {label} if kind == "token" else self.tokens - label - {END} if kind == "not" else first[label]
        while changed:
            changed = False
            for name, (a, _) in g.rules.items():
                todo, seen, got = [a], {a}, set()
                while todo:
                    s = todo.pop()
                    if self.final[s] and name not in empty:
                        empty.add(name)
                        changed = True
                    for kind, label, t, _ in moves[s]:
                        got |= heads(kind, label)
                        if kind == "call" and label in empty and t not in seen:
                            seen.add(t)
                            todo.append(t)
                if not got <= first[name]:
                    first[name] |= got
                    changed = True
        self.before = self._before(g, empty)
        self.read: list[dict[str, tuple[tuple[int, int], ...]]] = []
        self.calls: list[dict[str, tuple[tuple[str, int, int], ...]]] = []
        for s in range(len(moves)):
            read, calls = defaultdict(list), defaultdict(list)
            for kind, label, t, mask in dict.fromkeys(moves[s]):
                if kind == "call":
                    for x in self.tokens if label in empty else first[label]:
                        if x == "@" + label:
                            read[x].append((t, mask))
                        else:
                            calls[x].append((label, t, mask))
                else:
                    for x in heads(kind, label):
                        read[x].append((t, mask))
            self.read.append({k: tuple(v) for k, v in read.items()})
            self.calls.append({k: tuple(v) for k, v in calls.items()})

    @staticmethod
    def _reach(moves: list, s: int, bit: dict) -> dict[int, int]:
        """The states reached without a token, and in which dialects."""
        out, todo = {s: bit[None]}, [s]
        while todo:
            x = todo.pop()
            for kind, label, t in moves[x]:
                if not kind and (mask := out[x] & bit[label]) & ~out.get(t, 0):
                    out[t] = out.get(t, 0) | mask
                    todo.append(t)
        return out

    def _before(self, g: _Rules, empty: set[str]) -> dict[str, tuple[str, ...]]:
        """By token (or none, at the begin) the group rules whose text may follow it; by ``@`` those that may follow a group."""
        prev: list[set[str]] = [set() for _ in g.moves]
        for a, _ in g.rules.values():
            prev[a].add("")
        changed = True
        while changed:
            changed = False
            for s, moves in enumerate(g.moves):
                for kind, label, t in moves:
                    if kind == "token":
                        got = {label}
                    elif kind == "not":
                        got = self.tokens - label
                    elif kind == "call":
                        a, z = g.rules[label]
                        if not prev[s] <= prev[a]:
                            prev[a] |= prev[s]
                            changed = True
                        got = prev[z] - {""} | (prev[s] if label in empty else set()) | ({"@"} if label in self.groups else set())
                    else:
                        got = prev[s]
                    if not got <= prev[t]:
                        prev[t] |= got
                        changed = True
        return {x: tuple(r for r in self.groups if x in prev[g.rules[r][0]]) for x in self.tokens | {""}}

    def group(self, inner: tuple[str, ...], rules: tuple[str, ...]) -> str:
        """The token of a group, brackets included: which of the rules accept it, in which dialects."""
        name = self.grouped.get((rules, inner))
        if name is None:
            asked, labels = (*inner, END), []
            borders = self.borders(asked)
            for r in rules:
                if not any(inner[1] in self.read[t] or inner[1] in self.calls[t] for t, _ in self.read[self.start[r]][inner[0]]):
                    continue
                if r in self.items:
                    mask = self.sequence(self.items[r], asked, 1, len(inner) - 1, borders)
                else:
                    mask = self.ends((r,), asked, 0, borders)[0].get(len(inner), 0)
                if mask:
                    labels.append((r, mask))
            name = "{" + ",".join(f"{r}:{m}" for r, m in labels) + "}"
            if name not in self.made:
                self.made[name] = name
                for read, calls in zip(self.read, self.calls, strict=True):
                    for table in (read, calls):
                        got = dict.fromkeys(table.get("@", ()))
                        for r, m in labels:
                            got |= dict.fromkeys((*x[:-1], x[-1] & m) for x in table.get("@" + r, ()) if x[-1] & m)
                        if got:
                            table[name] = tuple(got)
            if len(inner) <= LONGEST:
                if len(self.grouped) >= REMEMBERED:
                    self.grouped.clear()
                self.grouped[rules, inner] = name
        return name

    def contracted(self, tokens: list[str]) -> list[str] | None:
        """The tokens with each group as one token and long lists shortened; null where brackets don't pair."""
        last, before = self.pair[1], self.before
        out: list[str] = []
        stack: list[tuple[int, str]] = []  # of open brackets: place, and what closes it
        done = 0
        for i in [i for i, t in enumerate(tokens) if t in BRACKETS]:
            out += tokens[done:i]
            done = i + 1
            t = tokens[i]
            if t in PAIRS:
                stack.append((len(out), PAIRS[t]))
                out.append(t)
                continue
            if not stack:
                return None
            at, want = stack.pop()
            if want != t:
                return None
            if len(out) - at > 4 * ENDMOST:
                out[at + 1 :] = self.shortened(out[at + 1 :])
            out.append(t)
            if t == last:
                x = out[at - 1] if at else ""
                out[at:] = [self.group(tuple(out[at:]), before["@" if x in self.made else x] if x != "NL" else self.groups)]
        return None if stack else self.shortened(out + tokens[done:])

    def borders(self, tokens: tuple[str, ...]) -> list[int]:
        """For each place the next place where, at the same depth of brackets, a part ends; the last place if none."""
        last = len(tokens) - 1
        out, stack = [last] * len(tokens), [last]
        for i in range(last, -1, -1):
            t = tokens[i]
            if t in CLOSERS:
                if t in PART_ENDS:
                    stack[-1] = i
                stack.append(last)
            elif t in OPENERS:
                if len(stack) > 1:
                    stack.pop()
            elif t in PART_ENDS or t in self.made:
                stack[-1] = i
            out[i] = stack[-1]
        return out

    def ends(self, rules: tuple[str, ...], tokens: tuple[str, ...], at: int, borders: list[int] | None = None, depth: int = 0) -> tuple[dict[int, int], int]:
        """Where a text of one of the rules that begins at token ``at`` can end, with the dialects in which it can, and the last
        token looked at for it. tokens ends with END.

        Rules in PARTS are recognised apart and remembered by the tokens that were looked at, so equal statements of all
        texts are parsed once; what a rule accepts at a place depends on nothing else."""
        read, calls, final, start, parts, every = self.read, self.calls, self.final, self.start, self.parts, self.all
        if borders is None:
            borders = self.borders(tokens)
        # a stack node: callers [(state to go on in, node, dialects)], ends so far, moves made
        top: tuple[list, dict, dict] = ([], {}, {})
        nodes = {}
        todo = [(start[r], top, at, every) for r in rules]
        far = at
        while todo:
            state, node, pos, mask = todo.pop()
            key = (state, pos)
            had = node[2].get(key, 0)
            mask &= ~had
            if not mask:
                continue
            node[2][key] = had | mask
            token = tokens[pos]
            if pos > far:
                far = pos
            ended = final[state] & mask & ~node[1].get(pos, 0)
            if ended:
                node[1][pos] = node[1].get(pos, 0) | ended
                for s, n, m in node[0]:
                    if m & ended:
                        todo.append((s, n, pos, m & ended))
            if token == "NL":  # a line end that may also mean nothing
                todo.append((state, node, pos + 1, mask))
            for s, m in read[state].get(token, ()):
                if m & mask:
                    todo.append((s, node, pos + 1, m & mask))
            for rule, s, m in calls[state].get(token, ()):
                m &= mask
                if not m:
                    continue
                child = nodes.get((rule, pos))
                if child is None:
                    nodes[rule, pos] = child = ([(s, node, m)], {}, {})
                    if rule in parts and depth < DEPTH and not (pos == at and rule in rules):
                        got, seen = self.part(rule, tokens, pos, borders, depth)
                        if seen > far:
                            far = seen
                        child[1].update(got)
                        todo += [(s, node, p, m & e) for p, e in got if m & e]
                    else:
                        todo.append((start[rule], child, pos, every))
                else:
                    for c in child[0]:
                        if c[0] == s and c[1] is node and not m & ~c[2]:
                            break
                    else:
                        child[0].append((s, node, m))
                        todo += [(s, node, p, m & e) for p, e in child[1].items() if m & e]
        return top[1], far

    def part(self, rule: str, tokens: tuple[str, ...], at: int, borders: list[int], depth: int) -> tuple[list[tuple[int, int]], int]:
        """``ends`` of a rule, remembered by the tokens up to the first, second or third border, whichever covers what
        was looked at."""
        keys, border, last = [], at, len(tokens) - 1
        for _ in range(3):
            border = borders[border]
            if border - at > LONGEST:
                break
            key = rule, tokens[at : border + 2]
            found = self.known.get(key)
            if found is not None:
                return [(at + e, m) for e, m in found[0]], at + found[1]
            keys.append((border + 1, key))
            if border >= last:
                break
            border += 1
        got, far = self.ends((rule,), tokens, at, borders, depth + 1)
        for upto, key in keys:
            if far <= upto:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[key] = [(e - at, m) for e, m in got.items()], far - at
                break
        return list(got.items()), far

    def shortened(self, tokens: list[str]) -> list[str]:
        """What stands in one pair of brackets, or in none, with long lists shortened: of the elements of a list all but the ENDMOST first and
        last ones come once for each form. No rule counts more elements or asks for an order among them, so what accepts
        the one accepts the other, and a table of a million numbers needs no stack of that size. Every text is read so,
        whatever its size.

        That holds for elements that are whole in themselves only. Where an element opens or closes what another closes or
        opened (a bracket, a conditional), all stay."""
        if tokens.count(",") <= 2 * ENDMOST:
            return tokens
        out: list[str] = []
        run: list[tuple[int, int]] = []  # whole elements, comma included, that follow one another
        begin, depth, asked, whole, dropped = 0, 0, 0, True, False

        def put() -> None:
            nonlocal dropped
            seen: set[tuple[str, ...]] = set()
            for i, (a, b) in enumerate(run):
                if ENDMOST <= i < len(run) - ENDMOST:
                    form = tuple(tokens[a:b])
                    if form in seen:
                        dropped = True
                        continue
                    seen.add(form)
                out.extend(tokens[a:b])
            run.clear()

        for i, t in enumerate(tokens):
            if t in PAIRS:
                depth += 1
            elif t in CLOSERS:
                depth -= 1
            elif depth:
                continue
            elif t == ",":
                if whole and not asked:
                    run.append((begin, i + 1))
                else:
                    put()
                    out.extend(tokens[begin : i + 1])
                begin, whole = i + 1, not asked
            elif t in self.entangled:
                whole = False
                if t in (";", "NEWLINE"):
                    asked = 0
            elif t in ("?", "lambda"):
                asked += 1
            elif t == ":":
                asked -= asked > 0
        put()
        return out + tokens[begin:] if dropped else tokens

    def sequence(self, item: str, tokens: tuple[str, ...], at: int, stop: int, borders: list[int]) -> int:
        """The dialects in which the tokens from ``at`` to ``stop`` are texts of a rule, one after the other, or none at all."""
        todo, out = {at: self.all}, 0
        while todo:
            at = min(todo)
            mask = todo.pop(at)
            while tokens[at] == "NL":
                at += 1
            if at == stop:
                out |= mask
                continue
            for e, m in self.part(item, tokens, at, borders, 0)[0]:
                if at < e <= stop and m & mask:
                    todo[e] = todo.get(e, 0) | m & mask
        return out

    def accepts(self, items: tuple[str, ...], tokens: list[str]) -> int:
        """The dialects in which tokens (ending with END) are a sequence of items, one of the rules each; 0 if in none. One dialect holds
        for the whole text.

        The stack is dropped after each item, so its size follows the longest item, not the text."""
        short = self.contracted(tokens)
        if short is None:
            return 0
        tokens = tuple(short)
        return self.sequence(items[0], tokens, 0, len(tokens) - 1, self.borders(tokens))
