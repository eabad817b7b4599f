"""The search mini-language: a lenient parser that never raises.

words (AND by default), OR, + and -, "phrases", (groups), ^boost, field:word, field:"phrase",
exact filters (site: domain: type: lang: collection: doc_type: crawl_id: url:, and crawl: for crawl_id),
numbers (year: month: status: modified:) and ranges field:[a TO b] or {a TO b}, * for an open end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from webquarry.model import TEXT_FIELDS

EXACT = ("site", "domain", "type", "lang", "collection", "doc_type", "crawl_id", "url", "crawl_name", "timestamp")
NUMERIC = ("year", "month", "status", "modified")
ALIASES = {"crawl": "crawl_id"}
#: Fields that single-token filters may name, with the labels of their chips.
FILTERS = {"collection": "Collection", "year": "Year", "site": "Site", "type": "Type", "lang": "Language", "month": "Month", "domain": "Host", "status": "Status", "modified": "Modified", "crawl": "Crawl"}

WORD = re.compile(r"[^\W_]+", re.UNICODE)


def analyse(text: str) -> list[str]:
    return [t for t in WORD.findall(text.lower()) if len(t.encode()) <= 40]


@dataclass(frozen=True)
class Leaf:
    """A word (one term) or a phrase (several) in some fields."""

    terms: tuple[str, ...]
    fields: tuple[str, ...] = TEXT_FIELDS
    boost: float = 1.0


@dataclass(frozen=True)
class Filter:
    """field = value, or low..high with open or excluded ends."""

    field: str
    value: str | None = None
    low: str | None = None
    high: str | None = None
    low_in: bool = True
    high_in: bool = True


@dataclass
class Node:
    op: str  # and, or, not
    parts: list = field(default_factory=list)


_token = re.compile(
    r"""\s+ | (?P<paren>[()]) | (?P<sign>[+-])(?=\S)
    | (?P<field>[A-Za-z_]+):(?=\S) | (?P<range>[\[{][^\]}]*[\]}]?) | "(?P<phrase>[^"]*)"? | (?P<boost>\^[0-9.]+) | (?P<word>[^\s()"^]+)""",
    re.VERBOSE,
)


def tokenise(q: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(q):
        m = _token.match(q, at)
        if not m:
            at += 1
            continue
        kind = m.lastgroup
        if kind == "range" and (not out or out[-1][0] != "field"):
            kind, m = "word", re.compile(r"\S+").match(q, at)
            out.append(("word", m.group()))
        elif kind == "sign" and at and not q[at - 1].isspace() and q[at - 1] != "(":
            out.append(("word", m.group()))
        elif kind == "field" and m.group("field").lower() not in (*TEXT_FIELDS, *EXACT, *NUMERIC, *ALIASES):
            m = re.compile(r"[^\s()\"^]+").match(q, at)
            out.append(("word", m.group()))
        elif kind == "field" and m.group("field") in (*EXACT, *ALIASES) and (v := re.compile(r"[^\s()\"]+").match(q, m.end())):
            out += [("field", m.group("field")), ("word", v.group())]
            m = v
        elif kind:
            out.append((kind, m.group(kind)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> tuple[str, str] | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self):
        parts = [self.all_of()]
        while self.peek() == ("word", "OR"):
            self.take()
            parts.append(self.all_of())
        parts = [p for p in parts if p is not None]
        return parts[0] if len(parts) == 1 else Node("or", parts) if parts else None

    def all_of(self):
        parts = []
        while (t := self.peek()) and t != ("paren", ")") and t != ("word", "OR"):
            if t == ("word", "AND"):
                self.take()
                continue
            not_ = t in (("sign", "-"), ("word", "NOT"))
            if not_ or t == ("sign", "+"):
                self.take()
            if (part := self.one()) is not None:
                parts.append(Node("not", [part]) if not_ else part)
        return parts[0] if len(parts) == 1 else Node("and", parts) if parts else None

    def one(self):
        if not self.peek() or self.peek() in (("paren", ")"), ("word", "OR")):
            return None
        kind, text = self.take()
        if kind == "paren":
            inner = self.either()
            if self.peek() == ("paren", ")"):
                self.take()
            return self.boosted(inner)
        if kind == "field":
            name = ALIASES.get(text.lower(), text.lower())
            nxt = self.peek()
            if not nxt or nxt[0] not in ("word", "phrase", "range", "sign"):
                return None
            kind, value = self.take()
            if kind == "sign" and self.peek() and self.peek()[0] == "word":
                value += self.take()[1]
            if kind == "range":
                return self.range(name, value)
            if name in EXACT:
                return Filter(name, value)
            if name in NUMERIC:
                return Filter(name, value) if re.fullmatch(r"\d+", value) else None
            return self.boosted(self.leaf(value, (name,)))
        if kind in ("word", "phrase", "range"):
            return self.boosted(self.leaf(text, TEXT_FIELDS))
        return None

    def leaf(self, text: str, fields: tuple[str, ...]):
        terms = analyse(text)
        return Leaf(tuple(terms), fields) if terms else None

    def boosted(self, part):
        nxt = self.peek()
        if nxt and nxt[0] == "boost":
            self.take()
            try:
                by = float(nxt[1][1:])
            except ValueError:
                return part
            return scale(part, by)
        return part

    def range(self, name: str, text: str):
        m = re.fullmatch(r"([\[{])\s*(\S+)\s+TO\s+(\S+?)\s*([\]}])", text)
        if not m or name not in (*NUMERIC, *EXACT):
            return None
        low, high = (None if x == "*" else x for x in m.group(2, 3))
        if name in NUMERIC and any(x is not None and not x.isdigit() for x in (low, high)):
            return None
        return Filter(name, None, low, high, m.group(1) == "[", m.group(4) == "]")


def scale(part, by: float):
    if isinstance(part, Leaf):
        return Leaf(part.terms, part.fields, part.boost * by)
    if isinstance(part, Node):
        return Node(part.op, [scale(p, by) for p in part.parts])
    return part


def parse(q: str):
    """The query's tree, or None for an empty query. Whatever can't be read is left out."""
    parser, parts = _Parser(tokenise(q)), []
    while parser.peek():
        part = parser.either()
        if part is not None:
            parts.append(part)
        if parser.peek() == ("paren", ")"):
            parser.take()
    return parts[0] if len(parts) == 1 else Node("and", parts) if parts else None


def leaves(node, positive: bool = True) -> list[tuple[Leaf, bool]]:
    if isinstance(node, Leaf):
        return [(node, positive)]
    if isinstance(node, Node):
        return [x for p in node.parts for x in leaves(p, positive != (node.op == "not"))]
    return []


# ---------------------------------------------------------------- filters as text


def active_filters(q: str) -> list[tuple[str, str]]:
    pairs = (t.partition(":") for t in q.split())
    return [(f, v) for f, colon, v in pairs if colon and v and f in FILTERS]


def with_filter(q: str, name: str, value: str) -> str:
    token, base = f"{name}:{value}", q.strip()
    return base if token in base.split() else f"{base} {token}".strip()


def without_filter(q: str, name: str, value: str) -> str:
    return " ".join(t for t in q.split() if t != f"{name}:{value}")


def filter_label(name: str) -> str:
    return FILTERS.get(name, "Filter")


def scoped(q: str, scope: str) -> str:
    """The query with a scope ANDed in front, once."""
    scope, q = scope.strip(), q.strip()
    return q if not scope or q.startswith(scope) else f"{scope} {q}".strip()
