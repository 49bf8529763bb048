"""Parsing expression grammars: ordered choice, sequence, repetition, lookahead and named tree nodes.

A parser is a function of text and position that gives None or the end and a list of nodes; a node is (name, text, children).
"""

from __future__ import annotations

import re
from collections.abc import Callable

Node = tuple[str, str, list]
Parser = Callable[[str, int], tuple[int, list] | None]


def token(pattern: str) -> Parser:
    """Text that matches the pattern; it leaves no node."""
    match = re.compile(pattern).match

    def parse(s: str, i: int):
        m = match(s, i)
        return (m.end(), []) if m else None

    return parse


def seq(*parts: Parser) -> Parser:
    def parse(s: str, i: int):
        nodes: list = []
        for p in parts:
            if (r := p(s, i)) is None:
                return None
            i = r[0]
            nodes += r[1]
        return i, nodes

    return parse


def choice(*parts: Parser) -> Parser:
    def parse(s: str, i: int):
        for p in parts:
            if (r := p(s, i)) is not None:
                return r
        return None

    return parse


def by_first(options: dict[str, Parser], other: Parser) -> Parser:
    """Ordered choice that looks at the next character first: the option whose key holds it, else the other."""
    table = {c: p for key, p in options.items() for c in key}
    get = table.get

    def parse(s: str, i: int):
        return get(s[i], other)(s, i) if i < len(s) else None

    return parse


def many(part: Parser) -> Parser:
    def parse(s: str, i: int):
        nodes: list = []
        while (r := part(s, i)) is not None and r[0] > i:
            i = r[0]
            nodes += r[1]
        return i, nodes

    return parse


def maybe(part: Parser) -> Parser:
    return lambda s, i: part(s, i) or (i, [])


def ahead_not(part: Parser) -> Parser:
    return lambda s, i: (i, []) if part(s, i) is None else None


def named(name: str, part: Parser) -> Parser:
    def parse(s: str, i: int):
        r = part(s, i)
        return None if r is None else (r[0], [(name, s[i : r[0]], r[1])])

    return parse


def where(part: Parser, ok: Callable[[list], bool]) -> Parser:
    """The part, if its nodes pass a test."""

    def parse(s: str, i: int):
        r = part(s, i)
        return r if r is not None and ok(r[1]) else None

    return parse


def later(get: Callable[[], Parser]) -> Parser:
    """A rule that refers to one defined further down."""
    return lambda s, i: get()(s, i)
