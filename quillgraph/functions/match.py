"""Match expressions over the terms of a text, as one boolean column.

    error AND ("connection refused" OR timeou*) NOT retry

Words, quoted phrases, ``*`` behind the last term for a prefix, ``^`` before a
phrase that must begin the text, ``+`` between parts of one phrase, ``NEAR(a b,
n)``, parentheses, AND, OR and NOT (with something before it).  NOT binds closer
than AND, AND closer than OR, and terms side by side closest of all.  A phrase
without a letter or digit matches nothing, but is left out of terms side by side.
Anything else raises ValueError.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions import text as X

_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([()*+^,])|([\w\u001a]+))')


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False

    def test(self, terms: Column) -> Column:
        """Whether the terms of a text hold the phrase."""
        if len(self.terms) == 1 and not self.first:
            return F.exists(terms, lambda t: t.startswith(self.terms[0])) if self.prefix else F.array_contains(terms, self.terms[0])
        return F.exists(self.places(terms), lambda i: i >= 0)

    def places(self, terms: Column) -> Column:
        """Where the phrase begins."""
        none = F.array().cast("array<int>")
        n = len(self.terms)
        at = F.array(F.lit(0)) if self.first else F.sequence(F.lit(0), F.size(terms) - n)

        def here(i: Column) -> Column:
            same = [F.get(terms, i + k) == t for k, t in enumerate(self.terms)]
            if self.prefix:
                same[-1] = F.get(terms, i + (n - 1)).startswith(self.terms[-1])
            return reduce(Column.__and__, same)

        return F.when(F.size(terms) >= n, F.filter(at, here)).otherwise(none)


@dataclass(frozen=True)
class Near:
    """Phrases with at most ``gap`` terms between the end of the first of them and
    the begin of the last."""

    phrases: tuple[Phrase, ...]
    gap: int

    def test(self, terms: Column) -> Column:
        """A choice of one place a phrase fits if it fits right of its leftmost
        place, so each place of each phrase is tried as that."""

        def fits(lead: Phrase) -> Column:
            def here(i: Column) -> Column:
                reach = i + (len(lead.terms) + self.gap)
                rest = [F.exists(p.places(terms), lambda j: (j >= i) & (j <= reach)) for p in self.phrases if p is not lead]
                return reduce(Column.__and__, rest, F.lit(True))

            return F.exists(lead.places(terms), here)

        return reduce(Column.__or__, [fits(p) for p in self.phrases])


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no match expression at {text[at:at + 20]!r}")
            self.tokens.append(("s", m[1][1:-1].replace('""', '"')) if m[1] is not None else ("p", m[2]) if m[2] else ("w", m[3]))
            at = m.end()
        self.at = 0

    def take(self, kind: str, *values: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == kind and self.tokens[self.at][1] in values:
            self.at += 1
            return True
        return False

    def need(self, kind: str, value: str) -> None:
        if not self.take(kind, value):
            raise ValueError(f"match expression: {value} expected")

    def begins(self) -> bool:
        """Whether something to match begins here."""
        if self.at >= len(self.tokens):
            return False
        kind, value = self.tokens[self.at]
        return kind == "s" or value in ("(", "^") or (kind == "w" and value not in ("AND", "OR", "NOT"))

    def either(self):
        left = self.both()
        while self.take("w", "OR"):
            right = self.both()
            left = ("or", left, right) if left and right else left or right
        return left

    def both(self):
        left = self.without()
        while self.take("w", "AND"):
            right = self.without()
            left = ("and", left, right) if left and right else None
        return left

    def without(self):
        left = self.beside()
        while self.take("w", "NOT"):
            right = self.beside()
            left = ("not", left, right) if left and right else left
        return left

    def beside(self):
        left = self.one()
        while self.begins():
            if self.tokens[self.at] == ("p", "("):
                break
            right = self.one()
            left = ("and", left, right) if left and right else left or right
        return left

    def one(self):
        if self.take("p", "("):
            inner = self.either()
            self.need("p", ")")
            return inner
        if self.at + 1 < len(self.tokens) and self.tokens[self.at] == ("w", "NEAR") and self.tokens[self.at + 1] == ("p", "("):
            return self.near()
        return self.phrase()

    def near(self):
        self.at += 2
        found, gap = [], 10
        while not self.take("p", ")"):
            if self.take("p", ","):
                kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "w" or not value.isdigit():
                    raise ValueError("match expression: a number expected")
                gap, self.at = int(value), self.at + 1
                self.need("p", ")")
                break
            found.append(self.phrase())
        found = [p for p in found if p]
        return None if not found else found[0] if len(found) == 1 else Near(tuple(found), gap)

    def phrase(self) -> Phrase | None:
        first = self.take("p", "^")
        terms: list[str] = []
        prefix = False
        while True:
            kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind not in ("s", "w") or (kind == "w" and value in ("AND", "OR", "NOT")):
                raise ValueError("match expression: a word or phrase expected")
            self.at += 1
            terms += fold(value)
            if not self.take("p", "+"):
                break
        prefix = self.take("p", "*")
        return Phrase(tuple(terms), prefix, first) if terms else None


def fold(text: str) -> list[str]:
    """The terms of a text, as the index of terms folds them."""
    plain = "".join(ch for ch in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(ch))
    return [t for t in re.split(r"[\W_]+", plain) if t]


def parse(expression: str):
    """The tree of an expression: phrases, ``Near``, or (operator, left, right);
    None if nothing in it can match."""
    parser = _Parser(expression)
    if not parser.tokens:
        return None
    tree = parser.either()
    if parser.at < len(parser.tokens):
        raise ValueError(f"match expression: {parser.tokens[parser.at][1]!r} is out of place")
    return tree


def _column(tree, terms: Column) -> Column:
    if isinstance(tree, (Phrase, Near)):
        return tree.test(terms)
    kind, left, right = tree[0], _column(tree[1], terms), _column(tree[2], terms)
    return left & right if kind == "and" else left | right if kind == "or" else left & ~right


def match(text: Column, expression: str) -> Column:
    """Whether a text matches an expression; the text's terms are made once."""
    tree = parse(expression)
    return F.lit(False) if tree is None else X.let(X.index_terms(text), lambda terms: _column(tree, terms))
