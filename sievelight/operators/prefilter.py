"""Which patterns can match a text at all, by the literals that each of them needs.

A pattern's needed literals are read off its syntax tree: a set of which every match holds at least one. One automaton
over the literals of all patterns passes over a text once, and only patterns of which a literal was met are run on it.
Letters are compared without case, as patterns that ignore case need it; that can only let more patterns through.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Literals of a set at most; shorter ones than two characters count only if they aren't ASCII.
MOST = 64


def folded(text: str) -> str:
    """Without case; what a pattern without case takes for i is i."""
    return text.lower() if text.isascii() else text.replace("İ", "i").replace("ı", "i").casefold()


def _class(items) -> set[str] | None:
    """The characters of a class, if they are few."""
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value))
        elif op is C.RANGE and value[1] - value[0] < MOST:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST else None


def _worth(literals: set[str] | None) -> tuple[int, int]:
    return (0, 0) if not literals else (min(len(x) if x.isascii() else 9 for x in literals), -len(literals))


def needed(tree) -> set[str] | None:
    """A set of which each match of a parsed pattern holds a literal; None if none is known."""
    found: list[set[str]] = []
    runs: set[str] = {""}  # what stands together just now

    def end() -> None:
        nonlocal runs
        if "" not in runs:
            found.append(runs)
        runs = {""}

    def extend(more: set[str]) -> None:
        nonlocal runs
        if len(runs) * len(more) > MOST:
            end()
        runs = {a + b for a in runs for b in more}

    for op, value in tree:
        if op is C.LITERAL:
            extend({chr(value)})
        elif op is C.IN and (few := _class(value)) and len(few) <= 8:
            extend(few)
        elif op is C.IN and (few := _class(value)):
            end()
            found.append(few)
        elif op in (C.SUBPATTERN, C.ATOMIC_GROUP):
            inner = needed(value[-1] if op is C.SUBPATTERN else value)
            end()
            if inner:
                found.append(inner)
        elif op is C.BRANCH:
            end()
            parts = [needed(x) for x in value[1]]
            if all(parts) and sum(map(len, parts)) <= MOST:
                found.append(set().union(*parts))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = needed(value[2])
            end()
            if inner:
                found.append(inner)
        elif op is not C.AT and op not in (C.ASSERT, C.ASSERT_NOT):
            end()
    end()
    return max(found, key=_worth, default=None)


@lru_cache(maxsize=None)
def literals(pattern: str) -> frozenset[str] | None:
    """The folded literals of a pattern; None where it must always be run."""
    got = needed(parser.parse(pattern))
    got = {folded(x) for x in got} if got else None
    return frozenset(got) if got and all(len(x) > 1 or not x.isascii() for x in got) else None


@lru_cache(maxsize=8)
def _automaton(patterns: tuple[str, ...]):
    holders: dict[str, set[int]] = {}
    for i, p in enumerate(patterns):
        for x in literals(p) or ():
            holders.setdefault(x, set()).add(i)
    out = ahocorasick.Automaton()
    for x, who in holders.items():
        out.add_word(x, frozenset(who))
    out.make_automaton()
    return out, [i for i, p in enumerate(patterns) if literals(p) is None]


def met(text: str, patterns: tuple[str, ...]) -> list[int]:
    """The numbers of the patterns that can match a text, in order."""
    automaton, always = _automaton(patterns)
    found = set(always)
    for who in {w for _, w in automaton.iter(folded(text))} if len(automaton) else ():
        found |= who
    return sorted(found)


def possible(text: str | Column, patterns: tuple[str, ...]) -> Column:
    """The numbers of the patterns that can match a text, as a column."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else met(t, patterns) for t in s], dtype=object)

    return run(F.col(text) if isinstance(text, str) else text)
