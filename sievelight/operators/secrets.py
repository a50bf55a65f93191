"""Secrets on their way out of a text: keys, tokens, seed phrases, requests, and flows to a destination outside.

Which words stand near which others, and in what order, decides here; so texts are read by a function over Arrow batches, which
goes on with those that name any secret at all, by one pass of an automaton that few texts stop. A statement (up to a full stop, or a line end) is a
row of marks: secrets, verbs, destinations, pronouns, transforms, each kind with its places in order. A verb of handing on
takes the secret after it, or, with a pronoun behind it, the last one before it, be it from an earlier statement of the
same paragraph in which it was read from somewhere. Secrets that are absent, masked or documents are excused, verbs that
are negated or wait for masking as well.

Null and blank texts have no detections. Long texts are read whole, and every match counts, however far apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions import analyzer_rules as A

from .links import CREDENTIALS
from .prefilter import met

#: What any text with a detection has, but for keys and seed phrases.
GATE = r"(?:sk-|ghp_|gho_|ghs_|ghr_|ghu_|akia|xox|aiza|\.env|header|cookie|prompt|mnemonic|seed|credential|password|passphrase|secret|key|token|wallet|context)"
_KEY = r"(?<![A-Fa-f0-9])[A-Fa-f0-9]{64}|0x[A-Fa-f0-9]{64}"
_FOUND = T.ArrayType(T.StructType([T.StructField("match", T.StringType()), T.StructField("confidence", T.DoubleType())]))


@lru_cache(maxsize=None)
def _re(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def _has(pattern: str, text: str) -> bool:
    return _re(pattern).search(text) is not None


class Marks:
    """The matches of a pattern in a part of a text, in order."""

    def __init__(self, pattern: str, text: str, lo: int, hi: int):
        self.spans = [m.span() for m in _re(pattern).finditer(text, lo, hi)]
        self._starts = np.array([a for a, _ in self.spans], np.int64)

    def __len__(self) -> int:
        return len(self.spans)

    def keep(self, test) -> "Marks":
        out = object.__new__(Marks)
        out.spans = [s for s in self.spans if test(s)]
        out._starts = np.array([a for a, _ in out.spans], np.int64)
        return out

    def at_or_after(self, place: int) -> tuple[int, int] | None:
        i = int(np.searchsorted(self._starts, place))
        return self.spans[i] if i < len(self.spans) else None

    def up_to(self, place: int) -> tuple[int, int] | None:
        i = int(np.searchsorted(self._starts, place, "right"))
        return self.spans[i - 1] if i else None

    def any_between(self, lo: int, hi: int) -> bool:
        found = self.at_or_after(lo)
        return found is not None and found[0] < hi


def statements(text: str) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, whether a blank line stands before) of the statements that aren't blank."""
    begin, broken = 0, False
    for m in [*_re(A.STATEMENT_END).finditer(text), None]:
        end = m.start() if m else len(text)
        if text[begin:end].strip():
            yield begin, end, broken
            broken = False
        if m:
            broken |= len(re.findall(r"\r\n|[\r\n]", m[0])) > 1
            begin = m.end()


def waits_for_masking(text: str) -> bool:
    return any(not _has(A.CONDITION_NEGATED_BEFORE, text[max(0, m.start() - 64) : m.start()]) for m in _re(A.CONDITION).finditer(text))


class _Statement:
    def __init__(self, text: str, lo: int, hi: int):
        self.text, self.lo, self.hi = text, lo, hi
        self.secrets = self._marks(A.SENSITIVE_OBJECT)
        self.bare = self.secrets.keep(lambda s: not self._excused(s))

    def _marks(self, pattern: str) -> Marks:
        return Marks(pattern, self.text, self.lo, self.hi)

    def _before(self, place: int, n: int) -> str:
        return self.text[max(self.lo, place - n) : place]

    def _after(self, place: int, n: int) -> str:
        return self.text[place : min(self.hi, place + n)]

    def _excused(self, s: tuple[int, int]) -> bool:
        before, after = self._before(s[0], 64), self._after(s[1], 96)
        absent = _has(A.ABSENT_BEFORE, before) and not _has(A.NOT_TRANSFORMING_BEFORE, before)
        masked = _has(A.TRANSFORMED_BEFORE, before) and not _has(A.NOT_TRANSFORMED_BEFORE, before)
        return absent or masked or _has(A.TRANSFORMED_AFTER, after) or _has(A.SECRET_DOCUMENT_SUFFIX, after)

    def carried(self) -> tuple[int, int] | None:
        """The last bare secret that is read from somewhere, by a verb that isn't negated, and not in a document."""
        sources, papers, out = self._marks(A.SOURCE_VERB), self._marks(A.ABOUT_DOCUMENTS), None
        for s in self.bare.spans:
            verb = sources.up_to(s[0])
            if verb and not _has(A.OUTBOUND_NEGATION, self._before(verb[0], 48)) and not papers.any_between(verb[1], s[0]):
                out = s
        return out

    def _stays(self, s: tuple[int, int]) -> bool:
        """Whether a secret is kept where it is."""
        m = _re(A.LOCAL_AFTER).search(self._after(s[1], 96))
        return m is not None and (m[0].lstrip().lower().startswith(A.STAYS) or _has(A.RETAINED_BEFORE, self._before(s[0], 64)))

    def _masked(self, s: tuple[int, int], verb: int, masks: Marks, local: Marks) -> bool:
        """Whether the secret itself is masked before the verb, and not only in what is kept here."""
        m = masks.up_to(s[0])
        if m is None or s[0] - m[1] > 64 or not _re(A.TRANSFORM_TARGET).fullmatch(self.text, m[1], s[0]):
            return False
        return not _has(A.TRANSFORM_NEGATED_BEFORE, self._before(m[0], 40)) and not local.any_between(s[1], verb)

    def flow(self, earlier: tuple[int, int] | None) -> str | None:
        """The excerpt around the first verb that hands a secret to a destination. ``earlier``: a secret carried from before."""
        sinks = self._marks(A.OUTBOUND_SINK).keep(lambda s: not _has(A.SINK_DOCUMENT_AFTER, self._after(s[1], 48)))
        if not len(sinks):
            return None
        masks, local, clauses = self._marks(A.TRANSFORMED), self._marks(A.LOCAL_SCOPE), self._marks(A.OTHER_CLAUSE)
        for verb in self._marks(A.OUTBOUND_FLOW).spans:
            noun = self.text[slice(*verb)].casefold() == "post" and _has(A.POST_NOUN, self._after(verb[1], 16))
            if noun or _has(A.OUTBOUND_NEGATION, self._before(verb[0], 64)) or waits_for_masking(self.text[verb[0] : min(self.hi, verb[1] + 256)]):
                continue
            pronoun = _re(A.PRONOUN).search(self.text, verb[1], min(self.hi, verb[1] + A.PRONOUN_REACH))
            if pronoun:
                sink, near = sinks.at_or_after(pronoun.end()), self.secrets.up_to(verb[0])
                secret = near or earlier
                if sink is None or secret is None or (near and (near not in self.bare.spans or self._masked(near, verb[0], masks, local))):
                    continue
            else:
                secret = self.bare.at_or_after(verb[1])
                if secret is None or self._stays(secret) or clauses.any_between(verb[1], secret[0]):
                    continue
                sink = sinks.at_or_after(verb[1]) or sinks.spans[-1]
            return self._excerpt(verb, sink, secret)
        return None

    def _excerpt(self, verb, sink, secret) -> str:
        for parts in ((verb, sink, secret), (verb, sink)):
            a, b = max(self.lo, min(p[0] for p in parts) - 64), min(self.hi, max(p[1] for p in parts) + 96)
            if b - a <= A.EXCERPT:
                break
        return self.text[a:b].strip()


def flow_of(text: str) -> str | None:
    """The first flow of a secret to a destination outside."""
    earlier = None
    for lo, hi, broken in statements(text):
        earlier = None if broken else earlier
        s = _Statement(text, lo, hi)
        if len(s.secrets) or earlier:
            earlier = s.carried() or earlier
            found = s.flow(earlier)
            if found is not None:
                return found
    return None


def instruction_of(text: str) -> str | None:
    """The first flow, or else the first request for a secret that isn't negated, quoted, about a document or safe."""
    found = flow_of(text)
    for pattern in A.EXFIL_INSTRUCTIONS if found is None else ():
        for m in _re(pattern).finditer(text):
            before, after = text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 48]
            excused = _has(A.NEGATED_INSTRUCTION, before) or _has(A.SECRET_DOCUMENT_SUFFIX, after) or _has(A.QUOTED_REQUEST_SUFFIX, after)
            if not excused and not waits_for_masking(text[m.start() : m.end() + 256]):
                return m[0]
    return found


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Spans in the shape of credentials, by pattern; one that overlaps an earlier one doesn't count."""
    out: list[tuple[int, int]] = []
    for p in CREDENTIALS:
        out += [m.span() for m in _re(p).finditer(text) if not any(m.start() < b and a < m.end() for a, b in out)]
    return out


def seeds_of(text: str, listed: frozenset[str], size: int = 12) -> list[str]:
    """Runs of ``size`` listed words, one after another, without overlap."""
    out, run = [], []
    for m in re.finditer(r"\b[a-z]{3,8}\b", text.lower()) if listed else ():
        run = [*run, m] if m[0] in listed else []
        if len(run) == size:
            out.append(text[run[0].start() : run[-1].end()])
            run = []
    return out


def detections_of(text: str, listed: frozenset[str] = frozenset()) -> list[tuple[str, float]]:
    asked, keyed = instruction_of(text), _has(A.KEY_CONTEXT, text)
    out = []
    for m in _re(A.PRIVATE_KEY).finditer(text):
        if (keyed or asked is not None) and not _has(A.PUBLIC_HASH_CONTEXT, text[max(0, m.start() - 40) : m.end() + 40]):
            out.append((m[0], 0.95))
    out += [(text[a:b], 0.90) for a, b in tokens_of(text) if asked is not None or _has(A.EXFIL_VERB, text[max(0, a - 80) : b + 80])]
    out += [(s, 0.95) for s in seeds_of(text, listed)]
    return [*out, (asked, 0.80)] if asked else out


def _telling(text: str | None) -> bool:
    return bool(text and text.strip()) and (bool(met(text, (GATE,))) or _has(_KEY, text))


def flow(text: str | Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: flow_of(t) if _telling(t) else None), T.StringType())(F.col(text) if isinstance(text, str) else text)


def instruction(text: str | Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: instruction_of(t) if _telling(t) else None), T.StringType())(F.col(text) if isinstance(text, str) else text)


def exfiltration(text: str | Column, seed_words: Iterable[str] = ()) -> Column:
    """Array of (match, confidence): private keys, credentials, seed phrases of the words given, and requests for secrets."""
    listed = frozenset(seed_words)
    t = F.col(text) if isinstance(text, str) else text

    @F.pandas_udf(_FOUND)
    def detect(s: pd.Series) -> pd.Series:
        told = [x if _telling(x) else None for x in s]
        seeds = [[(w, 0.95) for w in seeds_of(x, listed)] if listed and x and not y else [] for x, y in zip(s, told)]
        return pd.Series([[{"match": m, "confidence": c} for m, c in (detections_of(y, listed) if y else more)] for y, more in zip(told, seeds)], dtype=object)

    return detect(t)
