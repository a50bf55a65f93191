"""What the layers of the screen need to know of a text, by one pass over Arrow batches.

The statistics and the likeness to known phrases are those of ``screen``; the patterns that can match, and whether an
analyzer can find anything, are tests that no text with a finding fails. So rules and analyzers, which are slower by far,
are run on few texts; those of secrets and tool calls are run here, as they are functions over batches themselves.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions import rules as R

from . import calls, secrets
from .prefilter import met
from .screen import _PATTERNS, _category_numbers, _phrase_table

#: Analyzers, in the order of their flags.
GATED = ("drain_address", "tool_hijack", "exfiltration", "malicious_link")
_TOLD = (*_PATTERNS, secrets.GATE, calls.GATE)
_WORDS, _TOKENS, _SECRET_RUN, _HEX = re.compile("[a-zA-Z]+"), re.compile("[a-z0-9]+"), re.compile(secrets._KEY), re.compile("0x[0-9a-f]{20}")
_VERBS, _KEYWORDS, _INVISIBLE = frozenset(R.IMPERATIVE_VERBS), frozenset(R.INSTRUCTION_KEYWORDS), re.compile(f"[{R.INVISIBLE_CHARACTERS}]")
_STRUCT = T.StructType(
    [T.StructField("can", T.ArrayType(T.IntegerType()))] + [T.StructField(n, T.DoubleType()) for n in ("entropy", "invisible_ratio", "instruction_density", "context_switch", "score", "similarity")]
    + [T.StructField("phrase", T.IntegerType())] + [T.StructField(n, T.BooleanType()) for n in GATED] + [T.StructField(n, calls._FOUND) for n in ("calls", "secrets")]
)


def entropy(text: str) -> float:
    points = np.frombuffer(text.encode("utf-8"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = np.bincount(_category_numbers()[points])
    p = n[n > 0] / len(points)
    return float(-(p * np.log2(p)).sum()) + 0.0 if len(points) else 0.0


def switch(words: list[str]) -> float:
    if len(words) < 6:
        return 0.0
    a, b = set(words[: len(words) // 2]), set(words[len(words) // 2 :])
    both = len(a & b)
    overlap, key = both / (len(a) + len(b) - both), len(b & _KEYWORDS) / len(b)
    return min(1.0, (1 - overlap) * 0.6 + key * 0.4) if overlap < R.OVERLAP and key > 0.1 else (1 - overlap) * 0.3


def likeness(low: str) -> tuple[float, int | None]:
    known, rows = _phrase_table()
    n = Counter(_TOKENS.findall(low))
    shared = n.keys() & known.keys()
    if not shared:
        return 0.0, None
    q, total = np.zeros(rows.shape[1]), sum(map(mul, n.values(), n.values()))  # tokens that no phrase has weigh 1
    for w in shared:
        idf, at = known[w]
        q[at] = n[w] * idf
        total += q[at] ** 2 - n[w] ** 2
    dots = np.round(rows @ q, 12)
    i = int(dots.argmax())
    return (float(dots[i]) / math.sqrt(total), i) if dots[i] > 0 else (0.0, None)


def look(text: str, seed_words: frozenset[str] = frozenset()) -> tuple:
    cut = lambda x: min(1.0, max(0.0, x))
    low = text.lower()
    words = _WORDS.findall(low)
    can = met(text, _TOLD)
    secret, call = len(_PATTERNS) in can, len(_PATTERNS) + 1 in can
    parts = (
        cut((entropy(text) - 2) / (R.ENTROPY - 2)), cut(len(_INVISIBLE.findall(text)) / len(text) / R.INVISIBLE if text else 0.0), cut(sum(map(_VERBS.__contains__, words)) / len(words) / R.DENSITY if words else 0.0), switch(words),
    )
    score = sum(p * w for p, w in zip(parts, (R.HEURISTIC_WEIGHTS[n] for n in ("entropy", "invisible_ratio", "instruction_density", "context_switch"))))
    longest = max(map(len, low.split()), default=0)
    address = longest > 31 or ("0x" in low and _HEX.search(low) is not None)
    link = ":" in low or "/" in low or "www." in low
    secret = secret or (longest > 63 and _SECRET_RUN.search(text) is not None)
    some = bool(text.strip())
    call_found = calls.detection_of(text) if call and some else None
    secrets_found = secrets.detections_of(text, seed_words) if secret and some else [(x, 0.95) for x in secrets.seeds_of(text, seed_words)]
    listed = lambda found: [{"match": m, "confidence": c} for m, c in found]
    return [i for i in can if i < len(_PATTERNS)], *parts, score, *likeness(low), address, call, secret or bool(secrets_found), link, listed([call_found] if call_found else []), listed(secrets_found)


def glance(text: str | Column, seed_words: frozenset[str] = frozenset()) -> Column:
    """Struct (can, four subscores and their weighted score, similarity, phrase, a flag for each analyzer of GATED, and the
    detections of calls and secrets)."""

    @F.pandas_udf(_STRUCT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        blank = ([], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, False, False, False, False, [], [])
        for s in batches:
            out = pd.DataFrame([blank if t is None else look(t, seed_words) for t in s], columns=[f.name for f in _STRUCT])
            yield out.astype({"phrase": "Int32", **{n: bool for n in GATED}})

    return run(F.col(text) if isinstance(text, str) else text)
