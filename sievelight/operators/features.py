"""Features of a text: named scalars, with built-in expressions, and hashed counts of its runs of bytes and words.

The vector has 27 scalars (subscores and score of the statistical layer, hits of each category of patterns, similarity to
known phrases, shares and shapes of characters) and two blocks of BUCKETS numbers, each scaled to length 1: runs of 3 to 5
bytes and of 1 and 2 words of the folded text, and runs of bytes of its letters and digits alone.

A null text has a null vector; an empty one has zeros.
"""

from __future__ import annotations

import ctypes
import re
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions import rules as R
from sievelight.functions.rules import INVISIBLE_CHARACTERS
from sievelight.functions.stats import logistic
from sievelight.functions.text import HOMOGLYPHS, fold_unicode, let

from . import screen as sc

# Patterns of what is counted.
ADDRESS, URL, LONG_RUN = r"0x[0-9a-fA-F]{40}", r"(?i)\b(?:https?|ftp|file|javascript|data|vbscript)\s*:", r"[0-9A-Za-z+/=_-]{24,}"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
NAMES = ("invisible", "homoglyph", "fold_changed", "non_ascii", "digit", "punctuation", "uppercase", "whitespace", "single_char_words", "mean_word_length", "log_length", "log_words", "addresses", "urls", "long_runs")


#: Digits that aren't decimal ones (superscripts, circled ones).
_ODD_DIGITS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit() and unicodedata.category(c) != "Nd")


def _without(t: Column, characters: str) -> Column:
    return (F.length(t) - F.length(F.translate(t, characters, ""))).cast("double")


def dense_ratios(text: str | Column, folded: Column | None = None) -> Column:
    """Struct of 15 scalars over a whole text; all 0 for an empty one."""
    t = F.col(text) if isinstance(text, str) else text
    count = lambda x, p: F.regexp_count(x, F.lit("(?U)" + p)).cast("double")
    digits = lambda x: (F.length(x) - F.length(F.translate(F.regexp_replace(x, r"\p{Nd}+", ""), _ODD_DIGITS, ""))).cast("double")
    surface = lambda f: F.trim(F.regexp_replace(F.lower(f), r"(?U)[\s\x1c-\x1f]+", " "))

    def of(v: Column) -> Column:
        n, x = F.length(v["t"]).cast("double"), v["t"]
        w, words = v["w"], F.size(v["w"]).cast("double")
        letters = F.length(F.array_join(w, "")).cast("double")
        share = lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0))
        values = (
            share(_without(x, INVISIBLE_CHARACTERS)), share(_without(x, HOMOGLYPHS[0])), (v["f"] != x).cast("double"), share(F.length(F.regexp_replace(x, r"[\x00-\x7F]+", "")).cast("double")),
            share(digits(x)), share(count(x, PUNCTUATION)), share(count(x, r"\p{IsUppercase}")), share(count(x, r"[\s\x1c-\x1f]")),
            F.coalesce(F.try_divide(F.size(F.filter(w, lambda y: F.length(y) == 1)).cast("double"), words), F.lit(0.0)),
            F.least(F.lit(20.0), F.coalesce(F.try_divide(letters, words), F.lit(0.0))),
            F.log1p(n), F.log1p(words), F.log1p(count(x, ADDRESS)), F.log1p(count(x, URL)), F.log1p(count(x, LONG_RUN)),
        )
        return F.struct(*[c.alias(name) for c, name in zip(values, NAMES)])

    f = fold_unicode(t) if folded is None else folded
    w = F.regexp_extract_all(surface(f), F.lit("[0-9a-z]+"), F.lit(0))
    return let(F.struct(t.alias("t"), f.alias("f"), w.alias("w")), of)


def learned_score(features: Column, weights: dict[str, float], bias: float, least: float = 0.97) -> Column:
    """The logistic score of weighted features; null below what is published."""
    z = F.lit(bias)
    for name, w in weights.items():
        z = z + features[name] * F.lit(float(w))
    s = logistic(z)
    return F.when(s >= least, s)


# --- hashed counts ---

BUCKETS, SIZES, WORDS = 1024, (3, 4, 5), (1, 2)
#: Vectors that a worker hands on at once, 16 KB each: those of a whole batch of texts are hundreds of MB.
CHUNK = 64
SUBSCORES = tuple(R.HEURISTIC_WEIGHTS)
CATEGORIES = tuple(sorted(R.INJECTION_PATTERNS))
DENSE = (*(f"heuristic.{n}" for n in SUBSCORES), "heuristic.combined", *(f"regex.{c}" for c in CATEGORIES), "regex.total", "tfidf.max_cosine", *NAMES)
DIMENSION = len(DENSE) + 2 * BUCKETS
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def _bucket(crc: np.ndarray) -> np.ndarray:
    return ((crc.astype(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(8)) % np.uint64(BUCKETS)


def _base(seed: str, view: str) -> int:
    return zlib.crc32(view.encode() + b"\0", zlib.crc32(seed.encode()))


def _runs(raw: bytes, base: int) -> np.ndarray:
    """Counts by bucket of the CRC-32 of all runs of SIZES bytes, all runs of a size at once."""
    b, out = np.frombuffer(raw, np.uint8), np.zeros(BUCKETS)
    c = np.full(len(b), np.uint32(base) ^ _ONES)
    for k in range(max(SIZES)):
        n = len(b) - k
        if n <= 0:
            break
        c = _CRC[(c[:n] ^ b[k:]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
        if k + 1 in SIZES:
            out += np.bincount(_bucket(c ^ _ONES).astype(np.int64), minlength=BUCKETS)
    return out


def _word_runs(words: list[str], base: int) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for size in WORDS:
        runs = Counter(words if size == 1 else [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)])
        if runs:
            crc = np.array([zlib.crc32(w.encode(), base) for w in runs], np.uint32)
            out += np.bincount(_bucket(crc).astype(np.int64), np.fromiter(runs.values(), float, len(runs)), BUCKETS)
    return out


def hashed_blocks(folded: str, seed: str = "features/1") -> np.ndarray:
    """The two blocks of a folded text, each scaled to length 1."""
    surface = re.sub(r"\s+", " ", folded.lower()).strip()
    bare = re.sub("[^0-9a-z]+", "", surface)
    a = _runs(surface.encode("utf-8", "replace"), _base(seed, "surface")) + _word_runs(re.findall("[0-9a-z]+", surface), _base(seed, "surface.word"))
    b = _runs(bare.encode(), _base(seed, "despaced"))
    return np.concatenate([x / n if (n := np.sqrt((x * x).sum())) else x for x in (a, b)])


def give_back() -> None:
    """Hands memory that is free back to the system: a pool of workers, of which each task takes the next, else holds as
    much in each of them as the largest task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def hashed(folded: str | Column, seed: str = "features/1") -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            for i in range(0, len(s), CHUNK):
                yield pd.Series([None if t is None else hashed_blocks(t, seed) for t in s.iloc[i : i + CHUNK]], dtype=object)
        give_back()

    return blocks(F.col(folded) if isinstance(folded, str) else folded)


def scalars(text: str | Column, own: Column, folded: Column) -> Column:
    """The 27 scalars of a text; shares and shapes are those of ``own``, a part of it or all."""
    t = F.col(text) if isinstance(text, str) else text

    def of(v: Column) -> Column:
        count = lambda c: F.log1p(F.size(F.filter(v["d"], lambda x: x["category"] == c)).cast("double"))
        return F.array(*[v["s"][n] for n in SUBSCORES], F.round(v["s"]["score"], 4), *[count(c) for c in CATEGORIES], F.log1p(F.size(v["d"]).cast("double")), v["p"], *[v["r"][n] for n in NAMES])

    parts = F.struct(sc.heuristic_parts(t).alias("s"), sc.pattern_detections(t).alias("d"), sc.phrase_similarity(t)["similarity"].alias("p"), dense_ratios(own, folded).alias("r"))
    return let(parts, of)


def vectors(df: DataFrame, text: str = "text", name: str = "features", characters: int | None = None, seed: str = "features/1") -> DataFrame:
    """Adds the vector, DIMENSION doubles. ``characters``: of shares, shapes and hashed counts only the first so many are
    read, as a scorer that was fitted in this way needs it; all where it is None."""
    cut = lambda c: c if characters is None else F.left(c, F.lit(characters))
    own = cut(F.col(text))
    df = df.withColumn("_folded", cut(fold_unicode(own)))
    vector = F.concat(scalars(text, own, F.col("_folded")), hashed("_folded", seed))
    return df.withColumn(name, F.when(F.col(text).isNotNull(), vector)).drop("_folded")
