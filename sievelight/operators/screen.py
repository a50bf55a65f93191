"""The text screen: layered detections of a text and its verdict, as column expressions.

A detection is a struct (category, match, confidence, layer); their order matters: the pattern layer first, by category
and pattern, then the statistical layer, then similarity to known phrases.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions import rules as R
from sievelight.functions.text import let

from .prefilter import possible

DETECTION = "struct<category:string,match:string,confidence:double,layer:int>"
#: Matches kept of a category.
MOST = 100


_FLAT = tuple((c, i, p) for c, ps in R.INJECTION_PATTERNS.items() for i, p in enumerate(ps))
_PATTERNS = tuple(p for _, _, p in _FLAT)


def pattern_detections(text: str | Column) -> Column:
    """All matches of all patterns, distinct within a category. A pattern is run on a text that has a literal it needs."""
    found = let(F.struct(_c(text).alias("t"), possible(text, _PATTERNS).alias("can")), lambda v: matches_of(v["t"], v["can"]))
    return F.coalesce(found, F.array().cast(f"array<{DETECTION}>"))


def matches_of(text: Column, can: Column) -> Column:
    """The detections of the patterns whose numbers are given."""
    parts = []
    for category in R.INJECTION_PATTERNS:
        found = [F.when(F.array_contains(can, n), F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0))).otherwise(F.array().cast("array<string>")) for n, (c, _, p) in enumerate(_FLAT) if c == category]
        parts.append(_tag(F.slice(F.array_distinct(F.flatten(F.array(*found))), 1, MOST), category))
    return F.when(F.size(can) > 0, F.flatten(F.array(*parts))).otherwise(F.array().cast(f"array<{DETECTION}>"))


def _tag(matches: Column, category: str) -> Column:
    return F.transform(matches, lambda m: F.struct(F.lit(category).alias("category"), m.alias("match"), F.lit(R.CATEGORY_CONFIDENCE[category]).alias("confidence"), F.lit(1).alias("layer")))


def fired(text: str | Column) -> Column:
    """Which patterns match, as category#number from 0; null for a null text."""

    def of(v: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.array_contains(v["can"], n) & v["t"].rlike("(?U)" + p), F.lit(f"{c}#{i}")) for n, (c, i, p) in enumerate(_FLAT)]))

    return let(F.struct(_c(text).alias("t"), possible(text, _PATTERNS).alias("can")), of)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


@lru_cache(maxsize=1)
def _category_numbers() -> np.ndarray:
    """The general category of each code point, as a number."""
    names: dict[str, int] = {}
    return np.array([names.setdefault(unicodedata.category(chr(i)), len(names)) for i in range(sys.maxunicode + 1)], np.uint8)


@F.pandas_udf(T.DoubleType())
def _entropy(s: pd.Series) -> pd.Series:
    table, out = _category_numbers(), []
    for t in s:
        if not t:
            out.append(None if t is None else 0.0)
            continue
        points = np.frombuffer(t.encode("utf-8"), np.uint8) if t.isascii() else np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
        n = np.bincount(table[points])
        p = n[n > 0] / len(points)
        out.append(float(-(p * np.log2(p)).sum()) + 0.0)
    return pd.Series(out, dtype="float64")


def entropy(text: str | Column) -> Column:
    """Shannon entropy, in bits, of the general categories of a text's characters: one pass over its code points."""
    return F.coalesce(_entropy(_c(text)), F.lit(0.0))


def invisible_ratio(text: str | Column) -> Column:
    t = _c(text)
    return F.coalesce(F.try_divide((F.length(t) - F.length(strip_invisible(t))).cast("double"), F.length(t)), F.lit(0.0))


def strip_invisible(text: str | Column) -> Column:
    return F.translate(_c(text), R.INVISIBLE_CHARACTERS, "")


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-zA-Z]+"), F.lit(0))


def _among(w: Column, listed: list[str]) -> Column:
    return F.size(F.filter(w, lambda x: x.isin(*listed)))


def instruction_density(text: str | Column) -> Column:
    return let(words(text), _density)


def _density(w: Column) -> Column:
    return F.coalesce(F.try_divide(_among(w, R.IMPERATIVE_VERBS).cast("double"), F.size(w)), F.lit(0.0))


def context_switch(text: str | Column) -> Column:
    """How little the second half of a text shares with the first, more if it gives instructions."""
    return let(words(text), _switch)


def _switch(words: Column) -> Column:
    def halves(w: Column) -> Column:
        mid = F.floor(F.size(w) / 2).cast("int")
        return F.struct(F.array_distinct(F.slice(w, F.lit(1), mid)).alias("a"), F.array_distinct(F.slice(w, mid + 1, F.size(w))).alias("b"), F.size(w).alias("n"))

    def shares(h: Column) -> Column:
        overlap = F.size(F.array_intersect(h["a"], h["b"])).cast("double") / F.size(F.array_union(h["a"], h["b"]))
        return F.struct(h["n"].alias("n"), overlap.alias("o"), (_among(h["b"], R.INSTRUCTION_KEYWORDS).cast("double") / F.size(h["b"])).alias("k"))

    def score(s: Column) -> Column:
        high = F.least(F.lit(1.0), (1 - s["o"]) * 0.6 + s["k"] * 0.4)
        return F.when(s["n"] < 6, 0.0).when((s["o"] < R.OVERLAP) & (s["k"] > 0.1), high).otherwise((1 - s["o"]) * 0.3)

    safe = lambda h: F.when(h["n"] >= 6, shares(h)).otherwise(F.struct(h["n"].alias("n"), F.lit(0.0).alias("o"), F.lit(0.0).alias("k")))
    return let(let(halves(words), safe), score)


def heuristic_parts(text: str | Column) -> Column:
    """Struct of the four subscores and their weighted sum; the words of a text are taken once."""
    cut = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    w = R.HEURISTIC_WEIGHTS
    spoken = let(words(text), lambda x: F.struct(_density(x).alias("density"), _switch(x).alias("switch")))

    def of(v: Column) -> Column:
        s = {"entropy": cut((v["e"] - 2) / (R.ENTROPY - 2)), "invisible_ratio": cut(v["i"] / R.INVISIBLE), "instruction_density": cut(v["w"]["density"] / R.DENSITY), "context_switch": v["w"]["switch"]}
        total = s["entropy"] * w["entropy"] + s["invisible_ratio"] * w["invisible_ratio"] + s["instruction_density"] * w["instruction_density"] + s["context_switch"] * w["context_switch"]
        return F.struct(*[c.alias(n) for n, c in s.items()], total.alias("score"))

    return let(F.struct(entropy(text).alias("e"), invisible_ratio(text).alias("i"), spoken.alias("w")), of)


def heuristic_score(text: str | Column) -> Column:
    """The weighted sum of the four subscores, unrounded."""
    return heuristic_parts(text)["score"]


# --- similarity to known phrases ---


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def phrase_weights() -> tuple[dict[str, float], list[dict[str, float]]]:
    """Inverse document frequencies of the known phrases' tokens, and each phrase's vector scaled to length 1."""
    docs = [Counter(tokens(p)) for p in R.KNOWN_INJECTIONS]
    df = Counter(t for d in docs for t in d)
    idf = {t: math.log((len(docs) + 1) / (n + 1)) + 1 for t, n in df.items()}
    out = []
    for d in docs:
        total = sum(d.values())
        v = {t: n / total * idf[t] for t, n in d.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / size for t, x in v.items()})
    return idf, out


@lru_cache(maxsize=1)
def _phrase_table() -> tuple[dict[str, tuple[float, int]], np.ndarray]:
    """Weight and column of each known token, and the phrases' vectors as rows."""
    idf, vectors = phrase_weights()
    at = {t: i for i, t in enumerate(sorted(idf))}
    rows = np.zeros((len(vectors), len(at)))
    for i, v in enumerate(vectors):
        for t, x in v.items():
            rows[i, at[t]] = x
    return {t: (idf[t], at[t]) for t in at}, rows


@F.pandas_udf(T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("phrase", T.IntegerType()), T.StructField("tokens", T.IntegerType())]))
def _phrase_similarity(s: pd.Series) -> pd.DataFrame:
    known, rows = _phrase_table()
    best, which, size = [], [], []
    for t in s:
        n = Counter(tokens(t)) if t else {}
        total, q = 0.0, np.zeros(rows.shape[1])
        for w, k in n.items():
            idf, at = known.get(w, (1.0, -1))
            total += (k * idf) ** 2
            if at >= 0:
                q[at] = k * idf
        dots = np.round(rows @ q, 12)
        i = int(dots.argmax())
        size.append(len(n))
        best.append(float(dots[i]) / math.sqrt(total) if dots[i] > 0 else 0.0)
        which.append(i if dots[i] > 0 else None)
    return pd.DataFrame({"similarity": best, "phrase": pd.array(which, dtype="Int32"), "tokens": pd.array(size, dtype="Int32")})


def phrase_similarity(text: str | Column) -> Column:
    """Struct (similarity, phrase, tokens): the known phrase with the largest TF-IDF cosine, the first of equal ones, by one
    pass over each text; 0 and null where no token is known. tokens: the number of distinct ones."""
    return _phrase_similarity(_c(text))


def similar_phrases(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, similarity, phrase) of the texts that have tokens."""
    return docs.select(key, phrase_similarity(text).alias("_p")).where("_p.tokens > 0").select(key, "_p.similarity", "_p.phrase")


# --- risk and verdict ---


def risk_level(detections: str | Column) -> Column:
    d = _c(detections)
    top = F.array_max(F.transform(d, lambda x: x["confidence"]))
    layers = F.size(F.array_distinct(F.transform(d, lambda x: x["layer"])))
    out = F.when(F.size(d) == 0, "NONE").when((top >= 0.9) & (layers >= 2), "CRITICAL").when((top >= 0.9) | (layers >= 3), "HIGH")
    return out.when((top >= 0.7) | (layers >= 2), "MEDIUM").otherwise("LOW")


def sanitized(text: str | Column, detections: str | Column) -> Column:
    whole = F.exists(_c(detections), lambda x: x["category"].isin(*R.WHOLE_TEXT_CATEGORIES))
    return F.when(whole, "[REDACTED]").otherwise(strip_invisible(text))


def redacted(text: str | Column, matches: str | Column) -> Column:
    """Each match, in order, replaced literally."""
    return F.aggregate(_c(matches), _c(text), lambda t, m: F.when(m != "", F.replace(t, m, F.lit("[REDACTED]"))).otherwise(t))


def classes(detections: str | Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in R.CATEGORY_CLASS.items() for x in kv])
    return F.array_distinct(F.transform(_c(detections), lambda x: F.element_at(names, x["category"])))


def rank(value: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), value)


def at_rank(n: Column, order: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in order]), n.cast("int"))


def analyzer_policy(score: str | Column) -> tuple[Column, Column]:
    """Verdict and risk of a weighted analyzer score."""
    s = _c(score)
    verdict = risk = None
    for least, v, r in R.SCORE_POLICY:
        verdict = F.when(s >= least, v) if verdict is None else verdict.when(s >= least, v)
        risk = F.when(s >= least, r) if risk is None else risk.when(s >= least, r)
    return verdict, risk


def decide(
    df: DataFrame, text: str = "text", detections: str = "detections", risk: str = "risk", score: str | Column | None = None, failed: Column | None = None, hard: Column | None = None,
    clean: Column | None = None, learned: Column | None = None,
) -> DataFrame:
    """Adds sanitized, verdict and risk_level by the ordered gates: no text, a failed analyzer, an unknown risk, a hard
    block, a score that is no number, then the highest of the policies; detections raise an allow, and what can't be
    sanitized is blocked. ``clean``: the sanitized text, if not by detections; ``learned``: the verdict that a scorer asks
    for, or null."""
    score = F.lit(0.0) if score is None else _c(score)
    failed, hard = (F.lit(False) if x is None else x for x in (failed, hard))
    learned = F.lit(None).cast("string") if learned is None else learned
    v2, r2 = analyzer_policy(score)
    known = F.col(risk).isin(*R.RISKS)
    v1 = F.when(F.col(risk) == "NONE", "ALLOW").when(F.col(risk) == "CRITICAL", "BLOCK").otherwise("SANITIZE")
    v3, r3 = F.when(learned.isin("SANITIZE", "BLOCK"), learned).otherwise("ALLOW"), F.when(learned == "BLOCK", "HIGH").when(learned == "SANITIZE", "MEDIUM").otherwise("NONE")
    top = at_rank(F.greatest(*[rank(v, R.VERDICTS) for v in (v1, v2, v3)]), R.VERDICTS)
    level = F.greatest(*[rank(r, R.RISKS) for r in (F.col(risk), r2, r3)])
    some = F.size(detections) > 0
    raised = F.when(some, F.greatest(level, F.lit(3))).otherwise(level)
    verdict = F.when((top == "ALLOW") & some, "SANITIZE").otherwise(top)
    stuck = (verdict == "SANITIZE") & some & (F.col("sanitized") == F.col(text))
    bad = F.col(text).isNull() | failed | ~known | hard | (F.col(risk) == "CRITICAL") | F.isnan(score) | (score < 0)
    df = df.withColumn("sanitized", sanitized(text, detections) if clean is None else clean)
    out_risk = F.when(bad, "CRITICAL").when(verdict == "BLOCK", at_rank(level, R.RISKS)).when(verdict == "ALLOW", "NONE").otherwise(at_rank(raised, R.RISKS))
    return df.withColumns({"verdict": F.when(bad | stuck, "BLOCK").otherwise(verdict), "risk_level": out_risk})


def screen(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds detections of the pattern and statistical layers, risk, sanitized text, classes, verdict and risk_level."""
    blank = F.trim(text) == ""
    score = heuristic_score(text)
    stat = F.when(score > R.HEURISTIC, F.array(F.struct(F.lit("statistical_analysis").alias("category"), F.lit("").alias("match"), F.least(F.lit(1.0), score).alias("confidence"), F.lit(2).alias("layer")))).otherwise(F.array().cast(f"array<{DETECTION}>"))
    none = F.array().cast(f"array<{DETECTION}>")
    df = df.withColumn("detections", F.when(F.col(text).isNull() | blank, none).otherwise(F.concat(pattern_detections(text).cast(f"array<{DETECTION}>"), stat.cast(f"array<{DETECTION}>"))))
    df = df.withColumn("risk", risk_level("detections")).withColumn("classes", classes("detections"))
    return decide(df, text)
