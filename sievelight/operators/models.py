"""A hook for models that judge texts: run only for rows without detections, loaded once a task, never trusted blindly.

A model is any object whose ``load()`` gives a function of a list of texts: a classifier's gives for each a dict of
``flagged``, ``confidence``, ``reason`` and ``category``; an embedding's gives for each (similarity, reference). The object
is sent to the tasks; what ``load`` opens lives there. What a model returns is checked: other fields, types or ranges, or
an exception, mean that it is unavailable for the row, which is then not flagged but marked ``failed``. A caller that
wants such rows blocked passes the mark to ``decide``.

Rows with detections, and null or blank texts, aren't sent to the model; they aren't ``consulted``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds and names of categories.
CONFIDENCE, SIMILARITY = 0.8, 0.82
CATEGORIES = {"PROMPT_INJECTION": "ai_prompt_injection", "DRAIN_ADDRESS": "ai_drain_address", "SECRET_EXFIL": "ai_secret_exfil", "TOOL_HIJACK": "ai_tool_hijack"}
#: Texts that a model gets at once.
BATCH = 64
_RESULT = T.StructType([T.StructField("consulted", T.BooleanType()), T.StructField("failed", T.BooleanType()), T.StructField("flagged", T.BooleanType()), T.StructField("confidence", T.DoubleType()), T.StructField("reason", T.StringType()), T.StructField("category", T.StringType())])


def _number(x: object, low: float) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or not low <= x <= 1:
        raise ValueError("not a number in range")
    return float(x)


def classified(got: dict) -> tuple[bool, float, str, str | None]:
    """A classifier's answer, checked; a ValueError where it isn't one."""
    if not isinstance(got, dict) or set(got) != {"flagged", "confidence", "reason", "category"}:
        raise ValueError("other fields")
    confidence = _number(got["confidence"], 0)
    if not isinstance(got["flagged"], bool) or not isinstance(got["reason"], str):
        raise ValueError("other types")
    if (got["category"] in CATEGORIES) != got["flagged"] or (not got["flagged"] and got["category"] is not None):
        raise ValueError("no category of a flagged text, or one of a clean text")
    return got["flagged"] and confidence >= CONFIDENCE, confidence, got["reason"][:200], CATEGORIES.get(got["category"])


def matched(got: tuple) -> tuple[bool, float, str, str | None]:
    """An embedding's answer, checked."""
    similarity, reference = got
    similarity = _number(similarity, -1)
    return similarity >= SIMILARITY, max(0.0, similarity), str(reference)[:200], "embedding_match"


def judged(text: str | Column, wanted: Column, model, check=classified) -> Column:
    """Struct (consulted, failed, flagged, confidence, reason, category) of a text; the model sees it only where ``wanted``."""

    def answers(ask, texts: list[str]) -> list:
        try:
            got = list(ask(texts))
            if len(got) == len(texts):
                return got
        except Exception:  # one by one, so that a text that breaks the model doesn't take others with it
            pass
        out = []
        for t in texts:
            try:
                out.append(list(ask([t]))[0])
            except Exception:
                out.append(None)
        return out

    def one(got) -> tuple:
        try:
            flagged, confidence, reason, category = check(got)
            return True, False, flagged, confidence, reason, category if flagged else None
        except (ValueError, TypeError, KeyError):
            return True, True, False, 0.0, "unavailable", None

    @F.pandas_udf(_RESULT)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ask = None
        for texts, wanted in batches:
            rows = [(False, False, False, None, None, None)] * len(texts)
            at = [i for i, (t, w) in enumerate(zip(texts, wanted)) if w and t is not None and t.strip()]
            if at and ask is None:
                try:
                    ask = model.load()
                except Exception:
                    ask = _unavailable
            for k in range(0, len(at), BATCH):
                part = at[k : k + BATCH]
                for i, got in zip(part, answers(ask, [texts.iloc[i] for i in part])):
                    rows[i] = one(got)
            out = pd.DataFrame(rows, columns=[f.name for f in _RESULT])
            yield out.astype({"consulted": bool, "failed": bool, "flagged": bool, "confidence": "float64"})

    return judge(F.col(text) if isinstance(text, str) else text, wanted)


def _unavailable(texts: list[str]) -> list:
    raise RuntimeError("the model couldn't be loaded")


def with_models(df: DataFrame, text: str = "text", detections: str = "detections", embedding=None, classifier=None) -> DataFrame:
    """Adds the models' detections to a screened frame, and ``consulted`` and ``failed`` (whether one was asked, or wasn't available).

    The embedding is layer 4 and asked first; the classifier is layer 5 and sees only what is without detections still.
    """
    df = df.withColumns({"consulted": F.lit(False), "failed": F.lit(False)})
    for layer, model, check in ((4, embedding, matched), (5, classifier, classified)):
        if model is None:
            continue
        df = df.withColumn("_m", judged(text, F.size(detections) == 0, model, check))
        found = F.array(F.struct(F.col("_m.category").alias("category"), F.lit("").alias("match"), F.col("_m.confidence").alias("confidence"), F.lit(layer).alias("layer")))
        df = df.withColumns({detections: F.when(F.col("_m.flagged"), found.cast(df.schema[detections].dataType)).otherwise(F.col(detections)), "consulted": F.col("consulted") | F.col("_m.consulted"), "failed": F.col("failed") | F.col("_m.failed")}).drop("_m")
    return df
