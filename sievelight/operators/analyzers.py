"""Analyzers of a text and their registry: each gives detections (match, confidence) as a column; a run weighs them.

An analyzer is a name, a weight and a function from a text column to an array of struct (match, confidence). Users add
their own to a ``Registry``, a pandas UDF over a model included; weights are scaled to sum to 1 in each run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import analyzer_rules as A

from .addresses import FOUND, addresses
from .calls import hijack, markup_action
from .links import suspicious
from .secrets import exfiltration, flow, instruction

__all__ = ["Registry", "addresses", "default_registry", "exfiltration", "flow", "hijack", "instruction", "markup_action", "recommendation", "suspicious"]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


class Registry:
    """Analyzers in the order in which they were added."""

    def __init__(self):
        self._all: dict[str, tuple[float, Callable[[Column], Column]]] = {}

    def register(self, name: str, weight: float, detect: Callable[[Column], Column]) -> Registry:
        if name in self._all:
            raise ValueError(f"{name} is registered")
        self._all[name] = (weight, detect)
        return self

    def unregister(self, name: str) -> None:
        self._all.pop(name, None)

    def names(self) -> list[str]:
        return list(self._all)

    def detector(self, name: str) -> Callable[[Column], Column] | None:
        return self._all.get(name, (0.0, None))[1]

    def total_weight(self) -> float:
        return sum(w for w, _ in self._all.values())

    def run(self, df: DataFrame, text: str = "text", failed: dict[str, Column] | None = None, gates: dict[str, Column] | None = None, given: dict[str, Column] | None = None) -> DataFrame:
        """Adds ``analyzers``, an array of (name, weight, score, error, detections), and ``score``, their weighted sum.

        An analyzer's score is 100 times its highest confidence. Where ``failed`` holds for it, its score is 50 and it has
        an error and no detections. ``gates``: by analyzer, where it can find anything at all; elsewhere it isn't run.
        ``given``: detections of analyzers that have been run before.
        """
        total, rows = self.total_weight(), []
        for name, (weight, detect) in self._all.items():
            bad = (failed or {}).get(name, F.lit(False))
            if name in (given or {}):
                rows.append((name, weight / total if total > 0 else weight, bad, F.when(bad, F.array().cast(FOUND)).otherwise(given[name].cast(FOUND))))
                continue
            found = F.when(bad, F.array().cast(FOUND)).otherwise(F.coalesce(detect(F.when(gates[name], F.col(text)) if name in (gates or {}) else F.col(text)), F.array().cast(FOUND)))
            rows.append((name, weight / total if total > 0 else weight, bad, found))
        df = df.withColumns({f"__{name}": found for name, _, _, found in rows})
        made = []
        for name, weight, bad, _ in rows:
            d = F.col(f"__{name}")
            score = F.when(bad, 50.0).otherwise(F.coalesce(F.array_max(F.transform(d, lambda x: x["confidence"])), F.lit(0.0)) * 100)
            made.append(F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"), score.alias("score"), F.when(bad, "analysis unavailable").alias("error"), d.alias("detections")))
        df = df.withColumn("analyzers", F.array(*made)).drop(*[f"__{r[0]}" for r in rows])
        return df.withColumn("score", F.aggregate("analyzers", F.lit(0.0), lambda a, x: a + x["weight"] * x["score"]))


def default_registry(seed_words: Iterable[str] = ()) -> Registry:
    """The four analyzers. ``seed_words``: the list whose words make a seed phrase, twelve in a row (the standard's 2,048, say,
    read from a file of the user's); without one, seed phrases aren't looked for."""
    listed, r = frozenset(seed_words), Registry()
    for name, detect in (("drain_address", addresses), ("tool_hijack", hijack), ("exfiltration", partial(exfiltration, seed_words=listed)), ("malicious_link", suspicious)):
        r.register(name, A.WEIGHTS[name], detect)
    return r


def recommendation(detections: str | Column, risk: str | Column) -> Column:
    """A sentence for each category that was found, and advice for the level."""
    d, r = _c(detections), _c(risk)
    found = lambda c: F.exists(d, lambda x: x["category"] == c)
    advice = F.lit(None).cast("string")
    for level, s in A.ADVICE.items():
        advice = F.when(r == level, s).otherwise(advice)
    said = F.concat_ws(" ", *[F.when(found(c), s) for c, s in A.CATEGORY_ADVICE.items()], F.coalesce(advice, F.lit(A.REVIEW)))
    return F.when(F.size(d) == 0, A.CLEAN).otherwise(said)


