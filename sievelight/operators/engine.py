"""The whole screen of a text: scanner, analyzers and, if given, a scorer, weighed into one verdict.

The scanner's layers are patterns, statistics, and likeness to known phrases (asked where the statistics are undecided or
no pattern matched). The registry's analyzers give a weighted score. Some findings block by themselves: a redirected
payment or a secret on its way out that is nearly certain, a tool call that is executed, a link that runs a script. What is
sanitized has every match replaced, and is screened again: what isn't clean then is blocked.

Rows are screened in two passes over written tables, so a text is sanitized before it is screened again, and rows that
are allowed or blocked are read once. Null texts are blocked, blank ones allowed.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import rules as R
from sievelight.functions.text import let
from sievelight.sources.scratch import saved

from . import screen as sc
from .analyzers import Registry, addresses, default_registry, exfiltration, hijack, suspicious
from .glance import glance

#: Classes of the analyzers' findings, and the confidence from which on they block.
CLASSES = {"drain_address": "DRAIN_ADDRESS", "tool_hijack": "TOOL_HIJACK", "exfiltration": "SECRET_EXFIL", "malicious_link": "MALICIOUS_LINK"}
HARD = {"drain_address": 0.9, "exfiltration": 0.9, "tool_hijack": 0.8}
RUNS = "^(?:file|javascript|vbscript):"
SECRET = "[REDACTED SECRET]"


def scanned(df: DataFrame, text: str = "text", thorough: bool = True, seed_words: frozenset[str] = frozenset()) -> DataFrame:
    """Adds glance (see there), detections and risk of the scanner's layers."""
    none = F.array().cast(f"array<{sc.DETECTION}>")
    one = lambda category, match, confidence, layer: F.array(F.struct(F.lit(category).alias("category"), match.alias("match"), confidence.alias("confidence"), F.lit(layer).alias("layer"))).cast(f"array<{sc.DETECTION}>")
    df = df.withColumn("glance", glance(text, seed_words))
    g, score = F.col("glance"), F.col("glance.score")
    found = sc.matches_of(F.col(text), g["can"]).cast(f"array<{sc.DETECTION}>")

    def of(p: Column) -> Column:
        asked = F.round(score, 4).between(*R.AMBIGUOUS) | (F.size(p) == 0)
        known = F.element_at(F.array(*[F.lit(x) for x in R.KNOWN_INJECTIONS]), g["phrase"] + 1)
        stat = F.when(score > R.HEURISTIC, one("statistical_analysis", F.lit(""), F.least(F.lit(1.0), F.round(score, 4)), 2)).otherwise(none)
        like = F.when(F.lit(thorough) & asked & (g["similarity"] >= R.SIMILARITY), one("corpus_match", known, g["similarity"], 3)).otherwise(none)
        return F.concat(p, stat, like)

    some = F.col(text).isNotNull() & (F.trim(text) != "")
    return df.withColumn("detections", F.when(some, let(found, of)).otherwise(none)).withColumn("risk", sc.risk_level("detections"))


def judged(df: DataFrame, text: str = "text", registry: Registry | None = None, thorough: bool = True, scorer=None, failed: dict[str, Column] | None = None) -> DataFrame:
    """One pass: adds detections (scanner's), found (analyzers': class, match, confidence), score, threat_classes, sanitized, verdict, risk_level."""
    registry = registry or default_registry()
    secrets = registry.detector("exfiltration")
    own = isinstance(secrets, partial) and secrets.func is exfiltration  # the library's, which the glance has run
    given = {"exfiltration": F.col("glance.secrets")} if own else {}
    given |= {"tool_hijack": F.col("glance.calls")} if registry.detector("tool_hijack") is hijack else {}
    gates = {n: F.col(f"glance.{n}") for n, f in (("drain_address", addresses), ("malicious_link", suspicious)) if registry.detector(n) is f}
    df = scanned(df, text, thorough, secrets.keywords["seed_words"] if own else frozenset())
    df = registry.run(df, text, failed, gates, given).drop("glance")
    named = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    each = F.transform("analyzers", lambda a: F.transform(a["detections"], lambda d: F.struct(a["name"].alias("analyzer"), F.coalesce(F.element_at(named, a["name"]), F.upper(a["name"])).alias("class"), d["match"].alias("match"), d["confidence"].alias("confidence"))))
    df = df.withColumn("found", F.flatten(each))
    hard = F.exists("found", lambda x: F.coalesce(_hard(x), F.lit(False)))
    broken = F.exists("analyzers", lambda a: a["error"].isNotNull())
    matches = F.concat(F.transform("detections", lambda d: d["match"]), F.transform(F.filter("found", lambda x: x["class"] != "TOOL_HIJACK"), lambda x: x["match"]))
    clean = sc.redacted(sc.sanitized(text, "detections"), matches)
    every = F.concat(sc.classes("detections"), F.transform("found", lambda x: x["class"]))
    df = df.withColumns({"threat_classes": F.array_distinct(F.array_compact(every)), "_all": F.concat(F.transform("detections", lambda d: d["category"]), F.transform("found", lambda x: x["class"]))})
    if scorer is not None:
        df = scorer.score(df, text)
    out = sc.decide(df, text, "_all", "risk", "score", broken, hard, clean, F.col("enforced") if scorer is not None else None).drop("_all")
    shown = F.transform("found", lambda x: F.struct(x["class"].alias("class"), F.when(x["class"] == "SECRET_EXFIL", SECRET).otherwise(x["match"]).alias("match"), x["confidence"].alias("confidence")))
    out = out.withColumns({"found": shown, "sanitized": F.when(F.col("verdict") == "ALLOW", F.col(text)).otherwise(F.col("sanitized"))})
    return out.withColumn("threat_classes", F.when(F.col("verdict") == "ALLOW", F.array().cast("array<string>")).otherwise(F.col("threat_classes")))


def _hard(x: Column) -> Column:
    out = (x["class"] == "MALICIOUS_LINK") & F.lower(F.translate(x["match"], "\t\r\n", "")).rlike(RUNS)
    for name, least in HARD.items():
        out = out | ((x["class"] == CLASSES[name]) & (x["confidence"] >= least))
    return out


def engine(df: DataFrame, text: str = "text", registry: Registry | None = None, thorough: bool = True, scorer=None) -> DataFrame:
    """The rows with their columns of ``judged``, those that were to be sanitized after a second screen of what is left."""
    first = judged(df, text, registry, thorough, scorer).withColumn("_row", F.monotonically_increasing_id())
    # a text that is allowed is written once
    first = saved(first.withColumn("sanitized", F.when(F.col("verdict") != "ALLOW", F.col("sanitized"))))
    open_ = first.where("verdict = 'SANITIZE'").select("_row", F.col("sanitized").alias("text"))
    # written as well, as a filter on what it gives would be computed from the text once more
    again = saved(judged(open_, "text", registry, thorough, scorer).select("_row", "verdict", F.col("threat_classes").alias("_more"))).where("verdict <> 'ALLOW'").drop("verdict")
    out = first.join(again, "_row", "left").withColumn("_bad", F.col("_more").isNotNull())
    level = F.when(F.col("_bad") & ~F.col("risk_level").isin("HIGH", "CRITICAL"), "HIGH").otherwise(F.col("risk_level"))
    whole = F.when(F.col("verdict") == "ALLOW", F.col(text)).otherwise(F.col("sanitized"))
    return out.withColumns({"sanitized": whole, "verdict": F.when(F.col("_bad"), "BLOCK").otherwise(F.col("verdict")), "risk_level": level}).drop("_row", "_more", "_bad")
