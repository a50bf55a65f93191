"""Folders of mixed source files as one frame of records, and citations of single records.

A record is a line of a ``.jsonl`` file (blank lines don't count; the first is 1), a row of a ``.parquet`` file (the first
is 0), a whole ``.json`` document, or a whole ``.py`` file. ``pos`` is its place in its file; it takes no sort: lines are
numbered within the splits that tasks read, and what earlier splits of a file hold is added from a table of one row a
split. A citation is a file's name below the folder and ``<kind>:<locator>``: ``jsonl:12/key/0``, ``parquet:57/text``
(place, and a JSON pointer into the record), ``json:/key/3``, or ``py:Class.NAME``, the string that a name is assigned or
``__doc__``. What a citation leads to must be text.

A folder without files gives no rows. A file of another suffix, a line or document that isn't JSON, and a citation that
leads nowhere are errors (the last ones as a status where that is asked for). Null citations resolve to nothing.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "path string, kind string, pos long, value string"
KINDS = {".jsonl": "jsonl", ".json": "json", ".parquet": "parquet", ".py": "py"}
_CITED = re.compile(r"(py|json|jsonl|parquet):(.+)", re.S)
_PLACE = re.compile(r"([0-9]+)(/.*)?", re.S)


def _files(spark: SparkSession, root: str) -> list[str]:
    """The files below a folder; names that begin with a dot or underscore don't count."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, out = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName()[0] not in "._":
            out.append(path.toString())
    return sorted(out)


def _below(root: str) -> Column:
    """The path of a row's file below the folder."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), f"^.*?{re.escape(root.split('://')[-1].rstrip('/'))}/", "")


def lines(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """(path, pos, value): the lines of text files that aren't blank, numbered from 1 in each file."""
    read = spark.read.text(paths).where(F.trim("value") != "")
    read = read.select(_below(root).alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    splits = read.groupBy("path", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)  # a row for each split
    splits = splits.select("path", "split", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return read.join(splits, ["path", "split"]).select("path", (F.col("id") - F.col("first") + F.col("before") + 1).alias("pos"), "value")


def _json(value: str | Column, path: str | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.try_parse_json(v).isNotNull(), v).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), F.col(path) if isinstance(path, str) else path)).cast("string"))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, pos, value) of all records of the files below a folder; values of Parquet rows are JSON."""
    by: dict[str, list[str]] = {}
    for f in _files(spark, root):
        suffix = re.search(r"(\.[^./]*)?$", f)[0]
        if suffix not in KINDS:
            raise ValueError(f"not a source of a known kind: {f}")
        by.setdefault(KINDS[suffix], []).append(f)
    out = spark.createDataFrame([], SCHEMA)
    for kind, paths in by.items():
        if kind == "jsonl":
            rows = lines(spark, paths, root).select("path", "pos", _json("value", "path").alias("value"))
        elif kind == "parquet":
            rows = None
            for p in paths:  # files may have schemas of their own
                one = spark.read.parquet(p)
                one = one.select(_below(root).alias("path"), F.col("_metadata.row_index").alias("pos"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in one.columns])).alias("value"))
                rows = one if rows is None else rows.unionByName(one)
        else:
            rows = spark.read.text(paths, wholetext=True).select(_below(root).alias("path"), F.lit(0).cast("long").alias("pos"), "value")
            rows = rows.withColumn("value", _json("value", "path")) if kind == "json" else rows
        out = out.unionByName(rows.select("path", F.lit(kind).alias("kind"), "pos", "value"))
    return out


def pointed(value: object, pointer: str) -> object:
    """What a JSON pointer leads to; a step that is missing is a KeyError."""
    if pointer and not pointer.startswith("/"):
        raise KeyError(pointer)
    for step in pointer.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict):
            value = value[step]
        elif isinstance(value, list) and step.isdigit() and int(step) < len(value):
            value = value[int(step)]
        else:
            raise KeyError(step)
    return value


def symbol(source: str, dotted: str) -> str:
    """The string that a Python source assigns to a name, in classes and functions that are named before it."""
    scope: ast.AST = ast.parse(source)
    *outer, last = dotted.split(".")
    for name in outer:
        inside = [n for n in scope.body if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == name]
        if not inside:
            raise KeyError(name)
        scope = inside[0]
    if last == "__doc__":
        text = ast.get_docstring(scope, clean=False)
    else:
        named = {t.id: n.value.value for n in reversed(scope.body) if isinstance(n, (ast.Assign, ast.AnnAssign)) and isinstance(n.value, ast.Constant) for t in (n.targets if isinstance(n, ast.Assign) else [n.target]) if isinstance(t, ast.Name)}
        text = named[last]
    if text is None:
        raise KeyError(last)
    return text


@F.pandas_udf(T.StringType())
def _text_at(kind: pd.Series, value: pd.Series, locator: pd.Series) -> pd.Series:
    """The text that a locator leads to in its record; null where it leads to none."""

    def one(kind, value, locator):
        if value is None or locator is None:
            return None
        try:
            got = symbol(value, locator) if kind == "py" else pointed(json.loads(value), locator)
        except (KeyError, ValueError, SyntaxError, RecursionError):
            return None
        return got if isinstance(got, str) else None

    return pd.Series([one(*x) for x in zip(kind, value, locator)], dtype=object)


def resolve(citations: DataFrame, records: DataFrame, strict: bool = True) -> DataFrame:
    """Citations (path, record_id, ...) with text. ``strict``: one that leads to no text is an error; else its text is null."""
    kind, rest = F.regexp_extract("record_id", "(?s)^(py|jsonl?|parquet):(.+)$", 1), F.regexp_extract("record_id", "(?s)^(py|jsonl?|parquet):(.+)$", 2)
    placed = kind.isin("jsonl", "parquet")
    place = F.when(placed & rest.rlike("(?s)^[0-9]{1,18}(/.*)?$"), F.regexp_extract(rest, "^[0-9]+", 0).cast("long")).when(kind.isin("py", "json"), F.lit(0).cast("long"))
    locator = F.when(placed, F.regexp_replace(rest, "^[0-9]+", "")).otherwise(rest)
    bad = (kind == "json") & ~rest.startswith("/")
    c = citations.withColumns({"_kind": kind, "_pos": F.when(~bad, place), "_locator": locator})
    r = records.toDF("_path", "_of", "_at", "_value")
    got = c.join(r, (F.col("path") == F.col("_path")) & (F.col("_kind") == F.col("_of")) & (F.col("_pos") == F.col("_at")), "left")
    got = got.withColumn("text", _text_at("_of", "_value", "_locator"))
    if strict:
        where = F.concat_ws(" ", F.lit("a citation leads to no text:"), "path", "record_id")
        got = got.withColumn("text", F.when(F.col("text").isNotNull() | F.col("record_id").isNull(), F.col("text")).otherwise(F.raise_error(where).cast("string")))
    return got.select(*citations.columns, "text")
