"""Strict scans and canonical sinks of row files, on any file system that Spark reads."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a malformed line or another type fails the scan."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bounded(df: DataFrame, key: str, text: str, rows: int = 10_000, length: int = 4_000) -> DataFrame:
    """The rows, if they are at most so many, with distinct keys and texts of at most so many characters; else an error."""
    got = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("k"), F.max(F.length(text)).alias("m")).first()
    if got.n > rows or got.k != got.n or (got.m or 0) > length:
        raise ValueError(f"{got.n} rows, {got.k} keys, {got.m} characters at most")
    return df


def pointer_path(pointer: str) -> str:
    """A JSON pointer as a variant path: ~1 and ~0 are / and ~, numbers are places."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer begins with /")
    steps = [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]
    return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)


def json_pointer(json: str | Column, pointer: str) -> Column:
    """The value at a pointer as text; null where a step is missing."""
    return F.try_variant_get(F.try_parse_json(F.col(json) if isinstance(json, str) else json), pointer_path(pointer), "string")


def canonical_lines(df: DataFrame) -> DataFrame:
    """(line): each row as JSON with its keys in order."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("line"))


def write_jsonl(df: DataFrame, path: str) -> None:
    canonical_lines(df).write.mode("errorifexists").text(path)


def manifest(rows: DataFrame, sources: DataFrame, licences: tuple[str, ...], text: str = "text") -> DataFrame:
    """Provenance of rows whose source is listed with an accepted licence: case_id, source, licence, sha256 of the text."""
    listed = sources.where(F.col("licence").isin(*licences))
    return rows.join(listed, "source").select("case_id", "source", "licence", F.sha2(text, 256).alias("sha256"))


def exposition(metrics: DataFrame) -> DataFrame:
    """(line) in the text format of metrics from (name, label, value)."""
    return metrics.select(F.format_string('%s{label="%s"} %d', "name", "label", "value").alias("line"))


def first_seen(pages: DataFrame, key: str, page: str, pos: str) -> DataFrame:
    """A paged capture's rows, each key once, by first page and position."""
    return pages.groupBy(key).agg(F.min(F.struct(page, pos)).alias("at")).select(key, f"at.{page}", f"at.{pos}")


def parse_jsonl(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """Rows of JSON lines that are held in a column; blank lines are skipped, a malformed one fails the query with its text."""
    row = F.from_json(line, schema)
    kept = lines.where(F.trim(line) != "").select(F.col(line).alias("line"), row.alias("row"))
    ok = F.try_parse_json("line").isNotNull() & F.col("row").isNotNull()
    return kept.select(F.when(ok, F.col("row")).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.left("line", F.lit(200))))).alias("row")).select("row.*")


# --- versions of several tables ---


class Conflict(Exception):
    """Another version was published since the one that a change is based on."""


def _fs(spark: SparkSession, at):
    return at.getFileSystem(spark._jsc.hadoopConfiguration())


def _log(spark: SparkSession, root: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_versions")
    return at, _fs(spark, at)


def version(spark: SparkSession, root: str) -> int:
    """The number of the current version; 0 before the first."""
    at, fs = _log(spark, root)
    if not fs.exists(at):
        return 0
    return max([0, *[int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()]])


def contents(spark: SparkSession, root: str, number: int | None = None) -> dict[str, list[str]]:
    """The tables of a version (the current one), each with the folders that hold its rows."""
    number = version(spark, root) if number is None else number
    if not number:
        return {}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_versions/{number:020d}")
    fs = _fs(spark, at)
    stream = fs.open(at)
    try:
        return json.loads(bytes(x & 255 for x in stream.readAllBytes()).decode())
    finally:
        stream.close()


def _publish(spark: SparkSession, root: str, number: int, text: str) -> bool:
    """Makes a file of the log appear, whole, unless it is there: false then."""
    jvm = spark._jvm
    at, fs = _log(spark, root)
    fs.mkdirs(at)
    new, made = jvm.org.apache.hadoop.fs.Path(at, f".{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(at, f"{number:020d}")
    if fs.getScheme() == "file":  # a local rename would replace a file; a link doesn't
        folder = at.toUri().getPath()
        with open(f"{folder}/{new.getName()}", "x") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(f"{folder}/{new.getName()}", f"{folder}/{made.getName()}")
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{folder}/{new.getName()}")
    stream = fs.create(new, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(new, made, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))  # never replaces
        return True
    except Exception:
        if not fs.exists(made):
            raise
        return False
    finally:
        fs.delete(new, False)


def commit(spark: SparkSession, root: str, replaced: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None, least: dict[str, int] | None = None, base: int | None = None) -> int:
    """Publishes a version below ``root``: the current one with some tables replaced and rows added to others; returns its number.

    Rows are written to folders of their own and counted as they are read again; a table with fewer than ``least`` rows is
    an error. Only then the version's list of folders appears in a log, whole and by one step, under the next number. Until
    that moment, and after a failure, readers see the version before; they never see none or a part. Where ``base`` is
    given and isn't the current version any more, or another writer takes its next number, the change is a Conflict and
    leaves nothing. Without ``base``, it is put upon whatever is current.
    """
    now = version(spark, root)
    if base is not None and base != now:
        raise Conflict(f"version {now} is current, not {base}")
    folder, kept = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}", {}
    for name, df in {**(replaced or {}), **(added or {})}.items():
        df.write.parquet(f"{folder}/{name}")
        kept[name] = spark.read.parquet(f"{folder}/{name}").count()
    while True:
        before = contents(spark, root, now)
        after = before | {n: [f"{folder}/{n}"] for n in replaced or {}} | {n: [*before.get(n, []), f"{folder}/{n}"] for n in added or {}}
        for name, n in (least or {}).items():
            have = kept.get(name, 0) + (spark.read.parquet(*before[name]).count() if name in before and name not in (replaced or {}) else 0)
            if have < n:
                raise ValueError(f"{name} has {have} rows, of {n} at least")
        if _publish(spark, root, now + 1, json.dumps(after, sort_keys=True)):
            return now + 1
        if base is not None:
            raise Conflict(f"version {now + 1} was published meanwhile")
        now = version(spark, root)


def release(tables: dict[str, DataFrame], root: str, least: dict[str, int] | None = None) -> int:
    """Publishes several tables as one version, in place of those of the same names; see ``commit``."""
    return commit(next(iter(tables.values())).sparkSession, root, replaced=tables, least=least)


def released(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """A table of a version (the current one)."""
    return spark.read.parquet(*contents(spark, root, number)[name])
