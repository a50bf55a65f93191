"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, the same in every run. A letter's place in a trigram is marked by a
permutation (here a rotation), and a trigram is the product of its permuted letters. A text is the sum of its trigrams'
vectors; a language's prototype is the sum of its texts' vectors, each divided by its length. Documents and prototypes
are compared by cosine after the mean of the prototypes, which all languages share, is taken from both.

Texts are read whole: case is folded, and every run of characters that aren't letters counts as one gap. A text that is
null or has no letter is ``und`` with score 0. Very long texts are counted in pieces and keep all trigrams. Ill-formed surrogates count as gaps. The score is the share of the best language in a softmax over the
cosines. If no labelled text has letters, everything is ``und``. Ties go to the first language by code point. Repeated
rows count each time; other columns than id, text and lang are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSION = 512
#: Sharpness of the softmax.
SHARP = 12.0
#: Trigram vectors that a worker holds (32 MB); when they are more, it starts anew.
HELD = 16384
#: Letters taken at once; a longer text is added up piece by piece.
PIECE = 1 << 18
_SLOTS = 1 << 18


def _folded(point: int) -> int:
    """The lower-case letter of a code point; 0 for what isn't a letter."""
    c = chr(point).lower()[0]
    return ord(c) if c.isalpha() else 0


class Space:
    """Vectors of trigrams. Letters' vectors are made from their code points."""

    def __init__(self, dimension: int = DIMENSION, seed: int = 11):
        self._d, self._seed = dimension, seed
        self._fold = np.full(0x110000, -1, np.int32)
        self._clear()

    def _clear(self) -> None:
        self._letter: dict[int, np.ndarray] = {}
        self._row: dict[int, int] = {}
        self.grams = np.zeros((HELD, self._d), np.float32)
        self._slot_code, self._slot_row = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, np.int32)

    @property
    def full(self) -> bool:
        return len(self._row) > HELD // 2

    def renew(self) -> None:
        if self.full:
            self._clear()

    def _vector(self, point: int) -> np.ndarray:
        if point not in self._letter:
            bits = np.random.Generator(np.random.PCG64([self._seed, point])).integers(0, 2, self._d)
            self._letter[point] = bits.astype(np.float32) * 2 - 1
        return self._letter[point]

    def _gram(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self._vector(a), 2) * np.roll(self._vector(b), 1) * self._vector(c)

    def _codes(self, text: str) -> np.ndarray:
        """Trigrams of a piece: letters folded, other runs as one gap, with a gap at either end."""
        raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        low = self._fold[raw]
        if (low < 0).any():
            for p in np.unique(raw[low < 0]).tolist():
                self._fold[p] = _folded(p)
            low = self._fold[raw]
        low = np.concatenate([np.zeros(1, np.int64), low, np.zeros(1, np.int64)])
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
        low = low[keep]
        return (low[:-2] << 42) | (low[1:-1] << 21) | low[2:]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, int]:
        """Rows of ``grams`` and their counts, a vector for trigrams beyond those held (or None), and the number of trigrams."""
        total, more, n = None, None, 0
        for i in range(0, len(text or ""), PIECE):
            codes = self._codes(text[max(i - 1, 0) : i + PIECE])
            n += len(codes)
            slot = ((codes ^ (codes >> 17) * 0x9E3779B1 ^ (codes >> 37) * 0x85EBCA6B) & (_SLOTS - 1)).astype(np.int64)
            known = self._slot_code[slot] == codes
            rows = self._slot_row[slot]
            if not known.all():
                other, k = np.unique(codes[~known], return_counts=True)
                extra = np.zeros(HELD)
                for code, m in zip(other.tolist(), k.tolist()):
                    r = self._row.get(code)
                    if r is None and len(self._row) < HELD:
                        r = self._row[code] = len(self._row)
                        self.grams[r] = self._gram(code)
                    if r is None:
                        more = self._gram(code) * m if more is None else more + self._gram(code) * m
                    else:
                        extra[r] += m
                at = np.array([self._row.get(c, -1) for c in other.tolist()], np.int32)
                s = ((other ^ (other >> 17) * 0x9E3779B1 ^ (other >> 37) * 0x85EBCA6B) & (_SLOTS - 1)).astype(np.int64)
                free = (at >= 0) & (self._slot_code[s] < 0)
                self._slot_code[s[free]], self._slot_row[s[free]] = other[free], at[free]
                wrong = free & (self._slot_code[s] != other)  # two for one free slot: the last one has it
                self._slot_row[s[free & ~wrong]] = at[free & ~wrong]
                c = np.bincount(rows[known], minlength=HELD) + extra
            else:
                c = np.bincount(rows, minlength=HELD)
            total = c if total is None else total + c
        if total is None:
            return np.zeros(0, np.int64), np.zeros(0, np.float32), None, 0
        rows = np.flatnonzero(total)
        return rows, total[rows].astype(np.float32), more, n

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The vector of each text, and its number of trigrams."""
        out, n = np.zeros((len(texts), self._d), np.float32), np.zeros(len(texts))
        for i, t in enumerate(texts):
            self.renew()
            rows, c, more, n[i] = self.counts(t)
            out[i] = c @ self.grams[rows]
            if more is not None:
                out[i] += more
        return out, n


def learn(docs: DataFrame, dimension: int = DIMENSION) -> dict[str, np.ndarray]:
    """Prototypes of documents (text, lang) with a language, over all of them.

    Tasks add up their texts and hand on one row for each language and block of 32 dimensions, which Spark adds up;
    what reaches the driver is one vector a language.
    """

    def bundle(batches):
        space, sums, held = Space(dimension), {}, {}

        def flush():
            for x, w in held.items():
                sums[x] = sums.get(x, 0) + w @ space.grams
            held.clear()

        for b in batches:
            for text, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if space.full:
                    flush()
                    space.renew()
                rows, c, more, n = space.counts(text)
                if n:
                    held.setdefault(x, np.zeros(HELD))[rows] += c / n
                    if more is not None:
                        sums[x] = sums.get(x, 0) + more / n
        flush()
        rows = [(x, d, float(w)) for x, v in sums.items() for d, w in enumerate(v)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.float64()))], ["lang", "d", "v"])

    rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(bundle, "lang string, d int, v double")
    # rounded, as the order in which tasks are added up varies in the last bits
    got = rows.groupBy("lang", "d").agg(F.round(F.sum("v"), 7).alias("v")).toPandas().sort_values(["lang", "d"])
    out = {x: g["v"].to_numpy() for x, g in got.groupby("lang")}
    return {x: v / np.linalg.norm(v) for x, v in sorted(out.items()) if np.any(v)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """Documents (text, ...) with lang_pred and score."""
    names = list(prototypes)
    p = np.stack(list(prototypes.values())) if names else np.zeros((0, DIMENSION))
    mean = p.mean(axis=0) if len(names) > 1 else np.zeros(p.shape[1])
    c = (p - mean).astype(np.float32)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    columns = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]

    def guess(batches):
        space = Space(p.shape[1])
        for b in batches:
            v, n = space.vectors(b.column("text").to_pylist())
            if names:
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                v -= mean.astype(np.float32)
                s = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) @ c.T
                best = s.argmax(axis=1)
                e = np.exp(SHARP * (s - s.max(axis=1, keepdims=True)).astype(np.float64))
                score = np.where(n > 0, 1 / e.sum(axis=1), 0.0)
                lang = [names[i] if k else "und" for i, k in zip(best, n)]
            else:
                lang, score = ["und"] * len(n), np.zeros(len(n))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in columns), pa.array(lang, pa.string()), pa.array(score)], [*(f.name for f in columns), "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    return docs.select(*[f.name for f in columns]).mapInArrow(guess, f"{schema}, lang_pred string, score double")


def held_out(of: int = 3, which: int = 1):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == which


def identify(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, text) and the columns to keep: learned from the rows that aren't held out. Null ids aren't held out."""
    docs = docs.select("doc_id", "text", "lang", *keep).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    prototypes = learn(docs.where("not held_out").select("text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text", *keep), prototypes)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
SQL: dict[str, str] = {}
