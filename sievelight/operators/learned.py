"""A linear scorer of texts: its training rows, its fit by folds of groups, and its use.

Training rows are a corpus of attacks and one of harmless texts, rewritten variants of both that still show the source's
words, and evasions of both, so that no way of rewriting tells the labels apart. Of equal rows the first stays, by
generator, source and transform.

The fit is L2-regularised logistic regression with balanced class weights. All folds, strengths and the final fit are
fitted at once: each pass over the vectors gives the losses and gradients of all models by two matrix products a batch,
tasks hand on one sum each, and every model takes its own quasi-Newton step. Groups are dealt to folds by hash, so none is
in two. The strength with the best average precision over all out-of-fold scores is chosen, the first of equal ones.
"""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions.rules import INVISIBLE_CHARACTERS
from sievelight.functions.text import HOMOGLYPHS
from sievelight.sources.scratch import saved

from . import features as ft
from .metrics import average_precision
from .variants import TRANSFORMS

# Strengths of the grid, folds, share of runs of three characters that must be left, look-alikes.
STRENGTHS, FOLDS, SURVIVING = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0), 5, 0.5
LOOK_ALIKES = ("aceiopsxy", "асеіорѕху")
#: Vectors that a task works on at once, and bytes of those that are read at once.
ROWS, GROUP = 256, 4 << 20
#: Doubles of a piece of a sum, and of tasks' sums that the driver adds up itself.
PIECE, DIRECT = 1 << 14, 1 << 20
#: Transforms that put a text into a frame of their own, which is itself an attack; one of them adds camouflage only.
FRAMES = tuple(n for n in TRANSFORMS if n.startswith("semantic:"))
CAMOUFLAGE = ("semantic:benign-preamble",)

EVASIONS = {
    "character-spacing": lambda t: F.regexp_replace(t, r"(\p{L})", "$1 "),
    "punctuation-split": lambda t: F.regexp_replace(t, r"(\p{L})", "$1."),
    "typo-deletion": lambda t: F.regexp_replace(t, r"((?:\P{L}*+\p{L}){6}\P{L}*+)\p{L}", "$1"),  # every seventh letter
    "uppercase": lambda t: F.upper(t),
    "homoglyph": lambda t: F.translate(t, *LOOK_ALIKES),
    "whitespace-expand": lambda t: F.replace(t, F.lit(" "), F.lit(" \t ")),
}


_GONE, _LATIN = dict.fromkeys(map(ord, INVISIBLE_CHARACTERS)), str.maketrans(*HOMOGLYPHS)
#: The number of each byte that is a digit or a letter, 36 for others.
_NUMBER = np.full(256, 36, np.int32)
_NUMBER[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = np.arange(36)


def _runs_of_three(text: str) -> np.ndarray:
    """Which runs of three letters or digits the folded text has, without what stands between: 36 ** 3 flags."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_GONE)).translate(_LATIN)
    c = _NUMBER[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    c = c[c < 36]
    has = np.zeros(36**3, bool)
    has[c[:-2] * 1296 + c[1:-1] * 36 + c[2:]] = True
    return has


def preserving(df: DataFrame, source: str, variant: str, least: float = SURVIVING) -> DataFrame:
    """The rows in whose variant enough of the source's distinct runs of three letters or digits are left; a source without any preserves none."""

    @F.pandas_udf(T.BooleanType())
    def survives(sources: pd.Series, variants: pd.Series) -> pd.Series:
        last = own = None
        out = []
        for s, v in zip(sources, variants):
            if s is None or v is None:
                out.append(0.0 >= least)
                continue
            if s != last:  # a source's variants follow each other
                last, own = s, _runs_of_three(s)
            n = np.count_nonzero(own)
            out.append((np.count_nonzero(own & _runs_of_three(v)) / n if n else 0.0) >= least)
        return pd.Series(out, dtype=bool)

    return df.where(survives(source, variant))


def _fresh(df: DataFrame, name: str) -> str:
    while any(c.lower() == name for c in df.columns):
        name += "_"
    return name


def evasions(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, transform, payload): each text in each evasion that changes it; n is the transform's place."""
    made = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(n).alias("transform"), f(F.col(text)).alias("payload")) for i, (n, f) in enumerate(EVASIONS.items())])
    return df.where(F.col(text).isNotNull()).select(key, text, F.explode(made).alias("x")).where(F.col("x.payload") != F.col(text)).select(key, "x.n", "x.transform", "x.payload")


def rewritings(df: DataFrame, key: str, text: str, names: tuple[str, ...]) -> DataFrame:
    """(key, n, transform, payload): each text in each variant in which its words survive."""
    made = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(n).alias("transform"), TRANSFORMS[n][1](F.col(text)).alias("payload")) for i, n in enumerate(names)])
    rows = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("source"), F.explode(made).alias("x")).select(key, "source", "x.n", "x.transform", "x.payload")
    return preserving(rows, "source", "payload").select(key, "n", "transform", "payload")


def training_rows(attacks: DataFrame, harmless: DataFrame, key: str, text: str = "text", digests: bool = False) -> DataFrame:
    """(payload, label, group, origin, transform), each payload once. ``digests``: with its SHA-256 as h instead of the payload, which no row then carries."""
    plain = lambda d: d.where(F.col(text).isNotNull()).select(key, F.lit(0).alias("n"), F.lit("").alias("transform"), F.col(text).alias("payload"))
    parts = (
        ("corpus-attack", 1, plain(attacks)), ("corpus-benign", 0, plain(harmless)),
        ("shipped-variant", 1, rewritings(attacks, key, text, tuple(n for n in TRANSFORMS if n not in CAMOUFLAGE))), ("benign-variant", 0, rewritings(harmless, key, text, tuple(n for n in TRANSFORMS if n not in FRAMES))),
        ("attack-evasion", 1, evasions(attacks, key, text)), ("benign-evasion", 0, evasions(harmless, key, text)),
    )
    rows = None
    for i, (origin, label, d) in enumerate(parts):
        d = d.select(F.struct(F.lit(i).alias("i"), F.col(key).alias("k"), "n").alias("order"), "payload", F.lit(label).alias("label"), F.col(key).cast("string").alias("group"), F.lit(origin).alias("origin"), "transform")
        rows = d if rows is None else rows.unionByName(d)
    rest = ("label", "group", "origin", "transform")
    rows = rows.select(F.sha2("payload", 256).alias("h"), "order", *rest, *([] if digests else ["payload"]))
    first = rows.groupBy("h").agg(F.min_by(F.struct(*([] if digests else ["payload"]), *rest), "order").alias("x"))
    return first.select(*(["h"] if digests else []), "x.*")


# --- the fit ---


@dataclass
class Fit:
    """Weights of the chosen strength, its out-of-fold scores (key, label, fold, score), and the average precision of each strength."""

    weights: np.ndarray
    bias: float
    strength: float
    precision: dict[float, float]
    out_of_fold: DataFrame


class _Bend:
    """Bounds of the loss's curvature: a quarter of the weighted mean of x x', diagonalised once for all strengths."""

    def __init__(self, gram: np.ndarray):
        e, self._v = np.linalg.eigh(gram)
        self._e = np.maximum(0.25 * e, 0.0)

    def solve(self, q: np.ndarray, ridge: float) -> np.ndarray:
        return self._v @ ((self._v.T @ q) / (self._e + ridge))


class _Step:
    """One model's quasi-Newton search, from the bound of the curvature: asks for loss and gradient at ``at`` until it is done."""

    def __init__(self, bend: _Bend, width: int, ridge: float, tolerance: float):
        self.x = np.zeros(width)
        self.at, self.f, self.g = self.x.copy(), None, None
        self._solve, self._tolerance, self._pairs, self._t, self.done, self._halved = (lambda q: bend.solve(q, ridge)), tolerance, [], 1.0, False, 0

    def told(self, f: float, g: np.ndarray) -> None:
        if self.f is None:
            self.f, self.g = f, g
        elif f <= self.f + 1e-4 * self._t * self.g @ self._d + 1e-14 * abs(self.f):
            s, y = self.at - self.x, g - self.g
            if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
                self._pairs = [*self._pairs[-9:], (s, y, 1 / (s @ y))]
            self.x, self.f, self.g, self._t, self._halved = self.at, f, g, 1.0, 0
        else:
            self._t, self._halved = self._t / 2, self._halved + 1
            self.done = self._halved > 30
            self.at = self.x + self._t * self._d
            return
        if self.g @ self._solve(self.g) <= self._tolerance**2:
            self.done = True
            return
        q, kept = self.g.copy(), []
        for s, y, r in reversed(self._pairs):
            a = r * (s @ q)
            q -= a * y
            kept.append(a)
        q = self._solve(q)
        if self._pairs:
            s, y, r = self._pairs[-1]
            q *= max(1.0, min(1e3, 1 / (r * (y @ self._solve(y)))))
        for (s, y, r), a in zip(self._pairs, reversed(kept)):
            q += (a - r * (y @ q)) * s
        self._d = -q
        self.at = self.x + self._d


def _block(column: pa.Array) -> Iterator[tuple[slice, np.ndarray]]:
    """The vectors of a column of binary rows, ROWS at once, as they lie in its buffer."""
    n = len(column)
    if not n:
        return
    _, at, raw = column.buffers()
    at = np.frombuffer(at, "<i8" if pa.types.is_large_binary(column.type) else "<i4")[column.offset : column.offset + n + 1]
    x = np.frombuffer(raw, "<f8", int(at[-1] - at[0]) // 8, int(at[0])).reshape(n, -1)
    for i in range(0, n, ROWS):
        own = slice(i, min(i + ROWS, n))
        yield own, x[own]


def _pieces(total: np.ndarray) -> pa.RecordBatch:
    """A task's sum in pieces, which are added up apart."""
    raw = [total[i : i + PIECE].tobytes() for i in range(0, len(total), PIECE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(raw)), pa.int64()), pa.array(raw, pa.binary())], ["at", "v"])


def _added(rows: DataFrame, size: int) -> np.ndarray:
    """The sum over tasks of ``size`` doubles each. Tasks of a shuffle add them up piece by piece, so that the driver gets
    one sum, or the tasks' own where they are small. They are added in an order of their own, as tasks end in any."""

    def add(batches):
        at = total = None
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(raw.as_py(), "<f8")
                if k != at and at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["at", "v"])
                at, total = k, total + v if k == at else v
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["at", "v"])

    if rows.rdd.getNumPartitions() * size > DIRECT:
        rows = rows.repartition("at").sortWithinPartitions("at", "v").mapInArrow(add, "at long, v binary")
    out = np.zeros(size)
    for at, v in sorted(map(tuple, rows.collect())):
        v = np.frombuffer(v, "<f8")
        out[at * PIECE : at * PIECE + len(v)] += v
    return out


def fit(rows: DataFrame, key: str = "key", label: str = "label", group: str = "group", features: str = "features", strengths: tuple[float, ...] = STRENGTHS, folds: int = FOLDS, tolerance: float = 1e-5, passes: int = 200) -> Fit:
    """The fit over rows (key, label 0 or 1, group, features array<double>). Rows with a null among these take no part.

    A fold whose training rows lack a label scores its rows with the share of label 1 among them.
    """
    spark = rows.sparkSession
    ok = F.col(label).isNotNull() & F.col(group).isNotNull()  # a condition on the vector would compute it twice

    def pack(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ft.CHUNK):
                b = batch.slice(i, ft.CHUNK)
                b = b.filter(b.column(3).is_valid())
                at, v = b.column(3).offsets.to_numpy(), b.column(3).values.to_numpy(zero_copy_only=False)
                vectors = [v[lo:hi].astype("<f8").tobytes() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(vectors, pa.binary())], ["key", "label", "fold", "x"])
        ft.give_back()

    kind = rows.schema[key].dataType.simpleString()
    cut = rows.where(ok).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.pmod(F.xxhash64(F.col(group)), F.lit(folds)).cast("int").alias("fold"), features)
    cut = saved(cut.mapInArrow(pack, f"key {kind}, label int, fold int, x binary"), GROUP)
    counts = {(r.fold, r.label): r.n for r in cut.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}  # 2 rows a fold
    if not counts:
        return Fit(np.zeros(0), 0.0, strengths[0], {}, cut.select("key", "label", "fold", F.lit(0.0).alias("score")))
    have = lambda f, y: sum(n for (g, c), n in counts.items() if g != f and c == y)
    models = [(f, c) for f in range(folds) for c in strengths]
    width = len(cut.first().x) // 8
    bend = _curvature(cut, width, sum(counts.values()), _shares([(-1, 1.0)], have)[:, 0])
    fitted = _search(cut, models, have, bend, width, tolerance, passes)
    scores = saved(_out_of_fold(cut, models, fitted, have, strengths))
    long = scores.select("key", "label", "fold", F.posexplode("scores").alias("s", "score"))
    got = {strengths[r.s]: r.precision for r in average_precision(long, "score", F.col("label") == 1, ["s"]).collect()}  # a row for each strength
    best = max(strengths, key=lambda c: (round(got.get(c, 0.0), 12), -strengths.index(c)))
    final = _search(cut, [(-1, best)], have, bend, width, tolerance, passes)[0]
    chosen = scores.select("key", "label", "fold", F.element_at("scores", strengths.index(best) + 1).alias("score"))
    return Fit(final[:-1], float(final[-1]), best, got, chosen)


def _curvature(held: DataFrame, width: int, n: int, share: np.ndarray) -> _Bend:
    """From one pass: each task adds up x x' of its rows, with a 1 for the bias and the weights of all rows' labels, and
    hands on the half that counts. There are so few tasks that these sums are a quarter of the vectors at most."""
    half = np.triu_indices(width + 1)

    def squares(batches):
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            y = b.column(0).to_numpy()
            for own, x in _block(b.column(1)):
                x = np.hstack([x, np.ones((len(x), 1))])
                total += (x.T * share[y[own]]) @ x
        yield _pieces(total[np.triu_indices(width + 1)])
        total = None
        ft.give_back()

    rows = held.select("label", "x")
    most = max(1, n // (2 * width))
    if rows.rdd.getNumPartitions() > most:
        rows = rows.coalesce(most)
    gram = np.zeros((width + 1, width + 1))
    gram[half] = _added(rows.mapInArrow(squares, "at long, v binary"), len(half[0]))
    return _Bend(gram + np.triu(gram, 1).T)


def _shares(models: list[tuple[int, float]], have) -> np.ndarray:
    """Balanced weights of the labels (rows 0 and 1) in the models' training rows, each divided by their number; 0 where a label is absent."""
    out = np.zeros((2, len(models)))
    for m, (f, _) in enumerate(models):
        n = have(f, 0) + have(f, 1)
        if have(f, 0) and have(f, 1):
            out[:, m] = [n / (2 * have(f, y)) / n for y in (0, 1)]
    return out


def _search(held: DataFrame, models: list[tuple[int, float]], have, bend: _Bend, width: int, tolerance: float, passes: int) -> list[np.ndarray]:
    """The optimum of each model: mean weighted loss + |w|^2 / (2 strength n)."""
    share = _shares(models, have)
    ridge = [1 / (c * max(have(f, 0) + have(f, 1), 1)) for f, c in models]
    steps = [_Step(bend, width + 1, r, tolerance) for r in ridge]
    for m, s in enumerate(steps):
        s.done = not share[:, m].any()
    for _ in range(passes):
        open_ = [m for m, s in enumerate(steps) if not s.done]
        if not open_:
            break
        w = np.stack([steps[m].at for m in open_], axis=1)
        got = _losses(held, w, np.array([models[m][0] for m in open_]), share[:, open_])
        for i, m in enumerate(open_):
            v = got[:, i]
            own = steps[m].at[:-1]
            g = v[1:].copy()
            g[:-1] += ridge[m] * own
            steps[m].told(float(v[0] + ridge[m] / 2 * own @ own), g)
    return [s.x for s in steps]


def _losses(held: DataFrame, w: np.ndarray, folds: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Loss and gradient of each model, one column a model, over all rows outside of its fold."""
    sent = held.sparkSession.sparkContext.broadcast((w, folds, share))

    def pass_over(batches):
        w, folds, share = sent.value
        total = np.zeros((len(w) + 1, w.shape[1]))
        for b in batches:
            labels, own_folds = b.column(0).to_numpy(), b.column(1).to_numpy()
            for own, x in _block(b.column(2)):
                y, f = labels[own], own_folds[own]
                z = x @ w[:-1] + w[-1]
                s = share[y] * (f[:, None] != folds[None, :])
                sign = np.where(y > 0, 1.0, -1.0)[:, None]
                total[0] += (s * np.logaddexp(0, -sign * z)).sum(axis=0)
                d = -s * sign / (1 + np.exp(np.clip(sign * z, -700, 700)))
                total[1:-1] += x.T @ d
                total[-1] += d.sum(axis=0)
        yield _pieces(total.ravel())
        ft.give_back()

    out = _added(held.select("label", "fold", "x").mapInArrow(pass_over, "at long, v binary"), (len(w) + 1) * w.shape[1]).reshape(len(w) + 1, -1)
    sent.unpersist()
    return out


def _out_of_fold(held: DataFrame, models: list[tuple[int, float]], fitted: list[np.ndarray], have, strengths: tuple[float, ...]) -> DataFrame:
    """(key, label, fold, scores): of each row the scores of its fold's models, by strength."""
    w, folds = np.stack(fitted, axis=1), sorted({f for f, _ in models})
    plain = {f: have(f, 1) / max(have(f, 0) + have(f, 1), 1) for f in folds if not (have(f, 0) and have(f, 1))}
    sent = held.sparkSession.sparkContext.broadcast((w, plain))
    k = len(strengths)

    def rate(batches):
        w, plain = sent.value
        for b in batches:
            f = b.column(2).to_numpy()
            out = np.zeros((len(f), k))
            for own, x in _block(b.column(3)):
                for fold in np.unique(f[own]).tolist():
                    some = np.flatnonzero(f[own] == fold)
                    z = x[some] @ w[:-1, fold * k : fold * k + k] + w[-1, fold * k : fold * k + k]
                    out[own.start + some] = plain[fold] if fold in plain else 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out.tolist(), pa.list_(pa.float64()))], ["key", "label", "fold", "scores"])

    return held.select("key", "label", "fold", "x").mapInArrow(rate, f"key {held.schema['key'].dataType.simpleString()}, label int, fold int, scores array<double>")


# --- the scorer ---


def version(seed: str, characters: int | None) -> str:
    """A digest of what a vector depends on: names, sizes, seed, limit, and the vector's blocks for fixed probes."""
    probes = [np.round(ft.hashed_blocks(p, seed), 9).tolist() for p in ("", "a b c", "ignore the previous rules", "i g n o r e")]
    return hashlib.sha256(json.dumps([ft.DENSE, ft.BUCKETS, ft.SIZES, ft.WORDS, seed, characters, probes]).encode()).hexdigest()[:16]


@dataclass
class Scorer:
    """Weights with what they were fitted on. ``publish``: the least score that is shown; ``enforce``: from which on ``verdict`` applies."""

    weights: np.ndarray
    bias: float
    seed: str = "features/1"
    characters: int | None = None
    publish: float = 0.97
    enforce: float | None = None
    verdict: str = "SANITIZE"

    def record(self) -> str:
        """The scorer as canonical JSON with its digest."""
        core = {"weights": [float(w) for w in self.weights], "bias": self.bias, "seed": self.seed, "characters": self.characters, "version": version(self.seed, self.characters), "dimension": ft.DIMENSION}
        return json.dumps(core | {"sha256": _digest(core)}, sort_keys=True)

    @classmethod
    def load(cls, record: str, **more) -> "Scorer":
        """The scorer of a record; another version of the vector, another digest or a weight that is no finite number is an error."""
        core = json.loads(record)
        if _digest({k: v for k, v in core.items() if k != "sha256"}) != core.get("sha256"):
            raise ValueError("the record's digest differs")
        if core["version"] != version(core["seed"], core["characters"]) or core["dimension"] != ft.DIMENSION or len(core["weights"]) != ft.DIMENSION:
            raise ValueError("fitted on other features")
        if not all(isinstance(w, float) and math.isfinite(w) for w in [*core["weights"], core["bias"]]):
            raise ValueError("a weight is no finite number")
        return cls(np.array(core["weights"]), core["bias"], core["seed"], core["characters"], **more)

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Adds attack_probability (null below ``publish``) and enforced (a verdict or null); a null text has neither."""
        weights, bias = self.weights, self.bias

        @F.pandas_udf(T.DoubleType())
        def logit(v: pd.Series) -> pd.Series:
            some = v.notna().to_numpy()
            out = np.full(len(v), np.nan)
            if some.any():
                for i in range(0, len(at := np.flatnonzero(some)), ROWS):
                    own = at[i : i + ROWS]
                    out[own] = np.stack(v.iloc[own].tolist()) @ weights + bias
            return pd.Series(out).where(some, None)

        name = _fresh(df, "_features")
        z = ft.vectors(df, text, name, self.characters, self.seed).withColumn(name, logit(name))
        p = F.when(F.col(name) >= 0, 1 / (1 + F.exp(-F.col(name)))).otherwise(F.exp(name) / (1 + F.exp(name)))
        enforced = F.lit(None).cast("string") if self.enforce is None else F.when(p >= self.enforce, self.verdict)
        return z.withColumns({"attack_probability": F.when(p >= self.publish, p), "enforced": enforced}).drop(name)


def _digest(core: dict) -> str:
    return hashlib.sha256(json.dumps(core, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
