"""Whitening of embeddings by a hierarchy of singular value decompositions.

Each task decomposes its vectors, centred on their own mean, slice by slice, and keeps the
count, the exact sums, all singular values and all right vectors. Summaries are merged a
few at a time, level by level, until one is left. A merge stacks the factors
(singular values times vectors) of both sides and a row that corrects the means,
sqrt(p q / (p + q)) times their difference, and decomposes that stack anew. The product of
the stack with its transpose is the scatter of both sides about their common mean, so
nothing is lost, whatever the order of the merges, and no dimension is dropped before the
end. Centring before multiplying keeps small spreads beside large means exact: means are
held as whole sums, and differences of them are taken in whole numbers.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import drop_staged, lean, staged, table
from barlab.llm.decontaminate import arrow_type
from barlab.llm.hard_negatives import numbers

SLICE, FAN_IN = 4096, 8  # vectors decomposed at once, summaries of a merge
SUMMARY = "n bigint, sums array<string>, factor binary"
LIMIT = 1 << 62


class Summary:
    """Count, sums in whole numbers, and a factor R of the scatter about the mean: R'R."""

    def __init__(self, n: int, sums: list[int], factor: np.ndarray):
        self.n, self.sums, self.factor = n, sums, factor

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of the rows of a matrix of whole numbers."""
        sums = [int(s) for s in x.astype(object).sum(0)] if x.size and int(np.abs(x).max()) > LIMIT // len(x) else [int(s) for s in x.sum(0)]
        return cls(len(x), sums, _factor(centred(x, len(x), sums)))

    def merge(self, other: Summary) -> Summary:
        p, q = self.n, other.n
        apart = np.array([float(Fraction(a * q - b * p, p * q)) for a, b in zip(self.sums, other.sums, strict=True)])
        row = math.sqrt(p * q / (p + q)) * apart
        return Summary(p + q, [a + b for a, b in zip(self.sums, other.sums, strict=True)], _factor(np.vstack([self.factor, other.factor, row[None]])))

    def row(self) -> tuple[int, list[str], bytes]:
        return self.n, [str(s) for s in self.sums], self.factor.tobytes()

    @classmethod
    def read(cls, n: int, sums: list[str], factor: bytes) -> Summary:
        return cls(n, [int(s) for s in sums], np.frombuffer(factor).reshape(-1, len(sums)) if sums else np.zeros((0, 0)))


def _factor(rows: np.ndarray) -> np.ndarray:
    """All singular values times their right vectors."""
    if not rows.size:
        return np.zeros((0, rows.shape[1]))
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, rounded once."""
    return away(x, n, sums).astype(float) / n


def away(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exact; as Python's numbers where 64 bits do not hold it."""
    wide = x.size and max(int(np.abs(x).max()), 1) > LIMIT // n or max(map(abs, sums), default=0) > LIMIT
    if wide:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def _summaries(width: int):
    names = ["n", "sums", "factor"]

    def batch_of(s: Summary) -> pa.RecordBatch:
        n, sums, factor = s.row()
        return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums], pa.list_(pa.string())), pa.array([factor], pa.binary())], names=names)

    def of_vectors(batches):
        held = None
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                new = Summary.of(numbers(batch.column(0).slice(at, SLICE), width))
                held = new if held is None else held.merge(new)
        if held is not None:
            yield batch_of(held)

    def of_summaries(batches):
        """One for each group of rows (group, n, sums, factor), which come together."""
        now, held = None, None
        for batch in batches:
            for g, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g != now and held is not None:
                    yield batch_of(held)
                now, held = g, Summary.read(*row) if g != now else held.merge(Summary.read(*row))
        if held is not None:
            yield batch_of(held)

    return of_vectors, of_summaries


def fit(distinct: DataFrame, width: int) -> Summary | None:
    """The summary of a one-column frame of vectors; None without any."""
    spark = distinct.sparkSession
    of_vectors, of_summaries = _summaries(width)
    level, path = staged(distinct.mapInArrow(lean(of_vectors), SUMMARY), "summaries")
    while (n := level.count()) > FAN_IN:
        grouped = level.withColumn("group", F.pmod(F.xxhash64("sums", "n"), F.lit(-(-n // FAN_IN)))).select("group", "n", "sums", "factor")
        level, new = staged(grouped.repartition("group").sortWithinPartitions("group", "n", "sums").mapInArrow(lean(of_summaries), SUMMARY), "summaries")
        drop_staged(spark, path)
        path = new
    held = None
    for r in sorted(level.collect(), key=lambda r: (r.n, r.sums)):  # FAN_IN rows at most
        one = Summary.read(r.n, r.sums, bytes(r.factor))
        held = one if held is None else held.merge(one)
    drop_staged(spark, path)
    return held


class Model:
    """The components of a summary: those that have a spread, at most ``most``."""

    def __init__(self, s: Summary, most: int):
        self.n, self.sums = s.n, s.sums
        _, values, vectors = np.linalg.svd(s.factor, full_matrices=False) if s.factor.size else (None, np.zeros(0), np.zeros((0, len(s.sums))))
        spread = values > (values[0] if len(values) else 0.0) * len(s.sums) * np.finfo(float).eps
        e = values**2 / s.n
        k = min(most, int(spread.sum()))
        self.vectors = vectors[:k] * np.sign(vectors[np.arange(k), np.abs(vectors[:k]).argmax(1)])[:, None]
        self.e, self.explained = e[:k], e[:k] / e.sum() if k else e[:k]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.vectors.T / np.sqrt(self.e)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of the squares of n x - sums, exact; beyond 64 bits an error."""
        d = away(x, self.n, self.sums)
        if d.dtype == object or d.size and max(int(np.abs(d).max()), 1) > math.isqrt(LIMIT // d.shape[1]):
            whole = [sum(int(c) ** 2 for c in row) for row in d]
            if max(whole) >= 1 << 63:
                raise OverflowError("deviations do not fit 64 bits")
            return np.array(whole, np.int64)
        return (d * d).sum(1)


def _gram(model, width: int):
    """(sums, products) of the whitened vectors of a task, as numbers in bytes."""

    def run(batches):
        k = len(model.value.e)
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                w = model.value.whitened(numbers(batch.column(0).slice(at, SLICE), width))
                sums += w.sum(0)
                products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([products.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["sums", "products"])

    return run


def identity_error(distinct: DataFrame, shared, width: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k, n = len(shared.value.e), shared.value.n
    parts = distinct.mapInArrow(lean(_gram(shared, width)), "sums array<double>, products array<double>")
    long = parts.select(F.posexplode(F.concat("products", "sums")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    v = np.zeros(k * k + k)
    for r in long.collect():  # k * (k + 1) rows
        v[r.i] = r.v
    mean = v[k * k :] / n
    return float(np.abs(v[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


def whiten(vectors: DataFrame, *, scale: int = 64, offset: int = 1_000_000, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): for each row
    its coordinates on the components of largest spread, each divided by that spread.

    Entries are cut to ``floor(scale * c) + offset``. The components are fitted on each
    distinct vector once, of which there are ``n``; ``deviation`` is the exact sum of the
    squares of n times the vector minus all vectors' sum. Rows whose vector is null or holds
    null or non-finite entries are dropped; shorter vectors count as filled up with zeros
    before they are cut. Components without spread (equal vectors, or fewer vectors than
    dimensions) are left out, so that a table of equal vectors, or an empty one, gives no
    rows. Rows that repeat are returned as often, null ids pass through, and other columns
    are ignored. The largest entry of a component is positive.
    """
    spark, id_type = vectors.sparkSession, arrow_type(vectors, id_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter(F.col("v").isNotNull()).filter(sound)
    width = rows.agg(F.max(F.size("v")).alias("width")).first().width or 0
    cut = F.transform("v", lambda c: F.floor(c.cast("double") * scale) + offset)
    filled = F.concat(cut, F.array_repeat(F.lit(offset).cast("bigint"), F.lit(width) - F.size("v")))
    x, x_at = staged(rows.select("vec_id", filled.alias("x")), "whole-vectors")
    distinct, distinct_at = staged(x.select("x").distinct(), "distinct-vectors")
    summary = fit(distinct, width)
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if summary is None:
        drop_staged(spark, x_at, distinct_at)
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(Model(summary, components))  # (components + 1) vectors
    error = identity_error(distinct, shared, width)
    drop_staged(spark, distinct_at)

    def run(batches):
        model = shared.value
        k = len(model.e)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                m, whole = len(part), numbers(part.column(1), width)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).cast(id_type).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array(np.repeat(model.deviation(whole), k)), pa.array(model.whitened(whole).reshape(-1)), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(lean(run), schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """The first 16 whitened coordinates of each embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))


def brute_force(rows: list[tuple], scale: int = 64, offset: int = 1_000_000, components: int = 16) -> dict:
    """id -> (n, deviation, whitened, explained) by the eigenvectors of one covariance."""
    sound = [(i, [math.floor(scale * c) + offset for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in sound), default=0)
    sound = [(i, tuple(v + [offset] * (width - len(v)))) for i, v in sound]
    distinct = sorted({v for _, v in sound})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centre = lambda v: np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)])
    m = np.array([centre(v) for v in distinct])
    e, vectors = np.linalg.eigh(m.T @ m / n)
    e, vectors = e[::-1][:components], vectors[:, ::-1][:, :components]
    return {i: (n, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), centre(v) @ vectors / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(m.T @ m / n)) for i, v in sound}
