"""Whitened embeddings with an exact covariance, by products of digit slices.

An entry c becomes the integer x = floor(64 c) + 1000000. The fit list
is each distinct vector of integers once: n of them, S their sum. Centred
entries z = n x - S are integers too; each is cut into digits of ``DIGIT`` bits,
so that a float64 product of two matrices of digits over ``BLOCK`` rows stays
below 2^53 and is exact. The products are shifted and added as big integers,
each partition's sums are cut into limbs of 60 bits that Spark adds as longs,
and the one covariance matrix that comes of it, n^3 V, is rounded once and
decomposed.

Three passes read the fit list, which is settled: sums and bounds, products,
and the covariance of what came out. The driver gets sums of d x d entries.

Rows whose vector is null, or has an entry that is null, not finite or too large
for a long, give no rows; empty vectors neither. Vectors of another length are
fitted on their own. A component without variance (fewer distinct vectors than
dimensions, constant entries) is 0 for every row and explains 0. Repeated rows
each give their rows, null ids too. A deviation beyond a long is null in the
query and whole in the decimal of ``whitened``, up to 38 digits. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .vectors import matrices, sound

SHIFT = 1000000
DIGIT = 20
#: Rows multiplied at a time: 2 * DIGIT + log2(BLOCK) bits are 52.
BLOCK = 4096
LIMB = 60
LIMBS = 5


def whole_numbers(vector: Column) -> Column:
    """The vector's integers x."""
    return F.transform(vector, lambda c: F.floor(F.lit(64.0) * c.cast("double")) + F.lit(SHIFT))


def _fits(vector: Column) -> Column:
    return F.forall(vector, lambda c: F.abs(c.cast("double")) < float(1 << 56))


def limbs_of(value: int) -> list[int]:
    """A big integer in limbs, lowest first; the highest bears the sign."""
    low = [value >> (LIMB * k) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)]
    return [*low, value >> (LIMB * (LIMBS - 1))]


def joined(limbs: list[int]) -> int:
    return sum(int(v) << (LIMB * k) for k, v in enumerate(limbs))


def _rows_of(numbers: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """Rows of (length, i, j, big integer)."""
    cut = [limbs_of(v) for *_, v in numbers]
    at = [pa.array([r[k] for r in numbers], pa.int32()) for k in range(3)]
    return pa.RecordBatch.from_arrays([*at, *[pa.array([c[k] for c in cut], pa.int64()) for k in range(LIMBS)]], names=["length", "i", "j", *[f"l{k}" for k in range(LIMBS)]])


BIG = "length int, i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))


def _merged(parts: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """The sums of big integers by length and place, added by Spark limb by limb.
    A limb has 60 bits: its high and low halves are added apart, so that no sum of
    fewer than 2^33 partitions runs over."""
    halves = []
    for k in range(LIMBS):
        halves += [F.sum(F.expr(f"l{k} & {(1 << 30) - 1}")).alias(f"a{k}"), F.sum(F.shiftright(f"l{k}", 30)).alias(f"b{k}")]
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in parts.groupBy("length", "i", "j").agg(*halves).toLocalIterator():
        out.setdefault(r.length, {})[r.i, r.j] = joined([r[f"a{k}"] + (r[f"b{k}"] << 30) for k in range(LIMBS)])
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The count (i = -1) and the sum of each entry, by length."""
    total: dict[int, list] = {}
    for batch in batches:
        for _, x in matrices(batch.column(0)):
            at = total.setdefault(x.shape[1], [0, [0] * x.shape[1]])
            at[0] += len(x)
            high, low = x >> 31, x & ((1 << 31) - 1)  # sums of either half stay within a long
            at[1] = [s + (int(a) << 31) + int(b) for s, a, b in zip(at[1], high.sum(axis=0), low.sum(axis=0), strict=True)]
    yield _rows_of([(d, i, j, v) for d, (n, s) in total.items() for i, j, v in [(-1, 0, n), *[(i, 0, v) for i, v in enumerate(s)]]])


def _digits(z: np.ndarray, count: int) -> list[np.ndarray]:
    """Integers in ``count`` digits, lowest first, as float64; the highest bears the sign."""
    low = [(z >> (DIGIT * k) & ((1 << DIGIT) - 1)).astype(np.float64) for k in range(count - 1)]
    return [*low, (z >> (DIGIT * (count - 1))).astype(np.float64)]


def exact_products(z: np.ndarray) -> np.ndarray:
    """z^T z of integers, as big integers. Entries may be longs or big themselves."""
    across = z.shape[1]
    total = np.zeros((across, across), object)
    for at in range(0, len(z), BLOCK):
        block = z[at : at + BLOCK]
        count = max(int(block.max()).bit_length(), int(-block.min()).bit_length()) // DIGIT + 1
        parts = _digits(block, count)
        for a in range(count):
            for b in range(a, count):
                # digits are under 2^DIGIT, the highest of either sign: a sum over BLOCK rows is under 2^53
                product = (parts[a].T @ parts[b]).astype(np.int64).astype(object) << (DIGIT * (a + b))
                total = total + (product if a == b else product + product.T)
    return total


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, as longs where they fit and big integers elsewhere."""
    most = max(max(abs(n * int(top) - s), abs(n * int(least) - s)) for top, least, s in zip(x.max(axis=0), x.min(axis=0), sums, strict=True))
    big = n * max(abs(int(x.max())), abs(int(x.min()))) >= 1 << 62 or max(map(abs, sums)) >= 1 << 62 or most >= 1 << 62
    return x.astype(object) * n - np.array(sums, object) if big else x * np.int64(n) - np.array(sums, np.int64)


def _products(known: dict[int, tuple[int, list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                d = x.shape[1]
                if d:
                    total[d] = total.get(d, 0) + exact_products(_centred(x, *known[d]))
        yield _rows_of([(d, i, j, int(g[i, j])) for d, g in total.items() for i in range(d) for j in range(i, d)])

    return run


@dataclass
class Fit:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    axes: np.ndarray  # one column a component
    values: np.ndarray  # eigenvalues, falling
    explained: np.ndarray
    error: float = 0.0

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(z, whitened) of rows of integers: n x - S exactly, and on the components."""
        z = _centred(x, self.n, self.sums)
        scale = np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1)), 0.0)
        return z, (z / self.n).astype(np.float64) @ self.axes * scale


def decomposed(n: int, sums: list[int], products: dict[tuple[int, int], int], components: int) -> Fit:
    """The fit of one length. ``products`` are n^3 times the covariance."""
    d = len(sums)
    v = np.zeros((d, d))
    for (i, j), g in products.items():
        v[i, j] = v[j, i] = g / n**3  # of two integers: rounded once
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    values = np.where(values > max(values[0], 0) * d * np.finfo(float).eps * 4, values, 0.0)
    trace = np.trace(v)
    return Fit(n, sums, axes, values, values / trace if trace > 0 else np.zeros(len(values)))


def _outers(fits: dict[int, Fit]):
    """Sums of what is whitened (j = -1) and of its products, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                if d := x.shape[1]:
                    w = fits[d].apply(x)[1]
                    total[d] = total.get(d, 0) + np.vstack([w.sum(axis=0), w.T @ w])
        rows = [(d, i, j, float(s[i, j])) for d, s in total.items() for i in range(len(s)) for j in range(s.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["length", "i", "j", "s"])

    return run


def fitted(vectors: DataFrame, components: int = 16) -> dict[int, Fit]:
    """The fit of each length over ``vectors`` (x: array of long), each row once."""
    known: dict[int, tuple[int, list[int]]] = {}
    for d, found in _merged(vectors.mapInArrow(_sums, BIG)).items():
        known[d] = found[-1, 0], [found[i, 0] for i in range(d)]
    products = _merged(vectors.mapInArrow(_products(known), BIG))
    fits = {d: decomposed(n, sums, products[d], components) for d, (n, sums) in known.items() if d}
    outer: dict[int, dict[tuple[int, int], float]] = {}
    for r in vectors.mapInArrow(_outers(fits), "length int, i int, j int, s double").groupBy("length", "i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        outer.setdefault(r.length, {})[r.i, r.j] = r.s
    for d, fit in fits.items():
        k = len(fit.values)
        s = np.array([[outer[d][i, j] for j in range(k)] for i in range(k + 1)]) / fit.n
        spread = s[1:] - np.outer(s[0], s[0]) - np.eye(k)
        there = fit.values > 0
        fit.error = float(np.abs(spread[there][:, there]).max(initial=0.0))
    return fits


def _deviation(z: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    if z.dtype == object or int(np.abs(z).max(initial=0)) ** 2 * z.shape[1] >= 1 << 63:
        return [sum(v * v for v in row) for row in z.astype(object).tolist()]
    return (z * z).sum(axis=1).tolist()


def _applied(fits: dict[int, Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column(1)):
                if not x.shape[1]:
                    continue
                fit = fits[x.shape[1]]
                z, w = fit.apply(x)
                k = w.shape[1]
                each = np.repeat(rows, k)
                far = [v if v < 10**38 else None for v in _deviation(z)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(each), fit.n, np.int64)),
                        pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                        pa.array(w.reshape(-1)),
                        pa.array(np.tile(fit.explained, len(rows))),
                        pa.array(np.full(len(each), fit.error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whitened(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of
    each row of ``embeddings`` (vec_id, embedding) that has a sound vector."""
    rows = embeddings.filter(sound(F.col("embedding"))).filter(_fits(F.col("embedding"))).select("vec_id", whole_numbers(F.col("embedding")).alias("x"))
    fits = fitted(settle(rows.select("x").distinct()), components)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(_applied(fits), f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
