"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, x = floor(64 * c) + 1000000, so that sums over rows are exact and rows can be centred without loss. With
X the centred rows, the process alternates distributed products Xv and X'u and builds X V = U B, where V and U are orthonormal
and B is bidiagonal; the singular values of the small B are those of X, and V turned by B's right vectors are the components.
One pass over the rows makes both products of a step: it takes r = X v - beta u, and sums U'r, X'r and r'r; what full
reorthogonalisation takes off r, and X'(Ur), follow from those sums. The left vectors are as long as the table; they are
never stored, since every u is X w for a short w that is known. V is orthogonalised against all its columns twice a step.
When a step breaks down (an eigenvalue that occurs more than once, or none left) the process goes on from a new direction, so
that it always runs through all dimensions and misses no component.

Rows are packed into blocks in a working table, which all passes read; a pass returns one number per dimension and step, summed by an
exchange. The driver holds dims x dims numbers, never a row.

Defined cases: vectors that are null or hold null or non-finite entries, or scaled entries of ``LARGEST`` and more, are left out; vectors of
different lengths are fitted apart, each length as a table of its own; repeated rows count and are returned once each, null
ids like others; directions without variance (below ``FLAT`` of the largest deviation) are no components, so that equal rows, or a
single one, give no result rows, and so do empty vectors and an empty table; of equal eigenvalues any orthonormal basis counts; a squared deviation beyond
the range of long is null; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscape.llm.common import columns, saved, small_batches

SCALE, SHIFT, TOP = 64, 1_000_000, 32
#: Deviations below this share of the largest are rounding.
FLAT = 1e-9
#: Scaled entries from here on are left out, so that differences of two of them are still longs.
LARGEST = 4e18
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Centre:
    """Rows of one length: how many, their sums, and sums as n * quotient + remainder."""

    dims: int
    n: int
    sums: tuple[int, ...]

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        quotient, rest = zip(*[divmod(s, self.n) for s in self.sums], strict=True)
        return np.array(quotient, np.int64), np.array(rest, np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x less its mean; only the last subtraction rounds."""
        quotient, rest = self.parts()
        return (x - quotient).astype(np.float64) - rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums) ** 2, exactly."""
        quotient, rest = self.parts()
        d = x - quotient
        most = (self.n * (float(np.abs(d.astype(np.float64)).max(initial=0)) + 1)) ** 2 * self.dims
        if most < 2**62:
            return ((self.n * d - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in d]
        return [e if e < 2**63 else None for e in exact]


@dataclass(frozen=True)
class Whitening:
    """Components as columns, their standard deviations and shares of the variance, and how far whitened rows are from unit covariance."""

    centre: Centre
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ self.components / self.deviations


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes[sizes > 0]):
            rows = pa.array(np.flatnonzero(sizes == dims))
            x = np.ascontiguousarray(batch.column(1).take(rows).flatten().to_numpy(zero_copy_only=False), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([int(dims)], pa.int32()), pa.array([batch.column(0).take(rows).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], ["dims", "ids", "x"])


def blocks(vectors: DataFrame) -> DataFrame:
    """dims, ids and x: some hundred usable rows of one length, whole numbers row by row; a working table."""
    small_batches(vectors.sparkSession)
    v = columns(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    entry = lambda c: c * float(SCALE)
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(entry(c)) >= LARGEST))
    x = F.transform("v", lambda c: F.floor(entry(c)) + F.lit(SHIFT).cast("long"))
    return saved(v.where(~F.coalesce(odd, F.lit(True))).select("vec_id", x.alias("x")).mapInArrow(_pack, "dims int, ids array<long>, x binary"), "zstd")


def _matrix(packed: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(packed, "<i8").reshape(-1, dims)


def centres(packed: DataFrame) -> list[Centre]:
    """One centre per length of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dims, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = _matrix(raw, dims)
                if np.abs(x.astype(np.float64)).max() * len(x) < 2**62:
                    new = [len(x), *x.sum(axis=0).tolist()]
                else:
                    new = [len(x), *x.astype(object).sum(axis=0)]
                old = held.setdefault(dims, [0] * (dims + 1))
                held[dims] = [a + b for a, b in zip(old, new, strict=True)]
        rows = [(dims, place, str(value)) for dims, values in held.items() for place, value in enumerate(values)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), pa.string()], strict=True)], ["dims", "place", "value"])

    sums = packed.select("dims", "x").mapInArrow(run, "dims int, place int, value string")
    sums = sums.groupBy("dims", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # dims + 1 rows a length
    by: dict[int, dict[int, int]] = {}
    for r in sums:
        by.setdefault(r["dims"], {})[r["place"]] = int(r["value"])
    return [Centre(dims, v[0], tuple(v[k + 1] for k in range(dims))) for dims, v in sorted(by.items())]


def _summed(packed: DataFrame, centre: Centre, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of ``of(centred rows)``, ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += of(centre.rows(_matrix(raw, centre.dims)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["place", "value"])

    parts = packed.where(F.col("dims") == centre.dims).select("x").mapInArrow(run, "place int, value double")
    out = np.zeros(size)
    for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():  # ``size`` rows
        out[r["place"]] = r["value"]
    return out


def _away(z: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """z less its part in the basis, taken off twice."""
    for _ in range(2):
        if basis:
            b = np.array(basis)
            z = z - (b @ z) @ b
    return z


def bidiagonalise(packed: DataFrame, centre: Centre) -> tuple[np.ndarray, np.ndarray]:
    """V (as columns) and the bidiagonal B with X V = U B, by one pass over the rows a step."""
    dims, spark = centre.dims, packed.sparkSession
    rnd = np.random.default_rng(12)
    right: list[np.ndarray] = []
    short = np.zeros((dims, 0))  # U = X short
    back = np.zeros((dims, 0))  # X'U
    matrix = np.zeros((dims, dims))
    beta, scale = 0.0, 0.0
    v = _away(rnd.standard_normal(dims), right)
    v /= np.linalg.norm(v)
    while True:
        j = len(right)
        right.append(v)
        start = v - beta * short[:, j - 1] if j else v
        shared = spark.sparkContext.broadcast((start, short))

        def step(c: np.ndarray, shared=shared) -> np.ndarray:
            start, short = shared.value
            r = c @ start
            return np.concatenate([r @ (c @ short), r @ c, [r @ r]])

        sums = _summed(packed, centre, j + dims + 1, step)
        shared.unpersist()
        lean, product, square = sums[:j], sums[j:-1], sums[-1]
        alpha = float(np.sqrt(max(0.0, square - lean @ lean)))
        scale = max(scale, alpha, beta)
        if alpha > FLAT * scale:
            w, z = (start - short @ lean) / alpha, (product - back @ lean) / alpha
        else:  # Xv lies in the left vectors found so far
            alpha, w, z = 0.0, np.zeros(dims), np.zeros(dims)
        short, back = np.column_stack([short, w]), np.column_stack([back, z])
        matrix[j, j] = alpha
        if j + 1 == dims:
            return np.array(right).T, matrix
        z = _away(z - alpha * v, right)
        beta = float(np.linalg.norm(z))
        if beta <= FLAT * scale:
            beta, z = 0.0, _away(rnd.standard_normal(dims), right)
            z /= np.linalg.norm(z)
            z = _away(z, right)
        v = z / np.linalg.norm(z)
        matrix[j, j + 1] = beta


def fit(packed: DataFrame, centre: Centre, top: int = TOP) -> Whitening | None:
    """Leading components of the rows of one length; None without variance."""
    dims, n = centre.dims, centre.n
    moments = _summed(packed, centre, dims + 1, lambda c: np.concatenate([c.sum(axis=0), [(c * c).sum()]]))
    trace = moments[-1] / n
    if trace <= 0:
        return None
    right, matrix = bidiagonalise(packed, centre)
    _, values, turned = np.linalg.svd(matrix)
    keep = np.flatnonzero(values > FLAT * values[0])[:top]
    components = right @ turned[keep].T
    components *= np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(keep))])
    deviations = values[keep] / np.sqrt(n)
    lean = moments[:dims] / n @ components / deviations  # means of the whitened rows, by rounding not quite 0

    def outer(c: np.ndarray) -> np.ndarray:
        w = c @ components / deviations - lean
        return (w.T @ w).ravel()

    covariance = _summed(packed, centre, len(keep) ** 2, outer).reshape(len(keep), -1) / n
    error = float(np.abs(covariance - np.eye(len(keep))).max())
    return Whitening(centre, components, deviations, deviations**2 / trace, error)


def whiten(packed: DataFrame, models: list[Whitening]) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    spark: SparkSession = packed.sparkSession
    shared = spark.sparkContext.broadcast({m.centre.dims: m for m in models})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, ids, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                m = shared.value.get(dims)
                if m is None:
                    continue
                x = _matrix(raw, dims)
                k, rows = m.components.shape[1], np.arange(len(x)).repeat(m.components.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()).take(pa.array(rows)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(rows), m.centre.n, np.int64)),
                        pa.array(m.centre.deviation(x), pa.int64()).take(pa.array(rows)),
                        pa.array(m.whiten(x).ravel()),
                        pa.array(np.tile(m.explained, len(x))),
                        pa.array(np.full(len(rows), m.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return packed.select("dims", "ids", "x").mapInArrow(run, _OUT)


def whitened(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """Every usable row of ``vectors`` on the leading components, scaled to unit variance."""
    packed = blocks(vectors)
    models = [fit(packed, c, top) for c in centres(packed)]
    return whiten(packed, [m for m in models if m])
