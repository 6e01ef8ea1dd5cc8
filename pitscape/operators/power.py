"""Cluster bootstrap over effect sizes with the multiplicities of all replicates as one vector.

A replicate draws clusters with return, so a row counts as often as its cluster was drawn. No row is ever copied: each carries the vector of
its multiplicities, one entry a replicate. Slopes and clustered errors need two sums over clusters. Rank correlations need each variable sorted
once: one running sum of the vectors along the sorted rows gives a row's average rank in every replicate at the same time.

Rows that are sorted carry whole numbers of few bytes: multiplicities, and ranks as what they exceed the start of their range by, in halves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from pitscape.operators.describe import student_two_sided
from pitscape.operators.ladder import summed
from pitscape.session import cut, release, stored

#: Rows of a sorted partition, which a task holds with a few vectors each.
ROWS = 8_000
MOMENTS = ["n", "so", "si", "se", "soo", "sii", "soe", "sie", "soi"]


def _weights(taken: Sequence, replicates: int) -> np.ndarray:
    return np.bincount(np.asarray(taken, np.int64), minlength=replicates).astype(float)


def _small(values: np.ndarray) -> bytes:
    """A vector of whole numbers, none negative, in the fewest of 1, 2, 4 or (as doubles) 8 bytes each that hold all of them."""
    top = values.max(initial=0)
    kind = np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else float
    return values.astype(kind).tobytes()


def _wide(packed: Sequence[bytes], replicates: int) -> np.ndarray:
    """Packed vectors as a matrix of doubles; their length tells the bytes a number."""
    out, kinds = np.empty((len(packed), replicates)), {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: float}
    size = np.array([len(p) for p in packed]) // replicates
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out[at] = np.frombuffer(b"".join([packed[i] for i in at]), kinds[int(n)]).reshape(-1, replicates)
    return out


def drawn(numbered: DataFrame, clusters: int, replicates: int, seed: int) -> DataFrame:
    """Clusters with ``w``, their multiplicities in all replicates (packed doubles); those that no replicate draws are left out.

    A draw is a seeded hash of its number, so a lost task draws the same clusters again.
    """
    draws = numbered.sparkSession.range(replicates * clusters).select(
        F.floor(F.col("id") / clusters).cast("int").alias("replicate"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(clusters)).alias("idx")
    )
    taken = draws.repartition("idx").groupBy("idx").agg(F.collect_list("replicate").alias("taken"))  # about a draw a replicate

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [_weights(t, replicates).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.binary())], ["idx", "w"])

    return stored(numbered.join(taken.mapInArrow(pack, "idx long, w binary"), "idx"))


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multiplicities in the last column as small numbers."""
    for batch in batches:
        w = [_small(np.frombuffer(v)) for v in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(w, pa.binary())], batch.schema.names)


def _line(kind: str, m: float, fraction: float, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of x, y, xx and xy of a line from the nine moments in the last axis of ``s``."""
    n, so, si, se, soo, sii, soe, sie, soi = np.moveaxis(s, -1, 0)
    y = se + fraction * m * si
    if kind == "oracle":
        return m * si, y, m * m * sii, m * sie + fraction * m * m * sii
    return so, y, soo, soe + fraction * m * soi


def slopes(clusters: DataFrame, lines: Sequence[tuple[str, float]], fraction: float, replicates: int, drawn_clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Slope and t of every (line, replicate), by two passes over the clusters' moments; each draw counts as a cluster of its own."""
    table = clusters.select("w", F.array(*[F.col(c).cast("double") for c in MOMENTS]).alias("s"))
    many = table.rdd.getNumPartitions() > 16
    total = summed(table, many, lambda row: {0: np.outer(np.frombuffer(row[0]), row[1]).ravel()})[0].reshape(replicates, len(MOMENTS))
    n = total[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        fits = []
        for kind, m in lines:
            sx, sy, sxx, sxy = _line(kind, m, fraction, total)
            var = sxx - sx * sx / n
            slope = np.where(var > 0, (sxy - sx * sy / n) / var, np.nan)
            fits.append((slope, (sy - slope * sx) / n, sx / n, var))

        def squares(row) -> dict[int, np.ndarray]:
            w, s = np.frombuffer(row[0]), np.array(row[1])
            out = []
            for (kind, m), (slope, intercept, mean, _) in zip(lines, fits, strict=True):
                sx, sy, sxx, sxy = _line(kind, m, fraction, s)
                score = (sxy - intercept * sx - slope * sxx) - mean * (sy - intercept * s[0] - slope * sx)
                out.append(w * score * score)
            return {0: np.concatenate(out)}

        meat = summed(table, many, squares)[0].reshape(len(lines), replicates)
        g = float(drawn_clusters)
        correction = g / (g - 1) * (n - 1) / (n - 2)
        slope = np.array([f[0] for f in fits])
        t = slope / (np.sqrt(correction * meat) / np.array([f[3] for f in fits]))
    return slope, t


class _Sorted:
    """Rows in ranges of ``value``, written once, and what lies before each range in every replicate."""

    def __init__(self, rows: DataFrame, value: Column, parts: int, replicates: int):
        self.replicates = replicates
        self.columns = rows.columns
        dealt = rows.withColumns({"v": value, "tie": F.xxhash64(*[c for c in rows.columns if c in ("o", "i", "e", "row")])})
        dealt = dealt.repartitionByRange(parts, "v", "tie").sortWithinPartitions("v", "tie")
        self.rows = cut(dealt.drop("tie"))
        self.at = [*self.columns, "v"].index
        w_at, v_at = self.at("w"), self.at("v")

        def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, w = _held(batches, (v_at, w_at), replicates)
            if len(v):
                sums = [w.sum(axis=0), w[v == v[0]].sum(axis=0), w[v == v[-1]].sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([v[0]]), pa.array([v[-1]]), pa.array([np.concatenate(sums).tobytes()], pa.binary())], ["part", "first", "last", "sums"])

        found = sorted(self.rows.mapInArrow(summary, "part int, first double, last double, sums binary").collect(), key=lambda r: r["part"])  # a row a range
        sums = [np.frombuffer(r["sums"]).reshape(3, -1) for r in found]
        self.total = sum((s[0] for s in sums), np.zeros(replicates))
        before = np.zeros(replicates)
        #: range -> (weight before its first value, weight of that value in earlier ranges, weight of its last value in later ranges)
        self.edges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, r in enumerate(found):
            tied, q = np.zeros(replicates), k - 1
            while q >= 0 and found[q]["last"] == r["first"]:
                tied = tied + sums[q][2]
                if found[q]["first"] != r["first"]:
                    break
                q -= 1
            later, q = np.zeros(replicates), k + 1
            while q < len(found) and found[q]["first"] == r["last"]:
                later = later + sums[q][1]
                if found[q]["last"] != r["last"]:
                    break
                q += 1
            self.edges[r["part"]] = before - tied, tied, later
            before = before + sums[k][0]

    def ranks(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Average rank of each row in each replicate, less the replicate's mean rank; of this task's range."""
        return self.edges[TaskContext.get().partitionId()][0] + self.above(v, w) / 2 - (self.total + 1) / 2

    def above(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Twice what each row's average rank in each replicate exceeds the weight before the range by: whole numbers."""
        _, tied, later = self.edges[TaskContext.get().partitionId()]
        new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        size = np.add.reduceat(w, new, axis=0)
        start = np.concatenate([np.zeros((1, w.shape[1])), np.cumsum(size, axis=0)[:-1]])
        start[1:] += tied
        size[0] += tied
        size[-1] += later
        return np.repeat(2 * start + size + 1, np.diff(np.append(new, len(v))), axis=0)


def _held(batches: Iterator[pa.RecordBatch], columns: Sequence[int], replicates: int) -> list[np.ndarray]:
    """Columns of a whole range: numbers as they are, packed vectors as matrices."""
    parts: list[list] = [[] for _ in columns]
    for batch in batches:
        for held, k in zip(parts, columns, strict=True):
            column = batch.column(k)
            if pa.types.is_binary(column.type):
                held.append(_wide(column.to_pylist(), replicates))
            else:
                held.append(column.to_numpy(zero_copy_only=False))
    return [np.concatenate(p) if p else np.zeros(0) for p in parts]


def _with_ranks(rows: DataFrame, value: Column, name: str, parts: int, replicates: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``rows`` with a packed vector ``name`` of the ranks of ``value`` above the start of the range ``name``_at, and for each range what to add to
    half of it for the rank less the replicate's mean rank."""
    ordered = _Sorted(rows, value, parts, replicates)
    v_at, w_at, keep = ordered.at("v"), ordered.at("w"), len(ordered.columns)
    shared = rows.sparkSession.sparkContext.broadcast((ordered.edges, ordered.total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        v, w = _held(iter(held), (v_at, w_at), replicates)
        state = _Sorted.__new__(_Sorted)
        state.edges, state.total = shared.value
        above, begin, part = state.above(v, w), 0, TaskContext.get().partitionId()
        for batch in held:
            own = above[begin : begin + batch.num_rows]
            begin += batch.num_rows
            added = [pa.array([_small(r) for r in own], pa.binary()), pa.array(np.full(len(own), part, np.int32))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(keep)], *added], [*ordered_columns, name, f"{name}_at"])

    ordered_columns = list(ordered.columns)
    schema = StructType([*rows.schema.fields, StructField(name, BinaryType()), StructField(f"{name}_at", IntegerType())])
    starts = {part: below - (ordered.total + 1) / 2 for part, (below, _, _) in ordered.edges.items()}
    return ordered.rows.mapInArrow(run, schema), starts


def rank_correlations(rows: DataFrame, multipliers: Sequence[float], fraction: float, replicates: int) -> np.ndarray:
    """Spearman of (oracle, observable) with the outcome at each multiplier, in each replicate: array (2, multipliers, replicates).

    ``rows``: o, i, e and w. Two sorts rank o and i; one sort per multiplier ranks the outcome and sums the products as it goes.
    The sorted rows of a multiplier are dropped before the next.
    """
    parts = max(1, -(-rows.count() // ROWS))
    ranked, at_o = _with_ranks(rows.select("o", "i", "e", "w"), F.col("o"), "ro", parts, replicates)
    ranked, at_i = _with_ranks(ranked, F.col("i"), "ri", parts, replicates)
    ranked = stored(ranked.drop("o"))
    starts = rows.sparkSession.sparkContext.broadcast((at_o, at_i))
    out = np.full((2, len(multipliers), replicates), np.nan)
    for k, m in enumerate(multipliers):
        release(rows.sparkSession)
        ordered = _Sorted(ranked, F.col("e") + F.lit(fraction * float(m)) * F.col("i"), parts, replicates)
        at = [ordered.at(c) for c in ("v", "w", "ro", "ro_at", "ri", "ri_at")]
        shared = rows.sparkSession.sparkContext.broadcast((ordered.edges, ordered.total))

        def products(batches: Iterator[pa.RecordBatch], at=at, shared=shared) -> Iterator[pa.RecordBatch]:
            v, w, ro, ro_at, ri, ri_at = _held(batches, at, replicates)
            if len(v):
                state = _Sorted.__new__(_Sorted)
                state.edges, state.total = shared.value
                ry = state.ranks(v, w)
                for rank, where, begin in ((ro, ro_at, starts.value[0]), (ri, ri_at, starts.value[1])):
                    rank /= 2
                    for part in np.unique(where):
                        rank[where == part] += begin[int(part)]
                sums = [(w * a * b).sum(axis=0) for a, b in ((ri, ry), (ro, ry), (ri, ri), (ro, ro), (ry, ry))]
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(sums).tobytes()], pa.binary())], ["sums"])

        parts_of = ordered.rows.mapInArrow(products, "sums binary")
        total = summed(parts_of, parts > 16, lambda row: {0: np.frombuffer(row[0])})[0].reshape(5, replicates)
        del ordered, parts_of
        with np.errstate(divide="ignore", invalid="ignore"):
            out[0, k] = total[0] / np.sqrt(total[2] * total[4])
            out[1, k] = total[1] / np.sqrt(total[3] * total[4])
    return out


def bootstrap(base: DataFrame, numbered: DataFrame, clusters: int, multipliers: Sequence[float], replicates: int, seed: int, fraction: float) -> list[tuple]:
    """(kind, multiplier, detection rate, median slope, median rank correlation) of every line.

    ``base``: cluster, o (observable), i (injected), e (outcome without the injection); ``numbered``: idx, cluster and its moments.
    """
    multipliers = [float(m) for m in multipliers]
    taken = drawn(numbered, clusters, replicates, seed)
    lines = [("null", 0.0), *[(k, m) for m in multipliers for k in ("oracle", "observable")]]
    slope, t = slopes(taken, lines, fraction, replicates, clusters)
    narrow = taken.select("cluster", "w").mapInArrow(_narrow, taken.select("cluster", "w").schema)
    rows = stored(base.join(narrow, "cluster").select("o", "i", "e", "w"))
    ic = rank_correlations(rows, multipliers, fraction, replicates)
    out = []
    for k, (kind, m) in enumerate(lines):
        fitted = np.isfinite(slope[k])
        hit = [s > 0 and (not np.isfinite(v) or student_two_sided(v, clusters - 1) < 0.05) for s, v in zip(slope[k][fitted], t[k][fitted], strict=True)]
        rank = None
        if kind != "null":
            found = ic[0 if kind == "oracle" else 1, multipliers.index(m)]
            found = found[np.isfinite(found)]
            rank = float(np.median(found)) if len(found) else None
        out.append((kind, m, float(np.mean(hit)) if len(hit) else None, float(np.median(slope[k][fitted])) if fitted.any() else None, rank, replicates))
    return out
