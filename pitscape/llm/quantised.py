"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Directions are collapsed first: rows with equal vectors are one class, however many there are. Every vector length has
codes of its own. On a bounded sample of its classes rotations are learned that make the signs of the rotated, centred vectors
balanced binary codes (alternating sign codes and the orthogonal Procrustes solution). The codes of all rotations, one
behind the other, are cut into substrings of equal length, one table each; classes that agree in a substring meet in its
table, and pairs whose first ``CHECK`` bits are near are compared by the original vectors in double precision.

Substrings grow with the logarithm of the number of classes, so that the entries of a bucket stay about constant.
Rotations are added until ``RECALL`` of partners planted at exactly the cosine asked for are found; where ``MOST_BITS`` do not
reach it, or fewer than 8 sample rows a dimension leave nothing to learn, rotations are random ones, and substrings get shorter until they do. So recall does not depend on the size of the table or the vectors' length.
A pair that agrees in one of the first substrings is passed on by the first such table alone. Buckets have no cap: where a
sample shows many entries, the bucket's meeting is cut into parts of bounded size.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing and are their own component; vectors of different lengths never link; rows with a null id are left out of the links and returned with 0 links
and a null component; an empty table gives an empty result. Repeated ids with equal vectors count as one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscape.llm.common import columns, components, saved

COSINE = 0.9
SAMPLE, PLANTED, ROUNDS = 5000, 2000, 30
RECALL, CHECK, MOST_BITS, MOST_A_ROTATION = 0.97, 64, 4096, 512
#: Entries of a bucket that meet in one part; one class of SHARE is counted to find larger buckets.
PART, SHARE = 2048, 8


def learn(sample: np.ndarray, bits: int, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) of iterative quantisation; without rounds a random rotation of the uncentred rows."""
    mean = sample.mean(axis=0) if rounds else np.zeros(sample.shape[1])
    x = sample - mean
    values, vectors = np.linalg.eigh(x.T @ x)
    project = vectors[:, ::-1][:, :bits]
    v = x @ project
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        code = np.where(v @ turn >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(code.T @ v)
        turn = (u @ w).T
    return mean, project @ turn


def unit_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, rep) of usable rows, and (rep, v): one row per distinct vector, scaled to length one."""
    v = columns(vectors, "vec_id", "embedding").where("vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    fine = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    v = v.where(~F.coalesce(fine, F.lit(True)) & (F.size("v") > 0)).withColumn("norm", F.sqrt(square)).where("norm > 0 and norm < double('inf')")
    v = v.select("vec_id", F.transform("v", lambda x: x / F.col("norm")).alias("v"), F.xxhash64("v", F.lit(1)).alias("h1"), F.xxhash64("v", F.lit(2)).alias("h2"))
    first = v.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"))
    member = saved(v.select("vec_id", "h1", "h2").distinct().join(first, ["h1", "h2"]).select("vec_id", "rep"))
    reps = v.withColumnRenamed("vec_id", "rep").join(member.where("vec_id = rep").select("rep"), "rep").select("rep", "v").dropDuplicates(["rep"])
    return member, saved(reps)


@dataclass(frozen=True)
class Codes:
    """Codes of one vector length: signs of ``x @ project - bar``, cut into substrings of ``width``; ``near``: check bits that may differ."""

    project: np.ndarray
    bar: np.ndarray
    width: int
    near: int

    def signs(self, x: np.ndarray) -> np.ndarray:
        return x @ self.project >= self.bar

    @property
    def tables(self) -> int:
        return self.project.shape[1] // self.width


def _met(differ: np.ndarray, width: int) -> np.ndarray:
    """Which rows of differing bits have a substring without any."""
    tables = differ.shape[1] // width
    return (~differ[:, : tables * width].reshape(len(differ), tables, width).any(axis=2)).any(axis=1)


def learn_codes(sample: np.ndarray, classes: int, cosine: float = COSINE, recall: float = RECALL) -> Codes:
    """Rotations and substring length that find ``recall`` of the partners planted at ``cosine`` around rows of ``sample``.

    Half of the partners lie in a random direction, half in that of another row.
    """
    rng = np.random.default_rng(11)
    dims = sample.shape[1]
    width = min(48, max(8, math.ceil(math.log2(max(classes, 2)))))
    x = sample[rng.integers(0, len(sample), PLANTED)]
    aside = np.where(np.arange(PLANTED)[:, None] % 2 == 0, rng.standard_normal((PLANTED, dims)), sample[rng.integers(0, len(sample), PLANTED)])
    aside += 1e-9 * rng.standard_normal((PLANTED, dims))
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * aside / np.where(size > 0, size, 1.0)
    bits = min(dims, MOST_A_ROTATION)
    learned = len(sample) >= 8 * dims
    parts, bars, differs = [], [], []
    while True:
        # in few dimensions the solution is nearly unique: fewer rounds keep the rotations different
        mean, project = learn(sample, bits, len(parts), (ROUNDS if dims >= 8 else 2) if learned else 0)
        parts.append(project)
        bars.append(mean @ project)
        differs.append((x @ project >= bars[-1]) != (y @ project >= bars[-1]))
        made = bits * len(parts)
        enough = made >= MOST_BITS
        if not enough and (made < CHECK or len(parts) % max(1, len(parts) // 8)):
            continue
        differ = np.hstack(differs)
        apart = differ[:, :CHECK].sum(axis=1)
        near = int(np.quantile(apart, 0.999, method="higher"))
        found = _met(differ, width) & (apart <= near)
        if enough and learned and found.mean() < recall:
            learned, parts, bars, differs = False, [], [], []
            continue
        while enough and found.mean() < recall and width > 1:
            width -= 1
            found = _met(differ, width) & (apart <= near)
        if enough or found.mean() >= recall:
            return Codes(np.hstack(parts), np.concatenate(bars), width, near)


def _entries(reps: DataFrame, codes: dict[int, Codes]) -> DataFrame:
    """slot, rep, code and rule (table, substring length, check bits that may differ) per class and table."""
    first, at = {}, 0
    for dims, c in codes.items():
        first[dims], at = at, at + (c.tables << c.width)
    shared = reps.sparkSession.sparkContext.broadcast((codes, first))  # at most MOST_BITS columns a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, first = shared.value
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            values = batch.column(1)
            sizes = values.value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes):
                if int(dims) not in codes:
                    continue
                c = codes[int(dims)]
                keep = pa.array(np.flatnonzero(sizes == dims))
                signs = c.signs(np.array(values.take(keep).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims))
                head = np.pad(signs[:, :CHECK], ((0, 0), (0, CHECK - min(CHECK, signs.shape[1]))))
                whole = np.packbits(head, axis=1).view(">i8").ravel().astype(np.int64)
                weight = 1 << np.arange(c.width, dtype=np.int64)
                keys = signs[:, : c.tables * c.width].reshape(len(keep), c.tables, c.width) @ weight
                table = np.arange(c.tables)
                slots = keys + (first[int(dims)] + (table << c.width))
                rules = (table << 16) | (c.width << 8) | c.near
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slots.ravel()),
                        pa.array(np.repeat(batch.column(0).take(keep).to_numpy(), c.tables)),
                        pa.array(np.repeat(whole, c.tables)),
                        pa.array(np.tile(rules, len(keep)).astype(np.int32)),
                    ],
                    ["slot", "rep", "code", "rule"],
                )

    return reps.select("rep", "v").mapInArrow(run, "slot long, rep long, code long, rule int")


def _meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs a < b of entries in one bucket, near in their check bits, from the first table where those bits show one."""
    sides = [side.withColumnsRenamed({"rep": name, "code": f"code_{name}"}) for side, name in ((left, "a"), (right, "b"))]
    met = sides[0].join(sides[1].drop("rule"), on).where("a < b").withColumn("x", F.expr("code_a ^ code_b"))
    met = met.where("bit_count(x) <= (rule & 255)").withColumn("w", F.expr("shiftright(rule, 8) & 255"))
    steps = " ".join(
        f"when w * {g + 1} <= {CHECK} and (shiftrightunsigned(x, {CHECK} - w * {g + 1}) & (shiftleft(1L, w) - 1)) = 0 then {g}" for g in range(CHECK // 8)
    )
    return met.where(f"coalesce(shiftright(rule, 16) = (case {steps} end), true)").select("a", "b")


def near_pairs(reps: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b), a < b, of classes found with a cosine of at least ``cosine``."""
    spark = reps.sparkSession
    sizes = {r["d"]: r["n"] for r in reps.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("n > 1").collect()}  # a row per length
    if not sizes:
        return spark.createDataFrame([], "a long, b long")
    spread = 1 << 30
    bars = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, min(spread, math.ceil(spread * SAMPLE / n)))])
    some = reps.where(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(spread)) < F.coalesce(bars[F.size("v")], F.lit(0))).select("v").collect()  # about SAMPLE a length
    by_length: dict[int, list] = {}
    for r in some:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    codes = {d: learn_codes(np.array(v), sizes[d], cosine) for d, v in sorted(by_length.items())}
    entries = saved(_entries(reps, codes))
    hot = entries.where(F.pmod(F.xxhash64("rep", F.lit(9)), F.lit(SHARE)) == 0).groupBy("slot").agg(F.count("*").alias("n")).where(f"n > {PART // SHARE}")
    hot = saved(hot.select("slot", F.ceil(F.col("n") * SHARE / PART).cast("int").alias("parts")))
    pairs = _meet(entries.join(hot, "slot", "left_anti"), entries.join(hot, "slot", "left_anti"), ["slot"])
    if not hot.isEmpty():
        busy = entries.join(hot, "slot")
        one = busy.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts")
        every = busy.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        pairs = pairs.union(_meet(one, every, ["slot", "part"]))
    pairs = pairs.distinct()
    left = reps.select(F.col("rep").alias("a"), F.col("v").alias("va"))
    right = reps.select(F.col("rep").alias("b"), F.col("v").alias("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return pairs.join(left, "a").join(right, "b").where((F.size("va") == F.size("vb")) & (dot >= cosine)).select("a", "b")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    member, reps = unit_classes(vectors)
    pairs = saved(near_pairs(reps, cosine))
    sizes = member.groupBy("rep").agg(F.count("*").alias("n"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    links = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    classes = sizes.join(links, "rep", "left").join(components(pairs).withColumnRenamed("id", "rep"), "rep", "left")
    per_class = classes.select("rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    per_row = member.join(per_class, "rep").select(F.col("vec_id").alias("id"), "n_links", "component_id")
    rows = columns(vectors, "vec_id")
    out = rows.join(per_row, rows["vec_id"] == per_row["id"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
