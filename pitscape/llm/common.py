"""Helpers that several operators share: working tables, text hashing, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscape.session import checkpoint_folder, cut, release

__all__ = ["cut", "saved", "columns", "Words", "chunks", "mix", "doc_sets", "components", "packed_text", "unpack", "unpacked", "release", "tasks_for"]

#: Text bytes that a task holds as arrays at a time; longer single texts are still taken whole.
CHUNK = 1_000_000
BATCH_ROWS = 500
_U = np.uint64


def saved(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; ``codec``: its compression, if not the session's.

    Cuts the lineage like a checkpoint, keeps columns prunable, and tells the
    planner the true size, so that small tables are broadcast by Spark's own check.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra ones, whatever they are called, never meet ours."""
    return df.select(*[df[f"`{n}`"] for n in names])


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for a keyed exchange: the session's number, or more where rows ask for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def small_batches(spark: SparkSession) -> None:
    """Rows of texts and of packed arrays are long, so that few of them make a batch for Python; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


# --- texts as arrays ------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE[_LOWER]
_SALT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of a well-known mixer)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int) -> np.ndarray:
    """_BASE ** 0 .. n-1, modulo 2**64."""
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts, lower-cased A-Z, as 64-bit hashes.

    ``hash``: one per word; ``first``: for text i its words are first[i]:first[i+1].
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        word = ~_SPACE[data]
        starts, ends = word.copy(), word.copy()
        if len(data):
            edge = at[:-1][(sizes > 0)]
            begins = np.zeros(len(data), bool)
            begins[edge] = True
            starts[1:] &= ~word[:-1] | begins[1:]
            ends[:-1] &= ~word[1:] | begins[1:]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.start, self.end, self.offset = s, e, at
        self.first = np.searchsorted(s, at)
        if len(s):
            inside = np.flatnonzero(word)
            length = e - s
            place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
            value = _BYTE_LOWER[data[inside]] * powers(int(length.max()))[place]
            self.hash = mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def grams(self, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each word on; meaningless where a text ends before."""
        n = max(0, len(self.hash) - width + 1)
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out += self.hash[k : k + n] * _SALT[k]
        return mix(out)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text each, and their texts (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            column = column.cast(pa.large_binary())
        begin, size, held = 0, 0, []
        for i, value in enumerate(column):
            held.append(value.as_py() or b"")
            size += len(held[-1])
            if size >= limit:
                yield batch.slice(begin, i + 1 - begin), held
                begin, size, held = i + 1, 0, []
        if held:
            yield batch.slice(begin), held


def doc_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``width`` words, ascending; shorter texts are one shingle."""
    w = Words(texts)
    grams = w.grams(width)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= width:
            g = np.sort(grams[a : b - width + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            own = w.hash[a:b]
            out.append(mix((own * _SALT[32 : 32 + b - a]).sum(keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for part, texts in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index("doc_id")), pa.array([pack.compress(t) for t in texts], pa.binary())], ["doc_id", "packed"]
        )


def packed_text(docs: DataFrame) -> DataFrame:
    """doc_id and the text compressed, for exchanges that must carry texts; null ids are left out."""
    small_batches(docs.sparkSession)
    return columns(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(_squeeze, "doc_id long, packed binary")


def unpack(values: Iterable) -> list[bytes]:
    read = zstandard.ZstdDecompressor()
    return [read.decompress(v.as_py() if hasattr(v, "as_py") else v) for v in values]


def unpacked(batch: pa.RecordBatch, column: int, limit: int = CHUNK // 4) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batch with about ``limit`` bytes of unpacked text each, and the texts of ``column``."""
    read = zstandard.ZstdDecompressor()
    begin, size, held = 0, 0, []
    for i, value in enumerate(batch.column(column)):
        held.append(read.decompress(value.as_py()))
        size += len(held[-1])
        if size >= limit:
            yield batch.slice(begin, i + 1 - begin), held
            begin, size, held = i + 1, 0, []
    if held:
        yield batch.slice(begin), held


# --- connected components -------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable by edges (a, b), for every id in an edge.

    Min-label propagation with a jump to the label's label in every round, so that
    rounds grow with the logarithm of the longest chain. Each round's labels are a
    written table; nothing but the number of changes reaches the driver.
    """
    both = saved(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    label = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")))
    while True:
        heard = (
            both.join(label.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("heard"))
        )
        # what an id tells its label: the label's own label may be lower by now
        told = (
            label.join(heard, "id")
            .where("heard < component")
            .groupBy(F.col("component").alias("id"))
            .agg(F.min("heard").alias("told"))
        )
        step = (
            label.join(heard, "id")
            .join(told, "id", "left")
            .select("id", F.least("component", "heard", F.coalesce("told", "component")).alias("component"), F.col("component").alias("old"))
        )
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = saved(
            step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component"), "old")
        )
        if new.where("component <> old").isEmpty():
            return new.select("id", "component")
        label = new.select("id", "component")

