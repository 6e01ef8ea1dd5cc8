"""Quality by compression: zstandard dictionaries of good and of bad texts, one calibrated score.

A dictionary trained on good texts makes good texts smaller than one trained on bad
texts does, and the other way round. Each class has ``PARTS`` dictionaries of disjoint parts of its sample
and counts with the mean of their sizes, which steadies them. The normalised difference of the two sizes, with
how far the text shrinks at all, is turned into a probability by a logistic fit on
labelled texts that the dictionaries have not seen.

Bounded sample (the only rows that reach the driver): at most ``per_class`` labelled rows
of each class, in the order of a hash of the id, whose text is at most ``sample_bytes``
long; even places train the dictionaries, odd ones the calibration. Class weights come
from the counts over all usable labels.

Defined cases: a null text counts as empty and gets a score like any other; rows with a null
or repeated id are scored row by row; a label that is neither 0 nor 1 is ignored, of several
labels of one id the smaller counts; without labels of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscape.llm.common import chunks, columns


#: Dictionaries of a class.
PARTS = 4


@dataclass(frozen=True)
class Model:
    """Everything a task needs; about 2 * PARTS * ``dict_bytes`` in size, whatever the corpus is."""

    good: tuple[bytes, ...]
    bad: tuple[bytes, ...]
    weights: tuple[float, ...] | None
    level: int


def _compressor(dictionary: bytes | None, level: int) -> zstandard.ZstdCompressor:
    kwargs = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False, **kwargs)


def _features(texts: list[bytes], model: Model) -> np.ndarray:
    packs = [_compressor(d, model.level) for d in (*model.good, *model.bad, None)]
    sizes = np.array([[len(p.compress(t)) for p in packs] + [len(t)] for t in texts], float).reshape(len(texts), -1)
    good, bad = sizes[:, : len(model.good)].mean(axis=1), sizes[:, len(model.good) : -2].mean(axis=1)
    plain, raw = sizes[:, -2], sizes[:, -1]
    return np.column_stack(
        [(good - bad) / (good + bad), np.log((np.minimum(good, bad) + 8) / (raw + 8)), np.log((plain + 8) / (raw + 8)), np.ones(len(raw))]
    )


def _dictionary(texts: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: the texts themselves, as raw content
        return (b"\n".join(texts) + b" " * 8)[-size:]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, sample_bytes: int = 65_536, dict_bytes: int = 65_536, level: int = 3) -> Model:
    """Dictionaries and calibration from (doc_id, quality) labels; see the module for the bounds."""
    usable = columns(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = columns(docs, "doc_id", "text").where(F.octet_length("text") <= sample_bytes)
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    order = F.xxhash64("doc_id")
    half = {}
    for quality in (0, 1):
        ids = usable.where(F.col("quality") == quality).orderBy(order, "doc_id").limit(per_class)
        rows = texts.join(F.broadcast(ids), "doc_id").select("doc_id", order.alias("h"), "text").collect()  # at most per_class ids
        rows.sort(key=lambda r: (r["h"], r["doc_id"], r["text"]))
        held = [r["text"].encode() for r in rows]
        half[quality] = held[::2], held[1::2]
    if not all(half[q][k] for q in (0, 1) for k in (0, 1)):
        return Model((), (), None, level)
    parts = [tuple(_dictionary(half[q][0][k::PARTS], dict_bytes) for k in range(min(PARTS, len(half[q][0])))) for q in (1, 0)]
    model = Model(*parts, None, level)
    x = np.vstack([_features(half[q][1], model) for q in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(half[0][1]), len(half[1][1])])
    weight = np.where(y == 1, counts[1] / len(half[1][1]), counts[0] / len(half[0][1]))
    weight *= len(y) / weight.sum()
    beta = np.zeros(x.shape[1])
    ridge = 1e-6 * np.eye(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta += step * min(1.0, 20.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.good, model.bad, tuple(beta), level)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row and ``score``, 0 to 1, by one pass without exchange."""
    keep = docs.columns if keep is None else keep
    kept = columns(docs, *dict.fromkeys([*keep, "text"]))
    shape = columns(docs, *keep).schema.add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, texts in chunks(batches, "text"):
            if m.weights is None:
                s = np.full(len(texts), 0.5)
            else:
                s = 1 / (1 + np.exp(-np.clip(_features(texts, m) @ np.array(m.weights), -35, 35)))
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(s, pa.float64())], [*keep, "score"])

    return kept.mapInArrow(run, shape)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(F.pmod(F.crc32(labels["doc_id"].cast("string").cast("binary")), F.lit(3)) != 1)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = fit(docs, learnable(labels))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return score(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is at least one half, with their columns."""
    model = fit(docs, learnable(labels))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")
    back = score(plain.withColumnRenamed(f"c{at}", "text"), model).where("score >= 0.5")
    return back.select(*[F.col("text" if i == at else f"c{i}").alias(n) for i, n in enumerate(names)])
