"""Language of texts: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased, everything in ASCII but letters becomes a blank, and its subwords are the strings of ``WIDTHS`` bytes that lie in a word
with one blank on either side. Each is hashed to a row of an embedding table; the mean of the rows goes through a linear layer and a softmax. Table
and layer are trained together by stochastic gradient descent in numpy, one text (or a snippet of it) a step. As the layer is linear, a prediction
needs only the layer's answer per bucket, averaged over the text: one pass over the documents without exchange, in windows of bounded size.

A temperature, fitted on texts that the descent has not seen, turns answers into calibrated probabilities, and the smallest threshold at which the
accepted ones of these texts and of their snippets are right with a share of ``PRECISION`` decides ``accepted``; a prediction below it is returned but rejected.

Bounded sample (the only rows that reach the driver): of each language at most ``per_language`` different texts, in the order of a hash, of at most
``sample_bytes`` bytes. The number of languages is taken to be small (hundreds), as it multiplies the sample.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is every text if nothing can be learned from; with one language only it
has score 1; a null ``lang`` is never learned, an empty one is a language like others; rows with a null or repeated id are predicted row by row and never
learned from if the id is null; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscape.llm.common import chunks, columns, mix, small_batches

WIDTHS = (2, 3, 4)
BUCKETS, SIZE, EPOCHS, RATE, SEED = 2**15, 16, 4, 0.5, 13
#: Share of the sample that calibrates, and of right answers asked of those accepted.
HELD, PRECISION = 0.25, 0.99
#: Bytes looked at at a time.
WINDOW = 262_144
UNKNOWN = "und"
_U = np.uint64
_BLANK = 32
_CLASS = np.full(256, _BLANK, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Model:
    """``answers``: what the linear layer says of each bucket (buckets x languages)."""

    languages: tuple[str, ...]
    answers: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _subwords(data: np.ndarray, first: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (from ``first`` on) and buckets of the subwords that begin in ``data``, width by width."""
    letter = data != _BLANK
    for width in WIDTHS:
        n = len(data) - width + 1
        if n <= 0:
            continue
        inside = np.ones(n, bool)
        for k in range(1, width - 1):
            inside &= letter[k : k + n]
        if width == 2:  # no byte in the middle to look at
            inside &= letter[:n] | letter[1 : n + 1]
        at = np.flatnonzero(inside)
        h = np.full(len(at), width, np.uint64)
        for k in range(width):
            h = h << _U(8) | data[at + k]
        yield at + first, (mix(h) & _U(buckets - 1)).astype(np.int64)


def windows(texts: list[bytes], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every subword of some texts, a window at a time."""
    ends = np.cumsum([len(t) + 2 for t in texts])
    data = _CLASS[np.frombuffer(b"".join(b" %s " % t for t in texts), np.uint8)]
    widest = max(WIDTHS)
    for begin in range(0, len(data), WINDOW):
        for at, bucket in _subwords(data[begin : begin + WINDOW + widest - 1], begin, buckets):
            own = at < begin + WINDOW
            at, bucket = at[own], bucket[own]
            text = np.searchsorted(ends, at, "right")
            # two blanks part the texts, so that no subword with a letter touches two
            yield text, bucket


def _counts(text: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text and their shares."""
    found = [b for _, b in windows([text], buckets)]
    bucket, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return bucket, count / max(1, count.sum())


def _snippet(text: bytes, rnd: np.random.Generator) -> bytes:
    """A few words from somewhere in the text."""
    words = text.split()
    if len(words) < 2:
        return text
    n = int(rnd.integers(1, min(24, len(words)) + 1))
    at = int(rnd.integers(0, len(words) - n + 1))
    return b" ".join(words[at : at + n])


def descend(texts: list[bytes], classes: np.ndarray, languages: int, buckets: int = BUCKETS, size: int = SIZE, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Embedding answers (buckets x languages) and bias after stochastic gradient descent; whole texts and snippets take turns."""
    rnd = np.random.default_rng(SEED)
    table = rnd.uniform(-1.0, 1.0, (buckets, size)) / size
    layer, bias = np.zeros((size, languages)), np.zeros(languages)
    whole = [_counts(t, buckets) for t in texts]
    steps, done = 2 * epochs * len(texts), 0
    for _ in range(epochs):
        for i in rnd.permutation(len(texts)):
            for bucket, share in (whole[i], _counts(_snippet(texts[i], rnd), buckets)):
                step = rate * (1 - done / steps)
                done += 1
                if not len(bucket):
                    continue
                mean = share @ table[bucket]
                z = mean @ layer + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[classes[i]] -= 1
                back = layer @ p
                layer -= step * np.outer(mean, p)
                bias -= step * 0.1 * p
                # shares are small, so that the table's rows learn by the share's root
                table[bucket] -= step * np.sqrt(share)[:, None] * back
    return table @ layer, bias


def logits(texts: list[bytes], answers: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Mean answer of each text (texts x languages)."""
    total, count = np.zeros((len(texts), answers.shape[1])), np.zeros(len(texts))
    for text, bucket in windows(texts, len(answers)):
        count += np.bincount(text, minlength=len(texts))
        found = answers[bucket]
        for k in range(answers.shape[1]):
            total[:, k] += np.bincount(text, found[:, k], len(texts))
    return total / np.maximum(count, 1)[:, None] + bias


def _probabilities(z: np.ndarray, temperature: float) -> np.ndarray:
    z = z / temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def calibrate(z: np.ndarray, classes: np.ndarray) -> tuple[float, float]:
    """Temperature of the least log loss, and the smallest threshold whose accepted answers are right often enough."""
    loss = lambda t: -np.log(np.maximum(_probabilities(z, t)[np.arange(len(z)), classes], 1e-12)).mean()
    grid = np.geomspace(0.05, 20, 81)
    temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    p = _probabilities(z, temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == classes
    order = np.argsort(-top, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    last = np.concatenate([top[order][1:] < top[order][:-1], [True]])  # equal scores are accepted together
    good = np.flatnonzero((share >= PRECISION) & last)
    return temperature, float(top[order][good[-1]]) if len(good) else 1.0


def learnable(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return docs.where(F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(5)) != 0)


def sample(docs: DataFrame, per_language: int, sample_bytes: int) -> list[tuple[str, int, str]]:
    """(lang, hash, text) of at most ``per_language`` different texts of each language, by a hash threshold from approximate counts.

    Equal texts meet before the exchange, so that a text that a third of all rows repeat is one row; no group is sorted as a whole.
    """
    h = F.xxhash64("text")
    rows = columns(docs, "lang", "text").where(F.col("lang").isNotNull() & (F.octet_length("text") <= sample_bytes) & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", h.alias("h"), "text")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    below = F.when(F.col("n") <= 2 * per_language, F.lit(2.0**63)).otherwise((4.0 * per_language / F.col("n") - 1) * 2.0**63)
    chosen = rows.join(F.broadcast(counts.select("lang", below.alias("below"))), "lang").where(F.col("h").cast("double") <= F.col("below"))  # a row a language
    chosen = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))
    held: dict[str, list] = {}
    for r in chosen.collect():  # about 2 * per_language rows a language
        held.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return [(lang, *t) for lang in sorted(held) for t in sorted(held[lang])[:per_language]]


def fit(docs: DataFrame, per_language: int = 400, sample_bytes: int = 16_384) -> Model | None:
    """A model from (text, lang); None if there is nothing to learn from."""
    rows = sample(docs, per_language, sample_bytes)
    languages = tuple(sorted({r[0] for r in rows}))
    if not languages:
        return None
    if len(languages) == 1:
        return Model(languages, np.zeros((1, 1)), np.zeros(1), 1.0, 0.0)
    texts = [r[2].lower().encode() for r in rows]
    classes = np.array([languages.index(r[0]) for r in rows])
    place = np.concatenate([np.arange(n) for n in np.bincount(classes)])  # rows come language by language
    held = (place % round(1 / HELD)) == 1
    train = [t for t, k in zip(texts, held, strict=True) if not k]
    answers, bias = descend(train, classes[~held], len(languages))
    rnd = np.random.default_rng(SEED + 1)
    kept, own = ([t for t, k in zip(texts, held, strict=True) if k], classes[held]) if held.any() else (train, classes)
    z = logits([*kept, *[_snippet(t, rnd) for t in kept]], answers, bias)
    return Model(languages, answers, bias, *calibrate(z, np.concatenate([own, own])))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, accepted of every row, by one pass without exchange."""
    small_batches(docs.sparkSession)
    kept = columns(docs, "doc_id", "text").withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        return kept.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    kept = kept.select("doc_id", "letters", F.lower("text").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, texts in chunks(batches, "text"):
            p = _probabilities(logits(texts, m.answers, m.bias), m.temperature)
            letters = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            best = p.argmax(axis=1)
            score = np.where(letters, p[np.arange(len(p)), best], 0.0)
            names = [m.languages[k] if good else UNKNOWN for k, good in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(score), pa.array(letters & (score >= m.threshold))], ["doc_id", "lang_pred", "score", "accepted"])

    return kept.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def predicted_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row of ``docs``."""
    out = predict(docs, fit(learnable(docs)))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
