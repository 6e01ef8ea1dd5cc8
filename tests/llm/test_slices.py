"""Texts are unpacked in slices of bounded bytes, however many rows a batch has."""

import pyarrow as pa
import zstandard

from pitscape.llm.common import unpacked


def test_slices_are_bounded_in_bytes_and_lose_nothing():
    texts = [b"x" * (1000 * (i % 7)) for i in range(300)] + [b"y" * 50_000, b""]
    pack = zstandard.ZstdCompressor(level=1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([pack.compress(t) for t in texts], pa.binary())], ["doc_id", "packed"])
    found = list(unpacked(batch, 1, 10_000))
    assert [i for part, _ in found for i in part.column(0).to_pylist()] == list(range(len(texts)))
    assert [t for _, held in found for t in held] == texts
    assert all(sum(map(len, held[:-1])) < 10_000 for _, held in found)
