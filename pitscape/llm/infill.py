"""Fill-in-the-middle texts by secondary-sort assembly.

A text is cut into units (``[A-Za-z]+|[^A-Za-z]``), two hashed cuts part it into prefix, middle and suffix, and a hashed
form says in which order they are written behind their marks. No task ever joins a text by itself: the first pass emits
*pieces*, some whole units each, keyed by document and place in the output. The pieces are dealt out by document and
sorted by place inside each partition (``repartition`` and ``sortWithinPartitions``, the DataFrame form of
repartitionAndSortWithinPartitions), and a document's pieces then stream through one digest, whatever its length. For the way back the same
stream is parted at its marks, the parts are sorted once more, now by their place in the text, and stream through a second digest.
The second sort stays in the partition of the first, so that the texts move once, compressed.

A document's key is its id, a digest of its text and the map task that read it, so that rows which repeat an id, or have
none, are never mixed up and a hot one is spread over as many keys as tasks read it; equal rows of one slice of a task travel once, with a count.

Defined cases: a null text counts as empty; an empty text and one that contains a mark are ``plain`` (null lengths, 0 is never hashed);
a null id is hashed as if it were empty digits; rows with a null or repeated id are transformed row by row; extra columns, whatever
their names, are left out; an empty table gives an empty result. A unit longer than a piece is spread over several pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscape.llm.common import chunks, columns, small_batches, tasks_for

#: Bytes of a piece, and of the text that a partition of pieces is meant to hold.
PIECE, PARTITION = 32_768, 32_000_000
#: Segments in the order of the text, and how each form writes them.
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
FORMS = {"psm": ((b"<P>", PREFIX), (b"<S>", SUFFIX), (b"<M>", MIDDLE)), "spm": ((b"<S>", SUFFIX), (b"<P>", PREFIX), (b"<M>", MIDDLE))}
_MARK = re.compile(b"<[PSM]>")
_SEGMENT = {b"<P>": PREFIX, b"<S>": SUFFIX, b"<M>": MIDDLE}
_KEY = ["doc_id", "digest", "part"]
_HEAD = ["n", "form", "prefix_chars", "middle_chars", "times"]
_PIECES = "doc_id long, digest binary, part int, position long, payload binary, n long, form string, prefix_chars long, middle_chars long, times long"
_BACK = "doc_id long, digest binary, part int, segment int, position long, payload binary, n long, form string, prefix_chars long, middle_chars long, times long, output_sha256 string"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class _Batch:
    """Rows gathered until they make a batch; ``schema``: names and types as Spark writes them."""

    TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}

    def __init__(self, schema: str, size: int = 4_000_000):
        fields = [f.split() for f in schema.split(", ")]
        self.names, self.types = [f[0] for f in fields], [self.TYPES[f[1]] for f in fields]
        self.size, self.rows, self.held = size, [], 0

    def add(self, row: tuple, weight: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += weight + 200
        if self.held >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), self.types, strict=True)], self.names)
        self.rows, self.held = [], 0


def _ends(starts: np.ndarray, points: np.ndarray, begin: int, end: int, size: int) -> list[int]:
    """Where the pieces of bytes begin:end end: at a unit's start, or inside a longer unit at a code point's."""
    ends, at = [], begin
    while end - at > size:
        k = np.searchsorted(starts, at + size, "right") - 1
        if starts[k] <= at:
            at = int(points[np.searchsorted(points, at + size, "right") - 1])
        else:
            at = int(starts[k])
        ends.append(at)
    return [*ends, end]


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False)
        out = _Batch(_PIECES)
        for batch, texts in chunks(batches, "text"):
            parts = batch.column(batch.schema.get_field_index("part")).to_pylist()
            times: dict[tuple, int] = {}
            for doc, part, text in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), parts, texts, strict=True):
                times[doc, part, text] = times.get((doc, part, text), 0) + 1
            for (doc, part, text), count in times.items():
                key = doc, hashlib.sha256(text).digest()[:16], part
                h1, h2, h3, h4 = np.frombuffer(hashlib.sha256(b"1:%s" % (b"" if doc is None else b"%d" % doc)).digest()[:16], ">u4").tolist()
                data = np.frombuffer(text, np.uint8)
                letter, point = _LETTER[data], (data & 0xC0) != 0x80
                start = point.copy()
                start[1:] &= ~(letter[1:] & letter[:-1])
                units, points = np.flatnonzero(start), np.flatnonzero(point)
                n = len(units)
                form = "plain" if not text or _MARK.search(text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
                if form == "plain":
                    head, segments = (n, form, None, None, count), [(b"", 0, len(text))]
                else:
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = (int(units[k]) if k < n else len(text) for k in (low, high))
                    chars = np.searchsorted(points, [a, b]).tolist()
                    head = (n, form, chars[0], chars[1] - chars[0], count)
                    span = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
                    segments = [(mark, *span[s]) for mark, s in FORMS[form]]
                position = 0
                for mark, begin, end in segments:
                    for to in _ends(units, points, begin, end, size):
                        payload = pack.compress(mark + text[begin:to])
                        yield from out.add((*key, position, payload, *(head if not position else (None,) * 5)), len(payload))
                        mark, begin, position = b"", to, position + 1
        yield from out.flush()

    return run


def pieces(docs: DataFrame, size: int = PIECE) -> DataFrame:
    """Pieces of every output, dealt out by document and sorted by ``position``; ``payload`` is compressed by zstd.

    The first piece of an output carries its form, lengths in code points, number of units and of equal rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = columns(docs, "text").agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    cut = columns(docs, "doc_id", "text").withColumn("part", F.spark_partition_id()).mapInArrow(_cut(size), _PIECES)
    return cut.repartition(tasks_for(spark, total, PARTITION), *_KEY).sortWithinPartitions(*_KEY, "position")


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list, Iterator[bytes]]]:
    """Key, head and stream of payloads of every output of a sorted partition; the head's count is whole once the stream has ended."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    unpack, held = zstandard.ZstdDecompressor(), next(rows, None)

    def stream(key: tuple, head: list) -> Iterator[bytes]:
        nonlocal held
        last = 0
        yield unpack.decompress(held[4])
        while (held := next(rows, None)) is not None and held[:3] == key:
            if held[3] == 0:  # the same row, from another slice of its task
                head[4] += held[9]
            elif held[3] != last:
                last = held[3]
                yield unpack.decompress(held[4])

    while held is not None:
        key, head = held[:3], list(held[5:])
        flow = stream(key, head)
        yield key, head, flow
        for _ in flow:
            pass


def _parted(flow: Iterator[bytes], form: str) -> Iterator[tuple[int, bytes]]:
    """(segment, bytes) of an output that arrives in pieces; a mark may lie across two of them."""
    segment, rest = PREFIX, b""
    for data in flow:
        if form == "plain":
            yield segment, data
            continue
        data, at = rest + data, 0
        for mark in _MARK.finditer(data):
            yield segment, data[at : mark.start()]
            segment, at = _SEGMENT[mark.group()], mark.end()
        open_at = data.rfind(b"<", max(at, len(data) - 2))
        end = open_at if open_at >= 0 else len(data)
        yield segment, data[at:end]
        rest = data[end:]
    yield segment, rest


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every output, and its parts keyed by their place in the text."""
    out = _Batch(_BACK)
    for key, head, flow in _outputs(batches):
        digest, position = hashlib.sha256(), 0

        def read(flow: Iterator[bytes], digest=digest) -> Iterator[bytes]:
            for data in flow:
                digest.update(data)
                yield data

        for segment, data in _parted(read(flow), head[1]):
            if data:
                yield from out.add((*key, segment, position, data, *(None,) * 6), len(data))
                position += 1
        yield from out.add((*key, -1, 0, None, *head, digest.hexdigest()))
    yield from out.flush()


_DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, head, digest = _Batch(_DIGESTS), None, None
    done = lambda: ((head[0], *head[6:10], head[11], digest.hexdigest()) for _ in range(head[10]))
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[3] == -1:
                if head:
                    for r in done():
                        yield from out.add(r)
                head, digest = row, hashlib.sha256()
            else:
                digest.update(row[5])
    if head:
        for r in done():
            yield from out.add(r)
    yield from out.flush()


def digests(docs: DataFrame, size: int = PIECE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of the text restored from it, of every row."""
    back = pieces(docs, size).mapInArrow(_digested, _BACK).sortWithinPartitions(*_KEY, "segment", "position")
    return back.mapInArrow(_restored, _DIGESTS)


_ASSEMBLED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Batch(_ASSEMBLED)
    for key, head, flow in _outputs(batches):
        text = b"".join(flow)
        for _ in range(head[4]):
            yield from out.add((key[0], *head[:4], text.decode()), len(text))
    yield from out.flush()


def assembled(docs: DataFrame, size: int = PIECE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and ``output``, the text to train on, of every row."""
    return pieces(docs, size).mapInArrow(_joined, _ASSEMBLED)


def restored(form: Column, output: Column) -> Column:
    """The text that an output of ``assembled`` was made from."""
    part = F.split(output, "<[PSM]>")
    swapped = F.when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(swapped)


ORACLE = """
with d as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as unit,
        sha256('1:' || doc_id) as h
    from documents
), g as (
    select *, len(unit)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
        ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4
    from d
), f as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
            when h4 % 100 < 20 then 'spm' else 'psm' end as form
    from g
), s as (
    select *, array_to_string(unit[1:low], '') as prefix, array_to_string(unit[low + 1:high], '') as middle,
        array_to_string(unit[high + 1:], '') as suffix
    from f
)
select doc_id, n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars,
    case when form <> 'plain' then length(middle)::bigint end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(text) as restored_sha256
from s
"""
