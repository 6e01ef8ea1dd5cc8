"""Exact removal of repeated 100-byte strings by blockwise suffix buckets and cover-sample ranks.

Every suffix (a place with at least 100 bytes left) belongs to a bucket, named by its anchor: the least hash of the 32-byte
strings in its first 100 bytes, which depends on those bytes alone, so that equal strings are always in one bucket at one distance from its
anchor. Buckets are dealt to tasks, which sort them one after another; a task holds a bucket's entries, never texts.

1. Runs of suffixes with one anchor go as one entry (anchor, hash of all bytes that they reach). Equal entries are repeats as a whole; an anchor with
   one entry only has no repeats; only runs of anchors with different entries go on.
2. Those runs are cut into slices of ``STEP`` suffixes at fixed distances from the anchor. The suffix ``STEP`` - 1 bytes behind a slice's
   first belongs to the cover sample: every suffix reaches a sample place within ``STEP`` bytes, and, as comparable suffixes stand at equal
   distances from their anchors, they reach it after equally many bytes. The rank of the sample string (its 93 bytes, as a 64-bit class) decides a long tie at once, so an
   entry is the rank and the at most 7 bytes that a suffix has before and after it.
3. Slices whose rank occurs with different outer bytes are resolved suffix by suffix: rank and outer bytes are one class, its first place is kept.

Within a batch, equal entries meet before the exchange, and a bucket with many different entries sends two of them as a sign and
passes its runs on directly; so no task gets more of a hot bucket than two entries a batch and the entries of batches where it is rare.

A suffix array of all places would move each of them (a shuffle of more than 12 bytes a byte); steps 1 and 2 move about half a byte a byte.

Defined cases: ids are any long, in their signed order; null and empty texts have 0 bytes; texts under 100 bytes keep everything; rows that repeat an id have the same place in the
order and are no earlier copies of each other (their texts are taken to be equal); rows with a null id are neither judged nor copied from; cuts may
fall inside a character, since matches are bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscape.llm.common import _BYTE, columns, mix, packed_text, powers, saved, tasks_for, unpack

LENGTH, ANCHOR, STEP = 100, 32, 8
#: Different entries of one bucket in a batch beyond which the batch passes its runs on directly.
MANY = 2
#: Entries held before a batch is dealt out; text bytes looked at at a time.
FLUSH, CHUNK = 200_000, 250_000
_U = np.uint64
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


class Rolling:
    """Hashes of any byte ranges of one buffer, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(n), dtype=np.uint64)])
        inverse = np.full(n + 1, _BASE_INVERSE, np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by minima from both sides of blocks."""
    n = len(key) - width + 1
    size = -(-len(key) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, at: np.ndarray) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes with one anchor: text, first suffix, last suffix, anchor; ``at``: where the texts in ``data`` begin and end."""
    roll = Rolling(data)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return roll, none, none, none, none
    place = np.arange(len(data) - ANCHOR + 1)
    bits = _U(max(1, int(len(data)).bit_length()))
    key = (roll.of(place, place + ANCHOR) >> bits << bits) | place.astype(np.uint64)
    anchor = (_least(key, LENGTH - ANCHOR + 1) & ((_U(1) << bits) - _U(1))).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(at, start, "right") - 1
    inside = start + LENGTH <= at[text + 1]
    start, text, anchor = start[inside], text[inside], anchor[inside]
    if not len(start):
        return roll, none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:] - 1, [len(start) - 1]])
    return roll, text[new], start[new], start[last], anchor[new]


def _windows_of_text(batches: Iterator[pa.RecordBatch], column: int, before: int, behind: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as one buffer after the other: the batch, the rows, where each row's bytes begin and end in the buffer, and from which byte of its text on.

    A text of more than ``CHUNK`` bytes comes as several windows, each with ``before`` bytes more in front and ``behind`` bytes more at the end,
    so that what is held does not grow with the text. A string column is read as it is, a binary one unpacked.
    """
    read = lambda v: (v.as_buffer().to_pybytes() if v.is_valid else b"") if pa.types.is_string(v.type) or pa.types.is_large_string(v.type) else unpack([v])[0]
    pack = lambda held: (np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(h) for h in held], dtype=np.int64)]))
    for batch in batches:
        rows, held, size = [], [], 0
        for i in range(batch.num_rows):
            text = read(batch.column(column)[i])
            if len(text) > CHUNK:
                for begin in range(0, len(text), CHUNK):
                    low = max(0, begin - before)
                    yield batch, np.array([i]), *pack([text[low : begin + CHUNK + behind]]), np.array([low])
                continue
            rows.append(i)
            held.append(text)
            size += len(text)
            if size >= CHUNK:
                yield batch, np.array(rows), *pack(held), np.zeros(len(rows), np.int64)
                rows, held, size = [], [], 0
        if rows:
            yield batch, np.array(rows), *pack(held), np.zeros(len(rows), np.int64)


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before in any key."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


#: An entry of the exchange: bucket key, key of its content, place (id, byte), number of suffixes (0 in a sign), and what its step needs besides.
_ENTRY = np.dtype([("bucket", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "u1"), ("off", "u1"), ("left", "<u8"), ("right", "<u8")])
_SMALL = np.dtype([("bucket", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "u1"), ("off", "u1")])
#: What comes back, in the packed columns of a row: repeats (start, n) and, for step 1, runs to look at (start, n, off).
_OUT = "doc_id long, repeats binary, open binary, windows binary"
_NAMES = ["part", "entries", "doc_id", "repeats", "open", "windows"]
_PACKED = "part long, entries binary, doc_id long, repeats binary, open binary, windows binary"
_RUN = np.dtype([("start", "<u4"), ("n", "u1"), ("off", "u1")])
_WINDOW = np.dtype([("class", "<i8"), ("start", "<u4")])


class _Answers:
    """Answers by text, as rows."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, kind: int, doc: np.ndarray, values: np.ndarray) -> None:
        if len(doc):
            order = np.argsort(doc, kind="stable")
            doc, values = doc[order], values[order]
            new = np.flatnonzero(_first(doc))
            for a, b in zip(new, [*new[1:], len(doc)], strict=True):
                row = [int(doc[a]), None, None, None]
                row[kind] = values[a:b].tobytes()
                self.rows.append(tuple(row))


def _runs(e: np.ndarray) -> np.ndarray:
    out = np.zeros(len(e), _RUN)
    for c in ("start", "n", "off"):
        out[c] = e[c]
    return out


def _windows(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and (class, start) of every suffix of the slices ``e``: rank, index in the slice and the outer bytes that it has."""
    docs, values = [], []
    for i in range(STEP):
        # off: the first index of a slice that is clipped at its beginning
        w = e[(e["off"] <= i) & (i < e["off"] + e["n"])]
        left = w["left"] >> _U(8 * i) if i < STEP - 1 else np.zeros(len(w), np.uint64)  # bytes i.. of 7
        right = w["right"] & _U((1 << 8 * i) - 1)  # bytes ..i
        v = np.zeros(len(w), _WINDOW)
        v["class"] = mix(w["bucket"] + mix(left * _PLACE[2 * i] + mix(right + _PLACE[2 * i + 1]))).view(np.int64)
        v["start"] = w["start"] + (i - w["off"])
        docs.append(w["doc"])
        values.append(v)
    return np.concatenate(docs), np.concatenate(values)


def _pass_on(answers: _Answers, e: np.ndarray, slices: bool) -> None:
    if slices:
        answers.add(3, *_windows(e))
    else:
        answers.add(2, e["doc"], _runs(e))


def _deal(entries: np.ndarray, parts: int, slices: bool) -> pa.RecordBatch:
    """A batch's entries as packed rows, one per part of the exchange, and the answers already known."""
    e = entries[np.lexsort((entries["start"], entries["doc"], entries["content"], entries["bucket"]))]
    answers = _Answers()
    new = _first(e["bucket"], e["content"])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
    later = ~new & ((e["doc"] != e["doc"][lead]) | (e["start"] != e["start"][lead]))
    answers.add(1, e["doc"][later], _runs(e[later]))
    kept = e[new]
    bucket = np.flatnonzero(_first(kept["bucket"]))
    count = np.diff(np.concatenate([bucket, [len(kept)]]))
    many = np.repeat(count >= MANY, count)
    _pass_on(answers, kept[many], slices)
    sign = np.concatenate([bucket[count >= MANY], bucket[count >= MANY] + 1])
    signs = kept[sign].copy()
    signs["doc"], signs["n"] = 0, 0
    sent = np.concatenate([kept[~many], signs])
    part = ((sent["bucket"] >> _U(40)) * _U(parts) >> _U(24)).astype(np.int64)
    order = np.lexsort((sent["start"], sent["doc"], part))
    sent, part = sent[order], part[order]
    new = np.flatnonzero(_first(part)) if len(part) else []
    rows = []
    for a, b in zip(new, [*new[1:], len(part)], strict=True):
        # column by column, so that the exchange's compression finds the repeated bytes
        rows.append((int(part[a]), b"".join(np.ascontiguousarray(sent[c][a:b]).tobytes() for c in sent.dtype.names), None, None, None, None))
    rows += [(int(r[0]) % parts, None, *r) for r in answers.rows]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], _NAMES)


def _resolve(slices: bool):
    dtype = _ENTRY if slices else _SMALL

    def settle(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        e = np.zeros(sum(len(raw) for raw in held) // dtype.itemsize, dtype)
        begin = 0
        while held:
            raw = held.pop(0)
            n, at = len(raw) // dtype.itemsize, 0
            for c in dtype.names:
                e[c][begin : begin + n] = np.frombuffer(raw, dtype[c], n, at)
                at += n * dtype[c].itemsize
            begin += n
        # signs (n = 0, which no run or slice has; ids may be negative) are no place
        e = e[np.lexsort((e["start"], e["doc"], e["content"], e["bucket"]))]
        answers = _Answers()
        bucket, content = _first(e["bucket"]), _first(e["bucket"], e["content"])
        different = np.add.reduceat(content.astype(np.int64), np.flatnonzero(bucket)) >= 2
        mixed = np.repeat(different, np.diff(np.concatenate([np.flatnonzero(bucket), [len(e)]])))
        real = e["n"] > 0
        group = np.cumsum(content) - 1
        lead = np.full(group[-1] + 1, len(e))
        np.minimum.at(lead, group[real], np.flatnonzero(real))
        lead = np.minimum(lead[group], len(e) - 1)
        later = real & (np.arange(len(e)) != lead) & ((e["doc"] != e["doc"][lead]) | (e["start"] != e["start"][lead]))
        answers.add(1, e["doc"][later], _runs(e[later]))
        yield from emit(answers)
        _pass_on(answers, e[real & ~later & mixed], slices)
        yield from emit(answers)

    def emit(answers: _Answers) -> Iterator[pa.RecordBatch]:
        rows, answers.rows = answers.rows, []
        for k in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 5000], strict=True), types, strict=True)], _NAMES[2:])

    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, answers = [], _Answers()
        for batch in batches:
            for i in range(batch.num_rows):  # row by row: a row packs up to a megabyte
                row = [batch.column(k)[i].as_py() for k in range(6)]
                if row[1]:
                    held.append(row[1])
                else:
                    answers.rows.append(tuple(row[2:]))
                    if len(answers.rows) >= 5000:
                        yield from emit(answers)
        if held:
            yield from settle(held)
        yield from emit(answers)

    return run


def _anchor_entries(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, rows, data, at, low in _windows_of_text(batches, 1, 0, LENGTH - 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False)[rows]
            roll, text, first, last, anchor = runs_of(data, at)
            e = np.zeros(len(text), _SMALL)
            if len(text):
                e["bucket"] = roll.of(anchor, anchor + ANCHOR)
                e["content"] = mix(roll.of(first, last + LENGTH) + (anchor - first).astype(np.uint64))
                e["doc"], e["start"], e["n"], e["off"] = ids[text], first - at[text] + low[text], last - first + 1, anchor - first
            held.append(e)
            size += len(e)
            if size >= FLUSH:
                yield _deal(np.concatenate(held), parts, False)
                held, size = [], 0
        if size:
            yield _deal(np.concatenate(held), parts, False)

    return run


def _slice_entries(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, rows, data, at, low in _windows_of_text(batches, 1, STEP, 256 + LENGTH + STEP):
            ids = batch.column(0).to_numpy(zero_copy_only=False)[rows]
            roll = Rolling(data)
            for k, row in enumerate(rows):
                r = np.frombuffer(b"".join(batch.column(2)[int(row)].as_py()), _RUN)
                if len(rows) == 1:  # perhaps one window of several: the runs that begin in it
                    begin = -(-low[k] // CHUNK) * CHUNK
                    r = r[(r["start"] >= begin) & (r["start"] < begin + CHUNK)]
                if not len(r):
                    continue
                start, n = r["start"].astype(np.int64), r["n"].astype(np.int64)
                suffix = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                anchor = np.repeat(start + r["off"], n)
                step = (suffix - anchor) // STEP
                new = np.flatnonzero(_first(anchor, step))
                count = np.diff(np.concatenate([new, [len(suffix)]]))
                e = np.zeros(len(new), _ENTRY)
                shift = at[k] - low[k]
                base = anchor[new] + step[new] * STEP + shift  # the slice's first suffix, if it is one of the run
                core = base + STEP - 1
                e["bucket"] = mix(roll.of(core, base + LENGTH) + _PLACE[64])
                e["doc"], e["start"], e["n"], e["off"] = ids[k], suffix[new], count, suffix[new] + shift - base
                # outer bytes that some suffix of the slice has
                for i in range(STEP - 1):
                    has = i >= e["off"]
                    e["left"] |= np.where(has, data[np.where(has, base + i, 0)], 0).astype(np.uint64) << _U(8 * i)
                    has = i < e["off"].astype(int) + e["n"] - 1
                    e["right"] |= np.where(has, data[np.where(has, base + LENGTH + i, 0)], 0).astype(np.uint64) << _U(8 * i)
                e["content"] = mix(e["left"] * _PLACE[65] + mix(e["right"] + e["off"] * _U(256) + e["n"]) + e["bucket"])
                held.append(e)
                size += len(e)
            if size >= FLUSH:
                yield _deal(np.concatenate(held), parts, True)
                held, size = [], 0
        if size:
            yield _deal(np.concatenate(held), parts, True)

    return run


def _explode_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 5000):
            part = batch.slice(begin, 5000)
            packs = part.column(1).to_pylist()
            w = np.frombuffer(b"".join(packs), _WINDOW)
            doc = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(p) // _WINDOW.itemsize for p in packs])
            yield pa.RecordBatch.from_arrays([pa.array(w["class"]), pa.array(doc), pa.array(w["start"].astype(np.int64))], ["class", "doc_id", "start"])


def _finish(batches: Iterator[pa.RecordBatch], with_kept: bool = True) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 128):
            part = batch.slice(begin, 128)
            out = []
            for doc, text, packs, starts in zip(part.column(0).to_pylist(), unpack(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                r = np.frombuffer(b"".join(packs or []), _RUN)
                begin_at = np.concatenate([r["start"].astype(np.int64), np.array(starts or [], np.int64)])
                end_at = np.minimum(len(text), np.concatenate([r["start"].astype(np.int64) + r["n"] - 1, np.array(starts or [], np.int64)]) + LENGTH)
                order = np.argsort(begin_at, kind="stable")
                begin_at, end_at = begin_at[order], np.maximum.accumulate(end_at[order])
                # a span goes on as long as the next string begins in it or right behind it
                new = np.flatnonzero(np.concatenate([[True], begin_at[1:] > end_at[:-1]])) if len(order) else np.zeros(0, np.int64)
                span_from, span_to = begin_at[new].tolist(), end_at[np.append(new[1:], len(order)) - 1].tolist() if len(order) else []
                kept = b"".join(text[a:b] for a, b in zip([0, *span_to], [*span_from, len(text)], strict=True))
                out.append((doc, len(text), len(text) - len(kept), len(span_from), hashlib.sha256(kept).hexdigest(), *([kept] if with_kept else [])))
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_kept
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(types)])


def deduplicated(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (``with_kept``) the bytes kept, of every row."""
    spark = docs.sparkSession
    packed = packed_text(docs)
    total = columns(docs, "text").agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    parts = tasks_for(spark, total, 40_000_000)
    # texts as they are, since a task that packs and reads them again keeps two Python processes
    first = columns(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(_anchor_entries(4 * parts), _PACKED)
    first = saved(first.repartitionById(4 * parts, F.col("part").cast("int")).mapInArrow(_resolve(False), _OUT))
    look = first.where("open is not null").groupBy("doc_id").agg(F.collect_list("open").alias("open"))
    second = packed.join(look, "doc_id").select("doc_id", "packed", "open").mapInArrow(_slice_entries(4 * parts), _PACKED)
    second = saved(second.repartitionById(4 * parts, F.col("part").cast("int")).mapInArrow(_resolve(True), _OUT))
    window = second.where("windows is not null").select("doc_id", "windows").mapInArrow(_explode_windows, "class long, doc_id long, start long")
    place = F.struct("doc_id", "start")
    lead = window.groupBy("class").agg(F.min(place).alias("lead"), F.count("*").alias("n")).where("n > 1").select("class", "lead")
    late = window.join(lead, "class").where(place != F.col("lead")).groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    whole = first.where("repeats is not null").select("doc_id", "repeats").union(second.where("repeats is not null").select("doc_id", "repeats"))
    whole = whole.groupBy("doc_id").agg(F.collect_list("repeats").alias("repeats"))
    gone = whole.join(late, "doc_id", "full")
    out = packed.join(gone, "doc_id", "left").select("doc_id", "packed", "repeats", "starts")
    digests = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_kept:
        out = out.mapInArrow(_finish, f"{digests}, kept binary")
    else:  # the bytes kept never leave Python
        out = out.mapInArrow(lambda batches: _finish(batches, False), digests)
    text = F.coalesce("text", F.lit("")).cast("binary")
    loose = columns(docs, "doc_id", "text").where("doc_id is null")
    loose = loose.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), *([text.alias("kept")] if with_kept else []))
    return out.union(loose)
