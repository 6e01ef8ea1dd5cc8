"""Benchmark decontamination by greedy string tiling.

A text and a benchmark item are compared only if they share a seed, a run of ``MATCH`` words. Then the longest
run of words that both have and that overlaps no earlier tile becomes a tile, again and again, until no run of ``MATCH``
words is left; the share of the item's words under tiles is its coverage. Tiles may come in any order, so an item whose
passages were moved around is found as well as a verbatim one.

Seeds are Karp-Rabin hashes of words, lower-cased A-Z and split at white space and ASCII punctuation. The benchmark's seeds are looked up in blocks of items with at most ``block_seeds``
seeds; a block is the only thing that is broadcast, so its size is bounded whatever the benchmark's, and each block is one pass
over the texts without any exchange.

Defined cases: null and empty texts or items match nothing; items of fewer than ``MATCH`` words are one seed as a whole; texts are
taken whole; repeated rows give a row each; rows with null ids are compared and returned with a null id.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscape.llm.common import Words, chunks, columns, saved

MATCH = 5
COVERAGE = 0.5
#: ASCII punctuation counts as white space here, so that a changed comma breaks no match.
_TABLE = bytes(32 if (33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126) else b for b in range(256))


def tile(doc: np.ndarray, item: np.ndarray, at_doc: np.ndarray, at_item: np.ndarray, match: int) -> tuple[int, int]:
    """Number of tiles and of item words under them, from the places of all shared seeds.

    Seeds on one diagonal that follow each other are one maximal run; runs are taken longest first and cut
    where an earlier tile has marked their words.
    """
    if not len(at_doc):
        return 0, 0
    order = np.lexsort((at_item, at_doc - at_item))
    d, i = at_doc[order], at_item[order]
    new = np.concatenate([[True], ((d - i)[1:] != (d - i)[:-1]) | (i[1:] != i[:-1] + 1)])
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate([first, [len(d)]])) + match - 1
    heap = [(-int(n), int(x), int(y)) for n, x, y in zip(length, d[first], i[first], strict=True)]
    heapq.heapify(heap)
    used_doc, used_item = set(), np.zeros(len(item), bool)
    tiles = covered = 0
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        free = [not used_item[y + k] and (x + k) not in used_doc for k in range(n)]
        if all(free):
            used_item[y : y + n] = True
            used_doc.update(range(x, x + n))
            tiles, covered = tiles + 1, covered + n
            continue
        k = 0
        while k < n:
            begin = k
            while k < n and free[k]:
                k += 1
            if k - begin >= match:
                heapq.heappush(heap, (begin - k, x + begin, y + begin))
            k += 1
    return tiles, covered


class Block:
    """Some items of the benchmark as arrays: seeds in order, and which item and place each is from."""

    def __init__(self, rows: list[tuple[int, str]], match: int):
        self.ids = [r[0] for r in rows]
        words = Words([(r[1] or "").encode().translate(_TABLE) for r in rows])
        grams = words.grams(match)
        self.items = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        seed, item, place = [], [], []
        self.short = {}
        for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            if b - a >= match:
                seed.append(grams[a : b - match + 1])
                place.append(np.arange(b - a - match + 1))
                item.append(np.full(b - a - match + 1, k))
            elif b > a:
                self.short.setdefault(int(words.hash[a]), []).append(k)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        seed, item, place = join(seed, np.uint64), join(item, np.int64), join(place, np.int64)
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        self.known = np.unique(self.seed)

    def compare(self, texts: list[bytes], match: int) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, tiles, covered words) for every text and item with a shared seed."""
        words = Words([t.translate(_TABLE) for t in texts])
        grams = words.grams(match)
        where = np.zeros(0, np.int64)
        if len(self.known) and len(grams):
            where = np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)] == grams)
        text = np.searchsorted(words.first, where, "right") - 1
        inside = where + match <= words.first[text + 1] if len(where) else np.zeros(0, bool)
        where, text = where[inside], text[inside]
        if len(where):
            low, high = np.searchsorted(self.seed, grams[where]), np.searchsorted(self.seed, grams[where], "right")
            times = high - low
            pick = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
            t, w, it, pl = np.repeat(text, times), np.repeat(where, times), self.item[pick], self.place[pick]
            order = np.lexsort((it, t))
            t, w, it, pl = t[order], w[order], it[order], pl[order]
            cut = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (it[1:] != it[:-1])]))
            for a, b in zip(cut, [*cut[1:], len(t)], strict=True):
                base = words.first[t[a]]
                doc = words.hash[base : words.first[t[a] + 1]]
                yield int(t[a]), int(it[a]), *tile(doc, self.items[it[a]], w[a:b] - base, pl[a:b], match)
        if self.short:
            found = defaultdict(set)
            keys = np.fromiter(self.short, np.uint64, len(self.short))
            for p in np.flatnonzero(np.isin(words.hash, keys)):
                t = int(np.searchsorted(words.first, p, "right") - 1)
                for k in self.short[int(words.hash[p])]:
                    n = len(self.items[k])
                    if p + n <= words.first[t + 1] and (words.hash[p : p + n] == self.items[k]).all():
                        found[t].add(k)
            for t, items in found.items():
                for k in items:
                    yield t, k, 1, len(self.items[k])


SHAPE = "doc_id long, item_id long, tiles long, covered long, item_words long, coverage double"


def _blocks(bench: DataFrame, block_seeds: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one block on the driver at a time."""
    rows, held = [], 0
    for r in columns(bench, "item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        held += len(r["text"] or "") // 2 + 1
        if held >= block_seeds:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def matches(docs: DataFrame, bench: DataFrame, coverage: float = COVERAGE, match: int = MATCH, block_seeds: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, tiles, covered, item_words, coverage of every pair that reaches ``coverage``."""
    spark = docs.sparkSession
    texts = columns(docs, "doc_id", "text")
    parts = []
    for rows in _blocks(bench, block_seeds):
        shared = spark.sparkContext.broadcast(Block(rows, match))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for part, held in chunks(batches, "text"):
                ids = part.column(0).to_pylist()
                out = []
                for t, k, tiles, covered in block.compare(held, match):
                    n = len(block.items[k])
                    if covered >= coverage * n:
                        out.append((ids[t], block.ids[k], tiles, covered, n, covered / n))
                if out:
                    types = [pa.int64()] * 5 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in SHAPE.split(", ")])

        parts.append(texts.mapInArrow(run, SHAPE))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SHAPE)


def decontaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` that reach the coverage of no item; rows with a null id stay (no match can name them)."""
    found = saved(matches(docs, bench).select(F.col("doc_id").alias("found_id")).distinct())
    return docs.join(found, docs["doc_id"] == found["found_id"], "left_anti")
