"""N-gram Jaccard join by a token-group matrix, exact at every size.

1. Texts with the same set of shingles are one class. Min-hash bands partition similar classes: in each bucket the
   smallest id leads, the others are compared with it by their whole sets, and the links found make groups.
2. The matrix of tokens and groups holds, for each class, a prefix of its set in hash order; two sets that link share at least ``need``
   tokens of their prefixes. A class with fewer than ``need`` prefix tokens that occur in another group cannot link outside its
   own group and is done. That is nearly every class.
3. For the rest the matrix of whole sets is built: groups are cut into blocks of bounded size, each block stores the union of its
   members' tokens, rare tokens of a block's queries name the blocks worth a look, a query's overlap with a block's union
   bounds its similarity with all members, and only blocks that reach the bound are opened and compared with each member.

Links join groups, and the components of all links are the answer. Links within a group need no comparison, so that a large group of near
copies costs its size, not its square.

Prefix lemma: of n tokens in a fixed order, with an overlap of at least a = ceil(3n/4) asked for and k = ceil(n/4), the first n - a + k hold
the first k common tokens; a partner has at least 3n/4 tokens, so both prefixes share at least ceil(3n/16).

Defined cases: ids are any long, in their signed order; null and empty texts have no shingles and link with nothing; texts of fewer than five words are one shingle; rows with
a null id have a null component and are not compared; rows that repeat an id are taken to repeat its text (one row is returned per row); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscape.llm.common import CHUNK, chunks, columns, components, doc_sets, mix, packed_text, release, saved, small_batches, tasks_for, unpacked

WIDTH = 5
BANDS, ROWS = 6, 3
#: Followers of a leader in one share; members and tokens of a block; blocks that ask another in one share.
FOLLOWERS, BLOCK, BLOCK_TOKENS, QUERIES = 256, 1024, 400_000, 64
#: Groups with more classes skip the count of step 2 and go on to step 3 (their tokens would all ask for an answer).
GIANT = 1000
#: Prefix tokens that a task turns into rows of the exchange at a time, and that one bucket should hold.
FLUSH, BUCKET = 400_000, 1_000_000
_U = np.uint64
_PERM = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)


def _linked(common: int, n: int, m: int) -> bool:
    return 100 * common >= 75 * (n + m - common)


# --- 1. classes and groups ------------------------------------------------------------------


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches, "text", CHUNK // 4):
        sets = doc_sets(texts, WIDTH)
        n = np.array([len(x) for x in sets], np.int64)
        some = np.flatnonzero(n)
        low, high = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        bands: list = [[]] * len(n)
        if len(some):
            flat = np.concatenate([sets[i] for i in some])
            at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            low[some], high[some] = np.add.reduceat(mix(flat), at), np.add.reduceat(mix(flat ^ _U(0x5555)), at)
            least = np.stack([np.minimum.reduceat(flat * p, at) for p in _PERM])
            keys = np.zeros((len(some), BANDS), np.uint64)
            for b in range(BANDS):
                keys[:, b] = mix(mix(least[b * ROWS : (b + 1) * ROWS]).sum(axis=0) + _U(b))
            for i, k in zip(some, keys.view(np.int64), strict=True):
                bands[i] = k.tolist()
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(n), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n", "low", "high", "bands"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), low and high (128 bits of the set), bands."""
    return columns(docs, "doc_id", "text").mapInArrow(_signatures, "doc_id long, n long, low long, high long, bands array<long>")


def _compare_with_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (leader, salt, follower last): links of followers with their leader."""
    key, own = None, None
    for batch in batches:
        for part, texts in unpacked(batch, 4):
            lead, salt, ids = (part.column(k).to_pylist() for k in range(3))
            sets = doc_sets(texts, WIDTH)
            out = []
            for i, s in enumerate(sets):
                if ids[i] == lead[i]:
                    key, own = (lead[i], salt[i]), s
                elif key == (lead[i], salt[i]) and _linked(len(np.intersect1d(own, s, assume_unique=True)), len(own), len(s)):
                    out.append((ids[i], lead[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def star_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) of classes with the leader of a bucket that they share; linear in classes and bands."""
    placed = reps.select("doc_id", "n", F.explode("bands").alias("key"))
    lead = placed.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("lead"))
    pairs = placed.join(lead, "key").where("doc_id <> lead.doc_id and 4 * least(n, lead.n) >= 3 * greatest(n, lead.n)")
    pairs = saved(pairs.select("doc_id", F.col("lead.doc_id").alias("lead")).distinct())
    shares = pairs.groupBy("lead").agg(F.ceil(F.count("*") / F.lit(FOLLOWERS)).cast("int").alias("shares"))
    follower = pairs.join(shares, "lead").select("lead", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int").alias("salt"), "doc_id", F.lit(1).alias("turn"))
    leader = shares.select("lead", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.col("lead").alias("doc_id"), F.lit(0).alias("turn"))
    wanted = saved(follower.union(leader))
    release(docs.sparkSession)
    rows = wanted.join(packed_text(docs), "doc_id").select("lead", "salt", "doc_id", "turn", "packed")
    tasks = tasks_for(docs.sparkSession, wanted.count(), 20_000)
    return rows.repartition(tasks, "lead", "salt").sortWithinPartitions("lead", "salt", "turn").mapInArrow(_compare_with_leader, "a long, b long")


# --- 2. the matrix of prefixes --------------------------------------------------------------


def prefix_size(n: int) -> int:
    return n - -(-3 * n // 4) + -(-n // 4)


def need(n: int) -> int:
    return max(1, -(-3 * n // 16))


class _Prefixes:
    """Prefix tokens of some classes, dealt to buckets as packed arrays.

    A token that two groups of the batch hold is known to be shared: it counts for its classes at once, and one entry of each
    of two groups goes on, without asking back. So a token in very many classes costs a batch two entries.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.tokens, self.ids, self.groups, self.asks, self.sizes, self.held = [], [], [], [], [], 0

    def add(self, tokens: np.ndarray, doc: int, group: int, giant: bool) -> None:
        self.tokens.append(tokens)
        self.ids.append(doc)
        self.groups.append(group)
        self.asks.append(not giant)
        self.sizes.append(len(tokens))
        self.held += len(tokens)

    def rows(self) -> pa.RecordBatch:
        sizes = np.array(self.sizes, np.int64)
        who = np.repeat(np.arange(len(sizes)), sizes)
        token = np.concatenate(self.tokens)
        order = np.argsort(token, kind="stable")
        token, who = token[order], who[order]
        ids, asks = np.array(self.ids, np.int64), np.array(self.asks, bool)
        group = np.array(self.groups, np.int64)[who]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        low, high = np.minimum.reduceat(group, start), np.maximum.reduceat(group, start)
        run = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [len(token)]])))
        known = low != high
        count = np.bincount(who[known[run]], minlength=len(ids))
        keep = ~known[run] & asks[who]
        # of tokens that do not ask, one entry for the smallest and one for the largest group
        silent = ~known & (np.bincount(run[keep], minlength=len(start)) == 0)
        t = np.concatenate([token[keep], token[start[known]], token[start[known]], token[start[silent]]])
        d = np.concatenate([ids[who[keep]], np.zeros(2 * known.sum() + silent.sum(), np.int64)])
        asking = np.arange(len(d)) < keep.sum()
        g = np.concatenate([group[keep], low[known], high[known], low[silent]])
        bucket = ((t >> _U(32)) * _U(self.buckets) >> _U(32)).astype(np.int64)
        order = np.lexsort((g, d, asking, bucket))
        t, d, g, asking, bucket = t[order], d[order], g[order], asking[order], bucket[order]
        new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (asking[1:] != asking[:-1]) | (d[1:] != d[:-1]) | (g[1:] != g[:-1])])) if len(t) else np.zeros(0, np.int64)
        length = np.diff(np.concatenate([new, [len(t)]]))
        out = []
        runs = np.flatnonzero(np.concatenate([[True], bucket[new][1:] != bucket[new][:-1]])) if len(new) else []
        for a, b in zip(runs, [*runs[1:], len(new)], strict=True):
            x, y = new[a], new[b] if b < len(new) else len(t)
            # the bucket is the leading bits, so the low 32 and the bucket tell tokens apart well enough: a clash only asks for more work
            out.append((int(bucket[x]), t[x:y].astype(np.uint32).tobytes(), d[new[a:b]].tobytes(), (g[new[a:b]] - d[new[a:b]]).tobytes(), length[a:b].astype(np.uint32).tobytes(), np.packbits(asking[new[a:b]]).tobytes(), b"", b""))
        some = np.flatnonzero(count)
        if len(some):
            out.append((int(ids[some[0]]) % self.buckets, b"", b"", b"", b"", b"", ids[some].tobytes(), count[some].astype(np.int64).tobytes()))
        self.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*out, strict=True))] if out else [pa.array([], pa.int64())] + [pa.array([], pa.binary())] * 7,
            _PACKED,
        )


_PACKED = ["bucket", "tokens", "docs", "groups", "lengths", "asking", "known", "counts"]
_PACKED_SHAPE = "bucket long, " + ", ".join(f"{c} binary" for c in _PACKED[1:])


def _count_shared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of buckets: per class the number of its tokens of this task's buckets that another group holds, packed by part."""
    total: dict[int, int] = {}
    bucket, held = None, []

    def settle() -> None:
        tokens = np.concatenate([np.frombuffer(h[0], np.uint32) for h in held])
        docs = np.concatenate([np.frombuffer(h[1], np.int64) for h in held])
        groups = np.concatenate([np.frombuffer(h[2], np.int64) for h in held]) + docs
        lengths = np.concatenate([np.frombuffer(h[3], np.uint32) for h in held]).astype(np.int64)
        # the entries without a class only say that a group holds a token
        asking = np.concatenate([np.unpackbits(np.frombuffer(h[4], np.uint8), count=len(h[3]) // 4) for h in held]).astype(bool)
        run = np.repeat(np.arange(len(docs)), lengths)
        order = np.argsort(tokens, kind="stable")
        t, g = tokens[order], groups[run[order]]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        shared = np.minimum.reduceat(g, start) != np.maximum.reduceat(g, start)
        flag = np.repeat(shared, np.diff(np.concatenate([start, [len(t)]])))
        count = np.bincount(run[order[flag]], minlength=len(docs))
        told = asking & (count > 0)
        for d, c in zip(docs[told].tolist(), count[told].tolist(), strict=True):
            total[d] = total.get(d, 0) + c

    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in range(len(_PACKED))], strict=True):
            if row[0] != bucket and held:
                settle()
                held = []
            bucket = row[0]
            if row[1]:
                held.append(row[1:6])
            for d, c in zip(np.frombuffer(row[6], np.int64).tolist(), np.frombuffer(row[7], np.int64).tolist(), strict=True):
                total[d] = total.get(d, 0) + c
    if held:
        settle()
    if total:
        docs, counts = np.fromiter(total.keys(), np.int64, len(total)), np.fromiter(total.values(), np.int64, len(total))
        part = (mix(docs.astype(np.uint64)) % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        docs, counts, part = docs[order], counts[order], part[order]
        new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        rows = [(int(part[a]), docs[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(new, [*new[1:], len(part)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "docs", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class from the packed counts of a part."""
    docs, counts = [], []
    for batch in batches:
        docs += [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        counts += [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
    if docs:
        own, at = np.unique(np.concatenate(docs), return_inverse=True)
        shared = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(shared)], ["doc_id", "shared"])


def open_classes(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """doc_id and group of the classes that may link outside their group; ``grouped``: doc_id, n, group, members."""
    spark = docs.sparkSession
    tokens = grouped.agg(F.sum("n")).collect()[0][0] or 0
    tasks = tasks_for(spark, tokens // 2, 4 * BUCKET)
    buckets = 4 * tasks

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Prefixes(buckets)
        for batch in batches:
            for part, texts in unpacked(batch, 3):
                ids, groups, members = (part.column(k).to_pylist() for k in range(3))
                for d, g, m, s in zip(ids, groups, members, doc_sets(texts, WIDTH), strict=True):
                    made.add(s[: prefix_size(len(s))].copy(), d, g, m > GIANT)
                if made.held >= FLUSH:
                    yield made.rows()
        if made.held:
            yield made.rows()

    rows = packed_text(docs).join(grouped, "doc_id").select("doc_id", "group", "members", "packed").mapInArrow(deal, _PACKED_SHAPE)
    counted = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _count_shared(b, tasks), "part long, docs binary, counts binary")
    counts = counted.repartition(tasks, "part").mapInArrow(_add_up, "doc_id long, shared long")
    asked = F.greatest(F.lit(1), F.ceil(F.col("n") * 3 / 16))
    may = (F.col("members") > GIANT) | (F.coalesce("shared", F.lit(0)) >= asked)
    return grouped.join(counts, "doc_id", "left").where(may).select("doc_id", "group")


# --- 3. the matrix of whole sets ------------------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in unpacked(batch, 2):
            sets = doc_sets(texts, WIDTH)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "group", "tokens"])


class _Block:
    """A block of the matrix: its union of tokens, and for each token the members that hold it."""

    def __init__(self, rows: list[tuple[int, int, int, np.ndarray]]):
        self.ids, self.groups, self.n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        token = np.concatenate([r[3] for r in rows])
        member = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        order = np.argsort(token, kind="stable")
        self.member = member[order]
        self.union, first = np.unique(token[order], return_index=True)
        self.first = np.concatenate([first, [len(token)]])

    def links(self, doc: int, group: int, n: int, tokens: np.ndarray) -> Iterator[tuple[int, int]]:
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if 4 * len(at) < 3 * n:  # the bound: no member shares more than the union does
            return
        low, count = self.first[at], self.first[at + 1] - self.first[at]
        pick = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = np.bincount(self.member[pick], minlength=len(self.ids))
        for k in np.flatnonzero((100 * common >= 75 * (n + self.n - common)) & (self.groups != group)):
            yield doc, int(self.ids[k])


def _open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (block, salt, members before queries): links of queries with members."""
    key, rows, block, out = None, [], None, []
    for batch in batches:
        own, salt, turn, doc, group, n = (batch.column(k).to_pylist() for k in range(6))
        lists = batch.column(6)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for i in range(batch.num_rows):
            tokens = flat[at[i] : at[i + 1]]
            if key != (own[i], salt[i]):
                key, rows, block = (own[i], salt[i]), [], None
            if turn[i] == 0:
                rows.append((doc[i], group[i], n[i], tokens))
            elif rows:
                block = block or _Block(rows)
                out += block.links(doc[i], group[i], n[i], tokens)
        rows = [(*r[:3], r[3].copy()) for r in rows] if block is None else rows
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
            out = []


def matrix_links(docs: DataFrame, may: DataFrame) -> DataFrame:
    """Links (a, b) between different groups among the classes of ``may``."""
    whole = saved(packed_text(docs).join(may, "doc_id").select("doc_id", "group", "packed").mapInArrow(_sets, "doc_id long, group long, tokens array<long>"))
    token = whole.select("doc_id", "group", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    # tokens of more than one group; the number of classes makes an order, rare first
    shared = token.groupBy("token").agg(F.min("group").alias("g1"), F.max("group").alias("g2"), F.count("*").alias("f")).where("g1 <> g2").select("token", "f")
    held = token.join(shared, "token").groupBy("doc_id", "group", "n").agg(F.collect_set(F.struct("f", "token")).alias("t"))
    # a class without three quarters of its tokens in other groups has no link outside its own
    held = held.where(4 * F.size("t") >= 3 * F.col("n"))
    plain = F.transform(F.array_sort("t"), lambda x: x["token"])
    held = saved(held.select("doc_id", "group", "n", plain.alias("tokens"), F.array_min(F.transform("t", lambda x: F.xxhash64(x["token"]))).alias("key")))
    release(docs.sparkSession)
    # similar classes share the least hash with the probability of their similarity; blocks are bounded in members and tokens
    load = held.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum(F.size("tokens")) / F.lit(BLOCK_TOKENS))).alias("shares"))
    row = saved(held.join(load, "key").withColumn("block", F.xxhash64("key", F.pmod(F.xxhash64("doc_id"), "shares"))).select("doc_id", "group", "n", "tokens", "block"))
    union = row.select("block", F.explode("tokens").alias("token")).distinct()
    # of m tokens, 3n/4 of which a partner has, it has one of the rarest m - 3n/4 + 1
    rare = F.slice("tokens", F.lit(1), (F.size("tokens") - F.ceil(F.col("n") * 3 / 4) + 1).cast("int"))
    probe = row.select(F.col("block").alias("query"), F.explode(rare).alias("token")).distinct()
    named = probe.join(union, "token").where("query < block").select("query", "block").distinct()
    inside = row.groupBy("block").agg(F.countDistinct("group").alias("g")).where("g > 1").select(F.col("block").alias("query"), "block")
    named = saved(named.union(inside))
    shares = named.groupBy("block").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("shares"))
    cells = ("doc_id", "group", "n", "tokens")
    member = row.join(shares, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(0).alias("turn"), *cells)
    asking = named.join(shares, "block").select(F.col("block").alias("to"), F.pmod(F.xxhash64("query"), "shares").cast("int").alias("salt"), F.col("query").alias("block"))
    query = row.join(asking, "block").select(F.col("to").alias("block"), "salt", F.lit(1).alias("turn"), *cells)
    tasks = tasks_for(docs.sparkSession, named.count(), 5_000)
    both = member.union(query).repartition(tasks, "block", "salt").sortWithinPartitions("block", "salt", "turn")
    return both.mapInArrow(_open_blocks, "a long, b long")


# --- the join -------------------------------------------------------------------------------


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    small_batches(docs.sparkSession)
    own = saved(signatures(docs))
    usable = own.where("doc_id is not null and n > 0")
    classes = usable.groupBy("n", "low", "high").agg(F.min("doc_id").alias("rep"))
    member = saved(usable.select("doc_id", "n", "low", "high").distinct().join(classes, ["n", "low", "high"]).select("doc_id", "rep"))
    reps = saved(usable.join(member.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    links = saved(star_links(docs, reps).distinct())
    release(docs.sparkSession)
    group = components(links)
    grouped = reps.select("doc_id", "n").join(group.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("group"))
    sizes = grouped.groupBy("group").agg(F.count("*").alias("members"))
    grouped = saved(grouped.join(sizes, "group").select("doc_id", "n", "group", "members"))
    may = saved(open_classes(docs, grouped))
    release(docs.sparkSession)
    more = saved(matrix_links(docs, may))
    release(docs.sparkSession)
    everything = links.union(more).union(member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = components(everything).withColumnRenamed("id", "of")
    out = own.select("doc_id", "n").join(final, F.col("doc_id") == F.col("of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, one row per id; rows with a null id stay."""
    found = saved(similar_groups(docs))
    # a table of its own, so that the planner knows how few ids go
    drop = saved(found.where("doc_id <> component_id").select(F.col("doc_id").alias("drop_id")).distinct())
    kept = docs.join(drop, docs["doc_id"] == drop["drop_id"], "left_anti")
    again = saved(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again_id")))
    if again.isEmpty():
        return kept
    single = kept.join(again, kept["doc_id"] == again["again_id"], "left_anti")
    first = kept.join(again, kept["doc_id"] == again["again_id"], "left_semi")
    return single.union(first.dropDuplicates(["doc_id"]))
