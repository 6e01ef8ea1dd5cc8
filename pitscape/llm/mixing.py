"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a budget of words. Its documents are ordered by a hash and taken until
the budget is met, without a sort: the words of a source are summed by the leading bits of
the hash, the running sums name the one bucket in which the budget ends, and only that
bucket's rows are summed again by the next bits. A budget above the source's size takes every
document once and the rest of the budget a second time, so the takings are nested.

Defined cases: a null text has size 0; a null source is a source of its own, after all
others; documents with equal hashes (equal id and equal text, or md5 ties) are taken or left together; a
null id is hashed like an id of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitscape.llm.common import columns, saved

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash and of one histogram; five rounds use all bits.
BITS, STEP = 60, 12
WEIGHTS = (5, 2, 1)


def source_key(source: Column) -> Column:
    """A null-free key: '=' and the source, or '~' for null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def document_hash() -> Column:
    """60 bits of an md5 of id and text."""
    text = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """key, source, h and size of every document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return columns(docs, "doc_id", "text", "source").select("doc_id", source_key(F.col("source")).alias("key"), document_hash().alias("h"), size.alias("size"))


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """key, source_size, target: ``share`` of all words dealt by weight, none above ``cap`` times its size.

    Filling by weight with caps has one level L with target = min(cap * size, L * weight). Sources
    in the order of cap * size / weight are capped while the level the others would have is above
    their own ratio. One row per source: windows over it are as small as the list of sources.
    """
    own = sizes.groupBy("key").agg(F.sum("size").cast("double").alias("source_size"))
    # '~' sorts after '=', so the null source comes last; the rest by code point
    rank = F.row_number().over(Window.orderBy("key")) - 1
    dealt = own.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumns({"limit": F.col("source_size") * cap, "ratio": F.col("source_size") * cap / F.col("w")}).withColumns(
        {
            "all_size": F.sum("source_size").over(everything),
            "all_w": F.sum("w").over(everything),
            "full": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "full_w": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    # the level if all sources before this one are capped: it rises while sources are rightly capped and falls after
    level = (F.col("all_size") * share - F.col("full")) / (F.col("all_w") - F.col("full_w"))
    dealt = dealt.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return dealt.select("key", F.col("source_size").cast("long").alias("source_size"), F.least("limit", F.col("level") * F.col("w")).alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """key and ``bar``: of each source, rows with h < bar come nearest to its ``budget`` words.

    Sums by (source, bucket) combine map-side, so a hot source costs no more than others;
    each round keeps only the rows of the bucket in which the budget of their source ends.
    """
    rows, state = sizes.join(budgets.where("budget > 0"), "key").select("key", "h", "size"), budgets.select("key", "budget", F.lit(0).cast("long").alias("low"))
    for used in range(STEP, BITS + 1, STEP):
        width = 1 << (BITS - used)
        sums = rows.groupBy("key", F.expr(f"shiftright(h, {BITS - used})").alias("bucket")).agg(F.sum("size").cast("double").alias("s"))
        running = Window.partitionBy("key").orderBy("bucket")
        at = sums.withColumn("before", F.sum("s").over(running) - F.col("s")).join(state, "key")
        # the bucket in which the running sum passes the budget; in the last round a bucket is one hash, left if that is nearer
        last = used == BITS
        passed = F.col("before") + (F.col("s") / 2 if last else F.col("s")) >= F.col("budget")
        first = at.groupBy("key").agg(
            F.min(F.when(passed, F.struct("bucket", "before"))).alias("m"), F.first("budget").alias("budget"), F.max("bucket").alias("top")
        )
        # where no bucket passes it (the last row of the range is taken too) the bar is the end of the rows
        low = F.coalesce(F.col("m.bucket"), F.col("top") + 1) * width
        state = saved(first.select("key", (F.col("budget") - F.coalesce("m.before", F.lit(0.0))).alias("budget"), low.alias("low")))
        if not last:
            edge = state.select("key", F.expr(f"shiftright(low, {BITS - used})").alias("bucket"))
            rows = saved(rows.withColumn("bucket", F.expr(f"shiftright(h, {BITS - used})")).join(edge, ["key", "bucket"]).drop("bucket"))
    return budgets.select("key").join(state.select("key", "low"), "key", "left").select("key", F.coalesce("low", F.lit(0)).alias("bar"))


def mixture(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted)."""
    return _taken(saved(sized(docs))).select("doc_id", "size", "source_size", "target", "taken")


def _taken(sizes: DataFrame) -> DataFrame:
    goal = saved(targets(sizes))
    over = F.col("target") > F.col("source_size")
    goal = goal.withColumns({"copies": over.cast("int"), "budget": F.when(over, F.col("target") - F.col("source_size")).otherwise(F.col("target"))})
    bars = thresholds(sizes, goal.select("key", "budget"))
    picked = sizes.join(goal.drop("budget").join(bars, "key"), "key")
    return picked.withColumn("taken", F.col("size") * (F.col("copies") + (F.col("h") < F.col("bar")).cast("int")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes at all, with ``times`` (1 or 2), the number of times it takes them.

    A row of size 0 adds nothing to a mix and is left out. Other columns may have any name; one named ``times`` is replaced.
    """
    places = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select("*", source_key(docs["source"]), document_hash()).toDF(*places, "mix_key", "mix_h")
    text = F.col(places[docs.columns.index("text")])
    sizes = saved(plain.select(F.col("mix_key").alias("key"), F.col("mix_h").alias("h"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    goal = saved(targets(sizes))
    over = F.col("target") > F.col("source_size")
    goal = goal.withColumns({"copies": over.cast("int"), "budget": F.when(over, F.col("target") - F.col("source_size")).otherwise(F.col("target"))})
    bars = thresholds(sizes, goal.select("key", "budget")).join(goal.select("key", "copies"), "key")
    bars = bars.select(F.col("key").alias("mix_key"), "bar", "copies")
    times = F.col("copies") + (F.col("mix_h") < F.col("bar")).cast("int")
    taken = plain.join(bars, "mix_key").withColumn("times", times).where((F.col("times") > 0) & (F.regexp_count(text, F.lit(WORD)) > 0))
    kept = [(p, c) for p, c in zip(places, docs.columns, strict=True) if c != "times"]
    return taken.select(*[F.col(p).alias(c) for p, c in kept], "times")


ORACLE = """
with s as (
  select doc_id, coalesce('=' || source, '~') as key,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '~') || '/' || coalesce(text, '')), 1, 15) as bigint) as h,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size
  from documents),
o as (select key, cast(sum(size) as double) as source_size from s group by key),
w as (select *, [5.0, 2.0, 1.0][cast((row_number() over (order by key) - 1) % 3 + 1 as int)]::double as w from o),
r as (select *, source_size * 2 as lim, source_size * 2 / w as ratio from w),
c as (select *, sum(source_size) over () as all_size, sum(w) over () as all_w,
             coalesce(sum(lim) over (order by ratio, key rows between unbounded preceding and 1 preceding), 0) as full_,
             coalesce(sum(w) over (order by ratio, key rows between unbounded preceding and 1 preceding), 0) as full_w from r),
l as (select *, (all_size * 1.5::double - full_) / (all_w - full_w) as lvl from c),
t as (select key, source_size, least(lim, (select max(lvl) from l) * w) as target from l),
b as (select *, target > source_size as twice, case when target > source_size then target - source_size else target end as budget from t),
q as (select key, h, sum(sum(size)) over (partition by key order by h) - sum(size) as before, sum(size) as own from s group by key, h)
select s.doc_id, s.size::bigint as size, b.source_size::bigint as source_size, b.target,
       (s.size * (case when b.twice then 1 else 0 end + case when q.before + q.own / 2.0 < b.budget then 1 else 0 end))::bigint as taken
from s join b using (key) join q using (key, h)
"""
