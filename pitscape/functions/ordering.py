"""Exact order statistics that split hot groups.

``percentile`` keeps every distinct value of a group in one buffer, and a window over
a group sorts it in one task; both fail once a group holds a large part of the data.
Here a group is cut along a *monotone* code of the value (a fixed number of codes per
factor of two), so that

* value counts are combined map-side on (group, value),
* the running totals over the codes of a group - a table whose size is bounded by the
  number of codes, not of rows - give every code its offset,
* only the rows of one (group, code) are ever sorted together.

The results are exact and do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitscape.session import stored

CODES_PER_OCTAVE = 256
FEW_GROUPS = 20_000      # up to so many groups, a table of one or a few rows a group is broadcast
FEW_CODES_PER_OCTAVE = 64  # coarser codes combine better map-side where rows are not shuffled first
_OFFSET = 2_000_000  # above the largest |log2| of a double times the codes per octave


def order_code(value: Column, per_octave: int = CODES_PER_OCTAVE) -> Column:
    """Monotone integer code of a finite double; zero has a code of its own."""
    magnitude = F.floor(F.log2(F.abs(value)) * per_octave) + _OFFSET
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * magnitude).cast("int")


def known_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows without a group.  Stated once at the source, the filter also keeps every
    branch of a statistic identical up to its first shuffle, so the shuffle is reused."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def cumulate(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, Column],
    code: Column | None = None,
) -> DataFrame:
    """One row per (keys, value) with each sum, ``<sum>_before`` and ``<sum>_total``.

    ``before`` covers the strictly smaller values of the same group.  ``code`` replaces
    the default code for values that are not doubles, e.g. calendar days.
    """
    keys = list(keys)
    counted = (
        known_keys(df, *keys, value)
        .groupBy(*keys, value)
        .agg(*[F.sum(expr).alias(name) for name, expr in sums.items()])
        .withColumn("__code", order_code(F.col(value)) if code is None else code)
    )
    offsets = _code_offsets(counted, keys, list(sums)).drop(*[f"__in_{n}" for n in sums])
    inside = W.partitionBy(*keys, "__code").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    joined = counted.join(offsets, keys + ["__code"])
    for name in sums:
        joined = joined.withColumn(
            f"{name}_before",
            F.col(f"__off_{name}") + F.coalesce(F.sum(name).over(inside), F.lit(0)),
        )
    return joined.drop("__code", *[f"__off_{n}" for n in sums])


def _code_offsets(counted: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Per (keys, code): the sum inside, the sum before, and the group total."""
    per_code = counted.groupBy(*keys, "__code").agg(*[F.sum(n).alias(f"__in_{n}") for n in names])
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = group.orderBy("__code").rowsBetween(W.unboundedPreceding, -1)
    out = {}
    for n in names:
        out[f"__off_{n}"] = F.coalesce(F.sum(f"__in_{n}").over(before), F.lit(0))
        out[f"{n}_total"] = F.sum(f"__in_{n}").over(group)
    return per_code.withColumns(out)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    weight: str | None = None,
    code: Column | None = None,
    few: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles per group, of value or (value, integer weight) rows.

    ``few`` says that there are at most ``FEW_GROUPS`` groups: then only the counts of the codes and the
    rows of the codes that hold a wanted rank are shuffled, and ``df`` is read once for each of the two.
    """
    keys = list(keys)
    present, count = known_keys(df, *keys, value), F.col(weight) if weight else F.lit(1)
    if few:
        counted = present.select(*keys, value, count.alias("__n"))
    else:
        counted = present.groupBy(*keys, value).agg(F.sum(count).alias("__n"))
    default = order_code(F.col(value), FEW_CODES_PER_OCTAVE if few else CODES_PER_OCTAVE)
    counted = counted.withColumn("__code", default if code is None else code)
    offsets = _code_offsets(counted, keys, ["__n"])
    position = {name: (F.col("__n_total") - 1) * F.lit(float(p)) for name, p in probabilities.items()}
    # keep only the codes in which a wanted rank lies, before any row-level sort
    wanted = F.lit(False)
    for at in position.values():
        for index in (F.floor(at), F.ceil(at)):
            wanted = wanted | (
                (index >= F.col("__off___n")) & (index < F.col("__off___n") + F.col("__in___n"))
            )
    chosen = offsets.filter(wanted).drop("__in___n")
    inside = W.partitionBy(*keys, "__code").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    if few:
        held = counted.join(F.broadcast(chosen), keys + ["__code"])
        kept = held.groupBy(*keys, "__code", value).agg(
            F.sum("__n").alias("__n"), F.max("__n_total").alias("__n_total"), F.max("__off___n").alias("__off___n")
        )
    else:
        kept = counted.join(chosen, keys + ["__code"])
    ranked = (
        kept
        .withColumn("__upto", F.col("__off___n") + F.sum("__n").over(inside))
        .withColumn("__from", F.col("__upto") - F.col("__n"))
    )
    at_index = lambda i: F.max(
        F.when((F.col("__from") <= i) & (i < F.col("__upto")), F.col(value))
    )
    aggregates = [F.max("__n_total").alias("__n_total")]
    for name, at in position.items():
        aggregates += [at_index(F.floor(at)).alias(f"__lo_{name}"), at_index(F.ceil(at)).alias(f"__hi_{name}")]
    grouped = ranked.groupBy(*keys).agg(*aggregates)
    return grouped.select(
        *keys,
        *[
            (
                F.col(f"__lo_{name}")
                + (at - F.floor(at)) * (F.col(f"__hi_{name}") - F.col(f"__lo_{name}"))
            ).alias(name)
            for name, at in position.items()
        ],
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value) -> ``rank`` (ties share their mean rank), ``ties``, ``group_rows``."""
    table = cumulate(df.filter(F.col(value).isNotNull()), keys, value, {"__n": F.lit(1)})
    return table.select(
        *keys,
        value,
        (F.col("__n_before") + (F.col("__n") + 1) / 2).alias("rank"),
        F.col("__n").alias("ties"),
        F.col("__n_total").alias("group_rows"),
    )


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, rows_out: str | None = None) -> DataFrame:
    """Add the average rank of ``value`` inside its group; a missing value has no rank.

    The rank table is unique on (keys, value), so a heavily tied value is a skewed key
    with one row on the other side, which the adaptive skew join splits.
    """
    keys = list(keys)
    table = average_ranks(df, keys, value)
    columns = [*keys, value, F.col("rank").alias(out)]
    if rows_out:
        columns.append(F.col("group_rows").alias(rows_out))
    return df.join(table.select(*columns), keys + [value], "left")


def _by_range(df: DataFrame, keys: list[str], value: Column, tie: str) -> DataFrame:
    """Rows in ranges of (keys, value, tie), with ``__range`` and an ``__id`` that rises along each."""
    dealt = df.withColumns({"__v": value.cast("double"), "__t": F.col(tie).cast("string")})
    dealt = dealt.repartitionByRange(*keys, "__v", "__t").sortWithinPartitions(*keys, "__v", "__t").drop("__v", "__t")
    # the upper bits of the id are the range, the lower 33 the place in it
    return dealt.withColumn("__id", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__id", 33))


def with_row_number(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    tie: str,
    out: str,
    rows_out: str | None = None,
    few: bool = False,
) -> DataFrame:
    """Exact row number by (value, tie) inside a group, without sorting a group in one task.

    ``value`` must be non-null.  Rows are dealt by ranges of (keys, value, tie) and sorted
    there, so neither a hot group nor a tied value is one task; a row's number is its
    place in its range plus the rows of its group in the ranges before.  ``few`` says that
    there are at most ``FEW_GROUPS`` groups: then the rows are not shuffled again for that sum.
    """
    keys = list(keys)
    placed = stored(_by_range(known_keys(df, *keys), keys, value, tie))  # written once, since it is read twice
    ranges = placed.groupBy(*keys, "__range").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    group = W.partitionBy(*keys)
    before = group.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select(
        *keys,
        "__range",
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__off"),
        F.sum("__n").over(group).alias(rows_out or "__rows"),
    )
    numbered = placed.join(F.broadcast(offsets) if few else offsets, keys + ["__range"]).withColumn(out, F.col("__id") + F.col("__off"))
    return numbered.drop("__id", "__range", "__off", "__rows")


def top_fraction(df: DataFrame, keys: Sequence[str], score: str, tie: str, fraction: float, out: str) -> DataFrame:
    """Flag the exact ``ceil(fraction * n)`` largest absolute scores per group.

    A missing score never alerts and does not count in ``n``.
    """
    present = df.filter(F.col(score).isNotNull())
    numbered = with_row_number(present, keys, -F.abs(F.col(score)), tie, "__rn", "__rows_in_group")
    flagged = numbered.withColumn(
        out, F.col("__rn") <= F.ceil(F.lit(float(fraction)) * F.col("__rows_in_group"))
    ).drop("__rn", "__rows_in_group")
    missing = df.filter(F.col(score).isNull()).withColumn(out, F.lit(False))
    return flagged.unionByName(missing)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], block: Column) -> DataFrame:
    """Add ``previous_<column>`` of the preceding row of the same key in ``order``.

    ``block`` is a non-decreasing function of the order (an hour, a month): a hot key is
    cut into its blocks, each block looks back inside itself, and only its first row
    takes the last row of the key's previous block, found on one row per block.
    """
    keys, order, columns = list(keys), list(order), list(columns)
    blocked = df.withColumn("__b", block)
    last = blocked.groupBy(*keys, "__b").agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("__last"))
    carried = last.select(*keys, "__b", F.lag("__last").over(W.partitionBy(*keys).orderBy("__b")).alias("__carry"))
    inside = W.partitionBy(*keys, "__b").orderBy(*order)
    looked = blocked.withColumn("__rn", F.row_number().over(inside)).withColumns(
        {f"__in_{c}": F.lag(c).over(inside) for c in columns}
    )
    joined = looked.join(carried, keys + ["__b"])
    first = F.col("__rn") == 1
    return joined.withColumns(
        {f"previous_{c}": F.when(first, F.col(f"__carry.{c}")).otherwise(F.col(f"__in_{c}")) for c in columns}
    ).drop("__b", "__rn", "__carry", *[f"__in_{c}" for c in columns])
