"""Table contracts: keys, schemas, ranges, coverage, joins of checked cardinality, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def _unique(df: DataFrame, on: Sequence[str], side: str) -> DataFrame:
    """Stop the job on a repeated key.  One map-side aggregate over the keys, joined back
    as a semi join that can only keep rows; the counting runs inside the same job."""
    once = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(
        F.when(F.col("__n") > 1, F.raise_error(f"{side} side repeats a key of ({', '.join(on)})").cast("boolean")).otherwise(F.lit(True))
    )
    return df.join(once.select(*on), list(on), "left_semi")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", cardinality: str = "many_to_one") -> DataFrame:
    """Join whose declared cardinality is enforced while it runs.

    NULL keys never match and are kept as in an ordinary join.
    """
    on = list(on)
    first, last = cardinality.split("_to_")
    if last == "one":
        right = _unique(right, on, "right")
    if first == "one":
        known = left
        for c in on:
            known = known.filter(F.col(c).isNotNull())
        checked = _unique(known, on, "left")
        some_null = F.lit(False)
        for c in on:
            some_null = some_null | F.col(c).isNull()
        left = checked.unionByName(left.filter(some_null))
    return left.join(right, on, how)


def schema_violations(df: DataFrame, table: str, declared: T.StructType) -> list[tuple[str, str, int]]:
    """Missing columns and type differences; extra columns are fine."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in declared.fields:
        if f.name not in have:
            out.append((table, f"missing_column:{f.name}", 1))
        elif have[f.name] != f.dataType:
            out.append((table, f"type:{f.name}", 1))
    return out


def table_checks(df: DataFrame, table: str, keys: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """(table, check, violations): null and duplicate keys, non-finite numbers, given rules."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    rules: dict[str, Column] = {"null_key": null_key}
    if doubles:
        bad = F.lit(False)
        for c in doubles:
            bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(False))
        rules["nonfinite"] = bad
    rules.update(checks)
    names = list(rules)
    wide = df.agg(*[F.count(F.when(F.coalesce(cond, F.lit(False)), 1)).alias(f"c{i}") for i, cond in enumerate(rules.values())])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(table).alias("table"), F.lit(n).alias("check"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(names)])))
    repeated = duplicate_keys(df, keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit(table).alias("table"), F.lit("duplicate_key").alias("check"), "violations"
    )
    return long.unionByName(repeated)


def missing_coverage(left: DataFrame, right: DataFrame, on: Mapping[str, str], check: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    a = left.select(*[F.col(l).alias(f"k{i}") for i, l in enumerate(on)]).distinct()
    b = right.select(*[F.col(r).alias(f"k{i}") for i, r in enumerate(on.values())]).distinct()
    return a.join(b, [f"k{i}" for i in range(len(on))], "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(check).alias("check"), "violations")


def interval_overlaps(links: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Per key: intervals that start inside an earlier one, and intervals that end before
    they start.  The dated links of one firm are a handful of rows."""
    far = F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))
    before = W.partitionBy(key).orderBy(start, far).rowsBetween(W.unboundedPreceding, -1)
    flagged = links.withColumn("__o", F.col(start) <= F.max(far).over(before)).withColumn("__r", far < F.col(start))
    return flagged.groupBy(key).agg(
        F.count(F.when(F.col("__o"), 1)).alias("overlaps"), F.count(F.when(F.col("__r"), 1)).alias("reversed")
    ).filter((F.col("overlaps") > 0) | (F.col("reversed") > 0))


def fingerprint(df: DataFrame, table: str) -> DataFrame:
    """Rows, order-independent content hash, and the range of every date column."""
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    h = F.xxhash64(*df.columns)
    out = df.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"),
        *[F.min(c).cast("string").alias(f"min_{c}") for c in dates], *[F.max(c).cast("string").alias(f"max_{c}") for c in dates],
    )
    ranges = [F.struct(F.lit(c).alias("column"), F.col(f"min_{c}").alias("low"), F.col(f"max_{c}").alias("high")) for c in dates]
    return out.select(F.lit(table).alias("table"), "rows", "hash_xor", "hash_sum", (F.array(*ranges) if ranges else F.array()).alias("date_ranges"))


def table_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Rows of a saved and a recomputed table: only left, only right, and differing per column."""
    keys = list(keys)
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("__a"))
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("__b"))
    both = a.join(b, keys, "full")
    matched = F.col("__a").isNotNull() & F.col("__b").isNotNull()

    def differs(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if isinstance(left.schema[c].dataType, (T.DoubleType, T.FloatType)):
            far = F.abs(x - y) > tolerance
        else:
            far = x != y
        return matched & (F.coalesce(far, F.lit(False)) | (x.isNull() != y.isNull()))

    return both.agg(
        F.count(F.when(F.col("__b").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("__a").isNull(), 1)).alias("only_right"),
        *[F.count(F.when(differs(c), 1)).alias(f"diff_{c}") for c in columns],
    )
