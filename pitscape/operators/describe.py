"""Descriptive tables, rank correlations and prediction metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

from pitscape.functions import scalars as S
from pitscape.functions.ordering import cumulate, known_keys, quantiles


def missingness(df: DataFrame, columns: Sequence[str], section: str) -> DataFrame:
    """Rows, missing rows and missing share of each column, in one scan."""
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(f"c_{i}") for i, c in enumerate(columns)])
    rows = F.array(
        *[
            F.struct(
                F.lit(section).alias("section"), F.lit(c).alias("column"), F.col("__n").alias("rows"),
                (F.col("__n") - F.col(f"c_{i}")).alias("missing"),
                (1 - F.col(f"c_{i}") / F.col("__n")).alias("missing_share"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(rows))


def nonfinite_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN or infinite entries per column (missing entries are not counted)."""
    bad = lambda c: F.col(c).isNotNull() & S.finite(F.when(~F.isnan(c), F.col(c))).isNull()
    wide = df.agg(*[F.count(F.when(bad(c), 1)).alias(f"c_{i}") for i, c in enumerate(columns)])
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c_{i}").alias("nonfinite")) for i, c in enumerate(columns)]))
    )


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """Rank correlation per group over the rows with both values; NULL under three rows.

    ``weight`` is an integer multiplicity.  Rows are first reduced to (keys, x, y, count); the ranks of x and of y return to
    that table by equi-joins, so no group is sorted in one task.
    """
    keys = list(keys)
    pairs = known_keys(df, *keys, x, y).groupBy(*keys, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(
        F.sum(F.col(weight) if weight else F.lit(1)).alias("__c")
    )
    ranked = pairs
    for col in ("__x", "__y"):
        table = cumulate(pairs, keys, col, {"__n": F.col("__c")})
        rank = (F.col("__n_before") + (F.col("__n") + 1) / 2 - (F.col("__n_total") + 1) / 2).alias(f"__r{col}")
        ranked = ranked.join(table.select(*keys, col, rank), keys + [col])
    c, rx, ry = F.col("__c"), F.col("__r__x"), F.col("__r__y")
    sums = ranked.groupBy(*keys).agg(
        F.sum(c).alias("n"), F.sum(c * rx * ry).alias("__xy"), F.sum(c * rx * rx).alias("__xx"), F.sum(c * ry * ry).alias("__yy")
    )
    value = F.try_divide(F.col("__xy"), F.sqrt(F.col("__xx") * F.col("__yy")))
    return sums.select(*keys, "n", F.when(F.col("n") >= 3, value).alias("spearman"))


def correlation_long(df: DataFrame, columns: Sequence[str], section: str) -> DataFrame:
    """Pairwise-complete rank correlations of all column pairs, long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    entries = [F.struct(F.lit(k).alias("__pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for k, (a, b) in enumerate(pairs)]
    out = spearman(df.select(F.inline(F.array(*entries))), ["__pair"], "x", "y")  # a number, not two names, goes with every row
    name = lambda side: F.element_at(F.array(*[F.lit(p[side]) for p in pairs]), F.col("__pair") + 1)
    return out.select(F.lit(section).alias("section"), name(0).alias("left"), name(1).alias("right"), "n", "spearman")


def variance_inflation(df: DataFrame, columns: Sequence[str], section: str) -> DataFrame:
    """VIF from complete cases: Spark computes the matrix, the driver inverts k x k."""
    complete = df.select(*columns).dropna()
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(complete).select("v")
    matrix = np.asarray(Correlation.corr(vectors, "v").head()[0].toArray())
    inverse = np.linalg.pinv(matrix)
    spark = df.sparkSession
    rows = [(section, c, float(inverse[i, i])) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "section string, column string, vif double")


def distribution(df: DataFrame, keys: Sequence[str], value: str, probabilities=(0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    keys = list(keys)
    names = {f"p{int(round(p * 100)):02d}": p for p in probabilities}
    basic = known_keys(df, *keys, value).groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    return basic.join(quantiles(df, keys, value, names), keys)


def weighted_mean(df: DataFrame, keys: Sequence[str], columns: Sequence[str], weight: str) -> DataFrame:
    """Row-weighted means; a missing metric drops out of its own weight only."""
    w = F.col(weight)
    return df.groupBy(*keys).agg(
        *[
            (F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(c)
            for c in columns
        ]
    )


def wins_against(metrics: DataFrame, cells: Sequence[str], model: str, candidate: str, benchmarks: Sequence[str], metric: str, lower_is_better: bool) -> DataFrame:
    """Per benchmark: compared cells, wins, mean and median improvement of the candidate."""
    wide = metrics.groupBy(*cells).pivot(model, [candidate, *benchmarks]).agg(F.first(metric))
    sign = -1.0 if lower_is_better else 1.0
    rows = F.array(
        *[
            F.struct(F.lit(b).alias("benchmark"), (sign * (F.col(f"`{candidate}`") - F.col(f"`{b}`"))).alias("gain"))
            for b in benchmarks
        ]
    )
    long = wide.select(F.inline(rows)).filter(F.col("gain").isNotNull())
    return long.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("gain") > 0, 1)).alias("wins"),
        F.avg("gain").alias("mean_gain"), F.median("gain").alias("median_gain"),
    )


def calibration_curve(df: DataFrame, keys: Sequence[str], probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """Rows, mean prediction and event rate per quantile bin; equal edges collapse."""
    keys = list(keys)
    counted = known_keys(df, *keys, probability, outcome).groupBy(*keys, probability).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("long")).alias("pos")
    )
    edges = quantiles(counted, keys, probability, {f"e{i:02d}": i / bins for i in range(bins + 1)}, "n")
    p = F.col(probability)
    below = sum((F.col(f"e{i:02d}") < p).cast("int") for i in range(bins + 1))
    at_floor = sum((F.col(f"e{i:02d}") == F.col("e00")).cast("int") for i in range(bins))
    binned = counted.join(edges, keys) if keys else counted.join(F.broadcast(edges))
    binned = binned.withColumn("bin", F.greatest(below, at_floor))
    return binned.groupBy(*keys, "bin").agg(
        F.sum("n").alias("n"), (F.sum(p * F.col("n")) / F.sum("n")).alias("predicted"), (F.sum("pos") / F.sum("n")).alias("actual")
    )


def prediction_metrics(df: DataFrame, keys: Sequence[str], probability: str, outcome: str, eps: float = 1e-6) -> DataFrame:
    """AUC, average precision, Brier, log loss, rank correlation and 10-bin ECE per group.

    Everything but the ECE comes from one table of (group, distinct probability) with
    its running counts of rows and events.
    """
    keys = list(keys)
    base = known_keys(df, *keys, probability, outcome).select(
        *keys, S.clip(F.col(probability), eps, 1 - eps).alias("__p"), F.col(outcome).cast("long").alias("__y")
    )
    table = cumulate(base, keys, "__p", {"n": F.lit(1), "pos": F.col("__y")})
    p, n, pos = F.col("__p"), F.col("n"), F.col("pos")
    neg = n - pos
    neg_before = F.col("n_before") - F.col("pos_before")
    total, events = F.max("n_total"), F.max("pos_total")
    rows_ge, events_ge = F.col("n_total") - F.col("n_before"), F.col("pos_total") - F.col("pos_before")
    rank = F.col("n_before") + (n + 1) / 2 - (F.col("n_total") + 1) / 2
    out = table.groupBy(*keys).agg(
        total.alias("rows"), events.alias("events"),
        F.try_divide(F.sum(pos * (neg_before + neg / 2)), events.cast("double") * (total - events)).alias("roc_auc"),
        F.try_divide(F.sum(pos * (events_ge / rows_ge)), events).alias("average_precision"),
        (F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / total).alias("brier_score"),
        (-F.sum(pos * F.log(p) + neg * F.log(1 - p)) / total).alias("log_loss"),
        F.sum(pos * rank).alias("__prank"), F.sum(n * rank * rank).alias("__rr"),
    )
    # the centred ranks of a 0/1 outcome have two values, total/2 apart
    yy = F.col("events") * (F.col("rows") - F.col("events")) * F.col("rows").cast("double") / 4
    out = out.withColumn("spearman", F.try_divide(F.col("__prank") * F.col("rows") / 2, F.sqrt(F.col("__rr") * yy)))
    curve = calibration_curve(base, keys, "__p", "__y")
    ece = curve.groupBy(*keys).agg(
        (F.sum(F.col("n") * F.abs(F.col("actual") - F.col("predicted"))) / F.sum("n")).alias("expected_calibration_error")
    )
    joined = out.join(ece, keys) if keys else out.join(F.broadcast(ece))
    return joined.drop("__prank", "__rr")


def fit_logit_line(df: DataFrame, keys: Sequence[str], score: str, outcome: str, iterations: int = 25) -> DataFrame:
    """Unpenalised one-feature logistic fit per group: keys, intercept, slope.

    Rows are reduced to (group, distinct score, counts); each Newton step is one grouped
    sum.  Only one row per group - folds and models, a few dozen - reaches the driver.
    A group with a single outcome class keeps the identity line.
    """
    keys = list(keys)
    spark = df.sparkSession
    counted = known_keys(df, *keys, score, outcome).groupBy(*keys, F.col(score).alias("__s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("long")).alias("pos")
    ).persist()
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["a double", "b double"])
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()
    state = {tuple(r[k] for k in keys): [0.0, 1.0] for r in sizes}
    moving = {tuple(r[k] for k in keys) for r in sizes if 0 < r["pos"] < r["n"]}
    for _ in range(iterations):
        if not moving:
            break
        params = spark.createDataFrame([(*k, *v) for k, v in state.items() if k in moving], schema)
        z = F.col("a") + F.col("b") * F.col("__s")
        mu = 1 / (1 + F.exp(-z))
        res, wgt = F.col("pos") - F.col("n") * mu, F.col("n") * mu * (1 - mu)
        joined = counted.join(F.broadcast(params), keys) if keys else counted.join(F.broadcast(params))
        steps = joined.groupBy(*keys).agg(
            F.sum(res).alias("g0"), F.sum(res * F.col("__s")).alias("g1"), F.sum(wgt).alias("h00"),
            F.sum(wgt * F.col("__s")).alias("h01"), F.sum(wgt * F.col("__s") * F.col("__s")).alias("h11"),
        ).collect()
        for r in steps:
            key = tuple(r[k] for k in keys)
            det = r["h00"] * r["h11"] - r["h01"] ** 2
            if det <= 1e-300:
                moving.discard(key)
                continue
            da = (r["h11"] * r["g0"] - r["h01"] * r["g1"]) / det
            db = (r["h00"] * r["g1"] - r["h01"] * r["g0"]) / det
            state[key][0] += da
            state[key][1] += db
            if abs(da) + abs(db) < 1e-10:
                moving.discard(key)
    counted.unpersist()
    out = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["intercept double", "slope double"])
    return spark.createDataFrame([(*k, *v) for k, v in state.items()], out)


@F.pandas_udf(DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value; used on final summaries of a few rows."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2.0)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def student_two_sided(t: float, df: float) -> float:
    x = df / (df + t * t)
    if x >= 1:
        return 1.0
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided t p-value; used on summaries, one row per fitted line."""
    return pd.Series([None if pd.isna(a) or pd.isna(n) else student_two_sided(float(a), float(n)) for a, n in zip(t, df)], dtype="float64")


def newey_west_mean(df: DataFrame, keys: Sequence[str], date: str, value: str, lags: Column | int) -> DataFrame:
    """Mean of a dated series with Bartlett-weighted autocovariances: n, mean, se, t.

    One row per date is expected, so a series is as long as the calendar at most.
    ``lags`` may be a column of the keys (horizon - 1).
    """
    keys = list(keys)
    series = df.filter(F.col(value).isNotNull()).select(*keys, date, F.col(value).alias("x"))
    mean = series.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    lag_column = F.lit(lags) if isinstance(lags, int) else lags
    centred = series.join(mean, keys).withColumn("e", F.col("x") - F.col("mean")).withColumn("__L", lag_column.cast("int"))
    order = W.partitionBy(*keys).orderBy(date)
    numbered = centred.withColumn("__i", F.row_number().over(order))
    shifted = numbered.select(*keys, F.explode(F.sequence(F.lit(0), F.col("__L"))).alias("l"), "__L", "__i", "e", "n", "mean")
    other = numbered.select(*keys, F.col("__i").alias("__j"), F.col("e").alias("e2"))
    pair = shifted.withColumn("__j", F.col("__i") - F.col("l")).join(other, keys + ["__j"])
    weight = F.when(F.col("l") == 0, 1.0).otherwise(2 * (1 - F.col("l") / (F.col("__L") + 1)))
    summed = pair.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum(weight * F.col("e") * F.col("e2")).alias("__v")
    )
    se = F.sqrt(F.col("__v")) / F.col("n")
    return summed.select(*keys, "n", "mean", se.alias("se"), F.try_divide(F.col("mean"), se).alias("t"))


def holm(df: DataFrame, family: Sequence[str], p: str, tie: str) -> DataFrame:
    """Step-down adjusted p-values inside a family of tests (a handful of rows)."""
    order = W.partitionBy(*family).orderBy(p, tie)
    raw = F.col(p) * (F.count(F.lit(1)).over(W.partitionBy(*family)) - F.row_number().over(order) + 1)
    running = order.rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("__raw", raw).withColumn("holm_p", F.least(F.max("__raw").over(running), F.lit(1.0))).drop("__raw")


def clustered_slope(df: DataFrame, keys: Sequence[str], y: str, x: str, cluster: str) -> DataFrame:
    """Simple regression per group with cluster-robust error: n, clusters, slope, se, t.

    Clusters are reduced to six sums first; the scores follow from them exactly.
    """
    keys = list(keys)
    rows = known_keys(df, *keys, y, x, cluster)
    X, Y = F.col(x), F.col(y)
    sums = rows.groupBy(*keys, cluster).agg(
        F.count(F.lit(1)).alias("n"), F.sum(X).alias("sx"), F.sum(Y).alias("sy"), F.sum(X * X).alias("sxx"), F.sum(X * Y).alias("sxy")
    )
    return slope_from_cluster_sums(sums, keys)


def slope_from_cluster_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    c = F.col
    total = sums.groupBy(*keys).agg(
        F.sum("n").alias("__N"), F.count(F.lit(1)).alias("__G"), F.sum("sx").alias("__SX"), F.sum("sy").alias("__SY"),
        F.sum("sxx").alias("__SXX"), F.sum("sxy").alias("__SXY"),
    )
    cov, var = c("__SXY") - c("__SX") * c("__SY") / c("__N"), c("__SXX") - c("__SX") * c("__SX") / c("__N")
    line = total.filter(var > 0).withColumn("slope", cov / var).withColumn(
        "intercept", (c("__SY") - c("slope") * c("__SX")) / c("__N")
    ).withColumn("__var", var).withColumn("__mx", c("__SX") / c("__N"))
    score = (c("sxy") - c("intercept") * c("sx") - c("slope") * c("sxx")) - c("__mx") * (
        c("sy") - c("intercept") * c("n") - c("slope") * c("sx")
    )
    joined = sums.join(line, keys) if keys else sums.join(F.broadcast(line))
    out = joined.groupBy(*keys, "__N", "__G", "slope", "intercept", "__var").agg(F.sum(score * score).alias("__meat"))
    correction = (c("__G") / (c("__G") - 1)) * ((c("__N") - 1) / (c("__N") - 2))
    se = F.sqrt(correction * c("__meat")) / c("__var")
    return out.select(
        *keys, c("__N").alias("rows"), c("__G").alias("clusters"), "slope", "intercept", se.alias("se"), F.try_divide(c("slope"), se).alias("t")
    )
