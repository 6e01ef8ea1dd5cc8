"""Lines of many series against numpy, one series at a time."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitscape.operators import inference as I
from pitscape.operators import returns as N


def month(k):
    y, m = divmod(k, 12)
    nxt = dt.date(2000 + y + (m == 11), (m + 1) % 12 + 1, 1)
    return nxt - dt.timedelta(days=1)


def plain(at, x, y, most):
    """Least squares and Bartlett errors from the full matrix of scores."""
    x = np.column_stack([np.ones(len(y)), x])
    bread = np.linalg.pinv(x.T @ x)
    beta = bread @ x.T @ y
    u = x * (y - x @ beta)[:, None]
    meat = np.zeros((x.shape[1],) * 2)
    for a in range(len(y)):
        for b in range(len(y)):
            gap = abs(int(at[a] - at[b]))
            if gap <= most:
                meat += (1 - gap / (most + 1)) * np.outer(u[a], u[b])
    e = y - x @ beta
    return beta, np.sqrt(np.clip(np.diag(bread @ meat @ bread), 0, None)), 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))


def table(spark, sizes, gaps=False):
    rng = np.random.default_rng(3)
    rows, kept = [], {}
    for g, n in enumerate(sizes):
        at = np.sort(rng.choice(3 * n, n, replace=False)) if gaps else np.arange(n)
        x = rng.normal(size=(n, 2)) * [1, 1e-3] + [5, 0.2]
        y = 0.3 + x[:, 0] - 40 * x[:, 1] + np.convolve(rng.normal(size=n + 3), np.ones(4), "valid")
        kept[g] = (at, x, y)
        rows += [(g, 3 + g, month(int(a)), float(v), float(p), float(q)) for a, v, (p, q) in zip(at, y, x)]
    return spark.createDataFrame(rows, "g int, h int, d date, y double, a double, b double").repartition(5), kept


@pytest.mark.parametrize("by,gaps", [("row", False), ("row", True), ("month", True)])
def test_lines_equal_numpy(spark, by, gaps):
    df, kept = table(spark, [40, 12, 25], gaps)
    out = {(r.g, r.term): r for r in I.hac_lines(df, ["g"], "d", "y", ["a", "b"], F.col("h") - 1, 11, by).collect()}
    for g, (at, x, y) in kept.items():
        beta, se, r2 = plain(np.arange(len(y)) if by == "row" else at, x, y, 2 + g)
        for j, term in enumerate(["const", "a", "b"]):
            row = out[(g, term)]
            assert np.isclose(row.coefficient, beta[j], rtol=1e-8) and np.isclose(row.se, se[j], rtol=1e-8) and np.isclose(row.r_squared, r2, rtol=1e-9)
            assert np.isclose(row.p_value, math.erfc(abs(beta[j] / se[j]) / math.sqrt(2)), rtol=1e-6) and row.status == "fitted" and row.months == len(y)


def test_mean_without_regressors(spark):
    df, kept = table(spark, [30, 1])
    out = {r.g: r for r in I.hac_lines(df, ["g"], "d", "y", [], 4, 4).collect()}
    beta, se, _ = plain(kept[0][0], np.empty((30, 0)), kept[0][2], 4)
    assert np.isclose(out[0].coefficient, beta[0]) and np.isclose(out[0].se, se[0])
    assert out[1].se is None and out[1].p_value is None and out[1].status == "too_short"


def test_missing_and_repeated(spark):
    df, _ = table(spark, [30])
    holes = df.withColumn("y", F.when(F.month("d") != 3, F.col("y")))
    assert I.hac_lines(holes, ["g"], "d", "y", ["a"], 1, 1).first().months == holes.filter("y is not null").count()
    twin = I.hac_lines(df.withColumn("b", F.col("a") * 7), ["g"], "d", "y", ["a", "b"], 1, 1)
    assert {r.status for r in twin.collect()} == {"rank_deficient"}
    with pytest.raises(Exception, match="repeats a date"):
        I.hac_lines(df.unionByName(df), ["g"], "d", "y", ["a"], 1, 1).collect()
    with pytest.raises(Exception, match="lacks the regressor"):
        I.hac_lines(df.withColumn("a", F.when(F.month("d") != 3, F.col("a"))), ["g"], "d", "y", ["a"], 1, 1).collect()
    with pytest.raises(Exception, match="greatest reach"):
        I.hac_lines(df, ["g"], "d", "y", ["a"], 3, 2).collect()
    assert I.hac_lines(df.limit(0), ["g"], "d", "y", ["a"], 1, 1).count() == 0


def test_fold_spreads_and_factor_summary(spark):
    rng = np.random.default_rng(5)
    rows = [(6, "s", "equal", False, month(3 * k), 2000 + k // 8, float(rng.normal()), float(rng.normal()), 0.5) for k in range(16)]
    spreads = spark.createDataFrame(rows, "horizon_months int, signal string, weighting string, industry_neutral boolean, feature_date date, fold int, long_short_excess_return double, long_short_total_return double, monotonicity double")
    out = {r.fold: r for r in N.fold_spreads(spreads).collect()}
    for fold in (2000, 2001):
        y = np.array([x[6] for x in rows if x[5] == fold])
        beta, se, _ = plain(np.arange(8), np.empty((8, 0)), y, 5)
        assert out[fold].formation_cohorts == 8 and np.isclose(out[fold].mean_long_short_excess_return, beta[0]) and np.isclose(out[fold].hac_standard_error, se[0])
    months = [(6, "s", "equal", False, month(k), float(rng.normal() / 50), 0.4, 6) for k in range(30)]
    monthly = spark.createDataFrame(months, "horizon_months int, signal string, weighting string, industry_neutral boolean, holding_date date, long_short_return double, turnover double, active_cohorts int")
    f = rng.normal(size=30) / 30
    factors = spark.createDataFrame([(month(k), float(f[k])) for k in range(30)], "date date, mkt double")
    row = N.factor_summary(monthly, factors, ["mkt"]).first()
    beta, se, r2 = plain(np.arange(30), f[:, None], np.array([m[5] for m in months]), 5)
    assert np.isclose(row.factor_alpha_monthly, beta[0]) and np.isclose(row.factor_alpha_hac_standard_error, se[0]) and np.isclose(row.factor_r_squared, r2)
    assert np.isclose(row.factor_betas["mkt"], beta[1]) and row.months == 30 and row.average_active_cohorts == 6
    with pytest.raises(Exception, match="lacks the regressor"):
        N.factor_summary(monthly, factors.limit(29), ["mkt"]).collect()
