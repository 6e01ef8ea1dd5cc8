"""Frontier position and motion, rolling market controls, unexpected motion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitscape.functions import scalars as S
from pitscape.functions.ordering import known_keys, quantiles, with_average_rank
from pitscape.params import DEFAULT, Params


def frontier_position(surface: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Log odds, hazard proxy, frontier margin and cohort percentile of a survival estimate."""
    level = F.col("viability_level")
    odds = S.logit(level, p.probability_clip)
    cohort = ["horizon_years", "feature_date"]
    named = surface.withColumnRenamed("predicted_survival", "viability_level")
    ranked = with_average_rank(named, cohort, "viability_level", "__rank", "viability_cohort_size")
    share = F.col("__rank") / F.col("viability_cohort_size")
    return (
        ranked.withColumn("viability_log_odds", odds)
        .withColumn("constant_hazard", S.constant_hazard(level, "horizon_years", p.probability_clip))
        .withColumn("frontier_margin", odds - F.log(F.lit(p.frontier / (1 - p.frontier))))
        .withColumn("above_frontier", level >= p.frontier)
        .withColumn("viability_percentile", F.when(F.col("viability_cohort_size") >= p.min_cohort, share))
        .drop("__rank")
    )


def motion(surface: DataFrame) -> DataFrame:
    """Velocity, acceleration, frontier crossing and encroachment between reports.

    Differences are annual and stay inside one model vintage (fold); encroachment is a
    plain difference and does not depend on the vintage.  One row per firm, horizon and
    report, so a firm window spans at most the calendar.
    """
    w = W.partitionBy("gvkey", "horizon_years").orderBy("feature_date", "datadate")
    before = lambda c: F.lag(c).over(w)
    years = F.date_diff("feature_date", before("feature_date")) / 365.25
    df = surface.withColumn("elapsed_years", years).withColumn(
        "__same", S.when_all(before("fold") == F.col("fold"), F.col("elapsed_years") > 0)
    )
    gap = F.when(F.col("elapsed_years") > 0, F.col("elapsed_years"))
    inside = lambda e: F.when(F.col("__same"), e)
    crossing = (
        F.when(~before("above_frontier") & F.col("above_frontier"), 1).when(before("above_frontier") & ~F.col("above_frontier"), -1).otherwise(0)
    )
    df = (
        df.withColumn("model_vintage_changed", S.when_all(before("fold") != F.col("fold")))
        .withColumn("velocity_probability", inside((F.col("viability_level") - before("viability_level")) / gap))
        .withColumn("velocity_log_odds", inside((F.col("viability_log_odds") - before("viability_log_odds")) / gap))
        .withColumn("frontier_crossing", inside(crossing))
    )
    df = df.withColumn("acceleration_log_odds", inside((F.col("velocity_log_odds") - before("velocity_log_odds")) / gap))
    if "crowding_density" in surface.columns:
        df = df.withColumn("competitive_encroachment", (F.col("crowding_density") - before("crowding_density")) / gap)
    return df.drop("__same")


def rolling_market_controls(panel: DataFrame, factors: DataFrame) -> DataFrame:
    """Momentum, prior return, volatility, dollar volume and beta known before each month.

    Row windows that end with the previous month; one row per firm and month.  Momentum
    needs all eleven returns, the others a minimum number of present ones.
    """
    joined = panel.join(factors.select("date", "mkt_excess", "rf"), "date", "left")
    w = W.partitionBy("gvkey").orderBy("date")
    win = lambda a, b: w.rowsBetween(a, b)
    x, y = F.col("mkt_excess"), F.col("total_return") - F.col("rf")
    base = joined.withColumns(
        {"__x": x, "__y": y, "__xy": x * y, "__xx": x * x, "__g": F.greatest(1 + F.col("total_return"), F.lit(0.01)),
         "__dv": F.abs("prc") * F.greatest("vol", F.lit(0.0))}
    ).withColumn("__g", F.when(F.col("total_return").isNotNull(), F.col("__g")))
    mean = lambda c, a, n: F.when(F.count(c).over(win(a, -1)) >= n, F.avg(c).over(win(a, -1)))
    mx, my = mean("__x", -24, 18), mean("__y", -24, 18)
    variance = mean("__xx", -24, 18) - mx * mx
    out = {
        "momentum_12_2": F.when(F.count("__g").over(win(-12, -2)) == 11, F.product("__g").over(win(-12, -2)) - 1),
        "prior_1m_return": F.lag("total_return").over(w),
        "realized_volatility_12m": F.when(F.count("total_return").over(win(-12, -1)) >= 8, F.stddev_samp("total_return").over(win(-12, -1))),
        "log_dollar_volume_12m": F.log1p(mean("__dv", -12, 8)),
        "equity_beta_24m": F.try_divide(mean("__xy", -24, 18) - mx * my, variance),
    }
    return base.withColumns(out).drop("__x", "__y", "__xy", "__xx", "__g", "__dv")


def unexpected_motion(
    df: DataFrame, target: str, numeric: Sequence[str], industry: str, year: str, p: Params = DEFAULT
) -> DataFrame:
    """Residual of a ridge expectation refitted for every year on strictly earlier years.

    Training never revisits rows: per (horizon, year, industry) the raw moments of
    (value or 0, missing flag) are summed once, map-side.  Imputing by the training
    median, scaling and industry dummies are linear maps of those moments, so adding up
    the earlier years and one small solve per year gives the exact fit.  Medians come
    from distinct values served to later years.  A control without any value in the earlier
    years is left out of that year's fit; the others are fitted.
    """
    numeric = list(numeric)
    rows = df.filter(F.col(target).isNotNull())
    cols = []
    for c in numeric:
        cols += [F.coalesce(F.col(c), F.lit(0.0)), F.col(c).isNull().cast("double")]
    cols.append(F.col(target))
    named = rows.select("horizon_years", F.col(year).alias("__y"), F.col(industry).cast("string").alias("__ind"), *[c.alias(f"u{i}") for i, c in enumerate(cols)])
    m = len(cols)
    moments = [F.count(F.lit(1)).alias("n"), *[F.sum(f"u{i}").alias(f"s{i}") for i in range(m)]]
    moments += [F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"q{i}_{j}") for i in range(m) for j in range(i, m)]
    yearly = named.groupBy("horizon_years", "__y", "__ind").agg(*moments)

    years = rows.select("horizon_years", F.col(year).alias("__serves")).distinct()
    long = rows.select("horizon_years", F.col(year).alias("__y"), *numeric).unpivot(["horizon_years", "__y"], numeric, "component", "value")
    distinct = known_keys(long, "value").groupBy("horizon_years", "__y", "component", "value").agg(F.count(F.lit(1)).alias("w"))
    served = distinct.join(F.broadcast(years), "horizon_years").filter(F.col("__y") < F.col("__serves"))
    medians = quantiles(served, ["horizon_years", "__serves", "component"], "value", {"median": 0.5}, "w")
    wide = medians.groupBy("horizon_years", F.col("__serves").alias("serves")).agg(
        F.array(*[F.max(F.when(F.col("component") == c, F.col("median"))) for c in numeric]).alias("medians")
    )
    wide = years.withColumnRenamed("__serves", "serves").join(wide, ["horizon_years", "serves"], "left")
    alpha, minimum = p.surprise_alpha, max(1, p.min_surprise_train)

    def solve(moments_: pd.DataFrame, meds: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in meds.iterrows():
            part = moments_[moments_["__y"] < row["serves"]].groupby("__ind", sort=True).sum(numeric_only=True)
            n = part["n"].sum() if len(part) else 0
            if n < minimum:
                continue
            med = np.full(m // 2, np.nan) if row["medians"] is None else np.asarray(row["medians"], dtype=float)
            known = np.flatnonzero(~np.isnan(med))
            k, d = len(known), len(part)
            s = part[[f"s{i}" for i in range(m)]].to_numpy(float)
            q = np.zeros((m, m))
            for i in range(m):
                for j in range(i, m):
                    q[i, j] = q[j, i] = part[f"q{i}_{j}"].sum()
            lift = np.zeros((k + 1, m))  # imputed numerics and the target from the raw vector
            for i, j in enumerate(known):
                lift[i, 2 * j], lift[i, 2 * j + 1] = 1.0, med[j]
            lift[k, m - 1] = 1.0
            total, cross = lift @ s.sum(axis=0), lift @ q @ lift.T
            mean = total / n
            central = cross - n * np.outer(mean, mean)
            sd = np.sqrt(np.clip(np.diag(central)[:k] / n, 0, None))
            sd[sd < 1e-12] = 1.0
            count = part["n"].to_numpy(float)
            by = s @ lift.T  # per industry sums of numerics and target
            share = count / n
            size = k + d
            a, b = np.zeros((size, size)), np.zeros(size)
            a[:k, :k] = central[:k, :k] / np.outer(sd, sd)
            b[:k] = central[:k, k] / sd
            dummy = by - count[:, None] * mean
            a[:k, k:] = (dummy[:, :k] / sd).T
            a[k:, :k] = a[:k, k:].T
            a[k:, k:] = np.diag(count) - n * np.outer(share, share)
            b[k:] = dummy[:, k]
            beta = np.linalg.solve(a + alpha * np.eye(size), b)
            raw = beta[:k] / sd
            const = mean[k] - raw @ mean[:k] - beta[k:] @ share
            coef, med = np.zeros(m // 2), np.nan_to_num(med)
            coef[known] = raw
            out.append((int(moments_["horizon_years"].iloc[0]), int(row["serves"]), float(const), list(coef), list(med), dict(zip(part.index, map(float, beta[k:]))), int(n)))
        return pd.DataFrame(out, columns=["horizon_years", "serves", "const", "coef", "medians", "effects", "train_rows"])

    left, right = yearly, wide.select(F.col("horizon_years").alias("h"), "serves", "medians")
    fitted = left.groupBy("horizon_years").cogroup(right.groupBy("h")).applyInPandas(
        solve, "horizon_years int, serves int, const double, coef array<double>, medians array<double>, effects map<string,double>, train_rows long"
    )
    joined = df.join(fitted.withColumnRenamed("serves", year), ["horizon_years", year], "left")
    expected = F.col("const") + F.coalesce(F.element_at("effects", F.col(industry).cast("string")), F.lit(0.0))
    for i, c in enumerate(numeric):
        expected = expected + F.col("coef")[i] * F.coalesce(F.col(c), F.col("medians")[i])
    expected = F.when(F.col(target).isNotNull(), expected)
    return (
        joined.withColumn("expected_velocity", expected)
        .withColumn("migration_surprise", F.col(target) - F.col("expected_velocity"))
        .drop("const", "coef", "medians", "effects")
    )
