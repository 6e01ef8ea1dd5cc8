"""Full cross-sections against numpy and pandas: median fill, rank IC, refusals, summary."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pitscape.operators import returns as N


def section(rng, n, date, horizon=2, fold=1):
    p = pd.DataFrame({"event_id": [f"{date}|{i}" for i in range(n)], "horizon_months": horizon, "feature_date": date, "fold": fold, "sic1": rng.integers(1, 4, n), "s": rng.normal(size=n), "target_valid": True})
    for k in range(13):
        p[f"c{k}"] = np.where(rng.random(n) < 0.15, np.nan, rng.normal(size=n) + 5 * (rng.random(n) < 0.03))
    p["forward_excess_return"] = 0.3 * p["s"] + 0.1 * p["sic1"] + p["c0"].fillna(0) * 0.2 + rng.normal(size=n)
    return p


CONTROLS = [f"c{k}" for k in range(13)]


def load(spark, p):
    df = spark.createDataFrame(p).withColumn("horizon_months", F.col("horizon_months").cast("int")).withColumn("fold", F.col("fold").cast("int")).withColumn("sic1", F.col("sic1").cast("int"))
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in CONTROLS}).repartition(3)


def standard(v):
    w = v.clip(v.quantile(0.01), v.quantile(0.99))
    w = w.fillna(w.median())
    return (w - w.mean()) / w.std(ddof=0)


def test_thirteen_controls_with_missing_values(spark):
    p = section(np.random.default_rng(1), 120, dt.date(2001, 3, 31))
    out = N.cross_section_regressions(load(spark, p), ["s"], CONTROLS).toPandas().set_index("term")
    x = np.column_stack([np.ones(len(p)), *[standard(p[c]) for c in ["s", *CONTROLS]], p["sic1"] == 2, p["sic1"] == 3]).astype(float)
    beta, _, rank, _ = np.linalg.lstsq(x, p["forward_excess_return"].to_numpy(), rcond=None)
    assert rank == x.shape[1] and np.allclose(out.loc[["intercept", "signal", *CONTROLS], "coefficient"], beta[:15])
    fit = x @ beta
    y = p["forward_excess_return"].to_numpy()
    assert np.isclose(out.loc["signal", "r_squared"], 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert np.isclose(out.loc["signal", "rank_ic"], p["s"].rank().corr(p["forward_excess_return"].rank())) and out.drop("signal")["rank_ic"].isna().all()
    assert set(out["status"]) == {"fitted"}


def test_dates_that_cannot_be_fitted_say_why(spark):
    rng = np.random.default_rng(2)
    days = [dt.date(2001, 3, 31), dt.date(2001, 6, 30), dt.date(2001, 9, 30), dt.date(2001, 12, 31)]
    few, tight, flat, good = (section(rng, n, d) for n, d in zip((20, 50, 90, 90), days, strict=True))
    tight["sic1"] = np.arange(50) % 40  # 1 + 14 + 39 columns
    flat["c3"] = 2.0
    out = N.cross_section_regressions(load(spark, pd.concat([few, tight, flat, good])), ["s"], CONTROLS).toPandas()
    status = out.groupby("feature_date")["status"].agg(["first", "size"])
    assert status["first"].tolist() == ["too_few_rows", "no_degrees_of_freedom", "rank_deficient", "fitted"] and status["size"].tolist() == [1, 1, 1, 15]
    assert out[out["status"] != "fitted"][["term", "coefficient", "rank_ic"]].isna().all(axis=None)


def test_summary_of_coefficients_and_rank_ics(spark):
    rng = np.random.default_rng(3)
    dates = pd.date_range("1998-01-31", periods=30, freq="ME").date
    rows = [(h, s, d, "signal", 0.02 * (s == "a") + 0.05 * rng.normal(), 0.1, 40, 1 + i // 10, "fitted", 0.05 + 0.1 * rng.normal()) for h in (1, 3) for s in "ab" for i, d in enumerate(dates)]
    rows += [(6, "a", d, "signal", 0.1, 0.1, 40, 1, "fitted", 0.1) for d in dates[:5]] + [(1, "a", dt.date(2001, 1, 31), None, None, None, 9, 1, "too_few_rows", None)]
    schema = "horizon_months int, signal string, feature_date date, term string, coefficient double, r_squared double, cross_section_rows long, fold int, status string, rank_ic double"
    out = N.cross_section_summary(spark.createDataFrame(rows, schema), 24, (3, "a")).toPandas().set_index(["horizon_months", "signal"])
    p = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    for h in (1, 3):
        v = p[(p["horizon_months"] == h) & (p["signal"] == "a") & (p["term"] == "signal")]["coefficient"].to_numpy()
        e = v - v.mean()
        s = sum((1 if k == 0 else 2 * (1 - k / h)) * (e[k:] * e[: len(e) - k]).sum() for k in range(h))
        assert np.isclose(out.loc[(h, "a"), "mean_coefficient"], v.mean()) and np.isclose(out.loc[(h, "a"), "coefficient_hac_se"], np.sqrt(s) / len(v))
    few = out.loc[(6, "a")]
    assert few["status"] == "too_few_months" and few["months"] == 5 and pd.isna(few["mean_coefficient"]) and pd.isna(few["holm_p"])
    assert out.loc[(1, "a"), "skipped_months"] == 1 and out.loc[(1, "a"), "observations"] == 1200 and out["is_primary"].sum() == 1
    tested = out[out["status"] == "tested"].sort_values("coefficient_p_value")
    want = np.minimum(1, np.maximum.accumulate(tested["coefficient_p_value"].to_numpy() * np.arange(4, 0, -1)))
    assert np.allclose(tested["holm_p"], want)


def test_few_cross_sections_do_not_shuffle_a_row_a_column(spark, monkeypatch):
    p = pd.concat([section(np.random.default_rng(k), 70, dt.date(2001, 3 * k, 28)) for k in (1, 2, 3)])
    seen, real = [], N.quantiles
    monkeypatch.setattr(N, "quantiles", lambda *a, **b: (seen.append(b.get("few", False)), real(*a, **b))[1])
    keys, columns = ["horizon_months", "feature_date"], ["s", *CONTROLS]
    order = ["event_id"]
    few = N.winsorize_standardize(load(spark, p), keys, columns).toPandas().sort_values(order)
    monkeypatch.setattr(N, "FEW_GROUPS", 3 * len(columns) - 1)
    many = N.winsorize_standardize(load(spark, p), keys, columns).toPandas().sort_values(order)
    assert seen == [True, False] and np.allclose(few[columns].to_numpy(float), many[columns].to_numpy(float))
