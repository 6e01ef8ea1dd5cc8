"""Paths, portfolios, costs, expectations, models and audits."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitscape.operators import audit as U
from pitscape.operators import axes as A
from pitscape.operators import costs as K
from pitscape.operators import dynamics as Y
from pitscape.operators import labels as L
from pitscape.operators import models as M
from pitscape.operators import returns as N
from pitscape.params import DEFAULT

D = dt.date.fromisoformat


def _ends(n, start="2000-01-31"):
    return [d.date() for d in pd.date_range(start, periods=n, freq="ME")]


def test_forward_path_with_exit(spark):
    months = _ends(13)
    events = spark.createDataFrame([("A|1", "A", months[0]), ("B|1", "B", months[0])], "event_id string, gvkey string, feature_date date")
    hist = [("A", months[1], 0.10, False, False), ("A", months[2], -0.20, True, False), ("B", months[1], 0.05, False, False), ("B", months[2], 0.0, True, True)]
    history = spark.createDataFrame(hist, "gvkey string, date date, total_return double, has_delist boolean, delist_return_missing boolean")
    factors = spark.createDataFrame([(m, 0.001) for m in months], "date date, rf double")
    paths = N.forward_paths(events, history, factors)
    out = {(r["event_id"], r["horizon_months"]): r for r in N.forward_targets(paths, ["gvkey"]).collect()}
    a = out[("A|1", 6)]
    assert a["forward_total_return"] == pytest.approx(1.10 * 0.80 * 1.001**4 - 1) and a["target_status"] == "complete_after_delist"
    assert out[("B|1", 6)]["target_status"] == "missing_delisting_return" and out[("B|1", 6)]["forward_total_return"] is None
    assert out[("B|1", 1)]["target_status"] == "complete"
    with pytest.raises(Exception, match="no factor row"):
        N.forward_paths(events, history, factors.filter(F.col("date") != F.lit(months[3]))).collect()
    short = N.forward_paths(events, history, factors.filter(F.col("date") <= F.lit(months[3])))
    out = {(r["event_id"], r["horizon_months"]): r for r in N.forward_targets(short, ["gvkey"]).collect()}
    assert out[("A|1", 3)]["target_status"] == "complete_after_delist"
    late = out[("A|1", 6)]
    assert late["target_status"] == "beyond_calendar" and not late["target_valid"]
    assert late["forward_total_return"] is None and late["forward_risk_free_return"] is None


def test_positions_without_or_with_a_broken_path(spark):
    months = _ends(4)
    path = "event_id string, holding_offset int, holding_date date, return_used double, path_valid_through_month boolean, cash_after_delist boolean, valid_delist_event boolean, rf double, beyond_calendar boolean"
    rows = [("A", 1, months[1], 0.1, True, False, False, 0.0, False), ("A", 2, months[2], None, False, False, False, 0.0, False), ("A", 3, months[3], None, False, False, False, None, True)]
    paths = spark.createDataFrame(rows, path)
    assigned = spark.createDataFrame([("A", 3)], "event_id string, horizon_months int")
    with pytest.raises(Exception, match="invalid return path"):
        N.cohort_positions(assigned, paths).collect()
    kept = N.cohort_positions(assigned, paths, broken_path="close").orderBy("holding_offset").collect()
    assert [(r["holding_offset"], r["closed"]) for r in kept] == [(1, False), (2, True)]
    with pytest.raises(Exception, match="no return path"):
        N.cohort_positions(spark.createDataFrame([("B", 3)], "event_id string, horizon_months int"), paths).collect()


@pytest.mark.parametrize("n", [1, 2, 5, 7, 11, 30, 33, 101])
def test_quantile_bins_equal_a_quantile_cut(spark, n):
    df = spark.range(1, n + 1).select(N.quantile_bin(F.col("id"), F.lit(n), 5).alias("q")).toPandas()
    if n < 5:
        assert df["q"].between(1, 5).all()
    else:
        ref = pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False) + 1
        assert (df["q"] == ref).all()


def test_leg_weights(spark):
    df = spark.createDataFrame([("L", 1, 1.0, False), ("L", 1, 3.0, False), ("L", 2, 4.0, False), ("N", 1, 1.0, True), ("N", 1, 3.0, True), ("N", 2, 4.0, True)], "leg string, sic1 int, base double, neutral boolean")
    out = N.leg_weights(df, ["leg"], "base", "sic1", "neutral").toPandas()
    assert out.groupby("leg")["weight"].sum().tolist() == pytest.approx([1.0, 1.0])
    assert out[out["leg"] == "N"].groupby("sic1")["weight"].sum().tolist() == pytest.approx([0.5, 0.5])


def test_turnover_skips_missing_months(spark):
    rows = [("s", D("2000-01-31"), "a", 0.5), ("s", D("2000-01-31"), "b", -0.5), ("s", D("2000-03-31"), "a", 0.2)]
    out = N.weight_turnover(spark.createDataFrame(rows, "k string, m date, n string, w double"), ["k"], "m", "n", "w").toPandas().set_index("m")["turnover"]
    assert out[D("2000-01-31")] == pytest.approx(0.5) and out[D("2000-03-31")] == pytest.approx(0.5 * (0.3 + 0.5))


def test_costs_and_capacity(spark):
    m = spark.createDataFrame([(1, 10.0, 1000.0, 9.9, 10.1, 500.0), (2, None, 1000.0, None, None, 500.0)], "permno long, prc double, vol double, bid double, ask double, market_cap_millions double")
    a, b = K.execution_liquidity(m).orderBy("permno").collect()
    assert a["half_spread"] == pytest.approx(0.01) and a["spread_source"] == "quoted" and 0 < a["capacity_weight_limit"] <= 0.10
    assert b["half_spread"] == pytest.approx(0.005) and b["capacity_weight_limit"] == 0.0 and not b["short_available"]
    w = spark.createDataFrame([(0.05, "long", 0.02, True), (0.05, "short", 0.02, False)], "weight double, leg string, capacity_weight_limit double, short_available boolean")
    x, y = K.cap_weights(w).collect()
    assert x["capacity_weight"] == 0.02 and y["capacity_weight"] == 0.0 and y["capacity_exclusion_reason"] == "short_unavailable"
    one = spark.range(1).select(K.transaction_cost(F.lit(0.2), F.lit(0.002), F.lit(1.0), F.lit(10.0)), K.borrow_cost(F.lit(-0.2), F.lit(300.0))).first()
    assert one[0] == pytest.approx(0.0006) and one[1] == pytest.approx(0.0005)


def test_cross_section_regression_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    n = 80
    p = pd.DataFrame({"event_id": [f"e{i:03d}" for i in range(n)], "horizon_months": 6, "feature_date": D("2001-03-31"), "fold": 1, "sic1": rng.integers(1, 4, n), "s": rng.normal(size=n), "c": rng.normal(size=n), "target_valid": True})
    p["forward_excess_return"] = 0.3 * p["s"] + 0.1 * p["sic1"] + rng.normal(size=n)
    out = N.cross_section_regressions(spark.createDataFrame(p), ["s"], ["c"]).toPandas().set_index("term")
    z = lambda v: (lambda w: (w - w.mean()) / w.std(ddof=0))(v.clip(v.quantile(0.01), v.quantile(0.99)))
    x = np.column_stack([np.ones(n), z(p["s"]), z(p["c"]), p["sic1"] == 2, p["sic1"] == 3]).astype(float)
    beta = np.linalg.lstsq(x, p["forward_excess_return"].to_numpy(), rcond=None)[0]
    assert np.allclose(out.loc[["intercept", "signal", "c"], "coefficient"], beta[:3])


def test_unexpected_motion_matches_a_refit(spark):
    rng = np.random.default_rng(7)
    n = 600
    p = pd.DataFrame({"horizon_years": 5, "yr": rng.integers(2000, 2006, n), "ind": rng.integers(10, 14, n), "a": rng.normal(size=n), "b": rng.normal(3, 2, n)})
    p.loc[rng.random(n) < 0.2, "a"] = np.nan
    p["y"] = p["a"].fillna(0) - 0.5 * p["b"] + 0.2 * p["ind"] + rng.normal(size=n)
    p["row"] = range(n)
    df = spark.createDataFrame(p).withColumn("a", F.when(~F.isnan("a"), F.col("a"))).withColumn("horizon_years", F.col("horizon_years").cast("int")).withColumn("yr", F.col("yr").cast("int"))
    out = Y.unexpected_motion(df, "y", ["a", "b"], "ind", "yr", replace(DEFAULT, min_surprise_train=100)).toPandas().set_index("row")
    tr, te = p[p["yr"] < 2004], p[p["yr"] == 2004]
    inds = sorted(tr["ind"].unique())

    def design(q):
        num = q[["a", "b"]].fillna(tr[["a", "b"]].median())
        base = tr[["a", "b"]].fillna(tr[["a", "b"]].median())
        return np.column_stack([(num - base.mean()) / base.std(ddof=0), *[(q["ind"] == i).astype(float) for i in inds]])

    x, yy = design(tr), tr["y"].to_numpy()
    xc = x - x.mean(0)
    beta = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(x.shape[1]), xc.T @ (yy - yy.mean()))
    expected = yy.mean() + (design(te) - x.mean(0)) @ beta
    assert np.allclose(out.loc[te.index, "expected_velocity"].to_numpy(float), expected)
    assert out.loc[p[p["yr"] == 2000].index, "migration_surprise"].isna().all()


def test_motion_stays_inside_a_vintage(spark):
    rows = [("g", D(f"{y}-12-31"), y, 5, D(f"{y + 1}-06-30"), f, lv) for y, f, lv in ((2000, 1, 0.90), (2001, 1, 0.92), (2002, 2, 0.93), (2003, 2, 0.94), (2004, 2, 0.96))]
    s = spark.createDataFrame(rows, "gvkey string, datadate date, fyear int, horizon_years int, feature_date date, fold int, predicted_survival double")
    out = Y.motion(Y.frontier_position(s)).orderBy("fyear").toPandas()
    assert pd.isna(out["velocity_log_odds"][2]) and out["model_vintage_changed"][2] and out["frontier_crossing"][4] == 1
    assert pd.isna(out["acceleration_log_odds"][3]) and not pd.isna(out["acceleration_log_odds"][4])


def test_expanding_innovation_uses_earlier_years(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(60):
        v = 0.0
        for y in range(2000, 2006):
            v = 0.6 * v + rng.normal()
            rows.append((f"g{g}", D(f"{y}-12-31"), y, float(v)))
    df = spark.createDataFrame(rows, "gvkey string, datadate date, fyear int, x_level double")
    out = A.expanding_innovation(df, "x_level", 50, 2).toPandas().sort_values(["gvkey", "fyear"])
    out["prev"] = out.groupby("gvkey")["x_level"].shift()
    tr = out[(out["fyear"] < 2004) & out["prev"].notna()]
    b = np.clip(np.polyfit(tr["prev"], tr["x_level"], 1)[0], 0, 1)
    te = out[out["fyear"] == 2004]
    ref = te["x_level"] - (tr["x_level"].mean() - b * tr["prev"].mean()) - b * te["prev"]
    assert np.allclose(te["x_innovation"].to_numpy(float), ref.to_numpy())
    assert out[out["fyear"] <= 2002]["x_innovation"].isna().all()


def test_labels_and_leaky_folds(spark):
    events = spark.createDataFrame([(k, D("1999-12-31"), 1999, D("2000-06-30")) for k in "ABCD"], "gvkey string, datadate date, fyear int, feature_date date")
    exits = spark.createDataFrame([("A", D("2002-06-15"), "performance_failure"), ("B", D("2001-06-15"), "merger")], "gvkey string, exit_date date, exit_category string")
    follow = spark.createDataFrame([("A", D("2002-06-15")), ("B", D("2001-06-15")), ("C", D("2009-12-31")), ("D", D("2001-01-31"))], "gvkey string, last_observed_date date")
    out = {r["gvkey"]: r for r in L.fixed_horizon_labels(events, exits, follow, "2010-12-31", (3,)).collect()}
    assert [out[k]["failure_within_horizon"] for k in "ABCD"] == [1, None, 0, None]
    assert [out[k]["censor_reason"] for k in "ABCD"] == ["none", "competing_exit", "none", "lost_followup"]
    assert out["A"]["label_observed_date"] == D("2002-06-15") and out["C"]["label_observed_date"] == D("2003-06-30")
    m = spark.createDataFrame([(3, 1985, D("1999-01-01"), 1)], "horizon_years int, event_year int, label_observed_date date, failure_within_horizon int")
    with pytest.raises(Exception, match="not known"):
        L.assign_folds(m, L.fold_table(spark, 1975, replace(DEFAULT, horizons_years=(3,), test_windows=((2000, 2004),)))).collect()


def test_nested_ridge_finds_a_signal(spark):
    rng = np.random.default_rng(1)
    rows = []
    for role, n in (("train", 600), ("validation", 300), ("test", 300)):
        x = rng.normal(size=(n, 2))
        y = (rng.random(n) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
        rows += [(1, 1, role, float(a), float(b) if i % 9 else None, int(t)) for i, (a, b, t) in enumerate(zip(x[:, 0], x[:, 1], y))]
    split = spark.createDataFrame(rows, "horizon_years int, fold int, role string, a double, b double, failure_within_horizon int")
    p = replace(DEFAULT, ridge_grid=(0.1, 1.0))
    m = M.fold_metrics(M.nested_predictions(split, ["a", "b"], "ridge", p)).first()
    assert m["roc_auc"] > 0.8 and m["expected_calibration_error"] < 0.12


def test_skipped_cells_keep_a_status_row_and_empty_splits_stop(spark):
    rng = np.random.default_rng(4)
    rows = []
    for fold, sizes in ((1, (600, 300, 300)), (2, (40, 300, 300))):
        for role, n in zip(("train", "validation", "test"), sizes):
            rows += [(1, fold, role, float(x), int(rng.random() < 1 / (1 + np.exp(-x)))) for x in rng.normal(size=n)]
    split = spark.createDataFrame(rows, "horizon_years int, fold int, role string, a double, failure_within_horizon int")
    p = replace(DEFAULT, ridge_grid=(1.0,))
    out = M.nested_predictions(split, ["a"], "ridge", p)
    status = [(r["fold"], r["status"]) for r in out.filter("role = 'skipped'").collect()]
    assert len(status) == 1 and status[0][0] == 2 and status[0][1].startswith("too few train rows")
    metrics = {r["fold"]: r for r in M.fold_metrics(out).collect()}
    assert metrics[1]["status"] == "fitted" and metrics[1]["roc_auc"] > 0.6 and metrics[2]["status"].startswith("too few") and metrics[2]["roc_auc"] is None
    with pytest.raises(ValueError, match="empty test split of horizon 1, fold 2"):
        M.nested_predictions(split.filter("fold = 1 or role <> 'test'"), ["a"], "ridge", p)
    folds = spark.createDataFrame([(1, 1), (1, 3)], "horizon_years int, fold int")
    with pytest.raises(ValueError, match="horizon 1, fold 3"):
        M.nested_predictions(split, ["a"], "ridge", p, folds=folds)


def test_unexpected_motion_leaves_out_only_the_control_without_history(spark):
    rng = np.random.default_rng(9)
    n = 500
    p = pd.DataFrame({"horizon_years": 5, "yr": rng.integers(2000, 2003, n), "ind": 1, "a": rng.normal(size=n)})
    p["y"] = 2 * p["a"] + rng.normal(size=n) * 0.1
    df = spark.createDataFrame(p).withColumns({"horizon_years": F.col("horizon_years").cast("int"), "yr": F.col("yr").cast("int")})
    df = df.withColumn("late", F.when(F.col("yr") == 2002, F.col("a") * 3))  # its first values are those of the last year
    small = replace(DEFAULT, min_surprise_train=100)
    got = [Y.unexpected_motion(df, "y", controls, "ind", "yr", small).filter("yr = 2002").orderBy("a").toPandas()["expected_velocity"].to_numpy(float) for controls in (["a", "late"], ["a"])]
    assert np.isfinite(got[0]).all() and np.allclose(*got)


def test_labels_go_on_to_the_last_year_of_the_reports(spark, monkeypatch):
    from pitscape.plans import model_queries as Q

    reports = spark.createDataFrame([("A", y, *[0.0] * len(Q.FEATURES)) for y in (2001, 2002, 2004)], "gvkey string, fyear int, " + ", ".join(f"{c} double" for c in Q.FEATURES))
    monkeypatch.setattr(Q, "report_components", lambda *_: reports)
    got = {r["fyear"]: r["failure_within_horizon"] for r in Q.lapse_matrix(spark, "").collect()}
    assert got == {2001: 0, 2002: 1, 2004: None}


def test_bootstrap_power_finds_strong_effect_and_keeps_null(spark):
    rng = np.random.default_rng(2)
    n = 1200
    inj = rng.normal(size=n)
    p = pd.DataFrame({"gvkey": [str(i % 120) for i in range(n)], "injected": inj, "observable": inj + rng.normal(size=n), "outcome": 0.5 * 0.2 * inj + rng.normal(size=n)})
    out = U.power_gates(U.bootstrap_power(spark.createDataFrame(p), [2.0], 20, 1, 0.5)).first()
    assert out["oracle_detection_rate"] == 1.0 and out["observable_detection_rate"] >= 0.8 and out["median_oracle_rank_ic"] > 0.3
    again = U.power_gates(U.bootstrap_power(spark.createDataFrame(p).repartition(5), [2.0], 20, 1, 0.5)).first()
    assert again["oracle_detection_rate"] == out["oracle_detection_rate"] and again["median_oracle_rank_ic"] == pytest.approx(out["median_oracle_rank_ic"])


def test_gates_truth_table(spark):
    schema = "scope string, scope_value string, score string, precision double, sign_accuracy double, coverage double"
    rows = [("overall", "all", "p", 0.30, 0.8, 0.99), ("overall", "all", "b", 0.2, 0.7, 1.0), ("block", "x", "p", 0.25, 0.8, 1.0), ("block", "y", "p", 0.21, 0.8, 1.0)]
    passed = lambda r: {x["gate"]: x["passed"] for x in U.drift_gate(spark.createDataFrame(r, schema), "p", "b", ["x", "y"]).collect()}
    assert passed(rows)["all_gates"]
    weak = [*rows[:3], ("block", "y", "p", 0.19, 0.8, 1.0)]
    assert not passed(weak)["all_gates"] and not passed(weak)["both_blocks_precision_at_least_0_20"]
    assert not passed(rows[:3])["all_gates"]
    with pytest.raises(PermissionError):
        U.eligibility_audit(spark.createDataFrame([(1, 0.1)], "fyear int, forward_return double"), ["forward_return"], ["candidate"])


def test_tertiles_of_filled_values(spark):
    """Six of ten train values are missing, so the median fills both tertiles; tertiles of the present ones would be 3 and 5."""
    values = [1.0, 3.0, 5.0, 100.0] + [None] * 6
    rows = [(1, "train", i, v) for i, v in enumerate(values)] + [(1, "test", 10, None), (1, "test", 11, 3.9), (1, "test", 12, 4.5)]
    split = spark.createDataFrame(rows, "k int, role string, id int, x double")
    got = {r["id"]: r["cell"] for r in L.tertile_cells(split, ["k"], ["x"]).collect()}
    assert (got[10], got[11], got[12], got[0]) == ("2", "0", "2", "0")


def test_every_query_has_a_stable_schema():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
