"""Guards of the hazard fit, and time-split folds against numpy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from test_geometry import _intervals

from pitscape.operators import survival as V

ORIGIN = dt.date(1900, 1, 1)


def test_monotone_likelihood_has_a_status_and_no_number(spark):
    # whoever fails has the largest x of its risk set, so a larger coefficient always fits better
    p = pd.DataFrame({"gvkey": [str(i) for i in range(30)], "entry_day": 0, "stop_day": range(10, 40), "event": 1, "x": [float(30 - i) for i in range(30)]})
    fit = V.fit_hazard(spark.createDataFrame(p), ["x"], "event")
    assert fit["status"] == "monotone_likelihood" and np.isnan(fit["beta"]).all()
    row = V.hazard_table(spark, fit, "c").first()
    assert (row["coefficient"], row["z"], row["p_value"], row["hazard_ratio"], row["status"], row["events"]) == (None, None, None, None, "monotone_likelihood", 30)


def test_too_few_events_are_refused(spark):
    p = _intervals(60)
    assert V.fit_hazard(spark.createDataFrame(p.assign(event=0)), ["x"], "event")["status"] == "too_few_events"
    fit = V.fit_hazard(spark.createDataFrame(p), ["x", "z"], "event", min_events=10_000)
    assert fit["status"] == "too_few_events" and fit["events"] == p["event"].sum() and fit["rows"] == 60 and fit["issuers"] == 30


def test_likelihood_and_table(spark):
    p = _intervals()
    fit = V.fit_hazard(spark.createDataFrame(p), ["x", "z"], "event")
    x = (p[["x", "z"]].to_numpy() - fit["mean"]) / fit["scale"]
    t0, t1 = p["entry_day"].to_numpy(), p["stop_day"].to_numpy()
    eta = x @ fit["beta"]
    want = sum(eta[i] - np.log(np.exp(eta[(t0 < t1[i]) & (t1[i] <= t1)]).sum()) for i in np.flatnonzero(p["event"]))
    assert fit["status"] == "fitted" and np.isclose(fit["log_likelihood"], want)
    for i, r in enumerate(V.hazard_table(spark, fit, "c").orderBy("feature").collect()):
        se = np.sqrt(fit["covariance"][i, i])
        assert np.isclose(r["z"], fit["beta"][i] / se) and np.isclose(r["ci_high"], np.exp(fit["beta"][i] + 1.959964 * se)) and 0 <= r["p_value"] <= 1
        assert (r["intervals"], r["issuers"], r["events"], r["covariance_kind"]) == (400, 200, p["event"].sum(), "issuer_clustered_sandwich")


def test_a_bad_start_is_halved_back(spark):
    # one huge outlier: a full Newton step from 0 overshoots
    p = _intervals(200)
    p.loc[0, "x"] = 60.0
    fit = V.fit_hazard(spark.createDataFrame(p), ["x", "z"], "event", iterations=60)
    assert fit["status"] == "fitted" and np.isfinite(fit["beta"]).all()


def logit(x, y):
    a, b = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(60):
        q = 1 / (1 + np.exp(-a @ b))
        b = b + np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a, a.T @ (y - q))
    return b


def test_folds_fit_before_and_judge_after(spark):
    rng = np.random.default_rng(4)
    n = 900
    year = rng.integers(1996, 2003, n)
    start = pd.to_datetime([f"{y}-{m:02d}-15" for y, m in zip(year, rng.integers(1, 13, n), strict=True)])
    x = rng.normal(size=n)
    stop = start + pd.to_timedelta(rng.integers(20, 300, n), unit="D")
    gone = rng.random(n) < 1 / (1 + np.exp(-(x - 1)))
    p = pd.DataFrame({
        "gvkey": [str(i // 3) for i in range(n)], "interval_id": [str(i) for i in range(n)], "feature_date": start.date, "interval_stop_date": stop.date, "x": x, "w": rng.normal(size=n),
        "entry_day": [(d - ORIGIN).days for d in start.date], "stop_day": [(d - ORIGIN).days for d in stop.date], "fail": gone.astype(int), "merge": ((rng.random(n) < 0.01) & ~gone).astype(int),
    })
    report, scored = V.hazard_folds(spark.createDataFrame(p), ["x", "w"], {"failure": "fail", "merger": "merge"}, ((2000, 2000), (2001, 2002)), 100, 20, 5)
    got = report.toPandas().set_index(["cause", "fold"])
    assert len(got) == 4 and got.loc[("merger", 1), "status"].startswith("too few train events") and np.isnan(got.loc[("merger", 1), "concordance"])
    for fold, (a, b) in ((1, (2000, 2000)), (2, (2001, 2002))):
        row = got.loc[("failure", fold)]
        train = p[p["interval_stop_date"] < dt.date(a, 1, 1)]
        test = p[[a <= d.year <= b for d in p["feature_date"]]]
        assert (row["train_intervals"], row["train_events"], row["test_intervals"], row["test_issuers"]) == (len(train), train["fail"].sum(), len(test), test["gvkey"].nunique())
        assert row["train_max_stop_date"] == train["interval_stop_date"].max() and row["status"] == "fitted"
        fit = V.fit_hazard(spark.createDataFrame(train), ["x", "w"], "fail")
        risk = lambda q, fit=fit: (q[["x", "w"]].to_numpy() - fit["mean"]) / fit["scale"] @ fit["beta"]
        line = logit(risk(train), train["fail"].to_numpy())
        prob = 1 / (1 + np.exp(-(line[0] + line[1] * risk(test))))
        mine = scored.filter(f"cause = 'failure' and fold = {fold}").toPandas().set_index("interval_id")
        assert np.allclose(mine.loc[test["interval_id"], "predicted_interval_event_probability"], prob, atol=1e-6)
        assert row["brier_score"] == pytest.approx(((prob - test["fail"]) ** 2).mean(), abs=1e-6)
        again = logit(np.log(prob / (1 - prob)), test["fail"].to_numpy())
        assert np.allclose([row["calibration_intercept"], row["calibration_slope"]], again, atol=1e-4)
        assert row["concordance"] > 0.6
    none, rows = V.hazard_folds(spark.createDataFrame(p), ["x"], {"failure": "fail"}, ((1990, 1991),), 100, 20, 5)
    assert rows is None and none.first()["status"] == "too few train intervals, test intervals, train events, test events"
