"""The vector-weighted bootstrap against rows that are really copied."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pitscape.operators import audit as U
from pitscape.operators import power as P


def frame(n=400, firms=40, seed=2, effect=0.2):
    rng = np.random.default_rng(seed)
    inj = np.round(rng.normal(size=n), 1)  # many ties
    inj[: n // 3] = 0.5  # a value with a third of the rows
    return pd.DataFrame({"gvkey": [str(int(firms * rng.random() ** 2)) for _ in range(n)], "injected": inj, "observable": np.round(inj + rng.normal(size=n), 1), "outcome": effect * inj + np.round(rng.normal(size=n), 1)})


def copied(p, weights, m, fraction, kind):
    """Slope, clustered t and rank correlation of one replicate on copied rows; every draw is a cluster of its own."""
    parts = [p[p["gvkey"] == g].assign(draw=f"{g}|{k}") for g, w in weights.items() for k in range(int(w))]
    q = pd.concat(parts)
    e = q["outcome"] - fraction * q["injected"]
    y = (e + fraction * m * q["injected"]).to_numpy()
    x = (m * q["injected"] if kind == "oracle" else q["observable"]).to_numpy()
    a = np.column_stack([np.ones(len(x)), x])
    bread = np.linalg.inv(a.T @ a)
    beta = bread @ a.T @ y
    score = pd.DataFrame(a * (y - a @ beta)[:, None]).groupby(q["draw"].to_numpy()).sum().to_numpy()
    g, n = q["draw"].nunique(), len(q)
    cov = bread @ (score.T @ score) @ bread * g / (g - 1) * (n - 1) / (n - 2)
    rank = None if kind == "null" else pd.DataFrame({"x": x, "y": y}).corr("spearman").iloc[0, 1]
    return beta[1], beta[1] / np.sqrt(cov[1, 1]), rank


@pytest.mark.parametrize("rows", [37, 8000])
def test_every_replicate_equals_copied_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(P, "ROWS", rows)
    p, fraction, replicates = frame(), 0.4, 6
    seen = {}
    real = P.slopes, P.rank_correlations, P.drawn
    monkeypatch.setattr(P, "slopes", lambda *a: seen.setdefault("slopes", real[0](*a)))
    monkeypatch.setattr(P, "rank_correlations", lambda *a: seen.setdefault("ic", real[1](*a)))
    monkeypatch.setattr(P, "drawn", lambda *a: seen.setdefault("drawn", real[2](*a)))
    out = {(r["kind"], r["multiplier"]): r for r in U.bootstrap_power(spark.createDataFrame(p).repartition(4), [1.0, 3.0], replicates, 5, fraction).collect()}
    w = {r["cluster"]: np.frombuffer(r["w"]) for r in seen["drawn"].select("cluster", "w").collect()}
    assert {sum(v[k] for v in w.values()) for k in range(replicates)} == {p["gvkey"].nunique()}
    lines = [("null", 0.0), ("oracle", 1.0), ("observable", 1.0), ("oracle", 3.0), ("observable", 3.0)]
    for i, (kind, m) in enumerate(lines):
        want = [copied(p, {g: v[k] for g, v in w.items()}, m, fraction, kind) for k in range(replicates)]
        assert np.allclose(seen["slopes"][0][i], [s for s, _, _ in want]) and np.allclose(seen["slopes"][1][i], [t for _, t, _ in want])
        if kind != "null":
            assert np.allclose(seen["ic"][0 if kind == "oracle" else 1, [1.0, 3.0].index(m)], [c for _, _, c in want])
            assert np.isclose(out[kind, m]["median_rank_ic"], np.median([c for _, _, c in want]))
        assert np.isclose(out[kind, m]["median_slope"], np.median([s for s, _, _ in want]))


def test_sorted_rows_carry_small_numbers(spark, monkeypatch):
    # a multiplicity took 8 bytes a replicate, a rank 8 more: 24 bytes a row and replicate went through every sort
    monkeypatch.setattr(P, "ROWS", 100)
    seen, real, replicates = [], P._Sorted.__init__, 50
    monkeypatch.setattr(P._Sorted, "__init__", lambda self, rows, *a: (seen.append(rows), real(self, rows, *a))[1])
    U.bootstrap_power(spark.createDataFrame(frame()), [1.0, 3.0], replicates, 5, 0.4).collect()
    held = [c for c in ("w", "ro", "ri") if c in seen[-1].columns]
    assert len(held) == 3 and max(sum(len(r[c]) for c in held) for r in seen[-1].select(*held).collect()) <= 5 * replicates


@pytest.mark.parametrize("top", [3, 300, 70_000, 2**33])
def test_small_numbers_come_back(top):
    v = np.array([0.0, top, 1.0])
    assert P._wide([P._small(v), P._small(v % 2)], 3).tolist() == [v.tolist(), (v % 2).tolist()]


def test_calibration_is_held_out_on_fresh_draws(spark):
    p = frame(600, 60, 4, 0.15)
    out = U.calibrate_power(spark.createDataFrame(p), [0.01, 4.0, 8.0], 12, 8, U.expected_fraction()).toPandas()
    first, second = out[out["stage"] == "calibration"], out[out["stage"] == "evaluation"]
    assert len(first) == 3 and not first.set_index("multiplier").loc[0.01, "passes"]
    assert first[first["selected"]]["multiplier"].tolist() == [4.0] == second["multiplier"].tolist() and second["passes"].tolist() == [True]
    none = U.calibrate_power(spark.createDataFrame(p), [0.01], 4, 4, 0.5).toPandas()
    assert none["stage"].tolist() == ["calibration"] and not none["selected"].any()
    with pytest.raises(ValueError, match="positive"):
        U.calibrate_power(spark.createDataFrame(p), [0.0], 4, 4, 0.5)
    assert U.expected_fraction(12, 12) == 1.0 and 0.77 < U.expected_fraction() < 0.82
