"""Neighbour search, concordance, components and hazards against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitscape.operators import archetypes as T
from pitscape.operators import neighbours as X
from pitscape.operators import survival as V


def _brute(ids, x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.argsort(np.argsort(ids)), d.shape), d), axis=1)[:, :k]
    return {ids[i]: [(ids[j], d[i, j]) for j in order[i]] for i in range(len(ids))}


@pytest.mark.parametrize("blocks", [False, True])
def test_nearest_is_exact_on_hot_and_small_groups(spark, monkeypatch, blocks):
    if blocks:  # force many blocks, salts and cells on small data
        monkeypatch.setattr(X, "BLOCK", 40)
        monkeypatch.setattr(X, "ASSIGN_BLOCK", 150)
        monkeypatch.setattr(X, "LEAF", 64)
    rng = np.random.default_rng(11)
    groups = {"hot": rng.normal(size=(900, 3)), "dup": np.repeat(rng.normal(size=(5, 3)), 30, axis=0), "tiny": rng.normal(size=(3, 3))}
    rows = [(g, f"{g}{i:04d}", [float(a) for a in v]) for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, id string, v array<double>")
    out = X.nearest(df, df, 6, True).toPandas().sort_values(["g", "id", "rank"])
    got = {i: list(zip(p["peer"], p["distance"])) for i, p in out.groupby("id")}
    for g, x in groups.items():
        ids = np.array([f"{g}{i:04d}" for i in range(len(x))])
        for i, ref in _brute(ids, x, min(6, len(x) - 1)).items():
            assert [p for p, _ in got[i]] == [p for p, _ in ref]
            assert np.allclose([d for _, d in got[i]], [d for _, d in ref])


def test_density_needs_k_and_skips_missing(spark):
    rows = [("a", "1", 0.0, 0.0), ("a", "2", 1.0, 0.0), ("a", "3", 0.0, 2.0), ("a", "4", None, 1.0), ("b", "5", 0.0, 0.0), ("b", "6", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, id string, x double, y double")
    out = {r["id"]: r["density"] for r in X.neighbour_density(df, df, ["x", "y"], 2, True).collect()}
    assert sorted(out) == ["1", "2", "3"]
    z = np.array([[0, 0], [1, 0], [0, 2.0]])
    z = (z - z.mean(0)) / z.std(0)
    d = np.linalg.norm(z[0] - z[1:], axis=1).mean()
    assert out["1"] == pytest.approx(1 / (1 + d))


def test_connected_components(spark):
    nodes = spark.createDataFrame([(f"{i:02d}",) for i in range(30)], "id string")
    edges = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(29) if i not in (9, 19)], "a string, b string")
    out = T.connected_components(nodes, edges).toPandas()
    assert out.groupby("comp")["id"].count().to_dict() == {"00": 10, "10": 10, "20": 10}


def test_connected_components_of_a_long_chain_stay_plannable(spark, monkeypatch):
    """Rounds grow with the logarithm of a chain, and no round hands its constraints to the next one."""
    order = np.random.default_rng(4).permutation(400)
    chain = [(f"{a:03d}", f"{b:03d}") for a, b in zip(order[:-1], order[1:])]
    nodes, edges = spark.createDataFrame([(f"{i:03d}",) for i in range(400)], "id string"), spark.createDataFrame(chain, "a string, b string")
    written = []
    monkeypatch.setattr(T, "stored", lambda df, keep=T.stored: written.append(1) or keep(df), raising=False)
    out = T.connected_components(nodes, edges)
    assert out.count() == 400 and {r["comp"] for r in out.collect()} == {"000"}
    assert out._jdf.queryExecution().optimizedPlan().constraints().size() <= 2
    assert 0 < len(written) <= 24


def test_archetypes_find_separated_groups(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.2, (150, 2)), rng.normal(5, 0.2, (90, 2)), rng.uniform(-20, 20, (30, 2))])
    df = spark.createDataFrame([(f"{i:03d}", [float(a) for a in v]) for i, v in enumerate(x)], "id string, v array<double>")
    labels, clusters = T.density_clusters(df, 5, 30, level=0.9)
    got = clusters.orderBy("label").toPandas()
    assert list(got["archetype"]) == ["A", "B"] and np.allclose(np.stack(got["centroid"])[0], 0, atol=0.2)
    pts = spark.createDataFrame([([0.0, 0.0],), ([10.0, -10.0],)], "v array<double>")
    out = T.assign_nearest(pts, clusters).orderBy("distance").collect()
    assert out[0]["label"] == 0 and out[0]["confidence"] > 0 and out[1]["label"] == -1 and out[1]["confidence"] == 0.0
    pairs = labels.select("id", "label", F.col("label").alias("b"))
    assert T.adjusted_rand(pairs, "label", "b").first()["adjusted_rand"] == pytest.approx(1.0)


def test_small_archetypes_stay_in_large_training_sets(spark, monkeypatch):
    from pitscape.plans import geometry_queries as Q

    # 50,000 training reports, far more than 25,000; the archetype of 22 would lose about half of its reports in a sample
    i = F.col("id")
    x = F.when(i < 22, 7.0).otherwise((i % 12).cast("double") / 2)
    points = spark.range(50_000).select(
        F.lpad(i.cast("string"), 6, "0").alias("gvkey"), F.lit(1997).alias("fyear"), i.cast("string").alias("id"),
        F.array(x, *[F.lit(0.0)] * 5).alias("v"), *[(x if c == Q.FEATURES[0] else F.lit(0.0)).alias(c) for c in Q.FEATURES],
    )
    monkeypatch.setattr(Q, "_scaled_points", lambda *_: points)
    out = Q.archetype_assignments(spark, "").groupBy("archetype").agg(F.count("*").alias("n"), F.min("gvkey").alias("first")).collect()
    sizes = {row["archetype"]: row["n"] for row in out}
    assert len(sizes) == 13 and "noise" not in sizes and min(sizes.values()) == 22 and sizes["M"] == 22


def test_search_assigns_like_the_packed_table(spark):
    rng = np.random.default_rng(8)
    centres = spark.createDataFrame([(i, [float(a) for a in v], 0.8) for i, v in enumerate(rng.normal(size=(700, 2)))], "label int, centroid array<double>, radius double")
    pts = spark.createDataFrame([(str(i), [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(300, 2)) * 2)], "id string, v array<double>")
    key = lambda df: sorted((p["id"], p["label"], round(p["confidence"], 9), round(p["distance"], 9)) for p in df.collect())
    assert key(T.assign_by_search(pts, centres)) == key(T.assign_nearest(pts, centres))


def _intervals(n=400, seed=2):
    rng = np.random.default_rng(seed)
    start = rng.integers(30_000, 30_060, n)
    x = rng.normal(size=(n, 2))
    length = np.ceil(rng.exponential(30 * np.exp(-0.7 * x[:, 0]))).astype(int).clip(1, 60)
    return pd.DataFrame({"gvkey": [str(i // 2) for i in range(n)], "entry_day": start, "stop_day": start + length, "event": (length < 60).astype(int) * rng.integers(0, 2, n),
                         "x": x[:, 0], "z": x[:, 1], "risk": np.round(x[:, 0], 1)})


def test_concordance_small_case(spark):
    df = spark.createDataFrame([("a", 0, 10, 1, 3.0), ("b", 0, 20, 1, 2.0), ("c", 0, 30, 0, 1.0)], "gvkey string, entry_day int, stop_day int, event int, risk double")
    out = V.interval_concordance(df, "risk", "event").first()
    assert out["concordance"] == 1.0 and out["pairs"] == 3


def test_concordance_matches_brute_force(spark):
    p = _intervals()
    good = pairs = 0.0
    for _, e in p[p["event"] == 1].iterrows():
        j = p[(p["entry_day"] <= e["stop_day"]) & (e["stop_day"] < p["stop_day"]) & (p["gvkey"] != e["gvkey"])]
        pairs += len(j)
        good += (j["risk"] < e["risk"]).sum() + 0.5 * (j["risk"] == e["risk"]).sum()
    out = V.interval_concordance(spark.createDataFrame(p), "risk", "event").first()
    assert out["pairs"] == pairs and out["concordance"] == pytest.approx(good / pairs)


def test_hazard_fit_is_the_partial_likelihood_optimum(spark):
    p = _intervals()
    df = spark.createDataFrame(p)
    fit = V.fit_hazard(df, ["x", "z"], "event")
    x = (p[["x", "z"]].to_numpy() - fit["mean"]) / fit["scale"]
    t0, t1, ev = p["entry_day"].to_numpy(), p["stop_day"].to_numpy(), p["event"].to_numpy()

    def terms(b):
        g, h, w = np.zeros(2), np.zeros((2, 2)), np.exp(x @ b)
        for i in np.flatnonzero(ev):
            r = (t0 < t1[i]) & (t1[i] <= t1)
            s0, s1 = w[r].sum(), (w[r, None] * x[r]).sum(0)
            g += x[i] - s1 / s0
            h += (x[r].T * w[r]) @ x[r] / s0 - np.outer(s1, s1) / s0**2
        return g, h

    g, h = terms(fit["beta"])
    assert np.abs(g).max() < 1e-6 and fit["beta"][0] > 0.3
    w = np.exp(x @ fit["beta"])
    score = np.zeros_like(x)
    for i in np.flatnonzero(ev):
        r = (t0 < t1[i]) & (t1[i] <= t1)
        s0, bar = w[r].sum(), (w[r, None] * x[r]).sum(0) / w[r].sum()
        score[i] += x[i] - bar
        score[r] -= (w[r] / s0)[:, None] * (x[r] - bar)
    per = pd.DataFrame(score).groupby(p["gvkey"]).sum().to_numpy()
    inv = np.linalg.inv(h)
    cov = inv @ per.T @ per @ inv * (len(per) / (len(per) - 1)) * ((len(x) - 1) / (len(x) - 2))
    assert np.allclose(fit["covariance"], cov, rtol=1e-6)
    assert V.proportionality(df, fit, "event").count() == 2


def test_survival_interval_reasons(spark):
    import datetime as dt
    from dataclasses import replace

    from pitscape.params import DEFAULT

    day = dt.date.fromisoformat
    events = spark.createDataFrame(
        [("f", day("2000-12-31"), 2000, day("2001-06-30"), 3), ("f", day("2001-12-31"), 2001, day("2002-06-30"), 4), ("m", day("2000-12-31"), 2000, day("2001-06-30"), 3),
         ("a", day("2000-12-31"), 2000, day("2001-06-30"), 3)], "gvkey string, datadate date, fyear int, feature_date date, reporting_history int")
    exits = spark.createDataFrame([("f", day("2002-09-15"), "performance_failure", day("2002-09-15")), ("m", day("2001-08-01"), "merger", day("2001-08-01")), ("a", None, None, day("2003-01-01"))],
                                  "gvkey string, exit_date date, exit_category string, last_observed_date date")
    out = V.survival_intervals(events, exits, replace(DEFAULT))
    assert sorted(r["terminal_reason"] for r in out.collect()) == ["administrative_right_censor", "covariate_update", "merger", "performance_failure"]
    assert {r["difference"] for r in V.exit_reconciliation(out).collect()} == {0}


def test_a_query_visits_few_cells(spark, monkeypatch):
    """The rows that a search compares, queries times the cells they visit, stay a few times the queries."""
    monkeypatch.setattr(X, "LEAF", 128)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4)) * rng.lognormal(0, 1, size=(3000, 1))
    ids = np.array([f"{i:04d}" for i in range(len(x))])
    df = spark.createDataFrame([("a", i, [float(a) for a in v]) for i, v in zip(ids, x)], "g string, id string, v array<double>")
    asked, search = [], X._search

    def counted(refs, asks, k):
        asked.append(asks.count())
        return search(refs, asks, k)

    monkeypatch.setattr(X, "_search", counted)
    got = X.nearest(df, df, 5, True).toPandas().sort_values(["id", "rank"])
    assert sum(asked) <= 12 * len(x)
    brute = _brute(ids, x, 5)
    assert {i: list(p["peer"]) for i, p in got.groupby("id")} == {i: [p for p, _ in brute[i]] for i in ids}


def test_rows_of_one_id_share_its_places(spark):
    rows = [("a", f"{i % 20:02d}", [float(i % 20), 0.0]) for i in range(40)]  # every row twice
    df = spark.createDataFrame(rows, "g string, id string, v array<double>")
    got = X.nearest(df, df, 3, True).toPandas()
    assert got.groupby("id").size().tolist() == [3] * 20
    assert got[got["id"] == "00"].sort_values("rank")["peer"].tolist() == ["01", "01", "01"]
