"""Recomputed labels, folds and metrics: no difference on random data, planted ones found."""

import datetime as dt
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from pitscape.operators import describe as E
from pitscape.operators import labels as L
from pitscape.operators import recompute as A
from pitscape.operators import relabel as B
from pitscape.params import DEFAULT

COLUMNS = ["failure_within_horizon", "label_status", "censor_reason", "horizon_end", "label_observed_date"]
KEY = ["gvkey", "fyear", "horizon_years"]
P = replace(DEFAULT, horizons_years=(1, 2), validation_years=2, test_windows=((2006, 2007), (2008, 2009)))
END = dt.date(2009, 12, 31)


def market(spark):
    rng = np.random.default_rng(8)
    day = lambda: dt.date(2000, 1, 1) + dt.timedelta(days=int(rng.integers(0, 3650)))
    events, exits, seen = [], [], []
    for g in range(120):
        days = sorted({day() for _ in range(5)})
        if g % 10 == 0:
            days = [dt.date(2004, 2, 29), dt.date(2005, 2, 28)]
        events += [(str(g), 1000 + i, t) for i, t in enumerate(days)]
        # exits on an event's day, on a horizon's end, without a category, and none
        x = {0: days[0], 1: days[0].replace(day=min(days[0].day, 28), year=days[0].year + 1), 2: day(), 3: None}[g % 4]
        exits.append((str(g), x, [None, "performance_failure", "merger"][g % 3] if x else None))
        if g % 7:
            seen.append((str(g), x or day()))
    frames = spark.createDataFrame(events, "gvkey string, fyear int, feature_date date"), spark.createDataFrame(exits, "gvkey string, exit_date date, exit_category string"), spark.createDataFrame(seen, "gvkey string, last_observed_date date")
    return frames


def saved_labels(events, exits, seen):
    return L.fixed_horizon_labels(events, L.single_exit(exits), seen, END, P.horizons_years)


def differing(table, by=()):
    return {(*[r[b] for b in by], r.kind): r["rows"] for r in table.collect() if r["rows"] and r.kind != "rows_compared"}


def test_labels(spark):
    events, exits, seen = market(spark)
    again = B.labels_by_sweep(events, exits, seen, F.lit(END), P.horizons_years)
    saved = saved_labels(events, exits, seen).cache()
    assert {r.label_status for r in saved.collect()} == {"observed", "censored"} and saved.select("censor_reason").distinct().count() == 4
    assert differing(A.differences_by_kind(saved, again, KEY, COLUMNS, ["horizon_years"])) == {}
    one = saved.filter("failure_within_horizon = 1 and horizon_years = 2").first()
    bad = saved.withColumn("failure_within_horizon", F.when((F.col("gvkey") == one.gvkey) & (F.col("fyear") == one.fyear) & (F.col("horizon_years") == 2), 0).otherwise(F.col("failure_within_horizon")))
    assert differing(A.differences_by_kind(bad, again, KEY, COLUMNS, ["horizon_years"]), ["horizon_years"]) == {(2, "failure_within_horizon"): 1}
    assert B.labels_by_sweep(events.limit(0), exits, seen, F.lit(END), P.horizons_years).count() == 0


def test_folds(spark):
    events, exits, seen = market(spark)
    labels = saved_labels(events, exits, seen).withColumn("event_year", F.year("feature_date")).cache()
    saved = L.assign_folds(labels, L.fold_table(spark, 2000, P)).cache()
    again = B.folds_by_rule(labels, 2000, p=P)
    key = [*KEY, "fold"]
    assert {r.role for r in saved.collect()} == {"train", "validation", "test"}
    assert differing(A.differences_by_kind(saved, again, key, ["role"])) == {}
    late = saved.withColumn("role", F.when(F.col("role") == "validation", "train").otherwise(F.col("role")))
    assert differing(A.differences_by_kind(late, again, key, ["role"])) == {("role",): saved.filter("role = 'validation'").count()}


def test_metrics(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(p), int(rng.random() < p)) for g, p in zip(rng.integers(0, 3, 900), rng.random(900) ** 3)]
    rows += [(3, 0.25, int(i % 3 == 0)) for i in range(40)] + [(4, float(p), 1) for p in rng.random(20)]
    rows += [(5, float(p), y) for p, y in ((0.0, 0), (1.0, 1), (0.5, 0), (np.nextafter(0.5, 1), 1), (0.5, 1), (np.nextafter(0.5, 0), 0))] + [(6, 0.3, 1)]
    df = spark.createDataFrame(rows, "g int, p double, y int").unionByName(spark.createDataFrame([(0, None, 1), (None, 0.5, 1)], "g int, p double, y int")).repartition(6)
    saved, again = E.prediction_metrics(df, ["g"], "p", "y").cache(), B.metrics_by_position(df, ["g"], "p", "y").cache()
    names = [c for c in again.columns if c != "g"]
    assert differing(A.differences_by_kind(saved, again, ["g"], names)) == {} and again.count() == 7
    got = {r.g: r for r in again.collect()}
    y, p = np.array([x[2] for x in rows if x[0] == 1]), np.array([x[1] for x in rows if x[0] == 1])
    pairs = np.sign(p[y == 1][:, None] - p[y == 0][None, :])
    assert np.isclose(got[1].roc_auc, (pairs.mean() + 1) / 2, rtol=1e-12) and got[4].roc_auc is None
    bad = saved.withColumn("brier_score", F.when(F.col("g") == 2, F.col("brier_score") + 1e-6).otherwise(F.col("brier_score")))
    assert differing(A.differences_by_kind(bad, again, ["g"], names, ["g"]), ["g"]) == {(2, "brier_score"): 1}
