"""Recomputations find what is planted, and nothing else."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from pitscape.operators import audit as U
from pitscape.operators import dynamics as Y
from pitscape.operators import lineage as G
from pitscape.operators import panel as P
from pitscape.operators import recompute as A
from pitscape.operators import returns as N


def month(k):
    y, m = divmod(2000 * 12 + k, 12)
    return (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)) if m < 11 else dt.date(y, 12, 31)


HISTORY = "gvkey string, date date, total_return double, has_delist boolean, delist_return_missing boolean"


def market(spark, seed=1, firms=25, months=30):
    """Histories with gaps, missing returns, total losses, valid and unusable exits, some beyond the calendar."""
    rnd = random.Random(seed)
    rows, events = [], []
    for f in range(firms):
        first, last = rnd.randrange(0, 8), rnd.randrange(12, months + 6)
        out = rnd.random()
        for k in range(first, last):
            final = k == last - 1
            if rnd.random() < 0.03 and not final:
                continue
            ret = None if rnd.random() < 0.03 else rnd.choice([-1.0, -1.2]) if rnd.random() < 0.02 else rnd.uniform(-0.3, 0.4)
            gone = final and out < 0.7
            flagged = gone and out < 0.2
            rows.append((str(f), month(k), None if flagged else ret, gone, flagged))
            if k % 3 == 2:
                events.append((f"{f}|{k}", str(f), month(k)))
    events.append(("late|0", "late", month(3)))
    factors = spark.createDataFrame([(month(k), 0.001 + 0.0001 * (k % 12)) for k in range(months)], "date date, rf double")
    return spark.createDataFrame(events, "event_id string, gvkey string, feature_date date"), spark.createDataFrame(rows, HISTORY), factors


COLUMNS = ["path_months", "target_valid", "target_status", "forward_total_return", "forward_risk_free_return", "forward_excess_return"]


def counts(df):
    return {(r.horizon_months, r.kind): r.rows for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_prefix_targets_equal_paths(spark, seed):
    events, history, factors = market(spark, seed)
    saved = N.forward_targets(N.forward_paths(events, history, factors), ["gvkey"])
    got = counts(A.differences_by_kind(saved, A.targets_by_prefix(events, history, factors), ["event_id", "horizon_months"], COLUMNS, ["horizon_months"]))
    # a security that is not in the history at all has no prefix: its free rate is unknown, everything else agrees
    assert {k: v for k, v in got.items() if v and k[1] != "rows_compared"} == {(h, "forward_risk_free_return"): 1 for h in (1, 3, 6, 12)}
    assert all(got[h, "rows_compared"] == events.count() for h in (1, 3, 6, 12))
    status = {r[0] for r in saved.select("target_status").distinct().collect()}
    assert status == {"complete", "complete_after_delist", "missing_return_path", "missing_delisting_return", "beyond_calendar"}


def test_planted_errors_are_counted(spark):
    events, history, factors = market(spark)
    events = events.where("gvkey <> 'late'")
    saved = N.forward_targets(N.forward_paths(events, history, factors), ["gvkey"]).cache()
    good = sorted(r.event_id for r in saved.where("target_valid and horizon_months = 6").collect())
    bad = saved.withColumn("forward_total_return", F.when((F.col("event_id") == good[0]) & (F.col("horizon_months") == 6), F.col("forward_total_return") + 1e-6).otherwise(F.col("forward_total_return")))
    bad = bad.withColumn("target_status", F.when((F.col("event_id") == good[1]) & (F.col("horizon_months") == 6), "complete?").otherwise(F.col("target_status")))
    bad = bad.where(f"not (event_id = '{good[2]}' and horizon_months = 6)").union(bad.where(f"event_id = '{good[3]}' and horizon_months = 6"))
    got = counts(A.differences_by_kind(bad, A.targets_by_prefix(events, history, factors), ["event_id", "horizon_months"], COLUMNS, ["horizon_months"]))
    assert {k: v for k, v in got.items() if v and k[1] != "rows_compared"} == {
        (6, "forward_total_return"): 1, (6, "target_status"): 1, (6, "only_recomputed"): 1, (6, "repeated_key"): 1,
    }


def test_total_losses_and_signs(spark):
    rows = [("a", month(k), r, False, False) for k, r in enumerate([0.1, -1.0, 0.5, -1.5, -1.5, 0.2])]
    events = spark.createDataFrame([("e0", "a", month(0)), ("e2", "a", month(2)), ("e3", "a", month(3))], "event_id string, gvkey string, feature_date date")
    factors = spark.createDataFrame([(month(k), 0.0) for k in range(6)], "date date, rf double")
    got = {(r.event_id, r.horizon_months): r.forward_total_return for r in A.targets_by_prefix(events, spark.createDataFrame(rows, HISTORY), factors, [1, 2]).collect()}
    assert got["e0", 1] == -1.0 and got["e0", 2] == -1.0
    assert math.isclose(got["e2", 1], -1.5) and math.isclose(got["e2", 2], -0.75) and math.isclose(got["e3", 2], -0.5 * 1.2 - 1)


def test_gap_in_the_calendar_stops(spark):
    events, history, factors = market(spark)
    with pytest.raises(Exception, match="calendar of the factors has a gap"):
        A.targets_by_prefix(events, history, factors.where(F.col("date") != F.lit(month(9)))).collect()


def test_path_gate_finds_what_is_planted(spark):
    events, history, factors = market(spark)
    paths = N.forward_paths(events, history, factors).cache()
    targets = N.forward_targets(paths, ["gvkey"]).cache()
    read = lambda *tables: {r.check: r.violations for r in A.path_gate(*tables).collect() if r.violations}
    assert read(events, paths, targets) == {}
    cash = paths.where("cash_after_delist and not beyond_calendar").first()
    wrong = paths.withColumn("return_used", F.when((F.col("event_id") == cash.event_id) & (F.col("holding_offset") == cash.holding_offset), 0.5).otherwise(F.col("return_used")))
    wrong = wrong.where(f"not (event_id = '{paths.first().event_id}' and holding_offset = 12)")
    invalid = targets.withColumn("forward_total_return", F.when(~F.col("target_valid"), 0.0).otherwise(F.col("forward_total_return")))
    n = targets.where("not target_valid").count()
    assert read(events.union(events.limit(1)), wrong, invalid.where("not (horizon_months = 3 and event_id = 'late|0')")) == {
        "repeated_event": 1, "incomplete_path": 1, "cash_differs_from_rate": 1, "incomplete_ladder": 1, "invalid_with_return": n - 1,
    }


def test_dynamics_gate_finds_what_is_planted(spark):
    rnd = random.Random(3)
    rows = [(str(g), dt.date(2000 + y, 12, 31), 2000 + y, 5, dt.date(2001 + y, 6, 30), y // 3, rnd.random()) for g in range(12) for y in range(8)]
    surface = spark.createDataFrame(rows, "gvkey string, datadate date, fyear int, horizon_years int, feature_date date, fold int, predicted_survival double")
    frame = Y.motion(Y.frontier_position(surface)).cache()
    read = lambda df: {r.check: (r.rows, r.violations) for r in A.dynamics_gate(df).collect()}
    clean = read(frame)
    assert all(v == 0 for _, v in clean.values()) and clean["velocity_inside_a_vintage"][0] == 12 * 5 and clean["velocity_across_vintages"][0] == 12 * 3
    first = (F.col("gvkey") == "3") & (F.col("fyear") == 2001)
    for column, check in (("viability_log_odds", "log_odds"), ("frontier_margin", "frontier_margin"), ("constant_hazard", "constant_hazard"), ("velocity_log_odds", "velocity_inside_a_vintage")):
        bad = read(frame.withColumn(column, F.when(first, F.col(column) + 1e-3).otherwise(F.col(column))))
        assert {k for k, (_, v) in bad.items() if v} == {check} and bad[check][1] == 1
    across = read(frame.withColumn("velocity_log_odds", F.when(F.col("fyear") == 2003, F.lit(0.1)).otherwise(F.col("velocity_log_odds"))))
    assert across["velocity_across_vintages"][1] == 12


def test_eligibility_gates_joins_and_blindness(spark, tmp_path):
    rnd = random.Random(6)
    rows = []
    for i in range(800):
        t = rnd.gauss(0, 1)
        rows.append((f"e{i}", 2002 + i % 17, t + rnd.gauss(0, 1), None if i % 50 == 0 else t + rnd.gauss(0, 4), t, 6, i % 10 != 0, rnd.gauss(0, 1)))
    df = spark.createDataFrame(rows, "event_id string, fyear int, good double, bench double, truth double, horizon_months int, target_valid boolean, forward_total_return double")
    candidates, truth, targets = df.select("event_id", "fyear", "good", "bench"), df.select("event_id", "truth"), df.select("event_id", "horizon_months", "target_valid", "forward_total_return")
    out = {r.candidate: r for r in U.proxy_eligibility(candidates, targets, truth, ["event_id"], "good", "bench", 6).collect()}
    good, bench = out["good"], out["bench"]
    assert all(good[g] is True for g in ("overall_gate", "improvement_gate", "period_gate", "block_gate", "coverage_gate")) and bench.overall_gate is None
    used = [r for r in rows if r[6] and r[3] is not None]
    assert good.eligible_rows == len(used) == bench.eligible_rows
    import pandas as pd

    p = pd.DataFrame(used).rename(columns={1: "y", 2: "g", 4: "t"})
    assert math.isclose(good.held_out_spearman, p[p["y"] >= 2013][["g", "t"]].corr("spearman").iloc[0, 1], abs_tol=1e-12)
    with pytest.raises(Exception, match="an eligible key has no truth"):
        U.proxy_eligibility(candidates, targets, truth.where("event_id <> 'e1'"), ["event_id"], "good", "bench", 6).collect()
    with pytest.raises(Exception, match="repeats a key"):
        U.proxy_eligibility(candidates.union(candidates.limit(1)), targets, truth, ["event_id"], "good", "bench", 6).collect()
    with pytest.raises(Exception, match="no eligible row"):
        U.proxy_eligibility(candidates, targets.where("false"), truth, ["event_id"], "good", "bench", 6).collect()
    targets.write.parquet(f"{tmp_path}/targets.parquet")
    saved = spark.read.parquet(f"{tmp_path}/targets.parquet")
    build = lambda t: lambda: U.proxy_eligibility(candidates, t, truth, ["event_id"], "good", "bench", 6)
    for table, leaks in ((saved, False), (saved.withColumn("target_valid", F.col("forward_total_return") > 0), True)):
        lineage = G.Lineage()
        with lineage.recording():
            columns, used_rows = lineage.of(build(table)())
        assert ("targets.forward_total_return" in frozenset().union(used_rows, *columns.values())) == leaks


def test_a_firm_that_changes_its_security_keeps_its_path(spark):
    d = dt.date
    links = spark.createDataFrame([
        ("f", 1, d(2000, 1, 1), d(2000, 6, 30), "LC", "P"), ("f", 2, d(2000, 7, 1), None, "LC", "P"), ("g", 2, d(2000, 3, 1), None, "LU", "C"),
        ("g", 1, d(2000, 7, 1), d(2001, 12, 31), "LS", "C"), ("x", 3, d(2000, 1, 1), None, "XX", "P"), ("h", 4, d(2000, 9, 1), d(2000, 3, 1), "LC", "P"),
    ], "gvkey string, lpermno long, linkdt date, linkenddt date, linktype string, linkprim string")
    got = sorted((r.permno, r.seg_from, r.seg_to, r.gvkey) for r in P.link_segments(links).collect())
    assert got == [(1, d(2000, 1, 1), d(2000, 6, 30), "f"), (1, d(2000, 7, 1), d(2001, 12, 31), "g"), (2, d(2000, 3, 1), d(2000, 6, 30), "g"), (2, d(2000, 7, 1), None, "f")]
    rows = [(s, month(k), 0.01 * (k + 1) * s, 5.0 * s, 11, 1) for s in (1, 2, 3) for k in range(18)] + [(2, month(18), 0.5, 1.0, 11, 9)]
    months = spark.createDataFrame(rows, "permno long, date date, ret double, market_cap_millions double, shrcd int, exchcd int")
    exits = spark.createDataFrame([], "permno long, dlstdt date, dlret double")
    history = P.dated_return_history(months, exits, links).cache()
    f = {r.date: r for r in history.where("gvkey = 'f'").collect()}
    assert [f[month(k)].permno for k in range(18)] == [1] * 6 + [2] * 12 and month(18) not in f
    g = {r.date: r.permno for r in history.where("gvkey = 'g'").collect()}
    assert [g[month(k)] for k in range(2, 18)] == [2] * 4 + [1] * 12 and history.where("gvkey in ('x', 'h')").isEmpty()
    events = spark.createDataFrame([("e", "f", month(2))], "event_id string, gvkey string, feature_date date")
    factors = spark.createDataFrame([(month(k), 0.0) for k in range(18)], "date date, rf double")
    target = A.targets_by_prefix(events, history, factors, [12]).first()
    assert target.target_valid and math.isclose(target.forward_total_return, math.prod(1 + 0.01 * (k + 1) * (1 if k < 6 else 2) for k in range(3, 15)) - 1)
    both = spark.createDataFrame([("a", 1, d(2000, 1, 1), None, "LC", "P"), ("b", 1, d(2000, 5, 1), d(2000, 5, 10), "LC", "P")], links.schema)
    assert P.dated_return_history(months, exits, both).where("gvkey = 'a'").count() == 18  # the tie holds for no month end
    with pytest.raises(Exception, match="two firms share the best link of security 1"):
        P.dated_return_history(months, exits, both.withColumn("linkenddt", F.lit(None).cast("date"))).collect()


def test_the_larger_security_counts(spark):
    links = spark.createDataFrame([("f", s, dt.date(2000, 1, 1), None, "LC", "P") for s in (1, 2, 3)], "gvkey string, lpermno long, linkdt date, linkenddt date, linktype string, linkprim string")
    rows = [(1, month(0), 0.1, 5.0, 11, 1), (2, month(0), 0.2, 9.0, 11, 1), (3, month(0), 0.3, None, 11, 1), (1, month(1), 0.1, 5.0, 11, 1), (2, month(1), 0.2, 5.0, 11, 1)]
    months = spark.createDataFrame(rows, "permno long, date date, ret double, market_cap_millions double, shrcd int, exchcd int")
    out = P.dated_return_history(months, spark.createDataFrame([], "permno long, dlstdt date, dlret double"), links)
    assert sorted((r.date, r.permno, r.candidates) for r in out.collect()) == [(month(0), 2, 3), (month(1), 1, 2)]
