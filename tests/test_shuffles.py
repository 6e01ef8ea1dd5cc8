"""What return and cost operators move between tasks: unfolded months stay with their security."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from pitscape.operators import costs as K
from pitscape.operators import returns as N

MONTHS = [dt.date(2000, 1, 31), dt.date(2000, 2, 29), dt.date(2000, 3, 31)]
PATH = "event_id string, gvkey string, holding_offset int, holding_date date, return_used double, path_valid_through_month boolean, cash_after_delist boolean, valid_delist_event boolean, rf double, beyond_calendar boolean"
ASSIGNED = "event_id string, gvkey string, feature_date date, horizon_months int, signal string, weighting string, industry_neutral boolean, leg string, weight double"


def _moved(df):
    """Keys of the shuffles of a plan."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def _inputs(spark):
    paths = [(e, g, k, MONTHS[k], x * k, True, False, False, 0.0, False) for e, g, x in [("A|0", "A", 0.1), ("B|0", "B", -0.2)] for k in (1, 2)]
    assigned = [(e, g, MONTHS[0], 2, "s", "equal", False, leg, 1.0) for e, g, leg in [("A|0", "A", "long"), ("B|0", "B", "short")]]
    return spark.createDataFrame(assigned, ASSIGNED), spark.createDataFrame(paths, PATH)


def test_months_of_a_security_are_unfolded_and_summed_in_one_place(spark):
    assigned, paths = _inputs(spark)
    positions = N.cohort_positions(assigned, paths)
    names = positions.groupBy(*N.STRATEGY, "holding_date", "gvkey").agg(F.sum("weight"))
    assert [re.sub(r"#\w+", "", m).split(",")[0] for m in _moved(names)] == ["gvkey"]
    plain = N.cohort_positions(assigned.drop("gvkey"), paths)  # meets its path by a join
    rows = lambda df: sorted(map(tuple, df.select("event_id", "holding_offset", "holding_date", "leg", "weight", "return_used").collect()))
    assert rows(positions) == rows(plain) and len(rows(plain)) == 4
    month = {r["holding_date"]: r for r in N.monthly_portfolios(positions).collect()}
    assert month[MONTHS[1]]["long_short_return"] == pytest.approx(0.3) and month[MONTHS[1]]["turnover"] == pytest.approx(1.0)
    assert month[MONTHS[2]]["long_short_return"] == pytest.approx(0.6) and month[MONTHS[2]]["turnover"] == pytest.approx(0.0)
    with pytest.raises(Exception, match="no return path"):
        N.cohort_positions(assigned, paths.filter("gvkey = 'A'")).collect()


def test_repeated_assignments_and_months_all_meet(spark):
    assigned, paths = _inputs(spark)
    twice = N.cohort_positions(assigned.unionByName(assigned), paths.unionByName(paths))
    plain = N.cohort_positions(assigned.unionByName(assigned).drop("gvkey"), paths.unionByName(paths))
    assert twice.count() == plain.count() == 16


def test_event_is_shuffled_once_for_its_path(spark):
    events = spark.createDataFrame([("A|0", "A", MONTHS[0]), ("N|0", None, MONTHS[0])], "event_id string, gvkey string, feature_date date")
    past = [("A", MONTHS[1], 0.1, False, False), ("A", MONTHS[2], 0.2, False, False), ("A", MONTHS[2], 0.3, False, False), (None, MONTHS[1], 0.5, False, False)]
    history = spark.createDataFrame(past, "gvkey string, date date, total_return double, has_delist boolean, delist_return_missing boolean")
    factors = spark.createDataFrame([(m, 0.0) for m in MONTHS], "date date, rf double")
    out = N.forward_paths(events, history, factors)
    seen = {(r["event_id"], r["holding_offset"], r["return_used"]) for r in out.filter("holding_offset <= 2").collect()}
    # a month that repeats is two rows of the path, a name that is missing has no past
    assert seen == {("A|0", 1, 0.1), ("A|0", 2, 0.2), ("A|0", 2, 0.3), ("N|0", 1, None), ("N|0", 2, None)}
    assert all(re.sub(r"#\w+", "", m).split(",")[0] == "gvkey" and "event_id" not in m for m in _moved(out))


def test_turnover_and_costs_move_positions_by_security_only(spark):
    at = "horizon_months int, signal string, weighting string, industry_neutral boolean, delay_months int, holding_date date"
    calendar = spark.createDataFrame([(6, "s", "equal", False, 0, m, 1, 0.0) for m in MONTHS[:2]], f"{at}, active_cohorts long, rf double")
    rows = [(6, "s", "equal", False, 0, MONTHS[0], 1, 0.5, 0.01, False, 0.1, 0.0, 0.0), (6, "s", "equal", False, 0, MONTHS[1], 1, 0.2, 0.02, False, 0.1, 0.0, 0.0)]
    positions = spark.createDataFrame(rows, f"{at}, permno long, actual_weight double, half_spread double, forced_exit boolean, return_used double, borrow_annual_bps double, rf double")
    out = K.costed_months(positions, calendar)
    assert not [m for m in _moved(out) if "permno" in m and not m.startswith("permno")]
    low = {r["holding_date"]: r for r in out.filter("cost_case = 'low'").collect()}
    assert low[MONTHS[0]]["turnover"] == pytest.approx(0.25) and low[MONTHS[1]]["turnover"] == pytest.approx(0.15)
    assert low[MONTHS[1]]["transaction_cost"] == pytest.approx(0.3 * (0.5 * 0.02 + 0.0005))


def test_sorts_carry_the_columns_asked_for(spark):
    rows = [(f"{i}", str(i), MONTHS[0], 6, True, 0.1, 1.0 + i, 1 + i % 2, float(i), "x" * 50) for i in range(60)]
    targets = spark.createDataFrame(rows, "event_id string, gvkey string, feature_date date, horizon_months int, target_valid boolean, forward_excess_return double, market_cap_millions double, sic1 int, s double, note string")
    keys = ["event_id", "weighting", "industry_neutral", "quantile", "weight"]
    whole, part = N.portfolio_sorts(targets, ["s"]), N.portfolio_sorts(targets, ["s"], carried=["gvkey"])
    assert "note" in whole.columns and "note" not in part.columns and "gvkey" in part.columns
    assert sorted(map(tuple, whole.select(*keys).collect())) == sorted(map(tuple, part.select(*keys).collect())) and part.count() > 0


def test_finished_shuffles_of_working_tables_are_dropped(spark):
    from pitscape.session import cut, stored

    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    plain = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    twice = plain.join(plain.withColumnRenamed("n", "m"), "k")
    assert twice.count() == 10  # a plan that is still in use keeps its shuffles
    held = tracker.shuffleStatuses().size()
    for keep in (cut, stored):
        assert keep(twice).count() == 10
        left = tracker.shuffleStatuses().size() - held
        assert left <= 1, f"{left} shuffles of {keep.__name__} are still there"  # of the count
        held += left
    assert twice.count() == 10


def test_a_search_places_its_rows_without_moving_them(spark):
    from pitscape.operators import neighbours as X

    rows = spark.createDataFrame([("a", f"{i:04d}", [float(i), float(i * 7 % 13)]) for i in range(60)], "g string, id string, v array<double>")
    trees = spark.createDataFrame([("a", [0, 1, 1], [29.0, 6.0, 6.0])], "g string, axis array<int>, at array<double>")
    placed = X._placed(rows, trees)
    assert {r["id"]: r["cell"] for r in placed.collect()} == {f"{i:04d}": 2 * (i > 29) + (i * 7 % 13 > 6) for i in range(60)}
    assert not _moved(placed)


def test_recall_of_lists_is_that_of_edges(spark):
    from pitscape.operators import neighbours as X

    rows = spark.createDataFrame([("a", f"{i:02d}", i * i % 17 / 3, i * 5 % 11 / 7) for i in range(30)], "g string, id string, x double, y double")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = []
    for lists in (False, True):
        seen, true = (X.peer_edges(rows, "g", "id", c, 4, **({"lists": True} if lists else {})) for c in (["x"], ["x", "y"]))
        out.append(sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in X.peer_recall(seen, true, sizes, 4).collect()))
    assert len(out[0]) == 30 and out[0] == out[1]
