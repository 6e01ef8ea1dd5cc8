"""Derived tables: money is summed as whole numbers, reports are made once, the panel carries what it is asked for."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from pitscape.operators import describe as E
from pitscape.operators import panel as P
from pitscape.operators import robust as R
from pitscape.plans import ladder_queries, panel_queries, score_queries
from pitscape.sources import derived as D

DAY = dt.datetime(1996, 3, 5)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("star"))
    put = lambda name, rows, shape: spark.createDataFrame(rows, shape).write.parquet(f"{d}/{name}.parquet")
    put("nation", [(0, "N", 0), (1, "M", 1)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(c, c % 2, 100.0) for c in range(1, 31)], "c_custkey long, c_nationkey int, c_acctbal double")
    put("supplier", [(s, s % 2, 5000.0) for s in range(1, 4)], "s_suppkey long, s_nationkey int, s_acctbal double")
    orders = [(o, o % 30 + 1, "OFP"[o % 3], 1000.005 + o, DAY + dt.timedelta(days=o * 7 % 1400)) for o in range(1, 301)]
    put("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp")
    lines = [(o, k, o % 3 + 1, float(40 + o % 10), 60000.005 + 10 * o + k, 0.01 * (o % 11), 0.01 * (k % 9), "RNA"[o % 3], "FO"[k % 2], DAY + dt.timedelta(days=o * 7 % 1400 + 20)) for o in range(1, 301) for k in range(3)]
    lines.append((7, 9, 1, 1.0, None, 0.05, None, "R", "F", None))
    put("lineitem", lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    return d


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sums_of_money_are_whole_numbers_and_equal_those_of_decimals(spark, tables):
    line = spark.read.parquet(f"{tables}/lineitem.parquet")
    ext, tax = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_tax").cast("decimal(4,2)")
    want = line.join(spark.read.parquet(f"{tables}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("o_custkey").cast("string").alias("gvkey"), F.year("o_orderdate").alias("fyear")
    ).agg(F.sum(ext).cast("double").alias("sale"), F.sum(ext * tax).cast("double").alias("dp"), F.sum(F.when(F.col("l_returnflag") == "R", ext * tax)).cast("double").alias("xad"))
    reports = D.reports(spark, tables)
    rows = lambda df: sorted(map(str, df.select("gvkey", "fyear", "sale", "dp", "xad").collect()))
    assert rows(reports) == rows(want) and len(rows(want)) > 30
    for table in (reports, D.security_months(spark, tables), D.factors(spark, tables)):
        sums = re.findall(r"sum\([^\n]*?\) AS", _plan(table))
        assert sums and not re.search(r"sum\([^()]*decimal", _plan(table))
    big = spark.createDataFrame([(2**53 - 1,), (2**53 + 1,), (-(2**62) - 1,), (None,)], "x long").select(D._double(F.col("x"), 2).alias("d")).collect()
    assert [r["d"] for r in big] == [float(f"{2**53 - 1}e-2"), float(f"{2**53 + 1}e-2"), float(f"{-(2**62) - 1}e-2"), None]


def test_panel_carries_only_the_report_columns_asked_for(spark, tables):
    whole, part = panel_queries.build_panel(spark, tables), panel_queries.build_panel(spark, tables, columns=[])
    assert "sale" in whole.columns and "sale" not in part.columns and "ext_f" not in _plan(part)
    keys = ["permno", "date", "gvkey", "fyear", "formation_date", "reporting_history"]
    rows = lambda df: sorted(map(str, df.select(*keys).collect()))
    assert rows(whole) == rows(part) and len(rows(part)) > 0
    first = lambda df: sorted(map(str, P.first_month_per_report(df).select("gvkey", "fyear", "feature_date", "permno").collect()))
    assert first(whole) == first(part.select("permno", "date", *P.REPORT_KEY))


@pytest.mark.parametrize("made", [lambda s, d: ladder_queries.model_matrix(s, d), lambda s, d: score_queries.relative_axes(s, d)])
def test_reports_are_made_once(spark, tables, monkeypatch, made):
    times, plain = [], D.reports
    monkeypatch.setattr(D, "reports", lambda *a: times.append(1) or plain(*a))
    out = made(spark, tables)
    assert len(times) == 1 and "lineitem" not in _plan(out) and out.count() > 0


def test_rank_correlations_carry_a_number_for_each_pair(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0, None), (3.0, 5.0, 1.0), (4.0, 4.0, 0.0)], "a double, b double, c double")
    out = E.correlation_long(df, ["a", "b", "c"], "s")
    got = {(r["left"], r["right"]): (r["n"], round(r["spearman"], 9)) for r in out.collect()}
    assert got == {("a", "b"): (4, 0.6), ("a", "c"): (3, -1.0), ("b", "c"): (3, -0.5)}
    assert all("left" not in m and "right" not in m for m in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", out._jdf.queryExecution().executedPlan().toString()))


def test_events_look_their_levels_up_without_a_shuffle_unless_keys_repeat(spark):
    levels = (("narrow", "a"), ("wide", None))
    rows = [(f"{i}", 2000 + i % 2, "x" if i < 50 else "y" if i < 54 else None, float(i * i % 37), float(i % 5) if i % 3 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, d int, a string, u double, v double")
    score = lambda events: R.relative_scores(df, events, ["u", "v"], "d", levels, ["id"], ["v"])
    plain, twice = score(df), score(df.unionByName(df))
    cells = lambda out: sorted(map(str, out.select("id", "component", "score", "level", "peer_count").collect()))
    assert cells(plain) == cells(twice) and {r["level"] for r in plain.collect()} == {"narrow", "wide"}
    moved = lambda out: "Exchange hashpartitioning" in out._jdf.queryExecution().executedPlan().toString()
    assert moved(twice) and not moved(plain)
    assert {r["level"] for r in plain.filter("component = 'v'").collect()} == {"wide"}
