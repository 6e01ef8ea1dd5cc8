"""Hand-computed cases of the point-in-time panel, components and scores."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitscape.functions import scalars as S
from pitscape.operators import components as C
from pitscape.operators import contracts as K
from pitscape.operators import panel as P
from pitscape.operators import robust as R
from pitscape.params import DEFAULT
from pitscape.sources import sinks, tables

D = lambda s: dt.date.fromisoformat(s) if s else None


def test_availability_sources(spark):
    day = D("2020-12-31")
    reports = spark.createDataFrame(
        [("1", day, 2020, D("2021-03-01")), ("2", day, 2020, D("2021-03-01")), ("3", day, 2020, None), ("4", day, 2020, D("2020-11-01"))],
        "gvkey string, datadate date, fyear int, rdq date",
    )
    filings = spark.createDataFrame([("1", day, 2020, "2021-02-15 16:00:00"), ("4", day, 2020, "2020-12-01 16:00:00")], "gvkey string, datadate date, fyear int, f string").select(
        "gvkey", "datadate", "fyear", F.col("f").cast("timestamp_ntz").alias("filing_timestamp")
    )
    out = {r["gvkey"]: r for r in P.report_availability(reports, filings).collect()}
    assert [out[k]["availability_source"] for k in "1234"] == ["sec_filing_timestamp", "rdq", "datadate_plus_180d", "datadate_plus_180d"]
    assert out["4"]["availability_date"] == dt.datetime(2021, 6, 29) and out["4"]["sec_invalid"] and out["4"]["rdq_invalid"]
    assert out["1"]["formation_date"] == D("2021-02-28")


def test_strict_month_end_and_staleness(spark):
    df = spark.createDataFrame([("2021-02-15 16:00:00",), ("2021-02-28 00:00:00",), ("2021-02-28 16:00:00",)], "t string").select(
        S.strictly_later_month_end(F.col("t").cast("timestamp_ntz")).alias("m")
    )
    assert [r["m"] for r in df.collect()] == [D("2021-02-28"), D("2021-03-31"), D("2021-03-31")]
    df = spark.createDataFrame([(D("2021-08-31"), D("2021-02-28")), (D("2021-09-30"), D("2021-02-28"))], "a date, b date")
    assert [r[0] for r in df.select(S.completed_months("a", "b")).collect()] == [6, 7]


def test_exit_returns(spark):
    months = spark.createDataFrame([(1, D("2020-01-31"), 0.10), (2, D("2020-01-31"), None), (3, D("2020-01-31"), 0.2)], "permno long, date date, ret double")
    exits = spark.createDataFrame([(1, D("2020-01-10"), -0.5), (2, D("2020-01-20"), -0.3), (3, D("2020-01-05"), None)], "permno long, dlstdt date, dlret double")
    out = {r["permno"]: r for r in P.compound_exit_returns(months, exits).collect()}
    assert out[1]["total_return"] == pytest.approx(1.1 * 0.5 - 1) and out[2]["total_return"] == -0.3 and out[3]["delist_return_missing"]
    with pytest.raises(Exception, match="two exits"):
        P.compound_exit_returns(months, exits.unionByName(exits)).collect()


def test_asof_ties_and_no_look_ahead(spark):
    left = spark.createDataFrame([("a", D("2020-03-31")), ("a", D("2020-06-30")), ("b", D("2020-03-31")), ("a", D("2019-12-31"))], "k string, date date")
    rows = [("a", D("2020-03-31"), 1, "old"), ("a", D("2020-03-31"), 2, "new"), ("a", D("2020-05-31"), 3, "mid")]
    right = spark.createDataFrame(rows, "k string, f date, o int, v string")
    ask = lambda r: {(x["k"], x["date"]): x["v"] for x in P.asof_join(left, r, "k", "date", "f", ["v"], ["o"]).collect()}
    out = ask(right)
    assert out[("a", D("2020-03-31"))] == "new" and out[("a", D("2020-06-30"))] == "mid"
    assert out[("b", D("2020-03-31"))] is None and out[("a", D("2019-12-31"))] is None
    later = right.unionByName(spark.createDataFrame([("a", D("2021-01-31"), 9, "future")], right.schema))
    assert ask(later) == out


def test_links_inclusive_open_and_ambiguous(spark):
    months = spark.createDataFrame([(1, D("2020-01-31")), (1, D("2021-12-31"))], "permno long, date date")
    schema = "gvkey string, lpermno long, linkdt date, linkenddt date, linktype string, linkprim string"
    links = spark.createDataFrame([("x", 1, D("2019-05-01"), D("2020-01-31"), "LU", "P"), ("y", 1, D("2020-02-01"), None, "LC", "C"), ("z", 1, D("2019-01-01"), None, "LX", "P")], schema)
    assert {r["date"]: r["gvkey"] for r in P.map_links(months, links).collect()} == {D("2020-01-31"): "x", D("2021-12-31"): "y"}
    bad = links.unionByName(spark.createDataFrame([("w", 1, D("2020-03-01"), None, "LC", "C")], schema))
    with pytest.raises(Exception, match="two firms"):
        P.map_links(months, bad).collect()


def _reports(spark, firms=1):
    rows = []
    for f in range(firms):
        for t in range(5):
            sale = 100.0 * 1.1**t
            rows.append((f"g{f}", D(f"{2000 + t}-12-31"), 2000 + t, sale, 0.6 * sale, 10.0 if t % 2 else None, 20.0, 2.0, 15.0, 8.0, 3.0, 110.0 + t, 22.8, 5.0, 30.0, 5.0, 50.0, 10.0))
    return spark.createDataFrame(rows, "gvkey string, datadate date, fyear int, sale double, cogs double, xrd double, xsga double, xad double, oiadp double, ib double, dp double, at double, ppent double, capx double, dltt double, dlc double, ceq double, che double")


def test_component_formulas(spark):
    out = C.accounting_components(_reports(spark)).orderBy("fyear").toPandas()
    assert np.allclose(out["gross_margin"], 0.4)
    assert pd.isna(out["revenue_cagr_3y"][2]) and out["revenue_cagr_3y"][3] == pytest.approx(0.10)
    assert out["asset_turnover"][1] == pytest.approx(110 / 110) and out["asset_lightness"][4] == pytest.approx(1 - 22.8 / 114)
    stock = 0.0
    for t in range(5):
        stock = stock * 0.8 + (10.0 if t % 2 else 0.0)
        assert out["capitalized_rnd_stock_assets"][t] == pytest.approx(stock / (110 + t))
    assert out["incremental_operating_margin"][1] == pytest.approx(0.0)
    twice = _reports(spark).unionByName(_reports(spark).limit(1))
    with pytest.raises(Exception, match="two reports"):
        C.accounting_components(twice).collect()


def test_stock_with_gap_year(spark):
    out = C.accounting_components(_reports(spark).filter("fyear <> 2002")).orderBy("fyear").toPandas()
    assert out["capitalized_rnd_stock_assets"][2] == pytest.approx((10 + 10 * 0.8**2) / 113)
    assert pd.isna(out["asset_turnover"][2])


def test_relative_score_fallback_and_future_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{i}", D("2020-12-31"), 10 + (i % 3 == 0), 1, float(rng.normal())) for i in range(60)]
    schema = "gvkey string, date date, sic2 int, sic1 int, v double"
    df = spark.createDataFrame(rows, schema)
    levels = (("sic2", "sic2"), ("sic1", "sic1"), ("market", None))
    p = replace(DEFAULT, min_peers=30)
    score = lambda x: R.relative_scores(x, df, ["v"], "date", levels, ["gvkey"], (), p).toPandas().sort_values("gvkey").reset_index(drop=True)
    out = score(df)
    sic2 = {r[0]: r[2] for r in rows}
    assert all(out["level"][i] == ("sic2" if sic2[g] == 10 else "sic1") for i, g in enumerate(out["gvkey"]))
    future = df.unionByName(spark.createDataFrame([("z", D("2021-12-31"), 10, 1, 99.0)], schema))
    pd.testing.assert_frame_equal(score(future), out)


def test_anchored_scores_use_earlier_years_only(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{y}-{i}", D(f"{y}-06-30"), float(rng.normal())) for y in (2018, 2019, 2020) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, feature_date date, v double")
    p = replace(DEFAULT, min_anchor=30)
    out = R.anchored_scores(df, ["v"], ["id"], "feature_date", p).toPandas().set_index("id").sort_index()
    assert out.loc["2018-0", "reference_count"] == 0 and pd.isna(out.loc["2018-0", "score"])
    assert out.loc["2020-3", "reference_count"] == 80 and out.loc["2020-3", "reference_end_year"] == 2019
    pdf = pd.DataFrame(rows, columns=["id", "d", "v"]).set_index("id")
    ref = pdf[pdf.index.str[:4] < "2020"]["v"]
    med, mad = ref.median(), (ref - ref.median()).abs().median()
    v = np.clip(pdf.loc["2020-3", "v"], ref.quantile(0.01), ref.quantile(0.99))
    assert out.loc["2020-3", "score"] == pytest.approx(np.clip((v - med) / (1.4826 * mad), -5, 5))
    more = df.unionByName(spark.createDataFrame([("2025-0", D("2025-01-31"), 50.0)], df.schema))
    again = R.anchored_scores(more, ["v"], ["id"], "feature_date", p).toPandas().set_index("id").sort_index().drop("2025-0")
    pd.testing.assert_frame_equal(again, out)


def test_ratios_and_labels(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, -2.0), (3.0, 2.0)], "n double, d double")
    out = df.select(S.positive_ratio("n", "d"), S.finite_ratio("n", "d")).collect()
    assert [tuple(r) for r in out] == [(None, None), (None, -0.5), (1.5, 1.5)]
    idx = spark.createDataFrame([(0,), (25,), (26,), (-1,)], "i int")
    assert [r[0] for r in idx.select(S.letter_label("i")).collect()] == ["A", "Z", "AA", None]


def test_checked_join_and_differences(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0)], "k int, x double")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, y string")
    assert K.checked_join(a, b.limit(1), ["k"], "left", "one_to_one").count() == 3
    with pytest.raises(Exception, match="repeats a key"):
        K.checked_join(a, b, ["k"], "left", "many_to_one").collect()
    c = spark.createDataFrame([(1, 1.0 + 1e-6), (3, 9.0)], "k int, x double")
    d = K.table_differences(a.filter("k is not null"), c, ["k"], ["x"]).first()
    assert (d["only_left"], d["only_right"], d["diff_x"]) == (1, 1, 1)


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).selectExpr("id", "id * 0.5 as x", "date_add(date'2020-01-01', cast(id as int)) as day")
    a, b = K.fingerprint(df, "t").first(), K.fingerprint(df.orderBy(F.desc("id")).repartition(7), "t").first()
    assert a == b and a["rows"] == 100 and a["date_ranges"][0]["high"] == "2020-04-09"


def test_sources_and_sinks(spark, tmp_path):
    fac = spark.createDataFrame([(D("2020-01-31"), 0.1, 0.0, 0.0, 0.0, 0.0, float("nan"), 0.001)], tables.RAW_SCHEMAS["factor_returns"])
    sinks.write_parquet(fac, str(tmp_path / "factor_returns.parquet"))
    out = tables.read_raw_bundle(spark, str(tmp_path), ["factor_returns", "truth"])
    assert list(out) == ["factor_returns"] and out["factor_returns"].first()["mom"] is None
    with pytest.raises(FileNotFoundError):
        tables.read_raw_bundle(spark, str(tmp_path), ["funda"])
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_parquet(fac, str(tmp_path / "factor_returns.parquet"))
    sinks.write_csv(spark.createDataFrame([(D("2020-01-31"), True)], "d date, ok boolean"), str(tmp_path / "c"))
    assert tables.read_small_csv(spark, str(tmp_path / "c"), "d date, ok boolean").first() == (D("2020-01-31"), True)
    u = tables.union_scenarios({"a": fac, "b": fac})
    assert u.columns[0] == "scenario" and u.count() == 2
