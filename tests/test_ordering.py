"""Exact order statistics against numpy and pandas, with a hot group and heavy ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitscape.functions import ordering as O
from pitscape.operators import describe as E
from pitscape.operators import robust as R


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    v = rng.normal(0, 100, n)
    v[rng.random(n) < 0.3] = 0.0
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 20, n).astype(str)), "v": v})
    pdf.loc[::17, "v"] = None
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).persist()


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    out = O.quantiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.99}).toPandas().set_index("g").sort_index()
    ref = pdf.dropna().groupby("g")["v"].quantile([0.01, 0.5, 0.99]).unstack()
    assert np.allclose(out[["a", "b", "c"]].to_numpy(), ref.to_numpy(), atol=1e-12)


def test_group_statistics_match_pandas(skewed):
    pdf, df = skewed
    out = R.group_statistics(df, ["g"], "v").toPandas().set_index("g").sort_index()
    g = pdf.dropna().groupby("g")["v"]
    mad = g.apply(lambda x: (x - x.median()).abs().median())
    assert (out["n"] == g.count()).all()
    assert np.allclose(out["mad"], mad) and np.allclose(out["std"], g.std(ddof=0))


def test_average_rank_matches_pandas(skewed):
    pdf, df = skewed
    out = O.with_average_rank(df, ["g"], "v", "rk").toPandas().set_index("id").sort_index()
    ref = pdf.groupby("g")["v"].rank(method="average")
    assert np.allclose(out["rk"], ref, equal_nan=True)


def test_row_number_total_order(skewed):
    pdf, df = skewed
    out = O.with_row_number(df.filter(F.col("v").isNotNull()), ["g"], F.col("v"), "id", "rn").toPandas()
    ref = pdf.dropna().assign(k=lambda x: x["id"].astype(str)).sort_values(["g", "v", "k"])
    ref["rn"] = ref.groupby("g").cumcount() + 1
    assert (out.set_index("id")["rn"].sort_index() == ref.set_index("id")["rn"].sort_index()).all()


def test_row_number_splits_ties_and_equal_prefixes(spark):
    """One tied value, ids that begin alike: no task sorts more than a few ranges."""
    df = spark.range(40_000).select(F.lit("g").alias("g"), F.lit(7.5).alias("v"), F.format_string("same%08d", "id").alias("tie"), "id")
    out = O.with_row_number(df, ["g"], F.col("v"), "tie", "rn", "n").cache()
    assert out.filter((F.col("rn") != F.col("id") + 1) | (F.col("n") != 40_000)).isEmpty() and out.count() == 40_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join ranges as small as these
    try:
        largest = O._by_range(df, ["g"], F.col("v"), "tie").groupBy("__range").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert largest < 15_000


def test_order_code_is_monotone(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 10.0**e, 200) for e in range(-8, 9)] + [[0.0, 5e-324, -5e-324, 1e308, -1e308]])
    rows = spark.createDataFrame(pd.DataFrame({"v": v})).withColumn("c", O.order_code(F.col("v"))).orderBy("v").toPandas()
    assert (rows["c"].diff().dropna() >= 0).all()


def test_top_fraction_exact_and_null(spark):
    rows = [(1, str(i), float(i - 15) if i else None) for i in range(31)]
    df = spark.createDataFrame(rows, "y int, gvkey string, s double")
    out = O.top_fraction(df, ["y"], "s", "gvkey", 0.1, "hit").filter("hit").toPandas()
    assert sorted(out["s"].abs()) == [14.0, 14.0, 15.0]


def test_with_previous_crosses_blocks(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 400), "t": np.arange(400), "s": rng.integers(0, 5, 400)})
    out = O.with_previous(spark.createDataFrame(pdf), ["k"], ["t"], ["s", "t"], F.floor(F.col("t") / 7)).toPandas().sort_values("t")
    assert np.allclose(out["previous_s"].to_numpy(float), pdf.groupby("k")["s"].shift().to_numpy(float), equal_nan=True)


def test_result_does_not_depend_on_partitions(spark, skewed):
    _, df = skewed
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(O.quantiles(df.repartition(int(n)), ["g"], "v", {"m": 0.37}).toPandas().sort_values("g")["m"].to_numpy())
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert (results[0] == results[1]).all()


def test_spearman_and_null_under_three(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": ["a"] * 200 + ["b"] * 2, "x": rng.integers(0, 9, 202).astype(float), "y": rng.normal(size=202)})
    out = E.spearman(spark.createDataFrame(pdf), ["g"], "x", "y").toPandas().set_index("g")["spearman"]
    a = pdf[pdf["g"] == "a"]
    assert out["a"] == pytest.approx(a["x"].rank().corr(a["y"].rank())) and pd.isna(out["b"])


def test_prediction_metrics_brute_force(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(300), 2) * 0.98 + 0.01
    y = (rng.random(300) < p).astype(int)
    m = E.prediction_metrics(spark.createDataFrame(pd.DataFrame({"g": "a", "p": p, "y": y})), ["g"], "p", "y").toPandas().iloc[0]
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert m["roc_auc"] == pytest.approx(auc) and m["brier_score"] == pytest.approx(np.mean((y - p) ** 2))
    bins = pd.qcut(pd.Series(p), 10, duplicates="drop")
    t = pd.DataFrame({"y": y, "p": p}).groupby(bins, observed=True).agg(n=("y", "size"), a=("y", "mean"), q=("p", "mean"))
    assert m["expected_calibration_error"] == pytest.approx(float((t["n"] / 300 * (t["a"] - t["q"]).abs()).sum()))


def test_logit_line_recovers_gradient_zero(spark):
    rng = np.random.default_rng(8)
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.3 + 1.7 * s)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 500 + ["one"] * 3, "s": np.append(s, [1.0, 2.0, 3.0]), "y": np.append(y, [1, 1, 1])}))
    out = E.fit_logit_line(df, ["g"], "s", "y").toPandas().set_index("g")
    mu = 1 / (1 + np.exp(-(out.loc["a", "intercept"] + out.loc["a", "slope"] * s)))
    assert abs((y - mu).sum()) < 1e-6 and abs(((y - mu) * s).sum()) < 1e-6
    assert tuple(out.loc["one", ["intercept", "slope"]]) == (0.0, 1.0)


def test_holm_and_student(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, t string, p double")
    out = {r["t"]: r["holm_p"] for r in E.holm(df, ["f"], "p", "t").collect()}
    assert out == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})
    assert E.student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert E.student_two_sided(12.7062047, 1) == pytest.approx(0.05, abs=1e-6)


def test_vif_of_independent_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 0] + 0.1 * x[:, 1]}))
    out = E.variance_inflation(df, ["a", "b"], "s").toPandas()
    assert (out["vif"] < 1.05).all()


def test_statistics_of_few_groups_write_no_rows(spark, monkeypatch):
    """Where groups are few, what is written is a table of the groups, and the code counts decide which rows move."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.lognormal(0, 3, 3000) * rng.choice([-1, 1], 3000), np.repeat([0.0, 2.5], 400)])
    df = spark.createDataFrame([(f"g{i % 2}", float(a)) for i, a in enumerate(x)], "g string, v double")
    written, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda frame: written.append(frame.count()) or cut(frame))
    few = R.group_statistics(df, ["g"], "v").toPandas().set_index("g")
    assert max(written) == 2
    monkeypatch.setattr(R, "FEW_GROUPS", 1)  # the other way, for many groups
    many = R.group_statistics(df, ["g"], "v").toPandas().set_index("g")
    for i in range(2):
        part = x[i::2]
        want = {"n": len(part), "median": np.median(part), "lower": np.quantile(part, 0.01), "upper": np.quantile(part, 0.99),
                "std": part.std(), "mad": np.median(np.abs(part - np.median(part)))}
        for name, value in want.items():
            assert few.loc[f"g{i}", name] == pytest.approx(value) == many.loc[f"g{i}", name]
