"""Subgroup metrics by cause, differences of tables with planted ones, refusal of groups without enough peers."""

from __future__ import annotations

import random

import pytest

from pitscape.operators import audit as U
from pitscape.operators import contracts as K
from pitscape.operators import neighbours as N


def test_subgroups_stay_apart_by_cause(spark):
    rnd = random.Random(4)
    rows = [
        (f"f{rnd.randrange(40)}", rnd.randrange(1985, 2005), rnd.randrange(1, 4), cause, rnd.randrange(20) / 20, rnd.randrange(2))
        for cause in ("merger", "failure")
        for _ in range(300)
    ]
    rows += [("f1", 1990, 1, "merger", None, 1), ("f1", 1990, 1, "merger", 0.5, None)]
    got = U.subgroup_metrics(spark.createDataFrame(rows, "gvkey string, year int, sic1 int, cause string, p double, y int"), "p", "y", groups=["cause"])
    seen = 0
    for r in got.collect():
        own = [x for x in rows if x[3] == r["cause"] and x[4] is not None and x[5] is not None]
        own = [x for x in own if r["value"] == (str(x[1] // 10 * 10) if r["dimension"] == "decade" else str(x[2]))]
        pos, neg = [x[4] for x in own if x[5]], [x[4] for x in own if not x[5]]
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert (r["rows"], r["issuers"], r["events"]) == (len(own), len({x[0] for x in own}), len(pos))
        assert r["roc_auc"] == pytest.approx(auc) and r["brier_score"] == pytest.approx(sum((x[4] - x[5]) ** 2 for x in own) / len(own))
        seen += 1
    assert seen == 2 * (3 + 3)


def test_planted_differences_are_counted(spark):
    rows = [(i, i / 7, i % 2 == 0) for i in range(50)]
    other = [*rows[1:10], (10, None, True), (11, 11 / 7 + 1e-9, False), (12, 12 / 7 + 1e-14, False), *rows[13:], (99, 1.0, True)]
    shape = "k int, v double, b boolean"
    got = K.table_differences(spark.createDataFrame(rows, shape), spark.createDataFrame(other, shape), ["k"], ["v", "b"]).first().asDict()
    assert got == {"only_left": 1, "only_right": 1, "diff_v": 2, "diff_b": 1}


def test_too_small_groups_are_refused(spark):
    rows = [("a", str(i), float(i), float(i % 3)) for i in range(6)] + [("b", str(i), float(i), 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id string, x double, y double")
    with pytest.raises(ValueError, match="b"):
        N.peer_edges(df, "g", "id", ["x", "y"], 3)
    assert N.peer_edges(df.filter("g = 'a'"), "g", "id", ["x", "y"], 3).count() == 18
