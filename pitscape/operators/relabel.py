"""Labels, folds and metrics of the risk models once more, by other means than those that made them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitscape.functions import scalars as S
from pitscape.functions.ordering import known_keys
from pitscape.params import DEFAULT, Params


def years_later(day: Column, years: Column) -> Column:
    """The same day of the month some years on, 29 February falling back, from the parts of the date."""
    first = F.make_date(F.year(day) + years, F.month(day), F.lit(1))
    return F.make_date(F.year(day) + years, F.month(day), F.least(F.dayofmonth(day), F.dayofmonth(F.last_day(first))))


def labels_by_sweep(events: DataFrame, exits: DataFrame, followup: DataFrame, sample_end: Column, horizons: Sequence[int], key: Sequence[str] = ("gvkey", "fyear")) -> DataFrame:
    """(key, horizon, label columns) from running counts on one calendar of exits, ends of observation and probes.

    Exits are counted before a probe of the same day and ends of observation after it, so the difference of two probes is what
    happened in (t, t+h]. A firm's calendar holds its dates only; probes are looked up by (firm, day), and no exit is compared with
    an event. Same columns and meaning as ``fixed_horizon_labels``: a firm without exit or without follow-up just adds no mark.
    """
    key = list(key)
    each = events.select(*key, "feature_date").withColumn("horizon_years", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    each = each.withColumn("horizon_end", years_later(F.col("feature_date"), F.col("horizon_years")))
    none, no_day = F.lit(0), F.lit(None).cast("date")

    def marks(df: DataFrame, day: str, place: int, failure: Column = none, other: Column = none, ended: Column = none, exit_day: Column = no_day) -> DataFrame:
        return df.filter(F.col(day).isNotNull()).select(
            "gvkey", F.col(day).alias("day"), F.lit(place).alias("place"), failure.alias("failure"), other.alias("other"), ended.alias("ended"), exit_day.alias("exit_day")
        )

    failed = F.coalesce(F.col("exit_category") == "performance_failure", F.lit(False)).cast("int")
    probes = each.select("gvkey", F.explode(F.array("feature_date", "horizon_end")).alias("day")).distinct()
    calendar = (
        marks(exits, "exit_date", 0, failed, 1 - failed, none, F.col("exit_date"))
        .unionByName(marks(probes, "day", 1))
        .unionByName(marks(followup, "last_observed_date", 2, ended=F.lit(1)))
    )
    so_far = W.partitionBy("gvkey").orderBy("day", "place").rangeBetween(W.unboundedPreceding, 0)
    swept = calendar.withColumns(
        {c: F.sum(c).over(so_far) for c in ("failure", "other", "ended")} | {"exit_day": F.max("exit_day").over(so_far), "ends": F.sum("ended").over(W.partitionBy("gvkey"))}
    ).filter("place = 1")
    at = lambda day, name: swept.select("gvkey", F.col("day").alias(day), F.struct("failure", "other", "ended", "ends", "exit_day").alias(name))
    both = each.join(at("feature_date", "a"), ["gvkey", "feature_date"], "left").join(at("horizon_end", "b"), ["gvkey", "horizon_end"], "left")
    failure = F.coalesce(F.col("b.failure") > F.col("a.failure"), F.lit(False))
    other = F.coalesce(F.col("b.other") > F.col("a.other"), F.lit(False))
    followed = F.coalesce((F.col("b.ends") > 0) & (F.col("b.ended") == 0), F.lit(False))
    label = F.when(failure, 1).when(~other & followed, 0)
    reason = (
        F.when(label.isNotNull(), "none").when(other, "competing_exit")
        .when(F.col("horizon_end") > sample_end, "administrative_right_censor").otherwise("lost_followup")
    )
    return both.select(
        *key, "horizon_years", "horizon_end", label.cast("int").alias("failure_within_horizon"), F.when(label.isNotNull(), "observed").otherwise("censored").alias("label_status"),
        reason.alias("censor_reason"), F.when(failure | other, F.col("b.exit_day")).when(label == 0, F.col("horizon_end")).alias("label_observed_date"),
    )


def folds_by_rule(labels: DataFrame, start_year: int, key: Sequence[str] = ("gvkey", "fyear"), p: Params = DEFAULT) -> DataFrame:
    """(key, horizon, fold, role) of every observed label from its year alone, counted back from the test windows."""
    year, h = F.col("event_year"), F.col("horizon_years")
    folds = []
    for i, (first, last) in enumerate(p.test_windows, 1):
        ahead = F.lit(first) - year  # years before the test window
        role = (
            F.when((ahead <= 0) & (year <= last), "test").when(ahead.between(h + 1, h + p.validation_years), "validation")
            .when((ahead >= 2 * h + p.validation_years + 1) & (year >= start_year), "train")
        )
        folds.append(F.struct(F.lit(i).alias("fold"), role.alias("role")))
    each = labels.filter(F.col("failure_within_horizon").isNotNull()).select(*key, "horizon_years", "event_year", F.explode(F.array(*folds)).alias("f"))
    return each.select(*key, "horizon_years", F.col("f.fold").alias("fold"), F.col("f.role").alias("role")).filter(F.col("role").isNotNull())


#: base-256 digits that hold every double from 1e-6 to 1 exactly (53 bits below the first of 20 leading zeros)
_DIGITS = 10


def _digits(value: str) -> Column:
    """Base-256 digits of a number in [0, 1), exact: scaling by 256 and cutting the whole part round nothing."""
    start = F.struct(F.col(value).alias("rest"), F.array().cast("array<int>").alias("digits"))

    def step(s: Column, _: Column) -> Column:
        whole = F.floor(s["rest"] * 256)
        return F.struct((s["rest"] * 256 - whole).alias("rest"), F.concat(s["digits"], F.array(whole.cast("int"))).alias("digits"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_DIGITS)), start, step, lambda s: s["digits"])


def positions(df: DataFrame, keys: Sequence[str], probability: str, outcome: str, eps: float = 1e-6) -> DataFrame:
    """One row per (keys, probability ``p``): ``n``, ``pos``, and how many rows and events of the group lie below.

    A value lies below another from the first digit in which they differ; so each value meets, digit by digit, the at most 256
    siblings of its prefix, and no group is ever sorted.
    """
    keys = list(keys)
    base = known_keys(df, *keys, probability, outcome).withColumn("p", S.clip(F.col(probability), eps, 1 - eps))
    counted = base.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("long")).alias("pos"))
    spread = counted.withColumn("__d", _digits("p")).select("*", F.posexplode("__d").alias("level", "digit"))
    spread = spread.withColumn("prefix", F.array_join(F.slice("__d", F.lit(1), F.col("level")), ".")).drop("__d")
    siblings = spread.groupBy(*keys, "level", "prefix", "digit").agg(F.sum("n").alias("__n"), F.sum("pos").alias("__pos"))
    lower = W.partitionBy(*keys, "level", "prefix").orderBy("digit").rowsBetween(W.unboundedPreceding, -1)
    below = siblings.select(*keys, "level", "prefix", "digit", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("nb"), F.coalesce(F.sum("__pos").over(lower), F.lit(0)).alias("pb"))
    return spread.join(below, [*keys, "level", "prefix", "digit"]).groupBy(*keys, "p", "n", "pos").agg(F.sum("nb").alias("n_below"), F.sum("pb").alias("pos_below"))


def metrics_by_position(df: DataFrame, keys: Sequence[str], probability: str, outcome: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """The columns of ``prediction_metrics`` from positions of values; pair counts instead of ranks for the AUC, one look-up per bin edge."""
    keys = list(keys)
    table = positions(df, keys, probability, outcome, eps)
    total = table.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sum("pos").alias("events"))
    t = table.join(total, keys)
    n, pos, p = F.col("n").cast("double"), F.col("pos").cast("double"), F.col("p")
    neg, neg_below = n - pos, F.col("n_below") - F.col("pos_below")
    misses = (F.col("rows") - F.col("events")).cast("double")
    rank, half = F.col("n_below") + (n + 1) / 2, (F.col("rows") + 1) / 2
    sums = t.groupBy(*keys, "rows", "events").agg(
        F.sum(pos * neg_below + pos * neg / 2).alias("__pairs"), F.sum(pos * (F.col("events") - F.col("pos_below")) / (F.col("rows") - F.col("n_below"))).alias("__ap"),
        F.sum(pos * F.pow(1 - p, 2) + neg * F.pow(p, 2)).alias("__sq"), F.sum(pos * F.log(p) + neg * F.log1p(-p)).alias("__ll"),
        F.sum(pos * (rank - half)).alias("__ry"), F.sum(n * F.pow(rank - half, 2)).alias("__rr"),
    )
    # each bin edge lies between the two values that cover its position
    wanted = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.struct(i.alias("edge"), ((F.col("rows") - 1) * i / F.lit(float(bins))).alias("at")))
    covers = lambda k: (F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n"))
    held = t.select(*keys, "p", "n_below", "n", F.explode(wanted).alias("w")).filter(covers(F.floor("w.at")) | covers(F.ceil("w.at")))
    edges = held.groupBy(*keys, F.col("w.edge").alias("edge"), F.col("w.at").alias("at")).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    edges = edges.withColumn("v", F.col("lo") + (F.col("at") - F.floor("at")) * (F.col("hi") - F.col("lo")))
    line = edges.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("edge", "v"))), lambda e: e["v"]).alias("edges"))  # bins + 1 numbers
    under = F.size(F.filter("edges", lambda e: e < F.col("p")))
    floor = F.size(F.filter(F.slice("edges", 1, bins), lambda e: e == F.col("edges")[0]))
    binned = t.join(line, keys).groupBy(*keys, F.greatest(under, floor).alias("bin")).agg(F.sum(F.col("n") * p).alias("__p"), F.sum("pos").alias("__y"))
    gap = binned.groupBy(*keys).agg(F.sum(F.abs(F.col("__p") - F.col("__y"))).alias("__gap"))
    every = F.col("rows").cast("double")
    return sums.join(gap, keys).select(
        *keys, "rows", "events", F.try_divide(F.col("__pairs"), F.col("events") * misses).alias("roc_auc"), F.try_divide(F.col("__ap"), F.col("events").cast("double")).alias("average_precision"),
        (F.col("__sq") / every).alias("brier_score"), (-F.col("__ll") / every).alias("log_loss"),
        F.try_divide(F.col("__ry"), F.sqrt(F.col("__rr") * F.col("events") * misses / every)).alias("spearman"), (F.col("__gap") / every).alias("expected_calibration_error"),
    )
