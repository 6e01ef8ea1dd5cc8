"""Fixed-horizon outcomes, purged folds, smoothed rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscape.functions import scalars as S
from pitscape.functions.ordering import quantiles
from pitscape.params import DEFAULT, Params


def followup_bounds(observations: DataFrame) -> DataFrame:
    return observations.groupBy("gvkey").agg(
        F.min("date").alias("first_observed_date"), F.max("date").alias("last_observed_date")
    )


def single_exit(exits: DataFrame) -> DataFrame:
    """One exit per firm; a second one stops the job."""
    one = F.when(F.count(F.lit(1)) == 1, F.min("exit_date")).otherwise(
        F.raise_error(F.concat(F.lit("more than one exit for firm "), F.max("gvkey"))).cast("date")
    )
    return exits.filter(F.col("exit_date").isNotNull()).groupBy("gvkey").agg(
        one.alias("exit_date"), F.min("exit_category").alias("exit_category")
    )


def fixed_horizon_labels(
    events: DataFrame, exits: DataFrame, followup: DataFrame, sample_end: str | Column, horizons: Sequence[int] = DEFAULT.horizons_years
) -> DataFrame:
    """1 failure in (t, t+h], 0 survived with follow-up, NULL competing exit or censored."""
    base = events.join(exits, "gvkey", "left").join(followup.select("gvkey", "last_observed_date"), "gvkey", "left")
    each = base.withColumn("horizon_years", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    t = F.col("feature_date")
    end = F.add_months(t, F.col("horizon_years") * 12)
    # adding years keeps the day of month, except 29 February
    inside = S.when_all(F.col("exit_date") > t, F.col("exit_date") <= F.col("horizon_end"))
    failed = F.col("exit_category") == "performance_failure"
    failure = inside & S.when_all(failed)
    competing = inside & ~S.when_all(failed)
    followed = S.when_all(F.col("last_observed_date") >= F.col("horizon_end"))
    label = F.when(failure, 1).when(~competing & followed, 0)
    reason = (
        F.when(label.isNotNull(), "none")
        .when(competing, "competing_exit")
        .when(F.col("horizon_end") > F.lit(sample_end).cast("date"), "administrative_right_censor")
        .otherwise("lost_followup")
    )
    known = F.when(inside, F.col("exit_date")).when(label == 0, F.col("horizon_end"))
    return each.withColumn("horizon_end", end).select(
        *[c for c in events.columns], "horizon_years", "horizon_end", "exit_date", "exit_category", "last_observed_date",
        label.cast("int").alias("failure_within_horizon"),
        F.when(label.isNotNull(), "observed").otherwise("censored").alias("label_status"),
        reason.alias("censor_reason"), known.alias("label_observed_date"),
    )


def label_counts(labels: DataFrame, keys: Sequence[str] = ("horizon_years", "label_status", "censor_reason")) -> DataFrame:
    return labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("failure_within_horizon"), F.lit(0)).alias("failures")
    )


def fold_table(spark: SparkSession, start_year: int, p: Params = DEFAULT) -> DataFrame:
    """Purged expanding folds: a horizon plus a year lies between the splits."""
    rows = []
    for h in p.horizons_years:
        for i, (t0, t1) in enumerate(p.test_windows, 1):
            v1 = t0 - h - 1
            v0 = v1 - p.validation_years + 1
            rows += [(h, i, "train", start_year, v0 - h - 1, v0), (h, i, "validation", v0, v1, t0), (h, i, "test", t0, t1, 9999)]
    schema = "horizon_years int, fold int, role string, from_year int, to_year int, known_before int"
    return spark.createDataFrame(rows, schema)


def assign_folds(matrix: DataFrame, folds: DataFrame) -> DataFrame:
    """Observed labels in every (fold, role) they serve; a label not yet known before the
    next split stops the job.  The fold table has a handful of rows, fixed by parameters."""
    observed = matrix.filter(F.col("failure_within_horizon").isNotNull())
    m, f = observed, F.broadcast(folds)
    joined = m.join(f, (m["horizon_years"] == f["horizon_years"]) & m["event_year"].between(f["from_year"], f["to_year"])).drop(
        f["horizon_years"]
    )
    late = (F.col("role") != "test") & (F.year("label_observed_date") >= F.col("known_before"))
    checked = F.when(late, F.raise_error("a label was not known before the next split").cast("string")).otherwise(F.col("role"))
    return joined.withColumn("role", checked).drop("from_year", "to_year", "known_before")


def smoothed_rates(split: DataFrame, keys: Sequence[str], group: str, prior_rows: float = DEFAULT.rate_prior_rows) -> DataFrame:
    """Failure rate of a group learnt on train rows, shrunk to the overall rate, applied
    to the other roles; an unseen group gets the overall rate."""
    keys = list(keys)
    train = split.filter(F.col("role") == "train")
    overall = train.groupBy(*keys).agg(F.avg("failure_within_horizon").alias("__all"))
    per = train.groupBy(*keys, group).agg(F.sum("failure_within_horizon").alias("__s"), F.count(F.lit(1)).alias("__n"))
    scored = split.filter(F.col("role") != "train").join(overall, keys).join(per, keys + [group], "left")
    rate = (F.col("__s") + prior_rows * F.col("__all")) / (F.col("__n") + prior_rows)
    return scored.withColumn("probability", F.coalesce(rate, F.col("__all"))).drop("__all", "__s", "__n")


def tertile_cells(split: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Base-3 cell of each row.  Missing values take the median of the train rows first;
    the tertiles are those of the filled train rows."""
    keys = list(keys)
    long = split.filter(F.col("role") == "train").unpivot(keys, list(columns), "component", "value")
    mid = quantiles(long, [*keys, "component"], "value", {"mid": 0.5})
    filled = long.join(mid, [*keys, "component"]).withColumn("value", F.coalesce("value", "mid"))
    edges = quantiles(filled, [*keys, "component"], "value", {"t1": 1 / 3, "t2": 2 / 3}).join(mid, [*keys, "component"])
    wide = edges.groupBy(*keys).agg(
        *[F.max(F.when(F.col("component") == c, F.struct("t1", "t2", "mid"))).alias(f"__{c}") for c in columns]
    )
    digit = lambda c: (
        (F.coalesce(F.col(c), F.col(f"__{c}.mid")) >= F.col(f"__{c}.t1")).cast("int")
        + (F.coalesce(F.col(c), F.col(f"__{c}.mid")) >= F.col(f"__{c}.t2")).cast("int")
    )
    cell = F.concat(*[digit(c).cast("string") for c in columns])
    return split.join(wide, keys).withColumn("cell", cell).drop(*[f"__{c}" for c in columns])
