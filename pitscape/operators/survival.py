"""Survival intervals, cause-specific proportional hazards, concordance."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitscape.functions import scalars as S
from pitscape.functions.ordering import cumulate, quantiles
from pitscape.operators.describe import prediction_metrics, spearman
from pitscape.operators.ladder import logit_lines
from pitscape.params import DEFAULT, Params
from pitscape.session import cut
from pitscape.sources.derived import EXIT_CATEGORIES


def survival_intervals(events: DataFrame, exits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(start, stop] intervals per firm: to the next report, the exit or the last follow-up.

    ``events`` needs gvkey, datadate, feature_date, reporting_history; ``exits`` has
    exit_date, exit_category and last_observed_date per firm.
    """
    kept = events.filter(F.col("reporting_history") >= p.min_reporting_history).join(
        exits.select("gvkey", "exit_date", "exit_category", "last_observed_date"), "gvkey", "left"
    )
    start = F.col("feature_date")
    order = W.partitionBy("gvkey").orderBy("feature_date", "datadate")
    exit_after = F.when(F.col("exit_date") > start, F.col("exit_date"))
    origin = F.lit(p.survival_origin).cast("date")
    out = kept.withColumn("__next", F.lead("feature_date").over(order)).withColumn("__exit", exit_after).withColumn(
        "interval_stop_date", F.least("__next", "__exit", "last_observed_date")
    )
    out = out.filter(F.col("interval_stop_date") > start)
    exited, updated = S.when_all(F.col("__exit") == F.col("interval_stop_date")), S.when_all(F.col("__next") == F.col("interval_stop_date"))
    reason = (
        F.when(exited, F.coalesce("exit_category", F.lit("other_unknown"))).when(updated, "covariate_update").otherwise("administrative_right_censor")
    )
    return out.select(
        *[c for c in events.columns], "exit_date", "exit_category", "interval_stop_date",
        F.date_diff("feature_date", origin).alias("entry_day"), F.date_diff("interval_stop_date", origin).alias("stop_day"),
        S.composite_key("gvkey", F.date_format("feature_date", "yyyy-MM-dd")).alias("interval_id"),
        reason.alias("terminal_reason"),
        (exited & S.when_all(F.col("exit_category") == "performance_failure")).cast("int").alias("performance_failure_event"),
        (exited & S.when_all(F.col("exit_category") == "merger")).cast("int").alias("merger_event"),
    )


def exit_reconciliation(intervals: DataFrame) -> DataFrame:
    """Dated exits after the first interval against the intervals that end in them."""
    firm = intervals.groupBy("gvkey").agg(
        F.min("feature_date").alias("__first"), F.max("exit_date").alias("exit_date"), F.max("exit_category").alias("exit_category")
    )
    eligible = firm.filter(F.col("exit_date") > F.col("__first")).groupBy("exit_category").agg(F.count(F.lit(1)).alias("eligible_dated_exits"))
    assigned = intervals.filter(F.col("terminal_reason").isin(*EXIT_CATEGORIES)).groupBy(F.col("terminal_reason").alias("exit_category")).agg(
        F.countDistinct("gvkey").alias("assigned_terminal_intervals")
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return eligible.join(assigned, "exit_category", "full").select(
        "exit_category", z("eligible_dated_exits").alias("eligible_dated_exits"), z("assigned_terminal_intervals").alias("assigned_terminal_intervals"),
        (z("assigned_terminal_intervals") - z("eligible_dated_exits")).alias("difference"),
    )


def interval_concordance(intervals: DataFrame, risk: str, event: str, firm: str = "gvkey") -> DataFrame:
    """Share of (event, other firm at risk) pairs in which the failing firm has more risk.

    An interval j is at risk at t if start_j <= t < stop_j.  Pairs are counted, never
    listed: the intervals below a risk that started by t, minus those that stopped by t.
    A count over days [0, t] splits into one power-of-two block of days per bit of the last day; in
    each block the lower risks are a running count over the risk order.  So rows multiply by
    the number of bits only, and every count is hot-safe.  Days before the origin are refused.
    """
    base = intervals.select(F.col(firm).alias("firm"), "entry_day", "stop_day", F.col(risk).cast("double").alias("risk"), F.col(event).alias("event")).filter(
        F.col("risk").isNotNull()
    )
    # each interval enters at its start (+1) and leaves at its stop (-1)
    marks = base.select("risk", F.inline(F.array(
        F.struct(F.col("entry_day").alias("day"), F.lit(1).alias("w")), F.struct(F.col("stop_day").alias("day"), F.lit(-1).alias("w")),
    )))
    first, last = base.agg(F.min(F.least("entry_day", "stop_day")), F.max(F.greatest("entry_day", "stop_day"))).first()
    if first is not None and first < 0:
        raise ValueError(f"an interval begins or ends on day {first}, before the origin")
    levels = F.sequence(F.lit(0), F.lit(max(1, (int(last or 0) + 1).bit_length()) - 1))
    block = lambda day, l: F.floor(day / F.pow(F.lit(2.0), l)).cast("int")
    points = marks.select("risk", "w", F.explode(F.transform(levels, lambda l: F.struct(l.alias("l"), block(F.col("day"), l).alias("b")))).alias("x"))
    points = points.select(F.col("x.l").alias("l"), F.col("x.b").alias("b"), "risk", F.col("w").alias("w"), F.lit(0).alias("q"))
    # days [0, t] = [0, t+1): for every set bit l of t+1, the block just below it
    events = base.filter(F.col("event") == 1)
    upper = (F.col("stop_day") + 1).cast("int")
    bits = F.filter(levels, lambda l: block(upper, l) % 2 == 1)
    asks = events.select("risk", F.explode(F.transform(bits, lambda l: F.struct(l.alias("l"), (block(upper, l) - 1).alias("b")))).alias("x"))
    asks = asks.select(F.col("x.l").alias("l"), F.col("x.b").alias("b"), "risk", F.lit(0).alias("w"), F.lit(1).alias("q"))
    table = cumulate(points.unionByName(asks), ["l", "b"], "risk", {"w": F.col("w"), "q": F.col("q")})
    q = F.col("q")
    counted = table.filter(q > 0).agg(
        F.sum(q * F.col("w_before")).alias("lower"), F.sum(q * F.col("w")).alias("tied"), F.sum(q * F.col("w_total")).alias("pairs")
    )
    # the firm's own interval that covers its event time does not count
    own = events.select("firm", F.col("risk").alias("r"), F.col("stop_day").alias("t")).join(base.select("firm", "risk", "entry_day", "stop_day"), "firm").filter(
        (F.col("entry_day") <= F.col("t")) & (F.col("t") < F.col("stop_day"))
    ).agg(
        F.count(F.when(F.col("risk") < F.col("r"), 1)).alias("lower_own"), F.count(F.when(F.col("risk") == F.col("r"), 1)).alias("tied_own"),
        F.count(F.lit(1)).alias("pairs_own"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    pairs = (z("pairs") - z("pairs_own")).cast("long")
    good = (z("lower") - z("lower_own")) + (z("tied") - z("tied_own")) / 2
    return counted.join(own).select(F.try_divide(good, pairs).alias("concordance"), pairs.alias("pairs"))


#: A standardised coefficient beyond this, or a curvature this small against its largest, means a likelihood without a maximum.
MONOTONE, FLAT = 15.0, 1e-9


def fit_hazard(intervals: DataFrame, features: Sequence[str], event: str, cluster: str = "gvkey", iterations: int = 30, ridge: float = 0.0, min_events: int = 1) -> dict:
    """Cause-specific proportional hazards with delayed entry and Breslow ties.

    Each row adds its weight and moments on its entry day and removes them after its
    stop day; the risk-set sums at every event day are running sums over the calendar.
    One aggregate over the rows gives the log partial likelihood, its gradient and its curvature; a Newton step that
    lowers the likelihood is halved.  ``status``: ``fitted``; ``too_few_events`` (nothing is fitted); ``monotone_likelihood``, when some
    direction only ever raises it, as with separable events; ``not_converged``.  Without ``fitted`` coefficients and errors are NaN.
    """
    features = list(features)
    k = len(features)
    mid = quantiles(intervals.unpivot([], features, "component", "value"), ["component"], "value", {"m": 0.5})
    medians = {r["component"]: r["m"] for r in mid.collect()}
    filled = intervals.select(
        F.col(cluster).alias("cluster"), "entry_day", "stop_day", F.col(event).cast("int").alias("event"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0))).alias(f"x{i}") for i, c in enumerate(features)],
    )
    stats = filled.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(k)]).first()
    mean = [stats[f"m{i}"] for i in range(k)]
    scale = [stats[f"s{i}"] if stats[f"s{i}"] and stats[f"s{i}"] > 1e-12 else 1.0 for i in range(k)]
    rows = filled.withColumns({f"x{i}": (F.col(f"x{i}") - mean[i]) / scale[i] for i in range(k)}).persist()
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("e"), F.countDistinct("cluster").alias("g")).first()
    out = {
        "features": features, "beta": np.full(k, np.nan), "covariance": np.full((k, k), np.nan), "mean": mean, "scale": scale, "medians": medians,
        "rows": counts["n"], "events": counts["e"] or 0, "issuers": counts["g"], "covariance_kind": None, "log_likelihood": float("nan"),
    }
    if out["events"] < max(1, min_events):
        rows.unpersist()
        return {**out, "status": "too_few_events"}
    beta, trial, best, status = np.zeros(k), np.zeros(k), -np.inf, "not_converged"
    for _ in range(iterations):
        value, grad, hess = _newton_terms(rows, trial, k)
        value -= 0.5 * ridge * float(trial @ trial)
        if not value >= best - 1e-12 * abs(best) and np.isfinite(best):
            trial = (beta + trial) / 2
            if np.abs(trial - beta).max() < 1e-12:
                break
            continue
        gained, beta, best = value - best, trial, value
        curvature = hess + ridge * np.eye(k)
        spread = np.linalg.eigvalsh(curvature)
        if np.abs(beta).max() > MONOTONE or spread[0] <= FLAT * max(spread[-1], 1e-300):
            status = "monotone_likelihood"
            break
        step = np.linalg.solve(curvature, grad - ridge * beta)
        if np.abs(step).max() < 1e-9 or 0 <= gained < 1e-13 * (1 + abs(best)):
            status = "fitted"
            break
        trial = beta + step
    if status != "fitted":
        rows.unpersist()
        return {**out, "status": status}
    bread = np.linalg.inv(hess)
    meat, clusters, n = _cluster_meat(rows, beta, k)
    correction = clusters / (clusters - 1.0) * (n - 1.0) / max(n - k, 1.0) if clusters > 1 else 1.0
    covariance, kind = bread @ meat @ bread * correction, "issuer_clustered_sandwich"
    if not np.isfinite(covariance).all() or (np.diag(covariance) < 0).any():
        covariance, kind = bread, "unclustered_fallback"
    rows.unpersist()
    return {**out, "beta": beta, "covariance": covariance, "covariance_kind": kind, "log_likelihood": best, "status": status}


def _linear(beta: np.ndarray) -> Column:
    z = F.lit(0.0)
    for i, b in enumerate(beta):
        z = z + F.lit(float(b)) * F.col(f"x{i}")
    return z


def _risk_days(rows: DataFrame, beta: np.ndarray, k: int, second: bool) -> DataFrame:
    """Per event day: events d, event sums e_i, and risk-set sums S0, S1_i (and S2_ij)."""
    w = F.exp(_linear(beta))
    terms = {"S0": w, **{f"S1_{i}": w * F.col(f"x{i}") for i in range(k)}}
    if second:
        terms.update({f"S2_{i}_{j}": w * F.col(f"x{i}") * F.col(f"x{j}") for i in range(k) for j in range(i, k)})
    valued = rows.select(*[f"x{i}" for i in range(k)], "event", "entry_day", "stop_day", *[e.alias(n) for n, e in terms.items()])
    ends = F.array(F.struct(F.col("entry_day").alias("day"), F.lit(1.0).alias("sg")), F.struct(F.col("stop_day").alias("day"), F.lit(-1.0).alias("sg")))
    net = valued.select("*", F.inline(ends)).groupBy("day").agg(
        *[F.sum(F.col("sg") * F.col(n)).alias(n) for n in terms],
        F.sum(F.when(F.col("sg") < 0, F.col("event")).otherwise(0)).alias("d"),
        *[F.sum(F.when(F.col("sg") < 0, F.col("event") * F.col(f"x{i}")).otherwise(0.0)).alias(f"e{i}") for i in range(k)],
    )
    before = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, -1)  # one row per day
    return net.select("day", "d", *[f"e{i}" for i in range(k)], *[F.sum(n).over(before).alias(n) for n in terms])


def _newton_terms(rows: DataFrame, beta: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood, gradient and curvature."""
    days = _risk_days(rows, beta, k, True).filter(F.col("d") > 0)
    c = F.col
    out = [F.sum(c(f"e{i}") - c("d") * c(f"S1_{i}") / c("S0")).alias(f"g{i}") for i in range(k)]
    out += [
        F.sum(c("d") * (c(f"S2_{i}_{j}") / c("S0") - c(f"S1_{i}") * c(f"S1_{j}") / (c("S0") * c("S0")))).alias(f"h{i}_{j}")
        for i in range(k) for j in range(i, k)
    ]
    out += [F.sum(c("d") * F.log("S0")).alias("log_risk"), *[F.sum(f"e{i}").alias(f"x{i}") for i in range(k)]]
    row = days.agg(*out).first()
    hess = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            hess[i, j] = hess[j, i] = row[f"h{i}_{j}"]
    value = sum(float(beta[i]) * row[f"x{i}"] for i in range(k)) - row["log_risk"]
    return value, np.array([row[f"g{i}"] for i in range(k)]), hess


def _score_rows(rows: DataFrame, beta: np.ndarray, k: int) -> DataFrame:
    days = _risk_days(rows, beta, k, False)
    upto = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("d") > 0, F.col("d") / F.col("S0")).otherwise(0.0)
    table = days.select(
        "day", F.sum(step).over(upto).alias("H0"),
        *[F.sum(F.when(F.col("d") > 0, step * F.col(f"S1_{i}") / F.col("S0")).otherwise(0.0)).over(upto).alias(f"H1_{i}") for i in range(k)],
        *[F.when(F.col("d") > 0, F.col(f"S1_{i}") / F.col("S0")).alias(f"xb{i}") for i in range(k)],
    )
    rename = lambda tag, key: table.select(F.col("day").alias(key), *[F.col(c).alias(f"{tag}{c}") for c in table.columns if c != "day"])
    joined = rows.join(rename("a_", "entry_day"), "entry_day").join(rename("b_", "stop_day"), "stop_day")
    w = F.exp(_linear(beta))
    return joined.withColumns(
        {
            f"r{i}": F.when(F.col("event") == 1, F.col(f"x{i}") - F.col(f"b_xb{i}")).otherwise(0.0)
            - w * (F.col(f"x{i}") * (F.col("b_H0") - F.col("a_H0")) - (F.col(f"b_H1_{i}") - F.col(f"a_H1_{i}")))
            for i in range(k)
        }
    )


def _cluster_meat(rows: DataFrame, beta: np.ndarray, k: int) -> tuple[np.ndarray, int, int]:
    per = _score_rows(rows, beta, k).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"r{i}").alias(f"r{i}") for i in range(k)])
    out = per.agg(
        F.count(F.lit(1)).alias("G"), F.sum("n").alias("N"),
        *[F.sum(F.col(f"r{i}") * F.col(f"r{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)],
    ).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = out[f"m{i}_{j}"]
    return meat, int(out["G"]), int(out["N"])


def hazard_table(spark, fit: dict, cause: str) -> DataFrame:
    """Coefficient, z, p, hazard ratio and 95 % interval per standardised feature, with what was fitted on; null without a fit."""
    rows = []
    known = lambda v: None if not np.isfinite(v) else float(v)
    for i, name in enumerate(fit["features"]):
        b, se = float(fit["beta"][i]), float(np.sqrt(max(fit["covariance"][i, i], 0.0))) if np.isfinite(fit["covariance"][i, i]) else float("nan")
        z = b / se if se > 0 else float("nan")
        low, high = b - 1.959963984540054 * se, b + 1.959963984540054 * se
        rows.append((cause, name, known(b), known(se), known(z), known(math.erfc(abs(z) / math.sqrt(2.0))), *(known(np.exp(v)) for v in (b, low, high)),
                     fit["covariance_kind"], fit["rows"], fit["issuers"], fit["events"], fit["status"]))
    return spark.createDataFrame(
        rows, "cause string, feature string, coefficient double, robust_se double, z double, p_value double, hazard_ratio double, ci_low double, ci_high double, "
        "covariance_kind string, intervals long, issuers long, events long, status string",
    )


def hazard_folds(
    intervals: DataFrame, features: Sequence[str], causes: Mapping[str, str], windows: Sequence[tuple[int, int]],
    min_intervals: int = 5000, min_train_events: int = 20, min_test_events: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Hazards fitted before each window and judged on it: metrics per cause and fold, and the scored intervals.

    Trained on intervals that stop before the window's first day, tested on those that start in its years. The risk score becomes the
    probability of an event inside the interval by a logistic line learnt on the train rows; all lines, metrics and test recalibrations are
    grouped jobs over all folds. ``causes`` names the event column of each. A fold below a minimum, or whose likelihood has no maximum, has a
    row with its ``status`` and no metrics.
    """
    spark = intervals.sparkSession
    keys, parts, table = ["cause", "fold"], [], []
    for fold, (first, last) in enumerate(windows, 1):
        train = intervals.filter(F.col("interval_stop_date") < F.make_date(F.lit(first), F.lit(1), F.lit(1)))
        test = intervals.filter(F.year("feature_date").between(first, last))
        size = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("gvkey").alias("g"), F.max("interval_stop_date").alias("to"), *[F.sum(c).alias(k) for k, c in causes.items()]).first()
        a, b = size(train), size(test)
        for cause, event in causes.items():
            counts = (cause, fold, first, last, a["n"], a["g"], a[cause] or 0, a["to"], b["n"], b["g"], b[cause] or 0)
            few = [n for n, low in (("train intervals", a["n"] < min_intervals), ("test intervals", b["n"] == 0), ("train events", (a[cause] or 0) < min_train_events), ("test events", (b[cause] or 0) < min_test_events)) if low]
            fit = None if few else fit_hazard(train, features, event)
            status = "too few " + ", ".join(few) if few else fit["status"]
            concordance, pairs = None, None
            if status == "fitted":
                for role, df in (("train", train), ("test", test)):
                    parts.append(with_risk(df, fit).select(F.lit(cause).alias("cause"), F.lit(fold).alias("fold"), F.lit(role).alias("role"), "interval_id", "gvkey", "feature_date", "interval_stop_date", "entry_day", "stop_day", F.col(event).cast("int").alias("event"), F.col("risk").alias("risk_score")))
                concordance, pairs = interval_concordance(parts[-1], "risk_score", "event").first()
            table.append((*counts, concordance, pairs, status))
    schema = (
        "cause string, fold int, test_start_year int, test_end_year int, train_intervals long, train_issuers long, train_events long, train_max_stop_date date, "
        "test_intervals long, test_issuers long, test_events long, concordance double, comparable_pairs long, status string"
    )
    report = spark.createDataFrame(table, schema)  # a row per cause and fold
    if not parts:
        return report, None
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = cut(rows)
    line = logit_lines(rows.filter("role = 'train'"), keys, "risk_score", "event")
    z = F.col("intercept") + F.col("slope") * F.col("risk_score")
    scored = rows.filter("role = 'test'").join(F.broadcast(line), keys).withColumn("predicted_interval_event_probability", 1 / (1 + F.exp(-z))).drop("intercept", "slope", "role")
    scored = cut(scored)
    metrics = prediction_metrics(scored, keys, "predicted_interval_event_probability", "event").select(*keys, "roc_auc", "average_precision", "brier_score")
    again = logit_lines(scored.withColumn("__z", S.logit("predicted_interval_event_probability", 1e-6)), keys, "__z", "event")
    again = again.select(*keys, F.col("intercept").alias("calibration_intercept"), F.col("slope").alias("calibration_slope"))
    return report.join(metrics, keys, "left").join(again, keys, "left"), scored


def with_risk(df: DataFrame, fit: dict, out: str = "risk") -> DataFrame:
    z = F.lit(0.0)
    for i, c in enumerate(fit["features"]):
        x = F.coalesce(F.col(c).cast("double"), F.lit(fit["medians"].get(c, 0.0)))
        z = z + F.lit(float(fit["beta"][i])) * (x - fit["mean"][i]) / fit["scale"][i]
    return df.withColumn(out, z)


def proportionality(intervals: DataFrame, fit: dict, event: str) -> DataFrame:
    """Rank correlation of each feature's residual at event times with log time."""
    k = len(fit["features"])
    rows = intervals.select(
        F.lit("").alias("cluster"), "entry_day", "stop_day", F.col(event).cast("int").alias("event"),
        *[((F.coalesce(F.col(c).cast("double"), F.lit(fit["medians"].get(c, 0.0))) - fit["mean"][i]) / fit["scale"][i]).alias(f"x{i}") for i, c in enumerate(fit["features"])],
    )
    days = _risk_days(rows, fit["beta"], k, False).filter(F.col("d") > 0).select(
        F.col("day").alias("stop_day"), *[(F.col(f"S1_{i}") / F.col("S0")).alias(f"xb{i}") for i in range(k)]
    )
    at = rows.filter("event = 1").join(days, "stop_day")
    long = at.select(F.log(F.col("stop_day").cast("double")).alias("log_time"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col(f"x{i}") - F.col(f"xb{i}")).alias("residual")) for i, c in enumerate(fit["features"])
    ])))
    return spearman(long, ["feature"], "residual", "log_time")
