"""Forward paths and targets, quantile portfolios, overlapping cohorts, cross-sectional regressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitscape.functions import scalars as S
from pitscape.functions.ordering import FEW_GROUPS, quantiles, with_row_number
from pitscape.operators.describe import holm, newey_west_mean, normal_two_sided_p, spearman
from pitscape.operators.inference import alpha_columns, hac_lines
from pitscape.params import DEFAULT, Params
from pitscape.session import cut

STRATEGY = ["horizon_months", "signal", "weighting", "industry_neutral"]


def forward_paths(events: DataFrame, history: DataFrame, factors: DataFrame, p: Params = DEFAULT, lag: int = 1) -> DataFrame:
    """Monthly path of every event, up to the longest horizon.

    After a valid exit the path earns the risk-free rate; a month without a usable
    return breaks it.  Months after the last factor row are kept, ``beyond_calendar`` and not
    valid; a gap inside the calendar is an error.  Path windows hold one row per holding month.

    The months of a name meet its events as one map, which the calendar bounds, and stay with them: an event is
    shuffled once, by its name and not yet unfolded. An event belongs to one name.
    """
    longest = max(p.return_horizons)
    month = history.filter(F.col("gvkey").isNotNull() & F.col("date").isNotNull()).repartition("gvkey").groupBy("gvkey", "date").agg(
        F.collect_list(F.struct(F.col("total_return").alias("ret_total"), "has_delist", "delist_return_missing")).alias("__r")
    )
    past = month.groupBy("gvkey").agg(F.map_from_entries(F.collect_list(F.struct("date", "__r"))).alias("__past"))
    rates = factors.select(F.col("date").alias("holding_date"), "rf")
    last = factors.agg(F.max("date").alias("__last"))  # one row
    exploded = events.join(past, "gvkey", "left").withColumn("holding_offset", F.explode(F.sequence(F.lit(lag), F.lit(longest)))).withColumn(
        "holding_date", F.last_day(F.add_months(F.last_day("feature_date"), F.col("holding_offset")))
    )
    known = exploded.withColumn("__r", F.try_element_at("__past", F.col("holding_date"))).drop("__past")
    found = known.select("gvkey", "holding_date", *[c for c in known.columns if c not in ("gvkey", "holding_date", "__r")], F.inline_outer("__r"))
    joined = found.join(F.broadcast(rates), "holding_date", "left").join(F.broadcast(last))
    beyond = F.coalesce(F.col("holding_date") > F.col("__last"), F.lit(True))
    missing_exit = F.coalesce("delist_return_missing", F.lit(False))
    valid_exit = F.coalesce("has_delist", F.lit(False)) & ~missing_exit & F.col("ret_total").isNotNull()
    path = W.partitionBy("gvkey", "event_id").orderBy("holding_offset")
    before, upto = path.rowsBetween(W.unboundedPreceding, -1), path.rowsBetween(W.unboundedPreceding, 0)
    rf = F.coalesce("rf", F.raise_error(F.concat(F.lit("no factor row for "), F.col("holding_date").cast("string"))).cast("double"))
    out = (
        joined.withColumn("beyond_calendar", beyond)
        .withColumn("rf", F.when(~F.col("beyond_calendar"), rf))
        .withColumn("delist_return_missing", missing_exit)
        .withColumn("valid_delist_event", valid_exit)
        .withColumn("cash_after_delist", F.coalesce(F.max("valid_delist_event").over(before), F.lit(False)))
        .withColumn(
            "__ok",
            ~F.col("beyond_calendar") & (F.col("cash_after_delist") | (F.col("ret_total").isNotNull() & ~F.col("delist_return_missing"))),
        )
        .withColumn("path_valid_through_month", F.bool_and("__ok").over(upto))
        .withColumn("delisted_by_month", F.max("valid_delist_event").over(upto))
        .withColumn("return_used", F.when(F.col("cash_after_delist"), F.col("rf")).when(~F.col("beyond_calendar"), F.col("ret_total")))
    )
    return out.drop("__ok", "__last", "has_delist")


def forward_targets(paths: DataFrame, carried: Sequence[str], horizons: Sequence[int] = DEFAULT.return_horizons) -> DataFrame:
    """All horizons of an event in one grouped aggregate over its path, then unfolded."""
    aggregates = []
    for h in horizons:
        near = F.col("holding_offset") <= h
        pick = lambda e, near=near: F.when(near, e)
        aggregates += [
            F.count(pick(F.lit(1))).alias(f"months_{h}"),
            F.bool_and(pick(F.col("path_valid_through_month"))).alias(f"valid_{h}"),
            F.bool_or(pick(F.col("delist_return_missing"))).alias(f"missing_{h}"),
            F.bool_or(pick(F.col("valid_delist_event"))).alias(f"gone_{h}"),
            F.bool_or(pick(F.col("beyond_calendar"))).alias(f"beyond_{h}"),
            F.count(pick(F.col("return_used"))).alias(f"used_{h}"),
            (F.product(pick(1 + F.col("return_used"))) - 1).alias(f"gross_{h}"),
            (F.product(pick(1 + F.col("rf"))) - 1).alias(f"rf_{h}"),
        ]
    wide = paths.groupBy("event_id", *carried).agg(*aggregates)
    c = F.col
    entries = []
    for h in horizons:
        ok = c(f"valid_{h}")
        gross = F.when(ok & (c(f"used_{h}") == c(f"months_{h}")), c(f"gross_{h}"))
        status = (
            F.when(c(f"missing_{h}"), "missing_delisting_return")
            .when(c(f"beyond_{h}"), "beyond_calendar")
            .when(~ok, "missing_return_path")
            .when(c(f"gone_{h}"), "complete_after_delist")
            .otherwise("complete")
        )
        entries.append(
            F.struct(
                F.lit(h).alias("horizon_months"), c(f"months_{h}").alias("path_months"), ok.alias("target_valid"),
                gross.alias("forward_total_return"), F.when(~c(f"beyond_{h}"), c(f"rf_{h}")).alias("forward_risk_free_return"),
                (gross - c(f"rf_{h}")).alias("forward_excess_return"), status.alias("target_status"),
            )
        )
    return wide.select("event_id", *carried, F.inline(F.array(*entries)))


def quantile_bin(row_number: Column, rows: Column, bins: int) -> Column:
    """Equal-width bins of first-occurrence ranks, right-closed as in a quantile cut."""
    raw = F.ceil((row_number - 1) * bins / F.when(rows > 1, rows - 1))
    return F.greatest(F.lit(1), F.coalesce(raw, F.lit(1))).cast("int")


def portfolio_sorts(targets: DataFrame, signals: Sequence[str], p: Params = DEFAULT, carried: Sequence[str] | None = None) -> DataFrame:
    """Every event's quantile and weight in each horizon x signal x neutrality x weighting cell.

    ``carried``: the columns of ``targets`` that come along with the keys, the industry and the cell (default: all); an event
    is ranked twice in every horizon and signal, so that each column is moved many times.
    """
    eligible = targets.filter(
        S.when_all(F.col("target_valid"), F.col("forward_excess_return").isNotNull(), F.col("market_cap_millions") > 0, F.col("sic1").isNotNull())
    )
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("signal_value")) for s in signals])
    section = ["horizon_months", "signal", "feature_date"]
    kept = ["*"] if carried is None else list(dict.fromkeys(["horizon_months", "feature_date", "event_id", "sic1", "market_cap_millions", *carried]))
    long = eligible.select(*kept, F.inline(pairs)).filter(F.col("signal_value").isNotNull())
    wide_enough = long.groupBy(*section).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= p.min_cross_section)
    long = long.join(F.broadcast(wide_enough.drop("__n")), section, "left_semi")
    modes = F.array(
        F.struct(F.lit(False).alias("industry_neutral"), F.lit("all").alias("__grp")),
        F.struct(F.lit(True).alias("industry_neutral"), F.col("sic1").cast("string").alias("__grp")),
    )
    both = long.select("*", F.inline(modes))
    numbered = with_row_number(both, [*section, "industry_neutral", "__grp"], F.col("signal_value"), "event_id", "__rn", "__gn", few=True)
    ranked = numbered.filter(~F.col("industry_neutral") | (F.col("__gn") >= p.min_industry_group)).withColumn(
        "quantile", quantile_bin(F.col("__rn"), F.col("__gn"), p.quantiles)
    )
    schemes = F.array(
        F.struct(F.lit("equal").alias("weighting"), F.lit(1.0).alias("__base")),
        F.struct(F.lit("value").alias("weighting"), F.col("market_cap_millions").alias("__base")),
    )
    cells = ranked.select("*", F.inline(schemes)).drop("__rn", "__gn")
    return leg_weights(cells, [*section, "industry_neutral", "weighting", "quantile"], "__base", "sic1", "industry_neutral").drop("__base", "__grp")


def leg_weights(df: DataFrame, leg: Sequence[str], base: str, industry: str, neutral: str) -> DataFrame:
    """Weights inside a leg; neutral legs give each industry present the same budget.

    An industry whose base sums to zero keeps weight zero and its budget is lost.
    Totals are aggregated and joined back: one small table per leg and industry.
    """
    leg = list(leg)
    per_industry = df.groupBy(*leg, industry).agg(F.sum(base).alias("__ind"))
    per_leg = per_industry.groupBy(*leg).agg(F.sum("__ind").alias("__leg"), F.count(F.lit(1)).alias("__k"))
    joined = df.join(F.broadcast(per_industry.join(per_leg, leg)), [*leg, industry])
    plain = F.when(F.col("__leg") > 0, F.col(base) / F.col("__leg"))
    split = F.when(F.col("__ind") > 0, F.col(base) / F.col("__ind") / F.col("__k")).otherwise(0.0)
    return joined.withColumn("weight", F.when(F.col(neutral), split).otherwise(plain)).drop("__ind", "__leg", "__k")


def quantile_returns(sorts: DataFrame) -> DataFrame:
    """Weighted forward returns of each quantile portfolio."""
    cell = [*STRATEGY, "feature_date", "quantile"]
    folds = sorts.groupBy(*cell, "fold").agg(F.count(F.lit(1)).alias("__c"))
    mode = folds.groupBy(*cell).agg((-F.max(F.struct("__c", (-F.col("fold")).alias("f")))["f"]).alias("fold"))
    totals = sorts.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.col("weight") * F.col("forward_total_return")).alias("forward_total_return"),
        F.sum(F.col("weight") * F.col("forward_excess_return")).alias("forward_excess_return"),
    )
    return totals.join(mode, cell)


def assignments(sorts: DataFrame, quantile_count: int = DEFAULT.quantiles) -> DataFrame:
    """Top and bottom quantile as long and short legs."""
    return sorts.filter(F.col("quantile").isin(1, quantile_count)).withColumn(
        "leg", F.when(F.col("quantile") == quantile_count, "long").otherwise("short")
    )


def sort_attrition(targets: DataFrame, signals: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in signals])
    ok = S.when_all(
        F.col("target_valid"), F.col("forward_excess_return").isNotNull(), F.col("v").isNotNull(),
        F.col("market_cap_millions") > 0, F.col("sic1").isNotNull(),
    )
    return targets.select("*", F.inline(pairs)).groupBy("horizon_months", "signal", "feature_date").agg(
        F.count(F.lit(1)).alias("events_total"), F.count(F.when(ok, 1)).alias("events_eligible")
    )


def cohort_positions(assigned: DataFrame, paths: DataFrame, low: int = 1, high: Column | None = None, broken_path: str = "raise") -> DataFrame:
    """Assignments unfolded over their holding months [low, high] (default: the horizon).

    An assignment without any path is an error, and so is a broken one, unless ``broken_path`` is "close": then
    months beyond the calendar are left out and the others come with ``closed`` from the first broken month on.
    Nothing that happens later decides whether a position is opened.

    Where both sides name their security, assignments and months of an event meet in the partition of ``gvkey`` and are
    unfolded there, so that sums by security follow without another shuffle.
    """
    high = F.col("horizon_months") if high is None else high
    columns = ["event_id", "holding_offset", "holding_date", "return_used", "path_valid_through_month", "cash_after_delist", "valid_delist_event", "rf", "beyond_calendar"]
    if "gvkey" in assigned.columns and "gvkey" in paths.columns:
        event = ["gvkey", "event_id"]
        rest, step = [c for c in assigned.columns if c not in event], columns[1:]
        sides = assigned.select(*event, F.struct(*rest).alias("__a")).unionByName(paths.select(*event, F.struct(*step).alias("__s")), True)
        # by number: the partitions grow tenfold when unfolded, so small ones are not put together
        dealt = sides.repartition(int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gvkey")
        met = dealt.groupBy(*event).agg(F.collect_list("__a").alias("__a"), F.collect_list("__s").alias("__s"))
        joined = met.select(*event, F.inline("__a"), "__s").select(*event, *rest, F.inline_outer("__s"))
    else:
        joined = assigned.join(paths.select(*columns), "event_id", "left")
    offset = F.coalesce("holding_offset", F.raise_error("an assignment has no return path").cast("int"))
    joined = joined.withColumn("holding_offset", offset).filter((F.col("holding_offset") >= low) & (F.col("holding_offset") <= high))
    broken = F.col("return_used").isNull() | ~F.col("path_valid_through_month")
    if broken_path == "close":
        return joined.filter(~F.col("beyond_calendar")).withColumn("closed", broken).drop("beyond_calendar")
    joined = joined.drop("beyond_calendar")
    return joined.withColumn(
        "return_used", F.when(broken, F.raise_error("an assignment has an invalid return path").cast("double")).otherwise(F.col("return_used"))
    )


def monthly_portfolios(positions: DataFrame) -> DataFrame:
    """Mean leg return over the cohorts active in a month, and turnover."""
    wr = F.col("weight") * F.col("return_used")
    cohort = positions.groupBy(*STRATEGY, "feature_date", "holding_date").agg(
        F.sum(F.when(F.col("leg") == "long", wr)).alias("long"), F.sum(F.when(F.col("leg") == "short", wr)).alias("short")
    )
    calendar = cohort.groupBy(*STRATEGY, "holding_date").agg(
        F.avg("long").alias("long_return"), F.avg("short").alias("short_return"),
        F.avg(F.col("long") - F.col("short")).alias("long_short_return"), F.count(F.lit(1)).alias("active_cohorts"),
    )
    signed = F.when(F.col("leg") == "long", F.col("weight")).otherwise(-F.col("weight"))
    calendar = cut(calendar)  # a row per strategy and month
    names = positions.groupBy(*STRATEGY, "holding_date", "gvkey").agg(F.sum(signed).alias("w")).join(
        F.broadcast(calendar.select(*STRATEGY, "holding_date", "active_cohorts")), [*STRATEGY, "holding_date"]
    )
    months = calendar.select(*STRATEGY, "holding_date")
    turnover = weight_turnover(names.withColumn("w", F.col("w") / F.col("active_cohorts")), STRATEGY, "holding_date", "gvkey", "w", months)
    return calendar.join(turnover, [*STRATEGY, "holding_date"])


def weight_turnover(names: DataFrame, strategy: Sequence[str], month: str, name: str, weight: str, months: DataFrame | None = None) -> DataFrame:
    """Half the absolute weight change against the previous month present (``months``: those of each strategy, if known).

    Each weight counts positive in its month and negative in the strategy's next one,
    so entering and leaving names need no outer join.
    """
    strategy = list(strategy)
    months = names.select(*strategy, month).distinct() if months is None else months
    following = F.lead(month).over(W.partitionBy(*strategy).orderBy(month))
    held = names.join(F.broadcast(months.withColumn("__next", following)), [*strategy, month])
    sides = F.array(
        F.struct(F.col(month).alias("m"), F.col(weight).alias("d")), F.struct(F.col("__next").alias("m"), (-F.col(weight)).alias("d"))
    )
    moved = held.select(*strategy, name, F.inline(sides)).filter(F.col("m").isNotNull())
    change = moved.groupBy(*strategy, "m", name).agg(F.abs(F.sum("d")).alias("c"))
    return change.groupBy(*strategy, F.col("m").alias(month)).agg((F.sum("c") / 2).alias("turnover"))


def exposures(assigned: DataFrame, controls: Sequence[str]) -> DataFrame:
    """Weighted long-short characteristic exposure per strategy, averaged over cohorts."""
    signed = F.when(F.col("leg") == "long", F.col("weight")).otherwise(-F.col("weight"))
    pairs = F.array(*[F.struct(F.lit(c).alias("characteristic"), F.col(c).cast("double").alias("v")) for c in controls])
    long = assigned.select("*", signed.alias("__w"), F.inline(pairs)).filter(F.col("v").isNotNull())
    return long.groupBy(*STRATEGY, "characteristic").agg(
        (F.sum(F.col("__w") * F.col("v")) / F.countDistinct("feature_date")).alias("exposure"), F.count(F.lit(1)).alias("observations")
    )


def cohort_spreads(quantile_table: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Top-minus-bottom return and monotonicity of each formation cohort."""
    cohort = [*STRATEGY, "feature_date"]
    top, bottom = F.col("quantile") == p.quantiles, F.col("quantile") == 1
    spread = quantile_table.groupBy(*cohort).agg(
        (F.max(F.when(top, F.col("forward_excess_return"))) - F.max(F.when(bottom, F.col("forward_excess_return")))).alias("long_short_excess_return"),
        (F.max(F.when(top, F.col("forward_total_return"))) - F.max(F.when(bottom, F.col("forward_total_return")))).alias("long_short_total_return"),
        F.max(F.when(top, F.col("fold"))).alias("fold"),
    )
    mono = spearman(quantile_table.withColumn("__q", F.col("quantile").cast("double")), cohort, "__q", "forward_excess_return")
    return spread.filter(F.col("long_short_excess_return").isNotNull()).join(mono.select(*cohort, F.col("spearman").alias("monotonicity")), cohort)


def fold_spreads(spreads: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Mean cohort spread of each strategy and fold with an error for the overlap of its horizon: one row per strategy and fold.

    A fold of a single cohort has a mean and no error.
    """
    keys = [*STRATEGY, "fold"]
    lines = hac_lines(spreads, keys, "feature_date", "long_short_excess_return", [], F.col("horizon_months") - 1, max(p.return_horizons) - 1)
    means = spreads.groupBy(*keys).agg(F.avg("long_short_total_return").alias("mean_long_short_total_return"), F.avg("monotonicity").alias("mean_monotonicity"))
    return lines.select(
        *keys, F.col("months").alias("formation_cohorts"), F.col("coefficient").alias("mean_long_short_excess_return"), F.col("se").alias("hac_standard_error"), F.col("t").alias("t_stat"), "p_value",
    ).join(means, keys)


def factor_summary(monthly: DataFrame, factors: DataFrame, factor_columns: Sequence[str], p: Params = DEFAULT) -> DataFrame:
    """Gross performance of every strategy over its months, with its factor line: one row per strategy.

    ``factors`` (date, factor columns) must cover every month; turnover and cohorts are means over the months.
    """
    known = monthly.join(factors.select(F.col("date").alias("holding_date"), *factor_columns), "holding_date", "left")
    span = monthly.groupBy(*STRATEGY).agg(
        F.min("holding_date").alias("first_month"), F.max("holding_date").alias("last_month"), F.avg("long_short_return").alias("mean_monthly_gross_return"),
        F.avg("turnover").alias("average_turnover"), F.avg("active_cohorts").alias("average_active_cohorts"),
    )
    earned = portfolio_summary(monthly, STRATEGY, "holding_date", "long_short_return")
    lines = hac_lines(known, STRATEGY, "holding_date", "long_short_return", factor_columns, F.col("horizon_months") - 1, max(p.return_horizons) - 1)
    return earned.join(span, STRATEGY).join(alpha_columns(lines, STRATEGY), STRATEGY)


def portfolio_summary(monthly: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Annualised mean, volatility, Sharpe, drawdown and hit rate of a monthly series."""
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    wealth = monthly.withColumn("__w", F.product(1 + F.col(value)).over(order)).withColumn("__peak", F.max("__w").over(order))
    return wealth.groupBy(*keys).agg(
        F.count(value).alias("months"), (F.avg(value) * 12).alias("annual_mean"),
        (F.stddev_samp(value) * F.sqrt(F.lit(12.0))).alias("annual_volatility"),
        F.try_divide(F.avg(value) * F.sqrt(F.lit(12.0)), F.stddev_samp(value)).alias("sharpe"),
        F.min(F.col("__w") / F.col("__peak") - 1).alias("maximum_drawdown"),
        F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"),
    )


def hac_regression(monthly: DataFrame, keys: Sequence[str], date: str, y: str, regressors: Sequence[str], lags: int | str) -> DataFrame:
    """Time-series regression with Bartlett-weighted errors per strategy.

    ``lags``: a number, or the key column that holds the horizon, whose overlap is horizon - 1.

    A series has one row per month, so each group is calendar-bounded; the solve of one
    series is a grouped Arrow batch.
    """
    keys, names = list(keys), ["const", *regressors]
    fields = ", ".join(f"{k} {monthly.schema[k].dataType.simpleString()}" for k in keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        x = np.column_stack([np.ones(len(pdf)), pdf[list(regressors)].to_numpy(float)])
        yy = pdf[y].to_numpy(float)
        bread = np.linalg.pinv(x.T @ x)
        beta = bread @ (x.T @ yy)
        u = x * (yy - x @ beta)[:, None]
        meat = u.T @ u
        most = int(pdf[lags].iloc[0]) - 1 if isinstance(lags, str) else lags
        for lag in range(1, min(most, len(u) - 1) + 1):
            g = u[lag:].T @ u[:-lag]
            meat += (1 - lag / (most + 1)) * (g + g.T)
        se = np.sqrt(np.clip(np.diag(bread @ meat @ bread), 0, None))
        head = {k: [pdf[k].iloc[0]] * len(names) for k in keys}
        return pd.DataFrame({**head, "term": names, "coefficient": beta, "se": se, "months": len(pdf)})

    needed = monthly.select(*keys, date, y, *regressors)
    return needed.groupBy(*keys).applyInPandas(solve, f"{fields}, term string, coefficient double, se double, months long")


def winsorize_standardize(df: DataFrame, keys: Sequence[str], columns: Sequence[str], lower=DEFAULT.winsor_lower, upper=DEFAULT.winsor_upper) -> DataFrame:
    """Per cross-section: clip to two quantiles, fill with the median, then centre and scale (population std).

    Clipping keeps the median, so that the three order statistics are one pass; a column without any value stays missing.
    """
    keys = list(keys)
    from pitscape.operators.robust import zscore_within

    long = df.select(*keys, *columns).unpivot(keys, list(columns), "component", "value")
    # few cross-sections: rows need not be shuffled a column each for their order statistics
    few = df.select(*keys).distinct().limit(FEW_GROUPS + 1).count() * len(columns) <= FEW_GROUPS
    bounds = quantiles(long, [*keys, "component"], "value", {"lo": lower, "hi": upper, "mid": 0.5}, few=few)
    wide = bounds.groupBy(*keys).agg(*[F.max(F.when(F.col("component") == c, F.struct("lo", "hi", "mid"))).alias(f"__{c}") for c in columns])
    clipped = df.join(wide, keys).withColumns(
        {c: F.coalesce(F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c).cast("double"), F.col(f"__{c}.hi")), F.col(f"__{c}.lo"))), F.col(f"__{c}.mid")) for c in columns}
    ).drop(*[f"__{c}" for c in columns])
    return zscore_within(clipped, keys, columns)


def cross_section_regressions(
    targets: DataFrame, signals: Sequence[str], controls: Sequence[str], p: Params = DEFAULT
) -> DataFrame:
    """Cross-sectional regression per horizon, signal and date.

    The design (standardised signal and controls, industry dummies, first one dropped)
    enters through its moments: X'X, X'y and y'y are plain grouped sums over the rows,
    whatever the size of a cross-section; only the small solves run per cross-section.
    ``rank_ic``, on the signal's row, is the rank correlation of signal and return.  A cross-section that cannot be fitted is one row
    whose ``status`` says why: ``too_few_rows``, ``no_degrees_of_freedom`` or ``rank_deficient``; all others are ``fitted``.
    """
    eligible = targets.filter(S.when_all(F.col("target_valid"), F.col("forward_excess_return").isNotNull(), F.col("sic1").isNotNull()))
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x_signal")) for s in signals])
    others = [c for c in controls if c not in signals]
    long = eligible.select("event_id", "horizon_months", "feature_date", "fold", "sic1", "forward_excess_return",
                           *[F.col(c).cast("double").alias(f"x_{c}") for c in others], F.inline(pairs)).filter(F.col("x_signal").isNotNull())
    section = ["horizon_months", "signal", "feature_date"]
    terms = ["x_signal", *[f"x_{c}" for c in others]]
    scaled = winsorize_standardize(long, section, terms).fillna(0.0, terms)  # a control without any value
    # per (cross-section, industry) moments; dummies need only these sums
    cols = [*terms, "forward_excess_return"]
    moments = [F.count(F.lit(1)).alias("n"), F.min("fold").alias("fold0"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)]]
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            moments.append(F.sum(F.col(a) * F.col(cols[j])).alias(f"q_{i}_{j}"))
    grouped = scaled.groupBy(*section, "sic1").agg(*moments)
    k, minimum = len(cols), p.min_cross_section

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sic1")
        n, m = int(pdf["n"].sum()), len(pdf)
        size = 1 + (k - 1) + (m - 1)
        first = pdf.iloc[0]
        head = {"horizon_months": int(first["horizon_months"]), "signal": first["signal"], "feature_date": first["feature_date"]}
        refuse = lambda why: pd.DataFrame([{**head, "term": None, "coefficient": None, "r_squared": None, "cross_section_rows": n, "fold": int(pdf["fold0"].min()), "status": why}])
        if n < minimum:
            return refuse("too_few_rows")
        if n <= size + 5:
            return refuse("no_degrees_of_freedom")
        sums = pdf[[f"s_{i}" for i in range(k)]].to_numpy(float)
        xx, xy = np.zeros((size, size)), np.zeros(size)
        total = sums.sum(axis=0)
        xx[0, 0], xx[0, 1:k], xy[0] = n, total[: k - 1], total[k - 1]
        for i in range(k - 1):
            for j in range(i, k - 1):
                xx[1 + i, 1 + j] = xx[1 + j, 1 + i] = pdf[f"q_{i}_{j}"].sum()
            xy[1 + i] = pdf[f"q_{i}_{k - 1}"].sum()
        for d in range(1, m):
            at = k + d - 1
            xx[0, at] = xx[at, at] = pdf["n"].iloc[d]
            xx[1:k, at] = sums[d, : k - 1]
            xy[at] = sums[d, k - 1]
        xx = np.triu(xx) + np.triu(xx, 1).T
        scale = np.sqrt(np.clip(np.diag(xx), 1e-300, None))
        if np.linalg.matrix_rank(xx / np.outer(scale, scale), tol=1e-10) < size:
            return refuse("rank_deficient")
        beta = np.linalg.solve(xx, xy)
        yy = pdf[f"q_{k - 1}_{k - 1}"].sum()
        spread = yy - total[k - 1] ** 2 / n
        r2 = 1 - (yy - beta @ xy) / spread if spread > 0 else np.nan
        names = ["intercept", *[c[2:] for c in cols[:-1]]]
        return pd.DataFrame({**head, "term": names, "coefficient": beta[:k], "r_squared": r2, "cross_section_rows": n, "fold": int(pdf["fold0"].min()), "status": "fitted"})

    schema = "horizon_months int, signal string, feature_date date, term string, coefficient double, r_squared double, cross_section_rows long, fold int, status string"
    fitted = grouped.groupBy(*section).applyInPandas(solve, schema)
    ic = spearman(long, section, "x_signal", "forward_excess_return").select(*section, F.col("spearman").alias("__ic"))
    return fitted.join(ic, section, "left").withColumn("rank_ic", F.when(F.col("term") == "signal", F.col("__ic"))).drop("__ic")


def cross_section_summary(monthly: DataFrame, minimum_months: int = 24, primary: tuple[int, str] | None = None) -> DataFrame:
    """Mean coefficient and mean rank IC of every horizon and signal with HAC errors of horizon - 1 lags, and Holm's adjustment over all of them.

    A series of fewer than ``minimum_months`` fitted cross-sections has a row with its ``status`` and no inference, and is no test of the family.
    """
    keys = ["horizon_months", "signal"]
    lags = F.col("horizon_months") - 1
    fitted = monthly.filter("term = 'signal'")
    sizes = monthly.groupBy(*keys).agg(
        F.count(F.when(F.col("term") == "signal", 1)).alias("months"), F.sum(F.when(F.col("term") == "signal", F.col("cross_section_rows"))).alias("observations"),
        F.countDistinct(F.when(F.col("status") != "fitted", F.col("feature_date"))).alias("skipped_months"),
    )
    enough = sizes.filter(F.col("months") >= minimum_months).select(*keys)
    rows = fitted.join(enough, keys, "left_semi")
    series = lambda c, name: newey_west_mean(rows, keys, "feature_date", c, lags).select(*keys, F.col("mean").alias(f"mean_{name}"), F.col("se").alias(f"{name}_hac_se"), F.col("t").alias(f"{name}_t")).withColumn(f"{name}_p_value", normal_two_sided_p(f"{name}_t"))
    folds = rows.groupBy(*keys, "fold").agg(F.avg("coefficient").alias("c")).groupBy(*keys).agg(F.avg((F.col("c") > 0).cast("double")).alias("positive_fold_share"))
    tested = series("coefficient", "coefficient").join(series("rank_ic", "rank_ic"), keys, "left").join(folds, keys)
    tested = holm(tested.withColumns({"__test": F.concat_ws("|", *keys), "__all": F.lit(1)}), ["__all"], "coefficient_p_value", "__test").drop("__all", "__test")
    own = (F.col("horizon_months") == primary[0]) & (F.col("signal") == primary[1]) if primary else F.lit(False)
    status = F.when(F.col("mean_coefficient").isNull(), "too_few_months").otherwise("tested")
    return sizes.join(tested, keys, "left").withColumns({"holm_reject_5pct": F.col("holm_p") < 0.05, "is_primary": own, "status": status})
