"""Execution liquidity, capacity, executed positions, trading and borrowing costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitscape.functions import scalars as S
from pitscape.functions.ordering import quantiles
from pitscape.operators.inference import alpha_columns, hac_lines
from pitscape.operators.returns import STRATEGY, cohort_positions, portfolio_summary
from pitscape.params import DEFAULT, Params


def execution_liquidity(months: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Half-spread, dollar volume, capacity, short availability and borrow tier."""
    price, cap = F.abs("prc"), F.col("market_cap_millions")
    quoted = (F.col("bid") > 0) & (F.col("ask") > F.col("bid"))
    quote = F.coalesce(quoted, F.lit(False))
    spread = F.when(quote, (F.col("ask") - F.col("bid")) / (F.col("ask") + F.col("bid"))).otherwise(p.fallback_spread_bps / 1e4)
    dollars = price * F.col("vol") * p.volume_multiplier
    adv = dollars / p.trading_days / 1e6
    both = F.col("adv_millions").isNotNull() & cap.isNotNull()
    room = F.when(both, F.greatest(F.least(F.col("adv_millions") * 1e6 * p.adv_share, cap * 1e6 * p.cap_share), F.lit(0.0)))
    usable = S.when_all(price > 0, F.col("vol") > 0, cap > 0)
    limit = F.when(usable & F.col("capacity_dollars").isNotNull(), F.least(F.lit(p.max_weight), F.col("capacity_dollars") / p.leg_capital)).otherwise(0.0)
    short_ok = usable & S.when_all(cap >= p.short_min_cap_millions, F.col("adv_millions") >= p.short_min_adv_millions)
    hard = F.coalesce(cap < p.hard_borrow_cap_millions, F.lit(False)) | F.coalesce(F.col("adv_millions") < p.hard_borrow_adv_millions, F.lit(False))
    return (
        months.withColumn("half_spread", F.greatest(F.least(spread, F.lit(p.max_half_spread)), F.lit(0.0)))
        .withColumn("spread_source", F.when(quote, "quoted").otherwise("fallback"))
        .withColumn("monthly_dollar_volume", dollars)
        .withColumn("adv_millions", adv)
        .withColumn("capacity_dollars", room)
        .withColumn("capacity_weight_limit", limit)
        .withColumn("short_available", short_ok)
        .withColumn("borrow_annual_bps", F.when(short_ok, F.when(hard, p.hard_borrow_bps).otherwise(p.easy_borrow_bps)))
    )


def cap_weights(assigned: DataFrame) -> DataFrame:
    """Cap each weight by its formation-time capacity, with the reason."""
    w, limit = F.col("weight"), F.greatest(F.coalesce("capacity_weight_limit", F.lit(0.0)), F.lit(0.0))
    blocked = (F.col("leg") == "short") & ~F.coalesce("short_available", F.lit(False))
    capped = F.when(blocked, 0.0).otherwise(F.least(w, limit))
    reason = (
        F.when(blocked, "short_unavailable").when(limit <= 0, "missing_or_zero_capacity")
        .when(F.col("capacity_weight") < w, "capacity_capped").otherwise("filled")
    )
    return (
        assigned.withColumn("capacity_weight", capped)
        .withColumn("capacity_fill_ratio", F.when(w > 0, F.col("capacity_weight") / w).otherwise(0.0))
        .withColumn("capacity_exclusion_reason", reason)
    )


def transaction_cost(change: Column, half_spread: Column, multiplier: Column, slippage_bps: Column) -> Column:
    return change * (multiplier * half_spread + slippage_bps / 1e4)


def borrow_cost(signed_weight: Column, annual_bps: Column) -> Column:
    return F.greatest(-signed_weight, F.lit(0.0)) * F.coalesce(annual_bps, F.lit(0.0)) / 1e4 / 12


def cost_assignments(assigned: DataFrame, months: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Formation-date liquidity on the assignments of the primary horizon, then caps."""
    liquid = execution_liquidity(months, p).select(
        "permno", F.col("date").alias("feature_date"), "half_spread", "capacity_weight_limit", "short_available", "borrow_annual_bps"
    )
    chosen = assigned.filter(F.col("horizon_months") == p.primary_return_horizon)
    return cap_weights(chosen.join(liquid, ["permno", "feature_date"], "left")).drop(
        "half_spread", "capacity_weight_limit", "short_available", "borrow_annual_bps"
    )


def lagged_liquidity(months: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Liquidity of month t serves month t+1, by calendar."""
    return execution_liquidity(months, p).select(
        "permno", F.last_day(F.add_months(F.last_day("date"), 1)).alias("holding_date"), F.col("date").alias("liquidity_date"),
        "half_spread", "spread_source", "capacity_weight_limit", "short_available", "borrow_annual_bps",
    )


def capacity_diagnostics(assigned: DataFrame) -> DataFrame:
    reason = F.col("capacity_exclusion_reason")
    middle = quantiles(assigned, [*STRATEGY, "leg"], "capacity_fill_ratio", {"median_fill": 0.5})
    counts = assigned.groupBy(*STRATEGY, "leg").agg(
        F.count(F.lit(1)).alias("assignments"), F.avg("capacity_fill_ratio").alias("mean_fill"),
        F.count(F.when(reason == "capacity_capped", 1)).alias("capped"),
        F.count(F.when(reason == "short_unavailable", 1)).alias("short_blocked"),
        F.count(F.when(reason == "missing_or_zero_capacity", 1)).alias("no_capacity"),
        F.count(F.when(F.col("capacity_fill_ratio") > 0, 1)).alias("executable"),
    )
    return counts.join(middle, [*STRATEGY, "leg"])


def executed_positions(
    assigned: DataFrame, paths: DataFrame, lagged: DataFrame, delay: int, p: Params = DEFAULT, broken_path: str = "raise"
) -> tuple[DataFrame, DataFrame]:
    """(positions, calendar) of capacity-limited weights, entered ``delay`` months late.

    ``broken_path``: a late entry may run into a month without a usable return; "raise" stops, "close"
    holds cash from that month on.
    """
    months = cohort_positions(assigned, paths, delay + 1, F.lit(delay + p.primary_return_horizon), broken_path)
    at = [*STRATEGY, "holding_date"]
    calendar = months.groupBy(*at).agg(F.countDistinct("feature_date").alias("active_cohorts"), F.min("rf").alias("rf"))
    signed = F.when(F.col("leg") == "long", F.col("capacity_weight")).otherwise(-F.col("capacity_weight"))
    if broken_path == "close":
        months = months.filter(~F.col("closed"))
    held = months.filter(~F.col("cash_after_delist")).groupBy(*at, "permno", "gvkey").agg(
        F.sum(signed).alias("__w"), F.min("return_used").alias("return_used"), F.max("return_used").alias("__r1"),
        F.max("valid_delist_event").alias("forced_exit"),
    )
    one_return = F.when(F.col("return_used") == F.col("__r1"), F.col("return_used")).otherwise(
        F.raise_error("one security-month has two returns").cast("double")
    )
    joined = held.withColumn("return_used", one_return).join(F.broadcast(calendar), at).join(lagged, ["permno", "holding_date"], "left")
    target = F.col("__w") / F.col("active_cohorts")
    limit = F.greatest(F.coalesce("capacity_weight_limit", F.lit(0.0)), F.lit(0.0))
    short_ok = F.coalesce("short_available", F.lit(False))
    fallback = p.fallback_spread_bps / 1e4
    size = F.when((F.col("target_weight") < 0) & ~short_ok, 0.0).otherwise(F.least(F.abs("target_weight"), limit))
    positions = joined.withColumn("target_weight", target).select(
        *at, "permno", "gvkey", "return_used", "rf", "forced_exit", "target_weight",
        (F.signum("target_weight") * size).alias("actual_weight"),
        F.when(F.abs("target_weight") > 0, size / F.abs("target_weight")).otherwise(0.0).alias("fill_ratio"),
        F.greatest(F.least(F.coalesce("half_spread", F.lit(fallback)), F.lit(p.max_half_spread)), F.lit(0.0)).alias("half_spread"),
        F.coalesce("spread_source", F.lit("fallback_missing_lag")).alias("spread_source"),
        F.coalesce("borrow_annual_bps", F.lit(0.0)).alias("borrow_annual_bps"), "capacity_weight_limit", "liquidity_date",
        F.lit(delay).alias("delay_months"),
    )
    return positions, calendar.withColumn("delay_months", F.lit(delay))


def costed_months(positions: DataFrame, calendar: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Gross, turnover, costs and net return per month and cost case.

    A position counts in its month and, with the opposite sign, in the next month of the
    strategy's calendar, so an all-cash month is a real predecessor.  The spread of a
    change is today's if the name is held, else last month's; closing a position after a
    forced exit changes the turnover but costs nothing.
    """
    group = [*STRATEGY, "delay_months"]
    following = F.lead("holding_date").over(W.partitionBy(*group).orderBy("holding_date"))
    cal = calendar.withColumn("__next", following)
    # a position moves once, to its security; both its sides and the sums by month follow there
    dealt = positions.select(*group, "holding_date", "permno", "actual_weight", "half_spread", "forced_exit").repartition(
        int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "permno"
    )
    held = dealt.join(F.broadcast(cal.select(*group, "holding_date", "__next")), [*group, "holding_date"])
    sides = F.array(
        F.struct(F.col("holding_date").alias("m"), F.col("actual_weight").alias("d"), F.lit(True).alias("now"), F.col("half_spread").alias("sp"), F.lit(False).alias("forced")),
        F.struct(F.col("__next").alias("m"), (-F.col("actual_weight")).alias("d"), F.lit(False).alias("now"), F.col("half_spread").alias("sp"), F.col("forced_exit").alias("forced")),
    )
    moved = held.select(*group, "permno", F.inline(sides)).filter(F.col("m").isNotNull())
    change = moved.groupBy(*group, F.col("m").alias("holding_date"), "permno").agg(
        F.abs(F.sum("d")).alias("change"), F.bool_or("now").alias("__held"), F.bool_or("forced").alias("__forced"),
        F.max(F.when(F.col("now"), F.col("sp"))).alias("__sp1"), F.max(F.when(~F.col("now"), F.col("sp"))).alias("__sp0"),
    ).withColumn("costed", F.when(F.col("__forced") & ~F.col("__held"), 0.0).otherwise(F.col("change"))).withColumn(
        "__sp", F.coalesce("__sp1", "__sp0")
    )
    cases = [(n, m, b) for n, m, b in p.cost_cases]
    per_case = [
        F.sum(transaction_cost(F.col("costed"), F.col("__sp"), F.lit(m), F.lit(b))).alias(f"tc_{n}") for n, m, b in cases
    ]
    trades = change.groupBy(*group, "holding_date").agg(
        (F.sum("change") / 2).alias("turnover"), (F.sum("costed") / 2).alias("costed_turnover"), *per_case
    )
    w = F.col("actual_weight")
    book = positions.groupBy(*group, "holding_date").agg(
        F.sum(w * F.col("return_used")).alias("__gross"), F.sum(F.greatest(w, F.lit(0.0))).alias("long_exposure"),
        F.sum(F.greatest(-w, F.lit(0.0))).alias("short_exposure"), F.sum(borrow_cost(w, F.col("borrow_annual_bps"))).alias("borrow_cost"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    base = calendar.join(book, [*group, "holding_date"], "left").join(trades, [*group, "holding_date"], "left").select(
        *group, "holding_date", "active_cohorts", "rf",
        (z("__gross") + (z("short_exposure") - z("long_exposure")) * F.col("rf")).alias("gross_return"),
        z("long_exposure").alias("long_exposure"), z("short_exposure").alias("short_exposure"), z("borrow_cost").alias("borrow_cost"),
        z("turnover").alias("turnover"), z("costed_turnover").alias("costed_turnover"), *[z(f"tc_{n}").alias(f"tc_{n}") for n, _, _ in cases],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("cost_case"), F.col(f"tc_{n}").alias("transaction_cost")) for n, _, _ in cases])
    out = base.select("*", F.inline(rows)).drop(*[f"tc_{n}" for n, _, _ in cases])
    return out.withColumn("net_return", F.col("gross_return") - F.col("transaction_cost") - F.col("borrow_cost"))


def cost_waterfall(months: DataFrame) -> DataFrame:
    """Mean gross, costs and net per strategy, with the error of the identity."""
    keys = [*STRATEGY, "delay_months", "cost_case"]
    out = months.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"), F.avg("gross_return").alias("gross"), F.avg("transaction_cost").alias("trading"),
        F.avg("borrow_cost").alias("borrowing"), F.avg("net_return").alias("net"),
    )
    return out.withColumn("reconciliation_error", F.abs(F.col("gross") - F.col("trading") - F.col("borrowing") - F.col("net")))


def delay_sensitivity(waterfall: DataFrame) -> DataFrame:
    """Net return of immediate against delayed execution, per strategy and cost case."""
    keys = [*STRATEGY, "cost_case"]
    now = waterfall.filter("delay_months = 0").select(*keys, F.col("net").alias("base_net"))
    late = waterfall.filter("delay_months > 0").select(*keys, "delay_months", F.col("net").alias("delayed_net"))
    return now.join(late, keys).withColumn("net_difference", F.col("delayed_net") - F.col("base_net"))


def net_summary(months: DataFrame, factors: DataFrame, factor_columns: Sequence[str], p: Params = DEFAULT) -> DataFrame:
    """Gross and net performance per strategy, delay and cost case, with costs, exposures and the factor line of the net returns.

    Every case is reported; ``factors`` must cover every month. The errors reach back the primary horizon less one month.
    """
    keys = [*STRATEGY, "delay_months", "cost_case"]
    means = months.groupBy(*keys).agg(
        F.min("holding_date").alias("first_month"), F.max("holding_date").alias("last_month"), F.avg("gross_return").alias("mean_monthly_gross_return"),
        F.avg("net_return").alias("mean_monthly_net_return"), F.avg("turnover").alias("average_turnover"), F.avg("costed_turnover").alias("average_costed_turnover"),
        (12 * F.avg("transaction_cost")).alias("annualized_transaction_cost"), (12 * F.avg("borrow_cost")).alias("annualized_borrow_cost"),
        F.avg((F.col("long_exposure") + F.col("short_exposure")) / 2).alias("average_capacity_fill_ratio"),
        F.avg("long_exposure").alias("average_long_gross_exposure"), F.avg("short_exposure").alias("average_short_gross_exposure"),
    )
    gross = portfolio_summary(months, keys, "holding_date", "gross_return").select(
        *keys, "months", F.col("annual_mean").alias("annualized_gross_return"), F.col("sharpe").alias("annualized_gross_sharpe")
    )
    net = portfolio_summary(months, keys, "holding_date", "net_return").select(
        *keys, F.col("annual_mean").alias("annualized_net_return"), F.col("sharpe").alias("annualized_net_sharpe"),
        F.col("maximum_drawdown").alias("net_maximum_drawdown"), F.col("hit_rate").alias("net_hit_rate"),
    )
    known = months.join(factors.select(F.col("date").alias("holding_date"), *factor_columns), "holding_date", "left")
    reach = p.primary_return_horizon - 1
    lines = hac_lines(known, keys, "holding_date", "net_return", factor_columns, reach, reach)
    return gross.join(net, keys).join(means, keys).join(alpha_columns(lines, keys, "net_"), keys)
