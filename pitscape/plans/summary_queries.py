"""Performance of whole strategies: fold tables, factor lines and net results."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitscape.operators import costs as K
from pitscape.operators import returns as N
from pitscape.plans import oracle_parts as Q
from pitscape.plans.registry import query, r
from pitscape.plans.return_queries import CTES as RETURNS
from pitscape.plans.return_queries import KEYS, costed_frame, monthly_frame, paths_frame, sorts_frame
from pitscape.session import cut
from pitscape.sources import derived as D

FACTORS = ["mkt_excess", "smb", "hml", "rmw", "cma", "mom"]
#: two-sided 5 % point of the normal distribution
NORMAL_5 = 1.959963984540054
CTES = dict(RETURNS)
CTES["spr"] = f"""select {KEYS}, feature_date, max(er) filter (quantile=5) - max(er) filter (quantile=1) x, max(tr) filter (quantile=5) - max(tr) filter (quantile=1) xt, corr(quantile, rk) mono,
 max(fold) filter (quantile=5) fold from (select *, {Q.avg_rank('er', KEYS + ', feature_date')} rk from qret) group by all having x is not null"""
CTES["spri"] = f"select *, x - avg(x) over g e, count(*) over g n, row_number() over (partition by {KEYS}, fold order by feature_date) i from spr window g as (partition by {KEYS}, fold)"
CTES["sprv"] = f"""select a.horizon_months, a.signal, a.weighting, a.industry_neutral, a.fold, sum(case when a.i=b.i then 1.0::double else 2*(1-(a.i-b.i)/a.horizon_months::double) end*a.e*b.e) v
 from spri a join spri b on a.horizon_months=b.horizon_months and a.signal=b.signal and a.weighting=b.weighting and a.industry_neutral=b.industry_neutral and a.fold=b.fold and a.i-b.i between 0 and a.horizon_months-1 group by all"""


def _line(prefix: str, source: str, keys: str, y: str, lags: str) -> dict[str, str]:
    """CTEs of a factor line by successive orthogonalisation: each factor is taken out of all later columns, the constant's
    remainder then carries the intercept and its influence."""
    columns = [*FACTORS, "c", "y"]
    out = {f"{prefix}0": f"select {keys}, holding_date, {y} y, {y} y0, 1.0::double c, {', '.join('f.' + x for x in FACTORS)} from {source} join factors f on f.date = holding_date"}
    for i, x in enumerate(FACTORS):
        later = ", ".join(f"{v} - sum({v}*{x}) over g / sum({x}*{x}) over g * {x} as {v}" for v in columns[i + 1 :])
        out[f"{prefix}{i + 1}"] = f"select {keys}, holding_date, y0, {later} from {prefix}{i} window g as (partition by {keys})"
    out[f"{prefix}e"] = f"""select *, alpha, (y - alpha*c) e, c*(y - alpha*c)/sum(c*c) over g psi, row_number() over (partition by {keys} order by holding_date) i
 from (select *, sum(y*c) over g / sum(c*c) over g alpha from {prefix}{len(FACTORS)} window g as (partition by {keys})) window g as (partition by {keys})"""
    same = " and ".join(f"a.{k.strip()}=b.{k.strip()}" for k in keys.split(","))
    a = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    out[f"{prefix}v"] = f"""select {a}, sqrt(sum(case when a.i=b.i then 1.0::double else 2*(1-(a.i-b.i)/({lags}+1)::double) end*a.psi*b.psi)) se
 from {prefix}e a join {prefix}e b on {same} and a.i-b.i between 0 and {lags} group by all"""
    out[f"{prefix}l"] = f"select {keys}, any_value(alpha) alpha, any_value(se) se, 1-sum(e*e)/(var_pop(y0)*count(*)) r2 from {prefix}e join {prefix}v using ({keys}) group by all"
    return out


_XKEYS = f"{KEYS}, delay_months, cost_case"
CTES |= _line("gl", "cal", KEYS, "ls", "a.horizon_months-1")
CTES["xnet"] = f"select x.*, gross_return-transaction_cost-borrow_cost net, coalesce(lo,0) lo, coalesce(sh,0) sh from xmon x left join (select {KEYS}, delay_months, holding_date, sum(greatest(aw,0)) lo, sum(greatest(-aw,0)) sh from xpi group by all) using ({KEYS}, delay_months, holding_date)"
CTES |= _line("nl", "xnet", _XKEYS, "net", "5")


@query(
    "fold_spreads",
    f"""select {KEYS}, fold, any_value(n) formation_cohorts, round(avg(x),8) mean_long_short_excess_return, case when any_value(n)>1 then round(sqrt(any_value(v))/any_value(n),8) end hac_standard_error,
 case when any_value(n)>1 then abs(avg(x)/nullif(sqrt(any_value(v))/any_value(n),0)) > {NORMAL_5}::double end significant, round(avg(xt),8) mean_long_short_total_return, round(avg(mono),8) mean_monotonicity
 from spri join sprv using ({KEYS}, fold) group by all""",
    CTES,
)
def fold_spreads(spark, d):
    """Mean top-less-bottom return of each strategy and fold, with an error for overlapping horizons."""
    table = cut(N.quantile_returns(sorts_frame(spark, d, paths_frame(spark, d))))
    out = N.fold_spreads(cut(N.cohort_spreads(table)))
    return out.select(
        *N.STRATEGY, "fold", "formation_cohorts", r("mean_long_short_excess_return", 8).alias("mean_long_short_excess_return"), r("hac_standard_error", 8).alias("hac_standard_error"),
        (F.col("p_value") < 0.05).alias("significant"), r("mean_long_short_total_return", 8).alias("mean_long_short_total_return"), r("mean_monotonicity", 8).alias("mean_monotonicity"),
    )


@query(
    "factor_summary",
    f"""select {KEYS}, count(*) as months, min(holding_date) first_month, max(holding_date) last_month, round(avg(ls),8) mean_monthly_gross_return, round(avg(ls)*sqrt(12)/stddev_samp(ls),6) sharpe,
 round(min(w/pk-1),7) maximum_drawdown, round(avg((ls>0)::int),7) hit_rate, round(avg(turnover),7) average_turnover, round(avg(active),7) average_active_cohorts,
 round(any_value(alpha),7) factor_alpha_monthly, round(any_value(se),7) factor_alpha_hac_standard_error, abs(any_value(alpha)/any_value(se)) > {NORMAL_5}::double significant, round(any_value(r2),6) factor_r_squared
 from (select *, max(w) over (partition by {KEYS} order by holding_date) pk from (select *, product(1+ls) over (partition by {KEYS} order by holding_date) w from cal join mo using ({KEYS}, holding_date) left join turn using ({KEYS}, i)))
 join gll using ({KEYS}) group by all""",
    CTES,
)
def factor_summary(spark, d):
    """Gross performance of every strategy and the line of its returns on the factors."""
    out = N.factor_summary(cut(monthly_frame(spark, d)), cut(D.factors(spark, d)), FACTORS)
    return out.select(
        *N.STRATEGY, "months", "first_month", "last_month", r("mean_monthly_gross_return", 8).alias("mean_monthly_gross_return"), r("sharpe").alias("sharpe"),
        *[r(c, 7).alias(c) for c in ("maximum_drawdown", "hit_rate", "average_turnover", "average_active_cohorts", "factor_alpha_monthly", "factor_alpha_hac_standard_error")],
        (F.col("factor_alpha_p_value") < 0.05).alias("significant"), r("factor_r_squared").alias("factor_r_squared"),
    )


@query(
    "net_summary",
    f"""select {_XKEYS}, count(*) as months, round(avg(gross_return)*12,7) annualized_gross_return, round(avg(net)*12,7) annualized_net_return, round(avg(net)*sqrt(12)/stddev_samp(net),6) annualized_net_sharpe,
 round(min(w/pk-1),7) net_maximum_drawdown, round(avg((net>0)::int),7) net_hit_rate, round(avg(costed_turnover),7) average_costed_turnover, round(avg(transaction_cost)*12,7) annualized_transaction_cost,
 round(avg(borrow_cost)*12,7) annualized_borrow_cost, round(avg((lo+sh)/2),7) average_capacity_fill_ratio, round(any_value(alpha),7) net_factor_alpha_monthly, round(any_value(se),7) net_factor_alpha_hac_standard_error,
 round(any_value(r2),6) net_factor_r_squared from (select *, max(w) over (partition by {_XKEYS} order by holding_date) pk from (select *, product(1+net) over (partition by {_XKEYS} order by holding_date) w from xnet))
 join nll using ({_XKEYS}) group by all""",
    CTES,
)
def net_summary(spark, d):
    """What is left after trading and borrowing, per strategy, delay and cost case."""
    months = cut(K.costed_months(*costed_frame(spark, d)))
    out = K.net_summary(months, cut(D.factors(spark, d)), FACTORS)
    names = [
        "annualized_gross_return", "annualized_net_return", "net_maximum_drawdown", "net_hit_rate", "average_costed_turnover", "annualized_transaction_cost", "annualized_borrow_cost",
        "average_capacity_fill_ratio", "net_factor_alpha_monthly", "net_factor_alpha_hac_standard_error",
    ]
    return out.select(
        *N.STRATEGY, "delay_months", "cost_case", "months", *[r(c, 7).alias(c) for c in names], r("annualized_net_sharpe").alias("annualized_net_sharpe"), r("net_factor_r_squared").alias("net_factor_r_squared"),
    )
