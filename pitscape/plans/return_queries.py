"""Forward returns, portfolios and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitscape.operators import costs as K
from pitscape.operators import describe as E
from pitscape.operators import panel as P
from pitscape.operators import returns as N
from pitscape.params import DEFAULT
from pitscape.plans import oracle_parts as Q
from pitscape.plans.panel_queries import CTES as PANEL
from pitscape.plans.registry import query, r
from pitscape.session import cut, stored
from pitscape.sources import derived as D

SIGNALS = ["migration_surprise", "viability_velocity", "historical_success_density"]
KEYS = "horizon_months, signal, weighting, industry_neutral"
CTES = dict(PANEL)
CTES["sev"] = "select * from signals"
CTES["pa0"] = """select e.*, o.k holding_offset, last_day(e.feature_date + to_months(cast(o.k as int))) holding_date
 from sev e cross join (select unnest(generate_series(1,12)) k) o"""
CTES["pa1"] = """select p.*, c.total_return ret_total, coalesce(c.has_delist,false) hd, coalesce(c.delist_return_missing,false) drm, f.rf, p.holding_date > (select max(date) from factors) bey
 from pa0 p left join compounded c on c.permno=p.permno and c.date=p.holding_date left join factors f on f.date=p.holding_date"""
CTES["pa2"] = """select *, hd and not drm and ret_total is not null vd from pa1"""
CTES["pa3"] = """select *, coalesce(bool_or(vd) over (partition by event_id order by holding_offset rows between unbounded preceding and 1 preceding),false) cash from pa2"""
CTES["paths"] = """select *, bool_and(not bey and (cash or (ret_total is not null and not drm))) over (partition by event_id order by holding_offset) ok,
 bool_or(vd) over (partition by event_id order by holding_offset) gone, case when cash then rf when not bey then ret_total end used from pa3"""
CTES["targets"] = """select *, case when target_valid then g end forward_total_return, case when target_valid then g - rfr end forward_excess_return,
 case when anymiss then 'missing_delisting_return' when anybey then 'beyond_calendar' when not target_valid then 'missing_return_path' when anygone then 'complete_after_delist' else 'complete' end target_status
 from (select event_id, gvkey, permno, feature_date, fold, sic1, market_cap_millions, migration_surprise, viability_velocity, historical_success_density,
  h.h horizon_months, count(*) path_months, bool_and(ok) target_valid, bool_or(drm) anymiss, bool_or(bey) anybey, bool_or(vd) anygone,
  product(1+used) - 1 g, product(1+rf) - 1 rfr from paths join (values (1),(3),(6),(12)) h(h) on holding_offset <= h.h group by all)"""
CTES["elig"] = """select t.*, s.s signal, case s.s when 'migration_surprise' then migration_surprise when 'viability_velocity' then viability_velocity else historical_success_density end sv
 from targets t cross join (values ('migration_surprise'),('viability_velocity'),('historical_success_density')) s(s)
 where target_valid and forward_excess_return is not null and market_cap_millions > 0 and sic1 is not null"""
CTES["wide"] = "select * from elig where sv is not null qualify count(*) over (partition by horizon_months, signal, feature_date) >= 30"
CTES["rnk"] = """select *, row_number() over (partition by horizon_months, signal, feature_date, industry_neutral, grp order by sv, event_id) rn,
 count(*) over (partition by horizon_months, signal, feature_date, industry_neutral, grp) gn
 from (select w.*, m.m industry_neutral, case when m.m then cast(sic1 as varchar) else 'all' end grp from wide w cross join (values (false),(true)) m(m))"""
CTES["sorts"] = """select *, case when industry_neutral then (case when ind > 0 then base/ind/k else 0 end) else base/leg end weight from (
 select *, sum(base) over (partition by horizon_months, signal, feature_date, industry_neutral, weighting, quantile, sic1) ind,
  sum(base) over (partition by horizon_months, signal, feature_date, industry_neutral, weighting, quantile) leg,
  count(distinct sic1) over (partition by horizon_months, signal, feature_date, industry_neutral, weighting, quantile) k
 from (select r.*, cast(greatest(1, ceil((rn-1)*5/(gn-1)::double)) as int) quantile, w.w weighting, case w.w when 'equal' then 1.0::double else market_cap_millions end base
  from rnk r cross join (values ('equal'),('value')) w(w) where not industry_neutral or gn >= 10))"""
CTES["asg"] = "select *, case when quantile=5 then 'long' else 'short' end leg_side from sorts where quantile in (1,5)"
CTES["qret"] = f"""select {KEYS}, feature_date, quantile, count(*) events, sum(weight*forward_total_return) tr, sum(weight*forward_excess_return) er, min(fold) fold
 from sorts group by all"""
CTES["pos"] = """select a.horizon_months, a.signal, a.weighting, a.industry_neutral, a.feature_date, a.gvkey, a.permno, a.leg_side, a.weight, p.holding_date, p.used, p.cash, p.vd, p.rf, p.holding_offset
 from asg a join paths p on p.event_id=a.event_id and p.holding_offset <= a.horizon_months"""
CTES["coh"] = f"select {KEYS}, feature_date, holding_date, sum(weight*used) filter (leg_side='long') l, sum(weight*used) filter (leg_side='short') s from pos group by all"
CTES["cal"] = f"select {KEYS}, holding_date, avg(l) lr, avg(s) sr, avg(l-s) ls, count(*) active from coh group by all"
CTES["nm"] = f"""select {KEYS}, holding_date, gvkey, sum(case leg_side when 'long' then weight else -weight end)/any_value(active) w
 from pos join cal using ({KEYS}, holding_date) group by all"""
CTES["mo"] = f"select {KEYS}, holding_date, row_number() over (partition by {KEYS} order by holding_date) i from (select distinct {KEYS}, holding_date from nm)"
CTES["nmi"] = f"select nm.*, i from nm join mo using ({KEYS}, holding_date)"
CTES["turn"] = f"""select {KEYS}, i, sum(abs(d))/2 turnover from (select {KEYS}, i, gvkey, sum(w) d from (
 select {KEYS}, i, gvkey, w from nmi union all select {KEYS}, i+1, gvkey, -w from nmi) group by all) group by all"""
CTES["liq"] = """select *, case when ok then least(0.10::double, cd/1e6::double) else 0 end lim, ok and market_cap_millions >= 25 and adv >= 0.10::double shortok,
 case when ok and market_cap_millions >= 25 and adv >= 0.10::double then case when market_cap_millions < 100 or adv < 0.5::double then 700.0::double else 300.0::double end end bps
 from (select *, greatest(least(adv*1e6::double*0.10::double, market_cap_millions*1e6::double*0.001::double),0) cd, coalesce(abs(prc)>0 and vol>0 and market_cap_millions>0,false) ok
 from (select *, abs(prc)*vol*1000 mdv, abs(prc)*vol*1000/21/1e6::double adv, coalesce(bid>0 and ask>bid,false) q,
  greatest(least(case when bid>0 and ask>bid then (ask-bid)/(ask+bid) else 0.005::double end, 0.05::double),0) hs from months))"""
CTES["casg"] = """select a.*, l.lim, l.shortok, case when leg_side='short' and not coalesce(shortok,false) then 0 else least(weight, greatest(coalesce(lim,0),0)) end cw
 from asg a left join liq l on l.permno=a.permno and l.date=a.feature_date where horizon_months=6"""
CTES["xpos0"] = """select a.event_id, a.signal, a.weighting, a.industry_neutral, a.horizon_months, d.d delay_months, p.holding_date, a.permno, a.gvkey, a.feature_date, p.rf, p.used, p.cash, p.vd, p.ok, p.bey,
 case leg_side when 'long' then cw else -cw end sw from casg a cross join (values (0),(1)) d(d) join paths p on p.event_id=a.event_id and p.holding_offset between d.d+1 and d.d+6"""
CTES["xok"] = "select * from xpos0 where not bey"
CTES["xcal"] = f"select {KEYS}, delay_months, holding_date, count(distinct feature_date) active, min(rf) rf from xok group by all"
CTES["xpos"] = f"""select *, sign(tw)*case when tw<0 and not coalesce(shortok,false) then 0 else least(abs(tw), greatest(coalesce(lim,0),0)) end aw,
 coalesce(hs, 0.005::double) hs1 from (
 select x.*, x.w/c.active tw, c.rf, l.lim, l.shortok, l.hs, l.bps, l.date ld from (select {KEYS}, delay_months, holding_date, permno, gvkey, sum(sw) w, min(used) used, bool_or(vd) forced
   from xok where not cash and ok group by all) x join xcal c using ({KEYS}, delay_months, holding_date)
 left join liq l on l.permno=x.permno and last_day(l.date + interval 1 day)=x.holding_date)"""
CTES["xmo"] = f"select *, row_number() over (partition by {KEYS}, delay_months order by holding_date) i from xcal"
CTES["xpi"] = f"select p.*, m.i from xpos p join xmo m using ({KEYS}, delay_months, holding_date)"
CTES["xch"] = f"""select *, abs(coalesce(aw1,0)-coalesce(aw0,0)) ch, case when coalesce(f0,false) and aw1 is null then 0 else abs(coalesce(aw1,0)-coalesce(aw0,0)) end cc, coalesce(s1,s0) sp from (
 select {KEYS}, delay_months, i, permno, max(aw) filter (now) aw1, max(aw) filter (not now) aw0, max(hs1) filter (now) s1, max(hs1) filter (not now) s0, bool_or(forced) filter (not now) f0
 from (select {KEYS}, delay_months, i, permno, aw, hs1, forced, true now from xpi union all select {KEYS}, delay_months, i+1, permno, aw, hs1, forced, false from xpi) group by all)"""
CTES["xmon"] = f"""select m.horizon_months, m.signal, m.weighting, m.industry_neutral, m.delay_months, m.holding_date, m.active, k.n cost_case,
 coalesce(b.g,0) + (coalesce(b.sh,0)-coalesce(b.lo,0))*m.rf gross_return, coalesce(b.bc,0) borrow_cost, coalesce(t.tu,0) turnover, coalesce(t.ct,0) costed_turnover,
 coalesce(case k.n when 'low' then t.t1 when 'conservative' then t.t2 else t.t3 end,0) transaction_cost
 from xmo m left join (select {KEYS}, delay_months, holding_date, sum(aw*used) g, sum(greatest(aw,0)) lo, sum(greatest(-aw,0)) sh, sum(greatest(-aw,0)*coalesce(bps,0)/1e4::double/12) bc
   from xpi group by all) b using ({KEYS}, delay_months, holding_date)
 left join (select {KEYS}, delay_months, i, sum(ch)/2 tu, sum(cc)/2 ct, sum(cc*(0.5::double*sp+0.0005::double)) t1, sum(cc*(sp+0.001::double)) t2, sum(cc*(1.5::double*sp+0.0025::double)) t3
   from xch group by all) t using ({KEYS}, delay_months, i) cross join (values ('low'),('conservative'),('severe')) k(n)"""
CTES["xwf"] = f"""select {KEYS}, delay_months, cost_case, count(*) as months, avg(gross_return) gross, avg(transaction_cost) trading, avg(borrow_cost) borrowing,
 avg(gross_return-transaction_cost-borrow_cost) net from xmon group by all"""


def history(spark, d):
    out = P.compound_exit_returns(D.security_months(spark, d), D.delistings(spark, d))
    return out.withColumn("gvkey", F.col("permno").cast("string"))


def paths_frame(spark, d, months=None):
    """Holding paths, written once for targets, portfolios and costs."""
    months = stored(history(spark, d)) if months is None else months
    events = D.signal_events(spark, d, months)
    return stored(N.forward_paths(events, months, cut(D.factors(spark, d))))


CARRIED = ["gvkey", "permno", "feature_date", "fold", "sic1", "market_cap_millions", *SIGNALS]


RETURNS = ["fold", "forward_total_return", "forward_excess_return"]


def sorts_frame(spark, d, paths, carried=("gvkey", "permno", *RETURNS)):
    return N.portfolio_sorts(N.forward_targets(paths, CARRIED), SIGNALS, carried=carried)


@query(
    "forward_paths",
    "select event_id, holding_offset, holding_date, vd as valid_delist_event, cash as cash_after_delist, ok as path_valid_through_month, gone as delisted_by_month, round(used,8) return_used from paths",
    CTES,
)
def forward_paths(spark, d):
    months = stored(history(spark, d))
    events = D.signal_events(spark, d, months)
    return N.forward_paths(events, months, D.factors(spark, d)).select(
        "event_id", "holding_offset", "holding_date", "valid_delist_event", "cash_after_delist", "path_valid_through_month",
        "delisted_by_month", r("return_used", 8).alias("return_used"),
    )


@query(
    "forward_targets",
    "select event_id, horizon_months, path_months, target_valid, target_status, round(forward_total_return,7) forward_total_return, round(forward_excess_return,7) forward_excess_return from targets",
    CTES,
)
def forward_targets(spark, d):
    return N.forward_targets(paths_frame(spark, d), CARRIED).select(
        "event_id", "horizon_months", "path_months", "target_valid", "target_status",
        r("forward_total_return", 7).alias("forward_total_return"), r("forward_excess_return", 7).alias("forward_excess_return"),
    )


@query("target_status_counts", "select horizon_months, target_status, count(*) n from targets group by 1,2", CTES)
def target_status_counts(spark, d):
    return N.forward_targets(paths_frame(spark, d), CARRIED).groupBy("horizon_months", "target_status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "portfolio_sorts",
    f"select {KEYS}, event_id, quantile, round(weight,9) weight from sorts",
    CTES,
)
def portfolio_sorts(spark, d):
    out = N.portfolio_sorts(N.forward_targets(paths_frame(spark, d), CARRIED), SIGNALS)
    return out.select(*N.STRATEGY, "event_id", "quantile", r("weight", 9).alias("weight"))


@query(
    "sort_attrition",
    """select t.horizon_months, s.s as signal, t.feature_date, count(*) events_total, count(*) filter (target_valid and forward_excess_return is not null and market_cap_millions > 0
  and case s.s when 'migration_surprise' then migration_surprise when 'viability_velocity' then viability_velocity else historical_success_density end is not null) events_eligible
 from targets t cross join (values ('migration_surprise'),('viability_velocity'),('historical_success_density')) s(s) group by 1,2,3""",
    CTES,
)
def sort_attrition(spark, d):
    return N.sort_attrition(N.forward_targets(paths_frame(spark, d), CARRIED), SIGNALS)


@query(
    "quantile_returns",
    f"select {KEYS}, feature_date, quantile, events, fold, round(tr,7) forward_total_return, round(er,7) forward_excess_return from qret",
    CTES,
)
def quantile_returns(spark, d):
    out = N.quantile_returns(sorts_frame(spark, d, paths_frame(spark, d)))
    return out.withColumns({c: r(c, 7) for c in ("forward_total_return", "forward_excess_return")})


@query(
    "cohort_spreads",
    f"""select {KEYS}, feature_date, round(max(er) filter (quantile=5) - max(er) filter (quantile=1),7) spread, round(corr(quantile, rk),7) monotonicity
 from (select *, {Q.avg_rank('er', KEYS + ', feature_date')} rk from qret) group by all having max(er) filter (quantile=5) is not null and max(er) filter (quantile=1) is not null""",
    CTES,
)
def cohort_spreads(spark, d):
    table = cut(N.quantile_returns(sorts_frame(spark, d, paths_frame(spark, d))))
    out = N.cohort_spreads(table)
    return out.select(*N.STRATEGY, "feature_date", r("long_short_excess_return", 7).alias("spread"), r("monotonicity", 7).alias("monotonicity"))


def monthly_frame(spark, d):
    paths = paths_frame(spark, d)
    legs = N.assignments(sorts_frame(spark, d, paths, ["gvkey"])).select(*N.STRATEGY, "event_id", "gvkey", "feature_date", "leg", "weight")
    return N.monthly_portfolios(N.cohort_positions(stored(legs), paths))


@query(
    "overlapping_portfolios",
    f"""select {KEYS}, holding_date, round(lr,8) long_return, round(sr,8) short_return, round(ls,8) long_short_return, active active_cohorts, round(turnover,7) turnover
 from cal join mo using ({KEYS}, holding_date) join turn using ({KEYS}, i)""",
    CTES,
)
def overlapping_portfolios(spark, d):
    out = monthly_frame(spark, d)
    return out.select(
        *N.STRATEGY, "holding_date", r("long_return", 8).alias("long_return"), r("short_return", 8).alias("short_return"),
        r("long_short_return", 8).alias("long_short_return"), "active_cohorts", r("turnover", 7).alias("turnover"),
    )


@query(
    "portfolio_exposures",
    f"""select {KEYS}, 'market_cap_millions' characteristic, round(sum(case leg_side when 'long' then weight else -weight end * market_cap_millions)/count(distinct feature_date),5) exposure, count(*) observations
 from asg group by all""",
    CTES,
)
def portfolio_exposures(spark, d):
    out = N.exposures(N.assignments(sorts_frame(spark, d, paths_frame(spark, d))), ["market_cap_millions"])
    return out.withColumn("exposure", r("exposure", 5))


@query(
    "portfolio_summary",
    f"""select {KEYS}, count(*) as months, round(avg(ls)*12,7) annual_mean, round(stddev_samp(ls)*sqrt(12),7) annual_volatility, round(avg(ls)*sqrt(12)/stddev_samp(ls),6) sharpe,
 round(min(w/pk-1),7) maximum_drawdown, round(avg((ls>0)::int),7) hit_rate
 from (select *, max(w) over (partition by {KEYS} order by holding_date) pk from (select *, product(1+ls) over (partition by {KEYS} order by holding_date) w from cal)) group by all""",
    CTES,
)
def portfolio_summary(spark, d):
    out = N.portfolio_summary(monthly_frame(spark, d), N.STRATEGY, "holding_date", "long_short_return")
    return out.withColumns({c: r(c, 7) for c in ("annual_mean", "annual_volatility", "maximum_drawdown", "hit_rate")}).withColumn("sharpe", r("sharpe", 6))


@query("factor_regression")
def factor_regression(spark, d):
    """Time-series regression with HAC errors; a matrix solve, checked in the tests."""
    monthly = monthly_frame(spark, d).join(D.factors(spark, d).withColumnRenamed("date", "holding_date"), "holding_date")
    return N.hac_regression(monthly, N.STRATEGY, "holding_date", "long_short_return", ["mkt_excess", "smb", "hml", "rmw", "cma", "mom"], "horizon_months")


@query("cross_section_regressions")
def cross_section_regressions(spark, d):
    """Cross-sectional regressions with industry dummies; checked in the tests."""
    targets = cut(N.forward_targets(paths_frame(spark, d), CARRIED))
    return N.cross_section_regressions(targets, SIGNALS, ["market_cap_millions"])


@query(
    "execution_liquidity",
    "select permno, date, round(hs,8) half_spread, round(adv,6) adv_millions, round(lim,8) capacity_weight_limit, shortok as short_available, bps as borrow_annual_bps from liq",
    CTES,
)
def execution_liquidity(spark, d):
    return K.execution_liquidity(D.security_months(spark, d)).select(
        "permno", "date", r("half_spread", 8).alias("half_spread"), r("adv_millions").alias("adv_millions"),
        r("capacity_weight_limit", 8).alias("capacity_weight_limit"), "short_available", "borrow_annual_bps",
    )


@query(
    "capacity_caps",
    f"""select {KEYS}, event_id, round(cw,9) capacity_weight, case when leg_side='short' and not coalesce(shortok,false) then 'short_unavailable'
  when coalesce(lim,0) <= 0 then 'missing_or_zero_capacity' when cw < weight then 'capacity_capped' else 'filled' end reason from casg""",
    CTES,
)
def capacity_caps(spark, d):
    months = D.security_months(spark, d)
    out = K.cost_assignments(N.assignments(sorts_frame(spark, d, paths_frame(spark, d))), months)
    return out.select(*N.STRATEGY, "event_id", r("capacity_weight", 9).alias("capacity_weight"), F.col("capacity_exclusion_reason").alias("reason"))


@query(
    "capacity_diagnostics",
    f"""select {KEYS}, leg_side as leg, count(*) assignments, round(avg(case when weight>0 then cw/weight else 0 end),8) mean_fill, round(median(case when weight>0 then cw/weight else 0 end),8) median_fill,
 count(*) filter (not (leg_side='short' and not coalesce(shortok,false)) and coalesce(lim,0)>0 and cw<weight) capped,
 count(*) filter (leg_side='short' and not coalesce(shortok,false)) short_blocked from casg group by all""",
    CTES,
)
def capacity_diagnostics(spark, d):
    months = D.security_months(spark, d)
    out = K.capacity_diagnostics(cut(K.cost_assignments(N.assignments(sorts_frame(spark, d, paths_frame(spark, d))), months)))
    return out.select(*N.STRATEGY, "leg", "assignments", r("mean_fill", 8).alias("mean_fill"), r("median_fill", 8).alias("median_fill"), "capped", "short_blocked")


def costed_frame(spark, d, signals=SIGNALS):
    months = stored(D.security_months(spark, d))
    past = P.compound_exit_returns(months, D.delistings(spark, d)).withColumn("gvkey", F.col("permno").cast("string"))
    paths = paths_frame(spark, d, stored(past))
    # costs are those of the primary horizon, and each horizon is sorted by itself
    targets = N.forward_targets(paths, CARRIED).filter(F.col("horizon_months") == DEFAULT.primary_return_horizon)
    sorts = N.portfolio_sorts(targets, list(signals), carried=["gvkey", "permno"])
    assigned = stored(K.cost_assignments(N.assignments(sorts), months))
    lagged = K.lagged_liquidity(months)
    p0, c0 = K.executed_positions(assigned, paths, lagged, 0)
    # a late entry may leave the calendar or lose its returns: it is closed then, and opened all the same
    p1, c1 = K.executed_positions(assigned, paths, lagged, 1, broken_path="close")
    return stored(p0.unionByName(p1)), cut(c0.unionByName(c1))


@query(
    "executed_positions",
    f"select {KEYS}, delay_months, holding_date, permno, round(tw,9) target_weight, round(aw,9) actual_weight, round(hs1,8) half_spread from xpos",
    CTES,
)
def executed_positions(spark, d):
    positions, _ = costed_frame(spark, d)
    return positions.select(
        *N.STRATEGY, "delay_months", "holding_date", "permno", r("target_weight", 9).alias("target_weight"),
        r("actual_weight", 9).alias("actual_weight"), r("half_spread", 8).alias("half_spread"),
    )


@query(
    "costed_months",
    f"""select {KEYS}, delay_months, holding_date, cost_case, round(gross_return,8) gross_return, round(transaction_cost,8) transaction_cost, round(borrow_cost,8) borrow_cost,
 round(turnover,7) turnover, round(costed_turnover,7) costed_turnover, round(gross_return-transaction_cost-borrow_cost,8) net_return from xmon""",
    CTES,
)
def costed_months(spark, d):
    out = K.costed_months(*costed_frame(spark, d))
    return out.select(
        *N.STRATEGY, "delay_months", "holding_date", "cost_case",
        *[r(c, 8).alias(c) for c in ("gross_return", "transaction_cost", "borrow_cost", "net_return")],
        r("turnover", 7).alias("turnover"), r("costed_turnover", 7).alias("costed_turnover"),
    )


@query(
    "cost_waterfall",
    f"select {KEYS}, delay_months, cost_case, months, round(gross,8) gross, round(trading,8) trading, round(borrowing,8) borrowing, round(net,8) net, abs(gross-trading-borrowing-net) < 1e-12 as reconciled from xwf",
    CTES,
)
def cost_waterfall(spark, d):
    out = K.cost_waterfall(K.costed_months(*costed_frame(spark, d)))
    return out.select(
        *N.STRATEGY, "delay_months", "cost_case", "months", *[r(c, 8).alias(c) for c in ("gross", "trading", "borrowing", "net")],
        (F.col("reconciliation_error") < 1e-12).alias("reconciled"),
    )


@query(
    "delay_sensitivity",
    f"""select a.horizon_months, a.signal, a.weighting, a.industry_neutral, a.cost_case, 1 as delay_months, round(a.net,8) base_net, round(b.net,8) delayed_net
 from xwf a join xwf b using ({KEYS}, cost_case) where a.delay_months=0 and b.delay_months=1""",
    CTES,
)
def delay_sensitivity(spark, d):
    out = K.delay_sensitivity(cut(K.cost_waterfall(K.costed_months(*costed_frame(spark, d)))))
    return out.select(*N.STRATEGY, "cost_case", "delay_months", r("base_net", 8).alias("base_net"), r("delayed_net", 8).alias("delayed_net"))


@query(
    "locked_signal_costs",
    f"select {KEYS}, delay_months, cost_case, months, round(net,8) net from xwf where signal='migration_surprise'",
    CTES,
)
def locked_signal_costs(spark, d):
    """The whole cost chain for one signal fixed in advance."""
    out = K.cost_waterfall(K.costed_months(*costed_frame(spark, d, ["migration_surprise"])))
    return out.select(*N.STRATEGY, "delay_months", "cost_case", "months", r("net", 8).alias("net"))


@query("cross_section_summary")
def cross_section_summary(spark, d):
    """Mean coefficient per horizon and signal with HAC error, p-value and Holm adjustment."""
    targets = cut(N.forward_targets(paths_frame(spark, d), CARRIED))
    monthly = cut(N.cross_section_regressions(targets, SIGNALS, ["market_cap_millions"]).filter("term = 'signal'"))
    mean = E.newey_west_mean(monthly, ["horizon_months", "signal"], "feature_date", "coefficient", F.col("horizon_months") - 1)
    folds = monthly.groupBy("horizon_months", "signal", "fold").agg(F.avg("coefficient").alias("c")).groupBy("horizon_months", "signal").agg(
        F.avg((F.col("c") > 0).cast("double")).alias("positive_fold_share")
    )
    tested = mean.join(folds, ["horizon_months", "signal"]).withColumn("p_value", E.normal_two_sided_p("t")).withColumn(
        "test", F.concat_ws("|", "horizon_months", "signal")
    ).withColumn("family", F.lit("all"))
    return E.holm(tested, ["family"], "p_value", "test").drop("family", "test")


@query(
    "cost_gate",
    f"""select count(*) as "rows", count(*) filter (abs(net - (gross_return-transaction_cost-borrow_cost)) > 1e-12) identity_errors,
 (select count(*) from xpos where abs(aw) > greatest(coalesce(lim,0),0) + 1e-12 or ld >= holding_date) over_capacity,
 count(*) filter (transaction_cost < 0 or borrow_cost < 0) negative_costs
 from (select *, gross_return-(transaction_cost+borrow_cost) net from xmon)""",
    CTES,
)
def cost_gate(spark, d):
    """Net equals gross minus costs, weights stay inside their lagged capacity, costs are not negative."""
    positions, calendar = costed_frame(spark, d)
    room = F.greatest(F.coalesce("capacity_weight_limit", F.lit(0.0)), F.lit(0.0))
    late = F.col("liquidity_date") >= F.col("holding_date")
    over = positions.agg(F.count(F.when((F.abs("actual_weight") > room + 1e-12) | late, 1)).alias("over_capacity"))
    bad = lambda c: F.count(F.when(c, 1))
    months = K.costed_months(positions, calendar).agg(
        F.count(F.lit(1)).alias("rows"),
        bad(F.abs(F.col("gross_return") - F.col("transaction_cost") - F.col("borrow_cost") - F.col("net_return")) > 1e-12).alias("identity_errors"),
        bad((F.col("transaction_cost") < 0) | (F.col("borrow_cost") < 0)).alias("negative_costs"),
    )
    return months.join(over)
