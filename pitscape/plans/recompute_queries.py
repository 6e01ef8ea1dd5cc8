"""Saved tables next to recomputations of them, and the gates that go with them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitscape.operators import audit as U
from pitscape.operators import components as C
from pitscape.operators import dynamics as Y
from pitscape.operators import lineage as G
from pitscape.operators import models as M
from pitscape.operators import panel as P
from pitscape.operators import recompute as A
from pitscape.operators import returns as N
from pitscape.params import DEFAULT
from pitscape.plans import oracle_parts as Q
from pitscape.plans.label_queries import FEATURES
from pitscape.plans.model_queries import CTES as MODELS
from pitscape.plans.model_queries import LOCAL, surface_frame
from pitscape.plans.registry import query, r
from pitscape.plans.return_queries import CARRIED, CTES as RETURNS
from pitscape.plans.return_queries import KEYS, SIGNALS, history, monthly_frame
from pitscape.plans.score_queries import report_components
from pitscape.session import checkpoint_folder, cut, stored
from pitscape.sources import derived as D

CTES = dict(RETURNS)
_T = lambda c: f"(year({c})*12 + month({c}) - 1)"
CTES["pfcal"] = f"select {_T('date')} t, rf, sum(ln(1+rf)) over (order by date) c from factors"
CTES["pfrow"] = f"""select permno, {_T('date')} t, case when not coalesce(delist_return_missing,false) then total_return end r, coalesce(delist_return_missing,false) f,
 coalesce(has_delist,false) and not coalesce(delist_return_missing,false) and total_return is not null x from compounded"""
CTES["pfden"] = "select permno, unnest(generate_series(least(min(t), any_value(t0))-1, greatest(max(t), any_value(t1)))) t, any_value(t1) t1 from pfrow cross join (select min(t) t0, max(t) t1 from pfcal) group by permno"
CTES["pfx"] = """select permno, t, t1, coalesce(sum(ln(1+r)) over w,0) g, count(r) over w u, count(case when f then 1 end) over w fl, coalesce(last_value(c ignore nulls) over w,0) c, max(t) over (partition by permno) t2,
 min(case when x then t end) over (partition by permno order by t rows between 1 following and unbounded following) nx
 from pfden left join pfrow using (permno, t) left join pfcal using (t) window w as (partition by permno order by t)"""
CTES["pft"] = f"""select e.event_id, h.h horizon_months, h.h::bigint path_months, m + h.h > a.t1 bey, a.nx <= m + h.h gone, c.fl > a.fl miss, coalesce(b.u - a.u,0) = least(coalesce(a.nx, m + h.h), m + h.h) - m fu,
  exp(b.g - a.g + c.c - b.c) - 1 g, exp(c.c - a.c) - 1 rf
 from (select *, {_T('feature_date')} m from sev) e cross join (values (1),(3),(6),(12)) h(h) join pfx a on a.permno = e.permno and a.t = m
 join pfx b on b.permno = e.permno and b.t = least(coalesce(a.nx, m + h.h), m + h.h, a.t2) join pfx c on c.permno = e.permno and c.t = least(m + h.h, a.t2)"""
CTES["pftar"] = """select event_id, horizon_months, path_months, fu and not bey target_valid, case when fu and not bey then g end tr, case when not bey then rf end rf, case when fu and not bey then g - rf end er,
 case when coalesce(miss,false) then 'missing_delisting_return' when bey then 'beyond_calendar' when not fu then 'missing_return_path' when coalesce(gone,false) then 'complete_after_delist' else 'complete' end st from pft"""
_KINDS = {
    "rows_compared": "a.event_id is not null and b.event_id is not null", "only_saved": "b.event_id is null", "only_recomputed": "a.event_id is null", "repeated_key": "false",
    "path_months": "a.path_months <> b.path_months", "target_valid": "a.target_valid <> b.target_valid", "target_status": "a.target_status <> b.st",
    "forward_total_return": "abs(a.forward_total_return - b.tr) > 1e-9 or (a.forward_total_return is null) <> (b.tr is null)",
    "forward_risk_free_return": "abs(a.rfr - b.rf) > 1e-9 and not b.st in ('beyond_calendar') and b.rf is not null",
    "forward_excess_return": "abs(a.forward_excess_return - b.er) > 1e-9 or (a.forward_excess_return is null) <> (b.er is null)",
}
TARGET = ["path_months", "target_valid", "target_status", "forward_total_return", "forward_risk_free_return", "forward_excess_return"]


CTES["pfdiff"] = (
    "select coalesce(a.horizon_months, b.horizon_months) horizon_months, " + ", ".join(f"count(*) filter ({cond}) {k}" for k, cond in _KINDS.items())
    + " from targets a full join pftar b on a.event_id = b.event_id and a.horizon_months = b.horizon_months group by 1"
)


@query(
    "target_recompute",
    " union all ".join(f"select horizon_months, '{k}' kind, {k} as \"rows\" from pfdiff" for k in _KINDS),
    CTES,
)
def target_recompute(spark, d):
    """Targets taken from whole paths against targets from two points of prefix products each: differences by horizon and kind."""
    months = cut(history(spark, d))
    factors, events = D.factors(spark, d), D.signal_events(spark, d, months)
    saved = N.forward_targets(N.forward_paths(events, months, factors), CARRIED)
    again = A.targets_by_prefix(events, months, factors)
    return A.differences_by_kind(saved, again, ["event_id", "horizon_months"], TARGET, ["horizon_months"])


@query(
    "path_gate",
    """select 'repeated_event' as "check", (select count(*) from (select event_id from sev group by 1 having count(*) > 1)) violations
 union all select 'repeated_path_month', (select count(*) from (select event_id, holding_offset from paths group by all having count(*) > 1))
 union all select 'repeated_target', (select count(*) from (select event_id, horizon_months from targets group by all having count(*) > 1))
 union all select 'incomplete_path', (select count(*) from (select distinct event_id from sev) e left join (select event_id, count(*) n, min(holding_offset) lo, max(holding_offset) hi from paths group by 1) q using (event_id)
  where coalesce(n <> 12 or lo <> 1 or hi <> 12, true))
 union all select 'incomplete_ladder', (select count(*) from (select distinct event_id from sev) e left join (select event_id, count(distinct horizon_months) n from targets group by 1) q using (event_id) where coalesce(n <> 4, true))
 union all select 'month_before_formation', (select count(*) from paths where holding_date <= feature_date)
 union all select 'cash_differs_from_rate', (select count(*) from paths where cash and not bey and (used is null or used <> rf))
 union all select 'invalid_with_return', (select count(*) from targets where not target_valid and (forward_total_return is not null or forward_excess_return is not null))
 union all select 'valid_without_return', (select count(*) from targets where target_valid and forward_total_return is null)""",
    CTES,
)
def path_gate(spark, d):
    months = cut(history(spark, d))
    factors, events = D.factors(spark, d), cut(D.signal_events(spark, d, months))
    paths = cut(N.forward_paths(events, months, factors))
    return A.path_gate(events, paths, N.forward_targets(paths, CARRIED))


_LADDER = len(DEFAULT.return_horizons) * len(SIGNALS) * 4


@query(
    "portfolio_gate",
    f"""select {_LADDER} - (select count(*) from (select distinct {KEYS} from cal)) missing_strategies, count(*) "rows",
 count(*) filter (turnover is null or turnover < 0) bad_turnover, count(*) filter (lr is null or sr is null or abs(ls - (lr - sr)) > 1e-12) bad_spread from cal join mo using ({KEYS}, holding_date) left join turn using ({KEYS}, i)""",
    CTES,
)
def portfolio_gate(spark, d):
    """The ladder of strategies is whole, turnover is there and not negative, the spread is long less short."""
    months = cut(monthly_frame(spark, d))
    bad = lambda c: F.count(F.when(F.coalesce(c, F.lit(True)), 1))
    rows = months.agg(
        F.count(F.lit(1)).alias("rows"), bad(F.col("turnover") < 0).alias("bad_turnover"),
        bad(F.abs(F.col("long_short_return") - (F.col("long_return") - F.col("short_return"))) > 1e-12).alias("bad_spread"),
    )
    ladder = months.select(*N.STRATEGY).distinct().agg((F.lit(_LADDER) - F.count(F.lit(1))).alias("missing_strategies"))
    return ladder.join(rows)


@query(
    "dynamics_gate",
    """select 'level_outside_unit_interval' as "check", count(*) as "rows", count(*) filter (predicted_survival is null or predicted_survival not between 0 and 1) violations from m
 union all select 'log_odds', count(*), count(*) filter (abs(lo - o) > 1e-9) from m
 union all select 'frontier_margin', count(*), count(*) filter (abs(mg - (o - ln(0.5::double/0.5::double))) > 1e-9) from m
 union all select 'constant_hazard', count(*), count(*) filter (abs(hz + ln(greatest(least(predicted_survival,1),1e-6::double))/horizon_years) > 1e-9) from m
 union all select 'velocity_inside_a_vintage', count(*) filter (s), count(*) filter (s and abs(vl - (o - plo)/el) > 1e-9) from m
 union all select 'velocity_across_vintages', count(*) filter (not s), count(*) filter (not s and vl is not null) from m""",
    {**MODELS, "m": "select *, ln(pc/(1-pc)) o, coalesce(pf = fold and el > 0, false) s from mot"},
)
def dynamics_gate(spark, d):
    """Levels, log odds, margins, hazards and velocities of the dynamics table, computed again from its levels."""
    return A.dynamics_gate(Y.motion(surface_frame(spark, d)), frontier=LOCAL.frontier)


_PERIODS = {"overall": (1996, 2000), "calibration": (1996, 1998), "held_out": (1999, 2000), "block1": (1999, 1999), "block2": (2000, 2000)}
_CAND = ("migration_surprise", "viability_velocity")
CTES["elg"] = """select s.*, year(s.feature_date) fyear, s.historical_success_density truth from sev s semi join (select event_id from targets where horizon_months = 6 and target_valid) t using (event_id)
 where viability_velocity is not null and year(s.feature_date) between 1996 and 2000"""
CTES["elc"] = " union all ".join(
    f"select '{c}' candidate, '{n}' period, corr(a, b) s from (select {Q.avg_rank(c)} a, {Q.avg_rank('truth')} b from elg where {c} is not null and fyear between {lo} and {hi})" for c in _CAND for n, (lo, hi) in _PERIODS.items()
)
CTES["elw"] = "select candidate, " + ", ".join(f"max(s) filter (period = '{n}') {n}_spearman" for n in _PERIODS) + " from elc group by 1"
CTES["elx"] = """select w.*, case when candidate = 'migration_surprise' then (select count(migration_surprise) from elg) else (select count(*) from elg) end eligible_rows,
 overall_spearman - (select overall_spearman from elw where candidate = 'viability_velocity') gain, candidate = 'migration_surprise' own from elw w"""


def _eligibility(events, targets):
    candidates = events.select("event_id", F.year("feature_date").alias("fyear"), *_CAND)
    truth = events.select("event_id", F.col("historical_success_density").alias("truth"))
    return U.proxy_eligibility(
        candidates, targets, truth, ["event_id"], *_CAND, 6, calibration=_PERIODS["calibration"], holdout=_PERIODS["held_out"], blocks=(_PERIODS["block1"], _PERIODS["block2"]),
    )


@query(
    "proxy_eligibility",
    "select candidate, " + ", ".join(f"round({n}_spearman, 8) {n}_spearman" for n in _PERIODS)
    + """, eligible_rows, round(eligible_rows / (select count(*) from elg), 8) coverage_vs_benchmark, round(gain, 8) overall_improvement, not own is_benchmark,
 case when own then overall_spearman >= 0.35 end overall_gate, case when own then gain >= 0.10 end improvement_gate, case when own then least(calibration_spearman, held_out_spearman) >= 0.30 end period_gate,
 case when own then least(block1_spearman, block2_spearman) >= 0.20 end block_gate, case when own then eligible_rows / (select count(*) from elg) >= 0.95 end coverage_gate from elx""",
    CTES,
)
def proxy_eligibility(spark, d):
    """A locked signal against its benchmark where targets are valid; the targets' values are never read."""
    months = cut(history(spark, d))
    events = cut(D.signal_events(spark, d, months))
    targets = N.forward_targets(N.forward_paths(events, months, D.factors(spark, d)), [])
    out = _eligibility(events, targets)
    return out.withColumns({c: r(c, 8) for c in out.columns if c.endswith(("_spearman", "_improvement", "_benchmark")) and c != "is_benchmark"})


OUTCOMES = ["surface.exit_date", "surface.exit_category", "surface.next_sale", "targets.forward_total_return", "targets.forward_excess_return", "targets.forward_risk_free_return", "targets.target_status"]


@query("leakage_audit")
def leakage_audit(spark, d):
    """Outcome columns stand in the tables that the operators are given; their analysed plans show that none is reached. Tests plant leaks."""
    folder = f"{checkpoint_folder(spark)}/audit-{uuid.uuid4().hex}"

    def kept(name, df):
        df.write.parquet(f"{folder}/{name}.parquet")
        return lambda: spark.read.schema(df.schema).parquet(f"{folder}/{name}.parquet")

    base = D.reports(spark, d)
    following = F.lead("sale").over(W.partitionBy("gvkey").orderBy("fyear"))
    outcomes = base.select("gvkey", "fyear", following.alias("next_sale")).join(D.firm_exits(spark, d).select("gvkey", "exit_date", "exit_category"), "gvkey")
    surface = kept("surface", D.risk_surface(spark, d, base).join(outcomes, ["gvkey", "fyear"]))
    controls = kept("controls", report_components(spark, d).select("gvkey", "fyear", *FEATURES[:4]))
    months = cut(history(spark, d))
    events = kept("events", D.signal_events(spark, d, months))
    targets = kept("targets", N.forward_targets(N.forward_paths(events(), months, D.factors(spark, d)), []))
    position = lambda: Y.frontier_position(surface(), LOCAL)
    moved = lambda: Y.motion(position()).withColumn("feature_year", F.year("feature_date"))
    core = ["gvkey", "datadate", "horizon_years", "viability_log_odds", "constant_hazard", "frontier_margin", "viability_percentile"]
    speed = ["gvkey", "datadate", "horizon_years", "velocity_log_odds", "acceleration_log_odds", "frontier_crossing"]
    surprise = lambda: Y.unexpected_motion(moved().join(controls(), ["gvkey", "fyear"], "left").drop("exit_date", "exit_category", "next_sale"), "velocity_log_odds", FEATURES[:4], "sic2", "feature_year", LOCAL)
    operators = {
        "frontier_position": lambda: position().select(*core), "motion": lambda: moved().select(*speed),
        "unexpected_motion": lambda: surprise().select("gvkey", "datadate", "horizon_years", "expected_velocity", "migration_surprise"), "proxy_eligibility": lambda: _eligibility(events(), targets()),
    }
    return G.leakage_audit(spark, operators, OUTCOMES)


@query("power_calibration")
def power_calibration(spark, d):
    """An injection of known size, half of it noise, planted along a signal into six-month returns: calibrated on 100 draws, held out on 50 fresh ones.

    The draws are hashes, so there is no SQL twin; the tests compare every replicate with rows that are really copied.
    """
    months = cut(history(spark, d))
    events = D.signal_events(spark, d, months)
    targets = N.forward_targets(N.forward_paths(events, months, D.factors(spark, d)), ["gvkey", "migration_surprise"])
    noise = (F.crc32(F.col("event_id").cast("binary")) % 1000 / 1000.0 - 0.5) / 5
    rows = targets.filter("target_valid and horizon_months = 6").select("gvkey", F.col("migration_surprise").alias("observable"), ((F.col("migration_surprise") + noise) / 20).alias("injected"), "forward_excess_return")
    share = U.expected_fraction()
    return U.calibrate_power(rows.withColumn("outcome", F.col("forward_excess_return") + share * F.col("injected")), [1.0, 2.0, 4.0, 6.0, 8.0, 10.0], 100, 50, share)


CTES["dh"] = """select gvkey, date, permno, total_return, coalesce(has_delist, false) hd, coalesce(delist_return_missing, false) drm, market_cap_millions cap, count(*) over (partition by gvkey, date) candidates,
 row_number() over (partition by gvkey, date order by market_cap_millions desc nulls last, permno) rn from (
 select c.*, l.gvkey, row_number() over (partition by c.permno, c.date order by case when linkprim = 'P' then 0 else 10 end + case linktype when 'LC' then 0 when 'LU' then 1 else 2 end, linkdt) ln
 from compounded c join links l on l.lpermno = c.permno and c.date between l.linkdt and coalesce(l.linkenddt, date '9999-12-31') where c.shrcd in (10, 11) and c.exchcd in (1, 2, 3)) where ln = 1"""


def firm_history(spark, d):
    return P.dated_return_history(D.security_months(spark, d), D.delistings(spark, d), D.links(spark, d))


@query(
    "dated_return_history",
    "select gvkey, date, permno, round(total_return, 9) total_return, hd has_delist, drm delist_return_missing, candidates from dh where rn = 1",
    CTES,
)
def dated_return_history(spark, d):
    return firm_history(spark, d).select("gvkey", "date", "permno", r("total_return", 9).alias("total_return"), "has_delist", "delist_return_missing", "candidates")


CTES["dhe"] = "select gvkey || '|' || strftime(date, '%Y-%m-%d') event_id, gvkey, date feature_date from dh where rn = 1 and month(date) % 3 = 0"
CTES["dhp"] = f"""select e.event_id, e.gvkey, o.k holding_offset, h.permno, h.total_return ret, coalesce(h.hd, false) hd, coalesce(h.drm, false) drm, f.rf, last_day(e.feature_date + to_months(cast(o.k as int))) > (select max(date) from factors) bey
 from dhe e cross join (select unnest(generate_series(1, 12)) k) o left join (select * from dh where rn = 1) h on h.gvkey = e.gvkey and h.date = last_day(e.feature_date + to_months(cast(o.k as int)))
 left join factors f on f.date = last_day(e.feature_date + to_months(cast(o.k as int)))"""
CTES["dhq"] = """select *, coalesce(bool_or(hd and not drm and ret is not null) over (partition by event_id order by holding_offset rows between unbounded preceding and 1 preceding), false) cash from dhp"""
CTES["dhs"] = """select event_id, h.h horizon_months, bool_and(not bey and (cash or (ret is not null and not drm))) ok, count(distinct permno) securities, product(1 + case when cash then rf when not bey then ret end) - 1 g
 from dhq join (values (1),(3),(6),(12)) h(h) on holding_offset <= h.h group by 1, 2"""


@query(
    "firm_targets",
    "select horizon_months, count(*) events, count(*) filter (ok) valid, count(*) filter (ok and securities > 1) valid_across_securities, round(avg(case when ok then g end), 9) mean_return from dhs group by 1",
    CTES,
)
def firm_targets(spark, d):
    """Forward targets of firms rather than securities, from prefixes of the stitched histories; how many cross a change of security."""
    months = cut(firm_history(spark, d))
    key = F.concat_ws("|", "gvkey", F.date_format("date", "yyyy-MM-dd"))
    events = months.filter(F.month("date") % 3 == 0).select(key.alias("event_id"), "gvkey", F.col("date").alias("feature_date"))
    targets = A.targets_by_prefix(events, months, D.factors(spark, d))
    held = events.select("event_id", "gvkey", A.month_number("feature_date").alias("m"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k"))
    used = held.join(months.select("gvkey", A.month_number("date").alias("t"), "permno"), (held["gvkey"] == months["gvkey"]) & (F.col("m") + F.col("k") == F.col("t")))
    near = F.explode(F.filter(F.array(*[F.lit(h) for h in DEFAULT.return_horizons]), lambda h: F.col("k") <= h))
    several = used.select("event_id", near.alias("horizon_months"), "permno").groupBy("event_id", "horizon_months").agg(F.countDistinct("permno").alias("securities"))
    ok = F.col("target_valid")
    return targets.join(several, ["event_id", "horizon_months"], "left").groupBy("horizon_months").agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(ok & (F.col("securities") > 1), 1)).alias("valid_across_securities"),
        r(F.avg(F.when(ok, F.col("forward_total_return"))), 9).alias("mean_return"),
    )


#: The thirteen controls of the full cross-section.
CONTROLS = [
    "log_market_cap", "book_to_market", "momentum_12_2", "operating_margin", "asset_growth", "leverage", "working_capital", "operating_income",
    "equity_to_liabilities", "sales_to_assets", "log_dollar_volume_12m", "realized_volatility_12m", "equity_beta_24m",
]


def firm_cross_sections(spark, d):
    """Quarter-end events of securities with market controls and those of the last report of the firm that they are linked to; targets of all horizons."""
    months = cut(history(spark, d))
    factors = D.factors(spark, d)
    market = Y.rolling_market_controls(months, factors).select("permno", "date", "momentum_12_2", "log_dollar_volume_12m", "realized_volatility_12m", "equity_beta_24m")
    events = D.signal_events(spark, d, months)
    links = P.map_links(months.select("permno", "date"), D.links(spark, d)).select("permno", F.col("date").alias("feature_date"), F.col("gvkey").alias("firm"))
    base = D.reports(spark, d)
    known = P.report_availability(cut(base), D.filings(spark, d, base))
    accounts = M.model_controls(C.asset_growth(report_components(spark, d)).select("gvkey", "fyear", "operating_margin", "asset_growth").join(
        known.withColumn("market_cap_millions", F.lit(None).cast("double")), ["gvkey", "fyear"]))
    carried = ["operating_margin", "asset_growth", "leverage", "working_capital", "operating_income", "equity_to_liabilities", "sales_to_assets", "ceq"]
    asked = events.join(links, ["permno", "feature_date"], "left").withColumnRenamed("gvkey", "security").withColumnRenamed("firm", "gvkey")
    linked = P.asof_join(asked.filter(F.col("gvkey").isNotNull()), accounts, "gvkey", "feature_date", "formation_date", carried, ["datadate", "fyear"])
    alone = asked.filter(F.col("gvkey").isNull()).withColumns({c: F.lit(None).cast("double") for c in carried})
    both = linked.select(*alone.columns).unionByName(alone).drop("gvkey").withColumnRenamed("security", "gvkey")
    cap = F.col("market_cap_millions")
    full = both.join(market.withColumnRenamed("date", "feature_date"), ["permno", "feature_date"], "left").withColumns(
        {"log_market_cap": F.when(cap > 0, F.log(F.when(cap > 0, cap))), "book_to_market": F.when(cap > 0, F.col("ceq") / F.when(cap > 0, cap) / 1e6)})
    targets = A.targets_by_prefix(events, months, factors).select("event_id", "horizon_months", "target_valid", "forward_excess_return")
    return stored(targets.join(full.select("event_id", "feature_date", "fold", "sic1", *SIGNALS, *CONTROLS), "event_id"))


@query("full_cross_sections")
def full_cross_sections(spark, d):
    """Regressions on the signal, thirteen controls and industries per date, with rank ICs; a date that is not fitted says why."""
    out = N.cross_section_regressions(firm_cross_sections(spark, d), SIGNALS, CONTROLS)
    return out.select("horizon_months", "signal", "feature_date", "term", r("coefficient", 8).alias("coefficient"), r("rank_ic", 8).alias("rank_ic"), r("r_squared", 8).alias("r_squared"), "cross_section_rows", "fold", "status")


@query("full_cross_section_summary")
def full_cross_section_summary(spark, d):
    """HAC inference on the monthly coefficients and rank ICs; the quarters here are at most 26, so the minimum is 8."""
    monthly = cut(N.cross_section_regressions(firm_cross_sections(spark, d), SIGNALS, CONTROLS))
    return N.cross_section_summary(monthly, 8, (6, SIGNALS[0]))
