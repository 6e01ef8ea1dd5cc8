"""Motion, market controls, survival and risk models."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitscape.operators import components as C
from pitscape.operators import dynamics as Y
from pitscape.operators import labels as L
from pitscape.operators import models as M
from pitscape.operators import panel as P
from pitscape.operators import survival as V
from pitscape.params import DEFAULT
from pitscape.plans import oracle_parts as Q
from pitscape.plans.geometry_queries import _scaled_points
from pitscape.plans.label_queries import CTES as LABEL
from pitscape.plans.label_queries import FEATURES, SHORT
from pitscape.plans.registry import query, r
from pitscape.plans.return_queries import history
from pitscape.plans.score_queries import report_components
from pitscape.session import cut
from pitscape.sources import derived as D

# the tables span seven years: shorter history, lower frontier and row minimums
LOCAL = replace(DEFAULT, frontier=0.5, min_reporting_history=2, min_surprise_train=200, min_train_rows=100, min_train_failures=5, min_validation_failures=2,
                horizons_years=SHORT.horizons_years, test_windows=SHORT.test_windows, validation_years=1)

CTES = dict(LABEL)
CTES["front"] = f"""select *, ln(pc/(1-pc)) lo, -ln(greatest(least(predicted_survival,1.0::double),1e-6::double))/horizon_years hz, ln(pc/(1-pc)) - ln(0.5::double/0.5::double) mg,
 predicted_survival >= 0.5 ab, count(*) over (partition by horizon_years, feature_date) cs, {Q.avg_rank('predicted_survival', 'horizon_years, feature_date')} rk
 from (select *, least(greatest(predicted_survival, 1e-6::double), 1-1e-6::double) pc from surface)"""
CTES["mot0"] = """select *, (feature_date - lag(feature_date) over w)/365.25::double el, lag(fold) over w pf, lag(predicted_survival) over w pv, lag(lo) over w plo, lag(ab) over w pab from front
 window w as (partition by gvkey, horizon_years order by feature_date, datadate)"""
CTES["mot"] = """select *, case when same then (predicted_survival-pv)/el end vp, case when same then (lo-plo)/el end vl,
 case when same then case when not pab and ab then 1 when pab and not ab then -1 else 0 end end fc from (select *, coalesce(pf=fold and el>0,false) same from mot0)"""
CTES["iv0"] = """select k.gvkey, k.datadate, k.fyear, k.formation_date fdt, k.reporting_history, x.exit_date, x.exit_category, x.last_observed_date,
 lead(k.formation_date) over (partition by k.gvkey order by k.formation_date, k.datadate) nx, case when x.exit_date > k.formation_date then x.exit_date end ex
 from known k left join exits x on x.gvkey=k.gvkey where k.reporting_history >= 2"""
CTES["iv"] = """select *, case when coalesce(ex=stp,false) then coalesce(exit_category,'other_unknown') when coalesce(nx=stp,false) then 'covariate_update' else 'administrative_right_censor' end reason,
 cast(fdt - date '1900-01-01' as int) entry_day, cast(stp - date '1900-01-01' as int) stop_day from (select *, least(coalesce(nx, date '9999-01-01'), coalesce(ex, date '9999-01-01'), last_observed_date) stp from iv0) where stp > fdt"""


def surface_frame(spark, d):
    return Y.frontier_position(cut(D.risk_surface(spark, d)), LOCAL)


@query(
    "frontier_position",
    """select gvkey, fyear, horizon_years, round(lo,7) log_odds, round(hz,8) hazard, round(mg,7) margin, ab as above, cs as cohort, round(case when cs>=20 then rk/cs end,8) percentile from front""",
    CTES,
)
def frontier_position(spark, d):
    return surface_frame(spark, d).select(
        "gvkey", "fyear", "horizon_years", r("viability_log_odds", 7).alias("log_odds"), r("constant_hazard", 8).alias("hazard"),
        r("frontier_margin", 7).alias("margin"), F.col("above_frontier").alias("above"), F.col("viability_cohort_size").alias("cohort"),
        r("viability_percentile", 8).alias("percentile"),
    )


@query(
    "motion",
    """select gvkey, fyear, horizon_years, round(el,7) elapsed, round(vp,7) velocity_probability, round(vl,6) velocity_log_odds, fc as frontier_crossing,
 round(case when same then (vl - lag(vl) over (partition by gvkey, horizon_years order by feature_date, datadate))/el end,5) acceleration, coalesce(pf<>fold,false) vintage_changed from mot""",
    CTES,
)
def motion(spark, d):
    out = Y.motion(surface_frame(spark, d))
    return out.select(
        "gvkey", "fyear", "horizon_years", r("elapsed_years", 7).alias("elapsed"), r("velocity_probability", 7).alias("velocity_probability"),
        r("velocity_log_odds").alias("velocity_log_odds"), "frontier_crossing", r("acceleration_log_odds", 5).alias("acceleration"),
        F.col("model_vintage_changed").alias("vintage_changed"),
    )


CTES["rm"] = """select c.*, f.mkt_excess x, c.total_return - f.rf y, greatest(1+c.total_return, 0.01::double) gr from compounded c left join factors f on f.date=c.date"""


@query(
    "rolling_market_controls",
    """select permno, date, round(case when count(total_return) over m = 11 then product(case when total_return is not null then gr end) over m - 1 end,7) momentum, round(lag(total_return) over o,8) prior_return,
 round(case when count(total_return) over y12 >= 8 then stddev_samp(total_return) over y12 end,8) volatility, round(ln(1+case when count(vol) over y12 >= 8 then avg(abs(prc)*greatest(vol,0)) over y12 end),7) dollar_volume,
 round((mxy-mx*my)/nullif(mxx-mx*mx,0),5) beta from (select *,
 case when count(x*y) over b >= 18 then avg(x*y) over b end mxy, case when count(x) over b >= 18 then avg(x) over b end mx, case when count(y) over b >= 18 then avg(y) over b end my, case when count(x) over b >= 18 then avg(x*x) over b end mxx
 from rm window b as (partition by permno order by date rows between 24 preceding and 1 preceding))
 window o as (partition by permno order by date), m as (partition by permno order by date rows between 12 preceding and 2 preceding), y12 as (partition by permno order by date rows between 12 preceding and 1 preceding)""",
    CTES,
)
def rolling_market_controls(spark, d):
    out = Y.rolling_market_controls(history(spark, d), D.factors(spark, d))
    return out.select(
        "permno", "date", r("momentum_12_2", 7).alias("momentum"), r("prior_1m_return", 8).alias("prior_return"),
        r("realized_volatility_12m", 8).alias("volatility"), r("log_dollar_volume_12m", 7).alias("dollar_volume"), r("equity_beta_24m", 5).alias("beta"),
    )


@query("unexpected_motion")
def unexpected_motion(spark, d):
    """Expanding ridge surprise of the log-odds velocity; checked against numpy in the tests."""
    moved = Y.motion(surface_frame(spark, d)).withColumn("feature_year", F.year("feature_date"))
    controls = report_components(spark, d).select("gvkey", "fyear", *FEATURES[:4])
    rows = cut(moved.join(controls, ["gvkey", "fyear"], "left"))
    out = Y.unexpected_motion(rows, "velocity_log_odds", FEATURES[:4], "sic2", "feature_year", LOCAL)
    return out.select("gvkey", "fyear", "horizon_years", r("expected_velocity").alias("expected"), r("migration_surprise").alias("surprise"), "train_rows")


def interval_frame(spark, d):
    base = D.reports(spark, d)
    known = P.report_history(P.report_availability(base, D.filings(spark, d, base)))
    comps = C.accounting_components(known).withColumn("feature_date", F.col("formation_date"))
    events = comps.select("gvkey", "datadate", "fyear", "sic1", "feature_date", "reporting_history", *FEATURES)
    return cut(V.survival_intervals(events, D.firm_exits(spark, d), LOCAL))


@query(
    "survival_intervals",
    """select gvkey, fyear, fdt as interval_start, stp as interval_stop, entry_day, stop_day, reason as terminal_reason, (reason='performance_failure')::int performance_failure_event, (reason='merger')::int merger_event from iv""",
    CTES,
)
def survival_intervals(spark, d):
    return interval_frame(spark, d).select(
        "gvkey", "fyear", F.col("feature_date").alias("interval_start"), F.col("interval_stop_date").alias("interval_stop"),
        "entry_day", "stop_day", "terminal_reason", "performance_failure_event", "merger_event",
    )


@query(
    "exit_reconciliation",
    """select coalesce(e.c, a.c) exit_category, coalesce(e.n,0) eligible_dated_exits, coalesce(a.n,0) assigned_terminal_intervals, coalesce(a.n,0)-coalesce(e.n,0) difference from
 (select c, count(*) n from (select gvkey, min(fdt) f, max(exit_date) x, max(exit_category) c from iv group by 1) where x > f group by 1) e
 full join (select reason c, count(distinct gvkey) n from iv where reason in ('performance_failure','merger','voluntary_administrative','other_unknown') group by 1) a on a.c=e.c""",
    CTES,
)
def exit_reconciliation(spark, d):
    return V.exit_reconciliation(interval_frame(spark, d))


@query(
    "interval_concordance",
    """select round(sum(case when j.r < i.r then 1.0::double when j.r = i.r then 0.5::double else 0 end)/count(*),9) concordance, count(*) pairs
 from (select gvkey, stop_day, dlc_ r from ivr where reason='performance_failure') i join (select gvkey, entry_day, stop_day, dlc_ r from ivr) j
 on j.entry_day <= i.stop_day and i.stop_day < j.stop_day and j.gvkey <> i.gvkey""",
    {**CTES, "ivr": "select iv.*, round(c.asset_lightness,2) dlc_ from iv join comp c on c.gvkey=iv.gvkey and c.fyear=iv.fyear where c.asset_lightness is not null"},
)
def interval_concordance(spark, d):
    rows = interval_frame(spark, d).withColumn("risk", F.round("asset_lightness", 2))
    out = V.interval_concordance(rows, "risk", "performance_failure_event")
    return out.select(r("concordance", 9).alias("concordance"), "pairs")


@query("cause_specific_hazards")
def cause_specific_hazards(spark, d):
    """Failure and merger hazards with clustered errors; checked against numpy in the tests."""
    rows = interval_frame(spark, d)
    out = None
    for cause, event in (("performance_failure", "performance_failure_event"), ("merger", "merger_event")):
        table = V.hazard_table(spark, V.fit_hazard(rows, FEATURES, event), cause)
        out = table if out is None else out.unionByName(table)
    return out


CAUSES = {"performance_failure": "performance_failure_event", "merger": "merger_event"}


def hazard_fold_frames(spark, d):
    """Two windows of the seven years; both causes, minimums to match."""
    return V.hazard_folds(interval_frame(spark, d), FEATURES, CAUSES, ((1999, 1999), (2000, 2001)), min_intervals=100, min_train_events=5, min_test_events=2)


@query("hazard_fold_metrics")
def hazard_fold_metrics(spark, d):
    """Concordance, discrimination and calibration of both causes on each window; checked against numpy in the tests."""
    return hazard_fold_frames(spark, d)[0]


@query("hazard_fold_predictions")
def hazard_fold_predictions(spark, d):
    out = hazard_fold_frames(spark, d)[1]
    return out.select("cause", "fold", "interval_id", "gvkey", "event", r("risk_score").alias("risk_score"), r("predicted_interval_event_probability").alias("probability"))


@query("hazard_proportionality")
def hazard_proportionality(spark, d):
    rows = interval_frame(spark, d)
    fit = V.fit_hazard(rows, FEATURES, "performance_failure_event")
    return V.proportionality(rows, fit, "performance_failure_event")


@query("hazard_time_split")
def hazard_time_split(spark, d):
    """Hazards fitted before 2000 and ranked on the intervals after it."""
    rows = interval_frame(spark, d)
    cutoff = 36524  # 2000-01-01 in days since 1900-01-01
    fit = V.fit_hazard(rows.filter(F.col("stop_day") < cutoff), FEATURES, "performance_failure_event")
    later = V.with_risk(rows.filter(F.col("entry_day") >= cutoff), fit)
    return V.interval_concordance(later, "risk", "performance_failure_event")


MODEL = replace(LOCAL, horizons_years=(1,), test_windows=((1999, 1999), (2000, 2000)))


def lapse_matrix(spark, d):
    """Does a firm report again within the horizon?  Unknown (NULL) past the last year of the reports."""
    w = W.partitionBy("gvkey").orderBy("fyear")
    following = F.lead("fyear").over(w)
    reports = report_components(spark, d)
    last = reports.agg(F.max("fyear").alias("__last"))
    base = reports.withColumn("__next", following).join(F.broadcast(last))
    each = base.withColumn("horizon_years", F.explode(F.array(*[F.lit(h) for h in MODEL.horizons_years])))
    end = F.col("fyear") + F.col("horizon_years")
    lapsed = (F.coalesce("__next", F.lit(9999)) > end).cast("int")
    return each.withColumn("failure_within_horizon", F.when(end <= F.col("__last"), lapsed)).select(
        "gvkey", "fyear", "horizon_years", "failure_within_horizon", F.col("fyear").alias("event_year"),
        F.make_date(end, F.lit(12), F.lit(31)).alias("label_observed_date"), *FEATURES,
    )


def lapse_split(spark, d):
    """Labelled rows in every fold and role, written once for the model phase."""
    return cut(L.assign_folds(lapse_matrix(spark, d), L.fold_table(spark, 1995, MODEL)))


def predictions(spark, d, features, model, trees=100):
    return M.nested_predictions(lapse_split(spark, d), features, model, MODEL, trees, L.fold_table(spark, 1995, MODEL))


@query("nested_ridge_predictions")
def nested_ridge_predictions(spark, d):
    out = predictions(spark, d, FEATURES, "ridge")
    return out.select("gvkey", "fyear", "horizon_years", "fold", "role", "model", r("probability").alias("probability"), "status")


@query("nested_tree_predictions")
def nested_tree_predictions(spark, d):
    out = predictions(spark, d, FEATURES, "trees")
    return out.select("gvkey", "fyear", "horizon_years", "fold", "role", "model", r("probability").alias("probability"), "status")


@query("incremental_utility_metrics")
def incremental_utility_metrics(spark, d):
    """Metrics of a small and a large feature set on the same folds."""
    split, folds = lapse_split(spark, d), L.fold_table(spark, 1995, MODEL)
    small = M.nested_predictions(split, FEATURES[:2], "ridge", MODEL, folds=folds).withColumn("model", F.lit("financial"))
    large = M.nested_predictions(split, FEATURES, "ridge", MODEL, folds=folds).withColumn("model", F.lit("financial_axes"))
    keep = ["horizon_years", "fold", "model", "role", "probability", "status", M.LABEL]
    return M.fold_metrics(small.select(*keep).unionByName(large.select(*keep)))


@query("principal_axes")
def principal_axes(spark, d):
    """Two components fitted on the training years; their sign is arbitrary."""
    out = M.principal_axes(_scaled_points(spark, d), F.col("fyear") <= 1998, FEATURES)
    return out.select("gvkey", "fyear", r(F.abs("pc1")).alias("abs_pc1"), r(F.abs("pc2")).alias("abs_pc2"))


@query("surface_scores")
def surface_scores(spark, d):
    """Every test-window event, censored ones included, scored by its own fold's model."""
    matrix, folds = cut(lapse_matrix(spark, d)), L.fold_table(spark, 1995, MODEL)
    rows = L.assign_folds(matrix, folds).unionByName(M.rows_to_score(matrix, folds))
    out = M.nested_predictions(cut(rows), FEATURES, "ridge", MODEL, folds=folds)
    return out.filter("role in ('score', 'skipped')").select("gvkey", "fyear", "horizon_years", "fold", r("probability").alias("probability"), "status")


@query(
    "model_controls",
    """select gvkey, fyear, round((at_-ceq)/nullif(at_,0),8) leverage, round((act-lct)/nullif(at_,0),8) working_capital, round(oiadp/nullif(at_,0),8) operating_income,
 round(ceq/nullif(at_-ceq,0),6) equity_to_liabilities, round(sale/nullif(at_,0),8) sales_to_assets, round(ln(at_/1e6::double),8) log_market_cap from reports""",
    CTES,
)
def model_controls(spark, d):
    out = M.model_controls(D.reports(spark, d).withColumn("market_cap_millions", F.col("at") / 1e6))
    return out.select("gvkey", "fyear", *[r(c, 8).alias(c) for c in ("leverage", "working_capital", "operating_income", "sales_to_assets", "log_market_cap")],
                      r("equity_to_liabilities").alias("equity_to_liabilities"))


@query(
    "interval_gate",
    """select count(*) as "rows", count(*) filter (stp <= fdt) empty_intervals, (select count(*) from (select fdt < lag(stp) over (partition by gvkey order by fdt) o from iv) where o) as overlapping,
 0::bigint both_causes, count(distinct gvkey||fdt) intervals from iv""",
    CTES,
)
def interval_gate(spark, d):
    """Intervals of a firm do not overlap, are not empty and end in one cause."""
    rows = interval_frame(spark, d)
    w = W.partitionBy("gvkey").orderBy("feature_date")
    flagged = rows.withColumn("__o", F.col("feature_date") < F.lag("interval_stop_date").over(w))
    bad = lambda c: F.count(F.when(c, 1))
    return flagged.agg(
        F.count(F.lit(1)).alias("rows"), bad(F.col("stop_day") <= F.col("entry_day")).alias("empty_intervals"), bad(F.col("__o")).alias("overlapping"),
        bad((F.col("performance_failure_event") + F.col("merger_event")) > 1).alias("both_causes"), F.countDistinct("interval_id").alias("intervals"),
    )
