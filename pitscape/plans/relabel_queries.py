"""Saved labels, folds and metrics against their recomputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitscape.operators import describe as E
from pitscape.operators import labels as L
from pitscape.operators import recompute as A
from pitscape.operators import relabel as B
from pitscape.plans import oracle_parts as Q
from pitscape.plans.label_queries import CTES as LABEL
from pitscape.plans.label_queries import _PM, SHORT, _scored_lines, label_frame
from pitscape.plans.registry import query
from pitscape.plans.score_queries import report_components
from pitscape.session import cut
from pitscape.sources import derived as D

LABELS = ["failure_within_horizon", "label_status", "censor_reason", "horizon_end", "label_observed_date"]
CTES = dict(LABEL)
# the same sweep in SQL: exits before probes before ends of observation
CTES["lsp"] = "select gvkey, fyear, feature_date t, h.h, cast(feature_date + to_years(h.h) as date) e from ev cross join (values (1),(2)) h(h)"
CTES["lsc"] = """select gvkey, exit_date dy, 0 pl, (exit_category='performance_failure')::int f, (exit_category<>'performance_failure')::int o, 0 en, exit_date xd from exits where exit_date is not null
 union all select distinct gvkey, dy, 1, 0, 0, 0, null::date from (select gvkey, t dy from lsp union all select gvkey, e from lsp)
 union all select gvkey, last_observed_date, 2, 0, 0, 1, null from exits where last_observed_date is not null"""
CTES["lsw"] = "select gvkey, dy, pl, sum(f) over w f, sum(o) over w o, sum(en) over w en, max(xd) over w xd, sum(en) over (partition by gvkey) ne from lsc window w as (partition by gvkey order by dy, pl)"
CTES["lsr"] = """select *, case when y is not null then 'observed' else 'censored' end st, case when y is not null then 'none' when ot then 'competing_exit' when e > date '2001-12-31' then 'administrative_right_censor' else 'lost_followup' end rs,
 case when fa or ot then xd when y = 0 then e end kn from (select *, case when fa then 1 when not ot and fo then 0 end y from (
 select p.*, b.f > a.f fa, b.o > a.o ot, b.ne > 0 and b.en = 0 fo, b.xd from lsp p join lsw a on a.gvkey=p.gvkey and a.dy=p.t and a.pl=1 join lsw b on b.gvkey=p.gvkey and b.dy=p.e and b.pl=1))"""
_LK = {
    "rows_compared": "a.gvkey is not null and b.gvkey is not null", "only_saved": "b.gvkey is null", "only_recomputed": "a.gvkey is null", "repeated_key": "false",
    "failure_within_horizon": "a.y is distinct from b.y", "label_status": "a.label_status <> b.st", "censor_reason": "a.censor_reason <> b.rs", "horizon_end": "a.horizon_end <> b.e",
    "label_observed_date": "a.label_observed_date is distinct from b.kn",
}
CTES["ldiff"] = (
    "select coalesce(a.horizon_years, b.h) horizon_years, " + ", ".join(f"count(*) filter ({c}) {k}" for k, c in _LK.items())
    + " from lab a full join lsr b on a.gvkey=b.gvkey and a.fyear=b.fyear and a.horizon_years=b.h group by 1"
)
_TESTS = ", ".join(f"({i},{a},{b})" for i, (a, b) in enumerate(SHORT.test_windows, 1))
CTES["frule"] = f"""select * from (select l.gvkey, l.fyear, l.horizon_years, f.f fold, case when event_year between f.a and f.b then 'test' when f.a - event_year between horizon_years + 1 and horizon_years + {SHORT.validation_years} then 'validation'
 when f.a - event_year > 2*horizon_years + {SHORT.validation_years} and event_year >= 1995 then 'train' end role from lab l cross join (values {_TESTS}) f(f,a,b) where l.y is not null) where role is not null"""
_FK = {
    "rows_compared": "a.gvkey is not null and b.gvkey is not null", "only_saved": "b.gvkey is null", "only_recomputed": "a.gvkey is null", "repeated_key": "false", "role": "a.role <> b.role",
}
CTES["fdiff"] = (
    "select coalesce(a.horizon_years, b.horizon_years) horizon_years, coalesce(a.fold, b.fold) fold, " + ", ".join(f"count(*) filter ({c}) {k}" for k, c in _FK.items())
    + " from split a full join frule b on a.gvkey=b.gvkey and a.fyear=b.fyear and a.horizon_years=b.horizon_years and a.fold=b.fold group by 1,2"
)
CTES["pred"] = f"select g, p, y from {_PM}"
CTES["mrank"] = f"""select *, {Q.avg_rank('p', 'g')} rp, {Q.avg_rank('y', 'g')} ry, count(*) over (partition by g order by p desc) nge, sum(y) over (partition by g order by p desc) pge from pred"""
_BIN = "greatest(" + " + ".join(f"(e[{i}] < p)::int" for i in range(1, 12)) + ", " + " + ".join(f"(e[{i}] = e[1])::int" for i in range(1, 11)) + ")"
_GAP = "select g, sum(abs(sp - sy))/sum(n) ece from (select b.g, {bin} bin, sum(p) sp, sum(y) sy, count(*) n from pred b join {edges} c on c.g=b.g group by 1,2) group by 1"
CTES["medge"] = "select g, [" + ", ".join(f"quantile_cont(p, {i / 10}::double)" for i in range(11)) + "] e from pred group by 1"
CTES["mece"] = _GAP.format(bin=_BIN, edges="medge")
CTES["msaved"] = """select m.*, ece from (select g, count(*) n, sum(y) e, (sum(rp) filter (y=1) - sum(y)*(sum(y)+1)/2.0::double)/nullif(sum(y)*(count(*)-sum(y)),0) auc, sum(case when y=1 then pge/nge::double end)/nullif(sum(y),0) ap,
 avg((y-p)*(y-p)) br, -avg(case when y=1 then ln(p) else ln(1-p) end) ll, case when isfinite(corr(rp, ry)) then corr(rp, ry) end sp from mrank group by 1) m join mece using (g)"""
# the second way: pairs of distinct values instead of ranks, positions in the sorted list instead of quantiles
CTES["mval"] = "select g, p, count(*) n, sum(y) y from pred group by 1,2"
CTES["mpos"] = """select a.g, a.p, a.n, a.y, sum(case when b.p < a.p then b.n else 0 end) nb, sum(case when b.p < a.p then b.y else 0 end) yb, sum(b.n) tn, sum(b.y) ty from mval a join mval b on a.g=b.g group by all"""
CTES["mlist"] = "select g, list(p order by p) l, count(*) - 1 k from pred group by 1"
CTES["medge2"] = "select g, [" + ", ".join(
    f"l[floor(k*{i}/10.0::double)::bigint + 1] + (k*{i}/10.0::double - floor(k*{i}/10.0::double)) * (l[ceil(k*{i}/10.0::double)::bigint + 1] - l[floor(k*{i}/10.0::double)::bigint + 1])" for i in range(11)
) + "] e from mlist"
CTES["mece2"] = _GAP.format(bin=_BIN, edges="medge2")
CTES["magain"] = """select m.*, ece from (select g, sum(n) n, sum(y) e, sum(y*((nb-yb) + (n-y)/2.0::double))/nullif(max(ty)*(max(tn)-max(ty)),0) auc, sum(y*(ty-yb)/(tn-nb)::double)/nullif(max(ty),0) ap,
 sum(y*(1-p)*(1-p) + (n-y)*p*p)/sum(n) br, -sum(y*ln(p) + (n-y)*ln(1-p))/sum(n) ll,
 sum(y*(nb + (n+1)/2.0::double - (tn+1)/2.0::double))/nullif(sqrt(sum(n*pow(nb + (n+1)/2.0::double - (tn+1)/2.0::double, 2))*max(ty)*(max(tn)-max(ty))/max(tn)::double),0) sp from mpos group by 1) m join mece2 using (g)"""
_MK = {"rows": "n", "events": "e", "roc_auc": "auc", "average_precision": "ap", "brier_score": "br", "log_loss": "ll", "spearman": "sp", "expected_calibration_error": "ece"}
CTES["mdiff"] = (
    "select coalesce(a.g, b.g) g, count(*) filter (a.g is not null and b.g is not null) rows_compared, count(*) filter (b.g is null) only_saved, count(*) filter (a.g is null) only_recomputed, count(*) filter (false) repeated_key, "
    + ", ".join(f"count(*) filter (abs(a.{c} - b.{c}) > 1e-9 or (a.{c} is null) <> (b.{c} is null)) d_{c}" for c in _MK.values()) + " from msaved a full join magain b on a.g=b.g group by 1"
)


def swept_labels(spark, d):
    exits = D.firm_exits(spark, d)
    events = report_components(spark, d).withColumn("feature_date", F.last_day(F.add_months("datadate", 3)))
    last = D.reports(spark, d).agg(F.max("fyear")).first()[0]
    return B.labels_by_sweep(events, L.single_exit(exits), exits.select("gvkey", "last_observed_date"), F.make_date(F.lit(last).cast("int"), F.lit(12), F.lit(31)), SHORT.horizons_years)


@query("label_recompute", " union all ".join(f"select horizon_years, '{k}' kind, {k} as \"rows\" from ldiff" for k in _LK), CTES)
def label_recompute(spark, d):
    """Labels joined from exits against labels swept along each firm's calendar: differences by horizon and kind."""
    return A.differences_by_kind(label_frame(spark, d), swept_labels(spark, d), ["gvkey", "fyear", "horizon_years"], LABELS, ["horizon_years"])


@query("fold_recompute", " union all ".join(f"select horizon_years, fold, '{k}' kind, {k} as \"rows\" from fdiff" for k in _FK), CTES)
def fold_recompute(spark, d):
    """Roles joined from the fold table against roles counted back from the test windows."""
    labels = cut(label_frame(spark, d))
    saved = L.assign_folds(labels, L.fold_table(spark, 1995, SHORT))
    again = B.folds_by_rule(labels, 1995, p=SHORT)
    return A.differences_by_kind(saved, again, ["gvkey", "fyear", "horizon_years", "fold"], ["role"], ["horizon_years", "fold"])


@query(
    "metric_recompute",
    " union all ".join(f"select g, '{k}' kind, {c} as \"rows\" from mdiff" for k, c in [*((k, k) for k in ("rows_compared", "only_saved", "only_recomputed", "repeated_key")), *((k, f"d_{c}") for k, c in _MK.items())]),
    CTES,
)
def metric_recompute(spark, d):
    """Metrics by running counts over value codes against the same from digit positions: differences by group and kind."""
    scored = cut(_scored_lines(spark, d))
    saved = E.prediction_metrics(scored, ["g"], "p", "y")
    return A.differences_by_kind(saved, B.metrics_by_position(scored, ["g"], "p", "y"), ["g"], list(_MK), ["g"])
