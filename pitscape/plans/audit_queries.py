"""Contracts, drift alerts, gates, proxy selection, power and recovery audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitscape.functions import scalars as S
from pitscape.operators import audit as U
from pitscape.operators import contracts as K
from pitscape.operators import panel as P
from pitscape.plans import oracle_parts as Q
from pitscape.plans.geometry_queries import CTES as GEO
from pitscape.plans.geometry_queries import recall_frame
from pitscape.plans.panel_queries import build_panel
from pitscape.plans.registry import query, r
from pitscape.session import cut
from pitscape.sources import derived as D
from pitscape.sources.tables import scan, union_scenarios

CTES = dict(GEO)
YEARS, BLOCKS = (1997, 2000), {"1997_1998": (1997, 1998), "1999_2000": (1999, 2000)}

# two scores of change against a truth of change, all from consecutive reports
CTES["chg"] = """select *, case when c1 then sale - ps end primary_score, case when c1 then at_ - pa end benchmark, case when c1 then qty - pq end truth_value
 from (select gvkey, datadate, fyear, sic1, sale, at_, qty, ext_f, lag(sale) over w ps, lag(at_) over w pa, lag(qty) over w pq, coalesce(fyear-lag(fyear) over w=1,false) c1
  from reports window w as (partition by gvkey order by fyear))"""
CTES["drift0"] = "select * from chg where fyear between 1997 and 2000 and benchmark is not null and truth_value is not null"
CTES["drift"] = """select *, rt <= ceil(0.1::double*n) ext, score_value is not null avail, coalesce(ra <= ceil(0.1::double*na),false) al, coalesce(sign(score_value)=sign(truth_value),false) sg from (
 select d.*, s.s score, case s.s when 'primary_score' then primary_score else benchmark end score_value,
 row_number() over (partition by s.s, fyear order by abs(truth_value) desc, gvkey) rt, count(*) over (partition by s.s, fyear) n,
 row_number() over (partition by s.s, fyear order by abs(case s.s when 'primary_score' then primary_score else benchmark end) desc, gvkey) ra, count(*) over (partition by s.s, fyear) na
 from drift0 d cross join (values ('primary_score'),('benchmark')) s(s))"""
CTES["dscope"] = """select 'overall' scope, 'all' scope_value, * from drift union all select 'scenario', 'base', * from drift
 union all select 'block', '1997_1998', * from drift where fyear between 1997 and 1998 union all select 'block', '1999_2000', * from drift where fyear between 1999 and 2000"""
CTES["dsum"] = """select scope, scope_value, score, count(*) as "rows", count(*) filter (al) alerts, count(*) filter (ext) truth_extremes, count(*) filter (al and ext) hits,
 count(*) filter (al and ext)/count(*) filter (al)::double prec, count(*) filter (al and ext)/count(*) filter (ext)::double recall, count(*) filter (al and sg)/count(*) filter (al)::double sign_accuracy, count(*) filter (avail)/count(*)::double coverage from dscope group by 1,2,3"""


def change_frame(spark, d):
    w = W.partitionBy("gvkey").orderBy("fyear")
    step = lambda c: F.when(F.col("fyear") - F.lag("fyear").over(w) == 1, F.col(c) - F.lag(c).over(w))
    return cut(D.reports(spark, d).select(
        "gvkey", "datadate", "fyear", "sic1", "sale", step("sale").alias("primary_score"), step("at").alias("benchmark"), step("qty").alias("truth_value"),
        F.col("ext_f"),
    ))


def drift_frame(spark, d):
    rows = change_frame(spark, d)
    return U.drift_events(rows, rows, ["primary_score", "benchmark"], "benchmark", "truth_value", "base", YEARS)


@query("drift_events", "select gvkey, fyear, score, al as is_alert, ext as is_truth_extreme, al and ext as correct_extreme, sg as sign_correct from drift", CTES)
def drift_events(spark, d):
    return drift_frame(spark, d).select("gvkey", "fyear", "score", "is_alert", "is_truth_extreme", "correct_extreme", "sign_correct")


@query(
    "drift_summary",
    """select scope, scope_value, score, "rows", alerts, truth_extremes, hits correct_extremes, round(prec,8) as "precision", round(recall,8) recall, round(sign_accuracy,8) sign_accuracy, round(coverage,8) coverage from dsum""",
    CTES,
)
def drift_summary(spark, d):
    out = U.drift_summary(drift_frame(spark, d), BLOCKS).drop("available_rows")
    return out.withColumns({c: r(c, 8) for c in ("precision", "recall", "sign_accuracy", "coverage")})


def _p(expr):
    return f"(select {expr} from dsum where scope='overall' and score='primary_score')"


CTES["dgate"] = f"""select 'overall_precision_at_least_0_25' gate, {_p('prec')} >= 0.25 passed union all
 select 'both_blocks_precision_at_least_0_20', (select bool_and(prec >= 0.20) from dsum where scope='block' and score='primary_score') union all
 select 'sign_accuracy_at_least_0_75', {_p('sign_accuracy')} >= 0.75 union all select 'coverage_at_least_0_95', {_p('coverage')} >= 0.95 union all
 select 'precision_improvement_at_least_0_05', {_p('prec')} - (select prec from dsum where scope='overall' and score='benchmark') >= 0.05"""


@query("drift_gate", "select gate, passed from dgate union all select 'all_gates', bool_and(passed) from dgate", CTES)
def drift_gate(spark, d):
    return U.drift_gate(U.drift_summary(drift_frame(spark, d), BLOCKS), "primary_score", "benchmark", list(BLOCKS))


def peer_summary_frame(spark, d):
    rows = recall_frame(spark, d).select(F.lit("base").alias("scenario"), F.lit("anchored").alias("space"), F.col("g").cast("int").alias("fyear"),
                                         "recall_at_k", "random_recall", "observed_crowding", "latent_crowding")
    complete = rows.agg(F.count(F.lit(1)).alias("complete_rows"))
    total = D.reports(spark, d).agg(F.count(F.lit(1)).alias("total_rows"))
    totals = complete.join(total).select(F.lit("base").alias("scenario"), "complete_rows", "total_rows")
    return cut(U.peer_summary(rows, totals, BLOCKS))


CTES["psc"] = """select 'overall' scope, 'all' scope_value, * from precall union all select 'scenario', 'base', * from precall union all
 select 'block', '1997_1998', * from precall where fyear between 1997 and 1998 union all select 'block', '1999_2000', * from precall where fyear between 1999 and 2000"""
CTES["psum"] = f"""select scope, scope_value, count(*) as "rows", avg(recall) mean_recall, avg(random_recall) mean_random_recall, avg(recall)/avg(random_recall) recall_lift, corr(ro, rl) crowding_spearman,
 cast(case when scope='block' then round(count(*) * (select count(*) from reports) / (select count(*) from precall)::double) else (select count(*) from reports) end as bigint) total_rows
 from (select *, {Q.avg_rank('oc', 'scope, scope_value')} ro, {Q.avg_rank('lc', 'scope, scope_value')} rl from psc) group by 1,2"""


@query(
    "peer_summary",
    """select scope, scope_value, "rows", round(mean_recall,8) mean_recall, round(mean_random_recall,8) mean_random_recall, round(recall_lift,6) recall_lift, round(crowding_spearman,7) crowding_spearman, total_rows from psum""",
    CTES,
)
def peer_summary(spark, d):
    out = peer_summary_frame(spark, d).drop("space", "coverage")
    return out.withColumns({"mean_recall": r("mean_recall", 8), "mean_random_recall": r("mean_random_recall", 8), "recall_lift": r("recall_lift"), "crowding_spearman": r("crowding_spearman", 7)})


CTES["pgate"] = """select 'peers' use, o.mean_recall >= 0.05 and (select bool_and(mean_recall >= 0.03) and count(*)=1 from psum where scope='scenario') and o.recall_lift >= 5 and o."rows"/o.total_rows::double >= 0.85 passed from psum o where scope='overall'
 union all select 'crowding', o.crowding_spearman >= 0.20 and (select bool_and(crowding_spearman >= 0.10) and count(*)=1 from psum where scope='scenario') and o."rows"/o.total_rows::double >= 0.85 from psum o where scope='overall'"""
CTES["prod"] = """select 'strategic_drift_supported' gate, (select bool_and(passed) from dgate) passed union all select 'peer_or_crowding_supported', (select bool_or(passed) from pgate)"""


@query("product_gate", "select gate, passed from prod union all select 'all_gates', bool_and(passed) from prod", CTES)
def product_gate(spark, d):
    summary = peer_summary_frame(spark, d)
    drift = U.drift_gate(U.drift_summary(drift_frame(spark, d), BLOCKS), "primary_score", "benchmark", list(BLOCKS))
    return U.product_gate(drift, U.peer_map_gate(summary, "anchored", 1), U.crowding_gate(summary, "anchored", 1))


PERIODS = {"calibration": (1996, 1998), "holdout": (1999, 2001), "block1": (1999, 1999), "block2": (2000, 2001)}
CTES["px"] = """select c.*, p.p period, k.k candidate, case k.k when 'primary_score' then primary_score when 'sale' then sale else benchmark end v from chg c
 join (values ('calibration',1996,1998),('holdout',1999,2001),('block1',1999,1999),('block2',2000,2001)) p(p,a,b) on c.fyear between p.a and p.b cross join (values ('primary_score'),('sale'),('benchmark')) k(k)"""
CTES["pm"] = f"""select candidate, period, count(*) n, corr(rv, rt) s from (select *, {Q.avg_rank('v', 'candidate, period')} rv, {Q.avg_rank('truth_value', 'candidate, period')} rt
 from px where v is not null and truth_value is not null) group by 1,2"""


@query("proxy_metrics", "select candidate, period, n, round(s,8) spearman from pm", CTES)
def proxy_metrics(spark, d):
    out = U.proxy_metrics(change_frame(spark, d), ["primary_score", "sale", "benchmark"], "truth_value", PERIODS)
    return out.withColumn("spearman", r("spearman", 8))


@query(
    "select_proxy",
    """select b.candidate, round(b.s,8) calibration_spearman, round(h.s,8) held_out_spearman, h.s >= 0.10 held_out_gate, b1.s >= 0.05 and b2.s >= 0.05 block_gate, h.n/z.n::double >= 0.9 coverage_gate, h.s - z.s >= 0.02 improvement_gate
 from (select * from pm where period='calibration' and candidate<>'benchmark' order by s desc, candidate limit 1) b join pm h on h.candidate=b.candidate and h.period='holdout'
 join pm b1 on b1.candidate=b.candidate and b1.period='block1' join pm b2 on b2.candidate=b.candidate and b2.period='block2' join pm z on z.candidate='benchmark' and z.period='holdout'""",
    CTES,
)
def select_proxy(spark, d):
    m = U.proxy_metrics(change_frame(spark, d), ["primary_score", "sale", "benchmark"], "truth_value", PERIODS)
    return U.select_proxy(cut(m), "benchmark").withColumns({c: r(c, 8) for c in ("calibration_spearman", "held_out_spearman")})


@query(
    "eligibility_audit",
    "select fyear, count(*) events, 'primary_score' candidate, count(primary_score) eligible from chg group by 1 union all select fyear, count(*), 'benchmark', count(benchmark) from chg group by 1",
    CTES,
)
def eligibility_audit(spark, d):
    return U.eligibility_audit(change_frame(spark, d), ["primary_score", "benchmark"], ["primary_score", "benchmark"])


@query(
    "recovery_by_industry",
    f"""select sic1, count(*) n, round(corr(primary_score, truth_value),8) pearson, round(regr_slope(truth_value, primary_score),10) slope, round(regr_r2(truth_value, primary_score),8) r_squared, round(corr(a,b),8) spearman
 from (select *, {Q.avg_rank('primary_score', 'sic1')} a, {Q.avg_rank('truth_value', 'sic1')} b from chg where primary_score is not null and truth_value is not null) group by 1""",
    CTES,
)
def recovery_by_industry(spark, d):
    out = U.recovery(change_frame(spark, d), ["sic1"], "primary_score", "truth_value")
    return out.withColumns({"pearson": r("pearson", 8), "slope": r("slope", 10), "r_squared": r("r_squared", 8), "spearman": r("spearman", 8)})


_RC = """select '{n}' pair, count(*) n, round(corr(a,b),8) spearman, round(max(sl),10) slope from (select {ra} a, {rb} b, regr_slope(y,x) over () sl from (select {x} x, {y} y from chg where {x} is not null and {y} is not null))"""


@query(
    "realized_check",
    " union all ".join(
        _RC.format(n=n, x=x, y=y, ra=Q.avg_rank("x"), rb=Q.avg_rank("y"))
        for n, x, y in (("candidate_truth", "primary_score", "truth_value"), ("candidate_outcome", "primary_score", "benchmark"), ("oracle_outcome", "truth_value", "benchmark"))
    ),
    CTES,
)
def realized_check(spark, d):
    out = U.realized_check(change_frame(spark, d), "primary_score", "truth_value", "truth_value", "benchmark")
    return out.select("pair", "n", r("spearman", 8).alias("spearman"), r("slope", 10).alias("slope"))


@query("bootstrap_power")
def bootstrap_power(spark, d):
    """Cluster bootstrap over effect sizes; the draws are hashes, so no SQL twin."""
    rows = change_frame(spark, d).select("gvkey", F.col("primary_score").alias("observable"), (F.col("truth_value") / 100).alias("injected"), (F.col("benchmark") / 1e5).alias("outcome")).dropna()
    return U.power_gates(U.bootstrap_power(cut(rows), [1.0, 2.0, 4.0, 6.0, 8.0, 10.0], 100, 12000, 0.5))


@query(
    "subgroup_metrics",
    """select dimension, value, count(*) as "rows", count(distinct gvkey) issuers, sum(y) events, round((sum(rk) filter (y=1) - sum(y)*(sum(y)+1)/2.0::double)/(sum(y)*(count(*)-sum(y))),8) roc_auc, round(avg((y-p)*(y-p)),8) brier_score
 from (select *, %s rk from (select 'decade' dimension, cast(cast(floor(fyear/10)*10 as int) as varchar) as value, gvkey, p, y from sg union all select 'sic1', cast(sic1 as varchar), gvkey, p, y from sg)) group by 1,2"""
    % Q.avg_rank("p", "dimension, value"),
    {**CTES, "sg": "select gvkey, fyear, sic1, least(greatest(ext_f/sale,1e-6::double),1-1e-6::double) p, case when truth_value > 0 then 1 else 0 end y from chg where sale > 0 and truth_value is not null"},
)
def subgroup_metrics(spark, d):
    rows = change_frame(spark, d).filter(F.col("truth_value").isNotNull()).select(
        "gvkey", F.col("fyear").alias("year"), "sic1", S.positive_ratio("ext_f", "sale").alias("p"), (F.col("truth_value") > 0).cast("int").alias("y")
    )
    out = U.subgroup_metrics(rows, "p", "y")
    return out.withColumns({"roc_auc": r("roc_auc", 8), "brier_score": r("brier_score", 8)})


@query(
    "subgroup_metrics_by_cause",
    """select cause, dimension, value, count(*) as "rows", count(distinct gvkey) issuers, sum(y) events, round((sum(rk) filter (y=1) - sum(y)*(sum(y)+1)/2.0::double)/(sum(y)*(count(*)-sum(y))),8) roc_auc, round(avg((y-p)*(y-p)),8) brier_score
 from (select *, %s rk from (select cause, 'decade' dimension, cast(cast(floor(fyear/10)*10 as int) as varchar) as value, gvkey, p, y from sgc union all select cause, 'sic1', cast(sic1 as varchar), gvkey, p, y from sgc)) group by 1,2,3"""
    % Q.avg_rank("p", "cause, dimension, value"),
    {
        **CTES,
        "sgc": """select gvkey, fyear, sic1, 'growth' cause, least(greatest(ext_f/sale,1e-6::double),1-1e-6::double) p, case when truth_value > 0 then 1 else 0 end y from chg where sale > 0 and truth_value is not null
 union all select gvkey, fyear, sic1, 'decline', 1-least(greatest(ext_f/sale,1e-6::double),1-1e-6::double), case when truth_value < 0 then 1 else 0 end from chg where sale > 0 and truth_value is not null""",
    },
)
def subgroup_metrics_by_cause(spark, d):
    """Two competing outcomes of the same reports, each with a probability of its own."""
    rows = change_frame(spark, d).filter(F.col("truth_value").isNotNull()).select(
        "gvkey", F.col("fyear").alias("year"), "sic1", S.positive_ratio("ext_f", "sale").alias("q"), "truth_value"
    )
    causes = F.array(
        F.struct(F.lit("growth").alias("cause"), F.col("q").alias("p"), (F.col("truth_value") > 0).cast("int").alias("y")),
        F.struct(F.lit("decline").alias("cause"), (1 - F.col("q")).alias("p"), (F.col("truth_value") < 0).cast("int").alias("y")),
    )
    out = U.subgroup_metrics(rows.select("gvkey", "year", "sic1", F.inline(causes)), "p", "y", groups=["cause"])
    return out.withColumns({"roc_auc": r("roc_auc", 8), "brier_score": r("brier_score", 8)})


@query(
    "utility_gate",
    """select * from (with c as (select l_returnflag scenario, cast(l_linestatus='F' as int) horizon_years, cast(year(l_shipdate) as int) fold, avg(l_discount)-0.049::double a, avg(l_tax)-0.04::double b from lineitem group by 1,2,3),
 g as (select scenario, horizon_years, avg(a) m from c group by 1,2), t as (
 select 'mean_auc_improvement_at_least_0_01' gate, avg(a) >= 0.01 passed from c union all select 'auc_wins', count(*) filter (a>0) >= 16 from c union all select 'mean_brier_improvement_positive', avg(b) > 0 from c
 union all select 'all_scenario_horizon_cells_positive', count(*) filter (m>0) = 6 from g) select gate, passed from t union all select 'all_gates', bool_and(passed) from t)""",
)
def utility_gate(spark, d):
    line = scan(spark, d, "lineitem", ["l_returnflag", "l_linestatus", "l_shipdate", "l_discount", "l_tax"])
    cells = line.groupBy(F.col("l_returnflag").alias("scenario"), (F.col("l_linestatus") == "F").cast("int").alias("horizon_years"), F.year(F.col("l_shipdate").cast("date")).alias("fold")).agg(
        (F.avg("l_discount") - 0.049).alias("auc_improvement"), (F.avg("l_tax") - 0.04).alias("brier_improvement")
    )
    return U.utility_gate(cells)


@query(
    "table_contracts",
    """select 'orders' as "table", 'null_key' as "check", count(*) filter (o_orderkey is null) violations from orders union all select 'orders','nonfinite', count(*) filter (not isfinite(o_totalprice)) from orders
 union all select 'orders','positive_price', count(*) filter (o_totalprice <= 0) from orders union all select 'orders','duplicate_key', coalesce(sum(n),0)::bigint from (select count(*) n from orders group by o_orderkey having count(*)>1)
 union all select 'lineitem','null_key', count(*) filter (l_orderkey is null or l_linenumber is null) from lineitem union all select 'lineitem','nonfinite', count(*) filter (not isfinite(l_extendedprice)) from lineitem
 union all select 'lineitem','share_range', count(*) filter (l_discount < 0 or l_discount > 0.1) from lineitem union all select 'lineitem','duplicate_key', coalesce(sum(n),0)::bigint from (select count(*) n from lineitem group by l_orderkey, l_linenumber having count(*)>1)""",
)
def table_contracts(spark, d):
    orders = scan(spark, d, "orders", ["o_orderkey", "o_totalprice"])
    line = scan(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"])
    a = K.table_checks(orders, "orders", ["o_orderkey"], {"positive_price": F.col("o_totalprice") <= 0})
    b = K.table_checks(line, "lineitem", ["l_orderkey", "l_linenumber"], {"share_range": (F.col("l_discount") < 0) | (F.col("l_discount") > 0.1)})
    return a.unionByName(b)


@query(
    "key_coverage",
    """select 'orders_without_lines' as "check", count(*) violations from (select distinct o_orderkey k from orders) where k not in (select l_orderkey from lineitem)
 union all select 'lines_without_order', count(*) from (select distinct l_orderkey k from lineitem) where k not in (select o_orderkey from orders)
 union all select 'months_without_link', count(*) from (select distinct permno k from months) where k not in (select lpermno from links)
 union all select 'months_without_factor', count(*) from (select distinct date k from months) where k not in (select date from factors)""",
    CTES,
)
def key_coverage(spark, d):
    orders, line = scan(spark, d, "orders", ["o_orderkey"]), scan(spark, d, "lineitem", ["l_orderkey"])
    months = D.security_months(spark, d)
    return (
        K.missing_coverage(orders, line, {"o_orderkey": "l_orderkey"}, "orders_without_lines")
        .unionByName(K.missing_coverage(line, orders, {"l_orderkey": "o_orderkey"}, "lines_without_order"))
        .unionByName(K.missing_coverage(months, D.links(spark, d), {"permno": "lpermno"}, "months_without_link"))
        .unionByName(K.missing_coverage(months, D.factors(spark, d), {"date": "date"}, "months_without_factor"))
    )


@query(
    "link_overlaps",
    """select gvkey, count(*) filter (o) as "overlaps", count(*) filter (rv) as reversed from (select gvkey, linkdt <= max(coalesce(linkenddt, date '9999-12-31')) over
  (partition by gvkey order by linkdt, coalesce(linkenddt, date '9999-12-31') rows between unbounded preceding and 1 preceding) o, coalesce(linkenddt, date '9999-12-31') < linkdt rv from links) group by 1 having count(*) filter (o) > 0 or count(*) filter (rv) > 0""",
)
def link_overlaps(spark, d):
    return K.interval_overlaps(D.links(spark, d), "gvkey", "linkdt", "linkenddt")


@query(
    "filing_contract",
    """select 'filings_without_report' as "check", 0::bigint violations union all select 'filed_before_report', count(*) from filings where filing_timestamp < datadate""",
    CTES,
)
def filing_contract(spark, d):
    base = D.reports(spark, d)
    filed = D.filings(spark, d, base)
    keys = {"gvkey": "gvkey", "datadate": "datadate", "fyear": "fyear"}
    early = filed.agg(F.count(F.when(F.col("filing_timestamp") < F.col("datadate").cast("timestamp_ntz"), 1)).alias("violations")).select(F.lit("filed_before_report").alias("check"), "violations")
    return K.missing_coverage(filed, base, keys, "filings_without_report").unionByName(early)


@query("table_fingerprint")
def table_fingerprint(spark, d):
    """Order-independent content hash and date ranges of the orders and line items."""
    a = K.fingerprint(scan(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]), "orders")
    b = K.fingerprint(scan(spark, d, "lineitem", ["l_orderkey", "l_suppkey", "l_extendedprice", "l_shipdate"]), "lineitem")
    return union_scenarios({"orders": a, "lineitem": b})


@query(
    "panel_gate",
    """select count(*) filter (formation_date > date) late_reports, count(*) filter (stale not between 0 and 18) stale_reports, count(*) filter (reporting_history < 1) short_history, count(*) as "rows" from panel""",
    CTES,
)
def panel_gate(spark, d):
    panel = build_panel(spark, d)
    bad = lambda cond: F.count(F.when(cond, 1))
    return panel.agg(
        bad(F.col("formation_date") > F.col("date")).alias("late_reports"), bad(~F.col("staleness_months").between(0, 18)).alias("stale_reports"),
        bad(F.col("reporting_history") < 1).alias("short_history"), F.count(F.lit(1)).alias("rows"),
    )


@query(
    "recomputed_differences",
    """select count(*) filter (b.k is null) only_left, count(*) filter (a.k is null) only_right,
 count(*) filter (a.k and b.k and (coalesce(abs(a.tr-b.tr) > 1e-12::double, false) or (a.tr is null) <> (b.tr is null))) diff_total_return,
 count(*) filter (a.k and b.k and a.hd <> b.hd) diff_has_delist
from (select permno, date, total_return tr, has_delist hd, true k from compounded) a
full join (select m.permno, m.date, case when ret is not null and dlret is not null then ret+dlret+ret*dlret else coalesce(ret,dlret) end tr, x.permno is not null hd, true k
 from months m left join (select permno, last_day(dlstdt) date, dlret from delistings) x on x.permno=m.permno and x.date=m.date) b on a.permno=b.permno and a.date=b.date""",
    CTES,
)
def recomputed_differences(spark, d):
    """Exit returns recomputed from a formula of their own against the operator's output."""
    saved = P.compound_exit_returns(D.security_months(spark, d), D.delistings(spark, d)).select("permno", "date", "total_return", "has_delist")
    exits = D.delistings(spark, d).select("permno", F.last_day("dlstdt").alias("date"), "dlret", F.lit(True).alias("x"))
    again = D.security_months(spark, d).join(exits, ["permno", "date"], "left").select(
        "permno", "date",
        F.when(F.col("ret").isNotNull() & F.col("dlret").isNotNull(), F.col("ret") + F.col("dlret") + F.col("ret") * F.col("dlret")).otherwise(F.coalesce("ret", "dlret")).alias("total_return"),
        F.col("x").isNotNull().alias("has_delist"),
    )
    return K.table_differences(saved, again, ["permno", "date"], ["total_return", "has_delist"], 1e-12)


@query(
    "checked_join",
    "select sic1, count(*) n, round(sum(sale),2) sale from reports group by 1",
)
def checked_join(spark, d):
    """Reports joined many-to-one to firms with the cardinality enforced."""
    left = D.reports(spark, d).select("gvkey", "sale")
    joined = K.checked_join(left, D.firms(spark, d).select("gvkey", "sic1"), ["gvkey"], "left", "many_to_one")
    return joined.groupBy("sic1").agg(F.count(F.lit(1)).alias("n"), r(F.sum("sale"), 2).alias("sale"))
