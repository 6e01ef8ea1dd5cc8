"""Descriptive tables, labels, folds, rates and prediction metrics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pitscape.functions import ordering as O
from pitscape.functions import scalars as S
from pitscape.operators import describe as E
from pitscape.operators import labels as L
from pitscape.params import DEFAULT
from pitscape.plans import oracle_parts as Q
from pitscape.plans.registry import query, r
from pitscape.plans.score_queries import ALL, CTES as SCORE, report_components
from pitscape.session import cut, stored
from pitscape.sources import derived as D
from pitscape.sources.tables import scan

# the driver's tables span seven years, so the horizons and windows are short
SHORT = replace(DEFAULT, horizons_years=(1, 2), validation_years=1, test_windows=((2000, 2000), (2001, 2001)))
FEATURES = ["gross_margin", "operating_margin", "asset_lightness", "capex_intensity", "sga_intensity", "rd_intensity_zero"]

CTES = dict(SCORE)
CTES["ev"] = "select *, last_day(datadate + interval 3 month) feature_date from comp"
CTES["lab0"] = """select e.*, h.h horizon_years, x.exit_date, x.exit_category, x.last_observed_date,
 cast(e.feature_date + to_years(h.h) as date) horizon_end
 from ev e left join exits x using (gvkey) cross join (values (1),(2)) h(h)"""
CTES["lab1"] = """select *, coalesce(exit_date > feature_date and exit_date <= horizon_end, false) ins,
 coalesce(exit_category='performance_failure', false) fl, coalesce(last_observed_date >= horizon_end, false) fo from lab0"""
CTES["lab"] = """select *, case when y is not null then 'observed' else 'censored' end label_status,
 case when y is not null then 'none' when ins then 'competing_exit' when horizon_end > date '2001-12-31' then 'administrative_right_censor' else 'lost_followup' end censor_reason,
 case when ins then exit_date when y = 0 then horizon_end end label_observed_date, year(feature_date) event_year
 from (select *, case when ins and fl then 1 when not (ins and not fl) and fo then 0 end y from lab1)"""
_FOLDS = []
for _h in SHORT.horizons_years:
    for _i, (_a, _b) in enumerate(SHORT.test_windows, 1):
        _v = _a - _h - 1
        _FOLDS += [(_h, _i, "train", 1995, _v - _h - 1), (_h, _i, "validation", _v, _v), (_h, _i, "test", _a, _b)]
CTES["folds"] = "select * from (values " + ",".join(f"({h},{i},'{n}',{a},{b})" for h, i, n, a, b in _FOLDS) + ") f(fh,fold,role,fy,ty)"
CTES["split"] = "select l.*, f.fold, f.role from lab l join folds f on f.fh = l.horizon_years and l.event_year between f.fy and f.ty where l.y is not null"


def label_frame(spark, d):
    events = report_components(spark, d).withColumn("feature_date", F.last_day(F.add_months("datadate", 3)))
    exits = D.firm_exits(spark, d)
    last = D.reports(spark, d).agg(F.max("fyear")).first()[0]
    sample_end = F.make_date(F.lit(last).cast("int"), F.lit(12), F.lit(31))
    return L.fixed_horizon_labels(
        events, L.single_exit(exits), exits.select("gvkey", "last_observed_date"), sample_end, SHORT.horizons_years
    ).withColumn("event_year", F.year("feature_date"))


def split_frame(spark, d):
    """Rows of every fold and role, written once for the model phase."""
    return cut(L.assign_folds(label_frame(spark, d), L.fold_table(spark, 1995, SHORT)))


@query(
    "missingness_table",
    " union all ".join(
        f"select 'components' section, '{c}' as \"column\", count(*) as \"rows\", count(*)-count({c}) missing, round(1-count({c})/count(*)::double,9) missing_share from comp"
        for c in ALL
    ),
    CTES,
)
def missingness_table(spark, d):
    out = E.missingness(report_components(spark, d), ALL, "components")
    return out.withColumn("missing_share", r("missing_share", 9))


@query("nonfinite_counts", " union all ".join(f"select '{c}' as \"column\", count(*) filter (not isfinite({c})) nonfinite from comp" for c in FEATURES), CTES)
def nonfinite_counts(spark, d):
    return E.nonfinite_counts(report_components(spark, d), FEATURES)


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query(
    "rank_correlation_matrix",
    " union all ".join(
        f"""select 'components' section, '{a}' as "left", '{b}' as "right", count(*) n, round(corr(rx, ry),7) spearman from
 (select {Q.avg_rank('x')} rx, {Q.avg_rank('y')} ry from (select {a} x, {b} y from comp where {a} is not null and {b} is not null))"""
        for a, b in _PAIRS
    ),
    CTES,
)
def rank_correlation_matrix(spark, d):
    out = E.correlation_long(stored(report_components(spark, d).select(*FEATURES)), FEATURES, "components")
    return out.withColumn("spearman", r("spearman", 7))


@query("variance_inflation")
def variance_inflation(spark, d):
    return E.variance_inflation(report_components(spark, d), FEATURES, "components")


@query(
    "distribution_summary",
    """select event_type, count(*) as "count", round(avg(value),6) mean, round(stddev_samp(value),6) std, min(value) as "min", max(value) as "max", """
    + ", ".join(f"round(quantile_cont(value, {p}::double),6) p{int(round(p*100)):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
    + " from events group by 1",
)
def distribution_summary(spark, d):
    out = E.distribution(scan(spark, d, "events", ["event_type", "value"]), ["event_type"], "value")
    return out.withColumns({c: r(c) for c in out.columns if c not in ("event_type", "count", "min", "max")})


_PM = """(select l_linestatus g, least(greatest(l_quantity/60 + l_discount, 1e-6::double), 1-1e-6::double) p, case when l_returnflag='R' then 1 else 0 end y from lineitem)"""


def _scored_lines(spark, d):
    line = scan(spark, d, "lineitem", ["l_linestatus", "l_quantity", "l_discount", "l_returnflag"])
    return line.select(
        F.col("l_linestatus").alias("g"), (F.col("l_quantity") / 60 + F.col("l_discount")).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y")
    )


_EDGES = ", ".join(f"quantile_cont(p, {i / 10}::double) e{i}" for i in range(11))
_BIN = "greatest(" + " + ".join(f"(e{i} < p)::int" for i in range(11)) + ", " + " + ".join(f"(e{i} = e0)::int" for i in range(10)) + ")"
_CURVE = f"select b.g, {_BIN} bin, count(*) n, avg(p) predicted, avg(y) actual from base b join (select g, {_EDGES} from base group by 1) e on e.g=b.g group by 1,2"


@query(
    "prediction_metrics",
    f"""select * from (with base as {_PM}, rk as (select *, {Q.avg_rank('p', 'g')} rp, {Q.avg_rank('y', 'g')} ry,
  count(*) over (partition by g order by p desc) nge, sum(y) over (partition by g order by p desc) pge from base),
 curve as ({_CURVE}), ece as (select g, sum(n*abs(actual-predicted))/sum(n) ece from curve group by 1)
select rk.g, count(*) as "rows", sum(y) events, round((sum(rp) filter (y=1) - sum(y)*(sum(y)+1)/2.0::double)/(sum(y)*(count(*)-sum(y))),8) roc_auc,
 round(sum(case when y=1 then pge/nge::double end)/sum(y),8) average_precision, round(avg((y-p)*(y-p)),8) brier_score,
 round(-avg(case when y=1 then ln(p) else ln(1-p) end),8) log_loss, round(corr(rp,ry),8) spearman, round(max(ece),8) expected_calibration_error
from rk join ece on ece.g = rk.g group by 1)""",
)
def prediction_metrics(spark, d):
    out = E.prediction_metrics(_scored_lines(spark, d), ["g"], "p", "y")
    return out.withColumns({c: r(c, 8) for c in out.columns if c not in ("g", "rows", "events")})


@query(
    "calibration_curve",
    f"select * from (with base as {_PM} select g, bin, n, round(predicted,8) predicted, round(actual,8) actual from ({_CURVE}))",
)
def calibration_curve(spark, d):
    base = _scored_lines(spark, d).withColumn("p", S.clip("p", 1e-6, 1 - 1e-6))
    out = E.calibration_curve(base, ["g"], "p", "y")
    return out.withColumns({c: r(c, 8) for c in ("predicted", "actual")})


@query("calibration_line")
def calibration_line(spark, d):
    """Logistic recalibration line per group; no closed form in SQL, checked in the tests."""
    base = _scored_lines(spark, d).withColumn("z", S.logit("p", 1e-6))
    return E.fit_logit_line(base, ["g"], "z", "y")


@query(
    "average_rank_in_cohort",
    f"""select o_orderstatus as status, month, total, n, round(rk,6) rank, round(rk/n,9) percentile from (
 select o_orderstatus, last_day(o_orderdate) as month, o_totalprice total, count(*) over (partition by o_orderstatus, last_day(o_orderdate)) n,
 (rank() over (partition by o_orderstatus, last_day(o_orderdate) order by o_totalprice) + (count(*) over (partition by o_orderstatus, last_day(o_orderdate), o_totalprice)-1)/2.0::double) rk from orders)""",
)
def average_rank_in_cohort(spark, d):
    orders = scan(spark, d, "orders", ["o_orderstatus", "o_orderdate", "o_totalprice"]).select(
        F.col("o_orderstatus").alias("status"), F.last_day(F.col("o_orderdate").cast("date")).alias("month"), F.col("o_totalprice").alias("total")
    )
    out = O.with_average_rank(orders, ["status", "month"], "total", "rank", "n")
    return out.select("status", "month", "total", "n", r("rank").alias("rank"), r(F.col("rank") / F.col("n"), 9).alias("percentile"))


@query(
    "fixed_horizon_labels",
    """select gvkey, fyear, horizon_years, horizon_end, y as failure_within_horizon, label_status, censor_reason, label_observed_date from lab""",
    CTES,
)
def fixed_horizon_labels(spark, d):
    return label_frame(spark, d).select(
        "gvkey", "fyear", "horizon_years", "horizon_end", "failure_within_horizon", "label_status", "censor_reason", "label_observed_date"
    )


@query("label_counts", "select horizon_years, label_status, censor_reason, count(*) as \"rows\", coalesce(sum(y),0) failures from lab group by 1,2,3", CTES)
def label_counts(spark, d):
    return L.label_counts(label_frame(spark, d))


@query("followup_bounds", "select cast(o_custkey as varchar) gvkey, min(o_orderdate)::date first_observed_date, max(o_orderdate)::date last_observed_date from orders group by 1")
def followup_bounds(spark, d):
    obs = scan(spark, d, "orders", ["o_custkey", "o_orderdate"]).select(
        F.col("o_custkey").cast("string").alias("gvkey"), F.col("o_orderdate").cast("date").alias("date")
    )
    return L.followup_bounds(obs)


@query("purged_folds", "select horizon_years, fold, role, count(*) as \"rows\", sum(y) failures, min(event_year) first_year, max(event_year) last_year from split group by 1,2,3", CTES)
def purged_folds(spark, d):
    return L.assign_folds(label_frame(spark, d), L.fold_table(spark, 1995, SHORT)).groupBy("horizon_years", "fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("failure_within_horizon").alias("failures"),
        F.min("event_year").alias("first_year"), F.max("event_year").alias("last_year"),
    )


@query(
    "smoothed_group_rates",
    """select s.gvkey, s.fyear, s.horizon_years, s.fold, s.role, round(coalesce((g.s + 20*a.m)/(g.n+20), a.m),9) probability
 from split s join (select horizon_years, fold, avg(y) m from split where role='train' group by 1,2) a on a.horizon_years=s.horizon_years and a.fold=s.fold
 left join (select horizon_years, fold, sic2, sum(y) s, count(*) n from split where role='train' group by 1,2,3) g
 on g.horizon_years=s.horizon_years and g.fold=s.fold and g.sic2=s.sic2 where s.role <> 'train'""",
    CTES,
)
def smoothed_group_rates(spark, d):
    out = L.smoothed_rates(split_frame(spark, d), ["horizon_years", "fold"], "sic2")
    return out.select("gvkey", "fyear", "horizon_years", "fold", "role", r("probability", 9).alias("probability"))


_TF = FEATURES[:3]
_MED = ", ".join(f"median({c}) k_{c}" for c in _TF)
_TERT = ", ".join(
    f"quantile_cont(coalesce({c}, k_{c}), 1.0::double/3) t1_{c}, quantile_cont(coalesce({c}, k_{c}), 2.0::double/3) t2_{c}, any_value(k_{c}) m_{c}" for c in _TF
)
_TC = " || ".join(f"cast((coalesce({c}, m_{c}) >= t1_{c})::int + (coalesce({c}, m_{c}) >= t2_{c})::int as varchar)" for c in _TF)


@query(
    "tertile_cell_rates",
    f"""select * from (with c as (select s.*, {_TC} cell from split s join (select horizon_years, fold, {_TERT}
  from split join (select horizon_years, fold, {_MED} from split where role='train' group by 1,2) using (horizon_years, fold) where role='train' group by 1,2) t
  on t.horizon_years=s.horizon_years and t.fold=s.fold)
 select c.gvkey, c.fyear, c.horizon_years, c.fold, c.role, c.cell, round(coalesce((g.s + 20*a.m)/(g.n+20), a.m),9) probability
 from c join (select horizon_years, fold, avg(y) m from c where role='train' group by 1,2) a on a.horizon_years=c.horizon_years and a.fold=c.fold
 left join (select horizon_years, fold, cell, sum(y) s, count(*) n from c where role='train' group by 1,2,3) g
 on g.horizon_years=c.horizon_years and g.fold=c.fold and g.cell=c.cell where c.role <> 'train')""",
    CTES,
)
def tertile_cell_rates(spark, d):
    cells = L.tertile_cells(split_frame(spark, d), ["horizon_years", "fold"], _TF)
    out = L.smoothed_rates(cells, ["horizon_years", "fold"], "cell")
    return out.select("gvkey", "fyear", "horizon_years", "fold", "role", "cell", r("probability", 9).alias("probability"))


@query(
    "weighted_metric_means",
    """select l_linestatus as g, round(sum(m*n)/sum(n),8) m, round(sum(s*n)/sum(n),8) s from
 (select l_linestatus, l_returnflag, avg(l_discount) m, avg(l_tax) s, count(*) n from lineitem group by 1,2) group by 1""",
)
def weighted_metric_means(spark, d):
    line = scan(spark, d, "lineitem", ["l_linestatus", "l_returnflag", "l_discount", "l_tax"])
    cells = line.groupBy(F.col("l_linestatus").alias("g"), "l_returnflag").agg(
        F.avg("l_discount").alias("m"), F.avg("l_tax").alias("s"), F.count(F.lit(1)).alias("n")
    )
    out = E.weighted_mean(cells, ["g"], ["m", "s"], "n")
    return out.withColumns({"m": r("m", 8), "s": r("s", 8)})


@query(
    "wins_against_benchmarks",
    """select * from (with c as (select last_day(l_shipdate) as month, avg(l_discount) filter (l_returnflag='A') a, avg(l_discount) filter (l_returnflag='N') n,
  avg(l_discount) filter (l_returnflag='R') r from lineitem group by 1)
 select 'N' benchmark, count(a-n) cells, count(*) filter (a-n > 0) wins, round(avg(a-n),9) mean_gain, round(median(a-n),9) median_gain from c
 union all select 'R', count(a-r), count(*) filter (a-r > 0), round(avg(a-r),9), round(median(a-r),9) from c)""",
)
def wins_against_benchmarks(spark, d):
    line = scan(spark, d, "lineitem", ["l_shipdate", "l_returnflag", "l_discount"])
    cells = line.groupBy(F.last_day(F.col("l_shipdate").cast("date")).alias("month"), "l_returnflag").agg(F.avg("l_discount").alias("m"))
    out = E.wins_against(cells, ["month"], "l_returnflag", "A", ["N", "R"], "m", lower_is_better=False)
    return out.withColumns({"mean_gain": r("mean_gain", 9), "median_gain": r("median_gain", 9)})


@query(
    "clustered_slope",
    """select * from (with b as (select l_linestatus g, l_extendedprice y, l_quantity x, l_suppkey c from lineitem),
 f as (select g, regr_slope(y,x) sl, regr_intercept(y,x) ic, avg(x) mx, regr_sxx(y,x) sxx, count(*) n, count(distinct c) k from b group by 1),
 s as (select b.g, c, sum((x-mx)*(y-ic-sl*x)) sc from b join f on f.g=b.g group by 1,2)
 select f.g, n as "rows", k clusters, round(sl,6) slope, round(ic,4) intercept, round(sqrt(sum(sc*sc)*(k/(k-1.0::double))*((n-1)/(n-2.0::double)))/sxx,6) se
 from f join s on s.g=f.g group by f.g, n, k, sl, ic, sxx)""",
)
def clustered_slope(spark, d):
    line = scan(spark, d, "lineitem", ["l_linestatus", "l_extendedprice", "l_quantity", "l_suppkey"])
    out = E.clustered_slope(line.withColumnRenamed("l_linestatus", "g"), ["g"], "l_extendedprice", "l_quantity", "l_suppkey")
    return out.select("g", "rows", "clusters", r("slope").alias("slope"), r("intercept", 4).alias("intercept"), r("se").alias("se"))


@query(
    "newey_west_mean",
    """select * from (with s as (select l_returnflag g, last_day(l_shipdate) d, avg(l_discount) x from lineitem group by 1,2),
 m as (select *, x - avg(x) over (partition by g) e, avg(x) over (partition by g) mean, count(*) over (partition by g) n, row_number() over (partition by g order by d) i from s)
 select a.g, max(a.n) n, round(max(a.mean),9) mean, round(sqrt(sum(case when a.i=b.i then 1.0::double else 2*(1-(a.i-b.i)/6.0::double) end * a.e*b.e))/max(a.n),9) se
 from m a join m b on a.g=b.g and a.i-b.i between 0 and 5 group by 1)""",
)
def newey_west_mean(spark, d):
    line = scan(spark, d, "lineitem", ["l_returnflag", "l_shipdate", "l_discount"])
    s = line.groupBy(F.col("l_returnflag").alias("g"), F.last_day(F.col("l_shipdate").cast("date")).alias("d")).agg(F.avg("l_discount").alias("x"))
    out = E.newey_west_mean(s, ["g"], "d", "x", 5)
    return out.select("g", "n", r("mean", 9).alias("mean"), r("se", 9).alias("se"))


@query(
    "group_mode",
    """select l_suppkey as supplier, min(y) as modal_year from (select l_suppkey, year(l_shipdate) y, count(*) n, max(count(*)) over (partition by l_suppkey) m
 from lineitem group by 1,2) where n = m group by 1""",
)
def group_mode(spark, d):
    """Most frequent year per supplier, smallest on a tie; the count table is per (key, value)."""
    line = scan(spark, d, "lineitem", ["l_suppkey", "l_shipdate"])
    counts = line.groupBy(F.col("l_suppkey").alias("supplier"), F.year(F.col("l_shipdate").cast("date")).alias("y")).count()
    return counts.groupBy("supplier").agg((-F.max(F.struct("count", -F.col("y")))["col2"]).alias("modal_year"))
