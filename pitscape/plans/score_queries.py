"""Components, peer and anchored scores, axis composites, proxy levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitscape.functions import ordering as O
from pitscape.functions import scalars as S
from pitscape.operators import axes as A
from pitscape.operators import components as C
from pitscape.operators import panel as P
from pitscape.operators import robust as R
from pitscape.params import DEFAULT
from pitscape.plans import oracle_parts as Q
from pitscape.plans.panel_queries import CTES as PANEL
from pitscape.plans.registry import query, r
from pitscape.session import cut, stored
from pitscape.sources import derived as D
from pitscape.sources.tables import scan

LEVELS = (("sic2", "sic2"), ("sic1", "sic1"), ("market", None))
EVENT = ["gvkey", "datadate", "fyear"]
ALL = list(C.REPORT_COMPONENTS) + list(C.DIAGNOSTICS)

CTES = dict(PANEL)
CTES["comp"] = Q.COMPONENT_SQL
CTES["peers"] = """
select c.*, coalesce(hhi, case when c.sic2 is not null then 0 end) industry_sales_hhi, ln(1 + nf) log_active_firm_count
from comp c left join (select fyear, sic2, sum(x*x)/(sum(x)*sum(x)) hhi, count(distinct gvkey) nf
  from (select fyear, sic2, gvkey, case when sale > 0 then sale end x from comp) group by 1,2) h
on h.fyear = c.fyear and h.sic2 = c.sic2
"""
SCORED = Q.COMPONENTS + ["industry_sales_hhi", "log_active_firm_count"]
CTES["long"] = Q.unpivot("peers", "gvkey, datadate, fyear, sic2, sic1", SCORED)
CTES["st2"] = Q.robust_stats("long", "datadate, component, sic2", "v")
CTES["st1"] = Q.robust_stats("long", "datadate, component, sic1", "v")
CTES["st0"] = Q.robust_stats("long", "datadate, component", "v")
CTES["rel"] = f"""
select l.gvkey, l.datadate, l.fyear, l.component,
  case when s2.n >= 20 and l.component not in ('industry_sales_hhi','log_active_firm_count') then 'sic2'
       when s1.n >= 20 and l.component not in ('industry_sales_hhi','log_active_firm_count') then 'sic1' else 'market' end lvl,
  case when s2.n >= 20 and l.component not in ('industry_sales_hhi','log_active_firm_count') then {Q.score('v', 's2')}
       when s1.n >= 20 and l.component not in ('industry_sales_hhi','log_active_firm_count') then {Q.score('v', 's1')}
       else {Q.score('v', 's0')} end sc,
  case when s2.n >= 20 and l.component not in ('industry_sales_hhi','log_active_firm_count') then s2.n
       when s1.n >= 20 and l.component not in ('industry_sales_hhi','log_active_firm_count') then s1.n else s0.n end pc
from long l left join st2 s2 on s2.datadate=l.datadate and s2.component=l.component and s2.sic2=l.sic2
left join st1 s1 on s1.datadate=l.datadate and s1.component=l.component and s1.sic1=l.sic1
left join st0 s0 on s0.datadate=l.datadate and s0.component=l.component
where coalesce(s2.n >= 20 and l.component not in ('industry_sales_hhi','log_active_firm_count'), false)
   or coalesce(s1.n >= 20 and l.component not in ('industry_sales_hhi','log_active_firm_count'), false) or s0.n >= 20
"""
CTES["served"] = "select y.fyear serves, l.component, l.v from long l join (select distinct fyear from long) y on l.fyear < y.fyear"
CTES["anst"] = Q.robust_stats("served", "serves, component", "v")
CTES["anch"] = f"""select l.gvkey, l.datadate, l.fyear, l.component, coalesce(s.n,0) rc, l.fyear-1 ry,
 case when s.n >= 100 then {Q.score('v', 's')} end sc
from long l left join anst s on s.serves = l.fyear and s.component = l.component"""


def _axes_sql(src: str) -> str:
    wide = ", ".join(f"max(sc) filter (component='{c}') {c}" for c in SCORED)
    cols = []
    for axis, parts in C.AXIS_COMPONENTS.items():
        signed = [f"-{c}" if c in C.NEGATIVE else c for c in parts]
        count = " + ".join(f"({c} is not null)::int" for c in parts)
        total = " + ".join(f"coalesce({s},0)" for s in signed)
        cols.append(f"case when {count} >= {C.AXIS_MINIMUM[axis]} then ({total})/({count}) end {axis}, {count} {axis}_component_count")
    return f"select gvkey, datadate, fyear, {', '.join(cols)} from (select gvkey, datadate, fyear, {wide} from {src} group by 1,2,3)"


CTES["raxes"] = _axes_sql("rel")
CTES["aaxes"] = _axes_sql("anch")
AXES = list(C.AXIS_COMPONENTS)


def report_components(spark, d):
    return C.accounting_components(D.reports(spark, d))


def peer_frame(spark, d):
    """Peer table of the score phase, written once because every statistic reads it; the reports below it are made once."""
    return stored(C.industry_components(stored(report_components(spark, d)), "datadate"))


def relative_axes(spark, d, prefix="", peers=None):
    peers = peer_frame(spark, d) if peers is None else peers
    scores = R.relative_scores(peers, peers, SCORED, "datadate", LEVELS, EVENT, C.MARKET_SCOPE)
    return A.axis_scores(A.pivot_scores(scores, EVENT, SCORED, prefix), prefix)


def anchored_axes(spark, d, prefix="", peers=None):
    scores = R.anchored_scores(peer_frame(spark, d) if peers is None else peers, SCORED, EVENT, "datadate")
    return A.axis_scores(A.pivot_scores(scores, EVENT, SCORED, prefix), prefix)


@query(
    "accounting_components",
    "select gvkey, fyear, rd_missing_indicator, " + ", ".join(f"round({c},8) {c}" for c in ALL if c != "rd_missing_indicator") + " from comp",
    CTES,
)
def accounting_components(spark, d):
    out = report_components(spark, d)
    return out.select("gvkey", "fyear", "rd_missing_indicator", *[r(c, 8).alias(c) for c in ALL if c != "rd_missing_indicator"])


@query("decayed_stock", "select gvkey, fyear, round(capitalized_rnd_stock_assets,9) stock from comp", CTES)
def decayed_stock(spark, d):
    return report_components(spark, d).select("gvkey", "fyear", r("capitalized_rnd_stock_assets", 9).alias("stock"))


@query("asset_growth", "select gvkey, fyear, round(asset_growth,8) growth from comp", CTES)
def asset_growth(spark, d):
    return C.asset_growth(D.reports(spark, d)).select("gvkey", "fyear", r("asset_growth", 8).alias("growth"))


@query(
    "industry_concentration",
    """select distinct fyear, sic2, round(industry_sales_hhi,9) hhi, round(log_active_firm_count,9) firms from peers""",
    CTES,
)
def industry_concentration(spark, d):
    return peer_frame(spark, d).select(
        "fyear", "sic2", r("industry_sales_hhi", 9).alias("hhi"), r("log_active_firm_count", 9).alias("firms")
    ).distinct()


@query(
    "robust_group_statistics",
    "select returnflag, linestatus, month, n, round(median,4) median, round(lower,4) lower, round(upper,4) upper, round(std,4) std, round(mad,4) mad from ("
    + Q.robust_stats("(select l_returnflag returnflag, l_linestatus linestatus, last_day(l_shipdate) as month, l_extendedprice v from lineitem)", "returnflag, linestatus, month", "v")
    + ")",
)
def robust_group_statistics(spark, d):
    line = scan(spark, d, "lineitem", ["l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice"]).select(
        F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"),
        F.last_day(F.col("l_shipdate").cast("date")).alias("month"), F.col("l_extendedprice").alias("v"),
    )
    out = R.group_statistics(line, ["returnflag", "linestatus", "month"], "v")
    return out.select("returnflag", "linestatus", "month", "n", *[r(c, 4).alias(c) for c in ("median", "lower", "upper", "std", "mad")])


@query(
    "relative_scores",
    "select gvkey, fyear, component, lvl as level, pc as peer_count, round(sc,7) score from rel",
    CTES,
)
def relative_scores(spark, d):
    peers = peer_frame(spark, d)
    out = R.relative_scores(peers, peers, SCORED, "datadate", LEVELS, EVENT, C.MARKET_SCOPE)
    return out.select("gvkey", "fyear", "component", "level", "peer_count", r("score", 7).alias("score"))


@query(
    "peer_fallback_counts",
    "select component, lvl as level, count(*) n from rel group by all",
    CTES,
)
def peer_fallback_counts(spark, d):
    peers = peer_frame(spark, d)
    out = R.relative_scores(peers, peers, SCORED, "datadate", LEVELS, EVENT, C.MARKET_SCOPE)
    return out.groupBy("component", "level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "anchored_scores",
    "select gvkey, fyear, component, rc as reference_count, ry as reference_end_year, round(sc,7) score from anch",
    CTES,
)
def anchored_scores(spark, d):
    out = R.anchored_scores(peer_frame(spark, d), SCORED, EVENT, "datadate")
    return out.select("gvkey", "fyear", "component", "reference_count", "reference_end_year", r("score", 7).alias("score"))


@query(
    "point_in_time_peer_score",
    f"""with m as (select distinct gvkey, month, spend from (select cast(o_custkey as varchar) gvkey, last_day(o_orderdate) as month,
   sum(cast(o_totalprice as decimal(12,2)))::double spend from orders group by 1,2)),
 j as (select m.*, k.fyear, k.formation_date, k.sic2, k.sic1, m.spend / k.at_ v from m join lateral
   (select * from known k where k.gvkey = m.gvkey and k.formation_date <= m.month order by formation_date desc, datadate desc, fyear desc limit 1) k on true
   where (year(m.month)-year(k.formation_date))*12+month(m.month)-month(k.formation_date) between 0 and 18 and k.at_ > 0),
 s2 as ({Q.robust_stats('j', 'month, sic2', 'v')}), s1 as ({Q.robust_stats('j', 'month, sic1', 'v')}), s0 as ({Q.robust_stats('j', 'month', 'v')}),
 sc as (select j.gvkey, j.month, case when s2.n >= 20 then 'sic2' when s1.n >= 20 then 'sic1' else 'market' end as level,
   case when s2.n >= 20 then {Q.score('v', 's2')} when s1.n >= 20 then {Q.score('v', 's1')} else {Q.score('v', 's0')} end score
   from j left join s2 on s2.month=j.month and s2.sic2=j.sic2 left join s1 on s1.month=j.month and s1.sic1=j.sic1
   left join s0 on s0.month=j.month where s2.n >= 20 or s1.n >= 20 or s0.n >= 20),
 rk as (select *, row_number() over (partition by month order by abs(score) desc, gvkey) rn, count(*) over (partition by month) n from sc)
select gvkey, month, level, round(score,7) score, rn <= ceil(0.1::double*n) is_alert from rk""".replace("with m as", "select * from (with m as", 1) + ")",
    CTES,
)
def point_in_time_peer_score(spark, d):
    """Monthly spend over the assets last reported, scored against peers of the month."""
    spend = scan(spark, d, "orders", ["o_custkey", "o_orderdate", "o_totalprice"]).groupBy(
        F.col("o_custkey").cast("string").alias("gvkey"), F.last_day(F.col("o_orderdate").cast("date")).alias("month")
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("spend"))
    base = cut(D.reports(spark, d))
    known = P.report_availability(base, D.filings(spark, d, base))
    joined = P.asof_join(spend, known, "gvkey", "month", "formation_date", ["formation_date", "sic2", "sic1", "at"], ["datadate", "fyear"])
    fresh = S.completed_months("month", "formation_date").between(0, DEFAULT.max_staleness_months)
    peers = cut(joined.filter(fresh & (F.col("at") > 0)).select("gvkey", "month", "sic2", "sic1", (F.col("spend") / F.col("at")).alias("v")))
    scores = cut(R.relative_scores(peers, peers, ["v"], "month", LEVELS, ["gvkey", "month"]))
    flagged = O.top_fraction(scores, ["month"], "score", "gvkey", 0.1, "is_alert")
    return flagged.select("gvkey", "month", "level", r("score", 7).alias("score"), "is_alert")


@query(
    "impute_from_peers",
    """select gvkey, fyear, round(coalesce(v, m2, m1, m0),9) as imputed,
 case when v is not null then 'observed' when m2 is not null then 'sic2' when m1 is not null then 'sic1' when m0 is not null then 'market' else 'unavailable' end imputation_level,
 case when v is not null then null when m2 is not null then n2 when m1 is not null then n1 else n0 end imputation_peer_count
from (select c.gvkey, c.fyear, rd_intensity_observed v,
  case when a.n >= 20 then a.m end m2, a.n n2, case when b.n >= 20 then b.m end m1, b.n n1, case when z.n >= 20 then z.m end m0, z.n n0
 from comp c left join (select fyear, sic2, count(rd_intensity_observed) n, median(rd_intensity_observed) m from comp group by 1,2) a on a.fyear=c.fyear and a.sic2=c.sic2
 left join (select fyear, sic1, count(rd_intensity_observed) n, median(rd_intensity_observed) m from comp group by 1,2) b on b.fyear=c.fyear and b.sic1=c.sic1
 left join (select fyear, count(rd_intensity_observed) n, median(rd_intensity_observed) m from comp group by 1) z on z.fyear=c.fyear)""",
    CTES,
)
def impute_from_peers(spark, d):
    out = R.impute_from_peers(cut(report_components(spark, d)), "rd_intensity_observed", "datadate", LEVELS)
    return out.select("gvkey", "fyear", r("rd_intensity_observed_peer_imputed", 9).alias("imputed"), "imputation_level", "imputation_peer_count")


_AX = ", ".join(f"round({a},6) {a}, {a}_component_count" for a in AXES)


@query("relative_axes", f"select gvkey, fyear, {_AX} from raxes", CTES)
def relative_axes_query(spark, d):
    out = relative_axes(spark, d)
    return out.select("gvkey", "fyear", *[x for a in AXES for x in (r(a).alias(a), F.col(f"{a}_component_count"))])


@query("anchored_axes", f"select gvkey, fyear, {_AX} from aaxes", CTES)
def anchored_axes_query(spark, d):
    out = anchored_axes(spark, d)
    return out.select("gvkey", "fyear", *[x for a in AXES for x in (r(a).alias(a), F.col(f"{a}_component_count"))])


@query(
    "axis_variants",
    """select gvkey, fyear, round(case when industry_sales_hhi is not null and log_active_firm_count is not null
  then (-industry_sales_hhi-log_active_firm_count)/2 end,6) hhi_reversed,
 round(case when (rd_intensity_zero is not null)::int+(capitalized_rnd_stock_assets is not null)::int+(rnd_positive_share_3y is not null)::int >= 2
  then (coalesce(rd_intensity_zero,0)+coalesce(capitalized_rnd_stock_assets,0)+coalesce(rnd_positive_share_3y,0)) /
  ((rd_intensity_zero is not null)::int+(capitalized_rnd_stock_assets is not null)::int+(rnd_positive_share_3y is not null)::int) end,6) rd_imputed
from (select gvkey, fyear, max(sc) filter (component='industry_sales_hhi') industry_sales_hhi, max(sc) filter (component='log_active_firm_count') log_active_firm_count,
 max(sc) filter (component='rd_intensity_zero') rd_intensity_zero, max(sc) filter (component='capitalized_rnd_stock_assets') capitalized_rnd_stock_assets,
 max(sc) filter (component='rnd_positive_share_3y') rnd_positive_share_3y from anch group by 1,2)""",
    CTES,
)
def axis_variants(spark, d):
    scores = R.anchored_scores(peer_frame(spark, d), SCORED, EVENT, "datadate")
    wide = A.pivot_scores(scores, EVENT, SCORED, "").withColumn("rd_intensity_peer_imputed", F.col("rd_intensity_zero"))
    out = A.axis_variants(wide)
    return out.select(
        "gvkey", "fyear", r("competitive_defensibility_hhi_reversed").alias("hhi_reversed"),
        r("innovation_intensity_peer_imputed").alias("rd_imputed"),
    )


CTES["levels"] = """select a.gvkey, a.datadate, a.fyear, case when rn >= 4 then rs/rn end rl, case when an >= 4 then asum/an end al
from (select gvkey, datadate, fyear, %s rn, %s rs from raxes) a join (select gvkey, datadate, fyear, %s an, %s asum from aaxes) b using (gvkey, datadate, fyear)""" % (
    " + ".join(f"({a} is not null)::int" for a in AXES), " + ".join(f"coalesce({a},0)" for a in AXES),
    " + ".join(f"({a} is not null)::int" for a in AXES), " + ".join(f"coalesce({a},0)" for a in AXES),
)
CTES["blend"] = """select *, case when rl is null then al when al is null then rl else (rl+al)/2 end bl,
 lag(case when rl is null then al when al is null then rl else (rl+al)/2 end) over w pl, coalesce(fyear - lag(fyear) over w = 1, false) c1
 from levels window w as (partition by gvkey order by datadate, fyear)"""


def proxy_levels(spark, d):
    """Axis levels of both spaces, written once for the phases that follow."""
    peers = peer_frame(spark, d)
    rel = relative_axes(spark, d, "rel_", peers).select(*EVENT, *[f"rel_{a}" for a in AXES])
    anc = anchored_axes(spark, d, "anch_", peers).select(*EVENT, *[f"anch_{a}" for a in AXES])
    return cut(A.axis_levels(rel.join(anc, EVENT), [f"rel_{a}" for a in AXES], [f"anch_{a}" for a in AXES]))


@query("axis_levels", "select gvkey, fyear, round(rl,6) relative, round(al,6) anchored, round(bl,6) blended from blend", CTES)
def axis_levels(spark, d):
    return proxy_levels(spark, d).select(
        "gvkey", "fyear", r("relative_axis_level").alias("relative"), r("anchored_axis_level").alias("anchored"),
        r("blended_axis_level").alias("blended"),
    )


CTES["innov"] = """select b.gvkey, b.datadate, b.fyear, b.bl, case when b.c1 and b.pl is not null and b.bl is not null and s.n >= 100 and s.yrs >= 2
  then b.bl - (s.my - s.slope*s.mx) - s.slope*b.pl end innovation
from blend b left join (select y.fyear, count(*) n, count(distinct t.fyear) yrs, avg(t.bl) my, avg(t.pl) mx,
   least(greatest(regr_slope(t.bl, t.pl),0::double),1::double) slope
   from (select distinct fyear from blend) y join blend t on t.fyear < y.fyear and t.c1 and t.pl is not null and t.bl is not null group by 1) s on s.fyear = b.fyear"""


@query("expanding_innovation", "select gvkey, fyear, round(innovation,6) innovation from innov", CTES)
def expanding_innovation(spark, d):
    out = A.expanding_innovation(proxy_levels(spark, d), "blended_axis_level", minimum_transitions=100)
    return out.select("gvkey", "fyear", r("blended_axis_innovation").alias("innovation"))


@query(
    "cell_occupancy",
    """select cell, count(*) n, round(count(*)/sum(count(*)) over (),8) share from (select %s cell from raxes) group by 1"""
    % " || ".join(f"case when {a} is null then '1' when {a} < -0.5 then '0' when {a} > 0.5 then '2' else '1' end" for a in AXES),
    CTES,
)
def cell_occupancy(spark, d):
    cells = relative_axes(spark, d).select(S.cell_code(AXES).alias("cell"))
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total)).select("cell", "n", r(F.col("n") / F.col("t"), 8).alias("share"))


@query(
    "axis_mean_by_decade",
    "select cast(floor(fyear/10)*10 as int) as decade, " + ", ".join(f"round(avg({a}),6) {a}" for a in AXES) + " from raxes group by 1",
    CTES,
)
def axis_mean_by_decade(spark, d):
    return relative_axes(spark, d).groupBy(S.decade("fyear").alias("decade")).agg(*[r(F.avg(a)).alias(a) for a in AXES])


@query(
    "largest_cells",
    """select * from (select cell, count(*) n from (select %s cell from raxes) group by 1 order by n desc, cell limit 40)"""
    % " || ".join(f"case when {a} is null then '1' when {a} < -0.5 then '0' when {a} > 0.5 then '2' else '1' end" for a in AXES),
    CTES,
)
def largest_cells(spark, d):
    """The 40 most occupied cells: a top-k report."""
    cells = relative_axes(spark, d).groupBy(S.cell_code(AXES).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return cells.orderBy(F.desc("n"), "cell").limit(40)


@query(
    "axis_gate",
    """select (select count(*) from rel) relative_rows, (select count(*) from anch) anchored_rows, (select count(*) from rel where abs(sc) > 5) + (select count(*) from anch where abs(sc) > 5) beyond_clip,
 (select count(*) from anch where ry >= fyear) late_anchor, (select count(*) from anch where sc is not null and rc < 100) thin_anchor, (select count(*) from rel where pc < 20) thin_peers""",
    CTES,
)
def axis_gate(spark, d):
    """Violation counts of the score phase: clip bound, prior-year anchors, reference sizes."""
    peers = peer_frame(spark, d)
    bad = lambda c: F.count(F.when(c, 1))
    rel = R.relative_scores(peers, peers, SCORED, "datadate", LEVELS, EVENT, C.MARKET_SCOPE).agg(
        F.count(F.lit(1)).alias("relative_rows"), bad(F.abs("score") > 5).alias("__a"), bad(F.col("peer_count") < 20).alias("thin_peers")
    )
    anc = R.anchored_scores(peers, SCORED, EVENT, "datadate").agg(
        F.count(F.lit(1)).alias("anchored_rows"), bad(F.abs("score") > 5).alias("__b"), bad(F.col("reference_end_year") >= F.col("fyear")).alias("late_anchor"),
        bad(F.col("score").isNotNull() & (F.col("reference_count") < 100)).alias("thin_anchor"),
    )
    return rel.join(anc).select("relative_rows", "anchored_rows", (F.col("__a") + F.col("__b")).alias("beyond_clip"), "late_anchor", "thin_anchor", "thin_peers")


@query(
    "extreme_examples",
    """select 'largest' kind, gvkey, fyear, round(sale,2) sale from (select * from cand order by sale desc, gvkey, fyear limit 1)
 union all select 'smallest', gvkey, fyear, round(sale,2) from (select * from cand order by sale, gvkey desc, fyear desc limit 1)""",
    {**CTES, "cand": "select r.* from reports r join (select gvkey from reports group by 1 having count(*) >= 3) g on g.gvkey=r.gvkey where r.sale >= (select median(sale) from reports)"},
)
def extreme_examples(spark, d):
    """Largest and smallest report of firms with three reports and at least median sales."""
    base = cut(D.reports(spark, d).select("gvkey", "fyear", "sale"))
    often = base.groupBy("gvkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("gvkey")
    middle = O.quantiles(base.withColumn("one", F.lit(1)), ["one"], "sale", {"m": 0.5}).select("m")
    fit = base.join(often, "gvkey", "left_semi").join(F.broadcast(middle)).filter(F.col("sale") >= F.col("m")).drop("m")
    top = fit.orderBy(F.desc("sale"), "gvkey", "fyear").limit(1).select(F.lit("largest").alias("kind"), "*")
    low = fit.orderBy("sale", F.desc("gvkey"), F.desc("fyear")).limit(1).select(F.lit("smallest").alias("kind"), "*")
    return top.unionByName(low).withColumn("sale", r("sale", 2))
