"""Availability, universe, links, as-of joins and the firm-month panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitscape.functions import scalars as S
from pitscape.operators import panel as P
from pitscape.plans.registry import query, r
from pitscape.session import stored
from pitscape.sources import derived as D
from pitscape.sources.tables import scan

CTES = {
    "avail": """
select *, case when sec_ok then 'sec_filing_timestamp' when rdq_ok then 'rdq' else 'datadate_plus_180d' end availability_source,
  case when sec_ok then 'high' when rdq_ok then 'medium' else 'low' end availability_confidence,
  (filing_timestamp is not null and not sec_ok) sec_invalid, (rdq is not null and not rdq_ok) rdq_invalid,
  case when cast(av as date) < last_day(av) then last_day(av) else last_day(last_day(av) + interval 1 day) end formation_date
from (select *, coalesce(filing_timestamp >= datadate, false) sec_ok, coalesce(rdq >= datadate, false) rdq_ok,
  case when coalesce(filing_timestamp >= datadate, false) then filing_timestamp
       when coalesce(rdq >= datadate, false) then rdq::timestamp else (datadate + 180)::timestamp end av
  from reports left join filings using (gvkey, datadate, fyear))
""",
    "known": "select *, row_number() over (partition by gvkey order by formation_date, datadate, fyear) reporting_history from avail",
    "compounded": """
select m.*, d.dlret, d.permno is not null has_delist,
  coalesce((1+ret)*(1+dlret)-1, ret, dlret) total_return, d.permno is not null and dlret is null delist_return_missing
from months m left join delistings d on d.permno = m.permno and last_day(d.dlstdt) = m.date
""",
    "flagged": """
select *, shrcd in (10,11) c1, exchcd in (1,2,3) c2, abs(prc) > 0 c3, market_cap_millions > 0 c4, abs(prc) >= 1 c5,
  market_cap_millions >= 10 c6, vol >= 100 c7 from compounded
""",
    "universe": """
select f.*, false exit_override from flagged f where c1 and c2 and c3 and c4 and c5 and c6 and c7
union all
select f.*, true from flagged f
where not (c1 and c2 and c3 and c4 and c5 and c6 and c7) and has_delist and exists (
  select 1 from flagged g where g.permno = f.permno and last_day(g.date + interval 1 day) = f.date
    and g.c1 and g.c2 and g.c3 and g.c4 and g.c5 and g.c6 and g.c7)
""",
    "mapped": """
select permno, date, gvkey, linkdt, linkenddt, linktype, linkprim from (
  select m.permno, m.date, l.*, row_number() over (partition by m.permno, m.date order by
     case linkprim when 'P' then 0 else 10 end + case linktype when 'LC' then 0 when 'LU' then 1 else 2 end, linkdt, gvkey) rn
  from universe m join links l on l.lpermno = m.permno and m.date between l.linkdt and coalesce(l.linkenddt, date '9999-12-31'))
where rn = 1
""",
    "linked": "select u.*, m.gvkey from universe u join mapped m on m.permno = u.permno and m.date = u.date",
    "joined_reports": """
select l.permno, l.date, l.gvkey, l.total_return, l.market_cap_millions, k.datadate, k.fyear, k.formation_date,
  k.reporting_history, k.sic2, k.sic1, k.sale, k.at_, k.oiadp, k.cogs,
  (year(l.date)-year(k.formation_date))*12 + month(l.date)-month(k.formation_date) stale
from linked l left join lateral (
  select * from known k where k.gvkey = l.gvkey and k.formation_date <= l.date
  order by formation_date desc, datadate desc, fyear desc limit 1) k on true
""",
    "panel": "select * from joined_reports where formation_date is not null and reporting_history >= 1 and stale between 0 and 18",
}


def _known(spark, d):
    base = D.reports(spark, d)
    return P.report_history(P.report_availability(base, D.filings(spark, d, base)))


#: What availability and filings of a report are made from, and the code by which the reports of a customer that is listed twice differ.
DATING = ["gvkey", "datadate", "fyear", "rdq", "first_order", "last_order", "n_orders", "sich"]


def build_panel(spark, d, filtered=True, columns=None):
    """The raw-table stand-ins are written once; the panel is one lazy plan over them. ``columns``: those of the report that it is asked for (default: all)."""
    base = D.reports(spark, d)
    if columns is not None:
        base = base.select(*dict.fromkeys([*DATING, *columns]))
        columns = ["sich", *columns]
    base = stored(base)
    return P.firm_month_panel(
        stored(D.security_months(spark, d)), D.delistings(spark, d), D.links(spark, d), base, D.filings(spark, d, base), filtered=filtered, columns=columns
    )


@query(
    "report_availability",
    """select gvkey, fyear, cast(av as date) available_day, availability_source, availability_confidence,
       sec_invalid, rdq_invalid, formation_date from avail""",
    CTES,
)
def report_availability(spark, d):
    base = D.reports(spark, d)
    return P.report_availability(base, D.filings(spark, d, base)).select(
        "gvkey", "fyear", F.col("availability_date").cast("date").alias("available_day"), "availability_source",
        "availability_confidence", "sec_invalid", "rdq_invalid", "formation_date",
    )


@query(
    "strict_month_end",
    """select l_shipdate::date as day, case when l_shipdate::date < last_day(l_shipdate) then last_day(l_shipdate)
         else last_day(last_day(l_shipdate) + interval 1 day) end as month_end_after,
       last_day(l_shipdate) as month_end, count(*) as n from lineitem group by 1,2,3""",
)
def strict_month_end(spark, d):
    line = scan(spark, d, "lineitem", ["l_shipdate"]).groupBy(F.col("l_shipdate").cast("date").alias("day")).count()
    return line.select(
        "day", S.strictly_later_month_end("day").alias("month_end_after"), S.month_end("day").alias("month_end"),
        F.col("count").alias("n"),
    )


@query(
    "report_staleness_months",
    "select gvkey, fyear, (year(formation_date)-year(datadate))*12+month(formation_date)-month(datadate) as months from avail",
    CTES,
)
def report_staleness_months(spark, d):
    return _known(spark, d).select("gvkey", "fyear", S.completed_months("formation_date", "datadate").alias("months"))


@query(
    "compound_exit_returns",
    """select permno, date, round(total_return,8) total_return, has_delist, delist_return_missing from compounded""",
    CTES,
)
def compound_exit_returns(spark, d):
    out = P.compound_exit_returns(D.security_months(spark, d), D.delistings(spark, d))
    return out.select("permno", "date", r("total_return", 8).alias("total_return"), "has_delist", "delist_return_missing")


@query("universe_filter", "select permno, date, exit_override, round(market_cap_millions,6) cap from universe", CTES)
def universe_filter(spark, d):
    out = P.apply_universe(P.compound_exit_returns(D.security_months(spark, d), D.delistings(spark, d)))
    return out.select("permno", "date", "exit_override", r("market_cap_millions", 6).alias("cap"))


@query(
    "universe_waterfall",
    """with k as (select count(*) s0, count(*) filter (c1) s1, count(*) filter (c1 and c2) s2, count(*) filter (c1 and c2 and c3) s3,
  count(*) filter (c1 and c2 and c3 and c4) s4, count(*) filter (c1 and c2 and c3 and c4 and c5) s5,
  count(*) filter (c1 and c2 and c3 and c4 and c5 and c6) s6, count(*) filter (c1 and c2 and c3 and c4 and c5 and c6 and c7) s7,
  (select count(*) from universe) s8 from flagged)
select 0 stage_order, 'raw' stage, s0 rows_remaining, 0 rows_removed from k union all
select 1,'share_code',s1,s0-s1 from k union all select 2,'exchange',s2,s1-s2 from k union all
select 3,'valid_price',s3,s2-s3 from k union all select 4,'valid_cap',s4,s3-s4 from k union all
select 5,'min_price',s5,s4-s5 from k union all select 6,'min_cap',s6,s5-s6 from k union all
select 7,'min_volume',s7,s6-s7 from k union all select 8,'exit_override',s8,s7-s8 from k""".replace("with k as", "select * from (with k as", 1) + ")",
    CTES,
)
def universe_waterfall(spark, d):
    return P.universe_waterfall(P.compound_exit_returns(D.security_months(spark, d), D.delistings(spark, d)))


@query("prior_month_exit_override", "select permno, date from universe where exit_override", CTES)
def prior_month_exit_override(spark, d):
    out = P.apply_universe(P.compound_exit_returns(D.security_months(spark, d), D.delistings(spark, d)))
    return out.filter("exit_override").select("permno", "date")


@query("dated_links", "select permno, date, gvkey, linkdt, linkenddt, linktype, linkprim from mapped", CTES)
def dated_links(spark, d):
    universe = P.apply_universe(P.compound_exit_returns(D.security_months(spark, d), D.delistings(spark, d)))
    return P.map_links(universe, D.links(spark, d))


@query(
    "exit_link_join",
    """select distinct d.permno, d.dlstdt, l.gvkey from delistings d join links l on l.lpermno = d.permno
       and d.dlstdt between l.linkdt and coalesce(l.linkenddt, date '9999-12-31')""",
)
def exit_link_join(spark, d):
    return P.dated_link_join(D.delistings(spark, d).select("permno", "dlstdt"), D.links(spark, d), "dlstdt")


@query(
    "asof_latest_report",
    """select permno, date, gvkey, datadate, fyear, formation_date from joined_reports""",
    CTES,
)
def asof_latest_report(spark, d):
    return build_panel(spark, d, filtered=False, columns=[]).select("permno", "date", "gvkey", "datadate", "fyear", "formation_date")


@query(
    "asof_order_per_shipment",
    """with o as (select o_custkey, cast(o_orderdate as date) d, max(o_orderkey) k from orders group by 1,2)
select l.l_suppkey as custkey, cast(l.l_shipdate as date) as day, count(*) as n, o.d as order_day, o.k as order_key
from lineitem l asof left join o on o.o_custkey = l.l_suppkey and o.d <= cast(l.l_shipdate as date) group by 1,2,4,5""",
)
def asof_order_per_shipment(spark, d):
    """Every shipment against the latest order of the customer with the supplier's number."""
    line = scan(spark, d, "lineitem", ["l_suppkey", "l_shipdate"]).select(
        F.col("l_suppkey").alias("custkey"), F.col("l_shipdate").cast("date").alias("day")
    )
    orders = scan(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]).select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderdate").cast("date").alias("order_day"), F.col("o_orderkey").alias("order_key")
    )
    out = P.asof_join(line, orders, "custkey", "day", "order_day", ["order_day", "order_key"], ["order_key"])
    return out.groupBy("custkey", "day", "order_day", "order_key").agg(F.count(F.lit(1)).alias("n"))


@query("report_history_count", "select gvkey, fyear, formation_date, reporting_history from known", CTES)
def report_history_count(spark, d):
    return _known(spark, d).select("gvkey", "fyear", "formation_date", "reporting_history")


@query(
    "firm_month_panel",
    "select permno, date, gvkey, fyear, formation_date, reporting_history, stale, round(total_return,8) total_return from panel",
    CTES,
)
def firm_month_panel(spark, d):
    return build_panel(spark, d, columns=[]).select(
        "permno", "date", "gvkey", "fyear", "formation_date", "reporting_history",
        F.col("staleness_months").alias("stale"), r("total_return", 8).alias("total_return"),
    )


@query(
    "panel_waterfall",
    """select 0 stage_order, 'raw' stage, count(*) rows_remaining, 0 rows_removed from joined_reports
union all select 1, 'matched_report', count(formation_date), count(*)-count(formation_date) from joined_reports
union all select 2, 'minimum_history', count(*) filter (reporting_history >= 1), count(formation_date)-count(*) filter (reporting_history >= 1) from joined_reports
union all select 3, 'fresh_report', (select count(*) from panel), count(*) filter (reporting_history >= 1) - (select count(*) from panel) from joined_reports""",
    CTES,
)
def panel_waterfall(spark, d):
    return P.waterfall(build_panel(spark, d, filtered=False, columns=[]), P.panel_stages())


@query(
    "one_security_per_firm_month",
    """select gvkey, date, permno, round(market_cap_millions,4) cap from (select *, row_number() over
       (partition by gvkey, date order by market_cap_millions desc, permno) rn from panel) where rn = 1""",
    CTES,
)
def one_security_per_firm_month(spark, d):
    panel = build_panel(spark, d, columns=[]).select("permno", "date", "gvkey", "market_cap_millions")
    out = P.one_security_per_firm_month(panel)
    return out.select("gvkey", "date", "permno", r("market_cap_millions", 4).alias("cap"))


@query(
    "first_month_per_report",
    """select gvkey, fyear, date as feature_date, permno from (select *, row_number() over
       (partition by gvkey, datadate, fyear order by date, permno) rn from panel) where rn = 1""",
    CTES,
)
def first_month_per_report(spark, d):
    return P.first_month_per_report(build_panel(spark, d, columns=[]).select("permno", "date", *P.REPORT_KEY)).select("gvkey", "fyear", "feature_date", "permno")
