"""SQL of the derived tables, written independently of the Spark derivations."""

from __future__ import annotations

import re

BASE: dict[str, str] = {}

BASE["firms"] = """
select cast(c_custkey as varchar) gvkey, sich, cast(floor(sich/100) as int) sic2,
       cast(floor(sich/1000) as int) sic1, c_acctbal
from (select *, cast((n_regionkey+1)*1000 + floor(c_nationkey/5)*100 + c_nationkey as int) sich
      from customer join nation on c_nationkey = n_nationkey)
"""
BASE["lines"] = """
select *, cast(l_extendedprice as decimal(12,2)) ext, cast(l_quantity as decimal(9,0)) qty,
       cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2)) rebate,
       cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)) taxed
from lineitem
"""
BASE["lbo"] = """
select l_orderkey, sum(ext) ext, sum(qty) qty, sum(rebate) rebate, sum(taxed) taxed,
  sum(ext) filter (l_returnflag='R') ext_r, sum(ext) filter (l_returnflag='N') ext_n,
  sum(ext) filter (l_linestatus='F') ext_f, sum(taxed) filter (l_returnflag='R') tax_r,
  sum(taxed) filter (l_returnflag='A') tax_a, sum(taxed) filter (l_linestatus='O') tax_o,
  sum(rebate) filter (l_returnflag='N') rebate_n, sum(qty) filter (l_linestatus='O') qty_o
from lines group by 1
"""
BASE["reports"] = """
select y.gvkey, make_date(fyear,12,31) datadate, fyear,
  case when n_orders % 3 <> 0 then cast(last_order + 90 as date) end rdq,
  sale, qty*600 cogs, xsga, xad, xrd, dp,
  sale - qty*600 - xsga - ext_r oiadp, sale - qty*600 - xsga - ext_r - dp ib,
  at_, qty*200 ppent, qty_o*300 capx, ext_f*0.2::double dltt, dlc, at_ - ext_n ceq, che, act, lct, ext_f, qty,
  first_order, last_order, n_orders, f.sich, f.sic2, f.sic1
from (
  select cast(o_custkey as varchar) gvkey, cast(year(o_orderdate) as int) fyear,
    coalesce(sum(ext),0)::double sale, coalesce(sum(qty),0)::double qty, coalesce(sum(rebate),0)::double xsga,
    coalesce(sum(taxed),0)::double dp, sum(tax_r)::double xad, sum(tax_a)::double xrd,
    coalesce(sum(ext_r),0)::double ext_r, coalesce(sum(ext_n),0)::double ext_n, coalesce(sum(ext_f),0)::double ext_f,
    coalesce(sum(tax_o),0)::double dlc, coalesce(sum(rebate_n),0)::double che, coalesce(sum(qty_o),0)::double qty_o,
    sum(cast(o_totalprice as decimal(12,2)))::double at_,
    coalesce(sum(cast(o_totalprice as decimal(12,2))) filter (o_orderstatus='O'),0)::double act,
    coalesce(sum(cast(o_totalprice as decimal(12,2))) filter (o_orderstatus='P'),0)::double lct,
    cast(min(o_orderdate) as date) first_order, cast(max(o_orderdate) as date) last_order,
    cast(count(*) as int) n_orders
  from orders left join lbo on o_orderkey = l_orderkey group by 1,2) y
join firms f on f.gvkey = y.gvkey
"""
BASE["filings"] = """
select gvkey, datadate, fyear,
  (case when month(first_order) <= 2 then cast(datadate - 10 as date)
        else cast(datadate + 30 + cast(day(last_order) as int) as date) end)::timestamp + interval 16 hour filing_timestamp
from reports where n_orders >= 2
"""
BASE["delistings"] = """
select s_suppkey permno, cast(date '1998-01-10' + cast(abs(floor(s_acctbal)) % 1200 as int) as date) dlstdt,
  case when s_suppkey % 5 <> 0 then -abs(s_acctbal)/10000 end dlret,
  (['performance_failure','merger','voluntary_administrative','other_unknown'])[cast(s_suppkey % 4 as int)+1] exit_category
from supplier where s_acctbal < 3000
"""
BASE["months"] = """
select m.permno, date, case when n_lines > 1 then rebate/traded*4 - 0.2::double end ret,
  traded/vol/100 prc, 1000.0::double + (m.permno % 97)*100 shrout, vol,
  case when n_lines % 4 <> 0 then traded/vol/100*(1 - rebate/traded/10) end bid,
  case when n_lines % 4 <> 0 then traded/vol/100*(1 + taxed/traded/10) end ask,
  cast(m.permno % 4 + 1 as int) exchcd, cast(m.permno % 3 + 10 as int) shrcd,
  traded/vol/100*(1000.0::double + (m.permno % 97)*100)/1000 market_cap_millions
from (select l_suppkey permno, last_day(l_shipdate) date, sum(ext)::double traded, sum(qty)::double vol,
        sum(rebate)::double rebate, sum(taxed)::double taxed, cast(count(*) as int) n_lines
      from lines group by 1,2) m
left join delistings d on d.permno = m.permno
where d.dlstdt is null or date <= last_day(d.dlstdt)
"""
BASE["links"] = """
select cast(o_custkey as varchar) gvkey, l_suppkey lpermno, make_date(y,1,1) linkdt,
  case when y < 2001 then make_date(y,12,31) end linkenddt,
  (['LC','LU','LS'])[cast((l_suppkey + y) % 3 as int)+1] linktype, case rn when 1 then 'P' else 'C' end linkprim
from (select *, row_number() over (partition by l_suppkey, y order by spend desc, o_custkey desc) rn
      from (select l_suppkey, cast(year(o_orderdate) as int) y, o_custkey, sum(ext) spend
            from lines join orders on l_orderkey = o_orderkey group by 1,2,3))
where rn <= 2
"""
BASE["factors"] = """
select date, r/e*4-0.2::double mkt_excess, rr/er*4-0.2::double smb, ra/ea*4-0.2::double hml, rn/en*4-0.2::double rmw,
  rf_/ef*4-0.2::double cma, t/e-0.04::double mom, 0.001::double + month(date)/10000.0::double rf
from (select last_day(l_shipdate) date, sum(ext)::double e, sum(rebate)::double r, sum(taxed)::double t,
  sum(ext) filter (l_returnflag='R')::double er, sum(rebate) filter (l_returnflag='R')::double rr,
  sum(ext) filter (l_returnflag='A')::double ea, sum(rebate) filter (l_returnflag='A')::double ra,
  sum(ext) filter (l_returnflag='N')::double en, sum(rebate) filter (l_returnflag='N')::double rn,
  sum(ext) filter (l_linestatus='F')::double ef, sum(rebate) filter (l_linestatus='F')::double rf_
  from lines group by 1)
"""
BASE["exits"] = """
select cast(c_custkey as varchar) gvkey, first_observed_date,
  case when c_acctbal < 4000 then cast(last_o + cast(c_custkey % 60 + 5 as int) as date) else last_o end last_observed_date,
  case when c_acctbal < 4000 then cast(last_o + cast(c_custkey % 60 + 5 as int) as date) end exit_date,
  case when c_acctbal < 4000 then
    (['performance_failure','merger','voluntary_administrative','other_unknown'])[cast(c_custkey % 4 as int)+1] end exit_category
from customer join (select o_custkey, cast(min(o_orderdate) as date) first_observed_date, cast(max(o_orderdate) as date) last_o
                    from orders group by 1) on o_custkey = c_custkey
"""
BASE["surface"] = """
select gvkey, datadate, fyear, sich, sic2, sic1, last_day(fd) + case when fd = last_day(fd) then 1 else 0 end fd_probe,
  case when fd < last_day(fd) then last_day(fd) else last_day(cast(last_day(fd) + 1 as date)) end feature_date,
  cast(floor((fyear-1995)/2) as int) fold, h.h horizon_years,
  case h.h when 3 then s3 else pow(s3, 5.0::double/3.0::double) end predicted_survival
from (select *, cast(datadate + n_orders*20 as date) fd,
        1 - least(greatest(ext_f/sale, 0.01::double), 0.99::double) s3 from reports where sale > 0)
cross join (values (3),(5)) h(h)
"""
BASE["signals"] = """
select m.permno || '|' || strftime(m.date,'%Y-%m-%d') || '|' || year(m.date) event_id, cast(m.permno as varchar) gvkey, m.permno,
  m.date feature_date, cast(year(m.date) as int) fold, cast(n_regionkey + 1 as int) sic1, market_cap_millions,
  ret migration_surprise, prc viability_velocity, ln(1+vol) historical_success_density
from months m join supplier on s_suppkey = m.permno join nation on n_nationkey = s_nationkey
where month(m.date) % 3 = 0 and ret is not null
"""
BASE["truth"] = """
select gvkey, datadate, fyear, qty/(n_orders*100) latent_axis_1, case when sale<>0 then xsga/sale end latent_axis_2,
  case when sale<>0 then ext_f/sale end latent_axis_3, case when at_<>0 then capx/at_ end latent_axis_4,
  case when at_<>0 then oiadp/at_ end latent_axis_5, case when at_<>0 then ppent/at_ end latent_axis_6
from reports
"""


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the derived tables it names, in dependency order."""
    known = {**BASE, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in known and word not in ordered and word not in path and _used_as_table(text, word):
                visit(known[word], path + (word,))
                ordered.append(word)

    visit(body, ())
    if not ordered:
        return body
    return "with " + ",\n".join(f"{n} as materialized ({known[n]})" for n in ordered) + "\n" + body


def _used_as_table(text: str, word: str) -> bool:
    return re.search(rf"(from|join)\s+(lateral\s+)?{word}\b|,\s*{word}\s+[a-z]\b", text) is not None
