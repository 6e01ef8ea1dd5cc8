"""Small SQL builders shared by the checks."""

from __future__ import annotations


def robust_stats(source: str, keys: str, value: str, lower: float = 0.01, upper: float = 0.99) -> str:
    return (
        f"select {keys}, count({value}) n, median({value}) median, quantile_cont({value},{lower}::double) lower, "
        f"quantile_cont({value},{upper}::double) upper, stddev_pop({value}) std, mad({value}) mad "
        f"from {source} where {value} is not null group by {keys}"
    )


def score(value: str, s: str = "", clip: float = 5.0) -> str:
    """Robust score from columns n/median/lower/upper/mad/std of alias ``s``."""
    q = f"{s}." if s else ""
    scale = (
        f"case when {q}mad*1.4826::double > 1e-12 then {q}mad*1.4826::double when {q}std > 1e-12 then {q}std end"
    )
    raw = f"(least(greatest({value}, {q}lower), {q}upper) - {q}median) / ({scale})"
    return (
        f"case when {value} is null or {q}n is null then null when ({scale}) is null then 0.0::double "
        f"else least(greatest({raw}, -{clip}::double), {clip}::double) end"
    )


def avg_rank(value: str, partition: str = "") -> str:
    p = f"partition by {partition} " if partition else ""
    q = f"partition by {partition + ', ' if partition else ''}{value}"
    return f"(rank() over ({p}order by {value}) + (count(*) over ({q}) - 1) / 2.0::double)"


COMPONENT_SQL = """
select gvkey, datadate, fyear, sich, sic2, sic1, sale, at_, n_orders, first_order, last_order, rdq,
  case when sale > 0 then (sale-cogs)/sale end gross_margin,
  case when r3 and sale > 0 and sale3 > 0 then pow(sale/sale3, 1.0::double/3) - 1 end revenue_cagr_3y,
  case when r2 and gm_n = 3 then gm_std end gross_margin_volatility_3y,
  case when sale > 0 then (case when xrd >= 0 then xrd end)/sale end rd_intensity_observed,
  case when sale > 0 then x/sale end rd_intensity_zero,
  cast(xrd is null as int) rd_missing_indicator,
  case when at_ > 0 then stock/at_ end capitalized_rnd_stock_assets,
  case when r2 then pos_share end rnd_positive_share_3y,
  case when r1 and xsga1 > 0 then (sale-cogs)/xsga1 end gross_profit_lag_sga,
  case when r1 and xsga1 > 0 then (sale-sale1)/xsga1 end revenue_change_lag_sga,
  case when sale > 0 then xad/sale end advertising_intensity,
  case when sale > 0 then xsga/sale end sga_intensity,
  case when sale > 0 then oiadp/sale end operating_margin,
  case when r1 and inv1 > 0 then oiadp*0.75::double/inv1 end cash_adjusted_roic,
  case when r1 and at1 > 0 then (sale-cogs)/at1 end gross_profitability_lag_assets,
  case when r1 and at1 > 0 then (ib+dp-capx)/at1 end cash_conversion_lag_assets,
  case when r1 and at1 > 0 then sale/at1 end asset_turnover,
  case when at_ > 0 then 1-ppent/at_ end asset_lightness,
  case when r1 and abs(sale-sale1) >= abs(sale1)*0.01::double and sale<>sale1 then (oiadp-oiadp1)/(sale-sale1) end incremental_operating_margin,
  case when sale > 0 then capx/sale end capex_intensity,
  case when r1 and at1 > 0 then (at_-at1)/at1 end asset_growth,
  case when r1 then sale - sale1 end d_sale, oiadp, ppent, capx, ceq, qty, ext_f, xsga, dltt, dlc, che, act, lct
from (select *, case when xrd >= 0 then xrd else 0 end x,
  coalesce(fyear - lag(fyear,1) over w = 1, false) r1, coalesce(fyear - lag(fyear,2) over w = 2, false) r2,
  coalesce(fyear - lag(fyear,3) over w = 3, false) r3, lag(sale,1) over w sale1, lag(sale,3) over w sale3,
  lag(xsga) over w xsga1, lag(at_) over w at1, lag(oiadp) over w oiadp1, lag(dltt+dlc+ceq-che) over w inv1,
  stddev_pop(case when sale > 0 then (sale-cogs)/sale end) over (partition by gvkey order by fyear rows 2 preceding) gm_std,
  count(case when sale > 0 then 1 end) over (partition by gvkey order by fyear rows 2 preceding) gm_n,
  avg(case when xrd > 0 then 1.0::double else 0.0::double end) over (partition by gvkey order by fyear rows 2 preceding) pos_share,
  (select sum((case when q.xrd >= 0 then q.xrd else 0 end) * pow(0.8::double, t.fyear - q.fyear)) from reports q
    where q.gvkey = t.gvkey and q.fyear <= t.fyear) stock
  from reports t window w as (partition by gvkey order by fyear))
"""
COMPONENTS = (
    "gross_margin revenue_cagr_3y gross_margin_volatility_3y rd_intensity_zero capitalized_rnd_stock_assets "
    "rnd_positive_share_3y gross_profit_lag_sga revenue_change_lag_sga advertising_intensity operating_margin "
    "cash_adjusted_roic gross_profitability_lag_assets asset_turnover asset_lightness "
    "incremental_operating_margin capex_intensity"
).split()


def unpivot(source: str, keep: str, columns: list[str]) -> str:
    parts = [f"select {keep}, '{c}' component, {c} v from {source} where {c} is not null" for c in columns]
    return " union all ".join(parts)
