"""Accounting components of a report from its own and the firm's earlier reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitscape.functions import scalars as S
from pitscape.params import DEFAULT, Params

# Axis -> components, in catalogue order.
AXIS_COMPONENTS = {
    "demand_strength": ("gross_margin", "revenue_cagr_3y", "gross_margin_volatility_3y"),
    "competitive_defensibility": ("industry_sales_hhi", "log_active_firm_count"),
    "innovation_intensity": ("rd_intensity_zero", "capitalized_rnd_stock_assets", "rnd_positive_share_3y"),
    "go_to_market": ("gross_profit_lag_sga", "revenue_change_lag_sga", "advertising_intensity"),
    "unit_economics": ("operating_margin", "cash_adjusted_roic", "gross_profitability_lag_assets"),
    "scalability": ("asset_turnover", "asset_lightness", "incremental_operating_margin", "capex_intensity"),
}
AXIS_MINIMUM = {
    "demand_strength": 2,
    "competitive_defensibility": 2,
    "innovation_intensity": 2,
    "go_to_market": 2,
    "unit_economics": 3,
    "scalability": 3,
}
NEGATIVE = ("gross_margin_volatility_3y", "log_active_firm_count", "capex_intensity")
MARKET_SCOPE = ("industry_sales_hhi", "log_active_firm_count")
OUTSIDE_COMPOSITES = ("cash_conversion_lag_assets",)
REPORT_COMPONENTS = tuple(
    c for axis in AXIS_COMPONENTS.values() for c in axis if c not in MARKET_SCOPE
) + OUTSIDE_COMPOSITES
DIAGNOSTICS = ("rd_intensity_observed", "rd_missing_indicator", "sga_intensity")


def accounting_components(reports: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Add every report-level component and diagnostic.

    One row per firm and fiscal year is required, so each firm window spans at most the
    calendar; a repeated year stops the job.
    """
    years = W.partitionBy("gvkey").orderBy("fyear")
    three = years.rowsBetween(-2, 0)
    so_far = years.rowsBetween(W.unboundedPreceding, 0)
    lag = lambda c, k=1: F.lag(c, k).over(years)

    positive_rd = F.when(F.col("xrd") >= 0, F.col("xrd"))
    rd = F.coalesce(positive_rd, F.lit(0.0))
    keep = F.lit(1.0 - p.rnd_depreciation)
    # s_t = x_t + s_(t-1) * keep^gap, unrolled: keep^(y-y0) * sum(x * keep^-(y-y0))
    age = F.col("fyear") - F.first("fyear").over(so_far)
    base = (
        reports.withColumn(
            "__once",
            F.when(lag("fyear") == F.col("fyear"), F.raise_error(F.concat(F.lit("two reports in one fiscal year for firm "), "gvkey")).cast("int")),
        )
        .withColumn("__age", age.cast("double"))
        .withColumn("__run1", F.coalesce(F.col("fyear") - lag("fyear") == 1, F.lit(False)))
        .withColumn("__run2", F.coalesce(F.col("fyear") - lag("fyear", 2) == 2, F.lit(False)))
        .withColumn("__run3", F.coalesce(F.col("fyear") - lag("fyear", 3) == 3, F.lit(False)))
        .withColumn("__gp", F.col("sale") - F.col("cogs"))
        .withColumn("gross_margin", S.positive_ratio("__gp", "sale"))
        .withColumn("__xrd_obs", positive_rd)
        .withColumn("__xrd", rd)
        .withColumn("__invested", F.col("dltt") + F.col("dlc") + F.col("ceq") - F.col("che"))
        .filter(F.col("__once").isNull())
    )
    stock = F.pow(keep, F.col("__age")) * F.sum(F.col("__xrd") * F.pow(keep, -F.col("__age"))).over(so_far)
    d_sale, d_oiadp = F.col("sale") - lag("sale"), F.col("oiadp") - lag("oiadp")
    material = (F.abs(d_sale) >= F.abs(lag("sale")) * 0.01) & (d_sale != 0)
    gate = lambda run, value: F.when(F.col(run), value)
    out = {
        "revenue_cagr_3y": gate(
            "__run3", F.when((F.col("sale") > 0) & (lag("sale", 3) > 0), F.pow(F.col("sale") / F.when(lag("sale", 3) > 0, lag("sale", 3)), 1.0 / 3.0) - 1)
        ),
        "gross_margin_volatility_3y": gate(
            "__run2", F.when(F.count("gross_margin").over(three) == 3, F.stddev_pop("gross_margin").over(three))
        ),
        "rd_intensity_observed": S.positive_ratio("__xrd_obs", "sale"),
        "rd_intensity_zero": S.positive_ratio("__xrd", "sale"),
        "rd_missing_indicator": F.col("xrd").isNull().cast("int"),
        "capitalized_rnd_stock_assets": S.positive_ratio(stock, "at"),
        "rnd_positive_share_3y": gate("__run2", F.avg((F.col("__xrd") > 0).cast("double")).over(three)),
        "gross_profit_lag_sga": gate("__run1", S.positive_ratio(F.col("__gp"), lag("xsga"))),
        "revenue_change_lag_sga": gate("__run1", S.positive_ratio(d_sale, lag("xsga"))),
        "advertising_intensity": S.positive_ratio("xad", "sale"),
        "sga_intensity": S.positive_ratio("xsga", "sale"),
        "operating_margin": S.positive_ratio("oiadp", "sale"),
        "cash_adjusted_roic": gate("__run1", S.positive_ratio(F.col("oiadp") * (1 - p.tax_rate), lag("__invested"))),
        "gross_profitability_lag_assets": gate("__run1", S.positive_ratio(F.col("__gp"), lag("at"))),
        "cash_conversion_lag_assets": gate("__run1", S.positive_ratio(F.col("ib") + F.col("dp") - F.col("capx"), lag("at"))),
        "asset_turnover": gate("__run1", S.positive_ratio(F.col("sale"), lag("at"))),
        "asset_lightness": 1 - S.positive_ratio("ppent", "at"),
        "incremental_operating_margin": gate("__run1", F.when(material, S.finite_ratio(d_oiadp, d_sale))),
        "capex_intensity": S.positive_ratio("capx", "sale"),
    }
    return base.withColumns({k: S.finite(v) if k != "rd_missing_indicator" else v for k, v in out.items()}).drop(
        "__once", "__age", "__run1", "__run2", "__run3", "__gp", "__xrd_obs", "__xrd", "__invested"
    )


def industry_components(peers: DataFrame, date: str = "date", industry: str = "sic2") -> DataFrame:
    """Sales concentration and log firm count of each industry at each date.

    Concentration is sum(x^2) / sum(x)^2 over positive sales, one map-side aggregate;
    an industry without positive sales has 0, an unknown industry has none.
    """
    x = F.when(F.col("sale") > 0, F.col("sale"))
    table = peers.filter(F.col(industry).isNotNull()).groupBy(date, industry).agg(
        F.coalesce(F.try_divide(F.sum(x * x), F.sum(x) * F.sum(x)), F.lit(0.0)).alias("industry_sales_hhi"),
        F.log1p(F.countDistinct("gvkey").cast("double")).alias("log_active_firm_count"),
    )
    return peers.join(table, [date, industry], "left")


def asset_growth(reports: DataFrame) -> DataFrame:
    """Growth of assets over the previous report, only across consecutive years."""
    w = W.partitionBy("gvkey").orderBy("datadate")
    before = F.lag("at").over(w)
    consecutive = F.col("fyear") - F.lag("fyear").over(w) == 1
    return reports.withColumn("asset_growth", F.when(consecutive, S.positive_ratio(F.col("at") - before, before)))
