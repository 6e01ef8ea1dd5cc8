"""The point-in-time tables, derived from the star-schema tables by Spark.

Customers stand for firms (one annual report per customer and year), suppliers for
securities (one row per supplier and month).  Money is rounded as a decimal and summed as whole
cents (products of money and a share: hundredths of a cent), so a derived table is identical however
its input is partitioned.  A sum beyond 9e18 units stops the job.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscape.functions import scalars as S
from pitscape.sources.tables import scan


def _hundredths(column: str, kind: str) -> Column:
    return (F.col(column).cast(kind) * 100).cast("long")


def _money(column: str) -> Column:
    """Cents."""
    return _hundredths(column, "decimal(12,2)")


def _share(column: str) -> Column:
    """Hundredths; times ``_money`` they make hundredths of a cent."""
    return _hundredths(column, "decimal(4,2)")


def _units(column: str) -> Column:
    return F.col(column).cast("decimal(9,0)").cast("long")


def _double(total: Column, places: int) -> Column:
    """The double next to a whole number of 10 ** -places; numbers that a double cannot hold go by a decimal."""
    exact = total.cast("double") / float(10**places)
    return F.when(F.abs(total) < 2**53, exact).otherwise((total.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-places))).cast("double"))


def _sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def firms(spark: SparkSession, d: str) -> DataFrame:
    customer = scan(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    nation = scan(spark, d, "nation", ["n_nationkey", "n_regionkey"])
    sich = (F.col("n_regionkey") + 1) * 1000 + F.floor(F.col("c_nationkey") / 5) * 100 + F.col("c_nationkey")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("sich", sich.cast("int"))
    sic2, sic1 = S.industry_pair("sich")
    return joined.select(
        F.col("c_custkey").cast("string").alias("gvkey"), "sich", sic2.alias("sic2"), sic1.alias("sic1"), "c_acctbal"
    )


def _lines_by_order(spark: SparkSession, d: str) -> DataFrame:
    line = scan(
        spark, d, "lineitem",
        ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"],
    )
    whole = line.select(
        "l_orderkey", "l_returnflag", "l_linestatus", _money("l_extendedprice").alias("ext"), _units("l_quantity").alias("qty"),
        _share("l_tax").alias("tax"), _share("l_discount").alias("discount"),
    )
    ext, qty = F.col("ext"), F.col("qty")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    taxed, rebate = ext * F.col("tax"), ext * F.col("discount")
    return whole.groupBy("l_orderkey").agg(
        F.sum(ext).alias("ext"),
        F.sum(qty).alias("qty"),
        F.sum(rebate).alias("rebate"),
        F.sum(taxed).alias("taxed"),
        _sum_if(flag == "R", ext).alias("ext_r"),
        _sum_if(flag == "N", ext).alias("ext_n"),
        _sum_if(status == "F", ext).alias("ext_f"),
        _sum_if(flag == "R", taxed).alias("tax_r"),
        _sum_if(flag == "A", taxed).alias("tax_a"),
        _sum_if(status == "O", taxed).alias("tax_o"),
        _sum_if(flag == "N", rebate).alias("rebate_n"),
        _sum_if(status == "O", qty).alias("qty_o"),
    )


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Annual report per firm; lines are combined per order before they meet the orders."""
    orders = scan(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    total = _money("o_totalprice")
    joined = orders.withColumn("o_day", F.col("o_orderdate").cast("date")).join(
        _lines_by_order(spark, d), F.col("o_orderkey") == F.col("l_orderkey"), "left"
    )
    z = lambda c, places=2: _double(F.coalesce(F.sum(c), F.lit(0)), places)
    yearly = joined.groupBy(F.col("o_custkey"), F.year("o_day").alias("fyear")).agg(
        z("ext").alias("sale"),
        z("qty", 0).alias("qty"),
        z("rebate", 4).alias("xsga"),
        z("taxed", 4).alias("dp"),
        _double(F.sum("tax_r"), 4).alias("xad"),
        _double(F.sum("tax_a"), 4).alias("xrd"),
        z("ext_r").alias("ext_r"),
        z("ext_n").alias("ext_n"),
        z("ext_f").alias("ext_f"),
        z("tax_o", 4).alias("dlc"),
        z("rebate_n", 4).alias("che"),
        z("qty_o", 0).alias("qty_o"),
        z(total).alias("at"),
        z(F.when(F.col("o_orderstatus") == "O", total)).alias("act"),
        z(F.when(F.col("o_orderstatus") == "P", total)).alias("lct"),
        F.min("o_day").alias("first_order"),
        F.max("o_day").alias("last_order"),
        F.count(F.lit(1)).cast("int").alias("n_orders"),
    )
    shaped = yearly.select(
        F.col("o_custkey").cast("string").alias("gvkey"),
        F.make_date("fyear", F.lit(12), F.lit(31)).alias("datadate"),
        "fyear",
        F.when(F.col("n_orders") % 3 != 0, F.date_add("last_order", 90)).alias("rdq"),
        "sale",
        (F.col("qty") * 600).alias("cogs"),
        "xsga", "xad", "xrd", "dp",
        (F.col("sale") - F.col("qty") * 600 - F.col("xsga") - F.col("ext_r")).alias("oiadp"),
        (F.col("sale") - F.col("qty") * 600 - F.col("xsga") - F.col("ext_r") - F.col("dp")).alias("ib"),
        "at",
        (F.col("qty") * 200).alias("ppent"),
        (F.col("qty_o") * 300).alias("capx"),
        (F.col("ext_f") * 0.2).alias("dltt"),
        "dlc",
        (F.col("at") - F.col("ext_n")).alias("ceq"),
        "che", "act", "lct", "ext_f", "qty", "first_order", "last_order", "n_orders",
    )
    return shaped.join(firms(spark, d).select("gvkey", "sich", "sic2", "sic1"), "gvkey")


def filings(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    """Dated filings for firms with two orders; some lie before the report date."""
    base = reports(spark, d) if base is None else base
    early = F.month("first_order") <= 2
    day = F.when(early, F.date_add("datadate", -10)).otherwise(
        F.date_add("datadate", F.lit(30) + F.dayofmonth("last_order"))
    )
    return base.filter(F.col("n_orders") >= 2).select(
        "gvkey", "datadate", "fyear", (day.cast("timestamp_ntz") + F.expr("interval 16 hours")).alias("filing_timestamp")
    )


def delistings(spark: SparkSession, d: str) -> DataFrame:
    """One dated exit per supplier with a small account balance."""
    supplier = scan(spark, d, "supplier", ["s_suppkey", "s_acctbal"]).filter(F.col("s_acctbal") < 3000)
    shift = (F.abs(F.floor("s_acctbal")) % 1200).cast("int")
    category = F.element_at(
        F.array(*[F.lit(c) for c in EXIT_CATEGORIES]), (F.col("s_suppkey") % 4).cast("int") + 1
    )
    return supplier.select(
        F.col("s_suppkey").alias("permno"),
        F.date_add(F.lit("1998-01-10").cast("date"), shift).alias("dlstdt"),
        F.when(F.col("s_suppkey") % 5 != 0, -F.abs(F.col("s_acctbal")) / 10000).alias("dlret"),
        category.alias("exit_category"),
    )


# Exit categories.
EXIT_CATEGORIES = ("performance_failure", "merger", "voluntary_administrative", "other_unknown")


def security_months(spark: SparkSession, d: str) -> DataFrame:
    """One row per security and month, up to the month of its exit."""
    line = scan(spark, d, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    ext = _money("l_extendedprice")
    monthly = line.groupBy(
        F.col("l_suppkey").alias("permno"), F.last_day(F.col("l_shipdate").cast("date")).alias("date")
    ).agg(
        _double(F.sum(ext), 2).alias("traded"),
        _double(F.sum(_units("l_quantity")), 0).alias("vol"),
        _double(F.sum(ext * _share("l_discount")), 4).alias("rebate"),
        _double(F.sum(ext * _share("l_tax")), 4).alias("taxed"),
        F.count(F.lit(1)).cast("int").alias("n_lines"),
    )
    exits = delistings(spark, d).select("permno", F.last_day("dlstdt").alias("exit_month"))
    kept = monthly.join(exits, "permno", "left").filter(
        F.col("exit_month").isNull() | (F.col("date") <= F.col("exit_month"))
    )
    prc = F.col("traded") / F.col("vol") / 100
    return kept.select(
        "permno", "date",
        F.when(F.col("n_lines") > 1, F.col("rebate") / F.col("traded") * 4 - 0.2).alias("ret"),
        prc.alias("prc"),
        (F.lit(1000.0) + (F.col("permno") % 97) * 100).alias("shrout"),
        F.col("vol"),
        F.when(F.col("n_lines") % 4 != 0, prc * (1 - F.col("rebate") / F.col("traded") / 10)).alias("bid"),
        F.when(F.col("n_lines") % 4 != 0, prc * (1 + F.col("taxed") / F.col("traded") / 10)).alias("ask"),
        (F.col("permno") % 4 + 1).cast("int").alias("exchcd"),
        (F.col("permno") % 3 + 10).cast("int").alias("shrcd"),
        (prc * (F.lit(1000.0) + (F.col("permno") % 97) * 100) / 1000).alias("market_cap_millions"),
    )


def links(spark: SparkSession, d: str) -> DataFrame:
    """Per security and year its two largest customers as dated links, the largest primary."""
    line = scan(spark, d, "lineitem", ["l_orderkey", "l_suppkey", "l_extendedprice"])
    orders = scan(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    spend = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_suppkey", F.year(F.col("o_orderdate").cast("date")).alias("y"), "o_custkey")
        .agg(F.sum(_money("l_extendedprice")).alias("spend"))
    )
    # the two largest as bounded aggregates, so a hot security-year is never sorted whole
    key = F.struct("spend", F.col("o_custkey").alias("c"))
    first = spend.groupBy("l_suppkey", "y").agg(F.max(key).alias("a"))
    second = (
        spend.join(first.select("l_suppkey", "y", F.col("a.c").alias("o_custkey")), ["l_suppkey", "y", "o_custkey"], "left_anti")
        .groupBy("l_suppkey", "y")
        .agg(F.max(key).alias("a"))
    )
    both = first.withColumn("linkprim", F.lit("P")).unionByName(second.withColumn("linkprim", F.lit("C")))
    kind = F.element_at(F.array(F.lit("LC"), F.lit("LU"), F.lit("LS")), ((F.col("l_suppkey") + F.col("y")) % 3 + 1).cast("int"))
    return both.select(
        F.col("a.c").cast("string").alias("gvkey"),
        F.col("l_suppkey").alias("lpermno"),
        F.make_date("y", F.lit(1), F.lit(1)).alias("linkdt"),
        F.when(F.col("y") < 2001, F.make_date("y", F.lit(12), F.lit(31))).alias("linkenddt"),
        kind.alias("linktype"),
        "linkprim",
    )


def factors(spark: SparkSession, d: str) -> DataFrame:
    """Monthly market-wide return factors."""
    line = scan(spark, d, "lineitem", ["l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
    line = line.withColumns({"ext": _money("l_extendedprice"), "rebate": _money("l_extendedprice") * _share("l_discount")})
    ext, rebate = F.col("ext"), F.col("rebate")

    def rate(condition=None) -> Column:
        top = F.sum(rebate) if condition is None else _sum_if(condition, rebate)
        low = F.sum(ext) if condition is None else _sum_if(condition, ext)
        return _double(top, 4) / _double(low, 2) * 4 - 0.2

    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return line.groupBy(F.last_day(F.col("l_shipdate").cast("date")).alias("date")).agg(
        rate().alias("mkt_excess"),
        rate(flag == "R").alias("smb"),
        rate(flag == "A").alias("hml"),
        rate(flag == "N").alias("rmw"),
        rate(status == "F").alias("cma"),
        (_double(F.sum(ext * _share("l_tax")), 4) / _double(F.sum(ext), 2) - 0.04).alias("mom"),
        (F.lit(0.001) + F.month(F.last_day(F.max(F.col("l_shipdate").cast("date")))) / 10000.0).alias("rf"),
    )


def firm_exits(spark: SparkSession, d: str) -> DataFrame:
    """First and last observed day of every firm, and its exit if it has one."""
    orders = scan(spark, d, "orders", ["o_custkey", "o_orderdate"])
    seen = orders.groupBy("o_custkey").agg(
        F.min(F.col("o_orderdate").cast("date")).alias("first_observed_date"),
        F.max(F.col("o_orderdate").cast("date")).alias("last_observed_date"),
    )
    customer = scan(spark, d, "customer", ["c_custkey", "c_acctbal"])
    leaves = F.col("c_acctbal") < 4000
    category = F.element_at(F.array(*[F.lit(c) for c in EXIT_CATEGORIES]), (F.col("c_custkey") % 4).cast("int") + 1)
    exit_date = F.date_add("last_observed_date", (F.col("c_custkey") % 60 + 5).cast("int"))
    return seen.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").cast("string").alias("gvkey"),
        "first_observed_date",
        F.when(leaves, exit_date).otherwise(F.col("last_observed_date")).alias("last_observed_date"),
        F.when(leaves, exit_date).alias("exit_date"),
        F.when(leaves, category).alias("exit_category"),
    )


def risk_surface(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    """Report events at two horizons with a survival probability and a model vintage."""
    base = reports(spark, d) if base is None else base
    p = S.clip(S.positive_ratio("ext_f", "sale"), 0.01, 0.99)
    one = base.withColumn("s3", 1 - p).filter(F.col("s3").isNotNull())
    at = F.expr("explode(array(named_struct('h', 3, 's', s3), named_struct('h', 5, 's', pow(s3, 5.0 / 3.0D))))")
    return one.select(
        "gvkey", "datadate", "fyear", "sich", "sic2", "sic1",
        S.strictly_later_month_end(F.date_add("datadate", F.col("n_orders") * 20)).alias("feature_date"),
        F.floor((F.col("fyear") - 1995) / 2).cast("int").alias("fold"),
        at.alias("x"),
    ).select("*", F.col("x.h").alias("horizon_years"), F.col("x.s").alias("predicted_survival")).drop("x")


def signal_events(spark: SparkSession, d: str, months: DataFrame | None = None) -> DataFrame:
    """Quarter-end events per security with three signals, for forward-return work."""
    months = security_months(spark, d) if months is None else months
    supplier = scan(spark, d, "supplier", ["s_suppkey", "s_nationkey"])
    nation = scan(spark, d, "nation", ["n_nationkey", "n_regionkey"])
    industry = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("permno"), (F.col("n_regionkey") + 1).cast("int").alias("sic1")
    )
    return (
        months.filter((F.month("date") % 3 == 0) & F.col("ret").isNotNull())
        .join(industry, "permno")
        .select(
            S.composite_key(F.col("permno"), F.date_format("date", "yyyy-MM-dd"), F.year("date")).alias("event_id"),
            F.col("permno").cast("string").alias("gvkey"),
            "permno",
            F.col("date").alias("feature_date"),
            F.year("date").alias("fold"),
            "sic1",
            "market_cap_millions",
            F.col("ret").alias("migration_surprise"),
            F.col("prc").alias("viability_velocity"),
            F.log1p("vol").alias("historical_success_density"),
        )
    )


def report_truth(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    """Audit-only sidecar: what a report was really about, here from raw quantities."""
    base = reports(spark, d) if base is None else base
    return base.select(
        "gvkey", "datadate", "fyear",
        S.finite_ratio("qty", F.col("n_orders") * 100).alias("latent_axis_1"),
        S.finite_ratio("xsga", "sale").alias("latent_axis_2"),
        S.finite_ratio("ext_f", "sale").alias("latent_axis_3"),
        S.finite_ratio("capx", "at").alias("latent_axis_4"),
        S.finite_ratio("oiadp", "at").alias("latent_axis_5"),
        S.finite_ratio("ppent", "at").alias("latent_axis_6"),
    )
