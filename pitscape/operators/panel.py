"""Availability, universe filter, dated links, as-of joins and the firm-month panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitscape.functions import scalars as S
from pitscape.params import DEFAULT, Params

REPORT_KEY = ["gvkey", "datadate", "fyear"]


def report_availability(reports: DataFrame, filings: DataFrame | None, fallback_days: int = DEFAULT.fallback_days) -> DataFrame:
    """When each report became known: filing stamp, else announcement day, else a fixed delay.

    A source dated before the report itself is flagged and the next one is used.
    """
    if filings is None:
        joined = reports.withColumn("filing_timestamp", F.lit(None).cast("timestamp_ntz"))
    else:
        joined = reports.join(filings.select(*REPORT_KEY, "filing_timestamp"), REPORT_KEY, "left")
    start = F.col("datadate").cast("timestamp_ntz")
    filed, announced = F.col("filing_timestamp"), F.col("rdq").cast("timestamp_ntz")
    good_filing, good_rdq = S.when_all(filed >= start), S.when_all(announced >= start)
    fallback = F.date_add("datadate", fallback_days).cast("timestamp_ntz")
    available = F.when(good_filing, filed).when(good_rdq, announced).otherwise(fallback)
    return joined.select(
        "*",
        available.alias("availability_date"),
        # fixed values: source and confidence names
        F.when(good_filing, "sec_filing_timestamp").when(good_rdq, "rdq").otherwise("datadate_plus_180d").alias("availability_source"),
        F.when(good_filing, "high").when(good_rdq, "medium").otherwise("low").alias("availability_confidence"),
        (filed.isNotNull() & ~good_filing).alias("sec_invalid"),
        (announced.isNotNull() & ~good_rdq).alias("rdq_invalid"),
        S.strictly_later_month_end(available).alias("formation_date"),
    )


def compound_exit_returns(months: DataFrame, exits: DataFrame) -> DataFrame:
    """Compound the ordinary return with the exit return in the exit month; two exits of
    a security in one month stop the job."""
    twice = F.raise_error("two exits of a security in one month")
    dated = exits.groupBy("permno", F.last_day("dlstdt").alias("date")).agg(
        F.max("dlret").alias("dlret"), F.when(F.count(F.lit(1)) > 1, twice.cast("boolean")).otherwise(True).alias("has_delist")
    )
    r, x = F.col("ret"), F.col("dlret")
    return months.join(dated, ["permno", "date"], "left").select(
        *months.columns,
        "dlret",
        F.coalesce("has_delist", F.lit(False)).alias("has_delist"),
        F.coalesce((1 + r) * (1 + x) - 1, r, x).alias("total_return"),
        (F.coalesce("has_delist", F.lit(False)) & x.isNull()).alias("delist_return_missing"),
    )


def universe_conditions(p: Params = DEFAULT) -> dict[str, Column]:
    return {
        "share_code": F.col("shrcd").isin(*p.share_codes),
        "exchange": F.col("exchcd").isin(*p.exchanges),
        "valid_price": F.abs(F.col("prc")) > 0,
        "valid_cap": F.col("market_cap_millions") > 0,
        "min_price": F.abs(F.col("prc")) >= p.min_price,
        "min_cap": F.col("market_cap_millions") >= p.min_cap_millions,
        "min_volume": F.col("vol") >= p.min_volume,
    }


def waterfall(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows left after each stage, in one scan: stage, rows_remaining, rows_removed."""
    kept, columns = F.lit(True), [F.count(F.lit(1)).alias("s0")]
    for i, cond in enumerate(stages.values(), 1):
        kept = kept & F.coalesce(cond, F.lit(False))
        columns.append(F.count(F.when(kept, 1)).alias(f"s{i}"))
    names = ["raw", *stages]
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("stage_order"),
                F.lit(name).alias("stage"),
                F.col(f"s{i}").alias("rows_remaining"),
                (F.col(f"s{max(i - 1, 0)}") - F.col(f"s{i}")).alias("rows_removed"),
            )
            for i, name in enumerate(names)
        ]
    )
    return df.agg(*columns).select(F.inline(entries))


def apply_universe(months: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Universe filter, keeping an exit month whose previous calendar month qualified."""
    flagged = months.withColumn("eligible", S.when_all(*universe_conditions(p).values()))
    served = flagged.filter("eligible").select(
        "permno", F.last_day(F.add_months(F.last_day("date"), 1)).alias("date")
    )
    override = (
        flagged.filter(~F.col("eligible") & F.col("has_delist"))
        .join(served, ["permno", "date"], "left_semi")
        .withColumn("exit_override", F.lit(True))
    )
    return (
        flagged.filter("eligible").withColumn("exit_override", F.lit(False)).unionByName(override).drop("eligible")
    )


def universe_waterfall(months: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The filter stages, then the exit override, which removes a negative number."""
    stages = universe_conditions(p)
    base = waterfall(months, stages)
    last = len(stages)
    added = apply_universe(months, p).agg(F.count(F.when(F.col("exit_override"), 1)).alias("added"))
    final = base.filter(F.col("stage_order") == last).join(added).select(
        F.lit(last + 1).alias("stage_order"),
        F.lit("exit_override").alias("stage"),
        (F.col("rows_remaining") + F.col("added")).alias("rows_remaining"),
        (-F.col("added")).alias("rows_removed"),
    )
    return base.unionByName(final)


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    point_key: str,
    interval_key: str,
    date: str,
    start: str,
    end: str,
    last_year: Column | None = None,
) -> DataFrame:
    """Points inside [start, end], both ends included; an open end is unbounded.

    Intervals are cut by calendar year so that the join key is (key, year): a key with
    very many intervals or points spreads over its years, and the range condition is
    only tried against the intervals of one year.  An open interval is cut at the last
    year of the points.
    """
    spans = intervals
    if last_year is None:
        spans = spans.join(points.agg(F.max(F.year(date)).alias("__last")))
        last_year = F.col("__last")
    stop = F.least(F.coalesce(F.year(end), last_year), last_year)
    cut = (
        spans.withColumn("__stop", stop)
        .filter(F.year(start) <= F.col("__stop"))
        .withColumn("__y", F.explode(F.sequence(F.year(start), F.col("__stop"))))
        .drop("__last", "__stop")
    )
    left = points.withColumn("__y", F.year(date))
    condition = (
        (left[point_key] == cut[interval_key])
        & (left["__y"] == cut["__y"])
        & (left[date] >= cut[start])
        & (left[date] <= F.coalesce(cut[end], left[date]))
    )
    return left.join(cut, condition).drop("__y")


def map_links(months: DataFrame, links: DataFrame, p: Params = DEFAULT, check: bool = True) -> DataFrame:
    """Attach the firm that a security belonged to on each date.

    Allowed links only; primary before candidate and confirmed before unconfirmed types.
    Two firms at the same best priority are an error, raised while the job runs.
    The choice is a minimum, so it combines map-side and needs no sort.
    """
    rank = F.when(F.col("linkprim") == "P", 0).otherwise(10) + F.when(F.col("linktype") == "LC", 0).when(
        F.col("linktype") == "LU", 1
    ).otherwise(2)
    allowed = links.filter(F.col("linktype").isin(*p.link_types) & F.col("linkprim").isin(*p.link_primary))
    matched = interval_join(
        months.select("permno", "date"),
        allowed.withColumn("link_rank", rank),
        "permno", "lpermno", "date", "linkdt", "linkenddt",
    )
    per_rank = matched.groupBy("permno", "date", "link_rank").agg(
        F.min(F.struct("linkdt", "gvkey", "linkenddt", "linktype", "linkprim")).alias("best"),
        F.min("gvkey").alias("g0"),
        F.max("gvkey").alias("g1"),
    )
    chosen = per_rank.groupBy("permno", "date").agg(F.min(F.struct("link_rank", "best", "g0", "g1")).alias("c"))
    firm = F.col("c.best.gvkey")
    if check:
        firm = F.when(F.col("c.g0") == F.col("c.g1"), firm).otherwise(
            F.raise_error(F.concat(F.lit("two firms share the best link of security "), F.col("permno").cast("string"))).cast("string")
        )
    return chosen.select(
        "permno", "date", firm.alias("gvkey"), F.col("c.best.linkdt").alias("linkdt"),
        F.col("c.best.linkenddt").alias("linkenddt"), F.col("c.best.linktype").alias("linktype"),
        F.col("c.best.linkprim").alias("linkprim"),
    )


def link_segments(links: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(permno, seg_from, seg_to, gvkey): the allowed links of each security swept into disjoint spans with one firm each.

    A span begins where some link begins or has just ended; the best link that covers its first day holds for all of it. ``seg_to`` is null
    where a link is open and nothing follows. Two firms at the same best priority come as ``tied``, an error only for a month inside. Adjacent spans of one firm are kept
    apart; days no link covers are in no span.
    """
    rank = F.when(F.col("linkprim") == "P", 0).otherwise(10) + F.when(F.col("linktype") == "LC", 0).when(F.col("linktype") == "LU", 1).otherwise(2)
    allowed = links.filter(F.col("linktype").isin(*p.link_types) & F.col("linkprim").isin(*p.link_primary) & (F.col("linkdt") <= F.coalesce("linkenddt", F.col("linkdt")))).withColumn("link_rank", rank)
    edges = allowed.select(F.col("lpermno").alias("permno"), F.explode(F.array("linkdt", F.date_add("linkenddt", 1))).alias("seg_from")).filter(F.col("seg_from").isNotNull()).distinct()
    order = W.partitionBy("permno").orderBy("seg_from")  # the link dates of one security
    spans = edges.withColumn("seg_to", F.date_sub(F.lead("seg_from").over(order), 1))
    covered = interval_join(spans, allowed, "permno", "lpermno", "seg_from", "linkdt", "linkenddt")
    per_rank = covered.groupBy("permno", "seg_from", "seg_to", "link_rank").agg(F.min("gvkey").alias("gvkey"), F.max("gvkey").alias("other"))
    best = per_rank.groupBy("permno", "seg_from", "seg_to").agg(F.min(F.struct("link_rank", "gvkey", "other")).alias("b"))
    return best.select("permno", "seg_from", "seg_to", F.col("b.gvkey").alias("gvkey"), (F.col("b.gvkey") != F.col("b.other")).alias("tied"))


def dated_return_history(months: DataFrame, exits: DataFrame, links: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One return per firm and month, stitched from whatever securities it had: the path of a firm goes on when its security changes.

    Only share class and exchange are filtered, nothing that depends on later prices. Of several securities of a firm in a month the one of
    the largest capitalisation counts, then the smaller number; ``candidates`` says how many there were.
    """
    kept = compound_exit_returns(months, exits).filter(F.col("shrcd").isin(*p.share_codes) & F.col("exchcd").isin(*p.exchanges))
    inside = interval_join(kept, link_segments(links, p).withColumnRenamed("permno", "lpermno"), "permno", "lpermno", "date", "seg_from", "seg_to")
    columns = ["permno", "total_return", "has_delist", "delist_return_missing", "market_cap_millions"]
    first = F.min(F.struct(F.col("market_cap_millions").isNull(), -F.col("market_cap_millions"), *[F.col(c).alias(f"s_{c}") for c in columns]))
    tied = F.min(F.when(F.col("tied"), F.col("permno"))).alias("tied")
    chosen = inside.groupBy("gvkey", "date").agg(first.alias("c"), F.count(F.lit(1)).alias("candidates"), tied)
    # raised behind the aggregate, so that no filter carries it into the join, where months outside a span would meet it
    tie = F.raise_error(F.concat(F.lit("two firms share the best link of security "), F.col("tied").cast("string"))).cast("bigint")
    permno = F.when(F.col("tied").isNotNull(), tie).otherwise(F.col("c.s_permno")).alias("permno")
    return chosen.select("gvkey", "date", permno, *[F.col(f"c.s_{c}").alias(c) for c in columns[1:]], "candidates")


def dated_link_join(observations: DataFrame, links: DataFrame, date: str) -> DataFrame:
    """Firms linked to a security on a date, whatever the link type; one row per firm."""
    joined = interval_join(observations, links, "permno", "lpermno", date, "linkdt", "linkenddt")
    return joined.select(*observations.columns, "gvkey").dropDuplicates(["permno", date, "gvkey"])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_date: str,
    right_date: str,
    columns: Sequence[str],
    tie_order: Sequence[str] = (),
) -> DataFrame:
    """Backward as-of join, same-day matches allowed; of several same-day rows the last wins.

    The answer depends only on (key, day).  Both sides are first reduced to that grain,
    map-side; one carried-forward window per key then runs over at most one row per
    calendar day, whatever the size of the key; the result returns to the rows by an
    equi-join on (key, day), where a hot key is spread over its days.
    """
    picked = F.struct(*[F.col(c) for c in dict.fromkeys([right_date, *tie_order, *columns])])
    known = right.filter(F.col(right_date).isNotNull()).groupBy(by, F.col(right_date).alias("__day")).agg(
        F.max(picked).alias("__row")
    )
    asked = left.filter(F.col(left_date).isNotNull()).select(by, F.col(left_date).alias("__day")).distinct()
    days = asked.withColumn("__row", F.lit(None).cast(known.schema["__row"].dataType)).withColumn(
        "__ask", F.lit(True)
    ).unionByName(known.withColumn("__ask", F.lit(False)))
    per_day = days.groupBy(by, "__day").agg(F.max("__row").alias("__row"), F.max("__ask").alias("__ask"))
    carried = W.partitionBy(by).orderBy("__day").rowsBetween(W.unboundedPreceding, 0)
    answer = (
        per_day.withColumn("__hit", F.last("__row", ignorenulls=True).over(carried))
        .filter("__ask")
        .select(
            F.col(by), F.col("__day").alias(left_date),
            *[F.col(f"__hit.{c}").alias(c if c not in left.columns else f"matched_{c}") for c in columns],
        )
    )
    return left.join(answer, [by, left_date], "left")


def report_history(reports: DataFrame) -> DataFrame:
    """Running number of reports per firm in the order they became usable."""
    order = W.partitionBy("gvkey").orderBy("formation_date", "datadate", "fyear")
    return reports.withColumn("reporting_history", F.row_number().over(order))


def one_security_per_firm_month(panel: DataFrame) -> DataFrame:
    """Largest capitalisation, then the smallest security id; a maximum, not a sort."""
    rest = [c for c in panel.columns if c not in ("gvkey", "date")]
    best = F.max(F.struct(F.coalesce("market_cap_millions", F.lit(float("-inf"))).alias("__cap"), (-F.col("permno")).alias("__id"), F.struct(*rest).alias("r")))
    return panel.groupBy("gvkey", "date").agg(best.alias("b")).select("gvkey", "date", "b.r.*")


def first_month_per_report(panel: DataFrame) -> DataFrame:
    """The first eligible month of every report, which dates its feature event."""
    rest = [c for c in panel.columns if c not in REPORT_KEY]
    first = F.min(F.struct("date", "permno", F.struct(*rest).alias("r")))
    return panel.groupBy(*REPORT_KEY).agg(first.alias("b")).select(*REPORT_KEY, "b.r.*").withColumnRenamed("date", "feature_date")


def panel_stages(p: Params = DEFAULT) -> dict[str, Column]:
    stale = S.completed_months("date", "formation_date")
    return {
        "matched_report": F.col("formation_date").isNotNull(),
        "minimum_history": F.col("reporting_history") >= p.min_history,
        "fresh_report": (stale >= 0) & (stale <= p.max_staleness_months),
    }


def firm_month_panel(
    months: DataFrame, exits: DataFrame, links: DataFrame, reports: DataFrame, filings: DataFrame | None,
    p: Params = DEFAULT, filtered: bool = True, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Security-months joined to their firm and to the latest report known at the time.

    ``columns``: those of the report that come along with its key, dates and running number (default: all); the as-of join carries
    each of them with every day. Of reports that agree in key and dates the one with the larger columns counts.
    """
    known = report_history(report_availability(reports, filings, p.fallback_days))
    if columns is not None:
        wanted = {*REPORT_KEY, "formation_date", "reporting_history", *columns}
        known = known.select(*[c for c in known.columns if c in wanted])
    universe = apply_universe(compound_exit_returns(months, exits), p)
    linked = universe.join(map_links(universe, links, p), ["permno", "date"])
    values = [c for c in known.columns if c != "gvkey" and c not in linked.columns]
    joined = asof_join(linked, known, "gvkey", "date", "formation_date", values, ("datadate", "fyear"))
    joined = joined.withColumn("staleness_months", S.completed_months("date", "formation_date"))
    if not filtered:
        return joined
    return joined.filter(S.when_all(*panel_stages(p).values()))
