"""Robust group statistics and the scores built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscape.functions.ordering import FEW_GROUPS, known_keys, quantiles
from pitscape.params import DEFAULT, Params
from pitscape.session import cut

MAD_TO_STD = 1.4826


def group_statistics(
    df: DataFrame, keys: Sequence[str], value: str,
    lower: float = DEFAULT.winsor_lower, upper: float = DEFAULT.winsor_upper, weight: str | None = None,
) -> DataFrame:
    """Per group: count, median, two quantiles, population std and (raw) MAD.

    ``weight`` is an integer multiplicity for rows already reduced to distinct values.
    The groups are counted first.  Where they are few, no row is shuffled but those in the codes that
    hold a wanted rank; ``df`` is then read once for each pass and should be cheap to read.
    """
    keys = list(keys)
    v, w = F.col(value), F.col("__w")
    present = known_keys(df, *keys, value).select(*keys, value, (F.col(weight) if weight else F.lit(1)).alias("__w"))
    if weight is None:
        moments = cut(present.groupBy(*keys).agg(F.count(v).alias("n"), F.stddev_pop(v).alias("std")))
    else:
        moments = cut(present.groupBy(*keys).agg(F.sum(w).alias("n"), (F.sum(v * w) / F.sum(w)).alias("__mean")))
    few = moments.count() <= FEW_GROUPS
    small = F.broadcast if few else lambda table: table
    # with many groups every branch below reads the value counts; written once, they are shuffled once
    counted = present if few else cut(present.groupBy(*keys, value).agg(F.sum(w).alias("__w")))
    if weight is not None:  # two passes: the one-pass form cancels badly when rows carry large weights
        square = w * (v - F.col("__mean")) * (v - F.col("__mean"))
        spread = counted.join(small(moments), keys).groupBy(*keys).agg(F.sqrt(F.sum(square) / F.sum(w)).alias("std"))
        moments = moments.drop("__mean").join(spread, keys)
    center = cut(quantiles(counted, keys, value, {"median": 0.5, "lower": lower, "upper": upper}, "__w", few=few))
    deviations = counted.join(small(center.select(*keys, "median")), keys).select(
        *keys, F.abs(v - F.col("median")).alias("__dev"), "__w"
    )
    return moments.join(center, keys).join(quantiles(deviations, keys, "__dev", {"mad": 0.5}, "__w", few=few), keys)


def _written(table: DataFrame) -> tuple[DataFrame, bool]:
    """``table`` written once, and whether it has few rows."""
    written = cut(table)
    return written, written.count() <= FEW_GROUPS


def _small(table: DataFrame) -> DataFrame:
    """``table`` written once, and broadcast if it has few rows."""
    written, few = _written(table)
    return F.broadcast(written) if few else written


def robust_score(value: Column, prefix: str = "", clip: float = DEFAULT.score_clip, tiny: float = 1e-12) -> Column:
    """Winsorise, centre on the median, scale by MAD (std if MAD is degenerate), clip."""
    c = lambda n: F.col(prefix + n)
    winsor = F.greatest(F.least(value, c("upper")), c("lower"))
    scale = F.when(c("mad") * MAD_TO_STD > tiny, c("mad") * MAD_TO_STD).when(c("std") > tiny, c("std"))
    score = F.when(scale.isNull(), F.lit(0.0)).otherwise((winsor - c("median")) / scale)
    return F.when(value.isNotNull() & c("n").isNotNull(), F.greatest(F.least(score, F.lit(clip)), F.lit(-clip)))


def long_components(df: DataFrame, keep: Sequence[str], components: Sequence[str]) -> DataFrame:
    """(keep..., component, value) with missing values left out."""
    return df.unpivot(list(keep), list(components), "component", "value").filter(F.col("value").isNotNull())


def relative_scores(
    peers: DataFrame,
    events: DataFrame,
    components: Sequence[str],
    date: str,
    levels: Sequence[tuple[str, str | None]],
    event_key: Sequence[str],
    market_only: Sequence[str] = (),
    p: Params = DEFAULT,
) -> DataFrame:
    """Score events against the peers of the same date, narrowest level with enough peers.

    ``levels`` lists (name, group column) from narrow to wide, None for the whole date.
    Returns event_key + component, score, level, peer count.  All levels and components
    share one statistics job: each peer row carries its (level, group) once per level.
    """
    peer_long = _with_levels(long_components(peers, [date, *_cols(levels)], components), levels)
    stats = group_statistics(peer_long, [date, "component", "level", "grp"], "value", p.winsor_lower, p.winsor_upper)
    long_events = long_components(events, [*event_key, *[c for c in [date, *_cols(levels)] if c not in event_key]], components)
    enough = stats.filter(F.col("n") >= p.min_peers)
    written, few = _written(enough)
    if few and not _repeats(events, event_key):
        return _scored_in_place(written, long_events, event_key, date, levels, market_only, p)
    eligible = _with_levels(long_events, levels).join(F.broadcast(written) if few else written, [date, "component", "level", "grp"])
    order = F.lit(0)
    for i, (name, _) in enumerate(levels):
        order = F.when(F.col("level") == name, F.lit(i)).otherwise(order)
    if market_only:
        widest = levels[-1][0]
        eligible = eligible.filter(~F.col("component").isin(*market_only) | (F.col("level") == widest))
    scored = eligible.select(
        *event_key, "component", order.alias("o"), "level", F.col("n").alias("peer_count"),
        robust_score(F.col("value"), clip=p.score_clip).alias("score"),
    )
    best = F.min(F.struct("o", "score", "level", "peer_count")).alias("b")
    return scored.groupBy(*event_key, "component").agg(best).select(
        *event_key, "component", F.col("b.score").alias("score"), F.col("b.level").alias("level"),
        F.col("b.peer_count").alias("peer_count"),
    )


def _repeats(df: DataFrame, key: Sequence[str]) -> bool:
    return not df.groupBy(*key).agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") > 1).isEmpty()


def _scored_in_place(stats: DataFrame, events: DataFrame, event_key: Sequence[str], date: str, levels, market_only: Sequence[str], p: Params) -> DataFrame:
    """The score of every event and component by the narrowest level with enough peers, where no key repeats and the statistics
    are few: an event looks its levels up and is not shuffled."""
    found, picks = events, []
    for i, (name, column) in enumerate(levels):
        at = F.lit("all") if column is None else F.col(column).cast("string")
        rest = [c for c in stats.columns if c not in (date, "component", "level", "grp")]
        one = stats.filter(F.col("level") == name).select(
            F.col(date).alias("__d"), F.col("component").alias("__c"), F.col("grp").alias("__g"), F.struct("level", *rest).alias(f"__s{i}")
        )
        found = found.join(F.broadcast(one), (F.col(date) == F.col("__d")) & (F.col("component") == F.col("__c")) & (at == F.col("__g")), "left").drop("__d", "__c", "__g")
        own = F.col(f"__s{i}")
        picks.append(F.when(~F.col("component").isin(*market_only), own) if market_only and i < len(levels) - 1 else own)
    chosen = found.withColumn("__s", F.coalesce(*picks)).filter(F.col("__s").isNotNull())
    return chosen.select(
        *event_key, "component", robust_score(F.col("value"), "__s.", p.score_clip).alias("score"), F.col("__s.level").alias("level"), F.col("__s.n").alias("peer_count")
    )


def _cols(levels) -> list[str]:
    return [c for _, c in levels if c is not None]


def _with_levels(df: DataFrame, levels) -> DataFrame:
    """One row per level whose group is known."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("level"),
                (F.lit("all") if column is None else F.col(column).cast("string")).alias("grp"),
            )
            for name, column in levels
        ]
    )
    out = df.withColumn("__l", F.explode(entries))
    return out.select(*df.columns, F.col("__l.level").alias("level"), F.col("__l.grp").alias("grp")).filter(
        F.col("grp").isNotNull()
    )


def peer_medians(peers: DataFrame, value: str, date: str, levels, p: Params = DEFAULT) -> DataFrame:
    """Peer medians of every level with enough peers: date, level, grp, n, median."""
    long = _with_levels(peers.select(date, *_cols(levels), F.col(value).alias("value")), levels)
    long = long.filter(F.col("value").isNotNull())
    med = quantiles(long, [date, "level", "grp"], "value", {"median": 0.5})
    n = long.groupBy(date, "level", "grp").agg(F.count(F.lit(1)).alias("n"))
    return med.join(n, [date, "level", "grp"]).filter(F.col("n") >= p.min_peers)


def impute_from_peers(peers: DataFrame, value: str, date: str, levels, p: Params = DEFAULT) -> DataFrame:
    """Fill a missing value with the current peer median; records the level and peer count."""
    table = peer_medians(peers, value, date, levels, p)
    out = peers
    for name, column in levels:
        one = table.filter(F.col("level") == name).select(
            F.col(date).alias("__d"), F.col("grp").alias("__g"),
            F.col("median").alias(f"__m_{name}"), F.col("n").alias(f"__n_{name}"),
        )
        group = F.lit("all") if column is None else F.col(column).cast("string")
        out = out.join(one, (out[date] == one["__d"]) & (group == one["__g"]), "left").drop("__d", "__g")
    medians = [F.col(f"__m_{name}") for name, _ in levels]
    level, count = F.lit(None).cast("string"), F.lit(None).cast("long")
    for name, _ in reversed(list(levels)):
        level = F.when(F.col(f"__m_{name}").isNotNull(), F.lit(name)).otherwise(level)
        count = F.when(F.col(f"__m_{name}").isNotNull(), F.col(f"__n_{name}")).otherwise(count)
    missing = F.col(value).isNull()
    return out.select(
        *peers.columns,
        F.coalesce(F.col(value), *medians).alias(f"{value}_peer_imputed"),
        F.when(missing, F.coalesce(level, F.lit("unavailable"))).otherwise(F.lit("observed")).alias("imputation_level"),
        F.when(missing, count).alias("imputation_peer_count"),
    )


def anchored_scores(
    events: DataFrame, components: Sequence[str], event_key: Sequence[str], date: str, p: Params = DEFAULT
) -> DataFrame:
    """Score events against all events of strictly earlier calendar years.

    A value serves the later years in which events exist, so the replication is by calendar
    year; the statistics combine the values map-side and shuffle few of them.
    """
    long = long_components(events.withColumn("__year", F.year(date)), [*event_key, "__year"], components)
    years = long.select(F.col("__year").alias("serves")).distinct()
    bounds = years.agg(F.min("serves").alias("y0"), F.max("serves").alias("y1"))
    bounds, years = cut(bounds), cut(years)
    expanded = long.join(F.broadcast(bounds)).filter(F.col("__year") < F.col("y1")).select(
        F.explode(F.sequence(F.col("__year") + 1, F.col("y1"))).alias("serves"), "component", "value"
    ).join(F.broadcast(years), "serves", "left_semi")
    stats = group_statistics(expanded, ["serves", "component"], "value", p.winsor_lower, p.winsor_upper)
    joined = long.join(_small(stats.withColumnRenamed("serves", "__year")), ["__year", "component"], "left")
    score = F.when(F.col("n") >= p.min_anchor, robust_score(F.col("value"), clip=p.score_clip))
    return joined.select(
        *event_key, "component", score.alias("score"),
        F.coalesce("n", F.lit(0)).alias("reference_count"), (F.col("__year") - 1).alias("reference_end_year"),
    )


def fit_robust_scale(training: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: name, median, scale (1.4826 MAD, or 1 if that is zero)."""
    stats = group_statistics(long_components(training, [], columns), ["component"], "value")
    scale = F.col("mad") * MAD_TO_STD
    return stats.select("component", "median", F.when(scale > 1e-12, scale).otherwise(1.0).alias("scale"))


def apply_robust_scale(df: DataFrame, fitted: DataFrame, columns: Sequence[str], clip: float) -> DataFrame:
    """Median fill, scale and clip; the fitted table has one row per column."""
    wide = fitted.agg(
        *[F.max(F.when(F.col("component") == c, F.struct("median", "scale"))).alias(f"__{c}") for c in columns]
    )
    out = df.join(F.broadcast(wide))
    return out.withColumns(
        {
            c: F.greatest(
                F.least((F.coalesce(F.col(c), F.col(f"__{c}.median")) - F.col(f"__{c}.median")) / F.col(f"__{c}.scale"), F.lit(clip)),
                F.lit(-clip),
            )
            for c in columns
        }
    ).drop(*[f"__{c}" for c in columns])


def zscore_within(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Cross-sectional z-scores with the population std; a constant column scores zero.

    The group moments come from a map-side aggregate joined back, so no group is ever
    gathered; the population std is the two-moment form around the group mean.
    """
    keys = list(keys)
    moments = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns]
    )
    out = df.join(moments, keys)
    return out.withColumns(
        {
            c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 1e-12, F.col(f"__s_{c}")).otherwise(1.0)
            for c in columns
        }
    ).drop(*[f"__{k}_{c}" for c in columns for k in "ms"])
