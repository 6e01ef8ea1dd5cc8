"""Saved tables against recomputations that share no step with the operators that made them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from pitscape.operators.contracts import duplicate_keys
from pitscape.params import DEFAULT, Params


def month_number(day: str | Column) -> Column:
    """Months since year 0, so that months can be counted by subtraction."""
    return F.year(day) * 12 + F.month(day) - 1


def _prefix(value: Column, order: W) -> list[Column]:
    """Running log of the size of 1 + value, its zeros and its signs; nulls add nothing."""
    factor = 1 + value
    log = F.when(factor != 0, F.log(F.abs(F.when(factor != 0, factor))))
    return [F.coalesce(F.sum(e).over(order), F.lit(0)) for e in (log, (factor == 0).cast("int"), (factor < 0).cast("int"))]


def _between(late: str, early: str) -> Column:
    """Product of 1 + value over the months after ``early`` up to ``late``, from two prefixes."""
    log, zeros, signs = (F.col(f"{late}.{n}") - F.col(f"{early}.{n}") for n in ("log", "zeros", "signs"))
    return F.when(zeros > 0, 0.0).otherwise(F.exp(log) * F.when(signs % 2 == 1, -1.0).otherwise(1.0))


def growth_prefixes(history: DataFrame, factors: DataFrame, key: str = "gvkey") -> DataFrame:
    """Per security and calendar month: prefixes of its growth, of its usable and flagged months and of the risk-free rate, and its next exit.

    A month is one row of the prefix table whether the security has a return in it or not, so a lookup is an equi-join. The
    windows hold the calendar of one security. A gap in the calendar of the factors stops the job.
    """
    calendar = factors.select(month_number("date").alias("t"), "rf")
    span = calendar.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))  # one row
    order = W.partitionBy("one").orderBy("t")  # one row a month of the calendar
    before = F.lag("t").over(order)
    unbroken = F.when(F.col("t") - before != 1, F.raise_error("the calendar of the factors has a gap").cast("double")).otherwise(F.col("rf"))
    cash = calendar.withColumn("one", F.lit(1)).withColumn("rf", unbroken).select("t", F.struct(*[c.alias(n) for c, n in zip(_prefix(F.col("rf"), order), ("log", "zeros", "signs"), strict=True)]).alias("cash"))
    flagged = F.coalesce("delist_return_missing", F.lit(False))
    rows = history.select(
        key, month_number("date").alias("t"), F.when(~flagged, F.col("total_return")).alias("r"), flagged.alias("flagged"),
        (F.coalesce("has_delist", F.lit(False)) & ~flagged & F.col("total_return").isNotNull()).alias("exit"),
    )
    each = rows.groupBy(key).agg(F.min("t").alias("a"), F.max("t").alias("b")).join(F.broadcast(span))
    dense = each.select(key, F.explode(F.sequence(F.least("a", "t0") - 1, F.greatest("b", "t1"))).alias("t"), "t0", "t1")
    full = dense.join(rows, [key, "t"], "left").join(F.broadcast(cash), "t", "left")
    own = W.partitionBy(key).orderBy("t")
    later = own.rowsBetween(1, W.unboundedFollowing)
    grown = F.struct(*[c.alias(n) for c, n in zip(_prefix(F.col("r"), own), ("log", "zeros", "signs"), strict=True)])
    flat = F.struct(F.lit(0.0).alias("log"), F.lit(0).cast("long").alias("zeros"), F.lit(0).cast("long").alias("signs"))
    return full.select(
        key, "t", "t1", grown.alias("grown"), F.coalesce("cash", flat).alias("cash"), F.count("r").over(own).alias("usable"),
        F.count(F.when(F.col("flagged"), 1)).over(own).alias("flags"), F.min(F.when(F.col("exit"), F.col("t"))).over(later).alias("next_exit"),
        F.max("t").over(W.partitionBy(key)).alias("t2"),
    )


def targets_by_prefix(events: DataFrame, history: DataFrame, factors: DataFrame, horizons: Sequence[int] = DEFAULT.return_horizons, key: str = "gvkey") -> DataFrame:
    """Forward targets from points of the prefix table: no month of a path is ever a row.

    An event looks up its own month, the month in which its path leaves the security (its exit or the horizon's end) and
    the horizon's end. Same columns as ``forward_targets``; a security without history gives broken paths.
    """
    prefix = growth_prefixes(history, factors, key)
    last = factors.agg(F.max(month_number("date")).alias("__t1"))
    at = prefix.select(key, F.col("t").alias("m"), F.struct("grown", "cash", "usable", "flags", "next_exit", "t2").alias("a"))
    start = events.select("event_id", key, month_number("feature_date").alias("m")).join(at, [key, "m"], "left")
    each = start.withColumn("horizon_months", F.explode(F.array(*[F.lit(int(h)) for h in horizons]))).join(F.broadcast(last))
    end = F.col("m") + F.col("horizon_months")
    stop = F.least(F.coalesce("a.next_exit", end), end)
    # nothing changes after the last month of the prefixes
    each = each.withColumns({"e": F.least(end, F.col("a.t2")), "s": F.least(stop, F.col("a.t2")), "stop": stop, "beyond": end > F.col("__t1")})
    left = prefix.select(key, F.col("t").alias("s"), F.struct("grown", "cash", "usable").alias("b"))
    right = prefix.select(key, F.col("t").alias("e"), F.struct("cash", "flags").alias("c"))
    points = each.join(left, [key, "s"], "left").join(right, [key, "e"], "left")
    usable = F.coalesce(F.col("b.usable") - F.col("a.usable"), F.lit(0))
    missing = F.coalesce(F.col("c.flags") > F.col("a.flags"), F.lit(False))
    gone = F.coalesce(F.col("a.next_exit") <= end, F.lit(False))
    valid = ~F.col("beyond") & (usable == F.col("stop") - F.col("m"))
    gross = F.when(valid, _between("b.grown", "a.grown") * _between("c.cash", "b.cash") - 1)
    rf = F.when(~F.col("beyond"), _between("c.cash", "a.cash") - 1)
    status = (
        F.when(missing, "missing_delisting_return").when(F.col("beyond"), "beyond_calendar").when(~valid, "missing_return_path")
        .when(gone, "complete_after_delist").otherwise("complete")
    )
    return points.select(
        "event_id", "horizon_months", F.col("horizon_months").cast("long").alias("path_months"), valid.alias("target_valid"), gross.alias("forward_total_return"),
        rf.alias("forward_risk_free_return"), (gross - rf).alias("forward_excess_return"), status.alias("target_status"),
    )


def differences_by_kind(saved: DataFrame, again: DataFrame, keys: Sequence[str], columns: Sequence[str], by: Sequence[str] = (), tolerance: float = 1e-9) -> DataFrame:
    """(by, kind, rows): rows of two tables that only one has, that a key repeats, and that differ in a column, by a full outer join.

    Doubles differ beyond ``tolerance``, absolute or relative; ``rows_compared`` is a kind too. ``by`` are some of the keys.
    """
    keys, by = list(keys), list(by)
    once = lambda df, side: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"__n_{side}"), *[F.first(c).alias(f"__{side}_{c}") for c in columns])
    both = once(saved, "a").join(once(again, "b"), keys, "full")
    here, there = F.col("__n_a").isNotNull(), F.col("__n_b").isNotNull()
    kinds: dict[str, Column] = {"rows_compared": here & there, "only_saved": ~there, "only_recomputed": ~here, "repeated_key": (F.coalesce("__n_a", F.lit(0)) > 1) | (F.coalesce("__n_b", F.lit(0)) > 1)}
    for c in columns:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        if isinstance(saved.schema[c].dataType, (T.DoubleType, T.FloatType)):
            far = F.abs(x - y) > tolerance * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
        else:
            far = x != y
        kinds[c] = here & there & (F.coalesce(far, F.lit(False)) | (x.isNull() != y.isNull()))
    counts = both.groupBy(*by).agg(*[F.count(F.when(cond, 1)).alias(f"k{i}") for i, cond in enumerate(kinds.values())])
    return counts.select(*by, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k{i}").alias("rows")) for i, k in enumerate(kinds)])))


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(check, violations): rows of a table that break a rule, all rules in one pass."""
    wide = df.agg(*[F.count(F.when(F.coalesce(c, F.lit(False)), 1)).alias(f"c{i}") for i, c in enumerate(rules.values())])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(rules)])))


def _repeats(df: DataFrame, keys: Sequence[str], check: str) -> DataFrame:
    return duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(check).alias("check"), "violations")


def path_gate(events: DataFrame, paths: DataFrame, targets: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(check, violations) of events, their paths and their targets: keys, completeness, timing, invalid paths, cash after an exit."""
    longest, ladder = max(p.return_horizons), len(p.return_horizons)
    months = paths.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("holding_offset").alias("lo"), F.max("holding_offset").alias("hi"))
    rungs = targets.groupBy("event_id").agg(F.countDistinct("horizon_months").alias("n"))
    short = lambda table, bad, check: events.select("event_id").distinct().join(table, "event_id", "left").agg(
        F.count(F.when(F.coalesce(bad, F.lit(True)), 1)).alias("violations")).select(F.lit(check).alias("check"), "violations")
    cash = F.col("cash_after_delist") & ~F.col("beyond_calendar") & (F.col("return_used").isNull() | (F.col("return_used") != F.col("rf")))
    parts = [
        _repeats(events, ["event_id"], "repeated_event"),
        _repeats(paths, ["event_id", "holding_offset"], "repeated_path_month"),
        _repeats(targets, ["event_id", "horizon_months"], "repeated_target"),
        short(months, (F.col("n") != longest) | (F.col("lo") != 1) | (F.col("hi") != longest), "incomplete_path"),
        short(rungs, F.col("n") != ladder, "incomplete_ladder"),
        violations(paths, {"month_before_formation": F.col("holding_date") <= F.col("feature_date"), "cash_differs_from_rate": cash}),
        violations(
            targets,
            {
                "invalid_with_return": ~F.col("target_valid") & (F.col("forward_total_return").isNotNull() | F.col("forward_excess_return").isNotNull()),
                "valid_without_return": F.col("target_valid") & F.col("forward_total_return").isNull(),
            },
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dynamics_gate(frame: DataFrame, entity: Sequence[str] = ("gvkey", "horizon_years"), frontier: float = DEFAULT.frontier, clip: float = DEFAULT.probability_clip, tolerance: float = 1e-9) -> DataFrame:
    """(check, rows, violations) of a dynamics table: its levels, log odds, margins, hazards, velocities and surprises from its own levels again.

    The previous event of each one is found by counting, not by a lag: events are numbered by date in their entity and joined to the number before.
    """
    entity = list(entity)
    odds = lambda p: F.log(p / (1 - p))
    level = F.greatest(F.least(F.col("viability_level"), F.lit(1 - clip)), F.lit(clip))
    limit = min(max(frontier, clip), 1 - clip)
    number = F.row_number().over(W.partitionBy(*entity).orderBy("feature_date", "datadate"))
    rows = frame.withColumn("__i", number)
    before = rows.select(*entity, (F.col("__i") + 1).alias("__i"), F.col("feature_date").alias("__d"), F.col("fold").alias("__f"), F.col("viability_level").alias("__p"))
    both = rows.join(before, [*entity, "__i"], "left")
    elapsed = F.datediff("feature_date", "__d") / 365.25
    same = F.coalesce((F.col("__f") == F.col("fold")) & (elapsed > 0), F.lit(False))
    earlier = F.greatest(F.least(F.col("__p"), F.lit(1 - clip)), F.lit(clip))
    speed = F.when(same, (odds(level) - odds(earlier)) / elapsed)
    far = lambda saved, again: F.coalesce(F.abs(F.col(saved) - again) > tolerance * F.greatest(F.lit(1.0), F.abs(again)), F.col(saved).isNull() != again.isNull())
    checks = {
        "level_outside_unit_interval": (F.lit(True), ~F.coalesce(F.col("viability_level").between(0, 1), F.lit(False))),
        "log_odds": (F.lit(True), far("viability_log_odds", odds(level))),
        "frontier_margin": (F.lit(True), far("frontier_margin", odds(level) - float(np.log(limit / (1 - limit))))),
        "constant_hazard": (F.lit(True), far("constant_hazard", -F.log(F.greatest(F.least(F.col("viability_level"), F.lit(1.0)), F.lit(clip))) / F.col("horizon_years"))),
        "velocity_inside_a_vintage": (same, same & far("velocity_log_odds", speed)),
        "velocity_across_vintages": (~same, ~same & F.col("velocity_log_odds").isNotNull()),
    }
    wide = both.agg(*[e for k, (all_, bad) in enumerate(checks.values()) for e in (F.count(F.when(all_, 1)).alias(f"n{k}"), F.count(F.when(bad, 1)).alias(f"v{k}"))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"n{k}").alias("rows"), F.col(f"v{k}").alias("violations")) for k, n in enumerate(checks)])))
