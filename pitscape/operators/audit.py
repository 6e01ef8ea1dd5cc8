"""Drift alerts, scoped summaries, gates, proxy selection, bootstrap power, recovery."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitscape.functions.ordering import top_fraction
from pitscape.operators import power
from pitscape.operators.contracts import checked_join
from pitscape.operators.describe import clustered_slope, prediction_metrics, slope_from_cluster_sums, spearman, student_p
from pitscape.session import cut
from pitscape.params import DEFAULT


def drift_events(candidates: DataFrame, truth: DataFrame, scores: Sequence[str], benchmark: str, truth_score: str, scenario: str, years: tuple[int, int], fraction: float = DEFAULT.alert_fraction) -> DataFrame:
    """One row per event and score: alert, true extreme, hit, and sign agreement.

    Compared are events of the evaluation years that have the benchmark and the truth.
    """
    key = ["gvkey", "datadate", "fyear"]
    joined = candidates.select(*key, *scores).join(truth.select(*key, F.col(truth_score).alias("truth_value")), key, "left").filter(
        F.col("fyear").between(*years) & F.col(benchmark).isNotNull() & F.col("truth_value").isNotNull()
    )
    flagged = top_fraction(joined, ["fyear"], "truth_value", "gvkey", fraction, "is_truth_extreme")
    long = flagged.select(*key, "truth_value", "is_truth_extreme", F.inline(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("score_value")) for s in scores])))
    alerts = top_fraction(long, ["score", "fyear"], "score_value", "gvkey", fraction, "is_alert")
    return alerts.select(
        F.lit(scenario).alias("scenario"), "*", F.col("score_value").isNotNull().alias("score_available"),
        (F.col("is_alert") & F.col("is_truth_extreme")).alias("correct_extreme"),
        F.coalesce(F.signum("score_value") == F.signum("truth_value"), F.lit(False)).alias("sign_correct"),
    )


def scoped(df: DataFrame, blocks: Mapping[str, tuple[int, int]], scenario: str = "scenario", year: str = "fyear") -> DataFrame:
    """Each row once per scope it belongs to: overall, its scenario, its year blocks."""
    scopes = [
        F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("scope_value")),
        F.struct(F.lit("scenario").alias("scope"), F.col(scenario).alias("scope_value")),
    ]
    for name, (a, b) in blocks.items():
        scopes.append(F.when(F.col(year).between(a, b), F.struct(F.lit("block").alias("scope"), F.lit(name).alias("scope_value"))))
    return df.withColumn("__s", F.explode(F.array_compact(F.array(*scopes)))).select("*", "__s.scope", "__s.scope_value").drop("__s")


def drift_summary(events: DataFrame, blocks: Mapping[str, tuple[int, int]]) -> DataFrame:
    count = lambda c: F.count(F.when(F.col(c), 1))
    out = scoped(events, blocks).groupBy("scope", "scope_value", "score").agg(
        F.count(F.lit(1)).alias("rows"), count("score_available").alias("available_rows"), count("is_alert").alias("alerts"),
        count("is_truth_extreme").alias("truth_extremes"), count("correct_extreme").alias("correct_extremes"),
        F.count(F.when(F.col("is_alert") & F.col("sign_correct"), 1)).alias("__sign"),
    )
    return out.select(
        "scope", "scope_value", "score", "rows", "available_rows", (F.col("available_rows") / F.col("rows")).alias("coverage"), "alerts", "truth_extremes", "correct_extremes",
        F.try_divide("correct_extremes", "alerts").alias("precision"), F.try_divide("correct_extremes", "truth_extremes").alias("recall"),
        F.try_divide("__sign", "alerts").alias("sign_accuracy"),
    )


def peer_summary(rows: DataFrame, totals: DataFrame, blocks: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Recall, lift and crowding agreement per scope and space.

    ``totals`` has (scenario, complete_rows, total_rows).  A block has no own total: it is
    its rows scaled by the scenario's total over complete rows, rounded per scenario.
    """
    wide = scoped(rows, blocks)
    basic = wide.groupBy("scope", "scope_value", "space").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("recall_at_k").alias("mean_recall"), F.avg("random_recall").alias("mean_random_recall")
    )
    rank = spearman(wide, ["scope", "scope_value", "space"], "observed_crowding", "latent_crowding").drop("n")
    per = wide.groupBy("scope", "scope_value", "space", "scenario").agg(F.count(F.lit(1)).alias("__n")).join(totals, "scenario")
    share = F.when(F.col("scope") == "block", F.round(F.col("__n") * F.col("total_rows") / F.col("complete_rows"))).otherwise(F.col("total_rows"))
    cover = per.groupBy("scope", "scope_value", "space").agg(F.sum(share).cast("long").alias("total_rows"))
    return basic.join(rank, ["scope", "scope_value", "space"]).join(cover, ["scope", "scope_value", "space"]).select(
        "*", (F.col("rows") / F.col("total_rows")).alias("coverage"), F.try_divide("mean_recall", "mean_random_recall").alias("recall_lift")
    ).withColumnRenamed("spearman", "crowding_spearman")


def gate_table(metrics: DataFrame, gates: Mapping[str, Column]) -> DataFrame:
    """(gate, passed) rows plus the verdict that all hold; each gate is an aggregate."""
    wide = metrics.agg(*[F.coalesce(g, F.lit(False)).alias(f"g{i}") for i, g in enumerate(gates.values())])
    rows = [F.struct(F.lit(n).alias("gate"), F.col(f"g{i}").alias("passed")) for i, n in enumerate(gates)]
    every = F.lit(True)
    for i in range(len(gates)):
        every = every & F.col(f"g{i}")
    return wide.select(F.inline(F.array(*rows, F.struct(F.lit("all_gates").alias("gate"), every.alias("passed")))))


def _at(scope: str, value: str, column: str, name_column: str, name: str) -> Column:
    hit = (F.col("scope") == scope) & (F.col("scope_value") == value) & (F.col(name_column) == name)
    return F.max(F.when(hit, F.col(column)))


def drift_gate(summary: DataFrame, primary: str, benchmark: str, blocks: Sequence[str]) -> DataFrame:
    at = lambda column, score=primary, scope="overall", value="all": _at(scope, value, column, "score", score)
    stable = F.lit(True)
    for b in blocks:
        stable = stable & (at("precision", primary, "block", b) >= 0.20)
    return gate_table(summary, {
        "overall_precision_at_least_0_25": at("precision") >= 0.25,
        "both_blocks_precision_at_least_0_20": stable,
        "sign_accuracy_at_least_0_75": at("sign_accuracy") >= 0.75,
        "coverage_at_least_0_95": at("coverage") >= 0.95,
        "precision_improvement_at_least_0_05": at("precision") - at("precision", benchmark) >= 0.05,
    })


def peer_map_gate(summary: DataFrame, space: str, scenarios: int = 3) -> DataFrame:
    at = lambda column: _at("overall", "all", column, "space", space)
    mine = (F.col("scope") == "scenario") & (F.col("space") == space)
    each = (F.count(F.when(mine, 1)) == scenarios) & F.bool_and(F.when(mine, F.col("mean_recall") >= 0.03))
    return gate_table(summary, {
        "overall_recall_at_least_0_05": at("mean_recall") >= 0.05, "every_scenario_recall_at_least_0_03": each,
        "recall_lift_at_least_5x_random": at("recall_lift") >= 5.0, "coverage_at_least_0_85": at("coverage") >= 0.85,
    })


def crowding_gate(summary: DataFrame, space: str, scenarios: int = 3) -> DataFrame:
    at = lambda column: _at("overall", "all", column, "space", space)
    mine = (F.col("scope") == "scenario") & (F.col("space") == space)
    each = (F.count(F.when(mine, 1)) == scenarios) & F.bool_and(F.when(mine, F.col("crowding_spearman") >= 0.10))
    return gate_table(summary, {
        "overall_spearman_at_least_0_20": at("crowding_spearman") >= 0.20, "every_scenario_spearman_at_least_0_10": each,
        "coverage_at_least_0_85": at("coverage") >= 0.85,
    })


def product_gate(drift: DataFrame, peers: DataFrame, crowding: DataFrame) -> DataFrame:
    """The product needs drift alerts and one of the two structural uses."""
    verdict = lambda df, name: df.filter("gate = 'all_gates'").select(F.lit(name).alias("use"), "passed")
    rows = verdict(drift, "drift").unionByName(verdict(peers, "peers")).unionByName(verdict(crowding, "crowding"))
    ok = lambda *names: F.coalesce(F.bool_or(F.when(F.col("use").isin(*names), F.col("passed"))), F.lit(False))
    return gate_table(rows, {"strategic_drift_supported": ok("drift"), "peer_or_crowding_supported": ok("peers", "crowding")})


def utility_gate(comparisons: DataFrame, wins: int = 16, cells: int = 6) -> DataFrame:
    """Incremental utility: mean lift, wins, Brier and positive scenario x horizon cells."""
    per = comparisons.groupBy("scenario", "horizon_years").agg(
        F.sum("auc_improvement").alias("__a"), F.count("auc_improvement").alias("__n"), F.sum("brier_improvement").alias("__b"),
        F.count(F.when(F.col("auc_improvement") > 0, 1)).alias("__w"),
    )
    return gate_table(per, {
        "mean_auc_improvement_at_least_0_01": F.sum("__a") / F.sum("__n") >= 0.01, "auc_wins": F.sum("__w") >= wins,
        "mean_brier_improvement_positive": F.sum("__b") / F.sum("__n") > 0,
        "all_scenario_horizon_cells_positive": F.count(F.when(F.col("__a") > 0, 1)) == cells,
    })


def proxy_metrics(df: DataFrame, candidates: Sequence[str], truth: str, periods: Mapping[str, tuple[int, int]], year: str = "fyear") -> DataFrame:
    """Rank correlation with the truth and available rows of each candidate and period."""
    long = df.select(year, truth, F.inline(F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(c).cast("double").alias("value")) for c in candidates])))
    spans = F.array_compact(F.array(*[F.when(F.col(year).between(a, b), F.lit(n)) for n, (a, b) in periods.items()]))
    each = long.withColumn("period", F.explode(spans))
    return spearman(each, ["candidate", "period"], "value", truth)


def select_proxy(metrics: DataFrame, benchmark: str, calibration: str = "calibration", holdout: str = "holdout", blocks: Sequence[str] = ("block1", "block2"),
                 min_holdout: float = 0.10, min_block: float = 0.05, min_coverage: float = 0.9, min_improvement: float = 0.02) -> DataFrame:
    """Best candidate on the calibration years (name breaks ties), then hold-out gates."""
    wide = metrics.groupBy("candidate").agg(
        *[F.max(F.when(F.col("period") == p, F.col("spearman"))).alias(p) for p in (calibration, holdout, *blocks)],
        F.max(F.when(F.col("period") == holdout, F.col("n"))).alias("__n"),
    )
    bench = wide.filter(F.col("candidate") == benchmark).select(F.col(holdout).alias("__b"), F.col("__n").alias("__bn"))
    best = wide.filter(F.col("candidate") != benchmark).orderBy(F.desc_nulls_last(calibration), "candidate").limit(1)
    stable = F.lit(True)
    for b in blocks:
        stable = stable & (F.col(b) >= min_block)
    return best.join(bench).select(
        "candidate", F.col(calibration).alias("calibration_spearman"), F.col(holdout).alias("held_out_spearman"),
        F.coalesce(F.col(holdout) >= min_holdout, F.lit(False)).alias("held_out_gate"), F.coalesce(stable, F.lit(False)).alias("block_gate"),
        (F.col("__n") / F.col("__bn") >= min_coverage).alias("coverage_gate"), F.coalesce(F.col(holdout) - F.col("__b") >= min_improvement, F.lit(False)).alias("improvement_gate"),
    )


def eligibility_audit(rows: DataFrame, candidates: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Coverage of each candidate per year, reading only columns that are no outcomes."""
    forbidden = set(candidates) - set(allowed)
    if forbidden:
        raise PermissionError(f"an eligibility audit may not read {sorted(forbidden)}")
    blind = rows.select("fyear", *candidates)
    counts = blind.groupBy("fyear").agg(F.count(F.lit(1)).alias("events"), *[F.count(c).alias(c) for c in candidates])
    return counts.select("fyear", "events", F.inline(F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(c).alias("eligible")) for c in candidates])))


def proxy_eligibility(
    candidates: DataFrame, targets: DataFrame, truth: DataFrame, keys: Sequence[str], selected: str, benchmark: str, horizon: int, year: str = "fyear",
    calibration: tuple[int, int] = (2002, 2012), holdout: tuple[int, int] = (2013, 2018), blocks: Sequence[tuple[int, int]] = ((2013, 2015), (2016, 2018)),
    min_overall: float = 0.35, min_improvement: float = 0.10, min_period: float = 0.30, min_block: float = 0.20, min_coverage: float = 0.95,
) -> DataFrame:
    """A locked proxy and its benchmark on the keys that have a valid target, without a look at any target's value; five gates for the proxy.

    ``truth`` has the keys and ``truth``. Joins are one to one and enforced; no eligible row, or an eligible key without truth, stops the job.
    That no value is read can be shown by ``operators.lineage``. A correlation without rows is null and its gate fails.
    """
    keys = list(keys)
    eligible = targets.filter((F.col("horizon_months") == horizon) & F.col("target_valid")).select(*keys)
    known = truth.select(*keys, F.col("truth").alias("__truth"))
    joined = checked_join(checked_join(eligible, candidates.select(*keys, year, selected, benchmark), keys, "left", "one_to_one"), known, keys, "left", "one_to_one")
    lost = F.raise_error("an eligible key has no truth").cast("double")
    rows = joined.withColumn("__truth", F.coalesce(F.col("__truth").cast("double"), lost)).filter(
        F.col(benchmark).isNotNull() & F.col(year).between(calibration[0], holdout[1])
    ).select(year, selected, benchmark, "__truth")
    periods = {"overall": (calibration[0], holdout[1]), "calibration": calibration, "held_out": holdout, **{f"block{k}": b for k, b in enumerate(blocks, 1)}}
    found = proxy_metrics(rows, [selected, benchmark], "__truth", periods, year)
    wide = found.groupBy("candidate").agg(*[F.max(F.when(F.col("period") == p, F.col("spearman"))).alias(f"{p}_spearman") for p in periods])
    if rows.isEmpty():
        raise ValueError("no eligible row has the benchmark")
    sizes = rows.agg(F.count(F.lit(1)).alias("__n"), F.count(selected).alias("__s"))
    bench = wide.filter(F.col("candidate") == benchmark).select(F.col("overall_spearman").alias("__b"))
    own = F.col("candidate") == selected
    out = wide.join(F.broadcast(sizes)).join(F.broadcast(bench)).select(  # one row each
        "candidate", *[f"{p}_spearman" for p in periods], F.when(own, F.col("__s")).otherwise(F.col("__n")).alias("eligible_rows"),
        (F.when(own, F.col("__s")).otherwise(F.col("__n")) / F.col("__n")).alias("coverage_vs_benchmark"), (F.col("overall_spearman") - F.col("__b")).alias("overall_improvement"),
        (~own).alias("is_benchmark"),
    )
    gate = lambda c: F.when(own, F.coalesce(c, F.lit(False)))
    stable = lambda names, low: F.least(*[F.coalesce(f"{n}_spearman", F.lit(-2.0)) for n in names]) >= low
    return out.withColumns(
        {
            "overall_gate": gate(F.col("overall_spearman") >= min_overall), "improvement_gate": gate(F.col("overall_improvement") >= min_improvement),
            "period_gate": gate(stable(["calibration", "held_out"], min_period)), "block_gate": gate(stable([f"block{k}" for k in range(1, len(blocks) + 1)], min_block)),
            "coverage_gate": gate(F.col("coverage_vs_benchmark") >= min_coverage),
        }
    )


def subgroup_metrics(predictions: DataFrame, probability: str, event: str, firm: str = "gvkey", groups: Sequence[str] = ()) -> DataFrame:
    """Discrimination and Brier score by decade and by broad industry, within ``groups`` such as the cause of an exit."""
    dims = F.array(
        F.struct(F.lit("decade").alias("dimension"), (F.floor(F.col("year") / 10) * 10).cast("string").alias("value")),
        F.struct(F.lit("sic1").alias("dimension"), F.col("sic1").cast("string").alias("value")),
    )
    keys = [*groups, "dimension", "value"]
    long = predictions.filter(F.col(probability).isNotNull() & F.col(event).isNotNull()).select("*", F.inline(dims))
    m = prediction_metrics(long, keys, probability, event)
    firms = long.groupBy(*keys).agg(F.countDistinct(firm).alias("issuers"))
    return m.join(firms, keys).select(*keys, "rows", "issuers", "events", "roc_auc", "brier_score")


def _numbered_clusters(sums: DataFrame, cluster: str) -> tuple[DataFrame, int]:
    """Clusters numbered 0..G-1 without a global sort: by hash bucket, then by name."""
    bucketed = sums.withColumn("__b", F.pmod(F.xxhash64(cluster), F.lit(4096)))
    per = bucketed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # 4096 rows
    offset = per.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = W.partitionBy("__b").orderBy(cluster)
    numbered = bucketed.join(F.broadcast(offset), "__b").withColumn("idx", F.col("__off") + F.row_number().over(inside) - 1).drop("__b", "__off")
    return numbered, sums.count()


def bootstrap_power(rows: DataFrame, multipliers: Sequence[float], replicates: int, seed: int, fraction: float, cluster: str = "gvkey",
                    observable: str = "observable", injected: str = "injected", outcome: str = "outcome") -> DataFrame:
    """Cluster bootstrap of detection rates and rank correlations over effect sizes.

    A draw is a seeded hash, so a lost task redraws the same clusters.  The slopes need
    only nine sums per cluster; for the rank correlations each variable is sorted once, with the multiplicities
    of all replicates as a vector per row (``operators.power``).  Every draw of a cluster counts as a cluster of its own.
    """
    spark = rows.sparkSession
    o, i = F.col("o"), F.col("i")
    base = rows.select(F.col(cluster).alias("cluster"), F.col(observable).alias("o"), F.col(injected).alias("i"), (F.col(outcome) - fraction * F.col(injected)).alias("e")).dropna()
    sums = base.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o").alias("so"), F.sum("i").alias("si"), F.sum("e").alias("se"), F.sum(o * o).alias("soo"),
        F.sum(i * i).alias("sii"), F.sum(o * F.col("e")).alias("soe"), F.sum(i * F.col("e")).alias("sie"), F.sum(o * i).alias("soi"),
    )
    numbered, count = _numbered_clusters(sums, "cluster")
    found = power.bootstrap(base, numbered, count, multipliers, replicates, seed, fraction)
    return spark.createDataFrame(found, "kind string, multiplier double, rate double, median_slope double, median_rank_ic double, replicates int")  # a row a line


def power_gates(power: DataFrame) -> DataFrame:
    """Per multiplier: the five gates, in one row."""
    false_rate = power.filter("kind = 'null'").select(F.col("rate").alias("null_rate"))
    pick = lambda k, col: F.max(F.when(F.col("kind") == k, F.col(col)))
    wide = power.filter("kind <> 'null'").groupBy("multiplier").agg(
        pick("oracle", "rate").alias("oracle_detection_rate"), pick("observable", "rate").alias("observable_detection_rate"),
        pick("oracle", "median_rank_ic").alias("median_oracle_rank_ic"), pick("observable", "median_rank_ic").alias("median_observable_rank_ic"),
    )
    return wide.join(F.broadcast(false_rate)).withColumn(
        "passes",
        F.coalesce((F.col("oracle_detection_rate") >= 0.8) & (F.col("observable_detection_rate") >= 0.8) & (F.col("null_rate") <= 0.10)
                   & (F.col("median_oracle_rank_ic") >= 0.04) & (F.col("median_observable_rank_ic") >= 0.01), F.lit(False)),
    )


def expected_fraction(horizon: int = 6, decay: int = 12) -> float:
    """Share of an injection, which fades by a quarter power of e a month, that falls into the horizon."""
    faded = [math.exp(-k / 4.0) for k in range(decay)]
    return sum(faded[:horizon]) / sum(faded)


def calibrate_power(rows: DataFrame, multipliers: Sequence[float], calibration_replicates: int, evaluation_replicates: int, fraction: float, seeds=(12000, 22000)) -> DataFrame:
    """Smallest multiplier that passes every gate, then the same gates for it on fresh draws.

    A row per calibrated multiplier, ``selected`` on the chosen one, and, if there is one, a row of stage ``evaluation``, whose
    ``passes`` is the verdict. The multipliers must be positive, the draws at least two each.
    """
    if not multipliers or min(multipliers) <= 0 or min(calibration_replicates, evaluation_replicates) < 2:
        raise ValueError("multipliers must be positive, and draws at least two")
    base = cut(rows)
    first = cut(power_gates(bootstrap_power(base, multipliers, calibration_replicates, seeds[0], fraction)).withColumn("stage", F.lit("calibration")))
    chosen = first.filter("passes").agg(F.min("multiplier")).first()[0]
    first = first.withColumn("selected", F.coalesce(F.col("multiplier") == F.lit(chosen), F.lit(False)))
    if chosen is None:
        return first
    second = power_gates(bootstrap_power(base, [chosen], evaluation_replicates, seeds[1], fraction)).withColumn("stage", F.lit("evaluation"))
    return first.unionByName(second.withColumn("selected", F.lit(True)))


def realized_check(rows: DataFrame, candidate: str, truth: str, oracle: str, outcome: str, cluster: str = "gvkey") -> DataFrame:
    """Rank correlations and clustered slopes of a candidate, the truth and the outcome."""
    pairs = F.array(
        F.struct(F.lit("candidate_truth").alias("pair"), F.col(candidate).alias("x"), F.col(truth).alias("y")),
        F.struct(F.lit("candidate_outcome").alias("pair"), F.col(candidate).alias("x"), F.col(outcome).alias("y")),
        F.struct(F.lit("oracle_outcome").alias("pair"), F.col(oracle).alias("x"), F.col(outcome).alias("y")),
    )
    long = rows.select(F.col(cluster).alias("cluster"), F.inline(pairs))
    return spearman(long, ["pair"], "x", "y").join(clustered_slope(long, ["pair"], "y", "x", "cluster"), "pair").withColumn(
        "p_value", student_p("t", (F.col("clusters") - 1).cast("double"))
    )


def recovery(rows: DataFrame, keys: Sequence[str], estimate: str, truth: str) -> DataFrame:
    """Agreement of an estimate with the truth: rows, correlation, slope, R2, rank correlation."""
    keys = list(keys)
    ok = rows.filter(F.col(estimate).isNotNull() & F.col(truth).isNotNull())
    line = ok.groupBy(*keys).agg(
        F.corr(estimate, truth).alias("pearson"), F.regr_slope(F.col(truth), F.col(estimate)).alias("slope"), F.regr_r2(F.col(truth), F.col(estimate)).alias("r_squared")
    )
    return line.join(spearman(ok, keys, estimate, truth), keys)
