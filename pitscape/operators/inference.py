"""Lines and means of many dated series at once, with errors that allow for overlapping horizons."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from pitscape.operators.describe import normal_two_sided_p
from pitscape.operators.recompute import month_number

_NUMBERS = T.ArrayType(T.DoubleType())
_SOLVED = T.StructType([T.StructField("slopes", _NUMBERS), T.StructField("inverse", T.ArrayType(_NUMBERS)), T.StructField("rank", T.IntegerType())])


@F.pandas_udf(_SOLVED)
def _solve(cross: pd.Series, against: pd.Series) -> pd.DataFrame:
    """Slopes and pseudo-inverse from centred cross products; one row per series."""
    out = []
    for c, a in zip(cross, against):
        b = np.asarray(a, dtype=float)
        m = np.asarray(c, dtype=float).reshape(len(b), len(b))
        # columns of equal length before the inverse, so that units do not decide the rank
        size = np.sqrt(np.diag(m))
        scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
        even = m * np.outer(scale, scale)
        inverse = np.linalg.pinv(even, rcond=1e-12, hermitian=True) * np.outer(scale, scale)
        out.append((inverse @ b, list(inverse), int(np.linalg.matrix_rank(even, tol=1e-12, hermitian=True))))
    return pd.DataFrame(out, columns=["slopes", "inverse", "rank"])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _lagged_sums(scores: DataFrame, keys: list[str], size: int, most: int) -> DataFrame:
    """Per group: Bartlett-weighted sums of lagged products of each entry of ``psi``.

    ``at`` is the place of a row on its time axis and ``lags`` the reach of its group, at most ``most``. A row looks
    back over that many places; the products are summed map-side.
    """
    back = W.partitionBy(*keys).orderBy("at").rangeBetween(-most, -1) if most else None
    zero = F.array(*[F.lit(0.0)] * size)
    if back is None:
        reached = scores.withColumn("__back", zero)
    else:
        seen = scores.withColumn("__seen", F.collect_list(F.struct("at", "psi")).over(back))
        weight = lambda e: F.greatest(1 - (F.col("at") - e["at"]) / (F.col("lags") + 1.0), F.lit(0.0))
        reached = seen.withColumn("__back", F.aggregate("__seen", zero, lambda s, e: F.zip_with(s, e["psi"], lambda a, b: a + b * weight(e))))
    product = F.zip_with("psi", "__back", lambda now, before: now * (now + 2 * before))
    summed = reached.withColumn("__p", product).groupBy(*keys).agg(*[F.sum(F.col("__p")[j]).alias(f"__v{j}") for j in range(size)])
    return summed.select(*keys, F.array(*[F.col(f"__v{j}") for j in range(size)]).alias("variances"))


def hac_lines(series: DataFrame, keys: Sequence[str], date: str, y: str, regressors: Sequence[str], lags: Column | int, most: int, by: str = "row") -> DataFrame:
    """(keys, term, coefficient, se, t, p_value, months, r_squared, status): a line per series, errors with Bartlett weights.

    The error of a coefficient is the lagged variance of its influence, a scalar per month, so that no matrix of scores is
    built: three sums per series and one look back of at most ``most`` places. ``lags`` may depend on the keys. ``by`` is "row"
    (a lag is a row, whatever lies between) or "month" (a lag is a calendar month, so a missing month does not shift it).

    Rows without ``y`` are left out; a missing regressor or a repeated date stops the job. Without ``regressors`` the line is the mean.
    ``status``: "fitted", "too_short" (no more rows than terms; no error) or "rank_deficient" (least squares of least norm).
    The p-value is that of the normal distribution. A series has one row per date, so a group is bounded by the calendar.
    """
    keys, xs = list(keys), list(regressors)
    if by not in ("row", "month"):
        raise ValueError("by is row or month")
    size = len(xs) + 1
    order = W.partitionBy(*keys).orderBy(date)
    known = [F.coalesce(F.col(x).cast("double"), F.raise_error(f"a month lacks the regressor {x}").cast("double")) for x in xs]
    place = F.row_number().over(order) if by == "row" else month_number(date)
    again = F.lag(date).over(order) == F.col(date)
    rows = series.filter(F.col(y).isNotNull()).select(
        *keys, date, F.col(y).cast("double").alias("__y"), F.array(*known).cast("array<double>").alias("__x"), (F.lit(lags) if isinstance(lags, int) else lags).cast("int").alias("lags")
    )
    rows = rows.withColumns({"at": F.when(F.coalesce(again, F.lit(False)), F.raise_error("a series repeats a date").cast("int")).otherwise(place)})
    rows = rows.withColumn("lags", F.when(F.col("lags").between(0, most), F.col("lags")).otherwise(F.raise_error("a lag lies outside the greatest reach").cast("int")))
    middle = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("months"), F.avg("__y").alias("__my"), F.array(*[F.avg(F.col("__x")[i]) for i in range(len(xs))]).cast("array<double>").alias("__mx"))
    centred = rows.join(middle, keys).withColumns({"__dx": F.zip_with("__x", "__mx", lambda a, b: a - b), "__dy": F.col("__y") - F.col("__my")})
    k = range(len(xs))
    moments = centred.groupBy(*keys).agg(
        F.array(*[F.sum(F.col("__dx")[i] * F.col("__dx")[j]) for i in k for j in k]).cast("array<double>").alias("__cross"),
        F.array(*[F.sum(F.col("__dx")[i] * F.col("__dy")) for i in k]).cast("array<double>").alias("__against"),
    )
    empty = F.array().cast("array<double>")
    if xs:
        solved = moments.withColumn("__s", _solve("__cross", "__against")).select(*keys, F.col("__s.slopes").alias("__b"), F.col("__s.inverse").alias("__inv"), F.col("__s.rank").alias("__rank"))
    else:
        solved = moments.select(*keys, empty.alias("__b"), F.array().cast("array<array<double>>").alias("__inv"), F.lit(0).alias("__rank"))
    fitted = centred.join(solved, keys).withColumn("__e", F.col("__dy") - _dot(F.col("__dx"), F.col("__b")))
    slope_part = F.transform("__inv", lambda line: _dot(line, F.col("__dx")) * F.col("__e"))
    fitted = fitted.withColumn("__sp", slope_part).withColumn("psi", F.concat(F.array(F.col("__e") / F.col("months") - _dot(F.col("__mx"), F.col("__sp"))), F.col("__sp")))
    variances = _lagged_sums(fitted.select(*keys, "at", "lags", "psi"), keys, size, most)
    left = fitted.groupBy(*keys).agg(F.sum(F.col("__e") * F.col("__e")).alias("__sse"), F.sum(F.col("__dy") * F.col("__dy")).alias("__sst"))
    wide = middle.join(solved, keys).join(variances, keys).join(left, keys)
    short = F.col("months") <= (size if xs else 1)
    status = F.when(short, "too_short").when(F.col("__rank") < len(xs), "rank_deficient").otherwise("fitted")
    coefficients = F.concat(F.array(F.col("__my") - _dot(F.col("__mx"), F.col("__b"))), F.col("__b"))
    named = F.arrays_zip(F.array(*[F.lit(n) for n in ("const", *xs)]).alias("term"), coefficients.alias("coefficient"), F.col("variances").alias("variance"))
    each = wide.withColumn("status", status).select(
        *keys, "months", "status", F.try_divide(F.col("__sst") - F.col("__sse"), F.col("__sst")).alias("r_squared"), F.explode(named).alias("z")
    ).select(*keys, F.col("z.term").alias("term"), F.col("z.coefficient").alias("coefficient"), F.when(F.col("status") != "too_short", F.sqrt(F.greatest(F.col("z.variance"), F.lit(0.0)))).alias("se"), "months", "r_squared", "status")
    return each.withColumn("t", F.try_divide("coefficient", "se")).withColumn("p_value", normal_two_sided_p("t"))


def alpha_columns(lines: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """One row per series from ``hac_lines``: the constant with its error, and a beta per regressor."""
    keys = list(keys)
    terms = F.col("term") == "const"
    pick = lambda c, n: F.max(F.when(terms, F.col(c))).alias(f"{prefix}{n}")
    return lines.groupBy(*keys).agg(
        pick("coefficient", "factor_alpha_monthly"), pick("se", "factor_alpha_hac_standard_error"), pick("t", "factor_alpha_t_stat"), pick("p_value", "factor_alpha_p_value"),
        F.max("r_squared").alias(f"{prefix}factor_r_squared"), F.max("status").alias(f"{prefix}factor_status"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~terms, F.struct("term", "coefficient"))))).alias(f"{prefix}factor_betas"),
    )
