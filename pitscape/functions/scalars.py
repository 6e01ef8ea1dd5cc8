"""Row-level column expressions: guarded arithmetic, calendar rules, codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value) -> Column:
    """NaN and infinities become NULL, which is the only marker of a missing number."""
    value = _c(value).cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def positive_ratio(numerator, denominator) -> Column:
    """Ratio defined only over a strictly positive denominator."""
    n, d = _c(numerator), _c(denominator)
    return F.when(d > 0, finite(n / d))


def finite_ratio(numerator, denominator) -> Column:
    """Ratio that rejects a zero denominator but keeps negative ones."""
    return finite(F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double")))


def month_end(value) -> Column:
    return F.last_day(_c(value))


def strictly_later_month_end(stamp) -> Column:
    """First month-end strictly after a time stamp; a month-end day moves on a month."""
    day = _c(stamp).cast("date")
    end = F.last_day(day)
    return F.when(day < end, end).otherwise(F.last_day(F.add_months(end, 1)))


def completed_months(later, earlier) -> Column:
    a, b = _c(later), _c(earlier)
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def industry_pair(sich) -> tuple[Column, Column]:
    """(two-digit, one-digit) industry codes."""
    two = F.floor(_c(sich) / 100)
    return two.cast("int"), F.floor(two / 10).cast("int")


def clip(value, low: float, high: float) -> Column:
    """NULL stays NULL; ``least``/``greatest`` alone would replace it by the bound."""
    v = _c(value)
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(high)), F.lit(low)))


def logit(probability, eps: float) -> Column:
    p = clip(probability, eps, 1.0 - eps)
    return F.log(p / (1.0 - p))


def constant_hazard(survival, years, eps: float) -> Column:
    return -F.log(clip(survival, eps, 1.0)) / _c(years)


def composite_key(*parts) -> Column:
    return F.concat_ws("|", *[_c(p).cast("string") for p in parts])


def letter_label(index) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, as spreadsheet columns; -1 (noise) stays NULL."""
    i = _c(index).cast("int")
    # bijective base 26: take the last letter, go on with what is left; seven letters hold every int
    step = lambda a, _: F.when(a["n"] < 0, a).otherwise(
        F.struct((F.floor(a["n"] / 26) - 1).cast("long").alias("n"), F.concat(F.char(a["n"] % 26 + 65), a["s"]).alias("s"))
    )
    start = F.struct(i.cast("long").alias("n"), F.lit("").alias("s"))
    return F.when(i < 0, F.lit(None).cast("string")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda a: a["s"]))


def three_way_digit(value, low, high, missing: int = 1) -> Column:
    v = _c(value)
    return (
        F.when(v.isNull(), F.lit(missing))
        .when(v < low, F.lit(0))
        .when(v > high, F.lit(2))
        .otherwise(F.lit(1))
    )


def cell_code(columns, low: float = -0.5, high: float = 0.5) -> Column:
    """One base-3 digit per axis; a missing axis counts as the middle."""
    return F.concat(*[three_way_digit(c, low, high).cast("string") for c in columns])


def decade(year) -> Column:
    return (F.floor(_c(year) / 10) * 10).cast("int")


def row_mean(columns, minimum: int) -> Column:
    """Mean over the non-missing columns, NULL under ``minimum`` of them."""
    cols = [_c(c) for c in columns]
    count = row_count(cols)
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(count >= minimum, total / count)


def row_count(columns) -> Column:
    return reduce(lambda a, b: a + b, [_c(c).isNotNull().cast("int") for c in columns])


def when_all(*conditions) -> Column:
    """Conjunction in which NULL counts as false."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])
