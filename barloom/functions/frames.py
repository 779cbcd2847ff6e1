"""Column factories over one block: full-frame rolling aggregates, shifts and safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.operators.blocks import bw, running, span, trailing


def C(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(C(a) if not isinstance(a, (int, float)) else F.lit(float(a)), C(b))


def lag(x, k: int = 1) -> Column:
    return F.lag(C(x), k).over(bw())


def lead(x, k: int = 1) -> Column:
    return F.lead(C(x), k).over(bw())


def diff(x) -> Column:
    return C(x) - lag(x)


def pct(x, k: int = 1) -> Column:
    return div(C(x) - lag(x, k), lag(x, k))


def full(x, n: int, value: Column) -> Column:
    """``value`` only where the last n observations of x are all present."""
    return F.when(F.count(C(x)).over(trailing(n)) == n, value)


def sma(x, n: int) -> Column:
    return full(x, n, F.avg(C(x)).over(trailing(n)))


def rsum(x, n: int) -> Column:
    return full(x, n, F.sum(C(x)).over(trailing(n)))


def rmax(x, n: int) -> Column:
    return full(x, n, F.max(C(x)).over(trailing(n)))


def rmin(x, n: int) -> Column:
    return full(x, n, F.min(C(x)).over(trailing(n)))


def rstd(x, n: int) -> Column:
    return full(x, n, F.stddev_samp(C(x)).over(trailing(n)))


def sma1(x, n: int) -> Column:
    """Rolling mean that accepts short frames."""
    return F.avg(C(x)).over(trailing(n))


def wma(x, n: int) -> Column:
    """Linearly weighted mean from two framed sums."""
    s = F.sum(C(x)).over(trailing(n))
    weighted = F.sum(C(x) * F.col("_i")).over(trailing(n))
    return full(x, n, (weighted - (F.col("_i") - n) * s) / F.lit(n * (n + 1) / 2))


def slope(x, n: int) -> Column:
    return F.regr_slope(C(x), F.col("_i").cast("double")).over(trailing(n))


def position_of_first_max(x, n: int) -> Column:
    """1-based position of the first maximum in an n-row frame."""
    return full(x, n, F.array_position(F.collect_list(C(x)).over(trailing(n)), F.max(C(x)).over(trailing(n))))


def position_of_first_min(x, n: int) -> Column:
    return full(x, n, F.array_position(F.collect_list(C(x)).over(trailing(n)), F.min(C(x)).over(trailing(n))))


def flag(cond: Column) -> Column:
    """0/1, with unknown comparisons counting as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def yes(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def strict_pivot(x, k: int, high: bool) -> Column:
    """Greater (or smaller) than each of the k rows before and after."""
    v = C(x)
    agg = F.max if high else F.min
    before, after = agg(v).over(span(-k, -1)), agg(v).over(span(1, k))
    room = (F.count(v).over(span(-k, -1)) == k) & (F.count(v).over(span(1, k)) == k)
    return room & ((v > before) & (v > after) if high else (v < before) & (v < after))


def last_seen(x) -> Column:
    return F.last(C(x), ignorenulls=True).over(running())
