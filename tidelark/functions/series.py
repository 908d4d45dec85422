"""Columns over ordered series: trailing windows, ranks, runs, business days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

C = Column | str


def series() -> WindowSpec:
    """The series of each pair in order of dates; a function, as a window needs a session."""
    return Window.partitionBy("pair").orderBy("date")


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trailing(n: int, lag: int = 0, by: WindowSpec | None = None) -> WindowSpec:
    return (by or series()).rowsBetween(1 - n - lag, -lag)


def rolling(how, x: C, n: int, least: int | None = None, lag: int = 0, by: WindowSpec | None = None) -> Column:
    """how(x) over n rows up to ``lag`` rows ago; null with fewer than ``least`` values (default: all n)."""
    w = trailing(n, lag, by)
    return F.when(F.count(x).over(w) >= (n if least is None else least), how(x).over(w))


def rolling2(how, x: C, y: C, n: int, least: int | None = None, by: WindowSpec | None = None) -> Column:
    w = trailing(n, 0, by)
    both = F.when(_c(x).isNotNull() & _c(y).isNotNull(), 1)
    return F.when(F.count(both).over(w) >= (n if least is None else least), how(x, y).over(w))


def rolling_percentile(x: str, n: int, least: int | None = None, by: WindowSpec | None = None) -> Column:
    """100 times the share of the other rows of the window that lie below the last; null rows count as not below.

    The share is of rows, so that a window reaching back over nulls is not shortened; a null last
    value gives null. x names a column.
    """
    w = trailing(n, 0, by)
    held = F.collect_list(F.struct(F.col(x).alias("x"))).over(w)
    below = F.size(F.filter(held, lambda e: e["x"] < F.col(x)))
    ok = (F.count(x).over(w) >= (max(20, n // 4) if least is None else least)) & F.col(x).isNotNull()
    return F.when(ok, F.try_divide(100.0 * below, F.size(held) - 1))


def lagged_z(x: C, n: int, least: int | None = None, by: WindowSpec | None = None) -> Column:
    """x less the mean of the n rows before it, in their standard deviations."""
    least = max(60, n // 4) if least is None else least
    return F.try_divide(_c(x) - rolling(F.avg, x, n, least, 1, by), rolling(F.stddev_samp, x, n, least, 1, by))


def with_runs(df: DataFrame, value: str, out: str = "run", keys: list[str] | None = None, order: str = "date") -> DataFrame:
    """Number the uninterrupted runs of ``value``."""
    w = Window.partitionBy(*(keys or ["pair"])).orderBy(order)
    return df.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)).withColumn(out, F.sum("_new").over(w)).drop("_new")


def business_days(date: C) -> Column:
    """Business days from Monday 1970-01-05 up to, not including, the date; differences count business days."""
    d = F.datediff(_c(date), F.lit("1970-01-05").cast("date"))
    return (F.floor(d / 7) * 5 + F.least(F.pmod(d, F.lit(7)), F.lit(5))).cast("long")


def average_rank(x: C, keys: list[str]) -> Column:
    """Rank from 1; ties share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2.0



def runs_of_days(df: DataFrame, mask: str, out: str = "run", least_gap: int = 1) -> DataFrame:
    """The days of a mask, numbered by run: a new one starts where more than ``least_gap`` rows of the series have passed since the last."""
    at = df.withColumn("_i", F.row_number().over(series())).where(mask)
    return at.withColumn("_new", (F.coalesce(F.col("_i") - F.lag("_i").over(series()), F.lit(1 << 30)) > least_gap).cast("int")).withColumn(out, F.sum("_new").over(series())).drop("_i", "_new")
