"""Statistics over columns and histograms. Exact percentiles go through a histogram of distinct values, so no
task or array ever holds all values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.ordered import running_total


def mean(value: Column) -> Column:
    """Mean; 0 for no values."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def ref_stddev(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, ref_stddev = sqrt(sum of squared deviations) / n (the engine's own definition, not the usual
    one), and stddev_pop beside it. Null values are left out; all are 0 for no values."""
    n, variance = F.count(column), F.coalesce(F.var_pop(column), F.lit(0.0))
    return df.agg(
        mean(F.col(column)).alias("mean"),
        F.when(n > 0, F.sqrt(variance * n) / n).otherwise(F.lit(0.0)).alias("ref_stddev"),
        F.sqrt(variance).alias("stddev_pop"),
    )


def value_ranks(df: DataFrame, column: str, frequency: str | None = None) -> DataFrame:
    """Histogram with running totals: (value, frequency, before). Nulls are left out."""
    weight = F.sum(frequency) if frequency else F.count(F.lit(1))
    histogram = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(weight.cast("long").alias("frequency"))
    return running_total(histogram, ["value"], "frequency", "before", inclusive=False)


def _at(df: DataFrame, column: str, wanted: list[tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """One row: for each name the sorted value at an index computed from n, clamped to 0..n-1; null for no values."""
    n = df.agg(F.count(column)).scalar()
    picks = []
    for name, index in wanted:
        i = F.greatest(F.lit(0), F.least(index(F.col("n")), F.col("n") - 1))
        picks.append(F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("frequency")), F.col("value"))).alias(name))
    return value_ranks(df, column).withColumn("n", n).agg(*picks)


def median(df: DataFrame, column: str) -> DataFrame:
    """The sorted value at index n div 2."""
    return _at(df, column, [("median", lambda n: F.floor(n / 2))])


def percentile_index_int(p: int) -> Callable[[Column], Column]:
    """Index that makes low and high percentiles mirror images."""
    if p < 50:
        return lambda n: (F.floor(F.lit(p / 100) * n) - 1).cast("long")
    return lambda n: (n - F.floor(F.lit((100 - p) / 100) * n)).cast("long")


def percentile_index_float(p: int) -> Callable[[Column], Column]:
    return lambda n: F.floor(F.lit(p / 100) * (n - 1)).cast("long")


#: The percentiles of a report.
REPORT = (5, 25, 30, 40, 50, 60, 70, 75, 95)


def percentiles(df: DataFrame, column: str, kind: str = "int", ps: tuple[int, ...] = REPORT) -> DataFrame:
    """One row p5, p25, ... of a column, by the integer rule or by the float rule."""
    index = percentile_index_int if kind == "int" else percentile_index_float
    return _at(df, column, [(f"p{p}", index(p)) for p in ps])


def weighted_percentiles(df: DataFrame, value: str, frequency: str, ps: tuple[int, ...] = REPORT) -> DataFrame:
    """Rows (percentile, value) of a histogram: the first value whose running total reaches round(p/100 * total)."""
    ranks = value_ranks(df, value, frequency).withColumn("total", df.where(F.col(value).isNotNull()).agg(F.sum(frequency).cast("long")).scalar())
    before, after = F.col("before"), F.col("before") + F.col("frequency")

    def reached(p: int) -> Column:
        target = F.round(F.lit(p / 100.0) * F.col("total"))
        return F.when((before <= target) & (target <= after), F.lit(p))

    hits = ranks.select("value", F.explode(F.array_compact(F.array(*[reached(p) for p in ps]))).alias("percentile"))
    return hits.groupBy("percentile").agg(F.min("value").alias("value"))
