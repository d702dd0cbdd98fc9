"""Distinct counts from log-log registers, for groups and all their combinations.

A register holds the largest rank (leading zeros plus one) of the hashes that fall to it. Registers of two partial
results merge by the larger one, so any split of the data, by day or by task, gives the same registers. They are
rows (group, register, rank): one exchange places all rows of a register together, after which every coarser
grouping is a maximum inside the partition, without another exchange.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the number of registers.
PRECISION = 12


def standard_error(precision: int = PRECISION) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / math.sqrt(1 << precision)


def with_register(df: DataFrame, value: Column, precision: int = PRECISION) -> DataFrame:
    """Adds register and rank of the value's MD5: the first `precision` bits, a multiple of 4, name the register,
    the next 52 bits give the rank."""
    if precision % 4 or not 4 <= precision <= 24:
        raise ValueError("precision must be 4, 8, 12, 16, 20 or 24")
    digits = precision // 4
    x = F.conv(F.col("_h").substr(digits + 1, 13), 16, 10).cast("long")
    rank = F.when(x == 0, F.lit(53)).otherwise(F.lit(53) - F.length(F.bin(x)))
    return df.withColumn("_h", F.md5(value.cast("binary"))).select(
        *df.columns, F.conv(F.col("_h").substr(1, digits), 16, 10).cast("int").alias("register"), rank.cast("byte").alias("rank")
    )


def registers(df: DataFrame, groups: list[str], value: str, precision: int = PRECISION) -> DataFrame:
    """(groups..., register, rank): the mergeable partial result. Null values aren't counted; null groups are
    groups. Map tasks send at most one row for each group and register. Groups can't be named register or rank."""
    if clash := {"register", "rank"} & {*groups}:
        raise ValueError(f"reserved names: {sorted(clash)}")
    rows = with_register(df.where(F.col(value).isNotNull()).select(*groups, value), F.col(value), precision)
    return rows.groupBy(*groups, "register").agg(F.max("rank").alias("rank"))


def merge(parts: DataFrame, more: DataFrame, groups: list[str]) -> DataFrame:
    """Union of two partial results."""
    return parts.unionByName(more).groupBy(*groups, "register").agg(F.max("rank").alias("rank"))


def estimate(parts: DataFrame, groups: list[str], precision: int = PRECISION) -> DataFrame:
    """(groups..., distinct, std_error) by the improved raw estimator: registers still at zero enter through the
    series sigma, which makes it unbiased for small and large counts alike."""
    m = 1 << precision
    used, inverse = F.count(F.lit(1)), F.sum(F.pow(F.lit(2.0), -F.col("rank")))
    sums = parts.groupBy(*groups).agg(used.alias("_used"), inverse.alias("_inverse"))
    empty = (F.lit(m) - F.col("_used")) / F.lit(float(m))
    sigma = empty
    for k in range(1, 20):
        sigma = sigma + F.pow(empty, F.lit(float(2**k))) * float(2 ** (k - 1))
    value = F.lit(m * m / (2 * math.log(2))) / (F.lit(float(m)) * sigma + F.col("_inverse"))
    return sums.select(*groups, F.round(value).cast("long").alias("distinct"), F.lit(standard_error(precision)).alias("std_error"))


def distinct_by_all(df: DataFrame, groups: list[str], value: str, precision: int = PRECISION) -> DataFrame:
    """(level, groups..., distinct, std_error) for every non-empty subset of groups; level names the columns that
    count, the others are null. An empty table gives no rows."""
    base = registers(df, groups, value, precision).repartition("register")
    kinds = {f.name: f.dataType for f in base.schema}
    out = None
    for size in range(len(groups), 0, -1):
        for own in combinations(groups, size):
            part = base if size == len(groups) else base.groupBy("register", *own).agg(F.max("rank").alias("rank"))
            counted = estimate(part, list(own), precision).select(
                F.lit("+".join(own)).alias("level"), *[(F.col(g) if g in own else F.lit(None).cast(kinds[g])).alias(g) for g in groups], "distinct", "std_error"
            )
            out = counted if out is None else out.unionByName(counted)
    return out
