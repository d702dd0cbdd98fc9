"""Global order without a single task: range partitions from sampled quantiles, then offsets of whole partitions.

The range partitions are written once to the shared folder, with the place of every row in it. Both the sums of whole
partitions and the rows themselves are read from there, so they can't disagree: planned twice, the exchange may be
sampled and coalesced differently each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import checkpointed

#: Bits of a place that count rows inside a partition; the partition's number is in the bits above.
PLACE_BITS = 33


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """df, written, with _place, which grows with the order: the number of the range partition and that of the row in
    it, from 0."""
    return checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))


def _offsets(rows: DataFrame, amount: Column) -> DataFrame:
    """(_part, _offset): the amount of all partitions before each; one row a partition, the only thing broadcast."""
    sums = rows.groupBy(F.shiftright("_place", PLACE_BITS).alias("_part")).agg(amount.alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_offset"))


def running_total(df: DataFrame, order: list[str], value: str, out: str, inclusive: bool = True) -> DataFrame:
    """df with the running total of `value` in the order of `order`, as long; a null value adds nothing. `order`
    should be unique for a defined result among ties. An empty table stays empty."""
    rows = placed(df, order).withColumn("_part", F.shiftright("_place", PLACE_BITS))
    amount = F.coalesce(F.col(value), F.lit(0))
    within = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = rows.join(F.broadcast(_offsets(rows, F.sum(amount))), "_part", "left")
    return joined.withColumn(out, (F.col("_offset") + F.coalesce(F.sum(amount).over(within), F.lit(0))).cast("long")).drop("_part", "_place", "_offset")


def row_index(df: DataFrame, order: list[str], out: str = "row_index") -> DataFrame:
    """Number of each row from 0 in the order of `order`, each number once, ties in any order. The rows are exchanged
    once: their place in the written partition and the sizes of the partitions before it make the number."""
    rows = placed(df, order).withColumn("_part", F.shiftright("_place", PLACE_BITS))
    within = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    joined = rows.join(F.broadcast(_offsets(rows, F.count(F.lit(1)))), "_part", "left")
    return joined.withColumn(out, F.col("_offset") + within).drop("_part", "_place", "_offset")


def block_round_robin(df: DataFrame, order: list[str], block: int, stores: int) -> DataFrame:
    """Rows dealt to stores in blocks: store = (i div block) mod stores, and the index of the row in its store."""
    i, size, n = F.col("row_index"), F.lit(block), F.lit(stores)
    number = F.floor(i / size)
    return row_index(df, order).withColumn("store_index", (number % n).cast("int")).withColumn(
        "index_in_store", (F.floor(number / n) * size + i % size).cast("long")
    )


def store_sizes(total: int, stores: int, block: int) -> list[int]:
    """Rows of each store under block_round_robin, without looking at the rows."""
    full, rest = divmod(total, block)
    sizes = [(full // stores + (i < full % stores)) * block for i in range(stores)]
    if rest:
        sizes[full % stores] += rest
    return sizes
