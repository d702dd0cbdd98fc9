"""How often every value occurs, and in how many records, by heavy-light aggregation.

Values that a bounded sample shows to be heavy are broadcast and numbered. Rows of a heavy value never cross an
exchange: each task adds them to its own counters, exact sets of ids and of records kept as words of 64 bits, one bit
for each id or record, so that a row that comes twice counts once. Only those words are exchanged, and words of
different tasks merge by OR. All other rows are exchanged by value, where removing repeats, counting rows and counting
records are local; as no heavy value is among them, no partition outgrows the others. The two count tables are then
united. A heavy value that the sample misses is counted as rightly as any other, only less evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the sample has, about. It decides which way rows take and has no influence on any count.
SAMPLE = 100_000
#: Share of the sample from which a value is heavy, and so 1 / HEAVY values at most.
HEAVY = 1 / 1000
#: log2 of the bits of a word of counters.
WORD = 6


def heavy_values(sample: DataFrame, size: int, share: float = HEAVY) -> list[str | None]:
    """Values, null among them, that hold at least a share of a sample of that size; at most 1 / share of them."""
    counts = sample.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    hits = counts.where(F.col("n") >= max(2, share * size)).orderBy(F.desc("n"), "value").limit(int(1 / share))
    return [r["value"] for r in hits.collect()]


def _counter(kind: int, number: Column) -> Column:
    """The word that a number lies in, and its bit; null has a word of its own."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit((1 << WORD) - 1)).cast("int"))
    return F.struct(F.lit(kind).alias("kind"), F.shiftright(number, WORD).alias("word"), F.coalesce(bit, F.lit(1).cast("long")).alias("bit"))


def count_heavy(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """(value, n, records) of the values in numbered (heavy, no), from counters local to each task."""
    hits = rows.join(F.broadcast(numbered), F.col("value").eqNullSafe(F.col("heavy")))  # at most 1 / HEAVY rows
    both = F.explode(F.array(_counter(0, F.col("id").cast("long")), _counter(1, F.col("record").cast("long"))))
    words = hits.select("no", both.alias("c")).groupBy("no", "c.kind", "c.word").agg(F.bit_or("c.bit").alias("bits"))
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.bit_count("bits")).otherwise(0)).cast("long")
    sums = words.groupBy("no").agg(total(0).alias("n"), total(1).alias("records"))
    return sums.join(F.broadcast(numbered), "no").select(F.col("heavy").alias("value"), "n", "records")


def count_light(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """(value, n, records) of all values that numbered hasn't; one exchange, by value."""
    rest = rows.join(F.broadcast(numbered), F.col("value").eqNullSafe(F.col("heavy")), "left_anti").repartition("value")
    once = rest.groupBy("value", "id").agg(F.min("record").alias("record"))
    each = once.groupBy("value", "record").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("records"))


def frequencies(rows: DataFrame, sample: DataFrame, size: int) -> DataFrame:
    """(value, n, records) of every value of rows (id, record, value): distinct ids, and distinct records that hold
    the value. Ids and records are integers, and rows with the same id are one row. A null value is a value, null
    records are one record, and null ids of one value are one id. An empty table gives no rows. sample is a random
    part of rows, of about `size` rows, with column value."""
    values = heavy_values(sample, size)
    numbered = rows.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], "heavy string, no int")
    rows = rows.select("id", "record", "value")
    return count_heavy(rows, numbered).unionByName(count_light(rows, numbered))


def marked_frequencies(counts: DataFrame, settings: DataFrame, records: DataFrame, common_share: float) -> DataFrame:
    """counts (grp, value, n, records) with rare and common: fewer rows than the group's minimum in settings (grp,
    least; null or none: 1), and records over a share of all records of the group in records (grp, all_records).
    Both tables have one row a group."""
    kept = counts.join(settings, "grp", "left").join(records, "grp", "left")
    return kept.select(
        "grp", "value", "n", "records", (F.col("n") < F.coalesce("least", F.lit(1))).alias("rare"), (F.col("records") > F.col("all_records") * common_share).alias("common")
    )
