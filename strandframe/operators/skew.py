"""Totals by key where a few keys hold most rows.

Rows are range partitioned on the key, a secondary order and a random tie-breaker, by sampled quantiles of all of
these, so a heavy key spreads over as many partitions as its share asks for, and so do rows without an id and one
row that is repeated very often. Each partition folds its sorted run into one partial state a key; only a key at a
partition's edge has several, and they are stitched by comparing the group and the row that end one with those that
begin the next. No task gets more rows than another, whatever the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.session import checkpointed

#: Parts that rows of equal key, group and id can be cut into.
TIES = 1 << 14
#: Totals of a state, and the edges by which states of one key are stitched.
SUMS = ("rows", "subs", "total")
EDGES = ("first_sub", "last_sub", "first_row", "last_row", "first_measure")


def _changed(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """For each row but the first: whether it differs from the one before; nulls are equal."""
    a, b = column[:-1], column[1:]
    differs = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(differs, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, sub, row, measure, part) to states (key, part, SUMS..., EDGES...)."""
    held: list | None = None  # state of the key that is still open
    last: pa.RecordBatch | None = None
    schema = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if schema is None:
            kinds = batch.schema
            types = [kinds.field("key").type, pa.int32(), *[pa.int64()] * 3, *[kinds.field("sub").type] * 2, *[kinds.field("row").type] * 2, pa.int64()]
            schema = pa.schema(list(zip(("key", "part", *SUMS, *EDGES), types, strict=True)))
        head = batch.slice(0, 1) if last is None else last
        rows = pa.Table.from_batches([head, batch]).combine_chunks()
        new_key = _changed(rows["key"])
        new_sub = _changed(rows["sub"]) | new_key
        new_row = _changed(rows["row"]) | new_sub | pc.is_null(rows["row"])[1:].to_numpy(zero_copy_only=False)
        if last is None:
            new_key[0] = new_sub[0] = new_row[0] = True
        measure = np.where(new_row, pc.fill_null(batch.column("measure"), 0).to_numpy(zero_copy_only=False), 0)
        starts = np.flatnonzero(new_key)
        bounds = starts if len(starts) and starts[0] == 0 else np.concatenate([[0], starts])
        sums = [np.add.reduceat(x.astype(np.int64), bounds) for x in (new_row, new_sub, measure)]
        ends = np.append(bounds[1:], batch.num_rows) - 1
        edges = [batch.column(c).take(pa.array(i)) for c, i in (("key", bounds), ("sub", bounds), ("sub", ends), ("row", bounds), ("row", ends))]
        part, amounts = batch.column("part")[0].as_py(), pc.fill_null(batch.column("measure"), 0).take(pa.array(bounds))
        states = pa.Table.from_arrays([edges[0], pa.array(np.full(len(bounds), part, np.int32)), *map(pa.array, sums), *edges[1:], amounts], schema=schema)
        if held is not None:
            if not new_key[0]:  # the open key goes on
                one = states.slice(0, 1).to_pylist()[0]
                for c in SUMS:
                    held[c] += one[c]
                held.update(last_sub=one["last_sub"], last_row=one["last_row"])
                states = states.slice(1)
            if states.num_rows:
                yield from pa.Table.from_pylist([held], schema).to_batches()
                held = None
        if states.num_rows:
            held = states.slice(states.num_rows - 1).to_pylist()[0]
            if states.num_rows > 1:
                yield from states.slice(0, states.num_rows - 1).combine_chunks().to_batches()
        last = batch.slice(batch.num_rows - 1)
    if held is not None:
        yield from pa.Table.from_pylist([held], schema).to_batches()


def totals_by_key(df: DataFrame, key: str, sub: str, row: str, measure: str | None = None) -> DataFrame:
    """(key, rows, subs, total): for each key the distinct rows, the distinct values of `sub`, and the sum of
    `measure` (long) over distinct rows.

    Rows with the same key, sub and row id are one, and the measure of any of them counts; a null row id is never a
    repeat; a null sub is a value like any other; a null key is a key; a null measure adds 0. An empty table gives
    no rows.
    """
    amount = F.col(measure).cast("long") if measure else F.lit(0).cast("long")
    tie = (F.rand(7) * TIES).cast("short")
    rows = df.select(F.col(key).alias("key"), F.col(sub).alias("sub"), F.col(row).alias("row"), amount.alias("measure"), tie.alias("tie"))
    placed = rows.repartitionByRange("key", "sub", "row", "tie").sortWithinPartitions("key", "sub", "row")
    kinds = {f.name: f.dataType for f in rows.schema}
    state = T.StructType(
        [T.StructField("key", kinds["key"]), T.StructField("part", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in SUMS]
        + [T.StructField(c, kinds[c[-3:]]) for c in EDGES[:4]]
        + [T.StructField("first_measure", T.LongType())]
    )
    partial = placed.select("key", "sub", "row", "measure", F.spark_partition_id().alias("part")).mapInArrow(_fold, state)
    edges = F.array_sort(F.collect_list(F.struct("part", *EDGES)))  # one a partition that the key is in
    stitched = partial.groupBy("key").agg(*[F.sum(c).alias(c) for c in SUMS], edges.alias("e"))

    def seam(x: Column, i: Column) -> Column:
        before = F.col("e")[i]
        group = x["first_sub"].eqNullSafe(before["last_sub"])
        again = F.coalesce(group & (x["first_row"] == before["last_row"]), F.lit(False))
        return F.struct(again.cast("long").alias("rows"), group.cast("long").alias("subs"), F.when(again, x["first_measure"]).otherwise(0).alias("total"))

    seams = F.when(F.size("e") > 1, F.transform(F.slice("e", 2, F.size("e")), seam))

    def twice(name: str) -> Column:
        return F.coalesce(F.aggregate(seams.getField(name), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))

    return stitched.select("key", *[(F.col(c) - twice(c)).alias(c) for c in SUMS])


def heavy_keys(totals: DataFrame, share: float) -> DataFrame:
    """Rows of totals that hold at least a share of all rows. totals is written once to the shared folder, then
    summed to one number and filtered."""
    kept = checkpointed(totals)
    return kept.where(F.col("rows") >= kept.agg(F.sum("rows")).scalar() * share)
