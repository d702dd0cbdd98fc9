"""The most frequent values of a column, by a heavy-light sketch of fixed size.

Each task keeps, for each group, buckets with a few exact counters. A value without a counter votes against its
bucket; when the votes reach a multiple of the smallest counter, that counter is evicted. Evicted and rejected
counts go to a compact array of counters. Tasks merge by recombining buckets: counters of a value add up, the
largest stay, the others join the array. Then for any value: counter <= count <= counter + its array cell.
An exact count of those values whose upper bound reaches the wanted place completes the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import checkpointed, written

BUCKETS, SLOTS, LIGHT = 1024, 4, 1 << 14
#: Votes against a bucket, as a multiple of its smallest counter, that evict it.
EVICT = 8
#: Values counted exactly first, for each group, as a multiple of the number asked for.
MARGIN = 4


class Sketch:
    """Counters of one group in one task; memory is fixed by its sizes."""

    def __init__(self, buckets: int = BUCKETS, slots: int = SLOTS, light: int = LIGHT) -> None:
        self.hash = np.zeros((buckets, slots), np.int64)
        self.votes = np.zeros((buckets, slots), np.int64)
        self.against = np.zeros(buckets, np.int64)
        self.names = np.empty((buckets, slots), object)
        self.light = np.zeros(light, np.int64)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return h & len(self.hash) - 1

    def cell(self, h: np.ndarray) -> np.ndarray:
        return h >> 32 & len(self.light) - 1

    def add(self, h: np.ndarray, n: np.ndarray, names: np.ndarray) -> None:
        """Distinct hashes with counts and names, all at once: round r takes the r-th value of each bucket."""
        b = self.bucket(h)
        order = np.argsort(b, kind="stable")
        b = b[order]
        first = np.r_[0, np.flatnonzero(np.diff(b)) + 1] if len(b) else np.zeros(0, np.int64)
        nth = np.arange(len(b)) - np.repeat(first, np.diff(np.r_[first, len(b)]))
        for r in range(nth.max() + 1 if len(b) else 0):
            at = nth == r
            self._round(b[at], h[order[at]], n[order[at]], names[order[at]])

    def _round(self, b: np.ndarray, h: np.ndarray, n: np.ndarray, names: np.ndarray) -> None:
        held, votes = self.hash[b], self.votes[b]
        same = (held == h[:, None]) & (votes > 0)
        hit = same.any(1)
        self.votes[b[hit], same[hit].argmax(1)] += n[hit]
        slot = votes.argmin(1)
        least = votes[np.arange(len(b)), slot]
        self.against[b[~hit & (least > 0)]] += n[~hit & (least > 0)]
        enters = ~hit & ((least == 0) | (self.against[b] >= EVICT * least))
        out = enters & (least > 0)
        np.add.at(self.light, self.cell(held[np.arange(len(b)), slot][out]), least[out])
        lost = ~hit & ~enters
        np.add.at(self.light, self.cell(h[lost]), n[lost])
        self.against[b[enters]] = 0
        for table, values in ((self.hash, h), (self.votes, n), (self.names, names)):
            table[b[enters], slot[enters]] = values[enters]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, value, hash) to counters (grp, value, hash, -1, n) and array cells (grp, null, null, cell, n)."""
    groups: dict[int | None, Sketch] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        code, values = batch.column("grp").dictionary_encode(null_encoding="encode"), batch.column("value")
        hashes, which = batch.column("hash").to_numpy(), code.indices.to_numpy()
        for i, group in enumerate(code.dictionary.to_pylist()):
            rows = np.flatnonzero(which == i)
            if values.null_count:
                rows = rows[~values.is_null().to_numpy(zero_copy_only=False)[rows]]
            h, first, n = np.unique(hashes[rows], return_index=True, return_counts=True)
            names = values.take(pa.array(rows[first])).to_numpy(zero_copy_only=False)
            groups.setdefault(group, Sketch()).add(h, n, names)
    for group, s in groups.items():
        full, cells = s.votes > 0, np.flatnonzero(s.light)
        k = int(full.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([group] * (k + len(cells)), pa.int32()), pa.array([*s.names[full], *[None] * len(cells)], pa.string()),
                pa.array([*s.hash[full].tolist(), *[None] * len(cells)], pa.int64()), pa.array(np.r_[np.full(k, -1), cells].astype(np.int32)),
                pa.array(np.r_[s.votes[full], s.light[cells]]),
            ],
            ["grp", "value", "hash", "cell", "n"],
        )


def sketch(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged counters (grp, value, votes, light) and array (grp, cell, n) of rows (grp int, value string). Both
    are bounded: BUCKETS * SLOTS and LIGHT rows a group. The value's own cell is in column light."""
    parts = rows.select("grp", "value", F.xxhash64("value").alias("hash")).mapInArrow(_sketched, "grp int, value string, hash long, cell int, n long")
    parts = checkpointed(parts.groupBy("grp", "cell", "value", "hash").agg(F.sum("n").alias("n")))
    bucket, cell = F.col("hash").bitwiseAND(F.lit(BUCKETS - 1)), F.shiftright("hash", 32).bitwiseAND(F.lit(LIGHT - 1)).cast("int")
    ranked = parts.where("cell = -1").withColumn("cell", cell).withColumn(
        "place", F.row_number().over(Window.partitionBy("grp", bucket).orderBy(F.desc("n"), "hash"))
    )
    light = parts.where("cell >= 0").select("grp", "cell", "n").unionByName(ranked.where(F.col("place") > SLOTS).select("grp", "cell", "n"))
    light = light.groupBy("grp", "cell").agg(F.sum("n").alias("n"))
    heavy = ranked.where(F.col("place") <= SLOTS).select("grp", "value", "cell", F.col("n").alias("votes"))
    heavy = heavy.alias("h").join(
        light.alias("l"), F.col("h.grp").eqNullSafe(F.col("l.grp")) & (F.col("h.cell") == F.col("l.cell")), "left"
    ).select("h.grp", "h.value", "h.votes", F.coalesce("l.n", F.lit(0)).alias("light"))
    return heavy, light


def _first(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("p", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("p") <= n).drop("p")


def _counted(rows: DataFrame, chosen: DataFrame, id: str) -> DataFrame:
    """chosen (grp, value, votes, light) with n, the distinct ids of each. Rows only travel if they are chosen: as chosen
    is a small written table, it is sent to all tasks; should it ever be large, the join is an exchange."""
    key = F.xxhash64("grp", "value")
    own = chosen.select(F.col("grp").alias("g"), F.col("value").alias("v"), key.alias("no"))
    hits = rows.join(own, F.col("grp").eqNullSafe(F.col("g")) & (F.col("value") == F.col("v"))).select("no", id).distinct()
    n = hits.groupBy("no").agg(F.count(F.lit(1)).alias("n"))
    return chosen.withColumn("no", key).join(n, "no").select("grp", "value", "n", "votes", "light")


def most_frequent(rows: DataFrame, top: int, id: str) -> DataFrame:
    """(grp, value, n, votes, light): the `top` values of each group with the most distinct ids, ties by value, with
    their exact counts n and what the sketch knew: votes <= rows <= votes + light.

    rows has grp (int, may be null), value (string; a null value is never among the results) and an id, which
    repeated rows share; rows with a null id are told apart by nothing and count once. Repeated rows only raise the
    sketch's bounds, so they are removed in the exact count alone. Nothing is collected: counters, candidates and places
    are tables of at most BUCKETS * SLOTS + LIGHT rows a group.

    Counted exactly are the candidates with the most votes; then, should there be any, the values that the sketch can't
    exclude: those with a counter that may reach the last place, and all in a cell of the array that may. On a column
    so flat that its cells reach the last place, that is an exact count of every value by an exchange.
    """
    rows = rows.select("grp", "value", id)
    heavy, light = (written(t) for t in sketch(rows))
    votes = (F.desc("votes"), F.desc("light"), F.desc("value"))
    chosen = written(_first(heavy, MARGIN * top, *votes))
    exact = written(_counted(rows, chosen, id))
    best = (F.desc("n"), F.asc("value"))
    last = _first(exact, top, *best).groupBy(F.col("grp").alias("g")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    same = F.col("grp").eqNullSafe(F.col("g"))
    place = F.when(F.col("k") == top, F.col("least")).otherwise(F.lit(0))  # 0 where the group has fewer candidates
    open_values = heavy.join(last, same, "left").where(F.col("votes") + F.col("light") >= F.coalesce(place, F.lit(0))).select("grp", "value", "votes", "light")
    known = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("grp", "value")]
    more = written(open_values.alias("a").join(chosen.alias("b"), known, "left_anti"))
    cells = written(light.join(last, same, "left").where(F.col("n") >= F.greatest(F.lit(1), F.coalesce(place, F.lit(0)))).select(F.col("grp").alias("g"), F.col("cell").alias("c")))
    found = exact
    if not more.isEmpty():
        found = found.unionByName(_counted(rows, more, id))
    if not cells.isEmpty():
        cell = F.shiftright(F.xxhash64("value"), 32).bitwiseAND(F.lit(LIGHT - 1)).cast("int")
        hits = rows.where(F.col("value").isNotNull()).join(cells, F.col("grp").eqNullSafe(F.col("g")) & (cell == F.col("c"))).select("grp", "value", id).distinct()
        counts = hits.groupBy("grp", "value").agg(F.count(F.lit(1)).alias("n"))
        # a third of all rows may have one value, but here there is one row a value
        rest = _first(counts, (MARGIN + 1) * top, *best).select("grp", "value", "n", F.lit(0).cast("long").alias("votes"), F.col("n").alias("light"))
        found = found.unionByName(rest.alias("a").join(written(found).alias("b"), known, "left_anti").select("a.*"))
    return _first(found, top, *best)
