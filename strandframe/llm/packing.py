"""Filling containers of fixed capacity with whole items.

Exact-complement hashing on the histogram of sizes, which has at most `capacity` entries however many items there
are: for the largest size with items left, the gap is looked up among single sizes, then sums of pairs, then sums of
triples, under the numbers of items that are left; where nothing fills the gap exactly, the largest size that fits is
put in and the rest of the gap is looked up again. Each combination is used as often as its sizes last. Best fit from
the largest size on, without looking for exact complements, is planned beside it, and the plan with fewer containers
is taken. Plans are short lists of patterns; items take their places by rank within size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.encoding import TOKENIZERS, count_column
from strandframe.operators.ordered import PLACE_BITS, placed
from strandframe.session import checkpointed

#: Sizes of one container and the number of such containers.
Pattern = tuple[tuple[int, ...], int]


class _Complements:
    """Sums of one, two and three sizes that are still available."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.pair = np.zeros((len(counts), 2), np.int64)  # a pair for each sum; checked against counts when used
        self.state = np.zeros(len(counts), np.int8)  # 0 to be searched, 1 found, 2 none: sizes only run out
        self.no_triple = np.zeros(len(counts), bool)

    def _find_pair(self, gap: int) -> bool:
        a = np.arange((gap + 1) // 2, gap)
        ok = (self.counts[a] > 0) & (self.counts[gap - a] > 0) & ((a * 2 != gap) | (self.counts[a] > 1))
        if not ok.any():
            return False
        first = a[ok][-1]
        self.pair[gap] = first, gap - first
        return True

    def two(self, gap: int) -> tuple[int, ...] | None:
        if gap < 2 or self.state[gap] == 2:
            return None
        a, b = self.pair[gap]
        stale = self.state[gap] == 0 or min(self.counts[a], self.counts[b]) < 1 + (a == b)
        if stale:
            self.state[gap] = 1 if self._find_pair(gap) else 2
        return tuple(map(int, self.pair[gap])) if self.state[gap] == 1 else None

    def three(self, gap: int) -> tuple[int, ...] | None:
        if self.no_triple[gap]:
            return None
        sizes = np.flatnonzero(self.counts[: max(0, gap - 1)])
        for a in sizes[self.state[gap - sizes] != 2][::-1].tolist():
            self.counts[a] -= 1  # so that a pair can't use the same item
            found = self._find_pair(gap - a)
            self.counts[a] += 1
            if found:
                return (a, *map(int, self.pair[gap - a]))
        self.no_triple[gap] = True
        return None


def exact_first(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns for counts[size], size 1..capacity, by exact complements and the largest that fits."""
    left = counts.astype(np.int64).copy()
    out: list[Pattern] = []
    sums = _Complements(left)

    def exact(gap: int) -> tuple[int, ...] | None:
        return (gap,) if left[gap] else sums.two(gap) or sums.three(gap)

    for size in range(capacity, 0, -1):
        while left[size]:
            pattern, gap = [size], capacity - size
            left[size] -= 1  # an item isn't its own partner
            while gap:
                partners = exact(gap)
                if partners is None:
                    fitting = np.flatnonzero(left[1 : gap + 1])
                    if not len(fitting):
                        break
                    partners = (int(fitting[-1]) + 1,)
                for x in partners:
                    left[x] -= 1
                pattern += partners
                gap -= sum(partners)
            sizes, times = np.unique(pattern, return_counts=True)
            more = int((left[sizes] // times).min())
            left[sizes] -= times * more
            out.append((tuple(sorted(pattern, reverse=True)), 1 + more))
    return out


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns by best fit from the largest size on; open_[gap] holds patterns with that much room."""
    open_: dict[int, list[list]] = {}
    gaps = np.zeros(capacity + 1, np.int64)
    for size in range(capacity, 0, -1):
        n = int(counts[size])
        while n:
            fitting = np.flatnonzero(gaps[size:]) + size
            if len(fitting):
                gap = int(fitting[0])
                pattern, m = open_[gap].pop()
            else:
                per = capacity // size
                gap, pattern, m = capacity, (), max(1, n // per)
            each = min(gap // size, n)
            used = min(m, n // each)
            new = (*pattern, *[size] * each)
            if used < m and pattern:
                open_[gap].append([pattern, m - used])
            if pattern:
                gaps[gap] -= used
            n -= used * each
            open_.setdefault(gap - size * each, []).append([new, used])
            gaps[gap - size * each] += used
    return [(tuple(p), m) for group in open_.values() for p, m in group if m]


def plan(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """The plan with fewer containers, exact complements first on ties."""
    return min((make(counts, capacity) for make in (exact_first, best_fit)), key=lambda p: sum(m for _, m in p))


@dataclass
class Places:
    """For each size, runs of ranks and the containers that they go to."""

    keys: np.ndarray  # size << 40 | first rank
    each: np.ndarray
    base: np.ndarray
    containers: int


def places(patterns: list[Pattern]) -> Places:
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, m in patterns:
        for size in sorted(set(pattern)):
            each = pattern.count(size)
            rows.append((size << 40 | used.get(size, 0), each, base))
            used[size] = used.get(size, 0) + m * each
        base += m
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return Places(table[:, 0], table[:, 1], table[:, 2], base)


def pack(items: DataFrame, id: str, size: str, capacity: int) -> DataFrame:
    """(id, piece, start, size, container_id): every item of `items` in a container of `capacity`.

    An item over the capacity is cut into full pieces and a last one; no other item is cut. An item of size 0 (or
    null size) takes no room and is spread over the containers that exist, or has container 0 if there are none.

    Ranks within a size come from range partitions by size and id: the place of a row in its partition, and the rows
    of its size in the partitions before it, one number for each size that a partition holds, so no more than
    partitions plus sizes. The driver gets the histogram of sizes only, `capacity` numbers at most.
    """
    whole = F.coalesce(F.col(size), F.lit(0)).cast("long")
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(whole / capacity) - 1, F.lit(0)).cast("long"))
    rows = items.select(F.col(id).alias("id"), whole.alias("_n"), F.explode(cuts).alias("piece")).select(
        "id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity).cast("int").alias("size"),
        F.monotonically_increasing_id().alias("_row"),  # tells repeated rows apart, so that they can be split
    )
    spots = placed(checkpointed(rows), ["size", "id", "piece", "_row"]).withColumn("_part", F.shiftright("_place", PLACE_BITS))
    groups = checkpointed(spots.groupBy("size", "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in groups.where("size > 0").groupBy("size").agg(F.sum("_rows").alias("n")).collect():
        counts[r["size"]] = r["n"]
    at = places(plan(counts, capacity))
    before = Window.partitionBy("size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("size", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    ranked = spots.join(F.broadcast(offsets), ["size", "_part"]).withColumn("_rank", F.col("_offset") + F.col("_place"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, ranks, container = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "_rank", "_spread"))
            container %= max(1, at.containers)
            real = sizes > 0
            run = np.searchsorted(at.keys, sizes[real] << 40 | ranks[real], "right") - 1
            container[real] = at.base[run] + (ranks[real] - (at.keys[run] & (1 << 40) - 1)) // at.each[run]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "piece", "start", "size")] + [pa.array(container)], ["id", "piece", "start", "size", "container_id"])

    kind = items.schema[id].dataType.simpleString()
    spread = F.shiftrightunsigned(F.xxhash64("id", "_row"), 2)
    packed = ranked.select("id", "piece", "start", "size", "_rank", spread.alias("_spread"))
    return packed.mapInArrow(assign, f"id {kind}, piece long, start long, size int, container_id long").withColumnRenamed("id", id)


def pack_documents(documents: DataFrame, id: str, text: str, capacity: int = 2048, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, piece, start_token, n_tokens, container_id) of documents, sized in tokens."""
    sized = count_column(documents, id, text, name, folder)
    return pack(sized, id, "n_tokens", capacity).withColumnsRenamed({"start": "start_token", "size": "n_tokens"})
