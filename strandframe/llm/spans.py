"""Long spans that records share, character for character.

Recompression: rounds that replace runs of one symbol and then pairs of symbols by new symbols. A name is a fixed
hash of what it replaces, so equal text gets equal symbols everywhere without a table of names, and all rounds of a
record are one pass over it. Which symbols a text has is only unsure near its ends; each symbol keeps the interval
of characters that forces it. A window's sign is its highest symbol that the window alone forces, with the
characters that force it, so equal windows have equal signs, wherever they lie.

Windows that follow each other and have one sign are a run. Records are parsed once, into a table of runs. Runs whose
sign only one record has share nothing. Of the others, equal runs are told apart once, by their text: a run that two
records have is shared as a whole, and only what is left, the ends of shared spans, is compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import written

#: Characters of a window.
WIDTH = 40
#: Rounds of renaming; by then no symbol is short enough to lie in a window.
ROUNDS = 12
#: Characters handled at once; longer records are cut into overlapping parts, which changes no sign.
PART = 1 << 18

#: Shared signs that a filter is made of at most, 16 MB for the driver and a filter of 4 MB.
FILTERED = 1 << 21
#: Windows of a run at most; longer ones, as in a repeated letter, are cut.
RUN = 256
#: Positions of a record whose spans are merged at once, before those at the borders are.
BLOCK = 1 << 20

FAR = 1 << 30
#: Odd base of prefix hashes.
BASE = np.uint64(0xD6E8FEB86659FD93)


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """64-bit hash of equally long columns of names."""
    h = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        h = (h ^ (p if isinstance(p, np.ndarray) else np.uint64(p))) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(32))
    return h


class _Symbols:
    """The symbols of one round: name, owning text, and the interval of characters that forces each."""

    def __init__(self, name: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.owner, self.low, self.high = name, owner, low, high

    def sides(self) -> tuple[np.ndarray, ...]:
        """low and high of the symbol before and after each; out of reach where there is none."""
        n = len(self.name)
        joined = self.owner[1:] == self.owner[:-1]
        before_low, before_high, after_low, after_high = (np.full(n, far, np.int32) for far in (-FAR, FAR) * 2)
        before_low[1:][joined], before_high[1:][joined] = self.low[:-1][joined], self.high[:-1][joined]
        after_low[:-1][joined], after_high[:-1][joined] = self.low[1:][joined], self.high[1:][joined]
        return before_low, before_high, after_low, after_high

    def runs(self) -> _Symbols:
        """Every run of equal symbols becomes one; to be a run, it needs to know both neighbours."""
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.owner[1:] != self.owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(self.name)) - 1
        bl, bh, al, ah = self.sides()
        low = np.minimum(np.minimum.reduceat(self.low, first), np.minimum(bl[first], al[last]))
        high = np.maximum(np.maximum.reduceat(self.high, first), np.maximum(bh[first], ah[last]))
        length = last - first + 1
        name = np.where(length > 1, _mix(self.name[first], length.astype(np.uint64), 1), self.name[first])
        return _Symbols(name, self.owner[first], low, high)

    def pairs(self, round_: int) -> _Symbols:
        """A symbol of the left half of all names joins one of the right half that follows it."""
        right = (_mix(self.name, round_ + 2) >> np.uint64(40) & np.uint64(1)).astype(bool)
        head = np.zeros(len(self.name), bool)
        head[:-1] = ~right[:-1] & right[1:] & (self.owner[1:] == self.owner[:-1])
        tail = np.r_[False, head[:-1]]
        bl, bh, al, ah = self.sides()
        low = np.minimum(self.low, np.where(right, bl, al))
        high = np.maximum(self.high, np.where(right, bh, ah))
        name = self.name.copy()
        h = np.flatnonzero(head)
        name[h] = _mix(self.name[h], self.name[h + 1], 0)
        keep = ~tail
        return _Symbols(name[keep], self.owner[keep], low[keep], high[keep])


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, BASE)), np.cumprod(np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64))))


def signs(codes: np.ndarray, owner: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The sign of the window at each character, 0 where no window starts. codes are all texts one after another,
    owner the text of each character, begin and end the bounds of each text."""
    n = len(codes)
    at = np.arange(n, dtype=np.int32)
    letters = _mix(codes.astype(np.uint64), 7)
    powers, back = _powers(1 << n.bit_length())
    with np.errstate(over="ignore"):
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(letters * powers[:n], dtype=np.uint64)]
    open_ = at + width <= end[owner]
    out = np.zeros(n, np.uint64)
    rounds = [_Symbols(letters, owner, at, at + 1)]
    for r in range(ROUNDS):
        nxt = rounds[-1].runs().pairs(r)
        if not (nxt.high - nxt.low <= width).any():
            break
        rounds.append(nxt)
    # intervals of middle length first: they hold enough text to be rare and lie in many windows, so signs are few
    tries = [(s, width * 2 // 5, width * 7 // 10) for s in reversed(rounds)] + [(s, 0, width) for s in reversed(rounds)]
    for s, least, most in tries:
        if not open_.any():
            break
        interval = s.high - s.low
        fits = (interval >= least) & (interval <= most)
        name, low, high = s.name[fits], s.low[fits], s.high[fits]
        text = s.owner[fits]
        first, last = np.maximum(high - width, begin[text]), np.minimum(low, end[text] - width)
        left = np.zeros(n + 1, np.int32)
        np.cumsum(open_, out=left[1:])
        use = last >= first
        use[use] = left[last[use] + 1] > left[first[use]]
        name, first, last, low, high = (x[use] for x in (name, first, last, low, high))
        best = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            forcing = (sums[high] - sums[low]) * back[low]  # hash of the characters that force the symbol
        strength = _mix(name, forcing) | np.uint64(1)
        for d in range(int((last - first).max()) + 1 if len(first) else 0):
            live = first + d <= last
            np.maximum.at(best, first[live] + d, strength[live])
        got = open_ & (best > 0)
        out[got] = best[got]
        open_ &= ~got
    return out


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple[int, int, str]]]:
    """(rec, offset, text) in groups of about PART characters; parts of a long text overlap by width - 1."""
    held, size = [], 0
    for b in batches:
        for rec, text in zip(b.column("rec"), b.column("text"), strict=True):
            rec, text = rec.as_py(), text.as_py()
            for at in range(0, len(text) - width + 1, PART):
                piece = text[at : at + PART + width - 1]
                held.append((rec, at, piece))
                size += len(piece)
                if size >= PART:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows with one sign: sign, rec, position of the first, text of all."""
    for held in _parts(batches, width):
        whole = "".join(p for _, _, p in held)
        sizes = np.array([len(p) for _, _, p in held], np.int32)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        end = np.cumsum(sizes, dtype=np.int32)
        begin = end - sizes
        owner = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
        sign = signs(codes, owner, begin, end, width)
        new = np.ones(len(sign), bool)
        new[1:] = (sign[1:] != sign[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(sign)))
        first, size = first[sign[first] > 0], size[sign[first] > 0]
        cuts = (size - 1) // RUN + 1
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        size = np.minimum(np.repeat(size, cuts) - nth * RUN, RUN)
        first = np.repeat(first, cuts) + nth * RUN
        of = owner[first]
        rec, shift = (np.array([h[i] for h in held], np.int64)[of] for i in (0, 1))
        texts = [whole[a:b] for a, b in zip(first.tolist(), (first + size + width - 1).tolist(), strict=True)]
        columns = (sign[first].view(np.int64), rec, (first - begin[of]).astype(np.int64) + shift, pa.array(texts, pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sign", "rec", "pos", "text"])


def _in_two(df: DataFrame, *key: str, low: str = "rec", high: str = "rec") -> DataFrame:
    """Keys that two different records have; map tasks send one row a key."""
    return df.groupBy(*key).agg(F.min(low).alias("a"), F.max(high).alias("b")).where("a < b").select(*key)


def _spots(sign: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a sign in a filter of `size` bits, a power of two."""
    sign = sign.view(np.uint64)
    return (sign & np.uint64(size - 1)).astype(np.int64), (sign >> np.uint64(32) & np.uint64(size - 1)).astype(np.int64)


def _with_signs(runs: DataFrame, signs_: DataFrame) -> DataFrame:
    """Runs whose sign is in signs_, by an exchange of both. As long as signs_ has FILTERED rows at most, a Bloom filter
    of 16 bits a sign first takes away most other runs where they are read; beyond that the exchange does it all."""
    n = signs_.count()
    if n <= FILTERED:
        size = 1 << max(16, (16 * n).bit_length())
        filter_ = np.zeros(size >> 3, np.uint8)
        for at in _spots(signs_.toArrow().column("sign").to_numpy(), size):
            np.bitwise_or.at(filter_, at >> 3, (1 << (at & 7)).astype(np.uint8))
        sent = runs.sparkSession.sparkContext.broadcast(filter_)

        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = sent.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for at in _spots(b.column("sign").to_numpy(), size):
                    keep &= (table[at >> 3] >> (at & 7) & 1).astype(bool)
                yield b.filter(pa.array(keep))

        runs = runs.mapInArrow(likely, runs.schema)
    return runs.join(signs_, "sign", "left_semi")


def shared_stretches(records: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rec, first, last): stretches of positions at which windows of `width` characters start that another record has
    too; they may touch or overlap, each is there once. records has rec (long) and text; nulls and texts under the
    width have none, texts of the same rec are one record and repeated rows change nothing.

    Texts of runs with the same sign and windows are compared by 64 and 128 bits of hash. Joins are on written rows
    and plain keys, so that adaptive execution can split a run or window that a third of all records has.
    """
    rows = records.where(F.col("rec").isNotNull() & (F.length("text") >= width)).select("rec", "text")
    runs = written(rows.mapInArrow(lambda b: _runs(b, width), "sign long, rec long, pos long, text string"))
    signs_ = written(_in_two(runs.select("sign", "rec"), "sign"))
    last = F.length("text") - width
    likely = written(_with_signs(runs, signs_).select("sign", F.xxhash64("text").alias("id"), "rec", "pos", "text"))
    texts = written(likely.groupBy("sign", "id").agg(F.min("rec").alias("a"), F.max("rec").alias("b"), F.first("text").alias("text")))
    own = F.col("a") == F.col("b")  # in one record only
    whole = texts.where(~own).select("sign", "id", F.array(F.struct(F.lit(0).alias("i"), last.alias("j"))).alias("at"))

    near = texts.join(texts.where(own).select("sign").distinct(), "sign", "left_semi")
    window = F.col("text").substr(F.col("i") + 1, F.lit(width))
    windows = near.select("sign", "id", "a", "b", "text", F.explode(F.sequence(F.lit(0), last)).alias("i")).select(
        "sign", "id", "a", "b", "i", F.xxhash64(window).alias("h"), F.xxhash64(F.lit(1), window).alias("g")
    )
    common = _in_two(windows, "h", "g", low="a", high="b")
    hits = windows.where(own).join(common, ["h", "g"], "left_semi").groupBy("sign", "id").agg(F.collect_set("i").alias("w"))  # RUN at most
    some = hits.select("sign", "id", F.arrays_zip(_ends("w", -1).alias("i"), _ends("w", 1).alias("j")).alias("at"))
    places = likely.select("sign", "id", "rec", "pos").join(whole.unionByName(some), ["sign", "id"])
    found = places.select("rec", "pos", F.explode("at").alias("s")).select("rec", (F.col("pos") + F.col("s.i")).alias("first"), (F.col("pos") + F.col("s.j")).alias("last"))
    return found.distinct()


def _ends(numbers: str, step: int) -> Column:
    """The numbers of a set whose neighbour on one side isn't in it, in order."""
    return F.array_sort(F.filter(numbers, lambda x: ~F.array_contains(F.col(numbers), x + step)))


def _merge(spots: DataFrame, group: Column, width: int) -> DataFrame:
    """Stretches of a group united where their windows touch."""
    own = Window.partitionBy("rec", "group").orderBy("first")
    so_far = own.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("first") > F.max("last").over(so_far) + width, F.lit(True)).cast("int")
    runs = spots.select("rec", "first", "last", group.alias("group")).withColumn("new", new).withColumn("no", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("rec", "group", "no").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("rec", "group", "first", "last")


def shared_spans(records: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rec, span_start, span_length): the longest stretches of positions, from 0, that lie in shared windows. Merged
    by blocks of a record first; only what reaches a border of a block meets its neighbours."""
    inside = _merge(shared_stretches(records, width), F.floor(F.col("first") / BLOCK), width)
    begin = F.col("group") * BLOCK
    border = (F.col("first") <= begin + RUN + width) | (F.col("last") + width >= begin + BLOCK)
    spans = _merge(inside, F.when(border, F.lit(-1).cast("long")).otherwise(F.col("group")), width)
    size = F.col("last") + width - F.col("first")
    return spans.select("rec", F.col("first").cast("int").alias("span_start"), size.cast("int").alias("span_length"))


def shared_share(records: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rec, n_chars, shared_chars, share): every record, with how much of it others have too. n_chars is 0 for a
    record without text; of several texts of a record the longest counts."""
    sums = shared_spans(records, width).groupBy("rec").agg(F.sum("span_length").alias("s"))
    sizes = records.groupBy("rec").agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("n_chars"))
    shared = F.coalesce("s", F.lit(0)).cast("long")
    return sizes.join(sums, "rec", "left").select("rec", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("share"))
