"""The graph of reads, with k-mers that occur once kept in the read that holds them.

Reads of equal text are one text with their number. A k-mer that occurs once in all texts has the number of its text as
coverage and the neighbours that this text shows, so nothing about it needs an exchange.
Which ones occur more than once is found from fingerprints: reads are written in groups, each group sends the sorted
hashes of its different k-mers to buckets, some three bytes each, and gets one bit back for each. Equal fingerprints of
different k-mers only mark more k-mers than need be, and all marked ones are treated exactly, as vertices with total
coverage and masks. Stretches of unmarked k-mers are chained in place; only their ends meet marked vertices.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import dna, words
from strandframe.functions.words import Windows
from strandframe.operators.graph import MAX_COVERAGE
from strandframe.session import dropped, settled

#: Windows of a bucket of fingerprints, about.
BUCKET = 1 << 20
#: Bits of a fingerprint beside those of its bucket.
PRINT = 32
#: Letters of a group, about: the more, the shorter are differences of its fingerprints.
PART = 1 << 19
#: Bits of a home.
HOME = 24

#: Kinds of rows: marked vertices; the unmarked ones beside them; their arcs to other unmarked ones; outermost arcs of
#: the stretch between; that stretch, if an end of it may go on; if none may; numbers of unmarked vertices by degrees.
MARKED, BESIDE, INNER, END, RUN, WHOLE, CLASS = range(7)
ROW = "kind byte, coverage int, word long, ahead long, behind long, parents byte, children byte, home long, text string"
_FIELDS = [("kind", pa.int8()), ("coverage", pa.int32()), ("word", pa.int64()), ("ahead", pa.int64()), ("behind", pa.int64()), ("parents", pa.int8()), ("children", pa.int8()), ("home", pa.int64()), ("text", pa.string())]
_LETTERS = np.frombuffer(dna.LETTERS.encode(), np.uint8)


class Graph(NamedTuple):
    """marked: vertices (word, coverage, parents, children, home). rows: all other rows, of the kinds above, parted by kind,
    with the number of the text that they come from as coverage."""

    marked: DataFrame
    rows: DataFrame

    def of(self, kind: int) -> DataFrame:
        return self.rows.where(F.col("kind") == kind)

    def without(self, *kinds: int) -> None:
        """Removes rows of some kinds that nothing reads any more."""
        for kind in kinds:
            dropped(self.rows, part=f"kind={kind}")

    def vertices(self) -> DataFrame:
        """Marked vertices and those beside them, of whose masks only the sides that face marked ones are set."""
        beside = self.of(BESIDE).select("word", "coverage", F.col("parents").cast("int"), F.col("children").cast("int"), "home")
        return self.marked.unionByName(beside)

    def classes(self) -> DataFrame:
        """(coverage, parents, children, n): n vertices with that coverage and as many neighbours as the masks say."""
        once = self.of(CLASS).select("coverage", F.col("parents").cast("int"), F.col("children").cast("int"), F.col("word").alias("n"))
        return self.marked.select("coverage", "parents", "children", F.lit(1).cast("long").alias("n")).unionByName(once)


def _hashes(w: Windows) -> np.ndarray:
    return words._mix(w.word)


def _cuts(h: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes, and their number."""
    starts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(h, starts), [len(h)]])


def _pressed(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, with their length, compressed."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _loosed(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(b[4:], int.from_bytes(b[:4], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _plain(a: np.ndarray) -> bytes:
    return a.astype(np.int64).tobytes()


def _read(group: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(_loosed(group["codes"], np.uint8), np.uint8), np.frombuffer(group["sizes"], np.int64)


def _groups(reads: DataFrame, k: int, seq: str, part: int) -> DataFrame:
    """(g, codes, sizes, times): the different texts in groups, with the number of reads of each, written, so that later
    steps see the same groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in words._texts(batches, k, part):
            codes, sizes = words._packed(held)
            times = np.array([n for *_, n in held])
            yield pa.RecordBatch.from_arrays([pa.array([_pressed(codes)]), pa.array([_plain(sizes)]), pa.array([_plain(times)])], ["codes", "sizes", "times"])

    texts = reads.where(F.length(seq) >= k).groupBy(seq).agg(F.least(F.count(F.lit(1)), F.lit(MAX_COVERAGE)).alias("n"))
    rows = texts.select(seq, "n").mapInArrow(run, "codes binary, sizes binary, times binary")
    return settled(rows.withColumn("g", F.monotonically_increasing_id()))


def _prints(groups: DataFrame, k: int, bits: int) -> DataFrame:
    """(g, b, prints): of each group and bucket, differences of the sorted fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.to_pylist():
                h = np.sort(_hashes(Windows(*_read(group), k)))
                h = h[np.diff(h, prepend=~h[:1]) != 0]
                cuts, short = _cuts(h, bits), (h >> np.uint64(64 - PRINT - bits)).astype(np.uint32)
                some = np.flatnonzero(np.diff(cuts))
                made = [_pressed(np.diff(short[cuts[b] : cuts[b + 1]], prepend=np.uint32(0))) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array([group["g"]] * len(made), pa.int64()), pa.array(some, pa.int64()), pa.array(made, pa.binary())], ["g", "b", "prints"])

    return groups.mapInArrow(run, "g long, b long, prints binary")


def _repeated(prints: DataFrame) -> DataFrame:
    """(g, b, bits): for each fingerprint, in order, whether its bucket has it more than once."""

    def out(held: list[dict]) -> pa.RecordBatch:
        each = [np.cumsum(_loosed(x["prints"], np.uint32), dtype=np.uint32) for x in held]
        whole = np.concatenate(each)
        order = np.argsort(whole, kind="stable")
        same = np.diff(whole[order]) == 0
        found = np.zeros(len(whole), bool)
        found[order[1:][same]], found[order[:-1][same]] = True, True
        flags = np.split(found, np.cumsum([len(x) for x in each])[:-1])
        return pa.RecordBatch.from_arrays([pa.array([x["g"] for x in held]), pa.array([x["b"] for x in held]), pa.array([_pressed(np.packbits(x)) for x in flags])], ["g", "b", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["b"] != row["b"]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    return prints.repartition("b").sortWithinPartitions("b").mapInArrow(run, "g long, b long, bits binary")


def _texts_at(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.StringArray:
    sizes = stop - start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(_LETTERS[codes[at]].tobytes()))


def _rows(w: Windows, marked: np.ndarray, times: np.ndarray) -> Iterator[pa.Table]:
    """Rows of a group whose windows are marked or not, each in a text of so many reads."""
    k, home, ahead_side = w.k, w.home() & ((1 << HOME) - 1), w.ahead <= w.back
    first, last = w.nth == 0, w.nth == w.of - 1
    once = ~marked
    before, after = np.roll(marked, 1) & ~first, np.roll(marked, -1) & ~last
    meets_left, meets_right = once & before, once & after
    goes_left, goes_right = once & ~first & ~before, once & ~last & ~after
    word = w.word.view(np.int64)
    x, y = w.rolled(k + 1)
    arc = np.minimum(x.view(np.int64), y.view(np.int64))  # of a window and the next

    def table(kind: int, **columns) -> pa.Table:
        n = len(next(iter(columns.values())))
        return pa.table({name: pa.array(np.full(n, kind, np.int8)) if name == "kind" else columns[name] if isinstance(columns.get(name), pa.Array) else pa.array(columns[name], of, from_pandas=True) if name in columns else pa.nulls(n, of) for name, of in _FIELDS})

    parents, children = w.masks()
    yield table(MARKED, word=word[marked], parents=parents[marked], children=children[marked], home=home[marked], coverage=times[marked])
    number, size = np.unique(times[once] * 4 + (parents[once] > 0) * 2 + (children[once] > 0), return_counts=True)
    yield table(CLASS, word=size, parents=(number >> 1 & 1).astype(np.int8), children=(number & 1).astype(np.int8), coverage=number >> 2)
    near = meets_left | meets_right
    parents, children = w.masks(meets_left, meets_right)
    yield table(BESIDE, word=word[near], parents=parents[near], children=children[near], home=home[near], coverage=times[near])
    for at, inner in ((np.flatnonzero(meets_left & goes_right), 0), (np.flatnonzero(meets_right & goes_left), -1)):
        leaves = ahead_side[at] == (inner == 0)
        yield table(INNER, word=word[at], home=home[at], coverage=times[at], ahead=pa.array(arc[at + inner], mask=~leaves), behind=pa.array(arc[at + inner], mask=leaves))
    start, stop = np.flatnonzero(once & ~goes_left), np.flatnonzero(once & ~goes_right)
    size = stop - start + 1
    for at, arcs, meets in ((start + 1, start, meets_left[start]), (stop - 1, stop - 1, meets_right[stop])):
        some = (size == 3) | (size > 3) & meets
        yield table(END, word=word[at[some]], ahead=arc[arcs[some]], home=home[at[some]], coverage=times[at[some]])
    open_ = meets_left[start] | meets_right[stop]
    for kind, some in ((RUN, open_), (WHOLE, ~open_)):
        a, z = (start + 1)[(size > 3) & some], (stop - 1)[(size > 3) & some]
        yield table(kind, word=w.ahead[a].view(np.int64), ahead=w.ahead[z].view(np.int64), home=home[a], coverage=times[a], text=_texts_at(w.codes, w.at[a], w.at[z] + k))


def graph(reads: DataFrame, k: int, seq: str = "seq", part: int = PART, bucket: int = BUCKET) -> Graph:
    """The graph of reads for k up to words.MOST, from groups of about `part` letters and buckets of about `bucket`
    windows."""
    groups = _groups(reads, k, seq, part)
    bits = (groups.count() * part // bucket).bit_length()
    flags = settled(_repeated(_prints(groups, k, bits)))

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = group.to_pylist()
        w = Windows(*_read(row), k)
        h, of, n = np.unique(_hashes(w), return_inverse=True, return_counts=True)
        sizes = np.diff(_cuts(h, bits))
        bitmaps = {r["b"]: r["bits"] for r in answers.to_pylist()}
        found = [np.unpackbits(_loosed(bitmaps[b], np.uint8))[: sizes[b]].astype(bool) for b in np.flatnonzero(sizes)]
        marked = ((n > 1) | np.concatenate(found))[of] | (w.ahead == w.back)
        # where a long text was cut, the next window lies in another group
        marked |= (w.nth == 0) & w.present[w.at - 1] | (w.nth == w.of - 1) & w.present[w.at + k]
        return pa.concat_tables(_rows(w, marked, np.repeat(np.frombuffer(row["times"], np.int64), w.counts)))

    rows = settled(groups.groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(run, ROW), groups, flags, by="kind")
    marked = rows.where(F.col("kind") == MARKED).groupBy("word").agg(
        F.least(F.sum("coverage"), F.lit(MAX_COVERAGE)).cast("int").alias("coverage"),
        F.bit_or("parents").cast("int").alias("parents"), F.bit_or("children").cast("int").alias("children"), F.min("home").alias("home"),
    )
    whole = Graph(settled(marked), rows)
    whole.without(MARKED)
    return whole
