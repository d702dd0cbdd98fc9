"""Cutting oversized items at natural boundaries, with an overlap in units.

Structure-tree packing. An item is the root of a tree whose kinds of nodes depend on what it holds: records and lines
of sequence files; sections under headings, blocks, list items and lines of text; nested elements of markup. Leaves are
slices of a line. A node's size is what it spans, so sizes of all nodes are known from their ends. Only a node over the
limit is opened into its children, and only then are these looked for; all others are units. Units that are siblings,
or follow each other across the ends of opened nodes, are then merged from the left up to the limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limit where none is given, in bytes.
DEFAULT_LIMIT = 2097152
#: Suffixes of FASTQ files; any other file is read as FASTA.
FASTQ_SUFFIXES = (".fastq", ".fq", ".fastq.gz", ".fq.gz")
#: Elements of markup that have no end.
VOID = frozenset(b"area base br col embed hr img input link meta source track wbr".split())

HEADING = re.compile(rb"^(#{1,6})[ \t]", re.M)
BLANK = re.compile(rb"\n(?:[ \t\r]*\n)+")
LIST_ITEM = re.compile(rb"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]", re.M)
TAG = re.compile(rb"<(/?)([A-Za-z][^\s<>/]*)[^<>]*?(/?)>")

# ---- children of a node: the ends of all parts of data[start:end], of which the last is end --------------------

Step = Callable[[bytes, int, int, int], np.ndarray]


def _cut_before(starts: list[int] | np.ndarray, start: int, end: int) -> np.ndarray:
    inside = [x for x in starts if start < x < end]
    return np.array([*inside, end], np.int64)


def lines(data: bytes, start: int, end: int, limit: int) -> np.ndarray:
    """Lines with their line ends."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8, end - start, start) == 10) + 1 + start
    return ends if len(ends) and ends[-1] == end else np.append(ends, end)


def fasta_records(data: bytes, start: int, end: int, limit: int) -> np.ndarray:
    """A line is the last of its record if the next one starts with '>'."""
    ends = lines(data, start, end, limit)
    last = np.append(np.frombuffer(data, np.uint8)[ends[:-1]] == ord(">"), True)
    return ends[last]


def fastq_records(data: bytes, start: int, end: int, limit: int) -> np.ndarray:
    """Four lines each; what is left over is one."""
    ends = lines(data, start, end, limit)
    last = np.zeros(len(ends), bool)
    last[3::4] = True
    last[-1:] = True
    return ends[last]


def sections(data: bytes, start: int, end: int, limit: int) -> np.ndarray:
    """Cut before the headings of the highest level that there is, the one that the node begins with aside."""
    found = [(len(m[1]), m.start()) for m in HEADING.finditer(data, start, end) if m.start() > start]
    top = min((level for level, _ in found), default=0)
    return _cut_before([at for level, at in found if level == top], start, end)


def blocks(data: bytes, start: int, end: int, limit: int) -> np.ndarray:
    """Paragraphs, lists and the like, with the empty lines after them."""
    return _cut_before([m.end() for m in BLANK.finditer(data, start, end)], start, end)


def list_items(data: bytes, start: int, end: int, limit: int) -> np.ndarray:
    """Cut before the items of a list that are indented least."""
    found = [(len(m[0]) - len(m[0].lstrip()), m.start()) for m in LIST_ITEM.finditer(data, start, end)]
    top = min((depth for depth, at in found if at > start), default=0)
    return _cut_before([at for depth, at in found if depth == top], start, end)


def elements(data: bytes, start: int, end: int, limit: int) -> np.ndarray:
    """Outermost elements and the text between them; a node that is one element falls into its tags and what is
    between them. An end without a beginning is text, a beginning without an end lasts as long as its parent."""
    tags = list(TAG.finditer(data, start, end))
    spans: list[tuple[int, int, re.Match]] = []
    open_: list[re.Match] = []
    for m in tags:
        name = m[2].lower()
        if m[1]:
            if any(x[2].lower() == name for x in open_):
                while open_[-1][2].lower() != name:
                    open_.pop()
                first = open_.pop()
                if not open_:
                    spans.append((first.start(), m.end(), first))
        elif not m[3] and name not in VOID:
            open_.append(m)
        elif not open_:
            spans.append((m.start(), m.end(), m))
    if len(spans) == 1 and spans[0][:2] == (start, end) and spans[0][2].end() < end:
        inner, last = spans[0][2].end(), data.rfind(b"<", start, end)
        return _cut_before([inner, *elements(data, inner, last, limit).tolist()] if inner < last else [inner], start, end)
    return _cut_before(sorted({x for a, b, _ in spans for x in (a, b)}), start, end)


def slices(data: bytes, start: int, end: int, limit: int) -> np.ndarray:
    """Slices of the limit, shorter only where that would cut a character of UTF-8 and the limit has room for one."""
    if data[start:end].isascii():
        return np.append(np.arange(start + limit, end, limit), end)
    ends, at = [], start
    while at + limit < end:
        cut = at + limit
        while cut > at and data[cut] & 0xC0 == 0x80:
            cut -= 1
        at = cut if cut > at else at + limit
        ends.append(at)
    return np.array([*ends, end], np.int64)


#: Kinds of items, and the kinds of nodes that each is opened into, from the outside in.
TREES: dict[str, tuple[Step, ...]] = {
    "fasta": (fasta_records, lines, slices),
    "fastq": (fastq_records, lines, slices),
    "text": (sections, blocks, list_items, lines, slices),
    "markup": (elements, lines, slices),
}
#: Nodes that can have children of their own kind.
NESTED = (sections, list_items, elements)


def unit_ends(data: bytes, kind: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """End offsets of the units of an item, in order, and those of the children of opened nodes."""
    steps, ends, opened = TREES[kind], [], [np.zeros(0, np.int64)]
    todo = [(0, len(data), 0)]
    while todo:
        start, end, at = todo.pop()
        cut = np.array([end])
        while at < len(steps) and len(cut) == 1:
            cut = steps[at](data, start, end, limit)
            at += 1
        at -= steps[at - 1] in NESTED
        sizes = np.diff(cut, prepend=start)
        big = np.flatnonzero(sizes > limit)
        ends.append(np.delete(cut, big))
        opened.append(np.concatenate([cut[big], cut[big] - sizes[big]]))
        todo += [(int(cut[i] - sizes[i]), int(cut[i]), at) for i in big]
    return np.sort(np.concatenate(ends)), np.unique(np.concatenate(opened))


def pieces(data: bytes, kind: str, limit: int, overlap: int, across: bool = True) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one item, end exclusive; empty for an item within the limit. Without across,
    no piece goes over the beginning or the end of a node that had to be opened."""
    if len(data) <= limit:
        return []
    ends, fences = unit_ends(data, kind, limit)
    begins = np.append(0, ends[:-1])
    if across:
        fences = np.zeros(0, np.int64)
    fences = np.append(fences[(fences > 0) & (fences < len(data))], len(data))
    out, first, n = [], 0, len(ends)
    while True:
        fence = int(fences[np.searchsorted(fences, begins[first], "right")])
        after = int(np.searchsorted(ends, min(begins[first] + limit, fence), "right"))
        out.append((int(begins[first]), int(ends[after - 1])))
        if after == n:
            return out
        if ends[after - 1] == fence:
            first = after
            continue
        fits = int(np.searchsorted(begins, ends[after] - limit, "left"))  # the first unit from which the next new one fits
        first = max(after - overlap, fits, first + 1)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, starts, ends = [], [], []
        columns = [batch.column(c) for c in ("id", "file", "start", "end", "limit", "overlap", "buffer")]
        for i in range(batch.num_rows):
            id_, file, start, end, limit, overlap, buffer = (c[i].as_py() for c in columns)
            if buffer is None:
                continue
            start, limit, overlap = start or 0, limit if limit and limit > 0 else DEFAULT_LIMIT, max(0, overlap or 0)
            data = buffer.encode()
            if end is not None and end != -1:
                data = data[: max(0, end - start + 1)]
            for a, b in pieces(data, "fastq" if (file or "").endswith(FASTQ_SUFFIXES) else "fasta", limit, overlap):
                ids.append(id_)
                starts.append(start + a)
                ends.append(start + b - 1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "piece_start", "piece_end"])


def split_items(items: DataFrame, id: str, file: str, start: str, end: str, limit: str, overlap: str, buffer: str) -> DataFrame:
    """(id, piece_start, piece_end), both inclusive file offsets, of every item over its limit.

    An item is the buffer up to `end` (null or -1: all of it; before the start: nothing; beyond the buffer: all of
    it). Null start is 0, null or non-positive limit is DEFAULT_LIMIT, null or negative overlap is 0. A null or
    empty buffer and an item within its limit give no rows; a null file is read as FASTA; each repeated row gives
    its own pieces. Sizes are bytes of UTF-8. One pass over the rows, no shuffle.
    """
    names = zip((id, file, start, end, limit, overlap, buffer), ("id", "file", "start", "end", "limit", "overlap", "buffer"), strict=True)
    rows = items.select(*[F.col(c).alias(n) for c, n in names])
    return rows.mapInArrow(_split, "id long, piece_start long, piece_end long").withColumnRenamed("id", id)
