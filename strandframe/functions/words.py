"""k-mers as words: numbers of two bits a letter up to 31 letters, text beyond.

Numbers keep the order of letters, take eight bytes in an exchange, and turn strand by a few shifts. Both classes have
the same functions, so that graph operators are written once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import dna

#: Letters of the longest k-mer that is a number; an arc, one letter longer, then just fits in 64 bits.
MOST = 31
#: Letters handled at once, and windows of a piece, which share a home.
PART, PIECE = 1 << 18, 1024
#: Code where a text has no letter before or after it.
NONE = 255

_CODES = np.zeros(256, np.uint8)
_CODES[np.frombuffer(dna.LETTERS.encode(), np.uint8)] = np.arange(4)


class Text:
    """Words that are the letters themselves."""

    kind = "string"

    def __init__(self, k: int) -> None:
        self.k = k

    def of_text(self, kmer: Column) -> Column:
        return kmer

    def text(self, word: Column) -> Column:
        return word

    def with_rc(self, df: DataFrame, word: str, out: str, size: int | None = None) -> DataFrame:
        """df with the reverse complement of a column of words of `size` letters, k by default."""
        return df.withColumn(out, dna.reverse_complement(F.col(word)))

    def extend(self, word: Column, code: Column) -> Column:
        """The arc, k+1 letters, that adds a letter."""
        return F.concat(word, dna.letter(code))

    def prefix(self, arc: Column) -> Column:
        return arc.substr(1, self.k)

    def suffix(self, arc: Column) -> Column:
        return arc.substr(2, self.k)

    def last(self, arc: Column) -> Column:
        """Code of the last letter."""
        return dna.code(dna.last_letter(arc))


class Packed(Text):
    """Words that are numbers."""

    kind = "long"

    def of_text(self, kmer: Column) -> Column:
        return F.conv(dna.codes(kmer), 4, 10).cast("long")

    def text(self, word: Column) -> Column:
        """Four letters at a time, looked up by their eight bits."""
        out, at = [], self.k
        for size in ([self.k % 4] if self.k % 4 else []) + [4] * (self.k // 4):
            at -= size
            number = F.shiftrightunsigned(word, 2 * at).bitwiseAND(F.lit(4**size - 1).cast("long")).cast("int")
            out.append(F.get(F.lit(["".join(x) for x in product(dna.LETTERS, repeat=size)]), number))
        return F.concat(*out)

    def with_rc(self, df: DataFrame, word: str, out: str, size: int | None = None) -> DataFrame:
        """All bits turned, and letters put in reverse order by swapping ever larger groups: one projection a swap, as
        each uses the one before twice."""
        df, x = df.withColumn(out, F.bitwise_not(word)), F.col(out)
        for by, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
            m = F.lit(mask)
            df = df.withColumn(out, F.shiftrightunsigned(x, by).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), by)))
        df = df.withColumn(out, F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32)))
        return df.withColumn(out, F.shiftrightunsigned(x, 64 - 2 * (size or self.k)))

    def extend(self, word: Column, code: Column) -> Column:
        return F.shiftleft(word, 2).bitwiseOR(code.cast("long"))

    def prefix(self, arc: Column) -> Column:
        return F.shiftrightunsigned(arc, 2)

    def suffix(self, arc: Column) -> Column:
        return arc.bitwiseAND(F.lit((1 << 2 * self.k) - 1))

    def last(self, arc: Column) -> Column:
        return arc.bitwiseAND(F.lit(3).cast("long")).cast("int")


def of(k: int) -> Text:
    return Packed(k) if k <= MOST else Text(k)


# ---- windows of reads as numbers -------------------------------------------------------------------------------


def _roll(codes: np.ndarray, k: int, turned: bool) -> np.ndarray:
    """Word of the k letters from each position on, or of their reverse complement, by doubling."""
    one = (3 - codes if turned else codes).astype(np.uint64)
    word, size = one, 1
    for bit in bin(k)[3:]:
        for more, length in [(word, size)] + ([(one, 1)] if bit == "1" else []):
            n = len(word) - length
            near, far = word[:n], more[size : size + n]
            word = far << np.uint64(2 * size) | near if turned else near << np.uint64(2 * length) | far
            size += length
    return word


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _texts(batches: Iterator[pa.RecordBatch], k: int, part: int = PART) -> Iterator[list[tuple[str, str, str]]]:
    """(letter before, text, letter after) and other columns, if any, in groups of about `part` letters; longer sequences
    are cut, with k-1 letters of overlap and the letters around each cut."""
    held, size = [], 0
    for b in batches:
        for s, *more in zip(*b.to_pydict().values(), strict=True):
            for at in range(0, len(s) - k + 1, part):
                held.append((s[at - 1 : at] if at else "", s[at : at + part + k - 1], s[at + part + k - 1 : at + part + k], *more))
                size += len(held[-1][1])
                if size >= part:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _packed(held: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts of a group with the letter on either side, 255 where there is none; sizes with these two."""
    raw = np.frombuffer("".join(f"{a or ' '}{t}{z or ' '}" for a, t, z, *_ in held).encode("latin-1", "replace"), np.uint8)
    sizes = np.array([len(h[1]) + 2 for h in held])
    codes = _CODES[raw]
    ends = np.cumsum(sizes)
    for at, i in ((ends - sizes, 0), (ends - 1, 2)):
        codes[at[[not h[i] for h in held]]] = NONE
    return codes, sizes


class Windows:
    """All windows of a group of texts, as arrays: begin of each in codes, number in its text and the text's number of
    windows, and the word on either strand."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, k: int) -> None:
        self.k, self.present = k, codes != NONE
        self.codes = np.where(self.present, codes, 0).astype(np.uint8)
        begin = np.cumsum(sizes) - sizes
        self.counts = counts = sizes - 2 - k + 1
        self.nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.of = np.repeat(counts, counts)
        self.at = np.repeat(begin + 1, counts) + self.nth
        self.ahead, self.back = self.rolled(k)
        self.word = np.minimum(self.ahead, self.back)

    def rolled(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of k letters from the begin of each window, on both strands."""
        return tuple(_roll(self.codes, k, turned)[np.minimum(self.at, len(self.codes) - k)] for turned in (False, True))

    def home(self) -> np.ndarray:
        first = self.at - self.nth % PIECE
        return _mix(self.ahead[np.searchsorted(self.at, first)]).view(np.int64)

    def masks(self, left: np.ndarray | bool = True, right: np.ndarray | bool = True) -> list[np.ndarray]:
        """Masks of parents and children; left, right: whether the letter on that side counts."""
        before, after = self.at - 1, self.at + self.k
        one = lambda at, side, c: ((self.present[at] & side).astype(np.uint8) << c)
        l, r = (one(before, left, self.codes[before]), one(after, right, self.codes[after]))
        l_rc, r_rc = (one(before, left, 3 - self.codes[before]), one(after, right, 3 - self.codes[after]))
        same = self.ahead <= self.back
        return [np.where(same, a, b).astype(np.int8) for a, b in ((l, r_rc), (r, l_rc))]


def _windows(held: list[tuple[str, str, str]], k: int, around: bool) -> list[pa.Array]:
    """word and, if asked for, masks of parents and children and home, of all windows of some texts."""
    w = Windows(*_packed(held), k)
    word = w.word.view(np.int64)
    return [pa.array(x) for x in ((word, *w.masks(), w.home()) if around else (word,))]


def windows(reads: DataFrame, k: int, seq: str = "seq", around: bool = False) -> DataFrame:
    """Canonical windows of k <= 31 letters as column word; with around, also the masks parents and children of the
    letters beside each (bit = code) and home, a hash of the piece of at most PIECE windows that it lies in. Sequences
    under k letters and nulls give none; characters other than A, C, G, T count as A."""
    names = ["word", "parents", "children", "home"] if around else ["word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _texts(batches, k):
            yield pa.RecordBatch.from_arrays(_windows(held, k, around), names)

    kinds = "word long, parents byte, children byte, home long" if around else "word long"
    return reads.where(F.length(seq) >= k).select(seq).mapInArrow(run, kinds)


def counted_windows(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(word, n): the same windows in order within groups of about PART letters, the equal ones of a group together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _texts(batches, k):
            word, n = np.unique(_windows(held, k, False)[0].to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])

    return reads.where(F.length(seq) >= k).select(seq).mapInArrow(run, "word long, n long")
