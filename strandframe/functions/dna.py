"""Functions on DNA strings, Column to Column, all inside whole-stage codegen.

Strings are ASCII; order is byte order. Null in, null out, everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model: letters by code 0..3, and their complements in the same order.
LETTERS = "ACGT"
COMPLEMENTS = "TGCA"
#: Pairs of first and last letter with which a sequence is lower than its reverse complement.
LOWER_ENDS = [a + b for a in LETTERS for b in LETTERS if a < COMPLEMENTS[LETTERS.index(b)]]


def normalize(seq: Column) -> Column:
    """Upper case; every character but A, C, G, T becomes A. A trailing line end is not part of the sequence."""
    return F.regexp_replace(F.upper(F.regexp_replace(seq, r"[\r\n]+$", "")), "[^ACGT]", "A")


def complement(seq: Column) -> Column:
    return F.translate(seq, LETTERS, COMPLEMENTS)


def complement_any(seq: Column) -> Column:
    """Complement in which every character outside A, C, G, T gives G."""
    return complement(F.regexp_replace(seq, "[^ACGT]", "C"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement. The outer letters alone settle many cases, without
    building the reverse complement: those in which the first is lower than the complement of the last."""
    outer = F.concat(kmer.substr(1, 1), kmer.substr(-1, 1))
    return F.when(outer.isin(*LOWER_ENDS), kmer).otherwise(F.least(kmer, reverse_complement(kmer)))


def is_canonical(kmer: Column) -> Column:
    return kmer <= reverse_complement(kmer)


def observed_key(kmer: Column) -> Column:
    """Key of a k-mer as read: upper case, other characters read as A, then canonical."""
    return canonical(F.regexp_replace(F.upper(kmer), "[^ACGT]", "A"))


def child(kmer: Column, base: Column) -> Column:
    """The next k-mer: first letter dropped, base appended."""
    return F.concat(F.substring(kmer, 2, 2147483647), base)


def parent(kmer: Column, base: Column) -> Column:
    """The previous k-mer: base put in front, last letter dropped."""
    return F.concat(base, kmer.substr(F.lit(1), F.length(kmer) - 1))


def code(base: Column) -> Column:
    """Nucleotide code 0..3 of one letter; null for any other."""
    position = F.call_function("instr", F.lit(LETTERS), base)
    return F.when(position > 0, position - 1).cast("int")


def letter(code_: Column) -> Column:
    return F.lit(LETTERS).substr(code_ + 1, F.lit(1))


def codes(seq: Column) -> Column:
    """The sequence with letters written as digits 0..3."""
    return F.translate(seq, LETTERS, "0123")


def first_letter(kmer: Column) -> Column:
    return kmer.substr(1, 1)


def last_letter(kmer: Column) -> Column:
    return F.right(kmer, F.lit(1))


def letter_at(kmer: Column, index: Column) -> Column:
    """Letter at a position from 0."""
    return kmer.substr(index + 1, F.lit(1))


def set_letter(seq: Column, index: Column, base: Column) -> Column:
    """The sequence with another letter at a position from 0."""
    return F.overlay(seq, base, index + 1, F.lit(1))


def mock(k: int) -> Column:
    """The k-mer of A only."""
    return F.repeat(F.lit(LETTERS[0]), k)


def random_kmer(k: int, seed: int = 42) -> Column:
    """A random k-mer for each row."""
    return F.concat(*[F.lit(LETTERS).substr((F.rand(seed + i) * 4).cast("int") + 1, F.lit(1)) for i in range(k)])


def lower_range(seq: Column, start: int, end: int) -> Column:
    """Lower case for positions start..end, from 0, both inclusive."""
    return F.concat(seq.substr(1, start), F.lower(seq.substr(start + 1, end - start + 1)), seq.substr(F.lit(end + 2), F.length(seq)))


def gc_ratio(seq: Column) -> Column:
    """Share of G and C; null for an empty sequence."""
    length = F.length(seq)
    return F.when(length > 0, F.length(F.regexp_replace(seq, "[^GC]", "")) / length)


def encoded_length(seq: Column, two_bit: bool = True) -> Column:
    """Bytes of the two encodings: letters and a terminator, or two bits a letter where a full last byte is
    followed by another one."""
    length = F.length(seq)
    return (F.floor(length * 2 / 8) + 1).cast("int") if two_bit else (length + 1).cast("int")


def rotate(text: Column, by: int) -> Column:
    """The first `by` characters move to the end; by is taken modulo the length."""
    length = F.length(text)
    cut = F.when(length > 0, F.lit(by) % length).otherwise(F.lit(0))
    return F.concat(text.substr(cut + 1, length), text.substr(F.lit(1), cut))


def reverse_range(text: Column, start: int, end: int) -> Column:
    """Positions start..end, from 0, both inclusive, in reverse order."""
    return F.concat(text.substr(1, start), F.reverse(text.substr(start + 1, end - start + 1)), text.substr(F.lit(end + 2), F.length(text)))


def swap(text: Column, i: int, j: int) -> Column:
    """The characters at two positions, from 0, in each other's place; unchanged where the text is too short."""
    i, j = F.lit(min(i, j)), F.lit(max(i, j))
    swapped = set_letter(set_letter(text, i, letter_at(text, j)), j, letter_at(text, i))
    return F.when(F.length(text) > j, swapped).otherwise(text)


def rotate_path(seq: Column, rotation: Column, k: int) -> Column:
    """Rotation of a circular path that keeps its k-1 letters of overlap: the cycle proper is all but the last
    k-1 letters. The first k-1 letters of the rotated cycle, repeated as often as a short cycle needs, close it."""
    size = F.length(seq) - (k - 1)
    cycle = seq.substr(F.lit(1), size)
    cut = rotation % size
    turned = F.concat(cycle.substr(cut + 1, size), cycle.substr(F.lit(1), cut))
    repeats = F.ceil(F.lit(k - 1) / size).cast("int") + 1
    closed = F.call_function("repeat", turned, repeats).substr(F.lit(1), F.length(seq))
    return F.when(size > 0, closed).otherwise(seq)


def shingles(seq: Column, width: Column | int) -> Column:
    """All windows of a width, in order; an empty array where the sequence is shorter."""
    w = F.lit(width) if isinstance(width, int) else width
    count = F.length(seq) - w + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: seq.substr(i, w))).otherwise(
        F.when(seq.isNotNull(), F.array().cast("array<string>"))
    )


def minimizer(kmer: Column, k: int, width: int = 19, hashed: bool = False) -> Column:
    """The smallest canonical shingle of a k-mer, by letters, or its hash and the smallest by that, which spreads k-mers
    more evenly. It is the same on both strands. Width: 19, or k-3 for shorter k."""
    w = width if k >= width else max(1, k - 3)
    each = F.transform(shingles(kmer, w), lambda x: F.xxhash64(canonical(x)) if hashed else canonical(x))
    return F.array_min(each)


def unit_prefix(value: Column) -> Column:
    """Display of a count with a metric prefix, one step for each factor of 1000 up to giga."""
    steps = ((1e9, "G"), (1e6, "M"), (1e3, "k"))
    out = F.format_string("%d", value.cast("long"))
    for size, sign in reversed(steps):
        out = F.when(value >= size, F.concat(F.format_string("%.3f", value / size), F.lit(" " + sign))).otherwise(out)
    return out
