"""MurmurHash64A of strings as an Arrow UDF; needed for path names and signatures only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandframe.functions import dna
from strandframe.functions.codec import pack

#: Seeds of k-mer hashes and of path signatures, and the multiplier and shift of the hash.
KMER_SEED = 0xCAA9CFCF
SIGNATURE_SEED = 0xD948C134
MULTIPLIER = 0xC6A4A7935BD1E995
SHIFT = 47


def murmur64a(data: bytes, seed: int) -> int:
    """MurmurHash64A of Austin Appleby, as an unsigned number, in the form that mixes the length into the seed as
    it is, where the published code first multiplies it."""
    mask = (1 << 64) - 1
    full = len(data) // 8 * 8
    state = seed ^ len(data)
    for word in np.frombuffer(data[:full], "<u8").tolist():
        word = word * MULTIPLIER & mask
        word = (word ^ word >> SHIFT) * MULTIPLIER & mask
        state = (state ^ word) * MULTIPLIER & mask
    if full < len(data):
        state = (state ^ int.from_bytes(data[full:], "little")) * MULTIPLIER & mask
    state = (state ^ state >> SHIFT) * MULTIPLIER & mask
    return state ^ state >> SHIFT


def murmur64a_column(text: Column, seed: int) -> Column:
    """Hash of a string column with its terminating zero byte left out, as decimal(20,0); null stays null."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else str(murmur64a(v.encode(), seed)))

    return digest(text).cast("decimal(20,0)")


def kmer_hash(kmer: Column) -> Column:
    """Hash of a k-mer as it is, with the zero byte that ends it."""
    return murmur64a_column(F.concat(kmer, F.lit("\0")), KMER_SEED)


def packed_hash(kmer: Column) -> Column:
    """Hash of the two-bit form of a k-mer (see codec), by which runs on several machines place it."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else str(murmur64a(pack(v), KMER_SEED)))

    return digest(kmer).cast("decimal(20,0)")


def canonical_hash(kmer: Column) -> Column:
    """Hash of the canonical form of a k-mer, with the zero byte that ends it."""
    return kmer_hash(dna.canonical(kmer))
