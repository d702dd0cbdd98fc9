"""K-mer extraction, counting and coverage histograms.

Counting canonicalises before the shuffle, so Spark's map-side partial aggregate merges both strands and absorbs
hot k-mers: one row per distinct k-mer and map task crosses the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import dna, words
from strandframe.operators.sequences import chunked


def odd(k: int) -> int:
    """k made odd, so that no k-mer is its own reverse complement."""
    return k | 1


def extract(reads: DataFrame, k: int, seq: str = "seq", positions: bool = False) -> DataFrame:
    """All windows of k letters in read orientation as column kmer (and pos, from 0). Sequences under k letters
    and nulls give none."""
    pieces = chunked(reads, k, seq)
    starts = F.explode(F.sequence(F.lit(1), F.length(seq) - k + 1))
    out = pieces.withColumn("_i", starts).withColumn("kmer", F.col(seq).substr(F.col("_i"), F.lit(k)))
    if positions:
        out = out.withColumn("pos", (F.col("_at") + F.col("_i") - 1).cast("int"))
    return out.drop("_i", "_at", seq)


def count(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, coverage) of canonical k-mers. Up to 31 letters they are exchanged and grouped as numbers."""
    total = F.count(F.lit(1)).alias("coverage")
    if k > words.MOST:
        return extract(reads, k, seq).select(dna.canonical(F.col("kmer")).alias("kmer")).groupBy("kmer").agg(total)
    counts = words.windows(reads, k, seq).groupBy("word").agg(total)
    return counts.select(words.of(k).text(F.col("word")).alias("kmer"), "coverage")


def partial_counts(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(word, n) of canonical k-mers as words, without an exchange: a word may have several rows."""
    if k > words.MOST:
        return extract(reads, k, seq).select(dna.canonical(F.col("kmer")).alias("word"), F.lit(1).cast("long").alias("n"))
    return words.counted_windows(reads, k, seq)


def summed(partial: DataFrame, k: int) -> DataFrame:
    """(kmer, coverage) of partial counts (word, n)."""
    total = partial.groupBy("word").agg(F.sum("n").alias("coverage"))
    return total.select(words.of(k).text(F.col("word")).alias("kmer"), "coverage")


def histogram(counts: DataFrame, number: Column | None = None) -> DataFrame:
    """(coverage, frequency) of canonical k-mers; number: k-mers that a row stands for, one by default."""
    total = F.count(F.lit(1)) if number is None else F.sum(number)
    return counts.groupBy("coverage").agg(total.alias("frequency"))


def histogram_both_strands(counts: DataFrame) -> DataFrame:
    return histogram(counts).withColumn("frequency", F.col("frequency") * 2)


def top(counts: DataFrame, n: int) -> DataFrame:
    """The n k-mers of highest coverage, ties by letters."""
    return counts.orderBy(F.desc("coverage"), "kmer").limit(n)


def minimum_coverage(counts: DataFrame, least: int = 1) -> DataFrame:
    return counts.where(F.col("coverage") >= least)


def with_minimizer(kmers: DataFrame, k: int, stores: int, width: int = 19, hashed: bool = False) -> DataFrame:
    """minimizer and store of each k-mer. Neighbours in a sequence mostly share both, as do the two strands."""
    out = kmers.withColumn("minimizer", dna.minimizer(F.col("kmer"), k, width, hashed))
    return out.withColumn("store", F.pmod(F.xxhash64("minimizer"), F.lit(stores)).cast("int"))


def partition_by_minimizer(kmers: DataFrame, k: int, partitions: int, width: int = 19, hashed: bool = False) -> DataFrame:
    """Rows placed so that k-mers of one minimizer share a partition."""
    return with_minimizer(kmers, k, partitions, width, hashed).repartition(partitions, "minimizer")


def partition_by_hash(kmers: DataFrame, partitions: int, kmer: str = "kmer") -> DataFrame:
    """Rows placed by the canonical form of the k-mer, so that both strands share a partition."""
    return kmers.repartition(partitions, dna.canonical(F.col(kmer)))
