"""Reads: the fixture from the tables, chunking of long sequences, and a summary by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import dna
from strandframe.session import read_table


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq): each read once, however often it was loaded, normalised from the raw buffer. A null buffer
    gives a null seq."""
    raw = read_table(spark, sf_dir, "sequence_reads")
    return raw.select("read_id", dna.normalize(F.col("buffer_for_sequence")).alias("seq")).distinct()


def _pieces(seq: str, k: int, size: int) -> Column:
    def piece(at: Column) -> Column:
        return F.struct(at.alias("s"), F.col(seq).substr(at + 1, F.lit(size + k - 1)).alias("t"))

    return F.transform(F.sequence(F.lit(0), F.length(seq) - k, F.lit(size)), piece)


def chunked(reads_: DataFrame, k: int, seq: str = "seq", chunk: int = 1024) -> DataFrame:
    """Sequences cut into pieces that hold `chunk` k-mers each and overlap by k-1 letters, with _at, the offset
    of the piece. Short sequences pass unchanged; sequences under k letters and nulls are dropped. Substrings cost
    time in proportion to their offset, so k-mers of a long sequence are taken from short pieces, in two steps."""
    out = reads_.where(F.length(seq) >= k).withColumn("_at", F.lit(0))
    for size in (chunk * 1024, chunk):
        out = out.withColumn("_p", F.explode(_pieces(seq, k, size))).withColumn(seq, F.col("_p.t")).withColumn("_at", F.col("_at") + F.col("_p.s")).drop("_p")
    return out


def dataset_summary(table: DataFrame, file: str = "file", seq: str = "seq", pair: str = "pair") -> DataFrame:
    """Reads, bases and paired reads of each file; null sequences count as reads of no bases, a null pair or one of -1
    as none."""
    paired = F.count_if(F.coalesce(F.col(pair), F.lit(-1)) != -1)
    return table.groupBy(file).agg(
        F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum(F.length(seq)), F.lit(0)).cast("long").alias("bases"), paired.alias("paired")
    )
