"""Observed k-mers of the `kmers` table: which rows count, and their key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import dna


def counting(kmers: DataFrame, *more: str) -> DataFrame:
    """Rows that count (kmer not null, of length kmer_length) with their key as column key, and the columns asked
    for. Repeated rows (same obs_id) are still in. The length of a key is its kmer_length."""
    rows = kmers.where(F.length("kmer") == F.col("kmer_length"))
    key = F.coalesce(dna.observed_key(F.col("kmer")), F.lit(""))  # never null, and the schema says so: no check computes it again
    return rows.select(*more, key.alias("key"))
