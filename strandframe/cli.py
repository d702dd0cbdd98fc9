"""Command line: python -m strandframe count|assemble|gc -k K -o FOLDER [-minimum-coverage N] FILE...

Words that start with '-' are options; every other word is a file, of a format told by its suffix.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import dna, words
from strandframe.operators import graph, kmers, unique, unitigs
from strandframe.session import build_session, written
from strandframe.sources import sinks
from strandframe.sources.sequences import read_sequences

#: The default k, made odd if it isn't, and the least length of a contig.
DEFAULT_K = 49
CONTIG = 100


def load(spark: SparkSession, files: list[str]) -> DataFrame:
    return read_sequences(spark, files).select("file", "name", dna.normalize(F.col("seq")).alias("seq"))


def count(spark: SparkSession, files: list[str], k: int, output: str) -> None:
    """The coverage distribution of canonical k-mers, as two text files; an existing folder is written into."""
    sinks.write_coverage_distribution(kmers.histogram(kmers.count(load(spark, files), k)), output)


def assemble(spark: SparkSession, files: list[str], k: int, output: str, minimum_coverage: int = 1) -> None:
    """Coverage distribution, graph summary and contigs; an existing folder is an error."""
    if sinks.exists(spark, output):
        raise FileExistsError(output)
    reads, number = load(spark, files), None
    if k <= words.MOST:
        whole = unique.graph(reads, k)
        vertices, number = whole.classes(), F.col("n")
        contigs = lambda: unitigs.assemble_graph(whole, k, minimum_coverage, CONTIG)
    else:
        vertices = written(graph.word_vertices(reads, k, home=True))
        contigs = lambda: unitigs.assemble_vertices(vertices, k, minimum_coverage, CONTIG)
    sinks.write_coverage_distribution(kmers.histogram(vertices, number), output)
    sinks.write_summary(graph.summary(vertices, number), graph.degree_matrix(vertices, number), k, output)
    sinks.write_unitigs(contigs(), k, f"{output}/unitigs.fasta")


def gc(spark: SparkSession, files: list[str], output: str) -> None:
    """Share of G and C of each file, as a CSV folder."""
    part = F.sum(F.length(F.regexp_replace("seq", "[^GC]", "")))
    load(spark, files).groupBy("file").agg((part / F.sum(F.length("seq"))).alias("gc")).write.csv(output, header=True)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strandframe", description=__doc__)
    parser.add_argument("command", choices=("count", "assemble", "gc"))
    parser.add_argument("-k", type=int, default=DEFAULT_K)
    parser.add_argument("-o", dest="output", default="output")
    parser.add_argument("-minimum-coverage", type=int, default=1)
    parser.add_argument("-master", default=None)
    parser.add_argument("files", nargs="+")
    o = parser.parse_args(arguments)
    spark = spark or build_session("strandframe", o.master)
    if o.command == "count":
        count(spark, o.files, kmers.odd(o.k), o.output)
    elif o.command == "assemble":
        assemble(spark, o.files, kmers.odd(o.k), o.output, o.minimum_coverage)
    else:
        gc(spark, o.files, o.output)
    return 0
