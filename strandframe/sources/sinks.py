"""Writers: coverage distributions, the graph summary as XML, unitigs as FASTA; all on any Hadoop file system."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.hashing import KMER_SEED, SIGNATURE_SEED, canonical_hash, murmur64a, murmur64a_column
from strandframe.functions import dna

#: Characters sent to a file at once.
CHUNK = 1 << 16


def at(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = at(spark, path)
    return system.exists(place)


def write_file(spark: SparkSession, path: str, lines: Iterable[str]) -> None:
    """One text file; folders above it are made, a file that is there is replaced."""
    system, place = at(spark, path)
    out, held, size = system.create(place, True), [], 0
    try:
        for line in lines:
            held.append(line + "\n")
            size += len(line) + 1
            if size >= CHUNK:
                out.write("".join(held).encode())
                held, size = [], 0
        if held:
            out.write("".join(held).encode())
    finally:
        out.close()


def write_coverage_distribution(histogram: DataFrame, folder: str) -> None:
    """coverage_distribution.txt (header, tabs, both strands) and coverage_distribution.txt-canonical (no header,
    spaces). A histogram has one row for each coverage that occurs; it is written row by row, as one file needs."""
    spark, rows = histogram.sparkSession, histogram.orderBy("coverage")
    table = rows.toLocalIterator()
    kept = [(r["coverage"], r["frequency"]) for r in table]  # as many as there are different coverages
    both = (f"{c}\t{2 * n}" for c, n in kept)
    write_file(spark, f"{folder}/coverage_distribution.txt", ["Coverage\tFrequency", *both])
    write_file(spark, f"{folder}/coverage_distribution.txt-canonical", (f"{c} {n}" for c, n in kept))


def write_summary(summary: DataFrame, degrees: DataFrame, k: int, folder: str) -> None:
    """assembly_graph_summary.xml: one row and 25 cells."""
    s = summary.first()
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', "<assembly_graph_summary>", f"<kmer_length>{k}</kmer_length>"]
    lines += [f"<{name}>{s[name]}</{name}>" for name in ("vertex_count", "arc_count", "vertex_observation_count")]
    lines.append("<connectivity>")
    for r in sorted(degrees.collect()):  # 25 rows
        inside = "".join(f"<{name}>{r[name]}</{name}>" for name in ("parent_count", "child_count", "frequency"))
        lines.append(f"    <class>{inside}</class>")
    lines += ["</connectivity>", "</assembly_graph_summary>"]
    write_file(summary.sparkSession, f"{folder}/assembly_graph_summary.xml", lines)


def write_bucketed(df: DataFrame, table: str, column: str = "kmer", buckets: int = 64, folder: str | None = None) -> DataFrame:
    """df as a table bucketed and sorted by a column, in a folder or in the warehouse. Two such tables, of vertices and
    of arcs by the vertex that they leave, join without an exchange."""
    writer = df.write.mode("overwrite").bucketBy(buckets, column).sortBy(column)
    (writer.option("path", folder) if folder else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def path_name(seq: str, k: int) -> int:
    """Canonical hash of the end k-mer that is lower on its own strand."""
    ends = [min(x, x[::-1].translate(str.maketrans(dna.LETTERS, dna.COMPLEMENTS))) for x in (seq[:k], seq[-k:])]
    return murmur64a(min(ends).encode() + b"\0", KMER_SEED)


def path_name_column(seq: Column, k: int) -> Column:
    """The same of a column, as decimal(20,0)."""
    return canonical_hash(F.least(dna.canonical(seq.substr(F.lit(1), F.lit(k))), dna.canonical(F.right(seq, F.lit(k)))))


def fasta_records(paths: DataFrame, k: int, width: int = 80) -> DataFrame:
    """One column value: header with name, length, circular flag and signature, then lines of `width` letters."""
    name = path_name_column(F.col("seq"), k)
    signature = F.lower(F.conv(murmur64a_column(F.col("seq"), SIGNATURE_SEED).cast("string"), 10, 16))
    header = F.format_string(">path_%s length=%d circular=%d signature=%s", name.cast("string"), F.length("seq"), "circular", signature)
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return paths.select(F.concat(header, F.lit("\n"), body).alias("value"))


def write_unitigs(paths: DataFrame, k: int, folder: str, mode: str = "errorifexists") -> None:
    """FASTA part files; an existing folder is an error unless mode says otherwise."""
    fasta_records(paths, k).write.mode(mode).text(folder)
