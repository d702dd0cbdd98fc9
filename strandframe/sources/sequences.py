"""FASTA and FASTQ scans through Spark's text source, so that any Hadoop file system, gzip and file splits work.

Records are cut by the text source itself: a FASTA record ends before a line that starts with '>'. A FASTQ file
is cut before every line that starts with '@'; a quality line may also start so, but what is cut off there has one
line, while a record's beginning always has its identifier, its sequence and a '+' line.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes by which a format is chosen.
FASTA_SUFFIXES = (".fasta", ".fa", ".fa.gz", ".fasta.gz")
FASTQ_SUFFIXES = (".fastq", ".fq", ".fastq.gz", ".fq.gz")


class InputError(Exception):
    """Base of what can be wrong with an input; `code` is the fixed value of each case."""

    code = -1


class InputNotFound(InputError, FileNotFoundError):
    """No file at a path."""

    code = -2


class InputNotSupported(InputError, ValueError):
    """The suffix of a path names no known format."""

    code = -3


class InputAlreadyOpen(InputError):
    """A reader was opened twice."""

    code = -4


class InputNotOpen(InputError):
    """A reader was used before it was opened."""

    code = -5


class InputAtEnd(InputError, EOFError):
    """A reader was asked for more than there is."""

    code = -6


def format_of(path: str) -> str:
    """Name of the format by suffix: 'fastq' or 'fasta', or one added by register_format."""
    for kind, (suffixes, _) in FORMATS.items():
        if path.endswith(suffixes):
            return kind
    raise InputNotSupported(path)


def _suffix_pattern(kind: str) -> str:
    return "(" + "|".join(re.escape(x) for x in FORMATS[kind][0]) + ")$"


def of_format(df: DataFrame, kind: str, file: str = "file") -> DataFrame:
    """Rows whose file name has a suffix of the format."""
    return df.where(F.col(file).rlike(_suffix_pattern(kind)))


def file_sizes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, bytes) of input files, from their metadata."""
    meta = spark.read.format("binaryFile").load(paths)
    return meta.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("value"))


def _marked(df: DataFrame) -> DataFrame:
    """Rows with preamble: whether a row is the first of its file and has no '>'. Rows of a split are numbered in
    file order, so the first row of a file is the lowest number among those of its first split."""
    rows = df.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("i")
    )
    head = (F.col("start") == 0) & ~F.col("value").startswith(">")
    suspects = rows.where(F.col("start") == 0).groupBy("file").agg(F.min(F.struct("i", head.alias("bad"))).alias("m"))
    bad = suspects.where("m.bad").select("file", F.col("m.i").alias("i"), F.lit(True).alias("preamble"))
    # at most one small row a file
    return rows.join(F.broadcast(bad), ["file", "i"], "left").select("file", "value", F.coalesce("preamble", F.lit(False)).alias("preamble"))


def _fasta_record(text: Column) -> tuple[Column, Column]:
    """name and seq of a record without its '>'."""
    cut = F.instr(text, "\n")
    name = F.when(cut > 0, text.substr(F.lit(1), cut - 1)).otherwise(text)
    seq = F.when(cut > 0, F.regexp_replace(text.substr(cut + 1, F.length(text)), "[\r\n]", "")).otherwise(F.lit(""))
    return F.regexp_replace(name, "\r$", "").alias("name"), seq.alias("seq")


def _spread(records: DataFrame, paths: str | list[str]) -> DataFrame:
    """Records of compressed files, which one task reads from end to end, dealt to as many tasks as a shuffle has."""
    names = [paths] if isinstance(paths, str) else paths
    if not any(x.endswith(".gz") for x in names):
        return records
    return records.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, seq): multi-line records joined, either kind of line end, a last record with or without one.
    A record without sequence lines has an empty seq. Lines before the first '>' of a file are skipped: what is cut
    off a file's beginning keeps its '>', so a piece at offset 0 without one is no record."""
    raw = _marked(spark.read.option("lineSep", "\n>").text(paths)).where(~F.col("preamble"))
    value = F.col("value")
    body = F.when(value.startswith(">"), value.substr(F.lit(2), F.length(value))).otherwise(value)
    return _spread(raw.select("file", *_fasta_record(body)), paths)


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, seq) of four-line records; the quality line isn't read further than to find its end."""
    raw = _named(spark.read.option("lineSep", "\n@").text(paths))
    lines = F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    records = raw.select("file", lines.alias("l")).where((F.size("l") >= 3) & F.col("l")[2].startswith("+"))
    return _spread(records.select("file", F.regexp_replace(F.col("l")[0], "^@", "").alias("name"), F.col("l")[1].alias("seq")), paths)


def records_of_buffers(buffers: DataFrame, kind: str, id: str, file: str, buffer: str) -> DataFrame:
    """(id, record, name, seq): the records of buffers that hold the text of a file of a format, numbered from 0 in
    each buffer. Buffers of files of other formats are left out; a null file is read as FASTA. FASTA: lines before the
    first '>' are skipped. FASTQ: four lines a record; one whose first line lacks its '@' or whose third line lacks
    its '+' is left out. A null buffer has no records; repeated rows repeat theirs."""
    own = F.coalesce(F.col(file), F.lit("")).rlike(_suffix_pattern("fastq"))
    rows = buffers.where(F.col(buffer).isNotNull() & (own if kind == "fastq" else ~own)).select(F.col(id).alias("id"), F.col(buffer).alias("b"))
    if kind == "fasta":
        parts = F.split(F.concat(F.lit("\n"), F.col("b")), "\n>")
        cut = rows.select("id", F.posexplode(F.slice(parts, 2, F.size(parts))).alias("record", "t"))
        out = cut.select("id", "record", *_fasta_record(F.col("t")))
    else:
        l = F.col("l")
        at = F.sequence(F.lit(0), F.floor(F.size(l) / 4).cast("int"))
        line = lambda i, n: F.regexp_replace(F.get(l, i * 4 + n), "\r$", "")
        each = F.transform(at, lambda i: F.struct(i.alias("record"), line(i, 0).alias("a"), line(i, 1).alias("seq"), line(i, 2).alias("p")))
        records = rows.select("id", F.split("b", "\n").alias("l")).select("id", F.explode(each).alias("r"))
        out = records.where(F.col("r.a").startswith("@") & F.col("r.p").startswith("+")).select("id", "r.record", F.expr("substr(r.a, 2)").alias("name"), "r.seq")
    return out.withColumnRenamed("id", id)


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, name, seq) of files of either format, chosen by suffix; InputNotSupported for any other."""
    by: dict[str, list[str]] = {}
    for path in paths:
        by.setdefault(format_of(path), []).append(path)
    if not by:
        raise InputNotFound("no input files")
    return reduce(DataFrame.unionByName, [FORMATS[kind][1](spark, own) for kind, own in sorted(by.items())])


#: Suffixes and reader of each format.
FORMATS = {"fastq": (FASTQ_SUFFIXES, read_fastq), "fasta": (FASTA_SUFFIXES, read_fasta)}


def register_format(kind: str, suffixes: tuple[str, ...], reader: Callable[[SparkSession, list[str]], DataFrame]) -> None:
    """Adds a format; reader gives (file, name, seq)."""
    FORMATS[kind] = (suffixes, reader)


def looks_like_identifier(line: str) -> bool:
    """Whether a line met after a seek into a FASTQ file is taken for an identifier."""
    if not line.startswith("@"):
        return False
    if re.search(r"\s", line.rstrip("\r\n")):
        return True
    return len(line) <= 100
