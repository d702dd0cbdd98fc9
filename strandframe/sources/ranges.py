"""The data source "sequences": byte ranges of FASTA and FASTQ files, for spark.read.format("sequences").

Each task reads one range. A record belongs to the range in which its first byte lies, so a reader that starts inside
a file first looks for the next beginning of a record. A compressed file is one range.

    register(spark)
    spark.read.format("sequences").option("range_bytes", 64 << 20).load(path)
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandframe.sources.sequences import InputAlreadyOpen, InputAtEnd, InputNotFound, InputNotOpen, format_of, looks_like_identifier

#: Bytes of a range where none are given.
RANGE_BYTES = 64 << 20


class RangeReader:
    """Records of one byte range of one file, end exclusive; None reads to the end of the file."""

    def __init__(self, path: str, start: int = 0, end: int | None = None) -> None:
        self.path, self.start, self.end = path, start, end
        self.fastq = format_of(path) == "fastq"
        self.file: BinaryIO | None = None

    def open(self) -> RangeReader:
        if self.file is not None:
            raise InputAlreadyOpen(self.path)
        if not Path(self.path).exists():
            raise InputNotFound(self.path)
        self.file = gzip.open(self.path, "rb") if self.path.endswith(".gz") else open(self.path, "rb")
        self.at = self.start
        if self.start:
            self.file.seek(self.start - 1)
            self.at += len(self.file.readline()) - 1  # what is left of a line that began before
        self.held: list[bytes] = []
        self._find()
        return self

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None

    def _line(self) -> bytes:
        line = self.held.pop(0) if self.held else self.file.readline()
        self.at += len(line)
        return line

    def _back(self, *lines: bytes) -> None:
        self.held[:0] = lines
        self.at -= sum(map(len, lines))

    def _find(self) -> None:
        """Goes to the next beginning of a record. A quality line may look like an identifier too, but no '+' line
        follows two lines after it."""
        while line := self._line():
            if not self.fastq and line.startswith(b">"):
                self._back(line)
                return
            if self.fastq and line.startswith(b"@") and (looks_like_identifier(line.decode("latin-1")) or not self.start):
                more = [self._line(), self._line()]
                self._back(*more)
                if more[1].startswith(b"+"):
                    self._back(line)
                    return

    def next(self) -> tuple[str, str]:
        """(name, seq) of the next record; InputAtEnd if it would begin behind the range."""
        if self.file is None:
            raise InputNotOpen(self.path)
        if self.end is not None and self.at >= self.end:
            raise InputAtEnd(self.path)
        head = self._line()
        if not head:
            raise InputAtEnd(self.path)
        text = lambda line: line.rstrip(b"\r\n").decode()
        if self.fastq:
            seq = text(self._line())
            self._line()
            self._line()
            return text(head)[1:], seq
        parts = []
        while (line := self._line()) and not line.startswith(b">"):
            parts.append(text(line))
        self._back(line)
        return text(head)[1:], "".join(parts)

    def __iter__(self) -> Iterator[tuple[str, str]]:
        while True:
            try:
                yield self.next()
            except InputAtEnd:
                return


class FileRange(InputPartition):
    def __init__(self, path: str, start: int, end: int | None) -> None:
        self.path, self.start, self.end = path, start, end


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = options["path"].split(",")
        self.size = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[FileRange]:
        out = []
        for path in self.paths:
            if not Path(path).exists():
                raise InputNotFound(path)
            format_of(path)
            whole = Path(path).stat().st_size
            if path.endswith(".gz"):
                out.append(FileRange(path, 0, None))
            else:
                out += [FileRange(path, at, min(at + self.size, whole)) for at in range(0, whole, self.size)]
        return out or [FileRange(self.paths[0], 0, 0)]

    def read(self, partition: FileRange) -> Iterator[tuple[str, str, str]]:
        reader = RangeReader(partition.path, partition.start, partition.end).open()
        try:
            for name, seq in reader:
                yield partition.path, name, seq
        finally:
            reader.close()


class SequenceSource(DataSource):
    """Paths, separated by commas, as all machines see them."""

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return "file string, name string, seq string"

    def reader(self, schema) -> SequenceReader:
        return SequenceReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SequenceSource)
