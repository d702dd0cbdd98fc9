"""Encoding with a public byte-level BPE vocabulary by prefix dynamic programming.

Of every byte prefix of a piece exactly one token can be the last of its encoding: the one that is compatible with
the last token of what stands before it. Storing that token for each prefix gives the encoding of all prefixes at
once; appending bytes only adds entries, and an edit only touches what stands after it in its own piece.

Texts are cut into lines where no piece can cross, and lines into pieces by the tokenizer's pattern. Encodings of
lines and pieces are kept in tables of bounded size in each Python worker; they are pure functions of the string.
"""

from __future__ import annotations

from array import array
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter of every function below.
TOKENIZERS = "/opt/tokenizers"
#: Pattern that cuts a text into pieces, of the public byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries kept a worker.
LINES_KEPT, PIECES_KEPT = 1 << 17, 1 << 19


class Vocabulary:
    """Tokens by bytes; ids are merge ranks, so a lower id is merged earlier."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ids = ranks
        self.text = {i: t for t, i in ranks.items()}
        self.longest = [0] * 256
        for t in ranks:
            self.longest[t[-1]] = max(self.longest[t[-1]], len(t))
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1 and (pair := self._halves(t, i)):
                self.halves[i] = pair
                self.joined[pair] = i
        self.fits: dict[tuple[int, int], bool] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one: what merging its bytes with all earlier merges leaves."""
        parts = [self.ids[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                if (j := self.joined.get((parts[i], parts[i + 1]), rank)) < best:
                    best, at = j, i
            if at < 0:
                return None
            parts[at : at + 2] = [best]
        return parts[0], parts[1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, together, encode to just these two.

        Merges are undone from the latest on, at the seam: a seam merge that comes before the merge undone last
        would have happened first. Of two equal merges the left one comes first.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, before = left, right, len(self.text) + 1
        good = True
        while True:
            if self.joined.get((a, b), before) < before:
                good = False
                break
            open_a, open_b = a in self.halves, b in self.halves
            if open_a and (not open_b or a > b):
                before, a = a, self.halves[a][1]
            elif open_b:
                before, b = b + 1, self.halves[b][0]
            else:
                break
        if len(self.fits) >= PIECES_KEPT:
            self.fits.clear()
        self.fits[left, right] = good
        return good


@lru_cache(maxsize=4)
def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Vocabulary:
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    return Vocabulary({b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class PrefixTable:
    """The last token of every byte prefix of one piece."""

    def __init__(self, vocab: Vocabulary, data: bytes = b"") -> None:
        self.vocab, self.data, self.last = vocab, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Adds bytes; nothing that is stored changes."""
        data = self.data + more
        ids, longest, compatible, last = self.vocab.ids, self.vocab.longest, self.vocab.compatible, self.last
        for end in range(len(self.data) + 1, len(data) + 1):
            for begin in range(max(0, end - longest[data[end - 1]]), end):
                token = ids.get(data[begin:end])
                if token is not None and (not begin or compatible(last[begin - 1], token)):
                    last.append(token)
                    break
        self.data = data

    def truncate(self, size: int) -> None:
        """Keeps the first bytes only; their encoding is stored already."""
        self.data = self.data[:size]
        del self.last[size:]

    def tokens(self, size: int | None = None) -> list[int]:
        """Ids of the first `size` bytes, of all of them by default."""
        at, out = len(self.data) if size is None else size, []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocab.text[out[-1]])
        return out[::-1]


def lines_of(text: str) -> Iterator[str]:
    """Cuts a text before line ends that follow a character other than white space. No piece crosses such a cut:
    a piece with white space after its first character has nothing else, and one before it ends there."""
    held = ""
    for i, part in enumerate(text.split("\n")):
        if not i:
            held = part
        elif held and not held[-1].isspace():
            yield held
            held = "\n" + part
        else:
            held += "\n" + part
    if held:
        yield held


class Encoder:
    """Encodes texts with one vocabulary."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> None:
        self.vocab = vocabulary(name, folder)
        self.cut = regex.compile(PATTERN).findall
        self.pieces: dict[str, array] = {}
        self.lines: dict[str, array] = {}

    def piece(self, text: str) -> array:
        known = self.pieces.get(text)
        if known is None:
            data = text.encode()
            whole = self.vocab.ids.get(data)
            known = array("i", PrefixTable(self.vocab, data).tokens() if whole is None else (whole,))
            if len(text) <= 64:
                if len(self.pieces) >= PIECES_KEPT:
                    self.pieces.clear()
                self.pieces[text] = known
        return known

    def line(self, text: str) -> array:
        known = self.lines.get(text)
        if known is None:
            known = array("i")
            pieces = self.pieces
            for x in self.cut(text):
                known += pieces.get(x) or self.piece(x)
            if len(text) <= 256:
                if len(self.lines) >= LINES_KEPT:
                    self.lines.clear()
                self.lines[text] = known
        return known

    def encode(self, text: str) -> array:
        out = array("i")
        lines = self.lines
        for x in lines_of(text):
            out += lines.get(x) or self.line(x)
        return out

    def count(self, text: str) -> int:
        return sum(len(self.line(x)) for x in lines_of(text))


class EncodedText:
    """A text with its ids, kept by line, for appends and edits that re-encode no more than the lines they touch."""

    def __init__(self, encoder: Encoder, text: str = "") -> None:
        self.encoder = encoder
        self.parts = list(lines_of(text))

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def ids(self) -> list[int]:
        return [i for p in self.parts for i in self.encoder.line(p)]

    def append(self, more: str) -> None:
        tail = self.parts.pop() if self.parts else ""
        self.parts += lines_of(tail + more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts `new` in the place of characters start..end (end exclusive)."""
        at, first, last, head = 0, None, 0, 0
        for i, p in enumerate(self.parts):
            if first is None and at + len(p) >= start:
                first, head = max(0, i - 1), at - (len(self.parts[i - 1]) if i else 0)
            at += len(p)
            last = i + 1
            if at > end:
                break
        first = first or 0
        stop = min(len(self.parts), last + 1)
        old = "".join(self.parts[first:stop])
        self.parts[first:stop] = lines_of(old[: start - head] + new + old[end - head :])


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, folder: str) -> Encoder:
    """The encoder of this Python process."""
    if (name, folder) not in _encoders:
        _encoders[name, folder] = Encoder(name, folder)
    return _encoders[name, folder]


def encode_column(df: DataFrame, id: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids): ids of each text without special tokens, whose strings are ordinary text here. Empty and null
    texts have an empty list; each row gives one row, repeated ones too. One pass, no shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):  # bounds what is held at once
                values, offsets = array("i"), [0]
                for t in texts.slice(at, 256):
                    if t.is_valid:
                        values += enc.encode(t.as_py())
                    offsets.append(len(values))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(values, np.int32) if values else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), lists], ["id", "ids"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id)


def count_column(df: DataFrame, id: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, n_tokens): number of ids of each text; 0 for empty and null texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            sizes = [enc.count(t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["id", "n_tokens"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(count, f"id {kind}, n_tokens long").withColumnRenamed("id", id)
