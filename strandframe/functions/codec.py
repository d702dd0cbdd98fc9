"""Two-bit packing of sequences as Arrow UDFs: four letters a byte, the first in the lowest bits, and a zero byte
more where the letters fill the last one. Needed where packed keys are exchanged with other programs; operators here
work on strings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandframe.functions.dna import LETTERS

_CODES = np.zeros(256, np.uint8)
_CODES[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(4)
_LETTERS = np.frombuffer(LETTERS.encode(), np.uint8)


def pack(seq: str) -> bytes:
    """Packed form of a normalised sequence; other characters count as A."""
    codes = _CODES[np.frombuffer(seq.encode(), np.uint8)]
    room = np.zeros((len(codes) // 4 + 1) * 4, np.uint8)
    room[: len(codes)] = codes
    four = room.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()


def unpack(data: bytes, length: int) -> str:
    raw = np.frombuffer(data, np.uint8)
    codes = np.stack([raw >> shift & 3 for shift in (0, 2, 4, 6)], axis=1).ravel()[:length]
    return _LETTERS[codes].tobytes().decode()


def packed(seq: Column) -> Column:
    """Binary column; null stays null."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else pack(x))

    return run(seq)


def unpacked(data: Column, length: Column) -> Column:
    """String column of packed sequences of given lengths; null stays null."""

    @F.pandas_udf("string")
    def run(d: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(k) else unpack(x, int(k)) for x, k in zip(d, n, strict=True)])

    return run(data, length)
