"""State kept for each key of a stream by an operator of its own: what an actor keeps between its messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: State before any row, and the state after some rows of a key.
Update = Callable[[tuple, pd.DataFrame], tuple]


def with_state(stream: DataFrame, key: str, fields: str, start: tuple, update: Update) -> DataFrame:
    """(key, fields...): the state of each key after each batch that has rows of it. fields names the parts of the state
    with their types; update must not depend on the order of rows."""
    kind, names = stream.schema[key].dataType.simpleString(), [key, *(x.split()[0] for x in fields.split(","))]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else start
        for frame in frames:
            now = update(now, frame)
        state.update(now)
        yield pd.DataFrame([(*k, *now)], columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {fields}", fields, "update", GroupStateTimeout.NoTimeout)


def read_totals(stream: DataFrame, file: str = "file", seq: str = "seq") -> DataFrame:
    """(file, reads, bases) as reads arrive; a null sequence is a read of no bases. A null file isn't counted: the state
    has keys that are known."""

    def add(now: tuple, frame: pd.DataFrame) -> tuple:
        return now[0] + len(frame), now[1] + int(frame[seq].str.len().fillna(0).sum())

    return with_state(stream.where(f"{file} is not null").select(file, seq), file, "reads long, bases long", (0, 0), add)
