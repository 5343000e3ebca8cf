"""Interval pairing over a stream of events, with a state per processor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.shipping import ship

OUT = "proc long, start long, stop long"
STATE = "began long"


def paired(events: DataFrame, opens: str, closes: str) -> DataFrame:
    """A stream (proc, time, seq, type) -> closed intervals (proc, start, stop), appended as they close.

    Events of a processor are taken in order of (time, seq) inside of each micro-batch; the state is the
    start of the interval that is open, one long a processor. Of two openings the later one counts, and
    a closing event without an opening is passed over, as in the batch operator.
    """
    ship(events.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        began = state.get[0] if state.exists else None
        rows = []
        held = pd.concat(list(frames)).sort_values(["time", "seq"])
        for time, kind in zip(held["time"], held["type"], strict=True):
            if kind == opens:
                began = int(time)
            elif kind == closes:
                if began is not None:
                    rows.append((key[0], began, int(time)))
                began = None
        if began is None:
            if state.exists:
                state.remove()
        else:
            state.update((began,))
        yield pd.DataFrame(rows, columns=["proc", "start", "stop"])

    some = events.where(events["type"].isin(opens, closes))
    return some.groupBy("proc").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
