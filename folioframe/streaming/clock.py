"""A clock that never goes back, over a stream: the state of a run is its time and its last number."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "run string, event_id long, seq long, clock double, late boolean"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, clock = state.get if state.exists else (0, None)
    # One batch of one run in the order of its ids, as the source gives none.
    rows = pd.concat(frames, ignore_index=True).sort_values("event_id", kind="stable")
    at = rows["at"].astype(float)
    first = pd.Series([float("-inf") if clock is None else clock])
    so_far = pd.concat([first, at], ignore_index=True).cummax().ffill()
    latest = so_far.iloc[1:].set_axis(rows.index)
    out = pd.DataFrame({"run": key[0], "event_id": rows["event_id"], "seq": range(seq + 1, seq + 1 + len(rows)), "clock": latest.where(latest != float("-inf")), "late": (at < so_far.iloc[:-1].to_numpy()).to_numpy()})
    end = float(so_far.iloc[-1])
    state.update((seq + len(rows), None if end == float("-inf") else end))
    yield out


def clocked(events: DataFrame) -> DataFrame:
    """``run, event_id, seq, clock, late`` of a stream (or table) ``run string, event_id long, at double``.

    ``seq`` counts a run's events as they arrive, those of one batch by id;
    ``clock`` is the greatest time so far, ``late`` whether the event's own lies
    before it.  A null time keeps the clock and isn't late.  The state of a run
    is two numbers and lives in the query's checkpoint, so a restarted query
    goes on where the last one ended.  A null run is a run of its own.
    """
    keyed = events.selectExpr("run", "event_id", "at")
    return keyed.groupBy("run").applyInPandasWithState(_advance, SCHEMA, "seq long, clock double", "append", GroupStateTimeout.NoTimeout)
