"""Ledgers with state over a stream: work checkpoints that only go forward within a phase, and attempts numbered by content.

Both take a stream and keep one small state for each key in Spark's state store, so a query that is started again from its checkpoint goes on
where it was. Within a batch rows are taken in order of (time, id); a row that comes in a later batch with an earlier time than its key's
last one is late: it is reported and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ACCEPTED, REGRESSION, LATE, REPEATED, NEW = "accepted", "regression", "late", "repeated", "new"


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")


def _checkpoint(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    phase, done, last = state.get if state.exists else (None, 0, None)
    out = []
    seen = pd.Timestamp(last) if last is not None else None
    for r in _rows(frames).itertuples():
        if seen is not None and r.ts < seen:
            out.append((key[0], r.event_id, LATE, phase, done))
            continue
        if phase is not None and r.phase == phase and r.completed < done:
            status = REGRESSION
        else:
            status, phase, done = ACCEPTED, r.phase, int(r.completed)
        out.append((key[0], r.event_id, status, phase, done))
        last_seen = r.ts
        state.update((phase, done, last_seen.to_pydatetime()))
    yield pd.DataFrame(out, columns=["job", "event_id", "status", "phase", "completed"])


def checkpoints(events: DataFrame) -> DataFrame:
    """job, event_id, status, phase, completed after each event. events: job, event_id (long), ts, phase, completed; null jobs form one job.

    An event is accepted if it begins another phase or completes no less than its phase has; a regression changes nothing.
    """
    kind = dict(events.dtypes)["job"]
    return events.groupBy("job").applyInPandasWithState(
        _checkpoint, f"job {kind}, event_id long, status string, phase string, completed long", "phase string, completed long, last timestamp", "append", GroupStateTimeout.NoTimeout
    )


def _attempt(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = list(state.get[0]) if state.exists else []
    at = {f: i + 1 for i, f in enumerate(known)}
    out = []
    for r in _rows(frames).itertuples():
        status = REPEATED if r.fingerprint in at else NEW
        if status == NEW:
            known.append(r.fingerprint)
            at[r.fingerprint] = len(known)
        out.append((*key, r.event_id, at[r.fingerprint], status))
    state.update((known,))
    yield pd.DataFrame(out, columns=["iteration", "renderer", "build", "event_id", "attempt", "status"])


def attempts(events: DataFrame) -> DataFrame:
    """iteration, renderer, build, event_id, attempt, status of each event. events: these keys, event_id (long), ts, fingerprint.

    A fingerprint that its cycle has seen keeps its attempt number, whenever it comes; another one gets the next. A cycle's state is its fingerprints.
    """
    kinds = dict(events.dtypes)
    keys = ["iteration", "renderer", "build"]
    return events.groupBy(*keys).applyInPandasWithState(
        _attempt, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", event_id long, attempt long, status string", "known array<string>", "append", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a streaming query over all that is there and returns all rows it ever gave. Its checkpoint and rows lie under `folder`, so that a second call goes on."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
