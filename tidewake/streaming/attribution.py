"""Sessions and attribution over a stream: state by entity, with timers.

Rows of one entity wait until the watermark has passed them and are then taken in order of time, so the answer is that of
the batch operators whatever order they came in. A touch that follows a long gap begins a session and closes the head
before it: a head's deadline is its window's end or the next head, whichever is first. A head is given once it is closed,
or once the watermark has passed its window; with its earliest response, or without one.

State of an entity: the rows that wait, the open head, and when its last touch was (which stays, since sessions are
numbered). Rows behind the watermark are lost, as everywhere in streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROWS = "event_id long, entity long, session_no long, response_id long, response_us long, n_candidates long"
WAITING = "us long, is_touch boolean, event_id long"
ENTITY = "session_no long, last_us long, head_id long, head_us long, response_id long, response_us long, n_candidates long"
#: State with timers needs this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attribution(StatefulProcessor):
    """The heads of one entity after another, as they are settled."""

    def __init__(self, gap_us: int, window_us: int) -> None:
        self.gap_us, self.window_us = gap_us, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.entity = handle.getValueState("entity", ENTITY)
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Rows only wait here: all of a batch are there by the time its timers run."""
        first = None
        for part in rows:
            new = list(zip(part["us"].tolist(), part["is_touch"].tolist(), part["event_id"].tolist(), strict=True))
            self.waiting.appendList(new)
            first = min(r[0] for r in new) if first is None else min(first, min(r[0] for r in new))
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.due.clear()
        final = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())  # responses before touches of the same time: a deadline is included
        n = sum(us <= final for us, _, _ in rows)
        state = list(self.entity.get()) if self.entity.exists() else [0, *[None] * 5, 0]
        found = []
        for us, is_touch, event_id in rows[:n]:
            session_no, last_us, head_id, head_us, _, _, count = state
            if not is_touch:
                if head_id is not None and head_us < us <= head_us + self.window_us:
                    state[4:] = [*(state[4:6] if count else (event_id, us)), count + 1]
                continue
            state[1] = us
            if last_us is None or us - last_us >= self.gap_us:
                if head_id is not None:
                    found.append((head_id, key[0], session_no, *state[4:]))
                state[0], state[2:] = session_no + 1, [event_id, us, None, None, 0]
        if state[2] is not None and state[3] + self.window_us <= final:
            found.append((state[2], key[0], state[0], *state[4:]))
            state[2:] = [None, None, None, None, 0]
        if n:
            self.waiting.put(rows[n:]) if rows[n:] else self.waiting.clear()
        self.entity.update(tuple(state))
        ahead = [us for us, _, _ in rows[n : n + 1]] + ([] if state[2] is None else [state[3] + self.window_us])
        if ahead:
            self._wake(min(ahead))
        if found:
            yield pd.DataFrame(found, columns=[x.split()[0] for x in ROWS.split(", ")]).astype("Int64")

    def _wake(self, us: int) -> None:
        """Runs the entity's timer once the watermark has passed ``us``; there is one timer, the earliest."""
        ms = -(-us // 1000)
        if self.due.exists():
            (before,) = self.due.get()
            if before <= ms:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def close(self) -> None:
        pass


def attributed(events: DataFrame, is_touch: Column, gap_us: int, window_us: int, late: str) -> DataFrame:
    """Heads of sessions with their earliest response and the number of candidates, from a stream of touches and
    responses (event_id, entity, ts). It runs on ``PROVIDER``."""
    rows = events.withWatermark("ts", late).select("entity", "ts", "event_id", F.unix_micros("ts").alias("us"), is_touch.alias("is_touch"))
    return rows.groupBy("entity").transformWithStateInPandas(Attribution(gap_us, window_us), ROWS, "append", "eventTime")
