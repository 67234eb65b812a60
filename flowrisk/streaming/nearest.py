"""The latest request before each event, on live streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

COLUMNS = ["us", "is_event", "late", "event_id", "ref"]


class NearestRequest(StatefulProcessor):
    """Events of one worker and time slice with the latest request up to them and less than ``width`` microseconds before.

    Rows wait until the watermark has passed them and are then merged in time order. What stays is the latest request, for
    events that are still to come, and nothing once the slice is over.
    """

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us long, is_event boolean, late long, event_id string, ref string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [tuple(None if v is pd.NA or v != v else v for v in r) for batch in rows for r in batch[COLUMNS].astype(object).itertuples(index=False, name=None)]
        if fresh:
            self.rows.appendList(fresh)
            events = [r[0] for r in fresh if r[1]]
            for us in {min(events, default=self._end(key)), self._end(key)}:
                self.handle.registerTimer(us // 1000 + 1)
        return iter(())

    def _end(self, key) -> int:
        return (int(key[1]) + 1) * self.width

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, seen, best, stay = timerValues.getCurrentWatermarkInMs() * 1000, [], set(), None, []
        rows = [tuple(r) for r in self.rows.get()]
        # At one time requests come before events; the earliest scheduled one is the last of them.
        for row in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[4] or "")):
            us, is_event, _, event, _ = row
            if us > now:
                stay.append(row)
            elif not is_event:
                best = row
            elif (us, event) not in seen:
                seen.add((us, event))
                out.append((event, us, best[4] if best is not None and us - best[0] < self.width else None))
        if now >= self._end(key):
            self.rows.clear()
        elif len(stay) + (best is not None) < len(rows):
            kept = stay if best is None else [best, *stay]
            self.rows.put(kept) if kept else self.rows.clear()
        waiting = [r[0] for r in stay if r[1]]
        if waiting:
            self.handle.registerTimer(min(waiting) // 1000 + 1)
        if out:
            yield pd.DataFrame({"event_id": [e for e, _, _ in out], "actor_id": [key[0]] * len(out),
                                "ts": pd.to_datetime(pd.Series([us for _, us, _ in out], dtype="int64"), unit="us"), "trigger_ref": [r for _, _, r in out]})
