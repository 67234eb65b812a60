"""Open/close tracking on a live stream, with the results of the batch form.

Two keyed operators. The first one, by buckets of resources, opens a watch and follows the resource; the second one, by the actor that opened it, settles
watches at that actor's windows. Both keep what arrives until the watermark has passed it and then take it in time order,
so events may come in any order and any batch. The state of a resource whose watch is closed is one flag.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowrisk.config import ClosureConfig

HOUR_US = 3_600_000_000
BUCKETS = 256  # of resources whose state is kept under one key; fixed for the life of a stream
MESSAGE = ("resource_id string, status string, at timestamp, actor_id string, opening_ts timestamp, opening_event_id string, "
           "opening_action_type string, resource_type string, expected_close_type string")
CLOSING = "resource_id string, status string, at timestamp, actor_id string"
# Order of messages at the same time: a window settles what is quiet by then, and a closing at that time comes first.
RANK = {"OPENED": 0, "QUIET": 1, "ACTIVE": 2, "CLOSED": 3, "EXPIRED": 4, "WINDOW": 5}


class Rules:
    """What opens a resource, what closes it and when, from the configuration and a list of pairs.

    A pair is (pair_id, opening action, closing action, window hours, tier); there is at most one per pair of action types.
    """

    def __init__(self, cfg: ClosureConfig, pairs: list[tuple]):
        self.cfg, self.by_opening, self.closers = cfg, {}, {}
        for pair_id, opening, closing, hours, tier in sorted(pairs, key=lambda p: (p[4], p[0], p[2], p[3])):
            self.by_opening.setdefault(opening, (closing, hours))
            self.closers.setdefault(closing, set()).add(opening)

    def opens(self, action: str | None, zone: str | None) -> bool:
        return action in self.cfg.opening_types or action in self.by_opening or zone in self.cfg.failsafe_zones

    def watch(self, action: str, opened: int) -> tuple[str, str, int, int]:
        """(resource type, expected closing, time of expiry or -1, microseconds of quiet to settle or 0)."""
        cfg = self.cfg
        kind = cfg.resource_types.get(action, "UNKNOWN")
        quiet = 0 if kind in cfg.never_settle else int(cfg.settlement_hours.get(kind, cfg.default_settlement_hours) * HOUR_US)
        if action in self.by_opening:
            return kind, self.by_opening[action][0], -1, quiet
        if action in cfg.temporal_ttl:
            return kind, "TEMPORAL_EXPIRY", opened + int(cfg.temporal_ttl[action] * HOUR_US), quiet
        return kind, "SETTLEMENT", -1, quiet

    def closes(self, action: str | None, opening: str, expected: str) -> bool:
        openings = self.closers.get(action)
        return openings is not None and (action == expected or (expected not in self.closers and opening in openings))


def _times(us: list[int]) -> pd.Series:
    return pd.to_datetime(pd.Series(us, dtype="int64"), unit="us")


class InTimeOrder(StatefulProcessor):
    """Keeps rows in state until the watermark has passed them, then hands them on in order.

    ``waiting`` lists (time in microseconds, rank, id) and the row's values, so that a batch is one call to the state and not one per row.
    Of rows with equal time, rank and id the last one counts. A timer stands at the earliest time at which there is something to do.
    """

    value, width = "", 3  # the columns of a row, and how many of all tell rows apart

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us long, rank int, id string, {self.value}")

    def wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def keep(self, rows: Iterator[pd.DataFrame], row) -> None:
        fresh = [row(values) for batch in rows for values in batch.itertuples(index=False)]
        if fresh:
            self.waiting.appendList([(*key, *value) for key, value in fresh])
            self.wake(min(key[0] for key, _ in fresh))

    def passed(self, watermark_ms: int) -> tuple[list[tuple], int | None]:
        """Rows up to the watermark in order, taken out of the state, and the time of the first one that stays."""
        ready, stay = {}, []
        for row in self.waiting.get():
            if row[0] <= watermark_ms * 1000:
                ready[tuple(row[:self.width])] = tuple(row[self.width:])
            else:
                stay.append(tuple(row))
        if ready and stay:
            self.waiting.put(stay)
        elif ready:
            self.waiting.clear()
        return sorted(ready.items(), key=lambda r: r[0]), min((row[0] for row in stay), default=None)

    def close(self) -> None:
        pass


class FollowResources(InTimeOrder):
    """Messages of the resources of one bucket: OPENED, QUIET (for as long as it takes to settle), ACTIVE (again), and CLOSED or EXPIRED, the last one.

    A bucket's rows are one call to the state and one table of messages, a resource that has rows is one or two calls. Times at which a resource is to be looked at
    again are rows without an action that wait like events.
    """

    value, width = "resource string, actor string, action string, zone string", 4

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.watch = handle.getMapState("watch", "resource string", "opened long, event string, actor string, action string, kind string, expected string, expiry long, quiet long, last long, still boolean, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.keep(rows, lambda r: ((int(r.us), 0, r.event_id, r.resource_id), (r.actor_id, r.action_type, r.target_zone)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready, later = self.passed(now)
        of: dict[str, list[tuple]] = {}
        for (us, rank, event, resource), values in ready:
            of.setdefault(resource, []).append((us, rank, event, *values))
        out, again = [], []
        for resource, rows in of.items():
            before = self.watch.getValue((resource,))
            if before is not None and before[-1]:
                continue
            before = None if before is None else tuple(before[:-1])
            w, told, ended = self.follow(before, [(us, event, *values) for us, rank, event, *values in rows if rank == 0], now)
            out += [(resource, status, us, w) for status, us in told]
            if ended:
                self.watch.updateValue((resource,), (*[None] * 10, True))
            elif w is not None:
                if w != before:
                    self.watch.updateValue((resource,), (*w, False))
                expiry, quiet, last, still = w[6:]
                times = [t for t in (last + quiet if quiet and not still else None, expiry if expiry >= 0 else None) if t is not None]
                if times:
                    again.append((min(times), 1, "", resource, None, None, None))
        if again:
            self.waiting.appendList(again)
            later = min(later if later is not None else again[0][0], *(row[0] for row in again))
        if later is not None:
            self.wake(later)
        if out:
            ws = [w for *_, w in out]
            yield pd.DataFrame({"resource_id": [r for r, *_ in out], "status": [s for _, s, _, _ in out], "at": _times([us for _, _, us, _ in out]), "actor_id": [w[2] for w in ws], "opening_ts": _times([w[0] for w in ws]),
                                "opening_event_id": [w[1] for w in ws], "opening_action_type": [w[3] for w in ws], "resource_type": [w[4] for w in ws], "expected_close_type": [w[5] for w in ws]})

    def follow(self, w: tuple | None, events: list[tuple], now: int) -> tuple[tuple | None, list[tuple[str, int]], bool]:
        """The watch of one resource after its events up to the watermark, what is to be told, and whether it is over."""
        out, ended = [], False

        def tell(status: str, us: int) -> None:
            out.append((status, us))

        for us, event, actor, action, zone in events:
            if w is None:
                if self.rules.opens(action, zone):
                    w = (us, event, actor, action, *self.rules.watch(action, us), us, False)
                    tell("OPENED", us)
                continue
            _, _, _, opening, _, expected, expiry, quiet, last, still = w
            closing = self.rules.closes(action, opening, expected)
            if expiry >= 0 and (expiry < us or (expiry == us and not closing)):
                break  # below
            if quiet and not still and last + quiet < us:
                tell("QUIET", last + quiet)
                still = True
            if still:
                tell("ACTIVE", us)
            if closing:
                tell("CLOSED", us)
                ended = True
                break
            w = (*w[:8], us, False)
        if w is not None and not ended:
            expiry, quiet, last, still = w[6:]
            settled = last + quiet
            if quiet and not still and settled <= now * 1000 and not 0 <= expiry < settled:
                tell("QUIET", settled)
                w = (*w[:9], True)
            if 0 <= expiry <= now * 1000:
                tell("EXPIRED", expiry)
                ended = True
        return w, out, ended


def track_watches(events: DataFrame, cfg: ClosureConfig = ClosureConfig(), delay: str = "2 hours", pairs: DataFrame | None = None) -> DataFrame:
    """What happens to the watch of every resource, as a stream of messages in the order of the watermark.

    A watch opens at the first opening event ever. OPENED, CLOSED (the earliest closing event after it) and EXPIRED are those of the batch form; QUIET and ACTIVE bound the times at
    which it may settle (``settle_watches``). ``pairs`` are the opening and closing pairs, discovered ones included; by default
    those of the configuration. A resource without an opening event keeps nothing but what the watermark has not passed.
    """
    rules = Rules(cfg, [tuple(p) for p in cfg.pairs] if pairs is None else
                  [tuple(r) for r in pairs.select("pair_id", "opening_action_type", "closing_action_type", "window_hours", "tier").collect()])
    rows = events.withWatermark("ts", delay).where(F.col("target_id").isNotNull()).select(
        F.col("target_id").alias("resource_id"), "ts", F.unix_micros("ts").alias("us"), F.coalesce("event_id", F.lit("")).alias("event_id"), "actor_id", "action_type", "target_zone")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("resource_id"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(FollowResources(rules), MESSAGE, "append", "EventTime")


class SettleAtWindows(InTimeOrder):
    """Closings of the watches that one actor opened: at the first window of the actor while the resource is quiet, unless it was closed before."""

    value = "status string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "resource_id string", "open boolean")
        self.quiet = handle.getMapState("quiet", "resource_id string", "quiet boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.keep(rows, lambda r: ((int(r.us), RANK[r.status], r.resource_id), (r.status,)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, opened, quieted = [], {r for r, in self.open.keys()}, {r for r, in self.quiet.keys()}
        open_, quiet = set(opened), set(quieted)

        def end(resource: str, status: str, us: int) -> None:
            out.append((resource, status, us))
            open_.discard(resource)
            quiet.discard(resource)

        ready, later = self.passed(timerValues.getCurrentWatermarkInMs())
        for (us, _, resource), (status,) in ready:
            if status == "WINDOW":
                for still in sorted(quiet):
                    end(still, "SETTLED", us)
            elif status == "OPENED":
                open_.add(resource)
            elif resource in open_:
                if status == "QUIET":
                    quiet.add(resource)
                elif status == "ACTIVE":
                    quiet.discard(resource)
                else:
                    end(resource, status, us)
        for state, before, now in ((self.open, opened, open_), (self.quiet, quieted, quiet)):  # only what changed is written
            for resource in before - now:
                state.removeKey((resource,))
            for resource in now - before:
                state.updateValue((resource,), (True,))
        if later is not None:
            self.wake(later)
        if out:
            yield pd.DataFrame({"resource_id": [r for r, _, _ in out], "status": [s for _, s, _ in out], "at": _times([us for _, _, us in out]), "actor_id": [key[0]] * len(out)})


def settle_watches(messages: DataFrame, windows: DataFrame, delay: str = "2 hours") -> DataFrame:
    """How and when every watch closes: CLOSED, EXPIRED or SETTLED, whichever is first, from two streams.

    ``messages`` are those of ``track_watches`` and ``windows`` the closed windows (window_start, actor_id) of all actors, as ``actor_window_stream`` gives
    them. ``delay`` has to cover the time that one batch of these streams spans, as its rows may be read in any order. State per actor: its
    open watches, and what the watermark has not passed.
    """
    message = messages.where(F.col("actor_id").isNotNull()).select("actor_id", "at", "resource_id", "status")
    window = windows.where(F.col("actor_id").isNotNull()).select("actor_id", F.col("window_start").alias("at"), F.lit("").alias("resource_id"), F.lit("WINDOW").alias("status"))
    rows = message.withWatermark("at", delay).unionByName(window.withWatermark("at", delay)).withColumn("us", F.unix_micros("at"))
    return rows.groupBy("actor_id").transformWithStateInPandas(SettleAtWindows(), CLOSING, "append", "EventTime")
