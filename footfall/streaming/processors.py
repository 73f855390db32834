"""Keyed state of the streams: a visitor's live session, the count of a minute, the first session of a visitor.

State lives in the RocksDB store, a value a key, and is written as it changes: a micro-batch costs what it touches. Rows of a
key are put in the order of their time within a micro-batch; what must not depend on the cutting into micro-batches waits
in the state until the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Class of the state store that processors need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SESSION = [
    ("session_id", int), ("started_at", int), ("last_seen_at", int), ("pageviews", int), ("event_count", int), ("engaged_seconds", int),
    ("conversions", int), ("landing_path", str), ("exit_path", str), ("triple", str), ("click", str),
]
PAYLOAD = [
    ("at", int), ("payload_id", int), ("origin", int), ("n_events", int), ("n_pageviews", int), ("n_conversions", int), ("heartbeat", int),
    ("has_pageview", int), ("page_path", str), ("triple", str), ("click", str),
]
SHOWN = [n for n, _ in SESSION if n not in ("triple", "click")]


def _schema(fields: list[tuple[str, type]]) -> StructType:
    return StructType([StructField(n, LongType() if k is int else StringType()) for n, k in fields])


def advance(live: dict | None, p: dict, timeout: int) -> tuple[dict | None, bool]:
    """The visitor's session after one payload, and whether the payload counted in it.

    Server rows (``origin`` 1) and rows without events extend a session that is live, and never open one."""
    held = live
    if live and p["at"] - live["last_seen_at"] > timeout:
        live = None
    opens = p["origin"] == 0 and p["n_events"] > 0
    tagged = opens and p["has_pageview"] and (p["triple"] != "||" or p["click"] != "")
    if live and tagged and (p["triple"] != live["triple"] or (p["click"] != "" and p["click"] != live["click"])):
        live = None
    if live is None:
        if not opens:
            return held, False
        live = {n: 0 for n, _ in SESSION}
        live.update(
            session_id=p["payload_id"], started_at=p["at"], last_seen_at=p["at"], landing_path=p["page_path"], exit_path=p["page_path"],
            triple=p["triple"], click=p["click"],
        )
    return {
        **live,
        "last_seen_at": max(live["last_seen_at"], p["at"]),
        "pageviews": live["pageviews"] + p["n_pageviews"],
        "event_count": live["event_count"] + p["n_events"],
        "engaged_seconds": live["engaged_seconds"] + p["heartbeat"],
        "conversions": live["conversions"] + p["n_conversions"],
        "exit_path": p["page_path"] if p["n_pageviews"] else live["exit_path"],
    }, True


def _tuple(row: dict, fields: list[tuple[str, type]]) -> tuple:
    return tuple(None if row[n] is None else kind(row[n]) for n, kind in fields)


class LiveSessions(StatefulProcessor):
    """A visitor's payloads wait until the watermark has passed them, are folded into the session in order, and every session
    that changed comes out with its totals. State: the session, and the payloads that wait (at most those of ``late``).
    Payloads behind the watermark when they come take no part; a row without session tells how many."""

    def __init__(self, timeout: int) -> None:
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _schema(SESSION))
        self.waiting = handle.getListState("waiting", _schema(PAYLOAD))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [n for n, _ in PAYLOAD]
        came = [_tuple(r, PAYLOAD) for part in rows for r in part[names].to_dict("records")]
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        new = [r for r in came if r[0] >= passed]
        if new:
            self.waiting.appendList(new)
        if len(new) < len(came):
            yield pd.DataFrame([{"visitor_key": key[0], **dict.fromkeys(SHOWN), "late_payloads": len(came) - len(new)}])
        yield from self._settle(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues)

    def _settle(self, key, timer_values) -> Iterator[pd.DataFrame]:
        passed = timer_values.getCurrentWatermarkInMs() // 1000  # whole seconds, as rows have them
        names = [n for n, _ in PAYLOAD]
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, left = [r for r in waiting if r[0] < passed], [r for r in waiting if r[0] >= passed]
        live = dict(zip([n for n, _ in SESSION], self.session.get(), strict=True)) if self.session.exists() else None
        touched: dict[int, dict] = {}
        for r in ready:
            live, counted = advance(live, dict(zip(names, r, strict=True)), self.timeout)
            if counted:
                touched[live["session_id"]] = live
        if ready:
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        over = live is not None and live["last_seen_at"] + self.timeout < passed and not left
        if over:
            self.session.clear()
        elif touched:
            self.session.update(_tuple(live, SESSION))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if left:
            self.handle.registerTimer((left[0][0] + 1) * 1000)
        elif live is not None and not over:
            self.handle.registerTimer((live["last_seen_at"] + self.timeout + 1) * 1000)
        if touched:
            yield pd.DataFrame([{"visitor_key": key[0], **{n: s[n] for n in SHOWN}, "late_payloads": 0} for s in touched.values()])

    def close(self) -> None:
        pass


class MinuteLimit(StatefulProcessor):
    """The first ``most`` payloads of each visitor's minute. A key is a minute and a bucket of visitors, whose counts are one value,
    so that the calls to the store do not grow with the visitors; it is dropped when the watermark has passed the minute."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        counts = [StructField("visitors", ArrayType(StringType())), StructField("used", ArrayType(LongType()))]
        self.counts = handle.getValueState("counts", StructType(counts))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used: dict[str | None, int] = {}
        if self.counts.exists():
            used.update(zip(*self.counts.get(), strict=True))
        else:
            self.handle.registerTimer((int(key[1]) + 1) * 60_000)
        new = pd.concat(list(rows)).sort_values(["received_at", "payload_id"])
        kept = []
        for v in new["visitor_key"].tolist():
            v = v if isinstance(v, str) else None  # pandas may give a null as NaN, which equals nothing
            had = used.get(v, 0)
            used[v] = had + 1
            kept.append(had < self.most)
        self.counts.update((list(used), list(used.values())))
        yield new.loc[kept, ["payload_id", "visitor_key"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


class FirstSession(StatefulProcessor):
    """Whether a session's visitor had one before: the start of the first is the state, kept for good."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "session_id"])
        low = int(new["at"].iloc[0])
        had = self.first.get()[0] if self.first.exists() else None
        if had is None or low < had:
            self.first.update((low,))
            had = low
        flags = (new["at"] > had).astype("int32").where(new["id_mode"] == 1).astype("Int32")
        yield pd.DataFrame({"session_id": new["session_id"].to_numpy(), "is_returning": flags.to_numpy()})

    def close(self) -> None:
        pass


CLICK = [("t", int), ("click_id", int), ("x", int), ("y", int)]


class RageClicks(StatefulProcessor):
    """The n-th click on one element within ``ms`` and ``px``. State: clicks that wait for the watermark, and of the last
    ``ms`` the newest n + 1 of each pixel, which are enough to tell the n-th from later ones."""

    def __init__(self, ms: int, px: int, n: int) -> None:
        self.ms, self.px, self.n = ms, px, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", _schema(CLICK))
        self.waiting = handle.getListState("waiting", _schema(CLICK))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        came = [tuple(map(int, r)) for part in rows for r in part[[n for n, _ in CLICK]].itertuples(index=False)]
        if new := [r for r in came if r[0] >= passed]:
            self.waiting.appendList(new)
        yield from self._settle(key, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, passed: int) -> Iterator[pd.DataFrame]:
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, left = [r for r in waiting if r[0] < passed], [r for r in waiting if r[0] >= passed]
        pixels: dict[tuple[int, int], list[tuple]] = {}
        for r in sorted(tuple(r) for r in self.recent.get()) if self.recent.exists() else []:
            pixels.setdefault((r[2], r[3]), []).append(r)
        found = []
        for r in ready:
            t, _, x, y = r
            pixels[x, y] = [*pixels.get((x, y), ())[-self.n :], r]
            near = 0
            for (px, py), clicks in list(pixels.items()):
                live = [c for c in clicks if t - c[0] < self.ms]
                if not live:
                    del pixels[px, py]
                elif abs(px - x) < self.px and abs(py - y) < self.px:
                    near += len(live)
            if near == self.n:
                found.append(r)
        if ready:
            self._store(self.waiting, left)
            self._store(self.recent, [c for clicks in pixels.values() for c in clicks if passed - c[0] < self.ms])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if left:
            self.handle.registerTimer(left[0][0] + 1)
        elif pixels and (newest := max(c[0] for clicks in pixels.values() for c in clicks)) + self.ms > passed:
            self.handle.registerTimer(newest + self.ms)
        else:
            self.recent.clear()
        if found:
            yield pd.DataFrame([{**dict(zip(("session_id", "pv", "element"), key, strict=True)), "click_id": i, "x": x, "y": y} for _, i, x, y in found])

    @staticmethod
    def _store(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass
