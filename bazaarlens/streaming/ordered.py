"""Ordered per-session folds over a stream that do not depend on how its input is cut.

Rows wait in state until the watermark has passed them, kept by pages: stretches of whole time slots
of about ``PAGE`` rows, cut where they grow longer. A session of few open rows has one page, so it
costs a handful of state calls however many slots its rows lie in. Each page also has the
composition of its steps ``s <- min(cap, a*s + b)``, so a trigger re-reads only the pages that it
adds to, and closing a whole page reads none. A session's state is the value folded up to the
watermark, one small step per page, and the rows of its pages; the rows of one page (of one slot, if
that alone has more) are the most that is in memory at a time.

Every trigger gives each session it touched: the folded value with the pages applied in order.
Once the rows of a session are all there, that is what the batch fold gives, whichever file came
first, as long as no row came later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from bazaarlens.operators.folds import composed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_MS = 24 * 3600 * 1000
OUTPUT = "session_id string, steps long, risk double, upto long"
PAGE = 1000  # open rows of a session that are kept together
_SESSION = "steps long, value double, upto long, pages binary"
_STEP = [("cap", "<f8"), ("a", "<f8"), ("b", "<f8")]
_ROW = np.dtype([("t", "<i8"), ("i", "<i8"), *_STEP])
_PAGES = np.dtype([("slot", "<i8"), ("n", "<i8"), *_STEP])


def _run(value: float, steps: np.ndarray) -> float:
    """``value`` after steps in order."""
    for cap, a, b in zip(steps["cap"].tolist(), steps["a"].tolist(), steps["b"].tolist(), strict=True):
        value = min(cap, a * value + b)
    return value


class OrderedFold(StatefulProcessor):
    """Folds the steps of a session in time order, late arrivals within the watermark included."""

    def __init__(self, slot_ms: int):
        self.slot_ms = slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _SESSION)
        # a page by its first slot
        self.rows = handle.getMapState("rows", "slot long", "rows binary")

    def _load(self) -> tuple[int, float, int, np.ndarray]:
        """Folded steps, their value, the latest time seen, and the pages in time order."""
        held = self.session.get()
        if held is None:
            return 0, 0.0, 0, np.empty(0, _PAGES)
        return *held[:3], np.frombuffer(held[3], _PAGES)

    def _keep(self, steps: int, value: float, upto: int, pages: np.ndarray) -> None:
        self.session.update((steps, value, upto, pages.tobytes()))

    def _slots(self, rows: np.ndarray) -> np.ndarray:
        return rows["t"] // (self.slot_ms * 1000)

    def _read(self, slot: int) -> np.ndarray:
        return np.frombuffer(self.rows.getValue((slot,))[0], _ROW)

    def _write(self, rows: np.ndarray) -> np.ndarray:
        """Store ordered rows as pages and give their entries."""
        slots, cuts = self._slots(rows), []
        if len(rows) > PAGE:  # at about every half page, where a slot begins
            cuts = np.unique(np.searchsorted(slots, slots[PAGE // 2::PAGE // 2]))
        code = np.zeros(len(rows), int)
        code[[c for c in cuts if c]] = 1
        code = np.cumsum(code)
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        pages = np.empty(len(starts), _PAGES)
        pages["slot"], pages["n"] = slots[starts], np.diff(np.append(starts, len(rows)))
        pages["cap"], pages["a"], pages["b"] = composed(code, rows["cap"], rows["a"], rows["b"])
        for slot, own in zip(pages["slot"].tolist(), np.split(rows, starts[1:]), strict=True):
            self.rows.updateValue((slot,), (own.tobytes(),))
        return pages

    def _add(self, pages: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Put rows into the pages of their slots; what lies before all pages goes to the first."""
        rows = rows[np.lexsort((rows["i"], rows["t"]))]
        if not len(pages):
            return self._write(rows)
        home = np.maximum(np.searchsorted(pages["slot"], self._slots(rows), "right") - 1, 0)
        starts = np.flatnonzero(np.diff(home, prepend=-1))
        grown = []
        for page, own in zip(home[starts].tolist(), np.split(rows, starts[1:]), strict=True):
            slot = int(pages["slot"][page])
            own = np.concatenate((self._read(slot), own))
            own = own[np.lexsort((own["i"], own["t"]))]
            if self._slots(own[:1])[0] != slot:
                self.rows.removeKey((slot,))
            grown.append(self._write(own))
        pages = np.concatenate((np.delete(pages, home[starts]), *grown))
        return pages[np.argsort(pages["slot"])]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps, value, upto, pages = self._load()
        idle = not len(pages)
        for chunk in rows:
            new = np.empty(len(chunk), _ROW)
            for column in _ROW.names:
                new[column] = chunk[column].to_numpy()
            pages = self._add(pages, new)
            upto = max(upto, int(new["t"].max()))
        self._keep(steps, value, upto, pages)
        if idle:
            self._wake(pages)
        n, now = steps + int(pages["n"].sum()), _run(value, pages)
        yield pd.DataFrame({"session_id": [key[0]], "steps": [n], "risk": [now], "upto": [upto]})

    def _wake(self, pages: np.ndarray) -> None:
        self.handle.registerTimer((int(pages["slot"][0]) + 1) * self.slot_ms)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Fold the slots that the watermark has passed; forget a session that is idle for a day."""
        mark = timerValues.getCurrentWatermarkInMs()
        steps, value, upto, pages = self._load()
        passed = mark // self.slot_ms  # slots below are over
        over = int(np.searchsorted(pages["slot"], passed))
        if over:
            # the pages before the last of these are over as wholes; that one may go on
            last = int(pages["slot"][over - 1])
            value = _run(value, pages[:over - 1])
            rows = self._read(last)
            done = int(np.searchsorted(self._slots(rows), passed))
            value = _run(value, rows[:done])
            steps += int(pages["n"][:over - 1].sum()) + done
            for slot in pages["slot"][:over].tolist():
                self.rows.removeKey((slot,))
            left = [self._write(rows[done:])] if done < len(rows) else []
            pages = np.concatenate((*left, pages[over:]))
        if len(pages):
            self._wake(pages)
        elif upto // 1000 + IDLE_MS <= mark:
            self.session.clear()
            return iter(())
        else:
            self.handle.registerTimer(upto // 1000 + IDLE_MS)
        self._keep(steps, value, upto, pages)
        return iter(())

    def close(self) -> None:
        pass


def ordered_fold(
    log: DataFrame, a: Column, b: Column, cap: Column | None = None, slot_ms: int = 60_000,
    key: str = "session_id", time: str = "timestamp", tie: str = "request_id",
) -> DataFrame:
    """Running ``s <- min(cap, a*s + b)`` per session; ``log`` has a watermark on ``time``.

    The state lives in the RocksDB store, which this sets for the session where it has another.
    """
    spark = log.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    limit = F.lit(float("inf")) if cap is None else cap
    steps = log.select(
        F.col(key).cast("string").alias("session_id"), time,
        F.unix_micros(time).alias("t"), F.coalesce(F.col(tie).cast("long"), F.lit(-2**63)).alias("i"),
        limit.cast("double").alias("cap"), a.cast("double").alias("a"), b.cast("double").alias("b"),
    )
    out = steps.groupBy("session_id").transformWithStateInPandas(
        OrderedFold(slot_ms), OUTPUT, "Update", "EventTime"
    )
    return out.withColumn("upto", F.timestamp_micros("upto"))
