"""The ordered fold touches its state by pages of rows, not by rows or slots."""

import numpy as np
import pandas as pd
import pytest

from bazaarlens.streaming import ordered


class Value:
    def __init__(self, calls):
        self.calls, self.held = calls, None

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def clear(self):
        self.held = None


class Map(dict):
    def __init__(self, calls):
        super().__init__()
        self.calls = calls

    def getValue(self, key):
        self.calls.append("getValue")
        return self[key]

    def updateValue(self, key, value):
        self.calls.append("updateValue")
        self[key] = value

    def removeKey(self, key):
        self.calls.append("removeKey")
        del self[key]


class Handle:
    """State of one session in memory that keeps a list of the calls to it."""

    def __init__(self):
        self.calls, self.timers = [], []

    def getValueState(self, name, schema):
        return Value(self.calls)

    def getMapState(self, name, key, schema):
        return Map(self.calls)

    def registerTimer(self, at):
        self.timers.append(at)


class Times:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def started():
    fold, handle = ordered.OrderedFold(60_000), Handle()
    fold.init(handle)
    return fold, handle


def rows_of(n, step_ms=90_000, seed=1):
    """A row every minute and a half, so that slots have one row at most."""
    random = np.random.default_rng(seed)
    cap = np.where(random.random(n) < 0.7, np.inf, 1.0)
    return pd.DataFrame({"t": np.arange(n) * step_ms * 1000, "i": np.arange(n), "cap": cap,
                         "a": random.choice([0.95, 1.0], n), "b": random.choice([0.0, 0.3], n)})


def folded(rows):
    value = 0.0
    for row in rows.sort_values(["t", "i"]).itertuples():
        value = min(row.cap, row.a * value + row.b)
    return value


def test_rows_of_many_slots_cost_few_state_calls():
    fold, handle = started()
    rows = rows_of(300)
    out, = fold.handleInputRows(("s",), iter([rows]), None)
    assert (out["steps"][0], round(out["risk"][0], 9)) == (300, round(folded(rows), 9))
    list(fold.handleExpiredTimer(("s",), Times(290 * 90_000), None))
    assert len(handle.calls) <= 10


@pytest.mark.parametrize("size", [1000, 7])
def test_pages_give_the_fold_in_any_order(monkeypatch, size):
    """Long sessions are cut into pages; shuffled chunks and closing between them change nothing."""
    monkeypatch.setattr(ordered, "PAGE", size)
    fold, handle = started()
    rows = rows_of(400, 25_000)
    early, late = rows[:250].sample(frac=1, random_state=3), rows[250:].sample(frac=1, random_state=4)
    for n in range(0, 250, 50):
        out, = fold.handleInputRows(("s",), iter([early[n:n + 50]]), None)
    assert (out["steps"][0], round(out["risk"][0], 9)) == (250, round(folded(early), 9))
    for mark in (0, 3_000_000, 6_200_000):
        list(fold.handleExpiredTimer(("s",), Times(mark), None))
        held = np.concatenate([np.frombuffer(v[0], ordered._ROW) for v in fold.rows.values()])
        assert held["t"].min() == -(-(mark // 60_000 * 60_000) // 25_000) * 25_000_000
        assert max(len(v[0]) // ordered._ROW.itemsize for v in fold.rows.values()) <= size + 3
    out, = fold.handleInputRows(("s",), iter([late[:100], late[100:]]), None)
    assert (out["steps"][0], round(out["risk"][0], 9)) == (400, round(folded(rows), 9))
    list(fold.handleExpiredTimer(("s",), Times(2 * 24 * 3600 * 1000), None))
    assert not fold.rows and fold.session.held is None
