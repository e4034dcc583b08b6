"""Calls of the state store go by bucket and batch, not by key or row."""

import pandas as pd

from kgspark.streaming import groups as G


class _Store:
    def __init__(self):
        self.kept, self.calls = [], 0

    def __getattr__(self, name):
        def call(*values):
            self.calls += 1
            if name == "appendValue":
                self.kept.append(values[0])
            elif name in ("put", "update"):
                self.kept = list(values[0]) if name == "put" else [values[0]]
            elif name == "clear":
                self.kept = []

        return call

    def get(self):
        self.calls += 1
        return iter(list(self.kept)) if self.many else (self.kept[0] if self.kept else None)


class _Handle:
    def __init__(self):
        self.stores, self.timers, self.now = [], [], 0

    def getListState(self, *_):
        return self._store(True)

    def getValueState(self, *_):
        return self._store(False)

    def _store(self, many):
        store = _Store()
        store.many = many
        self.stores.append(store)
        return store

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_calls_do_not_grow_with_keys_and_rows():
    handle, g = _Handle(), G._Groups(10, anchored=False)
    g.init(handle)
    rows = pd.DataFrame({"group_key": [k for k in range(500) for _ in range(3)], "seconds": [0.0, 5.0, 30.0] * 500, "place": range(1500), "same": [None] * 1500})
    assert list(g.handleInputRows((1,), iter([rows]), handle)) == [] and handle.timers == [30_000]
    handle.now = 7_000
    first = pd.concat(g.handleExpiredTimer((1,), handle, None))
    assert len(first) == 1000 and set(first["group_start"]) == {0.0} and handle.timers == [30_000, 15_000]
    handle.now = 60_000
    second = pd.concat(g.handleExpiredTimer((1,), handle, None))
    assert second["place"].tolist() == list(range(2, 1500, 3)) and set(second["group_start"]) == {30.0}
    assert not any(s.kept for s in handle.stores) and sum(s.calls for s in handle.stores) < 12
