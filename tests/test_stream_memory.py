"""What a key's timer hands on comes in small parts, however much has arrived."""

import numpy as np
import pandas as pd

from fieldlark.config import ServerConfig
from fieldlark.streaming import room


class Held:
    """State of one key, as the store gives it."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getValue(self, k):
        self.calls += 1
        return self.values.get(k)

    def updateValue(self, k, v):
        self.calls += 1
        self.values[k] = v

    def removeKey(self, k):
        del self.values[k]

    def keys(self):
        return iter(list(self.values))

    def get(self):
        return self.values.get(())

    def update(self, v):
        self.values[()] = v

    def put(self, v):
        self.values[()] = v

    def exists(self):
        return () in self.values

    def clear(self):
        self.values.clear()


class Handle:
    def __init__(self):
        self.held, self.timers = {}, []

    def _state(self, name, *schema):
        return self.held.setdefault(name, Held())

    getMapState = getValueState = getListState = _state

    def registerTimer(self, ms):
        self.timers.append(ms)


class Passed:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_output_and_calls_do_not_grow_with_an_arrival():
    p, h = room.RoomProcessor({"a": np.linspace(0, 1, 1600)}, ServerConfig()), Handle()
    p.init(h)
    rows = [("r", "a", (t + 1) * 0.05, 0.5, 0.9, 0.8) for t in range(1000)]
    arrived = pd.DataFrame(rows, columns=["room", "link_id", "ts", "activity", "health_score", "confidence"])
    list(p.handleInputRows(("r",), iter([arrived]), Passed(0)))
    assert h.held["waiting"].calls < 400  # not two for every tick
    got = list(p.handleExpiredTimer(("r",), Passed(room._ms(40.02)), None))
    assert sum(map(len, got)) == 800 and max(map(len, got)) <= room.PART and h.timers[-1] == room._ms(801 * 0.05)
    got += list(p.handleExpiredTimer(("r",), Passed(room._ms(1000.0)), None))
    assert [t for g in got for t in g.ts] == [r[2] for r in rows] and not h.held["waiting"].values
