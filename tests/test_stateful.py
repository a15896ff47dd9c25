"""The waiting rows of a stateful fold: order, and how much state a batch touches."""

import pandas as pd
from pyspark.sql import types as T

from kinetable.operators.fold import Fold
from kinetable.streaming.stateful import FoldProcessor


class Listing(Fold):
    columns = ("v",)
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("n", T.LongType())])

    def start(self):
        return 0

    def step(self, state, row):
        return state + 1, [(row[0], state + 1)]

    def finish(self, state):
        return [(-1, state)]


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Map:
    def __init__(self):
        self.held, self.reads, self.writes = {}, 0, 0

    def getValue(self, k):
        self.reads += 1
        return self.held[k]

    def updateValue(self, k, v):
        self.writes += 1
        self.held[k] = v

    def removeKey(self, k):
        del self.held[k]


class Handle:
    def __init__(self):
        self.map, self.timers = Map(), set()

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return self.map

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def rows(times):
    return iter([pd.DataFrame({"event_ts": pd.to_datetime(times, unit="ms"), "v": times})])


def drained(frames):
    return [tuple(r) for f in frames for r in f.itertuples(index=False)]


def made(slot_ms=1000):
    handle, p = Handle(), FoldProcessor(Listing(), ["sid"], "v", 50_000, slot_ms)
    p.init(handle)
    return handle, p


def test_rows_come_out_in_order_once_the_watermark_has_passed():
    handle, p = made()
    assert drained(p.handleInputRows(("s",), rows([5000, 1500, 9000, 1200]), Clock(0))) == []
    assert handle.timers == {1200}
    assert drained(p.handleInputRows(("s",), rows([4000, 1300]), Clock(1250))) == [("s", 1200, 1)]
    assert handle.timers == {1300}
    handle.timers.discard(1300)
    assert drained(p.handleExpiredTimer(("s",), Clock(5000), None)) == [("s", 1300, 2), ("s", 1500, 3), ("s", 4000, 4), ("s", 5000, 5)]
    handle.timers.discard(9000)
    assert drained(p.handleExpiredTimer(("s",), Clock(9000), None)) == [("s", 9000, 6)]
    assert handle.timers == {59_000} and not handle.map.held
    handle.timers.clear()
    assert drained(p.handleExpiredTimer(("s",), Clock(59_000), None)) == [("s", -1, 6)]
    assert not p.state.exists() and not p.index.exists()


def test_a_batch_touches_its_own_and_the_ready_rows_only():
    handle, p = made()
    list(p.handleInputRows(("s",), rows(list(range(10_000, 400_000, 50))), Clock(0)))
    waiting = len(handle.map.held)
    assert waiting == 390
    handle.map.reads = handle.map.writes = 0
    assert drained(p.handleInputRows(("s",), rows([399_000, 399_001]), Clock(5_000))) == []
    assert (handle.map.reads, handle.map.writes) == (0, 1)
    handle.map.reads = handle.map.writes = 0
    assert len(drained(p.handleInputRows(("s",), rows([200_000]), Clock(12_020)))) == 41
    assert (handle.map.reads, handle.map.writes) == (3, 2)  # three slots reached; the last is cut


def test_rows_far_ahead_of_the_watermark_cost_few_chunks():
    """Before the first watermark is known all rows are years ahead of it; they need no slot of an hour each."""
    handle, p = made()
    year = 31_536_000_000
    times = list(range(50 * year, 50 * year + 400_000, 700))
    assert drained(p.handleInputRows(("s",), rows(times), Clock(0))) == []
    assert handle.map.writes <= 2
    got = []
    for watermark in (50 * year + 100, 50 * year + 90_000, 50 * year + 390_000, 51 * year):
        handle.timers.clear()
        got += drained(p.handleExpiredTimer(("s",), Clock(watermark), None))
        assert [r[1] for r in got] == [t for t in times if t <= watermark]
    assert [r[2] for r in got] == list(range(1, len(times) + 1)) and not handle.map.held


def test_a_batch_of_one_slot_is_cut_into_chunks():
    handle, p = made(10**9)
    times = list(range(1, 10_001))
    assert drained(p.handleInputRows(("s",), rows(times), Clock(0))) == []
    assert handle.map.writes == 3
    handle.timers.clear()
    assert [r[1] for r in drained(p.handleExpiredTimer(("s",), Clock(10_000), None))] == times
