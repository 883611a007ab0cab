"""Many calls are one state of a stream, and uses are held in few bytes."""

import json

import pandas as pd

from tracewell.streaming import stateful


class Value:
    def __init__(self):
        self.value, self.updates = None, 0

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value, self.updates = value, self.updates + 1

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.state, self.timers = Value(), set()

    def getValueState(self, name, schema):
        return self.state

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def listTimers(self):
        return iter(self.timers)


class Now:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


def test_calls_of_a_bucket_are_one_state():
    at = lambda s: pd.Timestamp(2024, 1, 1) + pd.Timedelta(seconds=s)
    ms = lambda s: int(at(s).value // 1_000_000)
    frame = lambda rows: iter([pd.DataFrame(rows, columns=["session_id", "request_id", "event_id", "ts", "kind", "chars"])])
    handle, counters = Handle(), stateful.CallCounters(10_000)
    counters.init(handle)
    (first,) = counters.handleInputRows((7,), frame([(f"s{i}", "r", i, at(i), "text", i) for i in range(100)]), Now(0))
    assert len(first) == 100 and handle.state.updates == 1 and handle.timers == {ms(10)}
    (second,) = counters.handleInputRows((7,), frame([("s1", "r", 200, at(1), "reasoning", 5), ("s2", "r", 201, at(90), "start", None)]), Now(0))
    assert sorted(map(tuple, second.itertuples(index=False))) == [("s1", "r", 2, 2, 5, 1), ("s2", "r", 2, 0, 0, 0)]
    handle.timers.clear()
    assert list(counters.handleExpiredTimer((7,), Now(ms(60)), Now(ms(10)))) == []
    assert {c[0] for c in json.loads(handle.state.value[0])[1]} == {f"s{i}" for i in (2, *range(51, 100))} and handle.timers == {ms(61)}
    assert list(counters.handleExpiredTimer((7,), Now(ms(500)), Now(ms(61)))) == [] and not handle.state.exists()


def test_uses_are_taken_in_slices(monkeypatch):
    at = lambda s: pd.Timestamp(2024, 1, 1) + pd.Timedelta(seconds=s)
    monkeypatch.setattr(stateful, "USES", 10, raising=False)
    uses = [(f"s{i * 7 % 11}", i, at(i // 3)) for i in range(200)]
    frames = [pd.DataFrame(uses[i::4], columns=["session_id", "event_id", "ts"]) for i in range(4)]
    handle, cache = Handle(), stateful.SessionCache(20_000_000, 3, 1000)
    cache.init(handle)
    got = list(cache.handleInputRows((2,), iter(frames), Now(0)))
    held, want = stateful.Sessions(20_000_000, 3), []
    for session, number, ts in uses:
        want += [(2, other, number, ts, what) for other, what in held.use(session, int(ts.value // 1000), number)]
    assert len(got) == 20 and [tuple(r) for f in got for r in f.itertuples(index=False)] == want
    assert json.loads(handle.state.value[0]) == held.held
