"""State in streams: counters, sessions, and the table that batches commit to."""

import datetime as dt
import random

import pytest

from tracewell.sources.shared import new_path
from tracewell.sources.sink import BatchTable
from tracewell.streaming import stateful


def test_a_batch_counts_once(spark):
    table = BatchTable(spark, new_path(spark, "sink"), "k int, v int")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v int")
    assert table.read().count() == 0
    assert table.write(rows((1, 1), (2, 2)), 0)

    def killed():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        table.write(rows((9, 9)), 1, killed)
    assert table.committed() == [0] and table.read().count() == 2
    assert table.write(rows((3, 3)), 1)
    assert not table.write(rows((3, 3), (4, 4)), 1)
    assert sorted((r.k, r.v, r.batch) for r in table.read().collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 1)]


def test_a_late_start_drops_what_it_follows_and_idle_calls_go(spark):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    batches = [
        [("s", "r", 1, at(0), "text", 5), ("s", "r", 3, at(1), "text", 7), ("s", "q", 2, at(1), "reasoning", 4)],
        [("s", "r", 2, at(0), "start", None), ("s", "r", 3, at(1), "text", 7)],  # the start comes late, a delta twice
        [("t", "x", 90, at(500), "text", 1)],  # time goes on
        [("t", "x", 91, at(500), "text", 1)],  # the watermark has passed the others' timers: their state goes
        [("s", "r", 95, at(501), "text", 2)],
        [("u", "y", 96, at(502), "start", None)],
    ]
    rows = [(n, *r) for n, b in enumerate(batches) for r in b]
    stream = stateful.replay(spark.createDataFrame(rows, "turn int, session_id string, request_id string, event_id long, ts timestamp, kind string, chars long"), "few", len(batches), "turn")
    table = BatchTable(spark, new_path(spark, "counters"), stateful.COUNTERS)
    stateful.run_to(table, stateful.counted_stream(stream, "5 minutes", 600_000), "counters", "update")
    steps = sorted((r.batch, r.session_id, r.request_id, r.chunk_count, r.reasoning_chars, r.text_chars) for r in table.read().collect())
    numbers = sorted({s[0] for s in steps})
    at_step = lambda i: [s[1:] for s in steps if s[0] == numbers[i]]
    assert at_step(0) == [("s", "q", 1, 4, 0), ("s", "r", 2, 0, 12)]
    assert at_step(1) == [("s", "r", 1, 0, 7)]
    assert ("s", "r", 1, 0, 2) in [s[1:] for s in steps]  # forgotten and begun anew
    assert ("u", "y", 0, 0, 0) in [s[1:] for s in steps]


def test_sessions_are_bounded_by_age_and_number():
    draw = random.Random(4)
    ttl, most = 50, 3
    held, log, at, misses = stateful.Sessions(ttl, most), [], 0, 0
    for n in range(600):
        at += draw.choice([1, 5, 30])
        name = draw.choice("abcdefgh")
        before = [i for i, (s, _) in enumerate(log) if s == name]
        fresh = not before or at - log[before[-1]][1] > ttl or len({s for s, _ in log[before[-1] + 1 :]}) >= most
        got = held.use(name, at, n)
        assert ((name, "new") in got) == fresh and len(held.held) <= most
        log.append((name, at))
        misses += fresh
        if draw.random() < 0.1:
            held.sweep(at)
            assert all(at - t <= ttl for t, _ in held.held.values())
    assert 50 < misses < 550
    assert sorted(held.sweep(at + 1000)) and not held.held
