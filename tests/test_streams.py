"""Streams in several micro-batches, with rows out of order and too late ones."""

import os
from datetime import datetime, timedelta

import pytest

from lodestone.streaming import running, windows

START = datetime(2024, 1, 1)


def landed(spark, tmp_path, batches):
    """One file a micro-batch, in this order."""
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "session bigint, case bigint, state string, expected string, ts timestamp"
    for k, rows in enumerate(batches):
        at = tmp_path / f"b{k}"
        spark.createDataFrame([(s, c, "O", e, START + timedelta(minutes=m)) for s, c, e, m in rows], schema).coalesce(1).write.parquet(str(at))
        (file,) = at.glob("part-*")
        target = folder / f"{k}.parquet"
        file.rename(target)
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    return windows.read_events(spark, str(folder), schema, per_trigger=1)


def test_running_index(spark, tmp_path):
    batches = [
        [(1, 10, "O", 5), (1, 11, "C", 2), (2, 20, "C", 3)],
        [(1, 12, "C", 8), (1, 13, None, 4)],  # 13 came out of order, within ten minutes
        [(1, 14, "O", 60), (2, 21, "O", 61)],
        [(1, 15, "C", 20), (1, 16, "C", 62)],  # 15 is later than the watermark (51)
        [(3, 30, "O", 300)],
    ]
    out = running.to_table(running.running_index(landed(spark, tmp_path, batches)), str(tmp_path / "out"), str(tmp_path / "state"), with_state=True)
    got = sorted((r.session, r.ts, r.case, r.part, r.n, r.defects, r.bond_index) for r in out.collect())
    want = [(1, 11, 2, 0, 1, 1), (1, 13, 4, 0, 2, 1), (1, 10, 5, 0, 3, 1), (1, 12, 8, 0, 4, 2), (1, 14, 60, 1, 1, 0), (1, 16, 62, 1, 2, 1), (2, 20, 3, 0, 1, 1), (2, 21, 61, 1, 1, 0)]
    assert [(s, c, p, n, d) for s, _, c, p, n, d, _ in got] == [(s, c, p, n, d) for s, c, _, p, n, d in want]
    assert [x[-1] for x in got] == pytest.approx([d / n for *_, n, d in want])


def test_running_index_in_one_batch(spark, tmp_path):
    """The same verdicts in one micro-batch: none is late, and the order is that of event time."""
    rows = [(1, 14, "O", 60), (1, 10, "O", 5), (1, 15, "C", 20), (1, 11, "C", 2), (9, 1, "O", 500)]
    out = running.to_table(running.running_index(landed(spark, tmp_path, [rows])), str(tmp_path / "out"), str(tmp_path / "state"), with_state=True)
    assert [(r.case, r.part, r.n, r.defects) for r in sorted(out.collect(), key=lambda r: r.ts)] == [(11, 0, 1, 1), (10, 0, 2, 1), (15, 0, 3, 2), (14, 1, 1, 0)]


def test_calls_of_the_state_go_with_the_sessions():
    """However many verdicts a session has, its state is asked the same number of times; and the rows are those of one verdict after the other."""
    import numpy as np
    import pandas as pd

    class Times:
        mark = 0

        def getCurrentWatermarkInMs(self):
            return self.mark

    class State:
        def __init__(self):
            self.calls, self.value, self.items, self.timers = 0, None, [], set()

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                return {
                    "get": lambda: self.value, "update": lambda x: setattr(self, "value", x), "registerTimer": self.timers.add, "deleteTimer": self.timers.discard,
                    "appendValue": self.items.append, "put": lambda x: self.items.__setitem__(slice(None), x), "clear": self.items.clear,
                }[name](*args)

            return call

    class Items(State):
        def get(self):
            self.calls += 1
            return iter(list(self.items))

    def run(batches):
        p, at = running.RunningIndex(50), Times()
        p.handle, p.waiting, p.totals = State(), Items(), State()
        found = []
        for mark, rows in [*batches, (10_000_000, [])]:
            if rows:
                frame = pd.DataFrame(rows, columns=["ts", "case", "defect"])
                list(p.handleInputRows((7,), iter([frame.assign(ts=pd.to_datetime(frame["ts"], unit="ms"))]), at))
            at.mark = mark
            while due := sorted(t for t in p.handle.timers if t <= mark):
                for out in p.handleExpiredTimer((7,), at, None):
                    found += [(int(t.timestamp() * 1000 + 0.5), c, k, n, d) for t, c, k, n, d in zip(out["ts"], out["case"], out["part"], out["n"], out["defects"], strict=True)]
                p.handle.timers.discard(due[0])
        return found, p.handle.calls + p.waiting.calls + p.totals.calls

    rng = np.random.default_rng(1)
    calls = set()
    for size in (1, 10, 400):
        batches = []
        for k in range(5):
            times = rng.integers(k * 1000 + 1, k * 1000 + 900, size)
            batches.append((k * 1000 + 950, [(int(t), int(c), int(d)) for t, c, d in zip(times, rng.integers(0, 9, size), rng.integers(0, 2, size), strict=True)]))
        want, part, n, defects, last = [], -1, 0, 0, -1000
        for t, c, d in sorted(r for _, rows in batches for r in rows):
            if t - last > 50:
                part, n, defects = part + 1, 0, 0
            n, defects, last = n + 1, defects + d, t
            want.append((t, c, part, n, defects))
        found, asked = run(batches)
        assert found == want
        calls.add(asked)
    assert len(calls) == 1 or max(calls) - min(calls) <= 5


def test_sessions_leave_late_rows_out(spark, tmp_path):
    batches = [
        [(1, 10, "O", 0), (1, 11, "C", 20), (2, 20, "C", 10)],
        [(1, 12, "C", 100)],
        [(4, 40, "O", 101)],  # rows are held against the watermark of the batch before
        [(1, 13, "C", 30), (2, 21, "O", 95)],  # 13 would have joined the first session, but the watermark (90) has closed it
        [(3, 30, "O", 400)],
    ]
    out = running.to_table(windows.session_index(landed(spark, tmp_path, batches)), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.session, int((r.start - START).total_seconds() // 60), int((r.end - START).total_seconds() // 60), r.n, r.defects) for r in out.collect())
    assert got == [(1, 0, 50, 2, 1), (1, 100, 130, 1, 1), (2, 10, 40, 1, 1), (2, 95, 125, 1, 0), (4, 101, 131, 1, 0)]


def test_store_setting_is_put_back(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    running.to_table(running.running_index(landed(spark, tmp_path, [[(1, 1, "O", 0)]])), str(tmp_path / "out"), str(tmp_path / "state"), with_state=True)
    assert spark.conf.get(key, None) == before
