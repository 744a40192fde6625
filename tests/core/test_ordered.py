import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from speechlake.operators import operations as O
from speechlake.streaming import append, ordered
from speechlake.streaming import events as S

STEPS = "run_id long, step long, created_at timestamp, seq long, kind string, attempt int, max_attempts int, optional boolean"
ITEMS = "run_id long, created_at timestamp, seq long, kind string, item string"


def _at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def _stream(spark, path, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def _beats(step, times, attempt=0, most=2, optional=False, run=1):
    return [(run, step, _at(abs(t)), 1000 * step + i, "end" if t < 0 else "beat", attempt, most, optional) for i, t in enumerate(times)]


def test_attempts_run_out_as_stated(spark, tmp_path):
    rows = _beats(1, [1, 60, 151.001], most=3) + _beats(2, [1, 100, 200], most=2) + _beats(3, [1, 100], most=1, optional=True) + _beats(4, [1, 50, -60, 500]) + _beats(5, [1, 91, 181], most=9)
    rows += _beats(6, [1, 100, -300, 310, -320], most=9) + _beats(7, [1000 - 90.001], most=5) + _beats(8, [1000 - 90], most=5) + [(2, 1, _at(1000), 1, "beat", 0, 9, False)]
    want = {
        (1, 1001, 1, "pending"), (1, 1002, 2, "pending"),  # 60 to 151.001 is over 90 seconds, then silence; attempts are left
        (2, 2000, 1, "pending"), (2, 2001, 2, "dead"),  # what comes after is not told
        (3, 3000, 1, "skipped"),
        (5, 5002, 1, "pending"),  # 90 seconds are no loss
        (6, 6000, 1, "pending"), (6, 6001, 2, "pending"),  # an end without a lease does not end the step; the second does
        (7, 7000, 1, "pending"),
    }
    path = f"file://{tmp_path}"
    for n, cut in enumerate(([rows], [sorted(rows, key=lambda r: r[2])[i : i + 4] for i in range(0, len(rows), 4)])):
        stream = _stream(spark, f"{path}/{n}", STEPS, cut)
        S.run_to_end(ordered.stale_steps(stream, ["run_id", "step"], ["end"]), f"{path}/{n}/out", f"{path}/{n}/s")
        assert {tuple(r)[1:] for r in spark.read.parquet(f"{path}/{n}/out").where("run_id = 1").collect()} == want
    twin = O.stale_steps(spark.createDataFrame(rows, STEPS), ["run_id", "step"], ["end"])
    assert {tuple(r)[1:] for r in twin.where("run_id = 1").collect()} == want


@pytest.mark.parametrize("size", [400, 60])
def test_batches_and_disorder_change_nothing(spark, tmp_path, size):
    rng, path = random.Random(size), f"file://{tmp_path}"
    rows = []
    for run in range(12):
        t = 0.0
        for i in range(30):
            t += rng.choice([5, 50, 89.999, 90, 90.001, 200])
            rows.append((run, i % 2, _at(t), 100 * run + i, rng.choice(["beat", "beat", "beat", "end"]), run % 2, 1 + run % 4, run % 3 == 0))
    rows.sort(key=lambda r: r[2] + dt.timedelta(seconds=rng.random() * 20))
    rows += rows[-3:]  # told again
    stream = _stream(spark, path, STEPS, [rows[i : i + size] for i in range(0, len(rows), size)])
    S.run_to_end(ordered.stale_steps(stream, ["run_id", "step"], ["end"], "30 seconds"), f"{path}/out", f"{path}/s")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").collect())
    df = spark.createDataFrame(rows, STEPS)
    until = int(max(r[2] for r in rows).replace(tzinfo=dt.timezone.utc).timestamp() * 1000) - 30_000
    assert got == sorted(tuple(r) for r in O.stale_steps(df, ["run_id", "step"], ["end"], F.lit(until)).collect()) and len(got) > 20


def test_a_cancel_counts_for_good(spark, tmp_path):
    day, path = 86_400, f"file://{tmp_path}"
    rows = [(1, _at(0), 1, "queue", "a"), (1, _at(1), 2, "queue", "b"), (1, _at(2), 3, "start", "b"), (1, _at(3), 4, "queue", "c"), (1, _at(4), 5, "start", "c"), (1, _at(5), 6, "queue", "c"), (1, _at(6), 7, "queue", "a"), (1, _at(10), 8, "cancel", None),
            (1, _at(11), 9, "start", "a"), (1, _at(3 * day), 10, "queue", "d"), (1, _at(4 * day), 11, "queue", "d"), (1, _at(4 * day), 12, "cancel", None), (2, _at(5), 13, "queue", "a"), (2, _at(9 * day), 14, "cancel", None), (1, _at(8 * day), 15, "queue", "b"), (3, _at(9 * day), 16, "queue", None)]
    want = {(1, "a", 1, 8), (1, "c", 6, 8), (1, "d", 10, 8), (1, "b", 15, 8), (2, "a", 13, 14)}
    assert {tuple(r) for r in O.cancelled_items(spark.createDataFrame(rows, ITEMS), ["run_id"], ["queue"], ["start"], ["cancel"]).collect()} == want
    stream = _stream(spark, path, ITEMS, [rows[i : i + 5] for i in range(0, len(rows), 5)])
    S.run_to_end(ordered.cancelled_items(stream, ["run_id"], ["queue"], ["start"], ["cancel"], "10 days"), f"{path}/early", f"{path}/s1")
    assert spark.read.schema("run_id long").parquet(f"{path}/early").count() == 0  # nothing is final yet
    later = _stream(spark, path, ITEMS, [[(9, _at(30 * day), 99, "other", None)]])
    S.run_to_end(ordered.cancelled_items(later, ["run_id"], ["queue"], ["start"], ["cancel"], "10 days"), f"{path}/out", f"{path}/s2")
    assert {tuple(r) for r in spark.read.parquet(f"{path}/out").collect()} == want


def test_numbers_have_no_gap_or_repeat_wherever_a_run_stops(spark, tmp_path):
    path, schema = f"file://{tmp_path}", "created_at timestamp, event long"
    batches = [[(_at(10 * b + i % 3), 100 * b + i) for i in range(7)] for b in range(3)]
    _stream(spark, path, schema, batches)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stops = iter([False, True, True, False, False])

    def stop():
        if next(stops):
            raise RuntimeError("stopped between rows and range")

    for _ in range(2):
        with pytest.raises(Exception, match="stopped between"):
            append.append_stream(stream(), f"{path}/log", f"{path}/s", ["created_at", "event"], stop)
        assert sorted(r.seq for r in append.read_log(spark, f"{path}/log").collect()) == list(range(7))
    append.append_stream(stream(), f"{path}/log", f"{path}/s", ["created_at", "event"], stop)
    log = sorted((r.seq, r.event) for r in append.read_log(spark, f"{path}/log").collect())
    assert [s for s, _ in log] == list(range(21)) and sorted(e for _, e in log) == sorted(e for b in batches for _, e in b)
    append.append_batch(spark.createDataFrame(batches[1], schema), 1, f"{path}/log", ["created_at", "event"])  # told again
    append.append_batch(spark.createDataFrame([], schema), 3, f"{path}/log", ["created_at", "event"])  # nothing new
    append.append_batch(spark.createDataFrame([(_at(1), 7)], schema), 4, f"{path}/log", ["created_at", "event"])
    assert sorted(r.seq for r in append.read_log(spark, f"{path}/log").collect()) == list(range(22))


class _Value:
    calls = 0

    def __init__(self):
        self.row = None

    def exists(self):
        _Value.calls += 1
        return self.row is not None

    def get(self):
        _Value.calls += 1
        return self.row

    def update(self, row):
        _Value.calls += 1
        self.row = row

    def clear(self):
        self.update(None)


class _Handle:
    getValueState = staticmethod(lambda name, schema: _Value())
    registerTimer = deleteTimer = staticmethod(lambda ms: None)


def test_state_is_called_once_a_batch_and_not_for_each_key():
    calls = []
    for n in (1, 500):
        steps, _Value.calls = ordered.StaleSteps(["run_id"], ["run_id", "seq", "attempt", "outcome"], ["end"], 90), 0
        steps.init(_Handle())
        frame = pd.DataFrame({"none": 0, "run_id": range(n), "at": 1_000_000, "seq": range(n), "kind": "beat", "item": None, "attempt": 0, "max_attempts": 2, "optional": False})
        assert not list(steps._advance([frame], 0))
        (lost,) = steps._advance([], 200_000)
        assert lost.values.tolist() == [[i, i, 1, "pending"] for i in range(n)]
        calls.append(_Value.calls)
    assert calls[0] == calls[1] < 20


def test_null_keys_are_a_key_and_long_ones_stay_exact(spark, tmp_path):
    big = (1 << 60) + 1
    rows = [(run, _at(t), t, kind, "a") for run in (None, big, 0) for t, kind in ((0, "queue"), (5, "cancel"))]
    stream = _stream(spark, f"file://{tmp_path}", ITEMS, [rows])
    S.run_to_end(ordered.cancelled_items(stream, ["run_id"], ["queue"], ["start"], ["cancel"]), f"file://{tmp_path}/out", f"file://{tmp_path}/s")
    assert {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {(run, "a", 0, 5) for run in (None, big, 0)}
