import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from speechlake.plans import streams
from speechlake.streaming import events as S

SCHEMA = "seq long, run_id long, kind string, created_at timestamp, data string"


def _stream(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def _at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_coalesced_keeps_the_latest_of_a_window(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = [(1, 1, "progress", _at(0.1), "a"), (2, 1, "progress", _at(0.2), "b"), (3, 1, "progress", _at(0.7), "c"), (4, 1, "log", _at(0.3), "d"), (5, 1, "done", _at(0.35), "e")]
    stream = _stream(spark, path, [rows, [(9, 2, "progress", _at(5000), "z")], [(10, 2, "progress", _at(9000), "z")]])
    held, passed = S.coalesced(stream, ["progress", "log"], "1 second")
    S.run_to_end(held, f"{path}/held", f"{path}/s1")
    S.run_to_end(passed, f"{path}/passed", f"{path}/s2")
    got = {r.seq for r in spark.read.parquet(f"{path}/held").where("run_id = 1").collect()}
    assert got == {2, 3, 4} and [r.seq for r in spark.read.parquet(f"{path}/passed").collect()] == [5]


def test_repeats_go(spark, tmp_path):
    path = f"file://{tmp_path}"
    stream = _stream(spark, path, [[(1, 1, "a", _at(0), "x"), (1, 1, "a", _at(0), "x")], [(1, 1, "a", _at(1), "x"), (2, 1, "a", _at(2), "y")]])
    S.run_to_end(S.once(stream), f"{path}/out", f"{path}/s")
    assert sorted(r.seq for r in spark.read.parquet(f"{path}/out").collect()) == [1, 2]


def test_silent_runs_are_told_once_the_watermark_passes(spark, tmp_path):
    path = f"file://{tmp_path}"
    stream = _stream(spark, path, [[(1, 1, "beat", _at(0), ""), (2, 2, "beat", _at(0), "")], [(3, 2, "beat", _at(80), "")], [(4, 3, "beat", _at(120), "")], [(5, 3, "beat", _at(130), "")]])
    S.run_to_end(S.stale(stream), f"{path}/out", f"{path}/s")
    got = {(r.run_id, r.last_ms) for r in spark.read.parquet(f"{path}/out").collect()}
    assert (1, int(_at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)) in got and all(i == 1 for i, _ in got)


def test_cancelled_work_is_dropped(spark, tmp_path):
    path = f"file://{tmp_path}"
    stream = _stream(spark, path, [[(1, 1, "cancel", _at(10), "")], [(2, 1, "work", _at(5), ""), (3, 1, "work", _at(20), ""), (4, 2, "work", _at(20), "")], [(5, 9, "work", _at(90_000), ""), (6, 9, "cancel", _at(90_000), "")], [(7, 9, "work", _at(190_000), ""), (8, 9, "cancel", _at(190_000), "")]])
    kept = S.drop_cancelled(stream.where("kind = 'work'"), stream.where("kind = 'cancel'"))
    S.run_to_end(kept, f"{path}/out", f"{path}/s")
    assert {r.seq for r in spark.read.parquet(f"{path}/out").collect() if r.run_id < 9} == {2, 4}


def test_progress_tells_changes_only(spark):
    steps = spark.createDataFrame([(1, "a", 1, 10, "done", False, 0, 0.0), (1, "a", 2, 10, "pending", False, 0, 0.0), (2, "a", 1, 10, "running", False, 0, 0.4)], "run_id long, kind string, shard int, weight int, state string, optional boolean, attempt int, progress double")
    told = spark.createDataFrame([(1, 0.5), (2, 0.1)], "run_id long, progress double")
    assert [(r.run_id, r.progress) for r in S.progress_of(steps, told).collect()] == [(2, 0.4)]
    assert S.running_rates(spark.createDataFrame([("en", 1, 10), ("en", 2, 10)], "lang string, edits int, ref_len int")).select(F.sum("edits")).first()[0] == 3


def test_a_table_is_fed_whole_and_in_order(spark):
    rows = [(i, None if i % 50 == 0 else i * 7 % 1000) for i in range(1000)]
    seen = []

    def run(stream):
        name = f"fed{len(seen)}"
        at = f"{streams._shared(spark)}/{name}"
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/s").trigger(availableNow=True).start().awaitTermination()
        seen.append({tuple(r) for r in spark.read.parquet(f"{at}/out").collect()})

    streams._feed(run, "at", spark.createDataFrame(rows, "id long, at long").repartition(5))
    new = [b - a for a, b in zip([set(), *seen], seen)]
    assert len(new) == streams.PARTS and all(new) and set(rows) == seen[-1]
    last = -1
    for part in new:
        at = [a for _, a in part if a is not None]
        assert min(at) > last
        last = max(at)


@pytest.mark.parametrize("part", ["600", "400"])
@pytest.mark.parametrize("name", ["stream_cancelled_items", "stream_stale"])
def test_a_stream_ends_at_the_millisecond_nearest_to_its_last_event(spark, tmp_path, name, part):
    last = f"06:00:00.000{part}"
    rows = [(1, "00:00:00", 1, "view"), (7, last, 1, "error"), (14, "00:00:01", 2, "error"), (15, last, 2, "click"), (16, "00:00:00", 3, "view"), (21, "00:00:02", None, "error"), (22, "00:00:03", None, "view")]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, 0, '')", [(i, f"2024-01-01 {at}", user, kind) for i, at, user, kind in rows])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = streams.QUERIES[name](spark, f"file://{tmp_path}")
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({streams.ORACLE_SQL[name]})").fetchall())
