import json
import os
import random

import pytest

from speechlake.sources import runlog as R


@pytest.fixture(scope="module")
def registered(spark):
    spark.dataSource.register(R.Runlog)
    return spark


def test_ranges_of_any_size_give_every_whole_line_once(registered, tmp_path):
    rng = random.Random(3)
    want, odd = [], [b"", b"   ", b"{torn", b"[1, 2]", b"7", b"\xff\xfe", b'"text"']
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        raw = b""
        for i in range(40):
            line = rng.choice(odd) if rng.random() < 0.3 else json.dumps({"t": rng.choice(["run", "score"]), "n": i, "x": "é" * rng.randint(0, 30)}, ensure_ascii=False).encode()
            if line.startswith(b'{"'):
                want.append((name, len(raw), json.loads(line)["t"], line.decode()))
            raw += line + b"\n"
        (tmp_path / name).write_bytes(raw + (b'{"t": "torn' if name == "b.jsonl" else b""))
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / ".hidden.jsonl").write_bytes(b'{"t": "x"}\n')
    (tmp_path / "d.jsonl").write_bytes(b'{"n": 1}\r\n{"t": null}')
    want += [("d.jsonl", 0, None, '{"n": 1}'), ("d.jsonl", 10, None, '{"t": null}')]
    for size in (1, 7, 64, 1 << 20):
        rows = registered.read.format("runlog").option("path", f"file://{tmp_path}").option("rangeBytes", size).load().collect() if size > 1 else None
        if rows is None:
            folder = R.RunlogReader({"path": f"file://{tmp_path}", "rangebytes": "1"})
            rows = [r for p in folder.partitions() for r in folder.read(p)]
        assert sorted((os.path.basename(r[0]), r[1], r[2] or "", r[3]) for r in rows) == sorted((a, b, c or "", d) for a, b, c, d in want)
    assert registered.read.format("runlog").option("path", f"file://{tmp_path}/none").load().collect() == []
    with pytest.raises(ValueError):
        R.Folder("")


def test_a_stream_waits_for_torn_lines_and_reads_nothing_twice(registered, tmp_path):
    spark, log, out = registered, tmp_path / "log", f"file://{tmp_path}/out"
    log.mkdir()

    def run():
        lines = spark.readStream.format("runlog").option("path", f"file://{log}").option("rangeBytes", 16).load().select("t", "line")
        lines.writeStream.format("runlog").option("path", out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(json.loads(r.line)["line"] for r in spark.read.format("runlog").option("path", out).load().collect())

    (log / "a.jsonl").write_bytes(b'{"t": "run"}\n{"t": "sco')
    assert run() == ['{"t": "run"}']
    with open(log / "a.jsonl", "ab") as f:
        f.write(b're", "n": 1}\n\n{"t": "score", "n": 2}\n{"t": "e')
    (log / "b.jsonl").write_bytes(b'{"t": "run", "n": 9}\n')
    assert run() == ['{"t": "run", "n": 9}', '{"t": "run"}', '{"t": "score", "n": 1}', '{"t": "score", "n": 2}']
    with open(log / "a.jsonl", "ab") as f:
        f.write(b'nd"}\n')
    assert len(run()) == 5 and len(run()) == 5


def test_writes_append_replace_and_leave_nothing_behind(registered, tmp_path):
    spark, path = registered, f"file://{tmp_path}/w"
    rows = spark.createDataFrame([(i, "run" if i % 2 else "ünd", None if i % 3 else i) for i in range(50)], "n long, t string, gone long").repartition(5)
    for _ in range(2):
        rows.write.format("runlog").option("path", path).mode("append").save()
    got = [json.loads(r.line) for r in spark.read.format("runlog").option("path", path).load().collect()]
    assert sorted(x["n"] for x in got) == sorted(list(range(50)) * 2) and all(("gone" in x) == (x["n"] % 3 == 0) for x in got)
    rows.limit(3).write.format("runlog").option("path", path).mode("overwrite").save()
    assert spark.read.format("runlog").option("path", path).load().count() == 3
    assert [f for f in os.listdir(tmp_path / "w") if f.startswith(".")] == []
    folder = R.Folder(path)
    for _ in range(2):  # a batch that is run again
        w = R.RunlogStreamWriter({"path": path})
        w.commit([w.write(iter(rows.limit(4).collect()))], 7)
    assert spark.read.format("runlog").option("path", path).load().count() == 7
    w = R.RunlogWriter({"path": path}, False)
    w.abort([w.write(iter(rows.limit(4).collect()))])
    assert len(folder.files()) >= 2 and [f for f in os.listdir(tmp_path / "w") if f.startswith(".")] == []
