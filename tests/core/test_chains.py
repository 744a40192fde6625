import json
import random

import pytest
from pyspark.sql import functions as F

from speechlake.functions import text as T
from speechlake.operators import shuffling, speakers

U32 = 0xFFFFFFFF


def draws(seed):
    state = seed & U32
    while True:
        state = (state + 0x6D2B79F5) & U32
        t = ((state ^ (state >> 15)) * (state | 1)) & U32
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & U32)) & U32
        yield ((t ^ (t >> 14)) & U32) / 4294967296


def walked(keys, n, seed):
    rows, draw = sorted(set(keys)), draws(seed)
    for i in range(len(rows) - 1, 0, -1):
        j = int(next(draw) * (i + 1))
        rows[i], rows[j] = rows[j], rows[i]
    return rows[:n]


@pytest.mark.parametrize("n, seed", [(7, 1), (10_000, 99)])
def test_the_shuffle_equals_a_walk(spark, n, seed):
    rng = random.Random(seed)
    rows = [(g, rng.randrange(10**6)) for g, size in (("a", 700), ("b", 1), (None, 40), ("c", 2), ("d", 3)) for _ in range(size)]
    rows += rows[:30]
    got = {}
    for r in shuffling.seeded_shuffle(spark.createDataFrame(rows, "g string, k long"), ["g"], "k", n, seed).collect():
        got.setdefault(r.g, {})[r["rank"]] = r.k
    for g in {g for g, _ in rows}:
        want = walked([k for h, k in rows if h == g], n, seed)
        assert [got[g][i + 1] for i in range(len(want))] == want and len(got[g]) == len(want)
    df = spark.createDataFrame(rows, "g string, k long")
    assert shuffling.seeded_shuffle(df.limit(0), ["g"], "k", n).collect() == []
    assert [r.k for r in shuffling.seeded_shuffle(df, [], "k", 5, seed).orderBy("rank").collect()] == walked([k for _, k in rows], 5, seed)


def test_merges_follow_chains_in_the_order_of_the_log(spark):
    keys = "ABCDE"
    rng = random.Random(4)
    log = [(1, 1, "A", "B"), (1, 2, "B", "C"), (2, 1, "B", "C"), (2, 2, "A", "B"), (3, 5, "A", "B"), (3, 6, "B", "A"), (3, 7, "A", "C")]
    for run in range(4, 14):
        log += [(run, at, *rng.sample(keys, 2)) for at in range(rng.randint(0, 12))]
    turns = [(run, rng.choice(keys), i) for run in range(1, 16) for i in range(12)] + [(1, None, 99)]
    df, merges = spark.createDataFrame(turns, "run_id long, speaker_key string, idx int"), spark.createDataFrame(log, "run_id long, at long, from_key string, into_key string")
    for until in (None, 5, 1):
        now, moved, touched = {(r, i): k for r, k, i in turns}, {}, set()
        for run, at, a, b in sorted(log):
            if until is None or at <= until:
                hit = [x for x, k in now.items() if x[0] == run and k == a]
                now |= dict.fromkeys(hit, b)
                touched |= set(hit)
                moved.setdefault(run, []).append((a, b, len(hit)))
        got = speakers.merge_by_log(df, merges, until).collect()
        assert {(r.run_id, r.idx): r.speaker_key for r in got} == now and len(got) == len(turns)
        assert {(r.run_id, r.idx) for r in got if r.merged_from is not None} == touched
        counts = speakers.moved_counts(merges, until, turns=df).orderBy("run_id", "at").collect()
        found = {}
        for r in counts:
            found.setdefault(r.run_id, []).append((r.from_key, r.into_key, r.turns_moved))
        assert found == moved
    with pytest.raises(Exception, match="merged with itself"):
        speakers.merge_chains(spark.createDataFrame([(1, 1, "A", "A")], merges.schema)).collect()


def test_canonical_json(spark):
    cases = {
        '{"b": 1, "a": {"d": 2, "c": 3}}': '{"a":{"c":3,"d":2},"b":1}', "[3, 1, 2]": "[3,1,2]", "null": "null", '"x"': '"x"', "3": "3", "3.0": "3", "-0.0": "0", "-2.50": "-2.5", "1e21": "1e+21", "123456789012345680000": "123456789012345680000",
        "0.000001": "0.000001", "1.5e-7": "1.5e-7", "9007199254740993": "9007199254740992", '{"ﬀ": 1, "\U00010000": 2, "a": [{"z": null, "y": true}]}': '{"a":[{"y":true,"z":null}],"\U00010000":2,"ﬀ":1}',
        '{"a": 1, "a": 2}': '{"a":2}', '"\\ud800é\\u0001\\n"': '"\\ud800é\\u0001\\n"', "{}": "{}", "[]": "[]", "{torn": None, "": None, "1e300": "1e+300", "12345.678e3": "12345678", "1e-5": "0.00001",
    }
    rows = spark.createDataFrame(list(cases.items()) + [(None, None)], "j string, want string")
    assert [(r.j, r.got, r.want) for r in rows.withColumn("got", T.canonical_text("j")).where("not (got <=> want)").collect()] == []
    nested = {"k": {"b": [1, {"z": 1, "a": {"q": "ü", "p": None}}], "a": 0.5}, "c": False}

    def shuffled(x, rng):
        if isinstance(x, dict):
            return {k: shuffled(x[k], rng) for k in rng.sample(list(x), len(x))}
        return [shuffled(y, rng) for y in x] if isinstance(x, list) else x

    texts = [(json.dumps(shuffled(nested, random.Random(i))),) for i in range(20)]
    assert spark.createDataFrame(texts, "j string").select(T.params_hash(F.col("j")).alias("h")).distinct().count() == 1
