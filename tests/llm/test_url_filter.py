import random

from speechlake.llm import url_filter as U


def brute(url, items):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for e, v, k in items:
        h, p = e[: e.index("/")], e[e.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((k, len(e), len(h), e, v))
    best = max(fits, default=None)
    return host, path, best[3] if best and best[0] else None, best[4] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://NET/x", "https://a.example.net/en/1?x=/fr/", "https://a.example.net/fr/1", "http://notexample.net/en/", "http://example.com/de/",
    "http://example.com/de", "http://q.org/fr/x#y", "http://q.org/en", "ftp://www.casino-win.example.org/en/3", "http://x.net", "http://x.net?y", "a://b://c.net/d", "http://É.net/é", "http://spam-farm.example.com/de/x",
    "http://x\ny.net/a\nb?c", "http://.net/", "http://net./x", "://net/",
]


def test_matches_brute_force(spark):
    items = U.entries()
    rng = random.Random(3)
    urls = URLS + [f"http://{rng.choice(['a.', 'b.c.', ''])}example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{i}" for i in range(200)]
    df = spark.createDataFrame([(i % 150, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    want = sorted((i % 150, *brute(u, items)) for i, u in enumerate(urls))
    key = lambda r: tuple("" if x is None else x for x in r)
    listed = spark.createDataFrame(items + [(None, "block", 0), ("net/", "allow", 0)], "entry string, verdict string, is_rule int")
    for limit, size in ((U.BROADCAST_BYTES, U.SHARD_BYTES), (0, U.SHARD_BYTES), (0, 100)):
        for given in (None, listed):
            got = [tuple(r) for r in U.judge_urls(df, given, broadcast_bytes=limit, shard_bytes=size).collect()]
            assert sorted(got, key=key) == sorted(want, key=key)


def test_nested_and_equal_length_rules(spark):
    items = U.entries([("b.c/xx", "block"), ("a.b.c/", "allow"), ("c/", "block")], [])
    df = spark.createDataFrame([(1, "http://a.b.c/xxy"), (2, "http://z.c/"), (3, "http://d/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge_urls(df, items).collect()}
    assert got == {1: ("a.b.c/", "allow"), 2: ("c/", "block"), 3: (None, "allow")}


def test_collision_is_confirmed(monkeypatch):
    monkeypatch.setattr(U, "_digest", lambda text: 7)  # every key collides
    a = U.DigestArray(U.pack([("net/", "block", 1), ("com/x", "allow", 0)]))
    assert [a.string(i) if i >= 0 else None for i in a.find(["net/", "org/", "com/x"])] == ["net/", None, "com/x"]
    assert a.path_lengths == [1, 2]
    assert list(U.DigestArray(U.pack([])).find(["x/"])) == [-1]


def test_long_url_null_id_and_entry_without_path(spark):
    long = "http://a.b.c/" + "x" * 300_000
    df = spark.createDataFrame([(None, long), (2**60 + 1, long), (1, "http://d")], "page_id long, url string")
    listed = spark.createDataFrame([("b.c", "block", None), ("d/", None, 0)], "entry string, verdict string, is_rule int")
    for limit in (U.BROADCAST_BYTES, 0):
        got = [(r.page_id, len(r.path), r.rule, r.verdict) for r in U.judge_urls(df, listed, broadcast_bytes=limit).collect()]
        assert sorted(got, key=str) == sorted([(None, 300_001, None, "block"), (2**60 + 1, 300_001, None, "block"), (1, 0, None, "allow")], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    for limit in (U.BROADCAST_BYTES, 0):
        assert U.judge_urls(df, broadcast_bytes=limit).collect() == []
