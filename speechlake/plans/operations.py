"""Queries of the operations operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechlake.functions import text as T
from speechlake.operators import operations as O
from speechlake.operators import shuffling
from speechlake.sources import views as V

_RATES = [("A", "F", "minute", 0.016, "default"), ("A", "*", "minute", 0.003, "default"), ("N", "*", "minute", 0.006, "override"), ("N", "F", "minute", 0.02, "default")]
_RATES_SQL = "(VALUES ('A', 'F', 'minute', 0.016::DOUBLE, 'default'), ('A', '*', 'minute', 0.003, 'default'), ('N', '*', 'minute', 0.006, 'override'), ('N', 'F', 'minute', 0.02, 'default')) r(provider_id, model, unit, usd_per_unit, source)"


def _rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RATES, "provider_id string, model string, unit string, usd_per_unit double, source string")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.resolve_rates(V.usage(spark, sf_dir), _rates(spark))


def rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir).groupBy("provider_id", "model", "rate_source", "usd_per_unit").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


_PRICED = f"SELECT u.*, coalesce(e.usd_per_unit, w.usd_per_unit) AS usd_per_unit, CASE WHEN e.usd_per_unit IS NOT NULL THEN e.source ELSE w.source END AS rate_source FROM usage u LEFT JOIN rates e ON u.provider_id = e.provider_id AND u.unit = e.unit AND u.model = e.model LEFT JOIN rates w ON u.provider_id = w.provider_id AND u.unit = w.unit AND w.model = '*'"
_R = {"rates": f"SELECT * FROM {_RATES_SQL}", "priced": _PRICED}


def usage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    billed = F.when(F.col("line") % 2 == 0, F.col("quantity") * 7)
    out = O.usage_records(_priced(spark, sf_dir), billed, F.col("quantity") * 6)
    return out.groupBy("provider_id", "model").agg(F.count("*").alias("records"), F.round(F.sum("minutes"), 3).alias("minutes"), F.round(F.sum("usd"), 5).alias("usd"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as recordings of so many minutes; every fourth was never measured."""
    return O.batch_items(_priced(spark, sf_dir), F.when(F.col("line") % 4 != 3, (F.col("quantity") * 60_000).cast("long")))


def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("order_id", "line", "duration_ms", F.round("usd", 8).alias("usd"), "unpriced_reason")


def batch_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.batch_estimate(_items(spark, sf_dir), ["order_id"]).withColumn("usd", F.round("usd", 8))


_ITEMS = "SELECT *, CASE WHEN duration_ms IS NULL THEN 'unknown_duration' WHEN usd_per_unit IS NULL THEN 'no_rate' END AS unpriced_reason, duration_ms / 60000.0::DOUBLE * usd_per_unit AS usd FROM (SELECT *, CASE WHEN line % 4 <> 3 THEN (quantity * 60000)::BIGINT END AS duration_ms FROM priced)"


def seeded_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = V.table(spark, sf_dir, "part")
    stored = parts.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("usd_per_unit"), F.when(F.col("p_size") % 5 == 0, "override").otherwise("default").alias("source"))
    seeds = parts.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")).alias("usd_per_unit"))
    return O.seed_rates(stored, seeds, ["id"])


_SEEDS = """SELECT id, action, CASE WHEN action IN ('insert', 'update') THEN n ELSE o END AS usd_per_unit FROM (SELECT coalesce(s.id, d.id) AS id, s.o, d.n, CASE WHEN s.id IS NULL THEN 'insert' WHEN d.id IS NULL THEN 'keep' WHEN s.source = 'override' THEN 'keep' WHEN s.o <> d.n THEN 'update' ELSE 'keep' END AS action FROM
 (SELECT p_partkey AS id, p_retailprice AS o, CASE WHEN p_size % 5 = 0 THEN 'override' ELSE 'default' END AS source FROM part WHERE p_partkey % 3 <> 0) s FULL JOIN (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS n FROM part WHERE p_partkey % 7 <> 0) d ON s.id = d.id)"""


def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.budget_cut(V.usage(spark, sf_dir), ["order_id"], ["line", "quantity", "provider_id", "model"], "quantity", 60.0)
    return out.groupBy("order_id").agg(F.count_if("runs").alias("run"), F.count_if(~F.col("runs")).alias("not_run"), F.max(F.when(F.col("runs"), F.col("spent"))).alias("spent"))


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending even shards wait for another system; some reports are out of range."""
    steps = V.step(spark, sf_dir).withColumns({"state": F.when((F.col("state") == "pending") & (F.col("shard") % 2 == 0), "awaiting_external").otherwise(F.col("state")), "progress": F.when(F.col("shard") == 2, F.col("progress") * 40 - 1).otherwise(F.col("progress"))})
    return O.run_progress(steps).withColumn("progress", F.round("progress", 9))


def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of kind O may lose shards; pending fifth shards were cancelled, which was asked for in every other run."""
    steps = V.step(spark, sf_dir).withColumn("state", F.when((F.col("shard") == 5) & (F.col("state") == "pending"), "cancelled").otherwise(F.col("state")))
    return O.run_state(steps, steps.where("run_id % 2 = 0").select("run_id"), ["O"])


_STATE = """SELECT run_id, CASE WHEN NOT bool_and(state IN ('done', 'dead', 'skipped', 'failed', 'cancelled')) THEN 'active' WHEN run_id % 2 = 0 AND bool_or(state = 'cancelled') THEN 'cancelled'
  WHEN bool_or(NOT optional AND state IN ('failed', 'dead') AND NOT casualty) THEN 'failed' WHEN bool_or(casualty) THEN 'partial' ELSE 'done' END AS state FROM (
 SELECT *, state = 'dead' AND kind = 'O' AND bool_or(state = 'done') OVER (PARTITION BY run_id, kind) AS casualty FROM (SELECT run_id, kind, shard, optional, CASE WHEN shard = 5 AND state = 'pending' THEN 'cancelled' ELSE state END AS state FROM step)) GROUP BY run_id"""


def step_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = spark.createDataFrame([("O", "F", "*"), ("F", "O", "same")], "kind string, needs_kind string, needs_shard string")
    out = O.step_dependencies(V.step(spark, sf_dir), needs)
    return out.select("run_id", "kind", "shard", F.array_join("depends_on", ",").alias("depends_on"))


_DEPS = """SELECT s.run_id, s.kind, s.shard, coalesce(string_agg(DISTINCT d.run_id || '/' || d.kind || '/' || d.shard, ',' ORDER BY d.run_id || '/' || d.kind || '/' || d.shard), '') AS depends_on FROM (SELECT DISTINCT run_id, kind, shard FROM step) s
 LEFT JOIN step d ON s.run_id = d.run_id AND ((s.kind = 'O' AND d.kind = 'F') OR (s.kind = 'F' AND d.kind = 'O' AND d.shard = s.shard)) GROUP BY s.run_id, s.kind, s.shard"""


def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.turn(spark, sf_dir)
    return O.violations(turns, ["run_id", "idx"], {"start<=end": F.col("start_ms") <= F.col("end_ms"), "end>=1000": F.col("end_ms") >= 1000, "speaker": F.col("speaker_key") != "system"})


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.repeated_keys(V.usage(spark, sf_dir), ["order_id", "line"])


def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_by(V.asset(spark, sf_dir), ["sha256"], ["asset_id"]).select("asset_id", "sha256", "copies")


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return O.seeded_sample(rows, ["lang", "source"], "doc_id", 5, 42).select("doc_id", "lang", "source", "rank")


def shuffled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of the seeded shuffle of each language."""
    return shuffling.seeded_shuffle(V.table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 5, 42).select("doc_id", "lang", "rank")


_MUL = "((({0}) & 65535) * ({1}) + ((((({0}) >> 16) * ({1})) & 65535) << 16)) & 4294967295"
_SHUFFLE = f"""WITH RECURSIVE o AS (SELECT lang, list(doc_id ORDER BY doc_id) AS a, count(*) AS n FROM documents GROUP BY lang),
k AS (SELECT lang, n, unnest(range(n - 1, 0, -1)) AS i FROM o),
x AS (SELECT lang, i, (42 + ({_MUL.format('n - i', '1831565813::BIGINT')})) & 4294967295 AS a FROM k),
y AS (SELECT lang, i, {_MUL.format('xor(a, a >> 15)', 'a | 1')} AS t FROM x),
z AS (SELECT lang, i, xor((t + ({_MUL.format('xor(t, t >> 7)', 't | 61')})) & 4294967295, t) AS t FROM y),
d AS MATERIALIZED (SELECT lang, i, floor(xor(t, t >> 14) / 4294967296.0::DOUBLE * (i + 1))::BIGINT AS j FROM z),
w AS (SELECT lang, a, n - 1 AS i FROM o UNION ALL
 SELECT w.lang, CASE WHEN d.j = d.i THEN a ELSE list_concat(a[1:d.j], [a[d.i + 1]], a[d.j + 2:d.i], [a[d.j + 1]], a[d.i + 2:]) END, w.i - 1 FROM w JOIN d ON d.lang = w.lang AND d.i = w.i)
SELECT lang, a[rank] AS doc_id, rank::INT AS rank FROM (SELECT lang, a, unnest(range(1, least(len(a), 5) + 1)) AS rank FROM w WHERE i = 0)"""


def params_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of nested parameters whose keys come in one of two orders."""
    e = V.ev(spark, sf_dir)
    one = F.format_string('{"temperature": 0.50, "prompt": {"version": %d, "opts": {"b": [3, 1, {"y": 1e0, "x": null}], "a": %s}, "id": "k"}, "data": %s}', F.col("seq") % 5, F.to_json(F.struct("kind")), "data")
    two = F.format_string('{"data":%3$s,"prompt":{"id":"k","opts":{"a":%2$s,"b":[3.0,1,{"x":null,"y":1}]},"version":%1$d},"temperature":5e-1}', F.col("seq") % 5, F.to_json(F.struct("kind")), "data")
    return e.select("seq", T.params_hash(F.when(F.col("seq") % 2 == 0, one).otherwise(two)).alias("params"))


def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.asset(spark, sf_dir).select("sha256", "asset_id")
    stored = O.first_by(a.where("asset_id % 2 = 0"), ["sha256"], ["asset_id"]).drop("copies")
    return O.insert_absent(stored, a.where("asset_id % 2 = 1").groupBy("sha256").agg(F.min("asset_id").alias("asset_id")), ["sha256"])


def coalesced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.coalesced_events(V.ev(spark, sf_dir), ["click", "view"])


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.latest_events(V.ev(spark, sf_dir))


#: Seconds of silence that lose a lease here, and the kind of event that ends a step: a user's day is a step.
STALE_HERE, ENDS = 6 * 3600, ["purchase"]


def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as heartbeats and ends of steps, with each step's attempts and whether it may be skipped."""
    day = F.dayofmonth("created_at")
    terms = {"attempt": (F.col("run_id") % 2).cast("int"), "max_attempts": (1 + (F.col("run_id") + day) % 4).cast("int"), "optional": (F.col("run_id") + day) % 3 == 0}
    return V.ev(spark, sf_dir).select("run_id", day.cast("long").alias("step"), "created_at", "seq", "kind", *[c.alias(n) for n, c in terms.items()])


def stale_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.stale_steps(step_events(spark, sf_dir), ["run_id", "step"], ENDS, seconds=STALE_HERE)


STALE = """WITH RECURSIVE e AS (SELECT user_id AS run_id, dayofmonth(ts) AS step, epoch_us(ts) AS us, event_id AS seq, event_type = 'purchase' AS ends, (SELECT epoch_ms(max(ts)) FROM events) AS until FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY us, seq) AS k FROM e WHERE us <= until * 1000),
t AS (SELECT *, lead(us) OVER (PARTITION BY run_id, step ORDER BY k) AS next FROM n),
w AS (
 SELECT run_id, step, 0::BIGINT AS k, (run_id % 2)::INT AS attempt, 'pending' AS state, 0::BIGINT AS seq, false AS lost FROM (SELECT DISTINCT run_id, step FROM n)
 UNION ALL
 SELECT run_id, step, k, attempt + quiet::INT, CASE WHEN state IN ('done', 'dead', 'skipped') THEN state WHEN quiet THEN CASE WHEN attempt + 1 < 1 + (run_id + step) % 4 THEN 'pending' WHEN (run_id + step) % 3 = 0 THEN 'skipped' ELSE 'dead' END
   WHEN NOT ends THEN 'running' WHEN state = 'running' THEN 'done' ELSE state END, seq, quiet
 FROM (SELECT w.run_id, w.step, t.k, w.attempt, w.state, t.seq, t.ends, NOT t.ends AND w.state IN ('pending', 'running') AND coalesce(t.next, until * 1000) - t.us > 21600000000 AS quiet FROM w JOIN t ON t.run_id = w.run_id AND t.step = w.step AND t.k = w.k + 1))
SELECT run_id, step, seq, attempt, state AS outcome FROM w WHERE lost"""


def item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as work: views and clicks queue the work of a user's day, purchases start it, every seventh error cancels the user's run."""
    kind = F.when(F.col("kind").isin("view", "click"), "queue").when(F.col("kind") == "purchase", "start").when((F.col("kind") == "error") & (F.col("seq") % 7 == 0), "cancel").otherwise("other")
    return V.ev(spark, sf_dir).select("run_id", "created_at", "seq", kind.alias("kind"), F.dayofmonth("created_at").cast("string").alias("item"))


def cancelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cancelled_items(item_events(spark, sf_dir), ["run_id"], ["queue"], ["start"], ["cancel"])


CANCELLED = """WITH e AS (SELECT user_id AS run_id, (ts, event_id) AS us, event_id AS seq, dayofmonth(ts)::VARCHAR AS item, CASE WHEN event_type IN ('view', 'click') THEN 'queue' WHEN event_type = 'purchase' THEN 'start' WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'cancel' END AS kind FROM events{bound}),
c AS (SELECT run_id, min(us) AS c, arg_min(seq, us) AS cancel FROM e WHERE kind = 'cancel' GROUP BY run_id)
SELECT q.run_id, q.item, arg_min(q.seq, q.us) AS seq, any_value(cancel) AS cancel FROM e q JOIN c ON q.run_id = c.run_id
WHERE q.kind = 'queue' AND NOT EXISTS (SELECT 1 FROM e s WHERE s.run_id = q.run_id AND s.item = q.item AND s.kind = 'start' AND s.us > q.us AND s.us < c.c) GROUP BY q.run_id, q.item"""


def overdue_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.overdue(V.ev(spark, sf_dir), F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return out.withColumn("overdue_s", F.round("overdue_s", 6)).orderBy(F.desc("overdue_s"), "seq")


def cancelled_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cancelled_work(V.ev(spark, sf_dir), "error")


def replay_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ev(spark, sf_dir).where("seq > 500").groupBy("run_id").agg(F.count("*").alias("events"), F.min("seq").alias("first"))


def orphan_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.ev(spark, sf_dir)
    return O.orphans(e.where("kind = 'error'"), e.where("kind <> 'error'"), ["run_id"], 3600 * 6).select("seq", "run_id", "op")


def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("http://10."), (F.col("page_id") % 256).cast("string"), F.lit(".0.1/x"))).when(F.col("page_id") % 13 == 0, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url"))
    return V.table(spark, sf_dir, "pages").select("page_id", O.url_refusal(url, ["example.com", "example.org"]).alias("refusal"))


_URL = """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'private' WHEN page_id % 13 = 0 THEN 'scheme' WHEN h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.org' OR h LIKE '%.example.org' THEN NULL ELSE 'not-allowed' END AS refusal
 FROM (SELECT page_id, lower(regexp_extract(url, '^[^:]*://([^/?#:]*)', 1)) AS h FROM pages)"""


def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, ".MP3").when(F.col("page_id") % 3 == 1, ".txt").otherwise("/"))
    mime = F.when(F.col("page_id") % 2 == 0, "Video/x-thing; q=1").otherwise("text/plain")
    return V.table(spark, sf_dir, "pages").select("page_id", O.file_name_problem(name).alias("problem"), O.media_kind(name, mime).alias("kind"))


def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    forced = F.when(F.col("asset_id") % 5 == 0, "batch").when(F.col("asset_id") % 5 == 1, "sync")
    m = O.mode(F.col("duration_ms"), F.col("bytes"), 60_000, 2_000, forced)
    return V.asset(spark, sf_dir).select("asset_id", m["mode"].alias("mode"), m["reason"].alias("reason"), O.request_budget_ms(F.lit(60_000).cast("long"), F.col("bytes"), F.lit(0.05)).alias("budget_ms"))


_ROUTE = """SELECT asset_id, CASE asset_id % 5 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN fits THEN 'sync' END ELSE CASE WHEN fits THEN 'sync' ELSE 'sync_chunked' END END AS mode,
 CASE asset_id % 5 WHEN 0 THEN 'batch needs staging' WHEN 1 THEN CASE WHEN fits THEN 'forced' ELSE 'sync needs a known duration within the limits' END ELSE CASE WHEN fits THEN 'fits one request' ELSE 'does not fit one request' END END AS reason,
 least(60000, greatest(5000, floor(0.9::DOUBLE * bytes / 0.05::DOUBLE)))::BIGINT AS budget_ms FROM (SELECT *, duration_ms <= 60000 AND bytes <= 2000 AS fits FROM asset)"""


def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their project, and the number of their steps."""
    o, c = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "customer")
    steps = V.step(spark, sf_dir).groupBy(F.col("run_id").alias("o_orderkey")).agg(F.count("*").alias("steps"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(steps, "o_orderkey").groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("runs"), F.sum("steps").alias("steps"))


def glossary_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = V.table(spark, sf_dir, "part")
    terms = parts.select("p_brand", F.trim("p_name").alias("term"), F.col("p_size").alias("boost")).groupBy("p_brand", "term").agg(F.max("boost").alias("boost"))
    return O.pack_glossary(terms, ["p_brand"], 40).select("p_brand", F.array_join("packed", ";").alias("packed"), "used")


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.glossary(V.table(spark, sf_dir, "part"), "p_name", "p_size")


def alias_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = spark.createDataFrame([("en", "eng", True), ("en-GB", "eng", False), ("fr", "fre", True), ("fr", "fra", True), ("de", "ger", True), ("at", "ger", True), ("es", "en", False)], "code string, alias string, has_set boolean")
    alias = F.when(F.col("doc_id") % 4 == 0, F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "fra").when(F.col("lang") == "de", "ger").otherwise("xx")).otherwise(F.col("lang"))
    rows = V.table(spark, sf_dir, "documents").select("doc_id", alias.alias("alias"))
    return O.aliases(rows, dims).select("doc_id", "alias", "code")


def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.asset(spark, sf_dir).select("asset_id", T.content_key(F.lit("p"), F.col("lang"), F.col("sha256")).alias("key"))
    cached = V.asset(spark, sf_dir).where("asset_id % 2 = 0").select(T.content_key(F.lit("p"), F.col("lang"), F.col("sha256")).alias("key"))
    return O.cache_split(rows, cached, "key").groupBy("hit").agg(F.count("*").alias("n"), F.sum("asset_id").alias("ids"))


def merged_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.to_json(F.struct(F.col("kind").alias("kind"), F.when(F.col("seq") % 2 == 0, "9").alias("k")))
    m = T.merge_json(F.col("data"), extra)
    return V.ev(spark, sf_dir).select("seq", m["k"].alias("k"), m["kind"].alias("kind"))


def word_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.word(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("words"), F.count("confidence").alias("sure"), F.countDistinct("confidence").alias("distinct_values"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.count_if(F.col("confidence") < 0.5).alias("weak"))


_GLOSSARY = """WITH RECURSIVE t AS (SELECT p_brand, trim(p_name) AS term, max(p_size) AS boost FROM part GROUP BY 1, 2),
r AS (SELECT p_brand, term, ceil(length(term) / CASE WHEN regexp_matches(term, '[^\\x20-\\x{36F}]') THEN 2.5 ELSE 4.0 END)::INT AS c, row_number() OVER (PARTITION BY p_brand ORDER BY boost DESC, length(term) DESC, term) AS k FROM t),
p AS (SELECT p_brand, 0::BIGINT AS k, 0 AS used, '' AS packed FROM (SELECT DISTINCT p_brand FROM part) UNION ALL
 SELECT p.p_brand, r.k, CASE WHEN used + c + (used > 0)::INT <= 40 THEN used + c + (used > 0)::INT ELSE used END, CASE WHEN used + c + (used > 0)::INT <= 40 THEN packed || CASE WHEN used > 0 THEN ';' ELSE '' END || term ELSE packed END FROM p JOIN r ON r.p_brand = p.p_brand AND r.k = p.k + 1)
SELECT p_brand, arg_max(packed, k) AS packed, arg_max(used, k) AS used FROM p GROUP BY p_brand"""


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_n(V.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 3)


def fetch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips to fetch for a sample of 100 when texts below 200 characters can't be scored."""
    per = V.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("n_chars") >= 200).alias("rows"), F.count_if(F.col("n_chars") < 200).alias("dropped"))
    return per.withColumn("x", O.over_fetch(100, F.col("rows"), F.col("dropped"))).select("lang", "rows", "dropped", F.round("x.expected_loss", 9).alias("expected_loss"), "x.fetch")


def import_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 11 == 3).alias("live"), F.when(F.col("doc_id") % 7 != 2, F.col("n_chars") * 0.06 - 3).alias("seconds"))
    return rows.select("doc_id", O.import_refusal(F.col("live"), F.col("seconds"), 300.0).alias("refusal"))


QUERIES = {f.__name__: f for f in (first_rows, fetch_sizes, import_checks, rate_lookup, usage_records, batch_items, batch_estimate, seeded_rates, budget_cut, run_progress, run_state, step_dependencies, row_violations, repeated_keys, content_dedupe, seeded_sample, insert_absent, coalesced_events, latest_events,
                                   stale_work, overdue_work, cancelled_work, cancelled_items, shuffled_sample, params_hashes, replay_after, orphan_operations, url_policy, upload_checks, routing, star_join, glossary_pack, glossary, alias_codes, response_cache, merged_props, word_census)}
ORACLE_SQL = {
    "rate_lookup": V.oracle("SELECT provider_id, model, rate_source, usd_per_unit, count(*) AS n, sum(quantity) AS quantity FROM priced GROUP BY ALL", "usage", **_R),
    "usage_records": V.oracle("SELECT provider_id, model, count(*) AS records, round(sum(round(s / 60, 4)), 3) AS minutes, round(sum(round(s / 60 * usd_per_unit, 6)), 5) AS usd FROM (SELECT *, CASE WHEN line % 2 = 0 THEN quantity * 7 ELSE quantity * 6 END AS s FROM priced WHERE usd_per_unit IS NOT NULL) GROUP BY provider_id, model", "usage", **_R),
    "batch_items": V.oracle(f"SELECT order_id, line, duration_ms, round(usd, 8) AS usd, unpriced_reason FROM ({_ITEMS})", "usage", **_R),
    "batch_estimate": V.oracle(f"SELECT order_id, count(*) AS items, coalesce(sum(duration_ms), 0)::BIGINT AS duration_ms, coalesce(round(sum(usd), 8), 0) AS usd, count(*) FILTER (WHERE usd IS NULL) AS unpriced, CASE count(DISTINCT rate_source) FILTER (WHERE usd IS NOT NULL) WHEN 0 THEN 'none' WHEN 1 THEN min(rate_source) FILTER (WHERE usd IS NOT NULL) ELSE 'mixed' END AS rate_source FROM ({_ITEMS}) GROUP BY order_id", "usage", **_R),
    "seeded_rates": _SEEDS,
    "budget_cut": V.oracle("SELECT order_id, count(*) FILTER (WHERE spent <= 60) AS run, count(*) FILTER (WHERE spent > 60) AS not_run, max(spent) FILTER (WHERE spent <= 60) AS spent FROM (SELECT order_id, sum(quantity) OVER (PARTITION BY order_id ORDER BY line, quantity, provider_id, model ROWS UNBOUNDED PRECEDING) AS spent FROM usage) GROUP BY order_id", "usage"),
    "run_progress": V.oracle("SELECT run_id, round(sum(weight * CASE WHEN state IN ('done', 'dead') THEN 1.0::DOUBLE WHEN state = 'running' OR (state = 'pending' AND shard % 2 = 0) THEN least(1.0::DOUBLE, greatest(0.1::DOUBLE, CASE shard WHEN 2 THEN progress * 40 - 1 ELSE progress END)) ELSE 0 END) / coalesce(nullif(sum(weight), 0), 1), 9) AS progress FROM step GROUP BY run_id", "step"),
    "run_state": V.oracle(_STATE, "step"),
    "glossary_pack": _GLOSSARY,
    "first_rows": "SELECT doc_id, lang, source, place::INT AS place FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS place FROM documents) WHERE place <= 3",
    "fetch_sizes": "SELECT lang, r AS rows, d AS dropped, round(100.0::DOUBLE * d / (r + d), 9) AS expected_loss, least(r + d, 100 + ceil(100.0::DOUBLE * d / (r + d))::BIGINT + 1) AS fetch FROM (SELECT lang, count(*) FILTER (WHERE n_chars >= 200) AS r, count(*) FILTER (WHERE n_chars < 200) AS d FROM documents GROUP BY lang)",
    "import_checks": "SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'live_stream' WHEN doc_id % 7 = 2 OR n_chars * 0.06::DOUBLE - 3 <= 0 THEN 'unknown_duration' WHEN n_chars * 0.06::DOUBLE - 3 > 300 THEN 'file_too_large' END AS refusal FROM documents",
    "step_dependencies": V.oracle(_DEPS, "step"),
    "row_violations": V.oracle("SELECT run_id, idx, 'start<=end' AS rule FROM turn WHERE start_ms > end_ms UNION ALL SELECT run_id, idx, 'end>=1000' FROM turn WHERE end_ms < 1000 UNION ALL SELECT run_id, idx, 'speaker' FROM turn WHERE speaker_key = 'system'", "turn"),
    "repeated_keys": V.oracle("SELECT order_id, line, count(*) AS n FROM usage GROUP BY order_id, line HAVING count(*) > 1", "usage"),
    "content_dedupe": V.oracle("SELECT min(asset_id) AS asset_id, sha256, count(*) AS copies FROM asset GROUP BY sha256", "asset"),
    "seeded_sample": "SELECT doc_id, lang, source, rank::INT AS rank FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 5",
    "insert_absent": V.oracle("SELECT sha256, min(asset_id) AS asset_id, false AS created FROM asset WHERE asset_id % 2 = 0 GROUP BY sha256 UNION ALL SELECT sha256, min(asset_id), true FROM asset WHERE asset_id % 2 = 1 AND sha256 NOT IN (SELECT sha256 FROM asset WHERE asset_id % 2 = 0) GROUP BY sha256", "asset"),
    "coalesced_events": V.oracle("SELECT run_id, kind, seq, data FROM (SELECT *, row_number() OVER (PARTITION BY run_id, kind, epoch_us(created_at) // 500000 ORDER BY seq DESC) AS k FROM ev WHERE kind IN ('click', 'view')) WHERE k = 1 UNION ALL SELECT run_id, kind, seq, data FROM ev WHERE kind NOT IN ('click', 'view')", "ev"),
    "latest_events": V.oracle("SELECT run_id, kind, max(seq) AS seq, arg_max(data, seq) AS data FROM ev GROUP BY run_id, kind", "ev"),
    "shuffled_sample": _SHUFFLE,
    "params_hashes": V.oracle("""SELECT seq, sha256('{"data":' || json(data) || ',"prompt":{"id":"k","opts":{"a":{"kind":"' || kind || '"},"b":[3,1,{"x":null,"y":1}]},"version":' || (seq % 5) || '},"temperature":0.5}') AS params FROM ev""", "ev"),
    "stale_work": STALE,
    "cancelled_items": CANCELLED.format(bound=""),
    "overdue_work": V.oracle("SELECT seq, run_id, round((epoch_us(TIMESTAMP '2024-01-10 00:00:00') - epoch_us(created_at)) / 1e6 - 300, 6) AS overdue_s FROM ev WHERE (epoch_us(TIMESTAMP '2024-01-10 00:00:00') - epoch_us(created_at)) / 1e6 > 300", "ev"),
    "cancelled_work": V.oracle("SELECT e.seq, e.run_id, e.kind, c.seq IS NOT NULL AND (e.created_at > c.created_at OR (e.created_at = c.created_at AND e.seq > c.seq)) AS cancelled FROM ev e LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at, seq) AS k FROM ev WHERE kind = 'error') WHERE k = 1) c ON e.run_id = c.run_id", "ev"),
    "replay_after": V.oracle("SELECT run_id, count(*) AS events, min(seq) AS first FROM ev WHERE seq > 500 GROUP BY run_id", "ev"),
    "orphan_operations": V.oracle("SELECT l.seq, any_value(l.run_id) AS run_id, arg_max(f.seq, (f.created_at, f.seq)) AS op FROM ev l LEFT JOIN ev f ON l.run_id = f.run_id AND f.kind <> 'error' AND f.created_at < l.created_at AND epoch_us(l.created_at) - epoch_us(f.created_at) <= 21600000000 WHERE l.kind = 'error' GROUP BY l.seq", "ev"),
    "url_policy": _URL,
    "upload_checks": "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'empty' WHEN octet_length(encode(regexp_extract(url || CASE page_id % 3 WHEN 0 THEN '.MP3' ELSE '.txt' END, '[^/]*$'))) > 255 THEN 'long' END AS problem, CASE WHEN page_id % 3 = 0 THEN 'audio' WHEN page_id % 2 = 0 THEN 'video' END AS kind FROM pages",
    "routing": V.oracle(_ROUTE, "asset"),
    "star_join": "SELECT c_mktsegment, o_orderstatus, count(*) AS runs, sum(steps)::BIGINT AS steps FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, count(*) AS steps FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY c_mktsegment, o_orderstatus",
    "glossary": "SELECT trim(p_name) AS term, max(p_size) AS boost FROM part WHERE trim(p_name) <> '' GROUP BY trim(p_name)",
    "alias_codes": "SELECT doc_id, alias, CASE alias WHEN 'eng' THEN 'en' WHEN 'fra' THEN 'fr' WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' WHEN 'es' THEN 'es' END AS code FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'ger' ELSE 'xx' END ELSE lang END AS alias FROM documents)",
    "response_cache": V.oracle("SELECT hit, count(*) AS n, sum(asset_id)::BIGINT AS ids FROM (SELECT asset_id, EXISTS (SELECT 1 FROM asset b WHERE b.asset_id % 2 = 0 AND b.sha256 = a.sha256 AND b.lang = a.lang) AS hit FROM asset a) GROUP BY hit", "asset"),
    "merged_props": V.oracle("SELECT seq, CASE WHEN seq % 2 = 0 THEN '9' ELSE json_extract_string(data, '$.k') END AS k, kind FROM ev", "ev"),
    "word_census": V.oracle("SELECT run_id, count(*) AS words, count(confidence) AS sure, count(DISTINCT confidence) AS distinct_values, min(confidence) AS low, max(confidence) AS high, count(*) FILTER (WHERE confidence < 0.5) AS weak FROM word GROUP BY run_id", "word"),
}
