"""Usage, cost, run state, event logs, uploads and routing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlake.functions import text as T

#: Coalescing window, staleness and due limits, and the least change of progress that is told.
COALESCE_MS, STALE_SECONDS, OVERDUE_SECONDS, PROGRESS_STEP = 500, 90, 300, 0.0005
STARTED = ("running", "awaiting_external")
TERMINAL = ("done", "dead", "skipped", "failed", "cancelled")
#: Fixed value: kinds of steps of which some shards may die.
CASUALTY_KINDS = ("asr.chunk",)
#: Extensions and MIME types of media.
MEDIA = {"mp3": "audio", "wav": "audio", "m4a": "audio", "ogg": "audio", "flac": "audio", "mp4": "video", "mov": "video", "mkv": "video", "webm": "video"}


def resolve_rates(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """usage with usd_per_unit and rate_source: the exact model's rate, else that of '*', else null. The rate table is small; a large one is joined without broadcast."""
    r = rates.select(F.col("provider_id").alias("_p"), F.col("unit").alias("_u"), F.col("model").alias("_m"), "usd_per_unit", F.col("source").alias("rate_source"))
    exact = usage.join(r, (F.col("provider_id") == F.col("_p")) & (F.col("unit") == F.col("_u")) & (F.col("model") == F.col("_m")), "left").drop("_p", "_u", "_m")
    any_ = r.where("_m = '*'").select("_p", "_u", F.col("usd_per_unit").alias("_usd"), F.col("rate_source").alias("_src"))
    both = exact.join(any_, (F.col("provider_id") == F.col("_p")) & (F.col("unit") == F.col("_u")), "left")
    own = F.col("usd_per_unit").isNotNull()
    return both.withColumns({"usd_per_unit": F.coalesce("usd_per_unit", "_usd"), "rate_source": F.when(own, F.col("rate_source")).otherwise(F.col("_src"))}).drop("_p", "_u", "_usd", "_src")


def usage_records(priced: DataFrame, billed: Column, own: Column) -> DataFrame:
    """Minutes of the provider's seconds, or else of our own, and usd; without a rate there is no record."""
    minutes = F.round(F.coalesce(billed, own) / 60, 4)
    return priced.where("usd_per_unit is not null").withColumn("minutes", minutes).withColumn("usd", F.round(F.coalesce(billed, own) / 60 * F.col("usd_per_unit"), 6))


def batch_items(priced: DataFrame, duration_ms: Column) -> DataFrame:
    """priced with duration_ms, usd and unpriced_reason of each item: unknown_duration, or no_rate, where there is no price. No price is null, never 0."""
    reason = F.when(duration_ms.isNull(), "unknown_duration").when(F.col("usd_per_unit").isNull(), "no_rate")
    return priced.withColumns({"duration_ms": duration_ms, "unpriced_reason": reason, "usd": F.when(reason.isNull(), duration_ms / 60_000 * F.col("usd_per_unit"))})


def batch_estimate(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, items, duration_ms, usd, unpriced, rate_source of batch_items: the duration is that of all items that have one, priced or not; the source of the rates used is none, one, or mixed."""
    sources = F.array_compact(F.collect_set(F.when(F.col("usd").isNotNull(), F.col("rate_source"))))
    out = items.groupBy(*by).agg(F.count("*").alias("items"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"), F.count_if(F.col("usd").isNull()).alias("unpriced"), sources.alias("s"))
    return out.withColumn("rate_source", F.when(F.size("s") == 0, "none").when(F.size("s") == 1, F.col("s")[0]).otherwise("mixed")).drop("s")


def seed_rates(stored: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, action, usd_per_unit: insert what is new, update changed defaults, leave overrides and the rest."""
    s = seeds.select(*keys, F.col("usd_per_unit").alias("_new"))
    both = stored.join(s, list(keys), "full")
    action = F.when(F.col("source").isNull(), "insert").when(F.col("_new").isNull(), "keep").when(F.col("source") == "override", "keep").when(F.col("usd_per_unit") != F.col("_new"), "update").otherwise("keep")
    return both.select(*keys, action.alias("action"), F.when(action.isin("insert", "update"), F.col("_new")).otherwise(F.col("usd_per_unit")).alias("usd_per_unit"))


def budget_cut(rows: DataFrame, by: Sequence[str], order: Sequence[str], cost: str, limit: float) -> DataFrame:
    """rows with spent and runs: within a group work stops before the first item that would pass the limit, and stays stopped."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).withColumn("runs", F.max(F.col("spent")).over(w) <= limit)


def run_progress(steps: DataFrame) -> DataFrame:
    """run_id, progress: weighted; a terminal step counts 1, one that runs or waits for another system what it reports, within 0.1 and 1, others 0. A report that is no finite number counts as none."""
    told = F.col("progress").cast("double")
    told = F.when(told.isNull() | F.isnan(told) | (F.abs(told) == float("inf")), 0.0).otherwise(told)
    part = F.when(F.col("state").isin(*TERMINAL), 1.0).when(F.col("state").isin(*STARTED), F.least(F.lit(1.0), F.greatest(F.lit(0.1), told))).otherwise(0.0)
    value = F.sum(F.col("weight") * part) / F.coalesce(F.nullif(F.sum("weight"), F.lit(0).cast("long")), F.lit(1).cast("long"))
    return steps.groupBy("run_id").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("progress"))


def run_state(steps: DataFrame, cancels: DataFrame | None = None, casualty_kinds: Sequence[str] = CASUALTY_KINDS) -> DataFrame:
    """run_id, state of runs whose steps are all terminal: cancelled, failed, partial or done; others are active.

    A dead step is a casualty if its kind is one of those that may lose shards and another step of the kind is done.
    Other failed or dead steps fail the run unless they are optional; casualties make it partial. It is cancelled only
    if that was asked for (cancels: run_id) and some step was cancelled.
    """
    state = F.col("state")
    lost = F.when(~F.col("optional") & state.isin("failed", "dead"), 1)
    kinds = steps.groupBy("run_id", "kind").agg(F.bool_and(state.isin(*TERMINAL)).alias("terminal"), F.bool_or(state == "done").alias("finished"), F.bool_or(state == "dead").alias("dead"),
                                                F.count(lost).alias("lost"), F.count(F.when(state == "dead", lost)).alias("lost_dead"), F.bool_or(state == "cancelled").alias("cancelled"))
    spared = F.col("finished") & F.col("kind").isin(*casualty_kinds)
    runs = kinds.groupBy("run_id").agg(F.bool_and("terminal").alias("terminal"), F.bool_or("cancelled").alias("cancelled"), F.bool_or(F.col("lost") > F.when(spared, F.col("lost_dead")).otherwise(0)).alias("failed"), F.bool_or(F.col("dead") & spared).alias("partial"))
    runs = runs.withColumn("asked", F.lit(False)) if cancels is None else runs.join(cancels.select("run_id").distinct().withColumn("asked", F.lit(True)), "run_id", "left")
    asked = F.coalesce("asked", F.lit(False)) & F.col("cancelled")
    return runs.select("run_id", F.when(~F.col("terminal"), "active").when(asked, "cancelled").when(F.col("failed"), "failed").when(F.col("partial"), "partial").otherwise("done").alias("state"))


def step_dependencies(steps: DataFrame, needs: DataFrame) -> DataFrame:
    """run_id, kind, shard, depends_on: ids of the steps that a step waits for; a need names a kind, and its own shard or all of them."""
    ids = steps.select("run_id", F.col("kind").alias("needs_kind"), F.col("shard").alias("_s"), F.concat_ws("/", "run_id", "kind", "shard").alias("id"))
    wanted = steps.join(F.broadcast(needs), "kind").select("run_id", "kind", "shard", "needs_kind", "needs_shard")
    met = wanted.join(ids, ["run_id", "needs_kind"]).where((F.col("needs_shard") == "*") | (F.col("_s") == F.col("shard")))
    found = met.groupBy("run_id", "kind", "shard").agg(F.array_sort(F.collect_set("id")).alias("depends_on"))
    return steps.select("run_id", "kind", "shard").distinct().join(found, ["run_id", "kind", "shard"], "left").withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))


def violations(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """keys, rule of every row that breaks a rule; a rule that is null holds, as in a database."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), name) for name, c in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, with the number of rows it stands for."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "copies": F.count("*").over(w)}).where("_r = 1").drop("_r")


def assets_by_digest(wanted: DataFrame, assets: DataFrame, digest: str = "sha256", deleted: str = "deleted_at") -> DataFrame:
    """wanted with the asset that has its content and was not deleted: a struct, null where there is none. At most one live asset has a content."""
    live = assets.where(F.col(deleted).isNull())
    return wanted.join(live.select(digest, F.struct(*[c for c in live.columns if c not in (digest, deleted)]).alias("asset")), digest, "left")


def seeded_sample(df: DataFrame, by: Sequence[str], key: str, n: int, seed: int, salts: int = 64) -> DataFrame:
    """n rows of each stratum, the same for any order of the input: ranked by a digest of seed and key.

    The first n are found in parts of a stratum and then among those, so that no stratum is sorted in one task.
    """
    rows = first_by(df, [*by, key], [key]).withColumns({"_d": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), "_s": F.pmod(F.hash(key), F.lit(salts))})
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("_d", key))
    rows = rows.withColumn("rank", rank(*by, "_s")).where(F.col("rank") <= n)
    return rows.withColumn("rank", rank(*by)).where(F.col("rank") <= n).drop("_d", "_s")


def first_n(df: DataFrame, by: Sequence[str], position: str, n: int, salts: int = 64) -> DataFrame:
    """The first n rows of each group in source order, found in parts as in seeded_sample."""
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    rows = df.withColumn("_s", F.pmod(F.hash(position), F.lit(salts)))
    rows = rows.withColumn("place", rank(*by, "_s")).where(F.col("place") <= n)
    return rows.withColumn("place", rank(*by)).where(F.col("place") <= n).drop("_s")


def over_fetch(n: int, rows: Column, dropped: Column) -> Column:
    """struct(expected_loss, fetch): clips to fetch so that n can be scored, given how many records have no usable reference."""
    total = rows + dropped
    loss = F.when(total > 0, n * dropped / total).otherwise(0.0)
    return F.struct(loss.alias("expected_loss"), F.least(total, n + F.ceil(loss) + 1).alias("fetch"))


def import_refusal(is_live: Column, duration_s: Column, most_s: float) -> Column:
    """Why media at a URL is not imported, or null: live, a duration that is not known and positive, or one over the limit."""
    d = duration_s.cast("double")
    unknown = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")) | (d <= 0)
    return F.when(F.coalesce(is_live, F.lit(False)), "live_stream").when(unknown, "unknown_duration").when(d > most_s, "file_too_large")


def with_responses(requests: DataFrame, keys: Sequence[str], complete: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """requests with the response column of ``complete``, any function from requests to (keys, response); null where it has none."""
    found = complete(requests).select(*keys, "response")
    return requests.join(found, list(keys), "left")


def insert_absent(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new rows whose key is not stored, and the stored rows, each with created."""
    fresh = first_by(new, keys, keys).drop("copies").join(stored.select(*keys).distinct(), list(keys), "left_anti")
    return stored.withColumn("created", F.lit(False)).unionByName(fresh.withColumn("created", F.lit(True)))


def coalesced_events(events: DataFrame, kinds: Sequence[str], window_ms: int = COALESCE_MS) -> DataFrame:
    """run_id, kind, seq, data: of the named kinds the latest of each window; other kinds pass as they are."""
    held = events.where(F.col("kind").isin(*kinds)).groupBy("run_id", "kind", F.window("created_at", f"{window_ms} milliseconds")).agg(F.max_by(F.struct("seq", "data"), "seq").alias("x")).select("run_id", "kind", "x.seq", "x.data")
    return held.unionByName(events.where(~F.col("kind").isin(*kinds)).select("run_id", "kind", "seq", "data"))


def latest_events(events: DataFrame) -> DataFrame:
    """run_id, kind, seq, data: last write wins, whatever the order or the repeats."""
    return events.groupBy("run_id", "kind").agg(F.max("seq").alias("seq"), F.max_by("data", "seq").alias("data"))


def stale_steps(events: DataFrame, keys: Sequence[str], ends: Sequence[str], until_ms: Column | None = None, seconds: int = STALE_SECONDS) -> DataFrame:
    """keys, seq, attempt, outcome: the batch twin of the stream of that name, up to the millisecond ``until_ms``; by default that of the last event.

    Whether a lease was lost after a heartbeat is seen from the next event of the step alone, and whether an end counted
    from the one before it; attempts are a running count of the losses, and the first final event hides all after it.
    """
    at, limit = F.unix_micros("created_at"), seconds * 1_000_000
    last = events.agg(F.floor(F.max(at) / 1000).cast("long").alias("_until"))
    rows = events.where("created_at is not null").crossJoin(F.broadcast(last)) if until_ms is None else events.where("created_at is not null").withColumn("_until", until_ms)
    rows = rows.where(at <= F.col("_until") * 1000).dropDuplicates([*keys, "created_at", "seq"])
    order = Window.partitionBy(*keys).orderBy("created_at", "seq")
    beat = ~F.col("kind").isin(*ends)
    rows = rows.withColumns({"_lost": beat & (F.coalesce(F.lead(at).over(order), F.col("_until") * 1000) - at > limit), "_end": ~beat & F.coalesce(F.lag(beat).over(order) & (at - F.lag(at).over(order) <= limit), F.lit(False))})
    rows = rows.withColumn("_n", F.col("attempt") + F.sum(F.col("_lost").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    used_up = F.col("_n") >= F.col("max_attempts")
    rows = rows.withColumn("_over", F.coalesce(F.max(F.col("_end") | (F.col("_lost") & used_up)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    return rows.where("_lost and not _over").select(*keys, "seq", F.col("_n").cast("int").alias("attempt"), F.when(~used_up, "pending").when(F.col("optional"), "skipped").otherwise("dead").alias("outcome"))


def overdue(events: DataFrame, now: Column, seconds: int = OVERDUE_SECONDS) -> DataFrame:
    """seq, overdue_s of work that was due longer ago than the limit."""
    late = (F.unix_micros(now) - F.unix_micros("created_at")) / 1e6
    return events.select("seq", "run_id", (late - seconds).alias("overdue_s")).where("overdue_s > 0")


def cancelled_items(events: DataFrame, keys: Sequence[str], queues: Sequence[str], starts: Sequence[str], cancels: Sequence[str]) -> DataFrame:
    """keys, item, seq, cancel: the batch twin of the stream of that name: the first queueing of an item after its last start before the run's first cancel."""
    at = F.struct(F.col("created_at"), F.col("seq"))
    rows = events.where("created_at is not null").withColumn("_at", at)
    flags = rows.where(F.col("kind").isin(*cancels)).groupBy(*keys).agg(F.min("_at").alias("_flag"))
    own = rows.where(F.col("item").isNotNull()).join(flags, list(keys))
    begun = own.groupBy(*keys, "item").agg(F.max(F.when(F.col("kind").isin(*starts) & (F.col("_at") < F.col("_flag")), F.col("_at"))).alias("_begun"), F.first("_flag").alias("_flag"))
    after = own.where(F.col("kind").isin(*queues)).drop("_flag").join(begun, [*keys, "item"]).where(F.col("_begun").isNull() | (F.col("_at") > F.col("_begun")))
    return after.groupBy(*keys, "item").agg(F.min("_at").alias("_at"), F.first("_flag.seq").alias("cancel")).select(*keys, "item", "_at.seq", "cancel")


def cancelled_work(events: DataFrame, cancel_kind: str) -> DataFrame:
    """seq, run_id, kind, cancelled: rows after their run's first cancel event; what came before it stays."""
    first = F.min(F.when(F.col("kind") == cancel_kind, F.struct("created_at", "seq"))).over(Window.partitionBy("run_id"))
    return events.withColumn("_c", first).select("seq", "run_id", "kind", (F.col("_c").isNotNull() & (F.struct("created_at", "seq") > F.col("_c"))).alias("cancelled"))


def file_name_problem(raw: Column) -> Column:
    """Why a file name is refused, or null: empty, a dot, control characters, or over 255 bytes. Only what follows the last slash counts."""
    name = F.trim(T.nfc(F.regexp_replace(raw, "^.*[/\\\\]", "")))
    return F.when(name == "", "empty").when(name.isin(".", ".."), "dot").when(name.rlike("[\\x00-\\x1F\\x7F]"), "control").when(F.octet_length(name) > 255, "long")


def media_kind(name: Column, mime: Column | None = None) -> Column:
    """By extension, else by the MIME type's base, else null."""
    table = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    by_name = F.try_element_at(table, F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1)))
    if mime is None:
        return by_name
    base = F.lower(F.regexp_extract(mime, "^\\s*(\\w+)/", 1))
    return F.coalesce(by_name, F.when(base.isin("audio", "video"), base))


def url_refusal(url: Column, allowed: Sequence[str] = ()) -> Column:
    """Why a url is refused without looking it up, or null: scheme, host, private address, or not on the list."""
    scheme, host = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lower(F.regexp_extract(url, "^[^:]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)", 1))
    octet = lambda i: F.regexp_extract(host, "^(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})$", i).try_cast("int")
    a, b = octet(1), octet(2)
    private4 = (a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)))
    private6 = host.rlike("^\\[(::1?|f[cd][0-9a-f]*:.*|fe[89ab][0-9a-f]*:.*|ff[0-9a-f]*:.*|::ffff:.*)\\]$")
    refused = F.when(url.isNull() | ~scheme.isin("http", "https"), "scheme").when(host == "", "host").when(F.coalesce(private4, F.lit(False)) | private6 | host.isin("localhost") | host.endswith(".localhost"), "private")
    if allowed:
        ok = F.lit(False)
        for h in allowed:
            ok = ok | (host == h) | host.endswith("." + h)
        refused = refused.when(~ok, "not-allowed")
    return refused


def request_budget_ms(most_ms: Column, most_bytes: Column, bytes_per_ms: Column) -> Column:
    return F.least(most_ms, F.greatest(F.lit(5000).cast("long"), F.floor(0.9 * most_bytes / bytes_per_ms)))


def mode(duration_ms: Column, size: Column, most_ms: int, most_bytes: int, forced: Column | None = None, staging: bool = False) -> Column:
    """struct(mode, reason): a forced mode that is supported; else sync if one request holds it, else sync_chunked. Duration never selects batch."""
    fits = duration_ms.isNotNull() & (duration_ms <= most_ms) & (size <= most_bytes)
    out = lambda m, r: F.struct(F.lit(m).alias("mode"), F.lit(r).alias("reason"))
    free = F.when(fits, out("sync", "fits one request")).otherwise(out("sync_chunked", "does not fit one request"))
    if forced is None:
        return free
    return (F.when((forced == "batch") & F.lit(staging), out("batch", "forced")).when(forced == "batch", out(None, "batch needs staging")).when((forced == "sync") & ~fits, out(None, "sync needs a known duration within the limits"))
            .when(forced == "sync", out("sync", "forced")).when(forced == "sync_chunked", out("sync_chunked", "forced")).otherwise(free))


def glossary(terms: DataFrame, term: str, boost: str) -> DataFrame:
    """term, boost: trimmed, without blanks, with the largest boost of each."""
    t = F.trim(F.col(term))
    return terms.select(t.alias("term"), F.col(boost).alias("boost")).where("term <> ''").groupBy("term").agg(F.max("boost").alias("boost"))


def pack_glossary(terms: DataFrame, by: Sequence[str], limit: int = 200) -> DataFrame:
    """by, packed, used: terms by falling boost, then falling length, then text, each if it still fits; a separator costs one token.

    Lengths are in UTF-16 units; a token is four of them, or two and a half in terms with letters beyond the Latin ones.
    """
    size = F.length("term") + F.regexp_count("term", F.lit("[\\x{10000}-\\x{10FFFF}]"))
    cost = F.ceil(size / F.when(F.col("term").rlike("[^\\x{20}-\\x{36F}]"), 2.5).otherwise(4.0)).cast("int")
    rows = terms.select(*by, F.struct((-F.col("boost")).alias("b"), (-size).alias("l"), "term", cost.alias("c")).alias("x")).groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("packed"))

    def step(acc: Column, x: Column) -> Column:
        need = x["c"] + F.when(F.size(acc["packed"]) > 0, 1).otherwise(0)
        fits = acc["used"] + need <= limit
        return F.struct(F.when(fits, acc["used"] + need).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["packed"], F.array(x["term"]))).otherwise(acc["packed"]).alias("packed"))

    return rows.select(*by, F.aggregate("xs", start, step).alias("a")).select(*by, "a.packed", "a.used")


def aliases(rows: DataFrame, dims: DataFrame) -> DataFrame:
    """alias, code: an alias that one code claims, else the single claimant with an evaluation set; codes are their own alias. dims: code, alias, has_set."""
    claims = dims.groupBy("alias").agg(F.countDistinct("code").alias("n"), F.min("code").alias("only"), F.countDistinct(F.when(F.col("has_set"), F.col("code"))).alias("m"), F.min(F.when(F.col("has_set"), F.col("code"))).alias("with_set"))
    named = claims.select("alias", F.when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("with_set")).alias("claimed"))
    codes = dims.select(F.col("code").alias("alias"), F.col("code").alias("exact")).distinct()
    return rows.join(codes, "alias", "left").join(named, "alias", "left").withColumn("code", F.coalesce("exact", "claimed")).drop("exact", "claimed")


def cache_split(requests: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """requests with hit, and the cached response of hits."""
    have = first_by(cached, [key], [key]).drop("copies").withColumn("hit", F.lit(True))
    return requests.join(have, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def orphans(lost: DataFrame, found: DataFrame, key: Sequence[str], back_seconds: int) -> DataFrame:
    """lost rows with the latest found operation of the same key in the time before them.

    Both sides are joined by key and stretch of time, a lost row in its own stretch and the one before.
    """
    stretch = lambda c: F.floor(F.unix_micros(c) / (back_seconds * 1_000_000))
    f = found.select(*key, F.col("seq").alias("op"), F.col("created_at").alias("op_at"), stretch("created_at").alias("_t"))
    at = lost.withColumn("_t", F.explode(F.array(stretch("created_at"), stretch("created_at") - 1)))
    met = at.join(f, [*key, "_t"]).where((F.col("op_at") < F.col("created_at")) & (F.unix_micros("created_at") - F.unix_micros("op_at") <= back_seconds * 1_000_000))
    best = met.groupBy("seq").agg(F.max_by("op", F.struct("op_at", "op")).alias("op"))
    return lost.join(best, "seq", "left")
