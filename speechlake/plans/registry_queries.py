"""Queries of the file readers and of the language registry, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.operators import evaluation as E
from speechlake.operators import registry as R
from speechlake.plans.evaluation import _BOOT
from speechlake.sources import files, views as V
from speechlake.sources.scratch import shared_dir

_LANGUAGES = [("en", "Latn"), ("fr", "Latn"), ("de", "Latn"), ("es", "Latn"), ("my", "Mymr")]
_CAPS = [("en", "alpha", True, "en-US", True, False), ("en", "beta", True, "en", False, False), ("fr", "alpha", True, "fr-FR", True, True), ("fr", "beta", True, "fr", True, False), ("de", "alpha", False, None, False, False), ("de", "beta", True, "de", True, False), ("es", "alpha", True, "es-ES", False, False)]
_CAPS_SQL = "(VALUES ('en', 'alpha', true, 'en-US', true, false), ('en', 'beta', true, 'en', false, false), ('fr', 'alpha', true, 'fr-FR', true, true), ('fr', 'beta', true, 'fr', true, false), ('de', 'alpha', false, NULL, false, false), ('de', 'beta', true, 'de', true, false), ('es', 'alpha', true, 'es-ES', false, false)) c(code, provider, accepted, provider_code, word_timing, suspect)"


def _languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LANGUAGES, "code string, script string")


def _capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CAPS, "code string, provider string, accepted boolean, provider_code string, word_timing boolean, suspect boolean")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def eval_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a quoted seven-column file with some broken ids, and read back."""
    at, d = _scratch(spark), V.table(spark, sf_dir, "documents")
    bad = F.col("doc_id") % 17 == 3
    d.select(F.when(bad, "x1").otherwise(F.col("doc_id").cast("string")).alias("id"), F.lit("f").alias("filename"), "text", F.lit("p").alias("plain"), F.lit("g").alias("graphemes"), F.col("n_chars").alias("num_samples"), "lang").write.csv(at, sep="\t", quote='"', escape='"', quoteAll=True)
    rows, dropped = files.read_eval_rows(spark, at)
    return rows.agg(F.count("*").alias("rows"), F.sum("id").alias("ids"), F.sum(F.length("raw")).alias("chars"), F.sum("num_samples").alias("samples")).crossJoin(dropped)


def runlog_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a run appended as JSON with torn lines between them, read back; rates, intervals, ratios and tiers are made anew from them. One language ended in an error, one has only its summary, and the run has no footer."""
    at, d = _scratch(spark), V.table(spark, sf_dir, "documents")
    line = F.struct(F.lit("score").alias("t"), F.col("doc_id").alias("id"), "lang", (F.col("n_chars") % 10).alias("edits"), F.col("n_chars").alias("ref_len"), F.lit(9.0).alias("usd"))
    files.append_runlog(d.where("doc_id % 13 <> 5").select(line.alias("x")).select("x.*"), at)
    files.append_runlog(d.select(F.lit("asr").alias("t"), "lang", (F.col("doc_id") % 4 / 4).alias("usd")), at)
    d.where("doc_id % 13 = 5").select(F.substring(F.to_json(line), 1, 20).alias("value")).write.mode("append").text(at)
    told = d.groupBy("lang").agg(F.count("*").alias("n")).select("lang", "n", F.when(F.col("lang") == "de", "budget").alias("error"), F.lit(0.5).alias("cer"))
    told = told.unionByName(d.agg(F.lit("my").alias("lang"), F.count("*").alias("n"), F.lit(None).cast("string").alias("error"), F.lit(0.25).alias("cer")))
    files.append_runlog(told.withColumn("t", F.lit("summary")), at)
    lines = files.read_runlog(spark, at, "t string, id long, lang string, edits long, ref_len long, usd double, n long, cer double, error string")
    rates, totals = R.replayed(lines)
    interval = E.bootstrap(lines.where("t = 'score'"), "lang", "id", b=200).select("lang", "lo", "hi")
    rows = E.baseline_ratio(rates.join(interval.join(rates.where("error is null").select("lang"), "lang"), "lang", "left"), "lang", "en")
    t = E.tier(F.col("cer"), F.col("hi"), F.col("ratio"), F.lit(1.0), F.col("n"), F.lit(True))
    rows = rows.withColumn("tier", t["tier"])
    return rows.withColumns({c: F.round(c, 9) for c in ("cer", "lo", "hi", "ratio")}).crossJoin(totals)


def language_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "zz").when(F.col("doc_id") % 9 == 1, "my").otherwise(F.col("lang")).alias("code"))
    return R.provider_code(rows, _capabilities(spark), _languages(spark), "alpha").groupBy("code", "provider_code", "failure").agg(F.count("*").alias("n"))


def exclusive_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = V.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("code")).agg(F.count("*").alias("n"))
    return R.supported_by(used, _capabilities(spark), "alpha", exclusive=True)


def provider_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = V.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("code")).agg(F.count("*").alias("n"))
    return used.join(F.broadcast(R.chosen_provider(_capabilities(spark), ["alpha", "beta"])), "code", "left")


def tier_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id")
    labels = V.table(spark, sf_dir, "labels")
    override = labels.where("quality = 0").select("doc_id", F.lit("unsupported").alias("tier"))
    measured = labels.where("toxic = 0").select("doc_id", F.lit("beta").alias("tier"))
    seed = d.where("doc_id % 2 = 0").select("doc_id", F.lit("experimental").alias("tier"))
    return R.cascade(d, "doc_id", override, measured, seed)


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a provider: errors as refusals of four kinds, of which the words tell one from another."""
    status = F.when(F.col("kind") == "error", F.when(F.col("seq") % 3 == 0, 500).otherwise(400)).otherwise(200)
    said = F.when(F.col("seq") % 2 == 1, "bad audio").when(F.col("seq") % 4 == 0, "Bad language code").otherwise("Model not supported")
    return V.ev(spark, sf_dir).select("seq", "run_id", "kind", R.call_outcome(status, said).alias("outcome"))


def capability_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attempts(spark, sf_dir)
    attempts = rows.select(F.concat_ws(":", F.col("run_id") % 100, F.col("kind"), F.col("seq") % 5).alias("code"), F.col("kind").alias("model"), "outcome", F.when(F.col("seq") % 7 == 0, True).when(F.col("seq") % 7 == 1, False).alias("word_timing"))
    known = F.concat_ws(":", F.col("run_id") % 100 + 50, F.lit("error"), F.col("seq") % 5)
    previous = rows.select(known.alias("code"), F.lit("accepted").alias("status"), F.lit(True).alias("supported"), F.array(F.lit("old")).alias("models"), F.lit(False).alias("word_timing")).distinct()
    return R.capability_roll_up(attempts, previous).withColumn("models", F.array_join("models", ","))


def baseline_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = V.ev(spark, sf_dir).select(F.col("seq").alias("run_id"), "kind", F.col("created_at").alias("finished_at"), F.col("value").alias("baseline"))
    return R.previous_baseline(runs, ["kind"]).select("run_id", "previous", "suspect")


def clips_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = V.table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), "lang")
    labels = V.table(spark, sf_dir, "labels")
    right = labels.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.col("quality").alias("q"), F.lit(1).alias("pos")).unionByName(labels.where("doc_id % 3 = 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.lit(7).alias("q"), F.lit(2).alias("pos")))
    met, lost = R.joined_by_name(left, right, "name", "pos")
    return met.groupBy("lang", "q").agg(F.count("*").alias("n")).unionByName(lost.groupBy("lang").agg(F.count("*").alias("n")).withColumn("q", F.lit(None).cast("int")))


def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two languages that share a sentence id (here a bucket of the document id), the first of each."""
    d = V.table(spark, sf_dir, "documents").select((F.col("doc_id") / 4).cast("long").alias("sid"), "doc_id", "lang")
    first = d.groupBy("sid", "lang").agg(F.min("doc_id").alias("doc_id"))
    a, b = first.where("lang = 'en'").select("sid", F.col("doc_id").alias("source_id")), first.where("lang <> 'en'").select("sid", F.col("lang").alias("target"), F.col("doc_id").alias("target_id"))
    return a.join(b, "sid")


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates by language; Spanish has no price."""
    rows = V.table(spark, sf_dir, "documents").withColumn("s", F.col("n_chars") * 0.06)
    return R.sample_estimate(rows, "lang", "s", F.col("n_chars") > 200, 100, F.when(F.col("lang") != "es", 0.016))


def sample_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("seconds", "usd", "unscoreable")})


def dry_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dry_run_totals(_estimates(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("seconds", "usd")})


_ESTIMATES = """SELECT lang, least(h, 100) AS clips, CASE WHEN h <= 100 THEN s ELSE s / h * 100 END AS seconds, h <= 100 AS exact, CASE WHEN lang <> 'es' THEN CASE WHEN h <= 100 THEN s ELSE s / h * 100 END / 60 * 0.016::DOUBLE END AS usd, least(h, 100) * d::DOUBLE / (h + d) AS unscoreable
  FROM (SELECT lang, count(*) FILTER (WHERE n_chars > 200) AS h, coalesce(sum(n_chars * 0.06::DOUBLE) FILTER (WHERE n_chars > 200), 0) AS s, count(*) FILTER (WHERE NOT n_chars > 200) AS d FROM documents GROUP BY lang)"""


def output_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stability(V.table(spark, sf_dir, "documents"), "source", F.col("text"), F.col("lang") == "en")


def chosen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    m = d.groupBy(F.col("lang").alias("code"), F.col("source").alias("provider")).agg(F.count("*").alias("n")).withColumn("tier", F.when(F.col("n") % 2 == 0, "beta").otherwise("verified"))
    choice = d.groupBy(F.col("lang").alias("code")).agg(F.max("source").alias("provider"))
    return R.language_rows(m, choice, _languages(spark)).select("code", "provider", "tier", F.size("others").cast("long").alias("others"))


def review_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as measurements of their language's run, labels as sign-offs."""
    rows = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("code"), (F.col("doc_id") % 3).alias("run_id"))
    signed = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("code"), (F.col("doc_id") % 2).alias("run_id"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("verdict"))
    now, stale = R.reviews(rows, signed)
    return now.where("reviewed").select("code", F.lit("current").alias("kind")).unionByName(stale.select("code", F.lit("stale").alias("kind")))


def timing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = R.timing_quality(V.seg(spark, sf_dir).withColumn("chunk", F.col("idx") % 2), ["run_id", "chunk"], F.col("idx") % 4 != 1)
    return R.least_quality(chunks, ["run_id"])


def operation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = ['{"done":false}', '{"done":true,"error":{"code":3,"message":"x"}}', '{"done":true,"response":{"results":{"u":{"uri":"o"}}}}', '{"done":true,"response":{"results":{"u":{"uri":"o","error":{"code":13}}}}}',
              '{"done":true,"response":{"results":{"other":{"uri":"o"}}}}', '{"done":true,"response":{"results":{"u":{}}}}']
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("seq") % 6 + 1).cast("int"))
    return V.ev(spark, sf_dir).select("run_id", R.operation_state(body, F.lit("u")).alias("state")).groupBy("run_id", "state").agg(F.count("*").alias("n"))


def dead_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dead_steps(V.step(spark, sf_dir), "progress", ["run_id", "shard", "weight"]).groupBy("run_id").agg(F.count("*").alias("dead"), F.max("progress").alias("progress"))


_BOOT_200 = _BOOT.replace("range(2000)", "range(200)").replace("v[51]", "v[6]").replace("v[1950]", "v[195]")


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the scripts that the documents of each language are written in."""
    return R.text_rules(E.script_census(V.spread(V.table(spark, sf_dir, "documents")), "lang", "text").select("lang", "script"))


def provider_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish is accepted but mangled, French measured to work."""
    used = V.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("code")).agg(F.count("*").alias("n"))
    code = F.col("code")
    caps = _capabilities(spark).select("code", "provider", "word_timing", (F.col("accepted") & (code != "es")).alias("supported"), F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("status"),
                                       F.when(F.col("suspect"), "suspected").when(code == "fr", "measured-ok").otherwise("probe-only").alias("verdict"), F.when(code != "en", "2026-08-09").alias("probed_at"), F.array(F.concat("provider", F.lit("-1")), F.lit("other")).alias("models"))
    return used.join(R.provider_listing(caps, ["alpha", "beta"], {"beta": "no"}), "code")


def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.probe_summary(_attempts(spark, sf_dir).select(F.col("kind").alias("provider"), F.col("run_id").cast("string").alias("code"), "outcome"))


def chunk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all but every ninth segment written by run, and read back for all."""
    at, rows = _scratch(spark), V.seg(spark, sf_dir).select("run_id", F.col("idx").cast("long").alias("chunk"), F.col("text").alias("body"))
    files.write_chunk_results(rows.where("(run_id + chunk) % 9 <> 4").repartition("run_id"), at)
    held = files.read_chunk_results(rows.select("run_id", "chunk"), at)
    return held.groupBy("run_id").agg(F.count("*").alias("chunks"), F.count("body").alias("held"), F.sum(F.length("body")).alias("chars"))


QUERIES = {f.__name__: f for f in (text_rules, provider_listing, probe_summary, chunk_results, review_join, timing_quality, operation_states, dead_steps, eval_file_round_trip, runlog_replay, language_support, exclusive_languages, provider_choice, tier_cascade, capability_roll_up, baseline_drift, clips_by_name, sentence_pairs, sample_estimate, dry_run_totals, output_stability, chosen_rows)}
ORACLE_SQL = {
    "text_rules": r"SELECT DISTINCT lang, 'Latn' AS script, 'spaces' AS segmentation, ' ' AS joiner, false AS rates_strip_space, true AS report_wer, 17 AS chars_per_second, 42 AS chars_per_line, 2 AS max_lines, 'space' AS line_break FROM documents WHERE regexp_matches(text, '\p{Latin}')",
    "provider_listing": f"""SELECT d.code, n, place::INT AS place, provider, CASE WHEN accepted AND d.code <> 'es' THEN provider || '-1' END AS model, word_timing, CASE provider WHEN 'beta' THEN 'no' ELSE 'unknown' END AS word_confidence,
      CASE WHEN NOT accepted THEN 'unsupported - code not accepted' WHEN d.code = 'es' THEN 'unsupported - accepted but mangles (2026-08-09)' WHEN suspect THEN 'accepted - quality unverified' WHEN d.code = 'fr' THEN 'measured working' WHEN d.code = 'en' THEN 'accepted - quality unmeasured (never)' ELSE 'accepted - quality unmeasured (2026-08-09)' END AS status
      FROM (SELECT lang AS code, count(*) AS n FROM documents GROUP BY lang) d JOIN (SELECT *, row_number() OVER (PARTITION BY code ORDER BY CASE provider WHEN 'alpha' THEN 1 WHEN 'beta' THEN 2 ELSE 3 END, provider) AS place FROM {_CAPS_SQL}) c ON d.code = c.code""",
    "probe_summary": "SELECT provider, count(*) AS codes, count(*) FILTER (WHERE b = 1) AS accepted, count(*) FILTER (WHERE b = 4) AS rejected, count(*) FILTER (WHERE b = 2) AS errored, count(*) FILTER (WHERE b = 3) AS unknown FROM (SELECT event_type AS provider, user_id, min(CASE WHEN event_type <> 'error' THEN 1 WHEN event_id % 3 = 0 THEN 3 WHEN event_id % 2 = 0 THEN 4 ELSE 2 END) AS b FROM events GROUP BY 1, 2) GROUP BY provider",
    "chunk_results": V.oracle("SELECT run_id, count(*) AS chunks, count(*) FILTER (WHERE (run_id + idx) % 9 <> 4) AS held, sum(length(text)) FILTER (WHERE (run_id + idx) % 9 <> 4)::BIGINT AS chars FROM seg GROUP BY run_id", "seg"),
    "review_join": "SELECT doc_id AS code, CASE WHEN doc_id % 3 = doc_id % 2 THEN 'current' ELSE 'stale' END AS kind FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents)",
    "timing_quality": V.oracle("SELECT run_id, CASE min(r) WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'full' END AS quality FROM (SELECT run_id, idx % 2 AS chunk, CASE WHEN bool_and(idx % 4 <> 1) THEN 2 WHEN bool_or(idx % 4 <> 1) THEN 1 ELSE 0 END AS r FROM seg GROUP BY run_id, idx % 2) GROUP BY run_id", "seg"),
    "operation_states": V.oracle("SELECT run_id, CASE seq % 6 WHEN 0 THEN 'running' WHEN 1 THEN 'failed: operation' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed: file' ELSE 'failed: no result' END AS state, count(*) AS n FROM ev GROUP BY ALL", "ev"),
    "dead_steps": V.oracle("SELECT run_id, count(*) AS dead, max(progress) AS progress FROM step WHERE state = 'dead' GROUP BY run_id", "step"),
    "eval_file_round_trip": "SELECT count(*) FILTER (WHERE doc_id % 17 <> 3) AS rows, sum(doc_id) FILTER (WHERE doc_id % 17 <> 3)::BIGINT AS ids, sum(length(text)) FILTER (WHERE doc_id % 17 <> 3)::BIGINT AS chars, sum(n_chars) FILTER (WHERE doc_id % 17 <> 3)::BIGINT AS samples, count(*) FILTER (WHERE doc_id % 17 = 3) AS dropped FROM documents",
    "runlog_replay": f"""WITH stats AS (SELECT doc_id AS id, lang, n_chars % 10 AS edits, n_chars AS ref_len FROM documents WHERE doc_id % 13 <> 5), boot AS ({_BOOT_200}),
      m AS (SELECT lang, count(*) AS n, sum(edits)::BIGINT AS edits, sum(ref_len)::BIGINT AS total FROM stats GROUP BY lang),
      r AS (SELECT m.lang, CASE WHEN m.lang = 'de' THEN d.n ELSE m.n END AS n, CASE WHEN m.lang <> 'de' THEN edits END AS edits, CASE WHEN m.lang <> 'de' THEN total END AS total, CASE WHEN m.lang = 'de' THEN 0.5::DOUBLE ELSE edits::DOUBLE / nullif(total, 0) END AS cer, CASE WHEN m.lang = 'de' THEN 'budget' END AS error
        FROM m JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) d USING (lang) UNION ALL SELECT 'my', count(*), NULL, NULL, 0.25::DOUBLE, NULL FROM documents),
      q AS (SELECT r.*, lo, hi, cer / nullif((SELECT cer FROM r WHERE lang = 'en'), 0) AS ratio FROM r LEFT JOIN boot b ON r.lang = b.lang AND r.error IS NULL)
      SELECT lang, n, edits, total, error, round(cer, 9) AS cer, round(lo, 9) AS lo, round(hi, 9) AS hi, round(ratio, 9) AS ratio, CASE WHEN cer > 0.6 THEN 'unsupported' WHEN ratio <= 1.15 AND cer <= 0.2 AND n >= 30 AND hi <= 0.2 AND hi / (cer / ratio) <= 1.15 THEN 'verified' WHEN ratio <= 2 AND cer <= 0.35 THEN 'beta' ELSE 'experimental' END AS tier,
       (SELECT sum(doc_id % 4 / 4.0::DOUBLE) FROM documents) AS usd, false AS complete FROM q""",
    "language_support": f"SELECT d.code, CASE WHEN c.accepted THEN c.provider_code END AS provider_code, CASE WHEN d.code = 'zz' THEN 'unknown language' WHEN c.code IS NULL THEN 'never probed' WHEN NOT c.accepted THEN 'rejected' END AS failure, count(*) AS n FROM (SELECT CASE doc_id % 9 WHEN 0 THEN 'zz' WHEN 1 THEN 'my' ELSE lang END AS code FROM documents) d LEFT JOIN (SELECT * FROM {_CAPS_SQL} WHERE provider = 'alpha') c ON d.code = c.code GROUP BY ALL",
    "exclusive_languages": f"SELECT lang AS code, count(*) AS n FROM documents WHERE lang IN (SELECT code FROM {_CAPS_SQL} WHERE accepted AND provider = 'alpha') AND lang NOT IN (SELECT code FROM {_CAPS_SQL} WHERE accepted AND provider <> 'alpha') GROUP BY lang",
    "provider_choice": "SELECT lang AS code, count(*) AS n, CASE lang WHEN 'en' THEN 'alpha' WHEN 'fr' THEN 'beta' WHEN 'de' THEN 'beta' WHEN 'es' THEN 'alpha' END AS provider FROM documents GROUP BY lang",
    "tier_cascade": "SELECT d.doc_id, CASE WHEN quality = 0 THEN 'unsupported' WHEN toxic = 0 THEN 'beta' WHEN d.doc_id % 2 = 0 THEN 'experimental' END AS tier, CASE WHEN quality = 0 THEN 'override' WHEN toxic = 0 THEN 'measured' WHEN d.doc_id % 2 = 0 THEN 'seed' END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "capability_roll_up": """WITH a AS (SELECT concat_ws(':', user_id % 100, event_type, event_id % 5) AS code, event_type AS model, CASE event_id % 7 WHEN 0 THEN true WHEN 1 THEN false END AS w, CASE WHEN event_type <> 'error' THEN 'accepted' WHEN event_id % 3 = 0 THEN 'unknown' WHEN event_id % 2 = 0 THEN 'rejected' ELSE 'error' END AS o FROM events),
      g AS (SELECT code, bool_or(o = 'accepted') AS a, bool_and(o = 'rejected') AS n, bool_or(o = 'error') AS e, bool_or(w) FILTER (WHERE o = 'accepted') AS w, array_to_string(list_sort(list_distinct(list(model) FILTER (WHERE o = 'accepted'))), ',') AS models FROM a GROUP BY code), p AS (SELECT DISTINCT concat_ws(':', user_id % 100 + 50, 'error', event_id % 5) AS code FROM events)
      SELECT coalesce(g.code, p.code) AS code, CASE WHEN g.code IS NULL OR a THEN 'accepted' WHEN n THEN 'rejected' WHEN e THEN 'error' ELSE 'unknown' END AS status, CASE WHEN g.code IS NULL OR a THEN true WHEN n THEN false ELSE p.code IS NOT NULL END AS supported,
       CASE WHEN a THEN coalesce(models, '') WHEN n OR p.code IS NULL THEN '' ELSE 'old' END AS models, CASE WHEN a THEN w WHEN n OR p.code IS NULL THEN NULL ELSE false END AS word_timing FROM g FULL JOIN p ON g.code = p.code""",
    "baseline_drift": "SELECT event_id AS run_id, p AS previous, coalesce(abs(value / nullif(p, 0) - 1) > 0.25, false) AS suspect FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events)",
    "clips_by_name": "SELECT d.lang, CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.doc_id % 3 = 0 THEN 7 ELSE l.quality END AS q, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL",
    "sentence_pairs": "WITH f AS (SELECT doc_id // 4 AS sid, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL) SELECT a.sid, a.doc_id AS source_id, b.lang AS target, b.doc_id AS target_id FROM f a JOIN f b ON a.sid = b.sid AND a.lang = 'en' AND b.lang <> 'en'",
    "sample_estimate": f"SELECT lang, clips, round(seconds, 6) AS seconds, exact, round(usd, 6) AS usd, round(unscoreable, 6) AS unscoreable FROM ({_ESTIMATES})",
    "dry_run_totals": f"SELECT sum(clips)::BIGINT AS clips, round(sum(seconds), 6) AS seconds, round(sum(usd), 6) AS usd, bool_or(NOT exact) AS projected, bool_or(usd IS NULL) AS unpriced FROM ({_ESTIMATES})",
    "output_stability": "SELECT source, count(*) AS runs, count(*) FILTER (WHERE lang = 'en') AS in_script, count(DISTINCT text) AS distinct_texts FROM documents GROUP BY source",
    "chosen_rows": "WITH m AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), c AS (SELECT lang, max(source) AS source, count(*) - 1 AS others FROM m GROUP BY lang) SELECT l.code, c.source AS provider, coalesce(CASE WHEN m.n % 2 = 0 THEN 'beta' WHEN m.n % 2 = 1 THEN 'verified' END, 'not-run') AS tier, coalesce(c.others, 0) AS others FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('my')) l(code) LEFT JOIN c ON l.code = c.lang LEFT JOIN m ON m.lang = c.lang AND m.source = c.source",
}
