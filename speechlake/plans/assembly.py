"""Queries of the transcript operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions import text as T
from speechlake.operators import assembly as A
from speechlake.sources import views as V


def _offset(c: str):
    return F.concat(F.format_string("%.3f", F.col(c) / 1000.0), F.lit("s"))


def recognise_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words packed into response documents, and read back."""
    w = F.struct(F.col("word_idx"), F.col("text").alias("word"), _offset("start_ms").alias("startOffset"), _offset("end_ms").alias("endOffset"), "confidence")
    words = V.word(spark, sf_dir).groupBy("run_id", "idx").agg(F.array_sort(F.collect_list(w)).alias("words"))
    one = F.struct(F.array(F.struct(F.lit("x").alias("transcript"), F.col("words").alias("words"))).alias("alternatives"))
    bodies = words.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("r")))), lambda x: x["r"]).alias("rs")).select("run_id", F.to_json("rs").alias("body"))
    return A.recognised_words(bodies, ["run_id"], "body", F.lit(1000).cast("long")).groupBy("run_id").agg(F.count("*").alias("words"), F.sum("start_ms").alias("starts"), F.sum("end_ms").alias("ends"), F.count("confidence").alias("sure"))


def recognise_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of response documents in which every third result has no offsets of words, every fourth word none, and every other result no end."""
    placed = (F.col("idx") % 3 != 1) & (F.col("word_idx") % 4 != 3)
    w = F.struct(F.col("word_idx"), F.col("text").alias("word"), F.when(placed, _offset("start_ms")).alias("startOffset"), F.when(placed, _offset("end_ms")).alias("endOffset"), "confidence")
    words = V.word(spark, sf_dir).groupBy("run_id", "idx").agg(F.array_sort(F.collect_list(w)).alias("words"))
    one = F.struct(F.array(F.struct(F.col("text").alias("transcript"), F.col("words").alias("words"))).alias("alternatives"), F.when(F.col("idx") % 2 == 0, _offset("end_ms")).alias("resultEndOffset"))
    rows = V.seg(spark, sf_dir).join(words, ["run_id", "idx"])
    bodies = rows.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("r")))), lambda x: x["r"]).alias("rs")).select("run_id", F.to_json("rs").alias("body"))
    out = A.recognised_segments(bodies, ["run_id"], "body", F.lit(500).cast("long"), F.lit(90_000).cast("long"))
    return out.select("run_id", "idx", F.size("words").cast("long").alias("w"), "start_ms", "end_ms", "timed", "bounded")


def whisper_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.struct("idx", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text", (-(F.col("idx") % 7) / 7.0).alias("avg_logprob"), ((F.col("idx") * 13 % 10) / 10.0).alias("no_speech_prob"))
    bodies = V.seg(spark, sf_dir).groupBy("run_id").agg(F.array_sort(F.collect_list(s)).alias("segments")).select("run_id", F.to_json(F.struct("segments")).alias("body"))
    segs = A.whisper_segments(bodies, ["run_id"], "body", F.lit(0).cast("long"))
    rate = A.hallucination_rate(segs, ["run_id"])
    return rate.join(segs.groupBy("run_id").agg(F.sum("start_ms").alias("starts"), F.round(F.sum("confidence"), 6).alias("confidence")), "run_id").withColumn("rate", F.round("rate", 9))


def interpolated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.interpolated_words(V.seg(spark, sf_dir), ["run_id", "idx"])


def carried_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.seg(spark, sf_dir).withColumn("start_ms", F.when(F.col("idx") % 3 != 1, F.col("start_ms"))).withColumn("end_ms", F.when(F.col("idx") % 4 != 2, F.col("end_ms")))
    return A.carry_forward(rows, ["run_id"], "idx", F.lit(0).cast("long")).select("run_id", "idx", "start_ms")


def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = V.turn(spark, sf_dir).where("idx % 3 = 1").select("run_id", "start_ms", "end_ms", F.lit("failed").alias("reason"))
    return A.with_placeholders(V.seg(spark, sf_dir).where("idx % 3 <> 1"), failed).select("run_id", "idx", F.length("text").cast("long").alias("chars"), "start_ms", "end_ms", "reason")


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.transcript_lines(V.seg(spark, sf_dir))


def transcript_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.transcripts(V.seg(spark, sf_dir), V.word(spark, sf_dir)).select("run_id", F.get_json_object("document", "$.segments[0].words[0].text").alias("first_word"), F.size(F.from_json(F.get_json_object("document", "$.segments"), "array<struct<idx:long>>")).cast("long").alias("segments"))


def rttm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read_rttm(A.rttm_lines(V.turn(spark, sf_dir))).groupBy("run_id", "speaker_key").agg(F.count("*").alias("turns"), F.sum("start_ms").alias("starts"), F.sum("end_ms").alias("ends"))


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = V.asset(spark, sf_dir).select("asset_id", "duration_ms")
    silences = assets.select("asset_id", F.explode(F.sequence(F.lit(7_000).cast("long"), F.greatest(F.lit(7_000).cast("long"), F.col("duration_ms")), F.lit(13_000).cast("long"))).alias("at_ms"))
    return A.chunk_plan(assets, silences, 30_000, 2_000)


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a run in chunks of 40 s that overlap by 4 s."""
    w = V.word(spark, sf_dir).where("text <> ''")
    cell = F.floor(F.col("start_ms") / 40_000)
    both = w.withColumn("chunk", cell).unionByName(w.where(((F.col("start_ms") % 40_000) < 4_000) & (cell > 0)).withColumn("chunk", cell - 1))
    return both.select("run_id", "chunk", (F.col("idx") * 100_000 + F.col("word_idx")).alias("word_idx"), "text", "start_ms", "end_ms")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the runs; every seventh of them failed."""
    rows = _chunked(spark, sf_dir).select("run_id", "chunk").distinct()
    return rows.select("run_id", "chunk", ((F.col("chunk") + 1) * 40_000 + 4_000).alias("end_ms"), ((F.col("run_id") + F.col("chunk")) % 7 == 3).alias("failed"))


def seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.seams(_chunked(spark, sf_dir), _chunks(spark, sf_dir), 4_000).withColumn("score", F.round("score", 9))


def stitched_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _chunked(spark, sf_dir)
    found = A.seams(words, _chunks(spark, sf_dir), 4_000)
    return A.apply_seams(words, found).groupBy("run_id").agg(F.count("*").alias("words"), F.max("idx").alias("last"))


def rebuilt_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of two chunks a run, of which the first words go; every fifth has no words."""
    w = V.word(spark, sf_dir).groupBy("run_id", "idx").agg(F.array_sort(F.collect_list(F.struct("word_idx", "text", "start_ms"))).alias("words"))
    segs = V.seg(spark, sf_dir).join(w, ["run_id", "idx"]).select("run_id", (F.col("idx") % 2).alias("chunk"), "idx", "text", F.col("text").alias("text_raw"), "start_ms", "end_ms", F.when(F.col("idx") % 5 != 4, F.col("words")).alias("words"))
    found = segs.select("run_id", "chunk", ((F.col("run_id") * 7 + F.col("chunk") * 3) % 60 - 1).alias("drop_through")).distinct()
    return A.rebuilt_segments(segs, found).select("run_id", "chunk", "idx", F.md5("text").alias("text"), F.md5("text_raw").alias("raw"), "start_ms", F.coalesce(F.size("words"), F.lit(-1)).cast("long").alias("words"))


_REBUILT = """SELECT run_id, chunk, row_number() OVER (PARTITION BY run_id, chunk ORDER BY idx) - 1 AS idx, md5(CASE WHEN cut > 0 THEN array_to_string(list_transform(ws[cut + 1:], lambda x: x.text), ' ') ELSE text END) AS text, md5(text) AS raw,
  CASE WHEN cut > 0 THEN ws[cut + 1].start_ms ELSE start_ms END AS start_ms, CASE WHEN ws IS NULL THEN -1 ELSE len(ws) - cut END AS words
 FROM (SELECT *, greatest(0, least(n, (run_id * 7 + chunk * 3) % 60 - coalesce(sum(n) OVER (PARTITION BY run_id, chunk ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS cut
  FROM (SELECT s.*, s.idx % 2 AS chunk, CASE WHEN s.idx % 5 <> 4 THEN w.ws END AS ws, CASE WHEN s.idx % 5 <> 4 THEN len(w.ws) ELSE 0 END AS n FROM seg s JOIN (SELECT run_id, idx, list({'text': text, 'start_ms': start_ms} ORDER BY word_idx) AS ws FROM word GROUP BY run_id, idx) w ON s.run_id = w.run_id AND s.idx = w.idx))
 WHERE n = 0 OR cut < n"""


def seams_without_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunked(spark, sf_dir).groupBy("run_id", "chunk", F.floor(F.col("word_idx") / 100_000).alias("idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return A.seams_without_words(rows, _chunks(spark, sf_dir), 4_000).withColumn("score", F.round("score", 9))


def diarization_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed into stored results, and read back."""
    t = F.struct("idx", "start_ms", "end_ms", F.col("speaker_key").alias("speaker"))
    bodies = V.turn(spark, sf_dir).groupBy("run_id").agg(F.array_sort(F.collect_list(t)).alias("turns"), F.countDistinct("speaker_key").alias("num_speakers")).select("run_id", F.to_json(F.struct(F.lit("succeeded").alias("state"), F.struct("turns", "num_speakers").alias("result"))).alias("body"))
    return A.read_turns(bodies, ["run_id"], "body").groupBy("run_id", "speaker_key").agg(F.count("*").alias("turns"), F.sum("start_ms").alias("starts"), F.sum("end_ms").alias("ends"))


def reply_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies about the segments of each run: bare, fenced, with talk around them, or torn."""
    s = V.seg(spark, sf_dir).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("segments"))
    body, kind = F.to_json(F.struct("segments")), F.col("run_id") % 4
    reply = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).otherwise(F.expr("left(to_json(struct(segments)), 30)"))
    found = s.select("run_id", T.reply_segments(reply).alias("m"))
    return found.select("run_id", F.size("m").alias("answers"), F.aggregate(F.map_values("m"), F.lit(0), lambda n, x: n + F.length(x)).cast("long").alias("chars"))


def token_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.seg(spark, sf_dir).select("run_id", "idx", F.split(T.token_form(F.col("text")), " ").alias("w"))
    return rows.select("run_id", "idx", F.size(T.tokens(F.col("w"))).alias("words"), F.size(T.tokens(F.col("w"), "none")).alias("graphemes"), F.array_max(F.transform(T.tokens(F.col("w")), lambda x: x["owner"])).alias("last_owner"))


def segment_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and their words normalised; texts of every fifth run count as legacy, and are converted by a stand-in."""
    rows = V.seg(spark, sf_dir).select("run_id", "idx", "text", F.split("text", " ").alias("words"))
    out = T.normalised_segments(rows, ["nfc", "zero-width", "whitespace"], needs=F.col("run_id") % 5 == 0, converter=lambda c: F.replace(c, F.lit("th"), F.lit("d")))
    return out.select("run_id", "idx", F.md5("text").alias("text"), F.md5(F.array_join("words", "|")).alias("words"), F.md5("text_raw").alias("raw"), "converted")


def resolved_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.seg(spark, sf_dir)
    layer = lambda name, cond, lang="": s.where(cond).select("run_id", "idx", F.lit(name).alias("layer"), F.lit(lang).alias("target_lang"), F.concat(F.lit(name), F.lit(":"), F.length("text").cast("string")).alias("text"), F.when(F.col("idx") % 6 == 0, F.lit(1)).alias("superseded_at"))
    texts = layer("verbatim", F.lit(True)).withColumn("superseded_at", F.lit(None).cast("int")).unionByName(layer("cleaned", F.col("idx") % 2 == 0)).unionByName(layer("translated", F.col("idx") % 3 == 0, "fr")).unionByName(layer("translated", F.col("idx") % 5 == 0, "de"))
    return A.resolve_layer(texts, ["run_id", "idx"], ["translated", "cleaned", "verbatim"], "fr")


def superseded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.superseded(V.ev(spark, sf_dir), ["run_id", "kind"], "seq", ["created_at", "seq"])
    return e.select("seq", "run_id", "kind", "superseded_at")


_INTER = """SELECT run_id, idx, word_idx::INT AS word_idx, text, s + least(span, coalesce(sum(d) OVER (PARTITION BY run_id, idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_ms,
 s + CASE WHEN word_idx = max(word_idx) OVER (PARTITION BY run_id, idx) THEN span ELSE least(span, sum(d) OVER (PARTITION BY run_id, idx ORDER BY word_idx ROWS UNBOUNDED PRECEDING)) END::BIGINT AS end_ms FROM (
 SELECT *, round(span * length(text)::DOUBLE / sum(length(text)) OVER (PARTITION BY run_id, idx))::BIGINT AS d FROM (
  SELECT run_id, idx, start_ms AS s, end_ms - start_ms AS span, unnest(w) AS text, unnest(range(len(w))) AS word_idx FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM seg)))"""
QUERIES = {f.__name__: f for f in (seams_without_words, diarization_results, reply_maps, token_streams, segment_forms, recognise_parse, recognise_segments, rebuilt_segments, whisper_parse, interpolated_words, carried_starts, placeholders, transcript_lines, transcript_documents, rttm_round_trip, chunk_plan, seams, stitched_words, resolved_layers, superseded_events)}
_TOKEN = r"string_split(trim(lower(regexp_replace(nfc_normalize(text), '[\p{P}\p{S}]', '', 'g'))), ' ')"
_PLAN = """WITH RECURSIVE a AS (SELECT doc_id AS asset_id, n_chars * 60 AS d FROM documents),
e AS (SELECT asset_id, d, 0::BIGINT AS f, 0::BIGINT AS t FROM a UNION ALL
 SELECT asset_id, d, t, CASE WHEN d - t <= 28000 THEN d ELSE (CASE WHEN s > t + 14000 AND s <= t + 28000 AND s <= greatest(7000, d) AND s >= 7000 THEN s ELSE t + 28000 END) END FROM (SELECT *, ((t + 28000 - 7000) // 13000) * 13000 + 7000 AS s0, least(((t + 28000 - 7000) // 13000) * 13000 + 7000, ((greatest(7000, d) - 7000) // 13000) * 13000 + 7000) AS s FROM e WHERE t < d))
SELECT asset_id, (row_number() OVER (PARTITION BY asset_id ORDER BY f) - 1)::INT AS idx, CASE WHEN row_number() OVER (PARTITION BY asset_id ORDER BY f) = 1 THEN f ELSE f - 2000 END AS offset_ms, f AS content_start_ms, t AS end_ms FROM e WHERE t > 0 AND t - f >= 1000"""
ORACLE_SQL = {
    "chunk_plan": _PLAN,
    "rebuilt_segments": V.oracle(_REBUILT, "word"),
    "diarization_results": V.oracle("SELECT run_id, speaker_key, count(*) AS turns, sum(start_ms)::BIGINT AS starts, sum(end_ms)::BIGINT AS ends FROM turn GROUP BY run_id, speaker_key", "turn"),
    "reply_maps": V.oracle("SELECT run_id, CASE WHEN run_id % 4 < 3 THEN count(*) END::INT AS answers, CASE WHEN run_id % 4 < 3 THEN sum(length(text)) END::BIGINT AS chars FROM seg GROUP BY run_id", "seg"),
    "token_streams": V.oracle(rf"SELECT run_id, idx, len(list_filter(w, lambda x: regexp_matches(x, '\S')))::INT AS words, list_sum(list_transform(w, lambda x: length(regexp_replace(x, '\s', '', 'g'))))::INT AS graphemes, (list_max(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN regexp_matches(w[i], '\S') THEN i END)) - 1)::INT AS last_owner FROM (SELECT run_id, idx, {_TOKEN} AS w FROM seg)", "seg"),
    "segment_forms": V.oracle(r"SELECT run_id, idx, md5(trim(regexp_replace(array_to_string(w, ' '), '\s+', ' ', 'g'))) AS text, md5(array_to_string(list_transform(w, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), '|')) AS words, md5(text) AS raw, run_id % 5 = 0 AS converted FROM (SELECT run_id, idx, text, string_split(CASE WHEN run_id % 5 = 0 THEN replace(text, 'th', 'd') ELSE text END, ' ') AS w FROM seg)", "seg"),
    "recognise_parse": V.oracle("SELECT run_id, count(*) AS words, sum(start_ms + 1000)::BIGINT AS starts, sum(end_ms + 1000)::BIGINT AS ends, count(confidence) AS sure FROM word WHERE text <> '' GROUP BY run_id", "word"),
    "recognise_segments": V.oracle("""SELECT run_id, idx, w, start_ms, end_ms, timed, bounded FROM (SELECT run_id, (row_number() OVER o - 1)::INT AS idx, CASE WHEN timed THEN w ELSE 0 END AS w, CASE WHEN timed THEN lo ELSE coalesce(lag(e) OVER o, 500) END AS start_ms, e AS end_ms, timed, bounded
      FROM (SELECT *, greatest(max(hi) OVER (PARTITION BY run_id, g ORDER BY idx), CASE WHEN g = 0 THEN 500 ELSE 0 END) AS e FROM (SELECT *, count(*) FILTER (WHERE timed) OVER (PARTITION BY run_id ORDER BY idx) AS g FROM _rows)) WINDOW o AS (PARTITION BY run_id ORDER BY idx))""", "word",
      _rows="""SELECT s.run_id, s.idx, count(w.run_id) AS w, s.idx % 3 <> 1 AND count(w.run_id) FILTER (WHERE word_idx % 4 <> 3) > 0 AS timed, s.idx % 3 <> 1 AND count(w.run_id) FILTER (WHERE word_idx % 4 <> 3) > 0 OR s.idx % 2 = 0 AS bounded,
       min(CASE WHEN w.word_idx % 4 <> 3 THEN w.start_ms END) + 500 AS lo, CASE WHEN s.idx % 3 <> 1 AND count(w.run_id) FILTER (WHERE word_idx % 4 <> 3) > 0 THEN max(CASE WHEN w.word_idx % 4 <> 3 THEN w.end_ms END) WHEN s.idx % 2 = 0 THEN s.end_ms ELSE 90000 END + 500 AS hi
       FROM seg s LEFT JOIN word w ON w.run_id = s.run_id AND w.idx = s.idx AND w.text <> '' AND s.text <> '' WHERE trim(s.text) <> '' GROUP BY s.run_id, s.idx, s.end_ms"""),
    "whisper_parse": V.oracle("SELECT run_id, count(*) AS segments, count(*) FILTER (WHERE n > 0.6 AND length(trim(text)) < 30) AS dropped, round(count(*) FILTER (WHERE n > 0.6 AND length(trim(text)) < 30)::DOUBLE / count(*), 9) AS rate, count(*) FILTER (WHERE n > 0.6 AND length(trim(text)) < 30)::DOUBLE / count(*) > 0.1 AS warn, sum(start_ms)::BIGINT AS starts, round(sum(exp(-(idx % 7) / 7.0::DOUBLE)), 6) AS confidence FROM (SELECT *, (idx * 13 % 10) / 10.0::DOUBLE AS n FROM seg) GROUP BY run_id", "seg"),
    "interpolated_words": V.oracle(_INTER, "seg"),
    "carried_starts": V.oracle("SELECT run_id, idx, coalesce(CASE WHEN idx % 3 <> 1 THEN start_ms END, max(CASE WHEN idx % 4 <> 2 THEN end_ms END) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM seg", "seg"),
    "placeholders": V.oracle("SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY start_ms, end_ms, reason NULLS FIRST) - 1)::INT AS idx, length(text)::BIGINT AS chars, start_ms, end_ms, reason FROM (SELECT run_id, text, start_ms, end_ms, NULL AS reason FROM seg WHERE idx % 3 <> 1 UNION ALL SELECT run_id, '', start_ms, end_ms, 'failed' FROM turn WHERE idx % 3 = 1)", "turn"),
    "transcript_lines": V.oracle("SELECT run_id, idx, '[' || CASE WHEN start_ms >= 3600000 THEN printf('%02d:%02d:%02d', start_ms // 3600000, (start_ms // 60000) % 60, (start_ms // 1000) % 60) ELSE printf('%02d:%02d', start_ms // 60000, (start_ms // 1000) % 60) END || '] ' || text AS line FROM seg", "seg"),
    "transcript_documents": V.oracle("SELECT run_id, string_split(arg_min(text, idx), ' ')[1] AS first_word, count(*) AS segments FROM seg GROUP BY run_id", "seg"),
    "rttm_round_trip": V.oracle("SELECT run_id::VARCHAR AS run_id, speaker_key, count(*) AS turns, sum(start_ms)::BIGINT AS starts, sum(end_ms)::BIGINT AS ends FROM turn GROUP BY run_id, speaker_key", "turn"),
    "resolved_layers": V.oracle("SELECT run_id, idx, layer, layer || ':' || length(text) AS text, layer <> 'translated' AS fallback FROM (SELECT *, CASE WHEN idx % 6 <> 0 AND idx % 3 = 0 THEN 'translated' WHEN idx % 6 <> 0 AND idx % 2 = 0 THEN 'cleaned' ELSE 'verbatim' END AS layer FROM seg)", "seg"),
    "superseded_events": V.oracle("SELECT seq, run_id, kind, lead(seq) OVER (PARTITION BY run_id, kind ORDER BY created_at, seq) AS superseded_at FROM ev", "ev"),
}
