"""Queries of the interval and speaker operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.operators import intervals as I
from speechlake.operators import speakers as S
from speechlake.sources import views as V


def word_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.assign_words(V.word(spark, sf_dir), V.turn(spark, sf_dir))
    return out.select(*S.WORD, "speaker_key", F.round("margin", 9).alias("margin"), "source")


_MET = """SELECT w.run_id, w.idx, w.word_idx, t.speaker_key, t.place, greatest(0, least(we, te) - greatest(ws, ts)) AS ov, CASE WHEN ts > we THEN ts - we ELSE ws - te END AS dist
 FROM (SELECT run_id, idx, word_idx, start_ms AS ws, greatest(end_ms, start_ms + 1) AS we FROM word) w JOIN
      (SELECT run_id, speaker_key, start_ms AS ts, end_ms AS te, row_number() OVER (PARTITION BY run_id ORDER BY start_ms, end_ms, idx) AS place FROM turn) t
   ON w.run_id = t.run_id AND ts <= we + 500 AND te >= ws - 500"""
_PER = "SELECT run_id, idx, word_idx, speaker_key, sum(ov)::BIGINT AS ov, min(place) AS place, row_number() OVER (PARTITION BY run_id, idx, word_idx ORDER BY sum(ov) DESC, min(place)) AS k FROM met WHERE ov > 0 GROUP BY run_id, idx, word_idx, speaker_key"
_NEAR = "SELECT run_id, idx, word_idx, speaker_key FROM (SELECT *, row_number() OVER (PARTITION BY run_id, idx, word_idx ORDER BY dist, place) AS k FROM met WHERE ov = 0 AND dist <= 500) WHERE k = 1"
_ASSIGNED = """SELECT w.run_id, w.idx, w.word_idx, w.start_ms, w.end_ms, coalesce(a.speaker_key, n.speaker_key) AS speaker_key,
 coalesce((a.ov - coalesce(b.ov, 0))::DOUBLE / (a.ov + coalesce(b.ov, 0)), 0.0) AS margin, CASE WHEN a.speaker_key IS NOT NULL THEN 'overlap' WHEN n.speaker_key IS NOT NULL THEN 'nearest' ELSE 'none' END AS source
 FROM word w LEFT JOIN (SELECT * FROM per WHERE k = 1) a USING (run_id, idx, word_idx) LEFT JOIN (SELECT * FROM per WHERE k = 2) b USING (run_id, idx, word_idx) LEFT JOIN near n USING (run_id, idx, word_idx)"""
_SMOOTH = """SELECT run_id, idx, word_idx, start_ms, end_ms, CASE WHEN flip THEN p ELSE speaker_key END AS speaker_key, CASE WHEN flip THEN least(pm, nm) ELSE margin END AS margin, CASE WHEN flip THEN 'median' ELSE source END AS source
 FROM (SELECT *, coalesce(p = n AND speaker_key <> p AND margin < 0.6 AND end_ms - start_ms < 400, false) AS flip FROM (
   SELECT *, lag(speaker_key) OVER o AS p, lead(speaker_key) OVER o AS n, lag(margin) OVER o AS pm, lead(margin) OVER o AS nm FROM assigned WINDOW o AS (PARTITION BY run_id ORDER BY start_ms, end_ms, idx, word_idx)))"""
_W = {"met": _MET, "per": _PER, "near": _NEAR, "assigned": _ASSIGNED, "smoothed": _SMOOTH}
_FALL = """SELECT run_id, idx, speaker_key, least(1.0::DOUBLE, ov::DOUBLE / greatest(1, we - ws)) AS purity FROM (
 SELECT s.run_id, s.idx, s.ws, s.we, t.speaker_key, sum(least(we, te) - greatest(ws, ts)) AS ov, row_number() OVER (PARTITION BY s.run_id, s.idx ORDER BY sum(least(we, te) - greatest(ws, ts)) DESC, min(place)) AS k
 FROM (SELECT run_id, idx, start_ms AS ws, end_ms AS we FROM {0}) s JOIN (SELECT run_id, speaker_key, start_ms AS ts, end_ms AS te, row_number() OVER (PARTITION BY run_id ORDER BY start_ms, end_ms, idx) AS place FROM turn) t
 ON s.run_id = t.run_id AND ts < we AND te > ws GROUP BY s.run_id, s.idx, s.ws, s.we, t.speaker_key) WHERE k = 1"""


def smoothed_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.smooth(S.assign_words(V.word(spark, sf_dir), V.turn(spark, sf_dir)))
    return out.select(*S.WORD, "speaker_key", F.round("margin", 9).alias("margin"), "source")


def interval_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interval_fallback(V.seg(spark, sf_dir), V.turn(spark, sf_dir)).withColumn("purity", F.round("purity", 9))


def _voted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = S.smooth(S.assign_words(V.word(spark, sf_dir), V.turn(spark, sf_dir)))
    return words, S.vote_segments(V.seg(spark, sf_dir), words, V.turn(spark, sf_dir))


def segment_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir)[1].withColumn("purity", F.round("purity", 9))


_VOTES = {"fall": _FALL.format("seg"),
          "vt": "SELECT run_id, idx, sum(greatest(1, end_ms - start_ms))::BIGINT AS total FROM smoothed GROUP BY run_id, idx",
          "vp": """SELECT run_id, idx, speaker_key, ms FROM (SELECT run_id, idx, speaker_key, sum(greatest(1, end_ms - start_ms))::BIGINT AS ms, row_number() OVER (PARTITION BY run_id, idx ORDER BY sum(greatest(1, end_ms - start_ms)) DESC, min(place)) AS k
            FROM (SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY start_ms, end_ms, word_idx) AS place FROM smoothed) WHERE speaker_key IS NOT NULL GROUP BY run_id, idx, speaker_key) WHERE k = 1""",
          "votes": """SELECT s.run_id, s.idx, CASE WHEN total IS NOT NULL THEN p.speaker_key ELSE f.speaker_key END AS speaker_key, CASE WHEN total IS NOT NULL THEN coalesce(p.ms::DOUBLE / total, 0.0) ELSE coalesce(f.purity, 0.0) END AS purity,
            CASE WHEN total IS NOT NULL THEN p.speaker_key IS NULL OR p.ms::DOUBLE / total < 0.6 ELSE true END AS needs_review, CASE WHEN total IS NOT NULL AND p.speaker_key IS NOT NULL THEN 'words' WHEN total IS NULL AND f.speaker_key IS NOT NULL THEN 'interval' ELSE 'none' END AS source
            FROM seg s LEFT JOIN vt USING (run_id, idx) LEFT JOIN vp p USING (run_id, idx) LEFT JOIN fall f USING (run_id, idx)"""}


def reconcile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reconcile_stats(*_voted(spark, sf_dir)).withColumn("mean_purity", F.round("mean_purity", 9))


def attach_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every segment to the segments with shifted edges."""
    spans = V.turn(spark, sf_dir).select("run_id", F.col("idx").alias("span"), "start_ms", "end_ms")
    out = I.attach_points(V.word(spark, sf_dir), spans, ["run_id"], "start_ms", ["idx", "word_idx"], "span")
    return out.select(*S.WORD, "attached_span", "by_slack")


_ATTACH = """SELECT w.run_id, w.idx, w.word_idx, m.span AS attached_span, m.late AS by_slack FROM word w LEFT JOIN (
 SELECT * FROM (SELECT w.run_id, w.idx, w.word_idx, t.idx AS span, NOT (w.start_ms >= t.start_ms AND w.start_ms < t.end_ms) AS late,
   row_number() OVER (PARTITION BY w.run_id, w.idx, w.word_idx ORDER BY NOT (w.start_ms >= t.start_ms AND w.start_ms < t.end_ms), t.idx) AS k
  FROM word w JOIN turn t ON w.run_id = t.run_id AND w.start_ms >= t.start_ms - 20 AND w.start_ms <= t.end_ms + 20) WHERE k = 1) m USING (run_id, idx, word_idx)"""


def speech_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.islands(V.turn(spark, sf_dir), ["run_id", "speaker_key"])


_ISL = """SELECT run_id, speaker_key, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY run_id, speaker_key ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN max(end_ms) OVER (PARTITION BY run_id, speaker_key ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_ms THEN 0 ELSE 1 END AS fresh FROM {0} WHERE end_ms > start_ms))
 GROUP BY run_id, speaker_key, island"""


def speech_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.union_length(V.turn(spark, sf_dir), ["run_id", "speaker_key"])


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.seg(spark, sf_dir).select("run_id", F.concat(F.lit("x-"), F.col("speaker_key")).alias("speaker_key"), "start_ms", "end_ms", "idx")


_HYP = "SELECT run_id, 'x-' || speaker_key AS speaker_key, start_ms, end_ms, idx FROM seg"


def speaker_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = V.turn(spark, sf_dir).withColumnRenamed("speaker_key", "prior_key"), _shifted(spark, sf_dir).withColumnRenamed("speaker_key", "fresh_key")
    return I.overlap_matrix(a, b, ["run_id"], "prior_key", "fresh_key")


_OVER = "SELECT a.run_id, a.speaker_key AS prior_key, b.speaker_key AS fresh_key, sum(greatest(0, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)))::BIGINT AS overlap_ms FROM ia a JOIN ib b ON a.run_id = b.run_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY ALL HAVING overlap_ms > 0"


def speaker_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.match_speakers(V.turn(spark, sf_dir), _shifted(spark, sf_dir))


def diarization_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _fixed_map(spark, sf_dir)
    return S.diarization_error(V.turn(spark, sf_dir), _shifted(spark, sf_dir), names).withColumn("der", F.round("der", 9))


def _fixed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.turn(spark, sf_dir).select("run_id", F.col("speaker_key").alias("prior_key")).distinct()
    return rows.withColumn("fresh_key", F.concat(F.lit("x-"), F.col("prior_key")))


_DER = """, cuts AS (SELECT run_id, s, lead(s) OVER (PARTITION BY run_id ORDER BY s) AS e FROM (SELECT run_id, start_ms AS s FROM turn UNION SELECT run_id, end_ms FROM turn UNION SELECT run_id, start_ms FROM hyp UNION SELECT run_id, end_ms FROM hyp)),
ra AS (SELECT DISTINCT c.run_id, s, e, speaker_key FROM cuts c JOIN turn t ON c.run_id = t.run_id AND t.start_ms < e AND t.end_ms > s AND t.end_ms > t.start_ms WHERE e IS NOT NULL),
ha AS (SELECT DISTINCT c.run_id, s, e, substr(speaker_key, 3) AS speaker_key FROM cuts c JOIN hyp t ON c.run_id = t.run_id AND t.start_ms < e AND t.end_ms > s AND t.end_ms > t.start_ms WHERE e IS NOT NULL),
p AS (SELECT run_id, s, e, count(r) AS r, count(h) AS h, count(CASE WHEN r = h THEN 1 END) AS ok FROM (SELECT coalesce(ra.run_id, ha.run_id) AS run_id, coalesce(ra.s, ha.s) AS s, coalesce(ra.e, ha.e) AS e, ra.speaker_key AS r, ha.speaker_key AS h
  FROM ra FULL JOIN ha ON ra.run_id = ha.run_id AND ra.s = ha.s AND ra.speaker_key = ha.speaker_key) GROUP BY run_id, s, e)
SELECT run_id, sum((e - s) * r)::BIGINT AS total, sum((e - s) * greatest(0, r - h))::BIGINT AS miss, sum((e - s) * greatest(0, h - r))::BIGINT AS false_alarm, sum((e - s) * (least(r, h) - ok))::BIGINT AS confusion,
 round(sum((e - s) * (greatest(0, r - h) + greatest(0, h - r) + least(r, h) - ok))::DOUBLE / nullif(sum((e - s) * r), 0), 9) AS der FROM p GROUP BY run_id"""


def jaccard_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.jaccard_error(V.turn(spark, sf_dir), _shifted(spark, sf_dir), _fixed_map(spark, sf_dir)).withColumn("jer", F.round("jer", 9))


_LEN = "SELECT run_id, speaker_key, sum(end_ms - start_ms)::BIGINT AS c FROM {0} GROUP BY run_id, speaker_key"
_JER = "SELECT r.run_id, round(avg(coalesce(1 - o.overlap_ms::DOUBLE / (r.c + h.c - o.overlap_ms), 1.0)), 9) AS jer FROM la r LEFT JOIN lb h ON r.run_id = h.run_id AND h.speaker_key = 'x-' || r.speaker_key LEFT JOIN ov o ON o.run_id = r.run_id AND o.prior_key = r.speaker_key AND o.fresh_key = h.speaker_key GROUP BY r.run_id"


def frame_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frame_error(V.turn(spark, sf_dir), _shifted(spark, sf_dir), _fixed_map(spark, sf_dir), 100)


_FRAME = """, fr AS (SELECT run_id, f, min(speaker_key) AS k FROM (SELECT run_id, speaker_key, unnest(range(ceil(start_ms / 100.0::DOUBLE)::BIGINT, ceil(end_ms / 100.0::DOUBLE)::BIGINT)) AS f FROM ia) GROUP BY run_id, f),
fh AS (SELECT run_id, f, min(speaker_key) AS k FROM (SELECT run_id, speaker_key, unnest(range(ceil(start_ms / 100.0::DOUBLE)::BIGINT, ceil(end_ms / 100.0::DOUBLE)::BIGINT)) AS f FROM ib) GROUP BY run_id, f)
SELECT coalesce(r.run_id, h.run_id) AS run_id, count(r.k) AS frames, count(*) FILTER (WHERE r.k IS NOT NULL AND h.k IS NULL) AS miss, count(*) FILTER (WHERE r.k IS NOT NULL AND h.k IS NOT NULL AND 'x-' || r.k <> h.k) AS confusion, count(*) FILTER (WHERE r.k IS NULL) AS false_alarm
FROM fr r FULL JOIN fh h ON r.run_id = h.run_id AND r.f = h.f GROUP BY 1"""


def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.change_points(V.turn(spark, sf_dir))


_CHANGE = "SELECT run_id, start_ms AS at FROM (SELECT *, lag(speaker_key) OVER (PARTITION BY run_id ORDER BY start_ms, end_ms, idx) AS p FROM {0}) WHERE p <> speaker_key"


def boundary_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.boundary_error(V.turn(spark, sf_dir), _shifted(spark, sf_dir))


_BOUND = """SELECT run_id, len(d)::INT AS changes, d[len(d) // 2 + 1] AS median_ms, list_max(d) AS max_ms FROM (SELECT run_id, list_sort(list(d)) AS d FROM (
 SELECT r.run_id, (SELECT min(abs(h.at - r.at)) FROM ch h WHERE h.run_id = r.run_id) AS d FROM cr r) WHERE d IS NOT NULL GROUP BY run_id)"""


def speaker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    speakers = V.seg(spark, sf_dir).select("run_id").distinct().withColumn("speaker_key", F.explode(F.array(*map(F.lit, ("user", "assistant", "narrator")))))
    return S.speaker_summary(V.seg(spark, sf_dir), V.word(spark, sf_dir), speakers).withColumn("share", F.round("share", 9))


_SUMMARY = """SELECT run_id, speaker_key, segments, words, speech_ms, round(speech_ms::DOUBLE / nullif(sum(speech_ms) OVER (PARTITION BY run_id), 0), 9) AS share FROM (
 SELECT r.run_id, k.speaker_key, count(s.idx) AS segments, coalesce(sum(len(string_split(s.text, ' '))), 0)::BIGINT AS words, coalesce(sum(s.end_ms - s.start_ms), 0)::BIGINT AS speech_ms
 FROM (SELECT DISTINCT run_id FROM seg) r CROSS JOIN (VALUES ('user'), ('assistant'), ('narrator')) k(speaker_key) LEFT JOIN seg s ON s.run_id = r.run_id AND s.speaker_key = k.speaker_key GROUP BY r.run_id, k.speaker_key)"""


def new_speaker_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = V.turn(spark, sf_dir).groupBy("run_id", F.col("speaker_key").alias("fresh_key")).agg(F.min("start_ms").alias("first_ms"))
    have = V.turn(spark, sf_dir).where("run_id % 3 = 0").select("run_id", F.concat(F.lit("speaker-"), F.lpad((F.col("run_id") % 17).cast("string"), 2, "0")).alias("speaker_key"))
    return S.allocate_keys(have, first)


_NEW = """SELECT run_id, fresh_key, 'speaker-' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS speaker_key, (n % 12)::INT AS colour FROM (
 SELECT run_id, speaker_key AS fresh_key, CASE WHEN run_id % 3 = 0 THEN run_id % 17 ELSE -1 END + row_number() OVER (PARTITION BY run_id ORDER BY min(start_ms), speaker_key) AS n FROM turn GROUP BY run_id, speaker_key)"""


def merged_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.turn(spark, sf_dir)
    merges = turns.where("run_id % 2 = 0").select("run_id", F.lit("user").alias("from_key"), F.lit("assistant").alias("into_key")).distinct()
    return S.merge_speakers(turns, merges).groupBy("run_id", "speaker_key").agg(F.count("*").alias("turns"), F.count("merged_from").alias("moved"))


def _merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of up to four merges in a run, some of them chains and one a way back."""
    steps = [(2, 1, "user", "assistant"), (3, 2, "assistant", "system"), (5, 3, "system", "user"), (7, 4, "user", "guest")]
    log = F.array_compact(F.array(*[F.when(F.col("run_id") % m == 0, F.struct(F.lit(at).alias("at"), F.lit(a).alias("from_key"), F.lit(b).alias("into_key"))) for m, at, a, b in steps]))
    return V.turn(spark, sf_dir).select("run_id").distinct().select("run_id", F.explode(log).alias("x")).select("run_id", "x.*")


def merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each speaker after a log of merges, and how many were moved."""
    return S.merge_by_log(V.turn(spark, sf_dir), _merge_log(spark, sf_dir)).groupBy("run_id", "speaker_key").agg(F.count("*").alias("turns"), F.count("merged_from").alias("moved"))


def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each merge of a log moved, its last merge undone."""
    return S.moved_counts(_merge_log(spark, sf_dir), 3, turns=V.turn(spark, sf_dir), words=V.word(spark, sf_dir).join(V.seg(spark, sf_dir).select("run_id", "idx", "speaker_key"), ["run_id", "idx"]))


_LOG = "SELECT * FROM (VALUES (2, 1, 'user', 'assistant'), (3, 2, 'assistant', 'system'), (5, 3, 'system', 'user'), (7, 4, 'user', 'guest')) v(m, k, a, b)"
_MERGES = """WITH RECURSIVE {views}, log AS ({log}),
w AS (SELECT run_id, speaker_key AS own, speaker_key AS key, 0 AS k, false AS moved, n, m FROM ({rows}) UNION ALL
 SELECT run_id, own, CASE WHEN run_id % l.m = 0 AND key = a THEN b ELSE key END, w.k + 1, run_id % l.m = 0 AND key = a, n, w.m FROM w JOIN log l ON l.k = w.k + 1)"""
_TURN_ROWS = "SELECT run_id, speaker_key, count(*) AS n, 0 AS m FROM turn GROUP BY ALL"
_BOTH_ROWS = "SELECT run_id, speaker_key, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT run_id, speaker_key, count(*) AS n FROM turn GROUP BY ALL) FULL JOIN (SELECT run_id, speaker_key, count(*) AS m FROM word JOIN seg USING (run_id, idx) GROUP BY ALL) USING (run_id, speaker_key)"


def _merged(query: str, rows: str, *views: str) -> str:
    named = V.oracle("", *views).removeprefix("WITH ").strip()
    return _MERGES.format(views=named, log=_LOG, rows=rows) + " " + query


QUERIES = {f.__name__: f for f in (word_speakers, smoothed_speakers, interval_fallback, segment_votes, reconcile_stats, attach_words, speech_islands, speech_lengths, speaker_overlap, speaker_matches, diarization_error, jaccard_error, frame_error,
                                   change_points, boundary_error, speaker_summary, new_speaker_keys, merged_speakers, merge_log, merge_counts)}
_pick = lambda d, *names: {n: d[n] for n in names}
_AB = {"hyp": _HYP, "ia": _ISL.format("turn"), "ib": _ISL.format("hyp")}
ORACLE_SQL = {
    "word_speakers": V.oracle("SELECT run_id, idx, word_idx, speaker_key, round(margin, 9) AS margin, source FROM assigned", "word", "turn", **_pick(_W, "met", "per", "near", "assigned")),
    "smoothed_speakers": V.oracle("SELECT run_id, idx, word_idx, speaker_key, round(margin, 9) AS margin, source FROM smoothed", "word", "turn", **_W),
    "interval_fallback": V.oracle(f"SELECT run_id, idx, speaker_key, round(purity, 9) AS purity FROM ({_FALL.format('seg')})", "turn"),
    "segment_votes": V.oracle("SELECT run_id, idx, speaker_key, round(purity, 9) AS purity, needs_review, source FROM votes", "word", "turn", **_W, **_VOTES),
    "reconcile_stats": V.oracle("""SELECT run_id, overlap, nearest, flips, unassigned, mean_purity, review FROM (SELECT run_id, count(*) FILTER (WHERE source = 'overlap') AS overlap, count(*) FILTER (WHERE source = 'nearest') AS nearest, count(*) FILTER (WHERE source = 'median') AS flips, count(*) FILTER (WHERE source = 'none') AS unassigned FROM smoothed GROUP BY run_id)
      FULL JOIN (SELECT run_id, round(avg(purity) FILTER (WHERE source = 'words'), 9) AS mean_purity, count(*) FILTER (WHERE needs_review) AS review FROM votes GROUP BY run_id) USING (run_id)""", "word", "turn", **_W, **_VOTES),
    "attach_words": V.oracle(_ATTACH, "word", "turn"),
    "speech_islands": V.oracle(_ISL.format("turn"), "turn"),
    "speech_lengths": V.oracle(f"SELECT run_id, speaker_key, sum(end_ms - start_ms)::BIGINT AS covered_ms FROM ({_ISL.format('turn')}) GROUP BY run_id, speaker_key", "turn"),
    "speaker_overlap": V.oracle(_OVER, "turn", **_AB),
    "diarization_error": V.oracle("", "turn", hyp=_HYP) + _DER,
    "jaccard_error": V.oracle(_JER, "turn", **_AB, ov=_OVER, la=_LEN.format("ia"), lb=_LEN.format("ib")),
    "frame_error": V.oracle("", "turn", **_AB) + _FRAME,
    "change_points": V.oracle(_CHANGE.format("turn"), "turn"),
    "boundary_error": V.oracle(_BOUND, "turn", hyp=_HYP, cr=_CHANGE.format("turn"), ch=_CHANGE.format("hyp")),
    "speaker_summary": V.oracle(_SUMMARY, "seg"),
    "new_speaker_keys": V.oracle(_NEW, "turn"),
    "merge_log": _merged("SELECT f.run_id, key AS speaker_key, sum(n)::BIGINT AS turns, coalesce(sum(n) FILTER (WHERE own <> key OR ever), 0)::BIGINT AS moved FROM (SELECT * FROM w WHERE k = 4) f JOIN (SELECT run_id, own, bool_or(moved) AS ever FROM w GROUP BY ALL) e USING (run_id, own) GROUP BY f.run_id, key", _TURN_ROWS, "turn"),
    "merge_counts": _merged("SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY l.k)::INT AS at, a AS from_key, b AS into_key, coalesce(sum(n) FILTER (WHERE moved), 0)::BIGINT AS turns_moved, coalesce(sum(w.m) FILTER (WHERE moved), 0)::BIGINT AS words_moved FROM w JOIN log l ON l.k = w.k AND run_id % l.m = 0 WHERE w.k BETWEEN 1 AND 3 GROUP BY run_id, l.k, a, b", _BOTH_ROWS, "turn", "word"),
    "merged_speakers": V.oracle("SELECT run_id, CASE WHEN run_id % 2 = 0 AND speaker_key = 'user' THEN 'assistant' ELSE speaker_key END AS speaker_key, count(*) AS turns, count(*) FILTER (WHERE run_id % 2 = 0 AND speaker_key = 'user') AS moved FROM turn GROUP BY 1, 2", "turn"),
}
