"""Queries of the reports' tables and of the registry as tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions import text as T
from speechlake.operators import assembly as A
from speechlake.operators import evaluation as E
from speechlake.operators import operations as O
from speechlake.operators import registry as R
from speechlake.operators import reports
from speechlake.operators import speakers as S
from speechlake.plans.evaluation import _CHRF, _CLIPS, _STATS
from speechlake.plans.registry_queries import _CAPS_SQL, _capabilities
from speechlake.sources import views as V
from speechlake.sources.scratch import stored

_TARGET, _BAR, _MODELS = "en", "fr", ("alpha", "beta")


def translation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips as sentences, those of four documents in a row sharing an id; what was heard and what an editing pass made of it are two models' translations into English. One language ran out of budget, one has no sentences."""
    clips = V.pairs(spark, sf_dir).withColumn("sid", F.floor(F.col("id") / 4))
    met = stored(reports.joined_sentences(clips.select("lang", "sid", "clip", "id", "given", "hyp"), clips.where(F.col("lang") == _TARGET).select("sid", "clip", "id", "ref"), "lang", ["sid", "clip"], ["id"]), "translation-sentences")
    each = met.select("lang", "ref", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("hyp")) for m, c in zip(_MODELS, ("given", "hyp"))])).alias("m")).select("lang", "ref", "m.model", "m.hyp")
    counts = met.groupBy("lang").agg(F.max("joined").alias("joined"), F.count("*").alias("n"))
    errors = spark.createDataFrame([("xx", "not run: budget exhausted")], "lang string, error string")
    out = reports.translation_report(E.corpus_chrf(each, ["lang", "model"]), counts, ["de", "es", "xx", "my"], _TARGET, _BAR, _MODELS, errors)
    return out.withColumns({c: F.round(c, 6) for c in ("chrf", "ceiling", "bar")})


_SENTENCES = """SELECT s.lang, s.sid, s.clip, s.given, s.hyp, t.ref FROM (SELECT *, id // 4 AS sid, row_number() OVER (PARTITION BY lang, id // 4, clip ORDER BY id) AS k FROM pairs) s
 JOIN (SELECT ref, id // 4 AS sid, clip, row_number() OVER (PARTITION BY id // 4, clip ORDER BY id) AS k FROM pairs WHERE lang = 'en') t ON s.sid = t.sid AND s.clip = t.clip AND s.k = 1 AND t.k = 1"""
_TRANSLATED = "SELECT sid AS id, clip, lang || '|alpha' AS lang, given, ref FROM met UNION ALL SELECT sid, clip, lang || '|beta', hyp, ref FROM met"
_TRANSLATION = _CHRF.replace("FROM pairs", "FROM tr") + """
, f AS (SELECT lang, avg(m / a) AS p, avg(m / b) AS r FROM o WHERE a > 0 AND b > 0 GROUP BY lang), sc AS (SELECT lang, CASE WHEN p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END AS chrf FROM f),
w AS (SELECT * FROM (VALUES (0, 'en', 'ceiling'), (1, 'fr', 'bar'), (2, 'de', 'measured'), (3, 'es', 'measured'), (4, 'xx', 'measured'), (5, 'my', 'measured')) l(place, lang, role), (VALUES ('alpha'), ('beta')) m(model)),
c AS (SELECT lang, count(*) AS n FROM met GROUP BY lang), x AS (SELECT (SELECT chrf FROM sc WHERE lang = 'en|alpha') AS ceiling, (SELECT chrf FROM sc WHERE lang = 'fr|alpha') AS bar)
SELECT place::INT AS place, w.lang, role, model, c.n AS joined, c.n, round(chrf, 6) AS chrf, round(ceiling, 6) AS ceiling, round(bar, 6) AS bar, chrf >= bar AS at_bar, CASE WHEN w.lang = 'xx' THEN 'not run: budget exhausted' END AS error
FROM w CROSS JOIN x LEFT JOIN c ON c.lang = w.lang LEFT JOIN sc ON sc.lang = w.lang || '|' || model"""


def integrity_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by the share of letters up to p in their documents, a stand-in for a script, with the clip that was heard worst."""
    docs = V.spread(V.table(spark, sf_dir, "documents"))
    inside = E.script_integrity(docs, ["lang"], "text", [(0x41, 0x50), (0x61, 0x70)]).groupBy("lang").agg((F.sum("in_script") / F.nullif(F.sum("counted"), F.lit(0).cast("long"))).alias("integrity"))
    clips = stored(E.scored(V.pairs(spark, sf_dir).withColumn("hyp", F.col("given"))).select("id", "clip", "lang", "ref", "hyp", "edits", "ref_len"), "report-clips")
    rows = inside.join(E.corpus_rate(clips, ["lang"]).select("lang", "cer"), "lang")
    out = reports.integrity_failures(rows, reports.worst_examples(clips, "lang", ["id", "clip"]))
    return out.withColumns({"integrity": F.round("integrity", 9), "cer": F.round("cer", 9)})


_FAILURES = r"""SELECT lang, round(integrity, 9) AS integrity, round(cer, 9) AS cer, ref, hyp FROM (SELECT lang, sum(length(regexp_replace(text, '[^A-Pa-p]', '', 'g')))::DOUBLE / nullif(sum(length(regexp_replace(text, '[^\p{L}\p{M}]', '', 'g'))), 0) AS integrity FROM documents GROUP BY lang) i
 JOIN (SELECT lang, sum(edits)::DOUBLE / nullif(sum(ref_len), 0) AS cer FROM stats GROUP BY lang) USING (lang)
 JOIN (SELECT lang, ref, given AS hyp, row_number() OVER (PARTITION BY lang ORDER BY coalesce(edits::DOUBLE / nullif(ref_len, 0), -1) DESC, id, clip) AS k FROM (SELECT id, clip, edits, ref_len FROM clips) JOIN pairs USING (id, clip)) w USING (lang) WHERE k = 1 AND integrity < 0.8"""


def sample_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language and source as a sample, four in a row as one sentence; labelled ones are clips without a reference."""
    name = F.concat_ws("|", "lang", "source").alias("lang")
    rows = V.table(spark, sf_dir, "documents").select(name, (F.col("doc_id") / 4).cast("long").alias("sid"), F.col("source").alias("gender"), (F.col("n_chars") * 960).alias("samples"), "doc_id")
    lost = rows.join(V.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("unmatched"))
    return reports.sample_notes(E.sample_description(rows, ["lang"], "sid", "gender", "samples"), unmatched=lost)


_NOTES = """SELECT lang, concat_ws(' ', 'Every clip in this sample is ' || source || '; the split cannot show speaker concentration.', CASE WHEN s < n THEN n || ' clips cover ' || s || ' distinct sentences.' END, CASE WHEN u > 0 THEN u || ' fetched clip(s) had no reference text and were dropped.' END) AS notes
FROM (SELECT lang || '|' || source AS lang, source, count(*) AS n, count(DISTINCT doc_id // 4) AS s, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)) AS u FROM documents GROUP BY lang, source)"""


def _directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the documents and one that has none, over seeds, what was measured, and overrides of which one names no language."""
    d = V.table(spark, sf_dir, "documents")
    entries = spark.createDataFrame([("en", "Latn"), ("fr", "Latn"), ("de", "Latn"), ("es", "Grek"), ("my", "Mymr")], "code string, script string")
    seed = spark.createDataFrame([("en", "verified", True, True, "in use"), ("fr", "beta", True, False, None), ("de", "beta", False, False, "new"), ("my", "experimental", True, True, "old")], "code string, tier string, enabled boolean, human_reviewed boolean, notes string")
    measured = d.groupBy(F.col("lang").alias("code")).agg(F.count("*").alias("n"), (F.sum(F.col("n_chars") % 10) / F.sum("n_chars")).alias("cer")).select(
        "code", F.when(F.col("n") % 2 == 0, "beta").otherwise("verified").alias("tier"), "cer", (F.col("cer") * 10).alias("cer_ratio"), "n", F.lit(False).alias("human_reviewed"), F.when(F.col("code") != "fr", F.concat(F.col("n").cast("string"), F.lit(" clips"))).otherwise("").alias("notes"))
    override = spark.createDataFrame([("de", "unsupported", True, None), ("es", None, True, "by hand"), ("zz", "verified", True, None)], "code string, tier string, enabled boolean, notes string")
    return R.resolved_languages(entries, seed, measured, override)


def language_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directory(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("cer", "cer_ratio")})


_DIRECTORY = """SELECT e.code, script, CASE e.code WHEN 'de' THEN 'unsupported' WHEN 'my' THEN 'experimental' ELSE CASE WHEN n % 2 = 0 THEN 'beta' ELSE 'verified' END END AS tier, CASE e.code WHEN 'de' THEN 'override' WHEN 'my' THEN 'seed' ELSE 'measured' END AS tier_source,
 true AS enabled, round(cer, 9) AS cer, round(cer * 10, 9) AS cer_ratio, n, e.code = 'my' AS human_reviewed, CASE e.code WHEN 'en' THEN n || ' clips in use' WHEN 'de' THEN n || ' clips new' WHEN 'es' THEN 'by hand' WHEN 'my' THEN 'old' END AS notes
FROM (VALUES ('en', 'Latn'), ('fr', 'Latn'), ('de', 'Latn'), ('es', 'Grek'), ('my', 'Mymr')) e(code, script) LEFT JOIN (SELECT lang AS code, count(*) AS n, sum(n_chars % 10)::DOUBLE / sum(n_chars) AS cer FROM documents GROUP BY lang) m ON m.code = e.code"""


def filtered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of languages by filters of the directory, one row for each filter and document."""
    rows, caps = stored(_directory(spark, sf_dir), "directory"), _capabilities(spark)
    filters = {"reviewable": {"tiers": ["beta", "verified"], "enabled": True, "script": "Latn"}, "alpha": {"provider": "alpha"}, "not-alpha": {"not_by": "alpha", "enabled": True}, "only-beta": {"exclusive_to": "beta"}}
    parts = [R.filtered_languages(rows, caps, **f).select("code", F.lit(name).alias("filter")) for name, f in filters.items()]
    codes = parts[0]
    for p in parts[1:]:
        codes = codes.unionByName(p)
    return V.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("code")).join(codes, "code").select("doc_id", "code", "filter")


_FILTERED = f"""SELECT doc_id, d.lang AS code, filter FROM documents d JOIN (SELECT code, 'reviewable' AS filter FROM dir WHERE tier IN ('beta', 'verified') AND script = 'Latn'
 UNION ALL SELECT code, 'alpha' FROM dir WHERE code IN (SELECT code FROM {_CAPS_SQL} WHERE accepted AND provider = 'alpha') UNION ALL SELECT code, 'not-alpha' FROM dir WHERE code NOT IN (SELECT code FROM {_CAPS_SQL} WHERE accepted AND provider = 'alpha')
 UNION ALL SELECT code, 'only-beta' FROM dir WHERE code IN (SELECT code FROM {_CAPS_SQL} WHERE accepted AND provider = 'beta') AND code NOT IN (SELECT code FROM {_CAPS_SQL} WHERE accepted AND provider <> 'beta')) f ON f.code = d.lang"""


def profiled_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring forms by a table of profiles: Spanish is scored without white space; a language of an unknown script has no profile, and its texts no form."""
    languages = spark.createDataFrame([("en", "Latn", "spaces", False, False), ("es", "Latn", "none", False, True), ("fr", "Latn", "spaces", False, False), ("de", "Xxxx", "spaces", False, False)], "code string, script string, segmentation string, legacy_encoding boolean, strip_space boolean")
    known = spark.createDataFrame([("Latn", True, False, None)], "script string, zwnj boolean, zwj boolean, native_digits string")
    profiles = R.scoring_profiles(languages, known)
    rows = V.spread(V.table(spark, sf_dir, "documents")).select("doc_id", F.col("lang").alias("code"), "text").join(profiles, "code", "left")
    return rows.select("doc_id", "segmentation", F.sha2(T.profiled_form(F.col("text"), F.col("strip_space"), F.col("zwnj"), F.col("zwj"), F.col("native_digits")), 256).alias("digest"))


_PROFILED = r"""SELECT doc_id, CASE lang WHEN 'es' THEN 'none' WHEN 'de' THEN NULL ELSE 'spaces' END AS segmentation, CASE lang WHEN 'de' THEN NULL WHEN 'es' THEN sha256(regexp_replace(t, '\s+', '', 'g')) ELSE sha256(trim(regexp_replace(t, '\s+', ' ', 'g'))) END AS digest
 FROM (SELECT doc_id, lang, regexp_replace(lower(nfc_normalize(text)), '[\p{P}\p{S}]', '', 'g') AS t FROM documents)"""


def grapheme_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as texts without word spaces: each grapheme gets its part of the time."""
    return A.interpolated_words(V.seg(spark, sf_dir), ["run_id", "idx"], "none").groupBy("run_id", "idx").agg(F.count("*").alias("units"), F.sum("start_ms").alias("starts"), F.max("end_ms").alias("end_ms"))


_TIMES = r"""SELECT run_id, idx, count(*) AS units, sum(s + least(span, coalesce(before, 0)))::BIGINT AS starts, max(CASE WHEN k = total THEN s + span ELSE s + least(span, before + d) END)::BIGINT AS end_ms FROM (
 SELECT *, sum(d) OVER (PARTITION BY run_id, idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
  SELECT run_id, idx, s, span, total, unnest(range(1, total + 1)) AS k, round(span::DOUBLE / total)::BIGINT AS d FROM (SELECT run_id, idx, start_ms AS s, end_ms - start_ms AS span, length(regexp_replace(text, '\s', '', 'g')) AS total FROM seg))) GROUP BY run_id, idx"""


def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by their number of turns as repeated runs: those in lower-case letters for nine of ten, distinct transcripts, and those of several speakers."""
    heard = V.seg(spark, sf_dir).groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("t"), F.countDistinct("speaker_key").alias("speakers"), F.count("*").alias("turns"))
    share = F.regexp_count("t", F.lit("[a-z]")) / F.nullif(F.regexp_count("t", F.lit("\\p{L}")), F.lit(0))
    return R.stability(heard, "turns", F.col("t"), share, F.col("speakers"))


_STABILITY = r"""SELECT turns, count(*) AS runs, count(*) FILTER (WHERE coalesce(length(regexp_replace(t, '[^a-z]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(t, '[^\p{L}]', '', 'g')), 0), 0) >= 0.9) AS in_script, count(DISTINCT t) AS distinct_texts, count(*) FILTER (WHERE speakers > 1) AS multi_speaker
 FROM (SELECT run_id, string_agg(text, ' ' ORDER BY idx, text) AS t, count(DISTINCT speaker_key) AS speakers, count(*) AS turns FROM seg GROUP BY run_id) GROUP BY turns"""


def live_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content as its asset, a third of them deleted, looked up by the content of every document."""
    a = V.asset(spark, sf_dir)
    held = O.first_by(a, ["sha256"], ["asset_id"]).select("sha256", "asset_id", "bytes", F.when(F.col("asset_id") % 3 == 0, F.lit("2026-01-01")).alias("deleted_at"))
    out = O.assets_by_digest(a.select(F.col("asset_id").alias("wanted_id"), "sha256"), held)
    return out.select("wanted_id", F.col("asset.asset_id").alias("asset_id"), F.col("asset.bytes").alias("bytes"))


def unmatched_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of earlier and fresh turns that a fixed matching, of users with themselves in every other run, leaves over."""
    prior = V.turn(spark, sf_dir)
    fresh = prior.withColumn("speaker_key", F.concat(F.lit("f-"), "speaker_key"))
    matches = prior.where("run_id % 2 = 0 and speaker_key = 'user'").select("run_id", F.lit("f-user").alias("fresh_key"), F.lit("user").alias("prior_key")).distinct()
    gone, new = S.unmatched_speakers(matches, prior, fresh)
    return gone.select("run_id", F.col("prior_key").alias("speaker_key"), F.lit(None).cast("long").alias("first_ms")).unionByName(new.select("run_id", F.col("fresh_key").alias("speaker_key"), "first_ms"))


def nested_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's object inside its properties, patched by the event's own; every fourth record has none yet."""
    record = F.when(F.col("seq") % 4 == 0, F.to_json(F.struct(F.col("kind").alias("mode")))).otherwise(F.to_json(F.struct(F.col("kind").alias("mode"), F.struct(F.lit("1").alias("k"), F.col("seq").cast("string").alias("at")).alias("batch"))))
    m = T.merge_json_at(record, "batch", F.to_json(F.struct((F.col("seq") % 5).cast("string").alias("k"))))
    return V.ev(spark, sf_dir).select("seq", m["mode"].alias("mode"), F.get_json_object(m["batch"], "$.k").alias("k"), F.get_json_object(m["batch"], "$.at").alias("at"))


QUERIES = {f.__name__: f for f in (translation_report, integrity_failures, sample_notes, language_directory, filtered_documents, profiled_forms, grapheme_times, run_stability, live_assets, unmatched_speakers, nested_props)}
ORACLE_SQL = {
    "translation_report": V.oracle("", "pairs", met=_SENTENCES, tr=_TRANSLATED) + _TRANSLATION,
    "integrity_failures": V.oracle(_FAILURES, "pairs", clips=_CLIPS, stats=_STATS),
    "sample_notes": _NOTES,
    "language_directory": _DIRECTORY,
    "filtered_documents": V.oracle(_FILTERED, dir=_DIRECTORY),
    "profiled_forms": _PROFILED,
    "grapheme_times": V.oracle(_TIMES, "seg"),
    "run_stability": V.oracle(_STABILITY, "seg"),
    "live_assets": V.oracle("SELECT asset_id AS wanted_id, CASE WHEN f % 3 <> 0 THEN f END AS asset_id, CASE WHEN f % 3 <> 0 THEN b END AS bytes FROM (SELECT asset_id, min(asset_id) OVER (PARTITION BY sha256) AS f, bytes AS b FROM asset)", "asset"),
    "unmatched_speakers": V.oracle("SELECT DISTINCT run_id, speaker_key, NULL::BIGINT AS first_ms FROM turn WHERE NOT (run_id % 2 = 0 AND speaker_key = 'user') UNION ALL SELECT run_id, 'f-' || speaker_key, min(start_ms) FROM turn WHERE NOT (run_id % 2 = 0 AND speaker_key = 'user') GROUP BY run_id, speaker_key", "turn"),
    "nested_props": V.oracle("SELECT seq, kind AS mode, (seq % 5)::VARCHAR AS k, CASE WHEN seq % 4 <> 0 THEN seq::VARCHAR END AS at FROM ev", "ev"),
}
