"""Queries of the evaluation operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechlake.functions import metrics as M
from speechlake.functions import scripts
from speechlake.functions import text as T
from speechlake.operators import evaluation as E
from speechlake.operators import statistics
from speechlake.sources import views as V
from speechlake.sources.scratch import stored

BASELINE = "en"


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scored(V.pairs(spark, sf_dir).withColumn("hyp", F.col("given")))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: the sums of all its clips."""
    return _clips(spark, sf_dir).groupBy("id", "lang", "arm").agg(F.sum("edits").alias("edits"), F.sum("ref_len").alias("ref_len"))


# the oracle's edit distance counts bytes, so the other characters of a pair are told apart by control characters there
_BYTES = "array_to_string(list_transform(list_concat(range(1, 9), range(14, 32)), lambda c: chr(c::INT)), '')"
_OTHERS = "array_to_string(list_distinct(regexp_extract_all({0} || {1}, '[^\\x00-\\x7F]')), '')"


def _lev(a: str, b: str) -> str:
    o = _OTHERS.format(a, b)
    return f"levenshtein(translate({a}, {o}, substr({_BYTES}, 1, length({o}))), translate({b}, {o}, substr({_BYTES}, 1, length({o}))))"


_NORM = "trim(regexp_replace(regexp_replace(lower(nfc_normalize({0})), '[\\p{{P}}\\p{{S}}]', '', 'g'), '\\s+', ' ', 'g'))"
_CLIPS = f"SELECT *, {_lev('h', 'r')}::BIGINT AS edits, length(r)::BIGINT AS ref_len FROM (SELECT id, clip, lang, arm, {_NORM.format('given')} AS h, {_NORM.format('ref')} AS r FROM pairs)"
_STATS = "SELECT id, lang, arm, sum(edits)::BIGINT AS edits, sum(ref_len)::BIGINT AS ref_len FROM clips GROUP BY id, lang, arm"


def corpus_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.corpus_rate(_stats(spark, sf_dir), ["lang", "arm"]).withColumn("cer", F.round("cer", 9))


def _rates(spark: SparkSession, sf_dir: str, stats: DataFrame | None = None) -> DataFrame:
    stats = stats or stored(_stats(spark, sf_dir), "tier-stats")
    rates = E.baseline_ratio(E.corpus_rate(stats, ["lang"]), "lang", BASELINE)
    texts = V.pairs(spark, sf_dir)
    integrity = E.script_integrity(texts, ["lang"], "given", [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)]).groupBy("lang").agg((F.sum("in_script") / F.nullif(F.sum("counted"), F.lit(0).cast("long"))).alias("integrity"))
    interval = E.bootstrap(stats, "lang", "id").select("lang", F.col("hi").alias("ci_hi"))
    return rates.join(integrity, "lang").join(interval, "lang")


def _tiers(spark: SparkSession, sf_dir: str, stats: DataFrame | None = None) -> DataFrame:
    """Every language but es has a sign-off."""
    rows = _rates(spark, sf_dir, stats)
    t = E.tier(F.col("cer"), F.col("ci_hi"), F.col("ratio"), F.col("integrity"), F.col("n"), F.col("lang") != "es")
    return rows.withColumn("t", t).select("lang", "n", "edits", "total", "cer", "ci_hi", "ratio", "integrity", "t.tier", "t.reason", "t.blocked")


def flagship_language_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiers(spark, sf_dir)
    return rows.select("lang", "n", "edits", "total", *[F.round(c, 9).alias(c) for c in ("cer", "ci_hi", "ratio", "integrity")], "tier", "reason", F.array_join("blocked", ",").alias("blocked"))


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier table in report order, with its place."""
    return E.report_rows(_tiers(spark, sf_dir).withColumn("ratio", F.when(F.col("lang") != "fr", F.col("ratio")))).select("place", "lang")


def blocked_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.blocked_queue(_tiers(spark, sf_dir))


_INTEGRITY = r"""SELECT lang, sum(length(regexp_replace(given, '[^A-Za-zÀ-ɏ]|[×÷]', '', 'g')))::DOUBLE / nullif(sum(length(regexp_replace(given, '[^\p{L}\p{M}]', '', 'g'))), 0) AS integrity FROM pairs GROUP BY lang"""
_RATES = "SELECT s.lang, count(*) AS n, sum(edits)::BIGINT AS edits, sum(ref_len)::BIGINT AS total, sum(edits)::DOUBLE / nullif(sum(ref_len), 0) AS cer FROM stats s GROUP BY s.lang"
_TIERS = """SELECT r.lang, r.n, edits, total, cer, hi AS ci_hi, cer / nullif((SELECT cer FROM rates WHERE lang = 'en'), 0) AS ratio, integrity FROM rates r JOIN integrity i USING (lang) JOIN boot b USING (lang)"""
_BLOCKED = """list_filter([CASE WHEN ratio IS NULL OR ratio > 1.15 THEN 'ratio>1.15' END, CASE WHEN cer > 0.2 THEN 'cer>0.2' END, CASE WHEN n < 30 THEN 'n<30' END, CASE WHEN ci_hi IS NULL THEN 'ciHi>0.20' WHEN ci_hi > 0.2 THEN 'ciHi>0.2' END,
 CASE WHEN cer > 0 AND ratio > 0 AND ci_hi / (cer / ratio) > 1.15 THEN 'ciHiRatio>1.15' END, CASE WHEN lang = 'es' THEN 'humanReview' END], lambda x: x IS NOT NULL)"""
_LEVELS = f"""SELECT *, CASE WHEN cer IS NULL OR integrity < 0.8 OR cer > 0.6 THEN [why] ELSE b END AS blocked, CASE WHEN cer IS NULL THEN 'experimental' WHEN integrity < 0.8 OR cer > 0.6 THEN 'unsupported' WHEN len(b) = 0 THEN 'verified' WHEN ratio <= 2.0 AND cer <= 0.35 THEN 'beta' ELSE 'experimental' END AS tier,
  CASE WHEN cer IS NULL THEN 'not-run' WHEN integrity < 0.8 THEN 'script-integrity' ELSE 'measured' END AS reason
 FROM (SELECT *, {_BLOCKED} AS b, CASE WHEN cer IS NULL THEN 'not-run' WHEN integrity < 0.8 THEN 'scriptIntegrity<0.8' ELSE 'cer>0.6' END AS why FROM t)"""
_FLAGSHIP = "SELECT lang, n, edits, total, round(cer, 9) AS cer, round(ci_hi, 9) AS ci_hi, round(ratio, 9) AS ratio, round(integrity, 9) AS integrity, tier, reason, array_to_string(blocked, ',') AS blocked FROM levels"
_ORDER = "SELECT (row_number() OVER (ORDER BY list_position(['verified', 'beta', 'experimental', 'unsupported'], tier), CASE WHEN lang <> 'fr' THEN ratio END NULLS LAST, lang) - 1)::INT AS place, lang FROM levels"


def corpus_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.word_stats(_clips(spark, sf_dir)).groupBy("lang").agg(F.sum("word_edits").alias("word_edits"), F.sum("ref_words").alias("ref_words"))
    return rows.withColumn("wer", F.round(M.rate(F.col("word_edits"), F.col("ref_words")), 9))


# distinct words of a pair get a character from 1 on; a clip of 240 characters has at most 120 words
_WER = r"""
SELECT lang, sum(word_edits)::BIGINT AS word_edits, sum(ref_words)::BIGINT AS ref_words, round(sum(word_edits)::DOUBLE / nullif(sum(ref_words), 0), 9) AS wer FROM (
  SELECT lang, len(rw) AS ref_words,
         levenshtein(array_to_string(list_transform(hw, lambda w: chr(list_position(al, w)::INT)), ''), array_to_string(list_transform(rw, lambda w: chr(list_position(al, w)::INT)), '')) AS word_edits
  FROM (SELECT lang, hw, rw, list_distinct(list_concat(rw, hw)) AS al FROM (
    SELECT lang, list_filter(string_split(h, ' '), lambda w: w <> '') AS hw, list_filter(string_split(r, ' '), lambda w: w <> '') AS rw FROM clips)))
GROUP BY lang"""


def corpus_chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.corpus_chrf(V.pairs(spark, sf_dir), ["lang"], hyp="given").withColumn("chrf", F.round("chrf", 6))


_CHRF = r"""
, u AS (SELECT id, clip, lang, regexp_replace(given, '\s+', '', 'g') AS h, regexp_replace(ref, '\s+', '', 'g') AS r FROM pairs),
g AS (SELECT lang, id, clip, n, substr(t, i, n) AS g, sum(a) AS a, sum(b) AS b FROM (
  SELECT id, clip, lang, n, t, a, b, unnest(range(1, length(t) - n + 2)) AS i FROM (
    SELECT id, clip, lang, h AS t, 1 AS a, 0 AS b FROM u UNION ALL SELECT id, clip, lang, r, 0, 1 FROM u), (SELECT unnest(range(1, 7)) AS n)) GROUP BY ALL),
o AS (SELECT lang, n, (sum(a) FILTER (WHERE b > 0))::DOUBLE AS a, sum(b)::DOUBLE AS b, sum(m)::DOUBLE AS m FROM (SELECT lang, id, clip, n, sum(a) AS a, sum(b) AS b, sum(least(a, b)) AS m FROM g GROUP BY ALL) GROUP BY lang, n)"""
_SCORE = """
, f AS (SELECT lang, avg(m / a) AS p, avg(m / b) AS r FROM o WHERE a > 0 AND b > 0 GROUP BY lang)
SELECT lang, round(CASE WHEN p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS chrf FROM f"""


def corpus_chrf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.corpus_chrf(V.pairs(spark, sf_dir), ["lang"], hyp="given", word_order=2).withColumn("chrf", F.round("chrf", 6))


_MARKS = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~'"
_EDGES = f"""flatten(list_transform(list_filter(regexp_split_to_array({{0}}, '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) = 1 THEN [w]
  WHEN contains({_MARKS}, w[-1:]) THEN [w[:-2], w[-1:]] WHEN contains({_MARKS}, w[1:1]) THEN [w[1:1], w[2:]] ELSE [w] END))"""
_ORDERS = _CHRF + f"""
, uw AS (SELECT id, clip, lang, {_EDGES.format('given')} AS h, {_EDGES.format('ref')} AS r FROM pairs),
gw AS (SELECT lang, id, clip, n, array_to_string(t[i:i + n - 1], ' ') AS g, sum(a) AS a, sum(b) AS b FROM (
  SELECT id, clip, lang, n, t, a, b, unnest(range(1, len(t) - n + 2)) AS i FROM (
    SELECT id, clip, lang, h AS t, 1 AS a, 0 AS b FROM uw UNION ALL SELECT id, clip, lang, r, 0, 1 FROM uw), (SELECT unnest(range(1, 3)) AS n)) GROUP BY ALL),
oc AS (SELECT * FROM o UNION ALL SELECT lang, n + 6, (sum(a) FILTER (WHERE b > 0))::DOUBLE, sum(b)::DOUBLE, sum(m)::DOUBLE FROM (SELECT lang, id, clip, n, sum(a) AS a, sum(b) AS b, sum(least(a, b)) AS m FROM gw GROUP BY ALL) GROUP BY lang, n)"""
_CHRF_WORDS = _ORDERS + _SCORE.replace("FROM o ", "FROM oc ")
_RAW = f"SELECT lang, round(sum({_lev('given', 'ref')})::DOUBLE / nullif(sum(length(ref)), 0), 9) AS cer, round(count(*) FILTER (WHERE given = ref)::DOUBLE / count(*), 9) AS exact, max(length(given)) AS longest FROM pairs GROUP BY lang"
_STATISTICS = """, fc AS (SELECT lang, avg(m / a) AS p, avg(m / b) AS r FROM o WHERE a > 0 AND b > 0 GROUP BY lang), fw AS (SELECT lang, avg(m / a) AS p, avg(m / b) AS r FROM oc WHERE a > 0 AND b > 0 GROUP BY lang)
SELECT lang, cer, exact, longest, round(500 * fc.p * fc.r / (4 * fc.p + fc.r), 6) AS chrf, round(500 * fw.p * fw.r / (4 * fw.p + fw.r), 6) AS chrf_words FROM _raw JOIN fc USING (lang) JOIN fw USING (lang)"""


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bootstrap(_stats(spark, sf_dir), "lang", "id").withColumns({"lo": F.round("lo", 9), "hi": F.round("hi", 9)})


_MUL = "((({0}) & 65535) * ({1}) + ((((({0}) >> 16) * ({1})) & 65535) << 16)) & 4294967295"
_BOOT = f"""
WITH c AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY id) - 1 AS i, edits, ref_len FROM stats),
n AS (SELECT lang, count(*) AS n FROM c GROUP BY lang),
d AS (SELECT lang, n, k, unnest(range(n)) AS j FROM n, (SELECT unnest(range(2000)) AS k)),
a AS (SELECT lang, n, k, (1 + ({_MUL.format('k * n + j + 1', '1831565813::BIGINT')})) & 4294967295 AS a FROM d),
b AS (SELECT lang, n, k, {_MUL.format('xor(a, a >> 15)', 'a | 1')} AS t FROM a),
e AS (SELECT lang, n, k, xor((t + ({_MUL.format('xor(t, t >> 7)', 't | 61')})) & 4294967295, t) AS t FROM b),
p AS (SELECT lang, n, k, floor(xor(t, t >> 14) / 4294967296.0::DOUBLE * n)::BIGINT AS i FROM e),
s AS (SELECT p.lang, p.n, k, sum(edits)::DOUBLE / nullif(sum(ref_len), 0) AS v FROM p JOIN c ON p.lang = c.lang AND p.i = c.i GROUP BY p.lang, p.n, k),
l AS (SELECT lang, n, list_sort(list(coalesce(v, 0))) AS v FROM s GROUP BY lang, n)
SELECT lang, n, v[51] AS lo, v[1950] AS hi FROM l"""


def bootstrap_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of its draws has no SQL."""
    return E.poisson_bootstrap(_stats(spark, sf_dir), "lang", "id")


def seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "documents").select("doc_id")
    return T.seeded_uniform(rows, 7, F.col("doc_id") + 1, "u").select("doc_id", F.round("u", 12).alias("draw"))


_DRAWS = f"""
WITH a AS (SELECT doc_id, (7 + ({_MUL.format('doc_id + 1', '1831565813::BIGINT')})) & 4294967295 AS a FROM documents),
b AS (SELECT doc_id, {_MUL.format('xor(a, a >> 15)', 'a | 1')} AS t FROM a),
e AS (SELECT doc_id, xor((t + ({_MUL.format('xor(t, t >> 7)', 't | 61')})) & 4294967295, t) AS t FROM b)
SELECT doc_id, round(xor(t, t >> 14) / 4294967296.0::DOUBLE, 12) AS draw FROM e"""


def pair_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of every clip, between code points and between graphemes."""
    h, r = F.col("h"), F.col("r")
    return _clips(spark, sf_dir).select("id", "clip", "edits", "ref_len", F.round(M.cer(h, r, F.col("edits")), 9).alias("cer"), F.round(M.grapheme_cer(h, r, F.col("edits")), 9).alias("grapheme_cer"))


def language_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.language_summary(_stats(spark, sf_dir)).withColumns({"cer": F.round("cer", 9), "worst_cer": F.round("worst_cer", 9)})


def language_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything of a language in one row: sums, worst clip, interval, integrity, tier."""
    stats = stored(_stats(spark, sf_dir), "report-stats")
    out = E.language_report(E.language_summary(stats), _tiers(spark, sf_dir, stats))
    return out.withColumns({c: F.round(c, 9) for c in ("cer", "worst_cer", "ci_hi", "ratio", "integrity")}).withColumn("blocked", F.array_join("blocked", ","))


def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three known statistics and two of the caller's own, in one pass over all pairs."""
    same = statistics.Statistic("exact", lambda h, r: {"n": F.lit(1), "same": (h == r).cast("long")}, lambda s: s["same"] / s["n"])
    longest = statistics.Statistic("longest", lambda h, r: {"most": F.length(h).cast("long")}, lambda s: s["most"], {"most": F.max})
    out = statistics.corpus(V.pairs(spark, sf_dir), ["lang"], ["cer", "chrf", "chrf_words", same, longest], hyp="given")
    return out.withColumns({"cer": F.round("cer", 9), "chrf": F.round("chrf", 6), "chrf_words": F.round("chrf_words", 6), "exact": F.round("exact", 9)})


def sample_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") * 960).alias("samples"))
    out = E.sample_description(rows, ["lang"], "doc_id", "source", "samples")
    return out.select("lang", "clips", "distinct_ids", F.round("seconds", 6).alias("seconds"), "uniform", F.size("groups").cast("long").alias("groups"), F.array_max(F.map_values("groups")).alias("largest_group"))


def script_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.script_integrity(V.spread(V.table(spark, sf_dir, "documents")), ["doc_id"], "text", [(0x41, 0x5A), (0x61, 0x7A)])
    return out.select("doc_id", "counted", "in_script", F.round("fraction", 9).alias("fraction"), F.array_join("strays", "").alias("strays"))


#: Scripts of the registry here, by the names of their characters' properties.
SCRIPTS = {"Latn": ["Latin"], "Cyrl": ["Cyrillic"], "Grek": ["Greek"], "Arab": ["Arabic"], "Deva": ["Devanagari"], "Mymr": ["Myanmar"], "Jpan": ["Hiragana", "Katakana", "Han"], "Hans": ["Han"], "Kore": ["Hangul", "Han"]}


def script_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity of each document by the scripts that a registry says its language accepts: English and French one, German two, Spanish none of those it is written in."""
    registry = spark.createDataFrame([("en", "Latn", None), ("fr", "Latn", []), ("de", "Cyrl", ["Latn"]), ("es", "Grek", ["Jpan"])], "code string, script string, alt_scripts array<string>")
    rows = scripts.accepted_scripts(V.spread(V.table(spark, sf_dir, "documents")).select("doc_id", "lang", "text"), registry)
    words = scripts.dictionary(scripts.scripts_table(spark, SCRIPTS))
    out = rows.select("doc_id", scripts.script_integrity(F.col("text"), F.col("accepted"), words).alias("x"), scripts.script_counts(F.col("text"), words)["Latn"].alias("latin"))
    return out.select("doc_id", "x.counted", "x.in_script", F.round("x.fraction", 9).alias("fraction"), F.array_join("x.strays", "").alias("strays"), "latin")


_SCRIPTS = r"""SELECT doc_id, length(a)::BIGINT AS counted, length(a)::BIGINT - length(c)::BIGINT AS in_script, round((length(a) - length(c))::DOUBLE / nullif(length(a), 0), 9) AS fraction, nullif(length(regexp_replace(text, '[^\p{Latin}]', '', 'g')), 0)::BIGINT AS latin,
 coalesce(array_to_string((list_transform(list_sort(list_transform(list_distinct(string_split(c, '')), lambda x: {'p': instr(c, x), 'x': x})), lambda y: y.x))[1:8], ''), '') AS strays
 FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[^\p{L}\p{M}]', '', 'g') AS a, regexp_replace(coalesce(text, ''), CASE lang WHEN 'de' THEN '[^\p{L}\p{M}]|\p{Latin}|\p{Cyrillic}' WHEN 'es' THEN '[^\p{L}\p{M}]|\p{Greek}|\p{Han}|\p{Hiragana}|\p{Katakana}' ELSE '[^\p{L}\p{M}]|\p{Latin}' END, '', 'g') AS c FROM documents)"""


def script_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.script_census(V.spread(V.table(spark, sf_dir, "documents")), "lang", "text").withColumn("share", F.round("share", 9))


def cleanup_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleanup(spark, sf_dir)


def _cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.cleanup_aggregate(E.cleanup_stats(V.pairs(spark, sf_dir)), ["lang", "arm"])
    return out.withColumns({c: F.round(c, 9) for c in ("cer_punct", "content_delta", "length_delta", "entity_drift")})


_SP = "trim(regexp_replace(nfc_normalize({0}), '\\s+', ' ', 'g'))"
_CN = "regexp_replace(regexp_replace(lower(nfc_normalize({0})), '[\\p{{P}}\\p{{S}}]', '', 'g'), '\\s+', '', 'g')"
_ENT = r"regexp_extract_all({0}, '\p{{Lu}}{{2,}}|\d+(?:[.,:/\x{{66B}}\x{{66C}}]\d+)*')"
_CLEAN = f"""
, k AS (SELECT *, {_lev('hp', 'rp')} AS ep, length(rp) AS lp, {_lev('hc', 'gc')} AS ec, length(gc) AS lc, length(hyp) - length(given) AS dl, length(given) AS li FROM (
  SELECT id, clip, lang, arm, given, hyp, {_SP.format('hyp')} AS hp, {_SP.format('ref')} AS rp, {_CN.format('hyp')} AS hc, {_CN.format('given')} AS gc FROM pairs)),
en AS (SELECT id, clip, token, sum(i) AS i, sum(o) AS o FROM (SELECT id, clip, unnest({_ENT.format('given')}) AS token, 1 AS i, 0 AS o FROM pairs UNION ALL SELECT id, clip, unnest({_ENT.format('hyp')}), 0, 1 FROM pairs) GROUP BY id, clip, token),
dr AS (SELECT id, clip, sum(abs(i - o)) AS drift, sum(i) AS total FROM en GROUP BY id, clip),
agg AS (SELECT lang, arm, count(*) AS n, round(sum(ep)::DOUBLE / nullif(sum(lp), 0), 9) AS cer_punct, round(sum(ec)::DOUBLE / nullif(sum(lc), 0), 9) AS content_delta, round(sum(dl)::DOUBLE / nullif(sum(li), 0), 9) AS length_delta,
  count(*) FILTER (WHERE ec > 0) AS rewritten, round(sum(coalesce(drift, 0))::DOUBLE / sum(greatest(1, coalesce(total, 0))), 9) AS entity_drift
FROM k LEFT JOIN dr USING (id, clip) GROUP BY lang, arm)"""


def cleanup_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All arms of the run were wanted; of the languages asked for one was never measured, and one has no set."""
    more = spark.createDataFrame([("xx", "rate limit", True), ("yy", None, False)], "lang string, error string, has_set boolean")
    languages = V.table(spark, sf_dir, "documents").select("lang", F.lit(None).cast("string").alias("error"), F.lit(True).alias("has_set")).distinct().union(more)
    # the gate reads the arms several times, and they are a dozen rows
    out = E.cleanup_gate(stored(_cleanup(spark, sf_dir), "cleanup-arms"), "src0", ["src0", "src1", "src2"], languages)
    return out.select("lang", "arm", "failure", *[F.round(c, 8).alias(c) for c in ("value", "against", "delta")], "reason")


def cleanup_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every arm in one row: rates, interval, examples, lost tokens and failed segments."""
    failures = V.table(spark, sf_dir, "documents").where("doc_id % 11 = 0").groupBy("lang", F.col("source").alias("arm")).agg(F.count("*").alias("failed"), F.lit("no reply").alias("failure"))
    failures = failures.union(spark.createDataFrame([("xx", "src0", 3, "rate limit")], "lang string, arm string, failed long, failure string"))
    out = E.arm_results(E.cleanup_stats(V.pairs(spark, sf_dir)), ["lang", "arm"], ["id", "clip"], failures, b=200)
    return out.select("lang", "arm", "n", *[F.round(c, 9).alias(c) for c in ("cer_punct", "content_delta", "entity_drift", "lo", "hi")], "failed", "failure", F.array_join(F.transform("examples", lambda e: F.concat_ws(":", e["id"], e["clip"], F.md5(e["output"]))), ",").alias("examples"), F.array_join("entities_lost", "|").alias("lost"))


_ARMS = """, st2 AS (SELECT lang || '|' || arm AS lang, id * 1000000 + clip AS id, ep AS edits, lp AS ref_len FROM k), boot2 AS ({boot}),
ex AS (SELECT lang, arm, string_agg(id || ':' || clip || ':' || md5(hyp), ',' ORDER BY place) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY lang, arm ORDER BY ec DESC, id, clip) AS place FROM k WHERE ec > 0) WHERE place <= 2 GROUP BY ALL),
lo AS (SELECT lang, arm, string_agg(token, '|' ORDER BY token) AS lost FROM (SELECT DISTINCT lang, arm, token FROM en JOIN k USING (id, clip) WHERE o < i) GROUP BY ALL),
fa AS (SELECT lang, source AS arm, count(*) AS failed, 'no reply' AS failure FROM documents WHERE doc_id % 11 = 0 GROUP BY ALL UNION ALL SELECT 'xx', 'src0', 3, 'rate limit')
SELECT lang, arm, coalesce(agg.n, 0) AS n, cer_punct, content_delta, entity_drift, round(b.lo, 9) AS lo, round(b.hi, 9) AS hi, coalesce(failed, 0) AS failed, failure, coalesce(examples, '') AS examples, coalesce(lost, '') AS lost
FROM agg LEFT JOIN (SELECT lang AS k, lo, hi FROM boot2) b ON b.k = agg.lang || '|' || agg.arm LEFT JOIN ex USING (lang, arm) LEFT JOIN lo USING (lang, arm) FULL JOIN fa USING (lang, arm)"""


_GATE = """
, cr AS (SELECT a.*, c.cer_punct AS control FROM agg a JOIN (SELECT lang, cer_punct FROM agg WHERE arm = 'src0') c ON a.lang = c.lang WHERE a.arm <> 'src0'),
w AS (SELECT l.lang, count(*) FILTER (WHERE arm <> 'src0' AND n > 0) AS scored FROM (SELECT DISTINCT lang FROM documents UNION SELECT 'xx') l LEFT JOIN agg USING (lang) GROUP BY l.lang)
SELECT lang, arm, failure, round(value, 8) AS value, round(against, 8) AS against, round(value - against, 8) AS delta, NULL AS reason FROM (
  SELECT lang, arm, 'cer_punct' AS failure, cer_punct AS value, control AS against FROM cr WHERE cer_punct > control
  UNION ALL SELECT lang, arm, 'content_delta', content_delta, 0.005::DOUBLE FROM cr WHERE content_delta > 0.005
  UNION ALL SELECT lang, arm, 'entity_drift', entity_drift, 0.02::DOUBLE FROM cr WHERE entity_drift > 0.02)
UNION ALL SELECT lang, 'src1,src2', 'not_measured', NULL, NULL, NULL, CASE lang WHEN 'xx' THEN 'rate limit' END FROM w WHERE scored < 2
UNION ALL SELECT lang, min(arm) FILTER (WHERE arm <> 'src0'), 'control_missing', NULL, NULL, NULL, NULL FROM agg GROUP BY lang HAVING count(*) FILTER (WHERE arm <> 'src0' AND n > 0) >= 2 AND count(cer_punct) FILTER (WHERE arm = 'src0') = 0"""


def entity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.cleanup_stats(V.pairs(spark, sf_dir)).where(F.size(F.concat("ents_in", "ents_out")) > 0)
    return out.select("id", "clip", "drift", "total", F.array_join("lost", ",").alias("lost"))


def rewritten_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two clips of each arm of which most content was rewritten."""
    return E.rewritten_examples(E.cleanup_stats(V.pairs(spark, sf_dir)), ["lang", "arm"], ["id", "clip"]).select("lang", "arm", "place", "id", "clip", "edits_c")


def _half_tiers(spark: SparkSession, sf_dir: str, half: int) -> DataFrame:
    rates = E.baseline_ratio(E.corpus_rate(_stats(spark, sf_dir).where(F.col("id") % 2 == half), ["lang", "arm"]), "arm", "src0", run=["lang"])
    t = E.tier(F.col("cer"), F.lit(None).cast("double"), F.col("ratio"), F.lit(1.0), F.col("n"), F.lit(True))
    return rates.select(F.concat_ws("|", "lang", "arm").alias("lang"), "n", F.round("cer", 9).alias("cer"), t["tier"].alias("tier"), F.when(F.col("n") % 7 == 0, "failed").alias("error"), t["reason"].alias("reason"), t["blocked"].alias("blocked"))


def tier_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tier_changes(_half_tiers(spark, sf_dir, 0), _half_tiers(spark, sf_dir, 1))


def publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (_half_tiers(spark, sf_dir, half).drop("reason", "blocked") for half in (0, 1))
    return E.publish(old, new, ["lang"])


_HALF = """SELECT {0} AS half, concat_ws('|', h.lang, h.arm) AS lang, h.n, round(h.cer, 9) AS cer,
  CASE WHEN h.cer IS NULL THEN 'experimental' WHEN h.cer > 0.6 THEN 'unsupported' WHEN h.cer / nullif(b.cer, 0) <= 2.0 AND h.cer <= 0.35 THEN 'beta' ELSE 'experimental' END AS tier, CASE WHEN h.n % 7 = 0 THEN 'failed' END AS error,
  CASE WHEN h.cer IS NULL THEN ['not-run'] WHEN h.cer > 0.6 THEN ['cer>0.6'] ELSE list_filter([CASE WHEN h.cer / nullif(b.cer, 0) <= 1.15 THEN NULL ELSE 'ratio>1.15' END, CASE WHEN h.cer > 0.2 THEN 'cer>0.2' END, CASE WHEN h.n < 30 THEN 'n<30' END, 'ciHi>0.20'], lambda x: x IS NOT NULL) END AS blocked,
  CASE WHEN h.cer IS NULL THEN 'not-run' ELSE 'measured' END AS reason
 FROM (SELECT lang, arm, count(*) AS n, sum(edits)::DOUBLE / nullif(sum(ref_len), 0) AS cer FROM stats WHERE id % 2 = {0} GROUP BY lang, arm) h
 LEFT JOIN (SELECT lang, sum(edits)::DOUBLE / nullif(sum(ref_len), 0) AS cer FROM stats WHERE id % 2 = {0} AND arm = 'src0' GROUP BY lang) b ON h.lang = b.lang"""
_CHANGES = """SELECT n.lang, n.tier AS after, n.cer AS cer_after, p.tier AS before, p.cer AS cer_before, CASE WHEN p.tier IS NULL THEN 'first measurement — ' || n.reason ELSE 'blocked by ' || array_to_string(n.blocked, ', ') END AS why, CASE WHEN p.tier IS NULL THEN 'new' WHEN list_position(['verified', 'beta', 'experimental', 'unsupported'], n.tier) < list_position(['verified', 'beta', 'experimental', 'unsupported'], p.tier) THEN 'promoted' ELSE 'demoted' END AS change
 FROM h1 n LEFT JOIN h0 p ON n.lang = p.lang WHERE n.tier IS DISTINCT FROM p.tier"""
_PUBLISH = "SELECT lang, n, cer, tier, error FROM h1 WHERE error IS NULL UNION ALL SELECT lang, n, cer, tier, error FROM h0 WHERE lang NOT IN (SELECT lang FROM h1 WHERE error IS NULL)"


def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.spread(V.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.sha2(T.scoring_form(F.col("text")), 256).alias("digest"), F.length(T.scoring_form(F.col("text"), strip_space=True, keep_punctuation=True)).cast("long").alias("packed_chars"))


def normaliser_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain chosen by language."""
    chains = {"fr": ["nfc", "lower", "whitespace"], "de": ["zero-width", "punctuation", "whitespace"]}
    c = F.col("text")
    out = T.chain(c, ["whitespace"])
    for lang, ids in chains.items():
        out = F.when(F.col("lang") == lang, T.chain(c, ids)).otherwise(out)
    return V.spread(V.table(spark, sf_dir, "documents")).select("doc_id", F.sha2(out, 256).alias("digest"))


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response key, slug, clock and duration texts of each document."""
    ms, rows = F.col("n_chars") * 60, V.table(spark, sf_dir, "documents")
    return rows.select("doc_id", T.content_key(F.col("source"), F.lit("m"), F.col("lang"), F.col("doc_id").cast("string")).alias("key"), T.slug(F.concat(F.lit(" Doc: "), "source", F.lit(" / "), "lang", F.lit("! "))).alias("slug"),
                       T.clock(ms, with_ms=True).alias("clock"), T.subtitle_time(ms).alias("subtitle"), T.parse_clock(T.clock(ms, True, True)).alias("parsed"), T.human_duration(ms / 1000).alias("human"))


_KEYS = """SELECT doc_id, sha256(concat_ws('|', source, 'm', lang, doc_id::VARCHAR)) AS key, 'doc-' || source || '-' || lang AS slug,
 CASE WHEN ms >= 3600000 THEN printf('%02d:%02d:%02d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60) ELSE printf('%02d:%02d', ms // 60000, (ms // 1000) % 60) END || printf('.%03d', ms % 1000) AS clock,
 printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS subtitle, ms AS parsed,
 CASE WHEN ms <= 0 THEN '—' ELSE printf('%dm %02ds', s // 60, s % 60) END AS human
FROM (SELECT *, n_chars * 60 AS ms, round(n_chars * 60 / 1000.0::DOUBLE)::BIGINT AS s FROM documents)"""

_SUMS = "SELECT lang, count(*) AS n, sum(edits)::BIGINT AS edits, sum(ref_len)::BIGINT AS ref_len, round(sum(edits)::DOUBLE / nullif(sum(ref_len), 0), 9) AS cer, (list(id ORDER BY coalesce(edits::DOUBLE / nullif(ref_len, 0), -1) DESC, id DESC))[1] AS worst_id, round(max(edits::DOUBLE / nullif(ref_len, 0)), 9) AS worst_cer FROM stats GROUP BY lang"
_C = {"clips": _CLIPS}
_S = {**_C, "stats": _STATS}
_s = lambda q: V.oracle(q, "pairs", **_S)
_B = {**_S, "boot": _BOOT}
_T = {**_B, "integrity": _INTEGRITY, "rates": _RATES, "t": _TIERS, "levels": _LEVELS}
QUERIES = {f.__name__: f for f in (
    flagship_language_tiers, report_order, blocked_queue, corpus_cer, corpus_wer, corpus_chrf, corpus_chrf_words, bootstrap_interval, bootstrap_poisson, seeded_draws, pair_rates, language_summary, language_report, corpus_statistics, sample_description, script_integrity, script_registry, script_census,
    cleanup_aggregate, cleanup_gate, cleanup_arms, entity_drift, rewritten_examples, tier_changes, publish, normalised_text, normaliser_chain, text_keys)}
ORACLE_SQL = {
    "flagship_language_tiers": V.oracle(_FLAGSHIP, "pairs", **_T),
    "report_order": V.oracle(_ORDER, "pairs", **_T),
    "blocked_queue": V.oracle("SELECT lang, unnest(blocked) AS blocker, len(blocked) = 1 AS only FROM levels WHERE tier <> 'verified' AND reason = 'measured'", "pairs", **_T),
    "corpus_cer": _s("SELECT lang, arm, count(*) AS n, sum(edits)::BIGINT AS edits, sum(ref_len)::BIGINT AS total, round(sum(edits)::DOUBLE / nullif(sum(ref_len), 0), 9) AS cer FROM stats GROUP BY lang, arm"),
    "corpus_wer": V.oracle(_WER, "pairs", **_C),
    "corpus_chrf": V.oracle("", "pairs") + _CHRF + _SCORE,
    "corpus_chrf_words": V.oracle("", "pairs") + _CHRF_WORDS,
    "bootstrap_interval": V.oracle("SELECT lang, n, round(lo, 9) AS lo, round(hi, 9) AS hi FROM boot", "pairs", **_B),
    "seeded_draws": _DRAWS,
    "pair_rates": V.oracle("SELECT id, clip, edits, ref_len, round(CASE WHEN ref_len > 0 THEN edits::DOUBLE / ref_len WHEN length(h) = 0 THEN 0.0 END, 9) AS cer, round(CASE WHEN ref_len > 0 THEN edits::DOUBLE / ref_len WHEN length(h) = 0 THEN 0.0 END, 9) AS grapheme_cer FROM clips", "pairs", **_C),
    "language_summary": _s(_SUMS),
    "language_report": V.oracle("SELECT s.*, round(ci_hi, 9) AS ci_hi, round(ratio, 9) AS ratio, round(integrity, 9) AS integrity, tier, reason, array_to_string(blocked, ',') AS blocked FROM _sums s LEFT JOIN levels USING (lang)", "pairs", **_T, _sums=_SUMS),
    "corpus_statistics": V.oracle("", "pairs", _raw=_RAW) + _ORDERS + _STATISTICS,
    "sample_description": "SELECT lang, sum(c)::BIGINT AS clips, sum(c)::BIGINT AS distinct_ids, round(sum(s)::DOUBLE / 16000, 6) AS seconds, count(*) = 1 AS uniform, count(*) AS groups, max(c) AS largest_group FROM (SELECT lang, source, count(*) AS c, sum(n_chars * 960) AS s FROM documents GROUP BY lang, source) GROUP BY lang",
    "script_integrity": r"""SELECT doc_id, length(a)::BIGINT AS counted, length(b)::BIGINT AS in_script, round(length(b)::DOUBLE / nullif(length(a), 0), 9) AS fraction,
 coalesce(array_to_string((list_transform(list_sort(list_transform(list_distinct(string_split(c, '')), lambda x: {'p': instr(c, x), 'x': x})), lambda y: y.x))[1:8], ''), '') AS strays
 FROM (SELECT doc_id, regexp_replace(text, '[^\p{L}\p{M}]', '', 'g') AS a, regexp_replace(text, '[^A-Za-z]', '', 'g') AS b, regexp_replace(text, '[^\p{L}\p{M}]|[A-Za-z]', '', 'g') AS c FROM documents)""",
    "script_registry": _SCRIPTS,
    "script_census": r"""SELECT lang, 'Latn' AS script, count(*) AS rows, 1.0::DOUBLE AS share, 'primary' AS role FROM documents WHERE regexp_matches(text, '\p{Latin}') GROUP BY lang""",
    "cleanup_aggregate": V.oracle("", "pairs") + _CLEAN + " SELECT * FROM agg",
    "cleanup_gate": V.oracle("", "pairs") + _CLEAN + _GATE,
    "entity_drift": V.oracle("", "pairs") + _CLEAN + " SELECT id, clip, sum(abs(i - o))::BIGINT AS drift, sum(i)::BIGINT AS total, coalesce(array_to_string(list_sort(list(token) FILTER (WHERE o < i)), ','), '') AS lost FROM en GROUP BY id, clip",
    "cleanup_arms": V.oracle("", "pairs") + _CLEAN + _ARMS.format(boot=_BOOT.replace("FROM stats", "FROM st2").replace("range(2000)", "range(200)").replace("v[51]", "v[6]").replace("v[1950]", "v[195]")),
    "rewritten_examples": V.oracle("", "pairs") + _CLEAN + " SELECT lang, arm, place::INT AS place, id, clip, ec::BIGINT AS edits_c FROM (SELECT *, row_number() OVER (PARTITION BY lang, arm ORDER BY ec DESC, id, clip) AS place FROM k WHERE ec > 0) WHERE place <= 2",
    "tier_changes": V.oracle(_CHANGES, "pairs", **_S, h0=_HALF.format(0), h1=_HALF.format(1)),
    "publish": V.oracle(_PUBLISH, "pairs", **_S, h0=_HALF.format(0), h1=_HALF.format(1)),
    "normalised_text": r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[\p{P}\p{S}]', '', 'g'), '\s+', ' ', 'g'))) AS digest, length(regexp_replace(lower(nfc_normalize(text)), '\s+', '', 'g'))::BIGINT AS packed_chars FROM documents",
    "normaliser_chain": r"SELECT doc_id, sha256(CASE lang WHEN 'fr' THEN trim(regexp_replace(lower(nfc_normalize(text)), '\s+', ' ', 'g')) WHEN 'de' THEN trim(regexp_replace(regexp_replace(text, '[\p{P}\p{S}]', '', 'g'), '\s+', ' ', 'g')) ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END) AS digest FROM documents",
    "text_keys": _KEYS,
}
