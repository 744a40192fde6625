"""Views over the driver's tables in the shape of transcription data, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Milliseconds of audio for a character of text; characters of a clip.
MS_PER_CHAR, CLIP_CHARS = 60, 240


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores. Parts of a file are no measure for it: one that is written as a single row group is cut into many of them, and all its rows are in one."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores if parts < cores else max(4 * cores, 2 * parts))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, clip, lang, arm, ref, given, hyp: all of each document, in clips of so many characters; one empty clip without a text.

    given is what a recogniser heard of the reference, hyp what an editing pass made of it; the arm src0 leaves it as it is.
    """
    rows = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "lang", F.col("source").alias("arm"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{CLIP_CHARS}}}"), F.lit(0)).alias("c"))
    clips = rows.select("id", "lang", "arm", F.posexplode_outer("c").alias("clip", "ref")).fillna({"clip": 0, "ref": ""})
    given = F.replace(F.replace("ref", F.lit("th"), F.lit("t")), F.lit(". "), F.lit(" "))
    clips = clips.withColumn("given", given)
    spaced = F.replace("given", F.lit("an"), F.lit("a n"))
    hyp = F.when(F.col("arm") == "src0", F.col("given")).when(F.col("id") % 3 == 1, F.replace(spaced, F.lit("ou"), F.lit("o"))).otherwise(spaced)
    return clips.select("id", "clip", "lang", "arm", "ref", "given", hyp.alias("hyp"))


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, idx, speaker_key, text, start_ms, end_ms."""
    length = F.length("text") * MS_PER_CHAR
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker_key"), "text", start.alias("start_ms"), length.alias("d"))
    return rows.select("run_id", "idx", "speaker_key", "text", "start_ms", (F.col("start_ms") + F.col("d")).cast("long").alias("end_ms"))


def word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, idx, word_idx, text, start_ms, end_ms, confidence."""
    rows = seg(spark, sf_dir).select("run_id", "idx", "start_ms", F.posexplode(F.split("text", " ")).alias("word_idx", "text"))
    before = Window.partitionBy("run_id", "idx").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start_ms") + F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)) * MS_PER_CHAR
    rows = rows.select("run_id", "idx", "word_idx", "text", at.cast("long").alias("start_ms"))
    sure = F.when(F.col("word_idx") % 10 != 9, (F.col("word_idx") * 37 % 100) / F.lit(100.0))
    return rows.select("run_id", "idx", F.col("word_idx").cast("long").alias("word_idx"), "text", "start_ms", (F.col("start_ms") + F.length("text") * MS_PER_CHAR).cast("long").alias("end_ms"), sure.alias("confidence"))


def turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, speaker_key, start_ms, end_ms, idx: segments with shifted edges."""
    start = F.greatest(F.lit(0).cast("long"), F.col("start_ms") + (F.col("idx") * 37 % 5 - 2) * 400)
    end = F.col("end_ms") + (F.col("idx") * 11 % 5 - 2) * 400
    return seg(spark, sf_dir).select("run_id", "speaker_key", start.alias("start_ms"), end.alias("end_ms"), "idx")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, run_id, kind, created_at, value, data."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("run_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("created_at"), "value", F.col("props").alias("data"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, line, provider_id, model, unit, quantity."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("provider_id"), F.col("l_linestatus").alias("model"), F.lit("minute").alias("unit"), F.col("l_quantity").alias("quantity"))


def step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, kind, shard, weight, state, optional, attempt, shipped."""
    state = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_discount") > 0.05, "dead").otherwise("done")).when(F.col("l_returnflag") == "A", F.when(F.col("l_tax") > 0.04, "running").otherwise("done")).otherwise(F.when(F.col("l_tax") > 0.06, "pending").otherwise("done"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linestatus").alias("kind"), F.col("l_linenumber").alias("shard"), F.col("l_quantity").cast("int").alias("weight"), state.alias("state"),
        (F.col("l_linenumber") % 3 == 0).alias("optional"), (F.col("l_partkey") % 4).cast("int").alias("attempt"), F.col("l_discount").alias("progress"))


def asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, sha256, duration_ms, bytes, lang, source."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset_id"), F.sha2("text", 256).alias("sha256"), (F.col("n_chars") * MS_PER_CHAR).alias("duration_ms"), F.octet_length("text").cast("long").alias("bytes"), "lang", "source")


_SQL = {
    "pairs": """SELECT *, CASE WHEN arm = 'src0' THEN given WHEN id % 3 = 1 THEN replace(replace(given, 'an', 'a n'), 'ou', 'o') ELSE replace(given, 'an', 'a n') END AS hyp
        FROM (SELECT *, replace(replace(ref, 'th', 't'), '. ', ' ') AS given FROM (
         SELECT id, lang, arm, unnest(range(len(c)))::INT AS clip, unnest(c) AS ref FROM (
          SELECT doc_id AS id, lang, source AS arm, CASE WHEN coalesce(text, '') = '' THEN [''] ELSE regexp_extract_all(text, '(?s).{1,240}') END AS c FROM documents)))""",
    "seg": """SELECT run_id, idx, speaker_key, text, start_ms, start_ms + d AS end_ms FROM (
        SELECT conv_id AS run_id, turn AS idx, role AS speaker_key, text, length(text) * 60 AS d,
               coalesce(sum(length(text) * 60) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms
        FROM conversations)""",
    "word": """SELECT run_id, idx, word_idx, text, start_ms, start_ms + length(text) * 60 AS end_ms,
               CASE WHEN word_idx % 10 <> 9 THEN (word_idx * 37 % 100) / 100.0::DOUBLE END AS confidence
        FROM (SELECT run_id, idx, word_idx, text,
                     (start_ms + coalesce(sum(length(text) + 1) OVER (PARTITION BY run_id, idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 60)::BIGINT AS start_ms
              FROM (SELECT run_id, idx, start_ms, unnest(string_split(text, ' ')) AS text, unnest(range(len(string_split(text, ' ')))) AS word_idx FROM seg))""",
    "turn": "SELECT run_id, speaker_key, greatest(0, start_ms + (idx * 37 % 5 - 2) * 400) AS start_ms, end_ms + (idx * 11 % 5 - 2) * 400 AS end_ms, idx FROM seg",
    "ev": "SELECT event_id AS seq, user_id AS run_id, event_type AS kind, ts AS created_at, value, props AS data FROM events",
    "usage": "SELECT l_orderkey AS order_id, l_linenumber AS line, l_returnflag AS provider_id, l_linestatus AS model, 'minute' AS unit, l_quantity AS quantity FROM lineitem",
    "step": """SELECT l_orderkey AS run_id, l_linestatus AS kind, l_linenumber AS shard, l_quantity::INT AS weight,
        CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_discount > 0.05 THEN 'dead' ELSE 'done' END
             WHEN l_returnflag = 'A' THEN CASE WHEN l_tax > 0.04 THEN 'running' ELSE 'done' END
             ELSE CASE WHEN l_tax > 0.06 THEN 'pending' ELSE 'done' END END AS state,
        l_linenumber % 3 = 0 AS optional, (l_partkey % 4)::INT AS attempt, l_discount AS progress FROM lineitem""",
    "asset": "SELECT doc_id AS asset_id, sha256(text) AS sha256, n_chars * 60 AS duration_ms, octet_length(encode(text))::BIGINT AS bytes, lang, source FROM documents",
}
_NEEDS = {"word": ["seg"], "turn": ["seg"]}


def oracle(query: str, *views: str, **more: str) -> str:
    """A query for the oracle, with the views that it names, and further named parts, before it."""
    names: list[str] = []
    for v in views:
        for n in [*_NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    parts = [f"{n} AS ({_SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {query}" if parts else query
