"""Readers and writers of text formats, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVAL_COLUMNS = ["id", "filename", "raw", "plain", "graphemes", "num_samples", "gender"]
MANIFEST = "path string, title string, language string, provider string, model string"
SCHEMA_VERSION = 1


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", quote: str = '"') -> DataFrame:
    """Delimited text: a doubled quote is a quote, quoted fields may hold line ends, blank rows go."""
    if len(sep) != 1 or len(quote) != 1 or sep == quote:
        raise ValueError("separator and quote must be one character each, and differ")
    return spark.read.csv(path, schema=schema, sep=sep, quote=quote, escape=quote, multiLine=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_eval_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The seven columns of an evaluation set, and a one-row table with the number of dropped rows: too few fields, or an id that is no number."""
    raw = read_delimited(spark, path, ", ".join(f"{c} string" for c in [*EVAL_COLUMNS, "_more"]))
    blank = F.col("filename").isNull() & (F.coalesce(F.regexp_replace("id", "\\s", ""), F.lit("")) == "")
    raw = raw.where(~blank)
    good = F.trim("id").rlike("^\\d+$") & F.col("gender").isNotNull()
    rows = raw.where(good).select(F.trim("id").cast("long").alias("id"), *EVAL_COLUMNS[1:5], F.col("num_samples").try_cast("long").alias("num_samples"), "gender")
    return rows, raw.select(F.count_if(~F.coalesce(good, F.lit(False))).alias("dropped"))


def read_eval_rows_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Every row with its seven columns, short ones skipped and not counted: ids are any text, and a sample count is the whole number its text begins with, else 0. In this reading the columns raw and plain have each other's names."""
    raw = read_delimited(spark, path, ", ".join(f"{c} string" for c in [*EVAL_COLUMNS, "_more"])).where("gender is not null")
    samples = F.coalesce(F.regexp_extract("num_samples", "^\\s*([+-]?\\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    names = {"raw": "plain", "plain": "raw"}
    return raw.select(*[F.coalesce(c, F.lit("")).alias(names.get(c, c)) for c in EVAL_COLUMNS[:5]], samples.alias("num_samples"), "gender")


def write_chunk_results(rows: DataFrame, path: str) -> None:
    """Results of chunks (run_id, chunk, body), a folder for each run; those that are there stay."""
    rows.select("run_id", "chunk", "body").write.mode("append").partitionBy("run_id").parquet(path)


def read_chunk_results(wanted: DataFrame, path: str) -> DataFrame:
    """wanted (run_id, chunk) with the body of the chunk's result; null for one that is not there yet."""
    held = wanted.sparkSession.read.schema("chunk long, body string, run_id long").parquet(path)
    return wanted.join(held.groupBy("run_id", "chunk").agg(F.min("body").alias("body")), ["run_id", "chunk"], "left")


def read_manifest(spark: SparkSession, path: str, **defaults: str) -> DataFrame:
    """Ingest manifest: # begins a remark, a header is skipped, blanks take the defaults."""
    rows = spark.read.csv(path, schema=MANIFEST, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).where("path <> 'path'")
    return rows.select("path", *[F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(defaults.get(c))).alias(c) for c in ("title", "language", "provider", "model")])


def read_runlog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and torn lines are skipped."""
    parsed = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.where("r is not null and r.t is not null").select("r.*")


def append_runlog(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def silences(log: Column) -> Column:
    """Milliseconds of all silence marks in a log, in order; empty without any."""
    marks = F.regexp_extract_all(log, F.lit("silence_(?:start|end): (-?\\d+(?:\\.\\d+)?)"), F.lit(1))
    return F.array_sort(F.transform(F.coalesce(marks, F.array().cast("array<string>")), lambda x: F.round(x.cast("double") * 1000).cast("long")))


def probe(body: Column) -> Column:
    """struct(duration_ms, format, streams) of a stored media probe; a duration that can't be read is null."""
    b = F.from_json(body, "format struct<duration:string,format_name:string>, streams array<struct<codec_type:string>>")
    return F.struct(F.round(b["format"]["duration"].try_cast("double") * 1000).cast("long").alias("duration_ms"), b["format"]["format_name"].alias("format"), F.size(F.coalesce(b["streams"], F.array().cast("array<struct<codec_type:string>>"))).alias("streams"))


def read_tiers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tier table; an unknown schema version is an error."""
    rows = spark.read.schema(f"schemaVersion int, {schema}").json(path)
    known = F.when(F.col("schemaVersion") == SCHEMA_VERSION, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown schema version "), F.coalesce(F.col("schemaVersion").cast("string"), F.lit("none")))).cast("boolean"))
    return rows.where(known).drop("schemaVersion")


def write_tiers(rows: DataFrame, path: str) -> None:
    rows.withColumn("schemaVersion", F.lit(SCHEMA_VERSION)).write.mode("overwrite").json(path)


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, for a sink that refuses numbers that are not finite."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.isnan(c) | (F.abs(F.col(c).cast("double")) == float("inf")), F.lit(False))
    return df.where(F.when(bad, F.raise_error(F.lit("a number is not finite")).cast("boolean")).otherwise(True))
