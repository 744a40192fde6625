"""Provider responses to transcripts: parsing, timing, seams, placeholders, layers, documents."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlake.functions import text as T

#: Guard against text heard in silence, and the limits of seams.
NO_SPEECH, SHORT_TEXT, HALLUCINATION_WARNING = 0.6, 30, 0.10
SEAM_SLACK_MS, SEAM_WORDS, SEAM_CHARS, SEAM_CUT, SEAM_FLAG = 300, 60, 400, 0.5, 0.7
#: Shapes of the two kinds of responses.
RECOGNISE = "array<struct<alternatives:array<struct<transcript:string,confidence:double,words:array<struct<word:string,startOffset:string,endOffset:string,confidence:double>>>>,resultEndOffset:string>>"
WHISPER = "struct<duration:double,segments:array<struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,words:array<struct<word:string,start:double,end:double,probability:double>>>>,words:array<struct<word:string,start:double,end:double,probability:double>>>"


def recognised_words(responses: DataFrame, keys: Sequence[str], body: str, offset_ms: Column) -> DataFrame:
    """keys, result, word_idx, text, start_ms, end_ms, confidence of the words of recognised_segments."""
    rows = _results(responses, keys, body, offset_ms).where("timed").select(*keys, "result", F.posexplode("words").alias("word_idx", "w"))
    return rows.select(*keys, "result", "word_idx", "w.text", "w.start_ms", "w.end_ms", "w.confidence")


def _results(responses: DataFrame, keys: Sequence[str], body: str, offset_ms: Column) -> DataFrame:
    """keys, result, text, confidence, words, timed, _o, _end of the first alternative of each result that has a text. A word without a start begins where the chunk does, one without an end ends at its start; words without a text go."""
    rows = responses.select(*keys, offset_ms.alias("_o"), F.posexplode(F.from_json(body, RECOGNISE)).alias("result", "_r"))
    first = F.get("_r.alternatives", F.lit(0))
    rows = rows.select(*keys, "_o", "result", F.trim(first["transcript"]).alias("text"), first["confidence"].alias("confidence"), T.offset_ms(F.col("_r.resultEndOffset")).alias("_end"), first["words"].alias("_w")).where("text <> ''")
    at = F.transform(F.coalesce("_w", F.array().cast("array<struct<word:string,startOffset:string,endOffset:string,confidence:double>>")),
                     lambda w: F.struct(w["word"].alias("text"), T.offset_ms(w["startOffset"]).alias("s"), T.offset_ms(w["endOffset"]).alias("e"), w["confidence"].alias("confidence")))
    rows = rows.withColumn("_w", F.filter(at, lambda w: w["text"] != ""))
    none, o = F.lit(0).cast("long"), F.col("_o")
    words = F.transform("_w", lambda w: F.struct(w["text"].alias("text"), (o + F.coalesce(w["s"], none)).alias("start_ms"), (o + F.coalesce(w["e"], w["s"], none)).alias("end_ms"), w["confidence"].alias("confidence"), (w["s"].isNotNull() | w["e"].isNotNull()).alias("placed")))
    return rows.select(*keys, "_o", "_end", "result", "text", "confidence", words.alias("words"), F.exists(words, lambda w: w["placed"]).alias("timed"))


def recognised_segments(responses: DataFrame, keys: Sequence[str], body: str, offset_ms: Column, duration_ms: Column) -> DataFrame:
    """keys, idx, text, start_ms, end_ms, confidence, words, timed, bounded of a recognise response.

    A result with placed words lasts from the first of them to the latest end. Another has no words: it begins where the
    one before it ends and lasts to the result's own end, or without one (bounded is then false) to the chunk's.
    """
    rows = _results(responses.withColumn("_d", duration_ms), [*keys, "_d"], body, offset_ms)
    placed = F.filter("words", lambda w: w["placed"])
    last = F.when(F.col("timed"), F.array_max(F.transform(placed, lambda w: w["end_ms"]))).otherwise(F.col("_o") + F.coalesce("_end", "_d"))
    order = Window.partitionBy(*keys).orderBy("result")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    # a result with words sets the end of all so far anew, others can only move it on
    rows = rows.withColumns({"_last": last, "_set": F.sum(F.col("timed").cast("int")).over(running), "idx": F.row_number().over(order) - 1})
    since = F.max("_last").over(Window.partitionBy(*keys, "_set").orderBy("result").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end_ms", F.when(F.col("_set") == 0, F.greatest("_o", since)).otherwise(since))
    start = F.when(F.col("timed"), F.get(placed, F.lit(0))["start_ms"]).otherwise(F.coalesce(F.lag("end_ms").over(order), "_o"))
    kept = F.when(F.col("timed"), F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), w["confidence"].alias("confidence")))).otherwise(F.array().cast("array<struct<text:string,start_ms:bigint,end_ms:bigint,confidence:double>>"))
    return rows.withColumn("start_ms", start).select(*keys, "idx", "text", "start_ms", "end_ms", "confidence", kept.alias("words"), "timed", (F.col("timed") | F.col("_end").isNotNull()).alias("bounded"))


def whisper_segments(responses: DataFrame, keys: Sequence[str], body: str, offset_ms: Column) -> DataFrame:
    """keys, idx, text, start_ms, end_ms, confidence, heard_in_silence of each segment."""
    rows = responses.select(*keys, offset_ms.alias("_o"), F.posexplode(F.from_json(body, WHISPER)["segments"]).alias("idx", "_s"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long") + F.col("_o")
    text = F.trim("_s.text")
    return rows.select(*keys, "idx", text.alias("text"), ms("_s.start").alias("start_ms"), ms("_s.end").alias("end_ms"), T.confidence_of(F.col("_s.avg_logprob")).alias("confidence"), heard_in_silence(F.col("_s.no_speech_prob"), text).alias("heard_in_silence"))


def whisper_words(responses: DataFrame, keys: Sequence[str], body: str, offset_ms: Column) -> DataFrame:
    """keys, word_idx, text, start_ms, end_ms, confidence: flat words and those inside segments, in one list."""
    b = F.from_json(body, WHISPER)
    none = F.array().cast("array<struct<word:string,start:double,end:double,probability:double>>")
    nested = F.flatten(F.transform(F.coalesce(b["segments"], F.array().cast("array<struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,words:array<struct<word:string,start:double,end:double,probability:double>>>>")), lambda s: F.coalesce(s["words"], none)))
    rows = responses.select(*keys, offset_ms.alias("_o"), F.posexplode(F.concat(F.coalesce(b["words"], none), nested)).alias("word_idx", "_w"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long") + F.col("_o")
    return rows.select(*keys, "word_idx", F.trim("_w.word").alias("text"), ms("_w.start").alias("start_ms"), ms("_w.end").alias("end_ms"), F.col("_w.probability").alias("confidence"))


def heard_in_silence(no_speech: Column, text: Column) -> Column:
    return F.coalesce((no_speech > NO_SPEECH) & (F.length(text) < SHORT_TEXT), F.lit(False))


def hallucination_rate(segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, segments, dropped, rate, warn (above 10 %)."""
    out = segments.groupBy(*by).agg(F.count("*").alias("segments"), F.count_if("heard_in_silence").alias("dropped"))
    return out.withColumn("rate", F.col("dropped") / F.col("segments")).withColumn("warn", F.col("rate") > HALLUCINATION_WARNING)


def past_end(words: DataFrame, limit: Column) -> DataFrame:
    return words.where(F.col("start_ms") > limit)


def carry_forward(rows: DataFrame, keys: Sequence[str], order: str, offset: Column) -> DataFrame:
    """rows whose unknown start is the largest end of those before, or the chunk's offset."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start_ms", F.coalesce("start_ms", F.max("end_ms").over(before), offset))


def segment_units(text: Column, segmentation: str = "spaces") -> Column:
    """Words between white space, or graphemes where words aren't set apart (segmentation none); blank units are none."""
    parts = F.split(text, T.SPACE) if segmentation == "spaces" else T.graphemes(text)
    return F.filter(parts, lambda w: ~w.rlike(f"^(?:{T.SPACE})?$"))


def interpolated_words(segments: DataFrame, keys: Sequence[str], segmentation: str = "spaces") -> DataFrame:
    """keys, word_idx, text, start_ms, end_ms: the segment's time shared by the length of its units in code points; the last takes what is left. Segments without a unit have no rows."""
    units = segment_units(F.col("text"), segmentation)
    rows = segments.select(*keys, F.col("start_ms").alias("_s"), F.greatest(F.lit(0).cast("long"), F.col("end_ms") - F.col("start_ms")).alias("_span"), F.posexplode(units).alias("word_idx", "text"))
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("word_idx")
    rows = rows.withColumns({"_len": F.length("text"), "_total": F.sum(F.length("text")).over(whole), "_last": F.lead("word_idx").over(order).isNull()})
    rows = rows.withColumn("_d", F.round(F.col("_span") * F.col("_len") / F.col("_total")).cast("long"))
    start = F.least(F.col("_span"), F.coalesce(F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    end = F.when(F.col("_last"), F.col("_span")).otherwise(F.least(F.col("_span"), F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return rows.select(*keys, "word_idx", "text", (F.col("_s") + start).alias("start_ms"), (F.col("_s") + end).alias("end_ms"))


def renumbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def with_placeholders(segments: DataFrame, failed: DataFrame) -> DataFrame:
    """segments with an empty one for each failed chunk, in order of time, numbered anew."""
    holes = failed.select("run_id", F.lit(None).cast("string").alias("speaker_key"), F.lit("").alias("text"), "start_ms", "end_ms", F.col("reason"))
    both = segments.select("run_id", "speaker_key", "text", "start_ms", "end_ms", F.lit(None).cast("string").alias("reason")).unionByName(holes)
    return renumbered(both, ["run_id"], ["start_ms", "end_ms", "reason"])


def chunk_plan(assets: DataFrame, silences: DataFrame, most_ms: int, lead_ms: int, least_ms: int = 1000) -> DataFrame:
    """asset_id, idx, offset_ms, content_start_ms, end_ms: cuts at the last silence in the second half of what a request takes, else where it is full; what fits a request is not cut any more.

    The walk over one asset is an expression over its own silences; assets are spread over the cluster.
    """
    lead = min(lead_ms, most_ms // 2)
    step = most_ms - lead
    own = silences.groupBy("asset_id").agg(F.array_sort(F.collect_list("at_ms")).alias("at"))
    rows = assets.join(own, "asset_id", "left").withColumn("at", F.coalesce("at", F.array().cast("array<long>")))
    count = F.ceil(F.col("duration_ms") / F.lit(max(1, step // 2))).cast("int") + 1
    start = F.array(F.lit(0).cast("long"))

    def cut(acc: Column, _: Column) -> Column:
        cursor = F.element_at(acc, -1)
        inside = F.filter("at", lambda s: (s > cursor + step // 2) & (s <= cursor + step))
        to = F.when(F.col("duration_ms") - cursor <= step, F.col("duration_ms")).when(F.size(inside) > 0, F.element_at(inside, -1)).otherwise(cursor + step)
        return F.when(cursor >= F.col("duration_ms"), acc).otherwise(F.concat(acc, F.array(to)))

    edges = rows.select("asset_id", F.aggregate(F.sequence(F.lit(1), count), start, cut).alias("edges"))
    parts = edges.select("asset_id", F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("p", "from_ms"), "edges")
    parts = parts.select("asset_id", "from_ms", F.element_at("edges", F.col("p") + 2).alias("end_ms")).where(F.col("end_ms") - F.col("from_ms") >= least_ms)
    parts = renumbered(parts, ["asset_id"], ["from_ms"])
    return parts.select("asset_id", "idx", F.when(F.col("idx") == 0, F.col("from_ms")).otherwise(F.col("from_ms") - lead).alias("offset_ms"), F.col("from_ms").alias("content_start_ms"), "end_ms")


def lcs_pairs(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places, by chains of matches.

    From the end of a, every match gets the length of the longest chain of matches that it can begin; lasts[k] is the
    latest place in b at which a chain of k + 1 begins. The pairs are then taken from the front. Of equally long
    choices a place of b is left unmatched only if no place of a that keeps the length has its token: the first token of
    b that is left is paired with the earliest such place; without one, the latest place of a that begins a chain of the
    length left is paired with the earliest place in b of its token.
    """
    where: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    by_length: dict[int, list[tuple[int, int]]] = {}
    lasts: list[int] = []  # falling
    for i in reversed(range(len(a))):
        found = [(bisect_left(lasts, -j, key=lambda last: -last), j) for j in where.get(a[i], ())]
        for k, j in found:
            by_length.setdefault(k + 1, []).append((j, i))
            if k == len(lasts):
                lasts.append(j)
            else:
                lasts[k] = max(lasts[k], j)
    out: list[tuple[int, int]] = []
    i = j = -1
    for left in range(len(lasts), 0, -1):
        choices = [(y, x) for y, x in by_length[left] if y > j and x > i]
        at_next = [x for y, x in choices if y == j + 1]
        i, j = (min(at_next), j + 1) if at_next else max(((x, y) for y, x in choices), key=lambda p: (p[0], -p[1]))
        out.append((i, j))
    return out


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of a longest common subsequence; bit i of a row is 0 where the length grows at place i of a."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b:
        same = row & where.get(x, 0)
        row = (row + same | row - same) & full
    return len(a) - row.bit_count()


def adjacent_chunks(chunks: DataFrame) -> DataFrame:
    """run_id, chunk, seam_ms of chunks that follow a chunk of their run without a gap; the seam is where that one ends. Next to a failed chunk there is none."""
    before = chunks.select("run_id", (F.col("chunk") + 1).alias("chunk"), F.col("end_ms").alias("seam_ms"), F.col("failed").alias("_f"))
    return chunks.where("not failed").join(before.where("not _f").drop("_f"), ["run_id", "chunk"]).select("run_id", "chunk", "seam_ms")


def _windows(words: DataFrame, pairs: DataFrame, lead_ms: int, slack_ms: int) -> DataFrame:
    """run_id, chunk, seam_ms, left, right: words at both sides of each seam with their places in their chunks."""
    place = F.row_number().over(Window.partitionBy("run_id", "chunk").orderBy("start_ms", "word_idx")) - 1
    placed = words.withColumn("place", place).select("run_id", F.col("chunk").alias("c"), F.struct("place", T.token_form(F.col("text")).alias("token"), "start_ms", "end_ms").alias("w"))
    side = lambda c, keep, name: pairs.join(placed, (pairs["run_id"] == placed["run_id"]) & (c == placed["c"])).groupBy(pairs["run_id"], "chunk").agg(
        F.array_sort(F.collect_list(F.when(keep, F.col("w")))).alias(name), F.max("w.place").alias(f"{name}_last"), F.max(F.when(F.col("w.end_ms") <= F.col("seam_ms") - lead_ms / 2, F.col("w.place"))).alias(f"{name}_ended"), F.max(F.when(F.col("w.start_ms") <= F.col("seam_ms") - lead_ms / 2, F.col("w.place"))).alias(f"{name}_begun"))
    left = side(F.col("chunk") - 1, F.col("w.start_ms") >= F.col("seam_ms") - lead_ms - slack_ms, "left")
    right = side(F.col("chunk"), F.col("w.end_ms") <= F.col("seam_ms") + slack_ms, "right")
    rows = pairs.join(left, ["run_id", "chunk"], "left").join(right, ["run_id", "chunk"], "left")
    return rows.select("run_id", "chunk", "seam_ms", F.slice("left", -SEAM_WORDS, SEAM_WORDS).alias("long_left"), "left", F.slice("right", 1, SEAM_WORDS).alias("right"), "left_last", F.coalesce("left_ended", F.lit(-1)).alias("left_ended"), F.coalesce("right_begun", F.lit(-1)).alias("right_begun"))


def seams(words: DataFrame, chunks: DataFrame, lead_ms: int, segmentation: str = "spaces", slack_ms: int = SEAM_SLACK_MS) -> DataFrame:
    """run_id, chunk, seam_ms, method, score, flagged, keep_through, drop_through: where the words of two chunks that overlap are joined.

    words: run_id, chunk, word_idx, text, start_ms, end_ms; chunks: run_id, chunk, end_ms, failed. A chunk begins lead_ms
    before its predecessor ends, the seam. Compared are the predecessor's words that start in the overlap and the
    chunk's own that end in it, give or take the slack, at most 60 of each. From a score of 0.5 on the pair whose
    earlier word lies nearest the seam joins them: the predecessor is kept through that word, and the chunk dropped
    through its own; below 0.7 that is flagged. Else both are cut in the middle of the overlap, flagged. Places count
    from 0 within the chunk, -1 is none; with an empty side all is kept. Tokens are whole words, or graphemes where
    words aren't set apart.
    """
    rows = _windows(words, adjacent_chunks(chunks), lead_ms, slack_ms)
    few = F.when(F.size("left") > SEAM_WORDS, F.col("long_left")).otherwise(F.col("left"))
    units = lambda c: T.tokens(F.transform(c, lambda w: w["token"]), segmentation)
    rows = rows.withColumn("left", F.coalesce(few, F.array().cast(rows.schema["left"].dataType))).withColumn("right", F.coalesce("right", F.array().cast(rows.schema["right"].dataType)))
    rows = rows.select("run_id", "chunk", "seam_ms", F.transform("left", lambda w: w["place"]).alias("lp"), F.transform("left", lambda w: (w["start_ms"] + w["end_ms"]) / 2).alias("lm"), F.transform("right", lambda w: w["place"]).alias("rp"),
                       units(F.col("left")).alias("l"), units(F.col("right")).alias("r"), "left_last", "left_ended", "right_begun")

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for x in pdf.itertuples(index=False):
                if not len(x.lp) or not len(x.rp):
                    out.append((x.run_id, x.chunk, x.seam_ms, "empty", 1.0, False, -1 if pd.isna(x.left_last) else int(x.left_last), -1))
                    continue
                pairs = lcs_pairs([t["token"] for t in x.l], [t["token"] for t in x.r])
                score = 2 * len(pairs) / (len(x.l) + len(x.r)) if len(x.l) + len(x.r) else 1.0
                if not pairs or score < SEAM_CUT:
                    out.append((x.run_id, x.chunk, x.seam_ms, "hard-cut", score, True, x.left_ended, x.right_begun))
                    continue
                i, j = min(pairs, key=lambda p: abs(x.lm[x.l[p[0]]["owner"]] - x.seam_ms))
                out.append((x.run_id, x.chunk, x.seam_ms, "lcs", score, score < SEAM_FLAG, x.lp[x.l[i]["owner"]], x.rp[x.r[j]["owner"]]))
            yield pd.DataFrame(out, columns=["run_id", "chunk", "seam_ms", "method", "score", "flagged", "keep_through", "drop_through"])

    return rows.mapInPandas(align, "run_id long, chunk long, seam_ms long, method string, score double, flagged boolean, keep_through int, drop_through int")


def seams_without_words(segments: DataFrame, chunks: DataFrame, lead_ms: int) -> DataFrame:
    """run_id, chunk, seam_ms, method, score, flagged, drop_through for chunks whose segments have no word times.

    segments: run_id, chunk, idx, text, start_ms, end_ms. Segments of the chunk go that lie, by their middle, before the
    middle of the overlap; the likeness of the last and first 400 characters is told but decides nothing, and all such
    seams are flagged.
    """
    pairs = adjacent_chunks(chunks)
    place = F.row_number().over(Window.partitionBy("run_id", "chunk").orderBy("start_ms", "idx")) - 1
    placed = segments.withColumn("place", place)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
    whole = placed.groupBy("run_id", "chunk").agg(text.alias("t"))
    gone = placed.join(pairs, ["run_id", "chunk"]).where((F.col("start_ms") + F.col("end_ms")) / 2 < F.col("seam_ms") - lead_ms / 2).groupBy("run_id", "chunk").agg(F.max("place").alias("drop_through"))
    units = lambda c: F.transform(T.tokens(F.array(T.token_form(c)), "none"), lambda x: x["token"])
    left = whole.select("run_id", (F.col("chunk") + 1).alias("chunk"), units(F.right("t", F.lit(SEAM_CHARS))).alias("l"))
    right = whole.select("run_id", "chunk", units(F.left("t", F.lit(SEAM_CHARS))).alias("r"))
    rows = pairs.join(left, ["run_id", "chunk"], "left").join(right, ["run_id", "chunk"], "left").join(gone, ["run_id", "chunk"], "left")

    @F.pandas_udf("long")
    def matched(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None or y is None else lcs_length(x, y) for x, y in zip(a, b)], dtype="int64")

    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    score = F.when((n("l") > 0) & (n("r") > 0), T.dice(matched("l", "r"), n("l"), n("r"))).otherwise(0.0)
    return rows.select("run_id", "chunk", "seam_ms", F.lit("no-words").alias("method"), score.alias("score"), F.lit(True).alias("flagged"), F.coalesce("drop_through", F.lit(-1)).alias("drop_through"))


def apply_seams(words: DataFrame, found: DataFrame, trim_tail: bool = False) -> DataFrame:
    """words without those that a chunk repeats after each seam, numbered anew over the run; with trim_tail, also without what its predecessor has beyond the seam."""
    place = F.row_number().over(Window.partitionBy("run_id", "chunk").orderBy("start_ms", "word_idx")) - 1
    own = found.select("run_id", "chunk", "drop_through")
    tail = found.select("run_id", (F.col("chunk") - 1).alias("chunk"), "keep_through")
    kept = words.withColumn("_p", place).join(own, ["run_id", "chunk"], "left").join(tail, ["run_id", "chunk"], "left")
    kept = kept.where(F.col("_p") > F.coalesce("drop_through", F.lit(-1)))
    kept = kept.where(F.col("keep_through").isNull() | (F.col("_p") <= F.col("keep_through"))) if trim_tail else kept
    return renumbered(kept.drop("_p", "drop_through", "keep_through"), ["run_id"], ["chunk", "start_ms", "word_idx"], "idx")


def rebuilt_segments(segments: DataFrame, found: DataFrame, joiner: str = " ") -> DataFrame:
    """segments after their seams: what a chunk repeats is dropped from the words inside its segments.

    segments: run_id, chunk, idx, text, text_raw, start_ms, end_ms, words (an array of structs with text, start_ms and
    whatever else); found: run_id, chunk, drop_through, the place in the chunk of the last word that goes (below 0: none).
    A segment that loses all its words goes; one that loses some begins at the first left, and its text is joined anew;
    one without words stays. The raw text is what was heard and never changes. Numbers are without gaps in a chunk.
    """
    n = F.size(F.coalesce("words", F.array().cast(segments.schema["words"].dataType)))
    order = Window.partitionBy("run_id", "chunk").orderBy("idx")
    rows = segments.join(found.select("run_id", "chunk", "drop_through"), ["run_id", "chunk"], "left").withColumn("_n", n)
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_cut", F.greatest(F.lit(0), F.least(F.col("_n"), F.coalesce("drop_through", F.lit(-1)) + 1 - before)).cast("int"))
    rows = rows.where((F.col("_n") == 0) | (F.col("_cut") < F.col("_n")))
    left, some = F.slice("words", F.col("_cut") + 1, F.greatest(F.col("_n") - F.col("_cut"), F.lit(0))), F.col("_cut") > 0
    new = {"idx": (F.row_number().over(order) - 1).cast(segments.schema["idx"].dataType), "text": F.when(some, F.array_join(F.transform(left, lambda w: w["text"]), joiner)).otherwise(F.col("text")),
           "start_ms": F.when(some, F.get(left, F.lit(0))["start_ms"]).otherwise(F.col("start_ms")), "words": F.when(some, left).otherwise(F.col("words"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in segments.columns])


def read_turns(results: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """keys, speaker_key, start_ms, end_ms, idx of stored diarization results; one that has not succeeded is an error."""
    shape = "state string, result struct<turns:array<struct<start_ms:long,end_ms:long,speaker:string>>,num_speakers:int,model:string>"
    r = F.from_json(body, shape)
    ok = F.when((r["state"] == "succeeded") & r["result"].isNotNull(), r["result"]["turns"]).otherwise(F.raise_error(F.concat(F.lit("no diarization result: "), F.coalesce(r["state"], F.lit("unreadable")))).cast("array<struct<start_ms:long,end_ms:long,speaker:string>>"))
    rows = results.select(*keys, F.posexplode(ok).alias("idx", "t"))
    return rows.select(*keys, F.col("t.speaker").alias("speaker_key"), F.col("t.start_ms").alias("start_ms"), F.col("t.end_ms").alias("end_ms"), "idx")


def transcripts(segments: DataFrame, words: DataFrame, runs: DataFrame | None = None, chunks: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """run_id, document: one JSON document a run, with its segments and their words in order.

    runs adds run (all its columns); chunks (run_id, chunk, end_ms, failed) and found seams (run_id, chunk, method,
    score, flagged) add lists of those, and a warning for every failed chunk and flagged seam.
    """
    w = words.groupBy("run_id", "idx").agg(F.array_sort(F.collect_list(F.struct("word_idx", "text", "start_ms", "end_ms"))).alias("words"))
    s = segments.join(w, ["run_id", "idx"], "left").select("run_id", F.struct("idx", "speaker_key", "text", "start_ms", "end_ms", "words").alias("s"))
    out, parts = s.groupBy("run_id").agg(F.array_sort(F.collect_list("s")).alias("segments")), ["run_id", "segments"]
    listed = lambda df, cols, name: df.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    warnings = []
    if runs is not None:
        out, parts = out.join(runs.select("run_id", F.struct(*runs.columns).alias("run")), "run_id", "left"), ["run", *parts]
    if chunks is not None:
        out, parts = out.join(listed(chunks, ["chunk", "end_ms", "failed"], "chunks"), "run_id", "left"), [*parts, "chunks"]
        warnings.append(F.transform(F.filter("chunks", lambda c: c["failed"]), lambda c: F.concat(F.lit("chunk "), c["chunk"].cast("string"), F.lit(" failed"))))
    if found is not None:
        out, parts = out.join(listed(found, ["chunk", "method", "score", "flagged"], "seams"), "run_id", "left"), [*parts, "seams"]
        warnings.append(F.transform(F.filter("seams", lambda c: c["flagged"]), lambda c: F.concat(F.lit("seam before chunk "), c["chunk"].cast("string"), F.lit(" is unsure"))))
    if warnings:
        none = F.array().cast("array<string>")
        out, parts = out.withColumn("warnings", F.concat(*[F.coalesce(w, none) for w in warnings])), [*parts, "warnings"]
    return out.select("run_id", F.to_json(F.struct(*parts)).alias("document"))


def transcript_lines(segments: DataFrame) -> DataFrame:
    return segments.select("run_id", "idx", F.concat(F.lit("["), T.clock(F.col("start_ms"), with_ms=False), F.lit("] "), F.col("text")).alias("line"))


def rttm_lines(turns: DataFrame) -> DataFrame:
    sec = lambda c: F.format_string("%.3f", c / 1000.0)
    return turns.select(F.concat_ws(" ", F.lit("SPEAKER"), F.col("run_id").cast("string"), F.lit("1"), sec(F.col("start_ms")), sec(F.col("end_ms") - F.col("start_ms")), F.lit("<NA>"), F.lit("<NA>"), "speaker_key", F.lit("<NA>"), F.lit("<NA>")).alias("value"))


def read_rttm(lines: DataFrame) -> DataFrame:
    """run_id, speaker_key, start_ms, end_ms of SPEAKER lines; blank lines and remarks are skipped, a short or non-numeric line is an error."""
    p = F.split(F.trim("value"), "\\s+")
    rows = lines.where((F.trim("value") != "") & ~F.trim("value").startswith(";;")).select(p.alias("p")).where(F.col("p")[0] == "SPEAKER")
    start, dur = F.get("p", F.lit(3)).try_cast("double"), F.get("p", F.lit(4)).try_cast("double")
    bad = (F.size("p") < 8) | start.isNull() | dur.isNull()
    ok = F.when(bad, F.raise_error(F.concat(F.lit("not a speaker line: "), F.array_join("p", " "))).cast("double")).otherwise(start)
    return rows.select(F.get("p", F.lit(1)).alias("run_id"), F.get("p", F.lit(7)).alias("speaker_key"), F.round(ok * 1000).cast("long").alias("start_ms"), F.round((ok + dur) * 1000).cast("long").alias("end_ms"))


def resolve_layer(texts: DataFrame, keys: Sequence[str], chain: Sequence[str], target: str = "") -> DataFrame:
    """keys, layer, text, fallback: the first layer of the chain that a segment has; a translation needs its target language."""
    order = F.array_position(F.array(*map(F.lit, chain)), F.col("layer"))
    live = texts.where(F.col("superseded_at").isNull() & (order > 0) & ((F.col("layer") != "translated") | (F.col("target_lang") == target)))
    best = live.groupBy(*keys).agg(F.min_by(F.struct("layer", "text"), order).alias("b"))
    return best.select(*keys, "b.layer", "b.text", (F.col("b.layer") != chain[0]).alias("fallback"))


def superseded(rows: DataFrame, keys: Sequence[str], at: str, order: Sequence[str]) -> DataFrame:
    """rows with superseded_at: the time of the next row of the key; the last row of a key lives."""
    return rows.withColumn("superseded_at", F.lead(at).over(Window.partitionBy(*keys).orderBy(*order)))
