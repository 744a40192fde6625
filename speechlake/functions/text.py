"""Text normalisation, clocks, digests and a seeded generator, as column expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Sequence
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the scoring rules see it, zero-width and bidirectional marks.
SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
WHITE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ALWAYS_ZERO_WIDTH = "\u200b\ufeff"
BIDI = "\u200e\u200f\u061c\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
ZWNJ, ZWJ = "‌", "‍"
LATIN_DIGITS = "0123456789"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Canonical composition; Spark has no expression for it. Texts of characters that can only be composed already stay in the JVM."""
    return F.coalesce(_nfc(F.when(~c.rlike("^[\\x{0}-\\x{2FF}]*$"), c)), c)


def count_of(c: Column, kind: str) -> Column:
    """Characters of a class, as the length of what is left of the others; regexp_count makes a string of each that it finds."""
    return F.length(F.regexp_replace(c, f"[^{kind}]+" if "&&" not in kind else f"[\\x{{0}}-\\x{{10FFFF}}&&[^{kind}]]+", "")).cast("long")


def strip_zero_width(c: Column, zwnj: bool = False, zwj: bool = False, bidi: bool = False) -> Column:
    # none of them is below U+0300
    c = F.when(F.rlike(c, F.lit("^[\\x{0}-\\x{2FF}]*+\\z")), c).otherwise(F.translate(c, ALWAYS_ZERO_WIDTH + BIDI if bidi else ALWAYS_ZERO_WIDTH, ""))
    if zwnj:
        c = F.replace(c, F.lit(ZWNJ), F.lit(""))
    return F.replace(c, F.lit(ZWJ), F.lit("")) if zwj else c


def collapse_space(c: Column, remove: bool = False) -> Column:
    # a table of characters is faster than a class of a pattern, and a single blank, by far the most frequent, is left as it is
    return F.translate(c, WHITE, "") if remove else F.trim(F.regexp_replace(F.translate(c, WHITE, " " * len(WHITE)), " {2,}", " "))


def fold_digits(c: Column, digit_sets: Sequence[str], to_native: bool = False) -> Column:
    """Between native and Latin digits by place; sets that haven't ten characters are ignored."""
    for s in digit_sets:
        if len(s) == 10:
            c = F.translate(c, LATIN_DIGITS, s) if to_native else F.translate(c, s, LATIN_DIGITS)
    return c


def strip_punctuation(c: Column, keep: Sequence[str] = ()) -> Column:
    """Without punctuation and symbols, but for those that an orthography uses as letters."""
    kept = "".join(f"\\x{{{ord(k):X}}}" for k in keep)
    return F.regexp_replace(c, f"[\\p{{P}}\\p{{S}}&&[^{kept}]]" if kept else "[\\p{P}\\p{S}]", "")


def scoring_form(c: Column, *, digit_sets: Sequence[str] = (), keep: Sequence[str] = (), keep_punctuation: bool = False, case_fold: bool = True, strip_space: bool = False, zwnj: bool = False, zwj: bool = False,
                 needs_converter: bool = False, converter: Callable[[Column], Column] | None = None, compose: bool = True) -> Column:
    """The form that texts are scored in: NFC, legacy encoding, zero width, digits, case, punctuation, white space.

    Without the converter that a legacy encoding needs it raises, since scoring unconverted text gives wrong rates.
    """
    if needs_converter and converter is None:
        raise ValueError("this profile needs an encoding converter, and none was given")
    if compose:
        c = nfc(c)
    if needs_converter:
        c = nfc(converter(c))
    c = fold_digits(strip_zero_width(c, zwnj, zwj, bidi=True), digit_sets)
    if case_fold:
        c = F.lower(c)
    if not keep_punctuation:
        c = strip_punctuation(c, keep)
    return collapse_space(c, strip_space)


def profiled_form(c: Column, strip_space: Column, zwnj: Column, zwj: Column, native_digits: Column) -> Column:
    """scoring_form by columns of a profile, so that one plan scores all languages; null without a profile. Digit sets that haven't ten characters are ignored."""
    c = strip_zero_width(nfc(c), bidi=True)
    c = F.when(zwnj, F.replace(c, F.lit(ZWNJ), F.lit(""))).otherwise(c)
    c = F.when(zwj, F.replace(c, F.lit(ZWJ), F.lit(""))).otherwise(c)
    folded = c
    for place, digit in enumerate(LATIN_DIGITS, 1):
        folded = F.replace(folded, F.substring(native_digits, place, 1), F.lit(digit))
    c = F.when(F.length(native_digits) == 10, folded).otherwise(c)
    c = strip_punctuation(F.lower(c))
    return F.when(strip_space, collapse_space(c, True)).when(~strip_space, collapse_space(c))


Normaliser = Callable[[Column], Column]
#: Named steps that a language's chain may list; callers may add their own.
NORMALISERS: dict[str, Normaliser] = {
    "nfc": nfc,
    "zero-width": strip_zero_width,
    "whitespace": collapse_space,
    "no-whitespace": lambda c: collapse_space(c, True),
    "lower": F.lower,
    "punctuation": strip_punctuation,
}


def chain(c: Column, ids: Sequence[str]) -> Column:
    """The named steps in order; an unknown name raises."""
    unknown = [i for i in ids if i not in NORMALISERS]
    if unknown:
        raise KeyError(f"no such normaliser: {', '.join(unknown)}")
    return reduce(lambda x, i: NORMALISERS[i](x), ids, c)


def _clock_parts(ms: Column) -> list[Column]:
    a = F.abs(F.round(ms)).cast("long")
    return [F.floor(a / 3_600_000), F.floor(a / 60_000) % 60, F.floor(a / 1000) % 60, a % 1000]


def normalised_segments(segments: DataFrame, ids: Sequence[str], joiner: str = " ", needs: Column | None = None, converter: Callable[[Column], Column] | None = None) -> DataFrame:
    """segments with text and words (an array of strings) normalised, text_raw as it came, and whether it was converted.

    needs tells which texts are in a legacy encoding; those are converted first, word by word where there are words.
    """
    if needs is not None and converter is None:
        raise ValueError("texts in a legacy encoding need a converter")
    out = segments.withColumns({"text_raw": F.col("text"), "converted": F.lit(False) if needs is None else F.coalesce(needs, F.lit(False))})
    if needs is not None:
        words = F.when(F.col("converted"), F.transform("words", converter)).otherwise(F.col("words"))
        out = out.withColumn("words", words).withColumn("text", F.when(~F.col("converted"), F.col("text")).when(F.size("words") > 0, F.array_join("words", joiner)).otherwise(converter(F.col("text"))))
    # a step that needs Python can't run inside an array, so words go through it joined by a character that texts have not
    mark = "\x1f"
    joined = F.array_join(F.transform("words", lambda w: F.replace(w, F.lit(mark), F.lit(""))), mark)
    if "nfc" in ids:
        out = out.withColumn("words", F.when(F.size("words") > 0, F.split(nfc(joined), mark)).otherwise(F.col("words")))
    rest = [i for i in ids if i != "nfc"]
    return out.withColumns({"text": chain(F.col("text"), ids), "words": F.transform("words", lambda w: chain(w, rest))})


def clock(ms: Column, with_ms: bool = True, always_hours: bool = False) -> Column:
    """[-][hh:]mm:ss[.mmm]; every part has two digits at least."""
    h, m, s, rest = _clock_parts(ms)
    long = F.format_string("%02d:%02d:%02d", h, m, s)
    text = long if always_hours else F.when(h > 0, long).otherwise(F.format_string("%02d:%02d", m, s))
    if with_ms:
        text = F.concat(text, F.format_string(".%03d", rest))
    return F.concat(F.when(F.round(ms) < 0, "-").otherwise(""), text)


def subtitle_time(ms: Column, separator: str = ",") -> Column:
    """hh:mm:ss,mmm; a time before the start is the start."""
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", *_clock_parts(F.greatest(ms, F.lit(0))))


def parse_clock(c: Column) -> Column:
    """[-][h:]m:s[.fraction] in milliseconds; the fraction is filled up on the right; null for anything else."""
    pattern = "^(-)?(?:(\\d+):)?(\\d{1,2}):(\\d{1,2})(?:[.,](\\d{1,3}))?$"
    part = lambda i: F.regexp_extract(F.trim(c), pattern, i)
    number = lambda x: F.when(x == "", F.lit(0)).otherwise(x.try_cast("long"))
    ms = ((number(part(2)) * 60 + number(part(3))) * 60 + number(part(4))) * 1000 + number(F.rpad(part(5), 3, "0"))
    return F.when(F.trim(c).rlike(pattern), F.when(part(1) == "-", -ms).otherwise(ms))


def human_duration(seconds: Column) -> Column:
    """Minutes and seconds, without hours, 60 seconds carried; a dash for nothing and less."""
    minutes = F.floor(seconds / 60).cast("long")
    rest = F.round(seconds - minutes * 60).cast("long")
    return F.when(seconds <= 0, "—").otherwise(F.format_string("%dm %02ds", minutes + (rest == 60).cast("long"), rest % 60))


def slug(c: Column, fallback: str = "item") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(nfc(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", fallback).otherwise(s)


def content_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Sorted keys, so that equal parameters have equal digests."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _number_text(x: int | float) -> str:
    """A number as the shortest digits of its double, without an exponent from 1e-6 up to below 1e21."""
    x = float(x)
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return "0" if x == 0 else format(Decimal(repr(x)), "f").removesuffix(".0")
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        return mantissa
    if -7 < int(exponent) < 0:
        return format(Decimal(repr(x)), "f")
    return f"{mantissa.removesuffix('.0')}e{int(exponent):+d}"


def _canonical(value: object) -> str:
    if isinstance(value, dict):
        order = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join([f"{_canonical(k)}:{_canonical(value[k])}" for k in order]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    if isinstance(value, str):
        return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m.group()):04x}", json.dumps(value, ensure_ascii=False))
    if value is None or isinstance(value, bool):
        return "null" if value is None else "true" if value else "false"
    return _number_text(value)


@F.pandas_udf(StringType())
def _canonical_text(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            return None if x is None else _canonical(json.loads(x))
        except (ValueError, RecursionError):
            return None

    return s.map(one)


def canonical_text(c: Column) -> Column:
    """JSON text with the keys of every object, at every depth, in the order of their code units, arrays as they are, no blanks; null for what is no JSON. Of a repeated key the last value counts. Spark's functions can't recurse, so this is Python by Arrow batches."""
    return _canonical_text(c)


def params_hash(params: Column) -> Column:
    """Digest of parameters given as JSON text: equal however their keys were put in. ``to_json`` of a struct leaves out null fields, as undefined ones are; a null in the text stays."""
    return F.sha2(canonical_text(params), 256)


def common_prefix_length(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(acc))


def strip_prompt_echo(text: Column, prompt: Column, least: int = 12) -> Column:
    """A text that begins, after blanks, with at least so many characters of its prompt loses them, and separators after them."""
    body = F.regexp_replace(text, f"^{SPACE}", "")
    n = common_prefix_length(body, prompt)
    rest = F.regexp_replace(F.substr(body, n + 1), f"^(?:{SPACE}|[,.;:—–-])+", "")
    return F.when(n >= least, rest).otherwise(text)


def times_u32(x: Column, y: Column) -> Column:
    """Low 32 bits of the product of two 32-bit numbers."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    return (low * y + F.shiftleft((high * y).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def seeded_uniform(df: DataFrame, seed: int, draw: Column, name: str) -> DataFrame:
    """Adds draw 1, 2, ... of the seeded generator, in [0, 1). Its state rises by a constant, so a draw is a function of its number.

    Steps are columns of their own: as one expression each step would be written out once for every use.
    """
    mask = F.lit(0xFFFFFFFF)
    a, t = F.col("_a"), F.col("_t")
    state = (F.lit(seed & 0xFFFFFFFF) + times_u32(draw.cast("long").bitwiseAND(mask), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(mask)
    out = df.withColumn("_a", state)
    out = out.withColumn("_a", a.bitwiseXOR(F.shiftright(a, 15))).withColumn("_t", times_u32(a, state.bitwiseOR(F.lit(1))))
    out = out.withColumn("_a", t.bitwiseXOR(F.shiftright(t, 7))).withColumn("_a", times_u32(a, t.bitwiseOR(F.lit(61))))
    out = out.withColumn("_t", (t + a).bitwiseAND(mask).bitwiseXOR(t))
    return out.withColumn(name, t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)).drop("_a", "_t")


def offset_ms(c: Column) -> Column:
    """'1.5s', a number's text, or a JSON object with seconds and nanos, in milliseconds; null otherwise."""
    text = F.rtrim(F.regexp_replace(F.trim(c), "s$", ""))
    parts = F.from_json(c, "seconds string, nanos long")
    plain = F.when(text.rlike("^-?\\d+(\\.\\d+)?$"), text.cast("double") * 1000)
    nested = F.when(c.startswith("{") & (parts["seconds"].isNotNull() | parts["nanos"].isNotNull()), F.coalesce(parts["seconds"].cast("double"), F.lit(0.0)) * 1000 + F.coalesce(parts["nanos"], F.lit(0)) / 1e6)
    return F.round(F.coalesce(plain, nested)).cast("long")


def billed_seconds(c: Column) -> Column:
    return F.when(c.rlike("^\\d+(\\.\\d+)?s$"), F.regexp_replace(c, "s$", "").cast("double"))


def overlap_ms(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def confidence_of(mean_log_probability: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(mean_log_probability)))


#: Entity tokens. Runs of capitals; digits, with separators only before further digits; Latin words in other scripts.
CAPITALS, NUMBERS = "\\p{Lu}{2,}", "\\d+(?:[.,:/\\x{66B}\\x{66C}]\\d+)*"
LATIN_TOKENS = "(?<![\\p{IsLatin}\\p{M}])\\p{IsLatin}[\\p{IsLatin}\\p{M}'’-]*"


def entities(c: Column, latin: bool = True) -> Column:
    """Entity tokens in order. In a language that is not written in Latin letters, words that are count as well."""
    return F.regexp_extract_all(c, F.lit("|".join([CAPITALS, NUMBERS] if latin else [CAPITALS, NUMBERS, LATIN_TOKENS])), F.lit(0))


def graphemes(c: Column) -> Column:
    """Extended grapheme clusters, in order."""
    return F.regexp_extract_all(c, F.lit("\\X"), F.lit(0))


def token_form(c: Column) -> Column:
    """A word as alignments compare it: NFC, without punctuation and symbols, in lower case, trimmed."""
    return F.regexp_replace(F.lower(strip_punctuation(nfc(c))), f"^{SPACE}|{SPACE}$", "")


def tokens(words: Column, segmentation: str = "spaces") -> Column:
    """array of (token, owner) of an array of token forms: whole words, or their graphemes where words are not set apart by spaces.

    owner is the place of the word; words of which nothing is left have no token.
    """
    placed = F.transform(words, lambda w, i: F.transform(F.array(w) if segmentation == "spaces" else graphemes(w), lambda t: F.struct(t.alias("token"), i.alias("owner"))))
    return F.filter(F.flatten(placed), lambda x: x["token"].rlike("\\S"))


def dice(matched: Column, a: Column, b: Column) -> Column:
    """Share of the units of two sequences that are matched; 1 for two empty ones."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise(2 * matched / (a + b))


def joined_words(words: Column, joiner: str = " ") -> Column:
    """The words of a segment as its text: by blanks, or by nothing in scripts without them."""
    return F.array_join(words, joiner)


def reply_segments(reply: Column) -> Column:
    """map<int,string> of a model's reply {"segments": [{"idx", "text"}]} or the list alone; the first answer of an idx stands.

    A code fence is taken off, and what stands before and after the outermost object or list. A reply that can't be
    read, or has no usable segment, is null and never the input.
    """
    fenced = F.regexp_extract(reply, "```(?:json)?\\s*([\\s\\S]*?)```", 1)
    body = F.trim(F.when(reply.rlike("```(?:json)?\\s*[\\s\\S]*?```"), fenced).otherwise(reply))
    body = F.regexp_replace(body, "^[^\\[{]+", "")
    listed = body.startswith("[")
    body = F.when(listed, F.regexp_extract(body, "^[\\s\\S]*\\]", 0)).otherwise(F.regexp_extract(body, "^[\\s\\S]*\\}", 0))
    rows = F.when(listed, F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")).otherwise(F.try_variant_get(F.try_parse_json(body), "$.segments", "array<variant>"))
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    whole = lambda v: kind(v, "$.idx").isin("BIGINT") | (F.try_variant_get(v, "$.idx", "double") % 1 == 0) & kind(v, "$.idx").rlike("DECIMAL|DOUBLE")
    good = F.filter(rows, lambda v: F.coalesce(whole(v) & (kind(v, "$.text") == "STRING"), F.lit(False)))
    pairs = F.transform(good, lambda v: F.struct(F.try_variant_get(v, "$.idx", "double").cast("int").alias("idx"), F.try_variant_get(v, "$.text", "string").alias("text")))
    first = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda y: y["idx"] == x["idx"]))
    return F.when(F.size(first) > 0, F.map_from_entries(first))


def merge_json(a: Column, b: Column) -> Column:
    """Object merge; b's keys win."""
    parsed = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.map_filter(parsed(b), lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(parsed(a), lambda k, v: ~F.map_contains_key(new, k)), new)


def merge_json_at(a: Column, key: str, patch: Column) -> Column:
    """a's members, and as the member key a's own object with those of patch over it; an absent one is made. A map of JSON texts.

    Members of what lies deeper are replaced as a whole.
    """
    inner = F.get_json_object(a, f"$['{key}']")
    return F.map_concat(F.map_filter(F.coalesce(F.from_json(a, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: k != key), F.create_map(F.lit(key), F.to_json(merge_json(inner, patch))))
