"""Document fingerprints by SimHash, with DataFrame functions only.

Terms are runs of five words (a text's last words begin shorter runs, so short texts have terms as well), each weighted
by how often it occurs. Every occurrence of a term votes with the bits of its 64-bit hash, plus for 1 and minus for 0;
the signs of the sums are the fingerprint. The 64 sums are kept as 32 whole numbers of two lanes, which one
aggregation with a map-side part adds up.

Fingerprints within a Hamming radius are found by block tables: cut into more blocks than the radius, two such
fingerprints agree in all but ``radius`` blocks, so a table for every choice of the other blocks meets every pair.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import discard, keyed, mark_of, places, release, stored, text_of

WORDS = 5
SPACES = "[\\x20\\x09-\\x0D]+"
BITS, LANES = 64, 32
_LANE_MASK = (1 << LANES) | 1


def fingerprints(texts: DataFrame, keys: list[str], words: int = WORDS) -> DataFrame:
    """keys, fingerprint (long) of a table with a column text. A text without words has fingerprint 0."""
    tokens = F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACES), "")
    listed = texts.select(*keys, tokens.alias("w"))
    runs = F.arrays_zip(*[F.when(F.size("w") > i, F.slice("w", i + 1, F.size("w"))).otherwise(F.array().cast("array<string>")) for i in range(words)])
    names = [f"w{i}" for i in range(words)]
    terms = listed.select(*keys, F.inline_outer(runs).alias(*names))
    hashed = terms.select(*keys, F.xxhash64(*names).alias("h"), F.col("w0").isNotNull().cast("long").alias("n"))
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANE_MASK)) * F.col("n")).alias(f"s{j}") for j in range(LANES)]
    votes = hashed.groupBy(*keys).agg(F.sum("n").alias("n"), *lanes)
    low = (1 << LANES) - 1
    bits = []
    for j in range(LANES):
        for at, count in ((j, F.col(f"s{j}").bitwiseAND(F.lit(low))), (j + LANES, F.shiftrightunsigned(f"s{j}", LANES))):
            bits.append(F.when(2 * count > F.col("n"), F.lit(_signed(1 << at))).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The edited text ends with the first characters of the next document in place of its own last quarter. Null texts
    are empty. Rows equal in id and text are one document; rows that share an id but not the text are documents of their
    own, as are rows without an id, which come last. Other columns are ignored.
    """
    plain = text_of(docs).withColumn("mark", mark_of())
    at = places(plain.select("mark", "doc_id"))
    total = F.lit(max(1, at.count()))
    before, after = F.pmod(F.col("key") - 1, total), F.pmod(F.col("key") + 1, total)
    n = F.length("text")
    take = F.floor(n / 4).cast("int")
    # a document's beginning goes to the one before it, as long as that one's quarter: rows of numbers say how long, so texts are sent but once to their place and once to their neighbour
    one = plain.groupBy("mark").agg(F.first("text").alias("text"))
    lengths = stored(at.join(plain.select("mark", take.alias("take")).distinct(), "mark").select("key", "take"), "simhash-lengths")
    placed = at.join(lengths.select(after.alias("key"), F.col("take").alias("asked")), "key")
    rows = stored(one.join(placed, "mark").select("key", "doc_id", "text", "asked"), "simhash-texts")
    discard(at, lengths)
    release(docs.sparkSession)
    given = rows.select(before.alias("key"), F.expr("substring(text, 1, asked)").alias("given"))
    both = rows.join(given, "key").select("key", "doc_id", "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - take), "given").alias("edited"))
    # what the result needs of a text goes with its votes, which stay where the join has put the text
    digests = both.select("key", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("x"))
    kept = ["key", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprints(digests.select(*kept, "x.which", "x.text"), [*kept, "which"])
    prints = prints.groupBy(*kept).agg(*[F.max(F.when(F.col("which") == i, F.col("fingerprint"))).alias(name) for i, name in enumerate(("own", "edited"))])
    found = stored(prints, "simhash-prints")
    discard(rows)
    following = found.select(before.alias("key"), F.col("own").alias("next"))
    return found.join(following, "key").select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(query_fingerprint, fingerprint, distance) of all stored fingerprints within the radius of a query, its own included.

    Both inputs have a long column fingerprint; equal ones count once, null ones not at all. More blocks than
    radius + 1 make more tables with longer keys: choose them so that a key is seldom shared by chance.
    """
    blocks = blocks or radius + 3
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def keys(df: DataFrame, name: str) -> DataFrame:
        cut = [F.shiftrightunsigned("fingerprint", edges[i]).bitwiseAND(F.lit(_signed((1 << (edges[i + 1] - edges[i])) - 1))) for i in range(blocks)]
        tables = [F.struct(F.lit(t).alias("t"), F.xxhash64(*[cut[i] for i in chosen]).alias("key")) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
        distinct = df.select("fingerprint").where("fingerprint is not null").distinct()
        return distinct.select(F.col("fingerprint").alias(name), F.inline(F.array(*tables)))

    pairs = keys(queries, "query_fingerprint").join(keys(prints, "fingerprint"), ["t", "key"])
    distance = F.bit_count(F.col("query_fingerprint").bitwiseXOR(F.col("fingerprint")))
    return pairs.select("query_fingerprint", "fingerprint", distance.alias("distance")).where(F.col("distance") <= radius).distinct()


def neighbours(docs: DataFrame, is_query: Column, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint, class_id, class_size, distance: the classes of equal fingerprints within the radius of each query document.

    class_id is the smallest id with the fingerprint, so a document's own class is the row with distance 0; members of a
    class are the documents with its fingerprint. is_query is a condition on doc_id; documents without an id are
    neither queries nor representatives. Repeated rows, nulls and other columns count as in document_fingerprints.
    """
    rows = keyed(docs)
    prints = stored(rows.select("key", "doc_id").join(fingerprints(rows.select("key", "text"), ["key"]), "key"), "simhash-all")
    discard(rows)
    classes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "simhash-classes")
    queries = prints.where(is_query)
    found = within_radius(queries, classes, radius)
    near = found.join(classes, "fingerprint").select("query_fingerprint", "class_id", "class_size", "distance")
    asked = queries.select("doc_id", F.col("fingerprint").alias("query_fingerprint")).distinct()
    return asked.join(near, "query_fingerprint").select("doc_id", as_text(F.col("query_fingerprint")).alias("fingerprint"), "class_id", "class_size", "distance")
