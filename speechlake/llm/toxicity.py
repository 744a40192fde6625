"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability sigmoid(bias + sum of the weights of its distinct
words), a word's weight being that of itself and of its first letters (inflected forms share them), and the document
the noisy-or of its sentences: 1 - prod(1 - p). A score takes from each sentence what it has above the bias alone, so
that thousands of sentences without any sign don't add up. Only document labels are used in training; the
sentence scores that they imply tell which sentences offend.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechlake.llm.common import remainder, stored

#: The fit reads at most so many labelled documents of each class, those with the smallest hash of their id, as long as
#: the texts of the class have at most so many characters in all. Scoring has no bounds.
MAX_TOXIC, MAX_CLEAN, MAX_FIT_CHARS = 2_000, 5_000, 8_000_000
#: Bias of a sentence, and the probability of a document without any sign.
BIAS, LEAK = -6.0, 0.01
#: Words in fewer fitted documents than this have no weight.
MIN_DOCS = 8
THRESHOLD = 0.7
#: Lengths of the beginnings of words that have weights.
STEMS = (4, 5)

_SENTENCE = re.compile(r"[^.!?\n\r]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans between sentence ends and line ends."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def features(word: str) -> list[str]:
    """The word, and its beginnings, marked by a hyphen."""
    return [word] + [word[:n] + "-" for n in STEMS if len(word) > n]


def fit(texts: list[str], labels: np.ndarray, epochs: int = 100, rate: float = 0.1, l1: float = 3e-5) -> dict[str, float]:
    """Word weights by full-batch Adam on the leaky noisy-or likelihood. The result depends on the input only; without both classes there are no weights."""
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return {}
    own: dict[str, list[str]] = {}
    seen: Counter[str] = Counter()
    for t in texts:  # the texts are read twice, so that only numbers are held for all of them
        bag = words(t)
        for x in bag:
            if x not in own:
                own[x] = features(x)
        seen.update({f for x in bag for f in own[x]})
    vocab = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= MIN_DOCS))}
    numbers = {x: [vocab[f] for f in fs if f in vocab] for x, fs in own.items()}
    del own, seen
    feature, sent, doc = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        for a, b in sentences(t):
            for x in sorted(words(t[a:b])):
                feature.extend(numbers[x])
                sent.extend([len(doc)] * len(numbers[x]))
            doc.append(d)
    n_sent = len(doc)
    del numbers
    feature, sent, doc = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (feature, sent, doc))
    w = np.zeros(len(vocab))
    m, v = np.zeros_like(w), np.zeros_like(w)
    ground = 1 / (1 + np.exp(-BIAS))
    for step in range(1, epochs + 1):
        z = np.clip(BIAS + np.bincount(sent, w[feature], n_sent), -30, 30)
        sig = 1 / (1 + np.exp(-z))
        p = np.maximum(sig - ground, 0)
        clean = (1 - LEAK) * np.exp(np.bincount(doc, np.log1p(-p), len(labels)))
        # d loss / d z of a sentence: slope of p over 1 - p, for a toxic document times -clean / (1 - clean); what
        # lies below the bias counts for toxic documents only, so that it can rise again
        pull = np.where(labels > 0, -clean / (1 - clean), 1.0)[doc]
        slope = np.where((z >= BIAS) | (pull < 0), pull * sig * (1 - sig) / (1 - p), 0) / len(labels)
        g = np.bincount(feature, slope[sent], len(w))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / (np.sqrt(v / c2) + 1e-5), 0)
    return {x: float(w[i]) for x, i in vocab.items() if w[i]}


class WordWeights(dict):
    """A word's weight, worked out at its first lookup. Forgets when it grows large, so memory is bounded."""

    def __init__(self, weights: dict[str, float], most: int = 1_000_000):
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = z = sum(self.weights.get(f, 0.0) for f in features(word))
        return z


def bag_scores(text: str, weights: WordWeights) -> tuple[float, list[tuple[float, int, int]]]:
    """The document's score and (score, start, end) of its sentences; a text without sentences scores as an empty bag, LEAK."""
    out, clean, ground = [], math.log1p(-LEAK), 1 / (1 + math.exp(-BIAS))
    for a, b in sentences(text):
        z = BIAS
        for x in sorted(words(text[a:b])):  # in a fixed order, so that equal texts have equal sums
            z += weights[x]
        z = min(30.0, max(-30.0, z))
        p = max(0.0, 1 / (1 + math.exp(-z)) - ground)
        out.append((p, a, b))
        clean += math.log1p(-p)
    return -math.expm1(clean), out


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_FIT_CHARS) -> dict[str, float]:
    """Fit on a bounded sample of the labelled documents outside the held-out fold.

    Labels that are null or belong to no document are left out. The sample is a fixed function of the ids and lengths:
    rows by rising hash of their id, as long as the class stays within max_chars; longer rows are passed over whole.
    """
    left = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body"))
    right = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y is not null")
    right = right.where(remainder(F.col("id"), modulus) != held)
    pick = [right.where(cond).orderBy(F.xxhash64("id"), "id").limit(n) for cond, n in (("y = 1", max_toxic), ("y = 0", max_clean))]
    sample = stored(left.join(F.broadcast(pick[0].union(pick[1])), "id").where(F.length("body") <= max_chars), "toxicity-sample")
    # the sample has a bounded number of rows unless ids repeat, and only their lengths are summed
    order = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id", "n", "d")
    sized = sample.select("id", "y", F.length("body").cast("long").alias("n"), F.md5("body").alias("d")).distinct()
    fits = sized.withColumn("all", F.sum("n").over(order)).where(F.col("all") <= max_chars).select("id", "y", "d")
    rows = sample.withColumn("d", F.md5("body")).join(fits, ["id", "y", "d"]).select("id", "y", "body").distinct().orderBy("id", "y", "body").collect()
    return fit([r.body for r in rows], np.array([r.y for r in rows]))


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, worst_start, worst_end, worst_score for every row.

    A null text counts as empty and, like any text without a sentence, scores LEAK. A null id is not held out.
    Repeated rows are scored each. worst_*: the most offending sentence (characters; the first of ties), null without one.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, modulus, held))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = WordWeights(model.value)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                score, parts = bag_scores(text, weights)
                p, a, b = max(parts, key=lambda x: x[0], default=(None, None, None))
                rows.append((score, int(score >= threshold), len(parts), a, b, p))
            out = pd.DataFrame(rows, columns=["score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_score"], index=pdf.index)
            yield pd.concat([pdf[["doc_id", "held_out"]], out.astype({"worst_start": "Int64", "worst_end": "Int64", "worst_score": float})], axis=1)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"))
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int, n_sentences int, worst_start int, worst_end int, worst_score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, as they are, whose score is below the threshold.

    Rows without an id and rows that repeat are judged each; a null or empty text is kept. Only texts go to Python, and
    scores come back: the other columns, of whatever names and types, stay where they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = WordWeights(model.value)
        for texts in batches:
            yield pd.Series([bag_scores(t or "", weights)[0] for t in texts], dtype=float)

    return docs.where(score("text") < threshold)


def offending_sentences(docs: DataFrame, model: dict[str, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end, sentence, score of every sentence at or above the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = WordWeights(sent.value)
        for pdf in batches:
            rows = [(i, a, b, t[a:b], p) for i, t in zip(pdf["doc_id"], pdf["text"]) for p, a, b in bag_scores(t, weights)[1] if p >= threshold]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "sentence", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, start int, end int, sentence string, score double")
