"""Corpus statistics as mergeable states, to which a caller adds their own.

A statistic says what one pair of texts contributes, as named columns; how contributions merge, as an aggregate that
Spark computes in parts (a sum, unless it says otherwise); and how the merged state is finished into a value. Any number
of them are computed over the same pairs in one pass, and only states are shuffled.

    register(Statistic("empty", lambda hyp, ref: {"n": F.lit(1), "empty": (hyp == "").cast("long")}, lambda s: s["empty"] / s["n"]))
    corpus(pairs, ["lang"], ["cer", "empty"])
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.functions import metrics as M


@dataclass(frozen=True)
class Statistic:
    """name; contribution of (hyp, ref); finish of the merged state; merges of the states that are not summed."""

    name: str
    contribution: Callable[[Column, Column], dict[str, Column]]
    finish: Callable[[dict[str, Column]], Column]
    merges: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


_KNOWN: dict[str, Statistic] = {}


def register(statistic: Statistic) -> None:
    """Make a statistic known under its name; a name can't be given twice."""
    if statistic.name in _KNOWN and _KNOWN[statistic.name] is not statistic:
        raise ValueError(f"there is a statistic {statistic.name} already")
    _KNOWN[statistic.name] = statistic


def corpus(pairs: DataFrame, by: Sequence[str], statistics: Sequence[str | Statistic], hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """by and one column for each statistic, named after it. Null texts are empty ones."""
    chosen = [s if isinstance(s, Statistic) else _KNOWN[s] for s in statistics]
    if len({s.name for s in chosen}) < len(chosen):
        raise ValueError("a statistic is asked for twice")
    h, r = (F.coalesce(F.col(c), F.lit("")) for c in (hyp, ref))
    states = {s.name: s.contribution(h, r) for s in chosen}
    rows = pairs.select(*by, *[c.alias(f"_{s}_{k}") for s, own in states.items() for k, c in own.items()])
    merged = rows.groupBy(*by).agg(*[s.merges.get(k, F.sum)(F.col(f"_{s.name}_{k}")).alias(f"_{s.name}_{k}") for s in chosen for k in states[s.name]])
    return merged.select(*by, *[s.finish({k: F.col(f"_{s.name}_{k}") for k in states[s.name]}).alias(s.name) for s in chosen])


def _characters(hyp: Column, ref: Column) -> dict[str, Column]:
    return {"edits": M.char_edits(hyp, ref), "total": F.length(ref).cast("long")}


def _words(hyp: Column, ref: Column) -> dict[str, Column]:
    counts = M.word_counts(hyp, ref)
    return {"edits": counts["edits"], "total": counts["words"]}


def _grams(char_order: int = 6, word_order: int = 0) -> tuple[Callable[[Column, Column], dict[str, Column]], Callable[[dict[str, Column]], Column]]:
    kinds = [("c", n) for n in range(char_order)] + [("w", n) for n in range(word_order)]

    def contribution(hyp: Column, ref: Column) -> dict[str, Column]:
        counts = {"c": M.ngram_stats(char_order)(M.packed(hyp), M.packed(ref))}
        if word_order:
            counts["w"] = M.ngram_stats(word_order, True)(M.edge_words(hyp), M.edge_words(ref))
        return {f"{k}{n}_{i}": F.get(counts[k], F.lit(3 * n + i)) for k, n in kinds for i in range(3)}

    return contribution, lambda s: M.chrf([tuple(s[f"{k}{n}_{i}"] for i in range(3)) for k, n in kinds])


_rate = lambda s: M.rate(s["edits"], s["total"])
for _s in (Statistic("cer", _characters, _rate), Statistic("wer", _words, _rate), Statistic("chrf", *_grams()), Statistic("chrf_words", *_grams(word_order=2))):
    register(_s)
