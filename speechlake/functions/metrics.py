"""Error rates of a pair of texts, as column expressions. An undefined rate is null, never 0, 1 or NaN."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from speechlake.functions import text as T
from speechlake.functions.text import SPACE

#: One private character for each distinct word of a pair.
_FIRST_PRIVATE = 0xF0000
#: Marks that the word order of chrF splits off.
EDGE_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: Characters of the pairs that are compared at once; of the texts whose words are numbered at once.
EDIT_CHARS, WORD_CHARS = 1 << 20, 1 << 22


def _edits(a: list[str] | list[np.ndarray], b: list[str] | list[np.ndarray]) -> np.ndarray:
    """Edits between code points, or between numbers, of pairs, many at once: of the table only diagonals near those that a pair has to pass."""
    la, lb = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    out, left, more = np.full(len(a), -1), np.arange(len(a)), 2
    while len(left):
        # pairs of about one length that pass the same diagonals stand together
        left = left[np.lexsort((lb[left] - la[left], np.maximum(la, lb)[left] // 32))]
        size, at = np.maximum.accumulate(np.maximum(la, lb)[left]) + 1, 0
        while at < len(left):
            end = at + max(1, int(np.searchsorted(size[at:] * np.arange(1, len(left) - at + 1), EDIT_CHARS, "right")))
            of, at = left[at:end], end
            found = _near_edits([a[i] for i in of], [b[i] for i in of], la[of], lb[of], more)
            # a way of n edits strays from the diagonals between its ends by half of what n has beyond their number
            sure = found <= np.abs(lb - la)[of] + 2 * more
            out[of[sure]] = found[sure]
        left, more = np.flatnonzero(out < 0), more * 4
    return out


def _table(side: list[str] | list[np.ndarray], size: np.ndarray, most: int) -> np.ndarray:
    """The units of a row's text in each row."""
    if isinstance(side[0], str):
        return np.frombuffer("".join(x.ljust(most, "\0") for x in side).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(side), most)
    out = np.zeros((len(side), most), np.uint32)
    out[np.arange(most) < size[:, None]] = np.concatenate(side)
    return out


def _near_edits(a: list, b: list, la: np.ndarray, lb: np.ndarray, more: int) -> np.ndarray:
    """The least edits of a way on the diagonals between a pair's ends and so many to both sides."""
    last, long = lb - la, [int(la.max()), int(lb.max())]
    low, high = max(min(0, int(last.min())) - more, -long[0]), min(max(0, int(last.max())) + more, long[1])
    points = [_table(side, size, most) for side, size, most in zip((a, b), (la, lb), long)]
    kind = np.uint16 if max(x.max(initial=0) for x in points) < 1 << 16 else np.uint32
    left, right = np.ascontiguousarray(points[0][:, ::-1].T, kind), np.ascontiguousarray(points[1].T, kind)
    far = long[0] + long[1] + 1
    n = np.full((high - low + 3, len(a)), far, np.int16 if far < 1 << 14 else np.int32)  # by diagonal, with one beyond at both sides
    n[1 - low], out = 0, np.where(la + lb == 0, 0, far)
    order = np.argsort(la + lb, kind="stable")
    ends = np.searchsorted((la + lb)[order], np.arange(far + 1))
    # cells whose places add up to s depend on those of s - 1 beside them and of s - 2 on their diagonal
    for s in range(1, far):
        lo, hi = max(low, -s, s - 2 * long[0]), min(high, s, 2 * long[1] - s)
        lo += (lo + s) % 2
        hi -= (hi + s) % 2
        if lo <= hi:
            i, j = (s - lo) // 2, (s + lo) // 2  # of the first diagonal; i falls and j rises from there
            beside = np.minimum(n[lo - low : hi - low + 1 : 2], n[lo - low + 2 : hi - low + 3 : 2]) + 1
            cells = n[lo - low + 1 : hi - low + 2 : 2]
            some = len(cells)
            first, skip = int(j == 0), int(i == some - 1)  # cells at the edges have no diagonal
            if some - first - skip > 0:
                x = long[0] - i + first
                unlike = left[x : x + some - first - skip] != right[j - 1 + first : j - 1 + some - skip]
                np.minimum(cells[first : some - skip] + unlike, beside[first : some - skip], out=beside[first : some - skip])
            cells[:] = beside
        of = order[ends[s] : ends[s + 1]]
        if len(of):
            out[of] = n[last[of] - low + 1, of]
    return out


@F.pandas_udf(LongType())
def _edits_of(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    known = (hyp.notna() & ref.notna()).to_numpy()
    out = pd.Series(pd.NA, index=hyp.index, dtype="Int64")
    out[known] = _edits(hyp[known].tolist(), ref[known].tolist())
    return out


def char_edits(hyp: Column, ref: Column) -> Column:
    """Edits between code points. The built-in distance walks a text anew for each row of its table, so batches of pairs are compared instead."""
    return F.when(hyp == ref, F.lit(0).cast("long")).otherwise(_edits_of(F.when(hyp != ref, hyp), ref))


#: Characters in which Arrow's white space and SPACE differ.
_ODD_SPACE = "[\x1c-\x1f\x85\ufeff]"


def _numbered_words(texts: list[str]) -> list[np.ndarray]:
    """The words of each text as numbers, equal words of all texts with equal numbers."""
    column = pa.array(texts, pa.large_string())
    odd = pc.any(pc.match_substring_regex(column, pattern=_ODD_SPACE)).as_py()
    words = pc.split_pattern_regex(column, pattern=f"[{T.WHITE}]+") if odd else pc.utf8_split_whitespace(column)
    some = pc.binary_length(words.values).to_numpy(zero_copy_only=False) > 0
    number = pc.dictionary_encode(words.values).indices.to_numpy(zero_copy_only=False)[some].astype(np.uint32)
    ends = np.append(0, np.cumsum(some))[words.offsets.to_numpy()].tolist()
    return [number[lo:hi] for lo, hi in zip(ends, ends[1:])]


@F.pandas_udf(StructType([StructField("edits", LongType()), StructField("words", LongType())]))
def _word_counts_of(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    unknown = (hyp.isna() | ref.isna()).to_numpy()
    known, (edits, words) = np.flatnonzero(~unknown), np.zeros((2, len(hyp)), np.int64)
    h, r = (side.iloc[known].tolist() for side in (hyp, ref))
    lot = np.cumsum([len(a) + len(b) for a, b in zip(h, r)], dtype=np.int64) // WORD_CHARS
    starts = np.flatnonzero(np.diff(lot, prepend=-1)).tolist()
    for lo, hi in zip(starts, [*starts[1:], len(lot)]):
        numbers = _numbered_words(h[lo:hi] + r[lo:hi])
        a, b = numbers[: hi - lo], numbers[hi - lo :]
        edits[known[lo:hi]], words[known[lo:hi]] = _edits(a, b), [len(x) for x in b]
    return pd.DataFrame({"edits": pd.arrays.IntegerArray(edits, unknown), "words": pd.arrays.IntegerArray(words, unknown)})


def word_counts(hyp: Column, ref: Column) -> Column:
    """struct(edits, words): edits between the words of two texts, and words of the reference. Words are numbered, and batches of pairs compared at once, as char_edits does with characters."""
    return _word_counts_of(hyp, ref)


def _banded_edits(hyp: Column, ref: Column) -> Column:
    """As char_edits, where a function of Python can't stand: in a band about the difference of lengths, and in full where that is too narrow."""
    band = F.abs(F.length(hyp) - F.length(ref)) * 2 + 16
    near = F.filter(F.array(F.call_function("levenshtein", hyp, ref, band)), lambda n: n >= 0)  # below 0: beyond the band
    return F.coalesce(F.get(near, F.lit(0)), F.levenshtein(hyp, ref)).cast("long")


def rate(edits: Column, total: Column) -> Column:
    return edits / F.nullif(total, F.lit(0).cast("long"))


def cer(hyp: Column, ref: Column, edits: Column | None = None) -> Column:
    """Null for an empty reference, unless both are empty. edits: those of the pair, if they are known."""
    return F.when(F.length(ref) > 0, (char_edits(hyp, ref) if edits is None else edits) / F.length(ref)).when(F.length(hyp) == 0, F.lit(0.0))


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_edits(hyp: Column, ref: Column) -> Column:
    """Edits between units: every distinct unit of the pair becomes one character, and characters are compared."""
    as_text = lambda ws, alphabet: F.array_join(F.transform(ws, lambda w: _private(F.array_position(alphabet, w))), "")
    # the alphabet is bound to a name, so that it is made once a pair and not once a word
    return F.transform(F.array(F.array_distinct(F.concat(ref, hyp))), lambda al: _banded_edits(as_text(hyp, al), as_text(ref, al)))[0]


def grapheme_cer(hyp: Column, ref: Column, edits: Column | None = None) -> Column:
    """As cer, between grapheme clusters."""
    edits = char_edits(hyp, ref) if edits is None else edits
    h, r = T.graphemes(hyp), T.graphemes(ref)
    plain = (F.size(h) == F.length(hyp)) & (F.size(r) == F.length(ref))  # every cluster is one code point
    # of characters below U+0300 only a carriage return with a line feed makes a cluster
    single = F.lit("^(?:[\\x{0}-\\x{2FF}&&[^\\r]]|\\r(?!\\n))*+$")
    clusters = F.when(F.size(r) > 0, F.when(plain, edits).otherwise(word_edits(h, r)) / F.size(r)).when(F.size(h) == 0, F.lit(0.0))
    return F.when(F.rlike(hyp, single) & F.rlike(ref, single), cer(hyp, ref, edits)).otherwise(clusters)


def _private(n: Column) -> Column:
    """The n-th private character, from its UTF-8 bytes."""
    cp = n + F.lit(_FIRST_PRIVATE)
    byte = lambda shift, mask, lead: F.shiftright(cp, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(lead))
    whole = F.shiftleft(byte(18, 7, 0xF0), 24) + F.shiftleft(byte(12, 63, 0x80), 16) + F.shiftleft(byte(6, 63, 0x80), 8) + byte(0, 63, 0x80)
    return F.decode(F.unhex(F.hex(whole)), "UTF-8")


def wer(hyp: Column, ref: Column, segmentation: str = "spaces") -> Column:
    """struct(value, kind). Null where words are no unit of the language, or where only a dictionary could find them."""
    if segmentation != "spaces":
        return F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("kind"))
    counts = word_counts(hyp, ref)
    value = F.when(counts["words"] > 0, counts["edits"] / counts["words"]).when(counts["edits"] == 0, F.lit(0.0))
    return F.struct(value.alias("value"), F.lit("spaces").alias("kind"))


def packed(c: Column) -> Column:
    """Characters as chrF counts them: without white space."""
    return F.regexp_replace(c, SPACE, "")


def edge_words(c: Column) -> Column:
    """Words, with one mark at their end or else at their start split off; single characters stay."""
    marks = F.lit(EDGE_MARKS)

    def cut(w: Column) -> Column:
        last, first = F.right(w, F.lit(1)), F.left(w, F.lit(1))
        return (F.when(F.length(w) == 1, F.array(w)).when(F.contains(marks, last), F.array(F.substr(w, F.lit(1), F.length(w) - 1), last))
                .when(F.contains(marks, first), F.array(first, F.substr(w, F.lit(2)))).otherwise(F.array(w)))

    return F.flatten(F.transform(words(c), cut))


@cache
def ngram_stats(order: int, words: bool = False):
    """A UDF (hyp, ref) -> (hyp, ref, match) for n = 1 .. order: n-grams of each side of a pair, and those that both have.

    Where a pair's reference has none of an order, its hypothesis counts none either: there is nothing to be precise about.

    hyp and ref are packed texts, or with ``words`` arrays of words. Spark could only count grams as rows; here a batch of
    pairs is counted at once, units and grams as dense numbers.
    """

    def few(hyp: list, ref: list) -> list[np.ndarray]:
        n, sides = len(hyp), [x if x is not None else "" for x in [*hyp, *ref]]
        size = np.array([len(x) for x in sides], np.int64)
        if words:
            unit = pd.factorize(np.array([w for x in sides for w in x], dtype=object))[0].astype(np.int64)
        else:
            unit = np.frombuffer("".join(sides).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair, right = np.repeat(np.tile(np.arange(n), 2), size), np.repeat(np.repeat([False, True], n), size)
        left_in = np.repeat(np.cumsum(size), size) - np.arange(len(unit))  # units from here to the side's end
        out, gram, wide = np.zeros((n, order, 3), np.int64), pair.copy(), unit.max(initial=0) + 1
        for k in range(order):
            whole = np.flatnonzero(left_in > k)
            if not len(whole):
                break
            # numbers of the grams of a pair; the gram that it continues tells whose it is
            gram[whole] = code = pd.factorize(gram[whole] * wide + unit[whole + k])[0]
            side, most, of = right[whole], code.max() + 1, pair[whole]
            owner = np.empty(most, np.int64)
            owner[code] = of
            left, found = (np.bincount(code[side == x], minlength=most) for x in (False, True))
            out[:, k, 0], out[:, k, 1] = (np.bincount(of[side == x], minlength=n) for x in (False, True))
            out[:, k, 2] = np.bincount(owner, np.minimum(left, found), n)
        out[:, :, 0] *= out[:, :, 1] > 0
        return list(out.reshape(n, -1))

    @F.pandas_udf("array<long>")
    def count(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([x for lo in range(0, len(hyp), 1000) for x in few(hyp[lo : lo + 1000].tolist(), ref[lo : lo + 1000].tolist())], dtype=object)

    return count


def chrf(stats: list[tuple[Column, Column, Column]], beta: float = 2.0) -> Column:
    """F-score of summed (hyp, ref, match) by order: orders that lack either side drop out; none left is 0."""
    full = [(h > 0) & (r > 0) for h, r, _ in stats]
    orders = sum((f.cast("int") for f in full), F.lit(0))
    mean = lambda i: sum((F.when(f, s[2] / s[i]).otherwise(0.0) for f, s in zip(full, stats)), F.lit(0.0)) / F.nullif(orders, F.lit(0))
    p, r, b = mean(0), mean(1), beta * beta
    return F.coalesce(F.when(p + r > 0, 100 * (1 + b) * p * r / (b * p + r)), F.lit(0.0))
