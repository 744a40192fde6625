"""Repair of conversation structure by a run-length dynamic program over min-plus transitions.

A row of a conversation is a symbol: what its role starts with, and whether it must go (blank, duplicate), is cut
short, or is sound. Edits lead through the states of the pattern ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
Each symbol is a 4 x 4 matrix of least costs in the min-plus semiring, inserts before the row included. Equal symbols
that follow each other are one run, and a run of n rows moves a vector of costs by the cached powers T^(2^i) of its
matrix that n is the sum of. From the costs at the ends of runs the edits are unrolled row by row; since an edit's
letter leads to one state alone, taking the smallest letter that keeps the least cost gives the ASCII-least audit.

Rows are dealt by ranges of (conversation, turn, role, digest of the text), so a conversation of any size is spread
over tasks. One that begins and ends inside a range is solved where it is. All others become pieces of bounded size;
their duplicates are found by a join of digests, their matrices multiply in any grouping, every piece is unrolled from
each of the four states, and the states are then chained over the pieces. Only the audit and the hash of one
conversation go through one task, a piece at a time, as a string and a hash are one value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import discard, shuffle_partitions, stored

FAR = 1 << 40
KEEP, RELABEL, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role leads from each state, or None.
STEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role that an inserted or relabelled row takes in each state.
FITTING = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
ENDS = (NOTHING, ASSISTANT)
BLANKS = " \t\n\x0b\x0c\r"
#: Rows and characters of a piece.
PIECE_ROWS, PIECE_CHARS = 20_000, 1_000_000

Matrix = tuple[tuple[int, ...], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(x + y for x, y in zip(row, column)), FAR) for column in zip(*b)) for row in a)


def moved(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple([min(min(x + y for x, y in zip(row, v)), FAR) for row in a])


UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


def _inserts() -> Matrix:
    """Least costs of reaching a state from another by inserted rows alone."""
    one = tuple(tuple(INSERT if STEPS[FITTING[i][0]].get(i) == j else UNIT[i][j] for j in range(4)) for i in range(4))
    return times(times(one, one), one)


INSERTS = _inserts()
#: Least cost of ending well from each state once no row is left.
AT_END = moved(INSERTS, tuple(0 if s in ENDS else FAR for s in range(4)))


def choices(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of what may be done with a row of this symbol, letters rising."""
    yield "D", DELETE, state
    role, fault = symbol[0], symbol[1]
    if fault == "x":
        return
    extra = CUT if fault == "t" else 0
    if (to := STEPS.get(role, {}).get(state)) is not None:
        yield "K", KEEP + extra, to
    yield "R", RELABEL + extra, STEPS[FITTING[state][0]][state]


@cache
def power(symbol: str, exponent: int) -> Matrix:
    """The symbol's transition to the power 2^exponent."""
    if exponent:
        return times(power(symbol, exponent - 1), power(symbol, exponent - 1))
    row = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in choices(symbol, state):
            row[state][to] = min(row[state][to], cost)
    return times(INSERTS, tuple(map(tuple, row)))


def over_run(symbol: str, n: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs before a run of n equal symbols, from those after it."""
    for i in range(n.bit_length()):
        if n >> i & 1:
            v = moved(power(symbol, i), v)
    return v


def product(runs: list[tuple[str, int]]) -> Matrix:
    out = UNIT
    for symbol, n in runs:
        for i in range(n.bit_length()):
            if n >> i & 1:
                out = times(out, power(symbol, i))
    return out


def collapsed(symbols: list[str]) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for s in symbols:
        out[-1:] = [(s, out[-1][1] + 1)] if out and out[-1][0] == s else [*out[-1:], (s, 1)]
    return out


def unrolled(runs: list[tuple[str, int]], state: int, after: tuple[int, ...], last: bool) -> tuple[str, int, int]:
    """The ASCII-least audit of the cheapest edits from a state, its end state and the cost: all of it if these are the last rows, else up to ``after``, the costs from there on."""
    bounds = [AT_END if last else after]
    for symbol, n in reversed(runs):
        bounds.append(over_run(symbol, n, bounds[-1]))
    bounds.reverse()
    letters: list[str] = []
    total = bounds[0][state]

    def insert(to_go: tuple[int, ...]) -> None:
        nonlocal state
        letters.append("I")
        to = STEPS[FITTING[state][0]][state]
        assert to_go[state] == INSERT + to_go[to]
        state = to

    for (symbol, n), end in zip(runs, bounds[1:]):
        inside = [end]
        for _ in range(n - 1):
            inside.append(moved(power(symbol, 0), inside[-1]))
        for left in reversed(inside):
            here = moved(power(symbol, 0), left)
            while True:
                found = {letter: to for letter, cost, to in choices(symbol, state) if cost + left[to] == here[state]}
                if "D" in found or here[state] != INSERT + here[STEPS[FITTING[state][0]][state]]:
                    letter = min(found)
                    letters.append(letter)
                    state = found[letter]
                    break
                insert(here)
    while last and AT_END[state]:
        insert(AT_END)
    return "".join(letters), state, total - (0 if last else after[state])


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> list[str]:
    """The ``role:text`` lines that an audit from a state leaves."""
    rows, out = iter(zip(roles, texts)), []
    for letter in audit:
        role, text = (FITTING[state], "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        role = FITTING[state] if letter == "R" else role
        out.append(f"{role}:{text}")
        state = STEPS[role[0]][state]
    return out


def fault_of(text: str, again: bool) -> str:
    """b(lank), d(uplicate), t(runcated) or - of a row; the first that holds."""
    kept = text.strip(BLANKS)
    return "b" if not kept else "d" if again else "-" if kept[-1] in ".!?" else "t"


def symbols_of(roles: list[str], faults: str) -> list[str]:
    return [(r[0] if r[:1] in ("s", "u", "a") and r else "?") + ("x" if f in "bd" else f) for r, f in zip(roles, faults)]


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies of each row: 0 for a dropped one, 2 for a repeated one. Nulls are read as one space, but in ``conv`` and ``turn`` they stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    spelt = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    lot = F.crc32(F.concat(spelt[0], F.lit(":"), spelt[1]).cast("binary")) % 20
    return rows.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.when(lot == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(lot.isin(0, 1), F.lit("")).when(lot == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).alias("copies"),
    )


_ANSWER = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
_PIECE = {"part": pa.int64(), "piece": pa.int64(), "turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "again": pa.list_(pa.int32())}
_TYPES = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE_TYPES = "part long, piece long, turns array<long>, roles array<string>, texts array<string>, again array<int>"


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _again(roles: list[str], texts: list[str]) -> list[bool]:
    seen: set[tuple[str, str]] = set()
    return [(x in seen) or seen.add(x) is not None for x in zip(roles, texts)]


def solved(turns: list[int | None], roles: list[str], texts: list[str]) -> tuple:
    """The answer for all rows of one conversation, in order."""
    faults = "".join(map(fault_of, texts, _again(roles, texts)))
    audit, _, cost = unrolled(collapsed(symbols_of(roles, faults)), NOTHING, AT_END, True)
    lines = "\n".join(repaired(roles, texts, audit, NOTHING))
    return _gaps(turns), faults.count("b"), faults.count("d"), faults.count("t"), illegal_pairs([r[:1] for r in roles]), cost, audit, hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest()


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def _in_ranges(batches: Iterator[pa.RecordBatch], piece_rows: int) -> Iterator[pa.RecordBatch]:
    """Of the sorted rows of a range: answers of conversations that begin and end in it, pieces of all others."""
    part, number, first = TaskContext.get().partitionId(), 0, True
    kinds = {"conv": pa.int64()} | _ANSWER | _PIECE
    held: list[tuple] = []
    conv, size, cut, started = None, 0, True, False
    out: list[tuple] = []

    def piece() -> tuple:
        nonlocal number
        number += 1
        live = [r for r in held for _ in range(r[3])]
        turns, roles, texts = [r[0] for r in live], [r[1] for r in live], [r[2] for r in live]
        return (conv, *[None] * len(_ANSWER), part, number, turns, roles, texts, [int(x) for x in _again(roles, texts)])

    def whole() -> tuple:
        live = [r for r in held for _ in range(r[3])]
        return (conv, *solved([r[0] for r in live], [r[1] for r in live], [r[2] for r in live]), *[None] * len(_PIECE))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies")]
        for c, turn, role, text, copies in zip(*columns):
            if not started or c != conv:
                if started:
                    out.append(piece() if cut or first else whole())
                    first = False
                conv, held, size, cut, started = c, [], 0, False, True
            elif len(held) >= piece_rows or size >= PIECE_CHARS:
                out.append(piece())
                held, size, cut = [], 0, True
            held.append((turn, role, text, copies))
            size += len(text)
            if len(out) >= 1000 or out and out[-1][-1] is not None:
                yield _batch(out, kinds)
                out = []
    if started:
        out.append(piece())  # the next range may go on with it
    if out:
        yield _batch(out, kinds)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrix, counts and edges of each piece, once it is known which of its rows repeat rows of earlier pieces."""
    kinds = {"conv": pa.int64(), "part": pa.int64(), "piece": pa.int64(), "matrix": pa.list_(pa.int64()), "faults": pa.string(), "illegal": pa.int64(), "head": pa.string(), "tail": pa.string(), "n_turns": pa.int64(), "low": pa.int64(), "high": pa.int64()}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            earlier = set(row["earlier"] or ())
            again = [x or i in earlier for i, x in enumerate(row["again"])]
            faults = "".join(map(fault_of, row["texts"], again))
            initials, known = [r[:1] for r in row["roles"]], {t for t in row["turns"] if t is not None}
            matrix = product(collapsed(symbols_of(row["roles"], faults)))
            edges = (initials[0], initials[-1]) if initials else (None, None)
            out.append((row["conv"], row["part"], row["piece"], [x for r in matrix for x in r], faults, illegal_pairs(initials), *edges, len(known), min(known, default=None), max(known, default=None)))
        yield _batch(out, kinds)


_SUMMED = "conv long, part long, piece long, matrix array<long>, faults string, illegal long, head string, tail string, n_turns long, low long, high long"


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and end state of each piece from each state."""
    kinds = {"conv": pa.int64(), "part": pa.int64(), "piece": pa.int64(), "audits": pa.list_(pa.string()), "ends": pa.list_(pa.int64())}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            runs = collapsed(symbols_of(row["roles"], row["faults"]))
            found = [unrolled(runs, s, tuple(row["after"]), row["last"]) for s in range(4)]
            out.append((row["conv"], row["part"], row["piece"], [a for a, _, _ in found], [e for _, e, _ in found]))
        yield _batch(out, kinds)


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each piece from its true state, and the bytes it leaves."""
    kinds = {"conv": pa.int64(), "part": pa.int64(), "piece": pa.int64(), "audit": pa.string(), "left": pa.binary()}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            lines = repaired(row["roles"], row["texts"], row["audit"], row["state"])
            out.append((row["conv"], row["part"], row["piece"], row["audit"], "\n".join(lines).encode("utf-8", "surrogatepass") if lines else None))
        yield _batch(out, kinds)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation from its pieces in order; of the pieces only one batch is held."""
    kinds = {"conv": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
    conv, audits, digest, begun, started = None, [], hashlib.sha256(), False, False
    for batch in batches:
        out = []
        for c, audit, left in zip(*[batch.column(n).to_pylist() for n in ("conv", "audit", "left")]):
            if started and c != conv:
                out.append((conv, "".join(audits), digest.hexdigest()))
            if not started or c != conv:
                conv, audits, digest, begun, started = c, [], hashlib.sha256(), False, True
            audits.append(audit)
            if left is not None:
                digest.update(b"\n" + left if begun else left)
                begun = True
        if out:
            yield _batch(out, kinds)
    if started:
        yield _batch([(conv, "".join(audits), digest.hexdigest())], kinds)


def _chained(pieces: DataFrame, name: str, schema: str, step: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """A fold over the few numbers of each piece of a conversation, in order; ``step`` takes sorted lists and gives one value a piece."""
    def run(table: pa.Table) -> pa.Table:
        return step(table.sort_by([("part", "ascending"), ("piece", "ascending")]))

    return stored(pieces.groupBy("conv").applyInArrow(run, schema), name)


def _after(table: pa.Table) -> pa.Table:
    """For each piece the costs from its end on, whether it is the last, and the sums of the conversation in its first."""
    rows = table.to_pylist()
    v, after = AT_END, []
    for row in reversed(rows):
        after.append(list(v))
        m = row["matrix"]
        v = moved(tuple(tuple(m[i : i + 4]) for i in range(0, 16, 4)), v)
    after.reverse()
    tails = [r for r in rows if r["head"] is not None]
    illegal = sum(r["illegal"] for r in rows) + sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(tails, tails[1:]))
    known = [r for r in rows if r["low"] is not None]
    gaps = known[-1]["high"] - known[0]["low"] + 1 - sum(r["n_turns"] for r in known) + sum(a["high"] == b["low"] for a, b in zip(known, known[1:])) if known else 0
    n = len(rows)
    return pa.table({
        "conv": table.column("conv"), "part": table.column("part"), "piece": table.column("piece"), "after": pa.array(after, pa.list_(pa.int64())),
        "last": [i + 1 == n for i in range(n)], "cost": pa.array([v[NOTHING]] * n, pa.int64()), "all_illegal": pa.array([illegal] * n, pa.int64()), "gaps": pa.array([gaps] * n, pa.int64()),
    })


def _states(table: pa.Table) -> pa.Table:
    """The state in which each piece begins."""
    state, states = NOTHING, []
    for ends in table.column("ends").to_pylist():
        states.append(state)
        state = ends[state]
    return pa.table({"conv": table.column("conv"), "part": table.column("part"), "piece": table.column("piece"), "state": pa.array(states, pa.int32())})


def _same(a: str, b: str, columns: tuple[str, ...] = ("conv", "part", "piece")) -> Column:
    """Equal in these columns, null conversations too."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _joined(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Pieces beside what was found for them."""
    both = a.alias("a").join(b.alias("b"), _same("a", "b"), how)
    return both.select("a.*", *[f"b.{c}" for c in b.columns if c not in ("conv", "part", "piece")])


def _from_pieces(pieces: DataFrame) -> DataFrame:
    """Answers of conversations that lie in several ranges or were cut."""
    key = ["conv", "part", "piece"]
    rows = pieces.where(F.size("roles") > 0).select(*key, F.posexplode(F.arrays_zip("roles", "texts", "again")).alias("i", "r"))
    rows = rows.where("r.again = 0").select(*key, "i", F.unhex(F.md5(F.concat(F.length("r.roles").cast("string"), F.lit(":"), F.col("r.roles"), F.col("r.texts")))).alias("digest"))
    rows = stored(rows, "repair-digests")
    at = F.struct("part", "piece")
    firsts = rows.groupBy("conv", "digest").agg(F.min(at).alias("first"), F.max(at).alias("final")).where("first < final")
    late = rows.alias("a").join(firsts.alias("b"), _same("a", "b", ("conv", "digest"))).where(F.struct("a.part", "a.piece") > F.col("b.first"))
    late = stored(late.groupBy("a.conv", "a.part", "a.piece").agg(F.collect_list("a.i").alias("earlier")), "repair-late")
    summed = stored(_joined(pieces.select(*key, "turns", "roles", "texts", "again"), late, "left").mapInArrow(_summed, _SUMMED), "repair-summed")
    after = _chained(summed.drop("faults"), "repair-after", "conv long, part long, piece long, after array<long>, last boolean, cost long, all_illegal long, gaps long", _after)
    ready = _joined(_joined(pieces.select(*key, "roles"), summed.select(*key, "faults")), after.select(*key, "after", "last"))
    audits = stored(ready.mapInArrow(_unrolled, "conv long, part long, piece long, audits array<string>, ends array<long>"), "repair-audits")
    states = _chained(audits.select(*key, "ends"), "repair-states", "conv long, part long, piece long, state int", _states)
    true = _joined(audits.select(*key, "audits"), states).select(*key, "state", F.element_at("audits", F.col("state") + 1).alias("audit"))
    lines = _joined(pieces.select(*key, "roles", "texts"), true).mapInArrow(_lined, "conv long, part long, piece long, audit string, left binary")
    ordered = lines.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    texts = ordered.mapInArrow(_hashed, "conv long, audit string, repaired_sha256 string")
    count = lambda f: F.sum(F.length("faults") - F.length(F.replace("faults", F.lit(f), F.lit(""))))
    counts = summed.groupBy("conv").agg(count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))
    sums = after.where("last").select("conv", "gaps", F.col("all_illegal").alias("illegal"), "cost")
    both = sums.alias("a").join(counts.alias("b"), _same("a", "b", ("conv",))).select("a.*", "b.blank", "b.duplicate", "b.truncated")
    out = both.alias("a").join(texts.alias("b"), _same("a", "b", ("conv",))).select("a.conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    out = stored(out, "repair-joined")
    discard(rows, late, summed, after, audits, states)
    return out


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of damaged (conv_id, turn, role, text).

    Rows of a conversation go by turn, null first; rows that share a turn go by role, then by the md5 of their text.
    Nulls in role and text are one space; rows without a conv_id are one conversation of their own; repeated rows are
    duplicates. A conversation of which no row is left has zeros, an empty audit and the hash of the empty string.
    Other columns are ignored, and an empty table gives no rows.
    """
    spark = rows.sparkSession
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    ready = damaged(rows).withColumn("digest", F.md5("text")).withColumn("nth", F.monotonically_increasing_id())
    dealt = ready.repartitionByRange(shuffle_partitions(spark), *order, "nth").sortWithinPartitions(*order)
    schema = f"{_TYPES}, {_PIECE_TYPES}"
    found = stored(dealt.select("conv", "turn", "role", "text", "copies").mapInArrow(lambda batches: _in_ranges(batches, piece_rows), schema), "repair-found")
    whole = found.where("part is null").select(*[c.split()[0] for c in _TYPES.split(", ")])
    cut = _from_pieces(found.where("part is not null").select("conv", *[c.split()[0] for c in _PIECE_TYPES.split(", ")]))
    return whole.unionByName(cut).withColumnRenamed("conv", "conv_id")
