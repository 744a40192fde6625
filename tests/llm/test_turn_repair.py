import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from speechlake.llm import turn_repair as T

WELL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        lot, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        own += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not kept else "d" if (role, text) in seen else "-" if kept[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def every_edit(rows, found, inserts):
    """All well-formed edits with so many inserts at most, as (cost, audit, lines)."""
    def go(i, cost, audit, lines, left):
        if i == len(rows):
            if WELL.fullmatch("".join(x[:1] for x in lines)):
                yield cost, audit, lines
        else:
            _, role, text = rows[i]
            yield from go(i + 1, cost + 2, audit + "D", lines, left)
            if found[i] not in "bd":
                more = 5 if found[i] == "t" else 0
                yield from go(i + 1, cost + more, audit + "K", [*lines, f"{role}:{text}"], left)
                for to in ("user", "assistant"):
                    yield from go(i + 1, cost + 1 + more, audit + "R", [*lines, f"{to}:{text}"], left)
        if left:
            for to in ("user", "assistant"):
                yield from go(i, cost + 5, audit + "I", [*lines, f"{to}:"], left - 1)

    return go(0, 0, "", [], inserts)


def forward(rows, found):
    """The least (cost, audit) and its lines, by a walk over the rows that keeps the best of each state."""
    step = {("s", ""): "s", ("u", ""): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}

    def grown(best):
        for _ in range(3):
            for state, (c, a, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if (to := step.get((role[0], state))) is not None:
                        best[to] = min(best.get(to, (10**9, "", ())), (c + 5, a + "I", (*lines, f"{role}:")))
        return best

    best = grown({"": (0, "", ())})
    for (_, role, text), f in zip(rows, found):
        new = {}
        for state, (c, a, lines) in best.items():
            options = [(state, c + 2, "D", lines)]
            if f not in "bd":
                more = 5 if f == "t" else 0
                if (to := step.get((role[:1], state))) is not None:
                    options.append((to, c + more, "K", (*lines, f"{role}:{text}")))
                options += [(step[(to[0], state)], c + 1 + more, "R", (*lines, f"{to}:{text}")) for to in ("user", "assistant") if (to[0], state) in step]
            for to, cost, letter, out in options:
                new[to] = min(new.get(to, (10**9, "", ())), (cost, a + letter, out))
        best = grown(new)
    return min(best[s] for s in ("", "a") if s in best)


def answer(rows, best):
    f = faults(rows)
    known = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = best
    return (max(known) - min(known) + 1 - len(known) if known else 0, f.count("b"), f.count("d"), f.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_runs_match_all_edits_of_short_conversations():
    for n in range(4):
        for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=n):
            rng = random.Random(str(roles))
            rows = [(i, r, rng.choice(["Yes.", "cut", "", "What?", " "])) for i, r in enumerate(roles)]
            best = min(every_edit(rows, faults(rows), 4))
            assert forward(rows, faults(rows)) == (best[0], best[1], tuple(best[2]))
            assert T.solved([t for t, _, _ in rows], [r for _, r, _ in rows], [x for _, _, x in rows]) == answer(rows, best)


def test_long_runs_by_powers_match_a_walk():
    rng = random.Random(5)
    for _ in range(150):
        rows = []
        for _ in range(rng.randint(1, 8)):
            role, text = rng.choice(["system", "user", "assistant", "", "x"]), rng.choice(["done.", "cut", "  ", "{}!", "{}"])
            rows += [(len(rows) + k, role, text.format(rng.random())) for k in range(rng.choice([1, 1, 2, 3, 17, 64]))]
        assert T.solved([t for t, _, _ in rows], [r for _, r, _ in rows], [x for _, _, x in rows]) == answer(rows, forward(rows, faults(rows)))


def test_powers_and_pieces_compose():
    rng = random.Random(6)
    symbols = [a + b for a in "sua?" for b in "xt-"]
    for _ in range(100):
        runs = [(rng.choice(symbols), rng.randint(1, 40)) for _ in range(rng.randint(1, 6))]
        end = tuple(rng.randint(0, 20) for _ in range(4))
        v = end
        for s, n in reversed(runs):
            for _ in range(n):
                v = T.moved(T.power(s, 0), v)
        assert T.moved(T.product(runs), end) == v
        audit, state, cost = T.unrolled(runs, T.NOTHING, end, False)
        assert cost + end[state] == v[T.NOTHING]


def rows_of(rng):
    rows = [(c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[t % 2], rng.choice(["One. ", "Two words", "x?", "", " \n", "End!", "Ünï。"]) + str(rng.randint(0, 3)) * rng.randint(0, 2)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(1000, t, rng.choice(["user", "assistant", "system"]), rng.choice(["the same first turn.", f"own {t}", f"own {t}."])) for t in range(900)]
    rows += [(1001, t // 3, "user" if t % 2 else "assistant", f"{t}.") for t in range(60)] + [(1002, None, "user", f"{k}?") for k in range(5)] + [(1002, 3, None, None), (1002, 4, "user", None)]
    rows += [(None, 1, "user", "no conversation."), (None, 2, "assistant", "yes."), (None, None, None, None), (1003, 5, "", "empty role."), (1004, 2, "user", "twice."), (1004, 2, "user", "twice."), (1005, 0, "user", "long " * 100_000 + ".")]
    dropped = [c for c in range(2000, 2400) if zlib.crc32(f"{c}:7".encode()) % 20 == 0][:3]
    return rows + [(c, 7, "user", "gone") for c in dropped]


def test_against_a_walk_however_rows_are_dealt(spark):
    rows = rows_of(random.Random(7))
    want = {c: answer(r, forward(r, faults(r))) for c, r in damage(rows).items()}
    df = spark.createDataFrame([(c, t, r, x, "k", 1) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, audit string, piece int").orderBy(F.rand(1))
    for size in (20_000, 50, 1):
        got = {r.conv_id: tuple(r)[1:] for r in T.repair(df, size).collect()}
        assert len(got) == len(want) and {c for c in want if got.get(c) != want[c]} == set()
    assert T.repair(df.limit(0)).collect() == []
