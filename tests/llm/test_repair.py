import hashlib
import itertools
import random
import re
import zlib

from actweave.llm import repair

SPACE = " \t\n\x0b\x0c\r"
GOAL = re.compile(r"(s?(ua)+)?\Z")


def faults(turns):
    """(initial, fault) of each (role, text)."""
    out, seen = [], set()
    for role, text in turns:
        body = text.strip(SPACE)
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "o"
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def plain_repair(turns):
    """(cost, audit, repaired turns) by trying all series of edits in the order of their cost."""
    marks, best = faults(turns), None
    for each in itertools.product("DKR", repeat=len(turns)):
        if any(e != "D" and f in "bd" for e, (_, f) in zip(each, marks, strict=True)):
            continue
        cost = sum({"D": 3, "K": 0, "R": 2}[e] + (e != "D" and f == "t") for e, (_, f) in zip(each, marks, strict=True))
        for gaps in itertools.product(range(3), repeat=len(turns) + 1):
            total = cost + 2 * sum(gaps)
            if sum(gaps) > 3 or (best and total > best[0]):
                continue
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(each, gaps[1:], strict=True))
            if best and (total, audit) >= best[:2]:
                continue
            for roles in itertools.product("ua", repeat=sum(x in "IR" for x in audit)):
                give, n, out = iter(roles), 0, []
                for x in audit:
                    if x == "K":
                        out.append((turns[n][0], turns[n][1], marks[n][0] or "-"))
                    elif x in "IR":
                        r = next(give)
                        out.append(({"u": "user", "a": "assistant"}[r], "" if x == "I" else turns[n][1], r))
                    n += x != "I"
                if GOAL.match("".join(r for _, _, r in out)):
                    best = (total, audit, [f"{role}:{text}" for role, text, _ in out])
    return best


def plain_row(conv, turns):
    """turns: (turn, role, text) after damage, nulls already spaces."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    marks = faults([t[1:] for t in turns])
    numbers = {t[0] for t in turns if t[0] is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
    cost, audit, out = plain_repair([t[1:] for t in turns])
    return (conv, gaps, *(sum(f == x for _, f in marks) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def conversation(rng, conv, n):
    roles = ["user", "assistant"] * 4 if rng.random() < 0.6 else ["system", *["user", "assistant"] * 3]
    rows = []
    for k in range(n):
        role = roles[k] if rng.random() < 0.7 else rng.choice(["user", "assistant", "system", "tool", "", None, "User"])
        text = rng.choice(["Hello.", "Why?", "no end", "Fine! ", " ", None, "", "ü.\n", "So…", f"own {k}."])
        rows.append((conv, rng.choice([k, k, k, 2 * k, None, 3]), role, text))
    return rows


def test_step_finds_the_cheapest_and_least_edits():
    rng = random.Random(2)
    texts = {"o": "a.", "b": " ", "t": "a"}
    sigs = {"".join(repair.symbol(rng.choice("suax"), rng.choice("ooobt")) for _ in range(rng.randint(1, 4))) for _ in range(150)}
    for row in repair.answers(iter(sorted(sigs))):
        turns = [({"s": "system", "u": "user", "a": "assistant", "x": "tool"}["suax"[(ord(x) - 65) // 4]], texts["obdt"[(ord(x) - 65) % 4]] + str(k) * (("obdt"[(ord(x) - 65) % 4]) == "t")) for k, x in enumerate(row["sig"])]
        turns = [(r, t.replace("a.", f"a{k}.")) for k, (r, t) in enumerate(turns)]
        assert (row["cost"], row["audit"]) == plain_repair(turns)[:2], row["sig"]


def test_query_equals_plain_version(spark):
    rng = random.Random(4)
    rows = [r for conv in range(90) for r in conversation(rng, conv, rng.randint(1, 4))]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (None, 1, "assistant", "Yes."), (-3, None, None, None)]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, at string, n int").repartition(5)
    got = {r[0]: tuple(r) for r in repair.audited(df).collect()}
    hurt = plain_damage(rows)
    want = {c: plain_row(c, [r[1:] for r in hurt if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want and len(got) == 92


def test_conversation_of_many_turns_and_batches(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(20_000)]
    report, kept = repair.repaired(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert tuple(report.collect()[0]) == (1, 0, 0, 0, 0, 0, 0, "K" * 20_000)
    assert repair.digests(kept).collect()[0][1] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in turns).encode()).hexdigest()
    report, kept = repair.repaired(spark.createDataFrame(turns[:9_999] + turns[10_000:], "conv_id long, turn long, role string, text string"))
    row = report.collect()[0]
    assert (row.gaps, row.illegal, row.cost, row.audit) == (1, 1, 2, "K" * 9_999 + "I" + "K" * 10_000)
    assert [tuple(r) for r in kept.filter("turn is null").collect()] == [(1, 9_999, "assistant", "", None)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.audited(none).collect() == []
