import random

from actweave.operators import answers
from actweave.operators import conversations as cv

SCHEMA = "conv int, n int, role string, text string, calls array<struct<id: string, name: string>>, call_id string"


def plain(rows):
    """(pruned, without orphans, rounds) of one conversation's (role, text, calls, call_id)."""
    last = next((i for i in range(len(rows) - 1, -1, -1) if rows[i][0] == "human"), None)
    cut, whole = [], []
    for i, (role, text, calls, call) in enumerate(rows):
        old = last is not None and i < last
        short = text[:20] + cv.CUT_MARK if old and role == "tool" and text is not None and len(text) > 20 and not text.endswith(cv.CUT_MARK) else text
        cut.append((role, short, calls, call))
        if old and role == "ai" and calls:
            ids = set()
            for r, _, _, c in rows[i + 1 :]:
                if r != "tool":
                    break
                ids.add(c)
            left = [c for c in calls if c[0] in ids]
            if len(left) < len(calls) and not left and not (text or "").strip():
                text = cv.INTERRUPTED
            calls = left
        whole.append((role, text, calls, call))
    return cut, whole, sum(r[0] == "ai" for r in rows[(-1 if last is None else last) + 1 :])


def conversation(rng):
    rows, ids = [], []
    for k in range(rng.randint(1, 14)):
        role = rng.choice(["human", "ai", "ai", "tool", "tool", "tool", "system"])
        calls = [(f"c{k}{j}", "find") for j in range(rng.randint(0, 3))] if role == "ai" else None
        if calls:
            ids = [c[0] for c in calls]
        rows.append((role, rng.choice([None, "", " ", "kurz", "x" * 50, "y" * 30 + cv.CUT_MARK]), calls, rng.choice(ids or ["z"]) if role == "tool" else None))
    return rows


def test_repairs_equal_plain_version(spark):
    rng = random.Random(12)
    convs = {k: conversation(rng) for k in range(300)}
    df = spark.createDataFrame([(k, n, *r) for k, x in convs.items() for n, r in enumerate(x)], SCHEMA).repartition(4)
    shape = lambda rows: {k: [(r.role, r.text, None if r.calls is None else [tuple(c) for c in r.calls], r.call_id) for r in sorted(rows, key=lambda r: r.n) if r.conv == k] for k in convs}
    want = {k: plain(x) for k, x in convs.items()}
    once = cv.pruned(df, 20)
    assert shape(once.collect()) == {k: w[0] for k, w in want.items()}
    assert once.exceptAll(cv.pruned(once, 20)).count() == 0
    whole = cv.without_orphans(df)
    assert shape(whole.collect()) == {k: w[1] for k, w in want.items()} and any(r[1] == cv.INTERRUPTED for w in want.values() for r in w[1])
    assert {r.conv: (r.rounds, r.close) for r in cv.rounds(df, 3).collect()} == {k: (w[2], w[2] + 1 >= 3) for k, w in want.items()}


def test_markers_go_back_to_what_the_sources_hold(spark):
    said = [
        (1, "Vedi {{cita:L-44-2015:3:1}}, {{cita:L-44-2015:3:9}} e {{cita:L-44-2015:7:1}}; {{cita:L-1-1900:1:1}}fine"),
        (2, "{{cita:L-9-1999:-:-}}{{cita:L-9-1999:2:}} due"), (3, "senza"), (4, None), (5, "{{cita:L-44-2015:3 bis:2}}"),
    ]
    texts = spark.createDataFrame(said, "answer_id int, text string")
    sources = spark.createDataFrame([(1, "L-44-2015", "3", "1"), (1, "L-44-2015", "3", None), (2, "L-9-1999", None, None), (5, "L-44-2015", "3-bis", None)], "answer_id int, act_id string, article string, par string")
    acts = spark.createDataFrame([("L-44-2015", True), ("L-9-1999", False), ("L-1-1900", False)], "id string, loaded boolean")
    fixed, added = answers.repaired(texts, sources, acts)
    assert {r.answer_id: r.text for r in fixed.collect()} == {
        1: "Vedi {{cita:L-44-2015:3:1}}, {{cita:L-44-2015:3:-}} e {{cita:L-44-2015:-:-}}; fine", 2: "{{cita:L-9-1999:-:-}}{{cita:L-9-1999:-:-}} due", 3: "senza", 4: None, 5: "{{cita:L-44-2015:3 bis:-}}",
    }
    assert [tuple(r) for r in added.collect()] == [(1, "L-44-2015")]
