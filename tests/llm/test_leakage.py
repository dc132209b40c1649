"""Leaks: passages with edits, stretches too short, standard sentences; a plain search on random texts; edge rows."""

import random

from auditloom.llm import leakage
from tests.conftest import rows

RNG = random.Random(4)
WORDS = ["".join(RNG.choices("bcdfglmnprst", k=2)) + RNG.choice(["a", "e", "o"]) + "".join(RNG.choices("klmnrst", k=2)) for _ in range(300)]


def sentence(n, rng):
    return " ".join(rng.choices(WORDS, k=n))


def item(rng):
    return f"Choose the best answer below. {sentence(14, rng)}. {sentence(14, rng)}. {sentence(14, rng)}."


def run(spark, documents, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in documents], "doc_id long, text string, item string, doc int")
    i = spark.createDataFrame([(n, t, "s") for n, t in items], "item_id long, text string, words string")
    return rows(leakage.leaks(d, i).select("doc_id", "item_id"))


def test_passages(spark):
    rng = random.Random(9)
    items = [(n, item(rng)) for n in range(8)]
    own = [t.split(". ", 1)[1].split() for _, t in items]
    pad = lambda: sentence(30, rng)
    changed = list(own[2][:20])
    changed[6], changed[13] = "zzz", "yyy"
    documents = [
        (1, f"{pad()} {' '.join(own[0][:16])} {pad()}"),
        (2, f"{pad()} {' '.join(own[1][:9])} {pad()}"),
        (3, f"{pad()} {' '.join(changed)} {pad()}"),
        (4, f"{pad()} {' '.join(own[3][:12])} {pad()} {' '.join(own[3][25:37])}"),
        (5, f"{pad()} Choose the best answer below. {pad()}"),
        (6, f"> **{' '.join(own[4][:10]).upper()}**\n> <b>{'  '.join(own[4][10:18])}</b>, {pad()}"),
        (7, f"{' '.join(own[5][:11])} {pad()}"),
        (8, f"{pad()} {' '.join(own[0][:16])} {pad()}"),
        (9, None), (10, ""), (11, "  "), (12, pad()),
    ]
    assert run(spark, documents, items) == [(1, 0), (3, 2), (4, 3), (6, 4), (8, 0)]


def test_copies_and_repeats(spark):
    rng = random.Random(10)
    text = item(rng)
    leak = "intro " + text.split(". ", 1)[1] + " outro"
    others = [(n, item(rng)) for n in range(3, 6)]
    assert run(spark, [(i, leak) for i in range(40)], [(1, text), (2, text + " " + sentence(4, rng)), *others]) == sorted([(i, n) for i in range(40) for n in (1, 2)], key=str)
    assert run(spark, [], [(1, text)]) == [] and run(spark, [(1, leak)], []) == []


def test_long_document(spark):
    rng = random.Random(12)
    items = [(n, item(rng)) for n in range(4)]
    own = items[3][1].split(". ", 1)[1]
    assert run(spark, [(1, sentence(40_000, rng) + " " + own + " " + sentence(40_000, rng))], items) == [(1, 3)]


def test_alignment():
    a = [str(i) for i in range(30)]
    b = ["x", *a[5:12], "y", *a[13:25], "z"]
    seeds = [(i, b.index(str(i))) for i in range(5, 23) if i not in (10, 11, 12)]
    ((first, end, matched),) = leakage.passages(a, lambda x, y: b[x:y], seeds)
    assert (first, end, matched) == (5, 25, 19) and leakage.held([(0, 10, 10), (5, 17, 12), (20, 31, 11)]) == 23


def test_blocks_of_items_change_nothing(spark):
    rng = random.Random(13)
    items = [(n, item(rng)) for n in range(20)]
    documents = [(i, f"{sentence(20, rng)} {items[i % 20][1].split('. ', 1)[1]} {sentence(20, rng)}") for i in range(30)]
    d, i = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = rows(leakage.leaks(d, i))
    assert len(whole) == 30 and rows(leakage.leaks(d, i, small=300)) == whole


def test_no_text_is_shuffled(spark):
    d, i = spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([(1, "y")], "item_id long, text string")
    plan = leakage.leaks(d, i)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
