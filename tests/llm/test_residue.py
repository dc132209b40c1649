"""Residue: held-out forms are learned from trusted ones, discussion and code are not residue; edge rows."""

import random

import numpy as np

from auditloom.llm import residue
from tests.conftest import rows

REAL = [
    "The {w} module keeps a record for each client and drops it after {n} minutes.", "502 Bad Gateway was returned {n} times while the {w} pool was idle.", "Templates use double braces, for example `{{{{ name }}}}`, which the renderer fills.", 'Bug {n}: users got "Access denied" after the {w} change.',
    "Replace the lorem ipsum in the landing mock before {w}, the design team asked for it.", "Placeholders such as <name> in the command line help stand for values that the user types.", "Without JavaScript the {w} report still shows the table.", "The endpoint answers 404 Not Found when the {w} is idle.", "Large commits hide small mistakes: the one for {w} touched {n} files.",
]
WORDS = "ledger parcel cabinet roster stencil widget canvas".split()


def corpus(n=600):
    rng = random.Random(1)
    out = []
    for i in range(n):
        text = "\n\n".join(rng.choice(REAL).format(w=rng.choice(WORDS), n=rng.randint(2, 99)) for _ in range(rng.randint(2, 6)))
        if i % 9 == 0:
            text += "\n\nReport for {{ owner }}, prepared by ${score}.\n\nLorem ipsum dolor sit amet, " + " ".join(rng.choices("magna aliqua tempor nisi ullamco cillum".split(), k=12)) + "."
        if i % 13 == 0:
            text = rng.choice(["404 Not Found", "Access denied", "Please enable JavaScript to view the wiki."])
        out.append((i, text, "x"))
    return out


def test_decisions(spark):
    data = corpus()
    extra = {
        9001: "Report for «owner», prepared by {score}.", 9002: "Magna nisi aliqua ullamco tempor nisi cillum magna aliqua tempor ullamco nisi.", 9003: "```jinja\n{% for x in y %}{{ x }}{% endfor %}\n```\nThe ledger module keeps a record.",
        9004: 'The old page said "Please enable JavaScript" to crawlers.', 9005: None, 9006: "", 9007: " \n ", 9008: "403 Forbidden\n\nThe ledger module keeps a record.", 9009: "The parcel module keeps a record. " * 9000,
    }
    df = spark.createDataFrame(data + [(k, v, "x") for k, v in extra.items()] + [(9008, extra[9008], "x")], "doc_id long, text string, odds string")
    found = {r.doc_id for r in residue.score(df).where("residue").collect()}
    expected = {i for i, t, _ in data if "{{ owner" in t or len(t) < 60}
    assert found & set(range(600)) == expected
    assert found - set(range(600)) == {9001, 9002, 9008}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert residue.score(empty).count() == 0
    plain = spark.createDataFrame([(1, "The ledger is full."), (2, None)], "doc_id long, text string")
    assert rows(residue.score(plain), "doc_id", "residue") == [(1, False), (2, False)]


def test_passages():
    assert residue.passages('A `x` b.\n```\ncode {{ y }}\n```\n"quote of it" c') == ["A  code  b.", "quoted  c"]
    assert residue.trusted("Dear {{ x }}") and not residue.trusted("Dear <name>")


def weights_of(found, trusted):
    owner, flat = residue.features(found, residue._Codes())
    return residue.fit(owner, flat, np.array(trusted, bool))


def test_the_scores_decide_not_the_forms():
    """Without the model the forms miss fields of other kinds and later filler, and hit a form in a sentence that all else speaks against."""
    rng = random.Random(5)
    words = "ledger parcel cabinet roster stencil widget canvas".split()
    filler = "magna aliqua tempor nisi ullamco cillum sit amet".split()
    fields = ["{{ %s }}", "${%s}", "%%%%%s%%%%", "«%s»", "{%s}"]
    forms = ["Report for %s, prepared by %s.", "Welcome to %s!", "Contact %s for help."]
    field = lambda kinds: rng.choice(kinds) % rng.choice(words).upper()
    form = lambda kinds: (f := rng.choice(forms)) % tuple(field(kinds) for _ in range(f.count("%s")))
    real = [f"The {a} module keeps a record of each {b} and drops it after {rng.randint(2, 99)} minutes." for a in words for b in words for _ in range(20)]
    known = [form(fields[:3]) for _ in range(90)] + ["Lorem ipsum dolor sit amet, " + " ".join(rng.choices(filler, k=9)) + "." for _ in range(60)] + [f"Please enable JavaScript to view the {w} page." for w in words * 6]
    train = real + known
    weights = weights_of(train, [residue.trusted(p) for p in train])
    decide = lambda ps: residue.odds_of(ps, weights, residue._Codes()) >= residue.ODDS
    new = [form(fields[3:]) for _ in range(60)] + [" ".join(rng.choices(filler, k=10)).capitalize() + "." for _ in range(40)]
    assert not any(map(residue.trusted, new)) and decide(new).mean() > 0.95
    assert decide(known).mean() > 0.95
    against = real[:400] + ["The ledger module keeps lorem ipsum dolor sit amet of each record and drops it after 9 minutes and then 7 minutes more."]
    assert residue.trusted(against[-1])  # one listed form in a sentence that all else speaks against
    weights = weights_of(against + known[:90], [residue.trusted(p) for p in against + known[:90]])
    assert not decide(against).any() and decide(known[:90]).all()
    assert not decide([f"The {w} module keeps a record of each {v}." for w in words for v in words]).any()
    assert not residue.odds_of([], weights, residue._Codes()).size


def test_slices_change_nothing(monkeypatch):
    found = [f"Passage {i} of the ledger." for i in range(50)] + ["Dear {{ x }}", "なぜですか。"] * 5
    weights = weights_of(found, [residue.trusted(p) for p in found])
    whole = residue.odds_of(found, weights, residue._Codes())
    monkeypatch.setattr(residue, "SLICE", 40)
    assert np.allclose(residue.odds_of(found, weights, residue._Codes()), whole)
