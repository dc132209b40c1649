"""Name variants: keys and scores, the join against all pairs, clusters against a plain agglomeration, edge rows."""

import math
import random
from collections import Counter

import numpy as np

from auditloom.llm import names
from tests.conftest import rows


def groups(spark, *spellings):
    df = spark.createDataFrame([(s, "x", 1) for s in spellings], "author string, spelling string, entity int")
    out: dict = {}
    for r in names.entities(df, "author").collect():
        out.setdefault(r.entity, set()).add(r.spelling)
    return sorted(map(sorted, out.values()))


def test_variants(spark):
    same = ["Robert Lunirihukul", "Bob Lunirihukul", "lunirihukul.robert", "R. Lunirihukul", "Lunirihukul, Robert", "robert-lunirihukul", "Robert Lunirihukul (ops team)", "Robert  LUNIRIHUKUL", "Robert Lunirihukl", "rlunirihukul", "Robert Lunirihukul <r@x.invalid>"]
    family = ["Dolores Lunirihukul", "D. Lunirihukul"]
    other = ["Søren Gepömesiros", "Soren Gepomesiros", "SÃ¸ren Gepömesiros"]
    firm = ["Nasubabifos Systems Inc", "NASUBABIFOS SYSTEMS INCORPORATED", "nasubabifos-systems"]
    unlike = ["Nasubabifos Consulting GmbH"]
    rng = random.Random(1)
    crowd = [rng.choice(["Robert", "Dolores", "Søren", "Ingrid", "Kenji"]) + " " + "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5)).title() for _ in range(250)]
    found = groups(spark, *same, *family, *other, *firm, *unlike, *crowd, None, "", "  ", "release-bot", "root", *same)
    assert [g for g in found if not set(g) <= set(crowd)] == sorted(map(sorted, (same, family, other, firm, unlike)))


def test_pairs_and_empty(spark):
    df = spark.createDataFrame([("Ada Lovelorn",), ("ada lovelorn",), ("Lovelorn, Ada",)], "author string")
    assert rows(names.same(names.entities(df, "author"))) == [("Ada Lovelorn", "Lovelorn, Ada"), ("Ada Lovelorn", "ada lovelorn"), ("Lovelorn, Ada", "ada lovelorn")]
    assert names.same(names.entities(df.limit(0), "author")).count() == 0
    long = "Ada L" + "ol" * 2000
    assert groups(spark, long, long.lower()) == [sorted([long, long.lower()])]


def test_join_loses_no_pair(spark):
    rng = random.Random(7)
    people = [" ".join(sorted("".join(rng.choices("abcde", k=rng.randint(3, 7))) for _ in range(2))) for _ in range(60)]
    df = spark.createDataFrame([(p,) for p in people], "author string")
    _, nodes = names.nodes(df, "author")
    found = {(r.a, r.b): r.cosine for r in names.cosine_pairs(names.vectors(nodes)).collect()}
    data = nodes.collect()
    counts = Counter(g for r in data for g in r.grams)
    vectors = {}
    for r in data:
        w = {g: math.log1p(len(data) / counts[g]) for g in r.grams}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors[r.node] = {g: x / norm for g, x in w.items()}
    for a, x in vectors.items():
        for b, y in vectors.items():
            dot = sum(v * y.get(g, 0) for g, v in x.items())
            if a < b and dot >= names.COSINE + 1e-9:
                assert abs(found[a, b] - dot) < 1e-9


def test_average_linkage(spark):
    rng = random.Random(11)
    edges = {(i, j): round(rng.random(), 4) for i in range(24) for j in range(i + 1, 24) if rng.random() < 0.3 or i // 4 == j // 4}
    edges = {k: (0.6 + v / 3 if k[0] // 4 == k[1] // 4 else v / 2) for k, v in edges.items()}
    clusters = [{i} for i in range(24)]
    mean = lambda a, b: sum(edges.get((min(i, j), max(i, j)), 0) for i in a for j in b) / (len(a) * len(b))
    while True:
        best = max(((mean(a, b), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j), default=(0, 0, 0))
        if best[0] < names.LINK:
            break
        clusters[best[1]] |= clusters.pop(best[2])
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a long, b long, score double")
    for local in (names.LOCAL, 0):  # in one task, and by rounds
        out: dict = {}
        for r in names.average_linkage(df, local=local).collect():
            out.setdefault(r.cluster, set()).add(r.node)
        assert sorted(map(sorted, out.values())) == sorted(map(sorted, clusters))


def test_many_spellings_round_a_hub():
    """One merge at a time, each with the hub: no number of rounds ends it."""
    edges = [(0, i, 0.9) for i in range(1, 100)] + [(i, j, 0.6) for i in range(1, 100) for j in range(i + 1, 100)]
    assert set(names.merge(edges).values()) == {0}
    assert set(names.merge([(0, i, 0.9) for i in range(1, 5)]).values()) == {0, 3, 4}


def test_frequent_grams_are_split(spark, monkeypatch):
    df = spark.createDataFrame([(f"Smith {x}{y}olu",) for x in "bdfgk" for y in "aeiou"], "author string")
    _, nodes = names.nodes(df, "author")
    whole = rows(names.cosine_pairs(names.vectors(nodes), 0.05))
    monkeypatch.setattr(names, "HOT", 3)
    assert len(whole) > 100 and [r[:2] for r in rows(names.cosine_pairs(names.vectors(nodes), 0.05))] == [r[:2] for r in whole]


def test_family_names_of_many(spark):
    people = [f"{g} Hartmond" for g in "Robert Ingrid Kenji Dolores Priya Sergei Fatima Olivia Ulrich Yolanda".split()] + [f"Robert {f}" for f in "Talume Bosirek Gamulon Pitaren Kadesso Morviel Sunetar Lobrack Vinterol".split()]
    found = groups(spark, *people, "R. Talume", "Bob Hartmond", "hartmond.ingrid")
    assert ["Bob Hartmond", "Robert Hartmond"] in found and ["Ingrid Hartmond", "hartmond.ingrid"] in found and ["R. Talume", "Robert Talume"] in found
    keys, _ = names.nodes(spark.createDataFrame([(p,) for p in people], "author string"), "author")
    assert rows(names.given_names(keys), "part") == [("robert",)]


def test_distance_and_score():
    assert [names.distance(a, b) for a, b in (("ab", "ba"), ("abc", "abc"), ("abc", "abd"), ("abc", "xyz"), ("a", "abcd"))] == [1, 0, 1, 3, 3]
    assert names.score("alexander smithers", "andrew smithers", {"alexander", "andrew"}) == 0
    assert names.score("asmithers", "andrew smithers", set()) > 0.5


def test_pairs_are_not_written(spark):
    """Of 900 keys with a given name in common every two have a cosine: 404,550 pairs, none of which may reach the disk."""
    rng = random.Random(5)
    people = ["Wilhelmina " + "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title() for _ in range(900)]
    df = spark.createDataFrame([(p,) for p in people], "author string")

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() + stages.apply(i).outputRecords() for i in range(stages.size()))

    before = written()
    assert names.entities(df, "author").count() == len(set(people))
    assert written() - before < 150_000


def test_sieve_keeps_what_scores(spark, monkeypatch):
    rng = random.Random(9)
    given = ["robert", "bob", "r", "ingrid", "inga", "ingird", "kenji", "jo", "j", "li"]
    family = ["lunirihukul", "lunirihukl", "lunirhiukul", "gepomesiros", "gepomesirso", "smithers", "smiters", "ng", "systems", "system"]
    keys = sorted({" ".join(sorted(rng.choice(x) for x in rng.choice([(given, family), (given, given, family), (family,), (given, family, family, given)]))) for _ in range(160)} | {"rlunirihukul", "smithersingrid"})
    known = {"robert", "ingrid", "kenji"}
    sieve, n = names._Sieve(keys), len(keys)
    x, y = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    kept = sieve.may(x, y)
    scored = np.array([names.score(keys[i], keys[j], known) > 0 for i, j in zip(x, y)])
    assert scored.any() and not (scored & ~kept).any() and not kept.all()
    df = spark.createDataFrame([(k,) for k in keys], "author string")
    whole = rows(names.entities(df, "author"))
    monkeypatch.setattr(names, "HOT", 7)
    assert rows(names.entities(df, "author")) == whole
