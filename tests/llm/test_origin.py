"""Origins: marks, families, places, data and minified code; components against a plain union; edge rows."""

import random
import re

import numpy as np

from auditloom.llm import origin
from auditloom.llm.components import components
from tests.conftest import rows
from pyspark.sql import functions as F

HAND = '''import os


def {a}(items, limit=5):
    """Return what is left of {b}."""
    out = []
    for item in items[:limit]:
        if item.get("{b}") is None:
            continue
        out.append({c}(item["{b}"]))
    return out if len(out) > {n} else None


class {d}:
    def __init__(self, name):
        self.name = name
        self.size = {n}
'''


def hand(rng):
    w = lambda: "".join(rng.choices("abcdefgh", k=7))
    return HAND.format(a=w(), b=w(), c=w(), d=w().title(), n=rng.randint(1, 99))


def generated(rng, head=""):
    name = "".join(rng.choices("abcdefgh", k=6)).title()
    return head + "".join(f"proto_{name}_{i}.getField{i} = function (i) {{ return jspbGet(this, {i}, i); }};\n" for i in range(rng.randint(3, 9)))


def test_origins(spark):
    rng = random.Random(2)
    files = [("r", f"src/a{i}.py", hand(rng)) for i in range(12)]
    files += [("r", f"src/g{i}.js", generated(rng, "// Code generated by tool 1.2. DO NOT EDIT.\n")) for i in range(3)]
    files += [("s", f"src/h{i}.js", generated(rng)) for i in range(3)]
    files += [("r", "vendor/pack/x.py", hand(rng)), ("r", "src/copy.py", "# This is a copy of pack 1.2.3, taken from its archive.\n" + hand(rng)), ("r", "vendor_portal/x.py", "# Do not edit the limits without asking.\n" + hand(rng))]
    files += [("r", "src/d.js", "const d = [\n" + ", ".join(str(rng.randint(0, 99999)) for _ in range(300)) + "\n];\n"), ("r", "src/m.js", "".join(f'!function(q){{"w{i}"in q&&(q.a=null)}}(this);var a{i % 9}=function(b){{return b[{i}]||!1}};' for i in range(40)))]
    files += [("r", "src/none.py", None), ("r", "src/empty.py", ""), ("r", "src/a0.py", files[0][2])]
    df = spark.createDataFrame([(*f, "clash", 1) for f in files], "repo string, file_path string, content string, origin string, class int")
    found = {(r.repo, r.file_path): r.origin for r in origin.origins(df).collect()}
    assert {k for k, v in found.items() if v == "generated"} == {("r", f"src/g{i}.js") for i in range(3)} | {("s", f"src/h{i}.js") for i in range(3)}
    assert {k[1] for k, v in found.items() if v == "vendored"} == {"vendor/pack/x.py", "src/copy.py"}
    assert found["r", "src/d.js"] == "data" and found["r", "src/m.js"] == "minified"
    assert all(found["r", f"src/a{i}.py"] is None for i in range(12)) and found["r", "src/empty.py"] is None and ("r", "src/none.py") not in found
    assert origin.origins(df.limit(0)).count() == 0


def test_one_text_in_many_repositories(spark):
    text = hand(random.Random(5))
    df = spark.createDataFrame([(r, "lib/x.py", text) for r in "abc"] + [("d", "y.py", hand(random.Random(6)))], "repo string, file_path string, content string")
    assert rows(origin.origins(df).where("origin = 'vendored'"), "repo") == [("a",), ("b",), ("c",)]


def test_paths(spark):
    spelt = ["src/a.py", "./src/a.py", "src\\a.py", "/src//a.py", " src/a.py ", "src/x/../a.py", "src/./a.py", ".\\SRC\\a.py"]
    df = spark.createDataFrame([(p,) for p in spelt] + [(None,), ("",)], "p string").select(origin.same_path(F.col("p")).alias("s"))
    assert rows(df.distinct()) == [("",), ("src/a.py",), (None,)]
    files = spark.createDataFrame([("r", "src/a.py"), ("s", "src/a.py")], "repo string, file_path string")
    findings = spark.createDataFrame([("r", ".\\src\\a.py"), ("r", None), ("q", "src/a.py")], "repo string, file_path string")
    assert rows(origin.led_to(files, findings, findings.limit(0))) == [("r", "src/a.py")]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed = changed or root[a] != low or root[b] != low
            root[a] = root[b] = low
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(spark, sets, bands):
    packed = [origin.pack(np.array(sorted(s), np.uint64)) for s in sets]
    return spark.createDataFrame([(i, bytearray(p), b) for i, (p, b) in enumerate(zip(packed, bands))], "class long, set binary, bands array<long>")


def joined(sets, bands):
    """The families by comparing every pair that shares a bucket."""
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if set(bands[i]) & set(bands[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {i: r for i, r in enumerate(root) if root.count(r) > 1}


def test_all_pairs_of_a_bucket(spark):
    low, high = set(range(100)), set(range(50, 150))
    sets = [low, high | {999}, high | {998}]  # the last two are alike, and unlike the least class
    found = origin.families(sets_of(spark, sets, [[7]] * 3)).collect()
    assert {r["class"]: r.family for r in found} == {1: 1, 2: 1}
    rng = random.Random(11)
    sets, bands = [], []
    for _ in range(60):
        base = set(rng.sample(range(400), 90))
        for _ in range(rng.randint(1, 4)):
            sets.append((base - set(rng.sample(sorted(base), rng.randint(0, 14)))) | set(rng.sample(range(400, 500), rng.randint(0, 9))))
            bands.append([rng.randrange(3), 10 + rng.randrange(2)])
    for block in (2048, 7):
        found = origin.families(sets_of(spark, sets, bands), block).collect()
        assert {r["class"]: r.family for r in found} == joined(sets, bands)


def test_packing():
    rng = random.Random(6)
    for n in (0, 1, 2, 5, 40):
        values = sorted(rng.sample(range(1 << 36), n))
        packed = origin.pack(np.array(values, np.uint64))
        assert origin.unpack(packed).tolist() == values and origin.count(packed) == n


def test_no_mark_without_a_hint():
    marks = ["Code generated by x", "@generated", "<autogenerated>", "machine-written source", "generated on 2020 by", "do not modify by hand", "produced by the X compiler", "file was created by", "automatically created from", "generado automáticamente", "Généré par", "genere autom", "erzeugt von x, nicht", "automatisch generiert", "gerado autom", "сгенерирован", "this is a copy of x v1", "@license", "(c) 2001 The x authors", "Copyright 2001 the x project", "permission is hereby granted", "released under the x", "redistribution in source", "/*! pack v1.2.3"]
    for m in marks:
        assert (origin.GENERATED.search(m) or origin.LICENCES.search(m)) and origin.hinted("x = 1\n" + m.upper()) and not origin.hinted("x = 1\n"), m


def test_similarity_is_exact(spark):
    rng = random.Random(4)
    sets, bands = [], []
    for i in range(80):  # 250 shingles, pairs at 0.8 exactly or one shingle below
        both = set(rng.sample(range(1 << origin.WIDTH), 250))
        sets += [both, set(sorted(both, key=lambda x: rng.random())[: 200 - i % 2])]
        bands += [[i], [i]]
    found = {r["class"]: r.family for r in origin.families(sets_of(spark, sets, bands)).collect()}
    assert found == {2 * i + k: 2 * i for i in range(0, 80, 2) for k in (0, 1)}


def test_marks_anywhere_in_a_file():
    code = "let total = 0;\nlet name = 'x';\n" * 100
    seen = lambda text: origin.measure(text, "src/a.js", origin._Mask())[:2]
    assert seen(code + "// Code generated by tool 1.2. DO NOT EDIT.\n") == (True, False)
    assert seen(code + "/*! pack v1.2.3\n * Released under the licence of its authors. */\n" + code) == (False, True)
    assert seen(code + "const head = `\n// Code generated by tool 1.2.\n`;\n") == (False, False)
    assert seen("const q = /[`'\"]/;\n" + code + "const b = `x`;\n// Code generated by tool 1.2.\n") == (True, False)
    py = "total = 0\n" * 200
    assert seen(py + '"""Code generated by tool 1.2."""\n') == (True, False)
    assert seen(py + 'HEAD = """\n# Code generated by tool 1.2.\n"""\n') == (False, False)


def test_long_strings():
    rng = random.Random(3)
    blob = 'DATA = """\n' + "\n".join("".join(rng.choices("abcdefXYZ0123+/", k=76)) for _ in range(30)) + '\n"""\n'
    prose = '"""\n' + "This module keeps a record of every parcel and says so at length.\n" * 30 + '"""\nimport os\n'
    assert origin.measure(blob, "a.py", origin._Mask())[2] and not origin.measure(prose, "a.py", origin._Mask())[2]


def test_families_decide(spark, monkeypatch):
    """Without families the unmarked members of generated ones are lost, and a mark in hand-written code counts."""
    rng = random.Random(7)
    base = [f"this.f{k} {rng.choice(['=', '+=', '-=', '*='])} get(m, {k}) {rng.choice(['+', '-', '*', '/', '%', '&'])} {rng.choice(['1', 'x', 'y[2]', 'z()', '!w', '-v'])};" for k in range(60)]
    made = lambda i: "\n".join([*base, "a " + "+-*/%&|^<>"[i] + " b;"])
    files = [("r", f"src/g{i}.js", ("// Code generated by tool 1.2. DO NOT EDIT.\n" if i % 2 else "") + made(i)) for i in range(10)]
    files += [("r", f"src/a{i}.py", hand(rng)) for i in range(12)] + [("s", "src/writer.py", "# This head says: code generated by tool 3.\n" + hand(rng))]
    files += [("s", "src/alone.js", "// Code generated by tool 1.2. DO NOT EDIT.\n" + "x.y(1);\nfor (;;) { z(); }\n" * 3)]
    df = spark.createDataFrame(files * 2, "repo string, file_path string, content string")
    generated = lambda: {r.file_path for r in origin.origins(df).where("origin = 'generated'").collect()}
    assert generated() == {f"src/g{i}.js" for i in range(10)} | {"src/alone.js"}
    monkeypatch.setattr(origin, "families", lambda classes: spark.createDataFrame([], "class long, family long"))
    assert generated() == {f"src/g{i}.js" for i in range(1, 10, 2)} | {"src/alone.js"}


def test_links_against_brute_force():
    """The share of pairs at 0.8 or more that a band brings together, over sets that differ by a few shingles."""
    rng = np.random.default_rng(1)
    met = pairs = 0
    for _ in range(600):
        tokens = [f"{c}" for c in rng.choice(list("+-*/%<>=&|^!~?:;,.(){}[]"), 300)]
        other = list(tokens)
        for at in rng.integers(0, 300, rng.integers(1, 6)):
            other[at] = "@"
        a, b = (origin.measure(" ".join(t), "a.js", origin._Mask()) for t in (tokens, other))
        x, y = (set(origin.unpack(m[5]).tolist()) for m in (a, b))
        if len(x & y) / len(x | y) >= origin.SIMILAR:
            pairs += 1
            met += bool(set(a[6]) & set(b[6]))
    assert pairs > 200 and met / pairs > 0.97


def test_sets_do_not_go_to_every_block(spark, monkeypatch):
    """400 sets of one family in eight buckets, 50 blocks each: a copy of each set for each would be 160,000 rows."""
    monkeypatch.setattr(origin, "SHEET", 1 << 10, raising=False)
    rng = random.Random(2)
    sets = [set(range(200)) | set(rng.sample(range(200, 10_000), 5)) for _ in range(400)]
    df = sets_of(spark, sets, [list(range(8))] * 400)

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() + stages.apply(i).outputRecords() for i in range(stages.size()))

    before = written()
    assert {r.family for r in origin.families(df, 8).collect()} == {0}
    assert written() - before < 100_000


def test_sketches_lose_no_link(spark, monkeypatch):
    rng = random.Random(21)
    sets, bands = [], []
    for _ in range(50):
        base = set(rng.sample(range(1 << origin.WIDTH), rng.randint(5, 140)))
        for _ in range(rng.randint(1, 5)):
            gone = set(rng.sample(sorted(base), rng.randint(0, len(base) // 6)))
            sets.append((base - gone) | set(rng.sample(range(1 << origin.WIDTH), rng.randint(0, 4))))
            bands.append(rng.sample(range(6), 3))
    for block, sheet in ((2048, 32), (7, 2)):
        monkeypatch.setattr(origin, "SHEET", sheet)
        found = origin.families(sets_of(spark, sets, bands), block).collect()
        assert {r["class"]: r.family for r in found} == joined(sets, bands)


def test_many_texts_at_once(monkeypatch):
    """The pass over many texts gives what each text gives alone, and ordinary texts are not taken apart alone."""
    rng = random.Random(31)
    bits = list("\"'`\\_$.();=\t\r\n\n   ") + ["\"\"\"", "'''", "a", "b$2", "1", "1.5", "0x1F.e", "..", "if", "implements", "implementx", "protectex", "return", "Interface", "/*", "*/", "//", "#", "#include", "A" * 20, "\x1c", "q" * 20 + "\n"]
    odd = ["é", "½", "٣", "§", "\1", "\2", "\x85", "\xa0", "\0", "😀"]
    texts = ["", " ", "a", "1$a.2", "a.1.b$c", "\"" * 7] + ["".join(rng.choices(bits + odd * (i % 3 == 0), k=rng.randint(0, 60))) for i in range(3000)]
    texts += [hand(rng) for _ in range(20)] + [generated(rng) * 40 for _ in range(5)]
    files = [(t, "src/a.py") for t in texts]
    alone = [origin.measure(*f, origin._Mask()) for f in files]
    for page in (1, 300, 1 << 20):
        monkeypatch.setattr(origin, "PAGE", page)
        assert origin.measure_all(files, origin._Mask()) == alone
    monkeypatch.setattr(origin, "measure", None)
    assert origin.measure_all(files[-25:], origin._Mask()) == alone[-25:] and origin.measure_all([], origin._Mask()) == []


def test_comments_by_their_signs():
    rng = random.Random(32)
    one = re.compile(r"/\*[\s\S]*?\*/|^[ \t]*(?://|#(?!include)).*$|[ \t]//[ \t].*$", re.M)
    for _ in range(5000):
        text = "".join(rng.choices(["/*", "*/", "//", "#", "#include", "\n", "\n", " ", "\t", "a", "\r", "/", "*"], k=rng.randint(0, 14)))
        assert origin.without_comments(text) == one.sub("", text)
