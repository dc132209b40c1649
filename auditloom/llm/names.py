"""Spellings of the same person or organisation: n-gram vectors, sparse cosine joins, average-linkage clusters.

1. Every distinct spelling is brought to a key: mis-decoded letters restored, address and remark taken off, letters folded,
   legal forms and order dropped. Equal keys are one node.
2. Keys become unit vectors of character n-grams, weighted by rarity over all keys. A pair of keys goes on if its cosine
   reaches `COSINE`, however many partners a key has. Keys are short, so no n-gram of a key could be left out without losing
   pairs. Keys are dealt out over blocks; a task holds two of them and sums the products n-gram by n-gram in its own memory.
3. The same task compares each such pair part by part: equal, mistyped, short for, initial of. Different given names rule it
   out. Neither products nor pairs that score nothing, of which there are as many as keys squared, are ever written.
4. Average linkage over these scores (absent pairs count 0), down to `LINK`. A merge needs a score of `LINK` or more, so
   no cluster leaves a connected component of these: components of up to `LOCAL` scores are each merged in one task, larger
   ones by rounds of mutual nearest clusters over tables, which give the same clusters, until a round merges none.

Null, blank and shared accounts are no spellings. Names are compared whole, whatever their length. Repeated rows count once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.components import components
from auditloom.session import cut

GRAM = 3
COSINE = 0.25
LINK = 0.45
LOCAL = 200_000  # scores of a component that one task merges (some 20 MB)
HOT = 32_768  # keys of a block, of which a task holds two
FEW = 256  # keys below which a block is not split, however many cores are idle
PAIRS = 1 << 18  # pairs that a task sifts at once
SLOTS = 3  # parts of a name that are sifted; longer names are always compared
PARTNERS = 8  # parts beside which a given name stands at least

# Accounts that many people use.
SHARED = set("release-bot jenkins root unknown".split())
SHARED_FORM = re.compile(r"(?i)^(?:ci|cd|admin|administrator|system|nobody|anonymous|build|deploy|github-actions|travis|dependabot.*|.*\[bot\]|.*[-_ ]bot)$")
# Legal forms, which are not part of an organisation's name.
LEGAL = set("gmbh inc incorporated corp corporation ltd limited llc llp plc ag kg co company sa sas sarl srl bv nv oy ab spa pty pte".split())
# Short forms of given names; a line holds forms of one name; the last lines hold words of organisations.
SHORT = """
alexander alex sandy xander sasha lex
alexandra alex sandra sasha
andrew andy drew
anastasia ana stasia stacy nastya
anthony tony
barbara barb babs
benjamin ben benny
bjorn bear
catherine katherine kate cathy kathy katie
charles charlie chuck chas
christopher chris kit
daniel dan danny
david dave davey
deborah deb debbie
dmitri dima mitya
dolores lola
donald don donnie
dorothy dot dottie dolly
edward ed eddie ted ned
elizabeth liz beth lizzie eliza betty betsy libby
fatima fati
francisco paco pancho frank fran kiko
frederick fred freddie
gabriela gabi gaby
gerald gerry jerry
gregory greg
guadalupe lupe lupita
henry harry hank
ignacio nacho
ingrid inga
isabella bella isa
jacqueline jackie
james jim jimmy jamie
jennifer jen jenny
jessica jess
johannes hans jan hannes
john johnny jack
jonathan jon
jose pepe
joseph joe joey
joshua josh
kenji ken
kenneth ken kenny
kimberly kim
lawrence larry laurie
leonard leo len
margaret maggie peggy meg marge
matthew matt
maximilian max
michael mike mick mickey
nicholas nick nico
nikolaos nikos niko nick
olivia liv
oluwaseun seun
patricia pat patty trish
patrick pat paddy
peter pete
philip phil
priya pri
raymond ray
rebecca becky becca
richard rick dick rich ricky
robert bob rob bobby robbie bert
ronald ron ronnie
samantha sam
samuel sam sammy
sebastian seb basti
stephen steve
susan sue susie suzie suzy
theodore ted theo teddy
thomas tom tommy
timothy tim
ulrich uli
valentina val tina
veronica vera ronnie
victoria vicky tori
vincent vince
walter walt wally
wilhelmina mina willa billie minnie
william bill will billy liam
yolanda yoli
zachary zach
zoe zoey
consulting consult consultants consultancy
international intl
laboratories labs laboratory lab
software sw soft
systems sys system
technologies tech technology technologys techs
"""
FORMS: dict[str, set[int]] = {}
for _i, _line in enumerate(SHORT.split("\n")):
    for _form in _line.split():
        FORMS.setdefault(_form, set()).add(_i)

LINES = SHORT.split("\n")


def _letters(part: str) -> int:
    """The letters of a part as bits; two parts differ in at least as many letters as bits."""
    bits = 0
    for c in part:
        bits |= 1 << ord(c) % 64
    return bits


FORM_LIST = [f for f in FORMS if len(f) >= 4]
FORM_BITS, FORM_SIZES = np.array([_letters(f) for f in FORM_LIST], np.uint64), np.array([len(f) for f in FORM_LIST])
FOLD = str.maketrans({"ø": "o", "Ø": "O", "æ": "ae", "Æ": "Ae", "œ": "oe", "ß": "ss", "ł": "l", "Ł": "L", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "’": "'"})


def _once_more(m: re.Match) -> str:
    for code in ("latin-1", "cp1252"):
        try:
            return m[0].encode(code).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return m[0]


def restored(name: str) -> str:
    """UTF-8 that was read as a one-byte code, read again, sequence by sequence."""
    return re.sub("[\u00c2-\u00f4][^\x00-\x7f]{1,3}", _once_more, name)


def key(name: str | None) -> str | None:
    """The parts of a name in alphabetical order, folded; None for what is no name of one person or organisation."""
    if name is None or not name.strip():
        return None
    name = unicodedata.normalize("NFKC", restored(name)).strip()
    if name.lower() in SHARED or SHARED_FORM.match(name):
        return None
    mail = re.match(r"^\s*<?([^\s<>@]+)@[\w.-]+>?\s*$", name)
    name = mail[1] if mail else re.sub(r"<[^>]*>|\([^)]*\)|\[[^\]]*\]", " ", name)
    name = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", name)
    name = "".join(c for c in unicodedata.normalize("NFD", name.translate(FOLD)) if unicodedata.category(c) != "Mn").lower()
    name = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m[1].replace(".", "") + " ", name)
    parts = [p for p in re.split(r"[^\w]+|_+|\d+$", name.replace("'", "")) if p]
    kept = [p for p in parts if p not in LEGAL]
    return " ".join(sorted(kept or parts)) or None


@lru_cache(500_000)
def distance(a: str, b: str, most: int = 2) -> int:
    """Edits between two words, swapped neighbours as one; most + 1 when there are more."""
    if a == b:
        return 0
    # an edit changes the set of letters by two at most
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    start, end = 0, 0
    least = min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most and min(last) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


@lru_cache(100_000)
def _forms(part: str) -> frozenset[int]:
    """The lines of the short forms that a part stands in, itself or, if it stands in none, with one slip."""
    if part in FORMS or len(part) < 4:
        return frozenset(FORMS.get(part, ()))
    near = (np.bitwise_count(FORM_BITS ^ np.uint64(_letters(part))) <= 2) & (np.abs(FORM_SIZES - len(part)) <= 1)
    return frozenset(i for at in np.flatnonzero(near).tolist() if distance(part, FORM_LIST[at], 1) == 1 for i in FORMS[FORM_LIST[at]])


@lru_cache(100_000)
def _initials(part: str) -> frozenset[str]:
    return frozenset(part[0]) | {LINES[i][0] for i in _forms(part)}


def _alike(a: str, b: str, known: set[str]) -> float:
    """How well two parts agree; `known` holds the parts that are given names of many."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.8 if _initials(a) & _initials(b) else 0.0
    if _forms(a) & _forms(b):
        return 0.95 if a in FORMS and b in FORMS else 0.85
    if a in known and b in known or a in FORMS and b in FORMS:
        return 0.0
    least = min(len(a), len(b))
    d = distance(a, b, 2)
    if d == 1 and (least >= 4 or a[0] == b[0]):
        return 0.9 if least >= 4 else 0.8
    return 0.8 if d == 2 and least >= 8 and a not in known and b not in known else 0.0


def score(a: str, b: str, known: set[str]) -> float:
    """0 to 1: how sure two keys denote the same. Every part of the shorter must agree with one of the longer."""
    x, y = sorted((a.split(), b.split()), key=len)
    if len(x) == 1 and len(y) >= 2:  # an account name: initial and family name, or all parts run together
        best = 0.0
        for family in y:
            if len(family) < 4:
                continue
            for given in y:
                if given is family:
                    continue
                joined = [w for i in _initials(given) for w in ((i + family, 0.85), (family + i, 0.85))]
                if len(given) > 1:
                    joined += [(given + family, 0.95), (family + given, 0.95)]
                for whole, worth in joined:
                    d = distance(x[0], whole, 2) if x[0][:1] == whole[:1] or x[0][-1:] == whole[-1:] else 3
                    best = max(best, worth - 0.1 * d if d <= 2 else 0.0)
        return best
    if len(x) == 1:
        d = distance(x[0], y[0], 1)
        slip = 0.85 if x[0][:1] == y[0][:1] else 0.3  # another first letter is another initial rather than a slip
        return (1.0, slip, 0.0)[d] if len(x[0]) >= 6 else float(a == b)
    long_x, long_y = [p for p in x if len(p) > 1], [p for p in y if len(p) > 1]
    if len(long_x) >= 2 and len(long_y) >= 2:  # middle initials count only if they are all there is
        x, y = sorted((long_x, long_y), key=len)
    total, rest, strong = 0.0, list(y), False
    for part in sorted(x, key=len, reverse=True):
        at = max(range(len(rest)), key=lambda i: _alike(part, rest[i], known))
        worth = _alike(part, rest[at], known)
        if worth == 0:
            return 0.0
        strong = strong or worth >= 0.75 and len(part) >= 4 and not (part in known and rest[at] in known)
        total += math.log(worth)
        rest.pop(at)
    if not strong:
        return 0.0
    return math.exp(total) * (0.55 if any(len(r) > 1 for r in rest) else 1.0)


def given_first(name: str, parts: str) -> str | None:
    """The part of a key of two that its spelling puts first, if it is written in plain order."""
    both = parts.split(" ")
    if len(both) != 2 or "," in name or "@" in name:
        return None
    words = (key(name.strip().split()[0]) or "").split(" ")
    return words[0] if len(words) == 1 and words[0] in both else None


def nodes(spellings: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """((spelling, key, first) of each distinct spelling that counts, (node, key, grams) of each distinct key)."""

    @F.pandas_udf("key string, first string")
    def keyed(names: pd.Series) -> pd.DataFrame:
        keys = [key(n) if isinstance(n, str) else None for n in names]
        return pd.DataFrame({"key": keys, "first": [k and given_first(n, k) for n, k in zip(names, keys)]}, dtype=object)

    distinct = spellings.select(F.col(name).alias("spelling")).where("spelling is not null").distinct()
    keyed = keyed.asNondeterministic()  # or the filter on keys, and the function with it, would be moved before the distinct
    keys = cut(distinct.withColumn("k", keyed("spelling")).select("spelling", "k.key", "k.first").where("key is not null"))
    padded = F.transform(F.split("key", " "), lambda p: F.concat(F.lit("^"), p, F.lit("$")))
    grams = F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - GRAM + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(GRAM)))))
    return keys, keys.select("key").distinct().select(F.xxhash64("key").alias("node"), "key", F.array_distinct(grams).alias("grams"))


def vectors(nodes: DataFrame) -> DataFrame:
    """(node, gram, count, weight): the unit vectors, weights falling with the number of keys that have the n-gram."""
    long = nodes.select("node", F.explode("grams").alias("gram"))
    counts = long.groupBy("gram").agg(F.count("*").alias("count"))
    weighed = long.join(counts, "gram").select("node", "gram", "count", F.log1p(nodes.count() / F.col("count")).alias("w"))
    return weighed.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("node")))).drop("w")


def in_pairs(vectors: DataFrame, *columns: Column) -> DataFrame:
    """A row for each node and pair of blocks (one <= two) that its own block is in, with its n-grams and weights."""
    packed = cut(vectors.groupBy("node").agg(F.collect_list("gram").alias("grams"), F.collect_list("weight").alias("weights"), *columns))
    n = packed.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / HOT), min(math.ceil(math.sqrt(2 * cores)), n // FEW))
    own = packed.withColumn("block", F.pmod("node", F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    return own.select("*", other).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other")


def _cosines(table: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, cosine) of the pairs between two blocks, or within one, at or over the threshold; some `PAIRS` at a time."""
    table = table.combine_chunks()
    block, one, two = (table.column(c).to_numpy() for c in ("block", "one", "two"))
    lists, weights = table.column("grams").combine_chunks(), table.column("weights").combine_chunks().flatten().to_numpy()
    codes = lists.flatten().dictionary_encode().indices.to_numpy()
    ends = np.cumsum(lists.value_lengths().to_numpy())
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    mine = block[owner] == two[0]
    order = np.flatnonzero(mine)[np.argsort(codes[mine], kind="stable")]
    held, worth = owner[order], weights[order]
    starts = np.searchsorted(codes[order], np.arange(codes.max(initial=-1) + 2)).tolist()
    within = one[0] == two[0]
    codes, weights, ends = codes.tolist(), weights.tolist(), ends.tolist()
    sums = np.zeros(len(ends))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for x in np.flatnonzero(block == one[0]).tolist():
        sums.fill(0)
        for at in range(ends[x - 1] if x else 0, ends[x]):
            first, last = starts[codes[at]], starts[codes[at] + 1]
            sums[held[first:last]] += worth[first:last] * weights[at]  # a node has an n-gram once
        if within:
            sums[: x + 1] = 0
        hits = np.flatnonzero(sums >= threshold)
        if len(hits):
            found.append((np.full(len(hits), x), hits, sums[hits]))
            size += len(hits)
        if size >= PAIRS:
            yield tuple(map(np.concatenate, zip(*found)))
            found, size = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found)))


def cosine_pairs(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(a, b, cosine) of each pair of nodes a < b at or over the threshold, exactly."""

    def joined(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        parts = [(np.minimum(nodes[x], nodes[y]), np.maximum(nodes[x], nodes[y]), c) for x, y, c in _cosines(table, threshold)]
        a, b, c = map(np.concatenate, zip(*parts)) if parts else ([], [], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})

    return in_pairs(vectors).groupBy("one", "two").applyInArrow(joined, "a long, b long, cosine double")


class _Sieve:
    """Tells of pairs of names, many at once, which of them `score` can give more than nothing.

    Of two names of several parts, all parts of one have to agree with parts of the other. A part without short forms, of
    more than one letter, agrees with an initial or with what is two edits from it at most, which changes four letters at most.
    """

    def __init__(self, keys: list[str]):
        n = len(keys)
        self.bits, self.sizes = np.zeros((SLOTS, n), np.uint64), np.full((SLOTS, n), -9, np.int64)
        self.hard = np.zeros((SLOTS, n), bool)
        self.initial, self.open = np.zeros(n, bool), np.zeros(n, bool)
        for row, name in enumerate(keys):
            parts = name.split()
            self.open[row] = not 2 <= len(parts) <= SLOTS
            self.initial[row] = any(len(p) == 1 for p in parts)
            for slot, part in enumerate(parts[:SLOTS]):
                self.bits[slot, row], self.sizes[slot, row] = _letters(part), len(part)
                self.hard[slot, row] = len(part) > 1 and not _forms(part)

    def _agree(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        all_ = np.ones(len(x), bool)
        for i in range(SLOTS):
            some = ~self.hard[i, x] | self.initial[y]
            for j in range(SLOTS):
                some |= (np.bitwise_count(self.bits[i, x] ^ self.bits[j, y]) <= 4) & (np.abs(self.sizes[i, x] - self.sizes[j, y]) <= 2)
            all_ &= some
        return all_

    def may(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.open[x] | self.open[y] | self._agree(x, y) | self._agree(y, x)


def given_names(keys: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """(part, given): the parts that stand beside at least `partners` others in names of two, and oftener first than last.

    Frequent family names stand beside many others too, but last; so the measure does not depend on how many people there are.
    """
    parts = F.split("key", " ")
    two = keys.where(F.size(parts) == 2)
    pairs = two.select("key", parts[0].alias("x"), parts[1].alias("y"), "first")
    both = pairs.unionByName(pairs.select("key", F.col("y").alias("x"), F.col("x").alias("y"), "first")).where("length(x) > 1 and length(y) > 1")
    counted = both.groupBy(F.col("x").alias("part")).agg(F.countDistinct("key").alias("n"), F.count_if(F.col("first") == F.col("x")).alias("begins"), F.count_if(F.col("first") == F.col("y")).alias("ends"))
    return counted.where((F.col("n") >= partners) & (F.col("begins") >= F.col("ends"))).select("part", F.lit(True).alias("given"))


def scored(vectors: DataFrame, nodes: DataFrame, keys: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(a, b, score) of the pairs a < b at or over the cosine whose names agree part by part."""
    part = nodes.select("node", F.explode(F.split("key", " ")).alias("part"))
    known = part.join(given_names(keys), "part").groupBy("node").agg(F.collect_set("part").alias("known"))
    named = vectors.join(nodes.select("node", "key"), "node").join(known, "node", "left")

    def judge(table: pa.Table) -> pa.Table:
        nodes, names = table.column("node").to_pylist(), table.column("key").to_pylist()
        known = [frozenset(k or ()) for k in table.column("known").to_pylist()]
        sieve = _Sieve(names)
        found = []
        for x, y, _ in _cosines(table, threshold):
            may = sieve.may(x, y)
            for i, j in zip(x[may].tolist(), y[may].tolist()):
                a, b = (i, j) if nodes[i] < nodes[j] else (j, i)
                if (worth := score(names[a], names[b], known[a] | known[b])) > 0:
                    found.append((nodes[a], nodes[b], worth))
        a, b, worth = zip(*found) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "score": pa.array(worth, pa.float64())})

    both = in_pairs(named, F.first("key").alias("key"), F.first("known").alias("known"))
    return both.groupBy("one", "two").applyInArrow(judge, "a long, b long, score double")


def merge(edges: list[tuple[int, int, float]], least: float = LINK) -> dict[int, int]:
    """{node: cluster} by average linkage over the scores of one component, one merge at a time, the best first, ties by number."""
    near: dict[int, dict[int, float]] = {}
    for a, b, score in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = score
    size = dict.fromkeys(near, 1)
    cluster = {n: [n] for n in near}
    heap = [(-round(s, 9), a, b, 1, 1) for a, x in near.items() for b, s in x.items() if a < b and s >= least]
    heapify(heap)
    while heap:
        _, a, b, size_a, size_b = heappop(heap)
        if size.get(a) != size_a or size.get(b) != size_b:
            continue  # of clusters that are no more
        mine, other = near[a], near.pop(b)
        mine.pop(b), other.pop(a)
        for c, total in other.items():
            mine[c] = mine.get(c, 0.0) + total
            del near[c][b]
        cluster[a] += cluster.pop(b)
        size[a] += size.pop(b)
        for c, total in mine.items():
            near[c][a] = total
            mean = total / (size[a] * size[c])
            if mean >= least:
                heappush(heap, (-round(mean, 9), min(a, c), max(a, c), size[min(a, c)], size[max(a, c)]))
    return {n: min(members) for members in cluster.values() for n in members}


def average_linkage(edges: DataFrame, least: float = LINK, local: int = LOCAL) -> DataFrame:
    """(node, cluster) of every node of `edges` (a, b, score): average linkage, absent pairs counting 0.

    A cluster is known by its least node. Components of the scores of `least` or more with up to `local` scores are grouped
    into one task each; the scores of larger ones stay tables. Nodes without such a score are clusters of their own.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score"))
    labels = cut(components(edges.where(F.col("score") >= least)))
    label = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    inside = edges.join(label("a"), "a").join(label("b"), "b").where("of_a = of_b").select("a", "b", "score", F.col("of_a").alias("component"))
    inside = cut(inside)
    large = cut(inside.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > local).select("component"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        found = merge(list(zip(rows.a.tolist(), rows.b.tolist(), rows.score.tolist())), least)
        return pd.DataFrame({"node": list(found), "cluster": list(found.values())}, dtype="int64")

    parts = inside.join(large, "component", "left_anti").groupBy("component").applyInPandas(one, "node long, cluster long")
    if not large.isEmpty():
        parts = parts.unionByName(by_rounds(inside.join(large, "component", "left_semi").drop("component"), least))
    alone = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels.select("node"), "node", "left_anti")
    return parts.unionByName(alone.select("node", F.col("node").alias("cluster")))


def by_rounds(edges: DataFrame, least: float = LINK) -> DataFrame:
    """(node, cluster) as `average_linkage`, by rounds in which mutual nearest clusters merge, until a round merges none.

    Ties are broken by a hash of the pair and the round, so that equal groups halve. Each round is written to the shared
    folder, one row a pair of clusters; nothing is gathered.
    """
    linked = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("score").alias("total")))
    members = cut(linked.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cluster", F.col("node")))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    number = -1
    while True:
        number += 1
        size = lambda x: sizes.select(F.col("cluster").alias(x), F.col("size").alias(f"size_{x}"))  # noqa: E731,B023
        mean = linked.join(size("a"), "a").join(size("b"), "b").select("a", "b", (F.col("total") / (F.col("size_a") * F.col("size_b"))).alias("mean")).where(F.col("mean") >= least)
        ranked = mean.withColumn("order", F.struct((-F.round("mean", 9)).alias("m"), F.xxhash64("a", "b", F.lit(number)).alias("h"), "a", "b"))
        best = ranked.select(F.explode(F.array("a", "b")).alias("cluster"), "order").groupBy("cluster").agg(F.min("order").alias("best"))
        merged = cut(best.groupBy("best").agg(F.count("*").alias("n")).where("n = 2").select(F.col("best.b").alias("old"), F.col("best.a").alias("new")))
        if merged.isEmpty():
            return members
        renamed = lambda df, x: df.join(merged.withColumnRenamed("old", x), x, "left").withColumn(x, F.coalesce("new", x)).drop("new")  # noqa: E731,B023
        members = cut(renamed(members, "cluster"))
        sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
        moved = renamed(renamed(linked, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total")
        linked = cut(moved.groupBy("a", "b").agg(F.sum("total").alias("total")))


def entities(df: DataFrame, name: str) -> DataFrame:
    """(spelling, entity): each distinct spelling that counts and the entity it denotes."""
    keys, found = nodes(df, name)
    found = cut(found)
    clusters = average_linkage(scored(vectors(found), found, keys))
    known = found.select("node", "key").join(clusters, "node", "left").select("key", F.coalesce("cluster", "node").alias("entity"))
    return keys.join(known, "key").select("spelling", "entity")


def same(entities: DataFrame) -> DataFrame:
    """(author_a, author_b) of every two spellings of an entity, author_a before author_b by code point."""
    by = cut(entities)
    a, b = (by.select("entity", F.col("spelling").alias(f"author_{x}")) for x in "ab")
    return a.join(b, "entity").where("author_a < author_b").select("author_a", "author_b")
