"""Passages of held-out items in a corpus: a prefix-filtered join on word shingles, then an alignment of words.

An item's own text is what remains without the sentences that many items share. Items are cut into windows of `PASSAGE`
words. A document that holds a window with few changes shares at least `SHARED` of its shingles, so one of all but the
`SHARED - 1` most frequent: only those (the prefix, rarest first, by counts over all documents) make a pair of document and
item. A pair is dropped where its shared shingles do not lie near one diagonal, or where the words that both sides have
there are too few for `LEAK`; for the others the words are aligned and the passages measured.

Shingles have three words here and not five, since passages count although single words were changed, added or dropped.

Items are taken in blocks of at most about `SMALL` shingles, which every task holds; a block costs one pass over the texts,
which writes the shingles that a document shares with the block and the words around them, and one pass over these. Neither
shuffles anything but the counts of shingles, and no text leaves its task.

Null, empty and blank texts on either side give no row. Layout, mark-up, case and punctuation do not matter. Equal texts are
judged once a batch and each of their documents comes out. Texts are read whole. Repeated items count each.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import cut, spread

SHINGLE = 3
PASSAGE = 10  # words below which a shared stretch is no passage
LEAK = 15  # words that one or two passages must hold together
SHARED = 3  # shingles of a window that remain after a few changed words
INTACT = 0.75  # share of the words of a passage that are the item's own
DRIFT = 8  # words added or dropped within a passage
STANDARD = 3  # items that share a sentence which is then no item's own
SMALL = 500_000  # item shingles of a block, with their words some 50 MB in a task

MARKUP = re.compile(r"<[/!]?[A-Za-z][^<>]{0,200}>|&(?:[A-Za-z]{2,8}|#\d{1,7});")
UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """The words of a text without tags, entities and invisible characters, in lower case."""
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    return WORD.findall(UNSEEN.sub("", text).lower())


class _Codes(dict):
    """64 bits for every word."""

    def __missing__(self, word: str) -> int:
        code = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) < 500_000:
            self[word] = code
        return code


def shingles(tokens: list[str], codes: _Codes) -> np.ndarray:
    """The hashes of all runs of SHINGLE words."""
    if len(tokens) < SHINGLE:
        return np.empty(0, np.uint64)
    c = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    with np.errstate(over="ignore"):
        out = c[: len(c) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            out = ((out ^ (out >> np.uint64(31))) * MIX) ^ c[k : len(c) - SHINGLE + 1 + k]
    return out


def own_words(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, words) of each item's own text."""

    @F.pandas_udf("array<string>")
    def split(sentences: pd.Series) -> pd.Series:
        return sentences.map(words)

    sentences = F.split(F.col(text), r"(?<=[.?!:;])\s+|\n+")
    one = items.where(F.col(text).isNotNull()).select(F.col(item).alias("item"), F.posexplode(sentences).alias("at", "sentence"))
    one = one.withColumn("words", split("sentence")).where("size(words) > 0").withColumn("form", F.xxhash64("words"))
    common = one.groupBy("form").agg(F.countDistinct("item").alias("n")).where(F.col("n") >= STANDARD).select("form")
    kept = one.join(common, "form", "left_anti")
    return kept.groupBy("item").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda s: s["words"])).alias("words"))


class Block:
    """Some items: their words, and of every shingle where it stands in them. Bounded by `SMALL`."""

    def __init__(self, items: list, texts: list[list[str]]):
        self.items, self.texts = items, texts
        each = [shingles(t, _Codes()) for t in texts]
        self.wanted = np.unique(np.concatenate([*each, np.empty(0, np.uint64)]))
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, found in enumerate(each):
            for at, s in enumerate(np.searchsorted(self.wanted, found).tolist()):
                self.postings[s].append((i, at))
        self.each = [np.searchsorted(self.wanted, found).tolist() for found in each]

    def prefix(self, counts: np.ndarray) -> dict[int, list[int]]:
        """Of each shingle the items in one of whose windows it is among the necessary ones, by its count over all documents."""
        out: dict[int, set[int]] = defaultdict(set)
        window = PASSAGE - SHINGLE + 1
        for i, found in enumerate(self.each):
            for s in range(max(1, len(found) - window + 1)):
                seen = sorted((counts[x], x) for x in found[s : s + window] if counts[x])
                for _, x in seen[: max(0, len(seen) - SHARED + 1)]:
                    out[x].add(i)
        return {x: sorted(items) for x, items in out.items()}


def _local(a: list[str], b: list[str]) -> tuple[int, int, int, int]:
    """(first, end, matched) in `a` of the best local alignment, and its score: a match 1, a change or gap -1."""
    best = (0, 0, 0, 0)
    above = [(0, 0, 0)] * (len(b) + 1)
    for i, x in enumerate(a):
        row = [(0, i + 1, 0)]
        left = row[0]
        for j, y in enumerate(b):
            diagonal = above[j]
            if x == y:
                start = diagonal[1] if diagonal[0] else i
                cell = (diagonal[0] + 1, start, diagonal[2] + 1)
            else:
                up = above[j + 1]
                top = diagonal if diagonal[0] >= up[0] and diagonal[0] >= left[0] else up if up[0] >= left[0] else left
                cell = (top[0] - 1, top[1], top[2]) if top[0] > 1 else (0, i + 1, 0)
            row.append(cell)
            left = cell
            if cell[0] > best[3]:
                best = (cell[1], i + 1, cell[2], cell[0])
        above = row
    return best


def chains(seeds: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The seeds (item, document place) in runs near one diagonal, of `SHARED` or more."""
    done: list[list[tuple[int, int]]] = []
    open_: list[list[tuple[int, int]]] = []
    for i, j in sorted(set(seeds), key=lambda s: (s[1], s[0])):
        open_ = [c for c in open_ if j - c[-1][1] <= 2 * DRIFT]
        near = [c for c in open_ if 0 <= i - c[-1][0] <= 2 * DRIFT and abs((j - c[-1][1]) - (i - c[-1][0])) <= 3]
        if near:
            max(near, key=len).append((i, j))
        else:
            done.append([(i, j)])
            open_.append(done[-1])
    return [c for c in done if len(c) >= SHARED]


def passages(item: list[str], slices, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first word, end, words matched) in the item of each passage that the document holds; `slices(a, b)` are words of the
    document. Nothing is aligned where the words in common cannot make `LEAK` in two passages."""
    near = []
    for c in chains(seeds):
        low = max(0, c[0][0] - DRIFT)
        a = item[low : c[-1][0] + SHINGLE + DRIFT]
        b = slices(max(0, c[0][1] - DRIFT), c[-1][1] + SHINGLE + DRIFT)
        have = set(b)
        common = sum(w in have for w in a)
        if common >= INTACT * PASSAGE:
            near.append((common, low, a, b))
    if sum(sorted((n[0] for n in near), reverse=True)[:2]) < INTACT * LEAK:
        return []
    found = []
    for _, low, a, b in near:
        first, end, matched, _ = _local(a, b)
        if end - first >= PASSAGE and matched >= INTACT * (end - first):
            found.append((low + first, low + end, matched))
    return found


def held(spans: list[tuple[int, int, int]]) -> int:
    """The words of the item that its best one or two passages hold."""
    longest: dict[int, int] = {}  # of each first word the farthest end, which holds all that nearer ends hold
    for s, e, _ in spans:
        longest[s] = max(e, longest.get(s, 0))
    spans = [(s, e, 0) for s, e in longest.items()]
    best = max((e - s for s, e, _ in spans), default=0)
    for n, (s, e, _) in enumerate(spans):
        for t, f, _ in spans[n + 1 :]:
            both = (e - s) + (f - t) - max(0, min(e, f) - max(s, t))
            best = max(best, both)
    return best


SEEN = "form binary, places array<int>, shingles array<int>, starts array<int>, parts array<array<string>>"


def _shared(given: DataFrame, block) -> DataFrame:
    """(doc, form, places, shingles, starts, parts) of the documents with SHARED shingles of the block or more, and the words
    near these: `parts` begin at the words `starts`."""
    kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.string()))]
    names = [c.split()[0] for c in SEEN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, wanted = _Codes(), block.value.wanted
        for batch in batches:
            kept, rows = [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                tokens = words(text) if text else []
                if len(tokens) < PASSAGE or not len(wanted):
                    continue
                found = shingles(tokens, codes)
                at = np.searchsorted(wanted, found).clip(max=len(wanted) - 1)
                places = np.flatnonzero(wanted[at] == found)
                hit = at[places]
                if len(places) < SHARED or len(set(hit.tolist())) < SHARED:
                    continue
                starts, parts, end = [], [], -1
                for p in places.tolist():
                    low, high = max(0, p - 2 * DRIFT), p + SHINGLE + 2 * DRIFT
                    if low <= end:
                        parts[-1] += tokens[end:high]
                    else:
                        starts.append(low)
                        parts.append(tokens[low:high])
                    end = min(high, len(tokens))
                kept.append(n)
                rows.append((hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), places.tolist(), hit.tolist(), starts, parts))
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(kept, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc", *names])

    return spread(given).mapInArrow(run, f"doc {given.schema['doc'].dataType.simpleString()}, {SEEN}")


def _held(seen: DataFrame, block, prefix) -> DataFrame:
    """(doc, at, held) of the documents that hold passages of the block's item number `at`."""

    def judge(places: list[int], hits: list[int], starts: list[int], parts: list[list[str]]) -> list[tuple[int, int]]:
        items, necessary = block.value, prefix.value
        wanted = {i for s in set(hits) for i in necessary.get(s, ())}
        if not wanted:
            return []
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for place, s in zip(places, hits):
            for i, at in items.postings[s]:
                if i in wanted:
                    seeds[i].append((at, place))

        def slices(a: int, b: int) -> list[str]:
            k = bisect_right(starts, a) - 1
            return parts[k][a - starts[k] : b - starts[k]]

        out = [(i, held(passages(items.texts[i], slices, s))) for i, s in seeds.items() if len({at for at, _ in s}) >= SHARED]
        return [(i, n) for i, n in out if n >= LEAK]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, list[tuple[int, int]]] = {}
            owners, found = [], []
            for n, (form, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("form", "places", "shingles", "starts", "parts")))):
                if form not in known:
                    known[form] = judge(*row)
                owners += [n] * len(known[form])
                found += known[form]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(owners, pa.int64())), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32())], ["doc", "at", "held"])

    return seen.mapInArrow(run, f"doc {seen.schema['doc'].dataType.simpleString()}, at int, held int")


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", small: int = SMALL) -> DataFrame:
    """(doc, item, held): each document with a passage of an item's own text, and how many of its words it holds.

    The driver holds one block of items at a time; what it collects of the documents are counts, one a shingle of the block.
    """
    spark = documents.sparkSession
    own = cut(own_words(items, item, text).where(F.size("words") >= PASSAGE))
    total = own.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // small))
    given = documents.where(F.length(F.trim(text)) > 0).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = f"{doc} {documents.schema[doc].dataType.simpleString()}, {item} {items.schema[item].dataType.simpleString()}, held int"
    parts = []
    for n in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n).orderBy("item").toArrow()
        block = Block(rows.column("item").to_pylist(), rows.column("words").to_pylist())
        sent = spark.sparkContext.broadcast(block)
        seen = cut(_shared(given, sent))
        met = seen.select(F.explode(F.array_distinct("shingles")).alias("s")).groupBy("s").agg(F.count("*").alias("n")).toArrow()
        counts = np.zeros(len(block.wanted), np.int64)
        counts[met.column("s").to_numpy()] = met.column("n").to_numpy()
        found = _held(seen, sent, spark.sparkContext.broadcast(block.prefix(counts)))
        names = spark.createDataFrame([(i, x) for i, x in enumerate(block.items)], f"at int, item {items.schema[item].dataType.simpleString()}")
        parts.append(found.join(F.broadcast(names), "at").select(F.col("doc").alias(doc), F.col("item").alias(item), "held"))
    return reduce(DataFrame.unionByName, parts).to(spark.createDataFrame([], kind).schema)
