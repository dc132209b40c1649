"""Byte-level BPE over Arrow batches, by length-bucketed padded matrices.

`encode` adds the token ids of a text column. Each batch is cut into pieces by the vocabulary's pattern; every distinct
piece becomes one row of a matrix of its length class. In each round every row merges its leftmost pair of least rank,
found by a vectorised probe of an open-addressing table; finished rows leave, and the others are compacted by one column.

Null and empty texts give an empty list. Strings that look like special tokens are ordinary text. Text of any length is
encoded whole. Repeated rows are encoded each; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from auditloom.session import spread

# Fixed value: the pre-tokenisation pattern that belongs to the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
NONE = np.int32(2**31 - 1)
LONG = 2048  # pieces of more bytes merge all places of the least pair in a round, which gives the same ids
MEMO = 400_000  # pieces remembered by a worker before it starts anew


class Vocabulary:
    """Ranks of a `.tiktoken` file: byte ids and a hashed table (left, right) -> merged id. Small enough to broadcast."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            ((ranks[token[:cut]] << 20) | ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        keys, values = np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int32)
        self.shift = 64 - max(4, int(4 * len(keys)).bit_length())
        size = 1 << (64 - self.shift)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):  # one winner a slot and round, the others go on to the next slot
            self.probes += 1
            free = self.keys[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = keys[left[placed]], values[left[placed]]
            rest = np.setdiff1d(np.arange(len(left)), placed, assume_unique=True)
            left, at = left[rest], (at[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each merged pair, NONE where a pair does not merge; -1 stands for padding."""
        keys = (left.astype(np.int64) << 20) | right
        out, at, todo = np.full(len(keys), NONE, np.int32), self._slot(keys), np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            here = self.keys[at[todo]]
            hit = here == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (here >= 0)]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return out


def _merge_matrix(vocabulary: Vocabulary, cells: np.ndarray, out: list, rows: np.ndarray) -> None:
    """Merge every row of `cells` (padded with -1) to its end and put its ids at out[row]."""
    ranks = vocabulary.rank(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(cells), -1)
    while len(cells):
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(cells), np.int64)
        best = ranks[np.arange(len(cells)), at] if ranks.shape[1] else np.full(len(cells), NONE)
        ended = best == NONE
        for i in np.flatnonzero(ended):
            ids = cells[i]
            out[rows[i]] = ids[ids >= 0].tolist()
        if ended.any():
            go = ~ended
            cells, ranks, rows, at, best = cells[go], ranks[go], rows[go], at[go], best[go]
            if not len(cells):
                return
        n, width = cells.shape
        every = np.arange(n)
        cells[every, at] = best
        keep = np.ones((n, width), bool)
        keep[every, at + 1] = False
        cells = cells[keep].reshape(n, width - 1)
        keep = np.ones((n, width - 1), bool)
        keep[every, at] = False
        ranks = ranks[keep].reshape(n, width - 2)
        if width > 2:
            before, after = at > 0, at < width - 2
            ranks[every[before], at[before] - 1] = vocabulary.rank(cells[every[before], at[before] - 1], best[before])
            ranks[every[after], at[after]] = vocabulary.rank(best[after], cells[every[after], at[after] + 1])


def _merge_long(vocabulary: Vocabulary, ids: np.ndarray) -> list[int]:
    """One long piece: each round merges every place of the pair of least rank, from the left, without overlap."""
    ranks = vocabulary.rank(ids[:-1], ids[1:])
    while len(ranks) and (best := ranks.min()) != NONE:
        places = np.flatnonzero(ranks == best)
        if len(places) > 1 and (np.diff(places) == 1).any():  # a run such as aaaa: every other place counts
            starts = np.concatenate(([True], np.diff(places) > 1))
            first = np.maximum.accumulate(np.where(starts, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - first) % 2 == 0]
        ids[places] = best
        ids = np.delete(ids, places + 1)
        ranks = np.delete(ranks, places)
        at = places - np.arange(len(places))
        before, after = at[at > 0], at[at < len(ids) - 1]
        ranks[before - 1] = vocabulary.rank(ids[before - 1], ids[before])
        ranks[after] = vocabulary.rank(ids[after], ids[after + 1])
    return ids.tolist()


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """The ids of each non-empty piece, by matrices of pieces of like length."""
    out: list = [None] * len(pieces)
    lengths = np.array([len(p) for p in pieces])
    for row in np.flatnonzero(lengths > LONG):
        out[row] = _merge_long(vocabulary, vocabulary.bytes[np.frombuffer(pieces[row], np.uint8)].copy())
    classes = np.ceil(np.log2(np.maximum(lengths, 2)) * 2).astype(int)
    classes[lengths > LONG] = -1
    for kind in np.unique(classes[classes >= 0]):
        every = np.flatnonzero(classes == kind)
        width = int(lengths[every].max())
        step = max(1, (1 << 21) // width)
        for start in range(0, len(every), step):
            rows = every[start : start + step]
            raw = np.frombuffer(b"".join(pieces[r].ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
            cells = vocabulary.bytes[raw]
            cells[np.arange(width) >= lengths[rows][:, None]] = -1
            _merge_matrix(vocabulary, cells, out, rows)
    return out


def encode_texts(vocabulary: Vocabulary, texts: Iterable[str | None], memo: dict[str, list[int]]) -> list[list[int]]:
    """The ids of each text; `memo` keeps the pieces that were met before."""
    find = regex.compile(PATTERN).findall
    cut = [find(t) if t else [] for t in texts]
    new = list({p for pieces in cut for p in pieces if p not in memo})
    memo.update(zip(new, encode_pieces(vocabulary, [p.encode("utf-8", "surrogatepass") for p in new])))
    return [[i for p in pieces for i in memo[p]] for pieces in cut]


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """`df` with the column `ids` (array<int>) in place of `text`.

    Narrow: no shuffle, one Arrow pass. A column already called `ids` is replaced. See the module for nulls and empties.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    kept = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, memo = shared.value, {}
        for batch in batches:
            if len(memo) > MEMO:
                memo.clear()
            lists = encode_texts(vocabulary, batch.column(text).to_pylist(), memo)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*kept, ids])

    return spread(df.select(*kept, text)).mapInArrow(run, schema)
