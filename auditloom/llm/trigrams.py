"""Trigram search: what a regex requires, and an index of a block of texts.

`required` reads the syntax tree of a regex and gives an AND/OR condition on trigrams (lower-cased) that every match must
fulfil. `Index` holds, for a block of texts in chunks, the sorted postings of every trigram; `candidates` intersects and unites them.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

import numpy as np

ALL: tuple = ("all",)
MOST = 64  # spellings kept exactly while a regex is read; beyond that the trigrams so far are made conditions


@dataclass
class _Part:
    exact: set[str] | None  # every string it can match, if these are few
    condition: tuple  # what else holds


def _and(*xs: tuple) -> tuple:
    flat = list(dict.fromkeys(y for x in xs if x != ALL for y in (x[1] if x[0] == "and" else (x,))))
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(*xs: tuple) -> tuple:
    if any(x == ALL for x in xs):
        return ALL
    flat = list(dict.fromkeys(y for x in xs for y in (x[1] if x[0] == "or" else (x,))))
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _strings(exact: set[str] | None) -> tuple:
    """One of these strings occurs."""
    if not exact:
        return ALL
    return _or(*(_and(*(("tri", s[i : i + 3]) for i in range(len(s) - 2))) for s in exact))


def _sequence(nodes) -> _Part:
    condition, run = [], {""}
    whole = True

    def close():
        nonlocal run, whole
        condition.append(_strings(run))
        run, whole = {""}, False

    for node in nodes:
        part = _read(node)
        condition.append(part.condition)
        if part.exact is None:
            close()
            continue
        longer = {a + b for a in run for b in part.exact}
        if len(longer) > MOST:
            close()
            longer = part.exact if len(part.exact) <= MOST else {""}
        run = longer
    if whole:
        return _Part(run, _and(*condition))
    condition.append(_strings(run))
    return _Part(None, _and(*condition))


def _read(node) -> _Part:
    kind, value = node
    if kind is C.LITERAL:
        return _Part({chr(value).lower()}, ALL)
    if kind is C.IN:
        chars: set[str] = set()
        for k, v in value:
            if k is C.LITERAL:
                chars.add(chr(v).lower())
            elif k is C.RANGE and v[1] - v[0] < 8:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return _Part(None, ALL)
        return _Part(chars, ALL) if len(chars) <= 8 else _Part(None, ALL)
    if kind is C.SUBPATTERN:
        return _sequence(value[-1])
    if kind is C.ATOMIC_GROUP:
        return _sequence(value)
    if kind is C.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(p.exact is not None for p in parts) and len(exact := set().union(*(p.exact for p in parts))) <= MOST:
            return _Part(exact, _or(*(p.condition for p in parts)))
        return _Part(None, _or(*(_and(p.condition, _strings(p.exact)) for p in parts)))
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = value
        part = _sequence(inner)
        if least == 0:
            return _Part({""} | part.exact, ALL) if most == 1 and part.exact and part.condition == ALL else _Part(None, ALL)
        if most == 1:
            return part
        return _Part(None, _and(part.condition, _strings(part.exact)))
    if kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return _Part({""}, ALL)
    return _Part(None, ALL)


def required(pattern: str) -> tuple:
    """The condition on trigrams that each match of `pattern` fulfils: ALL, ('tri', x), ('and', xs) or ('or', xs)."""
    part = _sequence(parser.parse(pattern))
    return _and(part.condition, _strings(part.exact))


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:] if len(points) > 2 else np.empty(0, np.uint64)


def _short(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)


def asked(condition: tuple) -> frozenset[str]:
    """The trigrams that a condition names."""
    if condition == ALL:
        return frozenset()
    return frozenset([condition[1]]) if condition[0] == "tri" else frozenset().union(*map(asked, condition[1]))


class Index:
    """The postings of the trigrams of a block of texts, by chunks of `chunk` characters; a trigram across a joint belongs to the first.

    `only` names the trigrams that are ever asked for; without it all are kept.
    """

    def __init__(self, texts: list[str], chunk: int = 20_000, only: frozenset[str] | None = None):
        self.size = len(texts)
        joined = "\0\0".join(t.lower() if len(t.lower()) == len(t) else "".join(c if len(c.lower()) > 1 else c.lower() for c in t) for t in texts)
        codes = _codes(joined)
        lengths = np.array([len(t) + 2 for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        pieces = -(-lengths // chunk)  # chunks of each text
        self.text = np.repeat(np.arange(self.size), pieces)  # of each chunk
        begins = np.repeat(starts, pieces) + chunk * (np.arange(len(self.text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        chunks = np.repeat(np.arange(len(self.text)), np.diff(np.append(begins, len(codes)).clip(max=len(codes))))
        if only is None:
            distinct, codes = np.unique(codes, return_inverse=True, sorted=True)
        else:
            distinct = np.sort(np.array([_codes(t)[0] for t in only], np.uint64))
            table = np.zeros(1 << 16, bool)  # what cannot be one of them goes by a hash
            table[_short(distinct)] = True
            kept = np.flatnonzero(table[_short(codes)])
            at = np.searchsorted(distinct, codes[kept]).clip(max=max(0, len(distinct) - 1))
            true = distinct[at] == codes[kept] if len(distinct) else np.zeros(0, bool)
            codes, chunks = at[true], chunks[kept[true]]
        # each trigram of a chunk once, in order
        key = np.sort(codes.astype(np.int64) * max(1, len(self.text)) + chunks)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        self.codes, self.chunks = distinct, key % max(1, len(self.text))
        self.ends = np.searchsorted(key, np.arange(len(distinct) + 1, dtype=np.int64) * max(1, len(self.text)))

    def posting(self, trigram: str) -> np.ndarray:
        """The texts in one of whose chunks the trigram lies, ascending."""
        code = _codes(trigram)[0]
        at = int(np.searchsorted(self.codes, code))
        if at == len(self.codes) or self.codes[at] != code:
            return np.empty(0, np.int64)
        texts = self.text[self.chunks[self.ends[at] : self.ends[at + 1]]]
        return texts[np.concatenate([[True], texts[1:] != texts[:-1]])] if len(texts) else texts

    def candidates(self, condition: tuple) -> np.ndarray:
        """The texts that fulfil `condition`, ascending."""
        if condition == ALL:
            return np.arange(self.size)
        kind, value = condition
        if kind == "tri":
            return self.posting(value)
        found = [self.candidates(x) for x in value]
        if kind == "or":
            return np.unique(np.concatenate(found))
        out = found[0]
        for other in sorted(found[1:], key=len):
            out = np.intersect1d(out, other, assume_unique=True)
        return out
