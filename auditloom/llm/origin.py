"""Where code comes from: written by hand, generated, minified, copied from a package, or data stored as code.

Every file becomes a set of shingles of five tokens, with identifiers, numbers and strings masked. Files with equal sets
are one class; classes that fall into one bucket of a MinHash band are compared with each other and linked at a similarity
of 0.8 or more; linked classes are one family. What is seen in the files of a family are seeds; the family decides for all of
its files, against a seed too:

- generated: a generator's mark in a comment line or a generator's way of naming files, in `PREVAIL` of the family;
- data: literals prevail, in `MOST` of the family; minified: short names and hardly any space, likewise.

A family of one decides for itself. Copies of packages have the shapes of any code, so masked families cannot tell them;
they are known by a place or a licence of a package in a comment line, or as one text in several repositories.

Similarity is that of the whole sets, each shingle by 36 bits of its hash. Within a bucket only pairs that are linked already,
directly or through others, and pairs that cannot reach 0.8 are left uncompared, as neither can change a family. Sets are not
copied to all their buckets: each class is first compared in one of them, which links most of a family. For the other buckets
sketches of a set (the parity of its shingles in some bits) tell which classes can still be alike, as sets differ in at least as
many shingles as their sketches in bits; only these meet by their whole sets, those most alike first. Large buckets are compared
block by block, so that a task holds two blocks. What no bucket brings together (a pair at 0.8 with a chance of one in seventy)
is not compared.

Texts are taken apart many at once, as numbers; one by one only where letters beyond ASCII stay outside strings and comments, a
number touches a dollar sign, or a text holds the two signs that stand for strings there. Both ways give the same.

Null contents and empty files are written by hand for want of evidence. Files are read whole. Repeated rows do no harm.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.components import components
from auditloom.session import cut, released, spread

SHINGLE = 5
SIMILAR = 0.8
WIDTH = 36  # bits a shingle
BLOCK = 2048  # classes of a bucket whose sets are held at once, twice
SHEET = 32  # blocks of a bucket whose sketches are held at once, twice
BITS = 2  # least bits of a sketch a shingle
BANDS, ROWS = 8, 4
PREVAIL = 0.3  # share of a family with a generator's marks from which all of it is generated
MOST = 0.5  # share of a family that looks like data, or minified, from which all of it is
DENSE = 16  # letters of a line of a long string, without a space, from which it is data and no text
COPIES = 3  # repositories with one and the same text

# How generators mark their files, in comment lines.
GENERATED = re.compile(
    r"(?i)code generated by \S|@generated\b|<auto-?generated>|\bauto-?generated file\b|machine[- ](?:written|generated)\b.{0,40}(?:source|from|by)|generated on [\d-]+ by|do not modify by hand|produced by the \S+ (?:compiler|generator)"
    r"|(?:file|code) (?:is|was|has been) (?:auto(?:matically)?[- ]?)?(?:generated|created)\b.{0,40}\b(?:by|from|lost)|automatically (?:generated|created) (?:by|from)"
    r"|generado autom|g[ée]n[ée]r[ée] (?:autom|par)|(?:erzeugt|generiert) von .{0,60}nicht|automatisch (?:erzeugt|generiert)|gerado autom|сгенерирован"
)
NAMES = re.compile(r"(?i)(?:_pb2?|_pb2_grpc|\.pb|_gen|\.gen|\.generated|_generated|_autogen|\.g|_stub|_wire|\.designer)\.\w+$|(?:^|/)(?:gen|generated|autogen|stubs|__generated__)/")
# Where packages are kept, and what their licence heads say.
PLACES = re.compile(r"(?i)(?:^|/)(?:vendor|vendors|vendored|third[_-]?party|node_modules|bower|bower_components|pods|deps|external|externals|extern|static/lib|site-packages|jspm_packages)/[^/]+/")
LICENCES = re.compile(
    r"(?i)this is a copy of \S+ v?\d|@license\b|(?:\(c\)|copyright)\s*(?:\(c\)\s*)?\d{4}.{0,60}\b(?:contributors|project|authors|foundation)\b|permission is (?:hereby )?granted|released under the|redistribution (?:and use )?in source|^\W*/?\*?!\s*\w[\w-]* v?\d+\.\d+\.\d+"
)
# Comments and the first lines of strings that begin a line, or (without group) other strings, patterns and comments behind code,
# in which no comment is sought.
NOTE = re.compile(
    r"(?P<note>/\*[\s\S]*?\*/|^[ \t]*(?://|#|\*|<!--).*$)|^[ \t]*(?P<doc>\"\"\"[\s\S]*?\"\"\")|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|`(?:[^`\\]|\\[\s\S])*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
    r"|(?<=[=(,:!&|?{};])[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/|[ \t](?://|#)[ \t].*$",
    re.M,
)
# Comments, by the signs that a text holds (block, two slashes, number sign), and what stays of them: a line end before a whole line.
COMMENTS = {
    (block, line, sign): (
        re.compile("|".join([r"(\n)[ \t]*(?:" + "|".join(["//"] * line + ["#(?!include)"] * sign) + ").*"] * (line or sign) + [r"/\*[\s\S]*?\*/"] * block + [r"[ \t]//[ \t].*"] * line)),
        r"\1" if line or sign else "",
    )
    for block in (False, True)
    for line in (False, True)
    for sign in (False, True)
    if block or line or sign
}
STRING = r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`"
STRINGS = re.compile(STRING)
TOKEN = re.compile(r"[A-Za-z_$][\w$]*|[^\s\w$\"'`]|\d[\w.]*|" + STRING + r"|[\"'`]|[^\W\d_]+")
CUT_NUMBER = re.compile(r"(?<![\w.])[A-Za-z_.]*+\d[\w.]*+\$")
PAGE = 1 << 20  # letters of texts that are taken apart at once
WORDS = frozenset(
    "def class return if elif else for while in import from const let var function async await try except finally public private protected static final void int long string bool boolean func type struct interface package switch case default break continue new this self throw throws raise with as lambda yield map range chan select go defer extends implements export enum true false null None True False".split()
)
_random = np.random.default_rng(20240229)
FACTORS = _random.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTOR = np.uint64(1_000_003)
LONG, PROSE = ('"""', "'''"), "§"


class _Mask(dict):
    """The code of every token: one for all identifiers, one for numbers, one for strings, its own for any other."""

    def __missing__(self, token: str) -> int:
        c = token[0]
        if token in WORDS:
            code = zlib.crc32(token.encode()) + 16
        elif c.isalpha() or c in "_$":
            code = 1
        elif c.isdigit():
            code = 2
        elif c in "\"'`" and len(token) > 1:
            code = 3
        else:
            code = zlib.crc32(token.encode()) + 16
        if len(self) < 500_000:
            self[token] = code
        return code


# The ASCII letters as `TOKEN` sees them, with 1 for a string and 2 for one of prose, and the words as their first and last eight bytes.
_ascii = [chr(i) for i in range(128)]
IS_SPACE = np.array([c.isspace() for c in _ascii])
IS_WORD = np.array([c.isalnum() or c in "_$" for c in _ascii])
IS_DIGIT = np.array([c.isdigit() for c in _ascii])
CODES = np.array([3 if c == "\1" else _Mask()[PROSE if c == "\2" else c] for c in _ascii], np.uint64)
HEADS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_words = sorted(WORDS, key=lambda w: int.from_bytes(w[:8].encode(), "little"))
KEYS = np.array([int.from_bytes(w[:8].encode(), "little") for w in _words], np.uint64)
KEY_ENDS = np.array([int.from_bytes(w[-8:].encode(), "little") for w in _words], np.uint64)
KEY_SIZES = np.array([len(w) for w in _words])
KEY_CODES = np.array([_Mask()[w] for w in _words], np.uint64)


def notes(text: str) -> str:
    """The comment lines of a whole text."""
    return "\n".join(m["note"] or m["doc"].split("\n")[0] for m in NOTE.finditer(text) if m.lastgroup)


def without_comments(text: str) -> str:
    held = "/*" in text, "//" in text, "#" in text
    if not any(held):
        return text
    pattern, kept = COMMENTS[held]
    return pattern.sub(kept, "\n" + text)[1:]


def _long(token: str) -> bool:
    return len(token) > 5 and token[:3] in LONG


def _dense(token: str) -> list[str]:
    """The lines of a long string that hold data."""
    return [line for line in token[3:-3].split("\n") if len(line) >= DENSE and " " not in line.strip()]


def tokens_of(body: str) -> tuple[list[str], int]:
    """(tokens, letters of data in long strings); a long string is one token of text, or a literal for each of its lines that hold data."""
    tokens, letters = TOKEN.findall(body), 0
    if '"""' in body or "'''" in body:
        for at in reversed([i for i, t in enumerate(tokens) if _long(t)]):
            dense = _dense(tokens[at])
            letters += sum(map(len, dense))
            tokens[at : at + 1] = ['""'] * len(dense) or [PROSE]
    return tokens, letters


# What stands in every text that a mark or a licence can be found in; all others need no search for comments.
HINTED = "generated created machine erzeugt generiert automatisch gerado generado сгенерирован copyright (c) redistribution @license".split() + ["do not modify by hand", "produced by the", "this is a copy of", "permission is", "released under the"] + [f"g{x}n{y}r{z}" for x in "eé" for y in "eé" for z in "eé"]
PLAIN_HINTS = [w for w in HINTED if w.isascii()]
HEAD = re.compile(r"(?i)!\s*\w[\w-]* v?\d+\.\d+\.\d+")


def hinted(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in (PLAIN_HINTS if text.isascii() else HINTED)) or "!" in text and bool(HEAD.search(text))


def _seen(text: str, path: str) -> tuple[bool, bool]:
    """(generated, vendored): what a file's comments and its path say."""
    said = notes(text) if hinted(text) else ""
    return bool(NAMES.search(path)) or bool(GENERATED.search(said)), bool(PLACES.search(path)) or bool(LICENCES.search(said))


def _looks(body: str, n: int, numbers: int, strings: int, letters: int, names: int, spelt: int) -> tuple[bool, bool]:
    """(data, minified) of a text of n tokens: numbers, strings and the letters of these, names and the letters of these."""
    data = bool(n) and (n >= 20 and (numbers + strings) / n >= 0.35 or len(body) >= 400 and letters / len(body) >= 0.7)
    minified = not data and n >= 50 and sum(map(body.count, " \t\n")) / len(body) < 0.08 and names > 0 and spelt / names < 3
    return data, minified


def _rolled(codes: np.ndarray) -> np.ndarray:
    """A number below 2^63 of each `SHINGLE` codes in a row."""
    n = max(0, len(codes) - SHINGLE + 1)
    rolled = codes[:n] * FACTOR
    for i in range(1, SHINGLE):
        rolled += codes[i : n + i]
        if i < SHINGLE - 1:
            rolled *= FACTOR
    return (rolled ^ (rolled >> np.uint64(29))) * MIX >> np.uint64(1)  # below 2^63, so the JVM sorts them alike


def _class(shingles: np.ndarray) -> tuple:
    """(class, set, bands) of the shingles of a file."""
    if not len(shingles):
        return None, b"", []
    mixed = np.sort(shingles)
    distinct = mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]
    least = (np.multiply.outer(FACTORS, distinct).min(axis=1) >> np.uint64(11)).reshape(BANDS, ROWS)
    bands = (least * FACTORS[:ROWS]).sum(axis=1) ^ (np.arange(BANDS, dtype=np.uint64) * MIX)
    packed = pack(distinct >> np.uint64(63 - WIDTH))
    return _id(packed, 8), packed, bands.view(np.int64).tolist()


def measure(text: str, path: str, mask: _Mask) -> tuple:
    """(generated, vendored, data, minified: what is seen; class, set, bands) of a file."""
    body = without_comments(text)
    tokens, letters = tokens_of(body)
    n = len(tokens)
    codes = np.fromiter(map(mask.__getitem__, tokens), np.uint64, n)
    strings = np.flatnonzero(codes == 3).tolist()
    names = np.flatnonzero(codes == 1).tolist()
    letters += sum([len(tokens[i]) for i in strings])
    looks = _looks(body, n, np.count_nonzero(codes == 2), len(strings), letters, len(names), sum([len(tokens[i]) for i in names]))
    return *_seen(text, path), *looks, *_class(_rolled(codes))


def _shortened(body: str) -> tuple[str, int] | None:
    """(a text with a sign for each token that is a string, letters of these); None where a text is not of the letters that `_page` knows."""
    if "\1" in body or "\2" in body:
        return None
    letters = 0
    if '"""' in body or "'''" in body:

        def sign(m: re.Match) -> str:
            nonlocal letters
            token = m[0]
            if not _long(token):
                letters += len(token)
                return "\1"
            dense = _dense(token)
            letters += sum(map(len, dense)) + 2 * len(dense)
            return "\1" * len(dense) or "\2"

        short = STRINGS.sub(sign, body)
    else:
        short, strings = STRINGS.subn("\1", body)
        letters = len(body) - len(short) + strings
    return None if not short.isascii() or "$" in short and CUT_NUMBER.search(short) else (short, letters)


def _page(texts: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """((tokens, numbers, strings, names, letters of names), shingles) of each shortened text, the tokens those of `TOKEN`, all texts at once."""
    page = np.frombuffer("\n".join([*texts, " " * 16]).encode(), np.uint8)
    word = IS_WORD[page]
    inner = word.copy()
    inner[1:] &= word[:-1]
    inner[0] = False
    at = np.flatnonzero(~(inner | IS_SPACE[page]))
    first = page[at]
    named = word[at]
    size = np.ones(len(at), np.int64)
    size[named] = np.flatnonzero(word[:-1] & ~word[1:]) + 1 - at[named]
    number = IS_DIGIT[first]
    # a number goes on over dots and names, as far as these touch
    piece = named | (first == ord("."))
    begins = np.ones(len(at), bool)
    begins[1:] = ~(piece[1:] & piece[:-1] & (at[1:] == at[:-1] + size[:-1]))
    order = np.arange(len(at))
    latest = np.maximum.accumulate(np.where(number, order, -1))
    start = np.maximum.accumulate(np.where(begins, order, 0))
    kept = np.ones(len(at), bool)
    kept[1:] = latest[:-1] < start[1:]
    at, first, size, named, number = at[kept], first[kept], size[kept], named[kept], number[kept]
    codes = CODES[first]
    could = np.flatnonzero(named & ~number & (size >= KEY_SIZES.min()) & (size <= KEY_SIZES.max()))
    begin = page[at[could][:, None] + np.arange(8)].view(np.uint64).ravel() & HEADS[np.minimum(size[could], 8)]
    key = np.minimum(np.searchsorted(KEYS, begin), len(KEYS) - 1)
    same = np.flatnonzero((KEYS[key] == begin) & (KEY_SIZES[key] == size[could]))
    could, key = could[same], key[same]
    end = page[(at[could] + np.maximum(size[could], 8) - 8)[:, None] + np.arange(8)].view(np.uint64).ravel()
    same = (size[could] <= 8) | (KEY_ENDS[key] == end)
    codes[could[same]] = KEY_CODES[key[same]]
    shingles = _rolled(codes)
    ends = np.cumsum([len(x) + 1 for x in texts])
    bounds = np.concatenate([[0], np.searchsorted(at, ends)])
    total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[bounds]).tolist()
    names = codes == 1
    for i, counts in enumerate(zip(np.diff(bounds).tolist(), total(codes == 2), total(codes == 3), total(names), total(np.where(names, size, 0)))):
        yield counts, shingles[bounds[i] : max(bounds[i], bounds[i + 1] - SHINGLE + 1)]


def measure_all(files: list[tuple[str, str]], mask: _Mask) -> list[tuple]:
    """`measure` of each (text, path), by numbers over many texts at once; one by one are only texts that `_shortened` leaves."""
    out: list = [None] * len(files)
    waiting, letters = [], 0

    def done() -> None:
        for (i, body, (_, long)), ((n, numbers, strings, names, spelt), shingles) in zip(waiting, _page([w[2][0] for w in waiting])):
            text, path = files[i]
            out[i] = *_seen(text, path), *_looks(body, n, numbers, strings, long, names, spelt), *_class(shingles)
        waiting.clear()

    for i, (text, path) in enumerate(files):
        body = without_comments(text)
        short = _shortened(body)
        if short is None:
            out[i] = measure(text, path, mask)
            continue
        waiting.append((i, body, short))
        letters += len(short[0])
        if letters >= PAGE:
            done()
            letters = 0
    done()
    return out


def pack(values: np.ndarray) -> bytes:
    """Numbers of 36 bits in four and a half bytes each."""
    high = (values >> np.uint64(32)).astype(np.uint8)
    if len(high) % 2:
        high = np.append(high, np.uint8(0))
    return values.astype("<u4").tobytes() + (high[::2] | high[1::2] << np.uint8(4)).tobytes()


def count(packed: bytes) -> int:
    return 2 * len(packed) // 9


def unpack(packed: bytes) -> np.ndarray:
    n = count(packed)
    both = np.frombuffer(packed, np.uint8, offset=4 * n)
    high = np.stack([both & np.uint8(15), both >> np.uint8(4)], axis=1).ravel()[:n]
    return np.frombuffer(packed, "<u4", n).astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def _id(data: bytes, size: int):
    """A number of 64 bits, or `size` bytes, that stands for these bytes."""
    digest = hashlib.blake2b(data, digest_size=size).digest()
    return int.from_bytes(digest, "little", signed=True) if size == 8 else digest


def same_path(path: Column) -> Column:
    """A path as it is meant: slashes one way and once, no leading dot or slash, no step up, no outer space, one case."""
    p = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^\s+|\s+$|^[A-Za-z]:(?=/)|^file://", "")
    p = F.regexp_replace(F.regexp_replace(p, "/{2,}", "/"), r"(?<=^|/)(?:\./)+", "")
    for _ in range(3):
        p = F.regexp_replace(p, r"(?:^|(?<=/))(?!\.\.)[^/]+/\.\./", "")
    spelt = path.rlike(r"\\|//|^[\s/.]|[\s/]$|/\.|:")  # most paths are as they should be
    return F.lower(F.when(spelt, F.regexp_replace(p, r"^/+|/+$", "")).otherwise(path))


def measured(source_files: DataFrame) -> DataFrame:
    """(repo, file_path, text, generated, vendored, data, minified, class, set, bands): one Arrow pass over the files."""
    schema = "repo string, file_path string, text binary, generated boolean, vendored boolean, data boolean, minified boolean, class long, set binary, bands array<long>"
    types = [pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = _Mask()
        for batch in batches:
            repos, paths, texts = (batch.column(c).to_pylist() for c in ("repo", "file_path", "content"))
            seen = measure_all([(text, path or "") for path, text in zip(paths, texts)], mask)
            rows = [(repo, path, _id(text.encode("utf-8", "surrogatepass"), 16), *s) for repo, path, text, s in zip(repos, paths, texts, seen)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

    return spread(source_files.where("content is not null").select("repo", "file_path", "content")).mapInArrow(run, schema)


def _bits(sets: list[bytes]) -> np.ndarray:
    """A row of bits for each set, a column for each shingle of two sets or more."""
    each = [unpack(x) for x in sets]
    values = np.concatenate([*each, np.empty(0, np.uint64)])
    _, codes, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts > 1
    columns = np.where(shared, np.cumsum(shared) - 1, -1)[codes]
    width = -(-max(1, int(shared.sum())) // 64) * 64
    ends = np.cumsum([len(x) for x in each])
    out = np.zeros((len(sets), width // 64), np.uint64)
    for first in range(0, len(sets), 256):
        last = min(first + 256, len(sets))
        flat = np.zeros((last - first, width), bool)
        for row in range(first, last):
            own = columns[ends[row - 1] if row else 0 : ends[row]]
            flat[row - first, own[own >= 0]] = True
        out[first:last] = np.packbits(flat, axis=1).view(np.uint64)
    return out


def _joined(table: pa.Table) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between labels in a bucket's block or between two, as many as join all that is alike; a number of what is joined, by row."""
    names = table.column("label").to_numpy()
    block, one, two = (table.column(c).to_numpy() for c in ("block", "one", "two"))
    sets = table.column("set").to_pylist()
    bits, sizes = _bits(sets), np.array([count(x) for x in sets])
    label = np.unique(names, return_inverse=True)[1]
    found: list[tuple[int, int]] = []
    across = one[0] != two[0]
    for x in np.flatnonzero(block == one[0]):
        open_ = (label != label[x]) & (np.minimum(sizes, sizes[x]) >= SIMILAR * np.maximum(sizes, sizes[x]))
        if across:
            open_ &= block == two[0]
        else:
            open_[:x] = False
        others = np.flatnonzero(open_)
        if not len(others):
            continue
        common = np.bitwise_count(bits[others] & bits[x]).sum(axis=1, dtype=np.int64)
        alike = others[common / (sizes[others] + sizes[x] - common) >= SIMILAR]
        if len(alike):
            labels, at = np.unique(label[alike], return_index=True)
            found += [(int(names[x]), int(names[y])) for y in alike[at]]
            label[np.isin(label, labels)] = label[x]
    return found, label


def _links(table: pa.Table) -> pa.Table:
    """(a, b): the links of `_joined`."""
    found, _ = _joined(table)
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def sketch(packed: bytes) -> bytes:
    """The parity of a set's shingles in so many bits that there are `BITS` a shingle or more, a power of two."""
    width = 1 << max(6, (BITS * count(packed) - 1).bit_length())
    at = (unpack(packed) * MIX >> np.uint64(32) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(bool)).tobytes()


def _at_home(table: pa.Table) -> pa.Table:
    """(class, size, sketch, label) of each class of a group; classes that are joined have the least of them as label."""
    names, sets = table.column("class").to_numpy(), table.column("set").to_pylist()
    _, numbers, at = np.unique(_joined(table)[1], return_index=True, return_inverse=True)
    least = np.full(len(numbers), np.iinfo(np.int64).max)
    np.minimum.at(least, at, names)
    return pa.table({"class": pa.array(names), "size": pa.array([count(x) for x in sets], pa.int64()), "sketch": pa.array([sketch(x) for x in sets], pa.binary()), "label": pa.array(least[at])})


def _near(table: pa.Table, best: bool) -> np.ndarray:
    """Of a bucket's block or two: the classes that can be alike one with another label; at `best`, only the likeliest of each two labels."""
    sizes, block, one, two = (table.column(c).to_numpy() for c in ("size", "block", "one", "two"))
    label = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
    sketches = table.column("sketch").to_pylist()
    widths = np.array([8 * len(x) for x in sketches])
    most = np.bincount(label).argmax()
    rest = label != most  # of every two labels one is not the most frequent
    near = np.zeros(len(label), bool)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero((widths == width) | (widths == 2 * width))  # sizes that can be alike differ by a quarter at most
        own = widths[at] == width
        bits = np.empty((len(at), width // 64), np.uint64)
        for row, x in enumerate(at.tolist()):
            words = np.frombuffer(sketches[x], np.uint64)
            bits[row] = words if own[row] else words[: width // 64] ^ words[width // 64 :]
        size, side = sizes[at], block[at]
        for row in np.flatnonzero(rest[at]).tolist():
            x = at[row]
            open_ = (label[at] != label[x]) & (np.minimum(size, size[row]) >= SIMILAR * np.maximum(size, size[row]))
            if not own[row]:
                open_ &= own
            if one[0] != two[0]:
                open_ &= side != side[row]
            others = np.flatnonzero(open_)
            if not len(others):
                continue
            differ = np.bitwise_count(bits[others] ^ bits[row]).sum(axis=1, dtype=np.int64)
            both = size[others] + size[row]
            can = differ * (1 + SIMILAR) <= both * (1 - SIMILAR) + 1e-6
            if not can.any():
                continue
            near[x] = True
            others = others[can][np.argsort((differ / both)[can], kind="stable")]
            if best:
                labels, first = np.unique(label[at[others]], return_index=True)
                near[at[others[first]]] = True
                label[np.isin(label, labels)] = label[x]
            else:
                near[at[others]] = True
    return near


def _dealt(places: DataFrame, block: int) -> DataFrame:
    """(class, places) of (class, band, n): the pairs of blocks (one <= two) of each bucket that a class is in."""
    blocks = places.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    pair = lambda i: F.struct(F.col("band"), F.col("block"), F.least("block", i).alias("one"), F.greatest("block", i).alias("two"))
    pairs = blocks.withColumn("block", own).select("class", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("p"))
    return pairs.groupBy("class").agg(F.collect_list("p").alias("places"))


def _homes(classes: DataFrame, full: DataFrame, block: int) -> DataFrame:
    """What `_at_home` tells of each class in one of its buckets, the largest that needs no blocks, else the largest of all."""
    home = full.groupBy("class").agg(F.max(F.struct(F.col("n") <= block, "n", "band")).alias("h"))
    blocks = F.ceil(F.col("h.n") / block).cast("int")
    home = home.select("class", "h.band", F.pmod(F.xxhash64("class"), blocks).cast("int").alias("block"))
    members = classes.select("class", "set").join(home, "class").withColumns({"label": F.col("class"), "one": F.col("block"), "two": F.col("block")})
    return cut(members.groupBy("band", "one", "two").applyInArrow(_at_home, "class long, size long, sketch binary, label long"))


def _meant(full: DataFrame, sketches: DataFrame, labels: DataFrame, best: bool, sheet: int) -> DataFrame:
    """(class, band) of the classes that `_near` finds in the buckets that hold several labels."""
    labelled = full.join(labels, "class")
    several = labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("band")
    members = sketches.join(labels, "class").join(_dealt(full.join(several, "band", "left_semi"), sheet), "class")

    def near(table: pa.Table) -> pa.Table:
        found = _near(table, best)
        return table.select(["class", "band"]).filter(pa.array(found))

    return cut(members.select("class", "label", "size", "sketch", F.inline("places")).groupBy("band", "one", "two").applyInArrow(near, "class long, band long").distinct())


def _compared(classes: DataFrame, places: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """(a, b): links between the labels of classes that meet in the places (class, band), by their whole sets."""
    counted = places.join(places.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band")
    members = classes.select("class", "set").join(_dealt(counted, block).join(labels, "class"), "class").select("class", "label", "set", F.inline("places"))
    return cut(members.groupBy("band", "one", "two").applyInArrow(_links, "a long, b long").distinct())


def families(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(class, family) of every class that is linked to another."""
    spark = classes.sparkSession
    banded = classes.select("class", F.explode("bands").alias("band")).distinct()
    full = cut(banded.join(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band"))
    homes = _homes(classes, full, block)
    sketches, labels = homes.drop("label"), homes.select("class", "label")
    for best in (True, False):
        released(spark)
        places = _meant(full, sketches, labels, best, SHEET * block)
        released(spark)
        links = _compared(classes, places, labels, block)
        if not links.isEmpty():
            labels = cut(_relabelled(labels, links))
    released(spark)
    linked = labels.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    return labels.join(linked, "label").select("class", F.col("label").alias("family"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (class, label) after links (a, b) between them: the least of all that are joined."""
    found = components(links).withColumnRenamed("node", "label")
    return labels.join(found, "label", "left").select("class", F.coalesce("component", "label").alias("label"))


def decided(files: DataFrame, found: DataFrame) -> DataFrame:
    """(class, decision) of the classes whose family is generated, data or minified; `found` is (class, family).

    Each file counts once, however many rows repeat it. A family that holds most of all files costs one row a task.
    """
    seen = files.where("class is not null").dropDuplicates(["repo", "file_path"])
    classes = seen.groupBy("class").agg(F.count("*").alias("files"), *(F.count_if(k).alias(k) for k in ("generated", "data", "minified")))
    sizes = classes.join(found, "class", "left").withColumn("family", F.coalesce("family", "class"))
    whole = sizes.groupBy("family").agg(F.sum("files").alias("n"), *(F.sum(k).alias(k) for k in ("generated", "data", "minified")))
    over = lambda k, share: F.col(k) >= F.col("n") * share
    decision = F.when(over("generated", PREVAIL), "generated").when(over("data", MOST), "data").when(over("minified", MOST), "minified")
    return sizes.select("class", "family").join(whole.select("family", decision.alias("decision")).where("decision is not null"), "family").select("class", "decision")


def origins(source_files: DataFrame) -> DataFrame:
    """(repo, file_path, origin): each file once; origin is generated, vendored, data, minified or null (by hand)."""
    files = cut(measured(source_files))
    classes = files.where("class is not null").groupBy("class").agg(F.first("set").alias("set"), F.first("bands").alias("bands"))
    decisions = decided(files.select("repo", "file_path", "generated", "data", "minified", "class"), families(classes))
    places = files.where((F.length("set") >= len(pack(np.arange(20, dtype=np.uint64)))) & ~F.col("vendored")).select("text", "repo").distinct()
    copied = places.groupBy("text").agg(F.count("*").alias("repos")).where(F.col("repos") >= COPIES).select("text", F.lit(True).alias("copied"))
    judged = files.drop("set", "bands").join(decisions, "class", "left").join(copied, "text", "left")
    short = F.when(F.col("class").isNull(), F.when(F.col("generated"), "generated").when(F.col("data"), "data"))  # too few tokens for a shingle
    origin = F.coalesce(F.when(F.col("decision").isin("generated", "data", "minified") & ~F.col("vendored"), F.col("decision")), F.when(F.col("vendored"), "vendored"), short, F.when(F.col("copied"), "vendored"))
    return judged.select("repo", "file_path", origin.alias("origin")).dropDuplicates(["repo", "file_path"])


def led_to(files: DataFrame, *findings: DataFrame) -> DataFrame:
    """The rows of `files` (repo, file_path, ...) to which a finding of the same repository leads, however its path is spelt."""
    paths = None
    for f in findings:
        one = f.select("repo", "file_path")
        paths = one if paths is None else paths.unionByName(one)
    spelt = paths.distinct().select("repo", same_path(F.col("file_path")).alias("same"))
    return files.withColumn("same", same_path(F.col("file_path"))).join(spelt, ["repo", "same"], "left_semi").drop("same").select(*files.columns)
