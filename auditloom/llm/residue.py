"""Template residue and error-page text: positive-unlabelled naive Bayes over passages, decisions per record.

A record's passages are its sentences outside code blocks, code spans and quotations. In a sample of records, passages that
have one of the fixed forms of `TRUSTED` are positive, all others unlabelled. Naive Bayes over hashed words, word pairs, marks
of unfilled fields and the length of a passage starts with the unlabelled as negative and is refined by expectation-maximization, in which the trusted stay positive.

The fitted weights alone decide: every passage of every record is scored, whether it has a trusted form or not (the forms are
not even looked for), and a record is residue if one of its passages reaches the log-odds `ODDS`.

The sample holds about `SAMPLE` records, drawn by a hash, and of each at most `PASSAGES` passages, drawn likewise. Without
any trusted passage nothing is residue. Null, empty and blank texts are no residue. Texts are read whole. Repeated rows are
judged each; ids may repeat or be null.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import spread

SAMPLE = 12_000
PASSAGES = 60
BITS = 18
ROUNDS = 8
ODDS = 4.0
SMOOTH = 0.02  # weight of a feature's overall share, as a part of the trusted passages
RARE = 3  # passages below which a feature says nothing
SLICE = 1 << 20  # characters of passages that are featured at once

FENCE = re.compile(r"(?ms)^[ \t>]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t>]*\1[^\n]*$|\Z)|<(pre|code)\b.*?(?:</\2>|\Z)")
SPAN = re.compile(r"``[^`]+``|`[^`\n]+`")
QUOTED = re.compile(r"\"[^\"\n]{2,300}\"|“[^”\n]{2,300}”|„[^“”\n]{2,300}[“”]|(?<!\w)'[^'\n]{3,200}'(?!\w)")
SENTENCE = re.compile(r"(?<=[.!?。！？])[ \t]+|(?<=[。！？])|</?noscript>|\r\n|[\n\r\u2028\u2029]")

# How a field is marked that a template should have filled. Marks are features; those of STRONG are trusted.
SHAPES = {
    "block": r"\{%-?\s*\w[^%{}\n]{0,80}%\}",
    "erb": r"<%=?[^%\n]{1,80}%>",
    "braces": r"\{\{[^{}\n]{1,80}\}\}",
    "dollar": r"\$\{[\w. ]{1,60}\}",
    "hash": r"#\{[\w. ]{1,60}\}",
    "percents": r"%%\w{1,60}%%",
    "brackets": r"\[\[\w{1,60}\]\]",
    "ats": r"@@\w{1,60}@@",
    "format": r"%\(\w{1,60}\)[sd]",
    "unders": r"(?<!\w)__[A-Z][A-Z0-9_]*__(?!\w)",
    "todo": r"(?i:\[(?:todo|tbd|fixme|insert|add|your|enter|placeholder|name|company)\b[^\]\n]{0,60}\])",
    "insert": r"(?i:<(?:insert|your|enter|add|todo)\b[^<>\n]{0,60}>)",
    "object": r"\[object Object\]",
    "upper": r"<[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*>",
    "guillemets": r"«\w+»",
    "angle": r"<\w[\w-]{0,40}>",
    "brace": r"(?<![\w$#{])\{\w{1,60}\}(?!\})",
}
STRONG = "block erb braces dollar hash percents brackets ats format unders todo insert object".split()
MARKS = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in SHAPES.items()))

FIELD = re.compile(r"[{<«]|%[%(]|\[\[|@@|__|\[[A-Za-z]")

# What servers, filler texts and script notices say.
TRUSTED = re.compile(
    r"""(?ix)
    ^\W*(?:error\W*)?[45]\d\d\W+(?:bad\ gateway|not\ found|forbidden|unauthorized|internal\ server\ error|service\ (?:temporarily\ )?unavailable|gateway\ time-?out|too\ many\ requests|bad\ request)\W*$
    |^\W*(?:error|erreur|fehler|erro)\s*[45]\d\d\W*$
    |^\W*(?:page\ not\ found|access\ denied|forbidden|too\ many\ requests|this\ site\ is\ under\ maintenance|your\ session\ has\ expired|something\ went\ wrong|unexpected\ application\ error|error\ establishing\ a\ database\ connection|oops\b.{0,40}
        |zugriff\ verweigert|acceso\ denegado|acc[eè]s\ (?:refus[eé]|interdit)|acesso\ negado|seite\ nicht\ gefunden|p[aá]gina\ n[aã]o\ encontrada|p[aá]gina\ no\ encontrada|page\ (?:non\ trouv[eé]e|introuvable)|доступ\ запрещ[её]н|страница\ не\ найдена|ページが見つかりません.{0,4}|アクセスが拒否されました.{0,4})\W*$
    |^\W*(?:please\ |you\ (?:need|have)\ to\ |bitte\ |veuillez\ )?(?:enable|turn\ on|activate|aktivieren|activer|activa|ative)\b.{0,12}\bjavascript\b
    |^\W*javascript\ is\ (?:disabled|required|turned\ off)|(?:this|the)\ (?:page|site|app)\ requires\ (?:scripts|javascript)|(?:does\ not|doesn'?t)\ (?:support\ scripting|work\ (?:properly\ )?without\ javascript)|scripting\ is\ (?:switched|turned)\ off|\bneeds\ (?:scripts|javascript)\b
    |lorem\ ipsum\ dolor\ sit\ amet|^\W*(?:text|content|your\ (?:text|description|content|title))\ goes\ here\W*$|^\W*insert\ (?:content|text)(?:\ here)?\W*$|^\W*placeholder\ (?:copy|text)\b.{0,40}$|^\W*(?:sample|dummy|filler|example)\ (?:text|paragraph|content|copy)\b.{0,40}$|^\W*platzhaltertext\W*$|^\W*aqu[ií]\ va\ el\ texto\W*$
    |^\W*(\w{3,8}(?:\ \w{3,8}){0,2})(?:\W+\1){3,}\W*$
    """
)
TOKEN = re.compile(r"[^\W_\u3040-\u30ff\u3400-\u9fff]+|\n|§\w+|[\u3040-\u30ff\u3400-\u9fff]")  # unspaced scripts by the letter
END = 0x9E3779B1
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """The code of every token; numbers have one, ends of passages another."""

    def __missing__(self, token: str) -> int:
        code = END if token == "\n" else 7 if token[0].isdigit() else zlib.crc32(token.encode("utf-8", "surrogatepass"))
        if len(self) < 500_000:
            self[token] = code
        return code


def _mark(m: re.Match) -> str:
    return f" §{m.lastgroup} "


def passages(text: str) -> list[str]:
    """The sentences of a text outside code and quotations."""
    if "```" in text or "~~~" in text or "<pre" in text or "<code" in text:
        text = FENCE.sub("\n", text)
    if "`" in text:
        text = SPAN.sub(" code ", text)
    text = QUOTED.sub(" quoted ", text)
    return [s for s in map(str.strip, SENTENCE.split(text)) if len(s) > 1]


def trusted(passage: str) -> bool:
    """Whether a passage has one of the fixed forms."""
    return bool(FIELD.search(passage)) and any(m.lastgroup in STRONG for m in MARKS.finditer(passage)) or bool(TRUSTED.search(passage))


def _hashed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values + np.uint64(1)) * MIX
        return ((values ^ (values >> np.uint64(29))) * MIX) >> np.uint64(64 - BITS)


def features(found: list[str], codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature), each pair once, of passages: hashed words, pairs, marks and the length."""
    n = len(found)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = "\n".join([MARKS.sub(_mark, p) if FIELD.search(p) else p for p in found]).lower()
    tokens = TOKEN.findall(text)
    c = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    ends = c == np.uint64(END)
    owner = np.cumsum(ends)
    word = ~ends
    single, at = c[word], owner[word]
    before, after = np.concatenate([[np.uint64(END)], c]), np.concatenate([c, [np.uint64(END)]])
    place = np.concatenate([[0], owner])
    real = (before != np.uint64(END)) | (after != np.uint64(END))
    pair = before[real] * np.uint64(0x100000001B3) ^ after[real]
    words = np.bincount(at, minlength=n)
    length = np.where(words < 6, words, np.minimum(words, 40) // 5 * 5).astype(np.uint64)
    own = np.arange(n)
    owners = np.concatenate([at, place[real], own])
    values = np.concatenate([single, pair, length | np.uint64(1 << 40)])
    key = np.sort(owners.astype(np.uint64) << np.uint64(BITS) | _hashed(values))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def fit(owner: np.ndarray, flat: np.ndarray, trusted: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The log-odds of every feature of passages (owner, flat), the last entry that of the classes."""
    weights = np.zeros((1 << BITS) + 1)
    if not trusted.any():
        weights[-1] = -1e9
        return weights
    positive = trusted.astype(float)
    used = np.bincount(flat, minlength=1 << BITS) >= RARE
    for _ in range(rounds):
        inside = np.bincount(flat, positive[owner], 1 << BITS)
        outside = np.bincount(flat, 1 - positive[owner], 1 << BITS)
        base, m = (inside + outside) / len(trusted), SMOOTH * trusted.sum() + 1
        a = np.log((inside + m * base + 1e-12) / (positive.sum() + m))
        b = np.log((outside + m * base + 1e-12) / ((1 - positive).sum() + m))
        weights[:-1] = np.where(used, a - b, 0)
        weights[-1] = np.log((positive.sum() + 1) / ((1 - positive).sum() + 1))
        odds = np.bincount(owner, weights[flat], len(trusted)) + weights[-1]
        positive = np.where(trusted, 1.0, 1 / (1 + np.exp(-np.clip(odds - ODDS, -60, 60))))
    return weights


def learn(df: DataFrame, doc: str, text: str, sample: int = SAMPLE, most: int = PASSAGES) -> np.ndarray:
    """Fit on about `sample` records, drawn by a hash of their id and text, and at most `most` passages of each, by a hash too."""
    given = df.where(F.length(F.trim(text)) > 0)
    drawn = given.where(F.pmod(F.xxhash64(doc, text), F.lit(max(1, df.count()))) < sample).select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            for given in batch.column(text).to_pylist():
                found = passages(given)
                if len(found) > most:
                    found = sorted(found, key=lambda p: zlib.crc32(p.encode("utf-8", "surrogatepass")))[:most]
                owner, flat = features(found, codes)
                rows = np.split(flat.astype(np.int32), np.flatnonzero(np.diff(owner)) + 1) if found else []
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([trusted(p) for p in found], pa.bool_())], ["features", "trusted"])

    found = spread(drawn).mapInArrow(run, "features binary, trusted boolean").toArrow()
    rows = found.column("features").to_pylist()
    flat = np.frombuffer(b"".join(rows), np.int32).astype(np.int64)
    return fit(np.repeat(np.arange(len(rows)), [len(r) // 4 for r in rows]), flat, np.array(found.column("trusted").to_pylist(), bool))


def odds_of(found: list[str], weights: np.ndarray, codes: _Codes) -> np.ndarray:
    """The log-odds of every passage, featured in slices."""
    ends = np.cumsum([len(p) + 1 for p in found])
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(found)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        owner, flat = features(found[a:b], codes)
        out.append(np.bincount(owner, weights[flat], b - a) + weights[-1])
    return np.concatenate(out) if out else np.empty(0)


def score(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, odds, passages, residue): of each record the log-odds of its likeliest passage, how many passages are residue, and
    the decision. Records without passages have null odds and are none. Narrow: one Arrow pass over all records."""
    model = df.sparkSession.sparkContext.broadcast(learn(df, doc, text))  # 2 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, weights = _Codes(), model.value
        for batch in batches:
            split = [passages(t) if t else [] for t in batch.column(text).to_pylist()]
            sizes = np.array([len(p) for p in split], np.int64)
            odds = odds_of([p for ps in split for p in ps], weights, codes)
            best, count = np.full(len(split), -np.inf), np.zeros(len(split), np.int32)
            owner = np.repeat(np.arange(len(split)), sizes)
            np.maximum.at(best, owner, odds)
            np.add.at(count, owner, odds >= ODDS)
            yield pa.RecordBatch.from_arrays([batch.column(doc), pa.array(best, mask=sizes == 0), pa.array(count), pa.array(count > 0)], [doc, "odds", "passages", "residue"])

    return spread(df.select(doc, text)).mapInArrow(run, f"{doc} {df.schema[doc].dataType.simpleString()}, odds double, passages int, residue boolean")
