"""Credentials in code: found by rules through a trigram index, judged by their value, hidden in place.

Each Arrow batch is a block of texts, cut into chunks. A trigram index of the block is built over the chunks, the trigrams that
each rule's regex requires are derived from it, the postings are intersected, and the regex runs on the candidates alone. As a
match may be of any length, the trigrams may lie in several chunks of a text, and the regex runs on the whole text. A hit
counts if its value is a literal that would grant access: not a placeholder, a mask, a reference or a word. Values written in
pieces are read joined. Values have no greatest length.

Null and empty texts hold nothing. Texts are searched whole, whatever their length. Other columns pass.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm import trigrams
from auditloom.session import spread

CHUNK = 20_000  # characters of a text that share their postings
HIDDEN = "REDACTED"

Q = "[\"'`]"
# Words in a name that make its value a password, or a key, token or the like.
PASSWORD = r"pass(?:word|wd|phrase|code)?|pwd|kennwort|passwort|clave|contrase[nñ]a|senha|mot_?de_?passe|_pw"
KEYLIKE = r"secret|token|api_?key|apikey|access_?key|(?:auth|hmac|signing|service|client|app|private|account|encryption|master|cert|firebase|secret|license|deploy|admin|shared|webhook|storage|session|jwt|crypt|ssh|rsa|pem)[_-]?(?:key|secret|token|id_token)|credentials?|session|authorization|_auth|bearer|jwt|pem"
URLISH = r"(?:[a-z][a-z0-9+.-]{1,20})://"


@dataclass(frozen=True)
class Rule:
    """A detector: its regex (the value is the group `v`) and what the value has to be."""

    name: str
    pattern: str
    kind: str
    part: str = ""  # what each match holds, for patterns that are dear to search for


RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:\s|\\r|\\n|\\\\n|[\"'+,>]|&#10;|Proc-Type[^\\\n]*|DEK-Info[^\\\n]*)*(?P<v>[A-Za-z0-9+/=]{16,}(?:(?:\s|\\r|\\n|\\\\n)+[A-Za-z0-9+/=]{4,})*)", "any"),
    Rule("encoded_private_key", r"(?P<v>LS0tLS1CRUdJTi[A-Za-z0-9+/=]{24,})", "encoded_key"),
    Rule("aws_access_key", r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[A-Z0-9]{12,20})(?![A-Za-z0-9])", "known"),
    Rule("github_token", r"(?<![A-Za-z0-9])(?P<v>(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{20,})", "known"),
    Rule("sk_token", r"(?<![A-Za-z0-9])(?P<v>sk-(?:[a-z]{2,8}-)?[A-Za-z0-9_-]{20,})", "known"),
    Rule("stripe_key", r"(?<![A-Za-z0-9])(?P<v>[sr]k_(?:live|test)_[A-Za-z0-9]{12,})", "known"),
    Rule("chat_token", r"(?<![A-Za-z0-9])(?P<v>xox[abeprs]-[A-Za-z0-9-]{10,})", "known"),
    Rule("lab_token", r"(?<![A-Za-z0-9])(?P<v>gl(?:b|pat|rt|ft|dt)-[A-Za-z0-9_-]{16,})", "known"),
    Rule("dashed_token", r"(?<![A-Za-z0-9-])(?P<v>[A-Z0-9]{8}-[A-Za-z0-9]{24})(?![A-Za-z0-9-])", "known"),
    Rule("google_key", r"(?<![A-Za-z0-9])(?P<v>AIza[A-Za-z0-9_-]{30,})", "known"),
    Rule("mail_token", r"(?<![A-Za-z0-9])(?P<v>(?:SG|qlm)\.[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{4,})", "known"),
    Rule("json_web_token", r"(?<![A-Za-z0-9])(?P<v>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{6,})?)", "known"),
    Rule("account_key", r"(?i)AccountKey=(?P<v>[A-Za-z0-9+/=_-]{16,})", "token"),
    Rule("url_password", URLISH + r"[^\s\"'`/@:<>]{0,60}:(?P<v>[^\s\"'`@/<>{}]{3,})@[\w.\[\]-]", "password"),
    Rule("url_parameter", r"(?i)[?&](?:[a-z_-]*key|[a-z_-]*token|sig|signature|secret|password|pwd|auth)=(?P<v>[^\s\"'`&#<>]{8,})", "token"),
    Rule("hook_address", r"(?i)/(?:services|hooks?|webhooks?)/(?:[a-z0-9_-]{1,20}/){0,3}(?P<v>[A-Za-z0-9._+=/-]{16,})", "token"),
    Rule("basic_header", r"(?i)basic\s+(?P<v>[A-Za-z0-9+/_-]{8,}={0,2})", "basic"),
    Rule("bearer_header", r"(?i)bearer\s+(?P<v>[A-Za-z0-9._~+/=-]{12,})", "token"),
    Rule("header", r"(?i)authorization[\"']?\s*[:=,]\s*[\"'`]?(?:token|apikey|key)\s+(?P<v>[A-Za-z0-9._~+/=-]{12,})", "token"),
    Rule("user_option", r"(?i)(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user)[ =]+[\"']?[\w.@-]+:(?P<v>[^\s\"'`]{4,})", "password"),
    Rule("client_option", r"(?i)\b(?:mysql|mysqldump|mariadb|mongo|redis-cli|psql)\b[^\n\"'`]*?\s-(?:p|a\s)(?P<v>[^\s\"'`]{4,})", "password"),
    Rule("sshpass", r"(?i)sshpass\s+-p\s*\\?[\"']?(?P<v>[^\s\"'`\\]{4,})", "password"),
    Rule("identified_by", r"(?i)identified\s+(?:with\s+\w+\s+)?by\s+(?:password\s+)?\\?[\"'](?P<v>[^\"'\n\\]{4,})", "password"),
    Rule("password_name", r"(?i)(?P<n>(?:" + PASSWORD + r")[\w-]{0,20})(?:\\?[\"'`]|\]|[ \t])*(?::\s*(?:str|string|String|&str)\s*)?(?:[ \t]*(?::=|=>|=|:|,|\()(?:[ \t]*|\s*(?=[\"'`(]))|[ \t]+is[ \t]+|[ \t]+)(?:\(\s*)?(?:new\s+\w+\(|String\.valueOf\(|b|r|u|f)?\\?(?P<q>[\"'`])(?P<v>[^\"'`\n]{3,})", "quoted_password"),
    Rule("password_plain", r"(?i)(?P<n>(?:" + PASSWORD + r")[\w-]{0,20})[ \t]*(?:=|:|\bis\b)[ \t]*(?P<v>[^\s\"'`,;(){}\[\]<>]{4,})", "plain_password"),
    Rule("password_element", r"(?i)(?:name|key)\s*[=:]\s*[\"']?[\w.-]{0,40}(?:" + PASSWORD + r")[\w.-]{0,20}[\"']?\s*(?:>|/?>?\s*\n?\s*,?\s*[\"']?value[\"']?\s*[=:]\s*[\"']?)(?P<v>[^\"'<\n]{4,})", "quoted_password"),
    Rule("password_tag", r"(?i)(?<!:)<(?:[\w.-]{0,30}(?:" + PASSWORD + r")[\w.-]{0,20})>(?P<v>[^<\n]{4,})", "quoted_password"),
    Rule("key_name", r"(?i)(?P<n>(?:" + KEYLIKE + r"|key)[\w-]{0,20})(?:\\?[\"'`]|\]|[ \t])*(?::\s*(?:str|string|String|&str)\s*)?(?:[ \t]*(?::=|=>|=|:|,|\()(?:[ \t]*|\s*(?=[\"'`(]))|[ \t]+is[ \t]+|[ \t]+)(?:\(\s*)?(?:\\?[\"'`])?(?P<v>[A-Za-z0-9+/=_.~!$%^*-]{12,})", "named_token"),
    Rule("key_element", r"(?i)(?:name|key)\s*[=:]\s*[\"']?(?P<n>[\w.-]{0,40}(?:" + KEYLIKE + r"|key)[\w.-]{0,20})[\"']?\s*(?:>|/?>?\s*\n?\s*,?\s*[\"']?value[\"']?\s*[=:]\s*[\"']?)(?P<v>[A-Za-z0-9+/=_.~-]{12,})", "named_token"),
    Rule("key_tag", r"(?i)<(?P<n>[\w.-]{0,30}(?:" + KEYLIKE + r"|key)[\w.-]{0,20})>(?P<v>[A-Za-z0-9+/=_.~-]{12,})", "named_token"),
    Rule("positional", r"(?i)(?:(?:login|sign|auth\w*|connect|authenticate|with\w*|set\w*|token|client|credentials?|verify|encrypt|decrypt|hmac\w*|return|yield)\s*\(?|\[)\s*(?:[\"'`][\w.@-]{0,30}[\"'`]\s*,\s*)?[\"'`](?P<v>[A-Za-z0-9+/=_-]{16,})[\"'`]", "free_token", r"[\"'`][A-Za-z0-9+/=_-]{16,}[\"'`]"),
)

# Names whose value is no credential although they hold such a word.
HARMLESS_NAME = re.compile(
    r"(?i)(?:primary|sort|foreign|cache|partition|row|index|public|composite|unique|hash|dedup\w*|object|group|map|lookup|translation|i18n|host|license_plate|natural|route|routing|shard|idempotency)[_.-]?key"
    r"|public|token_?(?:type|pattern|count|limit|name|s\b|izer|ize)|max_?tokens|num_?tokens|csrf|keyboard|keyword|keydown|monkey|_label|\.error|_hint|placeholder|fingerprint|checksum|_sha|sha\d|integrity|digest|revision|commit|uuid|_id$|key_?id$|secret_?(?:name|ref|path|arn)|password_?(?:field|label|hint|policy|length|reset|regex|pattern)|confirm|minlength|(?:^|[_.-])(?:compass|bypass|passed|passive|passenger|passing)"
)
PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*+|•+|\.{3,}|_+|-+|0+|#+|change[-_ ]?(?:me|it|this)?|replace[-_ ]?(?:me|this|it)?|todo|tbd|fixme|none|null|nil|undefined|true|false|empty|unset|n/?a|dummy|example|sample|test(?:ing)?|secret|password|passwd|pass|pwd|token|key|hidden|masked|redacted|your[-_ ].*|my[-_ ].*|insert[-_ ].*|enter[-_ ].*|some[-_ ].*|put[-_ ].*|example[-_].*|placeholder.*|dummy[-_].*|fake[-_].*|default|optional|required|foo|bar|baz|string|str|value|prompt|input|xxx.*)[.!?]?$"
)
REFERENCE = re.compile(
    r"(?i)^(?:\$[a-z_{(]|%\(|%[A-Za-z_]{3,40}%$|\{|<|\[|\(|!(?:ref|sub|getatt|vault|secret|env)|#\{|arn:|vault:|ssm:|secret:|env[:.(]|env$|ref[:+]|file:|op://|keyring|kms:|sops:|enc\[|process\.env|os\.|system\.|config[.\[(]|cfg[.\[(]|settings[.\[(]|self\.|this\.|props\.|kwargs|args\.|req\.|request\.|opts\.|options\.|params\.|ctx\.|vault\.|getpass|prompt|input|read_?line|load_?|get_?|fetch_?\w*\(|generate|lookup|secretkeyref|valuefrom)"
)
UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
HEX = re.compile(r"^(?:0x)?[0-9a-fA-F]+$")
# What stands before embedded media, digests and public keys, and what these do not hold.
MEDIA = re.compile(r"(?i)data:[\w/+.-]*;base64,|sha(?:1|256|384|512)-|ssh-(?:rsa|ed25519|dss)\s+|ecdsa-\S+\s+|-----BEGIN (?:RSA )?(?:PUBLIC KEY|CERTIFICATE)-----\s*")
OTHER = re.compile(r"[^A-Za-z0-9+/=\s\\]")


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def _masked(v: str) -> bool:
    body = v.strip("\"'`<>[](){}")
    return not body or bool(PLACEHOLDER.match(body)) or len(set(body)) <= 2 or v[0] in "<[({" and v[-1] in ">])}" or "***" in v or "•" in v or "xxxx" in v.lower() or "..." in v or "EXAMPLE" in v


def _random(v: str, least: int) -> bool:
    """It looks drawn at random: long enough, with digits among letters or letters of mixed case, and no plain words."""
    if len(v) < least or re.fullmatch(r"[a-z]+(?:[-_./][a-z]+)*|[A-Z]+(?:[-_][A-Z]+)*|[a-z]+(?:[A-Z][a-z]+)+|[A-Za-z]+(?:[-_.][A-Za-z]+)*", v) and not _shuffled(v):
        return False
    return entropy(v) >= (2.4 if HEX.match(v) else 2.8) and (any(c.isdigit() for c in v) or _shuffled(v))


def _shuffled(v: str) -> bool:
    """Its letters change case as words do not."""
    letters = re.sub(r"[^A-Za-z]", "", v)
    changes = sum(a.islower() != b.islower() for a, b in zip(letters, letters[1:]))
    return len(letters) >= 6 and changes >= max(3, len(letters) * 0.28)


def _password(v: str, quoted: bool) -> bool:
    if _masked(v) or REFERENCE.match(v) or len(v) < 5:
        return False
    if " " in v.strip() or re.fullmatch(r"[\w.]+\(.*", v):
        return False
    if re.fullmatch(r"[A-Za-z_]+(?:[-_. ][A-Za-z_]+)*[:?!.,]?", v):  # words only; a mixed run of letters is none
        return _shuffled(v) and "." not in v
    if not quoted and re.fullmatch(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+|\d{1,5}", v):
        return False
    return any(c.isdigit() for c in v) or any(c in "!@#$%^&*?+=~/" for c in v) or _shuffled(v)


def _decoded(v: str) -> str:
    try:
        return base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return ""


def _media(text: str, at: int) -> bool:
    """Whether the run of letters in which place `at` lies, however long, is that of embedded media, a digest or a public key."""
    size, start = 256, 0
    while True:
        low = max(0, at - size)
        last = None
        for last in OTHER.finditer(text, low, at):
            pass
        if last or not low:
            start = last.end() if last else 0
            break
        size *= 8
    return any(m.end() >= start for m in MEDIA.finditer(text, max(0, start - 200), min(at, start + 60)))


def grants(kind: str, m: re.Match) -> bool:
    """Whether the value of a rule's match is a credential."""
    v, text = m["v"], m.string
    name = m.groupdict().get("n") or ""
    if name:  # the words before the one that was found belong to the name
        name = NAME_START.search(text, max(0, m.start("n") - 40), m.start("n"))[0] + name
    if kind == "any":
        return not _masked(v) and entropy(v) > 2.5
    if kind == "encoded_key":
        return "PRIVATE" in _decoded(v[: len(v) // 4 * 4][:80])
    if _media(text, m.start("v")):
        return False
    if kind == "known":  # the form says what it is
        return not _masked(v) and entropy(v) > 2.5
    if kind == "basic":
        inner = _decoded(v)
        return ":" in inner and _password(inner.split(":", 1)[1], True)
    if kind == "token":
        return not _masked(v) and not REFERENCE.match(v) and _random(v, 8)
    if kind == "password":
        return _password(v, True)
    if kind in ("quoted_password", "plain_password"):
        if name and HARMLESS_NAME.search(name):
            return False
        inner = _decoded(v) if re.fullmatch(r"[A-Za-z0-9+/]{8,}={0,2}", v) else ""
        return _password(v, kind[0] == "q") or bool(inner.isprintable() and inner and _password(inner.split(":", 1)[-1], True))
    if kind == "named_token":
        if HARMLESS_NAME.search(name):
            return False
        if REFERENCE.match(v) or _masked(v) or "://" in v:
            return False
        inner = _decoded(v) if len(v) % 4 == 0 else ""
        if inner.isprintable() and ":" in inner and _password(inner.split(":", 1)[1], True):
            return True
        if re.fullmatch(r"(?i)key", name.rsplit(".", 1)[-1]) and (UUID.match(v) or len(v) < 16):
            return False
        return _random(v, 12)
    if UUID.match(v) or REFERENCE.match(v):
        return False
    if HEX.match(v):  # a bare value where a call, a list or a result takes its key; longer ones are digests
        return len(v) in (32, 40) and _random(v, 16)
    return len(v) >= 16 and _random(v, 16) and _shuffled(v) and any(c.isdigit() for c in v)


NAME_START = re.compile(r"[\w.$-]*\Z")
# How one literal is written in pieces: added, joined from a list, or set side by side on two lines.
PIECES = re.compile(r"(?P<q>[\"'`])(?:\s*\+\s*|[ \t]*\\?\r?\n[ \t]*(?:\+\s*)?)(?P=q)")
LISTED = re.compile(r"\[(?P<l>\s*(?:[\"'`][^\"'`\n]{1,300}[\"'`]\s*,\s*)+[\"'`][^\"'`\n]{1,300}(?:[\"'`]\s*,?\s*\]|$))")
BETWEEN = re.compile(r"[\"'`]\s*,\s*[\"'`]")
JOINS = re.compile(r"(?:\"\"|''|``)\.join\(|\.join\((?:\"\"|''|``)\)|strings\.Join\(|String\.join\(|implode\(")
OPENS = re.compile(r"(?:(?:\"\"|''|``)\.join\(\s*|strings\.Join\(\s*|String\.join\(\s*\"\",\s*|implode\(\s*(?:\"\"|'')\s*,\s*)?(?:\[\]string\s*)?[\[{(]?\s*\Z")


def joined(text: str) -> tuple[str, np.ndarray | None]:
    """`text` with literals in pieces made whole, and the old place of every character (None: nothing changed)."""
    cuts = [m.span() for m in PIECES.finditer(text)]
    if JOINS.search(text):
        for m in LISTED.finditer(text):
            first = m.start("l") + len(m["l"]) - len(m["l"].lstrip())
            cuts.append((OPENS.search(text, max(0, first - 60), first).start(), first))
            cuts += [(m.start("l") + b.start(), m.start("l") + b.end()) for b in BETWEEN.finditer(m["l"])]
    if not cuts:
        return text, None
    kept, places, at = [], [], 0
    for start, end in [*sorted(set(cuts)), (len(text), len(text))]:
        if start >= at:
            kept.append(text[at:start])
            places.append(np.arange(at, start))
            at = end
    return "".join(kept), np.concatenate(places)


class Scanner:
    """The compiled rules and their trigram conditions."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern), re.compile(r.part) if r.part else None, trigrams.required(r.pattern)) for r in rules]
        self.asked = frozenset().union(*(trigrams.asked(c) for *_, c in self.rules))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Of each text the (start, end, rule) of every credential, in the text as it is written."""
        parts: list[tuple[int, str, np.ndarray | None]] = []
        for row, text in enumerate(texts):
            parts.append((row, text, None))
            whole, places = joined(text)
            if places is not None:  # what looks like pieces may be two values, so both readings count
                parts.append((row, whole, places))
        index = trigrams.Index([p[1] for p in parts], CHUNK, self.asked)
        found: list[set[tuple[int, int, str]]] = [set() for _ in texts]
        for rule, regex, part, condition in self.rules:
            for at in index.candidates(condition):
                row, text, places = parts[at]
                if part is not None and not part.search(text):
                    continue
                for m in regex.finditer(text):
                    if grants(rule.kind, m):
                        start, end = m.span("v")
                        if places is not None:
                            start, end = int(places[start]), int(places[end - 1]) + 1
                        found[row].add((start, end, rule.name))
        return [sorted(f) for f in found]


def hide(text: str, spans: list[tuple[int, int, str]]) -> str:
    """`text` with the characters of every span hidden; quotes, line ends and joints within a span stay."""
    out, at = [], 0
    for start, end, _ in spans:
        start = max(start, at)
        if end <= start:
            continue
        out.append(text[at:start])
        out += [HIDDEN if not i % 2 else x for i, x in enumerate(re.split(r"(\\?[\"'`]\s*(?:[+,]|\r?\n)?\s*[\"'`]|(?:\\n|\\r|\s)+)", text[start:end])) if x]
        at = end
    return "".join(out) + text[at:]


def find(df: DataFrame, text: str) -> DataFrame:
    """`df` with `secrets` (array<struct<start,end,rule>>) and `redacted` (the text with these hidden; null stays null).

    Narrow: one Arrow pass. Columns already called so are replaced.
    """
    kept = [c for c in df.columns if c not in ("secrets", "redacted")]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("rule", T.StringType())])
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("secrets", T.ArrayType(span)), T.StructField("redacted", T.StringType())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            spans = scanner.scan([t or "" for t in texts])
            rows = [[{"start": a, "end": b, "rule": r} for a, b, r in s] for s in spans]
            shown = [None if t is None else hide(t, s) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind), pa.array(shown, pa.string())], [*kept, "secrets", "redacted"])

    return spread(df.select(*kept)).mapInArrow(run, schema)


def snippets(secret_findings: DataFrame, vulnerability_findings: DataFrame) -> DataFrame:
    """(table_name, finding_id, snippet): the code of both tables of findings. Repeated rows stay."""
    of = lambda df, name, column: df.select(F.lit(name).alias("table_name"), "finding_id", F.col(column).alias("snippet"))
    return of(secret_findings, "secret_findings", "context").unionByName(of(vulnerability_findings, "vulnerability_findings", "code_snippet"))
