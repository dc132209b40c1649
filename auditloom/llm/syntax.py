"""Whether source files parse: bundled grammars, LALR(1) tables, whole token streams, the first unrecoverable error.

The tables of the five languages are made once on the driver and broadcast (their size depends on the grammars alone). Each
Arrow batch is lexed and recognised; equal contents within a batch are parsed once. The tables decide every file of every
language. The grammar of Python holds the targets of assignments, the order of parameters and arguments and the fields of
formatted strings; its lexer judges indentation, numbers and escapes.

Null contents and extensions without a grammar give a null verdict, empty texts are tried like any other. Files are read
whole, whatever their length. Repeated rows are judged each; other columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.lalr import END, Machine, Tables
from auditloom.session import spread

# The grammar of each extension and whether it is the extended dialect.
LANGUAGES = {".py": ("python", "python", False), ".js": ("javascript", "ecma", False), ".ts": ("typescript", "ecma", True), ".java": ("java", "java", False), ".go": ("go", "go", False)}

# The reserved and contextual words of the languages.
ECMA_WORDS = set(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let async of get set static from as yield await".split()
)
TS_WORDS = ECMA_WORDS | set("type interface namespace module declare abstract readonly keyof infer is asserts satisfies unique implements public private protected override global accessor out".split())
JAVA_WORDS = set(
    "package import static module transitive public protected private abstract final native synchronized transient volatile strictfp default sealed class extends implements permits interface enum open record void throws this super if else while do for return throw break continue yield assert try catch finally switch case when with new instanceof".split()
)
JAVA_RESERVED = set("const goto _".split())
JAVA_PRIMITIVE = set("boolean byte short int long char float double".split())
GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
PYTHON_WORDS = set(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split()
)

ECMA = re.compile(
    r"""(?:[ \t\f\v\u00a0\ufeff]|//[^\n\r\u2028\u2029]*)*(?:(?P<nl>(?:(?:\r\n|[\n\r\u2028\u2029])[ \t]*)+)|(?P<eof>\Z)|(?P<bc>/\*[\s\S]*?\*/)|(?P<id>(?:[^\W\d]|\$|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})(?:[\w$\u200c\u200d]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*)
    |(?P<num>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*|\d(?:_?\d)*)n?(?![\w$.])|(?:\.\d(?:_?\d)*|\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?)(?:[eE][+-]?\d(?:_?\d)*)?(?![\w$])|0[xX][0-9a-fA-F]+n?(?![\w$]))
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<private>\#(?:[^\W\d]|\$)[\w$]*)
    |(?P<asg>\*\*=|<<=|&&=|\|\|=|\?\?=|[-+*/%&|^]=)
    |(?P<op>===|!==|==|!=|\*\*|<<|<=|&&|\|\||\?\?|[%^])
    |(?P<p>\.\.\.|=>|>=|\?\.(?!\d)|\+\+|--|[-+*/{}()\[\];,<>.?:=!~&|@`]))""",
    re.X,
)
ECMA_KINDS = {"num": "NUM", "str": "STR", "private": "PRIVATE", "asg": "ASSIGN", "op": "OP"}
ECMA_BLANK = re.compile(r"(?:[ \t\f\v\u00a0\ufeff]|//[^\n\r\u2028\u2029]*)*")
ECMA_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
ECMA_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
AFTER_OPERAND = {"ID", "NUM", "STR", "REGEX", "TPL", "TPL_TAIL", ")", "]", "}", "this", "super", "null", "true", "false", "PRIVATE", "++", "--"} | (TS_WORDS - ECMA_WORDS) | {"async", "of", "get", "set", "static", "from", "as", "await"}


class Broken(Exception):
    """A text that no lexer goes on with: the place and what is wrong."""


def lex_ecma(text: str, words: set[str]) -> tuple[list[str], list[int], list[bool]]:
    """(terminals, places, whether a line ends before each)."""
    kinds, places, lines = [], [], []
    at, n, newline = (text.find("\n") if text.startswith("#!") and "\n" in text else 0), len(text), False
    braces: list[bool] = []  # of each open brace whether it is of a template
    parens: list[bool] = []  # of each open parenthesis whether it is of a statement's head
    operand = False

    def add(kind: str, place: int) -> None:
        nonlocal newline, operand
        kinds.append(kind)
        places.append(place)
        lines.append(newline)
        newline, operand = False, kind in AFTER_OPERAND

    def template(place: int, start: int, first: bool) -> int:
        end = ECMA_TEMPLATE.match(text, start).end()
        if end >= n:
            raise Broken(place, "unterminated template")
        if text[end] == "`":
            add("TPL" if first else "TPL_TAIL", place)
            return end + 1
        if text[end] != "$":
            raise Broken(place, "unterminated template")
        add("TPL_HEAD" if first else "TPL_MID", place)
        braces.append(True)
        return end + 2

    match = ECMA.match
    while at < n:
        m = match(text, at)
        if m is None:
            at = ECMA_BLANK.match(text, at).end()
            raise Broken(at, f"unexpected {text[at]!r}")
        kind = m.lastgroup
        word = m[kind]
        end = m.end()
        place = end - len(word)
        if kind == "id":
            before = kinds[-1] if kinds else ""
            kinds.append(word if word in words else "ID")
            places.append(place)
            lines.append(newline)
            newline, operand = False, before == "." or before == "?." or kinds[-1] in AFTER_OPERAND
        elif kind == "nl":
            newline = True
            if kinds and kinds[-1] in ("return", "break", "continue", "throw") and not (len(kinds) > 1 and kinds[-2] in (".", "?.")):
                if text[end : end + 1] != ":":
                    add("ASI", place)
                    newline = True
        elif kind == "bc":
            newline = newline or "\n" in word
        elif kind != "eof" and word[0] == "/" and not operand and (regex := ECMA_REGEX.match(text, place)):
            add("REGEX", place)
            end = regex.end()
        elif kind == "p":
            if word == "`":
                at = template(place, place + 1, True)
                continue
            if word == "{":
                braces.append(False)
            elif word == "}":
                if braces and braces.pop():
                    at = template(place, place + 1, False)
                    continue
            elif word == "(":
                parens.append(bool(kinds) and kinds[-1] in ("if", "while", "for", "with"))
            elif word in ("++", "--") and newline and operand:
                add("ASI", place)
                newline = True
            head = word == ")" and parens and parens.pop()
            ended = newline
            kinds.append(word)
            places.append(place)
            lines.append(newline)
            newline, operand = False, word in AFTER_OPERAND
            if head or word == "}" and "\n" in text[end : end + 2] or ended and word in ("++", "--"):
                operand = False
        elif kind != "eof":
            add(ECMA_KINDS[kind], place)
        at = end
    add(END, n)
    return kinds, places, lines


JAVA = re.compile(
    r"""(?P<ws>[ \t\f\r\n\ufeff\x1a]+|//[^\n\r]*|/\*[\s\S]*?\*/)|(?P<ns>non-sealed\b)|(?P<id>(?:[^\W\d]|\$)[\w$]*)
    |(?P<lit>"{3}[ \t\f]*\r?\n(?:[^\\"]|\\[\s\S]|"(?!""))*"{3}|"(?:[^"\\\n\r]|\\[^\n\r])*"|'(?:[^'\\\n\r]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[^\n\ru]))'
      |(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))
    |(?P<asg><<=|[-+*/&|^%]=)|(?P<p>->|::|\.\.\.|>=|\+\+|--)|(?P<op>==|!=|<=|&&|\|\||<<|[/%^])|(?P<q>[-+*{}()\[\];,<>.?:=!~&|@])""",
    re.X,
)
GO = re.compile(
    r"""(?P<ws>[ \t\r\ufeff]+|//[^\n]*)|(?P<nl>\n)|(?P<bc>/\*[\s\S]*?\*/)|(?P<id>[^\W\d]\w*)
    |(?P<str>"(?:[^"\\\n]|\\[^\n])*"|`[^`]*`)
    |(?P<lit>'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|[^\n]))'|(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w))
    |(?P<asg>&\^=|<<=|>>=|[-+*/&|^%]=)|(?P<p>:=|<-|\.\.\.|\+\+|--)|(?P<op>==|!=|<=|>=|&&|\|\||<<|>>|&\^|[/%<>])|(?P<q>[-+*{}()\[\];,.:=!~&|^])""",
    re.X,
)
GO_ENDS = {"ID", "LIT", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
PYTHON = re.compile(
    r"""(?P<id>[^\W\d]\w*(?!\w|["']))|(?P<ws>[ \t\f]+|\\(?:\r\n|\n|\r))|(?P<nl>\r\n|\n|\r)|(?P<c>\#[^\n\r]*)
    |(?P<f>(?:[fF][rR]?|[rR][fF])(?:"{3}|'{3}|"|'))
    |(?P<str>(?:[rRuU]|[bB][rR]?|[rR][bB])?(?:"{3}(?:[^\\"]|\\[\s\S]|"(?!""))*"{3}|'{3}(?:[^\\']|\\[\s\S]|'(?!''))*'{3}|"(?!"")(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?!'')(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'))
    |(?P<word>[^\W\d]\w*)
    |(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)
    |(?P<asg>\*\*=|//=|>>=|<<=|[-+*/%&|^@]=)|(?P<p>\.\.\.|->|:=|\*\*)|(?P<op>//|<<|>>|[%&^])|(?P<cmp>==|!=|<=|>=|[<>])|(?P<q>[-+*/{}()\[\];,.:=!~|@])""",
    re.X,
)
PYTHON_INDENT = re.compile(r"[ \t\f]*")
AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)(?!\w)|(?!\w)")
LEADING_ZERO = re.compile(r"0[0-9_]*[1-9][0-9_]*\Z")
# What may not follow a backslash in a string, and the text of a string with fields up to what ends it.
BAD_ESCAPE = re.compile(r"(?:[^\\]|\A)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!(?:0010|000[0-9a-fA-F])[0-9a-fA-F]{4})|N(?!\{[^{}]+\}))")
BAD_BYTE = re.compile(r"(?:[^\\]|\A)(?:\\\\)*\\x(?![0-9a-fA-F]{2})")
FIELD_TEXT = {
    (q, raw): re.compile((r"(?:[^{}\\" if not raw else r"(?:[^{}\\") + ("\n\r" if len(q) == 1 else "") + q[0] + r"]|" + ("" if raw else r"\\N\{[^{}\n]+\}|") + r"\\(?:\r\n|[^{}]|(?=[{}]))" + (f"|{q[0]}(?!{q[0] * 2})" if len(q) == 3 else "") + r"|\{\{|\}\})*")
    for q in ('"', "'", '"""', "'''")
    for raw in (False, True)
}
SPEC_TEXT = {q: re.compile(r"[^{}" + ("\n\r" if len(q) == 1 else "") + q[0] + r"]*") for q in ('"', "'", '"""', "'''")}


def lex_java(text: str) -> tuple[list[str], list[int]]:
    kinds, places, at, n, match = [], [], 0, len(text), JAVA.match
    while at < n:
        m = match(text, at)
        if m is None:
            raise Broken(at, f"unexpected {text[at]!r}")
        kind = m.lastgroup
        if kind != "ws":
            word = m[0]
            if kind == "id":
                word = word if word in JAVA_WORDS else "PRIM" if word in JAVA_PRIMITIVE else "LIT" if word in ("true", "false", "null") else "?" + word if word in JAVA_RESERVED else "ID"
            elif kind not in ("p", "q"):
                word = {"ns": "NONSEALED", "lit": "LIT", "asg": "ASSIGN", "op": "OP"}[kind]
            kinds.append(word)
            places.append(at)
        at = m.end()
    return [*kinds, END], [*places, n]


def lex_go(text: str) -> tuple[list[str], list[int]]:
    kinds, places, at, n, match = [], [], 0, len(text), GO.match
    while at < n:
        m = match(text, at)
        if m is None:
            raise Broken(at, f"unexpected {text[at]!r}")
        kind = m.lastgroup
        if kind == "nl" or kind == "bc" and "\n" in m[0]:
            if kinds and kinds[-1] in GO_ENDS:
                kinds.append(";")
                places.append(at)
        elif kind not in ("ws", "bc"):
            word = m[0]
            if kind == "id":
                word = word if word in GO_WORDS else "ID"
            elif kind not in ("p", "q"):
                word = {"str": "STR", "lit": "LIT", "asg": "ASSIGN", "op": "OP"}[kind]
            kinds.append(word)
            places.append(at)
        at = m.end()
    if kinds and kinds[-1] in GO_ENDS:
        kinds.append(";")
        places.append(n)
    return [*kinds, END], [*places, n]


def lex_python(text: str) -> tuple[list[str], list[int]]:
    """Strings with fields give their fields' own tokens; `inside` holds what is open: (kind, quote, raw, depth)."""
    if (null := text.find("\0")) >= 0:
        raise Broken(null, "null character")
    kinds, places, at, n, match = [], [], (1 if text.startswith("\ufeff") else 0), len(text), PYTHON.match
    indents, depth, start = [(0, 0)], 0, True
    inside: list[tuple[str, str, bool, int]] = []

    def add(kind: str, place: int) -> None:
        kinds.append(kind)
        places.append(place)

    while at < n:
        if inside and inside[-1][0] != "field":  # the text of a string or of a format
            kind, quote, raw, _ = inside[-1]
            m = (FIELD_TEXT[quote, raw] if kind == "text" else SPEC_TEXT[quote]).match(text, at)
            if kind == "text" and not raw and not _escapes(m[0]):
                raise Broken(at, "invalid escape")
            at = m.end()
            if text.startswith("{", at):
                add("{", at)
                depth += 1
                inside.append(("field", quote, raw, depth))
                at += 1
            elif kind == "text" and text.startswith(quote, at):
                add("FEND", at)
                inside.pop()
                at += len(quote)
            elif kind == "spec" and text.startswith("}", at):
                add("}", at)
                depth -= 1
                del inside[-2:]
                at += 1
            else:
                raise Broken(at, "unterminated string")
            continue
        if start and not depth:
            m = PYTHON_INDENT.match(text, at)
            rest = text[m.end() : m.end() + 1]
            if rest and rest not in "#\n\r" and not (rest == "\\" and text[m.end() + 1 : m.end() + 2] in ("\n", "\r")):
                blank = m[0].rpartition("\f")[2]
                width = (len(blank.expandtabs(8)), len(blank))
                if width[0] > indents[-1][0]:
                    if width[1] <= indents[-1][1]:
                        raise Broken(at, "tabs and spaces are mixed")
                    indents.append(width)
                    add("INDENT", at)
                while width[0] < indents[-1][0]:
                    indents.pop()
                    add("DEDENT", at)
                if width[0] != indents[-1][0]:
                    raise Broken(at, "unindent matches no outer level")
                if width != indents[-1]:
                    raise Broken(at, "tabs and spaces are mixed")
            at = m.end()
            start = False
            continue
        m = match(text, at)
        if m is None:
            raise Broken(at, f"unexpected {text[at]!r}")
        kind, word = m.lastgroup, m[0]
        end = m.end()
        if kind == "ws":
            if word[0] == "\\" and end == n:
                raise Broken(at, "unexpected end of file")
        elif kind == "nl":
            if not depth:
                if kinds and kinds[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                    add("NEWLINE", at)
                start = True
        elif kind == "id" or kind == "word":
            if not word.isascii() and not word.isidentifier():
                raise Broken(at, f"unexpected {word!r}")
            add(word if word in PYTHON_WORDS else "ID", at)
        elif kind == "q" or kind == "p":
            field = inside[-1] if inside and inside[-1][3] == depth else None
            if field and word in (":", ":="):
                add(":", at)
                inside.append(("spec", field[1], field[2], depth))
                at += 1
                continue
            if field and word == "!":
                if text[at + 1 : at + 2] not in ("s", "r", "a") or not re.match(r"\s*[:}]", text[at + 2 : at + 40]):
                    raise Broken(at, "invalid conversion")
                add("CONVERSION", at)
                at += 2
                continue
            if word == "!":
                raise Broken(at, "unexpected '!'")
            if field and word == "}":
                inside.pop()
            if word in "([{":
                depth += 1
            elif word in ")]}":
                depth -= 1
                if depth < 0:
                    raise Broken(at, f"unmatched {word!r}")
            add(word, at)
        elif kind == "f":
            quote = word.lstrip("fFrR")
            add("FSTART", at)
            inside.append(("text", quote, len(word) - len(quote) == 2, 0))
        elif kind == "str":
            prefix = word[: word.index(word[-1])].lower()
            if "b" in prefix:
                if not word.isascii():
                    raise Broken(at, "bytes hold ASCII only")
                if "\\x" in word and "r" not in prefix and BAD_BYTE.search(word):
                    raise Broken(at, "invalid escape")
                add("BYTES", at)
            else:
                if "r" not in prefix and not _escapes(word):
                    raise Broken(at, "invalid escape")
                add("STR", at)
        elif kind == "num":
            if LEADING_ZERO.match(word):
                raise Broken(at, "leading zeros")
            if not AFTER_NUMBER.match(text, end):
                raise Broken(end, "invalid number")
            add("NUM", at)
        elif kind != "c":
            add({"asg": "ASSIGN", "op": "OP", "cmp": "COMP"}[kind], at)
        at = end
    if inside:
        raise Broken(n, "unterminated string")
    if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
        add("NEWLINE", n)
    kinds += ["DEDENT"] * (len(indents) - 1)
    places += [n] * (len(indents) - 1)
    return [*kinds, END], [*places, n]


def _escapes(body: str) -> bool:
    """Whether the escapes of a string are whole, and every character that is given by name exists."""
    if "\\" not in body:
        return True
    if BAD_ESCAPE.search(body):
        return False
    try:
        return all(unicodedata.lookup(name) for name in re.findall(r"(?:[^\\]|\A)(?:\\\\)*\\N\{([^{}]+)\}", body))
    except KeyError:
        return False


class Kinds(dict):
    """What a token of its own is to a language: worked out once by its lexer, `UNKNOWN` where that fails."""

    def __init__(self, read) -> None:
        self.read = read

    def __missing__(self, token: str):
        try:
            kind = self.read(token)
        except Broken:
            kind = UNKNOWN
        if len(self) < 200_000 and len(token) <= 80:
            self[token] = kind
        return kind


UNKNOWN = "?"


def _tokens(pattern: str, blank: str) -> re.Pattern:
    """All tokens of a text at once, with what lies between them dropped; a letter that begins none comes out by itself."""
    return re.compile(f"(?:{blank})*({re.sub(r'[(][?]P<[a-z]+>', '(?:', pattern)}|[\\s\\S]|\\Z)", re.X)


def _simple_fields(quote: str) -> str:
    """A string with fields that hold neither backslashes nor its own quotes."""
    one = r"\n\r" if len(quote) == 1 else ""
    q = quote[0]
    code = rf"[^{{}}\\{q}{one}]*"
    rest = rf"|{q}(?!{q}{q})" if len(quote) == 3 else ""
    start = quote if len(quote) == 3 else rf"{q}(?!{q}{q})"
    return rf"{start}(?:[^{{}}\\{q}{one}]{rest}|\\[^{{}}\n\r]|\{{\{{|\}}\}}|\{{{code}(?:\{{{code}\}}{code})*\}})*{quote}"


JAVA_TOKENS = _tokens(JAVA.pattern, r"[ \t\f\r\n\ufeff\x1a]|//[^\n\r]*|/\*[\s\S]*?\*/")
GO_TOKENS = _tokens(GO.pattern, r"[ \t\r\ufeff]|//[^\n]*")
PYTHON_TOKENS = _tokens(
    "(?:[fF][rR]?|[rR][fF])(?:" + "|".join(map(_simple_fields, ('"""', "'''", '"', "'"))) + r")|(?:\#[^\n\r]*)?(?:\r\n|\n|\r)(?:[ \t\f]*(?:\#[^\n\r]*)?(?:\r\n|\n|\r))*[ \t\f]*|" + PYTHON.pattern,
    r"[ \t\f]|\\(?:\r\n|\n|\r)",
)
PYTHON_DEPTH = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}
PYTHON_LINE = ("NEWLINE", "INDENT", "DEDENT")


def _java_kind(token: str) -> str:
    if token[0].isalpha() and token.isidentifier():
        return token if token in JAVA_WORDS else "PRIM" if token in JAVA_PRIMITIVE else "LIT" if token in ("true", "false", "null") else "ID" if token not in JAVA_RESERVED else UNKNOWN
    return lex_java(token)[0][0]


def _go_kind(token: str) -> str:
    if token.isidentifier():
        return token if token in GO_WORDS else "ID"
    return "\n" if "\n" in token and token[0] in "/\n" else "".join(lex_go(token)[0][:1]).replace(END, "")


def _python_kind(token: str):
    """A terminal, the list of them for a string with fields, or the widths of the indentation after a line's end."""
    if token in PYTHON_DEPTH:
        return token
    if token == "\ufeff":  # a mark of the byte order within a text
        return UNKNOWN
    if token.isidentifier():
        return token if token in PYTHON_WORDS else "ID"
    if len(token) > 1 and token[0] == token[-1] and token[0] in "\"'" and "\\" not in token:
        return "STR"
    if "\n" in token and token[0] in "#\n\r" or token[0] == "\r":
        blank = re.split(r"[\n\r\f]", token)[-1]
        return (len(blank.expandtabs(8)), len(blank))
    kinds = lex_python(token)[0][:-2]
    return kinds if len(kinds) > 1 else "".join(kinds)


JAVA_KIND = Kinds(_java_kind)
GO_KIND = Kinds(_go_kind)
PYTHON_KIND = Kinds(_python_kind)


def fast_java(text: str) -> list[str]:
    tokens = JAVA_TOKENS.findall(text)
    while tokens and not tokens[-1]:
        tokens.pop()
    return [*map(JAVA_KIND.__getitem__, tokens), END]


def fast_go(text: str) -> list[str]:
    kinds: list[str] = []
    last = ""
    for kind in map(GO_KIND.__getitem__, filter(None, GO_TOKENS.findall(text))):
        if kind == "\n":
            if last not in GO_ENDS:
                continue
            kind = ";"
        elif not kind:
            continue
        kinds.append(kind)
        last = kind
    if last in GO_ENDS:
        kinds.append(";")
    return [*kinds, END]


def fast_python(text: str) -> list[str]:
    if "\0" in text or "\\" in text and re.search(r"(?:\A|[\n\r])[ \t\f]*\\[\n\r]|\\[\n\r]+\Z", text):
        return [UNKNOWN]
    kinds: list[str] = []
    indents, depth = [(0, 0)], 0
    tokens = [t for t in PYTHON_TOKENS.findall("\n" + text.removeprefix("\ufeff")) if t]
    while tokens and tokens[-1][0] == "#":
        tokens.pop()
    for i, kind in enumerate(map(PYTHON_KIND.__getitem__, tokens)):
        if kind.__class__ is str:
            if not kind:
                continue
            kinds.append(kind)
            if kind in PYTHON_DEPTH:
                depth += PYTHON_DEPTH[kind]
                if depth < 0:
                    return [UNKNOWN]
        elif kind.__class__ is list:
            kinds += kind
        elif not depth:
            if kinds and kinds[-1] not in PYTHON_LINE:
                kinds.append("NEWLINE")
            if kind != indents[-1] and i + 1 < len(tokens):
                if kind[0] > indents[-1][0]:
                    if kind[1] <= indents[-1][1]:
                        return [UNKNOWN]
                    indents.append(kind)
                    kinds.append("INDENT")
                while kind[0] < indents[-1][0]:
                    indents.pop()
                    kinds.append("DEDENT")
                if kind != indents[-1]:
                    return [UNKNOWN]
    if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
        kinds.append("NEWLINE")
    return [*kinds, *["DEDENT"] * (len(indents) - 1), END]


FAST = {".java": fast_java, ".go": fast_go, ".py": fast_python}


def tables() -> dict[str, Tables]:
    """The tables of every extension."""
    text = lambda name: files("auditloom.llm").joinpath(f"grammars/{name}.grammar").read_text("utf-8")
    return {ext: Tables(text(grammar), extended) for ext, (_, grammar, extended) in LANGUAGES.items()}


def first_error(text: str, ext: str, every: dict[str, Machine]) -> tuple[int, str] | None:
    """(place, message) of the first error that the language's grammar cannot go on from, None if the text parses.

    Texts are read by all their tokens at once first, which tells that they parse; where they do not, token by token for the place.
    """
    if ext in FAST and every[ext].accepts(FAST[ext](text)) < 0:
        return None
    try:
        inserts = None
        if ext in (".js", ".ts"):
            kinds, places, lines = lex_ecma(text, TS_WORDS if ext == ".ts" else ECMA_WORDS)
            inserts = lambda i: "ASI" if lines[i] or kinds[i] in ("}", END) else None
        else:
            kinds, places = {".java": lex_java, ".go": lex_go, ".py": lex_python}[ext](text)
    except Broken as broken:
        return broken.args
    at = every[ext].accepts(kinds, inserts)
    if at < 0:
        return None
    return places[at], "unexpected end of file" if kinds[at] == END else f"unexpected {text[places[at] : places[at] + 20].splitlines()[0] if places[at] < len(text) and text[places[at]] not in chr(10) + chr(13) else 'end of line'!r}"


def parse(df: DataFrame, content: str = "content", ext: str = "ext") -> DataFrame:
    """`df` without `content`, with `language` of the extension, `parses` (null where not judged), `error_line`, `error_column`
    (from 1, null where it parses) and `error`. Narrow: one Arrow pass, no shuffle. Columns already called so are replaced."""
    made = ["claimed_language", "parses", "error_line", "error_column", "error"]
    kept = [c for c in df.columns if c not in (content, *made)]
    shared = df.sparkSession.sparkContext.broadcast(tables())
    types = [T.StringType(), T.BooleanType(), T.IntegerType(), T.IntegerType(), T.StringType()]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, t) for n, t in zip(made, types))])
    arrow = [pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]

    def judge(text: str | None, kind: str | None, machines: dict[str, Machine]) -> tuple:
        language = LANGUAGES.get((kind or "").lower())
        if text is None or language is None:
            return (language and language[0], None, None, None, None)
        found = first_error(text, kind.lower(), machines)
        if found is None:
            return (language[0], True, None, None, None)
        before = text[: found[0]]
        line = len(re.findall(r"\r\n|\n|\r", before)) + 1
        return (language[0], False, line, found[0] - max(before.rfind("\n"), before.rfind("\r")), found[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = {ext: Machine(t) for ext, t in shared.value.items()}
        for batch in batches:
            known: dict[tuple, tuple] = {}
            rows = []
            for key in zip(batch.column(content).to_pylist(), batch.column(ext).to_pylist()):
                if key not in known:
                    known[key] = judge(*key, machines)
                rows.append(known[key])
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, t) for c, t in zip(columns, arrow))], [*kept, *made])

    return spread(df.select(*kept, content)).mapInArrow(run, schema)


def broken_files(source_files: DataFrame) -> DataFrame:
    """(repo, file_path, language, error_line, error_column, error): each file that does not parse, once."""
    rows = parse(source_files.select("repo", "file_path", "ext", "content")).where("not parses")
    return rows.select("repo", "file_path", F.col("claimed_language").alias("language"), "error_line", "error_column", "error").dropDuplicates(["repo", "file_path"])


def rates(source_files: DataFrame, file_metrics: DataFrame) -> DataFrame:
    """(repo, language, files, broken, share): of the measured files with known content, per repository and language."""
    verdicts = parse(source_files.select("repo", "file_path", "ext", "content")).where("parses is not null").dropDuplicates(["repo", "file_path"])
    measured = verdicts.join(file_metrics.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi")
    counted = measured.groupBy("repo", F.col("claimed_language").alias("language")).agg(F.count("*").alias("files"), F.count_if(~F.col("parses")).alias("broken"))
    return counted.withColumn("share", F.col("broken") / F.col("files"))
