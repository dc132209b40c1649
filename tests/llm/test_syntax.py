"""Recognisers: sound and broken texts of every language, the interpreter as the judge of Python, edge rows."""

import ast
import random
import re
import warnings

import pytest

from auditloom.llm import lalr, syntax
from tests.conftest import rows

TABLES = {ext: lalr.Machine(t) for ext, t in syntax.tables().items()}
GOOD = {
    ".js": [
        "", "// only\n", "const a = 1\nlet b = a\n;[1,2].map(x => x)\n", "a\n++b\n", "var x = a / b / c; y = /[/]\\/x/gi.test(s)\n", "f(`a${b + `c${d}`}e`)", "label: for (const [k, v] of m) { if (!k) continue label }",
        "class A extends B { #p = 1; static x; get y() { return this.#p } static async *z() {} ['k']() {} static { f() } }", "const {a, b: [c = 1], ...d} = e;", "async (x) => { await x; for await (const y of z) {} }",
        "import d, { a as b } from 'x'; export default function () {}\nexport * as n from 'y'", "do x++; while (x < 5) y()", "if (a) b; else c", "x?.y?.[0]?.(1) ?? 1n ** 2n", "return_ = function* () { yield* a; yield }", "({ async f() {}, get g() { return 1 }, [h]: 1, ...i })",
        "throw new Error(`x`)", "switch (a) { case 1: b(); break; default: c() }", "try { a() } catch { b() } finally { c() }", "new a.b.C(1).d(); new X; new.target", "#!/usr/bin/env node\nx()\n", "function f() {\n  return\n  1\n}", "a = b ? c : d ? e : f",
    ],
    ".ts": [
        "interface A<T> extends B<T> { readonly x?: string; [k: string]: any; f(a: number): void; new (x: T): A<T> }", "type U<T> = T extends (infer R)[] ? R : { [K in keyof T]?: T[K] }", "enum E { A = 1, B }", "abstract class C { constructor(private readonly x: number, public y?: string) {} abstract f(): void; declare z: string }",
        "function f(a: string): a is 'x'; function f(a: any): boolean { return true }", "const x = <T,>(a: T): T => a; let y = a as unknown as B; z!.w; f<number>(1)", "import type { A } from 'a'; export type { A }; declare module 'x' { const y: number }", "namespace N.M { export const a = 1 }", "let m: Map<string, Array<Record<string, number>>> = new Map();", "@Component({ a: 1 }) export class D { @Input() x: string; }", "const t: [a: string, b?: number, ...c: boolean[]] = v satisfies T;", "type F = (a: number, ...b: string[]) => void | `a${string}`",
    ],
    ".java": [
        "", "package a.b; import java.util.*; public class A<T extends B & C> implements D<T> { int x = 1, y[] = {1, 2}; A() { super(); } <R> R f(T... a) throws E { return null; } }", "record P(int x, String... y) { P { if (x < 0) throw new E(); } }", "sealed interface S permits A, B {}\nnon-sealed class A implements S {}", "enum E { A(1) { void f() {} }, B; int x; }",
        "class A { void f() { for (Map.Entry<String, List<Integer>> e : m.entrySet()) { x += e.getKey().length() >> 2; } int r = switch (k) { case A, B -> 1; default -> { yield 2; } }; } }", "class A { String s = \"\"\"\n  a \"b\"\n  \"\"\"; char c = '\\u0041'; Runnable r = () -> {}; Function<A, B> g = A::new; Object o = (Runnable & X) () -> f(); int z = (int) +1; }", "@interface I { int x() default 1; } @I(x = 2) class B { @Override public int[] f()[] { return new int[][] {{1}}[0]; } }",
        "class A { void f() { if (o instanceof String s && s.isEmpty()) try (var r = g(); r2) { } finally { } label: while (true) break label; } }",
    ],
    ".go": [
        "package a\n", "package a\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\nvar (\n\ta, b = 1, 2\n)\nfunc (s *S[T]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok {\n\t\treturn v, nil\n\t} else if x := 1; x > 2 {\n\t}\n\tfor i := range xs {\n\t\tgo f()\n\t}\n\tfor {\n\t}\n}\n", "package a\ntype T struct {\n\tA int `json:\"a\"`\n\t*B\n\tC func(int) error\n}\ntype N interface {\n\t~int | ~string\n\tF()\n}\n", "package a\nfunc f[K comparable, V any](m map[K]V) { x := []T{{1}, {2}}; y := &T{A: 1}; switch z := q.(type) { case int, *B: default: }; select { case v := <-c: case c <- 1: } }\n", "package a\nconst (\n\tA = iota\n\tB\n)\nfunc g() { defer func() { recover() }(); L: for i := 0; i < 3; i++ { continue L }; a[1:2:3] = b.(C).d }\n",
    ],
}
BAD = {
    ".js": ["const a = ;", "const a;", "let {b};", "f(", "}", "a b", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> z\n", "function f() { if (x) { }", "x = “a”", "let s = 'abc", "def f(x):\n    return x\n", "interface A { x: string }", "{ \"a\": 1, \"b\": 2 }", "if (a) else b", "let x = `a${b`", "class A { f( { } }", "package main\nfunc f() {}\n"],
    ".ts": ["let x: = 1", "interface A { x: string", "<!DOCTYPE html>", "import json\nimport os\n", "function f(a: string {", "enum E { A B }"],
    ".java": ["class A { void f() { int x = 1 } }", "public class A {", "class A { } }", "class A { String s = \"abc; }", "import x\nclass A {}", "def f(): pass", "class A { void f( { } }", "class A { int f() { return 1 2; } }", "void f() {}"],
    ".go": ["", "// only\n", "func f() {}\n", "package a\nfunc f() {\n", "package a\nfunc f()\n{\n}\n", "package a\nx := 1\n", "package a\nfunc f() { a b }\n", "package a\nimport \"x\n", "package a\nvar x = [\n"],
}


@pytest.mark.parametrize("ext", GOOD)
def test_languages(ext):
    for text in GOOD[ext]:
        assert syntax.first_error(text, ext, TABLES) is None, text
    for text in BAD[ext]:
        assert syntax.first_error(text, ext, TABLES) is not None, text


def test_python_tables_agree_with_the_interpreter():
    sound = "import os\n\n\n@d(1)\nasync def f(a, /, b: int = 1, *c, d, **e) -> int:\n    '''x'''\n    async with a as b, c:\n        return [x async for x in y if z] + {**a, 'b': 1}['b']\n    while x := g(): pass\n    try:\n        raise A from B\n    except* (C, D) as e:\n        lambda *a, k=1: (yield)\n    else:\n        x = y if z else w,\n    finally:\n        del a[1:2, ...], b.c\n\n\nmatch a:\n    case [1, *r] | {'k': v, **w} if v:\n        pass\n    case P(x=1) as q:\n        print(f'{a!r:>{b}}', end='')\n"
    ast.parse(sound)
    assert syntax.first_error(sound, ".py", TABLES) is None
    rng = random.Random(5)
    pool = [sound, *MORE_PYTHON]
    for text in pool:
        assert (syntax.first_error(text, ".py", TABLES) is None) == valid(text), text
    inserted = "( ) [ ] { } : = , . * ** yield lambda not in for if else := f\" ' \" # 1 x await del return ; @ / -> 0x 01 b' f'{ !r} \\x".split()
    for _ in range(1500):
        tokens = re.findall(r"\w+|\s+|[^\w\s]", rng.choice(pool))
        i, j = rng.randrange(len(tokens)), rng.randrange(len(tokens))
        change = rng.randrange(5)
        if change == 0:
            del tokens[i]
        elif change == 1:
            tokens.insert(i, tokens[j])
        elif change == 2:
            tokens[i], tokens[j] = tokens[j], tokens[i]
        elif change == 3:
            tokens[i] = rng.choice(inserted)
        else:
            del tokens[i:]
        text = "".join(tokens)
        assert (syntax.first_error(text, ".py", TABLES) is None) == valid(text), text


MORE_PYTHON = r"""
def f(a, b=1, /, c=2, *, d, e=3, **g): pass
lambda a, *b, c=1, **d: 0
def f(a=1, b): pass
f(a, *b, c=1, *d, **e, g=2)
f(c=1, d)
f(**a, *b)
f(x for x in y)
f(x for x in y, 1)
f() = 1
a.b, c[0], *d = e = 1
(a, b) += 1
(a) += 1
a, b: int
(a): int = 1
for f() in x: pass
for a.b, (c, *d) in x, y: pass
del f()
del (a, b.c), [d]
with a as f(): pass
with (a as b, c as (d, e)): pass
x = 012
x = 00 + 0_0 + 1_0.5e-3j + 0xFF
x = 1if y else 2
x = 1_000abc
x = b'é'
x = '\x4'
x = r'\x4' b''
x = '\N{DIGIT ONE}' '\N{nothing at all}'
if x:§	y§        z
if x:§        y§	z
x = 1 \§ + 2
class A(): pass
x = f'{a}{b!r:>{w}.{p}f}{{}}{c=}' f"{d['k']}" f'''{§x§:y}'''
x = f'{}'
x = f'{a!z}'
x = f'{a b}'
x = f'}'
x = f'{a'
x = f"{x["a"]}"
x = rf'\d{a}\{b}' fr"{c:\d}"
x = f'{lambda x: 1}'
x = f'{(lambda x: 1)}{y:=5}{z!=1}'
x = f'\N{DIGIT ONE}{a}'
x = ''"" '' + '''a'''
x = ''''
try: pass§except A: pass§except* B: pass
try: pass§except A, B: pass
return yield x
x = yield = 1
x = y = yield
[x for x in y if (z := 1)]
*a
print x
match x:§    case A(1, b=2): pass§    case A(b=2, 1): pass
match = case = type = 1
type X[T: int, *U, **V] = list[T]
async def f():§    return await x ** 2
""".strip().split("\n")
MORE_PYTHON = [t.replace("§", "\n") + "\n" for t in MORE_PYTHON] + ["x = \0\n", "\ufeffx = 1\n", "x = 1 \\", "x = 1"]


def valid(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.removeprefix("\ufeff"))
    except (SyntaxError, ValueError):
        return False
    return True


def test_engine_on_an_ambiguous_grammar():
    machine = lalr.Machine(lalr.Tables("S: E ; E: E '+' E | 'x' | '(' E ')' ;"))
    assert machine.accepts([*"x+x+(x+x)", lalr.END]) == -1
    assert machine.accepts([*"x+", lalr.END]) == 2
    assert machine.accepts([*"x)", lalr.END]) == 1
    assert machine.accepts([*"x" + "+x" * 200, lalr.END]) == -1


def test_rows(spark):
    deep = "x = " + "(" * 3000 + ")" * 3000
    data = [("r", "a.py", ".py", "x = 1"), ("r", "b.py", ".py", None), ("r", "c.py", ".py", ""), ("r", "d.txt", ".txt", "("), ("r", "e.js", ".js", "("), ("r", "e.js", ".js", "("), ("r", "f.js", None, "("), ("r", "g.java", ".JAVA", "class {"), ("r", "h.js", ".js", "a()\n" * 40000 + "b("), ("r", "i.py", ".py", deep)]
    files = spark.createDataFrame([(*d, "clash", 1) for d in data], "repo string, file_path string, ext string, content string, error string, error_line int")
    assert rows(syntax.broken_files(files), "file_path", "language", "error_line") == [("e.js", "javascript", 1), ("g.java", "java", 1), ("h.js", "javascript", 40001)]  # the last parses, however deep it is nested
    metrics = files.select("repo", "file_path")
    assert ("r", "javascript", 2, 2, 1.0) in rows(syntax.rates(files, metrics))
    assert rows(syntax.broken_files(files.limit(0))) == [] and rows(syntax.rates(files, metrics.limit(0))) == []


def test_ambiguity_is_read_to_the_end():
    wild = lalr.Machine(lalr.Tables("S: T ; T: T T | 'a' ;"))
    for n in (1, 5, 60):
        assert wild.accepts(["a"] * n + [lalr.END]) == -1
        assert wild.accepts(["a"] * n + ["b", lalr.END]) == n


def test_dropping_nodes_changes_nothing():
    tables = lalr.Tables("S: E ; E: E '+' E | 'x' | '(' E ')' ;")
    whole, small = lalr.Machine(tables), lalr.Machine(tables, most=20)
    rng = random.Random(2)
    for _ in range(300):
        kinds = [*(rng.choice("x+()") if rng.random() < 0.1 else c for c in "(" * 9 + "x+(x+x)+x" + ")" * 9 + "+x+x"), lalr.END]
        assert small.accepts(kinds) == whole.accepts(kinds)
        assert len(small.state) < 80
    kinds = [*("(" * 500 + "x" + ")" * 500), lalr.END]
    assert small.accepts(kinds) == -1 and small.accepts(kinds[:-2] + [lalr.END]) == 1000
