import ast
import random

import pytest

from sillar.llm import parse_check
from sillar.llm.parse_check import first_error
from sillar.llm.syntax.glr import compile_grammar, recognise

VALID = {
    "python": ["", "x = 1\n", "async def f(a, *, b: int = 2, **k) -> None:\n    async with a as b, c:\n        yield [i for i in x if i]\n", "match x:\n    case {'a': [1, *r]} if r:\n        pass\n    case _:\n        match = 3\n", "def f(\n  a,\n):\n\treturn (yield)\n", "x: int = lambda *a, k=1: (a, k)\nprint(f'{x!r:>{1}}', *x, **y)\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    del x[1:2, ::3]\n"],
    "javascript": ["let a = 1\nlet b = a / 2 / 3\nb\n++a", "const f = async ({a, b: [c] = []}, ...r) => { await a?.b?.[c] ?? r }", "for (const x of y) if (x) continue; else break", "export default class extends A { #p = 1; static { go() } get x() { return this.#p } async *g() {} }", "const r = /[/\\]]+/g.test(`a${b + `${c}`}d`)", "const e = <A b={c} {...d}>text {x ? <B/> : null}</A>;", "label: while (1) { do x++; while (x < 3) }", "var o = {a, 'b': 1, [c]: 2, get: 3, async d() {}, ...e}"],
    "typescript": ["type A<T extends object = {}> = { [K in keyof T]?: T[K] extends (infer U)[] ? U : never };", "abstract class A<T> implements B, C { constructor(private readonly x: number, y?: string) { super() } abstract f(): void; }", "const x = <T,>(a: T): a is T => a as unknown as T;", "enum E { A = 1, B }\nnamespace N { export const a = f<number>(1)! }", "import type { A } from './a'\nlet x: [a: number, ...b: string[]] | null = y satisfies Z"],
    "tsx": ["const f = <T,>(x: T) => <div className=\"a\">{x}</div>;"],
    "java": ["package a.b; import static c.D.*; @X(y = 1) public class A<T extends B & C> extends D { int[] a = {1, 2}, b[]; A() { this(1); } <U> U f(final int... x) throws E { return x -> { }; } }", "record P(int x, String y) { } sealed interface S permits P { default void f() { switch (x) { case 1, 2 -> go(); default -> { } } } }", "class A { void f() { for (int i = 0, j; i < (int) n; i++) { a[i] <<= (b >>> 2); } try (var r = open()) { } catch (A | B e) { } Object o = (Runnable & X) () -> new int[3][].length; } }"],
    "go": ["package a\n\nimport (\n\t\"b\"\n\tc \"d\"\n)\n\ntype S[T any, U ~int | string] struct {\n\tA, B int `x`\n\t*E\n}\n\nfunc (s *S[T, U]) F(a int, b ...string) (x int, err error) {\n\tif v, ok := m[1]; !ok {\n\t\treturn\n\t} else if x > 1 {\n\t}\n\tfor i := range 3 {\n\t\tgo func() { <-ch }()\n\t}\n\tswitch t := v.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\treturn &S[int, string]{A: 1}, nil\n}\n"],
    "rust": ["#![x]\nuse a::{b, c as d, e::*};\n#[derive(A)]\npub struct S<'a, T: 'a + Clone = u8, const N: usize = 3> where T: Copy { pub(crate) a: &'a mut [T; N] }\nimpl<T> Tr for S<'_, T> { fn f(&self, x: impl Fn(u8) -> u8) -> Result<(), Box<dyn E>> { let Some(y) = x else { return Err(1)? }; match y { A::B { c, .. } | A::C(1..=2) if c => {}, _ => loop { break 'a 3 } }; vec![1; 2]; a.b::<u8>()?.await; |x: u8| -> u8 { x }; if let Some(x) = y && x > 1 {} ; x as u8 < 3 } }\nmacro_rules! m { ($a:expr) => { $a } }"],
    "php": ["<?php\nnamespace A\\B;\nuse C\\{D, E as F};\n#[X]\nfinal class G extends H implements I { use J; const K = 1; public function __construct(private readonly ?int $x = null, A|B ...$y) {} public static function f(): static { return new static; } }\n$a = fn($x) => $x?->y['z'] ?? throw new E();\n$m = match(true) { 1, 2 => 'a', default => 'b', };\nif ($a): ?>html<?php endif;\necho <<<EOT\n a $b\n EOT;\n", "plain html"],
    "c": ["#include <a.h>\n#define X(a) \\\n  (a)\ntypedef struct s { int a : 3; struct s *n; } s_t;\nstatic const char *f(int (*cb)(void *), unsigned long n[static 3]) {\n  s_t x = { .a = 1, .n = (s_t *) 0 };\n  for (int i = 0; i < n; ++i) { if (x.a) goto end; else *p++ = sizeof(int) * -1; }\n  switch (n) { case 1: default: break; }\nend:\n  return \"a\" \"b\";\n}\n"],
    "cpp": ["#include <v>\nnamespace a::b {\ntemplate <typename T, int N = 3> class V : public W<T>, private X { public: explicit V(const T& x) noexcept : x_{x}, W<T>(x) {} virtual ~V() = default; auto f() const -> decltype(x_) override; V& operator=(V&&) = delete; private: std::map<int, std::vector<T>> x_; };\n}\nint main() { auto l = [&, x = 1](auto&& y) mutable { return y < x ? y : x; }; for (const auto& [k, v] : m) { if (auto it = m.find(k); it != m.end()) throw std::runtime_error(\"x\"); } return static_cast<int>(a->*b) >> 1; }\n"],
    "c_sharp": ["using System;\nusing static A.B;\nnamespace N;\n[X(1)] public partial record struct R<T>(int A) where T : class, new() { public int P { get; private set; } = 1; public string Q => $\"a{P}b\"; event Action E; public static R<T> operator +(R<T> a, R<T> b) => a; async Task<int> F(ref int x, params int[] y) { await foreach (var (a, b) in z) { } var q = from a in b where a > 1 orderby a descending select new { a, b.C }; return x switch { > 1 and < 3 => 2, R { A: 1 } r => 3, _ => throw new E() }; } }"],
}
BROKEN = {
    "python": ["def f(:\n    pass\n", "if x:\npass\n", "x = (1,\n", "<<<<<<< HEAD\nx = 1\n=======\n", "a, b\n05-11\n", "return {{ x }} 3\n", "  x = 1\n y = 2\n", "class A\n    pass\n"],
    "javascript": ["function f( {", "let x = ;", "a b", "const note9 = “x”;", "<A><B></A>", "return {{ x }} 3;", "/* open", "x = 'a\n'", "if (x) {", "f(1,, 2)", "package a;"],
    "typescript": ["#include \"a.h\"\n", "function f((a: number) {}", "let x: = 3"], "tsx": ["const x = <A>{</A>"],
    "java": ["class A { void f() { ", "class A { int x = 1 }", "import re\n", "class A { void f() { return x y; } }", "}"], "go": ["package a\nfunc f() {", "package a\nx := 1 2\n", "use a::b;", "package a\n\nfunc f(n int) int {\n\treturn n\n"],
    "rust": ["fn f() { let x = ; }", "package a\n\nfunc f() {}", "fn f( { }"], "php": ["<?php\nfunction f( {", "<?php $a = ;", "<?php class A { function f() { "],
    "c": ["int f( { return 1; }", "int f(std::vector<int> x) { }", "class A { };", "int x = 3", "import os\nx = 1\n"], "cpp": ["int f() { ", "def f():\n    pass\n", "int f() { x + ; }"], "c_sharp": ["class A { void F() { ", "package a\n\nimport (\n)", "class A { int x = ; }"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    for text in VALID[language]:
        assert first_error(text, language) is None, text
        assert first_error("﻿" + text.replace("\n", "\r\n"), language) is None, text


@pytest.mark.parametrize("language", BROKEN)
def test_broken(language):
    for text in BROKEN[language]:
        assert first_error(text, language) is not None, text


def test_lines_and_kinds():
    assert first_error("a = 1\n<<<<<<< x\n", "python") == (2, "merge")
    assert first_error("a = (\n\n", "python")[1] == "end"
    assert first_error("x = $\n", "python") == (1, "lexical")
    assert first_error("x y\n", "python") == (1, "syntax")


def test_python_against_its_own_parser():
    rng = random.Random(5)
    base = "import a\n\n\ndef f(x, y=1):\n    if x > 1 and (y or [1, 2]):\n        return {'a': x}\n    for i in range(3):\n        print(i, end='')\n    else:\n        pass\n\n\nclass C:\n    z = 1\n"
    same = 0
    for _ in range(400):
        i = rng.randrange(len(base))
        text = base[:i] + rng.choice(["", "(", ")", ":", " ", "x", "1", "\n", "if", ","]) + base[i + rng.randrange(3) :]
        try:
            compile(text, "x", "exec", ast.PyCF_ONLY_AST)
            ok = True
        except SyntaxError:
            ok = False
        same += ok == (first_error(text, "python") is None)
    assert same >= 395  # forms that only Python's later checks refuse


def test_ambiguous_grammar():
    t = compile_grammar("s : e ; e : e '+' e | e '*' e | 'x' | '(' e ')' ;")
    ids = t.terms
    for text, ok in (("x+x*x", True), ("(x+x)*x", True), ("x+", False), ("", False), ("(x", False)):
        assert (recognise(t, [ids[c] for c in text]) is None) is ok


def test_files(spark):
    ext = spark.createDataFrame([(".PY", "python", 1), (".go", "go", 2)], "ext string, language string, path int")
    schema = "project_id string, path string, content string, ingested_at timestamp, verdict string"
    assert parse_check.parse_files(spark.createDataFrame([], schema), ext).collect() == []
    import datetime as dt

    rows = [("p", "a.py", "x = (", dt.datetime(2024, 1, 1), "v"), ("p", "a.py", "x = 1", dt.datetime(2024, 1, 2), "v"), (None, "b.Py", "x =", None, None), ("p", "c.py", None, None, None), ("p", None, "x", None, None), ("p", "d.txt", "(", None, None), ("p", "big.py", "x = 1\n" * 50_000, None, None)]
    got = {(r.project_id, r.path): r.valid for r in parse_check.parse_files(spark.createDataFrame(rows, schema), ext).collect()}
    assert got == {("p", "a.py"): True, (None, "b.Py"): False, ("p", "big.py"): True}
