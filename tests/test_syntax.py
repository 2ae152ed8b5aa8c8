"""Declarations of every language, as chunks and outlines."""

from __future__ import annotations

import pytest

from corvane.operators import chunking as ck
from corvane.operators import syntax as sx

# (language, text, the first words of each chunk)
CHUNKS = [
    ("typescript", "function hello() { return 'world'; }", ["function hello"]),
    ("typescript", "class Foo { bar(): string { return 'baz'; } baz(): number { return 42; } }", ["bar()", "baz()"]),
    ("typescript", "interface User { name: string; }\ntype Point = { x: number; y: number; };\nexport type B =\n  | 'a'\n  | 'b';\n", ["interface User", "type Point", "type B"]),
    ("typescript", "const f = (a: {b: number}, c = g()) => {\n  if (a) { return 1; }\n};\nexport default async function main<T>(x: T): Promise<void> {\n  const s = `${x} }`; // }\n  for (const i of y) { foo(); }\n}\nconst h = x => x + 1;", ["(a: {b", "async function main", "x => x + 1"]),
    ("typescript", "class K<T> extends L { private async get(a = {x: 1}): Promise<{a: number}> { if (a) {} } constructor(private z: string) { super(); } }", ["private async get", "constructor("]),
    ("javascript", "const o = { m() { return /}/.test(x); } };\nfunction* g() { }\nitems.map(x => { return x; });", ["m() {", "function* g", "x => {"]),
    ("python", "@deco\ndef a():\n    pass\n\nclass C:\n    def m(self):\n        return 1\n    async def n(self): ...\n", ["@deco", "def m", "async def n"]),
    ("java", "package x;\n@S\npublic class A extends B {\n  public A() { }\n  @Override\n  public <T> List<T> go(Map<String, T> m) throws E, F {\n    if (x) { run(); }\n  }\n  abstract void q();\n}\ninterface I { void m(); }\nenum E { A, B; }", ["@Override", "abstract void q", "interface I", "enum E"]),
    ("go", "package main\n\nfunc Add[T any](a, b T) T {\n\treturn a\n}\ntype S struct {\n\tx int\n}\nfunc (s *S) Get() (int, error) { f := func() {}; return s.x, nil }\n", ["func Add", "func (s *S) Get"]),
    ("c", "#include <a.h>\n#define MAX 10\nint add(int a) {\n  return a;\n}\nstruct Point {\n  int x;\n};\nenum Color { RED };\ntypedef struct { int x; } P;\ntypedef int myint;\nstatic void *foo(void (*cb)(int)) { if (x) { while(1) {} } }", ["#define MAX", "int add", "struct Point", "enum Color", "typedef struct", "typedef int", "static void *foo"]),
    ("cpp", "namespace n { class A : public B { public: A() : x(1) {} ~A() {} int get() const override { return x; } }; }\nvoid A::run(int x) { }\nenum class C { X };", ["A() : x(1)", "~A()", "int get()", "void A::run", "enum class C"]),
    ("csharp", "class Calculator { int Add(int a, int b) { return a + b; } public int X { get; set; } public int Y() => 3; }\nrecord R(int A);\nstruct P { double X; }\ninterface IR { void Save(); }\nenum Color { Red }", ["int Add", "public int Y", "record R", "struct P", "interface IR", "enum Color"]),
    ("rust", "pub fn f<'a>(x: &'a str) -> R where T: X {\n let c = '}';\n}\npub struct S(i32);\nimpl<T> Tr for S { fn m(&self) {} }\nenum E { A }\ntrait Q { fn z(); }\ntype A = B;", ["pub fn f", "pub struct S", "impl<T> Tr", "enum E", "trait Q", "type A"]),
    ("kotlin", "fun greet(name: String): String {\n    return \"Hello $name\"\n}\nobject My {\n    fun doStuff() {}\n}\nfun b() = 3\nval x = 1", ["fun greet", "object My", "fun b()", "val x"]),
    ("swift", "class Point { func distance(other: Point) -> Double { return 0.0 } func text() -> String { return \"}\" } }\nprotocol D {\n    func draw()\n}", ["func distance", "func text", "protocol D"]),
    ("php", "<?php\nfunction f($a) { return 1; }\nclass A { public static function g(): int { $c = function () {}; return 2; } }", ["function f", "public static function g"]),
    ("bash", "foo() {\n  echo ${x} # }\n}\nfunction bar {\n echo hi\n}\n", ["foo()", "function bar"]),
    ("powershell", "function Get-X {\n param($a)\n}\n", ["function Get-X"]),
    ("css", "@import 'x';\n.a, .b:hover { color: red; }\n@media (x) { .c { d: e } }\n@keyframes k { from {a:b} }", ["@import", ".a, .b", "@media", "@keyframes"]),
    ("html", "<html><script>var a = '<b>';</script><p>x</p><style>.a{}</style></html>", ["<script>", "<style>"]),
    ("xml", "<?xml version='1.0'?>\n<!-- <x> -->\n<Project Sdk=\"X\">\n <A b='>'/>\n <C><D/></C></Project>", ["<Project"]),
    ("json", '{\n "a": {"b": [1,{"c":2}]},\n "d": "x, y", "e": 3\n}', ['"a": {', '"d": "x, y"', '"e": 3']),
    ("json", '[{"a":1},{"b":2}]', ['"a":1', '"b":2']),
    ("toml", 'name = "test"\nversion = "1.0"\n\n[build]\noptimize = true\n\n[[dep]]\nts = "^5.0"\n', ["name", "version", "[build]", "[[dep]]"]),
]


@pytest.mark.parametrize(("language", "text", "want"), CHUNKS)
def test_chunks(language, text, want):
    got = [c[2] for c in sx.chunks(language)(text)]
    assert len(got) == len(want) and all(g.startswith(w) for g, w in zip(got, want, strict=True)), got
    assert all(g in text for g in got)


@pytest.mark.parametrize("language", sorted(sx.LANGUAGES))
def test_odd_texts(language):
    for text in ("", "   \n ", "}}}{{{", "((", "\"", "'unclosed", "/* open", "<a", "x" * 3000, "{" * 300 + "}" * 200):
        for a, b, c, _ in sx.chunks(language)(text):
            assert 1 <= a <= b and c in text
        sx.outline(language, text)


def test_outline_leaves_out_callables_within_callables():
    text = "class A {\n  m() {\n    const f = () => { g(); };\n    class B { n() { } }\n  }\n}\nfunction o() {\n  function p() { }\n}\n"
    assert [(k, n) for k, n, _, _ in ck.outline("a.js", text)] == [("class_declaration", "A"), ("method_definition", "m"), ("class_declaration", "B"), ("method_definition", "n"), ("function_declaration", "o")]
    assert ck.outline("a.py", "class C:\n    def m(self):\n        def inner(): pass\n") == [("class_definition", "C", 1, 3), ("function_definition", "m", 2, 3)]
    assert ck.outline("a.txt", "one\ntwo") == [("file", "2 lines", 1, 2)]
    assert ck.outline("a.yaml", "a: 1\nb:\n  c: 2\na: 3\n") == [("yaml", "a", 1, 1), ("yaml", "b", 2, 2)]
    assert ck.outline("a.md", "# One\ntext\n## Two\n") == [("atx_heading", "One", 1, 1), ("atx_heading", "Two", 3, 3)]
    assert ck.outline("a.h", "class A { };", {".h": "cpp"}) == [("class_specifier", "A", 1, 1)]


def test_descriptions():
    text = "/**\n * Adds two.\n */\nint add(int a) { return a; }\n// one\n// two\nvoid f() {}\n"
    assert [c[3] for c in sx.chunks("c")(text)] == ["Adds two.", "one\ntwo"]
    assert [c[3] for c in sx.chunks("python")('# above\ndef f(a):\n    """Says it."""\n    return a\n')] == ["above\nSays it."]


def test_outlines_of_files(spark):
    files = spark.createDataFrame([("a.go", "func F() {\n}\n"), ("b.zzz", "x"), (None, None)], "path string, text string")
    got = sorted((str(r["path"]), r["kind"], r["name"]) for r in ck.outlines(files).collect())
    assert got == [("None", "file", "1 lines"), ("a.go", "function_declaration", "F"), ("b.zzz", "file", "1 lines")]
