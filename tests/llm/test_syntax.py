import glob
import os

import pytest

from tidemark.llm.syntax import fault, fault_rates, unparsable
from tidemark.llm.syntax_js import Bad
from tidemark.llm.syntax_python import Python

GOOD = {
    "Python": ["", "\ufeffx = 1\n", "f'{a!r:>{w}} {b[\"k\"]}'\n", "s = '''it's\n=======\n'''\n", "match x:\n    case [a, *_]:\n        pass\n", "type X = int\n", "# <<<<<<< ours\n", 'r"\\\\"', "f'{x:{{}}}'\n" if False else "f'{{}}'\n", "async def f():\n    return [x async for x in y]\n"],
    "JavaScript": ["", "const a = b / c / d; const r = /[/]\\/(?<x>y)/giu.test(s);", "for (const [k, v] of Object.entries(o)) { if (!k) continue; else break }", "a = b\n++c", "x = `a ${`n ${1}`} b`;", "class A extends (B, C) { static #p = 1; get x() { return this.#p } async *g() { yield* y } static { f() } }", "label: while (1) { break label }", "export default async function () { await x?.y?.[0]?.(1) ?? z }", "import a, { b as c } from './x'; import * as d from \"y\"; export * from 'z'", "({ a, b: [c = 1, ...d] }) => ({ ...a, ['k']: 1, get q() { return 1 }, async m() {} })", "if (a) function f() {}", "var f = async x => { await x }, g = async (x, y) => x", "!function(e){var t={};e.exports=t}({});", "#!/usr/bin/env node\nx", "do x(); while (y) z()", "try { a } catch { b } finally { c }", "switch (a) { case 1: b; break; default: c }", "let x = a ? b : c ? d : e", "return_ = 1", "/* ======= */ x", "new Foo", "new (f())(1).x", "a\n/b/g", "x = {async: 1, get: 2, set, of}", "for (;;) {}", "delete a[b], void 0, typeof c", "'\\\n'", "let async; async = 1; async()"],
    "TypeScript": ["interface A<T extends B = C> extends D, E<F> { readonly a?: string; [k: string]: unknown; new (x: number): A; m<U>(this: A, ...r: U[]): asserts r is X }", "type F = { [K in keyof T as `x${K}`]?: T[K] extends infer U ? U : never } & ((a: string) => void) | new () => X", "const f = <T,>(x: T): x is T => x as unknown as T", "enum E { A = 1 << 2, B = 'b' } declare module 'x' { export const y: number }", "abstract class A<T> implements B { private constructor(private readonly x: T, public y?: string) { super() } abstract m(): void; declare z: string; override get q(): number { return 1 } }", "let x = <any>y; let z = a! + b!.c; let g = f<string>(1); if (a < b && c > (d)) {}", "import type { A } from './a'; export type { A }; import x = require('y'); export = x;", "function f(a: number): void; function f(a: any) {}", "const t: [a: string, b?: number, ...c: X[]] = y satisfies Z", "namespace N.M { }", "@dec() class C { @dec p = 1 }", "for (const a of b as C[]) {}", "let a: typeof import('x'), b: A.B<C>[], c: unique symbol, d: -1 | 'x' | null", "export async function f(): Promise<string[]> { return (await r.json()) as string[]; }", "type A = B<C<D<E>>>", "let f = (a?: number) => a", "let o = { m<T>(x: T): T { return x } }", "let x = y < z", "a ? (b) : c => d"],
    "TSX": ["const a = <div className=\"x\" {...p} on={() => f(<b/>)}>don't {x ? <i>1</i> : null} // it's {/* c */}<A.B<string> c='y'/></div>;", "const f = <T,>(x: T) => <></>;", "function F({ a, b }: { a: string; b: (x: string) => void }) { return (<ul>{a.map((x) => <li key={x}>{x}</li>)}</ul>); }", "let x = a < b;"],
    "Rust": ["", "#![allow(x)]\nuse a::{b, c::{self, *}, d as e};\n", "fn f<'a, T: B<C = D> + 'a, const N: usize>(x: &'a mut [T; N], mut y: impl Fn(u8) -> u8) -> Result<Vec<Vec<T>>, E> where T: for<'b> X<'b> { let v = x as *const u8 as usize; if let Some(ref a @ 1..=9) = b && !c { return Ok(d?) } for (i, _) in e.iter().enumerate() { 'l: loop { break 'l } } match z { A::B { c, .. } | D(1 | 2) if g => {} 'a'..='z' => (), _ => unreachable!(\"{}\", x), } Ok(vec![1; 3]) }", "struct A(pub u8, B); struct C; pub(crate) struct D<T> where T: E { pub a: T } enum F { A = 1, B(u8), C { x: u8 } }", "impl<T> !Send for X<T> {} unsafe impl<'a> A<'a> for B { type C = D; const E: u8 = 1; fn f(&self) -> Self::C { Self { a: 1, ..self.b() } } }", "macro_rules! m { ($($x:expr),*) => { $( $x )* } }", "fn f() { let c = |x: u8, (a, b)| -> u8 { x }; let d = move || 1; let r = r#\"a \"b\" c\"#; let e = b'\\'' ; let s = 1.0e-3_f64 + 0xff_u8 as f64 + 1..2; x.0.1; a.b::<C>(); <T as U>::v(); if x == (Y { z: 1 }) {} }", "/* a /* b */ c */ // d\nmod x;\nextern \"C\" { fn g(a: *mut u8, ...); }", "pub trait A: B + 'static { async fn f(self: Box<Self>) -> impl C { 1 } fn g(); }", "fn f() { match x { _ if y => return, _ => { 1 } _ => if a { b } else { c } } let Some(x) = y else { return }; unsafe { *p = 1 } async move { 1 }.await; }", "static X: [u8; 2] = [0x04, 0x8c];", "fn a() -> bool { a < b && c >> 1 > d }", "type A = Box<dyn Fn(&str) -> Option<Vec<u8>> + Send>;"],
}
BAD = {
    "Python": ["def f(:\n", "x = (1\n", "<<<<<<< ours\nx\n=======\ny\n>>>>>>> b\n", "s = 'a\n", '"""x', "f'{a", "if x:\n", "  x\n y\n", "use a::b;", "x = 1\x00"],
    "JavaScript": ["const x", "f(", "a b", "\"x", "`a ${b", "/a", "let x = {a: 1", "def f(x):\n    pass", "interface A { b: c }", "const f = (a: number) => a", "import { a } fro", "class A {", "<<<<<<< a\nx\n=======\ny\n>>>>>>> b", "return 1", "enum A { B }", "x = <div/>", "SELECT a FROM b", "{\"a\": 1}", "for (const x of y", "if (a) }", "'a\nb'", "const = 1", "a ? b", "1 = x", "fn main() {}", "x = y z"],
    "TypeScript": ["interface A {", "let x: = 1", "type A = ", "function f(a: string", "const x = <div>a</div>;", "public size(): number {}", "let a: B<C", "export const"],
    "TSX": ["<div>", "<a></b>", "<a b=></a>", "const x = <div>{</div>;", "from a import b"],
    "Rust": ["fn f(", "fn f() { let x = ; }", "\"a", "'", "fn f() { a b }", "use std::colle", "struct A {", "/* a", "fn f() -> { }", "const x = 1;", "def f(): pass", "pub fn f() { 1 + }", "r#\"a\"", "fn f() } {", "let x = 1;", "fn f() { if x { }", "<<<<<<< a\nfn f() {}\n=======\nfn g() {}\n>>>>>>> b\n", "{\"a\": 1}", "impl A { x }"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(language, text):
    assert fault(text, language) is None


@pytest.mark.parametrize("language,text", [(k, t) for k, v in BAD.items() for t in v])
def test_invalid(language, text):
    assert fault(text, language) is not None


def test_every_cut_of_a_file_is_found():
    text = "export function f(a) {\n  return a.map((x) => x + 1);\n}\n"
    assert all(fault(text[:n], "JavaScript") for n in range(22, len(text) - 2)) and not fault(text, "JavaScript")
    rust = "pub fn f(a: &[u8]) -> u8 {\n    a.iter().map(|x| x + 1).sum()\n}\n"
    assert all(fault(rust[:n], "Rust") for n in range(1, len(rust) - 2))


def test_deep_and_long():
    assert fault("x = " + "[" * 3000 + "]" * 3000, "JavaScript") is None
    assert fault("x = " + "[" * 3000 + "]" * 2999, "JavaScript")
    assert fault("fn f() { " + "(" * 2000 + "1" + ")" * 2000 + " }", "Rust") is None
    assert fault("let a = 1;\n" * 20_000, "JavaScript") is None


def test_nesting_is_read_or_told():
    for n in (6_000, 50_000):
        assert fault("x = " + "[" * n + "1" + "]" * n + ";", "JavaScript") is None and fault("x = " + "[" * n + "1 1" + "]" * n + ";", "JavaScript")
        assert fault("fn f() { let x = " + "[" * n + "1" + "]" * n + "; }", "Rust") is None and fault("fn f() { let x = " + "[" * n + "1 1" + "]" * n + "; }", "Rust")
    assert fault("x = " + "[" * 5_000 + "1" + "]" * 5_000, "Python") == "nested too deep"
    assert fault("x = " + "[" * 600_000 + "1" + "]" * 600_000 + ";", "JavaScript") == "nested too deep"


JUMPS = {
    "Python": (["while x:\n    break\n", "def f():\n    return 1\n"], ["return 1\n", "break\n", "nonlocal x\n", "def f():\n    continue\n", "class A:\n    return 1\n"]),
    "JavaScript": (
        ["for (;;) break", "switch (a) { case 1: break }", "a: { break a }", "a: for (;;) { for (;;) continue a }", "with (a) b", "for (;;) { switch (a) { default: continue } }"],
        ["break;", "continue;", "switch (a) { case 1: continue }", "for (;;) { function f() { break } }", "for (;;) break a", "a: { () => { break a } }", "with (a) break", "class A { static { return } }"]),
    "Rust": (["fn f() { break }"], []),
}


@pytest.mark.parametrize("language", JUMPS)
def test_jumps(language):
    good, bad = JUMPS[language]
    assert [fault(t, language) for t in good] == [None] * len(good)
    assert all(fault(t, language) for t in bad), [t for t in bad if not fault(t, language)]


BLOCKS = ["def f", "def f()", "for x in y", "if x:\n    y\n  z", "x\n  y", "try:\n    x\n", "try:\n    x\ny", "else:\n    x", "if x:\n    y\nz\nelse:\n    w", "x = y if z", "a b", "x = a +", "f(a,\n  b c)", "if x:\n", "while x:\n    # y\n", "x = (a +)", "\tif x:\n        y"]


@pytest.mark.parametrize("text", BLOCKS)
def test_python_stack_tells_without_the_interpreter(text):
    with pytest.raises(Bad):
        Python(text).check()


def test_python_stack_lets_the_library_pass():
    for path in sorted(glob.glob(os.path.join(os.path.dirname(os.__file__), "*.py")))[:120]:
        Python(open(path, encoding="utf-8", newline="").read()).check()


def test_reasons():
    assert fault("x\n<<<<<<< a\n", "JavaScript") == "merge conflict" and fault("f(", "JavaScript") in ("premature end", "unbalanced delimiters") and fault("'a", "JavaScript") == "unterminated literal"


def test_table(spark):
    rows = [(1, "r", "a.py", "x = (", "z"), (2, "r", "b.PY", "x", "z"), (3, "r", "c.rs", None, "z"), (4, "r", None, "x", "z"), (5, None, "d.ts", "let x: = 1", "z"), (6, "r", "e.md", "(", "z"), (1, "r", "a.py", "x = (", "z"), (7, "r", "rs", "(", "z"), (8, "r", "x.mjs", "", "z")]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, path string, content string, language string")
    got = unparsable(df)
    assert sorted(r["file_id"] for r in got.where("fault is not null").collect()) == [1, 1, 5]
    rates = {(r["repo"], r["language"]): (r["files"], r["invalid"], r["share"]) for r in fault_rates(got).collect()}
    assert rates == {("r", "Python"): (3, 2, 0.666667), (None, "TypeScript"): (1, 1, 1.0), ("r", "JavaScript"): (1, 0, 0.0)}
    assert unparsable(df.limit(0)).count() == 0
