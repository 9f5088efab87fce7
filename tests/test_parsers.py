"""Parsers on small source files: literal rows."""

from millrace.sources import parsers
from millrace.sources.lexer import brackets, tokens

JS='''import def, { a, b as c } from './x';
import * as ns from "pkg";
import './side';
const re = /["'`{]\\/[/"]*/g, n = 1;
const { d, e } = require('./dd');
export class K extends Base.Inner {
  #hid() { return this.go(`x ${helper(1)} }`); }
  @dec() static async go(a, b) {
    const inner = () => hidden();
    list.map(x => x.y(hidden2()));
    return other(a), this.#hid(), tag`t`, new Foo(bar());
  }
  field = () => nope();
  get val() { return 1 }
  *gen() { yield* this.go() }
  [Symbol.iterator]() { }
}
export default K;
function run(x) { if (x) { return K(); } function nested() { z(); } return { m() { q(); }, k: v() } }
async function later() { await run(1) }
function* g() { }
const go = async (p, q = {}) => { call(); }, one = z => z, fx = function named(a) { return a }, iife = (function() {})();
export { run, go as default2 } from './y';
export default function () { }
let multi =
  foo(1)
  .bar()
var last = 3
if (x) { const hiddenVar = require("inif"); }
'''
TS='''import type { T } from './t';
@Component({ a: '}' })
export class S<A> extends Base<A> implements I, J<string>, k.L {
  private x: number = 1;
  constructor(private a: string) { super(); this.init(); }
  protected run<T>(a: Map<string, number>): Promise<void> { go<string>(a); return this.run2?.(a); }
  over(a: string): void;
  over(a: any): void { }
  abstract q(): void;
}
export interface I extends A, B<C> { m(): void }
export abstract class Abs { m() {} }
declare function dd(): void;
export enum E { A = 1 }
const enum CE { B }
namespace N.M { export function f(): number { return g(); } export const z: Map<string, number> = new Map<string, number>(); interface Q {} }
type X = { a: () => void };
const arrow = <T,>(x: T): T => x;
export const typed: (a: number) => void = (a) => { };
function over(a: string): void;
function over(a: any): void { h(); }
let u: string, v = 2
'''
JAVA='''/* { */ package a.b;
import a.c.D;
import static x.Y.*;
@Ann(value = "}{")
public class T<X extends Comparable<X>> extends U<X> implements I, J<K>, p.Q {
  private static final int[] F = { 1, 2 };
  Runnable r = new Runnable() { public void run() { f(); } };
  static { init(); }
  public T(int a) { this(a, 1); go(a); }
  @Override
  protected <V> Map<String, List<V>> m(final int x, String... y) throws E, G<H> {
    String s = """ text " { """; char c = '"';
    new Thread(() -> lam()).start();
    Object o = new Object() { void inner() { hidden(); } };
    this.self(x); other.call(); super.m(1); Outer.this.no(); T::m; new Foo(arg());
    class Local { void k() { nope(); } }
    if (x > 1) { return helper(x); }
  }
  abstract int[] arr();
  enum Nested { A; void no() {} }
  interface Inner { void no(); }
  record R(int a) { void no() {} }
  @interface An { }
}
interface W extends A, B<C> { int size(); default void d() { size(); } }
enum Q implements I { ONE { void x() {} }; void m() { } }
'''
PY='''import os, sys as s
from .a import b as c, d
from __future__ import annotations
from x import *
X: int = 1
a = b = 2
(p, q) = 1, 2
@dec
class C(Base, abc.ABC, metaclass=M):
    y = 1
    def m(self, x: "str" = ")") -> dict[str, int]:
        self.n(f(g()))
        def inner(): h()
        return [k() for k in cls.z()]
    class In: pass
class E(Enum):
    A = 1
    def no(self): pass
async def _f(): import re
try:
    import opt
except ImportError: pass
'''


def rows(path, text):
    found = list(parsers.findings(path, text))
    symbols = [(r[1], r[3], r[4], r[5], r[6], r[7], r[8]) for r in found if r[0] == "symbol"]
    relations = {(r[1], r[2], r[9]) for r in found if r[0] == "relation"}
    calls = [(r[2], r[9], r[11]) for r in found if r[0] == "call"]
    imports = [(r[1], r[9], r[10], r[11]) for r in found if r[0] == "import"]
    return symbols, relations, calls, imports


def test_js():
    symbols, relations, calls, imports = rows('src/k.js', JS)
    assert symbols == [
        ('re', 'variable', 'public', 4, 4, None, None),
        ('n', 'variable', 'public', 4, 4, None, None),
        ('K', 'class', 'public', 6, 17, 'extends Base.Inner', None),
        ('#hid', 'method', 'private', 7, 7, '()', 'src.k.K'),
        ('go', 'method', 'public', 8, 12, '(a, b)', 'src.k.K'),
        ('val', 'method', 'public', 14, 14, '()', 'src.k.K'),
        ('gen', 'method', 'public', 15, 15, '()', 'src.k.K'),
        ('[Symbol.iterator]', 'method', 'public', 16, 16, '()', 'src.k.K'),
        ('run', 'function', 'public', 19, 19, '(x)', None),
        ('later', 'function', 'public', 20, 20, '()', None),
        ('go', 'function', 'public', 22, 22, '(p, q = {})', None),
        ('one', 'function', 'public', 22, 22, '', None),
        ('fx', 'function', 'public', 22, 22, '(a)', None),
        ('iife', 'variable', 'public', 22, 22, None, None),
        ('multi', 'variable', 'public', 25, 27, None, None),
        ('last', 'variable', 'public', 28, 28, None, None),
    ]
    assert relations == {
        ('belongs_to', 'src.k.K', 'src.k'),
        ('belongs_to', 'src.k.K.#hid', 'src.k.K'),
        ('belongs_to', 'src.k.K.[Symbol.iterator]', 'src.k.K'),
        ('belongs_to', 'src.k.K.gen', 'src.k.K'),
        ('belongs_to', 'src.k.K.go', 'src.k.K'),
        ('belongs_to', 'src.k.K.val', 'src.k.K'),
        ('extends', 'src.k.K', 'Base.Inner'),
        ('imports', 'src.k', './dd'),
        ('imports', 'src.k', './side'),
        ('imports', 'src.k', './x'),
        ('imports', 'src.k', 'inif'),
        ('imports', 'src.k', 'pkg'),
    }
    assert calls == [
        ('src.k.K.#hid', 'go', True),
        ('src.k.K.#hid', 'helper', False),
        ('src.k.K.go', 'other', False),
        ('src.k.K.go', '#hid', True),
        ('src.k.K.go', 'tag', False),
        ('src.k.K.go', 'bar', False),
        ('src.k.K.gen', 'go', True),
        ('src.k.run', 'K', False),
        ('src.k.run', 'v', False),
        ('src.k.later', 'run', False),
    ]
    assert imports == [
        ('import', './x', ['a', 'b as c', 'def'], True),
        ('import', 'pkg', ['ns'], False),
        ('import', './side', [], True),
        ('export', 'default', ['K'], False),
        ('export', "'./y'", ['run'], False),
        ('export', "'./y'", ['go as default2'], False),
        ('export', 'default', ['function () { }'], False),
        ('import', './dd', [], True),
        ('import', 'inif', [], False),
    ]


def test_ts():
    symbols, relations, calls, imports = rows('t.ts', TS)
    assert symbols == [
        ('S', 'class', 'public', 3, 10, 'extends Base', None),
        ('constructor', 'method', 'public', 5, 5, '(private a: string)', 't.S'),
        ('run', 'method', 'protected', 6, 6, '(a: Map<string, number>)', 't.S'),
        ('over', 'method', 'public', 8, 8, '(a: any)', 't.S'),
        ('I', 'interface', 'public', 11, 11, 'extends A, B<C>', None),
        ('E', 'enum', 'public', 14, 14, None, None),
        ('CE', 'enum', 'public', 15, 15, None, None),
        ('N.M', 'namespace', 'public', 16, 16, None, None),
        ('f', 'function', 'public', 16, 16, '()', None),
        ('z', 'variable', 'public', 16, 16, None, None),
        ('Q', 'interface', 'public', 16, 16, None, None),
        ('arrow', 'function', 'public', 18, 18, '(x: T)', None),
        ('typed', 'function', 'public', 19, 19, '(a)', None),
        ('over', 'function', 'public', 21, 21, '(a: any)', None),
        ('u', 'variable', 'public', 22, 22, None, None),
        ('v', 'variable', 'public', 22, 22, None, None),
    ]
    assert relations == {
        ('belongs_to', 't.S', 't'),
        ('belongs_to', 't.S.constructor', 't.S'),
        ('belongs_to', 't.S.over', 't.S'),
        ('belongs_to', 't.S.run', 't.S'),
        ('extends', 't.I', 'A'),
        ('extends', 't.I', 'B<C>'),
        ('extends', 't.S', 'Base'),
        ('implements', 't.S', 'I'),
        ('implements', 't.S', 'J<string>'),
        ('imports', 't', './t'),
    }
    assert calls == [
        ('t.S.constructor', 'init', True),
        ('t.S.run', 'go', False),
        ('t.S.run', 'run2', True),
        ('t.N.M.f', 'g', False),
        ('t.over', 'h', False),
    ]
    assert imports == [
        ('import', './t', ['T'], True),
    ]


def test_java():
    symbols, relations, calls, imports = rows('src/T.java', JAVA)
    assert symbols == [
        ('a.b', 'namespace', 'public', 1, 1, None, None),
        ('T', 'class', 'public', 4, 24, None, None),
        ('T', 'method', 'public', 9, 9, '(int a)', 'a.b.T'),
        ('m', 'method', 'protected', 10, 18, '(final int x, String... y) : Map<String, List<V>>', 'a.b.T'),
        ('arr', 'method', 'package-private', 19, 19, '() : int[]', 'a.b.T'),
        ('W', 'interface', 'package-private', 25, 25, None, None),
        ('size', 'method', 'package-private', 25, 25, '() : int', 'a.b.W'),
        ('d', 'method', 'package-private', 25, 25, '() : void', 'a.b.W'),
        ('Q', 'enum', 'package-private', 26, 26, None, None),
    ]
    assert relations == {
        ('belongs_to', 'a.b.Q', 'a.b'),
        ('belongs_to', 'a.b.T', 'a.b'),
        ('belongs_to', 'a.b.T.T', 'a.b.T'),
        ('belongs_to', 'a.b.T.arr', 'a.b.T'),
        ('belongs_to', 'a.b.T.m', 'a.b.T'),
        ('belongs_to', 'a.b.W', 'a.b'),
        ('belongs_to', 'a.b.W.d', 'a.b.W'),
        ('belongs_to', 'a.b.W.size', 'a.b.W'),
        ('extends', 'a.b.T', 'U<X>'),
        ('extends', 'a.b.W', 'A'),
        ('extends', 'a.b.W', 'B<C>'),
        ('implements', 'a.b.Q', 'I'),
        ('implements', 'a.b.T', 'I'),
        ('implements', 'a.b.T', 'J<K>'),
        ('imports', 'a.b', 'a.c.D'),
        ('imports', 'a.b', 'x.Y'),
    }
    assert calls == [
        ('a.b.T.T', 'go', True),
        ('a.b.T.m', 'lam', True),
        ('a.b.T.m', 'self', True),
        ('a.b.T.m', 'arg', True),
        ('a.b.T.m', 'helper', True),
        ('a.b.W.d', 'size', True),
    ]
    assert imports == [
        ('import', 'a.c.D', [], False),
        ('static_import', 'x.Y', [], False),
    ]


def test_py():
    symbols, relations, calls, imports = rows('pk/p.py', PY)
    assert symbols == [
        ('X', 'variable', 'public', 5, 5, None, None),
        ('a', 'variable', 'public', 6, 6, None, None),
        ('C', 'class', 'public', 9, 15, '(Base, abc.ABC, metaclass=M)', None),
        ('m', 'method', 'public', 11, 14, '(self, x: "str" = ")") -> dict[str, int]', 'pk.p.C'),
        ('In', 'class', 'public', 15, 15, None, 'pk.p.C'),
        ('E', 'enum', 'public', 16, 18, '(Enum)', None),
        ('_f', 'function', 'protected', 19, 19, '()', None),
    ]
    assert relations == {
        ('belongs_to', 'pk.p.C', 'pk.p'),
        ('belongs_to', 'pk.p.C.In', 'pk.p.C'),
        ('belongs_to', 'pk.p.C.m', 'pk.p.C'),
        ('belongs_to', 'pk.p.E', 'pk.p'),
        ('belongs_to', 'pk.p._f', 'pk.p'),
        ('extends', 'pk.p.C', 'Base'),
        ('extends', 'pk.p.C', 'abc.ABC'),
        ('extends', 'pk.p.E', 'Enum'),
        ('imports', 'pk.p', '.a'),
        ('imports', 'pk.p', 'opt'),
        ('imports', 'pk.p', 'os'),
        ('imports', 'pk.p', 'sys as s'),
        ('imports', 'pk.p', 'x'),
    }
    assert calls == [
        ('pk.p.C.m', 'n', True),
        ('pk.p.C.m', 'f', False),
        ('pk.p.C.m', 'g', False),
        ('pk.p.C.m', 'k', False),
        ('pk.p.C.m', 'z', True),
    ]
    assert imports == [
        ('import', 'os', [], False),
        ('import', 'sys as s', [], False),
        ('import', '.a', ['b as c', 'd'], True),
        ('import', 'x', [], False),
        ('import', 'opt', [], False),
    ]


def test_tokens():
    found = tokens("a = b / c; x = /[/}]\\//g; `t ${ {a: 1} } u`; // end {\n'open\nz", script=True)
    assert [t.text for t in found] == ["a", "=", "b", "/", "c", ";", "x", "=", "/[/}]\\//g", ";", "`t ", "${", "{", "a", ":", "1", "}", "}", " u`", ";", "'open", "z"]
    assert [t.line for t in found][-2:] == [2, 3]
    pairs = brackets(tokens("f(a[1], {b: (c)}) )", script=True))
    assert sorted(pairs) == [1, 3, 7, 10] and pairs[1] == 14
    assert brackets(tokens("a { b (", script=True)) == {1: 3, 3: 3}


def test_broken_files_end():
    for text in ("class A {", "class", "function f(", "export default", "import {", "const a =", "`${", "x = /a", "export class", "@", "namespace N {", "interface I extends", "(" * 300, "}" * 50, "class A { m( }"):
        for path in ("a.js", "a.ts", "A.java"):
            assert all(r[0] != "error" for r in parsers.findings(path, text)), (path, text)


def test_table_function(spark):
    files = [("p.py", PY, 1), ("p.py", PY, 1), ("t.ts", TS, 2), ("T.JAVA", JAVA, 3), ("bad.py", "def (", 4), ("nul.py", "a\0", 5), ("n.py", None, 6), ("e.js", "", 7), ("x.rb", "class X; end", 8), (None, "x = 1", 9), ("noending", "x", 10), ("long.js", "/* {" + "x" * 3_000_000 + "*/ function f() { g() }", 11)]
    df = spark.createDataFrame(files, "path string, text string, name int").withColumnRenamed("name", "file.id")
    found = parsers.parse(df).cache()
    assert found.columns[:2] == ["path", "file.id"]
    symbols = parsers.symbols(found, "path").collect()
    assert sum(r.path == "p.py" for r in symbols) == 2 * len(rows("p.py", PY)[0])
    assert {r.path for r in symbols} == {"p.py", "t.ts", "T.JAVA", "long.js"}
    assert {r.path: r.error.split(":")[0] for r in parsers.failures(found, "path").collect()} == {"bad.py": "SyntaxError", "nul.py": "SyntaxError"}
    assert [(r.caller, r.callee, r.to_self) for r in parsers.calls(found, "path").where("path = 'long.js'").collect()] == [("long.f", "g", False)]
    assert parsers.relations(found, "path").where("path = 't.ts'").count() == len(rows("t.ts", TS)[1])
    assert {r.is_relative for r in parsers.imports(found, "path").collect()} == {True, False}
    assert parsers.parse(df.where("false")).count() == 0
    spark.udtf.register("parse_source", parsers.parse_source)
    df.createOrReplaceTempView("some_files")
    assert spark.sql("SELECT s.name FROM some_files f, LATERAL parse_source(f.path, f.text) s WHERE s.symbol_type = 'interface'").collect() == [("I",), ("Q",), ("W",)]


def test_python_lines_and_marks():
    symbols, _, calls, _ = rows("a/b.py", "x = 1\r\ndef f(a,\r\n      b=')') -> {1: ':'}:\r\n    '\x0c\u2028'; return g(lambda: h())\r\n")
    assert symbols == [("x", "variable", "public", 1, 1, None, None), ("f", "function", "public", 2, 4, "(a,\n      b=')') -> {1: ':'}", None)]
    assert calls == [("a.b.f", "g", False), ("a.b.f", "h", False)]
