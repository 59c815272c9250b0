"""Source files: recogniser against Python's own parser, islands, documentation, pairing."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm.docwords import prose, says_something
from millrace.llm.documented import paired
from millrace.llm.gll import Grammar, accepts, furthest
from millrace.llm.islands import Water, at_line, cleaned, islands
from millrace.llm.syntax import checked, dialect, rates

PYTHON = '''"""Doc."""
from __future__ import annotations
import a.b as c, d
from . import (x, y as z,)
@deco(1)
class K[T: int](Base, metaclass=M):
    a: int = 3
    async def m(self, /, p, *args, q: str = "x", **kw) -> list[int]:
        async with a as b, c: await d
        async for i in range(3): yield i
        return [i async for i in x if i], {**a, "k": v}, {1, 2, *s}
def f(*, a=lambda x, *y: x if x else y):
    global g; nonlocal_ = 1
    while (n := f(a)) > 0 and not n in b: n -= 1; continue
    else: pass
    try: x[1:2, ..., ::3] = y = yield
    except* (A, B) as e: raise E from e
    else: del x, (y, z[0])
    finally: assert x, "m"
    with (open(a) as f1, open(b)): pass
    print(*a, sep="", **k); x @= y ** -1; z = not a is not b
    match command.split():
        case [Point(x=0, y=_), *rest] | {"k": 1, **kw} as p if p: pass
        case -1 | "s" | None | a.b: ...
    if a: pass
    elif b: x: int
    return (yield), *a
match = case = type = 1
type Alias[T] = list[T]
s = f"{a!r}" """y
z"""; u = rb"x" b'y'; t = 0x1F + 1_000.5e-3j + 0b1
(a, [b, *c]), d.e = f[g]
for x, in y: print(x)
'''


def test_python_agrees_with_its_parser():
    rng = random.Random(1)
    lines = PYTHON.split("\n")
    texts = [PYTHON, "", "\n# only\n", "x = (1,\n  2)\n", "if x:\ny", "def f(:", "a = 'x", "  x = 1", "f() = 1", "x y", "é = 1\n", "class A: pass", "1 + ", "return", "@x\ny = 1", "\tif a:\n\t\tb\n", "while 1: x = y += 2", "a, b += 1", "lambda: (yield)", "x = yield", "print 1", "a if b", "del f()", "0777", "1__0", "b'a' 'c'", "x = {a: 1, b}", "for f() in y: pass"]
    for _ in range(400):
        text = list(PYTHON)
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(text))
            text[k : k + rng.randint(0, 3)] = rng.choice(["", "(", ")", ":", "\n", " ", "'", "x", "=", ",", "]"])
        texts.append("".join(text))
        texts.append("\n".join(lines[: rng.randrange(len(lines))]))
    wrong = 0
    for t in texts:
        try:
            ast.parse(t)
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        got = dialect(t, "python") is not None
        # Never rejects what Python accepts; accepts a few things that only later passes of Python's reject.
        assert got or not valid, t
        wrong += got and not valid
    assert wrong <= 0.04 * len(texts)


VALID = {
    "javascript": [
        "import a, { b as c } from './x.js';\nexport default class extends A { static #p = 1; get x() { return this.#p } async *g(a, ...b) {} static { f() } }",
        "const f = async ({ a, b: [c = 1, ...d] }, e) => ({ ...a, [k]: 1, m() {}, get n() { return 2 } })\nlet x = a ? b : c ?? d, y = `t${ `n${1}` }u`\nfor (const [k, v] of Object.entries(o)) { if (!k) continue; else break }",
        "var a = 1\nvar b = a\n++b\nlabel: do { x = /[/]\\/x/g.test(s) / 2 } while (x)\nswitch (a) { case 1: default: f() }\ntry { throw e } catch { } finally { }\nreturn_ = a?.b?.[c]?.(d)",
        "#!/usr/bin/node\nexport * as ns from 'x'\nexport { a as default }\nif (a) b; else c\nfor (;;) ;\nfor (x in y) z\nnew A.B(1)(2)[3]`t`\nasync function* g() { yield* h(); await p }",
    ],
    "java": [
        "package a.b;\nimport static c.D.*;\n@A(x = 1, y = {2, 3}) public abstract class C<T extends X & Y<? super Z>> extends D<T> implements E, F { static { f(); } private final int[] a = {1, 2}, b[] = null; C() throws X { this(1); } <U> U g(final int... x) { return (U) null; } enum G { A(1) { void f() {} }, B; int z; } @interface H { int v() default 3; } }",
        "record P(int x, String... y) implements Q { P { if (x < 0) throw new E(\"m\"); } }\nsealed interface S permits T {}\nfinal class T implements S { int f(Object o) { return switch (o) { case Integer i when i > 3 -> i; case P(int a, var b) -> { yield a; } case null, default -> 0; }; } }",
        "class A { void f() { List<Map<String, int[]>> x = new ArrayList<>(); for (int i = 0, j = 1; i < 3 && j >> 1 > 0; i++, --j) x.get(i)[2] += (int) y >>> 2; for (var z : x) {} Runnable r = () -> { }; F<A> g = A::new, h = int[]::clone; try (var a = b(); c) { } catch (X | Y e) { } finally { } synchronized (this) { } l: while (true) { continue l; } String t = \"\"\"\n a \"b\" \"\"\"; char c = '\\u0041'; assert a : b; a[0]++; new B() { }.m(); if (o instanceof String s && s.length() > 1) return; int q = a < b ? 1 : 2; } }",
        "open module a.b { requires transitive c; exports d to e, f; opens g; uses h.I; provides j.K with l.M; }",
    ],
    "go": [
        'package a\n\nimport (\n\tb "c/d"\n\t. "e"\n)\n\ntype T[K comparable, V any] struct {\n\tx, y int `json:"x"`\n\t*E\n}\n\nfunc (t *T[K, V]) M(a, b int, c ...string) (r map[K][]V, err error) {\n\tdefer func() { recover() }()\n\tfor i, v := range a {\n\t\tif x := f(v); x > 0 {\n\t\t\tcontinue\n\t\t} else if y {\n\t\t}\n\t}\n\tswitch v := x.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v, ok := <-d:\n\t}\n\treturn map[K][]V{k: {1, 2}}, nil\n}\n',
        "package a\nvar x = []struct{ a int }{{1}, {2}}\nconst (\n\tA = iota\n\tB\n)\nfunc f() { go func(x int) { ch <- x }(1); for ; ; { break }; for i := 0; i < 3; i++ { }; l: x[1:2:3], y = <-c, &T{a: 1}; goto l }\ntype I interface { ~int | string; M() }\nfunc g[T any](x T) T { return h[int](x) }",
    ],
}
INVALID = {
    "javascript": ["function f( {", "const x = ;", "a b", "<<<<<<< x\na\n=======\nb\n>>>>>>> y", "let s = 'a", "`${a", "class { ]", "if (a {", "/* open", "def f(x):\n    return x\n", "}"],
    "java": ["class A {", "class A { void f( { } }", "class A { int x = ; }", "<html>", "def f(): pass", "package a", "class A { void f() { x } }", "class A { void f() { return 1 } }"],
    "go": ["package a\nfunc f( {", "func f() {}", "package a\nfunc f() { x := }", "package a\nfunc f() {\n", "package a\n<<<<<<< x\n", "class A {}"],
}


@pytest.mark.parametrize("language", sorted(VALID))
def test_valid_and_invalid(language):
    for t in VALID[language]:
        assert dialect(t, language), (language, t)
    for t in INVALID[language]:
        assert dialect(t, language) is None, (language, t)
    assert dialect("", language) == dialect("\n \n", language) == "empty"


def test_recogniser_handles_ambiguity_and_left_recursion():
    g = Grammar({"s": "s s | 'a'"}, ["s"])
    assert accepts(g, ["a"] * 40) == "s" and accepts(g, ["a", "b"]) is None and furthest(g, ["a", "a", "b"]) == 2
    two = Grammar({"x": "'a' tail", "y": "'a' 'b' tail", "tail": "'c'*"}, ["x", "y"])
    assert accepts(two, ["a", "c"]) == "x" and accepts(two, ["a", "b", "c"]) == "y" and accepts(two, ["b"]) is None
    lines = Grammar({"p": "st*", "st": "NAME EOS"}, ["p"])
    assert accepts(lines, ["NAME", "NAME"], [True, True]) and not accepts(lines, ["NAME", "NAME"], [True, False]) and accepts(lines, ["NAME", ";", "NAME"])


def test_checked_and_rates(spark):
    rows = [(1, "r", "a.py", "python", "x = 1"), (2, "r", "b/c.PY", None, "x = ("), (3, "r", "d.js", "python", ""), (4, "s", "e.txt", None, "("), (5, "s", None, None, "("), (6, "s", "f.go", None, None), (7, None, "g.java", None, "class A {}" * 3000), (None, "r", "h.js", None, "a(")]
    df = spark.createDataFrame(rows, "file_id int, repo string, file_path string, language string, content string").withColumns({"valid": F.lit("clash"), "dialect": F.lit(1), "accepted": F.lit(2)})
    got = {r.file_id: r for r in checked(df, keep=("repo",)).collect()}
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: True, 7: True, None: False}
    assert got[2].language == "python" and 0 <= got[2].accepted < 1 and got[7].dialect == "unit"
    out = {(r.repo, r.language): (r.n_files, r.n_invalid, r.rate) for r in rates(checked(df, keep=("repo",)), ["repo", "language"]).collect()}
    assert out["r", "python"] == (2, 1, 0.5) and out["r", "javascript"] == (2, 1, 0.5)
    assert checked(df.limit(0)).count() == 0


JAVA = """public class A {
    /** A field. */
    int x;

    int none() { return 1; }

    /**
     * Adds { up.
     */
    @Override
    public int add(int a) {
        String s = "} ( {"; // }
        return a;
    }
}
"""
JS = """/** License. */

/** Counts (things). */
export const count = (a, b) => {
  return /[{]/.test(`x ${ a } {`);
};
// line
function plain() { }
class K {
  /** Moves it. */
  async move(x) { if (x) { return 1; } }
}
"""
GO = """package a

// Old text.

// Sum adds
// two.
//go:noinline
func Sum(a int) int {
\treturn a // }
}
func (t *T) None() { }
"""
PY = '''import x

class K:
    """Class."""
    @deco
    def f(
        self, a="):",
    ):
        # comment first
        r"""Raw \\d doc.

        More."""
        return 1

    async def g(self): "One line."

def h():
    x = """not doc"""

def i():
    b"""bytes"""
'''


def test_islands():
    found = {i.name: i for i in islands(JAVA, "java")}
    assert set(found) == {"none", "add"} and found["add"].doc == "Adds { up." and found["none"].doc is None and found["add"].code.endswith("return a;\n    }")
    found = {i.name: i for i in islands(JS, "javascript")}
    assert set(found) == {"count", "plain", "move"} and found["count"].doc == "Counts (things)." and found["plain"].doc is None and found["move"].doc == "Moves it."
    found = {i.name: i for i in islands(GO, "go")}
    assert found["Sum"].doc == "Sum adds\ntwo." and found["None"].doc is None and found["Sum"].code.endswith("}")
    found = {i.name: i for i in islands(PY, "python")}
    assert set(found) == {"f", "g", "h", "i"} and found["f"].doc.startswith("Raw \\d doc.") and found["g"].doc == "One line." and found["h"].doc is None and found["i"].doc is None
    crlf = at_line(Water(JAVA.replace("\n", "\r\n"), "java"), 11, "add")
    assert cleaned(crlf.doc) == "Adds { up."
    assert at_line(Water(JAVA, "java"), 3, "add") is None and at_line(Water("", "go"), 1) is None


SAYS = ["Returns the mean of both values.", "TODO: speed this up.\n\nOldest slots still unread.", "load_rows\n\nReads one record per line.", "Liczy średnią ważoną odczytów.", "Oldest rows first.\n\nArgs:\n    a: x\n", "Drops broken lines.\n\n:param a: b\n:return: c"]
SAYS_NOTHING = ["", None, "  ", "TODO", "FIXME: add docs later", "xxx", "...", "-----", "N/A", "_summary_\n\nArgs:\n    a (_type_): _description_\n\nReturns:\n    _type_: _description_", "See base class.", "Same as above.", "@see Other", "Inherits documentation.", "# type: ignore", "noqa", "pylint: disable=missing-docstring", "Load rows.", "The load rows function.", "load_rows()", "load_rows: a, b", "Args:\n    a:\n    b:\n", "Parameters\n----------\na : float\nb : float", "@param a\n@param b\n@return", ":param a:\n:return:", "Docstring for load_rows.", "Brak opisu.", "{@inheritDoc}", "TODO(ann): document load_rows", "<description>", "Fill me in!"]


@pytest.mark.parametrize("doc", SAYS)
def test_says_something(doc):
    assert says_something(doc, "load_rows", "a, b")


@pytest.mark.parametrize("doc", SAYS_NOTHING)
def test_says_nothing(doc):
    assert not says_something(doc, "load_rows", "a, b")


def test_prose_and_delimiters():
    assert prose("Does x.\n\nArgs:\n    a: text of it\n\n    b: more\n\nThen y.") == "Does x. Then y."
    assert cleaned('"""A b."""') == "A b." and cleaned("/**\n * A\n *  b.\n */") == "A\n b." and cleaned("// a\n// b") == "a\nb" and cleaned(None) is None and cleaned("'x'") == "x"


def test_paired(spark):
    files = [(1, "a.py", PY), (2, "b.java", JAVA), (3, "c.go", "package a\n\nvar s = `open\n\n// Sum adds two numbers up.\nfunc Sum(a int) int {"), (4, "d.py", None), (5, "e.rs", "fn x() {}"), (1, "a.py", PY)]
    entities = [
        (1, "f", "method", 6, None, None, None), (1, "f", "method", 6, None, None, " "), (1, "K", "class", 3, None, None, "Class."), (1, "h", "function", 17, None, None, '"""Keeps only valid readings."""'),
        (2, "add", "method", 11, "int add(int a)", None, None), (2, "none", "Method", 5, None, None, None), (3, "Sum", "function", 6, None, None, None), (4, "z", "function", 1, None, 'def z():\n    """Writes everything twice."""\n', None),
        (9, "gone", "function", 1, None, None, "Turns pages slowly."), (5, "x", "function", 1, None, "fn x() {}", None), (None, "f", "function", 1, None, None, "Says much more here."), (1, None, "function", 1, None, None, "Says much more here."), (2, "add", "method", 900, None, None, None),
    ]
    e = spark.createDataFrame(entities, "file_id int, name string, type string, line_start int, signature string, raw_code string, docstring string").withColumns({"language": F.lit("clash"), "content": F.lit("clash"), "documentation": F.lit(0)})
    f = spark.createDataFrame(files, "file_id int, file_path string, content string").withColumn("entities", F.lit("clash"))
    every = {(r.file_id, r.name, r.line_start): r for r in paired(e, f, only_documented=False).collect()}
    assert len(every) == 9 and every[3, "Sum", 6].documentation == "Sum adds two numbers up."
    good = {(r.file_id, r.name) for r in paired(e, f).collect()}
    assert good == {(1, "f"), (1, "h"), (3, "Sum"), (4, "z"), (9, "gone")}
    assert every[1, "f", 6].code.startswith("    def f(") and every[2, "add", 11].documentation == "Adds { up."
    assert paired(e.limit(0), f).count() == 0 and paired(e, f.limit(0)).count() == 2


def test_annotations_over_several_lines():
    source = """class A {
  /** Counts what is left. */
  @Foo(
    a = {"x;", "y"},
    b = 3 // why)
  )
  @Bar @Baz("q")
  int run(int a) { return 1; }
  int x = 3;
  @Three("a")
  void four() {}
}
"""
    assert [(i.name, i.doc) for i in islands(source, "java")] == [("run", "Counts what is left."), ("four", None)]
