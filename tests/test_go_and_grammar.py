"""Go generics and bodiless functions, Python's soft ``case``, Java syntax errors."""

from codeloom.operators.analysis import analyse
from tests.conftest import files_df


def _rec(spark, rows):
    return {r.file_path: r for r in analyse(files_df(spark, rows)).collect()}


GO = """package main

func Map[K comparable, V any](m map[K]V, f func(K) V) []V {
\tfor k := range m { if k != nil { f(k) } }
\treturn nil
}

func asm(a int) int
func asm2[T any](
\ta T,
) (b int, err error)

var v = []int{1, 2}
var w = map[string]struct{}{}

func multi(
\ta int,
\tb string,
) (x struct{ y int }, err error) {
\treturn
}

func (s *Stack[T]) Push(x T) {}

type Pair[K comparable, V any] struct {
\tKey K
\tVal V
}

type Arr [8]struct {
\tx int
}

type (
\tBox[T interface{ ~int | ~string }] struct {
\t\tItem T
\t}
\tPlain struct {
\t\ta, b int
\t}
)

type Named[T ~int] []T
"""


def test_go_generics_and_bodiless(spark):
    g = _rec(spark, [("g.go", "go", GO)])["g.go"]
    assert [f.name for f in g.functions] == ["Map", "multi"]
    m = g.functions[0]
    assert m.parameters == ["m: interface{}", "f: interface{}"] and m.complexity == 3
    assert (m.position.start_line, m.position.start_column, m.position.end_column) == (2, 5, 8)
    assert m.body_text.startswith("{\n\tfor k") and m.body_text.endswith("return nil\n}")
    assert g.functions[1].parameters == ["a: int", "b: string"] and g.functions[1].body_text == "{\n\treturn\n}"
    assert [(s.name, [f.name for f in s.fields]) for s in g.structs] == [("Pair", ["Key", "Val"]), ("Box", ["Item"]), ("Plain", ["b"])]
    assert g.structs[0].body_text == "Pair[K comparable, V any] struct {\n\tKey K\n\tVal V\n}"
    spans = {s.name: (s.start_line, s.end_line) for s in g.function_spans}
    assert spans == {"Map": (2, 5), "multi": (15, 20)}
    # functions 3 and 1, five type declarations of 1 (the group is one)
    assert abs(g.metrics.average_complexity - (3 + 1 + 4) / 6) < 1e-9


PY = """def f(x):
    match x:
        case 1:
            return 1
        case [a, b] if a:
            match a:
                case 2:
                    case = 3
                    case(1)
                case _:
                    pass
        case _:
            return 2
    return 0

def g(case):
    case = 1
    case(1)
    case[0] = 2
    match = case
    match(case)
    return case

class K:
    def h(self, y):
        match y:
            # a comment
            case "a" | "b": return 1
            case {"k": v}:
                if v:
                    return 2

    def i(self, match):
        if match:
            case = 2
        return case

match z:
    case 1: pass
"""


def test_soft_case(spark):
    r = _rec(spark, [("c.py", "python", PY), ("crlf.py", "python", PY.replace("\n", "\r\n"))])
    for p in r.values():
        # f: five clauses and an if; g: none; h: two clauses and an if; i: an if
        assert {x.name: x.complexity for x in p.functions} == {"f": 7, "g": 1, "h": 4, "i": 2}
        assert {c.name: c.complexity for c in p.classes} == {"K": 5}


VALID = '''package a.b;
import java.util.*;
import static java.lang.Math.*;
@Deprecated(since = "1", forRemoval = true)
public sealed interface Shape<T extends Comparable<? super T> & Runnable> permits Circle, Square {}
enum Color { RED(1), GREEN(2,3) { int x() { return 1; } }, ; Color(int... v) {} }
record Point(int x, int y) { Point { if (x < 0) throw new IllegalArgumentException("x"); } }
@interface Note { String value() default "x"; int[] n() default {1, 2,}; int k() default 5; }
class A<T> extends B<List<Map<String, ?>>> implements C, D {
    static final double D1 = 1., D2 = .5, D3 = 1.e3, D4 = 0x1.8p-3, D5 = 1_000.5f;
    int[][] grid = new int[3][], more[] = {{1}, {2,},};
    char q = '\\'', r = '"';
    String text = """
        if (x = ; ) { "quoted" ( [
        """;
    { i++; --j; a[i++] = b[--j]; }
    <R> R gen(Function<? super T, ? extends R> f, T... xs) throws E, F {
        for (;;) { break; }
        for (int i = 0, n = 3; i < n; ) { i++; }
        for (final var x : xs) continue;
        label: while (true) { if (a) break label; else if (b) continue label; else return null; }
        Runnable w = () -> {}; Supplier<String[]> s = String[]::new; var z = x -> -x;
        BiFunction<Integer, Integer, Integer> add = (a, b) -> a + b;
        Object o = (Object & Runnable) (Runnable) () -> System.out.println("hi" + 1 + 'c');
        int y = switch (k) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> -1; };
        String d = switch (o) { case String t when "a".equals(t) -> "s"; case null, default -> "n"; };
        if (!(o instanceof String str && str.length() > 0)) { return (R) o; }
        boolean v = "a" instanceof String ? true : !false;
        try (var in = open(); var out = open()) { } catch (A | B e) { throw e; } finally { ; }
        do { x <<= 1; x >>>= 2; x = ~x ^ y % 2; } while (x != 0);
        synchronized (this) { assert x > 0 : "no"; }
        List<int[]> l = new ArrayList<>(); Class<?> c = int[].class, e = A.class;
        A<T>.Inner inner = outer.new Inner() { void m() {} };
        int[] arr = {}; long h = 0xFFL, g = 0b1010, oct = 017;
        Foo.<String>bar().baz()[0].q = (byte) +1;
        switch (x) { case 'a': case 'b': foo(); break; default: ; }
        return null;
    }
    abstract int area(); native void n(int[] a, @Nullable final String... b);
}
'''
BROKEN = ["int x = ;", "foo(a, );", "int[] a = new int[;", "return = 3;", "x = a + ;", "if () { }", "if a > 0 { }", "String s = \"a\" \"b\";",
          "int y = 1 int z = 2;", "a.;", "foo(;", "foo(]);", "int k = (a] + [b);", "class { }", "x = y 5;", "b = a & ;", "for i = 0; { }", "throw , e;"]


def test_java_syntax_errors_take_the_fallback(spark):
    rows = [("ok.java", "java", VALID), ("ok_crlf.java", "java", VALID.replace("\n", "\r\n"))]
    for i, b in enumerate(BROKEN):
        rows.append((f"bad{i}.java", "java", "class Bad {\n    void run(int a) {\n        " + b + "\n    }\n}\n"))
    r = _rec(spark, rows)
    assert {p: x.parser_used for p, x in r.items() if p.startswith("ok")} == {"ok.java": "tree-sitter", "ok_crlf.java": "tree-sitter"}
    assert [BROKEN[i] for i in range(len(BROKEN)) if r[f"bad{i}.java"].parser_used != "regex"] == []
    assert all([f.name for f in r[f"bad{i}.java"].functions] == ["run"] for i in range(len(BROKEN)) if "{ }" not in BROKEN[i])
