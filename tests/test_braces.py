"""The scanner of brace languages: worked examples, and text that is no program."""

import random

import pytest

from cairn.operators import braces

JS = r"""// a comment { function no() {} }
import { a } from './a'
import "side";
export const hidden = 1
const LIMIT = 3, other = `x ${y} }`
let multi = [
  1,
  2
]
const arrow = (x) => {
  return x / 2
}
function show(x) {
  const y = /[{/]/.test(x)
  function inner() { return helper.deep().go(x) }
  return inner()
}
export default async function load() {
  await fetch("u{")
}
class View extends Base {
  count = 0
  static async build(a, b) {
    return new View(a)
  }
  render() { this.draw(1); if (x) { y() } }
  get size(): number { return 1 }
}
export class T<K> { m<V>(x: V): void { z() } }
"""
JAVA = r"""package a.b;
import java.util.List;
import static com.x.Utils.method;
/** doc { */
@Ann("x(")
public class Shop extends Base<String> implements I {
    private static final int LIMIT = 3;
    private List<Integer> rows = new ArrayList<>(), more;
    String s = "}";

    public Shop(int n) {
        super(n);
        this.n = n;
    }

    @Override
    public <T> List<T> sell(int n, String[] a) throws IOException {
        if (n > 0) { return helper.tidy(n).all(); }
        check(n);
        return new Foo(n).bar();
    }
    class Inner { void go() { } }
    interface Q { int size(); }
}
"""
GO = r"""package main

import (
	"fmt"
	x "a/b"
)
import "os"

var Limit = 3
var (
	one = 1
	two = f(2)
)
type Shop struct {
	n int
}
type (
	A struct { x int }
	B int
)
func main() {
	s := Shop{n: 1}
	fmt.Println(s.Sell(2), len("a`"))
	raw := `func no() { \`
	go func() { run() }()
}

func (s *Shop) Sell(n int) (interface{}, error) {
	return tidy(n), nil
}
"""

SYMBOLS = {
    "typescript": [
        ("LIMIT", "variable", 5, 5), ("other", "variable", 5, 5), ("multi", "variable", 6, 9), ("arrow", "variable", 10, 12), ("show", "function", 13, 17),
        ("inner", "function", 15, 15), ("load", "function", 18, 20), ("View", "class", 21, 28), ("build", "function", 23, 25), ("render", "function", 26, 26),
        ("size", "function", 27, 27), ("T", "class", 29, 29), ("m", "function", 29, 29),
    ],
    "java": [
        ("Shop", "class", 5, 24), ("LIMIT", "variable", 7, 7), ("rows", "variable", 8, 8), ("s", "variable", 9, 9), ("Shop", "function", 11, 14),
        ("sell", "function", 16, 21), ("Inner", "class", 22, 22), ("go", "function", 22, 22), ("size", "function", 23, 23),
    ],
    "go": [
        ("Limit", "variable", 9, 9), ("one", "variable", 10, 13), ("two", "variable", 10, 13), ("Shop", "class", 14, 16), ("A", "class", 17, 20),
        ("main", "function", 21, 26), ("Sell", "function", 28, 30),
    ],
}
EDGES = {
    "typescript": [
        ("import", "./a", 2), ("import", "side", 3), ("call", "/[{/]/.test", 14), ("call", "helper.deep", 15), ("call", "helper.deep().go", 15), ("call", "inner", 16),
        ("call", "fetch", 19), ("call", "this.draw", 26), ("call", "y", 26), ("call", "z", 29),
    ],
    "java": [
        ("import", "java.util.List", 2), ("import", "com.x.Utils", 3), ("call", "helper.tidy", 18), ("call", "helper.tidy(n).all", 18), ("call", "check", 19),
        ("call", "new Foo(n).bar", 20),
    ],
    "go": [
        ("import", "a/b", 3), ("import", "fmt", 3), ("import", "os", 7), ("call", "f", 12), ("call", "fmt.Println", 23), ("call", "len", 23), ("call", "s.Sell", 23),
        ("call", "run", 25), ("call", "tidy", 29),
    ],
}
TEXTS = {"typescript": JS, "java": JAVA, "go": GO}


@pytest.mark.parametrize("language", sorted(TEXTS))
def test_worked_examples(spark, language):
    files = spark.createDataFrame([("p", TEXTS[language], language), ("q", None, language), ("r", "x = 1", "cobol")], "path string, content string, language string")
    assert [tuple(r)[2:] for r in braces.parse_symbols_braces(files).orderBy("ord").collect()] == SYMBOLS[language]
    assert [tuple(r)[2:] for r in braces.extract_edges_braces(files).orderBy("ord").collect()] == EDGES[language]


def test_any_text_is_read():
    rng = random.Random(1)
    for _ in range(600):
        language = rng.choice(sorted(TEXTS))
        text = TEXTS[rng.choice(sorted(TEXTS))]
        cut = list(text[rng.randrange(len(text)) :])
        for _ in range(rng.randrange(12)):
            cut.insert(rng.randrange(len(cut) + 1), rng.choice("(){}[]\"'`/\\;\n"))
        source = "".join(cut)
        lines = source.count("\n") + 1
        assert all(1 <= a <= b <= lines for _, k, *_, a, b in braces.symbols("p", source, language) if k >= 0)
        assert all(1 <= line <= lines for *_, line in braces.edges("p", source, language))
