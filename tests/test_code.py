"""The source parser and its measures on own snippets; expected values by hand."""

import pytest

from riskframe.code import lexer, measures
from riskframe.sources import code


def of(body, head="fn f(a: bool)"):
    (one,) = measures.functions(f"{head} {{\n{body}\n}}\n")
    return one


@pytest.mark.parametrize(
    ("body", "decisions", "tries"),
    [
        ("", 0, 0),
        ("if a { b() } else if c { d() } else { e() }", 2, 0),
        ("for x in 0..=n { while y < 3 { loop { break; } } }", 3, 0),
        ("match x { Some(1 | 2) if a && b => 1, None => 2, _ => { 3 } }", 4, 0),
        ("let v = read()?.parse::<Vec<Vec<u8>>>()?;", 0, 2),
        ("let f = |x: u8| if x > 1 { 2 } else { 3 }; let g = || a || b;", 0, 0),
        ("fn inner() { if a {} } struct S { x: u8 } const N: u8 = 3;", 0, 0),
        ('println!("{}", if a { 1 } else { 2 }); vec![if a {1} else {2}];', 0, 0),
        ("if let Some(x) = y && z || w { }", 3, 0),
        ("let Some(x) = y else { return };", 0, 0),
        ("let c = 'a'; let s = r#\"if \" || \"#; 'out: loop { break 'out; } /* if /* x */ */ // while", 1, 0),
        ("let p = Point { x: 1, y: if a { 1 } else { 2 }, ..old }; if x == (Y { z: 1 }) { }", 2, 0),
        ("if a < b as usize { } match x { A => {} B { .. } => return, C(..) => y = 3 }", 4, 0),
        ("async { if a {} }; unsafe { x() }; a & b | c; &&x; x..; ..=y", 1, 0),
    ],
)
def test_decisions(body, decisions, tries):
    got = of(body)
    assert (got["decisions"], got["tries"]) == (decisions, tries)


def test_names_and_lines():
    text = """
struct S<T>(T);
impl<T: Fn(u8) -> bool> S<T> where T: Clone {
    pub async fn one(&self) -> Vec<T> { todo!() }
    #[test]
    fn skipped() {}
}
impl fmt::Display for crate::a::Name<'_> { fn fmt(&self) {} }
impl dyn Other { fn plain() {} }
trait Tr { fn need(&self); fn given(&self) { } }
mod m { fn deep() {
  fn nested() { }
} }
#[cfg(test)]
mod tests { fn gone() {} }
#[cfg(any(test))]
mod kept { #[tokio::test] fn stays() {} }
extern "C" { fn c(); }
"""
    got = measures.functions(text)
    assert [(f["name"], f["start_line"], f["end_line"]) for f in got] == [("S::one", 4, 4), ("Name::fmt", 8, 8), ("plain", 9, 9), ("Tr::given", 10, 10), ("deep", 11, 13), ("stays", 17, 17)]
    assert [f["name"] for f in measures.shapes(text)] == ["one", "fmt", "plain", "given", "deep", "nested", "stays"]


def test_signals():
    got = of(
        """if a {
  if b && c || d { x.unwrap(); }
} else if e { y.expect("no") } else { z.expect(1, 2); }
let v = items.iter().map(|i| if i { 1 } else { 2 }).unwrap_or(3);
while p && (q || r) && s { panic!("x"); }
dbg!(v); unimplemented!();
let Some(k) = v else { if a { return } };"""
    )
    assert got["signals"] == {"nesting": 2, "lines": 9, "bumps": 3, "bool_ops": 3, "stubs": 2, "panics": 3}
    assert got["spans"]["nesting"] == [(2, 4)] and got["spans"]["bool_ops"] == [(6, 6)]
    assert got["spans"]["panics"] == [(3, 3), (4, 4), (6, 6)]


def test_shapes_forget_names_and_values_only():
    one, two, three, four = (measures.shapes(f"fn f(x: u8) {{ {b} }}")[0] for b in ("let a = b + 1; if a > 2 { g(a) }", "let q = r + 7; if q > 9 { h(q) }", "let a = b - 1; if a > 2 { g(a) }", 'let a = b + "s"; if a > 2 { g(a) }'))
    assert one["shapes"] == two["shapes"] and one["node_count"] == two["node_count"]
    assert one["shapes"] != three["shapes"] and one["shapes"] != four["shapes"]


@pytest.mark.parametrize("text", ["fn f( {", "fn f() { if }", "fn f() { let x = ; }", 'fn f() { "open }', "/* open", "fn f() { a b }"])
def test_bad_text_is_an_error(text):
    with pytest.raises(lexer.CodeError):
        measures.functions(text)


def test_files(spark, tmp_path):
    for name, text in {"a/x.rs": "fn f() { g()?; }", "a/.hidden/y.rs": "fn no() {}", "b.rs": "fn broken( {", "skip/z.rs": "fn no() {}", "note.txt": "fn"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = code.parsed(code.walk(spark, str(tmp_path), ["skip/**"]))
    assert [(r["file"], r["name"], r["cc"]) for r in code.functions(found, 0.5).collect()] == [("a/x.rs", "f", 1.5)]
    assert [r["file"] for r in code.warnings(found).collect()] == ["b.rs"]


def test_a_long_file_is_held_by_the_item():
    """Neither its tokens nor its trees stay: memory is that of an item, also inside of a module."""
    import tracemalloc

    peaks = []
    for n in (200, 4000):
        text = "mod m {\n" + "fn f(a: bool) { if a && b { c.unwrap(); } }\n" * n + "}\nfn last() {}\n"
        seen = []
        tracemalloc.start()
        measures.each(text, measures.function_rows, lambda f, seen=seen: seen.append((f["name"], f["start_line"])))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(seen) == n + 1 and seen[-2:] == [("f", n + 1), ("last", n + 3)]
    assert peaks[1] < 2 * peaks[0] + 1e6


def test_errors_of_a_long_text_are_those_of_the_whole():
    """A bad token is told before a bad item above it, and a file that fails at its end has no functions."""
    with pytest.raises(lexer.CodeError, match="line 3003: the comment does not end"):
        measures.functions("fn f() { if }\n" + "fn g() {}\n" * 3000 + "\n/* open")
    with pytest.raises(lexer.CodeError, match="line 3001"):
        measures.functions("fn f() {}\n" * 3000 + "fn g( {")


def test_pieces_of_a_long_file(spark):
    text = "".join(f"fn f{k}() {{ {'if a {} ' * (k % 3)}}}\n" for k in range(2500))
    files = spark.createDataFrame([("a.rs", text), ("b.rs", text + "fn broken( {"), ("c.rs", ""), ("d.rs", "fn d() {}")], "file string, text string").coalesce(1)
    found = code.parsed(files)
    got = [(r["file"], r["name"], r["cc"]) for r in code.functions(found).orderBy("ord").collect()]
    assert got == [("a.rs", f"f{k}", 1.0 + k % 3) for k in range(2500)] + [("d.rs", "d", 1.0)]
    assert max(r["n"] for r in found.selectExpr("size(found) AS n").collect()) <= 1000
    assert [r["file"] for r in code.warnings(found).collect()] == ["b.rs"]
