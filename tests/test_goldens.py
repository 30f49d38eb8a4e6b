"""Golden values of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import code, text as fn, vector
from palimpsest.operators import cluster


def test_lock_hash_goldens():
    goldens = {"": -1477818771, "a": 1075015857, "ab": 1718550461, "abc": -785388649, "abcd": -393934804, "abcde": -445659580}
    assert {k: fn.lock_hash(k.encode()) for k in goldens} == goldens
    assert fn.lock_hash(b"rust11111111-1111-1111-1111-111111111111") == -648330360


def test_tokenize_identifier(spark):
    names = ["parseConfigFile", "read_uncompressed_blob", "HTMLParser", "build_AST_node", "a-b.c/d:e f", ""]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", fn.tokenize_identifier(F.col("n")).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == [["parse", "config", "file"], ["read", "uncompressed", "blob"], ["html", "parser"], ["build", "ast", "node"], list("abcdef"), []]


def _identifier_words(name):
    """The rule sign by sign, to hold the expression against."""
    out, now = [], ""
    for i, c in enumerate(name):
        if c in "_-./: ":
            out, now = out + [now], ""
        else:
            if c.isupper() and now and ((i and name[i - 1].islower()) or (i + 1 < len(name) and name[i + 1].islower() and len(now) > 1)):
                out, now = out + [now], ""
            now += c
    return [t.lower() for t in out + [now] if t]


def test_tokenize_identifier_against_rule(spark):
    import itertools

    names = ["".join(p) for n in range(1, 7) for p in itertools.product("aB_1"[: 4 if n < 6 else 3], repeat=n)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", fn.tokenize_identifier(F.col("n")).alias("t")).collect()
    assert [(r.n, r.t) for r in rows if r.t != _identifier_words(r.n)] == []


def test_content_id(spark):
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    rows = spark.createDataFrame([(empty, 0), (empty, 262143), (empty, 262144)], "h string, s int").select(fn.content_id(F.col("h"), F.col("s")).alias("c")).collect()
    assert rows[0].c == "bafkreihdwdcefgh4dqkjv67uzcmw7ojee6xedzdetojuzjevtenxquvyku"
    assert rows[1].c is not None and rows[2].c is None
    with pytest.raises(Exception, match="not a SHA-256"):
        spark.createDataFrame([("xyz", 1)], "h string, s int").select(fn.content_id(F.col("h"), F.col("s"))).collect()


def test_languages(spark):
    names = {"main.rs": "rust", "script.py": "python", "index.js": "javascript", "app.tsx": "typescript", "server.go": "go", "config.json": "json", "notes.md": None, "go": "go"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", fn.detect_language(F.col("n")).alias("l")).collect()
    assert {r.n: r.l for r in rows} == names


def test_syntax():
    assert code.syntax_error("fn broken( {", "rust")
    assert "Mismatched" in code.syntax_error("fn broken() { let x = [1, 2); }", "rust")
    assert code.syntax_error('{"key": unquoted_value}', "json")
    assert code.syntax_error('{"key": [1, 2]}', "json") is None
    assert code.syntax_error('fn f() { let s = "}"; /* ) */ } // ]', "rust") is None
    assert code.syntax_error("def f():\n    # )\n    return 'a\nb'\n", "python") is None
    assert "Unclosed string" in code.syntax_error('let a = "x\n";', "rust")
    assert "Unclosed block comment" in code.syntax_error("/* x", "rust")


RUST = "pub fn calculate_hash(x: u8) -> u8 {\n    x\n}\nstruct UserRecord {\n    a: u8,\n}\nenum Status {\n    On,\n}\ntrait Processor {\n    fn run(&self);\n}\nimpl Processor for UserRecord {\n    fn run(&self) {}\n}\n"


def test_blocks():
    assert [b[:2] for b in code.find_blocks(RUST, "rust")] == [("function", "calculate_hash"), ("struct", "UserRecord"), ("enum", "Status"), ("trait", "Processor"), ("impl", "Processor")]
    assert [b[2:4] for b in code.find_blocks(RUST, "rust")][:2] == [(1, 3), (4, 6)]
    python = "def process_item(x):\n    return x\n\nclass ItemManager:\n    def __init__(self):\n        pass\n"
    assert [b[:2] for b in code.find_blocks(python, "python", general=True)] == [("function", "process_item"), ("class", "ItemManager")]
    assert code.find_blocks("function go() {}", "lua", general=True)[0][1] == "go"
    assert code.find_blocks("", "rust") == []


def test_symbols():
    source = '/// @id: 11111111-2222-3333-4444-555555555555\n/// Adds.\n#[inline]\npub fn add() {}\n\npub(crate) struct S;\n#[cfg(test)]\nmod tests {\n    pub fn hidden() {}\n}\nimpl<T> Shape for Box<T> {\n}\n/* pub fn no() {} */\n'
    assert code.find_symbols(source) == [
        ("function", "add", 4, "11111111-2222-3333-4444-555555555555", "Adds."),
        ("struct", "S", 6, None, None),
        ("impl_block", "Box", 11, None, None),
    ]


def test_symbols_past_strings_generics_and_attributes():
    source = (
        '/// Not this one.\n#[derive(Debug)]\n/// @id: zz111111-2222-3333-4444-555555555555\n/// @id: 21111111-2222-3333-4444-555555555555\n/// Said.\n#[cfg(\n    any(a, b)\n)]\n'
        'pub(in crate::x) async unsafe extern "C" fn f<T>() {\n    let s = "}\\" pub fn no() {";\n    let r = r#"\npub fn raw() {}"#;\n    let c = \'{\';\n}\n'
        "/// Lost.\n\npub unsafe trait T<'a> {}\n  pub const fn k() {}\nfn private() {} pub fn inline() {}\n"
        "unsafe impl<F: Fn(u8) -> u8, T> crate::a::B<F>\n    for\n    Vec<T>\nwhere\n    T: Copy,\n{\n    /// Inner.\n    pub fn inner(&self) {}\n}\nimpl Plain {}\nimpl Trait;\n"
        '#[cfg(test)]\n#[allow(x)]\nmod tests {\n    const S: &str = "}";\n    pub fn hidden() {}\n}\n/* a\npub enum No {} */\npub enum E { A }\n'
    )
    mine = "21111111-2222-3333-4444-555555555555"
    assert [(k, n, i, d) for k, n, _, i, d in code.find_symbols(source)] == [
        ("function", "f", mine, "Said."),
        ("trait", "T", None, None),
        ("function", "k", None, None),
        ("impl_block", "Vec", None, None),
        ("function", "inner", None, "Inner."),
        ("impl_block", "Plain", None, None),
        ("enum", "E", None, None),
    ]
    assert all(source.split("\n")[line - 1].split()[0] in ("pub", "pub(in", "unsafe", "impl") for _, _, line, _, _ in code.find_symbols(source))


def test_noise_vector():
    v = fn.noise_vector("hello", 1024)
    assert len(v) == 1024 and abs(float((v.astype(float) ** 2).sum()) - 1) < 1e-4
    assert (v == fn.noise_vector("hello", 1024)).all() and (v != fn.noise_vector("other", 1024)).any()


def test_welford():
    c = cluster.Cluster(np.array([1, 2], dtype=np.float32), 0.0, 1)
    c.add(np.array([3, 4], dtype=np.float32))
    c.add(np.array([5, 6], dtype=np.float32))
    assert c.count == 3 and np.allclose(c.mean, [3, 4], atol=1e-5) and math.isclose(c.m2, 16, abs_tol=1e-5) and math.isclose(c.variance, 8, abs_tol=1e-5)
    assert cluster.Cluster(np.zeros(2), 0.0, 1).variance == 0.0


def test_split():
    points = np.array([[1, 0, 0], [0.9, 0.1, 0], [0, 1, 0], [0, 0.9, 0.1]], dtype=np.float32)
    a, b = cluster.split_in_two(list("abcd"), points)
    assert a.count and b.count and a.count + b.count == 4
    same = np.full((2, 3), 0.5, dtype=np.float32)
    a, b = cluster.split_in_two(list("ab"), same)
    assert (a.count, b.count, a.m2, b.m2) == (1, 1, 0.0, 0.0) and (a.mean == b.mean).all()
    with pytest.raises(ValueError):
        cluster.split_in_two(["a"], points[:1])


def test_combine():
    made = cluster.combine(cluster.Cluster(np.array([1, 2], np.float32), 0.0, 1), cluster.Cluster(np.array([3, 4], np.float32), 0.0, 1))
    assert made.count == 2 and np.allclose(made.mean, [2, 3]) and math.isclose(made.m2, 4.0)


def test_vectors(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], [])]
    got = spark.createDataFrame(rows, "a array<float>, b array<float>").select(vector.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [1.0, 2.0, 1.0, 1.0, 1.0, 1.0]
    text = spark.createDataFrame([([0.5, -1.25],)], "a array<float>").select(vector.parse_vector(vector.format_vector(F.col("a"))).alias("v")).first().v
    assert text == [0.5, -1.25]


def test_json_contains(spark):
    data = '{"a": {"b": 1, "c": [1, 2]}, "d": "x"}'
    df = spark.createDataFrame([(data,), ("not json",), (None,)], "j string")
    cases = [({}, [True, False, False]), ({"a": {"b": 1}}, [True, False, False]), ({"a": {"c": [1]}}, [False] * 3), ({"a": {"c": [1, 2]}}, [True, False, False]), ({"d": "y"}, [False] * 3)]
    for wanted, expected in cases:
        assert [r[0] for r in df.select(fn.json_contains(F.col("j"), wanted)).collect()] == expected, wanted


def test_json_strings_and_search_text(spark):
    df = spark.createDataFrame([(bytearray(b"plain"), "{}"), (bytearray(b"\xff\xfe"), '{"b": "two", "a": ["one", 1]}'), (None, "broken")], "d binary, j string")
    assert [r[0] for r in df.select(fn.search_text(F.col("d"), F.col("j"))).collect()] == ["plain", "one two", None]


def test_marker_names(spark):
    h = "a" * 64
    df = spark.createDataFrame([(f"{7:020d}_{h}.json",), ("7_x.json",)], "n string")
    seq, mark = fn.parse_marker_name(F.col("n"))
    assert [tuple(r) for r in df.select(seq, mark).collect()] == [(7, h), (None, None)]


def test_paths_and_impl(spark):
    df = spark.createDataFrame([("impl<T: X> Show for Wide<T> {", "C:\\x\\crates\\core\\src\\a.rs")], "h string, p string")
    row = df.select(fn.impl_target(F.col("h")), fn.normalize_path(F.col("p")), fn.crate_of(F.col("p"))).first()
    assert tuple(row) == ("Wide", "crates/core/src/a.rs", "core")
