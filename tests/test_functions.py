import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import value
from tessera.functions import glob as globs
from tessera.functions import language as lang
from tessera.functions import pdf
from tessera.functions import text as T
from tessera.functions import vector as V


def each(spark, f, xs):
    return [r["v"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("text,want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\r\n", ["a", "b"]), ("\n", [""]), ("a\n\nb", ["a", "", "b"]), ("a\r", ["a\r"])])
def test_lines(spark, text, want):
    assert value(spark, T.lines(F.col("x")), x=text) == want


def test_tokens(spark):
    assert value(spark, T.tokens(F.col("x")), x="Tool::new(x_1) Été " + "a" * 40) == ["tool", "new", "x", "1", "été"]
    assert value(spark, T.space_tokens(F.col("x")), x="  A\tb\u00a0C \n") == ["a", "b", "c"]
    assert value(spark, T.identifiers(F.col("x")), x="éa foo_1 2b _x") == ["foo_1", "_x"]


def test_extension_and_paths(spark):
    assert each(spark, T.extension, ["a/b.rs", "a.b/c", ".env", ".a.env", "x.tar.gz", ""]) == ["rs", None, None, "env", "gz", None]
    assert value(spark, T.relative_path(F.col("x"), F.lit("/r/")), x="/r/a/b") == "a/b"
    assert value(spark, T.relative_path(F.col("x"), F.lit("/r")), x="/rr/a") == "/rr/a"
    assert value(spark, T.root_key(F.col("x")), x="/r") == hashlib.sha256(b"/r").hexdigest()[:16]
    assert value(spark, T.content_hash(F.col("x")), x="") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_text_test(spark):
    xs = ["a" * 70 + "\0" * 30, "a" * 71 + "\0" * 29, "a\0", "Line 1\nLine 2\r\nTabbed\ttext", ""]
    assert each(spark, T.looks_like_text, xs) == [False, True, False, True, False]


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aé€😀\n", max_size=12), min_size=1, max_size=20), st.integers(4, 12))
def test_cut_bytes_never_splits_characters(spark, texts, most):
    got = each(spark, lambda c: T.cut_bytes(c, most, "..."), texts)
    for t, g in zip(texts, got):
        raw = t.encode()
        assert g == (t if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "...")


def test_signature(spark):
    assert value(spark, T.signature(F.col("x")), x="  fn a() {\n  b\n}") == "fn a() {"
    assert value(spark, T.signature(F.col("x")), x="a" * 201) == "a" * 200 + "..."


@pytest.mark.parametrize(
    "patterns,yes,no",
    [
        (["lib/**"], ["/project/lib/utils.ts", "lib/nested/file.rs", "/lib/file.rs"], ["/project/src/main.rs"]),
        (["**/*.ts"], ["/project/src/main.ts", "lib/utils.ts"], ["/project/src/main.rs"]),
        (["lib/**", "**/*.tsx"], ["/project/lib/utils.ts", "/project/src/Component.tsx"], ["/project/src/main.rs"]),
        (["src/components/**/*.ts"], ["/project/src/components/Button.ts"], ["/project/lib/utils.ts"]),
        (["[invalid"], ["/path/[invalid/file.rs"], ["/path/valid/file.rs"]),
        (["**/test.rs"], ["/project/src/test.rs", "test.rs"], ["/project/src/main.rs"]),
        (["*.{rs,py}"], ["a/b.rs", "c.py"], ["d.go"]),
        (["src/?[!a]*.c"], ["src/xbz.c"], ["src/xaz.c"]),
    ],
)
def test_globs(spark, patterns, yes, no):
    assert each(spark, lambda c: globs.matches_any(c, patterns), yes + no) == [True] * len(yes) + [False] * len(no)


def test_no_globs_fit_everything(spark):
    assert value(spark, globs.matches_any(F.col("x"), []), x="anything")


def test_include_exclude(spark):
    paths = ["/a/src.rs", "/a/src_test.rs", "/a/b.txt"]
    assert each(spark, lambda c: globs.included(c, [".rs"], ["test"]), paths) == [True, False, False]
    assert each(spark, lambda c: globs.included(c, ["*.rs"], ["**/src_*"]), paths) == [True, False, False]


def test_languages(spark):
    assert each(spark, lang.language_of, ["rs", "mjs", "tsx", "jsx", "cc", "hpp", "kts", "bash", "sass", "cfg", "env", "asciidoc", "org", "TOML", "xyz", ""]) == [
        "Rust", "JavaScript", "TypeScript (TSX)", "JavaScript (JSX)", "C++", "C/C++ Header", "Kotlin", "Shell", "SCSS", "Config", "Environment", "AsciiDoc", "Org Mode", "TOML", None, None,
    ]


def test_kinds(spark):
    assert each(spark, lang.symbol_kind, ["function_item", "impl_item", "type_item", "what"]) == ["function", "class", "type_alias", "unknown"]
    assert each(spark, lang.display_name, ["enum_variant"]) == ["enum variant"]
    assert each(spark, lang.visibility, ["pub fn foo", "public void bar", "protected int x", "fn private_func"]) == ["public", "public", "protected", "private"]


@pytest.mark.parametrize(
    "line,name,want",
    [
        ('let result = greet("World");', "greet", "call"),
        ("counter = counter + 1", "counter", "write"),
        ("from mymodule import greet", "greet", "import"),
        ("let person = new Person()", "Person", "instantiation"),
        ("class A extends B {", "B", "inheritance"),
        ("let x: Foo = y", "Foo", "write"),
        ("fn f(a: Foo)", "Foo", "type_reference"),
        ("if a == b", "a", "read"),
    ],
)
def test_reference_kinds(spark, line, name, want):
    at = line.index(name)
    got = value(spark, lang.reference_kind(F.col("l"), F.col("b"), F.col("a")), l=line, b=line[:at], a=line[at + len(name) :])
    assert got == want


def test_pdf_lines(spark):
    assert each(spark, pdf.is_table_row, ["Column1  Column2  Column3", "Name\tAge\tCity", "This is a normal sentence", "Only two"]) == [True, True, False, False]
    assert value(spark, pdf.table_row(F.col("x")), x="Name  Age  City") == "| Name | Age | City |"
    assert value(spark, pdf.table_separator(F.col("x")), x="Name  Age  City") == "| --- | --- | --- |"
    assert each(spark, pdf.is_heading, ["INTRODUCTION", "Chapter 1:", "Section Title:", "This is a normal sentence", "https://example.com"]) == [True, True, True, False, False]


def test_pdf_markdown(spark):
    got = value(spark, pdf.markdown(F.col("x")), x="INTRODUCTION\n\nThis is some text.\n\nSection 1:\nMore text here.")
    assert got == "## INTRODUCTION\n\n\nThis is some text.\n\n## Section 1\n\nMore text here.\n"
    got = value(spark, pdf.markdown(F.col("x")), x="a  b  c\nd  e  f\nend of it")
    assert got == "| a | b | c |\n| --- | --- | --- |\n| d | e | f |\n\nend of it\n"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<float>, b array<float>")
    row = df.select(V.squared_l2(F.col("a"), F.col("b")).alias("d"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0))).alias("z")).head()
    assert row["d"] == 8.0 and row["c"] == pytest.approx(11 / (5**0.5 * 5)) and row["z"] is None
