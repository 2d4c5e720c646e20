import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.errors import CacheError, ConfigError, GitError, InvalidValue, ValidationError
from tessera.sources import files, gitlog, ignore, parsing
from tessera.sources.state import GitCache, HashCache


def paths(df):
    return {r["file_path"] for r in df.collect()}


def test_scan(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("ignored.txt\nbuild/\n!keep.log\n")
    (tmp_path / "included.txt").write_text("hello")
    (tmp_path / "ignored.txt").write_text("hello")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfd")
    (tmp_path / "binary.dat").write_bytes(b"a" * 70 + b"\0" * 30)
    (tmp_path / "large.txt").write_text("x" * 2000)
    (tmp_path / "exact.txt").write_text("x" * 1000)
    (tmp_path / "sub" / ".git").mkdir(parents=True)
    (tmp_path / "sub" / ".git" / "config").write_text("no")
    (tmp_path / "sub" / "a.rs").write_text("fn a() {}\n")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "x.txt").write_text("x")
    got = files.scan(spark, str(tmp_path), "p", max_size=1000)
    assert paths(got) == {".gitignore", "included.txt", "exact.txt", "sub/a.rs"}
    row = got.where("file_path = 'sub/a.rs'").head()
    assert (row["extension"], row["language"], row["project"], row["root_path"]) == ("rs", "Rust", "p", str(tmp_path))
    assert paths(files.scan(spark, str(tmp_path), include=[".rs"])) == {"sub/a.rs"}
    assert paths(files.scan(spark, str(tmp_path), exclude=["*.txt"])) == {".gitignore", "sub/a.rs"}
    assert files.single(spark, str(tmp_path / "sub" / "a.rs")).head()["file_path"] == "a.rs"
    assert "included.txt" in paths(files.scan(spark, f"file://{tmp_path}"))
    with pytest.raises(ValidationError):
        files.scan(spark, str(tmp_path / "none"))
    with pytest.raises(ValidationError):
        files.scan(spark, str(tmp_path / "included.txt"))


def test_pdf_extractor_is_pluggable(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF fine")
    (tmp_path / "b.pdf").write_bytes(b"%PDF broken")

    def extract(body: bytes) -> str:
        if b"broken" in body:
            raise ValueError("no")
        return "INTRODUCTION\nText"

    got = files.scan(spark, str(tmp_path), pdf_text=extract).collect()
    assert [(r["file_path"], r["language"], r["content"]) for r in got] == [("a.pdf", "PDF", "## INTRODUCTION\n\nText\n")]


def test_nested_ignore_rules(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / ".gitignore").write_text("*.log\n/top.txt\n# note\n\nsecret?.txt\n**/gen/\n")
    (tmp_path / "a" / ".gitignore").write_text("!keep.log\nb/*.tmp\n")
    (tmp_path / "a" / ".ignore").write_text("other.md\n")
    (tmp_path / "a" / "gen").mkdir()
    for p in ("x.log", "top.txt", "secret1.txt", "a/top.txt", "a/keep.log", "a/y.log", "a/other.md", "a/b/z.tmp", "a/b/z.txt", "a/gen/g.txt"):
        (tmp_path / p).write_text("t")
    assert {p for p, _ in ignore.walk(str(tmp_path), None)} == {".gitignore", "a/.gitignore", "a/.ignore", "a/top.txt", "a/keep.log", "a/b/z.txt"}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    top = tmp_path_factory.mktemp("repo")

    def git(*args, when=None):
        env = {"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(top), "GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "ann@x.org", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "ann@x.org"}
        if when:
            env |= {"GIT_AUTHOR_DATE": f"{when} +0000", "GIT_COMMITTER_DATE": f"{when} +0000"}
        subprocess.run(["git", *args], cwd=top, check=True, capture_output=True, env=env)

    git("init", "-q", "-b", "main")
    (top / "inner").mkdir()
    (top / "inner" / "a.py").write_text("x = 1\n")
    git("add", ".")
    git("commit", "-q", "-m", "First commit\n\nwith a body", when=1700000000)
    (top / "inner" / "a.py").write_text("x = 2\n")
    (top / "é b.txt").write_text("été\n")
    git("add", ".")
    git("commit", "-q", "-m", "Change the authentication value", when=1700001000)
    (top / "big.txt").write_text("line of text\n" * 2000)
    git("add", ".")
    git("commit", "-q", "-m", "Add a big file", when=1700002000)
    return top


def test_commits(spark, repo):
    rows = gitlog.commits(spark, str(repo)).orderBy(F.desc("commit_date")).collect()
    assert [r["message"].splitlines()[0] for r in rows] == ["Add a big file", "Change the authentication value", "First commit"]
    assert rows[2]["message"] == "First commit\n\nwith a body\n" and rows[2]["files_changed"] == ["inner/a.py"] and rows[2]["parent_hashes"] == []
    assert set(rows[1]["files_changed"]) == {"inner/a.py", "é b.txt"} and rows[1]["parent_hashes"] == [rows[2]["hash"]]
    assert "-x = 1\n+x = 2\n" in rows[1]["diff_content"] and "+été" in rows[1]["diff_content"]
    assert rows[0]["diff_content"].endswith("[... diff truncated ...]") and len(rows[0]["diff_content"].encode()) < 8100
    assert (rows[0]["author_name"], rows[0]["author_email"], rows[0]["commit_date"]) == ("Ann", "ann@x.org", 1700002000)
    n = lambda **k: gitlog.commits(spark, str(repo), **k).count()
    assert (n(since=1700001000), n(until=1700001000), n(since=1700001000, until=1700001000), n(most=1), n(branch="main")) == (2, 2, 1, 1, 3)


def test_control_bytes_in_commits(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=A", "-c", "user.email=a@x", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a.txt").write_bytes(b"one\x1etwo\x1fthree\n")
    run("add", ".")
    run("commit", "-q", "-m", "Bytes \x1e and \x1f\x1f in a message")
    (tmp_path / "a.txt").write_bytes(b"other\n")
    run("commit", "-qam", "Next")
    rows = gitlog.commits(spark, str(tmp_path)).collect()
    assert [r["message"] for r in rows] == ["Next\n", "Bytes \x1e and \x1f\x1f in a message\n"]
    assert "+one\x1etwo\x1fthree" in rows[1]["diff_content"] and rows[0]["files_changed"] == rows[1]["files_changed"] == ["a.txt"]


def test_repository(repo, tmp_path):
    assert gitlog.discover(str(repo / "inner" / "a.py")) == str(repo)
    assert gitlog.current_branch(str(repo)) == "main" and gitlog.has_commits(str(repo)) and gitlog.commit_count(str(repo)) == 3
    with pytest.raises(GitError):
        gitlog.discover(str(tmp_path))


def test_hash_cache(tmp_path):
    place = tmp_path / "sub" / "cache.json"
    cache = HashCache.load(place)
    assert cache.roots == {}
    cache.roots["/r"] = {"a": "1"}
    cache.mark("/r", now=1000)
    cache.save(place)
    again = HashCache.load(place)
    assert again.roots == {"/r": {"a": "1"}} and again.dirty_roots["/r"].age(1600) == 600 and again.dirty_roots["/r"].age(10) == 0
    assert not again.dirty_roots["/r"].is_stale(3600, 1000) and again.dirty_roots["/r"].is_stale(0, 1000)
    assert again.clear_stale(3600, 1100) == [] and again.clear_stale(3600, 9000) == ["/r"]
    place.write_text(json.dumps({"roots": {}, "dirty_roots": ["/old"]}))
    assert HashCache.load(place).dirty_roots["/old"].timestamp == 0
    assert isinstance(json.loads(place.read_text())["dirty_roots"], dict)
    place.write_text("{not json")
    with pytest.raises(CacheError):
        HashCache.load(place)


def test_git_cache(tmp_path):
    place = tmp_path / "git.json"
    g = GitCache.load(place)
    g.add("a", {"1"})
    g.add("a", {"1", "2"})
    g.replace("b", {"9"})
    g.save(place)
    g = GitCache.load(place)
    assert (g.count("a"), g.count("none"), g.total(), g.has("a", "2"), g.has("b", "2")) == (2, 0, 3, True, False)
    g.remove("a")
    assert g.total() == 1
    g.clear()
    assert g.total() == 0


def test_config(tmp_path):
    place = tmp_path / "c.toml"
    place.write_text('[search]\nlimit = 5\n[other]\nx = 1\n')
    c = Config.load(place, {"TESSERA_MIN_SCORE": "0.4", "TESSERA_BATCH_SIZE": "many"})
    assert (c.search.limit, c.search.min_score, c.search.hybrid, c.embedding.batch_size) == (5, 0.4, True, 256)
    c.save(tmp_path / "d" / "e.toml")
    assert Config.load(tmp_path / "d" / "e.toml", {}) == c
    with pytest.raises(InvalidValue):
        Config.load(place, {"TESSERA_MIN_SCORE": "1.5"})
    with pytest.raises(InvalidValue):
        Config.load(place, {"TESSERA_LIMIT": "0"})
    with pytest.raises(ConfigError):
        Config.load(tmp_path / "none.toml", {})
    place.write_text("[search\n")
    with pytest.raises(ConfigError):
        Config.load(place, {})


SOURCES = {
    "rs": ("/// Says hello.\n#[inline]\npub fn greet(n: &str) -> String {\n    format!(\"}{\")\n}\n\nimpl Person {\n    fn new() -> Self { Person }\n}\nstruct Person;\nconst MAX: u32 = 3;\nmod tests { fn t() {} }\n", [("function_item", "greet", 3, 5), ("impl_item", "Person", 7, 9), ("function_item", "new", 8, 8), ("struct_item", "Person", 10, 10), ("const_item", "MAX", 11, 11), ("mod_item", "tests", 12, 12), ("function_item", "t", 12, 12)]),
    "py": ("class A:\n    '''Doc.'''\n    @property\n    def f(self):\n        return 1\n\nasync def g(): pass\n", [("class_definition", "A", 1, 5), ("decorated_definition", "f", 3, 5), ("function_definition", "f", 4, 5), ("function_definition", "g", 7, 7)]),
    "js": ("export function a(x) {\n  return () => 1;\n}\nconst b = (y) => {\n  if (y) { return 1; }\n};\nclass C extends D {\n  m(z) { return z; }\n}\n", [("function_declaration", "a", 1, 3), ("arrow_function", "b", 4, 6), ("class_declaration", "C", 7, 9), ("method_definition", "m", 8, 8)]),
    "ts": ("interface I { x: number }\ntype T = string;\nenum E { A }\nclass K { private f(a: number): string { return ''; } }\n", [("interface_declaration", "I", 1, 1), ("type_alias_declaration", "T", 2, 2), ("enum_declaration", "E", 3, 3), ("class_declaration", "K", 4, 4), ("method_definition", "f", 4, 4)]),
    "go": ("package p\n\nfunc F() int {\n\treturn 1\n}\n\nfunc (r *R) M() {}\n\ntype R struct {\n\tx int\n}\n", [("function_declaration", "F", 3, 5), ("method_declaration", "M", 7, 7), ("type_declaration", "R", 9, 11)]),
    "java": ("public class A {\n  A() { }\n  private int f(int x) throws E {\n    return new B(x).g();\n  }\n  enum K { X }\n}\ninterface I { void h(); }\n", [("class_declaration", "A", 1, 7), ("constructor_declaration", "A", 2, 2), ("method_declaration", "f", 3, 5), ("enum_declaration", "K", 6, 6), ("interface_declaration", "I", 8, 8), ("method_declaration", "h", 8, 8)]),
    "c": ("struct P { int x; };\nstatic int add(int a, int b) {\n  return a + b; /* } */\n}\nint proto(void);\n", [("struct_specifier", "P", 1, 1), ("function_definition", "add", 2, 4)]),
    "cpp": ("namespace n {\nclass A : public B {\n  int f() const { return 1; }\n};\n}\nint A::g(int x) {\n}\n", [("namespace_definition", "n", 1, 5), ("class_specifier", "A", 2, 4), ("function_definition", "f", 3, 3), ("function_definition", "A::g", 6, 7)]),
    "rb": ("module M\n  class A\n    def f(x)\n      if x then 1 end\n    end\n    def self.g\n    end\n  end\nend\n", [("module", "M", 1, 9), ("class", "A", 2, 8), ("method", "f", 3, 5), ("singleton_method", "g", 6, 7)]),
    "php": ("<?php\nclass A {\n  public function f($x) { return 1; }\n}\nfunction g() { }\n", [("class_declaration", "A", 2, 4), ("function_definition", "f", 3, 3), ("function_definition", "g", 5, 5)]),
    "swift": ("struct S {\n  init(x: Int) { }\n  func f() -> Int { return 1 }\n}\nprotocol P { }\n", [("struct_declaration", "S", 1, 4), ("init_declaration", "init", 2, 2), ("function_declaration", "f", 3, 3), ("protocol_declaration", "P", 5, 5)]),
    "cs": ("namespace N {\n  public class A {\n    public int F(int x) { return x; }\n  }\n}\n", [("namespace_declaration", "N", 1, 5), ("class_declaration", "A", 2, 4), ("method_declaration", "F", 3, 3)]),
}


@pytest.mark.parametrize("ext", sorted(SOURCES))
def test_units(ext):
    text, want = SOURCES[ext]
    assert [(u.node, u.name, u.start_line, u.end_line) for u in parsing.units(ext, text)] == want


def test_units_of_other_files():
    assert parsing.units(None, "x") == [] == parsing.units("txt", "fn a() {}") == parsing.units("rs", "fn incomplete {") == parsing.units("py", "def (:")


def test_definitions(spark, tmp_path):
    from tessera.sources.definitions import definitions_of

    (tmp_path / "a.rs").write_text(SOURCES["rs"][0])
    rows = {r["name"] + str(r["start_line"]): r for r in definitions_of(files.scan(spark, str(tmp_path))).collect()}
    g = rows["greet3"]
    assert (g["kind"], g["visibility"], g["signature"], g["doc_comment"], g["def_id"]) == ("function", "public", "pub fn greet(n: &str) -> String {", "Says hello.", "def:a.rs:greet:3")
    assert rows["new8"]["parent_id"] == f"a.rs:{rows['Person7']['pre']}" and rows["greet3"]["parent_id"] is None and rows["new8"]["visibility"] == "private"


def test_python_comments():
    from tessera.sources.parsing import definitions

    text = "# says so\n@cached\ndef a():\n    '''inside'''\n\ndef b():\n    '''inside'''\n\nx = 1\ndef c():\n    pass\n"
    assert [(u.name, u.doc) for _, _, u in definitions("py", text) if u.node == "function_definition"] == [("a", "says so"), ("b", "inside"), ("c", None)]
