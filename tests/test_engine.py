import io
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import __main__ as server
from tessera.client import Engine, Token
from tessera.config import Config
from tessera.embedding import HashingEmbedder, embed, named
from tessera.errors import Cancelled, IndexDirty, StoreError, ValidationError
from tessera.prompts import PROMPTS, render
from tessera.requests import AdvancedSearchRequest, FindDefinitionRequest, FindReferencesRequest, GetCallGraphRequest, IndexRequest, QueryRequest, SearchGitHistoryRequest
from tessera.store import Store, key_of
from test_sources import repo  # noqa: F401


@pytest.fixture
def engine(spark, tmp_path):
    c = Config()
    c.storage.path = str(tmp_path / "store")
    c.cache.hash_cache_path, c.cache.git_cache_path = str(tmp_path / "h.json"), str(tmp_path / "g.json")
    return Engine(spark, c, HashingEmbedder(64))


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "tree"
    top.mkdir()
    (top / "a.py").write_text("def authenticate(user):\n    return check(user)\n\ndef check(user):\n    return user == 'root'\n")
    (top / "b.rs").write_text("fn parse_tokens() {\n    lexer();\n}\n")
    (top / "c.txt").write_text("notes about the weather\nand the sea\n")
    return top


def test_workflow(engine, tree):
    seen = []
    out = engine.index(IndexRequest(str(tree), project="p"), progress=lambda n, what: seen.append(n))
    assert (out["mode"], out["files_indexed"], out["chunks_created"], out["errors"]) == ("full", 3, 4, []) and seen[0] == 0 and seen[-1] == 100
    got = engine.query(QueryRequest("authenticate user", min_score=0.3))
    assert got["results"][0]["file_path"] == "a.py" and got["results"][0]["keyword_score"] is not None
    assert set(got["results"][0]) == set(Engine.HIT)
    only = engine.query(AdvancedSearchRequest("lexer weather user", min_score=0.0, file_extensions=["rs"]))
    assert {r["file_path"] for r in only["results"]} == {"b.rs"}
    assert {r["language"] for r in engine.query(AdvancedSearchRequest("lexer weather user", min_score=0.0, languages=["Text"]))["results"]} == {"Text"}
    assert {r["file_path"] for r in engine.query(AdvancedSearchRequest("user", min_score=0.0, path_patterns=["*.py"]))["results"]} == {"a.py"}
    assert engine.query(QueryRequest("user", project="other"))["results"] == []
    assert len(engine.query(QueryRequest("user", limit=2, min_score=0.0, hybrid=False))["results"]) == 2
    assert engine.query(QueryRequest("weather", path=str(tree), min_score=0.0))["results"][0]["file_path"] == "c.txt"
    s = engine.statistics()
    assert (s["total_files"], s["total_chunks"]) == (3, 4) and s["language_breakdown"][0] == {"language": "Python", "file_count": 1, "chunk_count": 2} and s["database_size_bytes"] > 0
    # incremental runs
    again = engine.index(IndexRequest(str(tree), project="p"))
    assert (again["mode"], again["files_indexed"], again["files_updated"], again["files_removed"], again["chunks_created"]) == ("incremental", 0, 0, 0, 0)
    (tree / "a.py").write_text("def login():\n    pass\n")
    (tree / "d.md").write_text("# new\n")
    (tree / "c.txt").unlink()
    again = engine.index(IndexRequest(str(tree), project="p"))
    assert (again["files_indexed"], again["files_updated"], again["files_removed"], again["chunks_created"]) == (1, 1, 1, 2)
    assert {r["file_path"] for r in engine.store.chunks().select("file_path").distinct().collect()} == {"a.py", "b.rs", "d.md"}
    assert engine.clear()["success"] and engine.statistics()["total_chunks"] == 0 and not engine.store.knows(str(tree))


def test_empty_folder_and_empty_index(engine, tmp_path):
    (tmp_path / "none").mkdir()
    out = engine.index(IndexRequest(str(tmp_path / "none")))
    assert (out["mode"], out["files_indexed"]) == ("full", 0) and "No code chunks found" in out["errors"][0]
    assert engine.query(QueryRequest("x")) == {"results": [], "duration_ms": 0, "threshold_used": 0.7, "threshold_lowered": False}


def test_dirty_root(engine, tree):
    engine.index(IndexRequest(str(tree)))
    engine.hashes.mark(str(tree))
    with pytest.raises(IndexDirty):
        engine.query(QueryRequest("x", path=str(tree)))
    assert engine.query(QueryRequest("user", min_score=0.0))["results"]
    engine.store.replace(str(tree), engine.store.chunks().where("false"))  # hashes without chunks: broken, so the next run is a full one
    assert engine.store.knows(str(tree)) and engine._dirty_verdict(str(tree), None) == "truly_corrupted"
    assert engine.index(IndexRequest(str(tree)))["mode"] == "full"
    assert engine.hashes.dirty_roots == {}


def test_failed_embeddings_are_tried_again(engine, tree):
    class Flaky(HashingEmbedder):
        def embed(self, texts):
            if any("lexer" in t for t in texts):
                raise RuntimeError("model is away")
            return super().embed(texts)

    good, engine.embedder = engine.embedder, Flaky(64)
    engine.config.embedding.batch_size = 1
    out = engine.index(IndexRequest(str(tree)))
    assert out["errors"] == ["no embedding: b.rs"]
    engine.embedder = good
    out = engine.index(IndexRequest(str(tree)))
    assert (out["mode"], out["files_indexed"], out["errors"]) == ("incremental", 1, [])
    assert engine.store.chunks().where("vector IS NULL").count() == 0 and engine.statistics()["total_chunks"] == 4


def test_cancel(engine, tree):
    token = Token(engine.spark)
    token.cancel()
    with pytest.raises(Cancelled):
        engine.index(IndexRequest(str(tree)), token=token)
    assert str(tree) in engine.hashes.dirty_roots


def test_two_runs_at_once(engine, tree):
    out = []
    runs = [threading.Thread(target=lambda: out.append(engine.index(IndexRequest(str(tree))))) for _ in range(2)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert sorted(o["mode"] for o in out) == ["full", "incremental"] and engine.statistics()["total_files"] == 3


def test_history(engine, repo):  # noqa: F811
    out = engine.search_git_history(SearchGitHistoryRequest("authentication value", str(repo / "inner"), min_score=0.0, max_commits=2))
    assert (out["commits_indexed"], out["total_cached_commits"]) == (2, 2) and out["results"][0]["commit_message"].startswith("Change the authentication")
    assert out["results"][0]["commit_date"] == 1700001000 and "+x = 2" in out["results"][0]["diff_snippet"]
    out = engine.search_git_history(SearchGitHistoryRequest("commit", str(repo), min_score=0.0))
    assert (out["commits_indexed"], out["total_cached_commits"], len(out["results"])) == (1, 3, 3)
    n = lambda **k: len(engine.search_git_history(SearchGitHistoryRequest("commit", str(repo), min_score=0.0, **k))["results"])
    assert (n(since="1700001500"), n(author="^Bob"), n(author="x.org"), n(file_pattern=r"\.py$"), n(limit=1)) == (1, 0, 3, 2, 1)
    assert engine.query(QueryRequest("commit", min_score=0.0))["results"] == []  # history is searched apart


def test_navigation(engine, tree):
    path = str(tree / "a.py")
    assert engine.find_definition(FindDefinitionRequest(path, 2))["definition"]["name"] == "authenticate"
    assert engine.find_definition(FindDefinitionRequest(path, 3))["definition"] is None
    refs = engine.find_references(FindReferencesRequest(path, 4))
    assert (refs["symbol_name"], refs["total_count"]) == ("check", 1) and refs["references"][0]["reference_kind"] == "call" and refs["references"][0]["start_line"] == 2
    graph = engine.get_call_graph(GetCallGraphRequest(path, 1))
    assert [c["name"] for c in graph["callees"]] == ["check"] and graph["callers"] == []
    graph = engine.get_call_graph(GetCallGraphRequest(path, 4, include_callees=False))
    assert [c["name"] for c in graph["callers"]] == ["authenticate"] and graph["callees"] == []


@pytest.mark.parametrize(
    "request_",
    [QueryRequest("  "), QueryRequest("x" * 10_241), QueryRequest("x", limit=1001), QueryRequest("x", min_score=1.1), QueryRequest("x", project=""), QueryRequest("x", project="p" * 257), AdvancedSearchRequest("x", file_extensions=[""]), AdvancedSearchRequest("x", file_extensions=["e" * 21]), AdvancedSearchRequest("x", languages=["l" * 51]), IndexRequest("/no/such/place"), IndexRequest("/", max_file_size=100_000_001), SearchGitHistoryRequest("x", "/no/such"), SearchGitHistoryRequest("x", "/", max_commits=10_001), FindDefinitionRequest("a", 0), FindReferencesRequest("a", 1, limit=10_001), GetCallGraphRequest("a", 1, depth=11), FindDefinitionRequest(" ", 1)],
)
def test_bad_requests(request_):
    with pytest.raises(ValidationError):
        request_.validate()


@pytest.mark.parametrize("request_", [QueryRequest("x", limit=1000, min_score=0.0), QueryRequest("x", limit=0, min_score=1.0), IndexRequest("/", max_file_size=100_000_000), SearchGitHistoryRequest("x", max_commits=10_000), FindReferencesRequest("a", 1, limit=10_000), GetCallGraphRequest("a", 1, depth=10)])
def test_good_requests(request_):
    request_.validate()
    assert type(request_).from_json(request_.to_json()) == request_


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.initialize(2)
    store.initialize(2)
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "s")).initialize(3)

    def rows(root, *files):
        return spark.createDataFrame([(f"{root}{f}{i}", f, root, "p", 1, 1, "Rust", "rs", "h", 0, text, [0.0, 1.0]) for i, (f, text) in enumerate(files)], "chunk_id string, file_path string, root_path string, project string, start_line int, end_line int, language string, extension string, file_hash string, indexed_at long, content string, vector array<float>")

    assert store.append("/a", rows("/a", ("x", "one two"), ("y", "two"))) == 2
    assert store.append("/a", rows("/a", ("x", "")).where("false")) == 0
    assert store.append("/b", rows("/b", ("x", "two"))) == 1
    assert (store.count(), store.count("/a"), sorted(store.roots())) == (3, 2, ["/a", "/b"])
    assert store.postings("/a").where("term = 'two'").count() == 2
    assert store.delete_files("/a", ["x"]) == 1  # the same path under another root stays
    assert {(r["root_path"], r["file_path"]) for r in store.chunks().collect()} == {("/a", "y"), ("/b", "x")}
    assert store.delete_chunks("/a", ["/ay1"]) == 1 and store.count("/a") == 0
    with pytest.raises(StoreError):
        store.append("/c", rows("/c", ("x", "t")).withColumn("vector", F.array(F.lit(1.0).cast("float"))))
    store.flush()
    assert store.term_stats("/b") == (1, 1.0) and store.term_stats("/none") == (0, 0.0)
    # what is deleted and comes back unchanged is there again; many updates in a row are written together
    for n in range(12):
        assert store.update("/b", rows("/b", ("x", "")), rows("/b", ("x", f"two {n // 2}"))) == 1
        assert (store.count("/b"), store.chunks("/b").count()) == (1, 1) and store.postings("/b").where(f"term = '{n // 2}'").count() == 1
    assert len(store._load()["roots"][key_of("/b")]["tombs"]) <= 8 and store.term_stats("/b") == (1, 2.0)
    store.clear_root("/b")
    assert store.count() == 0
    store.clear()
    assert store.chunks().count() == 0 and len(store.chunks().columns) == 12


def test_roots_written_at_once_are_all_kept(spark, tmp_path):
    Store(spark, str(tmp_path / "s")).initialize(1)
    failed = []

    def write(root):
        store = Store(spark, str(tmp_path / "s"), 1)
        rows = spark.createDataFrame([(root, "x", root, "p", 1, 1, "Rust", "rs", "h", 0, "text", [1.0])], "chunk_id string, file_path string, root_path string, project string, start_line int, end_line int, language string, extension string, file_hash string, indexed_at long, content string, vector array<float>")
        try:
            for _ in range(2):
                store.append(root, rows)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(f"/r{k}",)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = Store(spark, str(tmp_path / "s"))
    assert not failed and {r: store.count(r) for r in store.roots()} == {f"/r{k}": 2 for k in range(4)} and store.version == 9


def test_embedder(spark):
    e = HashingEmbedder(32)
    a, b = e.embed(["Some words here", ""])
    assert np.linalg.norm(a) == pytest.approx(1) and not b.any() and (e.embed(["Some words here"])[0] == a).all()
    assert named("BAAI/bge-base-en-v1.5").dimension == 768 and named("what").dimension == 384

    class Broken:
        dimension, name = 2, "broken"

        def embed(self, texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return np.zeros((len(texts), 2), np.float32)

    rows = {r["t"]: r for r in embed(spark.createDataFrame([("a",), ("bad",), (None,)], "t string").coalesce(1), Broken(), "t", 1).collect()}
    assert rows["bad"]["vector"] is None and "RuntimeError" in rows["bad"]["error"] and rows["a"]["vector"] == [0.0, 0.0] and rows[None]["error"] is None


def test_server(engine, tree):
    lines = [{"id": 1, "tool": "index_codebase", "arguments": {"path": str(tree)}}, {"id": 2, "tool": "query_codebase", "arguments": {"query": "user", "min_score": 0.0}}, {"id": 3, "tool": "query_codebase", "arguments": {"query": ""}}, {"id": 4, "tool": "none"}, {"id": 5, "tool": "list"}, {"id": 6, "prompt": "git-search", "arguments": {"query": "q"}}, {"id": 7, "tool": "get_statistics"}]
    out = io.StringIO()
    server.serve(engine, io.StringIO("".join(json.dumps(x) + "\n" for x in lines) + "not json\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert got[0]["result"]["files_indexed"] == 3 and got[1]["result"]["results"] and got[2]["error"]["user_error"] and "error" in got[3] and len(got[4]["result"]["tools"]) == 9 and "'.'" in got[5]["result"] and got[6]["result"]["total_files"] == 3 and "error" in got[7]
    assert server.main(["version"]) == 0
    assert all(render(p) for p in PROMPTS) and len(PROMPTS) == 9


def test_sql_functions(spark):
    from tessera.functions.register import register

    register(spark, HashingEmbedder(8))
    spark.createDataFrame([("py", "def a():\n    pass\n\nclass B:\n    def c(self): pass\n"), ("txt", "x")], "ext string, content string").createOrReplaceTempView("sources")
    rows = spark.sql("SELECT u.kind, u.start_line FROM sources, LATERAL code_units(ext, content) u ORDER BY u.start_line").collect()
    assert [tuple(r) for r in rows] == [("function_definition", 1), ("class_definition", 4), ("function_definition", 5)]
    rows = spark.sql("SELECT d.name, d.kind, d.parent_pre FROM sources, LATERAL code_definitions(ext, content) d ORDER BY d.pre").collect()
    assert [tuple(r) for r in rows] == [("a", "function", -1), ("B", "class", -1), ("c", "function", 1)]
    assert spark.sql("SELECT size(embed(content)) AS n FROM sources").head()["n"] == 8
