"""The engine's operations: index, query, filtered search, statistics, clear, history search, and code navigation."""

from __future__ import annotations

import fcntl
import os
import tempfile
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .embedding import Embedder, embed, named
from .errors import Cancelled, IndexDirty, IndexingError
from .functions import glob as globs
from .operators import chunking, fusion, keyword, knn, navigation, snapshot, stats
from .operators import commits as history
from .requests import AdvancedSearchRequest, FindDefinitionRequest, FindReferencesRequest, GetCallGraphRequest, IndexRequest, QueryRequest, Request, SearchGitHistoryRequest
from .sources import files as source
from .sources import gitlog
from .sources.definitions import definitions_of
from .sources.state import GitCache, HashCache
from .store import Store, key_of

Progress = Callable[[int, str], None]


class Token:
    """Cancels the work it is given to: between steps, and running Spark jobs by their group."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.group, self.cancelled = spark, f"index-{id(self)}", False

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobGroup(self.group)

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled("Indexing was cancelled")


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, embedder: Embedder | None = None, pdf_text: Callable[[bytes], str] | None = None) -> None:
        self.spark, self.config = spark, config or Config.load()
        self.embedder = embedder or named(self.config.embedding.model_name)
        self.pdf_text = pdf_text
        self.store = Store(spark, self.config.storage.path)
        self.store.initialize(self.embedder.dimension)
        self.hashes = HashCache.load(self.config.cache.hash_cache_path)
        self.git = GitCache.load(self.config.cache.git_cache_path)

    # ---- indexing ----
    @contextmanager
    def _lock(self, root: str, wait: float = 1800) -> Iterator[None]:
        """One index run a root; another waits, and then finds its work done."""
        folder = Path(tempfile.gettempdir()) / "tessera-locks"
        folder.mkdir(exist_ok=True)
        with open(folder / key_of(root), "w") as handle:
            until = time.monotonic() + wait
            while True:
                try:
                    fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if time.monotonic() > until:
                        raise IndexingError(f"another run has held {root} for {wait:.0f} s") from None
                    time.sleep(0.5)
            yield

    def _chunks(self, files: DataFrame) -> DataFrame:
        cut = chunking.chunk_hybrid(files, self.config.indexing.chunk_size).withColumn("indexed_at", F.unix_timestamp())
        cut = cut.withColumn("language", F.coalesce("language", F.lit("Unknown"))).withColumn("extension", F.coalesce("extension", F.lit("")))
        return embed(cut, self.embedder, "content", self.config.embedding.batch_size)

    def index(self, request: IndexRequest, progress: Progress | None = None, token: Token | None = None, now: float | None = None) -> dict[str, Any]:
        """A full run if the root is new or broken, else an incremental one."""
        request.validate()
        began, tell, token = time.monotonic(), progress or (lambda percent, what: None), token or Token(self.spark)
        root = source.normalise(request.path)
        with self._lock(root):
            self.spark.sparkContext.setJobGroup(token.group, f"index {root}", interruptOnCancel=True)
            verdict = self._dirty_verdict(root, now)
            self.hashes.mark(root, now=now)
            self.hashes.save(self.config.cache.hash_cache_path)
            tell(0, "scan")
            exclude = [*request.exclude_patterns]
            # written once into the store's work folder: hashes, chunks and counts read the same bytes
            work = f"{self.store.path}/work/{key_of(root)}-{time.time_ns()}"
            try:
                source.scan(self.spark, root, request.project, request.include_patterns, exclude, request.max_file_size, self.pdf_text).write.parquet(work)
                files = self.spark.read.parquet(work)
                token.check()
                tell(20, "compare")
                out = self._full(root, files, token, tell) if not self.store.knows(root) or verdict == "truly_corrupted" else self._incremental(root, files, token, tell)
            finally:
                # what this thread runs later is not the token's to cancel
                for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                    self.spark.sparkContext.setLocalProperty(name, None)
                self.store._delete([work])
            self.hashes.clear_mark(root)
            self.hashes.save(self.config.cache.hash_cache_path)
            tell(100, "done")
        return out | {"duration_ms": int(1000 * (time.monotonic() - began))}

    def _dirty_verdict(self, root: str, now: float | None) -> str | None:
        mark = self.hashes.dirty_roots.get(root)
        if mark is None:
            return None
        n = F.lit
        indexed = self.store.files(root).count()
        one = self.spark.range(1).select(snapshot.dirty_verdict(n(mark.age(now)), n(self.store.file_hashes(root).count()), n(indexed), n(self.store.count(root))).alias("v"))
        return one.head()["v"]

    #: Failed files that a response names; all of them are tried again by the next run.
    NAMED_ERRORS = 100

    def _finish(self, root: str, files: DataFrame) -> list[str]:
        """Remember the files whose chunks all have vectors; what to say about the others."""
        bad = self.store.chunks(root).where("vector IS NULL").select("file_path").distinct()
        self.store.set_files(root, files.join(bad, "file_path", "left_anti"))
        return [f"no embedding: {r['file_path']}" for r in bad.orderBy("file_path").limit(self.NAMED_ERRORS).collect()]

    def _full(self, root: str, files: DataFrame, token: Token, tell: Progress) -> dict[str, Any]:
        n_files = files.count()
        tell(40, "chunk and embed")
        n = self.store.replace(root, self._chunks(files))
        token.check()
        errors = self._finish(root, files) if n else ["No code chunks found"]
        return {"mode": "full", "files_indexed": n_files, "chunks_created": n, "embeddings_generated": n, "files_updated": 0, "files_removed": 0, "errors": errors}

    def _incremental(self, root: str, files: DataFrame, token: Token, tell: Progress) -> dict[str, Any]:
        changes = snapshot.diff(self.store.file_hashes(root), files)
        count = snapshot.counters(changes).head()
        made, errors = 0, []
        if count["files_added"] or count["files_updated"] or count["files_removed"]:
            tell(40, "chunk and embed")
            new = files.join(changes.where("status IN ('added', 'updated')").select("file_path"), "file_path", "left_semi")
            made = self.store.update(root, changes.where("status IN ('added', 'updated', 'removed')"), self._chunks(new))
            token.check()
            errors = self._finish(root, files)
        return {"mode": "incremental", "files_indexed": count["files_added"], "chunks_created": made, "embeddings_generated": made, "files_updated": count["files_updated"], "files_removed": count["files_removed"], "errors": errors}

    # ---- searching ----
    def _gate(self, path: str | None) -> str | None:
        """The root as it is stored; a root whose run did not end can't be searched by path."""
        if path is None:
            return None
        root = source.normalise(path)
        if root in self.hashes.dirty_roots:
            raise IndexDirty(f"the index of {root} is not complete; index it again")
        return root

    def _vector(self, text: str) -> list[float]:
        return [float(x) for x in self.embedder.embed([text])[0]]

    def _search(self, rows: DataFrame, postings: DataFrame, known: tuple[int, float], text: str, limit: int, threshold: float, hybrid: bool) -> DataFrame:
        """Hits of rows, which are filtered already, with threshold_used and threshold_lowered. known: the postings' term_stats()."""
        depth = fusion.DEPTH * max(limit, 1)
        near = knn.knn(rows.where("vector IS NOT NULL"), self._vector(text), depth)
        if hybrid:
            words = keyword.bm25_postings(postings, text, stats=known).join(rows.select("chunk_id"), "chunk_id", "left_semi")
            fused = fusion.hybrid(near, keyword.top(words, "keyword_score", depth), limit)
        else:
            fused = near.select("chunk_id", F.col("vector_score").alias("score"), "vector_score", F.lit(None).cast("double").alias("keyword_score")).orderBy(F.desc("score"), "chunk_id").limit(limit)
        held = fusion.adaptive(fused, threshold)
        # `held` has at most `limit` rows, so the chunk table is read with its ids as a filter
        return rows.drop("vector").join(F.broadcast(held), "chunk_id").orderBy(F.desc("score"), "chunk_id")

    HIT = ("file_path", "root_path", "content", "score", "vector_score", "keyword_score", "start_line", "end_line", "language", "project")

    def _answer(self, hits: DataFrame, threshold: float, began: float) -> dict[str, Any]:
        rows = hits.collect()  # at most `limit` of them
        used = rows[0]["threshold_used"] if rows else threshold
        return {"results": [{k: r[k] for k in self.HIT} for r in rows], "duration_ms": int(1000 * (time.monotonic() - began)), "threshold_used": used, "threshold_lowered": bool(rows and rows[0]["threshold_lowered"])}

    def _filtered(self, request: QueryRequest) -> tuple[DataFrame, DataFrame, tuple[int, float]]:
        root = self._gate(request.path)
        rows = self.store.chunks(root)
        tests: list[Column] = []
        if request.project is not None:
            tests.append(F.col("project") == request.project)
        if isinstance(request, AdvancedSearchRequest):
            if request.file_extensions:
                tests.append(reduce(Column.__or__, [F.col("file_path").endswith("." + e.lstrip(".")) for e in request.file_extensions]))
            if request.languages:
                tests.append(F.col("language").isin(request.languages))
            if request.path_patterns:
                tests.append(globs.matches_any(F.col("file_path"), request.path_patterns))
        return (rows.where(reduce(Column.__and__, tests)) if tests else rows), self.store.postings(root), self.store.term_stats(root)

    def query(self, request: QueryRequest) -> dict[str, Any]:
        """Hybrid or vector search; with an AdvancedSearchRequest also by extension, language and path. Filters run first."""
        request.validate()
        began = time.monotonic()
        found = self._filtered(request)
        if not self.store.count():
            return {"results": [], "duration_ms": 0, "threshold_used": request.min_score, "threshold_lowered": False}
        return self._answer(self._search(*found, request.query, request.limit, request.min_score, request.hybrid), request.min_score, began)

    search_by_filters = query

    def search_frame(self, request: QueryRequest) -> DataFrame:
        """The same hits as a DataFrame, not collected."""
        request.validate()
        return self._search(*self._filtered(request), request.query, request.limit, request.min_score, request.hybrid)

    def statistics(self, request: Request | None = None) -> dict[str, Any]:
        rows = self.store.chunks()
        total = stats.totals(rows).head()
        by = stats.by_language(rows).collect()
        return {"total_files": total["total_files"], "total_chunks": total["total_chunks"], "total_embeddings": total["total_chunks"], "database_size_bytes": self.store.size_bytes(), "language_breakdown": [{"language": r["language"], "file_count": r["files"], "chunk_count": r["chunks"]} for r in by]}

    def clear(self, request: Request | None = None) -> dict[str, Any]:
        """Everything goes: chunks, hashes, dirty marks and the list of indexed commits."""
        try:
            self.store.clear()
            self.hashes.dirty_roots.clear()
            self.git.clear()
            self.hashes.save(self.config.cache.hash_cache_path)
            self.git.save(self.config.cache.git_cache_path)
            return {"success": True, "message": "Cleared all indexed data"}
        except Exception as e:  # the answer says so instead
            return {"success": False, "message": f"{type(e).__name__}: {e}"}

    # ---- history ----
    def search_git_history(self, request: SearchGitHistoryRequest) -> dict[str, Any]:
        request.validate()
        began = time.monotonic()
        repo = gitlog.discover(request.path)
        since, until = (self._seconds(x) for x in (request.since, request.until))
        with self._lock("git:" + repo):
            found = gitlog.hashes(repo, request.branch, since, until)
            wanted = [h for h, _ in found if not self.git.has(repo, h)][: request.max_commits]
            if wanted:
                frame = gitlog.commits(self.spark, repo, request.branch, since, until)
                new = frame.join(self.spark.createDataFrame([(h,) for h in wanted], "hash string"), "hash", "left_semi")
                self.store.append(repo, embed(history.commit_chunks(new, repo, request.project), self.embedder), commits=True)
                self.git.add(repo, set(wanted))
                self.git.save(self.config.cache.git_cache_path)
        rows = history.matching(history.dated(self.store.commits(repo), since, until), request.author, request.file_pattern)
        if request.project is not None:
            rows = rows.where(F.col("project") == request.project)
        hits = self._search(rows, self.store.postings(repo, commits=True), self.store.term_stats(repo, commits=True), request.query, request.limit, request.min_score, True).collect()
        cut = lambda text: text if len(raw := text.encode()) <= history.SNIPPET_BYTES else raw[: history.SNIPPET_BYTES].decode("utf-8", "ignore") + "..."
        results = [{"commit_hash": r["chunk_id"], "commit_message": r["message"], "author": r["author_name"], "author_email": r["author_email"], "commit_date": r["commit_date"], "score": r["score"], "vector_score": r["vector_score"], "keyword_score": r["keyword_score"], "files_changed": r["files_changed"], "diff_snippet": cut(r["diff_content"] or "")} for r in hits]
        return {"results": results, "commits_indexed": len(wanted), "total_cached_commits": self.git.count(repo), "duration_ms": int(1000 * (time.monotonic() - began))}

    def _seconds(self, text: str | None) -> int | None:
        """Epoch seconds of a date; None for none, and for one that can't be read."""
        if text is None:
            return None
        return self.spark.createDataFrame([(text,)], "t string").select(history.parse_date(F.col("t")).alias("s")).head()["s"]

    # ---- navigation ----
    def _definitions(self, path: str, project: str | None) -> tuple[DataFrame, DataFrame]:
        files = source.single(self.spark, path, project)
        return files, definitions_of(files)

    def find_definition(self, request: FindDefinitionRequest) -> dict[str, Any]:
        """The definition that encloses the position."""
        request.validate()
        began = time.monotonic()
        files, defs = self._definitions(request.file_path, request.project)
        row = navigation.definition_at(defs, os.path.basename(request.file_path), request.line, request.column).head()
        return {"definition": row.asDict() if row else None, "precision": self._precision(request.file_path), "duration_ms": int(1000 * (time.monotonic() - began))}

    @staticmethod
    def _precision(path: str) -> str:
        return "medium" if path.endswith(".py") else "low"

    def find_references(self, request: FindReferencesRequest) -> dict[str, Any]:
        """Uses of the symbol defined at the position, with the true total."""
        request.validate()
        began = time.monotonic()
        files, defs = self._definitions(request.file_path, request.project)
        at = navigation.definition_at(defs, os.path.basename(request.file_path), request.line, request.column).head()
        out: dict[str, Any] = {"symbol_name": None, "references": [], "total_count": 0, "precision": self._precision(request.file_path)}
        if at:
            refs = navigation.references(files, defs.where(F.col("name") == at["name"]))
            total = refs.count()
            rows = refs.orderBy("file_path", "line_no", "start_col").limit(request.limit).collect()
            found = [{"file_path": r["file_path"], "start_line": r["line_no"], "end_line": r["line_no"], "start_col": r["start_col"], "end_col": r["end_col"], "reference_kind": r["reference_kind"], "preview": r["line"].strip()} for r in rows]
            out |= {"symbol_name": at["name"], "references": found, "total_count": total}
            if request.include_definition:
                out["definition"] = at.asDict()
        return out | {"duration_ms": int(1000 * (time.monotonic() - began))}

    def get_call_graph(self, request: GetCallGraphRequest) -> dict[str, Any]:
        """Callers and callees of the function at the position, up to `depth` calls away, as rows (name, file, line, depth, parent)."""
        request.validate()
        began = time.monotonic()
        files, defs = self._definitions(request.file_path, request.project)
        functions = defs.where(F.col("kind").isin("function", "method"))
        root = navigation.definition_at(functions, os.path.basename(request.file_path), request.line, request.column).head()
        out: dict[str, Any] = {"root_symbol": None, "callers": [], "callees": [], "precision": self._precision(request.file_path)}
        if root:
            edges = navigation.call_edges(navigation.references(files, defs), defs).select("caller", "callee").distinct()
            start = self.spark.createDataFrame([(root["def_id"],)], "node string")
            names = defs.select(F.col("def_id").alias("node"), "name", "kind", "file_path", "start_line")
            for key, wanted, a, b in (("callers", request.include_callers, "callee", "caller"), ("callees", request.include_callees, "caller", "callee")):
                if wanted:
                    found = navigation.reach(edges, start, request.depth, a, b).where("depth > 0").join(names, "node").orderBy("depth", "node")
                    out[key] = [r.asDict() for r in found.collect()]
            out["root_symbol"] = root.asDict()
        return out | {"duration_ms": int(1000 * (time.monotonic() - began))}

    # ---- by name, as a server calls them ----
    def tools(self) -> dict[str, tuple[type[Request] | None, Callable[..., dict[str, Any]]]]:
        return {
            "index_codebase": (IndexRequest, self.index),
            "query_codebase": (QueryRequest, self.query),
            "get_statistics": (None, self.statistics),
            "clear_index": (None, self.clear),
            "search_by_filters": (AdvancedSearchRequest, self.query),
            "search_git_history": (SearchGitHistoryRequest, self.search_git_history),
            "find_definition": (FindDefinitionRequest, self.find_definition),
            "find_references": (FindReferencesRequest, self.find_references),
            "get_call_graph": (GetCallGraphRequest, self.get_call_graph),
        }

    def call(self, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
        kind, run = self.tools()[name]
        return run(kind.from_dict(arguments)) if kind else run()
