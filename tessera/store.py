"""The chunk store: Parquet folders by root, named in a manifest whose replacement is the commit.

Chunks and their postings lie in new folders for each append; the manifest lists the folders of every root, so a reader
always sees whole appends, and reading one root touches that root's folders only. Deleted chunks are named in folders of
their own, which readers take off older parts; after MAX_TOMBS of them the root is written anew, so an update costs what
it changes. Postings are sorted by term within files, so a query's terms are found by the files' statistics.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import StoreError, StoreUnavailable
from .functions.text import tokens
from .operators import stats

CHUNKS = "chunk_id string, file_path string, root_path string, project string, start_line int, end_line int, language string, extension string, file_hash string, indexed_at long, content string, vector array<float>"
#: What commits carry beside a chunk's columns.
COMMIT_COLUMNS = "message string, author_name string, author_email string, files_changed array<string>, diff_content string, commit_date long"
POSTINGS = "chunk_id string, term string, tf long, length long"
COMMITS = CHUNKS + ", " + COMMIT_COLUMNS
#: Folders of deleted chunks that a root may have before it is written anew.
MAX_TOMBS = 8
#: Seconds after which a claim on the manifest counts as left behind.
STALE = 60
_LOCKS: dict[str, threading.Lock] = {}
FILES = "root_path string, file_path string, file_hash string"


def _names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fieldNames()


def key_of(root: str) -> str:
    return hashlib.sha256(root.encode()).hexdigest()[:16]


class Store:
    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None) -> None:
        self.spark, self.path, self.dimension = spark, path.rstrip("/"), dimension
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- files of any Hadoop file system ----
    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _load(self) -> dict:
        place = self._at(f"{self.path}/manifest.json")
        if not self._fs.exists(place):
            return {"version": 0, "dimension": self.dimension, "roots": {}, "files": {}}
        stream = self._fs.open(place)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _save(self, manifest: dict) -> None:
        manifest["version"] += 1
        new, place = self._at(f"{self.path}/manifest.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifest.json")
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(place), options)

    @contextmanager
    def _edit(self) -> Iterator[dict]:
        """The manifest, held alone from reading to writing: by a lock among threads, by a claim file among processes.

        A claim is held for as long as the manifest takes to be written; one of over STALE seconds is left by a process that
        ended meanwhile.
        """
        claim = self._at(f"{self.path}/manifest.claim")
        with _LOCKS.setdefault(self.path, threading.Lock()):
            until = time.monotonic() + 4 * STALE
            while not self._fs.createNewFile(claim):
                if time.monotonic() > until:
                    raise StoreUnavailable(f"the manifest of {self.path} is held by another process")
                if self._fs.exists(claim) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > STALE:
                    self._fs.delete(claim, False)
                time.sleep(0.05)
            try:
                manifest = self._load()
                yield manifest
                self._save(manifest)
            finally:
                self._fs.delete(claim, False)

    def _delete(self, folders: Sequence[str]) -> None:
        for f in folders:
            self._fs.delete(self._at(f), True)

    # ---- lifecycle ----
    def initialize(self, dimension: int) -> None:
        """Create an empty store; an existing one stays, if its vectors have this length."""
        held = self._load()
        if not held["version"]:
            with self._edit() as held:
                if not held["version"]:
                    held["dimension"] = dimension
        if held["dimension"] not in (None, dimension):
            raise StoreError(f"the store holds vectors of length {held['dimension']}, not {dimension}")
        self.dimension = dimension

    def flush(self) -> None:
        """Nothing to do: every write is committed by its manifest."""

    @property
    def version(self) -> int:
        return self._load()["version"]

    # ---- writing ----
    def _write(self, root: str, rows: DataFrame, commits: bool) -> dict | None:
        folder = f"{self.path}/data/root_key={key_of(root)}/{uuid.uuid4().hex}"
        rows.select(*_names(COMMITS if commits else CHUNKS)).write.parquet(f"{folder}/chunks")
        made = self.spark.read.schema(COMMITS if commits else CHUNKS).parquet(f"{folder}/chunks")
        bad = self.dimension and made.where(F.col("vector").isNotNull() & (F.size("vector") != self.dimension)).head(1)
        count = made.count()
        if bad or not count:
            self._delete([folder])
            if bad:
                raise StoreError(f"a vector's length is not {self.dimension}")
            return None
        cut = made.select("chunk_id", tokens(F.col("content")).alias("t")).select("chunk_id", F.size("t").cast("long").alias("length"), F.explode("t").alias("term"))
        index = cut.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length")).select(*_names(POSTINGS))
        index.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.parquet(f"{folder}/postings")
        return {"folder": folder, "chunks": count} | self._lengths(made.select(F.size(tokens(F.col("content"))).alias("length")))

    @staticmethod
    def _lengths(rows: DataFrame) -> dict:
        """Chunks with a term, and their terms: what BM25 needs of a part, so that a query doesn't count the postings."""
        row = rows.agg(F.count_if(F.col("length") > 0).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("terms")).head()
        return {"docs": row["docs"], "terms": row["terms"]}

    @staticmethod
    def _fresh(root: str, commits: bool) -> dict:
        return {"root": root, "commits": commits, "parts": [], "tombs": [], "seq": 0}

    def append(self, root: str, chunks: DataFrame, commits: bool = False) -> int:
        """Add chunks of one root; how many. commits: they carry COMMIT_COLUMNS too."""
        part = self._write(root, chunks, commits)
        if part is None:
            return 0
        with self._edit() as manifest:
            held = manifest["roots"].setdefault(key_of(root), self._fresh(root, commits))
            held["parts"].append(part | {"seq": held["seq"]})
        return part["chunks"]

    def replace(self, root: str, chunks: DataFrame, commits: bool = False) -> int:
        """Put chunks in place of all that the root has."""
        part = self._write(root, chunks, commits)
        with self._edit() as manifest:
            old = manifest["roots"].pop(key_of(root), self._fresh(root, commits))
            if part is not None:
                manifest["roots"][key_of(root)] = self._fresh(root, commits) | {"parts": [part | {"seq": 0}]}
        self._delete([p["folder"] for p in old["parts"] + old["tombs"]])
        return 0 if part is None else part["chunks"]

    def _bury(self, root: str, dead: DataFrame) -> dict | None:
        """A folder with the ids of chunks that are no more; None if there are none."""
        folder = f"{self.path}/data/root_key={key_of(root)}/{uuid.uuid4().hex}"
        dead.select("chunk_id", F.size(tokens(F.col("content"))).alias("length")).write.parquet(folder)
        made = self.spark.read.schema("chunk_id string, length int").parquet(folder)
        if not (count := made.count()):
            self._delete([folder])
            return None
        return {"folder": folder, "chunks": count} | self._lengths(made)

    def _change(self, root: str, dead: DataFrame, added: DataFrame | None) -> int:
        part = self._write(root, added, False) if added is not None else None
        tomb = self._bury(root, dead)
        with self._edit() as manifest:
            held = manifest["roots"].setdefault(key_of(root), self._fresh(root, False))
            held["seq"] += 1
            if tomb is not None:
                held["tombs"].append(tomb | {"seq": held["seq"]})
            if part is not None:
                held["parts"].append(part | {"seq": held["seq"]})
            empty = not self._live(held)
            if empty:
                manifest["roots"].pop(key_of(root))
        if empty:
            self._delete([p["folder"] for p in held["parts"] + held["tombs"]])
        elif len(held["tombs"]) > MAX_TOMBS:
            self.replace(root, self.chunks(root))
        return 0 if part is None else part["chunks"]

    @staticmethod
    def _live(held: dict) -> int:
        return sum(p["chunks"] for p in held["parts"]) - sum(t["chunks"] for t in held["tombs"])

    def update(self, root: str, gone: DataFrame, added: DataFrame) -> int:
        """One commit: the root without the files in gone (file_path), with the chunks in added; how many were added."""
        return self._change(root, self.chunks(root).join(gone.select("file_path").distinct(), "file_path", "left_semi"), added)

    def delete_files(self, root: str, files: Sequence[str] | DataFrame) -> int:
        """Drop the chunks of some files of one root; how many chunks went."""
        if not isinstance(files, DataFrame):
            files = self.spark.createDataFrame([(f,) for f in files], "file_path string")
        before = self.count(root)
        self._change(root, self.chunks(root).join(files.select("file_path").distinct(), "file_path", "left_semi"), None)
        return before - self.count(root)

    def delete_chunks(self, root: str, ids: Sequence[str]) -> int:
        """Drop single chunks of one root."""
        before = self.count(root)
        self._change(root, self.chunks(root).where(F.col("chunk_id").isin(list(ids))), None)
        return before - self.count(root)

    def set_files(self, root: str, files: DataFrame) -> None:
        """Remember a root's files as they were indexed (root_path, file_path, file_hash): what the next run compares with."""
        folder = f"{self.path}/files/root_key={key_of(root)}/{uuid.uuid4().hex}"
        files.select("root_path", "file_path", "file_hash").write.parquet(folder)
        with self._edit() as manifest:
            old = manifest["files"].get(key_of(root))
            manifest["files"][key_of(root)] = folder
        self._delete([old] if old else [])

    def clear(self) -> None:
        with self._edit() as manifest:
            old = [p["folder"] for r in manifest["roots"].values() for p in r["parts"] + r["tombs"]] + [*manifest["files"].values()]
            manifest |= {"roots": {}, "files": {}}
        self._delete(old)

    def clear_root(self, root: str) -> None:
        with self._edit() as manifest:
            old = manifest["roots"].pop(key_of(root), self._fresh(root, False))
            state = manifest["files"].pop(key_of(root), None)
        self._delete([p["folder"] for p in old["parts"] + old["tombs"]] + ([state] if state else []))

    # ---- reading ----
    def roots(self, commits: bool = False) -> list[str]:
        return [r["root"] for r in self._load()["roots"].values() if r["commits"] == commits]

    def knows(self, root: str) -> bool:
        """Whether the root's files are remembered from a run that ended."""
        return key_of(root) in self._load()["files"]

    def file_hashes(self, root: str) -> DataFrame:
        folder = self._load()["files"].get(key_of(root))
        return self.spark.read.schema(FILES).parquet(folder) if folder else self.spark.createDataFrame([], FILES)

    def _frame(self, kind: str, schema: str, root: str | None, commits: bool) -> DataFrame:
        """All parts without what was deleted after they were written; parts of one age are read together."""
        whole: list[str] = []
        out = None
        for held in self._load()["roots"].values():
            if held["commits"] != commits or root not in (None, held["root"]):
                continue
            ages: dict[tuple[str, ...], list[str]] = {}
            for p in held["parts"]:
                later = tuple(t["folder"] for t in held["tombs"] if t["seq"] > p["seq"])
                ages.setdefault(later, []).append(f"{p['folder']}/{kind}")
            whole += ages.pop((), [])
            for later, folders in ages.items():
                dead = self.spark.read.schema("chunk_id string").parquet(*later)
                kept = self.spark.read.schema(schema).parquet(*folders).join(dead, "chunk_id", "left_anti").select(*_names(schema))
                out = kept if out is None else out.unionByName(kept)
        if whole:
            rest = self.spark.read.schema(schema).parquet(*whole)
            out = rest if out is None else rest.unionByName(out)
        return self.spark.createDataFrame([], schema) if out is None else out

    def chunks(self, root: str | None = None) -> DataFrame:
        return self._frame("chunks", CHUNKS, root, False)

    def commits(self, repo: str | None = None) -> DataFrame:
        return self._frame("chunks", COMMITS, repo, True)

    def postings(self, root: str | None = None, commits: bool = False) -> DataFrame:
        return self._frame("postings", POSTINGS, root, commits)

    def term_stats(self, root: str | None = None, commits: bool = False) -> tuple[int, float]:
        """Chunks with a term, and the mean number of terms in them, as the manifest has them."""
        held = [r for r in self._load()["roots"].values() if r["commits"] == commits and root in (None, r["root"])]
        docs, terms = (sum(p[k] for r in held for p in r["parts"]) - sum(t[k] for r in held for t in r["tombs"]) for k in ("docs", "terms"))
        return docs, terms / max(docs, 1)

    def count(self, root: str | None = None) -> int:
        return sum(self._live(r) for r in self._load()["roots"].values() if not r["commits"] and root in (None, r["root"]))

    def files(self, root: str) -> DataFrame:
        return stats.files_of(self.chunks(root), root)

    def size_bytes(self) -> int:
        place = self._at(self.path)
        return self._fs.getContentSummary(place).getLength() if self._fs.exists(place) else 0
