"""Commits of a git repository as a Spark data source (`gitlog`), read by the git command line.

The driver lists hashes, newest first; partitions take slices of the list, and a task reads its commits with their
changed paths and patches against the first parent. Options: path, branch, since, until (epoch seconds), max, per_task.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import GitError

SCHEMA = "hash string, message string, author_name string, author_email string, commit_date long, files_changed array<string>, diff_content string, parent_hashes array<string>"
# Bytes of a patch that are read, bytes that stay, and the mark of a cut.
READ_BYTES, KEEP_BYTES = 100_000, 8000
CUT_MARK = "\n\n[... diff truncated ...]"


def git(path: str, *args: str, text: str | None = None) -> str:
    run = subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotePath=false", "-C", path, *args], input=text.encode() if text is not None else None, capture_output=True)
    if run.returncode:
        raise GitError(run.stderr.decode("utf-8", "replace").strip())
    return run.stdout.decode("utf-8", "surrogateescape")


def discover(path: str) -> str:
    """The repository's top folder, from any place inside it."""
    return git(path if os.path.isdir(path) else os.path.dirname(path), "rev-parse", "--show-toplevel").strip()


def current_branch(path: str) -> str | None:
    try:
        return git(path, "symbolic-ref", "--short", "HEAD").strip()
    except GitError:
        return None


def has_commits(path: str) -> bool:
    try:
        return bool(git(path, "rev-parse", "--verify", "HEAD").strip())
    except GitError:
        return False


def commit_count(path: str) -> int:
    return int(git(path, "rev-list", "--count", "HEAD")) if has_commits(path) else 0


def hashes(path: str, branch: str | None = None, since: int | None = None, until: int | None = None) -> list[tuple[str, int]]:
    """(hash, time) of all commits in reach of a local branch or HEAD, newest first, children before parents."""
    if not branch and not has_commits(path):
        return []
    tip = f"refs/heads/{branch}" if branch else "HEAD"
    rows = [r.split(" ") for r in git(path, "log", "--date-order", "--format=%H %ct", tip).splitlines()]
    return [(h, t) for h, t in ((h, int(t)) for h, t in rows) if (since is None or t >= since) and (until is None or t <= until)]


def _clean(text: str) -> str:
    return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _patch(text: str) -> tuple[list[str], str]:
    """Changed paths (new side) and the patch: file headers marked `--- `, hunk headers, and lines that are UTF-8."""
    files: list[str] = []
    out: list[str] = []
    size, header = 0, False
    for line in text.split("\n"):
        if line.startswith("diff --git "):
            header = True
            rest = line[len("diff --git ") :]
            name = rest[(len(rest) + 1) // 2 :]
            files.append(_clean(name[2:] if name.startswith("b/") else name))
            made = "--- " + line
        elif header and line.startswith("+++ "):
            if line[4:].strip() != "/dev/null":
                files[-1] = _clean(line[6:].rstrip("\t"))
            made = line
        elif line.startswith("@@"):
            header = False
            made = line
        elif line.startswith("Binary files"):
            continue
        elif header or line[:1] in ("+", "-", " "):
            made = line
        else:
            continue
        if size >= READ_BYTES:
            continue
        try:
            made.encode("utf-8")
        except UnicodeEncodeError:  # bytes that are no UTF-8
            continue
        out.append(made + "\n")
        size += len(made) + 1
    body = "".join(out)
    if len(raw := body.encode()) > KEEP_BYTES:
        body = raw[:KEEP_BYTES].decode("utf-8", "ignore") + CUT_MARK
    return files, body


def read(path: str, wanted: list[str]) -> Iterator[tuple]:
    """Rows of SCHEMA for the given hashes."""
    if not wanted:
        return
    # NUL stands neither in names nor in messages, and files that hold it are binary to git, so no patch has it
    form = "--format=%x00%H%x00%P%x00%an%x00%ae%x00%ct%x00%B%x00"
    text = git(path, "log", "--no-walk=unsorted", "--stdin", "--root", "-m", "--first-parent", "-p", "-U3", "--no-color", "--no-ext-diff", "--no-renames", form, text="\n".join(wanted) + "\n")
    fields = iter(text.split("\0")[1:])
    for h, parents, name, email, when, message, patch in zip(*[fields] * 7, strict=True):
        files, diff = _patch(patch)
        yield h, _clean(message), _clean(name) or "Unknown", _clean(email), int(when), files, diff, parents.split()


class _Slice(InputPartition):
    def __init__(self, wanted: list[str]) -> None:
        self.wanted = wanted


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options.get("path", ".")
        self.branch = options.get("branch")
        self.since, self.until, self.most = (int(options[k]) if k in options else None for k in ("since", "until", "max"))
        self.per_task = int(options.get("per_task", 500))

    def partitions(self) -> list[_Slice]:
        found = [h for h, _ in hashes(self.path, self.branch, self.since, self.until)][: self.most]
        return [_Slice(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from read(self.path, partition.wanted)


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def commits(spark: SparkSession, path: str, branch: str | None = None, since: int | None = None, until: int | None = None, most: int | None = None) -> DataFrame:
    spark.dataSource.register(GitLog)
    given = {"branch": branch, "since": since, "until": until, "max": most}
    return spark.read.format("gitlog").options(path=os.path.realpath(path), **{k: str(v) for k, v in given.items() if v is not None}).load()
