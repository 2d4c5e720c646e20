"""Small states kept as JSON beside the store: file hashes and dirty marks by root, indexed commits by repository.

They are written to a new file that then takes the old one's place, so a broken write leaves the old state.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import CacheError


def _load(path: str | os.PathLike) -> dict:
    place = Path(path)
    if not place.exists():
        return {}
    try:
        return json.loads(place.read_text())
    except (ValueError, OSError) as e:
        raise CacheError(f"{place}: {e}") from e


def _save(path: str | os.PathLike, value: dict) -> None:
    place = Path(path)
    place.parent.mkdir(parents=True, exist_ok=True)
    temp = place.with_name(place.name + ".new")
    temp.write_text(json.dumps(value, indent=2, sort_keys=True))
    os.replace(temp, place)


@dataclass
class Dirty:
    timestamp: int
    expected_files: int | None = None

    def age(self, now: float | None = None) -> int:
        return max(0, int(now if now is not None else time.time()) - self.timestamp)

    def is_stale(self, most: int, now: float | None = None) -> bool:
        return self.age(now) >= most


@dataclass
class HashCache:
    roots: dict[str, dict[str, str]] = field(default_factory=dict)
    dirty_roots: dict[str, Dirty] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | os.PathLike) -> HashCache:
        """An older form that lists dirty roots without times is read with the time 0, and saved anew."""
        raw = _load(path)
        dirty = raw.get("dirty_roots", {})
        out = cls(raw.get("roots", {}), {k: Dirty(0) for k in dirty} if isinstance(dirty, list) else {k: Dirty(**v) for k, v in dirty.items()})
        if isinstance(dirty, list):
            out.save(path)
        return out

    def save(self, path: str | os.PathLike) -> None:
        _save(path, {"roots": self.roots, "dirty_roots": {k: vars(v) for k, v in self.dirty_roots.items()}})

    def mark(self, root: str, expected: int | None = None, now: float | None = None) -> None:
        self.dirty_roots[root] = Dirty(int(now if now is not None else time.time()), expected)

    def clear_mark(self, root: str) -> None:
        self.dirty_roots.pop(root, None)

    def clear_stale(self, most: int, now: float | None = None) -> list[str]:
        gone = [r for r, d in self.dirty_roots.items() if d.is_stale(most, now)]
        for r in gone:
            del self.dirty_roots[r]
        return gone

    def frame(self, spark: SparkSession, root: str) -> DataFrame:
        return spark.createDataFrame([(root, f, h) for f, h in self.roots.get(root, {}).items()], "root_path string, file_path string, file_hash string")


@dataclass
class GitCache:
    repos: dict[str, set[str]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | os.PathLike) -> GitCache:
        return cls({k: set(v) for k, v in _load(path).get("repos", {}).items()})

    def save(self, path: str | os.PathLike) -> None:
        _save(path, {"repos": {k: sorted(v) for k, v in self.repos.items()}})

    def has(self, repo: str, commit: str) -> bool:
        return commit in self.repos.get(repo, ())

    def add(self, repo: str, commits: set[str]) -> None:
        self.repos.setdefault(repo, set()).update(commits)

    def replace(self, repo: str, commits: set[str]) -> None:
        self.repos[repo] = set(commits)

    def remove(self, repo: str) -> None:
        self.repos.pop(repo, None)

    def clear(self) -> None:
        self.repos.clear()

    def count(self, repo: str) -> int:
        return len(self.repos.get(repo, ()))

    def total(self) -> int:
        return sum(map(len, self.repos.values()))
