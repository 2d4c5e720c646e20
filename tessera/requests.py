"""Requests with their defaults and bounds; validate() raises ValidationError."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from typing import Any, ClassVar

from .errors import ValidationError

# Bounds of the requests.
QUERY_BYTES, PROJECT_BYTES, EXTENSION_BYTES, LANGUAGE_BYTES = 10_240, 256, 20, 50
MAX_LIMIT, MAX_FILE_SIZE, MAX_COMMITS, MAX_REFERENCES, MAX_DEPTH = 1000, 100_000_000, 10_000, 10_000, 10


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ValidationError(why)


class Request:
    def validate(self) -> None:
        for check in (self._path, self._query, self._project, self._numbers, self._lists):
            check()

    @classmethod
    def from_dict(cls, given: dict[str, Any]):
        known = {f.name for f in fields(cls)}
        try:
            return cls(**{k: v for k, v in given.items() if k in known})
        except TypeError as e:
            raise ValidationError(str(e)) from e

    @classmethod
    def from_json(cls, text: str):
        return cls.from_dict(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    needs_directory: ClassVar[bool] = False

    def _path(self) -> None:
        if self.needs_directory:
            _need(os.path.exists(self.path), f"Path does not exist: {self.path}")
            _need(os.path.isdir(self.path), f"Path is not a directory: {self.path}")
        if (file := getattr(self, "file_path", None)) is not None:
            _need(bool(file.strip()), "file_path cannot be empty")

    def _query(self) -> None:
        if (text := getattr(self, "query", None)) is not None:
            _need(bool(text.strip()), "query cannot be empty")
            _need(len(text.encode()) <= QUERY_BYTES, f"query too long (max {QUERY_BYTES} bytes)")

    def _project(self) -> None:
        if (name := getattr(self, "project", None)) is not None:
            _need(name != "", "project name cannot be empty")
            _need(len(name.encode()) <= PROJECT_BYTES, f"project name too long (max {PROJECT_BYTES} characters)")

    bounds: ClassVar[dict[str, tuple[float, float]]] = {"limit": (0, MAX_LIMIT), "min_score": (0, 1), "max_file_size": (0, MAX_FILE_SIZE), "max_commits": (0, MAX_COMMITS), "line": (1, 2**31 - 1), "column": (0, 2**31 - 1), "depth": (0, MAX_DEPTH)}

    def _numbers(self) -> None:
        for name, (low, high) in self.bounds.items():
            value = getattr(self, name, None)
            if value is not None:
                _need(low <= value <= high, f"{name} must be between {low} and {high}, got {value}")

    def _lists(self) -> None:
        for name, most in (("file_extensions", EXTENSION_BYTES), ("languages", LANGUAGE_BYTES)):
            for x in getattr(self, name, ()):
                _need(0 < len(x.encode()) <= most, f"an item of {name} must have 1 to {most} bytes: {x!r}")


@dataclass
class IndexRequest(Request):
    path: str
    project: str | None = None
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    max_file_size: int = 1_048_576
    needs_directory: ClassVar[bool] = True


@dataclass
class QueryRequest(Request):
    query: str
    path: str | None = None
    project: str | None = None
    limit: int = 10
    min_score: float = 0.7
    hybrid: bool = True


@dataclass
class AdvancedSearchRequest(QueryRequest):
    file_extensions: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    path_patterns: list[str] = field(default_factory=list)


@dataclass
class SearchGitHistoryRequest(Request):
    query: str
    path: str = "."
    project: str | None = None
    branch: str | None = None
    max_commits: int = 10
    limit: int = 10
    min_score: float = 0.7
    author: str | None = None
    since: str | None = None
    until: str | None = None
    file_pattern: str | None = None

    def _path(self) -> None:
        _need(os.path.exists(self.path), f"Path does not exist: {self.path}")


@dataclass
class FindDefinitionRequest(Request):
    file_path: str
    line: int
    column: int = 0
    project: str | None = None


@dataclass
class FindReferencesRequest(Request):
    file_path: str
    line: int
    column: int = 0
    limit: int = 100
    project: str | None = None
    include_definition: bool = True
    bounds: ClassVar[dict[str, tuple[float, float]]] = Request.bounds | {"limit": (0, MAX_REFERENCES)}


@dataclass
class GetCallGraphRequest(Request):
    file_path: str
    line: int
    column: int = 0
    depth: int = 2
    project: str | None = None
    include_callers: bool = True
    include_callees: bool = True


@dataclass
class StatisticsRequest(Request):
    pass


@dataclass
class ClearRequest(Request):
    pass
