"""Configuration: defaults, then a TOML file (any section may be missing), then environment variables, then validation."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from .errors import ConfigError, InvalidValue


def data_dir() -> Path:
    return Path(os.environ.get("XDG_DATA_HOME") or Path.home() / ".local/share") / "tessera"


def cache_dir() -> Path:
    return Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "tessera"


def config_path() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "tessera" / "config.toml"


@dataclass
class Storage:
    path: str = field(default_factory=lambda: str(data_dir() / "store"))


@dataclass
class Embedding:
    model_name: str = "all-MiniLM-L6-v2"
    batch_size: int = 256


@dataclass
class Indexing:
    chunk_size: int = 50
    max_file_size: int = 1_048_576
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=lambda: ["target", "node_modules", ".git", "dist", "build"])


@dataclass
class Search:
    min_score: float = 0.7
    limit: int = 10
    hybrid: bool = True


@dataclass
class Cache:
    hash_cache_path: str = field(default_factory=lambda: str(cache_dir() / "hash_cache.json"))
    git_cache_path: str = field(default_factory=lambda: str(cache_dir() / "git_cache.json"))


#: Environment variable -> section, key and type.
ENVIRONMENT = {
    "TESSERA_STORE_PATH": ("storage", "path", str),
    "TESSERA_MODEL": ("embedding", "model_name", str),
    "TESSERA_BATCH_SIZE": ("embedding", "batch_size", int),
    "TESSERA_MIN_SCORE": ("search", "min_score", float),
    "TESSERA_LIMIT": ("search", "limit", int),
    "TESSERA_MAX_FILE_SIZE": ("indexing", "max_file_size", int),
}


@dataclass
class Config:
    storage: Storage = field(default_factory=Storage)
    embedding: Embedding = field(default_factory=Embedding)
    indexing: Indexing = field(default_factory=Indexing)
    search: Search = field(default_factory=Search)
    cache: Cache = field(default_factory=Cache)

    @classmethod
    def load(cls, path: str | os.PathLike | None = None, environ: dict[str, str] | None = None) -> Config:
        """path given: it has to exist; else the default place, if there is a file."""
        out = cls()
        place = Path(path) if path else config_path()
        if path and not place.exists():
            raise ConfigError(f"Configuration file not found: {place}")
        if place.exists():
            try:
                given = tomllib.loads(place.read_text())
            except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
                raise ConfigError(f"Failed to parse configuration: {e}") from e
            for section in fields(cls):
                target = getattr(out, section.name)
                for k, v in given.get(section.name, {}).items():
                    if hasattr(target, k):
                        setattr(target, k, v)
        for name, (section, key, kind) in ENVIRONMENT.items():
            if (value := (os.environ if environ is None else environ).get(name)) is not None:
                try:
                    setattr(getattr(out, section), key, kind(value))
                except ValueError:
                    pass  # an unreadable number leaves the setting as it was
        out.validate()
        return out

    def save(self, path: str | os.PathLike | None = None) -> None:
        place = Path(path) if path else config_path()
        text = "\n".join(f"[{name}]\n" + "".join(f"{k} = {json.dumps(v)}\n" for k, v in section.items()) for name, section in asdict(self).items())
        try:
            place.parent.mkdir(parents=True, exist_ok=True)
            (temp := place.with_suffix(".tmp")).write_text(text)
            os.replace(temp, place)
        except OSError as e:
            raise ConfigError(f"Failed to save configuration: {e}") from e

    def validate(self) -> None:
        positive = {"embedding.batch_size": self.embedding.batch_size, "indexing.chunk_size": self.indexing.chunk_size, "indexing.max_file_size": self.indexing.max_file_size, "search.limit": self.search.limit}
        for key, value in positive.items():
            if value <= 0:
                raise InvalidValue(f"Invalid configuration value for '{key}': must be greater than 0")
        if not 0 <= self.search.min_score <= 1:
            raise InvalidValue(f"Invalid configuration value for 'search.min_score': must be between 0.0 and 1.0, got {self.search.min_score}")
