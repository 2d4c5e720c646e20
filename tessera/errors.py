"""Error classes with what callers need to know: whether the user can mend it, and whether trying again may help."""

from __future__ import annotations


class EngineError(Exception):
    prefix = ""
    user_error = False
    retryable = False

    def __str__(self) -> str:
        text = super().__str__()
        return f"{self.prefix}: {text}" if self.prefix else text


class EmbeddingError(EngineError):
    prefix = "Embedding error"


class EmbeddingTimeout(EmbeddingError):
    retryable = True


class StoreError(EngineError):
    prefix = "Store error"


class StoreUnavailable(StoreError):
    retryable = True


class IndexingError(EngineError):
    prefix = "Indexing error"


class IndexDirty(IndexingError):
    """The last index run of a root did not end, so its data may be incomplete."""


class Cancelled(IndexingError):
    pass


class ChunkingError(EngineError):
    prefix = "Chunking error"


class ConfigError(EngineError):
    prefix = "Configuration error"


class InvalidValue(ConfigError):
    user_error = True


class ValidationError(EngineError):
    prefix = "Validation error"
    user_error = True


class GitError(EngineError):
    prefix = "Git error"


class CacheError(EngineError):
    prefix = "Cache error"


class InputOutputError(EngineError):
    prefix = "IO error"
    retryable = True
