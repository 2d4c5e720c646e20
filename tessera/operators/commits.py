"""Commits as documents, the way back, and the filters of a search in history. All expressions; no stage of their own."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_bytes

# Most bytes of a commit's document and of a snippet, and the mark of a cut.
DOCUMENT_BYTES, SNIPPET_BYTES = 6000, 500
CUT_MARK = "\n\n[... content truncated for embedding ...]"


def author(name: Column, email: Column) -> Column:
    name, email = F.coalesce(name, F.lit("Unknown")), F.coalesce(email, F.lit(""))
    return F.when(email == "", name).otherwise(F.concat(name, F.lit(" <"), email, F.lit(">")))


def commit_text(most: int = DOCUMENT_BYTES) -> Column:
    """The document of a commit's row (message, author_name, author_email, files_changed, diff_content)."""
    files = F.concat(F.lit("Files Changed:\n"), F.array_join(F.transform("files_changed", lambda f: F.concat(F.lit("- "), f, F.lit("\n"))), ""), F.lit("\n"))
    parts = [
        F.concat(F.lit("Commit Message:\n"), F.coalesce("message", F.lit("")), F.lit("\n\n")),
        F.concat(F.lit("Author: "), author(F.col("author_name"), F.col("author_email")), F.lit("\n\n")),
        F.when(F.coalesce(F.size("files_changed"), F.lit(0)) > 0, files).otherwise(""),
        F.when(F.coalesce("diff_content", F.lit("")) != "", F.concat(F.lit("Diff:\n"), F.col("diff_content"))).otherwise(""),
    ]
    return cut_bytes(F.concat(*parts), most, CUT_MARK)


def commit_chunks(commits: DataFrame, repo: str | Column, project: str | None = None, most: int = DOCUMENT_BYTES) -> DataFrame:
    """Chunk rows of commits, with the commit's own columns kept beside the text."""
    repo = F.lit(repo) if isinstance(repo, str) else repo
    return commits.select(
        F.col("hash").alias("chunk_id"),
        F.concat(F.lit("git://"), repo).alias("file_path"),
        F.lit(None).cast("string").alias("root_path"),
        F.lit(project).cast("string").alias("project"),
        F.lit(0).alias("start_line"),
        F.lit(0).alias("end_line"),
        F.lit("git-commit").alias("language"),
        F.lit("commit").alias("extension"),
        F.col("hash").alias("file_hash"),
        F.col("commit_date").alias("indexed_at"),
        commit_text(most).alias("content"),
        "message", "author_name", "author_email", "files_changed", "diff_content", "commit_date",
    )


def parse_author(line: Column) -> tuple[Column, Column]:
    """Name and email of `Author: name <email>`; an empty email where there is none."""
    body = F.regexp_replace(line, r"^Author:\s*", "")
    email = F.regexp_extract(body, r"<([^>]*)>", 1)
    return F.trim(F.regexp_replace(body, r"\s*<[^>]*>.*$", "")), email


def reparse(content: Column) -> Column:
    """struct(message, author_name, author_email, files_changed, snippet) read back from a commit's document by its headings."""
    message = F.regexp_extract(content, r"(?s)^Commit Message:\n(.*?)\n\nAuthor: [^\n]*(?:\n|$)", 1)
    line = F.regexp_extract(content, r"(?s)^Commit Message:\n.*?\n\n(Author: [^\n]*)", 1)
    name, email = parse_author(line)
    listed = F.regexp_extract(content, r"(?s)\n\nFiles Changed:\n(.*?)\n(?:\n|$)", 1)
    files = F.transform(F.filter(F.split(listed, "\n"), lambda f: f.startswith("- ")), lambda f: F.substr(f, F.lit(3)))
    diff = F.regexp_extract(content, r"(?s)\n\nDiff:\n(.*)$", 1)
    return F.struct(message.alias("message"), name.alias("author_name"), email.alias("author_email"), files.alias("files_changed"), cut_bytes(diff, SNIPPET_BYTES, "...").alias("snippet"))


def parse_date(text: Column) -> Column:
    """Epoch seconds of an integer, an ISO timestamp or a day; null if it is none of these."""
    t = F.trim(text)
    whole = F.when(t.rlike("^-?[0-9]+$"), t.try_cast("long"))
    stamp = F.when(~t.rlike("^-?[0-9]+$"), F.unix_seconds(t.try_cast("timestamp")))
    return F.coalesce(whole, stamp)


def dated(commits: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Commits between two moments, both included."""
    if since is not None:
        commits = commits.where(F.col("commit_date") >= since)
    return commits if until is None else commits.where(F.col("commit_date") <= until)


def _regex(pattern: str | None) -> str | None:
    """The pattern, or None for one that can't be read: such a filter is left out."""
    try:
        return pattern if pattern and re.compile(pattern) else None
    except re.error:
        return None


def matching(commits: DataFrame, author_pattern: str | None = None, file_pattern: str | None = None) -> DataFrame:
    """Commits whose author's name or email, and one changed file at least, match."""
    if p := _regex(author_pattern):
        commits = commits.where(F.col("author_name").rlike(p) | F.col("author_email").rlike(p))
    if p := _regex(file_pattern):
        commits = commits.where(F.exists("files_changed", lambda f: f.rlike(p)))
    return commits


def unseen(commits: DataFrame, indexed: DataFrame) -> DataFrame:
    """Commits whose hash is not among the indexed ones (commit_hash)."""
    return commits.join(indexed.select(F.col("commit_hash").alias("hash")).distinct(), "hash", "left_anti")


def newest(commits: DataFrame, most: int) -> DataFrame:
    return commits.orderBy(F.desc("commit_date"), "hash").limit(most)
