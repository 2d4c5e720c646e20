"""Texts with which a caller may ask for an operation."""

from __future__ import annotations

from string import Template

# Prompt name -> description, defaults of its arguments, text.
PROMPTS: dict[str, tuple[str, dict[str, object], str]] = {
    "index": ("Index a codebase directory (full or incremental by what is there)", {"path": "."}, "Please index the codebase at path: '$path'. A first run is a full index; later ones update what changed."),
    "query": ("Search the indexed codebase", {"query": ""}, "Please search the codebase for: $query"),
    "stats": ("Statistics of the indexed codebase", {}, "Please get statistics about the indexed codebase."),
    "clear": ("Clear all indexed data", {}, "Please clear all indexed data."),
    "search": ("Search with filters by file type, language and path", {"query": ""}, "Please perform an advanced search for: $query"),
    "git-search": ("Search the commit history, indexing commits on demand", {"query": "", "path": "."}, "Please search git commit history at path '$path' for: $query. Commits are indexed as needed."),
    "definition": ("Find where a symbol is defined", {"file": "", "line": 1, "column": 0}, "Please find the definition of the symbol at file '$file', line $line, column $column."),
    "references": ("Find all references to a symbol", {"file": "", "line": 1, "column": 0}, "Please find all references to the symbol at file '$file', line $line, column $column."),
    "callgraph": ("Callers and callees of a function", {"file": "", "line": 1, "column": 0}, "Please get the call graph for the function at file '$file', line $line, column $column: what calls it and what it calls."),
}


def render(name: str, **given: object) -> str:
    _, defaults, text = PROMPTS[name]
    return Template(text).substitute(defaults | given)
