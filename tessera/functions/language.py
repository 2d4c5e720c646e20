"""Languages by file extension, parsers by extension, and the kinds of symbols, visibilities and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language.
LANGUAGES = {
    "rs": "Rust", "py": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "jsx": "JavaScript (JSX)", "tsx": "TypeScript (TSX)", "java": "Java",
    "cpp": "C++", "cc": "C++", "cxx": "C++", "hh": "C/C++ Header", "hxx": "C/C++ Header", "c": "C", "h": "C/C++ Header", "hpp": "C/C++ Header", "go": "Go", "rb": "Ruby", "php": "PHP", "swift": "Swift",
    "kt": "Kotlin", "kts": "Kotlin", "scala": "Scala", "sh": "Shell", "bash": "Shell", "sql": "SQL", "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "SCSS", "sass": "SCSS",
    "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "xml": "XML", "ini": "INI", "conf": "Config", "config": "Config", "cfg": "Config", "properties": "Properties",
    "env": "Environment", "md": "Markdown", "markdown": "Markdown", "rst": "reStructuredText", "adoc": "AsciiDoc", "asciidoc": "AsciiDoc", "org": "Org Mode", "txt": "Text", "log": "Log", "pdf": "PDF",
}

# Extension -> grammar for structure-aware chunks and definitions.
GRAMMARS = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "swift": "swift",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "cs": "csharp", "rb": "ruby", "php": "php",
}

# Names of symbol kinds, reference kinds, visibilities and precisions.
SYMBOL_KINDS = ("function", "method", "class", "struct", "interface", "trait", "enum", "module", "variable", "constant", "parameter", "field", "import", "export", "enum_variant", "type_alias", "unknown")
REFERENCE_KINDS = ("call", "read", "write", "import", "type_reference", "inheritance", "instantiation", "unknown")
VISIBILITIES = ("public", "private", "protected", "internal")
PRECISIONS = {"high": "compiler-grade resolution", "medium": "syntax-tree resolution", "low": "text patterns"}


def language_of(ext: Column) -> Column:
    """Language of an extension in any case; null if unknown."""
    return F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[F.lower(ext)]


# Node kinds of the grammars -> symbol kind.
NODE_KINDS = {
    "function": ("function_item", "function_definition", "function_declaration", "function_expression", "arrow_function", "decorated_definition"),
    "method": ("method_definition", "method_declaration", "method", "singleton_method", "constructor_declaration"),
    "class": ("impl_item", "class_definition", "class_declaration", "class_specifier", "class"),
    "struct": ("struct_item", "struct_specifier", "struct_declaration"),
    "interface": ("interface_declaration", "protocol_declaration"),
    "trait": ("trait_item", "trait_declaration"),
    "enum": ("enum_item", "enum_declaration", "enum_specifier"),
    "module": ("mod_item", "module", "namespace_definition", "namespace_declaration"),
    "variable": ("static_item", "variable_declaration", "lexical_declaration"),
    "constant": ("const_item",),
    "type_alias": ("type_item", "type_alias_declaration", "type_declaration"),
}
KIND_OF_NODE = {node: kind for kind, nodes in NODE_KINDS.items() for node in nodes}


def symbol_kind(node_kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in KIND_OF_NODE.items() for x in kv))[node_kind], F.lit("unknown"))


def display_name(kind: Column) -> Column:
    """A symbol kind for people: `type_alias` is `type alias`."""
    return F.replace(kind, F.lit("_"), F.lit(" "))


def visibility(node_text: Column) -> Column:
    """Visibility by the words in a definition's text, the widest first."""
    t = F.lower(node_text)
    # fixed values: the words that grant a visibility
    public = t.contains("pub ") | t.contains("public ") | t.contains("export ")
    return F.when(public, "public").when(t.contains("protected "), "protected").when(t.contains("internal ") | t.contains("package "), "internal").otherwise("private")


def reference_kind(line: Column, before: Column, after: Column) -> Column:
    """What an occurrence is, from its line and the text before and after it on that line; the first that fits."""
    low, a = F.lower(line), F.ltrim(after)
    # fixed values: the words and signs looked for
    imports = low.contains("import ") | low.contains("from ") | low.contains("require(") | low.contains("use ")
    return (
        F.when(imports, "import")
        .when(before.contains("new "), "instantiation")
        .when(before.contains("extends") | before.contains("implements"), "inheritance")
        .when(a.startswith("("), "call")
        .when(a.startswith("=") & ~a.startswith("==") & ~a.startswith("=>"), "write")
        .when(before.contains(":") | before.contains("->") | before.contains("<"), "type_reference")
        .otherwise("read")
    )
