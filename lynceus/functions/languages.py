"""Language names from file extensions and from free-form names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lynceus.functions.text import sql_map

UNKNOWN = "unknown"

# Extension -> language. `jsx` is read as JavaScript.
BY_EXTENSION = {
    "py": "python",
    "js": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "rs": "rust",
    "go": "go",
    "java": "java",
    "cs": "csharp",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "c": "c",
    "h": "c",
    "rb": "ruby",
    "php": "php",
    "swift": "swift",
    "kt": "kotlin",
    "kts": "kotlin",
}

# Accepted language names and aliases.
BY_NAME = {
    "python": "python",
    "py": "python",
    "javascript": "javascript",
    "js": "javascript",
    "typescript": "typescript",
    "ts": "typescript",
    "rust": "rust",
    "rs": "rust",
    "go": "go",
    "golang": "go",
    "java": "java",
    "csharp": "csharp",
    "cs": "csharp",
    "cpp": "cpp",
    "c++": "cpp",
    "c": "c",
    "ruby": "ruby",
    "php": "php",
    "swift": "swift",
    "kotlin": "kotlin",
    "kt": "kotlin",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(sql_map(table), F.lower(key))


def language_from_ext(ext: Column) -> Column:
    return F.coalesce(_lookup(BY_EXTENSION, ext), F.lit(UNKNOWN))


def language_from_name(name: Column) -> Column:
    return F.coalesce(_lookup(BY_NAME, name), F.lit(UNKNOWN))


def language_of(name: Column, ext: Column) -> Column:
    """A declared name or extension wins; otherwise the file's extension decides."""
    return F.coalesce(
        _lookup(BY_NAME, name),
        _lookup(BY_EXTENSION, name),
        _lookup(BY_EXTENSION, ext),
        F.lit(UNKNOWN),
    )
