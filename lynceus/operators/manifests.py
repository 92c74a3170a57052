"""Dependencies from manifests and lock files.

Each format is one expression from the text of a file to its packages, built
from string and array functions. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.text import line_array, trimmed

CARGO, NPM, PIP, GO, MAVEN = "cargo", "npm", "pip", "go", "maven"
YARN, PNPM, PIPFILE, POETRY = "yarn", "pnpm", "pipfile", "poetry"

# Ecosystem names used by advisory feeds.
ECOSYSTEM = {
    CARGO: "crates.io",
    NPM: "npm",
    PIP: "PyPI",
    GO: "Go",
    MAVEN: "Maven",
    YARN: "npm",
    PNPM: "npm",
    PIPFILE: "PyPI",
    POETRY: "PyPI",
}

# File-name endings of each kind, most specific first.
ENDINGS = (
    (POETRY, ("poetry.lock",)),
    (PIPFILE, ("pipfile.lock",)),
    (YARN, ("yarn.lock",)),
    (PNPM, ("pnpm-lock.yaml",)),
    (CARGO, ("cargo.lock",)),
    (NPM, ("package-lock.json", "package.json")),
    (PIP, ("requirements.txt", "requirements.in")),
    (GO, ("go.sum",)),
    (MAVEN, ("pom.xml",)),
)

UNKNOWN_VERSION = "unknown"


def manifest_kind(path: Column, code: Column, by_content: bool = True) -> Column:
    """Kind of a manifest, by name and then by content; NULL for any other file.

    With ``by_content=False`` only the path decides, and a columnar source does
    not have to read the text of the other files.
    """
    low = F.lower(F.coalesce(path, F.lit("")))

    def named(endings: tuple[str, ...]) -> Column:
        test = F.lit(False)
        for e in endings:
            test = test | F.endswith(low, F.lit(e))
        return test

    kind = F
    for name, endings in ENDINGS:
        kind = kind.when(named(endings), name)
    if not by_content:
        return kind
    has = lambda text: F.contains(code, F.lit(text))
    return (
        kind.when(has("[[package]]"), CARGO)
        .when(F.endswith(low, F.lit(".txt")) & has("=="), PIP)
        .when(F.endswith(low, F.lit(".xml")) & has("<groupId>"), MAVEN)
        .when(F.startswith(trimmed(code), F.lit("{")) & has('"dependencies"'), NPM)
        .when(has("<groupId>"), MAVEN)
    )


def _packages(items: Column, name, version) -> Column:
    """Name and version of each item; items that lack one are left out."""
    found = F.transform(items, lambda x: F.struct(name(x).alias("name"), version(x).alias("version")))
    return F.filter(found, lambda p: (p["name"] != "") & (p["version"] != ""))


def _lines(code: Column, pattern: str) -> Column:
    """Trimmed lines that match a pattern."""
    return F.filter(F.transform(line_array(code), trimmed), lambda line: line.rlike(pattern))


def _groups(items: Column, pattern: str) -> Column:
    """Packages from the first two groups of a pattern."""
    return _packages(
        items,
        lambda x: F.regexp_extract(x, pattern, 1),
        lambda x: F.regexp_extract(x, pattern, 2),
    )


def _setting(block: Column, key: str) -> Column:
    """Value of the last ``key = "value"`` line of a block."""
    return F.regexp_extract(block, rf'(?s)^(?:.*\n)?[ \t]*{key} = "*([^"\n]*)', 1)


def package_blocks(code: Column) -> Column:
    """``[[package]]`` blocks of a Cargo.lock or poetry.lock."""
    pieces = F.split(code, r"(?m)^[ \t]*\[\[package\]\][ \t]*\r?$", -1)
    return _packages(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda block: _setting(block, "name"),
        lambda block: _setting(block, "version"),
    )


def package_lock(code: Column) -> Column:
    """Installed packages of a ``package-lock.json``; nested paths keep their last name."""
    entries = F.map_entries(
        F.from_json(code, "STRUCT<packages: MAP<STRING, STRUCT<version: STRING>>>")["packages"]
    )
    return _packages(
        F.filter(entries, lambda e: F.contains(e["key"], F.lit("node_modules/"))),
        lambda e: F.substring_index(e["key"], "node_modules/", -1),
        lambda e: e["value"]["version"],
    )


def requirements(code: Column) -> Column:
    """A name, any extras, a comparison and its version; of several comparisons the first. Markers and comments are skipped."""
    name, extras = r"[A-Za-z0-9](?:[\w.\-]*[A-Za-z0-9])?", r"(?:\s*\[[^\]]*\])?"
    pattern = rf"^({name}){extras}\s*(?:===|~=|[<>=!]=|[<>])\s*([^\s,;#]+)"
    return _groups(_lines(code, pattern), pattern)


def go_sum(code: Column) -> Column:
    """Modules of a go.sum; the ``/go.mod`` line of a module folds into it."""
    pattern = r"^(\S+)\s+v([^\s/]+)"
    return F.array_distinct(_groups(_lines(code, pattern), pattern))


def pom_xml(code: Column) -> Column:
    """``group:artifact`` and version of every dependency element."""

    def element(block: Column, tag: str) -> Column:
        return trimmed(F.regexp_extract(block, rf"<{tag}>([^<]*)</{tag}>", 1))

    blocks = F.regexp_extract_all(code, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    return _packages(
        F.filter(blocks, lambda b: element(b, "artifactId") != ""),
        lambda b: F.concat_ws(
            ":", F.nullif(element(b, "groupId"), F.lit("")), element(b, "artifactId")
        ),
        lambda b: F.coalesce(F.nullif(element(b, "version"), F.lit("")), F.lit(UNKNOWN_VERSION)),
    )


def yarn_lock(code: Column) -> Column:
    """Entries of a yarn.lock: a ``name@range:`` head and its ``version`` line."""
    return _packages(
        F.split(code, r"\r?\n\s*\r?\n"),
        lambda e: F.regexp_extract(e, r'(?m)^"?((?:@[^/@\s"]+/)?[^@\s"#]+)@[^\n]*:\s*$', 1),
        lambda e: F.regexp_extract(e, r'(?m)^\s+version:?\s+"?([^"\s]+)"?', 1),
    )


def pnpm_lock(code: Column) -> Column:
    """Keys such as ``/name@1.2.3:`` or ``/name/1.2.3:`` of a pnpm lock file."""
    pattern = r"^['\"]?/?((?:@[^/@\s]+/)?[^/@\s'\"]+)[@/](\d[^(:\s'\"_]*)[^:\s]*['\"]?:"
    return F.array_distinct(_groups(_lines(code, pattern), pattern))


def pipfile_lock(code: Column) -> Column:
    """Pinned packages of the default and develop sections."""
    section = "MAP<STRING, STRUCT<version: STRING>>"
    doc = F.from_json(code, f"STRUCT<`default`: {section}, develop: {section}>")
    none = F.array().cast("array<struct<key:string,value:struct<version:string>>>")
    part = lambda name: F.coalesce(F.map_entries(doc.getField(name)), none)
    return _packages(
        F.concat(part("default"), part("develop")),
        lambda e: e["key"],
        lambda e: F.regexp_replace(e["value"]["version"], r"^[=\s]+", ""),
    )


PARSERS = {
    CARGO: package_blocks,
    NPM: package_lock,
    PIP: requirements,
    GO: go_sum,
    MAVEN: pom_xml,
    YARN: yarn_lock,
    PNPM: pnpm_lock,
    PIPFILE: pipfile_lock,
    POETRY: package_blocks,
}


def _exploded(manifests: DataFrame, kinds: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    kind, code = F.col("kind"), F.col("code")
    found = ecosystem = F
    for k in kinds:
        found = found.when(kind == k, PARSERS[k](code))
        ecosystem = ecosystem.when(kind == k, ECOSYSTEM[k])
    return manifests.where(kind.isin(*kinds)).select(
        *keep, F.col("path").alias("file_path"), ecosystem.alias("ecosystem"), F.explode(found).alias("p")
    ).select(*keep, "file_path", "p.name", "p.version", "ecosystem")


def parse(files: DataFrame, kind: str) -> DataFrame:
    """Dependencies of files that are all of one kind."""
    return _exploded(files.select("path", "code", F.lit(kind).alias("kind")), (kind,))


def extract_dependencies(
    files: DataFrame,
    kinds: tuple[str, ...] = tuple(PARSERS),
    by_content: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Dependencies of every manifest among the files, each format by its parser.

    One pass over the files: the kind selects the parser inside the row.
    """
    kind = manifest_kind(F.col("path"), F.col("code"), by_content)
    return _exploded(files.select(*keep, "path", "code", kind.alias("kind")), kinds, keep)


def distinct_dependencies(dependencies: DataFrame) -> DataFrame:
    """One row per file, module and version."""
    return dependencies.dropDuplicates(["file_path", "name", "version", "ecosystem"])
