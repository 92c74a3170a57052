"""Comparable keys of versions, by the grammar of each ecosystem.

A key is text that sorts as the version does. Keys of different ecosystems are never compared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sorts after every key; the empty text sorts before.
OPEN_END = "~"
# Marks between the release and what follows, in the order in which they sort:
# a prerelease, the release itself, a later build of it, further release parts.
BEFORE, RELEASE, AFTER = "!", "+", ","

VERSION = r"^[vV=]*(\d+(?:\.\d+)*)(.*)$"
# Words that name the release itself, later builds of it, and stages before it.
RELEASE_WORDS = ("final", "ga", "release")
AFTER_WORDS = ("post", "sp", "patch")
STAGES = {"dev": "0dev", "a": "alpha", "b": "beta", "m": "milestone", "c": "rc", "cr": "rc", "pre": "rc", "preview": "rc"}

# Ecosystems whose versions follow SemVer 2.
SEMVER = ("npm", "crates.io", "Go", "Hex", "Pub", "SwiftURL", "NuGet")
SEMVER_PARTS = r"^\s*[vV=]*(\d+(?:\.\d+)*)-?([^+]*?)(?:\+.*)?\s*$"

# The version grammar of Python packages. Groups: epoch, release, stage and its number, a bare later
# build, a later build by word and its number, a development build and its number, local part.
PYTHON_PARTS = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)

# Maven qualifiers before the release in their order, and the one right after it.
MAVEN_BEFORE = {"alpha": "0", "beta": "1", "milestone": "2", "rc": "3", "cr": "3", "snapshot": "4"}
MAVEN_AFTER = "sp"


def _number(digits: Column) -> Column:
    """Digits as text that sorts as the number does, however many there are."""
    bare = F.regexp_replace(digits, "^0+", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), 6, "0"), bare)


def general_key(version: Column) -> Column:
    """Versions of ecosystems without a grammar of their own; NULL when one does not begin with a number.

    Release parts compare as numbers of any length, and trailing zero parts are dropped, so
    ``1.2`` equals ``1.2.0``. What follows is cut into words and numbers: stages come before the
    release, ``.post1`` and ``-sp`` after it, and build data after a plus says nothing.
    """
    rest = F.lower(F.regexp_replace(F.regexp_extract(version, VERSION, 2), r"\+.*$", ""))
    apart = F.regexp_replace(F.regexp_replace(rest, r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", "."), r"[^a-z0-9]+", ".")
    words = F.filter(F.split(apart, r"\."), lambda w: (w != "") & ~w.isin(*RELEASE_WORDS))
    stage = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    keyed = F.transform(
        words,
        lambda w: F.when(w.rlike(r"^\d+$"), F.concat(F.lit("0"), _number(w))).otherwise(
            F.concat(F.lit("1"), F.coalesce(F.try_element_at(stage, w), w))
        ),
    )
    later = F.get(words, F.lit(0)).isin(*AFTER_WORDS)
    mark = F.when(F.size(words) == 0, F.lit(RELEASE)).when(later, F.lit(AFTER)).otherwise(F.lit(BEFORE))
    return F.when(
        version.rlike(VERSION), F.concat(_release(F.regexp_extract(version, VERSION, 1)), mark, F.array_join(keyed, " "))
    )


def _release(numbers: Column) -> Column:
    """Dotted numbers without the zeros at their end."""
    bare = F.regexp_replace(numbers, r"(?:\.0+)+$", "")
    return F.array_join(F.transform(F.split(bare, r"\."), _number), ".")


def semver_key(version: Column, fold: Column | None = None) -> Column:
    """SemVer 2: identifiers of a prerelease compare in turn, numbers as such and before words, words by ASCII;
    of two alike the shorter comes first; a prerelease comes before its release; build data says nothing.

    Fewer than three numbers are allowed, and zeros at their end dropped. ``fold`` says whose case says nothing.
    """
    stage = F.regexp_extract(version, SEMVER_PARTS, 2)
    if fold is not None:
        stage = F.when(fold, F.lower(stage)).otherwise(stage)
    each = F.transform(
        F.split(stage, r"\."),
        lambda w: F.when(w.rlike(r"^\d+$"), F.concat(F.lit("0"), _number(w))).otherwise(F.concat(F.lit("1"), w)),
    )
    tail = F.when(stage == "", F.lit(RELEASE)).otherwise(F.concat(F.lit(BEFORE), F.array_join(each, " ")))
    return F.when(version.rlike(SEMVER_PARTS), F.concat(_release(F.regexp_extract(version, SEMVER_PARTS, 1)), tail))


def python_key(version: Column) -> Column:
    """PEP 440: epoch, release, stage, later build, development build, local part; NULL for anything else.

    A development build alone comes before all stages, one of a stage before that stage. Each field's
    key is as long as it says or ends its text, so fields compare one after another.
    """
    low = F.lower(version)
    # the pattern is tried once for all of its groups, none of which can hold the mark between them
    groups = F.split(F.regexp_replace(low, PYTHON_PARTS, "\x01".join(f"${i}" for i in range(1, 11))), "\x01", -1)
    key = F.get(F.transform(F.array(groups), _python_key), F.lit(0))
    return F.when(low.rlike(PYTHON_PARTS), key)


def _python_key(groups: Column) -> Column:
    part = lambda i: F.get(groups, F.lit(i - 1))
    stage, dev = part(3), part(8) != ""
    post = (part(5) != "") | (part(6) != "")
    letter = F.when(stage.isin("a", "alpha"), "a").when(stage.isin("b", "beta"), "b").otherwise("c")
    before = (
        F.when(stage != "", F.concat(F.lit("1"), letter, _number(part(4))))
        .when(dev & ~post, F.lit("0")).otherwise(F.lit("2"))
    )
    later = F.when(post, F.concat(F.lit("1"), _number(F.concat(part(5), part(7))))).otherwise(F.lit("0"))
    build = F.when(dev, F.concat(F.lit("0"), _number(part(9)))).otherwise(F.lit("1"))
    local = F.transform(
        F.split(part(10), r"[-_.]"),
        lambda w: F.when(w.rlike(r"^\d+$"), F.concat(F.lit("1"), _number(w))).otherwise(F.concat(F.lit("0"), w)),
    )
    ending = F.when(part(10) == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.array_join(local, " ")))
    return F.concat(_number(part(1)), F.lit("!"), _release(part(2)), F.lit(" "), before, later, build, ending)


def maven_key(version: Column) -> Column:
    """Maven: tokens between dots, hyphens and changes of digits to letters; NULL when it does not begin with a number.

    Zeros and words for the release at the end, or in front of a hyphen, are dropped. Then tokens compare in turn:
    known stages, the end, ``sp``, other words, numbers behind a hyphen, numbers behind a dot.
    """
    low = F.lower(F.regexp_replace(version, r"^\s*[vV]|\s+$", ""))
    for letter, word in (("a", "alpha"), ("b", "beta"), ("m", "milestone")):
        low = F.regexp_replace(low, rf"(?<![a-z]){letter}(?=\d)", word)
    low = F.regexp_replace(low, r"(?<=\d)(?=[^\d.\-])|(?<=[^\d.\-])(?=\d)", "-")
    low = F.regexp_replace(low, r"(?<=[.\-])(?=[.\-]|$)", "0")
    low = F.regexp_replace(low, rf"(?:[.\-](?:0+|{'|'.join(RELEASE_WORDS)}))+(?=-|$)", "")
    before = F.create_map(*[F.lit(x) for word, place in MAVEN_BEFORE.items() for x in (word, f"A{place}")])

    def token(t: Column) -> Column:
        word = F.regexp_replace(t, r"^[.\-]", "")
        number = F.concat(F.when(F.startswith(t, F.lit("-")), F.lit("E")).otherwise(F.lit("F")), _number(word))
        named = F.when(word == MAVEN_AFTER, F.lit("C")).when(word.isin(*RELEASE_WORDS), F.lit("B"))
        return F.when(word.rlike(r"^\d+$"), number).otherwise(
            F.coalesce(F.try_element_at(before, word), named, F.concat(F.lit("D"), word, F.lit(" ")))
        )

    tokens = F.regexp_extract_all(low, F.lit(r"[.\-]?[^.\-]+"), F.lit(0))
    return F.when(version.rlike(r"^\s*[vV]?\d"), F.concat(F.array_join(F.transform(tokens, token), ""), F.lit("B")))


def version_key(version: Column, ecosystem: Column | None = None) -> Column:
    """Text that sorts as the version does in its ecosystem; NULL when the version has no place there."""
    if ecosystem is None:
        return general_key(version)
    return (
        F.when(ecosystem.isin(*SEMVER), semver_key(version, ecosystem == "NuGet"))
        .when(ecosystem == "PyPI", python_key(version))
        .when(ecosystem == "Maven", maven_key(version))
        .otherwise(general_key(version))
    )


def in_range(key: Column, low: Column, high: Column, closed: Column | None = None) -> Column:
    """Whether a key lies in [low, high), or in [low, high] where ``closed``."""
    below = key < high
    return (key >= low) & (below if closed is None else below | (closed & (key == high)))
