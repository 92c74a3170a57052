"""Line splitting, trimming, paths and empty-text handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode White_Space characters, which a trimmed snippet loses.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def sql_text(text: str | None) -> str:
    """A Spark SQL string literal."""
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_map(table: dict[str, str]) -> Column:
    """A constant map column."""
    return F.expr(f"map({', '.join(sql_text(t) for pair in table.items() for t in pair)})")


def trimmed(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def trimmed_line(col: Column) -> Column:
    """:func:`trimmed` of a column at hand: what begins and ends with a visible ASCII character is not searched for white space."""
    visible = lambda c: (c > F.lit(" ")) & (c < F.lit("\x7f"))
    return F.when(visible(F.left(col, F.lit(1))) & visible(F.right(col, F.lit(1))), col).otherwise(trimmed(col))


def replaced(text: Column, old: str, new: str) -> Column:
    """A text with ``old`` replaced; one that does not hold it only pays for the test, several times cheaper than a search to replace."""
    return F.when(F.contains(text, F.lit(old)), F.replace(text, F.lit(old), F.lit(new))).otherwise(text)


def line_array(code: Column) -> Column:
    """Lines of a text: LF or CRLF ends a line, the last end makes no empty line.

    CRLF is folded with a plain replace and LF is a one-character separator, so
    neither step runs the regex engine.
    """
    text = replaced(code, "\r\n", "\n")
    text = F.when(
        F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)
    ).otherwise(text)
    return F.when(code != "", F.split(text, "\n", -1))


def to_lines(files: DataFrame, col: str = "code") -> DataFrame:
    """One row per line, numbered from 1; every other column is kept."""
    keep = [c for c in files.columns if c != col]
    return files.select(
        *keep, F.posexplode(line_array(F.col(col))).alias("line_pos", "line")
    ).select(*keep, (F.col("line_pos") + 1).alias("line_no"), "line")


def extension(path: Column) -> Column:
    """Last dotted suffix of the file name, NULL for dotfiles and bare names."""
    return F.nullif(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1), F.lit(""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def none_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def empty_if_none(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _bare_hash(line: Column) -> Column:
    bare = replaced(replaced(replaced(line, " ", ""), "\t", ""), "\r", "")
    return F.when(line.isNotNull(), F.xxhash64(bare))


def neighbours_hash(before: Column, after: Column) -> Column:
    """A hash of the lines before and after a line without white space; either may be absent."""
    return F.xxhash64(_bare_hash(before), _bare_hash(after))


def with_neighbours(lines: Column) -> Column:
    """Structs (line, before, after) of an array of lines."""
    none = F.array(F.lit(None).cast("string"))
    before = F.concat(none, F.slice(lines, F.lit(1), F.size(lines) - 1))
    after = F.concat(F.slice(lines, F.lit(2), F.size(lines)), none)
    return F.arrays_zip(lines.alias("line"), before.alias("before"), after.alias("after"))


def line_contexts(code: Column) -> Column:
    """For each line of :func:`line_array` the :func:`neighbours_hash`."""
    hashes = F.transform(line_array(code), _bare_hash)
    none = F.array(F.lit(None).cast("bigint"))
    # bound once: lambdas would make the hashes again for each line
    return F.transform(
        F.array(hashes),
        lambda h: F.zip_with(F.concat(none, h), F.concat(F.slice(h, 2, F.size(h)), none), lambda a, b: F.xxhash64(a, b)),
    )[0]
