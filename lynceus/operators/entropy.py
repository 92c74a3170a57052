"""High-entropy literals as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.functions.entropy import ASSIGNED_LITERAL, THRESHOLD, assigned_literals, entropy
from lynceus.functions.text import to_lines


def random_literals(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Assigned literals above an entropy, with their place and bits per character.

    Only lines with a candidate leave the line split, and the entropy of a
    literal is folded inside its row.
    """
    lines = to_lines(files.select("path", "code")).where(
        (F.contains("line", F.lit("'")) | F.contains("line", F.lit('"')))
        & F.col("line").rlike("(?dU)" + ASSIGNED_LITERAL)
    )
    found = lines.select(
        F.col("path").alias("file_path"),
        F.col("line_no").alias("line_start"),
        F.explode(assigned_literals(F.col("line"))).alias("literal"),
    ).withColumn("bits", entropy(F.col("literal")))
    return found.where(F.col("bits") > threshold)
