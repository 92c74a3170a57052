"""Code trees and single files as ``files`` rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.functions.languages import language_from_ext
from lynceus.functions.text import extension, file_name
from lynceus.operators.manifests import ENDINGS
from lynceus.scale import work_dir

# Folders that hold no source of their own.
PRUNED_FOLDERS = (".git", "node_modules", "target", ".venv", "__pycache__", "dist", "build")

# Extensions of scannable text files.
SCANNABLE_EXTENSIONS = (
    "py", "js", "mjs", "cjs", "ts", "tsx", "jsx", "rs", "go", "java", "cs", "cpp", "cc", "c",
    "h", "rb", "php", "swift", "kt", "kts", "yaml", "yml", "toml", "json", "xml", "env", "sh",
    "bash", "zsh", "cfg", "ini", "conf", "properties", "tf", "hcl", "dockerfile", "svelte", "vue",
)

# Files named like an extension, and manifests whose extension is not scannable.
SCANNABLE_NAMES = (".env", "dockerfile") + tuple(e for _, group in ENDINGS for e in group)

# Entries a task lists before it hands the folders that are left to other tasks.
ENTRIES_PER_TASK = 50_000
READ_BYTES = 16 * 1024 * 1024
BYTES_PER_TASK = 128 * 1024 * 1024


def in_pruned_folder(path: Column, folders: tuple[str, ...] = PRUNED_FOLDERS) -> Column:
    return F.exists(F.split(path, "/"), lambda part: part.isin(*folders))


def is_scannable(path: Column, extensions: tuple[str, ...] = SCANNABLE_EXTENSIONS) -> Column:
    by_extension = F.coalesce(F.lower(extension(path)).isin(*extensions), F.lit(False))
    return by_extension | F.lower(file_name(path)).isin(*SCANNABLE_NAMES)


def _decoded(raw: DataFrame) -> DataFrame:
    """Text of files that are valid UTF-8; :func:`tree_rejects` lists the others."""
    code = F.col("content").cast("string")
    ext = extension(F.col("path"))
    return raw.where(F.is_valid_utf8(code)).select(
        "path", code.alias("code"), language_from_ext(ext).alias("language"), ext.alias("ext")
    )


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def list_tree(
    spark: SparkSession, root: str, entries_per_task: int = ENTRIES_PER_TASK
) -> DataFrame:
    """Path and size of every file below a folder, pruned folders left out.

    Spark's own listing keeps the whole index on the driver and skips names
    that begin with a dot or an underscore, such as ``__init__.py``. Here each
    task walks folders and returns those it did not get to, which the next
    round deals out again. Every round is a written table.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, _ = _filesystem(root)
        for pdf in batches:
            for start in pdf["path"]:
                todo, rows, listed = [start], [], 0
                while todo and listed < entries_per_task:
                    for info in filesystem.get_file_info(pafs.FileSelector(todo.pop(), allow_not_found=True)):
                        listed += 1
                        if info.type == pafs.FileType.File:
                            rows.append((info.path, False, info.size))
                        elif info.base_name not in PRUNED_FOLDERS:
                            todo.append(info.path)
                rows += [(folder, True, 0) for folder in todo]
                yield pd.DataFrame(rows, columns=["path", "is_folder", "bytes"])

    schema = "path STRING, is_folder BOOLEAN, bytes BIGINT"
    base = work_dir(spark, "listing")
    folders = spark.createDataFrame([(_filesystem(root)[1],)], "path STRING")
    rounds = 0
    while True:
        out = f"{base}/round={rounds}"
        folders.mapInPandas(walk, schema).write.parquet(out)
        found = spark.read.schema(schema).parquet(out)
        folders = found.where("is_folder").select("path").repartition(
            spark.sparkContext.defaultParallelism * 4
        )
        rounds += 1
        if folders.isEmpty():
            break
    return spark.read.schema(schema).parquet(base).where("NOT is_folder").select("path", "bytes")


def _refusal(error: OSError) -> str | None:
    """Why a file can't be read whatever the attempt; None for errors worth another attempt."""
    if isinstance(error, PermissionError) or "ACCESS_DENIED" in str(error):
        return "permission denied"
    return "not found" if isinstance(error, FileNotFoundError) else None


def _contents(files: DataFrame, root: str, refuse: bool = True) -> DataFrame:
    """Bytes of listed files, read in tasks of similar size.

    With ``refuse`` a file that is gone or may not be read has a ``reason`` and no bytes.
    Any other error fails the task, which Spark tries again.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, _ = _filesystem(root)
        rows, size = [], 0
        for pdf in batches:
            for path in pdf["path"]:
                content, reason = None, None
                try:
                    with filesystem.open_input_stream(path) as stream:
                        content = stream.read()
                except OSError as error:
                    reason = _refusal(error)
                    if reason is None or not refuse:
                        raise
                rows.append((path, content, reason))
                size += len(content or b"")
                if size >= READ_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "content", "reason"])
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=["path", "content", "reason"])

    total = files.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, total // BYTES_PER_TASK)
    return files.select("path").repartition(int(tasks)).mapInPandas(
        read, "path STRING, content BINARY, reason STRING"
    )


def read_code_tree(
    spark: SparkSession,
    path: str,
    extensions: tuple[str, ...] = SCANNABLE_EXTENSIONS,
    max_bytes: int | None = None,
) -> DataFrame:
    """Every scannable text file below a folder.

    Folders, names and sizes are tested on the listing, so no other file is
    opened. What is left out of the scannable files is in :func:`tree_rejects`.
    """
    files = list_tree(spark, path).where(is_scannable(F.col("path"), extensions))
    if max_bytes is not None:
        files = files.where(F.col("bytes") <= max_bytes)
    return _decoded(_contents(files, path))


def tree_rejects(
    spark: SparkSession,
    path: str,
    extensions: tuple[str, ...] = SCANNABLE_EXTENSIONS,
    max_bytes: int | None = None,
) -> DataFrame:
    """Scannable files that :func:`read_code_tree` leaves out: path, bytes, reason.

    A list of its own, which reads the files within ``max_bytes`` once more.
    """
    files = list_tree(spark, path).where(is_scannable(F.col("path"), extensions))
    over = F.col("bytes") > max_bytes if max_bytes is not None else F.lit(False)
    large = files.where(over).select("path", "bytes", F.lit(f"over {max_bytes} bytes").alias("reason"))
    text = F.is_valid_utf8(F.col("content").cast("string"))
    bad = _contents(files.where(~over), path).select(
        "path",
        F.octet_length("content").cast("bigint").alias("bytes"),
        F.coalesce("reason", F.when(~text, "not UTF-8 text")).alias("reason"),
    )
    return large.unionByName(bad.where("reason IS NOT NULL"))


def read_code_files(
    spark: SparkSession,
    path: str,
    extensions: tuple[str, ...] = SCANNABLE_EXTENSIONS,
    max_bytes: int | None = None,
) -> DataFrame:
    """As :func:`read_code_tree` through Spark's binary file source.

    The tests on file metadata prune while the scan is planned. Names that
    begin with a dot or an underscore are not seen.
    """
    place = F.col("_metadata.file_path")
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .where(~in_pruned_folder(place) & is_scannable(place, extensions))
    )
    if max_bytes is not None:
        raw = raw.where(F.col("_metadata.file_size") <= max_bytes)
    return _decoded(raw)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file whatever its name. A missing file, or one that is no UTF-8 text, is an error."""
    _, place = _filesystem(path)
    files = spark.createDataFrame([(place, 0)], "path STRING, bytes BIGINT")
    code = F.col("content").cast("string")
    checked = F.when(F.is_valid_utf8(code), code).otherwise(
        F.raise_error(F.concat(F.lit("not UTF-8 text: "), F.col("path")))
    )
    ext = extension(F.col("path"))
    return _contents(files, path, refuse=False).select(
        "path", checked.alias("code"), language_from_ext(ext).alias("language"), ext.alias("ext")
    )
