"""Source files of a folder of packages as a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators.shared import module_path

#: Paths that hold generated code.
SKIPPED = r"/(generated|build)/|_generated\.rs$"


def read_workspace(spark: SparkSession, folder: str, suffix: str = ".rs") -> DataFrame:
    """(package, path, module_path, text, line_count, error) of the files under ``<package>/src/`` of a folder.

    Generated code is left out. A file that is not UTF-8 text, or whose brackets
    do not balance, stays, with its error named, so that its annotations are
    still read; its items are for the reader of ``error is null``. Files are
    read whole and in parallel through Spark's own source; the path begins with
    the package's folder.
    """
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    at = F.regexp_replace(F.url_decode("_metadata.file_path"), rf"^.*?/\Q{root}\E/", "")
    files = raw.select(at.alias("path"), F.col("value").alias("text"))
    files = files.where(F.col("path").rlike(r"^[^/]+/src/") & ~F.concat(F.lit("/"), "path").rlike(SKIPPED))
    # brackets outside of strings and line comments
    plain = F.regexp_replace("text", r'(?s)r#".*?"#|"(?:\\.|[^"\\])*"|' + r"'(?:\\.|[^'\\])'" + r"|//[^\n]*", "")
    count = lambda c: F.length(plain) - F.length(F.translate(plain, c, ""))
    uneven = (count("{") != count("}")) | (count("(") != count(")")) | (count("[") != count("]"))
    package = F.substring_index("path", "/", 1)
    lines = F.size(F.split(F.regexp_replace("text", r"\n$", ""), "\n"))
    return files.select(
        package.alias("package"), "path", module_path(F.col("path"), package).alias("module_path"), "text", lines.alias("line_count"),
        F.when(~F.is_valid_utf8("text"), "not UTF-8").when(uneven, "unbalanced brackets").alias("error"),
    )
