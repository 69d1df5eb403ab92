"""Package directories, and lines of code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import golang as go

DIR_KEY = ["module", "version", "dir"]


def file_facts(files: DataFrame) -> DataFrame:
    """(module, version, dir, name, size, package_word, code_lines) of every Go file, in one scan.

    A hundred bytes or so per file. ``packages`` and ``loc`` take this table in place of the files,
    so that both together read the text once.
    """
    return files.filter(F.col("ext") == ".go").select(
        *DIR_KEY, "name", F.octet_length("content").cast("long").alias("size"),
        go.first_package_word(F.col("content")).alias("package_word"),
        go.code_lines(F.col("content")).alias("code_lines"))


def _facts(files_or_facts: DataFrame) -> DataFrame:
    return files_or_facts if "package_word" in files_or_facts.columns else file_facts(files_or_facts)


def packages(files: DataFrame) -> DataFrame:
    """(module, version, dir, package_name) of every directory some Go file names a package in.

    The first file by name whose raw text mentions ``package <word>`` names the whole directory.
    A minimum per directory, combined before the shuffle, so a huge directory costs one row per task.
    """
    word = F.col("package_word")
    return (
        _facts(files).groupBy(DIR_KEY)
        .agg(F.min_by(word, F.when(word != "", F.col("name"))).alias("package_name"))
        .filter(F.col("package_name") != ""))


def loc(files: DataFrame) -> DataFrame:
    """(module, version, loc): lines of Go that hold more than blanks and comments.

    Counted per file during the scan; only one number per module and task is shuffled.
    """
    return _facts(files).groupBy("module", "version").agg(F.sum("code_lines").alias("loc"))
