"""Functions defined in assembly files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline import schema

# Fixed value: an assembly function's first definition, with ASCII word classes.
SIGNATURE = r"TEXT[\t\n\f\r ]+·([A-Za-z1-9]+[A-Za-z0-9_]*)"


def asm_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("ext").isin(schema.ASM_EXTENSIONS))


def asm_functions(files: DataFrame) -> DataFrame:
    """(module, version, dir, name) of the first function in each assembly file, distinct."""
    return (
        asm_files(files)
        .select("module", "version", "dir", F.regexp_extract("content", SIGNATURE, 1).alias("name"))
        .filter(F.col("name") != "")
        .distinct())
