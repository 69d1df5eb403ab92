"""Analysis whose cost follows the distinct texts: versions of a module share most of their files.

Every text is cut and searched once, however many files hold it, and what is found is carried over to those files by a join on the
text's digest. What depends on a file's place is decided after that: its path and package, and which names its directory's
assembly defines. Whether a path ends in ``_test.go`` decides what is looked for, so it is part of what tells texts apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline import schema
from seamline.operators import registry
from seamline.operators.assembly import asm_functions
from seamline.operators.bounds import settle
from seamline.operators.detectors import DIR_KEY, PLACE, TEXT_FIELDS, detect
from seamline.operators.packages import packages
from seamline.operators.segments import lexed, structured

_TEST = "_test.go"


def _text_key() -> Column:
    """A name for the text of a Go file, with the part of the path that matters to the search."""
    return F.concat(F.sha2(F.col("content"), 256), F.when(F.endswith("path", F.lit(_TEST)), _TEST).otherwise(".go"))


def text_index(files: DataFrame) -> DataFrame:
    """(module, version, dir, path, text_key) of every Go file, in one scan that keeps a digest of each text."""
    return files.filter((F.col("ext") == ".go") & F.col("content").isNotNull()).select(*DIR_KEY, "path", _text_key().alias("text_key"))


def distinct_texts(files: DataFrame) -> DataFrame:
    """A table of files that holds every text once, under its key as path.

    Equal texts of a task are one before the exchange, which is the one that the windows over files need.
    """
    empty = F.lit("")
    return files.filter((F.col("ext") == ".go") & F.col("content").isNotNull()).select(
        empty.alias("module"), empty.alias("version"), empty.alias("dir"), _text_key().alias("path"), _text_key().alias("name"), "ext",
        "content").dropDuplicates(["module", "version", "path"])


def shared_occurrences(files: DataFrame, vectors: list[str] | None = None, *, facts: DataFrame | None = None,
                       exec_rules: DataFrame | None = None, places: bool = False) -> DataFrame:
    """What ``plans.occurrences.occurrences`` gives, with each distinct text analysed once.

    Detectors that are functions see segments of texts without module, version and directory.
    """
    names = vectors or [*schema.VECTOR_NAMES, *registry.names()]
    builtin = [v for v in names if v in schema.VECTOR_NAMES]
    custom = registry.conditions(names)
    functions = [v for v in names if v not in schema.VECTOR_NAMES and v not in custom]
    rows = structured(lexed(distinct_texts(files), 0))
    rows = settle(rows) if functions else rows
    found = detect(files, builtin, exec_rules=exec_rules, custom=custom, rows=rows, listed_assembly=False)
    for v in functions:
        found = found.unionByName(registry.run(v, rows))
    if "assembly" in builtin:
        asm = asm_functions(files)
        # First any name that some assembly defines, so that few calls are carried over; then those of the directory.
        known = asm.select(F.col("name").alias("method_invoked")).distinct().withColumn("known", F.lit(True))
        found = found.join(known, "method_invoked", "left").filter((F.col("vector") != "assembly") | F.col("known")).drop("known")
    found = found.drop(*DIR_KEY).withColumnRenamed("path", "text_key")
    carried = found.join(text_index(files), "text_key")
    # The search named the text by its key, which the path of the file replaces.
    own = F.concat("path", F.expr("substring(file_path, length(text_key) + 1)"))
    carried = carried.withColumn("file_path", F.when(F.startswith("file_path", F.col("text_key")), own).otherwise(F.col("file_path")))
    if "assembly" in builtin:
        here = asm.select(*DIR_KEY, F.col("name").alias("method_invoked")).distinct().withColumn("here", F.lit(True))
        carried = carried.join(here, [*DIR_KEY, "method_invoked"], "left").filter((F.col("vector") != "assembly") | F.col("here")).drop("here")
    literal = (F.col("vector") == "global") & (F.col("method_invoked") == "anonym func")
    carried = carried.select(*DIR_KEY, *PLACE, "vector", "file_path", "line_number", *TEXT_FIELDS)
    return (
        carried.join(packages(files if facts is None else facts), DIR_KEY, "inner")
        .withColumn("package_name", F.when(literal, "").otherwise(F.col("package_name")))
        .select(schema.OCCURRENCE_COLUMNS + (["dir", *PLACE] if places else [])))
