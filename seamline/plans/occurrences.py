"""From files to the occurrence table, and its distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline import schema
from seamline.operators import registry
from seamline.operators.bounds import settle
from seamline.operators.chunks import CHUNK_CHARS
from seamline.operators.detectors import DIR_KEY, PLACE, detect
from seamline.operators.packages import packages
from seamline.operators.segments import segments


def occurrences(files: DataFrame, vectors: list[str] | None = None, *,
                exec_rules: DataFrame | None = None, facts: DataFrame | None = None,
                partitions: int | None = None, large_bytes: int | None = None, chunk_chars: int = CHUNK_CHARS,
                places: bool = False) -> DataFrame:
    """One row per place where a vector occurs, duplicates kept.

    Directories that name no package are not analysed. Names are joined to the few occurrences, not
    to the files, so the text of a large directory is never shuffled by directory. Function
    literals called at initialisation carry no package name.

    ``facts`` is ``file_facts(files)`` where that is at hand; it saves a scan of the text.
    ``vectors`` may name registered detectors too; by default all built-in and registered ones run. Files of
    ``large_bytes`` and more, where given, are read in pieces of ``chunk_chars`` by as many tasks. With ``places`` the
    rows also have dir, path and pos, by which ``plans.ordering`` puts them in order.
    """
    names = vectors or [*schema.VECTOR_NAMES, *registry.names()]
    builtin = [v for v in names if v in schema.VECTOR_NAMES]
    custom = registry.conditions(names)
    functions = [v for v in names if v not in schema.VECTOR_NAMES and v not in custom]
    shared = settle(segments(files, partitions, large_bytes, chunk_chars)) if functions else None
    found = [detect(files, builtin, exec_rules=exec_rules, custom=custom, partitions=partitions, large_bytes=large_bytes,
                    chunk_chars=chunk_chars, rows=shared)] if builtin or custom else []
    found += [registry.run(v, shared) for v in functions]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    literal = (F.col("vector") == "global") & (F.col("method_invoked") == "anonym func")
    return (
        rows.join(packages(files if facts is None else facts), DIR_KEY, "inner")
        .withColumn("package_name", F.when(literal, "").otherwise(F.col("package_name")))
        .select(schema.OCCURRENCE_COLUMNS + (["dir", *PLACE] if places else [])))


def distinct_key() -> Column:
    """Text that two occurrences of a vector share exactly when they count once."""
    keys = {**schema.DISTINCT_KEYS, **registry.key_columns()}
    out = F.lit(None).cast("string")
    for vector, columns in keys.items():
        key = F.concat_ws(":", *[F.col(c).cast("string") for c in columns])
        out = F.when(F.col("vector") == vector, key).otherwise(out)
    return out


def unique_counts(occurrence_rows: DataFrame) -> DataFrame:
    """(module, version, vector, n): distinct occurrences; unknown vectors are ignored.

    Duplicates are removed within each task and then by full key before anything is counted per
    module, so a module with most of the rows is still spread over all tasks.
    """
    return (
        occurrence_rows
        .select("module", "version", "vector", distinct_key().alias("key"))
        .filter(F.col("key").isNotNull())
        .groupBy("module", "version", "vector")
        .agg(F.count_distinct("key").alias("n")))
