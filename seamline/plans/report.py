"""Reports over the occurrence table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline import schema
from seamline.functions import text
from seamline.operators import registry

MODULE_KEY = ["module", "version"]
NOTHING_FOUND = "No occurrences found."


def vector_names() -> list[str]:
    return [*schema.VECTOR_NAMES, *registry.names()]


def overview(modules: DataFrame, loc: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per module-version: dependants, lines, and ``n_<vector>`` for every vector.

    ``modules`` has module, version, dependants; modules without a line count are dropped, modules
    without occurrences stay with zeros. All sides have one row per module (and vector).
    """
    wide = counts.groupBy(MODULE_KEY).agg(*[
        F.max(F.when(F.col("vector") == v, F.col("n"))).alias(f"n_{v}") for v in vector_names()])
    zero_filled = [F.coalesce(f"n_{v}", F.lit(0)).cast("long").alias(f"n_{v}") for v in vector_names()]
    return (
        modules.join(loc, MODULE_KEY, "inner")
        .join(wide, MODULE_KEY, "left")
        .select(*MODULE_KEY, "dependants", "loc", *zero_filled))


def per_line(n: Column, loc: Column) -> Column:
    """Occurrences per line of code; NULL where there are no lines."""
    return F.when(loc > 0, n.cast("double") / loc)


def density(overview_rows: DataFrame) -> DataFrame:
    """The overview with ``d_<vector>`` densities in place of the counts."""
    return overview_rows.select(
        *MODULE_KEY, "dependants", "loc",
        *[per_line(F.col(f"n_{v}"), F.col("loc")).alias(f"d_{v}") for v in vector_names()])


def summary(counts: DataFrame, modules: DataFrame) -> DataFrame:
    """One row per module-version and vector in report order, zeros shown, count right-aligned.

    Every row of ``modules`` (module, version) gets its lines, whether anything was found there or not.
    """
    grid = modules.select(MODULE_KEY).distinct().select(
        *MODULE_KEY, text.module_label(F.concat("module", F.lit("@"), "version")).alias("module_label"),
        F.inline(text.vector_rows(registry.vector_rows())))
    return (
        grid.join(counts, [*MODULE_KEY, "vector"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
        .select(
            *MODULE_KEY, "module_label", "ord", "vector",
            F.concat(F.lit("["), "code", F.lit("] "), "label", F.lit(":")).alias("label"),
            "n", F.format_string("%10d", "n").alias("shown")))


def detail_lines(occurrence_rows: DataFrame) -> DataFrame:
    """One report line per occurrence, duplicates kept, with its link and place in the report."""
    return (
        occurrence_rows
        .withColumn("ord", text.vector_order(registry.vector_rows()))
        .filter(F.col("ord").isNotNull())
        .select(*MODULE_KEY, "ord", "vector", "file_path", "line_number",
                text.detail_link().alias("link"), text.detail_text().alias("line")))


def module_details(modules: DataFrame, loc: DataFrame, counts: DataFrame,
                   occurrence_rows: DataFrame) -> DataFrame:
    """The detail report as rows: per module-version and vector a heading with count and density,
    and one row per occurrence, or one that says nothing was found.

    The report is kept in long form, since a module can hold any share of all occurrences: nothing
    gathers a module's list in one place. Sort by module, version, ord, file_path, line_number to
    print it.
    """
    heads = (
        modules.join(loc, MODULE_KEY, "inner")
        .select(*MODULE_KEY, "loc", F.inline(text.vector_rows(registry.vector_rows())))
        .join(counts, [*MODULE_KEY, "vector"], "left")
        .select(*MODULE_KEY, "vector", "ord",
                F.concat(F.lit("["), "code", F.lit("] "), "report_label").alias("heading"),
                F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                per_line(F.coalesce("n", F.lit(0)), F.col("loc")).alias("density")))
    found = detail_lines(occurrence_rows).select(
        *MODULE_KEY, "vector", "file_path", "line_number", "line")
    # Occurrences stay where they are and the headings, a few rows per module, come to them; the
    # vectors without any row are added afterwards.
    lines = found.join(heads, [*MODULE_KEY, "vector"], "inner")
    empty = (
        heads.filter(F.col("n") == 0)
        .withColumn("file_path", F.lit("")).withColumn("line_number", F.lit(0))
        .withColumn("line", F.lit(NOTHING_FOUND)))
    columns = [*MODULE_KEY, "ord", "heading", "n", "density", "file_path", "line_number", "line"]
    return lines.select(columns).unionByName(empty.select(columns))


def occurrence_json(occurrence_rows: DataFrame) -> DataFrame:
    return occurrence_rows.select(*MODULE_KEY, text.occurrence_json().alias("json"))
