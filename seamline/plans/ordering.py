"""Occurrences in the order of a walk over the source tree, numbered, and lists of them in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions import text
from seamline.operators.bounds import settle

LIST_KEY = ["module", "version", "vector"]
PAGE_ROWS = 1000


def walk_key() -> list[Column]:
    """Place of an occurrence in a walk: directories before what they hold, and by names, not by the whole path.

    A directory ``a`` comes before ``a/b``, and that before ``a-b``, though its path sorts behind. In a
    directory files follow by name, in a file occurrences by position; the calls of one chain in the order of the text.
    """
    return [F.split("dir", "/").alias("dir_names"), F.substring_index("path", "/", -1).alias("file_name"), F.col("pos")]


def numbered(rows: DataFrame, group: list[str], order: list[Column | str], out: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """Adds ``out``: the number of a row in its group by ``order``, from 1. A group may hold any share of the rows.

    The rows are cut into ranges of group and order; each range numbers its own, and a row for each range and group tells how many
    of the group come before. Rows equal in ``order`` are numbered in any way, but once: the ranges are settled.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = rows.withColumns({f"_order{i}": c for i, c in enumerate(keys)})
    by = [f"_order{i}" for i in range(len(keys))]
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(named.repartitionByRange(n, *group, *by).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*group, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy(*group, "_range").orderBy(*by)
    return ranged.withColumn("_own", F.row_number().over(within)).join(starts, [*group, "_range"]).withColumn(
        out, (F.col("_start") + F.col("_own")).cast("bigint")).drop("_own", "_start", "_range", *by)


def in_walk_order(placed_occurrences: DataFrame, partitions: int | None = None) -> DataFrame:
    """Occurrences with ``ordinal``, their number in their list: that of a module-version and vector.

    Takes the result of ``occurrences(..., places=True)``.
    """
    ties = ["line_number", "variable_name", "method_invoked", "type_passed", "pattern", "command"]
    return numbered(placed_occurrences, LIST_KEY, [*walk_key(), *ties], partitions=partitions)


def detail_pages(ordered: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The lists of the detail report, each cut into pages: module, version, vector, page (from 0), first_ordinal, entries.

    ``entries`` is an array of at most ``page_rows`` rows (ordinal, file_path, line_number, link, line) in order. Pages follow from
    ordinals, so that the list of one module is spread over as many groups as it has pages.
    """
    entry = F.struct("ordinal", "file_path", "line_number", text.detail_link().alias("link"), text.detail_text().alias("line"))
    page = ((F.col("ordinal") - 1) / page_rows).cast("bigint")
    return ordered.select(*LIST_KEY, page.alias("page"), entry.alias("entry")).groupBy(*LIST_KEY, "page").agg(
        F.array_sort(F.collect_list("entry")).alias("entries")).select(
        *LIST_KEY, "page", F.col("entries")[0]["ordinal"].alias("first_ordinal"), "entries")
