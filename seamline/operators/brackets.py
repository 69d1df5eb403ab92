"""A table of bracket pairs: where each bracket opens and closes, how deep, and whether the two fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.operators.segments import FILE_KEY, lexed, so_far

KINDS = {"(": "round", "[": "square", "{": "curly"}


def bracket_pairs(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """(module, version, path, depth, nth, opens, closes, open_pos, close_pos, open_line, close_line, fits).

    The n-th bracket that opens at a depth of a file belongs to the n-th that closes there. A bracket without partner has NULL on
    the other side, and does not fit. ``depth`` is 1 for brackets of the top level; it falls below 1 where more close
    than open. Lines are physical, positions are those of the segments that end with the bracket.

    One exchange by file, which both windows keep: one by file for depths and lines, and one by file and depth, in which
    openers and closers take turns, so that a partner is the row before.
    """
    opens = F.col("step") > 0
    placed = lexed(files, partitions).select(
        *FILE_KEY, "pos", "core", "step", F.sum("step").over(so_far()).alias("after"),
        (F.sum("nl").over(so_far()) + 1).cast("int").alias("line")).filter("step <> 0").withColumn(
        "depth", F.when(opens, F.col("after")).otherwise(F.col("after") + 1).cast("int"))
    at_depth = W.partitionBy(*FILE_KEY, "depth").orderBy("pos")
    here = F.struct("core", "pos", "line", "step")
    paired = placed.select("*", F.lag(here).over(at_depth).alias("last"), F.lead(here).over(at_depth).alias("next"),
                           F.sum(F.when(opens, 1).otherwise(0)).over(at_depth.rowsBetween(W.unboundedPreceding, 0)).cast("int").alias("nth"))
    # A closer speaks for its pair, an opener only where none follows, and a closer without opener stands alone.
    closed = ~opens & F.coalesce(F.col("last.step") > 0, F.lit(False))
    lost = opens & ~F.coalesce(F.col("next.step") < 0, F.lit(False))
    opener = F.when(closed, F.col("last")).when(opens, here)
    closer = F.when(~opens, here)
    return paired.filter(~opens | lost).select(
        *FILE_KEY, "depth", "nth", opener["core"].alias("opens"), closer["core"].alias("closes"),
        opener["pos"].alias("open_pos"), closer["pos"].alias("close_pos"), opener["line"].alias("open_line"), closer["line"].alias("close_line"),
        F.coalesce(opener["core"] == F.translate(closer["core"], ")]}", "([{"), F.lit(False)).alias("fits"))


def bracket_counts(pairs: DataFrame) -> DataFrame:
    """(module, version, path, kind, n, deepest, lines): fitting pairs of each kind of a file, and the lines they go over together."""
    kind = F.element_at(F.create_map(*[F.lit(x) for item in KINDS.items() for x in item]), F.col("opens"))
    return pairs.filter("fits").groupBy(*FILE_KEY, kind.alias("kind")).agg(
        F.count("*").alias("n"), F.max("depth").alias("deepest"), F.sum(F.col("close_line") - F.col("open_line")).alias("lines"))
