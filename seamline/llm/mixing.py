"""Operator 6: mixing sources to target weights by a time-varying curriculum.

Size of a document: its words. Each source has a weight; the sources share ``budget`` times all sizes by weight, no
source more than ``most`` times its own size, and what is cut off there is shared again by weight among the others.
Solved at once: the target is min(most * size, level * weight) with one level for all.

A source's documents come in the order of a hash, pass after pass, until its target is used up. Each source also has
a schedule, its relative weight over training time from 0 to 1, linear between ``KNOTS``. The integral of the
schedule says which share of its target a source has been asked for at a time; inverting it at the middle of a
document's place in the source's cumulative demand gives the document its training position. The result is
sorted by position through a range shuffle.

Skew: sizes are summed before any shuffle; the running total of a source is cut into ranges of the hash, so one
source may hold any share of the documents. The only table handled in one task has one row per source.

Defined results: null texts have size 0; null sources are one source, ordered last. Documents of size 0, and all of a
source with target 0, are taken 0 times and have no position. Repeated rows and rows without doc_id are
documents of their own. Reruns agree, as only hashes of doc_id decide. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.shared import running_total
from seamline.llm.words import word_counts

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST = 2
#: Training times at which schedules give a relative weight, and the schedules that sources take in turn.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
SOURCE = ["missing", "name"]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(word_counts(batch.column(3)))],
                              names=["doc_id", "source", "content", "size"])


def _content(docs: DataFrame):
    """A hash of a whole row, which tells rows apart that share a doc_id or have none."""
    return F.xxhash64(*[F.col(c).cast("string") for c in docs.columns])


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, content (a hash of the row), size of every row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       _content(docs).alias("content"), F.col("text").cast("string").alias("text")).mapInArrow(
        _sizes, "doc_id bigint, source string, content bigint, size bigint")


def _in_turn(values, rank):
    """The value of a fixed list that a rank from 1 takes, in turn."""
    return F.element_at(F.lit(list(values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST,
            schedules=SCHEDULES) -> DataFrame:
    """One row per source: missing, name, source_size, target, schedule."""
    per_source = sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(*SOURCE))
    weighed = per_source.select(
        "*", _in_turn(weights, rank).alias("weight"),
        F.array(*[_in_turn([s[k] for s in schedules], rank) for k in range(len(schedules[0]))]).alias("schedule")).withColumn(
        "limit", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), *SOURCE)
    levels = weighed.select(
        "*", (F.sum("source_size").over(everything) * F.lit(float(budget))).alias("total"),
        F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("cut_off"),
        F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open_weight")).withColumn(
        "level", (F.col("total") - F.col("cut_off")) / F.col("open_weight"))
    # the level of the first source, by ratio, that stays within its limit holds for all that follow
    held = F.min(F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.struct(F.col("limit") / F.col("weight"), "missing", "name", "level"))).over(everything)
    return levels.withColumn("held", held["level"]).select(
        *SOURCE, "source_size", F.coalesce(F.least("limit", F.col("held") * F.col("weight")), F.col("limit")).alias("target"), "schedule")


def position(share, schedule: str = "schedule", knots=KNOTS):
    """Training time at which a schedule, linear between knots, has given out a share (0 to 1) of its integral."""
    w = [F.col(schedule)[k] for k in range(len(knots))]
    areas = [(w[k] + w[k + 1]) / 2 * (knots[k + 1] - knots[k]) for k in range(len(knots) - 1)]
    total = sum(areas[1:], areas[0])
    asked = share * total
    out = None
    for k in reversed(range(len(areas))):
        before = sum(areas[1:k], areas[0]) if k else F.lit(0.0)
        length = knots[k + 1] - knots[k]
        slope = (w[k + 1] - w[k]) / length
        rest = F.greatest(asked - before, F.lit(0.0))
        # w x + slope x^2 / 2 = rest, in the form without cancellation
        root = F.sqrt(F.greatest(w[k] * w[k] + 2 * slope * rest, F.lit(0.0)))
        bottom = w[k] + root
        x = F.least(F.when(bottom > 0, 2 * rest / bottom).otherwise(F.lit(0.0)), F.lit(length)) + knots[k]
        out = x if out is None else F.when(asked < before + areas[k], x).otherwise(out)
    return out


def mix(docs: DataFrame, whole: bool = False, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST,
        schedules=SCHEDULES) -> DataFrame:
    """One row per document: doc_id, source, content, size, source_size, target, taken, and passes.

    ``passes`` is an array of (words, position), one for each time the document is used. The document at which a source's
    demand ends gives only the words still missing; with ``whole`` it is used whole if more than half is wanted.
    """
    return assign(sizes(docs), whole, weights, budget, most, schedules)


def assign(sized: DataFrame, whole: bool = False, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST,
           schedules=SCHEDULES) -> DataFrame:
    keyed = sized.select("*", F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"),
                         F.xxhash64("doc_id", F.lit("mix")).alias("order"), F.struct("doc_id", "content").alias("tie"))
    placed = running_total(keyed, SOURCE, "order", "size", "before").drop("tie")
    joined = placed.join(targets(keyed, weights, budget, most, schedules), SOURCE)
    demand = F.round("target").cast("bigint")
    size = F.col("size")
    rows = joined.withColumn("demand", demand).withColumn(
        "full", F.when(F.col("source_size") > 0, F.expr("demand div source_size")).otherwise(F.lit(0))).withColumn(
        "rest", F.greatest(F.lit(0), F.least(size, F.col("demand") - F.col("full") * F.col("source_size") - F.col("before"))))
    if whole:
        rows = rows.withColumn("rest", F.when(2 * F.col("rest") > size, size).otherwise(F.lit(0)))
    middle = lambda n, words: (n * F.col("source_size") + F.col("before") + words / 2) / F.col("demand")
    passes = F.transform(F.sequence(F.lit(0), F.lit(int(most))), lambda n: F.struct(
        F.when(n < F.col("full"), size).when(n == F.col("full"), F.col("rest")).otherwise(F.lit(0)).cast("bigint").alias("words"),
        n.alias("n")))
    rows = rows.withColumn("taken", (F.col("full") * size + F.col("rest")).cast("bigint")).withColumn(
        "passes", F.filter(passes, lambda p: p["words"] > 0))
    return rows.withColumn("passes", F.transform("passes", lambda p: F.struct(
        p["words"].alias("words"), position(F.least(middle(p["n"], p["words"]), F.lit(1.0))).alias("position")))).select(
        "doc_id", "source", "content", "size", "source_size", "target", "taken", "passes")


def by_position(rows: DataFrame, column: str) -> DataFrame:
    """Rows range-sorted by training position; rows without one come last, spread by their id."""
    key = F.coalesce(F.col(column), 2 + F.pmod(F.xxhash64("doc_id", F.lit("rest")), F.lit(1_000_000)) / 1e6)
    keyed = rows.withColumn("_key", key).withColumn("_tie", F.xxhash64("doc_id"))
    return keyed.repartitionByRange("_key", "_tie").sortWithinPartitions("_key", "_tie").drop("_key", "_tie")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix uses them, each row once per use, whole, in training order; same columns."""
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))
    uses = mix(docs, whole=True).select(key.alias("_id"), F.col("content").alias("_content"), F.explode("passes.position").alias("_at"))
    keyed = docs.withColumn("_id", key).withColumn("_content", _content(docs))
    # rows that agree in every column are one text, used as often as all of them
    one = F.row_number().over(Window.partitionBy("_id", "_content").orderBy("_id"))
    used = keyed.withColumn("_row", one).filter("_row = 1").join(uses, ["_id", "_content"]).select(*docs.columns, "_at")
    return by_position(used, "_at").drop("_at")
