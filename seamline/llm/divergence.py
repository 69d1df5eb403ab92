"""Operator 12: source divergence audit, by a frequent-pattern tree of term rows.

For each language, terms (runs of letters, only A-Z lower-cased) in at least ``min_docs`` documents are kept. A group is a (lang,
source); its weight of a term is p = 1 + floor(SCALE (count + PRIOR) / (N + PRIOR V)). Divergence of two groups is the sum of
abs(p - q) over all kept terms; the terms that stand out most of a group follow from p and the language's own q.

*Tree.* The row of a term is its nonzero (source, count) items in source order. Equal rows are one with a multiplicity, rows are sorted,
and each task walks its range of rows as the depth-first walk of their frequent-pattern tree: what two rows share is a path
walked once. When a node is left, its multiplicity is known and it is settled with each of its ancestors in one vector operation:
that is the correction of the pair (source of the node, source of the ancestor),

    m (abs(p - q) - abs(p - q0) - abs(p0 - q) + abs(p0 - q0)),      p0, q0: weights of a count of 0.

A path that crosses a border between ranges is walked on both sides, which leaves all sums as they are. What
remains of a pair needs no term: V abs(p0 - q0), and for each side the sum of abs(p - q0) - abs(p0 - q0) over its own nonzero counts,
which follows from running totals over the sorted weights of a source. So no pass is made over term times pair.

*Skew.* Documents are counted per task before anything is shuffled, in tables that are flushed when full, so that a hot
source or word is a few rows a task. Rows of terms are spread by term. A task holds one path (as long as a language has
sources) and a bounded table of corrections.

Defined results: null text, lang and source are ''. Groups without terms have N = 0; a language without kept terms has V = 0, its pairs
the value 0. A language with one source has no pairs. Repeated rows count repeatedly. Ties are ordered by item. All values are
exact integers. Texts are read a slice at a time, whole. Empty tables give none. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.shared import Scratch, shuffle_partitions

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
PRIOR = 5
#: Entries of a task's tables before they are passed on
TABLE = 200_000
SLICE = 1 << 20

# Bytes of terms: A-Z become a-z, other letters and all bytes of longer characters stay, everything else ends a term.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, count bigint, docs bigint"


def terms_of(text: bytes) -> Counter:
    """Number of each term of a text, a slice at a time."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + SLICE
        part = text[at:end].translate(_FOLD)
        if end < len(text):
            # A term may go on: up to the last separator, or further slices where there is none.
            last = part.rfind(b" ")
            while last < 0 and end < len(text):
                end += end - at
                part = text[at:end].translate(_FOLD)
                last = part.rfind(b" ") if end < len(text) else len(part)
            if last >= 0:
                part = part[:last + 1]
        found.update(part.split())
        at += len(part)
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table: dict[tuple, dict[bytes, list[int]]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        for (lang, source), terms in table.items():
            n = len(terms)
            pairs = np.array(list(terms.values()), dtype=np.int64).reshape(-1, 2)
            yield pa.record_batch([
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()),
                pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["lang", "source", "term", "count", "docs"])
        table.clear()
        held = 0

    for batch in batches:
        keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for key, text in zip(keys, batch.column("text").cast(pa.large_string()).cast(pa.large_binary())):
            terms = table.setdefault(key, {})
            before = len(terms)
            for term, n in terms_of(text.as_py()).items():
                row = terms.get(term)
                if row is None:
                    terms[term] = [n, 1]
                else:
                    row[0] += n
                    row[1] += 1
            held += len(terms) - before
            if held >= TABLE:
                yield from flush()
    yield from flush()


def weight(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR kept)), exactly; ``kept`` is not 0."""
    wide = "decimal(20,0)"
    return (F.lit(1) + F.call_function("div", (count + PRIOR).cast(wide) * F.lit(SCALE).cast("decimal(10,0)"),
                                       (total + F.lit(PRIOR) * kept).cast(wide))).cast("bigint")


def _groups(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))


def term_rows(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, items): the row of each kept term, its items (source, count) in source order."""
    n = shuffle_partitions(docs.sparkSession)
    counted = docs.mapInArrow(_count, COUNTS).repartition(n, "lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "count"))).alias("items")).filter(
        F.col("docs") >= min_docs).drop("docs")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections (lang, left, right, value) of sorted term rows with multiplicities."""
    totals: dict[tuple, int] = {}
    names: list[str] = []
    sources: list[int] = []
    counts: list[int] = []
    p = np.zeros(64, dtype=np.int64)
    p0 = np.zeros(64, dtype=np.int64)
    m: list[int] = []
    number: dict[str, int] = {}
    lang = None

    def leave() -> None:
        """Settles the deepest node with its ancestors, and hands its multiplicity to its parent."""
        d = len(sources) - 1
        times = m.pop()
        if d:
            a = p[:d]
            a0 = p0[:d]
            value = np.abs(p[d] - a) - np.abs(p[d] - a0) - np.abs(p0[d] - a) + np.abs(p0[d] - a0)
            own = sources[d]
            for other, v in zip(sources, value.tolist()):
                if v:
                    totals[other, own] = totals.get((other, own), 0) + times * v
            m[-1] += times
        sources.pop()
        counts.pop()

    def flush() -> pa.RecordBatch:
        rows = [(lang, names[a], names[b], v) for (a, b), v in totals.items()]
        totals.clear()
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()),
                                pa.array(columns[3], pa.int64())], names=["lang", "left", "right", "value"])

    for batch in batches:
        for row_lang, items, weights, zeros, times in zip(*(batch.column(c).to_pylist() for c in ("lang", "items", "weights", "zeros", "times"))):
            if row_lang != lang:
                while sources:
                    leave()
                if totals:
                    yield flush()
                lang = row_lang
                names, number = [], {}
            path = [(number.setdefault(i["source"], len(number)), i["count"]) for i in items]
            if len(names) < len(number):
                names = list(number)
            shared = 0
            while shared < len(sources) and shared < len(path) and path[shared] == (sources[shared], counts[shared]):
                shared += 1
            while len(sources) > shared:
                leave()
            if len(path) > len(p):
                grown = max(2 * len(p), len(path))
                p, p0 = (np.concatenate([x, np.zeros(grown - len(x), dtype=np.int64)]) for x in (p, p0))
            for d in range(shared, len(path)):
                sources.append(path[d][0])
                counts.append(path[d][1])
                p[d], p0[d] = weights[d], zeros[d]
                m.append(0)
            m[-1] += times
            if len(totals) >= TABLE:
                yield flush()
    while sources:
        leave()
    yield flush()


def audit(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of each group from the others of its language, and its marked terms."""
    n = shuffle_partitions(docs.sparkSession)
    groups = _groups(docs)
    rows = scratch.settle(term_rows(groups, min_docs), keep=True)
    kept = rows.groupBy("lang").agg(F.count("*").alias("kept"))
    cells = rows.select("lang", "term", F.inline("items"))
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    known = groups.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    sized = scratch.settle(known.withColumn("zero", F.when(F.col("kept") > 0, weight(F.lit(0), F.col("total"), F.col("kept")))), keep=True)
    weighted = scratch.settle(
        cells.join(sized, ["lang", "source"]).withColumn("p", weight(F.col("count"), F.col("total"), F.col("kept"))).select(
            "lang", "term", "source", "count", "p", "zero"), keep=True)
    pairs = _pairs(scratch, n, sized, weighted)
    marked = _marked(kept, weighted, top_terms)
    return pairs.unionByName(marked)


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    ranked = ranked if most is None else ranked.filter(F.col("rank") <= most)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _corrections(n: int, weighted: DataFrame) -> DataFrame:
    """(lang, left, right, correction) from the tree, left before right in source order."""
    item = F.array_sort(F.collect_list(F.struct("source", "count", "p", "zero")))
    paths = weighted.groupBy("lang", "term").agg(item.alias("row")).groupBy("lang", "row").agg(F.count("*").alias("times")).select(
        "lang", F.transform("row", lambda x: F.struct(x["source"].alias("source"), x["count"].alias("count"))).alias("items"),
        F.col("row.p").alias("weights"), F.col("row.zero").alias("zeros"), "times")
    walked = paths.repartitionByRange(n, "lang", "items").sortWithinPartitions("lang", "items").mapInArrow(
        _walk, "lang string, left string, right string, value bigint")
    return walked.groupBy("lang", "left", "right").agg(F.sum("value").alias("correction"))


def _pairs(scratch: Scratch, n: int, sized: DataFrame, weighted: DataFrame) -> DataFrame:
    corrections = scratch.settle(_corrections(n, weighted), keep=True)
    both = corrections.unionByName(corrections.select("lang", F.col("right").alias("left"), F.col("left").alias("right"), "correction"))
    # Sum of abs(p - x) over the nonzero counts of a source, for the zero weight x of every other: running totals over
    # the distinct weights and the points asked for, in one order.
    weights = weighted.groupBy("lang", "source", "p").agg(F.count("*").alias("times"), F.max("zero").alias("zero"))
    other = sized.select("lang", F.col("source").alias("right"), F.col("zero").alias("right_zero"))
    asked = sized.join(other, "lang").filter(F.col("source") != F.col("right"))
    points = weights.select("lang", "source", F.col("p").alias("x"), "times", F.lit(None).cast("string").alias("right"), F.lit(0).alias("last")).unionByName(
        asked.filter(F.col("kept") > 0).select("lang", "source", F.col("right_zero").alias("x"), F.lit(0).cast("bigint").alias("times"), "right", F.lit(1).alias("last")))
    group = Window.partitionBy("lang", "source")
    upto = group.orderBy("x", "last").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("times") * F.col("x")
    side = points.select(
        "lang", F.col("source").alias("left"), "right", "x", F.sum("times").over(upto).alias("below"), F.sum(mass).over(upto).alias("below_mass"),
        F.sum("times").over(group).alias("all"), F.sum(mass).over(group).alias("all_mass")).filter(F.col("right").isNotNull()).select(
        "lang", "left", "right", "all",
        (F.col("x") * F.col("below") - F.col("below_mass") + F.col("all_mass") - F.col("below_mass")
         - F.col("x") * (F.col("all") - F.col("below"))).alias("apart"))
    back = side.select("lang", F.col("left").alias("right"), F.col("right").alias("left"), F.col("all").alias("all_back"), F.col("apart").alias("apart_back"))
    key = ["lang", "left", "right"]
    zeros = F.abs(F.col("zero") - F.col("right_zero"))
    value = F.when(F.col("kept") == 0, 0).otherwise(
        zeros * (F.col("kept") - F.col("all") - F.col("all_back")) + F.col("apart") + F.col("apart_back") + F.coalesce("correction", F.lit(0)))
    joined = asked.withColumnRenamed("source", "left").join(side, key, "left").join(back, key, "left").join(both, key, "left")
    return _ranked(joined.select("lang", F.col("left").alias("source"), F.col("right").alias("item"), value.cast("bigint").alias("value")), "pair")


def _marked(kept: DataFrame, weighted: DataFrame, top_terms: int) -> DataFrame:
    terms = weighted.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    whole = weighted.groupBy("lang").agg(F.sum("count").alias("total"))
    q = terms.join(whole, "lang").join(kept, "lang").select("lang", "term", weight(F.col("count"), F.col("total"), F.col("kept")).alias("q"))
    found = weighted.join(q, ["lang", "term"]).filter(F.col("p") > F.col("q"))
    return _ranked(found.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "term", top_terms)
