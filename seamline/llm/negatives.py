"""Operator 13: hard negatives of anchors, scored exactly with Kronecker-packed products.

Components become integers, floor(``SCALE`` x). An anchor's positives are its ``N_POSITIVES`` best other rows of the same label; for each,
the ``N_NEGATIVES`` best rows of other labels are returned whose score lies between ``LOW`` and ``HIGH`` hundredths of the positive's.

*Packing.* In a block of candidates every component is biased to be at least 0 and several candidates' values of one component are put
into separated fields of one wide integer. A field has room for the largest sum of products, so that

    sum over j of a_j * packed_j

holds the products of all its candidates next to each other: one multiplication per anchor component serves all of them. The
fields are unpacked and the biases' share, known from the component sums, is taken off. Wide integers are the 64 bits
of the machine where two fields fit, and Python's unbounded integers otherwise; both give exact scores.

*Blocks.* Anchors, the query set, meet all rows in blocks of bounded size, each a row of one packed table; pairs of blocks meet in
an ordinary join on the pair's name. Two rounds: positives first, then negatives within their windows. What leaves a pair of
blocks is the best few rows of each anchor (and positive); windows over these merge them.

Skew: a label may hold any share of the rows; blocks are dealt by a hash and blind to labels.

Defined results: rows with a null label or vector, a null or non-finite component, or no id take no part, nor do empty vectors and those with
a component so large that a product could leave 64 bits. Rows of an anchor's dimension are its candidates. Rows equal in
id, label and components count once; different rows under one id are rows of their own (ties: smaller id, then a hash of the row), but no row is a candidate
of an anchor with its id. A negative label counts as any other. Empty tables give none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.shared import Scratch

SCALE = 256
N_POSITIVES, N_NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Rows of a block, and bytes of its components
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Anchors scored at a time
STEP = 32
#: Fields of an unbounded integer
WIDE_FIELDS = 64


def pack(values: np.ndarray, bits: int, fields: int, kind) -> np.ndarray:
    """Rows of values of at least 0 as (components, words): field f of word w is row ``w * fields + f``."""
    words = -(-len(values) // fields)
    out = np.zeros((values.shape[1], words), dtype=kind)
    for f in range(fields):
        part = values[f::fields].astype(kind).T
        out[:, : part.shape[1]] += part * kind(1 << bits * f) if kind is not object else part * (1 << bits * f)
    return out


def products(anchors: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Each anchor's products with all candidates, still packed; one multiplication of a word per anchor component."""
    total = anchors[:, :1] * packed[0]
    for j in range(1, len(packed)):
        total += anchors[:, j: j + 1] * packed[j]
    return total


def unpack(total: np.ndarray, bits: int, fields: int, n: int) -> np.ndarray:
    """The fields of packed words, as (anchors, n)."""
    mask = (1 << bits) - 1
    out = np.zeros((len(total), total.shape[1] * fields), dtype=total.dtype)
    for f in range(fields):
        out[:, f::fields] = (total >> np.uint64(bits * f)) & np.uint64(mask) if total.dtype != object else (total >> bits * f) & mask
    return out[:, :n]


def scores(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first anchor, exact inner products of ``STEP`` anchors with all candidates) of two int64 matrices."""
    d = candidates.shape[1]
    bias_a, bias_c = (-int(x.min(initial=0)) for x in (anchors, candidates))
    top = d * (int(anchors.max(initial=0)) + bias_a) * (int(candidates.max(initial=0)) + bias_c)
    bits = max(1, top.bit_length())
    kind, fields = (np.uint64, 64 // bits) if bits <= 32 else (object, WIDE_FIELDS)
    shifted = lambda x, by: (x.astype(object) + by) if kind is object else (x + by).astype(kind)
    a, packed = shifted(anchors, bias_a), pack(shifted(candidates, bias_c), bits, fields, kind)
    exact = object if kind is object else np.int64
    sum_a, sum_c = anchors.astype(exact).sum(axis=1), candidates.astype(exact).sum(axis=1)
    for at in range(0, len(a), STEP):
        field = unpack(products(a[at: at + STEP], packed), bits, fields, len(candidates)).astype(exact)
        shift = bias_c * sum_a[at: at + STEP, None] + bias_a * sum_c[None, :] + d * bias_a * bias_c
        yield at, (field - shift).astype(np.int64)


def best(order_score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by ``order`` (a rank of every position)."""
    if len(order_score) > 4 * k:
        edge = np.partition(order_score, len(order_score) - k)[len(order_score) - k]
        at = np.flatnonzero(order_score >= edge)
    else:
        at = np.arange(len(order_score))
    return at[np.lexsort((order[at], -order_score[at]))[:k]]


class Block:
    """One row of a packed table: ids, row hashes, labels and components."""

    def __init__(self, row: dict, prefix: str):
        read = lambda name: np.frombuffer(row[prefix + name], dtype=np.int64)
        self.id, self.row, self.label = read("id"), read("row"), read("label")
        self.parts = read("parts").reshape(len(self.id), -1)
        self.order = np.empty(len(self.id), dtype=np.int64)
        self.order[np.lexsort((self.row, self.id))] = np.arange(len(self.id))


def _pack_rows(name: str) -> Callable:
    """Rows of a block, sorted together, as one row of binaries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            lists = list(zip(*held))
            columns = [np.array(c, dtype=np.int64).tobytes() for c in lists[:3]] + [b"".join(lists[3])]
            return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), *(pa.array([c], pa.large_binary()).cast(pa.binary()) for c in columns)],
                                   names=["dim", "block", *(name + c for c in ("id", "row", "label", "parts"))])
        for batch in batches:
            lists = batch.column("parts")
            values, offsets = lists.flatten().to_numpy(), np.r_[0, np.cumsum(batch.column("dim").to_numpy())]
            keys = zip(batch.column("dim").to_pylist(), batch.column("block").to_pylist())
            each = zip(*(batch.column(c).to_pylist() for c in ("id", "row", "label")))
            for i, (at, row) in enumerate(zip(keys, each)):
                if at != key:
                    if held:
                        yield close()
                    key, held = at, []
                held.append((*row, values[offsets[i]: offsets[i + 1]].tobytes()))
        if held:
            yield close()
    return run


def _blocks(rows: DataFrame, name: str, partitions: int) -> DataFrame:
    """(dim, block, <name>id, <name>row, <name>label, <name>parts): rows packed by ``block``."""
    dealt = rows.repartition(partitions, "dim", "block").sortWithinPartitions("dim", "block")
    schema = f"dim int, block bigint, {name}id binary, {name}row binary, {name}label binary, {name}parts binary"
    return dealt.select("id", "row", "label", "parts", "dim", "block").mapInArrow(_pack_rows(name), schema)


def usable_rows(vectors: DataFrame, relabel: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """id, label, dim, parts (integers), row (a hash of it) of the rows that take part, each once."""
    values = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * SCALE)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), values.alias("scaled"))
    # Twice the bits of a component and those of the dimension stay within 63.
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.size("scaled")))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("scaled") > 0) & F.forall(
        "scaled", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < most), F.lit(False)))
    rows = rows.filter(F.coalesce(good, F.lit(False))).select(
        "id", (relabel(F.col("id"), F.col("label")) if relabel else F.col("label")).alias("label"),
        F.size("scaled").alias("dim"), F.transform("scaled", lambda x: F.floor(x).cast("bigint")).alias("parts"))
    return rows.withColumn("row", F.xxhash64("label", "parts")).dropDuplicates(["id", "row", "label", "parts"])


POSITIVES = "anchor_id bigint, anchor_row bigint, positive_id bigint, positive_row bigint, positive_score bigint"
NEGATIVES = POSITIVES + ", negative_id bigint, negative_row bigint, negative_score bigint"


def _long_batch(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, dtype=np.int64) for i in range(len(names))]
    return pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=names)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(",")]


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _positives(n_positives: int):
    """The best rows of an anchor's label in a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _pairs_of(batches):
            a, c = Block(row, "a_"), Block(row, "c_")
            out = []
            for first, score in scores(a.parts, c.parts):
                for i, s in enumerate(score, first):
                    at = np.flatnonzero((c.label == a.label[i]) & (c.id != a.id[i]))
                    at = at[best(s[at], c.order[at], n_positives)]
                    same = np.full(len(at), 1)
                    out.append([a.id[i] * same, a.row[i] * same, c.id[at], c.row[at], s[at]])
            yield _long_batch(out, _names(POSITIVES))
    return run


def _negatives(n_negatives: int, low: int, high: int):
    """For each positive of an anchor, the best rows of other labels in a block within its window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _pairs_of(batches):
            a, c = Block(row, "a_"), Block(row, "c_")
            wanted: dict[tuple, list] = {}
            for p in row["wanted"]:
                wanted.setdefault((p["anchor_id"], p["anchor_row"]), []).append((p["positive_id"], p["positive_row"], p["positive_score"]))
            out = []
            for first, score in scores(a.parts, c.parts):
                for i, s in enumerate(score, first):
                    other = np.flatnonzero((c.label != a.label[i]) & (c.id != a.id[i]))
                    for positive in wanted.get((int(a.id[i]), int(a.row[i])), ()):
                        least, most = -(-low * positive[2] // 100), high * positive[2] // 100
                        at = other[(s[other] >= least) & (s[other] <= most)]
                        at = at[best(s[at], c.order[at], n_negatives)]
                        same = np.full(len(at), 1)
                        out.append([a.id[i] * same, a.row[i] * same, *(v * same for v in positive), c.id[at], c.row[at], s[at]])
            yield _long_batch(out, _names(NEGATIVES))
    return run


def hard_negatives(vectors: DataFrame, scratch: Scratch, is_anchor: Callable[[Column], Column],
                   relabel: Callable[[Column, Column], Column] | None = None, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES,
                   low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` tells from the id column which rows are anchors, ``relabel`` gives labels from (id, label).
    """
    rows = scratch.settle(usable_rows(vectors, relabel))
    # One row per dimension: how many blocks its rows and its anchors fill.
    most = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_anchor(F.col("id"))).alias("n_anchors")).select(
        "dim", F.ceil(F.col("n") / most).alias("blocks"), F.ceil(F.col("n_anchors") / most).alias("anchor_blocks")).filter("anchor_blocks > 0")
    n_pairs = sizes.agg(F.coalesce(F.sum(F.col("blocks") * F.col("anchor_blocks")), F.lit(0))).first()[0]
    partitions = int(min(max(n_pairs, 1), 100_000))
    dealt = rows.join(sizes, "dim").withColumn("h", F.xxhash64("id", "row"))
    candidates = scratch.settle(_blocks(dealt.withColumn("block", F.pmod("h", "blocks")), "c_", partitions))
    anchors = scratch.settle(_blocks(dealt.filter(is_anchor(F.col("id"))).withColumn("block", F.pmod("h", "anchor_blocks")), "a_", partitions))
    # Each pair of blocks of a dimension is one row with a name of its own.
    left = candidates.join(sizes, "dim").select("dim", F.col("block").alias("right_block"), F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("anchor_blocks") - 1)).alias("left_block"), "c_id", "c_row", "c_label", "c_parts")
    right = anchors.join(sizes, "dim").select("dim", F.col("block").alias("left_block"), F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("right_block"), "a_id", "a_row", "a_label", "a_parts")
    key = ["dim", "left_block", "right_block"]
    pairs = left.repartition(partitions, *key).join(right.repartition(partitions, *key), key)

    anchor = ["anchor_id", "anchor_row"]
    order = Window.partitionBy(*anchor).orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    found = pairs.select("c_id", "c_row", "c_label", "c_parts", "a_id", "a_row", "a_label", "a_parts").mapInArrow(_positives(n_positives), POSITIVES)
    positives = scratch.settle(found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n_positives).drop("r"))

    # An anchor's positives go to its block: at most n_positives rows for each of its rows.
    home = dealt.filter(is_anchor(F.col("id"))).select(
        F.col("id").alias("anchor_id"), F.col("row").alias("anchor_row"), "dim", F.pmod("h", "anchor_blocks").alias("left_block"))
    wanted = scratch.settle(positives.join(home, anchor).groupBy("dim", "left_block").agg(
        F.collect_list(F.struct(*anchor, "positive_id", "positive_row", "positive_score")).alias("wanted")))
    windows = pairs.join(wanted, ["dim", "left_block"]).select(
        "c_id", "c_row", "c_label", "c_parts", "a_id", "a_row", "a_label", "a_parts", "wanted").mapInArrow(
        _negatives(n_negatives, low, high), NEGATIVES)
    positive = [*anchor, "positive_id", "positive_row", "positive_score"]
    order = Window.partitionBy(*positive).orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    ranked = scratch.settle(windows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives), keep=True)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
