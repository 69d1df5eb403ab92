"""Operator 3: similarity join of documents on word n-grams, by MinHash banding with exact verification.

Texts become sets of ``n`` consecutive words (5 by default; A-Z without case). Equal word sequences are one class.
Each class gets MinHash values, grouped into bands; a shuffle on band hashes brings classes that agree in a band
together. Every such pair is verified on the full n-gram sets, once, in the first band the two share. Band and row
counts follow from the recall wanted at the threshold (``choose_bands``).

Skew: copies are collapsed before any pairing. A bucket of any size is cut into blocks of bounded total n-gram
count and number of members by a hash, and pairs of blocks are compared; what leaves a comparison is a count per class and one edge per
class, never the pairs. Buckets of several bands with the same members are compared once.

A class is known by two hashes of its words, never by a doc_id: one doc_id may stand on any number of rows and
texts. Texts are fetched by doc_id and hashes, and each task passes on one of equal rows.

Defined results: null or empty texts (no words) link with nothing. A text of fewer than ``n`` words has one
n-gram, all its words. A row without doc_id belongs to no class and has no links. Rows that share a doc_id have the classes of
their own texts; a linked group is named by its smallest doc_id. Repeated rows are copies of each other. Ties between classes with one
doc_id go to the smaller hashes. Very long texts are one row in one task. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.shared import Scratch, components, doc_texts, shuffle_partitions, struct_of
from seamline.llm.words import mix, ngrams, words_of

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.99999
HASHES = 160
#: n-grams of all members of a block together
BLOCK_GRAMS = 400_000
#: members of a block; matrices of two blocks have four times its square
BLOCK_ROWS = 1000
#: (doc_id, class) pairs a task remembers
SEEN = 200_000
SEED = 3


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach the recall within ``hashes``."""
    best = None
    for rows in range(1, hashes + 1):
        miss = 1 - threshold**rows
        bands = 1 if miss <= 0 else int(np.ceil(np.log(max(1 - recall, 1e-15)) / np.log(miss)))
        if bands * rows <= hashes:
            best = max(bands, 1), rows
    if best is None:
        raise ValueError("recall cannot be reached with so few hashes")
    return best


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**32, count, dtype=np.uint32), rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _grams(chunk, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram hashes of a chunk with their texts, in text order, and the words' hashes."""
    words = chunk.sure_hashes()
    grams, text = ngrams(words, chunk.text, n)
    counts = chunk.counts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(chunk.text, short)
        whole = np.array([_sequence(words[f: f + c])[0] for f, c in zip(first, counts[short])], dtype=np.uint64)
        grams, text = np.concatenate([grams, whole]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        grams, text = grams[order], text[order]
    return grams, text, words


def _sequence(words: np.ndarray) -> tuple[np.uint64, np.uint64]:
    place = np.arange(len(words), dtype=np.uint64)
    return (np.add.reduce(mix(words + place * np.uint64(0x9E3779B97F4A7C15))),
            np.add.reduce(mix(words ^ mix(place + np.uint64(7)))))


def _minhashes(grams: np.ndarray, text: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have n-grams, and a matrix of their band hashes."""
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.empty(0, dtype=np.int64)
    masks, factors = _permutations(bands * rows)
    keys = np.empty((len(first), bands), dtype=np.uint64)
    if not len(first):
        return text[first], keys
    high = (grams >> np.uint64(32)).astype(np.uint32)
    for band in range(bands):
        h = np.full(len(first), band + 1, dtype=np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            h = mix(h * np.uint64(31) + np.minimum.reduceat((high ^ masks[i]) * factors[i], first))
        keys[:, band] = h
    return text[first], keys


def _class_keys(chunk, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the word sequence of each text."""
    begin = np.r_[0, np.cumsum(chunk.counts())]
    place = np.arange(len(words), dtype=np.uint64) - begin[chunk.text].astype(np.uint64)
    a = np.r_[np.uint64(0), np.cumsum(mix(words + place * np.uint64(0x9E3779B97F4A7C15)))]
    b = np.r_[np.uint64(0), np.cumsum(mix(words ^ mix(place + np.uint64(7))))]
    return (a[begin[1:]] - a[begin[:-1]]).view(np.int64), (b[begin[1:]] - b[begin[:-1]]).view(np.int64)


def _keyed(text_of, once: bool):
    """Rows with the class hashes k1, k2 and n_words of their text; ``once``: of equal (doc_id, class), the first a task sees.

    What a task has seen is a set of bounded size, forgotten when full.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            for chunk in words_of(text_of(batch).cast(pa.string())):
                k1, k2 = _class_keys(chunk, chunk.sure_hashes())
                part = batch.slice(chunk.first, chunk.n_texts)
                out = pa.record_batch([*part.columns, pa.array(k1), pa.array(k2), pa.array(chunk.counts().astype(np.int64))],
                                      names=[*part.schema.names, "k1", "k2", "n_words"])
                if once:
                    new = []
                    for i, key in enumerate(zip(part.column("doc_id").to_pylist(), k1.tolist(), k2.tolist())):
                        if key not in seen:
                            new.append(i)
                            seen.add(key)
                    if len(seen) > SEEN:
                        seen.clear()
                    out = out.take(pa.array(new, pa.int64()))
                yield out
    return run


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for chunk in words_of(batch.column(1)):
                grams, text, words = _grams(chunk, n)
                owners, keys = _minhashes(grams, text, bands, rows)
                m = chunk.n_texts
                full = np.zeros((m, bands), dtype=np.uint64)
                full[owners] = keys
                k1, k2 = _class_keys(chunk, words)
                yield pa.record_batch([
                    ids.slice(chunk.first, m), pa.array(k1), pa.array(k2), pa.array(chunk.counts().astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * bands), pa.array(full.ravel().view(np.int64))),
                ], names=["doc_id", "k1", "k2", "n_words", "bands"])
    return run


def _sets(n: int, bands: int, rows: int):
    """Sorted distinct n-grams of each text (node, text, copies), and its band hashes, as little-endian bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words_of(batch.column(1)):
                grams, text, _ = _grams(chunk, n)
                owners, keys = _minhashes(grams, text, bands, rows)
                ends = np.searchsorted(text, owners, "right")
                begins = np.searchsorted(text, owners, "left")
                yield pa.record_batch([
                    batch.column(0).take(pa.array(owners + chunk.first)), batch.column(2).take(pa.array(owners + chunk.first)),
                    pa.array([np.unique(grams[i:j]).tobytes() for i, j in zip(begins, ends)], pa.binary()),
                    pa.array([k.tobytes() for k in keys], pa.binary()),
                ], names=["node", "copies", "grams", "keys"])
    return run


def linked_pairs(grams: list[np.ndarray], keys: np.ndarray, band: int, side: np.ndarray | None, threshold: float):
    """Indexes (i, j) of the members of one block pair that reach the threshold and meet first in this band.

    ``side`` tells the two blocks apart; None where a block is compared with itself.
    """
    n = len(grams)
    meet = keys[:, band][:, None] == keys[:, band][None, :]
    for earlier in range(band):
        meet &= keys[:, earlier][:, None] != keys[:, earlier][None, :]
    meet = np.triu(meet, 1)
    if side is not None:
        meet &= side[:, None] != side[None, :]
    i, j = np.nonzero(meet)
    if not len(i):
        return i, j
    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    if n <= 3:
        common = np.array([len(np.intersect1d(grams[x], grams[y], assume_unique=True)) for x, y in zip(i, j)])
    else:
        _, column, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), sizes)
        shared = count[column] > 1
        row, column = row[shared], column[shared]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        inner = np.zeros((n, n), dtype=np.float64)
        width = 4096
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [at, at + width])
            part = np.zeros((n, width), dtype=np.float32)
            part[row[lo:hi], column[lo:hi] - at] = 1
            inner += part @ part.T
        common = inner[i, j].astype(np.int64)
    # J >= t as common * (1 + t) >= t * (|a| + |b|), with room for rounding of t alone
    good = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
    return i[good], j[good]


def _verify(threshold: float, n_bands: int):
    names = ["node", "n_links", "root"]

    def one(rows: dict[str, list]) -> pa.RecordBatch | None:
        nodes = np.array(rows["node"], dtype=np.int64)
        grams = [np.frombuffer(g, dtype=np.uint64) for g in rows["grams"]]
        keys = np.frombuffer(b"".join(rows["keys"]), dtype=np.uint64).reshape(len(nodes), n_bands)
        side = np.array(rows["side"], dtype=bool) if rows["left"][0] != rows["right"][0] else None
        i, j = linked_pairs(grams, keys, rows["band"][0], side, threshold)
        if not len(i):
            return None
        copies = np.array(rows["copies"], dtype=np.int64)
        links = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = nodes.copy()
        while True:  # smallest node reachable within the block pair
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            if (before == root).all():
                break
        some = links > 0
        return pa.record_batch([pa.array(nodes[some]), pa.array(links[some]), pa.array(root[some])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, {}
        for batch in batches:
            columns = {k: batch.column(k).to_pylist() for k in batch.schema.names}
            keys = list(zip(columns["bucket"], columns["left"], columns["right"]))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != group:
                    if group is not None and (out := one(rows)) is not None:
                        yield out
                    group, rows = keys[at], {k: [] for k in columns}
                for k, v in columns.items():
                    rows[k].extend(v[at:end])
                at = end
        if group is not None and (out := one(rows)) is not None:
            yield out
    return run


def blocks_of(members, grams, block_grams: int = BLOCK_GRAMS, block_rows: int = BLOCK_ROWS):
    """How many blocks a bucket is cut into."""
    return F.greatest(F.ceil(F.col(grams) / block_grams), F.ceil(F.col(members) / block_rows)).cast("int")


def ngram_join(docs: DataFrame, scratch: Scratch, n: int = NGRAM, threshold: float = THRESHOLD,
               recall: float = RECALL, hashes: int = HASHES, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """doc_id, class_id (smallest doc_id reachable by links), copy_id (smallest with the same words), n_links; also k1, k2 (the class
    of the row) and stands (whether its doc_id and class stand for the group).

    ``n_links`` counts the other rows whose n-gram sets have a Jaccard similarity of ``threshold`` or more,
    copies included.
    """
    bands, rows = choose_bands(threshold, recall, hashes)
    parts = shuffle_partitions(docs.sparkSession)
    texts = doc_texts(docs)
    signed = scratch.settle(texts.mapInArrow(
        _signatures(n, bands, rows), "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, bands array<bigint>"), keep=True)
    usable = signed.filter("doc_id is not null and n_words > 0")
    # A class has a number for the pairing, given once, in the settled table.
    classes = scratch.settle(usable.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"),
        F.first("n_words").alias("n_words")).withColumn("node", F.monotonically_increasing_id()), keep=True)

    spread = classes.select("node", "n_words", F.posexplode("bands").alias("band", "key")).select(
        F.xxhash64("band", "key").alias("bucket"), "band", "node", "n_words").repartition(parts, "bucket")
    buckets = spread.groupBy("bucket").agg(
        F.first("band").alias("band"), F.count("*").alias("members"), F.sum("n_words").alias("grams"),
        F.min("node").alias("lo"), F.max("node").alias("hi"),
        F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2")).filter("members > 1")
    chosen = buckets.groupBy("members", "lo", "hi", "x1", "x2").agg(
        F.min_by(F.struct("bucket", "band", "grams", "members"), "band").alias("b")).select(
        "b.bucket", "b.band", blocks_of("b.members", "b.grams", block_grams).alias("blocks"))
    # joined by shuffle at every size: neither table is bounded
    members = spread.drop("band").join(chosen.hint("shuffle_hash"), "bucket").withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit("block")), "blocks").cast("int"))
    placed = scratch.settle(members.select("bucket", "band", "node", "block", F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", "band", "node", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        (F.col("block") > F.col("other")).alias("side")))
    wanted = placed.select("node").distinct().join(classes.select("node", "k1", "k2", F.col("least").alias("doc_id"), "copies"), "node")
    keyed = texts.mapInArrow(_keyed(lambda b: b.column("text"), once=True), "doc_id bigint, text string, k1 bigint, k2 bigint, n_words bigint")
    sets = keyed.join(wanted.hint("shuffle_hash"), ["doc_id", "k1", "k2"]).select("node", "text", "copies").mapInArrow(
        _sets(n, bands, rows), "node bigint, copies bigint, grams binary, keys binary").groupBy("node").agg(
        F.first("grams").alias("grams"), F.first("keys").alias("keys"), F.first("copies").alias("copies"))
    found = placed.join(sets, "node").repartition(parts, "bucket", "left", "right").sortWithinPartitions(
        "bucket", "left", "right").mapInArrow(_verify(threshold, bands), "node bigint, n_links bigint, root bigint")
    found = scratch.settle(found, keep=True)

    links = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    linked = scratch.settle(components(scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b"))), keep=True)
    # A linked group is named by the smallest doc_id of its classes, and that class stands for it.
    first = F.min(F.struct("least", "k1", "k2"))
    named = linked.join(classes.select("node", "least", "k1", "k2"), "node").groupBy("component").agg(first.alias("first"))
    of_class = classes.select("k1", "k2", "node", "least", "copies").join(links, "node", "left").join(linked, "node", "left").join(
        named, "component", "left").select("k1", "k2", "least", "copies", "links", F.coalesce("first", F.struct("least", "k1", "k2")).alias("first"))
    usable = F.col("usable")
    return signed.select("doc_id", "k1", "k2", (F.col("doc_id").isNotNull() & (F.col("n_words") > 0)).alias("usable")).join(
        of_class, ["k1", "k2"], "left").select(
        "doc_id",
        F.when(usable, F.col("first.least")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(usable, F.col("least")).otherwise(F.col("doc_id")).alias("copy_id"),
        F.when(usable, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("bigint").alias("n_links"),
        "k1", "k2", (usable & (F.struct(F.col("doc_id").alias("least"), "k1", "k2") == F.col("first"))).alias("stands"))


def representatives(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents that stand for their group, by the result of ``ngram_join``: one row of each.

    Rows that belong to no class, without doc_id or words, all stay. Of equal rows of the class that stands, and of rows with its words and doc_id,
    one stays, by a hash of the row.
    """
    kept = classes.filter("stands").select(F.col("doc_id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    keyed = rows.mapInArrow(
        _keyed(lambda b: b.column("row").field("text"), once=False),
        T.StructType([rows.schema["row"], *struct_of("k1 bigint, k2 bigint, n_words bigint").fields])).withColumn(
        "_id", F.col("row.doc_id").cast("bigint"))
    classed = F.col("_id").isNotNull() & (F.col("n_words") > 0)
    same = Window.partitionBy("_id", "_k1", "_k2").orderBy(F.xxhash64(*[F.col(f"row.`{c}`").cast("string") for c in docs.columns]))
    standing = keyed.filter(classed).select("row", "_id", F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).join(
        kept, ["_id", "_k1", "_k2"], "left_semi").withColumn("_row", F.row_number().over(same)).filter("_row = 1").select("row.*")
    return standing.unionByName(keyed.filter(~classed).select("row.*"))
