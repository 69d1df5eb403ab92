"""Operator 7: near duplicates among vectors, by spherical k-means cells and blocked cosine products.

Centroids are fitted on a bounded sample (``FIT_VECTORS`` rows by hash, ``FIT_VALUES`` numbers in all). Every vector
belongs to the cell of its nearest centroid, and is a guest of each later cell that its partners may belong to: a
partner lies within the angle whose cosine is the threshold, so beyond the plane between two centroids only if the
distance to that plane is at most the sine of that angle. No link is lost, whatever the vectors. Products
are computed within a cell, home by home and home by guest, so each pair is compared once. One row per
group, the smallest vec_id, is kept.

Vectors are stored once, in tiles of at most ``BLOCK`` rows of neighbouring cells; the cells a vector visits are bits beside it, not
copies of it. Pairs of tiles meet in a Cartesian product, which reads both and stores and shuffles neither, so the disk in use grows
with the vectors, whatever the number of pairs. Products are of single precision; what they leave in doubt is decided in double.

Skew: equal vectors are collapsed before any product. A cell of any size is cut into tiles by a
hash, and pairs of tiles are multiplied; what leaves a task is a count and one edge per vector, never the pairs.

Vectors of each dimension have centroids and cells of their own, and link with those of their size only.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing. A row without vec_id takes no part: no links, no
component, not kept. Repeated rows are equal vectors and link with each other. Labels and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.grouping import groups_of, roots, vectors_of
from seamline.llm.shared import Scratch, components, shuffle_partitions

THRESHOLD = 0.95
FIT_VECTORS = 20_000
FIT_VALUES = 4_000_000
CELL_ROWS = 1024  # results do not depend on it
MAX_CELLS = 1024
PLACED_BYTES = 32 << 20  # of distances to centroids at a time
BLOCK = 4096  # rows of a tile
TILE_BYTES = 4 << 20  # and its bytes
TILES = 64  # at least, of vectors enough for tiles of 256 rows
PART_BYTES = 16 << 20  # of the tiles one task holds
PAIRS_IN_BATCH = 8  # rows are pairs of tiles
STEP = 1024  # rows of a product
FOUND_ROWS = 1 << 20  # links of a task before they are summed up
SEED = 7


def _read(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, rows = vectors_of(batch.column(1))
            yield pa.record_batch([
                batch.column(0), pa.array(dims),
                pa.array([_digest(i, v) for i, v in zip(batch.column(0).to_pylist(), rows)], pa.binary()),
                pa.array([None if v is None else v.astype(kind).tobytes() for v in rows], pa.binary())], names=["vec_id", "dim", "digest", "vector"])
    return run


def _digest(vec_id: int | None, v: np.ndarray | None) -> bytes:
    """Of the values; unusable vectors get one of their own, so that no join meets them under one key."""
    return b"unusable %d" % (vec_id or 0) if v is None else hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest()


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, initial=0)[:, None]  # norms of very large and very small vectors stay finite
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def kind_of(vectors: DataFrame, column: str = "embedding") -> str:
    """The type in which components are stored: that of the table, or double."""
    return "<f4" if vectors.schema[column].dataType.elementType == T.FloatType() else "<f8"


def digests_of(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, dim (-1: unusable), digest of the values, vector as bytes of its components."""
    return vectors.select(F.col(id_column).cast("bigint").alias("vec_id"),
                          F.col(column).cast("array<double>").alias("embedding")).mapInArrow(
        _read(kind_of(vectors, column)), "vec_id bigint, dim bigint, digest binary, vector binary")


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        home = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        norms = np.sqrt((sums * sums).sum(axis=1))
        centroids = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], centroids)
    return centroids


def sample_of(table: DataFrame, total: int, dim: int, fit_vectors: int, fit_values: int, column: str = "unit",
              kind: str = "<f8") -> np.ndarray:
    """At most ``fit_vectors`` rows with at most ``fit_values`` numbers, by hash of the digest."""
    most = max(1, min(fit_vectors, fit_values // max(dim, 1)))
    share = int(1_000_000 * min(1.0, 0.95 * most / max(total, 1)))
    rows = table.filter(F.pmod(F.xxhash64("digest", F.lit("fit")), F.lit(1_000_000)) < max(share, 1)).select(
        "digest", column).limit(most).collect()
    rows = sorted((bytes(r["digest"]), bytes(r[column])) for r in rows)
    return np.frombuffer(b"".join(v for _, v in rows), dtype=kind).reshape(len(rows), dim)


def by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each batch by dimension."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            yield int(dim), batch.take(pa.array(np.flatnonzero(dims == dim)))


def _near(batch: pa.RecordBatch, centroids: np.ndarray, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """Where each part of the rows begins, and its cosines to the centroids."""
    n = batch.num_rows
    x = _units(np.frombuffer(b"".join(batch.column("vector").to_pylist()), dtype=kind).reshape(n, -1))
    step = max(1, PLACED_BYTES // (8 * len(centroids)))
    for at in range(0, n, step):
        yield at, x[at: at + step] @ centroids.T


def _homes(model, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in by_dim(batches):
            centroids, _, first = model.value[dim]
            for _, near in _near(batch, centroids, kind):
                cells, counts = np.unique(near.argmax(axis=1), return_counts=True)
                yield pa.record_batch([pa.array(first + cells), pa.array(counts)], names=["cell", "n"])
    return run


def _tiles_of(counts: dict[int, int], cells_of: dict[int, range], rows_of: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(first tile, number of tiles) of each cell; small cells side by side share one, in the order of the cells."""
    out, at = {}, 0
    for dim, cells in cells_of.items():
        most, filled = rows_of[dim], 0
        for cell in cells:
            n = counts.get(cell, 0)
            if filled and filled + n > most:
                at, filled = at + 1, 0
            parts = max(1, -(-n // most))
            out[cell] = at, parts
            filled += n
            if parts > 1:
                at, filled = at + parts, 0
        at += bool(filled) or out[cells[-1]][0] == at
    return out


def _assign(model, tiles, reach: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in by_dim(batches):
            centroids, gaps, first = model.value[dim]
            base = np.array([tiles.value[first + c] for c in range(len(centroids))], dtype=np.int64)
            for at, near in _near(batch, centroids, kind):
                m = len(near)
                home = near.argmax(axis=1)
                own = near[np.arange(m), home]
                later = np.arange(len(centroids))[None, :] > home[:, None]
                visits = later & (own[:, None] - near <= reach * gaps[home] + 1e-9)
                visits[np.arange(m), home] = True
                part = batch.slice(at, m)
                tile = base[home, 0] + part.column("spread").to_numpy() % base[home, 1]
                yield pa.record_batch([
                    pa.array(tile), pa.array((first + home).astype(np.int32)), part.column("dim"), pa.array([first] * m, pa.int32()), part.column("node"),
                    part.column("copies"), pa.array([v.tobytes() for v in np.packbits(visits, axis=1)], pa.binary()), part.column("vector")],
                    names=["tile", "cell", "dim", "first", "node", "copies", "visits", "vector"])
    return run


_TILE = "tile bigint, dim bigint, first int, homes array<int>, visited array<int>, node binary, copies binary, cell binary, visits binary, vectors binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (tile,), rows in groups_of(batches, ["tile"]):
        first, cell = rows["first"][0], np.array(rows["cell"], dtype=np.int32)
        visits = b"".join(rows["visits"])
        visited = np.unpackbits(np.bitwise_or.reduce(np.frombuffer(visits, np.uint8).reshape(len(cell), -1), axis=0))
        yield pa.record_batch([
            pa.array([tile]), pa.array(rows["dim"][:1]), pa.array([first], pa.int32()), pa.array([np.unique(cell)], pa.list_(pa.int32())),
            pa.array([(first + np.flatnonzero(visited)).astype(np.int32)], pa.list_(pa.int32())),
            *[pa.array([v], pa.binary()) for v in (np.array(rows["node"], dtype=np.int64).tobytes(), np.array(rows["copies"], dtype=np.int64).tobytes(),
                                                  cell.tobytes(), visits, b"".join(rows["vector"]))]],
            names=["tile", "dim", "first", "homes", "visited", "node", "copies", "cell", "visits", "vectors"])


class _Tile:
    def __init__(self, vectors: bytes, dim: int, kind: str):
        self.unit = _units(np.frombuffer(vectors, dtype=kind).reshape(-1, dim))
        self.low = self.unit.astype(np.float32)


def _linked(a: _Tile, b: _Tile, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a left and a right row whose cosine is the threshold or more."""
    dim = a.low.shape[1]
    doubt = (dim + 8) * 2.0**-23  # more than the error of a product of unit vectors in single precision
    for s in range(0, len(left), STEP):
        x = a.low[left[s: s + STEP]]
        for t in range(0, len(right), STEP):
            near = x @ b.low[right[t: t + STEP]].T
            if near.max() < threshold - doubt:
                continue
            i, j = np.nonzero(near >= threshold - doubt)
            close = np.flatnonzero(near[i, j] < threshold + doubt)
            i, j, good = left[s + i], right[t + j], np.ones(len(i), bool)
            step = max(1, (1 << 20) // dim)
            for at in range(0, len(close), step):
                k = close[at: at + step]
                good[k] = np.einsum("ij,ij->i", a.unit[i[k]], b.unit[j[k]]) >= threshold
            yield i[good], j[good]


def _summed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, links, root with a row for each node that has links."""
    node, links, root = (np.concatenate(c) for c in zip(*found))
    names, at = np.unique(np.r_[node, root], return_inverse=True)
    n = len(node)
    total = np.bincount(at[:n], weights=links, minlength=len(names)).astype(np.int64)
    return names, total, roots(len(names), at[:n], at[n:], names)


def _products(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, left, held = [], 0, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                of = lambda name: batch.column(name)[r].as_py()  # noqa: E731, B023
                ints = lambda name, kind=np.int64: np.frombuffer(batch.column(name)[r].as_buffer(), dtype=kind)  # noqa: E731, B023
                tile, other, dim, first = of("tile"), of("other"), of("dim"), of("first")
                if tile != left:
                    left, held = tile, _Tile(batch.column("vectors")[r].as_buffer(), dim, kind)
                a, b = held, held if tile == other else _Tile(batch.column("other_vectors")[r].as_buffer(), dim, kind)
                node, other_node, copies, other_copies = ints("node"), ints("other_node"), ints("copies"), ints("other_copies")
                cell, visits = ints("cell", np.int32), ints("visits", np.uint8).reshape(len(node), -1)
                for c in np.unique(cell):
                    at = int(c) - first
                    mine = np.flatnonzero(visits[:, at >> 3] & (128 >> (at & 7)))
                    for i, j in _linked(a, b, mine, np.flatnonzero(cell == c), threshold):
                        if tile == other:  # each pair once; of two cells the earlier visits the later
                            once = i < j
                            i, j = i[once], j[once]
                        if not len(i):
                            continue
                        (p, i), (q, j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
                        p, q = (node[p], copies[p]), (other_node[q], other_copies[q])
                        names = np.r_[p[0], q[0]]
                        links = np.r_[np.bincount(i, weights=q[1][j]), np.bincount(j, weights=p[1][i])]
                        found.append((names, links, roots(len(names), i, len(p[0]) + j, names)))
                        size += len(names)
                        if size > FOUND_ROWS:
                            found = [_summed(found)]
                            size = len(found[0][0])
                            if size > FOUND_ROWS // 2:
                                yield pa.record_batch([*map(pa.array, found[0])], names=["node", "n_links", "root"])
                                found, size = [], 0
        if found:
            yield pa.record_batch([*map(pa.array, _summed(found))], names=["node", "n_links", "root"])
    return run


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS,
                    max_cells: int = MAX_CELLS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    parts, kind = shuffle_partitions(spark), kind_of(vectors)
    read = scratch.settle(digests_of(vectors))
    usable = (F.col("dim") > 0) & F.col("vec_id").isNotNull()
    named = scratch.settle(read.select("vec_id", "digest", usable.alias("usable")), keep=True)
    distinct = scratch.settle(read.filter(usable).groupBy("dim", "digest").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    sizes = read.filter(usable).groupBy("dim").count().orderBy("dim").collect()  # a row per dimension
    scratch.drop(read)
    groups = scratch.settle(distinct.select("digest", "node", "copies"), keep=True)
    total, fitted, cells_of, rows_of = sum(r["count"] for r in sizes), {}, {}, {}
    first = 0
    for r in sizes:  # at most max_cells centroids in all, and one more of each dimension
        dim, n = r["dim"], r["count"]
        cells = max(1, min(max_cells * n // total, n // cell_rows))
        sample = sample_of(distinct.filter(F.col("dim") == dim), n, dim, FIT_VECTORS, FIT_VALUES, "vector", kind) if cells > 1 else ()
        centroids = spherical_kmeans(_units(sample), cells) if len(sample) else np.zeros((1, dim))
        fitted[dim] = centroids, np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 1e-12)), first
        cells_of[dim] = range(first, first + len(centroids))
        rows_of[dim] = min(block, max(256, n // TILES), max(64, TILE_BYTES // (int(kind[2:]) * dim + len(centroids) // 8 + 20)))
        first += len(centroids)
    model = spark.sparkContext.broadcast(fitted)
    reach = float(np.sqrt(max(0.0, 1 - threshold**2))) if threshold > 0 else 1.0
    counts = distinct.mapInArrow(_homes(model, kind), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    tiles_of = _tiles_of({r["cell"]: r["n"] for r in counts.collect()}, cells_of, rows_of)  # a row per cell
    n_tiles = max((at + n for at, n in tiles_of.values()), default=1)
    tiles = spark.sparkContext.broadcast(tiles_of)
    spread = F.pmod(F.xxhash64("node", F.lit("tile")), F.lit(1 << 40)).alias("spread")
    placed = distinct.select("dim", "node", "copies", "vector", spread).mapInArrow(
        _assign(model, tiles, reach, kind), "tile bigint, cell int, dim bigint, first int, node bigint, copies bigint, visits binary, vector binary")
    stored = scratch.settle(placed.repartition(max(parts, -(-n_tiles // 4)), "tile").sortWithinPartitions("tile", "cell").mapInArrow(_gathered, _TILE))

    # Each task reads a part of the tiles on either side; the parts are small, and as many as keep all tasks busy.
    stored_bytes = sum(r["count"] * (int(kind[2:]) * r["dim"] + len(cells_of[r["dim"]]) // 8 + 20) for r in sizes)
    sides = max(math.isqrt(4 * parts) + 1, -(-stored_bytes // PART_BYTES))
    ours = stored.select("tile", "dim", "first", "visited", "node", "copies", "visits", "vectors").coalesce(sides)
    theirs = stored.select(F.col("tile").alias("other"), "homes", "cell", *[F.col(c).alias(f"other_{c}") for c in ("node", "copies", "vectors")]).coalesce(sides)
    # Tiles are in the order of their cells, and a vector visits its own cell and later ones.
    meet = (F.col("tile") <= F.col("other")) & F.arrays_overlap("visited", "homes")
    pairs = ours.hint("shuffle_replicate_nl").join(theirs, meet).drop("visited", "homes")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows_in_batch = spark.conf.get(size)
    spark.conf.set(size, str(PAIRS_IN_BATCH))
    try:
        found = scratch.settle(pairs.mapInArrow(_products(threshold, kind), "node bigint, n_links bigint, root bigint"), keep=True)
    finally:
        spark.conf.set(size, rows_in_batch)

    links = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    linked = scratch.settle(components(scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b"))), keep=True)
    of_vector = groups.join(links, "node", "left").join(linked, "node", "left")
    result = named.join(of_vector, "digest", "left")
    component = F.when(F.col("usable"), F.coalesce("component", "node")).otherwise(F.col("vec_id"))
    return result.select(
        "vec_id", F.when(F.col("usable"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
