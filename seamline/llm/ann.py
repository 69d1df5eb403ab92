"""Operator 8: approximate nearest neighbours by largest inner product, with balanced posting lists.

Vectors get one more coordinate so that all have the norm of the longest; nearest by distance is then largest by
inner product. Centroids come from k-means with a penalty for large lists, fitted on a bounded sample
(``FIT_VECTORS`` rows by hash, ``FIT_VALUES`` numbers in all); every vector is indexed. There are as many lists as twice the root
of the number of vectors, so lists and the share of them that a query visits balance, up to ``MAX_LISTS``, which the sample
can support; from about a million vectors on lists grow. A vector goes to the list of its
nearest centroid and, near a boundary, to those of further centroids within ``(1 + CLOSURE)`` times that distance,
at most ``COPIES``. A query finds centroids by
best-first search in a graph of centroids held in memory, and its lists by distance: the nearest lists that hold ``LEAST``
members, and all within a ratio of the last of these. The ratio is measured, not set: a sample of at most ``TRIALS`` vectors
by hash is compared with every member, and the ratio is the least one at which the lists hold the share
``RECALL`` of their true neighbours. Members of a query's lists are compared exactly.

Skew: of equal vectors the smallest ids suffice, so no more than one more than ``k`` different ids of each are indexed. Lists and the queries of a list
are cut into blocks by a hash; a block of queries meets a block of members in one product. A task keeps the best ``k``
of each query over all its lists, and passes on what exceeds a bounded buffer.

Vectors of each dimension have centroids, lists and norm of their own; a query's candidates are those of its size.

Defined results: vectors that are null, empty, zero or hold null or non-finite components are neither queries nor
candidates; so are rows without an id. Ties go to the smaller id. Rows that share the id of a query are not its candidates; a repeated query id is one query.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.grouping import groups_of, vectors_of
from seamline.llm.neardup import by_dim, sample_of
from seamline.llm.shared import Scratch, shuffle_partitions

K = 20
FIT_VECTORS = 20_000
FIT_VALUES = 4_000_000
LIST_ROWS = 40
MAX_LISTS = 2048
COPIES = 2
CLOSURE = 0.05
RECALL = 0.95
TRIALS = 500
#: Members of the lists whose distance the ratio starts from; several times ``K``
LEAST = 1000
DEGREE = 16
STRIDE = 8  # centroids whose neighbours are looked at together
BLOCK = 2048
SLICE = 256  # queries whose lists are found at a time
BUFFER = 200_000
CHUNK_VALUES = 2 << 20  # distances computed at a time
SEED = 8


@dataclass
class Index:
    """Centroids in the space with one more coordinate, their graph, and the norm all vectors get."""

    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    sizes: np.ndarray
    ratio: float = np.inf

    def search(self, query: np.ndarray, least: int) -> list[int]:
        """The nearest lists that hold ``least`` members, and those within ``1 + ratio`` times the distance of the last of
        them, nearest first, by best-first search."""
        c = self.centroids
        seen = np.zeros(len(c), dtype=bool)
        heap: list[tuple[float, int]] = []

        def reach(nodes: np.ndarray) -> None:
            nodes = nodes[~seen[nodes]]
            seen[nodes] = True
            for d, i in zip(np.sqrt(((c[nodes] - query) ** 2).sum(axis=1)).tolist(), nodes.tolist()):
                heapq.heappush(heap, (d, i))

        reach(np.zeros(1, dtype=np.int64))
        found: list[tuple[float, int]] = []
        members, far = 0, 0.0  # far: no less than the distance the ratio starts from
        while heap:
            some = [heapq.heappop(heap) for _ in range(min(STRIDE, len(heap)))]
            if members >= least and len(found) >= DEGREE and some[0][0] > (1.03 + self.ratio) * far:
                break
            found += some
            for d, i in some:
                if members < least:
                    far = max(far, d)
                members += self.sizes[i]
            reach(np.unique(self.graph[[i for _, i in some]]))
        return self.chosen(sorted(found), least)

    def chosen(self, by_distance: list[tuple[float, int]], least: int) -> list[int]:
        """Of lists in order of distance, those a query visits."""
        edge, members, out = np.inf, 0, []
        for d, i in by_distance:
            if d > edge:
                break
            out.append(i)
            members += self.sizes[i]
            if members >= least and edge == np.inf:
                edge = (1 + self.ratio) * d + 1e-12
        return out

    def ratios(self, query: np.ndarray, least: int) -> np.ndarray:
        """Of each list, the ratio from which on a query visits it."""
        d = np.sqrt(((self.centroids - query) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        start = d[order[min(int(np.searchsorted(np.cumsum(self.sizes[order]), least)), len(d) - 1)]]
        return np.maximum(d / max(start, 1e-300) - 1, 0)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims, rows = vectors_of(batch.column(1))
        yield pa.record_batch([
            batch.column(0), pa.array(dims), pa.array([0.0 if v is None else float(np.sqrt((v * v).sum())) for v in rows]),
            pa.array([None if v is None else hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() for v in rows], pa.binary()),
            pa.array([None if v is None else v.tobytes() for v in rows], pa.binary())],
            names=["vec_id", "dim", "norm", "digest", "vector"])


def balanced_kmeans(sample: np.ndarray, k: int, rounds: int = 10, penalty: float = 0.05, seed: int = SEED) -> np.ndarray:
    """Centroids of at most ``k`` lists; a list larger than the mean repels."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    extra = np.zeros(len(centroids))
    step = max(1, CHUNK_VALUES // len(centroids))
    for _ in range(rounds):
        home, least = [], []
        for x in (sample[at: at + step] for at in range(0, len(sample), step)):
            distance = (centroids * centroids).sum(axis=1) - 2 * x @ centroids.T + (x * x).sum(axis=1)[:, None]
            home.append((distance + extra).argmin(axis=1))
            least.append(distance.min(axis=1))
        home = np.concatenate(home)
        size = np.bincount(home, minlength=len(centroids))
        extra = penalty * np.concatenate(least).mean() * (size / max(size.mean(), 1) - 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    return centroids


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with one more coordinate, all of the given norm."""
    return np.hstack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(axis=1), 0))[:, None]])


def centroid_graph(centroids: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbours of each centroid: its nearest, and the next in a ring so that all are reachable."""
    n = len(centroids)
    distance = (centroids * centroids).sum(axis=1) - 2 * centroids @ centroids.T
    np.fill_diagonal(distance, np.inf)
    near = np.argsort(distance, axis=1, kind="stable")[:, : min(degree, max(n - 1, 1))]
    return np.hstack([near, ((np.arange(n) + 1) % n)[:, None]])


def _lists(model, closure: float, copies: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in by_dim(batches):
            index = model.value[dim]
            c = index.centroids
            step = max(1, CHUNK_VALUES // len(c))
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                x = lifted(_matrix(part.column("vector")), index.norm)
                distance = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T, 0))
                order = np.argsort(distance, axis=1, kind="stable")[:, :copies]
                near = np.take_along_axis(distance, order, 1)
                rows, place = np.nonzero(near <= (1 + closure) * near[:, :1] + 1e-12)
                yield _in_lists(part, rows, order[rows, place])
    return run


def _in_lists(batch: pa.RecordBatch, rows, lists) -> pa.RecordBatch:
    take = pa.array(rows, pa.int64())
    return pa.record_batch([batch.column("dim").take(take), pa.array(lists, pa.int32()), batch.column("vec_id").take(take),
                            batch.column("vector").take(take)], names=["dim", "list", "vec_id", "vector"])


def _as_queries(x: np.ndarray, norm: float) -> np.ndarray:
    """Queries of the common norm in the space with one more coordinate."""
    return np.hstack([x * (norm / np.sqrt((x * x).sum(axis=1)))[:, None], np.zeros((len(x), 1))])


def _probes(model, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in by_dim(batches):
            index = model.value[dim]
            for part in (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE)):
                found = [index.search(q, least) for q in _as_queries(_matrix(part.column("vector")), index.norm)]
                yield _in_lists(part, [i for i, some in enumerate(found) for _ in some], [j for some in found for j in some])
    return run


def _tried(trials, k: int):
    """The members of a task that are nearest to each trial vector, with their lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, ...]] = {}
        for dim, batch in by_dim(batches):
            ids, q = trials.value.get(dim, ((), ()))
            if not len(ids):
                continue
            step = max(1, CHUNK_VALUES // len(ids))
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                vec, lists = part.column("vec_id").to_numpy(), part.column("list").to_numpy()
                score = q @ _matrix(part.column("vector")).T
                score[ids[:, None] == vec[None, :]] = -np.inf
                n = min(k, len(vec))
                top = np.argpartition(-score, n - 1, axis=1)[:, :n]
                new = (np.take_along_axis(score, top, 1), vec[top], lists[top])
                if dim in held:
                    new = tuple(np.hstack(both) for both in zip(held[dim], new))
                    top = np.argsort(-new[0], axis=1, kind="stable")[:, :k]
                    new = tuple(np.take_along_axis(a, top, 1) for a in new)
                held[dim] = new
        for dim, (score, vec, lists) in held.items():
            i, j = np.nonzero(np.isfinite(score))
            yield pa.record_batch([pa.array(np.full(len(i), dim)), pa.array(i), pa.array(vec[i, j]), pa.array(lists[i, j], pa.int32()),
                                   pa.array(score[i, j])], names=["dim", "trial", "vec_id", "list", "score"])
    return run


def _measure_ratios(spark, members: DataFrame, indexes: dict[int, Index], trials: dict[int, tuple], k: int, copies: int,
                    least: int, recall: float) -> None:
    """Sets the ratio of each index from the true ``k`` nearest members of its trial vectors."""
    tried = members.mapInArrow(_tried(spark.sparkContext.broadcast(trials), k * copies),
                               "dim bigint, trial bigint, vec_id bigint, list int, score double")
    nearest_of = Window.partitionBy("dim", "trial").orderBy(F.desc("score"), "vec_id")
    true = tried.groupBy("dim", "trial", "vec_id").agg(F.max("score").alias("score"), F.collect_set("list").alias("lists")).withColumn(
        "n", F.row_number().over(nearest_of)).filter(F.col("n") <= k)
    needed: dict[int, list[float]] = {}
    ratios: dict[tuple[int, int], np.ndarray] = {}
    for row in true.select("dim", "trial", "lists").collect():  # at most k rows of each trial vector
        dim, trial = row["dim"], row["trial"]
        if (dim, trial) not in ratios:
            index = indexes[dim]
            ratios[dim, trial] = index.ratios(_as_queries(trials[dim][1][trial: trial + 1], index.norm)[0], least)
        needed.setdefault(dim, []).append(float(ratios[dim, trial][row["lists"]].min()))
    for dim, values in needed.items():
        values.sort()
        indexes[dim].ratio = values[min(len(values) - 1, int(np.ceil(recall * len(values))))]


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best different candidates of each query: largest score, then smallest id."""
    if not len(query):
        return query, vec, score
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    again = np.r_[False, (query[1:] == query[:-1]) & (vec[1:] == vec[:-1])]
    query, vec, score = query[~again], vec[~again], score[~again]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.empty(0, dtype=bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) if len(query) else first
    keep = np.arange(len(query)) - start < k
    return query[keep], vec[keep], score[keep]


def _compare(k: int):
    def one(rows: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        ask = np.array(rows["query"], dtype=bool)
        ids = np.array(rows["vec_id"], dtype=np.int64)
        if not ask.any() or ask.all():
            return None
        x = np.frombuffer(b"".join(rows["vector"]), dtype=np.float64).reshape(len(ids), -1)
        q, qid, x, xid = x[ask], ids[ask], x[~ask], ids[~ask]
        score = q @ x.T
        score[qid[:, None] == xid[None, :]] = -np.inf
        # an id may have several vectors: its best one counts, once
        by = np.argsort(xid, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(xid[by]) != 0])
        tops = np.maximum.reduceat(score[:, by], first, axis=1)
        most = min(k, len(first))
        # all that may be among the k best once scores are exact
        edge = np.partition(tops, len(first) - most, axis=1)[:, len(first) - most]
        size = np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
        i, j = np.nonzero((score >= (edge - 1e-12 * size)[:, None]) & np.isfinite(score))
        return best(qid[i], xid[j], (q[i] * x[j]).sum(axis=1), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            return best(*(np.concatenate([h[c] for h in held]) for c in range(3)), k)

        def out(rows):
            return pa.record_batch([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2])], names=["query_id", "vec_id", "score"])

        for _, rows in groups_of(batches, ["dim", "list", "block", "queries"]):
            found = one(rows)
            if found is None:
                continue
            held.append(found)
            size += len(found[0])
            if size > 2 * BUFFER:
                held = [merged()]
                size = len(held[0][0])
                if size > BUFFER:
                    yield out(held[0])
                    held, size = [], 0
        if held:
            yield out(merged())
    return run


def nearest(vectors: DataFrame, scratch: Scratch, is_query, k: int = K, copies: int = COPIES, closure: float = CLOSURE,
            recall: float = RECALL, least: int = LEAST, max_lists: int = MAX_LISTS, block: int = BLOCK,
            id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which ``is_query`` (a condition on vec_id) holds, its ``k`` nearest."""
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    read = scratch.settle(vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
                          .mapInArrow(_read, "vec_id bigint, dim bigint, norm double, digest binary, vector binary"), keep=True)
    valid = read.filter("vec_id is not null and dim > 0")
    shapes = valid.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy("dim").collect()  # a row per dimension
    if not shapes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    usable, total, indexes = valid, sum(r["n"] for r in shapes), {}
    few = Window.partitionBy("digest", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    fewer = Window.partitionBy("digest").orderBy("vec_id")
    indexed = usable.dropDuplicates(["digest", "vec_id"]).withColumn("_n", F.row_number().over(few)).filter(F.col("_n") <= k + 1).withColumn(
        "_n", F.row_number().over(fewer)).filter(F.col("_n") <= k + 1)
    lot, trials = F.xxhash64("digest", F.lit("trial")), {}
    for r in shapes:  # at most max_lists centroids in all, and one more of each dimension
        dim, n, norm = r["dim"], r["n"], r["norm"]
        lists = max(1, min(max_lists * n // total, n // LIST_ROWS, int(2 * n**0.5)))
        sample = sample_of(valid.filter(F.col("dim") == dim), n, dim, FIT_VECTORS, FIT_VALUES, "vector") if lists > 1 else ()
        centroids = balanced_kmeans(lifted(sample, norm), lists) if len(sample) else np.zeros((1, dim + 1))
        indexes[dim] = Index(centroids, centroid_graph(centroids), norm, np.zeros(len(centroids), dtype=np.int64))
        if lists > 1:
            drawn = valid.filter(F.col("dim") == dim).groupBy("digest").agg(F.min("vec_id").alias("vec_id")).orderBy(
                lot, "digest").limit(max(1, TRIALS * n // total))
            rows = valid.join(F.broadcast(drawn), ["digest", "vec_id"]).dropDuplicates(["digest", "vec_id"]).orderBy("digest").collect()
            trials[dim] = np.array([v["vec_id"] for v in rows]), np.frombuffer(b"".join(v["vector"] for v in rows)).reshape(len(rows), dim)
    model = spark.sparkContext.broadcast(indexes)

    members = scratch.settle(indexed.mapInArrow(_lists(model, closure, copies), "dim bigint, list int, vec_id bigint, vector binary"), keep=True)
    for row in members.groupBy("dim", "list").count().collect():  # a row per list
        indexes[row["dim"]].sizes[row["list"]] = row["count"]
    if trials:
        _measure_ratios(spark, members, indexes, trials, k, copies, least, recall)
    sized = spark.sparkContext.broadcast(indexes)
    asked = scratch.settle(usable.filter(is_query(F.col("vec_id"))).mapInArrow(
        _probes(sized, least), "dim bigint, list int, vec_id bigint, vector binary"), keep=True)

    # at most max_lists rows: how many blocks of members and of queries a list has
    blocks = members.groupBy("dim", "list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(
        asked.groupBy("dim", "list").agg(F.ceil(F.count("*") / block).cast("int").alias("query_blocks")), ["dim", "list"])
    salt = F.xxhash64("vec_id", F.lit("block"))
    split_members = members.join(F.broadcast(blocks), ["dim", "list"]).select(
        "dim", "list", F.pmod(salt, "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("queries"), F.lit(False).alias("query"), "vec_id", "vector")
    split_queries = asked.join(F.broadcast(blocks), ["dim", "list"]).select(
        "dim", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(salt, "query_blocks").cast("int").alias("queries"), F.lit(True).alias("query"), "vec_id", "vector")
    found = split_members.unionByName(split_queries).repartition(parts, "dim", "list", "block", "queries").sortWithinPartitions(
        "dim", "list", "block", "queries").mapInArrow(_compare(k), "query_id bigint, vec_id bigint, score double")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
