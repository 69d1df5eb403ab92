"""Operator 5: packing documents into sequences of fixed length, by bin completion.

Each document is its token ids and one end id. A longer one is cut into full pieces; only its first piece may be
shorter. What remains to pack depends on lengths alone, and there are at most ``capacity`` of them: so the corpus is
reduced to a histogram, a table of bounded size, on which bin completion runs once. Around the largest length left it
enumerates fillings that no other dominates, fullest first, uses a filling as often as the histogram
allows, and searches on depth first. Branches whose waste exceeds what the best solution so far leaves are cut; the
first solutions come from best-fit decreasing. The search stops when the best solution meets the lower bound, or
after ``MAX_NODES`` nodes with the best one found: bounded work that doesn't depend on the number of documents.

Fillings then become sequences: the pieces of a length are ranked by a hash, and ranks are dealt to the
places that the fillings have for that length. Ranking is a running total over hash ranges, so any share of the
documents may have one length.

Defined results: null and empty texts are the end id alone. Repeated rows, and rows without doc_id, are
documents of their own. An empty table packs into nothing. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.shared import Scratch, doc_texts, running_total
from seamline.llm.tokens import encoder
from seamline.llm.words import SLICE_ROWS

CAPACITY = 2048
END = 0
MAX_NODES = 4_000
MAX_FILLINGS = 12
ENUMERATED = 300

Filling = tuple[tuple[int, int], ...]  # (length, how often), longest first
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced=True).encode
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            ids, offsets = encode(batch.column(1))
            out: list[tuple] = []
            for k, doc in enumerate(batch.column(0).to_pylist()):
                one = np.append(ids[offsets[k]: offsets[k + 1]], np.uint32(END)).astype("<u4")
                out += [(doc, p, s, n, zlib.crc32(one[s: s + n].data)) for p, (s, n) in enumerate(cut(len(one), capacity))]
            doc, piece, start, length, crc = zip(*out) if out else ((),) * 5
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


# --- bin completion on a histogram --------------------------------------------------------------

def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: by total length, and by lengths too large to share a bin (Martello and Toth)."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    for k in sorted({min(n, capacity - n) for n in counts if 0 < n < capacity} | {0})[:256]:
        large = sum(c for n, c in counts.items() if n > capacity - k)
        middle = sum(c for n, c in counts.items() if capacity // 2 < n <= capacity - k)
        spare = middle * capacity - sum(n * c for n, c in counts.items() if capacity // 2 < n <= capacity - k)
        small = sum(n * c for n, c in counts.items() if k <= n <= capacity // 2)
        best = max(best, large + middle + max(0, -(-(small - spare) // capacity)))
    return best


def fillings(counts: np.ndarray, room: int, most: int = MAX_FILLINGS) -> list[list[int]]:
    """Undominated ways to fill ``room``, fullest first: lists of lengths, longest first.

    ``counts[n]`` pieces of length n are left. No filling can take in another piece. Enumeration goes from long to
    short pieces and gives up after ``ENUMERATED`` steps; the longest-first filling is always among the results.
    """
    lengths = np.flatnonzero(counts[: room + 1]).tolist()
    if not lengths:
        return [[]]
    least = lengths[0]
    found: dict[tuple[int, ...], int] = {}
    steps = [0, 0]  # taken, fillings without waste

    def extend(taken: list[int], left: int, top: int) -> None:
        i = bisect_right(lengths, left, 0, top + 1) - 1
        while i >= 0 and taken.count(lengths[i]) >= counts[lengths[i]]:
            i -= 1
        if i < 0:
            found.setdefault(tuple(taken), left)
            steps[1] += not left
            return
        for j in range(i, -1, -1):
            n = lengths[j]
            if j < i and left - n < least:
                continue  # the longer piece in its place dominates
            if taken.count(n) < counts[n]:
                steps[0] += 1
                extend([*taken, n], left - n, j)
                if steps[0] > ENUMERATED or steps[1] > 2:
                    return

    extend([], room, len(lengths) - 1)
    out: list[list[int]] = []
    for f, _ in sorted(found.items(), key=lambda x: (x[1], len(x[0]), [-n for n in x[0]])):
        if not any(dominates(o, f) for o in out):
            out.append(list(f))
        if len(out) == most:
            break
    return out


def dominates(one: list[int], other: tuple[int, ...]) -> bool:
    """Whether all of ``other`` fits into the lengths of ``one``, each taking up some; judged up to 6 pieces."""
    if len(one) > len(other) or len(other) > 6:
        return False

    def place(k: int, left: list[int]) -> bool:
        if k == len(other):
            return True
        return any(other[k] <= r and place(k + 1, [*left[:i], r - other[k], *left[i + 1:]]) for i, r in enumerate(left))

    return place(0, list(one))


def _apply(counts: np.ndarray, bin_: list[int]) -> int:
    """Uses a bin as often as the histogram allows; how often."""
    lengths, need = np.unique(bin_, return_counts=True)
    times = int((counts[lengths] // need).min())
    counts[lengths] -= times * need
    return times


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on a histogram: each length, longest first, goes to the fullest bins with room."""
    rooms: dict[int, list[tuple[list[int], int]]] = {}
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = min((r for r in rooms if r >= n), default=None)
            if room is None:
                each = capacity // n
                if left >= each:
                    rooms.setdefault(capacity - each * n, []).append(([n] * each, left // each))
                    left %= each
                if left:
                    rooms.setdefault(capacity - left * n, []).append(([n] * left, 1))
                    left = 0
                continue
            group, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each = min(room // n, left)
            used = min(times, left // each)
            rooms.setdefault(room - each * n, []).append((group + [n] * each, used))
            if times > used:
                rooms.setdefault(room, []).append((group, times - used))
            left -= used * each
    return [g for groups in rooms.values() for g in groups]


def complete_bins(histogram: dict[int, int], capacity: int, max_nodes: int = MAX_NODES) -> list[tuple[list[int], int]]:
    """Bins (lengths, how often) that hold the histogram, in as few as the bounded search finds."""
    histogram = {n: c for n, c in histogram.items() if c}
    if not histogram:
        return []
    bound = lower_bound(histogram, capacity)
    total = sum(n * c for n, c in histogram.items())
    best = best_fit(histogram, capacity)
    fewest = sum(t for _, t in best)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        counts[n] = c
    nodes = 0
    # depth first: (left, bins so far as a linked list, their number, their waste, choices still to try)
    stack: list[tuple] = [(counts, None, 0, 0, None)]
    while stack and fewest > bound and nodes < max_nodes:
        left, bins, used, waste, choices = stack.pop()
        if waste > (fewest - 1) * capacity - total:
            continue
        if choices is None:
            some = np.flatnonzero(left)
            if not len(some):
                if used < fewest:
                    best, fewest = [], used
                    while bins:
                        best.append(bins[1])
                        bins = bins[0]
                continue
            nodes += 1
            largest = int(some[-1])
            left[largest] -= 1
            choices = [[largest, *f] for f in fillings(left, capacity - largest)]
            left[largest] += 1
        if len(choices) > 1:
            stack.append((left.copy(), bins, used, waste, choices[1:]))
        times = _apply(left, choices[0])
        stack.append((left, (bins, (choices[0], times)), used + times, waste + times * (capacity - sum(choices[0])), None))
    return best


# --- from fillings to sequences -------------------------------------------------------------------

def places(bins: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, places in a sequence, then their offsets), by first rank."""
    out: dict[int, list[list[int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, times in bins:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in lengths:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, o in offsets.items():
            out.setdefault(n, []).append([ranks.get(n, 0), sequence, len(o), *o])
            ranks[n] = ranks.get(n, 0) + times * len(o)
        sequence += times
    return {n: np.array([r + [0] * (max(map(len, rows)) - len(r)) for r in rows], dtype=np.int64) for n, rows in out.items()}


def _dealer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence = np.zeros(len(length), dtype=np.int64)
            offset = np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                rows, mine = table[int(n)], length == n
                at = np.searchsorted(rows[:, 0], rank[mine], "right") - 1
                step, place = np.divmod(rank[mine] - rows[at, 0], rows[at, 2])
                sequence[mine] = rows[at, 1] + step
                offset[mine] = rows[at, 3 + place]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*keep, pa.array(sequence), pa.array(offset)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    return doc_texts(docs).mapInArrow(_pieces(tokenizer, capacity), PIECES)


def pack(docs: DataFrame, tokenizer: str, scratch: Scratch, capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> DataFrame:
    """Every piece with its sequence_id and the offset there; sequences have no gaps."""
    pieces = scratch.settle(pieces_of(docs, tokenizer, capacity), keep=True)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    model = docs.sparkSession.sparkContext.broadcast(places(complete_bins(counts, capacity, max_nodes)))
    ordered = pieces.withColumn("one", F.lit(1)).withColumn(
        "order", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("tie", F.struct("doc_id", "piece", "ids_crc32"))
    ranked = running_total(ordered, ["length"], "order", "one", "rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("bigint").alias("rank")).mapInArrow(
        _dealer(model), PIECES + ", sequence_id bigint, offset bigint")
