"""Operator 1: quality classifier, a factorisation machine over hashed words, structure and metadata.

The score of a feature vector x is sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise part is
computed in linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2).

Features: words hashed into ``2**WORD_BITS`` buckets with weight (count / words)**0.5; about twenty structure
statistics of the whole text, each cut into ``LEVELS`` levels of weight 1; metadata: the level of ``n_chars`` and
whether it is absent or differs from the text. Label, lang, source and doc_id are never features.

The model is fitted on a bounded sample of labelled rows (``max_train``, by hash of the id) with AdaGrad; its size is
fixed by the parameters (about 5 MB), so sending it to the executors is bounded. Scoring reads every whole text once
and shuffles nothing.

Defined results: null and empty texts are scored by structure and metadata alone; a row without doc_id is scored and
never used for fitting; labels that are null or neither 0 nor 1 are ignored; repeated label rows count repeatedly.
Without any usable label, or with one kind only, every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.shared import held_out
from seamline.llm.words import Words, words_of

WORD_BITS = 16
LEVELS = 12
FACTORS = 8
MAX_TRAIN = 12_000
FOLDS = 5
THRESHOLD = 0.3

#: Byte classes counted in each text.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".!?", "comma": b",;:", "bar": b"|", "shout": b"!",
    "symbol": b"#$%&*@^~_=+<>{}[]\\/`", "quote": b"\"'()-", "high": bytes(range(128, 256)),
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
_STATISTICS = [*_CLASSES, "words", "bytes", "word_length", "distinct", "top_word", "repeats", "line_length", "n_chars", "n_chars_kind"]
N_FEATURES = (1 << WORD_BITS) + len(_STATISTICS) * (LEVELS + 1)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _levels(x: np.ndarray) -> np.ndarray:
    """Shares from 0 to 1 by powers of two, finer towards 0; 0 has a level of its own."""
    return np.where(x <= 0, 0, np.clip(LEVELS + np.floor(np.log2(np.maximum(x, 1e-9))).astype(int), 1, LEVELS))


def _sizes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(np.maximum(x, 0) + 1) * LEVELS / 20).astype(int), 0, LEVELS)


def features(chunk: Words, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight) of all features of a chunk, ordered by text."""
    m = chunk.n_texts
    counts = chunk.counts()
    hashes = chunk.hashes()
    bucket = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pairs, tally = np.unique((chunk.text << WORD_BITS) | bucket, return_counts=True)
    owner, bucket = pairs >> WORD_BITS, pairs & ((1 << WORD_BITS) - 1)
    size = np.diff(chunk.offsets)
    running = {k: np.r_[0, np.cumsum(t[chunk.data])] for k, t in _TABLES.items()}
    count = {k: c[chunk.offsets[1:]] - c[chunk.offsets[:-1]] for k, c in running.items()}
    top = np.zeros(m, dtype=np.int64)
    np.maximum.at(top, owner, tally)
    same = np.zeros(m, dtype=np.int64)
    if len(chunk.starts) > 1:  # words that repeat the word before them
        again = (hashes[1:] == hashes[:-1]) & (chunk.text[1:] == chunk.text[:-1])
        same = np.bincount(chunk.text[1:][again], minlength=m)
    lengths = np.bincount(chunk.text, weights=chunk.ends - chunk.starts, minlength=m)
    known = np.array([-1 if x is None else x for x in n_chars], dtype=np.float64)
    # code points: bytes that do not continue another
    points = np.r_[0, np.cumsum((chunk.data & 0xC0) != 0x80)]
    points = points[chunk.offsets[1:]] - points[chunk.offsets[:-1]]
    level = {k: _levels(_share(c, size)) for k, c in count.items()} | {
        "words": _sizes(counts), "bytes": _sizes(size), "word_length": _sizes(8 * _share(lengths, counts)),
        "distinct": _levels(_share(np.bincount(owner, minlength=m), counts)), "top_word": _levels(_share(top, counts)),
        "repeats": _levels(_share(same, counts)), "line_length": _sizes(_share(size, count["line"] + 1)),
        "n_chars": _sizes(known), "n_chars_kind": np.where(known < 0, 0, np.where(known == points, 1, 2))}
    dense = np.stack([(1 << WORD_BITS) + i * (LEVELS + 1) + level[k] for i, k in enumerate(_STATISTICS)], axis=1)
    text = np.concatenate([owner, np.repeat(np.arange(m), len(_STATISTICS))])
    feature = np.concatenate([bucket, dense.ravel()])
    weight = np.concatenate([np.sqrt(tally / counts[owner]), np.ones(dense.size)]).astype(np.float32)
    order = np.argsort(text, kind="stable")
    return text[order], feature[order].astype(np.int32), weight[order]


@dataclass
class Machine:
    """A factorisation machine; ``constant`` overrides it where there was nothing to learn."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    constant: float | None = None

    def margins(self, first: np.ndarray, feature: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Log-odds of rows whose features begin at ``first``; every row has at least one."""
        scaled = self.factors[feature] * weight[:, None]
        total = np.add.reduceat(scaled, first, axis=0)
        squares = np.add.reduceat(scaled * scaled, first, axis=0)
        linear = np.add.reduceat(self.linear[feature] * weight, first)
        return self.bias + linear + 0.5 * (total * total - squares).sum(axis=1)

    def scores(self, first, feature, weight) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.margins(first, feature, weight), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, factors: int = FACTORS, epochs: int = 6,
        batch: int = 64, rate: float = 0.08, decay: float = 1e-5, seed: int = 1) -> Machine:
    """Logistic loss by AdaGrad on sparse rows of (feature, weight)."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    machine = Machine(0.0, np.zeros(N_FEATURES, dtype=np.float32),
                      rng.normal(0, 0.01, (N_FEATURES, factors)).astype(np.float32),
                      share if share in (0.0, 1.0) or not len(labels) else None)
    if machine.constant is not None:
        return machine
    machine.bias = float(np.log(share / (1 - share)))
    seen_bias, seen_linear = 1e-6, np.full(N_FEATURES, 1e-6, dtype=np.float32)
    seen_factors = np.full((N_FEATURES, factors), 1e-6, dtype=np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at: at + batch]
            lengths = np.array([len(rows[i][0]) for i in some])
            first = np.r_[0, np.cumsum(lengths)[:-1]]
            feature = np.concatenate([rows[i][0] for i in some])
            weight = np.concatenate([rows[i][1] for i in some])
            scaled = machine.factors[feature] * weight[:, None]
            total = np.add.reduceat(scaled, first, axis=0)
            margin = machine.bias + np.add.reduceat(machine.linear[feature] * weight, first) + 0.5 * (
                total * total - np.add.reduceat(scaled * scaled, first, axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) / len(some)
            each = np.repeat(error, lengths).astype(np.float32) * weight
            unique, where = np.unique(feature, return_inverse=True)
            by = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[by], np.arange(len(unique)))
            g_linear = np.add.reduceat(each[by], cuts) + decay * machine.linear[unique]
            g_factors = np.add.reduceat((each[:, None] * (np.repeat(total, lengths, axis=0) - scaled))[by], cuts, axis=0)
            g_factors += decay * machine.factors[unique]
            seen_linear[unique] += g_linear**2
            machine.linear[unique] -= rate * g_linear / np.sqrt(seen_linear[unique])
            seen_factors[unique] += g_factors**2
            machine.factors[unique] -= rate * 0.5 * g_factors / np.sqrt(seen_factors[unique])
            seen_bias += float(error.sum()) ** 2
            machine.bias -= rate * float(error.sum()) / seen_bias**0.5
    return machine


def _feature_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in words_of(batch.column("text")):
            n_chars = batch.column("n_chars").slice(chunk.first, chunk.n_texts).to_pylist()
            text, feature, weight = features(chunk, n_chars)
            cuts = np.searchsorted(text, np.arange(chunk.n_texts + 1))
            rows = [(feature[i:j].tobytes(), weight[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:])]
            yield pa.record_batch([batch.column("quality").slice(chunk.first, chunk.n_texts),
                                   pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                                  names=["quality", "features", "weights"])


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       n_chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, folds: int = FOLDS) -> Machine:
    """Fits on at most ``max_train`` labelled rows that are not held out, chosen by a hash of the id."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        "doc_id is not null and quality in (0, 1)").filter(~held_out("doc_id", folds))
    total = usable.count()
    share = min(1.0, max_train / max(total, 1))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = _inputs(docs).join(chosen, "doc_id").mapInArrow(
        _feature_lists, "quality int, features binary, weights binary").limit(max_train).collect()
    rows = sorted(rows, key=lambda r: (r.features, r.weights, r.quality))  # the order of tasks must not matter
    return fit([(np.frombuffer(r.features, dtype=np.int32), np.frombuffer(r.weights, dtype=np.float32)) for r in rows],
               np.array([r.quality for r in rows], dtype=np.float64))


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = []
            for chunk in words_of(batch.column(at)):
                n_chars = batch.column("n_chars").slice(chunk.first, chunk.n_texts).to_pylist()
                text, feature, weight = features(chunk, n_chars)
                scores.append(machine.scores(np.searchsorted(text, np.arange(chunk.n_texts)), feature, weight))
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, machine: Machine, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted, for every row."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    scored = _inputs(docs).mapInArrow(_scorer(model), "doc_id bigint, score double")
    return scored.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def _filter(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value
        for batch in batches:
            keep = []
            for chunk in words_of(batch.column("text")):
                known = batch.column("n_chars").cast(pa.int64()) if "n_chars" in batch.schema.names else pa.nulls(batch.num_rows, pa.int64())
                text, feature, weight = features(chunk, known.slice(chunk.first, chunk.n_texts).to_pylist())
                keep.append(machine.scores(np.searchsorted(text, np.arange(chunk.n_texts)), feature, weight) >= threshold)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))
    return run


def keep_good(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.mapInArrow(_filter(model, threshold), docs.schema)
