"""Packed products against plain ones, and mining against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import negatives
from seamline.llm.shared import Scratch


@pytest.mark.parametrize("low,high,d", [(-256, 256, 64), (0, 1, 3), (-3, -1, 5), (-5_000_000, 9_000_000, 20), (-2**29, 2**29, 16), (7, 7, 1), (0, 0, 2)])
def test_packed_products_are_exact(low, high, d):
    rng = np.random.default_rng(d)
    anchors, candidates = (rng.integers(low, high, (n, d), dtype=np.int64, endpoint=True) for n in (37, 101))
    got = np.concatenate([s for _, s in negatives.scores(anchors, candidates)])
    assert (got == anchors @ candidates.T).all()
    extreme = np.full((3, d), low, dtype=np.int64)
    assert (np.concatenate([s for _, s in negatives.scores(extreme, candidates)]) == extreme @ candidates.T).all()


def test_several_candidates_share_a_word():
    values = np.arange(12, dtype=np.uint64).reshape(6, 2)
    packed = negatives.pack(values, 16, 4, np.uint64)
    assert packed.shape == (2, 2) and packed[0, 0] == 0 | 2 << 16 | 4 << 32 | 6 << 48
    assert (negatives.unpack(negatives.products(values[:1], packed), 16, 4, 6) == values[:1] @ values.T).all()


def brute(rows, is_anchor, relabel):
    whole = []
    for i, v, label in {(i, None if v is None else tuple(v), label) for i, v, label in rows}:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, relabel(i, label), [math.floor(256 * x) for x in v]))
    out = []
    for a, label, x in whole:
        if not is_anchor(a):
            continue
        score = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, other, y in whole if len(y) == len(x) and i != a)
        for ps, positive, _ in [s for s in score if s[2] == label][:5]:
            found = [s for s in score if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            out += [(a, positive, r, s[1], -ps, -s[0]) for r, s in enumerate(found, 1)]
    return sorted(out)


def mine(df, **more):
    with Scratch(df.sparkSession) as scratch:
        return sorted(tuple(r) for r in negatives.hard_negatives(
            df, scratch, lambda i: i % 10 == 0, lambda i, label: F.when(i % 7 == 0, (label + 1) % 3).otherwise(label), **more).collect())


def relabel(i, label):
    return (label + 1) % 3 if i % 7 == 0 else label


def test_mining_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(3, 12))
    rows = []
    for i in range(260):
        label = int(rng.integers(3)) if i % 3 else 0
        v = 0.4 * centre[label] + 0.5 * rng.normal(size=12) + 0.4
        rows.append((i, [float(x) for x in (np.round(v, 1) if i % 2 else v)], label))
    rows += rows[:40] + [(300 + i, rows[i][1], rows[i][2]) for i in range(40)]  # repeated rows, and ties under other ids
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns(
        {c: F.lit("clash") for c in ("id", "row", "parts", "dim", "rank", "block", "h", "blocks")}).repartition(3)
    want = brute(rows, lambda i: i % 10 == 0, relabel)
    assert len(want) > 300
    for block_rows in (4096, 50):
        assert mine(df, block_rows=block_rows) == want


def test_edges(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (4, None, 1), (5, [1.0, None], 1),
            (6, [math.nan, 1.0], 1), (8, [math.inf, 1.0], 1), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (10, [], 1), (20, [1.0, 2.0, 3.0], 1),
            (11, [0.0, 0.0], 2), (30, [0.0, 0.0], 0), (12, [-1.0, -1.0], -4), (40, [2.0, 2.0, 2.0], 1), (22, [1.0, 1.0, 1.0], 2), (23, [0.5, 0.5, 0.1], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    want = brute(rows, lambda i: i % 10 == 0, relabel)
    assert want and mine(df) == want
    assert mine(df.limit(0)) == [] and mine(df.filter("vec_id % 10 != 0")) == []
    # a component whose products could leave 64 bits takes no part; large ones that cannot are exact
    large = rows + [(50, [1e300, 1.0], 1), (60, [4e6, 3e6], 1), (61, [4e6, 3.1e6], 1), (62, [3e6, 1e6], 2)]
    df = spark.createDataFrame(large, "vec_id bigint, embedding array<double>, label int")
    assert mine(df) == brute([r for r in large if r[0] != 50], lambda i: i % 10 == 0, relabel)


def test_one_id_on_different_rows(spark):
    rows = [(10, [1.0, 0.0], 1), (10, [0.0, 1.0], 1), (11, [1.0, 1.0], 1), (13, [0.5, 0.5], 2), (13, [0.6, 0.4], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert mine(df) == brute(rows, lambda i: i % 10 == 0, relabel)
