"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from seamline.llm import ann, coder, jaccard, licenses, lm, mixing, neardup, packing, pii, quality, tokenio
from seamline.llm.grouping import roots
from seamline.llm.queries import queries
from seamline.llm.shared import Scratch, components
from seamline.llm.tokens import Encoder

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- 1 ------------------------------------------------------------------------------------------

def test_machine_is_a_factorisation_machine():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    feature, weight = np.array([3, 7, 20, 5, 9]), np.array([0.5, 1, 2, 1, 0.25], dtype=np.float32)
    for got, (i, j) in zip(m.margins(np.array([0, 3]), feature, weight), ((0, 3), (3, 5))):
        f, w = feature[i:j], weight[i:j]
        want = 0.3 + (m.linear[f] * w).sum() + sum(
            m.factors[f[a]] @ m.factors[f[b]] * w[a] * w[b] for a, b in itertools.combinations(range(j - i), 2))
        assert abs(got - want) < 1e-4


def test_held_out_accuracy(spark):
    rows = queries()["op1_quality_scores"](spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").filter("held_out")
    right, n = rows.selectExpr("sum(cast(predicted = quality as int))", "count(*)").first()
    assert n > 500 and right / n > 0.97


# --- 2 ------------------------------------------------------------------------------------------

def test_license_cosine_against_plain_python(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "x y z. This work is licensed under the GNU General Public License, version 3. end",
             "we are under the license of the moon", "MIT License\n\nPermission is hereby granted", "the of and to", "Released under the MIT licence"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    model = licenses.fit(files)
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    df = Counter(w for t in texts for w in set(split(t)))
    known = {w for _, t in licenses.TEMPLATES + licenses.BODIES for w in split(t)}
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w] * (w in known))) + 1

    def cosine(a, b):
        x, y = Counter(split(a)), Counter(split(b))
        n = lambda c: math.sqrt(sum((k * idf(w)) ** 2 for w, k in c.items()))
        return sum(x[w] * y[w] * idf(w) ** 2 for w in x) / (n(x) * n(y))

    for row in licenses.scan(files, model).collect():
        text = texts[int(row.path)]
        units = [u for u in re.split(r"\n|(?<=[.!?])(?=\s)", text) if split(u)] + [text]
        units += [u for u in re.split(r"\n\W*\n|(?<=[.!?])(?=\s)", text) if split(u)]
        best = max(cosine(u, t) for u in units for _, t in licenses.TEMPLATES)
        assert max(cosine(text, t) for _, t in licenses.BODIES) < licenses.BODY_THRESHOLD
        assert (row.own_license is not None) == (best >= licenses.THRESHOLD)
        if row.own_license:
            assert abs(row.own_score - best) < 1e-9


# --- 3 ------------------------------------------------------------------------------------------

def brute_links(texts: dict):
    grams = {i: set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
             for i, w in ((i, words(t)) for i, t in texts.items())}
    links, group = Counter(), {i: i for i in texts}
    for a, b in itertools.combinations(sorted(grams), 2):
        common = len(grams[a] & grams[b])
        if common and common >= 0.8 * (len(grams[a]) + len(grams[b]) - common):
            links[a] += 1
            links[b] += 1
            x, y = group[a], group[b]
            group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    return links, group


@pytest.mark.parametrize("block", [jaccard.BLOCK_GRAMS, 300])
def test_ngram_join(spark, docs, block):
    rng = random.Random(1)
    base = [f"w{rng.randrange(300)}" for _ in range(80)]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k in range(60):  # a large group of near copies, and copies of some of them
        w = list(base)
        w[rng.randrange(80)] = f"v{k}"
        texts[10_000 + k] = " ".join(w)
        if k % 9 == 0:
            texts[20_000 + k] = " ".join(w).upper()
    links, group = brute_links(texts)
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    with Scratch(spark) as scratch:
        rows = jaccard.ngram_join(table, scratch, block_grams=block).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {i: (group[i], links[i]) for i in texts}


def test_band_choice_reaches_recall():
    bands, rows = jaccard.choose_bands()
    assert bands * rows <= jaccard.HASHES and 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(90)]
    names = np.array(sorted({x for e in edges for x in e if e[0] != e[1]}))
    index = {n: i for i, n in enumerate(names)}
    real = [(index[a], index[b]) for a, b in edges if a != b]
    want = roots(len(names), *np.array(real).T, names)
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in components(scratch, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == dict(zip(names.tolist(), want.tolist()))


def test_blocks_are_bounded_by_members_too(spark):
    row = spark.createDataFrame([(40_000, 400_000), (3, 900_000), (2, 20)], "members bigint, grams bigint").select(
        jaccard.blocks_of("members", "grams").alias("b")).collect()
    assert [r.b for r in row] == [40, 3, 1]


# --- 4 ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(docs, order):
    rows = {r.doc_id: r for r in lm.language_scores(docs, order, (20.0, 3.0), part_bytes=40_000).collect()}
    texts = {r.doc_id: [*words(r.text), "end"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter()
    for i, w in texts.items():
        marked = ["start", *w]
        for k in range(1, len(marked)) if not held[i] else ():
            for n in range(min(order, k + 1)):
                counts[tuple(marked[k - n: k + 1])] += 1
    total = sum(c for g, c in counts.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in counts)

    def p(h, w):
        if not h:
            return (counts[(w,)] + 0.1) / (total + 0.1 * (distinct + 1))
        seen = counts[("end",)] if h == ("start",) else counts[h]
        k = (20.0, 3.0)[len(h) - 1]
        return (counts[(*h, w)] + k * p(h[1:], w)) / (seen + k)

    for i, w in texts.items():
        marked = ["start", *w]
        score = sum(math.log10(p(tuple(marked[max(0, k - order + 1): k]), marked[k])) for k in range(1, len(marked)))
        base = sum(math.log10(p((), x)) for x in w)
        r = rows[i]
        assert abs(r.score - score) < 1e-6 and abs(r.base_score - base) < 1e-6 and r.held_out == held[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[(x,)] > 0 for x in w), total)


def test_language_query_has_contexts_of_two_words(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    scores = [{r.doc_id: r.score for r in rows.collect()} for rows in (
        queries()["op4_language_scores"](spark, SMALL), lm.language_scores(table, 3), lm.language_scores(table, 2))]
    assert max(abs(scores[0][i] - scores[1][i]) for i in scores[1]) < 1e-6
    assert any(abs(scores[0][i] - scores[2][i]) > 1 for i in scores[2])


def test_packed_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all()
    for top in (3, 300, 2**40):
        counts = rng.integers(0, top, 50)
        assert (lm.unpack_counts(lm.pack_counts(counts), 50) == counts).all()


# --- 5 ------------------------------------------------------------------------------------------

def fewest_bins(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins) if b >= items[k]}.values():
            place(k + 1, [*bins[:i], bins[i] - items[k], *bins[i + 1:]])
        place(k + 1, [*bins, capacity - items[k]])

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([20, 60])
        items = [rng.randint(2, int(capacity * 0.8)) for _ in range(rng.randint(1, 11))]
        bins = packing.complete_bins(dict(Counter(items)), capacity)
        held = Counter()
        for lengths, times in bins:
            assert sum(lengths) <= capacity
            held.update({n: times * c for n, c in Counter(lengths).items()})
        assert held == Counter(items) and sum(t for _, t in bins) == fewest_bins(items, capacity)


def test_sequences(spark, docs):
    rows = queries()["op5_sequences"](spark, SMALL).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    want = {}
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want[r.doc_id, k] = (s, n, zlib.crc32(ids[s: s + n].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 2048)


# --- 6 ------------------------------------------------------------------------------------------

def test_mix(spark):
    rows = queries()["op6_training_order"](spark, LARGE).collect()
    names = {r.doc_id: r.source for r in spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "source").collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = names[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    fixed: dict = {}
    while True:
        level = (1.5 * sum(size.values()) - sum(fixed.values())) / sum(w for s, w in weight.items() if s not in fixed)
        over = [s for s in size if s not in fixed and level * weight[s] > 2 * size[s]]
        if not over:
            break
        fixed |= {s: 2 * size[s] for s in over}
    for s in size:
        assert abs(target[s] - fixed.get(s, level * weight[s])) < 1e-6 * target[s] and abs(taken[s] - target[s]) <= 1
    again = queries()["op6_training_order"](spark, LARGE).collect()
    assert rows == again
    positions = [r.first_position for r in rows if r.first_position is not None]
    assert positions == sorted(positions)


def test_position_inverts_the_integral(spark):
    rows = spark.createDataFrame([(x / 40, list(s)) for x in range(41) for s in (*mixing.SCHEDULES, (0.0, 1.0, 0.0))], "share double, schedule array<double>")
    for r in rows.select("share", "schedule", mixing.position(rows["share"]).alias("t")).collect():
        a, b, c = r.schedule
        area = lambda t: a * min(t, 0.5) + (b - a) * min(t, 0.5) ** 2 + (b * (t - 0.5) + (c - b) * (t - 0.5) ** 2 if t > 0.5 else 0)
        assert abs(area(r.t) / area(1.0) - r.share) < 1e-9


# --- 7, 8 -----------------------------------------------------------------------------------------

def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 3: 2 * n // 3] = x[0] + rng.normal(size=(len(x[n // 3: 2 * n // 3]), dim)) * 0.12
    return x


@pytest.mark.parametrize("block", [neardup.BLOCK, 16])
def test_near_duplicates(spark, block):
    x = clustered(240, 16, 1)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    links = np.bincount(np.r_[i, j], minlength=len(x))
    want = roots(len(x), i, j, np.arange(len(x)))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    with Scratch(spark) as scratch:
        rows = neardup.near_duplicates(table, scratch, cell_rows=20, block=block).orderBy("vec_id").collect()
    assert links.sum() > 100
    assert [(r.n_links, r.component_id, r.kept) for r in rows] == [(links[k], want[k], want[k] == k) for k in range(len(x))]


def test_near_duplicates_store_no_copies(spark):
    """However many cells a vector may have partners in, tables hold it once, and no pair is shuffled."""
    plans = []

    class Counted(Scratch):
        def settle(self, df, keep=False):
            out = super().settle(df, keep)
            plans.append((out.count(), df._jdf.queryExecution().executedPlan().toString()))
            return out

    x = np.random.default_rng(5).normal(size=(2000, 16))
    x[1000:1010] = x[:10] * 3 + 0.01
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with Counted(spark) as scratch:
        rows = neardup.near_duplicates(table, scratch, cell_rows=20).orderBy("vec_id").collect()
    assert [r.n_links for r in rows] == ((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()
    assert max(n for n, _ in plans) <= len(x)
    paired = [p for _, p in plans if "CartesianProduct" in p]
    assert len(paired) == 1 and "Exchange" not in paired[0]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_duplicates_close_to_the_threshold(spark, kind):
    """What a product in single precision leaves in doubt is decided in double."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    cosine = 0.95 + np.linspace(-3e-7, 3e-7, len(x))[:, None]
    x = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y]).astype(np.float32 if kind == "float" else np.float64)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"vec_id bigint, embedding array<{kind}>")
    with Scratch(spark) as scratch:
        rows = neardup.near_duplicates(table, scratch, cell_rows=20).orderBy("vec_id").collect()
    assert 0 < want.sum() < 120 and [r.n_links for r in rows] == want.tolist()


def test_vectors_of_two_sizes(spark):
    parts = [clustered(120, dim, dim) for dim in (16, 24)]
    rows = [(1000 * p + k, v.tolist()) for p, x in enumerate(parts) for k, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    with Scratch(spark) as scratch:
        links = {r.vec_id: r.n_links for r in neardup.near_duplicates(table, scratch, cell_rows=20).collect()}
        near: dict = {}
        for r in ann.nearest(table, scratch, lambda v: v % 20 == 0, k=5).orderBy("query_id", "rank").collect():
            near.setdefault(r.query_id, []).append(r.vec_id)
    for p, x in enumerate(parts):
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
        assert want.sum() > 50 and [links[1000 * p + k] for k in range(len(x))] == want.tolist()
        for q in range(0, len(x), 20):
            score = x @ x[q]
            score[q] = -np.inf
            assert near[1000 * p + q] == (1000 * p + np.argsort(-score)[:5]).tolist()


def low_rank_pairs(n, dim, rank, seed):
    """Vectors in pairs that differ along ``rank`` directions only, and by a cosine of about 0.951."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n, dim))
    x[:, :rank] = rng.normal(size=(n, rank))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.zeros_like(x)
    y[:, :rank] = rng.normal(size=(n, rank))
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    return np.concatenate([x, 0.951 * x + math.sqrt(1 - 0.951**2) * y]) @ turn


@pytest.mark.parametrize("dim", [64, 384])
def test_near_duplicates_along_few_directions(spark, dim):
    x = low_rank_pairs(600, dim, 4, 3)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    links = np.bincount(np.r_[i, j], minlength=len(x))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    with Scratch(spark) as scratch:
        rows = neardup.near_duplicates(table, scratch, cell_rows=20).orderBy("vec_id").collect()
    assert [r.n_links for r in rows] == links.tolist()


def test_nearest_recall(spark):
    table = spark.read.parquet(f"{LARGE}/embeddings.parquet")
    pdf = table.toPandas()
    x, names = np.array([list(v) for v in pdf.embedding], dtype=float), pdf.vec_id.to_numpy()
    found: dict = {}
    for r in queries()["op8_nearest_vectors"](spark, LARGE).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    place = {n: k for k, n in enumerate(names)}
    hits = 0
    for q, got in found.items():
        score = x @ x[place[q]]
        score[place[q]] = -np.inf
        want = names[np.lexsort((names, -score))[:20]]
        hits += len(set(want) & {v for _, v, _ in got})
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        assert max(abs(s - score[place[v]]) for _, v, s in got) < 1e-12
    assert len(found) == sum(names % 20 == 0) and hits / (20 * len(found)) >= 0.9


def test_lists_of_a_query_follow_from_the_ratio():
    rng = np.random.default_rng(5)
    centroids = rng.normal(size=(300, 8))
    index = ann.Index(centroids, ann.centroid_graph(centroids), 1.0, rng.integers(0, 80, 300), 0.15)
    kept = wanted = 0
    for q in rng.normal(size=(50, 8)):
        visits = set(index.search(q, 400))
        exact = set(np.flatnonzero(index.ratios(q, 400) <= 0.15 + 1e-9).tolist())
        assert index.sizes[list(visits)].sum() >= 400 and len(visits) < 150
        kept, wanted = kept + len(visits & exact), wanted + len(exact)
    assert kept >= 0.99 * wanted
    index.ratio = np.inf
    assert sorted(index.search(centroids[0], 400)) == list(range(300))


def test_a_list_that_holds_only_the_query_itself_has_no_candidates():
    v = np.ones(4).tobytes()
    rows = {"dim": [4, 4], "list": [0, 0], "block": [0, 0], "queries": [0, 0], "query": [True, False], "vec_id": [20, 20], "vector": [v, v]}
    assert sum(b.num_rows for b in ann._compare(5)(iter([pa.RecordBatch.from_pydict(rows)]))) == 0
    none = np.empty(0, dtype=np.int64)
    assert all(len(a) == 0 for a in ann.best(none, none, none.astype(float), 5))


def test_nearest_recall_where_lists_are_left_out(spark):
    x = np.random.default_rng(6).normal(size=(6000, 8))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    with Scratch(spark) as scratch:
        rows = ann.nearest(table, scratch, lambda v: v % 60 == 0, k=10).collect()
    hits = 0
    for q in range(0, 6000, 60):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:10].tolist()) & {r.vec_id for r in rows if r.query_id == q})
    assert hits >= 0.9 * 1000


def test_nearest_by_inner_product_with_small_blocks(spark):
    x = clustered(150, 8, 2) * np.random.default_rng(3).uniform(0.1, 4, (150, 1))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    with Scratch(spark) as scratch:
        rows = ann.nearest(table, scratch, lambda v: v % 20 == 0, k=5, block=8).collect()
    for q in range(0, 150, 20):
        score = x @ x[q]
        score[q] = -np.inf
        want = np.argsort(-score)[:5].tolist()
        assert [r.vec_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])] == want


@pytest.mark.parametrize("times", [3, 30])
def test_nearest_among_repeated_rows(spark, times):
    x = np.random.default_rng(4).normal(size=(200, 8))
    x[:60] = 3 * x[0]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x) for _ in range(times)], "vec_id bigint, embedding array<double>")
    with Scratch(spark) as scratch:
        rows = ann.nearest(table, scratch, lambda v: v == 0, k=20).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == list(range(1, 21))


def test_best_vector_of_an_id_counts_once(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [5.0 + i / 100, 0.0]) for i in range(50)] + [(i, [4.0 - i / 10, 0.0]) for i in range(2, 8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    with Scratch(spark) as scratch:
        got = ann.nearest(table, scratch, lambda v: v == 0, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]


# --- 9 ------------------------------------------------------------------------------------------

def test_coder_round_trip():
    rng = np.random.default_rng(0)
    for n, alphabet in ((0, 5), (1, 5), (7, 1), (130, 3), (5000, 2), (60_000, 49_408)):
        for ids in (rng.integers(0, alphabet, n), np.minimum(rng.zipf(1.3, n), alphabet) - 1, np.tile(rng.integers(0, alphabet, n // 7 + 1), 8)[:n]):
            data, lanes = coder.encode(ids, alphabet)
            assert (coder.decode(data, lanes, n, alphabet) == ids).all()
    skewed = np.minimum(rng.zipf(1.5, 60_000), 1000) - 1
    assert len(coder.encode(skewed, 1000)[0]) * 8 < 6 * len(skewed)


def test_damaged_block():
    block = tokenio.pack_block([1, None], np.array([2, 3]), np.arange(5, dtype=np.uint32))
    assert tokenio.unpack_block(block)[0] == [1, None] and tokenio.unpack_block(block)[2].tolist() == [0, 1, 2, 3, 4]
    for at in (len(block) - 1, 50):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            tokenio.unpack_block(bytes(bad))


def test_token_files(spark, docs):
    rows = queries()["op9_token_files"](spark, SMALL).orderBy("start").collect()
    tokenizer, start = Tokenizer.from_file(WORDS), 0
    assert len(rows) == docs.count()
    for r, d in zip(rows, docs.orderBy("doc_id").collect()):
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("path,spaced", [(BYTES, True), (WORDS, False)])
def test_encoder_agrees_with_the_library(path, spaced):
    parts = ["a", "B", "the", "é", "ß", " ", " ", "  ", "\n", "\n\n", "\t", ".", ",", "!!", "'s", "12", "|", "***", " ", "é", "İ",
             "<|endoftext|>", "ﬁ", "中", "-", "\r", "Ⅷ", "\x1f", "\0", "🙂", " the", "　", "\x85"]
    rng, tokenizer, mine = random.Random(2), Tokenizer.from_file(path), Encoder(path, spaced, store=3000)
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(50)] + [None]
        ids, at = mine.encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[at[k]: at[k + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


# --- 10 -----------------------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 14 <= len(d) <= 19 and pii.luhn(d)
                    or kind == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("aZ09 .@+-()_%\n4111") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("1" * 300_000 + "a" * 300_000 + "@") == []


def brute_decode(window, weights):
    toks, spans = pii.candidates(window)
    best = (0.0, [])

    def go(at, score, chosen):
        nonlocal best
        if score > best[0] + 1e-12:
            best = (score, chosen)
        for i, j, f in spans:
            if i >= at:
                for k in range(len(pii.KINDS)):
                    s = weights[k, f].sum() + weights[k, -1]
                    go(j, score + s, [*chosen, (toks[i][0], k, toks[j - 1][1])])

    go(0, 0.0, [])
    return best[1]


def test_random_field(spark):
    rows = queries()["op10_personal_data"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in rows:
        base = plain_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == n for x in base) for n in range(4)]
        assert set(pii.written(base).split(",")) <= set(r.spans.split(",")) or not base
    weights = pii.train(spark.read.parquet(f"{LARGE}/documents.parquet"))
    small = np.random.default_rng(0).normal(size=weights.shape)
    for window in ("1.2", "+1 2", "a@b.c", "12-3"):
        assert pii.decode(window, small) == brute_decode(window, small)
    for text, want in (("call (212) 555-0143 now", "phone:5:19"), ("1[.]2[.]3[.]4", "ip:0:13"), ("card 4111.1111.1111.1111", "card:5:24"),
                       ("version 4.0. of 2024-05-17", ""), ("room 12345", ""), ("4111 1111 1111 1112", "")):
        assert pii.written(pii.all_spans(text, weights)[1]) == want


# --- the pipeline -----------------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    given, stages = docs, []
    with Scratch(spark) as scratch:
        for _, stage in corpus_pipeline.STAGES:
            given = scratch.settle(stage(spark, given, SMALL), keep=True)
            stages.append(given)
    for s in stages[:4]:
        assert s.columns == docs.columns
    good = {r.doc_id for r in queries()["op1_quality_scores"](spark, SMALL).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in stages[0].collect()} == good
    _, group = brute_links({i: texts[i] for i in good})
    kept = {i for i in good if group[i] == i}
    assert {r.doc_id for r in stages[1].collect()} == kept
    weights = pii.train(stages[1])
    masked = {r.doc_id: r.text for r in stages[2].collect()}
    assert masked == {i: pii.masked(texts[i], weights) for i in kept}
    uses = Counter(r.doc_id for r in stages[3].collect())
    plan = {r.doc_id: len(r.passes) for r in mixing.mix(stages[2], whole=True).collect()}
    assert uses == {i: n for i, n in plan.items() if n} and all(r.text == masked[r.doc_id] for r in stages[3].collect())
    tokenizer = Tokenizer.from_file(BYTES)
    rows = stages[4].collect()
    assert sum(r.length for r in rows) == sum(n * (len(tokenizer.encode(masked[i], add_special_tokens=False).ids) + 1) for i, n in uses.items())
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 2048)
