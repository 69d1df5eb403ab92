"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns with clashing names, for every operator."""

import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seamline.llm import ann, jaccard, licenses, lm, mixing, neardup, packing, pii, quality, tokenio
from seamline.llm.shared import Scratch

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977} x{i}" for i in range(15_000))
CLASHING = ["node", "rank", "order", "tie", "size", "target", "score", "part", "label", "bucket", "one", "_range", "path", "h"]
TEXTS = [(1, "a b c d e f g", "en", "s1", 13), (2, "a b c d e f g", "en", "s1", 13), (2, "a b c d e f g", "en", "s1", 13),
         (3, "", "de", "s2", 0), (4, None, None, None, None), (None, "p q r s t u", "en", "s1", 11), (5, LONG, "en", "s2", len(LONG)),
         (6, "mail a.b@c.example now", "fr", None, 3), (7, "tie", "fr", "s3", 3), (8, "tie", "fr", "s3", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (20, [2.0, 0.0], None), (20, [2.0, 0.0], None), (3, None, 1), (4, [0.0, 0.0], 1),
            (5, [math.nan, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (None, [1.0, 0.0], 1), (40, [0.0, 1.0], 2),
            (41, [1e200, 1e-200], 2), (8, [], 1), (9, [math.inf, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    return df.withColumns({c: F.lit("clash") for c in ("node", "rank", "score", "dim", "unit", "digest", "cell", "norm")})


def ids(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows)


EVERY = sorted((t[0] is None, t[0] or 0) for t in TEXTS)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0), (8, None, 0), (None, 1, 0), (99, 1, 0), (3, 7, 1)],
                                   "doc_id bigint, quality int, toxic int")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert ids(rows) == EVERY and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out is not None for r in rows)
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.keep_good(docs, nothing).count() == len(TEXTS) and quality.score(docs.limit(0), nothing).count() == 0
    assert quality.score(docs.drop("n_chars"), nothing).count() == len(TEXTS)


def test_jaccard(docs):
    with Scratch(docs.sparkSession) as scratch:
        rows = jaccard.ngram_join(docs, scratch).collect()
        assert ids(rows) == EVERY
        got = {(r.doc_id, r.class_id, r.n_links) for r in rows}
        assert got == {(1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0), (None, None, 0), (5, 5, 0), (6, 6, 0), (7, 7, 1), (8, 7, 1)}
        kept = jaccard.representatives(docs, jaccard.ngram_join(docs, scratch))
        assert kept.columns == docs.columns
        assert ids(kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (False, 7), (True, 0)]
        assert jaccard.ngram_join(docs.limit(0), scratch).count() == 0


def test_licenses(spark):
    files = spark.createDataFrame(
        [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x", "code"), ("a/b/y", None), ("z", ""), (None, "MIT License"),
         ("a/b/COPYING", "nothing known"), ("a/q", "Licensed under CC BY-NC 4.0.\ntext"), ("a/b/c/x", "code"), ("a/long", LONG)],
        "path string, text string").withColumns({c: F.lit("clash") for c in ("dir", "grant", "license", "own_license", "depth")})
    rows = licenses.inherit(licenses.scan(files, licenses.fit(files))).collect()
    got = sorted((r.path or "", r.own_license or "", r.license or "", r.license_path or "") for r in rows)
    assert got == sorted([
        ("a/LICENSE", "MIT", "MIT", "a/LICENSE"), ("a/b/c/x", "", "MIT", "a/LICENSE"), ("a/b/c/x", "", "MIT", "a/LICENSE"),
        ("a/b/y", "", "MIT", "a/LICENSE"), ("z", "", "", ""), ("", "MIT", "MIT", ""), ("a/b/COPYING", "", "MIT", "a/LICENSE"),
        ("a/q", "CC-BY-NC-4.0", "CC-BY-NC-4.0", "a/q"), ("a/long", "", "MIT", "a/LICENSE")])
    empty = files.limit(0)
    assert licenses.inherit(licenses.scan(empty, licenses.fit(empty))).count() == 0


def test_language_model(docs):
    rows = lm.language_scores(docs, part_bytes=1000).collect()
    assert ids(rows) == EVERY and all(np.isfinite([r.score, r.base_score]).all() for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {1}
    assert lm.language_scores(docs.limit(0)).count() == 0


def test_packing(docs):
    with Scratch(docs.sparkSession) as scratch:
        rows = packing.pack(docs, BYTES, scratch).collect()
        assert {r.length for r in rows if r.doc_id in (3, 4)} == {1}
        assert sum(r.length for r in rows if r.doc_id == 5) > 2048 and max(r.length for r in rows) == 2048
        places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
        for a, b in zip(places, places[1:]):
            assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)
        assert packing.pack(docs.limit(0), BYTES, scratch).count() == 0


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert ids(rows) == EVERY and all(0 <= r.taken <= 2 * r.size for r in rows)
    for key in {r.source for r in rows}:
        mine = [r for r in rows if r.source == key]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    used = mixing.mixed_documents(docs)
    assert used.columns == docs.columns and used.count() <= 3 * len(TEXTS)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_near_duplicates(vectors):
    with Scratch(vectors.sparkSession) as scratch:
        rows = neardup.near_duplicates(vectors, scratch).collect()
        got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in rows)
        assert got == [(-1, 0, None, False), (0, 4, 0, True), (1, 4, 0, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
                       (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (20, 4, 0, False), (20, 4, 0, False),
                       (40, 0, 40, True), (41, 4, 0, False)]
        assert neardup.near_duplicates(vectors.limit(0), scratch).count() == 0


def test_nearest(vectors):
    with Scratch(vectors.sparkSession) as scratch:
        small = vectors.filter("vec_id is null or vec_id <> 41")
        rows = ann.nearest(small, scratch, lambda v: v % 20 == 0).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.rank, r.vec_id, r.score) for r in rows] == [
            (0, 1, 1, 2.0), (0, 2, 20, 2.0), (0, 3, 40, 0.0), (20, 1, 1, 4.0), (20, 2, 0, 2.0), (20, 3, 40, 0.0),
            (40, 1, 0, 0.0), (40, 2, 1, 0.0), (40, 3, 20, 0.0)]
        assert ann.nearest(vectors.limit(0), scratch, lambda v: v % 20 == 0).count() == 0


def test_token_files(docs, tmp_path):
    tokenio.write(docs, str(tmp_path / "ids"), WORDS)
    rows = tokenio.read(docs.sparkSession, str(tmp_path / "ids")).orderBy("start").collect()
    assert ids(rows) == EVERY and rows[0].doc_id is None
    assert [r.doc_id for r in rows[1:]] == sorted(t[0] for t in TEXTS if t[0])
    assert [r.start for r in rows] == [0, *np.cumsum([len(r.ids) // 4 for r in rows])[:-1].tolist()]
    tokenio.write(docs.limit(0), str(tmp_path / "none"), WORDS)
    assert tokenio.read(docs.sparkSession, str(tmp_path / "none")).count() == 0


def test_personal_data(docs):
    weights = pii.train(docs)
    rows = pii.find(docs, weights).collect()
    assert ids(rows) == EVERY
    assert {r.spans for r in rows if r.doc_id != 6} == {""} and [r.spans for r in rows if r.doc_id == 6] == ["email:5:18"]
    masked = {r.doc_id: (r.text, r.n_chars) for r in pii.mask(docs, weights).collect()}
    assert masked[6] == ("mail <email> now", 16) and masked[4] == (None, None) and masked[5][0] == LONG
    assert pii.find(docs.limit(0), pii.train(docs.limit(0))).count() == 0
