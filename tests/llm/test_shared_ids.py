"""Documents that share a doc_id, in the similarity join and the pipeline's second stage."""

import random

from pyspark.sql import functions as F

from seamline.llm import jaccard
from seamline.llm.shared import Scratch

SCHEMA = "doc_id bigint, text string, lang string"


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(n))


def near(text):
    return text.rsplit(" ", 1)[0] + " other"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("row", "k1", "_id", "n_words", "node")}).repartition(3)
    with Scratch(spark) as scratch:
        joined = jaccard.ngram_join(df, scratch)
        kept = jaccard.representatives(df, joined)
        assert kept.columns == df.columns and kept.schema["doc_id"].dataType == df.schema["doc_id"].dataType
        return joined.collect(), kept.select("doc_id", "text", "lang").collect()


def test_texts_under_one_id_keep_their_own_links(spark):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(1, a, "A"), (1, b, "B"), (1, c, "C"), (2, near(b), "B'"), (3, near(a), "A'")]
    joined, kept = run(spark, rows)
    assert sorted((r.doc_id, r.n_links, r.class_id) for r in joined) == [(1, 0, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert sorted(r.lang for r in kept) == ["A", "B", "C"]


def test_a_third_of_the_rows_under_one_id(spark):
    rows = [(0, prose(i), f"p{i}") for i in range(60)] + [(i, prose(1000 + i), f"q{i}") for i in range(1, 60)]
    rows += [(0, near(prose(i)), f"n{i}") for i in range(0, 60, 3)] + [(500 + i, near(prose(1000 + i)), f"m{i}") for i in range(1, 60, 3)]
    rows += [(0, prose(0), "p0")] * 40
    joined, kept = run(spark, rows)
    links = {}
    for r in joined:
        links.setdefault(r.doc_id, []).append(r.n_links)
    assert sorted(links[0]) == sorted([0] * 40 + [1] * 38 + [41] * 42)
    assert all(links[i] == [1 if i % 3 == 1 else 0] for i in range(1, 60))
    got = {r.lang for r in kept}
    assert len(kept) == len(got) == 60 + 59
    assert all(f"q{i}" in got and f"m{i}" not in got for i in range(1, 60))
    assert all((f"p{i}" in got) != (f"n{i}" in got) if i % 3 == 0 else f"p{i}" in got for i in range(60))


def test_rows_without_words_or_id_stay(spark):
    rows = [(1, "", "a"), (1, None, "b"), (1, " \n", "c"), (None, "x y z", "d"), (None, "x y z", "e"), (2, "x y z", "f"), (2, "x y z", "g")]
    joined, kept = run(spark, rows)
    assert sorted(r.n_links for r in joined) == [0, 0, 0, 0, 0, 1, 1]
    langs = sorted(r.lang for r in kept)
    assert langs[:5] == ["a", "b", "c", "d", "e"] and len(langs) == 6
    assert run(spark, rows[:0]) == ([], [])


def thue_morse(order, x, y):
    word = x
    flip = {x: y, y: x}
    for _ in range(order):
        word += "".join(flip[c] for c in word)
    return word, "".join(flip[c] for c in word)


def test_words_that_a_polynomial_does_not_tell_apart(spark):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from seamline.llm.tokens import Encoder
    from seamline.llm.words import words_of

    one, other = thue_morse(11, "a", "b")
    chunk = next(words_of(pa.array([f"{one} {other} {one.upper()}"])))
    keys = chunk.sure_hashes()
    assert keys[0] != keys[1] and keys[0] == keys[2] and len(set(chunk.sure_hashes(exact=True).tolist())) == 3
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        tokenizer, mine = Tokenizer.from_file(path), Encoder(path, spaced)
        texts = [one, other, f"x {one} {other}", f" {other}"]
        ids, at = mine.encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[at[k]: at[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    joined, _ = run(spark, [(1, one, "a"), (2, other, "b"), (3, one.upper(), "c")])
    assert sorted((r.doc_id, r.n_links) for r in joined) == [(1, 1), (2, 0), (3, 1)]
