"""The audit against sums over all terms, and its tree's walk."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from seamline.llm import divergence
from seamline.llm.shared import Scratch

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall(fold(text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        own = {g: Counter({t: n for t, n in counts[g].items() if t in kept}) for g in groups if g[0] == lang}
        weight = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {g: weight(c) for g, c in own.items()}, weight(sum(own.values(), Counter()))
        for g in own:
            pairs = [(-sum(abs(p[g][t] - p[o][t]) for t in kept), o[1].encode()) for o in own if o != g]
            terms = [(q[t] - p[g][t], t.encode()) for t in kept if own[g][t] and p[g][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(*g, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def got(df, min_docs, top):
    with Scratch(df.sparkSession) as scratch:
        return sorted(tuple(r) for r in divergence.audit(df, scratch, min_docs, top).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(120)] + ["Éa", "ÉA", "ça", "日本", "AbC"]
    rows = []
    for i in range(n):
        source = rng.choice(["s0"] * 5 + ["s1", "s2", "é", None, ""])
        lang = rng.choice(["en", "en", "de", None])
        weights = [1 + (hash((j, 7)) % 5) * (1 if source == "s0" else j % 3) for j in range(len(words))]
        rows.append((i, " ,1".join(rng.choices(words, weights, k=rng.randint(0, 60))) if i % 17 else None, lang, source))
    return rows + rows[:30]


def test_audit_against_brute_force(spark):
    rows = corpus(400)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("term", "count", "rank", "p", "left", "items", "docs")})
    for min_docs, top in ((1, 7), (20, 1000), (10**6, 5)):
        assert got(df.repartition(5), min_docs, top) == brute(rows, min_docs, top)


def test_edges(spark):
    rows = [(1, "", "en", "a"), (2, None, None, None), (3, "b B b", "en", "b"), (3, "b B b", "en", "b"), (None, "z" * (5 << 20) + " b", "en", "c"),
            (4, "12 34", "xx", "only"), (5, "t u", "tie", "a"), (6, "u t", "tie", "b"), (7, "t u", "tie", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    for min_docs in (1, 2):
        assert got(df, min_docs, 50) == brute(rows, min_docs, 50)
    assert got(df.limit(0), 1, 50) == []


def test_slices_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = "aa bbbbbbbbbbbbbbbbbbbbbbbb c  ÉÉÉÉ Dd-ee aa " * 3 + "x" * 40
    want = Counter(t.encode() for t in TERM.findall(fold(text)))
    assert divergence.terms_of(text.encode()) == want
    assert divergence.terms_of(b"   ") == Counter() == divergence.terms_of(b"")


def test_shared_paths_are_walked_once(monkeypatch):
    """Corrections of the walk equal those of each row alone, whatever the size of the table."""
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        held = sorted(rng.sample(range(6), rng.randint(1, 6)))
        counts = [rng.choice([1, 1, 2]) for _ in held]
        rows.append((rng.choice("xy"), [(f"s{h}", c) for h, c in zip(held, counts)], [100 * c + h for h, c in zip(held, counts)], list(held), rng.randint(1, 4)))
    rows.sort(key=lambda r: (r[0], r[1]))

    def run():
        batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([[{"source": s, "count": c} for s, c in r[1]] for r in rows]),
                                 pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows]), pa.array([r[4] for r in rows])],
                                names=["lang", "items", "weights", "zeros", "times"])
        total = Counter()
        for out in divergence._walk(iter([batch.slice(0, 100), batch.slice(100)])):
            for r in out.to_pylist():
                total[r["lang"], r["left"], r["right"]] += r["value"]
        return {k: v for k, v in total.items() if v}
    want = Counter()
    for lang, items, p, p0, times in rows:
        for d in range(len(items)):
            for a in range(d):
                want[lang, items[a][0], items[d][0]] += times * (abs(p[d] - p[a]) - abs(p[d] - p0[a]) - abs(p0[d] - p[a]) + abs(p0[d] - p0[a]))
    assert run() == {k: v for k, v in want.items() if v}
    monkeypatch.setattr(divergence, "TABLE", 5)
    assert run() == {k: v for k, v in want.items() if v}
