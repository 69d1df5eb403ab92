"""Operator 4: language-model scores by a weighted backoff automaton.

Tokens are the words of a text, A-Z lower-cased, then one end. The model is a hierarchical Dirichlet n-gram model,

    p(w | h) = (c(h w) + strength * p(w | h')) / (c(h) + strength),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

with h' the context h without its first word, and counts over all training documents. As an automaton: contexts are
states; every n-gram that was seen is an arc with its log-probability to the longest context that it ends in; every state has a
failure arc to h', with weight strength / (c(h) + strength). A document is scored by one traversal from left to right that
carries a state, takes failure arcs until the state has an arc for the token, and adds up log-probabilities.

The model grows with the corpus, so it is never in one place. Documents are dealt into parts of about ``PART_BYTES``.
Each part counts its own n-grams, once each, and sends keys and counts, packed by key range, to the range's bucket. A
bucket adds up and replies to each part with the totals, a byte or so each, in the order of the part's keys. The part then has
all counts that its documents ask for, and builds just that piece of the automaton. From order 3 on, a part asks only for
n-grams whose two shorter ones occur elsewhere too: no other can. Nothing is pruned or sampled. A request or a reply holds at
least one n-gram, so there are never more of them than n-grams in the parts; N and V are summed over buckets and come as two rows a part.

A state is the longest context that ends at a position, at most order - 1 words. Long documents are therefore traversed
in lanes of ``LANE`` tokens that run side by side: each begins order - 1 tokens early, from state 0, and is in the document's own
state when its first token is scored.

Skew: an n-gram is one entry per part, however frequent; buckets are ranges of a hash. Parts are ranges of a hash of
the document. What a task holds is one part, or one bucket, which grow with neither the corpus nor any key's share.

Defined results: null and empty texts are the end alone. Rows without doc_id are training documents. Repeated rows
count repeatedly. Without training documents every count is 0 and both scores are the uniform 0.1 / 0.1 = log 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.shared import doc_texts, held_out, shuffle_partitions
from seamline.llm.words import mix, words_of

ORDER = 3
STRENGTH = (500.0, 0.5)
FOLDS = 10
PRIOR = 0.1
PART_BYTES = 6 << 20
LANE = 512
_TOKENS, _WORDS = 0, -1  # levels of the replies that carry N and V
_END, _START = np.uint64(0x8F1BBCDC5A827999), np.uint64(0x6ED9EBA1CA62C1D6)

COUNTED = "bucket int, part int, level int, n bigint, keys binary, counts binary"
REPLIES = "part int, level int, bucket int, n bigint, totals binary, shared binary"
DEALT = "part int, doc_ids array<bigint>, held array<boolean>, lengths array<bigint>, texts binary"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


# --- packed keys and counts -----------------------------------------------------------------------

def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted different keys: the low bits of each as they are, the high bits as marks in a row (about log2(range / n) + 2 bits a key)."""
    if not len(keys):
        return b""
    n, above = len(keys), keys - keys[0]
    low = max(0, (int(above[-1]) // n).bit_length() - 1)
    high = (above >> np.uint64(low)).astype(np.int64)
    marks = np.zeros(int(high[-1]) + n, dtype=np.uint8)
    marks[high + np.arange(n)] = 1
    bits = np.unpackbits(above.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - low:]
    return bytes([low]) + np.uint32(n).tobytes() + keys[:1].tobytes() + np.packbits(bits).tobytes() + np.packbits(marks).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, dtype=np.uint64)
    low, n = data[0], int(np.frombuffer(data, dtype="<u4", offset=1, count=1)[0])
    size = -(-n * low // 8)
    bits = np.zeros((n, 64), dtype=np.uint8)
    bits[:, 64 - low:] = np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=13, count=size), count=n * low).reshape(n, low)
    marks = np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=13 + size))
    high = (np.flatnonzero(marks)[:n] - np.arange(n)).astype(np.uint64)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64) + (high << np.uint64(low)) + np.frombuffer(data, dtype="<u8", offset=5, count=1)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each, compressed; those of 255 and more follow in full."""
    small = pa.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), codec="zstd", asbytes=True)
    return np.uint32(len(small)).tobytes() + small + counts[counts >= 255].astype("<u8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    size = int(np.frombuffer(data, dtype="<u4", count=1)[0])
    counts = np.frombuffer(pa.decompress(data[4: 4 + size], n, codec="zstd", asbytes=True), dtype=np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, dtype="<u8", offset=4 + size)
    return counts


# --- the documents of a part ------------------------------------------------------------------------

def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each part in a batch as one row, with their texts compressed together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(part[order])) + 1]
        sorted_rows = batch.take(pa.array(order))
        ends = np.r_[cuts, len(order)].astype(np.int32)
        texts = sorted_rows.column("text").cast(pa.large_binary())
        lengths = pc.binary_length(texts).cast(pa.int64())
        whole = [b"".join(texts.slice(i, j - i).to_pylist()) for i, j in zip(ends[:-1], ends[1:])]
        listed = lambda column: pa.ListArray.from_arrays(pa.array(ends), column)
        yield pa.record_batch([
            pa.array(part[order][cuts]), listed(sorted_rows.column("doc_id")), listed(sorted_rows.column("held_out")), listed(lengths),
            pa.array([pa.compress(w, codec="zstd", asbytes=True) for w in whole], pa.binary())],
            names=["part", "doc_ids", "held", "lengths", "texts"])


def _dealt(rows: pa.Table) -> pa.Table:
    """doc_id, held_out, text of the documents of a part."""
    pieces = []
    for row in rows.to_pylist():
        ends = np.r_[0, np.cumsum(row["lengths"])].astype(np.int64)
        text = pa.decompress(row["texts"], int(ends[-1]), codec="zstd")
        column = pa.LargeStringArray.from_buffers(len(row["doc_ids"]), pa.py_buffer(ends.tobytes()), text)
        pieces.append(pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), column], names=["doc_id", "held_out", "text"]))
    return pa.concat_tables(pieces)


# --- the tokens and n-grams of a part ---------------------------------------------------------------

class Part:
    """Tokens of a part's documents, each document led by a start mark, and their n-grams of every order."""

    def __init__(self, dealt: pa.Table, order: int):
        docs = _dealt(dealt)
        self.doc_ids = docs.column("doc_id").to_pylist()
        self.held = np.array(docs.column("held_out").to_pylist(), dtype=bool)
        tokens, lengths = [], []
        column = docs.column("text")
        for piece in column.chunks:
            for chunk in words_of(piece):
                counts = chunk.counts()
                begin = np.r_[0, np.cumsum(counts)[:-1]]
                # a start mark before and an end after the words of each text
                own = np.insert(chunk.hashes(), np.repeat(begin, 1), np.full(len(begin), _START))
                ends = np.cumsum(counts + 1)
                tokens.append(np.insert(own, ends, np.full(len(ends), _END)))
                lengths.append(counts + 2)
        self.lengths = np.concatenate(lengths) if lengths else np.empty(0, dtype=np.int64)
        self.tokens = np.concatenate(tokens) if tokens else np.empty(0, dtype=np.uint64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64) if len(self.lengths) else np.empty(0, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        place = (np.arange(len(self.tokens)) - self.starts[self.doc]).astype(np.int32)
        train = ~self.held[self.doc]
        # per order: different keys, first position and counts of each, and the key of each position (-1: none)
        self.keys, self.first, self.own, self.at = [], [], [], []
        whole = self.tokens
        for n in range(1, order + 1):
            if n > 1:
                whole = mix(np.r_[np.uint64(0), whole[:-1]] * np.uint64(0xA0761D6478BD642F) + self.tokens + np.uint64(n))
            # the start mark is a context and never predicted; contexts do not reach before it
            there = np.flatnonzero(place >= max(n - 1, 1))
            keys, first, inverse = np.unique(whole[there], return_index=True, return_inverse=True)
            at = np.full(len(whole), -1, dtype=np.int32)
            at[there] = inverse
            self.keys.append(keys)
            self.first.append(there[first])
            self.own.append(np.bincount(inverse, weights=train[there], minlength=len(keys)).astype(np.int64))
            self.at.append(at)
        self.total = [own.copy() for own in self.own]
        self.shared = [np.zeros(len(k), dtype=bool) for k in self.keys]
        self.all_tokens = self.all_words = 0

    def hear(self, replies: pa.Table, buckets: int) -> None:
        """Takes in the totals that buckets have sent, in the order of what was asked of them."""
        rows = replies.to_pylist()
        for row in rows:
            if row["level"] == _TOKENS:
                self.all_tokens = row["n"]
            elif row["level"] == _WORDS:
                self.all_words = row["n"]
        for level in range(1, len(self.keys) + 1):
            asked = None
            for row in rows:
                if row["level"] == level:
                    if asked is None:
                        asked, cuts = self.asked(level, buckets)
                    where = asked[cuts[row["bucket"]]: cuts[row["bucket"] + 1]]
                    self.total[level - 1][where] = unpack_counts(row["totals"], row["n"])
                    self.shared[level - 1][where] = np.unpackbits(np.frombuffer(row["shared"], dtype=np.uint8), count=row["n"])

    def wanted(self, level: int) -> np.ndarray:
        """Which n-grams to ask for: all of one or two words; longer ones if both shorter ones occur elsewhere."""
        if level <= 2:
            return np.ones(len(self.keys[level - 1]), dtype=bool)
        last = self.first[level - 1]
        shorter, shared = self.at[level - 2], self.shared[level - 2]
        return shared[shorter[last]] & shared[shorter[last - 1]]

    def asked(self, level: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the wanted n-grams, by key, and where those of each bucket begin."""
        some = np.flatnonzero(self.wanted(level))
        bucket = (self.keys[level - 1][some] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return some, np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))

    def requests(self, part: int, levels: list[int], buckets: int) -> list[dict]:
        out = []
        for level in levels:
            some, cuts = self.asked(level, buckets)
            keys, own = self.keys[level - 1][some], self.own[level - 1][some]
            for b in np.flatnonzero(np.diff(cuts)):
                i, j = cuts[b], cuts[b + 1]
                out.append({"bucket": int(b), "part": part, "level": level, "n": int(j - i),
                            "keys": pack_keys(keys[i:j]), "counts": pack_counts(own[i:j])})
        return out


# --- the automaton of a part ------------------------------------------------------------------------

class Automaton:
    """States 0 (no context) and one for each context that was seen; arcs sorted by state and word."""

    def __init__(self, part: Part, strength: tuple[float, ...]):
        order = len(part.keys)
        self.context = order - 1
        words = len(part.keys[0])
        p = (part.total[0] + PRIOR) / (part.all_tokens + PRIOR * (part.all_words + 1))
        self.base = np.log10(p)
        end = np.searchsorted(part.keys[0], _END)
        starts = part.total[0][end] if end < words and part.keys[0][end] == _END else 0
        # contexts of one word: words, and the start mark as number `words`
        usable = np.r_[part.total[0] > 0, starts > 0]
        usable[end] = False
        seen = np.r_[part.total[0], starts]
        state = np.where(usable, np.cumsum(usable), 0)
        self.fail_to = [np.zeros(1, dtype=np.int64), np.zeros(int(usable.sum()), dtype=np.int64)]
        self.fail_weight = [np.zeros(1), np.log10(strength[0] / (seen[usable] + strength[0]))] if order > 1 else [np.zeros(1), np.zeros(int(usable.sum()))]
        self.start = int(state[words]) if order > 1 else 0
        states = 1 + int(usable.sum())
        one = np.where(part.at[0] >= 0, part.at[0], words)  # context number of each position
        sources, labels = [np.zeros(words, dtype=np.int64)], [np.arange(words)]
        targets, weights = [state[:words] if order > 1 else np.zeros(words, dtype=np.int64)], [self.base]
        context_state, context_seen = state[one], seen[one]  # by position: the longest context that ends there, of this length
        shorter = p
        shorter_at = part.at[0]
        for n in range(2, order + 1):
            total, last = part.total[n - 1], part.first[n - 1]
            there = np.flatnonzero(total > 0)
            last = last[there]
            k = strength[min(n - 2, len(strength) - 1)]
            p_here = np.zeros(len(total))
            p_here[there] = (total[there] + k * shorter[shorter_at[last]]) / (context_seen[last - 1] + k)
            longer_state = np.zeros(len(total), dtype=np.int64)
            if n < order:
                keep = np.zeros(len(total), dtype=bool)
                keep[there] = part.at[0][last] != end
                longer_state[keep] = states + np.arange(int(keep.sum()))
                states += int(keep.sum())
                self.fail_to.append(context_state[part.first[n - 1][keep]])
                nxt = strength[min(n - 1, len(strength) - 1)]
                self.fail_weight.append(np.log10(nxt / (total[keep] + nxt)))
            sources.append(context_state[last - 1])
            labels.append(part.at[0][last])
            targets.append(np.where(longer_state[there] > 0, longer_state[there], context_state[last]))
            weights.append(np.log10(p_here[there]))
            if n < order:
                here = part.at[n - 1]
                known = here >= 0
                found = np.where(known, longer_state[here], 0)
                context_state = np.where(found > 0, found, context_state)
                context_seen = np.where(known, total[here], context_seen)
            shorter, shorter_at = p_here, part.at[n - 1]
        source, label = np.concatenate(sources), np.concatenate(labels)
        self.width = words
        key = source * np.int64(max(words, 1)) + label
        by = np.argsort(key, kind="stable")
        self.arcs = key[by]
        self.target, self.weight = np.concatenate(targets)[by], np.concatenate(weights)[by]
        self.fail_to, self.fail_weight = np.concatenate(self.fail_to), np.concatenate(self.fail_weight)

    def score(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lane: int = LANE) -> np.ndarray:
        """Log-probability of each document, cut into lanes."""
        lanes = -(-lengths // lane)
        doc = np.repeat(np.arange(len(starts)), lanes)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        early = np.minimum(self.context, number * lane)
        begin = number * lane - early
        state = np.where(number > 0, 0, self.start)
        gained = self.traverse(words, starts[doc] + begin, np.minimum(number * lane + lane, lengths[doc]) - begin, state, early)
        return np.bincount(doc, weights=gained, minlength=len(starts))

    def traverse(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray, early: np.ndarray) -> np.ndarray:
        """Log-probability of each lane from its state, all of them stepping together; the ``early`` tokens only move the state."""
        scores = np.zeros(len(starts))
        state = state.astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes = -lengths[order]
        for t in range(int(lengths.max()) if len(lengths) else 0):
            active = order[: np.searchsorted(sizes, -t, "left")]
            word = words[starts[active] + t]
            where, todo = state[active], np.arange(len(active))
            gained = np.zeros(len(active))
            arc = np.zeros(len(active), dtype=np.int64)
            while len(todo):
                key = where[todo] * self.width + word[todo]
                at = np.searchsorted(self.arcs, key)
                hit = self.arcs[np.minimum(at, len(self.arcs) - 1)] == key
                arc[todo[hit]] = at[hit]
                todo = todo[~hit]
                gained[todo] += self.fail_weight[where[todo]]
                where[todo] = self.fail_to[where[todo]]
            scores[active] += np.where(t >= early[active], gained + self.weight[arc], 0.0)
            state[active] = self.target[arc]
        return scores


# --- the steps as Spark sees them ---------------------------------------------------------------------

_COUNTED = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("level", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_REPLIES = pa.schema([("part", pa.int32()), ("level", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("totals", pa.binary()), ("shared", pa.binary())])


def _count(order: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(Part(docs, min(order, 2)).requests(key[0].as_py(), list(range(1, min(order, 2) + 1)), buckets), schema=_COUNTED)
    return run


def _count_longer(level: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _COUNTED.empty_table()
        part = Part(docs, level)
        part.hear(replies, buckets)
        return pa.Table.from_pylist(part.requests(key[0].as_py(), [level], buckets), schema=_COUNTED)
    return run


def _reply(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """For each part the totals of its keys, in its order, and which of them others have."""
    bucket, level = key[0].as_py(), key[1].as_py()
    rows = rows.to_pylist()
    keys = [unpack_keys(r["keys"]) for r in rows]
    counts = [unpack_counts(r["counts"], r["n"]) for r in rows]
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)
    several = np.bincount(inverse, minlength=len(unique)) > 1
    out, at = [], 0
    for row, k in zip(rows, keys):
        mine = inverse[at: at + len(k)]
        at += len(k)
        out.append({"part": row["part"], "level": level, "bucket": bucket, "n": len(k), "totals": pack_counts(total[mine]),
                    "shared": np.packbits(several[mine]).tobytes()})
    return pa.Table.from_pylist(out, schema=_REPLIES)


def _volume(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A bucket's share of N and V: training tokens, and different words among them."""
    tokens, words = 0, []
    if key[1].as_py() == 1:
        for row in rows.to_pylist():
            counts = unpack_counts(row["counts"], row["n"])
            tokens += int(counts.sum())
            words.append(unpack_keys(row["keys"])[counts > 0])
    return pa.table([pa.array([tokens], pa.int64()), pa.array([len(np.unique(np.concatenate(words))) if words else 0], pa.int64())],
                    names=["tokens", "words"])


def _score(order: int, strength: tuple[float, ...], buckets: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        part = Part(docs, order)
        part.hear(replies, buckets)
        automaton = Automaton(part, strength)
        word = part.at[0]
        real = word >= 0
        n = part.lengths - 1
        base = np.bincount(part.doc[real], weights=automaton.base[word[real]], minlength=len(n))
        known = np.bincount(part.doc[real], weights=part.total[0][word[real]] > 0, minlength=len(n)).astype(np.int64)
        score = automaton.score(word, part.starts + 1, n)
        return pa.table([pa.array(part.doc_ids, pa.int64()), pa.array(part.held), pa.array(n, pa.int64()), pa.array(known),
                         pa.array(np.full(len(n), part.all_tokens, dtype=np.int64)), pa.array(base), pa.array(score)], schema=schema)
    return run


def language_scores(docs: DataFrame, order: int = ORDER, strength: tuple[float, ...] = STRENGTH, folds: int = FOLDS,
                    part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    texts = doc_texts(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), -(-size // part_bytes))
    dealt = texts.select("doc_id", "text", held_out("doc_id", folds).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast(
        "int").alias("part")).mapInArrow(_deal, DEALT).repartition(parts, "part")  # one exchange, which every step reads again

    def answered(counted: DataFrame) -> DataFrame:
        return counted.groupBy("bucket", "level").applyInArrow(_reply, REPLIES).repartition(parts, "part")

    counted = dealt.groupBy("part").applyInArrow(_count(order, parts), COUNTED)
    volume = counted.groupBy("bucket", "level").applyInArrow(_volume, "tokens bigint, words bigint").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    told = volume.select(F.array(F.struct(F.lit(_TOKENS).alias("level"), F.col("tokens").alias("n")),
                                 F.struct(F.lit(_WORDS).alias("level"), F.col("words").alias("n"))).alias("both"),
                         F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).select("part", F.explode("both").alias("v")).select(
        "part", "v.level", F.lit(0).alias("bucket"), "v.n", F.lit(None).cast("binary").alias("totals"), F.lit(None).cast("binary").alias("shared"))
    replies = answered(counted).unionByName(told.repartition(parts, "part"))
    for level in range(3, order + 1):
        longer = dealt.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_count_longer(level, parts), COUNTED)
        replies = replies.unionByName(answered(longer))
    return dealt.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_score(order, strength, parts), SCORED)
