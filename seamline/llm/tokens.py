"""Token ids of whole texts by the tokenizers library, each different piece of text encoded once per worker.

Texts are cut where the tokenizer itself always cuts, at white space. Pieces are told apart by 64-bit hashes, computed on
whole Arrow columns; a piece not seen lately is encoded by the library: plain letters and marks, many at a time, by
its BPE model, anything else by its whole encoder. Texts with special strings or white space beyond ASCII are encoded
whole. The store of seen pieces is bounded and starts anew when full, which changes speed alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

from seamline.llm.words import digests_of_long, Words, mix, words_of

STORE = 1_000_000
CHUNK_BYTES = 3 << 20

GROUP = 200  # parts the model gets as one text

_LETTER, _MARK = 1, 2
_LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if chr(c) not in "×÷")
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_CLASS[[ord(c) for c in ".,;:!?|*&$%#()-"]] = _MARK
_SPACES = r"\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


class Encoder:
    """Encodes columns of texts.

    ``spaced``: the vocabulary keeps the space before a word and all other white space (byte-level vocabularies).
    Otherwise it drops white space and lower-cases.
    """

    def __init__(self, path: str, spaced: bool, store: int = STORE):
        self.spaced, self.store = spaced, store
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Tokenizer(self.tokenizer.model)
        self.parts.model._resize_cache(0)  # a piece comes here once, so the model's own store only costs
        self.parts.pre_tokenizer = WhitespaceSplit()
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_chars = np.zeros(256, dtype="<u4")  # the character that stands for each byte
        for c in (chr(c) for c in range(0x20, 0x100) if _CLASS[c] or chr(c) == " " or chr(c) in _LATIN):
            for byte, char in zip(c.encode(), level.pre_tokenize_str(c)[0][0]):
                self.byte_chars[byte] = ord(char)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token.removesuffix("</w>")) if not spaced else len(token)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)  # sorted
        self.slots = np.empty(0, dtype=np.int64)
        self.begin = np.zeros(1, dtype=np.int64)  # of each slot's ids in the pool, and its end
        self.pool = np.empty(0, dtype=np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column (null: empty), and the offset of each text's ids and of their end."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        pattern = rf"[{_SPACES}]|<\|" if self.spaced else r"<\|"
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(column, pattern)))
        usual = column
        if len(odd):
            mask = np.zeros(len(column), dtype=bool)
            mask[odd] = True
            usual = pc.if_else(pa.array(mask), pa.scalar("", pa.large_string()), column)
        done = [self._chunk(chunk) for chunk in words_of(usual, CHUNK_BYTES)]
        counts = np.concatenate([n for _, n in done]) if done else np.empty(0, dtype=np.int64)
        flat = [i for i, _ in done]
        if len(odd):
            joined, begin = np.concatenate(flat), np.r_[0, np.cumsum(counts)]
            flat, at = [], 0
            for k in odd:
                own = self.whole(column[int(k)].as_py())
                flat += [joined[at: begin[k]], own]
                counts[k] = len(own)
                at = begin[k]
            flat.append(joined[at:])
        return np.concatenate(flat) if flat else np.empty(0, dtype=np.uint32), np.r_[0, np.cumsum(counts)].astype(np.int64)

    def _chunk(self, chunk: Words) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, text, keys = chunk.starts, chunk.ends, chunk.text, chunk.hashes(exact=self.spaced)
        known: dict[int, str] = {}
        if self.spaced:
            starts, ends, text, keys = self._with_spaces(chunk, keys, known)
        keys = digests_of_long(chunk.data, starts, ends, keys)
        if not len(keys):
            return np.empty(0, dtype=np.uint32), np.zeros(chunk.n_texts, dtype=np.int64)
        order = np.argsort(keys)
        ordered = keys[order]
        opens = np.r_[True, ordered[1:] != ordered[:-1]]
        unique, one = ordered[opens], order[opens]  # a place of each key; any will do
        if len(self.keys) + len(unique) > self.store:
            self._clear()
        at = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), dtype=bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != unique
        if new.any():
            self._learn(chunk.data, unique[new], at[new], starts[one[new]], ends[one[new]], known)
            at = np.searchsorted(self.keys, unique)
        slot = np.empty(len(keys), dtype=np.int64)
        slot[order] = np.repeat(self.slots[at], np.diff(np.r_[np.flatnonzero(opens), len(keys)]))
        lengths = self.begin[slot + 1] - self.begin[slot]
        ends_at = np.cumsum(lengths)
        place = np.arange(ends_at[-1]) + np.repeat(self.begin[slot] - (ends_at - lengths), lengths)
        return self.pool[place], np.bincount(text, weights=lengths, minlength=chunk.n_texts).astype(np.int64)

    def _with_spaces(self, chunk: Words, keys: np.ndarray, known: dict[int, str]):
        """Pieces with the white space they hold: `` word``, and the pieces that the pattern makes of other white space.

        A run of white space before a word gives all but its last character as one piece; the last goes to the word if it
        is a space, else it is a piece. A run at the end of a text is one piece.
        """
        data, offsets, starts, text = chunk.data, chunk.offsets, chunk.starts, chunk.text
        first = np.r_[True, text[1:] != text[:-1]] if len(text) else np.empty(0, dtype=bool)
        gap_start = np.where(first, offsets[text], np.r_[0, chunk.ends[:-1]]) if len(text) else starts
        gap = starts - gap_start
        last = np.where(gap > 0, data[np.maximum(starts - 1, 0)], 0) if len(text) else starts
        space = last == 0x20
        piece_starts = starts - space
        keys = np.where(space, mix(keys + np.uint64(0x51ED270B)), keys)
        extra: list[tuple[int, int, int, int]] = []  # position, end, text, key
        lines = np.flatnonzero((gap == 1) & (last == 0x0A))
        newline = self._named("\n", known)
        for i in np.flatnonzero(((gap == 1) & ~space & (last != 0x0A)) | (gap > 1)):
            run = data[gap_start[i]: starts[i]].tobytes().decode()
            at = int(gap_start[i])
            for part in (run[:-1], "" if space[i] else run[-1]):
                if part:
                    extra.append((at, at + len(part), int(text[i]), self._named(part, known)))
                    at += len(part)
        ends_of = offsets[:-1].copy()
        np.maximum.at(ends_of, text, chunk.ends)
        for i in np.flatnonzero(offsets[1:] > ends_of):
            run = data[ends_of[i]: offsets[i + 1]].tobytes().decode()
            extra.append((int(ends_of[i]), int(offsets[i + 1]), int(i), self._named(run, known)))
        if not len(lines) and not extra:
            return piece_starts, chunk.ends, text, keys
        more = np.array([e[:3] for e in extra], dtype=np.int64).reshape(-1, 3)
        pos = np.r_[piece_starts, starts[lines] - 1, more[:, 0]]
        order = np.argsort(pos, kind="stable")
        return (pos[order], np.r_[chunk.ends, starts[lines], more[:, 1]][order], np.r_[text, text[lines], more[:, 2]][order],
                np.r_[keys, np.full(len(lines), newline, dtype=np.uint64), np.array([e[3] for e in extra], dtype=np.uint64)][order])

    @staticmethod
    def _named(piece: str, known: dict[int, str]) -> int:
        key = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "little")
        known[key] = piece
        return key

    def _learn(self, data: np.ndarray, keys: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: dict[int, str]) -> None:
        """Encodes new pieces and stores their ids; ``at``: where their keys go in the sorted ones."""
        slots = np.empty(len(keys), dtype=np.int64)
        plain, ids, sizes = self._plain(data, starts, ends)
        if known:
            named = np.isin(keys, np.fromiter(known, dtype=np.uint64, count=len(known)))
            if named[plain].any():
                keep = ~named[plain]
                ids = ids[np.repeat(keep, sizes)]
                plain, sizes = plain[keep], sizes[keep]
        slots[plain] = len(self.begin) - 1 + np.arange(len(plain))
        rest = np.setdiff1d(np.arange(len(keys)), plain, assume_unique=True)
        others = [self.whole(known.get(int(keys[k])) or data[starts[k]: ends[k]].tobytes().decode()) for k in rest]
        slots[rest] = len(self.begin) - 1 + len(plain) + np.arange(len(rest))
        sizes = np.r_[sizes, np.fromiter(map(len, others), dtype=np.int64, count=len(others))]
        self.begin = np.r_[self.begin, self.begin[-1] + np.cumsum(sizes)]
        self.pool = np.concatenate([self.pool, ids, *others])
        self.keys = np.insert(self.keys, at, keys)
        self.slots = np.insert(self.slots, at, slots)

    def _plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces are letters, then marks, with at most one space before them; their ids, and how many each has.

        The bytes of all pieces are looked at as one column. A piece whose bytes have other classes, or letters behind
        marks, is left to the whole encoder. Letters and marks are parts of their own, and the model gets many parts at a time.
        """
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        raw = data[np.arange(lengths.sum()) + np.repeat(starts - first, lengths)]
        if not len(raw):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        kind = _CLASS[raw]
        lead = np.flatnonzero(raw == 0xC3)
        lead = lead[lead + 1 < len(raw)]
        second = raw[lead + 1]
        latin = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
        kind[latin] = kind[latin + 1] = _LETTER
        begins = np.zeros(len(raw), dtype=bool)
        begins[first] = True
        if self.spaced:
            space = first[(raw[first] == 0x20) & (lengths > 1)]
            kind[space] = kind[space + 1]
        turn = np.r_[True, kind[1:] != kind[:-1]]
        wrong = (kind == 0) | (turn & (kind == _LETTER) & ~begins)
        plain = np.flatnonzero(np.add.reduceat(wrong, first, dtype=np.int64) == 0)
        if not len(plain):
            return plain, np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        keep = np.zeros(len(lengths), dtype=bool)
        keep[plain] = True
        inside = np.repeat(keep, lengths)
        cut = np.flatnonzero((turn | begins)[inside])  # where parts begin
        owner = np.repeat(np.arange(len(plain)), lengths[plain])[cut]
        letters = raw[inside]
        if not self.spaced:
            upper = (letters >= 0x41) & (letters <= 0x5A)
            upper[1:] |= (letters[:-1] == 0xC3) & (letters[1:] >= 0x80) & (letters[1:] <= 0x9E)
            letters = letters + np.uint8(0x20) * upper
        text = np.insert(self.byte_chars[letters], cut[1:], 0x20)
        bounds = np.r_[(cut + np.arange(len(cut)))[::GROUP], len(text) + 1]
        groups = [text[i: j - 1].tobytes().decode("utf-32-le") for i, j in zip(bounds[:-1], bounds[1:])]
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.parts.encode_batch_fast(groups, add_special_tokens=False)])
        part_ends = np.searchsorted(np.cumsum(self.width[ids]), np.r_[cut[1:], len(letters)]) + 1
        last = np.r_[owner[1:] != owner[:-1], True]
        return plain, ids, np.diff(part_ends[last], prepend=0)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder per worker process."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]
