"""BPE encoding and decoding by forced-boundary splitting (operator 7).

A byte pair that occurs inside no token of the vocabulary can never be merged over, so it marks a certain
cut. A word is cut there, the fragments are encoded independently and their ids concatenated. Fragments of
a batch of unseen words are merged together, one step at a time, on flat numpy arrays.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: The words' pattern of the public vocabulary file word_bpe_49k.json.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_OR_GAP = regex.compile(WORD.pattern + "| ")
#: The same for lower-case ASCII text, which the standard library's engine reads twice as fast.
ASCII_WORD_OR_GAP = re.compile(r"[a-z]+| |'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: White space of that file's normaliser. str.split() also cuts at U+001C to U+001F, which are none here.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: The part of it that is not ASCII.
WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words whose encodings a worker keeps.
CACHE_WORDS = 500_000
#: Places of the table of merges.
TABLE_BITS = 18
#: Longer fragments are merged by a heap, one at a time.
FLAT_SYMBOLS = 64
#: Characters of text that are encoded together.
STEP_CHARS = 2_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


def chunks_of(text: str) -> list[str]:
    """The pieces between white space; no token reaches over it."""
    if any(c in text for c in ODD_SPACE):
        return [x for x in SPACE.split(text) if x]
    return text.split()


class WordBPE:
    """Encoder and decoder for a word-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in alphabet], dtype=np.int64)
        n = self.n = max(vocab.values()) + 1
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        code = np.array([vocab[a] * n + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.rank_of = {c: (r, m) for r, (c, m) in enumerate(zip(code.tolist(), made.tolist(), strict=True))}
        self.made = made
        self._index(code)
        right = np.concatenate([self.inner, self.last])
        #: Rank of the pair of byte a and byte b (256 + b: byte b ends the word), or -1.
        self.first_rank = self._lookup(self.inner[:, None] * n + right[None, :])
        byte_of = {c: b for b, c in enumerate(alphabet)}
        #: Whether byte b may follow byte a inside a token; [.., 256 + b] where b ends the word.
        self.joined = np.zeros((256, 512), dtype=bool)
        for token in vocab:
            closed = token.endswith(end) and len(token) > len(end)
            units = [byte_of[c] for c in (token[: -len(end)] if closed else token)]
            for k in range(len(units) - 1):
                self.joined[units[k], units[k + 1] + (256 if closed and k == len(units) - 2 else 0)] = True
        self.cache: dict[str, tuple[int, ...]] = {}

    def _index(self, code: np.ndarray) -> None:
        """A table with open addressing, sparse enough for one or two probes a pair."""
        self.key = np.full(1 << TABLE_BITS, -1, dtype=np.int64)
        self.rank = np.full(1 << TABLE_BITS, -1, dtype=np.int64)
        at, left = self._place(code), np.arange(len(code))
        while len(left):
            free = self.key[at[left]] < 0
            self.key[at[left[free]]] = code[left[free]]  # of several the last stays, the others go on
            put = self.key[at[left]] == code[left]
            self.rank[at[left[put]]] = left[put]
            left = left[~put]
            at[left] = (at[left] + 1) & ((1 << TABLE_BITS) - 1)

    @staticmethod
    def _place(code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _lookup(self, code: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        flat = code.ravel()
        at = self._place(flat)
        key = self.key[at]
        out = np.where(key == flat, self.rank[at], -1)
        left = np.flatnonzero((key != flat) & (key >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << TABLE_BITS) - 1)
            key = self.key[at[left]]
            hit = key == flat[left]
            out[left[hit]] = self.rank[at[left[hit]]]
            left = left[~hit & (key >= 0)]
        return out.reshape(code.shape)

    def _merge_one(self, ids: list[int]) -> list[int]:
        """Merge one fragment with a heap of (rank, place): n log n for very long ones."""
        n, rank_of = self.n, self.rank_of
        after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank_of.get(ids[i] * n + ids[i + 1]))]
        heap = [(rank, i, made, a, b) for rank, made, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if r := rank_of.get(made * n + ids[after[i]]):
                    heapq.heappush(heap, (r[0], i, r[1], made, ids[after[i]]))
            if (h := before[i]) >= 0 and (r := rank_of.get(ids[h] * n + made)):
                heapq.heappush(heap, (r[0], h, r[1], ids[h], made))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def _encode_flat(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and the word of each id: cut at forced boundaries, merge every fragment, concatenate."""
        is_last = np.zeros(len(data), dtype=bool)
        is_last[np.cumsum(lengths) - 1] = True
        sym = np.where(is_last, self.last[data], self.inner[data])
        cut = np.ones(len(data), dtype=bool)  # whether a fragment begins here
        right = data[1:] + 256 * is_last[1:]
        cut[1:] = is_last[:-1] | ~self.joined[data[:-1], right]
        seg = np.cumsum(cut) - 1
        rank = np.full(len(sym), -1, dtype=np.int64)  # of the pair that begins here
        rank[:-1] = np.where(cut[1:], -1, self.first_rank[data[:-1], right])
        word_of = np.repeat(np.arange(len(lengths)), lengths)[cut]
        size = np.bincount(seg)
        done_seg, done_sym = [], []
        for s in np.flatnonzero(size > FLAT_SYMBOLS):
            merged = self._merge_one(sym[seg == s].tolist())
            done_seg.append(np.full(len(merged), s)), done_sym.append(np.array(merged, dtype=np.int64))
        flat = size[seg] <= FLAT_SYMBOLS
        sym, seg, rank = sym[flat], seg[flat], rank[flat]
        big = np.int64(1) << 60
        while len(sym):
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.minimum.reduceat(np.where(rank >= 0, (rank << 32) + np.arange(len(sym)), big), first)
            live = best < big
            at = best[live] & 0xFFFFFFFF
            if not live.all():  # these fragments are done
                mine = np.repeat(live, np.diff(np.r_[first, len(sym)]))
                done_seg.append(seg[~mine]), done_sym.append(sym[~mine])
                at, sym, seg, rank = (np.cumsum(mine) - 1)[at], sym[mine], seg[mine], rank[mine]
                if not len(sym):
                    break
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            sym, seg, rank = sym[keep], seg[keep], rank[keep]
            beside = np.concatenate([at, at[at > 0] - 1])  # only pairs beside a merge have new ranks
            right = np.minimum(beside + 1, len(sym) - 1)
            inside = (right > beside) & (seg[beside] == seg[right])
            rank[beside] = np.where(inside, self._lookup(sym[beside] * self.n + sym[right]), -1)
        seg, sym = np.concatenate(done_seg), np.concatenate(done_sym)
        order = np.argsort(seg, kind="stable")
        return sym[order], word_of[seg[order]]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without white space, and the bounds of each piece's ids."""
        text = " ".join(chunks)
        if self.special_split and self.special_split.search(text):
            flat = [self._with_special(c) for c in chunks]
            return np.array([i for x in flat for i in x], dtype=np.int64), np.cumsum([0, *map(len, flat)])
        words, chunk_of = self.words_of(text)
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(len(chunks) + 1, dtype=np.int64)
        ids, word = self.encode_words(words)
        return ids, np.searchsorted(chunk_of[word], np.arange(len(chunks) + 1))

    @staticmethod
    def words_of(text: str) -> tuple[list[str], np.ndarray]:
        """The words of pieces that are joined by spaces, and the number of each word's piece."""
        if text.isascii():
            found = ASCII_WORD_OR_GAP.findall(text.lower())
        else:
            found = WORD_OR_GAP.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        words = [w for w in found if w != " "]
        if len(words) == len(found):
            return words, np.zeros(len(words), dtype=np.int64)
        gap = np.fromiter(map(" ".__eq__, found), dtype=bool, count=len(found))
        return words, np.cumsum(gap)[~gap]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and the word of each id."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        return self._encode_flat(np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64), lengths)

    def _with_special(self, chunk: str) -> list[int]:
        out: list[int] = []
        for part in self.special_split.split(chunk):
            out += [self.special[part]] if part in self.special else self.encode_chunks([part])[0].tolist() if part else []
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_chunks(chunks_of(text or ""))[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by one space, as the file names no decoder; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class Memo:
    """For each piece without white space what make() builds from its ids; forgets most when it is full.

    make(ids, bounds) gets the ids of many pieces at once and returns one value for each.
    """

    def __init__(self, bpe: WordBPE, make, limit: int = CACHE_WORDS):
        self.bpe, self.make, self.limit, self.known = bpe, make, limit, {}

    def batches(self, texts: list[str | None], step: int = STEP_CHARS) -> Iterator[list[str]]:
        """The pieces of each text in turn, after self.known has all of them."""
        at = 0
        while at < len(texts):
            group, chars = [], 0
            while at + len(group) < len(texts) and (not group or chars < step):
                text = texts[at + len(group)] or ""
                chars += len(text)
                group.append(chunks_of(text))
            at += len(group)
            every = set().union(*group)
            new = every.difference(self.known)
            if len(self.known) + len(new) > self.limit:  # keep what has come again
                self.known = {c: self.known[c] for c in every.difference(new)}
            for kind in ([c for c in new if c.isascii()], [c for c in new if not c.isascii()]):
                for k in range(0, len(kind), 20_000):
                    part = kind[k : k + 20_000]
                    self.known.update(zip(part, self.make(*self.bpe.encode_chunks(part)), strict=True))
            yield from group


def as_bytes(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Each piece's ids as little-endian unsigned 32-bit numbers."""
    data, at = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


class Spans:
    """Keys and, in one growing array, the ids of each of them."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.bounds, self.used = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 14, dtype=np.int64), 0

    def add(self, keys: list[str], ids: np.ndarray, bounds: np.ndarray) -> None:
        n = len(self.place)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(keys) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.bounds[n + 1 : n + len(keys) + 1] = bounds[1:] + self.used
        self.used += len(ids)
        self.place.update(zip(keys, range(n, n + len(keys)), strict=True))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the keys at these places, one key after the other, and the bounds of each key's ids."""
        start = self.bounds[at]
        n = self.bounds[at + 1] - start
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])], ends


class IdTable:
    """Ids of whole columns of texts: each distinct word is encoded once, and each distinct piece put together once."""

    def __init__(self, bpe: WordBPE, limit: int = CACHE_WORDS):
        self.bpe, self.limit, self.pieces, self.words = bpe, limit, Spans(), Spans()

    def _places(self, pieces: list[str]) -> np.ndarray:
        """The place of each distinct piece, after the unknown ones are encoded; a full table starts anew."""
        if len(self.words.place) > self.limit:
            self.words = Spans()
        if len(self.pieces.place) > self.limit:
            self.pieces = Spans()
        at = np.fromiter(map(self.pieces.place.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        unknown = np.flatnonzero(at < 0)
        plain = np.fromiter((pieces[k].isascii() for k in unknown.tolist()), dtype=bool, count=len(unknown))
        for kind in (unknown[plain], unknown[~plain]):
            for k in range(0, len(kind), 20_000):
                part = kind[k : k + 20_000]
                at[part] = np.arange(len(part)) + len(self.pieces.place)
                self._learn([pieces[i] for i in part.tolist()])
        return at

    def _learn(self, pieces: list[str]) -> None:
        text = " ".join(pieces)
        if self.bpe.special_split and self.bpe.special_split.search(text):
            self.pieces.add(pieces, *self.bpe.encode_chunks(pieces))
            return
        words, piece_of = self.bpe.words_of(text)
        if new := [w for w in dict.fromkeys(words) if w not in self.words.place]:
            ids, word = self.bpe.encode_words(new)
            self.words.add(new, ids, np.searchsorted(word, np.arange(len(new) + 1)))
        at = np.fromiter(map(self.words.place.__getitem__, words), dtype=np.int64, count=len(words))
        ids, ends = self.words.gather(at)
        self.pieces.add(pieces, ids, ends[np.searchsorted(piece_of, np.arange(len(pieces) + 1))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each text's ids; a null text has none."""
        texts = texts.fill_null("")
        if pc.any(pc.match_substring_regex(texts, WIDE_SPACE)).as_py():
            texts = pc.replace_substring_regex(texts, WIDE_SPACE, " ")
        lists = pc.ascii_split_whitespace(texts)
        pieces = lists.flatten().dictionary_encode()
        at = self._places(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, ends = self.pieces.gather(at[pieces.indices.to_numpy()])
        offsets = lists.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]

    def batches(self, texts: pa.Array, step: int = STEP_CHARS) -> Iterator[np.ndarray]:
        """The ids of each text in turn; texts of about `step` bytes are encoded together."""
        sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + step, side="right")))
            ids, bounds = self.encode(texts.slice(at, stop - at))
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield ids[a:b]
            at = stop


_LOADED: dict[str, WordBPE] = {}
_TABLES: dict[str, IdTable] = {}


def loaded(path: str) -> WordBPE:
    """The vocabulary, read once in each Python process."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def table(path: str) -> IdTable:
    """The table of a vocabulary, kept by each Python process from one task to the next."""
    if path not in _TABLES:
        _TABLES[path] = IdTable(loaded(path))
    return _TABLES[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text: doc_id, ids (array of int) and decoded.

    A null text counts as empty: no ids, empty decoded text. Repeated rows and ids each give a row; an empty
    table gives none; other columns are ignored.
    """

    def run(batches):
        bpe = loaded(path)
        memo = Memo(bpe, as_bytes)
        for b in batches:
            ids = [np.frombuffer(b"".join(map(memo.known.__getitem__, x)), dtype="<u4").astype(np.int32) for x in memo.batches(b.column("text").to_pylist())]
            decoded = [bpe.decode(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """encode_documents() with its ids and texts as digests, without moving them out of the Python worker.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256. A null text
    counts as empty; repeated rows each give a row; an empty table gives none.
    """

    def run(batches):
        bpe = loaded(path)

        def make(ids, bounds):
            numbers, tokens, at = list(map(str, ids.tolist())), [bpe.tokens[i] for i in ids.tolist()], bounds.tolist()
            return [(" ".join(numbers[a:b]), " ".join(tokens[a:b])) for a, b in zip(at, at[1:], strict=False)]

        memo = Memo(bpe, make)
        for b in batches:
            n, by_ids, by_text = [], [], []
            for chunks in memo.batches(b.column("text").to_pylist()):
                found = [x for x in map(memo.known.__getitem__, chunks) if x[0]]
                ids = " ".join([x[0] for x in found])
                n.append(ids.count(" ") + 1 if ids else 0)
                by_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                by_text.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
