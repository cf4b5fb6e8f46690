"""Byte-level BPE in two tiers: a minimal perfect hash of the vocabulary, and merges over a heap of linked bytes."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import BLOCK, MIX, alike_spans, chunks, distinct, gather, mix, ready, spans_hash, utf8, words_at

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 150_000


class PerfectHash:
    """Maps n distinct 64-bit keys to 0 .. n - 1, hash-and-displace: a bucket's displacement sends its keys to free slots."""

    def __init__(self, keys: np.ndarray):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        self.move = np.zeros(self.buckets, np.int64)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        free = np.ones(self.n, bool)
        tries = np.arange(1, 513, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            own = keys[order[starts[b] : starts[b + 1]]]
            if len(own) < 2:
                break
            base = 0
            while True:
                at = self._slots(own[None, :], (tries + np.uint64(base))[:, None])
                good = free[at].all(1)
                if len(own) > 1:
                    ranked = np.sort(at, 1)
                    good &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
                hit = int(good.argmax())
                if good[hit]:
                    free[at[hit]] = False
                    self.move[b] = base + hit + 1
                    break
                base += len(tries)
        lone = np.flatnonzero(sizes == 1)
        self.move[lone] = -1 - np.flatnonzero(free)  # a lone key names its slot outright

    def _slots(self, keys: np.ndarray, moves: np.ndarray) -> np.ndarray:
        return (mix(keys ^ (moves * MIX)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        move = self.move[(keys % np.uint64(self.buckets)).astype(np.int64)]
        out = self._slots(keys, move.astype(np.uint64))
        return np.where(move < 0, -1 - move, out)


class Vocabulary:
    """Ranks of byte strings; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = sorted(ranks, key=ranks.get)
        ids = np.array([ranks[t] for t in self.tokens], np.int64)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        ends = lengths.cumsum()
        keys = spans_hash(self.data, ends - lengths, ends)
        self.hash = PerfectHash(keys)
        at = self.hash.slots(keys)
        self.slot_id, self.slot_start, self.slot_length = (np.zeros(len(ids), np.int64) for _ in range(3))
        self.slot_id[at], self.slot_start[at], self.slot_length[at] = ids, ends - lengths, lengths
        self.slot_head = np.zeros(len(ids), np.uint64)
        self.slot_head[at] = words_at(self.data, ends - lengths, lengths)
        self.id_start, self.id_length = (np.zeros(int(ids.max()) + 1, np.int64) for _ in range(2))
        self.id_start[ids], self.id_length[ids] = ends - lengths, lengths

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def whole(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Ids of spans that are tokens, else -1; the bytes are compared, not their hash alone."""
        slot, lengths = self.hash.slots(keys), ends - starts
        hit = (self.slot_length[slot] == lengths) & (self.slot_head[slot] == words_at(data, starts, lengths))
        if len(rest := np.flatnonzero(hit & (lengths > 8))):
            hit[rest] = alike_spans(data, starts[rest], self.data, self.slot_start[slot[rest]], lengths[rest])
        return np.where(hit, self.slot_id[slot], -1)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.data, self.id_start[ids], self.id_length[ids]) if len(ids) else np.zeros(0, np.uint8)


def merge(token: bytes, ranks: dict[bytes, int], heap: list[int] | None = None) -> list[int]:
    """Ids of a pre-token: the pair of least rank is merged, leftmost first; pairs wait in a heap, parts are linked.

    An entry holds rank, start and end of a pair in one number; heap: the entries of the byte pairs, if they are at hand.
    """
    n = len(token)
    rank = ranks.get
    if heap is None:
        heap = [r << 64 | i << 32 | i + 2 for i in range(n - 1) if (r := rank(token[i : i + 2])) is not None]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapify(heap)
    while heap:
        x = heappop(heap)
        end = x & 0xFFFFFFFF
        i = x >> 32 & 0xFFFFFFFF
        mid = after[i]
        if mid < 0 or mid >= n or after[mid] != end:
            continue  # one of its parts has been merged since
        after[i], after[mid] = end, -1
        left = before[i]
        if left >= 0 and (r := rank(token[left:end])) is not None:
            heappush(heap, r << 64 | left << 32 | end)
        if end < n:
            before[end] = i
            right = after[end]
            if (r := rank(token[i:right])) is not None:
                heappush(heap, r << 64 | i << 32 | right)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : after[i]]])
        i = after[i]
    return out


_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _kinds() -> np.ndarray:
    every = "".join(map(chr, range(0x110000)))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts, in bytes, of the pre-tokens that PATTERN finds in each text; each ends where the next starts."""
    code = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    at = None
    if n != len(data):
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        width[(code >= 0xDC80) & (code <= 0xDCFF)] = 1
        at = np.zeros(n + 1, np.int64)
        np.cumsum(width, out=at[1:])
        offsets = np.searchsorted(at, offsets)
    kind = kinds[code]
    border = np.zeros(n + 1, bool)
    border[offsets] = True  # where texts meet
    edge = border.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    start = edge[:n].copy()
    begin = np.flatnonzero(edge)
    final = begin[1:] - 1  # each run's last character
    # White space before other text in the same text: the last character stands apart, and a space joins what follows.
    tail = final[(kind[begin[:-1]] == _SPACE) & ~border[begin[1:]]]
    start[tail] = True
    joins = tail[code[tail] == 32]
    start[joins + 1] = False
    # Contractions: an apostrophe that starts a pre-token, before one of the endings.
    mark = np.flatnonzero((code[: n - 1] == 39) & start[: n - 1] & (kind[1:] == _LETTER) & ~border[1:n])
    if len(mark):
        q, r = code[mark + 1], code[np.minimum(mark + 2, n - 1)]
        two = (mark + 2 < n) & ~border[mark + 2] & (((q == 114) & (r == 101)) | ((q == 118) & (r == 101)) | ((q == 108) & (r == 108)))
        one = (q == 115) | (q == 116) | (q == 109) | (q == 100)
        mark, size = mark[one | two], np.where(two, 3, 2)[one | two]
        start[mark + 1] = False
        after = mark + size
        inner = after[(after < n) & ~border[after]]
        start[inner[kind[inner] == _LETTER]] = True
    start = np.flatnonzero(start)
    return start if at is None else at[start]


class Encoder:
    """A worker's vocabulary and the merges that it has done; the memo is emptied when full, which changes no result."""

    made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.vocabulary = Vocabulary.load(path)
        self.ranks = {t: int(self.vocabulary.slot_id[s]) for t, s in zip(self.vocabulary.tokens, self._slots(), strict=True)}
        self.kinds = _kinds()
        self.pairs = np.full(1 << 16, -1, np.int64)
        for token, r in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = r
        self.memo: dict[bytes, list[int]] = {}

    def _slots(self) -> list[int]:
        v = self.vocabulary
        lengths = np.array([len(t) for t in v.tokens], np.int64)
        ends = lengths.cumsum()
        return v.hash.slots(spans_hash(v.data, ends - lengths, ends)).tolist()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and how many each text has."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        starts = pretokens(data, offsets, self.kinds)
        n = np.diff(np.searchsorted(starts, offsets))
        ends = np.append(starts[1:], len(data))
        keys = spans_hash(data, starts, ends)
        ids = self.vocabulary.whole(data, starts, ends, keys)
        miss = np.flatnonzero(ids < 0)
        counts = np.ones(len(ids), np.int64)
        if len(miss):
            first, back = distinct(data, starts[miss], ends[miss] - starts[miss], keys[miss])
            found, memo, ranks, raw = [], self.memo, self.ranks, data.tobytes()
            if len(memo) > MEMO:
                memo.clear()
            pairs = self.pairs[data[:-1].astype(np.int64) << 8 | data[1:]]
            for i, j in zip(starts[miss[first]].tolist(), ends[miss[first]].tolist(), strict=True):
                token = raw[i:j]
                x = memo.get(token)
                if x is None:
                    x = memo[token] = merge(token, ranks, [r << 64 | k << 32 | k + 2 for k, r in enumerate(pairs[i : j - 1].tolist()) if r >= 0])
                found.append(x)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
            counts[miss] = sizes[back]
        at = counts.cumsum() - counts
        out = np.empty(int(counts.sum()), np.int64)
        out[at[ids >= 0]] = ids[ids >= 0]
        if len(miss):
            size = sizes[back]
            within = np.arange(int(size.sum())) - np.repeat(size.cumsum() - size, size)
            out[np.repeat(at[miss], size) + within] = flat[np.repeat((sizes.cumsum() - sizes)[back], size) + within]
        per_text = np.zeros(len(n), np.int64)
        some = n > 0
        if some.any():
            per_text[some] = np.add.reduceat(counts, (n.cumsum() - n)[some])
        return out, per_text

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes in a row, and how many each text has."""
        sizes = np.concatenate([[0], self.vocabulary.id_length[ids].cumsum()])
        ends = counts.cumsum()
        return self.vocabulary.bytes_of(ids), sizes[ends] - sizes[ends - counts]


def encode_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """doc_id, token_ids, n_tokens, round_trip (decoding the ids gives the text's very bytes); one row a row of docs.

    ranks: a rank file (base64 token, rank) that each worker can read. Text is split by the pattern of such vocabularies;
    strings of special tokens are ordinary text. null text: null results. Empty text: no tokens, round_trip true. Texts
    of any length are encoded whole. Repeated rows repeat; an empty table gives no rows; other columns don't matter.
    """
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, BLOCK):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, counts = encoder.encode(own, at)
                back, sizes = encoder.decode(ids, counts)
                ends = sizes.cumsum()
                alike = (sizes == np.diff(at)) & np.array([np.array_equal(back[e - s : e], own[a:b]) for e, s, a, b in zip(ends, sizes, at[:-1], at[1:], strict=True)], bool)
                null = batch.column(1).slice(i, j - i).is_null()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], counts.cumsum()]), pa.int32()), pa.array(ids.astype(np.int32)), mask=null if null.true_count else None)
                hide = lambda x, null=null: pa.array(x, mask=null.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, hide(counts), hide(alike)], ["doc_id", "token_ids", "n_tokens", "round_trip"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, "doc_id long, token_ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(tokens: DataFrame, ids: str = "token_ids", doc_id: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """doc_id, text from token ids; null ids give null, and bytes that are no text become replacement characters.

    An id outside the vocabulary, or null within a list, is an error that names it. Repeated rows repeat; an empty table gives no rows; other
    columns don't matter.
    """
    ready(tokens.sparkSession)

    def text_of(vocabulary: Vocabulary, ids: list[int]) -> str:
        at = np.array([-1 if i is None else i for i in ids], np.int64)
        known = (at >= 0) & (at < len(vocabulary.id_length))
        known[known] = vocabulary.id_length[at[known]] > 0
        if not known.all():
            raise ValueError(f"{ids[int(np.flatnonzero(~known)[0])]} is no id of the vocabulary")
        return vocabulary.bytes_of(at).tobytes().decode("utf-8", "replace")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks)
        for batch in batches:
            texts = [None if x is None else text_of(encoder.vocabulary, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(work, "doc_id long, text string")
