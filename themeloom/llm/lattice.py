"""Likelihood of text under a subword lattice: all segmentations into vocabulary pieces, summed in log space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.bpe import PerfectHash
from themeloom.llm.common import BLOCK, chunks, distinct, gather, ragged, ready, runs, spans_hash, utf8

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
PRIOR = 1000.0
_INK = np.ones(256, np.uint8)
_INK[:33] = 0
_B = 0x9E6C63D0876A9A47


@dataclass
class Pieces:
    """Pieces as bytes (a word's start is a space) with log scores; `single` are the scores of lone bytes."""

    hash: PerfectHash
    keys: np.ndarray  # by slot
    score: np.ndarray  # by slot
    lengths: np.ndarray  # those that pieces have
    single: np.ndarray
    spelling: np.ndarray  # by slot, rows of bytes, 0 after a piece's end
    size: np.ndarray  # by slot, bytes

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a vocabulary file: scores rank the pieces there, and a piece's prior is Zipf's, 1 / (10 + rank)."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        words = {}
        for i in ids:
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                words.setdefault(model.id_to_piece(i).replace("▁", " ").encode(), model.get_score(i))
        names = sorted(words, key=lambda w: (-words[w], w))
        prior = np.concatenate([1 / (10.0 + np.arange(len(names))), np.full(256, 1 / (10.0 + len(names)))])
        prior = np.log(prior / prior.sum())
        keys = np.array([cls.key(w) for w in names], np.uint64)
        table = PerfectHash(keys)
        by_slot, score = np.zeros(len(names), np.uint64), np.zeros(len(names))
        at = table.slots(keys)
        by_slot[at], score[at] = keys, prior[: len(names)]
        return cls(table, by_slot, score, np.unique([len(w) for w in names]), prior[len(names) :], *cls.spelled(names, at))

    @staticmethod
    def spelled(words: list[bytes], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the words, and how many, by slot."""
        spelling, size = np.zeros((len(words), max(map(len, words))), np.uint8), np.zeros(len(words), np.int64)
        for i, w in zip(slots.tolist(), words, strict=True):
            spelling[i, : len(w)], size[i] = np.frombuffer(w, np.uint8), len(w)
        return spelling, size

    @staticmethod
    def key(word: bytes) -> int:
        h = 0
        for b in word:
            h = (h * _B + b + 1) & (2**64 - 1)
        return h

    def arcs(self, group: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Start, end, words, slots of all pieces in words of one length (length x words), by end. Slot n + b is the lone byte b.

        A character that is no piece by itself may be spelt by its bytes.
        """
        size, n = group.shape
        power = np.array([pow(_B, i, 2**64) for i in range(int(self.lengths.max(initial=0)) + 1)], np.uint64)
        prefix = np.zeros((size + 1, n), np.uint64)
        for j in range(size):
            prefix[j + 1] = prefix[j] * np.uint64(_B) + group[j] + np.uint64(1)
        spelt = np.zeros((size, n), bool)
        heads = (group & 0xC0) != 0x80
        for width in range(1, 5):
            for i in range(size):
                lead = group[i]
                own = heads[i] & (((lead < 0xC0) & (width == 1)) | ((lead >= 0xC0) & (lead < 0xE0) & (width == 2)) | ((lead >= 0xE0) & (lead < 0xF0) & (width == 3)) | ((lead >= 0xF0) & (width == 4)))
                at = np.flatnonzero(own)
                if not len(at):
                    continue
                end = min(size, i + width)
                if end - i < len(power):
                    slot, known = self.find(prefix[end, at] - prefix[i, at] * power[end - i])
                    known[known] = self.spells(slot[known], group[i:end, at[known]])
                    at = at[~known]
                spelt[i:end, at] = True
        spelt |= ~heads & ~np.maximum.accumulate(heads, 0)  # bytes that no character starts
        for j in range(1, size + 1):
            for width in self.lengths[self.lengths <= j].tolist():
                slot, known = self.find(prefix[j] - prefix[j - width] * power[width])
                words = np.flatnonzero(known)
                words = words[self.spells(slot[words], group[j - width : j, words])]
                if len(words):
                    yield j - width, j, words, slot[words]
            words = np.flatnonzero(spelt[j - 1])
            if len(words):
                yield j - 1, j, words, self.hash.n + group[j - 1, words].astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.hash.slots(keys)
        return slot, self.keys[slot] == keys

    def spells(self, slot: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Whether pieces have the very bytes of text (bytes x words)."""
        return (self.size[slot] == len(text)) & (self.spelling[slot, : len(text)].T == text).all(0)

    def marginals(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word, a space put before it, over all its segmentations; and, given the words' counts, the expected counts of
        pieces (by slot, then lone bytes)."""
        out, score = np.zeros(len(starts)), np.concatenate([self.score, self.single])
        expected = np.zeros(len(score))
        for size in np.unique(lengths).tolist():
            every = np.flatnonzero(lengths == size)
            step = max(1, (1 << 22) // (size + 1) // (8 if counts is None else 32))
            for k in range(0, len(every), step):
                own = every[k : k + step]
                group = np.full((size + 1, len(own)), 32, np.uint8)
                group[1:] = data[starts[own][None, :] + np.arange(size)[:, None]]
                alpha = np.full((size + 2, len(own)), -np.inf)
                alpha[0] = 0
                kept = []
                for i, j, words, slot in self.arcs(group):
                    alpha[j, words] = np.logaddexp(alpha[j, words], alpha[i, words] + score[slot])
                    if counts is not None:
                        kept.append((i, j, words, slot))
                out[own] = alpha[size + 1]
                if counts is not None:
                    beta = np.full((size + 2, len(own)), -np.inf)
                    beta[size + 1] = 0
                    for i, j, words, slot in reversed(kept):
                        through = score[slot] + beta[j, words]
                        beta[i, words] = np.logaddexp(beta[i, words], through)
                    for i, j, words, slot in kept:
                        share = np.exp(alpha[i, words] + score[slot] + beta[j, words] - alpha[size + 1, words]) * counts[own[words]]
                        expected += np.bincount(slot, share, len(score))
        return out, expected


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word (its bytes), n over all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in chunks(offsets, 8 << 20):
                own, parts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                hashes, where, size = [], [], []
                for k, m in chunks(parts, BLOCK):
                    starts, ends = runs(_INK[own[parts[k] : parts[m]]], parts[k : m + 1] - parts[k])
                    hashes.append(spans_hash(own[parts[k] : parts[m]], starts, ends))
                    where.append(starts + parts[k])
                    size.append(ends - starts)
                where, size = np.concatenate(where), np.concatenate(size)
                first, back = distinct(own, where, size, np.concatenate(hashes))
                n = np.bincount(back, minlength=len(first))
                where, size = where[first], size[first]
                yield pa.RecordBatch.from_arrays([ragged(gather(own, where, size) if len(first) else np.zeros(0, np.uint8), size), pa.array(n)], ["word", "n"])

    found = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text")).mapInArrow(work, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", path: str = PIECES, prior: float = PRIOR) -> Pieces:
    """The vocabulary with scores from the corpus: expected piece counts over all documents' words, from the ranks' prior.

    The file's scores rank its pieces, they aren't probabilities; one pass of expectation over the lattices of all words makes them so. `prior` is
    the weight, in pieces, of the ranks against the counts.
    """
    ready(docs.sparkSession)
    pieces = Pieces.load(path)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            total = total + shared.value.marginals(data, offsets[:-1], np.diff(offsets), batch.column(1).to_numpy().astype(np.float64))[1]
        if np.ndim(total):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

    counts = word_counts(docs, text).mapInArrow(work, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    n = np.concatenate([np.exp(pieces.score), np.exp(pieces.single)]) * prior
    n[counts.column("piece").to_numpy()] += counts.column("n").to_numpy()
    log = np.log(n / n.sum())
    return Pieces(pieces.hash, pieces.keys, log[: pieces.hash.n], pieces.lengths, log[pieces.hash.n :], pieces.spelling, pieces.size)


def score(docs: DataFrame, pieces: Pieces, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_bytes (of words and the space before each), log_prob (natural), bits_per_byte; one row a row of docs.

    No piece crosses white space (bytes up to 32), so a document's marginal is the product of its words'. null text: null
    results; no words: log_prob 0, bits_per_byte null. Every text has a finite log_prob, since lone bytes spell what
    pieces can't. Whole texts count. Repeated rows repeat; an empty table gives no rows; other columns don't matter.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, 8 << 20):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                total, n_words, n_bytes = scored(shared.value, own, at)
                null = batch.column(1).slice(i, j - i).is_null().to_numpy(zero_copy_only=False)
                bits = np.divide(-total / np.log(2), n_bytes, out=np.zeros(len(total)), where=n_bytes > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n_words, mask=null), pa.array(n_bytes, mask=null), pa.array(total, mask=null), pa.array(bits, mask=null | (n_bytes == 0))],
                    ["doc_id", "n_words", "n_bytes", "log_prob", "bits_per_byte"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, "doc_id long, n_words long, n_bytes long, log_prob double, bits_per_byte double")


def scored(pieces: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability, words and bytes of each text."""
    starts, sizes, hashes = [], [], []
    for k, m in chunks(offsets, BLOCK):
        a, b = runs(_INK[data[offsets[k] : offsets[m]]], offsets[k : m + 1] - offsets[k])
        hashes.append(spans_hash(data[offsets[k] : offsets[m]], a, b))
        starts.append(a + offsets[k])
        sizes.append(b - a)
    starts, sizes, hashes = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((starts, np.int64), (sizes, np.int64), (hashes, np.uint64)))
    n = len(offsets) - 1
    row = np.searchsorted(offsets, starts, "right") - 1
    first, back = distinct(data, starts, sizes, hashes)
    log, _ = pieces.marginals(data, starts[first], sizes[first])
    return np.bincount(row, log[back], n) if len(row) else np.zeros(n), np.bincount(row, minlength=n), np.bincount(row, sizes + 1, n).astype(np.int64)

