"""Language identification by cross-parsing: the language whose text needs the fewest phrases to spell a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import MIX, chunks, ready, utf8

DOCS, CHARS, SEGMENT = 64, 16_000, 2048
_CHUNK = 2 << 20


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Moves of each state of the suffix automaton of text; state 0 is the root."""
    follow, link, length = [{}], [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = cur
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(follow)
                follow.append(follow[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return follow


class Moves:
    """Moves of all states in an open hash table: (state, symbol) to state, so that an alphabet of any size costs its moves and no more."""

    def __init__(self, keys: np.ndarray, after: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(len(keys) * 4).bit_length())) - 1)
        self.keys, self.after = np.full(int(self.mask) + 1, -1, np.int64), np.full(int(self.mask) + 1, -1, np.int32)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.after[at[put]] = keys[put], after[put]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & int(self.mask)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * MIX
        return ((h ^ (h >> np.uint64(29))) & self.mask).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """State after each, -1: none."""
        at = self._home(keys)
        there = self.keys.take(at)
        out = self.after.take(at)
        odd = np.flatnonzero((there != keys) & (there >= 0))
        out[there < 0] = -1
        while len(odd):
            at[odd] = (at[odd] + 1) & int(self.mask)
            there = self.keys[at[odd]]
            out[odd] = np.where(there == keys[odd], self.after[at[odd]], -1)
            odd = odd[(there != keys[odd]) & (there >= 0)]
        return out


@dataclass
class Languages:
    names: list[str]
    symbol: np.ndarray  # character -> symbol, 0: unknown
    moves: Moves  # of all automata: state * symbols + symbol
    root: np.ndarray  # languages x symbols: the state after a phrase's first symbol; 0, where nothing follows, if there is none
    sizes: np.ndarray  # training characters

    @classmethod
    def of(cls, samples: dict[str, str]) -> Languages:
        names = sorted(s for s in samples if samples[s])
        codes = {s: np.frombuffer(samples[s].encode("utf-32-le", "replace"), np.uint32) for s in names}
        seen = np.unique(np.concatenate([*codes.values(), np.zeros(0, np.uint32)]))
        size = len(seen) + 1
        symbol = np.zeros(0x110000, np.int32)
        symbol[seen] = np.arange(1, size)
        keys, after, base = [], [], 1  # state 0: after an unknown character nothing follows
        root = np.zeros((len(names), size), np.int64)
        for k, s in enumerate(names):
            follow = automaton(symbol[codes[s]])
            for state, moves in enumerate(follow):
                keys += [(state + base) * size + c for c in moves]
                after += [q + base for q in moves.values()]
            root[k, list(follow[0])] = [q + base for q in follow[0].values()]
            base += len(follow)
        return cls(names, symbol, Moves(np.array(keys, np.int64), np.array(after, np.int32)), root, np.array([len(codes[s]) for s in names]))

    def phrases(self, data: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and characters by text. A parse begins anew after each `segment` characters."""
        code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        flat = self.symbol[code]
        place = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=place[1:])
        at = place[offsets]
        n = np.diff(at)
        parts = -(-n // segment)
        row = np.repeat(np.arange(len(n)), parts)
        k = np.arange(len(row)) - np.repeat(parts.cumsum() - parts, parts)
        start = at[:-1][row] + k * segment
        size = np.minimum(segment, n[row] - k * segment)
        order = np.argsort(-size, kind="stable")
        row, start, size = row[order], start[order], size[order]
        n_lang = len(self.names)
        count = np.ones((len(row), n_lang), np.int32)
        lanes_at = np.searchsorted(-size, -np.arange(1, segment + 1), "right") if len(row) else np.zeros(segment, int)
        n_symbols = self.root.shape[1]
        shift = np.arange(n_lang) * n_symbols
        root = self.root.reshape(-1)
        state = root[flat[start][:, None].astype(np.int64) + shift] if len(row) else np.zeros((0, n_lang), np.int64)
        for t in range(1, segment):
            lanes = int(lanes_at[t])
            if not lanes:
                break
            c = flat[start[:lanes] + t].astype(np.int64)[:, None]
            after = self.moves((state[:lanes] * n_symbols + c).ravel()).reshape(lanes, n_lang)
            stop = after < 0
            count[:lanes] += stop
            state[:lanes] = after
            where = np.flatnonzero(stop.ravel())
            state[:lanes].reshape(-1)[where] = root.take((c + shift).ravel()[where])
        out = np.stack([np.bincount(row, count[:, i], len(n)) for i in range(n_lang)], 1) if n_lang else np.zeros((len(n), 0))
        return out, n


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", per_language: int = DOCS, chars: int = CHARS) -> Languages:
    """From at most per_language labelled documents a language, those of least hashed id, `chars` lower-case characters in all of each.

    Rows without language, id or text don't count; of an id with several texts the least counts, so repeated rows add nothing.
    """
    ready(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("k"), F.col(lang).alias("l")).distinct()
    best = known.withColumn("i", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k"))).where(F.col("i") <= per_language)
    rows = docs.select(F.col(doc_id).alias("k"), F.col(lang).alias("l"), F.substring(F.lower(text), 1, chars).alias("t")).join(F.broadcast(best), ["k", "l"]).groupBy("l", "i").agg(F.min("t").alias("t")).collect()
    samples: dict[str, str] = {}
    for r in sorted(rows):
        samples[r.l] = (samples.get(r.l, "") + " " + r.t)[: chars + 1]
    return Languages.of({s: x[1:] for s, x in samples.items()})


def identify(docs: DataFrame, languages: Languages, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, language, phrases, entropy (phrases * log2(training characters) / characters), margin to the next; one row a row of docs.

    The least entropy wins, equal ones by name. A character that the training text lacks is a phrase by itself. null or
    empty text: all null. Whole texts are parsed, in segments of SEGMENT characters. Repeated rows repeat; an empty
    table gives no rows; other columns don't matter.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weight, names = np.log2(np.maximum(own.sizes, 2)), np.array([*own.names, ""], object)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, _CHUNK):
                count, n = own.phrases(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                entropy = count * weight / np.maximum(n, 1)[:, None]
                none = (n == 0) | (len(own.names) == 0)
                entropy = np.concatenate([entropy, np.full((len(n), max(1, 2 - entropy.shape[1])), np.inf)], 1)
                order = np.argsort(entropy, 1, kind="stable")
                best, low, next_ = order[:, 0], *np.take_along_axis(entropy, order[:, :2], 1).T
                won = count[np.arange(len(n)), np.minimum(best, max(0, count.shape[1] - 1))] if count.shape[1] else np.zeros(len(n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(names[np.minimum(best, len(own.names))], pa.string(), mask=none), pa.array(won.astype(np.int64), mask=none), pa.array(low, mask=none), pa.array(next_ - low if len(own.names) > 1 else np.zeros(len(n)), mask=none)],
                    ["doc_id", "language", "phrases", "entropy", "margin"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lower(F.col(text).cast("string")).alias("text")).mapInArrow(work, "doc_id long, language string, phrases long, entropy double, margin double")
