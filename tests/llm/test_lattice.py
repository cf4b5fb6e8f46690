import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from themeloom.llm import lattice
from themeloom.llm.bpe import PerfectHash
from themeloom.llm.common import utf8


def small(words, seed=0):
    rng = np.random.default_rng(seed)
    words = [w.encode() for w in words]
    keys = np.array([lattice.Pieces.key(w) for w in words], np.uint64)
    table = PerfectHash(keys)
    p = rng.random(len(words) + 256)
    log = np.log(p / p.sum())
    by_slot, score = np.zeros(len(words), np.uint64), np.zeros(len(words))
    at = table.slots(keys)
    by_slot[at], score[at] = keys, log[: len(words)]
    return lattice.Pieces(table, by_slot, score, np.unique([len(w) for w in words]), log[len(words) :], *lattice.Pieces.spelled(words, at)), dict(zip(words, log, strict=False)), at


def segmentations(word, known, single):
    """All ways to spell the word: pieces, and bytes of characters that are no piece."""
    spelt, i = set(), 0
    for c in word.decode():
        n = len(c.encode())
        if c.encode() not in known:
            spelt |= set(range(i, i + n))
        i += n

    def rest(i):
        if i == len(word):
            yield []
            return
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in known:
                for r in rest(j):
                    yield [(word[i:j], known[word[i:j]]), *r]
        if i in spelt:
            for r in rest(i + 1):
                yield [(i, single[word[i]]), *r]

    return list(rest(0))


WORDS = [" ", "a", "b", " a", "ab", "ba", "aab", " b", "é", " é", "bé", "abab", " ab"]


@pytest.mark.parametrize("text", ["a", "ab", "abab", "aababab", "bé", "éa", "c", "acb", "漢a", "abé漢ba"])
def test_marginal_sums_all_segmentations(text):
    pieces, known, at = small(WORDS)
    word = b" " + text.encode()
    ways = segmentations(word, known, pieces.single)
    want = math.log(sum(math.exp(sum(s for _, s in w)) for w in ways))
    data = np.frombuffer(text.encode(), np.uint8)
    got, expected = pieces.marginals(data, np.array([0]), np.array([len(data)]), np.array([3.0]))
    assert got[0] == pytest.approx(want, abs=1e-9)
    share = Counter()
    for w in ways:
        for piece, _ in w:
            share[piece if isinstance(piece, bytes) else word[piece]] += 3 * math.exp(sum(s for _, s in w) - want)
    for n, w in enumerate(known):
        assert expected[at[n]] == pytest.approx(share[w], abs=1e-9)
    for b in range(256):
        assert expected[len(known) + b] == pytest.approx(share[b], abs=1e-9)


def test_document_is_the_sum_of_its_words():
    pieces, _, _ = small(WORDS)
    data, offsets = utf8(pa.array(["ab  a\n", "", None, "abab ab", "a ab"]))
    total, words, n_bytes = lattice.scored(pieces, data, offsets)
    one = lambda t: lattice.scored(pieces, *utf8(pa.array([t])))[0][0]
    assert words.tolist() == [2, 0, 0, 2, 2] and n_bytes.tolist() == [5, 0, 0, 8, 5]
    assert total.tolist() == pytest.approx([one("ab") + one("a"), 0, 0, one("abab") + one("ab"), one("ab") + one("a")])


def test_scores_of_a_corpus_are_those_of_its_counts(spark, make_docs):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "the cat", "the the mat\n", None, ""])]
    counts = {bytes(r.word).decode(): r.n for r in lattice.word_counts(make_docs(rows), "text").collect()}
    assert counts == Counter("the cat sat the cat the the mat".split())
    fitted = lattice.fit(make_docs(rows))
    assert np.exp(np.r_[fitted.score, fitted.single]).sum() == pytest.approx(1)
    start = lattice.Pieces.load(lattice.PIECES)
    words = sorted(counts)
    data = np.frombuffer("".join(words).encode(), np.uint8)
    n = np.array([len(w) for w in words])
    _, expected = start.marginals(data, n.cumsum() - n, n, np.array([counts[w] for w in words], float))
    want = np.exp(np.r_[start.score, start.single]) * lattice.PRIOR + expected
    assert np.exp(np.r_[fitted.score, fitted.single]) == pytest.approx(want / want.sum())


def test_edges(spark, make_docs, edges):
    docs = make_docs(edges)
    fitted = lattice.fit(docs)
    rows = lattice.score(docs, fitted).collect()
    assert len(rows) == len(edges)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].log_prob is None and by_id[2].log_prob == 0 and by_id[2].bits_per_byte is None
    assert by_id[7].log_prob == by_id[8].log_prob and by_id[7].n_words == 60_000
    assert all(math.isfinite(r.log_prob) for r in rows if r.log_prob is not None)
    empty = make_docs([])
    assert lattice.score(empty, lattice.fit(empty)).count() == 0


def test_pieces_and_words_are_told_apart_by_their_bytes():
    """A Thue-Morse word and its complement, which collide under the pieces' polynomial hash: only the true piece matches, and words keep their own scores."""
    word = b"a"
    while len(word) < 2048:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    twin = word.translate(bytes.maketrans(b"ab", b"ba"))
    assert lattice.Pieces.key(word) == lattice.Pieces.key(twin)
    words = [b"a", b"b", b" ", b" " + word]
    keys = np.array([lattice.Pieces.key(w) for w in words], np.uint64)
    table = lattice.PerfectHash(keys)
    at, log = table.slots(keys), np.log(np.full(len(words) + 256, 1 / (len(words) + 256)))
    by_slot, score = np.zeros(len(words), np.uint64), np.zeros(len(words))
    by_slot[at], score[at] = keys, log[: len(words)]
    pieces = lattice.Pieces(table, by_slot, score, np.unique([len(w) for w in words]), log[len(words) :], *lattice.Pieces.spelled(words, at))
    data = np.frombuffer(word + twin, np.uint8)
    got, _ = pieces.marginals(data, np.array([0, 2048]), np.array([2048, 2048]))
    assert got[0] > -10 > got[1] and got[1] == pytest.approx(2049 * log[0])
