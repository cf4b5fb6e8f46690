import random

import numpy as np
import pytest

from themeloom.llm import minhash
from themeloom.llm.common import Scratch, utf8


def shingle_set(text, k=3):
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def corpus(seed=1, n=60):
    """Texts of random words, each with a few copies of which some words are others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([2, 30, 120]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(len(copy) // 15 + 1)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return list(enumerate(out))


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_signature_is_the_minimum_of_each_hash():
    import pyarrow as pa

    a, b = minhash.coefficients(16)
    data, offsets = utf8(pa.array(["one two three four five", "", "!!", "solo", None, "two words"]))
    keys, n = minhash.shingles(data, offsets, 3)
    assert n.tolist() == [3, 0, 0, 1, 0, 1]
    sig = minhash.signatures(data, offsets, a, b, 3, block=4)
    for h in range(16):
        assert sig[0, h] == min(int(((int(a[h]) * int(x) + int(b[h])) % 2**64) >> 32) for x in keys[:3])
    assert (sig[[1, 2, 4]] == 0xFFFFFFFF).all()


def test_groups_hold_pairs_that_brute_force_finds(spark, make_docs):
    rows = corpus()
    sets = {i: shingle_set(t) for i, t in rows}
    close = [(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.7]
    far = {(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) < 0.3}
    group = {r.doc_id: r.group_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert len(group) == len(rows)
    assert sum(group[i] == group[j] for i, j in close) >= 0.97 * len(close) > 20
    linked = roots([(i, j) for i, j in ((i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.4)], sets)
    assert not [p for p in far if group[p[0]] == group[p[1]] and linked[p[0]] != linked[p[1]]]
    assert all(group[g] == g for g in group.values())


def test_buckets_of_unlike_documents_are_compared_pair_by_pair(spark):
    """A hub that is like nobody must not hide pairs among the others."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**32, (3, 128), dtype=np.uint32)
    base[:, :4] = 7  # all share the first band
    sigs = [base[0], base[1], base[1], base[2], base[2], base[2]]
    reps = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "doc_id long, sig binary")
    for rounds in (0, 1, 2):
        edges = minhash.near_edges(reps, Scratch(spark), 128, 32, 0.6, rounds).collect()
        got = roots([tuple(e) for e in edges], range(6))
        assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, 5: 3}


@pytest.mark.parametrize("pairs", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 52), (50, 52)], [(3, 3)]])
def test_components(spark, pairs):
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()}
    pairs = [p for p in pairs if p[0] != p[1]]
    assert got == roots(pairs, {x for p in pairs for x in p})


def test_edges(spark, make_docs, edges):
    docs = make_docs(edges)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(edges)
    group = {r.doc_id: r.group_id for r in got}
    assert group[8] == 7 and group[1] == 1 and group[2] == 2 and group[3] == 3 and group[4] == 4 and group[5] == 5 and group[None] is None
    assert all(r.kept for r in got if r.doc_id is None)
    kept = minhash.drop_near(docs)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 11, 12] or sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12]
    assert ids.count(None) == 3
    assert minhash.near_duplicates(make_docs([])).count() == 0 == minhash.drop_near(make_docs([])).count()


@pytest.mark.parametrize(("words", "replaced"), [(120, 8), (300, 18)])
def test_a_star_whose_centre_is_not_the_least_id_stays_whole(spark, make_docs, words, replaced):
    """Copies like their original but not one another: groups are those of all pairs that share a band."""
    import pyarrow as pa

    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(words)]
    texts = [" ".join(base)]
    for _ in range(59):
        copy = list(base)
        for at in rng.sample(range(words), replaced):
            copy[at] = word()
        texts.append(" ".join(copy))
    texts = texts[1:31] + texts[:1] + texts[31:]
    a, b = minhash.coefficients(minhash.HASHES)
    sigs = minhash.signatures(*utf8(pa.array(texts)), a, b, minhash.SHINGLE)
    bands = sigs.reshape(len(texts), minhash.BANDS, -1)
    pairs = [(i, j) for i in range(60) for j in range(i + 1, 60) if (bands[i] == bands[j]).all(1).any() and (sigs[i] == sigs[j]).sum() >= minhash.SIMILAR * minhash.HASHES]
    group = {r.doc_id: r.group_id for r in minhash.near_duplicates(make_docs(list(enumerate(texts)))).collect()}
    assert group == roots(pairs, range(60))
    assert len(pairs) < 60 * 59 // 4


def test_joins_span_what_all_pairs_do():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 60):
        for cut in (n, n // 2 or n):
            sigs, label = rng.integers(0, 3, (n, 16), dtype=np.uint32), rng.integers(0, max(1, n // 2), n)
            a, b = minhash.joins(sigs, label, cut, 9)
            pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if (cut == n or i < cut <= j) and (sigs[i] == sigs[j]).sum() >= 9]
            assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} <= set(pairs)
            same = [(i, j) for i in range(n) for j in range(n) if label[i] == label[j]]
            assert roots([*zip(a.tolist(), b.tolist(), strict=True), *same], range(n)) == roots(pairs + same, range(n))


def signed(places, fill):
    """A signature that has the given value at those places, and a fill elsewhere."""
    out = np.arange(128, dtype=np.uint32) + np.uint32(fill)
    out[list(places)] = 7
    return out


@pytest.mark.parametrize("tile", [256, 2])
def test_a_member_alike_to_the_hub_is_compared_with_the_rest_too(spark, monkeypatch, tile):
    """hub ~ a, a ~ c, hub and c too far apart; all share a band. And a chain of 9 of which each is like the next alone."""
    monkeypatch.setattr(minhash, "TILE", tile)
    hub, a, c = signed(range(98), 1000), signed(range(128), 0), signed([*range(4), *range(33, 128)], 2000)
    chain = [signed(range(0), 5000 + 0) for _ in range(9)]
    for k in range(9):
        chain[k] = np.concatenate([np.full(4, 9, np.uint32), *(np.full(12, 100 + (k + j) // 2 * 50 + j, np.uint32) for j in range(10)), np.full(4, 10_000 + k, np.uint32)])
    sigs = [hub, a, c, *chain]
    reps = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "doc_id long, sig binary")
    alike = [(i, j) for i in range(12) for j in range(i + 1, 12) if (sigs[i].reshape(32, 4) == sigs[j].reshape(32, 4)).all(1).any() and (sigs[i] == sigs[j]).sum() >= 0.6 * 128]
    assert (0, 1) in alike and (1, 2) in alike and (0, 2) not in alike
    edges = [tuple(e) for e in minhash.near_edges(reps, Scratch(spark), 128, 32, 0.6).collect()]
    assert set(edges) <= set(alike) and roots(edges, range(12)) == roots(alike, range(12))
