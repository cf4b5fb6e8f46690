import base64
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from themeloom.llm import bpe
from themeloom.llm.common import distinct


@pytest.fixture(scope="module")
def peer():
    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts):
    import pyarrow as pa

    from themeloom.llm.common import utf8

    ids, n = bpe.Encoder.of(bpe.RANKS).encode(*utf8(pa.array(texts)))
    return [x.tolist() for x in np.split(ids, n.cumsum()[:-1])]


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(len(keys)))
    for few in (1, 2, 3):
        assert sorted(bpe.PerfectHash(keys[:few]).slots(keys[:few]).tolist()) == list(range(few))


def test_heap_merges_as_repeated_search_does():
    rng = random.Random(2)
    ranks = {bytes([c]): c for c in b"abc"} | {b"ab": 300, b"bc": 301, b"abc": 302, b"aa": 303, b"aaa": 304, b"ca": 305, b"caab": 306, b"aab": 307}
    for _ in range(500):
        token = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 15)))
        parts = [token[i : i + 1] for i in range(len(token))]
        while found := [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]:
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge(token, ranks) == [ranks[p] for p in parts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'srevltmd!a1é漢　"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=8))
def test_matches_a_public_encoder(peer, texts):
    assert encode(texts) == [peer.encode_ordinary(t) for t in texts]


def test_edges_and_round_trip(spark, make_docs, edges, peer):
    rows = bpe.encode_documents(make_docs(edges)).collect()
    assert len(rows) == len(edges)
    want = sorted(((i, None if t is None else peer.encode_ordinary(t)) for i, t in edges), key=str)
    assert sorted(((r.doc_id, r.token_ids) for r in rows), key=str) == want
    assert all(r.round_trip is (None if r.token_ids is None else True) for r in rows)
    back = bpe.decode_documents(bpe.encode_documents(make_docs(edges))).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(edges, key=str)
    assert bpe.encode_documents(make_docs([])).count() == 0


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_strings_that_polynomial_hashes_confuse_keep_their_own_tokens(spark, make_docs):
    """A Thue-Morse word and its complement collide under every polynomial hash modulo 2 ** 64; and distinct() compares bytes, whatever the hash says."""
    word = thue_morse(2048)
    twin = word.translate(str.maketrans("ab", "ba"))
    rows = bpe.encode_documents(make_docs([(1, word), (2, twin), (3, word)]).coalesce(1)).collect()
    assert all(r.round_trip for r in rows)
    tokens = {r.doc_id: r.token_ids for r in rows}
    assert tokens[1] == tokens[3] != tokens[2]
    data = np.frombuffer(b"abcxyzabclongerthaneight!longerthaneight?", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 25]), np.array([3, 6, 9, 25, 41])
    first, back = distinct(data, starts, ends - starts, np.zeros(5, np.uint64))
    spans = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    assert [spans[first[k]] for k in back] == spans and len(first) == 4


def test_decode_by_itself(spark, make_docs, edges):
    docs = make_docs(edges)
    tokens = bpe.encode_documents(docs)
    back = sorted(map(tuple, bpe.decode_documents(tokens).collect()), key=str)
    assert back == sorted(((i, t) for i, t in edges), key=str)
    with pytest.raises(Exception, match="no id of the vocabulary"):
        bpe.decode_documents(spark.createDataFrame([(1, [5, 10**7])], "doc_id long, token_ids array<int>")).collect()
