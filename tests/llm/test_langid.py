import random

import numpy as np
import pyarrow as pa
import pytest

from themeloom.llm import langid
from themeloom.llm.common import utf8

SF = "/root/testdata/sf0.01"


def greedy(text, sample, segment):
    """Phrases of a text: the longest prefix of what is left that occurs in the sample, or one character."""
    n = 0
    for k in range(0, len(text), segment):
        part = text[k : k + segment]
        i = 0
        while i < len(part):
            j = i + 1
            while j < len(part) and part[i : j + 1] in sample:
                j += 1
            i, n = j, n + 1
    return n


@pytest.mark.parametrize("segment", [5, 2048])
def test_phrases_are_the_longest_matches(segment):
    rng = random.Random(6)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randrange(1, 9)))
    samples = {"x": " ".join(word("abc") for _ in range(60)), "y": " ".join(word("bcdé") for _ in range(60))}
    texts = ["", "a", "zzz", "éa漢b", *(" ".join(word("abcdéz") for _ in range(rng.randrange(12))) for _ in range(60))]
    got, n = langid.Languages.of(samples).phrases(*utf8(pa.array(texts)), segment)
    assert n.tolist() == [len(t) for t in texts]
    assert got.tolist() == [[greedy(t, samples[s], segment) for s in ("x", "y")] for t in texts]


def test_automaton_accepts_factors_only():
    text = "abcbcabba"
    moves = langid.automaton(np.array([ord(c) - 96 for c in text]))
    for length in range(1, 6):
        for k in range(3**length):
            word = [k // 3**i % 3 + 1 for i in range(length)]
            state = 0
            for c in word:
                state = moves[state].get(c, -1) if state >= 0 else -1
            assert (state >= 0) == ("".join(chr(96 + c) for c in word) in text)


def test_every_character_of_the_training_text_is_known():
    """An alphabet far beyond a byte: the training text itself is one phrase a segment, and phrases are the longest matches."""
    rng = random.Random(2)
    han = "".join(chr(0x4E00 + rng.randrange(1500)) for _ in range(9000))
    hangul = "".join(chr(0xAC00 + rng.randrange(900)) for _ in range(9000))
    own = langid.Languages.of({"ko": hangul, "zh": han})
    texts = [han[:2000], hangul[500:2500], han[100:400] + "zz" + hangul[:50] + han[7:9]]
    got, _ = own.phrases(*utf8(pa.array(texts)))
    assert got[0, 1] == 1 and got[1, 0] == 1
    assert got.tolist() == [[greedy(t, s, 2048) for s in (hangul, han)] for t in texts]


def test_moves_find_what_was_put_in_and_nothing_else():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 20_000))
    after = rng.integers(0, 1 << 30, len(keys))
    moves = langid.Moves(keys[::2], after[::2].astype(np.int32))
    assert (moves(keys[::2]) == after[::2]).all() and (moves(keys[1::2]) == -1).all()
    assert (langid.Moves(np.zeros(0, np.int64), np.zeros(0, np.int32))(keys) == -1).all()


def test_repeated_rows_add_nothing_to_the_training_text(spark):
    rows = [(i, f"text {'ab' * (i % 7)} {i}", "en" if i % 2 else "de") for i in range(40)]
    once, often = (spark.createDataFrame(rows * n, "doc_id long, text string, lang string") for n in (1, 5))
    a, b = langid.fit(once), langid.fit(often)
    assert a.names == b.names and (a.sizes == b.sizes).all() and (a.moves.keys == b.moves.keys).all()


def test_accuracy_on_documents_not_trained_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = langid.fit(docs.where("doc_id % 2 = 0"))
    rows = langid.identify(docs.where("doc_id % 2 = 1"), own).join(docs, "doc_id").select("language", "lang").collect()
    assert np.mean([r.language == r.lang for r in rows]) > 0.97 and len(rows) > 400


def test_edges(spark, make_docs, edges):
    docs = make_docs(edges)
    rows = langid.identify(docs, langid.fit(docs)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(edges) and by_id[1].language is None and by_id[2].language is None and by_id[7].language == "en"
    own = langid.Languages.of({"a": "same text", "b": "same text"})
    tie = langid.identify(make_docs([(1, "same"), (2, "漢")]), own).collect()
    assert {r.language for r in tie} == {"a"} and {r.margin for r in tie} == {0}
    none = langid.fit(make_docs([]))
    assert langid.identify(make_docs([]), none).count() == 0
    assert [r.language for r in langid.identify(make_docs([(1, "x")]), none).collect()] == [None]
