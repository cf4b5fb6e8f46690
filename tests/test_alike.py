"""Components of terms by the cosine of their hash vectors, against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from themeloom.operators import bags, similarity


@pytest.mark.parametrize("least", [0.45, 0.6, 0.75, 2.0])
def test_components_are_those_of_all_pairs_in_blocks_of_any_size(spark, monkeypatch, least):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    terms = [f"t{i}" for i in range(90)] + ["é", "Z"]
    v = bags.hash_rows(pa.array(terms))
    near = np.round(v @ v.T / np.sqrt((v * v).sum(1)[:, None] * (v * v).sum(1)), 6) >= least
    want = {}
    for i, t in enumerate(terms):
        seen, todo = {i}, [i]
        while todo:
            fresh = set(np.flatnonzero(near[todo.pop()])) - seen
            seen |= fresh
            todo += fresh
        want[t] = min((terms[j] for j in seen), key=str.encode)
    got = similarity.alike(spark.createDataFrame([(t,) for t in [*terms, "t3"]], "term string"), least)
    assert {r.term: r.root for r in got.collect()} == want and got.count() == len(terms)
    assert similarity.alike(spark.createDataFrame([], "term string"), least).count() == 0


def test_the_query_compares_every_term(spark):
    from themeloom.plans import registry
    from themeloom.sources import tables

    sf = "/root/testdata/sf0.001"
    assert registry.queries()["term_match"](spark, sf).count() == tables.dtm(tables.corpus(spark, sf)).select("term").distinct().count()
