import random
from collections import defaultdict

import pytest

from themeloom.llm.exact import drop_exact, exact_duplicates


def brute(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[("null", n) if t is None else t].append(i)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [0, 1 << 24])
def test_matches_brute_force_over_many_rounds(spark, make_docs, limit):
    rng = random.Random(3)
    stems = ["", "ab", "abab" * 5, "abab" * 9 + "c", "é" * 7]
    rows = [(i, rng.choice(stems) + "".join(rng.choice("ab") for _ in range(rng.randrange(3)))) for i in range(300)]
    got = exact_duplicates(make_docs(rows), first=3, growth=2, broadcast_bytes=limit)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_edges(spark, make_docs, edges):
    assert sorted(map(tuple, exact_duplicates(make_docs(edges)).collect()), key=str) == brute(edges)
    assert exact_duplicates(make_docs([])).count() == 0


def test_drop_keeps_one_row_of_a_text_and_all_columns(spark, make_docs, edges):
    docs = make_docs(edges)
    out = drop_exact(docs)
    assert out.schema == docs.schema
    texts = [r.text for r in out.collect()]
    assert sorted(t for t in texts if t is not None) == sorted({t for _, t in edges if t is not None})
    assert texts.count(None) == 2
    assert drop_exact(make_docs([])).count() == 0
