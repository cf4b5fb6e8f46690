from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from themeloom.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 5))
def test_split_is_an_exact_partition_and_even(blocks, shards, seed):
    out = mixing.split(np.array(blocks), shards, seed)
    assert (out.sum(0) == blocks).all() and (out >= 0).all()
    sizes = out.sum(1)
    assert sizes.max() - sizes.min() <= np.ceil(np.log2(shards + 1)) + 1


def test_split_has_the_hypergeometric_mean():
    draws = np.array([mixing.split(np.array([40, 10]), 5, s)[0] for s in range(400)])
    assert draws.mean(0) == pytest.approx([8, 2], abs=0.25)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.integers(0, 500), min_size=1), st.dictionaries(st.sampled_from("abcdef"), st.floats(0, 3)))
def test_quotas_follow_the_weights(counts, weights):
    got = mixing.quotas(counts, weights, 0.5)
    live = {s for s in counts if counts[s] and weights.get(s, 0) > 0}
    assert set(got) == live and all(0 <= got[s] <= counts[s] for s in got)
    if live:
        most = min(counts[s] / weights[s] for s in live)
        assert all(abs(got[s] - most * weights[s]) <= 1 for s in live)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_plan_meets_quotas_with_disjoint_documents(spark, make_docs):
    rows = [(i, f"text {i}") for i in range(3000)]
    docs = make_docs(rows)
    got = mixing.mix_plan(docs, weights={"src0": 2, "src1": 1, "src2": 0.25}, shards=7, block=8, bucket=100).collect()
    assert Counter(r.source for r in got) == {"src0": 1000, "src1": 500, "src2": 125}
    assert len({r.doc_id for r in got}) == len(got)
    by_shard = Counter(r.shard for r in got)
    assert set(by_shard) == set(range(7)) and max(by_shard.values()) - min(by_shard.values()) <= 4 * 8
    for k in range(7):
        assert sorted(r.position for r in got if r.shard == k) == list(range(by_shard[k]))
    same = mixing.mix_plan(docs.repartition(3), weights={"src0": 2, "src1": 1, "src2": 0.25}, shards=7, block=8, bucket=100)
    assert rows_of(same) == sorted(map(tuple, got), key=str)
    blocks = {}
    for r in got:
        blocks.setdefault((r.source, r.shard), []).append(r.doc_id)
    assert sum(len(b) % 8 != 0 for b in blocks.values()) <= 3


def test_ranks_do_not_depend_on_the_buckets(spark, make_docs):
    docs = make_docs([(i, "same text") for i in range(500)])
    assert rows_of(mixing.mix_plan(docs, bucket=7)) == rows_of(mixing.mix_plan(docs, bucket=10**6))


def test_edges(spark, make_docs, edges):
    rows = [*edges, *[(i, "filler") for i in range(100, 160)], (200, "twin"), (200, "twin")]
    docs = make_docs(rows)
    plan = mixing.mix_plan(docs, weights={"src0": 1, "src1": 1, "src2": 1, "src": 1, None: 5, "absent": 5}, shards=3, block=2).collect()
    n = Counter(r.source for r in docs.collect())
    least = min(n.values())
    bare = docs.withColumn("source", F.when(F.col("source") != "src1", F.col("source")))
    assert Counter(r.source for r in mixing.mix_plan(bare, weights={None: 1}).collect()) == {None: n["src1"]}
    assert Counter(r.source for r in plan) == {s: least for s in n}
    out = mixing.mix_sources(docs, shards=3)
    assert out.schema == docs.schema and out.count() == mixing.mix_plan(docs, shards=3).count() <= len(rows)
    assert mixing.mix_plan(make_docs([])).count() == 0 == mixing.mix_sources(make_docs([])).count()


def test_a_tiny_source_does_not_shrink_the_rest(spark, make_docs):
    counts = {f"s{i}": 500 for i in range(20)}
    whole = mixing.quotas(counts, None, 0.5)
    assert whole == counts
    assert mixing.quotas(counts | {"n": 1}, None, 0.5) == counts | {"n": 1}
    assert mixing.quotas(counts | {f"t{i}": 1 for i in range(900)}, None, 0.5) == counts | {f"t{i}": 1 for i in range(900)}
    docs = make_docs([(i, f"text {i}") for i in range(600)] + [(None, "stray")])
    assert Counter(r.source for r in mixing.mix_plan(docs).collect()) == {"src0": 200, "src1": 200, "src2": 200, "src": 1}


def test_a_large_source_is_still_tempered():
    got = mixing.quotas({"big": 90_000, **{f"s{i}": 1000 for i in range(10)}}, None, 0.5)
    assert got == {"big": 9486, **{f"s{i}": 1000 for i in range(10)}}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.integers(0, 500), min_size=1), st.integers(0, 3000))
def test_a_total_is_met_exactly(counts, total):
    got = mixing.quotas(counts, None, 0.5, total)
    assert sum(got.values()) == min(total, sum(counts.values())) and all(0 <= got[s] <= counts[s] for s in got)


def test_plan_and_mix_draw_the_same_rows(spark, make_docs, edges):
    """Whatever other columns there are; null and repeated ids among them."""
    rows = [*edges, *[(i, f"text {i}") for i in range(100, 700)], (300, "twin of another text")]
    docs = make_docs(rows)
    plan = mixing.mix_plan(docs, weights={"src0": 3, "src1": 1, "src": 1}, shards=3)
    out = mixing.mix_sources(docs, weights={"src0": 3, "src1": 1, "src": 1}, shards=3)
    shards = out.select("doc_id", "source", F.spark_partition_id().alias("shard"))
    assert rows_of(plan.select("doc_id", "source", "shard")) == rows_of(shards)
    bare = docs.where("doc_id is not null").select("doc_id", "source")
    assert rows_of(mixing.mix_plan(bare)) == rows_of(mixing.mix_plan(docs.where("doc_id is not null").withColumn("more", F.rand(1))))


def brute_plan(hashes, counts, weights, shards, block, seed):
    """The plan by hand: rank each source's hashes, cut blocks, deal them by the tree, shuffle each shard."""
    want = mixing.quotas(counts, weights, 0.5)
    names = sorted(want)
    dealt = np.zeros((shards, len(names)), int)

    def node(lo, hi, here):
        if hi - lo == 1:
            dealt[lo] = here
            return
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(here, int(here.sum()) * (mid - lo) // (hi - lo), method="marginals")
        node(lo, mid, left)
        node(mid, hi, here - left)

    node(0, shards, np.array([-(-want[s] // block) for s in names]))
    out = []
    for j, s in enumerate(names):
        owner = [k for k in range(shards) for _ in range(dealt[k, j])]
        for rank, (_, doc) in enumerate(sorted(hashes[s])[: want[s]]):
            out.append((doc, s[1:], owner[rank // block], rank))
    return out


def test_plan_against_one_made_by_hand(spark, make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(1, 900)])
    key = F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id", F.concat(F.lit("s"), "source")), 1)
    told = docs.select("doc_id", "source", key.alias("key")).collect()
    hashes, counts = {}, Counter(f"s{r.source}" for r in told)
    for r in told:
        hashes.setdefault(f"s{r.source}", []).append((r.key, r.doc_id))
    weights = {"src0": 2, "src1": 1, "src2": 1}
    want = brute_plan(hashes, counts, {f"s{s}": w for s, w in weights.items()}, 5, 8, 5)
    got = mixing.mix_plan(docs, weights=weights, shards=5, block=8, seed=5, bucket=50).collect()
    assert sorted((r.doc_id, r.source, r.shard) for r in got) == sorted(x[:3] for x in want)
    keys = {r.doc_id: r.key for r in told}
    order = spark.createDataFrame([(d, s, k, keys[d], n) for d, s, k, n in want], "doc_id long, source string, shard int, key long, rank long").withColumn("o", F.xxhash64(F.lit(6), "key", "rank"))
    place = {}
    for k in range(5):
        for i, r in enumerate(order.where(F.col("shard") == k).orderBy("o", "doc_id").collect()):
            place[r.doc_id] = i
    assert {r.doc_id: r.position for r in got} == place


def test_shards_and_blocks_grow_with_the_rows(spark, make_docs, monkeypatch):
    docs = make_docs([(i, "t") for i in range(600)])
    monkeypatch.setattr(mixing, "SHARDS", 2)
    monkeypatch.setattr(mixing, "SHARD_ROWS", 50)
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 40)
    plan = mixing.mix_plan(docs, block=1).collect()
    assert len({r.shard for r in plan}) == 12 and len(plan) == 600
    assert max(Counter(r.shard for r in plan).values()) <= 5 * 15
