"""Each stage of the pipeline against brute force over its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from themeloom.llm import quality
from themeloom.llm.common import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    scratch = Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.write(stage(spark, docs, SF))
        out.append((name, docs.collect(), after.collect(), docs.schema, after.schema))
        docs = after
    return out


def test_all_but_the_last_return_documents(stages):
    assert [s[0] for s in stages] == ["quality classifier", "exact dedup", "near dedup", "mix sources", "byte-level BPE"]
    for _, _, _, before, after in stages[:-1]:
        assert [(f.name, f.dataType) for f in before] == [(f.name, f.dataType) for f in after]


def test_quality_drops_what_the_classifier_rejects(spark, stages):
    _, before, after, _, _ = stages[0]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).where("kept").collect()}
    assert {r.doc_id for r in after} == kept and 0 < len(after) < len(before)


def test_exact_keeps_the_least_id_of_each_text(stages):
    _, before, after, _, _ = stages[1]
    best = {}
    for r in before:
        best[r.text] = min(best.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())


def test_near_keeps_one_of_each_group_and_all_that_are_alone(stages):
    from test_minhash import jaccard, roots, shingle_set

    _, before, after, _, _ = stages[2]
    sets = {r.doc_id: shingle_set(r.text) for r in before}
    ids = sorted(sets)
    sims = {(i, j): s for i in ids for j in ids if i < j and (s := jaccard(sets[i], sets[j])) >= 0.3}
    loose, strict = roots([p for p, s in sims.items() if s >= 0.45], ids), roots([p for p, s in sims.items() if s >= 0.75], ids)
    kept = {r.doc_id for r in after}
    assert set(loose.values()) <= kept
    assert max(Counter(strict[i] for i in kept).values()) == 1


def test_mix_meets_its_quotas(stages):
    from themeloom.llm.mixing import quotas

    _, before, after, _, _ = stages[3]
    assert Counter(r.source for r in after) == quotas(Counter(r.source for r in before), None, 0.5)
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len({r.doc_id for r in after}) == len(after)


def test_encode_is_a_round_trip_of_all(spark, stages):
    _, before, after, _, _ = stages[4]
    assert {r.doc_id for r in after} == {r.doc_id for r in before} and all(r.round_trip for r in after)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in after)
