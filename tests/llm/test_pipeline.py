"""Every stage of the pipeline on its own input, against brute force."""

import os
from itertools import combinations

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_stages(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as P
    from beatframe.llm.pii import base_spans
    from beatframe.llm.quality import quality_scores

    from .test_operators import component, shingles

    docs, columns, seen = P.read(spark, SF, "documents"), None, {}
    for k, (name, stage) in enumerate(P.STAGES):
        columns = columns or docs.columns
        out = P.settle(stage(spark, docs, SF))
        assert k == len(P.STAGES) - 1 or out.columns == columns
        seen[name] = (docs, out)
        docs = out
    before, after = seen["quality"]
    good = {r.doc_id for r in quality_scores(before, P.read(spark, SF, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == good
    before, after = seen["near_dedup"]
    sets = {r.doc_id: shingles(r.text) for r in before.collect()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= P.SIMILAR * len(sets[a] | sets[b])]
    assert {r.doc_id for r in after.collect()} == set(component(links, sets).values())
    before, after = seen["personal_data"]
    assert before.count() == after.count()
    for r in after.collect():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
    before, after = seen["mix_sources"]
    assert after.exceptAll(before).count() == 0
    before, after = seen["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
