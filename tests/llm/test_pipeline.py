"""The pipeline's stages, each on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from test_jaccard import brute
from test_rules import base_rules
from test_texts import contaminated

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    columns = docs.columns
    bench = corpus_pipeline.table(spark, SF, "benchmark").collect()
    at = docs.collect()
    for k, (name, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs = at, corpus_pipeline.stage(step(spark, docs, SF), "test")
        assert docs.columns == columns
        at = docs.collect()
        rows, was = Counter(map(tuple, at)), Counter(map(tuple, before))
        if k == 0:
            good = {r["doc_id"] for r in before if (b := base_rules(r["text"]))[0] >= 50 and 2 * b[4] <= b[0]}
            assert {r["doc_id"] for r in at} == good and not rows - was
        elif k == 1:
            groups, _ = brute(before)
            assert {r["doc_id"] for r in at} == {r["doc_id"] for r, g in zip(before, groups) if g[1] in (None, r["doc_id"])}
            assert not rows - was and len(at) < len(before)
        elif k == 2:
            dirty = {d for d, *_, hit in contaminated(before, bench) if hit}
            assert dirty and not any(hit for *_, hit in contaminated(at, bench))
            assert {tuple(r) for r in before if r["doc_id"] not in dirty} <= set(rows)
        else:
            assert set(rows) <= set(was) and max(rows.values()) <= 2
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in at)
    again = corpus_pipeline.pipeline(spark, SF).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near duplicates", "decontamination", "source mix", "token files"]
