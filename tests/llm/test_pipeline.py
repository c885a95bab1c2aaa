"""The pipeline's stages on a small corpus, and on odd tables."""

from collections import Counter

import pytest
from test_operators import DOCS, ODD, slow_containment

import corpus_pipeline
from rootloom.llm import packing, pii, quality, simhash_golay

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage on all that the one before kept, held against what its operator says of each row."""
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        before = {r.doc_id: r for r in docs.collect()}
        after = {r.doc_id: r for r in out.collect()} if k < 4 else None
        if name == "quality":
            assert set(after) == {r.doc_id for r in quality.query(docs, labels).filter("predicted = 1").collect()}
        elif name == "near_duplicates":
            groups = {}
            for r in simhash_golay.near_copies_roots(docs).collect():
                groups.setdefault(r.root, []).append(r.doc_id)
            assert set(after) == {min(g) for g in groups.values()}
        elif name == "decontamination":
            bad = {d for d, _ in slow_containment([(r.doc_id, r.text) for r in before.values()], [(r.item_id, r.text) for r in items.collect()])}
            assert set(after) == set(before) - bad and bad
        elif name == "pii":
            spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
            assert set(after) == set(before) and any(spans.values())
            assert all((after[i].text == before[i].text) == (not spans[i]) and after[i].n_chars == len(after[i].text) for i in after)
        else:
            assert Counter(tuple(r)[:5] for r in out.collect()) == Counter(tuple(r) for r in packing.pieces(docs).collect())
        if k < 4:
            assert out.columns == start.columns, name
            docs = out


@pytest.mark.parametrize("empty", [False, True])
def test_odd_and_empty_input(spark, tmp_path, empty):
    rows = [] if empty else [*ODD, (None, "another text of its own here", "en", "s", 28), (3, "a second text under the id three", "en", "s", 32)]
    spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' AS _doc", "'clash' AS th", "'clash' AS score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else [(None, "another text of its own here"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    # no labels: all are kept; copies and null texts fold; the item's row goes, and no other row without an id
    want = [] if empty else [1, 3, 3, 5, 6, 7]
    assert sorted(r.doc_id for r in out if r.piece == 0) == want
