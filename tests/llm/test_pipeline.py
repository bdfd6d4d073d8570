import collections
import os

import pytest

import corpus_pipeline
from chronofold.llm import shared, shingle_overlap, simhash

from .conftest import edge_rows

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "no document holds this sentence, which is long enough"), (2, None), (None, "nor this one")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


@pytest.mark.parametrize("name", STAGES)
def test_stages_take_edge_cases(spark, edge_docs, clashing_docs, no_docs, folder, name):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns; the same rows whatever the other columns."""
    rows = lambda df: sorted(map(str, df.collect()))
    out = STAGES[name](spark, clashing_docs, folder)
    plain = STAGES[name](spark, edge_docs, folder)
    if name == "token-output":
        assert rows(out) == rows(plain) and plain.count() == len(edge_rows())
    else:
        assert out.columns == clashing_docs.columns and plain.columns == edge_docs.columns
        assert rows(out.select(edge_docs.columns)) == rows(plain) and plain.count() > 0
    assert STAGES[name](spark, no_docs, folder).count() == 0


def test_one_row_of_each_component_stays(spark, edge_docs):
    members = collections.Counter(r.component for r in shingle_overlap.near_copies(edge_docs).collect())
    kept = shared.written(shingle_overlap.keep_one(edge_docs), "test-kept")
    assert kept.count() == edge_docs.count() - sum(members.values()) + len(members)
    assert set(collections.Counter(r.component for r in shingle_overlap.near_copies(kept).collect()).values()) <= {1}
    by_id = collections.Counter(r.doc_id for r in kept.collect())
    assert by_id[7] <= 1 and by_id[None] == 1  # repeated rows; of the rows without id one has a text of its own


def test_rows_that_share_an_id_are_told_apart(spark, edge_docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, "en"), (1, b, "en"), (2, a, "fr"), (3, b, "fr"), (None, a, "de"), (1, a, "de"), (1, a, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    first = [sorted(map(str, shingle_overlap.keep_one(docs).collect())) for _ in range(2)]
    assert first[0] == first[1] and sorted((r.doc_id, r.text) for r in shingle_overlap.keep_one(docs).collect()) == [(1, a), (1, b)]


def test_run_is_the_stages_in_a_row(spark, edge_docs, no_docs, folder):
    for docs in (edge_docs, no_docs):
        docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        seen = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            seen = shared.written(stage(spark, seen, folder), "test-stage")
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(corpus_pipeline.run(spark, folder)) == rows(seen)
    assert os.listdir(folder)


def test_simhash_ignores_other_columns(edge_docs, clashing_docs):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(simhash.near_dedup(clashing_docs)) == rows(simhash.near_dedup(edge_docs))
