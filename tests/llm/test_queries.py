"""Registered queries of the training-data operators: SQL parity, contracts and the pipeline."""

import pytest

import __spark_entry__ as E
import corpus_pipeline
from eventide.llm.queries import ORACLE, QUERIES
from parity import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    r = compare(spark, name, QUERIES[name], ORACLE[name], SF, duck(SF))
    assert r["schema_match"] and r["rows_match"] and r["value_match"], r


def test_entry_lists_all_operators_and_the_pipeline():
    names = E.queries()
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, len(QUERIES) + 1)] and set(QUERIES) | {"pipeline"} <= set(names)


def test_pipeline_stages(spark):
    """Each stage works on what its predecessor kept, and its decisions take effect."""
    from eventide.llm import ngram_join, outliers, packing, toxicity
    from eventide.llm.common import read_table, written
    assert len(corpus_pipeline.STAGES) == 5
    docs = read_table(spark, SF, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], SF), name))
        assert kept[-1].columns == docs.columns
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] > ids[1] >= ids[2] >= ids[3] >= ids[4] and ids[4]
    good = {r.doc_id for r in outliers.quality(kept[0]).collect() if r.kept}
    assert ids[1] == good
    clean = {r.doc_id for r in toxicity.toxicity(kept[1], read_table(spark, SF, "labels")).collect() if r.predicted == 0}
    assert ids[2] == clean
    firsts = {r.component_id for r in ngram_join.near_duplicates(kept[2]).collect()}
    assert ids[3] == firsts
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == whole[r.doc_id] for r in kept[4].collect())
    name, last = corpus_pipeline.STAGES[-1]
    out = last(spark, kept[4], SF)
    assert out.where("piece = 0").count() == kept[4].count()
    total = corpus_pipeline.run(spark, SF)
    assert total.agg({"length": "sum"}).first()[0] == out.agg({"length": "sum"}).first()[0]
    assert packing.MAX_TOKENS == 2048
