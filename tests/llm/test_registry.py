import corpus_pipeline
import pytest
from compare import compare, connect
from helpers import documents, empty_documents

import __spark_entry__ as entry
from pagetide.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", ["op5_mixing", "op10_secrets"])
def test_native_operators_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_stages_keep_columns_and_bear_awkward_rows(spark):
    for docs in (documents(spark), empty_documents(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert {"doc_id", "shard", "slot", "size"} <= set(out.columns)
        out.count()


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    all_ids = ids(docs)
    kept = ids(corpus_pipeline.one_of_each(spark, docs, SF))
    classes = {r.doc_id: r.component_id for r in QUERIES["op7_jaccard"](spark, SF).collect()}
    assert sorted(kept) == sorted(set(classes.values()))
    leaky = {r.doc_id for r in QUERIES["op2_contamination"](spark, SF).collect()}
    assert sorted(ids(corpus_pipeline.clean_documents(spark, docs, SF))) == sorted(set(all_ids) - leaky) and leaky
    good = {r.doc_id for r in QUERIES["op3_quality"](spark, SF).collect() if r.predicted}
    assert sorted(ids(corpus_pipeline.good_documents(spark, docs, SF))) == sorted(good)
