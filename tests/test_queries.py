"""Registered queries agree with their SQL checks.

A few run by default; set PAGETIDE_ALL=1 to run every one.
"""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, connect
from pagetide.operators import edits, elements
from pagetide.plans import inputs

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "page_tokens page_elements first_match page_first_card url_distributions keywords masked_text change_feed "
    "state_merge parsed_responses embeds rolling_hour stream_changes element_text table_texts release_records parse_log "
    "image_validation session_report record_quarantine stored_summaries stream_late"
).split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PAGETIDE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_every_query_is_checked_or_listed():
    from pagetide.plans.queries import QUERIES

    assert set(QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_stay_in_the_jvm(spark):
    for name in ("page_first_card", "content_profile", "masked_length", "keywords", "link_validation", "embeds"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_pages_made_of_one_small_file_are_dealt_to_all_tasks(spark, tmp_path):
    rows = spark.range(5000).selectExpr(
        "id AS p_partkey", "concat('part ', id) AS p_name", "'Brand#1' AS p_brand", "'STEEL' AS p_type", "CAST(id % 50 AS INT) AS p_size", "1.0D AS p_retailprice")
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = entry.queries()["element_attributes"](spark, str(tmp_path))
    per_task = made.groupBy(F.spark_partition_id()).agg(F.countDistinct("page_id").alias("n")).collect()
    assert len(per_task) == 4 and sum(r.n for r in per_task) == 5000 and max(r.n for r in per_task) < 2000


def test_rows_that_become_pages_are_dealt_without_holding_a_row_group(spark, tmp_path, monkeypatch):
    """Dealing in turn sorts all rows that a task reads, and so does writing to more tasks than DIRECT_TASKS."""
    rows = spark.range(6000).selectExpr(
        "if(id % 10 = 9, null, id % 4000) AS p_partkey", "concat('part ', id) AS p_name", "'Brand#1' AS p_brand", "'STEEL' AS p_type", "CAST(id % 50 AS INT) AS p_size")
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    read = spark.read.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(inputs, "ROWS_PER_TASK", 10)
    dealt = inputs.dealt_rows(read)
    per_task = dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(per_task) == elements.DIRECT_TASKS and max(r.n for r in per_task) < 90
    assert dealt.columns == read.columns and dealt.exceptAll(read).isEmpty() and read.exceptAll(dealt).isEmpty()
    monkeypatch.undo()
    plan = entry.queries()["listing_elements"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan and plan.count("Exchange hashpartitioning(_dealt") == 1


def test_edits_stay_where_their_pages_were_dealt(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('<nav>a</nav>', repeat('<p>text text text</p>', 400), '<article>', id, '</article>') AS html")
    done = edits.edit_pages(pages, [edits.Edit("remove", "nav"), edits.Edit("modify", "article", attributes={"k": "1"})])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    per_task = done.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(per_task) >= 6 and sum(r.n for r in per_task) == 3000
    assert done.where("page_id = 5").first().html.endswith('<article k="1">5</article>')


DEALT_BY_SIZE = (
    "publish_dates",
    "page_outline",
    "release_records",
    "card_rejects",
    "card_titles",
    "selector_rates",
    "parse_log",
    "listing_cards",
    "operation_metrics",
    "card_urls",
    "image_urls",
    "match_confidence",
    "element_children",
    "grid_containers",
    "page_links",
    "listing_elements",
    "page_structure",
)


@pytest.mark.parametrize("name", DEALT_BY_SIZE)
def test_windows_run_where_pages_were_dealt_by_size(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    by_page = [line for line in plan.splitlines() if "Exchange hashpartitioning(page_id" in line]
    assert by_page and all("REPARTITION_BY_NUM" in line for line in by_page)


@pytest.mark.parametrize("name", ("selector_rates", "parse_log", "operation_metrics"))
def test_no_filter_works_out_the_parse_log_again(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-*(0123456789)").startswith("Filter ")]
    assert filters and not any("lambdafunction" in line for line in filters)
