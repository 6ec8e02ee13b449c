"""Physical plans: what is shuffled, what is read, what runs in Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pagemill.backends import stub
from pagemill.functions import text
from pagemill.functions.messages import request_prompt
from pagemill.operators import completions, neardup, numbering, selection
from pagemill.operators.filters import filter_special_pattern
from pagemill.operators.routing import route_categories
from pagemill.sources.stages import write_bucketed


@pytest.fixture(scope="module")
def pool(spark, tmp_path_factory):
    """A pool table as the stages write it, with automatic broadcasts off."""
    path = str(tmp_path_factory.mktemp("pool") / "table")
    words = [F.concat(F.lit(c), F.col("id")).alias(c) for c in ("webpage", "author", "request", "response")]
    pool = F.when(F.col("id") % 3 < 2, "WI").otherwise("WR").alias("pool")
    spark.range(100).select(pool, F.col("id").alias("seq"), *words).write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def shuffled_columns(plan: str) -> set[str]:
    found = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    return {re.sub(r"#\d+L?", "", c) for columns in found for c in columns.split(", ")}


def read_columns(plan: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<(.*)>", plan)]


def test_signatures_shuffle_hashes_and_no_text(pool):
    rows = filter_special_pattern(pool).withColumn("page", selection.page_key(F.col("webpage")))
    plan = formatted(neardup.collapse_equal_signatures(rows, carry=["page"]))
    assert plan.count("ArrowEvalPython (") == 1
    assert plan.count(") Exchange\n") == 1
    assert not shuffled_columns(plan) & {"request", "response", "webpage", "author"}
    assert read_columns(plan) == [{"pool", "seq", "webpage", "request", "response"}]
    # Combined before the shuffle: a group of equal texts is one row per task.
    assert "partial_min(seq" in plan.split(") Exchange\n")[0]


def test_routing_and_cutting_need_no_shuffle(pool):
    plan = formatted(text.cut_sections(route_categories(pool)).select("seq", "category", "webpage"))
    assert "Exchange" not in plan and read_columns(plan) == [{"seq", "webpage"}]


def test_prompt_reads_only_its_columns_in_one_generated_stage(pool):
    prompt = request_prompt("WR_all", F.col("webpage"), F.col("author"), F.col("seq"))
    plan = formatted(pool.select("seq", prompt.alias("prompt")))
    assert read_columns(plan) == [{"seq", "webpage", "author"}]
    assert "Project [codegen id" in plan and "Exchange" not in plan


def test_filter_reaches_the_scan(pool):
    plan = formatted(filter_special_pattern(pool.filter("pool = 'WI'")).select("seq"))
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan)[1]
    for part in ("EqualTo(pool,WI)", "IsNotNull(request)", "Not(EqualTo(response,))", "StringStartsWith(response,I'm sorry)"):
        assert part in pushed


def test_generation_runs_once_and_sends_only_the_prompt(pool):
    answered = completions.generate(pool, F.col("request"), stub, wait=(0, 0))
    plan = formatted(completions.succeeded(answered).select("seq", "webpage", "completion", "attempts"))
    assert plan.count("ArrowEvalPython (") == 1 and "Exchange" not in plan
    # The prompt and its hash, and no other column.
    assert re.search(r"Arguments: \[call\(request#\d+, sha2\(cast\(request#\d+ as binary\), 256\), null, null\)", plan)


def test_quota_filters_before_its_shuffle(pool):
    keys = pool.select("seq", selection.page_key(F.col("webpage")).alias("page"))
    plan = formatted(numbering.first_by_draw(keys, "s", "seq", 10))
    # The offsets are broadcast, so rows beyond the quota's prefixes stop at the join.
    assert "BroadcastHashJoin Inner" in plan and "SortMergeJoin" not in plan
    assert not shuffled_columns(plan) & {"webpage", "request"}


def test_first_per_page_combines_before_the_shuffle(pool):
    keys = pool.select("seq", selection.page_key(F.col("webpage")).alias("page"))
    plan = formatted(selection.first_per_page(keys, "s"))
    assert "partial_min(" in plan.split(") Exchange\n")[0] and "Window" not in plan
    assert shuffled_columns(plan) == {"page", "min"}
    assert "HashAggregate" in plan and "SortAggregate" not in plan and ") Sort" not in plan


def test_equal_signatures_aggregate_by_hash(pool):
    for carry in ((), selection.PAGE_NUMBERS):  # the mix carries the page
        rows = pool.select("pool", "seq", "request", *selection.page_numbers(F.col("webpage")))
        plan = formatted(neardup.collapse_equal_signatures(rows, carry=carry))
        assert "HashAggregate" in plan and "SortAggregate" not in plan and ") Sort" not in plan


def test_first_per_page_is_exact_at_the_ends_of_bigint(spark):
    keys = [-(1 << 63), -1, 0, (1 << 63) - 1]
    df = spark.createDataFrame([(bytes([k]), key) for k, key in enumerate(keys)], "page binary, seq bigint")
    assert sorted(row["seq"] for row in selection.first_per_page(df, "s").collect()) == keys


def test_bucketed_tables_join_without_a_shuffle(spark, pool, tmp_path):
    done = pool.filter("seq % 10 <> 9").select("seq", F.upper("request").alias("completion"))
    pages = write_bucketed(pool, "bucketed_pages", str(tmp_path / "pages"), 4)
    replies = write_bucketed(done, "bucketed_replies", str(tmp_path / "replies"), 4)
    try:
        for joined in (
            completions.attach_completions(pages, replies, ["seq"]),
            completions.pending_rows(pages, replies, ["seq"]),
        ):
            plan = formatted(joined)
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert completions.attach_completions(pages, replies, ["seq"]).filter("completion IS NULL").count() == 10
        assert completions.pending_rows(pages, replies, ["seq"]).count() == 10
    finally:
        spark.sql("DROP TABLE bucketed_pages")
        spark.sql("DROP TABLE bucketed_replies")
