from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pagemill import fixtures
from pagemill.operators import selection
from pagemill.operators.filters import filter_report, filter_special_pattern
from pagemill.plans import mix
from pagemill.plans.mix import assemble, build_mix, number_mix
from pagemill.session import materialize

SF_DIR = "/root/testdata/sf0.001"


def shuffled(seqs, salt):
    return sorted(seqs, key=lambda s: (int(hashlib.md5(f"{salt}:{s}".encode()).hexdigest()[:8], 16), s))


def skewed(spark):
    """WI and WR rows; one page has a third of all rows."""
    data = [
        ("WI" if i % 3 else "WR", i, "hot" if i % 5 in (0, 2) else f"page{i % 97}") for i in range(600)
    ]
    return data, spark.createDataFrame(data, "pool string, seq bigint, page string")


@pytest.mark.parametrize("wi_quota, wr_quota", [(20, 10), (5, 400), (400, 1), (0, 10), (1000, 1000)])
def test_properties_of_the_selection(spark, wi_quota, wr_quota):
    data, df = skewed(spark)
    page = {seq: p for _, seq, p in data}
    place = {
        pool: {s: n for n, s in enumerate(shuffled([s for q, s, _ in data if q == pool], f"shuffle_{pool.lower()}"))}
        for pool in ("WI", "WR")
    }
    wi, wr = selection.select_mix(df, wi_quota, wr_quota)
    wi_rows, wr_rows = ([r.seq for r in pool.orderBy("position").collect()] for pool in (wi, wr))
    # WI: the first ones of the draw. WR: in the order of the draw, within the quota.
    assert [place["WI"][s] for s in wi_rows] == list(range(min(wi_quota, len(place["WI"]))))
    assert [place["WR"][s] for s in wr_rows] == sorted(place["WR"][s] for s in wr_rows) and len(wr_rows) <= wr_quota
    # Every WR page once, and none of WI.
    wi_pages, wr_pages = {page[s] for s in wi_rows}, {page[s]: place["WR"][s] for s in wr_rows}
    assert len(wr_pages) == len(wr_rows) and not wi_pages & wr_pages.keys()
    # What was left out has a page that was taken before it, or comes after the quota was full.
    full = max(wr_pages.values()) if len(wr_rows) == wr_quota else len(data)
    for s in place["WR"].keys() - set(wr_rows):
        assert page[s] in wi_pages or wr_pages.get(page[s], len(data)) < place["WR"][s] or place["WR"][s] > full
    numbers = [r.number for r in number_mix(wi, wr).orderBy("number").collect()]
    assert numbers == list(range(len(wi_rows) + len(wr_rows)))


def test_page_key_is_a_digest_of_the_whole_page(spark):
    pages = ["", "x" * 100_000, "x" * 99_999 + "y"]
    df = spark.createDataFrame([(p,) for p in pages], "webpage string")
    got = [bytes(r[0]) for r in df.select(selection.page_key(F.col("webpage"))).collect()]
    assert got == [hashlib.sha256(p.encode()).digest() for p in pages]


def test_final_pages_never_overlap(spark):
    pairs = fixtures.pairs(spark, SF_DIR)
    page = {r.seq: r.webpage for r in filter_special_pattern(pairs).select("seq", "webpage").collect()}
    keys = filter_special_pattern(pairs).select("pool", "seq", selection.page_key(F.col("webpage")).alias("page"))
    wi, wr = selection.select_mix(keys, 40, 20)
    wi_pages = {page[r.seq] for r in wi.collect()}
    wr_pages = [page[r.seq] for r in wr.collect()]
    assert len(set(wr_pages)) == len(wr_pages) == 20 and not wi_pages & set(wr_pages)


@pytest.fixture(scope="module")
def whole(spark):
    return build_mix(fixtures.pairs(spark, SF_DIR), 40, 20).orderBy("number").collect()


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_mix_does_not_depend_on_partitions(spark, whole, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pairs = fixtures.pairs(spark, SF_DIR).repartition(partitions)
        assert build_mix(pairs, 40, 20).orderBy("number").collect() == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.prompt_id for r in whole] == [f"web_data_{i}" for i in range(60)]


def test_save_num_cuts_the_last_rows_and_counts_are_reported(spark, whole):
    pairs, report = fixtures.pairs(spark, SF_DIR), Observation()
    assert build_mix(pairs, 40, 20, save_num=45, report=report).orderBy("number").collect() == whole[:45]
    want = {}
    for row in filter_report(pairs).collect():
        want |= {f"{row.pool}_total": row.total, f"{row.pool}_deleted": row.deleted}
    assert report.get == want


def test_mix_without_wi_rows_is_numbered_from_zero(spark):
    pairs = fixtures.pairs(spark, SF_DIR).filter("pool = 'WR'")
    got = build_mix(pairs, 40, 5).orderBy("number").collect()
    assert [r.prompt_id for r in got] == [f"web_data_{i}" for i in range(5)]


def test_mix_of_nothing(spark):
    assert build_mix(fixtures.pairs(spark, SF_DIR).limit(0), 40, 20).count() == 0


def test_more_ids_than_a_broadcast_holds_are_joined_range_by_range(spark, monkeypatch):
    pairs = fixtures.pairs(spark, SF_DIR)
    ids = [(pool, seq, n) for n, (pool, seq) in enumerate((p, s) for p in ("WI", "WR") for s in range(3, 200, 7))]
    numbered = spark.createDataFrame(ids, "pool string, seq bigint, number bigint")
    whole = assemble(pairs, numbered, len(ids)).orderBy("number").collect()
    jobs = []

    def recorded(df, name):
        jobs.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    monkeypatch.setattr(mix, "materialize", recorded)
    assert assemble(pairs, numbered, len(ids), most=10).orderBy("number").collect() == whole and whole
    jobs.clear()
    documents = fixtures.documents(spark, SF_DIR).select(
        F.lit("WI").alias("pool"), F.col("doc_id").alias("seq"), *[F.col("text").alias(c) for c in ("webpage", "request", "response")]
    )
    plan = assemble(documents, numbered, len(ids), most=10)._jdf.queryExecution().executedPlan().toString()
    # A job for each range with the ids of that range, and none for all of them.
    assert len(jobs) == 3 and all(job.count("BroadcastExchange") == 1 and "Exchange hash" not in job for job in jobs)
    assert "Join" not in plan


def test_the_draw_is_bounded_by_the_quota(spark, monkeypatch):
    """Rows far behind the quota are not grouped; hot pages ask for a second round."""
    rows = [(i, f"hot{i % 2}" if i % 10 else f"page{i}") for i in range(4_000)]
    wr = spark.createDataFrame(rows, "seq bigint, page string")
    used = spark.createDataFrame([("hot0",), ("page20",)], "page string")
    seen = []
    grouped = selection.first_per_page

    def counted(df, salt, key="seq"):
        seen.append(df.count())
        return grouped(df, salt, key)

    monkeypatch.setattr(selection, "first_per_page", counted)
    everything = selection.quota_sample(selection.unused_pages(grouped(wr, "s"), used, 2), "s", 4_000).orderBy("position").collect()
    for quota in (1, 40, 300, 401, 4_000):
        seen.clear()
        got = selection.select_unused(wr, used, 2, "s", quota).orderBy("position").collect()
        assert [(r.page, r.seq, r.position) for r in got] == [(r.page, r.seq, r.position) for r in everything[:quota]]
        if quota == 40:
            assert len(seen) > 1 and seen[0] < 100 and seen[-1] < 1_000
    assert selection.select_unused(wr.limit(0), used, 2, "s", 5).count() == 0


def test_more_pages_than_a_broadcast_holds_go_through_a_bit_map(spark):
    df = spark.range(3_000).select(F.col("id").alias("seq"), selection.page_key(F.col("id").cast("string")).alias("page"))
    used = df.filter("seq % 5 = 0 and seq < 1000").select("page")
    wanted = {r.seq for r in selection.unused_pages(df, used, 200).collect()}
    far = selection.unused_pages(df, used, 200, most=0)
    assert {r.seq for r in far.collect()} == wanted and far.count() == len(wanted) == 2_800
    met = {r.seq for r in selection.pages_met(df, used, 200).filter("_met").collect()}
    # All used ones are looked at, and of the others a sixteenth at most.
    assert met >= {s for s in range(0, 1_000, 5)} and len(met) < 200 + 3_000 // 16
    plan = selection.pages_met(df, used, 200)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
    few = spark.createDataFrame([], "page binary")
    assert selection.unused_pages(df, few, 10**9, most=0).count() == 3_000


def test_page_numbers_are_the_page_key(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("webpage"))
    numbers = df.select("webpage", *selection.page_numbers(F.col("webpage"))).select("webpage", selection.page_of_numbers().alias("page"))
    assert numbers.filter(F.col("page") != selection.page_key(F.col("webpage"))).count() == 0 and numbers.filter("page is null").count() == 0


def test_page_text_is_scanned_but_not_shuffled_at_the_end(spark):
    """The one join that carries text takes its other side by broadcast."""
    pairs = fixtures.documents(spark, SF_DIR).select(
        F.lit("WI").alias("pool"),
        F.col("doc_id").alias("seq"),
        F.col("text").alias("webpage"),
        F.col("text").alias("request"),
        F.col("text").alias("response"),
    )
    plan = build_mix(pairs, 40, 20)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
