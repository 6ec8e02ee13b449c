from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagemill.fixed_values import REQUEST_CATEGORIES
from pagemill.functions.draws import draw_u32
from pagemill.operators.numbering import first_by_draw, global_row_number, position_cutoffs
from pagemill.operators.routing import route_categories

KEYS = {
    "dense": list(range(5000)),
    "sparse": [i * i * 7919 - 10**9 for i in range(5000)],
    "read ids": [(p << 33) + i for p in range(7) for i in range(300)],
    "one far out": [*range(3000), 2**62],
    "ends of the range": [-(2**62), -1, 0, 1, 2**62],
    "single": [42],
}


@pytest.mark.parametrize("name", KEYS)
def test_position_cutoffs(spark, name):
    keys = sorted(KEYS[name])
    shuffled = random.Random(0).sample(keys, len(keys))
    df = spark.createDataFrame([(k,) for k in shuffled], "seq bigint")
    n = len(keys)
    positions = [0, n // 3, n // 2, n - 1, n]
    assert position_cutoffs(df, "seq", lambda rows: positions) == [*(keys[p] for p in positions[:-1]), None]


def test_position_cutoffs_without_rows(spark):
    assert position_cutoffs(spark.createDataFrame([], "seq bigint"), "seq", lambda n: [0]) == [None]


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 11, 12, 100])
def test_slices_are_disjoint_and_cover_all_rows(spark, n):
    df = spark.createDataFrame([(i * 3 + 5,) for i in range(n)], "seq bigint").repartition(3)
    got = [r.category for r in route_categories(df).orderBy("seq").collect()]
    k = n // 6
    want = [c for c, size in zip(REQUEST_CATEGORIES, (2 * k, 2 * k, k, n - 5 * k)) for _ in range(size)]
    assert got == want


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_global_row_number_with_a_hot_leading_value(spark, partitions):
    data = [("hot" if i % 3 else f"cold{i % 50}", i) for i in range(3000)]
    random.Random(3).shuffle(data)
    df = spark.createDataFrame(data, "name string, seq bigint").repartition(partitions)
    got = [(r.name, r.seq) for r in global_row_number(df, ["name", "seq"]).orderBy("position").collect()]
    assert got == sorted(data)
    assert global_row_number(df, ["name", "seq"]).agg(F.max("position")).first()[0] == len(data) - 1


@pytest.mark.parametrize("quota", [0, 1, 777, 5000, 9000])
def test_first_by_draw_equals_sort_and_limit(spark, quota):
    df = spark.range(5000).withColumnRenamed("id", "seq")
    want = df.orderBy(draw_u32("s", F.col("seq")), "seq").limit(quota).collect()
    got = first_by_draw(df, "s", "seq", quota).orderBy("position").collect()
    assert [r.seq for r in got] == [r.seq for r in want]
    assert [r.position for r in got] == list(range(min(quota, 5000)))
