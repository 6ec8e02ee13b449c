"""Near-duplicate removal against literal copies of its rule."""

from __future__ import annotations

import random
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.fixed_values import BEGIN_OF_TEXT
from pagemill.functions.text import UNSPACED, token_set
from pagemill.operators import minhash, neardup
from pagemill.operators.lsh_index import BandIndex



def tokens_of(text):
    """Tokens by the rule, character by character."""
    found, last = [], None
    for c in text:
        if any(low <= ord(c) <= high for low, high in UNSPACED):
            kind = "alone"
        elif c.isspace():
            kind = "space"
        else:
            kind = "word" if c == "_" or unicodedata.category(c)[0] in "LMN" else "other"
        if kind == last and kind not in ("alone", "space"):
            found[-1] += c
        elif kind != "space":
            found.append(c)
        last = kind
    return found


def literal_signature(tokens, a, b):
    out = np.full(len(a), minhash.PRIME, dtype=np.int64)
    for token in tokens:
        g = 0
        for byte in token.encode():
            g = (g * minhash.BASE + byte + 1) % minhash.PRIME
        h = pow(g, 5, minhash.PRIME)
        out = np.minimum(out, (a * h + b) % minhash.PRIME)
    return out.tolist()


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.text(alphabet=st.sampled_from("ab_9 .,\n\t\x0b\x1d\xa0éß漢字倀กの、　\u0301\U0001f600\U00020001\x00"), max_size=60), max_size=8),
    st.sampled_from([1, 4, 16, 1 << 17]),
)
def test_signature_of_bytes_equals_signature_of_tokens(texts, piece):
    a, b = minhash.permutations(18)
    want = [literal_signature([*tokens_of(t), BEGIN_OF_TEXT], a, b) for t in texts]
    whole, minhash.PIECE_BYTES = minhash.PIECE_BYTES, piece
    try:
        array = pa.array(["skipped", *texts], pa.string()).slice(1)
        assert minhash._sign_texts(array, a, b).to_pylist() == want
        lists = pa.array([[*tokens_of(t), BEGIN_OF_TEXT, ""] for t in texts], pa.list_(pa.string()))
        assert minhash._sign_token_lists(lists, a, b).to_pylist() == want
    finally:
        minhash.PIECE_BYTES = whole


def test_token_columns_follow_the_rule(spark):
    texts = ["", "don't, caf\u00e9 cafe\u0301", "他是学生。ok学生", "กข ฯabc", "\u3000の\xa0アx_1!?", "Привет, мир\x1d٣٤", "a\U0001f600\U00020001b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", token_set(F.col("text")).alias("tokens"))
    for row in rows.collect():
        assert set(row["tokens"]) == {*tokens_of(row["text"]), BEGIN_OF_TEXT}


def test_requests_without_spaces_that_differ_in_one_character_are_near_duplicates(spark):
    draw = random.Random(5)
    requests = ["".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(40)) for _ in range(6)]
    changed = [r[:20] + "一" + r[21:] for r in requests]
    rows = [("WI", n, r, r) for n, r in enumerate([*requests, *changed])]
    df = spark.createDataFrame(rows, "pool string, seq bigint, request string, response string")
    agree = minhash._sign_texts(pa.array([requests[0], changed[0]]), *minhash.permutations()).to_pylist()
    assert np.mean(np.array(agree[0]) == np.array(agree[1])) > 0.9
    assert sorted(r["seq"] for r in neardup.surviving_rows(df).collect()) == list(range(6))


def test_long_texts_without_spaces_are_cut_between_characters():
    text = "".join(chr(0x4E00 + k % 20_000) for k in range(200_000))
    bounds = np.array([0, 600_000])
    pieces = list(minhash._pieces(np.frombuffer(text.encode(), dtype=np.uint8), bounds, minhash._safe_cuts()))
    assert max(b - a for a, b in pieces) <= minhash.PIECE_BYTES and len(pieces) > 4


def test_one_very_long_text_is_signed_whole():
    a, b = minhash.permutations(8)
    words = [f"w{i}" for i in range(150_000)] + ["x" * 700_000]
    got = minhash._sign_texts(pa.array([" ".join(words), "short"]), a, b).to_pylist()
    assert got[0] == literal_signature([*words, BEGIN_OF_TEXT], a, b)
    assert got[1] == literal_signature(["short", BEGIN_OF_TEXT], a, b)


def test_permutations_and_shape():
    a, b = minhash.permutations()
    assert len(set(a.tolist())) == len(set(b.tolist())) == 128 and a.min() > 0
    assert minhash.band_shape(0.7, 128) == (14, 9)


def test_collision_rate_follows_jaccard(spark):
    """Share of equal signature values estimates the Jaccard similarity."""
    a, b = minhash.permutations(128)
    rng = random.Random(1)
    estimates = []
    for _ in range(40):
        shared, left, right = ([f"t{rng.randrange(10**9)}" for _ in range(n)] for n in (70, 15, 15))
        x, y = (np.array(literal_signature(shared + own, a, b)) for own in (left, right))
        estimates.append((x == y).mean())
    assert abs(np.mean(estimates) - 0.7) < 0.03


def literal_removed(table):
    """Look every row up; all of its candidates but the first go."""
    members = defaultdict(set)
    for idx, *bucket in table:
        members[tuple(bucket)].add(idx)
    candidates = defaultdict(set)
    for group in members.values():
        for idx in group:
            candidates[idx] |= group
    removed = set()
    for group in candidates.values():
        removed |= set(sorted(group)[1:])
    return removed


@pytest.mark.parametrize("seed, keys, split", [(1, 12, 3), (2, 60, 2), (3, 250, 200_000), (4, 2, 10)])
def test_two_hop_rule_on_random_buckets(spark, seed, keys, split):
    rng = random.Random(seed)
    # A third of all rows share one bucket.
    table = [(i, band, 0 if rng.random() < 1 / 3 else rng.randrange(keys)) for i in range(200) for band in range(3)]
    df = spark.createDataFrame(table, "idx bigint, band int, key bigint")
    got = {r.idx for r in neardup.two_hop_removed(df, "idx", ["band", "key"], split).collect()}
    assert got == literal_removed(table)


def test_hot_list_stays_within_the_broadcast_bound(spark, monkeypatch):
    """With room for three hot buckets, shards grow until no more are hot."""
    monkeypatch.setattr(neardup, "MAX_BROADCAST_ROWS", 3)
    table = [(i, band, i % 7) for i in range(140) for band in range(3)]
    df = spark.createDataFrame(table, "idx bigint, band int, key bigint")
    edges = neardup.shared_buckets(df, "idx", ["band", "key"], 2)
    assert edges.filter("_shards > 1").select("band", "key").distinct().count() <= 3
    assert {r.idx for r in neardup.two_hop_removed(df, "idx", ["band", "key"], 2).collect()} == literal_removed(table)


def test_two_hops_are_needed(spark):
    table = [(0, 0, 0), (2, 0, 0), (1, 1, 0), (2, 1, 0), (9, 2, 5)]
    df = spark.createDataFrame(table, "idx bigint, band int, key bigint")
    assert {r.idx for r in neardup.two_hop_removed(df, "idx", ["band", "key"]).collect()} == {1, 2}


def requests(spark):
    rng = random.Random(7)
    texts = []
    for i in range(240):
        words = [f"w{(i // 4) * 100 + j}" for j in range(40)]
        if i % 3 == 0:
            texts.append("the same words in a third of all rows")
        elif i % 3 == 1:
            texts.append(" ".join(words))
        else:
            words[rng.randrange(40)] = f"x{i}"
            texts.append(" ".join(words))
    data = [("WI" if i % 2 else "WR", i, t) for i, t in enumerate(texts)]
    return data, spark.createDataFrame(data, "pool string, seq bigint, request string")


def literal_survivors(data):
    a, b = minhash.permutations()
    survivors = set()
    for pool in ("WI", "WR"):
        table = []
        for owner, seq, request in data:
            if owner == pool:
                sig = literal_signature([*tokens_of(request), BEGIN_OF_TEXT], a, b)
                table += [(seq, band, tuple(sig[band * 9 : band * 9 + 9])) for band in range(14)]
        survivors |= {seq for seq, *_ in table} - literal_removed(table)
    return survivors


@pytest.mark.parametrize("split", [3, 200_000])
def test_surviving_rows(spark, split):
    data, df = requests(spark)
    want = literal_survivors(data)
    got = neardup.surviving_rows(df, split=split).collect()
    assert {r.seq for r in got} == want and len(got) == len(want) < 200
    assert all(r.pool == data[r.seq][0] for r in got)
    assert {r.seq for r in neardup.drop_near_duplicates(df, split=split).collect()} == want


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_survivors_do_not_depend_on_partitions(spark, partitions):
    data, df = requests(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.seq for r in neardup.surviving_rows(df.repartition(partitions)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == literal_survivors(data)


def test_own_tokens_and_carried_columns(spark):
    data, df = requests(spark)
    df = df.withColumn("ids", F.split("request", " ")).withColumn("page", F.concat(F.lit("p"), "seq"))
    got = neardup.surviving_rows(df, tokens=F.col("ids"), carry=["page"]).collect()
    assert all(r.page == f"p{r.seq}" for r in got) and {r.pool for r in got} == {"WI", "WR"}


def test_report_of_an_empty_pool(spark):
    empty = spark.createDataFrame([], "pool string, seq bigint")
    assert neardup.dedup_report(empty, empty).collect() == []


def test_an_index_that_lasts_gives_the_candidates_of_the_whole(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, draw.randrange(60) if i % 3 else 0, draw.randrange(3)) for i in range(400)]  # one hot bucket
    bands = spark.createDataFrame(sorted(set(rows)), "seq bigint, k1 bigint, k2 bigint")
    wanted = {tuple(r) for r in neardup.least_candidate(bands, "seq", neardup.BUCKET_KEY).collect()}
    index = BandIndex(spark, "lasting", str(tmp_path / "index"), 4)
    try:
        assert index.candidates(bands).count() == 0
        for part in range(2):
            later = bands.filter((F.col("seq") >= 200) == bool(part))
            index.insert(later)
            if not part:
                alone = neardup.least_candidate(later, "seq", neardup.BUCKET_KEY)
                assert {tuple(r) for r in index.candidates(later).collect()} == {tuple(r) for r in alone.collect()}
        # The later rows alone, then all; also in a session that has to register the folder again.
        found = {tuple(r) for r in index.candidates(later).collect()}
        assert found == {r for r in wanted if r[0] >= 200} and wanted
        index.drop()
        again = BandIndex(spark, "lasting", str(tmp_path / "index"), 4)
        got = again.candidates(bands)
        assert {tuple(r) for r in got.collect()} == wanted
        plan = again.candidates(bands)._jdf.queryExecution().executedPlan().toString()
        # Only the rows that are looked up are shuffled to the buckets; the index is read as it lies.
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(k1") == 1
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 2
    finally:
        index.drop()
