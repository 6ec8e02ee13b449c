"""Operators over whole tables against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat_format, decontaminate, hyperminhash, language_id, sharding, suffix_dedup
from pagemill.llm.components import connected
from tests.llm.samples import LOWER, edge_rows, sentence, table

# --- repeated bytes ---


def plain_repeats(rows):
    windows = lambda data: ((s, data[s : s + 200]) for s in range(len(data) - 199))
    often = Counter(w for _, text in rows for _, w in windows((text or "").encode()))
    out = Counter()
    for number, text in rows:
        data = (text or "").encode()
        gone = set()
        for s, w in windows(data):
            if often[w] > 1:
                gone.update(range(s, s + 200))
        kept = bytes(b for p, b in enumerate(data) if p not in gone)
        out[number, len(data), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot_runs", [suffix_dedup.HOT_RUNS, 2])
def test_repeated_bytes(spark, hot_runs):
    passage = sentence(9, 90)
    more = [sentence(10, 40) + passage, passage[:260] + sentence(11, 500), passage[20:240] + "é" + passage[10:230]]
    rows = [r for r in edge_rows() if len(r[1] or "") < 30_000] + [(900 + i, t) for i, t in enumerate(more)]
    got = suffix_dedup.remove_repeats(table(spark, rows), hot_runs=hot_runs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == plain_repeats(rows)
    for r in got:
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_kept_bytes(spark):
    got = suffix_dedup.remove_repeats(table(spark, edge_rows()[:9]), with_kept=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_suffix_array_is_sorted():
    draw = np.random.default_rng(1)
    for letters in (2, 3, 200):
        text = np.concatenate([draw.integers(1, letters + 1, 3_000), [0]]).astype(np.uint8)
        text[500:900] = text[1500:1900]
        order = suffix_dedup.suffix_array(text, np.ones(len(text), dtype=bool))
        data = text.tobytes() + b"\0" * 200
        keys = [data[p : p + 200] for p in order]
        assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)


# --- benchmark ---


def test_overlaps(spark, monkeypatch):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    base = edge_rows()[7][1]
    items = [(1, base[30:200]), (2, None), (3, "!!"), (4, "a B"), (5, "a b c d"), (6, "x " * 30), (None, base[100:250]), (7, base[30:200])]
    clean, hit_text = sentence(31, 40, "vwxyz"), "so " + base[30:180]
    rows = edge_rows() + [(900, "x " * 50), (901, "b a b a B"), (902, base[100:200])]
    rows += [(None, clean), (None, "a"), (None, hit_text), (900, clean), (900, hit_text), (900, hit_text), (902, None)]
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    wanted: dict = {}
    for number, text in rows:
        w, hit, names = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        wanted[number, text] = (len(w), len(hit), names)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    columns = table(spark, rows).columns
    for block_rows in (decontaminate.BLOCK_ROWS, 7):
        monkeypatch.setattr(decontaminate, "BLOCK_ROWS", block_rows)
        docs = table(spark, rows)
        report = decontaminate.overlap_report(docs, benchmark)
        assert report.count() == len(rows)
        # The report has no text: its rows are held against those of the id.
        got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["hit_items"]), r["contaminated"]) for r in report.collect())
        names = lambda found: tuple(sorted(str(x) for x in found if x is not None))
        assert got == Counter((n, wanted[n, t][0], wanted[n, t][1], names(wanted[n, t][2]), wanted[n, t][1] > 0) for n, t in rows)
        kept = decontaminate.drop_contaminated(docs, benchmark)
        assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(row for row in rows if not wanted[row][1])
        assert kept.columns == columns and (None, clean) in wanted and not wanted[900, clean][1] and wanted[900, hit_text][1]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(table(spark, rows), nothing).count() == len(rows)
    assert decontaminate.overlap_report(table(spark, []), benchmark).count() == 0


# --- near-duplicates ---


def plain_components(rows):
    sets = {}
    for number, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.setdefault(number, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = {n: {n} for n in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                joined = group[a] | group[b]
                for n in joined:
                    group[n] = joined
    return {n: (len(sets[n]), min(group[n])) for n in sets}


def near_rows():
    """A hub with copies that are near it but mostly not near each other, and chains."""
    base = sentence(21, 200).split(" ")
    rows = edge_rows()[:22]
    for k in range(40):
        words = base[:]
        for j in range(k % 8):
            words[(k * 37 + j * 41) % 200] = f"edit{k}x{j}"
        rows.append((1000 - k, " ".join(words)))
    short = sentence(22, 12).split(" ")
    return rows + [(2000 + i, " ".join(short[i : i + 9])) for i in range(4)] + [rows[7]]


@pytest.mark.parametrize("block, partners", [(hyperminhash.BLOCK, hyperminhash.PARTNERS), (5, 1)])
def test_components_of_near_duplicates(spark, monkeypatch, block, partners):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    monkeypatch.setattr(hyperminhash, "PARTNERS", partners)
    rows = near_rows()
    wanted = plain_components(rows)
    got = hyperminhash.link_components(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_without_ids_and_rows(spark):
    got = hyperminhash.link_components(table(spark, [(None, "a b c"), (3, "a b c"), (None, None)])).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == [(3, 3), (None, 3), (None, None)]
    assert hyperminhash.link_components(table(spark, [])).count() == 0
    kept = hyperminhash.drop_near_duplicates(table(spark, near_rows()))
    assert Counter(r["doc_id"] for r in kept.collect()).most_common(1)[0][1] == 1


def test_repeated_ids_link_by_each_of_their_texts(spark):
    """(1, a), (2, b), (2, near a): the second text of 2 belongs to 1."""
    a, b, c = (sentence(70 + k, 80) for k in range(3))
    near = lambda text: text.replace(" ", " \t", 3) + " more words"
    rows = [(1, a), (2, b), (2, near(a)), (3, near(b)), (None, c), (None, near(c)), (None, "alone here"), (3, near(b))]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in hyperminhash.link_components(table(spark, rows)).collect())
    wanted = [(1, 1, True), (2, 2, True), (2, 1, False), (3, 2, False), (3, 2, False), (None, None, True)]
    assert got == Counter([*wanted, (None, None, True), (None, None, False)])


def test_pairs_just_above_the_threshold_are_found(spark):
    """Many pairs of similarity 0.75 to 0.80, none of them near another."""
    draw, rows = random.Random(8), []
    for k in range(300):
        words = sentence(5_000 + k, 160).split(" ")
        other = words[:]
        shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        while True:
            changed = other[:]
            changed[draw.randrange(160)] = f"w{k}x{draw.randrange(999)}"
            one, two = shingles(words), shingles(changed)
            if 100 * len(one & two) < 75 * len(one | two):
                break
            other = changed
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = hyperminhash.link_components(table(spark, rows)).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got) and len(got) == 600


def test_no_scratch_table_of_a_stage_is_left(spark, tmp_path):
    folder = Path(spark.conf.get("spark.checkpoint.dir")) / "pagemill"
    before = set(folder.glob("*/*"))
    hyperminhash.drop_near_duplicates(table(spark, near_rows())).write.parquet(str(tmp_path / "out"))
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*/*")) - before}
    assert left == {"near-duplicates", "repeated-rows"}


def test_estimates_follow_the_similarity():
    draw = np.random.default_rng(2)
    for common in (0.3, 0.75, 0.95):
        hashes = draw.integers(0, 2**64, 20_000, dtype=np.uint64)
        both = int(len(hashes) * common)
        rest = (len(hashes) - both) // 2
        one, two = np.sort(hashes[: both + rest]), np.sort(np.concatenate([hashes[:both], hashes[both + rest :]]))
        a, b = (hyperminhash.fine_codes(x)[None, :] for x in (one, two))
        estimate, _ = hyperminhash.may_reach(a, b, np.array([len(one)]), np.array([len(two)]), 0.75)
        assert abs(estimate[0] - common) < 0.12


def _sketched(sets):
    return np.array([hyperminhash.sketch(np.sort(x)) for x in sets], dtype=np.uint16)


def test_short_texts_with_a_common_line_hardly_meet():
    """A tenth of their shingles is common: no bucket holds more than a few of them."""
    line = sentence(80, 9)
    texts = [f"{line} {sentence(6_000 + k, 45)}" for k in range(400)]
    keys = hyperminhash.band_keys(_sketched(map(hyperminhash.shingles, texts)))
    assert np.unique(keys, return_counts=True)[1].max() < 20


@pytest.mark.parametrize("union", [4, 8, 16, 40, 120, 400, 4_000])
def test_sets_at_the_threshold_meet_whatever_their_size(union):
    draw = np.random.default_rng(union)
    first, second = [], []
    for _ in range(1_000 if union < 4_000 else 100):
        hashes = draw.integers(0, 2**64, union, dtype=np.uint64)
        common, rest = hashes[: union * 3 // 4], hashes[union * 3 // 4 :]
        cut = len(rest) // 2
        first.append(np.concatenate([common, rest[:cut]]))
        second.append(np.concatenate([common, rest[cut:]]))
    a, b = (hyperminhash.band_keys(_sketched(x)) for x in (first, second))
    assert (a == b).any(axis=1).all()


def test_filled_halves_are_counted():
    codes = np.random.default_rng(4).integers(0, 256, (50, 256)).astype(np.uint8)
    codes[codes % 3 == 0] &= 15
    codes[codes % 5 == 0] &= 240
    wanted = ((codes & 15) > 0).sum(axis=1) + ((codes >> 4) > 0).sum(axis=1)
    assert (hyperminhash._filled_halves(codes) == wanted).all()


@pytest.mark.parametrize("pairs", [hyperminhash.PAIRS, 7])
def test_best_partners_of_a_bucket(monkeypatch, pairs):
    """Against pairs one by one: of two components, apart in no lesser bucket, the best first."""
    monkeypatch.setattr(hyperminhash, "PAIRS", pairs)
    draw = np.random.default_rng(5)
    hashes = draw.integers(0, 2**64, 60, dtype=np.uint64)
    sets = [np.sort(np.concatenate([hashes[draw.permutation(60)[:55]], draw.integers(0, 2**64, k % 9, dtype=np.uint64)])) for k in range(30)]
    codes = np.array([hyperminhash.fine_codes(x) for x in sets])
    sizes, component = np.array([len(x) for x in sets]), draw.integers(0, 6, 30)
    tops = np.stack([draw.integers(0, 4, 30), np.full(30, 5), draw.integers(6, 9, 30), draw.integers(3, 6, 30)], axis=1)
    largest = np.argmax(np.bincount(component))
    for spans in ([(0, 30)], [(0, 13), (13, 30)]):
        wanted = set()
        for i in range(30):
            others = range(30) if len(spans) == 1 else range(13, 30) if i < 13 else range(13)
            found = []
            for j in others:
                estimate, good = hyperminhash.may_reach(codes[[i]], codes[[j]], sizes[[i]], sizes[[j]], 0.75)
                before = any(x == y < 5 for x, y in zip(tops[i], tops[j]))
                if component[i] not in (component[j], largest) and good[0] and not before:
                    found.append((-estimate[0], j))
            wanted |= {(i, j, len(found) > 4) for _, j in sorted(found)[:4]}
        args = component, codes, hyperminhash._filled_halves(codes), sizes, tops, 5, 0.75, 4, spans
        got = [row for found in hyperminhash._block_pairs(*args) for row in zip(*(x.tolist() for x in found))]
        assert len(got) == len(wanted) > 20 and set(got) == wanted


def test_texts_of_one_or_two_shingles_are_linked_to_equal_sets_only(spark):
    rows = [(k, f"a b c d e w{k}") for k in range(60)] + [(100, "A b c d e  w7"), (101, "a b c d e"), (102, "a b c d e")]
    rows += [(103, "k l m n o p q"), (104, "k l m n o p q r")]
    got = hyperminhash.link_components(table(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows)


def test_connected(spark):
    edges = [(9, 8), (8, 7), (7, 6), (6, 5), (3, 1), (3, 2), (5, 5), (20, 10), (10, 20), (9, 8)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {9: 5, 8: 5, 7: 5, 6: 5, 5: 5, 3: 1, 2: 1, 1: 1, 20: 10, 10: 10}


# --- languages ---


def test_languages(spark):
    kinds = {"aa": "abcd", "bb": "cdef", "cc": "éñßa"}
    train = [(i, sentence(i, 40, kinds[lang]), lang) for i, lang in enumerate(list(kinds) * 20)]
    train += [(900, None, "aa"), (901, "abc", None), (902, "", "aa"), (903, "123", "bb")]
    test = [(i, sentence(1000 + i, 25, kinds[lang]), lang) for i, lang in enumerate(list(kinds) * 10)]
    test += [(800, None, "und"), (801, "", "und"), (802, "12 ² !", "und"), (803, None, "und")]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(test + test[:3], schema).repartition(3)
    got = language_id.identify(docs, spark.createDataFrame(train, schema)).collect()
    assert len(got) == len(test) + 3
    assert all(r["lang_pred"] == r["lang"] for r in got)
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["score"] == 0 for r in got if r["lang"] == "und")
    assert language_id.identify(docs.limit(0), spark.createDataFrame(train, schema)).count() == 0
    untrained = language_id.identify(docs, spark.createDataFrame([], schema)).collect()
    assert {r["lang_pred"] for r in untrained} == {"und"}
    bounded = language_id.identify(docs, spark.createDataFrame(train, schema), max_grams=60).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in bounded) >= 0.9 * len(bounded)


def test_probabilities_add_up(spark):
    train = spark.createDataFrame([(sentence(1, 300, "abc"), "x")], "text string, lang string")
    model = language_id.train(train)["x"]
    keys, values = model.grams[0]
    assert abs(np.exp(values).sum() + np.exp(model.contexts[0][1][0] + model.floor) - 1) < 0.05
    assert all((np.diff(k) > 0).all() for k, _ in model.grams if len(k) > 1)


# --- shards ---


@pytest.mark.parametrize("group", [sharding.SLOT_GROUP, 3])
def test_shards(spark, monkeypatch, group):
    monkeypatch.setattr(sharding, "SLOT_GROUP", group)
    hot = sentence(1, 30)
    rows = [(i, hot if i % 3 == 0 else sentence(i, 5 + i % 40)) for i in range(900)] + [(5000, None), (5001, ""), (5002, None)]
    got = sharding.shard_documents(table(spark, rows), 8).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((n, len((t or "").encode()) + 16) for n, t in rows)
    size, slots = Counter(), {}
    for r in got:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(size.values()) / 8
    assert sorted(size) == list(range(8)) and all(abs(x - mean) <= 0.01 * mean + 300 for x in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Only a group that is larger than a shard is cut.
    homes = {}
    for r in got:
        homes.setdefault(r["text"] or "", set()).add(r["shard"])
    assert all(len(h) == 1 for t, h in homes.items() if t and t != hot)


def test_shards_of_little(spark):
    assert sharding.shard_documents(table(spark, []), 40).count() == 0
    got = sharding.shard_documents(table(spark, [(1, "a"), (1, "a"), (None, None)]), 5).collect()
    assert len(got) == 3 and all(0 <= r["shard"] < 5 for r in got)
    with pytest.raises(ValueError):
        sharding.shard_documents(table(spark, []).withColumn("slot", F.lit(1)), 2)


# --- tool calls ---


def test_tool_calls(spark):
    schemas = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}}
    good = '{"b": 2.5, "a": 1}'
    calls = [
        (1, "c1", 0, "add", good, []), (1, "c2", 1, "add", good, ["c1"]), (1, "c3", 2, "add", good, ["c2", "c1"]),
        (1, "c4", 3, "add", '{"a": "1", "b": 2}', []), (1, "c5", 4, "add", '{"a": 1}', []), (1, "c6", 5, "add", "no", []),
        (1, "c7", 6, "add", '{"a": 1, "b": 2, "z": 3}', []), (1, "c8", 7, "sub", good, []), (1, None, 8, "add", good, []),
        (1, "c9", 9, "add", good, ["gone"]), (2, "c1", 0, "add", good, ["c2"]), (2, "c2", 1, "add", good, ["c1"]),
        (3, "d", 0, "add", good, []), (3, "d", 1, "add", good, []), (4, "n", 0, "add", None, None), (None, "e", 0, "add", good, []),
    ]
    results = [(1, "c1", 5, "late"), (1, "c1", 1, "x \"q\""), (2, "c1", 3, "other"), (9, "c1", 1, "lost"), (1, None, 1, "y")]
    calls_df = spark.createDataFrame(calls, "conv_id long, call_id string, turn int, name string, arguments string, needs array<string>")
    results_df = spark.createDataFrame(results, "conv_id long, call_id string, turn int, content string")
    got = {(r["conv_id"], r["call_id"], r["turn"]): r for r in chat_format.link_tool_calls(calls_df, results_df, schemas).collect()}
    assert len(got) == len(calls)
    problems = {k[1:]: r["problem"] for k, r in got.items() if k[0] == 1}
    assert [problems[f"c{i}", i - 1] for i in range(1, 9)] == [None, None, None, *["bad arguments"] * 4, "unknown tool"]
    assert problems[None, 8] == "no id" and problems["c9", 9] == "missing need"
    assert [got[1, f"c{i}", i - 1]["level"] for i in (1, 2, 3)] == [0, 1, 2]
    assert got[2, "c1", 0]["problem"] == "cycle" and got[3, "d", 1]["problem"] == "duplicate id"
    assert got[4, "n", 0]["problem"] == "bad arguments"
    assert got[1, "c1", 0]["record"] == '{"arguments":{"a":1,"b":2.5},"id":"c1","name":"add","result":"x \\"q\\""}'
    assert got[1, "c2", 1]["record"] == '{"arguments":{"a":1,"b":2.5},"id":"c2","name":"add"}'
    assert chat_format.link_tool_calls(calls_df.limit(0), results_df.limit(0), schemas).count() == 0


# --- languages with more grams than any bound ---


def plain_model(text):
    """Log-probability of a word by interpolated Kneser-Ney, with all grams of ``text``."""
    tables = {language_id.ORDER: Counter()}
    for word in language_id.words_of(text):
        padded = language_id.START * 3 + word + language_id.END
        tables[4].update(padded[i : i + 4] for i in range(len(word) + 1))
    for k in (3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discount, totals, followers = {}, Counter(), Counter()
    for k, table_ in tables.items():
        once, twice = (sum(n == m for n in table_.values()) for m in (1, 2))
        discount[k] = once / (once + 2 * twice) if once and twice else 0.5
        for gram, n in table_.items():
            totals[gram[:-1]] += n
            followers[gram[:-1]] += 1

    def probability(gram):
        if not gram:
            return 1 / (len(tables[1]) + 1)
        k, context = len(gram), gram[:-1]
        if not totals[context]:
            return probability(gram[1:])
        own = max(tables[k][gram] - discount[k], 0) if tables[k][gram] else 0
        return own / totals[context] + discount[k] * followers[context] / totals[context] * probability(gram[1:])

    def word_score(word):
        padded = language_id.START * 3 + word + language_id.END
        return sum(np.log(probability(padded[i : i + 4])) for i in range(len(word) + 1))

    return word_score


@pytest.mark.parametrize("part_rows", [language_id.PART_ROWS, 500])
def test_models_keep_all_grams(spark, monkeypatch, part_rows):
    monkeypatch.setattr(language_id, "PART_ROWS", part_rows)
    draw = np.random.default_rng(3)
    signs = np.array([chr(0x4E00 + k) for k in range(3_000)])
    # Distinct 4-grams of signs: more than 200,000, nearly all seen once.
    texts = {lang: " ".join("".join(signs[draw.integers(0, 3_000, 12)]) for _ in range(17_000)) for lang in ("x",)}
    texts["y"] = sentence(5, 400)
    rows = [(text[i : i + 1300], lang) for lang, text in texts.items() for i in range(0, len(text), 1300)]
    models = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert len(models["x"].grams[3][0]) > 200_000
    words = {lang: [w for text, of in rows if of == lang for w in language_id.words_of(text)] for lang in texts}
    asked = [words["x"][0], words["x"][-1], words["y"][0], words["y"][7], "zz", signs[5] + "ab"]
    got = language_id.entropies(asked, models)
    for column, lang in enumerate(models):
        scorer = plain_model(" ".join(words[lang]))
        assert np.allclose(got[:, column], [-scorer(w) / (len(w) + 1) for w in asked], atol=1e-9)


def test_calibration_texts_stay_on_executors(spark):
    rows = [(sentence(i % 7, 30, "abcd"), "aa") for i in range(40)] + [(sentence(i, 30, "cdef"), "bb") for i in range(40)]
    training = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    sent = spark.sparkContext.broadcast(language_id.store_models(training))
    values, true = language_id._sample_entropies(training, "text", "lang", 10, sent)
    assert values.shape == (17, 2) and sorted(true.tolist()) == [0] * 7 + [1] * 10
    assert (values.argmin(axis=1) == true).all()


# --- near-duplicates of tables with null and repeated ids ---


def test_distinct_texts_of_null_and_repeated_ids_stay(spark):
    one, two, three, four, five = (sentence(300 + k, 60, "abcde") for k in range(5))
    rows = [(1, one), (None, one), (None, two), (None, three), (None, three), (None, three.upper()), (7, one), (7, four), (7, four)]
    rows += [(8, five), (9, five), (8, "other words"), (None, None), (None, None), (None, "")]
    got = Counter((r["doc_id"], (r["text"] or "").lower()) for r in hyperminhash.drop_near_duplicates(table(spark, rows)).collect())
    wanted = [(1, one), (None, two), (None, three), (7, four), (8, five), (8, "other words"), *[(None, "")] * 3]
    assert got == Counter((number, text.lower()) for number, text in wanted)


def test_languages_are_calibrated_on_all_texts(spark):
    """The text of the highest entropy counts, whatever its hash; copies count once."""
    rows = [(sentence(i, 30, "abcd"), "aa") for i in range(700)] + [(sentence(i, 30, "cdef"), "bb") for i in range(700)]
    rows += [rows[3]] * 200 + [("12", "cc"), ("", "aa"), (None, "aa"), ("abc", None)]
    training = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    sent = spark.sparkContext.broadcast(language_id.store_models(training))
    distinct = sorted({row for row in rows if None not in row and language_id.words_of(row[0])})
    models, langs = sent.value.load(), list(sent.value.floors)
    values = language_id.entropies([text for text, _ in distinct], models)
    scale, bounds = language_id.calibrate(values, np.array([langs.index(lang) for _, lang in distinct]), langs)
    got = language_id._calibrate_on_all(training, "text", "lang", sent)
    assert got[0] == scale and got[1].keys() == bounds.keys()
    assert all(np.isclose(got[1][lang], bound) for lang, bound in bounds.items())
    seen = language_id.identify(training.where("lang is not null"), training).where("rejected and lang_pred <> 'und'")
    assert seen.where("lang = lang_pred").count() == 0
