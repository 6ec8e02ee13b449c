"""Toxicity, collocations and token alignment against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm import collocations, toxicity
from pagemill.llm.pretokens import byte_symbols
from pagemill.llm.queries import QUERIES
from pagemill.llm.token_alignment import align_documents, segments
from pagemill.llm.word_arrays import byte_classes, word_blocks
from tests.llm.samples import LOWER, edge_rows, sentence, table

SF_DIR = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def same(got: list[tuple], wanted: list[tuple]) -> bool:
    return Counter(map(tuple, got)) == Counter(wanted)


# --- words as arrays ---


@pytest.mark.parametrize("block", [1, 5, 16, 1 << 20])
def test_words_of_blocks(block):
    classes = byte_classes(b" ", b".")
    texts = ["Ab c. d  é", None, "", " . ", "xyz" * 9 + " a b c d e f g", "one", ".a.b"]
    got = defaultdict(list)
    for words in word_blocks(pa.array(texts), classes, 2, block):
        found = words.dictionary.take(pa.array(words.code)).to_pylist()
        for row, word, own in zip(words.row.tolist(), found, words.own.tolist()):
            if own:
                got[row].append(word.decode())
        assert all(np.diff(words.piece) >= 0)
    assert dict(got) == {n: t.translate(LOWER).replace(".", " ").split() for n, t in enumerate(texts) if t and t.strip(" .")}


# --- collocations ---


def plain_phrases(rows: list[tuple[str | None, str | None]], least: int) -> dict[str, Counter]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        for c in ".,;:!?\n\x0b\x0c\r":
            text = (text or "").replace(c, "\n")
        for piece in text.translate(LOWER).split("\n"):
            words = piece.replace("\t", " ").split(" ")
            words = [w for w in words if w]
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang or "und"][tuple(words[i : i + n])] += 1
    return counts


def plain_collocations(rows, least: int, top: int) -> list[tuple]:
    out = []
    for lang, f in plain_phrases(rows, least).items():
        total = sum(n for g, n in f.items() if len(g) == 1)
        frequent = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        kept = []
        for g, a in frequent.items():
            longer = [
                n for h, n in frequent.items()
                if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
            ]
            if any(100 * n >= 80 * a for n in longer):
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return out


def phrase_rows(seed: int) -> list[tuple[str | None, str]]:
    draw = random.Random(seed)
    words = [sentence(seed + k, 1) + str(k % 7) for k in range(40)]
    phrases = [" ".join(draw.choices(words, k=draw.randint(2, 5))) for _ in range(25)]
    rows = []
    for _ in range(150):
        parts = [draw.choice(phrases) if draw.random() < 0.6 else draw.choice(words) for _ in range(draw.randint(1, 30))]
        marks = [draw.choice(["  ", " ", "\t", ". ", ", ", "\n", " "]) for _ in parts]
        rows.append((draw.choice(["de", "en", None, "und"]), "".join(p + m for p, m in zip(parts, marks))))
    return rows + [("en", None), ("en", ""), (None, " .,\n"), ("xx", "One one ONE")]


@pytest.mark.parametrize(("share", "count", "block"), [(0.125, 2, 1 << 20), (0.02, 1, 300), (0.5, 40, 1 << 20), (1.0, 1, 50)])
def test_collocations(spark, monkeypatch, share, count, block):
    """Any sample gives the same, and any cut of the texts."""
    rows = phrase_rows(3)
    docs = table(spark, [(n, text) for n, (_, text) in enumerate(rows)]).drop("lang")
    docs = docs.join(spark.createDataFrame([(n, lang) for n, (lang, _) in enumerate(rows)], "doc_id long, lang string"), "doc_id")
    monkeypatch.setattr(collocations, "COUNTED_BYTES", block)
    got = collocations.collocations(docs, least=8, top=20, sample_share=share, sample_count=count)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert same(got.collect(), plain_collocations(rows, 8, 20))


def test_failures_of_the_border_are_counted(spark):
    """A sample that proposes nothing makes every frequent word a failure."""
    rows = phrase_rows(5)
    docs = spark.createDataFrame(rows, "lang string, text string")
    frequent, totals, failed = collocations.frequent_phrases(docs, 8, sample_share=0.5, sample_count=10**9)
    wanted = {(lang, g) for lang, f in plain_phrases(rows, 8).items() for g, n in f.items() if n >= 8}
    assert failed > 0 and {(r["lang"], tuple(r["phrase"].split(" "))) for r in frequent.collect()} == wanted
    none = collocations.collocations(docs.limit(0))
    assert none.count() == 0 and collocations.collocations(docs.select("lang", F.lit(None).cast("string").alias("text"))).count() == 0


# --- token alignment ---

_TOKENS = Tokenizer.from_file(A)
_TOKENS.encode_special_tokens = True
_PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
_BYTE = {symbol: byte for byte, symbol in byte_symbols().items()}


def _ends(tokens: list[bytes]) -> list[int]:
    return np.cumsum([len(t) for t in tokens]).tolist()


def plain_alignment(rows: list[tuple]) -> list[tuple]:
    documents, found = Counter(), []
    for number, text in rows:
        ids_a = _TOKENS.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = _PIECES.encode(text or "")
        bytes_a = [bytes(_BYTE[c] for c in _TOKENS.id_to_token(n)) for n in ids_a]
        pieces = [(n, _PIECES.id_to_piece(n)) for n in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if _PIECES.is_byte(n) else p.replace("▁", " ").encode() for n, p in pieces]
        spelled = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != spelled or b"".join(bytes_b) != spelled:
            found.append((number, None))
            continue
        ends_a, ends_b = _ends(bytes_a), _ends(bytes_b)
        groups, low = [], 0
        for high in sorted(set(ends_a) & set(ends_b)):
            groups.append(([n for n, e in zip(ids_a, ends_a) if low < e <= high], [n for n, e in zip(ids_b, ends_b) if low < e <= high]))
            low = high
        links = [(a, b) for left, right in groups for a in left for b in right]
        documents.update(set(links))
        text_of_groups = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in groups)
        found.append((number, (len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(text_of_groups.encode()).hexdigest())))
    most = Counter()
    for (a, _), n in documents.items():
        most[a] = max(most[a], n)
    return [
        (number, *m[:3], len(m[3]), sum(documents[p] == most[p[0]] for p in m[3]), sum(documents[p] for p in m[3]), m[4])
        if m else (number, 0, 0, 0, 0, 0, 0, "")
        for number, m in found
    ]


MORE = ["a  b   c\n d \n\n  e \t f ", " ", "   ", "▁x y", "a  b\x85 c", "漢字 と　 ひ", "\n x", "  x", "<s> <0x0A> </s>", "ﬁ ① é"]


@pytest.mark.parametrize("broadcast", [1 << 20, 60, 0])
def test_alignment(spark, broadcast):
    short = [(n, text[:700] if text else text) for n, text in edge_rows()]
    rows = short + [(200 + n, text) for n, text in enumerate(MORE)]
    got, pairs = align_documents(table(spark, rows), A, B, broadcast_pairs=broadcast)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert same(got.collect(), plain_alignment(rows))
    assert pairs.columns == ["a", "b", "documents"] and pairs.count() == pairs.select("a", "b").distinct().count()
    if broadcast:
        assert align_documents(table(spark, []), A, B)[0].count() == 0


def test_texts_in_segments(monkeypatch):
    from pagemill.llm import token_alignment

    text = " ".join(sentence(n, 3) for n in range(400)) + "\n \t " + "x" * 500
    whole = [chunk for part in segments(text) for chunk in part]
    aligner = token_alignment.Aligner(A, B)
    wanted = aligner.text(text)
    monkeypatch.setattr(token_alignment, "SEGMENT", 100)
    monkeypatch.setattr(token_alignment, "CHUNKS", 50)
    assert len(list(segments(text))) > 20 and [c for part in segments(text) for c in part] == whole
    got = aligner.text(text)
    assert got[:2] == wanted[:2] and (got[2] == wanted[2]).all() and (got[3] == wanted[3]).all()


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs if len(r.text) < 4_000]
    got = align_documents(spark.createDataFrame(rows, "doc_id long, text string"), A, B)[0]
    assert same(got.collect(), plain_alignment(rows)) and len(rows) > 100
    assert QUERIES["op13_token_alignment"](spark, SF_DIR).count() == len(docs)


# --- toxicity ---

INSULTS = {"en": ["idiot", "scum", "moron"], "es": ["tonto", "basura"]}
SMALL = toxicity.Settings(steps=300, least_language=20)


def toxic_rows(seed: int, texts: int) -> list[tuple]:
    """(doc_id, text, lang, toxic): insults decide in two languages, chance in the third."""
    draw = random.Random(seed)
    words = {lang: [sentence(k + 100 * n, 1, "abcdeghlmnoprstu" + lang) for k in range(150)] for n, lang in enumerate(["en", "es", "fr"])}
    rows = []
    for number in range(texts):
        lang = draw.choice(["en", "en", "es", "fr"])
        text = [draw.choice(words[lang]) for _ in range(draw.randint(5, 120))]
        toxic = draw.random() < 0.2
        if toxic and lang in INSULTS:
            for _ in range(draw.randint(1, 3)):
                text.insert(draw.randrange(len(text)), draw.choice(INSULTS[lang]))
        rows.append((number, " ".join(text), lang, int(toxic)))
    return rows


def test_toxicity_finds_what_decides(spark):
    rows = toxic_rows(1, 1_600)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] < 1_200] + [(3, None), (None, 1)], "doc_id long, toxic int")
    network = toxicity.learn_toxicity(docs, labels, SMALL)
    scored = docs.withColumn("score", toxicity.toxicity_score(F.col("text"), network)).collect()
    score = {r["doc_id"]: r["score"] for r in scored}
    held = [r for r in rows if r[0] >= 1_200]
    flagged = [r for r in held if score[r[0]] >= 0.7]
    for lang in INSULTS:
        toxic = [r for r in held if r[2] == lang and r[3]]
        assert sum(score[r[0]] >= 0.7 for r in toxic) >= 0.9 * len(toxic)
    assert sum(1 - r[3] for r in flagged) <= 0.02 * len(held)
    assert not [r for r in flagged if r[2] == "fr"] or len([r for r in flagged if r[2] == "fr"]) <= 2
    assert all(0 <= s <= 1 for s in score.values())


def test_toxicity_scores_only_texts_and_whole_ones(spark, monkeypatch):
    rows = toxic_rows(2, 700)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    network = toxicity.learn_toxicity(docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int"), SMALL)
    again = toxicity.learn_toxicity(
        docs.repartition(5).withColumn("_words", F.lit(1)), spark.createDataFrame([(r[0], r[3]) for r in rows[::-1]], "doc_id long, toxic int"), SMALL
    )
    texts = pa.array([r[1] for r in rows] + [None, "", " ", rows[0][1], "ab " * 50_000 + "idiot scum " + "cd " * 50_000])
    scores = toxicity.score_texts(texts, network)
    assert np.allclose(scores, toxicity.score_texts(texts, again)) and scores[700] == scores[701] == scores[702]
    assert scores[703] == scores[0] and scores[704] > toxicity.score_texts(pa.array(["ab " * 50_000 + "cd " * 50_000]), network)[0]
    from pagemill.llm import word_arrays

    blocks = [list(word_blocks(texts, toxicity._CLASSES, 2, size)) for size in (1000, 1 << 23)]
    assert len(blocks[0]) > 100 and len(blocks[1]) == 1
    monkeypatch.setattr(toxicity, "word_blocks", lambda t, c, o: word_arrays.word_blocks(t, c, o, 1000))
    assert np.allclose(scores, toxicity.score_texts(texts, network), atol=1e-5)
    edge = table(spark, edge_rows()).select("doc_id", toxicity.toxicity_score(F.col("text"), network).alias("s"))
    assert all(0 <= r["s"] <= 1 for r in edge.collect()) and edge.count() == len(edge_rows())


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = table(spark, edge_rows())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(n, 1) for n in range(20)], "doc_id long, toxic int")
    for labels, most in ((none, 0.01), (one, 0.5)):
        network = toxicity.learn_toxicity(docs, labels, SMALL)
        scores = toxicity.score_texts(pa.array(["a b", None]), network)
        assert scores[0] == scores[1] and scores[0] <= most
    assert toxicity.learn_toxicity(docs.limit(0), one, SMALL) is not None


def test_toxicity_query_holds_out(spark):
    got = QUERIES["op11_toxicity"](spark, SF_DIR)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    for r in got.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7)


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Every labelled text has its word counted, however long; groups and blocks share the work."""
    rows = [(n, f"only{n} " + "word " * (12_000 if n == 5 else 3), "en", n % 4 == 0) for n in range(400)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[3])) for r in rows] + [(5, 0), (None, 1), (7, None)], "_id long, _label int")
    found = toxicity.training_rows(docs, labels, SMALL, "doc_id", "text", "lang").collect()
    assert len(found) == 400 and max(len(r["_words"]) for r in found) == 4 * 12_001
    rows = toxic_rows(5, 900)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    settings = toxicity.Settings(steps=400, least_language=20, group_rows=200)
    network = toxicity.learn_toxicity(docs, labels, settings)
    scores = toxicity.score_texts(pa.array([r[1] for r in rows]), network)
    toxic = [score for score, r in zip(scores, rows) if r[3] and r[2] in INSULTS]
    assert sum(score >= 0.7 for score in toxic) >= 0.8 * len(toxic)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 50)
    texts = [np.arange(2, 2 + n) % len(network.embeddings) for n in (130, 7, 49)]
    laid, starts = toxicity._laid_out(texts, len(network.filters))
    small = toxicity._pool(laid, starts, network)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 1 << 18)
    for (a, i), (b, j) in zip(small, toxicity._pool(laid, starts, network)):
        assert np.allclose(a, b)


def test_toxicity_joins_words_and_not_texts(spark, capsys):
    """Texts stay where they are read: no exchange has them, whatever the size of the labels."""
    rows = toxic_rows(6, 60)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] < 20], "_id long, _label int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = toxicity.training_rows(docs, labels, SMALL, "doc_id", "text", "lang")
        found.explain("formatted")
        inputs = [part.split("\n")[1] for part in capsys.readouterr().out.split("\n\n") if ") Exchange" in part.split("\n")[0]]
        assert len(inputs) == 2 and not [i for i in inputs if "text" in i] and any("_words" in i for i in inputs)
        assert found.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(
    ("docs_id", "labels_id"), [("long", "long"), ("int", "long"), ("string", "string"), ("string", "long"), ("double", "double"), ("decimal(9,0)", "int")]
)
@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_toxicity_joins_every_label(spark, monkeypatch, docs_id, labels_id, bits):
    """Ids of any kinds, copies, null ids and null texts, with bits that are all set or few."""
    monkeypatch.setattr(toxicity, "ID_BITS", bits)
    monkeypatch.setattr(toxicity, "TEXT_ROWS", 7)
    texts = [(n, None if n == 4 else "" if n == 5 else f"word{n % 1000} one two", "en") for n in range(-40, 160)]
    texts += [(7, "word7 one two", "de"), (7, "other", "en"), (None, "word one", "en")]
    marks = [(n, n % 2) for n in range(-30, 60)] + [(7, 0), (8, 1), (9, None), (500, 1), (None, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumn("doc_id", F.col("doc_id").cast(docs_id))
    labels = spark.createDataFrame(marks, "_id long, _label int").withColumn("_id", F.col("_id").cast(labels_id))
    got = toxicity.training_rows(docs, labels, SMALL, "doc_id", "text", "lang").collect()
    known = {n: max(m for i, m in marks if i == n and m is not None) for n, _ in marks if n is not None}

    def words(text: str | None) -> bytes:
        return toxicity.word_buckets(pa.array((text or "").encode().split(), pa.large_binary())).astype(np.uint32).tobytes()

    langs = defaultdict(list)
    for n, text, lang in texts:
        if n in known:
            langs[n, words(text)].append(lang)
    wanted = [(w, known[n], min(found)) for (n, w), found in langs.items()]
    assert same([(bytes(r["_words"]), r["_label"], r["_lang"]) for r in got], wanted)


def test_toxicity_leaves_no_broadcast_network(spark, monkeypatch):
    """What a round sends goes when the round ends."""
    from pyspark.core.broadcast import Broadcast

    rows = toxic_rows(7, 300)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    sent, gone = [], []

    def keep(value, found):
        if isinstance(value, toxicity.Network):
            sent.append(found)
        return found

    send, destroy = type(spark.sparkContext).broadcast, Broadcast.destroy
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: keep(value, send(self, value)))
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: gone.append(self) or destroy(self, *a))
    toxicity.learn_toxicity(docs, labels, toxicity.Settings(steps=20, least_language=20))
    assert len(sent) == 5 and all(any(b is g for g in gone) for b in sent)


def test_toxicity_looks_up_only_words_at_hand():
    """Answers do not depend on what else the network knows, and the words at hand give them."""
    network = toxicity.new_network(np.arange(0, 5_000, 5), SMALL)
    rows, starts = np.array([3, 1, 900, 3, 7, 7, 1]), np.array([0, 3, 4])
    got = toxicity._answers(network, rows, starts)
    for text, hidden in zip(np.split(rows, starts[1:]), got):
        padded = np.append(text, [0, 0])
        wanted = [
            (sum(network.embeddings[padded[j : j + len(text)]] @ w[j] for j in range(len(w))) + b).max(axis=0)
            for w, b in zip(network.filters, network.biases)
        ]
        assert np.allclose(hidden, np.concatenate(wanted), atol=1e-5)
