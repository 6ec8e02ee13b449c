"""Toxic texts by a convolutional text classifier, trained in numpy by Spark tasks.

A word hashes to one of ``BUCKETS`` buckets. Buckets that enough training texts have get an
embedding of their own, all others share one. Filters over one, two and
three neighbouring words run over the whole text; the greatest answer of each, at least 0,
goes into a logistic output. Adam trains embeddings, filters and output together.

The classifier is fitted on all labelled rows. They are dealt by id hash to groups of about
``group_rows`` rows. In each of a few rounds every group trains the network of the round before on its
own rows, each at least once; what the groups give is averaged in the shuffle: an embedding over
the groups that moved it, all else over all groups.

Thresholds are calibrated by language, on all rows of a quarter of the ids that is not trained on:
the output becomes a probability by a logistic fit for each language, and the threshold of a
language, the one of greatest F1 among those with enough precision there, is laid on the
score 0.7. Both are found from counts of rows by output, rounded to a thousandth. The language of a text is
read off its words, by word counts of the labelled rows'
languages; the language column of a text that is scored is not looked at. A language in which the labels
cannot be told from the words gets no threshold below 1, so nothing there is flagged.

The driver holds the network, per language a count for each bucket that has an embedding, and bits of
the labelled ids' hashes: by these, texts become words where they are read, and no text is shuffled.
Learning and scoring go over every whole text: of a very long one block by block, keeping the
greatest answers. Null and empty texts have the score of a text without words. Equal texts
have equal scores. Of an id with several labels the greatest counts; null ids and labels are not
learnt from. Without labels of both kinds every score is the share of toxic labels, at most 0.5.
An empty table gives an empty result. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.word_arrays import byte_classes, word_blocks
from pagemill.session import discard, materialize

BUCKETS = 1 << 24
THRESHOLD = 0.7
# Letters and digits of ASCII and all beyond ASCII make words.
_CLASSES = byte_classes(bytes(c for c in range(128) if not chr(c).isalnum()))
# Rows of the embedding table: what stands outside a text, and words without a row.
OUTSIDE, RARE = 0, 1
# Words that are embedded together while training.
BLOCK_WORDS = 1 << 18
# Texts that are scored, or become words, together.
TEXT_ROWS = 256
# Outputs are counted in steps of this part.
BINS = 1000
# Bits that say which hashes of ids have labels, 8 MB.
ID_BITS = 1 << 26


@dataclass(frozen=True)
class Settings:
    """Shape of the network and of its training."""

    group_rows: int = 12_000
    rounds: int = 4
    least_texts: int = 4
    embedding: int = 12
    filters: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    steps: int = 1_500
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-4
    precision: float = 0.8
    least_language: int = 60
    seed: int = 11


@dataclass
class Network:
    buckets: np.ndarray  # sorted; bucket k has row k + 2
    embeddings: np.ndarray
    filters: list[np.ndarray]  # of each width: (width, embedding, filters)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    language: np.ndarray = field(default_factory=lambda: np.zeros((2, 1)))  # log-probabilities by row
    scale: np.ndarray = field(default_factory=lambda: np.ones(1))  # by language, as the next two
    shift: np.ndarray = field(default_factory=lambda: np.zeros(1))
    threshold: np.ndarray = field(default_factory=lambda: np.full(1, THRESHOLD))


def word_buckets(dictionary: pa.LargeBinaryArray) -> np.ndarray:
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, dictionary.to_pylist()), np.uint64, len(dictionary))
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def _rows(network: Network, buckets: np.ndarray) -> np.ndarray:
    at = np.searchsorted(network.buckets, buckets)
    known = at < len(network.buckets)
    known[known] = network.buckets[at[known]] == buckets[known]
    return np.where(known, at + 2, RARE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# --- training, of one group ---------------------------------------------------------------


def _pool(rows: np.ndarray, starts: np.ndarray, network: Network) -> list[tuple[np.ndarray, np.ndarray]]:
    """Greatest answers and where, by width, for texts whose rows begin at ``starts``."""
    gap = len(network.filters)
    stops = [*starts[1:].tolist(), len(rows) - gap]
    if len(rows) > BLOCK_WORDS:
        return _pool_blocks(rows, list(zip(starts.tolist(), stops)), network)
    found, embedded = [], network.embeddings[rows]
    for weights, bias in zip(network.filters, network.biases):
        answers = embedded[: len(embedded) - len(weights) + 1] @ weights[0]
        for k in range(1, len(weights)):
            answers += embedded[k : len(embedded) - len(weights) + 1 + k] @ weights[k]
        where = np.stack([a + np.argmax(answers[a:b], axis=0) for a, b in zip(starts.tolist(), stops)])
        found.append((np.take_along_axis(answers, where, axis=0) + bias, where))
    return found


def _pool_blocks(rows: np.ndarray, spans: list[tuple[int, int]], network: Network) -> list[tuple[np.ndarray, np.ndarray]]:
    """``_pool`` of long texts: block by block, keeping the greatest answers."""
    shape = len(spans), len(network.biases[0])
    found = [(np.full(shape, -np.inf), np.zeros(shape, dtype=np.int64)) for _ in network.filters]
    for text, (start, stop) in enumerate(spans):
        for at in range(start, stop, BLOCK_WORDS):
            size = min(BLOCK_WORDS, stop - at)
            embedded = network.embeddings[rows[at : at + size + len(network.filters) - 1]]
            for weights, bias, (best, where) in zip(network.filters, network.biases, found):
                answers = sum(embedded[k : k + size] @ weights[k] for k in range(len(weights)))
                place = np.argmax(answers, axis=0)
                value = answers[place, np.arange(shape[1])] + bias
                better = value > best[text]
                best[text, better], where[text, better] = value[better], at + place[better]
    return found


def _laid_out(texts: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all texts with ``gap`` places outside behind each, and where each begins."""
    outside = np.zeros(gap, dtype=np.int64)
    starts = np.cumsum([0, *(len(text) + gap for text in texts[:-1])])
    return np.concatenate([part for text in texts for part in (text, outside)] + [outside]), starts


class _Adam:
    def __init__(self, values: list[np.ndarray], rate: float):
        self.values, self.rate, self.step = values, rate, 0
        self.first = [np.zeros_like(v) for v in values]
        self.second = [np.zeros_like(v) for v in values]

    def move(self, k: int, gradient: np.ndarray, rows: slice | np.ndarray = slice(None)) -> None:
        """Move those rows of value ``k``; the moments of others stay as they are."""
        m = self.first[k][rows] * 0.9 + 0.1 * gradient
        s = self.second[k][rows] * 0.999 + 0.001 * gradient * gradient
        self.first[k][rows], self.second[k][rows] = m, s
        way = (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.999**self.step)) + 1e-8)
        self.values[k][rows] -= self.rate * way


def train(texts: list[np.ndarray], labels: np.ndarray, network: Network, settings: Settings) -> None:
    """Train on texts given as embedding rows."""
    draw = np.random.default_rng(settings.seed)
    gap, many = len(network.filters), settings.filters
    output = np.array([network.bias])
    adam = _Adam([network.embeddings, network.weights, output, *network.filters, *network.biases], settings.rate)
    order = np.zeros(0, dtype=int)
    for adam.step in range(1, settings.steps + 1):
        if len(order) < settings.batch:
            order = np.append(order, draw.permutation(len(texts)))
        picked, order = order[: settings.batch], order[settings.batch :]
        rows, starts = _laid_out([texts[i] for i in picked], gap)
        pooled = _pool(rows, starts, network)
        hidden = np.maximum(np.concatenate([answers for answers, _ in pooled], axis=1), 0)
        error = (_sigmoid(hidden @ network.weights + output[0]) - labels[picked]) / len(picked)
        back = error[:, None] * network.weights * (hidden > 0)
        adam.move(1, hidden.T @ error + settings.decay * network.weights)
        adam.move(2, error.sum(keepdims=True))
        touched, moves = [], []
        for k, (weights, (_, where)) in enumerate(zip(network.filters, pooled)):
            g = back[:, k * many : (k + 1) * many]
            grad = settings.decay * weights
            for j in range(len(weights)):
                seen = rows[where + j]
                grad[j] += np.einsum("bfd,bf->df", network.embeddings[seen], g)
                touched.append(seen.ravel())
                moves.append((g[:, :, None] * weights[j].T).reshape(-1, settings.embedding))
            adam.move(3 + k, grad)
            adam.move(3 + len(network.filters) + k, g.sum(axis=0))
        distinct, place = np.unique(np.concatenate(touched), return_inverse=True)
        gradient = np.zeros((len(distinct), settings.embedding))
        np.add.at(gradient, place, np.concatenate(moves))
        adam.move(0, gradient, distinct)
        network.embeddings[OUTSIDE] = 0
    network.bias = float(output[0])


def new_network(buckets: np.ndarray, settings: Settings) -> Network:
    draw = np.random.default_rng(settings.seed)
    size, many = settings.embedding, settings.filters
    embeddings = draw.normal(0, 0.3, (len(buckets) + 2, size))
    embeddings[OUTSIDE] = 0
    filters = [draw.normal(0, (width * size) ** -0.5, (width, size, many)) for width in settings.widths]
    biases = [np.zeros(many) for _ in settings.widths]
    weights = draw.normal(0, 0.3, many * len(settings.widths))
    return Network(buckets, embeddings, filters, biases, weights, 0.0)


def _calibrate(
    network: Network, logits: np.ndarray, labels: np.ndarray, spoken: np.ndarray, rows: np.ndarray, settings: Settings
) -> None:
    """A logistic fit and a threshold for each language, from ``rows`` texts of each logit, label and
    language; too small ones take those of all."""
    languages = network.language.shape[1]
    network.scale, network.shift = np.ones(languages), np.zeros(languages)
    network.threshold = np.full(languages, 1.0)

    def fit(x: np.ndarray, y: np.ndarray, many: np.ndarray) -> tuple[float, float, float]:
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps; a weak prior keeps the slope at hand where labels are noise
            p = _sigmoid(a * x + b)
            w = many * np.maximum(p * (1 - p), 1e-6)
            g = np.array([(many * (p - y) * x).sum() + 0.1 * (a - 1), (many * (p - y)).sum() + 0.01 * b])
            h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        a = max(a, 0.0)
        p = _sigmoid(a * x + b)
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum((many * y)[order])
        flagged = np.cumsum(many[order])
        last = np.append(np.diff(p[order]) != 0, True)  # of equal scores all are flagged
        f1 = np.where(last & (hits >= settings.precision * flagged) & (hits >= 3), 2 * hits / (flagged + hits[-1]), 0)
        best = int(np.argmax(f1))
        if f1[best] <= 0:
            return a, b, 1.0
        below = p[order][best + 1] if best + 1 < len(p) else 0.0
        return a, b, float(np.clip((p[order][best] + below) / 2, 1e-4, 1.0))

    whole = fit(logits, labels, rows)
    for k in range(languages):
        mine = spoken == k
        enough = rows[mine].sum() >= settings.least_language
        network.scale[k], network.shift[k], network.threshold[k] = fit(logits[mine], labels[mine], rows[mine]) if enough else whole


# --- scoring, in tasks -------------------------------------------------------------------


def _answers(network: Network, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Greatest answers of all filters for texts that begin at ``starts``, none of them empty.

    What a filter says of a word at a place is looked up, as embeddings of the words at hand times filters.
    """
    known, code = np.unique(np.append(rows, OUTSIDE), return_inverse=True)  # OUTSIDE is the least
    embeddings, rows = network.embeddings[known], code[:-1]
    owner_end = np.append(starts[1:], len(rows))
    longest = max(len(w) for w in network.filters)
    padded = np.append(rows, np.zeros(longest, dtype=rows.dtype))
    left = np.repeat(owner_end, owner_end - starts) - np.arange(len(rows))  # words to the end of the text
    out = []
    for weights, bias in zip(network.filters, network.biases):
        answers = (embeddings @ weights[0]).astype(np.float32)[rows]
        for j in range(1, len(weights)):
            behind = np.where(left > j, padded[j : j + len(rows)], OUTSIDE)
            answers += (embeddings @ weights[j]).astype(np.float32)[behind]
        out.append(np.maximum.reduceat(answers, starts, axis=0) + bias.astype(np.float32))
    return np.concatenate(out, axis=1)


def _output(network: Network, hidden: np.ndarray) -> np.ndarray:
    return hidden @ network.weights + network.bias


def score_texts(texts: pa.Array, network: Network) -> np.ndarray:
    """Scores of a batch of texts, ``TEXT_ROWS`` at a time."""
    parts = [_scores(texts.slice(at, TEXT_ROWS), network) for at in range(0, len(texts), TEXT_ROWS)]
    return np.concatenate([np.zeros(0), *parts])


def _scores(texts: pa.Array, network: Network) -> np.ndarray:
    hidden = np.zeros((len(texts), len(network.weights)), dtype=np.float32)
    spoken = np.zeros((len(texts), network.language.shape[1]))
    for words in word_blocks(texts, _CLASSES, max(len(w) for w in network.filters) - 1):
        if not len(words.code):
            continue
        rows = _rows(network, word_buckets(words.dictionary))[words.code]
        starts = np.flatnonzero(np.diff(words.row, prepend=-1))
        owner = words.row[starts]
        hidden[owner] = np.maximum(hidden[owner], _answers(network, rows, starts))
        spoken[owner] += np.add.reduceat(network.language[rows], starts, axis=0)
    language = np.argmax(spoken, axis=1)
    p = _sigmoid(network.scale[language] * _output(network, hidden) + network.shift[language])
    t = network.threshold[language]
    above = THRESHOLD + (1 - THRESHOLD) * (p - t) / np.maximum(1 - t, 1e-9)
    return np.where(p >= t, np.minimum(above, 1.0), THRESHOLD * p / t)


# --- the operator -------------------------------------------------------------------------


def _id_bits(labels: DataFrame, docs: DataFrame) -> np.ndarray:
    """Bits set at the hashes of all labelled ids, as 64-bit words; all of them if equal ids may hash apart."""
    kinds = {frame.schema["_id"].dataType.simpleString() for frame in (labels, docs)}
    if len(kinds) > 1 or not kinds <= {"tinyint", "smallint", "int", "bigint", "string"}:
        return np.full(ID_BITS // 64, -1, dtype=np.int64)
    found = labels.select(_id_hash().alias("h")).groupBy(F.expr("shiftright(h, 6)").alias("word"))
    found = found.agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(ID_BITS // 64, dtype=np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words


def _id_hash() -> Column:
    return F.pmod(F.xxhash64("_id"), F.lit(ID_BITS))


def training_rows(
    docs: DataFrame, labels: DataFrame, settings: Settings, id_column: str, text_column: str, lang_column: str
) -> DataFrame:
    """All labelled rows, as word buckets: ``_label``, ``_lang``, ``_hash`` of the id, ``_words``, and whether
    they are ``_held`` back for calibration.

    Texts become words where they are read, and only those whose id may have a label: of all others
    the join gets null words and drops them.
    """
    labels = labels.where("_id is not null and _label is not null")
    known = labels.groupBy("_id").agg((F.max("_label") > 0).cast("int").alias("_label"))
    rows = docs.select(
        F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), F.col(lang_column).alias("_lang")
    )
    bits = _id_bits(labels, rows)

    def words_of(texts: pa.Array) -> list[bytes]:
        found: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
        for words in word_blocks(texts, _CLASSES):
            of_word = word_buckets(words.dictionary).astype(np.uint32)[words.code]
            starts = np.flatnonzero(np.diff(words.row, prepend=-1))
            for row, part in zip(words.row[starts].tolist(), np.split(of_word, starts[1:])):
                found[row].append(part)
        return [np.concatenate(parts).tobytes() if parts else b"" for parts in found]

    @F.arrow_udf("binary")
    def buckets(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        at = hashes.to_numpy(zero_copy_only=False)
        maybe = np.flatnonzero(bits[at >> 6] >> (at & 63) & 1)
        found: list[bytes | None] = [None] * len(texts)
        for some in np.split(maybe, range(TEXT_ROWS, len(maybe), TEXT_ROWS)):
            for row, words in zip(some.tolist(), words_of(texts.take(pa.array(some)))):
                found[row] = words
        return pa.array(found, pa.binary())

    rows = rows.select("_id", "_lang", buckets("_text", _id_hash()).alias("_words")).join(known, "_id")
    # Of copies of a row one counts; their languages may differ.
    rows = rows.groupBy("_id", "_words").agg(F.max("_label").alias("_label"), F.min("_lang").alias("_lang"))
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(settings.seed), "_id"))
    return rows.withColumn("_held", F.pmod("_hash", F.lit(4)) == 0).drop("_id")


def _words_of(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(words, dtype=np.uint32).astype(np.int64) for words in batch.column("_words").to_pylist()]


def _empty_network(rows: DataFrame, settings: Settings) -> Network:
    """A network that knows the buckets of enough texts, and how often each is said in a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, held = batch.column("_lang").to_pylist(), batch.column("_held").to_pylist()
            texts = _words_of(batch)
            for lang in set(langs):
                mine = [k for k, of in enumerate(langs) if of == lang]
                said, times = np.unique(np.concatenate([texts[k] for k in mine]), return_counts=True)
                trained = [np.unique(texts[k]) for k in mine if not held[k]] or [np.zeros(0, dtype=np.int64)]
                found, many = np.unique(np.concatenate(trained), return_counts=True)
                in_texts = np.zeros(len(said), dtype=np.int64)
                in_texts[np.searchsorted(said, found)] = many
                columns = {"lang": pa.array([lang] * len(said), pa.string()), "bucket": said, "n": times, "texts": in_texts}
                yield pa.RecordBatch.from_pydict(columns)

    counted = rows.select("_lang", "_held", "_words").mapInArrow(count, "lang string, bucket long, n long, texts long")
    counted = materialize(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "buckets")
    known = materialize(counted.groupBy("bucket").agg(F.sum("texts").alias("t")).where(F.col("t") >= settings.least_texts), "known")
    buckets = np.sort(known.select("bucket").toArrow().column("bucket").to_numpy())
    network = new_network(buckets, settings)
    sizes = {row["_lang"]: row["count"] for row in rows.groupBy("_lang").count().collect()}
    names = sorted(lang for lang, n in sizes.items() if lang is not None and n >= settings.least_language) or [None]
    counts = np.ones((len(network.embeddings), len(names)))
    said = {row["lang"]: row["n"] for row in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    kept = counted.join(known, "bucket").select("lang", "bucket", "n").toArrow()
    langs = np.array(kept.column("lang").to_pylist(), dtype=object)
    for k, lang in enumerate(names):
        mine = np.array([of == lang for of in langs], dtype=bool)
        times = kept.column("n").to_numpy()[mine]
        counts[np.searchsorted(buckets, kept.column("bucket").to_numpy()[mine]) + 2, k] += times
        counts[RARE, k] += said.get(lang, 0) - times.sum()
    discard(counted, known)
    network.language = np.log(counts / counts.sum(axis=0))
    network.language[OUTSIDE] = 0
    return network


def _dense(network: Network) -> np.ndarray:
    """All that is trained but the embeddings."""
    return np.concatenate([network.weights, [network.bias], *map(np.ravel, network.filters), *network.biases])


def _set_dense(network: Network, values: np.ndarray) -> None:
    sizes = [len(network.weights), 1, *(f.size for f in network.filters), *(len(b) for b in network.biases)]
    weights, bias, *rest = np.split(values[: sum(sizes)], np.cumsum(sizes)[:-1])
    widths = len(network.filters)
    network.weights, network.bias = weights, float(bias[0])
    network.filters = [part.reshape(f.shape) for part, f in zip(rest, network.filters)]
    network.biases = rest[widths:]


def _train_round(dealt: DataFrame, network: Network, settings: Settings) -> Network:
    """The network after every group has trained it on its rows, averaged."""
    size = settings.embedding
    sent = dealt.sparkSession.sparkContext.broadcast(replace(network, language=np.zeros((2, 1))))
    names = [f"d{k}" for k in range(size)]

    def work(group: pa.Table) -> pa.Table:
        own, before = deepcopy(sent.value), sent.value
        texts, hashes = group.column("_words").to_pylist(), group.column("_hash").to_pylist()
        order = sorted(range(len(texts)), key=lambda k: (hashes[k], texts[k]))
        placed = [_rows(own, np.frombuffer(texts[k], dtype=np.uint32)).astype(np.int32) for k in order]
        del texts
        labels = group.column("_label").to_numpy().astype(np.float64)[order]
        steps = max(-(-settings.steps // settings.rounds), -(-len(placed) // settings.batch))
        train(placed, labels, own, replace(settings, steps=steps))
        moved = own.embeddings - before.embeddings
        rows = np.flatnonzero(moved.any(axis=1))
        dense = _dense(own) - _dense(before)
        dense = np.append(dense, np.zeros(-len(dense) % size)).reshape(-1, size)
        values = np.concatenate([moved[rows], dense])
        # What is no embedding has numbers below 0.
        numbers = np.concatenate([rows, -1 - np.arange(len(dense))])
        return pa.table([pa.array(numbers), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(size))], names=["row", *names])

    schema = ", ".join(["row long", *(f"{name} double" for name in names)])
    found = dealt.groupBy("_group").applyInArrow(work, schema).groupBy("row").agg(*[F.avg(c).alias(c) for c in names])
    found = materialize(found, "moved")
    sent.destroy()  # its files lie with the driver and with every executor
    moved = found.toArrow()
    discard(found)
    rows, values = moved.column("row").to_numpy(), np.stack([moved.column(c).to_numpy() for c in names], axis=1)
    network = deepcopy(network)
    network.embeddings[rows[rows >= 0]] += values[rows >= 0]
    inner = values[rows < 0][np.argsort(-rows[rows < 0])].ravel()
    _set_dense(network, _dense(network) + inner[: len(_dense(network))])
    return network


def _held_back(held: DataFrame, network: Network) -> list[np.ndarray]:
    """Of the rows held back: outputs, labels, languages and how many rows have them."""
    sent = held.sparkSession.sparkContext.broadcast(network)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            placed = [_rows(own, words) for words in _words_of(batch)]
            hidden = np.zeros((len(placed), len(own.weights)))
            spoken = [int(np.argmax(own.language[place].sum(axis=0))) for place in placed]
            waiting: list[tuple[int, np.ndarray]] = []

            def pooled() -> None:
                # Filters meet every embedding once, so many texts go together.
                starts = np.cumsum([0, *(len(part) for _, part in waiting[:-1])])
                for (k, _), found in zip(waiting, _answers(own, np.concatenate([part for _, part in waiting]), starts)):
                    hidden[k] = np.maximum(hidden[k], found)
                waiting.clear()

            size = 0
            for k, place in enumerate(placed):
                for at in range(0, len(place), BLOCK_WORDS):
                    waiting.append((k, place[at : at + BLOCK_WORDS + len(own.filters) - 1]))
                    size += len(waiting[-1][1])
                    if size >= BLOCK_WORDS:
                        pooled()
                        size = 0
            if waiting:
                pooled()
            bins = np.rint(np.clip(_output(own, hidden), -30, 30) * BINS).astype(np.int64)
            columns = {"bin": pa.array(bins, pa.int64()), "spoken": pa.array(spoken, pa.int64()), "label": batch.column("_label")}
            yield pa.RecordBatch.from_pydict(columns)

    found = held.select("_words", "_label").mapInArrow(answer, "bin long, spoken long, label int")
    found = found.groupBy("bin", "label", "spoken").count().sort("bin", "label", "spoken").toArrow()
    sent.destroy()
    logits, labels, spoken, rows = (column.to_numpy() for column in found.columns)
    return [logits / BINS, labels.astype(np.float64), spoken, rows.astype(np.float64)]


def toxicity_score(text: Column, network: Network) -> Column:
    """The score of a text, from 0 to 1; 0.7 is the calibrated threshold of its language."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(texts, network), pa.float64())

    return score(text)


def learn_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    label_id_column: str = "doc_id",
    label_column: str = "toxic",
) -> Network:
    """The classifier that the labelled ones of ``docs`` give."""
    narrow = labels.select(F.col(label_id_column).alias("_id"), F.col(label_column).alias("_label"))
    rows = materialize(training_rows(docs, narrow, settings, id_column, text_column, lang_column), "labelled")
    kinds = {(row["_held"], row["_label"]): row["count"] for row in rows.groupBy("_held", "_label").count().collect()}
    if len(kinds) < 4:
        network = new_network(np.zeros(0, dtype=np.int64), settings)
        network.weights[:] = 0
        toxic = sum(n for (_, label), n in kinds.items() if label)
        share = min(toxic / max(1, sum(kinds.values())), 0.5)
        network.bias = float(np.log(max(share, 1e-4) / (1 - share)))
    else:
        network = _empty_network(rows, settings)
        trained = sum(n for (held, _), n in kinds.items() if not held)
        groups = max(1, round(trained / settings.group_rows))
        dealt = rows.where("not _held").withColumn("_group", F.pmod(F.xxhash64("_hash"), F.lit(groups)))
        for _ in range(settings.rounds):
            network = _train_round(dealt.select("_group", "_hash", "_label", "_words"), network, settings)
        logits, labels_, spoken, many = _held_back(rows.where("_held"), network)
        _calibrate(network, logits, labels_, spoken, many, settings)
    discard(rows)
    return network
