"""Languages of texts by character models with interpolated Kneser-Ney smoothing.

A text is its words: runs of letters, lower-cased, with start marks before and an end
mark behind. Per language, the 4-grams of all training texts are counted; each task
counts its distinct words first, and counts of equal grams are added up in the shuffle.
The highest order uses the counts, a lower one the number of distinct characters seen before
a gram. Each order takes its discount D = n1 / (n1 + 2 n2) from its own numbers of
grams seen once and twice. A model holds, per order, a sorted array of gram hashes with
log-probabilities, and one of context hashes with the logs of back-off weights. Both are
computed by joins, written to shared scratch space in ranges of hashes, and mapped from
there by the tasks that score, which search them by bisection: no gram goes through the driver
or has to fit a task's memory.

A text goes to the language of the lowest cross-entropy per character. ``score`` is that
language's share if entropies are scaled by a factor fitted on training texts; ``rejected``
marks a text whose entropy lies above that of all training texts of the language. Neither
changes the choice.

Counts cover all training texts, and a model keeps all grams. ``max_grams``, if it is given,
leaves each order the grams of the highest counts, at most so many; contexts and their
back-off weights all stay. The factor and the bound are fitted on all distinct training texts,
as sums and maxima that are added up in the shuffle; ``calibration_texts``, if it is given, leaves
each language at most so many, those of the least hashes.

Texts that are null or have no letter are ``und`` with score 0. Training rows with a null
text or language are passed over; without any, all texts are ``und``. Equal texts get equal
results. Other columns of the input are passed on; names that the result adds are refused.
"""

from __future__ import annotations

import bisect
import json
import math
import re
import tempfile
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem, copy_files
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import materialize, scratch_path

ORDER = 4
# Rows of one order in a hash range of a stored model, about.
PART_ROWS = 250_000
# Factors of entropies that are tried.
SCALES = tuple(2.0**k for k in range(-2, 8))
UNDETERMINED = "und"
START, END = "\x01", "\x02"
_WORD = re.compile(r"[^\W\d_]+")
_NO_LETTER = re.compile(r"[\W\d_]")
_STEP = 0x9E3779B97F4A7C15
# Characters of text that are worked on at a time.
PIECE_CHARS = 1 << 21


def words_of(text: str | None) -> list[str]:
    words = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    # A few characters, such as superscript digits, are neither digits nor letters.
    letters = ("".join(filter(str.isalpha, word)) for word in words)
    return [word for word in letters if word]


def pieces(texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
    """Words of texts with the text's number, in pieces of about ``PIECE_CHARS``. Longer
    texts are cut between words."""
    piece, size = [], 0
    for number, text in enumerate(texts):
        text, at = text or "", 0
        while at < len(text):
            stop = len(text)
            if stop - at > PIECE_CHARS:
                found = _NO_LETTER.search(text, at + PIECE_CHARS)
                stop = found.start() if found else stop
            piece.append((number, words_of(text[at:stop])))
            size += stop - at
            at = stop
            if size >= PIECE_CHARS:
                yield piece
                piece, size = [], 0
    if piece:
        yield piece


# --- training ------------------------------------------------------------------------------


def count_grams(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    """``lang``, ``gram`` of ``ORDER`` characters and its count ``n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            all_grams: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
            for piece in pieces(batch.column("text").to_pylist()):
                words: dict[str, Counter] = defaultdict(Counter)
                for number, found in piece:
                    words[langs[number]].update(found)
                for lang, counts in words.items():
                    grams = all_grams[lang]
                    for word, n in counts.items():
                        padded = START * (ORDER - 1) + word + END
                        for at in range(len(word) + 1):
                            grams[padded[at : at + ORDER]] += n
            for lang, grams in all_grams.items():
                columns = {
                    "lang": pa.array([lang] * len(grams), pa.string()),
                    "gram": pa.array(list(grams), pa.string()),
                    "n": pa.array(list(grams.values()), pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def order_tables(counts: DataFrame) -> dict[int, DataFrame]:
    """Per order: ``lang``, ``gram``, ``n``, and of its context the total ``n`` and the number
    of distinct ``followers``."""
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        above = tables[order + 1]
        table = above.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        tables[order] = materialize(table, f"grams-{order}")
    return tables


def _bounded(table: DataFrame, max_grams: int) -> DataFrame:
    """The grams of each language with the highest counts, at most ``max_grams`` of them."""
    top = 1 << 20
    histogram = table.groupBy("lang", F.least("n", F.lit(top)).alias("n")).agg(F.count("*").alias("grams"))
    running = F.sum("grams").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    least = histogram.withColumn("kept", running).where(F.col("kept") <= max_grams)
    least = least.groupBy(F.col("lang").alias("of")).agg(F.min("n").alias("least"))
    bound = F.broadcast(least)
    return table.join(bound, (table["lang"] == bound["of"]) & (table["n"] >= bound["least"])).drop("of", "least")


def _probabilities(counts: DataFrame, max_grams: int | None) -> tuple[DataFrame, DataFrame]:
    """All entries of the models: ``kind`` (``gram`` or ``context``), ``order``, ``lang``,
    ``hash`` and the log ``value``; and the ``floor`` of each ``lang``."""
    tables = order_tables(counts)
    once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    floors = tables[1].groupBy("lang").agg(F.log(1 / (F.count("*") + 1)).alias("floor"))
    lower = floors.withColumnRenamed("floor", "lower")
    parts = []
    for order in range(1, ORDER + 1):
        discount = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5).alias("discount")
        discounts = F.broadcast(tables[order].groupBy("lang").agg(discount))
        table = tables[order].withColumn("context", F.expr(f"substring(gram, 1, {order - 1})"))
        totals = table.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("followers"))
        share = F.col("discount") * F.col("followers") / F.col("total")
        totals = totals.join(discounts, "lang").withColumn("backoff", F.log(F.greatest(share, F.lit(1e-12))))
        totals = materialize(totals.drop("followers"), "contexts")
        # The next lower order has every gram's end, and order 0 is the floor.
        table = table.withColumn("end", F.expr("substring(gram, 2)")).join(totals, ["lang", "context"])
        table = table.join(lower if order > 1 else F.broadcast(lower), ["lang", "end"] if order > 1 else "lang")
        own = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")
        value = F.log(own + F.exp(F.col("backoff") + F.col("lower"))).alias("value")
        values = materialize(table.select("lang", "gram", "n", value), f"values-{order}")
        lower = values.select("lang", F.col("gram").alias("end"), F.col("value").alias("lower"))
        kept = values if max_grams is None else _bounded(values, max_grams)
        named = lambda kind: [F.lit(kind).alias("kind"), F.lit(order).alias("order"), "lang"]  # noqa: B023, E731
        parts.append(kept.select(*named("gram"), _hash_column(order)("gram").alias("hash"), "value"))
        context = _hash_column(order - 1)("context").alias("hash")
        parts.append(totals.select(*named("context"), context, F.col("backoff").alias("value")))
    return reduce(DataFrame.unionByName, parts), floors


def _hash_column(order: int):
    """A column function: hashes of grams of ``order`` characters each."""

    @F.arrow_udf("long")
    def hashed(grams: pa.Array) -> pa.Array:
        return pa.array(_hash_all(grams.to_pylist(), order).view(np.int64))

    return hashed


# --- models ---------------------------------------------------------------------------------


class Table:
    """Sorted hashes and their values, in parts by the ``bits`` highest bits of the hash."""

    def __init__(self, bits: int = 0, parts: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        self.bits, self.parts = bits, parts or {}

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of hashes, and which have one."""
        values, hit = np.zeros(len(wanted)), np.zeros(len(wanted), dtype=bool)
        if not self.bits:
            groups = [(0, slice(None))]
        else:
            part = (wanted >> np.uint64(64 - self.bits)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange((1 << self.bits) + 1))
            groups = [(k, order[cuts[k] : cuts[k + 1]]) for k in self.parts]
        for k, rows in groups:
            keys, stored = self.parts.get(k, (None, None))
            if keys is None or not len(keys):
                continue
            here = wanted[rows]
            at = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
            same = keys[at] == here
            values[rows] = np.where(same, stored[at], 0.0)
            hit[rows] = same
        return values, hit

    def __getitem__(self, column: int) -> np.ndarray:
        """All hashes (0) or all values (1) as one array."""
        if column not in (0, 1):
            raise IndexError(column)
        kinds = (np.uint64, np.float64)
        return np.concatenate([np.zeros(0, kinds[column]), *(self.parts[k][column] for k in sorted(self.parts))])


@dataclass
class Model:
    """Of each order: hashes of grams and their log-probabilities, hashes of contexts and the
    logs of their back-off weights. ``floor``: of an unknown character."""

    grams: list[Table]
    contexts: list[Table]
    floor: float


@dataclass
class Stored:
    """Models as files in shared scratch space: ``kind``, order, number of the hash range and
    path of each. What is sent to executors is this and no gram."""

    files: list[tuple[str, int, int, str]]
    bits: int
    floors: dict[str, float]

    def load(self) -> dict[str, Model]:
        """The models, over arrays that are mapped from the files and not read."""
        found: dict[tuple, dict[int, tuple]] = defaultdict(dict)
        for kind, order, part, path in self.files:
            data = _mapped(path)
            size = int(data[:8].view(np.int64)[0])
            for lang, (at, n) in json.loads(data[8 : 8 + size].tobytes()).items():
                keys, values = data[at : at + 8 * n], data[at + 8 * n : at + 16 * n]
                found[kind, order, lang][part] = keys.view(np.uint64), values.view(np.float64)
        orders = range(1, ORDER + 1)
        of = lambda kind, lang: [Table(self.bits, found.get((kind, k, lang))) for k in orders]
        return {lang: Model(of("gram", lang), of("context", lang), floor) for lang, floor in self.floors.items()}


def _mapped(path: str) -> np.ndarray:
    """A file's bytes. One that is in no local folder is copied first, and the copy goes
    with the map."""
    store, inner = FileSystem.from_uri(path)
    if isinstance(store, LocalFileSystem):
        return np.asarray(np.memmap(inner, np.uint8, "r"))
    with tempfile.NamedTemporaryFile() as copy:
        copy_files(inner, copy.name, source_filesystem=store, destination_filesystem=LocalFileSystem())
        return np.asarray(np.memmap(copy.name, np.uint8, "r"))


def _write_part(path: str, langs: np.ndarray, hashes: np.ndarray, values: np.ndarray) -> None:
    """One hash range of one order: after a header, the sorted hashes and values of each language."""
    names, number = np.unique(langs, return_inverse=True)
    order = np.lexsort((hashes, number))
    cuts = np.searchsorted(number[order], np.arange(len(names) + 1))
    found = {}
    for lang, start, stop in zip(names.tolist(), cuts, cuts[1:]):
        keys, first = np.unique(hashes[order[start:stop]], return_index=True)
        found[lang] = keys, values[order[start:stop]][first]
    # Eight bytes, the header, and a multiple of eight bytes for each array.
    room = -(-(len(json.dumps({lang: [1 << 60, 1 << 60] for lang in found})) + 8) // 8) * 8
    index, at = {}, room
    for lang, (keys, _) in found.items():
        index[lang] = at, len(keys)
        at += 16 * len(keys)
    header = json.dumps(index).encode().ljust(room - 8)
    store, inner = FileSystem.from_uri(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(inner) as out:
        out.write(np.int64(len(header)).tobytes() + header)
        for keys, values_ in found.values():
            out.write(keys.tobytes())
            out.write(values_.tobytes())


def _store(entries: DataFrame, floors: DataFrame) -> Stored:
    """Write the entries in hash ranges of about ``PART_ROWS`` rows of one order."""
    spark = entries.sparkSession
    entries = materialize(entries, "entries")
    largest = max((row["count"] for row in entries.groupBy("kind", "order").count().collect()), default=0)
    bits = min(max(math.ceil(largest / PART_ROWS) - 1, 0).bit_length(), 12)
    part = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "language-models"))
    folder = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toUri().toString()
    folder = re.sub("^file:/+", "file:///", folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "order", "part")

        def put(group: tuple, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows)
            langs = np.array(whole.column("lang").to_pylist(), dtype=object)
            # A name of its own: another attempt of the task leaves this file alone.
            path = f"{folder}/{group[0]}-{group[1]}-{group[2]}-{uuid.uuid4().hex}"
            _write_part(path, langs, whole.column("hash").to_numpy().view(np.uint64), whole.column("value").to_numpy())
            return pa.RecordBatch.from_pylist([{**dict(zip(names, group)), "path": path}], out_schema)

        out_schema = pa.schema([("kind", pa.string()), ("order", pa.int32()), ("part", pa.int64()), ("path", pa.string())])
        waiting, last = [], None
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in names)))
            start = 0
            while start < len(groups):
                stop = bisect.bisect_right(groups, groups[start], lo=start)
                if waiting and groups[start] != last:
                    yield put(last, waiting)
                    waiting = []
                waiting.append(batch.slice(start, stop - start))
                start, last = stop, groups[start]
        if waiting:
            yield put(last, waiting)

    keys = ["kind", "order", "part"]
    dealt = entries.withColumn("part", part).repartition(*keys).sortWithinPartitions(*keys)
    written = dealt.mapInArrow(write, "kind string, order int, part long, path string").collect()
    floor = {row["lang"]: row["floor"] for row in floors.sort("lang").collect()}
    return Stored([tuple(row) for row in written], bits, floor)


def _hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the grams of 0 to ``order`` characters that end at each code point."""
    total = np.zeros(len(points), dtype=np.uint64)
    out, factor = [total], 1
    for back in range(order):
        moved = np.zeros(len(points), dtype=np.uint64)
        moved[back:] = points[: len(points) - back]
        total = total + (moved + np.uint64(1)) * np.uint64(factor)
        factor = factor * _STEP % (1 << 64)
        mixed = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(mixed ^ (mixed >> np.uint64(32)))
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _hash_all(grams: list[str], order: int) -> np.ndarray:
    """Hashes of grams of ``order`` characters each."""
    if order == 0:
        return np.zeros(len(grams), dtype=np.uint64)
    return _hashes(_points("".join(grams)), order)[order][order - 1 :: order]


def store_models(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", max_grams: int | None = None
) -> Stored:
    """A model per language of ``docs``, as files."""
    counts = materialize(count_grams(docs, text_column, lang_column), "grams")
    return _store(*_probabilities(counts, max_grams))


def train(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", max_grams: int | None = None
) -> dict[str, Model]:
    """A model per language of ``docs``."""
    return store_models(docs, text_column, lang_column, max_grams).load()


# --- scoring -------------------------------------------------------------------------------


def _gram_scores(model: Model, hashes: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
    """Log-probability under a model of the last character of each gram, given those before it."""
    size = len(hashes[1])
    out = np.zeros(size)
    open_ = np.arange(size)
    for order in range(ORDER, 0, -1):
        values, hit = model.grams[order - 1].find(hashes[order][open_])
        out[open_] += values
        open_ = open_[~hit]
        if not len(open_):
            break
        # A context that was never seen has a back-off weight of 1.
        out[open_] += model.contexts[order - 1].find(before[order - 1][open_])[0]
    out[open_] += model.floor
    return out


def entropies(texts: list[str | None], models: dict[str, Model]) -> np.ndarray:
    """Cross-entropy in nats per character of each text (rows) in each language; NaN
    for texts without a letter."""
    sums, chars = np.zeros((len(texts), len(models))), np.zeros(len(texts))
    if not models:
        return sums
    for piece in pieces(texts):
        number: dict[str, int] = {}
        found = [(row, [number.setdefault(word, len(number)) for word in words]) for row, words in piece if words]
        if not number:
            continue
        points = _points("".join(START * (ORDER - 1) + word + END for word in number))
        lengths = np.array([len(word) + 1 for word in number])
        # Characters that are predicted: all but the start marks.
        keep = points != ord(START)
        all_hashes = _hashes(points, ORDER)
        # A gram's score is that of all its places, and sorted hashes are found faster.
        _, first, gram = np.unique(all_hashes[ORDER][keep], return_index=True, return_inverse=True)
        hashes = [h[keep][first] for h in all_hashes]
        before = [np.concatenate([h[:1], h[:-1]])[keep][first] for h in all_hashes]
        starts = np.cumsum(lengths) - lengths
        of_gram = (_gram_scores(model, hashes, before) for model in models.values())
        scores = np.stack([np.add.reduceat(values[gram], starts) for values in of_gram], axis=1)
        for row, numbers in found:
            used = np.array(numbers)
            sums[row] -= scores[used].sum(axis=0)
            chars[row] += lengths[used].sum()
    return np.where(chars[:, None] > 0, sums / np.maximum(chars, 1)[:, None], np.nan)


def _choose(values: np.ndarray, langs: list[str], scale: float, bounds: dict[str, float]):
    """Language, score, entropy and rejection of each row of entropies."""
    known = ~np.isnan(values[:, 0]) if values.shape[1] else np.zeros(len(values), dtype=bool)
    best = np.where(known, np.argmin(np.where(np.isnan(values), np.inf, values), axis=1), 0) if values.shape[1] else known * 0
    for row, is_known in enumerate(known):
        if not is_known:
            yield UNDETERMINED, 0.0, None, True
            continue
        lowest = float(values[row, best[row]])
        share = 1 / float(np.exp(-scale * (values[row] - lowest)).sum())
        yield langs[best[row]], share, lowest, lowest > bounds.get(langs[best[row]], math.inf)


def _losses(values: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How unlikely texts with these entropies are in languages where they have ``own``, under
    each of ``SCALES`` (columns)."""
    lowest = values.min(axis=1)
    of = lambda scale: np.log(np.exp(-scale * (values - lowest[:, None])).sum(axis=1)) + scale * (own - lowest)
    return np.stack([of(scale) for scale in SCALES], axis=1)


def calibrate(values: np.ndarray, true: np.ndarray, langs: list[str]) -> tuple[float, dict[str, float]]:
    """The factor under which the languages ``true`` (numbers) of texts with these entropies are
    likeliest, and the highest entropy of a text in its own language."""
    usable = ~np.isnan(values[:, 0]) if len(values) else np.zeros(0, dtype=bool)
    values, true = values[usable], true[usable]
    if not len(values):
        return 1.0, {}
    own = values[np.arange(len(true)), true]
    scale = SCALES[int(np.argmin(_losses(values, own).sum(axis=0)))]
    return scale, {lang: float(own[true == k].max()) for k, lang in enumerate(langs) if (true == k).any()}


def _calibrate_on_all(training: DataFrame, text_column: str, lang_column: str, models) -> tuple[float, dict[str, float]]:
    """``calibrate`` over all distinct texts per language. Texts are scored where they are read, and one row
    per language comes to the driver."""
    rows = training.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).dropna()
    names = [f"loss{k}" for k in range(len(SCALES))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _loaded(models)
        number = {lang: k for k, lang in enumerate(loaded)}
        for batch in batches:
            langs, hashes = batch.column("lang").to_pylist(), batch.column("hash").to_pylist()
            # A training row without letters may be the only one of its language.
            fresh = {(lang, h): k for k, (lang, h) in enumerate(zip(langs, hashes)) if lang in number}
            fresh = np.fromiter(fresh.values(), np.int64, len(fresh))
            values = entropies(batch.column("text").take(pa.array(fresh)).to_pylist(), loaded)
            usable = ~np.isnan(values[:, 0]) if len(fresh) else np.zeros(0, dtype=bool)
            fresh, values = fresh[usable], values[usable]
            if not len(fresh):
                continue
            own = values[np.arange(len(fresh)), [number[langs[k]] for k in fresh.tolist()]]
            kept = batch.select(["lang", "hash"]).take(pa.array(fresh))
            arrays = [*kept.columns, pa.array(own), *map(pa.array, _losses(values, own).T.copy())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "hash", "own", *names])

    schema = ", ".join(["lang string, hash long, own double", *(f"{name} double" for name in names)])
    scored = rows.select("lang", F.xxhash64("text").alias("hash"), "text").mapInArrow(score, schema)
    scored = scored.groupBy("lang", "hash").agg(*[F.first(c).alias(c) for c in ["own", *names]])
    found = scored.groupBy("lang").agg(F.max("own").alias("own"), *[F.sum(c).alias(c) for c in names]).collect()
    if not found:
        return 1.0, {}
    scale = SCALES[int(np.argmin([sum(row[c] for row in found) for c in names]))]
    return scale, {row["lang"]: row["own"] for row in found}


def _sample_entropies(training: DataFrame, text_column: str, lang_column: str, texts: int, models) -> tuple:
    """Entropies of ``texts`` distinct texts per language, those of the least hashes, and the
    numbers of their languages. Only these numbers come to the driver."""
    rows = training.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).dropna()
    rows = rows.withColumn("hash", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    drawn = rows.select("lang", "hash").distinct().withColumn("place", place).where(F.col("place") <= texts)
    bounds = drawn.groupBy(F.col("lang").alias("of")).agg(F.max("hash").alias("most"))
    bounds = F.broadcast(materialize(bounds, "sample"))
    sample = rows.join(bounds, (rows["lang"] == bounds["of"]) & (rows["hash"] <= bounds["most"]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, loaded = set(), _loaded(models)
        for batch in batches:
            names = list(zip(batch.column("lang").to_pylist(), batch.column("hash").to_pylist()))
            fresh = [k for k, name in enumerate(names) if not (name in done or done.add(name))]
            values = entropies(batch.column("text").take(pa.array(fresh, pa.int64())).to_pylist(), loaded)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([names[k][0] for k in fresh], pa.string()),
                    "hash": pa.array([names[k][1] for k in fresh], pa.int64()),
                    "entropies": pa.array(list(values), pa.list_(pa.float64())),
                }
            )

    found = sample.select("lang", "hash", "text").mapInArrow(score, "lang string, hash long, entropies array<double>")
    found = found.dropDuplicates(["lang", "hash"]).collect()
    number = {lang: k for k, lang in enumerate(models.value.floors)}
    # A training row without letters may be the only one of its language.
    found = [row for row in found if row["lang"] in number]
    values = np.array([row["entropies"] for row in found], dtype=np.float64).reshape(len(found), len(number))
    return values, np.array([number[row["lang"]] for row in found], dtype=np.int64)


_LOADED: dict[tuple, dict[str, Model]] = {}


def _loaded(sent) -> dict[str, Model]:
    """The stored models of a broadcast, mapped once per process."""
    stored = sent.value
    key = tuple(path for *_, path in stored.files)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = stored.load()
    return _LOADED[key]


def identify(
    docs: DataFrame,
    training: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    max_grams: int | None = None,
    calibration_texts: int | None = None,
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``entropy`` and ``rejected``, by models of
    ``training``."""
    if clash := {"lang_pred", "score", "entropy", "rejected", "_found"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    # File names, and one number per language.
    sent = docs.sparkSession.sparkContext.broadcast(store_models(training, text_column, lang_column, max_grams))
    if calibration_texts is None:
        scale, bounds = _calibrate_on_all(training, text_column, lang_column, sent)
    else:
        sample = _sample_entropies(training, text_column, lang_column, calibration_texts, sent)
        scale, bounds = calibrate(*sample, list(sent.value.floors))

    @F.arrow_udf("struct<lang_pred:string,score:double,entropy:double,rejected:boolean>")
    def find(batch: pa.Array) -> pa.Array:
        models = _loaded(sent)
        rows = _choose(entropies(batch.to_pylist(), models), list(models), scale, bounds)
        fields = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        names = ("lang_pred", "score", "entropy", "rejected")
        return pa.StructArray.from_arrays([pa.array(list(x), kind) for x, kind in zip(fields, kinds)], list(names))

    return docs.withColumn("_found", find(text_column)).select(*docs.columns, "_found.*")
