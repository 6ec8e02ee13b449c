"""Phrases that stand together often, by Toivonen's mining.

Texts are lower-cased (A to Z only), cut into pieces at ``.,;:!?`` and line ends, and those
into words at blanks and tabs. A phrase is up to four neighbouring words of a piece. No phrase
occurs more often than the phrases inside it, so only such can be frequent of which all
parts are.

A sample of the rows proposes: every phrase that it holds a few times. One pass over all rows
then counts exactly the proposed phrases and their negative border, the phrases that are not
proposed but whose parts all are (of single words, all). A border phrase that turns out to be
frequent is a failure: its extensions may be frequent and uncounted. The full pass is taken twice, by
hashes first, so that words are written out only for phrases whose hash is frequent. A further pass
counts every phrase around an occurrence of a failed one that has not been counted yet. Any
uncounted frequent phrase holds a failed one, so this closes the border, whatever the sample
was; the sample decides the work and never what is found.

Proposed and failed phrases are known to the tasks by bit maps of ``BITS`` bits, two for each phrase,
whatever their number. Bits that meet by chance let further phrases be counted,
exactly too, and hide none. Counts are summed in each block of a task first, so a phrase that
stands in a third of all rows is a few rows for the shuffle. The sample's phrases are shuffled
as hashes. Very long texts are worked on in parts that overlap by three words.

Null and empty texts have no words; a null language is ``und``. Equal rows count each. An
empty table gives an empty result. Other columns do not matter, whatever their names. Scores are
exact: the product is a decimal of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pagemill.llm.word_arrays import Words, byte_classes, word_blocks
from pagemill.session import discard, materialize

LONGEST = 4
BITS = 1 << 26
# Share of the rows in the sample. A phrase is proposed that stands in it as often as a phrase that
# is just frequent would on average: a lower bar would propose, and have counted, far more that are not.
SAMPLE_SHARE = 0.125
# Parts that candidates of a language are ranked in before the last ranking.
RANK_PARTS = 16

# Bytes of texts that are counted together: what a task keeps is some forty times that.
COUNTED_BYTES = 2 << 20

_CLASSES = byte_classes(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
_COUNTED = "lang string, words int, phrase string, hash long, n long, proposed boolean"


# --- bit maps ------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _extend(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on by a word."""
    return _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + words)


class PhraseMap:
    """Which phrases belong to a set, or may by chance."""

    def __init__(self):
        self.cells = np.zeros(BITS // 64, dtype=np.uint64)

    @staticmethod
    def places(hashes: np.ndarray) -> list[np.ndarray]:
        """Two bits for each hash."""
        return [hashes % np.uint64(BITS), (hashes >> np.uint64(32)) % np.uint64(BITS)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for place in self.places(hashes):
            found &= (self.cells[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def phrase_map(hashes: DataFrame) -> PhraseMap:
    """The map of a column ``hash``. Cells are set on the executors and joined there; at most
    BITS / 64 of them come to the driver, 16 MB."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(np.concatenate(PhraseMap.places(batch.column(0).to_numpy().view(np.uint64))))
            cell, first = np.unique(place >> np.uint64(6), return_index=True)
            bits = np.uint64(1) << (place & np.uint64(63))
            joined = np.bitwise_or.reduceat(bits, first) if len(bits) else bits
            columns = [pa.array(cell.astype(np.int64)), pa.array(joined.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "bits"])

    found = hashes.select("hash").mapInArrow(cells, "cell long, bits long")
    # Written, so that the shuffle files behind it go at once.
    table = materialize(found.groupBy("cell").agg(F.bit_or("bits").alias("bits")), "cells")
    found, out = table.toArrow(), PhraseMap()
    discard(table)
    out.cells[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


# --- counting, in tasks ----------------------------------------------------------------------


class _Phrases:
    """The phrases of a block by where they begin, from one word to ``LONGEST``."""

    def __init__(self, words: Words, lang: np.ndarray, langs: list[str]):
        self.words, self.langs = words, langs
        self.lang = lang[words.row]
        size = max(1, len(words.dictionary))
        # A word of one language is one thing, whatever it is in another.
        key = self.lang * size + words.code
        if len(langs) * size <= 8 * len(key) + 1024:
            seen = np.zeros(len(langs) * size, dtype=bool)
            seen[key] = True
            self.distinct = np.flatnonzero(seen)
            self.word = (np.cumsum(seen) - 1)[key]
        else:
            self.distinct, self.word = np.unique(key, return_inverse=True)
        texts = words.dictionary.take(pa.array(self.distinct % size)).to_pylist()
        spoken = self.distinct // size
        starts = np.flatnonzero(np.diff(spoken, prepend=-1)).tolist()
        self.word_hash = np.zeros(len(texts), dtype=np.uint64)
        for start, stop in zip(starts, [*starts[1:], len(texts)]):
            seed = xxhash.xxh64_intdigest(langs[spoken[start]].encode())
            hashes = (xxhash.xxh64_intdigest(w, seed) for w in texts[start:stop])
            self.word_hash[start:stop] = np.fromiter(hashes, np.uint64, stop - start)
        self.first = self.word_hash[self.word]

    def whole(self, n: int) -> np.ndarray:
        """Whether n words from each place on are in one piece; for all places that leave n words."""
        piece = self.words.piece
        return piece[: max(0, len(piece) - n + 1)] == piece[n - 1 :]

    def longer(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of n words from those of n - 1, for all places that leave n words."""
        return _extend(hashes[: max(0, len(self.first) - n + 1)], self.first[n - 1 :])

    def counts(self, places: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the phrases of n words that begin at ``places``: a place, the hash and the count.
        Only equal words are counted together; phrases that share a hash may come in several rows."""
        own = self.words.own[places]
        places, hashes = places[own], hashes[own]
        order = np.argsort(hashes, kind="stable")
        places, hashes = places[order], hashes[order]
        change = np.ones(len(places), dtype=bool)
        change[1:] = hashes[1:] != hashes[:-1]
        for k in range(n):
            word = self.word[places + k]
            change[1:] |= word[1:] != word[:-1]
        start = np.flatnonzero(change)
        return places[start], hashes[start], np.diff(start, append=len(places))

    def rows(self, places: np.ndarray, hashes: np.ndarray, n: int, proposed: PhraseMap | None) -> pa.RecordBatch:
        places, hashes, counts = self.counts(places, hashes, n)
        parts = [self.words.dictionary.take(pa.array(self.words.code[places + k])) for k in range(n)]
        text = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]
        known = proposed.has(hashes) if proposed else np.ones(len(places), dtype=bool)
        columns = [
            pa.array(self.langs).take(pa.array(self.lang[places])),
            pa.array(np.full(len(places), n, dtype=np.int32)),
            text.cast(pa.large_string()).cast(pa.string()),
            pa.array(hashes.view(np.int64)),
            pa.array(counts.astype(np.int64)),
            pa.array(known),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "hash", "n", "proposed"])


def _hash_rows(hashes: np.ndarray, n: int) -> pa.RecordBatch:
    kept, counts = np.unique(hashes, return_counts=True)
    columns = [pa.array(kept.view(np.int64)), pa.array(np.full(len(kept), n, dtype=np.int32)), pa.array(counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["hash", "words", "n"])


def _sampled(found: _Phrases) -> Iterator[pa.RecordBatch]:
    """Hashes and counts of all phrases."""
    hashes = found.first
    for n in range(1, LONGEST):  # the longest have no extension, so nobody asks whether they are proposed
        if n > 1:
            hashes = found.longer(hashes, n)
        yield _hash_rows(hashes[found.whole(n) & found.words.own[: len(hashes)]], n)


def _proposed_and_border(found: _Phrases, proposed: PhraseMap) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By length: the places and the hashes of the phrases whose parts are all proposed."""
    hashes = found.first
    yield 1, np.arange(len(hashes)), hashes
    known = proposed.has(found.word_hash)[found.word]
    for n in range(2, LONGEST + 1):
        hashes = found.longer(hashes, n)
        places = np.flatnonzero(known[: len(hashes)] & known[1 : len(hashes) + 1] & found.whole(n))
        yield n, places, hashes[places]
        known = np.zeros(len(hashes), dtype=bool)
        known[places] = proposed.has(hashes[places])


def _border_hashes(found: _Phrases, proposed: PhraseMap) -> Iterator[pa.RecordBatch]:
    """Hashes and counts of the proposed phrases and their border."""
    for n, places, hashes in _proposed_and_border(found, proposed):
        yield _hash_rows(hashes[found.words.own[places]], n)


def _with_border(found: _Phrases, proposed: PhraseMap, heavy: PhraseMap) -> Iterator[pa.RecordBatch]:
    """Counts of those of them whose hashes are frequent; and of all words, as the phrase ''."""
    for n, places, hashes in _proposed_and_border(found, proposed):
        kept = heavy.has(hashes)
        yield found.rows(places[kept], hashes[kept], n, proposed)
    lang, words = np.unique(found.lang[found.words.own], return_counts=True)
    many = len(lang)
    columns = [
        pa.array(found.langs).take(pa.array(lang)), pa.array(np.zeros(many, dtype=np.int32)), pa.array([""] * many, pa.string()),
        pa.array(np.zeros(many, dtype=np.int64)), pa.array(words.astype(np.int64)), pa.array(np.ones(many, dtype=bool)),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "hash", "n", "proposed"])


def _around_failures(
    found: _Phrases, proposed: PhraseMap, heavy: PhraseMap, failed: PhraseMap
) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that hold a failed one and were not counted with the border. Parts
    that were counted must be frequent, as the phrase is not otherwise."""
    may = heavy.has(found.word_hash)[found.word]  # all words were counted
    holds = failed.has(found.word_hash)[found.word]
    given = proposed.has(found.word_hash)[found.word]
    hashes = found.first
    for n in range(2, LONGEST + 1):
        hashes = found.longer(hashes, n)
        many = len(hashes)
        places = np.flatnonzero(may[:many] & may[1 : many + 1] & found.whole(n))
        covered = given[places] & given[places + 1]
        around = holds[places] | holds[places + 1]
        fresh = places[around & ~covered]
        yield found.rows(fresh, hashes[fresh], n, None)
        own = hashes[places]
        may, given, before = np.zeros(many, dtype=bool), np.zeros(many, dtype=bool), around
        may[places] = ~covered | heavy.has(own)
        holds = np.zeros(many, dtype=bool)
        holds[places] = before | failed.has(own)
        given[places] = covered & proposed.has(own)  # as in the full pass


def _phrase_rows(docs: DataFrame, text_column: str, lang_column: str, count, *maps: PhraseMap) -> DataFrame:
    """What ``count`` gives for each block of the texts. The maps are broadcast: of bounded size."""
    sent = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            lang, langs = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), names.dictionary.to_pylist()
            for words in word_blocks(batch.column(1), _CLASSES, LONGEST - 1, COUNTED_BYTES):
                if len(words.code):
                    yield from count(_Phrases(words, lang, langs), *sent.value)

    rows = docs.select(F.coalesce(F.col(lang_column), F.lit("und")).alias("lang"), F.col(text_column).alias("text"))
    hashed = count in (_sampled, _border_hashes)
    return rows.mapInArrow(run, "hash long, words int, n long" if hashed else _COUNTED)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "words", "phrase", "hash", "proposed").agg(F.sum("n").alias("n"))


# --- the operator ------------------------------------------------------------------------------


def frequent_phrases(
    docs: DataFrame,
    least: int,
    text_column: str = "text",
    lang_column: str = "lang",
    sample_share: float = SAMPLE_SHARE,
    sample_count: int | None = None,
) -> tuple[DataFrame, DataFrame, int]:
    """``lang, words, phrase, n`` of all phrases of up to four words that occur ``least`` times
    or more; ``lang`` and the number of all its words; and the failures of the border."""
    texts = docs.select(text_column, lang_column)
    sample_count = sample_count or max(2, round(least * sample_share))
    columns = text_column, lang_column
    enough = F.when(F.col("words") == 1, F.lit(min(2, sample_count))).otherwise(sample_count)
    sample = _phrase_rows(texts.sample(False, sample_share, 20_011), *columns, _sampled)
    sample = sample.groupBy("hash").agg(F.max("words").alias("words"), F.sum("n").alias("n"))
    proposed = phrase_map(sample.where(F.col("n") >= enough))
    border = _phrase_rows(texts, *columns, _border_hashes, proposed).groupBy("hash").agg(F.sum("n").alias("n"))
    heavy = phrase_map(border.where(F.col("n") >= least))
    counted = _summed(_phrase_rows(texts, *columns, _with_border, proposed, heavy))
    counted = materialize(counted.where((F.col("words") == 0) | (F.col("n") >= least)), "phrases")
    totals = counted.where("words = 0").select("lang", F.col("n").alias("total"))
    frequent = counted.where((F.col("words") > 0) & (F.col("n") >= least))
    failures = frequent.where(~F.col("proposed") & (F.col("words") < LONGEST))
    failed = failures.count()
    if failed:
        around = _phrase_rows(texts, *columns, _around_failures, proposed, heavy, phrase_map(failures))
        more = _summed(around).where(F.col("n") >= least)
        frequent = frequent.unionByName(materialize(more, "phrases"))
    return frequent.select("lang", "words", "phrase", "n"), totals, failed


def _part(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame,
    least: int = 30,
    top: int = 2_000,
    inside_percent: int = 80,
    text_column: str = "text",
    lang_column: str = "lang",
    sample_share: float = SAMPLE_SHARE,
    sample_count: int | None = None,
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its parts at the cut of the lowest
    score ``floor(2000000 * a / (l + r))``. A phrase inside a longer one that occurs
    ``inside_percent`` of its times or more is left out. Order: score and ``a`` falling,
    then the phrase.
    """
    frequent, totals, _ = frequent_phrases(docs, least, text_column, lang_column, sample_share, sample_count)
    frequent = materialize(frequent, "frequent")
    candidates = frequent.where("words > 1").withColumn("w", F.split("phrase", " "))

    starts = F.sequence(F.lit(0), F.col("words") - 2)
    inner = F.flatten(
        F.transform(
            starts,  # all shorter parts of two words or more, by start and length
            lambda i: F.transform(F.sequence(F.lit(2), F.col("words") - i), lambda k: _part(F.col("w"), i + 1, k)),
        )
    )
    inside = candidates.where("words > 2").select("lang", F.col("n").alias("longer"), F.explode(F.array_distinct(inner)).alias("phrase"), F.col("phrase").alias("whole"))
    inside = inside.where("phrase <> whole").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    joined = candidates.join(inside, ["lang", "phrase"], "left")
    wide = "decimal(38,0)"
    hidden = F.col("longer").cast(wide) * 100 >= F.col("n").cast(wide) * inside_percent
    left_over = joined.where(~F.coalesce(hidden, F.lit(False))).drop("longer")

    cuts = left_over.select("lang", "phrase", F.col("n").alias("a"), "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("first"), _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    counts = frequent.select("lang", "phrase", "n")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    product = (F.col("a").cast("decimal(31,0)") * F.lit(2_000_000).cast("decimal(7,0)")).alias("p")
    cuts = cuts.select("*", product, (F.col("l").cast(wide) + F.col("r").cast(wide)).alias("s"))
    # Both are whole numbers, so this is the floor.
    cuts = cuts.withColumn("score", F.expr("p div s"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    few = scored.withColumn("part", part)
    few = few.withColumn("rank", F.row_number().over(W.Window.partitionBy("lang", "part").orderBy(*order)))
    few = few.where(F.col("rank") <= top).drop("part")
    ranked = few.withColumn("rank", F.row_number().over(W.Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked.where(F.col("rank") <= top).join(totals.withColumnRenamed("total", "n"), "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
