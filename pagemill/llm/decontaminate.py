"""Overlaps of documents with benchmark items, by winnowing.

Words are lower-cased (A to Z only) runs of digits, letters and characters outside
ASCII. Of the word 5-grams in each window of 10 words, the one with the least hash
stands for the window; neighbouring windows mostly share it, so a text keeps about two
fingerprints in seven words. Two equal windows have equal least hashes: whatever two
texts share over 10 words or more is found. Fingerprints of documents are joined
with those of the items; where one meets, the windows it stands for are compared word
by word, which extends the hit and drops chance matches of hashes.

Items of fewer than 10 words are one window of their length, hashed as a whole.

Only fingerprints of items are broadcast, at most ``BLOCK_ROWS`` at a time: more are
taken in blocks, each a pass over the documents. Null and empty texts, and items
without words, have no windows. A document is its id and its text (a digest of it): rows that
repeat both have the same hits, texts that share an id or have none are told apart. Empty
tables on either side give no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
# Fingerprints of items in one broadcast: 12 bytes each, so some tens of MB in a task.
BLOCK_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words as an array; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


FINGERPRINT = "array<struct<fingerprint:bigint,words:int,first:int,last:int>>"


def winnowed(words: Column) -> Column:
    """Fingerprints of the windows of ``WINDOW`` words: the least hash of their grams and
    the first and last of the neighbouring windows that have it."""

    def grams(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - GRAM)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(GRAM)]))

    def least(g: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(g) - (WINDOW - GRAM + 1))
        return F.transform(places, lambda i: F.least(*[F.get(g, i + k) for k in range(WINDOW - GRAM + 1)]))

    def runs(m: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(m) - 1)
        changes = F.filter(places, lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        return _bound(
            changes,
            lambda s: F.transform(
                s,
                lambda i, j: F.struct(
                    F.get(m, i).alias("fingerprint"),
                    F.lit(WINDOW).alias("words"),
                    i.alias("first"),
                    (F.coalesce(F.get(s, j + 1), F.size(m)) - 1).alias("last"),
                ),
            ),
        )

    found = _bound(_bound(_bound(words, grams), least), runs)
    return F.when(F.size(words) >= WINDOW, found).otherwise(F.array().cast(FINGERPRINT)).cast(FINGERPRINT)


def whole_windows(words: Column, length: int) -> Column:
    """Fingerprints of all windows of ``length`` words, one each."""
    places = F.sequence(F.lit(0), F.size(words) - length)
    found = F.transform(
        places,
        lambda i: F.struct(
            F.xxhash64(F.lit(length), *[F.get(words, i + k) for k in range(length)]).alias("fingerprint"),
            F.lit(length).alias("words"),
            i.alias("first"),
            i.alias("last"),
        ),
    )
    return F.when(F.size(words) >= length, found).otherwise(F.array().cast(FINGERPRINT)).cast(FINGERPRINT)


def _window_texts(words: Column, first: Column, last: Column, length: Column) -> Column:
    """Windows that begin at ``first`` to ``last``: where, and their words joined by blanks."""
    return F.transform(
        F.sequence(first, last),
        lambda i: F.struct(i.alias("start"), F.array_join(F.slice(words, i + 1, length), " ").alias("window")),
    )


def _item_windows(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item, length, window text, fingerprint) of all windows of all items."""
    words = items.select(F.col(id_column).alias("item"), words_of(F.col(text_column)).alias("w"))
    full = words.where(F.size("w") >= WINDOW).select("item", "w", F.inline(winnowed(F.col("w"))))
    parts = [full]
    for length in range(1, WINDOW):
        short = words.where(F.size("w") == length)
        parts.append(short.select("item", "w", F.inline(whole_windows(F.col("w"), length))))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    texts = _window_texts(F.col("w"), F.col("first"), F.col("last"), F.col("words"))
    return rows.select("item", "words", "fingerprint", F.inline(texts)).drop("start").distinct()


def document_key(id_column: str, text_column: str) -> Column:
    """What stands for a document, though ids repeat or are missing."""
    digests = F.xxhash64(F.lit(1), text_column).alias("h1"), F.xxhash64(F.lit(2), text_column).alias("h2")
    return F.struct(F.col(id_column).alias("id"), *digests)


def _hits(
    docs: DataFrame,
    items: DataFrame,
    id_column: str,
    text_column: str,
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    block_rows: int | None = None,
    with_items: bool = True,
) -> DataFrame:
    """``key``, ``start`` and ``words`` of each document window that is a window of an item, and
    the ``item``: a row for each, or without items a row for the window."""
    windows = materialize(_item_windows(items, item_id_column, item_text_column), "item-windows")
    block_rows = block_rows or BLOCK_ROWS
    sizes = windows.agg(
        F.count_distinct("fingerprint", "words").alias("prints"), F.collect_set("words").alias("lengths")
    ).first()
    blocks = max(1, -(-sizes["prints"] // block_rows))
    words = docs.select(document_key(id_column, text_column).alias("key"), words_of(F.col(text_column)).alias("w"))
    kinds = [whole_windows(F.col("w"), n) for n in sorted(sizes["lengths"]) if n < WINDOW]
    if WINDOW in sizes["lengths"] or not kinds:
        kinds.append(winnowed(F.col("w")))
    # Not inline(): it brings a filter on the number of prints, for which all are computed twice.
    prints = words.withColumn("prints", F.concat(*kinds)).select("key", "w", F.inline_outer("prints"))
    out = None
    for block in range(blocks):
        ours = windows
        if blocks > 1:
            ours = windows.where(F.pmod(F.xxhash64("fingerprint", "words"), F.lit(blocks)) == block)
        # Counted above: a block is about block_rows fingerprints, and as many windows or a few times that.
        known = F.broadcast(ours.select("fingerprint", "words").distinct())
        met = prints.join(known, ["fingerprint", "words"], "left_semi")
        texts = _window_texts(F.col("w"), F.col("first"), F.col("last"), F.col("words"))
        met = met.select("key", "words", F.inline(texts))
        if with_items:
            hits = met.join(ours.select("words", "window", "item").distinct(), ["words", "window"])
        else:
            hits = met.join(ours.select("words", "window").distinct(), ["words", "window"], "left_semi")
        hits = hits.select("key", "start", "words", *(["item"] if with_items else []))
        out = hits if out is None else out.unionByName(hits)
    return out


def find_overlaps(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """One row per document window that is a window of an item: ``id``, ``start`` and
    ``words`` (both in words) and ``item``. A window in several items has a row for each."""
    hits = _hits(docs, items, id_column, text_column, **options)
    return hits.select(F.col("key.id").alias("id"), "start", "words", "item")


def _covered(spans: Column) -> Column:
    """Number of words in the union of spans (start, words)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(s: Column, x: Column) -> Column:
        end = F.greatest(s["end"], x["start"] + x["words"])
        return F.struct(end.alias("end"), (s["n"] + end - F.greatest(s["end"], x["start"])).alias("n"))

    def union(s: Column, x: Column) -> Column:
        return F.when(x["start"] + x["words"] > s["end"], step(s, x)).otherwise(s)

    return F.aggregate(F.sort_array(spans), start, union, lambda s: s["n"])


def overlap_report(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``n_words``, ``n_hit`` (words in any hit), ``hit_items``
    (sorted, as strings), ``spans`` (start and words) and ``contaminated``."""
    hits = _hits(docs, items, id_column, text_column)
    per_doc = hits.groupBy(F.col("key").alias("hit_key")).agg(
        F.collect_set(F.struct("start", "words")).alias("spans"),
        F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("hit_items"),
    )
    counted = docs.select(
        F.col(id_column),
        document_key(id_column, text_column).alias("own_key"),
        F.size(words_of(F.col(text_column))).cast("long").alias("n_words"),
    )
    joined = counted.join(per_doc, counted["own_key"].eqNullSafe(per_doc["hit_key"]), "left")
    return joined.select(
        id_column,
        "n_words",
        F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,words:int>>")).alias("spans"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with any item.

    Keys of hit documents are written first, so that their real size decides how they
    are joined: texts are shuffled only if the keys are too many to broadcast.
    """
    hits = _hits(docs, items, id_column, text_column, with_items=False).select(F.col("key").alias("_hit_key")).distinct()
    hits = materialize(hits, "contaminated")
    return docs.join(hits, document_key(id_column, text_column).eqNullSafe(hits["_hit_key"]), "left_anti")
