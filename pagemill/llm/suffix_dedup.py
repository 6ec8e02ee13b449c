"""Bytes that repeat: every byte inside a string of 200 bytes that also starts elsewhere.

Equal windows of 200 bytes hold equal least hashes of their 32-byte grams at equal places (the
anchor), so a text falls into runs of windows with one anchor, about one in 85
bytes. Only anchors that occur at least twice can repeat. The bytes of their runs
meet by anchor hash, and there a suffix array over the distinct ones finds the
windows that repeat: suffixes are of type B if smaller than their successor, else
of type A. Type B alone is sorted by comparison; scanning the buckets of first bytes in
order then puts each type A suffix behind those of its bucket that came before, since its
successor has its place already. Adjacent suffixes with a common prefix of 200 bytes
are repeats.

Runs with equal bytes are one in the suffix array. Anchors with more than
``HOT_RUNS`` runs are not brought together: their windows are counted one by one, by 128-bit
hashes with a partial count before the shuffle, so any number of rows may share a passage.
Matches never cross documents. Within a document windows may overlap.

Null and empty texts, and those of fewer than 200 bytes, lose nothing. Rows that repeat
are copies of each other and lose everything from 200 bytes on. An empty table gives
an empty result. Other columns of the input are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.session import materialize

LENGTH = 200
GRAM = 32
WINDOW = LENGTH - GRAM + 1
# Windows worked on at a time; a place must fit the low 16 bits of a key.
CHUNK = 48_000
# Bytes in one suffix array, and runs of an anchor that may come together.
ARRAY_BYTES = 1 << 21
HOT_RUNS = 20_000
_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64
)
_LOW = np.uint64(0xFFFF)


# --- anchors -----------------------------------------------------------------------------


def anchor_runs(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hashes of a text and the first and last window that each run has."""
    windows = len(data) - LENGTH + 1
    for begin in range(0, windows, CHUNK):
        count = min(CHUNK, windows - begin)
        grams = count + WINDOW - 1
        words = [np.ndarray((grams,), "<u8", data, begin + 8 * k, (1,)) for k in range(4)]
        key = words[0] * _FACTORS[0]
        for k in range(1, 4):
            key = (key ^ (key >> np.uint64(31))) + words[k] * _FACTORS[k]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
        # The leftmost place of the least hash: equal windows have it at the same distance.
        key = (key & ~_LOW) | np.arange(grams, dtype=np.uint64)
        width = 1
        while width * 2 <= WINDOW:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        rest = WINDOW - width
        least = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], count) - 1
        yield (least[first] >> np.uint64(16)).astype(np.int64), first + begin, last + begin


# --- suffix arrays -------------------------------------------------------------------------


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor (type B). The last one is not."""
    size = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    smaller = np.zeros(size, dtype=bool)
    if len(differs):
        # All places of a run of equal characters take the type of its last one.
        at = np.searchsorted(differs, np.arange(size))
        inside = at < len(differs)
        place = differs[at[inside]]
        smaller[inside] = text[place] < text[place + 1]
    return smaller


def _sorted_by_comparison(padded: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places in the order of the ``LENGTH`` bytes that begin there."""
    rows = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[places]
    return places[np.argsort(np.ascontiguousarray(rows).view(f"V{LENGTH}").ravel().view(f"S{LENGTH}"), kind="stable")]


def suffix_array(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Wanted places of ``text`` (bytes, no zero), sorted by ``LENGTH`` bytes at least.

    ``wanted`` is closed under succession up to a type B suffix: a type A suffix that is
    wanted has its successor wanted.
    """
    smaller = _types(text)
    padded = np.concatenate([text, np.zeros(LENGTH, dtype=np.uint8)])
    direct = _sorted_by_comparison(padded, np.flatnonzero(wanted & smaller))
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(chunk: np.ndarray, own: int) -> np.ndarray:
        """Hand the type A predecessors of sorted places to their buckets; those of the
        same bucket are given back."""
        before = chunk[chunk > 0] - 1
        before = before[wanted[before] & ~smaller[before]]
        letters = text[before]
        same = before[letters == own]
        before, letters = before[letters > own], letters[letters > own]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cuts = np.flatnonzero(np.diff(letters)) + 1
        for part in np.split(before, cuts):
            if len(part):
                waiting[text[part[0]]].append(part)
        return same

    # The last suffix of all has no successor and comes first of its bucket.
    end = len(text) - 1
    if wanted[end]:
        waiting[text[end]].append(np.array([end]))
    for letter in range(256):
        chunk = np.concatenate(waiting[letter]) if waiting[letter] else np.zeros(0, dtype=np.int64)
        waiting[letter] = []
        while len(chunk):
            out.append(chunk)
            chunk = induce(chunk, letter)
        chunk = direct[bounds[letter] : bounds[letter + 1]]
        if len(chunk):
            out.append(chunk)
            induce(chunk, letter)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def common_prefix_reached(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each two neighbours in ``order``: whether their common prefix has ``LENGTH`` bytes."""
    padded = np.concatenate([text, np.zeros(LENGTH, dtype=np.uint8)])
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    one, two = order[:-1], order[1:]
    for start in range(0, LENGTH, 8):
        left = np.flatnonzero(same)
        if not len(left):
            break
        words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        same[left] = words[one[left] + start] == words[two[left] + start]
    return same


def repeated_windows(runs: list[bytes]) -> list[np.ndarray]:
    """For each of several different runs of bytes: which of its windows are also in
    another run, or again in its own."""
    # Zero bytes end a run; those of a text are taken as a value that UTF-8 never has.
    text = np.frombuffer(b"\0".join(run.replace(b"\0", b"\xff") for run in runs) + b"\0", dtype=np.uint8)
    lengths = np.array([len(run) for run in runs])
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    is_window = np.zeros(len(text), dtype=bool)
    for begin, length in zip(begins, lengths):
        is_window[begin : begin + length - LENGTH + 1] = True
    # A type A suffix needs its successors up to a type B one, or the end mark.
    smaller = _types(text)
    wanted = is_window.copy()
    stops = np.flatnonzero(smaller | (text == 0))
    for place in begins + lengths - LENGTH:
        wanted[place : stops[np.searchsorted(stops, place)] + 1] = True
    order = suffix_array(text, wanted)
    order = order[is_window[order]]
    same = common_prefix_reached(text, order)
    repeated = np.zeros(len(text), dtype=bool)
    repeated[order[:-1][same]] = True
    repeated[order[1:][same]] = True
    return [repeated[a : a + n - LENGTH + 1] for a, n in zip(begins, lengths)]


# --- in Spark ------------------------------------------------------------------------------


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _runs(keyed: DataFrame) -> DataFrame:
    schema = T.StructType([keyed.schema["id"], keyed.schema["text_hash"]])
    schema.add("anchor", T.LongType()).add("first", T.IntegerType()).add("last", T.IntegerType())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for row, text in enumerate(batch.column("text")):
                for part in anchor_runs(text.as_py().encode()):
                    rows.append(np.full(len(part[0]), row))
                    parts.append(part)
            if parts:
                take = pa.array(np.concatenate(rows))
                anchor, first, last = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").take(take),
                        "text_hash": batch.column("text_hash").take(take),
                        "anchor": pa.array(anchor),
                        "first": pa.array(first.astype(np.int32)),
                        "last": pa.array(last.astype(np.int32)),
                    }
                )

    return keyed.where(F.octet_length("text") >= LENGTH).mapInArrow(find, schema)


def _run_bytes(texts: DataFrame) -> DataFrame:
    """The bytes of each run of ``texts`` (id, text_hash, text, runs)."""
    schema = T.StructType([texts.schema["id"], texts.schema["text_hash"]])
    schema.add("anchor", T.LongType()).add("hot", T.BooleanType()).add("first", T.IntegerType())
    schema.add("bytes", T.BinaryType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, anchor, hot, first, data = [], [], [], [], []
            for row, (text, runs) in enumerate(zip(batch.column("text"), batch.column("runs"))):
                text = text.as_py().encode()
                for run in runs.as_py():
                    rows.append(row)
                    anchor.append(run["anchor"])
                    hot.append(run["hot"])
                    first.append(run["first"])
                    data.append(text[run["first"] : run["last"] + LENGTH])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id").take(take),
                    "text_hash": batch.column("text_hash").take(take),
                    "anchor": pa.array(anchor, pa.int64()),
                    "hot": pa.array(hot, pa.bool_()),
                    "first": pa.array(first, pa.int32()),
                    "bytes": pa.array(data, pa.binary()),
                }
            )

    return texts.mapInArrow(cut, schema)


def _span_schema(runs: DataFrame) -> T.StructType:
    schema = T.StructType([runs.schema["id"], runs.schema["text_hash"]])
    return schema.add("start", T.IntegerType()).add("end", T.IntegerType())


def _spans_of(flags: np.ndarray, first: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(first + a, first + b - 1 + LENGTH) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def _repeated_spans(runs: DataFrame) -> DataFrame:
    """Byte spans (id, text_hash, start, end) of windows that repeat, by suffix arrays
    over the runs that share an anchor."""
    schema = _span_schema(runs)

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        groups: dict[tuple[int, bytes], list[tuple]] = {}
        per_anchor: dict[int, list[bytes]] = {}
        for id_, text_hash, anchor, first, data in rows:
            key = (anchor, data)
            if key not in groups:
                groups[key] = []
                per_anchor.setdefault(anchor, []).append(data)
            groups[key].append((id_, text_hash, first))
        several = [(anchor, data) for anchor, runs in per_anchor.items() if len(runs) > 1 for data in runs]
        flags = dict(zip(several, repeated_windows([data for _, data in several]))) if several else {}
        ids, hashes, starts, ends = [], [], [], []
        for key, owners in groups.items():
            if len(owners) > 1:
                spans = [(0, len(key[1]))]
            elif key in flags:
                spans = _spans_of(flags[key], 0)
            else:
                continue
            for id_, text_hash, first in owners:
                for a, b in spans:
                    ids.append(id_)
                    hashes.append(text_hash)
                    starts.append(first + a)
                    ends.append(first + b)
        names = ("id", "text_hash", "start", "end")
        kinds = (id_type, pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(names, (ids, hashes, starts, ends), kinds)})

    id_type = None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            id_type = batch.schema.field("id").type
            columns = [batch.column(c).to_pylist() for c in ("id", "text_hash", "anchor", "first", "bytes")]
            for row in zip(*columns):
                if size > ARRAY_BYTES and row[2] != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                last = row[2]
        if rows:
            yield solve(rows)

    columns = ["id", "text_hash", "anchor", "first", "bytes"]
    together = runs.select(*columns).repartition("anchor").sortWithinPartitions("anchor")
    return together.mapInArrow(find, schema)


def _hot_spans(runs: DataFrame) -> DataFrame:
    """The same for anchors of very many runs: windows are counted by their hashes."""
    schema = T.StructType([runs.schema["id"], runs.schema["text_hash"]])
    schema.add("start", T.IntegerType()).add("w1", T.LongType()).add("w2", T.LongType())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, digests = [], [], []
            for row, (first, data) in enumerate(zip(batch.column("first").to_pylist(), batch.column("bytes").to_pylist())):
                for at in range(len(data) - LENGTH + 1):
                    rows.append(row)
                    start.append(first + at)
                    digests.append(xxhash.xxh128_digest(data[at : at + LENGTH]))
            pairs = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id").take(take),
                    "text_hash": batch.column("text_hash").take(take),
                    "start": pa.array(start, pa.int32()),
                    "w1": pa.array(np.ascontiguousarray(pairs[:, 0])),
                    "w2": pa.array(np.ascontiguousarray(pairs[:, 1])),
                }
            )

    found = runs.mapInArrow(windows, schema)
    often = found.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    spans = found.join(often, ["w1", "w2"], "left_semi")
    return spans.select("id", "text_hash", "start", (F.col("start") + LENGTH).alias("end"))


def _merged(spans):
    """Sorted disjoint spans, neighbours joined, of a sorted array of spans."""
    start = F.array().cast("array<struct<start:int,end:int>>")

    def step(done, x):
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        touching = (F.size(done) > 0) & (x["start"] <= last["end"])
        return F.when(touching, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(x))
        )

    return F.aggregate(F.sort_array(spans), start, step)


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_kept: bool = False,
    hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """Per row of ``docs``: the id, ``n_bytes``, ``spans`` (start and end of removed bytes,
    disjoint and sorted), ``n_removed``, ``kept_sha256`` and, with ``with_kept``, the bytes
    that remain.

    Texts are dealt by id to meet their anchors that repeat, and those that have some are
    written to shared scratch space, to be cut and later to lose their spans.
    """
    keyed = _keyed(docs, id_column, text_column)
    runs = _runs(keyed)
    often = runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    alive = runs.join(often, "anchor").withColumn("hot", F.col("n") > hot_runs)
    run = F.struct("anchor", "hot", "first", "last")
    # A text's runs are at most as many as its bytes.
    per_text = alive.groupBy(F.col("id").alias("of"), F.col("text_hash").alias("of_hash")).agg(F.collect_list(run).alias("runs"))
    same = keyed["id"].eqNullSafe(per_text["of"]) & (keyed["text_hash"] == per_text["of_hash"])
    texts = materialize(keyed.join(per_text, same).drop("of", "of_hash"), "repeating")
    pieces = _run_bytes(texts)
    spans = _repeated_spans(pieces.where(~F.col("hot"))).unionByName(_hot_spans(pieces.where("hot")))
    per_text = spans.groupBy(F.col("id").alias("of"), F.col("text_hash").alias("of_hash")).agg(
        F.collect_set(F.struct("start", "end")).alias("spans")
    )
    per_text = materialize(per_text.withColumn("spans", _merged(F.col("spans"))), "spans")

    @F.arrow_udf("binary")
    def keep(batch: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, cuts in zip(batch, spans):
            data, at, parts = text.as_py().encode(), 0, []
            for cut in cuts.as_py():
                parts.append(data[at : cut["start"]])
                at = cut["end"]
            out.append(b"".join([*parts, data[at:]]))
        return pa.array(out, pa.binary())

    same = texts["id"].eqNullSafe(per_text["of"]) & (texts["text_hash"] == per_text["of_hash"])
    cut = texts.join(per_text, same).withColumn("kept", keep("text", "spans"))
    cut = cut.select("id", "text_hash", "spans", "kept")
    # Rows that repeat are cut alike.
    cut = cut.groupBy("id", "text_hash").agg(
        F.first("spans").alias("spans"),
        F.first(F.sha2("kept", 256)).alias("cut_sha256"),
        *([F.first("kept").alias("kept")] if with_kept else []),
    )
    cut = cut.withColumnsRenamed({"id": "of", "text_hash": "of_hash"})
    rows = keyed.select(
        "id",
        "text_hash",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("whole_sha256"),
        *([F.encode("text", "UTF-8").alias("whole")] if with_kept else []),
    )
    same = rows["id"].eqNullSafe(cut["of"]) & (rows["text_hash"] == cut["of_hash"])
    spans_column = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    removed = F.aggregate(spans_column, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.join(cut, same, "left").select(
        F.col("id").alias(id_column),
        "n_bytes",
        spans_column.alias("spans"),
        removed.alias("n_removed"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"),
        *([F.coalesce("kept", "whole").alias("kept")] if with_kept else []),
    )
