"""Packing of tokenised documents into sequences by vector best fit.

Items are the pieces of documents; each demands tokens, one document place and
attention cost (its length squared). A sequence has a capacity for each. Items go
in order of falling length to the open sequence that they fill best: the least
weighted norm of what would be left of the capacities, or the greatest weighted dot
product of demand and residual, among those where every capacity holds.

Items of one length demand the same, and sequences of one fill are alike, so the
choice is made once for all of them. Only the number of items of each length, at
most ``max_tokens`` numbers, goes to the driver, and the plan says which ranks of a
length go where; ranks are given out on the executors. The packing is the one that
a single best-fit run over all documents would find, at any size.

Null and empty texts are documents of the end token alone. Rows that repeat are
documents of their own. An empty table gives an empty result. Columns of the input
beside the id and the text are not needed and do not matter, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from pagemill.llm.pretokens import TokenCache, byte_symbols, load_vocabulary
from pagemill.session import materialize

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces of one length that are ranked in one sort.
RANK_GROUP = 2_000
# Chunks whose ids a task keeps (twice as many while they are renewed), and texts that it has as strings at a time.
CHUNK_ENTRIES = 40_000
TEXT_ROWS = 256


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. The defaults leave only the tokens to bind: places for
    as many documents as tokens, and the attention cost of one full document."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024**2
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    select: str = "norm"


# --- the plan: on the driver, over counts ---------------------------------------------


def plan_packing(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` items of each length.

    Each row is (length, first rank, last rank + 1, items per sequence, first
    sequence, offset of the first item): rank r goes to sequence
    ``first + (r - rank) // per`` at ``offset + (r - rank) % per * length``.
    """
    limit = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.float64)
    weights = np.array(capacity.weights)
    rows: list[tuple[int, int, int, int, int, int]] = []
    # Classes of sequences alike: what is left of each capacity, the first one and how many.
    left = np.zeros((0, 3))
    span: list[tuple[int, int]] = []
    opened = 0
    for length in sorted((n for n in counts if counts[n] > 0), reverse=True):
        demand = np.array([length, 1, length * length], dtype=np.float64)
        if (demand > limit).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity of a sequence")
        rank, total = 0, counts[length]
        while rank < total:
            fits = np.flatnonzero((left >= demand).all(axis=1)) if len(left) else np.zeros(0, dtype=int)
            if len(fits):
                if capacity.select == "norm":
                    score = -np.square(weights * (left[fits] - demand) / limit).sum(axis=1)
                else:
                    score = (weights * (left[fits] / limit) * (demand / limit)).sum(axis=1)
                pick = int(fits[np.argmax(score)])
                room, (first, many) = left[pick], span[pick]
            else:
                pick, room, first = -1, limit, opened
                many = -(-(total - rank) // int((limit // demand).min()))
                opened += many
            per = int((room // demand).min())
            full, rest = min(many, (total - rank) // per), 0
            if full < many:
                rest = (total - rank) - full * per
            if full:
                rows.append((length, rank, rank + full * per, per, first, int(limit[0] - room[0])))
            if rest:
                start = rank + full * per
                rows.append((length, start, start + rest, rest, first + full, int(limit[0] - room[0])))
            rank += full * per + rest
            parts = [(per, first, full), (rest, first + full, int(rest > 0))]
            parts.append((0, first + full + int(rest > 0), many - full - int(rest > 0)))
            fresh = [(room - k * demand, (a, m)) for k, a, m in parts if m > 0]
            if pick >= 0:
                left = np.delete(left, pick, axis=0)
                del span[pick]
            fresh = [(r, s) for r, s in fresh if r[0] >= 1 and r[1] >= 1 and r[2] >= 1]
            if fresh:
                left = np.concatenate([left, [r for r, _ in fresh]])
                span.extend(s for _, s in fresh)
    return rows


# --- token ids: in tasks ----------------------------------------------------------------


@cache
def _encoder(path: str) -> tuple[tiktoken.Encoding, str | None, int]:
    """The vocabulary of a tokenizers ``.json`` file, in which ids follow the merges."""
    # Its merges are of no use here beyond this check, so they are not kept.
    ranks, special = load_vocabulary.__wrapped__(path)
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocabulary = content["model"]["vocab"]
    made = [vocabulary[left + right] for left, right in ranks]
    if made != sorted(made):
        raise ValueError("ids must rise in the order of the merges")
    of_symbol = {symbol: byte for byte, symbol in byte_symbols().items()}
    plain = {bytes(map(of_symbol.__getitem__, token)): number for token, number in vocabulary.items() if token != special}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})
    return encoding, special, content["added_tokens"][0]["id"] if special else -1


@cache
def _chunks(path: str) -> TokenCache:
    """Ids, as bytes, of a blank and what stands between it and the next blank."""
    encode = _encoder(path)[0].encode_ordinary
    return TokenCache(lambda chunk: array("I", encode(" " + chunk)).tobytes(), CHUNK_ENTRIES)


# A blank inside white space that does not end it belongs to the token before it.
_BLANK_INSIDE = re.compile(r"\s (?:\s|\Z)|\A (?:\s|\Z)")


def encode_text(text: str, path: str) -> bytes:
    """Ids of a text, 4 bytes each, lowest byte first.

    A blank starts a token, so what lies between blanks is looked up as a whole.
    Texts with a blank inside wider white space are encoded as a whole.
    """
    encoding, special, special_id = _encoder(path)
    if special and special in text:
        return array("I", [special_id]).tobytes().join(encode_text(part, path) for part in text.split(special))
    if _BLANK_INSIDE.search(text):
        return array("I", encoding.encode_ordinary(text)).tobytes()
    first, *chunks = text.split(" ")
    head = array("I", encoding.encode_ordinary(first)).tobytes()
    return head + b"".join(map(_chunks(path).__getitem__, chunks))


def piece_starts(length: int, most: int) -> list[int]:
    """Where pieces of a document of ``length`` tokens start: all but the first have
    ``most`` tokens."""
    return [0, *range((length - 1) % most + 1, length, most)]


def cut_documents(
    docs: DataFrame, id_column: str, text_column: str, vocabulary: str, end_id: int, most: int, with_ids: bool
) -> DataFrame:
    """One row per piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if
    asked for, ``ids``."""
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType)])
    schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part.slice(at, TEXT_ROWS) for part in batches for at in range(0, part.num_rows, TEXT_ROWS)):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                data = encode_text(text or "", vocabulary) + end
                total = len(data) // 4
                starts = piece_starts(total, most)
                for number, (a, b) in enumerate(zip(starts, [*starts[1:], total])):
                    part = data[4 * a : 4 * b]
                    rows.append(row)
                    piece.append(number)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            columns = {
                "id": batch.column("id").take(pa.array(rows, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(cut, schema)


# --- ranks and places --------------------------------------------------------------------


def _ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rank`` from 0 within each length. Lengths with many pieces are dealt to groups,
    each ranked on its own and moved by what lies in the groups before it."""
    groups = [max(1, counts.get(n, 0) // RANK_GROUP) for n in range(max(counts, default=0) + 1)]
    many = F.element_at(F.array(*[F.lit(g) for g in groups]), F.col("length").cast("int") + 1)
    dealt = pieces.withColumn("rank_group", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), many))
    sizes = dealt.groupBy("length", "rank_group").agg(F.count("*").alias("size"))
    before = W.Window.partitionBy("length").orderBy("rank_group").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "rank_group", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = W.Window.partitionBy("length", "rank_group").orderBy("id", "piece", "ids_crc32")
    numbered = dealt.withColumn("inside", F.row_number().over(inside))
    return numbered.join(offsets, ["length", "rank_group"]).withColumn("rank", F.col("before") + F.col("inside") - 1)


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    capacity: Capacity = Capacity(),
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their places: the id, ``piece``, ``start``,
    ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``; with ``with_ids`` also
    the token ids, for writing sequences out.

    Tokens are found once, and the pieces written to shared scratch space, since
    their counts must be known before any is placed.
    """
    spark = docs.sparkSession
    pieces = materialize(
        cut_documents(docs, id_column, text_column, vocabulary, end_id, capacity.tokens, with_ids), "pieces"
    )
    # At most as many rows as a sequence has tokens.
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    schema = "length long, low long, high long, per long, first long, at long"
    # A few rows per length, whatever the number of documents.
    places = F.broadcast(spark.createDataFrame(plan, schema))
    ranked = _ranked(pieces, counts)
    inside = (ranked["length"] == places["length"]) & (ranked["rank"] >= places["low"])
    inside &= ranked["rank"] < places["high"]
    place = F.col("rank") - F.col("low")
    per: Column = F.col("per")
    return (
        ranked.join(places, inside)
        .drop(places["length"])
        .select(
            F.col("id").alias(id_column),
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("first") + F.floor(place / per)).cast("long").alias("sequence_id"),
            (F.col("at") + place % per * F.col("length")).cast("long").alias("offset"),
            *(["ids"] if with_ids else []),
        )
    )
