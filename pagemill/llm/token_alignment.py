"""Tokens of two vocabularies, aligned where both end.

Texts are deduplicated exactly first: shuffled by the whole text, each distinct one is
tokenised and aligned once, and stands for as many documents as have it. A blank
begins a token in both vocabularies, and no token goes on over one, so both are cut alike at the
blanks: what stands between (a chunk) is tokenised and aligned by itself, and chunks that
come again are looked up.

Tokens are compared by their bytes. Byte offsets where a token of either vocabulary ends cut
a text into groups; every token of the one is linked with every token of the other in its group.
For each pair of ids the documents that hold it linked are counted, a distinct text with
its number of copies, and the counts are joined back to the documents as measures.

What one task has seen of a pair is summed there before the shuffle. Of the pairs'
counts at most ``BROADCAST_PAIRS`` go to the tasks, those of most documents, chosen by a histogram;
rarer ones are joined, so that all are used. The table of aligned texts is written once.

Null and empty texts, and those whose tokens do not spell a blank and the text, have no tokens:
zeros and ''. Copies share their measures; repeated ids have a row each. Very long texts
are worked on in segments. An empty table gives an empty result. Other columns do not
matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.packing import PATTERN
from pagemill.llm.pretokens import byte_symbols, load_vocabulary
from pagemill.session import materialize

# Characters of a text that are worked on at a time, and chunks that are remembered.
SEGMENT = 1 << 20
CHUNKS = 250_000
BROADCAST_PAIRS = 500_000

_IRREGULAR = re.compile(r"  |[^\S ] ")
_CUT = re.compile(r"(?<=\S)(?= )")
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


# --- vocabularies --------------------------------------------------------------------------


class ByteVocabulary:
    """A byte-level ``.json`` vocabulary; special tokens are plain text."""

    def __init__(self, path: str):
        ranks, special = load_vocabulary(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        of_symbol = {symbol: byte for byte, symbol in byte_symbols().items()}
        entries = {t: n for t, n in content["model"]["vocab"].items() if t != special}
        made = [entries[left + right] for left, right in ranks]
        if made != sorted(made):
            raise ValueError("ids must rise in the order of the merges")
        plain = {bytes(map(of_symbol.__getitem__, t)): n for t, n in entries.items()}
        self.size = max(content["model"]["vocab"].values()) + 1
        self.bytes = {n: t for t, n in plain.items()}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={}).encode_ordinary


class PieceVocabulary:
    """A sentencepiece ``.model`` vocabulary that puts a blank before a text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(n) for n in range(self.size)]
        if any(re.search("[^▁]▁", piece) for piece in pieces):
            raise ValueError("a piece goes on over a blank")
        self.bytes = {
            n: bytes([int(piece[3:5], 16)]) if self.model.is_byte(n) else piece.replace("▁", " ").encode()
            for n, piece in enumerate(pieces)
        }
        self._blank = pieces.index("▁")

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks, which begin with a blank."""
        found = self.model.encode([chunk[1:] for chunk in chunks], num_threads=1)
        return [ids if len(chunk) > 1 else [self._blank] for chunk, ids in zip(chunks, found)]


# --- chunks ---------------------------------------------------------------------------------


def segments(text: str) -> Iterator[list[str]]:
    """The chunks of a blank and the text, in lists of some ``SEGMENT`` characters. A chunk
    begins with the first blank after something that is no white space."""
    text, at = " " + text, 0
    while at < len(text):
        stop = len(text)
        if stop - at > SEGMENT:
            found = _CUT.search(text, at + SEGMENT)
            stop = found.start() if found else stop
        part, at = text[at:stop], stop
        if _IRREGULAR.search(part):
            yield _CUT.split(part)
        else:
            yield [" " + word for word in part[1:].split(" ")]


class Aligner:
    """Texts to groups and linked pairs; chunks in recent use keep their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteVocabulary(path_a), PieceVocabulary(path_b)
        if self.a.size * self.b.size > 1 << 32:
            raise ValueError("vocabularies of more than 2^32 pairs are not supported")
        size = max(self.a.size, self.b.size)
        self.length_a, self.length_b = (
            np.array([len(v.bytes.get(n, b"")) for n in range(size)], dtype=np.int64) for v in (self.a, self.b)
        )
        # Each id with a comma, a bar or a semicolon behind it, and zeros to equal width.
        spelled = [f"{n}{mark}".encode() for n in range(size) for mark in ",|;"]
        self.spelled = np.array(spelled).view(np.uint8).reshape(len(spelled), -1)
        # Ids in both vocabularies by chunk, as bytes; None if they do not spell the chunk.
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def _learn(self, chunks: list[str]) -> None:
        known, older, of_b, encode = self.known, self.older, self.b.bytes, self.a.encode
        fresh = []
        for chunk in chunks:
            if chunk in older:
                known[chunk] = older[chunk]
            else:
                fresh.append(chunk)
        for chunk, ids_b in zip(fresh, self.b.encode(fresh)):
            if b"".join([of_b[n] for n in ids_b]) == chunk.encode():
                known[chunk] = array("I", encode(chunk)).tobytes(), array("I", ids_b).tobytes()
            else:
                known[chunk] = None

    def tokens(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids in both vocabularies, or None if they do not spell the chunks."""
        if len(self.known) >= CHUNKS:
            self.known, self.older = {}, self.known
        known = self.known
        if missing := [chunk for chunk in set(chunks) if chunk not in known]:
            self._learn(missing)
        found = list(map(known.__getitem__, chunks))
        if None in found:
            return None
        left, right = zip(*found)
        return tuple(np.frombuffer(b"".join(part), dtype=np.uint32).astype(np.int64) for part in (left, right))

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, bytes, np.ndarray]:
        """The number of groups, their text, and the links as a * size of B + b."""
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        common = end_a[_found_in(end_a, end_b)]
        # Tokens up to and with each group, and the group of each token.
        upto_a, upto_b = (np.searchsorted(end, common, side="right") for end in (end_a, end_b))
        many_a, many_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        groups = np.arange(len(common))
        of_a, of_b = np.repeat(groups, many_a), np.repeat(groups, many_b)
        code = np.empty(len(a) + len(b), dtype=np.int64)
        mark_a, mark_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        mark_a[upto_a - 1], mark_b[upto_b - 1] = 1, 2
        code[np.arange(len(a)) + (upto_b - many_b)[of_a]] = 3 * a + mark_a
        code[np.arange(len(b)) + upto_a[of_b]] = 3 * b + mark_b
        text = self.spelled[code].ravel()
        # Each token of A as often as its group has tokens of B, beside each of these.
        times = many_b[of_a]
        before = np.cumsum(times) - times
        place = np.arange(int(times.sum())) + np.repeat((upto_b - many_b)[of_a] - before, times)
        return len(common), text[text != 0].tobytes(), np.repeat(a * self.b.size, times) + b[place]

    def text(self, text: str) -> tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray] | None:
        """Measures, digest of the groups, pairs and how often; None if the tokens do not
        spell the text."""
        totals, digest, found = np.zeros(4, dtype=np.int64), hashlib.sha256(), []
        for number, chunks in enumerate(segments(text)):
            tokens = self.tokens(chunks)
            if tokens is None:
                return None
            groups, spelled, links = self.align(*tokens)
            totals += (len(tokens[0]), len(tokens[1]), groups, len(links))
            digest.update((b";" if number else b"") + spelled[:-1])
            links.sort()
            start = np.flatnonzero(np.diff(links, prepend=-1))
            found.append((links[start], np.diff(start, append=len(links))))
        pairs, times = found[0] if len(found) == 1 else _summed(found)
        return tuple(totals.tolist()), digest.hexdigest(), pairs, times


def _found_in(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the sorted values are among the sorted others."""
    at = np.searchsorted(others, values)
    found = at < len(others)
    found[found] = others[at[found]] == values[found]
    return found


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, with their weights summed."""
    pairs = np.concatenate([p for p, _ in found])
    weights = np.concatenate([w for _, w in found])
    order = np.argsort(pairs, kind="stable")
    pairs, weights = pairs[order], weights[order]
    start = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[start], np.add.reduceat(weights, start)


@cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# --- tables -----------------------------------------------------------------------------------

_ALIGNED = (
    "text_key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs binary, times binary"
)


def align_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Measures of distinct texts (``text``, ``copies``), and their linked pairs: for
    each, sorted, a * size of B + b and how often, as unsigned 32-bit numbers."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            for at in range(0, len(batch), 512):  # rows come large
                part = batch.slice(at, 512)
                measures, digests, pairs, times = [], [], [], []
                for text in part.column("text"):
                    found = aligner.text(text.as_py() or "") if text.as_py() else None
                    if not found:
                        found = ((0, 0, 0, 0), "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
                    measures.append(found[0])
                    digests.append(found[1])
                    pairs.append(found[2].astype(np.uint32).tobytes())
                    times.append(found[3].astype(np.uint32).tobytes())
                columns = {"text_key": part.column("text_key"), "copies": part.column("copies")}
                for k, name in enumerate(MEASURES):
                    columns[name] = pa.array([m[k] for m in measures], pa.int64())
                columns["groups_sha256"] = pa.array(digests, pa.string())
                columns |= {"pairs": pa.array(pairs, pa.binary()), "times": pa.array(times, pa.binary())}
                yield pa.RecordBatch.from_pydict(columns)

    return texts.select("text_key", "copies", "text").mapInArrow(align, _ALIGNED)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a column of binaries end to end, and where each row begins."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data if data is not None else b"", dtype=np.uint8)
    return data[bounds[0] : bounds[-1]].view(np.uint32), (bounds - bounds[0]) // 4


def count_pairs(aligned: DataFrame) -> DataFrame:
    """``pair`` and ``documents``: how many documents hold it linked; and ``texts``, how many distinct ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, bounds = _numbers(batch.column("pairs"))
            copies = np.repeat(batch.column("copies").to_numpy(), np.diff(bounds))
            order = np.argsort(pairs, kind="stable")
            start = np.flatnonzero(np.diff(pairs[order].astype(np.int64), prepend=-1))
            if len(start):
                columns = [
                    pa.array(pairs[order][start].astype(np.int64)),
                    pa.array(np.add.reduceat(copies[order], start)),
                    pa.array(np.diff(start, append=len(order))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["pair", "documents", "texts"])

    found = aligned.select("pairs", "copies").mapInArrow(count, "pair long, documents long, texts long")
    return found.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("texts").alias("texts"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least power of two of texts that at most ``most`` pairs reach."""
    level = F.floor(F.log2("texts")).alias("level")
    levels = {row["level"]: row["count"] for row in counts.groupBy(level).count().collect()}  # 64 at most
    reach, least = 0, max(levels, default=0) + 1
    while least > 0 and reach + levels.get(least - 1, 0) <= most:
        least -= 1
        reach += levels.get(least, 0)
    return 1 << least


def pair_measures(aligned: DataFrame, counts: DataFrame, size_b: int, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``text_key``, ``n_best`` and ``count_sum`` of the texts that have links."""
    best = counts.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("documents").alias("most"))
    marked = counts.join(F.broadcast(best), F.expr(f"pair div {size_b}") == F.col("a"))  # a row for each id of A
    marked = marked.select("pair", "documents", "texts", (F.col("documents") == F.col("most")).alias("best"))
    marked = materialize(marked, "pair-counts")
    least = _frequent(marked, broadcast_pairs)
    known = marked.where(F.col("texts") >= least).toArrow()  # at most broadcast_pairs rows
    order = np.argsort(known.column("pair").to_numpy())
    table = tuple(known.column(c).to_numpy()[order] for c in ("pair", "documents", "best"))
    sent = aligned.sparkSession.sparkContext.broadcast(table)

    def split(part: pa.RecordBatch):
        """Pairs, times and rows of a batch, and where they stand in the table, if they do."""
        pair, documents, best = sent.value
        codes, bounds = _numbers(part.column("pairs"))
        times = _numbers(part.column("times"))[0].astype(np.int64)
        row = np.repeat(np.arange(len(part)), np.diff(bounds))
        at = np.searchsorted(pair, codes)
        found = at < len(pair)
        found[found] = pair[at[found]] == codes[found]
        return codes, times, row, at, found

    def with_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, documents, best = sent.value
        for part in batches:
            codes, times, row, at, found = split(part)
            hits, many = at[found], times[found]
            sums, bests = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
            np.add.at(sums, row[found], documents[hits] * many)
            np.add.at(bests, row[found], best[hits] * many)
            columns = [part.column("text_key"), pa.array(bests), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["text_key", "n_best", "count_sum"])

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            codes, times, row, _, found = split(part)
            columns = [
                part.column("text_key").take(pa.array(row[~found])),
                pa.array(codes[~found].astype(np.int64)),
                pa.array(times[~found]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["text_key", "pair", "times"])

    linked = aligned.where("n_links > 0").select("text_key", "pairs", "times")
    sums = linked.mapInArrow(with_table, "text_key binary, n_best long, count_sum long")
    if least > 1:  # else the table has all pairs
        rare = linked.mapInArrow(without, "text_key binary, pair long, times long")
        rare = rare.join(marked.where(F.col("texts") < least), "pair").select(
            "text_key",
            F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
            (F.col("times") * F.col("documents")).alias("count_sum"),
        )
        sums = sums.unionByName(rare).groupBy("text_key")
        sums = sums.agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return sums


def align_documents(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> tuple[DataFrame, DataFrame]:
    """One row per row of ``docs``: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum`` and ``groups_sha256``; and the counts: ``a``, ``b`` and ``documents``."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    key = F.unhex(F.sha2("text", 256)).alias("text_key")
    texts = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).select("*", key)
    aligned = materialize(align_texts(texts, path_a, path_b), "aligned")
    counts = materialize(count_pairs(aligned), "pairs")
    size_b = _aligner(path_a, path_b).b.size
    sums = pair_measures(aligned, counts, size_b, broadcast_pairs)
    narrow = aligned.select("text_key", *MEASURES, "groups_sha256")
    measures = materialize(narrow.join(sums, "text_key", "left"), "measures")
    keyed = rows.select("id", key)
    zero = F.lit(0).cast("long")
    joined = keyed.join(measures, "text_key", "left").select(
        F.col("id").alias(id_column),
        *[F.coalesce(name, zero).alias(name) for name in (*MEASURES, "n_best", "count_sum")],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
    ids = counts.select(F.expr(f"pair div {size_b}").alias("a"), (F.col("pair") % size_b).alias("b"), "documents")
    return joined, ids
