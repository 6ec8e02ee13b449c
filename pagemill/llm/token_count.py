"""Token counts of texts under a byte-level BPE vocabulary, without any token id.

Each pre-token is a doubly linked list of byte symbols. A heap holds the ranks of
adjacent pairs; the lowest is popped, leftmost first, and merged if both symbols
are still what they were when it was pushed. The count is the number of initial
symbols less the number of merges. Pre-tokens repeat, so their counts are cached.

Null and empty texts have no tokens. The special token's string inside a text is
one token, as in the library. Rows, other columns and their order are untouched;
any number of rows may repeat.
"""

from __future__ import annotations

from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.llm.pretokens import SPECIAL, TokenCache, byte_symbols, load_vocabulary, pretokens

PAIR_BITS = 24


@cache
def _pairs(path: str) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """Rank of each pair of symbols and the symbol that it makes, by the two packed in
    one number; and the symbol of each byte."""
    ranks, _ = load_vocabulary(path)
    numbers: dict[str, int] = {}

    def number(symbol: str) -> int:
        return numbers.setdefault(symbol, len(numbers))

    of_byte = [number(symbol) for _, symbol in sorted(byte_symbols().items())]
    pairs = {}
    for (left, right), rank in ranks.items():
        key = number(left) << PAIR_BITS | number(right)
        pairs[key] = (rank, number(left + right))
    return pairs, of_byte


def merged_count(token: bytes, path: str) -> int:
    """Number of symbols that are left of a pre-token after all merges."""
    pairs, of_byte = _pairs(path)
    symbols = [of_byte[byte] for byte in token]
    size = count = len(symbols)
    heap = []
    for at in range(size - 1):
        pair = pairs.get(symbols[at] << PAIR_BITS | symbols[at + 1])
        if pair:
            heap.append((pair[0], at, pair[1]))
    if not heap:
        return count
    before, after = list(range(-1, size - 1)), list(range(1, size + 1))
    heapify(heap)
    while heap:
        rank, at, made = heappop(heap)
        behind = after[at]
        # Stale if either symbol has been merged since: then the pair has another rank, or none.
        if symbols[at] < 0 or behind >= size:
            continue
        pair = pairs.get(symbols[at] << PAIR_BITS | symbols[behind])
        if not pair or pair[0] != rank:
            continue
        symbols[at], symbols[behind] = made, -1
        count -= 1
        after[at] = behind = after[behind]
        one = before[at]
        if behind < size:
            before[behind] = at
            pair = pairs.get(made << PAIR_BITS | symbols[behind])
            if pair:
                heappush(heap, (pair[0], at, pair[1]))
        if one >= 0:
            pair = pairs.get(symbols[one] << PAIR_BITS | made)
            if pair:
                heappush(heap, (pair[0], one, pair[1]))
    return count


@cache
def _counts(path: str) -> tuple[TokenCache, str | None]:
    _, special = load_vocabulary(path)
    counts = TokenCache(lambda token: 1 if token == SPECIAL else merged_count(token.encode(), path))
    return counts, special


def count_texts(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each text."""
    counts, special = _counts(path)
    out = np.zeros(len(texts), dtype=np.int64)
    for numbers, tokens, bounds in pretokens(texts, special):
        sums = np.zeros(len(tokens) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(counts.__getitem__, tokens), np.int64, len(tokens)), out=sums[1:])
        np.add.at(out, numbers, sums[bounds[1:]] - sums[bounds[:-1]])
    return out


def token_count(text: Column, vocabulary: str) -> Column:
    """Number of tokens of ``text`` as BIGINT. ``vocabulary`` is the path of a ``.json``
    file that every executor has."""

    @F.arrow_udf("bigint")
    def count(batch: pa.Array) -> pa.Array:
        return pa.array(count_texts(batch.to_pylist(), vocabulary))

    return count(text)
