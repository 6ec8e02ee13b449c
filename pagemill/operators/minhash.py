"""MinHash signatures and their bands.

With p = 2^31 - 1, a token hashes to h = g^5 mod p, where g is the polynomial
hash of its UTF-8 bytes: g <- (g * BASE + byte + 1) mod p. The fifth power is a
permutation of the residues and scatters tokens that differ little, which a
polynomial alone maps to neighbours. Permutation k takes h to (a_k h + b_k) mod
p, and the signature keeps the least value of each. All products fit a BIGINT, so
SQL can compute the same numbers, and all steps vectorise over the bytes of an
Arrow batch.
"""

from __future__ import annotations

import hashlib
import string
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.fixed_values import BEGIN_OF_TEXT, NUM_PERM
from pagemill.functions.text import UNSPACED, WHITESPACE

PRIME = 2**31 - 1
BASE = 911_382_323
# Text bytes and permutations worked on at a time, for arrays that stay in cache.
PIECE_BYTES = 1 << 17
PERMUTATIONS_AT_ONCE = 4


def permutations(num_perm: int = NUM_PERM) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers in [1, p) and offsets in [0, p), from a rule."""

    def number(name: str) -> int:
        return int(hashlib.md5(name.encode()).hexdigest()[:8], 16)

    a = [number(f"a:{k}") % (PRIME - 1) + 1 for k in range(num_perm)]
    b = [number(f"b:{k}") % PRIME for k in range(num_perm)]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


@cache
def band_shape(threshold: float, num_perm: int = NUM_PERM) -> tuple[int, int]:
    """Bands and rows per band that minimise the equally weighted areas of false
    positives below the threshold and false negatives above it."""
    s = np.linspace(0.0, 1.0, 2001)
    below = s <= threshold
    best = (np.inf, 1, 1)
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            hit = 1.0 - (1.0 - s**rows) ** bands
            error = np.trapezoid(hit[below], s[below]) + np.trapezoid(1.0 - hit[~below], s[~below])
            best = min(best, (float(error), bands, rows))
    return best[1], best[2]


# --- in a task: one Arrow batch at a time ------------------------------------------


def _string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the len + 1 offsets into them."""
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data if data is not None else b"", dtype=np.uint8), bounds


SPACE, WORD, OTHER, ALONE = range(4)


@cache
def _char_classes() -> np.ndarray:
    """Class of each code point, as the token pattern has it."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    table[np.isin(kinds, ["L", "M", "N"])] = WORD
    table[ord("_")] = WORD
    table[[ord(c) for c in WHITESPACE]] = SPACE
    for low, high in UNSPACED:
        table[low : high + 1] = ALONE
    return table


@cache
def _ascii_classes() -> np.ndarray:
    """The same for single bytes; those of longer characters are looked at apart."""
    classes = np.full(256, OTHER, dtype=np.uint8)
    classes[[ord(c) for c in string.ascii_letters + string.digits + "_"]] = WORD
    classes[[ord(c) for c in WHITESPACE if ord(c) < 128]] = SPACE
    return classes


@cache
def _safe_cuts() -> np.ndarray:
    """Bytes before which no token goes on: ASCII white space, and the first byte of
    U+5000 to U+9FFF, where each character is a token."""
    safe = _ascii_classes() == SPACE
    safe[0xE5:0xEA] = True
    return safe


def _kinds(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte by its character, and where characters that stand alone begin."""
    kind = _ascii_classes()[piece]
    lead = np.flatnonzero(piece >= 0xC0)
    if not len(lead):
        return kind, lead
    first = piece[lead]
    length = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = (first & np.where(length == 2, 0x1F, np.where(length == 3, 0x0F, 0x07))).astype(np.int64)
    for k in range(1, 4):
        more = np.flatnonzero((length > k) & (lead + k < len(piece)))
        point[more] = point[more] << 6 | (piece[lead[more] + k] & 0x3F)
    of_char = _char_classes()[np.minimum(point, 0x10FFFF)]
    for k in range(4):
        more = np.flatnonzero((length > k) & (lead + k < len(piece)))
        kind[lead[more] + k] = of_char[more]
    return kind, lead[of_char == ALONE]


def _pieces(data: np.ndarray, bounds: np.ndarray, safe: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut the bytes into pieces that split no token: at the end of a text if
    possible, else at a safe byte, else as far on as needed."""
    start, end = int(bounds[0]), int(bounds[-1])
    while start < end:
        stop = min(start + PIECE_BYTES, end)
        text_end = int(bounds[np.searchsorted(bounds, stop, side="right") - 1])
        if text_end > start:
            stop = text_end
        else:
            next_end = int(bounds[np.searchsorted(bounds, stop)])
            cuts = np.flatnonzero(safe[data[start + 1 : stop]])
            if len(cuts):
                stop = start + 1 + int(cuts[-1])
            else:
                while stop < next_end and not safe[data[stop]]:
                    ahead = np.flatnonzero(safe[data[stop : min(stop + PIECE_BYTES, next_end)]])
                    stop = stop + int(ahead[0]) if len(ahead) else min(stop + PIECE_BYTES, next_end)
        yield start, stop
        start = stop


def _text_tokens(
    data: np.ndarray, bounds: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens in the bytes of texts, piece by piece: their bytes end to end, their
    lengths and the texts they are of."""
    for start, stop in _pieces(data, bounds, _safe_cuts()):
        piece = data[start:stop]
        kind, alone = _kinds(piece)
        edge = np.empty(len(kind) + 1, dtype=bool)
        edge[0] = edge[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[alone] = True
        edge[bounds[np.searchsorted(bounds, start) : np.searchsorted(bounds, stop, side="right")] - start] = True
        cuts = np.flatnonzero(edge)
        is_token = kind[cuts[:-1]] != SPACE
        if is_token.any():
            owner = np.searchsorted(bounds, cuts[:-1][is_token] + start, side="right") - 1
            yield piece[kind != SPACE], np.diff(cuts)[is_token], owner


def _listed_tokens(
    data: np.ndarray, bounds: np.ndarray, owners: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for ready tokens; empty ones are left out."""
    group = (bounds[1:] - bounds[0]) // PIECE_BYTES
    for part in np.split(np.arange(len(owners)), np.flatnonzero(np.diff(group)) + 1):
        lengths = bounds[part + 1] - bounds[part]
        filled = lengths > 0
        if filled.any():
            yield data[bounds[part[0]] : bounds[part[-1] + 1]], lengths[filled], owners[part][filled]


def _fold(x: np.ndarray) -> np.ndarray:
    """Congruent modulo p and, for x < 2^62, below 2^32."""
    return (x & PRIME) + (x >> 31)


def _powers(count: int) -> np.ndarray:
    """BASE^0, BASE^1, ... mod p, at least ``count`` of them, by doubling."""
    table = np.ones(1, dtype=np.int64)
    while len(table) < count:
        table = np.concatenate([table, table * pow(BASE, len(table), PRIME) % PRIME])
    return table


def _hash_tokens(token_bytes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """h of each token, from the bytes of all tokens end to end."""
    last = np.cumsum(lengths)
    power = np.repeat(last - 1, lengths)
    power -= np.arange(len(power))
    terms = _powers(int(lengths.max())).take(power)
    terms *= token_bytes.astype(np.int64) + 1
    g = np.add.reduceat(_fold(terms), last - lengths) % PRIME
    g2 = g * g % PRIME
    return g2 * g2 % PRIME * g % PRIME


def _take_minima(out: np.ndarray, owner: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lower ``out[k, row]`` to the permuted values of the row's tokens.

    A fold leaves x = a h + b congruent and below 2p, in 32 bits; the lesser of v
    and v - p, which wraps to a large number where negative, is x mod p.
    """
    pairs = np.sort((owner << 31) | h)
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    owner, h = pairs >> 31, pairs & PRIME
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    rows = owner[first]
    shape = (PERMUTATIONS_AT_ONCE, len(h))
    value, high = np.empty(shape, dtype=np.int64), np.empty(shape, dtype=np.int64)
    folded, reduced = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
    for start in range(0, len(a), PERMUTATIONS_AT_ONCE):
        ks = slice(start, min(start + PERMUTATIONS_AT_ONCE, len(a)))
        v, t, f, r = (x[: ks.stop - start] for x in (value, high, folded, reduced))
        np.multiply(h, a[ks, None], out=v)
        v += b[ks, None]
        np.right_shift(v, 31, out=t)
        v &= PRIME
        np.add(v, t, out=f, casting="unsafe")
        np.subtract(f, np.uint32(PRIME), out=r)
        np.minimum(f, r, out=r)
        out[ks, rows] = np.minimum(out[ks, rows], np.minimum.reduceat(r, first, axis=1))


def _as_lists(out: np.ndarray) -> pa.Array:
    num_perm, rows = out.shape
    flat = pa.array(np.ascontiguousarray(out.T, dtype=np.int32).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * num_perm), flat)


def _sign_texts(texts: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.Array:
    mark = np.frombuffer(BEGIN_OF_TEXT.encode(), dtype=np.uint8)
    start = (a * _hash_tokens(mark, np.array([len(mark)])) + b) % PRIME
    out = np.repeat(start[:, None], len(texts), axis=1)
    for token_bytes, lengths, owner in _text_tokens(*_string_buffers(texts)):
        _take_minima(out, owner, _hash_tokens(token_bytes, lengths), a, b)
    return _as_lists(out)


def _sign_token_lists(tokens: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.Array:
    out = np.full((len(a), len(tokens)), PRIME, dtype=np.int64)
    owners = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy())
    for token_bytes, lengths, owner in _listed_tokens(*_string_buffers(tokens.flatten()), owners):
        _take_minima(out, owner, _hash_tokens(token_bytes, lengths), a, b)
    return _as_lists(out)


# --- columns ------------------------------------------------------------------------


def text_signature(text: Column, num_perm: int = NUM_PERM) -> Column:
    """MinHash signature of the ``token_set`` of a text, as ``array<int>``.

    Finds the tokens itself, in the bytes of the batch: a list of token strings
    would cost several times what the signature does.
    """
    a, b = permutations(num_perm)

    @F.arrow_udf("array<int>")
    def sign(batch: pa.Array) -> pa.Array:
        return _sign_texts(batch, a, b)

    return sign(text)


def signature(tokens: Column, num_perm: int = NUM_PERM) -> Column:
    """MinHash signature of a column of token lists, such as one from a model's
    own tokenizer (ids cast to strings); empty tokens do not count."""
    a, b = permutations(num_perm)

    @F.arrow_udf("array<int>")
    def sign(batch: pa.Array) -> pa.Array:
        return _sign_token_lists(batch, a, b)

    return sign(tokens)


def signature_in_sql(df: DataFrame, tokens: str, name: str, num_perm: int = NUM_PERM) -> DataFrame:
    """The same signature from built-in functions alone, to check the others by.

    ``explode(array(h))`` keeps the token hashes from being computed anew for
    every permutation when projections are collapsed.
    """
    a, b = permutations(num_perm)

    def polynomial(token: Column) -> Column:
        byte_pairs = F.regexp_extract_all(F.hex(F.encode(token, "UTF-8")), F.lit(".."), F.lit(0))
        start = F.lit(0).cast("bigint")
        return F.aggregate(
            byte_pairs, start, lambda g, pair: (g * BASE + F.conv(pair, 16, 10).cast("bigint") + 1) % PRIME
        )

    def fifth_power(g: Column) -> Column:
        square = g * g % PRIME
        return square * square % PRIME * g % PRIME

    pairs = F.array(*[F.struct(F.lit(int(x)).alias("a"), F.lit(int(y)).alias("b")) for x, y in zip(a, b)])
    values = F.transform(
        pairs, lambda p: F.array_min(F.transform("_h", lambda h: (p["a"] * h + p["b"]) % PRIME)).cast("int")
    )
    hashes = F.transform(F.transform(F.col(tokens), polynomial), fifth_power)
    return df.withColumn("_h", F.explode(F.array(hashes))).withColumn(name, values).drop("_h")


def band_text(signature_column: Column, bands: int, rows: int) -> Column:
    """Readable band keys: the values of each band, joined by commas."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda band: F.array_join(F.slice(signature_column, band * rows + 1, F.lit(rows)), ","),
    )


def pair_of_hashes(*columns: Column) -> Column:
    """Two differently keyed 64-bit hashes, as ``array<bigint>``.

    128 bits leave no realistic chance of a false match at 10^11 rows, where 64
    would not, and fixed-width keys keep aggregations hash-based.
    """
    return F.array(F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns))


def band_hashes(pool: Column, signature_column: Column, bands: int, rows: int) -> Column:
    """Compact band keys: a pair of hashes per band, as one flat array.

    The pool is hashed in, so rows of different pools share no key.
    """
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(bands - 1)),
            lambda band: pair_of_hashes(pool, band, F.slice(signature_column, band * rows + 1, F.lit(rows))),
        )
    )


def explode_bands(df: DataFrame, hashes: str, bands: int) -> DataFrame:
    """One row per band, with its key ``k1, k2`` in place of the flat array."""
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda band: F.struct(
            F.get(F.col(hashes), band * 2).alias("k1"), F.get(F.col(hashes), band * 2 + 1).alias("k2")
        ),
    )
    return df.select(*[c for c in df.columns if c != hashes], F.inline(keys))
