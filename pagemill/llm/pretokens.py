"""Pre-tokens of a byte-level BPE vocabulary, found for many texts at once.

The vocabularies of this kind cut a text, before any merge, by one pattern::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Here the same cuts are found with array operations over the code points of a
piece of up to ``PIECE_CHARS`` characters, whatever number of texts it holds.
Runs of one class (letter, number, white space, other) are the tokens, but for
two rules: the last blank of a white-space run goes to what follows it, and a
lone apostrophe takes an ending such as ``'re`` from the letters behind it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import regex
from tokenizers import pre_tokenizers

PIECE_CHARS = 1 << 19
# A cache of pre-tokens starts anew beyond so many entries, and keeps those in use.
CACHE_ENTRIES = 200_000

# Lone surrogates occur in no UTF-8 text.
TEXT_END, SPECIAL = "\ud801", "\ud800"
LETTER, NUMBER, SPACE, OTHER, MARK = range(5)


@cache
def _classes() -> np.ndarray:
    """Class of each code point."""
    category = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    table[category == "L"] = LETTER
    table[category == "N"] = NUMBER
    # Python's tables are of an older Unicode than the tokenizers library's.
    late = [c for c in np.flatnonzero(category == "C") if regex.match(r"[\p{L}\p{N}]", chr(c))]
    ask = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for kind, before in ((LETTER, "a"), (NUMBER, "1")):
        table[[c for c in late if len(ask(before + chr(c))) == 1]] = kind
    # White space by its Unicode property.
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]] = SPACE
    table[[0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    table[[ord(TEXT_END), ord(SPECIAL)]] = MARK
    return table


def _token_starts(points: np.ndarray) -> np.ndarray:
    """Where tokens start in code points that end in a mark; each mark is one."""
    kind = _classes()[points]
    start = np.ones(len(kind), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == MARK
    # The last character of white space before a token.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < MARK) & (kind[1:] != SPACE))
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points[:-1] == 0x27) & (kind[1:] == LETTER) & start[:-1])
    if len(quote):
        one = points[quote + 1]
        two = points[np.minimum(quote + 2, len(points) - 1)]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        for where, length in ((quote[single], 1), (quote[double & ~single], 2)):
            start[where + 1] = False
            after = where + 1 + length
            start[after[kind[after] == LETTER]] = True
    return start


def _segments(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """Texts in parts of at most ``PIECE_CHARS``, cut where white space begins, which
    is always the start of a token; a longer run without white space stays whole."""
    begins = None
    for number, text in enumerate(texts):
        text = text or ""
        at = 0
        while len(text) - at > PIECE_CHARS:
            begins = begins or re.compile(r"(?<=\S)\s")
            stop = at + PIECE_CHARS
            found = begins.search(text, stop - 2000, stop) or begins.search(text, stop)
            if not found:
                break
            yield number, text[at : found.start()]
            at = found.start()
        yield number, text[at:]


def pretokens(texts: list[str | None], special: str | None) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Pre-tokens in pieces: the numbers of the texts that a piece has parts of, its
    tokens in order, and where each part's tokens begin, with the end behind.

    An occurrence of ``special`` is one token, given as ``SPECIAL``.
    """

    def cut(parts: list[tuple[int, str]]):
        joined = TEXT_END.join(part for _, part in parts) + TEXT_END
        if special and special in joined:
            joined = joined.replace(special, SPECIAL)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.flatnonzero(_token_starts(points))
        ends = np.flatnonzero(points[starts] == ord(TEXT_END))
        bounds = np.concatenate([[0], ends - np.arange(len(ends))])
        keep = np.ones(len(starts), dtype=bool)
        keep[ends] = False
        stops = np.append(starts[1:], len(points))
        words = [joined[a:b] for a, b in zip(starts[keep].tolist(), stops[keep].tolist())]
        return np.array([number for number, _ in parts]), words, bounds

    parts, size = [], 0
    for number, part in _segments(texts):
        if parts and size + len(part) > PIECE_CHARS:
            yield cut(parts)
            parts, size = [], 0
        parts.append((number, part))
        size += len(part)
    if parts:
        yield cut(parts)


class TokenCache(dict):
    """What ``make`` gives for a pre-token, kept for those in recent use."""

    def __init__(self, make: Callable[[str], object], entries: int | None = None):
        super().__init__()
        self.make, self.entries, self.older = make, entries, {}

    def __missing__(self, token: str):
        if len(self) >= (self.entries or CACHE_ENTRIES):
            self.older = dict(self)
            self.clear()
        value = self.older.get(token)
        if value is None:
            value = self.make(token)
        if len(token) <= 64:
            self[token] = value
        return value


@cache
def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in such vocabularies: itself
    if it is one, else the next free one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {byte: chr(byte) for byte in printable}
    for byte in range(256):
        if byte not in symbols:
            symbols[byte] = chr(256 + len(symbols) - len(printable))
    return symbols


@cache
def load_vocabulary(path: str) -> tuple[dict[tuple[str, str], int], str | None]:
    """Ranks of the merges, and the special token, of a ``.json`` vocabulary.

    Other pre-tokenisers, normalisers or more special tokens are refused.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    before = content["pre_tokenizer"]
    if before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
        raise ValueError("a byte-level vocabulary without a prefix blank is needed")
    if content["normalizer"] or content["model"].get("ignore_merges") or len(content["added_tokens"]) > 1:
        raise ValueError("normalisers and several special tokens are not supported")
    merges = (m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"])
    special = content["added_tokens"][0]["content"] if content["added_tokens"] else None
    return {tuple(pair): rank for rank, pair in enumerate(merges)}, special
