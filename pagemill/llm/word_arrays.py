"""Words of many texts as arrays: codes into a dictionary, found in the bytes of Arrow batches.

Bytes are lower-cased (A to Z only) and each has a class: part of a word, blank, or the
end of a piece. Texts are worked on in blocks of bounded size. A text longer than a block is
cut between words; each part goes on for a few words into the next one, so that whatever runs
over a few words is whole in one of them, and says which words are its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD, BLANK, PIECE_END = range(3)
BLOCK_BYTES = 1 << 23

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_classes(blanks: bytes, piece_ends: bytes = b"") -> np.ndarray:
    """Class of each byte; all that is neither is part of a word."""
    classes = np.full(256, WORD, dtype=np.uint8)
    classes[np.frombuffer(blanks, dtype=np.uint8)] = BLANK
    classes[np.frombuffer(piece_ends, dtype=np.uint8)] = PIECE_END
    return classes


@dataclass
class Words:
    """The words of a block in order."""

    code: np.ndarray  # of each word in the dictionary
    dictionary: pa.LargeBinaryArray
    row: np.ndarray  # the text that a word is of
    piece: np.ndarray  # the piece that a word is of, counted through the block
    own: np.ndarray  # false for words that belong to the next part of the text


def _part_ends(data: np.ndarray, classes: np.ndarray, overlap: int, most: int) -> Iterator[tuple[int, int, int]]:
    """Parts (start, end of own words, end) of the bytes of one text."""
    start = 0
    while len(data) - start > most:
        kind = classes[data[start : start + most]]
        gaps = np.flatnonzero(kind != WORD)
        stop = start + (int(gaps[-1]) if len(gaps) else most)
        while not len(gaps) and stop < len(data) and classes[data[stop]] == WORD:
            ahead = np.flatnonzero(classes[data[stop : stop + most]] != WORD)
            stop = stop + int(ahead[0]) if len(ahead) else min(stop + most, len(data))
        if stop <= start:
            stop = start + 1
        end, words = stop, 0
        while words < overlap and end < len(data):
            reach = min(end + 4096, len(data))
            inside = classes[data[end:reach]] == WORD
            closes = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
            if words + len(closes) >= overlap:
                end += int(closes[overlap - words - 1])
                break
            # A word that goes on is looked at again from its start.
            begun = int(closes[-1]) if len(closes) else 0
            words += len(closes)
            if reach == len(data):
                end = reach
            elif begun:
                end += begun
            else:
                more = np.flatnonzero(classes[data[reach:]] != WORD) if inside[-1] else np.zeros(1, dtype=int)
                end = reach + (int(more[0]) if len(more) else len(data) - reach)
                words += int(inside.any())
        yield start, stop, end
        start = stop
    yield start, len(data), len(data)


def _found(parts: list[tuple[int, np.ndarray, int]], classes: np.ndarray) -> Words:
    data = np.concatenate([part for _, part, _ in parts])
    bounds = np.concatenate([[0], np.cumsum([len(part) for _, part, _ in parts])])
    kind = classes[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    if len(data):
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[bounds] = True
    cuts = np.flatnonzero(edge)
    kinds = kind[cuts[:-1]] if len(data) else np.zeros(0, dtype=np.uint8)
    is_word = kinds == WORD
    starts, lengths = cuts[:-1][is_word] if len(data) else np.zeros(0, dtype=np.int64), np.diff(cuts)[is_word]
    part = np.searchsorted(bounds, starts, side="right") - 1
    piece = np.cumsum(kinds == PIECE_END)[is_word] + part
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[kind == WORD]))]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    own_end = bounds[:-1] + np.array([own for _, _, own in parts])
    rows = np.array([row for row, _, _ in parts])
    return Words(
        words.indices.to_numpy(zero_copy_only=False), words.dictionary, rows[part], piece, starts < own_end[part]
    )


def word_blocks(
    texts: pa.Array, classes: np.ndarray, overlap: int = 0, block_bytes: int = BLOCK_BYTES
) -> Iterator[Words]:
    """Words of texts (null: none), block by block; ``row`` counts in ``texts``."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)
    filled = texts.is_valid().to_numpy(zero_copy_only=False)
    waiting: list[tuple[int, np.ndarray, int]] = []
    size = 0
    for row in np.flatnonzero(filled & (np.diff(bounds) > 0)).tolist():
        text = _LOWER[data[bounds[row] : bounds[row + 1]]]
        for start, own, end in _part_ends(text, classes, overlap, block_bytes):
            if waiting and size + end - start > block_bytes:
                yield _found(waiting, classes)
                waiting, size = [], 0
            waiting.append((row, text[start:end], own - start))
            size += end - start
    if waiting:
        yield _found(waiting, classes)
