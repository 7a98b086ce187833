"""Words and word shingles of Arrow text columns, hashed with numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased. A shingle is five consecutive words; a text of one to four words
has one shingle, its whole word sequence; a text without words has none.
Hashes are 64 bits wide and depend on the words alone, so they agree between
tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Text is hashed in slices of about so many bytes, which bounds a task's memory; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18

_MASK = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


_BYTE = _splitmix(256, 1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = _splitmix(WIDTH, 2) | np.uint64(1)
_SHORT = _splitmix(WIDTH, 3)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about SLICE_BYTES; null is empty. Nothing is copied but texts with nulls among them."""
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if raw[-1] > raw[0] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(raw, raw[at] + SLICE_BYTES, "right")) - 1)
        end = min(end, n)
        yield at, end, data[raw[at] : raw[end]], raw[at : end + 1] - raw[at]
        at = end
    del column, data
    # workers live on between tasks; what Arrow keeps for later is given back
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each word, and the word range of each text as offsets. space: which bytes end a word.

    One long text is taken in pieces that end at a space, so that only its words are held at once.
    """
    if len(data) <= 2 * SLICE_BYTES or len(offsets) != 2:
        return _words(data, offsets, space)
    parts, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + SLICE_BYTES)
        while end < n:  # on to the next space, however long the word is
            gap = np.flatnonzero(space[data[end : end + SLICE_BYTES]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(n, end + SLICE_BYTES)
        word, first, stop, _ = _words(data[at:end], np.array([0, end - at]), space)
        parts.append((word, first + at, stop + at))
        at = end
    word, first, stop = (np.concatenate(x) for x in zip(*parts, strict=True))
    return word, first, stop, np.array([0, len(word)])


def _words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    _grow(n)
    solid = ~space[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    before |= edge[:n]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    after |= edge[1:]
    first, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers[0][:n], out=total[1:])
    value = (total[end] - total[first]) * _powers[1][first] + (end - first).astype(np.uint64)
    return mix(value), first, end, np.searchsorted(first, offsets)


def rolling(word: np.ndarray) -> np.ndarray:
    """Hashes of all runs of WIDTH words, across texts too; the caller keeps those inside a text."""
    n = len(word) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = word[:n] * _STEP[0]
    for j in range(1, WIDTH):
        value += word[j : n + j] * _STEP[j]
    return mix(value)


def runs_of(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, 1 to WIDTH; a short text's shingle is the run of all its words."""
    if n == WIDTH:
        return rolling(word)
    if len(word) < n:
        return word[:0]
    value = np.full(len(word) - n + 1, _SHORT[n])
    for j in range(n):
        value += word[j : len(word) - n + 1 + j] * _STEP[j]
    return mix(value)


def shingles_of(word: np.ndarray, run: np.ndarray, start: int, end: int) -> np.ndarray:
    """Shingle hashes, in order, of the text whose words are word[start:end]; run is rolling(word)."""
    n = end - start
    if n >= WIDTH:
        return run[start : end - WIDTH + 1]
    if n <= 0:
        return run[:0]
    return mix(np.sum(word[start:end] * _STEP[:n], keepdims=True) + _SHORT[n])


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a column."""
    for at, _, data, offsets in text_slices(column):
        word, _, _, spans = words(data, offsets)
        run = rolling(word)
        for i in range(len(spans) - 1):
            yield at + i, np.unique(shingles_of(word, run, spans[i], spans[i + 1]))


def set_id(values: np.ndarray) -> int:
    """A signed 64-bit id of a set of shingle hashes; equal sets have equal ids."""
    total = np.sum(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), keepdims=True, dtype=np.uint64)
    return int(mix(total + np.uint64(len(values)))[:1].view(np.int64)[0])
