"""Array work on whole texts inside Spark tasks: words, shingles and their hashes, many documents at a time.

Texts of a batch are cut into chunks of about ``CHUNK`` bytes (a longer text is a chunk of its own) and handled as one
byte array, so that no object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RADIX = 0x9E3779B97F4A7C15 | 1
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, radix: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        grown = np.full(max(n, CHUNK + (1 << 16)), radix, np.uint64)
        grown[0] = 1
        np.multiply.accumulate(grown, out=grown)
        if n > 4 * CHUNK:                                   # a very long text: do not keep its table
            return grown
        _powers[kind] = have = grown
    return have


def chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts as UTF-8; null as no bytes) of consecutive chunks of an Arrow string column."""
    start, held, size = 0, [], 0
    for i, t in enumerate(column.cast(pa.large_binary()) if not pa.types.is_binary(column.type) else column):
        b = t.as_py() or b""
        if held and size + len(b) > CHUNK:
            yield start, held
            start, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield start, held


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of batches in smaller ones, of about CHUNK bytes of a string column each, without copying."""
    for batch in batches:
        start = 0
        for at, texts in chunks(batch.column(column)):
            yield batch.slice(at, len(texts))
            start = at + len(texts)
        if start < batch.num_rows:
            yield batch.slice(start)


class Words:
    """Words of a chunk: ``starts``/``ends`` in ``buf``, ``doc`` of each, ``first`` word index of each document (one more at the end)."""

    def __init__(self, texts: list[bytes], space: np.ndarray = SPACE):
        self.n_docs = len(texts)
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        word = np.empty(len(self.buf) + 1, bool)
        word[0], word[1:] = False, ~space[self.buf]
        # the byte that joins two texts may be a word byte of another kind of word
        word[self.doc_start[1:]] = False
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.doc_start)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        n = len(self.buf)
        up, down = _power("up", _RADIX, n + 1), _power("down", pow(_RADIX, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.buf] * up[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of every run of ``width`` consecutive words inside one document."""
    n = np.diff(first)
    counts = np.maximum(n - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
    out = np.full(total, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[begin + k])
    return begin, out
