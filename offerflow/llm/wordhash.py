"""Word and shingle hashes of whole Arrow batches of texts, by numpy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = bytes([0x20, *range(0x09, 0x0E)])
_DEPTH = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit number over all bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """Splits texts at separator bytes and hashes each word by tabulation: the sum of one random
    number per byte value and place in the word. ASCII capitals count as small letters."""

    def __init__(self, separators: bytes = SPACES):
        self.separator = np.zeros(256, dtype=bool)
        self.separator[list(separators)] = True
        lower = np.arange(256)
        lower[65:91] += 32
        table = mix(np.arange(1, _DEPTH * 256 + 1, dtype=np.uint64)
                    * np.uint64(0x9E3779B97F4A7C15)).reshape(_DEPTH, 256)[:, lower]
        table[:, self.separator] = 0
        self.table = np.ascontiguousarray(table).reshape(-1)

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """(start byte, end byte, text number, hash) of every word. ``data`` holds the bytes of
        the texts, ``offsets`` where each begins and the last ends."""
        base = int(offsets[0])
        data, offsets = data[base:int(offsets[-1])], offsets.astype(np.int64) - base
        n = len(data)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none.astype(np.uint64)
        inside = ~self.separator[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        opens, closes = edge[:-1].copy(), edge[1:].copy()
        opens[1:] |= ~inside[:-1]
        closes[:-1] |= ~inside[1:]
        starts, ends = np.flatnonzero(inside & opens), np.flatnonzero(inside & closes) + 1
        if not len(starts):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none.astype(np.uint64)
        first = int(starts[0])
        place = np.arange(first, n, dtype=np.int32) - np.repeat(
            starts.astype(np.int32), np.diff(np.append(starts, n)))
        at = (place & (_DEPTH - 1)) * 256 + data[first:]
        values = self.table[at]
        if int(place.max()) >= _DEPTH:  # longer words: another factor for each 64 bytes
            far = np.flatnonzero(place >= _DEPTH)
            values[far] = mix(values[far] + (place[far] // _DEPTH).astype(np.uint64)) * (
                ~self.separator[data[first:][far]])
        hashes = mix(np.add.reduceat(values, starts - first))
        texts = np.searchsorted(offsets, starts, side="right") - 1
        return starts + base, ends + base, texts, hashes


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None
            else np.zeros(0, dtype=np.uint8)), offsets


def pieces(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``limit`` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, offsets = string_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, int(offsets[at]) + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def shingle_sets(hashes: np.ndarray, texts: np.ndarray, n_texts: int, size: int):
    """(shingle, text number) of each text's distinct shingles, sorted by text and shingle. A
    text of fewer words than ``size`` has its whole sequence as one shingle."""
    counts = np.bincount(texts, minlength=n_texts)
    ends = np.cumsum(counts)
    n = len(hashes)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        word = hashes[j:]
        out[:n - j] += np.where(texts[j:] == texts[:n - j], word * factors[j], np.uint64(0))
    short = counts < size
    keep = (np.arange(n) + size <= ends[texts]) | (short[texts] & (np.arange(n) == (ends - counts)[texts]))
    tagged = out + np.where(short[texts], counts[texts].astype(np.uint64), np.uint64(0)) * np.uint64(0xD6E8FEB86659FD93)
    shingles, owner = mix(tagged[keep]), texts[keep]
    cuts = np.searchsorted(owner, np.arange(n_texts + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a > 1:
            shingles[a:b].sort()
    new = np.ones(len(shingles), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], owner[new]
