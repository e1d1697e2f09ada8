"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents. Its words become numbers of the benchmark's vocabulary;
stretches without room for the shortest test phrase cannot hold one and are left out of the
sequence. The sequence is indexed, all test phrases are searched backwards through it at once,
their occurrences are located by sampled suffix positions, and the covered words are merged
into removal spans. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from offerflow.llm.common import KEY, row_key, text_of
from offerflow.llm.fm_index import FMIndex
from offerflow.llm.wordhash import WordHasher, pieces, string_buffers

#: Bytes that end a word: ASCII without digits and letters.
BREAKS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Bytes of text in a shard (a longer document is a shard of its own).
SHARD_BYTES = 8 << 20
#: Test phrases that a task holds at once; a larger benchmark is searched in blocks.
BLOCK_WINDOWS = 500_000


class Phrases:
    """The windows of some benchmark items: vocabulary, patterns, and each pattern's items."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        hasher, texts = WordHasher(BREAKS), pa.array([t for _, t in items], pa.string())
        _, _, owner, hashes = hasher.words(*string_buffers(texts))
        self.vocabulary, words = np.unique(hashes, return_inverse=True)
        cuts, found = np.searchsorted(owner, np.arange(len(items) + 1)), {}
        for i, (item, _) in enumerate(items):
            mine = (words[cuts[i]:cuts[i + 1]] + 2).tolist()  # 0 ends the text, 1 parts stretches
            for a in range(max(1, len(mine) - size + 1) if mine else 0):
                found.setdefault(tuple(mine[a:a + size]), set()).add(item)
        self.lengths = np.array([len(p) for p in found], dtype=np.int64)
        self.patterns = np.zeros((len(found), size), dtype=np.int64)
        for k, p in enumerate(found):
            self.patterns[k, :len(p)] = p
        self.items = [sorted(x for x in s if x is not None) for s in found.values()]
        self.shortest = int(self.lengths.min()) if len(found) else 0


def read_blocks(benchmark: DataFrame, size: int, most: int, item_id: str, text: str) -> Iterator[Phrases]:
    """The benchmark as blocks of about ``most`` windows, fetched row by row."""
    block, held = [], 0
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string"), text_of(f"`{text}`"))
    for item, body in rows.toLocalIterator():
        block.append((item, body))
        held += body.count(" ") + 1
        if held >= most:
            yield Phrases(block, size)
            block, held = [], 0
    if block:
        yield Phrases(block, size)


def search(texts: pa.Array, phrases: Phrases):
    """Per text the number of words; (text, first byte, end byte) of every merged span with the
    number of its words; and (text, pattern) pairs that occur."""
    data, offsets = string_buffers(texts)
    starts, ends, owner, hashes = WordHasher(BREAKS).words(data, offsets)
    counts = np.bincount(owner, minlength=len(texts))
    none = np.zeros(0, dtype=np.int64)
    if not len(phrases.lengths) or not len(hashes):
        return counts, (none, none, none, none), (none, none)
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == hashes
    # stretches of known words within one text
    edge = np.ones(len(known), dtype=bool)
    edge[1:] = (known[1:] != known[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(edge)
    length = np.diff(np.append(first, len(known)))
    room = known[first] & (length >= phrases.shortest)
    first, length = first[room], length[room]
    if not len(first):
        return counts, (none, none, none, none), (none, none)
    begin = np.cumsum(length + 1) - (length + 1)
    word = np.repeat(first - begin, length + 1) + np.arange(int((length + 1).sum()))
    seq = np.ones(len(word), dtype=np.int64)
    inside = np.ones(len(word), dtype=bool)
    inside[begin + length] = False
    seq[inside] = at[word[inside]] + 2
    index = FMIndex(seq)
    low, high = index.ranges(phrases.patterns, phrases.lengths)
    times = np.maximum(high - low, 0)
    hit = np.flatnonzero(times)
    if not len(hit):
        return counts, (none, none, none, none), (none, none)
    times = times[hit]
    rows = np.repeat(low[hit] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    pattern = np.repeat(hit, times)
    place = word[index.locate(rows)]
    cover = np.zeros(len(owner) + 1, dtype=np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + phrases.lengths[pattern], -1)
    covered = np.cumsum(cover[:-1]) > 0
    opens, closes = covered.copy(), covered.copy()
    opens[1:] &= ~covered[:-1] | (owner[1:] != owner[:-1])
    closes[:-1] &= ~covered[1:] | (owner[1:] != owner[:-1])
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    pairs = np.unique(np.stack([owner[place], pattern], axis=1), axis=0)
    return counts, (owner[a], starts[a], ends[b], b - a + 1), (pairs[:, 0], pairs[:, 1])


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  shard_bytes: int = SHARD_BYTES, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: the row key, doc_id, n_words, n_hit, item_ids (sorted as strings),
    spans (merged, [start, end) in bytes of the UTF-8 text).

    A window is ``size`` consecutive words of an item, or all words of a shorter one. Null texts have
    no words; an item with a null id marks words but is not listed; items of one id count once;
    repeated rows are searched each; without benchmark rows nothing is hit; an empty table gives no rows."""
    rows = docs.select(*row_key(docs, doc_id), F.col(f"`{doc_id}`").alias("doc_id"),
                       text_of(f"`{text}`").alias("text"))
    schema = (f"{KEY[0]} string, {KEY[1]} long, doc_id {docs.schema[doc_id].dataType.simpleString()}, "
              "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>")
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(p) for p in read_blocks(benchmark, size, block_windows, item_id, item_text)]
    if not blocks:
        blocks = [context.broadcast(Phrases([], size))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in pieces(batch, 3, shard_bytes):
                texts = part.column(3)
                _, offsets = string_buffers(texts)
                n = part.num_rows
                counts = np.zeros(n, dtype=np.int64)
                spans: list[list] = [[] for _ in range(n)]
                items: list[set] = [set() for _ in range(n)]
                hits = np.zeros(n, dtype=np.int64)
                for block in blocks:
                    phrases = block.value
                    counts, (owner, a, b, words), (doc, pattern) = search(texts, phrases)
                    for d, x, y, w in zip(owner.tolist(), a.tolist(), b.tolist(), words.tolist()):
                        spans[d].append((x - int(offsets[d]), y - int(offsets[d]), w))
                        hits[d] += w
                    for d, p in zip(doc.tolist(), pattern.tolist()):
                        items[d].update(phrases.items[p])
                merged = [[s[:2] for s in x] for x in spans]
                if len(blocks) > 1:  # spans of different blocks may overlap
                    hasher = WordHasher(BREAKS)
                    for d in np.flatnonzero(hits).tolist():
                        start, end, _, _ = hasher.words(*string_buffers(texts.slice(d, 1)))
                        start, end = start - int(offsets[d]), end - int(offsets[d])
                        cover = np.zeros(len(start), dtype=bool)
                        for x, y, w in spans[d]:
                            k = int(np.searchsorted(start, x))
                            cover[k:k + w] = True
                        hits[d] = int(cover.sum())
                        a = np.flatnonzero(cover & ~np.insert(cover[:-1], 0, False))
                        b = np.flatnonzero(cover & ~np.append(cover[1:], False))
                        merged[d] = [(int(start[i]), int(end[j])) for i, j in zip(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(counts), pa.array(hits),
                     pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                     pa.array([[{"start": x, "end": y} for x, y in s] for s in merged], span_type)],
                    names=[*KEY, "doc_id", "n_words", "n_hit", "item_ids", "spans"])

    return rows.mapInArrow(find, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text",
                   chars: str | None = "n_chars", item_id: str = "item_id", item_text: str = "text",
                   shard_bytes: int = SHARD_BYTES, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` with the removal spans cut out of their texts, in the columns of
    ``docs`` (``chars``, where present, is the new length). Cutting goes on while what is left
    of a text still holds a test phrase. Rows without a hit are unchanged, and none is dropped
    but those that have no word left after cutting."""
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(p) for p in read_blocks(benchmark, size, block_windows, item_id, item_text)]
    columns = docs.columns
    at = columns.index(text)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at, shard_bytes):
                changed: dict[int, bytes] = {}
                todo, now = np.arange(part.num_rows), part.column(at).fill_null("")
                while len(todo):
                    _, offsets = string_buffers(now)
                    spans: dict[int, list] = {}
                    for block in blocks:
                        _, (owner, a, b, _), _ = search(now, block.value)
                        for d, x, y in zip(owner.tolist(), a.tolist(), b.tolist()):
                            spans.setdefault(d, []).append((x - int(offsets[d]), y - int(offsets[d])))
                    again = sorted(spans)
                    for d in again:
                        changed[int(todo[d])] = _without(now[d].as_py().encode(), _merged(spans[d]))
                    todo = todo[again]
                    now = pa.array([changed[int(i)].decode() for i in todo], pa.string())
                left = [changed[i].decode() if i in changed else None for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(left, pa.string())],
                                                 names=[*part.schema.names, "cut"])

    named = docs.withColumn(text, F.col(f"`{text}`").cast("string")).toDF(*[f"c{i}" for i in range(len(columns))])
    out = named.mapInArrow(cut, StructType([*named.schema, StructField("cut", StringType())]))
    body = F.coalesce(F.col("cut"), F.col(f"c{at}"))
    kept = out.filter(F.col("cut").isNull() | F.col("cut").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    final = []
    for i, c in enumerate(columns):
        if c == text:
            final.append(body.alias(c))
        elif c == chars:
            final.append(F.when(F.col("cut").isNull(), F.col(f"c{i}")).otherwise(
                F.length("cut").cast(docs.schema[c].dataType)).alias(c))
        else:
            final.append(F.col(f"c{i}").alias(c))
    return kept.select(*final)

