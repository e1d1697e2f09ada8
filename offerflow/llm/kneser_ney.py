"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model counts word n-grams of all trusted documents but a held-out share. Words are numbered,
frequent ones low. The counts are cut into shards by the middle word, for a trigram, its context,
its lower-order bigram and that one's context all share this word: each shard joins its counts with
those of the next lower order. Tasks send sorted, compressed runs of numbers, and the counts are
kept like that, for n-grams written out as plain rows take several times the space of their text.
Documents are scored in rounds: in each, a part of the shards is written out as sorted keys for
lookup, every document's words that belong there get their probability, and the keys are removed
again. A task joins its n-grams with one shard at a time, so none ever holds the whole model. A
document is kept where its perplexity is at most a high quantile of held-out trusted documents of
its language.
"""

from __future__ import annotations

import functools
import operator
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerflow.llm.common import group_key, text_of
from offerflow.llm.wordhash import WordHasher, mix, pieces, string_buffers
from offerflow.operators.ordered import running
from offerflow.session import remove, scratch_folder, stage

#: Share of the trusted documents that is held out of the counts (a seeded hash draws them).
HELD_OUT = 0.2
#: Entries of the model in a shard, and bytes of text scored and hashed at once (hashing takes many
#: bytes per byte of text).
SHARD_ENTRIES = 1_000_000
PIECE_BYTES = 8 << 20
HASH_BYTES = 2 << 20
#: Words that a task gathers before it sends their n-grams, and bytes of text taken for a word.
RUN_WORDS = 2_000_000
WORD_BYTES = 6
#: Rounds in which documents are scored: more take less disk and more reading of the documents.
ROUNDS = 3
#: Share of held-out trusted documents that stays below its language's limit.
QUANTILE = 0.99
#: Words of average trusted text added to every document, so that a few odd words in a short
#: one do not decide.
SHRINK = 20

#: Numbers of the mark before a text's first word and of words that no trusted text has.
START, UNKNOWN = 0, 2 ** 32 - 1
TRI, CONTEXT2, BI, CONTEXT1 = range(1, 5)
LOW = np.uint64(2 ** 32 - 1)
HALF = np.uint64(32)


class Words(NamedTuple):
    """What all shards share: the probability of an unseen word, the files of the numbered words
    and of their counts, the sum of these counts, and the discounts of words, pairs and trigrams."""
    unseen: float
    paths: list[str | None]
    counts: list[str | None]
    everything: float
    d1: list[float]
    d2: list[float]
    d3: list[float]


def _key(kind: int, *words: np.ndarray) -> np.ndarray:
    h = np.full(len(words[0]), kind, dtype=np.uint64)
    for w in words:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64))
    return h


def _shard(word: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(word) >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _contexts(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each word; a mark stands before a text's first."""
    one, two = np.full_like(words, START), np.full_like(words, START)
    if len(words):
        one[1:] = np.where(texts[1:] == texts[:-1], words[:-1], START)
        two[2:] = np.where(texts[2:] == texts[:-2], words[:-2], START)
    return two, one


def _steps(numbers: np.ndarray) -> np.ndarray:
    """Each number less the one before it."""
    return np.concatenate([numbers[:1], numbers[1:] - numbers[:-1]])


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers, the same byte of all numbers side by side, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return len(columns[0]).to_bytes(8, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(data: bytes, *types: type) -> list[np.ndarray]:
    n, sizes = int.from_bytes(data[:8], "little"), [np.dtype(t).itemsize for t in types]
    raw = np.frombuffer(pa.decompress(data[8:], n * sum(sizes), codec="zstd"), np.uint8)
    cuts = np.cumsum([0, *sizes]) * n
    return [np.ascontiguousarray(raw[i:j].reshape(size, n).T).view(t).reshape(n)
            for i, j, size, t in zip(cuts[:-1], cuts[1:], sizes, types)]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's counts."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(np.concatenate(counts)[order], first)


def _summed_trigrams(ba: list[np.ndarray], c: list[np.ndarray], n: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct trigrams, given as (b, a) in one number and c, in order, and their counts."""
    x, z = np.concatenate(ba), np.concatenate(c)
    order = np.lexsort((z, x))
    x, z = x[order], z[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (z[1:] != z[:-1])]))
    return [x[first], z[first], np.add.reduceat(np.concatenate(n)[order], first)]


def _write(folder: str, name: str, **parts: np.ndarray) -> str:
    """Flat files of the arrays; a task that runs again writes files of its own."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    for part, data in parts.items():
        with fs.open_output_stream(f"{root}/{name}.{part}") as f:
            f.write(np.ascontiguousarray(data).tobytes())
    return f"{folder}/{name}"


def _load(path: str, part: str) -> pa.Buffer:
    fs, root = pa.fs.FileSystem.from_uri(path)
    if isinstance(fs, pa.fs.LocalFileSystem):
        with pa.memory_map(f"{root}.{part}") as f:
            return f.read_buffer()
    with fs.open_input_file(f"{root}.{part}") as f:
        return f.read_buffer()


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key, -1 where there is none. The wanted are looked up in order."""
    out = np.full(len(wanted), -1)
    if len(keys) and len(wanted):
        order = np.argsort(wanted)
        sought = wanted[order]
        at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
        hit = keys[at] == sought
        out[order[hit]] = at[hit]
    return out


def _numbers(paths: list[str | None], hashes: np.ndarray) -> np.ndarray:
    """The numbers of hashed words, one shard of words at a time."""
    out, part = np.full(len(hashes), UNKNOWN, dtype=np.uint32), _shard(hashes, len(paths))
    for s, path in enumerate(paths):
        mine = np.flatnonzero(part == s)
        if path is not None and len(mine):
            at = _find(np.frombuffer(_load(path, "keys"), np.uint64), hashes[mine])
            rank = np.frombuffer(_load(path, "ranks"), np.uint32)[at].astype(np.int64)
            out[mine] = np.where(at < 0, UNKNOWN, 1 + rank * len(paths) + s)
    return out


def _numbered(words: list[str | None], hashes: np.ndarray) -> np.ndarray:
    distinct, where = np.unique(hashes, return_inverse=True)
    return _numbers(words, distinct)[where]


def _cut(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array(d)[np.minimum(counts, 3).astype(np.int64) - 1]


def _single(words: Words, numbers: np.ndarray) -> np.ndarray:
    """p of single words, one shard of them at a time."""
    out, n = np.full(len(numbers), words.unseen), len(words.counts)
    at = numbers.astype(np.int64) - 1
    part = np.where(numbers == UNKNOWN, -1, at % n)
    for s, path in enumerate(words.counts):
        mine = np.flatnonzero(part == s)
        if path is not None and len(mine):
            seen = np.frombuffer(_load(path, "counts"), np.uint32)[at[mine] // n].astype(np.int64)
            out[mine] += (seen - _cut(seen, words.d1)) / words.everything
    return out


def _discounts(seen: np.ndarray) -> list[float]:
    """D1, D2 and D3+ from the counts of counts; where those are too few, 0.75 of a count."""
    n = [int(x) for x in seen]
    if not n[0] or not n[1]:
        return [0.75, 0.75, 0.75]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else 0.75 for i in range(3)]
    return [min(max(d, 0.05), i + 1 - 0.05) for i, d in enumerate(raw)]


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, 5).astype(np.int64), minlength=5)[1:5].tolist()


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, text numbers) of the words of some texts at a time."""
    hasher = WordHasher()
    for batch in batches:
        for part in pieces(batch, 0, HASH_BYTES):
            _, _, texts, hashes = hasher.words(*string_buffers(part.column(0)))
            if len(hashes):
                yield hashes, texts


def _runs(shard: np.ndarray, shards: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each shard, in the order they have."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        yield s, [c[order[cuts[s]:cuts[s + 1]]] for c in columns]


RUN = "shard long, run binary"


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.binary())],
                                      names=["shard", "run"])


def _number_words(texts: DataFrame, folder: str, shards: int) -> list[str | None]:
    """Numbers all words of the texts, in shards by their hash, and returns the shards' files."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send() -> pa.RecordBatch:
            h, n = _summed(keys, counts)
            return _batch([(s, _pack(_steps(x), y)) for s, (x, y) in _runs(_shard(h, shards), shards, h, n)])

        keys, counts = [], []
        for hashes, _ in _words_of(batches):
            h, n = np.unique(hashes, return_counts=True)
            keys.append(h)
            counts.append(n.astype(np.uint64))
            if sum(map(len, keys)) >= RUN_WORDS:
                yield send()
                keys, counts = [], []
        if keys:
            yield send()

    def write(table: pa.Table) -> pa.Table:
        runs = [_unpack(r.as_py(), np.uint64, np.uint64) for r in table.column("run")]
        h, n = _summed([np.cumsum(x, dtype=np.uint64) for x, _ in runs], [y for _, y in runs])
        ranks = np.empty(len(h), dtype=np.uint32)
        ranks[np.argsort(-n.astype(np.int64), kind="stable")] = np.arange(len(h), dtype=np.uint32)
        return pa.table({"shard": table.column("shard").slice(0, 1), "path": [_write(folder, "words", keys=h, ranks=ranks)]})

    rows = texts.mapInArrow(words, RUN).groupBy("shard").applyInArrow(write, "shard long, path string").collect()  # a row per shard
    by = {r["shard"]: r["path"] for r in rows}
    return [by.get(s) for s in range(shards)]


def _count_trigrams(texts: DataFrame, words: list[str | None], folder: str, shards: int) -> list:
    """Counts the trigrams of all texts in shards by the middle word and returns a row per shard:
    its file and how many trigrams and pairs were counted once to four times. A pair counts in
    how many contexts it is seen, not how often."""
    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send() -> pa.RecordBatch:
            ba, c, n = _summed_trigrams(*zip(*gathered))
            b, a = (ba >> HALF).astype(np.uint32), (ba & LOW).astype(np.uint32)
            return _batch([(s, _pack(_steps(x), _steps(y), z, m)) for s, (x, y, z, m)
                           in _runs(_shard(b, shards), shards, b, a, c, n)])

        gathered: list = []
        for hashes, owner in _words_of(batches):
            c = _numbered(words, hashes)
            a, b = _contexts(c, owner)
            ba = (b.astype(np.uint64) << HALF) | a
            gathered.append(_summed_trigrams([ba], [c], [np.ones(len(c), dtype=np.uint64)]))
            if sum(len(x[0]) for x in gathered) >= RUN_WORDS:
                yield send()
                gathered = []
        if gathered:
            yield send()

    def count(table: pa.Table) -> pa.Table:
        runs = [_unpack(r.as_py(), np.uint32, np.uint32, np.uint32, np.uint64) for r in table.column("run")]
        ba, c, n = _summed_trigrams(
            [(np.cumsum(b, dtype=np.uint32).astype(np.uint64) << HALF) | np.cumsum(a, dtype=np.uint32) for b, a, _, _ in runs],
            [c for _, _, c, _ in runs], [n for _, _, _, n in runs])
        b, a = (ba >> HALF).astype(np.uint32), (ba & LOW).astype(np.uint32)
        packed = np.frombuffer(_pack(_steps(b), _steps(a), c, n), np.uint8)
        _, n2 = np.unique((ba >> HALF << HALF) | c, return_counts=True)
        return pa.table({"shard": table.column("shard").slice(0, 1), "path": [_write(folder, "trigrams", packed=packed)],
                         "n3": [_counts_of_counts(n)], "n2": [_counts_of_counts(n2)]})

    return (texts.mapInArrow(trigrams, RUN).groupBy("shard")
            .applyInArrow(count, "shard long, path string, n3 array<long>, n2 array<long>").collect())  # a row per shard


def _trigrams(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, c, n) of a shard, ordered by b, a and c."""
    b, a, c, n = _unpack(_load(path, "packed").to_pybytes(), np.uint32, np.uint32, np.uint32, np.uint64)
    return np.cumsum(a, dtype=np.uint32), np.cumsum(b, dtype=np.uint32), c, n.astype(np.int64)


def _paths(spark: SparkSession, paths: list[str], of, schema: str) -> DataFrame:
    """What ``of`` yields for each path, one path in a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from of(paths[i])

    return spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(run, schema)


def _count_words(spark: SparkSession, trigrams: list[str], folder: str, shards: int) -> list:
    """Counts for each word the distinct words before it and returns a row per shard of words:
    its file, the sum of its counts, its words, and how many were counted once to four times."""
    def followers(path: str) -> Iterator[pa.RecordBatch]:
        _, b, c, _ = _trigrams(path)
        pairs = np.unique((b.astype(np.uint64) << HALF) | c)
        word, n = np.unique((pairs & LOW).astype(np.int64) - 1, return_counts=True)
        yield _batch([(s, _pack(_steps(x.astype(np.uint32)), y.astype(np.uint32))) for s, (x, y)
                      in _runs(word % shards, shards, word // shards, n)])

    def count(table: pa.Table) -> pa.Table:
        runs = [_unpack(r.as_py(), np.uint32, np.uint32) for r in table.column("run")]
        _, n = _summed([np.cumsum(x, dtype=np.uint32) for x, _ in runs], [y.astype(np.int64) for _, y in runs])
        path = _write(folder, "counts", counts=n.astype(np.uint32))  # every word of the texts is counted: no rank is left out
        return pa.table({"shard": table.column("shard").slice(0, 1), "path": [path], "total": [int(n.sum())],
                         "words": [len(n)], "n1": [_counts_of_counts(n)]})

    return (_paths(spark, trigrams, followers, RUN).groupBy("shard")
            .applyInArrow(count, "shard long, path string, total long, words long, n1 array<long>").collect())  # a row per shard


def train(trusted: DataFrame, text: str = "text", entries: int = SHARD_ENTRIES) -> list:
    """Counts the texts and writes the counts to the shared folder: the words in shards by their
    hash, the trigrams in shards of the middle word with about ``entries`` probabilities and
    weights each. Returns the words (see :class:`Words`), then the trigrams' paths; None stands
    for a shard without entries."""
    spark = trusted.sparkSession
    folder, staged = _folder(spark), f"training-{uuid.uuid4().hex}"
    texts = stage(trusted.select(text_of(f"`{text}`").alias("text")), f"{staged}/texts")
    size = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WORD_BYTES
    shards, word_shards = max(1, -(-5 * size // (2 * entries))), max(1, -(-size // (8 * entries)))
    words = _number_words(texts, folder, word_shards)
    rows = _count_trigrams(texts, words, folder, shards)
    remove(spark, f"{scratch_folder(spark)}/{staged}")
    d3, d2 = (_discounts(np.sum([r[k] for r in rows] or [[0] * 4], axis=0)) for k in ("n3", "n2"))
    by = {r["shard"]: r["path"] for r in rows}
    singles = _count_words(spark, list(by.values()), folder, word_shards)
    seen = np.sum([r["n1"] for r in singles] or [[0] * 4], axis=0)
    d1, total = _discounts(seen), sum(r["words"] for r in singles)
    everything = float(sum(r["total"] for r in singles) or 1)
    spare = sum(d * int(k) for d, k in zip(d1, (seen[0], seen[1], total - seen[0] - seen[1])))
    unseen = (spare / everything if total else 1.0) / (total + 1)
    counted = {r["shard"]: r["path"] for r in singles}
    return [Words(unseen, words, [counted.get(s) for s in range(word_shards)], everything, d1, d2, d3),
            *[by.get(s) for s in range(shards)]]


def _folder(spark: SparkSession) -> str:
    folder = f"{scratch_folder(spark)}/kneser-ney-{uuid.uuid4().hex}"
    return folder if "://" in folder else folder.replace("file:", "file://", 1)


def _write_lookup(path: str, words: Words, folder: str) -> str:
    """Writes a shard's discounted shares of seen trigrams and pairs and the weights that seen
    contexts leave to the next lower order: sorted keys, for each the place of its value among
    the distinct values, and these."""
    a, b, c, n = _trigrams(path)
    first = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (a[1:] != a[:-1])]))
    cut, total = _cut(n, words.d3), np.add.reduceat(n, first)
    sizes = np.diff(np.append(first, len(n)))
    keys = [_key(TRI, a, b, c), _key(CONTEXT2, a[first], b[first])]
    values = [(n - cut) / np.repeat(total, sizes), np.add.reduceat(cut, first) / total]
    pairs, n = np.unique((b.astype(np.uint64) << HALF) | c, return_counts=True)
    b, c = pairs >> HALF, pairs & LOW
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    cut, total = _cut(n, words.d2), np.add.reduceat(n, first)
    sizes = np.diff(np.append(first, len(n)))
    keys += [_key(BI, b, c), _key(CONTEXT1, b[first])]
    values += [(n - cut) / np.repeat(total, sizes), np.add.reduceat(cut, first) / total]
    key = np.concatenate(keys)
    order = np.argsort(key)
    table, places = np.unique(np.concatenate(values)[order], return_inverse=True)
    return _write(folder, "lookup", keys=key[order], places=places.astype(np.min_scalar_type(len(table))), table=table)


def _lookups(spark: SparkSession, shards: list[tuple[int, str]], words: Words, folder: str) -> dict[int, str]:
    def write(path: str) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"path": [path], "lookup": [_write_lookup(path, words, folder)]})

    rows = _paths(spark, [p for _, p in shards], write, "path string, lookup string").collect()  # a row per shard
    lookups = {r["path"]: r["lookup"] for r in rows}
    return {s: lookups[p] for s, p in shards}


def log_probabilities(a: np.ndarray, b: np.ndarray, c: np.ndarray, words: Words, shard: np.ndarray,
                      paths: dict[int, str]) -> np.ndarray:
    """ln p(c | a, b) of numbered words whose middle ones lie in the given shards."""
    distinct, where = np.unique(c, return_inverse=True)
    out = _single(words, distinct)[where]
    for s, (mine,) in _runs(shard, int(shard.max(initial=0)) + 1, np.arange(len(c))):
        if s not in paths:
            continue
        keys, table = np.frombuffer(_load(paths[s], "keys"), np.uint64), np.frombuffer(_load(paths[s], "table"), np.float64)
        data = _load(paths[s], "places")
        places = np.frombuffer(data, f"u{data.size // len(keys)}")

        def seen(rows: np.ndarray, kind: int, *of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The rows with an entry, and its value."""
            at = _find(keys, _key(kind, *[x[rows] for x in of]))
            return rows[at >= 0], table[places[at[at >= 0]]]

        rows, left = seen(mine, CONTEXT1, b)
        out[rows] *= left
        pairs, share = seen(rows, BI, b, c)
        out[pairs] += share
        rows, left = seen(rows, CONTEXT2, a, b)
        out[rows] *= left
        rows, share = seen(rows, TRI, a, b, c)
        out[rows] += share
    return np.log(out)


def score(docs: DataFrame, shards: list, doc_id: str = "doc_id", text: str = "text",
          lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang, n_words, log_p (sum over the words, natural log).

    The shards take turns in ``ROUNDS`` rounds. A document is known again in the next one by its
    doc_id, language and the hash of its text; rows alike in all three have the same sums."""
    spark, words, n = docs.sparkSession, shards[0], len(shards) - 1
    rounds = min(ROUNDS, n)
    rows = docs.select(text_of(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"),
                       F.col(f"`{lang}`").cast("string").alias("lang")).withColumn("key", F.xxhash64("text"))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang string, key long, n_words long, log_p double"

    def sums(paths: dict[int, str], turn: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = WordHasher()
            for batch in batches:
                for part in pieces(batch, 0, PIECE_BYTES):
                    found: list = []
                    for small in pieces(part, 0, HASH_BYTES):
                        _, _, texts, hashes = hasher.words(*string_buffers(small.column(0)))
                        found.append((hashes, texts, small.num_rows))
                    first = np.cumsum([0, *[m for _, _, m in found]])
                    c = _numbered(words.paths, np.concatenate([h for h, _, _ in found]))
                    texts = np.concatenate([t + f for (_, t, _), f in zip(found, first)])
                    n_words = np.bincount(texts, minlength=part.num_rows)
                    a, b = _contexts(c, texts)
                    shard = _shard(b, n)
                    mine = np.flatnonzero(shard % rounds == turn)
                    log_p = log_probabilities(a[mine], b[mine], c[mine], words, shard[mine], paths)
                    log_p = np.bincount(texts[mine], weights=log_p, minlength=part.num_rows).astype(float)
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n_words), pa.array(log_p)],
                                                     names=["doc_id", "lang", "key", "n_words", "log_p"])

        return rows.mapInArrow(run, schema)

    parts = []
    for turn in range(rounds):
        folder = _folder(spark)
        mine = [(s, p) for s, p in enumerate(shards[1:]) if p is not None and s % rounds == turn]
        parts.append(stage(sums(_lookups(spark, mine, words, folder), turn), "sums").withColumn("turn", F.lit(turn)))
        remove(spark, folder)
    each = [F.max(F.when(F.col("turn") == t, F.col("log_p"))) for t in range(rounds)]
    whole = functools.reduce(DataFrame.unionAll, parts).groupBy("doc_id", "lang", "key").agg(
        F.max("n_words").alias("n_words"), functools.reduce(operator.add, each).alias("log_p"),
        (F.count(F.lit(1)) / rounds).cast("int").alias("copies"))
    return whole.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("key", "copies")


def _distinct_texts(docs: DataFrame, sample: DataFrame, doc_id: str, text: str, entries: int = SHARD_ENTRIES) -> DataFrame:
    """Each distinct text of the documents named by ``sample`` once: (text).

    Only hashes are shuffled. The row that stands for a text is known by the hash of its doc_id and
    text, which tasks look up in sorted files; only rows alike in both meet by their text."""
    spark, folder = docs.sparkSession, _folder(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).filter("text IS NOT NULL")
    key = F.xxhash64("doc_id", "text")
    hashed = rows.select("doc_id", key.alias("key"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    shards = max(1, -(-sample.count() // entries))
    chosen = (hashed.join(sample, "doc_id", "left_semi").groupBy("t1", "t2", "key").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("t1", "t2").agg(F.min(F.struct("key", "n")).alias("s")).select("s.key", "s.n")
              .withColumn("shard", F.pmod("key", F.lit(shards))))

    def write(table: pa.Table) -> pa.Table:
        keys, again = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy() > 1
        order = np.argsort(keys)
        path = _write(folder, "texts", keys=keys[order], again=again[order].astype(np.uint8))
        return pa.table({"shard": table.column("shard").slice(0, 1), "path": [path], "again": [bool(again.any())]})

    files = chosen.groupBy("shard").applyInArrow(write, "shard long, path string, again boolean").collect()  # a row per shard
    paths = [(r["shard"], r["path"]) for r in files]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            found = np.full(len(key), -1)
            for s, path in paths:
                mine = np.flatnonzero(key % shards == s)
                at = _find(np.frombuffer(_load(path, "keys"), np.uint64), key[mine].view(np.uint64))
                again = np.frombuffer(_load(path, "again"), np.uint8)[at]
                found[mine] = np.where(at < 0, -1, again.astype(np.int64))
            taken = batch.filter(pa.array(found >= 0))
            yield pa.RecordBatch.from_arrays([taken.column(1), pa.array(found[found >= 0] > 0)], names=["text", "again"])

    picked = rows.select(key.alias("key"), "text").mapInArrow(pick, "text string, again boolean")
    if not any(r["again"] for r in files):
        return picked.select("text")
    return picked.filter("NOT again").select("text").unionAll(picked.filter("again").select("text").dropDuplicates())


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shrink: float = SHRINK,
             per_language: int | None = None, seed: int = 11, doc_id: str = "doc_id",
             text: str = "text", lang: str = "lang", quality: str = "quality") -> DataFrame:
    """One row per document: doc_id, lang, n_words, perplexity, threshold, kept.

    Trusted are the documents labelled with quality 1. All but a share of ``HELD_OUT``, drawn by a
    seeded hash of the doc_id, train the model (about ``per_language`` of each language at most, if
    given); all other trusted ones set the limits:
    per language the exact ``quantile`` of their perplexity. A language without held-out
    trusted documents takes the highest limit of the others; without any, all are kept. Perplexity
    counts ``shrink`` words of the average trusted rate in.

    Null text has no words: null perplexity, not kept. Null doc_ids are never trusted; a null
    language is a language of its own; repeated rows are scored each; an empty table gives no rows."""
    ids = (labels.filter(F.col(f"`{quality}`") == 1).select(F.col(f"`{doc_id}`").alias("doc_id"))
           .filter("doc_id IS NOT NULL").distinct())
    known = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), group_key(f"`{lang}`").alias("_lang"))
    trusted = stage(known.join(ids, "doc_id").distinct(), "trusted")
    most = F.lit(1.0) if per_language is None else F.lit(float(per_language)) / F.count(F.lit(1))
    share = trusted.groupBy("_lang").agg(most.alias("_share"))
    draw = (F.xxhash64(F.lit(seed), "doc_id") / F.lit(2.0 ** 64)) + 0.5
    drawn = trusted.join(share, "_lang").select("doc_id", "_lang", (draw < F.least("_share", F.lit(1 - HELD_OUT))).alias("_trains"))
    drawn = stage(drawn, "drawn")
    sample = drawn.filter("_trains").select("doc_id").distinct()
    shards = train(_distinct_texts(docs, sample, doc_id, text))
    scored = stage(score(docs, shards, doc_id, text, lang).withColumn("_lang", group_key("lang")), "scores")
    held = scored.join(drawn.filter("NOT _trains").select("doc_id", "_lang").distinct(), ["doc_id", "_lang"], "left_semi").filter("n_words > 0")
    mean = held.agg(F.sum("log_p") / F.sum("n_words")).first()[0]
    rate = F.lit(float(mean if mean is not None else 0.0))
    perplexity = F.exp(-(F.col("log_p") + shrink * rate) / (F.col("n_words") + shrink))
    ranked = running(held.select("_lang", "doc_id", perplexity.alias("x")), ["x", "doc_id"], by=["_lang"], rank="_r")
    sizes = ranked.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    limits = ranked.join(sizes, "_lang").filter(F.col("_r") == F.greatest(F.lit(1), F.ceil(F.col("_n") * quantile))).select("_lang", "x")
    limits = limits.groupBy("_lang").agg(F.max("x").alias("_limit"))
    highest = limits.agg(F.max("_limit")).first()[0]
    out = scored.join(limits, "_lang", "left").select(
        "doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, perplexity).alias("perplexity"),
        F.coalesce("_limit", F.lit(highest).cast("double")).alias("threshold"))
    return out.withColumn("kept", F.when(F.col("n_words") == 0, False).otherwise(
        F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))))
