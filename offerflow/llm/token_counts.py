"""Token counts with overlap resynchronisation for huge documents.

A text longer than a chunk is cut into overlapping chunks that are encoded apart, on as many
tasks as there are chunks. Two neighbours both have tokens in their overlap. A place right after white
space where a token of either begins is a stable boundary: the vocabulary's pre-tokenizer
drops white space and never looks across it, so from there on both encode alike. The counts
are spliced at the middle one of the common boundaries. Neighbours without one are encoded
again with wider overlaps, in the end as one chunk.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerflow.llm.common import text_of, worker_cache
from offerflow.llm.wordhash import pieces
from offerflow.session import shuffle_width, stage

#: Characters of a chunk, and by how many neighbours overlap at first.
CHUNK = 32_768
OVERLAP = 512
REMEMBERED = 250_000

_GAP = re.compile(r"[ \t\n\r]+")
_PART = re.compile(r"[a-zß-öø-ÿœ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class WordCounter:
    """Token counts by a tokenizer of the tokenizers library that drops white space: the count
    of a text is the sum over its words, and words met before are remembered. Within a word of
    Latin letters, digits and ASCII signs without apostrophe, runs of letters, single digits
    and runs of signs are counted alone, as the pre-tokenizer parts them. Words with one of the
    special strings, and all others, go to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        split = {}
        for w in words - self.words.keys():
            low = w.lower()
            found = _PART.findall(low)
            exact = "".join(found) == low and not any(s in w for s in self.special)
            split[w] = found if exact else [w]
        missing = list({p for ps in split.values() for p in ps} - self.parts.keys())
        self.parts.update(zip(missing, map(len, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False))))
        for w, ps in split.items():
            self.words[w] = sum(map(self.parts.__getitem__, ps))

    def count(self, texts: list[str]) -> list[int]:
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        self._learn({w for ws in cut for w in ws} | {""})
        get = self.words.__getitem__
        return [sum(map(get, ws)) for ws in cut]

    def boundaries(self, text: str, begin: int, low: int, high: int):
        """Tokens of the chunk ``text``, which begins at ``begin``; and for the stable boundaries
        before ``low`` and from ``high`` on, their places and the tokens before each."""
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        starts = np.array([a for a, _ in encoding.offsets], dtype=np.int64)
        # at least one gap lies between a boundary and the chunk's edges, where words may be cut
        after = np.array([m.end() for m in _GAP.finditer(text)], dtype=np.int64)[1:]
        after = after[(after < len(text)) & np.isin(after, starts)]
        before = np.searchsorted(starts, after)
        near = [(after + begin <= low), (after + begin >= high)]
        return len(starts), [(after[m] + begin, before[m]) for m in near]


def _counter(path: str) -> WordCounter:
    known = worker_cache("word_counter")
    if path not in known:
        known[path] = WordCounter(path)
    return known[path]


def _spliced(long: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of texts (row, text); n_tokens is null where neighbours don't align."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                step = max(chunk, overlap)
                last = max(1, -(-(len(text) - overlap) // step))
                for k in range(last):
                    a = k * step
                    b = len(text) if k == last - 1 else a + step + overlap
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([row], pa.int64()), "no": pa.array([k], pa.int64()),
                        "begin": pa.array([a], pa.int64()), "last": pa.array([k == last - 1]),
                        "piece": pa.array([text[a:b]], pa.string())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        kind = pa.list_(pa.int64())
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for r in batch.to_pylist():
                low = r["begin"] + overlap if r["no"] else -1
                high = r["begin"] + max(chunk, overlap) if not r["last"] else 1 << 62
                n, ((pl, nl), (ph, nh)) = counter.boundaries(r["piece"], r["begin"], low, high)
                for o, v in zip(out, (r["row"], r["no"], r["last"], n, pl, nl, ph, nh)):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()),
                 pa.array(out[3], pa.int64()), *[pa.array(o, kind) for o in out[4:]]],
                names=["row", "no", "last", "n", "left", "n_left", "right", "n_right"])

    chunks = long.mapInArrow(cut, "row long, no long, begin long, last boolean, piece string")
    encoded = chunks.repartition(shuffle_width(long), "row", "no").mapInArrow(
        encode, "row long, no long, last boolean, n long, left array<long>, n_left array<long>, "
                "right array<long>, n_right array<long>")
    in_text = Window.partitionBy("row").orderBy("no")

    def at(places: str, counts: str, place: Column) -> Column:
        return F.get(F.col(counts), (F.array_position(F.col(places), place) - 1).cast("int"))

    common = F.array_intersect("right", F.lead("left").over(in_text))
    cuts = encoded.withColumn("cut", F.when(~F.col("last"), F.get(common, F.floor(F.size(common) / 2).cast("int"))))
    cuts = cuts.withColumn("_from", F.lag("cut").over(in_text))
    ends = F.when(F.col("last"), F.col("n")).otherwise(at("right", "n_right", F.col("cut")))
    begins = F.when(F.col("no") == 0, F.lit(0)).otherwise(at("left", "n_left", F.col("_from")))
    return cuts.select("row", (ends - begins).alias("_n")).groupBy("row").agg(
        F.when(F.count("_n") == F.count(F.lit(1)), F.sum("_n")).alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, doc_id: str = "doc_id",
                 text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``).

    Counts are the library's own, without begin, end or added special tokens. Null text is empty;
    repeated rows are counted each; an empty table gives no rows. Short texts are counted
    where they lie; only longer ones are shuffled, chunk by chunk, so one huge document is many
    tasks."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(f"`{text}`").alias("text"))
    is_long = F.length("text") > chunk + overlap
    id_type = docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            for part in pieces(batch, 2, 4 << 20):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counter.count(part.column(2).to_pylist()), pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"])

    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    short = sized.filter(~is_long).mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([ids, *batch.columns], names=["row", *batch.schema.names])

    # the few long texts get a number each; written, so that a rerun can't change it
    long = stage(sized.filter(is_long).mapInArrow(number, f"row long, doc_id {id_type}, n_bytes long, text string"), "long-texts")
    done, todo, wider = None, long, overlap
    while True:
        tried = stage(_spliced(todo.select("row", "text"), vocabulary, chunk, wider), "spliced")
        aligned = tried.filter("n_tokens IS NOT NULL")
        done = aligned if done is None else done.union(aligned)
        missing = tried.filter("n_tokens IS NULL").select("row")
        if not missing.head(1):
            break
        wider *= 8
        todo = todo.join(missing, "row", "left_semi")
    counted = long.select("row", "doc_id", "n_bytes").join(done, "row").select("doc_id", "n_bytes", "n_tokens")
    return short.union(counted).withColumn("over_limit", F.col("n_tokens") > limit)
