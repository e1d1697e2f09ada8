"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned and sorted by doc_id; each partition encodes its texts and
writes three files: ``.bin``, the ids of all its documents as unsigned little-endian integers
of 16 bits (32 where the vocabulary is larger); ``.idx``, where each document begins and the
last ends, as 64-bit integers counted from the file's first id; ``.arrow``, the doc_ids. An index
table holds per file the number of documents and ids, and its base: the prefix sum of the ids
of all files before it. Readers map the files into memory.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerflow.llm.common import text_of, worker_cache
from offerflow.llm.wordhash import pieces
from offerflow.session import scratch_folder, shuffle_width, stage

#: Bytes of text per file, and how many parts of texts a worker remembers.
FILE_BYTES = 64 << 20
REMEMBERED = 1_000_000

# letters and signs that the pre-tokenizer's classes part in any surroundings
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ÿœŒ", r"!-&(-/:-@\[-`{-~"
_PART = re.compile(f" ?(?:[{_LETTER}]++|[{_SIGN}]++)(?=[{_LETTER}{_SIGN}]{{0,200}}(?:[ \n]|\\Z))|\n| ?[^ \n]+| ")
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_WIDE_GAP = re.compile(r"\s\s")


class ByteBpe:
    """A byte-level BPE of the tokenizers library, with memory for parts it has met.

    The pre-tokenizer never joins what lies on both sides of a single space between two
    non-space characters (the space begins the second part), nor of a single line end
    there, so text may be cut at them, and a word is encoded alike wherever it stands. A
    word of Latin letters and ASCII signs other than the apostrophe is cut further, between its runs
    of letters and of signs. A text with wider gaps is cut at its single spaces only; one with a special
    string of the vocabulary goes to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.type = np.dtype("<u4" if wide else "<u2")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        kind = "I" if self.type.itemsize == 4 else "H"
        return [array(kind, e.ids).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [text]
        if _WIDE_GAP.search(text):
            words = _INNER_SPACE.split(text)
            return [words[0], *[f" {w}" for w in words[1:]]]
        return _PART.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of :attr:`type`."""
        cut = [self._cut(t) for t in texts]
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        missing = list(set().union(*cut) - self.parts.keys())
        self.parts.update(zip(missing, self._encoded(missing)))
        get = self.parts.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]


def _encoder(path: str) -> ByteBpe:
    known = worker_cache("byte_bpe")
    if path not in known:
        known[path] = ByteBpe(path)
    return known[path]


def _files(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None,
                      doc_id: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files and returns the index table: file, n_docs, n_tokens, base, width (bytes
    of an id), in ``folder`` (by default a new one in the shared scratch folder).

    Documents come in ascending doc_id order, null ids first, equal ids by a hash of the text.
    Each ends with ``end_id``; null text is empty; repeated rows are written each; an empty
    table gives an index without rows. A task that runs again writes files of its own name,
    and only those of the successful run enter the index."""
    spark = docs.sparkSession
    folder = folder or f"{scratch_folder(spark)}/tokens-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("/"):
        folder = folder.replace("file:", "file://", 1)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), text_of(f"`{text}`").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(shuffle_width(docs), -(-total // file_bytes))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    placed = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, coder, names = TaskContext.get(), _encoder(vocabulary), None
        lengths, ids = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if names is None:
                fs, root = _files(folder)
                fs.create_dir(root, recursive=True)
                names = f"{task.partitionId():06d}-{task.taskAttemptId()}"
                out = fs.open_output_stream(f"{root}/{names}.bin")
                end = np.array([end_id], dtype=coder.type).tobytes()
            ids.append(batch.column(0))
            for part in pieces(batch, 1, 4 << 20):
                for encoded in coder.encode(part.column(1).to_pylist()):
                    out.write(encoded)
                    out.write(end)
                    lengths.append(len(encoded) // coder.type.itemsize + 1)
        if names is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.array(lengths, dtype="<i8"))]).astype("<i8")
        with fs.open_output_stream(f"{root}/{names}.idx") as f:
            f.write(offsets.tobytes())
        table = pa.table({"id": pa.chunked_array(ids)})
        with fs.open_output_stream(f"{root}/{names}.arrow") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([task.partitionId()], pa.int32()), "file": [f"{folder}/{names}"],
            "n_docs": [len(lengths)], "n_tokens": [int(offsets[-1])], "width": [coder.type.itemsize]})

    index = stage(placed.mapInArrow(write, "part int, file string, n_docs long, n_tokens long, width long"), "token-index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return index.select("part", "file", "n_docs", "n_tokens", "width",
                        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))


def _mapped(fs: pa.fs.FileSystem, path: str) -> pa.Buffer:
    if isinstance(fs, pa.fs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def open_shard(file: str, width: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids, offsets, doc_ids) of one file, as views of the mapped bytes."""
    fs, path = _files(file)
    ids = np.frombuffer(_mapped(fs, f"{path}.bin"), dtype=f"<u{width}")
    offsets = np.frombuffer(_mapped(fs, f"{path}.idx"), dtype="<i8")
    doc_ids = pa.ipc.open_file(_mapped(fs, f"{path}.arrow")).read_all().column("id").combine_chunks()
    return ids, offsets, doc_ids


def read_token_files(spark: SparkSession, index: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per document, read from the files: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, doc_ids = open_shard(row["file"], row["width"])
                for a in range(0, len(doc_ids), 10_000):
                    b = min(a + 10_000, len(doc_ids))
                    crc = [zlib.crc32(ids[offsets[i]:offsets[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.slice(a, b - a), pa.array(offsets[a:b] + row["base"]),
                         pa.array(np.diff(offsets[a:b + 1])), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = index.select("part", "file", "width", "base").repartition(shuffle_width(index), "part")
    return spread.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, vocabulary: str, end_id: int = 2, doc_id: str = "doc_id",
                text: str = "text", folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the token files of ``docs`` and reads them back: see :func:`write_token_files`
    and :func:`read_token_files`."""
    index = write_token_files(docs, vocabulary, end_id, folder, doc_id, text, file_bytes)
    return read_token_files(docs.sparkSession, index, docs.schema[doc_id].dataType.simpleString())
