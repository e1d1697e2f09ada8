"""N-gram Jaccard join by rare-first prefix filtering.

1. One pass hashes each text's distinct shingles. Every chunk of texts deals its shingles, six
   bytes each, to buckets by hash.
2. A bucket counts exactly how many texts have each shingle and sends those found twice or
   more back to their chunks. A shingle of one text can make no pair, so what a text gets
   back holds its part of every overlap.
3. A text is put in order, rarest shingle first. If more of it than the threshold allows is
   its own, it is done. The others post their prefix.
4. Posted shingles meet by equality under length and positional filters. Pairs are made
   unique, put through a suffix filter, and verified once from the shared shingles.

Texts with equal sets are one class. For groups, classes first meet the most central class of
each posted shingle; then, exactly, classes of different components only, so a group of
thousands of alike texts never makes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.llm.common import KEY, pick_rows, row_key, text_of
from offerflow.llm.components import connected
from offerflow.llm.wordhash import WordHasher, mix, pieces, shingle_sets, string_buffers
from offerflow.session import shuffle_width, stage

#: Bytes of text per chunk, and of corpus per bucket: what a task holds at once.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20

_LOW48 = np.uint64((1 << 48) - 1)


def _pack(place: np.ndarray, shingles: np.ndarray, width: int) -> bytes:
    """Texts' places (rising) as differences in byte planes, then the low bytes of the shingles."""
    steps = np.diff(place, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    low = shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(steps.T).tobytes() + np.ascontiguousarray(low).tobytes()


def _unpack(blob, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(blob, dtype=np.uint8)
    n = len(raw) // (4 + width)
    steps = np.ascontiguousarray(raw[:4 * n].reshape(4, n).T).view("<u4").reshape(-1)
    low = np.zeros((n, 8), dtype=np.uint8)
    low[:, :width] = raw[4 * n:].reshape(n, width)
    return np.cumsum(steps.astype(np.int64)), low.reshape(-1).view("<u8").astype(np.uint64)


def shingle_table(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id",
                  text: str = "text", chunk_bytes: int = CHUNK_BYTES,
                  bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two staged tables.

    Documents: row key, doc_id, sig (class of equal sets; null without words), n (set size).
    Sets: sig, n, tokens, one row per class that can have a partner. Tokens are the shingles
    found in two texts or more, as ``min(count, 32767) * 2**48 + 48 bits of hash``, rising."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), row_key(docs, doc_id)[1].alias("key"),
                       text_of(f"`{text}`").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(docs), -(-total // bucket_bytes))
    id_type = docs.schema[doc_id].dataType.simpleString()
    dealt_schema = (f"bucket int, chunk long, blob binary, ids array<{id_type}>, "
                    "keys array<long>, sigs array<long>, ns array<long>")
    empty_docs = [None, None, None, None]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, chunk, out = WordHasher(), TaskContext.get().partitionId() << 32, None
        for batch in batches:
            schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary()),
                                ("ids", pa.list_(batch.schema.field("id").type)),
                                ("keys", pa.list_(pa.int64())), ("sigs", pa.list_(pa.int64())),
                                ("ns", pa.list_(pa.int64()))])
            for part in pieces(batch, 2, chunk_bytes):
                data, offsets = string_buffers(part.column(2))
                _, _, texts, hashes = hasher.words(data, offsets)
                shingles, owner = shingle_sets(hashes, texts, part.num_rows, n)
                sizes = np.bincount(owner, minlength=part.num_rows)
                firsts = np.cumsum(sizes) - sizes
                sums = np.zeros(part.num_rows, dtype=np.uint64)
                if len(shingles):
                    full = sizes > 0
                    sums[full] = np.add.reduceat(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), firsts[full])
                sigs = mix(sums + sizes.astype(np.uint64)).view(np.int64)
                one = np.zeros(part.num_rows, dtype=bool)  # the first of the chunk's equal sets
                one[np.unique(sigs, return_index=True)[1]] = True
                use = one[owner]
                shingles, owner = shingles[use] >> np.uint64(16), owner[use]
                bucket = ((shingles >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
                bucket, shingles, owner = bucket[order], shingles[order], owner[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
                made = [[int(bucket[a]), chunk, _pack(owner[a:b], shingles[a:b], 6), *empty_docs]
                        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                made.append([chunk % buckets, chunk, None, part.column(0).to_pylist(),
                             part.column(1).to_pylist(), sigs.tolist(), sizes.tolist()])
                chunk += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    def count(table: pa.Table) -> pa.Table:
        blobs = table.column("blob")
        has = [b.is_valid for b in blobs]
        chunks, places, hashes = [], [], []
        for c, b, ok in zip(table.column("chunk").to_pylist(), blobs, has):
            if ok:
                place, h = _unpack(b.as_buffer(), 6)
                chunks.append(np.full(len(h), c))
                places.append(place)
                hashes.append(h)
        passed = table.filter(pa.array([not x for x in has]))
        if not hashes:
            return passed
        chunk, place, h = map(np.concatenate, (chunks, places, hashes))
        order = np.argsort(h)
        h = h[order]
        cuts = np.flatnonzero(np.append(np.insert(h[1:] != h[:-1], 0, True), True))
        times = np.repeat(np.diff(cuts), np.diff(cuts))
        twice = times > 1
        tokens = (np.minimum(times[twice], 32767).astype(np.uint64) << np.uint64(48)) | h[twice]
        chunk, place = chunk[order[twice]], place[order[twice]]
        order = np.lexsort((place, chunk))
        chunk, place, tokens = chunk[order], place[order], tokens[order]
        cuts = np.flatnonzero(np.append(np.insert(chunk[1:] != chunk[:-1], 0, True), True)) if len(chunk) else []
        made = [[-1, int(chunk[a]), _pack(place[a:b], tokens[a:b], 8), *empty_docs]
                for a, b in zip(cuts[:-1], cuts[1:])]
        if not made:
            return passed
        return pa.concat_tables([passed, pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*made), table.schema)], schema=table.schema)])

    def gather(table: pa.Table) -> pa.Table:
        where = [i for i, x in enumerate(table.column("sigs")) if x.is_valid]
        row = table.slice(where[0], 1)
        sigs = np.array(row.column("sigs")[0].as_py(), dtype=np.int64)
        sizes = np.array(row.column("ns")[0].as_py(), dtype=np.int64)
        parts = [_unpack(b.as_buffer(), 8) for b in table.column("blob") if b.is_valid]
        sets: list = [None] * len(sigs)
        if parts:
            place, tokens = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((tokens, place))
            place, tokens = place[order], tokens[order].view(np.int64)
            cuts = np.searchsorted(place, np.arange(len(sigs) + 1))
            # a partner shares percent of the set at least, so at least that much comes back
            enough = (np.diff(cuts) > 0) & (100 * np.diff(cuts) >= percent * sizes)
            for i in np.flatnonzero(enough).tolist():
                sets[i] = tokens[cuts[i]:cuts[i + 1]]
        ids = row.column("ids").combine_chunks().flatten()
        return pa.Table.from_arrays(
            [ids, row.column("keys").combine_chunks().flatten(),
             pa.array(sigs, mask=sizes == 0), pa.array(sizes), pa.array(sets, pa.list_(pa.int64()))],
            names=["doc_id", "key", "sig", "n", "tokens"])

    spread = rows.mapInArrow(deal, dealt_schema)
    counted = spread.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, dealt_schema)
    gathered = counted.groupBy("chunk").applyInArrow(
        gather, f"doc_id {id_type}, key long, sig long, n long, tokens array<long>")
    table = stage(gathered, "shingles")
    documents = table.select(F.col("doc_id").cast("string").alias(KEY[0]), F.col("key").alias(KEY[1]),
                             "doc_id", "sig", "n")
    sets = table.filter("tokens IS NOT NULL").select("sig", "n", "tokens").dropDuplicates(["sig"])
    return documents, stage(sets, "sets")


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(token, sig, n, place) of every shared shingle in a prefix: place counts from 0 in the
    whole order, where the text's own shingles come first."""
    own = F.col("n") - F.size("tokens")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return (sets.withColumn("_own", own).withColumn("_length", (prefix - own).cast("int")).filter("_length > 0")
            .select("sig", "n", "_own", F.posexplode(F.expr("slice(tokens, 1, _length)")).alias("_at", "token"))
            .select("token", "sig", "n", (F.col("_at") + F.col("_own")).alias("place")))


def _can_pair(x: str, y: str, percent: int):
    """Length and positional filter for a shingle met at both places: what can still overlap
    reaches the threshold."""
    rest = F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place"))
    return (rest * (100 + percent) >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))) & (
        100 * F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) >= percent * F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, overlap) of the distinct pairs that reach the threshold."""
    one = sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    other = sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    joined = pairs.select("a", "b").distinct().join(one, "a").join(other, "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def may_reach(x: np.ndarray, y: np.ndarray, most: int, depth: int) -> int:
            # least number of tokens in one of the two only: split both at a token of x
            if depth == 0 or not len(x) or not len(y):
                return abs(len(x) - len(y))
            mid = len(x) // 2
            cut = int(np.searchsorted(y, x[mid]))
            if abs(mid - cut) + abs(len(x) - mid - len(y) + cut) > most:
                return most + 1
            low = may_reach(x[:mid], y[:cut], most, depth - 1)
            return low + may_reach(x[mid:], y[cut:], most - low, depth - 1) if low <= most else low

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ta, tb = batch.column(4), batch.column(5)
            out = []
            for i in range(len(a)):
                x, y = ta[i].values.to_numpy(), tb[i].values.to_numpy()
                need = -(-percent * (na[i] + nb[i]) // (100 + percent))
                if may_reach(x, y, len(x) + len(y) - 2 * need, 3) > len(x) + len(y) - 2 * need:
                    continue
                overlap = len(np.intersect1d(x, y, assume_unique=True))
                if overlap >= need:
                    out.append((a[i], b[i], overlap))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 names=["a", "b", "overlap"])

    return joined.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(verify, "a long, b long, overlap long")


def similar_pairs(sets: DataFrame, percent: int = 80) -> DataFrame:
    """All links between classes (sigs ``a`` < ``b``) with their overlap: the whole join."""
    posts = _postings(sets, percent)
    x, y = posts.alias("x"), posts.alias("y")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.sig") < F.col("y.sig"))
                   & _can_pair("x", "y", percent))
    return _verified(pairs.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")), sets, percent)


def class_groups(sets: DataFrame, percent: int = 80) -> DataFrame:
    """(node, root): the components of the classes that link with another."""
    posts = stage(_postings(sets, percent), "postings")
    centre = posts.groupBy("token").agg(
        F.count(F.lit(1)).alias("_c"), F.min(F.struct("place", "n", "sig")).alias("_m")
    ).filter("_c > 1").select("token", "_m.place", "_m.n", "_m.sig")
    star = posts.alias("x").join(centre.alias("y"), (F.col("x.token") == F.col("y.token"))
                                 & (F.col("x.sig") != F.col("y.sig")) & _can_pair("x", "y", percent))
    first = stage(_verified(star.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")),
                            sets, percent).select("a", "b"), "star-links")
    roots = connected(first)
    # posted shingles whose texts are not yet of one component
    named = posts.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select(
        *posts.columns, F.coalesce("root", "sig").alias("comp"))
    named = stage(named, "postings")
    per = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("_c"))
    mixed = (per.groupBy("token").agg(F.count(F.lit(1)).alias("_k"), F.max(F.struct("_c", "comp")).alias("_m"))
             .filter("_k > 1").select("token", F.col("_m.comp").alias("main")))
    x = named.join(mixed, "token").filter("comp != main").alias("x")
    y = named.alias("y")
    cross = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp"))
                   & _can_pair("x", "y", percent))
    pairs = cross.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b"))
    return connected(first.union(_verified(pairs, sets, percent).select("a", "b")))


def near_duplicate_groups(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id",
                          text: str = "text", **sizes) -> DataFrame:
    """One row per document: the row key, doc_id, n_shingles, component_id, group.

    ``component_id`` is the smallest doc_id reachable by links (null where no document of the
    component has one); ``group`` names the component, null for texts without words, which link with
    nothing: their component_id is their own doc_id. Null text has no words; repeated rows
    have equal sets and share a component; an empty table gives no rows."""
    documents, sets = shingle_table(docs, n, percent, doc_id, text, **sizes)
    roots = class_groups(sets, percent)
    classes = documents.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("_first"))
    grouped = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select(
        "sig", "_first", F.coalesce("root", "sig").alias("group"))
    grouped = stage(grouped, "classes")
    least = grouped.groupBy("group").agg(F.min("_first").alias("component_id"))
    named = grouped.join(least, "group").select("sig", "group", "component_id")
    return documents.join(named, "sig", "left").select(
        *KEY, "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "group")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the smallest doc_id, then the
    smallest row key. Texts without words all stay."""
    groups = near_duplicate_groups(docs, doc_id=doc_id, **settings)
    first = groups.filter("group IS NOT NULL").groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("_k")).select(
        *[F.col(f"_k.{k}") for k in KEY], F.lit(1).alias("copies"))
    empty = groups.filter("group IS NULL").select(*KEY, F.lit(1).alias("copies"))
    return pick_rows(docs, first.union(empty), "copies", doc_id)
