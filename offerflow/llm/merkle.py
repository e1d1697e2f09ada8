"""A dataset manifest: a tree of SHA-256 digests that keeps the hash states between children.

Every row is a leaf; within a group (a language), and then over the groups, runs of ``fanout``
digests become the digest of their parent until one is left. A parent is hashed child by child,
and the state before each child's slot is copied and kept. To see what the root would be with
another leaf, its path is folded: at every level the kept state before the slot is resumed with
the replacement and the siblings right of it only; what stands left of it is not hashed again.

Leaves are numbered by range-partitioned ranks, and blocks of consecutive leaves become whole
subtrees, one group of bounded size each, however many rows a group of the tree holds. Roots of
blocks are the leaves of the next layer, so a few layers reach the root of any number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructType

from offerflow.llm import sha_lanes as sha
from offerflow.llm.common import group_key
from offerflow.operators.ordered import running
from offerflow.session import few_rows, stage

#: Leaves of one block, at most.
BLOCK_LEAVES = 8192


def leaf_digest(values: Sequence[Column]) -> Column:
    """Binary digest of a row: each value as UTF-8 byte count, ``:`` and text, ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
        for t in texts]), 256))


def lower_hex(digest: str | Column) -> Column:
    return F.lower(F.hex(digest))


# --- subtrees -------------------------------------------------------------------------------

def widths(n: int, levels: int, fanout: int) -> list[int]:
    """Nodes per level of a subtree of ``n`` leaves."""
    out = [n]
    for _ in range(levels):
        out.append(-(-out[-1] // fanout))
    return out


def levels_of(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def grow(leaves: np.ndarray, levels: int, fanout: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(digests per level, states per level above the leaves): digests are rows of 32 bytes,
    states have shape (parents, fanout, 32), one before each child slot."""
    nodes, states = [leaves], []
    for _ in range(levels):
        below = nodes[-1]
        parents = -(-len(below) // fanout)
        state, kept = sha.start(parents), np.empty((parents, fanout, 32), dtype=np.uint8)
        children = np.full(parents, fanout)
        children[-1] = len(below) - (parents - 1) * fanout
        for slot in range(fanout):
            kept[:, slot] = sha.state_rows(state)
            child = below[slot::fanout]
            if len(child):
                state[:, :len(child)] = sha.compress(state[:, :len(child)], sha.hex_blocks(child))
        nodes.append(sha.finish(state, children))
        states.append(kept)
    return nodes, states


def pack(nodes: list[np.ndarray], states: list[np.ndarray]) -> bytes:
    return b"".join(x.tobytes() for x in [*nodes, *states])


def unpack(tree: bytes, n: int, levels: int, fanout: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    data, at, nodes, states = np.frombuffer(tree, dtype=np.uint8), 0, [], []
    sizes = widths(n, levels, fanout)
    for w in sizes:
        nodes.append(data[at:at + 32 * w].reshape(w, 32))
        at += 32 * w
    for w in sizes[1:]:
        states.append(data[at:at + 32 * w * fanout].reshape(w, fanout, 32))
        at += 32 * w * fanout
    return nodes, states


def steps_up(nodes: list[np.ndarray], states: list[np.ndarray], place: np.ndarray,
             fanout: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per level for the leaves at ``place``: (slot, children of the run, state before the slot,
    digests of the run of shape (lanes, fanout, 32); those beyond its children are void)."""
    for level, kept in enumerate(states):
        slot, parent = place % fanout, place // fanout
        width = len(nodes[level])
        count = np.minimum(fanout, width - parent * fanout)
        run = nodes[level][np.minimum(parent[:, None] * fanout + np.arange(fanout), width - 1)]
        yield slot, count, kept[parent, slot], run
        place = parent


def stored_steps(path: bytes, fanout: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The steps of one packed path, in the form of :func:`steps_up` with a single lane."""
    size = 8 + 32 + 32 * fanout
    for at in range(0, len(path), size):
        step = np.frombuffer(path, dtype=np.uint8, count=size, offset=at)
        slot, count = step[:8].view("<u4")
        yield (np.array([slot], dtype=np.int64), np.array([count], dtype=np.int64),
               step[8:40].reshape(1, 32), step[40:].reshape(1, fanout, 32))


def packed_steps(nodes, states, place: np.ndarray, fanout: int) -> list[bytes]:
    out = [b""] * len(place)
    for slot, count, state, run in steps_up(nodes, states, place, fanout):
        head = np.stack([slot, count], axis=1).astype("<u4")
        for i in range(len(out)):
            out[i] += head[i].tobytes() + state[i].tobytes() + run[i].tobytes()
    return out


def fold(digests: np.ndarray, steps, fanout: int, siblings: tuple[np.ndarray, np.ndarray]):
    """(digests at the top, hash state and number of the siblings met) for replaced ``digests``.

    Each step resumes the state before the slot; only the replacement and the siblings right of
    it are hashed."""
    met, n_met = siblings
    for slot, count, state, run in steps:
        now = sha.compress(sha.states_of(state), sha.hex_blocks(digests))
        if now.shape[1] != len(digests):
            now = np.repeat(now, len(digests), axis=1)
        for other in range(fanout):
            is_sibling = (other < count) & (other != slot)
            if not is_sibling.any():
                continue
            block = sha.hex_blocks(run[:, other])
            met = np.where(is_sibling, sha.compress(met, block), met)
            n_met = n_met + is_sibling
            to_right = is_sibling & (other > slot)
            if to_right.any():
                now = np.where(to_right, sha.compress(now, block), now)
        digests = sha.finish(now, np.broadcast_to(count, len(digests)))
    return digests, (met, n_met)


# --- layers -----------------------------------------------------------------------------------

def _block_levels(block_leaves: int, fanout: int) -> int:
    levels = 1
    while fanout ** (levels + 1) <= block_leaves:
        levels += 1
    return levels


def _digest_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def _layer(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Blocks of the nodes (_g, pos, n, digest, total): _g, block, n, levels, total (nodes of the
    next layer), root, tree. ``n`` is the number of equal nodes in a row from ``pos`` on."""
    size = fanout ** levels

    def build_block(key, rows):
        rows = rows.sort_by("pos")
        total = rows.column("total")[0].as_py()
        first = key[1].as_py() * size
        a = np.maximum(rows.column("pos").to_numpy(), first)
        b = np.minimum((rows.column("pos").to_numpy() + rows.column("n").to_numpy()), first + size)
        leaves = np.repeat(_digest_rows(rows.column("digest")), b - a, axis=0)
        high = min(levels, levels_of(total, fanout))
        made = grow(leaves, high, fanout)
        return pa.table({"_g": [key[0].as_py()], "block": [key[1].as_py()], "n": [len(leaves)],
                         "levels": pa.array([high], pa.int32()), "total": [-(-total // size)],
                         "root": [made[0][-1][0].tobytes()], "tree": [pack(*made)]})

    return stage(_in_blocks(nodes, size).groupBy("_g", "block").applyInArrow(
        build_block, "_g string, block long, n long, levels int, total long, root binary, tree binary"), "tree-layer")


def _in_blocks(nodes: DataFrame, size: int) -> DataFrame:
    """A row per node and block; equal nodes in a row may fill several blocks."""
    return nodes.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("pos") / size), F.floor((F.col("pos") + F.col("n") - 1) / size))))


def _layers(nodes: DataFrame, fanout: int, levels: int, largest: int) -> list[DataFrame]:
    """Layers of blocks, the last with one block per _g."""
    size, out = fanout ** levels, [_layer(nodes, fanout, levels)]
    while largest > size:
        largest = -(-largest // size)
        out.append(_layer(out[-1].select("_g", F.col("block").alias("pos"), F.lit(1).cast("long").alias("n"),
                                         F.col("root").alias("digest"), "total"), fanout, levels))
    return out


def _paths(layers: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The lowest layer with the path from each block's root to the root of all, given the paths
    (_g, path) of the last layer's blocks."""
    upper = layers[-1].join(top, "_g")
    for layer in reversed(layers[:-1]):
        upper = stage(_descend(layer, upper, fanout, levels), "tree-paths")
    return upper


def _descend(blocks: DataFrame, upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    size = fanout ** levels

    def down(key, low, high):
        if not high.num_rows or not low.num_rows:
            return low.select(names).append_column("path", pa.array([], pa.binary()))
        above = high.to_pylist()[0]
        tree = unpack(above["tree"], above["n"], above["levels"], fanout)
        steps = packed_steps(*tree, low.column("block").to_numpy() % size, fanout)
        return low.select(names).append_column("path", pa.array([s + above["path"] for s in steps], pa.binary()))

    names = ["_g", "block", "n", "levels", "root", "tree"]
    return (blocks.select(*names, F.floor(F.col("block") / size).alias("up")).groupBy("_g", "up")
            .cogroup(upper.select("_g", F.col("block").alias("up"), "n", "levels", "tree", "path").groupBy("_g", "up"))
            .applyInArrow(down, "_g string, block long, n long, levels int, root binary, tree binary, path binary"))


# --- manifest -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Manifest:
    """``leaves``: _g, key, carried columns, digest, pos, n (equal rows stand in a row), total.
    ``layers``: written tables of blocks per layer, with all digests and kept states; ``group_layers``
    the same above the groups. ``subroots``: _g, digest. ``root`` is None for an empty dataset."""

    leaves: DataFrame
    layers: list[DataFrame]
    group_layers: list[DataFrame]
    subroots: DataFrame
    root: str | None
    key: str
    carried: tuple[str, ...]
    fanout: int
    levels: int


def build(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
          group: str = "lang", key: str = "doc_id", carry: Mapping[str, Column] | None = None,
          fanout: int = 2, block_leaves: int = BLOCK_LEAVES) -> Manifest:
    """The manifest of ``docs``. ``carry`` names further columns to keep with each leaf, such as
    the digest of a changed row.

    Leaves of a group ascend by ``key``, null keys first, equal keys by digest; a null group is a
    group of its own, before the others; groups stand in bytewise order. Nulls in other columns
    are ``-``, empty text is ``0:``, text is hashed whole. Rows alike in every column are leaves
    of their own; they move as one row with their number. Other columns are not read. An empty
    table has no root and no rows."""
    carry = dict(carry or {})
    levels = _block_levels(block_leaves, fanout)
    rows = docs.select(
        group_key(f"`{group}`").alias("_g"), F.col(f"`{key}`").alias("_key"),
        leaf_digest([F.col(f"`{c}`") for c in columns]).alias("digest"),
        *[c.alias(f"_x_{name}") for name, c in carry.items()])
    carried = [f"_x_{name}" for name in carry]
    leaves = stage(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "leaves")
    totals = stage(leaves.groupBy("_g").agg(F.sum("n").alias("total")), "leaf-totals")
    largest = totals.agg(F.max("total")).first()[0]
    placed = running(leaves, ["_key", "digest", *carried], by=["_g"], sums=["n"], rank="_rank").select(
        "_g", "_key", *carried, "digest", "n", (F.col("cum_n") - F.col("n")).alias("pos"))
    placed = placed.join(few_rows(totals), "_g")
    empty = largest is None
    layers = _layers(placed.select("_g", "pos", "n", "digest", "total"), fanout, levels, largest or 0)
    subroots = layers[-1].select("_g", F.col("root").alias("digest"))
    n_groups = 0 if empty else subroots.count()
    ranked = running(subroots, ["_g"], rank="_rank").select(
        F.lit("").alias("_g"), (F.col("_rank") - 1).alias("pos"), F.lit(1).cast("long").alias("n"), "digest",
        F.lit(n_groups).cast("long").alias("total"), F.col("_g").alias("name"))
    group_layers = _layers(ranked.drop("name"), fanout, levels, n_groups)
    root = None if empty else bytes(group_layers[-1].first()["root"]).hex()
    return Manifest(placed, layers, group_layers, ranked.select(F.col("name").alias("_g"), "digest", "pos"),
                    root, key, tuple(carry), fanout, levels)


def _group_paths(manifest: Manifest) -> DataFrame:
    """(_g, path): from each group's subroot to the root of all."""
    fanout, size = manifest.fanout, manifest.fanout ** manifest.levels
    spark = manifest.leaves.sparkSession
    end = spark.createDataFrame([("", b"")], "_g string, path binary")
    upper = _paths(manifest.group_layers, F.broadcast(end), fanout, manifest.levels)

    def down(key, low, high):
        if not high.num_rows or not low.num_rows:
            return pa.table({"_g": pa.array([], pa.string()), "path": pa.array([], pa.binary())})
        above = high.to_pylist()[0]
        tree = unpack(above["tree"], above["n"], above["levels"], fanout)
        steps = packed_steps(*tree, low.column("pos").to_numpy() % size, fanout)
        return pa.table({"_g": low.column("_g"), "path": pa.array([s + above["path"] for s in steps], pa.binary())})

    low = manifest.subroots.select("_g", "pos", F.floor(F.col("pos") / size).alias("up")).groupBy("up")
    high = upper.select(F.col("block").alias("up"), "n", "levels", "tree", "path").groupBy("up")
    return stage(low.cogroup(high).applyInArrow(down, "_g string, path binary"), "group-paths")


def folded(manifest: Manifest, changed: str | None = None) -> DataFrame:
    """One row per row of the dataset: key, carried columns, leaf, subroot, root, proof_sha256 (hash
    of the siblings from leaf to root), folded_root (the root with the row's leaf replaced by
    the carried digest ``changed``, where that is not null) and verified (it equals the root).

    Rows meet the subtree of their block, and only it, in one co-grouped shuffle."""
    fanout, size = manifest.fanout, manifest.fanout ** manifest.levels
    leaves = manifest.leaves
    group_paths = _group_paths(manifest)
    blocks = _paths(manifest.layers, few_rows(group_paths), fanout, manifest.levels)
    carried = [f"_x_{name}" for name in manifest.carried]
    names = ["_g", "_key", *carried, "digest"]
    shape = StructType([leaves.schema[c] for c in names]).add("_proof", BinaryType()).add("_root", BinaryType())
    schema = to_arrow_schema(shape)
    replaced = F.coalesce(f"_x_{changed}", "digest") if changed else F.col("digest")

    def refold(key, low, high):
        if not low.num_rows or not high.num_rows:
            return schema.empty_table()
        low = low.sort_by("pos")
        first = key[1].as_py() * size
        pos, n = low.column("pos").to_numpy(), low.column("n").to_numpy()
        a, b = np.maximum(pos, first), np.minimum(pos + n, first + size)
        which = np.repeat(np.arange(len(pos)), b - a)
        above = high.to_pylist()[0]
        tree = unpack(above["tree"], above["n"], above["levels"], fanout)
        digests = _digest_rows(low.column("_new"))[which]
        proof = sha.start(len(which)), np.zeros(len(which), dtype=np.int64)
        digests, proof = fold(digests, steps_up(*tree, np.arange(len(which)), fanout), fanout, proof)
        digests, proof = fold(digests, stored_steps(above["path"], fanout), fanout, proof)
        out = low.select(names).take(pa.array(which))
        out = out.append_column("_proof", pa.array([r.tobytes() for r in sha.finish(*proof)], pa.binary()))
        return out.append_column("_root", pa.array([r.tobytes() for r in digests], pa.binary())).cast(schema)

    low = _in_blocks(leaves.withColumn("_new", replaced), size)
    out = low.groupBy("_g", "block").cogroup(
        blocks.select("_g", "block", "n", "levels", "tree", "path").groupBy("_g", "block")).applyInArrow(refold, shape)
    subroots = few_rows(manifest.subroots.select("_g", F.col("digest").alias("_subroot")))
    return out.join(subroots, "_g").select(
        F.col("_key").alias(manifest.key), *[F.col(f"_x_{c}").alias(c) for c in manifest.carried],
        lower_hex("digest").alias("leaf"), lower_hex("_subroot").alias("subroot"),
        F.lit(manifest.root).cast("string").alias("root"), lower_hex("_proof").alias("proof_sha256"),
        lower_hex("_root").alias("folded_root"),
        (lower_hex("_root") == F.lit(manifest.root)).alias("verified"))


def manifest_table(docs: DataFrame, tampered: Column, changes: Mapping[str, Column],
                   columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
                   group: str = "lang", key: str = "doc_id", fanout: int = 2,
                   block_leaves: int = BLOCK_LEAVES) -> DataFrame:
    """Builds the manifest and folds every row; rows where ``tampered`` holds are folded with
    the ``changes`` of their columns. Odd inputs as in :func:`build`."""
    other = leaf_digest([changes.get(c, F.col(f"`{c}`")) for c in columns])
    manifest = build(docs, columns, group, key, {"changed": F.when(tampered, other)}, fanout, block_leaves)
    return folded(manifest, "changed").drop("changed")
