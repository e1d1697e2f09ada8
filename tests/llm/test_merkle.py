"""The dataset manifest against brute force with hashlib."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offerflow.llm import merkle, queries, sha_lanes

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    out = []
    for c in COLUMNS:
        v = row[c]
        if v is None:
            out.append("-")
        else:
            v = str(v + more if c == "n_chars" else v)
            out.append(f"{len(v.encode())}:{v}")
    return h(*out)


def tree(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i:i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def refolded(levels, i, digest, siblings, fanout):
    for level in levels[:-1]:
        first = i // fanout * fanout
        run = level[first:first + fanout]
        siblings += [x for k, x in enumerate(run) if first + k != i]
        run[i - first] = digest
        digest, i = h(*run), i // fanout
    return digest


def brute(rows, fanout=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda t: t[:3])
        trees[g] = tree([t[2] for t in groups[g]], fanout)
    top = tree([trees[g][-1][0] for g in names], fanout)
    root = top[-1][0]
    for at, g in enumerate(names):
        for i, (_, _, digest, r) in enumerate(groups[g]):
            siblings, new = [], digest
            if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                new = leaf(r, 1)
            new = refolded(top, at, refolded(trees[g], i, new, siblings, fanout), siblings, fanout)
            yield r["doc_id"], digest, trees[g][-1][0], root, h(*siblings), new, new == root


def table(docs, **shape):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest_table(docs, tampered, {"n_chars": F.col("n_chars") + 1}, **shape)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.binary(min_size=32, max_size=32), min_size=1, max_size=9), st.integers(1, 3))
def test_lanes_equal_the_library(digests, times):
    rows = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)
    state = sha_lanes.start(len(rows))
    for _ in range(times):
        state = sha_lanes.compress(state, sha_lanes.hex_blocks(rows))
        state = sha_lanes.states_of(sha_lanes.state_rows(state))
    got = sha_lanes.finish(state, np.full(len(rows), times))
    assert [g.tobytes().hex() for g in got] == [h(d.hex() * times) for d in digests]


def test_state_before_a_slot_resumes(spark):
    rows = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(5)), dtype=np.uint8).reshape(-1, 32)
    nodes, states = merkle.grow(rows, 2, 3)
    assert [len(n) for n in nodes] == [5, 2, 1]
    text = [r.tobytes().hex() for r in rows]
    assert nodes[2][0].tobytes().hex() == h(h(*text[:3]), h(*text[3:]))
    resumed = sha_lanes.compress(sha_lanes.states_of(states[0][1, 1][None]), sha_lanes.hex_blocks(rows[4:]))
    assert sha_lanes.finish(resumed, np.array([2]))[0].tobytes() == nodes[1][1].tobytes()
    again = merkle.unpack(merkle.pack(nodes, states), 5, 2, 3)
    assert all((a == b).all() for a, b in zip(nodes + states, again[0] + again[1]))


@pytest.mark.parametrize("fanout,block_leaves", [(2, 16), (3, 27)])
def test_odd_rows(spark, odd_docs, fanout, block_leaves):
    """Nulls everywhere, repeated rows over several blocks, long text, clashing columns."""
    more = [(7, "again", None, "s", 5, 0.0, "x")] * 70 + [(None, "lost", None, None, 1, 0.0, "x")] * 3
    more += [(i, f"t{i}", "fr" if i % 2 else "é", "s", i, 0.0, "x") for i in range(61)]
    docs = odd_docs.union(spark.createDataFrame(more, odd_docs.schema))
    docs = docs.withColumn("digest", F.lit("z")).withColumn("pos", F.lit(1)).withColumn("block", F.lit(2))
    want = Counter(brute(docs.collect(), fanout))
    assert Counter(map(tuple, table(docs, fanout=fanout, block_leaves=block_leaves).collect())) == want


def test_single_and_empty(spark, odd_docs):
    assert table(odd_docs.limit(0)).collect() == []
    one = spark.createDataFrame([(3, "x " * 400_000, None, None, None)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    [row] = table(one).collect()
    assert tuple(row) == next(brute(one.collect()))
    assert row["leaf"] == row["root"] and row["verified"]


def test_manifest_keeps_digests_and_states(spark, small):
    made = merkle.build(small, block_leaves=16)
    [top] = made.group_layers[-1].collect()
    assert bytes(top["root"]).hex() == made.root
    per_group = {r["_g"]: r["n"] for r in made.leaves.groupBy("_g").agg(F.sum("n").alias("n")).collect()}
    stored = made.layers[0].groupBy("_g").agg(F.sum("n").alias("n")).collect()
    assert {r["_g"]: r["n"] for r in stored} == per_group
    for r in made.layers[0].collect():
        nodes, states = merkle.unpack(bytes(r["tree"]), r["n"], r["levels"], 2)
        assert nodes[-1][0].tobytes() == bytes(r["root"]) and len(states) == r["levels"]


def test_query(spark, small):
    got = queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001")
    assert Counter(map(tuple, got.collect())) == Counter(brute(small.collect()))
