"""The Jaccard join against all pairs by brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from offerflow.llm import jaccard, wordhash
from offerflow.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Per row (n, smallest reachable id), and the links between different sets."""
    sets = [shingles(r["text"]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links, holders = set(), defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].add(i)
    for i, s in enumerate(sets):
        near = Counter(j for g in s for j in holders[g] if j < i)
        for j, both in near.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                up[find(i)] = find(j)
                if s != sets[j]:
                    links.add(frozenset((s, sets[j])))
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            k = find(i)
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    return [(len(s), least.get(find(i)) if s else r["doc_id"]) for i, (s, r) in enumerate(zip(sets, rows))], links


def near_copies(spark):
    """Groups of texts with a few edits each: dense, chained, and just below the threshold."""
    rng = random.Random(2)
    rows, k = [], 0
    for edits in (1, 2, 3, 5):
        base = [f"g{edits}w{rng.randrange(200)}" for _ in range(90)]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(90)] = f"e{rng.randrange(10 ** 6)}"
            rows.append((k, " ".join(words)))
            k += 1
    chain = [f"c{i}" for i in range(200)]
    for step in range(0, 100, 6):
        rows.append((k, " ".join(chain[step:step + 100])))
        k += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("which", ["odd", "small", "near"])
def test_groups(spark, odd_docs, small, which):
    docs = {"odd": odd_docs, "small": small, "near": near_copies(spark)}[which]
    rows = docs.collect()
    want, links = brute(rows)
    got = jaccard.near_duplicate_groups(docs, chunk_bytes=20_000, bucket_bytes=50_000)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == Counter(
        (r["doc_id"], *w) for r, w in zip(rows, want))
    _, sets = jaccard.shingle_table(docs)
    assert jaccard.similar_pairs(sets).count() == len(links)
    stay = jaccard.one_of_each(docs)
    assert stay.columns == docs.columns
    empty = sum(not shingles(r["text"]) for r in rows)
    groups = got.filter("group IS NOT NULL").select("group").distinct().count()
    assert stay.count() == empty + groups


def test_no_documents(small):
    assert jaccard.near_duplicate_groups(small.limit(0)).count() == 0
    assert jaccard.one_of_each(small.limit(0)).count() == 0


def test_word_hashes():
    texts = ["", "a b a", "A\tB\n\nB ", "é" * 50 + " x", "é" * 50, "x" * 200 + " " + "x" * 136, " ", "ab", "b"]
    data, offsets = wordhash.string_buffers(pa.array(texts))
    start, end, text, value = wordhash.WordHasher().words(data, offsets)
    got = [(int(t), data[a:b].tobytes().decode()) for t, a, b in zip(text, start, end)]
    want = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t)]
    assert got == want
    by = defaultdict(set)
    for v, (_, w) in zip(value, want):
        by[w.translate(LOWER)].add(int(v))
    assert all(len(v) == 1 for v in by.values())
    assert len(set.union(*by.values())) == len(by)
    assert sum(p.num_rows for p in wordhash.pieces(pa.record_batch([pa.array(texts)], ["t"]), 0, 10)) == len(texts)


def test_connected(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    rows = connected(spark.createDataFrame(links, "a long, b long")).collect()
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[find(a)] = find(b)
    pairs = {(find(r["node"]), r["root"]) for r in rows}
    assert {r["node"] for r in rows} == {x for p in links if p[0] != p[1] for x in p}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
