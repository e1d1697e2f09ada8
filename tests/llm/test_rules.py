"""Quality rules, mixing and the hash tree against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from offerflow.llm import hash_tree, line_rules, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i:i + 3])].append(i)
    hit = {k for p in at.values() if len(p) > 1 for i in p for k in (i, i + 1, i + 2)}
    lines, seen, dup = [l for l in text.split("\n") if WORD.search(l)], set(), 0
    for l in lines:
        dup += l in seen
        seen.add(l)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@pytest.mark.parametrize("which", ["odd_docs", "small"])
def test_base_rules(request, which):
    docs = request.getfixturevalue(which)
    rows = Counter((r["doc_id"], base_rules(r["text"])) for r in docs.collect())
    got = Counter((r["doc_id"], tuple(r[f] for f in FIELDS))
                  for r in line_rules.quality_report(docs).collect())
    assert got == rows


def test_line_frequency(spark):
    filler = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(40)]
    common = " ".join(f"c{k}" for k in range(55))
    rows = [(i, f"{filler[i]}\n{common.upper() if i % 2 else common}  ", "h") for i in range(30)]
    rows += [(100 + i, common, "h") for i in range(5)] + [(200, common, "other"), (201, common, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_rules.quality_report(docs, max_docs=20).collect()}
    assert all(got[i]["words_removed"] == 55 and got[i]["kept"] for i in range(30))
    assert all(got[100 + i]["depleted"] and not got[100 + i]["kept"] for i in range(5))
    assert got[200]["kept"] and got[201]["kept"]
    out = {r["doc_id"]: r["text"] for r in line_rules.apply_quality_rules(docs, max_docs=20).collect()}
    assert sorted(out) == [*range(30), 200, 201]
    assert out[5] == filler[5] and out[0] == filler[0]


def test_distinct_documents_are_counted(spark):
    """Rows of one doc_id are one document; rows without doc_id count by content."""
    text = "a line of " + " ".join(f"w{k}" for k in range(60))
    twice = [(i % 12, text, "h") for i in range(24)]
    lost = [(None, f"{text}\nno {i}", "g") for i in range(21)] + [(None, f"{text}\nno 0", "g")] * 5
    few = [(None, f"{text}\nno {i % 20}", "f") for i in range(40)]
    docs = spark.createDataFrame(twice + lost + few, "doc_id long, text string, source string")
    got = line_rules.quality_report(docs, max_docs=20)
    per = got.groupBy("n_words", "doc_id").agg({"words_removed": "sum", "*": "count"}).collect()
    assert {r["sum(words_removed)"] for r in per if r["doc_id"] is not None} == {0}
    assert sorted(r["words_removed"] for r in got.filter("doc_id IS NULL").collect()) == [0] * 40 + [63] * 26


def lines_by_force(rows, max_docs, min_left):
    """(doc_id, words_removed, kept) per row, from the rule's own words."""
    docs = defaultdict(set)

    def normal(line):
        return re.sub(r"[\x20\x09-\x0D]+", " ", line).lower().strip(" ")

    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if WORD.search(line):
                docs[r["source"], normal(line)].add(r["doc_id"] if r["doc_id"] is not None else ("row", str(r)))
    for r in rows:
        lines = [l for l in (r["text"] or "").split("\n") if WORD.search(l)]
        gone = sum(len(WORD.findall(l)) for l in lines if len(docs[r["source"], normal(l)]) > max_docs)
        n, _, _, _, repeated = base_rules(r["text"])
        failed = n < 50 or 2 * repeated > n
        yield r["doc_id"], gone, not failed and not (n - gone) < min_left * n


@pytest.mark.parametrize("which", ["odd_docs", "small"])
@pytest.mark.parametrize("max_docs", [1, 3, 20])
def test_line_rules_by_force(request, which, max_docs):
    docs = request.getfixturevalue(which)
    want = Counter(lines_by_force(docs.collect(), max_docs, line_rules.MIN_LEFT))
    got = line_rules.quality_report(docs, max_docs=max_docs).collect()
    assert Counter((r["doc_id"], r["words_removed"], r["kept"]) for r in got) == want


def test_line_limit_is_the_same_in_a_large_host(spark):
    """A line's verdict does not change when the host gets more clean documents."""
    filler = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"{filler} {i}\nthis line stands everywhere", "h") for i in range(30)]
    few = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clean = spark.range(100, 4100).selectExpr("id AS doc_id", f"concat('{filler} clean ', id) AS text", "'h' AS source")
    want = {r["doc_id"]: r["words_removed"] for r in line_rules.quality_report(few).collect()}
    got = {r["doc_id"]: r["words_removed"] for r in line_rules.quality_report(few.union(clean)).collect()}
    assert want == {i: 4 for i in range(30)}
    assert {i: got[i] for i in want} == want and not any(n for i, n in got.items() if i >= 100)


def test_quality_of_odd_and_empty(odd_docs):
    out = line_rules.apply_quality_rules(odd_docs)
    kept = Counter((r["doc_id"], r["text"]) for r in odd_docs.collect()
                   if (b := base_rules(r["text"]))[0] >= 50 and 2 * b[4] <= b[0])
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == kept
    assert out.columns == odd_docs.columns
    assert line_rules.quality_report(odd_docs.limit(0)).count() == 0


def test_hash_tree(odd_docs, small):
    for docs in (odd_docs, small):
        rows = hash_tree.assign_shards(docs, hash_tree.even_tree(16), hash_tree.even_tree(17)).collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))
                       for r in docs.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        slots, shard_of = defaultdict(list), {}
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
            assert shard_of.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert hash_tree.assign_shards(small.limit(0), hash_tree.even_tree(16)).count() == 0


def test_weights_move_keys_only_where_they_change(spark):
    ids = spark.range(20000)
    old, new = hash_tree.even_tree(16), hash_tree.even_tree(16)
    new[1][3][13] = 3.0  # region 1, rack 3
    from pyspark.sql import functions as F
    both = hash_tree.place(hash_tree.place(ids, F.col("id"), old, "a"), F.col("id"), new, "b").collect()
    per = Counter(r["a"] for r in both)
    assert all(abs(per[s] - 1250) < 180 for s in range(16))
    for r in both:
        if r["a"] != r["b"]:
            assert r["b"] // 8 == 1  # only into the region that grew
            assert r["a"] // 8 == 0 or r["b"] // 4 == 3
            assert r["a"] // 4 != 3 or r["b"] == 13
    assert abs(Counter(r["b"] for r in both)[13] - 20000 * 3 / 18) < 300


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 4), max_size=7), st.integers(0, 300), st.integers(5, 400))
def test_fit_lengths(table, budget, fit):
    sizes, counts = np.array(list(table), dtype=int), np.array(list(table.values()), dtype=int)
    got = mixing.fit_lengths(sizes, counts, budget, fit)
    assert ((0 <= got) & (got <= counts)).all()
    total = int((sizes * got).sum())
    assert total <= budget or total == 0
    if budget >= int((sizes * counts).sum()):
        assert (got == counts).all()
    elif fit >= 300:  # what is left has room for no document that is left
        assert all(budget - total < n for n, g, c in zip(sizes, got, counts) if g < c and n > 0)


def test_mix(odd_docs, small):
    for docs in (odd_docs, small):
        rows = mixing.mix_plan(docs).collect()
        again = Counter(tuple(r) for r in mixing.mix_plan(docs.repartition(5)).collect())
        assert Counter(tuple(r) for r in rows) == again
        size, sizes = {}, defaultdict(list)
        for d in docs.collect():
            n = len(WORD.findall(d["text"] or ""))
            size[d["source"]] = size.get(d["source"], 0) + n
        for d in docs.collect():
            sizes[size[d["source"]]].append(len(WORD.findall(d["text"] or "")))
        names = sorted([s for s in size if s is not None]) + [None] * (None in size)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        target, free, left = {}, set(names), 1.5 * sum(size.values())
        while True:
            level = left / sum(weight[s] for s in free)
            full = {s for s in free if 2 * size[s] < level * weight[s]}
            if not full:
                target.update({s: level * weight[s] for s in free})
                break
            target.update({s: 2 * size[s] for s in full})
            left -= sum(2 * size[s] for s in full)
            free -= full
        by = defaultdict(list)
        for r in rows:
            assert r["taken"] in (0, r["size"], 2 * r["size"])
            by[r["source_size"], round(r["target"], 3)].append(r["taken"])
        assert set(by) == {(size[s], round(target[s], 3)) for s in names}
        for (s, t), taken in by.items():
            if docs is small:
                assert abs(sum(taken) - t) <= max(2, 0.001 * t)
            else:  # the best sum that any choice of copies gives
                sums = {0}
                for n in sizes[s]:
                    sums |= {x + n for x in sums} | {x + 2 * n for x in sums}
                assert sum(taken) == max(x for x in sums if x <= round(t))
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        want = Counter()
        for r in rows:
            want[r["doc_id"]] += r["copies"]
        got = Counter(r["doc_id"] for r in mixed.collect())
        assert got == +want
    assert mixing.mix_plan(small.limit(0)).count() == 0
