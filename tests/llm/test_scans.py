"""License scans and the Kneser-Ney classifier against brute force; held-out accuracy."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from offerflow.llm import kneser_ney, licenses
from offerflow.session import scratch_folder

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bigrams(text):
    words = TERM.findall(text.translate(LOWER))
    return set(zip(words, words[1:]))


def brute_licenses(text, templates, t):
    """{(license, score, words of the unit)} of the text, its blocks and its lines."""
    text = text or ""
    blocks = re.split(r"\n(?:[ \t\r\x0b\x0c]*\n)+", text)
    out = set()
    for unit in [text, *blocks, *text.split("\n")]:
        a = bigrams(unit)
        scores = [(-2 * len(a & b) / (len(a) + len(b)), name) for name in templates for x in templates[name]
                  if a and (b := bigrams(x))]
        if scores and -min(scores)[0] >= t:
            out.add((min(scores)[1], round(-min(scores)[0], 9), tuple(TERM.findall(unit.translate(LOWER)))))
    return out


def test_licenses(spark, odd_docs, small):
    mit = licenses.TEMPLATES["MIT"][2]
    words = mit.split(" ")
    texts = ["Some text.\nReleased under the MIT License.\nMore text", f"{mit}\n\nint main()", "x\n\n" + "\n".join(
        " ".join(words[i:i + 9]) for i in range(0, len(words), 9)) + "\n\ny", " ".join(words[:40]), " ".join(words[::-1]),
        "licensed under cc by-nc 4.0", "LICENSED UNDER CC-BY 4.0!", "released under the mit", "a\n \nReleased under the MIT License.\n\n"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = made.union(small.select("doc_id", "text")).union(odd_docs.select("doc_id", "text"))
    want = defaultdict(set)
    rows = Counter()
    for r in docs.collect():
        want[r["doc_id"], r["text"]] = brute_licenses(r["text"], licenses.TEMPLATES, 0.8)
        rows[r["doc_id"]] += 1
    got = licenses.license_matches(docs.dropDuplicates()).join(docs.dropDuplicates(), "doc_id").collect()
    seen = defaultdict(set)
    for r in got:
        body = (r["text"] or "").encode()
        units = set()
        for m in r["matches"]:
            units.add((m["license"], round(m["score"], 9), tuple(TERM.findall(body[m["start"]:m["end"]].decode(errors="replace").translate(LOWER)))))
        seen[r["doc_id"], r["text"]] |= {u for u in units if u in want[r["doc_id"], r["text"]]}
    for k, w in want.items():
        assert w == seen[k] or k[0] is None, k
    assert Counter(r["doc_id"] for r in licenses.license_matches(docs).select("doc_id").collect()) == rows
    best = {r["doc_id"]: r["matches"][0]["license"] if r["matches"] else None
            for r in licenses.license_matches(made).collect()}
    assert [best[i] for i in range(9)] == ["MIT", "MIT", "MIT", None, None, "CC-BY-NC-4.0", "CC-BY-4.0", "MIT", "MIT"]
    assert licenses.license_matches(docs.limit(0)).count() == 0


class Model:
    """Interpolated modified Kneser-Ney, straight from the definition."""

    def __init__(self, texts):
        c3 = Counter()
        for t in texts:
            w = ["<s>", "<s>", *WORD.findall((t or "").translate(LOWER))]
            c3.update(zip(w, w[1:], w[2:]))
        c2 = Counter((b, c) for _, b, c in c3)
        c1 = Counter(c for _, c in c2)
        self.c = [None, c1, c2, c3]
        self.d = [None] + [self.discounts(x) for x in (c1, c2, c3)]
        self.sum2, self.left2, self.sum3, self.left3 = Counter(), Counter(), Counter(), Counter()
        for (b, _), n in c2.items():
            self.sum2[b] += n
            self.left2[b] += min(self.cut(2, n), n)
        for (a, b, _), n in c3.items():
            self.sum3[a, b] += n
            self.left3[a, b] += min(self.cut(3, n), n)

    def discounts(self, counts):
        n = Counter(counts.values())
        if not n[1] or not n[2]:
            return [0.75] * 3
        y = n[1] / (n[1] + 2 * n[2])
        raw = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else 0.75 for i in (1, 2, 3)]
        return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]

    def cut(self, order, n):
        return self.d[order][min(n, 3) - 1]

    def p(self, a, b, c):
        c1 = self.c[1]
        total = sum(c1.values())
        spare = sum(min(self.cut(1, n), n) for n in c1.values())
        p = spare / total / (len(c1) + 1)
        if c in c1:
            p += (c1[c] - self.cut(1, c1[c])) / total
        if b in self.sum2:
            n = self.c[2].get((b, c), 0)
            p = (n - self.cut(2, n) if n else 0) / self.sum2[b] + self.left2[b] / self.sum2[b] * p
        if (a, b) in self.sum3:
            n = self.c[3].get((a, b, c), 0)
            p = (n - self.cut(3, n) if n else 0) / self.sum3[a, b] + self.left3[a, b] / self.sum3[a, b] * p
        return p


def test_probabilities(spark, odd_docs):
    texts = ["the cat sat on the mat", "the cat ate the rat", "a cat sat", "on the mat the cat sat on the mat", "", None]
    for train, docs in ((texts, texts + ["the dog sat on a mat", "zzz", "cat cat cat"]),
                        ([r["text"] for r in odd_docs.collect()[5:40]], [r["text"] for r in odd_docs.collect()[:30]])):
        model = Model(train)
        shards = kneser_ney.train(spark.createDataFrame([(t,) for t in train], "text string"), entries=20)
        assert len(shards) > 2
        rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(docs)], "doc_id long, text string, lang string")
        for r in kneser_ney.score(rows, shards).collect():
            w = ["<s>", "<s>", *WORD.findall((docs[r["doc_id"]] or "").translate(LOWER))]
            assert r["n_words"] == len(w) - 2
            want = sum(math.log(model.p(*g)) for g in zip(w, w[1:], w[2:]))
            assert r["log_p"] == pytest.approx(want, rel=1e-9, abs=1e-9)
        words = sorted(model.c[1])
        assert sum(model.p("the", "cat", c) for c in words + ["?"]) == pytest.approx(1.0)


def test_all_trusted_but_the_held_out_train(spark, monkeypatch):
    """The counts grow with the trusted text, and single words lie in several shards."""
    seen, real = [], kneser_ney.train

    def spy(training, *args, **more):
        seen.append(training.count())
        return real(training, *args, entries=2000)

    monkeypatch.setattr(kneser_ney, "train", spy)
    docs = spark.range(8000).selectExpr("id AS doc_id", "concat('word ', id, ' of the text ', id % 7) AS text", "'en' AS lang")
    assert kneser_ney.classify(docs, docs.selectExpr("doc_id", "1 AS quality")).filter("kept").count() > 7500
    assert 6000 < seen[0] < 6800
    shards = real(docs.limit(100), entries=20)
    assert len([p for p in shards[0][1] if p]) > 2


def test_model_takes_little_disk(spark):
    """Counts and keys stay far below the 24 bytes of a trigram's three hashes, and the keys go after scoring."""
    def disk():
        root = Path(scratch_folder(spark).removeprefix("file://").removeprefix("file:"))
        return sum(f.stat().st_size for f in root.rglob("*") if f.is_file())

    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=200)), "en") for i in range(1000)],
                                 "doc_id long, text string, lang string").repartition(4)
    before = disk()
    shards = kneser_ney.train(docs, entries=50_000)
    assert disk() - before < 10 * 200_000
    assert kneser_ney.score(docs, shards).agg({"n_words": "sum"}).first()[0] == 200_000
    assert disk() - before < 12 * 200_000


def test_classifier_against_brute_force(spark, monkeypatch):
    """Perplexities, limits and verdicts; texts train once however often they stand there, rows alike stay."""
    monkeypatch.setattr(kneser_ney, "RUN_WORDS", 500)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words[:20 + 40 * (i % 2)], k=rng.randint(1, 40))), "en" if i % 3 else None) for i in range(300)]
    rows += [(300 + i, rows[i][1], "de") for i in range(40)] + rows[:30] + rows[:10] + [(400, None, "en"), (401, "", "en"), (None, "w1 w2 q", "en"), (2, "w3 w4 w5", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS quality")
    trains = {r[0] for r in docs.select("doc_id").where("xxhash64(11, doc_id) / pow(2.0D, 64) + 0.5D < 0.8D AND doc_id % 5 != 0").collect()}
    model = Model({t for i, t, _ in rows if i in trains and t is not None})
    sums = []
    for i, t, lang in rows:
        w = ["<s>", "<s>", *WORD.findall(t or "")]
        sums.append((i, lang, len(w) - 2, sum(math.log(model.p(*g)) for g in zip(w, w[1:], w[2:]))))
    held = [s for s in sums if s[0] is not None and s[0] % 5 and s[0] not in trains and s[2]]
    rate = sum(s[3] for s in held) / sum(s[2] for s in held)
    perplexity = lambda s: math.exp(-(s[3] + 20 * rate) / (s[2] + 20)) if s[2] else None
    limits = {}
    for lang in {s[1] for s in held}:
        x = sorted(perplexity(s) for s in held if s[1] == lang)
        limits[lang] = x[max(1, math.ceil(len(x) * 0.9)) - 1]
    want = sorted((str(s[0]), str(s[1]), s[2], round(perplexity(s) or 0, 6), round(limits.get(s[1], max(limits.values())), 6)) for s in sums)
    out = kneser_ney.classify(docs, labels, quantile=0.9).collect()
    assert sorted((str(r["doc_id"]), str(r["lang"]), r["n_words"], round(r["perplexity"] or 0, 6), round(r["threshold"], 6)) for r in out) == want
    assert all(r["kept"] == (r["n_words"] > 0 and r["perplexity"] <= r["threshold"]) for r in out)
    assert {r["kept"] for r in out} == {True, False}


def test_classifier(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = {r["doc_id"]: r for r in kneser_ney.classify(docs, labels, per_language=40).collect()}
    assert len(out) == docs.count()
    good, bad = [], []
    for r in labels.collect():
        (good if r["quality"] == 1 else bad).append(out[r["doc_id"]]["kept"])
    assert sum(good) / len(good) > 0.95
    assert sum(bad) / len(bad) < 0.5
    odd = kneser_ney.classify(odd_docs, labels, per_language=5).collect()
    assert len(odd) == odd_docs.count()
    assert all(r["perplexity"] is None and not r["kept"] for r in odd if r["n_words"] == 0)
    assert all(r["kept"] for r in kneser_ney.classify(odd_docs, labels.limit(0)).filter("n_words > 0").collect())
    assert kneser_ney.classify(docs.limit(0), labels).count() == 0


def test_whole_licenses_and_notices_inside_texts(spark):
    """Full texts, texts parted by blank lines, and notices in the middle of a line are found."""
    full = {n: (licenses.TEXTS / f"{n}.txt").read_text(encoding="utf-8") for n in licenses.TEMPLATES}
    header = licenses.TEMPLATES["GPL-3.0"][1].replace(" This program is distributed", "\n\nThis program is distributed")
    noise = " ".join(f"w{i} of the x{i}" for i in range(300))
    cases = [(n, f"{n} copyright 2020 somebody\n\n{text}") for n, text in full.items()]
    cases += [(n, f"{noise} {' '.join(text.split())} {noise}") for n, text in full.items()]
    cases += [("GPL-3.0", header), ("GPL-3.0", f"{noise}\n{header}\n{noise}"),
              ("BSD-2-Clause", full["BSD-2-Clause"].split("THIS SOFTWARE")[0]),
              ("BSD-3-Clause", " ".join(full["BSD-3-Clause"].split())),
              ("MIT", f"{noise} Released under the MIT License. {noise}"), (None, noise)]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["matches"] for r in licenses.license_matches(docs).collect()}
    assert [(got[i][0]["license"] if got[i] else None) for i in range(len(cases))] == [n for n, _ in cases]
    inside = got[len(cases) - 2]
    assert [m["unit"] for m in inside] == ["window"]
    assert cases[-2][1].encode()[inside[0]["start"]:inside[0]["end"]] == b"Released under the MIT License"
    both = f"{noise} {header} {noise} Licensed under CC BY 4.0. {noise}"
    two = licenses.license_matches(spark.createDataFrame([(0, both)], "doc_id long, text string")).collect()[0]
    assert [m["license"] for m in two["matches"]] == ["GPL-3.0", "CC-BY-4.0"]


def test_windows_by_brute_force():
    """Each template's best window scores as in a plain search over all windows."""
    import random

    import numpy as np
    import pyarrow as pa

    from offerflow.llm.wordhash import WordHasher, string_buffers

    rng = random.Random(3)
    given = {"a": ("p q r s t u v", "p q p q r"), "b": ("q r s p t",)}
    known, hasher = licenses.Templates(given, 0.8), WordHasher(licenses.BREAKS)
    texts = [" ".join(rng.choices("pqrstuv", k=rng.randint(1, 60))) for _ in range(200)]
    texts += [" ".join(rng.choices("xy", k=9)) + " " + given["a"][0] + " z " + given["b"][0] for _ in range(20)]
    starts, _, owner, hashes = hasher.words(*string_buffers(pa.array(texts)))
    pairs = licenses._bigrams(hashes)
    at = np.minimum(np.searchsorted(known.known, pairs), len(known.known) - 1)
    hits = np.flatnonzero((known.known[at] == pairs) & (owner[1:] == owner[:-1]))
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    got = defaultdict(list)
    for i, a, b, score, _ in known.windows(pairs, at, hits, owner, cuts):
        got[i, int(owner[a])].append((a, b, score))
    some = 0
    for i, (_, bigrams_of, m) in enumerate(known.sets):
        for d in range(len(texts)):
            want = {}
            for a in range(cuts[d], cuts[d + 1] - m + 1):
                own = set(pairs[a:a + m - 1].tolist())
                shared = len(own & set(bigrams_of.tolist()))
                if 2 * shared / (len(own) + len(bigrams_of)) >= 0.8:
                    want[a] = (2 * shared / (len(own) + len(bigrams_of)), 3 * shared - len(own))
            found = got[i, d]
            some += len(found)
            assert all(s == pytest.approx(want[a][0]) and b == a + m for a, b, s in found)
            assert bool(found) == bool(want)
            assert all(any(abs(a - x) < m and want[x][1] >= want[a][1] for x, *_ in found) for a in want)
    assert some > 20
