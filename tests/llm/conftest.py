import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta9", "eps,", "zeta", "##", "été", "naïve", "x"]
    texts = [None, "", " \t\n", "one", "a\nb\n\na\n  \nb", "x " * 400]
    texts += ["\n".join(" ".join(rng.choices(words, k=rng.randint(1, 30)))
                        for _ in range(rng.randint(1, 8))) for _ in range(40)]
    texts += [" ".join(rng.choices(words, k=9000))]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, 1.5, "z")
            for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], rows[12], (None, "one two", None, None, None, None, None),
             (None, None, None, None, None, None, None), (3, "another three", "en", "s1", 3, 0.0, "q")]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size double, shard string")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
