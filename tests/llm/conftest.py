import random

import pytest

#: Names that the operators use inside.
EXTRA = ("n_words", "spans", "items", "h", "run", "set_id", "cell", "part", "score", "size", "label", "key", "shard", "tier")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, nulls, empty, short and long texts, repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(60, 200), 5000) for _ in range(30)]
    passage = prose(rng, 80, 5000)
    rows = list(enumerate(base))
    rows += [(100 + i, t) for i, t in enumerate(base[:5])]
    for i in range(12):
        words = base[7].split()
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, f"{prose(rng, 30, 5000)} {passage}\n{prose(rng, 20, 5000)}") for i in range(6)]
    rows += [(400, None), (401, ""), (402, "  \n\t "), (403, "one two"), (404, "One TWO"), (405, "Ünï cödé Ⅷ 日本語 🙂 don't"), (406, prose(rng, 30_000)), (3, base[3]), (None, base[4]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    frame = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    for name in EXTRA:
        frame = frame.selectExpr("*", f"'x' as {name}")
    return frame


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
