import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng: random.Random, n: int, lexicon: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(lexicon)}" + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Null, empty, tiny and long texts, exact and near copies, shared passages, repeated rows and a null id."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(60, 300)) for _ in range(40)]
    passage = prose(rng, 70)
    texts = list(base)
    for i in range(12):
        words = base[i].split(" ")
        for _ in range(max(1, len(words) // 100)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [base[0], base[0], base[1]]
    texts += [f"{prose(rng, 50)} {passage} {prose(rng, 40)}" for _ in range(5)]
    texts += ["", None, " \n\t ", "one", "one two three", "é ß 日本 😀 " * 30, "same word " * 80, prose(rng, 9000)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 1), (5, "another text under the same id " * 4, "en", "s", 1), (None, base[2], "en", "s", 1)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
