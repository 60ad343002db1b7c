import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Texts with copies, near copies, a common passage, ties, nulls, empty and one very long text."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge") for b in ("rk", "lm", "nt", "ss", "wo", "xi")]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage = text(60)
    rows = []
    for i in range(n):
        rows.append(text(rng.randint(40, 160)) + (f"\n{passage}\n" + text(20) if i % 4 == 0 else ""))
    for i in range(0, n, 3):
        words = rows[i].split(" ")
        words[len(words) // 2] = "changed"
        rows.append(" ".join(words))
    rows += [rows[0]] * 3 + [rows[1].upper(), None, None, "", "", "   ", "one", "One", "two words", passage, text(30_000), "é ß œ \u3000 x\u00a0y <|endoftext|> 12 's"]
    return [(7 * i % 10_007, t, "en", "s", len(t or "")) for i, t in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With repeated rows, and columns whose names clash with those that operators use."""
    df = spark.createDataFrame(rows + rows[:2] + [(None, "text without an id", None, None, None)], SCHEMA)
    return df.selectExpr("*", "1 as key", "2 as n", "3 as id", "4 as digest", "5 as label", "6 as kept").repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
