import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, score string, node int, block string, at double"


def sentence(k: int, n: int) -> str:
    return " ".join(f"w{(k * 7919 + i * (k + 3)) % 997}" for i in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs, blanks, a very long text, exact and near copies, repeated rows, columns with clashing names."""
    base = sentence(1, 40)
    near = base.replace("w1 ", "w1 ") + " tail"
    texts = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One  TWO"), (9, sentence(5, 30_000)),
        (10, sentence(2, 25)), (11, sentence(3, 25)), (12, "word " * 30), (12, "word " * 30), (None, base), (None, "just some words here now"),
        (13, "Ünïcode ▁ mark   sep\r\nline [INST] </s> \\ <s>"), (14, "x" * 5000), (15, "1 2 3"), (16, "a b c d e f"),
    ]
    return spark.createDataFrame([(i, t, "en", "s", 1, "b", 0.5) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where(F.lit(False))
