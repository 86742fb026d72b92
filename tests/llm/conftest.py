import pytest
from pyspark.sql import Row

WORDS = [a + b for a in ("ba", "de", "fi", "go", "lu", "mi", "no", "pa", "ru", "se") for b in ("lor", "mint", "gar", "tess", "von", "rick", "dale", "hump")]


def prose(seed: int, n: int) -> str:
    """n words in sentences, from a fixed stream."""
    import random

    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(WORDS)
        out.append(w + "." if i % 9 == 8 else w)
    return " ".join(out)


#: Cases that every operator over documents must stand: nulls, empty and blank texts, ties, repeated rows, long texts.
ODD = [
    (1, prose(1, 120)), (2, prose(1, 120)), (2, prose(1, 120)), (3, None), (4, ""), (5, "   \n\t "), (None, prose(1, 120)), (None, None),
    (6, "one"), (7, "one two"), (8, "Er " * 3000), (9, prose(9, 20_000)), (10, prose(10, 80) + "\n" + prose(1, 120)),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with further columns whose names operators use themselves."""
    rows = [
        Row(doc_id=i, text=t, lang="en", source="s", n_chars=None if t is None else len(t), score=0.5, component_id=7, fp=1, tag=2, unit=3, start=4, end=5, digest="x", bin=6, length=7)
        for i, t in ODD
    ]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, fp long, tag long, unit int, start int, end int, digest string, bin long, length long"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
