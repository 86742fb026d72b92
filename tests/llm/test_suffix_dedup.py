import random

import numpy as np
import pytest

from credence.llm.suffix_dedup import anchors, repeated_passages
from tests.llm.conftest import prose


def brute(docs, length):
    """Words that lie in a stretch of ``length`` words that stands in two documents, or twice apart in one."""
    places = {}
    for i, t in docs:
        w = (t or "").split()
        for j in range(len(w) - length + 1):
            places.setdefault(tuple(w[j : j + length]), set()).add((i, j))
    out = {}
    for found in places.values():
        ids = {i for i, _ in found}
        if len(ids) > 1 or max(j for _, j in found) - min(j for _, j in found) >= length:
            for i, j in found:
                out.setdefault(i, set()).update(range(j, j + length))
    return out


def spans(df, **more):
    out = {}
    for r in repeated_passages(df, **more).collect():
        assert r.n_words == r.end - r.start and not out.get(r.doc_id, set()) & set(range(r.start, r.end))
        out.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return out


def corpus():
    rng = random.Random(2)
    passage = prose(500, 70).split()
    docs = []
    for i in range(60):
        w = prose(i, rng.randint(20, 160)).split()
        if i % 4 == 0:
            a, b = sorted((rng.randint(0, 25), rng.randint(45, 70)))
            at = rng.randint(0, len(w))
            w[at:at] = passage[a:b]
        if i % 7 == 0 and docs:
            w += docs[rng.randrange(len(docs))][1].split()[: rng.randint(40, 90)]
        docs.append((i, " ".join(w)))
    docs += [(100, "Er " * 400), (101, "x " + "Er " * 120 + "y"), (102, "ab cd ef " * 60), (103, prose(900, 55) + " " + prose(901, 9) + " " + prose(900, 55))]
    return docs


@pytest.mark.parametrize("hot", [200_000, 1])
def test_equals_brute_force(spark, hot):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert spans(df, hot=hot) == brute(docs, 50)


def test_short_lengths(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert spans(df, length=20, gram=4) == brute(docs, 20)


def test_every_stretch_has_an_anchor():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 500).astype(np.uint64)
    at, _ = anchors(words)
    assert all(((at >= s) & (at <= s + 42)).any() for s in range(451)) and len(at) < 60
    assert len(anchors(words[:49])[0]) == 0


def test_odd_rows(odd, empty):
    got = spans(odd)
    assert {1, 2, 10} <= got.keys() and not got.keys() & {3, 4, 5, 6, 7, 9, None}
    assert len(got[1]) == len(got[2]) == 120
    assert repeated_passages(empty).count() == 0


@pytest.mark.parametrize("hot", [200_000, 1])
def test_texts_of_one_id_are_told_apart(spark, hot):
    same = prose(7, 60)
    for a, b in ((same, same + " more words"), (f"{prose(1, 10)} {same}", f"{prose(2, 30)} {same} {prose(3, 5)}")):
        rows = [(1, a), (1, b), (1, a), (2, prose(9, 80))]
        got = sorted((r.doc_id, r.start, r.end) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect())
        first, second = (len(t.split(same)[0].split()) for t in (a, b))
        assert got == sorted([(1, first, first + 60), (1, second, second + 60)])
