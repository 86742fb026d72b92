import itertools
import random

import numpy as np

from credence.llm import decontam as D
from tests.llm.conftest import prose

ITEMS = [(i, prose(1000 + i, 15 + 3 * i)) for i in range(14)] + [(20, "Tiny item"), (21, None), (22, "..."), (23, prose(1000, 15)), (24, "no no no no no no no no no no no")]


def brute(docs, items):
    """Items that hold their share of shingles in some stretch of a document."""
    out = set()
    for i, t in docs:
        have = D.shingles(D.words_of(t))
        for d, text in items:
            want = D.shingles(D.words_of(text))
            if want and len(want & have) >= D.OVERLAP * len(want) - 1e-9:
                out.add((i, d))
    return out


def corpus():
    rng = random.Random(4)
    docs = []
    for i in range(50):
        w = prose(i, rng.randint(5, 400)).split()
        if i % 3 == 0:
            item = ITEMS[rng.randrange(14)][1].split()
            if i % 2 and len(item) > 35:
                item[rng.randrange(3)] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = item
        docs.append((i, " ".join(w)))
    return [*docs, (60, "a tiny item here"), (61, "no " * 30), (62, "Tiny, item.")]


def test_equals_brute_force_however_the_benchmark_is_parted(spark):
    docs = corpus()
    items = spark.createDataFrame([(i, t, 1.0) for i, t in ITEMS], "item_id long, text string, score double")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, D.contaminated(df, items).collect()))
    assert {r[:2] for r in got} == brute(docs, ITEMS) and (62, 20) in {r[:2] for r in got} and 60 not in {r[0] for r in got}
    assert all(r[4] >= 0.8 and 0.5 <= r[5] <= 1 and 0.5 <= r[6] <= 1 for r in got)
    for part in (3, 7):
        assert sorted(map(tuple, D.contaminated(df, items, part).collect())) == got
    kept = {r.doc_id for r in D.drop_contaminated(df, items, 5).collect()}
    assert kept == {i for i, _ in docs} - {r[0] for r in got}


def test_question_and_answer_must_both_be_held(spark):
    question, answer = prose(1, 40) + "?", "It was exactly here"
    items = spark.createDataFrame([(1, question + " " + answer), (2, "yes"), (3, "no!")], "item_id long, text string")
    docs = [(1, prose(5, 30) + " " + question + " " + prose(6, 30)), (2, f"x {question} {answer} y"), (3, "yes indeed it is so"), (4, "Yes!"), (5, "no " * 9)]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(2, 1), (4, 2)]


def test_wand_scores_what_reaches_its_threshold():
    index = D.Index([(i, t) for i, t in ITEMS if t])
    for _, t in corpus():
        w = D.words_of(t)
        terms = sorted({index.term[x] for x in w if x in index.term})
        for b in range(index.n_blocks):
            full = {}
            for k in terms:
                for d, s in index.postings[b].get(k, []):
                    full[d] = full.get(d, 0.0) + s
            want = {d: s for d, s in full.items() if s >= index.least[d] - 1e-6}
            got = dict(index.wand(b, terms))
            assert got.keys() == want.keys() and all(np.isclose(got[d], want[d]) for d in got)


def test_most_lost_equals_brute_force():
    rng = random.Random(6)
    for _ in range(30):
        n, spare = rng.randint(5, 11), rng.randint(0, 4)
        impacts = [rng.random() for _ in range(n)]
        best = 0.0
        for k in range(n + 1):
            for gone in itertools.combinations(range(n), k):
                void = sum(any(i <= g < i + D.GRAM for g in gone) for i in range(n - D.GRAM + 1))
                if void <= spare:
                    best = max(best, sum(impacts[g] for g in gone))
        assert np.isclose(D.most_lost(impacts, spare), best)


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, " ".join(prose(1, 120).split()[30:70])), (1, " ".join(prose(1, 120).split()[30:70]))], "item_id long, text string")
    got = D.contaminated(odd, items).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 1, 2, 2, 2, 2, 10, 10]
    kept = D.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 8, 9, None}
    none = items.limit(0)
    assert D.contaminated(odd, none).count() == 0 and D.drop_contaminated(odd, none).count() == odd.count()
    assert D.contaminated(empty, items).count() == 0
