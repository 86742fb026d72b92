import random
import re

import numpy as np
import pytest
import xxhash

from credence.llm import simhash
from credence.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable by links of at most three bits."""
    least = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 3 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_fingerprint_equals_brute_force(odd):
    from tests.llm.conftest import ODD

    for t in [t for _, t in ODD] + ["Ä Ö x ÜBER A B", "a\x0bb c\x1cd e"]:
        assert simhash.fingerprint(t) == brute_print(t)


def test_shingle_hash_is_the_engines(spark):
    row = spark.sql("select xxhash64('de fi go') as h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest("de fi go", 42)


def test_links_lose_none(spark):
    rng = random.Random(1)
    prints, at = [], 0
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.append((at, base))
            at += 1
            for b in rng.sample(range(64), rng.randint(1, 4)):
                base ^= 1 << b
    want = brute_components(prints)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f, i) for i, f in prints], "fp long, rep long").dropDuplicates(["fp"])
    lists = df.mapInArrow(simhash._postings, "key long, fp long, rep long").repartition(5, "key").sortWithinPartitions("key")
    got = {r.node: r.component for r in components(lists.mapInArrow(simhash._links, "a long, b long")).collect()}
    assert {i: got.get(i, i) for i in want} == want


@pytest.mark.parametrize("n", [300, 6000])
def test_forest_spans_either_way(n):
    rng = np.random.default_rng(n)
    rest = rng.choice(1 << 14, n, replace=False).astype(np.uint32) * np.uint32(37) % np.uint32(1 << 24)
    rest = np.unique(rest)
    parent = list(range(len(rest)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = simhash._forest(rest)
    for a, b in pairs:
        assert int(rest[a] ^ rest[b]).bit_count() <= 3
        parent[find(a)] = find(b)
    assert len(pairs) < len(rest)
    for i in range(0, len(rest), 7):
        for j in np.flatnonzero(np.bitwise_count(rest ^ rest[i]) <= 3):
            assert find(i) == find(int(j))


def test_chain_settles(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 0 for i in range(201)}


def test_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = [(r.doc_id, r.component_id) for r in rows]
    assert got.count((2, 1)) == 2 and (1, 1) in got and {(3, 3), (4, 3), (5, 3)} <= set(got) and got.count((None, None)) == 2
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9, 10] and ids.count(None) == 2
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_texts_of_one_id_link_what_either_links(spark):
    a, b, c = "alpha beta gamma delta", "quite another text of some words", "a third text that has nothing of those"
    rows = [(3, b), (7, b), (7, a), (9, a), (11, c), (12, c), (13, None)]
    for docs in (rows, rows[::-1]):
        got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (7, 3), (7, 3), (9, 3), (11, 11), (12, 11), (13, 13)]
