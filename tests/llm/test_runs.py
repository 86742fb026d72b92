import hashlib
import random
import zlib

import numpy as np
import pytest

from credence.llm import runs


def brute(words, shortest=6, power=4):
    """All runs by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(shortest, power * q):
                found.setdefault((i, size), q)
            i = j + 1
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, letters, n):
    out = []
    while len(out) < n:
        root = [rng.randrange(letters) for _ in range(rng.randint(1, 5))]
        out += root * rng.randint(1, 7) + [rng.randrange(letters) for _ in range(rng.randint(0, 4))]
        if len(out) > 20 and rng.random() < 0.4:
            a = rng.randrange(len(out) - 10)
            out += out[a : a + rng.randint(8, 60)]
    return out[:n]


@pytest.mark.parametrize("power,shortest", [(4, 6), (2, 2), (3, 5)])
def test_runs_equal_brute_force(power, shortest):
    rng = random.Random(power)
    for k in range(300):
        words = periodic(rng, rng.choice([1, 2, 3, 6]), rng.randint(0, 150))
        got = runs.find_runs(np.array(words, dtype=np.int64), shortest, power) if words else []
        assert got == brute(words, shortest, power), (k, words)


def test_longest_previous_factors():
    rng = random.Random(5)
    for _ in range(60):
        w = periodic(rng, 3, rng.randint(1, 60))
        length, source = runs.previous_factors(runs.stretch_ranks(np.array(w, dtype=np.int64)))
        for i in range(len(w)):
            best = max((next((x for x in range(len(w) - i) if w[j + x] != w[i + x]), len(w) - i) for j in range(i)), default=0)
            assert length[i] == best
            if best:
                assert source[i] < i and w[source[i] : source[i] + best] == w[i : i + best]


def test_documents_of_a_batch_do_not_meet():
    rng = random.Random(9)
    docs = [[b"%d" % x for x in periodic(rng, 2, rng.randint(0, 90))] for _ in range(80)] + [[b"a"] * 5, [b"a"] * 7]
    assert runs.batch_runs(docs) == [brute(d) for d in docs]


def report(doc_id, text):
    """The contract's columns by plain code."""
    words = runs.split_words(text)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words and doc_id is not None:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words) if len(words) < 4000 else runs.batch_runs([words])[0]
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_report_and_odd_rows(spark, odd, empty):
    rows = runs.run_report(odd)
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, rows.collect()), key=repr)
    assert got == sorted((report(r.doc_id, r.text) for r in odd.collect()), key=repr)
    assert runs.run_report(empty).count() == 0
    texts = [(i, "x a a a a a a y " + "b c " * (i % 9) + "z " * (i % 30)) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, runs.run_report(df).collect())) == sorted(report(*t) for t in texts)


def test_long_periodic_text():
    words = [b"w%d" % (i % 997) for i in range(60_000)]
    assert runs.batch_runs([words, [b"a"] * 50_000]) == [[(0, 60_000, 997)], [(0, 50_000, 1)]]


def test_arguments(odd):
    with pytest.raises(ValueError):
        runs.periodic_runs(odd, power=1)
