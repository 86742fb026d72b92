import random
import re
from collections import Counter

import pytest

from credence.llm import divergence, twins


def brute(rows):
    """The audit of (lang, source, text) rows by plain integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, count, groups = Counter(), Counter(), {}
        for (own, source, _), w in zip(rows, words, strict=True):
            if own == lang:
                docs.update(set(w))
                count.update(w)
                groups.setdefault(source, Counter()).update(w)
        kept = [t for t in docs if docs[t] >= divergence.LEAST]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, p = share(count), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, some, most in (("pair", pair, None), ("term", term, 50)):
                some = sorted(some, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(some)]
    return sorted(out)


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    return sorted(map(tuple, divergence.audit(df).collect()))


@pytest.mark.parametrize("shard,slots,seats", [(4096, 32, 4), (16, 3, 1), (40, 32, 1)])
def test_equals_brute_force(spark, monkeypatch, shard, slots, seats):
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "SLOTS", slots)
    monkeypatch.setattr(divergence, "SEATS", seats)
    rng = random.Random(shard)
    names = ["Ähre", "x", "WORD", "b_c", "日本", "e1e"] + [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = [
        (lang, f"s{rng.randrange(groups)}", " ".join(rng.choice(names[: rng.randint(3, len(names))]) for _ in range(rng.randint(0, 60))))
        for lang, groups, n in (("en", 7, 300), ("de", 4, 200), ("fr", 1, 60), ("es", 3, 20)) for _ in range(n)
    ]
    rows += [(None, None, None), ("", "s1", "a b"), ("en", None, ""), ("en", "silent", "42 !")]
    assert rows_of(spark, rows) == brute(rows)


def test_odd_rows(spark, odd, empty):
    got = divergence.audit(odd.unionByName(odd.limit(0)))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.count() == 0
    assert divergence.audit(empty).count() == 0


def test_ties_and_hot_source(spark):
    rows = [("en", "hot", f"alpha beta {'gamma ' * (i % 3)}") for i in range(400)] + [("en", s, "alpha beta") for s in ("b", "a", "ä") for _ in range(10)]
    assert rows_of(spark, rows) == brute(rows)


def test_vectors_survive_packing():
    import numpy as np

    at, p = np.array([0, 3, 4095]), np.array([1, 10**9 + 1, 7])
    got = divergence.unpack(divergence.pack(at, p), 4096, 2)
    assert got[at].tolist() == p.tolist() and (np.delete(got, at) == 2).all()
    assert divergence.unpack(divergence.pack(at[:0], p[:0]), 3, 5).tolist() == [5, 5, 5]


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    cases = [(0, 0, 1), (7, 10**12, 3), (10**15 + 7, 10**15 + 9, 10**6), (2, 11, 1)]
    df = spark.createDataFrame(cases, "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (total + 5 * v) for n, total, v in cases]


def test_flushes_change_nothing(spark, monkeypatch):
    rows = [("en", f"s{i % 3}", "one two three four five " * (1 + i % 2)) for i in range(90)]
    want = rows_of(spark, rows)
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["a", "a", "b", "a"], "text": ["x y", "x", "x", "z z"]})
    got = Counter()
    for b in divergence._count(iter([batch, batch])):
        for r in b.to_pylist():
            got[r["source"], r["term"], "n"] += r["n"]
            got[r["source"], r["term"], "docs"] += r["docs"]
    assert got["a", "z", "n"] == 4 and got["a", "z", "docs"] == 2 and got["b", "x", "n"] == 2 and got["a", "x", "docs"] == 4
    assert want == brute(rows)


def test_twin_is_registered():
    from credence.llm.queries import ORACLE, QUERIES

    assert ORACLE["op11_source_divergence"] == twins.DIVERGENCE and "op11_source_divergence" in QUERIES
