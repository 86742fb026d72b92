import random

from credence.llm import token_counts
from credence.llm.packing import CAPACITIES, cost, pack, pack_documents
from tests.llm.conftest import ODD


def brute(sizes, caps):
    """Sizes in each bin: best fit by looking at every open bin, sizes of new ones by looking at every piece to come."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins = []
    for at, i in enumerate(order):
        fit = [b for b in bins if b[0] - sum(b[1]) >= sizes[i]]
        if fit:
            least = min(b[0] - sum(b[1]) for b in fit)
            b = [b for b in fit if b[0] - sum(b[1]) == least][-1]
            b[1].append(sizes[i])
        else:
            later = [sizes[j] for j in order[at + 1 :]]
            price = {}
            for c in caps:
                if c >= sizes[i]:
                    beside = c - sizes[i]
                    price[c] = cost(c) / max(1, sizes[i] + min(beside, sum(x for x in later if x <= beside)))
            bins.append((min(price, key=lambda c: (price[c], c)), [sizes[i]]))
    return sorted(sorted(b[1]) for b in bins)


def total(sizes, caps):
    return sum(map(cost, pack(sizes, caps)[2]))


def test_equals_brute_force():
    rng = random.Random(5)
    for caps in ((8, 16, 32), (10,), (700, 9000, 20_000)):
        for _ in range(40):
            sizes = [rng.randint(0, max(caps)) for _ in range(rng.randint(0, 40))]
            bins, offsets, final = pack(sizes, caps)
            used = {}
            for b, o, s in sorted(zip(bins, offsets, sizes, strict=True)):
                used.setdefault(b, []).append((o, s))
            for b, items in used.items():
                items.sort(key=lambda x: (x[0], x[0] + x[1]))
                assert items[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(items, items[1:], strict=False))
                assert final[b] == min(c for c in caps if c >= sum(s for _, s in items))
            assert len(final) == len(used)
            # Bins of equal room may change places: the rooms left are the same.
            want = brute(sizes, caps)
            assert len(want) == len(final) and sorted(map(sum, want)) == sorted(sum(s for _, s in x) for x in used.values())


def test_several_sizes_cost_less_than_the_one_that_holds_all():
    rng = random.Random(1)
    sizes = [min(8192, int(rng.lognormvariate(5.5, 1.2))) for _ in range(4000)]
    final = pack(sizes)[2]
    assert len(set(final)) >= 4
    assert total(sizes, CAPACITIES) < 0.95 * total(sizes, (8192,))
    assert total(sizes, CAPACITIES) < 1.15 * sum(s * min(cost(c) / c for c in CAPACITIES if c >= s) for s in sizes)


def test_a_small_rest_opens_a_small_bin():
    assert pack([100], (512, 8192))[2] == [512]
    assert pack([8000, 150, 40, 300], (512, 8192))[2] == [8192, 512]
    assert pack([], (8,)) == ([], [], [])


def test_rows(odd, empty):
    got = pack_documents(odd, capacities=(64, 4096), shard_tokens=5000)
    rows = got.collect()
    by_doc, counter = {}, token_counts.TrieCounter(token_counts.vocabulary())
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    n = sum(counter.counts(list({w}))[w] for w in dict(ODD)[9].split())
    assert sorted((r.start, r.length) for r in by_doc[9]) == [(i * 4096, min(4096, n - i * 4096)) for i in range(-(-n // 4096))]
    assert len(by_doc[2]) == 2 and [r.length for r in by_doc[3]] == [0] and len(by_doc[None]) == 2
    filled = {}
    for r in rows:
        filled.setdefault((r.shard, r.bin, r.capacity), []).append((r.offset, r.length))
    for (_, _, cap), items in filled.items():
        assert sum(n for _, n in items) <= cap
    assert len({r.shard for r in rows}) > 1
    assert pack_documents(odd, length="length", capacities=(64,)).where("length <> 7").count() == 0
    assert pack_documents(empty).count() == 0


def test_no_id_and_no_length_fill_one_shard(spark):
    docs = spark.range(400).selectExpr("cast(null as long) as doc_id", "5 as n")
    sizes = [r["count"] for r in pack_documents(docs, length="n", shard_tokens=100).groupBy("shard").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 60 and sum(sizes) == 400
    nothing = spark.range(400).selectExpr("1L as doc_id", "0 as n")
    sizes = [r["count"] for r in pack_documents(nothing, length="n", shard_pieces=20).groupBy("shard").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 60 and sum(sizes) == 400


def test_partitions_change_no_row(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(60)]), rng.choice([0, 5, 9, 40, 200])) for _ in range(600)] + [(None, 5)] * 2500
    df = spark.createDataFrame(rows, "doc_id long, n int")
    packed = [sorted(map(tuple, pack_documents(d, length="n", capacities=(16, 64), shard_tokens=700).collect()), key=repr) for d in (df.repartition(1), df.repartition(7, "n"))]
    assert packed[0] == packed[1] and len(packed[0]) > 3100
