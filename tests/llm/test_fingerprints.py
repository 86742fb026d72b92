import hashlib
import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash

from credence.llm import fingerprints as P
from tests.llm.conftest import prose


def hashed(term):
    """128 bits of a term by the public hash."""
    first = xxhash.xxh64_intdigest(term.encode(), 42)
    second = xxhash.xxh64_intdigest(struct.pack("<i", 1), xxhash.xxh64_intdigest(struct.pack("<Q", first), 42))
    return first, second


def words(text):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]


def brute_weights(texts):
    df = Counter(hashed(w)[0] % P.BUCKETS for t in texts for w in set(words(t)))
    return {b: max(1, 1 + int(math.log2(len(texts) // n))) if len(texts) >= n else 1 for b, n in df.items()}


def brute_print(text, weight):
    votes = [0] * 128
    for w in set(words(text)):
        hi, lo = hashed(w)
        for b in range(64):
            votes[b] += weight.get(hi % P.BUCKETS, 1) * (1 if lo >> b & 1 else -1)
            votes[64 + b] += weight.get(hi % P.BUCKETS, 1) * (1 if hi >> b & 1 else -1)
    return sum(1 << b for b in range(128) if votes[b] > 0)


def brute_edits(rows):
    """The contract's columns by plain code, for (doc_id, text) with different ids."""
    rows = sorted(rows, reverse=True)
    weight = brute_weights([t for _, t in rows])
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        own, new, following = (brute_print(x, weight) for x in (t, edited, after))
        like = [1 - (own ^ x).bit_count() / 128 for x in (new, following)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{own:032x}", f"{new:032x}", *like))
    return sorted(out)


@pytest.fixture(scope="module")
def some():
    rng = random.Random(4)
    rows = [(i * rng.choice([1, 3]) + 1000 * (i % 5), prose(i, rng.randint(0, 90))) for i in range(160)]
    rows = list(dict(rows).items())
    return [*rows, (9001, ""), (9002, "Ä ÖL"), (-5, "日本語 テキスト " * 5), (9003, rows[0][1]), (9004, prose(3, 3000))]


@pytest.mark.parametrize("slices", [256, 7, 1])
def test_edits_equal_brute_force(spark, some, monkeypatch, slices):
    monkeypatch.setattr(P, "SLICES", slices)
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
    got = P.edits(df)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.collect())) == brute_edits(some)


def test_order_with_hot_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICES", 8)
    rows = [(5, f"five {i}") for i in range(60)] + [(None, f"none {i}") for i in range(30)] + [(i, "t") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    light = P._rows(df).selectExpr("kd", "tag", "doc_id", "cast(length(text) as long) as n")
    next_of = {(r.kd, r.tag): (r.next_kd, r.next_tag) for r in P._order(light).collect()}
    ordered = sorted(((r.doc_id is not None, r.doc_id or 0, r.tag, r.kd) for r in light.collect()), reverse=True)
    keys = [(kd, tag) for _, _, tag, kd in ordered]
    assert next_of == {k: keys[(i + 1) % len(keys)] for i, k in enumerate(keys)}


def test_odd_rows(spark, odd, empty):
    rows = P.edits(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i in {r.doc_id for r in odd.collect() if r.doc_id is not None} | set()) + ["None", "None"]
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[3].fingerprint == by_id[4].fingerprint == by_id[5].fingerprint == "0" * 32
    assert by_id[3].n_chars == 0 and by_id[9].near_edited > by_id[9].near_next
    assert P.edits(empty).count() == 0 and P.fingerprints(empty).count() == 0


def test_single_document_is_its_own_next(spark):
    (row,) = P.edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert (row.edited_sha256, row.near_next) == (hashlib.sha256(b"abcdab").hexdigest(), 1.0)


def test_edited_texts_are_nearer_than_the_next(spark):
    rows = [(i, prose(i, 300)) for i in range(60)]
    got = P.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.near_edited > r.near_next for r in got)


@pytest.mark.parametrize("radius,spare", [(3, 2), (0, 3), (6, 1), (10, 2)])
def test_near_finds_all(spark, radius, spare):
    rng = random.Random(radius)
    prints = []
    for _ in range(40):
        base = rng.getrandbits(128)
        for _ in range(rng.randint(1, 6)):
            prints.append(base)
            for b in rng.sample(range(128), rng.randint(0, 6)):
                base ^= 1 << b
    signed = lambda x: x - 2**64 if x >> 63 else x
    halves = lambda x: (signed(x >> 64), signed(x & 2**64 - 1))
    df = spark.createDataFrame([halves(p) for p in prints], "hi long, lo long")
    once = sorted(set(prints), key=halves)
    want = sorted((*halves(a), *halves(b), (a ^ b).bit_count()) for k, a in enumerate(once) for b in once[k + 1 :] if (a ^ b).bit_count() <= radius)
    assert sorted(map(tuple, P.near(df, radius, spare).collect())) == want
    asked = once[::5]
    want = sorted((*halves(a), *halves(b), (a ^ b).bit_count()) for a in asked for b in once if (a ^ b).bit_count() <= radius)
    got = P.near(df, radius, spare, spark.createDataFrame([halves(p) for p in asked], "hi long, lo long"))
    assert sorted(map(tuple, got.collect())) == want


def test_blocks_out_of_range(spark):
    with pytest.raises(ValueError):
        P.block_tables(spark.createDataFrame([(1, 2)], "hi long, lo long"), 0, 1)


def test_main_path_is_native(spark, some):
    plan = P.edits(spark.createDataFrame(some, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
