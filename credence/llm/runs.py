"""Periodic runs of words by longest previous factors, LZ blocks, boundary extensions and copied runs.

A run is a stretch of consecutive words with smallest period q, at least ``max(shortest, power * q)`` words long,
that no neighbouring word extends keeping period q. For a text:

1. Words become symbols. Suffixes are sorted by doubling: the ranks of the stretches of 1, 2, 4, ... words are kept, so
   the common length of any two places, forwards or backwards, is read off the ranks by descending powers of two.
2. LPF, the longest previous factor at each place, is the longer common length with the nearest earlier places on
   either side in suffix order. Blocks follow: each is the longest previous factor at its start, or one word.
3. A run that touches a block's start b ends within the block or begins after the block before, less a period; so its
   period is below ``(sizes of both blocks) / (power - 1)``. For each such period the common lengths to both sides of b
   and b +- period give the run (Main's extensions). As many are asked for as there are words.
4. A run strictly inside a block is a copy of one inside its earlier place. Runs lie in buckets by their start; a block
   copies those of its source in order, its own first ones included where both overlap.

Documents are taken in batches of about ``BATCH`` words, or one by one where longer; equal words of different documents
are different symbols, so nothing spans two. A document whose stretches of ``shortest - 1`` words are all different has
no run, as the stretch at a run's start stands again a period later; it isn't sorted. Memory is a few
numbers per word and doubling of the longest text of a batch.

A null text has no words, and no runs; its collapsed text is empty, as is that of an empty one. Rows stay as they are,
repeated ones and those without a doc_id too; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST, POWER = 6, 4
BATCH = 1 << 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

Run = tuple[int, int, int]


def _heads(keys: np.ndarray) -> np.ndarray:
    """Whether each of some sorted keys differs from the one before."""
    return np.concatenate([[True], keys[1:] != keys[:-1]])


def stretch_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... symbols from each place on, until all differ; those over the end are shorter.

    A rank is the number of places with a lesser stretch. Only places that share their rank are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    head = _heads(symbols[order])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    shared = order[~(head & np.append(head[1:], True))]
    ranks, width = [rank.astype(np.int32)], 1
    while len(shared):
        beyond = shared + width
        after = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[shared] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        shared, key = shared[order], key[order]
        was, place = rank[shared], np.arange(len(shared))
        head = _heads(key)
        first = np.maximum.accumulate(np.where(_heads(was), place, 0))
        rank = rank.copy()
        rank[shared] = was + np.maximum.accumulate(np.where(head, place, 0)) - first
        shared = shared[~(head & np.append(head[1:], True))]
        ranks.append(rank.astype(np.int32))
        width *= 2
    return ranks


def common_after(ranks: Sequence[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from places a and b on agree; a place at the end agrees with none. a and b differ."""
    n, a, b = len(ranks[0]), a.copy(), b.copy()
    start = a.copy()
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
        a[same] += 1 << k
        b[same] += 1 << k
    return a - start


def common_before(ranks: Sequence[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols before places a and b agree. a and b differ."""
    a, b = a.copy(), b.copy()
    start = a.copy()
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a - (1 << k), b - (1 << k)
        inside = np.flatnonzero((x >= 0) & (y >= 0))
        same = inside[ranks[k][x[inside]] == ranks[k][y[inside]]]
        a[same], b[same] = x[same], y[same]
    return start - a


def _nearest_less(values: np.ndarray, step: int) -> np.ndarray:
    """For each index the nearest to one side (step -1 or 1) that holds a lesser value; -1 or n without one.

    All jump at once: between an index and where it points nothing is lesser, so it may go on to where that points.
    """
    n = len(values)
    at = np.arange(n) + step
    padded = np.append(values, [-1, -1])  # index n and index -1 hold less than all
    waiting = np.flatnonzero(padded[at] > values)
    while len(waiting):
        at[waiting] = at[at[waiting]]
        waiting = waiting[padded[at[waiting]] > values[waiting]]
    return at


def previous_factors(ranks: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """LPF and the place of an earlier occurrence, for each place of the text."""
    n = len(ranks[0])
    suffixes = np.argsort(ranks[-1])
    padded = np.append(suffixes, n)
    length, source = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for step in (-1, 1):
        near = _nearest_less(suffixes, step)
        there = (near >= 0) & (near < n)
        here, before = suffixes[there], padded[near[there]]
        found = common_after(ranks, before, here)
        longer = found > length[here]
        length[here[longer]], source[here[longer]] = found[longer], before[longer]
    return length, source


def _touching(ranks: Sequence[np.ndarray], starts: np.ndarray, sizes: np.ndarray, shortest: int, power: int) -> list[Run]:
    """The runs that touch a block's start, or the text's end, with their smallest periods."""
    n = len(ranks[0])
    bounds, around = np.append(starts, n), np.append(sizes, 0) + np.append(0, sizes)
    count = around // (power - 1)
    total = int(count.sum())
    if not total:
        return []
    b = np.repeat(bounds, count)
    p = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + 1
    found = []
    for low in (b, b - p):
        ok = (low >= 0) & (low + p <= n)
        x, q = low[ok], p[ok]
        back, on = common_before(ranks, x, x + q), common_after(ranks, x, x + q)
        size = back + on + q
        keep = size >= np.maximum(shortest, power * q)
        found.append(np.stack([(x - back)[keep], size[keep], q[keep]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.empty(0, bool)
    return [tuple(r) for r in rows[new].tolist()]


def find_runs(symbols: np.ndarray, shortest: int = SHORTEST, power: int = POWER) -> list[Run]:
    """(start, length, smallest period) of all runs of the symbols, by start, then period. ``power`` is 2 at least."""
    n = len(symbols)
    if n < shortest:
        return []
    ranks = stretch_ranks(symbols)
    length, source = previous_factors(ranks)
    step, starts, at = np.maximum(length, 1).tolist(), [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    begins = np.array(starts)
    sizes = np.diff(np.append(begins, n))
    buckets: dict[int, list[tuple[int, int]]] = {}
    for start, size, period in _touching(ranks, begins, sizes, shortest, power):
        buckets.setdefault(start, []).append((size, period))
    if not buckets:
        return []
    # A run inside a block leaves a word on either side.
    wide = sizes >= shortest + 2
    for begin, size, origin in zip(begins[wide].tolist(), sizes[wide].tolist(), source[begins[wide]].tolist(), strict=True):
        last = origin + size - 1
        for start in _starts(buckets, origin + 1, last):
            for length_, period in buckets[start]:
                if start + length_ <= last:
                    there = buckets.setdefault(start + begin - origin, [])
                    if (length_, period) not in there:
                        there.append((length_, period))
    return sorted(((s, size, p) for s, some in buckets.items() for size, p in some), key=lambda r: (r[0], r[2]))


def _starts(buckets: dict[int, list[tuple[int, int]]], first: int, end: int) -> Iterator[int]:
    """The starts of runs in [first, end), in order; those added on the way included."""
    if end - first <= 4 * len(buckets):
        yield from (s for s in range(first, end) if s in buckets)
        return
    done = first - 1
    while left := [s for s in buckets if done < s < end]:
        done = min(left)
        yield done


def split_words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass")) if text else []


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the periodic tail that one in ten ids gets; a row without an id keeps its words."""
    if not words or doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapse(words: list[bytes], runs: Sequence[Run]) -> str:
    """The words joined by one blank, without those that stand in a run after its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for start, size, period in runs:
            gone[start + period] += 1
            gone[start + size] -= 1
        words = [w for w, lost in zip(words, (np.cumsum(gone) > 0).tolist(), strict=False) if not lost]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _repeats(codes: np.ndarray, width: int) -> bool:
    """Whether some stretch of ``width`` codes stands twice (by hash, so it may say yes too often, never no)."""
    n = len(codes) - width + 1
    if n < 2:
        return False
    h = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[j : j + n]
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def batch_runs(texts: Sequence[list[bytes]], shortest: int = SHORTEST, power: int = POWER) -> list[list[Run]]:
    """The runs of each of some texts, given as words."""
    out: list[list[Run]] = [[] for _ in texts]
    number: dict[bytes, int] = {}
    held: list[tuple[int, np.ndarray]] = []
    for k, words in enumerate(texts):
        if len(words) >= shortest:
            codes = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
            if _repeats(codes, shortest - 1):
                held.append((k, codes))
    group: list[tuple[int, np.ndarray]] = []
    while held or group:
        if held and (not group or sum(len(c) for _, c in group) + len(held[0][1]) <= BATCH):
            group.append(held.pop(0))
            if held:
                continue
        first = np.cumsum([0, *(len(c) for _, c in group)])
        # Equal words of two documents are two symbols.
        own = np.concatenate([c.astype(np.int64) + d * len(number) for d, (_, c) in enumerate(group)])
        runs = find_runs(own, shortest, power)
        where = np.searchsorted(first, [r[0] for r in runs], side="right") - 1
        for d, (start, size, period) in zip(where.tolist(), runs, strict=True):
            out[group[d][0]].append((start - int(first[d]), size, period))
        group = []
    return out


def periodic_runs(docs: DataFrame, plant: bool = False, shortest: int = SHORTEST, power: int = POWER) -> DataFrame:
    """doc_id, runs (start, length, period, by start, then period) and collapsed text of every row of ``docs``.

    ``plant`` gives one id in ten a periodic tail before runs are sought. Nothing is shuffled.
    """
    if power < 2 or shortest < 2:
        raise ValueError("a run has two periods and two words at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = b.column("doc_id").to_pylist()
                words = [split_words(t) for t in b.column("text").to_pylist()]
                if plant:
                    words = [planted(w, i) for w, i in zip(words, ids, strict=True)]
                found = batch_runs(words, shortest, power)
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
                left = [collapse(w, runs) for w, runs in zip(words, found, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind), pa.array(left, pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, ties by start, then period; null without one. Ratios are compared crosswise."""
    def better(a: Column, x: Column) -> Column:
        left, right = x["length"] * a["period"], a["length"] * x["period"]
        tie = (left == right) & ((x["start"] < a["start"]) | ((x["start"] == a["start"]) & (x["period"] < a["period"])))
        return F.when(a.isNull() | (left > right) | tie, x).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def run_report(docs: DataFrame) -> DataFrame:
    """A row for each document with a planted tail in one of ten: its number of runs, the strongest, digests of all runs and of the collapsed text."""
    found = periodic_runs(docs, plant=True).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
