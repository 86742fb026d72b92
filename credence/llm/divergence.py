"""How far the term use of each source lies from its peers' and from its language's, by systolic rotation.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. Each language keeps the V terms that stand in
at least ``LEAST`` of its documents. A group (lang, source), and each language, gives every kept term the smoothed
share p = 1 + floor(10^9 (count + 5) / (N + 5 V)) in exact integers, N being its count over kept terms.

* Tasks count terms with tables of bounded size; counts meet by group and term, then by term.
* The vocabulary of a language is cut into shards of about ``SHARD`` terms by hash and numbered within each, so a group
  is a vector for each shard, of bounded size: numbers and shares of the terms it has, packed; all others share one p.
* Rotation: the groups of a language sit in a ring of slots, at most ``SLOTS``. Their vectors stay in the partition of
  (lang, shard, slot), one shuffle that all rounds read. In round r the packed vectors of each slot visit the slot r
  places on; after half a turn every two slots have met once, and a meeting gives the distance to both groups.
  In round 0 the groups of one slot meet. Distances are sums over shards.
* A heap for each vector keeps the ``TOP`` terms most above the language's share; the heaps' terms are ranked by group.

The pairs of a language's sources are the result itself; no documents or terms are paired. Only the number of rounds
comes to the driver.

A null text, lang or source is ''. A group whose documents have no kept term has no ``term`` rows; the only source of a
language has no ``pair`` rows; where V = 0 all distances are 0. Every row is a document, repeated ones too. Ties go by
the item's UTF-8 bytes. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm._common import cut

LEAST = 30
TOP = 50
UNIT, SMOOTH = 1_000_000_000, 5
SHARD = 4096
SLOTS, SEATS = 32, 4
#: Entries that a task counts before it passes them on.
HELD = 1 << 18
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms(text: str) -> list[bytes]:
    return _TERM.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, occurrences and documents, summed over what a task has read since it last passed counts on."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            words = pa.array([w.decode("utf-8", "surrogatepass") for w in n], pa.string())
            size = len(words)
            columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), words, pa.array(n.values(), pa.int64()), pa.array([docs[w] for w in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            words = terms(text)
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 V)), exact."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(19,0)")
    return F.call_function("div", top, (total + SMOOTH * kept).cast("decimal(19,0)")) + 1


def pack(numbers: np.ndarray, shares: np.ndarray) -> bytes:
    """Sorted term numbers and their shares, in few bytes."""
    return zlib.compress(np.concatenate([np.diff(numbers, prepend=0), shares]).astype("<i4").tobytes(), 1)


def unpack(data: bytes, width: int, rest: int) -> np.ndarray:
    """The share of every term of a shard."""
    both = np.frombuffer(zlib.decompress(data), dtype="<i4")
    out = np.full(width, rest, dtype=np.int64)
    half = len(both) // 2
    out[np.cumsum(both[:half])] = both[half:]
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's packed vector of each shard, and its heap of terms above the language's share."""
    top_type = pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())]))
    for b in batches:
        data, top = [], []
        column = b.column("cells")
        sizes = np.diff(column.offsets.to_numpy()) if b.num_rows else []
        number, p, q, words = column.flatten().flatten()
        number, p, q, at = number.to_numpy(), p.to_numpy(), q.to_numpy(), 0
        for size in sizes:
            own = slice(at, at + size)
            data.append(pack(number[own], p[own]))
            gap = p[own] - q[own]
            above = np.flatnonzero(gap > 0)
            heap = heapq.nsmallest(TOP, zip((-gap[above]).tolist(), (w.encode("utf-8", "surrogatepass") for w in words.take(pa.array(above + at)).to_pylist()), strict=True))
            top.append([{"item": w.decode("utf-8", "surrogatepass"), "value": -v} for v, w in heap])
            at += size
        kept = ["lang", "source", "shard", "slot", "slots", "width", "rest"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(data, pa.binary()), pa.array(top, top_type)], names=[*kept, "data", "top"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distance of each resident and visitor over a shard, told to both."""
    opened: dict[tuple, np.ndarray] = {}

    def vector(key: tuple, data: bytes, width: int, rest: int) -> np.ndarray:
        if key not in opened:
            if len(opened) >= 256:
                opened.clear()
            opened[key] = unpack(data, width, rest)
        return opened[key]

    names = ("lang", "shard", "width", "source", "data", "rest", "item", "item_data", "item_rest")
    for b in batches:
        langs, left, right, values = [], [], [], []
        for lang, shard, width, a, a_data, a_rest, c, c_data, c_rest in zip(*(b.column(x).to_pylist() for x in names), strict=True):
            f = int(np.abs(vector((lang, shard, a), a_data, width, a_rest) - vector((lang, shard, c), c_data, width, c_rest)).sum())
            langs += [lang, lang]
            left += [a, c]
            right += [c, a]
            values += [f, f]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "item", "value"])


def vectors(docs: DataFrame) -> DataFrame:
    """lang, source, shard, slot, slots, width, rest, data, top: the packed vector of every group in every shard, written."""
    words = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = cut(
        words.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    groups = words.select("lang", "source").distinct()
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST).drop("docs")
    by_term = cut(by_term)
    # A row for each language, written so that its size is known.
    langs = cut(by_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n")).withColumn("shards", F.ceil(F.col("v") / SHARD)))
    # Dealt by shard, lest a language's whole vocabulary be numbered in one task.
    cell = by_term.join(langs, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards"))).repartition("lang", "shard")
    number = F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1
    cell = cut(cell.select("lang", "term", "shard", number.alias("number"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"), "v"))
    have = cut(counts.join(cell, ["lang", "term"]).select("lang", "source", "term", "shard", "number", "q", "n"))

    totals = have.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    widths = cell.groupBy("lang", "shard").agg(F.count("*").cast("int").alias("width"))
    # Windows over the sources of a language: no more rows than the result has for one of them.
    of_lang = Window.partitionBy("lang")
    seats = groups.join(totals, ["lang", "source"], "left").join(langs.select("lang", "v", "shards"), "lang", "left")
    seats = seats.withColumn("place", F.row_number().over(of_lang.orderBy("source")) - 1).withColumn("slots", F.least(F.lit(SLOTS), F.ceil(F.count("*").over(of_lang) / SEATS)).cast("int"))
    seats = seats.select(
        "lang", "source", "slots", (F.col("place") % F.col("slots")).cast("int").alias("slot"), F.coalesce("group_n", F.lit(0)).alias("group_n"), F.coalesce("v", F.lit(0)).alias("v"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shards", F.lit(1)) - 1)).alias("shard"),
    )
    seats = seats.withColumn("rest", F.when(F.col("v") > 0, share(F.lit(0), F.col("group_n"), F.col("v"))).otherwise(0)).join(widths, ["lang", "shard"], "left").fillna(0, ["width"])
    shares = have.join(totals, ["lang", "source"]).join(langs.select("lang", "v"), "lang").withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))
    # No more entries than a shard has terms.
    cells = shares.groupBy("lang", "source", "shard").agg(F.sort_array(F.collect_list(F.struct("number", "p", "q", "term"))).alias("cells"))
    rows = seats.join(cells, ["lang", "source", "shard"], "left").select("lang", "source", "shard", "slot", "slots", "width", "rest", F.coalesce("cells", F.array()).alias("cells"))
    return cut(rows.mapInArrow(_vectors, "lang string, source string, shard long, slot int, slots int, width int, rest long, data binary, top array<struct<item:string,value:long>>"))


def rotate(held: DataFrame) -> DataFrame:
    """lang, source, item, value: the distance of every two sources of a language, in both directions."""
    residents = held.select("lang", "shard", "slot", "width", "source", "data", "rest")
    most = held.agg(F.max("slots")).first()[0] or 0
    met = None
    for r in range(most // 2 + 1):
        goes = F.col("slots") > 0 if r == 0 else (2 * r < F.col("slots")) | ((2 * r == F.col("slots")) & (F.col("slot") < r))
        visitors = held.where(goes).select(
            "lang", "shard", F.pmod(F.col("slot") + r, F.col("slots")).cast("int").alias("slot"), F.col("source").alias("item"), F.col("data").alias("item_data"), F.col("rest").alias("item_rest")
        )
        # Both sides are dealt by slot; the residents' exchange is the same in all rounds, so it is made once.
        meeting = residents.hint("merge").join(visitors, ["lang", "shard", "slot"])
        if r == 0:
            meeting = meeting.where("source < item")
        met = meeting if met is None else met.unionByName(meeting)
    found = met.mapInArrow(_meet, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its peers by distance, and the terms most above its language's share."""
    held = vectors(docs)
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = rotate(held).select("*", F.lit("pair").alias("part"), F.row_number().over(ordered).alias("rank"))
    above = held.select("lang", "source", F.explode("top").alias("x")).select("lang", "source", "x.*")
    above = above.select("*", F.lit("term").alias("part"), F.row_number().over(ordered).alias("rank")).where(F.col("rank") <= TOP)
    return pairs.select(columns).unionByName(above.select(columns))
