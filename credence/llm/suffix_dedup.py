"""Repeated passages by sparse suffix arrays.

Of a document's suffixes (at word starts) only those at minimiser positions are kept: positions whose hash
of ``GRAM`` words is the least among the ``LENGTH - GRAM + 1`` that start in some stretch of ``LENGTH``
words. The choice depends on content alone, so two copies of a passage of ``LENGTH`` words keep the same
suffix of it. Suffixes whose first ``GRAM`` words occur once are dropped; the others are sorted by what
follows, each is compared with its neighbour for the length of their common prefix, and matches are
extended to the left: for each length r of the part at the right, suffixes that share r words form an
interval of the sorted array, and within it equal words at the left complete a passage of ``LENGTH``.
A passage counts as repeated if it stands in two documents, or twice in one without overlap.

Sorted runs are read batch by batch. A run of more than ``HOT`` suffixes is not held: its passages are
counted by an aggregation over their digests, which combines on the map side, with the same result. Words
that begin more than 1 / (4 x shuffle partitions) of all suffixes, fewer than 4 x shuffle partitions of them,
meet their suffixes by a broadcast.

Null, empty and short texts repeat nothing. Equal rows count as one document; different texts of one doc_id are told
apart by a hash of the text, repeat one another like those of different ids, and give their own stretches each. Rows
without a doc_id take no part. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm._common import cut, meet, shuffle_width, texts
from credence.llm._words import grams as _grams
from credence.llm._words import hashes

LENGTH = 50
GRAM = 8
HOT = 200_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PLACE = 22  # bits of a position inside a chunk


def anchors(words: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser positions and the hashes of their words; the leftmost of equal hashes in a stretch."""
    if len(words) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _grams(words, gram)
    span = length - gram + 1
    step = (1 << _PLACE) - span
    picked = []
    for start in range(0, max(1, len(h) - span + 1), step):
        part = h[start : start + step + span - 1]
        low = (part >> np.uint64(_PLACE)) << np.uint64(_PLACE) | np.arange(len(part), dtype=np.uint64)
        least, width = low, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(low) - span + 1], least[span - width : len(low) - width + 1])
        picked.append(start + (np.unique(least) & np.uint64((1 << _PLACE) - 1)).astype(np.int64))
    at = np.unique(np.concatenate(picked))
    return at, h[at]


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags, places, grams = [], [], [], []
            for i, tag, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tag", "text")), strict=True):
                at, h = anchors(hashes(t), length, gram)
                if len(at):
                    ids.append(np.full(len(at), i, dtype=np.int64))
                    tags.append(np.full(len(at), tag, dtype=np.int64))
                    places.append(at)
                    grams.append(h)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(ids)),
                        pa.array(np.concatenate(tags)),
                        pa.array(np.concatenate(places).astype(np.int32)),
                        pa.array(np.concatenate(grams).view(np.int64)),
                    ],
                    names=["doc_id", "tag", "pos", "gram"],
                )

    return run


def _context_rows(length: int, gram: int):
    """Each repeated suffix with the words around it: those before it backwards, those from it on.

    Suffixes of one document with the same words around them, at most ``length`` apart, are one row with
    the first and the last position, so that a repeated word or phrase does not multiply rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for i, tag, t, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tag", "text", "found")), strict=True):
                words = (hashes(t) >> np.uint64(32)).astype(">u4")
                back = np.ascontiguousarray(words[::-1])
                n = len(words)
                open_rows: dict[tuple, list[int]] = {}
                for x in sorted(found, key=lambda x: x["pos"]):
                    p = x["pos"]
                    key = (x["gram"], x["hot"], back[n - p : n - p + length - gram].tobytes(), words[p : p + length].tobytes())
                    row = open_rows.get(key)
                    if row is not None and p - row[1] < length:
                        row[1] = p
                        continue
                    if row is not None:
                        _put(out, (i, tag), row, key)
                    open_rows[key] = [p, p]
                for key, row in open_rows.items():
                    _put(out, (i, tag), row, key)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "tag", "pos", "last", "gram", "hot", "left", "right"]
            )

    return run


def _put(out: list[list], doc: tuple[int, int], row: list[int], key: tuple) -> None:
    for col, v in zip(out, (*doc, *row, *key), strict=True):
        col.append(v)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of ``width``, and how many there are."""
    cells = column.to_pylist()
    size = np.fromiter(map(len, cells), dtype=np.int64, count=len(cells)) // 4
    joined = b"".join(c.ljust(4 * width, b"\0") for c in cells)
    return np.frombuffer(joined, dtype=">u4").reshape(-1, width).astype(np.uint32), size


def _hashes(words: np.ndarray) -> np.ndarray:
    """Column j: hash of the first j words."""
    out = np.zeros((len(words), words.shape[1] + 1), dtype=np.uint64)
    for j in range(words.shape[1]):
        out[:, j + 1] = (out[:, j] + words[:, j].astype(np.uint64) + np.uint64(1)) * _PRIME
        out[:, j + 1] ^= out[:, j + 1] >> np.uint64(31)
    return out


def _neighbours(length: int, gram: int):
    """Spans of repeated passages, from suffixes sorted by gram and what follows."""

    def spans(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, end: np.ndarray, grams: np.ndarray, left: pa.Array, right: pa.Array) -> pa.RecordBatch | None:
        n = len(doc)
        lw, ln = _matrix(left, length - gram)
        rw, rn = _matrix(right, length)
        same = np.cumprod(rw[1:] == rw[:-1], axis=1).sum(axis=1)
        common = np.minimum(same, np.minimum(rn[1:], rn[:-1]))
        common[grams[1:] != grams[:-1]] = 0
        lh = _hashes(lw)
        first = np.full(n, length + 1, dtype=np.int64)
        last = np.zeros(n, dtype=np.int64)
        for r in range(gram, length + 1):
            fits = np.flatnonzero((rn >= r) & (ln >= length - r))
            if not len(fits):
                continue
            interval = np.concatenate([[0], np.cumsum(common < r)]).astype(np.uint64)[fits]
            key = (interval + np.uint64(1)) * _MIX ^ lh[fits, length - r]
            order = np.lexsort((pos[fits], tag[fits], doc[fits], key))
            k, d, t, p = key[order], doc[fits][order], tag[fits][order], pos[fits][order]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            ends = np.r_[starts[1:], len(k)] - 1
            twice = (d[starts] != d[ends]) | (t[starts] != t[ends]) | (np.maximum.reduceat(end[fits][order], starts) - p[starts] >= length)
            hit = fits[order[np.repeat(twice, ends - starts + 1)]]
            first[hit] = np.minimum(first[hit], r)
            last[hit] = r
        hit = np.flatnonzero(last)
        if not len(hit):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[hit]), pa.array(tag[hit]), pa.array(pos[hit] + first[hit] - length), pa.array(end[hit] + last[hit])], names=["doc_id", "tag", "start", "end"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            table = pa.concat_tables([held, table]) if held is not None else table
            grams = table.column("gram").to_numpy()
            whole = int(np.flatnonzero(grams == grams[-1])[0])
            held = table.slice(whole)
            if whole and (out := go(table.slice(0, whole))):
                yield out
        if held is not None and (out := go(held)):
            yield out

    def go(table: pa.Table) -> pa.RecordBatch | None:
        table = table.combine_chunks()
        return spans(
            table.column("doc_id").to_numpy(),
            table.column("tag").to_numpy(),
            table.column("pos").to_numpy().astype(np.int64),
            table.column("last").to_numpy().astype(np.int64),
            table.column("gram").to_numpy(),
            table.column("left"),
            table.column("right"),
        )

    return run


def _passages(length: int, gram: int):
    """Every passage around a suffix: digest, document, first word, and that of the row's last position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                doc, tag, pos, end = (part.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "tag", "pos", "last"))
                lw, ln = _matrix(part.column("left"), length - gram)
                rw, rn = _matrix(part.column("right"), length)
                lh, rh = _hashes(lw), _hashes(rw)
                for r in range(gram, length + 1):
                    fits = np.flatnonzero((rn >= r) & (ln >= length - r))
                    key = (rh[fits, r] + np.uint64(r)) * _MIX ^ lh[fits, length - r]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(doc[fits]), pa.array(tag[fits]), pa.array(pos[fits] + r - length), pa.array(end[fits] + r - length)],
                        names=["key", "doc_id", "tag", "start", "last"],
                    )

    return run


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, start, end, n_words of every stretch of words [start, end) that repeated passages cover."""
    spark = docs.sparkSession
    rows = texts(docs).where("doc_id is not null").withColumn("tag", F.xxhash64("text"))
    found = cut(rows.mapInArrow(_anchor_rows(length, gram), "doc_id long, tag long, pos int, gram long"))
    place, doc = F.struct("doc_id", "tag", "pos"), F.struct("doc_id", "tag")
    share, total = 4 * shuffle_width(spark), found.count()
    often = (
        found.groupBy("gram")
        .agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
        .where("a < b")
        .select("gram", (F.col("n") > hot).alias("hot"), (F.col("n") * share > total).alias("common"))
    )
    by_doc = (
        meet(found, ["gram"], cut(often), ["hot"])
        .groupBy("doc_id", "tag")
        .agg(F.collect_set(F.struct("pos", "gram", "hot")).alias("found"))
    )
    around = (
        rows.join(by_doc, ["doc_id", "tag"])
        .select("doc_id", "tag", "text", "found")
        .mapInArrow(_context_rows(length, gram), "doc_id long, tag long, pos int, last int, gram long, hot boolean, left binary, right binary")
    )
    around = cut(around)
    sorted_runs = (
        around.where("not hot").drop("hot").repartition(shuffle_width(spark), "gram").sortWithinPartitions("gram", "right")
    )
    spans = sorted_runs.mapInArrow(_neighbours(length, gram), "doc_id long, tag long, start long, end long")
    passages = around.where("hot").mapInArrow(_passages(length, gram), "key long, doc_id long, tag long, start long, last long")
    twice = (
        passages.groupBy("key")
        .agg(F.min(doc).alias("a"), F.max(doc).alias("b"), (F.max("last") - F.min("start")).alias("apart"))
        .where(f"a <> b or apart >= {length}")
        .select("key")
    )
    spans = spans.unionByName(passages.join(twice, "key", "left_semi").select("doc_id", "tag", "start", (F.col("last") + length).alias("end")))
    in_order = Window.partitionBy("doc_id", "tag").orderBy("start", "end")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.col("before") >= F.col("start"), 0).otherwise(1)).over(in_order)
    return (
        spans.groupBy("doc_id", "tag", "start")
        .agg(F.max("end").alias("end"))
        .withColumn("before", before)
        .withColumn("group", group)
        .groupBy("doc_id", "tag", "group")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"))
    )
