"""Substring dedup by hashing lines, and passages that lie across or inside lines.

Units are of two kinds. Each line that holds anything is one, however short; it is normalised (lower case,
white space to one blank, marks at its edges trimmed) and digested to 128 bits. And each passage of
``LENGTH`` words is one, wherever it starts and ends; its words are compared in lower case. All digests meet
in one aggregation that keeps the least (doc_id, number of the first word): the earliest occurrence, which
stays. The words of all others go, with the offsets that they had in the text.

Passages are grouped into blocks: those in a row that share the position whose ``GRAM`` words have the least
hash among the positions in the passage. Two equal passages have the same least words, so blocks whose
least words stand in one place of the corpus alone are left out first. The others are digested and meet like
lines. Blocks that differ and have the same least words may share a passage; the first of each kind is
taken apart into its passages, which are digested and meet once more. Nothing is sampled: the words found
are those that a comparison of all passages finds. A passage that overlaps its own first place is no
repetition.

Aggregations combine on the map side, so a unit that is everywhere costs a row for each task, and its first
place is broadcast to its rows. What a document loses comes back by doc_id, in a list no longer than the
document; no posting list of a unit is ever gathered.

Null and empty texts have no units. Equal rows count as one document and lose the same words; different
texts of one doc_id are told apart, and ranked, by a hash of the text. Rows without a doc_id keep their text
and make no other row lose any. Further columns are ignored. Words are parted by white space, so in a script
without spaces whole lines are found, passages inside a line are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm._common import cut, meet, shuffle_width, texts
from credence.llm._words import grams, hashes, places

LENGTH = 50
GRAM = 8
#: Marks that are trimmed from the edges of a line before it is compared.
MARKS = " .,;:!?\"'()[]-*_|<>"

_FOUND = "doc_id long, tag long, unit int, words int, gram long, d1 long, d2 long, passages int"


def line_units(text: str) -> list[tuple[int, int, bytes]]:
    """(number of the first word, words, digest) of each line of the text that holds anything."""
    out, at = [], 0
    for line in text.lower().split("\n"):
        words = line.split()
        if words:
            whole = " ".join(words)
            norm = whole.strip(MARKS) or whole
            out.append((at, len(words), xxhash.xxh3_128_digest(norm.encode("utf-8", "surrogatepass"))))
            at += len(words)
    return out


def blocks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the first word, number of passages and hash of the least words of each block of hashed words."""
    n = len(words) - LENGTH + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h, span = grams(words, GRAM), LENGTH - GRAM + 1
    least = (h >> np.uint64(32)) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    at = (np.minimum(least[:n], least[span - width : span - width + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return begin, np.diff(np.append(begin, n)), h.view(np.int64)[at[begin]]


def _digests(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> bytes:
    """128 bits of each run of hashed words, end to end."""
    held = words.tobytes()
    return b"".join([xxhash.xxh3_128_digest(held[x:y]) for x, y in zip((8 * first).tolist(), (8 * last).tolist(), strict=True)])


def _batch(ids: list, tags: list, parts: list[tuple]) -> pa.RecordBatch:
    """Rows of documents; a part holds first words, counts of words, digests, least words, counts of passages (None for lines)."""
    sizes = [len(x[0]) for x in parts]

    def column(k: int, kind: type) -> np.ndarray:
        return np.concatenate([np.asarray(x[k], dtype=kind) for x in parts] or [np.empty(0, kind)])

    d = np.frombuffer(b"".join(x[2] for x in parts), dtype=np.int64).reshape(-1, 2)
    line = np.repeat([x[4] is None for x in parts] or [], sizes).astype(bool)
    least = np.concatenate([np.zeros(n, np.int64) if x[3] is None else x[3] for x, n in zip(parts, sizes, strict=True)] or [np.empty(0, np.int64)])
    passages = np.concatenate([np.zeros(n, np.int64) if x[4] is None else x[4] for x, n in zip(parts, sizes, strict=True)] or [np.empty(0, np.int64)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(np.repeat(np.array(tags, np.int64), sizes)),
            pa.array(column(0, np.int32)), pa.array(column(1, np.int32)), pa.array(np.where(line, d[:, 0], least)),
            pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.array(passages.astype(np.int32), mask=line),
        ],
        names=["doc_id", "tag", "unit", "words", "gram", "d1", "d2", "passages"],
    )


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines and blocks of documents. The least words of a line are its digest."""
    for b in batches:
        ids, tags, parts = [], [], []
        for i, tag, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tag", "text")), strict=True):
            lines = line_units(t) if t else []
            if not lines:
                continue
            at, n, d = zip(*lines, strict=True)
            ids.append(i)
            tags.append(tag)
            parts.append((at, n, b"".join(d), None, None))
            if at[-1] + n[-1] >= LENGTH:
                words = hashes(t.lower())
                first, count, least = blocks(words)
                last = first + count + LENGTH - 1
                ids.append(i)
                tags.append(tag)
                parts.append((first, last - first, _digests(words, first, last), least, count))
        yield _batch(ids, tags, parts)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of the blocks in ``parts``, one by one."""
    for b in batches:
        ids, tags, out = [], [], []
        for i, tag, t, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tag", "text", "parts")), strict=True):
            at = np.unique(np.concatenate([np.arange(x["unit"], x["unit"] + x["passages"]) for x in parts]))
            ids.append(i)
            tags.append(tag)
            out.append((at, np.full(len(at), LENGTH), _digests(hashes(t.lower()), at, at + LENGTH), np.zeros(len(at), np.int64), np.ones(len(at))))
        yield _batch(ids, tags, out)


def _after_first(found: DataFrame, total: int) -> DataFrame:
    """Rows of ``found`` that an earlier one equals, with its place and whether they lie clear of it.

    A digest with more than 1 / (4 x shuffle partitions) of all units is common: fewer than 4 x shuffle
    partitions digests can be, so their first places are broadcast.
    """
    share = 4 * shuffle_width(found.sparkSession)
    at = F.struct("doc_id", "tag", "unit")
    first = found.groupBy("d1", "d2").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    first = cut(first.where("first < last").select("d1", "d2", "first", (F.col("n") * share > total).alias("common")))
    same = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.tag") == F.col("tag"))
    apart = F.col("passages").isNull() | ~same | (F.col("unit") - F.col("first.unit") >= LENGTH)
    return meet(found, ["d1", "d2"], first, ["first"]).where(at > F.col("first")).select(
        "doc_id", "tag", "unit", "words", "passages", apart.alias("apart"), F.col("first.doc_id").alias("first_doc_id")
    )


def _rows(docs: DataFrame) -> DataFrame:
    return texts(docs).where("doc_id is not null and text is not null").withColumn("tag", F.xxhash64("text"))


def _repeats(docs: DataFrame) -> DataFrame:
    rows = _rows(docs)
    share = 4 * shuffle_width(docs.sparkSession)
    every = cut(rows.mapInArrow(_units, _FOUND))
    total = every.count()
    often = every.groupBy("gram").agg(F.count("*").alias("n"), F.min("d1").alias("a"), F.max("d1").alias("b")).where("n > 1")
    often = cut(often.select("gram", (F.col("a") < F.col("b")).alias("mixed"), (F.col("n") * share > total).alias("common")))
    found = cut(meet(every, ["gram"], often, ["mixed"]))
    later = cut(_after_first(found, total))

    # Blocks that share their least words with a different one: the first of each kind, in passages, and
    # those that overlap the first of their kind, whose passages may have an earlier place in another kind.
    mixed = found.where("mixed and passages is not null").groupBy("d1", "d2")
    kinds = mixed.agg(F.min(F.struct("doc_id", "tag", "unit", "passages")).alias("x")).select("x.*")
    kinds = kinds.unionByName(later.where("not apart").select("doc_id", "tag", "unit", "passages"))
    by_doc = kinds.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("unit", "passages")).alias("parts"))
    one = rows.join(by_doc, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]).select("doc_id", "tag", "text", "parts")
    single = cut(one.mapInArrow(_passages, _FOUND))
    single = _after_first(single, single.count())
    return later.unionByName(single).where("apart").select("doc_id", "tag", "unit", "words", "first_doc_id")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, unit, words, first_doc_id of every line or passage that an earlier one equals.

    ``unit`` is the number of its first word. Rows of one document may overlap.
    """
    return _repeats(docs).drop("tag").distinct()


def remove(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the words of the spans (first word, words), and the offsets [start, end) of the stretches that went.

    A line that loses words keeps the others, parted by one blank; a line that loses all of them goes.
    """
    starts, ends = places(text)
    gone = np.zeros(len(starts) + 1, dtype=np.int64)
    for first, n in spans:
        gone[first] += 1
        gone[min(first + n, len(starts))] -= 1
    mask = np.cumsum(gone)[:-1] > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    went = [(int(starts[a]), int(ends[b - 1])) for a, b in zip(turns[::2], turns[1::2], strict=True)]
    out, at = [], 0
    flags = mask.tolist()
    for line in text.split("\n"):
        words = line.split()
        lost = flags[at : at + len(words)]
        at += len(words)
        if not any(lost):
            out.append(line)
        elif not all(lost):
            out.append(" ".join([w for w, x in zip(words, lost, strict=True) if not x]))
    return "\n".join(out), went


def _with_spans(docs: DataFrame) -> DataFrame:
    """``row``, the row of ``docs``, with the spans of words that it loses (null without any)."""
    spans = F.collect_set(F.struct("unit", "words")).alias("spans")
    gone = _repeats(docs).groupBy(F.col("doc_id").alias("id"), F.col("tag").alias("own")).agg(spans)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    return rows.join(gone, (F.col("key") == F.col("id")) & (F.col("hash") == F.col("own")), "left").select("row", "spans")


def _left(batch: pa.RecordBatch, names: list[str]) -> tuple[dict[str, pa.Array], list[tuple[str | None, list | None]]]:
    """The columns of a batch's rows, and text and offsets of each row; None for rows that lose nothing."""
    cols = dict(zip(names, batch.column("row").flatten(), strict=True))
    texts_spans = zip(cols["text"].to_pylist(), batch.column("spans").to_pylist(), strict=True)
    return cols, [remove(t, [(s["unit"], s["words"]) for s in x]) if x else (t, None) for t, x in texts_spans]


def with_offsets(docs: DataFrame) -> DataFrame:
    """doc_id, text without later occurrences, its n_chars, and the offsets [start, end) of what went from the text, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, left = _left(b, ["doc_id", "text"])
            went = [[{"start": s, "end": e} for s, e in x or []] for _, x in left]
            new = [t for t, _ in left]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            sizes = pa.array([None if t is None else len(t) for t in new], pa.int64())
            yield pa.RecordBatch.from_arrays([cols["doc_id"], pa.array(new, pa.string()), sizes, pa.array(went, kind)], names=["doc_id", "text", "n_chars", "removed"])

    return _with_spans(texts(docs)).mapInArrow(run, "doc_id long, text string, n_chars long, removed array<struct<start:int,end:int>>")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns; text without later occurrences, n_chars (if there) their new length.

    A row whose text is all repeated goes.
    """
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, left = _left(b, names)
            cols["text"] = pa.array([t for t, _ in left], cols["text"].type)
            if "n_chars" in cols:
                was = cols["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([w if x is None else len(t) for (t, x), w in zip(left, was, strict=True)], cols["n_chars"].type)
            out = pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)
            yield out.filter(pa.array([not (x and not t.strip()) for t, x in left], pa.bool_()))

    return _with_spans(docs).mapInArrow(run, schema)
