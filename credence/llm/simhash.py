"""SimHash near-duplicates by an inverted index on choices of five byte positions, in place of count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most three bits differ in at
most three bytes, so they share at least five of the eight positional bytes: the guaranteed minimum. Lists
of one positional byte hold a 256th of all rows or more, and a tally over their pairs grows with the square
of the table. The index therefore keeps one posting list for each choice of five positions and their bytes
(56 choices): a pair that reaches the minimum meets in some list, and no pair below it meets in any. In a
list of two the shared positional bytes are tallied; in a longer one they are five or more by construction.
The bits that differ are counted to verify a pair.

Copies are collapsed first: a fingerprint enters the index once, under its smallest doc_id. A list emits
no pairs but a spanning forest of its links, so a list of m fingerprints emits fewer than m rows and no
link is lost from the components. Lists are read as sorted runs; a run holds distinct fingerprints that
share 40 bits, at most 2**24 of eight bytes. Fingerprints of more than 1 / (4 x shuffle partitions) of all
rows, fewer than 4 x shuffle partitions of them, meet their rows by a broadcast.

Null and empty texts have no shingles and the fingerprint zero, linked like any other. Rows without a
doc_id keep a null doc_id and take part in no link. Rows of one doc_id are one document: different texts of
it link what either of them links. Repeated rows give repeated results. Further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm._common import cut, meet, shuffle_width, texts
from credence.llm.components import components

WIDTH = 3
SEED = 42
MAX_BITS = 3
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PLACES = list(itertools.combinations(range(8), 8 - MAX_BITS))
_CHUNK = 1 << 16


def _ones(values: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(values.view(np.uint8), bitorder="little").reshape(-1, 64)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """64 votes of the shingles' hashes: a bit is 1 if more than half of them have it."""
    if not text:
        return 0
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < WIDTH:
        return digest(b" ".join(words), SEED)
    total = len(words) - WIDTH + 1
    votes = np.zeros(64, dtype=np.int64)
    shingles = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:], strict=False))
    for start in range(0, total, _CHUNK):
        size = min(_CHUNK, total - start)
        hashes = np.fromiter(
            (digest(s, SEED) for s in itertools.islice(shingles, size)), dtype=np.uint64, count=size
        )
        votes += _ones(hashes)
    return int(np.packbits(votes * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *marks: Column) -> DataFrame:
    """(doc_id, fp) of every row, and further longs; fp is the fingerprint's bits as a signed long."""
    names = ["doc_id", *[f"mark{k}" for k in range(len(marks))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(fps.view(np.int64))], names=[*names, "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[m.alias(n) for m, n in zip(marks, names[1:], strict=True)])
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "fp"]))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each choice of positions: the choice and its bytes in one long, the fingerprint, its document."""
    shifts = [np.array([8 * p for p in places], dtype=np.uint64) for places in _PLACES]
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            fp = part.column("fp").to_numpy().view(np.uint64)
            rep = part.column("rep").to_numpy()
            keys = np.empty((len(_PLACES), len(fp)), dtype=np.uint64)
            for c, shift in enumerate(shifts):
                key = np.full(len(fp), c, dtype=np.uint64)
                for s in shift:
                    key = (key << np.uint64(8)) | ((fp >> s) & np.uint64(255))
                keys[c] = key
            n = len(_PLACES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(fp.view(np.int64), n)), pa.array(np.tile(rep, n))],
                names=["key", "fp", "rep"],
            )


def _rest_bits(key: int, fp: np.ndarray) -> np.ndarray:
    """The 24 bits that a list leaves open."""
    open_places = [p for p in range(8) if p not in _PLACES[key >> 40]]
    out = np.zeros(len(fp), dtype=np.uint32)
    for p in open_places:
        out = (out << np.uint32(8)) | ((fp >> np.uint64(8 * p)) & np.uint64(255)).astype(np.uint32)
    return out


def _flips() -> np.ndarray:
    masks = [0]
    for k in range(1, MAX_BITS + 1):
        masks += [sum(1 << b for b in bits) for bits in itertools.combinations(range(24), k)]
    return np.array(masks, dtype=np.uint32)


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally of a pair: how many of the eight positional bytes the fingerprints share."""
    return ((a ^ b).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs reach the guaranteed minimum of shared bytes and differ in few enough bits."""
    out = shared_bytes(a, b) >= 8 - MAX_BITS
    out[out] = np.bitwise_count(a[out] ^ b[out]) <= MAX_BITS
    return out


def _forest(rest: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of the values at a distance of MAX_BITS or less.

    Each unvisited value is expanded once: against all others while the run is small, else by looking up
    the 2,324 values at that distance, so the work stays linear in a long run.
    """
    n = len(rest)
    links: list[tuple[int, int]] = []
    if n <= 4096:
        left = np.arange(n)
        while len(left):
            frontier, left = [int(left[0])], left[1:]
            while frontier and len(left):
                u = frontier.pop()
                near = np.bitwise_count(rest[left] ^ rest[u]) <= MAX_BITS
                links += [(u, int(v)) for v in left[near]]
                frontier += left[near].tolist()
                left = left[~near]
        return links
    order = np.argsort(rest, kind="stable")
    values, masks = rest[order], _flips()
    seen = np.zeros(n, dtype=bool)
    for first in range(n):
        if seen[first]:
            continue
        seen[first] = True
        frontier = [first]
        while frontier:
            u = frontier.pop()
            wanted = values[u] ^ masks
            at = np.searchsorted(values, wanted)
            at = at[(at < n) & (values[np.minimum(at, n - 1)] == wanted)]
            at = at[~seen[at]]
            seen[at] = True
            links += [(int(order[u]), int(order[v])) for v in at]
            frontier += at.tolist()
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists' spanning links, from rows sorted by key."""
    held: tuple[np.ndarray, ...] | None = None

    def emit(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        near = two[_verified(fp[two], fp[two + 1])]
        a, b = [rep[near]], [rep[near + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            pairs = _forest(_rest_bits(int(key[s]), fp[s : s + n]))
            if pairs:
                got = rep[s : s + n][np.array(pairs)]
                a.append(got[:, 0])
                b.append(got[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

    for batch in batches:
        cols = tuple(batch.column(c).to_numpy() for c in ("key", "fp", "rep"))
        if held is not None:
            cols = tuple(np.concatenate(x) for x in zip(held, cols, strict=True))
        if not len(cols[0]):
            continue
        whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last run may go on
        held = tuple(c[whole:] for c in cols)
        if whole and (out := emit(cols[0][:whole], cols[1][:whole].view(np.uint64), cols[2][:whole])):
            yield out
    if held is not None and len(held[0]) and (out := emit(held[0], held[1].view(np.uint64), held[2])):
        yield out


def _of_one_id(named: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): links between the fingerprints, by their smallest ids, of documents that have several."""
    several = named.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x < y").select("doc_id")
    each = named.select("doc_id", "fp").join(several, "doc_id").distinct()
    reps = cut(meet(each, ["fp"], groups, ["rep"]))
    least = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return reps.join(least, "doc_id").where("rep <> a").select(F.col("rep").alias("b"), "a").select("a", "b")


def _labelled(known: DataFrame) -> DataFrame:
    """The rows of ``known`` (doc_id, fp and more) that have a doc_id, with their component_id."""
    spark = known.sparkSession
    share = 4 * shuffle_width(spark)
    named = known.where("doc_id is not null")
    total = named.count()
    groups = cut(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), (F.count("*") * share > total).alias("common")))
    lists = (
        groups.mapInArrow(_postings, "key long, fp long, rep long")
        .repartition(shuffle_width(spark), "key")
        .sortWithinPartitions("key")
    )
    links = lists.mapInArrow(_links, "a long, b long").unionByName(_of_one_id(named, groups)).distinct()
    member = components(links)  # (node, component)
    labelled = groups.join(member, groups.rep == member.node, "left").select(
        "fp", "common", F.coalesce("component", "rep").alias("component_id")
    )
    return meet(named, ["fp"], cut(labelled), ["component_id"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    known = cut(fingerprints(docs))
    rest = known.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long"))
    return _labelled(known).unionByName(rest).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but the smallest doc_id of each component; rows without doc_id stay.

    Of rows of one doc_id and fingerprint the one with the least hash of its text stays, of rows equal in
    text that with the least hash of all columns (but nested ones), so the order of rows does not matter. If
    that doc_id has texts of other fingerprints, one of each stays, and no text is lost to a different one.
    """
    flat = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "struct", "array", "variant"))]
    tag, whole = F.xxhash64(F.col("text").cast("string")), F.xxhash64(*flat)
    known = cut(fingerprints(docs, tag, whole))
    least = F.min(F.struct("mark0", "mark1")).alias("least")
    kept = _labelled(known).where("doc_id = component_id").groupBy("doc_id", "fp").agg(least).select(F.col("doc_id").alias("id"), "least.*").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), tag.alias("tag"), whole.alias("whole")).where("key is not null")
    met = rows.join(kept, (F.col("key") == F.col("id")) & (F.col("tag") == F.col("mark0")) & (F.col("whole") == F.col("mark1")), "left_semi")
    named = met.dropDuplicates(["key", "tag", "whole"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return named.unionByName(docs.where("doc_id is null"))
