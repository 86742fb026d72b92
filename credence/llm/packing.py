"""Best-fit packing of documents into sequences of several permitted lengths, chosen jointly.

A document is cut into pieces of the largest permitted length and a rest. Within a shard the pieces go,
longest first, into the open bin with the least room that holds them. Where none does, a bin opens at the
permitted size that costs least for each token it can be filled with. A sequence of c tokens costs
``OVERHEAD`` + c + c * c / ``ATTENTION``: a share that every sequence has, its tokens, and the attention
between them, in units of what a token costs the other layers. So a long sequence pays off only for pieces
that need its length or for want of others to fill it. What a bin of size c can be filled with is the piece
itself and, up to the room beside it, the tokens of the pieces yet to come that are no longer than that
room. When all are packed, each bin is cut down to the least permitted size that holds its contents.

The number of shards follows from the numbers of tokens and pieces, and a row's shard is drawn by a digest of its id,
its length and an ordinal among equal ones, so a shard's work and memory are bounded whatever the input: no source,
length, id or missing id can fill one alone, and neither a lost executor nor the order or partitions of the input
change anything. Only ids and lengths are shuffled.

Lengths are tokens of the given vocabulary, unless a column is named. Null and empty texts have length 0
and one piece of length 0 at the start of a bin of its shard. Repeated rows are packed each; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm import token_counts
from credence.llm._common import cut

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
#: Tokens of a sequence at which attention costs as much as the rest of a layer: six times a width of 4,096.
ATTENTION = 24_576
SHARD_TOKENS = 4_000_000
SHARD_PIECES = 100_000


def cost(capacity: int) -> float:
    """What a sequence of so many tokens costs."""
    return OVERHEAD + capacity + capacity * capacity / ATTENTION


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the final capacity of each bin. No piece may exceed the largest capacity."""
    caps = sorted(capacities)
    costs = {c: cost(c) for c in caps}
    top = caps[-1]
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    falling = np.array([sizes[i] for i in order], dtype=np.int64)
    #: Tokens from a place in the order on, and the first place whose piece is no longer than a room.
    rest = np.concatenate([np.cumsum(falling[::-1])[::-1], [0]]).tolist()
    first = np.searchsorted(-falling, -np.arange(top + 1)).tolist()
    rooms: list[list[int]] = [[] for _ in range(top + 1)]  # open bins by the room they have
    mask = 0  # bit r: some open bin has room r
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    filled: list[int] = []
    for at, i in enumerate(order):
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room = min(
                (c for c in caps if c >= size),
                key=lambda c: (costs[c] / max(1, size + min(c - size, rest[max(at + 1, first[c - size])])), c),
            )
            b = len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        rooms[room - size].append(b)
        mask |= 1 << (room - size)
    return bins, offsets, [next(c for c in caps if c >= n) for n in filled]


def _drawn(sized: DataFrame) -> DataFrame:
    """``sized`` (doc_id, length) with a number drawn by a digest of both and an ordinal among equal rows.

    Equal rows can't be told apart in the result, so they are counted and made again, a part of them at a time.
    """
    part = 1000
    counted = sized.groupBy("doc_id", "length").agg(F.count("*").alias("n"))
    parts = counted.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / part))))
    parts = parts.repartition("doc_id", "length", "at")
    each = parts.withColumn("no", F.explode(F.sequence(F.col("at") * part, F.least(F.col("n"), (F.col("at") + 1) * part) - 1)))
    return each.select("doc_id", "length", F.xxhash64("doc_id", "length", "no").alias("draw"))


def pack_documents(
    docs: DataFrame,
    length: str | None = None,
    capacities: tuple[int, ...] = CAPACITIES,
    shard_tokens: int = SHARD_TOKENS,
    shard_pieces: int = SHARD_PIECES,
    model: str = token_counts.MODEL,
) -> DataFrame:
    """doc_id, piece, start, length, shard, bin, offset and capacity of every piece of every row of ``docs``."""
    top = max(capacities)
    sized = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("length"))
        if length
        else token_counts.count_tokens(docs, model=model).select("doc_id", F.col("n_tokens").alias("length"))
    )
    sized = cut(_drawn(sized))
    count = F.greatest(F.lit(1), F.ceil(F.col("length") / top).cast("int"))
    tokens, n = sized.agg(F.sum("length"), F.sum(count)).first()
    shards = max(1, -(-(tokens or 0) // shard_tokens), -(-(n or 0) // shard_pieces))
    pieces = (
        sized.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumn("start", F.col("piece").cast("long") * top)
        .withColumn("length", F.least(F.col("length") - F.col("start"), F.lit(top).cast("long")))
        .withColumn("shard", F.pmod(F.xxhash64("draw", "piece"), F.lit(shards)))
        .drop("draw")
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets, caps = pack(pdf["length"].tolist(), capacities)
        return pdf.assign(bin=bins, offset=offsets, capacity=np.array(caps, dtype=np.int64)[bins])

    return pieces.groupBy("shard").applyInPandas(
        run, "doc_id long, piece int, start long, length long, shard long, bin long, offset long, capacity long"
    )
