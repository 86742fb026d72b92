"""SimHash document fingerprints of 128 bits, by DataFrame functions alone.

Terms are the different words of the lower-cased text, parted by white space; a word that stands a thousand times votes
once, so no line that is repeated outvotes the rest. A term has 128 hashed bits (XXH64 of the term, and XXH64 of that
with a further number); each votes with the term's weight, for or against, and a fingerprint bit is 1 where the votes
for it win. The weight is 1 + floor(log2(N / df)): df is the number of the N texts that have a term of the same one of
``BUCKETS`` hash buckets, counted over all texts, so common words weigh little. The table of weights has ``BUCKETS``
rows at most whatever the corpus, and is the only thing that is broadcast besides slices' edges (below). Votes for two
bits are summed in the halves of one number, so that a row has few enough columns for generated code; a text may have
2^31 / weight different words.

``near`` finds all fingerprints within a Hamming radius by permuted block tables. The bits are cut into radius + spare
blocks; a table for each choice of ``spare`` blocks puts those first, as its key. Two fingerprints within the radius
differ in at most ``radius`` blocks, so they share a key in some table; pairs that share one are verified. Equal
fingerprints are one row of a table.

``with_next`` puts documents in descending order of doc_id and edits the end of each by the beginning of the next. The
order is found on ids alone: ranges between quantiles of the ids, ordered one by one, and joined at their edges. An id
that many rows have is a range of its own, cut again by the hash of the text. Texts are shuffled once, and of each next
text only as much as the edit takes. Votes are summed where text and edit have met, without a further shuffle.

Null and empty texts have no terms; their fingerprint is zero. Rows that repeat both doc_id and text count once, and give
one row; different texts of one doc_id are told apart, and ordered, by a hash of the text. Rows without a doc_id come
after all others. A single document is its own next one. Further columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm._common import cut

BITS = 128
BUCKETS = 1 << 16
SLICES = 256


def terms(text: Column) -> Column:
    """The different words of a text; a blank one, which has no weight, may be among them."""
    return F.array_distinct(F.split(F.lower(text), r"\s+"))


def halves(term: Column) -> list[Column]:
    """128 hashed bits of a term."""
    first = F.xxhash64(term)
    return [first, F.xxhash64(first, F.lit(1))]


def bucket(half: Column) -> Column:
    return half.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def weights(rows: DataFrame) -> DataFrame:
    """(bucket, weight) by the number of texts of ``rows`` that have a term of the bucket."""
    each = rows.select(F.explode(terms(F.col("text"))).alias("term")).where("term <> ''")
    df = each.groupBy(bucket(F.xxhash64("term")).alias("bucket")).agg(F.count("*").alias("df"))
    total = rows.agg(F.count("*").alias("total"))
    ratio = F.expr("total div df")
    # The whole part of a binary logarithm is the number of binary digits less one.
    return df.crossJoin(total).select("bucket", F.length(F.bin(ratio)).cast("long").alias("weight"))  # one row by BUCKETS rows


def vote(word_rows: DataFrame, keys: list[str], kept: dict[str, Column]) -> DataFrame:
    """keys, ``kept`` aggregates, hi and lo of rows (keys, term, weight)."""
    sides = dict(zip(("hi", "lo"), halves(F.col("term")), strict=True))
    rows = word_rows.withColumns({f"__{s}": h for s, h in sides.items()})
    # Bits b and b + 32 of a half, times the weight, in the halves of one number.
    two = lambda s, b: F.shiftrightunsigned(f"__{s}", b).bitwiseAND(F.lit(1 << 32 | 1)) * F.col("weight")
    cells = [F.sum(two(s, b)).alias(f"__{s}{b}") for s in sides for b in range(32)]
    summed = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in kept.items()], F.sum("weight").alias("__all"), *cells)
    return summed.select(*keys, *kept, *[_bits(s).alias(s) for s in sides])


def _bits(side: str) -> Column:
    """The bits that more than half of all weight is for."""
    out = F.lit(0).cast("long")
    for b in range(32):
        low, high = F.col(f"__{side}{b}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"__{side}{b}", 32)
        for votes, at in ((low, b), (high, b + 32)):
            out = out.bitwiseOR(F.shiftleft((2 * votes > F.col("__all")).cast("long"), at))
    return out


def weighed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with their ``words`` apart, as ``term`` with its ``weight``; a blank word weighs nothing."""
    others = [c for c in rows.columns if c != "words"]
    each = rows.select(*others, F.explode("words").alias("term")).withColumn("__b", bucket(F.xxhash64("term")))
    held = F.broadcast(table.select(F.col("bucket").alias("__b"), F.col("weight").alias("__w")))  # BUCKETS rows at most
    weight = F.when(F.col("term") == "", F.lit(0).cast("long")).otherwise(F.coalesce("__w", F.lit(1)))
    return each.join(held, "__b", "left").select(*others, "term", weight.alias("weight"))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def digits(hi: Column, lo: Column) -> Column:
    """32 hexadecimal digits."""
    return F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in (hi, lo)])


def _rows(docs: DataFrame) -> DataFrame:
    """(kd, tag, doc_id, text): kd and tag tell documents apart, null ids too."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("kd"), F.xxhash64(text, doc_id.isNull()).alias("tag"), doc_id.alias("doc_id"), text.alias("text"))


def fingerprints(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(doc_id, tag, hi, lo) of every document; ``table`` holds the weights, those of ``docs`` itself if none is given."""
    rows = _rows(docs)
    table = cut(weights(rows)) if table is None else table
    words = rows.select("kd", "tag", "doc_id", terms(F.col("text")).alias("words"))
    return vote(weighed(words, table), ["kd", "tag"], {"doc_id": F.max("doc_id")}).select("doc_id", "tag", "hi", "lo")


def _order(light: DataFrame) -> DataFrame:
    """(kd, tag, doc_id, n, next_kd, next_tag) of rows (kd, tag, doc_id, n): the next one in descending order of doc_id, the first after the last."""
    marks = [(i + 1) / SLICES for i in range(SLICES - 1)]
    # At most SLICES numbers come to the driver.
    found = light.agg(F.percentile_approx("doc_id", marks, 10_000)).first()[0] or []
    bounds = sorted(set(found))
    often = [b for b in bounds if found.count(b) > 1]
    below = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    own = F.coalesce(F.col("doc_id").isin(often), F.lit(True))
    cutted = light.select(
        "*", F.when(F.col("doc_id").isNull(), -1).otherwise(below).alias("range"), own.cast("int").alias("own"), F.when(own, F.shiftright("tag", 57)).otherwise(F.lit(0)).cast("long").alias("part"),
    )
    slice_ = ["range", "own", "part"]
    at = F.struct("doc_id", "tag", "kd")
    before = F.lag(at).over(Window.partitionBy(*slice_).orderBy(F.asc_nulls_first("doc_id"), "tag"))
    # A row for each slice: SLICES, and 128 for each id that more than 1 / SLICES of all rows have.
    whole = Window.orderBy(*slice_)
    edges = cutted.groupBy(*slice_).agg(F.max(at).alias("last"))
    edges = edges.select(*slice_, F.lag("last").over(whole).alias("edge"), F.last("last").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("wrap"))
    met = cutted.withColumn("before", before).join(F.broadcast(edges), slice_).withColumn("next", F.coalesce("before", "edge", "wrap"))
    return met.select("kd", "tag", "doc_id", "n", F.col("next.kd").alias("next_kd"), F.col("next.tag").alias("next_tag"))


def with_next(docs: DataFrame) -> DataFrame:
    """(kd, tag, doc_id, n, text, edited, next_kd, next_tag): the last third of each text gives way to the beginning of the next document."""
    rows = _rows(docs)
    light = cut(rows.groupBy("kd", "tag").agg(F.max("doc_id").alias("doc_id"), F.max(F.char_length("text")).cast("long").alias("n")))
    order = cut(_order(light))
    # Read twice with the same columns, so both share one shuffle.
    once = rows.select("kd", "tag", "text").dropDuplicates(["kd", "tag"])
    wanted = order.select(F.col("next_kd").alias("kd"), F.col("next_tag").alias("tag"), F.col("kd").alias("to_kd"), F.col("tag").alias("to_tag"), "n")
    third = F.floor(F.col("n") / 3).cast("int")
    heads = once.join(wanted, ["kd", "tag"]).select(F.col("to_kd").alias("kd"), F.col("to_tag").alias("tag"), F.substring("text", F.lit(1), third).alias("head"))
    met = once.join(order, ["kd", "tag"]).join(heads, ["kd", "tag"])
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - third).cast("int")), "head")
    return met.select("kd", "tag", "doc_id", "n", "text", edited.alias("edited"), "next_kd", "next_tag")


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    table = cut(weights(_rows(docs)))
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    # The digest goes along as four numbers, which are aggregated like the others.
    along = {"doc_id": F.col("doc_id"), "n": F.col("n"), "next_kd": F.col("next_kd"), "next_tag": F.col("next_tag")}
    along |= {f"s{i}": F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)}
    both = with_next(docs).select("kd", "tag", *[c.alias(n) for n, c in along.items()], F.posexplode(F.array("text", "edited")).alias("side", "text"))
    words = both.select("kd", "tag", "side", *along, terms(F.col("text")).alias("words"))
    prints = vote(weighed(words, table), ["kd", "tag", "side"], {n: F.max(n) for n in along})
    sides = [F.max(F.when(F.col("side") == k, F.col(h))).alias(f"{h}{k}") for k in (0, 1) for h in ("hi", "lo")]
    known = cut(prints.groupBy("kd", "tag").agg(*[F.max(n).alias(n) for n in along], *sides))
    following = known.select(F.col("kd").alias("next_kd"), F.col("tag").alias("next_tag"), F.col("hi0").alias("next_hi"), F.col("lo0").alias("next_lo"))
    own, edited, after = [(F.col(a), F.col(b)) for a, b in (("hi0", "lo0"), ("hi1", "lo1"), ("next_hi", "next_lo"))]
    return known.join(following, ["next_kd", "next_tag"]).select(
        "doc_id", F.col("n").alias("n_chars"), F.concat(*[F.lpad(F.lower(F.hex(f"s{i}")), 16, "0") for i in range(4)]).alias("edited_sha256"),
        digits(*own).alias("fingerprint"), digits(*edited).alias("edited_fingerprint"), likeness(own, edited).alias("near_edited"), likeness(own, after).alias("near_next"),
    )


def _block(start: int, width: int) -> Column:
    """``width`` bits of hi and lo from ``start`` on, the highest being 0."""
    def part(half: Column, first: int, n: int) -> Column:
        return F.shiftrightunsigned(half, 64 - first - n).bitwiseAND(F.lit((1 << n) - 1))

    if start + width <= 64:
        return part(F.col("hi"), start, width)
    if start >= 64:
        return part(F.col("lo"), start - 64, width)
    over = start + width - 64
    return F.shiftleft(part(F.col("hi"), start, width - over), over).bitwiseOR(part(F.col("lo"), 0, over))


def block_tables(prints: DataFrame, radius: int, spare: int = 2) -> DataFrame:
    """``prints`` (hi, lo and more) once for each permuted table: its number and the blocks that are its key."""
    n = radius + spare
    if not 0 <= radius < BITS // 2 or spare < 1 or n > BITS or -(-BITS // n) > 62:
        raise ValueError("blocks must have 1 to 62 bits")
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [_block(a, b - a) for a, b in itertools.pairwise(edges)]
    keys = [F.struct(F.lit(t).alias("table"), *[blocks[i].alias(f"b{k}") for k, i in enumerate(some)]) for t, some in enumerate(itertools.combinations(range(n), spare))]
    return prints.select("*", F.explode(F.array(*keys)).alias("key"))


def near(prints: DataFrame, radius: int = 3, spare: int = 2, queries: DataFrame | None = None) -> DataFrame:
    """hi, lo, other_hi, other_lo, distance: every two different fingerprints that differ in at most ``radius`` bits.

    Without ``queries`` each pair stands once, the lesser first; with them, hi and lo are theirs and equal fingerprints
    are found too. More ``spare`` blocks make keys longer and tables more: a candidate shares that many blocks.
    """
    once = prints.select("hi", "lo").where("hi is not null and lo is not null").distinct()
    table = block_tables(once, radius, spare)
    asked = table if queries is None else block_tables(queries.select("hi", "lo").where("hi is not null and lo is not null").distinct(), radius, spare)
    others = table.select("key", F.col("hi").alias("other_hi"), F.col("lo").alias("other_lo"))
    found = asked.join(others, "key").withColumn("distance", distance((F.col("hi"), F.col("lo")), (F.col("other_hi"), F.col("other_lo")))).where(F.col("distance") <= radius)
    if queries is None:
        found = found.where(F.struct("hi", "lo") < F.struct("other_hi", "other_lo"))
    return found.select("hi", "lo", "other_hi", "other_lo", "distance").distinct()
