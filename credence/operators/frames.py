"""Sets of known names as bit masks: unions merge in any order, and take a number for each 64 names.

A vocabulary (name, index) numbers the names from 0. A frame is an array of longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.operators.ranges import point_in_interval


def vocabulary(rows: DataFrame, name: str) -> DataFrame:
    """(name, index): the distinct names in order; as many rows as names, numbered in one task."""
    names = rows.select(F.col(name).alias("name")).where("name is not null").distinct()
    return names.withColumn("index", F.row_number().over(Window.orderBy("name")) - 1)


def words(size: int) -> int:
    return max(1, -(-size // 64))


def collect(index: Column, width: int) -> list[Column]:
    """Aggregates ``__w0``, ``__w1``, ... of the bits of an index; null indexes add nothing."""
    bit = lambda w: F.when((index / 64).cast("int") == w, F.call_function("shiftleft", F.lit(1).cast("long"), (index % 64).cast("int"))).otherwise(F.lit(0).cast("long"))
    return [F.bit_or(bit(w)).alias(f"__w{w}") for w in range(width)]


def collected(width: int) -> Column:
    return F.array(*[F.coalesce(F.col(f"__w{w}"), F.lit(0).cast("long")) for w in range(width)])


def unite(frame: Column, width: int) -> list[Column]:
    """Aggregates of the union of frames."""
    return [F.bit_or(frame[w]).alias(f"__w{w}") for w in range(width)]


def without(a: Column, b: Column) -> Column:
    """The names of a that are not in b."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def everything(n: Column, width: int) -> Column:
    """The frame of the first n names."""
    def word(left: Column) -> Column:
        return F.when(left >= 64, F.lit(-1)).when(left > 0, F.call_function("shiftleft", F.lit(1).cast("long"), left.cast("int")) - 1).otherwise(F.lit(0)).cast("long")

    return F.array(*[word(n - 64 * w) for w in range(width)])


def size(frame: Column) -> Column:
    return F.aggregate(frame, F.lit(0), lambda n, x: n + F.bit_count(x))


def is_empty(frame: Column) -> Column:
    return ~F.exists(frame, lambda x: x != 0)


def members(frame: Column, names: Column) -> Column:
    """The names, out of an array in the order of their indexes, whose bits are set."""
    marked = F.transform(names, lambda x, i: F.struct(x.alias("x"), F.element_at(frame, (i / 64).cast("int") + 1).alias("w"), (i % 64).cast("int").alias("b")))
    return F.transform(F.filter(marked, lambda s: F.getbit(s["w"], s["b"]) == 1), lambda s: s["x"])


def gated(points: DataFrame, modes: DataFrame, carriers: DataFrame, key: str, point: str, width: float) -> DataFrame:
    """key, radars, carriers, used_fallback: the frames that a measured point leaves open.

    ``modes`` (radar_id, klo, khi) around the point give radars, and those their ``carriers`` (radar_id, carrier_id). A
    point without a mode, or whose radars no carrier has, leaves all radars and carriers open. Radars and carriers are
    the catalogue's, so both are broadcast; a point's hits are gathered by bits, and no set is expanded.
    """
    radar, carrier = (vocabulary(rows, c) for rows, c in ((modes.select("radar_id").unionByName(carriers.select("radar_id")), "radar_id"), (carriers, "carrier_id")))
    n_radar, n_carrier = radar.count(), carrier.count()
    w_radar, w_carrier = words(n_radar), words(n_carrier)
    own = carriers.join(F.broadcast(carrier), carriers.carrier_id == carrier.name).groupBy("radar_id").agg(*collect(F.col("index"), w_carrier)).select("radar_id", collected(w_carrier).alias("c"))
    # A row for each radar that has a mode or a carrier.
    index = radar.withColumnRenamed("name", "radar_id").join(own, "radar_id", "left").select("radar_id", "index", "c")
    hits = point_in_interval(points.select(key, point), modes.select("radar_id", "klo", "khi"), point, "klo", "khi", width).join(F.broadcast(index), "radar_id")
    bits = [c.alias(c_name) for c, c_name in zip(collect(F.col("index"), w_radar), [f"__r{w}" for w in range(w_radar)], strict=True)]
    seen = hits.groupBy(key).agg(*bits, *unite(F.col("c"), w_carrier)).select(
        F.col(key).alias("__key"), F.array(*[f"__r{w}" for w in range(w_radar)]).alias("__r"), collected(w_carrier).alias("__c"),
    )
    has_mode = F.broadcast(modes.select("radar_id").distinct().join(radar, modes.radar_id == radar.name).agg(*collect(F.col("index"), w_radar)).select(collected(w_radar).alias("all_radars")))
    met = points.select(key).join(seen, F.col(key) == F.col("__key"), "left").crossJoin(has_mode)
    none = F.col("__c").isNull() | is_empty(F.col("__c"))
    return met.select(
        key, F.when(none, F.col("all_radars")).otherwise(F.col("__r")).alias("radars"), F.when(none, everything(F.lit(n_carrier), w_carrier)).otherwise(F.col("__c")).alias("carriers"), none.alias("used_fallback")
    )


def listing(names: DataFrame) -> DataFrame:
    """One row: ``names`` of a vocabulary, in order."""
    return names.agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "name"))), lambda x: x["name"]).alias("names"))
