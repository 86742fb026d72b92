"""The knowledge graph out of tables of radars, modes and carriers, and the rows and dimensions made from it.

The tables are parameters: ``radars`` (name, band, antenna), ``modes`` (radar, name and nominal values, see
``NOMINAL``) and ``aircraft`` (family, variant, role, generation, radar, limits, operators, tags).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions import scores as S

#: A mode's nominal property, the unit in the names of its bounds, whether it is a whole number.
NOMINAL = (
    ("centre_frequency", "ghz", False), ("bandwidth", "mhz", False), ("detection_range", "km", True), ("pulse_width", "us", False), ("duty_cycle", "", False),
    ("coherent_processing_interval", "ms", False), ("dwell_time", "ms", False), ("azimuth_coverage", "deg", True), ("elevation_coverage", "deg", True),
    ("range_resolution", "m", False), ("velocity_resolution", "mps", False), ("instrumented_range", "km", True), ("peak_power", "kw", False),
    ("average_power", "kw", False), ("noise_figure", "db", False), ("probability_of_detection", "", False), ("false_alarm_rate", "", False),
)
#: Properties of a carrier's node.
CARRIER = ("family", "variant", "role", "generation", "max_speed_mach", "service_ceiling_m", "combat_radius_km", "ferry_range_km", "hardpoints", "tags")


def ident(kind: str, *names: str | Column) -> Column:
    """"kind:name", or "kind:name:name", of slugs."""
    parts = [S.slug(F.col(n) if isinstance(n, str) else n) for n in names]
    return F.concat_ws(":", F.lit(kind), *parts)


def mode_properties(modes: DataFrame) -> Column:
    """A struct of a mode's properties: bounds around nominal values; those of the repetition frequency and capacity as they are."""
    cols = [F.col(c) for c in ("name", "waveform", "scan_type") if c in modes.columns]
    for stem, unit, whole in NOMINAL:
        nominal = "_".join(x for x in (stem, unit) if x)
        if nominal not in modes.columns:
            continue
        low, high = S.numeric_range(F.col(nominal).cast("double"), S.SPREADS.get(stem, 0.10), 0.0, 1.0 if stem == "probability_of_detection" else None, whole)
        for side, x in (("min", low), ("max", high)):
            cols.append((x if whole else F.round(x, 6)).alias("_".join(p for p in (stem, side, unit) if p)))
    cols += [F.col(c) for c in ("prf_min_hz", "prf_max_hz", "notes") if c in modes.columns]
    if "track_capacity" in modes.columns:
        cols += [F.col("track_capacity").alias(f"track_capacity_{side}") for side in ("min", "max")]
    return F.struct(*cols)


def generate_graph(radars: DataFrame, modes: DataFrame, aircraft: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, properties as JSON text) and edges (source, relation, target), each once.

    An id that stands twice keeps the least of its properties; families and operators have the same ones.
    """
    def node(rows: DataFrame, label: str, at: Column, properties: Column) -> DataFrame:
        return rows.select(at.alias("id"), F.lit(label).alias("label"), F.to_json(properties).alias("properties"))

    radar, mode, carrier = ident("radar", "name"), ident("radar_mode", "radar", "name"), ident("aircraft", "variant")
    known = [c for c in CARRIER if c in aircraft.columns]
    operators = aircraft.select("variant", F.explode("operators").alias("operator"))
    nodes = (
        node(radars, "Radar", radar, F.struct("name", "band", "antenna"))
        .unionByName(node(modes, "RadarMode", mode, mode_properties(modes)))
        .unionByName(node(aircraft, "AircraftFamily", ident("aircraft_family", "family"), F.struct(F.col("family").alias("name"))))
        .unionByName(node(aircraft, "AircraftVariant", carrier, F.struct(*known)))
        .unionByName(node(operators, "Operator", ident("operator", "operator"), F.struct(F.col("operator").alias("name"))))
        .groupBy("id").agg(F.min(F.struct("label", "properties")).alias("n")).select("id", "n.*")
    )
    edge = lambda rows, s, r, t: rows.select(s.alias("source"), F.lit(r).alias("relation"), t.alias("target"))
    edges = (
        edge(modes, ident("radar", "radar"), "HAS_MODE", mode)
        .unionByName(edge(aircraft, carrier, "VARIANT_OF", ident("aircraft_family", "family")))
        .unionByName(edge(aircraft, carrier, "USES_RADAR", ident("radar", "radar")))
        .unionByName(edge(operators, ident("operator", "operator"), "OPERATES", carrier))
        .dropDuplicates(["source", "relation", "target"])
    )
    return nodes, edges


def candidate_rows(radars: DataFrame, modes: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Every mode with the carriers that use its radar and their operators, where there are any."""
    own = modes.select(ident("radar_mode", "radar", "name").alias("mode_id"), ident("radar", "radar").alias("radar_id"), mode_properties(modes).alias("mode_props"))
    known = radars.select(ident("radar", "name").alias("radar_id"), F.struct("name", "band", "antenna").alias("radar_props"))
    carrier = aircraft.select(
        ident("radar", "radar").alias("radar_id"), ident("aircraft", "variant").alias("aircraft_id"), F.struct("max_speed_mach", "service_ceiling_m").alias("aircraft_props"), "operators"
    )
    rows = own.join(known, "radar_id").join(carrier, "radar_id", "left")
    return rows.withColumn("operator", F.explode_outer("operators")).withColumn("aircraft_uses_radar", F.col("aircraft_id").isNotNull()).drop("operators")
