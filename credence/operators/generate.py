"""Synthetic observations, tracks and reports.

Draws are digests of (seed, name of the draw, row), so a row's values depend neither on partitions nor on
workers, and another engine can draw the same. The schedule of a track is folded over its switches within its row.

``carriers`` is the catalogue: aircraft_id, variant, family, radar_id, radar, kind ("rotary", "bomber" or
other), vmax (km/h), ceiling (m), operators, and modes with mode_id, mode, waveform, scan and the bounds lo
and hi of the measurements. It is as long as the catalogue, so it is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions.scores import dead_reckoning, iso_utc, r6, slug
from credence.operators.etl import MEASURES

#: Areas of sensors with latitude and longitude, kinds of claims, sources of reports.
AREAS = (
    ("North Sea", 56.25, 2.25), ("Eastern Mediterranean", 34.5, 31.0), ("Baltic Sea", 55.25, 18.5), ("Arabian Gulf", 25.75, 52.75),
    ("South China Sea", 16.5, 114.0), ("Bay of Bengal", 15.0, 88.0), ("Sea of Japan", 39.5, 135.0), ("Western Pacific", 24.0, 145.0),
)
CLAIM_TYPES = ("operator", "aircraft_variant", "aircraft_family", "radar_type", "radar_mode", "location", "relation")
SOURCES = ("sigint_a", "osint_b", "liaison_c", "analyst_d")
SOURCE_TYPES = ("sigint", "osint", "liaison", "analyst_assessment")
#: Relative errors of the seven measurements.
ERRORS = (0.006, 0.08, 0.025, 0.08, 0.08, 0.08, 0.08)
START, END = 1_704_067_200, 1_767_225_600  # 2024 and 2026


def draw(seed: int, name: str, *keys: str | Column) -> Column:
    """Uniform in [0, 1): the first 32 bits of a digest."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(name), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def uniform(low: Column | float, high: Column | float, u: Column) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return low + (high - low) * u


def pick(items: Column, u: Column) -> Column:
    """The entry of an array that a draw falls on; null of an empty one."""
    return F.try_element_at(items, (F.floor(u * F.size(items)) + 1).cast("int"))


def measured(value: Column, relative: float, floor: float) -> Column:
    """value, error, min and max of a measurement."""
    error = F.greatest(F.abs(value) * relative, F.lit(floor))
    return F.struct(r6(value).alias("value"), r6(error).alias("error"), r6(value - error).alias("min"), r6(value + error).alias("max"))


def esm_parameters(mode: Column, u) -> Column:
    """What a sensor measures of a mode: two categories, seven values within its bounds, the repetition interval."""
    values = [uniform(F.element_at(mode["lo"], i + 1), F.element_at(mode["hi"], i + 1), u(f"m{i}")) for i in range(len(MEASURES))]
    cells = [measured(v, e, 1e-9).alias(name) for v, e, (name, *_) in zip(values, ERRORS, MEASURES, strict=True)]
    period = measured(F.try_divide(F.lit(1e6), r6(values[2])), 0.025, 0.0).alias("measured_pulse_repetition_interval_us")
    return F.struct(mode["waveform"].alias("observed_waveform"), mode["scan"].alias("observed_scan_type"), *cells, period)


def location(u) -> Column:
    """An area, a place within a degree and a half of it, and a box of errors of its own height and width."""
    area = pick(F.array(*[F.struct(F.lit(a).alias("area"), F.lit(y).alias("lat"), F.lit(x).alias("lon")) for a, y, x in AREAS]), u("area"))
    lat, lon = area["lat"] + uniform(-1.5, 1.5, u("lat")), area["lon"] + uniform(-1.5, 1.5, u("lon"))
    dy, dx = uniform(0.03, 0.35, u("lat_error")), uniform(0.03, 0.35, u("lon_error"))
    box = F.struct(
        r6(lat - dy).alias("min_latitude_deg"), r6(lat + dy).alias("max_latitude_deg"), r6(lon - dx).alias("min_longitude_deg"), r6(lon + dx).alias("max_longitude_deg")
    )
    return F.struct(area["area"].alias("area"), r6(lat).alias("estimated_latitude_deg"), r6(lon).alias("estimated_longitude_deg"), box.alias("error_box"))


def kinematics(kind: Column, vmax: Column, ceiling: Column, u) -> Column:
    """Speed, altitude and heading with their errors; their ranges depend on the kind of carrier."""
    def by_kind(rotary: Column, bomber: Column, other: Column) -> Column:
        return F.when(kind == "rotary", rotary).when(kind == "bomber", bomber).otherwise(other)

    at_most = lambda x, y: F.least(x, F.lit(float(y)))
    a, b = u("speed"), u("altitude")
    speed = by_kind(uniform(120, at_most(vmax, 310), a), uniform(650, at_most(vmax * 0.9, 1050), a), uniform(450, at_most(vmax * 0.85, 1450), a))
    altitude = by_kind(uniform(100, at_most(ceiling * 0.75, 4500), b), uniform(7000, ceiling * 0.9, b), uniform(1500, ceiling * 0.9, b))
    dv, dh = uniform(25, 140, u("speed_error")), uniform(100, 900, u("altitude_error"))
    r1 = lambda x: F.round(x + 1e-9, 1)
    return F.struct(
        r1(speed).alias("ground_speed_kph"), r1(dv).alias("ground_speed_error_kph"), r1(F.greatest(F.lit(0.0), speed - dv)).alias("ground_speed_min_kph"), r1(speed + dv).alias("ground_speed_max_kph"),
        r1(altitude).alias("altitude_m"), r1(dh).alias("altitude_error_m"), r1(F.greatest(F.lit(0.0), altitude - dh)).alias("altitude_min_m"), r1(F.least(ceiling, altitude + dh)).alias("altitude_max_m"),
        r1(uniform(0, 360, u("heading"))).alias("heading_deg"), r1(uniform(2, 20, u("heading_error"))).alias("heading_error_deg"),
    )


def ambiguous(own: Column, operator: Column, mode: Column, everyone: Column, most: int = 10) -> Column:
    """The first carriers of the catalogue with the same radar, or of the same family unless one target is tracked."""
    near = F.filter(everyone, lambda x: (x["radar_id"] == own["radar_id"]) | ((x["family"] == own["family"]) & (mode != "single_target_track")))
    return F.transform(F.slice(near, 1, most), lambda x: F.struct(
        x["family"].alias("aircraft_family"), x["variant"].alias("aircraft_variant"), x["aircraft_id"].alias("aircraft_id"),
        F.when(F.array_contains(x["operators"], operator), operator).otherwise(F.try_element_at(x["operators"], F.lit(1))).alias("operator"), x["radar"].alias("radar"),
    ))


def catalogue(carriers: DataFrame) -> DataFrame:
    """One row: ``all``, the carriers in the order of their ids, as an array."""
    row = F.struct("aircraft_id", "variant", "family", "radar_id", "radar", "kind", "vmax", "ceiling", "operators", "modes")
    return carriers.agg(F.array_sort(F.collect_list(row)).alias("all"))


def observations(spark: SparkSession, carriers: DataFrame, count: int, seed: int, start: int = START, end: int = END) -> DataFrame:
    """``count`` observations of the document schema: a carrier, one of its operators and modes, measured within the mode's bounds."""
    if count < 1:
        raise ValueError("count must be at least 1")
    if end <= start:
        raise ValueError("the end must lie behind the start")
    u = lambda name: draw(seed, name, "n")
    base = spark.range(1, count + 1).withColumnRenamed("id", "n").crossJoin(F.broadcast(catalogue(carriers)))
    rows = base.withColumn("own", pick(F.col("all"), u("carrier"))).where("own is not null")
    rows = rows.withColumn("operator", pick(F.col("own.operators"), u("operator"))).withColumn("mode", pick(F.col("own.modes"), u("mode")))
    at = F.timestamp_seconds(F.lit(start) + F.floor(u("time") * (end - start)))
    own, mode = F.col("own"), F.col("mode")
    label = _label(own, F.col("operator"), mode["mode"], mode["mode_id"])
    return rows.select(
        F.concat(F.lit("esm_obs_"), number(F.col("n"), 5)).alias("observation_id"),
        F.unix_seconds(at).cast("double").alias("timestamp_unix"), iso_utc(at).alias("timestamp_iso8601"),
        F.struct(F.lit("passive_esm").alias("type"), F.lit("synthetic_ground_or_airborne_collector").alias("platform")).alias("sensor"),
        location(u).alias("estimated_emitter_location"), kinematics(own["kind"], own["vmax"], own["ceiling"], u).alias("approximate_kinematics"),
        esm_parameters(mode, u).alias("esm_radar_parameters"),
        ambiguous(own, F.col("operator"), mode["mode"], F.col("all")).alias("candidate_labels_from_shared_kg_features"), label.alias("ground_truth_label"),
    )


def number(n: Column, width: int) -> Column:
    """Decimal digits, with zeros ahead up to ``width``."""
    return F.format_string(f"%0{width}d", n.cast("long"))


def normal(u, name: str) -> Column:
    """A standard normal draw, out of two uniform ones."""
    return F.sqrt(-2 * F.log(1 - u(f"{name}_radius"))) * F.cos(2 * math.pi * u(f"{name}_angle"))


def switches(steps: Column, modes: Column, share: float, most: int | None, at: Callable[[str, Column], Column]) -> Column:
    """The steps at which a track changes its mode, in order: each but the first with probability ``share``, ``most`` drawn of them at most."""
    if not 0 <= share <= 1:
        raise ValueError("the probability of a switch must lie in [0, 1]")
    if most is not None and most < 0:
        raise ValueError("the cap on switches must not be negative")
    found = F.filter(F.sequence(F.lit(1), steps - 1), lambda i: at("switch", i) < share)
    if most is not None:
        kept = F.slice(F.array_sort(F.transform(found, lambda i: F.struct(at("keep", i).alias("u"), i.alias("i")))), 1, most) if most else F.array().cast("array<struct<u:double,i:int>>")
        found = F.array_sort(F.transform(kept, lambda x: x["i"]))
    return F.when(modes > 1, found).otherwise(F.array().cast("array<int>"))


def stays(shifts: Column, modes: Column, first: Column, at: Callable[[str, Column], Column]) -> Column:
    """The mode of each stay between switches, folded from the first on: a switch moves on by 1 to ``modes - 1`` places, so never to the same mode."""
    start = F.array(first.cast("int"))
    move = lambda held, i: (F.element_at(held, -1) + 1 + F.floor(at("jump", i) * (modes - 1)).cast("int")) % modes
    return F.aggregate(shifts, start, lambda held, i: F.concat(held, F.array(move(held, i))))


def tracks(
    spark: SparkSession, carriers: DataFrame, count: int, seed: int, min_s: float = 1.0, max_s: float = 60.0, step_s: float = 0.5, switch: float = 0.03,
    most: int | None = None, start: int = START, end: int = END,
) -> DataFrame:
    """``count`` tracks: carrier, operator, number of steps, switches, modes of the stays, start, place and kinematics at the start."""
    if count < 1:
        raise ValueError("count must be at least 1")
    if min_s < step_s or max_s < min_s:
        raise ValueError("durations must not be shorter than a step, nor the longest shorter than the shortest")
    if end - start <= max_s:
        raise ValueError("the span of time must be longer than the longest track")
    u = lambda name: draw(seed, name, "n")
    at = lambda name, i: draw(seed, name, "n", i)
    rows = spark.range(1, count + 1).withColumnRenamed("id", "n").crossJoin(F.broadcast(catalogue(carriers)))
    rows = rows.withColumn("own", pick(F.col("all"), u("carrier"))).where("own is not null").withColumn("operator", pick(F.col("own.operators"), u("operator")))
    rows = rows.withColumn("duration", uniform(min_s, max_s, u("duration"))).withColumn("modes", F.size("own.modes"))
    rows = rows.withColumn("steps", F.greatest(F.lit(2), F.round(F.col("duration") / step_s).cast("int") + 1))
    rows = rows.withColumn("shifts", switches(F.col("steps"), F.col("modes"), switch, most, at))
    rows = rows.withColumn("stays", stays(F.col("shifts"), F.col("modes"), F.floor(u("mode") * F.col("modes")), at))
    begin = F.lit(start) + F.floor(u("start") * F.greatest(F.lit(1), F.floor(F.lit(end - start) - F.col("duration"))))
    return rows.select(
        "n", "all", "own", "operator", "steps", "shifts", "stays", begin.cast("long").alias("begin"), F.lit(float(step_s)).alias("step_s"),
        location(u).alias("place"), kinematics(F.col("own.kind"), F.col("own.vmax"), F.col("own.ceiling"), u).alias("base"),
    )


def _label(own: Column, operator: Column, mode: Column, mode_id: Column) -> Column:
    return F.struct(
        own["family"].alias("aircraft_family"), own["variant"].alias("aircraft_variant"), own["aircraft_id"].alias("aircraft_id"), operator.alias("operator"), own["radar"].alias("radar"),
        own["radar_id"].alias("radar_id"), mode.alias("mode"), mode_id.alias("mode_id"),
    )


def series(
    spark: SparkSession, carriers: DataFrame, count: int, seed: int, min_s: float = 1.0, max_s: float = 60.0, step_s: float = 0.5, switch: float = 0.03,
    most: int | None = None, start: int = START, end: int = END, workers: int | None = None,
) -> DataFrame:
    """The observations of ``count`` tracks in the document schema, a row for each: seven measurements of the step's mode, place and kinematics that drift, candidates, truth, ids.

    Speed, altitude and heading drift from those at the start by normal draws times the time gone; the place follows
    them. Everything is drawn by digests and folded within a row, so no state is kept and no worker matters:
    ``workers`` deals the tracks to so many tasks and changes no row.
    """
    if workers is not None and workers < 1:
        raise ValueError("workers must be at least 1")
    made = tracks(spark, carriers, count, seed, min_s, max_s, step_s, switch, most, start, end)
    made = made.repartition(workers, "n") if workers else made
    rows = made.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    u = lambda name: draw(seed, name, "n", "i")
    stay = F.element_at("stays", F.size(F.filter("shifts", lambda s: s <= F.col("i"))) + 1)
    rows = rows.withColumn("mode", F.element_at("own.modes", stay + 1)).withColumn("gone", F.greatest(F.lit(0.0), F.col("i") * F.col("step_s") + uniform(-0.04, 0.04, u("jitter"))))
    gone, base, place, r1 = F.col("gone"), F.col("base"), F.col("place"), lambda x: F.round(x + 1e-9, 1)
    speed = F.greatest(F.lit(0.0), base["ground_speed_kph"] + normal(u, "speed") * 0.6 * gone)
    altitude = F.greatest(F.lit(0.0), base["altitude_m"] + normal(u, "altitude") * 1.8 * gone)
    dv, dh = base["ground_speed_error_kph"], base["altitude_error_m"]
    moved = F.struct(
        r1(speed).alias("ground_speed_kph"), dv.alias("ground_speed_error_kph"), r1(F.greatest(F.lit(0.0), speed - dv)).alias("ground_speed_min_kph"), r1(speed + dv).alias("ground_speed_max_kph"),
        r1(altitude).alias("altitude_m"), dh.alias("altitude_error_m"), r1(F.greatest(F.lit(0.0), altitude - dh)).alias("altitude_min_m"), r1(altitude + dh).alias("altitude_max_m"),
        r1(F.pmod(base["heading_deg"] + normal(u, "heading") * 0.04 * gone, F.lit(360.0))).alias("heading_deg"), base["heading_error_deg"].alias("heading_error_deg"),
    )
    rows = rows.withColumn("kin", moved)
    lat, lon = dead_reckoning(place["estimated_latitude_deg"], place["estimated_longitude_deg"], F.col("kin.heading_deg"), F.col("kin.ground_speed_kph"), gone)
    box = place["error_box"]
    dy, dx = ((box[f"max_{k}_deg"] - box[f"min_{k}_deg"]) / 2 for k in ("latitude", "longitude"))
    where = F.struct(
        place["area"].alias("area"), r6(lat).alias("estimated_latitude_deg"), r6(lon).alias("estimated_longitude_deg"),
        F.struct(r6(lat - dy).alias("min_latitude_deg"), r6(lat + dy).alias("max_latitude_deg"), r6(lon - dx).alias("min_longitude_deg"), r6(lon + dx).alias("max_longitude_deg")).alias("error_box"),
    )
    micros = F.col("begin") * 1_000_000 + F.round(gone * 1e6).cast("long")
    series_id, own, mode = F.concat(F.lit("esm_series_"), number(F.col("n"), 5)), F.col("own"), F.col("mode")
    return rows.select(
        F.concat(series_id, F.lit("_obs_"), number(F.col("i") + 1, 3)).alias("observation_id"), series_id.alias("series_id"), F.col("i").alias("sequence_index"), F.round(gone + 1e-9, 3).alias("elapsed_time_s"),
        (micros / 1e6).alias("timestamp_unix"), iso_utc(F.timestamp_micros(micros)).alias("timestamp_iso8601"),
        F.struct(F.lit("passive_esm").alias("type"), F.lit("synthetic_ground_or_airborne_collector").alias("platform")).alias("sensor"),
        where.alias("estimated_emitter_location"), F.col("kin").alias("approximate_kinematics"), esm_parameters(mode, u).alias("esm_radar_parameters"),
        ambiguous(own, F.col("operator"), mode["mode"], F.col("all")).alias("candidate_labels_from_shared_kg_features"),
        _label(own, F.col("operator"), mode["mode"], mode["mode_id"]).alias("ground_truth_label"),
    )


def series_documents(found: DataFrame, step_s: float = 0.5) -> DataFrame:
    """One row for each series with its observations nested, in order, and the truth of the whole track: its modes, and where they shift.

    A series is one group, as long as its track. ``found`` may carry reports.
    """
    row = F.struct(F.col("sequence_index").alias("_at"), F.struct(*[c for c in found.columns]).alias("o"))
    lists = found.groupBy("series_id").agg(F.collect_list(row).alias("r"))
    ordered = F.transform(F.array_sort("r", lambda a, b: a["_at"] - b["_at"]), lambda x: x["o"])
    rows = lists.select("series_id", ordered.alias("observations"))
    o = F.col("observations")
    mode = lambda i: o[i]["ground_truth_label"]["mode_id"]
    steps = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: (i > 0) & ~mode(F.greatest(i - 1, F.lit(0))).eqNullSafe(mode(i)))
    rows = rows.withColumn("shifts", steps)
    first = F.col("observations")[0]["ground_truth_label"]
    many = F.size("shifts") > 0
    whole = first.withField("mode", F.when(many, "multiple").otherwise(first["mode"])).withField("mode_id", F.when(many, "multiple").otherwise(first["mode_id"]))
    plan = F.transform("observations", lambda x: F.struct(x["sequence_index"].alias("sequence_index"), x["ground_truth_label"]["mode"].alias("mode"), x["ground_truth_label"]["mode_id"].alias("mode_id")))
    return rows.select(
        "series_id", F.lit("aircraft").alias("emitter_type"), F.lit(float(step_s)).alias("sample_interval_s"),
        F.round(F.element_at("observations", -1)["elapsed_time_s"] - F.col("observations")[0]["elapsed_time_s"], 3).alias("duration_s"), F.size("observations").alias("observation_count"),
        F.col("shifts").alias("mode_shift_sequence_indices"), F.get("shifts", F.lit(0)).alias("mode_shift_sequence_index"), plan.alias("ground_truth_mode_sequence"), whole.alias("ground_truth_track_label"), "observations",
    )


def claim_value(kind: Column, right: Column, found, everyone: Column, u) -> Column:
    """object_id, object_value and object_kind of a claim: the truth's, or another carrier's, radar's, operator's or area's."""
    truth, where = found["ground_truth_label"], found["estimated_emitter_location"]["area"]
    other = pick(F.filter(everyone, lambda x: ~x["aircraft_id"].eqNullSafe(truth["aircraft_id"])), u("other"))
    strange = pick(F.filter(everyone, lambda x: ~x["radar_id"].eqNullSafe(truth["radar_id"])), u("radar"))
    mode = pick(strange["modes"], u("mode"))
    operators = F.array_sort(F.array_distinct(F.flatten(F.transform(everyone, lambda x: x["operators"]))))
    operator = pick(F.filter(operators, lambda x: ~x.eqNullSafe(truth["operator"])), u("operator"))
    area = pick(F.filter(F.array(*[F.lit(a) for a, *_ in AREAS]), lambda x: ~x.eqNullSafe(where)), u("area"))
    choose = lambda a, b: F.when(right, a).otherwise(b)
    known = choose(F.coalesce(where, F.lit("unknown area")), area)
    family, carrier = choose(truth["aircraft_family"], other["family"]), choose(truth["aircraft_id"], other["aircraft_id"])
    variant, radar_id = choose(truth["aircraft_variant"], other["variant"]), choose(truth["radar_id"], strange["radar_id"])
    radar, acting = choose(truth["radar"], strange["radar"]), choose(truth["operator"], operator)
    cells = {
        "operator": (acting, acting, "operator"), "aircraft_variant": (carrier, variant, "aircraft_variant"),
        "aircraft_family": (F.concat(F.lit("aircraft_family:"), slug(family)), family, "aircraft_family"), "radar_type": (radar_id, radar, "radar"),
        "radar_mode": (choose(truth["mode_id"], mode["mode_id"]), choose(truth["mode"], mode["mode"]), "radar_mode"), "location": (F.concat(F.lit("area:"), slug(known)), known, "area"),
        "relation": (F.concat(F.lit("relation:"), carrier, F.lit(":USES_RADAR:"), radar_id), F.concat(variant, F.lit(" uses "), radar), "relation_hypothesis"),
    }
    out = []
    for k, name in enumerate(("object_id", "object_value", "object_kind")):
        cell = F.raise_error(F.concat(F.lit("no such kind of claim: "), kind)).cast("string")
        for c in reversed(CLAIM_TYPES):
            value = cells[c][k]
            cell = F.when(kind == c, F.lit(value) if isinstance(value, str) else value).otherwise(cell)
        out.append(cell.alias(name))
    return F.struct(*out)


def reports(found: DataFrame, carriers: DataFrame, seed: int, least: int = 10, most: int = 12, count: Column | None = None) -> DataFrame:
    """Reports about observations, each with one claim, right or wrong, for or against.

    ``count`` gives the number of an observation's reports, else it is drawn from ``least`` to ``most``. The
    second and the sixth are always wrong. An observation without a truth is an error.
    """
    if least < 1 or most < least:
        raise ValueError("the bounds on reports must be positive and in order")
    n = count if count is not None else (F.floor(draw(seed, "reports", "observation_id") * (most - least + 1)) + least).cast("int")
    truth = F.col("ground_truth_label")
    checked = F.when(truth.isNull(), F.raise_error(F.lit("reports need the truth of their observation")).cast("int")).otherwise(n)
    series = F.col("series_id") if "series_id" in found.columns else F.lit(None).cast("string")
    base = found.withColumn("series_id", series.cast("string")).withColumn("__n", checked).where("__n > 0").crossJoin(F.broadcast(catalogue(carriers)))
    rows = base.withColumn("no", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    u = lambda name: draw(seed, name, "observation_id", "no")
    kind = F.element_at(F.array(*[F.lit(c) for c in CLAIM_TYPES]), F.col("no") % len(CLAIM_TYPES) + 1)
    right = (u("right") < 0.72) & ~F.col("no").isin(1, 5)
    rows = rows.withColumn("kind", kind).withColumn("right", right).withColumn("against", u("stance") <= 0.12)
    found_cols = {c: F.col(c) for c in ("ground_truth_label", "estimated_emitter_location")}
    rows = rows.withColumn("v", claim_value(F.col("kind"), F.col("right"), found_cols, F.col("all"), u))
    stance = F.when(F.col("against"), "refutes").otherwise("supports")
    by_truth = lambda a, b, name: r6(F.when(F.col("right"), uniform(*a, u(name))).otherwise(uniform(*b, u(name))))
    number = F.lpad((F.col("no") + 1).cast("string"), 2, "0")
    seconds = lambda x: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(x, 3).cast("decimal(18,6)"))
    collected = F.try_to_timestamp("timestamp_iso8601") + seconds(uniform(-1800, 900, u("collected")))
    published = collected + seconds(uniform(30, 900, u("published")))
    claim = F.struct(
        F.concat(F.lit("intel_claim:"), "observation_id", F.lit(":"), number).alias("claim_id"), F.col("kind").alias("claim_type"), stance.alias("stance"),
        F.col("observation_id").alias("subject_id"), F.when(F.col("against"), "REFUTES").otherwise("SUPPORTS").alias("predicate"), "v.object_id", "v.object_value", "v.object_kind",
        F.concat(F.initcap(stance), F.lit(" "), F.replace(F.col("kind"), F.lit("_"), F.lit(" ")), F.lit(" assessment: "), F.col("v.object_value"), F.lit(".")).alias("claim_text"),
        by_truth((0.60, 0.92), (0.35, 0.82), "confidence").alias("claim_confidence"), r6(uniform(0.70, 0.98, u("extraction"))).alias("extraction_confidence"),
        r6(uniform(0.55, 0.95, u("specificity"))).alias("specificity_score"), by_truth((0.70, 0.98), (0.15, 0.70), "consistency").alias("kg_consistency_score"),
        F.when(F.col("right"), "correct").otherwise("contradictory").alias("synthetic_truth_value"),
    )
    one = lambda key, value: F.map_from_arrays(F.array(F.coalesce(key, F.lit("unknown"))), F.array(F.lit(value)))
    context = F.struct(
        one(truth["operator"], 0.75).alias("operator_priors"), one(F.concat(F.lit("aircraft_family:"), slug(truth["aircraft_family"])), 0.70).alias("aircraft_family_priors"),
        one(truth["radar_id"], 0.70).alias("radar_type_priors"), one(truth["mode_id"], 0.65).alias("radar_mode_priors"),
    )
    return rows.select(
        F.concat(F.lit("intel_report:"), "observation_id", F.lit(":"), number).alias("report_id"), "observation_id", "series_id",
        F.concat(F.lit("source:"), pick(F.array(*[F.lit(x) for x in SOURCES]), u("source"))).alias("source_id"), pick(F.array(*[F.lit(x) for x in SOURCE_TYPES]), u("type")).alias("source_type"),
        iso_utc(published).alias("published_at"), iso_utc(collected).alias("collected_at"), iso_utc(published + seconds(uniform(5, 120, u("ingested")))).alias("ingested_at"),
        by_truth((0.62, 0.95), (0.25, 0.78), "credibility").alias("credibility_score"), context.alias("external_context"), F.array(claim).alias("claims"),
    )


def budgets(found: DataFrame, seed: int, least: int, most: int) -> DataFrame:
    """``found`` with ``reports_left_to_it``: each series' drawn total, dealt to its observations in order.

    Each but the last takes a draw of what is left, the last takes the rest. A series is one group, as long as
    its track.
    """
    if least < 0 or most < least:
        raise ValueError("the bounds on reports of a series must not be negative and be in order")
    total = F.floor(draw(seed, "budget", "series_id") * (most - least + 1)) + least
    ids = found.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("sequence_index", "observation_id"))).alias("o"))
    empty = F.array().cast("array<struct<observation_id:string,n:bigint>>")

    def step(state: Column, at: Column) -> Column:
        share = F.floor(draw(seed, "share", at["observation_id"]) * (state["left"] + 1))
        taken = F.when(F.size(state["out"]) + 1 == state["size"], state["left"]).otherwise(share)
        return F.struct((state["left"] - taken).alias("left"), state["size"].alias("size"), F.concat(state["out"], F.array(F.struct(at["observation_id"].alias("observation_id"), taken.alias("n")))).alias("out"))

    start = F.struct(total.alias("left"), F.size("o").alias("size"), empty.alias("out"))
    dealt = ids.select(F.explode(F.aggregate("o", start, step)["out"]).alias("d")).select("d.observation_id", F.col("d.n").cast("int").alias("reports_left_to_it"))
    return found.join(dealt, "observation_id")


def with_reports(found: DataFrame, carriers: DataFrame, seed: int, least: int = 10, most: int = 12, series_bounds: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """``found`` with ``intelligence_reports``: by bounds for each observation, or by a budget for each series; none is an empty list."""
    if (series_bounds[0] is None) != (series_bounds[1] is None):
        raise ValueError("a series needs both bounds or none")
    if series_bounds[0] is None:
        made = reports(found, carriers, seed, least, most)
    else:
        made = reports(budgets(found, seed, *series_bounds), carriers, seed, count=F.col("reports_left_to_it"))
    lists = made.groupBy("observation_id").agg(F.array_sort(F.collect_list(F.struct("report_id", *[c for c in made.columns if c != "report_id"])), lambda a, b: F.when(a["report_id"] < b["report_id"], -1).otherwise(1)).alias("r"))
    own = found.drop("intelligence_reports").join(lists, "observation_id", "left")
    return own.withColumn("intelligence_reports", F.coalesce("r", F.array().cast(lists.schema["r"].dataType))).drop("r")
