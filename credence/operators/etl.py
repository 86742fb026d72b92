"""Observations scored against rows of the knowledge graph, and the tables of evidence that follow.

Observations and rows come as flat tables: seven measured intervals (lo0, hi0 to lo6, hi6), seven of a mode
(klo0, khi0 and so on), two categories, and what carriers and operators add. ``flat_observations`` and
``flat_rows`` make them from documents. Rows of the graph are bounded by its modes, carriers and operators,
so they are broadcast.

Modes are scored, not their rows, and pairs are scored twice: an aggregation gives what an observation's k-th best row
reaches at least, and only modes that can reach it with their best carrier and operator meet their rows. So pairs are never
sorted or shuffled. Ties go to the row that comes first in the graph's order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions import scores as S

K = 5
MIN_DELTA = 0.05
#: A measurement of an observation; stem and unit of the mode's bounds; the name of the residual.
MEASURES = (
    ("measured_centre_frequency_ghz", "centre_frequency", "ghz", "center_frequency_residual"),
    ("measured_bandwidth_mhz", "bandwidth", "mhz", "bandwidth_residual"),
    ("measured_prf_hz", "prf", "hz", "prf_residual"),
    ("measured_pulse_width_us", "pulse_width", "us", "pulse_width_residual"),
    ("measured_duty_cycle", "duty_cycle", "", "duty_cycle_residual"),
    ("measured_coherent_processing_interval_ms", "coherent_processing_interval", "ms", "coherent_processing_interval_residual"),
    ("measured_dwell_time_ms", "dwell_time", "ms", "dwell_time_residual"),
)
N = len(MEASURES)
MACH_KPH = 1060.0
NAMES = ("mode_id", "radar_id", "aircraft_id", "operator")


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def flat_observations(documents: DataFrame) -> DataFrame:
    """Observations of the document schema with what scoring reads in flat columns; the truth is kept apart in ``truth``."""
    esm, kin, context = "esm_radar_parameters", "approximate_kinematics", F.col("external_context")
    cols = [F.col(c) for c in ("observation_id", "series_id", "sequence_index", "elapsed_time_s", "timestamp_iso8601")]
    widths = []
    for i, (name, *_) in enumerate(MEASURES):
        m = F.col(f"{esm}.{name}")
        lo, hi = S.measurement_interval(m["value"], m["error"], m["min"], m["max"])
        cols += [F.least(lo, hi).alias(f"lo{i}"), F.greatest(lo, hi).alias(f"hi{i}")]
        widths.append(F.coalesce(F.abs(m["max"] - m["min"]), F.lit(0.0)))
    period = F.col(f"{esm}.measured_pulse_repetition_interval_us")
    widths.append(F.coalesce(F.abs(period["max"] - period["min"]), F.lit(0.0)))
    one, several = F.try_variant_get(context["operator"], "$", "string"), F.try_variant_get(context["operator"], "$", "array<string>")
    return documents.select(
        *cols,
        F.col(f"{esm}.observed_waveform").alias("waveform"),
        F.col(f"{esm}.observed_scan_type").alias("scan"),
        F.coalesce(F.col(f"{kin}.ground_speed_max_kph"), F.col(f"{kin}.ground_speed_kph"), F.lit(0.0)).alias("speed"),
        F.coalesce(F.col(f"{kin}.altitude_max_m"), F.col(f"{kin}.altitude_m"), F.lit(0.0)).alias("height"),
        S.r6(_sum(widths)).alias("width"),
        context["operator_priors"].alias("priors"),
        F.try_element_at(context["priors"], F.lit("operator")).alias("more_priors"),
        F.coalesce(several, F.when(one.isNotNull(), F.array(one))).alias("named"),
        F.col("ground_truth_label").alias("truth"),
    )


def flat_rows(rows: DataFrame) -> DataFrame:
    """Rows of mode, radar, carrier and operator, numbered in their order, with properties in flat columns; null for those that the struct lacks."""
    known_props, carrier = rows.schema["mode_props"].dataType.names, F.col("aircraft_props")
    props = lambda name, kind: (F.col("mode_props")[name] if name in known_props else F.lit(None)).cast(kind)
    cols = []
    for i, (_, stem, unit, _) in enumerate(MEASURES):
        lo, hi = (props("_".join(x for x in (stem, side, unit) if x), "double") for side in ("min", "max"))
        known = lo.isNotNull() & hi.isNotNull()
        cols += [F.when(known, F.least(lo, hi)).alias(f"klo{i}"), F.when(known, F.greatest(lo, hi)).alias(f"khi{i}")]
    # Modes times carriers times operators: one task numbers them.
    order = Window.orderBy("mode_id", F.coalesce("aircraft_id", F.lit("")), F.coalesce("operator", F.lit("")))
    return rows.select(
        *NAMES, *cols, props("waveform", "string").alias("mode_waveform"), props("scan_type", "string").alias("mode_scan"),
        carrier.isNotNull().alias("has_props"), (F.coalesce(carrier["max_speed_mach"], F.lit(0.0)) * MACH_KPH).alias("speed_limit"),
        F.coalesce(carrier["service_ceiling_m"], F.lit(0.0)).cast("double").alias("ceiling"),
        F.when(F.col("aircraft_id").isNull(), 0.5).when(F.col("aircraft_uses_radar"), 1.0).when(F.col("aircraft_uses_radar").isNotNull(), 0.0)
        .when(F.col("radar_id").isNotNull(), 1.0).otherwise(0.5).alias("link"),
        F.row_number().over(order).alias("row"),
    )


def field_scores() -> list[Column]:
    """Scores of the nine fields; null where either side lacks it."""
    out = [S.interval_overlap(F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"klo{i}"), F.col(f"khi{i}"), ordered=True) for i in range(N)]
    return out + [(F.col(a) == F.col(b)).cast("double") for a, b in (("waveform", "mode_waveform"), ("scan", "mode_scan"))]


def with_fields(rows: DataFrame) -> DataFrame:
    """``rows`` with the nine scores in columns of their own, so that what reads them several times computes them once."""
    return rows.withColumns({f"__f{i}": c for i, c in enumerate(field_scores())})


def feature_columns() -> list[Column]:
    """Residuals of the seven measurements, and what the nine fields of ``with_fields`` say together, under the names of features."""
    fields = [F.col(f"__f{i}") for i in range(N + 2)]
    out = [S.residual(F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"klo{i}"), F.col(f"khi{i}")).alias(name) for i, (*_, name) in enumerate(MEASURES)]
    return out + [
        S.r6(S.mean_known(fields)).alias("radar_interval_overlap_score"),
        F.col("waveform").eqNullSafe(F.col("mode_waveform")).cast("double").alias("waveform_match_score"),
        F.col("scan").eqNullSafe(F.col("mode_scan")).cast("double").alias("scan_type_match_score"),
        _sum([f.isNull().cast("double") for f in fields]).alias("missing_feature_count"),
        S.count_at_least(fields, 0.5).alias("matched"),
        _sum([f.isNotNull().cast("int") for f in fields]).alias("compared"),
    ]


def consistency() -> tuple[Column, Column]:
    """Of speed and of height: a half without properties, 1 without a limit or within it, else how far the limit reaches."""
    pick = lambda seen, limit: S.limit_consistency(F.col("has_props"), F.col(seen), F.col(limit))
    return pick("speed", "speed_limit"), pick("height", "ceiling")


def carrier_part() -> Column:
    speed, height = consistency()
    return S.carrier_score((speed + height) / 2, F.col("link"))


def prior_part() -> Column:
    return S.external_prior(F.col("operator"), F.col("priors"), F.col("more_priors"), F.col("named"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key where they lie in fewer files than a shuffle has tasks: a few files must not mean a few tasks for all pairs."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows if len(rows.inputFiles()) >= width else rows.repartition(width, key)


def _interval(i: int) -> Column:
    """As ``interval_overlap`` of bounds in order. Two branches that are computed keep it whole in the plan: see ``_scored``."""
    ol, oh, kl, kh = (F.col(f"{c}{i}") for c in ("lo", "hi", "klo", "khi"))
    known, overlap = ol.isNotNull() & oh.isNotNull() & kl.isNotNull() & kh.isNotNull(), F.least(oh, kh) - F.greatest(ol, kl)
    oc, kc = (ol + oh) / 2, (kl + kh) / 2
    scale = F.greatest(F.abs(kc), F.abs(oc), kh - kl, F.lit(1.0))
    far = F.greatest(F.lit(0.0), 1 - F.least(F.abs(oc - kl), F.abs(oc - kh), F.abs(oc - kc)) / scale)
    return F.when(known & (overlap > 0), F.least(F.lit(1.0), F.try_divide(overlap, oh - ol))).otherwise(F.when(known, far))


def _scored(seen: DataFrame, modes: DataFrame) -> DataFrame:
    """Pairs of ``_seen`` observations and ``_modes`` with ``mode_raw``, the mean of the nine fields.

    Each field's score stands in the mean twice, as a number and as known, so each becomes a method of its own. All nine in one
    would be larger than what the JVM compiles.
    """
    same = [(F.col(a) == F.col(b)).cast("double") for a, b in (("waveform", "mode_waveform"), ("scan", "mode_scan"))]
    return seen.crossJoin(F.broadcast(modes)).withColumn("mode_raw", S.mean_known([_interval(i) for i in range(N)] + same))


def _seen(observations: DataFrame) -> DataFrame:
    """What pairs read of an observation, with the least and the most that an operator's prior can be, dealt to all tasks by observation."""
    of = lambda pick, c: S.clamp(pick(F.map_values(F.col(c))))
    named = lambda found: F.when(F.col("named").isNotNull(), found).otherwise(0.5)
    least = F.least(of(F.array_min, "priors"), of(F.array_min, "more_priors"), named(0.0), F.lit(0.5))
    most = F.greatest(of(F.array_max, "priors"), of(F.array_max, "more_priors"), named(1.0), F.lit(0.5))
    limits = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("speed", "height")]
    fields = [f"{e}{i}" for i in range(N) for e in ("lo", "hi")]
    rows = observations.select("observation_id", *limits, least.alias("least_prior"), most.alias("most_prior"), *fields, "waveform", "scan")
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "observation_id")


def _modes(rows: DataFrame, k: int) -> DataFrame:
    """Modes numbered by ``place``, with their fields and what their carriers add to a total.

    The best row adds no more than ``roomy``. It adds as much where the tightest limits of the mode's carriers leave room, and no less than
    ``low`` anywhere. ``roomy_k`` and ``low_k`` hold likewise for the k-th best row, null without k rows.
    """
    add = lambda best: 0.15 * S.carrier_score(F.when(F.col("has_props"), best).otherwise(0.5), F.col("link"))
    kth = lambda best: F.get(F.sort_array(F.collect_list(add(best)), asc=False), F.lit(k - 1))
    tight = lambda c: F.min(F.when(F.col("has_props") & (F.col(c) > 0), F.col(c)).otherwise(float("inf")))
    bounds = rows.groupBy("mode_id").agg(
        F.max(add(0.0)).alias("low"), F.max(add(1.0)).alias("roomy"), kth(0.0).alias("low_k"), kth(1.0).alias("roomy_k"),
        tight("speed_limit").alias("speed_room"), tight("ceiling").alias("height_room"), F.min("row").alias("row"),
    )
    # As many as there are modes: one task numbers them.
    place = F.row_number().over(Window.orderBy("mode_id")).alias("place")
    fields = [f"{e}{i}" for i in range(N) for e in ("klo", "khi")]
    return bounds.join(rows.drop("mode_id"), "row").select(
        F.col("mode_id").alias("m"), place, "low", "roomy", "low_k", "roomy_k", "speed_room", "height_room", *fields, "mode_waveform", "mode_scan"
    )


def topk(observations: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """observation_id, rank, row and the three scores of the k best rows of each observation."""
    seen, modes = _seen(observations), _modes(rows, k)
    room = (F.col("speed") <= F.col("speed_room")) & (F.col("height") <= F.col("height_room"))
    raw = 0.75 * F.col("mode_raw") + 0.10 * F.col("least_prior")
    at_least = lambda name: (raw + F.when(room, F.col(f"roomy{name}")).otherwise(F.col(f"low{name}"))).alias(f"low{name}")
    pairs = _scored(seen, modes).select("observation_id", (F.col("place") % (2 * k)).alias("group"), at_least(""), at_least("_k"))
    # The k-th best row reaches what the best of k modes reach, here of different groups, and what the k-th best of any mode does.
    tops = [F.max(F.when(F.col("group") == g, F.col("low"))).alias(f"top{g}") for g in range(2 * k)]
    kth = F.get(F.sort_array(F.array(*[f"top{g}" for g in range(2 * k)]), asc=False), F.lit(k - 1))
    least = pairs.groupBy("observation_id").agg(*tops, F.max("low_k").alias("own")).select("observation_id", F.greatest(kth, F.col("own")).alias("least"))
    # Exploding an array of one keeps the filter above the scores: below them it would hold all of them once more.
    near = _scored(seen.join(least, "observation_id"), modes).select("observation_id", "m", "least", "most_prior", "roomy", F.explode(F.array("mode_raw")).alias("mode_raw"))
    # Totals are rounded to six places.
    reach = F.col("least").isNull() | (0.75 * F.col("mode_raw") + F.col("roomy") + 0.10 * F.col("most_prior") >= F.col("least") - 2e-6)
    left = near.where(reach).select("observation_id", "m", "mode_raw")
    own = rows.select(F.col("mode_id").alias("m"), "operator", "has_props", "speed_limit", "ceiling", "link", "row")
    met = left.join(observations.select("observation_id", "speed", "height", "priors", "more_priors", "named"), "observation_id").join(F.broadcast(own), "m")
    totals = met.select("observation_id", "row", "mode_raw", carrier_part().alias("carrier"), prior_part().alias("prior")).select(
        "observation_id", "row", S.r6(F.col("mode_raw")).alias("mode_score"), S.r6(F.col("carrier")).alias("aircraft_score"),
        S.r6(0.75 * F.col("mode_raw") + 0.15 * F.col("carrier") + 0.10 * F.col("prior")).alias("total_score"),
    )
    best = Window.partitionBy("observation_id").orderBy(F.desc("total_score"), "row")
    return totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def chain(rows: DataFrame, key: str, time: str, ident: str, bucket_s: int = 3600) -> DataFrame:
    """Neighbours in time among the rows of a key: (key, source, target), one way.

    Rows are ordered within hours, and hours within a key by their first and last row, so that a key that
    has most rows does not put them all into one task.
    """
    at = F.struct(F.col(time).alias("t"), F.col(ident).alias("i"))
    hour = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / bucket_s)
    rows = rows.select(key, hour.alias("__hour"), at.alias("__at"))
    inside = rows.withColumn("next", F.lead("__at").over(Window.partitionBy(key, "__hour").orderBy("__at"))).where("next is not null")
    ends = rows.groupBy(key, "__hour").agg(F.min("__at").alias("first"), F.max("__at").alias("__at"))
    across = ends.withColumn("next", F.lead("first").over(Window.partitionBy(key).orderBy("__hour"))).where("next is not null")
    return inside.select(key, "__at", "next").unionByName(across.select(key, "__at", "next")).select(
        key, F.col("__at.i").alias("source"), F.col("next.i").alias("target")
    )


def contradictions(best: DataFrame, least: float = MIN_DELTA) -> DataFrame:
    """source, target, score_delta, reason among an observation's candidates, paired as an array of the k best."""
    row = F.struct("rank", "total_score", "id", *NAMES)
    lists = best.groupBy("observation_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    left = lists.select("c", F.posexplode("c").alias("p", "l"))
    both = left.select("l", F.explode(F.slice("c", F.col("p") + 2, F.size("c"))).alias("r"))
    reason = F.concat_ws(",", *[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in NAMES])
    delta = S.r6(F.col("l.total_score") - F.col("r.total_score"))
    out = both.select(F.col("l.id").alias("source"), F.col("r.id").alias("target"), delta.alias("score_delta"), reason.alias("reason"))
    return out.where((F.col("score_delta") >= least) & (F.col("reason") != ""))


def ingest(observations: DataFrame, rows: DataFrame, now: Column, k: int = K, truth: bool = False, keep=None) -> dict[str, DataFrame]:
    """The six tables of evidence of flat observations and rows: observations, candidates, candidate_edges,
    contradiction_edges, truth_edges and similarity_edges.

    ``now`` is the time that ages are taken against. ``truth`` copies truth labels to observations and marks
    candidates that are true; without it no label reaches a table. ``keep`` writes or caches the ranking,
    which four tables read (nothing by default, so each computes it). An observation without any candidate
    gives no row. Neighbours of one best mode are those next in time.
    """
    ranked = topk(observations, rows, k)
    ranked = keep(ranked) if keep else ranked
    age = S.days_between(now, S.parse_utc(F.col("timestamp_iso8601")))
    recency = S.r6(S.recency(age, 30.0, 0.0))
    names = rows.select("row", *NAMES)
    best = ranked.join(F.broadcast(names), "row").withColumn("id", F.concat(F.lit("evidence:candidate:"), "observation_id", F.lit(":"), "rank"))

    # Numbers alone are aggregated by hash; names of the best row come by its number.
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    top = ranked.groupBy("observation_id").agg(
        first("total_score").alias("total_score"), first("row").alias("row"), F.max(F.when(F.col("rank") == 2, F.col("total_score"))).alias("second"), F.count("*").alias("found"),
    )
    top = top.join(F.broadcast(names), "row").select("observation_id", F.struct("total_score", "mode_id", "aircraft_id").alias("first"), "second", "found")
    unclear = F.when(F.col("found") > 1, F.greatest(F.lit(0.05), 1.0 - (F.col("first.total_score") - F.col("second")))).otherwise(0.1)
    node = F.concat(F.lit("evidence:observation:"), "observation_id")
    label = lambda name: F.col(f"truth.{name}") if truth else F.lit(None).cast("string")
    met = observations.join(top, "observation_id")
    obs = met.select(
        node.alias("id"), "observation_id", "series_id", "sequence_index", "elapsed_time_s", "timestamp_iso8601",
        S.r6(F.col("found") / k).alias("degree_score"), F.col("first.total_score").alias("text_score"), recency.alias("recency_score"),
        S.masses_from_score(F.col("first.total_score"), unclear).alias("ds_masses"),
        *[label(n).alias(n) for n in ("radar_id", "mode_id", "aircraft_id", "operator")],
        F.col("first.mode_id").alias("best_candidate_mode_id"), F.col("first.aircraft_id").alias("best_candidate_aircraft_id"), F.col("first.total_score").alias("best_candidate_score"),
    )

    # The carrier's properties are those of the first row that names it; no carrier counts as a name.
    carrier = rows.groupBy(F.col("aircraft_id").alias("carrier")).agg(F.min(F.struct("row", "has_props", "speed_limit", "ceiling")).alias("own"))
    mode_cols = [*[f"{e}{i}" for i in range(N) for e in ("klo", "khi")], "mode_waveform", "mode_scan"]
    wide = (
        observations.join(best, "observation_id").join(F.broadcast(rows.select("row", *mode_cols)), "row")
        .join(F.broadcast(carrier), F.col("aircraft_id").eqNullSafe(F.col("carrier")))
        .select("*", "own.has_props", "own.speed_limit", "own.ceiling")
        .join(top.select("observation_id", "found"), "observation_id")
    )
    speed, height = consistency()
    features = with_fields(wide).select(
        "id", "observation_id", "series_id", "sequence_index", "rank", F.col("total_score").alias("text_score"), recency.alias("recency_score"),
        S.masses_from_score(F.col("total_score"), F.when(F.col("rank") == 1, 0.2).otherwise(0.35)).alias("ds_masses"),
        *NAMES, "mode_score", "aircraft_score", speed.alias("speed_consistency_score"), height.alias("altitude_consistency_score"),
        F.lit(1.0).alias("heading_consistency_score"), F.col("width").alias("observation_uncertainty_width"),
        F.col("found").cast("double").alias("candidate_ambiguity_count"), *feature_columns(),
    )
    degree = S.r6(F.col("matched") / F.greatest(F.col("compared"), F.lit(1)))
    candidates = features.withColumn("degree_score", degree).drop("matched", "compared")

    true = best.join(observations.select("observation_id", "truth"), "observation_id").where(
        F.lit(truth) & F.col("mode_id").eqNullSafe(F.col("truth.mode_id")) & F.col("aircraft_id").eqNullSafe(F.col("truth.aircraft_id"))
    )
    timed = met.select(F.col("first.mode_id").alias("mode_id"), S.parse_utc(F.col("timestamp_iso8601")).alias("t"), node.alias("id"))
    near = chain(timed, "mode_id", "t", "id")
    both_ways = F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))
    return {
        "observations": obs,
        "candidates": candidates,
        "candidate_edges": best.select(node.alias("source"), F.col("id").alias("target"), F.col("total_score").alias("score"), "rank"),
        "contradiction_edges": contradictions(best),
        "truth_edges": true.select(node.alias("source"), F.col("id").alias("target")),
        "similarity_edges": near.select(F.inline(both_ways)),
    }


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of the tables of ``ingest``."""
    parts = [t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)
