"""The views in DuckDB SQL, as common table expressions."""

from __future__ import annotations

from credence.sources.views import TEMPLATES


def r6(x: str) -> str:
    return f"round({x} + 1e-9, 6)"


OBS = """obs AS (SELECT *, value - error AS lo, value + error AS hi FROM (
  SELECT event_id AS observation_id, user_id AS series_id, ts, event_type AS waveform, length(event_type) % 3 AS code, value,
    greatest(abs(value) * 0.08, 1e-9) AS error, TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS k FROM events))"""

SER = OBS + """, ser AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, observation_id) - 1 AS sequence_index FROM obs)"""

_T = ", ".join(f"({i}, '{n}', CAST({f} AS DOUBLE), CAST({w} AS DOUBLE))" for i, n, f, w in TEMPLATES)

MODES = f"""tpl(i, mode_name, f, w) AS (VALUES {_T}), mode0 AS (
  SELECT *, (20 + 9 * n_nationkey) * f + 0.37::DOUBLE * (n_nationkey + 1) + 0.11::DOUBLE * i AS c, 4 * n_nationkey + 3 * i AS kk FROM nation, tpl),
modes AS (SELECT 'mode:' || n_nationkey || ':' || i AS mode_id, 'radar:' || n_nationkey AS radar_id, n_nationkey AS nation, mode_name, i AS mode_index,
  {r6('c')} AS center, {r6('c * (1 - w)')} AS klo, {r6('c * (1 + w)')} AS khi, {r6('kk * 0.8::DOUBLE')} AS k_klo, {r6('kk * 1.2::DOUBLE')} AS k_khi,
  (n_nationkey + i) % 3 AS mode_code FROM mode0)"""


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '^_+|_+$', '', 'g')"


CARRIERS = f"""carriers AS (SELECT 'carrier:' || {slug('c_mktsegment')} || ':' || c_nationkey AS carrier_id, 'radar:' || c_nationkey AS radar_id,
  c_nationkey AS nation, c_mktsegment AS variant, max(c_acctbal) AS speed_limit, min(c_acctbal) AS ceiling
  FROM customer GROUP BY c_nationkey, c_mktsegment HAVING max(c_acctbal) >= 9000)"""

OPERATES = CARRIERS + """, oplinks AS (SELECT n_nationkey, n_regionkey AS rk FROM nation
  UNION ALL SELECT n_nationkey, (n_regionkey + 1) % 5 FROM nation WHERE n_nationkey % 2 = 0),
operates AS (SELECT r_name AS operator, carrier_id, nation FROM carriers JOIN oplinks ON nation = n_nationkey JOIN region ON rk = r_regionkey)"""

KG = MODES + ", " + OPERATES + """, kg AS (SELECT m.*, c.carrier_id, c.variant, c.speed_limit, c.ceiling, o.operator, c.carrier_id IS NOT NULL AS uses_radar
  FROM modes m LEFT JOIN carriers c ON c.radar_id = m.radar_id LEFT JOIN operates o ON o.carrier_id = c.carrier_id)"""

CLAIMS = """claims AS (SELECT l_orderkey AS report_id, l_linenumber AS claim_no, l_returnflag AS claim_type, l_suppkey AS object_id,
  CASE WHEN l_linestatus = 'F' THEN 'refutes' ELSE 'supports' END AS stance, 1 - l_discount * 5 AS confidence, 1 - l_tax * 5 AS extraction,
  o_totalprice / 500000 AS credibility, l_quantity / 50 AS specificity, coalesce(CASE WHEN l_orderkey % 9 <> 0 THEN o_orderdate END, CASE WHEN l_orderkey % 45 <> 0 THEN o_orderdate + INTERVAL 3 DAY END) AS observed_at, l_shipdate AS reference_time
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

VECS = "vecs AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"

EDGES = """edges AS (SELECT e.vec_id AS src, e.vec_id + s.step AS dst, s.rel FROM embeddings e,
  (VALUES (0, 1), (1, 2), (2, -1)) s(rel, step) WHERE e.vec_id + s.step IN (SELECT vec_id FROM embeddings))"""


def clamp(x: str, low: float = 0, high: float = 1) -> str:
    return f"least(greatest({x}, {low}::DOUBLE), {high}::DOUBLE)"


def overlap(ol: str, oh: str, kl: str, kh: str) -> str:
    """The interval score of bounds that are in order."""
    oc, kc = f"(({ol} + {oh}) / 2)", f"(({kl} + {kh}) / 2)"
    return (
        f"(CASE WHEN {ol} IS NULL OR {oh} IS NULL OR {kl} IS NULL OR {kh} IS NULL THEN NULL "
        f"WHEN least({oh}, {kh}) - greatest({ol}, {kl}) > 0 THEN least(1.0::DOUBLE, (least({oh}, {kh}) - greatest({ol}, {kl})) / ({oh} - {ol})) "
        f"ELSE greatest(0.0::DOUBLE, 1 - least(abs({oc} - {kl}), abs({oc} - {kh}), abs({oc} - {kc})) / greatest(abs({kc}), abs({oc}), {kh} - {kl}, 1.0::DOUBLE)) END)"
    )


def recency(age: str, half_life: float, missing: float) -> str:
    return f"(CASE WHEN ({age}) IS NULL THEN {missing}::DOUBLE ELSE exp(-0.6931471805599453::DOUBLE * greatest({age}, 0.0::DOUBLE) / {half_life}::DOUBLE) END)"


def days(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0::DOUBLE)"


#: Scores of every observation against every candidate row.
SCORED = (
    OBS + ", " + KG
    + f""", msc AS (SELECT o.observation_id, m.mode_id, {overlap('o.lo', 'o.hi', 'm.klo', 'm.khi')} AS s1, {overlap('o.k * 0.95::DOUBLE', 'o.k * 1.05::DOUBLE', 'm.k_klo', 'm.k_khi')} AS s2,
  CASE WHEN o.code = m.mode_code THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s3, o.value, o.k, o.code FROM obs o, modes m),
msc2 AS (SELECT *, (coalesce(s1, 0) + coalesce(s2, 0) + s3) / ((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + 1) AS mode_score FROM msc),
lim AS (SELECT t.*, g.radar_id, g.carrier_id, g.operator, g.uses_radar,
  CASE WHEN NOT g.uses_radar THEN 0.5 WHEN speed_limit <= 0 OR value * 20 <= 1.05 * speed_limit THEN 1.0 ELSE speed_limit / (value * 20) END::DOUBLE AS sp,
  CASE WHEN NOT g.uses_radar THEN 0.5 WHEN ceiling <= 0 OR k IS NULL OR k * 100 <= 1.05 * ceiling THEN 1.0 ELSE ceiling / (k * 100) END::DOUBLE AS al,
  CASE WHEN g.uses_radar THEN 1.0 ELSE 0.5 END::DOUBLE AS link,
  CASE WHEN code = 0 AND operator = 'EUROPE' THEN 0.9 WHEN code = 1 AND operator = 'ASIA' THEN 0.8 WHEN code = 2 AND operator = 'AFRICA' THEN 1.0
    WHEN code = 2 AND operator IS NOT NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS prior FROM msc2 t JOIN kg g USING (mode_id)),
scored AS (SELECT *, round(0.75::DOUBLE * mode_score + 0.15::DOUBLE * (0.8::DOUBLE * (sp + al) / 2 + 0.2::DOUBLE * link) + 0.10::DOUBLE * prior + 1e-9, 6) AS total FROM lim),
topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY total DESC, mode_id, coalesce(carrier_id, ''), coalesce(operator, '')) AS rank FROM scored) WHERE rank <= 5)"""
)
