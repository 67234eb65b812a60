"""The same queries as plain SQL over the benchmark tables, for checking."""

from __future__ import annotations

from flowrisk.config import LEAK_VOCABULARY, METHOD_ACTIONS, VALUE_PATTERNS
from flowrisk.functions.expressions import hmac_pads, seed_salt

# Canonical events. Every query below starts from this chain of subqueries.
EV = """
src AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
ev0 AS (SELECT *,
  'u' || user_id || CASE WHEN user_id % 2 = 0 THEN '@p.iam.gserviceaccount.com' ELSE '@example.com' END AS actor_id,
  CASE event_type
    WHEN 'signup' THEN CASE WHEN k < 20 THEN 'IAM_CREATE_KEY' WHEN k < 40 THEN 'IAM_DELETE_KEY' ELSE 'IAM_IMPERSONATE' END
    WHEN 'click' THEN CASE WHEN k < 20 THEN 'IAM_SET_POLICY' WHEN k < 40 THEN 'COMPUTE_METADATA_CHANGE' ELSE 'COMPUTE_CREATE' END
    WHEN 'purchase' THEN CASE WHEN k < 70 THEN 'SECRET_ACCESS' ELSE 'KMS_DECRYPT' END
    WHEN 'view' THEN 'GCS_READ'
    ELSE CASE WHEN k < 50 THEN 'GCS_WRITE' ELSE 'BQ_JOB_SUBMIT' END END AS action_type,
  CASE event_type
    WHEN 'signup' THEN 'IDENTITY'
    WHEN 'click' THEN CASE WHEN k < 20 THEN 'CONTROL' ELSE 'COMPUTE' END
    WHEN 'purchase' THEN 'SECRET' WHEN 'view' THEN 'DATA'
    ELSE CASE WHEN k < 50 THEN 'EXFIL_RISK' ELSE 'DATA' END END AS target_zone
  FROM src),
ev AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, ts, epoch_us(ts) AS us,
  date_trunc('day', ts) AS ws, actor_id, action_type, target_zone, user_id, event_type, value, k,
  CASE WHEN event_type = 'signup' THEN 'sa/' || user_id || '/' || (k % 5)
       ELSE target_zone || '/' || (user_id % 50) || '/' || (k % 10) END AS target_id,
  CASE WHEN user_id % 3 = 0 THEN 'projects/p/locations/l/jobs/' || (user_id % 7)
       WHEN user_id % 3 = 1 THEN 'sched:j' || (user_id % 7) || ':0' END AS trigger_ref,
  CASE WHEN user_id % 3 < 2 THEN 'WEAK' ELSE 'NONE' END AS provenance_level,
  CASE WHEN user_id % 4 = 0 AND k < 90 THEN 1 ELSE 0 END AS chained,
  user_id % 6 = 0 AS known
  FROM ev0)"""

WS = "strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start"

EDGES = """
hops AS (SELECT *, lag(target_zone) OVER (PARTITION BY ws, actor_id ORDER BY ts, event_id) AS source_zone FROM ev),
edges0 AS (SELECT ws, actor_id, source_zone, target_zone, target_id, count(*) AS edge_count, min(us) AS first_seen
  FROM hops WHERE source_zone IS NOT NULL GROUP BY ALL),
edges AS (SELECT e.*, NOT EXISTS (SELECT 1 FROM edges0 p WHERE p.actor_id = e.actor_id
    AND p.source_zone = e.source_zone AND p.target_zone = e.target_zone
    AND p.ws >= e.ws - INTERVAL 7 DAY AND p.ws < e.ws) AS is_new FROM edges0 e)"""

FLUX = """
zi AS (SELECT * FROM (VALUES ('CONTROL',0),('IDENTITY',1),('SECRET',2),('DATA',3),('COMPUTE',4),('EXFIL_RISK',5)) t(z, i)),
cells AS (SELECT ws, a.i AS i, b.i AS j, CAST(sum(edge_count) AS DOUBLE) AS flux FROM edges
  JOIN zi a ON a.z = source_zone JOIN zi b ON b.z = target_zone GROUP BY ALL),
pairs AS (SELECT ws, least(i, j) AS lo, greatest(i, j) AS hi,
  sum(CASE WHEN i <= j THEN flux ELSE 0 END) AS f, sum(CASE WHEN i > j THEN flux ELSE 0 END) AS b FROM cells GROUP BY ALL),
obs AS (SELECT *, sum(f + b) OVER (PARTITION BY lo, hi ORDER BY ws) AS seen FROM pairs),
sig AS (SELECT ws, sum(CASE WHEN lo <> hi AND f > 0 AND b > 0 AND seen >= 5
    THEN (CASE WHEN seen <= 50 THEN 0.5 ELSE 1.0 END) * (f - b) * ln(f / b) ELSE 0 END) AS sigma FROM obs GROUP BY ws),
br AS (SELECT ws, count(DISTINCT source_zone || '_' || target_zone) AS bridges FROM edges
  WHERE is_new AND source_zone <> target_zone GROUP BY ws),
wins AS (SELECT DISTINCT ws FROM ev),
zf AS (SELECT w.ws, coalesce(sigma, 0) AS sigma, coalesce(bridges, 0) AS bridges FROM wins w
  LEFT JOIN sig USING (ws) LEFT JOIN br USING (ws)),
ema AS (SELECT c.ws, c.sigma, c.bridges, c.sigma - sum(h.sigma * CASE WHEN h.rn = 1 THEN 1.0 ELSE 0.1 END
    * power(0.9, h_n - h.rn)) AS d FROM (SELECT *, row_number() OVER (ORDER BY ws) - 1 AS h_n FROM zf) c
  LEFT JOIN (SELECT *, row_number() OVER (ORDER BY ws) AS rn FROM zf) h ON h.ws < c.ws
  GROUP BY c.ws, c.sigma, c.bridges)"""

ACT = """
tgt AS (SELECT ws, actor_id, target_id, count(*) AS hits FROM ev GROUP BY ALL),
ent AS (SELECT ws, actor_id, count(*) AS n_targets, sum(hits) AS n,
  CASE WHEN count(*) <= 1 THEN 0.0 ELSE log2(sum(hits)) - sum(hits * log2(hits)) / sum(hits) END AS h FROM tgt GROUP BY ALL),
act AS (SELECT ws, actor_id, count(*) AS event_count, string_agg(DISTINCT action_type, ',' ORDER BY action_type) AS action_types,
  count(*) / greatest(1.0, (max(us) - min(us)) / 6e7) AS burst, max(provenance_level) AS provenance_level, bool_or(known) AS known,
  count(*) FILTER (action_type = 'IAM_SET_POLICY') AS n_policy, count(*) FILTER (action_type = 'IAM_CREATE_KEY') AS n_key,
  count(*) FILTER (action_type = 'IAM_IMPERSONATE') AS n_imp, count(*) FILTER (action_type = 'SECRET_ACCESS') AS n_secret,
  count(*) FILTER (action_type = 'KMS_DECRYPT') AS n_kms, count(*) FILTER (action_type = 'COMPUTE_METADATA_CHANGE') AS n_meta,
  sum(chained) AS n_chained FROM ev GROUP BY ws, actor_id)"""

INV = """
r5 AS (SELECT c.ws, c.actor_id, c.n_imp, avg(p.n_imp) AS base FROM act c
  LEFT JOIN act p ON p.actor_id = c.actor_id AND p.n_imp > 0 AND p.ws >= c.ws - INTERVAL 7 DAY AND p.ws < c.ws
  WHERE c.n_imp > 0 GROUP BY ALL),
touch AS (SELECT DISTINCT ws, actor_id, action_type, target_id FROM ev WHERE action_type IN ('SECRET_ACCESS', 'KMS_DECRYPT')),
fresh AS (SELECT t.*, NOT EXISTS (SELECT 1 FROM touch p WHERE p.actor_id = t.actor_id AND p.target_id = t.target_id
    AND p.action_type = t.action_type AND p.ws >= t.ws - INTERVAL 7 DAY AND p.ws < t.ws) AS is_new FROM touch t),
r68 AS (SELECT ws, actor_id, bool_or(is_new AND action_type = 'SECRET_ACCESS') AS i6,
  bool_or(is_new AND action_type = 'KMS_DECRYPT') AS i8 FROM fresh GROUP BY ALL HAVING bool_or(is_new)),
r10 AS (SELECT DISTINCT ws, actor_id FROM edges WHERE is_new AND target_zone IN ('SECRET', 'EXFIL_RISK')),
r11 AS (SELECT c.ws, c.actor_id, coalesce(sum(p.n_chained), 0) AS past_chained, coalesce(sum(p.event_count), 0) AS past_events,
  any_value(c.event_count > c.n_chained) AS bare FROM act c
  LEFT JOIN act p ON p.actor_id = c.actor_id AND p.ws >= c.ws - INTERVAL 7 DAY AND p.ws < c.ws GROUP BY c.ws, c.actor_id),
flags AS (SELECT a.ws, a.actor_id, n_policy > 0 AS i1, n_key > 0 AS i2, n_key > 0 AND NOT known AS i3, a.n_imp > 0 AS i4,
  coalesce(a.n_imp > 0 AND (base IS NULL OR a.n_imp > 2 * base), false) AS i5, coalesce(i6, false) AS i6,
  n_policy > 0 AND n_secret > 0 AS i7, coalesce(i8, false) AS i8, n_meta > 0 AS i9, r10.ws IS NOT NULL AS i10,
  a.actor_id LIKE '%.iam.gserviceaccount.com%' AND bare AND past_events >= 10 AND past_chained / past_events >= 0.8 AS i11
  FROM act a LEFT JOIN r5 USING (ws, actor_id) LEFT JOIN r68 USING (ws, actor_id) LEFT JOIN r10 USING (ws, actor_id)
  JOIN r11 USING (ws, actor_id)),
inv AS (SELECT ws, actor_id,
  CASE WHEN i1 OR i2 OR i3 OR i5 OR i6 OR i7 OR i9 OR i10 OR i11 THEN 5.0 WHEN i4 OR i8 THEN 4.0 ELSE 0.0 END AS inv_score,
  CAST(i1::INT+i2::INT+i3::INT+i4::INT+i5::INT+i6::INT+i7::INT+i8::INT+i9::INT+i10::INT+i11::INT AS INTEGER) AS inv_count,
  concat_ws(',', CASE WHEN i1 THEN 'INV_001' END, CASE WHEN i2 THEN 'INV_002' END, CASE WHEN i3 THEN 'INV_003' END,
    CASE WHEN i4 THEN 'INV_004' END, CASE WHEN i5 THEN 'INV_005' END, CASE WHEN i6 THEN 'INV_006' END,
    CASE WHEN i7 THEN 'INV_007' END, CASE WHEN i8 THEN 'INV_008' END, CASE WHEN i9 THEN 'INV_009' END,
    CASE WHEN i10 THEN 'INV_010' END, CASE WHEN i11 THEN 'INV_011' END) AS fired FROM flags)"""

CLOSE = """
op AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY ts, event_id) AS rn FROM ev
  WHERE action_type IN ('IAM_CREATE_KEY','IAM_CREATE_SA','IAM_IMPERSONATE','IAM_SET_POLICY','COMPUTE_METADATA_CHANGE')
     OR target_zone IN ('IDENTITY','CONTROL')),
wt AS (SELECT target_id AS resource_id, event_id AS oid, us AS o, actor_id, action_type,
  CASE action_type WHEN 'IAM_CREATE_KEY' THEN 'SA_KEY' WHEN 'IAM_IMPERSONATE' THEN 'IMPERSONATION'
    WHEN 'IAM_SET_POLICY' THEN 'IAM_POLICY' WHEN 'COMPUTE_METADATA_CHANGE' THEN 'COMPUTE' ELSE 'UNKNOWN' END AS rt,
  CASE action_type WHEN 'IAM_CREATE_KEY' THEN 'IAM_DELETE_KEY' WHEN 'IAM_IMPERSONATE' THEN 'TEMPORAL_EXPIRY' ELSE 'SETTLEMENT' END AS ect,
  CASE action_type WHEN 'IAM_CREATE_KEY' THEN 720 WHEN 'IAM_IMPERSONATE' THEN 1 WHEN 'COMPUTE_METADATA_CHANGE' THEN 2 ELSE 4 END AS h,
  CASE action_type WHEN 'IAM_CREATE_KEY' THEN 5.0 WHEN 'IAM_IMPERSONATE' THEN 4.0 WHEN 'IAM_SET_POLICY' THEN 4.0
    WHEN 'COMPUTE_METADATA_CHANGE' THEN 2.0 ELSE 3.0 END AS sens,
  CASE action_type WHEN 'IAM_IMPERSONATE' THEN 1 WHEN 'COMPUTE_METADATA_CHANGE' THEN 2 ELSE 4 END AS s
  FROM op WHERE rn = 1),
ex AS (SELECT w.resource_id, min((e.us, e.event_id)) AS c FROM wt w JOIN ev e ON e.target_id = w.resource_id
  AND e.action_type = w.ect AND (e.us, e.event_id) > (w.o, w.oid) GROUP BY ALL),
aw AS (SELECT DISTINCT ws, epoch_us(ws) AS wu, actor_id FROM ev),
st0 AS (SELECT w.resource_id, a.wu, any_value(w.o) AS o, any_value(w.s) AS s, max(e.us) AS la FROM wt w
  JOIN aw a ON a.actor_id = w.actor_id AND a.wu >= w.o
  LEFT JOIN ev e ON e.target_id = w.resource_id AND e.us > w.o AND e.us <= a.wu
  WHERE w.rt <> 'SA_KEY' GROUP BY w.resource_id, a.wu),
st AS (SELECT resource_id, min(wu) AS settled FROM st0
  WHERE wu - greatest(o, coalesce(la, o)) >= s * 3600000000 GROUP BY ALL),
cl AS (SELECT w.*, ex.c[1] AS ex_us, st.settled,
  CASE WHEN ect = 'TEMPORAL_EXPIRY' THEN o + h * 3600000000 END AS expiry FROM wt w LEFT JOIN ex USING (resource_id)
  LEFT JOIN st USING (resource_id))"""


def _signals(point_in_time: bool) -> str:
    seen = "w.o <= a.wu" if point_in_time else "true"
    explicit = "w.ex_us <= a.wu" if point_in_time else "w.ex_us IS NOT NULL"
    return f"""
cs0 AS (SELECT a.ws, a.actor_id, w.*, coalesce({explicit}, false) OR coalesce(w.settled <= a.wu, false)
    OR coalesce(w.expiry <= a.wu, false) AS done, (a.wu - w.o) / 3.6e9 AS age
  FROM aw a JOIN cl w ON w.actor_id = a.actor_id AND {seen}),
cs1 AS (SELECT ws, actor_id, count(*) AS total, count(*) FILTER (done) AS closed,
  sum(CASE WHEN NOT done AND age > h THEN sens * (1 + log2(greatest(1.0, age / h))) ELSE 0 END) AS orphaned FROM cs0 GROUP BY ALL),
cs AS (SELECT a.ws, a.actor_id, coalesce(total, 0) AS total, coalesce(closed, 0) AS closed,
  CASE WHEN total IS NULL THEN 1.0 ELSE closed / total END AS ratio, coalesce(orphaned, 0) AS orphaned
  FROM aw a LEFT JOIN cs1 USING (ws, actor_id))"""


FUSE = """
nov AS (SELECT ws, actor_id, sum(CASE WHEN target_zone IN ('SECRET','EXFIL_RISK') THEN 2.0
  WHEN target_zone IN ('IDENTITY','CONTROL') THEN 1.5 ELSE 1.0 END) AS novelty FROM edges WHERE is_new GROUP BY ALL),
fu0 AS (SELECT a.ws, a.actor_id, a.event_count, a.burst, ent.h AS ent, inv_score, inv_count, coalesce(novelty, 0.0) AS novelty, sigma, bridges,
  coalesce(d, 0.0) AS d, ratio, orphaned FROM act a JOIN ent USING (ws, actor_id) JOIN inv USING (ws, actor_id)
  LEFT JOIN nov USING (ws, actor_id) JOIN ema USING (ws) JOIN cs USING (ws, actor_id)),
fu1 AS (SELECT *, least(inv_score / 5.0, 1.0) AS s1, least(inv_count / 10.0, 1.0) AS s2, least(novelty / 10.0, 1.0) AS s3,
  1.0 / (1.0 + exp(-(sigma - 3.0))) AS s4, least(bridges / 5.0, 1.0) AS s5, greatest(0.0, least(d / 5.0, 1.0)) AS s6,
  1.0 - ratio AS s7, least(orphaned / 50.0, 1.0) AS s8 FROM fu0),
fu AS (SELECT *, .17 * s1 + .13 * s2 + .30 * s3 + .04 * s4 + .13 * s5 + .08 * s6 + .10 * s7 + .05 * s8 AS fusion FROM fu1)"""

# LCS of the day's zone sequence with each pattern, one event at a time.
LCS = """
seqs AS (SELECT ws, actor_id, list(target_zone ORDER BY ts, event_id) AS zs, count(*) AS n FROM ev GROUP BY ALL),
pz AS (SELECT * FROM (VALUES ('pat-a', ['SECRET','DATA']), ('pat-b', ['DATA','SECRET','COMPUTE','IDENTITY'])) t(pid, pat)),
dp AS (SELECT ws, actor_id, pid, zs, pat, n, 0 AS i, [0, 0, 0, 0, 0] AS r FROM seqs, pz
  UNION ALL SELECT ws, actor_id, pid, zs, pat, n, i + 1, (SELECT [0, c1, c2, c3, c4] FROM (SELECT c1, c2, c3,
      CASE WHEN zs[i+1] = pat[4] THEN r[4] + 1 ELSE greatest(r[5], c3) END AS c4 FROM (SELECT c1, c2,
      CASE WHEN zs[i+1] = pat[3] THEN r[3] + 1 ELSE greatest(r[4], c2) END AS c3 FROM (SELECT c1,
      CASE WHEN zs[i+1] = pat[2] THEN r[2] + 1 ELSE greatest(r[3], c1) END AS c2 FROM (SELECT
      CASE WHEN zs[i+1] = pat[1] THEN r[1] + 1 ELSE r[2] END AS c1)))))
  FROM dp WHERE i < n),
zm AS (SELECT ws, actor_id, pid, r[len(pat) + 1] / greatest(n, len(pat)) AS zone_score FROM dp WHERE i = n)"""

MATCH = """
pm0 AS (SELECT ws, actor_id, event_count,
  0.30e0 + 0.35e0 * za.zone_score + 0.20e0 + 0.15e0 AS pa,
  0.30e0 * CASE WHEN split_part(actor_id, '@', 1) = 'u6' THEN 0.8e0 WHEN actor_id = 'u12@p.iam.gserviceaccount.com' THEN 1e0 ELSE 0e0 END
    + 0.35e0 * zb.zone_score + 0.20e0 * CASE WHEN isodow(ws) <= 5 THEN 1e0 ELSE 0e0 END
    + 0.15e0 * CASE WHEN event_count BETWEEN 1 AND 3 THEN 1e0 ELSE 0e0 END AS pb,
  0.30e0 + 0.35e0 + 0.20e0 * CASE WHEN isodow(ws) >= 6 THEN 1e0 ELSE 0e0 END
    + 0.15e0 * CASE WHEN event_count BETWEEN 2 AND 5 THEN 1e0 ELSE 0e0 END AS pc
  FROM act JOIN (SELECT * FROM zm WHERE pid = 'pat-a') za USING (ws, actor_id)
  JOIN (SELECT * FROM zm WHERE pid = 'pat-b') zb USING (ws, actor_id)),
pm AS (SELECT ws, actor_id, greatest(pa, pb, pc) AS score,
  CASE WHEN pa >= pb AND pa >= pc THEN 'pat-a' WHEN pb >= pc THEN 'pat-b' ELSE 'pat-c' END AS pid FROM pm0)"""

PROV = """
dom AS (SELECT DISTINCT ON (ws, actor_id) ws, actor_id, provenance_level, trigger_ref FROM ev
  ORDER BY ws, actor_id, CASE provenance_level WHEN 'STRONG' THEN 3 WHEN 'WEAK' THEN 2 ELSE 1 END DESC, ts, event_id),
chain AS (SELECT trigger_ref, count(*) AS corroboration,
  trigger_ref LIKE 'sched:%' OR count(*) >= 2 AS resolved FROM ev WHERE trigger_ref IS NOT NULL GROUP BY trigger_ref),
rr AS (SELECT fu.*, pm.score, pm.pid, dom.provenance_level, coalesce(resolved, false) AS resolved,
  fusion * (1 - 0.3 * pm.score * CASE provenance_level WHEN 'STRONG' THEN 1.0 WHEN 'WEAK'
    THEN CASE WHEN coalesce(resolved, false) THEN 0.8 ELSE 0.6 END ELSE 0.0 END) AS residual
  FROM fu JOIN pm USING (ws, actor_id) JOIN dom USING (ws, actor_id) LEFT JOIN chain USING (trigger_ref)),
risk AS (SELECT *, CASE WHEN residual >= 0.45 THEN 'HIGH' WHEN residual >= 0.34 THEN 'MEDIUM' WHEN residual >= 0.20 THEN 'WATCH'
  ELSE 'NORMAL' END AS tier FROM rr),
energy AS (SELECT *, residual * 10.0 * (1 + 0.5 * (1 - ratio)) + orphaned / 10.0 AS e FROM risk),
lev AS (SELECT *, CASE WHEN e > 8 THEN 'ALERT_HIGH' WHEN e > 5 THEN 'ALERT_MED' WHEN e > 3 THEN 'WATCH' ELSE 'NORMAL' END AS level FROM energy)"""


def sql(*parts: str, select: str) -> str:
    recursive = "RECURSIVE " if LCS in parts else ""
    return f"WITH {recursive}" + ",".join(parts) + "\n" + select


FUSED = (EV, EDGES, FLUX, ACT, INV, CLOSE, _signals(True), FUSE)
RISK = (*FUSED, LCS, MATCH, PROV)
r6 = lambda e: f"round({e}, 6) + 0.0"

ORACLE: dict[str, str] = {
    "actor_windows": sql(EV, ACT, select=f"""SELECT {WS}, actor_id, event_count, n_targets, action_types,
        {r6('burst')} AS burst_per_min, {r6('h')} AS breadth_entropy, provenance_level
        FROM (SELECT ws, actor_id, event_count, action_types, burst, n_targets, h,
              CASE WHEN provenance_level = 'WEAK' THEN 'WEAK' ELSE 'NONE' END AS provenance_level
              FROM act JOIN ent USING (ws, actor_id))"""),
    "breadth_entropy": sql(EV, ACT, select=f"SELECT {WS}, actor_id, {r6('h')} AS breadth_entropy FROM ent"),
    "window_targets": sql(EV, ACT, select=f"SELECT {WS}, actor_id, target_id, hits FROM tgt"),
    "zone_sequences": sql(EV, select=f"""SELECT {WS}, actor_id, row_number() OVER (PARTITION BY ws, actor_id
        ORDER BY ts, event_id) AS position, target_zone FROM ev"""),
    "zone_edges": sql(EV, EDGES, select=f"""SELECT {WS}, actor_id, source_zone, target_zone, target_id,
        edge_count, first_seen FROM edges0"""),
    "edge_novelty": sql(EV, EDGES, select=f"""SELECT {WS}, actor_id, source_zone, target_zone, target_id, is_new FROM edges"""),
    "zone_flux": sql(EV, EDGES, FLUX, select=f"""SELECT {WS},
        (SELECT string_agg(CAST(CAST(coalesce(flux, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY a.i, b.i) FROM zi a CROSS JOIN zi b
          LEFT JOIN (SELECT * FROM cells c WHERE c.ws = zf.ws) c ON c.i = a.i AND c.j = b.i) AS flux_matrix,
        (SELECT string_agg(CAST(CAST(coalesce(f - b, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY a.i, b2.i) FROM zi a CROSS JOIN zi b2
          LEFT JOIN (SELECT * FROM pairs p WHERE p.ws = zf.ws AND lo <> hi) p ON p.lo = a.i AND p.hi = b2.i) AS net_currents,
        {r6('sigma')} AS sigma_coarse, bridges AS bridge_count FROM zf"""),
    "sigma_coarse": sql(EV, EDGES, FLUX, select=f"SELECT {WS}, {r6('sigma')} AS sigma_coarse FROM sig"),
    "bridge_count": sql(EV, EDGES, FLUX, select=f"SELECT {WS}, bridges AS bridge_count FROM br"),
    "ema_delta": sql(EV, EDGES, FLUX, select=f"""SELECT {WS}, {r6('sigma')} AS sigma_coarse,
        {r6('coalesce(d, 0)')} AS delta_f FROM ema"""),
    "novelty_score": sql(EV, EDGES, select=f"""SELECT {WS}, actor_id, {r6('''sum(CASE WHEN target_zone IN ('SECRET','EXFIL_RISK')
        THEN 2.0 WHEN target_zone IN ('IDENTITY','CONTROL') THEN 1.5 ELSE 1.0 END)''')} AS novelty_score FROM edges WHERE is_new GROUP BY ws, actor_id"""),
    "inv_simple": sql(EV, EDGES, ACT, INV, select=f"""SELECT {WS}, actor_id, i1 AS INV_001, i2 AS INV_002, i3 AS INV_003,
        i4 AS INV_004, i7 AS INV_007, i9 AS INV_009 FROM flags"""),
    "inv_spike": sql(EV, ACT, select=f"""SELECT strftime(c.ws, '%Y-%m-%d %H:%M:%S') AS window_start, c.actor_id, c.n_imp AS n_impersonate,
        {r6('avg(p.n_imp)')} AS impersonation_baseline, coalesce(c.n_imp > 2 * avg(p.n_imp), true) AS INV_005 FROM act c
        LEFT JOIN act p ON p.actor_id = c.actor_id AND p.n_imp > 0 AND p.ws >= c.ws - INTERVAL 7 DAY AND p.ws < c.ws
        WHERE c.n_imp > 0 GROUP BY c.ws, c.actor_id, c.n_imp"""),
    "inv_novel_access": sql(EV, EDGES, ACT, INV, select=f"SELECT {WS}, actor_id, i6 AS INV_006, i8 AS INV_008 FROM r68"),
    "novel_access": sql(EV, EDGES, ACT, INV, select=f"""SELECT {WS}, actor_id, target_id, is_new FROM fresh
        WHERE action_type = 'SECRET_ACCESS'"""),
    "inv_new_edge": sql(EV, EDGES, ACT, INV, select=f"SELECT {WS}, actor_id, true AS INV_010 FROM r10"),
    "inv_delegation": sql(EV, EDGES, ACT, INV, select=f"""SELECT {WS}, actor_id, CAST(past_chained AS BIGINT) AS past_chained,
        CAST(past_events AS BIGINT) AS past_events, i11 AS INV_011 FROM flags JOIN r11 USING (ws, actor_id)"""),
    "invariants": sql(EV, EDGES, ACT, INV, select=f"""SELECT {WS}, actor_id, inv_score, inv_count, fired AS fired_invariants FROM inv"""),
    "closure_watches": sql(EV, CLOSE, select="""SELECT resource_id, rt AS resource_type, oid AS opening_event_id, o AS opening_ts,
        actor_id AS opening_actor_id, ect AS expected_close_type, h AS window_hours, CAST(sens AS DOUBLE) AS sensitivity FROM wt"""),
    "closure_closed": sql(EV, CLOSE, select="SELECT resource_id, c[1] AS closing_ts, c[2] AS closing_event_id FROM ex"),
    "stream_watches": sql(EV, CLOSE, select="""SELECT resource_id, oid AS opening_event_id, least(ex_us, expiry, settled) AS closed_at,
        CASE least(ex_us, expiry, settled) WHEN ex_us THEN 'CLOSED' WHEN expiry THEN 'EXPIRED' WHEN settled THEN 'SETTLED' ELSE 'OPEN' END AS closed_by FROM cl"""),
    "closure_settled": sql(EV, CLOSE, select="""SELECT resource_id, strftime(make_timestamp(settled), '%Y-%m-%d %H:%M:%S') AS settled_ts FROM st"""),
    "closure_signals": sql(EV, CLOSE, _signals(True), select=f"""SELECT {WS}, actor_id, total AS total_watches, closed AS closed_watches,
        {r6('ratio')} AS closure_ratio, {r6('orphaned')} AS orphaned_privilege FROM cs"""),
    "closure_signals_lookahead": sql(EV, CLOSE, _signals(False), select=f"""SELECT {WS}, actor_id, total AS total_watches, closed AS closed_watches,
        {r6('ratio')} AS closure_ratio, {r6('orphaned')} AS orphaned_privilege FROM cs"""),
}

MINED = """
sens AS (SELECT target_id, us, event_id, action_type,
  row_number() OVER (PARTITION BY target_id ORDER BY us, event_id) AS p FROM ev WHERE target_zone IN ('IDENTITY','CONTROL','SECRET')),
nxt AS (SELECT a.target_id, a.p, a.action_type AS oa, a.us, min(b.p) AS q FROM sens a JOIN sens b
  ON b.target_id = a.target_id AND b.p > a.p AND b.action_type <> a.action_type GROUP BY ALL),
gaps AS (SELECT oa, b.action_type AS ca, (b.us - n.us) / 3.6e9 AS gap FROM nxt n JOIN sens b ON b.target_id = n.target_id AND b.p = n.q),
cand AS (SELECT oa, ca, count(*) AS n, list_sort(list(gap))[count(*) // 2 + 1] AS med FROM gaps WHERE gap <= 720 GROUP BY ALL HAVING count(*) >= 3)"""

ORACLE |= {
    "mine_pairs": sql(EV, MINED, select=f"""SELECT 'cp-' || oa || '-' || ca AS candidate_id, oa AS opening_action_type,
        ca AS closing_action_type, n AS obs_count, {r6('med')} AS median_gap_hours FROM cand"""),
    "promote_pairs": sql(EV, MINED, select="""SELECT 'disc-' || oa || '-' || ca AS pair_id, oa AS opening_action_type,
        ca AS closing_action_type, CAST(greatest(1, floor(2 * round_even(med, 1))) AS INTEGER) AS window_hours, 2 AS tier FROM cand
        WHERE n >= 5 AND NOT (oa = 'IAM_CREATE_KEY' AND ca = 'IAM_DELETE_KEY')"""),
    "candidate_status": sql(EV, MINED, select="""SELECT 'cp-' || oa || '-' || ca AS candidate_id, n AS obs_count, CASE WHEN n < 5 THEN NULL
        WHEN oa = 'IAM_CREATE_KEY' AND ca = 'IAM_DELETE_KEY' THEN 'existing' ELSE 'disc-' || oa || '-' || ca END AS promoted_to FROM cand"""),
    "fusion_score": sql(*FUSED, select=f"""SELECT {WS}, actor_id, inv_score, inv_count, {r6('novelty')} AS novelty_score,
        bridges AS bridge_new, {r6('sigma')} AS sigma_coarse, {r6('d')} AS delta_f, {r6('ratio')} AS closure_ratio,
        {r6('orphaned')} AS orphaned_privilege, {r6('fusion')} AS fusion_raw FROM fu"""),
    "lcs_zone_match": sql(EV, LCS, select=f"SELECT {WS}, actor_id, pid AS pattern_id, {r6('zone_score')} AS zone_score FROM zm"),
    "pattern_match": sql(EV, ACT, LCS, MATCH, select=f"""SELECT {WS}, actor_id, {r6('score')} AS pattern_match_score,
        pid AS matched_pattern_id FROM pm"""),
    "pattern_usage": sql(EV, ACT, LCS, MATCH, select="""SELECT pid AS pattern_id, count(DISTINCT ws) AS match_count,
        strftime(max(ws), '%Y-%m-%d %H:%M:%S') AS last_matched_ts FROM pm GROUP BY pid"""),
    "dominant_provenance": sql(EV, "dom AS (SELECT DISTINCT ON (ws, actor_id) ws, actor_id, provenance_level, trigger_ref FROM ev "
        "ORDER BY ws, actor_id, CASE provenance_level WHEN 'WEAK' THEN 2 ELSE 1 END DESC, ts, event_id)",
        select=f"SELECT {WS}, actor_id, provenance_level, trigger_ref FROM dom"),
    "trigger_chain": sql(EV, select="""SELECT trigger_ref, count(*) AS corroboration,
        trigger_ref LIKE 'sched:%' OR count(*) >= 2 AS resolved, 1 AS depth,
        CASE WHEN trigger_ref LIKE 'sched:%' THEN 'service-1@gcp-sa-cloudscheduler.iam.gserviceaccount.com'
             WHEN count(*) >= 2 THEN 'scheduler-job:' || split_part(trigger_ref, '/', 6) END AS terminal_initiator
        FROM ev WHERE trigger_ref IS NOT NULL GROUP BY trigger_ref"""),
    "enrich_provenance": sql(EV, select="""SELECT event_id, CASE WHEN trigger_ref IS NULL THEN 'NONE' ELSE 'WEAK' END AS provenance_level,
        CASE WHEN known AND actor_id LIKE '%@gcp-sa-cloudscheduler.iam.gserviceaccount.com' THEN 'CLOUD_SCHEDULER'
             ELSE 'UNKNOWN' END AS provenance_source FROM ev"""),
    "residual_risk": sql(*RISK, select=f"""SELECT {WS}, actor_id, {r6('fusion')} AS fusion_raw, {r6('score')} AS pattern_match_score,
        pid AS matched_pattern_id, provenance_level, resolved AS trigger_chain_resolved, {r6('residual')} AS residual_risk, tier FROM risk"""),
    "risk_energy": sql(*RISK, select=f"SELECT {WS}, actor_id, {r6('e')} AS risk_energy, level AS alert_level FROM lev"),
    "policy_suggestions": sql(*RISK, select=f"""SELECT sha256(CAST(epoch(ws) AS BIGINT) || '|' || actor_id) AS suggestion_id, {WS}, actor_id,
        {r6('e')} AS risk_energy, level AS alert_level, CASE level WHEN 'ALERT_HIGH' THEN 'ISOLATE_ACTOR'
        WHEN 'ALERT_MED' THEN 'REQUEST_REVIEW' ELSE 'INCREASE_MONITORING' END AS suggested_action FROM lev WHERE level <> 'NORMAL'"""),
    "tier_counts": sql(*RISK, select="SELECT tier, count(*) AS n FROM risk GROUP BY tier"),
}


# --- ingestion ---------------------------------------------------------------------

_METHODS = ", ".join(f"({i}, '{s}', '{m}', '{a}', '{z}')" for i, (s, m, a, z) in enumerate(METHOD_ACTIONS))
RAW = f"""
src AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
raw AS (SELECT *, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '123Z' AS stamp, 'i' || event_id AS insert_id,
  'p' || (user_id % 2) AS project_id,
  CASE WHEN event_type = 'error' AND k IN (5, 6) THEN 'malformed' WHEN event_type = 'signup' THEN 'scheduler'
    WHEN event_type = 'click' THEN 'request' WHEN event_type = 'error' AND k < 5 THEN 'unknown' ELSE 'audit' END AS log_format FROM src),
meth(i, svc, m, action, zone) AS (VALUES {_METHODS}),
aud0 AS (SELECT raw.*, 'v1.' || coalesce(m, 'Foo') AS method, coalesce(action, 'OTHER') AS action_type, coalesce(zone, 'DATA') AS zone,
  (user_id + k) % 9 AS ri,
  CASE (user_id + k) % 9 WHEN 0 THEN 'projects/p/serviceAccounts/a' WHEN 1 THEN 'projects/p/serviceAccounts/a/keys/'
    WHEN 2 THEN 'projects/p/secrets/s' WHEN 3 THEN 'projects/p/cryptoKeys/c' WHEN 4 THEN 'projects/_/buckets/external-b/objects/o'
    WHEN 5 THEN 'projects/_/buckets/inner/objects/o' WHEN 6 THEN 'bigquery.googleapis.com/projects/public-x/d'
    WHEN 7 THEN 'zones/z/instances/i' END || (k % 5) AS res,
  CASE WHEN user_id % 5 = 0 THEN 'unknown' WHEN user_id % 5 = 1 THEN 'svc' || user_id || '@gcp-sa-logging.iam.gserviceaccount.com'
    WHEN user_id % 5 = 2 THEN 'w' || user_id || '@p.iam.gserviceaccount.com' ELSE 'h' || user_id || '@example.com' END AS actor
  FROM raw LEFT JOIN meth ON meth.i = (user_id * 7 + k) % 26 WHERE log_format = 'audit'),
aud AS (SELECT *, coalesce(res, 'unknown') AS target_id,
  substr(sha256(stamp || '|' || actor || '|' || method || '|' || coalesce(res, 'unknown') || '|' || insert_id), 1, 32) AS eid,
  zone = 'DATA' AND action_type IN ('GCS_READ','GCS_WRITE','GCS_LIST','BQ_JOB_SUBMIT') AND ri IN (4, 6) AS leaves FROM aud0)"""

ORACLE |= {
    "scan_raw_logs": sql(RAW, select="""SELECT CASE WHEN event_type = 'click' THEN 'run.googleapis.com'
        ELSE 'cloudaudit.googleapis.com/activity' END AS source, CASE WHEN log_format <> 'malformed' THEN insert_id END AS insert_id,
        CAST(sum(CASE WHEN k % 5 IN (2, 3) THEN 2 ELSE 1 END) AS BIGINT) AS n FROM raw GROUP BY ALL"""),
    "incremental_files": sql("""f AS (SELECT DISTINCT event_type AS source, event_type || '/' || strftime(ts, '%Y/%m/%d/%H') || '.jsonl' AS path FROM events)""",
        select="""SELECT source, count(*) AS n_new, min(path) AS first_new, max(path) AS last_path FROM f
        WHERE source = 'view' OR path > source || '/2024/01/15/12.jsonl' GROUP BY source"""),
    "route_formats": sql(RAW, select="SELECT event_id, log_format FROM raw"),
    "ingest_stats": sql(RAW, select="""SELECT log_format, CASE log_format WHEN 'malformed' THEN 'error' WHEN 'unknown' THEN 'skipped'
        ELSE 'parsed' END AS status, count(*) AS n FROM raw GROUP BY ALL"""),
    "quarantined_entries": sql(RAW, select="SELECT event_id, log_format FROM raw WHERE log_format = 'malformed'"),
    "canonicalize_audit": sql(RAW, select="""SELECT eid AS event_id, us AS ts,
        strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, actor AS actor_id, method AS action_subtype,
        target_id, CASE WHEN k % 7 = 0 THEN 'FAIL' ELSE 'SUCCESS' END AS result, project_id,
        CASE WHEN user_id % 3 = 0 THEN 'projects/p/locations/l/jobs/' || (user_id % 7) END AS trigger_ref,
        CASE WHEN user_id % 3 = 0 THEN 'WEAK' ELSE 'NONE' END AS provenance_level, CASE WHEN user_id % 4 = 0 THEN 'd1' ELSE '' END AS delegation_chain,
        'projects/p/logs/cloudaudit.googleapis.com%2Factivity:' || insert_id AS raw_ref, 'sandbox' AS env, false AS is_deploy FROM aud"""),
    "bootstrap_intervals": sql("""
eq AS (SELECT o_orderstatus AS k, CAST(floor(CAST(o_totalprice AS DOUBLE) / 1000) AS BIGINT) AS v, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS y, count(*) AS n
  FROM orders GROUP BY ALL),
ch AS (SELECT k, v, y, c, least(64, n - 64 * c) AS m, md5('42|' || k || '|' || (v * 1000000000) || '|' || y || '|' || c) AS h
  FROM (SELECT *, unnest(range(0, CAST(ceil(n / 64.0) AS BIGINT))) AS c FROM eq)),
th AS (SELECT CAST(m AS BIGINT) AS m, CAST(0 AS BIGINT) AS i, exp(-CAST(m AS DOUBLE)) AS p, exp(-CAST(m AS DOUBLE)) AS c FROM range(1, 65) AS r(m)
  UNION ALL SELECT m, i + 1, p * m / (i + 1), c + p * m / (i + 1) FROM th WHERE c + p * m / (i + 1) > c OR i + 1 < m),
cdf AS (SELECT m, list(c ORDER BY i) AS steps FROM th GROUP BY m),
u AS (SELECT k, v, y, m, r, CAST((('0x' || substr(h, 1, 8))::BIGINT % 2147483647 * (r * r) % 2147483647 + ('0x' || substr(h, 9, 8))::BIGINT % 2147483647 * r
  + ('0x' || substr(h, 17, 8))::BIGINT % 2147483647) % 2147483647 AS DOUBLE) / 2147483647 AS u FROM ch, range(1, 201) AS q(r)),
dr AS (SELECT k, v, r, sum(w) AS n, sum(w * y) AS p FROM (SELECT u.*, len(list_filter(steps, lambda s: s <= u.u)) AS w FROM u JOIN cdf USING (m)) GROUP BY ALL),
cu AS (SELECT k, r, p, sum(n) OVER o AS un, sum(p) OVER o AS up FROM dr WINDOW o AS (PARTITION BY k, r ORDER BY v DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT k, r, sum(CASE WHEN p > 0 THEN up / un * p ELSE 0 END) / sum(p) AS ap FROM cu GROUP BY k, r HAVING sum(p) > 0)""",
        select=f"SELECT k AS o_orderstatus, {r6('quantile_cont(ap, 0.025)')} AS ci_lower, {r6('quantile_cont(ap, 0.975)')} AS ci_upper FROM ap GROUP BY k").replace("WITH ", "WITH RECURSIVE ", 1),
    "stream_canonical": sql(RAW, select="""SELECT eid AS event_id, us AS ts, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
        actor AS actor_id, method AS action_subtype, target_id, CASE WHEN user_id % 3 = 0 THEN 'projects/p/locations/l/jobs/' || (user_id % 7) END AS trigger_ref FROM aud"""),
    "known_accounts": sql(EV, """k AS (SELECT DISTINCT 'u' || user_id || '@p.iam.gserviceaccount.com' AS actor_id FROM events WHERE user_id % 6 = 0
        UNION SELECT 'service-1@gcp-sa-cloudscheduler.iam.gserviceaccount.com')""",
        select="SELECT k.actor_id, count(ev.event_id) AS n_events FROM k LEFT JOIN ev ON ev.actor_id = k.actor_id GROUP BY k.actor_id"),
    "pattern_registry": sql("""n AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS rate_max FROM events GROUP BY user_id)""",
        select="""SELECT 'p' || user_id AS pattern_id, rate_max, CASE WHEN user_id % 2 = 0 THEN 'first' ELSE 'second' END AS origin FROM n
        WHERE (user_id % 2 = 0 OR user_id % 3 = 0) AND NOT (user_id % 10 = 0) AND user_id <> 12"""),
    "event_content_id": sql(RAW, select="SELECT insert_id, eid AS event_id FROM aud"),
    "map_actions": sql(RAW, select="""SELECT eid AS event_id, action_type, CASE WHEN leaves THEN 'EXFIL_RISK_DEST' ELSE
        CASE ri WHEN 0 THEN 'SERVICE_ACCOUNT' WHEN 1 THEN 'SERVICE_ACCOUNT' WHEN 2 THEN 'SECRET' WHEN 3 THEN 'KMS_KEY' WHEN 4 THEN 'GCS_BUCKET'
        WHEN 5 THEN 'GCS_BUCKET' WHEN 6 THEN 'BIGQUERY' WHEN 7 THEN 'COMPUTE' ELSE 'OTHER' END END AS target_type,
        CASE WHEN leaves THEN 'EXFIL_RISK' ELSE zone END AS target_zone FROM aud"""),
    "exfil_reclass": sql(RAW, select="SELECT action_type, target_id, count(*) AS n FROM aud WHERE leaves GROUP BY ALL"),
    "actor_class": sql(RAW, select="""SELECT DISTINCT actor AS actor_id, CASE WHEN user_id % 5 = 0 THEN 'UNKNOWN' WHEN user_id % 5 < 3
        THEN 'SERVICE_ACCOUNT' ELSE 'HUMAN' END AS actor_type, user_id % 5 = 1 AS is_infrastructure FROM aud"""),
    "parse_ts": """SELECT event_id, form, CASE form WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) // 1000 * 1000
        WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000 END AS parsed FROM events, (SELECT unnest([0, 1, 2, 3]) AS form)""",
    "floor_window": """SELECT event_id, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS w15,
        strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS w5 FROM events""",
    "canonicalize_scheduler": sql(RAW, select="""SELECT insert_id, 'j' || (user_id % 7) AS job_id, 'https://s' || (user_id % 3) || '/' AS target_url,
        CASE WHEN k < 80 THEN 'AttemptStarted' ELSE 'AttemptFinished' END AS attempt_type, us AS at, CASE WHEN k < 80 THEN us END AS scheduled,
        CASE WHEN k >= 80 THEN 500 END AS http_status, project_id FROM raw WHERE log_format = 'scheduler'"""),
    "canonicalize_requests": sql(RAW, select="""SELECT insert_id, 's' || (user_id % 3) AS service_name, 'https://s' || (user_id % 3) AS request_url,
        200 AS status_code, us AS at, round(k / 1000.0, 6) AS latency_seconds, k < 80 AS is_scheduler_invoked, project_id
        FROM raw WHERE log_format = 'request'"""),
    "dedup_events": sql(RAW, select="""SELECT DISTINCT eid AS event_id, 1 AS arrival, actor AS actor_id FROM aud
        WHERE substr(eid, 32, 1) NOT IN ('0', '2', '4', '6')"""),
}

CORR = """
src AS (SELECT *, epoch_us(ts) AS us, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
  lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'p' || (user_id % 2) AS project_id FROM events),
runs AS (SELECT project_id, id, us, 'https://s' || (user_id % 3) AS url FROM src WHERE event_type = 'signup'),
calls AS (SELECT project_id, id, us, k, 's' || (user_id % 3) AS svc, 'https://s' || (user_id % 3) AS url FROM src
  WHERE event_type = 'click' AND k < 80),
aud AS (SELECT id, us, 'w' || (user_id % 4) AS actor_id, CASE WHEN user_id % 4 < 3 THEN 's' || (user_id % 4) END AS svc
  FROM src WHERE event_type = 'purchase'),
g0 AS (SELECT project_id, (us - lag(us) OVER (PARTITION BY project_id ORDER BY us, id)) / 1e6 AS gap FROM runs),
cad AS (SELECT project_id, list_sort(list(gap))[count(*) // 2 + 1] AS cadence FROM g0 WHERE gap > 0 GROUP BY project_id),
links AS (SELECT project_id, 'r' || id AS sid, id AS rid, k % 2 = 0 AS url_match, 'j' || (k % 7) AS job, us - k::BIGINT * 60000000 AS sched, svc, us AS req FROM calls),
cnt AS (SELECT l.sid, count(c.id) AS n FROM links l LEFT JOIN calls c ON c.svc = l.svc AND c.us >= l.sched AND c.us <= l.sched + 3600000000 GROUP BY l.sid),
best AS (SELECT a.id, a.us, l.*, row_number() OVER (PARTITION BY a.id ORDER BY l.req DESC, l.sched, l.sid) AS rn FROM aud a
  JOIN links l ON l.svc = a.svc AND a.us >= l.req AND a.us - l.req < 7200000000),
cor AS (SELECT a.id, a.actor_id, b.* EXCLUDE (id), n, cadence FROM aud a LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON b.id = a.id
  LEFT JOIN cnt ON cnt.sid = b.sid LEFT JOIN cad ON cad.project_id = b.project_id),
obsv AS (SELECT l.svc, a.actor_id, count(*) AS n FROM links l JOIN aud a ON a.us >= l.req AND a.us <= l.req + 7200000000 GROUP BY ALL),
top AS (SELECT DISTINCT ON (svc) svc, actor_id, n FROM obsv ORDER BY svc, n DESC, actor_id),
cfg(svc, w) AS (VALUES ('s0', 'w0'), ('s1', 'w1'), ('s2', 'w2'), ('s9', 'w9')),
val AS (SELECT coalesce(top.svc, cfg.svc) AS service_name, w AS configured_worker, actor_id AS observed_worker, coalesce(n, 0) AS n_events,
  CASE WHEN actor_id IS NULL THEN 'unobserved' WHEN w IS NULL THEN 'discovered' WHEN w = actor_id THEN 'confirmed' ELSE 'mismatched' END AS status
  FROM top FULL JOIN cfg ON top.svc = cfg.svc)"""

# One pass in time order per project, carrying the used requests along.
GREEDY = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY us, id) AS i FROM runs),
walk AS (SELECT DISTINCT project_id, 0::BIGINT AS i, []::VARCHAR[] AS used, ''::VARCHAR AS sid, NULL::VARCHAR AS rid, false AS url_match FROM runs
  UNION ALL
  SELECT w.project_id, o.i, CASE WHEN p.c IS NULL THEN w.used ELSE list_append(w.used, p.c.id) END, o.id, p.c.id, coalesce(p.c.hit, false)
  FROM walk w JOIN ordered o ON o.project_id = w.project_id AND o.i = w.i + 1
  LEFT JOIN LATERAL (SELECT arg_min({'id': c.id, 'hit': c.url = o.url}, (c.url <> o.url, c.us, c.id)) AS c FROM calls c
    WHERE c.project_id = o.project_id AND c.us >= o.us AND c.us < o.us + 3600000000 AND NOT list_contains(w.used, c.id)) p ON true)"""

ORACLE |= {
    "link_sched_requests": sql(CORR, GREEDY, select="""SELECT walk.project_id, sid AS scheduler_id, rid AS request_id, url_match, svc AS service_name
        FROM walk JOIN calls ON calls.id = rid""").replace("WITH ", "WITH RECURSIVE ", 1),
    "sched_cadence": sql(CORR, select=f"SELECT project_id, {r6('cadence')} AS cadence_seconds FROM cad"),
    "link_candidates": sql(CORR, select="SELECT sid AS scheduler_id, n AS candidate_count FROM cnt"),
    "correlate_audit": sql(CORR, select="""SELECT id AS event_id, actor_id, CASE WHEN sid IS NOT NULL THEN 'sched:' || job || ':' || (sched // 1000000) END AS trigger_ref,
        sid AS scheduler_id, rid AS request_id FROM cor"""),
    "correlation_confidence": sql(CORR, select="""SELECT id AS event_id, CASE WHEN sid IS NULL THEN 0.0 ELSE round_even(least(1.0e0,
        0.4e0 + 0.3e0 * CASE WHEN url_match THEN 1 ELSE 0 END + 0.2e0 / greatest(n, 1) + 0.1e0 * greatest(0.0e0, 1.0e0 - (us - req) / 1e6 / cadence)), 4) END
        AS correlation_confidence FROM cor"""),
    "validate_service_map": sql(CORR, select="SELECT * FROM val"),
    "hydration_summary": sql(CORR, select="""SELECT count(configured_worker) AS configured, count(*) FILTER (status = 'confirmed') AS confirmed,
        count(*) FILTER (status = 'mismatched') AS mismatched, min(n_events) AS min_observations,
        count(configured_worker) = count(*) FILTER (status = 'confirmed') AND count(*) FILTER (status = 'mismatched') = 0 AND min(n_events) > 0 AS hydration_complete FROM val"""),
}


# --- ablation and detection ------------------------------------------------------------

def _named(cte: str, source: str) -> str:
    """Rows with role and scenario derived from the user number."""
    return f"""{cte} AS (SELECT *, CAST(regexp_extract(actor_id, '^u([0-9]+)', 1) AS BIGINT) AS u,
  ['worker','attacker','reader','other'][CAST(CAST(regexp_extract(actor_id, '^u([0-9]+)', 1) AS BIGINT) % 4 + 1 AS INTEGER)] AS role,
  's' || (CAST(regexp_extract(actor_id, '^u([0-9]+)', 1) AS BIGINT) % 5) AS scenario FROM {source})"""


ABL = """
ab AS (SELECT *, a0 - fusion AS delta, CASE WHEN fusion >= .8 THEN 'HIGH' WHEN fusion >= .5 THEN 'MEDIUM' WHEN fusion >= .005 THEN 'WATCH' ELSE 'NORMAL' END AS old_tier,
  CASE WHEN a0 >= .8 THEN 'HIGH' WHEN a0 >= .5 THEN 'MEDIUM' WHEN a0 >= .005 THEN 'WATCH' ELSE 'NORMAL' END AS new_tier
  FROM (SELECT *, (.17 * s1 + .13 * s2 + .30 * s3 + .04 * s4 + .13 * s5 + .08 * s6) / .85 AS a0 FROM fu))"""
ROLES = _named("nr", "ab")
RISKN = _named("rn", "risk")
ABLATED, SCENES = (*FUSED, ABL), (*RISK, RISKN)
_SIG = {"inv_score": "inv_score", "novelty_score": "novelty", "sigma_coarse": "sigma", "bridge_new": "bridges", "delta_f": "d",
        "closure_gap": "1 - ratio", "orphaned_priv": "orphaned"}
_NR = lambda p: f"list_sort(list(residual))[CAST(round_even((count(*) - 1) * {p}, 0) AS BIGINT) + 1]"
_SETS = """
sets AS (SELECT 'overall' AS axis, 'all' AS level, * FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus, * FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, * FROM orders)"""
RECAL = f"""
att AS (SELECT {_NR(0.75)} AS p75, {_NR(0.90)} AS p90, {_NR(0.95)} AS p95 FROM rn WHERE u % 10 = 0),
ben AS (SELECT {_NR(0.95)} AS b95 FROM rn WHERE u % 10 <> 0),
lim AS (SELECT greatest(p75, b95) AS watch, p90 AS medium, p95 AS high, b95 AS benign_p95 FROM att, ben)"""

ORACLE |= {
    "ablation": sql(*ABLATED, select=f"""SELECT {WS}, actor_id, {r6('fusion')} AS fusion_raw, {r6('a0')} AS ablated, {r6('delta')} AS delta,
        old_tier, new_tier FROM ab"""),
    "tier_migration": sql(*ABLATED, select="SELECT old_tier, new_tier, count(*) AS n FROM ab GROUP BY ALL"),
    "ablation_stats": sql(*ABLATED, select=f"""SELECT {r6('avg(abs(delta))')} AS mean, {r6('median(abs(delta))')} AS median,
        {r6('stddev_samp(abs(delta))')} AS stdev, {r6('max(abs(delta))')} AS max FROM ab"""),
    "ablation_top": sql(*ABLATED, select=f"""SELECT {WS}, actor_id, {r6('delta')} AS delta, (SELECT string_agg(s, ',' ORDER BY v DESC, i) FROM (
        SELECT * FROM (VALUES (.17 * s1, 0, 'inv_score'), (.13 * s2, 1, 'inv_count'), (.30 * s3, 2, 'novelty_score'), (.04 * s4, 3, 'sigma_coarse'),
        (.13 * s5, 4, 'bridge_new'), (.08 * s6, 5, 'delta_f'), (.10 * s7, 6, 'closure_gap'), (.05 * s8, 7, 'orphaned_priv')) t(v, i, s)
        ORDER BY v DESC, i LIMIT 3)) AS dominant_signals FROM (SELECT * FROM ab ORDER BY abs(delta) DESC, ws, actor_id LIMIT 10)"""),
    "role_stats": sql(*ABLATED, ROLES, select=f"""SELECT role, count(*) AS count, {r6('avg(fusion)')} AS baseline_mean, {r6('stddev_samp(fusion)')} AS baseline_stdev,
        {r6('avg(a0)')} AS zero_mean, {r6('stddev_samp(a0)')} AS zero_stdev, {r6('avg(a0)')} AS redist_mean, {r6('stddev_samp(a0)')} AS redist_stdev,
        {r6('avg(CASE WHEN 1 - ratio > 0.001 THEN 100.0 ELSE 0 END)')} AS closure_gap_active_pct,
        {r6('avg(CASE WHEN orphaned > 0.001 THEN 100.0 ELSE 0 END)')} AS orphaned_priv_active_pct,
        count(*) FILTER (old_tier <> new_tier) AS tier_changes_zero, count(*) FILTER (old_tier <> new_tier) AS tier_changes_redist,
        {r6("avg(fusion) / (SELECT avg(fusion) FROM nr WHERE role = 'worker')")} AS gap_baseline,
        {r6("avg(a0) / (SELECT avg(a0) FROM nr WHERE role = 'worker')")} AS gap_zero,
        {r6("avg(a0) / (SELECT avg(a0) FROM nr WHERE role = 'worker')")} AS gap_redist FROM nr GROUP BY role"""),
    "role_extract": """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE lower(c_mktsegment) END AS role, count(*) AS n FROM customer GROUP BY ALL""",
    "scenario_summary": sql(*SCENES, select=f"""SELECT scenario, {r6('max(residual)')} AS max_residual, {r6('avg(residual)')} AS mean_residual,
        arg_max(tier, CASE tier WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'WATCH' THEN 1 ELSE 0 END) AS max_tier,
        (SELECT string_agg(DISTINCT f, ',' ORDER BY f) FROM (SELECT scenario AS sc, unnest(string_split(fired, ',')) AS f FROM rn JOIN inv USING (ws, actor_id))
         WHERE sc = rn.scenario AND f <> '') AS fired_invariants, count(*) AS n_pairs FROM rn GROUP BY scenario"""),
    "role_gap": sql(*SCENES, "pa AS (SELECT scenario, role, actor_id, avg(residual) AS m, count(*) AS n, count(*) FILTER (tier IN ('HIGH','MEDIUM')) AS h "
        "FROM rn GROUP BY ALL), rg AS (SELECT scenario, coalesce(avg(m) FILTER (role = 'attacker'), 0) AS am, coalesce(avg(m) FILTER (role = 'worker'), 0) AS wm, "
        "coalesce(sum(h) FILTER (role = 'worker') / sum(n) FILTER (role = 'worker'), 0) AS fp, "
        "coalesce(sum(n - h) FILTER (role = 'attacker') / sum(n) FILTER (role = 'attacker'), 0) AS fn FROM pa GROUP BY scenario)",
        select=f"""SELECT scenario, {r6('am')} AS attacker_mean, {r6('wm')} AS worker_mean, {r6('fp')} AS fp_rate, {r6('fn')} AS fn_rate,
        {r6('CASE WHEN wm > 0 THEN (am - wm) / wm * 100 WHEN am > 0 THEN 100.0 ELSE 0.0 END')} AS gap_pct FROM rg"""),
    "signal_activation": sql(*SCENES, select="SELECT scenario, " + ", ".join(
        f"round(avg(CASE WHEN {e} THEN 1.0 ELSE 0 END), 6) AS {n}" for n, e in (("inv_score", "inv_score > 0"), ("novelty_score", "novelty > 0"),
        ("bridge_new", "bridges > 0"), ("closure_gap", "ratio < 1"), ("orphaned_priv", "orphaned > 0"), ("trigger_resolved", "resolved"))) +
        " FROM rn GROUP BY scenario"),
    "signal_max": sql(*SCENES, select="SELECT actor_id, round(max(residual), 6) AS residual_risk_max, " + ", ".join(
        f"{r6(f'CAST(max({e}) AS DOUBLE)')} AS {s}_max, max({e}) > 0 AS {s}_fired" for s, e in _SIG.items()) + " FROM rn GROUP BY actor_id"),
    "prediction_divergence": sql(*SCENES, "pd AS (SELECT u, s, f, CASE WHEN u % 2 = 0 THEN s IN ('inv_score', 'delta_f') ELSE s = 'closure_gap' END AS ex FROM (" +
        " UNION ALL ".join(f"SELECT u, '{s}' AS s, max({e}) > 0 AS f FROM rn GROUP BY u" for s, e in _SIG.items()) + "))",
        select="""SELECT s AS signal, count(*) FILTER (ex AND f) AS expected_fired, count(*) FILTER (ex AND NOT f) AS expected_silent,
        count(*) FILTER (NOT ex AND f) AS unexpected_fired, count(*) FILTER (NOT ex AND NOT f) AS unexpected_silent FROM pd GROUP BY s"""),
    "sweep_report": sql(_SETS, select="""SELECT axis, level, count(*) AS runs, round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice), 3) AS std,
        round(min(o_totalprice), 3) AS min, round(max(o_totalprice), 3) AS max, round(median(o_totalprice), 3) AS median FROM sets GROUP BY ALL"""),
    "detection_by_axis": sql(_SETS, "rt AS (SELECT axis, level, count(*) AS n, avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0 END) AS rate FROM sets GROUP BY ALL)",
        select=f"""SELECT axis, level, n, {r6('rate')} AS rate, CASE WHEN o >= .8 AND z > 0 THEN 'PASS' WHEN o >= .8 THEN 'CLASS-WIPE' WHEN o >= .6 THEN 'BORDERLINE'
        ELSE 'FAIL' END AS verdict FROM rt, (SELECT max(rate) FILTER (axis = 'overall') AS o, min(rate) AS z FROM rt)"""),
    "blind_spots": """SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE NOT o_totalprice > 200000
        ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 30""",
    "residual_percentiles": sql(*SCENES, select="SELECT scenario, count(*) AS n, " + ", ".join(
        f"{r6(_NR(p))} AS p{int(p * 100)}" for p in (0.50, 0.75, 0.90, 0.95, 0.99)) + " FROM rn GROUP BY scenario"),
    "recalibrate": sql(*SCENES, RECAL, select=f"SELECT {r6('watch')} AS watch, {r6('medium')} AS medium, {r6('high')} AS high, {r6('benign_p95')} AS benign_p95 FROM lim"),
    "recalibrated_tiers": sql(*SCENES, RECAL, select="""SELECT CASE WHEN residual >= high THEN 'HIGH' WHEN residual >= medium THEN 'MEDIUM' WHEN residual >= watch THEN 'WATCH'
        ELSE 'NORMAL' END AS recal_tier, residual >= watch AS recal_detected, count(*) AS n FROM rn, lim WHERE u % 10 = 0 GROUP BY ALL"""),
    "embed_in_baseline": sql(EV, select=f"""SELECT {WS}, 'attack-' || actor_id AS actor_id, count(*) AS event_count, count(DISTINCT target_id) AS n_targets
        FROM ev WHERE user_id % 10 = 0 GROUP BY ws, actor_id UNION ALL
        SELECT {WS}, actor_id, count(*), count(DISTINCT target_id) FROM ev GROUP BY ws, actor_id"""),
    "separation_stats": """SELECT l_returnflag, count(*) AS count, round(avg(l_extendedprice), 3) AS mean, round(stddev_pop(l_extendedprice), 3) AS std,
        round(min(l_extendedprice), 3) AS min, round(quantile_cont(l_extendedprice, 0.25), 3) AS p25, round(quantile_cont(l_extendedprice, 0.5), 3) AS p50,
        round(quantile_cont(l_extendedprice, 0.75), 3) AS p75, round(quantile_cont(l_extendedprice, 0.9), 3) AS p90, round(max(l_extendedprice), 3) AS max
        FROM lineitem GROUP BY l_returnflag""",
    "separation_odd_values": """SELECT category, count(*) AS count, round(min(v), 2) AS min, round(quantile_cont(v, 0.25), 2) AS p25,
        round(quantile_cont(v, 0.5), 2) AS p50, round(quantile_cont(v, 0.75), 2) AS p75, round(quantile_cont(v, 0.9), 2) AS p90, round(max(v), 2) AS max
        FROM (SELECT nullif(l_returnflag, 'N') AS category, CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN 1e12 ELSE CAST(l_extendedprice AS DOUBLE) END AS v
        FROM lineitem) GROUP BY category""",
    "effect_size": """SELECT round(am, 3) AS attack_mean, round(bm, 3) AS benign_mean, round((am - bm) / sqrt((sa * sa + sb * sb) / 2), 6) AS cohens_d,
        round(am / bm, 6) AS separation_ratio FROM (SELECT avg(l_extendedprice) FILTER (l_returnflag = 'R') AS am, avg(l_extendedprice) FILTER (l_returnflag <> 'R') AS bm,
        stddev_pop(l_extendedprice) FILTER (l_returnflag = 'R') AS sa, stddev_pop(l_extendedprice) FILTER (l_returnflag <> 'R') AS sb FROM lineitem)""",
}

# --- trajectories ------------------------------------------------------------------------

TR = """
tr0 AS (SELECT 'u' || user_id AS actor, user_id, us / 1e6 AS t, event_id AS seq, lag(target_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src,
  target_id AS dst, event_type AS action FROM ev),
tr AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY t, seq) AS p, count(*) OVER (PARTITION BY actor) AS n FROM tr0 WHERE src IS NOT NULL)"""
BAL = """
bal AS (SELECT actor, src, dst, action, sum(f) AS f, sum(b) AS b FROM (SELECT actor, src, dst, action, 1 AS f, 0 AS b FROM tr
  UNION ALL SELECT actor, dst, src, action, 0, 1 FROM tr) GROUP BY ALL)"""


def _excess(window_rows: str, base_rows: str, key: str) -> str:
    """Smoothed divergence of window rows from baseline rows, straight from its definition."""
    return f"""
wc AS (SELECT {key}, src, dst, action, count(*) AS w FROM ({window_rows}) GROUP BY ALL),
bc AS (SELECT {key}, src, dst, action, count(*) AS b FROM ({base_rows}) GROUP BY ALL),
un AS (SELECT {key}, src, dst, action, coalesce(w, 0) AS w, coalesce(b, 0) AS b FROM wc FULL JOIN bc USING ({key}, src, dst, action)),
tot AS (SELECT {key}, sum(w) AS tw, sum(b) AS tb, count(*) AS e FROM un GROUP BY {key}),
exs AS (SELECT {key}, any_value(tw) AS tw, any_value(tb) AS tb, CASE WHEN any_value(tb) = 0 THEN 0.0 ELSE greatest(0.0, sum((w + 1) / (tw + e) *
  ln(((w + 1) / (tw + e)) / ((b + 1) / (tb + e))))) END AS score FROM un JOIN tot USING ({key}) WHERE tw > 0 GROUP BY {key})"""


def _roll(stride: int) -> str:
    ends = f"SELECT actor AS ea, p AS pe FROM tr WHERE p >= 20 AND (p - 20) % {stride} = 0"
    return _excess(f"SELECT tr.*, pe FROM tr JOIN ({ends}) ON ea = actor AND p > pe - 20 AND p <= pe",
                   f"SELECT tr.*, pe FROM tr JOIN ({ends}) ON ea = actor AND p <= pe - 20", "actor, pe")


BUDGET = """
al AS (SELECT actor, t AS wt, max(round(score, 9)) AS score FROM exs JOIN tr USING (actor) WHERE p = pe GROUP BY ALL),
bu AS (SELECT *, CAST(floor(wt / 86400) AS BIGINT) AS day, row_number() OVER (PARTITION BY floor(wt / 86400) ORDER BY score DESC, actor, wt) AS rk FROM al QUALIFY rk <= 3),
camp AS (SELECT 'u' || user_id AS actor, min(us) / 1e6 AS ts0, min(us) / 1e6 + 3 * 86400 AS te, 'f' || ((user_id // 10) % 5) AS flavor FROM ev WHERE user_id % 10 = 0 GROUP BY user_id),
det AS (SELECT c.*, (SELECT arg_min({'t': wt, 's': score, 'd': day}, (-score, wt)) FROM bu WHERE bu.actor = c.actor AND wt BETWEEN ts0 AND te) AS a FROM camp c)"""
CAMP = """
camp AS (SELECT 'u' || user_id AS actor, min(us) / 1e6 AS ts0, min(us) / 1e6 + 3 * 86400 AS te, 'f' || ((user_id // 10) % 5) AS flavor FROM ev WHERE user_id % 10 = 0 GROUP BY user_id)"""
SPANS = """
wd AS (SELECT median(te - ts0) AS w FROM camp),
life AS (SELECT actor, min(t) AS lo, max(t) AS hi, any_value(w) AS w FROM tr, wd GROUP BY actor),
sp AS (SELECT actor, i AS span, lo + i * w AS a, lo + (i + 1) * w AS b FROM (SELECT *, unnest(range(CAST(floor((hi - lo) / w) AS BIGINT))) AS i FROM life)),
ok AS (SELECT * FROM sp WHERE NOT EXISTS (SELECT 1 FROM camp c WHERE c.actor = sp.actor AND NOT (b <= ts0 OR a >= te))),
smp AS (SELECT actor, a, b, 'benign' AS flavor FROM ok UNION ALL SELECT actor, ts0, te, flavor FROM camp),
srow AS (SELECT s.actor, s.flavor, s.a, src, dst, action FROM smp s JOIN tr ON tr.actor = s.actor AND t >= s.a AND t < s.b),
deg AS (SELECT actor, flavor, a, node, count(*) AS dg FROM (SELECT actor, flavor, a, unnest([src, dst]) AS node FROM srow) GROUP BY ALL),
dsum AS (SELECT actor, flavor, a, count(*) AS r, max(dg) AS dmax, avg(dg) AS davg FROM deg GROUP BY ALL),
feat AS (SELECT s.actor, s.flavor, s.a, count(r.src) AS n, count(DISTINCT r.src || '>' || r.dst || '>' || r.action) AS e, count(DISTINCT r.action) AS na
  FROM smp s LEFT JOIN srow r ON r.actor = s.actor AND r.flavor = s.flavor AND r.a = s.a GROUP BY ALL)"""
_INNER, _OUTER = (p.hex() for p in hmac_pads(seed_salt(7)))
_H = lambda c: f"substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({c})))), 1, 16)"

ORACLE |= {
    "trajectories": sql(EV, TR, select="SELECT actor, seq, src, dst, action, p AS position FROM tr"),
    "trajectory_slice": sql(EV, TR, """sl AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY t, seq) AS q FROM tr
        WHERE t >= 1704067200 + 5 * 86400 AND t < 1704067200 + 20 * 86400)""",
        select="SELECT actor, count(DISTINCT s) AS n_states FROM (SELECT actor, unnest([src, dst]) AS s FROM sl WHERE q <= 10) GROUP BY actor"),
    "trajectory_reversed": sql(EV, TR, select="SELECT actor, seq, dst AS src, src AS dst, round(max(t) OVER (PARTITION BY actor) - t, 3) AS t FROM tr"),
    "kl_irreversibility": sql(EV, TR, BAL, "z AS (SELECT actor, sum(f) AS n, count(*) AS e FROM bal GROUP BY actor)",
        select=f"SELECT actor, {r6('greatest(0.0, sum((f + 1) / (n + e) * ln((f + 1) / (b + 1))))')} AS kl FROM bal JOIN z USING (actor) GROUP BY actor"),
    "flux_divergence": sql(EV, TR, BAL, select=f"""SELECT actor, CAST(sum(f) AS BIGINT) AS n_transitions, {r6('sum(abs(f - b)) / sum(f)')} AS flux_l1,
        {r6('max(abs(f - b)) / sum(f)')} AS flux_max FROM bal GROUP BY actor HAVING sum(f) >= 2"""),
    "node_divergence": sql(EV, TR, select=f"""SELECT actor, node, {r6('sum(s) / any_value(n)')} AS divergence FROM (SELECT actor, n, src AS node, 1 AS s FROM tr
        UNION ALL SELECT actor, n, dst, -1 FROM tr) GROUP BY actor, node"""),
    "excess_kl": sql(EV, TR, "lw AS (SELECT actor AS la, min(t) AS t0, max(t) AS t1 FROM tr WHERE p > n - 20 AND n > 20 GROUP BY actor)",
        _excess("SELECT tr.* FROM tr JOIN lw ON la = actor AND t BETWEEN t0 AND t1", "SELECT tr.* FROM tr JOIN lw ON la = actor AND t < t0", "actor"),
        select=f"SELECT actor, CAST(tw AS BIGINT) AS n_window, CAST(tb AS BIGINT) AS n_baseline, {r6('score')} AS excess FROM exs"),
    "rolling_excess": sql(EV, TR, _roll(1), select=f"SELECT actor, pe AS end_position, {r6('score')} AS score FROM exs"),
    "entropy_rate": sql(EV, TR, """hc AS (SELECT actor, (p - 1) // 20 AS half, dst, count(*) AS c FROM tr WHERE p <= 40 AND n >= 40 GROUP BY ALL),
        hh AS (SELECT actor, half, -sum(c / 20 * ln(c / 20)) AS h FROM hc GROUP BY ALL)""",
        select=f"SELECT actor, {r6('(max(h) FILTER (half = 1) - max(h) FILTER (half = 0)) / 20')} AS entropy_rate FROM hh GROUP BY actor"),
    "transitions_per_actor": sql(EV, TR, select="SELECT actor, count(*) AS n_transitions FROM tr GROUP BY actor"),
    "pseudonymize": sql(EV, TR, "tk AS (SELECT action, format('T{:03d}', row_number() OVER (ORDER BY action)) AS token FROM (SELECT DISTINCT action FROM tr))",
        select=f"""SELECT {_H('actor')} AS actor, {_H('src')} AS src, {_H('dst')} AS dst, token AS action,
        round(t + (CAST('0x' || left(md5('7|' || actor || '|' || CAST(round(t * 1000) AS BIGINT)), 8) AS BIGINT) / 4294967296.0 * 2 - 1) * 30.0, 2) AS t FROM tr JOIN tk USING (action)"""),
    "alert_budget": sql(EV, TR, _roll(1), BUDGET, select=f"SELECT actor, day, rk AS rank, {r6('score')} AS score FROM bu"),
    "campaign_detection": sql(EV, TR, _roll(1), BUDGET, select=f"""SELECT actor, flavor, a IS NOT NULL AS detected, round(a.t, 3) AS alert_time,
        {r6('a.s')} AS alert_score, a.d AS budget_day FROM det"""),
    "budget_eval": sql(EV, TR, _roll(1), BUDGET, select=f"""SELECT coalesce(flavor, 'ALL') AS flavor, count(*) AS total, count(a) AS tp, count(*) - count(a) AS fn,
        {r6('count(a) / count(*)')} AS detection_rate FROM det GROUP BY ROLLUP (flavor)"""),
    "campaigns_per_flavor": sql(EV, CAMP, select="SELECT flavor, count(*) AS n_campaigns FROM camp GROUP BY flavor"),
    "behavioural_read": sql(EV, TR, CAMP, """up AS (SELECT c.actor, c.flavor, c.te, count(*) FILTER (t >= ts0) AS k, max(p) AS lp, any_value(ts0) AS ts0 FROM camp c
        JOIN tr ON tr.actor = c.actor AND t <= te GROUP BY ALL),
        iw AS (SELECT up.actor AS la, flavor, te AS t1, CASE WHEN k < 5 THEN tr.t ELSE ts0 END AS t0 FROM up JOIN tr ON tr.actor = up.actor AND tr.p = greatest(1, lp - 79)
          UNION ALL SELECT actor, 'benign', max(t), min(t) FROM tr WHERE n >= 40 AND p > n // 2 - 20 AND p <= n // 2 AND actor NOT IN (SELECT actor FROM camp) GROUP BY actor)""",
        _excess("SELECT tr.*, flavor FROM tr JOIN iw ON la = actor AND t BETWEEN t0 AND t1", "SELECT tr.*, flavor FROM tr JOIN iw ON la = actor AND t < t0", "actor, flavor"),
        select="SELECT flavor, count(*) AS count, " + ", ".join(f"{r6(e)} AS {n}" for n, e in (("mean", "avg(score)"), ("std", "stddev_pop(score)"), ("min", "min(score)"),
        ("p25", "quantile_cont(score, 0.25)"), ("p50", "quantile_cont(score, 0.5)"), ("p75", "quantile_cont(score, 0.75)"), ("p90", "quantile_cont(score, 0.9)"),
        ("max", "max(score)"))) + f""", {r6('CASE WHEN flavor <> $$benign$$ THEN (avg(score) - bm) / sqrt((stddev_pop(score) * stddev_pop(score) + bs * bs) / 2) END')} AS cohens_d,
        {r6('CASE WHEN flavor <> $$benign$$ THEN avg(score) / bm END')} AS separation_ratio FROM exs,
        (SELECT avg(score) AS bm, stddev_pop(score) AS bs FROM exs WHERE flavor = 'benign') GROUP BY flavor, bm, bs"""),
    "benign_spans": sql(EV, TR, CAMP, SPANS, select="SELECT actor, span, round(a, 3) AS t_start, round(b, 3) AS t_end FROM ok"),
    "span_features": sql(EV, TR, CAMP, SPANS, select="""SELECT actor, flavor, round(a, 3) AS t_start, CAST(n AS DOUBLE) AS n_events, CAST(coalesce(r, 0) AS DOUBLE) AS n_resources,
        CAST(e AS DOUBLE) AS n_edges, CAST(na AS DOUBLE) AS n_actions, CASE WHEN n > 0 THEN round(e / n, 6) ELSE 0.0 END AS edge_diversity,
        CAST(coalesce(dmax, 0) AS DOUBLE) AS max_degree, round(coalesce(davg, 0.0), 6) AS mean_degree FROM feat LEFT JOIN dsum USING (actor, flavor, a)"""),
    "average_precision": sql(EV, """th AS (SELECT event_type, k, count(*) AS n, count(*) FILTER (value > 20) AS p FROM src GROUP BY ALL),
        cu AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM th WINDOW w AS (PARTITION BY event_type ORDER BY k DESC))""",
        select=f"SELECT event_type, {r6('sum(cp / cn * p) / sum(p)')} AS average_precision, {r6('sum(p) / sum(n)')} AS prevalence FROM cu GROUP BY event_type"),
    "ks_two_sample": """WITH s AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS n1, count(*) FILTER (o_orderstatus <> 'F') AS n2 FROM orders),
        c AS (SELECT o_totalprice AS v, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY ALL),
        d AS (SELECT max(abs(ca / n1 - cb / n2)) AS d, any_value(n1) AS n1, any_value(n2) AS n2 FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb FROM c), s)
        SELECT n1, n2, round(d, 6) AS statistic, (SELECT round(greatest(0.0, least(1.0, sum((CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) *
        exp(-2.0 * j * j * n1 * n2 / (n1 + n2) * d * d)))), 6) FROM (SELECT unnest(range(1, 60)) AS j)) AS p_value FROM d""",
    "degree_dist": sql(EV, TR, select="""SELECT degree, count(*) AS n_nodes FROM (SELECT node, count(*) AS degree FROM (SELECT unnest([src, dst]) AS node FROM tr)
        GROUP BY node) GROUP BY degree"""),
    "iqr_check": sql(EV, TR, """na AS (SELECT user_id % 10 = 0 AS att, actor, count(*) AS n FROM tr GROUP BY ALL),
        q AS (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM na WHERE NOT att)""",
        select="""SELECT q1, q3, count(*) AS n, count(*) FILTER (n < q1 - 1 OR n > q3 + 1) AS n_outside, count(*) FILTER (n < q1 - 1 OR n > q3 + 1) = 0 AS passed
        FROM na, q WHERE att GROUP BY ALL"""),
    "activity_check": sql(EV, TR, select=f"""SELECT count(*) AS n_actors, min(n) AS min, CAST(floor(median(n)) AS BIGINT) AS median, {r6('avg(n)')} AS mean,
        min(n) >= 80 AS passed FROM (SELECT count(*) AS n FROM tr GROUP BY actor) WHERE n >= 50"""),
    "leak_scan": "WITH w AS (SELECT DISTINCT unnest([" + ", ".join(f"'{w.lower()}'" for w in LEAK_VOCABULARY) + """]) AS word),
        c AS (SELECT doc_id, 'text' AS "column", text AS v FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents)
        SELECT doc_id, "column", word FROM c, w WHERE contains(lower(v), word)""",
}

# --- log profiling -------------------------------------------------------------------------------

_TYPES = " ".join(f"WHEN regexp_matches(value, '{p}') THEN '{n}'" for n, p in VALUE_PATTERNS)
LEAF = f"""
src AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
leaf0(id, log_type, path, value, is_string) AS (
  SELECT 'e' || event_id, 'events', p, v, s FROM (SELECT event_id, unnest([
    {{'p': 'logName', 'v': 'projects/p/logs/events', 's': true}}, {{'p': 'timestamp', 'v': strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), 's': true}},
    {{'p': 'actor.email', 'v': 'u' || user_id || '@example.com', 's': true}}, {{'p': 'actor.ids[]', 'v': CAST(user_id AS VARCHAR), 's': false}},
    {{'p': 'actor.ids[]', 'v': CAST(k AS VARCHAR), 's': false}}, {{'p': 'resource', 'v': 'projects/p/x/' || (k % 10), 's': true}},
    {{'p': 'kind', 'v': event_type, 's': true}}], recursive := true) FROM src)
  UNION ALL SELECT 'o' || o_orderkey, 'orders', p, v, s FROM (SELECT o_orderkey, unnest([
    {{'p': 'logName', 'v': 'projects/p/logs/orders', 's': true}}, {{'p': 'order.key', 'v': CAST(o_orderkey AS VARCHAR), 's': false}},
    {{'p': 'order.status', 'v': o_orderstatus, 's': true}}, {{'p': 'order.priority', 'v': o_orderpriority, 's': true}},
    {{'p': 'createTime', 'v': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ'), 's': true}},
    {{'p': 'customer', 'v': 'u' || o_custkey || '@example.com', 's': true}}], recursive := true) FROM orders)
  UNION ALL SELECT 'c-' || conv_id || '-' || turn, 'UNKNOWN', p, v, s FROM (SELECT conv_id, turn, unnest([
    {{'p': 'conv.id', 'v': CAST(conv_id AS VARCHAR), 's': false}}, {{'p': 'conv.turn', 'v': CAST(turn AS VARCHAR), 's': false}},
    {{'p': 'role', 'v': role, 's': true}}, {{'p': 'text', 'v': text, 's': true}}], recursive := true) FROM conversations)),
leaf AS (SELECT *, CASE WHEN NOT is_string THEN NULL {_TYPES} END AS vt FROM leaf0),
tot AS (SELECT (SELECT count(*) FROM events) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM conversations) AS n),
dt AS (SELECT DISTINCT ON (path) path, vt FROM (SELECT path, vt, count(*) AS c FROM leaf WHERE vt IS NOT NULL GROUP BY ALL) ORDER BY path, c DESC, vt),
smp AS (SELECT path, string_agg(value, ',' ORDER BY value) AS samples FROM (SELECT path, value, row_number() OVER (PARTITION BY path ORDER BY value) AS r
  FROM (SELECT DISTINCT path, value FROM leaf)) WHERE r <= 5 GROUP BY path),
prof AS (SELECT path, count(*) AS c, count(DISTINCT value) AS card, any_value(n) AS n FROM leaf, tot GROUP BY path)"""
CLUST = """
tl AS (SELECT 'e' || event_id AS id, epoch_us(ts) AS us, event_id AS eid FROM events),
tg AS (SELECT *, CASE WHEN us - lag(us) OVER (ORDER BY us, id) <= 60000000 THEN 0 ELSE 1 END AS fresh FROM tl),
tc AS (SELECT *, sum(fresh) OVER (ORDER BY us, id) AS g FROM tg),
cl AS (SELECT g, min(us) AS a, max(us) AS b, count(*) AS n FROM tc GROUP BY g HAVING count(*) >= 2),
sh AS (SELECT a, path, min(value) AS value FROM leaf JOIN tc USING (id) JOIN cl USING (g) GROUP BY a, path HAVING count(DISTINCT value) = 1)"""

ORACLE |= {
    "log_type_counts": """SELECT 'events' AS log_type, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders
        UNION ALL SELECT 'UNKNOWN', count(*) FROM conversations""",
    "flatten_json": sql(LEAF, select="SELECT id, log_type, path, value, is_string FROM leaf"),
    "semantic_types": sql(LEAF, select="SELECT path, vt AS value_type, count(*) AS n FROM leaf WHERE vt IS NOT NULL GROUP BY ALL"),
    "profile_fields": sql(LEAF, select=f"""SELECT path, c AS count, card AS cardinality, vt AS dominant_type, {r6('c / n')} AS presence_rate, samples
        FROM prof LEFT JOIN dt USING (path) JOIN smp USING (path)"""),
    "merged_profile": sql(LEAF, select=f"""SELECT path, c AS count, card AS n_values, vt AS dominant_type, {r6('c / n')} AS presence_rate, samples, true AS within_error
        FROM prof LEFT JOIN dt USING (path) JOIN smp USING (path)"""),
    "timestamp_fields": sql(LEAF, select="SELECT path FROM dt WHERE vt = 'iso_timestamp' AND path IN ('timestamp', 'createTime')"),
    "actor_target_fields": sql(LEAF, select="""SELECT path, card AS cardinality, CASE vt WHEN 'email' THEN 'actor' ELSE 'target' END AS kind
        FROM prof JOIN dt USING (path) WHERE vt IN ('email', 'uri')"""),
    "correlation_candidates": sql(LEAF, select="""SELECT path, round(1.0 - abs(card / c - 0.3), 3) AS score FROM prof
        WHERE card / c > 0.01 AND card / c < 0.8 AND card >= 2 AND c >= 5"""),
    "temporal_clusters": sql(LEAF, CLUST, select="SELECT a AS cluster_start, b AS cluster_end, n AS n_entries FROM cl"),
    "cluster_shared": sql(LEAF, CLUST, select="SELECT a AS cluster_start, path, value FROM sh"),
    "cluster_keys": sql(LEAF, CLUST, select="""SELECT path, count(DISTINCT value) AS n_values, count(*) AS n_clusters, 0.9 AS score FROM sh
        GROUP BY path HAVING count(DISTINCT value) >= 2"""),
    "cross_log_overlap": sql(LEAF, "pl AS (SELECT DISTINCT log_type, path, value FROM leaf WHERE is_string AND length(value) > 3)",
        select="""SELECT a.log_type AS log_type_1, a.path AS field_1, b.log_type AS log_type_2, b.path AS field_2, count(*) AS shared_values
        FROM pl a JOIN pl b ON a.value = b.value AND a.log_type < b.log_type GROUP BY ALL"""),
}

ORACLE |= {
    "stream_dedup": sql(EV, select="SELECT event_id, actor_id FROM ev"),
    "stream_actor_windows": sql(EV, ACT, select=f"""SELECT {WS}, actor_id, event_count, n_targets, action_types,
        {r6('burst')} AS burst_per_min, {r6('h')} AS breadth_entropy FROM act JOIN ent USING (ws, actor_id)"""),
    "stream_edges": ORACLE["zone_edges"],
    "stream_sessions": sql(EV, """gaps AS (SELECT event_type, us, us - lag(us) OVER (PARTITION BY event_type ORDER BY us) AS gap FROM ev),
        runs AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > 600000000) OVER (PARTITION BY event_type ORDER BY us) AS run FROM gaps)""",
        select="""SELECT event_type AS log_type, min(us) AS cluster_start, max(us) AS cluster_end, count(*) AS n_entries FROM runs
        GROUP BY event_type, run HAVING count(*) >= 2"""),
    "ingest_twice": sql(RAW, select="SELECT count(*) AS first_run, CAST(0 AS BIGINT) AS second_run, count(*) AS stored, count(*) AS ids FROM aud"),
}
_ACTIVE = (("inv_score", "inv_score > 0"), ("novelty_score", "novelty > 0"), ("bridge_new", "bridges > 0"), ("closure_gap", "ratio < 1"),
           ("orphaned_priv", "orphaned > 0"), ("trigger_resolved", "resolved"))
ORACLE["signal_reliability"] = sql(*SCENES, "sa AS (SELECT scenario, s, avg(CASE WHEN f THEN 1.0 ELSE 0 END) AS v FROM (" + " UNION ALL ".join(
    f"SELECT scenario, '{s}' AS s, {e} AS f FROM rn" for s, e in _ACTIVE) + ") GROUP BY ALL)",
    select=f"SELECT s AS signal, {r6('avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END)')} AS reliability, {r6('avg(v)')} AS mean_activation FROM sa GROUP BY s")
_SENTENCES = ", ".join(f"CASE WHEN {flag} THEN {text} END" for flag, text in (
    ("i1", "actor_id || ' changed an access policy and no deployment was under way'"), ("i2", "'a service-account key was issued for ' || key"),
    ("i3", "actor_id || ', not seen before, issued a service-account key'"), ("i4", "actor_id || ' acted as ' || imp"),
    ("i5", "printf('%d impersonations where %.1f are usual', n_imp, coalesce(base, 0.0))"), ("i6", "actor_id || ' read secret ' || sec || ' for the first time'"),
    ("i7", "'a secret was read and an access policy changed in one window'"), ("i8", "actor_id || ' decrypted with ' || crypt || ' for the first time'"),
    ("i9", "'instance metadata of ' || meta || ' was changed'"), ("i10", "actor_id || ' went from ' || hop[1] || ' to ' || hop[2] || ' for the first time'"),
    ("i11", "printf('%s acted %d times without delegation, which it had %d times in %d before (%.0f%%)', actor_id, event_count - n_chained, past_chained::BIGINT, "
            "past_events::BIGINT, 100.0 * past_chained / past_events)")))
ORACLE |= {
    "risk_explanations": sql(EV, EDGES, ACT, INV, """
named AS (SELECT ws, actor_id, arg_min(target_id, (us, event_id)) FILTER (action_type = 'IAM_CREATE_KEY') AS key,
  arg_min(target_id, (us, event_id)) FILTER (action_type = 'IAM_IMPERSONATE') AS imp,
  arg_min(target_id, (us, event_id)) FILTER (action_type = 'COMPUTE_METADATA_CHANGE') AS meta FROM ev GROUP BY ALL),
seen AS (SELECT ws, actor_id, target_id, min(us) AS f FROM ev GROUP BY ALL),
newly AS (SELECT ws, actor_id, arg_min(target_id, (f, target_id)) FILTER (action_type = 'SECRET_ACCESS') AS sec,
  arg_min(target_id, (f, target_id)) FILTER (action_type = 'KMS_DECRYPT') AS crypt FROM fresh JOIN seen USING (ws, actor_id, target_id) WHERE is_new GROUP BY ALL),
hops2 AS (SELECT ws, actor_id, min((source_zone, target_zone)) AS hop FROM edges WHERE is_new AND target_zone IN ('SECRET', 'EXFIL_RISK') GROUP BY ALL)""",
        select=f"""SELECT {WS}, actor_id, CASE WHEN said = '' THEN 'no rule fired' ELSE said END AS explanation FROM (
        SELECT ws, actor_id, concat_ws('; ', {_SENTENCES}) AS said FROM flags JOIN act USING (ws, actor_id) JOIN named USING (ws, actor_id)
        LEFT JOIN newly USING (ws, actor_id) LEFT JOIN hops2 USING (ws, actor_id) LEFT JOIN (SELECT ws, actor_id, base FROM r5) USING (ws, actor_id)
        LEFT JOIN (SELECT ws, actor_id, past_chained, past_events FROM r11) USING (ws, actor_id))"""),
    "sink_by_day": sql(EV, ACT, select=f"SELECT {WS}, actor_id, event_count, n_targets FROM act JOIN ent USING (ws, actor_id)"),
    "scan_prefixes": sql(RAW, select="""SELECT CASE event_type WHEN 'signup' THEN 'cloudscheduler.googleapis.com' ELSE 'run.googleapis.com' END AS source, count(*) AS n
        FROM raw WHERE event_type IN ('signup', 'click') GROUP BY ALL"""),
}
ORACLE["stream_correlate"] = f"SELECT event_id, actor_id, trigger_ref FROM ({ORACLE['correlate_audit']})"
