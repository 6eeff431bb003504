"""SQL of the queries, written for DuckDB as common table expressions that build on each other."""

from __future__ import annotations

H = """h AS (SELECT event_type AS meter_id, date_trunc('hour', ts) AS t, epoch(date_trunc('hour', ts))::BIGINT AS ts_s,
  round(sum(value), 2) AS demand_kw FROM events GROUP BY ALL)"""
MEM = "mem(entity_id, meter_id) AS (VALUES ('interest','click'),('interest','view'),('sales','purchase'),('sales','signup'),('all','click'),('all','view'),('all','purchase'),('all','signup'),('all','error'))"
GRID = """span AS (SELECT meter_id, min(ts_s) AS a, max(ts_s) AS b FROM h GROUP BY 1),
pts AS (SELECT meter_id, unnest(range(a, b + 1, 3600)) AS ts_s FROM span),
raw AS (SELECT pts.meter_id, pts.ts_s, h.demand_kw AS read_kw FROM pts LEFT JOIN h USING (meter_id, ts_s)),
br AS (SELECT *, last_value(CASE WHEN read_kw IS NOT NULL THEN ts_s END IGNORE NULLS) OVER b AS pt,
  last_value(read_kw IGNORE NULLS) OVER b AS pv,
  first_value(CASE WHEN read_kw IS NOT NULL THEN ts_s END IGNORE NULLS) OVER f AS nt,
  first_value(read_kw IGNORE NULLS) OVER f AS nv FROM raw
  WINDOW b AS (PARTITION BY meter_id ORDER BY ts_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  f AS (PARTITION BY meter_id ORDER BY ts_s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT meter_id, ts_s, read_kw, CASE WHEN read_kw IS NOT NULL THEN read_kw
  WHEN nt - pt <= 7200 THEN pv + (ts_s - pt)::DOUBLE / (nt - pt) * (nv - pv) END AS demand_kw,
  to_timestamp(ts_s) AT TIME ZONE 'UTC' AS t, (to_timestamp(ts_s) AT TIME ZONE 'UTC')::DATE AS local_date FROM br)"""
SMOOTH = """s AS (SELECT *, quantile_cont(demand_kw, 0.5) OVER (PARTITION BY meter_id, local_date
  ORDER BY ts_s ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM g)"""
REGION = """lo AS (SELECT *, coalesce(v <= quantile_cont(v, 0.1) OVER (PARTITION BY meter_id, local_date), false) AS low
  FROM s),
lr AS (SELECT *, sum(CASE WHEN low IS DISTINCT FROM pl THEN 1 ELSE 0 END) OVER (PARTITION BY meter_id, local_date
  ORDER BY ts_s) AS run FROM (SELECT *, lag(low) OVER (PARTITION BY meter_id, local_date ORDER BY ts_s) AS pl,
  lead(ts_s) OVER (PARTITION BY meter_id, local_date ORDER BY ts_s) AS nx FROM lo)),
rr AS (SELECT meter_id, local_date, run, min(ts_s) AS a, coalesce(arg_max(coalesce(nx, ts_s), ts_s), max(ts_s)) AS b
  FROM lr WHERE low GROUP BY ALL),
region AS (SELECT meter_id, local_date, a AS region_start_s, b AS region_end_s, (b - a) / 60 AS region_minutes FROM rr
  WHERE b - a >= 3600 QUALIFY row_number() OVER (PARTITION BY meter_id, local_date ORDER BY b - a DESC, a) = 1)"""
BASE = """bs AS (SELECT s.meter_id, s.local_date,
  quantile_cont(CASE WHEN ts_s BETWEEN region_start_s AND region_end_s THEN v END, 0.5) AS held,
  quantile_cont(v, 0.1) AS fb, max(v) AS pk, avg(v) AS mean, max(region_minutes) AS rm
  FROM s LEFT JOIN region r ON r.meter_id = s.meter_id AND r.local_date = s.local_date GROUP BY ALL),
base AS (SELECT meter_id, local_date, round(coalesce(held, fb) + 1e-7, 2) AS baseline_kw,
  round(pk + 1e-7, 2) AS peak_kw, round(pk - coalesce(held, fb) + 1e-7, 2) AS operating_range_kw,
  round(coalesce(rm / 60, 0), 3) AS baseline_hours,
  CASE WHEN held IS NOT NULL THEN 'hybrid_sustained'
  ELSE 'fallback_percentile' END AS baseline_method,
  coalesce(mean > 0 AND (pk - coalesce(held, fb)) / mean < 0.15, false) AS is_continuous FROM bs
  WHERE pk IS NOT NULL)"""
STATE = """sb AS (SELECT s.*, baseline_kw, peak_kw, operating_range_kw, is_continuous,
  baseline_kw + 0.20 * (peak_kw - baseline_kw) AS up, baseline_kw + 0.15 * (peak_kw - baseline_kw) AS down FROM s LEFT
  JOIN base b ON b.meter_id = s.meter_id AND b.local_date = s.local_date),
hy AS (SELECT *, coalesce(last_value(CASE WHEN v >= up THEN 1
  WHEN v <= down THEN 0 END IGNORE NULLS) OVER (PARTITION BY meter_id, local_date ORDER BY ts_s), 0) AS latent FROM sb),
st AS (SELECT *, CASE WHEN baseline_kw IS NULL OR v IS NULL THEN 'UNKNOWN'
  WHEN peak_kw - baseline_kw <= 0 THEN 'BASELINE' WHEN latent = 1 THEN 'OPERATING' ELSE 'BASELINE' END AS raw_state
  FROM hy),
sr AS (SELECT *, sum(CASE WHEN raw_state IS DISTINCT FROM ps THEN 1 ELSE 0 END) OVER (PARTITION BY meter_id, local_date
  ORDER BY ts_s) AS run FROM (SELECT *, lag(raw_state) OVER (PARTITION BY meter_id, local_date ORDER BY ts_s) AS ps
  FROM st)),
sk AS (SELECT *, run = 1 OR raw_state = 'UNKNOWN' OR max(ts_s) OVER w - min(ts_s) OVER w >= 1800 AS keep FROM sr
  WINDOW w AS (PARTITION BY meter_id, local_date, run)),
sf AS (SELECT *, last_value(CASE WHEN keep THEN raw_state END IGNORE NULLS) OVER (PARTITION BY meter_id, local_date
  ORDER BY ts_s) AS state FROM sk)"""
PERIOD = """pr AS (SELECT *, sum(CASE WHEN state IS DISTINCT FROM pst THEN 1 ELSE 0 END) OVER w2 AS srun
  FROM (SELECT *, lag(state) OVER w AS pst, lead(ts_s) OVER w AS nx FROM sf
  WINDOW w AS (PARTITION BY meter_id, local_date ORDER BY ts_s))
  WINDOW w2 AS (PARTITION BY meter_id, local_date ORDER BY ts_s)),
pb AS (SELECT meter_id, local_date, srun, min(ts_s) AS a, arg_max(coalesce(nx, ts_s), ts_s) AS b FROM pr
  WHERE state = 'OPERATING' GROUP BY ALL HAVING b - a >= 1800),
pf AS (SELECT *, sum(fresh) OVER (PARTITION BY meter_id, local_date ORDER BY a) AS grp
  FROM (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY meter_id, local_date ORDER BY a) < 3600 THEN 0
  ELSE 1 END AS fresh FROM pb)),
pg AS (SELECT meter_id, local_date, min(a) AS start_s, max(b) AS end_s FROM pf GROUP BY meter_id, local_date, grp)"""
CAND = """ca AS (SELECT *, lag(state) OVER w AS before, max(ts_s) OVER (PARTITION BY meter_id, local_date) AS day_end
  FROM sf WINDOW w AS (PARTITION BY meter_id, local_date ORDER BY ts_s)),
cu AS (SELECT c.meter_id, c.local_date, c.ts_s, c.v, c.up, c.day_end, c.peak_kw - c.baseline_kw AS span,
  (SELECT min(x.v) FROM s x WHERE x.meter_id = c.meter_id AND x.local_date = c.local_date
  AND x.ts_s BETWEEN c.ts_s - 7200 AND c.ts_s) AS lv,
  (SELECT arg_min(x.ts_s, row(x.v, x.ts_s)) FROM s x WHERE x.meter_id = c.meter_id AND x.local_date = c.local_date
  AND x.v IS NOT NULL AND x.ts_s BETWEEN c.ts_s - 7200 AND c.ts_s) AS lt,
  coalesce((SELECT min(x.ts_s) FROM s x WHERE x.meter_id = c.meter_id AND x.local_date = c.local_date
  AND x.ts_s >= c.ts_s AND x.v < c.up), c.day_end) AS til
  FROM ca c WHERE state = 'OPERATING' AND (before = 'BASELINE' OR before IS NULL))"""
FRAME = """es AS (SELECT entity_id, ts_s, CASE
  WHEN count(demand_kw) >= 1 THEN sum(demand_kw) END AS demand_kw, count(demand_kw) AS n_meters_reporting FROM g
  JOIN mem USING (meter_id) GROUP BY ALL),
f AS (SELECT *, to_timestamp(ts_s) AT TIME ZONE 'UTC' AS t, (to_timestamp(ts_s) AT TIME ZONE 'UTC')::DATE AS local_date,
  hour(to_timestamp(ts_s) AT TIME ZONE 'UTC') AS hour FROM es)"""
SUMMARY = """su AS (SELECT entity_id, local_date, count(*) = 24
  AND count(demand_kw) = 24 AS is_complete_day, sum(demand_kw) AS daily_energy_kwh, max(demand_kw) AS maximum_demand_kw,
  arg_min(hour(t) * 60 + minute(t), row(-demand_kw, ts_s)) FILTER (demand_kw IS NOT NULL) AS peak_time_minutes FROM f
  GROUP BY ALL)"""
SHAPE = """ex AS (SELECT *, coalesce(demand_kw > lag(demand_kw) OVER w AND demand_kw > lead(demand_kw) OVER w,
  false) AS lp, coalesce(demand_kw < lag(demand_kw) OVER w AND demand_kw < lead(demand_kw) OVER w, false) AS lv,
  max(demand_kw) OVER (PARTITION BY entity_id, local_date) AS top FROM f
  WINDOW w AS (PARTITION BY entity_id ORDER BY ts_s)),
sh AS (SELECT entity_id, local_date, avg(demand_kw) AS mean_demand_kw,
  stddev_samp(demand_kw) / nullif(avg(demand_kw), 0) AS cv, max(demand_kw) / nullif(avg(demand_kw), 0) AS par,
  max(demand_kw) AS top, count(demand_kw) AS n, count(*) FILTER (lp) AS n_local_peaks,
  avg(CASE WHEN coalesce(demand_kw >= 0.9 * top, false) THEN 1.0 ELSE 0.0 END) AS high_fraction,
  max(demand_kw) FILTER (hour >= 6 AND hour < 10) AS mo, max(demand_kw) FILTER (hour >= 10 AND hour < 14) AS mi,
  max(demand_kw) FILTER (hour >= 14 AND hour < 18) AS af, max(demand_kw) FILTER (hour >= 18 AND hour < 22) AS ev,
  avg(demand_kw) FILTER (hour >= 22 OR hour < 6) AS night, avg(demand_kw) FILTER (hour >= 6 AND hour < 22) AS day
  FROM ex GROUP BY ALL),
sp AS (SELECT *, coalesce(cv <= 0.15, false) AS is_flat, n_local_peaks >= 2 AS is_multi_peak, CASE
  WHEN n / 24.0 < 0.5 THEN 'insufficient_data'
  WHEN par >= 2 AND high_fraction <= 0.1 AND mo >= 0.85 * top AND NOT coalesce(af >= 0.85 * top, false)
  AND NOT coalesce(ev >= 0.85 * top, false) THEN 'morning_peak' WHEN par >= 2 AND high_fraction <= 0.1
  AND af >= 0.85 * top THEN 'afternoon_peak'
  WHEN par >= 2 AND high_fraction <= 0.1 AND ev >= 0.85 * top THEN 'evening_peak' WHEN par >= 2 AND high_fraction <= 0.1
  AND mi >= 0.85 * top THEN 'midday_peak' WHEN n_local_peaks >= 2 THEN 'multi_peak'
  WHEN night / nullif(day, 0) >= 1.1 THEN 'overnight_heavy' WHEN coalesce(cv <= 0.15, false) THEN 'flat'
  ELSE 'mixed_other' END AS der_primary_shape FROM sh)"""
TEMP = """tp AS (SELECT DISTINCT ts_s + 1200 AS ts_s, round(60 + 20 * sin(ts_s / 86400), 1) AS temperature_f FROM h
  WHERE ts_s % 10800 = 0),
bk AS (SELECT f.entity_id, f.ts_s, f.demand_kw, b.ts_s AS bt, b.temperature_f AS bf FROM f ASOF LEFT
  JOIN tp b ON f.ts_s >= b.ts_s),
fw AS (SELECT bk.*, n.ts_s AS nt, n.temperature_f AS nf FROM bk ASOF LEFT JOIN tp n ON bk.ts_s <= n.ts_s),
wx AS (SELECT entity_id, ts_s, demand_kw, CASE WHEN bt IS NOT NULL AND (nt IS NULL OR ts_s - bt <= nt - ts_s) THEN CASE
  WHEN ts_s - bt <= 4800 THEN bf END WHEN nt - ts_s <= 4800 THEN nf END AS external_temperature_f FROM fw)"""
XY = """dd AS (SELECT entity_id, (to_timestamp(ts_s) AT TIME ZONE 'UTC')::DATE AS d,
  round(avg(external_temperature_f), 6) AS x, round(avg(demand_kw), 6) AS y FROM wx GROUP BY ALL),
p AS (SELECT entity_id, x, y FROM dd WHERE x IS NOT NULL AND y IS NOT NULL),
bps AS (SELECT entity_id, unnest(range((floor(min(x)) + 1)::BIGINT, ceil(max(x))::BIGINT))::DOUBLE AS bp FROM p
  GROUP BY 1)"""
DIRTY = """di AS (SELECT meter_id, ts_s, CASE WHEN ts_s % 72000 = 0 THEN -demand_kw
  ELSE demand_kw END AS demand_kw, 1 AS seq FROM h UNION ALL SELECT meter_id, ts_s, demand_kw + 1, 2 FROM h
  WHERE ts_s % 50400 = 0)"""
NORM = """nd AS (SELECT *, CASE
  WHEN peak_kw - baseline_kw > 0 THEN (demand_kw - baseline_kw) / (peak_kw - baseline_kw) END AS nv,
  ts_s - lag(ts_s) OVER (PARTITION BY meter_id, local_date ORDER BY ts_s) AS step FROM sf)"""
GAPS = """mg AS (SELECT *, sum(CASE WHEN m IS DISTINCT FROM pm THEN 1 ELSE 0 END) OVER (PARTITION BY meter_id,
  local_date ORDER BY ts_s) AS run
  FROM (SELECT *, demand_kw IS NULL AS m, lag(demand_kw IS NULL) OVER w AS pm, lead(ts_s) OVER w AS nx FROM g
  WINDOW w AS (PARTITION BY meter_id, local_date ORDER BY ts_s))),
mq AS (SELECT meter_id, local_date, max(s) / 60 AS gap
  FROM (SELECT meter_id, local_date, run, arg_max(coalesce(nx, ts_s), ts_s) - min(ts_s) AS s FROM mg WHERE m
  GROUP BY ALL) GROUP BY ALL)"""
FALL = """ea AS (SELECT *, lag(state) OVER w AS before, ts_s - lag(ts_s) OVER w AS step,
  min(CASE WHEN v IS NOT NULL THEN {'v': -v, 't': ts_s} END) OVER (w RANGE BETWEEN 7200 PRECEDING
  AND CURRENT ROW) AS hi,
  min(CASE WHEN v IS NOT NULL THEN {'v': v, 't': ts_s} END) OVER (w RANGE BETWEEN CURRENT ROW AND 7200 FOLLOWING) AS lo,
  count(*) FILTER (state = 'BASELINE') OVER (w ROWS UNBOUNDED PRECEDING) AS idle FROM sf
  WINDOW w AS (PARTITION BY meter_id, local_date ORDER BY ts_s)),
em AS (SELECT *, quantile_cont(step, 0.5) OVER (PARTITION BY meter_id, local_date) AS med FROM ea),
ec AS (SELECT *, coalesce(lo.t, ts_s) AS cross_s, coalesce(hi.t, ts_s) AS from_s, coalesce(-hi.v - lo.v, 0) AS delta
  FROM em WHERE state = 'BASELINE' AND before = 'OPERATING')"""

G, S, R, B, T = (H, GRID), (H, GRID, SMOOTH), (H, GRID, SMOOTH, REGION), (H, GRID, SMOOTH, REGION, BASE), (
    H, GRID, SMOOTH, REGION, BASE, STATE
)
# A plateau goes on while points stay near its first value; a day's peaks are then thinned from the highest down.
TOPS = """pt AS (SELECT meter_id, local_date, ts_s, demand_kw AS v,
  row_number() OVER (PARTITION BY meter_id, local_date ORDER BY ts_s) AS i FROM g WHERE demand_kw IS NOT NULL),
fl AS (SELECT meter_id, local_date, i, i AS a, v AS kw FROM pt WHERE i = 1 UNION ALL
  SELECT p.meter_id, p.local_date, p.i, CASE WHEN abs(p.v - kw) / greatest(kw, 1e-6) <= 0.01 THEN a ELSE p.i END, CASE
  WHEN abs(p.v - kw) / greatest(kw, 1e-6) <= 0.01 THEN kw ELSE p.v END
  FROM fl JOIN pt p ON p.meter_id = fl.meter_id AND p.local_date = fl.local_date AND p.i = fl.i + 1),
pl AS (SELECT meter_id, local_date, a, max(i) AS b, any_value(kw) AS kw FROM fl GROUP BY meter_id, local_date, a),
mx AS (SELECT m.meter_id, m.local_date, m.ts_s, m.v FROM pl JOIN pt m ON m.meter_id = pl.meter_id
  AND m.local_date = pl.local_date AND m.i = a + (b - a + 1) // 2
  LEFT JOIN pt x ON x.meter_id = pl.meter_id AND x.local_date = pl.local_date AND x.i = a - 1 LEFT
  JOIN pt y ON y.meter_id = pl.meter_id AND y.local_date = pl.local_date AND y.i = b + 1
  WHERE coalesce(x.v <= kw, true) AND coalesce(y.v <= kw, true))"""
PROM = """hi AS (SELECT p.meter_id, p.local_date, p.ts_s, p.v, max(CASE WHEN o.ts_s < p.ts_s THEN o.ts_s END) AS l,
  min(CASE WHEN o.ts_s > p.ts_s THEN o.ts_s END) AS r
  FROM mx p LEFT JOIN mx o ON o.meter_id = p.meter_id AND o.local_date = p.local_date AND o.v > p.v GROUP BY ALL),
pm AS (SELECT h.meter_id, h.local_date, h.ts_s, h.v AS kw,
  h.v - coalesce(greatest(min(CASE WHEN pt.ts_s BETWEEN l AND h.ts_s THEN pt.v END),
  min(CASE WHEN pt.ts_s BETWEEN h.ts_s AND r THEN pt.v END)), min(pt.v)) AS prominence_kw
  FROM hi h JOIN pt ON pt.meter_id = h.meter_id AND pt.local_date = h.local_date
  GROUP BY h.meter_id, h.local_date, h.ts_s, h.v)"""
THIN = """od AS (SELECT *, row_number() OVER (PARTITION BY meter_id, local_date ORDER BY kw DESC, ts_s) AS k FROM pm),
nm AS (SELECT meter_id, local_date, 0::BIGINT AS k, []::BIGINT[] AS kept FROM od WHERE k = 1 UNION ALL
  SELECT o.meter_id, o.local_date, o.k, CASE
  WHEN len(list_filter(kept, lambda t: abs(t - o.ts_s) < 180 * 60)) = 0 THEN list_append(kept, o.ts_s) ELSE kept END
  FROM nm JOIN od o ON o.meter_id = nm.meter_id AND o.local_date = nm.local_date AND o.k = nm.k + 1),
left_over AS (SELECT meter_id, local_date, unnest(kept) AS ts_s FROM nm
  QUALIFY k = max(k) OVER (PARTITION BY meter_id, local_date))"""
E = (H, MEM, GRID, FRAME)
W = (*E, TEMP)


def q(parts: tuple[str, ...], select: str) -> str:
    """The parts before a final select, whose floats are rounded as in the queries: a hair more, and no negative zero."""
    select = select.replace(", 4)", " + 1e-7, 4) + 0.0")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def _fit3(side: str) -> str:
    e = "greatest(x - bp, 0)" if side == "cooling" else "greatest(bp - x, 0)"
    return q(
        (
            *W,
            XY,
            f"""ft AS (SELECT entity_id, bp, count(*) AS n, coalesce(regr_r2(y, {e}), 0) AS r2, var_pop({e}) AS ve
              FROM p JOIN bps USING (entity_id) GROUP BY ALL HAVING count(*) >= 5)""",
            """bf AS (SELECT *, CASE WHEN ve < 1e-12 THEN 0 ELSE r2 END AS rr FROM ft
              QUALIFY row_number() OVER (PARTITION BY entity_id
              ORDER BY round(CASE WHEN ve < 1e-12 THEN 0 ELSE r2 END, 11) DESC, bp) = 1)""",
        ),
        f"""SELECT entity_id, '3P_{side}' AS model_type, round(rr, 4) AS r_squared,
          round(1 - (1 - rr) * (n - 1) / (n - 4), 4) AS adjusted_r_squared, n AS n_points,
          bp::INT::VARCHAR AS breakpoints FROM bf""",
    )


day = "CAST(local_date AS VARCHAR) AS local_date"
SQL: dict[str, str] = {
    "flagship": q((H, MEM, """e AS (SELECT entity_id, ts_s, t, sum(demand_kw) AS d, count(demand_kw) AS n FROM h
      JOIN mem USING (meter_id) WHERE entity_id = 'all'
      GROUP BY ALL)"""), """SELECT entity_id, t::DATE::VARCHAR AS local_date, round(max(d), 4) AS peak_kw,
      arg_min(hour(t), row(-d, ts_s)) AS peak_hour, max(n) AS meters FROM e GROUP BY 1, 2"""),
    "scan_demand": q((H,), "SELECT meter_id, ts_s, round(demand_kw, 4) AS demand_kw FROM h"),
    "dedup_first": q((H, DIRTY), """SELECT meter_id, ts_s, round(demand_kw, 4) AS demand_kw FROM di
      QUALIFY row_number() OVER (PARTITION BY meter_id, ts_s ORDER BY seq) = 1"""),
    "detect_resolution": q((H, """gp AS (SELECT meter_id,
      ts_s - lag(ts_s) OVER (PARTITION BY meter_id ORDER BY ts_s) AS gap
      FROM h)""", "gc AS (SELECT meter_id, gap, count(*) AS n FROM gp WHERE gap IS NOT NULL GROUP BY ALL)"),
        """SELECT meter_id, round(arg_min(gap, row(-n, gap)) / 60, 4) AS resolution_minutes FROM gc GROUP BY 1"""),
    "validate_input": q((H, DIRTY, """bt AS (SELECT meter_id, ts_s, count(*) AS n,
      count(*) FILTER (demand_kw < 0) AS neg, count(*) FILTER (demand_kw = 0) AS zero FROM di
      GROUP BY ALL)""", "bg AS (SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY meter_id ORDER BY ts_s) AS gap FROM bt)"),
        """SELECT meter_id, sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates, sum(neg)::BIGINT AS negatives,
          sum(zero)::BIGINT AS zeros, mode(gap) / 60 AS resolution_minutes,
          count(*) FILTER (gap <> 3600) AS irregular_intervals FROM bg GROUP BY 1"""),
    "convert_units": q((H,), """SELECT meter_id, ts_s, round(demand_kw * 60 / 15.0, 4) AS demand_kw,
      round(demand_kw, 4) AS demand_input_raw FROM h"""),
    "regularize": q(G, """SELECT meter_id, ts_s, round(demand_kw, 4) AS demand_kw, round(read_kw, 4) AS demand_kw_raw,
      read_kw IS NOT NULL AS is_observed, read_kw IS NULL
      AND demand_kw IS NOT NULL AS is_interpolated, demand_kw IS NULL AS is_missing, CASE
      WHEN read_kw IS NOT NULL THEN 'observed' WHEN demand_kw IS NOT NULL THEN 'interpolated'
      ELSE 'missing' END AS data_quality_flag FROM g"""),
    "interpolate": q(G, """SELECT meter_id, ts_s, round(demand_kw, 4) AS demand_kw, 'linear' AS interpolation_method
      FROM g WHERE read_kw IS NULL AND demand_kw IS NOT NULL"""),
    "segment_days": q(G, f"SELECT meter_id, {day}, count(*) AS n_intervals FROM g GROUP BY ALL"),
    "complete_days": q(G, f"""SELECT meter_id, {day} FROM g GROUP BY meter_id, g.local_date HAVING count(*) = 24
      AND count(demand_kw) = 24"""),
    "smooth_median": q(S, "SELECT meter_id, ts_s, round(v, 4) AS smooth_kw FROM s"),
    "smooth_mean": q(G, """SELECT meter_id, ts_s,
      round(avg(demand_kw) OVER (PARTITION BY meter_id, local_date ORDER BY ts_s ROWS BETWEEN 1 PRECEDING
      AND 1 FOLLOWING), 4) AS smooth_kw FROM g"""),
    "sustained_region": q(R, f"""SELECT meter_id, {day}, region_start_s, region_end_s,
      round(region_minutes, 4) AS region_minutes FROM region"""),
    "baseline": q(B, f"""SELECT meter_id, {day}, baseline_kw, peak_kw, operating_range_kw, baseline_hours,
      baseline_method, is_continuous FROM base"""),
    "normalize_demand": q(T, """SELECT meter_id, ts_s,
      round(CASE WHEN peak_kw - baseline_kw > 0 THEN (demand_kw - baseline_kw) / (peak_kw - baseline_kw) END, 4)
      AS normalized_demand FROM sf"""),
    "hysteresis": q(T, "SELECT meter_id, ts_s, raw_state FROM st"),
    "persistence": q(T, "SELECT meter_id, ts_s, state FROM sf"),
    "operating_periods": q((*T, PERIOD), f"""SELECT meter_id, {day}, start_s, end_s,
      round((end_s - start_s) / 3600, 4) AS duration_hours,
      row_number() OVER (PARTITION BY meter_id, pg.local_date ORDER BY end_s - start_s DESC, start_s)::INT AS rank
      FROM pg"""),
    "start_candidates": q((*T, CAND), f"""SELECT meter_id, {day}, coalesce(lt, ts_s) AS transition_s,
      ts_s AS crossing_s, round(v - coalesce(lv, v), 4) AS delta_kw,
      round((ts_s - coalesce(lt, ts_s)) / 3600, 4) AS duration_hours,
      round((til - ts_s) / 3600, 4) AS persistence_hours,
      round(CASE WHEN ts_s > lt THEN (v - lv) / ((ts_s - lt) / 3600) ELSE 0 END, 4) AS avg_rate FROM cu"""),
    "interval_ramps": q(S, """SELECT meter_id, ts_s,
      round((v - lag(v) OVER w) / ((ts_s - lag(ts_s) OVER w) / 3600), 4) AS ramp_kw_per_hr FROM s
      WINDOW w AS (PARTITION BY meter_id, local_date ORDER BY ts_s)"""),
    "local_maxima": q((*G, TOPS), f"SELECT meter_id, {day}, ts_s, round(v, 4) AS kw FROM mx"),
    "prominence": q((*G, TOPS, PROM), f"""SELECT meter_id, {day}, ts_s, round(kw, 4) AS kw,
      round(prominence_kw, 4) AS prominence_kw FROM pm"""),
    "peak_nms": q((*G, TOPS, PROM, THIN), f"""SELECT meter_id, {day}, ts_s, round(kw, 4) AS kw,
      round(prominence_kw, 4) AS prominence_kw FROM pm JOIN left_over USING (meter_id, local_date, ts_s)"""),
    "local_extrema": q(G, """SELECT meter_id, ts_s,
      coalesce(demand_kw > lag(demand_kw) OVER w AND demand_kw > lead(demand_kw) OVER w, false) AS is_local_peak,
      coalesce(demand_kw < lag(demand_kw) OVER w AND demand_kw < lead(demand_kw) OVER w, false) AS is_local_valley
      FROM g WINDOW w AS (PARTITION BY meter_id ORDER BY ts_s)"""),
    "der_peak_events": q((*E, "ps AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts_s) AS pos FROM f)", """hit AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY entity_id ORDER BY pos) - 1 > 1 THEN 1 ELSE 0 END AS nw FROM ps WHERE demand_kw >= 300)""", "hs AS (SELECT *, 1 + sum(nw) OVER (PARTITION BY entity_id ORDER BY pos) AS seq FROM hit)", "bd AS (SELECT entity_id, seq, min(pos) AS a, max(pos) AS b FROM hs GROUP BY ALL)"),
        """SELECT printf('%s_%s_%04d', bd.entity_id, 'over_300', seq::INT) AS event_id, bd.entity_id,
          'over_300' AS peak_definition, min(ts_s) AS start_s, max(ts_s) AS end_s,
          round((max(ts_s) - min(ts_s)) / 3600, 4) AS duration_hours, round(max(demand_kw), 4) AS max_demand_kw,
          round(avg(demand_kw), 4) AS mean_demand_kw, round(min(demand_kw), 4) AS min_demand_kw,
          count(*) AS n_intervals, CASE WHEN max(ts_s) - min(ts_s) >= 7200 THEN 'sustained'
          ELSE 'short' END AS duration_class FROM bd JOIN ps ON ps.entity_id = bd.entity_id AND pos BETWEEN a AND b
          GROUP BY bd.entity_id, seq"""),
    "entity_sum": q(E, """SELECT entity_id, ts_s, round(demand_kw, 4) AS demand_kw, n_meters_reporting,
      demand_kw IS NULL AS is_missing FROM es"""),
    "season_daytype": """SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter'
      WHEN month(o_orderdate) < 6 THEN 'spring' WHEN month(o_orderdate) < 9 THEN 'summer' ELSE 'fall' END AS season,
  CASE WHEN o_orderdate::DATE IN ('1995-07-04', '1995-12-25', '1996-07-04', '1996-12-25') THEN 'holiday'
  WHEN isodow(o_orderdate) < 6 THEN 'weekday' ELSE 'weekend' END AS day_type,
  count(*) AS n, count(DISTINCT o_orderdate::DATE) AS n_days FROM orders GROUP BY ALL""",
    "calendar": q(E, f"""SELECT entity_id, ts_s, {day}, year(t)::INT AS year, month(t)::INT AS month,
      day(t)::INT AS day, dayofyear(t)::INT AS day_of_year, hour(t)::INT AS hour, minute(t)::INT AS minute,
      (isodow(t) - 1)::INT AS day_of_week, dayname(t) AS day_name, isodow(t) < 6 AS is_weekday,
      isodow(t) >= 6 AS is_weekend, 'winter' AS season, CASE WHEN f.local_date = DATE '2024-01-15' THEN 'holiday'
      WHEN isodow(t) < 6 THEN 'weekday' ELSE 'weekend' END AS day_type FROM f"""),
    "tod_segments": q((*E, SHAPE), f"""SELECT entity_id, {day}, round(mo, 4) AS morning_peak_kw,
      round(mi, 4) AS midday_peak_kw, round(af, 4) AS afternoon_peak_kw, round(ev, 4) AS evening_peak_kw,
      round(night, 4) AS overnight_mean_kw, round(night, 4) AS nighttime_mean_kw, round(day, 4) AS daytime_mean_kw
      FROM sh"""),
    "peak_normalize": q(E, """SELECT entity_id, ts_s,
      round(demand_kw / nullif(max(demand_kw) OVER (PARTITION BY entity_id, local_date), 0), 4) AS peak_normalized
      FROM f"""),
    "fam_threshold": q(E, "SELECT entity_id, ts_s, coalesce(demand_kw >= 300, false) AS meets_threshold_300 FROM f"),
    "fam_percentile": q(E, """SELECT entity_id, ts_s,
      coalesce(demand_kw >= quantile_cont(demand_kw, 0.9) OVER (PARTITION BY entity_id), false) AS top_pct_0_9
      FROM f"""),
    "fam_rank": q(E, """SELECT entity_id, ts_s, demand_kw IS NOT NULL
      AND row_number() OVER (PARTITION BY entity_id ORDER BY demand_kw DESC NULLS LAST, ts_s) <= 10 AS top_rank_10
      FROM f"""),
    "daily_summary": q((*E, SUMMARY), f"""SELECT entity_id, {day}, is_complete_day,
      round(daily_energy_kwh, 4) AS daily_energy_kwh, round(maximum_demand_kw, 4) AS maximum_demand_kw,
      peak_time_minutes::INT AS peak_time_minutes FROM su"""),
    "load_shape": q((*E, SHAPE), f"""SELECT entity_id, {day}, round(mean_demand_kw, 4) AS mean_demand_kw,
      round(cv, 4) AS cv, n_local_peaks, round(high_fraction, 4) AS high_fraction, is_flat, is_multi_peak,
      der_primary_shape FROM sp"""),
    "recurring_timing": q((*E, SUMMARY, """cd AS (SELECT *, count(*) OVER (PARTITION BY entity_id) AS nc,
      (peak_time_minutes // 30 * 30)::INT AS w FROM su
      WHERE is_complete_day)"""), """SELECT entity_id, w AS window_start_minutes, count(*) AS n_days,
      round(count(*) / max(nc), 4) AS statistical_support,
      string_agg(CAST(local_date AS VARCHAR), ',' ORDER BY local_date) AS dates FROM cd GROUP BY 1, 2
      HAVING count(*) >= 3"""),
    "recurring_shape": q((*E, SUMMARY, SHAPE, """cd AS (SELECT su.entity_id, su.local_date, der_primary_shape AS sn,
      count(*) OVER (PARTITION BY su.entity_id) AS nc FROM su JOIN sp ON sp.entity_id = su.entity_id
      AND sp.local_date = su.local_date WHERE is_complete_day)"""),
        """SELECT entity_id, sn AS primary_shape,
      count(*) AS n_days, round(count(*) / max(nc), 4) AS statistical_support FROM cd WHERE sn <> 'insufficient_data'
      GROUP BY 1, 2 HAVING count(*) >= 3"""),
    "outlier_days": q((*E, SUMMARY, """lg AS (SELECT entity_id, local_date,
      unnest(['daily_energy_kwh', 'maximum_demand_kw']) AS metric,
      unnest([daily_energy_kwh, maximum_demand_kw]) AS value FROM su
      WHERE is_complete_day)""", """zz AS (SELECT *, count(*) OVER w AS n,
      (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM lg
      WINDOW w AS (PARTITION BY entity_id, metric))"""), f"""SELECT entity_id, {day}, metric, round(value, 4) AS value,
      round(z, 4) AS z_score FROM zz WHERE n >= 5 AND abs(z) >= 1.5"""),
    "coincidence_study": q((H, MEM, GRID, """j AS (SELECT entity_id, meter_id, ts_s, demand_kw FROM g
      JOIN mem USING (meter_id) WHERE demand_kw IS NOT NULL)""", """ow AS (SELECT entity_id, sum(m) AS sm, count(*) AS n
      FROM (SELECT entity_id, meter_id, max(demand_kw) AS m FROM j GROUP BY ALL)
      GROUP BY 1)""", "gr AS (SELECT entity_id, ts_s, sum(demand_kw) AS t FROM j GROUP BY ALL)"),
        """SELECT entity_id,
      round(any_value(sm), 4) AS sum_of_individual_peaks_kw, any_value(n) AS n_meters,
      round(max(t), 4) AS group_peak_kw, arg_min(ts_s, row(-t, ts_s)) AS coincident_peak_s, any_value(n) >= 2
      AND any_value(sm) > 0 AS success, round(CASE WHEN any_value(n) >= 2
      AND any_value(sm) > 0 THEN max(t) / any_value(sm) END, 4) AS coincidence_factor FROM gr JOIN ow USING (entity_id)
      GROUP BY 1"""),
    "coincidence_daily": q((H, MEM, GRID, """j AS (SELECT entity_id, local_date, meter_id, ts_s, demand_kw FROM g
      JOIN mem USING (meter_id) WHERE demand_kw IS NOT NULL)""", """ow AS (SELECT entity_id, local_date, sum(m) AS sm,
      count(*) AS n FROM (SELECT entity_id, local_date, meter_id, max(demand_kw) AS m FROM j GROUP BY ALL)
      GROUP BY 1, 2)""", "gr AS (SELECT entity_id, local_date, ts_s, sum(demand_kw) AS t FROM j GROUP BY ALL)"),
        f"""SELECT entity_id, {day}, round(any_value(sm), 4) AS sum_of_individual_peaks_kw, any_value(n) AS n_meters,
          round(max(t), 4) AS group_peak_kw, arg_min(ts_s, row(-t, ts_s)) AS coincident_peak_s, true AS success,
          round(max(t) / any_value(sm), 4) AS coincidence_factor FROM gr JOIN ow USING (entity_id, local_date)
          GROUP BY entity_id, gr.local_date"""),
    "asof_nearest": q(W, """SELECT entity_id, ts_s, round(demand_kw, 4) AS demand_kw,
      round(external_temperature_f, 4) AS external_temperature_f FROM wx"""),
    "temp_policy": q(W, """SELECT entity_id, ts_s, round(demand_kw, 4) AS demand_kw,
      round(coalesce(CASE WHEN ts_s % 7200 = 0 THEN 50.0 END, external_temperature_f), 4) AS temperature_f FROM wx"""),
    "temp_band": q(W, """SELECT entity_id, ts_s, CASE WHEN external_temperature_f <= 32 THEN 'below-32'
      WHEN external_temperature_f <= 50 THEN '32-50' WHEN external_temperature_f <= 65 THEN '50-65'
      WHEN external_temperature_f <= 80 THEN '65-80' WHEN external_temperature_f <= 90 THEN '80-90'
      WHEN external_temperature_f > 90 THEN '90-above' END AS temperature_band FROM wx"""),
    "cp_grid": q((*W, XY), "SELECT entity_id, bp FROM bps"),
    "cp_2p": q((*W, XY), """SELECT entity_id, '2P' AS model_type, round(coalesce(regr_r2(y, x), 0), 4) AS r_squared,
      round(1 - (1 - coalesce(regr_r2(y, x), 0)) * (count(*) - 1) / (count(*) - 3), 4) AS adjusted_r_squared,
      count(*) AS n_points, '' AS breakpoints FROM p GROUP BY 1 HAVING count(*) >= 4"""),
    "cp_3p_cool": _fit3("cooling"),
    "cp_3p_heat": _fit3("heating"),
    "daily_stats": q(G, f"""SELECT meter_id, {day}, round(avg(demand_kw), 4) AS average_kw,
      round(quantile_cont(demand_kw, 0.5), 4) AS median_kw, round(min(demand_kw), 4) AS minimum_kw,
      round(max(demand_kw), 4) AS maximum_kw, round(stddev_samp(demand_kw), 4) AS std_kw,
      round(stddev_samp(demand_kw) / nullif(avg(demand_kw), 0), 4) AS cv FROM g GROUP BY meter_id, g.local_date"""),
    "peak_concentration": q((*G, """pk AS (SELECT meter_id, local_date, arg_min(ts_s, row(-demand_kw, ts_s)) AS pt
      FROM g WHERE demand_kw IS NOT NULL
      GROUP BY ALL)"""), """SELECT g.meter_id, CAST(g.local_date AS VARCHAR) AS local_date,
      round(sum(CASE WHEN abs(ts_s - pt) <= 1800 THEN demand_kw END) / nullif(sum(demand_kw), 0), 4)
      AS peak_concentration_1hr, round(sum(CASE
      WHEN abs(ts_s - pt) <= 3600 THEN demand_kw END) / nullif(sum(demand_kw), 0), 4) AS peak_concentration_2hr FROM g
      LEFT JOIN pk ON pk.meter_id = g.meter_id AND pk.local_date = g.local_date GROUP BY g.meter_id, g.local_date"""),
    "mean_abs_ramp": q((*G, """mr AS (SELECT meter_id, local_date,
      abs((demand_kw - lag(demand_kw) OVER w) / ((ts_s - lag(ts_s) OVER w) / 3600)) AS r FROM g
      WINDOW w AS (PARTITION BY meter_id, local_date ORDER BY ts_s))"""),
        f"""SELECT meter_id, {day},
      round(avg(r), 4) AS mean_absolute_ramp_kw_per_hr FROM mr GROUP BY meter_id, mr.local_date"""),
    "profile_matrix": q(E, f"""SELECT entity_id, {day}, count(*)::INT AS n, round(sum(demand_kw) + 1e-7, 2) AS total
      FROM f GROUP BY entity_id, f.local_date HAVING count(*) = 24 AND count(demand_kw) = 24"""),
    "end_candidates": q((*T, FALL), f"""SELECT meter_id, {day}, ts_s AS transition_s, cross_s AS crossing_s,
      round(delta, 4) AS delta_kw, round((cross_s - from_s) / 3600, 4) AS duration_hours,
      round(idle * med / 3600, 4) AS persistence_hours,
      round(CASE WHEN cross_s > from_s THEN delta / ((cross_s - from_s) / 3600) ELSE 0 END, 4) AS avg_rate FROM ec"""),
    "project_demand": q((H,), """SELECT meter_id, ts_s, round(demand_kw, 4) AS demand_kw,
      round(demand_kw, 4) AS demand_kw_raw FROM h"""),
    "parse_ts": q((H,), """SELECT DISTINCT strftime(t, '%Y-%m-%d %H:%M:%S') AS wall,
      epoch(timezone('America/Chicago', t::TIMESTAMP))::BIGINT AS ts_s FROM h"""),
    "scan_temperature": q(W, "SELECT ts_s, round(temperature_f, 4) AS temperature_f FROM tp"),
    "states": q(T, """SELECT meter_id, ts_s, round(up, 4) AS entry_kw, round(down, 4) AS exit_kw, raw_state, state
      FROM sf"""),
    "entity_frame": q(E, f"""SELECT entity_id, ts_s, {day}, hour::INT AS hour, round(demand_kw, 4) AS demand_kw,
      n_meters_reporting, demand_kw IS NULL AS is_missing FROM f"""),
    "peakiness": q((*B, """pe AS (SELECT meter_id, local_date, max(demand_kw) AS mx, avg(demand_kw) AS av FROM g
      GROUP BY ALL)"""), """SELECT pe.meter_id, CAST(pe.local_date AS VARCHAR) AS local_date,
      round(CASE WHEN av > 0 AND baseline_kw IS NOT NULL THEN mx / av END, 4) AS peak_to_average_ratio,
      round(CASE WHEN baseline_kw > 0 THEN mx / baseline_kw END, 4) AS peak_to_baseline_ratio,
      round(CASE WHEN mx > 0 AND baseline_kw IS NOT NULL THEN av / mx END, 4) AS load_factor FROM pe LEFT
      JOIN base ON base.meter_id = pe.meter_id AND base.local_date = pe.local_date"""),
    "longest_gap": q((*G, GAPS), f"SELECT meter_id, {day}, round(gap, 4) AS longest_missing_gap_minutes FROM mq"),
    "daily_quality": q((*G, GAPS, """dc AS (SELECT meter_id, local_date, count(*) AS n, count(read_kw) AS o,
      count(demand_kw) - count(read_kw) AS i, count(*) - count(demand_kw) AS m FROM g
      GROUP BY ALL)""", """dq AS (SELECT dc.*, coalesce(gap, 0) AS gap, o / n AS share FROM dc LEFT
      JOIN mq ON mq.meter_id = dc.meter_id AND mq.local_date = dc.local_date)"""),
        f"""SELECT meter_id, {day}, n AS expected_intervals, o AS observed_intervals, i AS interpolated_intervals,
          m AS missing_intervals, round(share, 4) AS completeness_fraction, round(i / n, 4) AS interpolation_fraction,
          round(gap, 1) AS longest_missing_gap_minutes, CASE WHEN share >= 0.75 AND gap <= 60 THEN 'GOOD'
          WHEN share >= 0.5 THEN 'ACCEPTABLE' WHEN share >= 0.25 THEN 'POOR' ELSE 'UNUSABLE' END AS quality_status
          FROM dq"""),
    "primary_shape": q((*E, SHAPE), f"SELECT entity_id, {day}, der_primary_shape FROM sp"),
    "meter_interval": q(T, f"""SELECT meter_id, ts_s, {day}, hour(t)::INT AS hour, round(demand_kw, 4) AS demand_kw,
      round(read_kw, 4) AS demand_kw_raw, read_kw IS NOT NULL AS is_observed, read_kw IS NULL
      AND demand_kw IS NOT NULL AS is_interpolated, demand_kw IS NULL AS is_missing, CASE
      WHEN read_kw IS NOT NULL THEN 'observed' WHEN demand_kw IS NOT NULL THEN 'interpolated'
      ELSE 'missing' END AS data_quality_flag, round(v, 4) AS analysis_demand_kw,
      round(CASE WHEN peak_kw - baseline_kw > 0 THEN (demand_kw - baseline_kw) / (peak_kw - baseline_kw) END, 4)
      AS normalized_demand, round(baseline_kw, 4) AS baseline_kw, state FROM sf"""),
    "entity_interval": q(E, f"""SELECT entity_id, ts_s, round(demand_kw, 4) AS demand_kw, n_meters_reporting,
      demand_kw IS NULL AS is_missing, {day}, year(t)::INT AS year, month(t)::INT AS month, day(t)::INT AS day,
      dayofyear(t)::INT AS day_of_year, hour::INT AS hour, minute(t)::INT AS minute,
      (isodow(t) - 1)::INT AS day_of_week, dayname(t) AS day_name, isodow(t) < 6 AS is_weekday,
      isodow(t) >= 6 AS is_weekend, 'winter' AS season, CASE WHEN isodow(t) < 6 THEN 'weekday'
      ELSE 'weekend' END AS day_type FROM f"""),
    "entity_daily": q((*E, SUMMARY, SHAPE), """SELECT su.entity_id, CAST(su.local_date AS VARCHAR) AS local_date,
      is_complete_day, round(daily_energy_kwh, 4) AS daily_energy_kwh, round(maximum_demand_kw, 4) AS maximum_demand_kw,
      peak_time_minutes::INT AS peak_time_minutes, round(mo, 4) AS morning_peak_kw, round(mi, 4) AS midday_peak_kw,
      round(af, 4) AS afternoon_peak_kw, round(ev, 4) AS evening_peak_kw, round(night, 4) AS overnight_mean_kw,
      round(night, 4) AS nighttime_mean_kw, round(sh.day, 4) AS daytime_mean_kw FROM su
      JOIN sh ON sh.entity_id = su.entity_id AND sh.local_date = su.local_date"""),
}
_hours = [
    f"round(count(*) FILTER (nv >= {t / 100}) * quantile_cont(step, 0.5) / 3600, 4) AS duration_above_{t}pct_hours"
    for t in (20, 50, 80)
]
_energy = [
    f"""round(CASE WHEN max(operating_range_kw) > 0 THEN sum(CASE WHEN nv >= {t / 100} THEN demand_kw
      ELSE 0 END) / nullif(sum(demand_kw), 0) END, 4) AS energy_frac_above_{t}pct"""
    for t in (20, 50, 80)
]
for _name, _columns in (("breadth", _hours + _energy), ("breadth_hours", _hours), ("breadth_energy", _energy)):
    SQL[_name] = q(
        (*T, NORM), f"SELECT meter_id, {day}, {', '.join(_columns)} FROM nd GROUP BY meter_id, nd.local_date"
    )
SQL |= {"study_coincidence": SQL["coincidence_study"], "daily_coincidence": SQL["coincidence_daily"]}


from gridloom.plans import oracle_events  # noqa: E402

SQL |= oracle_events.SQL
