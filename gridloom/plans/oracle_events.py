"""SQL of events, classes, change points and local times, on the parts of gridloom.plans.oracle.

Rules are written from their definitions: scores are sums of capped shares, ramps and separations are walks from one
point to the next, widths look for the nearest point below a share on either side.
"""

from __future__ import annotations

from gridloom.plans import oracle as o

#: Points that have a value, with the one before.
STEPS = """ns AS (SELECT meter_id, local_date, ts_s, v, lag(v) OVER w AS pv, lag(ts_s) OVER w AS pt FROM s
  WHERE v IS NOT NULL WINDOW w AS (PARTITION BY meter_id, local_date ORDER BY ts_s))"""


def _event(name: str, rows: str, kw: str, first: str, last: str, event: str, threshold: str) -> str:
    """The best-scored of ``rows`` (delta, dur, pers, sep, span) of each day; {name} holds its figures."""
    day = "x.meter_id = c.meter_id AND x.local_date = c.local_date"
    return f"""{name}_rate AS (SELECT *, CASE WHEN dur > 0 THEN delta / dur ELSE 0 END AS rate FROM ({rows})),
{name}_scored AS (SELECT *, 0.30 * least(1, delta / greatest(span, 1e-6)) + 0.25 * least(1,
  rate / 50.0) + 0.25 * least(1, pers / 4.0) + 0.20 * least(1, sep / greatest(span, 1e-6)) AS score
  FROM {name}_rate WHERE delta >= 10 AND rate >= 5 AND pers * 60 >= 30),
{name} AS (SELECT c.*, {event} AS transition_s, {last} AS crossing_s, {kw} AS kw, {threshold} AS threshold,
  coalesce((SELECT max(abs(x.v - x.pv) / ((x.ts_s - x.pt) / 3600)) FROM ns x WHERE {day} AND x.pt >= c.{first}
  AND x.ts_s <= c.{last}), rate) AS most,
  coalesce((SELECT avg(CASE WHEN x.v IS NULL THEN 1.0 ELSE 0.0 END) FROM s x WHERE {day}
  AND abs(x.ts_s - c.{event}) <= 3600), 0) AS lost
  FROM (SELECT * FROM {name}_scored QUALIFY row_number() OVER (PARTITION BY meter_id, local_date ORDER BY score DESC,
  {event}, {last}) = 1) c)"""


START = _event(
    "st_ev",
    """SELECT *, coalesce(lt, ts_s) AS tr, v - coalesce(lv, v) AS delta, (ts_s - coalesce(lt, ts_s)) / 3600 AS dur,
      (til - ts_s) / 3600 AS pers, v - up AS sep, coalesce(lv, v) AS low FROM cu""",
    "low",
    "tr",
    "ts_s",
    "tr",
    "up",
)
END = _event(
    "en_ev",
    """SELECT *, (cross_s - from_s) / 3600 AS dur, idle * med / 3600 AS pers, abs(coalesce(lo.v - down, 0)) AS sep,
      peak_kw - baseline_kw AS span, lo.v AS low FROM ec""",
    "low",
    "from_s",
    "cross_s",
    "ts_s",
    "down",
)


def _event_select(name: str, kw: str) -> str:
    return f"""SELECT meter_id, {o.day}, transition_s, crossing_s, round(kw + 1e-7, 2) AS {kw},
      round(threshold + 1e-7, 2) AS threshold_kw, round(delta + 1e-7, 2) AS delta_kw, round(dur, 4) AS duration_hours,
  round(rate + 1e-7, 2) AS ramp_rate_kw_per_hr, round(most + 1e-7, 2) AS max_ramp_rate_kw_per_hr,
  round(pers, 4) AS persistence_hours, round(score, 4) AS score, round(score * (1 - 0.5 * lost), 4) AS confidence,
  dur > 3 AS is_gradual FROM {name}"""


#: A walk along a day's steps: a ramp goes on in its direction or through a small reversal, a flat step ends it.
RAMPS = """rs AS (SELECT *, row_number() OVER (PARTITION BY meter_id, local_date ORDER BY ts_s) AS i FROM
  (SELECT meter_id, local_date, ts_s, v, (ts_s - lag(ts_s) OVER w) / 3600 AS h,
  (v - lag(v) OVER w) / ((ts_s - lag(ts_s) OVER w) / 3600) AS ramp FROM s
  WINDOW w AS (PARTITION BY meter_id, local_date ORDER BY ts_s)) WHERE ramp IS NOT NULL),
walk AS (SELECT meter_id, local_date, i, ts_s, v, sign(ramp) <> 0 AS open, ts_s AS start_s, v AS start_kw,
  sign(ramp)::DOUBLE AS dir, ramp * h AS cum, 1 AS g FROM rs WHERE i = 1 UNION ALL
  SELECT r.meter_id, r.local_date, r.i, r.ts_s, r.v, on_ OR sign(ramp) <> 0, CASE WHEN on_ THEN start_s
  ELSE last_s END, CASE WHEN on_ THEN start_kw ELSE last_kw END, CASE WHEN on_ THEN dir ELSE sign(ramp) END,
    CASE WHEN on_ THEN cum + CASE WHEN sign(ramp) = dir THEN ramp * h ELSE 0 END ELSE ramp * h END, CASE WHEN on_ THEN g
    ELSE g + 1 END FROM
  (SELECT n.*, w.start_s, w.start_kw, w.dir, w.cum, w.g, w.ts_s AS last_s, w.v AS last_kw, w.open
  AND (sign(n.ramp) = w.dir OR (sign(n.ramp) <> 0 AND w.cum <> 0 AND abs(n.ramp) < 0.1 * abs(w.cum))) AS on_
   FROM walk w JOIN rs n ON n.meter_id = w.meter_id AND n.local_date = w.local_date AND n.i = w.i + 1) r),
rg AS (SELECT meter_id, local_date, g, any_value(start_s) AS start_s, any_value(start_kw) AS start_kw,
  max(ts_s) AS end_s, arg_max(v, ts_s) AS end_kw FROM walk WHERE open GROUP BY ALL
  HAVING any_value(start_s) <> max(ts_s))"""
#: Ramps that are large enough, from the first on those far enough from the last that was kept.
RAMP_EVENTS = """rk AS (SELECT *, abs(end_kw - start_kw) AS delta, (end_s - start_s) / 3600 AS hours,
  row_number() OVER (PARTITION BY meter_id, local_date ORDER BY start_s) AS i FROM rg
  WHERE abs(end_kw - start_kw) >= 10 AND abs(end_kw - start_kw) / ((end_s - start_s) / 3600) >= 5
  AND end_s - start_s >= 600),
apart AS (SELECT meter_id, local_date, i, true AS kept, end_s AS last FROM rk WHERE i = 1 UNION ALL
  SELECT n.meter_id, n.local_date, n.i, n.start_s - a.last >= 900, CASE WHEN n.start_s - a.last >= 900 THEN n.end_s
  ELSE a.last END FROM apart a JOIN rk n ON n.meter_id = a.meter_id AND n.local_date = a.local_date AND n.i = a.i + 1),
re AS (SELECT rk.*, b.operating_range_kw AS span FROM rk JOIN apart USING (meter_id, local_date, i) LEFT
  JOIN base b USING (meter_id, local_date) WHERE kept),
rx AS (SELECT re.meter_id, re.local_date, re.start_s, max(abs(rs.ramp)) AS most,
  coalesce(bool_or(sf.state = 'OPERATING') AND bool_or(sf.state = 'BASELINE'), false) AS moves FROM re
  JOIN sf ON sf.meter_id = re.meter_id AND sf.local_date = re.local_date AND sf.ts_s BETWEEN re.start_s AND re.end_s
  LEFT JOIN rs ON rs.meter_id = sf.meter_id AND rs.local_date = sf.local_date AND rs.ts_s = sf.ts_s GROUP BY ALL)"""
RAMP_SELECT = f"""SELECT meter_id, {o.day}, CASE WHEN end_kw > start_kw THEN 'UP'
  ELSE 'DOWN' END AS event_type, start_s, end_s, round(start_kw + 1e-7, 2) AS start_kw,
  round(end_kw + 1e-7, 2) AS end_kw,
  round(delta + 1e-7, 2) AS delta_kw, round(hours, 4) AS duration_hours,
  round(delta / hours + 1e-7, 2) AS average_ramp_kw_per_hr, round(most + 1e-7, 2) AS max_ramp_kw_per_hr,
  CASE WHEN start_kw <> 0 THEN round(delta / abs(start_kw) * 100 + 1e-7, 2) END AS percent_change,
  round(delta / greatest(span, 1e-6) / hours, 4) AS normalized_ramp_rate,
  round(least(1, delta / greatest(span, 1e-6) * 0.5 + least(delta / hours / 100, 0.5)), 4) AS confidence,
  moves AS is_operating_transition FROM re JOIN rx USING (meter_id, local_date, start_s)"""


def _width(share: int) -> str:
    same = "x.meter_id = p.meter_id AND x.local_date = p.local_date"
    low = f"coalesce((x.demand_kw - x.baseline_kw) / x.operating_range_kw, -1) < {share / 100}"
    left = f"coalesce((SELECT max(x.ts_s) FROM sf x WHERE {same} AND {low} AND x.ts_s < p.ts_s), -1e15)"
    right = f"coalesce((SELECT min(x.ts_s) FROM sf x WHERE {same} AND {low} AND x.ts_s > p.ts_s), 1e15)"
    return f"""CASE WHEN (kw - p.baseline_kw) / p.span >= {share / 100} THEN ((SELECT max(x.ts_s) - min(x.ts_s)
      FROM sf x WHERE {same} AND x.ts_s > {left} AND x.ts_s < {right}) / 3600) ELSE 0 END AS width_{share}"""


#: Prominent peaks of days with a range, from the highest down those half an hour from all that were kept.
PEAKS = f"""pd AS (SELECT pm.*, b.baseline_kw, b.operating_range_kw AS span,
  row_number() OVER (PARTITION BY pm.meter_id, pm.local_date ORDER BY kw DESC, ts_s) AS k FROM pm
  JOIN base b ON b.meter_id = pm.meter_id AND b.local_date = pm.local_date
  WHERE b.operating_range_kw > 0 AND prominence_kw >= 0.1 * b.operating_range_kw),
far_ AS (SELECT meter_id, local_date, k, [ts_s] AS kept, true AS own FROM pd WHERE k = 1 UNION ALL
  SELECT n.meter_id, n.local_date, n.k, CASE
  WHEN len(list_filter(kept, lambda t: abs(t - n.ts_s) < 1800)) = 0 THEN list_append(kept, n.ts_s)
  ELSE kept END, len(list_filter(kept, lambda t: abs(t - n.ts_s) < 1800)) = 0
  FROM far_ f JOIN pd n ON n.meter_id = f.meter_id AND n.local_date = f.local_date AND n.k = f.k + 1),
pe AS (SELECT p.*, row_number() OVER w AS rank, first_value(p.ts_s) OVER w AS first_s FROM pd p
  JOIN far_ f ON f.meter_id = p.meter_id AND f.local_date = p.local_date AND f.k = p.k WHERE f.own
  WINDOW w AS (PARTITION BY p.meter_id, p.local_date ORDER BY kw DESC, p.ts_s)),
pw AS (SELECT p.*, {_width(70)}, {_width(80)}, {_width(90)},
  (SELECT bool_or(x.read_kw IS NULL AND x.demand_kw IS NOT NULL) FROM sf x WHERE x.meter_id = p.meter_id
  AND x.local_date = p.local_date AND x.ts_s = p.ts_s) AS filled FROM pe p)"""
WIDTHS = ", ".join(f"round(width_{w}, 4) AS width_{w}_hours" for w in (70, 80, 90))
PEAK_SELECT = f"""SELECT meter_id, {o.day}, rank::INT AS rank, ts_s AS peak_s, round(kw + 1e-7, 2) AS peak_kw,
  filled AS peak_is_interpolated, round(prominence_kw + 1e-7, 2) AS prominence_kw,
  round(prominence_kw / greatest(span, 1e-6), 4) AS prominence_fraction,
  round(abs(ts_s - first_s) / 3600, 4) AS separation_hours, {WIDTHS},
  round(least(1, 2 * prominence_kw / greatest(span, 1e-6)), 4) AS confidence FROM pw"""

SB = (*o.T, STEPS)
ALL_PEAKS = (o.TOPS, o.PROM, PEAKS)
QUALITY = (
    o.GAPS,
    """dc AS (SELECT meter_id, local_date, count(*) AS n, count(read_kw) AS o, count(demand_kw) - count(read_kw) AS i,
      count(*) - count(demand_kw) AS m FROM g GROUP BY ALL)""",
    """dq AS (SELECT dc.*, coalesce(gap, 0) AS gap, o / n AS share FROM dc LEFT JOIN mq ON mq.meter_id = dc.meter_id
      AND mq.local_date = dc.local_date)""",
)
_four = lambda c: f"round({c} + 1e-7, 4)"
_iso = lambda c: f"strftime(to_timestamp({c}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00'"


def _event_columns(name: str, kind: str, prefix: str) -> str:
    x = f"{name}."
    return f"""{x}transition_s AS {prefix}_s, {_iso(x + "transition_s")} AS probable_{prefix}_time,
      {_iso(x + "crossing_s")} AS {prefix}_threshold_crossing, round({x}kw + 1e-7, 2) AS {prefix}_kw,
      round({x}delta + 1e-7, 2) AS {kind}_delta_kw,
  {_four(x + "dur")} AS {kind}_duration_hours, round({x}rate + 1e-7, 2) AS {kind}_ramp_kw_per_hr,
  round({x}most + 1e-7, 2) AS {kind}_max_ramp_kw_per_hr,
  {_four(f"{x}score * (1 - 0.5 * {x}lost)")} AS {prefix}_confidence, {x}dur > 3 AS {prefix}_is_gradual"""


_levels = (20, 40, 60, 80, 90)
#: The feature vector of a day; df_ has a row for each meter and day.
FEATURES = (
    *SB, o.CAND, o.FALL, START, END, RAMPS, RAMP_EVENTS, *ALL_PEAKS, o.PERIOD, *QUALITY, o.NORM,
    f"""f_stat AS (SELECT meter_id, local_date, {_four("avg(demand_kw)")} AS average_kw,
      {_four("quantile_cont(demand_kw, 0.5)")} AS median_kw, {_four("min(demand_kw)")} AS minimum_kw,
      {_four("max(demand_kw)")} AS maximum_kw,
  {_four("stddev_samp(demand_kw)")} AS std_kw, {_four("stddev_samp(demand_kw) / nullif(avg(demand_kw), 0)")} AS cv,
  avg(demand_kw) AS av, max(demand_kw) AS mx,
  arg_min(ts_s, row(-demand_kw, ts_s)) FILTER (demand_kw IS NOT NULL) AS top_s FROM g GROUP BY ALL)""",
    "f_wide AS (SELECT meter_id, local_date, " + ", ".join(
        f"{_four(f'count(*) FILTER (nv >= {t / 100}) * quantile_cont(step, 0.5) / 3600')} AS duration_above_{t}pct_hours, "
        f"""{_four(f'CASE WHEN max(operating_range_kw) > 0 THEN sum(CASE WHEN nv >= {t / 100} THEN demand_kw ELSE 0 END) / nullif(sum(demand_kw), 0) END')} AS energy_frac_above_{t}pct""" for t in _levels
    ) + " FROM nd GROUP BY ALL)",
    f"""f_near AS (SELECT g.meter_id, g.local_date,
      {_four("sum(CASE WHEN abs(ts_s - top_s) <= 1800 THEN demand_kw END) / nullif(sum(demand_kw), 0)")} AS peak_concentration_1hr,
  {_four("sum(CASE WHEN abs(ts_s - top_s) <= 3600 THEN demand_kw END) / nullif(sum(demand_kw), 0)")} AS peak_concentration_2hr FROM g JOIN f_stat USING (meter_id, local_date) GROUP BY ALL)""",
    f"""f_move AS (SELECT meter_id, local_date, {_four("avg(r)")} AS mean_absolute_ramp_kw_per_hr
      FROM (SELECT meter_id, local_date,
      abs((demand_kw - lag(demand_kw) OVER w) / ((ts_s - lag(ts_s) OVER w) / 3600)) AS r FROM g
  WINDOW w AS (PARTITION BY meter_id, local_date ORDER BY ts_s)) GROUP BY ALL)""",
    f"""f_period AS (SELECT meter_id, local_date, count(*) AS n,
      {_four(f"sum({_four('(end_s - start_s) / 3600')})")} AS hours FROM pg GROUP BY ALL)""",
    """f_ramp AS (SELECT meter_id, local_date, count(*) AS n, count(*) FILTER (end_kw > start_kw) AS up,
      count(*) FILTER (NOT end_kw > start_kw) AS down FROM re GROUP BY ALL)""",
    "f_peaks AS (SELECT meter_id, local_date, count(*) - 1 AS n FROM pw GROUP BY ALL)",
    f"""df_ AS (SELECT t.meter_id, t.local_date, average_kw, median_kw, minimum_kw, maximum_kw, std_kw, cv,
      b.baseline_kw, b.operating_range_kw, coalesce(b.is_continuous, false) AS is_continuous_operation,
  dq.n AS dq_expected_intervals, dq.o AS dq_observed_intervals, dq.i AS dq_interpolated_intervals,
  dq.m AS dq_missing_intervals, {_four("dq.share")} AS dq_completeness_fraction,
  {_four("dq.i / dq.n")} AS dq_interpolation_fraction,
  round(dq.gap, 1) AS dq_longest_missing_gap_minutes, CASE WHEN dq.share >= 0.75 AND dq.gap <= 60 THEN 'GOOD'
  WHEN dq.share >= 0.5 THEN 'ACCEPTABLE' WHEN dq.share >= 0.25 THEN 'POOR' ELSE 'UNUSABLE' END AS dq_quality_status,
  {", ".join(f"duration_above_{t}pct_hours, energy_frac_above_{t}pct" for t in _levels)}, peak_concentration_1hr,
  peak_concentration_2hr, mean_absolute_ramp_kw_per_hr,
  {_event_columns("st_ev", "startup", "start")}, {_event_columns("en_ev", "shutdown", "end")},
  coalesce(f_period.n, 0) AS operating_period_count, coalesce(f_period.hours, 0) AS total_operating_duration_hours,
  coalesce(f_ramp.n, 0) AS ramp_event_count, coalesce(f_ramp.up, 0) AS up_ramp_count,
  coalesce(f_ramp.down, 0) AS down_ramp_count,
  round(p.kw + 1e-7, 2) AS peak_kw, {_iso("p.ts_s")} AS peak_time, p.filled AS peak_is_interpolated,
  round(p.prominence_kw + 1e-7, 2) AS peak_prominence_kw,
  {_four("p.prominence_kw / greatest(p.span, 1e-6)")} AS peak_prominence_fraction,
  {", ".join(f"{_four(f'p.width_{w}')} AS peak_width_{w}_hours" for w in (70, 80, 90))}, CASE
  WHEN p.kw IS NOT NULL THEN {_four("least(1, 2 * p.prominence_kw / greatest(p.span, 1e-6))")} END AS peak_confidence,
  coalesce(f_peaks.n, 0) AS secondary_peak_count,
  60.0::DOUBLE AS resolution_minutes,
  {_four("CASE WHEN av > 0 AND b.baseline_kw IS NOT NULL THEN mx / av END")} AS peak_to_average_ratio,
  {_four("CASE WHEN b.baseline_kw > 0 THEN mx / b.baseline_kw END")} AS peak_to_baseline_ratio,
  {_four("CASE WHEN mx > 0 AND b.baseline_kw IS NOT NULL THEN av / mx END")} AS load_factor, cv AS intraday_variability,
  'UTC' AS timezone, CAST(t.local_date AS VARCHAR) AS date
  FROM f_stat t LEFT JOIN (SELECT meter_id, local_date, baseline_kw, operating_range_kw, is_continuous
  FROM base) b USING (meter_id, local_date) LEFT JOIN dq USING (meter_id, local_date) LEFT
  JOIN f_wide USING (meter_id, local_date)
  LEFT JOIN f_near USING (meter_id, local_date) LEFT JOIN f_move USING (meter_id, local_date) LEFT
  JOIN st_ev USING (meter_id, local_date) LEFT JOIN en_ev USING (meter_id, local_date) LEFT
  JOIN f_period USING (meter_id, local_date)
  LEFT JOIN f_ramp USING (meter_id, local_date) LEFT JOIN f_peaks USING (meter_id, local_date) LEFT
  JOIN (SELECT * FROM pw WHERE rank = 1) p USING (meter_id, local_date))""",
)
#: Classes by the local hour of the start; attributes in their fixed order.
CLASSES = (
    *FEATURES,
    """ch AS (SELECT *,
      hour(to_timestamp(start_s) AT TIME ZONE 'UTC') + minute(to_timestamp(start_s) AT TIME ZONE 'UTC') / 60 AS hr
      FROM df_)""",
    """cl AS (SELECT *, CASE WHEN is_continuous_operation THEN 'CONTINUOUS'
      WHEN coalesce(maximum_kw - minimum_kw < 5, true) THEN 'MINIMAL_LOAD' WHEN hr < 6 THEN 'EARLY_START'
      WHEN hr < 10 THEN 'MORNING_START' WHEN hr < 14 THEN 'MIDDAY_START'
  WHEN hr IS NOT NULL THEN 'EVENING_START' WHEN total_operating_duration_hours <> 0 THEN 'NO_CLEAR_START'
  ELSE 'UNKNOWN' END AS primary_class,
  array_to_string(list_filter([CASE WHEN startup_ramp_kw_per_hr >= 50 THEN 'rapid_start'
  WHEN start_is_gradual THEN 'gradual_start' END, CASE WHEN shutdown_ramp_kw_per_hr >= 50 THEN 'rapid_shutdown'
  WHEN end_is_gradual THEN 'gradual_shutdown' END,
    CASE WHEN total_operating_duration_hours >= 10 THEN 'long_operating_duration'
    WHEN total_operating_duration_hours <= 4 AND total_operating_duration_hours > 0 THEN 'short_operating_duration' END,
    CASE WHEN peak_width_80_hours >= 3 THEN 'broad_peak' WHEN peak_width_80_hours <= 1 THEN 'sharp_peak' END, CASE
    WHEN peak_concentration_1hr >= 0.4 THEN 'high_peak_concentration' END,
    CASE WHEN operating_period_count >= 2 THEN 'multiple_operating_periods' END, CASE
    WHEN secondary_peak_count >= 1 THEN 'multiple_peaks' END, CASE WHEN cv >= 0.3 THEN 'high_intraday_variability' END],
    lambda x: x IS NOT NULL), ',') AS attributes FROM ch)""",
    """cc AS (SELECT *, round(least(1, (0.5 * CASE WHEN coalesce(dq_completeness_fraction, 0) = 0 THEN 0.5
      ELSE dq_completeness_fraction END + 0.25 * (coalesce(start_confidence, 0) + coalesce(end_confidence, 0)))
    * CASE WHEN primary_class IN ('UNKNOWN', 'NO_CLEAR_START') THEN 0.5 ELSE 1 END) + 1e-7, 4)
    AS classification_confidence,
  CASE primary_class WHEN 'CONTINUOUS' THEN 'Operating range too small relative to daily mean.'
  WHEN 'MINIMAL_LOAD' THEN 'Daily demand range is negligible.'
  WHEN 'NO_CLEAR_START' THEN 'Building operated but no credible start transition was detected.'
    WHEN 'UNKNOWN' THEN 'Insufficient information to classify.'
    ELSE 'Classified from rule-based logic.' END AS classification_notes FROM cl)""",
)

#: Sums of the excesses below h_bp and above c_bp for every pair of breakpoints, then the least error of the four sets of slopes.
MOMENTS = """mo AS (SELECT entity_id, a.bp AS h_bp, b.bp AS c_bp, count(*) AS n, sum(y) AS sy,
  var_pop(y) * count(*) AS sst, var_pop(greatest(a.bp - x, 0)) * count(*) AS hh,
  var_pop(greatest(x - b.bp, 0)) * count(*) AS cc,
  covar_pop(greatest(a.bp - x, 0), greatest(x - b.bp, 0)) * count(*) AS hc,
  covar_pop(greatest(a.bp - x, 0), y) * count(*) AS hy, covar_pop(greatest(x - b.bp, 0), y) * count(*) AS cy
  FROM p JOIN bps a USING (entity_id) JOIN bps b USING (entity_id) WHERE a.bp <= b.bp GROUP BY ALL
  HAVING max(greatest(a.bp - x, 0)) > 0 AND max(greatest(x - b.bp, 0)) > 0),
sl AS (SELECT *, CASE WHEN hh * cc - hc * hc > 1e-9 THEN (cc * hy - hc * cy) / (hh * cc - hc * hc) END AS bh, CASE
  WHEN hh * cc - hc * hc > 1e-9 THEN (hh * cy - hc * hy) / (hh * cc - hc * hc) END AS bc FROM mo),
er AS (SELECT *, least(CASE WHEN bh >= 0 AND bc >= 0 THEN sst - bh * hy - bc * cy END, CASE WHEN hh > 1e-9
  AND hy >= 0 THEN sst - hy * hy / hh END, CASE WHEN cc > 1e-9 AND cy >= 0 THEN sst - cy * cy / cc END, sst) AS sse
  FROM sl),
m4 AS (SELECT entity_id, '4P' AS model_type, n, 4 AS k, CASE WHEN sst > 0 THEN 1 - sse / sst
  ELSE 0 END AS r2, h_bp::INT::VARCHAR AS breakpoints FROM er WHERE h_bp = c_bp AND n >= 8
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY round(sse / nullif(sst, 0), 9), h_bp) = 1),
m5 AS (SELECT entity_id, '5P' AS model_type, n, 5 AS k, CASE WHEN sst > 0 THEN 1 - sse / sst
  ELSE 0 END AS r2, h_bp::INT || ',' || c_bp::INT AS breakpoints FROM er WHERE n >= 10
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY round(sse / nullif(sst, 0), 9), h_bp, c_bp) = 1
  AND count(*) OVER (PARTITION BY entity_id) >= 2)"""


def _three(side: str) -> str:
    e = "greatest(x - bp, 0)" if side == "cooling" else "greatest(bp - x, 0)"
    return f"""m3{side[0]} AS (SELECT entity_id, '3P_{side}' AS model_type, n, 3 AS k, CASE WHEN ve < 1e-12 THEN 0
      ELSE r2 END AS r2, bp::INT::VARCHAR AS breakpoints FROM
  (SELECT entity_id, bp, count(*) AS n, coalesce(regr_r2(y, {e}), 0) AS r2, var_pop({e}) AS ve FROM p
  JOIN bps USING (entity_id) GROUP BY ALL HAVING count(*) >= 5)
  QUALIFY row_number() OVER (PARTITION BY entity_id
  ORDER BY round(1 - CASE WHEN ve < 1e-12 THEN 0 ELSE r2 END, 9), bp) = 1)"""


MODELS = (
    *o.W,
    o.XY,
    MOMENTS,
    _three("cooling"),
    _three("heating"),
    """m2 AS (SELECT entity_id, '2P' AS model_type, count(*) AS n, 2 AS k, coalesce(regr_r2(y, x), 0) AS r2,
      '' AS breakpoints FROM p GROUP BY 1 HAVING count(*) >= 4)""",
    """ms AS (SELECT *, CASE WHEN n - k - 1 > 0 THEN 1 - (1 - r2) * (n - 1) / (n - k - 1) END AS adj
      FROM (SELECT *, 1 AS i FROM m2 UNION ALL SELECT *, 2 FROM m3c UNION ALL SELECT *, 3 FROM m3h UNION ALL SELECT *, 4
      FROM m4 UNION ALL SELECT *, 5 FROM m5))""",
)


def _models(where: str) -> str:
    return o.q(
        MODELS,
        f"""SELECT entity_id, model_type, round(r2, 4) AS r_squared, round(adj, 4) AS adjusted_r_squared, n AS n_points,
          breakpoints FROM ms {where}""",
    )


#: Demand by quarter hours for two meters, by hours for the others; steps by the commonest gap, windows of an hour's steps.
QUARTER = (
    """fine AS (SELECT event_type AS meter_id, CASE WHEN event_type IN ('click', 'view') THEN 900
      ELSE 3600 END AS size, floor(epoch(ts))::BIGINT AS t_s, value FROM events)""",
    "h AS (SELECT meter_id, t_s - t_s % size AS ts_s, round(sum(value), 2) AS demand_kw FROM fine GROUP BY ALL)",
    """gaps AS (SELECT meter_id, gap, count(*) AS n
      FROM (SELECT meter_id, ts_s - lag(ts_s) OVER (PARTITION BY meter_id ORDER BY ts_s) AS gap FROM h)
      WHERE gap IS NOT NULL GROUP BY ALL)""",
    "res AS (SELECT meter_id, arg_min(gap, row(-n, gap)) AS step FROM gaps GROUP BY 1)",
    o.GRID.replace(
        "max(ts_s) AS b FROM h GROUP BY 1",
        "max(ts_s) AS b, any_value(step) AS step FROM h JOIN res USING (meter_id) GROUP BY 1",
    ).replace("range(a, b + 1, 3600)", "range(a, b + 1, step)"),
    "wide AS (SELECT meter_id, greatest(1, round_even(3600.0 / step, 0))::INT AS n FROM res)",
    """at_ AS (SELECT g.*, row_number() OVER (PARTITION BY g.meter_id, local_date ORDER BY ts_s) AS i,
      (n + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) // 2 AS half FROM g JOIN wide USING (meter_id))""",
    """qs AS (SELECT a.meter_id, a.ts_s, any_value(a.demand_kw) AS demand_kw, quantile_cont(x.demand_kw, 0.5) AS mid
      FROM at_ a JOIN at_ x ON x.meter_id = a.meter_id AND x.local_date = a.local_date AND x.i BETWEEN a.i - a.half
      AND a.i + a.half GROUP BY ALL)""",
)
_shape_time = "to_timestamp(ts_s) AT TIME ZONE 'America/Chicago'"
FLAGS = """SELECT sp.entity_id, CAST(sp.local_date AS VARCHAR) AS local_date,
  coalesce(mo >= 0.85 * top, false) AS has_morning_peak, coalesce(mi >= 0.85 * top, false) AS has_midday_peak,
  coalesce(af >= 0.85 * top, false) AS has_afternoon_peak,
  coalesce(ev >= 0.85 * top, false) AS has_evening_peak, n / 24.0 < 0.5 AS is_unusual,
  coalesce(par >= 2, false) AS is_highly_peaked,
  coalesce(night / nullif(sp.day, 0) >= 1.1, false) AS is_overnight_heavy,
  n_local_peaks >= 1 AND valleys >= 1 AS has_peak_valley_pattern,
  coalesce(high_fraction <= 0.1, false) AS has_sharp_peak,
  coalesce(high_fraction >= 0.3, false) AS has_sustained_high_load
  FROM sp JOIN (SELECT entity_id, local_date, count(*) FILTER (lv) AS valleys FROM ex
  GROUP BY ALL) USING (entity_id, local_date)"""
_summary = """SELECT 'primary_class' AS panel, NULL::DOUBLE AS low, primary_class AS label FROM cl UNION ALL
  SELECT 'start_hour', floor(hr)::DOUBLE, NULL FROM cl WHERE hr IS NOT NULL""" + "".join(
    f""" UNION ALL SELECT '{panel}', round(a + CASE WHEN b > a THEN least(19, floor(({value} - a) / ((b - a) / 20)))
      ELSE 0 END * ((b - a) / 20), 6), NULL FROM cl, (SELECT min({value}) AS a, max({value}) AS b FROM cl)
      WHERE {value} IS NOT NULL"""
    for panel, value in (("operating_hours", "total_operating_duration_hours"), ("peak_kw", "peak_kw"))
)

_key = "meter_id, CAST(local_date AS VARCHAR) AS local_date"
SQL: dict[str, str] = {
    "start_event": o.q((*SB, o.CAND, START), _event_select("st_ev", "start_kw")),
    "end_event": o.q((*SB, o.FALL, END), _event_select("en_ev", "end_kw")),
    "ramp_groups": o.q(
        (*o.S, RAMPS),
        f"SELECT {_key}, start_s, round(start_kw, 4) AS start_kw, end_s, round(end_kw, 4) AS end_kw FROM rg",
    ),
    "ramp_events": o.q((*SB, RAMPS, RAMP_EVENTS), RAMP_SELECT),
    "peak_events": o.q((*SB, *ALL_PEAKS), PEAK_SELECT),
    "peak_width": o.q((*SB, *ALL_PEAKS), f"SELECT {_key}, ts_s AS peak_s, {WIDTHS} FROM pw"),
    "cp_4p": _models("WHERE model_type = '4P'"),
    "cp_5p": _models("WHERE model_type = '5P'"),
    "cp_select": _models(
        "WHERE adj IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY round(adj, 9) DESC, i) = 1"
    ),
    "daily_features": o.q(FEATURES, "SELECT * REPLACE (CAST(local_date AS VARCHAR) AS local_date) FROM df_"),
    "event_counts": o.q(
        FEATURES,
        f"""SELECT {_key}, operating_period_count, total_operating_duration_hours, ramp_event_count, up_ramp_count,
          down_ramp_count, secondary_peak_count FROM df_""",
    ),
    "classify_day": o.q(
        CLASSES, f"SELECT {_key}, primary_class, attributes, classification_confidence, classification_notes FROM cc"
    ),
    "class_distribution": o.q(CLASSES, "SELECT primary_class, count(*) AS n_days FROM cc GROUP BY 1"),
    "class_confidence": o.q(CLASSES, f"SELECT {_key}, primary_class, classification_confidence FROM cc"),
    "day_attributes": o.q(CLASSES, f"SELECT {_key}, attributes FROM cc"),
    "population_summary": o.q(
        CLASSES, f"SELECT panel, round(low, 4) AS low, label, count(*) AS n_days FROM ({_summary}) GROUP BY ALL"
    ),
    "quarter_smooth": o.q(
        QUARTER, "SELECT meter_id, ts_s, round(demand_kw, 4) AS demand_kw, round(mid, 4) AS analysis_demand_kw FROM qs"
    ),
    "asof_unlimited": o.q(
        (
            *o.E,
            o.TEMP.split(",\nbk AS")[0],
            "tq AS (SELECT * FROM tp WHERE ts_s % 864000 < 259200)",
            """ub AS (SELECT f.entity_id, f.ts_s, f.demand_kw, b.ts_s AS bt, b.temperature_f AS bf FROM f ASOF LEFT
              JOIN tq b ON f.ts_s >= b.ts_s)""",
            "uf AS (SELECT ub.*, n.ts_s AS nt, n.temperature_f AS nf FROM ub ASOF LEFT JOIN tq n ON ub.ts_s <= n.ts_s)",
        ),
        """SELECT entity_id, ts_s, round(demand_kw, 4) AS demand_kw,
          round(CASE WHEN bt IS NOT NULL AND (nt IS NULL OR ts_s - bt <= nt - ts_s) THEN bf
          ELSE nf END, 4) AS external_temperature_f FROM uf""",
    ),
    "repeated_hour": o.q(
        (o.H,),
        """SELECT ts_s - min(ts_s) OVER () + 1730505600 AS ts_s, round(demand_kw, 4) AS demand_kw FROM h
          WHERE meter_id = 'click'""",
    ),
    "iso_times": o.q(
        (o.H,),
        """SELECT DISTINCT ts_s, strftime(to_timestamp(ts_s) AT TIME ZONE 'America/Chicago',
          '%Y-%m-%dT%H:%M:%S') || '-06:00' AS iso FROM h""",
    ),
    "meter_peaks": o.q(
        (o.H, o.MEM, o.GRID),
        """SELECT entity_id, meter_id, round(max(demand_kw), 4) AS meter_peak_kw FROM g JOIN mem USING (meter_id)
          WHERE demand_kw IS NOT NULL GROUP BY ALL""",
    ),
    "load_shape_flags": o.q((*o.E, o.SHAPE), FLAGS),
    "local_peak_time": o.q(
        (
            *o.E[:3],
            """es AS (SELECT entity_id, ts_s, CASE WHEN count(demand_kw) >= 1 THEN sum(demand_kw) END AS demand_kw
              FROM g JOIN mem USING (meter_id) GROUP BY ALL)""",
            f"fl AS (SELECT *, {_shape_time} AS lt, ({_shape_time})::DATE AS ld FROM es)",
        ),
        """SELECT entity_id, CAST(ld AS VARCHAR) AS local_date, count(*) = 24
          AND count(demand_kw) = 24 AS is_complete_day, round(sum(demand_kw), 4) AS daily_energy_kwh,
          round(max(demand_kw), 4) AS maximum_demand_kw,
          (arg_min(hour(lt) * 60 + minute(lt),
          row(-demand_kw, ts_s)) FILTER (demand_kw IS NOT NULL))::INT AS peak_time_minutes FROM fl
          GROUP BY entity_id, ld""",
    ),
}
