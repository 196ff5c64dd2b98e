"""SQL counterparts of the registered queries, over the same event table.

Each query is a SELECT over named common table expressions; ``sql`` prefixes the ones it needs. The thresholds and
dates repeat those of the registry.
"""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
LIVE_AT = "TIMESTAMP '2024-01-20 12:00:00'"
FLOORS = ("floor_1", "floor_2", "floor_3")
WARNINGS = (
    "floor_2_long_call", "floor_2_escalation", "floor_no_response", "zone_slow_to_heat", "observer_silence", "setpoint_miss",
    "furnace_short_call",
)


def secs(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) // 1000000)"


def each(template: str, sep: str = ", ") -> str:
    return sep.join(template.format(f=f) for f in FLOORS)


def r_of(x: str, y: str) -> str:
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    spread = f"sqrt((var_pop({x}) {both}) * (var_pop({y}) {both}))"
    return f"CASE WHEN (count(*) {both}) >= 2 AND {spread} > 0 THEN (covar_pop({x}, {y}) {both}) / {spread} END"


LABEL = """CASE WHEN r IS NULL THEN NULL ELSE
  CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'negligible' END
  || CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END END"""
PERIOD = "CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END"
SEVERITY = "CASE WHEN confidence <= 0.33 THEN 'low' WHEN confidence <= 0.66 THEN 'medium' ELSE 'high' END"


def cte(until: str | None = None) -> dict[str, str]:
    """The common table expressions, over events up to ``until``."""
    limit = "" if until is None else f" WHERE ts <= {until}"
    zones_at = (
        "SELECT q.site_id, q.floor, q.seq, q.kind, q.ts, "
        + each("max(CASE WHEN x.floor = '{f}' AND x.edge = 'started' THEN 1 ELSE 0 END) AS {f}_on")
        + """ FROM {rows} q LEFT JOIN (SELECT *, lead(ts) OVER w AS n_ts, lead(seq) OVER w AS n_seq FROM call_edges
              WINDOW w AS (PARTITION BY site_id, entity_id ORDER BY ts, seq)) x
            ON x.site_id = q.site_id AND (x.ts, x.seq) <= (q.ts, q.seq) AND (x.n_ts IS NULL OR (q.ts, q.seq) < (x.n_ts, x.n_seq))
            GROUP BY ALL"""
    )
    other = "array_to_string(list_filter([" + each("CASE WHEN {f}_on = 1 AND floor <> '{f}' THEN '{f}' END") + "], lambda z: z IS NOT NULL), ',')"
    return {
        "ev": f"SELECT event_id, ts, user_id AS site_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'floor_' || (event_id % 3 + 1) AS floor FROM events{limit}",
        "call_obs": """SELECT *, lag(new_state) OVER (PARTITION BY site_id, entity_id ORDER BY ts, seq) AS old_state FROM (
            SELECT site_id, event_id * 4 + 2 AS seq, ts, 'binary_sensor.' || floor || '_heating_call' AS entity_id, floor,
              CASE WHEN event_type IN ('click', 'view') THEN 'on' ELSE 'off' END AS new_state
            FROM ev WHERE event_type IN ('click', 'view', 'purchase', 'signup'))""",
        "furnace_obs": """SELECT *, lag(new_state) OVER (PARTITION BY site_id, entity_id ORDER BY ts, seq) AS old_state FROM (
            SELECT site_id, event_id * 4 + 3 AS seq, ts, 'binary_sensor.furnace_heating' AS entity_id, NULL::VARCHAR AS floor,
              CASE WHEN k < 50 THEN 'on' ELSE 'off' END AS new_state FROM ev)""",
        "outdoor": """SELECT site_id, 'sensor.outdoor_temperature' AS entity_id, ts, event_id * 4 AS seq, value AS temperature_f
            FROM ev WHERE event_type = 'view' AND k % 17 <> 0""",
        "climate": """SELECT site_id, event_id * 4 + 1 AS seq, ts, 'climate.' || floor || '_thermostat' AS entity_id, floor,
            CAST(60 + k % 10 AS DOUBLE) AS setpoint, CAST(55 + CAST(round(value) AS INT) % 20 AS DOUBLE) AS current_temp,
            CASE WHEN k % 17 = 0 THEN 'off' ELSE 'heat' END AS hvac_mode,
            CASE WHEN k % 3 < 2 THEN 'heating' ELSE 'idle' END AS hvac_action FROM ev""",
        "call_edges": """SELECT site_id, entity_id, floor, ts, seq, CASE WHEN new_state = 'on' THEN 'started' ELSE 'ended' END AS edge
            FROM call_obs WHERE (old_state = 'off' AND new_state = 'on') OR (old_state = 'on' AND new_state = 'off')""",
        "furnace_edges": """SELECT site_id, entity_id, floor, ts, seq, CASE WHEN new_state = 'on' THEN 'started' ELSE 'ended' END AS edge
            FROM furnace_obs WHERE (old_state = 'off' AND new_state = 'on') OR (old_state = 'on' AND new_state = 'off')""",
        "calls": f"""SELECT site_id, entity_id, floor, ts, seq, CASE WHEN pe = 'started' THEN pt END AS started_at, ts AS ended_at,
            CASE WHEN pe = 'started' THEN {secs('pt', 'ts')} END AS duration_s
            FROM (SELECT *, lag(edge) OVER w AS pe, lag(ts) OVER w AS pt FROM call_edges
              WINDOW w AS (PARTITION BY site_id, entity_id ORDER BY ts, seq)) WHERE edge = 'ended'""",
        "furnace": f"""SELECT site_id, entity_id, floor, ts, seq, CASE WHEN pe = 'started' THEN pt END AS started_at, ts AS ended_at,
            CASE WHEN pe = 'started' THEN {secs('pt', 'ts')} END AS duration_s
            FROM (SELECT *, lag(edge) OVER w AS pe, lag(ts) OVER w AS pt FROM furnace_edges
              WINDOW w AS (PARTITION BY site_id, entity_id ORDER BY ts, seq)) WHERE edge = 'ended'""",
        "furnace_o": """SELECT f.*, CASE WHEN CAST(o.ts AS DATE) = CAST(f.ts AS DATE) THEN o.temperature_f END AS outdoor_temp_f
            FROM furnace f ASOF LEFT JOIN outdoor o ON f.site_id = o.site_id AND f.ts >= o.ts""",
        "chg": """SELECT *, coalesce(setpoint IS NOT NULL AND setpoint IS DISTINCT FROM p_sp, false) AS sp_changed,
            coalesce(current_temp IS NOT NULL AND current_temp IS DISTINCT FROM p_ct, false) AS ct_changed,
            (hvac_mode IS NOT NULL AND hvac_mode IS DISTINCT FROM p_mode) OR (hvac_action IS NOT NULL AND hvac_action IS DISTINCT FROM p_act) AS md_changed,
            hvac_action = 'heating' AS heating, coalesce(p_act = 'heating', false) AS was,
            coalesce(p_act = 'heating' AND current_temp >= setpoint AND (p_ct IS NULL OR p_ct < setpoint), false) AS reached
            FROM (SELECT *, lag(setpoint) OVER w AS p_sp, lag(current_temp) OVER w AS p_ct, lag(hvac_mode) OVER w AS p_mode, lag(hvac_action) OVER w AS p_act
              FROM climate WINDOW w AS (PARTITION BY site_id, entity_id ORDER BY ts, seq))""",
        # cycle number = running count of starts; rows outside a cycle are dropped afterwards
        "hr0": """SELECT *, sum(CASE WHEN heating AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY site_id, entity_id ORDER BY ts, seq) AS cyc
            FROM chg""",
        "hr": """SELECT *, first_value(ts) OVER c AS cycle_ts, first_value(seq) OVER c AS cycle_seq, first_value(current_temp) OVER c AS start_temp,
            max(CASE WHEN reached THEN 1 ELSE 0 END) OVER (PARTITION BY site_id, entity_id, cyc ORDER BY ts, seq) AS sofar
            FROM hr0 WHERE heating OR was WINDOW c AS (PARTITION BY site_id, entity_id, cyc ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        "cycles": """SELECT site_id, entity_id, floor, cycle_ts, cycle_seq, any_value(start_temp) AS start_temp, count(*) AS readings,
            bool_or(was AND NOT heating) AS closed, max(ts) FILTER (WHERE was AND NOT heating) AS ended_at,
            max(seq) FILTER (WHERE was AND NOT heating) AS end_seq,
            max(setpoint) FILTER (WHERE was AND NOT heating) AS end_setpoint, max(current_temp) FILTER (WHERE was AND NOT heating) AS end_temp,
            max(ts) FILTER (WHERE reached) AS reached_at,
            count(*) FILTER (WHERE reached OR (sofar = 1 AND heating AND ct_changed)) AS n_post,
            max(current_temp) FILTER (WHERE reached OR (sofar = 1 AND heating AND ct_changed)) AS peak,
            max(current_temp) FILTER (WHERE heating AND ct_changed) AS closest,
            coalesce(bool_or(was AND heating AND (sp_changed OR md_changed)), false) AS adjusted
            FROM hr GROUP BY ALL""",
        "starts_q": "SELECT site_id, floor, seq, ts, 'start' AS kind FROM hr WHERE heating AND NOT was",
        "reach_q": "SELECT site_id, floor, seq, ts, 'reach' AS kind FROM hr WHERE reached",
        "zones_start": f"SELECT *, {other} AS other_zones FROM ({zones_at.format(rows='starts_q')})",
        "all_q": "SELECT site_id, floor, seq, ts, 'all' AS kind FROM climate",
        "zones_all": f"SELECT *, {other} AS other_zones FROM ({zones_at.format(rows='all_q')})",
        "zones_reach": f"SELECT *, {other} AS other_zones FROM ({zones_at.format(rows='reach_q')})",
        "climate_o": """SELECT c.site_id, c.seq, CASE WHEN CAST(o.ts AS DATE) = CAST(c.ts AS DATE) THEN o.temperature_f END AS outdoor_temp_f
            FROM climate c ASOF LEFT JOIN outdoor o ON c.site_id = o.site_id AND c.ts >= o.ts""",
        "tt": f"""SELECT h.site_id, h.entity_id, h.floor, h.ts, h.seq, h.start_temp, h.setpoint, h.setpoint - h.start_temp AS setpoint_delta,
            {secs('h.cycle_ts', 'h.ts')} AS duration_s, h.current_temp AS end_temp, h.current_temp - h.start_temp AS degrees_gained,
            CASE WHEN {secs('h.cycle_ts', 'h.ts')} > 0 THEN round((h.current_temp - h.start_temp) / ({secs('h.cycle_ts', 'h.ts')} / 60), 3) + 0.0 ELSE 0.0 END AS degrees_per_min,
            o.outdoor_temp_f, z.other_zones
            FROM hr h JOIN climate_o o USING (site_id, seq) JOIN zones_reach z USING (site_id, seq)
            WHERE h.reached AND h.start_temp IS NOT NULL""",
        "over": f"""SELECT c.site_id, c.entity_id, c.floor, c.cycle_ts AS started_at, c.ended_at, c.start_temp, c.end_setpoint AS setpoint,
            c.end_setpoint - c.start_temp AS setpoint_delta, c.end_temp, {secs('c.reached_at', 'c.ended_at')} AS overshoot_s,
            CASE WHEN n_post > 1 THEN peak END AS peak_temp, o.outdoor_temp_f, z.other_zones, c.end_seq AS seq
            FROM cycles c JOIN climate_o o ON o.site_id = c.site_id AND o.seq = c.end_seq JOIN zones_start z ON z.site_id = c.site_id AND z.seq = c.cycle_seq
            WHERE closed AND reached_at IS NOT NULL""",
        "miss": f"""SELECT c.site_id, c.entity_id, c.floor, c.cycle_ts AS started_at, c.ended_at, c.end_seq, c.start_temp, c.end_setpoint AS setpoint,
            c.end_setpoint - c.start_temp AS setpoint_delta, {secs('c.cycle_ts', 'c.ended_at')} AS duration_s,
            coalesce(closest, start_temp) AS closest_temp, c.end_setpoint - coalesce(closest, start_temp) AS delta,
            CASE WHEN adjusted THEN 'thermostat_adjustment' ELSE 'unknown' END AS likely_cause, c.cycle_seq
            FROM cycles c WHERE closed AND reached_at IS NULL AND c.end_setpoint - c.start_temp > 0 AND coalesce(closest, start_temp) < c.end_setpoint""",
        "slow": f"""SELECT * FROM (SELECT *, {secs('cycle_ts', 'ts')} AS elapsed_s, row_number() OVER (PARTITION BY site_id, entity_id, cycle_seq ORDER BY ts, seq) AS rn
            FROM hr WHERE heating AND sofar = 0 AND {secs('cycle_ts', 'ts')} >= 21600) WHERE rn = 1""",
        "days": "SELECT DISTINCT site_id, CAST(ts AS DATE) AS date FROM ev",
        "odaily": "SELECT site_id, CAST(ts AS DATE) AS date, sum(CAST(round(temperature_f * 1000000) AS BIGINT)) / count(temperature_f) / 1000000 AS o_avg, min(temperature_f) AS o_min, max(temperature_f) AS o_max FROM outdoor GROUP BY ALL",
        "cdaily": "SELECT site_id, floor, CAST(ts AS DATE) AS date, count(*) AS n, sum(duration_s) AS s, max(duration_s) AS m FROM calls GROUP BY ALL",
        "fdaily": "SELECT site_id, CAST(ts AS DATE) AS date, count(*) AS n, sum(duration_s) AS s FROM furnace GROUP BY ALL",
        "sdaily": "SELECT site_id, CAST(ts AS DATE) AS date, " + each("round(avg(setpoint) FILTER (WHERE floor = '{f}'), 1) AS setpoint_{f}_f") + " FROM climate GROUP BY ALL",
        "floor_days": """SELECT d.site_id, f.floor, d.date, coalesce(c.n, 0) AS total_calls, CAST(coalesce(c.s, 0) AS BIGINT) AS total_runtime_s,
            CASE WHEN c.n > 0 THEN round(coalesce(c.s, 0) / c.n, 1) END AS avg_duration_s, c.m AS max_duration_s, round(o.o_avg, 1) AS outdoor_temp_avg_f
            FROM days d CROSS JOIN (VALUES ('floor_1'), ('floor_2'), ('floor_3')) f(floor)
            LEFT JOIN cdaily c ON c.site_id = d.site_id AND c.date = d.date AND c.floor = f.floor
            LEFT JOIN odaily o ON o.site_id = d.site_id AND o.date = d.date""",
        "wdaily": "SELECT site_id, CAST(ts AS DATE) AS date, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS warn_{k}" for k in WARNINGS) + " FROM warnings GROUP BY ALL",
        "fdays": """SELECT d.site_id, d.date, CAST(coalesce(fd.s, 0) AS BIGINT) AS total_furnace_runtime_s, coalesce(fd.n, 0) AS session_count,
            round(o.o_min, 6) AS outdoor_temp_min_f, round(o.o_max, 6) AS outdoor_temp_max_f, round(o.o_avg, 1) AS outdoor_temp_avg_f, """
        + each("CAST(coalesce({f}.s, 0) AS BIGINT) AS runtime_{f}_s, coalesce({f}.n, 0) AS sessions_{f}, sd.setpoint_{f}_f")
        + """ FROM days d LEFT JOIN fdaily fd USING (site_id, date) LEFT JOIN odaily o USING (site_id, date) LEFT JOIN sdaily sd USING (site_id, date) """
        + each("LEFT JOIN (SELECT * FROM cdaily WHERE floor = '{f}') {f} ON {f}.site_id = d.site_id AND {f}.date = d.date", " "),
        "fdays_w": "SELECT f.*, " + ", ".join(f"coalesce(w.warn_{k}, 0) AS warn_{k}" for k in WARNINGS) + " FROM fdays f LEFT JOIN wdaily w USING (site_id, date)",
        "intervals": """SELECT * FROM (SELECT *, lead(ts) OVER w AS until, lead(seq) OVER w AS until_seq FROM call_edges
            WINDOW w AS (PARTITION BY site_id, entity_id ORDER BY ts, seq)) WHERE edge = 'started'""",
        "long0": f"SELECT *, ts + INTERVAL 1 DAY AS warn_at FROM intervals WHERE {secs('ts', f'least(coalesce(until, {AS_OF}), {AS_OF})')} >= 86400",
        "long": """SELECT l.site_id, l.entity_id, l.floor, l.warn_at AS ts, l.seq, l.ts AS started_at, 86400::BIGINT AS threshold_s, c.current_temp, c.setpoint
            FROM long0 l ASOF LEFT JOIN climate c ON c.site_id = l.site_id AND c.floor = l.floor AND l.warn_at >= c.ts""",
        "esc": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, CAST(ts AS DATE) ORDER BY ts, seq) AS long_call_count_today FROM long) WHERE long_call_count_today >= 2",
        "silence": f"""SELECT site_id, ts AS last_event_ts, event_id * 4 + 1 AS seq, nxt AS next_event_ts, {secs('ts', f'coalesce(nxt, {AS_OF})')} AS gap_s, ts + INTERVAL 1 DAY AS ts
            FROM (SELECT *, lead(ts) OVER (PARTITION BY site_id ORDER BY ts, event_id) AS nxt FROM ev WHERE ts <= {AS_OF})
            WHERE {secs('ts', f'coalesce(nxt, {AS_OF})')} >= 86400""",
        "nr0": f"SELECT *, ts + INTERVAL 12 HOUR AS warn_at FROM intervals WHERE {secs('ts', f'least(coalesce(until, {AS_OF}), {AS_OF})')} >= 43200",
        "nr2": """SELECT n.site_id, n.entity_id, n.floor, n.warn_at, n.seq, n.ts, n.start_temp, max(c.current_temp) AS highest
            FROM (SELECT n.*, (SELECT max_by(c.current_temp, c.ts) FROM climate c WHERE c.site_id = n.site_id AND c.floor = n.floor AND (c.ts, c.seq) <= (n.ts, n.seq)) AS start_temp FROM nr0 n) n
            LEFT JOIN climate c ON c.site_id = n.site_id AND c.floor = n.floor AND (c.ts, c.seq) > (n.ts, n.seq) AND c.ts <= n.warn_at
              AND (n.until IS NULL OR (c.ts, c.seq) < (n.until, n.until_seq)) GROUP BY ALL""",
        "nr": """SELECT site_id, entity_id, floor, warn_at AS ts, seq, ts AS call_start_time, 720.0::DOUBLE AS minutes_elapsed, start_temp,
            greatest(start_temp, coalesce(highest, start_temp)) AS current_temp, 'high' AS severity
            FROM nr2 WHERE start_temp IS NOT NULL AND coalesce(highest, start_temp) <= start_temp""",
        "al": "SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts, seq) AS i FROM long",
        "sent": """SELECT site_id, i, ts FROM al WHERE i = 1 UNION ALL
          SELECT n.site_id, n.i, n.ts FROM (SELECT s.site_id, min(a.i) AS i, min_by(a.ts, a.i) AS ts FROM sent s JOIN al a
            ON a.site_id = s.site_id AND a.i > s.i AND epoch_us(a.ts) - epoch_us(s.ts) >= 172800000000 GROUP BY s.site_id, s.i) n""",
        "short": "SELECT *, 10800::BIGINT AS threshold_s FROM furnace WHERE duration_s > 0 AND duration_s < 10800",
        "warnings": """SELECT site_id, 'floor_2_long_call' AS kind, ts FROM long UNION ALL SELECT site_id, 'floor_2_escalation', ts FROM esc
            UNION ALL SELECT site_id, 'floor_no_response', ts FROM nr UNION ALL SELECT site_id, 'zone_slow_to_heat', ts FROM slow
            UNION ALL SELECT site_id, 'observer_silence', ts FROM silence UNION ALL SELECT site_id, 'setpoint_miss', ended_at FROM miss
            UNION ALL SELECT site_id, 'furnace_short_call', ts FROM short""",
        "gs": """SELECT site_id, 'floor_call_active' AS metric, floor, ts, seq, CASE WHEN edge = 'started' THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM call_edges
            UNION ALL SELECT site_id, 'furnace_active', NULL, ts, seq, CASE WHEN edge = 'started' THEN 1.0 ELSE 0.0 END FROM furnace_edges
            UNION ALL SELECT site_id, 'heating_session_duration_s', NULL, ts, seq, duration_s FROM furnace WHERE duration_s IS NOT NULL
            UNION ALL SELECT site_id, 'floor_temperature_f', floor, ts, seq, current_temp FROM chg WHERE ct_changed
            UNION ALL SELECT site_id, 'floor_setpoint_f', floor, ts, seq, setpoint FROM chg WHERE (ct_changed OR sp_changed) AND setpoint IS NOT NULL
            UNION ALL SELECT site_id, 'outdoor_temperature_f', NULL, ts, seq, temperature_f FROM outdoor""",
        "ticks": "SELECT site_id, metric, floor, CAST(ceil(epoch_us(ts) / 21600000000.0) AS BIGINT) AS tick, max_by(value, (ts, seq)) AS value FROM gs GROUP BY ALL",
        "series": """SELECT g.site_id, g.metric, g.floor, make_timestamp(g.tick * 21600000000) AS ts, t.value
            FROM (SELECT site_id, metric, floor, unnest(range(min(tick), max(tick) + 1)) AS tick FROM ticks GROUP BY site_id, metric, floor) g
            ASOF JOIN (SELECT * REPLACE (coalesce(floor, '-') AS floor) FROM ticks) t
            ON t.site_id = g.site_id AND t.metric = g.metric AND t.floor = coalesce(g.floor, '-') AND g.tick >= t.tick""",
        "snapshots": """SELECT g.site_id, make_timestamp(g.tick * 21600000000) AS ts, c.floor, c.current_temp, c.setpoint, c.hvac_action,
        CASE WHEN CAST(o.ts AS DATE) = CAST(make_timestamp(g.tick * 21600000000) AS DATE) THEN o.temperature_f END AS outdoor_temp_f
        FROM (SELECT site_id, floor, make_timestamp(tick * 21600000000) AS at, tick FROM (SELECT site_id, unnest(range(min(t), max(t) + 1)) AS tick FROM (
          SELECT site_id, CAST(ceil(epoch_us(ts) / 21600000000.0) AS BIGINT) AS t FROM climate) GROUP BY site_id) CROSS JOIN (VALUES ('floor_1'), ('floor_2'), ('floor_3')) z(floor)) g
        ASOF JOIN climate c ON c.site_id = g.site_id AND c.floor = g.floor AND g.at >= c.ts
        ASOF LEFT JOIN outdoor o ON o.site_id = g.site_id AND g.at >= o.ts""",
        "snapshot": "SELECT site_id, "
        + each("max_by(value, (ts, seq)) FILTER (WHERE metric = 'floor_temperature_f' AND floor = '{f}') AS {f}_temp_f, max_by(value, (ts, seq)) FILTER (WHERE metric = 'floor_setpoint_f' AND floor = '{f}') AS {f}_setpoint_f, max_by(value, (ts, seq)) FILTER (WHERE metric = 'floor_call_active' AND floor = '{f}') AS {f}_calling")
        + ", max_by(value, (ts, seq)) FILTER (WHERE metric = 'outdoor_temperature_f') AS outdoor_temp_f, max_by(value, (ts, seq)) FILTER (WHERE metric = 'furnace_active') AS furnace_active FROM gs GROUP BY site_id",
        "open_now": """SELECT site_id, entity_id, floor, ts AS on_since FROM (
            SELECT *, row_number() OVER (PARTITION BY site_id, entity_id ORDER BY ts DESC, seq DESC) AS rn
            FROM (SELECT * FROM call_edges UNION ALL SELECT * FROM furnace_edges)) WHERE rn = 1 AND edge = 'started'""",
        "live": "SELECT site_id, CAST(coalesce(sum(d) FILTER (WHERE fact = 'furnace'), 0) AS BIGINT) AS furnace_committed_s, CAST(coalesce(sum(d) FILTER (WHERE fact = 'open' AND floor IS NULL), 0) AS BIGINT) AS furnace_in_flight_s, count(*) FILTER (WHERE fact = 'furnace' OR (fact = 'open' AND floor IS NULL)) AS session_count, "
        + each("CAST(coalesce(sum(d) FILTER (WHERE fact = 'call' AND floor = '{f}'), 0) AS BIGINT) AS {f}_committed_s, CAST(coalesce(sum(d) FILTER (WHERE fact = 'open' AND floor = '{f}'), 0) AS BIGINT) AS {f}_in_flight_s")
        + f""" FROM (SELECT site_id, 'call' AS fact, floor, duration_s AS d FROM calls WHERE CAST(ts AS DATE) = CAST({LIVE_AT} AS DATE)
            UNION ALL SELECT site_id, 'furnace', NULL, duration_s FROM furnace WHERE CAST(ts AS DATE) = CAST({LIVE_AT} AS DATE)
            UNION ALL SELECT site_id, 'open', floor, {secs('on_since', LIVE_AT)} FROM open_now
            UNION ALL SELECT DISTINCT site_id, 'idle', NULL, NULL::BIGINT FROM ev) GROUP BY site_id""",
        "live_t": "SELECT *, furnace_committed_s + furnace_in_flight_s AS furnace_today_s, " + each("{f}_committed_s + {f}_in_flight_s AS {f}_today_s") + " FROM live",
        "anom0": """SELECT * FROM (SELECT site_id, floor, date, total_runtime_s AS runtime_s, avg(total_runtime_s) OVER w AS m, stddev_pop(total_runtime_s) OVER w AS sd,
            count(*) OVER w AS n FROM floor_days WINDOW w AS (PARTITION BY site_id, floor ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
            WHERE n >= 3 AND m >= 300 AND runtime_s > m * 1.5""",
        "anom": f"""SELECT *, {SEVERITY.replace("CASE", "CASE WHEN sd = 0 THEN 'medium'", 1)} AS severity FROM (SELECT site_id, floor, date, runtime_s, m, sd, n,
            CASE WHEN sd = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, (abs((runtime_s - m) / sd) - 2) / 3)) END AS confidence FROM anom0)""",
        "base": """SELECT floor AS key, quantile_cont(duration_s, 0.95) AS p95 FROM calls WHERE duration_s IS NOT NULL GROUP BY floor""",
        "eff": f"""SELECT cohort, floor, round(sum(gain) / (sum(d) / 60), 3) AS score_f_per_min, count(*) AS session_count, round(sum(d) / 60, 1) AS total_runtime_min, round(sum(gain), 1) AS total_temp_gain_f
            FROM (SELECT site_id % 10 AS cohort, floor, ended_at AS ts, {secs('cycle_ts', 'ended_at')} AS d, end_temp - start_temp AS gain FROM cycles WHERE closed)
            WHERE d >= 60 AND gain > 0 AND ts >= {AS_OF} - INTERVAL 14 DAY AND ts <= {AS_OF} GROUP BY cohort, floor HAVING count(*) >= 5""",
        "marked": """SELECT *, CASE WHEN rn <= greatest(1, n * 3 // 4) THEN 'baseline' ELSE 'window' END AS part FROM (
            SELECT *, site_id % 10 AS cohort, row_number() OVER (PARTITION BY site_id % 10 ORDER BY ts, seq) AS rn, count(*) OVER (PARTITION BY site_id % 10) AS n FROM calls) WHERE n >= 8""",
        "shift": f"""SELECT cohort, floor, period, round(oc / ot, 3) AS observed_share, round(hc / ht, 3) AS historical_share,
            CASE WHEN hc > 0 THEN round((oc / ot) / (hc / ht), 2) END AS ratio, oc AS observed_count, ot AS observed_total, hc AS historical_count, ht AS historical_total
            FROM (SELECT *, CAST(sum(hc) OVER g AS BIGINT) AS ht, CAST(sum(oc) OVER g AS BIGINT) AS ot FROM (
              SELECT cohort, floor, {PERIOD} AS period, count(*) FILTER (WHERE part = 'baseline') AS hc, count(*) FILTER (WHERE part = 'window') AS oc FROM marked GROUP BY ALL)
              WINDOW g AS (PARTITION BY cohort, floor))
            WHERE ht >= 8 AND ot > 0 AND oc >= 3 AND (hc = 0 OR (oc / ot) / (hc / ht) >= 1.2)""",
        "weekly": """SELECT site_id % 10 AS cohort, floor, isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, avg(duration_s) AS m
            FROM calls WHERE duration_s IS NOT NULL GROUP BY ALL HAVING count(*) >= 3""",
        "degr": """SELECT cohort, floor, round(slope, 1) AS slope_s_per_week, n AS weeks_analysed, week_keys, weekly_mean_s, earliest_week, latest_week FROM (
            SELECT cohort, floor, coalesce(regr_slope(m, i), 0) AS slope, count(*) AS n, bool_or(rest < 2 AND fell) AS fell,
              string_agg(week, ',' ORDER BY week) AS week_keys, string_agg(CAST(round(m, 1) AS VARCHAR), ',' ORDER BY week) AS weekly_mean_s, min(week) AS earliest_week, max(week) AS latest_week
            FROM (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY cohort, floor) - row_number() OVER w AS rest, coalesce(m < lag(m) OVER w, false) AS fell
              FROM weekly WINDOW w AS (PARTITION BY cohort, floor ORDER BY week)) GROUP BY cohort, floor)
            WHERE n >= 3 AND slope >= 60 AND NOT fell""",
        "rt": "SELECT site_id, floor, ts, seq, CAST(ts AS DATE) AS date, duration_s, CAST(sum(duration_s) OVER (PARTITION BY site_id, floor, CAST(ts AS DATE) ORDER BY ts, seq) AS BIGINT) AS runtime_today_s FROM calls WHERE duration_s IS NOT NULL",
        "raw_totals": "SELECT site_id, floor, CAST(ended_at AS DATE) AS date, sum(duration_s) AS raw_s FROM calls WHERE duration_s IS NOT NULL GROUP BY ALL",
        "checked": """SELECT f.site_id, f.floor, f.date, f.total_runtime_s AS summary_s, CAST(coalesce(r.raw_s, 0) AS BIGINT) AS raw_s, CAST(f.total_runtime_s - coalesce(r.raw_s, 0) AS BIGINT) AS delta_s
            FROM (SELECT * REPLACE (total_runtime_s + CASE WHEN day(date) % 7 = 0 THEN 60 ELSE 0 END AS total_runtime_s) FROM floor_days) f
            LEFT JOIN (SELECT site_id, floor, CAST(ts AS DATE) AS date, sum(duration_s) AS raw_s FROM calls WHERE duration_s IS NOT NULL GROUP BY ALL) r USING (site_id, floor, date)""",
    }


def sql(select: str, until: str | None = None) -> str:
    """``select`` with the common table expressions it refers to, directly or through others."""
    tables = cte(until)
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in tables:
            if name not in seen and re.search(rf"\b(?:FROM|JOIN) {name}\b", text):
                seen.add(name)
                visit(tables[name])
                needed.append(name)

    visit(select)
    return ("WITH RECURSIVE " if "sent" in seen else "WITH ") + ",\n".join(f"{n} AS ({tables[n]})" for n in needed) + f"\n{select}"


D = "strftime(date, '%Y-%m-%d') AS date"
DOTS = "CAST(strftime({0}, '%Y-%m-%d') AS VARCHAR)"
LINES = """SELECT site_id, event_id * 4 + 1 AS seq, CASE event_id % 16 WHEN 1 THEN 'bad_source' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'empty_new_state,bad_climate_mode'
    WHEN 4 THEN 'not_an_object' WHEN 5 THEN 'bad_climate_mode' WHEN 6 THEN 'bad_schema' WHEN 7 THEN 'climate_temperature_not_numeric,climate_current_temperature_not_numeric'
    WHEN 8 THEN 'bad_ts' WHEN 10 THEN 'data_not_object' WHEN 11 THEN 'missing_data_fields' WHEN 12 THEN 'bad_binary_state' WHEN 13 THEN 'bad_outdoor_state'
    WHEN 14 THEN 'missing_top_level,bad_source' ELSE '' END AS errors, event_id % 16 = 9 AS unknown_entity FROM ev"""
CHANGE = "SELECT site_id, floor, ts, seq, setpoint, current_temp, hvac_mode, hvac_action FROM chg WHERE {0}"
GROWTH = (
    "CASE WHEN last_furnace_s <> 0 THEN round((this_furnace_s - last_furnace_s) / last_furnace_s * 100, 6) END AS furnace_pct, "
    "CASE WHEN last_sessions <> 0 THEN round((this_sessions - last_sessions) / last_sessions * 100, 6) END AS sessions_pct, "
    + each("CASE WHEN last_{f}_daily_s <> 0 THEN round((this_{f}_daily_s - last_{f}_daily_s) / last_{f}_daily_s * 100, 6) END AS {f}_pct")
)


def _week(name: str, test: str) -> str:
    w = f"FILTER (WHERE {test})"
    cols = f"count(*) {w} AS {name}_days, CAST(coalesce(sum(total_furnace_runtime_s) {w}, 0) AS BIGINT) AS {name}_furnace_s, CAST(coalesce(sum(session_count) {w}, 0) AS BIGINT) AS {name}_sessions, avg(outdoor_temp_avg_f) {w} AS {name}_outdoor_avg_f, "
    return cols + each("coalesce(coalesce(sum(runtime_{f}_s) W, 0) / nullif(count(*) W, 0), 0.0) AS N_{f}_daily_s, avg(setpoint_{f}_f) W AS N_{f}_setpoint_f").replace(" W", f" {w}").replace("N_", f"{name}_")


WEEKLY_COLS = [f"{w}_{c}" for w in ("this", "last") for c in ("outdoor_avg_f", *[f"{f}_{k}" for f in FLOORS for k in ("daily_s", "setpoint_f")])]
MONTH_SUMS = ["total_furnace_runtime_s", "session_count", *[c for f in FLOORS for c in (f"runtime_{f}_s", f"sessions_{f}")], *[f"warn_{k}" for k in WARNINGS]]
ALL_FDAYS = "site_id, total_furnace_runtime_s, session_count, outdoor_temp_min_f, outdoor_temp_max_f, outdoor_temp_avg_f, " + each("runtime_{f}_s, sessions_{f}")
AS = {"until": AS_OF}
LIVE = {"until": LIVE_AT}

ORACLE: dict[str, str] = {
    "read_log": sql("""SELECT site_id, seq, ts, entity_id, 'climate' AS kind, floor, hvac_mode AS new_state, setpoint, current_temp, hvac_action FROM climate
        UNION ALL SELECT site_id, event_id * 4, ts, 'sensor.outdoor_temperature', 'outdoor', NULL, CASE WHEN k % 17 = 0 THEN 'unavailable' ELSE CAST(value AS VARCHAR) END, NULL, NULL, NULL FROM ev WHERE event_type = 'view'"""),
    "flatten_state_changes": sql("""SELECT site_id, seq, ts, entity_id, old_state, new_state, setpoint FROM (
        SELECT site_id, seq, ts, entity_id, old_state, new_state, NULL::DOUBLE AS setpoint FROM call_obs
        UNION ALL SELECT site_id, seq, ts, entity_id, NULL, hvac_mode, setpoint FROM climate) WHERE NOT (entity_id LIKE 'climate%' AND new_state = 'off') AND NOT (entity_id LIKE 'binary%' AND old_state IS NULL)"""),
    "validate_observations": sql(LINES),
    "validation_summary": sql(f"""SELECT measure, count(*) AS n FROM (SELECT unnest(list_filter(string_split(errors, ','), lambda e: e <> '')
        || ['total', CASE WHEN errors = '' THEN 'valid' ELSE 'invalid' END] || CASE WHEN unknown_entity THEN ['unknown_entity'] ELSE [] END) AS measure FROM ({LINES})) GROUP BY measure"""),
    "derived_union": sql("""SELECT event_type, site_id, floor, ts, seq, duration_s, temperature_f, current_temp, setpoint, outdoor_temp_f FROM (
        SELECT 'floor_call_started' AS event_type, site_id, floor, ts, seq, NULL::BIGINT AS duration_s, NULL::DOUBLE AS temperature_f, NULL::DOUBLE AS current_temp, NULL::DOUBLE AS setpoint, NULL::DOUBLE AS outdoor_temp_f FROM call_edges WHERE edge = 'started'
        UNION ALL SELECT 'floor_call_ended', site_id, floor, ts, seq, duration_s, NULL, NULL, NULL, NULL FROM calls
        UNION ALL SELECT 'heating_session_started', site_id, NULL, ts, seq, NULL, NULL, NULL, NULL, NULL FROM furnace_edges WHERE edge = 'started'
        UNION ALL SELECT 'heating_session_ended', site_id, NULL, ts, seq, duration_s, NULL, NULL, NULL, outdoor_temp_f FROM furnace_o
        UNION ALL SELECT 'outdoor_temp_updated', site_id, NULL, ts, seq, NULL, temperature_f, NULL, NULL, NULL FROM outdoor
        UNION ALL SELECT 'zone_time_to_temp', site_id, floor, ts, seq, duration_s, NULL, NULL, setpoint, outdoor_temp_f FROM tt
        UNION ALL SELECT 'zone_overshoot', site_id, floor, ended_at, seq, overshoot_s, NULL, NULL, setpoint, outdoor_temp_f FROM over
        UNION ALL SELECT 'zone_setpoint_miss', m.site_id, m.floor, m.ended_at, m.end_seq, m.duration_s, NULL, NULL, m.setpoint, o.outdoor_temp_f FROM miss m JOIN climate_o o ON o.site_id = m.site_id AND o.seq = m.end_seq
        UNION ALL SELECT 'zone_slow_to_heat_warning', s.site_id, s.floor, s.ts, s.seq, s.elapsed_s, NULL, NULL, s.setpoint, o.outdoor_temp_f FROM slow s JOIN climate_o o USING (site_id, seq)
        UNION ALL SELECT 'floor_2_long_call_warning', site_id, floor, ts, seq, NULL, NULL, NULL, setpoint, NULL FROM long
        UNION ALL SELECT 'floor_2_long_call_escalation', site_id, floor, ts, seq, NULL, NULL, NULL, setpoint, NULL FROM esc
        UNION ALL SELECT 'floor_no_response_warning', site_id, floor, ts, seq, NULL, NULL, NULL, NULL, NULL FROM nr
        UNION ALL SELECT 'observer_silence_warning', site_id, NULL, ts, seq, gap_s, NULL, NULL, NULL, NULL FROM silence
        UNION ALL SELECT 'furnace_short_call_warning', site_id, NULL, ts, seq, duration_s, NULL, NULL, NULL, NULL FROM short
        UNION ALL SELECT CASE WHEN duration_s < 10800 THEN 'heating_short_session_warning' ELSE 'heating_long_session_warning' END, site_id, floor, ts, seq, duration_s, NULL, NULL, NULL, NULL
          FROM calls c LEFT JOIN base b ON b.key = c.floor WHERE duration_s < 10800
            OR duration_s > greatest(coalesce(b.p95 * 1.5, 0), CASE floor WHEN 'floor_1' THEN 1800.0 WHEN 'floor_2' THEN 2700.0 ELSE 1200.0 END)
        UNION ALL SELECT 'floor_daily_summary', site_id, floor, CAST(date + 1 AS TIMESTAMP), NULL, total_runtime_s, NULL, NULL, NULL, NULL FROM floor_days
        UNION ALL SELECT 'furnace_daily_summary', site_id, NULL, CAST(date + 1 AS TIMESTAMP), NULL, total_furnace_runtime_s, NULL, NULL, NULL, NULL FROM fdays
        UNION ALL SELECT 'floor_runtime_anomaly', site_id, floor, CAST(date + 1 AS TIMESTAMP), NULL, runtime_s, NULL, NULL, NULL, NULL FROM anom
        UNION ALL SELECT 'zone_temp_snapshot', site_id, floor, ts, NULL, NULL, NULL, current_temp, setpoint, outdoor_temp_f FROM snapshots
        UNION ALL SELECT 'thermostat_setpoint_changed', site_id, floor, ts, seq, NULL, NULL, current_temp, setpoint, NULL FROM chg WHERE sp_changed
        UNION ALL SELECT 'thermostat_current_temp_updated', site_id, floor, ts, seq, NULL, NULL, current_temp, setpoint, NULL FROM chg WHERE ct_changed
        UNION ALL SELECT 'thermostat_mode_changed', site_id, floor, ts, seq, NULL, NULL, current_temp, setpoint, NULL FROM chg WHERE md_changed
        UNION ALL SELECT 'thermostat_setpoint_reached', site_id, floor, ts, seq, NULL, NULL, current_temp, setpoint, NULL FROM chg WHERE reached)""", **AS),
    "session_export": sql("SELECT site_id, ended_at - to_seconds(duration_s) AS started_at, ended_at, duration_s, outdoor_temp_f, entity_id FROM furnace_o WHERE duration_s IS NOT NULL"),
    "entity_lookup": sql("""SELECT s.source, e.* FROM (
        SELECT entity_id, 'climate' AS kind, floor, count(*) AS n, count(DISTINCT site_id) AS sites FROM climate WHERE site_id % 7 <> 0 GROUP BY ALL
        UNION ALL SELECT entity_id, 'call', floor, count(*), count(DISTINCT site_id) FROM call_obs GROUP BY ALL
        UNION ALL SELECT entity_id, 'furnace', NULL, count(*), count(DISTINCT site_id) FROM furnace_obs GROUP BY ALL
        UNION ALL SELECT 'sensor.outdoor_temperature', 'outdoor', NULL, count(*), count(DISTINCT site_id) FROM ev WHERE event_type = 'view') e, (VALUES ('scheme'), ('table')) s(source)"""),
    "outdoor_readings": sql("SELECT * FROM outdoor"),
    "anomaly_confidence": sql(f"""SELECT *, {SEVERITY} AS severity FROM (SELECT site_id, event_id, z, round(least(1.0, greatest(0.0, (z - 2) / 3)), 6) AS confidence FROM (
        SELECT site_id, event_id, round(abs(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 6) AS z FROM ev WINDOW w AS (PARTITION BY site_id)))"""),
    "context_events": sql("""SELECT event_type, site_id, floor, ts, duration_s FROM (
        SELECT 'heating_session_ended' AS event_type, site_id, NULL::VARCHAR AS floor, ts, duration_s, NULL::DATE AS date FROM furnace
        UNION ALL SELECT 'floor_daily_summary', site_id, floor, CAST(date + 1 AS TIMESTAMP), total_runtime_s, date FROM floor_days
        UNION ALL SELECT 'furnace_daily_summary', site_id, NULL, CAST(date + 1 AS TIMESTAMP), total_furnace_runtime_s, date FROM fdays
        UNION ALL SELECT 'furnace_short_call_warning', site_id, NULL, ts, duration_s, NULL FROM short
        UNION ALL SELECT 'observer_silence_warning', site_id, NULL, ts, gap_s, NULL FROM silence
        UNION ALL SELECT 'floor_2_long_call_warning', site_id, floor, ts, NULL, NULL FROM long
        UNION ALL SELECT 'floor_no_response_warning', site_id, floor, ts, NULL, NULL FROM nr
        UNION ALL SELECT 'floor_runtime_anomaly', site_id, floor, CAST(date + 1 AS TIMESTAMP), runtime_s, NULL FROM anom)
        WHERE (ts >= TIMESTAMP '2024-01-17 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00') OR date = DATE '2024-01-16'""", **AS),
    "call_edges": sql("SELECT * FROM call_edges"),
    "floor_calls": sql("SELECT site_id, entity_id, floor, seq, started_at, ended_at, duration_s FROM calls"),
    "furnace_sessions": sql("SELECT site_id, entity_id, seq, started_at, ended_at, duration_s, outdoor_temp_f FROM furnace_o"),
    "setpoint_changes": sql(CHANGE.format("sp_changed")),
    "temp_updates": sql(CHANGE.format("ct_changed")),
    "mode_changes": sql(CHANGE.format("md_changed")),
    "setpoint_reached": sql(CHANGE.format("reached")),
    "heating_cycles": sql("SELECT site_id, floor, cycle_ts, cycle_seq, start_temp, readings, closed, ended_at, end_temp, reached_at, adjusted FROM cycles"),
    "open_sessions": sql("SELECT * FROM open_now", **LIVE),
    "zone_time_to_temp": sql("SELECT * FROM tt"),
    "zone_overshoot": sql("SELECT * FROM over"),
    "zone_setpoint_miss": sql("""SELECT m.* EXCLUDE (end_seq, cycle_seq), m.end_seq AS seq, o.outdoor_temp_f, z.other_zones FROM miss m
        JOIN climate_o o ON o.site_id = m.site_id AND o.seq = m.end_seq JOIN zones_start z ON z.site_id = m.site_id AND z.seq = m.cycle_seq"""),
    "zone_slow_to_heat": sql("""SELECT s.site_id, s.entity_id, s.floor, s.cycle_ts AS started_at, s.ts, s.seq, s.elapsed_s, s.start_temp, s.current_temp, s.setpoint, o.outdoor_temp_f,
        s.setpoint - s.start_temp AS setpoint_delta, s.current_temp - s.start_temp AS degrees_gained FROM slow s JOIN climate_o o USING (site_id, seq)"""),
    "asof_outdoor": sql("SELECT f.site_id, f.ended_at, f.seq, f.duration_s, o.temperature_f AS outdoor_temp_f FROM furnace f ASOF LEFT JOIN outdoor o ON f.site_id = o.site_id AND f.ts >= o.ts"),
    "asof_outdoor_stale": sql(f"SELECT f.site_id, f.ended_at, f.seq, f.duration_s, CASE WHEN {secs('o.ts', 'f.ts')} <= 86400 THEN o.temperature_f END AS outdoor_temp_f FROM furnace f ASOF LEFT JOIN outdoor o ON f.site_id = o.site_id AND f.ts >= o.ts"),
    "other_zones_calling": sql("SELECT site_id, floor, ts, seq, other_zones FROM zones_start"),
    "floor_daily_summary": sql(f"SELECT * REPLACE ({D}) FROM floor_days"),
    "furnace_daily_summary": sql(f"SELECT * REPLACE ({D}) FROM fdays_w", **AS),
    "day_summary": sql(f"SELECT {ALL_FDAYS}, {D}, " + ", ".join(f"warn_{k}" for k in WARNINGS) + ", " + each("CASE WHEN date <= DATE '2024-01-15' THEN setpoint_{f}_f END AS setpoint_{f}_f") + ", CASE WHEN date <= DATE '2024-01-15' THEN 'stored' ELSE 'recomputed' END AS source FROM fdays_w", **AS),
    "monthly_summary": sql("SELECT site_id, strftime(date_trunc('month', date), '%Y-%m') AS month, day(last_day(date_trunc('month', date))) AS days_in_month, count(*) AS day_count, "
        + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in MONTH_SUMS)
        + ", round(sum(CAST(round(outdoor_temp_avg_f * 1000000) AS BIGINT)) / count(outdoor_temp_avg_f) / 1000000, 1) AS outdoor_avg_f, round(min(outdoor_temp_min_f), 1) AS outdoor_min_f, round(max(outdoor_temp_max_f), 1) AS outdoor_max_f FROM fdays_w GROUP BY site_id, date_trunc('month', date)", **AS),
    "weekly_comparison": sql("SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in WEEKLY_COLS) + f"), {GROWTH}, last_days < 7 AS partial, this_floor_2_daily_s > last_floor_2_daily_s AS floor_2_up FROM (SELECT site_id, {_week('this', 'r <= 7')}, {_week('last', 'r > 7')} FROM (SELECT *, dense_rank() OVER (PARTITION BY site_id ORDER BY date DESC) AS r FROM fdays) WHERE r <= 14 GROUP BY site_id HAVING max(r) >= 7)"),
    "runtime_trend": sql("SELECT s.site_id, strftime(s.date, '%Y-%m-%d') AS date, " + each("max(total_runtime_s) FILTER (WHERE floor = '{f}') AS {f}_s") + """, max(outdoor_temp_avg_f) AS outdoor_temp_f
        FROM (SELECT site_id, CAST(unnest(generate_series(TIMESTAMP '2024-01-16', max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM floor_days WHERE date BETWEEN DATE '2024-01-16' AND DATE '2024-01-29' GROUP BY site_id) s
        LEFT JOIN floor_days f ON f.site_id = s.site_id AND f.date = s.date GROUP BY s.site_id, s.date"""),
    "floor_trend": sql(f"SELECT site_id, {D}, total_calls, total_runtime_s, avg_duration_s, max_duration_s, outdoor_temp_avg_f FROM floor_days WHERE floor = 'floor_2' AND date BETWEEN DATE '2024-01-16' AND DATE '2024-01-29'"),
    "duty_cycle": sql("""SELECT site_id, count(on_s) AS session_count, round(coalesce(sum(on_s), 0.0::DOUBLE), 3) AS total_on_s, 604799.0::DOUBLE AS window_duration_s, round(coalesce(sum(on_s), 0.0::DOUBLE) / 604799 * 100, 6) AS duty_cycle_pct, count(*) FILTER (WHERE on_s < duration_s) AS clipped_count
        FROM (SELECT DISTINCT site_id FROM ev) LEFT JOIN (SELECT * FROM (SELECT site_id, duration_s, (epoch_us(least(ended_at, TIMESTAMP '2024-01-16 23:59:59')) - epoch_us(greatest(ended_at - to_seconds(duration_s), TIMESTAMP '2024-01-10'))) / 1000000 AS on_s FROM furnace WHERE duration_s IS NOT NULL) WHERE on_s > 0) USING (site_id) GROUP BY site_id"""),
    "duty_cycle_windows": sql("""SELECT site_id, strftime(date, '%Y-%m-%d') AS window_id, count(*) AS session_count, round(sum(on_us) / 1000000, 3) AS total_on_s, 259200.0::DOUBLE AS window_duration_s,
        round(sum(on_us) / 1000000 / 259200 * 100, 6) AS duty_cycle_pct, count(*) FILTER (WHERE on_us < duration_s * 1000000) AS clipped_count FROM (
        SELECT s.site_id, w.date, s.duration_s, least(epoch_us(s.ended_at), epoch_us(CAST(w.date + 3 AS TIMESTAMP))) - greatest(epoch_us(s.ended_at) - s.duration_s * 1000000, epoch_us(CAST(w.date AS TIMESTAMP))) AS on_us
        FROM furnace s, (SELECT DISTINCT date FROM days) w WHERE s.duration_s > 0) WHERE on_us > 0 GROUP BY ALL"""),
    "temp_correlation": sql(f"SELECT site_id, floor, n, round(r, 6) AS r, {LABEL} AS label FROM (SELECT site_id, floor, count(*) AS n, {r_of('outdoor_temp_avg_f', 'total_runtime_s')} AS r FROM floor_days WHERE outdoor_temp_avg_f IS NOT NULL GROUP BY ALL)"),
    "session_temp_correlation": sql(f"""SELECT * REPLACE (round(r, 6) AS r), {LABEL} AS label FROM (SELECT site_id, count(*) AS total, count(outdoor_temp_f) AS with_temp, count(*) - count(outdoor_temp_f) AS without_temp,
        count(DISTINCT CAST(ended_at AS DATE)) AS days, strftime(min(ended_at), '%Y-%m-%d') AS first_date, strftime(max(ended_at), '%Y-%m-%d') AS last_date,
        round(avg(duration_s) FILTER (WHERE outdoor_temp_f IS NOT NULL), 6) AS avg_duration_s, round(avg(outdoor_temp_f), 6) AS avg_outdoor_f, {r_of('outdoor_temp_f', 'duration_s')} AS r FROM furnace_o WHERE duration_s IS NOT NULL GROUP BY site_id)"""),
    "floor_runtime_summary": sql("SELECT site_id, floor, count(DISTINCT date) AS days, CAST(sum(total_runtime_s) AS BIGINT) AS total_s, max(total_runtime_s) AS max_s, CAST(sum(total_runtime_s) // count(DISTINCT date) AS BIGINT) AS avg_s FROM floor_days WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL"),
    "duration_baseline_merged": sql("SELECT floor AS key, count(*) AS count, min(duration_s) AS min, max(duration_s) AS max, true AS median_near, true AS p75_near, true AS p95_near FROM calls WHERE duration_s IS NOT NULL GROUP BY floor"),
    "duration_baseline": sql("SELECT site_id, floor AS key, count(*) AS count, min(duration_s) AS min, max(duration_s) AS max, round(quantile_cont(duration_s, 0.5), 6) AS median, round(quantile_cont(duration_s, 0.75), 6) AS p75, round(quantile_cont(duration_s, 0.95), 6) AS p95 FROM calls WHERE duration_s IS NOT NULL GROUP BY site_id, floor"),
    "warnings_daily": sql(f"SELECT site_id, {D}, " + ", ".join(f"warn_{k} AS {k}" for k in WARNINGS) + " FROM wdaily", **AS),
    "live_status": sql("SELECT * FROM live_t", **LIVE),
    "reconcile_daily": sql(f"SELECT * REPLACE ({D}) FROM checked WHERE delta_s <> 0"),
    "reconcile_totals": sql("SELECT site_id, count(DISTINCT date) AS days_checked, count(*) AS pairs_checked, count(*) FILTER (WHERE delta_s <> 0) AS mismatches, CAST(sum(abs(delta_s)) AS BIGINT) AS abs_delta_s FROM checked GROUP BY site_id"),
    "unreconciled_days": sql(f"SELECT DISTINCT site_id, {D} FROM raw_totals WHERE (site_id, date) NOT IN (SELECT (site_id, date) FROM floor_days WHERE date <= DATE '2024-01-15')"),
    "floor_runtime_anomaly": sql(f"SELECT site_id, floor, {D}, runtime_s, round(m, 4) AS baseline_mean_s, round(sd, 4) AS baseline_stddev_s, n AS history_count, round(m * 1.5, 4) AS threshold_s, round(confidence, 4) AS confidence, severity FROM anom"),
    "session_duration_anomaly": sql(f"""SELECT *, {SEVERITY} AS severity FROM (SELECT site_id, floor, ts, seq, duration_s, CASE WHEN short THEN 'short' ELSE 'long' END AS finding, round(CASE WHEN short THEN 10800 ELSE lim END, 4) AS threshold_s,
        CASE WHEN NOT short THEN round(p95, 4) END AS baseline_p95_s, CASE WHEN short THEN 'short_cycle' ELSE 'overheating_risk' END AS likely_cause,
        round(CASE WHEN short THEN 1.0 ELSE least(1.0, greatest(0.0, (abs((duration_s - lim) / lim) - 2) / 3)) END, 4) AS confidence
        FROM (SELECT c.*, b.p95, duration_s < 10800 AS short, greatest(coalesce(b.p95 * 1.5, 0), CASE floor WHEN 'floor_1' THEN 1800.0 WHEN 'floor_2' THEN 2700.0 ELSE 1200.0 END) AS lim FROM calls c LEFT JOIN base b ON b.key = c.floor WHERE duration_s IS NOT NULL)
        WHERE short OR duration_s > lim)"""),
    "furnace_short_calls": sql("SELECT site_id, entity_id, seq, started_at, ended_at, duration_s, threshold_s FROM short"),
    "heating_efficiency": sql("SELECT * FROM eff"),
    "efficiency_extremes": sql("""SELECT cohort, w.floor AS worst_floor, w.score AS worst_score, b.floor AS best_floor, b.score AS best_score FROM (
        SELECT cohort, min({'score': score_f_per_min, 'floor': floor}) AS w, max({'score': score_f_per_min, 'floor': floor}) AS b FROM eff GROUP BY cohort HAVING count(*) > 1)"""),
    "time_of_day_shift": sql("SELECT * FROM shift"),
    "efficiency_degradation": sql("SELECT * FROM degr"),
    "insights": sql("""SELECT 'heating_efficiency' AS insight, cohort, floor, score_f_per_min, session_count, NULL::DOUBLE AS slope_s_per_week, NULL::BIGINT AS weeks_analysed, NULL::VARCHAR AS period, NULL::DOUBLE AS ratio, NULL::BIGINT AS observed_count, NULL::BIGINT AS historical_count FROM eff
        UNION ALL SELECT 'efficiency_degradation', cohort, floor, NULL, NULL, slope_s_per_week, weeks_analysed, NULL, NULL, NULL, NULL FROM degr
        UNION ALL SELECT 'time_of_day_shift', cohort, floor, NULL, NULL, NULL, NULL, period, ratio, observed_count, historical_count FROM shift"""),
    "long_call_warnings": sql("SELECT * FROM long", **AS),
    "long_call_escalations": sql("SELECT * FROM esc", **AS),
    "silence_gaps": sql("SELECT * FROM silence", **AS),
    "floor_no_response": sql("SELECT * FROM nr", **AS),
    "alert_throttle": sql("""SELECT a.site_id, 'floor_2_long_call' AS kind, a.floor, a.ts, a.seq, a.i IN (SELECT s.i FROM sent s WHERE s.site_id = a.site_id) AS sent,
        CASE WHEN EXISTS (SELECT 1 FROM sent s WHERE s.site_id = a.site_id AND s.i = a.i) THEN a.i - 1 - coalesce((SELECT max(s.i) FROM sent s WHERE s.site_id = a.site_id AND s.i < a.i), 0) ELSE 0 END AS suppressed_before FROM al a""", **AS),
    "late_alerts": sql("SELECT site_id, ts, event_id * 4 + 1 AS seq, sent_at, coalesce((epoch_us(sent_at) - epoch_us(ts)) / 1000000 > 300, false) AS late FROM (SELECT *, lead(ts) OVER (PARTITION BY site_id ORDER BY ts, event_id) AS sent_at FROM ev)", **AS),
    "recent_sessions": sql("SELECT site_id, entity_id, seq, started_at, ended_at, duration_s, outdoor_temp_f, rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC, seq DESC) AS rank FROM furnace_o) WHERE rank <= 8"),
    "recent_warnings": sql("""SELECT * FROM (SELECT site_id, 'call lasts too long' AS label, floor, ts, NULL::BIGINT AS duration_s FROM long UNION ALL SELECT site_id, 'furnace ran too briefly', NULL, ts, duration_s FROM short
        UNION ALL SELECT site_id, 'no readings from the site', NULL, ts, gap_s FROM silence
        UNION ALL SELECT site_id, 'floor stays cold while calling', floor, ts, NULL FROM nr
        UNION ALL SELECT site_id, 'unusual runtime of a floor', floor, CAST(date + 1 AS TIMESTAMP), runtime_s FROM anom)
        WHERE ts BETWEEN TIMESTAMP '2024-01-25 00:00:00' AND TIMESTAMP '2024-01-28 00:00:00'""", **AS),
    "latest_gauges": sql("SELECT site_id, metric, floor, max_by(value, (ts, seq)) AS value, max(ts) AS ts FROM gs GROUP BY ALL"),
    "gauge_series": sql("SELECT * FROM series"),
    "runtime_today": sql(f"SELECT * REPLACE ({D}) FROM rt"),
    "anomaly_counter": sql(f"SELECT site_id, floor, strftime(date, '%Y-%m-%d') AS date, count(*) OVER (PARTITION BY site_id, floor ORDER BY anom.date) AS anomalies_total FROM anom"),
    "hourly_increase": sql("""SELECT site_id, floor, date_trunc('hour', ts) AS hour, CAST(sum(CASE WHEN b IS NULL OR runtime_today_s < b THEN runtime_today_s ELSE runtime_today_s - b END) AS BIGINT) AS increase
        FROM (SELECT *, lag(runtime_today_s) OVER (PARTITION BY site_id, floor ORDER BY ts, seq) AS b FROM rt) GROUP BY ALL"""),
    "series_reduce": sql("SELECT site_id, metric, floor, max_by(value, ts) AS last, max_by(value, ts) AS last_not_null, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, count(value) AS n FROM series GROUP BY ALL"),
    "current_snapshot": sql("SELECT * FROM snapshot"),
    "zone_snapshots": sql("SELECT * FROM snapshots"),
    "context_rollup": sql("SELECT *, 'current' AS section, '2024-01-20' AS date, NULL::BIGINT AS session_count, NULL::BIGINT AS furnace_runtime_s, " + each("NULL::BIGINT AS {f}_runtime_s") + ", NULL::DOUBLE AS outdoor_temp_min_f, NULL::DOUBLE AS outdoor_temp_max_f, NULL::DOUBLE AS outdoor_temp_avg_f FROM snapshot"
        + " UNION ALL BY NAME SELECT site_id, 'today' AS section, '2024-01-20' AS date, session_count, furnace_today_s AS furnace_runtime_s, " + each("{f}_today_s AS {f}_runtime_s") + " FROM live_t"
        + " UNION ALL BY NAME SELECT site_id, CASE WHEN date = DATE '2024-01-19' THEN 'yesterday' ELSE 'older' END AS section, strftime(date, '%Y-%m-%d') AS date, session_count, total_furnace_runtime_s AS furnace_runtime_s, " + each("runtime_{f}_s AS {f}_runtime_s")
        + ", outdoor_temp_min_f, outdoor_temp_max_f, outdoor_temp_avg_f FROM fdays WHERE date >= DATE '2024-01-17' AND date < DATE '2024-01-20'", **LIVE),
    "restart_tag": sql("""SELECT site_id, floor, event_type, ts, strftime(ts, '%Y-%m-%d') AS run_id, coalesce((ts, seq) <= (first_ts, first_seq), true) AS across_restart
        FROM (SELECT *, min(ts) FILTER (WHERE event_type <> 'zone_overshoot') OVER r AS first_ts, min(seq) FILTER (WHERE event_type <> 'zone_overshoot') OVER (PARTITION BY site_id, CAST(ts AS DATE), ts) AS fs,
          arg_min(CASE WHEN event_type <> 'zone_overshoot' THEN seq END, CASE WHEN event_type <> 'zone_overshoot' THEN ts END) OVER r AS first_seq
        FROM (SELECT site_id, floor, ts, seq, 'zone_time_to_temp' AS event_type FROM tt UNION ALL SELECT site_id, floor, ended_at, -1, 'zone_overshoot' FROM over UNION ALL SELECT site_id, floor, ended_at, -1, 'zone_setpoint_miss' FROM miss)
        WINDOW r AS (PARTITION BY site_id, CAST(ts AS DATE)))"""),
    "st_ingest": sql("SELECT site_id, seq, ts, entity_id, hvac_mode AS new_state, setpoint FROM climate"),
    "st_calls": sql("SELECT site_id, entity_id, floor, ended_at, seq, started_at, duration_s FROM (SELECT * FROM calls UNION ALL SELECT * FROM furnace)"),
    "st_resume": sql("SELECT site_id, entity_id, floor, ended_at, seq, started_at, duration_s FROM calls"),
    "st_cycles": sql("""SELECT 'thermostat_setpoint_changed' AS event_type, c.site_id, c.floor, c.ts, c.seq, NULL::BIGINT AS duration_s, NULL::DOUBLE AS peak_temp, NULL::VARCHAR AS likely_cause, o.outdoor_temp_f, z.other_zones
          FROM chg c JOIN climate_o o USING (site_id, seq) JOIN zones_all z USING (site_id, seq) WHERE sp_changed
        UNION ALL SELECT 'thermostat_current_temp_updated', c.site_id, c.floor, c.ts, c.seq, NULL, NULL, NULL, o.outdoor_temp_f, z.other_zones FROM chg c JOIN climate_o o USING (site_id, seq) JOIN zones_all z USING (site_id, seq) WHERE ct_changed
        UNION ALL SELECT 'thermostat_mode_changed', c.site_id, c.floor, c.ts, c.seq, NULL, NULL, NULL, o.outdoor_temp_f, z.other_zones FROM chg c JOIN climate_o o USING (site_id, seq) JOIN zones_all z USING (site_id, seq) WHERE md_changed
        UNION ALL SELECT 'thermostat_setpoint_reached', c.site_id, c.floor, c.ts, c.seq, NULL, NULL, NULL, o.outdoor_temp_f, z.other_zones FROM chg c JOIN climate_o o USING (site_id, seq) JOIN zones_all z USING (site_id, seq) WHERE reached
        UNION ALL SELECT 'zone_time_to_temp', site_id, floor, ts, seq, duration_s, NULL, NULL, outdoor_temp_f, other_zones FROM tt
        UNION ALL SELECT 'zone_overshoot', o.site_id, o.floor, o.ended_at, c.end_seq, o.overshoot_s, o.peak_temp, NULL, o.outdoor_temp_f, o.other_zones FROM over o JOIN cycles c ON c.site_id = o.site_id AND c.entity_id = o.entity_id AND c.cycle_ts = o.started_at
        UNION ALL SELECT 'zone_setpoint_miss', m.site_id, m.floor, m.ended_at, m.end_seq, m.duration_s, m.closest_temp, m.likely_cause, o.outdoor_temp_f, z.other_zones FROM miss m
          JOIN climate_o o ON o.site_id = m.site_id AND o.seq = m.end_seq JOIN zones_start z ON z.site_id = m.site_id AND z.seq = m.cycle_seq
        UNION ALL SELECT 'zone_slow_to_heat_warning', s.site_id, s.floor, s.ts, s.seq, s.elapsed_s, NULL, NULL, o.outdoor_temp_f, z.other_zones FROM slow s JOIN climate_o o USING (site_id, seq) JOIN zones_all z USING (site_id, seq)"""),
    "st_alarms": sql("""SELECT * FROM (SELECT site_id, 'floor_2_long_call' AS kind, floor, ts, started_at AS since FROM long UNION ALL SELECT site_id, 'floor_no_response', floor, ts, call_start_time FROM nr
        UNION ALL SELECT site_id, 'observer_silence', NULL, ts, last_event_ts FROM silence)"""),
    "st_daily": sql(f"SELECT * REPLACE ({D}) FROM fdays"),
    "st_floor_days": sql(f"SELECT * REPLACE ({D}) FROM floor_days"),
    "st_late": sql("SELECT site_id, count(*) AS rows, 0::BIGINT AS twice FROM call_obs GROUP BY site_id"),
    "st_gauges": sql("SELECT site_id, metric, floor, max_by(value, (ts, seq)) AS value, max(ts) AS ts FROM gs GROUP BY ALL"),
    "backfill": sql("SELECT site_id, entity_id, floor, ended_at, seq, duration_s FROM calls WHERE ended_at >= TIMESTAMP '2024-01-16'"),
}

# the streams run on past the last event, so that every alarm comes due
ORACLE["st_alarms"] = ORACLE["st_alarms"].replace(AS_OF, "TIMESTAMP '2024-12-31 00:00:00'")
ORACLE["st_backfill"] = f"""SELECT * FROM ({ORACLE["st_cycles"]}) WHERE ts >= TIMESTAMP '2024-01-16'
    UNION ALL BY NAME SELECT kind AS event_type, site_id, floor, ts FROM ({ORACLE["st_alarms"]}) WHERE ts > TIMESTAMP '2024-01-16'"""
