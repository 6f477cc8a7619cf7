"""Queries over runs, debounced states and events."""
from pyspark.sql import functions as F

from roadrisk.constants import RISK_PRESETS
from roadrisk.functions import ttc as X
from roadrisk.operators import events as E
from roadrisk.operators import risk_states as R
from roadrisk.operators.lineage import cut
from roadrisk.operators.sequence import previous
from roadrisk.plans import sqltext as Q
from roadrisk.plans.inputs import truth, union_predictions
from roadrisk.plans.registry import query


@query("step_deltas", """SELECT trip_id, frame_id, t_sec - lag(t_sec) OVER w AS step, frame_id - lag(frame_id) OVER w AS id_step
FROM frames WINDOW w AS (PARTITION BY trip_id ORDER BY frame_id)""", "step")
def _(t):
    f = previous(t.frames.select("trip_id", "frame_id", "t_sec"), ["trip_id"], ["frame_id"],
                 {"_t": "t_sec", "_f": "frame_id"})
    return f.select("trip_id", "frame_id", (F.col("t_sec") - F.col("_t")).alias("step"),
                    (F.col("frame_id") - F.col("_f")).alias("id_step"))


@query("count_episodes", """SELECT trip_id, count(*) FILTER (WHERE min_ttc < 3 AND NOT coalesce(before < 3, false)) AS episodes
FROM (SELECT *, lag(min_ttc) OVER (PARTITION BY trip_id ORDER BY frame_id) AS before FROM frames) GROUP BY trip_id""")
def _(t):
    return E.count_episodes(t.frames, F.col("min_ttc") < 3.0)


def runs_sql(src, cond, gap, aggs="", keys="trip_id"):
    """Islands over row positions; ``src`` has keys and frame_id."""
    return f"""SELECT {keys}, min(position) AS run_start, max(position) AS run_end, count(*) AS active_rows,
 min(frame_id) AS first_frame_id, max(frame_id) AS last_frame_id{aggs}
FROM (SELECT *, sum(CASE WHEN position - before <= {gap} + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY position) AS island
 FROM (SELECT *, lag(position) OVER (PARTITION BY {keys} ORDER BY position) AS before
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY frame_id) - 1 AS position FROM {src}) p0 WHERE {cond}) p1) p2
GROUP BY {keys}, island"""


@query("runs", runs_sql("frames", "min_ttc < 2", 2))
def _(t):
    return E.runs(t.frames, X.is_danger("min_ttc"), 2)


@query("error_episodes", f"""WITH e AS (SELECT *, CASE WHEN predicted_ttc < 2 THEN 'FP' ELSE 'FN' END AS error_type
  FROM {Q.UNION} WHERE (predicted_ttc < 2) <> (truth_ttc < 2)),
 i AS (SELECT *, sum(CASE WHEN frame_id - before <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY trip_id, error_type ORDER BY frame_id) AS island
  FROM (SELECT *, lag(frame_id) OVER (PARTITION BY trip_id, error_type ORDER BY frame_id) AS before FROM e)),
 src AS (SELECT *, row_number() OVER (PARTITION BY trip_id, error_type, island ORDER BY n DESC, first) AS rn
  FROM (SELECT trip_id, error_type, island, union_source, count(*) AS n, min(frame_id) AS first FROM i
   GROUP BY trip_id, error_type, island, union_source))
SELECT_FINAL i.trip_id, i.error_type, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS error_frames,
 round(count(*) / 20, 2) AS duration_s,
 arg_min(frame_id, (CASE WHEN i.error_type = 'FP' THEN predicted_ttc ELSE truth_ttc END, frame_id)) AS representative_frame,
 arg_min(predicted_ttc, (CASE WHEN i.error_type = 'FP' THEN predicted_ttc ELSE truth_ttc END, frame_id)) AS predicted_ttc,
 arg_min(truth_ttc, (CASE WHEN i.error_type = 'FP' THEN predicted_ttc ELSE truth_ttc END, frame_id)) AS truth_ttc,
 arg_min(frame_id % 7 + 1, (CASE WHEN i.error_type = 'FP' THEN predicted_ttc ELSE truth_ttc END, frame_id)) AS selected_track_id,
 min(src.union_source) AS dominant_source
FROM i JOIN src ON i.trip_id = src.trip_id AND i.error_type = src.error_type AND i.island = src.island AND src.rn = 1
GROUP BY i.trip_id, i.error_type, i.island""", "duration_s predicted_ttc truth_ttc")
def _(t):
    return E.error_episodes(union_predictions(t).withColumn("selected_track_id", F.col("frame_id") % 7 + 1))


@query("lost_danger_episodes", runs_sql(
    f"{Q.UNION}", "truth_ttc < 2 AND predicted_ttc < 2 AND NOT classical_ttc < 2", 0,
    ", min(predicted_ttc) AS kept_ttc_min, min(classical_ttc) AS lost_ttc_min"), "kept_ttc_min lost_ttc_min")
def _(t):
    return E.lost_danger_episodes(union_predictions(t), "predicted_ttc", "classical_ttc")


@query("collapse_ranges", """SELECT trip_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ';' ORDER BY a) AS ranges
FROM (SELECT trip_id, min(frame_id) AS a, max(frame_id) AS b FROM (SELECT trip_id, frame_id,
  frame_id - row_number() OVER (PARTITION BY trip_id ORDER BY frame_id) AS g FROM frames WHERE min_ttc < 2) GROUP BY trip_id, g)
GROUP BY trip_id""")
def _(t):
    return E.collapse_ranges(t.frames.filter(X.is_danger("min_ttc")))


def fsm_sql(src: str, presets: str) -> str:
    """Recursive walk over rows (trip_id, frame_id, ttc, reliable) of ``src`` under ``presets``."""
    return f"""presets(preset, enter, enter_critical, leave, warn, calm, gap) AS ({presets}),
 fr AS (SELECT trip_id, frame_id, ttc, row_number() OVER (PARTITION BY trip_id ORDER BY frame_id) AS rn,
  CASE WHEN NOT reliable THEN 'UNKNOWN' WHEN ttc < 15e-1 THEN 'CRITICAL' WHEN ttc < 2 THEN 'DANGER'
   WHEN ttc < 3 THEN 'WARNING' ELSE 'SAFE' END AS band FROM {src}),
 walk AS (
  SELECT trip_id, preset, CAST(0 AS BIGINT) AS rn, 'NORMAL' AS state, 0 AS d, 0 AS a, 0 AS dc, 0 AS ac, '' AS reason FROM (SELECT DISTINCT trip_id FROM fr), presets
  UNION ALL
  SELECT trip_id, preset, rn, CASE reason WHEN 'unreliable' THEN 'UNKNOWN' WHEN 'danger_exit_confirmed' THEN CASE WHEN warm THEN 'ATTENTIVE' ELSE 'NORMAL' END
    WHEN 'danger_held' THEN 'HIGH_RISK' WHEN 'danger_enter_confirmed' THEN 'HIGH_RISK' WHEN 'attentive_exit_confirmed' THEN 'NORMAL'
    WHEN 'attentive_held' THEN 'ATTENTIVE' WHEN 'attentive_enter_confirmed' THEN 'ATTENTIVE' ELSE was END,
   d, a, CASE WHEN reason IN ('unreliable', 'danger_exit_confirmed', 'danger_enter_confirmed') THEN 0 WHEN was = 'HIGH_RISK' THEN dc ELSE dc0 END,
   CASE WHEN reason IN ('unreliable', 'attentive_exit_confirmed', 'attentive_enter_confirmed') THEN 0 WHEN reason = 'attentive_held' THEN ac ELSE ac0 END, reason
  FROM (SELECT *, CASE WHEN band = 'UNKNOWN' THEN 'unreliable'
     WHEN was = 'HIGH_RISK' THEN CASE WHEN dc >= leave THEN 'danger_exit_confirmed' ELSE 'danger_held' END
     WHEN hot AND d >= (CASE WHEN band = 'CRITICAL' THEN enter_critical ELSE enter END) THEN 'danger_enter_confirmed'
     WHEN was = 'ATTENTIVE' THEN CASE WHEN ac >= calm THEN 'attentive_exit_confirmed' ELSE 'attentive_held' END
     WHEN warm AND a >= warn THEN 'attentive_enter_confirmed' ELSE 'normal' END AS reason
   FROM (SELECT w.trip_id, w.preset, f.rn, f.band, p.*, f.band IN ('DANGER', 'CRITICAL') AS hot, f.band IN ('WARNING', 'DANGER', 'CRITICAL') AS warm,
      CASE WHEN w.state = 'UNKNOWN' THEN 'NORMAL' ELSE w.state END AS was,
      CASE WHEN f.band IN ('DANGER', 'CRITICAL') THEN w.d + 1 ELSE 0 END AS d,
      CASE WHEN f.band IN ('WARNING', 'DANGER', 'CRITICAL') THEN w.a + 1 ELSE 0 END AS a,
      CASE WHEN f.band IN ('DANGER', 'CRITICAL') THEN 0 ELSE w.dc + 1 END AS dc, w.dc AS dc0,
      CASE WHEN f.band IN ('WARNING', 'DANGER', 'CRITICAL') THEN 0 ELSE w.ac + 1 END AS ac, w.ac AS ac0
     FROM walk w JOIN fr f ON f.trip_id = w.trip_id AND f.rn = w.rn + 1
     JOIN (SELECT preset AS pname, enter, enter_critical, leave, warn, calm FROM presets) p ON p.pname = w.preset) q1) q2),
 states AS (SELECT fr.trip_id, walk.preset, fr.frame_id, fr.rn - 1 AS position, fr.ttc, fr.band AS raw_band, walk.state, walk.reason
  FROM walk JOIN fr ON fr.trip_id = walk.trip_id AND fr.rn = walk.rn)"""


def preset_rows(names):
    return "VALUES " + ", ".join(f"('{n}', {', '.join(map(str, RISK_PRESETS[n]))})" for n in names)


STREAM_FSM = fsm_sql("stream_frames", preset_rows(["recommended"]))
UNION_SRC = f"(SELECT trip_id, frame_id, predicted_ttc AS ttc, true AS reliable FROM {Q.UNION})"
UNION_FSM = fsm_sql(UNION_SRC, preset_rows(list(RISK_PRESETS)))
EVENTS = """spans AS (SELECT trip_id, preset, min(position) AS start_pos, max(position) AS end_pos FROM (
   SELECT *, sum(CASE WHEN position - before <= gap + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY trip_id, preset ORDER BY position) AS island
   FROM (SELECT s.*, p.gap, lag(position) OVER (PARTITION BY s.trip_id, s.preset ORDER BY position) AS before
    FROM states s JOIN presets p ON p.preset = s.preset WHERE state = 'HIGH_RISK')) GROUP BY trip_id, preset, island),
 ev AS (SELECT sp.trip_id, sp.preset, sp.start_pos, sp.end_pos, min(frame_id) AS start_frame, max(frame_id) AS end_frame,
   coalesce(min(CASE WHEN isfinite(ttc) THEN ttc END), 3e0) AS least
  FROM spans sp JOIN states s ON s.trip_id = sp.trip_id AND s.preset = sp.preset AND s.position BETWEEN sp.start_pos AND sp.end_pos
  GROUP BY sp.trip_id, sp.preset, sp.start_pos, sp.end_pos)"""


def stream_states(t):
    return R.risk_states(t.stream_frames, reliable="reliable")


@query("risk_states", f"""WITH {STREAM_FSM}
SELECT_FINAL * FROM states""", "ttc")
def _(t):
    return stream_states(t)


@query("event_to_ttc", f"""WITH {STREAM_FSM}
SELECT_FINAL trip_id, frame_id, state, CASE WHEN state = 'HIGH_RISK' THEN ttc ELSE greatest(ttc, 2) END AS event_ttc FROM states""", "event_ttc")
def _(t):
    return R.event_to_ttc(stream_states(t)).select("trip_id", "frame_id", "state", "event_ttc")


@query("risk_level", f"""WITH {STREAM_FSM}
SELECT_FINAL trip_id, frame_id, CASE state WHEN 'UNKNOWN' THEN 'UNKNOWN' WHEN 'HIGH_RISK' THEN
 CASE WHEN raw_band IN ('DANGER', 'CRITICAL') THEN raw_band ELSE 'DANGER' END WHEN 'ATTENTIVE' THEN 'WARNING' ELSE 'SAFE' END AS level
FROM states""")
def _(t):
    return stream_states(t).select("trip_id", "frame_id", X.risk_level("state", "raw_band").alias("level"))


EVENT_FIELDS = """trip_id, preset, row_number() OVER (PARTITION BY trip_id, preset ORDER BY start_pos) AS event_no,
 start_frame, end_frame, start_pos, end_pos, greatest(0, least) AS min_ttc_sec,
 CASE WHEN least < 15e-1 THEN 'CRITICAL' ELSE 'DANGER' END AS severity,
 least(1, (end_pos - start_pos + 1) / 7) AS event_quality,
 CASE WHEN end_pos - start_pos + 1 >= 7 THEN 'HIGH' WHEN end_pos - start_pos + 1 >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level"""


@query("risk_events", f"""WITH {STREAM_FSM}, {EVENTS}
SELECT_FINAL {EVENT_FIELDS} FROM ev""", "min_ttc_sec event_quality")
def _(t):
    return E.risk_events(cut(stream_states(t)))


def union_states(t):
    return cut(R.risk_states(union_predictions(t), list(RISK_PRESETS), ttc="predicted_ttc"))


TRUE_RUNS = f"""truth AS (SELECT trip_id, frame_id, min_ttc AS truth_ttc FROM frames),
 tr AS (SELECT trip_id, run_start AS start_pos, run_end AS end_pos FROM ({runs_sql('truth', 'truth_ttc < 2', 2)})),
 pairs AS (SELECT ev.trip_id, ev.preset, tr.start_pos AS t0, ev.start_pos AS p0 FROM tr JOIN ev ON ev.trip_id = tr.trip_id
   AND tr.start_pos <= ev.end_pos AND ev.start_pos <= tr.end_pos)"""


@query("event_overlap", f"""WITH {UNION_FSM}, {EVENTS}, {TRUE_RUNS}
SELECT_FINAL p.preset, tr.trip_id, 'truth' AS kind, start_pos, end_pos, count(p0) AS overlaps,
  CASE WHEN count(p0) > 0 THEN greatest(0, min(p0) - start_pos) END AS onset_delay, greatest(0, count(p0) - 1) AS fragments
 FROM tr JOIN (SELECT preset FROM presets) p ON true LEFT JOIN pairs ON pairs.trip_id = tr.trip_id AND pairs.t0 = start_pos AND pairs.preset = p.preset
 GROUP BY p.preset, tr.trip_id, start_pos, end_pos
UNION ALL SELECT ev.preset, ev.trip_id, 'predicted', start_pos, end_pos, count(t0), NULL, 0
 FROM ev LEFT JOIN pairs ON pairs.trip_id = ev.trip_id AND pairs.preset = ev.preset AND pairs.p0 = start_pos
 GROUP BY ev.preset, ev.trip_id, start_pos, end_pos""")
def _(t):
    tr = E.runs(truth(t), X.is_danger("truth_ttc"), 2).select(
        "trip_id", F.col("run_start").alias("start_pos"), F.col("run_end").alias("end_pos"))
    s = union_states(t)
    return E.event_overlap(s.select("trip_id", "preset").distinct().join(tr, "trip_id"), E.risk_events(s),
                           ("trip_id", "preset"))


METRICS_SQL = f"""WITH {UNION_FSM}, {EVENTS}, {TRUE_RUNS},
 t_side AS (SELECT p.preset, tr.trip_id, start_pos, count(p0) AS n, greatest(0, min(p0) - start_pos) AS delay
  FROM tr JOIN (SELECT preset FROM presets) p ON true LEFT JOIN pairs ON pairs.trip_id = tr.trip_id AND pairs.t0 = start_pos AND pairs.preset = p.preset
  GROUP BY p.preset, tr.trip_id, start_pos),
 p_side AS (SELECT ev.preset, ev.trip_id, start_pos, count(t0) AS n FROM ev LEFT JOIN pairs ON pairs.trip_id = ev.trip_id
  AND pairs.preset = ev.preset AND pairs.p0 = start_pos GROUP BY ev.preset, ev.trip_id, start_pos),
 tc AS (SELECT preset, trip_id, count(*) AS truth_events, count(*) FILTER (WHERE n > 0) AS event_tp,
   CAST(sum(greatest(0, n - 1)) AS BIGINT) AS fragmentation, avg(CASE WHEN n > 0 THEN delay END) AS delay FROM t_side GROUP BY preset, trip_id),
 pc AS (SELECT preset, trip_id, count(*) AS predicted_events, count(*) FILTER (WHERE n > 0) AS hit FROM p_side GROUP BY preset, trip_id),
 al AS ({Q.score("(SELECT s.trip_id, s.preset, CASE WHEN state = 'HIGH_RISK' THEN 1e0 ELSE CAST('inf' AS DOUBLE) END AS predicted_ttc, truth_ttc FROM states s JOIN truth ON truth.trip_id = s.trip_id AND truth.frame_id = s.frame_id)", "trip_id, preset")}),
 m AS (SELECT al.trip_id, al.preset, coalesce(truth_events, 0) AS truth_events, coalesce(predicted_events, 0) AS predicted_events,
  coalesce(event_tp, 0) AS event_tp, coalesce(predicted_events, 0) - coalesce(hit, 0) AS event_fp, coalesce(truth_events, 0) - coalesce(event_tp, 0) AS event_fn,
  CASE WHEN truth_events > 0 THEN event_tp / truth_events ELSE 1 END AS event_recall,
  CASE WHEN predicted_events > 0 THEN hit / predicted_events WHEN truth_events > 0 THEN 0 ELSE 1 END AS event_precision,
  coalesce(fragmentation, 0) AS fragmentation, coalesce(delay, 0) AS mean_onset_delay_frames, fp AS false_high_frames,
  fp * 5e-2 AS false_event_duration_sec, tp + fp AS high_risk_frames, f1 AS alert_f1, "precision" AS alert_precision, recall AS alert_recall
  FROM al LEFT JOIN tc ON tc.trip_id = al.trip_id AND tc.preset = al.preset LEFT JOIN pc ON pc.trip_id = al.trip_id AND pc.preset = al.preset)"""


@query("event_metrics", METRICS_SQL + "\nSELECT_FINAL * FROM m",
       "event_recall event_precision mean_onset_delay_frames false_event_duration_sec alert_f1 alert_precision alert_recall")
def _(t):
    return E.event_metrics(union_states(t), truth(t))


@query("hysteresis_compare", METRICS_SQL + """
SELECT_FINAL preset, avg(event_recall) AS macro_event_recall, avg(event_precision) AS macro_event_precision, avg(alert_f1) AS macro_alert_f1,
 sum(false_event_duration_sec) AS total_false_event_duration_sec, CAST(sum(predicted_events) AS BIGINT) AS total_predicted_events,
 CAST(sum(fragmentation) AS BIGINT) AS total_fragmentation FROM m GROUP BY preset""",
       "macro_event_recall macro_event_precision macro_alert_f1 total_false_event_duration_sec")
def _(t):
    return E.hysteresis_compare(E.event_metrics(union_states(t), truth(t)))
