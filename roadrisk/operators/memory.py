"""What a track remembers: its last observations, filtered motion, semantic support, and where it is
expected while it is not seen.

The tracker (``tracking.track_components``) decides which component continues which track; all else
follows from a track's observations and is computed by windows, scans and one grouped step, without
state that runs through a trip.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadrisk.constants import IMAGE_HEIGHT, IMAGE_WIDTH, INF, MIN_CLOSING_MPS
from roadrisk.functions import geometry as G
from roadrisk.functions.ttc import is_finite
from roadrisk.operators.fusion import semantic_state
from roadrisk.operators.motion import FILTER_ROWS, FILTERED, filter_rows, filter_segments, filtered_values, line_of
from roadrisk.operators.sequence import SEG, by_track, last_rows, seg_window

MEMORY = 11      # fixed value: observations a track remembers
PREDICTED = 2    # fixed value: frames for which an unseen track is predicted, at most
FADING = 0.82    # fixed value: confidence kept per frame not seen
_TRACK = ["trip_id", "track_id"]


def _mean(name: str, field: str) -> Column:
    return F.aggregate(name, F.lit(0.0), lambda a, q: a + q[field]) / F.size(name)


def confidence_of(closing, residual, history, quality, depth_m, ground_confidence) -> Column:
    """Weighted history, mean quality, calm of the fit, ground and motion of a track."""
    closing, residual = F.col(closing), F.col(residual)
    calm = F.when(is_finite(residual), F.exp(-residual / F.greatest(F.lit(0.5), F.col(depth_m) * 0.10))).otherwise(0.0)
    return (0.25 * F.least(F.lit(1.0), F.col(history) / 7.0) + 0.30 * F.col(quality) + 0.20 * calm
            + 0.15 * F.lit(ground_confidence) + 0.10 * F.when(closing > MIN_CLOSING_MPS, 1.0).otherwise(0.5))


def _observed(tracked: DataFrame) -> DataFrame:
    """Tracked rows with position, own noise and times as doubles."""
    x = (F.col("box")["x0"] + F.col("box")["x1"]) / 2.0
    return tracked.withColumns({
        "center_x": x, "t_sec": F.col("t_sec").cast("double"), "depth_m": F.col("depth_m").cast("double"),
        "depth_sigma_m": G.depth_sigma("depth_mad_m", "lr_support", "depth_confidence")})


def robust(tracked: DataFrame, only: DataFrame | Column | None = None) -> DataFrame:
    """``remembered`` without the filtered motion and the confidence, and with ``next_frame_id``, the
    frame of the track's next observation.

    With ``only`` (a condition, or trip_id, track_id, frame_id, once each) the rows named there: all observations
    are looked back at, but windows leave their task, and lines are fitted, for the named rows alone.
    All columns of ``tracked`` move once: pass those that are needed.
    """
    if isinstance(only, Column):
        tracked = tracked.withColumn("_only", only)
    elif only is not None:
        tracked = tracked.join(only.select(*_TRACK, "frame_id", F.lit(True).alias("_only")), [*_TRACK, "frame_id"], "left")
    r = _with_last(_observed(by_track(tracked, _TRACK))).drop(SEG)
    return _fitted(r if only is None else r.filter("_only").drop("_only"))


def _with_last(o: DataFrame) -> DataFrame:
    """Rows of ``by_track`` with their last observations, hits and the frame of the next one."""
    fields = {"t": "t_sec", "v": "depth_m", "x": "center_x", "s": "depth_sigma_m", "q": "quality", "c": "depth_confidence"}
    r = last_rows(o, _TRACK, MEMORY, fields, "observations", {"next_frame_id": "frame_id"}, keep_segment=True)
    return r.withColumn("hits", F.col("position") + 1).drop("position")


def _fitted(r: DataFrame) -> DataFrame:
    return _with_lines(_summed(r))


def _summed(r: DataFrame) -> DataFrame:
    """What is needed of the last observations, in less room than they take."""
    return r.withColumns({
        "history": F.size("observations"), "_times": F.transform("observations", lambda q: q["t"]), "_depths": F.transform("observations", lambda q: q["v"]),
        "mean_quality": _mean("observations", "q"), "mean_depth_confidence": _mean("observations", "c")})


def _with_lines(r: DataFrame) -> DataFrame:
    r = r.withColumn("_fit", line_of("_times", "_depths")).drop("_times", "_depths")
    known = (F.col("history") >= 3) & F.col("_fit.slope").isNotNull()
    closing = F.when(known, -F.col("_fit.slope")).otherwise(0.0)
    return r.withColumns({
        "closing_mps": closing, "ttc": F.when(closing > MIN_CLOSING_MPS, F.col("depth_m") / closing).otherwise(F.lit(INF)),
        "residual_m": F.when(known, F.col("_fit.residual")).otherwise(F.lit(INF))}).drop("_fit")


def _with_filter(r: DataFrame, o: DataFrame, ground_confidence: float, robustly) -> DataFrame:
    """``r`` (rows of ``o`` with their place ``_nth`` in their segment) with the filtered motion, and the
    robust one by ``robustly``. ``o``: of ``by_track``. Each row takes its state from the list of its segment."""
    k = filter_segments(filter_rows(o.withColumn("sigma_m", F.col("depth_sigma_m")), _TRACK), _TRACK).drop("_rows")
    j = r.join(k, [*_TRACK, SEG]).withColumns({c: F.col(c)[F.col("_nth") - 1] for c in FILTERED})
    j = robustly(filtered_values(j, "filter_").drop(*FILTERED, "_nth", SEG))
    return j.withColumn("confidence", confidence_of("closing_mps", "residual_m", "history", "mean_quality", "depth_m", ground_confidence))


def _dealt(tracked: DataFrame) -> DataFrame:
    """Rows by track in the segments of the filter, numbered in each."""
    o = _observed(by_track(tracked, _TRACK, rows=FILTER_ROWS))
    return o.withColumn("_nth", F.row_number().over(seg_window(_TRACK, ["frame_id", "ordinal"])))


def remembered(tracked: DataFrame, ground_confidence: float = 1.0) -> DataFrame:
    """Each observation of a track with what the track knows then.

    tracked: trip_id, track_id, frame_id, ordinal, t_sec, box, depth_m, quality, depth_mad_m, lr_support,
    corridor_overlap, depth_confidence; one row per track and frame, other columns stay. Adds
    depth_sigma_m, hits, ``observations`` (the last 11), history, mean_quality, mean_depth_confidence,
    the robust motion (closing_mps, ttc, residual_m), the filtered one (filter_distance_m,
    filter_closing_mps, filter_ttc, filter_residual_m), and confidence. Motion needs three observations.
    """
    o = _dealt(tracked)
    return _with_filter(_with_last(o), o, ground_confidence, _fitted).drop("next_frame_id")


def track_memory(tracked: DataFrame, frames: DataFrame, ground_confidence: float = 1.0, max_missed: int = 3,
                 include_predicted: bool = True, with_semantics: bool = False) -> DataFrame:
    """``remembered`` for every frame in which a track is alive: seen (missed 0), or, with
    ``include_predicted``, not seen for up to two frames since.

    frames: trip_id, frame_id, t_sec of all frames. An unseen track keeps its last observation; its
    filtered distance moves on with the time, the filtered residual grows and the filtered confidence
    fades with each frame missed. With ``with_semantics`` (tracked then has matched and
    det_confidence) the semantic score and misses run on through the frames until the track
    ends, ``max_missed`` frames after its last observation, an unseen frame being a miss.
    """
    # the frames that an observation can reach, listed at its own frame: rows are moved before they are
    # multiplied; an observation lasts until the next one of its track, and its rows stay in its segment
    reach = frames.select("trip_id", F.col("t_sec").cast("double").alias("_now"), "frame_id", F.explode(F.sequence(F.lit(0), F.lit(max_missed))).alias("missed"))
    reach = reach.groupBy("trip_id", (F.col("frame_id") - F.col("missed")).alias("frame_id")).agg(F.collect_list(F.struct("missed", "_now")).alias("_reach"))
    o = _dealt(tracked.join(reach, ["trip_id", "frame_id"], "left"))
    lasts = F.filter("_reach", lambda x: F.col("next_frame_id").isNull() | (F.col("frame_id") + x["missed"] < F.col("next_frame_id")))
    # what is sorted later need not hold the last observations; lines are fitted at the end, because Spark
    # forgets where rows lie when they pass through Python
    m = _summed(_with_last(o)).withColumn("_m", F.explode(lasts)).drop("_reach", "next_frame_id")
    m = m.withColumns({"missed": F.col("_m.missed"), "_now": F.col("_m._now"), "frame_id": F.col("frame_id") + F.col("_m.missed")}).drop("_m")
    if with_semantics:
        m = semantic_state(m.withColumn("matched", F.col("matched") & (F.col("missed") == 0)))
    # after the state has run on: rows that are not returned need no motion
    m = m.filter(F.col("missed") <= (min(PREDICTED, max_missed) if include_predicted else 0))
    m = _with_filter(m, o, ground_confidence, _with_lines)
    passed = F.greatest(F.lit(0.0), F.col("_now") - F.col("t_sec"))
    filtered = is_finite("filter_residual_m")
    distance = F.col("filter_distance_m") - passed * F.when(filtered, F.col("filter_closing_mps")).otherwise(0.0)
    m = m.withColumns({
        "filter_distance_m": distance, "filter_residual_m": F.col("filter_residual_m") + 0.20 * F.col("missed"),
        "filter_ttc": F.when(filtered & (distance > 0) & (F.col("filter_closing_mps") > MIN_CLOSING_MPS), distance / F.col("filter_closing_mps")).otherwise(F.lit(INF))})
    base = confidence_of("filter_closing_mps", "filter_residual_m", "history", "mean_quality", "depth_m", ground_confidence)
    m = m.withColumns({
        "filter_confidence": (0.80 * base + 0.20 * F.col("mean_depth_confidence")) * F.pow(F.lit(FADING), F.col("missed")),
        "confirmed": (F.col("hits") >= 3) & (F.col("history") >= 3)}).drop("_now")
    return m


def risk_tracks(tracks: DataFrame, min_bottom=0.0, min_height=0.0, top_width=0.16, bottom_width=0.55) -> DataFrame:
    """Confirmed tracks that stand low and large enough in the own corridor.

    tracks: confirmed, center_x and bottom_y and height as shares of the image.
    """
    inside = G.corridor_member("center_x", "bottom_y", F.lit(top_width), F.lit(bottom_width))
    return tracks.filter(F.col("confirmed") & (F.col("bottom_y") >= min_bottom) & (F.col("height") >= min_height) & inside)


def latest_observation(obs: DataFrame, cols, keys=("trip_id", "track_id")) -> DataFrame:
    """The last row of each track by (frame_id, ordinal)."""
    keys = list(keys)
    last = F.max(F.struct("frame_id", "ordinal", *cols))
    return obs.groupBy(*keys).agg(last.alias("_o")).select(*keys, "_o.frame_id", *[f"_o.{c}" for c in cols])


_NORMS = ("center_x_norm", "bottom_y_norm", "width_norm", "height_norm")


def track_diagnostics(known: DataFrame) -> DataFrame:
    """Normalised geometry, history and evidence of a track at each of its rows (of ``remembered``)."""
    b = F.col("box")
    mad = F.col("depth_mad_m")
    ratio = F.when(is_finite(mad) & (F.col("depth_m") > 0), mad / F.col("depth_m"))
    return known.select(
        *_TRACK, "frame_id", ((b["x0"] + b["x1"]) / 2 / IMAGE_WIDTH).alias("center_x_norm"), (b["y1"] / IMAGE_HEIGHT).alias("bottom_y_norm"),
        ((b["x1"] - b["x0"]) / IMAGE_WIDTH).alias("width_norm"), ((b["y1"] - b["y0"]) / IMAGE_HEIGHT).alias("height_norm"),
        "hits", "history", "residual_m", "quality", "depth_mad_m", ratio.alias("depth_mad_ratio"), "lr_support", "corridor_overlap")


def _of_selected(known: DataFrame, selected: DataFrame | None) -> DataFrame:
    return known if selected is None else selected.select(*_TRACK, "frame_id").join(known, [*_TRACK, "frame_id"])


def selected_diagnostics(frames: DataFrame, selected: DataFrame | None, known: DataFrame) -> DataFrame:
    """Every frame with the diagnostics of its selected track (trip_id, frame_id, track_id), prefixed
    ``selected_``; without one counts are 0 and the rest NULL. ``selected`` None: ``known`` has the
    selected rows alone."""
    d = track_diagnostics(_of_selected(known, selected))
    names = [c for c in d.columns if c not in ("trip_id", "frame_id")]
    d = d.withColumnsRenamed({c: f"selected_{c}" for c in names})
    return frames.join(d, ["trip_id", "frame_id"], "left").na.fill(0, ["selected_hits", "selected_history"])


def selected_evidence(frames: DataFrame, selected: DataFrame | None, known: DataFrame) -> DataFrame:
    """Every frame with its selected track's measurement and remembered observations. ``selected``
    None: ``known`` has the selected rows alone.

    Without a selected track the history is 0, the observations are an empty JSON list and all
    else is NULL. Times and depths in the JSON have six decimals, positions three.
    """
    item = F.transform("observations", lambda q: F.struct(
        F.round(q["t"], 6).alias("timestamp"), F.round(q["v"], 6).alias("depth_m"), F.round(q["x"], 3).alias("center_x"), F.round(q["s"], 6).alias("depth_sigma_m")))
    b = F.col("box")
    box = F.to_json(F.array(*[b[c].cast("int") for c in ("x0", "y0", "x1", "y1")]))
    e = _of_selected(known, selected).select(
        "trip_id", "frame_id", F.col("track_id").alias("selected_track_id"), F.col("depth_m").alias("selected_depth_m"),
        F.col("residual_m").alias("selected_motion_residual_m"), F.col("quality").alias("selected_observation_quality"),
        F.col("depth_confidence").alias("selected_depth_confidence"), F.col("lr_support").alias("selected_lr_support"),
        F.col("history").alias("selected_history_length"), box.alias("selected_bbox_xyxy"), F.to_json(item).alias("selected_observations_json"))
    return frames.join(e, ["trip_id", "frame_id"], "left").na.fill(0, ["selected_history_length"]).na.fill("[]", ["selected_observations_json"])
