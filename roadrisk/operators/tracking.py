"""Track building and track filters with state that runs through the frames of a trip.

State cannot be merged from the middle, but it starts empty after every break (a gap that ends
all tracks, or a filter restart). Rows are spread over tasks by (trip, stretch between breaks) and stream
through each task in order; only the live state is held, never a whole trip.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadrisk.constants import IMAGE_HEIGHT, IMAGE_WIDTH, INF
from roadrisk.functions import geometry as G
from roadrisk.operators.association import KEYS
from roadrisk.operators.lineage import cut, spread
from roadrisk.operators.scoring import select_min_ttc
from roadrisk.operators.sequence import SEG, by_track, last_rows, run_starts, running_max, running_total


def _by_frame(batches, keys):
    """Rows of one frame at a time as (key, frame, list of dicts), across batch borders."""
    at, rows = None, []
    for pdf in batches:
        for r in pdf.to_dict("records"):
            now = (*[r[k] for k in keys], r["frame_id"])
            if now != at and rows:
                yield at[:-1], at[-1], rows
                rows = []
            at = now
            rows.append(r)
    if rows:
        yield at[:-1], at[-1], rows


def _gathered(batches, rows: int):
    """The rows of several batches as one frame of at least ``rows`` rows; the last may have fewer."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _costs(tracks, comps):
    """Cost matrix of tracks against components, infinite outside the gates."""
    a = np.array([(*t["box"], t["cx"], t["cy"], t["depth"]) for t in tracks], float)[:, None, :]
    b = np.array([(c["x0"], c["y0"], c["x1"], c["y1"], c["cx"], c["cy"], c["depth_m"]) for c in comps], float)[None, :, :]
    return _pair_costs(a, b)


def _pair_costs(a, b):
    w = np.clip(np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]), 0, None)
    h = np.clip(np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]), 0, None)
    area = lambda m: np.clip(m[..., 2] - m[..., 0], 0, None) * np.clip(m[..., 3] - m[..., 1], 0, None)
    iou = w * h / np.maximum(1.0, area(a) + area(b) - w * h)
    shift = np.hypot(a[..., 4] - b[..., 4], a[..., 5] - b[..., 5]) / math.hypot(IMAGE_WIDTH, IMAGE_HEIGHT)
    far = np.abs(a[..., 6] - b[..., 6]) / np.maximum(1.0, np.maximum(a[..., 6], b[..., 6]))
    cost = 0.45 * (1 - iou) + 0.35 * np.minimum(1, shift / 0.12) + 0.20 * np.minimum(1, far / 0.65)
    return np.where(((iou < 0.02) & (shift > 0.12)) | (far > 0.65), np.inf, cost)


def frame_tracks(tracks, made, comps, skipped, max_missed):
    """One frame: (live tracks, tracks made so far, components in order, frames without components
    before) -> (live tracks, tracks made, [(component, track number, hits)]). Cheapest pairs first, ties
    by track and component; new tracks for the rest."""
    for t in tracks:
        t["missed"] += skipped
    tracks = [t for t in tracks if t["missed"] <= max_missed]
    owner = [None] * len(comps)
    if tracks:
        cost = _costs(tracks, comps)
        used = set()
        i, j = np.nonzero(np.isfinite(cost))
        number = np.array([t["id"] for t in tracks])
        for k in np.lexsort((j, number[i], cost[i, j])):
            if i[k] not in used and owner[j[k]] is None:
                used.add(i[k])
                owner[j[k]] = tracks[i[k]]
    for t in tracks:
        t["missed"] += 1
    found = []
    for n, comp in enumerate(comps):
        if owner[n] is None:
            made += 1
            owner[n] = {"id": made, "hits": 0}
            tracks.append(owner[n])
        owner[n].update(box=(comp["x0"], comp["y0"], comp["x1"], comp["y1"]), cx=comp["cx"], cy=comp["cy"],
                        depth=comp["depth_m"], hits=owner[n]["hits"] + 1, missed=0)
        found.append((comp, owner[n]["id"], owner[n]["hits"]))
    return [t for t in tracks if t["missed"] <= max_missed], made, found


# frames of a segment, and of the run before it from which its first tracks are taken; stretches whose
# segments do not fit are walked again with the next, at last whole
TRACK_SEGMENTS = ((256, 64), (8192, 2048))
_LANE_ROWS = 1 << 18  #: rows of segments that are walked side by side
_PLACE = ["x0", "y0", "x1", "y1", "cx", "cy", "depth_m"]
_LANE = ["trip_id", "stretch", "segment"]
LANES = ("trip_id string, stretch bigint, segment bigint, frame_id array<bigint>, ordinal array<bigint>, number array<bigint>, "
         "hits array<bigint>, first array<struct<frame_id: bigint, ordinal: bigint, number: bigint, hits: bigint>>, "
         "last array<struct<frame_id: bigint, ordinal: bigint, number: bigint, hits: bigint>>, made_before bigint, made bigint, tied boolean")


def walk_lanes(lane, frame, place, begin, max_missed):
    """``frame_tracks`` over many lanes side by side: one step takes the next frame of each.

    lane, frame, place: rows by lane, frame and component; begin: the first own frame of each lane.
    Returns track numbers and hits by row, and for each lane (tracks before its first own frame, tracks at
    the end, tracks made before, tracks made, whether two pairs cost the same); a track is (row, number, hits).
    """
    n, lanes = len(lane), len(begin)
    out_number, out_hits = np.zeros(n, np.int64), np.zeros(n, np.int64)
    head = np.flatnonzero(np.r_[True, (lane[1:] != lane[:-1]) | (frame[1:] != frame[:-1])])
    size, at_frame = np.diff(np.append(head, n)), frame[head]
    first = np.searchsorted(lane[head], np.arange(lanes + 1))
    steps = np.diff(first)
    order = np.argsort(-steps, kind="stable")  # the active lanes stay in front
    done = [[[], [], None, 0, False] for _ in range(lanes)]
    t = {"place": np.zeros((lanes, 0, 7)), **{k: np.zeros((lanes, 0), np.int64) for k in ("missed", "number", "hits", "row")}}
    made, seen, tied = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, bool)

    def tracks(i):
        live = t["number"][i] > 0
        return list(zip(*(t[k][i][live].tolist() for k in ("row", "number", "hits"))))

    for step in range(steps.max(initial=0)):
        active = int((steps > step).sum())
        t, made, seen, tied = {k: v[:active] for k, v in t.items()}, made[:active], seen[:active], tied[:active]
        g = first[order[:active]] + step
        now = at_frame[g]
        for i in np.flatnonzero(now >= begin[order[:active]]):
            if done[order[i]][2] is None:
                done[order[i]][0], done[order[i]][2] = tracks(i), int(made[i])
        t["missed"] = t["missed"] + (now - (seen if step else now - 1) - 1)[:, None]
        live = (t["number"] > 0) & (t["missed"] <= max_missed)
        there = np.arange(size[g].max()) < size[g][:, None]
        row = np.where(there, head[g][:, None] + np.arange(there.shape[1]), 0)
        comp = place[row]
        owner = np.full(there.shape, -1)
        if live.any():
            cost = _pair_costs(t["place"][:, :, None, :], comp[:, None, :, :])
            cost[~(live[:, :, None] & there[:, None, :] & np.isfinite(cost))] = np.inf
            flat = cost.reshape(active, -1)
            for _ in range(min(live.shape[1], there.shape[1])):
                k = flat.argmin(axis=1)  # of equal costs the lowest track, then the lowest component
                best = flat[np.arange(active), k]
                go = np.flatnonzero(np.isfinite(best))
                if not len(go):
                    break
                tied[go] |= (flat[go] == best[go, None]).sum(axis=1) > 1
                i, j = np.divmod(k[go], there.shape[1])
                owner[go, j] = i
                cost[go, i, :] = np.inf
                cost[go, :, j] = np.inf
        t["missed"] = t["missed"] + 1
        l, j = np.nonzero(owner >= 0)
        i, r = owner[l, j], row[l, j]
        t["place"][l, i], t["missed"][l, i], t["row"][l, i] = comp[l, j], 0, r
        t["hits"][l, i] += 1
        out_number[r], out_hits[r] = t["number"][l, i], t["hits"][l, i]
        # live tracks to the front, in the order in which they were made, and the new ones behind
        live &= t["missed"] <= max_missed
        fresh = there & (owner < 0)
        kept = live.sum(axis=1)
        width = int((kept + fresh.sum(axis=1)).max())
        front = np.argsort(~live, axis=1, kind="stable")
        grown = {}
        for k, v in t.items():
            v = np.take_along_axis(v, front[:, :, None] if v.ndim == 3 else front, axis=1)[:, :width]
            grown[k] = np.concatenate([v, np.zeros((active, width - v.shape[1], *v.shape[2:]), v.dtype)], axis=1)
        t = grown
        t["number"][np.arange(width) >= kept[:, None]] = 0
        l, j = np.nonzero(fresh)
        nth, r = np.cumsum(fresh, axis=1)[l, j], row[l, j]
        i = kept[l] + nth - 1
        t["place"][l, i], t["missed"][l, i], t["number"][l, i], t["hits"][l, i], t["row"][l, i] = comp[l, j], 0, made[l] + nth, 1, r
        out_number[r], out_hits[r] = made[l] + nth, 1
        made, seen = made + fresh.sum(axis=1), now
        for i in np.flatnonzero(steps[order[:active]] == step + 1):
            done[order[i]][1], done[order[i]][3], done[order[i]][4] = tracks(i), int(made[i]), bool(tied[i])
    return out_number, out_hits, done


def _whole_lanes(batches):
    """Rows of whole lanes, about ``_LANE_ROWS`` at once."""
    rest = None
    for pdf in _gathered(batches, _LANE_ROWS):
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        whole = (pdf[_LANE] != pdf[_LANE].iloc[-1]).any(axis=1)
        if whole.any():
            yield pdf[whole].reset_index(drop=True)
        rest = pdf[~whole]
    if rest is not None:
        yield rest.reset_index(drop=True)


def _walked(c: DataFrame, frames: int | None, before: int, max_missed) -> DataFrame:
    """One row for each segment of ``frames`` frames (None: for each stretch) with its tracks."""
    if frames:
        here = F.floor(F.col("frame_id") / frames)
        nearby = F.when(F.col("frame_id") >= (here + 1) * frames - before, F.array(here, here + 1)).otherwise(F.array(here))
        c = c.withColumn("segment", F.explode(nearby))
    else:
        c = c.withColumn("segment", F.lit(0).cast("long"))
    c = spread(c, *_LANE).sortWithinPartitions(*_LANE, "frame_id", "ordinal")

    def run(batches):
        for pdf in _whole_lanes(batches):
            lane = (pdf[_LANE] != pdf[_LANE].shift()).any(axis=1).cumsum().to_numpy() - 1
            head = np.flatnonzero(np.diff(lane, prepend=-1))
            names = pdf[_LANE].iloc[head]
            frame, ordinal = pdf["frame_id"].to_numpy(), pdf["ordinal"].to_numpy()
            begin = names["segment"].to_numpy() * frames if frames else frame[head]
            number, hits, done = walk_lanes(lane, frame, pdf[_PLACE].to_numpy(float), begin, max_missed)
            out = []
            for (trip, stretch, segment), a, b, b0, (old, last, made0, made, tied) in zip(
                    names.itertuples(index=False, name=None), head, np.append(head[1:], len(lane)), begin, done):
                if made0 is None:
                    continue  # no frame of its own
                x = slice(a + int(np.searchsorted(frame[a:b], b0)), b)
                first, last = ([(int(frame[r]), int(ordinal[r]), k, h) for r, k, h in v] for v in (old, last))
                out.append((trip, stretch, segment, frame[x], ordinal[x], number[x], hits[x], first, last, made0, made, tied))
            yield pd.DataFrame(out, columns=[*_LANE, "frame_id", "ordinal", "number", "hits", "first", "last", "made_before", "made", "tied"])

    return c.mapInPandas(run, LANES)


def _chained(pdf: pd.DataFrame) -> pd.DataFrame:
    """For the segments of a trip: the number of tracks before, and numbers and hits of the tracks that
    go on. A segment fits if it began with the tracks that the one before it left."""
    out, made, at, left, local = [], 0, None, {}, []
    for r in pdf.sort_values(["stretch", "segment"]).itertuples(index=False):
        if r.stretch != at:
            at, left, local = r.stretch, {}, []
        first = [(x["frame_id"], x["ordinal"]) for x in r.first]
        fits = first == local if r.tied else sorted(first) == sorted(local)
        numbers, hits = {}, {}
        if fits:
            for k, x in zip(first, r.first):
                numbers[x["number"]], had = left[k]
                hits[x["number"]] = had - x["hits"]
        out.append((r.trip_id, r.stretch, r.segment, made, numbers, hits, fits))
        left = {(x["frame_id"], x["ordinal"]): (
            numbers.get(x["number"], made + x["number"] - r.made_before), x["hits"] + hits.get(x["number"], 0)) for x in r.last}
        local = sorted(left, key=lambda k: left[k][0])
        made += r.made - r.made_before
    return pd.DataFrame(out, columns=[*_LANE, "above", "numbers", "more", "fits"])


def track_components(components: DataFrame, max_missed=3) -> DataFrame:
    """Give each component a track: cheapest pairs first, new tracks for the rest.

    components: KEYS, ordinal, box, depth_m. A track ends after more than ``max_missed`` frames
    without a match, so a gap that long separates independent stretches; track numbers
    rise over the trip. Adds track_id, hits.

    Stretches are cut into segments that are walked side by side, each from some frames before it on.
    A segment stands if it began with the very tracks that the one before it ended with (and in
    their order, where two pairs cost the same); stretches with one that does not are walked again.
    """
    c = components.select(
        *KEYS, "ordinal", F.col("depth_m").cast("double").alias("depth_m"), "box.*",
        *[x.alias(n) for x, n in zip(G.centre("box"), ("cx", "cy"))])
    stretch = run_starts(c.select(*KEYS).distinct(), ["trip_id"], "frame_id", max_missed, "stretch")
    c = c.join(stretch, KEYS)
    state = ["first", "last", "made_before", "made", "tied"]
    chain = "trip_id string, stretch bigint, segment bigint, above bigint, numbers map<bigint,bigint>, more map<bigint,bigint>, fits boolean"

    def chained(lanes):
        return cut(lanes.select(*_LANE, *state).groupBy("trip_id").applyInPandas(_chained, chain))

    lanes = None
    for frames, before in (*((f, b) for f, b in TRACK_SEGMENTS if b > 4 * max_missed), (None, 0)):
        walked = cut(_walked(c, frames, before, max_missed))
        lanes = walked if lanes is None else lanes.unionByName(walked)
        links = chained(lanes)
        again = links.filter("not fits").select("trip_id", "stretch").distinct()
        if again.isEmpty():
            break
        lanes = lanes.join(again, ["trip_id", "stretch"], "left_anti")
        c = c.join(again, ["trip_id", "stretch"], "left_semi")
    row = lanes.select(*_LANE, "made_before", F.explode(F.arrays_zip("frame_id", "ordinal", "number", "hits")).alias("r"))
    row = row.select(*_LANE, "made_before", "r.*").join(links, _LANE)
    old = F.col("number") <= F.col("made_before")
    return row.select(
        *KEYS, "ordinal", F.when(old, F.col("numbers")[F.col("number")]).otherwise(F.col("above") + F.col("number") - F.col("made_before")).alias("track_id"),
        F.when(old, F.col("hits") + F.col("more")[F.col("number")]).otherwise(F.col("hits")).alias("hits"))


# fixed values of the planar filter: acceleration noise, start variance of speeds, chi-square gate
_ACCEL, _SPEED_VAR, _GATE = (3.0, 2.0), 25.0, 9.21


def planar_step(state, t, z, speed, yaw, sigmas, gate=_GATE):
    """One update of (t, x, P) with x = forward, lateral and their speeds -> (state, accepted, d2)."""
    z, r = np.asarray(z, float), np.diag(np.square(sigmas))
    if state is None or not 0.0 < t - state[0] <= 0.5:
        return (t, np.array([*z, 0.0, 0.0]), np.diag([r[0, 0], r[1, 1], _SPEED_VAR, _SPEED_VAR])), True, 0.0
    t0, x, p = state
    dt = t - t0
    f = np.eye(4)
    f[0, 2] = f[1, 3] = dt
    g = np.array([[0.5 * dt * dt, 0], [0, 0.5 * dt * dt], [dt, 0], [0, dt]])
    x, p = f @ x, f @ p @ f.T + g @ np.diag(np.square(_ACCEL)) @ g.T
    v = max(0.0, speed)
    bent = yaw is not None and abs(yaw) >= 1e-4
    turn = yaw * dt if yaw is not None else 0.0
    moved = np.array([v / yaw * math.sin(turn), v / yaw * (1 - math.cos(turn))]) if bent else np.array([v * dt, 0.0])
    back = np.array([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]])
    big = np.kron(np.eye(2), back)
    pos = back @ (x[:2] - moved) if bent else x[:2] - moved
    x, p = np.concatenate([pos, back @ x[2:]]), big @ p @ big.T
    e, s = z - x[:2], p[:2, :2] + r
    d2 = float(e @ np.linalg.solve(s, e))
    if d2 <= gate:
        k = np.linalg.solve(s, p[:2, :]).T
        x, p = x + k @ e, p - k @ p[:2, :]
        p = 0.5 * (p + p.T)
    return (t, x, p), d2 <= gate, d2


PLANAR_FIELDS = ("accepted", "mahalanobis_squared", "forward_m", "lateral_m", "forward_mps", "lateral_mps", "horizon_s", "lateral_mean_m", "lateral_variance_m2")


def planar_row(x, p, accepted, d2):
    """PLANAR_FIELDS of a state: itself, and its lateral distribution at min(2 s, arrival)."""
    arrive = float(x[0] / -x[2]) if x[2] < -0.3 else INF
    row = np.array([0.0, 1.0, 0.0, min(2.0, arrive)])
    ahead = row[3] >= 0
    return (bool(accepted), float(d2), *map(float, x), arrive, float(row @ x) if ahead else None, float(row @ p @ row) if ahead else None)


def planar_steps(state, t, z, speed, yaw, sigmas, gate=_GATE):
    """``planar_step`` of many states at once: arrays with one entry a state. ``state`` is (t, x, P) or
    rows of NaN in t for none; a yaw of NaN is unknown."""
    t0, x, p = state
    dt = t - t0
    fresh = ~((dt > 0.0) & (dt <= 0.5))
    n = len(t)
    r = np.square(sigmas)
    dt = np.where(fresh, 0.0, dt)
    f = np.broadcast_to(np.eye(4), (n, 4, 4)).copy()
    f[:, 0, 2] = f[:, 1, 3] = dt
    g = np.zeros((n, 4, 2))
    g[:, 0, 0] = g[:, 1, 1] = 0.5 * dt * dt
    g[:, 2, 0] = g[:, 3, 1] = dt
    x = (f @ x[:, :, None])[:, :, 0]
    p = f @ p @ f.transpose(0, 2, 1) + (g * np.square(_ACCEL)) @ g.transpose(0, 2, 1)
    v = np.maximum(0.0, speed)
    known = ~np.isnan(yaw)
    bent = known & (np.abs(yaw) >= 1e-4)
    turn = np.where(known, yaw, 0.0) * dt
    per = np.where(bent, yaw, 1.0)
    cos, sin = np.cos(turn), np.sin(turn)
    px = x[:, 0] - np.where(bent, v / per * sin, v * dt)
    py = x[:, 1] - np.where(bent, v / per * (1 - cos), 0.0)
    big = np.zeros((n, 4, 4))
    big[:, 0, 0] = big[:, 1, 1] = big[:, 2, 2] = big[:, 3, 3] = cos
    big[:, 0, 1] = big[:, 2, 3] = sin
    big[:, 1, 0] = big[:, 3, 2] = -sin
    x = np.column_stack([np.where(bent, cos * px + sin * py, px), np.where(bent, cos * py - sin * px, py),
                         cos * x[:, 2] + sin * x[:, 3], cos * x[:, 3] - sin * x[:, 2]])
    p = big @ p @ big.transpose(0, 2, 1)
    e, s = z - x[:, :2], p[:, :2, :2].copy()
    s[:, 0, 0] += r[:, 0]
    s[:, 1, 1] += r[:, 1]
    s[fresh] = np.eye(2)  # not used
    d2 = np.einsum("ni,ni->n", e, np.linalg.solve(s, e[:, :, None])[:, :, 0])
    take = d2 <= gate
    k = np.linalg.solve(s, p[:, :2, :]).transpose(0, 2, 1)
    after = p - k @ p[:, :2, :]
    after = 0.5 * (after + after.transpose(0, 2, 1))
    x = np.where(take[:, None], x + (k @ e[:, :, None])[:, :, 0], x)
    p = np.where(take[:, None, None], after, p)
    x[fresh] = np.column_stack([z, np.zeros((n, 2))])[fresh]
    start = np.zeros((n, 4, 4))
    start[:, 0, 0], start[:, 1, 1] = r[:, 0], r[:, 1]
    start[:, 2, 2] = start[:, 3, 3] = _SPEED_VAR
    p[fresh] = start[fresh]
    return (t, x, p), take | fresh, np.where(fresh, 0.0, d2)


def planar_rows(x, p, accepted, d2) -> dict[str, np.ndarray]:
    """``planar_row`` of many states; NaN where there is no lateral distribution."""
    with np.errstate(divide="ignore", invalid="ignore"):
        arrive = np.where(x[:, 2] < -0.3, x[:, 0] / -x[:, 2], INF)
    h = np.minimum(2.0, arrive)
    mean = x[:, 1] + h * x[:, 3]
    variance = p[:, 1, 1] + h * (p[:, 1, 3] + p[:, 3, 1]) + h * h * p[:, 3, 3]
    none = ~(h >= 0)
    mean[none] = variance[none] = np.nan
    return dict(zip(PLANAR_FIELDS, (accepted, d2, x[:, 0], x[:, 1], x[:, 2], x[:, 3], arrive, mean, variance)))


def planar_walk(state, start, t, z, speed, yaw, sigmas):
    """The filter over rows in order. ``start``: true for the first row of a session; ``state``: what a
    first row that starts none goes on from. Sessions advance side by side, the k-th rows of all in one
    step. -> (state after the last row, PLANAR_FIELDS)."""
    n = len(t)
    begin = np.flatnonzero(start | (np.arange(n) == 0))
    size = np.diff(np.append(begin, n))
    order = np.argsort(-size, kind="stable")  # the longest first: those still open are a prefix
    begin, size = begin[order], size[order]
    now = (np.full(len(begin), np.nan), np.zeros((len(begin), 4)), np.zeros((len(begin), 4, 4)))
    if state is not None and not start[0]:
        first = int(np.flatnonzero(begin == 0)[0])
        for held, value in zip(now, state):
            held[first] = value
    xs, ps, ok, d2 = np.empty((n, 4)), np.empty((n, 4, 4)), np.empty(n, bool), np.empty(n)
    open_at = np.searchsorted(-size, -np.arange(size[0]), side="left")  # sessions with more than k rows
    for k, m in enumerate(open_at):
        rows = begin[:m] + k
        now, ok[rows], d2[rows] = planar_steps(tuple(a[:m] for a in now), t[rows], z[rows], speed[rows], yaw[rows], sigmas[rows])
        xs[rows], ps[rows] = now[1], now[2]
    return (t[-1], xs[-1], ps[-1]), planar_rows(xs, ps, ok, d2)


_WALKED = 1 << 16  # rows of a task that are walked at once


def _with_sessions(o: DataFrame, keys, max_gap_s=0.5) -> DataFrame:
    """``o`` with ``session``, as ``distance_filter_sessions`` numbers the frames of a track (the least time
    of a frame counts); the rows move once."""
    order = ["frame_id", "ordinal"]
    s = by_track(o, keys).withColumn("_at", F.min("t_sec").over(Window.partitionBy(*keys, SEG, "frame_id")))
    s = last_rows(s, keys, 2, {"f": "frame_id", "t": "_at"}, "_two", order=order, keep_segment=True)
    was = F.when(F.size("_two") > 1, F.col("_two")[0])
    gap = F.col("_at") - was["t"]
    opens = was["f"].isNull() | (was["f"] != F.col("frame_id"))
    fresh = F.when(opens & (was["t"].isNull() | ~((gap > 0) & (gap <= max_gap_s))), F.col("frame_id"))
    return running_max(s, keys, order, fresh, "session").select(*o.columns, "session")


def planar_filter(obs: DataFrame, keys=("trip_id", "track_id")) -> DataFrame:
    """Filtered planar state per observation, with the lateral distribution at min(2 s, arrival).

    obs: keys, frame_id, ordinal, t_sec, forward_m, lateral_m, speed_mps, yaw (may be NULL). A task
    walks the sessions of ``_WALKED`` rows side by side; a session cut there goes on in the next rows.
    """
    keys = list(keys)
    s = G.box_depth_sigmas("forward_m")
    o = obs.select(*keys, "frame_id", "ordinal", "t_sec", F.col("forward_m").cast("double").alias("forward_m"), "lateral_m",
                   "speed_mps", "yaw", s["forward"].alias("_s0"), s["lateral"].alias("_s1")).filter("_s0 is not null")
    o = spread(_with_sessions(o, keys), *keys, "session").sortWithinPartitions(*keys, "session", "frame_id", "ordinal")
    names = list(PLANAR_FIELDS)

    def run(batches):
        at, state = None, None
        for pdf in _gathered(batches, _WALKED):
            own = pdf[[*keys, "session"]]
            start = own.ne(own.shift()).any(axis=1).to_numpy()
            start[0] = tuple(own.iloc[0]) != at
            state, out = planar_walk(
                state, start, pdf["t_sec"].to_numpy(float), pdf[["forward_m", "lateral_m"]].to_numpy(float), pdf["speed_mps"].to_numpy(float),
                pdf["yaw"].to_numpy(float), pdf[["_s0", "_s1"]].to_numpy(float))
            at = tuple(own.iloc[-1])
            yield pd.concat([pdf[[*keys, "frame_id", "ordinal"]], pd.DataFrame(out, columns=names)], axis=1)

    head = ", ".join(f"{k} {obs.schema[k].dataType.simpleString()}" for k in (*keys, "frame_id", "ordinal"))
    return o.mapInPandas(run, f"{head}, accepted boolean, " + ", ".join(f"{n} double" for n in names[1:]))


def track_occupancy(filtered: DataFrame, source: str) -> DataFrame:
    """Corridor probability of each filtered observation, tagged with its measurement source."""
    p = G.corridor_occupancy("lateral_mean_m", "lateral_variance_m2")
    return filtered.withColumns({
        "measurement_source": F.lit(source), "corridor_occupancy_probability": F.when(F.col("lateral_mean_m").isNotNull(), p)})


def multicue_rank(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rank a frame's candidates: contained, same track as last frame's choice, near, overlapping.

    items: KEYS, box: the frames to rank. Continuity needs the frame before, so each run of
    neighbouring item frames that have candidates is independent.
    """
    p = items.select(*KEYS, F.col("box").alias("_i")).filter("_i is not null").join(
        candidates.select(*KEYS, "ordinal", "track_id", "box"), KEYS)
    p = p.select(*KEYS, "ordinal", "track_id", G.contains_centre("_i", "box").alias("contains"),
                 G.normalised_centre_distance("_i", "box").alias("distance"), G.bbox_iou("_i", "box").alias("iou"))
    stretch = run_starts(p.select(*KEYS).distinct(), ["trip_id"], "frame_id", 0, "stretch")
    p = spread(p.join(stretch, KEYS), "trip_id", "stretch").sortWithinPartitions("trip_id", "stretch", "frame_id", "ordinal")

    def run(batches):
        at, chosen, out = None, None, []
        names = ["trip_id", "frame_id", "ordinal", "track_id", "contains", "continues", "distance", "iou", "rank"]
        for key, frame, rows in _by_frame(batches, ["trip_id", "stretch"]):
            if key != at:
                at, chosen = key, None
            order = sorted(rows, key=lambda r: (
                not r["contains"], r["track_id"] != chosen, r["distance"], -r["iou"], r["track_id"], r["ordinal"]))
            for n, r in enumerate(order, 1):
                out.append((key[0], frame, r["ordinal"], r["track_id"], r["contains"], r["track_id"] == chosen, r["distance"], r["iou"], n))
            chosen = order[0]["track_id"]
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return p.mapInPandas(run, "trip_id string, frame_id bigint, ordinal bigint, track_id bigint, contains boolean, "
                              "continues boolean, distance double, iou double, rank bigint")


def reset_groups(frames: DataFrame, degraded) -> DataFrame:
    """Number the stretches between unreadable frames: add ``reset_group`` to every key so that
    no state passes a fault; the faulty frame itself opens the next stretch."""
    return running_total(frames, ["trip_id"], ["frame_id"], F.when(degraded, 1).otherwise(0), "reset_group")


def fail_closed(frames: DataFrame, degraded, ttc="ttc") -> DataFrame:
    """Faulty frames report no danger and are marked; state restarts after them."""
    f = reset_groups(frames, degraded)
    return f.withColumns({"degraded": degraded, ttc: F.when(degraded, F.lit(INF)).otherwise(F.col(ttc))})


def classical_choice(tracks: DataFrame, frames: DataFrame, low_ego_speed=0.0, low_ego_closing=0.3, normal_closing=0.3) -> DataFrame:
    """The track chosen per frame when slow own motion asks for faster closing: ttc, track_id,
    confidence, closing_mps, and raw_ttc, which the usual least closing speed would give.

    tracks as for ``select_min_ttc``; frames: trip_id, frame_id, speed_mps. At up to ``low_ego_speed``
    (0: never) a track must close at ``low_ego_closing``. Frames without a choice have infinite TTCs.
    Limits of confidence, speed, depth and residual are fixed values.
    """
    f = frames.select(*KEYS, "speed_mps")
    slow = (F.lit(low_ego_speed) > 0) & (F.col("speed_mps") <= low_ego_speed)
    t = tracks.join(f, KEYS).withColumn("_least", F.when(slow, F.lit(low_ego_closing)).otherwise(F.lit(normal_closing)))
    limits = dict(min_confidence=0.75, max_closing=20.0, max_depth=20.0, max_residual=0.8)
    chosen = select_min_ttc(t, min_closing=F.col("_least"), **limits)
    raw = select_min_ttc(t, min_closing=normal_closing, **limits).select(*KEYS, F.col("ttc").alias("raw_ttc"))
    j = f.join(chosen, KEYS, "left").join(raw, KEYS, "left")
    return j.withColumns({c: F.coalesce(c, F.lit(INF)) for c in ("ttc", "raw_ttc")}).withColumn("low_ego", F.coalesce(slow, F.lit(False))).drop("speed_mps")


def union_gates(df: DataFrame, low_ego_floor=None, low_ego_speed=2.0, filter_gate=False, path_gate=False,
                turn_accel=0.0, turn_min_iou=0.0) -> DataFrame:
    """Optional gates on classical danger, in order; each rewrites ttc and source (fixed values).

    df: predicted_ttc, union_source, detector_ttc, speed_mps, lateral_accel, and for the gates
    used: raw_classical_ttc, filter_ttc (NULL: no accepted update), intersects, matched_iou.
    """
    def active(extra):
        return F.col("union_source").startswith("classical") & (F.col("predicted_ttc") < 2.0) & F.coalesce(extra, F.lit(False))

    def put(df, when, ttc, source):
        return df.withColumn("_w", when).withColumns({
            "predicted_ttc": F.when(F.col("_w"), ttc).otherwise(F.col("predicted_ttc")),
            "union_source": F.when(F.col("_w"), F.lit(source)).otherwise(F.col("union_source"))}).drop("_w")

    det = F.col("detector_ttc")
    if low_ego_floor is not None:
        lifted = ((F.col("union_source") == "classical") & (F.col("speed_mps") <= low_ego_speed)
                  & (F.col("raw_classical_ttc") < 2.0) & ~(F.col("predicted_ttc") < 2.0))
        df = put(df, F.coalesce(lifted, F.lit(False)), F.lit(low_ego_floor), "classical_low_ego_ttc_floor")
    if filter_gate:
        own = F.coalesce(F.col("filter_ttc") < 2.0, F.lit(False))
        df = df.withColumn("_g", active(F.lit(True))).withColumn("_own", F.col("_g") & own)
        df = put(df, F.col("_own"), F.col("filter_ttc"), "v2_ekf_classical")
        df = put(df, F.col("_g") & ~F.col("_own"), det, "v2_ekf_classical_fallback").drop("_g", "_own")
    if path_gate:
        df = put(df, active(~F.col("intersects")), det, "path_nonintersecting_classical_fallback")
    if turn_accel > 0 and turn_min_iou > 0:
        df = put(df, active((F.abs("lateral_accel") >= turn_accel) & (F.coalesce("matched_iou", F.lit(0.0)) < turn_min_iou)), det,
                 "turn_unassociated_classical_fallback")
    return df
