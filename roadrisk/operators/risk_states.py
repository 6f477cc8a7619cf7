"""Debounced risk states per trip.

A frame is one of five symbols (four severity bands, or unreliable) and the debounce counters
are bounded, so each preset is a small finite automaton. Trips of any length are cut into
segments: every segment first reports, for each possible entry state, the state it leaves
behind; those maps are composed in a tree (``scan``), which gives the true entry states; then all
segments are walked at once. The Structured Streaming operator uses the same automaton.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadrisk.constants import DEFAULT_PRESET, RISK_PRESETS
from roadrisk.functions.ttc import ttc_band
from roadrisk.operators.lineage import spread
from roadrisk.operators.scan import mapping, scan
from roadrisk.operators.sequence import SEG, segmented

SYMBOLS = ("SAFE", "WARNING", "DANGER", "CRITICAL", "UNKNOWN")
REASONS = (
    "unreliable", "danger_exit_confirmed", "danger_held", "danger_enter_confirmed",
    "attentive_exit_confirmed", "attentive_held", "attentive_enter_confirmed", "normal",
)
START = ("NORMAL", 0, 0, 0, 0)


def step(state, band, preset):
    """One frame: (name, danger, attentive, danger_clear, attentive_clear) -> (state, reason)."""
    enter, enter_critical, leave, warn, calm, _ = preset
    name, danger, attentive, clear, quiet = state
    if band == "UNKNOWN":
        return ("UNKNOWN", 0, 0, 0, 0), "unreliable"
    hot, warm = band in ("DANGER", "CRITICAL"), band != "SAFE"
    danger = min(danger + 1, max(enter, enter_critical)) if hot else 0
    attentive = min(attentive + 1, max(warn, 1)) if warm else 0
    name = "NORMAL" if name == "UNKNOWN" else name
    if name == "HIGH_RISK":
        clear = 0 if hot else clear + 1
        if clear < leave:
            return (name, danger, attentive, clear, quiet), "danger_held"
        return ("ATTENTIVE" if warm else "NORMAL", danger, attentive, 0, quiet), "danger_exit_confirmed"
    if hot and danger >= (enter_critical if band == "CRITICAL" else enter):
        return ("HIGH_RISK", danger, attentive, 0, quiet), "danger_enter_confirmed"
    if name == "ATTENTIVE":
        quiet = 0 if warm else quiet + 1
        if quiet < calm:
            return (name, danger, attentive, clear, quiet), "attentive_held"
        return ("NORMAL", danger, attentive, clear, 0), "attentive_exit_confirmed"
    if warm and attentive >= warn:
        return ("ATTENTIVE", danger, attentive, clear, 0), "attentive_enter_confirmed"
    return (name, danger, attentive, clear, quiet), "normal"


@lru_cache(maxsize=None)
def automaton(preset):
    """Reachable states, and per (symbol, state) the next state and the reason, as arrays."""
    states, index, nxt, why = [START], {START: 0}, [], []
    for s in states:
        row, reasons = [], []
        for band in SYMBOLS:
            t, reason = step(s, band, preset)
            if t not in index:
                index[t] = len(states)
                states.append(t)
            row.append(index[t])
            reasons.append(REASONS.index(reason))
        nxt.append(row)
        why.append(reasons)
    return states, np.array(nxt, dtype=np.int32).T.copy(), np.array(why, dtype=np.int32).T.copy()


def preset_of(preset):
    return RISK_PRESETS[preset] if isinstance(preset, str) else tuple(preset)


def symbol(ttc="ttc", reliable="reliable"):
    band = ttc_band(ttc)
    code = F.when(band == "SAFE", 0).when(band == "WARNING", 1).when(band == "DANGER", 2).otherwise(3)
    return F.when(F.col(reliable), code).otherwise(4).cast("int")


CHUNK = 256  #: segments walked side by side


def _flat(symbols: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of the segments, and where each segment starts among them."""
    starts = symbols.offsets.to_numpy().astype(np.int64)
    return symbols.flatten().to_numpy(zero_copy_only=False), starts - starts[0]


def _side_by_side(flat: np.ndarray, starts: np.ndarray, preset: pa.Array):
    """(preset, rows, inside, symbols) of at most CHUNK segments of one preset: a row of symbols for each
    frame number, with the idle symbol after a segment's end; ``inside`` says where there are frames."""
    preset = np.array(preset.to_pylist(), object)
    for p in sorted(set(preset)):
        of = np.flatnonzero(preset == p)
        for a in range(0, len(of), CHUNK):
            rows = of[a:a + CHUNK]
            sizes = starts[rows + 1] - starts[rows]
            inside = np.arange(int(sizes.max())) < sizes[:, None]
            grid = np.full(inside.shape, len(SYMBOLS), np.int8)
            grid[inside] = np.concatenate([flat[starts[r]:starts[r + 1]] for r in rows])
            yield p, rows, inside, np.ascontiguousarray(grid.T)


def _idle(nxt, why):
    """Tables of an automaton with one more symbol, which changes nothing."""
    return np.vstack([nxt, np.arange(nxt.shape[1], dtype=nxt.dtype)]), np.vstack([why, np.zeros_like(why[:1])])


def _segment_maps(presets):
    tables = {n: _idle(*automaton(preset_of(n))[1:])[0] for n in presets}
    states = max(t.shape[1] for t in tables.values())

    @F.arrow_udf("array<double>")
    def left_by(symbols: pa.Array, preset: pa.Array) -> pa.Array:
        out = np.tile(np.arange(states + 1, dtype=float), (len(symbols), 1))
        for p, rows, inside, grid in _side_by_side(*_flat(symbols), preset):
            nxt = tables[p]
            state = np.tile(np.arange(nxt.shape[1]), (len(rows), 1))
            for syms in grid:
                state = nxt[syms[:, None], state]
            out[rows, :state.shape[1]] = state
            out[rows, -1] = inside.sum(axis=1)
        return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * (states + 1), out.reshape(-1))

    return left_by, mapping(states)


def _walk(presets):
    """States and reasons of the frames of segments, a byte a frame and no object a segment: a batch holds up
    to ten thousand segments."""
    tables = {n: _idle(*automaton(preset_of(n))[1:]) for n in presets}
    kind, name = (np.int8, "tinyint") if all(t.shape[1] < 128 for t, _ in tables.values()) else (np.int32, "int")

    @F.arrow_udf(f"struct<states: array<{name}>, reasons: array<tinyint>>")
    def walk(symbols: pa.Array, entry: pa.Array, preset: pa.Array) -> pa.Array:
        flat, starts = _flat(symbols)
        states, reasons = np.empty(len(flat), kind), np.empty(len(flat), np.int8)
        entry = entry.to_numpy(zero_copy_only=False)
        for p, rows, inside, grid in _side_by_side(flat, starts, preset):
            nxt, why = tables[p]
            s = entry[rows]
            path, because = np.empty(grid.shape, kind), np.empty(grid.shape, np.int8)
            for i, syms in enumerate(grid):
                because[i] = why[syms, s]
                path[i] = s = nxt[syms, s]
            for k, r in enumerate(rows):
                n = starts[r + 1] - starts[r]
                states[starts[r]:starts[r + 1]], reasons[starts[r]:starts[r + 1]] = path[:n, k], because[:n, k]
        cuts = starts.astype(np.int32)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, states), pa.ListArray.from_arrays(cuts, reasons)], ["states", "reasons"])

    return walk


def _names(presets):
    """Literal arrays that turn state and reason numbers back into words, per preset."""
    words = F.create_map(*[
        x for n in presets
        for x in (F.lit(n), F.array(*[F.lit(s[0]) for s in automaton(preset_of(n))[0]]))
    ])
    return words, F.array(*[F.lit(r) for r in REASONS])


def risk_states(frames: DataFrame, presets=(DEFAULT_PRESET,), ttc="ttc", reliable=None,
                keys=("trip_id",), rows=None) -> DataFrame:
    """State and reason of every frame under each named preset.

    ``frames`` has ``keys``, ``frame_id`` (one row each) and a TTC; without ``reliable`` every
    frame counts as reliable. Returns keys, preset, frame_id, position (row number in the
    trip, from 0), ttc, raw_band, state, reason.
    """
    keys, presets = list(keys), list(presets)
    if reliable is None:
        frames, reliable = frames.withColumn("_ok", F.lit(True)), "_ok"
    f = frames.select(*keys, "frame_id", F.col(ttc).alias("ttc"), symbol(ttc, reliable).cast("tinyint").alias("_sym"))
    f = segmented(f, **({"rows": rows} if rows else {}))
    row = F.struct("frame_id", "_sym", "ttc")
    # one array per segment: at most SEGMENT_ROWS frames, whatever the trip's length
    segs = spread(f, *keys, SEG).groupBy(*keys, SEG).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    segs = segs.withColumn("preset", F.explode(F.array(*[F.lit(p) for p in presets])))
    syms = F.col("_rows._sym")
    # each segment as a map of states and a count; combined along the trip they give its entry state
    left_by, rule = _segment_maps(presets)
    maps = segs.select(*keys, SEG, "preset", left_by(syms, F.col("preset")).alias("element"))
    entries = scan(maps, [*keys, "preset"], SEG, rule).select(
        *keys, "preset", SEG, F.col("entry")[0].cast("int").alias("_entry"), F.element_at("entry", -1).cast("long").alias("_earlier"))
    done = segs.join(entries, [*keys, SEG, "preset"]).withColumn(
        "_w", _walk(presets)(syms, F.col("_entry"), F.col("preset")))
    words, reasons = _names(presets)
    zipped = F.arrays_zip(F.col("_rows").alias("r"), F.col("_w.states").alias("s"), F.col("_w.reasons").alias("y"))
    flat = done.select(*keys, "preset", "_earlier", F.posexplode(zipped).alias("_i", "z"))
    return flat.select(
        *keys, "preset", F.col("z.r.frame_id").alias("frame_id"),
        (F.col("_earlier") + F.col("_i")).alias("position"), F.col("z.r.ttc").alias("ttc"),
        F.when(F.col("z.r._sym") == 4, F.lit("UNKNOWN")).otherwise(ttc_band(F.col("z.r.ttc"))).alias("raw_band"),
        words[F.col("preset")][F.col("z.s").cast("int")].alias("state"), reasons[F.col("z.y").cast("int")].alias("reason"),
    )


def event_to_ttc(states: DataFrame, ttc="ttc", floor=2.0) -> DataFrame:
    """TTC reported only while HIGH_RISK; otherwise at least ``floor``."""
    gated = F.when(F.col("state") == "HIGH_RISK", F.col(ttc)).otherwise(F.greatest(F.col(ttc), F.lit(floor)))
    return states.withColumn("event_ttc", gated)
