"""Operators on small inputs, against hand-worked values or brute force."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadrisk.functions import geometry as G
from roadrisk.operators import association as A
from roadrisk.operators import fusion, models, motion, pixels, quality, sampling, scoring, sweep, tracking

INF = float("inf")


def test_scores_by_hand(spark):
    df = spark.createDataFrame([("t", 1.0, 1.0), ("t", 1.5, INF), ("t", INF, 1.5), ("t", INF, INF)],
                               "trip_id string, predicted_ttc double, truth_ttc double")
    r = scoring.ttc_score(df, ["trip_id"]).first()
    assert (r.tp, r.fp, r.fn, r.f1, r.mae_critical) == (1, 1, 1, 0.5, 48.75)
    assert r.inverse_mae == pytest.approx(1 / 3) and r.composite == pytest.approx(25.0)


def test_no_critical_frame(spark):
    df = spark.createDataFrame([("t", INF, INF)], "trip_id string, predicted_ttc double, truth_ttc double")
    r = scoring.ttc_score(df, ["trip_id"]).first()
    assert r.mae_critical is None and r.composite == pytest.approx(30.0)


def candidates(spark, n=400, seed=2):
    rnd = random.Random(seed)
    rows = [(f"t{rnd.randrange(3)}", rnd.randrange(60), i, rnd.choice([0.5, 0.55, 0.62, 0.8]), rnd.choice([0.4, 0.47, 0.52, 0.9]), 0.1,
             rnd.choice([0.02, 0.04, 0.09]), rnd.choice([0.6, 0.72, 0.85]), rnd.choice([5.0, 17.0, 30.0]), rnd.choice([8.0, 16.0, 30.0]),
             rnd.choice([0.3, 0.7, 1.0, 2.0]), rnd.choice([0.7, 1.6, 2.6, INF])) for i in range(n)]
    names = ("trip_id frame_id ordinal center_x bottom_y width height confidence closing_mps depth_m residual_m candidate_ttc").split()
    types = ["string", "long", "long"] + ["double"] * 9
    frames = [(f"t{t}", f, rnd.choice([0.9, 1.7, 2.4, INF])) for t in range(3) for f in range(60)]
    return spark.createDataFrame(rows, ", ".join(map(" ".join, zip(names, types)))), spark.createDataFrame(
        frames, "trip_id string, frame_id long, truth_ttc double")


def test_grid_sweep_equals_one_guard_at_a_time(spark):
    c, f = candidates(spark)
    assert sweep.guard_grid(spark).count() == 2916 == sweep.GRID_SIZE
    got = {(r.config_id, r.trip_id): r for r in sweep.grid_sweep(c, f).collect()}
    grid = {r.config_id: r.asDict() for r in sweep.guard_grid(spark).collect()}
    assert grid[sweep.current_guard_id()]["distance"] == 0.0
    for cid in (0, 7, 500, sweep.current_guard_id(), 2915):
        cfg = {k: v for k, v in grid[cid].items() if k not in ("config_id", "distance")}
        p = scoring.frame_min_ttc(c.filter(G.guard_predicate(cfg)), f)
        for r in scoring.ttc_score(p, ["trip_id"]).collect():
            g = got[cid, r.trip_id]
            assert (g.tp, g.fp, g.fn, g.tn) == (r.tp, r.fp, r.fn, r.tn)
            assert g.composite == pytest.approx(r.composite) and g.mae_critical == pytest.approx(r.mae_critical)


def test_loto_marks_infeasible(spark):
    c, f = candidates(spark)
    r = sweep.loto_select(sweep.grid_sweep(c, f), sweep.guard_grid(spark), sweep.current_guard_id(), min_composite=1000.0).collect()
    assert len(r) == 4 and all(x.config_id is None and x.feasible_configs == 0 for x in r)


def test_semantic_state_is_the_recursion(spark):
    rnd = random.Random(4)
    rows = [("t", 1, i, 0, rnd.random() > 0.5, rnd.random()) for i in range(1200)]
    df = spark.createDataFrame(rows, "trip_id string, track_id long, frame_id long, ordinal long, matched boolean, det_confidence double")
    got = {r.frame_id: r for r in fusion.semantic_state(df).collect()}
    score = misses = 0
    for r in rows:
        score = 0.4 * (r[5] if r[4] else 0.0) + 0.6 * score
        misses = 0 if r[4] else misses + 1
        assert got[r[2]].score == pytest.approx(score, abs=1e-12) and got[r[2]].misses == misses


def boxes(spark, n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rnd.uniform(-40, 640), rnd.uniform(-20, 350)
        rows.append(("t", rnd.randrange(4), i, x, y, x + rnd.uniform(1, 200), y + rnd.uniform(1, 120)))
    d = spark.createDataFrame(rows, "trip_id string, frame_id long, ordinal long, x0 double, y0 double, x1 double, y1 double")
    return rows, d.select("trip_id", "frame_id", "ordinal", G.box("x0", "y0", "x1", "y1").alias("box"))


def test_box_pairs_equal_brute_force(spark):
    ra, a = boxes(spark, 60, 1)
    rb, b = boxes(spark, 60, 2)
    p = A.box_pairs(a.withColumnsRenamed({"ordinal": "i", "box": "p"}), b.withColumnsRenamed({"ordinal": "j", "box": "q"}), "p", "q")
    got = sorted((r.i, r.j) for r in p.collect())
    want = sorted((x[2], y[2]) for x in ra for y in rb if x[1] == y[1] and x[3] <= y[5] and y[3] <= x[5] and x[4] <= y[6] and y[4] <= x[6])
    assert got == want and want


def evidence(spark, rows):
    d = spark.createDataFrame(rows, "trip_id string, frame_id long, predicted_ttc double, union_source string, speed_mps double, lateral_accel double")
    return d.withColumn("box", G.box(F.lit(80.0), F.lit(0.0), F.lit(120.0), F.lit(40.0)))


def updates(spark, frames):
    d = spark.createDataFrame([("t", f, 0, 4, 10.0) for f in frames], "trip_id string, frame_id long, ordinal long, track_id long, depth_m double")
    return d.withColumn("box", G.box(F.lit(80.0), F.lit(0.0), F.lit(120.0), F.lit(40.0)))


def test_path_gates(spark):
    rows = [("t", i, 1.0, "classical", 10.0, 0.0) for i in (10, 11)]
    g = A.path_gate(evidence(spark, rows), updates(spark, [10])).orderBy("frame_id").collect()
    assert [(r.gated_ttc, r.suppressed, r.eligible) for r in g] == [(2.0, True, True), (1.0, False, False)]
    c = A.contained_path_gate(evidence(spark, rows), updates(spark, [10, 11])).orderBy("frame_id").collect()
    assert [r.gated_ttc for r in c] == [1.0, 2.0]
    assert [r.association_status for r in c] == ["episode_start_or_no_continuity", "continuous_off_path"]


def line(spark, depths, dt=0.1):
    return spark.createDataFrame([("t", i, i * dt, float(v)) for i, v in enumerate(depths)], "trip_id string, frame_id long, t_sec double, depth_m double")


def test_causal_ttc(spark):
    exact = [10 - 5 * i * 0.1 for i in range(11)]
    jump = [v + (12 if i == 5 else 0) for i, v in enumerate(exact)]
    for depths in (exact, jump):
        r = motion.causal_ttc(line(spark, depths), "depth_m", 11, "theil_sen", 20.0).orderBy("frame_id").collect()
        # slope -5 m/s: at 5.0 m one second remains
        assert r[-1].predicted_ttc == pytest.approx(exact[-1] / 5.0)
    a = motion.causal_ttc(line(spark, exact[:6] + [50.0] * 5), "depth_m").orderBy("frame_id").collect()
    b = motion.causal_ttc(line(spark, exact[:6] + [1.0] * 5), "depth_m").orderBy("frame_id").collect()
    assert [r.predicted_ttc for r in a[:6]] == [r.predicted_ttc for r in b[:6]]


def test_weighted_line(spark):
    obs = line(spark, [10 - i for i in range(5)]).withColumn("sigma_m", F.lit(1.0))
    r = motion.weighted_depth_ttc(obs, ["trip_id"]).orderBy("frame_id").collect()
    assert r[3].regression_ttc is None and r[4].regression_ttc == pytest.approx(0.6)


def test_filters_run_alike_in_tasks_and_by_hand(spark):
    rnd = random.Random(6)
    t = 0.0
    rows = []
    for i in range(120):
        step = 13 if i in (40, 80) else 1
        t += step
        rows.append(("t", 1, int(t), 0, t * 0.05, 30 - 0.1 * i + rnd.gauss(0, 0.5), 0.5))
    df = spark.createDataFrame(rows, "trip_id string, track_id long, frame_id long, ordinal long, t_sec double, depth_m double, sigma_m double")
    got = {r.frame_id: r for r in motion.kalman_distance(df).collect()}
    s = None
    for r in rows:
        s = motion.filter_step(s, r[4], r[5], r[6])
        assert got[r[2]].distance_m == pytest.approx(s[1])
        assert got[r[2]].closing_mps == pytest.approx(motion.motion_of(s, r[4])[0])


def test_matches_move_rows_once(spark):
    rng = np.random.default_rng(5)
    rows = [("t", f, o, int(rng.integers(0, 4)), float(rng.random()), float(rng.integers(-20, 620)), float(rng.integers(-20, 340)), float(rng.integers(0, 90)))
            for f in range(6) for o in range(12)]
    d = spark.createDataFrame(rows, "trip_id string, frame_id long, ordinal long, class_id int, confidence double, x double, y double, side double")
    d = d.withColumn("box", F.when(F.col("ordinal") != 3, G.box(F.col("x"), F.col("y"), F.col("x") + F.col("side"), F.col("y") + F.col("side")))).drop("x", "y", "side")
    a, b = d.filter("ordinal % 2 = 1 AND frame_id <> 4").localCheckpoint(), d.filter("ordinal % 2 = 0 AND frame_id <> 5").localCheckpoint()
    out = A.best_iou_match(a, b, 0.1, 0.0, ("class_id",))
    iou = {(r.frame_id, r.i, r.o): r.v for r in A.box_pairs(
        a.select(*A.KEYS, F.col("ordinal").alias("i"), F.col("box").alias("p")), b.select(*A.KEYS, F.col("ordinal").alias("o"), F.col("box").alias("q")), "p", "q"
    ).withColumn("v", G.bbox_iou("p", "q")).collect()}
    for r in out.collect():
        best = min([(-v, o) for (f, i, o), v in iou.items() if (f, i) == (r.frame_id, r.ordinal) and v > 0], default=None)
        assert r.matched_iou == (-best[0] if best else 0.0)
        assert (r.match.ordinal if r.match else None) == (best[1] if best and -best[0] >= 0.1 else None)
    for plan in (out, A.associate_detections(a, b)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Join") == 1 and "Generate" not in text


def test_semantic_entries_join_on_the_keys_of_the_windows(spark):
    rows = [("t", 1, f, 0, f % 3 == 0, 0.5) for f in range(40)]
    df = spark.createDataFrame(rows, "trip_id string, track_id long, frame_id long, ordinal long, matched boolean, det_confidence double")
    text = fusion.semantic_state(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" not in [line for line in text.splitlines() if "Join" in line][0]


def test_closing_reliability_fits_only_what_is_asked(spark, monkeypatch):
    rows = [("t", k, f, 0.1 * f, 20.0 - f * (k + 1) + (f % 3)) for k in (1, 2) for f in range(30)]
    d = spark.createDataFrame(rows, "trip_id string, track_id long, frame_id long, t_sec double, depth_m double")
    every = {(r.track_id, r.frame_id): (r.closing_mps, r.residual_mad_m) for r in motion.closing_reliability(d).collect()}
    asked = spark.createDataFrame([("t", 1, 0, "a"), ("t", 1, 17, "b"), ("t", 2, 29, "c"), ("t", 3, 5, "d")], "trip_id string, track_id long, frame_id long, mark string")
    fitted, plain = spark.sparkContext.accumulator(0), motion.theil_sen

    def counted(points):
        from pyspark.sql.functions import udf

        def seen(x):
            fitted.add(1)
            return x
        return plain(udf(seen, "array<struct<t: double, v: double>>")(points))

    monkeypatch.setattr(motion, "theil_sen", counted)
    got = {r.mark: (r.track_id, r.frame_id, r.closing_mps, r.residual_mad_m) for r in motion.closing_reliability(d, asked=asked).collect()}
    assert set(got) == {"a", "b", "c"} and all(r[2:] == every[r[:2]] for r in got.values())
    assert fitted.value <= 6  # at most twice each, not the windows of all 60


def test_planar_gate_and_reset():
    s, ok, d = tracking.planar_step(None, 0.0, (10.0, 0.0), 0.0, None, (0.3, 0.3))
    assert ok and d == 0.0
    s, ok, _ = tracking.planar_step(s, 0.1, (9.9, 0.0), 0.0, None, (0.3, 0.3))
    assert ok
    _, ok, d = tracking.planar_step(s, 0.2, (2.0, 8.0), 0.0, None, (0.3, 0.3))
    assert not ok and d > 9.21
    s, ok, d = tracking.planar_step(s, 5.0, (2.0, 8.0), 0.0, None, (0.3, 0.3))
    assert ok and d == 0.0 and tuple(s[1]) == (2.0, 8.0, 0.0, 0.0)


def test_planar_walk_equals_the_steps_of_each_row():
    rng = np.random.default_rng(3)
    n = 600
    start = rng.random(n) < 0.05
    start[0] = True
    t = np.cumsum(rng.choice([0.05, 0.1, 0.3, 0.6, 0.0], n, p=[0.7, 0.2, 0.05, 0.03, 0.02]))
    z, speed = np.column_stack([rng.uniform(1, 40, n), rng.normal(0, 3, n)]), rng.uniform(-1, 25, n)
    yaw = np.where(rng.random(n) < 0.2, np.nan, np.where(rng.random(n) < 0.2, 5e-5, rng.normal(0, 0.3, n)))
    sigmas = rng.uniform(0.2, 3, (n, 2))
    want, s = [], None
    for i in range(n):
        s, ok, d2 = tracking.planar_step(None if start[i] else s, t[i], z[i], speed[i], None if np.isnan(yaw[i]) else yaw[i], sigmas[i])
        want.append(tracking.planar_row(s[1], s[2], ok, d2))
    got, state = [], None
    for x in (slice(0, 201), slice(201, 202), slice(202, n)):  # sessions cut between the pieces go on
        state, out = tracking.planar_walk(state, start[x], t[x], z[x], speed[x], yaw[x], sigmas[x])
        got.append(np.column_stack([out[c] for c in tracking.PLANAR_FIELDS]))
    np.testing.assert_allclose(np.concatenate(got), np.array(want, float), rtol=1e-9, atol=1e-9)


def test_tracks_follow_and_end(spark):
    rows = []
    for f in [0, 1, 2, 6, 7, 20]:  # gaps of three frames keep tracks, longer ones end them
        rows += [("t", f, 0, 100.0 + f, 100.0, 10.0), ("t", f, 1, 400.0 - f, 120.0, 30.0)]
    d = spark.createDataFrame(rows, "trip_id string, frame_id long, ordinal long, x double, y double, depth_m double")
    d = d.select("trip_id", "frame_id", "ordinal", "depth_m", G.box(F.col("x") - 20, F.col("y") - 20, F.col("x") + 20, F.col("y") + 20).alias("box"))
    got = {(r.frame_id, r.ordinal): (r.track_id, r.hits) for r in tracking.track_components(d).collect()}
    assert [got[f, 0] for f in (0, 1, 2, 6, 7, 20)] == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (3, 1)]
    assert got[7, 1] == (2, 5) and got[20, 1] == (4, 1)


def test_multicue_keeps_the_previous_choice(spark):
    items = spark.createDataFrame([("t", f) for f in (1, 2, 4)], "trip_id string, frame_id long").withColumn(
        "box", G.box(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(100.0)))
    spec = {1: [(5, 50.0), (6, 60.0)], 2: [(5, 70.0), (6, 52.0)], 4: [(5, 70.0), (6, 52.0)]}
    rows = [("t", f, o, t, x) for f, v in spec.items() for o, (t, x) in enumerate(v)]
    c = spark.createDataFrame(rows, "trip_id string, frame_id long, ordinal long, track_id long, x double").withColumn(
        "box", G.box(F.col("x") - 10, F.lit(40.0), F.col("x") + 10, F.lit(60.0)))
    top = {r.frame_id: r.track_id for r in tracking.multicue_rank(items, c).filter("rank = 1").collect()}
    assert top == {1: 5, 2: 5, 4: 6}


def test_router_equals_plain_newton(spark):
    rng = np.random.default_rng(0)
    k = len(models.ROUTER_FEATURES)
    x = rng.normal(size=(200, k))
    y = (x[:, 0] - 0.5 * x[:, 3] + rng.normal(size=200) > 0.3).astype(int)
    fold = rng.integers(0, 2, 200)
    rows = spark.createDataFrame([(int(f), [float(v) for v in r], int(l)) for f, r, l in zip(fold, x, y)], "fold int, x array<double>, y int")
    got = {r.fold: r.weights for r in models.fit_routers(rows, spark.range(2).withColumnRenamed("id", "fold")).collect()}
    for f in (0, 1):
        a, b = x[fold != f], y[fold != f].astype(float)
        z = np.column_stack([np.ones(len(a)), (a - a.mean(0)) / a.std(0)])
        c = np.where(b == 1, len(b) / (2 * b.sum()), len(b) / (2 * (1 - b).sum()))
        w, ridge = np.zeros(k + 1), np.diag([0.0] + [2.0] * k)
        for _ in range(40):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve(z.T @ (z * (c * p * (1 - p))[:, None]) + ridge + 1e-8 * np.eye(k + 1), z.T @ (c * (p - b)) + ridge @ w)
        assert np.allclose(got[f], w, atol=1e-6)


def test_router_of_a_thousand_folds(spark):
    rng = np.random.default_rng(2)
    k = len(models.ROUTER_FEATURES)
    x = rng.normal(size=(60, k))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    rows = spark.createDataFrame([(i, [float(v) for v in r], int(l)) for i, (r, l) in enumerate(zip(x, y))], "fold int, x array<double>, y int")
    m = models.fit_routers(rows, spark.range(1000).withColumnRenamed("id", "fold"), iterations=6)
    got = {r.fold: r.weights for r in m.collect()}
    assert len(got) == 1000
    # folds without rows train on all of them, and so alike; a fold with a row trains without it
    assert np.allclose(got[60], got[999], atol=1e-9) and not np.allclose(got[0], got[999], atol=1e-4)
    d = models.router_features(spark.createDataFrame([(f, 1.0, 5.0) for f in (0, 999, 5000)], "fold int, c_ttc double, d_ttc double").selectExpr(
        "*", *[f"CAST(0 AS DOUBLE) AS {s}_{c}" for s in "cd" for c in ("confidence", "residual", "quality", "lr_support", "history", "components", "ground")],
        "CAST(0 AS DOUBLE) AS d_depth_confidence", "CAST(0 AS DOUBLE) AS d_risk_tracks", "CAST(0 AS DOUBLE) AS speed_mps"))
    routed = {r.fold: r for r in models.route(d, models.linear_form(m)).collect()}
    assert len(routed) == 3 and routed[5000].detector_probability is None and routed[5000].routed_ttc == 1.0


def test_router_leaves_agreement_alone(spark):
    names = models.ROUTER_FEATURES
    rows = [(0, 1.0, 1.5), (0, 5.0, 1.0), (0, INF, INF)]
    d = spark.createDataFrame(rows, "fold int, c_ttc double, d_ttc double").withColumns({n: F.lit(1.0) for n in names})
    m = spark.createDataFrame([(0, 5.0, [5.0] * len(names))], "fold int, bias double, slopes array<double>")
    assert [r.routed_ttc for r in models.route(d, m).collect()] == [1.0, 1.0, INF]


def test_tree_split_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=300), 2)
    y = ((v > 0.3) ^ (rng.random(300) < 0.1)).astype(int)
    rows = spark.createDataFrame([(1, int(l), float(a), float(b)) for a, b, l in zip(v, rng.random(300).round(3), y)], "node int, label int, a double, b double")
    r = models.tree_split(rows, ["a", "b"]).first()
    u = np.unique(v)
    t = (u[:-1] + u[1:]) / 2
    if len(t) > 64:
        t = t[np.unique(np.linspace(0, len(t) - 1, 64, dtype=int))]

    def cost(m):
        g = lambda q: len(q) * (1 - q.mean() ** 2 - (1 - q.mean()) ** 2) if len(q) else 0.0
        return g(y[m]) + g(y[~m])
    best = min((cost(v <= x), x) for x in t if 5 <= (v <= x).sum() <= 295)
    assert r.feature == 0 and r.cost == pytest.approx(best[0]) and r.threshold == pytest.approx(best[1])


def test_ground_line(spark):
    modes = spark.createDataFrame([(0, r, 0.1 * r + (5.0 if r % 9 == 0 else 0.0), 20) for r in range(170, 330)],
                                  "frame_id long, row_no long, disparity double, weight long")
    r = pixels.fit_ground_line(modes, ["frame_id"]).first()
    assert r.slope == pytest.approx(0.1) and r.intercept == pytest.approx(0.0, abs=1e-6) and r.support == 142 and r.total_rows == 160


def test_object_depth_takes_the_nearer_mode(spark):
    rows = [(0, y, x, 20.2 if (x + y) % 2 else 8.2) for y in range(40) for x in range(40)]
    p = spark.createDataFrame(rows, "frame_id long, row_no long, col_no long, disparity double").withColumns(
        {"evidence": F.lit(True), "lr_ok": F.lit(True)})
    b = spark.createDataFrame([(0, 1, 0, 0, 40, 40)], "frame_id long, box_id long, x0 long, y0 long, x1 long, y1 long")
    r = pixels.object_depth(p, b, ["frame_id"], 320.0, 0.3).first()
    assert r.depth_m == pytest.approx(96 / 20.2) and r.mode_count == 2
    assert r.confidence == pytest.approx(0.45 * 0.5 + 0.30 + 0.25, abs=0.02)


def test_perception_rules(spark):
    f = spark.createDataFrame([("t", 0, 0.0, "frame_drop")], "trip_id string, frame_id long, t_sec double, reason string")
    doc = quality.unknown_document(f)
    assert quality.validate_perception(doc).first().violations == []
    bad = quality.validate_perception(doc.withColumn("risk_level", F.lit("SAFE"))).first().violations
    assert bad == ["unknown_not_empty"]
    assert quality.validate_perception(doc.withColumn("status", F.lit("valid"))).first().violations == ["valid_with_reasons"]


def test_leakage_guard():
    assert quality.leakage_guard(["depth"]) == ["depth"]
    with pytest.raises(ValueError):
        quality.leakage_guard(["depth", "min_truth_ttc"])


def test_sampling_small_groups(spark):
    d = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "trip_id string, frame_id long")
    got = sampling.evenly_spaced(d, 4)
    assert sorted(r.frame_id for r in got.filter("trip_id = 'a'").collect()) == [0, 3, 6, 9]
    assert got.filter("trip_id = 'b'").count() == 3
    assert [r.frame_id for r in sampling.evenly_spaced(d, 1).filter("trip_id = 'a'").collect()] == [0]


def test_readers_and_writers(spark, tmp_path):
    import json

    from roadrisk.sources import readers, writers

    d = spark.createDataFrame([("T1", i, i * 0.05, INF if i % 2 else 1.25) for i in range(4)], "trip_id string, frame_id long, t_sec double, predicted_ttc double")
    writers.write_predictions(d, str(tmp_path / "p"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "p" / "trip_id=T1").glob("*.csv")))
    assert "frame_id,timestamp,predicted_ttc" in text and "1,0.050000,inf" in text and "2,0.100000,1.250000" in text
    (tmp_path / "T9.csv").write_text("frame_id,timestamp,predicted_ttc\n0,0.0,inf\n1,0.05,1.5\n2,0.1,bad\n")
    r = readers.read_predictions(spark, str(tmp_path / "T9.csv"), "strict").orderBy("frame_id").collect()
    assert [x.predicted_ttc for x in r] == [INF, 1.5, None] and r[2].ttc_error == "not numeric" and r[0].trip_id == "T9"
    doc = {"metadata": {"duration_sec": 1.0, "fps": 20.0, "description": "x"}, "events_log": [{"type": "brake", "t": 0.1}],
           "frames": [{"frame_id": 0, "timestamp": 0.0, "ego": {"speed_kmh": 36.0}, "targets": [{"target_id": "a"}, {"target_id": "b"}], "min_ttc": 1.5}]}
    (tmp_path / "trips").mkdir()
    (tmp_path / "trips" / "T7.json").write_text(json.dumps(doc))
    trips = readers.read_trips(spark, str(tmp_path / "trips"))
    assert trips.first().trip_id == "T7"
    assert readers.explode_targets(trips).count() == 2 and readers.explode_frames(trips).first().min_ttc == 1.5
    assert readers.explode_events(trips).first().type == "brake"
    (tmp_path / "img").mkdir()
    for n in ("000003.jpg", "frame_7.jpg", "notes.jpg"):
        (tmp_path / "img" / n).write_bytes(b"x")
    assert [x.frame_id for x in readers.list_modality_files(spark, str(tmp_path / "img"), ".jpg").collect()] == [3]
    assert [x.frame_id for x in readers.list_modality_files(spark, str(tmp_path / "img"), ".jpg", "frame_").collect()] == [7]


def test_residual_sigmas_reads_its_observations_once(spark):
    rng = np.random.default_rng(8)
    rows = [("t", k, i * 0.05, float(20 - 0.1 * i + rng.normal()), float(rng.normal())) for k in (1, 2) for i in range(41)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    kind = "trip_id string, track_id long, t_sec double, depth_m double, lateral_m double"
    got = {r.track_id: r for r in motion.residual_sigmas(spark.createDataFrame(rows, kind).mapInPandas(count, kind)).collect()}
    for k in (1, 2):
        t, d, x = (np.array([r[c] for r in rows if r[1] == k]) for c in (2, 3, 4))
        mad = [1.4826 * np.median(np.abs(e - np.median(e))) for e in (d - np.polyval(np.polyfit(t, d, 1), t), x - np.polyval(np.polyfit(t, x, 1), t))]
        assert np.allclose([got[k].median_depth_m, got[k].depth_sigma_m, got[k].lateral_sigma_m], [np.median(d), *mad])
    assert seen.value == len(rows)


def test_long_stretches_are_walked_in_segments(spark, monkeypatch):
    """Segments side by side give the tracks of the plain walk, with gaps, NULL depths, ties and segments that must be walked again."""
    rng = np.random.default_rng(11)
    rows = []
    for trip in ("a", "b"):
        f = 0
        for _ in range(300):
            f += int(rng.choice([1, 2, 4, 6], p=[0.9, 0.06, 0.03, 0.01]))
            for o in range(int(rng.integers(1, 5))):
                x = 100.0 + 60 * o + (rng.normal(0, 25) if trip == "a" else 0)  # trip b: tracks that live long, equal boxes
                rows.append((trip, f, o, x, 100.0, None if rng.random() < 0.03 else 10.0 + (rng.random() if trip == "a" else 0)))
                if trip == "b" and o == 0:
                    rows.append((trip, f, 9, x, 100.0, 10.0))
    d = spark.createDataFrame(rows, "trip_id string, frame_id long, ordinal long, x double, y double, depth_m double")
    d = d.select("trip_id", "frame_id", "ordinal", "depth_m", G.box(F.col("x") - 20, F.col("y") - 20, F.col("x") + 20, F.col("y") + 20).alias("box"))
    want = {}
    for trip in ("a", "b"):
        mine = sorted((r for r in rows if r[0] == trip), key=lambda r: r[1:3])
        tracks, made, last = [], 0, None
        for f in sorted({r[1] for r in mine}):
            comps = [{"ordinal": o, "x0": x - 20, "y0": y - 20, "x1": x + 20, "y1": y + 20, "cx": x, "cy": y, "depth_m": np.nan if z is None else z}
                     for _, g, o, x, y, z in mine if g == f]
            tracks, made, found = tracking.frame_tracks(tracks, made, comps, 0 if last is None else f - last - 1, 3)
            last = f
            want |= {(trip, f, c["ordinal"]): (k, h) for c, k, h in found}
    for segments in (((32, 16),), ((16, 13), (64, 32)), ()):
        monkeypatch.setattr(tracking, "TRACK_SEGMENTS", segments)
        got = {(r.trip_id, r.frame_id, r.ordinal): (r.track_id, r.hits) for r in tracking.track_components(d).collect()}
        assert got == want
