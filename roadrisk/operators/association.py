"""Matching boxes within frames.

Where each box wants its best partner, the objects of its image come to it as one list, so rows
move once. Where all pairs are asked for, boxes that may overlap are found by a join on (keys,
image cell): each box is listed in the cells it covers, so only neighbours meet; a pair that
shares several cells is kept in the first one only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadrisk.constants import IMAGE_HEIGHT, IMAGE_WIDTH, PATH_HALF_WIDTH_M, ROAD_USER_CLASSES
from roadrisk.functions import geometry as G
from roadrisk.functions.ttc import is_danger
from roadrisk.operators.lineage import cut
from roadrisk.operators.sequence import previous

KEYS = ["trip_id", "frame_id"]
CELL_W, CELL_H = 160, 90
FOCAL_PX, PRINCIPAL_PX = 500.0, 320.0


def _cell(v: Column, size: int, limit: int) -> Column:
    """Cell of a coordinate; whatever lies outside the image counts to the border cells."""
    return F.least(F.greatest(F.floor(v / F.lit(size)), F.lit(0)), F.lit(limit // size - 1)).cast("int")


def _cells(df: DataFrame, b: str) -> DataFrame:
    box = F.col(b)
    xs = F.sequence(_cell(box["x0"], CELL_W, IMAGE_WIDTH), _cell(F.greatest(box["x0"], box["x1"]), CELL_W, IMAGE_WIDTH))
    ys = F.sequence(_cell(box["y0"], CELL_H, IMAGE_HEIGHT), _cell(F.greatest(box["y0"], box["y1"]), CELL_H, IMAGE_HEIGHT))
    return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def _touch(p: Column, q: Column) -> Column:
    return (p["x0"] <= q["x1"]) & (q["x0"] <= p["x1"]) & (p["y0"] <= q["y1"]) & (q["y0"] <= p["y1"])


def _with_objects(items: DataFrame, objects: DataFrame, row: Column, name: str) -> DataFrame:
    """``items`` with the objects of their image (``row`` of those that have a box) as one list: both sides
    move once, and no pair leaves its row."""
    o = objects.filter(F.col("box").isNotNull()).groupBy(*KEYS).agg(F.collect_list(row).alias(name))
    return items.join(o, KEYS, "left")


def box_pairs(a: DataFrame, b: DataFrame, a_box: str, b_box: str, keys=KEYS) -> DataFrame:
    """Pairs of rows of one frame whose boxes touch or overlap (inclusive edges)."""
    j = _cells(a.filter(F.col(a_box).isNotNull()), a_box).join(
        _cells(b.filter(F.col(b_box).isNotNull()), b_box), [*keys, "_cx", "_cy"])
    p, q = F.col(a_box), F.col(b_box)
    first = (
        (F.col("_cx") == F.greatest(_cell(p["x0"], CELL_W, IMAGE_WIDTH), _cell(q["x0"], CELL_W, IMAGE_WIDTH)))
        & (F.col("_cy") == F.greatest(_cell(p["y0"], CELL_H, IMAGE_HEIGHT), _cell(q["y0"], CELL_H, IMAGE_HEIGHT)))
    )
    return j.filter(first & _touch(p, q)).drop("_cx", "_cy")


def retained(class_id="class_id") -> Column:
    return F.col(class_id).isin(*ROAD_USER_CLASSES)


def class_name(class_id="class_id") -> Column:
    names = F.create_map(*[F.lit(x) for kv in ROAD_USER_CLASSES.items() for x in kv])
    return F.element_at(names, F.col(class_id).cast("int"))


def associate_detections(components: DataFrame, detections: DataFrame) -> DataFrame:
    """Best detection per component: components keep their columns, plus matched, det_class,
    det_confidence, det_iou.

    components: KEYS, ordinal, box. detections: KEYS, ordinal, class_id, confidence, box.
    """
    row = F.struct(F.col("ordinal").alias("_d"), F.col("class_id").alias("_class"), F.col("confidence").alias("_conf"),
                   G.expand_and_clip("box").alias("_dbox"))
    c = F.col("box")

    def judged(r):
        b = r["_dbox"]
        tall = G.vertical_overlap(c, b) >= 0.50
        iou = G.bbox_iou(c, b)
        matched = _touch(c, b) & (
            (iou >= 0.15) | (G.contains_centre(b, c) & tall)
            | (G.contains_centre(c, b) & (G.intersection_over_box(c, b) >= 0.50) & tall))
        score = 0.60 * r["_conf"] + 0.40 * iou
        return F.when(matched, F.struct((-score).alias("s"), r["_d"].alias("_d"), r["_class"].alias("_class"), r["_conf"].alias("_conf"), iou.alias("_iou")))

    best = _with_objects(components, detections.filter(retained()), row, "_seen")
    best = best.withColumn("_m", F.array_min(F.transform("_seen", judged))).drop("_seen")
    m = F.col("_m")
    return best.withColumns({
        "matched": m.isNotNull(), "det_class": m["_class"],
        "det_confidence": F.coalesce(m["_conf"], F.lit(0.0)), "det_iou": F.coalesce(m["_iou"], F.lit(0.0)),
    }).drop("_m")


def best_iou_match(items: DataFrame, candidates: DataFrame, min_iou: float, floor=1e-9, take=("track_id", "depth_m")) -> DataFrame:
    """Each item (its ``box``, may be NULL) with the candidate box of largest IoU.

    Adds matched_iou (best found, 0 if none) and a struct ``match`` of the candidate's
    ordinal, box and ``take`` columns: NULL below ``min_iou``. First ordinal wins ties.
    """
    i = F.col("box")

    def judged(r):
        iou = G.bbox_iou(i, r["box"], floor)
        return F.when(_touch(i, r["box"]) & (iou > 0), F.struct((-iou).alias("_neg"), *[r[c].alias(c) for c in ("_o", "box", *take)]))

    row = F.struct(F.col("ordinal").alias("_o"), "box", *take)
    best = _with_objects(items, candidates, row, "_seen").withColumn("_m", F.array_min(F.transform("_seen", judged))).drop("_seen")
    m = F.col("_m")
    iou = F.coalesce(-m["_neg"], F.lit(0.0))
    match = F.struct(m["_o"].alias("ordinal"), m["box"].alias("box"), *[m[c].alias(c) for c in take])
    return best.withColumns(
        {"matched_iou": iou, "match": F.when(iou >= min_iou, F.when(m.isNotNull(), match))}).drop("_m")


def containment_match(items: DataFrame, candidates: DataFrame, take=("track_id", "depth_m")) -> DataFrame:
    """Candidates whose centre lies in the item's box: their number, and the one if unique."""
    a = items.select(*KEYS, F.col("box").alias("_ibox"))
    b = candidates.select(*KEYS, F.col("box").alias("_b"), *take)
    inside = box_pairs(a, b, "_ibox", "_b").filter(G.contains_centre("_ibox", "_b"))
    n = inside.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("contained"), F.min(F.struct(F.col("_b").alias("box"), *take)).alias("_one"))
    out = items.join(n, KEYS, "left").withColumn("contained", F.coalesce("contained", F.lit(0)))
    status = F.when(F.col("contained") == 1, "unique").when(F.col("contained") > 1, "ambiguous").otherwise("none")
    return out.withColumns({
        "containment": status, "match": F.when(F.col("contained") == 1, F.col("_one"))}).drop("_one")


def classical_danger(source="union_source", ttc="predicted_ttc") -> Column:
    return F.col(source).startswith("classical") & is_danger(ttc)


def _offset(m: Column) -> Column:
    return G.path_offset(m["box"], m["depth_m"], "speed_mps", "lateral_accel", FOCAL_PX, PRINCIPAL_PX)


def path_gate(evidence: DataFrame, updates: DataFrame, min_iou=0.30, half=PATH_HALF_WIDTH_M) -> DataFrame:
    """Classical danger whose matched track lies off the own path becomes 2.0 s.

    Missing matches or geometry leave the TTC as it is.
    """
    danger = classical_danger()
    asked = evidence.withColumn("box", F.when(danger, F.col("box")))
    m = best_iou_match(asked, updates, min_iou)
    m = m.withColumn("path_offset_m", F.when(danger, _offset(F.col("match"))))
    eligible = F.col("path_offset_m").isNotNull()
    off = F.coalesce(F.abs("path_offset_m") > half, F.lit(False))
    return m.withColumns({
        "eligible": eligible, "suppressed": off,
        "gated_ttc": F.when(off, F.lit(2.0)).otherwise(F.col("predicted_ttc")),
    })


def contained_path_gate(evidence: DataFrame, updates: DataFrame, half=PATH_HALF_WIDTH_M) -> DataFrame:
    """As ``path_gate``, but by unique containment, and only from the second frame in a row
    in which the same track is the contained one."""
    danger = classical_danger()
    asked = evidence.withColumn("box", F.when(danger, F.col("box")))
    m = containment_match(asked, updates)
    track = F.when(danger & (F.col("containment") == "unique"), F.col("match")["track_id"])
    m = m.withColumn("_track", track)
    m = previous(m, ["trip_id"], ["frame_id"], {"_was": "_track", "_before": "frame_id"})
    held = F.coalesce((F.col("_before") == F.col("frame_id") - 1) & (F.col("_was") == F.col("_track")), F.lit(False))
    m = m.withColumn("path_offset_m", F.when(held, _offset(F.col("match"))))
    off = F.coalesce(F.abs("path_offset_m") > half, F.lit(False))
    status = (
        F.when(~danger, "not_classical_danger")
        .when(F.col("_track").isNull(), "ambiguous_or_missing_containment")
        .when(~held, "episode_start_or_no_continuity")
        .when(F.col("path_offset_m").isNull(), "continuous_geometry_unavailable")
        .when(off, "continuous_off_path").otherwise("continuous_on_path")
    )
    return m.withColumns({
        "association_status": status, "suppressed": off,
        "gated_ttc": F.when(off, F.lit(2.0)).otherwise(F.col("predicted_ttc")),
    }).drop("_track", "_was", "_before")


def rank_candidates(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """All candidates of an item's frame, ranked by IoU, centre distance, depth difference.

    One item per frame, so this is a plain equi-join. Items: box, item_depth_m.
    """
    from pyspark.sql import Window

    p = items.select(*KEYS, F.col("box").alias("_i"), "item_depth_m").filter("_i is not null").join(
        candidates.select(*KEYS, "ordinal", "track_id", "depth_m", "box"), KEYS)
    p = p.withColumns({
        "bbox_iou": G.bbox_iou("_i", "box"), "centre_distance_px": G.centre_distance("_i", "box"),
        "depth_delta_m": F.abs(F.col("item_depth_m") - F.col("depth_m"))})
    w = Window.partitionBy(*KEYS).orderBy(F.desc("bbox_iou"), "centre_distance_px", "depth_delta_m", "ordinal")
    return p.withColumn("rank", F.row_number().over(w)).drop("_i")


def detection_parity(a: DataFrame, b: DataFrame, min_iou=0.5, by=("trip_id",)) -> DataFrame:
    """How well detector b reproduces detector a: matches, class agreement, IoU, confidence."""
    from roadrisk.operators.quantiles import exact_quantiles

    m = best_iou_match(a, b, min_iou, 0.0, ("class_id", "confidence"))
    # written once: the counts and the median read it
    m = cut(m.select(*by, "matched_iou", F.col("match").isNotNull().alias("_hit"), (F.col("class_id") == F.col("match.class_id")).alias("_same"),
                     F.abs(F.col("confidence") - F.col("match.confidence")).alias("_gap")))
    hit, same, gap = F.col("_hit"), F.col("_same"), F.when(F.col("_hit"), F.col("_gap"))
    counts = m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reference_boxes"), F.count_if(hit).alias("matched"),
        F.count_if(hit & same).alias("class_agreed"), F.count_if(hit & ~same).alias("class_swaps"),
        F.count_if(hit & ~same & (F.col("matched_iou") >= 0.95)).alias("same_box_swaps"),
        F.avg(gap).alias("mean_confidence_gap"), F.max(gap).alias("max_confidence_gap"))
    med = exact_quantiles(m.filter(hit), list(by), "matched_iou", {"median_iou": 0.5})
    return counts.join(med, list(by), "left")


def label_evidence(labels: DataFrame, evidence: DataFrame, updates: DataFrame) -> DataFrame:
    """Labelled (frame, track) with its path geometry.

    status: missing_evidence (the frame is unknown: an error), no_update, no_geometry, available.
    The first update of a (frame, track) counts.
    """
    one = updates.groupBy(*KEYS, "track_id").agg(
        F.min(F.struct("ordinal", "box", "depth_m")).alias("_u"))
    e = evidence.select(*KEYS, "speed_mps", "lateral_accel", F.lit(True).alias("_seen"))
    j = labels.join(e, KEYS, "left").join(one, [*KEYS, "track_id"], "left")
    u = F.col("_u")
    j = j.withColumn("path_offset_m", F.when(u.isNotNull(), _offset(u)))
    status = (
        F.when(F.col("_seen").isNull(), "missing_evidence").when(u.isNull(), "no_update")
        .when(F.col("path_offset_m").isNull(), "no_geometry").otherwise("available"))
    return j.withColumns({"status": status, "depth_m": u["depth_m"]}).drop("_u", "_seen")


def track_window_coverage(labels: DataFrame, updates: DataFrame, radius=5) -> DataFrame:
    """Share of the frames within ``radius`` of a label in which its track is visible.

    Each label lists its at most 2 * radius + 1 frames, so this is an equi-join.
    """
    seen = updates.select(*KEYS, "track_id").distinct().withColumnRenamed("frame_id", "_f")
    first = F.greatest(F.lit(0), F.col("frame_id") - radius)
    asked = labels.withColumn("_f", F.explode(F.sequence(first, F.col("frame_id") + radius)))
    j = asked.join(seen.withColumn("_hit", F.lit(1)), ["trip_id", "_f", "track_id"], "left")
    out = j.groupBy(*KEYS, "track_id").agg(
        F.count("_hit").alias("visible_frames"), F.count(F.lit(1)).alias("window_frames"))
    return out.withColumn("visible_fraction", F.col("visible_frames") / F.col("window_frames"))


def candidate_geometry(suppressed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Suppressed (frame, track) rows with the geometry of the last such candidate."""
    cols = [c for c in candidates.columns if c not in (*KEYS, "track_id", "ordinal")]
    last = candidates.groupBy(*KEYS, "track_id").agg(
        F.max_by(F.struct(*cols), "ordinal").alias("_g"))
    return suppressed.join(last, [*KEYS, "track_id"]).select(
        *suppressed.columns, *[F.col("_g")[c].alias(c) for c in cols])


# fixed values: middle fifth of the image, in pixels
_MIDDLE = (256.0, 384.0)
PROVISIONAL_MARK = "PROVISIONAL_AI_ASSUMPTION; camera-position heuristic only; not ground truth"


def provisional_labels(labels: DataFrame, evidence: DataFrame) -> DataFrame:
    """Fill unlabelled rows (trip_id, frame_id, track_id) from the box position, marked as no
    truth: all eight reviewer fields, so that the rows pass the check of label files."""
    x = F.coalesce(G.centre("box")[0], F.lit(0.0))
    rel = F.when(x.between(*_MIDDLE), "on_path").otherwise("adjacent")
    j = labels.join(evidence.select(*KEYS, "box"), KEYS, "left").withColumn("path_relation", rel)
    owner = F.when(F.col("path_relation") == "on_path", "yes").otherwise("no")
    name = F.concat(F.lit("ai-"), F.col("trip_id"), F.lit("-"), F.coalesce("track_id", "frame_id").cast("string"))
    return j.withColumns({
        "object_id_window": name, "event_owner": owner, "relative_motion": F.lit("closing"), "cpa_distance_m": F.lit("unknown"),
        "occluded": F.lit("unknown"), "candidate_type": F.lit("unknown"), "review_confidence": F.lit("low"),
        "notes": F.lit(PROVISIONAL_MARK)}).drop("box")
