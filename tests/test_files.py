"""Readers and writers on written files."""
import json

from pyspark.sql import functions as F

from roadrisk.operators.quality import validate_predictions, validate_risk_event
from roadrisk.sources import readers as R
from roadrisk.sources import writers as W

CANDIDATE_HEADER = (
    "frame_id,timestamp,track_id,ground_truth_ttc,ground_confidence,depth_m,closing_speed_mps,candidate_ttc,motion_residual_m,confidence,"
    "selected_hits,selected_history,selected_depth_confidence,selected_center_x_norm,selected_bottom_y_norm,selected_width_norm,"
    "selected_height_norm,selected_quality,selected_depth_mad_m,selected_depth_mad_ratio,selected_lr_support,selected_corridor_overlap")


def test_candidates_by_name_with_ordinal(spark, tmp_path):
    (tmp_path / "T1.csv").write_text(
        CANDIDATE_HEADER + "\n7,0.35,42,inf,0.9,12.5,3.0,4.1,,0.8,3,5,0.7,0.5,0.9,0.1,0.2,0.6,0.1,0.01,0.9,0.4\n"
        "7,0.35,43,1.500,0.9,10,3.0,inf,0.2,0.7,3,5,0.7,0.4,0.8,0.1,0.2,0.6,0.1,0.01,0.9,0.4\n8,0.4,42,inf,0.9,12,3.0,4.0,0.1,0.8,3,5,0.7,0.5,0.9,0.1,0.2,0.6,0.1,0.01,0.9,0.4\n")
    rows = sorted(R.read_candidates(spark, str(tmp_path)).collect(), key=lambda r: (r["frame_id"], r["ordinal"]))
    assert [(r["trip_id"], r["frame_id"], r["ordinal"], r["track_id"], r["t_sec"]) for r in rows] == [
        ("T1", 7, 0, 42, 0.35), ("T1", 7, 1, 43, 0.35), ("T1", 8, 0, 42, 0.4)]
    assert rows[0]["truth_ttc"] == float("inf") and rows[0]["residual_m"] is None and rows[0]["center_x"] == 0.5 and rows[1]["candidate_ttc"] == float("inf")


def test_detections_in_another_order(spark, tmp_path):
    (tmp_path / "T2.csv").write_text(
        "﻿confidence,frame_id,timestamp,class_id,class_name,x0,y0,x1,y1\n0.5,1,0.0,2,car,1,2,3,4\n0.9,1,0.0,0,person,5,6,7,8\n")
    rows = sorted(R.read_detections(spark, str(tmp_path), 1).collect(), key=lambda r: r["ordinal"])
    assert [(r["frame_id"], r["ordinal"], r["class_name"], r["confidence"], r["box"]["x1"]) for r in rows] == [(0, 0, "car", 0.5, 3.0), (0, 1, "person", 0.9, 7.0)]


def test_prediction_files_to_validation(spark, tmp_path):
    lines = [f"{k},{k * 0.05:.6f},{'inf' if k % 3 else '1.5'}" for k in range(400)]
    lines[7] = "7,0.350000,bad"
    (tmp_path / "T3.csv").write_text("frame_id,timestamp,predicted_ttc\n" + "\n".join(lines) + "\n")
    p = R.read_predictions(spark, str(tmp_path)).withColumnsRenamed({"t_sec": "timestamp", "predicted_ttc": "_v", "ttc_text": "predicted_ttc"})
    frames = spark.range(400).select(F.lit("T3").alias("trip_id"), F.col("id").alias("frame_id"), (F.col("id") * 0.05).alias("t_sec"))
    bad = validate_predictions(p, frames).where("errors <> ''").collect()
    assert [(r["position"], r["errors"]) for r in bad] == [(7, "ttc")]


def test_header_check(spark, tmp_path):
    (tmp_path / "A.csv").write_text("﻿frame_id,timestamp,predicted_ttc\n0,0,inf\n")
    (tmp_path / "B.csv").write_text("frame_id,timestamp,timestamp,speed\n0,0,0,1\n")
    (tmp_path / "C.csv").write_text("frame_id,timestamp,predicted_ttc,ground_truth_ttc\n0,0,inf,inf\n")
    got = {r["trip_id"]: list(r["errors"]) for r in R.check_headers(spark, str(tmp_path)).collect()}
    assert got == {"A": ["bom"], "B": ["missing:predicted_ttc", "repeated", "extra:speed"], "C": []}


def test_documents_keep_nulls_and_sort_keys(spark, tmp_path):
    d = spark.createDataFrame(
        [("T", k, None if k % 2 else 1.5, [(2, None)]) for k in range(5000)], "trip_id string, frame_id bigint, min_ttc_sec double, objects array<struct<z:int,a:double>>")
    W.write_documents(d.repartition(3), str(tmp_path / "out"))
    for f in (tmp_path / "out" / "trip_id=T").glob("part-*"):
        rows = [json.loads(x) for x in f.read_text().splitlines()]
        assert [r["frame_id"] for r in rows] == sorted(r["frame_id"] for r in rows)
        assert all(list(r) == ["frame_id", "min_ttc_sec", "objects", "trip_id"] and list(r["objects"][0]) == ["a", "z"] for r in rows)
        assert all((r["min_ttc_sec"] is None) == bool(r["frame_id"] % 2) for r in rows)


def test_event_documents_pass_their_contract(spark, tmp_path):
    frames = spark.range(100).select(F.lit("T").alias("trip_id"), F.col("id").alias("frame_id"), (F.col("id") * 0.05).alias("t_sec"))
    events = spark.createDataFrame([("T", 40, 44, 1.2, "CRITICAL", 0.7, "MEDIUM"), ("T", 10, 16, 1.8, "DANGER", 1.0, "HIGH")],
                                   "trip_id string, start_frame bigint, end_frame bigint, min_ttc_sec double, severity string, event_quality double, confidence_level string")
    d = W.event_documents(events, frames, "run")
    rows = d.orderBy("start_frame").collect()
    assert [(r["event_id"], r["start_time"], r["end_time"], r["track_id"], r["clip_path"]) for r in rows] == [("run-E1", 0.5, 0.8, 0, None), ("run-E2", 2.0, 2.2, 0, None)]
    assert all(not r["violations"] for r in validate_risk_event(d).collect())
    W.write_events(d, str(tmp_path / "events"))
    text = [json.loads(x) for f in (tmp_path / "events").rglob("part-*") for x in f.read_text().splitlines()]
    assert [x["event_id"] for x in sorted(text, key=lambda x: x["start_frame"])] == ["run-E1", "run-E2"] and all("clip_path" in x for x in text)


def test_modality_prefix_is_literal(spark, tmp_path):
    for n in ("a.b12.png", "aXb13.png", "a.bno.png"):
        (tmp_path / n).write_bytes(b"x")
    assert [r["frame_id"] for r in R.list_modality_files(spark, str(tmp_path), ".png", "a.b").collect()] == [12]


def test_evidence_has_a_fixed_schema(spark, tmp_path):
    from roadrisk import schemas

    (tmp_path / "T5.csv").write_text(
        'union_predicted_ttc,frame_id,timestamp,raw_detections_json,selected_observations_json,union_selected_bbox_xyxy,note\n'
        'inf,3,0.15,"[{""bbox_xyxy"":[1,2,3,4],""class_id"":2,""class_name"":""car"",""confidence"":0.5}]","[{""timestamp"":0.1,""depth_m"":9.5,""center_x"":4,""depth_sigma_m"":0.3}]","[1,2,3,4]",x\n'
        '1.25,4,0.2,not json,[],,y\n')
    d = R.read_evidence(spark, str(tmp_path))
    assert set(d.columns) == {f.name for f in schemas.EVIDENCE_CSV.fields} - {"timestamp"} | {"t_sec", "trip_id"}
    a, b = d.orderBy("frame_id").collect()
    assert (a.trip_id, a.frame_id, a.t_sec, a.union_predicted_ttc, a.predicted_ttc) == ("T5", 3, 0.15, float("inf"), float("inf"))
    assert a.raw_detections_json[0].class_name == "car" and a.selected_observations_json[0].depth_m == 9.5 and a.union_selected_bbox_xyxy == [1, 2, 3, 4]
    assert (b.union_predicted_ttc, b.raw_detections_json, b.selected_observations_json, b.risk_track_count) == (1.25, None, [], None)


def test_perception_lines(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(
        '{"schema_version":"v","trip_id":"T","frame_id":1,"status":"valid","objects":[{"track_id":7,"bbox_xyxy":[1,2,30,40]}],"min_ttc_sec":1.5}\n'
        '{"trip_id":"T","frame_id":2,"status":"unknown","objects":[],"degraded_reasons":["frame_drop"]}\n')
    a, b = R.read_perception(spark, str(tmp_path)).orderBy("frame_id").collect()
    assert (a.box.x0, a.box.y1, a.min_ttc_sec, a.objects[0].track_id) == (1.0, 40.0, 1.5, 7)
    assert b.box is None and b.degraded_reasons == ["frame_drop"] and b.min_ttc_sec is None


def test_annotation_headers(spark, tmp_path):
    from roadrisk.constants import ANNOTATION_HEADER

    names = list(ANNOTATION_HEADER)
    for stem, header in (("good", names), ("short", names[:-1]), ("turned", [names[1], names[0], *names[2:]]), ("more", [*names, "own"])):
        (tmp_path / f"{stem}.csv").write_text(",".join(header) + "\n1\n")
    got = {r.trip_id: list(r.errors) for r in R.check_annotation_headers(spark, str(tmp_path)).collect()}
    assert got == {"good": [], "short": ["missing:annotator_notes"], "turned": ["order"], "more": ["extra:own"]}


def test_inventory_lists_events(spark):
    from roadrisk.operators.quality import audit_anomalies, trip_inventory

    frames = spark.range(40).select(F.when(F.col("id") < 20, "a").otherwise("b").alias("trip_id"), (F.col("id") % 20).alias("frame_id"),
                                    ((F.col("id") % 20) * 0.05).alias("t_sec"), F.lit(5.0).alias("min_ttc"))
    events = spark.createDataFrame([("a", 1, "brake"), ("a", 0, "cut_in"), ("a", 2, None)], "trip_id string, event_no int, type string")
    inv = trip_inventory(frames, events=events)
    assert {r.trip_id: (r.n_events, r.event_types) for r in inv.collect()} == {"a": (3, "cut_in;brake;unknown"), "b": (0, "")}
    bad = inv.withColumns({"image_size": F.when(F.col("trip_id") == "a", "640x480").otherwise("640x360"), "invalid_images": F.when(F.col("trip_id") == "b", 2).otherwise(0)})
    assert {(r.trip_id, r.category, r.detail) for r in audit_anomalies(bad).collect()} == {("a", "image_size", "640x480"), ("b", "image_decode", "2")}


def test_hash_tree_names_the_segments_that_differ(spark):
    from roadrisk.operators import quality as C

    a = spark.range(300_000).select(F.concat(F.lit("t"), F.col("id") % 3).alias("trip_id"), F.floor(F.col("id") / 3).alias("frame_id"), F.lit(1).alias("v"))
    line = F.concat_ws(",", "frame_id", "v")
    b = a.withColumn("v", F.when((F.col("trip_id") == "t1") & F.col("frame_id").isin(5, 70_000), 2).otherwise(F.col("v"))).filter("trip_id <> 't2' OR frame_id < 99000")
    got = sorted((r.trip_id, r.segment, r.in_a, r.in_b) for r in C.differing_segments(a, b, line).collect())
    # frames from 99,000 on lie in the segments from 96 on; the 97th is whole in neither
    assert got == [("t1", 0, True, True), ("t1", 68, True, True), ("t2", 96, True, True), ("t2", 97, True, False)]
    assert C.differing_segments(a, a.repartition(7), line).count() == 0
    assert [t.count() for t in C.hash_tree(a, line)] == [3 * 98, 6, 3, 3, 3]
    root = C.root_of_units(C.hash_tree(a, line)[-1]).first().h
    assert root == C.root_of_units(C.hash_tree(a.repartition(5), line)[-1]).first().h != C.root_of_units(C.hash_tree(b, line)[-1]).first().h
