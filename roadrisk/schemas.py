"""Fixed schemas of the file formats read and written; nothing is inferred."""
from pyspark.sql import types as T

D, L, S, B, I = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType(), T.IntegerType()


def struct(spec):
    """``struct({'a': D, ...})`` with every field nullable."""
    return T.StructType([T.StructField(k, v, True) for k, v in spec.items()])


TARGET = struct({
    "target_id": S, "target_class": S, "rel_pos": S, "rel_velocity": S,
    "longitudinal_distance": D, "lateral_distance": D, "closing_speed": D,
    "ttc_simple": D, "ttc_2d": D, "in_collision_cone": B,
})
FRAME = struct({
    "frame_id": L, "timestamp": D,
    "ego": struct({"speed_kmh": D, "longitudinal_accel": D, "lateral_accel": D}),
    "targets": T.ArrayType(TARGET), "min_ttc": D, "headway_sec": D,
    "driver": struct({"state": S}), "behavior_flags": struct({"harsh_brake": B}),
    "risk": struct({"final_risk_score": D}),
})
TRIP = struct({
    "metadata": struct({"duration_sec": D, "fps": D, "description": S}),
    "frames": T.ArrayType(FRAME),
    "events_log": T.ArrayType(struct({"type": S, "t": D, "params": S})),
})
# TTC columns stay text: the CSV reader turns 'inf' into NULL.
PREDICTIONS_CSV = struct({"frame_id": L, "timestamp": D, "predicted_ttc": S, "ground_truth_ttc": S})
DETECTIONS_CSV = struct({
    "frame_id": L, "timestamp": D, "class_id": I, "class_name": S, "confidence": D,
    "x0": D, "y0": D, "x1": D, "y1": D,
})
CANDIDATES_CSV = struct({
    "frame_id": L, "timestamp": D, "track_id": L, "ground_truth_ttc": S, "ground_confidence": D,
    "depth_m": D, "closing_speed_mps": D, "candidate_ttc": S, "motion_residual_m": D, "confidence": D,
    "selected_center_x_norm": D, "selected_bottom_y_norm": D, "selected_width_norm": D,
    "selected_height_norm": D,
})
BOX_JSON = T.ArrayType(struct({"bbox_xyxy": T.ArrayType(D), "class_id": I, "class_name": S, "confidence": D}))
TRACK_JSON = T.ArrayType(struct({
    "track_id": L, "bbox_xyxy": T.ArrayType(D), "depth_m": D, "depth_confidence": D,
    "accepted": B, "mahalanobis_squared": D, "corridor_occupancy_probability": D,
}))
MEASUREMENT_JSON = T.ArrayType(struct({"track_id": L, "timestamp": D, "depth_m": D, "center_x": D, "depth_sigma_m": D}))
OBSERVATION_JSON = T.ArrayType(struct({"timestamp": D, "depth_m": D, "center_x": D, "depth_sigma_m": D}))
# fixed values: columns of the evidence of one frame; TTC and JSON columns are text in the file
_SELECTED = {
    "selected_track_id": L, "selected_depth_m": D, "selected_motion_residual_m": D, "selected_observation_quality": D, "selected_depth_confidence": D,
    "selected_lr_support": D, "selected_history_length": L, "selected_bbox_xyxy": S, "selected_observations_json": S}
EVIDENCE_CSV = struct({
    "frame_id": L, "timestamp": D, "input_degraded": B, "predicted_ttc": S, "classical_predicted_ttc": S, "classical_selection_confidence": D,
    "classical_selected_closing_speed_mps": D, "experimental_classical_minimum_closing_speed_mps": D, "experimental_low_ego_gate_active": B,
    "union_predicted_ttc": S, "union_source": S, "union_selection_confidence": D, "union_selected_closing_speed_mps": D, "raw_detections_json": S,
    "ground_confidence": D, "detection_count": L, "depth_valid_component_count": L, "risk_track_count": L, "selection_confidence": D,
    "selected_closing_speed_mps": D, "ego_speed_mps": D, "lateral_accel_mps2": D, "longitudinal_accel_mps2": D, "turn_association_gate_active": B,
    "classical_selected_yolo_iou": D, "classical_track_measurements_json": S, "detector_track_measurements_json": S, "v2_shadow_updates_json": S,
    "v2_event_to_ttc": S, "v2_event_match_iou": D, "v2_event_occupancy": D, "v2_event_low_occupancy_suppressed": B, "path_intersection_possible": B,
    "path_lateral_separation_m": D, "uncapped_predicted_ttc": S, "uncapped_selection_confidence": D, "uncapped_selected_closing_speed_mps": D,
    "uncapped_selected_track_id": L, **{f"{p}{k}": t for p in ("", "classical_", "union_") for k, t in _SELECTED.items()},
})
EVIDENCE_TTC = ("predicted_ttc", "classical_predicted_ttc", "union_predicted_ttc", "uncapped_predicted_ttc", "v2_event_to_ttc")
EVIDENCE_JSON = {
    "raw_detections_json": BOX_JSON, "v2_shadow_updates_json": TRACK_JSON, "classical_track_measurements_json": MEASUREMENT_JSON,
    "detector_track_measurements_json": MEASUREMENT_JSON, **{f"{p}selected_observations_json": OBSERVATION_JSON for p in ("", "classical_", "union_")},
    **{f"{p}selected_bbox_xyxy": T.ArrayType(L) for p in ("", "classical_", "union_")}}
OBJECT = struct({
    "track_id": L, "object_type": S, "bbox_xyxy": T.ArrayType(D), "detection_confidence": D, "distance_m": D,
    "closing_speed_mps": D, "ttc_sec": D, "in_collision_corridor": B, "ttc_quality": D,
})
PERCEPTION = struct({
    "schema_version": S, "run_id": S, "trip_id": S, "frame_id": L, "timestamp": D, "image_width": L, "image_height": L,
    "status": S, "objects": T.ArrayType(OBJECT), "min_ttc_sec": D, "risk_level": S, "perception_quality": D,
    "latency_ms": D, "degraded_reasons": T.ArrayType(S),
})
RUN_MANIFEST = struct({
    "schema_version": S, "run_id": S, "created_at": S, "code_commit": S, "model_version": S, "config_sha256": S,
    "dataset_id": S, "processing_mode": S, "input_features": T.ArrayType(S), "uses_future_frames": B,
    "uses_full_event_schedule": B, "depth_keyframe_policy": S, "hardware": struct({"platform": S, "accelerator": S}),
    "contract_versions": struct({"perception": S, "risk_event": S}),
})
RISK_EVENT = struct({
    "schema_version": S, "run_id": S, "event_id": S, "trip_id": S, "start_frame": L, "end_frame": L,
    "start_time": D, "end_time": D, "min_ttc_sec": D, "object_type": S, "track_id": L, "severity": S,
    "event_quality": D, "confidence_level": S, "clip_path": S,
})
