"""Results depend on them, so they are stated once, here."""

INF = float("inf")

# --- fixed values: time-to-collision thresholds (seconds) -------------------
DANGER_TTC = 2.0
CRITICAL_ZONE_TTC = 3.0
SEVERE_TTC = 1.5
INF_AS_SECONDS = 99.0
MIN_TTC_FOR_INVERSE = 0.1

# --- fixed values: sampling, ranges, image ---------------------------------
FRAME_PERIOD_S = 0.05
MIN_DEPTH_M = 1.5
MAX_DEPTH_M = 80.0
DEPTH_SENTINEL_M = 999.0
MIN_CLOSING_MPS = 0.3
IMAGE_WIDTH = 640
IMAGE_HEIGHT = 360
PATH_HALF_WIDTH_M = 1.75

# --- fixed values: detector classes kept as road users ----------------------
ROAD_USER_CLASSES = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}

# --- fixed values: the guard in use and the scale of one step per dimension --
CURRENT_GUARD = {
    "corridor_top_width": 0.10,
    "corridor_bottom_width": 0.50,
    "minimum_bottom": 0.50,
    "minimum_height": 0.05,
    "minimum_confidence": 0.75,
    "maximum_closing_speed_mps": 20.0,
    "maximum_depth_m": 20.0,
    "maximum_motion_residual_m": 0.8,
}
GUARD_SCALE = {
    "corridor_top_width": 0.02,
    "corridor_bottom_width": 0.05,
    "minimum_bottom": 0.05,
    "minimum_height": 0.02,
    "minimum_confidence": 0.05,
    "maximum_closing_speed_mps": 5.0,
    "maximum_depth_m": 5.0,
    "maximum_motion_residual_m": 0.3,
}
GUARD_AXES = {
    "corridor": ((0.10, 0.50), (0.12, 0.50), (0.12, 0.55), (0.16, 0.55)),
    "minimum_bottom": (0.45, 0.50, 0.55),
    "minimum_height": (0.03, 0.05, 0.08),
    "minimum_confidence": (0.70, 0.75, 0.80),
    "maximum_closing_speed_mps": (15.0, 20.0, 25.0),
    "maximum_depth_m": (15.0, 20.0, 25.0),
    "maximum_motion_residual_m": (0.5, 0.8, 1.1),
}
MINIMUM_COMPOSITE = 28.7

SEMANTIC_AXES = {
    "score_threshold": (0.20, 0.25, 0.30),
    "misses": (2, 3, 4),
    "fallback_depth_m": (4.0, 5.0, 6.0),
}
SEMANTIC_MINIMUM_COMPOSITE = 38.4

# --- fixed values: debounce presets ----------------------------------------
# (danger entry, critical entry, danger exit, attentive entry, attentive exit, event merge gap)
RISK_PRESETS = {
    "raw": (1, 1, 1, 1, 1, 0),
    "debounce_2": (2, 2, 2, 2, 3, 2),
    "recommended": (3, 2, 3, 2, 4, 4),
    "strict_4": (4, 2, 3, 2, 4, 4),
}
DEFAULT_PRESET = "recommended"

# --- our own choice: rows of a trip that one task handles at a time ---------
SEGMENT_ROWS = 1024

# fixed values: header of an annotation file, in its order
ANNOTATION_HEADER = (
    "frame_id", "track_id", "overlay_box_index", "depth_m", "candidate_ttc", "ground_truth_ttc", "ground_confidence", "closing_speed_mps", "motion_residual_m",
    "yolo_matched_class", "yolo_matched_confidence", "iou", "semantic_score", "misses", "selected_center_x_norm", "selected_bottom_y_norm",
    "selected_width_norm", "selected_height_norm", "is_gt_danger_frame", "label", "annotator_notes")
