"""All registered queries; importing the modules registers them."""
import importlib

MODULES = ["score_queries", "event_queries", "geometry_queries", "sweep_queries", "motion_queries", "audit_queries", "pixel_queries", "quality_queries", "model_queries"]

for _m in MODULES:
    importlib.import_module(f"roadrisk.plans.{_m}")

from roadrisk.plans.registry import ORACLES, QUERIES  # noqa: E402,F401
