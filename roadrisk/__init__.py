"""Collision-risk analytics over frame, track, detection and event tables, on Spark."""
