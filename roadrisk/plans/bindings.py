"""Driving tables derived from the star-schema test tables.

One SQL text per table, valid in Spark and in DuckDB, so that both engines start from
identical rows. ``pixels`` alone differs, because array explosion is spelled differently.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from roadrisk.operators.lineage import shared

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

BINDINGS: dict[str, str] = {}

BINDINGS["frames"] = """
SELECT concat('T', CAST(o_orderkey % 6 AS STRING)) AS trip_id,
       CAST(floor(o_orderkey / 6) AS BIGINT) AS frame_id,
       floor(o_orderkey / 6) * 5e-2 AS t_sec,
       CASE WHEN (CAST(floor(o_orderkey / 30) AS BIGINT) * 7919 + (o_orderkey % 6) * 1009) % 1000 < 500
            THEN ((CAST(floor(o_orderkey / 30) AS BIGINT) * 7919 + (o_orderkey % 6) * 1009) % 1000) / 1e2
                 + (o_custkey % 10) / 1e2
            ELSE CAST('inf' AS DOUBLE) END AS min_ttc,
       (o_custkey % 90) / 36e-1 AS speed_mps,
       ((o_custkey % 21) - 10) / 1e1 AS lateral_accel,
       CAST(o_custkey AS BIGINT) AS k
FROM orders"""

BINDINGS["predictions"] = """
SELECT trip_id, frame_id, t_sec, min_ttc,
       CASE WHEN (frame_id * 31 + k) % 10 = 0 THEN CAST('inf' AS DOUBLE)
            WHEN (frame_id * 31 + k) % 10 = 1 THEN 12e-1
            ELSE greatest(5e-2, min_ttc + ((k % 41) - 20) / 5e1) END AS classical_ttc,
       CASE WHEN (frame_id * 17 + k) % 8 = 0 THEN CAST('inf' AS DOUBLE)
            WHEN (frame_id * 17 + k) % 8 = 1 THEN 15e-1
            ELSE greatest(5e-2, min_ttc + ((k % 29) - 14) / 5e1) END AS detector_ttc
FROM frames"""

BINDINGS["candidates"] = """
SELECT trip_id, frame_id, ordinal, track_id, center_x, bottom_y, width, height, confidence,
       closing_mps, depth_m, residual_m,
       CASE WHEN closing_mps > 3e-1 THEN depth_m / closing_mps ELSE CAST('inf' AS DOUBLE) END AS candidate_ttc
FROM (SELECT concat('T', CAST(l_orderkey % 6 AS STRING)) AS trip_id,
       CAST(floor(l_orderkey / 6) AS BIGINT) AS frame_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS ordinal,
       CAST(l_linenumber AS BIGINT) AS track_id,
       3e-1 + (l_suppkey % 41) / 1e2 AS center_x,
       4e-1 + (l_partkey % 61) / 1e2 AS bottom_y,
       2e-2 + (l_suppkey % 20) / 1e2 AS width,
       2e-2 + (l_partkey % 15) / 1e2 AS height,
       6e-1 + l_tax * 5 AS confidence,
       l_discount * 200 - 2 AS closing_mps,
       15e-1 + l_quantity * 6e-1 AS depth_m,
       (l_partkey % 20) / 1e1 AS residual_m
FROM lineitem) x"""

BINDINGS["detections"] = """
SELECT concat('T', CAST(l_orderkey % 6 AS STRING)) AS trip_id,
       CAST(floor(l_orderkey / 6) AS BIGINT) AS frame_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS ordinal,
       CASE l_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 5
            WHEN 5 THEN 7 ELSE 9 END AS class_id,
       3e-1 + l_tax * 8 AS confidence,
       (3e-1 + (l_suppkey % 37) / 1e2) * 640 - l_quantity AS x0,
       (4e-1 + (l_partkey % 53) / 1e2) * 360 - l_quantity AS y0,
       (3e-1 + (l_suppkey % 37) / 1e2) * 640 + l_quantity AS x1,
       (4e-1 + (l_partkey % 53) / 1e2) * 360 AS y1
FROM lineitem"""

BINDINGS["stream_frames"] = """
SELECT concat('U', CAST(user_id AS STRING)) AS trip_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_id,
       ts AS event_time,
       CASE WHEN value < 60 THEN value / 15e0 ELSE CAST('inf' AS DOUBLE) END AS ttc,
       event_type <> 'error' AS reliable,
       15e-1 + value / 1e1 AS depth_m
FROM events"""

BINDINGS["track_labels"] = """
SELECT concat('T', CAST(l.doc_id % 6 AS STRING)) AS trip_id,
       CAST(floor(l.doc_id / 6) AS BIGINT) AS frame_id,
       CAST(1 + l.doc_id % 7 AS BIGINT) AS track_id,
       CASE WHEN l.doc_id % 5 = 0 THEN 'adjacent' WHEN l.doc_id % 5 = 1 THEN 'diverging'
            ELSE 'on_path' END AS path_relation,
       CASE WHEN l.toxic = 1 THEN 'association_failure' WHEN l.quality = 1 THEN 'stereo_noise'
            ELSE 'genuine_miss' END AS label,
       d.n_chars / 1e3 AS cpa_distance_m
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""

BINDINGS["runtime"] = """
SELECT concat('T', CAST(l_orderkey % 6 AS STRING)) AS trip_id,
       CAST(floor(l_orderkey / 6) AS BIGINT) AS frame_id,
       CAST(l_linenumber AS BIGINT) AS repeat,
       CAST(l_quantity AS DOUBLE) AS compute_ms,
       l_tax * 1000 AS tracking_ms,
       l_discount * 1000 AS read_ms
FROM lineitem"""

_PIXELS_SPARK = """
SELECT CAST(floor(vec_id / 50) AS BIGINT) AS frame_id, CAST(vec_id % 50 AS BIGINT) AS row_no,
       CAST(pos AS BIGINT) AS col_no, abs(CAST(e AS DOUBLE)) * 100 AS disparity, label
FROM embeddings LATERAL VIEW posexplode(embedding) p AS pos, e"""

_PIXELS_DUCKDB = """
SELECT CAST(floor(vec_id / 50) AS BIGINT) AS frame_id, CAST(vec_id % 50 AS BIGINT) AS row_no,
       CAST(pos - 1 AS BIGINT) AS col_no, abs(CAST(embedding[pos] AS DOUBLE)) * 100 AS disparity, label
FROM (SELECT vec_id, embedding, label, unnest(generate_series(1, len(embedding))) AS pos
      FROM embeddings)"""

DERIVED = list(BINDINGS) + ["pixels"]


def oracle_text(name: str) -> str:
    return _PIXELS_DUCKDB if name == "pixels" else BINDINGS[name]


def with_bindings(sql: str) -> str:
    """Prepend, as CTEs, the derived tables that the oracle text mentions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in DERIVED:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(oracle_text(name))
                needed.append(name)

    visit(sql)
    ctes = [f"{n} AS ({oracle_text(n).strip()})" for n in needed]
    return ctes, sql


class Tables:
    """Lazy access to the base and derived tables below one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = self._load(name)
        return self._seen[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        text = _PIXELS_SPARK if name == "pixels" else BINDINGS[name]
        parents = [p for p in BASE_TABLES + DERIVED if p != name and re.search(rf"\b{p}\b", text)]
        for parent in parents:
            text = re.sub(rf"(FROM|JOIN) {parent}\b", rf"\1 {{{parent}}}", text)
        return self.spark.sql(text, **{p: getattr(self, p) for p in parents})

    @property
    def framed(self) -> "FramedTables":
        """The same tables, dealt by frame."""
        return FramedTables(self.spark, self.folder)


_TRIP_OF = "concat('T', CAST(l_orderkey % 6 AS STRING)) AS trip_id"
_FRAME_OF = "CAST(floor(l_orderkey / 6) AS BIGINT) AS frame_id"
_LINE = "l_linenumber l_partkey l_suppkey l_extendedprice l_shipdate l_quantity l_discount l_tax".split()


class FramedTables(Tables):
    """candidates and detections from one shuffle of their lines by (trip, frame): what follows by frame
    finds the rows in place. An order is a frame of a trip, so its lines are numbered as the frame's."""

    def _load(self, name: str) -> DataFrame:
        if name == "lines":
            return shared(super()._load("lineitem").selectExpr(_TRIP_OF, _FRAME_OF, *_LINE), "trip_id", "frame_id")
        if name not in ("candidates", "detections"):
            return super()._load(name)
        text = BINDINGS[name]
        for a, b in ((_TRIP_OF, "trip_id"), (_FRAME_OF, "frame_id"), ("PARTITION BY l_orderkey", "PARTITION BY trip_id, frame_id"), ("FROM lineitem", "FROM {lines}")):
            if a not in text:
                raise ValueError(f"{name} has no {a}")
            text = text.replace(a, b)
        return self.spark.sql(text, lines=self.lines)
