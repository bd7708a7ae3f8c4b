"""Views of the test tables in the engine's data model, for Spark and as DuckDB SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import configure

HEIGHT, STRIDE = 64, 16
TARGET_ORDER = [
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Parquet tables of one folder as attributes, and the derived views as methods."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def lines(self) -> DataFrame:
        """Events as scan lines of one source; a line number is the event id.

        The length of the one source is a single number, as the file size is for real files.
        """
        last = self.events.agg(F.max("event_id")).first()[0]
        return self.events.selectExpr(
            "'events' AS source",
            "event_id AS line",
            f"{last + 1}L AS source_lines",
            "event_type <> 'error' AS valid",
            "CAST(event_id % 16 AS INT) AS nibble",
            "value",
            "user_id",
            "user_id % 5 AS channel",
        )

    def frames(self) -> DataFrame:
        """Orders as frames with geometry, camera clock and exposure."""
        return self.orders.selectExpr(
            "'orders' AS source",
            "o_orderkey AS frame_id",
            "o_custkey",
            "o_orderstatus",
            "unix_timestamp(o_orderdate) AS camera_seconds",
            "(o_orderkey * 7919) % 1100000 AS camera_microseconds",
            "CAST(floor((o_custkey % 1000) * 12.5D) AS BIGINT) AS exposure_time_ns",
            "o_orderstatus <> 'P' AS valid",
            "concat('g', o_orderkey % 8) AS geometry_id",
            "0.5D + 0.25D * (o_orderkey % 4) AS scale_x",
            "0.5D + 0.25D * (o_custkey % 4) AS scale_y",
            "8.0D * (o_orderkey % 3) AS offset_x",
            "8.0D * (o_custkey % 3) AS offset_y",
            "4000 AS original_width",
            "4000 AS original_height",
        ).selectExpr(
            "*",
            "CAST(4000 * scale_x + 2 * offset_x AS INT) AS filter_width",
            "CAST(4000 * scale_y + 2 * offset_y AS INT) AS filter_height",
            "'sat-c.line-array' AS sensor_id",
            "'pushbroom' AS acquisition_mode",
        )

    def targets(self) -> DataFrame:
        """Line items as detection boxes in the filter plane."""
        return self.lineitem.selectExpr(
            "'orders' AS source",
            "l_orderkey AS frame_id",
            "CAST(l_partkey % 4000 AS DOUBLE) AS x_min",
            "CAST(l_suppkey % 4000 AS DOUBLE) AS y_min",
            "l_partkey % 4000 + l_quantity AS x_max",
            "l_suppkey % 4000 + l_tax * 1000 AS y_max",
            "l_suppkey % 30 AS class_index",
            "1 - l_discount AS confidence",
            *TARGET_ORDER,
        )

    def categories(self) -> DataFrame:
        return self.nation.selectExpr(
            "'nations' AS mapping_id", "CAST(n_nationkey AS BIGINT) AS class_index", "n_name AS type"
        )

    def tracks(self) -> DataFrame:
        return self.events.selectExpr(
            "'events' AS source",
            "event_id div 10 AS frame_id",
            "event_id % 10 AS place",
            "user_id AS track_id",
            "user_id % 30 AS class_index",
            "value AS x_min",
            "CAST(user_id % 100 AS DOUBLE) AS y_min",
            "value + 8 AS x_max",
            "user_id % 100 + 4.0D AS y_max",
        )

    def dense(self) -> DataFrame:
        """Line items as crowded boxes: about forty per frame at every scale but the smallest."""
        return self.lineitem.selectExpr(
            "l_orderkey % 1500 AS frame",
            "l_suppkey % 3 AS class_index",
            "l_extendedprice AS score",
            "CAST(l_partkey % 60 AS DOUBLE) AS x_min",
            "CAST(l_suppkey % 60 AS DOUBLE) AS y_min",
            "l_partkey % 60 + l_quantity AS x_max",
            "l_suppkey % 60 + l_quantity AS y_max",
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "l_quantity",
        )

    def images(self) -> DataFrame:
        """Embeddings as 8 x 8 gray images in an array column."""
        return self.embeddings.selectExpr(
            "vec_id AS frame_id",
            "transform(embedding, e -> CAST(round(255 * abs(CAST(e AS DOUBLE))) AS SMALLINT)) AS pixels",
        )

    def artifacts(self) -> DataFrame:
        return self.documents.selectExpr(
            "concat(source, '/', doc_id) AS path",
            "CAST(length(text) AS BIGINT) AS size_bytes",
            "sha2(text, 256) AS sha256",
            "doc_id",
            "text",
            "source",
        )


# DuckDB twins of the views above. Later views may use earlier ones.
VIEWS = {
    "lines": """
        SELECT 'events' AS source, event_id AS line, event_type <> 'error' AS valid,
               (event_id % 16)::INT AS nibble, value, user_id, user_id % 5 AS channel,
               (SELECT max(event_id) + 1 FROM events) AS source_lines
        FROM events""",
    "win": f"""
        SELECT l.*, w.frame_id FROM lines l,
          LATERAL (SELECT unnest(range(greatest(0, floor((l.line - {HEIGHT}) / {STRIDE}.0)::BIGINT + 1),
                                       l.line // {STRIDE} + 1)) AS frame_id) w""",
    "frames": """
        SELECT *, (4000 * scale_x + 2 * offset_x)::INT AS filter_width,
               (4000 * scale_y + 2 * offset_y)::INT AS filter_height
        FROM (SELECT o_orderkey AS frame_id, o_custkey, o_orderstatus,
                     epoch(o_orderdate)::BIGINT AS camera_seconds,
                     (o_orderkey * 7919) % 1100000 AS camera_microseconds,
                     floor((o_custkey % 1000) * 12.5::DOUBLE)::BIGINT AS exposure_time_ns,
                     o_orderstatus <> 'P' AS valid, 'g' || (o_orderkey % 8) AS geometry_id,
                     0.5::DOUBLE + 0.25::DOUBLE * (o_orderkey % 4) AS scale_x,
                     0.5::DOUBLE + 0.25::DOUBLE * (o_custkey % 4) AS scale_y,
                     8.0::DOUBLE * (o_orderkey % 3) AS offset_x, 8.0::DOUBLE * (o_custkey % 3) AS offset_y,
                     4000 AS original_width, 4000 AS original_height
              FROM orders)""",
    "targets": f"""
        SELECT l_orderkey AS frame_id, (l_partkey % 4000)::DOUBLE AS x_min, (l_suppkey % 4000)::DOUBLE AS y_min,
               l_partkey % 4000 + l_quantity AS x_max, l_suppkey % 4000 + l_tax * 1000 AS y_max,
               l_suppkey % 30 AS class_index, 1 - l_discount AS confidence,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(TARGET_ORDER)}) - 1 AS target_index,
               count(*) OVER (PARTITION BY l_orderkey) AS n_targets
        FROM lineitem""",
    "categories": """
        SELECT 'nations' AS mapping_id, n_nationkey::BIGINT AS class_index, n_name AS type FROM nation""",
    "tracks": """
        SELECT event_id // 10 AS frame_id, event_id % 10 AS place, user_id AS track_id, user_id % 30 AS class_index,
               value AS x_min, (user_id % 100)::DOUBLE AS y_min, value + 8 AS x_max, user_id % 100 + 4.0::DOUBLE AS y_max
        FROM events""",
    "mapped": """
        SELECT t.*, f.geometry_id, f.filter_width, f.filter_height, f.original_width, f.original_height,
               (t.x_min - f.offset_x) / f.scale_x AS ox_min, (t.y_min - f.offset_y) / f.scale_y AS oy_min,
               (t.x_max - f.offset_x) / f.scale_x AS ox_max, (t.y_max - f.offset_y) / f.scale_y AS oy_max
        FROM targets t JOIN frames f USING (frame_id)""",
    "good": """
        SELECT m.*, c.mapping_id, c.type FROM mapped m JOIN categories c USING (class_index)
        WHERE m.n_targets <= 256 AND m.confidence BETWEEN 0 AND 1
          AND m.x_min >= 0 AND m.y_min >= 0 AND m.x_max <= m.filter_width AND m.y_max <= m.filter_height
          AND m.x_min < m.x_max AND m.y_min < m.y_max
          AND m.ox_min >= 0 AND m.oy_min >= 0 AND m.ox_max <= m.original_width AND m.oy_max <= m.original_height
          AND m.ox_min < m.ox_max AND m.oy_min < m.oy_max""",
    "dense": """
        SELECT l_orderkey % 1500 AS frame, l_suppkey % 3 AS class_index, l_extendedprice AS score,
               (l_partkey % 60)::DOUBLE AS x_min, (l_suppkey % 60)::DOUBLE AS y_min,
               l_partkey % 60 + l_quantity AS x_max, l_suppkey % 60 + l_quantity AS y_max,
               l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity
        FROM lineitem""",
    "pixels": """
        SELECT vec_id AS frame_id, (i // 8)::BIGINT AS y, (i % 8)::BIGINT AS x,
               round(255 * abs(embedding[i + 1]::DOUBLE))::SMALLINT AS v
        FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS i)""",
    "artifacts": """
        SELECT source || '/' || doc_id AS path, length(text)::BIGINT AS size_bytes, sha256(text) AS sha256,
               doc_id, text, source
        FROM documents""",
}


def with_views(names: str, body: str) -> str:
    """SQL text with the named views (space separated, in dependency order) in front."""
    parts = [f"{name} AS ({VIEWS[name]})" for name in names.split()]
    return f"WITH {', '.join(parts)}{body if body.startswith(',') else ' ' + body}" if parts else body


def recipe(name: str, oracle: str | None = None, views: str = ""):
    """Register a query and, where SQL can express it, its oracle."""

    def add(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(views, oracle)
        return function

    return add
