"""Validation rules over the test tables (inventory section C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions.boxes import Box, Geometry
from framelake.functions.names import valid_digest
from framelake.operators import rules
from framelake.operators.artifacts import reconcile
from framelake.operators.lookup import unknown_classes
from framelake.operators.requests import exact_keys, validate_requests
from framelake.operators.tiles import detector_rows
from framelake.operators.windows import assign_frames, contiguity, window_summary
from framelake.recipes.decode import RAW_TARGETS, TARGET_ID, TARGET_ID_SQL
from framelake.recipes.tables import HEIGHT, STRIDE, Tables, recipe
from framelake.session import scratch_path
from framelake.sources import config


@recipe("c1_line_magic", "SELECT line, value FROM lines WHERE valid", "lines")
def line_magic(t: Tables):
    return t.lines().where("valid").select("line", "value")


@recipe(
    "c2_complete_groups",
    f"""SELECT frame_id, line FROM win
        WHERE valid AND nibble = 0 AND line + 16 <= least(frame_id * {STRIDE} + {HEIGHT}, source_lines)""",
    "lines win",
)
def complete_groups(t: Tables):
    starts = t.lines().where("valid AND nibble = 0 AND line + 16 <= source_lines").select("line")
    return assign_frames(starts, HEIGHT, STRIDE).where(f"line + 16 <= frame_id * {STRIDE} + {HEIGHT}").select("frame_id", "line")


@recipe(
    "c3_box_rule",
    f"SELECT {TARGET_ID_SQL}, CASE WHEN NOT (x_min < x_max AND y_min < y_max) THEN 'box' END AS failed_rule FROM {RAW_TARGETS} t",
)
def box_rule(t: Tables):
    return rules.flag(t.targets(), [rules.box_rule(Box.of())]).select(*TARGET_ID, "failed_rule")


@recipe(
    "c4_scale_rule",
    """SELECT frame_id, CASE WHEN scale_x - 0.5 <= 0 OR scale_y - 0.75 <= 0 OR frame_id % 13 = 0 THEN 'scale' END AS failed_rule
       FROM frames""",
    "frames",
)
def scale_rule(t: Tables):
    spoiled = t.frames().withColumns(
        {
            "scale_x": F.col("scale_x") - 0.5,
            "scale_y": F.col("scale_y") - 0.75,
            "offset_x": F.when(F.col("frame_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("offset_x")),
        }
    )
    checks = rules.geometry_rules(Geometry.of(), F.col("geometry_id"))
    return rules.flag(spoiled, checks).select("frame_id", "failed_rule")


@recipe(
    "c5_geometry_rules",
    """SELECT p_partkey, CASE WHEN p_size - 5 < 1 THEN 'plane_size'
               WHEN NOT regexp_full_match(p_name, '[A-Za-z0-9._-]+') OR length(p_name) >= 64 THEN 'geometry_id' END AS failed_rule
       FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_')
                    WHEN p_partkey % 3 = 1 THEN repeat('a', 60 + p_size % 8) ELSE p_name END AS p_name FROM part)""",
)
def geometry_rules(t: Tables):
    parts = t.part.selectExpr(
        "p_partkey",
        """CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_')
                WHEN p_partkey % 3 = 1 THEN repeat('a', 60 + p_size % 8) ELSE p_name END AS geometry_id""",
        "1.0D AS scale_x", "1.0D AS scale_y", "0.0D AS offset_x", "0.0D AS offset_y",
        "p_size - 5 AS original_width", "p_size AS original_height", "p_size AS filter_width", "p_size AS filter_height",
    )
    checks = rules.geometry_rules(Geometry.of(), F.col("geometry_id"))
    return rules.flag(parts, checks).select("p_partkey", "failed_rule")


@recipe(
    "c6_confidence_rule",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 12 BETWEEN 0 AND 1 THEN NULL ELSE 'confidence' END AS failed_rule
       FROM lineitem""",
)
def confidence_rule(t: Tables):
    return rules.flag(t.lineitem, [rules.confidence_rule(F.col("l_discount") * 12)]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "failed_rule"
    )


@recipe(
    "c7_target_limit",
    "SELECT l_orderkey AS frame_id, count(*) AS n_targets FROM lineitem GROUP BY 1 HAVING count(*) > 4",
)
def target_limit(t: Tables):
    return rules.crowded_frames(t.targets(), ["frame_id"], limit=4)


@recipe(
    "c8_schema_version",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 1 THEN 'schema_version' END AS failed_rule FROM orders",
)
def schema_version(t: Tables):
    return rules.flag(t.orders, [rules.version_rule(F.col("o_orderkey") % 6)]).select("o_orderkey", "failed_rule")


@recipe(
    "c9_single_record",
    """SELECT l_orderkey AS frame_id, l_linenumber AS kind, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def single_record(t: Tables):
    records = t.lineitem.select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("kind"))
    return rules.repeated(records, ["frame_id", "kind"])


PLANE_SQL = """
    SELECT frame_id, target_index, CASE
      WHEN NOT (x_min >= 0 AND y_min >= 0 AND x_max <= filter_width AND y_max <= filter_height AND x_min < x_max AND y_min < y_max)
        THEN 'filter_plane'
      WHEN NOT (ox_min >= 0 AND oy_min >= 0 AND ox_max <= original_width AND oy_max <= original_height
                AND ox_min < ox_max AND oy_min < oy_max) THEN 'original_plane' END AS failed_rule FROM mapped"""


def _planes(t: Tables):
    from framelake.operators.targets import ordinal_targets
    from framelake.recipes.tables import TARGET_ORDER

    placed = ordinal_targets(t.targets(), ["frame_id"], TARGET_ORDER)
    joined = placed.join(t.frames().select("frame_id", *Geometry._fields), "frame_id")
    return rules.flag(joined, rules.plane_rules(Box.of(), Geometry.of())).select("frame_id", "target_index", "failed_rule")


@recipe("c10_filter_plane", f"SELECT * FROM ({PLANE_SQL}) WHERE failed_rule = 'filter_plane'", "frames targets mapped")
def filter_plane(t: Tables):
    return _planes(t).where("failed_rule = 'filter_plane'")


@recipe(
    "c11_original_plane",
    f"SELECT * FROM ({PLANE_SQL}) WHERE failed_rule IS DISTINCT FROM 'filter_plane'",
    "frames targets mapped",
)
def original_plane(t: Tables):
    return _planes(t).where("NOT (failed_rule <=> 'filter_plane')")


@recipe(
    "c12_plane_match",
    """SELECT frame_id, CASE WHEN filter_width <> 4000 OR filter_height <> 4000 THEN 'plane_match' END AS failed_rule FROM frames""",
    "frames",
)
def plane_match(t: Tables):
    return rules.flag(t.frames(), [rules.plane_match_rule(Geometry.of(), F.lit(4000), F.lit(4000))]).select("frame_id", "failed_rule")


@recipe(
    "c13_single_role",
    """WITH d AS (SELECT DISTINCT CASE WHEN l_returnflag = 'A' THEN l_orderkey ELSE -l_orderkey END AS frame_id FROM lineitem),
            t AS (SELECT DISTINCT CASE WHEN event_type = 'view' THEN event_id ELSE -event_id - 1 END AS frame_id FROM events),
            f AS (SELECT o_orderkey AS frame_id FROM orders UNION SELECT frame_id FROM d UNION SELECT frame_id FROM t)
       SELECT frame_id, d.frame_id IS NOT NULL AS has_detection, t.frame_id IS NOT NULL AS has_tracking
       FROM f LEFT JOIN d USING (frame_id) LEFT JOIN t USING (frame_id) WHERE (d.frame_id IS NULL) = (t.frame_id IS NULL)""",
)
def single_role(t: Tables):
    frames = t.orders.selectExpr("o_orderkey AS frame_id")
    detections = t.lineitem.selectExpr("if(l_returnflag = 'A', l_orderkey, -l_orderkey) AS frame_id")
    tracks = t.events.selectExpr("if(event_type = 'view', event_id, -event_id - 1) AS frame_id")
    return rules.role_conflicts(frames, detections, tracks, ["frame_id"])


@recipe(
    "c14_role_matches_mode",
    """SELECT o_orderkey, CASE WHEN (o_orderpriority < '3') <> (o_orderstatus = 'O') THEN 'role'
              WHEN o_orderkey % 10 = 0 THEN 'telemetry' END AS failed_rule FROM orders""",
)
def role_matches_mode(t: Tables):
    mode = F.when(F.col("o_orderpriority") < "3", "pushbroom").otherwise("stare")
    checks = rules.role_rules(mode, F.col("o_orderstatus") == "O", F.col("o_orderkey") % 10 != 0)
    return rules.flag(t.orders, checks).select("o_orderkey", "failed_rule")


@recipe(
    "c15_camera_clock",
    "SELECT frame_id, CASE WHEN NOT valid OR camera_microseconds > 999999 THEN 'camera_clock' END AS failed_rule FROM frames",
    "frames",
)
def camera_clock(t: Tables):
    return rules.flag(t.frames(), [rules.clock_rule(F.col("valid"), F.col("camera_microseconds"))]).select("frame_id", "failed_rule")


@recipe(
    "c16_contiguity",
    """SELECT event_type AS source, min(id) AS first_id, max(id) AS last_id, count(DISTINCT id) AS n_ids, count(*) AS n_rows,
              min(id) = 0 AND max(id) = count(DISTINCT id) - 1 AND count(*) = count(DISTINCT id) AS contiguous
       FROM (SELECT event_type, event_id AS id FROM events UNION ALL SELECT 'all', event_id FROM events
             UNION ALL SELECT 'twice', event_id // 2 FROM events) GROUP BY 1""",
)
def contiguous(t: Tables):
    ids = (
        t.events.selectExpr("event_type AS source", "event_id AS frame_id")
        .unionByName(t.events.selectExpr("'all' AS source", "event_id AS frame_id"))
        .unionByName(t.events.selectExpr("'twice' AS source", "event_id div 2 AS frame_id"))
    )
    return contiguity(ids)


@recipe(
    "c17_duplicate_tracks",
    "SELECT frame_id, track_id, count(*) AS copies FROM tracks GROUP BY 1, 2 HAVING count(*) > 1",
    "tracks",
)
def duplicate_tracks(t: Tables):
    return rules.repeated(t.tracks(), ["frame_id", "track_id"])


@recipe("c18_known_class", "SELECT class_index, count(*) AS n FROM targets WHERE class_index >= 25 GROUP BY 1", "targets")
def known_class(t: Tables):
    return unknown_classes(t.targets(), t.categories()).groupBy("class_index").agg(F.count(F.lit(1)).alias("n"))


@recipe(
    "c19_detector_rows",
    f"""SELECT {TARGET_ID_SQL}, class_index - 1 AS class_index, greatest(0.0, x_min - 9) AS x_min, greatest(0.0, y_min - 9) AS y_min,
               least(150.0::DOUBLE, x_max) AS x_max, least(60.0::DOUBLE, y_max) AS y_max
        FROM (SELECT l_orderkey AS frame_id, l_linenumber, l_partkey, l_suppkey, (l_partkey % 4000)::DOUBLE AS x_min,
                (l_suppkey % 4000)::DOUBLE AS y_min, l_partkey % 4000 + l_quantity AS x_max, l_suppkey % 4000 + l_tax * 1000 AS y_max,
                l_suppkey % 30 AS class_index, l_discount FROM lineitem) t
        WHERE class_index - 1 >= 0 AND l_discount * 12 BETWEEN 0 AND 1
          AND greatest(0.0, x_min - 9) < least(150.0, x_max) AND greatest(0.0, y_min - 9) < least(60.0, y_max)""",
)
def detector_filter(t: Tables):
    raw = t.targets().withColumns(
        {
            "class_index": F.col("class_index") - 1,
            "confidence": F.col("l_discount") * 12,
            "x_min": F.col("x_min") - 9,
            "y_min": F.col("y_min") - 9,
        }
    )
    return detector_rows(raw, F.lit(150), F.lit(60)).select(*TARGET_ID, "class_index", *Box._fields)


def _manifest(t: Tables):
    """Expected artifacts: some missing, some with another size or digest, some extra."""
    return t.artifacts().selectExpr(
        "CASE WHEN doc_id % 17 = 0 THEN concat(path, '.old') ELSE path END AS path",
        "size_bytes + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size_bytes",
        "CASE WHEN doc_id % 11 = 0 THEN reverse(sha256) ELSE sha256 END AS sha256",
    )


MANIFEST_SQL = """
    manifest AS (SELECT CASE WHEN doc_id % 17 = 0 THEN path || '.old' ELSE path END AS path,
                        size_bytes + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size_bytes,
                        CASE WHEN doc_id % 11 = 0 THEN reverse(sha256) ELSE sha256 END AS sha256 FROM artifacts),
    matched AS (SELECT coalesce(m.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unexpected'
                  WHEN m.size_bytes <> a.size_bytes THEN 'size' WHEN m.sha256 <> a.sha256 THEN 'digest' ELSE 'ok' END AS status
                FROM manifest m FULL JOIN artifacts a ON a.path = m.path)"""


@recipe("c20_artifact_size", f", {MANIFEST_SQL} SELECT path, status FROM matched WHERE status IN ('missing', 'size')", "artifacts")
def artifact_size(t: Tables):
    return reconcile(_manifest(t), t.artifacts()).where("status IN ('missing', 'size')").select("path", "status")


@recipe(
    "c21_digest_form",
    """SELECT doc_id, regexp_full_match(d, '[0-9a-f]{64}') AS well_formed FROM
       (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) ELSE substr(sha256(text), 2) END AS d FROM documents)""",
)
def digest_form(t: Tables):
    digest = F.expr(
        "CASE doc_id % 3 WHEN 0 THEN sha2(text, 256) WHEN 1 THEN upper(sha2(text, 256)) ELSE substr(sha2(text, 256), 2) END"
    )
    return t.documents.select("doc_id", valid_digest(digest).alias("well_formed"))


@recipe(
    "c22_digest_equal",
    f", {MANIFEST_SQL} SELECT path, status FROM matched WHERE status IN ('digest', 'ok')",
    "artifacts",
)
def digest_equal(t: Tables):
    return reconcile(_manifest(t), t.artifacts()).where("status IN ('digest', 'ok')").select("path", "status")


@recipe(
    "c23_exact_keys",
    """SELECT event_id, event_id % 5 = 0 OR event_id % 5 = 4 AS exact FROM events""",
)
def key_set(t: Tables):
    document = F.expr(
        """CASE event_id % 5 WHEN 0 THEN replace(props, '}', ', "frame_id": 1}') WHEN 1 THEN props
             WHEN 2 THEN replace(props, '}', ', "frame_id": 1, "x": {"k": 2}}') WHEN 3 THEN '[1]'
             ELSE concat('{"frame_id": null, "k": [', event_id, ']}') END"""
    )
    return t.events.select("event_id", exact_keys(document, ("k", "frame_id")).alias("exact"))


@recipe(
    "c24_frame_limit",
    """SELECT user_id AS source, count(*) AS frame_count, count(*) > 200 AS over_limit FROM events GROUP BY 1""",
)
def frame_limit(t: Tables):
    return rules.over_frame_limit(t.events.selectExpr("user_id AS source"), ["source"], 200)


@recipe(
    "c25_run_status",
    """SELECT c_custkey AS source, count(o_orderkey) AS frame_count, CASE WHEN count(o_orderkey) > 20 THEN 'failed'
              WHEN count(o_orderkey) = 0 THEN 'no_result' ELSE 'completed' END AS status
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def run_status(t: Tables):
    counted = t.orders.groupBy(F.col("o_custkey").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    runs = t.customer.selectExpr("c_custkey AS source").join(counted, "source", "left")
    count = F.coalesce("n", F.lit(0))
    return runs.select("source", count.alias("frame_count"), rules.run_status(count, count > 20).alias("status"))


@recipe(
    "c26_record_counts",
    """SELECT (SELECT count(*) FROM orders) AS frames, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS records,
              (SELECT count(*) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS reconciled""",
)
def record_counts(t: Tables):
    frames = t.orders.agg(F.count(F.lit(1)).alias("frames"))
    records = t.lineitem.groupBy("l_orderkey").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("records"))
    # Both sides are one row each, so this pairing is one row.
    both = frames.withColumn("k", F.lit(1)).join(records.withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("reconciled", F.col("frames") == F.col("records"))


@recipe("c27_output_exists", "SELECT o_orderstatus AS status, count(*) AS n, true AS second_write_refused FROM orders GROUP BY 1")
def output_exists(t: Tables):
    """A product path that exists is refused; the first product stays as it was."""
    from pyspark.errors import AnalysisException

    path = scratch_path(t.spark, "product")
    product = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    product.write.mode("errorifexists").parquet(path)
    try:
        product.write.mode("errorifexists").parquet(path)
        refused = False
    except AnalysisException:
        refused = True
    return t.spark.read.parquet(path).withColumn("second_write_refused", F.lit(refused))


@recipe(
    "c28_empty_window",
    """SELECT line // 4 AS frame_id, count(*) AS n_lines FROM lines GROUP BY 1 HAVING count_if(valid) = 0""",
    "lines",
)
def empty_window(t: Tables):
    return rules.empty_windows(window_summary(t.lines(), 4, 4, F.col("value"))).select("frame_id", "n_lines")


@recipe("c29_channel", "SELECT line, CASE WHEN channel <> 0 THEN 'channel' END AS failed_rule FROM lines", "lines")
def channel(t: Tables):
    return rules.flag(t.lines(), [rules.channel_rule(F.col("channel"))]).select("line", "failed_rule")


@recipe(
    "c30_tile_size",
    "SELECT p_partkey, CASE WHEN p_size * 40 < 640 OR p_partkey < 640 THEN 'tile_size' END AS failed_rule FROM part",
)
def tile_size(t: Tables):
    return rules.flag(t.part, [rules.tile_rule(F.col("p_size") * 40, F.col("p_partkey"), 640)]).select("p_partkey", "failed_rule")


# Requests carry one defect each, chosen by o_orderkey % 40; the expected rule follows from it.
PROFILES_JSON = """concat('{"schema_version":"1.0","profiles":{"n', n_nationkey, '.push":{"sensor_id":"s', n_nationkey,
    '","acquisition_mode":"pushbroom","evidence_class":"', CASE WHEN n_regionkey = 0 THEN 'synthetic' ELSE 'development' END,
    '","max_frames":64,"filter":{"role":"detection"}},"n', n_nationkey, '.stare":{"sensor_id":"s', n_nationkey,
    '","acquisition_mode":"stare","max_frames":64,"filter":{"role":"tracking"}},"n', n_nationkey,
    '.text":{"sensor_id":"s', n_nationkey, '","acquisition_mode":"pushbroom","output_mode":"product_text","max_frames":8',
    CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE ',"filter_backend":"mock"' END,
    CASE WHEN n_nationkey % 5 = 1 THEN '' ELSE ',"geometry":{"factory":"normalise"}' END,
    CASE WHEN n_nationkey % 5 = 2 THEN '' ELSE ',"category_map":"m"' END,
    ',"filter":{"role":"', CASE WHEN n_nationkey % 5 = 3 THEN 'parse' ELSE 'detection' END, '"}},"n', n_nationkey,
    '.ground":{"sensor_id":"s', n_nationkey, '","acquisition_mode":"pushbroom","output_mode":"ground_nav","max_frames":64,"filter":{"role":"',
    CASE WHEN n_nationkey % 2 = 0 THEN 'parse' ELSE 'detection' END, '"}},"n', n_nationkey,
    '.bad":{"sensor_id":"s', n_nationkey, '","acquisition_mode":"', CASE WHEN n_nationkey % 3 = 0 THEN 'stare' ELSE 'pushbroom' END,
    '","max_frames":64,"filter":{"role":"', CASE n_nationkey % 3 WHEN 0 THEN 'detection' WHEN 1 THEN 'tracking' ELSE 'identity' END, '"}}}}') AS document"""

# Member texts of a request by defect number k; n is the nation of the request.
REQUEST_JSON = """CASE k WHEN 1 THEN '[1, 2]' WHEN 2 THEN 'not json' ELSE concat('{',
    CASE WHEN k = 3 THEN '"zz": 1, "extra": 2, ' ELSE '' END,
    CASE k WHEN 4 THEN '' WHEN 5 THEN '"schema_version": "2.0", ' WHEN 6 THEN '"schema_version": 1.0, ' ELSE '"schema_version": "1.0", ' END,
    CASE k WHEN 7 THEN '"request_id": "", ' ELSE concat('"request_id": "r', o_orderkey, '", ') END,
    CASE k WHEN 8 THEN '"trace_id": 7, ' WHEN 0 THEN '"trace_id": "t", ' ELSE '' END,
    '"acquisition_mode": "', CASE WHEN k = 9 THEN 'scan' WHEN k = 11 OR k = 34 THEN 'stare' WHEN k = 35 AND n % 3 = 0 THEN 'stare' ELSE 'pushbroom' END, '", ',
    '"sensor": ', CASE k WHEN 10 THEN '"s"' WHEN 12 THEN '{"id": "s", "x": 1}' WHEN 13 THEN '{}'
        WHEN 14 THEN '{"id": "sat-a.area-array"}' WHEN 11 THEN '{"id": "sat-c.line-array"}' WHEN 25 THEN '{"id": "other"}'
        ELSE concat('{"id": "s', n, '"}') END, ', ',
    '"input": ', CASE WHEN k = 15 THEN 'null' WHEN k = 16 THEN '{"artifact_ref": "a", "media_type": "m", "url": "u"}'
        WHEN k = 17 THEN '{"media_type": "m"}' WHEN k = 18 THEN '{"artifact_ref": "a", "media_type": 3}'
        WHEN k = 19 THEN '{"artifact_ref": "a", "media_type": "m", "size_bytes": -1}'
        WHEN k = 20 THEN '{"artifact_ref": "a", "media_type": "m", "size_bytes": 1.5}'
        WHEN k = 21 THEN '{"artifact_ref": "a", "media_type": "m", "sha256": "ABC"}'
        WHEN k = 22 THEN '{"artifact_ref": "a", "media_type": "m", "sha256": 5}'
        WHEN k = 33 THEN '{"artifact_ref": "a", "media_type": "m"}'
        WHEN k = 37 THEN concat('{"artifact_ref": "a", "path": "/p", "media_type": "m", "size_bytes": 9, "sha256": "', repeat('0a', 32), '"}')
        ELSE '{"artifact_ref": "a", "path": "/p", "media_type": "m"}' END, ', ',
    '"processing": ', CASE WHEN k = 23 THEN '[]' WHEN k = 24 THEN '{"runtime_profile": "p", "fps": 1}' WHEN k = 26 THEN '{"runtime_profile": ""}'
        WHEN k = 27 THEN '{"runtime_profile": "none"}' WHEN k = 28 THEN concat('{"runtime_profile": "n', n, '.stare"}')
        WHEN k = 29 THEN concat('{"runtime_profile": "n', n, '.text"}') WHEN k = 30 OR k = 37 THEN concat('{"runtime_profile": "n', n, '.ground"}')
        WHEN k = 31 THEN concat('{"runtime_profile": "n', n, '.push", "max_frames": 65}')
        WHEN k = 32 THEN concat('{"runtime_profile": "n', n, '.push", "max_frames": "4"}')
        WHEN k = 34 THEN concat('{"runtime_profile": "n', n, '.stare", "max_frames": 64}')
        WHEN k = 35 THEN concat('{"runtime_profile": "n', n, '.bad"}')
        WHEN k = 36 THEN concat('{"runtime_profile": "n', n, '.push", "max_frames": 0}')
        ELSE concat('{"runtime_profile": "n', n, '.push"}') END, '}') END AS document"""


@recipe(
    "c31_validate_requests",
    """SELECT o_orderkey, rule IS NULL AS ok, rule, CASE WHEN rule IS NULL THEN 's' || n END AS sensor_id,
              CASE WHEN rule IS NULL THEN CASE k WHEN 34 THEN 'tracking' WHEN 37 THEN 'parse' ELSE 'detection' END END AS filter_role,
              CASE WHEN k = 3 THEN 'request: no field is named extra' WHEN k = 27 THEN 'processing.runtime_profile: no profile is named none'
                   WHEN rule IS NULL THEN 'request is valid' END AS message
       FROM (SELECT o_orderkey, k, n, CASE
           WHEN k IN (1, 2) THEN 'R1' WHEN k = 3 THEN 'R2' WHEN k IN (4, 5, 6) THEN 'R3' WHEN k = 7 THEN 'R4' WHEN k = 8 THEN 'R5'
           WHEN k = 9 THEN 'R6' WHEN k = 10 THEN 'R7' WHEN k = 12 THEN 'R8' WHEN k = 13 THEN 'R9' WHEN k = 14 THEN 'R10'
           WHEN k = 11 THEN 'R11' WHEN k = 15 THEN 'R12' WHEN k = 16 THEN 'R13' WHEN k IN (17, 18) THEN 'R14' WHEN k IN (19, 20) THEN 'R15'
           WHEN k IN (21, 22) THEN 'R16' WHEN k = 23 THEN 'R17' WHEN k = 24 THEN 'R18' WHEN k = 26 THEN 'R19' WHEN k = 27 THEN 'R21'
           WHEN k = 25 THEN 'R22' WHEN k = 28 THEN 'R23'
           WHEN k = 29 THEN CASE n % 5 WHEN 0 THEN 'R24' WHEN 1 THEN 'R25' WHEN 2 THEN 'R26' WHEN 3 THEN 'R27' END
           WHEN k = 30 THEN CASE WHEN n % 2 = 0 THEN 'R33' ELSE 'R28' END
           WHEN k = 37 THEN CASE WHEN n % 2 = 0 THEN NULL ELSE 'R28' END
           WHEN k = 35 THEN CASE n % 3 WHEN 0 THEN 'R31' WHEN 1 THEN 'R29' ELSE 'R30' END
           WHEN k = 33 THEN CASE WHEN n_regionkey = 0 THEN NULL ELSE 'R32' END
           WHEN k = 32 THEN 'R34' WHEN k IN (31, 36) THEN 'R35' END AS rule
         FROM (SELECT o_orderkey, o_orderkey % 40 AS k, o_custkey % 25 AS n FROM orders) r JOIN nation ON n_nationkey = n) x""",
)
def request_rules(t: Tables):
    registry = config.profiles_of(t.nation.selectExpr(PROFILES_JSON))
    requests = t.orders.selectExpr("o_orderkey", "o_orderkey % 40 AS k", "o_custkey % 25 AS n").selectExpr("o_orderkey", "k", REQUEST_JSON)
    judged = validate_requests(requests, registry)
    told = F.when(F.col("k").isin(3, 27) | F.col("ok"), F.col("message"))
    return judged.select("o_orderkey", "ok", "rule", "sensor_id", "filter_role", told.alias("message"))


