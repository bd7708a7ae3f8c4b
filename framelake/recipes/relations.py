"""Joins, aggregates, sequences, ordering and set operations (inventory sections D to H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import names
from framelake.functions.boxes import Box, Geometry, inverse_map
from framelake.operators import artifacts, lookup, pixels, rules, tiles, windows
from framelake.operators.colocated import by_frame, frame_rows
from framelake.operators.requests import unexpected_key
from framelake.operators.spatial import overlapping_pairs
from framelake.operators.targets import attach_targets, nest_targets, observation_count, ordinal_targets
from framelake.operators.windows import window_summary
from framelake.plans.products import navigation_records
from framelake.recipes.checks import MANIFEST_SQL, PROFILES_JSON, _manifest
from framelake.recipes.tables import HEIGHT, STRIDE, TARGET_ORDER, Tables, recipe
from framelake.session import scratch_path
from framelake.sources import config

WINDOW_OK = f"valid AND nibble = 0 AND line + 16 <= least(frame_id * {STRIDE} + {HEIGHT}, source_lines)"


# ---- D: joins -------------------------------------------------------------------------------------


@recipe(
    "d1_category_join",
    "SELECT frame_id, target_index, class_index, mapping_id, type FROM targets JOIN categories USING (class_index)",
    "targets categories",
)
def category_join(t: Tables):
    placed = ordinal_targets(t.targets(), ["frame_id"], TARGET_ORDER)
    return lookup.with_category(placed, t.categories()).select("frame_id", "target_index", "class_index", "mapping_id", "type")


@recipe("d2_unknown_class", "SELECT frame_id, class_index, x_min FROM targets ANTI JOIN categories USING (class_index)", "targets categories")
def unknown_class(t: Tables):
    return lookup.unknown_classes(t.targets(), t.categories()).select("frame_id", "class_index", "x_min")


@recipe(
    "d3_frame_join",
    """SELECT f.frame_id, f.geometry_id, c.c_nationkey AS nation, count(*) AS n_targets, min((x_min - offset_x) / scale_x) AS left_edge,
              max((x_max - offset_x) / scale_x) AS right_edge
       FROM frames f JOIN targets t USING (frame_id) JOIN customer c ON c.c_custkey = f.o_custkey GROUP BY ALL""",
    "frames targets",
)
def frame_join(t: Tables):
    """Frame, telemetry and target rows by key. Targets are reduced per frame before they
    meet the frames: the geometry map is increasing, so the extremes may be taken first."""
    reduced = t.targets().groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.min("x_min").alias("x_min"),
        F.min("y_min").alias("y_min"),
        F.max("x_max").alias("x_max"),
        F.max("y_max").alias("y_max"),
    )
    owners = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    box = inverse_map(Box.of(), Geometry.of())
    return (
        t.frames()
        .join(reduced, "frame_id")
        .join(owners, "o_custkey")
        .select("frame_id", "geometry_id", "nation", "n_targets", box.x_min.alias("left_edge"), box.x_max.alias("right_edge"))
    )


@recipe(
    "d3_frame_rows",
    """SELECT f.frame_id, f.geometry_id, f.camera_seconds, f.exposure_time_ns, f.o_custkey, t.class_index,
              (x_min - offset_x) / scale_x AS left_edge, (x_max - offset_x) / scale_x AS right_edge
       FROM frames f JOIN targets t USING (frame_id) WHERE f.valid""",
    "frames targets",
)
def frame_target_rows(t: Tables):
    """Frame, geometry, telemetry and target rows by (source, frame), from tables that are kept by frame."""
    frames = t.frames()
    tables = by_frame(
        {
            "frame": frames.select("source", "frame_id", "o_custkey"),
            "geometry": frames.select(
                "source", "frame_id", "geometry_id", "scale_x", "scale_y", "offset_x", "offset_y", "original_width", "original_height"
            ),
            "telemetry": frames.where("valid").select("source", "frame_id", "camera_seconds", "exposure_time_ns"),
            "target": t.targets().select("source", "frame_id", "class_index", "x_min", "y_min", "x_max", "y_max"),
        }
    )
    box = inverse_map(Box.of(), Geometry.of())
    return frame_rows(tables["frame"], tables["geometry"], tables["telemetry"], tables["target"]).select(
        "frame_id",
        "geometry_id",
        "camera_seconds",
        "exposure_time_ns",
        "o_custkey",
        "class_index",
        box.x_min.alias("left_edge"),
        box.x_max.alias("right_edge"),
    )


@recipe("d4_reconcile", f", {MANIFEST_SQL} SELECT path, status FROM matched", "artifacts")
def reconcile(t: Tables):
    return artifacts.reconcile(_manifest(t), t.artifacts()).select("path", "status")


@recipe(
    "d5_frames_left_targets",
    """SELECT frame_id, frame_id % 3 = 0 AS moved, count(t.class_index)::INT AS n_targets FROM frames
       LEFT JOIN (SELECT * REPLACE (CASE WHEN frame_id % 3 = 0 THEN -frame_id ELSE frame_id END AS frame_id) FROM targets) t USING (frame_id)
       GROUP BY 1, 2""",
    "frames targets",
)
def frames_left_targets(t: Tables):
    targets = t.targets().withColumn("frame_id", F.when(F.col("frame_id") % 3 == 0, -F.col("frame_id")).otherwise(F.col("frame_id")))
    placed = ordinal_targets(targets, ["frame_id"], TARGET_ORDER)
    nested = nest_targets(placed, ["frame_id"], F.col("class_index"), "targets")
    both = attach_targets(t.frames(), nested, ["frame_id"], "targets")
    return both.select("frame_id", (F.col("frame_id") % 3 == 0).alias("moved"), F.size("targets").alias("n_targets"))


@recipe(
    "d6_request_profile",
    """SELECT o_orderkey, CASE WHEN o_custkey % 30 < 25 THEN 64 END::BIGINT AS max_frames,
              CASE WHEN o_custkey % 30 < 25 THEN 'detection' END AS role FROM orders""",
)
def request_profile(t: Tables):
    registry = config.profiles_of(t.nation.selectExpr(PROFILES_JSON)).selectExpr("profile_id", "max_frames", "filter.role")
    wanted = t.orders.selectExpr("o_orderkey", "concat('n', o_custkey % 30, '.push') AS profile_id")
    return wanted.join(lookup.small_or_shuffled(registry), "profile_id", "left").drop("profile_id")


BEST_FIRST = "-score, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"


def best_first():
    return [-F.col("score"), *map(F.col, ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))]


BOX_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(score * 100) AS BIGINT)) AS box_id"
IOU_SQL = """(greatest(0.0, least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * greatest(0.0, least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)))
   / ((a.x_max - a.x_min) * (a.y_max - a.y_min) + (b.x_max - b.x_min) * (b.y_max - b.y_min)
      - greatest(0.0, least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * greatest(0.0, least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)))"""


@recipe(
    "d7_overlapping_pairs",
    f""", x AS MATERIALIZED (SELECT *, {BOX_ID}, row_number() OVER (PARTITION BY frame, class_index ORDER BY {BEST_FIRST}) AS r FROM dense)
        SELECT a.frame, a.class_index, least(a.box_id, b.box_id) AS low_id, greatest(a.box_id, b.box_id) AS high_id, {IOU_SQL} AS iou
        FROM x a JOIN x b ON a.frame = b.frame AND a.class_index = b.class_index AND a.r < b.r WHERE {IOU_SQL} > 0.45""",
    "dense",
)
def pairs(t: Tables):
    boxes = t.dense().selectExpr("*", BOX_ID)
    return overlapping_pairs(boxes, ["frame"], "box_id", best_first(), top_k=None, class_column="class_index")


# Destination pixels of a map with scale 1.5 and offset 2 onto a 16 x 16 plane.
DESTINATION = """frame_id, CAST(p % 16 AS BIGINT) AS x, CAST(floor(p / 16) AS BIGINT) AS y,
    (p % 16 - 2.0D) / 1.5D AS src_x, (floor(p / 16) - 2.0D) / 1.5D AS src_y"""


@recipe(
    "d8_pixel_join",
    """, d AS (SELECT DISTINCT frame_id, (p % 16)::BIGINT AS x, (p // 16)::BIGINT AS y, (p % 16 - 2.0::DOUBLE) / 1.5::DOUBLE AS sx,
              ((p // 16) - 2.0::DOUBLE) / 1.5::DOUBLE AS sy FROM (SELECT DISTINCT frame_id FROM pixels), range(256) r(p))
       SELECT d.frame_id, d.y, d.x, coalesce(v, 0)::SMALLINT AS v FROM d LEFT JOIN pixels s
         ON s.frame_id = d.frame_id AND s.x = floor(d.sx) AND s.y = floor(d.sy)""",
    "pixels",
)
def pixel_join(t: Tables):
    source = pixels.to_long(t.images(), "pixels", F.lit(8), ["frame_id"])
    wanted = t.images().selectExpr("frame_id", "explode(sequence(0, 255)) AS p").selectExpr(*_split(DESTINATION))
    return pixels.resample_long(source, wanted, ["frame_id"])


def _split(columns: str) -> list[str]:
    """Comma-separated SQL columns to a list, keeping commas inside parentheses."""
    parts, depth, current = [], 0, ""
    for character in columns:
        depth += (character == "(") - (character == ")")
        if character == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += character
    return [*parts, current]


@recipe(
    "d9_frame_tiles",
    """, s AS (SELECT p_partkey, 640 + p_size * 32 AS width, 640 + p_partkey % 1000 AS height FROM part),
        n AS (SELECT *, ceil((width - 640) / 500.0)::BIGINT + 1 AS nx, ceil((height - 640) / 500.0)::BIGINT + 1 AS ny FROM s)
       SELECT p_partkey, i AS tile_index, least(i % nx * 500, width - 640) AS x_offset, least(i // nx * 500, height - 640) AS y_offset
       FROM n, LATERAL (SELECT unnest(range(nx * ny)) AS i)""",
    "categories",
)
def frame_tiles(t: Tables):
    frames = t.part.selectExpr("p_partkey", "640 + p_size * 32 AS width", "640 + p_partkey % 1000 AS height")
    return tiles.tile_grid(frames, 640).drop("width", "height")


@recipe(
    "d10_crop_join",
    """, b AS (SELECT vec_id AS frame_id, vec_id % 7 - 1 AS x0, vec_id % 5 AS y0, vec_id % 7 + 2 AS x1, vec_id % 5 + 4 AS y1 FROM embeddings)
       SELECT p.frame_id, p.y, p.x, p.v FROM pixels p JOIN b ON b.frame_id = p.frame_id
         AND p.x >= greatest(0, x0) AND p.x < least(8, x1) AND p.y >= greatest(0, y0) AND p.y < least(8, y1)""",
    "pixels",
)
def crop_join(t: Tables):
    """Long form: pixels joined to their frame's box by key, then cut by range."""
    box = t.embeddings.selectExpr(
        "vec_id AS frame_id", "vec_id % 7 - 1 AS x_min", "vec_id % 5 AS y_min", "vec_id % 7 + 2 AS x_max", "vec_id % 5 + 4 AS y_max"
    )
    joined = pixels.to_long(t.images(), "pixels", F.lit(8), ["frame_id"]).join(box, "frame_id")
    return joined.where("x >= x_min AND x < x_max AND y >= y_min AND y < y_max").select("frame_id", "y", "x", "v")


# ---- E: aggregates --------------------------------------------------------------------------------


@recipe("e1_assemble_frames", "SELECT frame_id, count(*) AS n_lines, count_if(valid) AS n_valid FROM win GROUP BY 1", "lines win")
def assemble_frames(t: Tables):
    return window_summary(t.lines(), HEIGHT, STRIDE, F.col("value")).select("frame_id", "n_lines", "n_valid")


@recipe(
    "e2_window_samples",
    f"""SELECT frame_id, min(line) FILTER ({WINDOW_OK}) AS first_line, arg_min(value, line) FILTER ({WINDOW_OK}) AS first_value,
               max(line) FILTER ({WINDOW_OK}) AS last_line, arg_max(value, line) FILTER ({WINDOW_OK}) AS last_value
        FROM win GROUP BY 1""",
    "lines win",
)
def window_samples(t: Tables):
    summary = window_summary(t.lines(), HEIGHT, STRIDE, F.col("value"))
    return summary.selectExpr(
        "frame_id",
        "window_start.line AS first_line",
        "window_start.sample AS first_value",
        "window_end.line AS last_line",
        "window_end.sample AS last_value",
    )


@recipe(
    "e2_window_samples_short_stride",
    """, w AS (SELECT l.*, k.frame_id FROM lines l, LATERAL (SELECT unnest(range(greatest(0, floor((l.line - 40) / 12.0)::BIGINT + 1),
              l.line // 12 + 1)) AS frame_id) k)
       SELECT frame_id, count(*) AS n_lines, max(line) FILTER (valid AND nibble = 0 AND line + 16 <= least(frame_id * 12 + 40, source_lines)) AS last_line
       FROM w GROUP BY 1""",
    "lines",
)
def window_samples_short_stride(t: Tables):
    """Panes shorter than a telemetry group fall back to lines."""
    summary = window_summary(t.lines(), 40, 12, F.col("value"))
    return summary.selectExpr("frame_id", "n_lines", "window_end.line AS last_line")


@recipe("e3_frame_count", "SELECT count(DISTINCT frame_id) AS frame_count FROM win", "lines win")
def frame_count(t: Tables):
    totals = t.events.agg((F.max("event_id") + 1).alias("n"))
    return totals.select(windows.frame_count(F.col("n"), STRIDE).alias("frame_count"))


def _good(t: Tables):
    """Targets that pass every rule, with ordinal, geometry and category."""
    placed = ordinal_targets(t.targets(), ["frame_id"], TARGET_ORDER)
    joined = placed.join(t.frames().select("frame_id", *Geometry._fields), "frame_id")
    labelled = lookup.with_category(joined, t.categories())
    checks = [
        rules.Rule("over_limit", ~F.col("over_limit"), "too many targets"),
        rules.confidence_rule(F.col("confidence")),
        rules.box_rule(Box.of()),
        *rules.plane_rules(Box.of(), Geometry.of()),
    ]
    return rules.quarantine(labelled, checks)[0]


@recipe("e4_observation_count", "SELECT count(*) AS observations FROM good", "frames targets categories mapped good")
def observations(t: Tables):
    nested = nest_targets(_good(t), ["frame_id"], F.col("class_index"), "targets")
    return observation_count(attach_targets(t.frames(), nested, ["frame_id"], "targets"), "targets")


@recipe(
    "e5_nest_targets",
    """SELECT f.frame_id, coalesce(string_agg(g.target_index || ':' || g.class_index || ':' || g.type, '|' ORDER BY g.target_index), '') AS nested
       FROM frames f LEFT JOIN good g USING (frame_id) GROUP BY 1""",
    "frames targets categories mapped good",
)
def nested_targets(t: Tables):
    item = F.concat_ws(":", F.col("target_index"), F.col("class_index"), F.col("type"))
    nested = nest_targets(_good(t), ["frame_id"], item, "targets")
    attached = attach_targets(t.frames().select("frame_id"), nested, ["frame_id"], "targets")
    return attached.select("frame_id", F.array_join("targets", "|").alias("nested"))


@recipe("e6_line_count", "SELECT count(*) AS n_lines FROM orders")
def line_count(t: Tables):
    folder = scratch_path(t.spark, "jsonl")
    record = F.to_json(F.struct(F.col("o_orderkey").alias("frame_id")))
    spaced = t.orders.select(F.explode(F.array(record, F.lit(""))).alias("value"))
    spaced.write.text(folder)
    return t.spark.read.text(folder).where("value <> ''").agg(F.count(F.lit(1)).alias("n_lines"))


@recipe("e7_input_bytes", "SELECT source, sum(strlen(text))::BIGINT AS input_bytes FROM documents GROUP BY 1")
def input_bytes(t: Tables):
    return t.documents.groupBy("source").agg(F.sum(F.octet_length("text")).cast("bigint").alias("input_bytes"))


@recipe(
    "e8_first_last_frame",
    """SELECT geometry_id AS source, min(frame_id) AS first_frame, arg_min(camera_seconds, frame_id) AS first_seconds,
              max(frame_id) AS last_frame, arg_max(camera_seconds, frame_id) AS last_seconds FROM frames GROUP BY 1""",
    "frames",
)
def first_last_frame(t: Tables):
    return t.frames().groupBy(F.col("geometry_id").alias("source")).agg(
        F.min("frame_id").alias("first_frame"),
        F.min_by("camera_seconds", "frame_id").alias("first_seconds"),
        F.max("frame_id").alias("last_frame"),
        F.max_by("camera_seconds", "frame_id").alias("last_seconds"),
    )


@recipe("e9_content_digest", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_digest(t: Tables):
    return t.documents.select("doc_id", artifacts.content_digest(F.col("text")).alias("sha256"))


@recipe(
    "e10_run_metrics",
    """SELECT source, count(*) AS frame_count, sum(size_bytes)::BIGINT AS bytes,
              CASE WHEN count(*) % 3 = 0 THEN 0.0 ELSE count(*) / (count(*) % 3)::DOUBLE END AS frames_per_second
       FROM artifacts GROUP BY 1""",
    "artifacts",
)
def run_metrics(t: Tables):
    frames = t.artifacts()
    counted = frames.groupBy("source").agg(*artifacts.run_metrics(frames, F.col("size_bytes")))
    wall = (F.col("frame_count") % 3).cast("double")
    return counted.withColumn("frames_per_second", artifacts.frames_per_second(F.col("frame_count"), wall))


@recipe(
    "e11_class_counts",
    """SELECT regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]', '_', 'g') AS class_dir, count(*) AS n
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def class_counts(t: Tables):
    """Counted per part first, so the dimension meets one row per part."""
    per_part = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    folder = names.class_folder(F.concat_ws("/", "p_name", "p_brand"))
    return per_part.join(t.part, "p_partkey").groupBy(folder.alias("class_dir")).agg(F.sum("n").alias("n"))


@recipe("e12_duplicate_members", "SELECT sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_members(t: Tables):
    return rules.repeated(t.artifacts().select("sha256"), ["sha256"])


# ---- F: windows and sequences -----------------------------------------------------------------------


@recipe("f1_sliding_windows", "SELECT frame_id, line FROM win", "lines win")
def sliding_windows(t: Tables):
    return windows.assign_frames(t.lines().select("line"), HEIGHT, STRIDE).select("frame_id", "line")


@recipe(
    "f1_gapped_windows",
    """SELECT line // 50 AS frame_id, line FROM lines WHERE line % 50 < 20""",
    "lines",
)
def gapped_windows(t: Tables):
    return windows.assign_frames(t.lines().select("line"), 20, 50).select("frame_id", "line")


@recipe(
    "f2_compact_rows",
    "SELECT frame_id, line, row_number() OVER (PARTITION BY frame_id ORDER BY line) - 1 AS out_row FROM win WHERE valid",
    "lines win",
)
def compact_rows(t: Tables):
    return windows.compact_rows(t.lines(), HEIGHT, STRIDE).select("frame_id", "line", "out_row")


@recipe(
    "f3_gaps",
    """SELECT event_type AS source, coalesce(p, -1) AS after_id, event_id AS next_id
       FROM (SELECT event_type, event_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events)
       WHERE event_id - coalesce(p, -1) > 1""",
)
def gaps(t: Tables):
    ids = t.events.selectExpr("event_type AS source", "event_id AS frame_id")
    return windows.gaps(ids, block_lines=1024)


@recipe("f4_target_ordinals", "SELECT frame_id, class_index, x_min, y_min, CASE WHEN n_targets <= 256 THEN target_index END AS target_index FROM targets", "targets")
def ordinals(t: Tables):
    placed = ordinal_targets(t.targets(), ["frame_id"], TARGET_ORDER)
    return placed.select("frame_id", "class_index", "x_min", "y_min", "target_index")


@recipe("f5_file_index", "SELECT url, page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS index FROM pages")
def file_index(t: Tables):
    return windows.global_index(t.pages.select("url", "page_id"), ["url", "page_id"])


@recipe(
    "f6_look_ahead",
    "SELECT line, lead(value, 14) OVER (ORDER BY line) AS value_14, lead(value, 15) OVER (ORDER BY line) AS value_15 FROM lines",
    "lines",
)
def look_ahead(t: Tables):
    return windows.look_ahead(t.lines(), "value", (14, 15), block_lines=512).select("line", "value_14", "value_15")


# ---- G and H: order, top-k, sets --------------------------------------------------------------------


@recipe("g1_sort_files", "SELECT url, page_id FROM pages ORDER BY url, page_id")
def sort_files(t: Tables):
    return t.pages.select("url", "page_id").orderBy("url", "page_id")


@recipe("g2_member_order", "SELECT path, row_number() OVER (ORDER BY path) - 1 AS position FROM artifacts", "artifacts")
def member_order(t: Tables):
    return windows.global_index(t.artifacts().select("path"), ["path"], "position")


@recipe("g3_frame_limit", "SELECT frame_id, camera_seconds FROM frames WHERE frame_id < 500", "frames")
def first_frames(t: Tables):
    return t.frames().where("frame_id < 500").select("frame_id", "camera_seconds")


@recipe(
    "g4_top_candidates",
    f"SELECT frame, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {BEST_FIRST})::INT AS rank FROM dense) WHERE rank <= 5",
    "dense",
)
def top_candidates(t: Tables):
    return windows.first_ranked(t.dense(), ["frame"], best_first(), 5).select("frame", "score", "rank")


@recipe(
    "g5_record_cap",
    f"SELECT frame, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {BEST_FIRST})::INT AS rank FROM dense) WHERE rank <= 256",
    "dense",
)
def record_cap(t: Tables):
    return tiles.cap_kept(t.dense(), ["frame"], best_first()).select("frame", "score", "rank")


@recipe(
    "h1_unexpected_key",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'b' ELSE NULL END AS unexpected FROM events""",
)
def unexpected(t: Tables):
    document = F.expr(
        """CASE event_id % 4 WHEN 0 THEN replace(props, '}', concat(', "zz": 1, "a', event_id, '": 2}'))
             WHEN 1 THEN replace(props, '}', ', "b": 1}') ELSE props END"""
    )
    return t.events.select("event_id", unexpected_key(document, ("k", "frame_id")).alias("unexpected"))


@recipe("h2_extension_member", r"SELECT page_id, lower(regexp_extract(url, '^.*/.+(\.[^./]*)$', 1)) IN ('.html', '.com') AS wanted FROM pages")
def extension_member(t: Tables):
    from framelake.sources.images import extensions

    return t.pages.select("page_id", names.extension(F.col("url")).isin(extensions("html, .COM")).alias("wanted"))


@recipe(
    "h3_one_sided_frames",
    """, l AS (SELECT o_orderkey AS frame_id FROM orders), r AS (SELECT CASE WHEN l_linenumber = 1 THEN l_orderkey ELSE -(l_orderkey * 10 + l_linenumber) END AS frame_id FROM lineitem)
       SELECT frame_id, 'left' AS side FROM (FROM l EXCEPT ALL FROM r) UNION ALL SELECT frame_id, 'right' FROM (FROM r EXCEPT ALL FROM l)""",
    "categories",
)
def one_sided(t: Tables):
    left = t.orders.selectExpr("o_orderkey AS frame_id")
    right = t.lineitem.selectExpr("if(l_linenumber = 1, l_orderkey, -(l_orderkey * 10 + l_linenumber)) AS frame_id")
    return lookup.both_sides(left, right)


# ---- B-7: the flagship, windows to navigation records ---------------------------------------------


NAV_SAMPLE = """named_struct('gps_week', CAST(line % 2048 AS INT), 'gps_seconds', line * 3,
    'lla', array(CAST(value AS FLOAT), CASE WHEN line % 48 = 0 THEN CAST('NaN' AS FLOAT) ELSE CAST(user_id AS FLOAT) END, CAST(line AS FLOAT)),
    'attitude', array(CAST(channel AS FLOAT), CAST(value AS FLOAT), CAST(0 AS FLOAT)),
    'velocity', array(CAST(value AS FLOAT), CAST(value AS FLOAT), CAST(channel AS FLOAT))) AS sample"""
NAV_SQL = f""", s AS (SELECT frame_id, min(line) FILTER ({WINDOW_OK}) AS line FROM win GROUP BY 1)
    SELECT s.frame_id, 'GPS' AS scale, coalesce(s.line % 2048, 0)::INT AS week, coalesce(s.line * 3, 0) AS seconds,
           coalesce(l.value::FLOAT::DOUBLE, 0) AS lon, CASE WHEN s.line % 48 = 0 THEN NULL ELSE coalesce(l.user_id::DOUBLE, 0) END AS lat,
           coalesce(s.line::FLOAT::DOUBLE, 0) AS alt, coalesce(l.channel::DOUBLE, 0) AS roll, coalesce(l.value::FLOAT::DOUBLE, 0) AS velocity
    FROM s LEFT JOIN lines l ON l.line = s.line"""


def navigation_view(t: Tables):
    return navigation_records(t.lines().selectExpr("*", NAV_SAMPLE), HEIGHT, STRIDE)


def flat_navigation(records):
    return records.select(
        "frame_id",
        "gps_time.scale",
        "gps_time.week",
        "gps_time.seconds",
        *[F.col("lla")[i].cast("double").alias(n) for i, n in enumerate(("lon", "lat", "alt"))],
        F.col("rpy")[0].cast("double").alias("roll"),
        F.col("velocity")[0].cast("double").alias("velocity"),
    )


@recipe("b7_navigation", NAV_SQL, "lines win")
def navigation(t: Tables):
    return flat_navigation(navigation_view(t))
