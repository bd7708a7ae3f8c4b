"""Projections, decoding and box arithmetic (inventory section B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import binary, boxes, names, records
from framelake.functions.boxes import Box, Geometry
from framelake.operators import pixels
from framelake.operators.windows import look_ahead
from framelake.recipes.linefile import HEADER_SQL, header_bytes
from framelake.recipes.tables import Tables, recipe


@recipe(
    "b1_parse_header",
    f"""SELECT event_id, event_type <> 'error' AS valid, (event_id % 16)::INT AS nibble,
               (user_id % 5)::SMALLINT AS channel_id, ((user_id // 5) % 256)::SMALLINT AS strip_number,
               event_id % 16777216 AS row_number, {HEADER_SQL['microseconds']} AS camera_microseconds
        FROM events""",
)
def parse_header(t: Tables):
    headed = t.events.select("event_id", header_bytes().alias("raw"))
    return headed.select("event_id", binary.line_header(F.col("raw")).alias("h")).select("event_id", "h.*")


@recipe(
    "b2_parse_samples",
    """SELECT a.line, a.value AS value_0, b.value AS value_14, c.value AS value_15
       FROM lines a LEFT JOIN lines b ON b.line = a.line + 14 LEFT JOIN lines c ON c.line = a.line + 15
       WHERE a.valid AND a.nibble = 0 AND a.line + 16 <= a.source_lines""",
    "lines",
)
def parse_samples(t: Tables):
    ahead = look_ahead(t.lines(), "value", (14, 15))
    starts = ahead.where("valid AND nibble = 0 AND line + 16 <= source_lines")
    return starts.select("line", F.col("value").alias("value_0"), "value_14", "value_15")


@recipe(
    "b3_be_float",
    """SELECT event_id, (CASE WHEN event_id % 2 = 1 THEN -1.0 ELSE 1.0 END::DOUBLE * pow(2.0, (event_id % 60) - 27)
               * (1.0::DOUBLE + ((event_id * 7919) % 8388608)::DOUBLE / 8388608.0::DOUBLE))::DOUBLE AS f
       FROM events""",
)
def be_float(t: Tables):
    bits = "shiftleft(event_id % 2, 31) + shiftleft(100 + event_id % 60, 23) + (event_id * 7919) % 8388608"
    raw = t.events.selectExpr("event_id", f"unhex(lpad(hex({bits}), 8, '0')) AS raw")
    return raw.select("event_id", binary.be_float(F.col("raw")).cast("double").alias("f"))


@recipe(
    "b4_exposure_ns",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              floor(((l_quantity::BIGINT * l_partkey) % 16777216) * 12.5::DOUBLE)::BIGINT AS exposure_time_ns
       FROM lineitem""",
)
def exposure_ns(t: Tables):
    ticks = F.expr("(CAST(l_quantity AS BIGINT) * l_partkey) % 16777216")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", binary.exposure_ns(ticks).alias("exposure_time_ns")
    )


@recipe(
    "b5_unpack_10_to_8",
    """WITH p AS (SELECT event_id, (event_id * 1000003 + user_id) % 1099511627776 AS n FROM events),
            b AS (SELECT event_id, (n >> 32) & 255 AS b0, (n >> 24) & 255 AS b1, (n >> 16) & 255 AS b2,
                         (n >> 8) & 255 AS b3, n & 255 AS b4 FROM p)
       SELECT event_id, x::BIGINT AS x,
              (CASE x WHEN 0 THEN b0 WHEN 1 THEN ((b1 & 63) << 2) | (b2 >> 6)
                      WHEN 2 THEN ((b2 & 15) << 4) | (b3 >> 4) ELSE ((b3 & 3) << 6) | (b4 >> 2) END)::SMALLINT AS v
       FROM b, range(4) r(x)""",
)
def unpack(t: Tables):
    packed = "unhex(lpad(hex((event_id * 1000003 + user_id) % 1099511627776), 10, '0')) AS packed"
    return pixels.unpack_long(t.events.selectExpr("event_id", packed), "packed", ["event_id"])


@recipe("b6_pts_ns", "SELECT o_orderkey AS frame_id, o_orderkey * 33333333 AS pts_ns FROM orders")
def pts(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("frame_id"), binary.pts_ns(F.col("o_orderkey"), 30.0).alias("pts_ns")
    )


SAMPLE_SQL = """
    named_struct('valid', valid, 'channel_id', frame_id % 5, 'strip_number', frame_id % 7,
      'row_number', frame_id * 16, 'camera_seconds', camera_seconds, 'camera_microseconds', camera_microseconds,
      'time_sync_status', frame_id % 3, 'exposure_time_ns', exposure_time_ns,
      'gps_week', CAST(frame_id % 2048 AS INT), 'gps_seconds', frame_id % 604800,
      'lla', array(scale_x, CASE WHEN frame_id % 9 = 0 THEN CAST('NaN' AS DOUBLE) ELSE scale_y END, offset_x),
      'velocity', array(offset_x, offset_y, scale_x),
      'attitude', array(CASE WHEN frame_id % 11 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE scale_x END,
                        scale_y, offset_y)) AS sample"""


@recipe(
    "b8_finite_or_null",
    """SELECT vec_id, i::BIGINT AS place,
              CASE WHEN (vec_id + i) % 7 = 0 OR (vec_id + i) % 11 = 0 THEN NULL ELSE embedding[i + 1]::DOUBLE END AS v
       FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS i)""",
)
def finite_or_null(t: Tables):
    spoiled = t.embeddings.selectExpr(
        "vec_id",
        """transform(embedding, (e, i) -> CASE WHEN (vec_id + i) % 7 = 0 THEN CAST('NaN' AS FLOAT)
             WHEN (vec_id + i) % 11 = 0 THEN CAST('-Infinity' AS FLOAT) ELSE e END) AS e""",
    )
    clean = spoiled.select("vec_id", F.posexplode(boxes.finite_triplet(F.col("e"))).alias("place", "v"))
    return clean.select("vec_id", F.col("place").cast("bigint").alias("place"), F.col("v").cast("double").alias("v"))


@recipe(
    "b9_normalized_telemetry",
    """SELECT frame_id, frame_id % 5 AS channel_id, 'camera' AS camera_scale, camera_seconds AS seconds,
              camera_microseconds AS microseconds, exposure_time_ns AS exposure, 'ns' AS exposure_unit,
              'GPS' AS gps_scale, (frame_id % 2048)::INT AS week, frame_id % 604800 AS gps_seconds,
              scale_x AS lon, CASE WHEN frame_id % 9 = 0 THEN NULL ELSE scale_y END AS lat, offset_x AS alt,
              CASE WHEN frame_id % 11 = 0 THEN NULL ELSE scale_x END AS roll, scale_y AS pitch, offset_y AS yaw,
              'roll-pitch-yaw_3-2-1' AS attitude_order, 'source' AS unit, false AS normalized
       FROM frames""",
    "frames",
)
def normalized_telemetry(t: Tables):
    sampled = t.frames().selectExpr("*", SAMPLE_SQL)
    r = F.col("r")
    return sampled.select("frame_id", records.telemetry(F.col("sample")).alias("r")).select(
        "frame_id",
        r["channel_id"].alias("channel_id"),
        r["camera_time"]["scale"].alias("camera_scale"),
        r["camera_time"]["seconds"].alias("seconds"),
        r["camera_time"]["microseconds"].alias("microseconds"),
        r["exposure"]["value"].alias("exposure"),
        r["exposure"]["unit"].alias("exposure_unit"),
        r["gps_time"]["scale"].alias("gps_scale"),
        r["gps_time"]["week"].alias("week"),
        r["gps_time"]["seconds"].alias("gps_seconds"),
        *[r["lla"]["values"][i].alias(n) for i, n in enumerate(("lon", "lat", "alt"))],
        *[r["attitude"]["values"][i].alias(n) for i, n in enumerate(("roll", "pitch", "yaw"))],
        r["attitude"]["order"].alias("attitude_order"),
        r["lla"]["units"][1].alias("unit"),
        r["velocity"]["normalized"].alias("normalized"),
    )


@recipe(
    "b10_area_frame",
    """SELECT frame_id, valid, frame_id % 5 AS channel_id, frame_id % 7 AS strip_number,
              frame_id % 3 AS time_sync_status, frame_id * 16 AS row_number, camera_seconds,
              camera_microseconds, exposure_time_ns FROM frames""",
    "frames",
)
def area_frame(t: Tables):
    sampled = t.frames().selectExpr("frame_id AS id", "*", SAMPLE_SQL)
    return sampled.select("frame_id", records.area_frame(F.col("sample")).alias("a")).select("frame_id", "a.*")


@recipe(
    "b11_observation",
    """SELECT frame_id, 'camera' AS scale, camera_seconds AS seconds, camera_microseconds AS microseconds,
              exposure_time_ns AS value, 'ns' AS unit FROM frames""",
    "frames",
)
def observation(t: Tables):
    nested = t.frames().select(
        "frame_id",
        records.camera_time(F.col("camera_seconds"), F.col("camera_microseconds")).alias("o"),
        records.exposure(F.col("exposure_time_ns")).alias("e"),
    )
    return nested.select("frame_id", "o.*", "e.*")


def _mapped(t: Tables):
    geometry = ["geometry_id", *Geometry._fields]
    return t.targets().join(t.frames().select("frame_id", *geometry), "frame_id")


TARGET_ID = ["frame_id", "l_linenumber", "l_partkey", "l_suppkey"]
TARGET_ID_SQL = "frame_id, l_linenumber, l_partkey, l_suppkey"
RAW_TARGETS = """(SELECT l_orderkey AS frame_id, l_linenumber, l_partkey, l_suppkey,
        (l_partkey % 4000)::DOUBLE AS x_min, (l_suppkey % 4000)::DOUBLE AS y_min,
        l_partkey % 4000 + l_quantity AS x_max, l_suppkey % 4000 + l_tax * 1000 AS y_max, l_quantity,
        l_suppkey % 30 AS class_index FROM lineitem)"""


@recipe(
    "b12_forward_map",
    f"""SELECT {TARGET_ID_SQL}, scale_x * x_min + offset_x AS x_min, scale_y * y_min + offset_y AS y_min,
               scale_x * x_max + offset_x AS x_max, scale_y * y_max + offset_y AS y_max
        FROM {RAW_TARGETS} t JOIN frames USING (frame_id)""",
    "frames",
)
def forward_map(t: Tables):
    return _mapped(t).select(*TARGET_ID, *boxes.forward_map(Box.of(), Geometry.of()).columns())


@recipe(
    "b13_inverse_map",
    f"""SELECT {TARGET_ID_SQL}, (x_min - offset_x) / scale_x AS x_min, (y_min - offset_y) / scale_y AS y_min,
               (x_max - offset_x) / scale_x AS x_max, (y_max - offset_y) / scale_y AS y_max
        FROM {RAW_TARGETS} t JOIN frames USING (frame_id)""",
    "frames",
)
def inverse_map(t: Tables):
    return _mapped(t).select(*TARGET_ID, *boxes.inverse_map(Box.of(), Geometry.of()).columns())


@recipe(
    "b14_center",
    f"SELECT {TARGET_ID_SQL}, (x_min + x_max) / 2 AS pixel, (y_min + y_max) / 2 AS line FROM {RAW_TARGETS} t",
)
def box_center(t: Tables):
    x, y = boxes.center(Box.of())
    return t.targets().select(*TARGET_ID, x.alias("pixel"), y.alias("line"))


@recipe(
    "b15_target_ids",
    """SELECT frame_id, target_index, 'd' || target_index AS target_id, 'detection:' || frame_id || ':' || target_index AS source_id
       FROM (SELECT frame_id, CASE WHEN n_targets <= 256 THEN target_index END AS target_index FROM targets)""",
    "targets",
)
def target_ids(t: Tables):
    from framelake.operators.targets import ordinal_targets
    from framelake.recipes.tables import TARGET_ORDER

    placed = ordinal_targets(t.targets(), ["frame_id"], TARGET_ORDER)
    index = F.col("target_index")
    return placed.select(
        "frame_id",
        "target_index",
        names.target_id(index).alias("target_id"),
        names.source_id(F.col("frame_id"), index).alias("source_id"),
    )


# A reversed, partly outside box, so that ordering and clamping both act.
LOOSE_SQL = {"x0": "x_max - 20", "y0": "y_min - 10", "x1": "x_min - 10", "y1": "y_max + 10"}


@recipe(
    "b16_clamp_box",
    f"""SELECT {TARGET_ID_SQL}, greatest(0.0, least({LOOSE_SQL['x0']}, {LOOSE_SQL['x1']})) AS x_min,
               greatest(0.0, least({LOOSE_SQL['y0']}, {LOOSE_SQL['y1']})) AS y_min,
               least(3000.0::DOUBLE, greatest({LOOSE_SQL['x0']}, {LOOSE_SQL['x1']})) AS x_max,
               least(90.0::DOUBLE, greatest({LOOSE_SQL['y0']}, {LOOSE_SQL['y1']})) AS y_max
        FROM {RAW_TARGETS} t""",
)
def clamp_box(t: Tables):
    loose = Box(F.col("x_max") - 20, F.col("y_min") - 10, F.col("x_min") - 10, F.col("y_max") + 10)
    return t.targets().select(*TARGET_ID, *boxes.clamp(loose, F.lit(3000), F.lit(90)).columns())


@recipe(
    "b17_crop_window",
    f"""SELECT {TARGET_ID_SQL}, greatest(0, floor(x_min / 3 - 5)::BIGINT) AS x_min,
               greatest(0, floor(y_min / 3 - 5)::BIGINT) AS y_min,
               least(1000, ceil(x_max / 3)::BIGINT) AS x_max, least(30, ceil(y_max / 3)::BIGINT) AS y_max
        FROM {RAW_TARGETS} t""",
)
def crop_window(t: Tables):
    box = Box(F.col("x_min") / 3 - 5, F.col("y_min") / 3 - 5, F.col("x_max") / 3, F.col("y_max") / 3)
    return t.targets().select(*TARGET_ID, *boxes.crop_window(box, F.lit(1000), F.lit(30)).columns())


@recipe(
    "b18_crop_name",
    """SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'unknown'
                ELSE regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]', '_', 'g') END AS class_dir,
              printf('f%06d_d%d', p_partkey * 977, p_size::BIGINT) AS name FROM part""",
)
def crop_names(t: Tables):
    kind = F.expr("CASE WHEN p_partkey % 50 = 0 THEN '' ELSE concat(p_name, '/', p_brand) END")
    return t.part.select(
        "p_partkey",
        names.class_folder(kind).alias("class_dir"),
        names.crop_name(F.col("p_partkey") * 977, F.col("p_size")).alias("name"),
    )


@recipe(
    "b19_redact_path",
    """SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS basename, 'text/html' AS media_type FROM pages""",
)
def redact_path(t: Tables):
    record = t.pages.selectExpr("page_id", "named_struct('path', url, 'media_type', 'text/html') AS input")
    return record.select(
        "page_id", records.redact_input(F.col("input"), ["path", "media_type"]).alias("r")
    ).select("page_id", "r.*")


@recipe(
    "b20_frame_metadata",
    """SELECT frame_id AS index, CASE WHEN valid THEN frame_id * 33333333 END AS pts_ns,
              CASE WHEN valid THEN 33333333::BIGINT END AS duration_ns, filter_width AS width, filter_height AS height,
              'GRAY8' AS format, filter_width::BIGINT * filter_height AS size_bytes,
              concat_ws(',', CASE WHEN valid THEN 'telemetry' END, 'geometry',
                        CASE WHEN frame_id % 5 = 0 THEN 'tracking' ELSE 'detection' END) AS kinds
       FROM frames""",
    "frames",
)
def frame_metadata(t: Tables):
    valid, frame = F.col("valid"), F.col("frame_id")
    kinds = {
        "telemetry": valid,
        "geometry": F.lit(True),
        "detection": frame % 5 != 0,
        "tracking": frame % 5 == 0,
    }
    described = t.frames().select(
        records.frame_metadata(
            frame,
            F.when(valid, binary.pts_ns(frame, 30.0)),
            F.when(valid, F.lit(33333333).cast("bigint")),
            F.col("filter_width"),
            F.col("filter_height"),
            F.lit("GRAY8"),
            F.col("filter_width").cast("bigint") * F.col("filter_height"),
            kinds,
        ).alias("m")
    )
    return described.select(
        "m.index", "m.pts_ns", "m.duration_ns", "m.video.*", "m.size_bytes", F.array_join("m.meta_kinds", ",").alias("kinds")
    )


@recipe(
    "b21_extension_set",
    """SELECT p_partkey, list_aggregate(list_sort(list_distinct([
                 CASE WHEN e LIKE '.%' THEN e ELSE '.' || e END
                 FOR e IN [lower(trim(i, ' ' || chr(9))) FOR i IN
                   string_split(' .' || p_type || ', ' || p_brand || ',,' || lower(p_type) || ' ,JPG', ',')]
                 IF length(e) > 0])), 'string_agg', '|') AS extensions FROM part""",
)
def extension_set(t: Tables):
    text = F.expr("concat(' .', p_type, ', ', p_brand, ',,', lower(p_type), ' ,JPG')")
    return t.part.select("p_partkey", F.array_join(names.extension_set(text), "|").alias("extensions"))


@recipe(
    "b22_image_meta",
    """SELECT 'pushbroom' AS acquisition_mode, f.frame_id, f.geometry_id, f.filter_width, f.filter_height,
              f.original_width, f.original_height, f.camera_seconds AS seconds, f.exposure_time_ns AS exposure,
              'sat-c.line-array' AS sensor_id, count(t.frame_id)::INT AS target_count
       FROM frames f LEFT JOIN targets t USING (frame_id) GROUP BY ALL""",
    "frames targets",
)
def image_meta(t: Tables):
    counts = t.targets().groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    joined = t.frames().join(counts, "frame_id", "left")
    planes = F.struct("filter_height", "filter_width", "geometry_id", "original_height", "original_width")
    meta = records.image_meta(
        F.col("sensor_id"),
        F.col("acquisition_mode"),
        F.col("frame_id"),
        planes,
        records.camera_time(F.col("camera_seconds"), F.col("camera_microseconds")),
        records.exposure(F.col("exposure_time_ns")),
        F.coalesce("n", F.lit(0)).cast("int"),
        "target_count",
    )
    return joined.select(meta.alias("m")).select(
        "m.acquisition_mode",
        "m.frame_id",
        "m.geometry_id",
        "m.filter_width",
        "m.filter_height",
        "m.original_width",
        "m.original_height",
        "m.observation_time.seconds",
        F.col("m.exposure_duration.value").alias("exposure"),
        "m.sensor_id",
        "m.target_count",
    )
