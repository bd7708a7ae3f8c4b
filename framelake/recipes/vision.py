"""Products and vision operators (inventory sections K and L)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from framelake.functions.binary import pts_ns
from framelake.functions.boxes import Box, crop_window
from framelake.functions.names import file_name
from framelake.operators import pixels, tiles
from framelake.operators.artifacts import frames_per_second, tree_digest
from framelake.operators.spatial import suppress
from framelake.operators.windows import sequence_number
from framelake.plans import bundles, products
from framelake.plans.detector import detect
from framelake.recipes.relations import BEST_FIRST, IOU_SQL, NAV_SQL, best_first, flat_navigation, navigation_view
from framelake.recipes.tables import TARGET_ORDER, Tables, recipe
from framelake.session import scratch_path
from framelake.sources.config import read_products

GOOD_VIEWS = "frames targets categories mapped good"


# ---- K: products ------------------------------------------------------------------------------------


def _detections(t: Tables):
    return products.target_records(t.frames(), t.targets(), t.categories(), TARGET_ORDER, mode="quarantine")


def _written(t: Tables, records):
    """Write a product, compressed, and read it back with the same schema."""
    path = scratch_path(t.spark, "product")
    products.write_records(records, path, "gzip")
    return read_products(t.spark, path, records.schema)


@recipe(
    "k1_target_frames",
    """SELECT f.frame_id, f.camera_seconds AS seconds, f.exposure_time_ns AS exposure, 'd' || g.target_index AS target_id,
              'detection:' || g.frame_id || ':' || g.target_index AS source_id, g.class_index, g.type, g.confidence,
              g.ox_min AS x_min, g.oy_max AS y_max, (g.oy_min + g.oy_max) / 2 AS line, (g.ox_min + g.ox_max) / 2 AS pixel
       FROM frames f LEFT JOIN good g USING (frame_id)""",
    GOOD_VIEWS,
)
def target_frames(t: Tables):
    records = _written(t, _detections(t)[0])
    flat = records.select(
        "frame_id", "observation_time.seconds", F.col("exposure_duration.value").alias("exposure"), F.explode_outer("targets").alias("g")
    )
    return flat.selectExpr(
        "frame_id", "seconds", "exposure", "g.target_id", "g.source_id", "g.class.index AS class_index", "g.class.type",
        "g.confidence", "g.bbox.x_min", "g.bbox.y_max", "g.geolocation_sample.line", "g.geolocation_sample.pixel",
    )


@recipe(
    "k1_rejected_targets",
    """SELECT m.frame_id, m.target_index, CASE WHEN NOT (x_min < x_max AND y_min < y_max) THEN 'box'
              WHEN NOT (x_min >= 0 AND y_min >= 0 AND x_max <= filter_width AND y_max <= filter_height) THEN 'filter_plane'
              WHEN NOT (ox_min >= 0 AND oy_min >= 0 AND ox_max <= original_width AND oy_max <= original_height) THEN 'original_plane'
              WHEN c.class_index IS NULL THEN 'class' END AS failed_rule
       FROM mapped m LEFT JOIN categories c USING (class_index)
       WHERE (m.frame_id, m.target_index) NOT IN (SELECT (frame_id, target_index) FROM good)""",
    GOOD_VIEWS,
)
def rejected_targets(t: Tables):
    return _detections(t)[2].select("frame_id", "target_index", "failed_rule")




def _odd_frames(t: Tables):
    """Every fifth frame is missing, and frames hold four targets at most."""
    frames = t.frames().where("frame_id % 5 <> 0")
    return products.target_records(frames, t.targets(), t.categories(), TARGET_ORDER, mode="quarantine", limit=4)


@recipe(
    "k1_orphan_targets",
    """SELECT frame_id, target_index, failed_rule FROM (
         SELECT frame_id, CASE WHEN n_targets <= 4 THEN target_index END AS target_index,
                CASE WHEN n_targets > 4 THEN 'over_limit' WHEN frame_id % 5 = 0 THEN 'frame_known' END AS failed_rule FROM targets)
       WHERE failed_rule IS NOT NULL""",
    "targets",
)
def orphan_targets(t: Tables):
    """All targets of crowded and of missing frames are listed."""
    rejects = _odd_frames(t)[2].where("failed_rule IN ('over_limit', 'frame_known')")
    return rejects.select("frame_id", "target_index", "failed_rule")


@recipe(
    "k1_crowded_frames",
    """SELECT f.frame_id, count(g.frame_id)::INT AS n_targets FROM frames f LEFT JOIN good g USING (frame_id)
       WHERE f.frame_id % 5 <> 0 AND f.frame_id NOT IN (SELECT frame_id FROM targets WHERE n_targets > 4) GROUP BY 1""",
    GOOD_VIEWS,
)
def crowded_frames(t: Tables):
    """A frame over the limit has no record, so it cannot be taken for one without targets."""
    return _odd_frames(t)[0].select("frame_id", F.size("targets").alias("n_targets"))


@recipe(
    "k2_track_frames",
    """, g AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY place) - 1 AS target_index, track_id, c.type,
              x_min, (y_min + y_max) / 2 AS row, (x_min + x_max) / 2 AS "column",
              row_number() OVER (PARTITION BY frame_id, track_id ORDER BY place) AS copy
            FROM tracks LEFT JOIN categories c USING (class_index)),
        k AS (SELECT * FROM g WHERE type IS NOT NULL AND copy = 1)
       SELECT f.frame_id, f.frame_id * 3 AS seconds, k.track_id, k.type, k.x_min, k.row, k."column"
       FROM (SELECT DISTINCT frame_id FROM tracks) f LEFT JOIN k USING (frame_id)""",
    "categories tracks",
)
def track_frames(t: Tables):
    frames = t.tracks().groupBy("source", "frame_id").agg(F.lit(True).alias("valid")).selectExpr(
        "*", "frame_id * 3 AS camera_seconds", "0L AS camera_microseconds", "0L AS exposure_time_ns", "'g' AS geometry_id",
        "1.0D AS scale_x", "1.0D AS scale_y", "0.0D AS offset_x", "0.0D AS offset_y", "4000 AS original_width",
        "4000 AS original_height", "4000 AS filter_width", "4000 AS filter_height", "'sat-a.area-array' AS sensor_id",
        "'stare' AS acquisition_mode",
    )
    records, _, _ = products.target_records(frames, t.tracks(), t.categories(), ["place"], role="tracking", mode="quarantine")
    flat = _written(t, records).select("frame_id", "observation_time.seconds", F.explode_outer("tracks").alias("k"))
    return flat.selectExpr(
        "frame_id", "seconds", "k.track_id", "k.class.type", "k.bbox.x_min", "k.image_sample.row", "k.image_sample.column"
    )


@recipe(
    "k3_image_meta",
    """SELECT f.frame_id, f.geometry_id, f.filter_width, f.original_height, f.camera_microseconds AS microseconds,
              count(g.frame_id)::INT AS target_count FROM frames f LEFT JOIN good g USING (frame_id) GROUP BY ALL""",
    GOOD_VIEWS,
)
def image_meta(t: Tables):
    meta = _written(t, _detections(t)[1])
    return meta.select(
        "frame_id", "geometry_id", "filter_width", "original_height", "observation_time.microseconds", "target_count"
    )


@recipe("k4_navigation_product", NAV_SQL, "lines win")
def navigation_product(t: Tables):
    return flat_navigation(_written(t, navigation_view(t)))


def _dense_frames(t: Tables):
    """8 x 8 images as BINARY frames of a source per label."""
    hexed = "array_join(transform(pixels, v -> lpad(hex(v), 2, '0')), '')"
    labels = t.embeddings.selectExpr("vec_id AS frame_id", "concat('l', label) AS source")
    images = t.images().selectExpr("frame_id", f"unhex({hexed}) AS pixels", "8 AS width", "8 AS height")
    return images.join(labels, "frame_id")


BUNDLE_SQL = """, b AS (SELECT 'l' || label AS source, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_id, vec_id FROM embeddings),
    m AS (SELECT source, b.frame_id, sha256(unhex(string_agg(printf('%02X', v::BIGINT), '' ORDER BY y, x))) AS sha256
          FROM pixels JOIN b ON pixels.frame_id = b.vec_id GROUP BY 1, 2)"""
LEVEL_SQL = """l{n} AS (SELECT source, node // 1024 AS node, sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM l{p} GROUP BY 1, 2)"""


@recipe(
    "k5_frame_bundle",
    BUNDLE_SQL
    + ", l0 AS (SELECT source, frame_id AS node, sha256 AS digest FROM m), "
    + ", ".join(LEVEL_SQL.format(n=i, p=i - 1) for i in range(1, 5))
    + " SELECT source, digest AS bundle_sha256 FROM l4",
    "pixels",
)
def frame_bundle(t: Tables):
    """Digest of each source over the digests of its members' pixels, read from the files of the bundle."""
    members = bundles.bundle_members(t.spark, _bundle(t))
    return tree_digest(members, "frame_id", "sha256", ["source"])


def _bundle_frames(t: Tables):
    """The dense frames with ids 0..n-1 in each source, some with presentation times."""
    frames = _dense_frames(t).withColumnRenamed("frame_id", "vec_id")
    return sequence_number(frames, ("source",), "vec_id", "frame_id").drop("vec_id")


def _bundle(t: Tables) -> str:
    path, frame = scratch_path(t.spark, "bundle"), F.col("frame_id")
    timed = frame % 4 != 3
    kinds = {"telemetry": timed, "geometry": F.lit(True), "detection": frame % 5 == 0}
    members = bundles.members_of(_bundle_frames(t), kinds, F.when(timed, pts_ns(frame, 30.0)), F.when(timed, F.lit(33333333).cast("bigint")))
    bundles.write_bundle(members, path, {"request_id": "r-1", "sensor_id": "cam"})
    return path


@recipe(
    "k5_frame_metadata",
    BUNDLE_SQL
    + """ SELECT source, frame_id, printf('%06d.bin', frame_id) AS name, 64::BIGINT AS size_bytes, sha256, 8 AS width, 8 AS height, 'GRAY8' AS format,
               CASE WHEN frame_id % 4 <> 3 THEN frame_id * 33333333 END AS pts_ns, CASE WHEN frame_id % 4 <> 3 THEN 33333333::BIGINT END AS duration_ns,
               concat_ws(',', CASE WHEN frame_id % 4 <> 3 THEN 'telemetry' END, 'geometry', CASE WHEN frame_id % 5 = 0 THEN 'detection' END) AS kinds
        FROM m""",
    "pixels",
)
def bundle_frame_metadata(t: Tables):
    members = bundles.bundle_members(t.spark, _bundle(t))
    return members.select(
        "source", "frame_id", file_name(F.col("name")).alias("name"), "size_bytes", "sha256", "metadata.video.width", "metadata.video.height",
        "metadata.video.format", "metadata.pts_ns", "metadata.duration_ns", F.array_join("metadata.meta_kinds", ",").alias("kinds"),
    )


@recipe(
    "k5_manifest",
    BUNDLE_SQL
    + """ SELECT 'r-1' AS request_id, 'cam' AS sensor_id, count(DISTINCT source) AS source_count, count(*) AS frame_count, 64 * count(*) AS size_bytes,
               0 AS first_index, (SELECT max(frame_id) FROM m WHERE source = (SELECT max(source) FROM m)) AS last_index, 0::BIGINT AS unsound FROM m""",
    "pixels",
)
def bundle_manifest(t: Tables):
    path = _bundle(t)
    found = bundles.read_manifest(t.spark, path)
    row = [found[k] for k in ("request_id", "sensor_id", "source_count", "frame_count", "size_bytes")]
    row += [found[f"{end}_frame_metadata"]["index"] for end in ("first", "last")]
    names = "request_id string, sensor_id string, source_count bigint, frame_count bigint, size_bytes bigint, first_index bigint, last_index bigint"
    return t.spark.createDataFrame([[*row, bundles.verify_bundle(t.spark, path).count()]], f"{names}, unsound bigint")


CROP_BOXES = [
    "vec_id AS frame_id",
    "inline(array(named_struct('target_index', 0L, 'x_min', vec_id % 7 - 1.5D, 'y_min', vec_id % 5 + 0.25D, "
    "'x_max', vec_id % 7 + 2.5D, 'y_max', vec_id % 5 + 2.0D), named_struct('target_index', 1L, 'x_min', 6.5D, "
    "'y_min', 7.5D - vec_id % 9, 'x_max', 12.0D, 'y_max', 8.0D - vec_id % 9)))",
]
CROP_SQL = """, t AS (
    SELECT vec_id AS frame_id, label, 0 AS i, greatest(0, floor(vec_id % 7 - 1.5)::BIGINT) AS x0, greatest(0, vec_id % 5) AS y0,
           least(8, ceil(vec_id % 7 + 2.5)::BIGINT) AS x1, least(8, vec_id % 5 + 2) AS y1 FROM embeddings
    UNION ALL SELECT vec_id, label, 1, 6, greatest(0, floor(7.5 - vec_id % 9)::BIGINT), 8, least(8, 8 - vec_id % 9) FROM embeddings)
    SELECT p.frame_id, 'c_' || label AS class_dir, printf('f%06d_d%d', p.frame_id, i::BIGINT) AS name, (x1 - x0)::INT AS width,
           (y1 - y0)::INT AS height, string_agg(printf('%02X', v::BIGINT), '' ORDER BY y, x) AS pixels
    FROM pixels p JOIN t ON p.frame_id = t.frame_id AND p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1 GROUP BY ALL"""


def _crop_boxes(t: Tables):
    labels = t.embeddings.selectExpr("vec_id AS frame_id", "concat('c/', label) AS type")
    return t.embeddings.selectExpr(*CROP_BOXES).join(labels, "frame_id")


@recipe("k6_crops_by_class", CROP_SQL, "pixels")
def crops_by_class(t: Tables):
    crops = products.crop_records(_dense_frames(t), _crop_boxes(t), ["frame_id"])
    path = scratch_path(t.spark, "crops")
    products.write_crops(crops, path)
    written = t.spark.read.parquet(path)
    return written.withColumn("pixels", F.hex("pixels")).select("frame_id", "class_dir", "name", "width", "height", "pixels")


@recipe(
    "k7_run_row",
    """SELECT source, count(*) AS frame_count, sum(size_bytes)::BIGINT AS bytes, count(*) > 300 AS over_limit,
              CASE WHEN count(*) > 300 THEN 'failed' ELSE 'completed' END AS status, round(count(*) / 4.0, 6)::DOUBLE AS frames_per_second
       FROM artifacts GROUP BY 1""",
    "artifacts",
)
def run_row(t: Tables):
    path = scratch_path(t.spark, "runs")
    products.run_row(t.artifacts(), 300).write.mode("append").parquet(path)
    runs = t.spark.read.parquet(path)
    return runs.withColumn("frames_per_second", F.round(frames_per_second(F.col("frame_count"), F.lit(4.0)), 6))


# ---- L: vision ---------------------------------------------------------------------------------------


@recipe(
    "l1_tile_grid",
    """, s AS (SELECT o_orderkey AS frame_id, 640 + o_custkey % 3457 AS width, 640 + (o_custkey * 7) % 3457 AS height FROM orders),
        n AS (SELECT *, ceil((width - 640) / 500.0)::BIGINT + 1 AS nx, ceil((height - 640) / 500.0)::BIGINT + 1 AS ny FROM s)
       SELECT frame_id, i AS tile_index, least(i % nx * 500, width - 640) AS x_offset, least(i // nx * 500, height - 640) AS y_offset
       FROM n, LATERAL (SELECT unnest(range(nx * ny)) AS i)""",
    "categories",
)
def tile_grid(t: Tables):
    frames = t.orders.selectExpr("o_orderkey AS frame_id", "640 + o_custkey % 3457 AS width", "640 + (o_custkey * 7) % 3457 AS height")
    return tiles.tile_grid(frames, 640).drop("width", "height")


def _tiles(t: Tables):
    """4 x 4 tiles of the dense 8 x 8 images, three per axis."""
    return tiles.cut_tiles(_dense_frames(t), 4)


@recipe(
    "l2_cut_tiles",
    """, g AS (SELECT (i % 3) AS tx, (i // 3) AS ty, i::BIGINT AS tile_index, least(i % 3 * 3, 4) AS x0, least(i // 3 * 3, 4) AS y0 FROM range(9) r(i))
       SELECT frame_id, tile_index, (y - y0)::BIGINT AS y, (x - x0)::BIGINT AS x, v FROM pixels JOIN g ON x >= x0 AND x < x0 + 4 AND y >= y0 AND y < y0 + 4""",
    "pixels",
)
def cut_tiles(t: Tables):
    named = _tiles(t).withColumnRenamed("tile", "pixels")
    return _bytes_as_values(named, 4, ["frame_id", "tile_index"])


@recipe(
    "l3_channels",
    """, o AS (SELECT frame_id, (y * 8 + x) AS p, v FROM pixels
                 UNION ALL SELECT frame_id, 64 + k, 0 FROM (SELECT DISTINCT frame_id FROM pixels), range(2) z(k)),
        g AS (SELECT r.frame_id, r.p // 3 AS pixel, ((r.v::BIGINT * 4899 + g.v::BIGINT * 9617 + b.v::BIGINT * 1868 + 8192) >> 14)::SMALLINT AS gray
              FROM o r JOIN o g ON g.frame_id = r.frame_id AND g.p = r.p + 1 JOIN o b ON b.frame_id = r.frame_id AND b.p = r.p + 2 WHERE r.p % 3 = 0)
       SELECT g.frame_id, g.pixel, gray, r.v AS blue_first, o.v AS replicated FROM g
       JOIN o r ON r.frame_id = g.frame_id AND r.p = g.pixel * 3 + 2 JOIN o ON o.frame_id = g.frame_id AND o.p = g.pixel // 3""",
    "pixels",
)
def channels(t: Tables):
    """All values and two zeros read as 22 RGB pixels; gray values repeated for three channels."""
    zeros = F.array_repeat(F.lit(0).cast("smallint"), 2)
    rgb = t.images().select("frame_id", "pixels", F.concat("pixels", zeros).alias("rgb"))
    shaped = rgb.select(
        "frame_id",
        pixels.rgb_to_gray(F.col("rgb")).alias("gray"),
        pixels.swap_red_blue(F.col("rgb")).alias("bgr"),
        pixels.gray_to_channels(F.col("pixels")).alias("triple"),
    )
    return shaped.select("frame_id", "bgr", "triple", F.posexplode("gray").alias("pixel", "gray")).select(
        "frame_id",
        F.col("pixel").cast("bigint").alias("pixel"),
        "gray",
        F.get("bgr", F.col("pixel") * 3).alias("blue_first"),
        F.get("triple", F.col("pixel")).alias("replicated"),
    )


def _make_sum_model():
    def predict(batch):
        return batch.sum(axis=1).astype("float64")

    return predict


@recipe(
    "l4_score_tiles",
    """, g AS (SELECT i::BIGINT AS tile_index, least(i % 3 * 3, 4) AS x0, least(i // 3 * 3, 4) AS y0 FROM range(9) r(i))
       SELECT frame_id, tile_index, sum(v)::DOUBLE AS score FROM pixels JOIN g ON x >= x0 AND x < x0 + 4 AND y >= y0 AND y < y0 + 4 GROUP BY 1, 2""",
    "pixels",
)
def score_tiles(t: Tables):
    scored = tiles.score_dense_tiles(_tiles(t), _make_sum_model, DoubleType(), name="score")
    return scored.select("frame_id", "tile_index", "score")


DECODED_SQL = """SELECT vec_id, label, list_position(embedding[5:], list_max(embedding[5:])) - 1 AS class_index, list_max(embedding[5:])::DOUBLE AS score,
      embedding[1]::DOUBLE - abs(embedding[3]::DOUBLE) / 2 AS x_min, embedding[2]::DOUBLE - abs(embedding[4]::DOUBLE) / 2 AS y_min,
      embedding[1]::DOUBLE + abs(embedding[3]::DOUBLE) / 2 AS x_max, embedding[2]::DOUBLE + abs(embedding[4]::DOUBLE) / 2 AS y_max
    FROM embeddings WHERE list_max(embedding[5:]) > 0.25::FLOAT"""


def _decoded(t: Tables):
    raw = t.embeddings.selectExpr(
        "vec_id", "label", "transform(embedding, (e, i) -> CASE WHEN i IN (2, 3) THEN abs(e) ELSE e END) AS raw"
    )
    decoded = tiles.decode_boxes(raw, "raw", 60, 0.25).drop("raw")
    return decoded.withColumn("score", F.col("score").cast("double"))


@recipe("l5_decode_boxes", DECODED_SQL)
def decode_boxes(t: Tables):
    return _decoded(t)


@recipe(
    "l6_untile",
    f"""SELECT vec_id, score, x_min + (vec_id % 8) * 500 AS x_min, y_min + (vec_id % 5) * 500 AS y_min,
               x_max + (vec_id % 8) * 500 AS x_max, y_max + (vec_id % 5) * 500 AS y_max FROM ({DECODED_SQL})""",
)
def untile(t: Tables):
    placed = _decoded(t).selectExpr("*", "vec_id % 8 * 500 AS x_offset", "vec_id % 5 * 500 AS y_offset")
    return tiles.untile(placed).select("vec_id", "score", *Box._fields)


def greedy_sql(source: str, group: str, order: str, columns: str, limit: int | None, same_class: bool) -> str:
    """Greedy suppression as a recursive query that carries the kept ranks of each group."""
    cut = f"WHERE r <= {limit}" if limit else ""
    klass = "AND a.class_index = b.class_index" if same_class else ""
    return f""" RECURSIVE ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS r FROM ({source})) {cut}),
      hits AS (SELECT b.{group}, b.r, list(a.r) AS rivals FROM ranked a JOIN ranked b ON a.{group} = b.{group} AND a.r < b.r {klass}
               WHERE {IOU_SQL} > 0.45 GROUP BY 1, 2),
      steps AS (SELECT k.{group}, k.r, coalesce(rivals, []) AS rivals FROM ranked k LEFT JOIN hits h ON h.{group} = k.{group} AND h.r = k.r),
      walk AS (SELECT {group}, 0::BIGINT AS r, []::BIGINT[] AS kept FROM (SELECT DISTINCT {group} FROM ranked)
               UNION ALL SELECT w.{group}, s.r, CASE WHEN list_has_any(w.kept, s.rivals) THEN w.kept ELSE list_append(w.kept, s.r) END
               FROM walk w JOIN steps s ON s.{group} = w.{group} AND s.r = w.r + 1),
      final AS (SELECT {group}, unnest(arg_max(kept, r)) AS r FROM walk GROUP BY 1)
      SELECT {columns} FROM ranked JOIN final USING ({group}, r)"""


KEPT = "frame, class_index, score, l_orderkey, l_partkey"


def _greedy_dense(limit: int | None) -> str:
    from framelake.recipes.tables import VIEWS

    return "WITH" + greedy_sql(VIEWS["dense"], "frame", BEST_FIRST, KEPT, limit, True)


@recipe("l7_suppress", _greedy_dense(500))
def suppress_top(t: Tables):
    kept = suppress(t.dense(), ["frame"], best_first(), class_column="class_index")
    return kept.select("frame", "class_index", "score", "l_orderkey", "l_partkey")


@recipe("l7_suppress_all", _greedy_dense(None))
def suppress_all(t: Tables):
    kept = suppress(t.dense(), ["frame"], best_first(), top_k=None, class_column="class_index")
    return kept.select("frame", "class_index", "score", "l_orderkey", "l_partkey")


LARGE_SQL = """SELECT l_orderkey % 100 AS frame, {score} AS score, (l_partkey % 400)::DOUBLE AS x_min, (l_suppkey % 400)::DOUBLE AS y_min,
    l_partkey % 400 + l_quantity AS x_max, l_suppkey % 400 + l_quantity AS y_max, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem"""


def _large(t: Tables, score: str):
    """A few frames of a hundredth of all line items each: over the size of one row from the second smallest scale on."""
    boxes = t.lineitem.selectExpr(
        "l_orderkey % 100 AS frame", f"{score} AS score", "CAST(l_partkey % 400 AS DOUBLE) AS x_min", "CAST(l_suppkey % 400 AS DOUBLE) AS y_min",
        "l_partkey % 400 + l_quantity AS x_max", "l_suppkey % 400 + l_quantity AS y_max", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    )
    kept = suppress(boxes, ["frame"], best_first(), top_k=None)
    return kept.select("frame", "score", "l_orderkey", "l_partkey", "l_linenumber")


def _large_sql(score: str) -> str:
    """Greedy suppression in rounds: what has no undecided better rival is kept, what has a kept rival goes."""
    return f"""WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {BEST_FIRST}) AS r FROM ({LARGE_SQL.format(score=score)})),
      hits AS (SELECT b.frame, b.r, list(a.r) AS rivals FROM ranked a JOIN ranked b ON a.frame = b.frame AND a.r < b.r WHERE {IOU_SQL} > 0.45 GROUP BY 1, 2),
      walk AS (SELECT frame, r, coalesce(rivals, []) AS rivals, 0 AS state FROM ranked k LEFT JOIN hits h USING (frame, r)
        UNION ALL (WITH u AS (SELECT * FROM walk WHERE state = 0), l AS (SELECT frame, list(r) AS rs FROM u GROUP BY 1),
          n AS (SELECT frame, r, rivals, NOT list_has_any(rivals, rs) AS best FROM u JOIN l USING (frame)),
          k AS (SELECT frame, list(r) FILTER (best) AS ks FROM n GROUP BY 1)
          SELECT frame, r, rivals, best::INT FROM n JOIN k USING (frame) WHERE best OR NOT list_has_any(rivals, ks)))
      SELECT frame, score, l_orderkey, l_partkey, l_linenumber FROM ranked JOIN (SELECT frame, r FROM walk WHERE state = 1) USING (frame, r)"""


@recipe("l7_suppress_large", _large_sql("l_extendedprice"))
def suppress_large(t: Tables):
    return _large(t, "l_extendedprice")


@recipe("l7_suppress_ties", _large_sql("l_tax"))
def suppress_ties(t: Tables):
    """Nine different scores only."""
    return _large(t, "l_tax")


@recipe(
    "l7_decode_and_suppress",
    "WITH" + greedy_sql(DECODED_SQL, "label", "-score, vec_id", "vec_id, label, score", 500, False),
)
def decode_and_suppress(t: Tables):
    kept = suppress(_decoded(t), ["label"], [-F.col("score"), F.col("vec_id")])
    return kept.select("vec_id", "label", "score")


def _make_box_model():
    """One vector per tile: a box around its centre and two class scores made of its sum (exact in float32)."""

    def predict(batch):
        sums = batch.sum(axis=1).astype("int64")
        return [[[2.0, 2.0, 8.0, 8.0, s / 4096, (s * 7) % 4096 / 4096]] for s in sums.tolist()]

    return predict


DETECTOR_SQL = (
    """WITH RECURSIVE px AS (SELECT vec_id AS frame_id, (i // 8)::BIGINT AS y, (i % 8)::BIGINT AS x, round(255 * abs(embedding[i + 1]::DOUBLE))::BIGINT AS v
             FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS i)),
        g AS (SELECT i::BIGINT AS tile_index, least(i % 3 * 3, 4) AS x0, least(i // 3 * 3, 4) AS y0 FROM range(9) r(i)),
        t AS (SELECT frame_id, tile_index, x0, y0, sum(v)::BIGINT AS s FROM px JOIN g ON x >= x0 AND x < x0 + 4 AND y >= y0 AND y < y0 + 4 GROUP BY ALL),
        raw AS (SELECT frame_id, tile_index, CASE WHEN s >= (s * 7) % 4096 THEN 0 ELSE 1 END::BIGINT AS class_index,
                  greatest(s, (s * 7) % 4096) / 4096::DOUBLE AS score, x0 - 2.0::DOUBLE AS x_min, y0 - 2.0::DOUBLE AS y_min, x0 + 6.0::DOUBLE AS x_max,
                  y0 + 6.0::DOUBLE AS y_max FROM t WHERE greatest(s, (s * 7) % 4096) > 1024),"""
    + greedy_sql("SELECT * FROM raw", "frame_id", "-score, tile_index", "*", 500, True).replace(" RECURSIVE ranked", " ranked").replace(
        "SELECT * FROM ranked JOIN final USING (frame_id, r)",
        """SELECT frame_id, class_index, score AS confidence, greatest(0.0, x_min) AS x_min, greatest(0.0, y_min) AS y_min,
              least(8.0, x_max) AS x_max, least(8.0, y_max) AS y_max, row_number() OVER (PARTITION BY frame_id ORDER BY -score, tile_index)::INT AS rank
           FROM ranked JOIN final USING (frame_id, r)""",
    )
)


@recipe("l_detector_product", DETECTOR_SQL)
def detector_product(t: Tables):
    """Frames to boxes: tiles, model, decoding, suppression over all tiles of a frame, clamping, record limit."""
    return detect(_dense_frames(t), _make_box_model, 4, 2, ["frame_id"])


RESAMPLE_SQL = """, g AS (SELECT vec_id AS frame_id, 0.5::DOUBLE * (1 + vec_id % 3) AS s, (vec_id % 2)::DOUBLE AS o FROM embeddings),
    d AS (SELECT frame_id, x::BIGINT AS x, y::BIGINT AS y, (x - o) / s AS sx, (y - o) / s AS sy FROM g, range(10) a(x), range(9) b(y))
    SELECT d.frame_id, d.y, d.x, coalesce(p.v, 0)::SMALLINT AS v FROM d LEFT JOIN pixels p
      ON p.frame_id = d.frame_id AND p.x = trunc(sx) AND p.y = trunc(sy) AND sx >= 0 AND sy >= 0 AND sx < 8 AND sy < 8"""


@recipe("l8_resample_nearest", RESAMPLE_SQL, "pixels")
def resample(t: Tables):
    scale, offset = F.expr("0.5D * (1 + frame_id % 3)"), F.expr("CAST(frame_id % 2 AS DOUBLE)")
    mapped = pixels.resample_nearest(
        F.col("pixels"), F.lit(8), F.lit(8), (scale, scale), (offset, offset), F.lit(10), F.lit(9)
    )
    return pixels.to_long(t.images().select("frame_id", mapped.alias("pixels")), "pixels", F.lit(10), ["frame_id"])


def _bytes_as_values(dense, width: int, keys: list[str] = ["frame_id"]):
    values = F.transform(
        F.sequence(F.lit(1), F.length("pixels")),
        lambda i: F.conv(F.hex(F.substring(F.col("pixels"), i, F.lit(1))), 16, 10).cast("smallint"),
    )
    return pixels.to_long(dense.select(*keys, values.alias("pixels")), "pixels", F.lit(width), keys)


# Pixel centres of a 10 x 6 plane in an 8 x 8 image, edges repeated.
BILINEAR_SQL = """, d AS (SELECT frame_id, x::BIGINT AS x, y::BIGINT AS y, greatest(0.0, least(7.0, (x + 0.5::DOUBLE) * (8::DOUBLE / 10) - 0.5::DOUBLE)) AS ax,
              greatest(0.0, least(7.0, (y + 0.5::DOUBLE) * (8::DOUBLE / 6) - 0.5::DOUBLE)) AS ay
            FROM (SELECT vec_id AS frame_id FROM embeddings), range(10) a(x), range(6) b(y)),
        e AS (SELECT *, floor(ax)::BIGINT AS x0, floor(ay)::BIGINT AS y0, least(floor(ax)::BIGINT + 1, 7) AS x1, least(floor(ay)::BIGINT + 1, 7) AS y1,
              ax - floor(ax) AS fx, ay - floor(ay) AS fy FROM d)
       SELECT e.frame_id, e.y, e.x, floor((a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + g.v * fx) * fy + 0.5)::SMALLINT AS v
       FROM e JOIN pixels a ON a.frame_id = e.frame_id AND a.x = x0 AND a.y = y0 JOIN pixels b ON b.frame_id = e.frame_id AND b.x = x1 AND b.y = y0
       JOIN pixels c ON c.frame_id = e.frame_id AND c.x = x0 AND c.y = y1 JOIN pixels g ON g.frame_id = e.frame_id AND g.x = x1 AND g.y = y1"""


@recipe("l9_bilinear", BILINEAR_SQL, "pixels")
def bilinear(t: Tables):
    resized = pixels.resize_dense("pixels", "width", "height", F.lit(10), F.lit(6))
    return _bytes_as_values(_dense_frames(t).select("frame_id", resized.alias("pixels")), 10)


@recipe("l8_resample_dense", RESAMPLE_SQL, "pixels")
def resample_dense(t: Tables):
    """The same map over BINARY frames through Arrow."""
    scale, offset = F.expr("0.5D * (1 + frame_id % 3)"), F.expr("CAST(frame_id % 2 AS DOUBLE)")
    mapped = pixels.resample_dense("pixels", "width", "height", scale, scale, offset, offset, F.lit(10), F.lit(9))
    return _bytes_as_values(_dense_frames(t).select("frame_id", mapped.alias("pixels")), 10)


@recipe(
    "l9_block_mean",
    "SELECT frame_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM pixels GROUP BY 1, 2, 3",
    "pixels",
)
def block_mean(t: Tables):
    small = t.images().select("frame_id", pixels.block_mean(F.col("pixels"), 8, 8, 2).alias("pixels"))
    return pixels.to_long(small, "pixels", F.lit(4), ["frame_id"])


@recipe("l10_crop", CROP_SQL, "pixels")
def crop(t: Tables):
    from framelake.functions.names import class_folder, crop_name

    rect = crop_window(Box.of(), F.lit(8), F.lit(8))
    joined = _crop_boxes(t).withColumns(dict(zip(Box._fields, rect))).join(t.images(), "frame_id")
    cut = pixels.cut(F.col("pixels"), F.lit(8), Box.of())
    return (
        joined.where("x_max > x_min AND y_max > y_min")
        .select(
            "frame_id",
            class_folder(F.col("type")).alias("class_dir"),
            crop_name(F.col("frame_id"), F.col("target_index")).alias("name"),
            (F.col("x_max") - F.col("x_min")).cast("int").alias("width"),
            (F.col("y_max") - F.col("y_min")).cast("int").alias("height"),
            F.array_join(F.transform(cut, lambda v: F.lpad(F.hex(v), 2, "0")), "").alias("pixels"),
        )
    )
