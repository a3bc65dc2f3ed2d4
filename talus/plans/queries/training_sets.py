"""Curation: labels, dedup, manifests, shards, splits, packing and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import text as X
from talus.operators import curation as K, hierarchy as H, ordering as O, rows, sampling
from talus.plans import dataset_build as B
from talus.plans.registry import query
from talus.session import scratch
from talus.sources import files
from talus.sources.tables import FILTER_VERSION

SEED = 42
MAX_BATCH = 64


def manifest_of(c):
    return K.full_manifest(c.route_images, c.routes, c.areas, H.lineages(c.areas))


def train_rows_of(c, shard_size: int = 50):
    return B.training_set(manifest_of(c), c.filter_scores, FILTER_VERSION, 0.2, shard_size)


def manifest_groups_of(c):
    return K.route_groups(manifest_of(c), "route_image_id")


@query("M12 P11 F18 W4 A7", """
    SELECT doc_id, str_label, dense_rank() OVER (ORDER BY str_label) - 1 AS label FROM (
        SELECT *, count(*) OVER (PARTITION BY str_label) AS n FROM (SELECT doc_id, source || '|' || CASE lang WHEN 'es' THEN 'None' ELSE lang END AS str_label FROM documents)) WHERE n > 1""")
def multiview_photos(c):
    photos = c.table("documents").select(
        "doc_id", F.col("source").alias("route_lineage"), F.when(F.col("lang") != "es", F.col("lang")).alias("route_name"))
    return K.multiview(photos).select("doc_id", "str_label", "label")


@query("M12 P11 F18", """
    SELECT url, str_label, dense_rank() OVER (ORDER BY str_label) - 1 AS label FROM (
        SELECT 'lineage|' || doc_id AS str_label, unnest([doc_id || '_a', doc_id || '_b']) AS url FROM documents WHERE n_chars > 300)""")
def multiview_from_image_lists(c):
    a, b = (F.concat(F.col("doc_id").cast("string"), F.lit(s)) for s in ("_a", "_b"))
    routes = c.table("documents").select(
        F.lit("lineage").alias("route_lineage"), F.col("doc_id").cast("string").alias("route_name"),
        F.when(F.col("n_chars") > 300, F.array(a, b)).otherwise(F.array(a)).alias("images"))
    return K.multiview_from_lists(routes).select("url", "str_label", "label")


@query("W3 F6 S7 U2", """
    SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY md5(content) ORDER BY id) AS rn FROM route_images
        WHERE md5(content) NOT IN (SELECT md5(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1)) WHERE rn = 1""")
def deduplicated_photos(c):
    path = scratch(c.spark, "hashes")
    toxic = c.table("labels").where("toxic = 1").select("doc_id")
    c.table("documents").join(toxic, "doc_id", "left_semi").select(F.md5("text").alias("digest")).write.parquet(path)
    photos = c.route_images.select("id", F.md5("content").alias("digest"))
    return rows.first_by_hash(photos, "digest", "id", files.read_hashes(c.spark, path)).select("id")


@query("J11 Z9 P15", """
    SELECT p.doc_id, m.title, m.n AS words FROM (SELECT doc_id, source AS url FROM documents) p
    JOIN (SELECT source AS url, arg_max(lang, doc_id) AS title, arg_max(n_chars, doc_id) AS n FROM documents GROUP BY 1) m ON m.url = p.url""")
def last_metadata_per_url(c):
    docs = c.table("documents")
    metadata = docs.select(F.col("source").alias("url"), F.col("lang").alias("title"), F.col("n_chars").alias("words"), F.col("doc_id").alias("pos"))
    return K.last_metadata(docs.select("doc_id", F.col("source").alias("url")), metadata, "url", "pos").select("doc_id", "title", "words")


@query("P15 J6", """
    SELECT i.id, s.route_image_id IS NOT NULL AS keep FROM route_images i LEFT JOIN (SELECT route_image_id FROM filter_scores WHERE keep) s ON s.route_image_id = i.id""")
def membership_labels(c):
    chosen = c.filter_scores.where("keep").select(F.col("route_image_id").alias("id"), F.lit(True).alias("_in"))
    return c.route_images.select("id").join(chosen, "id", "left").select("id", F.col("_in").isNotNull().alias("keep"))


@query("R4 P5 W1 T4 P14", """
    SELECT route_image_id, image_url, route_id, route_name, grade, area_id, area_name, area_path, area_depth,
           row_number() OVER (ORDER BY area_id, route_id, route_image_id) AS position FROM manifest""")
def full_manifest(c):
    columns = ["route_image_id", "image_url", "route_id", "route_name", "grade", "area_id", "area_name", "area_path", "area_depth"]
    return K.in_manifest_order(manifest_of(c).select(*columns), K.FULL_ORDER)


@query("W1 P5 R4", """
    SELECT route_image_id, route_id, n FROM (
        SELECT i.id AS route_image_id, r.id AS route_id, count(*) OVER (PARTITION BY r.id) AS n FROM route_images i
        JOIN routes r ON r.id = i.route_id JOIN area_paths p ON p.id = r.area_id WHERE i.id % 10 <= (i.id // 10) % 4 AND i.id % 20 <> 11) WHERE n >= 2""")
def manifest_of_sparse_routes(c):
    """Routes of none to four usable photos: every route keeps as many as its number tells, and some have no url."""
    photos = c.route_images.where(F.expr("id % 10 <= (id div 10) % 4")).withColumn("image_url", F.when(F.col("id") % 40 == 11, "").when(F.col("id") % 20 != 11, F.col("image_url")))
    rows_ = K.full_manifest(photos, c.routes, c.areas, H.lineages(c.areas))
    counts = rows_.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    return rows_.join(counts, "route_id").select("route_image_id", "route_id", "n")


@query("A5 A6 K1", """
    SELECT count(*) AS images, count(DISTINCT route_id) AS routes, count(DISTINCT area_id) AS areas, min(area_depth) AS shallowest, max(area_depth) AS deepest FROM manifest""")
def manifest_file_summary(c):
    """The manifest written as CSV, read back with its schema and counted."""
    path = scratch(c.spark, "manifest")
    columns = ["route_image_id", "image_url", "route_id", "route_name", "grade", "area_id", "area_name", "area_path", "area_depth"]
    files.write_csv(manifest_of(c).select(*columns), path)
    schema = "route_image_id long, image_url string, route_id long, route_name string, grade string, area_id long, area_name string, area_path string, area_depth int"
    back = files.read_csv(c.spark, path, schema)
    return back.agg(
        F.count(F.lit(1)).alias("images"), F.countDistinct("route_id").alias("routes"), F.countDistinct("area_id").alias("areas"),
        F.min("area_depth").alias("shallowest"), F.max("area_depth").alias("deepest"))


@query("P1 P14 T4 J1", """
    SELECT i.id AS image_id, i.route_id, r.area_id, 'images/routes/' || i.route_id || '/' || i.id || '.jpg' AS b2_key, i.route_id AS label,
           row_number() OVER (ORDER BY i.route_id, i.created_at, i.id) AS position
    FROM images i JOIN routes r ON r.id = i.route_id WHERE i.status = 'approved'""")
def field_photo_manifest(c):
    key = F.concat(F.lit("images/routes/"), F.col("route_id").cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".jpg"))
    return K.in_manifest_order(K.field_manifest(c.images.withColumn("b2_key", key), c.routes), K.FIELD_ORDER).drop("created_at")


@query("P3 P2 J7 W2 W1 F17 M11 K3", """
    SELECT idx, idx // 50 AS shard, route_image_id, route_id, round(filter_score::DOUBLE, 4) AS filter_score, coalesce(description, '') AS description, '' AS gps FROM train_rows""")
def training_set(c):
    rows_ = train_rows_of(c)
    return rows_.select("idx", "shard", "route_image_id", "route_id", F.round(F.col("filter_score").cast("double"), 4).alias("filter_score"), "description", "gps")


@query("K3 S8 F20", """
    SELECT printf('train-%05d', idx // 50) AS name, count(*) AS n, sum(route_image_id)::BIGINT AS ids FROM train_rows GROUP BY 1""")
def training_shards(c):
    path = scratch(c.spark, "shards")
    files.write_shards(train_rows_of(c), path)
    back = files.read_shards(c.spark, path)
    return back.groupBy(K.shard_name(F.col("shard")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("route_image_id").alias("ids"))


MISSING = "route_image_id % 9 = 4"  # photos that are not stored
HAVE = f"SELECT *, row_number() OVER (ORDER BY filter_score DESC, route_image_id) - 1 AS place FROM train_rows WHERE NOT {MISSING}"


def _shards(c):
    photos = c.route_images.select(X.last_segment(F.col("image_url")).alias("url_name"), F.col("id").alias("route_image_id"), F.col("content").cast("binary").alias("content"))
    photos = photos.where(~F.expr(MISSING)).withColumnRenamed("url_name", "name")
    return B.shard_rows(manifest_of(c), c.filter_scores, photos, FILTER_VERSION, 0.2, 50)


@query("K3 S8 S9 M11 F20", """
    SELECT printf('train-%05d.parquet', place // 50) AS file, h.route_image_id::INT AS route_image_id, md5(i.content) AS bytes_md5, h.route_id::INT AS route_id,
           coalesce(h.description, '') AS description, '' AS gps, round(h.filter_score::DOUBLE, 4) AS filter_score, 'best' AS filter_model_version
    FROM have h JOIN route_images i ON i.id = h.route_image_id""", have=HAVE)
def training_shard_files(c):
    """Shards with the bytes of the photos written as train-%05d.parquet and read back; each row with its file."""
    path = scratch(c.spark, "shard-files")
    rows_, _ = _shards(c)
    files.write_named_shards(rows_, path)
    back = files.read_named_shards(c.spark, path)
    return back.select("file", "route_image_id", F.md5("image.bytes").alias("bytes_md5"), "route_id", "description", "gps", F.round(F.col("filter_score").cast("double"), 4).alias("filter_score"), "filter_model_version")


@query("K3 M11", f"SELECT count(*) FILTER (WHERE NOT {MISSING}) AS written, count(*) FILTER (WHERE {MISSING}) AS skipped FROM train_rows")
def shard_counters(c):
    return _shards(c)[1]


@query("K4 W10 A7", """
    SELECT batch, count(*) AS n, count(DISTINCT source) AS groups FROM (SELECT source, (dense_rank() OVER (ORDER BY source) - 1) // 5 + 1 AS batch FROM documents) GROUP BY 1""")
def batch_folders(c):
    """Whole sources, five to a batch, written as batch folders and read back."""
    path = scratch(c.spark, "batches")
    files.write_batches(K.batch_of_groups(c.table("documents").select("doc_id", "source"), "source", 5), path)
    return c.spark.read.parquet(path).groupBy(F.col("batch").cast("long").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("groups"))


@query("W10", "SELECT id, (row_number() OVER (ORDER BY image_url) - 1) // 500 AS batch FROM route_images")
def row_batches(c):
    return K.batch_of_rows(c.route_images.select("id", "image_url"), ["image_url"], 500).select("id", "batch")


@query("T9", "SELECT id, image_url FROM route_images ORDER BY route_id, id LIMIT 150")
def first_photos(c):
    return c.route_images.select("id", "image_url", "route_id").orderBy("route_id", "id").limit(150).select("id", "image_url")


@query("A23", "SELECT route_id, n, first_idx, area_path FROM train_groups")
def training_route_groups(c):
    return K.route_groups(train_rows_of(c)).select("route_id", "n", "first_idx", "area_path")


SPLIT = """
    SELECT route_id, n, before::BIGINT AS before, CASE WHEN before < floor({train}::DOUBLE * total) THEN 'train'
           WHEN before < floor({train}::DOUBLE * total) + floor({val}::DOUBLE * total) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY {path}, first_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM {source})"""


@query("W5 Z14", SPLIT.format(train=0.8, val=0.1, source="train_groups", path="area_path"))
def contiguous_split(c):
    return K.contiguous_split(K.route_groups(train_rows_of(c)), 0.8, 0.1).select("route_id", "n", "before", "split")


@query("W5 Z8", SPLIT.format(train=0.7, val=0.15, source="manifest_groups", path="replace(area_path, '/', chr(1))"))
def contiguous_split_depth_first(c):
    return K.contiguous_split(manifest_groups_of(c), 0.7, 0.15, true_dfs=True).select("route_id", "n", "before", "split")


@query("W5", f"SELECT r.idx, r.route_image_id, s.split FROM train_rows r JOIN ({SPLIT.format(train=0.8, val=0.1, source='train_groups', path='area_path')}) s USING (route_id)")
def split_photos(c):
    rows_ = train_rows_of(c)
    return K.rows_of(rows_, K.contiguous_split(K.route_groups(rows_), 0.8, 0.1), "split").select("idx", "route_image_id", "split")


@query("A22 W5", f"SELECT split, sum(n)::BIGINT AS images, count(*) AS routes FROM ({SPLIT.format(train=0.8, val=0.1, source='manifest_groups', path='area_path')}) GROUP BY 1")
def split_sizes(c):
    split = K.contiguous_split(manifest_groups_of(c), 0.8, 0.1)
    return split.groupBy("split").agg(F.sum("n").alias("images"), F.count(F.lit(1)).alias("routes"))


ORDERED = """
    SELECT epoch, route_id, n, row_number() OVER (PARTITION BY epoch ORDER BY {order}) AS rn FROM (
        SELECT e.epoch, g.*, md5('42|' || e.epoch || '|' || g.route_id) AS shuffle_key FROM manifest_groups g, (SELECT unnest(range(3)) AS epoch) e)"""
PACKED = """
    SELECT epoch, route_id, n, rn, n AS fill, 0::BIGINT AS batch FROM ordered WHERE rn = 1
    UNION ALL SELECT o.epoch, o.route_id, o.n, o.rn, CASE WHEN p.fill + o.n > 64 THEN o.n ELSE p.fill + o.n END, CASE WHEN p.fill + o.n > 64 THEN p.batch + 1 ELSE p.batch END
    FROM packed p JOIN ordered o ON o.epoch = p.epoch AND o.rn = p.rn + 1"""
RANDOM, LOCAL = "shuffle_key, route_id", "area_path, shuffle_key, route_id"


@query("W6 W9 Z16", "SELECT epoch, route_id, n, batch FROM packed", ordered=ORDERED.format(order=RANDOM), packed=PACKED)
def random_batches(c):
    orders = K.epoch_orders(manifest_groups_of(c), 3, SEED)
    return O.pack_batches(orders, "n", K.RANDOM_ORDER, MAX_BATCH).select("epoch", "route_id", "n", "batch")


@query("W6 W8", "SELECT epoch, route_id, n, batch FROM packed", ordered=ORDERED.format(order=LOCAL), packed=PACKED)
def local_batches(c):
    orders = K.epoch_orders(manifest_groups_of(c), 3, SEED)
    return O.pack_batches(orders, "n", K.LOCAL_ORDER, MAX_BATCH).select("epoch", "route_id", "n", "batch")


FIELD_ORDERED = """
    SELECT epoch, route_id, n, row_number() OVER (PARTITION BY epoch ORDER BY shuffle_key, route_id) AS rn FROM (
        SELECT e.epoch, g.*, md5('42|' || e.epoch || '|' || g.route_id) AS shuffle_key
        FROM (SELECT route_id, count(*) AS n FROM images GROUP BY 1) g, (SELECT unnest(range(3)) AS epoch) e)"""


@query("W6 W9", "SELECT epoch, route_id, n, batch FROM packed", ordered=FIELD_ORDERED, packed=PACKED)
def field_photo_batches(c):
    """Batches of field photos: groups of all sizes below and above the limit."""
    groups = c.images.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    return O.pack_batches(K.epoch_orders(groups, 3, SEED), "n", K.RANDOM_ORDER, MAX_BATCH).select("epoch", "route_id", "n", "batch")


@query("W8", "SELECT epoch, route_id, rn FROM ordered", ordered=ORDERED.format(order=LOCAL))
def local_route_order(c):
    return O.global_rank(K.epoch_orders(manifest_groups_of(c), 3, SEED), K.LOCAL_ORDER, ["epoch"], "rn").select("epoch", "route_id", "rn")


@query("W9", "SELECT epoch, route_id, rn FROM ordered", ordered=ORDERED.format(order=RANDOM))
def random_route_order(c):
    return O.global_rank(K.epoch_orders(manifest_groups_of(c), 3, SEED), K.RANDOM_ORDER, ["epoch"], "rn").select("epoch", "route_id", "rn")


@query("W7", "SELECT greatest(1, ceil(sum(n) / 64.0))::BIGINT AS batches FROM manifest_groups")
def batch_count_estimate(c):
    return O.batch_estimate(manifest_groups_of(c), "n", MAX_BATCH)


@query("X1", """
    SELECT id, keep, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM (
        SELECT route_image_id AS id, keep, row_number() OVER (PARTITION BY keep ORDER BY md5('42|' || route_image_id), route_image_id) AS rn, count(*) OVER (PARTITION BY keep) AS n FROM filter_scores)""")
def stratified_split(c):
    rows_ = c.filter_scores.select(F.col("route_image_id").alias("id"), "keep")
    return sampling.stratified_split(rows_, "keep", "id", 0.7, SEED).select("id", "keep", "split")


@query("A22", """
    SELECT split, keep, count(*) AS n FROM (SELECT keep, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM (
        SELECT keep, row_number() OVER (PARTITION BY keep ORDER BY md5('42|' || route_image_id), route_image_id) AS rn, count(*) OVER (PARTITION BY keep) AS n FROM filter_scores)) GROUP BY 1, 2""")
def split_class_counts(c):
    split = sampling.stratified_split(c.filter_scores.select("route_image_id", "keep"), "keep", "route_image_id", 0.8, SEED, ("train", "val"))
    return split.groupBy("split", "keep").agg(F.count(F.lit(1)).alias("n"))


@query("X2 U3", """
    SELECT id, keep FROM (SELECT route_image_id AS id, keep, row_number() OVER (PARTITION BY keep ORDER BY md5('42|' || route_image_id), route_image_id) AS rn FROM filter_scores) WHERE rn <= 100""")
def balanced_sample(c):
    return sampling.balanced_sample(c.filter_scores.select(F.col("route_image_id").alias("id"), "keep"), "keep", "id", 200, SEED)


@query("X3", """
    SELECT d.draw, r.id, r.keep FROM (
        SELECT draw, u < 0.5 AS keep, floor(v * CASE WHEN u < 0.5 THEN (SELECT count(*) FROM filter_scores WHERE keep) ELSE (SELECT count(*) FROM filter_scores WHERE NOT keep) END)::BIGINT + 1 AS rn FROM (
            SELECT draw, ('0x' || substr(md5('42|class|' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, ('0x' || substr(md5('42|row|' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS v
            FROM (SELECT unnest(range(1, (SELECT count(*) FROM filter_scores) + 1)) AS draw))) d
    JOIN (SELECT route_image_id AS id, keep, row_number() OVER (PARTITION BY keep ORDER BY route_image_id) AS rn FROM filter_scores) r ON r.keep = d.keep AND r.rn = d.rn""")
def weighted_draws(c):
    return sampling.weighted_draws(c.filter_scores.select(F.col("route_image_id").alias("id"), "keep"), "keep", "id", SEED)


@query("X4", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) AS rn FROM route_images) WHERE rn <= 120")
def bounded_subset(c):
    return sampling.bounded_subset(c.route_images.select("id"), "id", 120, SEED)


@query("A24", """
    SELECT count(DISTINCT source) AS labels, count(DISTINCT CASE WHEN l.doc_id IS NOT NULL THEN source END) AS done FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def annotation_progress(c):
    done = c.table("labels").select("doc_id", F.lit(True).alias("done"))
    per = c.table("documents").select("doc_id", "source").join(done, "doc_id", "left").groupBy("source").agg(F.max(F.coalesce("done", F.lit(False))).alias("done"))
    return per.agg(F.count(F.lit(1)).alias("labels"), F.count_if("done").alias("done"))


@query("A21 P4", """
    SELECT count(*) AS scored, count(*) FILTER (WHERE score >= 0.8) AS passed, round(100.0 * count(*) FILTER (WHERE score >= 0.8) / count(*), 4) AS passed_pct FROM filter_scores""")
def scoring_counters(c):
    passed = F.count_if(F.col("score") >= 0.8)
    total = F.count(F.lit(1))
    return c.filter_scores.agg(total.alias("scored"), passed.alias("passed"), F.round(F.lit(100.0) * passed / F.greatest(total, F.lit(1)), 4).alias("passed_pct"))


@query("S2 K1 P6", "SELECT url, label, keep FROM (SELECT 'https://x/' || route_image_id AS url, (route_image_id // 10)::INT AS label, keep FROM filter_scores) WHERE keep")
def annotation_file(c):
    """Annotations written as CSV and read back with the annotation schema; only the kept rows."""
    path = scratch(c.spark, "annotations")
    rows_ = c.filter_scores.select(
        F.concat(F.lit("https://x/"), F.col("route_image_id").cast("string")).alias("url"), F.lit("").alias("route_name"), F.lit("").alias("route_lineage"),
        F.lit("").alias("str_label"), F.expr("cast(route_image_id div 10 as int)").alias("label"), F.initcap(F.col("keep").cast("string")).alias("keep"))
    files.write_csv(rows_, path)
    return files.read_annotations(c.spark, path).where("keep").select("url", "label", "keep")


@query("S2 K1", """
    SELECT doc_id, md5(text) AS text_md5, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE replace(left(text, 200), 'e', chr(92)) || chr(13) || chr(10) || 'n' END AS description FROM documents""")
def texts_in_csv(c):
    """Whole texts, with their line breaks, and a column of nulls, blanks, backslashes and breaks, written as CSV and read
    back by as many tasks as the files have splits."""
    path = scratch(c.spark, "texts-csv")
    odd = F.concat(F.translate(F.substring("text", 1, 200), "e", chr(92)), F.lit("\r\nn"))
    rows_ = c.table("documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, odd).alias("description"))
    files.write_csv(rows_, path)
    return files.read_csv(c.spark, path, "doc_id long, text string, description string").select("doc_id", F.md5("text").alias("text_md5"), "description")


@query("S6 K9", "SELECT DISTINCT (doc_id // 10)::INT AS batch FROM documents")
def progress_file(c):
    path = scratch(c.spark, "progress")
    files.write_progress(c.route_images.select("route_id").distinct(), path)
    return files.read_progress(c.spark, path)


@query("S4", "SELECT image_url AS url FROM route_images UNION ALL SELECT replace(image_url, 'large', 'medium') FROM route_images")
def processed_keys_from_json(c):
    arrays = c.route_images.select(F.to_json(F.array(F.col("image_url"), X.medium_fallback(F.col("image_url")))).alias("j"))
    return files.key_array(arrays, "j")


@query("S5", """
    SELECT 'https://x/' || route_image_id AS url, 'r' || route_image_id AS route, CASE WHEN keep THEN 'keep' ELSE 'discard' END AS tag FROM filter_scores""")
def tags_from_json(c):
    tag = F.struct(F.concat(F.lit("r"), F.col("route_image_id").cast("string")).alias("route"), F.when(F.col("keep"), "keep").otherwise("discard").alias("tag"))
    objects = c.filter_scores.select(F.to_json(F.create_map(F.concat(F.lit("https://x/"), F.col("route_image_id").cast("string")), tag)).alias("j"))
    return files.tagged_map(objects, "j")


@query("S3 P1 P14", "SELECT id AS route_id, area_id, grade, name FROM routes WHERE status = 'approved'")
def approved_route_scan(c):
    return c.routes.where(F.col("status") == "approved").select(F.col("id").alias("route_id"), "area_id", "grade", "name")


@query("S9 J12", """
    SELECT d.source, s.bytes, count(*) AS documents FROM documents d
    JOIN (SELECT source, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents WHERE source NOT LIKE '%7' GROUP BY 1) s ON s.source = d.source GROUP BY 1, 2""")
def stored_file_contents(c):
    """Documents of all sources but those that end in 7 written as text files per source and read back as bytes; of all
    documents, those whose source has a file."""
    path = scratch(c.spark, "texts")
    docs = c.table("documents").select("source", "text")
    files.write_texts(docs.where(~F.col("source").endswith("7")), path, "source", "text")
    found = files.read_binary(c.spark, path, "*.txt").withColumn("source", F.regexp_extract("path", "source=([^/]+)/", 1))
    present = files.with_existing_file(docs, "source", found.select(F.col("source").alias("name")))
    counts = present.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    sizes = found.groupBy("source").agg(F.sum(F.length("content").cast("long")).alias("bytes"))
    return counts.join(sizes, "source").select("source", "bytes", "documents")
