"""Small cases in which an answer was wrong once."""

import numpy as np
from pyspark.sql import functions as F

from talus.functions import text as X
from talus.operators import catalogue as C, knn, pages, state as S
from talus.sources import files


def test_csv_keeps_line_breaks_blanks_and_quotes(spark, tmp_path):
    rows = [("a", "two\nlines"), ("b", ' "quoted", \r\n'), ("d", None), ("e", "back\\slash")]
    df = spark.createDataFrame(rows, "k string, v string")
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "out"), "k string, v string").collect()) == rows


def test_unknown_action_decides_nothing(spark):
    areas = spark.createDataFrame([(1, "unreviewed"), (2, "unreviewed")], "id long, status string")
    log = spark.createDataFrame([(1, 1, "aprove"), (1, 2, "approve"), (2, 1, "x")], "id long, seq long, action string")
    assert {r.id: r.status for r in S.first_decisions(areas, log).collect()} == {1: "approved", 2: "unreviewed"}
    events = log.select(F.col("id").alias("image_id"), "seq", "action", F.lit(0).cast("long").alias("correct_route_id"))
    assert [tuple(r) for r in S.review_decisions(events).collect()] == [(1, 2, True, None)]


def test_correction_to_an_unknown_route_changes_nothing(spark):
    decisions = spark.createDataFrame([(1, 1, True, 7), (1, 2, True, 9), (2, 1, False, None)], "image_id long, seq long, approved boolean, set_route long")
    routes = spark.createDataFrame([(7,)], "id long")
    left = {(r.image_id, r.seq) for r in S.known_corrections(decisions, routes).collect()}
    assert left == {(1, 1), (2, 1)}


def test_any_white_space_is_stripped(spark):
    areas = spark.createDataFrame([(1, "approved")], "id long, status string")
    rows = spark.createDataFrame([("\t\n", 1), ("a\t", 1), (" b\x1f", None)], "name string, parent_id long")
    got = {(r.name, r.reason) for r in S.area_suggestions(rows, areas).collect()}
    assert got == {("", "name is empty"), ("a", None), ("b", None)}


def test_fallback_replaces_every_large(spark):
    assert spark.range(1).select(X.medium_fallback(F.lit("h/large/a_large.jpg"))).first()[0] == "h/medium/a_medium.jpg"


def test_a_page_without_tables_has_no_links(spark):
    page = spark.createDataFrame([("u", '<nav><a href="x">x</a></nav>')], "url string, html string")
    assert pages.outgoing_links(page).count() == 0
    assert pages.outgoing_links(page, with_navigation=True).count() == 1


def test_more_query_vectors_than_a_block_holds(spark):
    rng = np.random.default_rng(0)
    vectors = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(1030)], "query_id long, vector array<double>")
    stored = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(5)], "image_id long, embedding array<float>")
    got = C.score_summary(vectors, stored, "image_id").collect()
    assert sorted(r.query_id for r in got) == list(range(1030)) and all(r.n == 5 for r in got)


def test_cells_are_fitted_on_all_rows(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(200)], "id long, vector array<double>")
    assert knn.build_cells(rows, lists=4).shape == (4, 4)


def test_csv_tells_null_from_blank_and_is_split(spark, tmp_path):
    odd = [None, "", "\\N", "\\", "\\n", "\\s", "\n", "\r\n", "a\\\nb", '"', '""', ",", " x ", " ", "#c", "\\\\N", "\x0b", "é\n"]
    rows = [(i, v, w) for i, (v, w) in enumerate((v, w) for v in odd for w in odd)]
    df = spark.createDataFrame(rows, "k int, v string, w string").repartition(2)
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), "k int, v string, w string")
    assert sorted(tuple(r) for r in back.collect()) == rows
    one = spark.createDataFrame([(i, "text\nwith breaks " * 40) for i in range(3000)], "k int, v string").coalesce(1)
    files.write_csv(one, str(tmp_path / "large"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        split = files.read_csv(spark, str(tmp_path / "large"), "k int, v string")
        assert split.rdd.getNumPartitions() > 8 and split.where(F.col("v") == "text\nwith breaks " * 40).count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_foreign_csv_keeps_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('url,route_name,route_lineage,str_label,label,keep\nu,"two\nlines",,x,3,TRUE\n')
    row = files.read_annotations(spark, str(tmp_path / "a.csv"), foreign=True).first()
    assert (row.route_name, row.route_lineage, row.label, row.keep) == ("two\nlines", None, 3, True)


def test_versions_that_do_not_change_are_left_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    stored = spark.createDataFrame([(i, f"v{i % 3}", [float(i)]) for i in range(60)], "image_id long, model_version string, embedding array<double>")
    files.write_versioned(stored.repartition(4), path)
    before = {p: p.stat().st_mtime_ns for v in (0, 2) for p in (tmp_path / "table" / f"model_version=v{v}").iterdir()}
    incoming = spark.createDataFrame([(1, "v1", [-1.0]), (1, "v1", [-2.0]), (4, "v1", [-4.0]), (100, "v1", [-100.0]), (7, "v9", [7.0])], stored.schema)
    for _ in range(2):  # a second time changes nothing
        files.upsert_versions(spark, path, incoming, ["image_id"], F.col("embedding")[0])
        got = {(r.image_id, r.model_version): r.embedding for r in spark.read.parquet(path).collect()}
        want = {(r.image_id, r.model_version): r.embedding for r in stored.collect()} | {(1, "v1"): [-1.0], (4, "v1"): [-4.0], (100, "v1"): [-100.0], (7, "v9"): [7.0]}
        assert got == want and spark.read.parquet(path).count() == len(want)
    assert before == {p: p.stat().st_mtime_ns for v in (0, 2) for p in (tmp_path / "table" / f"model_version=v{v}").iterdir()}


def test_vectors_of_other_versions_are_not_moved(spark):
    from talus.operators.rows import upsert

    stored = spark.range(1000).selectExpr("id AS image_id", "if(id % 2 = 0, 'v1', 'v2') AS model_version", "array(id * 1.0D) AS embedding")
    path_rows = stored.where("model_version = 'v1'").limit(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = upsert(stored, path_rows, ["image_id", "model_version"], F.col("image_id"), F.col("model_version") == "v1")
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        branches = plan.split("Union")[1]
        assert "Join LeftAnti" in branches
        # the first branch of the union is a scan with a filter, nothing below it joins or moves
        untouched = table._jdf.queryExecution().optimizedPlan().children().head().toString()
        assert "Join" not in untouched and "Aggregate" not in untouched and "Filter" in untouched
        assert table.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_named_shards_hold_their_rows_in_order(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = spark.range(23).selectExpr(
        "named_struct('bytes', cast(string(id) AS binary), 'path', cast(null AS string)) AS image", "cast(id AS int) AS route_image_id", "1 AS route_id", "'' AS route_name", "'' AS grade",
        "'' AS type", "'' AS description", "'' AS location", "'' AS gps", "2 AS area_id", "'' AS area_name", "'' AS area_path", "3 AS area_depth", "0.5F AS filter_score", "'m' AS filter_model_version",
        "22 - id AS idx", "(22 - id) div 5 AS shard").repartition(6)
    for _ in range(2):  # an earlier build is replaced
        assert files.write_named_shards(rows, path) == 5
        assert sorted(p.name for p in (tmp_path / "shards").iterdir() if not p.name.startswith((".", "_"))) == [f"train-{i:05d}.parquet" for i in range(5)]
    back = files.read_named_shards(spark, path)
    assert back.columns[:-1] == list(files.SHARD_COLUMNS)
    assert {(r.file, r.route_image_id, bytes(r.image.bytes)) for r in back.collect()} == {(f"train-{(22 - i) // 5:05d}.parquet", i, str(i).encode()) for i in range(23)}
    first = spark.read.parquet(f"{path}/train-00000.parquet").collect()
    assert [r.route_image_id for r in first] == [22, 21, 20, 19, 18]
