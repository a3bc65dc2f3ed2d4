import pytest
from pyspark.sql import functions as F

from talus.operators import catalogue as C, classifiers, metrics as M, state as S
from talus.sources import files

SCORES = "id long, score double, keep boolean"


def scores(spark, *rows):
    return spark.createDataFrame([(i, s, k) for i, (s, k) in enumerate(rows)], SCORES)


def by_hand(rows, t):
    tp = sum(k and s >= t for s, k in rows)
    fp = sum((not k) and s >= t for s, k in rows)
    fn = sum(k and s < t for s, k in rows)
    precision = tp / (tp + fp) if tp + fp else 0.0
    recall = tp / (tp + fn) if tp + fn else 0.0
    return precision, recall, (2 * precision * recall / (precision + recall) if precision + recall else 0.0), 100 * (tp + fp) / len(rows)


@pytest.mark.parametrize("rows", [
    [(0.9, True), (0.9, False), (0.4, True), (0.95, True), (0.399999, False)],
    [(0.5, True), (0.8, True)], [(0.5, False), (0.8, False)],
])
def test_sweep_and_pareto(spark, rows):
    df = scores(spark, *rows)
    for r in M.threshold_sweep(df, "score", "keep", M.REPORT_THRESHOLDS).collect():
        assert (r["precision"], r["recall"], r["f1"], r["keep_pct"]) == pytest.approx(by_hand(rows, r["threshold"]))
    best = (0.0, 0.0, 0.0)
    for t in M.PARETO_THRESHOLDS:
        p, _, _, keep = by_hand(rows, t)
        if keep >= 5.0 and p > best[0]:
            best = (p, t, keep)
    assert tuple(M.pareto(df, "score", "keep").first()) == pytest.approx(best)


def test_empty_scores(spark):
    df = scores(spark).limit(0)
    sweep = M.threshold_sweep(df, "score", "keep", [0.5]).first()
    assert sweep["tp"] == 0 and sweep["precision"] == 0.0 and sweep["keep_pct"] is None
    assert tuple(M.pareto(df, "score", "keep").first()) == (0.0, 0.0, 0.0)


def test_float_column_at_the_boundary(spark):
    row = spark.range(1).select(F.lit(0.9).alias("score"), F.lit(0.9).cast("float").alias("raw"))
    out = row.select((F.col("score") >= 0.9).alias("a"), (F.col("raw") >= F.lit(0.9)).alias("b")).first()
    assert (out["a"], out["b"]) == (True, False)


def test_logistic_separates_and_balances(spark):
    rows = [(i, [1.0 + (i % 5) / 10, 0.0], True) for i in range(20)] + [(100 + i, [0.0, 1.0 + (i % 7) / 10], False) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<float>, keep boolean")
    out = M.confusion(classifiers.balanced_logistic(df, "keep", "v"), "score", "keep", 0.5).first()
    assert (out["tp"], out["fp"], out["fn"], out["tn"]) == (20, 0, 0, 200)
    with pytest.raises(ValueError):
        classifiers.balanced_logistic(df.where("keep"), "keep", "v")


def test_parameter_checks():
    for k in (0, 21):
        with pytest.raises(ValueError):
            C.check_top_k(k)
    with pytest.raises(ValueError):
        C.check_query("a")


def test_submission_checks(spark):
    rows = spark.createDataFrame([("image/png", 1), ("image/gif", 1), (None, 1), ("image/jpeg", S.MAX_UPLOAD_BYTES), ("image/jpeg", S.MAX_UPLOAD_BYTES + 1)], "content_type string, size long")
    assert [r["r"] for r in rows.select(S.submission_problem().alias("r")).collect()] == [None, "unsupported content type", "unsupported content type", None, "file too large"]


def test_domains(spark):
    rows = spark.createDataFrame([("user", "approved"), ("robot", "approved"), ("admin", None)], "source string, status string")
    assert [r["r"] for r in rows.select(S.domain_problem().alias("r")).collect()] == [None, "unknown source", "unknown status"]


def test_binary_files_and_presence(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"one")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.jpg").write_bytes(b"three")
    (tmp_path / "c.txt").write_bytes(b"x")
    found = files.read_binary(spark, str(tmp_path))
    rows = spark.createDataFrame([("a.jpg", 1), ("b.jpg", 2), ("gone.jpg", 3)], "file string, n int")
    assert {(r["n"], bytes(r["content"])) for r in files.with_content(rows, "file", found).collect()} == {(1, b"one"), (2, b"three")}
    assert {r["n"] for r in files.with_existing_file(rows, "file", found).collect()} == {1, 2}


def test_json_keys_and_tags(spark, tmp_path):
    (tmp_path / "keys.json").write_text('["u1", "u2"]')
    (tmp_path / "tags.json").write_text('{"u1": {"route": "r", "tag": "keep"},\n "u2": {"route": "s", "tag": "discard"}}')
    assert {r["url"] for r in files.read_key_array(spark, str(tmp_path / "keys.json")).collect()} == {"u1", "u2"}
    assert {tuple(r) for r in files.read_tagged_map(spark, str(tmp_path / "tags.json")).collect()} == {("u1", "r", "keep"), ("u2", "s", "discard")}
    (tmp_path / "done.txt").write_text("1\n 2 \n\nx\n")
    assert {r["batch"] for r in files.read_progress(spark, str(tmp_path / "done.txt")).collect()} == {1, 2}


def test_annotations_keep_spellings(spark, tmp_path):
    (tmp_path / "a.csv").write_text('url,route_name,route_lineage,str_label,label,keep\nu,"a, ""b""",l,s,1,True\nv,n,l,s,2,False\n')
    rows = files.read_annotations(spark, str(tmp_path / "a.csv")).orderBy("url").collect()
    assert [(r["keep"], r["label"]) for r in rows] == [(True, 1), (False, 2)]
    assert rows[0]["route_name"] == 'a, "b"'
