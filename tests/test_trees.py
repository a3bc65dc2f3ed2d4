import gzip
import json

import pytest
from pyspark.sql import functions as F

from talus.sources import tree as T

HOST = "https://h"


def route(name, images=(), url=True, **extra):
    node = {"name": name, "grade": "5.9", "images": list(images), **extra}
    if url:
        node["url"] = f"{HOST}/route/1/{name}"
    return node


DOCUMENT = {
    "type": "sitemap", "url": f"{HOST}/sitemap.xml", "subareas": {
        f"{HOST}/area/1/north": {
            "type": "area", "url": f"{HOST}/area/1/north",
            "routes": [route("one", ["i1", "i2"], **{"Type:": "Trad", "GPS:": "1,2"}), {}, route("two", ["i2"]), route("lost", url=False)],
            "subareas": {
                f"{HOST}/area/2/wall": {"type": "area", "url": f"{HOST}/area/2/wall", "routes": [route("three", ["i3"]), route("one", ["i9"])], "subareas": {}},
                f"{HOST}/area/3/void": {},
                "nourl": {"type": "area", "routes": [route("hidden")], "subareas": {}},
            },
        },
        "bare": {"type": "area", "subareas": {f"{HOST}/area/4/kept": {"type": "area", "url": f"{HOST}/area/4/kept", "routes": [], "subareas": {}}}},
        f"{HOST}/area/1/north#2": {"type": "area", "url": f"{HOST}/area/1/north", "routes": [route("four", ["i4"])], "subareas": {}},
    },
}


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    target = tmp_path_factory.mktemp("tree") / "tree.json.gz"
    with gzip.open(target, "wt") as out:
        json.dump(DOCUMENT, out)
    return str(target)


@pytest.fixture(scope="module")
def documents(spark, path):
    return T.read_documents(spark, path)


def test_flatten_keeps_sitemap_in_lineage(spark, path):
    rows = {(r["route_name"], r["route_lineage"], tuple(r["images"])) for r in T.load_flattened_tree(spark, path).collect()}
    assert ("one", "sitemap.xml / north", ("i1", "i2")) in rows
    assert ("three", "sitemap.xml / north / wall", ("i3",)) in rows
    assert ("hidden", "sitemap.xml / north", ()) in rows       # an area without url adds no segment
    assert (None, "sitemap.xml / north", ()) in rows           # the failed route
    assert len(rows) == 8


def test_flatten_without_lineage(documents):
    assert T.flatten(documents, lineage=False).columns == ["route_name", "images"]
    assert T.flatten(documents, lineage=False).count() == 8


def test_counts(documents):
    # sitemap, north twice, wall, the area without url, bare, kept; the empty node is not counted
    assert tuple(T.count_tree(documents).first()) == (7, 8, 6)


def test_trim(documents):
    nodes, routes = T.trim(documents, max_areas=2, max_routes=2)
    assert {r["url"] for r in nodes.collect()} == {f"{HOST}/sitemap.xml", f"{HOST}/area/1/north", f"{HOST}/area/2/wall", f"{HOST}/area/4/kept", None}
    assert routes.where(F.col("area_url") == f"{HOST}/area/1/north").count() == 2


def test_rows_skip_sitemaps_and_unaddressed_nodes(documents):
    lines = T.document_lines(documents).cache()
    areas = T.area_rows(lines)
    routes = T.route_rows(lines, areas)
    images = T.image_rows(lines, routes)
    by_name = {r["name"]: r for r in areas.collect()}
    assert set(by_name) == {"north", "wall", "kept"}
    assert by_name["north"]["parent_id"] is None and by_name["wall"]["parent_id"] == by_name["north"]["id"]
    assert by_name["kept"]["parent_id"] is None                # child of an area without url
    found = {r["name"]: r for r in routes.collect()}
    assert set(found) == {"one", "two", "three", "four"}       # no url, no row; hidden sits in a skipped area
    assert found["one"]["area_id"] == by_name["wall"]["id"]    # sub-areas are loaded before an area's own routes
    assert found["one"]["type"] is None and found["two"]["area_id"] == by_name["north"]["id"]
    owner = {r["image_url"]: r["route_id"] for r in images.collect()}
    assert owner["i2"] == found["one"]["id"] and owner["i9"] == found["one"]["id"] and set(owner) == {"i1", "i2", "i3", "i4", "i9"}


def test_line_files_round_trip(spark, documents, tmp_path):
    lines = T.document_lines(documents).withColumn("pos", F.lit(0).cast("long")).select("kind", "url", "parent_url", "pos", "name", "grade", "attributes")
    T.write_lines(lines, str(tmp_path / "lines"))
    assert all(f.suffix in (".gz", ".crc", "") for f in (tmp_path / "lines").iterdir())
    back = T.read_lines(spark, str(tmp_path / "lines"))
    assert back.count() == lines.count()
    photos = {(r["url"], r["route_name"], r["route_lineage"]) for r in T.line_photos(back).collect()}
    assert ("i3", "three", "north / wall") in photos


def test_sub_areas_stand_in_the_order_of_the_text(spark):
    def area(name, routes, **below):
        return {"type": "area", "url": f"{HOST}/{name}", "routes": routes, "subareas": {f"{HOST}/{k}": v for k, v in below.items()}}

    root = area("root", [], Z=area("Z", [route("one"), route("two")]), B=area("B", [route("one"), route("three")]), A=area("A", []))
    documents = spark.createDataFrame([("d", json.dumps(root, indent=1))], "doc string, node string")
    lines = T.document_lines(documents)
    areas = T.area_rows(lines)
    names = {r["id"]: r["name"] for r in areas.collect()}
    assert [names[i] for i in sorted(names)] == ["root", "Z", "B", "A"]
    assert {r["name"]: names[r["area_id"]] for r in T.route_rows(lines, areas).collect()} == {"one": "Z", "two": "Z", "three": "B"}
    nodes, _ = T.trim(documents, max_areas=2)
    assert {r["url"] for r in nodes.collect()} == {f"{HOST}/root", f"{HOST}/Z", f"{HOST}/B"}


def test_a_repeated_key_keeps_its_place_and_takes_the_last_value(spark):
    text = '{"url": "h/r", "type": "area", "subareas": {"y": {"url": "h/old"}, "x": {"url": "h/x"}, "y": {"url": "h/new"}}}'
    nodes = T.open_levels(spark.createDataFrame([("d", text)], "doc string, node string")).collect()
    assert [(r["order"], r["url"]) for r in sorted(nodes, key=lambda r: r["order"])] == [([], "h/r"), ([0], "h/new"), ([1], "h/x")]


def test_odd_nodes_are_empty(spark):
    rows = [("a", "{}"), ("b", " {\n} "), ("c", "null"), ("d", ""), ("e", None), ("f", '{"url": "h/f", "subareas": {"n": null, "e": {}}, "routes": null}')]
    documents = spark.createDataFrame(rows, "doc string, node string")
    assert tuple(T.count_tree(documents).first()) == (1, 0, 0)
    assert T.document_lines(documents).count() == 1
