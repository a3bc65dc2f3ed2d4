"""Scraped area trees: nested documents (small) and one-node-per-line files (any size).

A nested document is one JSON value and so one task. It is opened level by level, and each node stays the JSON text it
is: sub-areas come out in the order in which the text has them, which a parsed VARIANT would lose. Large trees use node lines
{kind: sitemap|area|route|image, url, parent_url, pos, ...}, which need no recursion to parse: lineage comes
from `hierarchy.lineages` over parent_url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talus.functions import text as X
from talus.session import cut

NODE_SCHEMA = "kind string, url string, parent_url string, pos long, name string, grade string, attributes map<string,string>"

# Attribute labels of a route node and the columns they fill.
ROUTE_ATTRIBUTES = {"type": "Type:", "description": "Description", "location": "Location", "gps": "GPS:"}


# --- nested documents -------------------------------------------------------------------------------------

NODE = "type string, url string, subareas map<string,string>, routes array<string>"
ROUTE = "name string, url string, grade string, images array<string>, " + ", ".join(f"`{label}` string" for label in ROUTE_ATTRIBUTES.values())


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole (optionally gzipped) JSON documents as (doc string, node string)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("node"))


def _children(subareas: Column) -> Column:
    """Key and value of every sub-area in the order of the text. Of a key that stands there twice the last value counts,
    at the place of the first."""
    keys, entries = F.map_keys(subareas), F.map_entries(subareas)
    firsts = F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    last = lambda key: F.get(F.map_values(subareas), (F.size(keys) - F.array_position(F.reverse(keys), key)).cast("int"))
    chosen = F.transform(firsts, lambda e: F.struct(e["key"].alias("key"), last(e["key"]).alias("value")))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), chosen).otherwise(entries)


def empty_node(node: Column) -> Column:
    return node.isNull() | node.rlike(r"^\s*(null|\{\s*\}|)\s*$")


def open_levels(documents: DataFrame, keep_areas: int | None = None) -> DataFrame:
    """All nodes of nested documents: doc, order (positions from the root, in the order of the text), lineage (last url
    segments of the path), parent_url (nearest area above; sitemaps are transparent), reached, node (JSON text), type, url,
    routes (JSON texts) and has_areas. `keep_areas` opens only the first sub-areas of every node."""
    level = documents.select(
        "doc", F.array().cast("array<int>").alias("order"), F.array().cast("array<string>").alias("above"),
        F.lit(None).cast("string").alias("parent_url"), F.lit(True).alias("reached"), "node",
    )
    done = None
    while True:
        here = level.withColumn("_n", F.from_json("node", NODE)).select(
            "*", F.col("_n.type").alias("type"), F.nullif("_n.url", F.lit("")).alias("url"), F.col("_n.routes").alias("routes"),
            F.col("_n.subareas").alias("subareas"), F.col("_n.subareas").isNotNull().alias("has_areas")).drop("_n")
        segment = X.last_segment(F.coalesce("url", F.lit("")))
        here = cut(here.withColumn("lineage", F.when(segment != "", F.concat("above", F.array(segment))).otherwise(F.col("above"))))
        done = here.drop("above", "subareas") if done is None else done.unionByName(here.drop("above", "subareas"))
        through = (F.col("type") == "sitemap") | F.col("url").isNull()  # an untyped node is no sitemap
        below = here.select(
            "doc", "order", F.col("lineage").alias("above"), F.when(through, F.col("parent_url")).otherwise(F.col("url")).alias("parent_url"),
            "reached", "type", F.posexplode(_children(F.col("subareas"))).alias("pos", "child"))
        if keep_areas is not None:
            below = below.where(F.col("pos") < keep_areas)
        addressed = F.coalesce(F.get_json_object("child.value", "$.url"), F.lit("")) != ""
        below = below.select(
            "doc", F.concat("order", F.array("pos")).alias("order"), "above", "parent_url",
            (F.col("reached") & ((F.col("type") == "sitemap") | addressed)).alias("reached"), F.col("child.value").alias("node"))
        if below.isEmpty():
            return done
        level = below


def document_routes(nodes: DataFrame) -> DataFrame:
    """One row per route: doc, order, area_url, route (JSON text), route_name, route_lineage (joined by ' / '), images and
    the fields of the route, in document order."""
    listed = nodes.select("doc", "order", F.col("url").alias("area_url"), "lineage", F.posexplode("routes").alias("pos", "route"))
    return listed.withColumn("_r", F.from_json("route", ROUTE)).select(
        "doc", F.concat("order", F.array("pos")).alias("order"), "area_url", "route", F.col("_r.name").alias("route_name"),
        F.array_join("lineage", " / ").alias("route_lineage"), F.coalesce("_r.images", F.array().cast("array<string>")).alias("images"),
        F.col("_r.url").alias("route_url"), F.col("_r.grade").alias("grade"),
        *[F.col(f"_r.`{label}`").alias(name) for name, label in ROUTE_ATTRIBUTES.items()])


def flatten(documents: DataFrame, lineage: bool = True) -> DataFrame:
    """(route_name, [route_lineage,] images) of every route."""
    columns = ["route_name", "route_lineage", "images"] if lineage else ["route_name", "images"]
    return document_routes(open_levels(documents)).select(*columns)


def load_flattened_tree(spark: SparkSession, path: str) -> DataFrame:
    return flatten(read_documents(spark, path))


def count_tree(documents: DataFrame) -> DataFrame:
    """(areas, routes, images): sitemaps count as areas, empty nodes do not, empty routes count."""
    nodes = open_levels(documents)
    full = nodes.where(~empty_node(F.col("node")))
    routes = document_routes(full)
    areas = full.agg(F.count(F.lit(1)).alias("areas"))
    return routes.agg(F.count(F.lit(1)).alias("routes"), F.coalesce(F.sum(F.size("images")), F.lit(0)).alias("images")).select(
        areas.scalar().alias("areas"), "routes", "images"
    )


def trim(documents: DataFrame, max_areas: int = 2, max_routes: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes and routes of the tree cut to the first sub-areas per node and the first routes per node."""
    nodes = open_levels(documents, keep_areas=max_areas).where(~empty_node(F.col("node")))
    return nodes, document_routes(nodes).where(F.element_at("order", -1) < max_routes)


def document_lines(documents: DataFrame) -> DataFrame:
    """Nested documents as node lines, with their `doc` and their `arrival` in it. Nodes without url, sub-areas and routes are skipped, sub-areas and
    routes without url are skipped, and sitemaps pass their parent on."""
    nodes = open_levels(documents)
    # children of an area without url are kept under that area's parent
    has_any = F.col("url").isNotNull() | F.col("has_areas") | F.col("routes").isNotNull()
    kept = nodes.where(F.coalesce("reached", F.lit(False)) & has_any)
    areas = kept.where(F.col("url").isNotNull()).select(
        "doc", F.when(F.col("type") == "sitemap", "sitemap").otherwise("area").alias("kind"), "url", "parent_url",
        F.array_join(F.transform("order", lambda p: F.format_string("%09d", p)), ".").alias("arrival"),
        X.last_segment(F.col("url")).alias("name"), F.lit(None).cast("string").alias("grade"),
        F.lit(None).cast("map<string,string>").alias("attributes"),
    )
    routes = document_routes(kept.where(F.coalesce(F.col("type") != "sitemap", F.lit(True))))
    routes = routes.where(F.coalesce("route_url", F.lit("")) != "")
    # sub-areas are loaded before an area's own routes: `~` sorts behind every position
    own, at = F.slice("order", 1, F.size("order") - 1), F.element_at("order", -1)
    arrival = F.concat(F.array_join(F.transform(own, lambda p: F.format_string("%09d.", p)), ""), F.format_string("~%09d", at))
    attributes = F.create_map(*[x for name in ROUTE_ATTRIBUTES for x in (F.lit(name), F.col(name))])
    route_lines = routes.select(
        "doc", F.lit("route").alias("kind"), F.col("route_url").alias("url"), F.col("area_url").alias("parent_url"), arrival.alias("arrival"),
        F.col("route_name").alias("name"), "grade", attributes.alias("attributes"),
    )
    image_lines = routes.select("doc", "route_url", arrival.alias("a"), F.posexplode("images").alias("p", "image")).select(
        "doc", F.lit("image").alias("kind"), F.col("image").alias("url"), F.col("route_url").alias("parent_url"),
        F.concat_ws(".", "a", F.format_string("%09d", F.col("p"))).alias("arrival"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("grade"), F.lit(None).cast("map<string,string>").alias("attributes"),
    )
    return areas.unionByName(route_lines).unionByName(image_lines)


# --- node lines -------------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE_SCHEMA).json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Gzipped JSON, one node per line; many files, each read as its own task."""
    lines.write.mode("overwrite").option("compression", "gzip").json(path)


def line_lineages(lines: DataFrame) -> DataFrame:
    """(url, lineage array root first, parent) of every area and sitemap line; `hierarchy.lineages` works on
    ids, so urls are hashed to 64 bits and carried along by name."""
    from talus.operators.hierarchy import lineages
    from talus.operators.rows import first_per_key

    nodes = lines.where(F.col("kind").isin("area", "sitemap")).select(
        F.xxhash64("url").alias("id"), F.when(F.col("parent_url").isNotNull(), F.xxhash64("parent_url")).alias("parent_id"),
        X.last_segment(F.col("url")).alias("name"), "url",
        F.struct("pos", "parent_url").alias("arrival"),
    )
    nodes = first_per_key(nodes, ["url"], F.col("arrival")).drop("arrival")  # of a url listed twice, the first line counts
    chains = lineages(nodes)
    return nodes.select("id", "url").join(chains, "id").select(
        "url", F.filter(F.reverse(F.col("chain.name")), lambda s: s != "").alias("lineage")
    )


def line_photos(lines: DataFrame) -> DataFrame:
    """(url, route_url, route_name, route_lineage) of every image line: the long form of the flattened tree."""
    area_lineage = line_lineages(lines).select(F.col("url").alias("area_url"), F.array_join("lineage", " / ").alias("route_lineage"))
    routes = lines.where(F.col("kind") == "route").select(F.col("url").alias("route_url"), F.col("parent_url").alias("area_url"), F.col("name").alias("route_name"))
    photos = lines.where(F.col("kind") == "image").select("url", F.col("parent_url").alias("route_url"), "pos")
    return photos.join(routes.join(area_lineage, "area_url"), "route_url").select("url", "route_url", "route_name", "route_lineage", "pos")


def count_lines(lines: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return lines.agg(
        F.count_if(kind.isin("area", "sitemap")).alias("areas"), F.count_if(kind == "route").alias("routes"), F.count_if(kind == "image").alias("images")
    )


def trim_lines(lines: DataFrame, max_areas: int = 2, max_routes: int = 2) -> DataFrame:
    """Lines of the trimmed tree: a node stays if it and all its ancestors are among the first of their kind
    under their parent."""
    from pyspark.sql import Window

    from talus.operators.hierarchy import lineages

    inner = lines.where(F.col("kind").isin("area", "sitemap"))
    by_parent = Window.partitionBy("parent_url").orderBy("pos", "url")
    # the rank filter is pushed into the tasks, so a parent with very many children ships only the first ones
    first = inner.where(F.col("parent_url").isNotNull()).withColumn("_r", F.row_number().over(by_parent)).where(F.col("_r") <= max_areas).drop("_r")
    kept = inner.where(F.col("parent_url").isNull()).unionByName(first)
    rooted = lineages(kept.select(
        F.xxhash64("url").alias("id"), F.when(F.col("parent_url").isNotNull(), F.xxhash64("parent_url")).alias("parent_id"), F.col("url").alias("name")
    )).where("rooted").select(F.col("chain")[0]["name"].alias("url"))
    areas = kept.join(rooted, "url", "left_semi")
    routes = lines.where(F.col("kind") == "route").join(areas.select(F.col("url").alias("parent_url")), "parent_url", "left_semi")
    routes = routes.withColumn("_r", F.row_number().over(by_parent)).where(F.col("_r") <= max_routes).drop("_r").select(*lines.columns)
    images = lines.where(F.col("kind") == "image").join(routes.select(F.col("url").alias("parent_url")), "parent_url", "left_semi").select(*lines.columns)
    return areas.select(*lines.columns).unionByName(routes).unionByName(images)


# --- loading ----------------------------------------------------------------------------------------------


def _numbered(lines: DataFrame, kind: str, arrival: str) -> DataFrame:
    """Lines of one kind, first line of a url wins, ids in arrival order."""
    from talus.operators.ordering import global_rank
    from talus.operators.rows import first_per_key

    rows = first_per_key(lines.where(F.col("kind") == kind), ["url"], F.struct(arrival, "parent_url"))
    return global_rank(rows, [arrival, "url"], name="id")


def area_rows(lines: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Areas (id, parent_id, name, url) of node lines; the name is the last url segment."""
    areas = _numbered(lines, "area", arrival)
    parents = areas.select(F.col("url").alias("parent_url"), F.col("id").alias("parent_id"))
    return areas.join(parents, "parent_url", "left").select("id", "parent_id", X.last_segment(F.col("url")).alias("name"), "url")


def route_rows(lines: DataFrame, areas: DataFrame, arrival: str = "arrival") -> DataFrame:
    homes = areas.select(F.col("url").alias("parent_url"), F.col("id").alias("area_id"))
    return _numbered(lines, "route", arrival).join(homes, "parent_url").select(
        "id", "area_id", "name", "grade", "url", *[F.col("attributes")[k].alias(k) for k in ROUTE_ATTRIBUTES]
    )


def image_rows(lines: DataFrame, routes: DataFrame, arrival: str = "arrival") -> DataFrame:
    owners = routes.select(F.col("url").alias("parent_url"), F.col("id").alias("route_id"))
    return _numbered(lines, "image", arrival).join(owners, "parent_url").select("id", "route_id", F.col("url").alias("image_url"))
