"""Subtrees, closures, paths, node-line trees and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talus.operators import hierarchy as H, pages as P
from talus.plans.registry import query
from talus.session import scratch
from talus.sources import tree as T


@query("R1 Z15", "SELECT descendant AS id, depth FROM area_closure WHERE ancestor = 3")
def area_subtree(c):
    return H.descend(c.areas, 3)


@query("R2", "SELECT descendant AS id, depth FROM part_closure WHERE ancestor = 1 AND depth <= 8")
def deep_subtree_to_depth_eight(c):
    return H.descend(c.part_tree, 1, 8)


@query("R3", """
    SELECT c.ancestor AS root_id, count(*) AS nodes, max(c.depth) AS deepest FROM part_closure c JOIN part_tree p ON p.id = c.ancestor
    WHERE c.depth <= 8 AND p.name LIKE '%1%' GROUP BY 1""")
def many_root_subtrees(c):
    roots = c.part_tree.where(F.col("name").contains("1")).select("id")
    counts = H.area_sums(c.part_tree, roots, c.part_tree.select("id", F.lit(1).alias("value")), 8)
    return counts.groupBy(F.col("root").alias("root_id")).agg(F.sum("total").alias("nodes"), F.max("depth").alias("deepest"))


@query("R4", "SELECT id, area_path, area_depth FROM area_paths")
def area_paths(c):
    return H.area_paths(H.lineages(c.areas))


@query("R4 A6", """
    SELECT min(depth) AS shallowest, max(depth) AS deepest, count(*) AS nodes FROM (
        SELECT descendant, max(depth) AS depth FROM part_closure GROUP BY 1)""")
def deep_tree_depths(c):
    paths = H.area_paths(H.lineages(c.part_tree))
    return paths.agg(F.min("area_depth").alias("shallowest"), F.max("area_depth").alias("deepest"), F.count(F.lit(1)).alias("nodes"))


@query("R8", "SELECT ancestor, descendant, depth FROM area_closure")
def area_closure(c):
    return H.area_pairs(c.areas)


def node_lines(c) -> DataFrame:
    """The catalogue as a scraped tree in node-line form: regions are sitemaps, the rest areas, then routes
    and their photos. `pos` orders the children of a node, `arrival` all lines."""
    parents = c.areas.select(F.col("id").alias("p_id"), F.col("url").alias("parent_url"))
    areas = c.areas.join(parents, F.col("parent_id") == F.col("p_id"), "left").select(
        F.when(F.col("parent_id").isNull(), "sitemap").otherwise("area").alias("kind"), "url", "parent_url",
        F.col("id").alias("pos"), "name", F.lit(None).cast("string").alias("grade"),
        F.lit(None).cast("map<string,string>").alias("attributes"),
    )
    homes = c.areas.select(F.col("id").alias("area_id"), F.col("url").alias("parent_url"))
    routes = c.routes.join(homes, "area_id").select(
        F.lit("route").alias("kind"), "url", "parent_url", F.col("id").alias("pos"), "name", "grade",
        F.create_map(F.lit("type"), F.col("type")).alias("attributes"),
    )
    images = c.route_images.select(
        F.lit("image").alias("kind"), F.col("image_url").alias("url"),
        F.concat(F.lit("https://x/route/"), F.col("route_id").cast("string")).alias("parent_url"), F.col("id").alias("pos"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("grade"),
        F.lit(None).cast("map<string,string>").alias("attributes"),
    )
    return areas.unionByName(routes).unionByName(images)


@query("R5 Z13", """
    SELECT i.image_url AS url, r.name AS route_name, replace(p.area_path, '/', ' / ') AS route_lineage
    FROM route_images i JOIN routes r ON r.id = i.route_id JOIN area_paths p ON p.id = r.area_id""")
def tree_photos_with_lineage(c):
    return T.line_photos(node_lines(c)).select("url", "route_name", "route_lineage")


@query("R6", """
    SELECT r.name AS route_name, count(*) AS images FROM route_images i JOIN routes r ON r.id = i.route_id GROUP BY r.id, r.name""")
def tree_photos_per_route(c):
    photos = T.line_photos(node_lines(c))
    return photos.groupBy("route_url", "route_name").agg(F.count(F.lit(1)).alias("images")).select("route_name", "images")


@query("R9", """
    SELECT (SELECT count(*) FROM areas) AS areas, (SELECT count(*) FROM routes JOIN areas a ON a.id = area_id) AS routes,
           (SELECT count(*) FROM route_images) AS images""")
def tree_counts(c):
    return T.count_lines(node_lines(c))


@query("R10", """
    SELECT kind, url FROM (
        SELECT 'area' AS kind, url FROM kept UNION ALL
        SELECT 'route', url FROM first_routes UNION ALL
        SELECT 'image', i.image_url FROM route_images i JOIN first_routes f ON f.id = i.route_id)""",
    ranked="SELECT *, CASE WHEN parent_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY parent_id ORDER BY id) END AS rn FROM areas",
    kept="SELECT id, url FROM ranked WHERE parent_id IS NULL UNION ALL SELECT r.id, r.url FROM ranked r JOIN kept k ON k.id = r.parent_id WHERE r.rn <= 2",
    first_routes="SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.area_id ORDER BY r.id) AS rn FROM routes r JOIN kept k ON k.id = r.area_id) WHERE rn <= 2")
def trimmed_tree(c):
    kind = F.when(F.col("kind") == "sitemap", "area").otherwise(F.col("kind"))
    return T.trim_lines(node_lines(c)).select(kind.alias("kind"), "url")


def _arriving(c):
    return node_lines(c).withColumn("arrival", F.concat_ws(".", F.lpad(F.length("url").cast("string"), 4, "0"), F.col("url")))


@query("R7 K7", """
    SELECT n.id, p.id AS parent_id, n.name FROM numbered n LEFT JOIN numbered p ON p.old = n.parent_id""",
    numbered="""SELECT id AS old, parent_id, name, row_number() OVER (ORDER BY lpad(length(url)::VARCHAR, 4, '0') || '.' || url) AS id
                FROM areas WHERE parent_id IS NOT NULL""")
def tree_area_rows(c):
    return T.area_rows(_arriving(c)).select("id", "parent_id", "name")


@query("R7 K7", """
    SELECT row_number() OVER (ORDER BY lpad(length(url)::VARCHAR, 4, '0') || '.' || url) AS id, name, grade, type FROM routes""")
def tree_route_rows(c):
    lines = _arriving(c)
    return T.route_rows(lines, T.area_rows(lines)).select("id", "name", "grade", "type")


@query("R7 K7", """
    SELECT i.id, r.id AS route_id, i.image_url FROM i JOIN r ON r.old = i.route_id""",
    i="SELECT row_number() OVER (ORDER BY lpad(length(image_url)::VARCHAR, 4, '0') || '.' || image_url) AS id, route_id, image_url FROM route_images",
    r="SELECT id AS old, row_number() OVER (ORDER BY lpad(length(url)::VARCHAR, 4, '0') || '.' || url) AS id FROM routes")
def tree_image_rows(c):
    lines = _arriving(c)
    return T.image_rows(lines, T.route_rows(lines, T.area_rows(lines)))


@query("K8 S1", """
    SELECT 'area' AS kind, count(*) AS n FROM areas WHERE parent_id IS NOT NULL UNION ALL SELECT 'sitemap', count(*) FROM areas WHERE parent_id IS NULL
    UNION ALL SELECT 'route', count(*) FROM routes JOIN areas a ON a.id = area_id UNION ALL SELECT 'image', count(*) FROM route_images""")
def tree_line_files(c):
    path = scratch(c.spark, "tree-lines")
    T.write_lines(node_lines(c), path)
    return T.read_lines(c.spark, path).groupBy("kind").agg(F.count("url").alias("n"))


def order_documents(c) -> DataFrame:
    """One nested document a customer: its orders as routes, each listed in an area of its status and in one of its priority.
    Areas stand by their newest order, newest first, and so do routes: no order of the alphabet."""
    key = F.explode(F.array(F.concat(F.lit("status-"), "o_orderstatus"), F.concat(F.lit("priority-"), "o_orderpriority"))).alias("key")
    number = F.col("o_orderkey").cast("string")
    route = F.struct("o_orderkey", F.concat(F.lit("Order "), number).alias("name"), F.concat(F.lit("https://x/route/"), number).alias("url"))
    listed = c.table("orders").select("o_custkey", "o_orderkey", route.alias("route"), key)
    home = F.concat(F.lit("https://x/customer/"), F.col("o_custkey").cast("string"))
    per = listed.groupBy("o_custkey", "key").agg(F.max("o_orderkey").alias("last"), F.sort_array(F.collect_list("route"), False).alias("routes"))
    node = F.struct(F.lit("area").alias("type"), F.concat(home, F.lit("/"), "key").alias("url"), F.transform("routes", lambda r: F.struct(r["name"], r["url"])).alias("routes"))
    docs = per.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("last", "key", node.alias("node"))), False).alias("areas"))
    below = F.map_from_entries(F.transform("areas", lambda a: F.struct(a["node"]["url"], a["node"])))
    return docs.select(F.col("o_custkey").cast("string").alias("doc"), F.to_json(F.struct(F.lit("area").alias("type"), home.alias("url"), below.alias("subareas"))).alias("node"))


LISTED = "SELECT o_custkey AS cust, o_orderkey AS o, unnest(['status-' || o_orderstatus, 'priority-' || o_orderpriority]) AS key FROM orders"
KEYS = "SELECT cust, key, row_number() OVER (PARTITION BY cust ORDER BY max(o) DESC, key DESC) AS pos FROM listed GROUP BY cust, key"


@query("R7 K7 S1", """
    SELECT 'Order ' || o AS name, 'https://x/customer/' || cust || '/' || arg_min(key, pos) AS area_url FROM listed JOIN keys USING (cust, key) GROUP BY cust, o""",
    listed=LISTED, keys=KEYS)
def nested_first_listing(c):
    """Routes of nested documents that list each twice: the area that comes first in the document keeps it."""
    lines = T.document_lines(order_documents(c))
    lines = lines.withColumn("arrival", F.concat(F.lpad("doc", 12, "0"), F.lit("/"), "arrival"))
    areas = T.area_rows(lines)
    return T.route_rows(lines, areas).join(areas.select(F.col("id").alias("area_id"), F.col("url").alias("area_url")), "area_id").select("name", "area_url")


@query("R10 R6", """
    SELECT 'https://x/customer/' || cust || '/' || key AS area_url, 'Order ' || o AS route_name FROM (
        SELECT l.*, k.pos, row_number() OVER (PARTITION BY cust, key ORDER BY o DESC) AS rn FROM listed l JOIN keys k USING (cust, key)) WHERE pos <= 2 AND rn <= 2""",
    listed=LISTED, keys=KEYS)
def nested_trimmed_routes(c):
    """The first two areas of every nested document with the first two routes of each."""
    _, routes = T.trim(order_documents(c), 2, 2)
    return routes.select("area_url", "route_name")


LINKS = "SELECT id AS src, id * 2 AS dst FROM part_tree UNION ALL SELECT id, id * 2 + 1 FROM part_tree"
REACHED = """SELECT 1::BIGINT AS url, 0 AS distance UNION ALL
    SELECT l.dst, r.distance + 1 FROM reached r JOIN part_tree p ON p.id = r.url JOIN links l ON l.src = r.url"""


@query("H7", """
    SELECT url, distance, url IN (SELECT id FROM part_tree) AS stored FROM reached""", links=LINKS, reached=REACHED)
def pages_reached_over_links(c):
    """Parts as pages that link to their two children in the part tree; the last level links to pages that are
    not stored."""
    pages = c.part_tree.select(F.col("id").alias("url"))
    links = pages.select(F.col("url").alias("src"), F.explode(F.array(F.col("url") * 2, F.col("url") * 2 + 1)).alias("dst"))
    roots = c.part_tree.where(F.col("parent_id").isNull()).select(F.col("id").alias("url"))
    found, failed = H.reachable(links, roots, pages)
    return found.withColumn("stored", F.lit(True)).unionByName(failed.withColumn("stored", F.lit(False)))


def linked_pages(c) -> DataFrame:
    """The stored pages with a route table that links page n to pages 2n + 1 and 2n + 2, whether they are stored or not."""
    target = F.transform(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2), lambda t: F.concat(F.lit('<a href="https://x/page/'), t.cast("string"), F.lit('">x</a>')))
    links = F.concat(F.lit(f'<table id="{P.ROUTE_TABLE_ID}">'), F.array_join(target, ""), F.lit("</table>"))
    return c.table("pages").select(F.concat(F.lit("https://x/page/"), F.col("page_id").cast("string")).alias("url"), F.concat("html", links).alias("html"))


@query("H7 H5", """
    SELECT 'https://x/page/' || page AS url, distance, page IN (SELECT page_id FROM pages) AS stored FROM steps""",
    steps="""SELECT min(page_id) AS page, 0 AS distance FROM pages
        UNION ALL SELECT unnest([2 * s.page + 1, 2 * s.page + 2]), s.distance + 1 FROM steps s JOIN pages p ON p.page_id = s.page""")
def pages_reached_from_html(c):
    """Pages reached over the links that are read out of the pages' own HTML."""
    pages = linked_pages(c)
    links = P.outgoing_links(pages).select(F.col("url").alias("src"), F.col("href").alias("dst"))
    first = c.table("pages").agg(F.concat(F.lit("https://x/page/"), F.min("page_id").cast("string")).alias("url"))
    found, failed = H.reachable(links, first, pages.select("url"))
    return found.withColumn("stored", F.lit(True)).unionByName(failed.withColumn("stored", F.lit(False)))
