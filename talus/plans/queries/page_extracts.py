"""Stored pages to rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import pages as P
from talus.plans.registry import query

CLEAN = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g')"
DECODE = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
H1 = DECODE.format(rf"regexp_replace(regexp_extract({CLEAN}, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g')")


@query("S10", r"SELECT page_id, url FROM pages WHERE regexp_matches(" + CLEAN + r", '(?i)<h1[\s>]')")
def stored_pages(c):
    return P.stored_pages(c.table("pages")).select("page_id", "url")


@query("H1 D3", rf"SELECT page_id, regexp_replace({H1}, '^\s+|\s+$', '', 'g') AS name, NULL::VARCHAR AS grade FROM pages")
def page_headings(c):
    html = F.col("html")
    return P.cleaned(c.table("pages")).select("page_id", P.heading(html).alias("name"), P.grade(html).alias("grade"))


def route_pages(c):
    """The stored pages in the layout of route and area pages: of three pages one has its navigation list as a route
    table, one as an area table, one has neither; all have a grade, a detail table, an image and a titled block."""
    id = F.col("page_id").cast("string")
    opened = F.when(F.col("page_id") % 3 == 0, F.lit(f'<table id="{P.ROUTE_TABLE_ID}">')).when(
        F.col("page_id") % 3 == 1, F.lit(f'<div class="{P.AREA_TABLE_CLASSES}"><div>')).otherwise(F.lit("<nav>"))
    closed = F.when(F.col("page_id") % 3 == 0, F.lit("</table>")).when(F.col("page_id") % 3 == 1, F.lit("</div></div>")).otherwise(F.lit("</nav>"))
    added = F.concat(
        F.lit(f'<span class="{P.GRADE_CLASS}"> 5.'), id, F.lit(f'</span><table class="{P.DETAILS_CLASS}"><tr><td>Number:</td><td>'), id,
        F.lit(f'</td></tr><tr><td>Page</td><td>from the table</td></tr></table><div class="{" ".join(P.IMAGE_CLASSES)}"><img data-src="https://x/'), id,
        F.lit(f'_small.jpg"></div><div class="{" ".join(P.BLOCK_CLASSES)}"><h3 class="{P.BLOCK_TITLE_CLASS}">Page</h3><div class="{P.BLOCK_TEXT_CLASS}">block &amp; '), id,
        F.lit("</div></div>"),
    )
    html = F.replace(F.replace("html", F.lit("<nav>"), opened), F.lit("</nav>"), closed)
    return c.table("pages").withColumn("html", F.concat(html, added))


@query("H5", rf"""
    SELECT url, kind, pos::INT AS pos, href FROM (
        SELECT url, kind, unnest(h) AS href, unnest(range(len(h))) AS pos FROM (
            SELECT url, CASE page_id % 3 WHEN 0 THEN 'route' ELSE 'area' END AS kind,
                   regexp_extract_all(regexp_extract({CLEAN}, '(?is)<nav\b[^>]*>(.*?)</nav>', 1), '(?is)<a\b[^>]*?\bhref="([^"]*)"', 1) AS h
            FROM pages WHERE page_id % 3 < 2))""")
def page_links(c):
    return P.outgoing_links(route_pages(c))


@query("H2 H3 H4 F9", rf"""
    SELECT url, regexp_replace({H1}, '^\s+|\s+$', '', 'g') AS name, '5.' || page_id AS grade, 1 AS images, 'https://x/' || page_id || '_large.jpg' AS image,
           2 AS attributes, page_id::VARCHAR AS number, 'block & ' || page_id AS page FROM pages""")
def extracted_pages(c):
    rows = P.extract_pages(route_pages(c))
    return rows.select(
        "url", "name", "grade", F.size("images").alias("images"), F.get("images", F.lit(0)).alias("image"), F.size("attributes").alias("attributes"),
        F.col("attributes")["Number:"].alias("number"), F.col("attributes")["Page"].alias("page"))


@query("P10 H6", r"""
    SELECT url, url LIKE '%/area/%' OR url LIKE '%/route/%' AS crawlable FROM (
        SELECT url FROM pages UNION ALL SELECT url FROM areas UNION ALL SELECT url FROM routes)""")
def crawlable_pages(c):
    """Pages are neither; areas and routes have their own addresses."""
    urls = c.table("pages").select("url").unionByName(c.areas.select("url")).unionByName(c.routes.select("url"))
    return urls.select("url", P.crawlable(F.col("url")).alias("crawlable"))


@query("H6 P10", """SELECT 'https://x/area/' || id AS loc FROM (SELECT r_regionkey AS id FROM region UNION ALL SELECT 1000 + c_custkey FROM customer)""")
def sitemap_area_locations(c):
    """One sitemap fragment per region and customer, holding an area entry and a route entry."""
    ids = c.table("region").select(F.col("r_regionkey").cast("long").alias("id")).unionByName(c.table("customer").select((F.lit(1000) + F.col("c_custkey")).alias("id")))
    xml = F.concat(F.lit("<urlset><url><loc> https://x/area/"), F.col("id").cast("string"), F.lit("</loc></url><url><loc>https://x/route/"), F.col("id").cast("string"), F.lit("</loc></url></urlset>"))
    return ids.select(F.explode(P.sitemap_areas(xml)).alias("loc"))
