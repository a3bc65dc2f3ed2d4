from pyspark.sql import functions as F

from talus.operators import pages as P

ROUTE = """<html><head><script>var t="<h1>no</h1></p>";</script><!-- <h1>never</h1> --></head><body>
<h1> The &amp; <b>Nose</b> </h1><span class="rateYDS extra"> <a>5.9</a> <i>YDS</i> </span>
<table class="description-details"><tr><td> Type: </td><td>Trad, <i>Alpine</i></td></tr><tr><td>GPS:</td><td>1, 2</td></tr><tr><td>Location</td><td>table</td></tr></table>
<div class="img-container position-relative"><a><img src="x" data-src="https://i/a_topo_smallMed.jpg"></a></div>
<div class="position-relative img-container"><img data-src="https://i/a_large.jpg"></div>
<div class="img-container position-relative"><p>none</p></div>
<div class="img-container position-relative"><img data-src="https://i/b_medium.jpg"></div>
<div class="mt-2 max-height max-height-md-800 max-height-xs-600"><h2 class="mt-2"><a href="#e"></a>Description</h2><div class="fr-view">Good  line.<br>Long</div></div>
<div class="mt-2 max-height max-height-md-800 max-height-xs-600"><h2 class="mt-2">Location</h2><div class="fr-view">block</div></div>
</body></html>"""
AREA = """<h1>Area</h1><div id="nav" class="max-height max-height-md-0 max-height-xs-400"><div><a class="x" href="/area/1">1</a><a href="/area/2">2</a></div></div><nav><a href="/n">n</a></nav>"""
TABLE = """<h1>Crag</h1><table width=1 id="left-nav-route-table"><tr><td><a href="/route/1">r</a></td></tr></table>
<div class="max-height max-height-md-0 max-height-xs-400"><div><a href="/area/9">9</a></div></div>"""


def table(spark):
    return spark.createDataFrame([("r", ROUTE), ("a", AREA), ("t", TABLE), ("e", "<p>error</p>")], "url string, html string")


def test_route_page(spark):
    row = P.extract_pages(table(spark)).where("url = 'r'").first()
    assert row["name"] == "The & Nose"
    assert row["grade"] == "5.9 YDS"
    assert row["images"] == ["https://i/a_large.jpg", "https://i/b_large.jpg"]
    assert row["attributes"] == {"Type:": "Trad, Alpine", "GPS:": "1, 2", "Description": "Good  line.Long", "Location": "block"}


def test_missing_parts_are_empty(spark):
    row = P.extract_pages(table(spark)).where("url = 'e'").first()
    assert row["name"] is None and row["grade"] is None and row["images"] == [] and row["attributes"] == {}


def test_route_links_take_precedence(spark):
    links = {(r["url"], r["kind"], r["pos"], r["href"]) for r in P.outgoing_links(table(spark)).collect()}
    assert links == {("a", "area", 0, "/area/1"), ("a", "area", 1, "/area/2"), ("t", "route", 0, "/route/1")}


def test_error_pages_are_dropped(spark):
    assert {r["url"] for r in P.stored_pages(table(spark)).collect()} == {"r", "a", "t"}


def test_sitemap(spark):
    xml = "<sitemapindex><sitemap><loc> https://h/sitemap-areas-1.xml </loc></sitemap><sitemap><loc>https://h/sitemap-routes.xml</loc></sitemap></sitemapindex>"
    assert spark.range(1).select(P.sitemap_areas(F.lit(xml)).alias("l")).first()["l"] == ["https://h/sitemap-areas-1.xml"]
