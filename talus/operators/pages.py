"""Stored HTML pages to typed rows, with SQL regular expressions only.

Comments, scripts and styles are removed before anything is matched. Selectors are plain class tests on the
opening tag, which is what the page layout needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talus.functions import text as X

# Class and id names of the page layout.
GRADE_CLASS = "rateYDS"
DETAILS_CLASS = "description-details"
IMAGE_CLASSES = ["img-container", "position-relative"]
BLOCK_CLASSES = ["mt-2", "max-height", "max-height-md-800", "max-height-xs-600"]
BLOCK_TITLE_CLASS = "mt-2"
BLOCK_TEXT_CLASS = "fr-view"
ROUTE_TABLE_ID = "left-nav-route-table"
AREA_TABLE_CLASSES = "max-height max-height-md-0 max-height-xs-400"

NOISE = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
TAGS = r"(?s)<[^>]*>"
HEADING = r"(?is)<h1\b[^>]*>(.*?)</h1>"
HREF = r"(?is)<a\b[^>]*?\bhref=\"([^\"]*)\""
LOC = r"(?is)<loc>\s*(.*?)\s*</loc>"

# Entities the pages use.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def clean(html: Column) -> Column:
    return F.regexp_replace(html, NOISE, "")


def plain(fragment: Column) -> Column:
    """Text of a fragment: tags dropped, entities decoded, trimmed."""
    text = F.regexp_replace(fragment, TAGS, "")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _class_test(*names: str) -> str:
    """A class attribute with every one of the names, up to the end of its opening tag."""
    each = "".join(rf"(?=[^\"]*(?<![\w-]){n}(?![\w-]))" for n in names)
    return rf"class=\"{each}[^\"]*\"[^>]*>"


def _first(html: Column, pattern: str, marker: str | None = None, group: int = 1) -> Column:
    """First match; `marker` is a plain text without which the pattern cannot match, tested first."""
    found = F.nullif(F.regexp_extract(html, pattern, group), F.lit(""))
    return found if marker is None else F.when(F.contains(html, F.lit(marker)), found)


def _element(*names: str) -> str:
    """Pattern of an element with these classes: group 1 is the tag, group 2 the content up to its end tag."""
    return rf"(?is)<(\w+)\b[^>]*?{_class_test(*names)}(.*?)</\1>"


# The functions below take cleaned markup.


def has_heading(html: Column) -> Column:
    return html.rlike(r"(?i)<h1[\s>]")


def heading(html: Column) -> Column:
    return plain(_first(html, HEADING))


def grade(html: Column) -> Column:
    return plain(_first(html, _element(GRADE_CLASS), GRADE_CLASS, 2))


def details(html: Column) -> Column:
    """Two-column detail table as a map."""
    table = F.coalesce(_first(html, _element(DETAILS_CLASS), DETAILS_CLASS, 2), F.lit(""))
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)))
    usable = F.filter(cells, lambda c: F.size(c) >= 2)
    return _entries(F.transform(usable, lambda c: F.struct(plain(c[0]).alias("key"), plain(c[1]).alias("value"))))


def _sections(html: Column, *classes: str) -> Column:
    """What follows each opening tag with these classes, up to the next one."""
    marked = F.split(F.regexp_replace(html, rf"(?is)<\w+ [^>]*?{_class_test(*classes)}", "\u0001"), "\u0001")
    sections = F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0)))
    return F.when(F.contains(html, F.lit(classes[-1])), sections).otherwise(F.array().cast("array<string>"))


def _block_entry(section: Column) -> Column:
    return F.struct(
        plain(_first(section, _element(BLOCK_TITLE_CLASS), group=2)).alias("key"),
        plain(_first(section, _element(BLOCK_TEXT_CLASS), group=2)).alias("value"),
    )


def blocks(html: Column) -> Column:
    """Titled description blocks as a map."""
    entries = F.transform(_sections(html, *BLOCK_CLASSES), _block_entry)
    return _entries(F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull()))


def _entries(entries: Column) -> Column:
    """Map from (key, value) entries where the last entry of a key wins."""
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]),
    )
    return F.map_from_entries(last)


def images(html: Column) -> Column:
    """Lazy-loaded image urls in page order, normalised, each once."""
    tags = F.transform(_sections(html, *IMAGE_CLASSES), lambda b: F.regexp_extract(b, r"(?is)<img\b[^>]*>", 0))
    sources = F.transform(tags, lambda t: F.regexp_extract(t, r"(?is)\bdata-src=\"([^\"]*)\"", 1))
    return F.array_distinct(F.transform(F.filter(sources, lambda u: u != ""), X.normalise_image_url))


def links(fragment: Column) -> Column:
    return F.regexp_extract_all(fragment, F.lit(HREF), F.lit(1))


def route_table(html: Column) -> Column:
    return _first(html, rf"(?is)id=\"{ROUTE_TABLE_ID}\"[^>]*>(.*?)</table>", ROUTE_TABLE_ID)


def area_table(html: Column) -> Column:
    return _first(html, rf"(?is)class=\"{AREA_TABLE_CLASSES}\"[^>]*>(.*?)</div>\s*</div>", AREA_TABLE_CLASSES)


def navigation(html: Column) -> Column:
    return _first(html, r"(?is)<nav\b[^>]*>(.*?)</nav>")


def cleaned(pages: DataFrame) -> DataFrame:
    """Pages with their markup cleaned once for all later expressions."""
    return pages.withColumn("html", clean(F.col("html")))


def outgoing_links(pages: DataFrame, with_navigation: bool = False) -> DataFrame:
    """(url, kind, pos, href). A page with a route table yields its route links, else its area links, else nothing;
    `with_navigation`: else those of its navigation list."""
    h = F.col("html")
    nav = navigation(h) if with_navigation else F.lit(None).cast("string")
    parts = cleaned(pages).select("url", route_table(h).alias("route"), area_table(h).alias("area"), nav.alias("nav"))
    kind = F.when(F.col("route").isNotNull(), "route").when(F.col("area").isNotNull(), "area").otherwise("nav")
    return parts.select("url", kind.alias("kind"), F.posexplode(links(F.coalesce("route", "area", "nav", F.lit("")))).alias("pos", "href"))


def sitemap_areas(xml: Column) -> Column:
    return F.filter(F.regexp_extract_all(xml, F.lit(LOC), F.lit(1)), lambda u: F.contains(u, F.lit("area")))


def crawlable(url: Column) -> Column:
    return F.contains(url, F.lit("/area/")) | F.contains(url, F.lit("/route/"))


def stored_pages(pages: DataFrame) -> DataFrame:
    """Captured pages without the ones that carry no heading (error pages)."""
    return pages.where(has_heading(clean(F.col("html"))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """url, name, grade, images and one map of free attributes in which description blocks win."""
    h = F.col("html")
    parts = cleaned(pages).select(
        "url", heading(h).alias("name"), grade(h).alias("grade"), images(h).alias("images"), details(h).alias("details"), blocks(h).alias("blocks")
    )
    return parts.select("url", "name", "grade", "images", X.merge_maps(F.col("details"), F.col("blocks")).alias("attributes"))
