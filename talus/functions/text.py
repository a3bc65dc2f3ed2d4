"""String, URL and formatting expressions. All are Column -> Column and stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Image-name suffixes of the photo host and the size that replaces them.
TOPO_SUFFIX = "_topo"
SIZE_SUFFIXES = "_(smallMed|small|medium)"
LARGE_SUFFIX = "_large"
LARGE, MEDIUM = "large", "medium"  # every occurrence in a url is replaced


# The point before a cased letter that follows anything but one.
WORD_START = r"(?<=[^\p{Lu}\p{Ll}\p{Lt}])(?=[\p{Lu}\p{Ll}\p{Lt}])"
MARK = "\u0001 "


def title(slug: Column) -> Column:
    """Slug to display name: dashes to spaces, every run of letters capitalised, '' for NULL.

    `initcap` only starts words after a blank, so a marked blank is put before every other run of letters and
    taken out again."""
    spaced = F.regexp_replace(F.replace(slug, F.lit("-"), F.lit(" ")), WORD_START, MARK)
    return F.coalesce(F.replace(F.initcap(spaced), F.lit(MARK), F.lit("")), F.lit(""))


def path_label(parent: Column, child: Column) -> Column:
    """'Parent / Child' from two slugs, or just the child where there is no parent."""
    has_parent = parent.isNotNull() & (parent != "")
    return F.when(has_parent, F.concat(title(parent), F.lit(" / "), title(child))).otherwise(title(child))


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like_patterns(query: str, escape: bool = False) -> tuple[str, str]:
    """The slug form and the raw form of a search text, wrapped as substring patterns."""
    trimmed = query.strip()
    if escape:
        trimmed = escape_like(trimmed)
    return f"%{trimmed.replace(' ', '-')}%", f"%{trimmed}%"


def matches_text(name: Column, query: str, escape: bool = False) -> Column:
    slug, raw = like_patterns(query, escape)
    return name.ilike(slug) | name.ilike(raw)


def strip(text: Column) -> Column:
    """Without any white space at the ends, not only blanks."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def slug_pattern(query: Column) -> Column:
    """The slug substring pattern for a column of search texts."""
    return F.concat(F.lit("%"), F.replace(strip(query), F.lit(" "), F.lit("-")), F.lit("%"))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def cache_name(url: Column) -> Column:
    """File name of a cached image: last url segment up to the query string."""
    return F.substring_index(last_segment(url), "?", 1)


def normalise_image_url(url: Column) -> Column:
    plain = F.replace(url, F.lit(TOPO_SUFFIX), F.lit(""))
    return F.regexp_replace(plain, SIZE_SUFFIXES, LARGE_SUFFIX)


def medium_fallback(url: Column) -> Column:
    return F.replace(url, F.lit(LARGE), F.lit(MEDIUM))


def vector_to_text(vector: Column) -> Column:
    """'[a,b,...]' with eight decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.8f", x)), ","), F.lit("]"))


def text_to_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def blank_if_null(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def label_key(lineage: Column, name: Column) -> Column:
    """Grouping label 'lineage|name'; a missing name is spelled 'None'."""
    return F.concat(lineage, F.lit("|"), F.coalesce(name, F.lit("None")))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def file_stem(path: Column) -> Column:
    """File name without folder and last extension ('models/best.v1.pth' -> 'best.v1')."""
    name = last_segment(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def merge_maps(*maps: Column) -> Column:
    """Union of string maps where a later map wins on a shared key, whatever the session's dedup policy."""
    merged = maps[0]
    for later in maps[1:]:
        merged = F.map_concat(_without_keys(merged, later), later)
    return merged


def _without_keys(merged: Column, later: Column) -> Column:
    return F.map_filter(merged, lambda k, v: ~F.map_contains_key(later, k))
