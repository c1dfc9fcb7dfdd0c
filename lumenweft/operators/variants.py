"""The widest rendition that a page's own srcset offers of an image, for sites whose addresses cannot be rewritten.

Their sizes are signed or bounded, so an address is only chosen among those that the page lists, never made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame

from lumenweft.functions import url as U
from lumenweft.functions.url import absolute
from lumenweft.functions.text import F, as_text, column

# Fixed values, in order of dispatch: resolver, the page's host, an image's host, its path (id, width, height or ratio), a parameter it must have, the parameter of its width.
RULES: list[tuple[str, str | None, str, str, str | None, str | None]] = [
    ("threads", r"(?:^|\.)threads\.(?:com|net)$", r"(?:^|\.)(?:cdninstagram\.com|fbcdn\.net)$", "", None, None),
    ("magnific", None, r"^img\.magnific\.com$", "", None, "w"),
    ("arcxp", None, ".", r"/resizer/v2/", "auth", "width"),
    ("spiegel", None, r"^cdn\.prod\.www\.spiegel\.de$", r"(?i)^/images/([0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})_w(\d+)_r([\d.]+)_", None, None),
    ("onedio", None, r"^img-s\d+\.onedio\.com$", r"(?i)^/id-([0-9a-f]+)/rev-\d+/w-(\d+)(?:/h-(\d+))?/f-[a-z0-9]+/s-[0-9a-f]+\.[a-z0-9]+$", None, None),
]
NAMED = ("spiegel", "onedio")
FOUND = "struct<resolver:string,original:string,width:int,height:int,ext:string,thumbnail:string,media_key:string>"


def _number(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def _path_ext(x: Column) -> Column:
    ext = F.lower(F.regexp_extract(U.path(x), r"(?i)\.(jpe?g|png|webp|avif|gif)$", 1))
    return F.when(ext.isin("", "jpeg"), "jpg").otherwise(ext)


def _rule(rule: tuple) -> Column:
    """What a rule finds for a row (page_url, src, listed, natural_width, natural_height), or null."""
    name, page, host, path, need, sized = rule
    named, any_listed = name in NAMED, page is not None
    group = lambda x, k: F.regexp_extract(U.path(x), path, k)
    member = lambda x: U.host(x).rlike(host) & U.path(x).rlike(path) & (x.rlike("(?i)^https://") if named else F.lit(True))
    family = lambda x: F.lower(group(x, 1)) if named else U.host(x)
    param = lambda x: F.lit(0.0) if sized is None else F.greatest(_number(U.param(x, sized)), F.lit(0.0))

    def width(x: Column, stated: Column) -> Column:
        return _number(group(x, 2)) if named else F.when(stated > 0, stated).otherwise(param(x))

    stated = lambda c: _number(F.regexp_extract(c, r"^\S+\s+([\d.]+)w", 1))
    address = lambda c: F.regexp_extract(c, r"^(\S+)", 1)
    src = F.col("src")
    read = F.transform(F.coalesce(F.col("listed"), F.array().cast("array<string>")), lambda c: F.struct((absolute(address(c), F.col("page_url")) if any_listed else address(c)).alias("url"), stated(c).alias("stated")))
    if not any_listed:
        read = F.filter(read, lambda v: member(v["url"]) & (family(v["url"]) == family(src)))
    rated = F.transform(read, lambda v, k: F.struct(width(v["url"], v["stated"]).alias("width"), (-k).alias("place"), v["url"].alias("url")))
    own = F.struct((F.lit(-1.0) if any_listed else width(src, F.lit(0.0))).alias("width"), F.lit(1).alias("place"), src.alias("url"))

    def result(all_: Column) -> Column:
        top = F.array_max(all_)
        best = F.when(member(top["url"]), top).otherwise(own) if any_listed else top
        return U.let(best, lambda b: facts(b, all_))

    def facts(b: Column, all_: Column) -> Column:
        none = F.lit(None)
        w = F.when(b["width"] > 0, b["width"].cast("int"))
        if named:
            third = _number(group(b["url"], 3))
            height = F.floor(b["width"] / F.nullif(third, F.lit(0.0)) + 0.5) if name == "spiegel" else third
            thumb, ext, key = F.when(b["url"] != src, src), U.image_extension(b["url"]), F.concat(F.lit(f"{name} "), family(src))
        else:
            height = F.floor(b["width"] * F.col("natural_height") / F.nullif(F.col("natural_width"), F.lit(0)) + 0.5)
            others = F.transform(F.filter(all_, lambda v: v["url"] != b["url"]), lambda v: F.struct(F.when(v["width"] > 0, v["width"]).otherwise(1e300).alias("w"), (-v["place"]).alias("o"), v["url"].alias("url")))
            thumb, key = none if any_listed else F.array_min(others)["url"], none
            ext = U.image_extension(b["url"]) if any_listed else _path_ext(b["url"])
        height = F.when(w.isNotNull() & (height > 0), height.cast("int"))
        return F.struct(*[c.alias(f"c{i}") for i, c in enumerate((F.lit(name), b["url"], w, height, ext, thumb, key))]).cast(FOUND)

    claimed = member(src) & (U.host(F.col("page_url")).rlike(page) if page else F.lit(True)) & (U.param(src, need).isNotNull() if need else F.lit(True))
    return F.when(claimed, U.let(F.concat(F.array(own), rated), result))


def claims() -> Column:
    """Whether a row (page_url, src) is an image of one of the sites."""
    with as_text():
        page_url, src = F.col("page_url"), F.col("src")
        fits = [U.host(src).rlike(host) & U.path(src).rlike(path) & (U.host(page_url).rlike(page) if page else F.lit(True)) & (src.contains(need) if need else F.lit(True)) for _, page, host, path, need, _ in RULES]
        any_ = F.coalesce(reduce(lambda a, b: a | b, fits), F.lit(False))
    return column(any_)


def widest_listed(images: DataFrame) -> DataFrame:
    """images (page_url, src, listed: a srcset's candidates as split, natural_width, natural_height, …) plus resolver, original, width, height, ext, thumbnail and media_key.

    The widest listed rendition of the same image on the same host, the first of equally wide ones, and never a narrower one than src. A row of no such site
    (or of a null src) has src as its original and null for the rest. Columns of images that have one of the new names are replaced.
    """
    with as_text():
        found = F.coalesce(*[_rule(r) for r in RULES])
    kept = images.withColumn("_v", column(found))
    for c in ("resolver", "width", "height", "ext", "thumbnail", "media_key"):
        kept = kept.withColumn(c, F.col(f"_v.{c}"))
    return kept.withColumn("original", F.coalesce("_v.original", "src")).drop("_v")
