"""Media that a stored page of a known site lists, by a table of rules.

A rule says which pages are the site's (host and path, whose first group is the page's id), how the page is cut into
blocks, which patterns find an address in a block (in order of preference), and where its files may lie. Rules come to
the pages by a broadcast join on their number, so one expression serves all sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenweft.functions import url as U
from lumenweft.functions.url import absolute

VIDEO = r"(?i)\.(?:mp4|webm|mov|m4v)(?:[?#]|$)"
OG_IMAGE = [r'(?i)<meta[^>]+property="og:image"[^>]+content="([^"]+)"', r'(?i)<meta[^>]+content="([^"]+)"[^>]+property="og:image"']



def _img(mark: str) -> list[str]:
    """The address of an img element whose tag holds the mark."""
    return [rf"""(?i)<img\b(?=[^>]*{mark})[^>]*?\bsrc\s*=\s*{q}([^{q}]+){q}""" for q in ('"', "'")]


def _img_on(file: str) -> list[str]:
    """The address of an img element that lies at a file address."""
    return [rf"""(?i)<img\b[^>]*?\bsrc\s*=\s*["']({file}[^"']+)["']"""]


# Fixed values: (site, host, path with the id, block cut, patterns, file hosts, all matches or the first, numbered keys). File hosts None: the page's own domain.
RULES: list[tuple[str, str, str, str | None, list[str], str | None, bool, bool]] = [
    ("erome", r"(?:^|\.)erome\.com$", r"^/a/([A-Za-z0-9]+)(?:/|$)", r'(?i)<div\s+class="media-group"', [r'(?i)<source\b[^>]*\bsrc="([^"]+)"', r'(?i)\bdata-src="([^"]+)"'], r"(?:^|\.)erome\.com$", False, True),
    ("imgchest", r"(?:^|\.)imgchest\.com$", r"^/p/([A-Za-z0-9]+)(?:/|$)", None, [r"(?i)(https://cdn\.imgchest\.com/files/[A-Za-z0-9]+\.[a-z0-9]{1,5})"], r"(?:^|\.)imgchest\.com$", True, True),
    ("kemono", r"^(?:www\.)?(?:kemono|coomer)\.(?:cr|su|st|party)$", r"(?i)^/[a-z0-9_.-]+/user/[^/]+/post/([^/]+)", None, [r'(?i)(?:href|src)="(https?://(?![^"]*/thumbnail/)[^"]*/data/[^"]+)"'], r"^(?:[a-z0-9]+\.)?(?:kemono|coomer)\.(?:cr|su|st|party)$", True, True),
    ("lensdump", r"(?:^|\.)lensdump\.com$", r"^/i/([A-Za-z0-9]+)(?:/|$)", None, OG_IMAGE, r"(?:^|\.)(?:lensdump\.com|l3n\.co)$", False, False),
    ("motherless", r"(?:^|\.)motherless\.com$", r"^/([0-9A-Za-z]+)/?$", None, [r"""__fileurl\s*=\s*['"]([^'"]+)['"]"""], r"(?:^|\.)motherless(?:media)?\.com$", False, False),
    ("xvideos", r"(?:^|\.)xvideos[0-9]*\.com$", r"(?i)/video\.?([a-z0-9]+)(?:/|$)", None, [r"""(?i)html5player\.setVideoUrlHigh\(\s*['"]([^'"]+)['"]\s*\)""", r"""(?i)html5player\.setVideoUrlLow\(\s*['"]([^'"]+)['"]\s*\)"""], r"(?:^|\.)xvideos(?:[0-9]*|-cdn)?\.com$", False, False),
    ("szuru", r"^(?:www\.)?(?:snootbooru\.com|booru\.bcbnsfw\.space)$", r"^/post/(\d+)(?:/|$)", None, [r"(?i)((?:https?://[a-z0-9.-]+)?/data/posts/[A-Za-z0-9_.-]+\.[a-z0-9]{1,5})"], r"^(?:www\.)?(?:snootbooru\.com|booru\.bcbnsfw\.space)$", False, False),
    ("chevereto", r"^(?:www\.)?(?:jpe?g\d?\.(?:cr|su|pet|fish(?:ing)?|church)|imglike\.com|putme(?:ga\.com|\.ga))$", r"(?i)^/(?:im(?:g|age)|i)/([^/]+)", None, OG_IMAGE, ".", False, False),
    ("imgpile", r"(?:^|\.)imgpile\.com$", r"^/p/([A-Za-z0-9_-]+)(?:/|$)", r"""(?i)class\s*=\s*["'][^"']*\bpost-media\b""", [r"""(?i)<a\b[^>]*\bhref\s*=\s*["'](https://[^"']+)["']"""], ".", False, True),
    ("imghost", r"^(?:www\.)?(?:imgdrive\.net|imgtaxi\.(?:com|net)|imgwallet\.(?:com|net))$", r"(?i)^(/img-[a-z0-9]+\.html)$", None, OG_IMAGE, None, False, False),
    ("imghost", r"^(?:www\.)?imgspice\.com$", r"(?i)^(/.*\.html)$", None, _img(r"""\bid\s*=\s*["']imgpreview["']"""), None, False, False),
    ("imghost", r"^(?:www\.)?imgpv\.com$", r"(?i)^(/.*\.html)$", None, _img(r"""\bid\s*=\s*["']img-preview["']"""), None, False, False),
    ("imghost", r"^(?:www\.)?picstate\.com$", r"(?i)^(/view/full/.*)", None, [r"""(?is)id\s*=\s*["']image_container["'].{0,400}?<img\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']"""], None, False, False),
    ("imghost", r"(?:^|\.)imagebam\.com$", r"(?i)^(/(?:view|image)/.*)", None, _img_on(r"https?://images\d*\.imagebam\.com/"), None, False, False),
    ("imghost", r"(?:^|\.)imagevenue\.com$", r"(?i)^(/[A-Za-z0-9]{6,}/?$|/view/.*)", None, _img_on(r"""https?://img\d+\.imagevenue\.com/(?![^"']*loader\.svg)"""), None, False, False),
    ("imghost", r"(?:^|\.)pixhost\.to$", r"(?i)^(/show/.*)", None, _img(r"""\bclass\s*=\s*["'][^"']*\bimage-img\b"""), None, False, False),
    ("imghost", r"(?:^|\.)(?:imagetwist|imagehaha)\.com$", r"(?i)^(/[a-z0-9]{8,}/?)$", None, _img_on(r"""https?://img\d+\.(?:imagetwist|imagehaha)\.com(?![^"']*/imgs/)/"""), None, False, False),
]
# Hosts whose pages name the smaller of two sizes; sites whose files must be https; what stands for a missing file.
SMALL = r"^(?:www\.)?(?:imgdrive\.net|imgtaxi\.(?:com|net)|imgwallet\.(?:com|net))$"
SECURE = ("chevereto", "imgpile", "imghost")
PLACEHOLDER = r"(?i)loading\.svg(?:$|[?#])"
SCHEMA = "rule int, site string, path_pattern string, cut string, patterns array<string>, file_host string, every boolean, numbered boolean"


def _extract(text: Column, pattern: Column) -> Column:
    return F.call_function("regexp_extract", text, pattern, F.lit(1))


def page_media(pages: DataFrame) -> DataFrame:
    """(page_id, site, id, idx, kind, url, ext, media_key) of pages (page_id, url, html) of known sites; others, and null html, give none.

    Of a block the first pattern counts whose match is a file of the site's hosts; each address counts once a page; what is no file of the site's
    hosts, or of no known type, goes; idx numbers what is left.
    """
    h, p = U.host(F.col("url")), U.path(F.col("url"))
    number = F.coalesce(*[F.when(h.rlike(r[1]) & p.rlike(r[2]), F.lit(i)) for i, r in enumerate(RULES)])
    table = pages.sparkSession.createDataFrame([(i, r[0], *r[2:]) for i, r in enumerate(RULES)], SCHEMA)
    rows = pages.where("html is not null").withColumn("rule", number).where("rule is not null").join(F.broadcast(table), "rule")
    blocks = F.when(F.col("cut").isNull(), F.array("html")).otherwise(F.expr("slice(split(html, cut), 2, greatest(size(split(html, cut)) - 1, 0))"))
    rows = rows.select("page_id", "site", "patterns", "file_host", "every", "numbered", F.col("url").alias("page"), _extract(p, F.col("path_pattern")).alias("id"), F.posexplode(blocks).alias("block", "text"))
    own = F.concat(F.lit(r"(?:^|\.)"), F.replace(F.substring_index(U.host(F.col("page")), ".", -2), F.lit("."), F.lit(r"\.")), F.lit("$"))
    rows = rows.withColumn("file_host", F.coalesce("file_host", own))
    every = F.expr("regexp_extract_all(text, patterns[0], 1)")
    named = F.filter(F.transform("patterns", lambda x: _extract(F.col("text"), x)), lambda x: x != "")
    first = F.slice(F.filter(named, lambda x: F.regexp_like(U.host(absolute(x, F.col("page"))), F.col("file_host"))), F.lit(1), F.lit(1))
    found = rows.select("page_id", "site", "id", "file_host", "numbered", "page", "block", F.posexplode(F.when(F.col("every"), every).otherwise(first)).alias("k", "raw"))
    url = absolute(F.col("raw"), F.col("page"))
    url = F.when((F.col("site") == "imghost") & U.host(F.col("page")).rlike(SMALL), F.regexp_replace(url, "^(.*?)/small/", "$1/big/")).otherwise(url)
    named = F.regexp_extract("url", r"[?&]f=([^&]+)", 1)
    ext = F.coalesce(U.image_extension(F.col("url")), F.when(F.col("url").rlike(VIDEO), U.extension(F.col("url"))), U.image_extension(U.decode(named)), F.when(U.decode(named).rlike(VIDEO), U.extension(U.decode(named))))
    found = found.withColumn("url", url).withColumn("ext", ext).where(F.expr("url rlike '^https?://'") & F.col("ext").isNotNull())
    image, secure = F.col("ext").isin(*U.IMAGE_EXTENSIONS), F.col("url").rlike("(?i)^https://")
    found = found.where(~F.col("site").isin(*SECURE) | secure).where((F.col("site") != "imghost") | image).where((F.col("site") != "chevereto") | ~F.col("url").rlike(PLACEHOLDER))
    found = found.withColumn("host", U.host(F.col("url"))).where(F.expr("host rlike file_host"))
    once = W.partitionBy("page_id", U.bare(F.col("url"))).orderBy("block", "k")
    found = found.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    idx = F.row_number().over(W.partitionBy("page_id").orderBy("block", "k")) - 1
    found = found.withColumn("idx", idx)
    key = F.when(F.col("site") == "kemono", F.concat_ws(" ", "site", "id", U.last_segment(F.col("url")))).when(F.col("site").isin("szuru", "chevereto"), F.concat_ws(" ", "site", U.host(F.col("page")), "id")).when(F.col("site") == "imghost", F.concat(F.lit("imghost "), U.host(F.col("page")), "id")).when(F.col("numbered"), F.concat_ws(" ", "site", "id", F.col("idx").cast("string"))).otherwise(F.concat_ws(" ", "site", "id"))
    kind = F.when(F.col("ext") == "gif", "gif").when(F.col("ext").isin(*U.IMAGE_EXTENSIONS), "image").otherwise("video")
    return found.select("page_id", "site", "id", "idx", kind.alias("kind"), "url", "ext", key.alias("media_key"))
