"""Originals that a page names elsewhere than in the image: around it, beside it, in its head or its links.

Each site has steps, held as data: where to look (the nearest enclosing element of a name, the first of a name inside
of that, or the first of a name in the document) and which attribute to take. Steps are tried in order. What they give
is an address of the page's own markup, never a made one, and counts only on the hosts that belong to the site.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as SF

from lumenweft.functions import url as U
from lumenweft.functions.text import F, compiled
from lumenweft.functions.url import absolute
from lumenweft.operators import tree as T
from lumenweft.sources.shared import stored

FOUND = "original string, kind string, ext string, thumbnail string, width int, height int, media_key string, pending boolean, platform string, hint string"

# Hosts of pages, resolver, and the hosts (and those below) that originals are on.
SITES: list[tuple[str, str, tuple[str, ...]]] = [
    ("danbooru.donmai.us", "booru", ("donmai.us",)), ("safebooru.donmai.us", "booru", ("donmai.us",)), ("gelbooru.com", "booru", ("gelbooru.com",)), ("safebooru.org", "booru", ("safebooru.org",)),
    ("yande.re", "booru", ("yande.re",)), ("konachan.com", "booru", ("konachan.com",)), ("konachan.net", "booru", ("konachan.net",)), ("e621.net", "booru", ("e621.net",)), ("e926.net", "booru", ("e926.net",)), ("e6ai.net", "booru", ("e6ai.net",)),
    ("rule34.xxx", "booru", ("rule34.xxx",)), ("tbib.org", "booru", ("tbib.org",)), ("hypnohub.net", "booru", ("hypnohub.net",)), ("xbooru.com", "booru", ("xbooru.com",)), ("realbooru.com", "booru", ("realbooru.com",)),
    ("derpibooru.org", "booru", ("derpicdn.net",)), ("furbooru.org", "booru", ("furrycdn.org",)), ("ponybooru.org", "booru", ("ponybooru.org",)), ("twibooru.org", "booru", ("twibooru.org",)),
    ("www.sakugabooru.com", "booru", ("sakugabooru.com",)), ("sakugabooru.com", "booru", ("sakugabooru.com",)),
    ("zerochan.net", "zerochan", ("zerochan.net",)), ("www.zerochan.net", "zerochan", ("zerochan.net",)),
    ("boards.4chan.org", "fourchan", ("4cdn.org",)), ("boards.4channel.org", "fourchan", ("4cdn.org",)),
    ("desuarchive.org", "foolfuuka", ("desu-usergeneratedcontent.xyz",)), ("archive.4plebs.org", "foolfuuka", ("4pcdn.org", "4plebs.org")),
    ("pikabu.ru", "pikabu", ("pikabu.ru",)), ("www.pikabu.ru", "pikabu", ("pikabu.ru",)),
    ("postimg.cc", "postimages", ("postimg.cc",)), ("www.postimg.cc", "postimages", ("postimg.cc",)), ("postimages.org", "postimages", ("postimg.cc",)), ("www.postimages.org", "postimages", ("postimg.cc",)),
    ("4kwallpapers.com", "wallpaper-hosts", ("4kwallpapers.com",)), ("wallpaperswide.com", "wallpaper-hosts", ("wallpaperswide.com",)),
]
# What elements are called here, and what they are.
SELECTORS: dict[str, T.Selector] = {
    "file url": (("", (("data-file-url", "has", ""),)),),
    "large file url": (("", (("data-large-file-url", "has", ""),)),),
    "uris": (("", (("data-uris", "has", ""),)),),
    "full link": (("a", (("class", "word", "original-file-unchanged"),)), ("a", (("class", "word", "original-file-changed"),)), ("a", (("class", "word", "highres-show"),)), ("a", (("id", "is", "highres"),))),
    "images link": (("a", (("href", "holds", "/images/"),)),),
    "large": (("", (("id", "is", "large"),)),),
    "preview": (("a", (("class", "word", "preview"),)),),
    "facts": (("script", (("type", "is", "application/ld+json"),)),),
    "thumb link": (("a", (("class", "word", "fileThumb"),)),),
    "file": (("", (("class", "word", "file"),)),),
    "chan post": (("", (("class", "word", "post"),)), ("", (("class", "word", "postContainer"),))),
    "file text": (("", (("class", "word", "fileText"),)),),
    "link": (("a", ()),),
    "thread image": (("a", (("class", "word", "thread_image_link"),)),),
    "fuuka post": (("", (("class", "word", "post"),)),),
    "story link": (("a", (("class", "word", "story-image__link"),)),),
    "story image": (("", (("class", "word", "story-image"),)),),
    "download": (("a", (("id", "is", "download"),)),),
    "wallpaper": (("a", (("href", "begins", "/images/wallpapers/"),)),),
    "resolution": (("a", (("href", "begins", "/download/"),)),),
    "resolutions": (("div", (("class", "word", "wallpaper-resolutions"),)),),
    "sizes link": (("a", (("href", "holds", "/download/"),)),),
    "og image": (("meta", (("property", "is", "og:image"),)),),
    "icon download": (("a", (("class", "word", "icon-download"),)), ("a", (("href", "holds", "/pictures/download_image/"),))),
    "cell": (("", (("data-test-id", "has", ""),)),),
    "artwork": (("a", (("href", "holds", "/artwork/"),)),),
    "moving": (("video", ()), ("iframe", (("src", "holds", "embed.html"),)), ("", (("class", "holds, in any case", "video"),)), ("", (("data-test-id", "holds, in any case", "video"),))),
}
#: Names that hold only inside of another one: (new name, name, inside of).
INSIDE = (("file text link", "link", "file text"), ("resolution link", "resolution", "resolutions"))
#: resolver, group, step, nearest enclosing name (None: the document), first name in it (None: that element itself), attribute. In a group the first that is there counts; an empty one ends its group.
STEPS: list[tuple[str, int, int, str | None, str | None, str]] = [
    ("booru", 0, 0, "file url", None, "data-file-url"),
    ("booru", 0, 1, "large file url", None, "data-large-file-url"),
    ("booru", 1, 0, "uris", None, "data-uris"),
    ("booru", 2, 0, None, "full link", "href"),
    ("booru", 3, 0, None, "images link", "href"),
    ("zerochan", 0, 1, "large", "preview", "href"),
    ("fourchan", 0, 0, "thumb link", None, "href"),
    ("fourchan", 0, 1, "file", "thumb link", "href"),
    ("fourchan", 0, 2, "chan post", "file text link", "href"),
    ("foolfuuka", 0, 0, "thread image", None, "href"),
    ("foolfuuka", 0, 1, "fuuka post", "thread image", "href"),
    ("pikabu", 0, 0, "story link", None, "href"),
    ("pikabu", 0, 1, "story image", "story link", "href"),
    ("postimages", 0, 0, None, "download", "href"),
]
#: Resolvers that images are given by their own address: (resolver, hosts of images, path).
BY_IMAGE = (("wallpaperscraft", r"^images\.wallpaperscraft\.com$", r"^/image/single/"), ("animepictures", r"^opreviews\.anime-pictures\.net$", r"(?i)/[0-9a-f]{32}_[a-z]{2}\.avif$"), ("artstation", r"(?i)^cdn[ab]\.artstation\.com$", r"(?i)/p/assets/.*/images/.*/(?:micro_square|smaller_square|small_square|small|medium|large|4k)/"))
ANIME_PAGE = r"(?i)^(?:www\.)?anime-pictures\.net$"
KEY = ["page_key", "at", "src"]


@compiled
def claimed(page_url: Column, src: Column) -> Column:
    """struct<resolver, pins>: the resolver of SITES or BY_IMAGE that an image is for, or null."""
    host = U.host(page_url)
    sites = F.create_map(*[x for h, r, pins in SITES for x in (F.lit(h), F.struct(F.lit(r).alias("resolver"), F.array(*map(F.lit, pins)).alias("pins")))])
    own = lambda r, at, p: (U.host(src).rlike(at) & U.path(src).rlike(p) & (host.rlike(ANIME_PAGE) if r == "animepictures" else F.lit(True)))
    by_image = F.coalesce(*[F.when(own(*rule), F.lit(rule[0])) for rule in BY_IMAGE])
    return F.coalesce(F.try_element_at(sites, host), F.when(by_image.isNotNull(), F.struct(by_image.alias("resolver"), F.array().cast("array<string>").alias("pins"))))


def on_hosts(address: Column, pins: Column) -> Column:
    """address if it is https on one of the hosts or below one of them, else null."""
    host = U.host(address)
    return F.when(address.rlike(r"(?i)^https://") & F.exists(pins, lambda p: (host == p) | host.endswith(F.concat(F.lit("."), p))), address)


def _text(v: Column, path: str) -> Column:
    """The string at a path of a variant; null if there is none or something else."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _first_inside(found: DataFrame, scopes: DataFrame) -> DataFrame:
    """scopes (page_key, first, last, root_no, target) -> value: the first element called target inside; a null attribute is none."""
    inner = found.select("page_key", F.col("name").alias("target"), F.col("elem_ordinal").alias("at"), F.col("attrs").alias("_attrs"))
    both = T.enclosed(inner, scopes, ("page_key", "target")).where("at > first")
    return both.groupBy("page_key", "target", "first").agg(F.min_by("_attrs", "at").alias("attrs"))


def _stepped(images: DataFrame, found: DataFrame) -> DataFrame:
    """KEY, group, step, value of every step of the images' resolvers that finds an element with the attribute."""
    spark = images.sparkSession
    steps = SF.broadcast(spark.createDataFrame(STEPS, "resolver string, grp int, step int, scope string, target string, attribute string"))  # as many rows as steps
    todo = images.select(*KEY, "doc_no", "resolver").join(steps, "resolver")
    scopes = T.intervals(found, F.col("name").alias("scope"), F.col("attrs").alias("_own"))
    near = T.enclosed(todo.where("scope is not null"), scopes, ("page_key", "scope")).groupBy(*KEY, "grp", "step", "target", "attribute").agg(F.max_by(F.struct("first", "last", "_own"), "first").alias("near"))
    value = lambda attrs: F.try_element_at(attrs, F.col("attribute"))
    out = near.where("target is null").select(*KEY, "grp", "step", value(F.col("near._own")).alias("value"))
    within = near.where("target is not null").select(*KEY, "grp", "step", "target", "attribute", "near.first", "near.last")
    first = _first_inside(found, within.select("page_key", "target", "first", "last").distinct())
    out = out.unionByName(within.join(first, ["page_key", "target", "first"]).select(*KEY, "grp", "step", value(F.col("attrs")).alias("value")))
    whole = found.where("root_no = doc_no").groupBy("page_key", "doc_no", F.col("name").alias("target")).agg(F.min_by("attrs", "elem_ordinal").alias("attrs"))
    out = out.unionByName(todo.where("scope is null").join(whole, ["page_key", "doc_no", "target"]).select(*KEY, "grp", "step", value(F.col("attrs")).alias("value")))
    return out.where("value is not null")


def _described(images: DataFrame, found: DataFrame) -> DataFrame:
    """KEY, group, step, value: the address in a page's JSON-LD of an image that stands in the page's main frame."""
    doc = found.where("name = 'facts' and root_no = doc_no").select("page_key", "doc_no", "elem_ordinal", F.try_parse_json("text").alias("v")).where("v is not null")
    nodes = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$['@graph']", "array<variant>"), F.array("v"))
    nodes = doc.select("page_key", "doc_no", "elem_ordinal", F.posexplode(nodes).alias("n", "node"))
    address, type_ = _text(F.col("node"), "$.contentUrl"), "$['@type']"
    untyped = F.try_variant_get("node", type_, "variant").isNull()
    good = nodes.where(address.isNotNull() & (untyped | (_text(F.col("node"), type_) == "ImageObject"))).select("page_key", "doc_no", F.struct("elem_ordinal", "n").alias("o"), address.alias("value"))
    first = good.groupBy("page_key", "doc_no").agg(F.min_by("value", "o").alias("value"))
    large = T.intervals(found.where("name = 'large'"))
    inside = T.enclosed(images.where("resolver = 'zerochan'").select(*KEY, "doc_no"), large).select(*KEY, "doc_no").distinct()
    return inside.join(first, ["page_key", "doc_no"]).select(*KEY, F.lit(0).alias("grp"), F.lit(0).alias("step"), "value")


def _largest(found: DataFrame) -> DataFrame:
    """page_key, doc_no, value: the link of a wallpaper page with the largest stated size, the first of as large ones."""
    rows = found.where("name in ('wallpaper', 'resolution link') and root_no = doc_no").select("page_key", "doc_no", "name", "elem_ordinal", F.try_element_at("attrs", F.lit("href")).alias("href"))
    side = lambda g: F.regexp_extract("href", r"(\d{2,5})x(\d{2,5})", g).try_cast("bigint")
    rated = rows.withColumn("area", side(1) * side(2)).where("area is not null")
    return rated.groupBy("page_key", "doc_no", "name").agg(F.max_by("href", F.struct("area", -F.col("elem_ordinal"))).alias("value"))


def _site_originals(images: DataFrame, found: DataFrame) -> DataFrame:
    """KEY and FOUND of images on pages of SITES."""
    image = F.col("image_id") == "image"
    steps = stored(_stepped(images, found).unionByName(_described(images, found)), "steps").join(images.select(*KEY, "image_id", "resolver"), KEY)
    steps = steps.where((F.col("resolver") != "booru") | (F.col("grp") < 2) | F.coalesce(image, F.lit(False)))
    # In a group the first value counts; the first group counts whose value is not empty.
    ordered = steps.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("grp", "step", "value"))).alias("s"))
    heads = F.filter("s", lambda x, i: (i == 0) | (F.get(F.col("s"), i - 1)["grp"] != x["grp"]))
    full = lambda x: F.when(x["grp"] == 1, _text(F.try_parse_json(x["value"]), "$.full")).otherwise(x["value"])
    raw = F.get(F.filter(F.transform(heads, full), lambda v: F.coalesce(v != "", F.lit(False))), F.lit(0))
    by_step = ordered.select(*KEY, raw.alias("raw"))
    of = {"4kwallpapers.com": "wallpaper", "wallpaperswide.com": "resolution link"}
    name = reduce(lambda a, b: F.when(U.host(F.col("page_url")) == b[0], b[1]).otherwise(a), of.items(), F.lit(None).cast("string"))
    sized = images.where("resolver = 'wallpaper-hosts'").withColumn("name", name).join(_largest(found), ["page_key", "doc_no", "name"]).select(*KEY, F.col("value").alias("raw"))
    art = T.intervals(found.where("name in ('file url', 'large file url')"), "attrs")
    art = T.enclosed(images.where("resolver = 'booru'").select(*KEY), art).groupBy(*KEY).agg(F.max_by("attrs", "first").alias("art"))
    rows = images.join(by_step.unionByName(sized), KEY).join(art, KEY, "left")
    x = F.when(F.col("raw").startswith("//"), F.concat(F.lit("https:"), "raw")).otherwise(F.col("raw"))
    x = F.when(F.col("resolver") == "postimages", F.regexp_replace(x, r"\?dl=1$", "")).otherwise(x)
    rows = rows.withColumn("original", on_hosts(absolute(x, F.col("page_url")), F.col("pins"))).where("original is not null and original <> src")
    o, r = F.col("original"), F.col("resolver")
    ext = U.extension(o)
    video = F.when(ext.isin("mp4", "webm"), "video").when(ext == "gif", "gif").otherwise("image")
    tim = F.nullif(F.regexp_extract(o, r"(?i)/(\d+)\.[a-z0-9]+$", 1), F.lit(""))
    attr = lambda c, a: F.try_element_at(c, F.lit(a))
    side = lambda a: attr("art", a).try_cast("int")
    both = (r == "booru") & (side("data-width") > 0) & (side("data-height") > 0)
    ident = F.nullif(F.coalesce(attr("art", "data-id"), F.col("image_data_id")), F.lit(""))
    host = U.host(F.col("page_url"))
    key = F.when(r == "booru", F.concat(F.lit("booru "), host, F.lit(" "), ident)).when(r == "fourchan", F.concat(F.lit("4chan "), tim)).when(r == "foolfuuka", F.concat(F.lit("foolfuuka "), host, F.lit(" "), tim))
    kind = F.when(r.isin("zerochan", "wallpaper-hosts"), "image").otherwise(video)
    return _of(rows, original=o, kind=kind, ext=ext, thumbnail=F.col("src"), width=F.when(both, side("data-width")), height=F.when(both, side("data-height")), media_key=key)


def _of(rows: DataFrame, **values: Column) -> DataFrame:
    cols = [values.get(c.split()[0], F.lit(None)).cast(c.split()[1]).alias(c.split()[0]) for c in FOUND.split(", ")]
    return rows.select(*KEY, "resolver", *cols)


def _wallpaperscraft(images: DataFrame, found: DataFrame) -> DataFrame:
    """The largest size that a page's links list for an image, put into the image's own address; only if it is larger."""
    single = r"(?i)^/image/single/(.+)_(\d+)x(\d+)\.([a-z0-9]+)$"
    part = lambda g: F.regexp_extract(U.path(F.col("src")), single, g)
    mine = images.where("resolver = 'wallpaperscraft'").withColumns({"slug": part(1), "_w": part(2).try_cast("bigint"), "_h": part(3).try_cast("bigint"), "_x": part(4)}).where("slug <> ''")
    links = found.where("name = 'sizes link' and root_no = doc_no").select("page_key", "doc_no", "elem_ordinal", F.posexplode(F.regexp_extract_all(F.try_element_at("attrs", F.lit("href")), F.lit(r"(?i)/download/[^/?#]+/\d+x\d+(?=[/?#]|$)"), F.lit(0))).alias("n", "m"))
    cut = lambda g: F.regexp_extract("m", r"(?i)^/download/([^/?#]+)/(\d+)x(\d+)", g)
    sizes = links.select("page_key", "doc_no", cut(1).alias("slug"), cut(2).try_cast("bigint").alias("w"), cut(3).try_cast("bigint").alias("h"), F.struct(-F.col("elem_ordinal"), -F.col("n")).alias("o")).where("w * h > 0")
    top = sizes.groupBy("page_key", "doc_no", "slug").agg(F.max_by(F.struct("w", "h"), F.struct(F.col("w") * F.col("h"), "o")).alias("t"))
    rows = mine.join(top, ["page_key", "doc_no", "slug"]).where("t.w * t.h > _w * _h")
    text = lambda c: F.col(c).cast("string")
    full = F.concat(F.lit("https://images.wallpaperscraft.com/image/single/"), "slug", F.lit("_"), text("t.w"), F.lit("x"), text("t.h"), F.lit("."), "_x")
    return _of(rows, original=full, kind=F.lit("image"), ext=U.extension(full), thumbnail=F.col("src"), width=F.col("t.w"), height=F.col("t.h"))


def _animepictures(images: DataFrame, found: DataFrame) -> DataFrame:
    """The download that a post's page links, for the image that the page's og:image is a rendition of."""
    md5 = lambda x: F.lower(F.regexp_extract(U.path(x), r"(?i)/([0-9a-f]{32})_[a-z]{2}\.avif$", 1))
    attr = lambda a: F.try_element_at("attrs", F.lit(a))
    first = lambda name, a: F.min_by(attr(a), F.when(F.col("name") == name, F.col("elem_ordinal")))
    named = found.where("name in ('og image', 'icon download') and root_no = doc_no").groupBy("page_key", "doc_no").agg(first("og image", "content").alias("og"), first("icon download", "href").alias("href"))
    rows = images.where("resolver = 'animepictures'").join(named, ["page_key", "doc_no"]).withColumn("original", on_hosts(absolute(F.col("href"), F.col("page_url")), F.array(F.lit("anime-pictures.net"))))
    rows = rows.where((md5(absolute(F.col("og"), F.col("page_url"))) == md5(F.col("src"))) & U.path(F.col("original")).contains("/pictures/download_image/"))
    ext = F.lower(F.nullif(F.regexp_extract("original", r"(?i)\.([a-z0-9]{3,4})$", 1), F.lit("")))
    return _of(rows, original=F.col("original"), kind=F.when(ext == "gif", "gif").otherwise("image"), ext=ext, thumbnail=F.col("src"), media_key=F.concat(F.lit("animepictures "), md5(F.col("src"))))


def _artstation(images: DataFrame, found: DataFrame, elems: DataFrame) -> DataFrame:
    """A clip that is still to be found out, where the image's cell shows one and its project is known; else a hint for a larger image."""
    mine = images.where("resolver = 'artstation'")
    around = T.enclosed(mine.select(*KEY), T.intervals(found.where("name in ('cell', 'artwork')"), "name", "parent", F.try_element_at("attrs", F.lit("href")).alias("href")))
    near = lambda name, c: F.max_by(F.col(c), F.when(F.col("name") == name, F.col("first")))
    around = around.groupBy(*KEY).agg(near("cell", "first").alias("cell"), near("artwork", "parent").alias("above"), near("artwork", "href").alias("href"))
    in_page = lambda c: F.when(F.col(c) >= 0, F.col(c))
    rows = mine.join(around, KEY, "left").withColumn("scope", F.coalesce("cell", in_page("above"), in_page("parent"), "at"))
    scopes = rows.select("page_key", F.col("scope").alias("elem_ordinal")).distinct().join(elems.select("page_key", "elem_ordinal", "subtree_end"), ["page_key", "elem_ordinal"])
    moving = T.enclosed(T.places(found.where("name = 'moving'")), T.intervals(scopes)).where("at > first").select("page_key", F.col("first").alias("scope"), F.lit(True).alias("moves")).distinct()
    project = lambda x: F.nullif(F.regexp_extract(x, r"/artwork/([A-Za-z0-9]+)", 1), F.lit(""))
    rows = rows.join(moving, ["page_key", "scope"], "left").withColumn("project", F.coalesce(project(F.col("href")), project(F.col("page_url"))))
    clip = F.coalesce(F.col("moves"), F.lit(False)) & F.col("project").isNotNull()
    # the CDN rule of this host puts the size that can be had into the path
    large = F.regexp_replace("src", r"/(?:micro_square|smaller_square|small_square|small|medium)/", "/large/")
    image = lambda c: F.when(~clip, c)
    return _of(
        rows, original=F.when(clip, F.col("src")).otherwise(large), kind=F.when(clip, "video").otherwise("image"), ext=F.when(clip, "mp4").otherwise(U.image_extension(large)), thumbnail=image(F.when(large != F.col("src"), F.col("src"))),
        pending=F.when(clip, True), platform=F.lit("artstation"), hint=F.when(clip, F.concat(F.lit("vid "), "project")).otherwise(F.concat(F.lit("img "), large)),
    )


def element_originals(images: DataFrame, elems: DataFrame) -> DataFrame:
    """images (page_key, page_url, at: the ordinal of the element, src) -> page_key, at, src, resolver and FOUND.

    elems: of extract.elements(), stored. One row for each image of which a page names another original; images of other
    sites, of elements that are not there, and those whose page names none have no row. Images that repeat count once.
    """
    every = images.select(*KEY, "page_url").where("page_key is not null and at is not null and src is not null").distinct()
    every = every.withColumn("claim", claimed(F.col("page_url"), F.col("src"))).where("claim is not null").select(*KEY, "page_url", "claim.*")
    attr = lambda a: F.try_element_at("attrs", F.lit(a))
    own = elems.select("page_key", F.col("elem_ordinal").alias("at"), "doc_no", "parent", attr("id").alias("image_id"), attr("data-id").alias("image_data_id"))
    mine = stored(every.join(own, ["page_key", "at"]), "claimed")
    if mine.isEmpty():
        return images.sparkSession.createDataFrame([], f"page_key bigint, at int, src string, resolver string, {FOUND}")
    near = elems.join(mine.select("page_key").distinct(), "page_key", "left_semi")
    found = T.hits(near, SELECTORS)
    for new, name, outside in INSIDE:
        both = T.enclosed(T.places(found.where(F.col("name") == name), "root_no", "doc_no", "parent", "subtree_end", "tag", "attrs", "text"), T.intervals(found.where(F.col("name") == outside))).where("at > first")
        inner = both.drop("first", "last").dropDuplicates(["page_key", "at"]).withColumnRenamed("at", "elem_ordinal").withColumn("name", F.lit(new))
        found = found.unionByName(inner)
    found = stored(found, "found")
    # each kind of resolver is a plan of its own, so that none grows with their number; their rows are few and narrow
    parts = {"site": _site_originals, "wallpaperscraft": _wallpaperscraft, "animepictures": _animepictures, "artstation": _artstation}
    return reduce(DataFrame.unionByName, [stored(part(mine, found, *([near] if name == "artstation" else [])), name) for name, part in parts.items()])
