"""Captured JSON of sites that serve media under signed or nested addresses: deep walks over VARIANT values, by owner.

A body is parsed once into a VARIANT. The walk goes down level by level: every object and array is a row, its children
come from one explode, and a row inherits from above what its media belong to: the nearest id (its owner), the nearest
array element (its group) and the key that it stands under. So a large body is spread over rows, and no code walks it.
Levels are written to one folder of the shared storage; each site's shapes are then looked for in all levels at once.

Order is that of the walk, with an object's keys in alphabetical order, as VARIANT keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenweft.functions import url as U
from lumenweft.sources.shared import scratch, stored

FACTS = "platform string, owner_id string, kind string, url string, ext string, width int, height int, poster string, pending boolean, ord string, payload_id bigint"
NODE = "payload_id bigint, platform string, depth int, path string, owner string, grp string, key string, v variant"
#: Levels of a body; deeper parts are not looked at.
MOST_LEVELS = 200
# Hosts of media, ids of owners, texts without one of which a body has none, keys of a video's addresses by preference, keys of what is no media of its own.
HOSTS = {"facebook": ("fbcdn.net", "cdninstagram.com"), "pinterest": ("pinimg.com",)}
OWNER = {"facebook": r"^\d{1,32}$", "pinterest": r"^\d{6,}$"}
GATES = {"facebook": r"fbcdn|cdninstagram|playable_url", "pinterest": r"pinimg"}
VIDEO_KEYS = ("playable_url_quality_hd", "browser_native_hd_url", "playable_url", "browser_native_sd_url", "progressive_url")
CHROME_KEY = r"(?i)blur|preview|placeholder|thumbnail|icon"
LEAST_SIDE = 128
FB_EXT = r"(?i)\.(jpe?g|png|webp|gif|avif|heic|mp4|mov|webm|m4v)$"
PIN_EXT = r"(?i)\.(jpe?g|png|webp|gif|avif|mp4|m3u8|mov|webm|m4v)$"
CHAPTER = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})(?:[/?#]|$)"
#: Platform, host of its pages, and where an address names the item that a page is of, in order.
PAGES = (
    ("facebook", r"(?:^|\.)facebook\.com$", (r"[?&]fbid=(\d{1,32})", r"[?&]v=(\d{1,32})", r"/videos/(\d{1,32})", r"/reels?/(\d{1,32})", r"/photos?/(\d{1,32})")),
    ("pinterest", r"(?:^|\.)pinterest\.(?:com|at|ca|ch|cl|co\.kr|co\.uk|com\.au|com\.mx|de|dk|es|fr|ie|it|jp|nz|ph|pt|ru|se|info)$", (r"/pin/(?:[^/]*--)?(\d+)(?:[/?#]|$)",)),
    ("mangadex", r"(?:^|\.)mangadex\.org$", (r"/chapter/" + CHAPTER,)),
)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text(v: Column, path: str) -> Column:
    """The string at a path, else null."""
    return F.when(F.schema_of_variant(_at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def number(v: Column, path: str) -> Column:
    """The number above zero at a path, else null. A number in a string is none."""
    x = F.try_variant_get(v, path, "double")
    return F.when(F.schema_of_variant(_at(v, path)).rlike("^(?:BIGINT|DOUBLE|DECIMAL)") & (x > 0), x)


def pinned(platform: str, x: Column) -> Column:
    """x if it is https on one of the platform's hosts, else null."""
    return F.when(x.rlike("(?i)^https://") & U.under(U.host(x), *HOSTS[platform]), x)


def _roots(payloads: DataFrame) -> DataFrame:
    """The values of bodies: JSON, or lines of it, behind a prefix against inclusion."""
    body = F.regexp_replace(F.trim("body"), r"^(?:for\s*\(;;\);|\)\]\}'[^\n]*\n?)", "")
    gate = F.lit(False)
    for platform, pattern in GATES.items():
        gate = gate | ((F.col("platform") == platform) & F.col("body").rlike(pattern))
    rows = payloads.where(gate).select("payload_id", "platform", body.alias("body"))
    # a first line that is a value of its own is one of several; parsing alone would not tell, as it stops behind a value
    first = F.try_parse_json(F.substring_index("body", "\n", 1))
    lines = rows.select("payload_id", "platform", F.posexplode(F.when(first.isNull(), F.array("body")).otherwise(F.split("body", r"\r?\n"))).alias("n", "line"))
    none = F.lit("")
    return lines.select("payload_id", "platform", F.lit(0).alias("depth"), F.lpad(F.col("n").cast("string"), 6, "0").alias("path"), none.alias("owner"), F.lpad(F.col("n").cast("string"), 6, "0").alias("grp"), none.alias("key"), F.try_parse_json("line").alias("v")).where("v is not null")


def _owned(rows: DataFrame) -> DataFrame:
    """rows with their own id as the owner, where it looks like one of the platform's."""
    own = text(F.col("v"), "$.id")
    fits = F.lit(False)
    for platform, pattern in OWNER.items():
        fits = fits | ((F.col("platform") == platform) & own.rlike(pattern))
    return rows.withColumn("owner", F.when(F.coalesce(fits, F.lit(False)), own).otherwise(F.col("owner")))


def _children(rows: DataFrame) -> DataFrame:
    """The objects and arrays right below rows."""
    members = F.try_variant_get("v", "$", "map<string,variant>")
    entries = F.transform(F.map_entries(members), lambda e, i: F.struct(i.alias("i"), e["key"].alias("key"), e["value"].alias("v"), F.lit(False).alias("item")))
    items = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x, i: F.struct(i.alias("i"), F.col("key").alias("key"), x.alias("v"), F.lit(True).alias("item")))
    each = rows.select("payload_id", "platform", "depth", "path", "owner", "grp", F.explode(F.coalesce(items, entries)).alias("c"))
    path = F.concat_ws(".", "path", F.lpad(F.col("c.i").cast("string"), 6, "0"))
    out = each.select("payload_id", "platform", (F.col("depth") + 1).alias("depth"), path.alias("path"), "owner", F.when(F.col("c.item"), path).otherwise(F.col("grp")).alias("grp"), F.col("c.key").alias("key"), F.col("c.v").alias("v"))
    inside = F.coalesce(F.size(F.try_variant_get("v", "$", "array<variant>")), F.size(F.try_variant_get("v", "$", "map<string,variant>")))
    return _owned(out.where(F.coalesce(inside, F.lit(0)) > 0))


def walked(payloads: DataFrame) -> DataFrame:
    """NODE: every object and array of payloads (payload_id, platform, body), with what it inherits."""
    spark = payloads.sparkSession
    folder, schema = scratch(spark, "walk"), NODE
    level = _owned(_roots(payloads))
    for depth in range(MOST_LEVELS):
        path = f"{folder}/{depth:03d}"
        level.select(*[c.split()[0] for c in schema.split(", ")]).write.parquet(path)
        done = spark.read.schema(schema).parquet(path)
        if done.isEmpty():
            break
        level = _children(done)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


# ---- shapes -----------------------------------------------------------------------------------------------------
def _facebook(nodes: DataFrame) -> DataFrame:
    """Videos by the first of their address keys; images of a size, of each owner and group the largest."""
    v = F.col("v")
    rows = nodes.where("platform = 'facebook' and owner <> ''")
    path = lambda x: F.regexp_extract(U.path(x), FB_EXT, 1)
    ext = lambda x: U.let(F.lower(path(x)), lambda e: F.when(e.isin("", "jpeg"), "jpg").otherwise(e))
    video = F.coalesce(*[pinned("facebook", text(v, f"$.{k}")) for k in VIDEO_KEYS])
    poster = pinned("facebook", text(v, "$.preferred_thumbnail.image.uri"))
    w, h = number(v, "$.width"), number(v, "$.height")
    image = F.when(~F.col("key").rlike(CHROME_KEY) & (w >= LEAST_SIDE) & (h >= LEAST_SIDE), pinned("facebook", text(v, "$.uri")))
    found = rows.select("payload_id", "owner", "grp", "path", video.alias("video"), poster.alias("poster"), image.alias("image"), w.cast("int").alias("w"), h.cast("int").alias("h"))
    one = lambda kind, url, *more: found.where(F.col(url).isNotNull()).select("payload_id", "owner", "grp", "path", F.lit(kind).alias("kind"), F.col(url).alias("url"), *more)
    none = F.lit(None)
    every = one("video", "video", F.lit(0).alias("k"), F.when(ext(F.col("video")) == "jpg", "mp4").otherwise(ext(F.col("video"))).alias("ext"), none.cast("int").alias("width"), none.cast("int").alias("height"), "poster")
    every = every.unionByName(one("image", "image", F.lit(1).alias("k"), ext(F.col("image")).alias("ext"), F.col("w").alias("width"), F.col("h").alias("height"), none.cast("string").alias("poster")))
    # an owner's address counts once a body, where it comes first
    place = F.struct("path", "k")
    once = every.groupBy("payload_id", "owner", "url").agg(F.min_by(F.struct("grp", "kind", "ext", "width", "height", "poster", place.alias("place")), place).alias("f")).select("payload_id", "owner", "url", "f.*")
    area = F.coalesce(F.col("width").cast("bigint") * F.col("height"), F.lit(0))
    images = once.where("kind = 'image'").groupBy("payload_id", "owner", "grp").agg(F.min_by(F.struct("url", "kind", "ext", "width", "height", "poster", "place"), F.struct(-area, F.col("place"))).alias("f")).select("payload_id", "owner", "grp", "f.*")
    # images come before videos in what a body gives
    kept = images.unionByName(once.where("kind = 'video'").select(*images.columns))
    order = F.concat(F.when(F.col("kind") == "image", "0 ").otherwise("1 "), F.col("place.path"))
    return kept.select(F.lit("facebook").alias("platform"), F.col("owner").alias("owner_id"), "kind", "url", "ext", "width", "height", "poster", F.lit(None).cast("boolean").alias("pending"), order.alias("ord"), "payload_id")


def _pinterest(nodes: DataFrame) -> DataFrame:
    """A pin's video (the mp4 before the streams), else its image (the original before the widest); every address once a body."""
    v = F.col("v")
    type_ = text(v, "$.type")
    slots = F.try_variant_get(v, "$.carousel_data.carousel_slots", "array<variant>")
    rows = nodes.where("platform = 'pinterest' and owner <> ''").where((type_.isNull() | type_.isin("pin", "story")) & slots.isNull() & (_at(v, "$.images").isNotNull() | _at(v, "$.videos").isNotNull()))
    address = lambda x, p="$.url": pinned("pinterest", text(x, p))
    side = lambda x, p: F.coalesce(F.try_variant_get(x, p, "double"), F.lit(0.0))
    sized = F.transform(F.map_values(F.try_variant_get(v, "$.images", "map<string,variant>")), lambda x, i: F.struct(side(x, "$.width").alias("w"), (-i).alias("place"), address(x).alias("url"), side(x, "$.height").alias("h")))
    widest = F.array_max(F.filter(sized, lambda x: x["url"].isNotNull()))
    orig = F.when(address(v, "$.images.orig.url").isNotNull(), F.struct(side(v, "$.images.orig.width").alias("w"), F.lit(0).alias("place"), address(v, "$.images.orig.url").alias("url"), side(v, "$.images.orig.height").alias("h")))
    free = ~F.coalesce(F.try_variant_get(v, "$.protected_delivery", "boolean"), F.lit(False))
    mp4 = address(v, "$.videos.video_list.V_720P.url")
    hls = F.coalesce(address(v, "$.videos.video_list.V_HLSV4.url"), address(v, "$.videos.video_list.V_HLSV3_MOBILE.url"))
    found = rows.select("payload_id", "owner", "path", F.when(free, F.coalesce(mp4, hls)).alias("video"), mp4.isNotNull().alias("progressive"), F.coalesce(orig, widest).alias("image"))
    found = stored(found.where("video is not null or image is not null"), "pins")
    first = found.where("video is not null").groupBy("payload_id", "video").agg(F.min("path").alias("first"))
    both = found.join(first, ["payload_id", "video"], "left").withColumn("plays", F.coalesce(F.col("path") == F.col("first"), F.lit(False)))
    url = F.col("image.url")
    ext = F.lower(F.nullif(F.regexp_extract(U.path(url), PIN_EXT, 1), F.lit("")))
    videos = both.where("plays").select("payload_id", "owner", "path", F.lit("video").alias("kind"), F.col("video").alias("url"), F.when(F.col("progressive"), "mp4").otherwise("m3u8").alias("ext"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), url.alias("poster"))
    images = both.where("not plays and image is not null").select("payload_id", "owner", "path", F.lit("image").alias("kind"), url.alias("url"), F.coalesce(ext, F.lit("jpg")).alias("ext"), F.col("image.w").cast("int").alias("width"), F.col("image.h").cast("int").alias("height"), F.lit(None).cast("string").alias("poster"))
    once = images.groupBy("payload_id", "url").agg(F.min_by(F.struct("owner", "path", "kind", "ext", "width", "height", "poster"), "path").alias("f")).select("payload_id", "f.owner", "f.path", "f.kind", "url", "f.ext", "f.width", "f.height", "f.poster")
    return videos.unionByName(once).select(F.lit("pinterest").alias("platform"), F.col("owner").alias("owner_id"), "kind", "url", "ext", "width", "height", "poster", F.lit(None).cast("boolean").alias("pending"), F.col("path").alias("ord"), "payload_id")


def _mangadex(payloads: DataFrame) -> DataFrame:
    """The pages of a chapter: full files, or the small ones where there are none."""
    schema = "struct<baseUrl:string,chapter:struct<hash:string,data:array<string>,dataSaver:array<string>>>"
    rows = payloads.where("platform = 'mangadex'").select("payload_id", F.lower(F.regexp_extract("request_url", r"/at-home/server/" + CHAPTER, 1)).alias("owner"), F.from_json("body", schema).alias("j")).where("owner <> ''")
    base = F.regexp_replace("j.baseUrl", "/+$", "")
    host = U.host(base)
    good = base.rlike("(?i)^https://") & ((host == "uploads.mangadex.org") | host.rlike(r"(?:^|\.)mangadex\.network$")) & F.col("j.chapter.hash").rlike("(?i)^[0-9a-f]{16,64}$")
    few = F.coalesce(F.size("j.chapter.data"), F.lit(0)) <= 0
    files = F.when(few, F.col("j.chapter.dataSaver")).otherwise(F.col("j.chapter.data"))
    each = rows.where(good).select("payload_id", "owner", base.alias("base"), F.when(few, "data-saver").otherwise("data").alias("dir"), F.col("j.chapter.hash").alias("hash"), F.posexplode(files).alias("n", "file")).where(F.col("file").rlike(r"(?i)^[\w-]+\.(?:png|jpe?g|gif)$"))
    ext = F.lower(F.substring_index("file", ".", -1))
    return each.select(F.lit("mangadex").alias("platform"), F.col("owner").alias("owner_id"), F.lit("image").alias("kind"), F.concat_ws("/", "base", "dir", "hash", "file").alias("url"), ext.alias("ext"), *[F.lit(None).cast("int").alias(c) for c in ("width", "height")], F.lit(None).cast("string").alias("poster"), F.lit(None).cast("boolean").alias("pending"), F.lpad(F.col("n").cast("string"), 6, "0").alias("ord"), "payload_id")


def captured_media(payloads: DataFrame) -> DataFrame:
    """payloads (payload_id, platform, request_url, body) -> FACTS: the media of captured bodies, by their owners.

    payload_id is the order in which bodies were captured. Null, empty and broken bodies, other platforms, media without
    an owner and files off a platform's hosts give none.
    """
    rows = payloads.select(F.col("payload_id").cast("bigint").alias("payload_id"), "platform", "request_url", "body").where("body is not null")
    nodes = walked(rows.where(F.col("platform").isin(*GATES)))
    names = [c.split()[0] for c in FACTS.split(", ")]
    out = _facebook(nodes).select(*names).unionByName(_pinterest(nodes).select(*names)).unionByName(_mangadex(rows).select(*names))
    return stored(out, "captured")


def owner_of(url: Column) -> Column:
    """struct<platform, owner_id>: the item that a page's address is of, or null."""
    host = U.host(url)
    found = []
    for platform, pattern, places in PAGES:
        ids = F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in places])
        ids = F.lower(ids) if platform == "mangadex" else ids
        found.append(F.when(host.rlike(pattern) & ids.isNotNull(), F.struct(F.lit(platform).alias("platform"), ids.alias("owner_id"))))
    return F.coalesce(*found)


def by_item(captured: DataFrame) -> DataFrame:
    """captured (FACTS) -> one row for each medium of an item, with idx and media_key.

    facebook: no image that is a video's poster, of the other images the largest, the latest of as large ones; videos
    come first, and a video that was found takes the place of pending ones. pinterest and mangadex: every address once,
    in the order of capture, of a chapter in the order of its pages.
    """
    item = ["platform", "owner_id"]
    at = F.struct("payload_id", "ord")
    once = captured.groupBy(*item, "url").agg(F.min_by(F.struct("kind", "ext", "width", "height", "poster", "pending", at.alias("at")), at).alias("f"), F.max(at).alias("late"), F.max(F.coalesce(F.col("width").cast("bigint") * F.col("height"), F.lit(0))).alias("area")).select(*item, "url", "f.*", "late", "area")
    fb = F.col("platform") == "facebook"
    posters = once.where(fb & (F.col("kind") == "video") & F.col("poster").isNotNull()).select(*item, F.col("poster").alias("url")).distinct()
    left = once.join(posters, [*item, "url"], "left_anti").unionByName(once.where("kind = 'video'").join(posters, [*item, "url"], "left_semi").select(*once.columns))
    video = F.col("kind") == "video"
    real = left.where(fb & video & ~F.coalesce("pending", F.lit(False))).select(*item).distinct().withColumn("real", F.lit(True))
    left = left.join(real, item, "left").where(~(fb & video & F.coalesce("pending", F.lit(False)) & F.coalesce("real", F.lit(False)))).drop("real")
    top = left.where(fb & ~video).groupBy(*item).agg(F.max_by("url", F.struct("area", "late")).alias("top"))
    left = left.join(top, item, "left").where(~fb | video | (F.col("url") == F.col("top"))).drop("top")
    chapter = F.when(F.col("platform") == "mangadex", F.struct(F.col("at.ord").alias("o"), F.col("at.payload_id").alias("p")))
    order = W.partitionBy(*item).orderBy(F.when(fb & ~video, 1).otherwise(0), chapter, "at")
    out = left.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
    several = F.count(F.lit(1)).over(W.partitionBy(*item)) > 1
    key = F.when(fb, F.concat(F.lit("fb:"), "owner_id", F.when(several, F.concat(F.lit("#"), F.col("idx").cast("string"))).otherwise("")))
    return out.select(*item, "idx", "kind", F.col("url").alias("src"), "ext", "width", "height", "poster", "pending", key.alias("media_key"))


def page_facts(pages: DataFrame, captured: DataFrame) -> DataFrame:
    """pages (page_key, url) joined by the item that their addresses are of to what was captured of it."""
    owned = pages.withColumn("_o", owner_of(F.col("url"))).where("_o is not null").select("page_key", "_o.platform", "_o.owner_id")
    return owned.join(by_item(captured), ["platform", "owner_id"])
