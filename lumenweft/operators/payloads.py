"""Captured JSON and page text to media facts: bounded deep walks, fixed-path readers, argmax over variants.

payloads: (platform, hint_id, body). A walk descends the whole value with what it inherits from above (an owner's id) and
tests every object for a shape; it is bounded by MAX_STEPS. Readers take fixed paths and are built-in expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweft.functions import url as U

MAX_STEPS = 400_000
SNIFFED = "source string, owner_id string, media_key string, kind string, url string, ext string, poster string, width int, height int, pending boolean"
FIELDS = [c.split()[0] for c in SNIFFED.split(", ")]

# The hosts that each platform's media may come from.
PINS = {
    "instagram": ("cdninstagram.com", "fbcdn.net"), "x": ("twimg.com",), "coub": ("coub.com", "akamaized.net"), "tenor": ("tenor.com",), "pexels": ("pexels.com",),
    "tiktok": ("tiktokcdn.com", "tiktokcdn-us.com", "tiktok.com", "tiktokv.com"), "shopify": ("cdn.shopify.com", "shopifycdn.com"), "fanbox": ("fanbox.cc", "pximg.net"),
}


def pin(platform: str, address) -> str | None:
    """The address if it is https on one of the platform's hosts."""
    m = re.match(r"https://([^/?#:@]+)", address) if isinstance(address, str) else None
    h = m[1].lower() if m else ""
    return address if any(h == p or h.endswith("." + p) for p in PINS[platform]) else None


def _largest(platform: str, sized) -> tuple[str, int, int] | None:
    """The widest pinned entry of a list of {url, width, height}, the first of equal ones."""
    known = [(int(c.get("width") or 0), c) for c in sized if isinstance(c, dict) and pin(platform, c.get("url"))] if isinstance(sized, list) else []
    if not known:
        return None
    width, best = max(known, key=lambda x: x[0])
    return best["url"], width, int(best.get("height") or 0)


def _carousel(node: dict, owner: str | None):
    """A leaf of a post: its video, else its image; a video without a usable file is pending with its cover."""
    if "media_type" not in node or isinstance(node.get("carousel_media"), list) or not owner:
        return None
    pk, plain = node.get("pk"), node.get("id")
    key = str(pk) if isinstance(pk, int) or isinstance(pk, str) and pk.isdigit() else plain if isinstance(plain, str) and re.fullmatch(r"\d+(?:_\d+)?", plain) else None
    cover = _largest("instagram", (node.get("image_versions2") or {}).get("candidates"))
    video = _largest("instagram", node.get("video_versions"))
    if video:
        return ("instagram", owner, key, "video", video[0], "mp4", cover and cover[0], video[1], video[2], None)
    if cover and str(node.get("media_type")) == "2":
        return ("instagram", owner, key, "video", cover[0], "mp4", cover[0], cover[1], cover[2], True)
    if cover:
        ext = re.search(r"\.([a-z0-9]+)(?:[?#]|$)", cover[0])
        return ("instagram", owner, key, "image", cover[0], ext[1] if ext else "jpg", None, cover[1], cover[2], None)
    return None


def _video_info(node: dict, owner: str | None):
    """A video's best mp4 by bit rate, else its first stream."""
    variants = (node.get("video_info") or {}).get("variants") if isinstance(node.get("video_info"), dict) else None
    if not isinstance(variants, list):
        return None
    poster = node.get("media_url_https")
    found = re.search(r"/(?:ext_tw_video_thumb|amplify_video_thumb|tweet_video_thumb)/(\w+)", poster) if isinstance(poster, str) else None
    media = next((v for v in (node.get("id_str"), node.get("media_id_str")) if isinstance(v, str) and v), found and found[1])
    usable = [v for v in variants if isinstance(v, dict) and pin("x", v.get("url"))]
    mp4 = max((v for v in usable if v.get("content_type") == "video/mp4"), key=lambda v: v.get("bitrate") or 0, default=None)
    hls = next((v for v in usable if v.get("content_type") == "application/x-mpegURL"), None)
    best = mp4 or hls
    return ("x", media, media, "video", best["url"], "mp4" if mp4 else "m3u8", poster, None, None, None) if media and best else None


#: platform: (the key whose value is inherited, the shape's test, a text without which no body needs parsing, distinct by)
SHAPES = {"instagram": ("code", _carousel, "media_type", 4), "x": ("", _video_info, "video_info", 1)}


def walk(platform: str, body: str | None) -> list[tuple]:
    """The media of a body: JSON, or lines of JSON, behind a prefix against inclusion. What is no JSON has none."""
    inherits, test, gate, distinct = SHAPES[platform]
    if not body or gate not in body:
        return []
    texts = [re.sub(r"^(?:for\s*\(;;\);|\)\]\}'[^\n]*\n?)", "", body.strip())]
    try:
        roots = [json.loads(texts[0])]
    except ValueError:
        roots = []
        for line in texts[0].splitlines():
            try:
                roots.append(json.loads(line))
            except ValueError:
                continue
    out, seen, steps = [], set(), 0
    stack = [(r, None) for r in reversed(roots)]
    while stack and steps < MAX_STEPS:
        node, owner = stack.pop()
        steps += 1
        if isinstance(node, list):
            stack.extend((v, owner) for v in reversed(node) if isinstance(v, dict | list))
        elif isinstance(node, dict):
            if inherits and isinstance(node.get(inherits), str):
                owner = node[inherits]
            row = test(node, owner)
            if row and row[distinct] not in seen:
                seen.add(row[distinct])
                out.append(row)
            stack.extend((v, owner) for v in reversed(list(node.values())) if isinstance(v, dict | list))
    return out


def sniffed(payloads: DataFrame) -> DataFrame:
    """The media facts of captured bodies of platforms with a shape. A cheap test of the text comes before any parsing."""
    gates = F.lit(False)
    for platform, (_, _, gate, _) in SHAPES.items():
        gates = gates | ((F.col("platform") == platform) & F.contains("body", F.lit(gate)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, b in zip(f["platform"], f["body"], strict=True) for r in walk(p, b)]
            out = pd.DataFrame(rows, columns=FIELDS)
            for c in ("width", "height"):
                out[c] = out[c].astype("Int32")
            yield out

    return payloads.where(gates).select("platform", "body").mapInPandas(run, SNIFFED)


# ---- fixed paths ------------------------------------------------------------------------------------------------
def _pinned(platform: str, x: Column) -> Column:
    return U.pinned(x, *PINS[platform])


def _at(path: str) -> Column:
    return F.get_json_object("body", path)


def readers(payloads: DataFrame) -> DataFrame:
    """(platform, hint_id, ord, kind, url, media_key, poster) of single-asset platforms; anything malformed gives none."""
    one = payloads.where(F.col("platform").isin("coub", "tenor", "pexels"))
    key = F.concat_ws(" ", "platform", F.when(F.col("platform") == "coub", F.nullif(F.regexp_extract(_at("$.permalink"), r"^([A-Za-z0-9]+)$", 1), F.lit(""))).when(F.col("platform") == "pexels", _at("$.props.pageProps.medium.id")).otherwise(F.col("hint_id")))
    tenor = []
    for f, kind in (("gif", "gif"), ("mp4", "video"), ("webm", "video")):
        for where in (".media_formats.", ".results[0].media_formats."):
            value = _pinned("tenor", F.expr(f"get_json_object(body, concat('$.gifs.byId.', hint_id, '{where}{f}.url'))"))
            tenor.append(F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("url"), F.lit(None).cast("string").alias("poster"))))
    picked = lambda p, kind, x, poster=None: F.when(_pinned(p, x).isNotNull(), F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), _pinned(p, x).alias("url"), (F.lit(None).cast("string") if poster is None else poster).alias("poster")))
    pexels = F.coalesce(picked("pexels", "video", _at("$.props.pageProps.medium.video.download_link")), picked("pexels", F.when(U.image_extension(_at("$.props.pageProps.medium.image.download_link")) == "gif", "gif").otherwise("image"), _at("$.props.pageProps.medium.image.download_link")))
    coub = picked("coub", "video", _at("$.file_versions.share.default"), _pinned("coub", _at("$.picture")))
    best = F.when(F.col("platform") == "coub", coub).when(F.col("platform") == "pexels", pexels).when(F.col("hint_id").rlike(r"^\d+$"), F.coalesce(*tenor))
    return one.withColumn("_b", best).where("_b is not null").select("platform", "hint_id", F.lit(0).alias("ord"), "_b.kind", "_b.url", key.alias("media_key"), "_b.poster")


TIKTOK = "struct<id:string,imagePost:struct<images:array<struct<imageURL:struct<urlList:array<string>>>>>,video:struct<playAddr:string,cover:string,bitrateInfo:array<struct<Bitrate:bigint,PlayAddr:struct<UrlList:array<string>>>>>>"
SHOPIFY = "struct<media:array<struct<id:string,media_type:string,src:string,width:int,height:int,preview_image:struct<src:string,width:int,height:int>,sources:array<struct<url:string,format:string,mime_type:string,width:int,height:int>>>>>"


def tiktok(payloads: DataFrame) -> DataFrame:
    """A photo post's slides, each once, else the rendition of the highest bit rate, else the default one."""
    item = F.from_json(F.get_json_object("body", "$.__DEFAULT_SCOPE__['webapp.video-detail'].itemInfo.itemStruct"), TIKTOK)
    rows = payloads.where("platform = 'tiktok'").withColumn("_i", item).where("_i is not null")
    first = lambda xs: _pinned("tiktok", F.get(xs, F.lit(0)))
    slides = F.transform(F.col("_i.imagePost.images"), lambda s, k: F.struct(k.alias("ord"), first(s["imageURL"]["urlList"]).alias("url")))
    rated = F.transform(F.col("_i.video.bitrateInfo"), lambda b, k: F.struct(F.coalesce(b["Bitrate"], F.lit(0)).alias("rate"), (-k).alias("place"), first(b["PlayAddr"]["UrlList"]).alias("url")))
    best = F.array_max(F.filter(rated, lambda x: x["url"].isNotNull()))["url"]
    post = F.size(F.coalesce(F.col("_i.imagePost.images"), F.array().cast("array<struct<imageURL:struct<urlList:array<string>>>>"))) > 0
    key = F.nullif(F.regexp_extract("_i.id", r"^(\d+)$", 1), F.lit(""))
    images = rows.where(post).select("hint_id", key.alias("k"), F.explode(slides).alias("s")).where("s.url is not null")
    images = images.groupBy("hint_id", "k", "s.url").agg(F.min("s.ord").alias("ord")).select("hint_id", "ord", F.lit("image").alias("kind"), "url", F.concat_ws(" ", F.lit("tiktok"), "k", F.col("ord").cast("string")).alias("media_key"), F.lit(None).cast("string").alias("poster"))
    video = rows.where(~post).select("hint_id", F.lit(0).alias("ord"), F.lit("video").alias("kind"), F.coalesce(best, _pinned("tiktok", F.col("_i.video.playAddr"))).alias("url"), F.concat_ws(" ", F.lit("tiktok"), key).alias("media_key"), _pinned("tiktok", F.col("_i.video.cover")).alias("poster"))
    return images.unionByName(video.where("url is not null"))


def shopify(payloads: DataFrame) -> DataFrame:
    """A product's images by their own address, its videos by the tallest mp4, else a stream; other media are left out."""
    each = payloads.where("platform = 'shopify'").withColumn("_p", F.from_json("body", SHOPIFY)).select("hint_id", F.posexplode("_p.media").alias("ord", "m"))
    mp4 = lambda s: (F.coalesce(s["format"], F.lit("")) == "mp4") | F.coalesce(s["mime_type"], F.lit("")).rlike(r"(?i)video/mp4") | s["url"].rlike(r"(?i)\.mp4(?:$|[?#])")
    hls = lambda s: (F.coalesce(s["format"], F.lit("")) == "m3u8") | F.coalesce(s["mime_type"], F.lit("")).rlike(r"(?i)mpegurl") | s["url"].rlike(r"(?i)\.m3u8(?:$|[?#])")
    usable = F.filter(F.col("m.sources"), lambda s: _pinned("shopify", s["url"]).isNotNull())
    rated = F.transform(usable, lambda s, k: F.struct(F.coalesce(s["height"], F.lit(0)).alias("h"), (-k).alias("place"), s["url"].alias("url"), mp4(s).alias("mp4"), hls(s).alias("hls")))
    best = F.array_max(F.filter(rated, lambda s: s["mp4"]))["url"]
    stream = F.get(F.filter(rated, lambda s: s["hls"] & ~s["mp4"]), F.lit(0))["url"]
    kind = F.when((F.col("m.media_type") == "image") | (F.coalesce("m.media_type", F.lit("")).eqNullSafe("") & F.col("m.src").isNotNull()), "image").when(F.col("m.media_type") == "video", "video")
    url = F.when(kind == "image", _pinned("shopify", F.coalesce("m.src", "m.preview_image.src"))).when(kind == "video", F.coalesce(best, stream))
    key = F.when(F.col("m.id").isNotNull(), F.concat(F.lit("shopify:"), "m.id"))
    return each.select("hint_id", "ord", kind.alias("kind"), url.alias("url"), key.alias("media_key"), F.when(kind == "video", _pinned("shopify", F.col("m.preview_image.src"))).alias("poster")).where("url is not null")


def fanbox(pages: DataFrame) -> DataFrame:
    """pages (page_id, post_id, html) -> a post's originals, each once, in order."""
    pattern = F.concat(F.lit(r"https://downloads\.fanbox\.cc/images/post/"), "post_id", F.lit(r"/[A-Za-z0-9_-]+\.[a-z0-9]+"))
    found = F.array_distinct(F.regexp_extract_all("html", pattern, F.lit(0)))
    return pages.where(F.col("post_id").rlike(r"^\d+$")).select("page_id", F.posexplode(found).alias("ord", "url")).withColumn("media_key", F.concat(F.lit("fanbox "), F.regexp_extract("url", r"/([A-Za-z0-9_-]+)\.[a-z0-9]+$", 1)))


def prefer_found(facts: DataFrame) -> DataFrame:
    """facts without pending ones whose owner and key are also found resolved."""
    from pyspark.sql import Window as W

    w = W.partitionBy("owner_id", "media_key")
    found = F.max((~F.coalesce(F.col("pending"), F.lit(False))).cast("int")).over(w)
    return facts.withColumn("_f", found).where((F.col("_f") == 0) | F.col("media_key").isNull() | ~F.coalesce(F.col("pending"), F.lit(False))).drop("_f")
