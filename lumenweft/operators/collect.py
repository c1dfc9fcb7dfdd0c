"""The scan of stored pages: every pass over a page's elements, united into media rows, each once a page.

The passes run in a fixed order (images, sources of pictures, backgrounds, video, audio, links, noscript, frames, page
metadata, preloads, the page's own address, the readers of its site, what was captured of its item), each in the order
of the page, and the first row of an identity stays.

A page's html is tokenised in one map and never shuffled. Every element then names what it holds in one array, which is
exploded, so all passes are one stream of rows, and addresses are resolved and tested for embedded items once. What an
element takes from those around or inside of it comes from one join of intervals. Only media rows are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as SF

from lumenweft.functions import url as U
from lumenweft.functions.text import F, as_text, column, interpreted
from lumenweft.functions.url import absolute
from lumenweft.operators import extract as X
from lumenweft.operators import graph as G
from lumenweft.operators import media as M
from lumenweft.operators import offers as O
from lumenweft.operators import originals as E
from lumenweft.operators import resolve as R
from lumenweft.operators import sheets as H
from lumenweft.operators import tree as T
from lumenweft.operators import variants as V
from lumenweft.sources.shared import stored

# Site -> address of an embedded item, type, platform, and its id there (None: the address).
EMBED_PAGES = {
    "vimeo": ("https://vimeo.com/{}", "mp4", "vimeo", "{}"), "dailymotion": ("https://www.dailymotion.com/video/{}", "mp4", "dailymotion", "{}"), "rutube": ("https://rutube.ru/video/{}/", "mp4", "rutube", "{}"),
    "rumble": ("https://rumble.com/{}", "mp4", "rumble", None), "loom": ("https://www.loom.com/share/{}", "mp4", "loom", "{}"), "streamable": ("https://streamable.com/{}", "mp4", "streamable", "{}"),
    "redgifs": ("https://www.redgifs.com/watch/{}", "mp4", "redgifs", "{}"), "twitch-clip": ("https://clips.twitch.tv/{}", "mp4", "twitch", "{}"), "twitch-vod": ("https://www.twitch.tv/videos/{}", "m3u8", "twitch", "vod {}"),
    "kick-clip": ("https://kick.com/clips/{}", "mp4", "kick", "{}"), "kick-vod": ("https://kick.com/video/{}", "m3u8", "kick", "video {}"), "soundcloud": ("https://soundcloud.com/{}", "m3u8", "soundcloud", None),
    "9gag": ("https://9gag.com/gag/{}", "mp4", "9gag", "{}"),
}
#: Sites whose items are taken from frames, and from the page's own address.
FRAME_SITES = ("vimeo", "dailymotion", "rutube", "rumble", "peertube", "loom", "streamable", "redgifs", "twitch-clip", "twitch-vod")
PAGE_SITES = ("rutube", "rumble", "peertube", "loom", "twitch-vod", "kick-clip", "kick-vod", "soundcloud")
STATUS_CELL = r"^/[^/]+/status/(\d{1,20})/(photo|video)/(\d{1,3})$"
PAINTED = r"pbs\.twimg\.com/(?:media|amplify_video_thumb|ext_tw_video_thumb|tweet_video_thumb)/"
ITEM = ["page_id", "seq", "src", "alt", "width", "height", "type", "kind", "file_size", "is_base64", "poster", "thumbnail", "hls_manifest", "unresolved_video", "unresolved_image", "platform", "hint", "media_key"]
HTTP = r"(?i)^https?://"
NAMED = "array<struct<pass:int,b:int,raw:string,mime:string>>"
HEROES = ("og:image", "og:image:url", "og:image:secure_url", "twitter:image", "twitter:image:src")
VIDEOS = ("og:video", "og:video:url", "og:video:secure_url")
#: What the scan keeps of a media row before originals are looked for.
COLUMNS = {
    "page_key": "bigint", "page_id": "bigint", "url": "string", "pass": "int", "a": "int", "b": "int", "src": "string", "alt": "string", "width": "int", "height": "int", "kind": "string", "type": "string", "poster": "string",
    "thumbnail": "string", "hls_manifest": "string", "pending": "boolean", "platform": "string", "hint": "string", "media_key": "string", "image": "boolean", "listed": "array<string>",
}


def _text(build) -> Column:
    """What build() gives, written out as SQL."""
    with as_text():
        out = build()
    return interpreted(out)


def _around(elems: DataFrame) -> DataFrame:
    """page_key, a, img, painted, moves, sources: what a link, an article, a video or an audio element has inside."""
    inner = elems.where(F.col("tag").isin("img", "video") | ((F.col("tag") == "source") & X.attr("src").isNotNull()))
    inner = T.places(inner, F.col("tag").alias("inner"), X.attr("src").alias("s"), X.attr("alt").alias("t"), X.attr("poster").alias("p"), F.greatest(X.size_of("width"), X.size_of("height")).alias("n"), X.attr("type").alias("mime"))
    both = T.enclosed(inner, T.intervals(elems.where(F.col("tag").isin("a", "article", "video", "audio")))).where("at > first")
    of = lambda tag, x: F.when(F.col("inner") == tag, x)
    return both.groupBy("page_key", F.col("first").alias("a")).agg(
        F.min_by(F.struct("s", "t", "n"), of("img", F.col("at"))).alias("img"),
        F.max(F.coalesce(of("img", F.col("s")), of("video", F.col("p")), F.lit("")).rlike(PAINTED)).alias("painted"),
        F.max(F.col("inner") == "video").alias("moves"),
        F.array_sort(F.collect_list(of("source", F.struct((F.col("at") + 10).alias("b"), F.col("s").alias("raw"), "mime")))).alias("sources"),
    )


def _named() -> Column:
    """What a row of elements, with what is inside of it, names: pass, place, address and MIME type."""
    name = F.lower(F.coalesce(X.attr("property"), X.attr("name"), F.lit("")))
    tag, none = F.col("tag"), F.array().cast(NAMED)
    listed = lambda number, found: F.transform(found, lambda x, k: F.struct(F.lit(number).alias("pass"), k.alias("b"), x.alias("raw"), F.lit(None).cast("string").alias("mime"))).cast(NAMED)
    one = lambda number, x: listed(number, F.array_compact(F.array(x)))
    av = F.when(tag == "video", 4).otherwise(5)
    below = F.transform(F.coalesce(F.col("sources"), F.array().cast("array<struct<b:int,raw:string,mime:string>>")), lambda x: F.struct(av.alias("pass"), x["b"].alias("b"), x["raw"].alias("raw"), x["mime"].alias("mime"))).cast(NAMED)
    own = F.transform(F.array_compact(F.array(X.attr("src"), X.attr("data-src"))), lambda x, k: F.struct(av.alias("pass"), k.alias("b"), x.alias("raw"), F.lit(None).cast("string").alias("mime"))).cast(NAMED)
    by_tag = (
        F.when(tag == "img", listed(1, X.image_found())).when(X.is_image(), listed(2, X.image_found())).when(tag.isin("video", "audio"), F.concat(own, below)).when(tag == "a", one(6, X.attr("href")))
        .when(tag == "noscript", listed(7, F.col("found"))).when(tag == "iframe", one(8, F.coalesce(X.attr("src"), X.attr("data-src")))).when((tag == "meta") & name.isin(*HEROES), one(9, X.attr("content")))
        .when((tag == "meta") & name.isin(*VIDEOS), one(10, X.attr("content"))).when(X.is_preload(), listed(11, X.preload_found())).when(tag == X.PAGE, one(12, F.col("url")))
    )
    return F.concat(F.when(tag == "noscript", none).otherwise(listed(3, F.col("found"))), F.coalesce(by_tag, none))


def _page_facts(elems: DataFrame) -> DataFrame:
    """page_key, video_type, hero: what a page's metadata say of its video."""
    name = F.lower(F.coalesce(X.attr("property"), X.attr("name"), F.lit("")))
    meta = elems.where((F.col("tag") == "meta") & X.attr("content").isNotNull() & name.isin("og:video:type", "og:image", "og:image:secure_url"))
    first = lambda on: F.min_by(X.attr("content"), F.when(on, F.col("elem_ordinal")))
    return meta.groupBy("page_key").agg(first(name == "og:video:type").alias("video_type"), first(name != "og:video:type").alias("hero"))


def _embedded(e: Column, target: Column) -> dict[str, Column]:
    """What an embedded item (struct<site, id>) becomes: address, type, platform and hint."""
    table = F.create_map(*[x for site, values in EMBED_PAGES.items() for x in (F.lit(site), F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("form", "type", "platform", "hint"), values, strict=True)]))])
    rule, filled = F.try_element_at(table, e["site"]), lambda x: F.replace(x, F.lit("{}"), e["id"])
    address = F.when(e["site"] == "peertube", F.concat(U.origin(target), F.lit("/videos/embed/"), e["id"])).otherwise(filled(rule["form"]))
    return {"src": address, "type": F.coalesce(rule["type"], F.lit("mp4")), "platform": F.coalesce(rule["platform"], e["site"]), "hint": F.coalesce(filled(rule["hint"]), address)}


def _element_rows(elems: DataFrame, resolve_originals: bool) -> DataFrame:
    """The rows of all passes over elements, as COLUMNS."""
    tags = ("img", "source", "video", "audio", "a", "noscript", "iframe", "meta", "link", X.PAGE)
    around = stored(_around(elems), "around")
    if not elems.where(F.size("keys") > 0).isEmpty():  # sheets decide, not attributes alone
        elems = H.styled(elems)
    holders = elems.where(F.col("tag").isin(*tags) | (F.size("found") > 0))
    rows = holders.withColumnRenamed("elem_ordinal", "a").join(around, ["page_key", "a"], "left").join(_page_facts(elems), "page_key", "left").withColumn("_named", _text(_named)).where(F.size("_named") > 0)
    hero = F.when(F.col("tag") == "meta", F.col("hero"))
    rows = rows.select(
        "page_key", "page_id", "url", "a", "tag", "subtree_end", F.coalesce(X.attr("alt"), F.lit("")).alias("alt"), F.coalesce(X.attr("aria-label"), X.attr("title"), F.lit("")).alias("label"), X.size_of("width").alias("w"), X.size_of("height").alias("h"),
        X.attr("src").alias("own"), X.poster_of().alias("poster"), hero.alias("hero"), F.when(F.col("tag") == "meta", F.col("video_type")).alias("video_type"), "img", F.coalesce("painted", F.lit(False)).alias("painted"),
        F.when(F.col("tag") == "img", F.get("listed", F.lit(0))).alias("listed"), F.explode("_named").alias("named"),
    ).select("*", "named.*").drop("named")
    rows = rows.withColumn("target", F.when(F.col("raw").startswith("data:"), F.col("raw")).otherwise(absolute(F.col("raw"), F.col("url")))).where("target is not null")
    # every step of the scan is a plan of its own: the rows are few and narrow, and no plan grows with the number of passes
    rows = stored(rows, "named")
    with as_text():
        facts, how = _tested(resolve_originals)
    rows = rows.withColumns({k: interpreted(v) for k, v in facts.items()})
    rows = rows.withColumn("_h", SF.explode(column(how))).select("*", "_h.k", "_h.how").drop("_h")
    rows = stored(rows, "tested")
    # a post of 9gag counts only where its article shows a video
    post = (F.col("how") == "embed") & (F.col("pass") == 6) & (F.col("e.site") == "9gag")
    gag = rows.where(post).select("page_key", F.col("a").alias("at"))
    if not gag.isEmpty():
        shown = around.where("moves").select("page_key", F.col("a").alias("elem_ordinal")).join(elems.where("tag = 'article'").select("page_key", "elem_ordinal", "subtree_end"), ["page_key", "elem_ordinal"])
        gag = T.enclosed(gag, T.intervals(shown)).select("page_key", F.col("at").alias("a"), F.lit(True).alias("gag")).distinct()
        rows = rows.join(gag, ["page_key", "a"], "left").where(~F.coalesce(post, F.lit(False)) | F.col("gag"))
    return _described(rows, resolve_originals)


def _tested(resolve_originals: bool) -> tuple[dict, Column]:
    """What is known of a row's target, and what the row therefore is: an image, a file, an embedded item, a status, a gallery page."""
    t, number = F.col("target"), F.col("pass")
    link = number == 6
    av = F.when(t.rlike(r"(?i)\.(?:mp4|m4v|webm|ogv|mov)(?:$|[?#])"), "video").when(t.rlike(r"(?i)\.(?:mp3|wav|ogg|oga|m4a|aac|flac|opus)(?:$|[?#])"), "audio")
    # most pages are told from those of the site without their address being taken apart
    on_x = F.when(link & F.col("url").rlike(r"(?i)(?:x|twitter)\.com"), F.coalesce(U.host(F.col("url")).rlike(r"(?:^|\.)(?:x|twitter)\.com$"), F.lit(False))).otherwise(False)
    facts = {
        "e": F.when(number.isin(6, 8, 12), R.embed(t)), "hls": U.is_hls(t), "dash": U.is_dash(t), "file": F.when(link, F.coalesce(U.looks_like_media(t), F.lit(False))).otherwise(False),
        "av": F.when(link, av).when(number == 5, "audio").when(number.isin(4, 10), "video"), "thumb": F.when(link, absolute(F.col("img.s"), F.col("url"))), "on_x": on_x,
        "cell": F.when(on_x, F.array(*[F.regexp_extract(U.path(t), STATUS_CELL, g) for g in (1, 2, 3)])),
    }
    site, stream = F.coalesce(F.col("e.site"), F.lit("")), F.col("hls") | F.col("dash")
    youtube, fetched = site == "youtube", t.rlike(HTTP)
    good = fetched & (stream | ~U.undownloadable(t))
    other = link & ~youtube & ~(stream & fetched)
    every = (*EMBED_PAGES, "peertube")
    plain = other & (site == "")
    gallery = plain & ~F.col("on_x") & ~F.col("file") & F.col("img.s").isNotNull() if resolve_originals else F.lit(False)
    one = lambda on, k, how: F.when(on, F.struct(F.lit(k).alias("k"), F.lit(how).alias("how")))
    how = F.array_compact(F.array(
        one(number.isin(1, 2, 3, 7, 9, 11) | (link & F.col("file") & F.col("av").isNull()), 0, "image"),
        one((number.isin(4, 5, 10) | (link & F.col("file") & F.col("av").isNotNull())) & good, 0, "file"),
        one(youtube & number.isin(6, 8), 1, "image"),
        one(link & ~youtube & stream & fetched, 1, "file"),
        one((other & site.isin(*every)) | ((number == 8) & site.isin(*FRAME_SITES)) | ((number == 12) & site.isin(*PAGE_SITES)), 1, "embed"),
        one(plain & F.col("on_x") & (F.col("cell")[0] != "") & ~F.col("painted"), 2, "status"),
        one(gallery, 2, "gallery"),
    ))
    return facts, how


def _described(rows: DataFrame, resolve_originals: bool) -> DataFrame:
    """Rows that are known to be an image, a file, an embedded item, a status or a gallery page, as COLUMNS."""
    with as_text():
        t, how, link = F.col("target"), F.col("how"), F.col("pass") == 6
        is_ = lambda x: how == x
        e = _embedded(F.col("e"), t)
        cell = lambda i: F.col("cell")[i]
        photo = cell(1) == "photo"
        loaded = (F.col("pass") == 1) & (t == absolute(F.col("own"), F.col("url")))
        side = lambda c: F.when(is_("image") & loaded, F.col(c)).when(is_("image") & (F.col("pass") == 1), 0)
        mime = F.when(F.col("pass") == 10, F.col("video_type")).otherwise(F.col("mime"))
        stream = F.col("hls") | F.col("dash")
        cover = F.when(link & (F.col("av") == "video") & F.col("thumb").rlike(r"(?i)^(?:https?:|data:image/)"), F.col("thumb")).when(F.col("pass") == 4, F.col("poster")).when(F.col("pass") == 10, absolute(F.col("hero"), F.col("url")))
        hint = F.when(photo, F.concat(F.lit("photo "), cell(0), F.lit(" "), cell(2).cast("int").cast("string"))).otherwise(cell(0))
        values = {
            "b": F.col("k") * 1_000_000 + F.col("b"),
            "src": F.when(is_("embed"), e["src"]).otherwise(t),
            "alt": F.when(F.col("pass") == 1, F.col("alt")).when(F.col("pass").isin(4, 5), F.col("label")).when(is_("gallery"), F.col("img.t")).otherwise(""),
            "width": side("w"), "height": side("h"),
            "kind": F.when(is_("embed"), "video").when(is_("file"), F.when(stream, "video").otherwise(F.col("av"))).when(is_("status"), F.when(photo, "image").otherwise("video")).when(is_("gallery"), "image"),
            "type": F.when(is_("embed"), e["type"]).when(is_("file"), F.when(F.col("dash"), "mpd").when(F.col("hls"), "m3u8").otherwise(U.av_type(t, mime))).when(is_("status"), F.when(photo, "unknown").otherwise("mp4")).when(is_("gallery"), "unknown"),
            "poster": F.when(is_("file"), cover), "thumbnail": F.when(link & how.isin("image", "gallery") & (F.col("k") != 1), F.col("thumb")), "hls_manifest": F.when(is_("file") & stream, t),
            "pending": F.when(how.isin("embed", "status", "gallery"), True), "platform": F.when(is_("embed"), e["platform"]).when(is_("status"), "twitter").when(is_("gallery"), "gallery-page"),
            "hint": F.when(is_("embed"), e["hint"]).when(is_("status"), hint).when(is_("gallery"), t), "media_key": F.when(is_("gallery"), U.canonical_key(F.col("thumb"))) if resolve_originals else F.lit(None), "image": F.when(is_("image"), True),
        }
        cols = [(values[n] if n in values else F.col(n)).cast(c).alias(n) for n, c in COLUMNS.items()]
        cols += [F.when(is_("status"), F.concat_ws("/", cell(0), cell(1), cell(2))).alias("status"), F.when(is_("gallery"), F.col("img.n")).alias("thumb_width")]
    out = rows.select(*map(interpreted, cols), "how")
    # one row for each cell of a status, and so many gallery pages as a scan takes
    first = W.partitionBy("page_key", "how", "status").orderBy("a")
    gate = F.coalesce((U.origin(F.col("src")) == U.origin(F.col("url"))) & ~U.path(F.col("src")).rlike(X.NON_CONTENT_PATH) & F.coalesce((F.col("thumb_width") == 0) | (F.col("thumb_width") >= X.GALLERY_MIN_THUMB), F.lit(True)), F.lit(False))
    special = out.where("how in ('status', 'gallery')").where((F.col("how") == "status") | gate).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= F.when(F.col("how") == "status", 1).otherwise(X.GALLERY_PAGE_CAP))
    return out.where("how not in ('status', 'gallery')").select(*COLUMNS).unionByName(special.select(*COLUMNS))


def _site_rows(elems: DataFrame, captured: DataFrame | None) -> DataFrame | None:
    """What the readers of sites find in the pages' markup, and what was captured of the items that the pages are of; as COLUMNS."""
    page = elems.where(F.col("tag") == X.PAGE).select("page_key", "page_id", "url", "text")
    none = F.lit(0)
    parts = []
    read = page.where("text <> ''")
    if not read.isEmpty():  # pages of sites that have a reader
        read = O.site_media(read.select(F.col("page_key").alias("page_id"), "url", F.col("text").alias("html"))).withColumnsRenamed({"page_id": "page_key", "url": "src"})
        parts.append(read.select("page_key", F.lit(13).alias("pass"), F.col("idx").alias("a"), "src", "kind", "ext", "media_key", "poster", none.alias("width"), none.alias("height"), F.lit(None).cast("boolean").alias("pending")))
    if captured is not None:
        facts = G.page_facts(page.select("page_key", "url"), captured)
        parts.append(facts.select("page_key", F.lit(14).alias("pass"), F.col("idx").alias("a"), "src", "kind", "ext", "media_key", "poster", "width", "height", "pending"))
    if not parts:
        return None
    found = reduce(DataFrame.unionByName, parts)
    rows = found.join(page.select("page_key", "page_id", "url"), "page_key")
    video = F.col("kind") == "video"
    values = {
        "b": F.lit(0), "alt": F.lit(""), "kind": F.when(video, "video").otherwise("image"), "type": F.when(video, F.col("ext")).when(F.col("ext") == "jpg", "jpeg").otherwise(F.col("ext")), "hls_manifest": F.when(video & (F.col("ext") == "m3u8"), F.col("src")),
        "thumbnail": F.lit(None), "platform": F.lit(None), "hint": F.lit(None), "image": F.lit(None), "listed": F.lit(None),
    }
    return rows.select(*[(values[n] if n in values else F.col(n)).cast(c).alias(n) for n, c in COLUMNS.items()])


def _with_originals(images: DataFrame, elems: DataFrame) -> DataFrame:
    """Image rows with what their addresses, their srcsets and their pages say of the originals; as COLUMNS and two more."""
    found = R.candidates(images.withColumnRenamed("thumbnail", "_shown").withColumnsRenamed({"pending": "_p", "hint": "_h", "kind": "_k", "type": "_t", "media_key": "_m", "platform": "_f"}), "src")
    named = E.element_originals(images.select("page_key", F.col("url").alias("page_url"), F.col("a").alias("at"), "src").where("pass not in (7, 8, 9, 11)"), elems)
    named = named.select("page_key", F.col("at").alias("a"), "src", F.struct(*[c.split()[0] for c in E.FOUND.split(", ")], "resolver").alias("own"))
    found = stored(found.join(named, ["page_key", "a", "src"], "left"), "candidates")
    wide = found.withColumn("page_url", F.col("url"))
    if wide.where(V.claims()).isEmpty():  # no image of a site whose srcsets say more than addresses
        wide = wide.withColumn("wide", F.lit(None).cast("struct<original:string,width:int,height:int,thumbnail:string,media_key:string>"))
    else:
        listed = V.widest_listed(wide.select(F.struct("*").alias("row"), "page_url", "src", "listed", F.col("width").alias("natural_width"), F.col("height").alias("natural_height")))
        w = lambda c: F.when(F.col("resolver").isNotNull(), F.col(c)).alias(c)
        wide = listed.select("row.*", F.struct(*map(w, ("original", "width", "height", "thumbnail", "media_key"))).alias("wide"))
    with as_text():
        own, by_srcset = F.col("own.original").isNotNull(), F.col("wide.original").isNotNull()
        pick = lambda name, else_: F.when(own, F.col(f"own.{name}")).when(by_srcset, F.col(f"wide.{name}") if name in ("original", "width", "height", "thumbnail", "media_key") else F.lit(None)).otherwise(else_)
        kind = pick("kind", F.col("kind"))
        chosen = {"_original": pick("original", F.col("original")), "_kind": F.when(by_srcset & ~own | (kind == "gif"), "image").otherwise(kind)}
        sizes = F.coalesce(U.dimensions(F.col("src")), U.dimensions(F.col("_original")))
    wide = wide.withColumns({k: interpreted(v) for k, v in chosen.items()}).withColumn("_sizes", interpreted(sizes))
    with as_text():
        original, kind = F.col("_original"), F.col("_kind")
        video = kind == "video"
        unknown = (F.coalesce(F.col("width"), F.lit(0)) == 0) & (F.coalesce(F.col("height"), F.lit(0)) == 0)
        side = lambda n: F.when(video, 0).otherwise(F.coalesce(pick(n, F.lit(None)), F.when(unknown, F.col(f"_sizes.{n}")).otherwise(F.col(n)), F.lit(0)))
        shown = F.coalesce(F.col("_shown"), pick("thumbnail", F.col("thumbnail")))
        done = {
            "src": original, "kind": kind, "width": side("width"), "height": side("height"), "thumbnail": F.when(~video & (shown != original), shown), "type": F.when(video, U.av_type(original)).otherwise(U.detect_type(original)),
            "pending": pick("pending", F.col("pending")), "hint": pick("hint", F.col("hint")), "media_key": pick("media_key", F.lit(None)), "poster": F.when(own & video & F.col("own.pending"), F.col("src")),
            "platform": F.when(own, F.col("own.platform")).when(~by_srcset & F.col("hint").isNotNull(), F.col("resolver")),
        }
        cols = [(done[n] if n in done else F.col(n)).cast(c).alias(n) for n, c in COLUMNS.items()]
    return wide.select(*map(interpreted, cols))


def media(pages: DataFrame, resolve_originals: bool = False, captured: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html) -> ITEM: the media rows of every page, in the order in which a scan finds them.

    resolve_originals: links to gallery pages are rows, too, and the thumbnails that they show are not. captured: facts of
    payloads.captured_media(), joined to the pages of their items. Every row of pages is a page of its own, rows that
    repeat a page_id too; seq numbers a page's rows. A page without media or with null html gives no rows; with a null
    address only what its markup names in full.
    """
    pages = pages.select("page_id", "url", "html").withColumn("page_key", F.monotonically_increasing_id())
    elems = stored(X.elements(pages, page_rows=O.reads(F.col("url"))), "elements")
    rows, read = _element_rows(elems, resolve_originals), _site_rows(elems, captured)
    rows = stored((rows if read is None else rows.unionByName(read)).where("src is not null"), "media")
    images = rows.where("image")
    data = F.col("src").startswith("data:image/")
    info = U.base64_info(F.col("src"))
    inline = images.where(data).withColumns({"kind": F.lit("image"), "type": info["type"], "file_size": info["bytes"], "is_base64": F.lit(True)})
    found = _with_originals(images.where(~data & F.col("src").rlike(HTTP)), elems)
    plain = [df.withColumns({"file_size": F.lit(0).cast("bigint"), "is_base64": F.lit(False)}) for df in (rows.where("image is null"), found)]
    every = reduce(DataFrame.unionByName, [inline, *plain])
    size = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    wait = F.coalesce("pending", F.lit(False))
    in_order = W.partitionBy("page_key").orderBy("pass", "a", "b", "src")
    items = every.select(
        "page_key", "page_id", F.row_number().over(in_order).cast("bigint").alias("seq"), "src", F.coalesce("alt", F.lit("")).alias("alt"), size("width"), size("height"), F.coalesce("type", F.lit("unknown")).alias("type"), "kind",
        "file_size", "is_base64", "poster", "thumbnail", "hls_manifest", F.when(wait & (F.col("kind") == "video"), True).alias("unresolved_video"), F.when(wait & (F.col("kind") == "image"), True).alias("unresolved_image"), "platform", "hint", "media_key",
    )
    kept = M.scan_dedup(items, "page_key")
    if not resolve_originals:
        return kept.select(*ITEM)
    gallery = F.coalesce(F.col("platform") == "gallery-page", F.lit(False))
    return R.suppress_gallery_thumbs(kept.withColumn("gallery_thumb", F.when(gallery, F.col("thumbnail"))), "page_key").select(*ITEM)
