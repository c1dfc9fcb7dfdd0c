"""URL to candidates: embed ids, resolvers by host, and the joins that bring captured facts."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from lumenweft.functions import cdn
from lumenweft.functions import url as U
from lumenweft.functions.text import F, as_text, column, compiled, interpreted

# Sites, hosts (a leading dot: also below), and what of the path or a parameter holds the id, in order of dispatch.
EMBEDS: list[tuple[str, tuple[str, ...], tuple[tuple[str, str], ...]]] = [
    ("youtube", ("youtu.be",), (("path", r"^/([A-Za-z0-9_-]{11})(?:/|$)"),)),
    ("youtube", ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com", "www.youtube-nocookie.com"), (("v", r"^([A-Za-z0-9_-]{11})$"), ("path", r"^/(?:embed|shorts|live|v)/((?!videoseries)[A-Za-z0-9_-]{11})(?:/|$)"))),
    ("vimeo", (".vimeo.com",), (("path", r"^/video/(\d+)"), ("path", r"^/(?:channels/[^/]+/|groups/[^/]+/videos/)?(\d+)(?:/|$)"))),
    ("dailymotion", ("dai.ly", "www.dai.ly"), (("path", r"^/([A-Za-z0-9]{5,})"),)),
    ("dailymotion", (".dailymotion.com",), (("video", r"^([A-Za-z0-9]{5,})"), ("path", r"^/(?:embed/)?video/([A-Za-z0-9]{5,})"))),
    ("rutube", (".rutube.ru",), (("path", r"(?i)^/(?:video|play/embed|shorts)/([0-9a-f]{32})(?:/|$)"),)),
    ("rumble", (".rumble.com",), (("path", r"(?i)^/(v[a-z0-9]+(?:-[^/]*)?\.html)$"), ("path", r"(?i)^/(embed/[a-z0-9]+)/?$"))),
    ("loom", (".loom.com",), (("path", r"(?i)^/(?:share|embed)/([0-9a-f]{32})(?:/|$)"),)),
    ("streamable", (".streamable.com",), (("path", r"^/[eos]/([a-z0-9]+)"), ("path", r"^/((?!login|signup|about|pricing|terms|privacy)[a-z0-9]{5,6})$"))),
    ("redgifs", (".redgifs.com",), (("path", r"(?i)^/(?:watch|ifr)/([a-z]+)"),)),
    ("twitch-clip", ("clips.twitch.tv",), (("clip", r"^([A-Za-z0-9_-]+)$"), ("path", r"^/((?!embed)[A-Za-z0-9_-]+)"))),
    ("twitch-vod", ("player.twitch.tv",), (("video", r"^v?(\d+)$"),)),
    ("twitch-clip", (".twitch.tv",), (("path", r"^/[^/]+/clip/([A-Za-z0-9_-]+)"), ("clip", r"^([A-Za-z0-9_-]+)$"))),
    ("twitch-vod", (".twitch.tv",), (("path", r"^/videos/(\d+)(?:/|$)"),)),
    ("kick-clip", (".kick.com",), (("path", r"(?i)/clips/(clip_[A-Za-z0-9]+)(?:/|$)"), ("clip", r"^(clip_[A-Za-z0-9]+)$"))),
    ("kick-vod", (".kick.com",), (("path", r"(?i)/videos?/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})(?:/|$)"),)),
    ("soundcloud", ("soundcloud.com", "www.soundcloud.com", "m.soundcloud.com"), (("path", r"(?i)^/((?!discover|stream|search|upload|you|charts|pages|terms-of-use)[a-z0-9][a-z0-9_-]*/(?!sets|likes|tracks|albums|reposts|followers|following|popular-tracks|comments)[a-z0-9][a-z0-9_-]*)/?$"),)),
    ("9gag", (".9gag.com",), (("path", r"^/gag/([A-Za-z0-9]+)"),)),
]
PEERTUBE = r"^/(?:videos/embed|w|videos/watch)/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[1-9A-HJ-NP-Za-km-z]{22})$"
LOWERED = ("rutube", "loom", "redgifs")


@compiled
def embed(url: Column) -> Column:
    """struct<site, id> of the first embed rule that a URL satisfies, else null."""

    def of(u: Column) -> Column:
        found = []
        for site, hosts, places in EMBEDS:
            plain = [h for h in hosts if h[0] != "."]
            at = reduce(lambda a, b: a | b, [u["host"] == h for h in plain] + [U.under(u["host"], h[1:]) for h in hosts if h[0] == "."])
            for where, pattern in places:
                text = u["path"] if where == "path" else F.coalesce(U.param_of(u["query"], where), F.lit(""))
                i = F.regexp_extract(text, pattern, 1)
                found.append(F.when(at & (i != ""), F.struct(F.lit(site).alias("site"), (F.lower(i) if site in LOWERED else i).alias("id"))))
        peertube = F.regexp_extract(u["path"], PEERTUBE, 1)
        found.append(F.when((peertube != "") & u["origin"].startswith("https:"), F.struct(F.lit("peertube").alias("site"), peertube.alias("id"))))
        return F.coalesce(*found)

    return F.when(U.valid(url), U.let(U.parts(url), of))


#: Resolvers that need only the URL: (name, host suffix, priority). Others than these are generic.
HOSTS = [("twitter", "twimg.com", 0), ("unsplash", "unsplash.com", 4), ("bsky", "bsky.app", 7), ("pinterest", "pinimg.com", 8), ("reddit", "redd.it", 9), ("flickr", "staticflickr.com", 10), ("pixiv", "pximg.net", 12), ("youtube", "youtube.com", 15), ("youtube", "youtu.be", 15), ("xiaohongshu", "xhscdn.com", 27)]


#: Where a session keeps the resolvers that it added.
SETTING = "lumenweft.resolvers"


def hosts_of(spark: SparkSession) -> list[tuple[str, str, int]]:
    return HOSTS + [tuple(x) for x in json.loads(spark.conf.get(SETTING, "[]"))]


def register_resolver(spark: SparkSession, name: str, suffix: str, priority: int) -> None:
    """Adds a resolver for a host and those below it to this session. An error where one of that priority has the suffix."""
    own = json.loads(spark.conf.get(SETTING, "[]"))
    if any((s, p) == (suffix, priority) for _, s, p in hosts_of(spark)):
        raise ValueError(f"{suffix} has a resolver of priority {priority} already")
    spark.conf.set(SETTING, json.dumps([*own, (name, suffix, priority)]))


def dispatch(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls plus resolver: the resolver of the highest priority whose host suffix the URL has, else generic.

    Each suffix of a host is looked up in a map of the resolvers, so no row is shuffled, least of all by its host.
    """
    first: dict[str, tuple[int, str]] = {}
    for name, suffix, priority in hosts_of(urls.sparkSession):
        first[suffix] = min(first.get(suffix, (priority, name)), (priority, name))
    with as_text():
        table = F.create_map(*[x for suffix, (priority, name) in first.items() for x in (F.lit(suffix), F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("resolver")))])
        found = lambda labels: F.transform(F.sequence(1, F.size(labels)), lambda i: F.try_element_at(table, F.array_join(F.slice(labels, i, F.size(labels)), ".")))
        best = U.let(F.split(U.host(F.col(url)), r"\."), lambda labels: F.array_min(F.array_compact(found(labels))))
        resolver = F.coalesce(best["resolver"], F.lit("generic"))
    return urls.withColumn("resolver", column(resolver))


def candidates(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls plus original, thumbnail, kind, pending and hint, by the URL alone."""
    with as_text():
        x, resolver = F.col(url), F.col("resolver")
        parts = {"_parts": U.parts(x), "_video": F.when(resolver == "youtube", embed(x))}
    up = cdn.upgraded(dispatch(urls, url), url).withColumns({k: interpreted(v) for k, v in parts.items()})
    with as_text():
        p, h, q, base = (F.col(f"_parts.{x}") for x in ("path", "host", "query", "origin"))
        video_id = F.col("_video")
        blob = F.regexp_extract(p, r"^/img/([^/]+)/plain/([^/]+)/([^@/]+)", 1)
        did, cid = (F.regexp_extract(p, r"^/img/[^/]+/plain/([^/]+)/([^@/]+)", i) for i in (1, 2))
        bsky_path = F.regexp_replace(F.regexp_replace(p, "^/img/feed_thumbnail/", "/img/feed_fullsize/"), "^/img/avatar_thumbnail/", "/img/avatar/")
        special = (
            F.when(resolver == "reddit", F.when(h == "v.redd.it", x).otherwise(F.concat(F.lit("https://i.redd.it"), p)))
            .when((resolver == "bsky") & (blob != ""), U.assemble(base, bsky_path, q))
            .when(video_id.isNotNull(), F.concat(F.lit("https://i.ytimg.com/vi/"), video_id["id"], F.lit("/hqdefault.jpg")))
            .when((resolver == "pixiv") & p.rlike(r"(?i)^/c/[^/]+/img-master/.*_master1200\.[a-z0-9]+$"), F.concat(base, F.regexp_replace(p, r"^/c/[^/]+/", "/")))
            .when(p.rlike(r"media_attachments/.*/small/[^/]+$"), U.assemble(base, F.regexp_replace(p, r"/small/([^/]+)$", "/original/$1"), q))
            .when(F.when(resolver == "unsplash", U.param_of(q, "s").isNotNull()).otherwise(False), x)
        )
        pending = ((resolver == "reddit") & (h == "v.redd.it")) | (blob == "feed_video_blob")
        hint = (
            F.when(blob == "feed_video_blob", F.concat_ws(" ", F.lit("video"), did, cid))
            .when(blob != "", F.concat_ws(" ", F.lit("blob"), did, cid))
            .when(F.col("pending"), F.regexp_extract(p, r"^/([a-z0-9]+)", 1))
            .when(resolver == "flickr", F.nullif(F.regexp_extract(p, r"/(\d+)_[0-9a-f]+", 1), F.lit("")))
        )
        original = F.coalesce(special, F.col("original"))
        thumbnail = F.when(F.col("original") != x, x)
        kind = F.when(F.col("pending"), "video").otherwise(F.when(U.av_type(F.col("original")).isin("mp4", "webm"), "video").otherwise("image"))
    out = up.withColumns({"original": column(original), "pending": column(pending)})
    return out.withColumns({"hint": column(hint), "thumbnail": column(thumbnail), "kind": column(kind)}).drop(*parts)


def by_owner(tiles: DataFrame, sniffed: DataFrame) -> DataFrame:
    """tiles (…, owner_id) joined to what was captured for their owners; of a media key both pending and found, the found stays."""
    w = W.partitionBy("owner_id", "media_key")
    known = F.max((~F.coalesce(F.col("pending"), F.lit(False))).cast("int")).over(w)
    facts = sniffed.withColumn("_known", known).where((F.col("_known") == 0) | ~F.coalesce(F.col("pending"), F.lit(False))).drop("_known")
    return tiles.join(facts, "owner_id")


def best_variant(variants: DataFrame, key: list[str], metric: str, order: str = "ord") -> DataFrame:
    """The variant of the highest metric for each key, the first of equal ones."""
    return variants.groupBy(*key).agg(F.max_by("url", F.struct(F.coalesce(F.col(metric), F.lit(0)).alias("m"), (-F.col(order)).alias("o"))).alias("url"))


def suppress_gallery_thumbs(items: DataFrame, page: str = "page_id") -> DataFrame:
    """items (page, src, gallery_thumb) without those that are the thumbnail of a pending gallery item of their page."""
    thumbs = items.where("gallery_thumb is not null").select(page, U.canonical_key(F.col("gallery_thumb")).alias("_key")).distinct()
    return items.withColumn("_key", F.when(F.col("gallery_thumb").isNull(), U.canonical_key(F.col("src")))).join(thumbs, [page, "_key"], "left_anti").drop("_key")
