"""Queries over stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenweft.functions import url as U
from lumenweft.functions.url import absolute
from lumenweft.operators import collect as C
from lumenweft.operators import extract as X
from lumenweft.operators import graph as G
from lumenweft.operators import offers as O
from lumenweft.operators import originals as E
from lumenweft.operators import resolve as R
from lumenweft.operators import sheets as H
from lumenweft.operators import variants as V
from lumenweft.sources.shared import stored

ANCHOR = r'<a[^>]*?href="([^"]*)"'


def anchors(pages: DataFrame) -> DataFrame:
    """One row for each anchor of each page: page_id, ord (from 0), href. A null html has none."""
    return addressed_anchors(pages).drop("url")


def addressed_anchors(pages: DataFrame) -> DataFrame:
    """anchors() with the page's url, which is carried along."""
    return pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), 1)).alias("ord", "href"))


def anchor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def anchor_dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = anchors(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return a.groupBy("page_id", "href").agg(F.min("ord").cast("bigint").alias("first_ord"), F.count(F.lit(1)).alias("n"))


def page_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads only the addresses; the html column is pruned."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    h = U.host(F.col("url"))
    return p.select(h.alias("host"), U.registrable_domain(h).alias("domain")).groupBy("host", "domain").agg(F.count(F.lit(1)).alias("n"))


def open_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ok = U.injectable(F.col("url"))
    return p.agg(F.sum(ok.cast("bigint")).alias("scanned"), F.sum((~ok).cast("bigint")).alias("skipped"))


def resolved_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = addressed_anchors(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return a.select("page_id", "ord", absolute(F.col("href"), F.col("url")).alias("target"))


def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.elements(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return e.where(F.col("tag").isin("a", "p", "li", "h1", "article", "nav", "footer")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


#: First segments put before the links' paths, in turn; those marked are no media pages.
SEGMENTS = (("photos", 0), ("tags", 1), ("gallery", 0), ("Category", 1), ("taglist", 0), ("sign-in", 1), ("members", 1), ("aboutus", 0), ("newsletter", 1), ("x/tags", 0), ("topic", 1), ("view", 0), ("p", 0), ("art", 0), ("media", 0), ("pagesize", 0))


def gallery_page_gate_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' links, below segments that are and are not a media page's, at the production limit."""
    a = addressed_anchors(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    segment = F.element_at(F.array(*[F.lit(s) for s, _ in SEGMENTS]), ((F.col("page_id") + F.col("ord")) % len(SEGMENTS) + 1).cast("int"))
    a = a.withColumn("href", F.concat(F.lit("/"), segment, "href")).withColumn("thumb_width", (F.col("ord") * 40).cast("int"))
    return X.gallery_links(a).select("page_id", "ord", "target")


#: Site, an address of it, and the id in it; {n} is the page's number, {e} eleven digits, {f} five, {h} 32 hexadecimal ones, {u} these as a UUID, {l} letters.
EMBEDDED = (
    ("youtube", "https://youtu.be/{e}?t=3", "{e}"), ("youtube", "https://www.youtube.com/watch?t=1&v={e}", "{e}"), ("youtube", "https://m.youtube.com/shorts/{e}", "{e}"), ("vimeo", "https://player.vimeo.com/video/{n}", "{n}"),
    ("vimeo", "https://vimeo.com/channels/staff/{n}", "{n}"), ("dailymotion", "https://dai.ly/x{f}", "x{f}"), ("dailymotion", "https://www.dailymotion.com/embed/video/x{f}", "x{f}"), ("rutube", "https://rutube.ru/video/{h}/", "{h}"),
    ("rumble", "https://rumble.com/v{n}-a-title.html", "v{n}-a-title.html"), ("rumble", "https://rumble.com/embed/v{n}/", "embed/v{n}"), ("loom", "https://www.loom.com/share/{h}", "{h}"), ("streamable", "https://streamable.com/e/{n}", "{n}"),
    ("redgifs", "https://www.redgifs.com/watch/{l}", "{l}"), ("twitch-clip", "https://clips.twitch.tv/Clip{n}", "Clip{n}"), ("twitch-vod", "https://player.twitch.tv/?video=v{n}", "{n}"), ("twitch-clip", "https://www.twitch.tv/some/clip/Clip{n}", "Clip{n}"),
    ("twitch-vod", "https://www.twitch.tv/videos/{n}", "{n}"), ("kick-clip", "https://kick.com/a/clips/clip_{n}", "clip_{n}"), ("kick-vod", "https://kick.com/a/videos/{u}", "{u}"), ("soundcloud", "https://soundcloud.com/artist{n}/track{n}", "artist{n}/track{n}"),
    ("9gag", "https://9gag.com/gag/a{n}", "a{n}"), ("peertube", "https://tube.example/w/{u}", "{u}"), (None, "https://example.com/video/1", None), (None, "https://www.youtube.com/watch?v=short&x={n}", None),
)
_HEX = "md5(cast(page_id AS STRING))"
_HOLES = {
    "{n}": "cast(page_id AS STRING)", "{e}": "lpad(cast(page_id AS STRING), 11, '0')", "{f}": "lpad(cast(page_id AS STRING), 5, '0')", "{h}": _HEX, "{l}": "translate(cast(page_id AS STRING), '0123456789', 'abcdefghij')",
    "{u}": " || '-' || ".join(f"substring({_HEX}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))),
}


def _made(k: int) -> str:
    """SQL, for both engines, of the k-th value of EMBEDDED by page."""

    def text(t: str | None) -> str:
        if t is None:
            return "NULL"
        out = f"'{t}'"
        for hole, sql in _HOLES.items():
            out = out.replace(hole, f"' || {sql} || '")
        return out

    return f"CASE page_id % {len(EMBEDDED)} " + " ".join(f"WHEN {i} THEN {text(e[k])}" for i, e in enumerate(EMBEDDED)) + " END"


def anchor_embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the links of the pages embed; each page's markup has one more link, to an address of a known site in turn."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    p = p.withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit('<p><a class="x" href="'), F.expr(_made(1)), F.lit('">y</a>')))
    a = addressed_anchors(p).withColumn("target", absolute(F.col("href"), F.col("url")))
    return a.withColumn("e", R.embed(F.col("target"))).where("e is not null").select("page_id", "ord", "e.site", "e.id")


_MARKUP = """concat('<html><head><meta property="og:image" content="/og/', page_id, '.jpg"></head><body><p><img src="/i/', page_id, '.png" alt="A" width="640" height="480" srcset="/i/', page_id, '-800x600.png 800w"></p>',
  '<video src="/v/', page_id, '.mp4" poster="https://p.example/x.jpg" title="T"></video><a href="/f/', page_id, '.webp"><img src="/t/', page_id, '.webp"></a><a href="', MADE, '">e</a>',
  '<iframe src="https://player.vimeo.com/video/', page_id, '"></iframe><div style="background-image: url(/b/', page_id, '.gif)"></div><img src="/i/', page_id, '.png?token=zz"></body></html>')"""


def collected_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan over every page's address, with markup that holds an item for most of its passes."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    items = C.media(p.withColumn("html", F.expr(_MARKUP.replace("MADE", f"coalesce({_made(1)}, '')"))))  # no site is a negative number's turn
    return items.select("page_id", "src", "kind", "type", "width", "height", F.coalesce("unresolved_video", F.lit(False)).alias("pending"))


_PATREON = "https://c1.patreonusercontent.com/4/patreon-media/p/post/{n}/"
#: A page's address, what its markup ends with, and the items there (site, place, kind, address, key); {n} is the page's number.
SITE_PAGES = (
    ("https://imgur.com/gallery/{n}", '<script>window.postDataJSON={"media":[{"id":"a{n}","url":"https://i.imgur.com/a{n}.png"},{"id":"b","url":"https://other.example/b.png"},{"url":"https://i.imgur.com/c{n}.mp4"}]};</script>', (("imgur", 0, "image", "https://i.imgur.com/a{n}.png", "imgur a{n}"), ("imgur", 1, "video", "https://i.imgur.com/c{n}.mp4", "imgur 2"))),
    ("https://www.patreon.com/posts/title-{n}", f'<img src="{_PATREON}aa/eyJ3Ijo2MjB9/1.jpg?t=1"><img src="{_PATREON}aa/eyJhIjoxLCJwIjoxfQ==/1.jpg?t=2"><img src="{_PATREON}bb/eyJ3Ijo2MjB9/2.gif">', (("patreon", 0, "image", _PATREON + "aa/eyJhIjoxLCJwIjoxfQ==/1.jpg?t=2", "patreon {n} aa/1.jpg"), ("patreon", 1, "gif", _PATREON + "bb/eyJ3Ijo2MjB9/2.gif", "patreon {n} bb/2.gif"))),
    ("https://fapello.com/some/{n}/", '<div class="uk-align-center"><img src="https://cdn.fapello.com/{n}.md.jpg"></div>', (("fapello", 0, "image", "https://cdn.fapello.com/{n}.jpg", "fapello some {n}"),)),
    ("https://xhamster.com/videos/title-{n}", '<script>window.initials = {"videoModel":{"sources":{"mp4":{"240p":"https://a.xhcdn.com/s{n}.mp4","1080p":"https://a.xhcdn.com/l{n}.mp4"}}}};</script>', (("xhamster", 0, "video", "https://a.xhcdn.com/l{n}.mp4", "xhamster {n}"),)),
    ("https://www.pornhub.com/view_video.php?viewkey=ph{n}", '<script>var flashvars_1 = {"mediaDefinitions":[{"format":"hls","quality":"240","videoUrl":"https://h.phncdn.com/{n}/240.m3u8"},{"format":"hls","quality":["240"],"videoUrl":"https://h.phncdn.com/{n}/all.m3u8"}]};</script>', (("pornhub", 0, "video", "https://h.phncdn.com/{n}/all.m3u8", "pornhub ph{n}"),)),
    ("https://ok.ru/video/{n}", '<div data-options="{&quot;flashvars&quot;:{&quot;metadata&quot;:{&quot;videos&quot;:[{&quot;name&quot;:&quot;hd&quot;,&quot;url&quot;:&quot;https://v.okcdn.ru/?id=h{n}&quot;},{&quot;name&quot;:&quot;sd&quot;,&quot;url&quot;:&quot;https://v.okcdn.ru/?id=s{n}&quot;}]}}}"></div>', (("okru", 0, "video", "https://v.okcdn.ru/?id=h{n}", "okru {n}"),)),
    ("https://imgpile.com/p/s{n}", '<i class="post-media"><a href="https://c.example/{n}.png"></a></i><i class="post-media"><a href="https://c.example/{n}.webm"></a></i>', (("imgpile", 0, "image", "https://c.example/{n}.png", "imgpile s{n} 0"), ("imgpile", 1, "video", "https://c.example/{n}.webm", "imgpile s{n} 1"))),
    ("https://imgspice.com/{n}.html", '<img id="imgpreview" src="/i/{n}.jpg">', (("imghost", 0, "image", "https://imgspice.com/i/{n}.jpg", "imghost imgspice.com/{n}.html"),)),
    ("https://jpg5.su/img/{n}", '<meta property="og:image" content="https://f.example/{n}.gif">', (("chevereto", 0, "gif", "https://f.example/{n}.gif", "chevereto jpg5.su {n}"),)),
    ("https://plain.example/{n}", '<meta property="og:image" content="https://f.example/{n}.gif">', ()),
)


def _text(t: str, kind: str = "STRING") -> str:
    return "'" + t.replace("{n}", f"' || cast(page_id AS {kind}) || '") + "'"


def site_reader_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the readers of sites find on every page, each given a known site's address and an end of its markup in turn."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    k = F.col("page_id") % len(SITE_PAGES)
    pick = lambda i: F.element_at(F.array(*[F.expr(_text(s[i])) for s in SITE_PAGES]), (k + 1).cast("int"))
    rows = p.select("page_id", pick(0).alias("url"), F.concat(F.coalesce("html", F.lit("")), pick(1)).alias("html"))
    return O.site_media(rows).select("page_id", "site", "idx", "kind", "url", "media_key")


_SPIEGEL = "https://cdn.prod.www.spiegel.de/images/0123abcd-0123-0123-0123-{n}_w"
#: An image's address, two candidates of its srcset, and what is found: resolver, which of the three, width, height; {n} is the page's number, in twelve digits.
LISTED = (
    ("https://img.magnific.com/{n}.jpg?t=a&w=740", "https://img.magnific.com/{n}.jpg?t=b&w=360 360w", "https://img.magnific.com/{n}.jpg?t=c&w=2000 2000w", "magnific", 2, 2000, None),
    ("https://www.n.example/resizer/v2/{n}.png?auth=h&width=100", "https://www.n.example/resizer/v2/{n}.png?auth=h&width=900 900w", "https://m.n.example/resizer/v2/{n}.png?auth=h&width=1900 1900w", "arcxp", 1, 900, None),
    (_SPIEGEL + "300_r1.5_a.jpg", _SPIEGEL + "1200_r1.5_b.jpg 1200w", _SPIEGEL + "600_r1.5_c.jpg 9000w", "spiegel", 1, 1200, 800),
    ("https://img-s1.onedio.com/id-{n}/rev-0/w-900/h-450/f-jpg/s-a1.jpg", "https://img-s1.onedio.com/id-{n}/rev-0/w-600/h-300/f-jpg/s-a2.jpg 600w", "https://img-s2.onedio.com/id-ff/rev-0/w-1200/h-600/f-jpg/s-a3.jpg 1200w", "onedio", 0, 900, 450),
    ("https://plain.example/{n}.jpg", "https://plain.example/{n}-l.jpg 2000w", "https://img.magnific.com/{n}.jpg?w=2000 2000w", None, 0, None, None),
)


def _listed(k: int, kind: str = "STRING") -> str:
    """SQL, for both engines, of the k-th value of LISTED by page."""
    text = lambda t: "'" + t.replace("{n}", f"' || lpad(cast(page_id AS {kind}), 12, '0') || '") + "'"
    return f"CASE page_id % {len(LISTED)} " + " ".join(f"WHEN {i} THEN {text(r[k])}" for i, r in enumerate(LISTED)) + " END"


def listed_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest rendition that a srcset lists, for an image of a known site in turn on every page."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("page_url"))
    images = p.select("*", F.expr(_listed(0)).alias("src"), F.array(F.expr(_listed(1)), F.expr(_listed(2))).alias("listed"), F.lit(None).cast("int").alias("natural_width"), F.lit(None).cast("int").alias("natural_height"))
    return V.widest_listed(images).select("page_id", "resolver", "original", "width", "height")


_MD5 = "0123456789abcdef0123{n}"
#: A page's address, what its markup ends with, the image's address, and what the page names as its original (resolver, address, kind, key); {n} is the page's number in twelve digits.
NAMED_PAGES = (
    ("https://danbooru.donmai.us/posts/{n}", '<section data-file-url="https://cdn.donmai.us/o/{n}.png" data-id="{n}"><p><img src="https://cdn.donmai.us/s/{n}.jpg"></p></section>', "https://cdn.donmai.us/s/{n}.jpg", ("booru", "https://cdn.donmai.us/o/{n}.png", "image", "booru danbooru.donmai.us {n}")),
    ("https://derpibooru.org/images/{n}", '<div data-uris="{&quot;full&quot;:&quot;https://derpicdn.net/v/{n}.webm&quot;}"><img src="https://derpicdn.net/{n}.png"></div>', "https://derpicdn.net/{n}.png", ("booru", "https://derpicdn.net/v/{n}.webm", "video", None)),
    ("https://www.zerochan.net/{n}", '<script type="application/ld+json">{"@type":"ImageObject","contentUrl":"https://static.zerochan.net/{n}.png"}</script><div id="large"><img src="https://s1.zerochan.net/{n}.jpg"></div>', "https://s1.zerochan.net/{n}.jpg", ("zerochan", "https://static.zerochan.net/{n}.png", "image", None)),
    ("https://boards.4chan.org/g/thread/{n}", '<div class="file"><a class="fileThumb" href="//i.4cdn.org/g/{n}.webm">x</a><img src="https://i.4cdn.org/g/{n}s.jpg"></div>', "https://i.4cdn.org/g/{n}s.jpg", ("fourchan", "https://i.4cdn.org/g/{n}.webm", "video", "4chan {n}")),
    ("https://boards.4chan.org/b/thread/{n}", '<div class="post"><p class="fileText">F <a href="//i.4cdn.org/b/{n}.gif">x</a></p><img src="https://i.4cdn.org/b/{n}s.jpg"></div>', "https://i.4cdn.org/b/{n}s.jpg", ("fourchan", "https://i.4cdn.org/b/{n}.gif", "gif", "4chan {n}")),
    ("https://desuarchive.org/a/{n}", '<article class="post"><a class="thread_image_link" href="https://desu-usergeneratedcontent.xyz/i/{n}.png"><img src="https://desu-usergeneratedcontent.xyz/t/{n}s.jpg"></a></article>', "https://desu-usergeneratedcontent.xyz/t/{n}s.jpg", ("foolfuuka", "https://desu-usergeneratedcontent.xyz/i/{n}.png", "image", "foolfuuka desuarchive.org {n}")),
    ("https://pikabu.ru/story/{n}", '<div class="story-image"><img src="https://cs1.pikabu.ru/{n}.jpg"><a class="story-image__link" href="https://cs1.pikabu.ru/big/{n}.png">+</a></div>', "https://cs1.pikabu.ru/{n}.jpg", ("pikabu", "https://cs1.pikabu.ru/big/{n}.png", "image", None)),
    ("https://postimg.cc/{n}", '<img src="https://i.postimg.cc/x/{n}.jpg"><a id="download" href="https://i.postimg.cc/y/{n}.jpg?dl=1">d</a>', "https://i.postimg.cc/x/{n}.jpg", ("postimages", "https://i.postimg.cc/y/{n}.jpg", "image", None)),
    ("https://wallpaperswide.com/{n}.html", '<img src="https://wallpaperswide.com/t/{n}.jpg"><div class="wallpaper-resolutions"><a href="/download/{n}-1280x720.jpg">s</a><a href="/download/{n}-2560x1440.jpg">l</a></div>', "https://wallpaperswide.com/t/{n}.jpg", ("wallpaper-hosts", "https://wallpaperswide.com/download/{n}-2560x1440.jpg", "image", None)),
    ("https://wallpaperscraft.com/wallpaper/{n}", '<img src="https://images.wallpaperscraft.com/image/single/w_{n}_1280x720.jpg"><a href="/download/w_{n}/3840x2160">l</a>', "https://images.wallpaperscraft.com/image/single/w_{n}_1280x720.jpg", ("wallpaperscraft", "https://images.wallpaperscraft.com/image/single/w_{n}_3840x2160.jpg", "image", None)),
    ("https://anime-pictures.net/posts/{n}", f'<meta property="og:image" content="https://opreviews.anime-pictures.net/0/{_MD5}_bp.avif"><img src="https://opreviews.anime-pictures.net/0/{_MD5}_cp.avif"><a class="icon-download" href="https://api.anime-pictures.net/pictures/download_image/{{n}}.png">d</a>', f"https://opreviews.anime-pictures.net/0/{_MD5}_cp.avif", ("animepictures", "https://api.anime-pictures.net/pictures/download_image/{n}.png", "image", f"animepictures {_MD5}")),
    ("https://www.artstation.com/u", '<div data-test-id="c"><a href="/artwork/a{n}"><img src="https://cdna.artstation.com/p/assets/images/images/{n}/small/a.jpg"></a><video></video></div>', "https://cdna.artstation.com/p/assets/images/images/{n}/small/a.jpg", ("artstation", "https://cdna.artstation.com/p/assets/images/images/{n}/small/a.jpg", "video", None)),
    ("https://plain.example/{n}", '<section data-file-url="https://cdn.donmai.us/o/{n}.png"><img src="https://cdn.donmai.us/s/{n}.jpg"></section>', "https://cdn.donmai.us/s/{n}.jpg", None),
)


def _padded(t: str, kind: str = "STRING") -> str:
    """SQL, for both engines, of a text with the page's number in twelve digits."""
    return "'" + t.replace("{n}", f"' || lpad(cast(page_id AS {kind}), 12, '0') || '") + "'"


def _in_turn(texts: tuple[str, ...]) -> str:
    return f"CASE page_id % {len(texts)} " + " ".join(f"WHEN {i} THEN {_padded(t)}" for i, t in enumerate(texts)) + " END"


def element_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The originals that pages name beside their images; each page's stored markup gets a known site's address and ends with an image of it, in turn."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    ends = F.expr(_in_turn(tuple(c[1] for c in NAMED_PAGES)))
    p = p.select("page_id", F.expr(_in_turn(tuple(c[0] for c in NAMED_PAGES))).alias("url"), F.concat(F.coalesce("html", F.lit("")), ends).alias("html"))
    e = stored(X.elements(p), "elements")
    images = X.image_urls(e).select(F.col("page_id").alias("page_key"), F.col("url").alias("page_url"), F.col("elem_ordinal").alias("at"), "src")
    return E.element_originals(images, e).select(F.col("page_key").alias("page_id"), "src", "resolver", "original", "kind", "media_key")


_FB = "https://scontent.xx.fbcdn.net/v/{n}"
#: A page's address, and the bodies that were captured while it was open (platform, request, body).
CAPTURED_PAGES = (
    ("https://www.facebook.com/photo/?fbid=9{n}&set=a", (
        ("facebook", "", 'for (;;);{"data":{"node":{"id":"9{n}","image":{"uri":"' + _FB + '_s.jpg","width":320,"height":240},"viewer_image":{"uri":"' + _FB + '_l.jpg","width":2048,"height":1536},"preview_image":{"uri":"' + _FB + '_p.jpg","width":4096,"height":4096}}}}'),
        ("facebook", "", '{"data":{"node":{"id":"9{n}","small":{"uri":"' + _FB + '_m.jpg","width":640,"height":480}}}}'),
    )),
    ("https://www.facebook.com/watch/?v=8{n}", (
        ("facebook", "", '{"a":[{"id":"8{n}","playable_url":"' + _FB + '_sd.mp4","playable_url_quality_hd":"' + _FB + '_hd.mp4","preferred_thumbnail":{"image":{"uri":"' + _FB + '_c.jpg"}},"cover":{"uri":"' + _FB + '_c.jpg","width":900,"height":900}},{"id":"7","x":{"uri":"' + _FB + '_o.jpg","width":900,"height":900}}]}'),
    )),
    ("https://www.pinterest.co.uk/pin/some-title--55{n}/", (
        ("pinterest", "", '{"r":{"data":[{"type":"board","id":"66{n}","images":{"orig":{"url":"https://i.pinimg.com/originals/b.jpg"}}},{"id":"55{n}","carousel_data":{"carousel_slots":[{"images":{"236x":{"url":"https://i.pinimg.com/236x/{n}-1.jpg","width":236},"736x":{"url":"https://i.pinimg.com/736x/{n}-1.jpg","width":736,"height":900}}},{"images":{"orig":{"url":"https://i.pinimg.com/originals/{n}-2.png","width":100,"height":90}}}]}}]}}'),
    )),
    ("https://www.pinterest.com/pin/44{n}/?x=1", (
        ("pinterest", "", '{"id":"44{n}","videos":{"video_list":{"V_HLSV4":{"url":"https://v1.pinimg.com/{n}.m3u8"},"V_720P":{"url":"https://v1.pinimg.com/{n}.mp4"}}},"images":{"orig":{"url":"https://i.pinimg.com/originals/{n}.jpg"}}}'),
    )),
    ("https://mangadex.org/chapter/01234567-89ab-cdef-0123-{n}/2", (
        ("mangadex", "https://api.mangadex.org/at-home/server/01234567-89ab-cdef-0123-{n}", '{"baseUrl":"https://x.mangadex.network/","chapter":{"hash":"0123456789abcdef","data":["1-a.png","../bad.png","3-c.jpg"],"dataSaver":["1-s.jpg"]}}'),
    )),
    ("https://plain.example/{n}", (("facebook", "", '{"id":"9{n}"'), ("other", "", "{}"))),
)
#: The media of those pages: kind, address, key.
CAPTURED_MEDIA = (
    (("image", _FB + "_l.jpg", "fb:9{n}"),), (("video", _FB + "_hd.mp4", "fb:8{n}"),), (("image", "https://i.pinimg.com/736x/{n}-1.jpg", None), ("image", "https://i.pinimg.com/originals/{n}-2.png", None)), (("video", "https://v1.pinimg.com/{n}.mp4", None),),
    (("image", "https://x.mangadex.network/data/0123456789abcdef/1-a.png", None), ("image", "https://x.mangadex.network/data/0123456789abcdef/3-c.jpg", None)), (),
)


def captured_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was captured of the items that pages are of: bodies and pages meet by the owner that a page's address names, in turn."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    most = max(len(bodies) for _, bodies in CAPTURED_PAGES)
    nth = lambda k, i: F.expr(_in_turn(tuple(c[1][k][i] if k < len(c[1]) else "" for c in CAPTURED_PAGES)))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), nth(k, 0).alias("platform"), nth(k, 1).alias("request_url"), nth(k, 2).alias("body")) for k in range(most)])
    bodies = p.select("page_id", F.explode(rows).alias("r")).where("r.body <> ''").select((F.col("page_id") * most + F.col("r.k")).alias("payload_id"), "r.platform", "r.request_url", "r.body")
    pages = p.select(F.col("page_id").alias("page_key"), F.expr(_in_turn(tuple(c[0] for c in CAPTURED_PAGES))).alias("url"))
    return G.page_facts(pages, G.captured_media(bodies)).select(F.col("page_key").alias("page_id"), "platform", "idx", "kind", "src", "media_key")


_NESTED = """concat(html, '<div><template shadowrootmode="open"><img src="/shadow/', page_id, '.png"><iframe srcdoc="&lt;img src=/deep/', page_id, '.png&gt;&lt;img src=/page/', page_id, '.png?_=1&gt;"></iframe></template></div>',
  '<template><img src="/inert/', page_id, '.png"></template><img src="/page/', page_id, '.png"><iframe srcdoc="&lt;video src=/frame/', page_id, '.mp4&gt;&lt;/video&gt;"></iframe>')"""


def nested_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of the stored markup with shadow roots and frames' documents behind it: rows of nested roots once, in the order in which roots are found."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null").select("page_id", "url", F.expr(_NESTED).alias("html"))
    return C.media(p).where("kind in ('image', 'video') and src rlike '/(?:page|shadow|deep|frame|inert)/'").select("page_id", "src", "kind", F.row_number().over(W.partitionBy("page_id").orderBy("seq")).alias("place"))


_S = "https://s.example/{n}-"
#: What follows a page's markup: a sheet, or several, and elements of which some are named by its rules.
STYLED_PAGES = (
    f'<style>#x{{n}} {{background:url({_S}id.png)}} .c {{background:url({_S}class.png)}} i {{background:url({_S}tag.png)}}</style><i id="x{{n}}" class="c"></i><b class="d c"></b><i></i><b></b>',
    f'<style>.a{{background-image:url({_S}old.png)}} .a{{background-image:url({_S}new.png)}} .b{{background:url({_S}strong.png) !important}}</style><u class="a"></u><u class="b" style="background:url({_S}weak.png)"></u><u class="a" style="background-image:url({_S}own.png)"></u><u class="a" style="background:none"></u>',
    f'<style>.p > u{{background:url({_S}child.png)}} .p b{{background:url({_S}below.png)}} s + q{{background:url({_S}next.png)}} s ~ u.z{{background:url({_S}later.png)}}</style><div class="p"><u><b></b></u><em><u></u></em></div><b></b><s></s><q></q><q></q><u class="z"></u>',
    f'<style media="print">u{{background:url({_S}print.png)}}</style><style>@media (max-width: 9px){{u{{background:url({_S}small.png)}}}} @media screen{{u[data-k^="on"]{{background:image-set(url({_S}1x.png) 1x, url({_S}2x.png) 2x), url({_S}layer.png)}}}} u:hover{{background:url({_S}hover.png)}}</style><u data-k="one"></u><u data-k="two"></u>',
    f'<style>u{{background:url({_S}page.png)}}</style><div><template shadowrootmode="open"><style>u{{background:url({_S}shadow.png)}} b{{background:url({_S}shadow-b.png)}}</style><u></u></template></div><u></u><b></b>',
    f'<style>/* u{{background:url({_S}no.png)}} */ .w{{background-image:url({_S}w.png)}} u.w{{background:red}} q.w{{background-image:url("{_S}(;}}).png")}}</style><u class="w"></u><q class="w"></q><noscript><style>u{{background:url({_S}ns.png) !important}}</style></noscript>',
)
#: Their backgrounds: place in the element's list, name.
STYLED = (
    ((0, "id.png"), (0, "class.png"), (0, "tag.png")), ((0, "new.png"), (0, "strong.png"), (0, "own.png")), ((0, "child.png"), (0, "below.png"), (0, "next.png"), (0, "later.png")), ((0, "2x.png"), (1, "layer.png")),
    ((0, "shadow.png"), (0, "page.png")), ((0, "(;}).png"),),
)


def styled_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backgrounds of elements by the cascade of sheets and attributes; each page's stored markup, its own sheets among it, ends with sheets and elements in turn."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), F.expr(_in_turn(STYLED_PAGES))).alias("html"))
    return H.sheet_backgrounds(stored(X.elements(p), "elements")).select("page_id", "sub_ordinal", "src")


def embed_id_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    n = F.lpad(F.col("page_id").cast("string"), 11, "0")
    made = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?t=1&v="), n))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://player.vimeo.com/video/"), F.col("page_id").cast("string")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://www.twitch.tv/videos/"), F.col("page_id").cast("string")))
        .otherwise("https://example.com/video/1")
    )
    e = R.embed(made)
    return p.select("page_id", e["site"].alias("site"), e["id"].alias("id"))


def resolver_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    n = F.col("page_id").cast("string")
    made = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://preview.redd.it/"), n, F.lit(".png?width=100&s=x"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://youtu.be/"), F.lpad(n, 11, "0"))).otherwise(F.concat(F.lit("https://plain.example/"), n, F.lit(".jpg")))
    return R.candidates(p.withColumn("url", made)).select("page_id", "resolver", "original")


QUERIES = {f.__name__: f for f in (anchor_scan, anchor_dedup_first_seen, page_host, open_pages, resolved_anchors, element_counts, gallery_page_gate_whole, anchor_embeds, collected_media, site_reader_media, listed_originals, element_originals, captured_items, nested_roots, styled_backgrounds, embed_id_scan, resolver_dispatch)}
_H = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
_O = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
_A = """a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*?href="([^"]*)"', 1)) AS href,
  generate_subscripts(regexp_extract_all(html, '<a[^>]*?href="([^"]*)"', 1), 1) - 1 AS ord FROM pages)"""
ORACLES = {
    "anchor_scan": f"WITH {_A} SELECT page_id, CAST(ord AS INTEGER) AS ord, href FROM a",
    "anchor_dedup_first_seen": f"WITH {_A} SELECT page_id, href, CAST(min(ord) AS BIGINT) AS first_ord, count(*) AS n FROM a GROUP BY page_id, href",
    "page_host": f"""WITH h AS (SELECT {_H} AS host FROM pages) SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, count(*) AS n FROM h GROUP BY ALL""",
    "open_pages": "SELECT CAST(count(*) FILTER (WHERE regexp_matches(url, '^https?://')) AS BIGINT) AS scanned, CAST(count(*) FILTER (WHERE NOT regexp_matches(url, '^https?://')) AS BIGINT) AS skipped FROM pages",
    "resolved_anchors": f"WITH {_A} SELECT page_id, CAST(ord AS INTEGER) AS ord, {_O} || href AS target FROM a JOIN pages USING (page_id)",
    "element_counts": """SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', ''), '<(a|p|li|h1|article|nav|footer)[ >]', 1)) AS tag FROM pages) GROUP BY page_id, tag""",
    "gallery_page_gate_whole": f"""WITH {_A}, s AS (SELECT page_id, ord, href, [{", ".join(f"'{x}'" for x, _ in SEGMENTS)}][CAST((page_id + ord) % {len(SEGMENTS)} AS INTEGER) + 1] AS segment FROM a)
SELECT page_id, CAST(ord AS INTEGER) AS ord, {_O} || '/' || segment || href AS target FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM s JOIN pages USING (page_id)
  WHERE (ord = 0 OR ord * 40 >= 64) AND segment NOT IN ({", ".join(f"'{x}'" for x, no in SEGMENTS if no)})) WHERE n <= 60""",
    "anchor_embeds": f"""WITH {_A}, n AS (SELECT page_id, count(*) AS n FROM a GROUP BY page_id), e AS (SELECT page_id, {_made(0).replace("STRING", "VARCHAR")} AS site, {_made(2).replace("STRING", "VARCHAR")} AS id FROM pages)
SELECT e.page_id, CAST(coalesce(n.n, 0) AS INTEGER) AS ord, site, id FROM e LEFT JOIN n ON n.page_id = e.page_id WHERE site IS NOT NULL""",
    "collected_media": f"""WITH p AS (SELECT *, {_O} AS o, {_made(0).replace("STRING", "VARCHAR")} AS site, {_made(2).replace("STRING", "VARCHAR")} AS id FROM pages)
SELECT page_id, o || '/i/' || page_id || '.png' AS src, 'image' AS kind, 'png' AS type, 640 AS width, 480 AS height, false AS pending FROM p
UNION ALL SELECT page_id, o || '/i/' || page_id || '-800x600.png', 'image', 'png', 800, 600, false FROM p UNION ALL SELECT page_id, o || '/t/' || page_id || '.webp', 'image', 'webp', 0, 0, false FROM p
UNION ALL SELECT page_id, o || '/b/' || page_id || '.gif', 'image', 'gif', 0, 0, false FROM p UNION ALL SELECT page_id, o || '/v/' || page_id || '.mp4', 'video', 'mp4', 0, 0, false FROM p
UNION ALL SELECT page_id, o || '/f/' || page_id || '.webp', 'image', 'webp', 0, 0, false FROM p UNION ALL SELECT page_id, o || '/og/' || page_id || '.jpg', 'image', 'jpeg', 0, 0, false FROM p
UNION ALL SELECT page_id, 'https://i.ytimg.com/vi/' || id || '/hqdefault.jpg', 'image', 'jpeg', 0, 0, false FROM p WHERE site = 'youtube'
UNION ALL SELECT DISTINCT * FROM (SELECT page_id, 'https://vimeo.com/' || page_id, 'video', 'mp4', 0, 0, true FROM p
  UNION ALL SELECT page_id, CASE site {" ".join(f"WHEN '{k}' THEN replace('{v[0]}', '{{}}', id)" for k, v in C.EMBED_PAGES.items())} ELSE 'https://tube.example/videos/embed/' || id END, 'video',
    CASE WHEN site IN ({", ".join(f"'{k}'" for k, v in C.EMBED_PAGES.items() if v[1] == "m3u8")}) THEN 'm3u8' ELSE 'mp4' END, 0, 0, true FROM p WHERE site NOT IN ('youtube', '9gag'))""",
    "site_reader_media": " UNION ALL ".join(
        f"SELECT page_id, '{site}' AS site, {idx} AS idx, '{kind}' AS kind, {_text(url, 'VARCHAR')} AS url, {_text(key, 'VARCHAR')} AS media_key FROM pages WHERE page_id % {len(SITE_PAGES)} = {i}" for i, (_, _, items) in enumerate(SITE_PAGES) for site, idx, kind, url, key in items
    ),
    "listed_originals": " UNION ALL ".join(
        f"SELECT page_id, {'NULL' if r[3] is None else repr(r[3])} AS resolver, split_part({_listed(r[4], 'VARCHAR')}, ' ', 1) AS original, CAST({r[5] or 'NULL'} AS INTEGER) AS width, CAST({r[6] or 'NULL'} AS INTEGER) AS height FROM pages WHERE page_id % {len(LISTED)} = {i}"
        for i, r in enumerate(LISTED)
    ),
    "embed_id_scan": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'youtube' WHEN 1 THEN 'vimeo' WHEN 2 THEN 'twitch-vod' END AS site, CASE page_id % 4 WHEN 0 THEN lpad(CAST(page_id AS VARCHAR), 11, '0') WHEN 3 THEN NULL ELSE CAST(page_id AS VARCHAR) END AS id FROM pages",
    "resolver_dispatch": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'reddit' WHEN 1 THEN 'youtube' ELSE 'generic' END AS resolver, CASE page_id % 3 WHEN 0 THEN 'https://i.redd.it/' || page_id || '.png' WHEN 1 THEN 'https://i.ytimg.com/vi/' || lpad(CAST(page_id AS VARCHAR), 11, '0') || '/hqdefault.jpg' ELSE 'https://plain.example/' || page_id || '.jpg' END AS original FROM pages",
    "element_originals": " UNION ALL ".join(
        f"SELECT page_id, {_padded(src, 'VARCHAR')} AS src, '{r[0]}' AS resolver, {_padded(r[1], 'VARCHAR')} AS original, '{r[2]}' AS kind, {'CAST(NULL AS VARCHAR)' if r[3] is None else _padded(r[3], 'VARCHAR')} AS media_key FROM pages WHERE page_id % {len(NAMED_PAGES)} = {i}"
        for i, (_, _, src, r) in enumerate(NAMED_PAGES) if r
    ),
    "captured_items": " UNION ALL ".join(
        f"SELECT page_id, '{CAPTURED_PAGES[i][1][0][0]}' AS platform, {idx} AS idx, '{kind}' AS kind, {_padded(src, 'VARCHAR')} AS src, {'CAST(NULL AS VARCHAR)' if key is None else _padded(key, 'VARCHAR')} AS media_key FROM pages WHERE page_id % {len(CAPTURED_PAGES)} = {i}"
        for i, items in enumerate(CAPTURED_MEDIA) for idx, (kind, src, key) in enumerate(items)
    ),
    "nested_roots": f"""WITH p AS (SELECT page_id, {_O} AS o FROM pages WHERE html IS NOT NULL)
SELECT page_id, o || '/' || name || '/' || page_id || ext AS src, kind, place FROM p, (VALUES ('page', '.png', 'image', 1), ('shadow', '.png', 'image', 2), ('deep', '.png', 'image', 3), ('frame', '.mp4', 'video', 4)) AS v(name, ext, kind, place)""",
    "styled_backgrounds": " UNION ALL ".join(
        f"SELECT page_id, CAST({k} AS INTEGER) AS sub_ordinal, {_padded(_S + name, 'VARCHAR')} AS src FROM pages WHERE page_id % {len(STYLED)} = {i}" for i, found in enumerate(STYLED) for k, name in found
    ),
}
