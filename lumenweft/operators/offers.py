"""Media of stored pages of sites that offer one item several times: in sizes, in qualities, or in a script's JSON.

Each site has an expression that lists a page's offers, all of built-in functions; a page is read once, whichever site it
is of. Of the offers of one item the best by rank stays, the first of equal ones, found by an aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenweft.functions import url as U
from lumenweft.operators import readers as R

OFFER = "struct<ord:int,item:string,rank:double,url:string,name:string,poster:string,ext:string>"

# Site -> its pages' hosts.
HOSTS = {
    "patreon": r"(?:^|\.)patreon\.com$", "fapello": r"(?:^|\.)fapello\.(?:com|su)$", "imgur": r"(?:^|\.)imgur\.(?:com|io)$",
    "xhamster": r"(?:^|\.)xhamster[0-9]*\.(?:com|desi|one)$", "pornhub": r"(?:^|\.)pornhub\.com$", "okru": r"(?:^|\.)ok\.ru$",
}
# Site -> the path of its pages with the id; the files' hosts.
PATHS = {
    "patreon": r"/posts/(?:[^/]*?-)?(\d+)(?:/|$)", "fapello": r"^/((?!(?i:trending|videos|top-likes|top-followers|popular_videos|search|ai)/)[A-Za-z0-9._-]+/\d+)/?$", "imgur": r"^(/)",
    "xhamster": r"(?i)/videos/(?:.*-)?([a-z0-9]+)(?:/|$)", "pornhub": r"(?i)^/embed/([a-z0-9]+)(?:/|$)", "okru": r"(?i)^/(?:video|videoembed)/(\d+)(?:/|$)",
}
FILES = {"imgur": "i.imgur.com", "xhamster": "xhcdn.com", "pornhub": "phncdn.com", "okru": ("okcdn.ru", "mycdn.me")}
# Names of renditions, from the worst to the best.
QUALITIES = ("mobile", "lowest", "low", "sd", "hd", "full", "quad", "ultra")
PATREON_FILE = r"/([0-9a-f]+)/([^/?\"'\s]+)/([^/?\"'\s]+)(?:\?[^\"'\s<>]*)?"

XHAMSTER = "struct<videoModel:struct<sources:struct<mp4:map<string,string>,standard:struct<h264:array<struct<url:string,quality:string>>>>>>"
PORNHUB = "struct<image_url:string,mediaDefinitions:array<struct<format:string,videoUrl:string,quality:string,remote:string>>>"
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}(?:==)?|[A-Za-z0-9+/]{3}=?)?$"


def _offer(ord_: Column, url: Column, rank=0, item=None, name=None, poster=None, ext=None) -> Column:
    values = (ord_, F.lit("") if item is None else item, rank if isinstance(rank, Column) else F.lit(rank), url, F.col("id") if name is None else name, F.lit(None) if poster is None else poster, F.lit(ext))
    return F.struct(*[v.alias(f"c{i}") for i, v in enumerate(values)]).cast(OFFER)


def _json_after(marker: str) -> Column:
    """The page from the first brace behind a marker; what follows the value there is not read."""
    return F.regexp_extract("html", rf"(?s){marker}[^{{]*+(\{{.*)", 1)


def _pin(site: str, x: Column) -> Column:
    hosts = FILES[site]
    return U.pinned(x, *((hosts,) if isinstance(hosts, str) else hosts))


def _patreon() -> Column:
    """Renditions of a post's images; the name of a size holds its width and height, or says that it is the original."""
    found = F.regexp_extract_all("html", F.concat(F.lit(r"(?i)https://[a-z0-9]+\.patreonusercontent\.com/\d+/patreon-media/p/post/"), F.col("id"), F.lit(PATREON_FILE)), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, "(?i)/patreon-media/p/post/[0-9]+" + PATREON_FILE, k)
    plain = lambda x: U.let(U.decode(part(x, 2)), lambda s: F.when(s.rlike(BASE64), F.unbase64(s).cast("string")))
    number = lambda j, k: F.coalesce(F.get_json_object(j, f"$.{k}").try_cast("double"), F.lit(0.0))
    rank = lambda x: U.let(plain(x), lambda j: F.when(F.get_json_object(j, "$.a").isNotNull() & j.rlike(r'"a"\s*:\s*-?[0-9]'), 1e15).otherwise(F.greatest(number(j, "w"), number(j, "h"))))
    item = lambda x: F.concat_ws("/", part(x, 1), part(x, 3))
    return F.transform(found, lambda x, k: _offer(k, x, rank(x), item(x), F.concat("id", F.lit(" "), item(x))))


def _fapello() -> Column:
    """The one item of the page's centred block, at its own size."""
    at = F.call_function("regexp_instr", F.col("html"), F.lit(r'(?i)class="[^"]*\buk-align-center\b'))
    block = F.when(at > 0, F.substring("html", at, F.lit(4000)))
    source, plain = F.regexp_extract(block, r'(?i)<source\b[^>]*\bsrc="([^"]+)"', 1), F.regexp_extract(block, r'(?i)\bsrc="([^"]+)"', 1)
    url = F.regexp_replace(F.coalesce(F.nullif(source, F.lit("")), F.nullif(plain, F.lit(""))), r"(?i)\.(?:md|th)(\.[a-z0-9]{1,5})(?=$|[?#])", "$1")
    video = block.rlike(r'(?i)type="video"|<video\b') | url.rlike(R.VIDEO)
    poster, name = F.nullif(F.regexp_extract(block, r'(?i)\bposter="([^"]+)"', 1), F.lit("")), F.replace(F.col("id"), F.lit("/"), F.lit(" "))
    one = _offer(F.lit(0), url, name=name, poster=F.when(video, poster))
    return F.when(url.isNotNull(), F.array(one.withField("ext", F.when(video, F.coalesce(U.extension(url), F.lit("mp4"))))))


def _imgur() -> Column:
    """The media of a post, given as JSON or as a string that holds it. An id that is no text counts as its text."""
    text = F.regexp_extract("html", r'(?s)window\.postDataJSON\s*=\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")', 1)
    text = F.when(text != "", F.get_json_object(F.concat(F.lit('{"a":'), text, F.lit("}")), "$.a")).otherwise(F.regexp_extract("html", r"(?s)window\.postDataJSON\s*=\s*(\{.*)", 1))
    media = F.from_json(text, "struct<media:array<struct<id:string,url:string>>>")["media"]
    return F.transform(media, lambda m, k: _offer(k, F.when(U.host(m["url"]) == FILES["imgur"], _pin("imgur", m["url"])), item=m["url"], name=F.coalesce(F.nullif(m["id"], F.lit("")), k.cast("string"))))


def _xhamster() -> Column:
    """A video's files by quality."""
    sources = F.from_json(_json_after(r"window\.initials\s*=\s*"), XHAMSTER)["videoModel"]["sources"]
    none = F.array().cast("array<struct<url:string,quality:string>>")
    named = F.transform(F.map_entries(sources["mp4"]), lambda e: F.struct(e["value"].alias("url"), e["key"].alias("quality")))
    both = F.concat(F.coalesce(named, none), F.coalesce(sources["standard"]["h264"], none))
    height = lambda q: F.coalesce(F.regexp_replace(q, r"\D", "").try_cast("double"), F.lit(0.0))
    return F.transform(both, lambda s, k: _offer(k, _pin("xhamster", s["url"]), height(s["quality"]), ext="mp4"))


def _pornhub() -> Column:
    """A video's streams; that of all qualities is the best."""
    model = F.from_json(_json_after(r"flashvars_[0-9]+\s*=\s*"), PORNHUB)
    plays = lambda d: (F.lower(d["format"]) == "hls") & F.coalesce(d["remote"], F.lit("")).isin("", "0", "false") & d["videoUrl"].rlike(r"(?i)\.m3u8(?:[?#]|$)")
    poster = _pin("pornhub", model["image_url"])
    return F.transform(model["mediaDefinitions"], lambda d, k: _offer(k, F.when(plays(d), _pin("pornhub", d["videoUrl"])), d["quality"].startswith("[").cast("double"), poster=poster, ext="m3u8"))


def _okru() -> Column:
    """The files of the page's players: the first player with one counts, there the best quality."""
    attrs = F.regexp_extract_all("html", F.lit(r"""\bdata-options\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1))
    plain = lambda x: _unescaped(F.regexp_replace(x, r"""^["']|["']$""", ""))
    videos = lambda x: F.from_json(F.get_json_object(plain(x), "$.flashvars.metadata"), "struct<videos:array<struct<name:string,url:string>>>")["videos"]
    quality = lambda n: F.array_position(F.array(*[F.lit(q) for q in QUALITIES]), F.lower(n))
    player = lambda x, p: F.transform(F.coalesce(videos(x), F.array().cast("array<struct<name:string,url:string>>")), lambda v, k: _offer(k, _pin("okru", v["url"]), F.coalesce(quality(v["name"]), F.lit(0)) - p * 100, ext="mp4"))
    return F.flatten(F.transform(attrs, player))


def _unescaped(x: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


SITES = {"patreon": _patreon, "fapello": _fapello, "imgur": _imgur, "xhamster": _xhamster, "pornhub": _pornhub, "okru": _okru}


def reads(url: Column) -> Column:
    """Whether a reader of a site reads pages of this address."""
    h, p = U.host(url), U.path(url)
    own = [h.rlike(pattern) & (p.rlike(PATHS[name]) | (F.lit(name) == "pornhub")) for name, pattern in HOSTS.items()]
    return reduce(lambda a, b: a | b, own + [h.rlike(r[1]) & p.rlike(r[2]) for r in R.RULES])


def offered_media(pages: DataFrame) -> DataFrame:
    """(page_id, site, id, idx, kind, url, ext, media_key, poster) of pages (page_id, url, html) of the sites above.

    Pages of other sites, null html or url, malformed JSON and files off a site's own hosts give none; idx numbers a page's items in order.
    Rows that repeat a page_id count as one page.
    """
    h, p = U.host(F.col("url")), U.path(F.col("url"))
    site = F.coalesce(*[F.when(h.rlike(pattern), F.lit(name)) for name, pattern in HOSTS.items()])
    rows = pages.where("html is not null").select("page_id", "html", "url", site.alias("site"), p.alias("path")).where("site is not null")
    ids = F.lit(None).cast("string")
    for name, pattern in PATHS.items():
        ids = F.when(F.col("site") == name, F.regexp_extract("path", pattern, 1)).otherwise(ids)
    view = U.param(F.col("url"), "viewkey")
    ids = F.when((F.col("site") == "pornhub") & view.rlike("^(?i:[a-z0-9]+)$"), view).otherwise(ids)
    rows = rows.withColumn("id", ids).where("id <> ''")
    offers = F.lit(None).cast(f"array<{OFFER}>")
    for name, listed in SITES.items():
        offers = F.when(F.col("site") == name, listed()).otherwise(offers)
    each = rows.select("page_id", "site", "id", F.explode(offers).alias("o")).select("page_id", "site", "id", "o.*").where("url is not null")
    best = F.max_by(F.struct("url", "name", "poster", "ext"), F.struct("rank", -F.col("ord"))).alias("b")
    each = each.groupBy("page_id", "site", "id", "item").agg(best, F.min("ord").alias("ord")).select("page_id", "site", "id", "ord", "b.*")
    ext = F.coalesce("ext", U.image_extension(F.col("url")), F.when(F.col("url").rlike(R.VIDEO) & (F.col("site") != "patreon"), U.extension(F.col("url"))))
    each = each.withColumn("ext", ext).where("ext is not null")
    kind = F.when(F.col("ext") == "gif", "gif").when(F.col("ext").isin(*U.IMAGE_EXTENSIONS), "image").otherwise("video")
    idx = F.row_number().over(W.partitionBy("page_id").orderBy("ord")) - 1
    return each.select("page_id", "site", "id", idx.alias("idx"), kind.alias("kind"), "url", "ext", F.concat_ws(" ", "site", "name").alias("media_key"), "poster")


def site_media(pages: DataFrame) -> DataFrame:
    """What the readers of all known sites find: offered_media, and page_media without posters."""
    return offered_media(pages).unionByName(R.page_media(pages), allowMissingColumns=True)
