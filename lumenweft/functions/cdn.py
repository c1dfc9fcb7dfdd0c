"""The CDN upgrade rules: a rendition's URL to the original's. One table, the first rule that matches is applied.

A rule has what the host, the path and the query must match (patterns; None: anything) and steps:
  ("drop", names) parameters go; ("clear",) the query goes; ("set", name, value) a parameter is set;
  ("sub", pattern, replacement) the path is rewritten; ("host", pattern, replacement) the host is;
  ("call", name) a value is computed, see COMPUTED.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as SF

from lumenweft.functions import url as U
from lumenweft.functions.text import F, as_text, column

RESIZE = ("w", "h", "fit", "resize", "quality", "q", "dpr", "crop")

# Hosts, paths and parameters of the CDNs, in order of priority.
RULES: list[tuple[str | None, str | None, str | None, list[tuple]]] = [
    (r"^pbs\.twimg\.com$", None, r"(?:^|&)name(?:=|&|$)", [("set", "name", "orig")]),
    (r"(?:^|\.)userapi\.com$", r"(?i)/s/v\d+/ig\d+/", r"(?:^|&)cs(?:=|&|$)", [("drop", ("cs",))]),
    (r"(?:^|\.)wp\.com$|\.files\.wordpress\.com$", None, None, [("drop", RESIZE), ("sub", r"(?i)-scaled(?=\.[a-z0-9]+$)", "")]),
    ("=shopify", None, None, [("sub", r"(?i)_(?:\d{1,5}x\d{1,5}|\d{1,5}x|x\d{1,5})(?:@\dx)?(?=\.[a-z0-9]+$)", ""), ("drop", ("width", "height", "crop", "pad_color"))]),
    (r"(?:^|\.)(?:images|plus)\.unsplash\.com$|\.imgix\.net$|^images\.rawpixel\.com$", None, None, [("drop", RESIZE)]),
    (r"^cdn\.sanity\.io$", None, None, [("drop", (*RESIZE, "fm", "auto", "rect", "flip", "or", "sat", "bg"))]),
    (r"^images\.ctfassets\.net$", None, None, [("drop", (*RESIZE, "fm", "f", "r", "bg"))]),
    (r"(?:^|\.)sirv\.com$", None, None, [("drop", (*RESIZE, "scale.width", "scale.height", "format", "colorspace"))]),
    (r"(?:^|\.)storyblok\.com$", r"/m/", None, [("sub", r"(?i)/m/.*$", "")]),
    (r"^ucarecdn\.com$", r"/-/", None, [("sub", r"(?i)/-/.*$", "/")]),
    (r"^ik\.imagekit\.io$", None, r"^(?!(?:.*&)?ik-s(?:=|&|$))", [("drop", ("tr",)), ("sub", r"(?i)/tr:[^/]+/", "/")]),
    (r"^images\.metmuseum\.org$", None, None, [("sub", r"/web-large/", "/original/")]),
    (r"^images-assets\.nasa\.gov$", None, None, [("sub", r"(?i)~(?:thumb|small|medium)(?=\.[a-z0-9]+$)", "~orig")]),
    (r"^i\.natgeofe\.com$", None, None, [("drop", ("w", "h"))]),
    (r"^static\.nike\.com$", r"^/a/images/", None, [("call", "nike")]),
    (r"(?:^|\.)assets\.adidas\.com$", None, None, [("call", "width_1920")]),
    (r"^cdn-icons-png\.flaticon\.com$", None, None, [("call", "folder_512")]),
    (r"^cdni\.pornpics\.com$", None, None, [("call", "folder_1280")]),
    (r"^c\.pxhere\.com$", r"^/photos/", None, [("sub", r"(?i)(\.(?:jpe?g|png|gif))(?:![a-z0-9]+)?$", "$1!d")]),
    (r"^images\d+\.alphacoders\.com$", None, None, [("sub", r"(?i)/thumb-\d+-(\d+\.(?:jpe?g|png|webp))$", "/$1")]),
    (r"^c\d+\.wallpaperflare\.com$", None, None, [("sub", r"(?i)-thumbnail(\.(?:jpe?g|png|webp))$", "$1")]),
    (r"^ic\.pics\.livejournal\.com$", None, None, [("sub", r"(?i)(/\d+_)[^/]+(\.(?:jpe?g|png|gif|webp|bmp))$", "$1original$2")]),
    (r"^res\.cloudinary\.com$", None, None, [("call", "cloudinary")]),
    (None, r"(?i)/thumb/.*/[^/]*px-[^/]+$", None, [("sub", r"/thumb/", "/"), ("sub", r"(?i)/[^/]*px-[^/]+$", "")]),
    ("=iiif", None, None, [("call", "iiif")]),
    (r"(?:^|\.)(?:googleusercontent|ggpht)\.com$", None, None, [("sub", r"(?i)=(?:[swh]\d+|[a-z]\d+)(?:-[a-z0-9]+)*$", "=s0")]),
    (r"^i\.pinimg\.com$", None, None, [("sub", r"^/\d+x(?:\d+)?(?:_RS)?/", "/originals/")]),
    (r"^(?:i\.ytimg|img\.youtube)\.com$", None, None, [("sub", r"(?i)(/vi/[^/]+/)(?:default|mqdefault|[0-3])\.jpg$", "$1hqdefault.jpg")]),
    (r"(?:^|\.)(?:media-amazon|ssl-images-amazon)\.com$", None, None, [("sub", r"(?i)\._[^.]*_(?=\.[a-z0-9]+$)", "")]),
    (r"^image\.civitai\.com$", None, None, [("sub", r"^(.*/)(?![^/]*(?<![^,/])original=)[^/]*=[^/]*(/[^/]*)$", "$1original=true$2")]),
    (r"^miro\.medium\.com$", None, None, [("sub", r"/v2/(?:(?:resize|fit|format|max|frame|crop)[^/]*/)*", "/")]),
    (r"^images\.pexels\.com$", None, None, [("clear",)]),
    (r"^cdn\.pixabay\.com$", None, None, [("sub", r"(?i)_\d{2,4}(?=\.[a-z0-9]+$)", "_1280")]),
    (r"(?:^|\.)staticflickr\.com$", None, None, [("sub", r"(?i)_[sqtmnwzc](?=\.[a-z0-9]+$)", "_b")]),
    (r"^ichef\.bbci\.co\.uk$", None, None, [("sub", r"/(news|standard)/\d{2,4}/", "/$1/2048/")]),
    (r"^i\.etsystatic\.com$", None, None, [("sub", r"(?i)il_\d+x(?:\d+|N)", "il_fullxfull")]),
    (r"^i\.ebayimg\.com$", None, None, [("sub", r"(?i)s-l\d+(?=\.[a-z0-9]+$)", "s-l1600")]),
    (r"^platform\.theverge\.com$", r"/wp-content/uploads/", None, [("drop", (*RESIZE, "strip", "ssl"))]),
    (r"(?:^|\.)scene7\.com$", None, None, [("drop", ("hei", "qlt", "fmt", "resMode", "op_usm", "fit")), ("set", "wid", "2000")]),
    (r"^cdn[a-z]\.artstation\.com$", None, None, [("sub", r"/(?:micro_square|smaller_square|small_square|small|medium)/", "/large/")]),
    (r"^static01\.nyt\.com$", None, None, [("sub", r"(?i)-(?:articleLarge|articleInline|mediumThreeByTwo\d+)(\.[a-z0-9]+)$", "-superJumbo$1"), ("clear",)]),
    (r"^i\.imgur\.com$", None, None, [("sub", r"(?i)\.gifv$", ".mp4"), ("sub", r"^/([A-Za-z0-9]{7})[sbtmlhrg](\.[a-z0-9]+)$", "/$1$2")]),
    (r"(?:^|\.)(?:alicdn|aliexpress-media)\.com$", None, None, [("sub", r"(?i)(\.(?:jpe?g|png|webp|gif))_.*$", "$1")]),
    (r"^cdn\.dribbble\.com$", None, None, [("clear",)]),
    (r"(?:^|\.)walmartimages\.com$", None, None, [("clear",)]),
    (r"^art\.ngfiles\.com$", None, None, [("clear",)]),
    (r"(?:^|\.)wixmp\.com$", r"/v1/(?:fit|fill)/", None, [("call", "wixmp")]),
    (r"^photos\.zillowstatic\.com$", None, None, [("sub", r"(?i)-[a-z0-9_]+\.(?:webp|jpe?g|png)$", "-uncropped_scaled_within_1536_1152.webp"), ("clear",)]),
    (r"^cdn\.stocksnap\.io$", r"/img-thumbs/", None, [("sub", r"/img-thumbs/[^/]+/", "/img-thumbs/960w/")]),
    (r"^www\.ikea\.com$", r"^/images/", None, [("clear",), ("set", "imwidth", "2000")]),
    (r"^c1\.neweggimages\.com$", None, None, [("sub", r"/((?:nobgproduct|productimage)compressall)\d+/", "/$1\\1280/")]),
    (r"^img\.kwcdn\.com$", None, r"(?i)imageView2", [("clear",)]),
    (r"^images\.squarespace-cdn\.com$", None, None, [("set", "format", "2500w")]),
    (r"^static\.wixstatic\.com$", r"/media/[^/]+/v1/", None, [("sub", r"(?i)(/media/[^/]+)/v1/.*$", "$1")]),
    (r"^cdn\.bsky\.app$", r"/feed_thumbnail/", None, [("sub", r"/feed_thumbnail/", "/feed_fullsize/")]),
    (r"^f4\.bcbits\.com$", r"(?i)/img/a\d+_\d+\.[a-z0-9]+$", None, [("sub", r"(?i)(/img/a\d+)_\d+(\.[a-z0-9]+)$", "$1_0$2")]),
    (r"^media\d*\.giphy\.com$", r"^/media/", None, [("sub", r"(?i)/[^/]+\.gif$", "/giphy.gif")]),
    (r"^media\d*\.tenor\.com$", None, None, [("sub", r"(?i)/([A-Za-z0-9_-]{11})[A-Za-z0-9]{5}(/[^/]+\.gif)$", "/$1AAAAC$2")]),
    (r"^burst\.shopifycdn\.com$", r"^/photos/", None, [("clear",)]),
    (r"^images\.steamusercontent\.com$", r"^/ugc/", None, [("drop", ("imw", "imh", "ima", "impolicy", "imcolor", "letterbox", "cache"))]),
    (r"^uploads\d*\.wikiart\.org$", None, None, [("sub", r"(?i)!\w+\.[a-z0-9]+$", "")]),
    (r"(?:^|\.)ib\.metapix\.net$", None, None, [("sub", r"(?i)^/files/(?:screen|preview)/", "/files/full/")]),
    (r"(?:^|\.)itaku\.ee$", r"(?i)/([^/]+)/\1_(?:sm|md|lg|xl)\.[a-z0-9]+$", None, [("sub", r"(?i)/([^/]+)/\1_(?:sm|md|lg|xl)(\.[a-z0-9]+)$", "/$1$2")]),
    (r"^wallpapercave\.com$", r"^/w\d+/", None, [("sub", r"^/w\d+/", "/wp/")]),
    (r"^wallpapers\.com$", r"^/images/(?:thumbnail|high)/", None, [("sub", r"^/images/(?:thumbnail|high)/", "/images/hd/")]),
    (r"^wallpaperaccess\.com$", r"(?i)^/thumb/[\w-]+\.[a-z0-9]+$", None, [("sub", r"^/thumb/", "/full/")]),
    (r"^upload\.wikimedia\.org$", r"/thumb/", None, [("sub", r"^(/wikipedia/[^/]+)/thumb/(.+)/[^/]+$", "$1/$2")]),
    (r"^(?:ww|wx)[1-4]\.sinaimg\.cn$", None, None, [("sub", r"(?i)^/(?!large/|woriginal/)[^/]+/([^/]+\.[a-z0-9]+)$", "/large/$1")]),
    (r"^i[0-9]\.hdslb\.com$|(?:^|\.)biliimg\.com$", None, None, [("sub", r"@.*$", "")]),
    (r"^thumbs\d+\.imgbox\.com$", r"(?i)_t\.[a-z0-9]+$", None, [("host", r"^thumbs(\d+)\.", "images$1."), ("sub", r"(?i)_t(\.[a-z0-9]+)$", "_o$1")]),
    (r"^avatars\.mds\.yandex\.net$", r"^/get-[^/]+/[^/]+/[^/]+/[^/]+", None, [("sub", r"/[^/]+$", "/orig")]),
    (r"^static\.toiimg\.com$", r"\bmsid-\d+|/photo/\d+\.cms", None, [("sub", r"^.*?(?:msid-(\d+)|/photo/(\d+)\.cms).*$", "/thumb/msid-$1$2,width-20000,resizemode-4/$1$2.jpg")]),
    (r"^cdn\.dsmcdn\.com$", r"/mnresize/\d+/\d+/", None, [("sub", r"/mnresize/\d+/\d+/", "/")]),
    (r"^img\.youm7\.com$", r"(?i)^/(?:small|medium)/", None, [("sub", r"(?i)^/(?:small|medium)/", "/large/")]),
    (r"^s\d+(?:-[a-z0-9]+)?\.glbimg\.com$", r"/\d+x\d+/", None, [("sub", r"/\d+x\d+/", "/0x0/")]),
    (r"^i\.ibb\.co$", r"(?i)\.(?:md|th)\.[a-z0-9]+$", None, [("sub", r"(?i)\.(?:md|th)(\.[a-z0-9]+)$", "$1")]),
    (r"^im\.vsco\.co$", None, None, [("drop", RESIZE)]),
    (r"^images\.saatchiart\.com$", r"(?i)-\d+\.jpe?g$", None, [("sub", r"(?i)-\d+(\.jpe?g)$", "-8$1")]),
    (r"^s?webtoon-phinf\.pstatic\.net$", None, None, [("drop", ("type",))]),
    (None, r"(?i)/m/_v2/.*_thumb\.[a-z0-9]+$", None, [("sub", r"(?i)_thumb(\.[a-z0-9]+)$", "$1")]),
    (None, r"/pictrs/image/", r"(?:^|&)(?:thumbnail|format)(?:=|&|$)", [("drop", ("thumbnail", "format"))]),
    (r"\.img\.susercontent\.com$", r"(?i)/file/[a-z0-9-]+(?:_tn|@resize_[^/?]+)$", None, [("sub", r"(?i)(?:_tn|@resize_[^/?]+)$", "")]),
    (r"(?:^|\.)mlstatic\.com$", r"(?i)-(?:OO|O|V|W|AB|F)\.(?:webp|jpg)$", None, [("sub", r"(?i)-(?:OO|O|V|W|AB|F)\.(?:webp|jpg)$", "-F.jpg")]),
    (r"^images\.tokopedia\.net$", r"/img/cache/[^/]+/", None, [("sub", r"/img/cache/[^/]+/", "/img/")]),
    (r"^productimages\.hepsiburada\.net$", r"(?i)/s/\d+/[^/]+/[^/]+\.[a-z0-9]+$", None, [("sub", r"(/s/\d+/)[^/]+(/)", "$1\\2000$2")]),
    (r"^img\.leboncoin\.fr$", None, r"(?:^|&)rule(?:=|&|$)", [("set", "rule", "ad-large")]),
    (r"^images\.meesho\.com$", None, r"(?:^|&)width(?:=|&|$)", [("set", "width", "2000")]),
    (r"^imgproxy\.domestika\.org$", r"^/unsafe/.+?/plain/", None, [("sub", r"^/unsafe/.+?/plain/", "/unsafe/plain/")]),
    (r"^i\d+\.shbdn\.com$", r"/photos/\d+/\d+/\d+/", None, [("sub", r"(/photos/\d+/\d+/\d+/)(?:thmb_|x\d+_)?", "$1x5_")]),
    (r"^img\.wattpad\.com$", r"(?i)/cover/\d+-\d+-k\w+\.jpg$", None, [("sub", r"(?i)(/cover/\d+)-\d+(-k\w+\.jpg)$", "$1-512$2")]),
    (r"^(?:postfiles|mblogthumb-phinf)\.pstatic\.net$", None, r"(?:^|&)type=w\d+(?:&|$)", [("set", "type", "w3840")]),
    (r"^imglf\d+\.lf127\.net$", None, r".", [("clear",)]),
    (r"^image\.nostr\.build$", r"/(?:thumb|resp/[^/]+)/", None, [("sub", r"/(?:thumb|resp/[^/]+)/", "/")]),
    (r"^news24cobalt\.24\.co\.za$", r"^/resources/[^/]+/format/[a-zA-Z0-9]+/", None, [("sub", r"/format/[a-zA-Z0-9]+/", "/")]),
    (None, r"/wp-content/uploads/", None, [("drop", (*RESIZE, "strip", "ssl")), ("sub", r"(?i)-\d{1,5}x\d{1,5}(?=\.[a-z0-9]+$)", ""), ("sub", r"(?i)-scaled(?=\.[a-z0-9]+$)", "")]),
]

IIIF = r"(?i)/(full|square|\d+,\d+,\d+,\d+|pct:[\d.]+,[\d.]+,[\d.]+,[\d.]+)/(full|max|pct:\d+(?:\.\d+)?|!?(?:\d+,\d*|,\d+))/(!?\d+(?:\.\d+)?)/(default|color|gray|bitonal)\.(jpe?g|tiff?|png|gif|jp2|pdf|webp)$"


def _folder(p: Column, least: int) -> Column:
    n = F.regexp_extract(p, r"^/(\d+)/", 1)
    return F.when((n != "") & (n.cast("bigint") < least), F.regexp_replace(p, r"^/\d+/", f"/{least}/")).otherwise(p)


def _cloudinary(p: Column, url: Column) -> Column:
    segs = F.split(F.regexp_extract(p, r"/upload/((?:[^/]+/)+)", 1), "/")
    segs = F.filter(segs, lambda s: s != "")
    start = F.struct(F.lit(True).alias("leading"), F.lit(0).alias("n"))
    lead = F.aggregate(
        segs, start, lambda acc, s: F.struct((acc["leading"] & U.cloudinary_transform(s)).alias("leading"), (acc["n"] + F.when(acc["leading"] & U.cloudinary_transform(s), 1).otherwise(0)).alias("n")), lambda acc: acc["n"]
    )
    kept = F.array_join(F.transform(F.slice(segs, lead + 1, F.greatest(F.size(segs) - lead, F.lit(0))), lambda s: F.concat(s, F.lit("/"))), "")
    at = F.instr(p, "/upload/")
    tail = F.regexp_extract(p, r"/upload/(?:[^/]+/)+([^/]*)$", 1)
    return F.when((at > 0) & (lead > 0), F.concat(F.substring(p, F.lit(1), at - 1), F.lit("/upload/"), kept, tail)).otherwise(p)


def _wixmp(p: Column, url: Column) -> Column:
    payload = F.get(F.split(F.coalesce(U.param(url, "token"), F.lit("")), r"\."), F.lit(1))
    b64 = F.translate(payload, "-_", "+/")
    text = F.try_to_binary(F.rpad(b64, F.length(b64) + F.pmod(-F.length(b64), F.lit(4)), "="), F.lit("base64")).cast("string")
    cap = lambda k: F.regexp_replace(F.get_json_object(text, f"$[0][0].{k}"), r"\D", "").cast("bigint")
    w, h = cap("width"), cap("height")
    target = F.concat(F.lit("/v1/fill/w_"), w.cast("string"), F.lit(",h_"), h.cast("string"), F.lit(",q_100,strp/"), F.regexp_extract(p, r"/v1/(?:fit|fill)/[^/]+/([^/]+)$", 1))
    fits = p.rlike(r"/v1/(?:fit|fill)/[^/]+/[^/]+$") & (w > 0) & (h > 0)
    return F.when(fits, F.concat(F.regexp_replace(p, r"/v1/(?:fit|fill)/[^/]+/[^/]+$", ""), target)).otherwise(p)


def _nike(p: Column, url: Column) -> Column:
    seg = F.regexp_extract(p, r"/a/images/([^/]+)/", 1)
    return F.when((seg != "") & U.cloudinary_transform(seg), F.regexp_replace(p, r"^/a/images/[^/]+/", "/a/images/w_2000,c_limit,f_auto/")).otherwise(p)


def _iiif(p: Column, url: Column) -> Column:
    size = F.regexp_extract(p, IIIF, 2)
    return F.when(~F.lower(size).isin("full", "max"), F.regexp_replace(p, IIIF, "/$1/full/$3/$4.$5")).otherwise(p)


COMPUTED = {
    "nike": _nike,
    # numbers below 1920: one to three digits, or four that begin with 0, with 1 and then less than 9, or with 190 or 191
    "width_1920": lambda p, url: F.regexp_replace(p, r"(?i)(^|[/,])w_0*(?:\d{1,3}|1[0-8]\d\d|19[01]\d)(?=[,/])", "$1w_1920"),
    "folder_512": lambda p, url: _folder(p, 512),
    "folder_1280": lambda p, url: _folder(p, 1280),
    "cloudinary": _cloudinary,
    "iiif": _iiif,
    "wixmp": _wixmp,
}
WHERE = {
    "=shopify": lambda h, p: (h == "cdn.shopify.com") | F.contains(p, F.lit("/cdn/shop/")),
    "=iiif": lambda h, p: p.rlike(IIIF),
}


def matches(rule: tuple, h: Column, p: Column, q: Column) -> Column:
    where, on_path, on_query, _ = rule
    tests = []
    if where is not None:
        tests.append(WHERE[where](h, p) if where in WHERE else h.rlike(where))
    if on_path is not None:
        tests.append(p.rlike(on_path))
    if on_query is not None:
        tests.append(q.rlike(on_query))
    return reduce(lambda a, b: a & b, tests)


def _ends(where: str) -> set[str] | None:
    """The last two labels of every host that a host pattern can match; None if they do not follow from it."""
    plain = where.replace(r"(?:^|\.)", "").replace("^", "")
    depth, parts = 0, [""]
    for c in plain:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    out = set()
    for part in parts:
        for m in [re.search(r"\(\?:([^()]*)\)", part)]:
            for word in m[1].split("|") if m else [""]:
                end = re.search(r"([a-z0-9-]+)\\\.([a-z]+)\$$", part[: m.start()] + word + part[m.end() :] if m else part)
                if end is None:
                    return None
                out.add(f"{end[1]}.{end[2]}")
    return out


RULE = "struct<rule:int,host:string,path:string,query:string>"
#: Where a session keeps the rules that it added: a setting of its own, so that other sessions do not have them.
SETTING = "lumenweft.cdn.rules"
Rule = tuple[str | None, str | None, str | None, list[tuple]]


def _own(spark: SparkSession) -> list[dict]:
    return json.loads(spark.conf.get(SETTING, "[]"))


def session_rules(spark: SparkSession) -> dict[int, Rule]:
    """Number -> rule, in this session. Those that it added have numbers below zero, in order of priority and then of time."""
    own = sorted(_own(spark), key=lambda r: r["priority"])
    added = {i - len(own): (r["host"], r["path"], r["query"], [tuple(tuple(x) if isinstance(x, list) else x for x in s) for s in r["steps"]]) for i, r in enumerate(own)}
    return added | dict(enumerate(RULES))


def register_rule(spark: SparkSession, name: str, host: str | None = None, path: str | None = None, query: str | None = None, steps: list[tuple] = (), priority: int = 0) -> None:
    """Adds a rule to this session, before the built-in ones; of several that match, the one of the lowest priority is applied.

    An error: a name that is taken, a rule of that priority with the same tests, no test at all, no steps, steps that need
    code of their own, patterns that do not compile.
    """
    own = _own(spark)
    if any(r["name"] == name for r in own):
        raise ValueError(f"there is a rule {name} already")
    if any((r["host"], r["path"], r["query"], r["priority"]) == (host, path, query, priority) for r in own):
        raise ValueError("there is a rule of this priority with the same tests")
    if not any((host, path, query)) or not steps or any(s[0] not in ("drop", "clear", "set", "sub", "host") for s in steps):
        raise ValueError("a rule has a test, and steps of drop, clear, set, sub and host")
    for pattern in (host, path, query, *[s[1] for s in steps if s[0] in ("sub", "host")]):
        if pattern is not None:
            try:
                re.compile(pattern)
            except re.error as e:
                raise ValueError(f"{pattern}: {e}") from e
    spark.conf.set(SETTING, json.dumps([*own, {"name": name, "host": host, "path": path, "query": query, "steps": list(steps), "priority": priority}]))


def unregister_rule(spark: SparkSession, name: str) -> None:
    """Takes a rule of this session back; nothing, if it has none of that name."""
    spark.conf.set(SETTING, json.dumps([r for r in _own(spark) if r["name"] != name]))


def by_end(rules: dict[int, Rule]) -> tuple[dict[str, list[int]], list[int]]:
    """The numbers of the rules that are tied to hosts, by the last two labels of these, and of all others."""
    tied: dict[str, list[int]] = {}
    anywhere = []
    for i, (where, *_) in rules.items():
        found = _ends(where) if where is not None and not where.startswith("=") else None
        for end in found or ():
            tied.setdefault(end, []).append(i)
        if not found:
            anywhere.append(i)
    return tied, anywhere


def tied_rules(spark: SparkSession, rules: dict[int, Rule], ends: dict[str, list[int]]) -> DataFrame:
    """end, tied: for the last two labels of a host, what the rules that are tied to such hosts ask for."""
    text = lambda x: x if x and not x.startswith("=") else ""
    return spark.createDataFrame([(end, [(i, *map(text, rules[i][:3])) for i in numbers]) for end, numbers in sorted(ends.items())], f"end string, tied array<{RULE}>")


def first_rule(h: Column, p: Column, q: Column, tied: Column, anywhere: dict[int, Rule]) -> Column:
    """The number of the first rule that matches, or null. tied: of tied_rules(), by the host's last two labels; anywhere: the others.

    They are few, so neither the plan nor the work on a URL grows with the number of rules.
    """
    fits = F.filter(tied, lambda r: F.regexp_like(h, r["host"]) & F.regexp_like(p, r["path"]) & F.regexp_like(q, r["query"]))
    return F.least(F.array_min(F.transform(fits, lambda r: r["rule"])), F.coalesce(*[F.when(matches(anywhere[i], h, p, q), F.lit(i)) for i in sorted(anywhere)]))


SCHEMA = "rule int, drop_names array<string>, clear boolean, set_name string, set_pair string, subs array<struct<pattern:string,first:boolean,replacement:string>>, host_pattern string, host_replacement string, call string"


def rows(rules: dict[int, Rule]) -> list[tuple]:
    """The rules' steps as rows of SCHEMA."""
    out = []
    for i, (*_, steps) in rules.items():
        by = {s[0]: s for s in steps}
        subs = []
        for s in steps:
            if s[0] == "sub":
                body = s[1].removeprefix("(?i)")
                tied = body.startswith("^") or body.endswith("$") or body.endswith("$)")
                subs.append((s[1], not tied, s[2]))
        host = by.get("host", (None, None, None))
        set_name, set_value = by.get("set", (None, None, None))[1:]
        out.append((i, list(by.get("drop", (None, ()))[1]), "clear" in by, set_name, None if set_name is None else f"{set_name}={set_value}", subs, host[1], host[2], by.get("call", (None, None))[1]))
    return out


def _subbed(p: Column, sub: Column) -> Column:
    """p with the pattern's first match replaced; a pattern tied to an end has one match anyway."""
    pattern, replacement = sub["pattern"], sub["replacement"]
    at = F.regexp_instr(p, pattern)
    flag = F.when(pattern.startswith("(?i)"), F.lit("(?i)")).otherwise("")
    head = F.concat(flag, F.lit("^(?:"), F.regexp_replace(pattern, r"^\(\?i\)", ""), F.lit(")"))
    one = F.when(at > 0, F.concat(F.substring(p, F.lit(1), at - 1), F.regexp_replace(F.substring(p, at, F.length(p)), head, replacement))).otherwise(p)
    return F.when(sub["first"], one).otherwise(F.regexp_replace(p, pattern, replacement))


def upgraded(df, url: str = "url", prefix: str = ""):
    """df plus original and thumbnail: the URL unwrapped and rewritten, and the URL as it was if that changed it.

    A broadcast join by the host's last two labels brings the few rules that may match, as patterns in columns; a second
    one (as many rows as rules) brings the steps of the first that does, so one expression serves all rules. A rewrite that leaves no path counts for
    nothing. What is no URL stays as it is.
    """
    c = {x: f"_{prefix}{x}" for x in ("start", "rule", "host", "path", "query", "step", "path2", "query2", "base2", "end", "tied")}
    spark = df.sparkSession
    rules = session_rules(spark)
    ends, anywhere = by_end(rules)
    col = lambda x: F.col(c[x])
    with as_text():
        start = F.coalesce(U.deproxy(F.col(url)), F.col(url))
        parts = {"host": U.host(col("start")), "path": U.path(col("start")), "query": U.query(col("start"))}
        first = first_rule(col("host"), col("path"), col("query"), col("tied"), {i: rules[i] for i in anywhere})
    out = df.withColumn(c["start"], column(start)).withColumns({c[k]: column(v) for k, v in parts.items()})
    tied = tied_rules(spark, rules, ends).withColumnsRenamed({"end": c["end"], "tied": c["tied"]})  # as many rows as ends of hosts
    out = out.withColumn(c["end"], SF.substring_index(SF.col(c["host"]), ".", -2)).join(SF.broadcast(tied), c["end"], "left").withColumn(c["rule"], column(first))
    table = spark.createDataFrame(rows(rules), SCHEMA)
    table = SF.broadcast(table.select(SF.col("rule").alias(c["rule"]), SF.struct(*[x for x in table.columns if x != "rule"]).alias(c["step"])))
    out = out.join(table, c["rule"], "left")
    step = lambda x: F.col(f"{c['step']}.{x}")
    name = lambda x: U.param_name(x)
    with as_text():
        computed = col("path")
        for call, f in COMPUTED.items():
            computed = F.when(step("call") == call, f(col("path"), col("start"))).otherwise(computed)
        subs = F.aggregate(F.coalesce(step("subs"), F.array().cast("array<struct<pattern:string,first:boolean,replacement:string>>")), computed, lambda acc, x: _subbed(acc, x))
        kept = F.array_join(F.filter(U.params(col("query")), lambda x: ~F.coalesce(F.array_contains(step("drop_names"), name(x)), F.lit(False))), "&")
        kept = F.when(F.coalesce(step("clear"), F.lit(False)), "").when(F.size(step("drop_names")) > 0, kept).otherwise(col("query"))
        has = lambda k: F.exists(U.params(k), lambda x: name(x) == step("set_name"))
        swapped = lambda k: F.array_join(F.transform(U.params(k), lambda x: F.when(name(x) == step("set_name"), step("set_pair")).otherwise(x)), "&")
        query = U.let(kept, lambda k: F.when(step("set_name").isNull(), k).when(has(k), swapped(k)).otherwise(F.concat_ws("&", F.when(k != "", k), step("set_pair"))))
        base = U.origin(col("start"))
        base = F.when(step("host_pattern").isNotNull(), F.replace(base, col("host"), F.regexp_replace(col("host"), step("host_pattern"), step("host_replacement")))).otherwise(base)
        fine = U.valid(col("start")) & (F.regexp_replace(col("path2"), "/", "") != "")
        done = F.when(fine, F.when(col("rule").isNull(), col("start")).otherwise(U.assemble(col("base2"), col("path2"), col("query2")))).otherwise(F.col(url))
        changed = F.when(F.col(f"{prefix}original") != F.col(url), F.col(url))
    out = out.withColumns({c["path2"]: column(subs), c["query2"]: column(query), c["base2"]: column(base)})
    return out.withColumn(f"{prefix}original", column(done)).withColumn(f"{prefix}thumbnail", column(changed)).drop(*c.values())
