"""URL functions as Columns: parts, types, sizes, identity. No UDF; the larger ones are written out as SQL (see text).

A URL here is what a browser would accept as absolute http(s), parsed by one pattern. Host names are lower-cased, user
info and default ports go, blanks in the path are escaped. Dot segments are left as they stand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column

from lumenweft.functions.text import F, compiled

ABSOLUTE = r"^(?i:(https?)://)(?:[^/?#@]*@)?([^/?#:@\s]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

# Vocabularies and parameter names that results depend on.
IMAGE_TYPES = ("jpeg", "png", "gif", "webp", "svg", "avif", "bmp", "ico")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "jfif", "png", "gif", "webp", "svg", "avif", "bmp", "ico")
VIDEO_TYPES = {"mp4": "mp4", "m4v": "m4v", "webm": "webm", "ogv": "ogg", "ogg": "ogg", "mov": "mov", "qt": "mov"}
AUDIO_TYPES = {"mp3": "mp3", "wav": "wav", "wave": "wav", "ogg": "ogg", "oga": "oga", "m4a": "m4a", "aac": "aac", "flac": "flac", "opus": "opus", "weba": "weba"}
MIME_TYPES = {"mpeg": "mp3", "x-m4a": "m4a", "quicktime": "mov", "x-wav": "wav", "x-matroska": "webm", "x-flac": "flac"}
MEDIA_FILE = r"(?i)\.(?:jpe?g|jfif|png|gif|webp|avif|bmp|ico|svg|mp4|m4v|webm|ogv|mov|mp3|wav|ogg|oga|m4a|aac|flac|opus)(?:$|[?#])"
MEDIA_FORMATS = (*IMAGE_EXTENSIONS, "mp4", "m4v", "webm", "ogv", "ogg", "mov", "mp3", "wav", "oga", "m4a", "aac", "flac", "opus")
MEDIA_HOSTS = (
    "pbs.twimg.com", "cdn.shopify.com", "images.unsplash.com", "plus.unsplash.com", "i.pinimg.com", "i.ytimg.com", "img.youtube.com", "i.redd.it",
    "preview.redd.it", "miro.medium.com", "googleusercontent.com", "ggpht.com", "media-amazon.com", "ssl-images-amazon.com", "wp.com", "imgix.net", "cdn.bsky.app",
)
KEY_MEDIA_FILE = r"(?i)\.(?:jpe?g|png|gif|webp|avif|bmp|ico|svgz?|tiff?|hei[cf]|jfif|jxl|jp2|mp4|webm|mov|m4v|mkv|avi|m3u8|mpd|mp3|m4a|aac|ogg|ogv|opus|oga|wav|flac)$"
VOLATILE_PARAMS = (
    "cb", "cache", "nocache", "bust", "cachebust", "_", "t", "ts", "time", "timestamp", "v", "ver", "version", "rand", "random", "r", "sig", "signature", "token",
    "expires", "exp", "nonce",
)
TRANSFORM_PARAMS = ("w", "h", "width", "height", "s", "size", "q", "quality", "dpr", "fit", "resize", "scale", "zoom", "fm", "format", "auto")
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "co.jp", "or.jp", "ne.jp", "com.au", "net.au", "org.au", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "co.za")
PROXY_PARAMS = ("url", "u", "src", "image", "imgurl")
SIGNING_PARAMS = ("token", "sig", "signature", "expires", "policy", "key-pair-id")
CLOUDINARY_KEYS = "w h c q e g x y r o a b co dpr fl ar z l u t f d p cs vc bo br ac so eo du fps ki sp if pg vs dn dl".split()
EMOJI_PACK = "/(twemoji|openmoji|noto-emoji|emojione|joypixels|emoji-datasource)"
#: Host (a leading dot: also below it) and what the path, in lower case, must have.
EMOJI = (
    ("abs.twimg.com", "^/emoji/"), ("s.w.org", "^/images/core/emoji/"), ("twemoji.maxcdn.com", ""), ("cdn.jsdelivr.net", EMOJI_PACK), ("cdnjs.cloudflare.com", EMOJI_PACK),
    (".githubassets.com", "/images/icons/emoji/"), (".fbcdn.net", r"/emoji\.php|^/rsrc\.php/"), (".facebook.com", r"/emoji\.php|^/rsrc\.php/"), ("em-content.zobj.net", ""), ("emoji.slack-edge.com", ""),
    ("a.slack-edge.com", "emoji-assets"), ("cdn.discordapp.com", "^/emojis/"), ("static-cdn.jtvnw.net", "^/emoticons/"), ("fonts.gstatic.com", "^/s/e/notoemoji/"), ("cdn.joypixels.com", ""),
)
RESERVED_NAME = r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|$)"
MAX_NAME = 200


def let(x: Column, body) -> Column:
    """body(x) with x evaluated once: keeps expressions that use a value often from growing with every use."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def valid(url: Column) -> Column:
    return F.coalesce(url.rlike(ABSOLUTE), F.lit(False))


def host(url: Column) -> Column:
    """Host name in lower case; empty where the URL is none."""
    return F.when(valid(url), F.lower(F.regexp_extract(url, ABSOLUTE, 2))).otherwise("")


def path(url: Column) -> Column:
    p = F.regexp_extract(url, ABSOLUTE, 4)
    return F.when(valid(url), F.replace(F.when(p == "", "/").otherwise(p), F.lit(" "), F.lit("%20"))).otherwise("")


def query(url: Column) -> Column:
    return F.when(valid(url), F.regexp_extract(url, ABSOLUTE, 5)).otherwise("")


def origin(url: Column) -> Column:
    port = F.regexp_extract(url, ABSOLUTE, 3)
    scheme = F.lower(F.regexp_extract(url, ABSOLUTE, 1))
    odd = (port != "") & ~((scheme == "http") & (port == "80")) & ~((scheme == "https") & (port == "443"))
    return F.when(valid(url), F.concat(scheme, F.lit("://"), host(url), F.when(odd, F.concat(F.lit(":"), port)).otherwise("")))


def assemble(base: Column, p: Column, q: Column) -> Column:
    return F.concat(base, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def decode(x: Column) -> Column:
    """Percent-decoding in which + stays; text with broken escapes is left as it is."""
    return let(x, lambda v: F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v))


def decode_param(x: Column) -> Column:
    """A parameter's value: + is a blank."""
    return F.coalesce(F.try_url_decode(x), x)


def params(q: Column) -> Column:
    return F.filter(F.split(q, "&"), lambda x: x != "")


def param_name(pair: Column) -> Column:
    return decode_param(F.substring_index(pair, "=", 1))


def param_value(pair: Column) -> Column:
    return decode_param(F.when(F.contains(pair, F.lit("=")), F.substring(pair, F.instr(pair, "=") + 1, F.length(pair))).otherwise(""))


def param_of(q: Column, name: str) -> Column:
    """The first value of a parameter of a query string, or null."""
    return let(F.get(F.filter(params(q), lambda x: param_name(x) == name), F.lit(0)), lambda x: F.when(x.isNotNull(), param_value(x)))


def param(url: Column, name: str) -> Column:
    """The first value of a parameter, or null."""
    return param_of(query(url), name)


def parts(url: Column) -> Column:
    """struct<ok, origin, host, path, query> of a URL, as the functions of these names; the pattern is matched once for each group."""

    def named(ok: bool, *values: Column) -> Column:
        return F.struct(F.lit(ok).alias("ok"), *[v.alias(n) for n, v in zip(("origin", "host", "path", "query"), values, strict=True)])

    def read(g: Column) -> Column:
        scheme, h, port, p = (g[i] for i in range(4))
        odd = (port != "") & ~((scheme == "http") & (port == "80")) & ~((scheme == "https") & (port == "443"))
        base = F.concat(scheme, F.lit("://"), h, F.when(odd, F.concat(F.lit(":"), port)).otherwise(""))
        return named(True, base, h, F.replace(F.when(p == "", "/").otherwise(p), F.lit(" "), F.lit("%20")), g[4])

    def split(x: Column) -> Column:
        group = lambda i: F.regexp_extract(x, ABSOLUTE, i)
        groups = F.array(F.lower(group(1)), F.lower(group(2)), group(3), group(4), group(5))
        return F.when(valid(x), let(groups, read)).otherwise(named(False, F.lit(None).cast("string"), F.lit(""), F.lit(""), F.lit("")))

    return let(url, split)


def without_params(q: Column, names, fold: bool = False) -> Column:
    """A query string but for some parameters; the others keep their spelling and order."""
    name = lambda x: F.lower(param_name(x)) if fold else param_name(x)
    return F.array_join(F.filter(params(q), lambda x: ~name(x).isin(*names)), "&")


def with_param(q: Column, name: str, value: str) -> Column:
    has = F.exists(params(q), lambda x: param_name(x) == name)
    swapped = F.array_join(F.transform(params(q), lambda x: F.when(param_name(x) == name, F.lit(f"{name}={value}")).otherwise(x)), "&")
    return F.when(has, swapped).otherwise(F.concat_ws("&", F.when(q != "", q), F.lit(f"{name}={value}")))


# ---- types ------------------------------------------------------------------------------------------------------
def bare(url: Column) -> Column:
    """The URL up to its query or fragment."""
    return F.regexp_extract(url, r"^([^?#]*)", 1)


def last_segment(url: Column) -> Column:
    return F.substring_index(bare(url), "/", -1)


def normal_format(token: Column) -> Column:
    t = F.lower(token)
    return F.when(t.isin("jpg", "jpeg", "jfif"), "jpeg").when(t.isin(*IMAGE_TYPES), t).otherwise("unknown")


def image_type(url: Column) -> Column:
    """Type by the file's extension, else unknown."""
    seg = last_segment(url)
    return F.when(F.contains(seg, F.lit(".")), normal_format(F.substring_index(seg, ".", -1))).otherwise("unknown")


@compiled
def detect_type(url: Column) -> Column:
    """Type by extension, else by the parameters format or fm, else by an @ suffix of the path."""
    by_ext = image_type(url)
    stated = F.coalesce(param(url, "format"), param(url, "fm"))
    at = F.regexp_extract(path(url), r"(?i)@([a-z0-9]+)$", 1)
    return F.when(by_ext != "unknown", by_ext).when(F.coalesce(stated, F.lit("")) != "", normal_format(stated)).when(at != "", normal_format(at)).otherwise("unknown")


def extension(url: Column) -> Column:
    """1 to 5 letters or digits after a dot that is not the name's first character, in lower case; else null."""
    ext = F.lower(F.regexp_extract(last_segment(url), r"^.+\.([A-Za-z0-9]{1,5})$", 1))
    return F.when(ext != "", ext)


@compiled
def image_extension(url: Column) -> Column:
    at = F.lower(F.regexp_extract(bare(url), r"(?i)@([a-z0-9]{1,5})$", 1))
    return F.when(extension(url).isin(*IMAGE_EXTENSIONS), extension(url)).when(at.isin(*IMAGE_EXTENSIONS), at)


def _mapped(value: Column, table: dict[str, str]) -> Column:
    return let(value, lambda v: reduce(lambda acc, kv: acc.when(v == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(None).cast("string"))))


@compiled
def av_type(url: Column, mime: Column | None = None) -> Column:
    """Canonical audio or video type by the extension, else by the MIME type; else unknown."""
    known = {**AUDIO_TYPES, **VIDEO_TYPES}
    by_ext = _mapped(extension(url), known)
    if mime is None:
        return F.coalesce(by_ext, F.lit("unknown"))
    top, sub = (F.lower(F.regexp_extract(mime, r"(?i)^(video|audio)/([\w.+-]+)", g)) for g in (1, 2))
    kind = F.when((top == "audio") & (sub == "mp4"), "m4a").otherwise(F.coalesce(_mapped(sub, MIME_TYPES), sub))
    return F.coalesce(by_ext, F.when(kind.isin(*known), kind), F.lit("unknown"))


def av_extension(kind: Column) -> Column:
    return _mapped(kind, {**AUDIO_TYPES, **VIDEO_TYPES})


def extension_for_type(kind: Column) -> Column:
    return F.when(kind.isin("png", "gif", "webp", "svg", "avif", "bmp", "ico"), kind).otherwise("jpg")


def kind_from_extension(ext: Column) -> Column:
    return F.when(ext.isin("mp4", "webm"), "video").when(ext == "gif", "gif").otherwise("image")


def is_hls(url: Column) -> Column:
    return url.rlike(r"(?i)\.m3u8(?:[?#]|$)")


def is_dash(url: Column) -> Column:
    return url.rlike(r"(?i)\.mpd(?:[?#]|$)")


def undownloadable(url: Column) -> Column:
    return url.rlike(r"(?i)^blob:") | is_hls(url) | is_dash(url)


def under(h: Column, *names: str) -> Column:
    """h is one of the names or below one of them."""
    return reduce(lambda a, b: a | b, [(h == n) | h.endswith("." + n) for n in names])


@compiled
def looks_like_media(url: Column) -> Column:
    def known(u: Column) -> Column:
        h = u["host"]
        hosts = under(h, *MEDIA_HOSTS) | h.rlike(r"(?:^|\.)lh\d\.googleusercontent\.com$")
        fmt = F.lower(F.coalesce(param_of(u["query"], "format"), param_of(u["query"], "fm"), F.lit("")))
        return u["ok"] & (hosts | fmt.isin(*MEDIA_FORMATS))

    return let(url, lambda x: F.coalesce(x.rlike(MEDIA_FILE) | let(parts(x), known), F.lit(False)))


@compiled
def dimensions(url: Column) -> Column:
    """struct<width, height> stated in a URL, or null: a WxH token, else the parameters w and h (a missing one is 0)."""
    size = r"(?i)(?<=[-_=])(\d{2,5})x(\d{2,5})(?![\dA-Za-z])"
    number = lambda name: F.regexp_extract(F.coalesce(param(url, name), F.lit("")), r"^\s*(\d+)", 1)
    w, h = number("w"), number("h")
    both = lambda a, b: F.struct(a.cast("int").alias("width"), b.cast("int").alias("height"))
    zero = lambda x: F.when(x == "", "0").otherwise(x)
    return F.when(url.rlike(size), both(F.regexp_extract(url, size, 1), F.regexp_extract(url, size, 2))).when((w != "") | (h != ""), both(zero(w), zero(h)))


@compiled
def base64_info(src: Column) -> Column:
    """struct<type, bytes> of a data:image URL: 3/4 of the payload less its padding, 0 if it is not base64; else null."""
    kind = F.regexp_extract(src, r"(?i)^data:image/([a-z0-9.+-]+)", 1)
    body = F.regexp_extract(src, r"(?is)^data:image/[^,]*;base64,(.*)$", 1)
    pad = F.length(F.regexp_extract(body, r"(={0,2})$", 1))
    size = F.when(body == "", 0).otherwise(F.floor(F.length(body) * 3 / 4) - pad).cast("bigint")
    return F.when(kind != "", F.struct(F.regexp_replace(normal_format(F.regexp_replace(kind, r"\+xml$", "")), "^unknown$", "unknown").alias("type"), size.alias("bytes")))


DOTTED = r"(?i)/(?:\.|%2e){1,2}(?=[/?#]|$)"


def dotless(p: Column) -> Column:
    """A path without dot segments: a fold over its segments, `..` taking the one before it off the stack."""
    up, here = r"(?i)^(?:\.|%2e){2}$", r"(?i)^(?:\.|%2e)$"
    none, end = F.array().cast("array<string>"), F.array(F.lit(""))
    parts = F.split(F.regexp_replace(p, "^/", ""), "/")
    last = F.size(parts) - 1
    marked = F.transform(parts, lambda x, i: F.struct(x.alias("x"), (i == last).alias("last")))

    def step(acc: Column, s: Column) -> Column:
        kept = F.when(s["x"].rlike(up), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        dots = s["x"].rlike(up) | s["x"].rlike(here)
        return F.when(dots & s["last"], F.concat(kept, end)).when(dots, kept).otherwise(F.concat(kept, F.array(s["x"])))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(marked, none, step), "/"))


@compiled
def without_dots(url: Column) -> Column:
    """An http address with the dot segments of its path resolved; anything else as it is."""
    part = lambda i: F.regexp_extract(url, r"^(?i:(https?://[^/?#]*))([^?#]*)((?s:.*))$", i)
    return F.when(url.rlike(r"(?i)^https?://[^/?#]*[^?#]*?" + DOTTED[4:]), F.concat(part(1), dotless(part(2)), part(3))).otherwise(url)


def absolute(uri: Column, base: Column) -> Column:
    """uri against base: absolute, scheme-relative, rooted, a query or a fragment alone, or relative to the base's folder; without dot segments."""
    origin_ = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(page, r"^(.*/)", 1)
    folder = F.when(F.length(folder) > F.length(origin_), folder).otherwise(F.concat(origin_, F.lit("/")))
    own = F.when(page == origin_, F.concat(page, F.lit("/"))).otherwise(page)
    joined = (
        F.when(uri.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), uri).when(uri.startswith("//"), F.concat(scheme, uri)).when(uri.startswith("/"), F.concat(origin_, uri))
        .when(uri.startswith("?"), F.concat(own, uri)).when(uri.startswith("#"), F.concat(own, F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1), uri)).otherwise(F.concat(folder, uri))
    )
    return let(joined, lambda x: without_dots(x))


def ascii_host(h: Column) -> Column:
    """A host name in ASCII (labels of other letters as xn--), or null where there is no such name. Not for use inside of lambdas."""
    return F.when(h.rlike(r"[^\x00-\x7F]"), F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), h)).otherwise(h)


def normal(url: Column) -> Column:
    """An http address as a browser writes it: scheme and host in lower case and ASCII, no default port, no user, no dot
    segments, blanks and letters beyond ASCII escaped; null where it is none. Not for use inside of lambdas."""
    rest = F.regexp_extract(url, ABSOLUTE, 4)
    tail = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    bytes_ = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    pieces = lambda x: F.regexp_extract_all(x, F.lit(r"[\x21-\x7E]+|[^\x21-\x7E]+"), F.lit(0))
    escaped = lambda x: F.array_join(F.transform(pieces(x), lambda y: F.when(y.rlike(r"^[\x21-\x7E]"), y).otherwise(bytes_(y))), "")
    path_ = dotless(F.when(rest == "", "/").otherwise(F.replace(rest, F.lit("\\"), F.lit("/"))))
    own = F.lower(F.regexp_extract(url, ABSOLUTE, 2))
    whole = origin(url)
    base = F.replace(whole, own, ascii_host(own))
    return F.when(valid(url), F.concat(base, escaped(path_), escaped(tail)))


# ---- identity ---------------------------------------------------------------------------------------------------
@compiled
def registrable_domain(h: Column) -> Column:
    labels = F.filter(F.split(F.regexp_replace(h, r"(?i)^www\.", ""), r"\."), lambda x: x != "")
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
    return F.when(n <= 2, F.array_join(labels, ".")).when(tail(2).isin(*TWO_PART_SUFFIXES), tail(3)).otherwise(tail(2))


@compiled
def cloudinary_transform(seg: Column) -> Column:
    """A comma list of key_value parts, each key a transformation's and no value with an underscore."""
    fine = lambda t: F.substring_index(t, "_", 1).isin(*CLOUDINARY_KEYS) & (F.length(t) - F.length(F.replace(t, F.lit("_"), F.lit(""))) == 1)
    return F.forall(F.split(seg, ","), fine)


@compiled
def canonical_key(src: Column) -> Column:
    """The stable identity of a media URL: host and path less edge hosts, signatures and renditions.

    What is no URL is its own key. Keys of dynamic paths keep the parameters that tell things apart, sorted by name.
    """
    sankaku = r"(?i)/data/(?:preview/|sample/)?(?:[0-9a-f]{2}/)*([0-9a-f]{32})\.(?:avif|jpe?g|png|gif|webp)$"
    xhs = r"(?i)^/\d{6,}/[0-9a-f]{32}/"

    def key(u: Column) -> Column:
        h, p, q = u["host"], u["path"], u["query"]
        seg = F.regexp_extract(p, r"/(?:image|video|raw)/(?:upload|fetch)/([^/]+)/", 1)
        uncut = F.when((seg != "") & cloudinary_transform(seg), F.regexp_replace(p, r"/(image|video|raw)/(upload|fetch)/[^/]+/", "/$1/$2/")).otherwise(p)
        ids = F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), param_of(q, k)) for k in ("frame", "page")]))
        kept = F.filter(params(q), lambda x: ~F.lower(param_name(x)).isin(*VOLATILE_PARAMS, *TRANSFORM_PARAMS))
        in_order = F.array_join(F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(param_name(x).alias("k"), x.alias("v")))), lambda s: s["v"]), "&")
        return (
            F.when(under(h, "fbcdn.net", "cdninstagram.com"), F.concat(F.lit("fbcdn.net"), p))
            .when(h.rlike(r"^i[0-2]\.wp\.com$"), F.concat(F.lit("i.wp.com"), p))
            .when(under(h, "googleusercontent.com"), F.concat(h, F.regexp_replace(p, r"=[^/=]*$", "")))
            .when(under(h, "imgix.net"), F.concat(h, p, F.when(F.size(ids) > 0, F.concat(F.lit("?"), F.array_join(ids, "&"))).otherwise("")))
            .when(under(h, "res.cloudinary.com"), F.concat(F.lit("res.cloudinary.com"), F.regexp_replace(uncut, r"/(upload|fetch)/v\d{10}/", "/$1/")))
            .when(under(h, "twimg.com"), F.concat(h, F.regexp_replace(p, r"(?i):(?:thumb|small|medium|large|orig)$", "")))
            .when(h == "i.pinimg.com", F.concat(h, F.regexp_replace(p, r"^/(?:\d+x(?:\d+)?(?:_RS)?|originals)/", "/")))
            .when(under(h, "sankakucomplex.com") & p.rlike(sankaku), F.concat(F.lit("sankakucomplex.com/data/"), F.lower(F.regexp_extract(p, sankaku, 1))))
            .when(under(h, "xhscdn.com", "rednotecdn.com") & p.rlike(xhs), F.concat(F.lit("xhscdn.com"), F.regexp_replace(F.regexp_replace(p, xhs, "/"), r"![^/]*$", "")))
            .when(p.rlike(KEY_MEDIA_FILE), F.concat(h, p))
            .otherwise(let(in_order, lambda x: assemble(h, p, x)))
        )

    return let(src, lambda x: F.when(valid(x), let(parts(x), key)).otherwise(x))


@compiled
def is_emoji(src: Column) -> Column:
    """Served by a host, or from a folder, that has only emoji."""

    def known(u: Column) -> Column:
        h, p = u["host"], F.lower(u["path"])
        at = lambda name: under(h, name[1:]) if name[0] == "." else h == name
        return reduce(lambda a, b: a | b, [at(name) & (p.rlike(pattern) if pattern else F.lit(True)) for name, pattern in EMOJI])

    return let(parts(src), known)


# ---- safety -----------------------------------------------------------------------------------------------------
def pinned(url: Column, *hosts: str) -> Column:
    """The URL if it is https on one of the hosts or below it, else null."""
    return F.when(url.rlike(r"(?i)^https://") & under(host(url), *hosts), url)


@compiled
def strip_secrets(url: Column) -> Column:
    """The URL without signing parameters: a fixed list and the X-Amz- and X-Goog- families. Others stay as spelled."""
    secret = lambda x: F.lower(param_name(x)).isin(*SIGNING_PARAMS) | F.lower(param_name(x)).rlike(r"^x-(?:amz|goog)-")
    kept = F.array_join(F.filter(params(query(url)), lambda x: ~secret(x)), "&")
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    has = F.exists(params(query(url)), secret)
    return F.when(has, F.concat(bare(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), fragment)).otherwise(url)


@compiled
def safe_source(url: Column) -> Column:
    """A page address to be shown: control characters and blanks out; no other scheme than http(s)."""
    clean = F.regexp_replace(url, r"[\x00-\x20\x7f]", "")
    return F.when(clean.rlike(r"(?i)^https?://"), clean)


def injectable(url: Column) -> Column:
    """A page that a script may look into: http(s), and no extension gallery."""
    return valid(url) & ~under(host(url), "chromewebstore.google.com", "addons.mozilla.org", "microsoftedge.microsoft.com") & ~((host(url) == "chrome.google.com") & path(url).startswith("/webstore"))


def _private_v4(a: Column) -> Column:
    """a: an IPv4 address as a number."""
    nets = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("224.0.0.0", 3))
    number = lambda s: reduce(lambda acc, x: acc * 256 + int(x), s.split("."), 0)
    return reduce(lambda x, y: x | y, [F.shiftright(a, 32 - bits) == number(net) >> (32 - bits) for net, bits in nets])


def _v4(h: Column) -> Column:
    """The number of a dotted, decimal, hexadecimal or octal address of one or four parts; else null."""
    part = lambda x: F.when(x.rlike(r"^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substring(x, 3, 8), 16, 10)).when(x.rlike(r"^0[0-7]{1,11}$"), F.conv(x, 8, 10)).when(x.rlike(r"^\d{1,10}$"), x).cast("bigint")
    four = lambda n: reduce(lambda acc, i: acc * 256 + F.get(n, F.lit(i)), range(4), F.lit(0).cast("bigint"))
    return let(F.transform(F.split(h, r"\."), part), lambda n: F.when(F.size(n) == 1, F.get(n, F.lit(0))).when(F.size(n) == 4, four(n)))


@compiled
def safe_capture(url: Column) -> Column:
    """False for what a server must not fetch: other schemes, local names, private, loopback and link-local addresses in any spelling, alone or inside of a name."""
    bracket = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?\[([0-9a-f:.%]+)\]", 1))
    h = F.regexp_replace(host(url), r"\.$", "")
    inside = lambda x: F.regexp_extract(x["h"], r"(?:^|[.-])(\d{1,3})[.-](\d{1,3})[.-](\d{1,3})[.-](\d{1,3})(?:[.-]|$)", 0)
    mapped = lambda x: F.regexp_extract(x["bracket"], r"(\d+\.\d+\.\d+\.\d+)$", 1)
    parts = F.struct(valid(url).alias("valid"), bracket.alias("bracket"), h.alias("h"))
    return let(parts, lambda x: F.coalesce(F.when(x["bracket"] != "", ~let(mapped(x), lambda m: _private_v6(x["bracket"], m))).otherwise(x["valid"] & ~_local(x["h"]) & ~let(inside(x), lambda i: _refused_v4(x["h"], i))), F.lit(False)))


def _local(h: Column) -> Column:
    return (h == "localhost") | h.rlike(r"\.(?:localhost|local|internal|lan|home|corp|intranet)$") | ((~F.contains(h, F.lit("."))) & ~h.rlike(r"^(?:0x[0-9a-f]+|\d+)$"))


def _private_v6(bracket: Column, mapped: Column) -> Column:
    private = bracket.rlike(r"^(?:::1?|0*(?::0*)*:0*1?)$") | bracket.rlike(r"^f[cd]") | bracket.rlike(r"^fe[89ab]") | bracket.rlike(r"^ff") | bracket.rlike(r"^(?:64:ff9b:|2002:)")
    return private | ((mapped != "") & let(_v4(mapped), lambda n: F.coalesce(_private_v4(n), F.lit(True)))) | (bracket.startswith("::ffff:") & (mapped == ""))


def _refused_v4(h: Column, inside: Column) -> Column:
    """h, or an address inside of it, is private, or h is a number that is no address."""
    alone = let(_v4(h), lambda n: F.coalesce(_private_v4(n), F.lit(False)) | F.coalesce(n >= 1 << 32, F.lit(False)))
    dotted = F.regexp_replace(F.regexp_replace(inside, r"^[.-]|[.-]$", ""), "-", ".")
    return alone | ((inside != "") & let(_v4(dotted), lambda n: F.coalesce(_private_v4(n), F.lit(False))))


# ---- names ------------------------------------------------------------------------------------------------------
@compiled
def sanitize_path(x: Column) -> Column:
    """A relative path that stays below its root and that every file system takes."""
    clean = F.replace(F.regexp_replace(x, r'[<>:"|?*\x00-\x1f]', ""), F.lit("\\"), F.lit("/"))
    parts = F.transform(F.split(clean, "/"), lambda p: F.regexp_replace(p, r"[. ]+$", ""))
    parts = F.filter(parts, lambda p: (p != "") & ~p.isin(".", ".."))
    parts = F.transform(parts, lambda p: F.when(p.rlike(RESERVED_NAME), F.concat(F.lit("_"), p)).otherwise(p))
    ext = lambda p: F.regexp_extract(p, r"(?s)^.+(\.[^.]{0,11})$", 1)
    cap = lambda p: F.when(F.length(p) <= MAX_NAME, p).otherwise(F.concat(F.substring(p, F.lit(1), MAX_NAME - F.length(ext(p))), ext(p)))
    return F.array_join(F.transform(parts, cap), "/")


def to_segment(x: Column) -> Column:
    return F.replace(sanitize_path(x), F.lit("/"), F.lit(""))


def expand_template(template: Column, tokens: dict[str, Column]) -> Column:
    """host, domain, date and kind filled in; any other {…} goes; then made safe."""
    filled = reduce(lambda acc, kv: F.replace(acc, F.lit("{" + kv[0] + "}"), to_segment(F.coalesce(kv[1], F.lit("")))), tokens.items(), template)
    return sanitize_path(F.regexp_replace(filled, r"\{[^}]*\}", ""))


@compiled
def original_name(url: Column) -> Column:
    """The file's name without its extension, decoded and made safe; null where there is none."""
    decoded = decode(F.substring_index(path(url), "/", -1))
    stem = F.when(F.instr(F.substring(decoded, 2, 1 << 20), ".") > 0, F.regexp_replace(decoded, r"(?s)\.[^.]*$", "")).otherwise(decoded)
    safe = F.substring_index(sanitize_path(stem), "/", -1)
    return F.when(valid(url) & (safe != ""), safe)


@compiled
def contained(p: Column) -> Column:
    """A relative path without its dot segments, or null if it would leave its root."""
    parts = F.filter(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("ok"))
    step = lambda acc, x: F.struct(
        F.when(x == "..", F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))).otherwise(F.concat(acc["out"], F.array(x))).alias("out"),
        (acc["ok"] & ~((x == "..") & (F.size(acc["out"]) == 0))).alias("ok"),
    )
    return F.when(~p.rlike(r"^(?:[/\\]|[A-Za-z]:)"), F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["out"], "/"))))


def archive_name(domain: Column, date: Column) -> Column:
    return F.concat(F.when(F.coalesce(domain, F.lit("")) != "", F.concat(domain, F.lit("-"))).otherwise(""), F.lit("media-"), date, F.lit(".zip"))


def links_name(domain: Column, date: Column) -> Column:
    return F.concat(F.when(F.coalesce(domain, F.lit("")) != "", F.concat(domain, F.lit("-"))).otherwise(""), F.lit("media-links-"), date, F.lit(".txt"))


# ---- proxies ----------------------------------------------------------------------------------------------------
@compiled
def deproxy(url: Column) -> Column:
    """The media URL that an image proxy's URL wraps, unwrapped once; null where there is none."""
    absolute = lambda x: x.rlike(r"(?i)^https?://")

    def inner(u: Column) -> Column:
        p, q, h, base = u["path"], u["query"], u["host"], u["origin"]
        search = F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")
        fetch = F.regexp_replace(F.regexp_extract(p, r"/image/fetch/(.*)$", 1), r"^(?:[^/]*_[^/]*/)+", "")
        cdn = F.regexp_extract(p, r"/cdn-cgi/image/([^/]*=[^/]*)/(.*)$", 2)
        misskey = F.when(h == "proxy.misskeyusercontent.jp", F.regexp_extract(p, r"^/(?:image|static|avatar|emoji)/(.+)$", 1)).otherwise("")
        by_host, by_path = under(h, "images.weserv.nl", "wsrv.nl"), p.rlike(r"/proxy/[^/]+$")
        # What each kind of proxy wraps, and what a relative address there is put behind.
        named = F.filter(F.transform(params(q), lambda x: F.struct(param_name(x).alias("name"), x.alias("pair"))), lambda x: x["name"].isin(*PROXY_PARAMS))
        wrap = lambda on, text, before: F.when(on, F.struct(text.alias("text"), before.alias("before")))
        none = F.lit(None).cast("string")

        def found(n: Column) -> Column:
            first = lambda k: F.get(F.filter(n, lambda x: x["name"] == k), F.lit(0))
            stated = lambda x: decode(param_value(x["pair"]))
            url_ = first(F.lit("url"))
            early = [
                wrap(fetch != "", F.concat(decode(fetch), search), none), wrap(cdn != "", F.concat(decode(cdn), search), F.concat(base, F.lit("/"))), wrap(by_host & url_.isNotNull(), F.nullif(stated(url_), F.lit("")), F.lit("https://")),
                wrap(by_path & url_.isNotNull(), stated(url_), none), wrap(misskey != "", decode(misskey), F.lit("https://")),
            ]
            late = F.transform(F.array(*map(F.lit, PROXY_PARAMS)), lambda k: let(first(k), lambda x: F.when(x.isNotNull(), let(stated(x), lambda v: F.struct(v.alias("text"), F.when(v.startswith("/"), base).alias("before"))))))
            return F.concat(F.array(*early), F.when(p.rlike(MEDIA_FILE), F.array_repeat(early[0], 0)).otherwise(late))

        whole = lambda w: F.when(absolute(w["text"]), w["text"]).otherwise(F.concat(w["before"], F.when(w["before"] == F.concat(base, F.lit("/")), F.regexp_replace(w["text"], "^/+", "")).otherwise(w["text"])))
        every = F.transform(F.array_compact(let(named, found)), whole)
        return F.get(F.filter(every, lambda v: F.coalesce(looks_like_media(v), F.lit(False))), F.lit(0))

    return F.when(valid(url), let(parts(url), inner))
