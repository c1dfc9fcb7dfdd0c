"""Queries over a media view of the part table, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenweft.functions import cdn
from lumenweft.functions import scalar as S
from lumenweft.functions import url as U
from lumenweft.operators import media as M
from lumenweft.operators import near_dup as N

#: A media view by arithmetic, in SQL that both engines read alike. hst, pth and qry are the parts that src is made of.
VIEW = """SELECT *, CONCAT('https://', hst, pth, '?', qry) AS src,
  CASE ext WHEN 'jpg' THEN 'jpeg' WHEN 'php' THEN 'unknown' ELSE ext END AS type, CASE WHEN ext = 'mp4' THEN 'video' ELSE 'image' END AS kind
FROM (SELECT p_partkey AS seq, p_partkey % 97 AS page_id, p_name AS alt,
  CASE p_partkey % 6 WHEN 0 THEN 'cdn.example.com' WHEN 1 THEN 'scontent-a.xx.fbcdn.net' WHEN 2 THEN 'i0.wp.com' WHEN 3 THEN 'img.example.co.uk' WHEN 4 THEN 'www.site.org' ELSE 'abs.twimg.com' END AS hst,
  CONCAT(CASE WHEN p_partkey % 6 = 5 AND p_partkey % 4 = 0 THEN '/emoji/' ELSE '/photos/' END, CAST(p_partkey % 400 AS STRING),
    CASE p_partkey % 5 WHEN 0 THEN '-800x600.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.mp4' WHEN 3 THEN '.webp' ELSE '.php' END) AS pth,
  CONCAT('id=', CAST(p_partkey % 50 AS STRING), '&w=', CAST(p_size * 40 AS STRING), '&token=', CAST(p_partkey AS STRING)) AS qry,
  CASE p_partkey % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'mp4' WHEN 3 THEN 'webp' ELSE 'php' END AS ext,
  CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE (p_size * 37) % 1900 END AS width, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE (p_size * 53) % 1700 END AS height,
  CASE WHEN p_partkey % 11 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(p_retailprice * 100) AS BIGINT) END AS file_size,
  p_partkey % 13 = 0 AS is_base64, CASE WHEN p_partkey % 17 = 0 THEN 'https://h.example/m.m3u8' END AS hls_manifest, p_partkey % 19 = 0 AS unresolved_video,
  p_partkey % 23 = 0 AS unresolved_image, p_partkey % 29 = 0 AS near_duplicate, CASE WHEN p_partkey % 3 = 0 THEN CONCAT('k', CAST(p_partkey % 200 AS STRING)) END AS media_key FROM part) AS base"""
#: The view's keys, stated from the parts.
KEY = "CASE WHEN hst LIKE '%fbcdn.net' THEN 'fbcdn.net' || pth WHEN hst = 'i0.wp.com' THEN 'i.wp.com' || pth WHEN hst = 'abs.twimg.com' OR ext <> 'php' THEN hst || pth ELSE hst || pth || '?id=' || (seq % 50) END"
SITE = "CASE hst WHEN 'cdn.example.com' THEN 'example.com' WHEN 'scontent-a.xx.fbcdn.net' THEN 'fbcdn.net' WHEN 'i0.wp.com' THEN 'wp.com' WHEN 'img.example.co.uk' THEN 'example.co.uk' WHEN 'www.site.org' THEN 'site.org' ELSE 'twimg.com' END"
WITH = f"WITH m AS ({VIEW.replace('STRING', 'VARCHAR')}), k AS (SELECT *, {KEY} AS key, {SITE} AS site FROM m)"
ITEM = ["seq", "page_id", "src", "alt", "type", "kind", "ext", "width", "height", "file_size", "is_base64", "hls_manifest", "unresolved_video", "unresolved_image", "near_duplicate", "media_key"]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.sql(VIEW.replace("FROM part)", "FROM {part})"), part=part).select(*ITEM)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle if oracle.lstrip().startswith("WITH") else f"{WITH} {oracle}"
        return f

    return add


# ---- URL functions ----------------------------------------------------------------------------------------------
@query("SELECT seq, hst AS host, site AS domain FROM k")
def registrable_domain(spark, d):
    h = U.host(F.col("src"))
    return items(spark, d).select("seq", h.alias("host"), U.registrable_domain(h).alias("domain"))


@query("SELECT seq, type AS image_type, CASE WHEN ext = 'php' THEN NULL WHEN ext = 'mp4' THEN NULL ELSE ext END AS image_ext, CASE WHEN ext = 'mp4' THEN 'mp4' ELSE 'unknown' END AS av_type FROM (SELECT seq, ext, CASE WHEN ext = 'mp4' THEN 'unknown' ELSE type END AS type FROM k)")
def image_type(spark, d):
    s = F.col("src")
    return items(spark, d).select("seq", U.image_type(s).alias("image_type"), U.image_extension(s).alias("image_ext"), U.av_type(s).alias("av_type"))


@query("SELECT seq, CASE seq % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'webp' ELSE 'unknown' END AS detected FROM k")
def detect_type_query(spark, d):
    made = F.concat(F.lit("https://cdn.example.com/i/"), F.col("seq").cast("string"), F.lit("?format="), F.when(F.col("seq") % 3 == 0, "JPG").when(F.col("seq") % 3 == 1, "webp").otherwise("tiff"))
    return items(spark, d).select("seq", U.detect_type(made).alias("detected"))


@query("SELECT seq, CASE seq % 4 WHEN 0 THEN 'm4a' WHEN 1 THEN 'mp3' WHEN 2 THEN 'unknown' ELSE 'ogg' END AS av FROM k")
def av_type_mime(spark, d):
    mime = F.when(F.col("seq") % 4 == 0, "audio/mp4").when(F.col("seq") % 4 == 1, "audio/mpeg").otherwise("application/json")
    src = F.when(F.col("seq") % 4 == 3, "https://a.example/x.ogv").otherwise("https://a.example/x.bin")
    return items(spark, d).select("seq", U.av_type(src, mime).alias("av"))


@query("SELECT seq, CASE WHEN ext = 'jpg' THEN 800 ELSE w END AS width, CASE WHEN ext = 'jpg' THEN 600 ELSE 0 END AS height FROM (SELECT seq, ext, CAST(regexp_extract(qry, 'w=(\\d+)', 1) AS INTEGER) AS w FROM k)")
def url_dimensions(spark, d):
    dims = U.dimensions(F.col("src"))
    return items(spark, d).select("seq", dims["width"].alias("width"), dims["height"].alias("height"))


@query("SELECT seq, key FROM k")
def canonical_key(spark, d):
    return items(spark, d).select("seq", U.canonical_key(F.col("src")).alias("key"))


@query("SELECT seq, hst = 'i0.wp.com' OR ext <> 'php' AS media FROM k")
def looks_like_media(spark, d):
    return items(spark, d).select("seq", U.looks_like_media(F.col("src")).alias("media"))


@query("SELECT seq, CASE WHEN ext <> 'php' OR hst = 'i0.wp.com' THEN 'https://' || hst || pth END AS target FROM k")
def deproxy_param(spark, d):
    bare = U.bare(F.col("src"))
    wrapped = F.concat(F.lit("https://proxy.example/get?x=1&url="), F.url_encode(bare))
    return items(spark, d).select("seq", U.deproxy(wrapped).alias("target"))


@query("SELECT seq, CASE seq % 5 WHEN 0 THEN 'https://images.unsplash.com/photo-' || seq || '?ixid=' || seq WHEN 1 THEN 'https://i.pinimg.com/originals/ab/' || seq || '.jpg' WHEN 2 THEN 'https://pbs.twimg.com/media/' || seq || '?format=jpg&name=orig' WHEN 3 THEN 'https://images.pexels.com/photos/' || seq || '.jpeg' ELSE 'https://plain.example/' || seq || '.jpg?w=5' END AS original, seq % 5 <> 4 AS changed FROM k")
def cdn_upgrade(spark, d):
    n = F.col("seq").cast("string")
    cases = (
        ("https://images.unsplash.com/photo-", n, "?ixid=", n, "&w=300&q=80"), ("https://i.pinimg.com/236x/ab/", n, ".jpg"), ("https://pbs.twimg.com/media/", n, "?format=jpg&name=small"),
        ("https://images.pexels.com/photos/", n, ".jpeg?auto=compress&w=100"), ("https://plain.example/", n, ".jpg?w=5"),
    )
    made = F.lit(None).cast("string")
    for i, parts in enumerate(cases):
        made = F.when(F.col("seq") % 5 == i, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(made)
    return cdn.upgraded(items(spark, d).select("seq", made.alias("url"))).select("seq", "original", F.col("thumbnail").isNotNull().alias("changed"))


@query("SELECT seq, 'https://res.cloudinary.com/demo/image/upload/v' || (seq % 3) || '/a_b_c/' || seq || '.jpg' AS original FROM k")
def cloudinary_strip(spark, d):
    n = F.col("seq").cast("string")
    made = F.concat(F.lit("https://res.cloudinary.com/demo/image/upload/w_"), n, F.lit(",c_fill/q_auto/v"), (F.col("seq") % 3).cast("string"), F.lit("/a_b_c/"), n, F.lit(".jpg"))
    return cdn.upgraded(items(spark, d).select("seq", made.alias("url"))).select("seq", "original")


@query("SELECT seq, hst = 'abs.twimg.com' AND pth LIKE '/emoji/%' AS emoji FROM k")
def emoji_urls(spark, d):
    return items(spark, d).select("seq", U.is_emoji(F.col("src")).alias("emoji"))


@query("SELECT seq, 'https://' || hst || pth || '?' || regexp_replace(qry, '&token=\\d+$', '') AS clean FROM k")
def strip_url_secrets(spark, d):
    return items(spark, d).select("seq", U.strip_secrets(F.col("src")).alias("clean"))


@query("SELECT seq, regexp_replace(regexp_replace(pth, '^.*/', ''), '\\.[a-z0-9]+$', '') AS name FROM k")
def original_name(spark, d):
    return items(spark, d).select("seq", U.original_name(F.col("src")).alias("name"))


@query("SELECT seq, 'Media/' || site || '/2024-01-02/' || kind || CASE WHEN seq % 2 = 0 THEN '' ELSE '/_con' END AS folder FROM k")
def path_template(spark, d):
    h = U.host(F.col("src"))
    tokens = {"host": h, "domain": U.registrable_domain(h), "date": F.lit("2024-01-02"), "kind": F.col("kind")}
    template = F.when(F.col("seq") % 2 == 0, "../Media/{domain}/{date}/{kind}/{nope}").otherwise("Media\\{domain}/{date}/./{kind}/con. ")
    return items(spark, d).select("seq", U.expand_template(template, tokens).alias("folder"))


@query("SELECT seq, regexp_replace(alt, '[<>:\"|?*]', '', 'g') || '/_aux.txt' AS path FROM k")
def sanitize_path(spark, d):
    return items(spark, d).select("seq", U.sanitize_path(F.concat(F.lit("/./"), F.col("alt"), F.lit("?/ ../aux.txt"))).alias("path"))


@query("SELECT seq, seq % 4 = 0 AS safe FROM k")
def ssrf_guard(spark, d):
    n = (F.col("seq") % 250).cast("string")
    made = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("https://8.8.4."), n, F.lit("/a"))).when(F.col("seq") % 4 == 1, F.concat(F.lit("http://10.1.2."), n)).when(F.col("seq") % 4 == 2, F.concat(F.lit("http://a.192-168-1-"), n, F.lit(".nip.io/"))).otherwise("http://[::ffff:7f00:1]/")
    return items(spark, d).select("seq", U.safe_capture(made).alias("safe"))


@query("SELECT seq, CAST(length(alt) AS BIGINT) AS bytes FROM k")
def base64_size(spark, d):
    info = U.base64_info(F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(F.col("alt").cast("binary")), r"\s", "")))
    return items(spark, d).select("seq", info["bytes"].alias("bytes"))


# ---- filters and facets -----------------------------------------------------------------------------------------
_SETTINGS = M.Settings(minimum_image_size=200, exclude_base64=True, exclude_emoji=True, capture_hls=False)
_PASS = "(width = 0 OR width >= 200) AND (height = 0 OR height >= 200) AND NOT is_base64 AND NOT (hst = 'abs.twimg.com' AND pth LIKE '/emoji/%') AND hls_manifest IS NULL"


@query(f"SELECT seq, src FROM k WHERE {_PASS}")
def settings_filter(spark, d):
    return items(spark, d).where(M.eligible(_SETTINGS)).select("seq", "src")


@query(f"SELECT page_id, count(*) AS n FROM k WHERE {_PASS} GROUP BY page_id")
def badge_count(spark, d):
    return M.badge(items(spark, d), _SETTINGS)


@query("SELECT seq, CASE WHEN greatest(width, height) <= 0 THEN NULL WHEN greatest(width, height) < 256 THEN 'small' WHEN greatest(width, height) < 1024 THEN 'medium' ELSE 'large' END AS bucket FROM k")
def size_bucket(spark, d):
    return items(spark, d).select("seq", M.bucket(F.col("width"), F.col("height")).alias("bucket"))


@query("SELECT seq FROM k WHERE NOT near_duplicate AND (greatest(width, height) <= 0 OR greatest(width, height) >= 1024) AND (kind <> 'image' OR type = 'jpeg') AND (file_size = 0 OR file_size >= 51200) AND NOT is_base64 AND NOT unresolved_video AND NOT unresolved_image")
def toolbar_filter(spark, d):
    t = M.Toolbar(size_bucket="large", image_type="jpeg", min_size_kb=50, include_base64=False, resolve_state="fetched")
    return M.toolbar(items(spark, d), t).select("seq")


@query("SELECT seq FROM k WHERE contains(lower(alt), 'red') OR contains(lower(src), 'red') OR contains(lower(type), 'red')")
def search_filter(spark, d):
    return M.toolbar(items(spark, d), M.Toolbar(duplicate_state="all", search="  ReD ")).select("seq")


@query("SELECT a.seq FROM k a WHERE a.site <> 'site.org' AND a.key NOT IN (SELECT key FROM k WHERE seq % 10 = 0)")
def blocklist_anti_join(spark, d):
    m = items(spark, d)
    excluded = m.where("seq % 10 = 0").select(F.col("src").alias("value"), F.lit("url").alias("kind")).unionByName(m.limit(1).select(F.lit("www.site.org").alias("value"), F.lit("host").alias("kind")))
    return M.without_excluded(m, excluded).select("seq")


@query("SELECT seq, key IN (SELECT key FROM k WHERE seq % 8 = 3) AS downloaded FROM k")
def downloaded_partition(spark, d):
    m = items(spark, d)
    return M.by_downloaded(m, m.where("seq % 8 = 3").select("src")).select("seq", "downloaded")


@query("""SELECT 'kind' AS facet, kind AS value, CAST(CASE kind WHEN 'image' THEN 1 WHEN 'video' THEN 2 ELSE 3 END AS BIGINT) AS place FROM k GROUP BY kind
UNION ALL SELECT 'format:' || kind, type, min(seq) FROM k WHERE type NOT IN ('', 'unknown') GROUP BY kind, type
UNION ALL SELECT DISTINCT 'size', CASE WHEN greatest(width, height) < 256 THEN 'small' WHEN greatest(width, height) < 1024 THEN 'medium' ELSE 'large' END,
  CAST(CASE WHEN greatest(width, height) < 256 THEN 1 WHEN greatest(width, height) < 1024 THEN 2 ELSE 3 END AS BIGINT) FROM k WHERE greatest(width, height) > 0""")
def facets(spark, d):
    return M.facets(items(spark, d))


@query("SELECT page_id, seq, CAST(row_number() OVER (PARTITION BY page_id ORDER BY file_size = 0, file_size DESC, seq) AS INTEGER) AS place FROM k")
def sort_size_unknown_last(spark, d):
    w = W.partitionBy("page_id").orderBy((F.col("file_size") == 0).asc(), F.col("file_size").desc(), "seq")
    return items(spark, d).select("page_id", "seq", F.row_number().over(w).alias("place"))


@query("SELECT seq, 'img' || lpad(CAST(seq % 40 AS VARCHAR), 20, '0') || '.e' AS natural_key FROM k")
def sort_name_natural(spark, d):
    name = F.concat(F.when(F.col("seq") % 2 == 0, "IMG").otherwise("img"), (F.col("seq") % 40).cast("string"), F.lit(".é"))
    return items(spark, d).select("seq", S.natural_key(name).alias("natural_key"))


@query("SELECT seq, CASE WHEN hls_manifest IS NOT NULL THEN 'stream' WHEN kind = 'image' AND type IN ('jpeg', 'png', 'avif', 'bmp') AND NOT is_base64 THEN 'convert' ELSE 'regular' END AS route FROM k")
def route_split(spark, d):
    return M.route(items(spark, d), "webp").select("seq", "route")


@query("SELECT seq FROM k WHERE kind = 'image' AND NOT is_base64 AND NOT unresolved_video AND NOT unresolved_image AND hls_manifest IS NULL")
def hash_candidates(spark, d):
    return items(spark, d).where(M.hash_candidate()).select("seq")


# ---- identity and merging ---------------------------------------------------------------------------------------
@query("SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY page_id, key ORDER BY seq) AS n FROM k) WHERE n = 1")
def first_seen_dedup(spark, d):
    return M.first_seen(items(spark, d)).select("seq")


@query()
def scan_dedup_fold(spark, d):
    return M.scan_dedup(items(spark, d)).select("page_id", "seq")


@query("SELECT seq, slot FROM (SELECT seq, min(seq) OVER (PARTITION BY key) AS slot, row_number() OVER (PARTITION BY key ORDER BY CAST(width AS BIGINT) * height DESC, file_size DESC, seq) AS n FROM k) WHERE n = 1")
def canonical_dedup_largest(spark, d):
    return M.keep_largest(items(spark, d)).select("seq", "slot")


@query("""SELECT seq, is_new FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN repl THEN 0 ELSE 1 END, CASE WHEN repl THEN -seq END, is_new, seq) AS n
FROM (SELECT *, coalesce(media_key, key) AS id, is_new = 1 AND media_key IS NOT NULL AS repl FROM (SELECT *, CAST(CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS is_new FROM k))) WHERE n = 1""")
def merge_scanned(spark, d):
    m = items(spark, d)
    out = M.merge_scanned(m.where("seq % 2 = 0"), m.where("seq % 2 = 1"))
    return out.select("seq", (F.col("seq") % 2).cast("int").alias("is_new"))


@query("""SELECT seq, time_ms FROM (SELECT *, sum(strlen('{"src":"' || src || '","time_ms":' || time_ms || '}')) OVER (ORDER BY p) AS bytes FROM (SELECT *, row_number() OVER (ORDER BY time_ms DESC, r, seq) AS p FROM (SELECT seq, src, key, r, time_ms, row_number() OVER (PARTITION BY key ORDER BY r, CASE WHEN r = 0 THEN -time_ms END, seq) AS n
FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END AS r, (seq * 7919) % 100003 AS time_ms FROM k)) WHERE n = 1) WHERE p <= 500) WHERE p = 1 OR bytes <= 2000000""")
def merge_history_whole(spark, d):
    """At the production limits: 500 entries and 2,000,000 bytes."""
    return _history(spark, d)


def _history(spark: SparkSession, d: str, **limits) -> DataFrame:
    m = items(spark, d).select("seq", "src", ((F.col("seq") * 7919) % 100003).alias("time_ms"))
    return M.merge_entries(m.where("seq % 3 <> 0"), m.where("seq % 3 = 0"), **limits).select("seq", "time_ms")


@query("SELECT page_id, seq FROM (SELECT page_id, seq, sum(length(src)) OVER w AS t, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY page_id ORDER BY seq DESC)) WHERE n = 1 OR t <= 300")
def byte_budget(spark, d):
    return M.byte_budget(items(spark, d), ["page_id"], [F.col("seq").desc()], F.octet_length("src"), 300).select("page_id", "seq")


@query("SELECT seq, CASE WHEN p AND (hls IS NOT TRUE) THEN 'https://new.example/' || seq || '.jpg' ELSE src END AS src, p AND hls IS NOT TRUE AS resolved FROM (SELECT *, seq % 19 = 0 OR seq % 23 = 0 AS p, seq % 2 = 0 AS hls FROM k)")
def apply_resolved(spark, d):
    m = items(spark, d)
    found = m.where("unresolved_video or unresolved_image").select("src", F.concat(F.lit("https://new.example/"), F.col("seq").cast("string"), F.lit(".jpg")).alias("url"), (F.col("seq") % 2 == 0).alias("hls"))
    out = M.apply_resolved(m, found, capture_hls=False)
    return out.select("seq", "src", F.col("src").startswith("https://new.example/").alias("resolved"))


@query("SELECT seq FROM k WHERE NOT (seq % 4 = 0 AND seq % 5 <> 0 AND seq % 3 = 0)")
def disk_state_left_join(spark, d):
    m = items(spark, d).select("seq", F.when(F.col("seq") % 5 != 0, F.col("seq")).alias("download_id"))
    disk = items(spark, d).where("seq % 4 = 0").select(F.col("seq").alias("download_id"), (F.col("seq") % 3 != 0).alias("exists"))
    return M.still_on_disk(m, disk).select("seq")


@query("""SELECT seq, batch_id, CASE WHEN n = 1 THEN path ELSE regexp_replace(path, '\\.jpg$', '') || '-' || n || '.jpg' END AS unique_path
FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, lower(path) ORDER BY seq) AS n FROM (SELECT seq, page_id AS batch_id, CASE WHEN seq % 2 = 0 THEN 'd/Pic' ELSE 'd/pic' END || (seq % 7) || '.jpg' AS path FROM k))""")
def uniquify_names(spark, d):
    path = F.concat(F.when(F.col("seq") % 2 == 0, "d/Pic").otherwise("d/pic"), (F.col("seq") % 7).cast("string"), F.lit(".jpg"))
    plan = items(spark, d).select("seq", F.col("page_id").alias("batch_id"), path.alias("path"))
    return M.unique_names(plan).select("seq", "batch_id", "unique_path")


@query("""SELECT seq, '{"src":"' || src || '","type":"' || type || '","width":' || width || ',"alt":' || CASE WHEN seq % 2 = 0 THEN 'null' ELSE '"x"' END || '}' AS sidecar, regexp_replace(pth, '^.*/', '') || '.json' AS file FROM k""")
def sidecar_json(spark, d):
    row = F.struct("src", "type", "width", F.when(F.col("seq") % 2 == 1, "x").alias("alt"))
    return items(spark, d).select("seq", F.to_json(row, {"ignoreNullFields": "false"}).alias("sidecar"), F.concat(U.last_segment(F.col("src")), F.lit(".json")).alias("file"))


@query("""WITH p AS (SELECT CAST(l_orderkey % 100 AS BIGINT) AS page_id, CAST(l_quantity * 20 AS INTEGER) AS width, CAST(l_linenumber * 150 AS INTEGER) AS height FROM lineitem)
SELECT page_id, count(*) AS image_count, round(max(CAST(width AS DOUBLE) * height) / sum(CAST(width AS DOUBLE) * height), 9) AS dominant, round(var_pop(CAST(width AS DOUBLE) / height), 6) AS spread,
  CASE WHEN count(*) >= 20 AND count(*) * 40000.0 / 1024000 >= 0.5 AND var_pop(CAST(width AS DOUBLE) / height) < 0.1 THEN 'gallery' WHEN page_id % 2 = 0 AND count(*) >= 10 THEN 'feed' WHEN page_id % 3 = 0 THEN 'article' ELSE 'unknown' END AS page_class
FROM p GROUP BY page_id""")
def page_signals_whole(spark, d):
    return _signals(spark.read.parquet(f"{d}/lineitem.parquet"))


def _signals(lineitem: DataFrame) -> DataFrame:
    images = lineitem.select((F.col("l_orderkey") % 100).cast("bigint").alias("page_id"), (F.col("l_quantity") * 20).cast("int").alias("width"), (F.col("l_linenumber") * 150).cast("int").alias("height"))
    pages = images.select("page_id").distinct().select("page_id", (F.col("page_id") % 3 == 0).alias("has_article"), (F.col("page_id") % 2 == 0).alias("feed_markers"))
    out = M.page_signals(images, pages)
    return out.select("page_id", "image_count", F.round("dominant_area_ratio", 9).alias("dominant"), F.round("aspect_spread", 6).alias("spread"), M.page_class().alias("page_class"))


# ---- near duplicates --------------------------------------------------------------------------------------------
def hashes(spark, d) -> DataFrame:
    """64 sign bits of every embedding in two halves."""
    bit = lambda i: F.when(F.col("embedding")[i] > 0, 1).otherwise(0).cast("bigint") * (1 << (31 - i % 32))
    half = lambda a: sum((bit(i) for i in range(a + 1, a + 32)), bit(a))
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("seq"), half(0).alias("hi"), half(32).alias("lo"), "label")


_HASH = """WITH h AS (SELECT vec_id AS seq, label, CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS BIGINT) << (31 - i) ELSE 0 END)) AS BIGINT) AS hi,
  CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 33] > 0 THEN CAST(1 AS BIGINT) << (31 - i) ELSE 0 END)) AS BIGINT) AS lo FROM embeddings)"""


@query(f"{_HASH} SELECT a.seq AS a, b.seq AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM h a, h b WHERE a.seq < b.seq AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 12")
def hamming_pairs(spark, d):
    return N.near_pairs(hashes(spark, d), 12)


_NEAR = """WITH h AS (SELECT vec_id AS seq, (vec_id // 5 * 2654435761 + vec_id // 5 % 13 * 97531) % 4294967296 AS hi,
  xor((vec_id // 5 * 3266489917 + 668265263) % 4294967296, CASE WHEN vec_id % 5 = 0 THEN 0 WHEN vec_id % 5 = 4 THEN 7 ELSE CAST(1 AS BIGINT) << CAST(vec_id % 5 * 9 AS BIGINT) END) AS lo FROM embeddings)"""


def near_hashes(spark, d) -> DataFrame:
    """Hashes in fives: the first of each, three that differ from it in a bit, and one in three."""
    five = F.expr("vec_id div 5")
    flip = F.when(F.col("vec_id") % 5 == 0, F.lit(0)).when(F.col("vec_id") % 5 == 4, F.lit(7)).otherwise(F.expr("shiftleft(cast(1 as bigint), cast(vec_id % 5 * 9 as int))")).cast("bigint")
    hi, lo = F.pmod(five * 2654435761 + five % 13 * 97531, F.lit(4294967296)), F.pmod(five * 3266489917 + 668265263, F.lit(4294967296))
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("seq"), hi.alias("hi"), lo.bitwiseXOR(flip).alias("lo"))


@query(f"{_NEAR} SELECT a.seq AS a, b.seq AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM h a, h b WHERE a.seq < b.seq AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8")
def near_hash_pairs(spark, d):
    return N.near_pairs(near_hashes(spark, d))


@query(f"""{_NEAR}, p AS (SELECT a.seq AS a, b.seq AS b, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3 AS near FROM h a, h b WHERE a.seq <= b.seq)
SELECT b AS seq, min(a) AS cluster FROM p WHERE near GROUP BY b""")
def near_hash_clusters(spark, d):
    """At this threshold two of the fives' members are near, or their first one is far from all others."""
    return N.clusters(near_hashes(spark, d), 4)


@query()
def near_dup_cluster(spark, d):
    return N.clusters(hashes(spark, d), 12)


@query(f"{_HASH} SELECT seq, n > 1 AND place > 1 AS near_duplicate, CASE WHEN n > 1 THEN keeper END AS duplicate_group FROM (SELECT seq, count(*) OVER (PARTITION BY label) AS n, row_number() OVER w AS place, first_value(seq) OVER w AS keeper FROM h WINDOW w AS (PARTITION BY label ORDER BY (hi % 100) * (lo % 100) DESC, hi % 1000 DESC, seq))")
def keeper_mark(spark, d):
    rows = hashes(spark, d).select("seq", F.col("label").alias("cluster"), (F.col("hi") % 100).cast("int").alias("width"), (F.col("lo") % 100).cast("int").alias("height"), (F.col("hi") % 1000).alias("file_size"))
    return N.keepers(rows).select("seq", "near_duplicate", "duplicate_group")
