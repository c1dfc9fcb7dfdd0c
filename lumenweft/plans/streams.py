"""Queries over manifests that are made from the supplier table, one HLS master, one media playlist and one MPD each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.functions import scalar as S
from lumenweft.operators import manifest as P



def _made(spark, d, *lines) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet")
    key = F.col("s_suppkey").cast("string")
    body = F.concat_ws("\n", *[x if not isinstance(x, str) else F.lit(x) for x in lines])
    return s.select(key.alias("manifest_id"), F.concat(F.lit("https://cdn.example/v/"), key, F.lit("/m.m3u8")).alias("url"), body.alias("body"))


def masters(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    tag = lambda rate, size, extra="": F.concat(F.lit("#EXT-X-STREAM-INF:AVERAGE-BANDWIDTH="), rate.cast("string"), F.lit(f',BANDWIDTH=9,RESOLUTION={size},CODECS="avc1.4d,mp4a.40",AUDIO="aud"{extra}'))
    return _made(
        spark, d, "#EXTM3U", '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aud",NAME="one",URI="a1.m3u8"', '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aud",NAME="two",DEFAULT=YES,URI="/a2.m3u8"', '#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="s",NAME="t",URI="s.m3u8"',
        tag(1_000_000 + k * 1000, "1280x720"), "720.m3u8", tag(5_000_000 - k, "1920x1080"), "# note", "/1080.m3u8", tag(900_000 + k * 3000, "1280x720"), "https://other.example/b.m3u8",
    )


def playlists(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    key = F.when(k % 3 == 0, '#EXT-X-KEY:METHOD=AES-128,URI="k.bin"').when(k % 3 == 1, '#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k.bin"').otherwise("#EXT-X-VERSION:4")
    return _made(
        spark, d, "#EXTM3U", F.concat(F.lit("#EXT-X-MEDIA-SEQUENCE:"), k.cast("string")), "#EXTINF:4.5,", "#EXT-X-BYTERANGE:100@50", "s.ts", key, "#EXTINF:3,", "#EXT-X-BYTERANGE:70", "s.ts", "#EXT-X-KEY:METHOD=NONE", "#EXTINF:2,", "t.ts",
        F.when(k % 5 == 0, "#EXTM3U").otherwise("#EXT-X-ENDLIST"),
    )


def mpds(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    n = (k % 4).cast("string")
    return _made(
        spark, d, '<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="static" mediaPresentationDuration="PT1M10S"><BaseURL>base/</BaseURL><Period><AdaptationSet mimeType="video/mp4">',
        F.concat(F.lit('<SegmentTemplate media="$RepresentationID$-$Number%04d$.m4s" timescale="10" startNumber="5"><SegmentTimeline><S t="0" d="100" r="'), n, F.lit('"/><S d="50"/></SegmentTimeline></SegmentTemplate>')),
        F.concat(F.lit('<Representation id="v1" bandwidth="'), (k * 100).cast("string"), F.lit('" width="1280" height="720"/><Representation id="v2" bandwidth="500" width="640" height="360"/></AdaptationSet>')),
        F.when(k % 7 == 0, "<AdaptationSet><ContentProtection/></AdaptationSet>").otherwise(""),
        '<AdaptationSet contentType="audio"><SegmentTemplate media="a-$Time$.m4s" duration="200" timescale="10"/><Representation id="a" bandwidth="64"/></AdaptationSet></Period></MPD>',
    )


def hls_master(spark, d):
    return P.hls_variants(masters(spark, d)).select("manifest_id", "uri", "bandwidth", "width", "height", "codecs", "audio_group")


def hls_select(spark, d):
    return P.variant_audio(P.select_variant(P.hls_variants(masters(spark, d)), 700), P.audio_renditions(masters(spark, d))).select("manifest_id", "uri", "audio_uri")


def hls_picker(spark, d):
    return P.picker(P.hls_variants(masters(spark, d)))


def hls_key_carry(spark, d):
    return P.hls_segments(playlists(spark, d)).select("manifest_id", "ord", "seq", F.col("duration"), "key_method", "key_uri", "range_len", "range_off")


def hls_policy(spark, d):
    return P.hls_policy(playlists(spark, d))


def dash_timeline(spark, d):
    return P.dash_segments(P.dash_representations(mpds(spark, d))).select("manifest_id", "id", "ord", "number", "time", "uri")


def dash_policy(spark, d):
    return P.dash_policy(P.dash_representations(mpds(spark, d)))


def dash_select(spark, d):
    return P.select_representation(P.dash_representations(mpds(spark, d)), 720).select("manifest_id", "id", "bandwidth")


def stream_commands(spark, d):
    m = masters(spark, d)
    return m.select("manifest_id", S.stream_command(F.col("url"), "yt-dlp", referer=F.lit("https://a.b/it's"), quality=F.lit("auto")).alias("best"), S.stream_command(F.col("url"), "ffmpeg", audio_only=True).alias("audio"))


QUERIES = {f.__name__: f for f in (hls_master, hls_select, hls_picker, hls_key_carry, hls_policy, dash_timeline, dash_policy, dash_select, stream_commands)}
_S = "s AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS manifest_id, 'https://cdn.example/v/' || s_suppkey || '/' AS base FROM supplier)"
_V = f"""WITH {_S}, v AS (SELECT manifest_id, base || '720.m3u8' AS uri, CAST(1000000 + k * 1000 AS BIGINT) AS bandwidth, 1280 AS width, 720 AS height FROM s
UNION ALL SELECT manifest_id, 'https://cdn.example/1080.m3u8', 5000000 - k, 1920, 1080 FROM s UNION ALL SELECT manifest_id, 'https://other.example/b.m3u8', 900000 + k * 3000, 1280, 720 FROM s)"""
ORACLES = {
    "hls_master": f"{_V} SELECT *, 'avc1.4d,mp4a.40' AS codecs, 'aud' AS audio_group FROM v",
    "hls_select": f"{_V} SELECT manifest_id, uri, 'https://cdn.example/a2.m3u8' AS audio_uri FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY bandwidth DESC, uri) AS n FROM v WHERE height = 720) WHERE n = 1",
    "hls_picker": f"{_V}, b AS (SELECT manifest_id, height, max(bandwidth) AS bandwidth FROM v GROUP BY ALL) SELECT *, height || 'p · ' || CASE WHEN bandwidth >= 1000000 THEN printf('%.1f Mbps', bandwidth / 1000000.0) ELSE CAST(CAST(floor(bandwidth / 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || ' kbps' END AS label FROM b",
    "hls_key_carry": f"""WITH {_S} SELECT manifest_id, o AS ord, k + o AS seq, CAST(CASE o WHEN 0 THEN 4.5 WHEN 1 THEN 3 ELSE 2 END AS DOUBLE) AS duration, CASE WHEN o = 1 AND k % 3 = 0 THEN 'AES-128' WHEN o = 1 AND k % 3 = 1 THEN 'SAMPLE-AES' END AS key_method,
  CASE WHEN o = 1 AND k % 3 < 2 THEN base || 'k.bin' END AS key_uri, CAST(CASE o WHEN 0 THEN 100 WHEN 1 THEN 70 END AS BIGINT) AS range_len, CAST(CASE o WHEN 0 THEN 50 WHEN 1 THEN 150 END AS BIGINT) AS range_off FROM s, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS o)""",
    "hls_policy": f"WITH {_S} SELECT manifest_id, CASE WHEN k % 5 = 0 THEN 'live' WHEN k % 3 = 1 THEN 'sample-aes' END AS refusal FROM s",
    "dash_timeline": f"""WITH {_S}, e AS (SELECT *, unnest(range(0, k % 4 + 2)) AS o FROM s), a AS (SELECT *, unnest(range(0, 4)) AS o FROM s)
SELECT manifest_id, id, CAST(o AS BIGINT) AS ord, CAST(5 + o AS BIGINT) AS number, CAST(o * 100 AS BIGINT) AS time, base || 'base/' || id || '-' || lpad(CAST(5 + o AS VARCHAR), 4, '0') || '.m4s' AS uri FROM e, (SELECT unnest(['v1', 'v2']) AS id)
UNION ALL SELECT manifest_id, 'a', o, 1 + o, o * 200, base || 'base/a-' || (o * 200) || '.m4s' FROM a""",
    "dash_policy": f"WITH {_S} SELECT manifest_id, CASE WHEN k % 7 = 0 THEN 'drm' END AS refusal FROM s",
    "dash_select": f"WITH {_S} SELECT manifest_id, 'v1' AS id, k * 100 AS bandwidth FROM s",
    "stream_commands": f"""WITH {_S} SELECT manifest_id, 'yt-dlp -S ''res:720'' --referer ''https://a.b/it''\\''''s'' ''' || base || 'm.m3u8''' AS best, 'ffmpeg -i ''' || base || 'm.m3u8'' -vn -c:a copy ''out.m4a''' AS audio FROM s""",
}
