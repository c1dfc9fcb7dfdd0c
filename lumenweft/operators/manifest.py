"""HLS and DASH manifests as tables: variants, renditions, segments, selection and policy. Nothing is fetched."""

from __future__ import annotations

import math
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenweft.functions import scalar as S
from lumenweft.functions.url import absolute

DRM_FORMATS = r"(?i)widevine|playready|fairplay|com\.apple\.streamingkeydelivery|urn:uuid"
VIDEO_CODEC = r"(?i)(?:^|[,.\s])(?:avc1|avc3|hvc1|hev1|vp0?9|av01|dvh1|dvhe|mp4v)"
MAX_DASH_SEGMENTS = 100_000


def lines(manifests: DataFrame) -> DataFrame:
    """(manifest_id, url, n, line) of every line that is not empty."""
    each = manifests.select("manifest_id", "url", F.posexplode(F.split("body", r"\r?\n")).alias("n", "raw"))
    return each.select("manifest_id", "url", "n", F.trim("raw").alias("line")).where("line <> ''")


def attribute(line: Column, name: str) -> Column:
    """The value of an attribute of a tag's list, without quotes; null if it is missing. Commas inside of quotes are part of it."""
    found = F.regexp_extract(line, rf'(?:[:,]|^)\s*{name}=("[^"]*"|[^,]*)', 1)
    present = line.rlike(rf"(?:[:,]|^)\s*{name}=")
    return F.when(present, F.regexp_replace(found, r'^"|"$', ""))


def hls_variants(manifests: DataFrame) -> DataFrame:
    """The variant streams of master playlists: the next line that is no comment is a variant's address."""
    after = W.partitionBy("manifest_id").orderBy("n").rowsBetween(1, W.unboundedFollowing)
    all_lines = lines(manifests).withColumn("uri", F.first(F.when(~F.col("line").startswith("#"), F.col("line")), ignorenulls=True).over(after))
    tags = all_lines.where(F.col("line").startswith("#EXT-X-STREAM-INF:") & F.col("uri").isNotNull())
    a = lambda k: attribute(F.col("line"), k)
    size = lambda g: F.regexp_extract(a("RESOLUTION"), r"(\d+)x(\d+)", g).try_cast("int")
    rate = F.coalesce(F.when(a("AVERAGE-BANDWIDTH") != "", a("AVERAGE-BANDWIDTH")), a("(?<!-)BANDWIDTH"), F.lit("0")).try_cast("bigint")
    return tags.select(
        "manifest_id", F.col("n").alias("ord"), absolute(F.col("uri"), F.col("url")).alias("uri"), rate.alias("bandwidth"), size(1).alias("width"), size(2).alias("height"), a("CODECS").alias("codecs"), a("NAME").alias("name"),
        F.when(a("AUDIO") != "", a("AUDIO")).alias("audio_group"),
    )


def audio_renditions(manifests: DataFrame) -> DataFrame:
    a = lambda k: attribute(F.col("line"), k)
    tags = lines(manifests).where(F.col("line").startswith("#EXT-X-MEDIA:") & (a("TYPE") == "AUDIO"))
    uri = F.when(a("URI") != "", absolute(a("URI"), F.col("url")))
    return tags.select("manifest_id", F.col("n").alias("ord"), F.coalesce(a("GROUP-ID"), F.lit("")).alias("group_id"), a("(?<![A-Z-])NAME").alias("name"), a("LANGUAGE").alias("language"), (F.coalesce(a("DEFAULT"), F.lit("")) == "YES").alias("is_default"), uri.alias("uri"))


def select_variant(variants: DataFrame, quality: str | int = "highest") -> DataFrame:
    """One variant of each manifest: by bandwidth, or the nearest to a height (the higher bandwidth of as near ones)."""
    w = W.partitionBy("manifest_id")
    if quality == "lowest":
        order = [F.col("bandwidth").asc(), F.col("ord").asc()]
    elif isinstance(quality, int):
        known = F.max(F.col("height").isNotNull()).over(w)
        gap = F.when(F.col("height").isNotNull(), F.abs(F.col("height") - quality))
        variants = variants.withColumn("_known", known)
        order = [F.when(F.col("_known"), gap).asc_nulls_last(), F.col("bandwidth").desc(), F.when(F.col("_known"), F.col("ord")).otherwise(-F.col("ord")).asc()]
    else:
        order = [F.col("bandwidth").desc(), F.col("ord").desc()]
    return variants.withColumn("_n", F.row_number().over(w.orderBy(*order))).where("_n = 1").drop("_n", "_known")


def variant_audio(chosen: DataFrame, renditions: DataFrame) -> DataFrame:
    """The chosen variants' audio: the default rendition of the group, else the first with an address."""
    with_uri = renditions.where("uri is not null").select("manifest_id", F.col("group_id").alias("audio_group"), F.col("ord").alias("audio_ord"), F.col("uri").alias("audio_uri"), "is_default")
    w = W.partitionBy("manifest_id", "ord").orderBy(F.col("is_default").desc(), "audio_ord")
    return chosen.join(with_uri, ["manifest_id", "audio_group"], "left").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "audio_ord", "is_default")


def picker(variants: DataFrame) -> DataFrame:
    """One entry for each height, of its highest bandwidth, with a label."""
    best = variants.where("height > 0").groupBy("manifest_id", "height").agg(F.max("bandwidth").alias("bandwidth"))
    return best.withColumn("label", S.variant_label(F.col("height"), F.col("bandwidth")))


def hls_segments(manifests: DataFrame) -> DataFrame:
    """The segments of media playlists with their keys, sequence numbers and byte ranges.

    A key holds until the next key tag; METHOD=NONE ends it, so what is carried forward is a struct and never null once
    a tag was seen. A range without an offset begins where the one before ended.
    """
    a = lambda k: attribute(F.col("line"), k)
    so_far = W.partitionBy("manifest_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    line = F.col("line")
    tag = lambda t: line.startswith(t)
    rows = lines(manifests).withColumn("is_segment", ~line.startswith("#"))
    key = F.when(tag("#EXT-X-KEY:"), F.struct(a("METHOD").alias("method"), F.when(a("URI") != "", absolute(a("URI"), F.col("url"))).alias("uri"), a("IV").alias("iv"), a("KEYFORMAT").alias("format")))
    rows = rows.withColumn("key", F.last(key, ignorenulls=True).over(so_far))
    rows = rows.withColumn("group", F.sum(F.col("is_segment").cast("int")).over(so_far) - F.col("is_segment").cast("int"))
    own = W.partitionBy("manifest_id", "group").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    duration = F.last(F.when(tag("#EXTINF:"), F.regexp_extract(line, r"^#EXTINF:\s*([\d.]+)", 1).try_cast("double")), ignorenulls=True).over(own)
    ranged = F.last(F.when(tag("#EXT-X-BYTERANGE:"), F.substring(line, 18, 100)), ignorenulls=True).over(own)
    first_seq = F.last(F.when(tag("#EXT-X-MEDIA-SEQUENCE:"), F.regexp_extract(line, r":\s*(\d+)", 1).try_cast("bigint")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("duration", F.coalesce(duration, F.lit(0.0))).withColumn("range", ranged).withColumn("seq", F.coalesce(first_seq, F.lit(0)) + F.col("group"))
    segments = rows.where("is_segment").withColumn("length", F.substring_index("range", "@", 1).try_cast("bigint")).withColumn("offset", F.when(F.contains("range", F.lit("@")), F.substring_index("range", "@", -1).try_cast("bigint")))
    ranges = W.partitionBy("manifest_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    segments = segments.withColumn("chain", F.sum(F.when(F.col("offset").isNotNull(), 1).otherwise(0)).over(ranges))
    chain = W.partitionBy("manifest_id", "chain").orderBy("n")
    begin = F.coalesce(F.max("offset").over(chain.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0))
    before = F.coalesce(F.sum("length").over(chain.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    clear = F.coalesce(F.col("key.method"), F.lit("NONE")) == "NONE"
    return segments.select(
        "manifest_id", F.col("group").cast("int").alias("ord"), absolute(line, F.col("url")).alias("uri"), "duration", "seq", *[F.when(~clear, F.col(f"key.{k}")).alias(f"key_{k}") for k in ("method", "uri", "iv", "format")],
        F.col("length").alias("range_len"), F.when(F.col("length").isNotNull(), begin + before).alias("range_off"),
    )


def hls_policy(manifests: DataFrame) -> DataFrame:
    """manifest_id, refusal: live, empty, then the first segment's drm, sample-aes or unsupported-key; null if it may be saved."""
    ended = lines(manifests).groupBy("manifest_id").agg(F.max(F.col("line").startswith("#EXT-X-ENDLIST")).alias("ended"))
    why = (
        F.when(F.col("key_method").isNull(), None)
        .when(F.coalesce(F.col("key_format"), F.lit("")).rlike(DRM_FORMATS), "drm")
        .when(F.col("key_method") == "SAMPLE-AES", "sample-aes")
        .when((F.col("key_method") != "AES-128") | F.col("key_uri").isNull(), "unsupported-key")
    )
    per = hls_segments(manifests).withColumn("why", why).groupBy("manifest_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("why", F.when(F.col("why").isNotNull(), F.col("ord"))).alias("why"))
    out = manifests.select("manifest_id").join(ended, "manifest_id", "left").join(per, "manifest_id", "left")
    return out.select("manifest_id", F.when(~F.coalesce("ended", F.lit(False)), "live").when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise(F.col("why")).alias("refusal"))


def container(uri: Column, has_init: Column) -> Column:
    p = F.lower(F.regexp_extract(uri, r"^([^?]*)", 1))
    return F.when(has_init | p.endswith(".m4s") | p.endswith(".mp4"), "mp4").when(p.endswith(".m4a"), "m4a").when(p.endswith(".aac"), "aac").otherwise("ts")


def audio_only(height: Column, codecs: Column) -> Column:
    return height.isNull() & F.coalesce(~codecs.rlike(VIDEO_CODEC), F.lit(False))


def audio_bitrate(name: Column) -> Column:
    """kbit/s of an mp3 preference; null: keep the m4a."""
    return F.regexp_extract(name, r"^mp3-(128|192|320)$", 1).try_cast("int")


def iv_of(seq: Column) -> Column:
    """The 16 bytes that stand in for a missing IV: the sequence number, big-endian."""
    return F.unhex(F.lpad(F.hex(seq.cast("bigint")), 32, "0"))


# ---- DASH -------------------------------------------------------------------------------------------------------
DASH_SCHEMA = (
    "manifest_id string, is_live boolean, has_drm boolean, duration double, ord int, kind string, id string, bandwidth bigint, width int, height int, codecs string, base_url string, "
    "initialization string, media string, start_number bigint, timescale bigint, seg_duration double, timeline array<struct<t:bigint,d:bigint,r:bigint>>"
)


def _seconds(text: str | None) -> float:
    import re

    m = re.fullmatch(r"PT(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?", (text or "").strip())
    return sum(float(v or 0) * k for v, k in zip(m.groups(), (3600, 60, 1), strict=True)) if m else 0.0


def parse_mpd(manifest_id: str, xml: str, url: str) -> list[tuple]:
    """The representations of the first period as rows of DASH_SCHEMA; a manifest without any gives one row of nulls."""
    from xml.etree import ElementTree

    local = lambda e: e.tag.rpartition("}")[2]
    kids = lambda e, name: [c for c in e if local(c) == name]
    number = lambda v: None if v is None else int(float(v))

    def base(at: str, e) -> str:
        found = kids(e, "BaseURL")
        return urljoin(at, (found[0].text or "").strip()) if found and (found[0].text or "").strip() else at

    try:
        mpd = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    if local(mpd) != "MPD":
        return []
    live, drm = mpd.get("type", "static") == "dynamic", any(local(e) == "ContentProtection" for e in mpd.iter())
    duration, periods = _seconds(mpd.get("mediaPresentationDuration")), kids(mpd, "Period")
    rows: list[tuple] = []
    if periods:
        p = periods[0]
        own = _seconds(p.get("duration"))
        if len(periods) > 1:
            after = _seconds(periods[1].get("start"))
            duration = own or (after - _seconds(p.get("start")) if after else duration)
        duration = duration or own
        at = base(base(url, mpd), p)
        for group in kids(p, "AdaptationSet"):
            at_group, template = base(at, group), (kids(group, "SegmentTemplate") or [None])[0]
            for r in kids(group, "Representation"):
                mime, content = (r.get("mimeType") or group.get("mimeType") or "").lower(), group.get("contentType") or ""
                kind = "video" if mime.startswith("video/") or content == "video" else "audio" if mime.startswith("audio/") or content == "audio" else None
                if kind is None:
                    continue
                t = (kids(r, "SegmentTemplate") or [template])[0]
                get = (lambda k: None) if t is None else t.get
                line = [] if t is None else kids(t, "SegmentTimeline")
                timeline = [(number(s.get("t")), number(s.get("d")) or 0, number(s.get("r")) or 0) for s in kids(line[0], "S")] if line else None
                start = number(get("startNumber"))
                rows.append((manifest_id, live, drm, duration, len(rows), kind, r.get("id") or "", number(r.get("bandwidth")) or 0, number(r.get("width")), number(r.get("height")), r.get("codecs") or group.get("codecs"), base(at_group, r),
                             get("initialization"), get("media"), 1 if start is None else start, number(get("timescale")) or 1, None if get("duration") is None else float(get("duration")), timeline))
    return rows or [(manifest_id, live, drm, duration, *[None] * 14)]


def dash_representations(manifests: DataFrame) -> DataFrame:
    """Arrow batches of manifests through an XML parser: inheritance of base addresses and templates is a walk of a tree."""
    names = [c.split()[0] for c in DASH_SCHEMA.replace("array<struct<t:bigint,d:bigint,r:bigint>>", "x").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for i, body, url in zip(f["manifest_id"], f["body"], f["url"], strict=True) for r in parse_mpd(i, body or "", url or "")]
            out = pd.DataFrame(rows, columns=names)
            out["timeline"] = [None if t is None else [dict(zip("tdr", x, strict=True)) for x in t] for t in out["timeline"]]
            yield out

    return manifests.select("manifest_id", "url", "body").mapInPandas(run, DASH_SCHEMA)


def dash_policy(representations: DataFrame, audio: bool = False) -> DataFrame:
    has = lambda k: F.max(F.coalesce(F.col("kind") == k, F.lit(False)))
    per = representations.groupBy("manifest_id").agg(F.max("is_live").alias("live"), F.max("has_drm").alias("drm"), has("video").alias("video"), has("audio").alias("audio"))
    missing = F.when(~F.col("audio"), "audio-unavailable") if audio else F.when(~F.col("video"), "no-representations")
    return per.select("manifest_id", F.when(F.col("live"), "live").when(F.col("drm"), "drm").otherwise(missing).alias("refusal"))


def dash_segments(representations: DataFrame) -> DataFrame:
    """manifest_id, id, ord, number, time, uri of every segment.

    Counts are worked out before anything is made, and representations of more than MAX_DASH_SEGMENTS are left out. A
    repeat of -1 goes on to the end of the period. The start of an entry without one is the end of the entry before.
    """
    reps = representations.where("media is not null").withColumn("timeline", F.coalesce("timeline", F.array().cast("array<struct<t:bigint,d:bigint,r:bigint>>")))
    span = F.ceil(F.col("duration") * F.col("timescale"))
    acc = F.struct(F.lit(0).cast("bigint").alias("time"), F.array().cast("array<struct<start:bigint,d:bigint,n:bigint>>").alias("out"))

    def entry(a: Column, s: Column) -> Column:
        start = F.coalesce(s["t"], a["time"])
        open_end = F.when(s["d"] > 0, F.greatest(F.lit(0), F.ceil((F.col("duration") * F.col("timescale") - start) / s["d"]) - 1)).otherwise(0)
        n = (F.when(s["r"] >= 0, s["r"]).otherwise(open_end) + 1).cast("bigint")
        return F.struct((start + n * s["d"]).cast("bigint").alias("time"), F.concat(a["out"], F.array(F.struct(start.cast("bigint").alias("start"), s["d"].alias("d"), n.alias("n")))).alias("out"))

    listed = F.aggregate("timeline", acc, entry, lambda a: a["out"])
    even = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("seg_duration").cast("bigint").alias("d"), F.greatest(F.lit(0), F.ceil(span / F.col("seg_duration"))).cast("bigint").alias("n")))
    runs = F.when(F.size("timeline") > 0, listed).when(F.coalesce("seg_duration", F.lit(0.0)) > 0, even)
    reps = reps.withColumn("runs", runs).where("runs is not null")
    total = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    each = reps.where(total <= MAX_DASH_SEGMENTS).select("*", F.posexplode("runs").alias("k", "run")).where("run.n > 0")
    done = F.aggregate(F.slice("runs", F.lit(1), F.col("k")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    each = each.withColumn("done", done).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("run.n") - 1)).alias("i"))
    each = each.withColumn("number", F.col("start_number") + F.col("done") + F.col("i")).withColumn("time", F.col("run.start") + F.col("i") * F.col("run.d"))
    uri = absolute(S.dash_template(F.col("media"), F.col("id"), F.col("number"), F.col("time"), F.col("bandwidth")), F.col("base_url"))
    return each.select("manifest_id", "id", (F.col("done") + F.col("i")).alias("ord"), "number", "time", uri.alias("uri"))


def select_representation(representations: DataFrame, quality: str | int = "highest", kind: str = "video") -> DataFrame:
    return select_variant(representations.where(F.col("kind") == kind), quality)


def segments_in(duration: float, timescale: int, length: float) -> int:
    return max(0, math.ceil(duration * timescale / length))
