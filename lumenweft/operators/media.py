"""Operators on media rows: eligibility, toolbar filters, facets, identity, dedup, merging, sorting.

A media row has seq (its place in collection order), src, alt, type, kind, width, height, file_size (0: unknown),
is_base64 and the optional flags unresolved_video, unresolved_image, hls_manifest, near_duplicate, media_key.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenweft.functions import scalar as S
from lumenweft.functions import url as U
from lumenweft.sources.shared import stored


@dataclass(frozen=True)
class Settings:
    minimum_image_size: int = 0
    exclude_base64: bool = False
    exclude_emoji: bool = False
    capture_hls: bool = False


@dataclass(frozen=True)
class Toolbar:
    media_kind: str = "all"
    image_type: str = "all"
    min_size_kb: float = 0
    include_base64: bool = True
    size_bucket: str = "all"
    download_state: str = "all"
    resolve_state: str = "all"
    duplicate_state: str = "unique"
    search: str = ""
    sort_by: str = "default"
    sort_dir: str = "asc"


def flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def eligible(settings: Settings) -> Column:
    """Unknown sizes pass; streams only where they can be captured."""
    least = settings.minimum_image_size
    ok = ((F.col("width") == 0) | (F.col("width") >= least)) & ((F.col("height") == 0) | (F.col("height") >= least))
    if settings.exclude_base64:
        ok &= ~flag("is_base64")
    if settings.exclude_emoji:
        ok &= ~U.is_emoji(F.col("src"))
    if not settings.capture_hls:
        ok &= F.col("hls_manifest").isNull()
    return ok


def bucket(width: Column, height: Column) -> Column:
    """small, medium or large by the larger edge; null where it is unknown."""
    edge = F.greatest(width, height)
    return F.when(edge <= 0, None).when(edge < 256, "small").when(edge < 1024, "medium").otherwise("large")


def pending() -> Column:
    return flag("unresolved_video") | flag("unresolved_image")


def pending_or_stream() -> Column:
    return pending() | F.col("hls_manifest").isNotNull()


def hash_candidate() -> Column:
    return (F.col("kind") == "image") & ~flag("is_base64") & ~pending_or_stream() & F.col("src").rlike(r"(?i)^https?://")


def convertible(target: str) -> Column:
    """A raster image that is not base64 and not of the target type already."""
    return (F.col("kind") == "image") & F.col("type").isin("jpeg", "png", "webp", "avif", "bmp") & ~flag("is_base64") & (F.col("type") != target)


def name_of() -> Column:
    return F.coalesce(U.original_name(F.col("src")), F.col("src"))


def matches_search(text: str) -> Column:
    q = text.strip().lower()
    if not q:
        return F.lit(True)
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    return has(name_of()) | has(F.col("alt")) | has(F.col("type")) | has(F.col("src"))


def toolbar(items: DataFrame, t: Toolbar, downloaded: DataFrame | None = None) -> DataFrame:
    """The rows that the toolbar shows. downloaded: keys (column key) of what is on disk."""
    ok = F.lit(True)
    if t.duplicate_state != "all":
        ok &= flag("near_duplicate") if t.duplicate_state == "duplicates" else ~flag("near_duplicate")
    if t.media_kind != "all":
        ok &= F.col("kind") == t.media_kind
    if t.size_bucket != "all":
        ok &= F.coalesce(bucket(F.col("width"), F.col("height")), F.lit(t.size_bucket)) == t.size_bucket
    if t.image_type != "all":
        family = "image" if t.media_kind == "all" else t.media_kind
        ok &= (F.col("kind") != family) | (F.col("type") == t.image_type)
    least = t.min_size_kb * 1024 if t.min_size_kb == t.min_size_kb and abs(t.min_size_kb) != float("inf") else 0
    if least > 0:
        ok &= (F.col("file_size") <= 0) | (F.col("file_size") >= least)
    if not t.include_base64:
        ok &= ~flag("is_base64")
    if t.resolve_state != "all":
        ok &= pending() if t.resolve_state == "pending" else ~pending()
    out = items.where(ok & matches_search(t.search))
    if t.download_state != "all":
        how = "left_semi" if t.download_state == "downloaded" else "left_anti"
        keys = (downloaded if downloaded is not None else items.limit(0).select(F.lit("").alias("key"))).select(F.col("key").alias("_key")).distinct()
        out = out.withColumn("_key", U.canonical_key(F.col("src"))).join(keys, "_key", how).drop("_key")
    return out


def sorted_items(items: DataFrame, by: str, direction: str = "asc") -> DataFrame:
    """Stable. Unknown sizes and areas come last in either direction; names in natural order."""
    turn = (lambda c: c.asc()) if direction == "asc" else (lambda c: c.desc())
    if by == "default":
        return items.orderBy("seq")
    if by == "name":
        return items.orderBy(turn(S.natural_key(name_of())), "seq")
    if by == "type":
        return items.orderBy(turn(F.col("type")), turn(F.lower(name_of())), "seq")
    value = F.col("file_size") if by == "size" else F.col("width").cast("bigint") * F.col("height")
    return items.orderBy((value == 0).asc(), turn(value), "seq")


def without_excluded(items: DataFrame, excluded: DataFrame) -> DataFrame:
    """items but for those whose key, or whose site, is in excluded (value, kind: url or host)."""
    keys = excluded.where("kind = 'url'").select(U.canonical_key(F.col("value")).alias("_key")).distinct()
    sites = excluded.where("kind = 'host'").select(U.registrable_domain(F.lower("value")).alias("_site")).where("_site <> ''").distinct()
    marked = items.withColumn("_key", U.canonical_key(F.col("src"))).withColumn("_site", U.registrable_domain(U.host(F.col("src"))))
    return marked.join(keys, "_key", "left_anti").join(sites, "_site", "left_anti").drop("_key", "_site")


def by_downloaded(items: DataFrame, on_disk: DataFrame) -> DataFrame:
    """items plus downloaded: whether its key is in on_disk (src)."""
    keys = on_disk.select(U.canonical_key(F.col("src")).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    return items.withColumn("_key", U.canonical_key(F.col("src"))).join(keys, "_key", "left").withColumn("downloaded", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")


def facets(items: DataFrame) -> DataFrame:
    """facet, value, place: kinds and sizes in their fixed order, the formats of each kind in order of appearance."""
    kinds = items.groupBy("kind").agg(F.min("seq").alias("s")).select(F.lit("kind").alias("facet"), F.col("kind").alias("value"), F.array_position(F.array(*map(F.lit, ("image", "video", "audio"))), F.col("kind")).alias("place"))
    formats = items.where("type is not null and type not in ('', 'unknown')").groupBy("kind", "type").agg(F.min("seq").cast("bigint").alias("place"))
    formats = formats.select(F.concat(F.lit("format:"), "kind").alias("facet"), F.col("type").alias("value"), "place")
    sizes = items.select(bucket(F.col("width"), F.col("height")).alias("value")).where("value is not null").distinct()
    sizes = sizes.select(F.lit("size").alias("facet"), "value", F.array_position(F.array(*map(F.lit, ("small", "medium", "large"))), F.col("value")).alias("place"))
    return kinds.unionByName(formats).unionByName(sizes)


def identity() -> Column:
    return F.coalesce(F.when(F.col("media_key") != "", F.col("media_key")), U.canonical_key(F.col("src")))


def first_seen(items: DataFrame) -> DataFrame:
    """The first row of each page and key. For rows without a media_key."""
    best = items.groupBy("page_id", U.canonical_key(F.col("src")).alias("_key")).agg(F.min_by(F.struct(*items.columns), "seq").alias("_row"))
    return best.select("_row.*")


def scan_dedup(items: DataFrame, page: str = "page_id") -> DataFrame:
    """What a scan of a page (rows of one value of the column page) keeps: a row goes if its media_key was kept before, else if its key was.

    Rows that their media_key rules out go first, and of the others the first of each key stays. Only where the first row
    of a repeated media_key goes for its key does the order of the two tests matter, as then its media_key is not taken:
    such a page's rows are folded in order. A page is bounded by what one page holds.
    """
    schema = items.schema
    own = F.coalesce(F.nullif("media_key", F.lit("")), F.concat(F.lit("\x00"), F.col("seq").cast("string")))
    rows = items.withColumn("_key", U.canonical_key(F.col("src"))).withColumn("_mk", own)
    in_page = W.partitionBy(page, "_mk")
    rows = rows.withColumn("_nth", F.row_number().over(in_page.orderBy("seq"))).withColumn("_all", F.count(F.lit(1)).over(in_page))
    first = F.col("_nth") == 1
    rows = rows.withColumn("_place", F.when(first, F.row_number().over(W.partitionBy(page, "_key", "_nth").orderBy("seq"))))
    rows = stored(rows.withColumn("_clash", F.max(first & (F.col("_all") > 1) & (F.col("_place") > 1)).over(W.partitionBy(page))), "identities")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        keys, media, keep = set(), set(), []
        for key, mk in zip(rows["_key"], rows["_mk"], strict=True):
            keep.append(mk not in media and key not in keys)
            if keep[-1]:
                keys.add(key)
                media.add(mk)
        return rows.loc[keep, schema.names]

    kept = rows.where("not _clash and _place = 1").select(*schema.names)
    clashing = rows.where("_clash")
    return kept if clashing.isEmpty() else kept.unionByName(clashing.groupBy(page).applyInPandas(fold, schema))


def keep_largest(items: DataFrame) -> DataFrame:
    """One row for each key, the largest (area, then bytes, then first), with slot: where the key first appeared."""
    rank = F.struct((F.col("width").cast("bigint") * F.col("height")).alias("area"), F.col("file_size").alias("size"), (-F.col("seq")).alias("first"))
    best = items.groupBy(U.canonical_key(F.col("src")).alias("_key")).agg(F.max_by(F.struct(*items.columns), rank).alias("_row"), F.min("seq").alias("slot"))
    return best.select("_row.*", "slot")


def merge_scanned(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Both, once each: found rows with a media_key take the place of what had it; else the first stays. With slot."""
    columns = existing.columns
    both = existing.withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1))).withColumn("_id", identity())
    order = F.struct("_new", "seq")
    replaces = (F.col("_new") == 1) & (F.coalesce(F.col("media_key"), F.lit("")) != "")
    # replacing rows rank above all others, the last of them first; of the others the first
    rank = F.struct(replaces.alias("r"), F.when(replaces, F.col("seq")).otherwise(F.lit(0)).alias("l"), F.when(replaces, 0).otherwise(-F.col("_new")).alias("n"), F.when(replaces, 0).otherwise(-F.col("seq")).alias("s"))
    out = both.groupBy("_id").agg(F.max_by(F.struct(*columns), rank).alias("_row"), F.min(order).alias("_first"))
    return out.select("_row.*", F.struct(F.col("_first._new").alias("round"), F.col("_first.seq").alias("seq")).alias("slot"))


def apply_resolved(items: DataFrame, resolved: DataFrame, capture_hls: bool) -> DataFrame:
    """Pending rows take the src that was found for them: a stream only where it can be captured; flags go."""
    found = resolved.select(F.col("src").alias("_src"), F.col("url").alias("_url"), F.col("hls").alias("_hls")).dropDuplicates(["_src"])
    out = items.join(found, items["src"] == found["_src"], "left")
    use = F.col("_url").isNotNull() & (F.lit(capture_hls) | ~F.coalesce(F.col("_hls"), F.lit(False)))
    stream = use & F.coalesce(F.col("_hls"), F.lit(False))
    values = {
        "src": F.when(use, F.col("_url")).otherwise(F.col("src")),
        "type": F.when(stream, "m3u8").when(use & (F.col("kind") == "image"), U.detect_type(F.col("_url"))).when(use, U.av_type(F.col("_url"))).otherwise(F.col("type")),
        "unresolved_video": F.when(use, F.lit(None)).otherwise(F.col("unresolved_video")),
        "unresolved_image": F.when(use, F.lit(None)).otherwise(F.col("unresolved_image")),
        "hls_manifest": F.when(stream, F.col("_url")).otherwise(F.col("hls_manifest")),
    }
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in items.columns])


def still_on_disk(history: DataFrame, disk: DataFrame) -> DataFrame:
    """history but for entries whose download is known to be deleted; without an id, or unknown, they stay."""
    state = disk.select("download_id", F.when(F.col("exists"), "present").otherwise("deleted").alias("_state"))
    return history.join(state, "download_id", "left").where(F.coalesce("_state", F.lit("unknown")) != "deleted").drop("_state")


def route(items: DataFrame, target: str | None = None) -> DataFrame:
    """items plus route: stream, convert or regular."""
    to = F.when(F.col("hls_manifest").isNotNull(), "stream")
    return items.withColumn("route", (to.when(convertible(target), "convert") if target else to).otherwise("regular"))


def selected(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen rows (src) that can be downloaded at once."""
    return items.where(~pending_or_stream()).join(chosen.select("src").distinct(), "src", "left_semi")


def badge(items: DataFrame, settings: Settings) -> DataFrame:
    return items.where(eligible(settings)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def page_signals(images: DataFrame, pages: DataFrame, viewport: int = 1280 * 800) -> DataFrame:
    """image_count, density, aspect_spread, dominant_area_ratio of every page; has_article and feed_markers are carried."""
    area = F.col("width").cast("double") * F.col("height")
    ratio = F.when((F.col("height") > 0) & (F.col("width") > 0), F.col("width") / F.col("height"))
    per = images.groupBy("page_id").agg(F.count(F.lit(1)).alias("image_count"), F.sum(area).alias("_sum"), F.max(area).alias("_max"), F.var_pop(ratio).alias("aspect_spread"))
    out = pages.join(per, "page_id", "left")
    n = F.coalesce(F.col("image_count"), F.lit(0))
    return out.select(
        "page_id", n.alias("image_count"), (n * 40000 / viewport).alias("density"), F.coalesce("aspect_spread", F.lit(0.0)).alias("aspect_spread"),
        F.when(F.col("_sum") > 0, F.col("_max") / F.col("_sum")).otherwise(0.0).alias("dominant_area_ratio"), "has_article", "feed_markers",
    )


def page_class() -> Column:
    c = F.col
    return (
        F.when((c("image_count") <= 5) & (c("dominant_area_ratio") >= 0.75), "single-media")
        .when((c("image_count") >= 20) & (c("density") >= 0.5) & (c("aspect_spread") < 0.1), "gallery")
        .when(c("feed_markers") & (c("image_count") >= 10), "feed")
        .when(c("has_article"), "article")
        .otherwise("unknown")
    )


# ---- names ------------------------------------------------------------------------------------------------------
def unique_names(plan: DataFrame, style: str = "dash") -> DataFrame:
    """plan (batch_id, seq, path) plus unique_path. dash: name-2.ext, whatever the case; zip: name (2).ext, by case.

    A made-up name may itself be taken, so each batch is folded in order. A batch is what one request downloads.
    Names stay taken, so a path's next number is looked for from its last one on.
    """
    fmt, fold_case = ("{}-{}{}", True) if style == "dash" else ("{} ({}){}", False)

    def fold(batches: pd.DataFrame) -> pd.DataFrame:
        batches = batches.sort_values("seq", kind="stable")
        taken: set[str] = set()
        tried: dict[str, int] = {}
        out = []
        for p in batches["path"]:
            folder, slash, file = p.rpartition("/")
            dot = file.rfind(".")
            base, ext = (file[:dot], file[dot:]) if dot > 0 else (file, "")
            # the letters of a name beyond ASCII may depend on their neighbours in lower case, so only those spelled alike go together
            key = p.lower() if fold_case and p.isascii() else p
            n = tried.get(key, 1)
            name = p if n == 1 else folder + slash + fmt.format(base, n, ext)
            while (name.lower() if fold_case else name) in taken:
                n += 1
                name = folder + slash + fmt.format(base, n, ext)
            tried[key] = n
            taken.add(name.lower() if fold_case else name)
            out.append(name)
        return batches.assign(unique_path=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema) + ", unique_path string"
    return plan.groupBy("batch_id").applyInPandas(fold, schema)


def byte_budget(rows: DataFrame, partition: list[str], order: list[Column], size: Column, most: int) -> DataFrame:
    """The leading rows whose sizes sum up to the budget; the first one at any rate."""
    w = W.partitionBy(*partition).orderBy(*order)
    total = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_n", F.row_number().over(w)).withColumn("_total", total).where((F.col("_n") == 1) | (F.col("_total") <= most)).drop("_n", "_total")


def merge_entries(existing: DataFrame, added: DataFrame, cap: int = 500, budget: int | None = 2_000_000, partition: tuple[str, ...] = ()) -> DataFrame:
    """History or favourites (src, time_ms, seq): added ones beat existing ones of their key, the newest of them wins; newest first, capped by number and bytes."""
    columns = existing.columns
    both = added.withColumn("_rank", F.lit(0)).unionByName(existing.withColumn("_rank", F.lit(1))).withColumn("_key", U.canonical_key(F.col("src")))
    best = W.partitionBy(*partition, "_key").orderBy("_rank", F.when(F.col("_rank") == 0, -F.col("time_ms")), "seq")
    kept = both.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    order = [F.col("time_ms").desc(), F.col("_rank").asc(), F.col("seq").asc()]
    newest = W.partitionBy(*partition).orderBy(*order)
    kept = kept.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= cap)
    if budget is not None:
        kept = byte_budget(kept, list(partition), order, F.octet_length(F.to_json(F.struct(*[c for c in columns if c != "seq"]))), budget)
    return kept.select(*columns)
