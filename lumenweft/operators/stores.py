"""Stores: settings with overlays, entries with removal, backups, sidecars, link lists, mirrors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenweft.functions import url as U
from lumenweft.operators.media import byte_budget

#: name: (default, lowest, highest); the limits hold when a value is read.
NUMBERS = {"minimum_image_size": (0, 0, 10_000), "concurrency": (5, 1, 20), "near_dup_threshold": (8, 2, 16), "max_scrolls": (40, 1, 500), "max_ms": (20_000, 1000, 600_000)}


def effective(settings: DataFrame, overrides: DataFrame) -> DataFrame:
    """settings (host, page_id, the global values) with per-host overrides (host, field, value): host, then global, then default; clamped."""
    wide = overrides.where(F.col("field").isin(*NUMBERS)).groupBy("host").pivot("field", list(NUMBERS)).agg(F.first("value"))
    wide = wide.select("host", *[F.col(n).alias(f"_o_{n}") for n in NUMBERS])
    out = settings.join(wide, "host", "left")

    def value(n: str) -> Column:
        default, lo, hi = NUMBERS[n]
        stated = F.col(n).try_cast("double") if n in settings.columns else F.lit(None).cast("double")
        return F.least(F.lit(hi), F.greatest(F.lit(lo), F.floor(F.coalesce(F.col(f"_o_{n}").try_cast("double"), stated, F.lit(float(default)))))).cast("int").alias(n)

    return out.select("host", *[c for c in settings.columns if c not in NUMBERS and c != "host"], *[value(n) for n in NUMBERS])


def merge_excluded(existing: DataFrame, added: DataFrame, cap: int = 500, budget: int = 500_000) -> DataFrame:
    """Excluded entries (value, kind, time_ms, seq): one for each kind and key, added ones first; newest first, capped."""
    both = added.withColumn("_rank", F.lit(0)).unionByName(existing.withColumn("_rank", F.lit(1)))
    key = F.concat_ws("|", "kind", F.when(F.col("kind") == "url", U.canonical_key(F.col("value"))).otherwise(F.col("value")))
    best = W.partitionBy("_key").orderBy("_rank", F.when(F.col("_rank") == 0, -F.col("time_ms")), "seq")
    kept = both.withColumn("_key", key).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    order = [F.col("time_ms").desc(), F.col("_rank").asc(), F.col("seq").asc()]
    newest = kept.orderBy(*order).limit(cap)
    return byte_budget(newest, [], order, F.octet_length(F.to_json(F.struct("value", "kind", "time_ms"))), budget).select(*existing.columns)


def removed(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """entries without those whose key is that of a src in gone."""
    keys = gone.select(U.canonical_key(F.col("src")).alias("_key")).distinct()
    return entries.withColumn("_key", U.canonical_key(F.col("src"))).join(keys, "_key", "left_anti").drop("_key")


def first_seen(held: DataFrame, added: DataFrame) -> DataFrame:
    """held and, for each key that it does not have, the first of added (by seq, then src); rows without an address go."""
    key, columns = U.canonical_key(F.col("src")), held.columns
    firsts = added.where("src <> ''").withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*columns), F.struct("seq", "src")).alias("_row"))
    fresh = firsts.join(held.select(key.alias("_key")), "_key", "left_anti")
    return held.unionByName(fresh.select("_row.*"))


ENTRY = "struct<src:string,filename:string,kind:string,type:string,thumbnailSrc:string,sourcePage:struct<url:string,title:string>,time:bigint>"
BACKUP = f"struct<app:string,version:int,exportedAt:bigint,settings:map<string,string>,favourites:array<{ENTRY}>,history:array<{ENTRY}>,excluded:array<struct<value:string,kind:string,time:bigint>>>"


def read_backups(documents: DataFrame, app: str, text: str = "body") -> DataFrame:
    """documents (id, body) plus backup, null where a body is none of ours; entries without an address go, page addresses that are unsafe become empty."""
    parsed = F.from_json(F.col(text), BACKUP, {"mode": "PERMISSIVE"})

    def entries(c: Column) -> Column:
        fine = F.filter(F.coalesce(c, F.array().cast(f"array<{ENTRY}>")), lambda e: e["src"].isNotNull() & (e["src"] != "") & e["time"].isNotNull())
        return F.transform(fine, lambda e: e.withField("sourcePage", F.struct(F.coalesce(U.safe_source(e["sourcePage"]["url"]), F.lit("")).alias("url"), e["sourcePage"]["title"].alias("title"))))

    b = F.col("_b")
    excluded = F.filter(F.coalesce(b["excluded"], F.array().cast("array<struct<value:string,kind:string,time:bigint>>")), lambda e: e["value"].isNotNull() & e["kind"].isin("url", "host"))
    clean = F.struct(b["app"].alias("app"), b["version"].alias("version"), b["exportedAt"].alias("exportedAt"), b["settings"].alias("settings"), entries(b["favourites"]).alias("favourites"), entries(b["history"]).alias("history"), excluded.alias("excluded"))
    return documents.withColumn("_b", parsed).withColumn("backup", F.when(b["app"] == app, clean)).drop("_b")


def write_backup(history: DataFrame, favourites: DataFrame, excluded: DataFrame, app: str, version: int, now_ms: int) -> DataFrame:
    """One row, body: the backup document. The stores are capped, so their lists are small."""
    entry = F.struct("src", "filename", "kind", "type", F.col("thumbnail_src").alias("thumbnailSrc"), F.struct(F.col("source_page_url").alias("url"), F.col("source_page_title").alias("title")).alias("sourcePage"), F.col("time_ms").alias("time"))
    lists = lambda df, e, name: df.agg(F.sort_array(F.collect_list(F.struct((-F.col("time_ms")).alias("k"), e.alias("e")))).alias("l")).select(F.transform("l", lambda x: x["e"]).alias(name))
    parts = lists(history, entry, "history").join(lists(favourites, entry, "favourites")).join(lists(excluded, F.struct("value", "kind", F.col("time_ms").alias("time")), "excluded"))
    return parts.select(F.to_json(F.struct(F.lit(app).alias("app"), F.lit(version).alias("version"), F.lit(now_ms).alias("exportedAt"), "favourites", "history", "excluded")).alias("body"))


def sidecars(items: DataFrame) -> DataFrame:
    """items (filename, …) plus sidecar, the item's metadata as JSON with nulls kept, and the sidecar's name."""
    names = ("src", "type", "kind", "width", "height", "file_size", "alt", "source_page_url", "source_page_title", "filename", "media_key")
    row = F.struct(*[F.col(n) if n in items.columns else F.lit(None).cast("string").alias(n) for n in names])
    return items.withColumn("sidecar", F.to_json(row, {"ignoreNullFields": "false"})).withColumn("sidecar_name", F.concat("filename", F.lit(".json")))


def renamed_sidecars(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """plan (download_id, sidecar_name) of completed downloads (download_id, saved_path): the asked folder with the saved file's name."""
    folder = F.regexp_extract("sidecar_name", r"^(.*/)", 1)
    return plan.join(completed, "download_id").withColumn("sidecar_name", F.concat(folder, F.regexp_extract("saved_path", r"([^/\\]*)$", 1), F.lit(".json"))).drop("saved_path")


def link_list(items: DataFrame, by: str = "page_id") -> DataFrame:
    """One text of addresses for each page, in order."""
    return items.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "src"))), lambda x: x["src"]), "\n").alias("links"))


def healed(local: DataFrame, mirror: DataFrame) -> DataFrame:
    """(key, value): the local one where its key is there, even with a null value, else the mirror's."""
    a, b = local.select("key", F.col("value").alias("_l"), F.lit(True).alias("_has")), mirror.select("key", F.col("value").alias("_m"))
    return a.join(b, "key", "full_outer").select("key", F.when(F.coalesce("_has", F.lit(False)), F.col("_l")).otherwise(F.col("_m")).alias("value"))


def archive_plan(items: DataFrame, most: int = 1 << 30) -> DataFrame:
    """items (batch_id, seq, path, file_size) plus place and fits: whether the sizes up to it stay in the archive's limit."""
    w = W.partitionBy("batch_id").orderBy("seq")
    return items.withColumn("place", F.row_number().over(w)).withColumn("fits", F.sum("file_size").over(w.rowsBetween(W.unboundedPreceding, 0)) <= most)
