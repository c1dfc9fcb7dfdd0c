"""Exact dedup by deterministic block naming.

Each normalised text is cut into blocks of a fixed size. The distinct blocks are sorted and numbered: equal blocks get
one integer, different blocks different ones. Then adjacent numbers are paired and the distinct pairs sorted and
numbered in turn, until each document is one number: its identity. Numbers come from sorted order within the shuffle
partitions, so they are the same whatever the order of arrival or the number of attempts. No two different texts share
an identity: blocks are told apart by their content, not by a hash (a 64-bit hash only deals them out, and blocks that
share one are told apart by content).

Copies are merged before the shuffle (partial aggregation), so a block that a third of all rows hold moves once a task.
A number goes back to the rows that hold it by a join on the 8-byte hash, and a group's decision by a join on its
identity; in both the rows of one key are dealt into parts first, so no key's rows land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.llm._common import spread_join, stored, table, text_of

BLOCK_CHARS = 4096
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def _named(rows: DataFrame, content: list[str], tag: str, slim: DataFrame, by: list[str]) -> DataFrame:
    """rows (with h, a hash of the content columns) plus name: an integer for each distinct content.

    A hash with one content takes the place of the content in the join; the few hashes with several contents, if any,
    are joined by content as well. slim: the rows without content, stored; by: columns that deal a hash's rows into parts.
    """
    value = content[0] if len(content) == 1 else F.struct(*content)
    by_hash = rows.groupBy("h").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    # sort-based aggregation leaves each partition sorted by h; sorting again makes the numbering explicit
    numbered = by_hash.select("h", (F.col("lo") != F.col("hi")).alias("mixed")).sortWithinPartitions("h").withColumn("name", F.monotonically_increasing_id())
    names = stored(numbered, tag)
    mixed = names.where("mixed").select("h")
    if mixed.isEmpty():
        return spread_join(slim, names, ["h"], by).drop("mixed")
    out = spread_join(rows, names, ["h"], by)
    # Several contents under one hash: sort those contents and number them below every other name.
    many = rows.join(mixed, "h", "left_semi").select("h", *content).distinct().repartition("h").sortWithinPartitions("h", *content)
    own = stored(many.withColumn("own", -1 - F.monotonically_increasing_id()), tag)
    return out.join(own, ["h", *content], "left").withColumn("name", F.coalesce("own", "name")).drop("own", "mixed")


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, text_sha256, levels, name: two rows have equal (levels, name) if and only if their normalised texts are equal."""
    norm = text_of(docs, doc_id, text).select("doc_id", normalised(F.col("text")).alias("norm"))
    # one pass over the text, however many blocks it has
    cut = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    blocks = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"), cut.alias("blocks"))
    rows = blocks.select("doc_id", "row", "text_sha256", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    rows = rows.withColumn("text_sha256", F.when(F.col("pos") == 0, F.col("text_sha256")))
    rows = rows.withColumn("h", F.xxhash64("block"))
    named = stored(_named(rows, ["block"], "blocks", stored(rows.drop("block"), "hashes"), ["doc_id", "pos"]).select("doc_id", "row", "n", "pos", "text_sha256", "name"), "level")
    level, done, at = 0, [], named
    while True:
        done.append(at.where("n = 1").select("row", F.lit(level).alias("levels"), "name"))
        rest = at.where("n > 1").select("row", "n", "pos", "name")
        if rest.isEmpty():
            break
        level += 1
        pairs = rest.groupBy("row", F.expr("cast(pos div 2 as int)").alias("pos"), F.expr("cast((n + 1) div 2 as int)").alias("n")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b0"), F.count(F.lit(1)).alias("c")
        )
        pairs = pairs.select("row", "n", "pos", "a", F.coalesce("b0", "a").alias("b"), (F.col("c") == 2).cast("int").alias("c"))
        pairs = stored(pairs.withColumn("h", F.xxhash64(F.lit(level), "a", "b", "c")), "paired")
        at = stored(_named(pairs, ["a", "b", "c"], "pairs", pairs, ["row", "pos"]).select("row", "n", "pos", "name"), "level")
    ids = done[0]
    for d in done[1:]:
        ids = ids.unionByName(d)
    return named.where("pos = 0").select("doc_id", "row", "text_sha256").join(ids, "row")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Of rows with equal normalised texts the smallest doc_id stays. Null text: equal to empty. Null doc_id: a row of its
    group, never the one that stays unless all are null (then keep_id is null and kept false). Rows that repeat a
    doc_id and its text count each in group_size and are all kept or all dropped. Empty table: no rows.
    """
    ids = stored(identities(docs, doc_id, text, block_chars), "identity")
    groups = ids.groupBy("levels", "name").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return spread_join(ids, groups, ["levels", "name"], ["doc_id", "row"]).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def op8_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op8_block_naming": op8_block_naming}
ORACLES = {
    "op8_block_naming": r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""
}
