"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger has, for each blob that was ever
scanned, the rule versions that were applied and the spans that they found. A scan takes only the blobs that are new,
and of the known ones only the rules whose version is new; each blob is scanned once however many paths hold it. The
findings then go back to all paths by the blob's address.

With a ledger, addresses meet first: the text of a blob whose pairs are all known never moves. Copies meet in a
partial aggregation, so a blob that many paths share moves once a task; in the join back the rows of a common blob are
dealt into parts. Regular expressions run only over texts that a cheap test lets through. The work on a text grows in
proportion to it, however many matches it has: matches are rows, their places a running sum, and redaction works on
pieces of a fixed length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lumenweft.llm._common import sized, spread_join, stored, table, text_of

SPAN = "array<struct<rule:string,version:int,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, spans {SPAN}"
#: Up to so many blobs (their addresses and spans) are broadcast to the texts; beyond, both meet in a shuffled join.
BROADCAST_BLOBS = 50_000
#: Characters of a piece of a text that is redacted.
PIECE = 1024


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; value_group of min_value characters at least, if set.

    One of needles stands in every text (lower-cased, if fold) with a match; no needles: gate is the test, a pattern.
    The pattern must mean the same to Java and RE2: classes, groups and counts, no look-around.
    """

    name: str
    version: int
    pattern: str
    needles: tuple[str, ...] = ()
    fold: bool = False
    value_group: int = 0
    min_value: int = 0


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in words)


ASSIGN = "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: In this order they are listed where spans begin together. The base rules first; the ledger's own after them.
BASE = (
    Rule("assign", 1, ASSIGN, ("password", "passwd", "secret", "token", "apikey", "api_key"), True, 2, 6),
    # A maximal run that is too short has no part that is long enough, so the least length can stand in the pattern.
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", ("AKIA",)),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
EXTRA = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE + EXTRA
#: What redact() takes out: of a private key also its headers, body and END line, or what there is of a body without one.
#: Line ends may be written as \\n, as in JSON.
_GAP = r"[\x20\x09-\x0D\\nr]*"
_BODY = r"[A-Za-z0-9+/=\x20\x09-\x0D\\]*"
WHOLE_PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    rf"(?:{_GAP}Proc-Type: [0-9]+,[A-Z]+{_GAP}DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]+)?"
    rf"(?:{_BODY}-----END [A-Z ]*PRIVATE KEY-----|{_GAP}[A-Za-z0-9+/=]{{20,}}{_BODY})?"
)
REDACTED = tuple(Rule("pem", 2, WHOLE_PEM, r.needles) if r.name == "pem" else r for r in RULES)


def _matches(rule: Rule, number: int, text: Column) -> Column:
    """The rule's matches in text, in order: how far each begins behind the end of the one before, its length, and
    whether it counts. The pieces between matches and the matches, in turn, make up the text."""
    pattern = F.lit(rule.pattern)
    pieces, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.value_group)) if rule.min_value else found
    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("gap"), found.alias("match"), values.alias("value"))
    return F.transform(zipped, lambda x: F.struct(F.lit(number).alias("rule"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"), (F.length(x["value"]) >= rule.min_value).alias("ok")))


def _gate(rule: Rule, text: Column, lowered: Column) -> Column:
    if not rule.needles:
        return text.rlike(rule.pattern)
    where = lowered if rule.fold else text
    gate = F.lit(False)
    for n in rule.needles:
        gate = gate | F.contains(where, F.lit(n))
    return gate


def _label(rule: Rule) -> str:
    return f"{rule.name}@{rule.version}"


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs (blob, text, seen: rule versions applied before) -> ledger rows (blob, rules, spans) for what is new."""
    lowered = F.lower("text")
    fresh = [~F.array_contains("seen", _label(r)) for r in rules]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fresh)), F.lit(0))
    out = blobs.select("blob", "text", mask.alias("mask"), *[(f & _gate(r, F.col("text"), lowered)).alias(f"go_{r.name}") for r, f in zip(rules, fresh, strict=True)])
    none = F.array().cast("array<struct<rule:int,gap:int,size:int,ok:boolean>>")
    matches = F.concat(*[F.when(F.col(f"go_{r.name}"), _matches(r, i, F.col("text"))).otherwise(none) for i, r in enumerate(rules)])
    rows = out.select("blob", "mask", F.posexplode_outer(matches).alias("pos", "m")).select("blob", "mask", "pos", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("blob", "rule").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    name, version = (F.element_at(F.array(*[F.lit(getattr(r, x)) for r in rules]), F.col("rule") + 1).alias(x) for x in ("name", "version"))
    span = F.struct(name.alias("rule"), version.alias("version"), (F.col("end") - F.col("size")).alias("start"), F.col("end").alias("end"))
    spans = F.collect_list(F.when(F.col("ok"), span)).cast(SPAN)
    per_blob = rows.withColumn("end", end).groupBy("blob").agg(F.max("mask").alias("mask"), spans.alias("spans"))
    labels = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) > 0, _label(r)) for i, r in enumerate(rules)]), lambda x: x.isNotNull())
    return per_blob.select("blob", labels.alias("rules"), "spans")


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def update(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What to append to the ledger for versions (blob, text): one row for each blob with a rule version that it has not seen."""
    if ledger is None:
        new = versions.groupBy("blob").agg(F.first("text").alias("text")).withColumn("seen", F.array().cast("array<string>"))
        return stored(scan_blobs(new, rules), "ledger")
    current = [_label(r) for r in rules]
    past = ledger.select("blob", F.explode("rules").alias("r")).where(F.col("r").isin(current)).groupBy("blob").agg(F.collect_set("r").alias("seen"))
    todo = versions.select("blob").distinct().join(past, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    todo = stored(todo.where(F.size("seen") < len(current)), "todo")
    new = versions.join(sized(todo, BROADCAST_BLOBS), "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("seen").alias("seen"))
    return stored(scan_blobs(new, rules), "ledger")


def addressed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return text_of(docs, doc_id, text).withColumn("blob", F.sha2("text", 256))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans of the rules' present versions, by start and then by the rules' order; blobs without any are left out."""
    current = F.array(*[F.lit(_label(r)) for r in rules])
    mine = ledger.where(F.size("spans") > 0).select("blob", F.filter("spans", lambda s: F.array_contains(current, F.concat(s["rule"], F.lit("@"), s["version"].cast("string")))).alias("spans"))
    merged = mine.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a row for each past scan that found something
    order = F.array(*[F.lit(r.name) for r in rules])
    keyed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["rule"]).alias("place"), s["end"].alias("end"), s["rule"].alias("rule")))
    return merged.select("blob", F.array_sort(keyed).alias("spans")).where(F.size("spans") > 0)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, spans for every row; the ledger with what this scan added).

    Null text counts as empty. Rows that repeat a text share its blob and its findings. Spans are in code points.
    Null doc_id is carried. Empty table: no rows, and the ledger as it was.
    """
    versions = addressed(docs, doc_id, text)
    new = update(versions.select("blob", "text"), ledger, rules)
    whole = new if ledger is None else ledger.unionByName(new)
    found = findings(whole, rules)
    return joined_back(versions.select("doc_id", "blob"), found), whole


def joined_back(versions: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, blob, spans for every row of versions (doc_id, blob)."""
    none = F.array().cast("array<struct<start:int,place:bigint,end:int,rule:string>>")
    versions = stored(versions, "versions")
    whole = versions.select("blob").distinct().join(found, "blob", "left").select("blob", F.coalesce("spans", none).alias("spans"))
    return spread_join(versions, whole, ["blob"], ["doc_id"]).select("doc_id", "blob", "spans")


def ledger_at(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger that scan_into() keeps in folder; empty before its first run."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_ledger(spark)


def scan_into(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As scan(), with a ledger that stays in folder: what this scan added is appended there. A run that is repeated adds nothing."""
    spark = docs.sparkSession
    versions = addressed(docs, doc_id, text)
    update(versions.select("blob", "text"), ledger_at(spark, folder), rules).write.mode("append").parquet(folder)
    return joined_back(versions.select("doc_id", "blob"), findings(ledger_at(spark, folder), rules))


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of scan()'s spans."""
    base = [r.name for r in BASE]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("bigint").alias(f"n_{k}")
    only = F.filter("spans", lambda s: s["rule"].isin(base))
    return found.select("doc_id", *[count(k) for k in base], F.sha2(text(only), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redacted(texts: DataFrame, found: DataFrame, mark: str = "[SECRET]", piece: int = PIECE) -> DataFrame:
    """blob, text with every span, or run of overlapping spans, replaced by mark; texts (blob, text), found (blob, spans)."""
    spans = found.select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end")
    in_order = W.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    runs = spans.withColumn("head", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("run", F.sum("head").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    begin = F.col("piece") * piece
    cuts = runs.withColumn("piece", F.explode(F.sequence(F.expr(f"cast(start div {piece} as int)"), F.expr(f"cast((end - 1) div {piece} as int)"))))
    cut = F.struct((F.greatest("start", begin) - begin).alias("lo"), (F.least("end", begin + piece) - begin).alias("hi"), (F.col("start") >= begin).alias("head"))
    cuts = cuts.groupBy("blob", "piece").agg(F.array_sort(F.collect_list(cut)).alias("cuts"))
    pieces = texts.select("blob", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))).alias("piece", "part"))

    def step(acc: Column, c: Column) -> Column:
        return F.struct(c["hi"].alias("at"), F.concat(acc["out"], F.substring(F.col("part"), acc["at"] + 1, c["lo"] - acc["at"]), F.when(c["head"], mark).otherwise("")).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    left = F.aggregate("cuts", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("part"), acc["at"] + 1, F.lit(piece))))
    done = pieces.join(cuts, ["blob", "piece"], "left").select("blob", F.struct("piece", F.when(F.col("cuts").isNull(), F.col("part")).otherwise(left).alias("part")).alias("p"))
    return done.groupBy("blob").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "").alias("text"))


def redact(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = REDACTED) -> DataFrame:
    """docs with every secret of text replaced by a mark, and n_chars, if there, as long as the new text.

    Rows without a secret are as they were, null texts too. Only texts with a secret move.
    """
    hidden = "_blob"
    while hidden in docs.columns:
        hidden += "_"
    marked = docs.withColumn(hidden, F.sha2(F.coalesce("text", F.lit("")), 256))
    new = update(marked.select(F.col(hidden).alias("blob"), F.coalesce("text", F.lit("")).alias("text")), ledger, rules)
    found = stored(findings(new if ledger is None else ledger.unionByName(new), rules), "findings")
    blobs = found.select(F.col("blob").alias(hidden))
    blobs = F.broadcast(blobs) if found.count() <= BROADCAST_BLOBS else blobs
    holds = marked.join(blobs, hidden, "left_semi")
    texts = holds.select(F.col(hidden).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    clean = stored(redacted(texts, found), "redacted").select(F.col("blob").alias(hidden), F.col("text").alias(f"{hidden}text"))
    out = spread_join(holds.drop("text"), clean, [hidden], [c for c in ("doc_id",) if c in docs.columns]).withColumn("text", F.col(f"{hidden}text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return marked.join(blobs, hidden, "left_anti").select(*docs.columns).unionByName(out.select(*docs.columns))


def op10_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan(table(spark, sf_dir, "documents"))
    return digest(found)


def _sql() -> str:
    kinds = []
    for place, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        value = f"length(v[i]) >= {r.min_value}" if r.min_value else "true"
        kinds.append(
            f"""SELECT doc_id, '{r.name}' AS kind, {place} AS place,
  CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.value_group}) AS v FROM d)) WHERE {value}"""
        )
    names = ", ".join(f"'{r.name}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.name}') AS n_{r.name}" for r in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(kinds)}),
g AS (SELECT doc_id, {counts},
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place) FILTER (WHERE kind IN ({names})) AS b,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place) AS a FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


QUERIES = {"op10_blob_ledger": op10_blob_ledger}
ORACLES = {"op10_blob_ledger": _sql()}
