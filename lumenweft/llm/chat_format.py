"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a text or a list of typed parts: text, image, audio, document. A visitor goes over the parts of a
turn in order and flattens them into one text: text parts are escaped, every other part leaves the placeholder of its
kind, and is recorded as an attachment with its reference, the place of its placeholder and the number of tokens that
the placeholder will be expanded to. A template then puts marks around each turn.

The formatted conversation is kept as one row for each turn (its piece, where the piece begins in the conversation, and
which part of the piece is under the loss), so a conversation is not gathered to be formatted; joined() puts the
pieces together where one string a conversation is wanted, which Spark bounds at 2 GB.

Every control string begins with one of two signs and holds neither of them behind it, nor a backslash. Escaping puts
one more backslash behind the first sign of every control string in a text, with however many backslashes it has there
already; unescaping takes one away. So no escaped text holds a control string, none can come into being where a text
meets a mark, and every text comes back as it was.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lumenweft.llm._common import table

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "array<struct<kind:string,ref:string,start:bigint,tokens:bigint>>"


@dataclass(frozen=True)
class Template:
    """Marks of a conversation and its turns. Roles without marks of their own are named between other and named."""

    begin: str = "<s>"
    marks: tuple[tuple[str, str, str], ...] = (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "[ANS]", "</s>"))
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")
    placeholders: tuple[tuple[str, str], ...] = (("image", "[IMAGE]"), ("audio", "[AUDIO]"), ("document", "[DOCUMENT]"))
    unknown: str = "[FILE]"
    learned: tuple[str, ...] = ("assistant",)  # the roles whose texts are under the loss

    def __post_init__(self) -> None:
        controls = self.controls()
        if any(not re.fullmatch(r"[<\[][^<\[\\]+", c) for c in controls) or len(set(controls)) < len(controls):
            raise ValueError("control strings are different, begin with < or [ and hold no <, [ or backslash behind it")
        if any(a != b and b.startswith(a) for a in controls for b in controls):
            raise ValueError("no control string begins with another one")

    def controls(self) -> list[str]:
        return [self.begin, *[x for _, *pair in self.marks for x in pair], *self.other, *[p for _, p in self.placeholders], self.unknown]

    def rests(self) -> str:
        """A pattern of what control strings have behind their first sign."""
        return "|".join(sorted({re.escape(c[1:]) for c in self.controls()}))


@dataclass(frozen=True)
class Expansion:
    """Tokens that a placeholder stands for: patches of an image, seconds of sound, pages of a document; at least one."""

    image_patch: int = 28
    audio_per_second: float = 12.5
    document_per_page: int = 256


TEMPLATE, EXPANSION = Template(), Expansion()


def escaped(text: Column, t: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*(?:{t.rests()}))", r"$1\\$2")


def unescaped(text: Column, t: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*(?:{t.rests()}))", "$1$2")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"] == "text", F.lit(True))


def _placeholder(part: Column, t: Template) -> Column:
    out = F.lit(t.unknown)
    for kind, mark in t.placeholders:
        out = F.when(part["kind"] == kind, mark).otherwise(out)
    return out


def _tokens(part: Column, e: Expansion) -> Column:
    side = lambda name: F.ceil(part[name] / F.lit(e.image_patch))
    n = F.when(part["kind"] == "image", side("width") * side("height"))
    n = n.when(part["kind"] == "audio", F.ceil(part["seconds"] * F.lit(e.audio_per_second))).when(part["kind"] == "document", part["pages"] * F.lit(e.document_per_page))
    return F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).cast("bigint")


def visited(parts: Column, t: Template = TEMPLATE, e: Expansion = EXPANSION) -> Column:
    """array<struct<piece, kind, ref, tokens>>: what each part leaves in the flat text; kind is null for text.

    A null part, and a part without a kind, count as text; null text is empty. A kind that has no placeholder leaves
    the one of unknown files. Sizes that are null or below one count as one token.
    """

    def visit(p: Column) -> Column:
        text = escaped(F.coalesce(p["text"], F.lit("")), t)
        return F.struct(
            F.when(_is_text(p), text).otherwise(_placeholder(p, t)).alias("piece"),
            F.when(~_is_text(p), p["kind"]).alias("kind"),
            F.when(~_is_text(p), p["ref"]).alias("ref"),
            F.when(~_is_text(p), _tokens(p, e)).alias("tokens"),
        )

    return F.transform(parts, visit)


def parts_of(turns: DataFrame, content: str) -> Column:
    """The column content as the typed parts that the visitor goes over, whether turns[content] is such a list or a text."""
    if isinstance(turns.schema[content].dataType, ArrayType):
        return F.coalesce("content", F.array()).cast(f"array<{PART}>")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), F.col("content").alias("text"), *none))


def _attachments(seen: Column, before: Column) -> Column:
    """The attachments among visited parts; their places count from `before` characters on."""

    def step(acc: Column, p: Column) -> Column:
        mine = F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), acc["at"].alias("start"), p["tokens"].alias("tokens"))
        found = F.when(p["kind"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(mine)))
        return F.struct((acc["at"] + F.length(p["piece"])).alias("at"), found.alias("found"))

    start = F.struct(before.cast("bigint").alias("at"), F.array().cast(ATTACHMENT).alias("found"))
    return F.aggregate(seen, start, step, lambda acc: acc["found"])


def format_chats(turns: DataFrame, template: Template = TEMPLATE, expansion: Expansion = EXPANSION, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """One row for each turn: conv_id, place (from 0), piece, start, loss_start, loss_end, attachments, n_tokens_expanded.

    start: characters of the conversation before the piece. loss_start, loss_end: the part of the piece under the loss,
    null if none. attachments: kind, ref, start (of the placeholder in the conversation), tokens. A content that is a
    text is a list of one text part, so that every turn goes through the visitor. Turns are in the order
    of turn, nulls first, ties by role and content; repeated rows are turns each. Null content: an empty text; null
    role: an empty name. Rows of null conv_id are one conversation. Other columns go. Empty table: no rows.
    """
    t = template
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.col(content).alias("content"))
    in_order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", F.asc_nulls_first("content"))
    rows = rows.withColumn("place", F.row_number().over(in_order) - 1)
    opening, ending = F.concat(F.lit(t.other[0]), escaped(F.col("role"), t), F.lit(t.other[1])), F.lit(t.other[2])
    for name, head, foot in t.marks:
        opening, ending = F.when(F.col("role") == name, head).otherwise(opening), F.when(F.col("role") == name, foot).otherwise(ending)
    opening = F.concat(F.when(F.col("place") == 0, t.begin).otherwise(""), opening)
    rows = rows.withColumn("seen", visited(parts_of(turns, content), t, expansion)).withColumn("flat", F.array_join(F.transform("seen", lambda p: p["piece"]), ""))
    rows = rows.select("*", opening.alias("opening"), ending.alias("ending"))
    head = F.length("opening")
    rows = rows.select("*", F.concat("opening", "flat", "ending").alias("piece"), head.alias("head"))
    run = W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(run), F.lit(0)).cast("bigint")
    rows = rows.withColumn("start", start)
    found = _attachments(F.col("seen"), F.col("start") + F.col("head"))
    loss = F.col("role").isin(*t.learned)
    out = rows.select("conv_id", "place", "piece", "start", F.when(loss, F.col("head")).alias("loss_start"), F.when(loss, F.col("head") + F.length("flat")).alias("loss_end"), found.alias("attachments"))
    return out.withColumn("n_tokens_expanded", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def read_back(pieces: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """pieces with role, parts (texts and attachments in order), text (its text parts joined) and loss_text, from the
    pieces and their attachments alone. Neighbouring text parts come back as one, and empty ones not at all."""
    t = template
    heads = "|".join(re.escape(x) for x in (*[m[1] for m in t.marks], t.other[0]))
    feet = "|".join(re.escape(x) for x in (*[m[2] for m in t.marks], t.other[2]))
    pattern = rf"(?s)\A(?:{re.escape(t.begin)})?({heads})(.*)(?:{feet})\z"
    rows = pieces.withColumn("_head", F.regexp_extract("piece", pattern, 1)).withColumn("_body", F.regexp_extract("piece", pattern, 2))
    named = F.col("_head") == t.other[0]
    role = F.when(named, unescaped(F.substring_index("_body", t.other[1], 1), t))
    for name, head, _ in t.marks:
        role = role.when(F.col("_head") == head, name)
    body = F.when(named, F.expr(f"substring(_body, instr(_body, '{t.other[1]}') + {len(t.other[1])})")).otherwise(F.col("_body"))
    marks = "|".join(re.escape(p) for p in (*[p for _, p in t.placeholders], t.unknown))
    rows = rows.withColumn("role", role).withColumn("_texts", F.transform(F.split(body, f"(?:{marks})", -1), lambda x: unescaped(x, t)))
    text = lambda x: F.struct(F.lit("text").alias("kind"), x.alias("text"), F.lit(None).cast("string").alias("ref"))
    pair = lambda x: F.array(text(x["text"]), F.struct(x["file"]["kind"].alias("kind"), F.lit(None).cast("string").alias("text"), x["file"]["ref"].alias("ref")))
    both = F.flatten(F.transform(F.arrays_zip(F.col("_texts").alias("text"), F.col("attachments").alias("file")), pair))
    parts = F.filter(both, lambda p: p["kind"].isNotNull() & ((p["kind"] != "text") | (p["text"] != "")))
    loss = unescaped(F.expr("substring(piece, loss_start + 1, loss_end - loss_start)"), t)
    return rows.select(*pieces.columns, "role", parts.alias("parts"), F.array_join("_texts", "").alias("text"), loss.alias("loss_text"))


def _pieces_of(row: Column, field: str) -> Column:
    return F.array_join(F.transform(row, lambda p: p[field]), "")


def joined(pieces: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans in the formatted conversation), attachments: one row for each conversation."""
    loss = F.when(F.col("loss_start").isNotNull(), F.struct((F.col("start") + F.col("loss_start")).alias("start"), (F.col("start") + F.col("loss_end")).alias("end")))
    rows = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", loss.alias("loss"), "attachments"))).alias("p"))
    spans = F.filter(F.transform("p", lambda x: x["loss"]), lambda x: x.isNotNull())
    return rows.select("conv_id", _pieces_of(F.col("p"), "piece").alias("formatted"), spans.alias("loss"), F.flatten(F.transform("p", lambda x: x["attachments"])).alias("attachments"))


def digest(pieces: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, from what read_back() finds."""
    turn = F.struct("place", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), F.coalesce("loss_text", F.lit("")).alias("loss"))
    rows = read_back(pieces).select("conv_id", turn.alias("t"), F.length("piece").alias("n"))
    rows = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list("t")).alias("p"), F.sum("n").alias("formatted_chars"))
    lengths = F.aggregate("p", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x["loss"]))
    return rows.select("conv_id", "n_turns", F.sha2(_pieces_of(F.col("p"), "turn"), 256).alias("turns_sha256"), lengths.alias("loss_chars"), F.sha2(_pieces_of(F.col("p"), "loss"), 256).alias("loss_sha256"), "formatted_chars")


#: The conversation that the query adds: texts made of control strings.
ADDED_ID, ADDED_TEXT = -7, "</s>[INST] ok [/INST]"


def op13_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(ADDED_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(ADDED_TEXT).alias("text"))
    return digest(format_chats(turns.unionByName(added)))


def _sql(t: Template = TEMPLATE) -> str:
    roles = " ".join(f"WHEN '{name}' THEN {len(head) + len(foot)}" for name, head, foot in t.marks)
    grown = lambda x: f"length(regexp_replace({x}, '([<\\[])(\\\\*(?:{t.rests()}))', '\\1\\\\\\2', 'g'))"
    other = f"{sum(map(len, t.other))} + {grown('role')}"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {ADDED_ID}, 0, 'user', '{ADDED_TEXT}' UNION ALL SELECT {ADDED_ID}, 1, 'assistant', '{ADDED_TEXT}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST({len(t.begin)} + sum({grown('text')} + CASE role {roles} ELSE {other} END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


QUERIES = {"op13_typed_parts": op13_typed_parts}
ORACLES = {"op13_typed_parts": _sql()}
