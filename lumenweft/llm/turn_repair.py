"""Conversation structure repair: which turns to keep, rerole, delete or insert so that roles alternate, at least cost.

A retained-subsequence program: what is chosen are the turns that stay (kept, or reroled), and the gap between two of
them is priced as a whole. Prefix sums give the price of deleting what lies between; the pair of roles at the gap's
ends gives the turns to insert there; and for each role a running minimum over all later turns holds the best turn to go
on with, so a turn costs a few comparisons whatever the length of the gap. Among the cheapest repairs the audit (the
initials of the edits, in order) that is least in ASCII is taken. The program runs from the last turn to the first, so
ties are decided without comparing strings: the later the next retained turn, the more deletions come first, and D is
the least initial; of two ways to the same turn the one with more insertions is less, as I comes before K and R.

Rows are dealt by ranges of conversation and turn, so neither a long conversation nor a common id lands in one task. A
conversation that lies within one task is repaired there. One that begins or ends a task's range, or is longer than
BLOCK_ROWS, is cut into blocks: a block is summed up as a small matrix (the least cost from each role before it to each
role after it), the matrices are folded from the last block to the first, each block then decides for every role that
may come before it, and a fold from the first block on picks the decisions that hold. Only one thing goes in order
through one task, in a stream that holds a batch of rows: the digest of such a conversation's whole repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.llm._common import small_batches, spread_join, stored, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows, and about so many characters, of a block of a conversation that is not repaired in one piece.
BLOCK_ROWS, BLOCK_CHARS = 32_768, 4_000_000
#: What was retained last: nothing, a system turn, a user's, an assistant's. The last two are roles that edits can give.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NEVER = 1 << 60
#: BETWEEN[p][r]: the roles to insert between a retained turn of role p and the next one of role r; None: it cannot come next.
BETWEEN = (
    (None, (), (), (USER,)),
    (None, None, (), (USER,)),
    (None, None, (ASSISTANT,), ()),
    (None, None, (), (USER,)),
)
#: What the end of the conversation asks for.
AT_END = ((), (USER, ASSISTANT), (ASSISTANT,), ())
BLANK, DUPLICATE, CUT = 1, 2, 3
SPACE = r"\x20\x09-\x0D"
DELETION = "D"


@dataclass
class Decisions:
    """For every turn and role before it, where the cheapest repair goes on: the next retained turn and its role."""

    n: int
    cost: np.ndarray  # [turn, role before]: cost from this turn to the end
    turn: np.ndarray  # [turn, role before]: the next retained turn, n if none is
    role: np.ndarray  # its role, or the role at the end


def solve(roles: list[int], must_go: list[bool], cut: list[bool], end: list[int] | None = None) -> Decisions:
    """roles: START for one that the pattern does not know. end: the cost of going on from the end with each role
    retained last; None: the conversation ends here."""
    n = len(roles)
    deleted = [0] * (n + 1)
    for i in range(n):
        deleted[i + 1] = deleted[i] + DELETE
    shape = (n + 1, 4)
    cost, turn, role = np.zeros(shape, np.int64), np.full(shape, n, np.int64), np.zeros(shape, np.int8)
    finish = [INSERT * len(x) for x in AT_END] if end is None else end
    cost[n] = finish
    role[n] = range(4)
    # Running minima: the cheapest retained turn of each role so far, as the cost from it on and all deletions before it.
    best = [NEVER] * 4
    where = [n] * 4
    fees = [[None if BETWEEN[q][r] is None else INSERT * len(BETWEEN[q][r]) for r in range(4)] for q in range(4)]
    for i in range(n - 1, -1, -1):
        if not must_go[i]:
            fee = TRUNCATED if cut[i] else 0
            for r in (SYSTEM, USER, ASSISTANT):
                own = KEEP if roles[i] == r else NEVER if r == SYSTEM else REROLE
                if own < NEVER:
                    v = deleted[i] + own + fee + int(cost[i + 1, r])
                    if v < best[r]:  # of equal ones the later turn, found first, stays
                        best[r], where[r] = v, i
        for q in range(4):
            least, at, to = deleted[n] + finish[q], n, q
            for r in (SYSTEM, USER, ASSISTANT):
                if fees[q][r] is None or best[r] >= NEVER:
                    continue
                v = best[r] + fees[q][r]
                if v < least or v == least and (where[r] > at or where[r] == at < n and fees[q][r] > fees[q][to]):
                    least, at, to = v, where[r], r
            cost[i, q], turn[i, q], role[i, q] = least - deleted[i], at, to
    return Decisions(n, cost, turn, role)


def audit(d: Decisions, roles: list[int], before: int = START, last: bool = True) -> tuple[str, int]:
    """The edits' initials, and the role retained last. last: the conversation ends behind these turns."""
    out, i, q = [], 0, before
    while i < d.n:
        at, to = int(d.turn[i, q]), int(d.role[i, q])
        out.append(DELETION * (at - i))
        if at == d.n:
            break
        out.append("I" * len(BETWEEN[q][to]) + ("K" if roles[at] == to else "R"))
        i, q = at + 1, to
    return "".join(out) + ("I" * len(AT_END[q]) if last else ""), q


def through(roles: list[int], must_go: list[bool], cut: list[bool]) -> list[list[int]]:
    """[role before][role after]: the least cost of a block of turns."""
    out = [[NEVER] * 4 for _ in range(4)]
    for after in range(4):
        d = solve(roles, must_go, cut, [0 if q == after else NEVER for q in range(4)])
        for before in range(4):
            out[before][after] = min(int(d.cost[0, before]), NEVER)
    return out


class Edits:
    """Goes along an audit and the turns that it edits, and gives the turns of the repaired conversation."""

    def __init__(self) -> None:
        self.before, self.plan, self.at = START, "", 0

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.plan) and self.plan[self.at] == "I":
            self.before = ASSISTANT if self.before == USER else USER
            self.at += 1
            yield NAMES[self.before], ""

    def begin(self, plan: str) -> Iterator[tuple[str, str]]:
        """A new block's part of the audit."""
        self.plan, self.at = plan, 0
        yield from self._inserted()

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        edit = self.plan[self.at]
        self.at += 1
        if edit == "R":
            self.before = ASSISTANT if self.before == USER else USER
            yield NAMES[self.before], text
        elif edit == "K":
            self.before = INITIALS[role[0]]
            yield role, text
        yield from self._inserted()


class TextDigest:
    """SHA-256 of the repaired turns, newline-joined, as they come."""

    def __init__(self) -> None:
        self.sha, self.some = hashlib.sha256(), False

    def add(self, turns: Iterator[tuple[str, str]]) -> None:
        for role, text in turns:
            self.sha.update((("\n" if self.some else "") + f"{role}:{text}").encode())
            self.some = True


# ---- rows -------------------------------------------------------------------------------------------------------
def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls as one space in role and text, damaged by the crc32 of `conv_id:turn`.

    Of 20 kinds 0 drops the row, 1 empties the text, 2 removes its full stops, exclamation and question marks, 3 repeats
    the row, 4 makes its role user. A null conv_id or turn is a space in that string, and stays null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


def _faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it is truncated: its last character that is no white space ends no sentence."""
    blank = ~text.rlike(rf"[^{SPACE}]")
    return blank, ~blank & ~text.rlike(rf"[.!?][{SPACE}]*\z")


PASS = "kind string, conv_id bigint, seg bigint, block int, pos bigint, turn bigint, role string, text string, h binary, blank boolean, cut boolean, gaps bigint, blanks bigint, duplicates bigint, cuts bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
COUNTS = ("gaps", "blanks", "duplicates", "cuts", "illegal")
_FIELDS = tuple(f.split()[0] for f in PASS.split(", "))


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in PASS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(_FIELDS))


def _illegal(roles: list[str]) -> int:
    initials = [r[:1] for r in roles]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _state(role: str) -> int:
    return INITIALS.get(role[:1], START)


def _turn_gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _whole(conv: int | None, rows: list[tuple]) -> tuple:
    """A conversation (turn, role, text, h, blank, cut) that lies in one task, repaired."""
    seen: set[bytes] = set()
    faults = []
    for _, _, _, h, blank, cut in rows:
        faults.append(BLANK if blank else DUPLICATE if h in seen else CUT if cut else 0)
        seen.add(h)
    roles = [_state(r[1]) for r in rows]
    d = solve(roles, [f in (BLANK, DUPLICATE) for f in faults], [f == CUT for f in faults])
    plan, _ = audit(d, roles)
    edits, digest = Edits(), TextDigest()
    digest.add(edits.begin(plan))
    for r in rows:
        digest.add(edits.turn(r[1], r[2]))
    counts = (_turn_gaps([r[0] for r in rows]), *[faults.count(x) for x in (BLANK, DUPLICATE, CUT)], _illegal([r[1] for r in rows]))
    return ("whole", conv, *[None] * 9, *counts, int(d.cost[0, START]), plan, digest.sha.hexdigest())


def _pass(block_rows: int):
    """Rows in order -> the conversations that lie in one task, repaired, and the rows of all others, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg = TaskContext.get().partitionId()
        held: list[tuple] = []
        conv, first, begun, block, chars, out = None, True, False, 0, 0, []

        def cut_off() -> Iterator[tuple]:
            """The rows held, as a block of a conversation that is not repaired here."""
            nonlocal block, chars
            yield from (("row", conv, seg, block, i, *r, *[None] * 8) for i, r in enumerate(held))
            block, chars = block + bool(held), 0
            held.clear()

        for batch in batches:
            for c, *row in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if begun and c != conv:
                    if first or block:
                        out.extend(cut_off())
                    else:
                        out.append(_whole(conv, held))
                        held.clear()
                    first, block, chars = False, 0, 0
                conv, begun = c, True
                held.append(tuple(row))
                chars += len(row[2])
                if len(held) >= block_rows or chars >= BLOCK_CHARS:
                    out.extend(cut_off())
            if out:
                yield _arrow(out)
                out = []
        if begun:
            out.extend(cut_off())
        if out:
            yield _arrow(out)

    return run


# ---- conversations in blocks ------------------------------------------------------------------------------------
def _columns(f: pd.DataFrame) -> tuple[list[int], list[bool], list[bool]]:
    f = f.sort_values("pos")
    return [_state(r) for r in f["role"]], f["fault"].isin([BLANK, DUPLICATE]).tolist(), (f["fault"] == CUT).tolist()


def _summed(f: pd.DataFrame) -> pd.DataFrame:
    """A block -> its matrix, and what its conversation's counts need."""
    f = f.sort_values("pos")
    roles = f["role"].tolist()
    count = lambda x: int((f["fault"] == x).sum())
    flat = [v for row in through(*_columns(f)) for v in row]
    return pd.DataFrame([(f["conv_id"].iloc[0], f["seg"].iloc[0], f["block"].iloc[0], flat, roles[0][:1], roles[-1][:1], _illegal(roles), count(BLANK), count(DUPLICATE), count(CUT))])


def _backward(f: pd.DataFrame) -> pd.DataFrame:
    """The matrices of a conversation's blocks -> the cost from the end of each block on, by the role retained last."""
    f = f.sort_values(["seg", "block"])
    ends, end = [], [INSERT * len(x) for x in AT_END]
    for i in range(len(f) - 1, -1, -1):
        ends.append(end)
        m = np.array(f["flat"].iloc[i]).reshape(4, 4)
        end = np.minimum((m + np.array(end)[None, :]).min(1), NEVER).tolist()
    last = [False] * (len(f) - 1) + [True]
    return pd.DataFrame({"conv_id": f["conv_id"], "seg": f["seg"], "block": f["block"], "end": ends[::-1], "last": last, "cost": end[START]})


def _planned(f: pd.DataFrame) -> pd.DataFrame:
    """A block with the costs behind it -> its part of the audit for each role before it, and the role after it."""
    roles, must_go, cut = _columns(f)
    end, last = list(f["end"].iloc[0]), bool(f["last"].iloc[0])
    d = solve(roles, must_go, cut, end)
    plans = [audit(d, roles, q, last) for q in range(4)]
    return pd.DataFrame([(f["conv_id"].iloc[0], f["seg"].iloc[0], f["block"].iloc[0], [p for p, _ in plans], [q for _, q in plans])])


def _forward(f: pd.DataFrame) -> pd.DataFrame:
    """From the first block on: which of a block's plans holds."""
    f = f.sort_values(["seg", "block"])
    q, took = START, []
    for after in f["after"]:
        took.append(q)
        q = int(after[q])
    return pd.DataFrame({"conv_id": f["conv_id"], "seg": f["seg"], "block": f["block"], "entry": took})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations in order, each block led by its plan -> the digest of each repaired text."""
    conv, begun, edits, digest, out = None, False, Edits(), TextDigest(), []
    for batch in batches:
        for c, _, _, pos, role, text, plan in zip(*[col.to_pylist() for col in batch.columns], strict=True):
            if not begun or c != conv:
                if begun:
                    out.append((conv, digest.sha.hexdigest()))
                conv, begun, edits, digest = c, True, Edits(), TextDigest()
            digest.add(edits.begin(plan) if pos < 0 else edits.turn(role, text))
    if begun:
        out.append((conv, digest.sha.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out])], ["conv_id", "repaired_sha256"])


def _in_blocks(rows: DataFrame) -> DataFrame:
    """The conversations whose rows were cut into blocks. A null conv_id is one conversation too."""
    # A row repeats an earlier one if its first place is not the first of its role and text.
    known = rows.withColumn("conv", F.struct("conv_id")).drop("conv_id")
    place = F.struct("seg", "block", "pos")
    firsts = known.groupBy("conv", "h").agg(F.min(place).alias("first"))
    known = spread_join(known, firsts, ["conv", "h"], ["seg", "block", "pos"])
    fault = F.when(F.col("blank"), BLANK).when(F.col("first") < place, DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    known = stored(known.select("conv.conv_id", "seg", "block", "pos", "turn", "role", "text", fault.alias("fault")), "blocks")
    narrow = known.select("conv_id", "seg", "block", "pos", "role", "fault")
    key = ["conv_id", "seg", "block"]
    of_block = "conv_id bigint, seg bigint, block int"
    sums = stored(narrow.groupBy(*key).applyInPandas(_summed, f"{of_block}, flat array<bigint>, head string, foot string, illegal bigint, blanks bigint, duplicates bigint, cuts bigint"), "matrices")
    # A conversation has a few numbers for each block here, and at most a block for each task and each BLOCK_ROWS rows.
    ends = stored(sums.select(*key, "flat").groupBy("conv_id").applyInPandas(_backward, f"{of_block}, end array<bigint>, last boolean, cost bigint"), "ends")
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.seg") == F.col(f"{b}.seg")) & (F.col(f"{a}.block") == F.col(f"{b}.block"))
    with_end = narrow.alias("n").join(ends.alias("e"), same("n", "e")).select("n.*", "e.end", "e.last")
    plans = stored(with_end.groupBy(*key).applyInPandas(_planned, f"{of_block}, plans array<string>, after array<int>"), "plans")
    entries = plans.select(*key, "after").groupBy("conv_id").applyInPandas(_forward, f"{of_block}, entry int")
    chosen = stored(plans.alias("p").join(entries.alias("e"), same("p", "e")).select("p.conv_id", "p.seg", "p.block", F.element_at("p.plans", F.col("e.entry") + 1).alias("plan")), "chosen")

    lead = chosen.select(*key, F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"), "plan")
    stream = lead.unionByName(known.select(*key, "pos", "role", "text", F.lit("").alias("plan")))
    shas = stream.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "block", "pos").mapInArrow(_digests, "conv_id bigint, repaired_sha256 string")

    turns = known.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    piece = F.struct("seg", "block", "head", "foot")
    counts = sums.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("ends"), *[F.sum(c).alias(c) for c in ("illegal", "blanks", "duplicates", "cuts")])
    pairs = F.zip_with(F.expr("slice(ends, 1, size(ends) - 1)"), F.expr("slice(ends, 2, size(ends) - 1)"), lambda a, b: F.concat(a["foot"], b["head"]))
    counts = counts.withColumn("illegal", F.col("illegal") + F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))))
    plan = chosen.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "block", "plan"))).alias("p"))
    plan = plan.select("conv_id", F.array_join(F.transform("p", lambda x: x["plan"]), "").alias("audit"))
    out = counts.drop("ends").alias("l")
    for other in (ends.select("conv_id", "cost").distinct(), plan, shas, turns):
        hit = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id"))
        out = out.join(other.alias("r"), hit, "left").select("l.*", *[F.col(f"r.{c}") for c in other.columns if c != "conv_id"]).alias("l")
    return out.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("bigint"))).select("conv_id", *COUNTS, "cost", "audit", "repaired_sha256")


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """turns (conv_id, turn, role, text, without nulls in role and text) -> one row for each conversation.

    gaps, blanks, duplicates, cuts, illegal: what is wrong before the repair, each turn by its first fault; cost, audit:
    the cheapest edits; repaired_sha256: digest of the repaired `role:text`, newline-joined. Turns are in the order of
    turn, nulls first, ties by role and then by the digest of role and text; repeated rows are turns each. Roles are told
    apart by their first letter, and a role without one cannot be kept. Null conv_id is one conversation. Other columns
    go. Empty table: no rows.
    """
    small_batches(turns.sparkSession)
    h = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    blank, cut = _faults(F.col("text"))
    rows = turns.select("conv_id", "turn", "role", "text", h.alias("h"), blank.alias("blank"), cut.alias("cut"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "h", "row")]  # rows equal in all but row are interchangeable
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    done = stored(dealt.mapInArrow(_pass(block_rows), PASS), "repaired")
    whole = done.where("kind = 'whole'").select("conv_id", *COUNTS, "cost", "audit", "repaired_sha256")
    return whole.unionByName(_in_blocks(done.where("kind = 'row'").select("conv_id", "seg", "block", "pos", "turn", "role", "text", "h", "blank", "cut")))


def op11_subsequence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repair(damaged(turns)).alias("r")
    every = turns.select("conv_id").distinct().alias("c")
    zero = F.lit(0).cast("bigint")
    names = {"gaps": "gaps", "blank": "blanks", "duplicate": "duplicates", "truncated": "cuts", "illegal": "illegal", "cost": "cost"}
    out = every.join(found, F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("c.conv_id", *[F.coalesce(f"r.{c}", zero).alias(name) for name, c in names.items()], F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("r.repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _sql() -> str:
    """The same by a walk over edits: every state keeps its cheapest edits as (cost, audit, turns), from the last turn on."""
    states = ("start", "s", "u", "a")
    step = {"start": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}
    keeps = {"start": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    at_end = {"start": (0, "", "[]"), "s": (6, "II", "['user:', 'assistant:']"), "u": (3, "I", "['assistant:']"), "a": (0, "", "[]")}
    made = lambda cost, initial, rest, turn: f"{{'c': {cost} + {rest}.c, 'a': '{initial}' || {rest}.a, 't': {turn} || {rest}.t}}"
    none = "CAST([] AS VARCHAR[])"

    def consume(q: str) -> str:
        to, name = step[q]
        stay = "CASE WHEN fault IN (1, 2) THEN 1000000000 WHEN fault = 3 THEN 3 ELSE 0 END"
        kept = [made(f"CASE WHEN initial = '{r}' THEN {stay} ELSE 1000000000 END", "K", r, "[role || ':' || text]") for r in keeps[q]]
        return f"list_min([{', '.join([made(4, 'D', q, none), made(f'3 + {stay}', 'R', to, f"['{name}:' || text]"), *kept])}]) AS {q}0"

    insert = [f"""list_min([{q}0, {made(3, "I", f"{step[q][0]}0", f"['{step[q][1]}:']")}]) AS {q}""" for q in states]
    ends = [f"{{'c': {c}, 'a': '{a}', 't': CAST({t} AS VARCHAR[])}} AS {q}" for q, (c, a, t) in at_end.items()]
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
c AS (SELECT *, xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(range(1, length(id) + 1), lambda i: [CAST(ascii(id[i]) AS BIGINT)] || CAST([-1, -1, -1, -1, -1, -1, -1, -1] AS BIGINT[]))),
  lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) ELSE xor(h >> 1, 3988292384 * (h & 1)) END), 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
o AS (SELECT *, role[1] AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{SPACE}]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][{SPACE}]*$') THEN 3 ELSE 0 END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
w AS (SELECT DISTINCT conv_id, n + 1 AS i, {", ".join(ends)} FROM f
  UNION ALL SELECT conv_id, i, {", ".join(insert)} FROM (SELECT f.conv_id, f.i, {", ".join(map(consume, states))} FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i - 1))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(w.start.c, 0) AS BIGINT) AS cost,
  coalesce(w.start.a, '') AS audit, sha256(coalesce(array_to_string(w.start.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND w.i = 1"""


QUERIES = {"op11_subsequence_repair": op11_subsequence_repair}
ORACLES = {"op11_subsequence_repair": _sql()}
