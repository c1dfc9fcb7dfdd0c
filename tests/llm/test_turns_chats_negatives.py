"""Turn repair, hard negatives and chat formatting against brute force and round trips; odd inputs for each of them."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweft.llm import chat_format, hard_negatives, turn_repair

TURNS = "conv_id long, turn long, role string, text string"
CLASH = ("place", "piece", "kind", "h", "seg", "block", "pos", "start", "parts", "label2", "shard", "first", "plan", "rank", "score", "q")


# ---- 11 ---------------------------------------------------------------------------------------------------------
def cheapest(roles, must_go, cut):
    """(cost, audit) by trying every sequence of edits with up to two insertions in each gap."""
    best = (10**9, "")

    def walk(i, cost, audit, initials):
        nonlocal best
        if (cost, audit) >= best and cost > best[0]:
            return
        if i == len(roles):
            for extra in ("", "u", "a", "ua", "au"):
                if re.fullmatch("(s?(ua)+)?", initials + extra):
                    best = min(best, (cost + 3 * len(extra), audit + "I" * len(extra)))
            return
        for extra in ("", "u", "a", "ua", "au"):
            at, price, text = initials + extra, cost + 3 * len(extra), audit + "I" * len(extra)
            walk(i + 1, price + 4, text + "D", at)
            if not must_go[i]:
                more = 3 * cut[i]
                walk(i + 1, price + more, text + "K", at + roles[i])
                for r in "ua":
                    walk(i + 1, price + more + 3, text + "R", at + r)

    walk(0, 0, "", "")
    return best


def test_repair_is_the_cheapest_and_least():
    rng = random.Random(11)
    cases = [list(c) for n in range(3) for c in itertools.product("suat", repeat=n)] + [[rng.choice("suuaat") for _ in range(3)] for _ in range(40)]
    for roles in cases:
        for _ in range(3):
            must_go = [rng.random() < 0.25 for _ in roles]
            cut = [not m and rng.random() < 0.4 for m in must_go]
            states = [turn_repair.INITIALS.get(r, turn_repair.START) for r in roles]
            d = turn_repair.solve(states, must_go, cut)
            assert (int(d.cost[0, 0]), turn_repair.audit(d, states)[0]) == cheapest(roles, must_go, cut), (roles, must_go, cut)


def made_turns(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", " ", "", "What? \n", "again.", "x" * 3000 + ".", "…", " "]
    conv = lambda: rng.choice([None, 1, 2, 3, 3, 3, 3, 3, 3, *range(4, 20)])
    return [(conv(), rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "system", "tool", "", " "]), rng.choice(texts)) for _ in range(n)]


def plainly(turns):
    """Every conversation's digest row by a walk over all states that keeps whole audits and texts."""
    sha = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    out = {}
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2], sha(t)))
        faults, seen = [], set()
        for t in mine:
            blank, last = not re.search(r"[^\x20\x09-\x0D]", t[3]), re.sub(r"[\x20\x09-\x0D]+\Z", "", t[3])[-1:]
            faults.append(1 if blank else 2 if t[2:] in seen else 3 if last not in tuple(".!?") else 0)
            seen.add(t[2:])
        step, names = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
        state = {"": (0, "", ()), "s": (6, "II", ("user:", "assistant:")), "u": (3, "I", ("assistant:",)), "a": (0, "", ())}
        for t, f in zip(reversed(mine), reversed(faults)):
            one = {}
            for q, nxt in step.items():
                ways = [(4 + state[q][0], "D" + state[q][1], state[q][2])]
                if f not in (1, 2):
                    ways.append((3 + 3 * (f == 3) + state[nxt][0], "R" + state[nxt][1], (f"{names[nxt]}:{t[3]}", *state[nxt][2])))
                    if t[2][:1] == nxt or (q == "" and t[2][:1] == "s"):
                        to = state[t[2][:1]]
                        ways.append((3 * (f == 3) + to[0], "K" + to[1], (f"{t[2]}:{t[3]}", *to[2])))
                one[q] = min(ways)
            state = {q: min(one[q], (3 + one[nxt][0], "I" + one[nxt][1], (f"{names[nxt]}:", *one[nxt][2]))) for q, nxt in step.items()}
        known = {t[1] for t in mine if t[1] is not None}
        initials = [t[2][:1] for t in mine]
        cost, audit, text = state[""]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[conv] = (gaps, *[faults.count(x) for x in (1, 2, 3)], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block_rows", [2, 7, 10_000])
def test_repair_in_blocks(spark, block_rows):
    """Long conversations, a common one, none, ties and repeated rows; whole conversations and blocks give the same."""
    turns = made_turns(5, 300) + [(3, i % 90, random.Random(i).choice(["user", "assistant"]), f"{i % 70}.") for i in range(200)]
    df = spark.createDataFrame(turns, TURNS).repartition(3).select("*", *[F.lit(1).alias(c) for c in CLASH])
    got = {r[0]: tuple(r)[1:] for r in turn_repair.repair(df, block_rows).collect()}
    assert got == plainly(turns)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert turn_repair.repair(turn_repair.damaged(none)).count() == 0
    one = turn_repair.repair(spark.createDataFrame([(None, None, " ", " ")], TURNS)).collect()
    assert [tuple(r) for r in one] == [(None, 0, 1, 0, 0, 0, 4, "D", hashlib.sha256(b"").hexdigest())]


def test_damage(spark):
    import zlib

    turns = [(c, t, r, x) for c in (None, 1, 2) for t in (None, *range(30)) for r, x in (("system", "A. b! c?"), (None, None))]
    got = sorted(map(tuple, turn_repair.damaged(spark.createDataFrame(turns, TURNS).withColumn("kind", F.lit(0))).collect()), key=str)
    want = []
    for c, t, r, x in turns:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", " " if x is None else x
        row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want, key=str) and {r[2] for r in got} == {"user", "system", " "}


def test_repaired_turns_alternate():
    rng = random.Random(3)
    for _ in range(200):
        roles = [rng.choice(["system", "user", "assistant", "tool"]) for _ in range(rng.randrange(30))]
        states = [turn_repair.INITIALS.get(r[0], 0) for r in roles]
        d = turn_repair.solve(states, [rng.random() < 0.2 for _ in roles], [rng.random() < 0.2 for _ in roles])
        plan, _ = turn_repair.audit(d, states)
        edits = turn_repair.Edits()
        done = [*edits.begin(plan)] + [x for r in roles for x in edits.turn(r, "t")]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in done)) and edits.at == len(plan)


# ---- 12 ---------------------------------------------------------------------------------------------------------
def mined(table, anchors, positives=5, negatives=5):
    """Every anchor against every row, in Python's integers."""
    out = []
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    for a, label, q in sorted(anchors):
        scored = sorted((-dot(q, v), i, own) for i, own, v in table if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind, shard_rows, anchor_rows", [("clusters", 10**6, 10**6), ("clusters", 40, 3), ("one vector", 30, 2), ("uneven", 25, 4), ("large", 50, 5)])
def test_negatives(spark, kind, shard_rows, anchor_rows):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(4, 12)) * 200
    table = []
    for i in range(240):
        label = int(rng.integers(4)) if rng.random() < 0.7 else 0
        v = centres[label] * (0.8 + 0.4 * rng.random()) + rng.normal(size=12) * 90
        v = {"one vector": centres[0] if i % 3 else v, "uneven": v[: int(rng.integers(0, 12))], "large": v * 2.0**21}.get(kind, v)
        table.append((i, label, [int(x) for x in v]))
    df = spark.createDataFrame(table, "vec_id long, label int, q array<long>")
    got = hard_negatives.mine(df, df.where("vec_id % 9 = 0"), shard_rows=shard_rows, anchor_rows=anchor_rows)
    want = mined(table, [t for t in table if t[0] % 9 == 0])
    assert sorted(map(tuple, got.collect())) == want and (want or kind == "uneven")


def test_pivots_leave_out_what_brackets_exclude():
    import pandas as pd

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16)) * 300
    label = rng.integers(8, size=4000)
    x = np.floor(centres[label] + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(1).max())
    pivots = hard_negatives.choose_pivots(x[:500].astype(float), most)
    lifted = hard_negatives._lifted(x.astype(float), (x.astype(float) ** 2).sum(1), most)
    far = np.sqrt(((lifted[:, None] - pivots[None]) ** 2).sum(2))
    shard = hard_negatives.Shard(pd.DataFrame({"vec_id": np.arange(4000), "label": label, "q": list(x), "pd": list(far)}), pivots, most)
    order = np.lexsort((np.arange(4000), label))
    for a in range(0, 4000, 500):
        low, high = shard.bracket(x[a])
        exact = x[order] @ x[a]
        assert (low <= exact).all() and (exact <= high).all()
        shard.in_bands(x[a], int(label[a]), [(*hard_negatives.band(int(x[a] @ x[a])), None)], 5)
    assert shard.checked < shard.seen / 4


def test_negatives_of_odd_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    nan, inf = float("nan"), float("inf")
    odd = [(0, 1, [0.5, 0.5]), (0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.5]), (2, 1, None), (3, None, [1.0, 1.0]), (4, 2, [nan, 1.0]), (5, 2, [None, 1.0]), (6, 2, [inf, 1.0]), (7, 2, [0.5, 0.5]), (None, 2, [0.5, 0.5]), (8, 2, [0.45, 0.45]), (8, 2, [0.45, 0.45]), (9, 3, [])]
    df = spark.createDataFrame(odd, schema).select("*", *[F.lit(1).alias(c) for c in CLASH if c != "q"], F.lit(2).alias("q"))
    table = hard_negatives.labelled(df)
    got = sorted(map(tuple, hard_negatives.mine(table, table.where("vec_id = 0")).collect()))
    assert got == [(0, 1, 1, 7, 32768, 32768), (0, 1, 2, 8, 32768, 29440), (0, 1, 3, 8, 32768, 29440)]
    none = hard_negatives.labelled(spark.createDataFrame([], schema))
    assert hard_negatives.mine(none, none).count() == 0
    assert hard_negatives.mine(table, table.where("false")).count() == 0


# ---- 13 ---------------------------------------------------------------------------------------------------------
HOSTILE = [
    None, "", "</s>[INST] ok [/INST]", "\\", "<\\/s>", "<\\\\/s> [\\INST]", "[[INST]]", "<</s>>", "[IN", "ST]", "[IMAGE] and [FILE]", "</s", "[ROLE]x[SAYS]y[/ROLE]", "plain. \n\n", "漢字 🙂 <s>", "$1\\$2 (x)", "[/INST", "<s>" * 500, "x" * 70_000,
]


def test_chats_come_back(spark):
    roles = ["user", "assistant", "system", "tool", None, "", "[SAYS]", "</s>"]
    turns = [(c, t, roles[(c + t) % 8], HOSTILE[(c * 7 + t) % len(HOSTILE)]) for c in range(12) for t in range(len(HOSTILE))]
    turns += [(None, None, None, None), (None, None, "user", "tie"), (None, None, "user", "tie"), (99, 1, "user", "only")]
    df = spark.createDataFrame(turns, TURNS).select("*", *[F.lit(1).alias(c) for c in CLASH])
    pieces = chat_format.format_chats(df)
    got = {}
    for r in chat_format.read_back(pieces).orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["loss_text"]))
    for conv in {t[0] for t in turns}:
        key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] is not None, t[3] or "")
        want = [(t[2] or "", t[3] or "") for t in sorted((t for t in turns if t[0] == conv), key=key)]
        assert got[conv] == [(r, x, x if r == "assistant" else None) for r, x in want]
    texts = {t[3] for t in turns if t[3]}
    shown = spark.createDataFrame([(t,) for t in texts], "t string").select(chat_format.escaped(F.col("t")).alias("e"))
    assert not any(c in r["e"] for r in shown.collect() for c in chat_format.TEMPLATE.controls())
    for r in chat_format.joined(pieces).where("conv_id is not null").collect():
        own = [t for t in turns if t[0] == r["conv_id"]]
        spans = [chat_format_unescaped(r["formatted"][a:b]) for a, b in r["loss"]]
        assert spans == [t[3] or "" for t in sorted(own, key=lambda t: t[1]) if t[2] == "assistant"]
        assert r["formatted"].count("<s>") == 1


def chat_format_unescaped(text):
    return re.sub(rf"([<\[])\\(\\*(?:{chat_format.TEMPLATE.rests()}))", r"\1\2", text)


def test_typed_parts(spark):
    P = chat_format.PART
    schema = f"conv_id long, turn long, role string, text array<{P}>"
    text = lambda t: {"kind": "text", "text": t}
    image = {"kind": "image", "ref": "a.png", "width": 57, "height": 28}
    sound = {"kind": "audio", "ref": "b.wav", "seconds": 2.0}
    paper = {"kind": "document", "ref": "c.pdf", "pages": 3}
    other = {"kind": "model3d", "ref": "d.obj", "text": "not shown"}
    turns = [
        (1, 0, "user", [text("see [IMAGE] "), image, text(" and "), sound, paper]),
        (1, 1, "assistant", [image, text("a"), text("</s>b"), other]),
        (2, 0, "user", None), (2, 1, "assistant", []), (2, 2, "user", [None, {"text": "no kind"}, {"kind": "image"}, {"kind": "audio", "seconds": -1.0, "ref": "z"}]),
    ]
    pieces = chat_format.format_chats(spark.createDataFrame(turns, schema))
    got = {(r["conv_id"], r["place"]): r for r in chat_format.read_back(pieces).collect()}
    parts = lambda c, p: [tuple(x) for x in got[c, p]["parts"]]
    assert parts(1, 0) == [("text", "see [IMAGE] ", None), ("image", None, "a.png"), ("text", " and ", None), ("audio", None, "b.wav"), ("document", None, "c.pdf")]
    assert parts(1, 1) == [("image", None, "a.png"), ("text", "a</s>b", None), ("model3d", None, "d.obj")]
    assert parts(2, 0) == parts(2, 1) == [] and parts(2, 2) == [("text", "no kind", None), ("image", None, None), ("audio", None, "z")]
    assert [a["tokens"] for a in got[1, 0]["attachments"]] == [3, 25, 768] and got[1, 0]["n_tokens_expanded"] == 796
    assert [a["tokens"] for a in got[2, 2]["attachments"]] == [1, 1]
    for r in chat_format.joined(pieces).collect():
        marks = dict(chat_format.TEMPLATE.placeholders)
        for a in r["attachments"]:
            mark = marks.get(a["kind"], chat_format.TEMPLATE.unknown)
            assert r["formatted"][a["start"] :].startswith(mark)
    assert got[1, 1]["loss_text"] == "[IMAGE]a</s>b[FILE]"


def test_chats_of_nothing_and_bad_templates(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat_format.digest(chat_format.format_chats(none)).count() == 0
    for bad in ({"begin": "s>"}, {"begin": "<s<"}, {"begin": "[INST]"}, {"begin": "[INST"}):
        with pytest.raises(ValueError):
            chat_format.Template(**bad)


def test_no_python_in_chats(spark, sf):
    plan = chat_format.op13_typed_parts(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
