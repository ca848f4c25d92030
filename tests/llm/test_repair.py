import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldmark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, row long, conv string, seq long, fault string"
SPACE = " \t\n\v\f\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, "f") for r in rows], SCHEMA).repartition(4)


def spoilt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = "".join(c for c in text if c not in SPACE)
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(rows, faults):
    """(cost, audit) by recursion over whole audits."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    due = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        options = []
        if i == len(rows):
            if last in ("", "a"):
                options.append((0, "", ()))
        else:
            options.append((4, "D", (i + 1, last, 0)))
            if faults[i] not in (1, 2):
                more = 3 * (faults[i] == 3)
                first = rows[i][2][:1]
                if (last, first) in step:
                    options.append((more, "K", (i + 1, first, 0)))
                options.append((3 + more, "R", (i + 1, due[last], 0)))
        if inserted < 3:
            options.append((3, "I", (i, due[last], inserted + 1)))
        found = []
        for cost, letter, then in options:
            rest = best(*then) if then else (0, "")
            if rest:
                found.append((cost + rest[0], letter + rest[1]))
        return min(found) if found else None

    return best(0, "", 0)


def brute(original, rows):
    out = []
    for conv in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = faults_of(own)
        cost, audit = plain_repair(own, faults)
        turns = {r[1] for r in own if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        lines, at, last = [], 0, ""
        for e in audit:
            role = {"": "user", "s": "user", "a": "user", "u": "assistant"}[last]
            if e == "I":
                lines.append(role + ":")
            else:
                if e == "K":
                    role = own[at][2]
                if e != "D":
                    lines.append(f"{role}:{own[at][3]}")
                at += 1
            if e != "D":
                last = role[0]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
                    illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(str, out))


def logs(seed):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "open", " \t", "", None, "Why? ", "A.\n", "été", "王。", "long " * 50 + "."]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rnd.choice([0, 1, 2, 3, 6, 9, 14])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "Ü"])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 3, None]), role, rnd.choice(texts) or rnd.choice([None, ""])))
            if rnd.random() < 0.7 and rows[-1][3]:
                rows[-1] = (*rows[-1][:3], f"{rnd.randrange(99)} {rows[-1][3]}")
    return rows


@pytest.mark.parametrize("block", [2048, 3, 1])
def test_report_against_plain_recursion(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = logs(block)
    original = frame(spark, rows)
    got = repair.report(original, repair.damaged(original)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, spoilt(rows))


def test_damage(spark):
    rows = logs(7)
    got = repair.damaged(frame(spark, rows)).select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, spoilt(rows)))


def test_edits_give_the_repaired_log(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Go on."), (1, 2, "assistant", "Cut"), (2, None, "system", "S."), (3, 5, "user", "")]
    edits, _, _ = repair.repaired(frame(spark, rows))
    got = [tuple(r) for r in edits.orderBy("conv", "seq").select("conv", "edit", "cost", "turn", "role", "text").collect()]
    assert got == [
        ("=1", "K", 0, 0, "user", "Hi."), ("=1", "I", 3, None, "assistant", ""), ("=1", "K", 0, 1, "user", "Go on."),
        ("=1", "K", 3, 2, "assistant", "Cut"), ("=2", "D", 4, None, "system", "S."), ("=3", "D", 4, 5, "user", "")]


def test_ranks_order_the_least_audits():
    rnd = np.random.default_rng(3)
    codes = [rnd.choice([0, 1, 2, 1, 2, 13, 14, 5, 8], n) for n in (0, 1, 5, 40)]
    blocks = repair.Blocks(codes, [True] * 4)
    letter, target = blocks.least_arcs(blocks.costs(np.tile(repair._ENDS, (4, 1))))
    rank, pointers, steps = repair.doubled(letter, target)
    audits = []
    for v in range(blocks.total):
        text, at = "", v
        while letter[at] >= 0:
            text += repair.LETTERS[letter[at]]
            at = target[at]
        assert steps[v] == len(text) and pointers[-1][v] == at
        audits.append(text)
    order = {a: k for k, a in enumerate(sorted(set(audits)))}
    assert [order[a] for a in audits] == list(rank)


def test_one_long_conversation_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 64)
    rows = [(1, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(1500)] + [(1, 2000, "user", "x" * 1_000_000)]
    r = repair.report(frame(spark, rows), frame(spark, rows)).first()
    assert (r["gaps"], r["truncated"], r["illegal"], r["cost"]) == (500, 1, 0, 4) and r["audit"] == "K" * 1500 + "D"
    none = frame(spark, [])
    assert repair.report(none, repair.damaged(none)).count() == 0
    only = frame(spark, rows[:1])
    assert [tuple(x) for x in repair.report(only, only.where(F.lit(False))).collect()] == [
        (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_conversations_of_a_batch_leave_together():
    """A batch of one row for each conversation cost many times its hash."""
    rows = [(f"={k // 3}", "DKR"[k % 3], 4 * (k % 3 == 0), "user", f"t{k}") for k in range(3000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a:a + 1000], strict=True)], ["conv", "edit", "cost", "role", "text"])
               for a in range(0, 3000, 1000)]
    out = list(repair._digested(batches))
    got = pa.Table.from_batches(out).to_pylist()
    assert len(out) <= 4 and [r["conv"] for r in got] == [f"={k}" for k in range(1000)]
    assert all((r["cost"], r["audit"]) == (4, "DKR") for r in got)
    assert got[333]["repaired_sha256"] == hashlib.sha256(b"user:t1000\nuser:t1001").hexdigest()


def test_edits_carry_their_cost_and_are_read_once(spark, monkeypatch):
    """The cost came by a join of all rows with their faults, and the edits were written with their texts to be read twice."""
    names, real = [], repair.stored
    monkeypatch.setattr(repair, "stored", lambda df, name: (names.append(name), real(df, name))[1])
    texts = ["Hello.", "open end", "Hello.", "", "\x0b \t", "Fine! \n", "open end"]
    rows = [(c, t, ["user", "assistant", "system", "tool"][(t + c) % 4], texts[(t * 3 + c) % 7]) for c in range(9) for t in range(11)]
    edits, faults, _ = repair.repaired(frame(spark, rows))
    fault = {(r["conv"], r["turn"]): r["fault"] for r in faults.collect()}
    prices = {"D": 4, "I": 3, "R": 3, "K": 0}
    got = edits.collect()
    assert all(r["cost"] == prices[r["edit"]] + 3 * (r["edit"] in "KR" and fault[r["conv"], r["turn"]] == 3) for r in got)
    assert {r["edit"] for r in got} == set("DIKR") and any(r["cost"] == 6 for r in got)
    repair.report(frame(spark, rows), frame(spark, rows)).count()
    assert "repair-edits" not in names
