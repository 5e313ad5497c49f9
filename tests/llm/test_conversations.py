"""Conversation repair against a uniform-cost search over single edits, row by row."""

import hashlib
import heapq
import random
import re
import zlib

from inkspan.llm import conversation_repair, queries
from inkspan.llm.common import table

SPOKEN = r"[^\x20\x09-\x0D]"


def damaged(rows):
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))


def cheapest(rows):
    """(cost, audit, repaired lines) of one conversation's sorted rows with their faults."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(out)
        role = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*out, role + ":")))
        if i < len(rows):
            (_, _, said, text), fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, role[0], (*out, f"{role}:{text}")))
                if said[:1] == role[0] or (said[:1] == "s" and state == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, said[0], (*out, f"{said}:{text}")))


def expected(rows, convs):
    found = {}
    for conv in convs:
        mine, seen, flagged = in_order(r for r in rows if r[0] == conv), set(), []
        for r in mine:
            spoken = re.findall(SPOKEN, r[3])
            fault = "blank" if not spoken else "duplicate" if r[2:] in seen else "truncated" if spoken[-1] not in ".!?" else ""
            seen.add(r[2:])
            flagged.append((r, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, text = cheapest(flagged)
        counts = [sum(f == k for _, f in flagged) for k in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def as_rows(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_op12_equals_search(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(queries.op12_conversation_repair(spark, sf)) == expected(list(damaged(rows)), {r[0] for r in rows})


def made(n, seed):
    """Short random conversations with every fault, null fields, other roles, ties and a long one."""
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", "admin", None], ["a.", "b", "c!", "", " \n", "why?\t", "é…", None, *[f"x{i}." for i in range(6)]]
    sizes = [(i, rng.randrange(1, 9)) for i in range(n)] + [(None, 7), (n, 60)]
    return [(c, rng.choice([None, *range(7)]) if size < 60 else rng.randrange(400), rng.choice(roles), rng.choice(texts)) for c, size in sizes for _ in range(size)]


def test_repair_of_odd_conversations(spark):
    rows = made(150, 5)
    rows += rows[:9]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, n int")
    for block in (2, 256):  # with blocks of two rows, nearly every conversation is joined from several
        again = [(*[" " if v is None and i > 1 else v for i, v in enumerate(r)],) for r in rows]
        want = expected(again, {r[0] for r in rows})
        audits = conversation_repair.audit_conversations(turns, block=block)
        got = {r["conv_id"]: tuple(r[c] for c in COLUMNS[:-1]) for r in audits.collect()}
        assert got == {k: v[:-1] for k, v in want.items()}
    made_turns = conversation_repair.repaired_turns(turns, audits).collect()
    for conv, found in want.items():
        mine = sorted((r for r in made_turns if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == found[-1]
    damaged_rows = conversation_repair.damage(turns)
    assert as_rows(conversation_repair.repair_conversations(damaged_rows, times_col="times")) == expected(list(damaged(rows)), {r[0] for r in rows})


def test_no_conversation(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair_conversations(turns).collect() == []
    turns = spark.createDataFrame([(4, 1, "user", "a.", 0)], "conv_id long, turn long, role string, text string, times int")
    assert as_rows(conversation_repair.repair_conversations(turns, times_col="times")) == {4: (0, 0, 0, 0, 0, 0, "", conversation_repair.EMPTY_SHA256)}
