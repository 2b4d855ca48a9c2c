"""Conversation repair against a search over single edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from loam.llm import conversations, queries

CONV = "conv_id long, turn long, role string, text string"
SP = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        blank = lambda x: " " if x is None else x
        k = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        role, text = blank(role), blank(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(symbols):
    """(cost, edits, new roles) by a search in order of (cost, edits); symbols: (initial, must go, truncated)."""
    heap = [(0, "", 0, 0, ())]
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    seen = set()
    while True:
        cost, edits, i, q, roles = heapq.heappop(heap)
        if i == len(symbols) and q in (0, 3):
            return cost, edits, roles
        if (i, q) in seen and len(edits) > 8:
            continue
        seen.add((i, q))
        for r in "ua":
            if (q, r) in step:
                heapq.heappush(heap, (cost + 5, edits + "I", i, step[q, r], (*roles, ("I", r))))
        if i < len(symbols):
            init, gone, cut = symbols[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, q, roles))
            if not gone:
                if (q, init) in step:
                    heapq.heappush(heap, (cost + 5 * cut, edits + "K", i + 1, step[q, init], (*roles, (i, "K"))))
                for r in "ua":
                    if (q, r) in step:
                        heapq.heappush(heap, (cost + 1 + 5 * cut, edits + "R", i + 1, step[q, r], (*roles, (i, r))))


def expected(rows, ids):
    out = {}
    for c in ids:
        mine = [r for r in rows if r[0] == c]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        turns = [r[1] for r in mine if r[1] is not None]
        seen, symbols, n = set(), [], {"blank": 0, "dup": 0, "cut": 0}
        for _, _, role, text in mine:
            blank, dup = not text.strip(SP), (role, text) in seen
            cut = not blank and text.rstrip(SP)[-1] not in ".!?"
            n["blank"] += blank
            n["dup"] += dup and not blank
            n["cut"] += cut and not dup
            seen.add((role, text))
            symbols.append((role[:1] if role[:1] in ("s", "u", "a") and role else "o", blank or dup, int(cut and not dup)))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        cost, edits, roles = cheapest(symbols)
        name = {"u": "user", "a": "assistant"}
        lines = [f"{name[r]}:" if i == "I" else f"{mine[i][2] if r == 'K' else name[r]}:{mine[i][3]}" for i, r in roles]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, n["blank"], n["dup"], n["cut"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk():
    rnd = random.Random(11)
    rows = []
    for c in range(160):
        turn = 0
        for _ in range(rnd.randint(1, 9)):
            turn += rnd.choice([0, 1, 1, 1, 1, 2])
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Hi there.", "What? ", "no end", "So!\n", "", " \t", None, "ok."]) if rnd.random() < 0.5 else f"line {rnd.random()}."
            rows.append((c, rnd.choice([turn, turn, turn, None]), role, text))
    rows += [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (None, 2, "assistant", "B.")]
    rows += [(900, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(60)]
    rows += [(901, t, "user" if t % 3 else "assistant", "é" * 30000 + ("." if t % 4 else "")) for t in range(4)]
    # every row is dropped
    rows += [(c, 3, "user", "gone.") for c in range(1000, 1100) if zlib.crc32(f"{c}:3".encode()) % 20 == 0]
    return rows


@pytest.mark.parametrize("size", [4, conversations.SEGMENT])
def test_repair_equals_search(spark, size):
    rows = talk()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONV + ", part int, word string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.digest(conversations.damage(df), df, size).collect()}
    want = expected(damaged(rows), {r[0] for r in rows})
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c
    assert any(r[0] >= 1000 for r in rows if r[0] is not None)


def test_equal_rows_of_one_turn_and_empty_table(spark, tmp_path):
    rows = [(1, 1, "user", "Same.")] * 7 + [(1, None, "user", "Same.")] * 2
    df = spark.createDataFrame(rows, CONV)
    got = conversations.digest(df, df, 3).collect()[0]
    assert (got["duplicate"], got["gaps"], got["cost"], got["audit"]) == (8, 0, 2 * 9, "D" * 9)
    empty = spark.createDataFrame([], CONV)
    assert conversations.digest(empty, empty).collect() == []
    spark.createDataFrame(talk(), CONV).write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op11_conversation_repair(spark, str(tmp_path)).columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_nodes_share_endings():
    """A node depends on its ending only, and joining two words at any place gives the word's node."""
    node = conversations.end_node(conversations.END)
    for s in reversed("suaUAD"):
        node = conversations.node_before(s, node)
    half = conversations.end_node(conversations.END)
    for s in reversed("UAD"):
        half = conversations.node_before(s, half)
    whole = conversations.end_node(tuple(half[0]))
    for s in reversed("sua"):
        whole = conversations.node_before(s, whole)
    assert whole[0] == node[0]
    assert [a + half[1][o] for a, o in zip(whole[1], whole[2])] == node[1]
