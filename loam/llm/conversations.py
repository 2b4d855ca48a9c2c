"""Conversation repair by a suffix-shared automaton of structure signatures.

A conversation is read as one symbol per row: its role (system, user,
assistant, other), sound or truncated, or a row that must go (blank, or a
duplicate of an earlier row). All that the cheapest repair depends on is this
word and the grammar ``(s?(ua)+)?``, so equal endings are worked out once for
all conversations:

1. Rows become narrow (no text): keys, role initial, fault, 128-bit hash of
   (role, text). Equal rows merge, the first place of each text within its
   conversation is a grouped minimum. The rows are range-partitioned by
   (conversation, turn, role, hash), so a conversation of any size spreads over
   tasks, and each task writes runs of at most ``SEGMENT`` symbols.
2. The distinct words are sorted by their ends and range-partitioned. A task
   builds the automaton incrementally: of two neighbours in this order, the
   common ending keeps its nodes, and only what differs is new. A node holds
   for every grammar state the cost-to-go, the best audit suffix and the state
   in which the word ends. Edits of equal cost have different initials, so the
   ASCII-least audit needs no look-ahead.
3. A conversation of several segments is worked from its end: costs between
   all pairs of grammar states of each segment (the automaton started from
   each state alone), folded to the cost vector behind each segment, which is
   the automaton's end for that segment; then forward through the states.
4. ``digest`` streams the texts of each conversation in order beside its
   audit; only this hash, sequential by nature, needs a conversation in one
   task, in memory of one byte a row.

Defined cases: a null role or text counts as one space, a null conversation id
is a conversation of its own, null turns come first and are no gap; rows of the
same turn are ordered by role and by hash; an empty role is like any unknown
one (it has to be changed or deleted); without rows all counts are zero and the
audit is empty; an empty table gives no rows; texts of any length are handled
row by row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import cut_lineage

#: Most symbols of one segment.
SEGMENT = 1024
#: A word of more than one in so many segments is frequent.
FREQUENT = 1000
#: Costs (fixed by the task).
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 40
#: Grammar states: nothing yet, after s, after u, after a. The first and the
#: last may end a conversation.
STATES = 4
END = (0, FAR, FAR, 0)
#: The state after each role, from each state.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None, None, None, None)}
#: The state after the only role that can be put in each state.
FORCED = (2, 2, 3, 2)
#: Pairs of role initials that may stand side by side.
LEGAL = ("su", "ua", "au")

Node = tuple[list[int], list[str], list[int]]


def damage(rows: DataFrame) -> DataFrame:
    """The damage of the test: by crc32 of ``conv_id:turn`` modulo 20 a row is
    dropped (0), emptied (1), loses its ``.!?`` (2), is doubled (3) or turned to
    user (4). Nulls count as one space."""
    blank = F.lit(" ")
    text, role = F.coalesce(rows["text"], blank), F.coalesce(rows["role"], blank)
    key = F.concat(F.coalesce(rows["conv_id"].cast("string"), blank), F.lit(":"), F.coalesce(rows["turn"].cast("string"), blank))
    rows = rows.select(rows["conv_id"].alias("conv_id"), rows["turn"].alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("k"))
    rows = rows.where("k <> 0").select(
        "conv_id", "turn",
        F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.expr("if(k = 3, array(0, 1), array(0))")).alias("copy"))
    return rows.drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and h, the hash of (role, text)."""
    role, text = F.coalesce(rows["role"], F.lit(" ")), F.coalesce(rows["text"], F.lit(" "))
    rows = rows.select(rows["conv_id"].alias("conv_id"), rows["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("h", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, h, init, blank, cut (truncated), n (equal rows) and
    again (the text stood at an earlier turn), one row for all equal rows."""
    first = F.substring("role", 1, 1)
    narrow = _keyed(rows).select(
        "conv_id", "turn", "role", "h",
        F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("init"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    narrow = narrow.groupBy("conv_id", "turn", "role", "h", "init", "blank", "cut").agg(F.count("*").alias("n"))
    narrow = cut_lineage(narrow)
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    # only texts of several turns need their first place
    firsts = narrow.groupBy(F.col("conv_id").alias("c"), F.col("h").alias("g")).agg(F.count("*").alias("times"), F.min(place).alias("at")).where("times > 1")
    joined = narrow.join(firsts, narrow["conv_id"].eqNullSafe(firsts["c"]) & (narrow["h"] == firsts["g"]), "left")
    again = F.col("at").isNotNull() & (F.col("at.some") != F.col("turn").isNotNull()) | F.coalesce(F.col("at.turn") != F.col("turn"), F.lit(False))
    return joined.select("conv_id", "turn", "role", "h", "init", "blank", "cut", "n", again.alias("again"))


_SEGMENTS = pa.schema([
    ("conv_id", pa.string()), ("none", pa.bool_()), ("part", pa.int64()), ("seg", pa.int64()), ("word", pa.string()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()), ("first_init", pa.string()),
    ("last_init", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64())])


def _cut_segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Segments of the sorted rows of one range: small letters for sound rows
    by role, capitals for truncated ones, D for rows that must go."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    out: dict[str, list] = {f.name: [] for f in _SEGMENTS}
    seg, conv, now = -1, None, None

    def close():
        if now:
            now["word"] = "".join(now["word"])
            for k, v in now.items():
                out[k].append(v)

    def flush():
        batch = pa.RecordBatch.from_pydict(out, schema=_SEGMENTS)
        for v in out.values():
            v.clear()
        return batch

    names = ("conv_id", "none", "turn", "init", "blank", "cut", "n", "again")
    for batch in batches:
        for conv_id, none, turn, init, blank, cut, n, again in zip(*(batch.column(c).to_pylist() for c in names)):
            for i in range(n):
                if now is None or conv != (none, conv_id) or len(now["word"]) >= size:
                    close()
                    seg, conv = seg + 1, (none, conv_id)
                    now = {"conv_id": conv_id, "none": none, "part": part, "seg": seg, "word": [], "blank": 0, "duplicate": 0, "truncated": 0,
                           "illegal": 0, "turns": 0, "first_init": init, "last_init": None, "first_turn": None, "last_turn": None}
                    if len(out["seg"]) >= 1024:
                        yield flush()
                if blank:
                    now["blank"] += 1
                elif again or i:
                    now["duplicate"] += 1
                elif cut:
                    now["truncated"] += 1
                now["word"].append("D" if blank or again or i else init.upper() if cut else init)
                if now["last_init"] is not None and now["last_init"] + init not in LEGAL:
                    now["illegal"] += 1
                now["last_init"] = init
                if turn is not None and turn != now["last_turn"]:
                    now["turns"] += 1
                    now["last_turn"] = turn
                    if now["first_turn"] is None:
                        now["first_turn"] = turn
    close()
    yield flush()


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The segments of all conversations, in order of (part, seg)."""
    ranged = _faults(rows).withColumn("none", F.col("conv_id").isNull()).withColumn("conv_id", F.col("conv_id").cast("string"))
    order = [F.col("none").desc(), "conv_id", F.col("turn").asc_nulls_first(), "role", "h"]
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "none", "turn", "init", "blank", "cut", "n", "again")
    return cut_lineage(ranged.mapInArrow(
        partial(_cut_segments, size=size), "conv_id string, none boolean, part long, seg long, word string, blank long, duplicate long, truncated long, illegal long, "
        "turns long, first_init string, last_init string, first_turn long, last_turn long"))


def _settle(node: Node) -> Node:
    """The node with one or two rows put in before it where that is cheaper."""
    cost, audit, out = node

    def put(q, cost, audit, out):
        t = FORCED[q]
        return cost[t] + INSERT, "I" + audit[t], out[t]

    best = list(zip(cost, audit, out))
    loop = {q: min(best[q], put(q, cost, audit, out)) for q in (2, 3)}
    for q in (2, 3):
        best[q] = loop[q]
    for q in (0, 1):
        best[q] = min(best[q], (best[2][0] + INSERT, "I" + best[2][1], best[2][2]))
    return [b[0] for b in best], [b[1] for b in best], [b[2] for b in best]


def end_node(ends: tuple[int, ...]) -> Node:
    """The automaton's last node, for costs ``ends`` of what follows."""
    return _settle((list(ends), [""] * STATES, list(range(STATES))))


def node_before(symbol: str, after: Node) -> Node:
    """The node that reads ``symbol`` and goes on at ``after``."""
    cost, audit, out = after
    best = []
    for q in range(STATES):
        choice = [(cost[q] + DELETE, "D" + audit[q], out[q])]
        if symbol != "D":
            extra = TRUNCATED if symbol.isupper() else 0
            t = NEXT[symbol.lower()][q]
            if t is not None:
                choice.append((cost[t] + extra, "K" + audit[t], out[t]))
            t = FORCED[q]
            choice.append((cost[t] + extra + REROLE, "R" + audit[t], out[t]))
        best.append(min(choice))
    return _settle(([b[0] for b in best], [b[1] for b in best], [b[2] for b in best]))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds the automaton of one range of words sorted by their ends: the
    nodes of the open path are a stack, the common ending of neighbours stays."""
    ends, path, last = None, [], ""
    for batch in batches:
        rows = {"ends": [], "word": [], "times": [], "cost": [], "audit": [], "out": []}
        for e, word, times in zip(*(batch.column(c).to_pylist() for c in ("ends", "word", "times"))):
            if e != ends:
                ends, path, last = e, [end_node(tuple(e))], ""
            same = 0
            while same < len(word) and same < len(last) and word[-1 - same] == last[-1 - same]:
                same += 1
            del path[same + 1:]
            for i in range(same, len(word)):
                path.append(node_before(word[-1 - i], path[-1]))
            last = word
            cost, audit, out = path[-1]
            rows["ends"].append(e)
            rows["word"].append(word)
            rows["times"].append(times)
            rows["cost"].append([c - e[t] for c, t in zip(cost, out)])
            rows["audit"].append(audit)
            rows["out"].append(out)
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
            ("ends", pa.list_(pa.int64())), ("word", pa.string()), ("times", pa.int64()), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string())), ("out", pa.list_(pa.int32()))]))


def solve(words: DataFrame) -> DataFrame:
    """For each distinct (ends array<long>, word), with its number of rows: per
    grammar state the cost of its best edits, their audit and the state in which
    the word ends."""
    distinct = words.groupBy("ends", "word").agg(F.count("*").alias("times")).withColumn("tail", F.reverse("word"))
    ranged = distinct.repartitionByRange("ends", "tail").sortWithinPartitions("ends", "tail").select("ends", "word", "times")
    return ranged.mapInArrow(_solve, "ends array<long>, word string, times long, cost array<long>, audit array<string>, out array<int>")


def _solved(placed: DataFrame) -> DataFrame:
    """``placed`` with the solution of each segment. A word of more than a
    thousandth of all segments comes by broadcast (there are fewer than
    ``FREQUENT`` such words of ``SEGMENT`` symbols), so no key of the shuffled
    join is hot."""
    key = ["ends", "word"]
    found = cut_lineage(solve(placed))
    frequent = F.col("times") * FREQUENT > placed.count()
    few = F.broadcast(found.where(frequent).drop("times"))
    rest = placed.join(F.broadcast(found.where(frequent).select(key)), key, "left_anti")
    return placed.join(few, key).unionByName(rest.join(found.where(~frequent).drop("times"), key))


def _ends(c: int | tuple[int, ...]) -> Column:
    return F.array(*(F.lit(x).cast("long") for x in c))


def _behind(frame: pd.DataFrame) -> pd.DataFrame:
    """Cost vector behind each segment of one conversation, from its end."""
    frame = frame.sort_values(["part", "seg"])
    vector, rows = list(END), []
    for m in reversed(frame["between"].tolist()):
        low = min(vector)
        vector = [min(v - low, FAR) for v in vector]
        rows.append(vector)
        vector = [min(m[q * STATES + t] + vector[t] for t in range(STATES)) for q in range(STATES)]
    frame["ends"] = rows[::-1]
    return frame[["none", "conv_id", "part", "seg", "word", "ends"]]


def _through(frame: pd.DataFrame) -> pd.DataFrame:
    """The grammar state in which each segment of one conversation starts."""
    frame = frame.sort_values(["part", "seg"])
    state, cost, audit = 0, [], []
    for c, a, o in zip(frame["cost"], frame["audit"], frame["out"]):
        cost.append(c[state])
        audit.append(a[state])
        state = o[state]
    frame["spent"], frame["edits"] = cost, audit
    return frame[["none", "conv_id", "part", "seg", "spent", "edits"]]


def edits(parts: DataFrame) -> DataFrame:
    """none, conv_id, part, seg, spent, edits: the cheapest repair of every
    segment of ``segments``."""
    key = ["none", "conv_id"]
    several = parts.groupBy(F.col("none").alias("n2"), F.col("conv_id").alias("c2")).agg(F.count("*").alias("k")).where("k > 1")
    match = (parts["none"] == several["n2"]) & parts["conv_id"].eqNullSafe(several["c2"])
    single = parts.join(several, match, "left_anti").select(*key, "part", "seg", "word").withColumn("ends", _ends(END))
    many = cut_lineage(parts.join(several, match, "left_semi").select(*key, "part", "seg", "word"))
    # costs between all pairs of states: the automaton ended in each state alone
    alone = [[0 if t == q else FAR for t in range(STATES)] for q in range(STATES)]
    words = many.select("word").distinct()
    between = solve(words.select("word", F.explode(F.array(*(_ends(a) for a in alone))).alias("ends")))
    between = between.select("word", F.expr(f"array_position(ends, {0}L) - 1").alias("t"), F.expr(
        f"transform(cost, (c, q) -> c + if(out[q] = array_position(ends, {0}L) - 1, 0L, {FAR}L))").alias("cost"))
    between = between.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("t", "cost"))).alias("by_end")).select(
        "word", F.expr(f"flatten(transform(sequence(0, {STATES - 1}), q -> transform(by_end, x -> x.cost[q])))").alias("between"))
    behind = many.join(between, "word").groupBy(*key).applyInPandas(
        _behind, "none boolean, conv_id string, part long, seg long, word string, ends array<long>")
    placed = cut_lineage(single.withColumn("more", F.lit(False)).unionByName(behind.withColumn("more", F.lit(True))))
    solved = _solved(placed)
    done = solved.where("not more").select(*key, "part", "seg", F.expr("cost[0]").alias("spent"), F.expr("audit[0]").alias("edits"))
    chain = solved.where("more").groupBy(*key).applyInPandas(
        _through, "none boolean, conv_id string, part long, seg long, spent long, edits string")
    return cut_lineage(done.unionByName(chain))


def _counts(parts: DataFrame, edited: DataFrame) -> DataFrame:
    """One row per conversation with rows: counts, cost and audit."""
    both = parts.join(edited.drop("conv_id", "none"), ["part", "seg"])
    one = F.struct("part", "seg", "first_init", "last_init", "first_turn", "last_turn", "edits")
    out = both.groupBy("none", "conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")), F.sum("spent").alias("cost"),
        F.min("first_turn").alias("low"), F.max("last_turn").alias("high"), F.sort_array(F.collect_list(one)).alias("list"))
    seam = "transform(sequence(1, size(list)), i -> if(i < size(list), {}, 0))"
    bad = "if(concat(list[i - 1].last_init, get(list, i).first_init) in ('su', 'ua', 'au'), 0, 1)"
    same = "if(list[i - 1].last_turn = get(list, i).first_turn, 1, 0)"
    total = "aggregate({}, 0L, (a, b) -> a + b)"
    return out.select(
        "none", "conv_id",
        F.expr(f"coalesce(high - low + 1 - (turns - {total.format(seam.format(same))}), 0L)").alias("gaps"),
        "blank", "duplicate", "truncated",
        F.expr(f"illegal + {total.format(seam.format(bad))}").alias("illegal"),
        "cost", F.expr("array_join(transform(list, x -> x.edits), '')").alias("audit"))


def _hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every repaired conversation; each has its edits first, then
    its rows in order."""
    schema = pa.schema([("none", pa.bool_()), ("conv_id", pa.string()), ("repaired_sha256", pa.string())])
    key = digest = None
    plan, at, state, lines = [], 0, 0, 0
    out: list[tuple] = []

    def put(role: str, text: str) -> None:
        nonlocal lines
        digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
        lines += 1

    def fill() -> None:
        """The inserted rows that come next."""
        nonlocal at, state
        while at < len(plan) and plan[at] == "I":
            at, state = at + 1, FORCED[state]
            put("assistant" if state == 3 else "user", "")

    for batch in batches:
        for none, conv, edits_, role, text in zip(*(batch.column(c).to_pylist() for c in ("none", "conv_id", "edits", "role", "text"))):
            if (none, conv) != key:
                if digest:
                    fill()
                    out.append((*key, digest.hexdigest()))
                key, digest = (none, conv), hashlib.sha256()
                plan, at, state, lines = "", 0, 0, 0
            if edits_ is not None:
                plan += edits_
                continue
            fill()
            edit, at = plan[at], at + 1
            if edit == "K":
                state = NEXT[role[0]][state]
                put(role, text)
            elif edit == "R":
                state = FORCED[state]
                put("assistant" if state == 3 else "user", text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if digest:
        fill()
        out.append((*key, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def repaired_sha256(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """none, conv_id, repaired_sha256 of every conversation with rows."""
    texts = _keyed(rows).select(
        F.col("conv_id").isNull().alias("none"), F.col("conv_id").cast("string").alias("conv_id"), F.lit(None).cast("string").alias("edits"),
        F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("seg"), "turn", "role", "text", "h")
    heads = edited.select("none", "conv_id", "edits", "part", "seg", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("h", "binary"))))
    order = ["none", "conv_id", F.col("edits").isNull(), "part", "seg", F.col("turn").asc_nulls_first(), "role", "h"]
    stream = heads.unionByName(texts).repartition("none", "conv_id").sortWithinPartitions(*order)
    return stream.select("none", "conv_id", "edits", "role", "text").mapInArrow(_hash_stream, "none boolean, conv_id string, repaired_sha256 string")


def repair(rows: DataFrame, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Counts per conversation (none, conv_id as text, gaps, blank, duplicate,
    truncated, illegal, cost, audit) and the edits of its segments."""
    parts = segments(rows, size)
    edited = edits(parts)
    return _counts(parts, edited), edited


def digest(rows: DataFrame, ids: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The repair of ``rows`` with the hash of the repaired conversation, one
    row for every conv_id of ``ids``."""
    counts, edited = repair(rows, size)
    hashes = repaired_sha256(rows, edited)
    found = counts.join(hashes.select(F.col("none").alias("n2"), F.col("conv_id").alias("c2"), "repaired_sha256"),
                        (F.col("none") == F.col("n2")) & F.col("conv_id").eqNullSafe(F.col("c2"))).drop("n2", "c2").withColumnRenamed("conv_id", "c")
    ids = ids.select(ids["conv_id"].alias("conv_id")).distinct()
    joined = ids.join(found, (ids["conv_id"].isNull() == found["none"]) & ids["conv_id"].cast("string").eqNullSafe(found["c"]), "left")
    return joined.select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
