"""Spelling variants: exact one-edit neighbours by trie-node pairs.

The vocabulary is sorted twice over the cluster, by word and by reversed word.
A task walks its sorted words with one open path and numbers every trie node
that it meets; a path that runs on from one sorted stretch into the next keeps
the number of the earlier stretch (one first and one last path per stretch go
to the driver). A word of L letters then has the nodes of its L + 1 prefixes
and of its L + 1 suffixes, and gives integer pairs (prefix node, suffix node):

* *gap* i skips letter i: (prefix of i letters, suffix after letter i);
* *split* i skips nothing: (prefix of i letters, the rest).

Two words with the same gap pair differ by one replaced letter; a split pair of
one equals a gap pair of the other exactly if the other has one letter more.
No candidate is wrong, so nothing is verified. A pair of nodes belongs to at
most one split word and to at most one word per letter of the alphabet, so the
pairs are grouped and every member takes count and best of the others: work is
linear in the pairs, and neighbours are never listed two by two. Of equal
letters in a row only the first counts as inserted, so two words meet once.

Defined cases: a null text has no words, a null doc_id counts as an empty one;
empty texts and empty tables give no rows; repeated rows count again; words of
any length take work and memory in proportion to their length; equal counts
are settled by code points; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import cut_lineage

_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed by the task: what stands between runs after lower-casing A-Z.
SEPARATOR = "[^a-zÀ-ÿ]+"
MIN_CHARS = 6
MIN_COUNT = 5
#: A form has at least this many times the occurrences of its variant.
RATIO = 5
#: One in so many runs loses a letter (set by the task).
LOSS = 199
#: Forms grow by RATIO at each step, so a chain has fewer than 32 of them.
DOUBLINGS = 5


def observed(docs: DataFrame, loss: int = LOSS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Column word: every run of letters of at least ``min_chars`` letters, after
    the loss of a letter that the checksum of (doc_id, run) asks for."""
    low = F.translate(F.coalesce("text", F.lit("")), _UP, _UP.lower())
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("d"), F.explode(F.split(low, SEPARATOR)).alias("run"))
    runs = runs.where(F.char_length("run") >= min_chars)
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, cast(h % char_length(run) as int))"), F.substring("run", at + 2, F.char_length("run")))
    word = runs.select(F.when(F.col("h") % loss == 0, cut).otherwise(F.col("run")).alias("word"))
    return word.where(F.char_length("word") >= min_chars)


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of every word with at least ``min_count`` rows."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the trie nodes of sorted stretches: columns part, wid, key in;
    stretch, wid, key, nodes (L + 1 numbers), fresh (letter differs from the
    one before) out. Numbers are unique over all tasks."""
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    count = stretch = -1
    part, last, path = None, "", []
    for batch in batches:
        out = {"stretch": [], "wid": [], "key": [], "nodes": [], "fresh": []}
        for p, wid, key in zip(*(batch.column(c).to_pylist() for c in ("part", "wid", "key"))):
            if p != part or key < last:
                stretch, part = stretch + 1, p
                count += 1
                path = [base + count]
                same = 0
            else:
                same = 0
                for a, b in zip(last, key):
                    if a != b:
                        break
                    same += 1
            del path[same + 1:]
            new = len(key) - same
            path.extend(range(base + count + 1, base + count + 1 + new))
            count += new
            last = key
            out["stretch"].append(base + stretch)
            out["wid"].append(wid)
            out["key"].append(key)
            out["nodes"].append(list(path))
            out["fresh"].append([i == 0 or key[i] != key[i - 1] for i in range(len(key))])
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("stretch", pa.int64()), ("wid", pa.int64()), ("key", pa.string()), ("nodes", pa.list_(pa.int64())), ("fresh", pa.list_(pa.bool_()))]))


def _aliases(walked: DataFrame) -> dict[int, int]:
    """Number of the earlier stretch for each node that a stretch shares with
    the one before it. Its size is bounded by stretches times word length."""
    order = F.col("key")
    ends = walked.groupBy("stretch").agg(
        F.min("key").alias("first"), F.max("key").alias("last"), F.min_by("nodes", order).alias("first_path"), F.max_by("nodes", order).alias("last_path"))
    known: dict[int, int] = {}
    before, before_path = None, []
    for r in sorted(ends.collect(), key=lambda r: r["first"]):
        if before is not None:
            same = 0
            for a, b in zip(before, r["first"]):
                if a != b:
                    break
                same += 1
            for mine, theirs in zip(r["first_path"][:same + 1], before_path):
                known[mine] = known.get(theirs, theirs)
        before, before_path = r["last"], r["last_path"]
    return known


def _nodes(vocab: DataFrame, key: Column) -> DataFrame:
    """wid, nodes, fresh of every word: its trie path from the root, for the
    trie over ``key``."""
    ordered = vocab.select("wid", key.alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    table = cut_lineage(ordered.withColumn("part", F.spark_partition_id()))
    # a table split between tasks gives further stretches, which is as good
    walked = cut_lineage(table.select("part", "wid", "key").mapInArrow(
        _walk, "stretch long, wid long, key string, nodes array<long>, fresh array<boolean>"))
    known = _aliases(walked)
    mine = sorted(known)
    theirs = [known[m] for m in mine]
    if not mine:
        return walked.select("wid", "nodes", "fresh")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the head of a path can be shared with an earlier stretch."""
        for batch in batches:
            rows = batch.column(1).to_pylist()
            for path in rows:
                for i, node in enumerate(path):
                    at = bisect_right(mine, node) - 1
                    if at < 0 or mine[at] != node:
                        break
                    path[i] = theirs[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64())), batch.column(2)], names=["wid", "nodes", "fresh"])

    return walked.select("wid", "nodes", "fresh").mapInArrow(settle, "wid long, nodes array<long>, fresh array<boolean>")


def neighbours(vocab: DataFrame) -> DataFrame:
    """wid, n_near, best (wid of the near word of largest n, smallest wid on
    ties), best_n for every row of vocab (wid, word, n) that has a near word."""
    ahead = _nodes(vocab, F.col("word")).select("wid", F.col("nodes").alias("p"), "fresh")
    back = _nodes(vocab, F.reverse("word")).select("wid", F.col("nodes").alias("s"))
    both = vocab.select("wid", "n").join(ahead, "wid").join(back, "wid").withColumn("last", F.expr("size(p) - 1"))
    pairs = both.select("wid", "n", F.explode(F.expr(
        """concat(transform(sequence(0, last), i -> named_struct('p', p[i], 's', s[last - i], 'kind', 0)),
                  transform(sequence(0, last - 1), i -> named_struct('p', p[i], 's', s[last - i - 1], 'kind', if(fresh[i], 1, 2))))""")).alias("k"))
    # kind 0: split; 1: gap at the first of equal letters in a row; 2: another gap
    met = pairs.groupBy("k.p", "k.s").agg(F.collect_list(F.struct(F.col("k.kind").alias("kind"), (-F.col("n")).alias("m"), "wid")).alias("all")).where("size(all) > 1")
    met = met.select(
        F.expr("get(filter(all, x -> x.kind = 0), 0)").alias("whole"),
        F.expr("array_sort(transform(filter(all, x -> x.kind > 0), x -> named_struct('m', x.m, 'wid', x.wid, 'kind', x.kind)))").alias("gap"))
    met = met.withColumn("longer", F.expr("filter(gap, x -> x.kind = 1)"))
    # each member of a gap has the other members and, at kind 1, the shorter word
    shares = met.select(F.explode(F.expr(
        """concat(
             transform(gap, x -> named_struct(
               'wid', x.wid,
               'near', size(gap) - 1 + if(x.kind = 1 and whole is not null, 1, 0),
               'top', array_min(filter(array(
                   if(size(gap) > 1, if(get(gap, 0).wid = x.wid, named_struct('m', get(gap, 1).m, 'wid', get(gap, 1).wid), named_struct('m', get(gap, 0).m, 'wid', get(gap, 0).wid)), null),
                   if(x.kind = 1 and whole is not null, named_struct('m', whole.m, 'wid', whole.wid), null)), y -> y is not null)))),
             if(whole is null, array(), array(named_struct(
               'wid', whole.wid,
               'near', size(longer),
               'top', if(size(longer) > 0, named_struct('m', get(longer, 0).m, 'wid', get(longer, 0).wid), null)))))""")).alias("x")).where("x.near > 0")
    return shares.groupBy("x.wid").agg(F.sum("x.near").alias("n_near"), F.min("x.top").alias("top")).select(
        "wid", "n_near", F.col("top.wid").alias("best"), (-F.col("top.m")).alias("best_n"))


def _ends(links: DataFrame) -> DataFrame:
    """wid, root: where each chain of links (wid, form) ends, by doubling."""
    hops = links.select("wid", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        onward = hops.select(F.col("wid").alias("root"), F.col("root").alias("onward"))
        hops = cut_lineage(hops.join(onward, "root", "left").select("wid", F.coalesce("onward", "root").alias("root")))
    return hops


def group(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary (word, n)."""
    vocab = cut_lineage(vocab.select("word", F.col("n").cast("long").alias("n")))
    # numbers in code-point order: ranges are numbered in order, and so are the rows of one
    vocab = cut_lineage(vocab.repartitionByRange("word").sortWithinPartitions("word").withColumn("wid", F.monotonically_increasing_id()))
    near = cut_lineage(neighbours(vocab))
    named = vocab.join(near, "wid", "left").withColumn("form", F.expr(f"if(best_n >= {ratio} * n, best, null)"))
    named = cut_lineage(named.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", F.expr("if(form is null, null, best_n)").alias("form_n")))
    links = named.where("form is not null").select("wid", "form")
    word = vocab.select(F.col("wid").alias("id"), F.col("word").alias("w"))
    ends = _ends(links)
    texts = links.join(ends, "wid")
    texts = texts.join(word.select(F.col("id").alias("form"), F.col("w").alias("form_word")), "form")
    texts = texts.join(word.select(F.col("id").alias("root"), F.col("w").alias("root_word")), "root").select("wid", "form_word", "root_word")
    return named.join(texts, "wid", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """The groups of the words of ``docs`` after the loss of letters."""
    return group(vocabulary(observed(docs)))
