"""Licence scan and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from loam.llm import licenses, queries, spelling

DOC = "doc_id long, text string, lang string, source string, n_chars long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licence_texts():
    rnd = random.Random(4)
    vocab = ["cc", "by", "CC", "general", "public", "License", "all", "rights", "reserved", "é", "x1", "ALL", "by "]
    texts = [rnd.choice([" ", "-", "\n", ", "]).join(rnd.choice(vocab) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += [None, "", " ", "cc by", "cc by cc by", "All rights reserved. " * 20000, "GENERAL  Public\tlicense", "ccby", "cc byé", "K cc by"]
    return texts


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
    hits = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licence_places_equal_brute_force(spark, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(licence_texts())] + [(None, "cc by", "en", "s", 0), (3, "cc by", None, None, None)]
    spark.createDataFrame([(*r, 5, "x") for r in rows], DOC + ", level int, labels string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_license_scan(spark, str(tmp_path)).collect()
    found = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got)
    assert found == Counter((r[0], *base_of(r[1])) for r in rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["score"] == 0) == (r["labels"] == "")
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    assert licenses.notices(spark.createDataFrame([], DOC)).collect() == []


@pytest.mark.parametrize("line, labels, level", [
    ("MIT", "mit", 1),
    ("Apache-2.0 OR MIT", "apache mit", 1),
    ("GPL-3.0-or-later", "gpl", 3),
    ("GPL-2.0-only WITH Classpath-exception-2.0", "gpl", 2),
    ("MIT AND GPL-2.0-only WITH Classpath-exception-2.0 OR proprietary", "gpl mit", 2),
    ("(MIT AND GPL-3.0+) OR BSD-3-Clause", "bsd", 1),
    ("MIT AND (GPL-3.0+ OR BSD-3-Clause)", "bsd mit", 1),
    ("GPL-2.0 AND MIT OR MPL-2.0", "mpl", 2),
    ("the Apache License, Version 2.0.", "apache", 1),
    ("CC BY-NC 4.0.", "cc-by-nc", 4),
    ("MIT or", "mit", 1),
    ("((MIT))", "mit", 1),
    ("(MIT OR", None, 0),
    ("MIT OR (GPL-3.0", "mit", 1),
    ("see below", None, 0),
    (")", None, 0),
    ("", None, 0),
])
def test_licence_expressions(line, labels, level):
    got = licenses.evaluate(line.encode())
    assert got == (None if labels is None else (frozenset(labels.split()), level))


def test_random_licence_expressions_equal_recursive_evaluation():
    """Full parentheses written out by a recursive generator, dropped where binding gives them."""
    rnd = random.Random(9)
    leaf = [("MIT", "mit", 1), ("MPL-2.0", "mpl", 2), ("GPL-3.0-only", "gpl", 3), ("CC-BY-NC-4.0", "cc-by-nc", 4), ("ISC", "isc", 1)]

    def make(depth):
        kind = rnd.choice(["leaf", "and", "or"]) if depth else "leaf"
        if kind == "leaf":
            text, label, level = rnd.choice(leaf)
            if rnd.random() < 0.3:
                return f"{text} WITH GCC-exception-3.1", {label}, 2 if level == 3 else level, 3
            return text, {label}, level, 3
        a, b = make(depth - 1), make(depth - 1)
        bind = 2 if kind == "and" else 1
        text = f" {kind.upper()} ".join(f"({x[0]})" if x[3] < bind or (i and x[3] == bind) or rnd.random() < 0.2 else x[0] for i, x in enumerate((a, b)))
        if kind == "and":
            return text, a[1] | b[1], max(a[2], b[2]), bind
        if a[2] == b[2]:
            return text, a[1] | b[1], a[2], bind
        return text, *min((a, b), key=lambda x: x[2])[1:3], bind

    for _ in range(500):
        text, labels, level, _ = make(4)
        assert licenses.evaluate(text.encode()) == (frozenset(labels), level), text


def test_tags_read_the_text_itself():
    text = "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND ISC\nmore words GPL-3.0 licensed under Mozilla things, released under AGPL-3.0!".encode()
    *_, base, labels, level = licenses.scan(text)
    assert (base, labels, level) == ([], ["agpl", "isc", "mit"], 3)


def spelling_rows():
    rnd = random.Random(2)
    stems = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(5, 9))) for _ in range(60)]
    words = list(stems)
    for s in stems:
        for _ in range(6):
            k = rnd.randrange(len(s))
            words.append(rnd.choice([s[:k] + s[k + 1:], s[:k] + rnd.choice("abcÉ") + s[k:], s[:k] + rnd.choice("ab") + s[k + 1:]]))
    words += ["a" * n for n in range(5, 12)] + ["q" * 3000, "q" * 3001, "q" * 1500 + "r" + "q" * 1499]
    rows = []
    for i in range(150):
        pick = [words[min(int(rnd.expovariate(0.02)), len(words) - 1)] for _ in range(rnd.randint(0, 120))]
        rows.append((i, rnd.choice([" ", ", ", "\n", "1"]).join(w.upper() if rnd.random() < 0.1 else w for w in pick)))
    rows += [(500 + i, " ".join(words[-12:])) for i in range(6)] + [(7, rows[7][1])] * 3
    rows += [(700 + i, " ".join(["mnopqr"] * 150 + ["mnopqs"] * 28 + ["mnoxqs"] * 5)) for i in range(2)]  # a chain of three
    return rows + [(600, None), (601, ""), (602, "12 34"), (None, "aaaaaaa bbbbbbb")]


def variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += len(run) >= 6
    n = {w: c for w, c in count.items() if c >= 5}
    gap, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gap[w[:i], w[i + 1:]].add(w)
    for w in n:
        for i in range(len(w)):
            near[w] |= gap[w[:i], w[i + 1:]] - {w}
            less = w[:i] + w[i + 1:]
            if less in n:
                near[w].add(less)
                near[less].add(w)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


@pytest.mark.parametrize("shuffle", [3, 17])
def test_variants_equal_brute_force(spark, tmp_path, shuffle):
    rows = spelling_rows()
    spark.createDataFrame([(*r, "w", 3) for r in rows], "doc_id long, text string, word string, n int").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    conf = {"spark.sql.shuffle.partitions": str(shuffle), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = {r["word"]: tuple(r)[1:] for r in queries.op13_spelling_variants(spark, str(tmp_path)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = variants(rows)
    assert got == want and sum(1 for v in want.values() if v[0]) > 10
    assert any(v[1] not in (k, v[0]) for k, v in want.items())


def test_variants_of_empty_tables(spark):
    assert spelling.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.report(spark.createDataFrame([(1, "lonely " * 5)], "doc_id long, text string")).collect()[0]["n_near"] == 0
