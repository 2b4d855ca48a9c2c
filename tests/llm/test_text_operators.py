"""Operators over documents against brute force, with the awkward rows:
nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loam.llm import bpe, decontam, fmindex, ngram, quality, repeats, suffix

AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def corpus():
    """Random prose with copies, near copies, shared passages and odd rows."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdéß") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, texts = prose(60), []
    for i in range(40):
        texts.append(prose(rnd.randint(1, 160)))
    for i in range(12):
        texts.append(prose(20) + "\n" + passage + "\t " + prose(rnd.randint(5, 40)))
    base = prose(120).split(" ")
    for i in range(14):  # near copies, one edit each
        w = list(base)
        w[rnd.randrange(len(w))] = "edit%d" % i
        texts.append(" ".join(w).upper() if i == 3 else " ".join(w))
    texts += [texts[0], texts[50], texts[50]]  # exact copies
    texts += [None, "", "   \n", "one", "a b c", "x " * 300, "é" * 400, "long " + prose(4000), "<|endoftext|> a<|endoftext|>"]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    # an extra column whose name an operator uses inside
    return spark.createDataFrame([(*r, 7, "x") for r in corpus()], DOC + ", id int, _hits string").repartition(3)


def test_suffix_dedup_equals_brute_force(docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.digest(docs).collect()}
    seen = set()
    for i, t, *_ in corpus():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        assert got[i] == (len(b), sum(gone), spans, sha(kept)), i


def test_suffix_array_orders_prefixes():
    rnd = random.Random(3)
    for _ in range(150):
        s = np.array([rnd.randint(1, rnd.choice([1, 2, 4])) for _ in range(rnd.randint(1, 60))])
        for depth in (5, 1000):
            sa = suffix.suffix_array(s, depth)
            assert sorted(sa) == list(range(len(s)))
            pre = [tuple(s[i:i + depth]) for i in sa]
            assert pre == sorted(pre)


def test_cut_repeats_keeps_characters_whole(docs):
    got = {r["doc_id"]: r for r in suffix.cut_repeats(docs).collect()}
    assert len(got) == len(corpus()) and got[0]["id"] == 7
    nulls = [i for i, t, *_ in corpus() if t is None]
    assert all(got[i]["text"] is None for i in nulls)
    last = max(i for i, t, *_ in corpus() if t == corpus()[0][1])
    assert got[0]["text"] == corpus()[0][1]
    if len(corpus()[0][1].encode()) >= 100:
        assert got[last]["text"] == ""


def test_fm_index_dedup_equals_brute_force(docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in fmindex.digest(docs).collect()}
    words = {i: (t or "").encode().split() for i, t, *_ in corpus()}
    count = Counter(tuple(w[p:p + 35]) for w in words.values() for p in range(len(w) - 34))
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - 34):
            if count[tuple(w[p:p + 35])] > 1:
                gone[p:p + 35] = [True] * 35
        assert got[i] == (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))), i


def test_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (None, t + " z"), (2, "other " + t)], "doc_id long, text string")
    cut = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix.digest(df).collect())
    # the row without an id comes first; both rows of id 1 repeat it; id 2 all but its first word
    assert cut == [(0, 0), (1, len(t)), (1, len(t)), (2, len(t))]
    assert [r["n_removed"] for r in fmindex.digest(df).orderBy("doc_id").collect()] == [60, 60, 60, 60]


def test_splitting_large_gram_groups_reads_no_text_again(spark, monkeypatch):
    line = "click here to read more about our rules, terms and licences"
    texts = [" ".join(f"a{i}x{k}" if k % 20 else line for k in range(121)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)

    def texts_read(limit):
        monkeypatch.setattr(repeats, "SHARD_UNITS", limit)
        read = spark.sparkContext.accumulator(0)

        def units(raw):
            read.add(1)
            return repeats.byte_units(raw)

        found = repeats.repeated(docs, units, np.uint8, suffix.later_copies, 100, suffix.GRAM, True, "doc_id", "text", [])
        assert not any(r["marks"] for r in found.collect())
        return read.value

    assert texts_read(4_000) == texts_read(1_500_000)


@pytest.mark.parametrize("words", [False, True])
def test_large_gram_groups_never_meet_in_one_shard(spark, monkeypatch, words):
    rnd = random.Random(8)
    limit, span = (800, 35) if words else (10_000, 100)
    monkeypatch.setattr(repeats, "SHARD_UNITS", limit)
    line = " ".join(f"click{i}" for i in range(20)) if words else "click here to read more about our rules, terms and licences"
    near = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(40)) for _ in range(12)]
    rows = [(i, f"{rnd.choice(near)} {line} {rnd.choice(near)} {line} {rnd.random()}") for i in range(300)]
    rows += [rows[7], rows[7], (None, rows[9][1] + " z")]

    def guarded(seqs, alone, n):
        if sum(len(x) for x in seqs) > 2 * limit:
            raise ValueError("a shard holds more than twice its units")
        return resolver(seqs, alone, n)

    resolver = fmindex.other_copies if words else suffix.later_copies
    how = (repeats.word_units, np.uint64, guarded, span, fmindex.GRAM, False) if words else (repeats.byte_units, np.uint8, guarded, span, suffix.GRAM, True)
    found = repeats.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), *how, "doc_id", "text", [])
    got = {}
    for r in found.collect():
        n = len(bytes(r["_raw"]).split()) if words else len(r["_raw"])
        gone = repeats.cover(n, r["marks"], span)
        got.setdefault(r["_id"], set()).add(tuple([False] * n if gone is None else gone.tolist()))
    seen, want = Counter(), {}
    docs = {}
    for i, text in rows:  # a repeated row is one document where the first stays
        docs.setdefault(i, []).append(text.encode().split() if words else text.encode())
    for u in docs.values():
        for x in u if words else u[:1]:
            seen.update(tuple(x[p:p + span]) for p in range(len(x) - span + 1))
    early = set()
    for i in sorted(docs, key=lambda i: -1 if i is None else i):
        u = docs[i][0]
        gone = [False] * len(u)
        for p in range(len(u) - span + 1):
            key = tuple(u[p:p + span])
            if seen[key] > 1 if words else key in early:
                gone[p:p + span] = [True] * span
            early.add(key)
        want[i] = {tuple(gone)}
    assert got == want


def jaccard_groups(rows, size, similarity):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().translate(AZ).split()
        n = min(size, len(w))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= similarity * (len(sets[a]) + len(sets[b]) - k) and top(a) != top(b):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("size,similarity", [(4, 85), (5, 80), (2, 60)])
def test_ngram_join_equals_brute_force(docs, size, similarity):
    got = {r[0]: (r[1], r[2]) for r in ngram.report(docs, size, similarity).collect()}
    assert got == jaccard_groups(corpus(), size, similarity)


def test_keep_one_keeps_the_smallest_of_each_group(docs):
    groups = jaccard_groups(corpus(), 5, 80)
    left = ngram.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, (_, c) in groups.items() if c == i)


def test_ngram_join_keeps_every_row(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, None), (3, None), (4, "q r s t"), (4, "u v w x y"), (5, "u v w x y")]
    got = ngram.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, None), (None, 0, None), (3, 0, 3), (3, 0, 3), (4, 1, 4), (4, 2, 4), (5, 2, 4)]
    assert Counter(tuple(r) for r in got) == Counter(want)


@pytest.mark.parametrize("size,similarity", [(4, 85), (2, 60)])
def test_ngram_links_equal_brute_force(spark, docs, size, similarity):
    sets = {}
    for i, t, *_ in corpus():
        w = (t or "").encode().translate(AZ).split()
        n = min(size, len(w))
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= similarity * len(a | b)
    rep = {i: min(j for j in sets if sets[j] == s) if s else i for i, s in sets.items()}
    pairs, member = ngram.links(docs, size, similarity)
    tops = sorted(set(rep.values()))
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for a in tops for b in tops if a < b and linked(sets[a], sets[b])]
    assert {r["id"]: r["rep"] for r in member.collect()} == rep
    got = {r["doc_id"]: (r["n_shingles"], r["class_id"], r["n_links"]) for r in ngram.degrees(docs, size, similarity).collect()}
    assert got == {i: (len(s), rep[i], sum(linked(s, sets[j]) for j in sets if j != i)) for i, s in sets.items()}
    none = ngram.degrees(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string"))
    assert sorted(tuple(r) for r in none.collect()) == [(None, 0, None, 0), (None, 1, None, 0)]


def test_decontamination_equals_brute_force(spark, docs):
    texts = {i: t for i, t, *_ in corpus()}
    w = texts[45].split()
    items = [(0, " ".join(w[3:30]).upper()), (1, "a b c"), (2, None), (3, " ,. "), (4, " ".join(w[40:52])), (10, " ".join(w[3:30])), (11, texts[10][:200])]
    bench = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, key string")
    import regex

    word = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {}
    for i, t in items:
        x = cut(t)
        for j in range(len(x) - min(13, len(x)) + 1) if x else ():
            windows.setdefault(tuple(x[j:j + min(13, len(x))]), set()).add(i)
    want = {}
    for i, t in texts.items():
        x, hit, found = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(x) - n + 1):
                if tuple(x[j:j + n]) in windows:
                    found |= windows[tuple(x[j:j + n])]
                    hit.update(range(j, j + n))
        want[i] = (len(x), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), len(hit) > 0 and 20 * len(hit) >= len(x))
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.report(docs, bench).collect()}
    assert got == want and any(v[4] for v in want.values())
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if not v[4]}
    assert decontam.report(docs, bench.where("false")).where("contaminated or n_hit > 0").count() == 0


def test_bpe_equals_the_tokenizers_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    rnd = random.Random(2)
    codec = bpe._codec(bpe.default_path())
    odd = ["".join(rnd.choice("aab  \n\t'slt.,!01²éßñ中文😀\x1c\x85\xa0<|endoftext|>") for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    for t, ids in zip(odd, codec.encode_batch(odd)):
        assert ids == lib.encode(t, add_special_tokens=False).ids, t
        assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip_digest(docs).collect()}
    for i, t, *_ in corpus():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids)).encode()), sha(lib.decode(ids, skip_special_tokens=False).encode()))


def test_bpe_columns_round_trip(docs):
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text", "id")))
    assert all((r["text"] or "") == r["decoded"] and r["id"] == 7 for r in back.collect())


def test_bpe_leaves_no_words_in_the_workers(spark, docs):
    def left(batches):
        import sys

        import pyarrow as pa

        for b in batches:
            at = sys.modules.get("loam.llm.bpe")
            codec = at._codec(at.default_path()) if at and at._codec.cache_info().currsize else None
            yield pa.RecordBatch.from_arrays([pa.array([len(codec.cache) - len(codec.specials) if codec else 0])], ["n"])

    bpe.round_trip_digest(docs).collect()
    bpe.encode(docs.select("doc_id", "text")).collect()
    probes = spark.range(0, 64, 1, 64).mapInArrow(left, "n long").collect()
    assert len(probes) == 64 and max(r["n"] for r in probes) == 0


def test_bpe_looks_up_one_word_among_known_and_new_ones():
    codec = bpe.PairIndexBPE(bpe.default_path())
    texts = ["aa bb", "aa cc <|endoftext|> bb", "", "aa bb", "dd"]
    want = list(codec.encode_batch(texts))
    assert [codec.decode(i) for i in want] == texts
    assert list(codec.encode_batch(texts[::-1]))[::-1] == want  # all known
    codec._forget()
    assert [next(codec.encode_batch([t])) for t in texts] == want  # one by one
    known = sum(1 for e in next(codec._look_up(["aa new aa"])) if e is codec.cache["aa"])
    assert known == 1  # " aa" is another word


def test_quality_learns_and_keeps_out_the_held_out(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        good = rnd.random() < 0.6
        w = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(5, 60))]
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w), "score"))
        labels.append((i, int(good), 0))
    rows += [(1000, None, ""), (1001, "", ""), (1002, rows[0][1], "")]
    labels += [(5000, 1, 0), (None, 1, 0), (1, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, lab)
    flipped = lab.withColumn("quality", __import__("pyspark.sql.functions", fromlist=["x"]).expr("case when crc32(encode(cast(doc_id as string), 'UTF-8')) % 4 = 2 then 1 - quality else quality end"))
    other = quality.fit(docs, flipped)  # held-out labels change nothing
    a = {r["doc_id"]: r["score"] for r in quality.score(docs.drop("score"), model).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.score(docs.drop("score"), other).collect()}
    assert a == b and len(a) == 403 and all(0 <= s <= 1 for s in a.values()) and a[1000] == a[1001] and a[1002] == a[0]
    assert sum((a[i] >= 0.7) == bool(y) for i, y, _ in labels[:400]) >= 390
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns and kept.count() > 150
    flat = quality.score(docs.drop("score"), quality.fit(docs, lab.where("false")))
    assert {r["score"] for r in flat.collect()} == {0.5}


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    m = quality.fit_trees(x, y, trees=12, depth=3)
    for row, s in zip(x[:50], m.scores(x[:50])):
        z = m.base
        for f, c, v in zip(m.feature, m.cut, m.leaf):
            i = 0
            while i < len(f):
                i = 2 * i + (2 if row[f[i]] > c[i] else 1)
            z += v[i - len(f)]
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-12


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    bench = spark.createDataFrame([], "item_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (suffix.digest(none), fmindex.digest(none), ngram.report(none), decontam.report(none, bench), bpe.round_trip_digest(none), quality.keep_good(none, lab), ngram.keep_one(none), suffix.cut_repeats(none)):
        assert df.count() == 0
