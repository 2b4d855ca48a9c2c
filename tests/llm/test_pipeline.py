"""The whole corpus pipeline against a brute-force version of its stages."""

import random
import tempfile

import numpy as np
import pytest
import regex
from test_text_operators import corpus, jaccard_groups, sha

import corpus_pipeline
from loam.llm import bpe, quality

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def folder(spark):
    rnd = random.Random(9)
    rows = corpus()
    n = len(rows)
    labels = [(i, 1) for i in range(n)]
    for i in range(60):  # documents that the labels call bad
        rows.append((n + i, " ".join(rnd.choice(["BUY!!", "$$$", "NOW%%%", "###"]) + str(rnd.randint(0, 999)) for _ in range(rnd.randint(10, 80))), "en", "s", 0))
        labels.append((n + i, 0))
    bench = [(0, rows[45][1]), (1, "never seen " * 9)]
    d = tempfile.mkdtemp(prefix="loam-pipeline-")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, labels, bench


def brute(rows, labels, bench):
    import zlib

    import tokenizers

    docs = {i: t for i, t, *_ in rows}
    y = dict(labels)
    taught = sorted(i for i in docs if i in y and zlib.crc32(str(i).encode()) % 4 != 2)
    model = quality.fit_trees(quality.matrix([docs[i] for i in taught]), np.array([y[i] for i in taught], dtype=float))
    score = dict(zip(docs, model.scores(quality.matrix(list(docs.values())))))
    docs = {i: t for i, t in docs.items() if score[i] >= 0.7}
    groups = jaccard_groups(list(docs.items()), 5, 80)
    docs = {i: t for i, t in docs.items() if groups[i][1] == i}
    seen, cut = set(), {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w in seen:
                gone[p:p + 100] = [True] * 100
            seen.add(w)
        at, out = 0, ""
        for ch in docs[i] or "":
            size = len(ch.encode())
            if not all(gone[at:at + size]):
                out += ch
            at += size
        cut[i] = out
    low = {i: i + 32 for i in range(65, 91)}
    windows = set()
    for _, t in bench:
        x = WORD.findall(t.translate(low))
        windows |= {tuple(x[j:j + 13]) for j in range(len(x) - 12)}
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = {}
    for i, t in cut.items():
        x, hit = WORD.findall(t.translate(low)), set()
        for j in range(len(x) - 12):
            if tuple(x[j:j + 13]) in windows:
                hit.update(range(j, j + 13))
        if not (hit and 20 * len(hit) >= len(x)):
            ids = lib.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))
    return want


def test_pipeline_equals_brute_force(spark, folder):
    d, rows, labels, bench = folder
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, d).collect()}
    want = brute(rows, labels, bench)
    assert got == want
    assert 45 not in got and len(got) < len(rows) - 60


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.dtypes == docs.dtypes
