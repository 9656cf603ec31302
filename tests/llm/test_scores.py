"""Quality classifier and LM scoring."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import cotraining, ctw
from tests.llm.fixtures import frame, prose, row

SF = "/root/testdata/sf0.01"


def test_quality_on_labels_not_seen(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = cotraining.scored(docs, labels, labelled=250).join(labels, "doc_id")
    seen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(250).select("doc_id")
    rest = out.join(seen, "doc_id", "left_anti").groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {(r.quality, r.toxic): r.kept for r in rest}
    assert kept[1, 0] > 0.95 and kept[0, 0] < 0.1


def test_toxic_documents_not_seen_are_rejected(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    some = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0)
    rest = cotraining.scored(docs, some).join(labels.join(some, "doc_id", "left_anti"), "doc_id")
    kept = {(r.quality, r.toxic): (r.kept, r.n) for r in rest.groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert kept[1, 0][0] > 0.98 and kept[0, 0][0] < 0.06 and kept[0, 1][0] < 0.06 and kept[1, 1][0] < 0.2


def test_keep_good_agrees_with_scores_and_keeps_columns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in cotraining.scored(docs, labels).where("keep").select("doc_id").collect()}
    got = cotraining.keep_good(docs, labels)
    assert got.columns == docs.columns and {r.doc_id for r in got.select("doc_id").collect()} == want


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


def test_quality_edge_cases(spark):
    docs = frame(spark)
    labels = labels_of(spark, [(1, 1, 0, "x"), (1, 1, 0, "x"), (2, None, None, None), (None, 1, 0, None), (7, 1, None, None)])
    out = cotraining.scored(docs, labels)
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    assert len(got[9]) == 2 and got[9][0] == got[9][1] and None not in got
    assert all(not got[i][0].keep and got[i][0].score == 0 for i in (4, 5, 6, 11))
    assert got[1][0].score == 1  # labels of one kind: the share of good ones
    kept = cotraining.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1
    assert cotraining.scored(docs.limit(0), labels.limit(0)).count() == 0
    assert cotraining.scored(docs.select("doc_id", "text"), labels.limit(0)).where("keep").count() == 10


def two_views(n=1200):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, n)
    shapes = rng.normal(size=(n, 10)) + y[:, None] * np.array([2.0] + [0] * 9)
    shapes[:, -1] = 1
    word_row = np.arange(n)
    word = np.where(rng.random(n) < 0.9, y, rng.integers(0, 2, n)).astype(np.uint64)
    meta = np.stack([1 + y, np.zeros(n, int), np.zeros(n, int)], axis=1)
    return y, shapes, word_row, word, meta


def test_two_views_exchange_labels():
    y, shapes, row, word, meta = two_views()
    first, rest = np.arange(200), np.arange(200, len(y))
    sides = [(shapes[i], row[np.isin(row, i)] - i[0], word[i], meta[i]) for i in (first, rest)]

    def unlabelled(text):
        rows = text.rows(*sides[1][:3]), cotraining.MetaView.rows(sides[1][3])
        return lambda before, now: cotraining.slopes(rows, before, now, 0.9)

    aside = first % 4 == 0
    model = cotraining.cotrained(*sides[0], y[first], aside, unlabelled)
    t, m, both = model.scores(*sides[1])
    assert ((both > 0.5) == y[rest]).mean() > 0.97 and ((t > 0.5) == y[rest]).mean() > 0.85
    assert len(model.exchanged) == 3 and model.exchanged[0][1] > 100 and model.exchanged[-1][0] > 500


def test_a_fit_is_the_logistic_regression():
    rng = np.random.default_rng(2)
    x = (rng.random((400, 12)) < 0.3).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ rng.normal(size=12))))).astype(float)
    rows = cotraining.Rows(*np.nonzero(x), 400, 12)
    assert np.allclose(rows.fitted(y, 1.0), cotraining.logistic(x, y, 1.0), atol=1e-4)


def test_the_exchange_covers_every_unlabelled_document(spark):
    y, shapes, row, word, meta = two_views(900)
    words = ["river", "stone"]
    rows = [(i, f"{words[int(w)]} {words[int(w)]} {prose(i, 30)}", "en", f"s{m[0]}", 0) for i, (w, m) in enumerate(zip(word, meta))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(y[i]), 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    model = cotraining.train(docs, labels, confident=0.8)
    assert model.exchanged[0][0] == 700  # the source tells all, so that it labels every other document
    assert cotraining.train(docs.union(docs), labels, confident=0.8).exchanged[0][0] == 1400


def brute_bits(corpus, text, depth):
    """Code length by whole context trees, bit by bit."""

    def bits(t):
        b = t.encode()
        for i in range(len(b)):
            c = (bytes(depth) + b[:i])[-depth:]
            for k in range(8):
                yield c, (1 << k) | (b[i] >> (8 - k)), (b[i] >> (7 - k)) & 1

    count, kids = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in corpus:
        for c, node, bit in bits(t or ""):
            for d in range(depth + 1):
                own = c[depth - d :]
                count[own, node][bit] += 1
                if d:
                    kids[own[1:], node].add(own)

    def pe(a, b):
        p = 1.0
        for i in range(a):
            p *= (i + 0.5) / (i + 1)
        for i in range(b):
            p *= (i + 0.5) / (a + i + 1)
        return p

    def pw(c, node, extra, bit):
        a, b = count.get((c, node), (0, 0))
        on = extra is not None and extra[depth - len(c) :] == c
        if on:
            a, b = (a + 1, b) if bit == 0 else (a, b + 1)
        if len(c) == depth:
            return pe(a, b)
        below = set(kids.get((c, node), ()))
        if on:
            below.add(extra[depth - len(c) - 1 :])
        p = 1.0
        for k in below:
            p *= pw(k, node, extra, bit)
        return 0.5 * pe(a, b) + 0.5 * p

    return sum(-math.log2(pw(b"", node, c, bit) / pw(b"", node, None, 0)) for c, node, bit in bits(text))


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_code_lengths_against_brute_force(spark, depth):
    texts = ["abracadabra", "abrakadabra é", "", None, "abra", "cad"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in ctw.code_lengths(df, depth).collect()}
    for i, t in enumerate(texts):
        assert got[i].bits == pytest.approx(brute_bits(texts, t, depth) if t else 0.0, rel=1e-8)
        assert (got[i].bits_per_byte is None) == (not t)


def test_default_contexts_reach_over_five_bytes(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, "".join(f"{d}abcd{d}" for d in rng.integers(0, 2, 200))) for i in range(10)], "doc_id bigint, text string")
    deep, flat = (ctw.code_lengths(df, *depth).agg(F.sum("bits")).first()[0] for depth in ((), (3,)))
    assert deep < 0.7 * flat


def test_shards_give_the_same_sums(spark):
    df = frame(spark, [row(i, prose(i, 30)) for i in (1, 2, 3)] + [row(3, prose(3, 30)), row(4, None)])
    whole, parts = (sorted((r.doc_id, r.n_bytes, round(r.bits, 6)) for r in ctw.code_lengths(df, shard=s).collect()) for s in (1 << 25, 40))
    assert whole == parts and len(whole) == 5


def test_lm_edge_cases(spark):
    out = ctw.code_lengths(frame(spark)).collect()
    assert len(out) == 14 and sum(r.doc_id == 9 for r in out) == 2
    assert all(r.bits_per_byte is None for r in out if r.doc_id in (4, 5))
    assert ctw.code_lengths(frame(spark, [])).count() == 0
