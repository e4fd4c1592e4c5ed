"""Scores: golden pairs, brute-force counterparts, identities."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevis.operators import embedding, mining, quality, rouge, runlog

PAIRS = [
    ("0", "my name is not fabby", "my name is beau"),
    ("1", "i don't love you", "i love you"),
    ("2", "my name is fabby", "my name is beau"),
    ("3", "", "words"),
    ("4", None, "words"),
]


def pairs(spark, rows=PAIRS):
    return spark.createDataFrame(rows, "id string, reference string, hypothesis string")


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_golden_pairs(spark):
    got = rouge.rouge_n(pairs(spark))
    one, two = by_id(got, "rouge1"), by_id(got, "rouge2")
    assert one == pytest.approx({"0": 66.6667, "1": 75.0, "2": 75.0, "3": 0.0}, abs=1e-3)
    assert two["0"] == pytest.approx(57.1429, abs=1e-3)
    assert by_id(rouge.rouge_l(pairs(spark)), "rougeL")["0"] == pytest.approx(66.6667, abs=1e-3)


def sample(n, seed, newline=False):
    rng = random.Random(seed)
    def text():
        ws = [rng.choice("ab c d e f g ga ab".split()) for _ in range(rng.randint(0, 90))]
        return (" " if not newline else rng.choice([" ", "\n"])).join(ws)
    return [(str(i), text(), text()) for i in range(n)]


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


def test_lcs_against_the_table():
    for _, a, b in sample(200, 5):
        assert rouge._common_length(a.split(), b.split()) == lcs_table(a.split(), b.split())[-1][-1]


def test_hit_positions_follow_the_table():
    for _, a, b in sample(100, 6):
        a, b = a.split(), b.split()
        t, i, j, want = lcs_table(a, b), len(a), len(b), []
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                want.append(i)
            elif t[i][j - 1] > t[i - 1][j]:
                j -= 1
            else:
                i -= 1
        assert rouge._hit_positions(a, b) == want


def test_identities(spark):
    rows = pairs(spark, sample(60, 7))
    same = rows.where(F.length("reference") > 3).withColumn("hypothesis", F.col("reference"))
    assert all(v == pytest.approx(100) for v in by_id(rouge.rouge_n(same, (1,)), "rouge1").values())
    one, ell, total = (by_id(f(rows), c) for f, c in (
        (lambda d: rouge.rouge_n(d, (1,)), "rouge1"), (rouge.rouge_l, "rougeL"), (rouge.rouge_lsum, "rougeLsum")))
    for key in one:
        assert ell[key] <= one[key] + 1e-9
        assert total[key] == pytest.approx(ell[key])


def test_rouge_n_against_counters(spark):
    rows = sample(60, 8, newline=True)
    got = rouge.rouge_n(pairs(spark, rows)).collect()
    for r in got:
        _, a, b = rows[int(r["id"])]
        for n in (1, 2):
            grams = lambda t: Counter(zip(*[t.split()[k:] for k in range(n)]))
            x, y = grams(a), grams(b)
            hits, size = sum((x & y).values()), sum(x.values()) + sum(y.values())
            assert r[f"rouge{n}"] == pytest.approx(200 * hits / size if hits else 0)


def test_stemmed_scores(spark):
    rows = [("0", "the cats were running happily", "a cat runs happy")]
    assert by_id(rouge.rouge_n(pairs(spark, rows), (1,), stem=True), "rouge1")["0"] > by_id(
        rouge.rouge_n(pairs(spark, rows), (1,)), "rouge1")["0"]


def test_bootstrap_brackets_the_mean(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("id"), (F.col("id") % 50).cast("double").alias("v"))
    row = rouge.rouge_bootstrap(df, "v", resamples=200).first()
    assert row["low"] < row["mid"] < row["high"]
    assert row["mid"] == pytest.approx(24.5, abs=0.5)


def test_embedding_score(spark):
    rng = np.random.default_rng(1)
    ref, hyp = rng.normal(size=(5, 8)), rng.normal(size=(7, 8))
    bag = lambda m: [(i + 1, [float(x) for x in v]) for i, v in enumerate(m)]
    entry = "array<struct<n:long,vector:array<double>>>"
    df = spark.createDataFrame([("1", bag(ref), bag(hyp))], f"id string, ref {entry}, hyp {entry}")
    row = embedding.embedding_score(df).first()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(ref) @ unit(hyp).T
    assert row["emb_r"] == pytest.approx(np.average(sims.max(1), weights=range(1, 6)))
    assert row["emb_p"] == pytest.approx(np.average(sims.max(0), weights=range(1, 8)))


def test_quantiles_against_numpy(spark):
    rng = random.Random(3)
    values = [round(rng.choice([5.0, rng.random() * 100]), 2) for _ in range(501)]  # half of them tie
    df = spark.createDataFrame([(str(i), v, "ab"[i % 2]) for i, v in enumerate(values)], "id string, v double, g string")
    row = quality.score_quantiles(df, "v").first()
    want = np.quantile(values, [0, 0.1, 0.5, 0.9, 1])
    assert [row[c] for c in ("low", "p10", "p50", "p90", "high")] == pytest.approx(list(want))
    grouped = {r["g"]: r for r in quality.score_quantiles(df, "v", by=("g",)).collect()}
    assert grouped["b"]["p90"] == pytest.approx(np.quantile(values[1::2], 0.9))
    tails = quality.quantile_tails(df, "v").groupBy("tail").count().collect()
    assert {t["tail"]: t["count"] for t in tails} == {
        "bad": sum(v <= want[1] for v in values), "good": sum(v >= want[3] for v in values)}


def test_tfidf_rows_have_length_one(spark):
    df = spark.createDataFrame(
        [("0", "my name is beau"), ("1", "my name is fabby"), ("2", "i love deep learning")], "id string, document string")
    weights = mining.tfidf(mining.term_counts(df), mining.document_count(df))
    norms = weights.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert len(norms) == 3 and all(r["n"] == pytest.approx(1) for r in norms)
    w = {(r["id"], r["term"]): r["weight"] for r in weights.collect()}
    assert w["0", "name"] < w["0", "beau"] and w["2", "deep"] == pytest.approx(3 ** -0.5)


def test_counts(spark):
    texts = ["This is the first document.", "This document is the second document.", "And this is the third one.",
             "Is this the first document?"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, document string")
    got = {(r["id"], r["term"]): r["tf"] for r in mining.term_counts(df, stop=False).collect()}
    assert [got.get((str(i), "document"), 0) for i in range(4)] == [1, 2, 0, 1]
    assert [got.get((str(i), "first"), 0) for i in range(4)] == [1, 0, 0, 1]


def test_epochs(spark):
    rows = [("a", e, v) for e, v in enumerate([3.0, 2.0, 2.0, 1.5, 9.0], 1)]
    losses = spark.createDataFrame(rows, "run string, epoch int, loss double")
    assert runlog.best_epoch(losses).first()["best_epoch"] == 4
    assert [r["epoch"] for r in runlog.improvements(losses).orderBy("epoch").collect()] == [1, 2, 4]
    assert runlog.strategy_scores(losses.withColumnRenamed("loss", "score"), "best").first()["score"] == 9.0
