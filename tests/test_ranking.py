"""Sentence rankings against plain loops over whole small documents."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevis.operators import extractive

TEXTS = [
    "The cat sat on the mat. A dog saw the cat and the mat. Rain fell. The dog ran to the cat on the mat!",
    "One. Two. One two three four five six seven one. Two one.",
    "No repeats here at all.",
    "alpha beta gamma delta eps zeta alpha eta theta iota kappa alpha lambda\nalpha beta beta",
    "",
    "12 34. 56.",
]


def lines(text):
    cut = [s.strip(" ") for s in re.findall(r"[^.!?\n]+[.!?]*", text)]
    return [re.findall(r"[^\W\d_](?:[^\W\d_]|['-])*", s.lower()) for s in cut if s]


def luhn(rows):
    flat = [w for r in rows for w in r]
    often = {w for w in flat if flat.count(w) > 1}
    out = []
    for r in rows:
        best, cluster = 0.0, []
        for i, w in enumerate(r):
            if w in often:
                if cluster and i - cluster[-1] > 4:
                    cluster = []
                cluster.append(i)
            closing = i == len(r) - 1 or not any(x in often for x in r[i + 1:i + 5])
            if cluster and closing and len(cluster) > 1:
                best = max(best, len(cluster) ** 2 / (cluster[-1] - cluster[0] + 1))
        out.append(best)
    return out


def lsa(rows):
    vocab = sorted({w for r in rows for w in r})
    out = []
    for r in rows:
        top = max([r.count(w) for w in vocab] + [1])
        out.append(math.sqrt(sum((0.4 + 0.6 * r.count(w) / top) ** 2 for w in vocab)))
    return out


def textrank(rows):
    n = len(rows)
    if n == 0:
        return []
    w = np.zeros((n, n))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            common = sum(x == y for x in a for y in b)
            if common:
                norm = math.log(len(a)) + math.log(len(b))
                w[i, j] = common if norm == 0 else common / norm
    total = w.sum(axis=1, keepdims=True)
    w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
    r = np.full(n, 1 / n)
    for _ in range(20):
        r = ((1 - 0.85) / n + 0.85 * w).T @ r
    return list(r)


@pytest.mark.parametrize("name,plain", [("luhn", luhn), ("lsa", lsa), ("textrank", textrank)])
def test_rankings(spark, name, plain):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "id string, document string")
    got = {}
    for r in extractive.sentence_scores(df, extractive.RANKINGS[name]).collect():
        got.setdefault(int(r["id"]), {})[r["pos"]] = r["score"]
    for i, text in enumerate(TEXTS):
        want = plain(lines(text))
        assert [got.get(i, {}).get(p) for p in range(len(want))] == pytest.approx(want, abs=1e-8), text


def test_reduced_rank_with_everything_kept_is_the_closed_form(spark):
    df = spark.createDataFrame([("1", TEXTS[0])], "id string, document string")
    full = [r["score"] for r in extractive.sentence_scores(df, extractive.lsa_array).orderBy("pos").collect()]
    kept = [r["score"] for r in extractive.sentence_scores(df, extractive.lsa_reduced_array(50)).orderBy("pos").collect()]
    assert kept == pytest.approx(full, abs=1e-6)


def test_shortened_text_is_an_ordered_subset(spark):
    long = "\n".join(f"Sentence number {i} talks about topic{i % 7} and thing{i % 5}." for i in range(120))
    df = spark.createDataFrame([("1", long), ("2", "")], "id string, document string")
    every = long.split("\n")
    for made in (
        extractive.shorten_ranked(df, "luhn", {"45": 273}), extractive.shorten_ranked(df, "textrank", {"45": 273}),
        extractive.shorten_ranked(df, "lsa", {"45": 273}, pick="closest"), extractive.shorten_centroid(df, 273),
    ):
        rows = {r["id"]: r for r in made.collect()}
        kept = rows["1"]["shortened_document"].replace(". S", ".\nS").split("\n")
        places = [every.index(s) for s in kept]
        assert places == sorted(set(places)) and 0 < len(places) < 120
        assert rows["1"]["shortened_len"] == len(rows["1"]["shortened_document"].split()) + 1
        assert rows["2"]["shortened_document"] == ""


def test_unknown_method_raises(spark):
    df = spark.createDataFrame([("1", "a")], "id string, document string")
    with pytest.raises(ValueError):
        extractive.shorten_ranked(df, "bertlike", {"45": 273})


def test_rankings_do_not_shuffle(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit("A cat. The cat ran.").alias("document"))
    plan = extractive.shorten_ranked(df, "luhn", {"45": 273})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


ODD = TEXTS + [
    "'tis o'clock - 'a-b' \u00e9t\u00e9-- 3rd x2y\tz. --- \n\n  '  \n\u0130stanbul \u03a3\u03a3. a\u0301b \u6f22\u5b57\u3002\u00a0c\r\u2028d!",
    "\n \n", " . ! ", "..", "one word\n" * 40,
]


def test_words_cut_out_of_whole_texts_are_the_words_of_each_sentence(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "id int, document string")
    document = F.col("document")
    made = df.select(extractive.word_lines(document).alias("a"), extractive.word_text(extractive.sentence_text(document)).alias("b"))
    for r in made.collect():
        assert (r["a"] is None) == (r["b"] is None)
        if r["a"] is not None:
            assert r["a"] == ([line.strip(" ") for line in r["b"].split("\n")] if r["b"] else [])


def test_centroids_from_pairs_and_from_entries_pick_alike():
    rng = np.random.default_rng(5)
    for size, words in ((1, 3), (7, 4), (60, 30), (90, 400)):
        rows = [" ".join(f"w{w}" for w in rng.integers(words, size=rng.integers(0, 12))) for _ in range(size)]
        rows[0] = rows[-1]
        sparse = extractive._line_rows(rows)
        for k in {1, min(3, size), size}:
            got = []
            for steps in (extractive._by_pairs, extractive._by_entries):
                likeness, distance, moved = steps(sparse, size)
                seeds = extractive._seeds(distance, size, k, np.random.default_rng(2))
                assert len(set(seeds)) == k
                assert seeds[: k // 2 + 1] == extractive._seeds(distance, size, k // 2 + 1, np.random.default_rng(2))[:k]
                got.append(extractive._cluster_picks(np.array([likeness(p) for p in seeds]).T, moved, 10))
            assert got[0] == got[1] and len(set(got[0])) == k


def test_centroid_cut_reads_a_text_once_and_takes_null(spark):
    df = spark.createDataFrame([("1", None), ("2", ".."), ("3", "A b. C d.\nE f g.")], "id string, document string")
    made = extractive.shorten_centroid(df, 4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "S+" not in plan  # one pass for the sentences, none for tokens
    rows = {r["id"]: (r["shortened_document"], r["shortened_len"]) for r in made.collect()}
    assert rows["1"] == ("", 1) and rows["2"] == ("", 1)
    assert rows["3"][1] == len(rows["3"][0].split()) + 1


def test_reduced_rank_of_few_sentences_is_solved_at_once(spark, monkeypatch):
    def filled_in(rows, keep):
        vocab = sorted({w for r in rows for w in r})
        counts = np.array([[r.count(w) for w in vocab] for r in rows], dtype=float)
        matrix = 0.4 + 0.6 * counts / np.maximum(counts.max(axis=1, keepdims=True), 1)
        left, strength, _ = np.linalg.svd(matrix, full_matrices=False)
        return np.sqrt(((left * strength)[:, :keep] ** 2).sum(axis=1))

    rng = np.random.default_rng(3)
    long = [[f"w{w}" for w in rng.integers(50, size=rng.integers(1, 15))] for _ in range(230)]
    iterated, krylov = [], extractive._krylov
    monkeypatch.setattr(extractive, "_krylov", lambda apply, size, keep: iterated.append(size) or krylov(apply, size, keep))
    for size in (1, 2, 3, 4, 40, 190, 230):
        rows = long[:size]
        assert extractive._reduced([" ".join(r) for r in rows], 3) == pytest.approx(filled_in(rows, 3), abs=1e-7)
    assert iterated == [230]
    alike = [f"a{i}" for i in range(6)]  # five equal strengths, two of them kept: the choice is the iteration's
    assert np.isfinite(extractive._reduced(alike, 3)).all() and iterated == [230, 6]
    plan = extractive.sentence_scores(spark.createDataFrame([("1", "A b.")], "id string, document string"), extractive.lsa_reduced_array())
    assert plan._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1  # no pass that makes words
