"""Blocks of rows that are sent their own words: rows in, rows out, and the same results as row by row."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevis.functions import blocks
from brevis.operators import embedding, mining, tokens
from brevis.plans import grid

WORDS = [f"w{i}" for i in range(40)]


def token_rows(spark, n=60, seed=4):
    rng = np.random.default_rng(seed)
    draw = lambda: [WORDS[i] for i in rng.integers(0, 40, rng.integers(0, 9))]
    rows = [(None if i % 7 == 0 else str(i // 2), draw(), [draw() for _ in range(i % 4)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, ref array<string>, hyps array<array<string>>")


@pytest.mark.parametrize("limit", (1, 50, 1_000_000))
def test_scores_of_blocks_are_those_of_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(blocks, "BLOCK", limit)
    rng = np.random.default_rng(5)
    vector = {w: rng.normal(size=4) for w in WORDS[:35]}  # five words are unknown
    lookup = spark.createDataFrame([(w, v.tolist()) for w, v in vector.items()], "word string, vector array<double>")
    rows, df = token_rows(spark)
    packed = embedding.packed_texts(df, "ref", "hyps")
    got = embedding.scores_of_blocks(packed, lookup, 0.1).collect()

    def score(ref, hyp):
        kinds = [np.unique([w for w in t if w in vector], return_counts=True) for t in (ref, hyp)]
        made = embedding._match(*[x for words, n in kinds for x in (n, [vector[w] for w in words])])
        return [round((x - 0.1) / 0.9, 9) for x in made]

    want = sorted((i or "", json.dumps([score(ref, h) for h in hyps])) for i, ref, hyps in rows)
    assert sorted((r["id"] or "", json.dumps([[round(x, 9) for x in s] for s in r["scores"]])) for r in got) == want
    counts = {r["word"]: (r["held"], r["docs"]) for r in blocks.word_counts(packed).collect()}
    texts = [[w for t in (ref, *hyps) for w in t] for _, ref, hyps in rows]
    assert counts == {w: (sum(t.count(w) for t in texts), sum(w in t for t in texts)) for w in WORDS if any(w in t for t in texts)}


def test_null_texts_have_empty_bags(spark):
    df = spark.createDataFrame([("1", None, [None, ["w1"]])], "id string, ref array<string>, hyps array<array<string>>")
    lookup = spark.createDataFrame([("w1", [1.0])], "word string, vector array<double>")
    row = embedding.scores_of_blocks(embedding.packed_texts(df, "ref", "hyps"), lookup).first()
    assert [tuple(s) for s in row["scores"]] == [(0.0, 0.0, 0.0)] * 2


def test_equal_summaries_are_scored_once(spark):
    """Thirteen variants of a document, of which only the tails open with other words."""
    text = " ".join(f"t{i}" for i in range(600))
    pairs = spark.createDataFrame([("1", text, "s"), ("2", None, "s")], "id string, document string, summary string")
    long, null = sorted(grid.token_leads(pairs).collect(), key=lambda r: r["id"])
    assert len(long["leads"]) == 4 and len(long["at"]) == 13 and null["leads"] == [""]
    place = {(v["method"], v["quantity"]): v["place"] for v in long["at"]}
    assert {place[m, q] for m, q in place if m != "tail"} == {0}
    assert long["leads"][place["tail", "45"]] == " ".join(f"t{i}" for i in range(600 - 272, 600 - 272 + 36))
    assert "Generate" not in grid.token_leads(pairs)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", (None, 6))
def test_weights_of_blocks_are_those_of_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(blocks, "BLOCK", 40)
    rows, _ = token_rows(spark, 50)
    texts = [(str(i), " ".join(ref * 2)) for i, (_, ref, _) in enumerate(rows)] + [("null", None), ("empty", "")]
    df = spark.createDataFrame(texts, "id string, document string")
    counts, n_docs = mining.term_counts(df), mining.document_count(df)
    want = mining.tfidf(mining.max_features(counts, limit) if limit else counts, n_docs)
    got = mining.tfidf_of_texts(mining.term_blocks(df), n_docs, limit)
    found = {(r["id"], r["term"]): r["weight"] for r in got.collect()}
    assert found == pytest.approx({(r["id"], r["term"]): r["weight"] for r in want.collect()}) and found
    if not limit:
        top = [(r["term"], r["score"]) for r in mining.mask_list(df, limit=5).orderBy("rank").collect()]
        old = [(r["term"], r["score"]) for r in mining.topk_terms(want, n_docs, 5).orderBy("rank").collect()]
        assert top == old
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", (1, 30))
def test_ids_of_blocks(spark, monkeypatch, limit):
    """Rows of many words share a block's look-up; every repeat of a word gets its id, in place."""
    monkeypatch.setattr(blocks, "BLOCK", limit)
    rows, _ = token_rows(spark, 40)
    df = spark.createDataFrame([(i, " ".join(ref), " ".join(ref[:2])) for i, ref, _ in rows], "id string, document string, summary string")
    vocab = spark.createDataFrame([(w, 1, i + 2) for i, w in enumerate(WORDS[:30])], "term string, freq long, word_id int")
    ids = {w: i + 2 for i, w in enumerate(WORDS[:30])}
    key = lambda r: (r[0] or "", *r[1:])
    for unknown in (None, 99):
        cut = lambda ws: [ids.get(w, unknown) for w in ws if w in ids or unknown] + [1]  # noqa: B023, E731
        got = tokens.encode_columns(df, vocab, {"document": 6, "summary": 2}, unknown=unknown)
        assert sorted(map(key, got.collect())) == sorted((i or "", cut(ref[:5]), cut(ref[:1])) for i, ref, _ in rows)
        assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    back = tokens.decode_ids(tokens.encode_ids(df, vocab), vocab).collect()
    assert sorted(map(key, back)) == sorted((i or "", " ".join(w for w in ref if w in ids)) for i, ref, _ in rows)
