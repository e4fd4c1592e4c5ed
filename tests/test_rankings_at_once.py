"""Rankings made in one pass, dense and sparse, and texts cut at their spaces."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevis import constants as K
from brevis.operators import extractive, shorten

SOME = "the cat sat on a mat and dog's tail not far from there".split()


def documents(n=60, seed=2):
    rnd = random.Random(seed)
    line = lambda: " ".join(rnd.choice(SOME) for _ in range(rnd.randrange(14)))
    return [rnd.choice(["\n", ". ", "! "]).join(line() for _ in range(rnd.randrange(12))) for _ in range(n)] + ["", "12 34. 5", None]


def test_rankings_at_once_are_those_one_by_one(spark):
    df = spark.createDataFrame([(d,) for d in documents()], "document string")
    d = F.col("document")
    rows = df.select(
        extractive.rankings_of(d, ("luhn", "lsa", "textrank")).alias("r"),
        *[f(d).alias(m) for m, f in extractive.RANKINGS.items()]).collect()
    for r in rows:
        for m in extractive.RANKINGS:
            assert (r["r"][m] or []) == pytest.approx(r[m] or [], abs=1e-9), m


def test_filled_and_unfilled_graph_give_the_same_ranks(monkeypatch):
    for d in documents(30, 3)[:30]:
        lines = d.replace("!", ".").replace("\n", ".").split(".")
        dense = extractive._overlap_ranks(lines, K.DAMPING, K.RANK_ROUNDS)
        with monkeypatch.context() as m:
            m.setattr(extractive, "DENSE", 0)
            assert np.allclose(dense, extractive._overlap_ranks(lines, K.DAMPING, K.RANK_ROUNDS), atol=1e-12)


@pytest.mark.parametrize("budget", (2, 5, 11, 40))
def test_cuts_at_spaces_are_cuts_of_tokens(spark, budget):
    df = spark.createDataFrame([(d,) for d in documents(20, 5)] + [(" a \t\n b ",)], "document string")
    toks = shorten.spaced(F.col("document"))
    made = df.select("document", *[F.struct(*f(toks, budget)).alias(m.replace(".", "")) for m, f in shorten.TOKEN_METHODS.items()]).collect()
    for r in made:
        if r["document"] is None:
            assert r["head"][0] is None and r["tail"][0] is None
            continue
        words = r["document"].split()
        assert tuple(r["head"]) == (" ".join(words[:budget]), min(len(words) + 1, budget))
        kept = min(len(words), budget - 1)
        assert tuple(r["tail"]) == (" ".join(words[len(words) - kept:]), kept + 1)
        for tenths in (2, 5):
            front, back = tenths * budget // 10 + 1, (10 - tenths) * budget // 10
            whole = len(words) + 1 <= front + back
            ends = words if whole else words[:front] + words[len(words) - max(back - 1, 0):]
            assert tuple(r[f"headtail0{tenths}"]) == (" ".join(ends), len(words) + 1 if whole else front + back)
