"""c_v coherence against whole windows, and the stemmer and its verb lemmas against published pairs."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brevis.functions.snowball import snowball_stem
from brevis.operators import coherence, tokens, topics


def slow_cv(topics_, texts, window):
    held, total = Counter(), 0
    for words in texts:
        for s in range(max(len(words) - window + 1, 1) if words else 0):
            seen = set(words[s : s + window])
            total += 1
            held.update((a, b) for a in seen for b in seen)
    out = {}
    for name, words in topics_.items():
        info = {}
        for a in words:
            for b in words:
                n, na, nb = held[a, b], held[a, a], held[b, b]
                p = n / total + 1e-12
                info[a, b] = 0.0 if not na or not nb else 1.0 if n == total else math.log(p / (na / total * nb / total)) / -math.log(p)
        star = {b: sum(info[a, b] for a in words) for b in words}
        size = math.sqrt(sum(v * v for v in star.values()))
        cos = []
        for a in words:
            own = math.sqrt(sum(info[a, b] ** 2 for b in words))
            cos.append(sum(info[a, b] * star[b] for b in words) / (own * size) if own and size else 0.0)
        out[name] = sum(cos) / len(cos)
    return out


@pytest.mark.parametrize("window", [1, 3, 8, 110])
def test_coherence_equals_whole_windows(spark, window):
    words = "river house tree cloud stone bread paper light".split()
    texts = [[words[(i * j + j // 3) % (3 + i % 6)] for j in range((i * 37) % 60)] for i in range(40)]
    found = {"a": words[:4], "b": words[2:7], "c": ["river", "never"], "d": ["stone"]}
    docs = spark.createDataFrame([(str(i), " ".join(t)) for i, t in enumerate(texts)] + [("n", None), ("e", "")], "id string, document string")
    tops = spark.createDataFrame([(k, w) for k, ws in found.items() for w in ws] + [("a", "river"), (None, "x"), ("a", None)], "topic string, term string")
    got = {r["topic"]: r["coherence"] for r in coherence.topic_coherence_cv(tops, docs, window=window).collect()}
    want = slow_cv(found, texts, window)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_long_texts_in_slabs(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    who, where = rng.integers(0, 5, 400), np.sort(rng.choice(5000, 400, replace=False))
    whole = coherence._together(where, who, 5000, 5, 20)
    monkeypatch.setattr(coherence, "_SLAB", 7)
    assert (coherence._together(where, who, 5000, 5, 20) == whole).all()
    seen = [{int(w) for w, p in zip(who, where, strict=True) if s <= p < s + 20} for s in range(4981)]
    assert all(whole[a, b] == sum(a in x and b in x for x in seen) for a in range(5) for b in range(5))


def test_sweep_ends_with_a_choice(spark):
    docs = spark.createDataFrame([(str(i), ("river boat water fish " if i % 2 else "bread oven flour salt ") * 5) for i in range(20)], "id string, document string")
    for measure in ("c_v", "npmi"):
        out = topics.coherence_sweep(docs, ks=(2, 3, 4), top=3, measure=measure)
        assert sorted(r["k"] for r in out.collect()) == [2, 3, 4]
        assert topics.best_k(out).first()["k"] in (2, 3, 4)
    with pytest.raises(ValueError):
        topics.coherence_sweep(docs, measure="other")


def test_tails_have_their_own_topics(spark):
    docs = spark.createDataFrame([(str(i), ("river boat " if i < 10 else "bread oven ") * 5) for i in range(20)], "id string, document string")
    tails = docs.select("id", F.when(F.col("id").cast("int") < 10, "bad").otherwise("good").alias("tail"))
    out = topics.tail_topics(tails, docs, "document", k=2, top=2, passes=2).collect()
    assert {(r["tail"], r["term"]) for r in out} == {("bad", "river"), ("bad", "boat"), ("good", "bread"), ("good", "oven")}
    assert Counter((r["tail"], r["topic"]) for r in out) == {(t, k): 2 for t in ("bad", "good") for k in (0, 1)}


# Pairs as published with the stemmer.
PUBLISHED = """consign consign consigned consign consignment consign consist consist consistency consist consistently consist
consolation consol consolatory consolatori consolidate consolid consoling consol consolingly consol consonant conson conspicuously conspicu
conspiracy conspiraci conspirators conspir constable constabl constance constanc knackeries knackeri knaves knave kneeled kneel
knightly knight knitting knit knives knive knocker knocker generous generous generate generat arsenal arsenal ties tie cries cri gas gas
kiwis kiwi luxuriated luxuri hopping hop hoping hope skies sky dying die news news inning inning proceed proceed relational relat rational ration
controlling control cheerfully cheer carelessly careless adoption adopt say say by by""".split()


def test_snowball_stems_as_published():
    assert {w: snowball_stem(w) for w in PUBLISHED[::2]} == dict(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True))


def test_verb_lemmas_come_before_the_stem(spark):
    docs = spark.createDataFrame([("1", "went gone running thought houses"), ("2", "went children")], "id string, document string")
    out = {r["word"]: (r["lemma"], r["stem"]) for r in tokens.lemma_stem_vocab(docs, F.split("document", " ")).collect()}
    assert out == {"went": ("go", "go"), "gone": ("go", "go"), "running": ("running", "run"), "thought": ("think", "think"),
                   "houses": ("houses", "hous"), "children": ("children", "children")}
    own = spark.createDataFrame([("children", "child")], "word string, lemma string")
    assert {r["word"]: r["stem"] for r in tokens.lemma_stem_vocab(docs, F.split("document", " "), own).collect()}["children"] == "child"
