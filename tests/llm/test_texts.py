"""Toxicity, quality and secrets against definitions, edge rows and small trained fixtures."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevis.llm import quality_qda, secrets, toxic_ssk

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def slow_kernel(s, t, decay):
    """Order-3 gap-weighted kernel by listing all subsequences."""
    def feats(w):
        out = {}
        for i in itertools.combinations(range(len(w)), 3):
            if i[-1] - i[0] < toxic_ssk.SPAN:
                u = "".join(w[k] for k in i)
                out[u] = out.get(u, 0) + decay ** (i[-1] - i[0] + 1)
        return out

    a, b = feats(s), feats(t)
    return sum(v * b.get(u, 0) for u, v in a.items())


@pytest.mark.parametrize("word,mark", [("idiot", "idiot"), ("idiiot", "idiot"), ("xidiotx", "idiot"), ("banana", "bandana")])
def test_kernel_is_the_subsequence_kernel(word, mark):
    near = toxic_ssk.Landmarks([mark]).kernel([word])[0, 0]
    norm = math.sqrt(slow_kernel(word, word, toxic_ssk.DECAY) * slow_kernel(mark, mark, toxic_ssk.DECAY))
    want = slow_kernel(word, mark, toxic_ssk.DECAY) / norm
    assert near == pytest.approx(want**toxic_ssk.POWER if want >= toxic_ssk.NEAR else 0, abs=2e-3)


def test_kernel_tolerates_gaps_and_insertions():
    near = toxic_ssk.Landmarks(["idiot"]).kernel(["idiot", "i-d-i-o-t", "idixot", "table", "id", ""])[:, 0]
    assert near[0] == pytest.approx(1, abs=1e-3)
    assert near[1] > 0.5 and near[2] > 0.03 and near[2] > near[3]
    assert near[3] == near[4] == near[5] == 0


def test_single_letters_are_joined():
    assert toxic_ssk.sentences("you i d i o t there. a b") == [["you", "idiot", "there"]]
    assert toxic_ssk.sentences("") == [] and toxic_ssk.sentences(" . ") == []


def _talk(n, seed):
    rnd = random.Random(seed)
    calm = "the river runs past houses and trees while people walk along quietly today under grey skies".split()
    rude = ["moronix", "moronar", "scumble", "idiotec"]
    rows = []
    for i in range(n):
        words = [rnd.choice(calm) for _ in range(30)]
        toxic = i % 3 == 0
        if toxic:
            words[rnd.randrange(30)] = rnd.choice(rude)
        rows.append((i, " ".join(words) + ".", toxic))
    return rows


def test_toxic_training_scores_and_edge_rows(spark):
    rows = _talk(240, 1)
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t, _ in rows]
        + [(900, "what a m o r o n i x he is", "en", "s", 1), (901, "an mo-ro-nix there", "en", "s", 1), (902, None, "en", "s", 0), (903, "", None, None, 0), (None, "river houses", "en", "s", 3),
           (904, "river " * 60_000 + "scumble", "en", "s", 1)], DOC).withColumn("score", F.lit("clash")).withColumn("k", F.lit(1))
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(5, None)], "doc_id long, toxic int")
    model = toxic_ssk.train(docs, labels, F.col("doc_id") % 5 != 0)
    out = {r["doc_id"]: r["score"] for r in toxic_ssk.apply(docs, model, ["doc_id"]).collect()}
    assert all((out[i] >= 0.5) == y for i, _, y in rows)
    assert out[900] >= 0.5 and out[901] >= 0.5 and out[904] >= 0.5
    assert out[902] == out[903] < 0.5 and out[None] < 0.5


def test_toxic_without_labels_calls_nothing_toxic(spark):
    docs = spark.createDataFrame([(1, "any words here")], "doc_id long, text string")
    for rows in ([], [(1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        model = toxic_ssk.train(docs, labels, F.lit(True))
        assert toxic_ssk.apply(docs, model, ["doc_id"]).first()["score"] < 0.5
    assert toxic_ssk.apply(docs.where("false"), model, ["doc_id"]).collect() == []


def test_kernel_counts_wide_and_small_values():
    words = ["mxorxon", "moqrxonz", "mxoxrxoxn", "iiidddiiiooottt", "table"]
    near = toxic_ssk.Landmarks(["moron", "idiot"]).kernel(words)
    span = range(20)
    def feats(w):
        out = {}
        for i in itertools.combinations(span[: len(w)], 3):
            u = "".join(w[k] for k in i)
            out[u] = out.get(u, 0) + toxic_ssk.DECAY ** (i[-1] - i[0] + 1)
        return out
    dot = lambda a, b: sum(v * b.get(u, 0) for u, v in a.items())
    for w, row in zip(words, near, strict=True):
        for mark, got in zip(("moron", "idiot"), row, strict=True):
            a, b = feats(w), feats(mark)
            want = dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))
            assert got == pytest.approx(want**toxic_ssk.POWER, abs=2e-3, rel=1e-2)
    assert (near[:4].max(1) > 0).all() and near[3, 1] > 0.5


def test_toxic_recall_of_inserted_letters(spark):
    rows = _talk(240, 1)
    rude = ["moronix", "moronar", "scumble", "idiotec"]
    put = lambda w, gaps: "".join(c + ("q" if i in gaps else "") for i, c in enumerate(w))
    forms = {n: [put(w, g) for w in rude for g in itertools.combinations(range(len(w) - 1), n)] for n in (1, 2)}
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    scorer = toxic_ssk.Scorer(toxic_ssk.train(docs, labels, F.lit(True)))
    recall = (scorer.scores([f"the river {w} runs" for w in forms[1]]) >= 0.5).mean()
    assert recall >= 0.8
    clean = scorer.strongest(sorted({w for _, t, y in rows if not y for w in t.strip(".").split()})).max()
    assert (scorer.strongest(forms[2]) > clean).mean() >= 0.8
    assert (scorer.strongest([put(w, range(len(w) - 1)) for w in rude]) > 0).all()


def test_toxic_fallbacks_call_nothing_toxic(spark):
    docs = spark.createDataFrame([(i, f"plain{i} words") for i in range(8)], "doc_id long, text string")
    for ys in ([1] * 8, [0, 1] * 4):  # label 1 only; no unit that speaks for it
        labels = spark.createDataFrame(list(enumerate(ys)), "doc_id long, toxic int")
        model = toxic_ssk.train(docs, labels, F.lit(True))
        assert model.fallback is not None and model.fallback < 0.5
        assert all(r["score"] < 0.5 for r in toxic_ssk.apply(docs, model, ["doc_id"]).collect())


def test_rare_insults_are_landmarks(spark):
    rows = [(str(i), "calm river words" + (" scumble" if i < 3 else ""), int(i % 2 == 0 and i < 20 or i < 3)) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc string, text string, label int")
    assert ("scumble", True) in toxic_ssk.choose(frame, 16)


def test_posterior_is_the_density_ratio():
    rng = np.random.default_rng(3)
    means, covs = rng.normal(size=(2, 3)), [np.diag([1.0, 2, 3]), np.array([[2.0, 0.5, 0], [0.5, 1, 0.2], [0, 0.2, 1]])]
    chol = [np.linalg.cholesky(c) for c in covs]
    model = quality_qda.Discriminant(
        means, np.array([np.linalg.inv(c) for c in chol]),
        np.array([math.log(p) - np.log(np.diag(c)).sum() for p, c in zip((0.3, 0.7), chol, strict=True)]))
    x = rng.normal(size=(5, 3))
    dens = [p * np.exp(-0.5 * ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)) / math.sqrt(np.linalg.det(c))
            for p, m, c in zip((0.3, 0.7), means, covs, strict=True)]
    assert np.allclose(model.posterior(x), dens[1] / (dens[0] + dens[1]))


def test_quality_learns_and_handles_edge_rows(spark):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice(["plain", "words", "make", "sentences", "here"]) for _ in range(40)) + "."
    bad = lambda: " ".join(rnd.choice(["XX###", "$$$", "||", "CLICK!!"]) for _ in range(40))
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(120)]
    docs = spark.createDataFrame(
        [(i, t, "a", "b", 1) for i, t, _ in rows] + [(500, None, None, None, 0), (501, "", "a", "b", 0), (None, good(), "a", "b", 1)], DOC).withColumn("stats", F.lit(1))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r["score"] for r in quality_qda.classify(docs, labels, F.col("doc_id") % 4 != 2).collect()}
    assert all((out[i] >= 0.7) == bool(y) for i, _, y in rows)
    assert out[500] == out[501] and 0 <= out[500] <= 1 and len(out) == 123
    none = quality_qda.classify(docs, labels.where("false"), F.lit(True)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_qda.classify(docs.where("false"), labels, F.lit(True)).collect() == []


def slow_base(text):
    out = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|passwd|secret|[Tt]oken|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_spans_and_ownership(spark):
    live, copied = "Zk9Qw3rT7yU1iO5pA2sD4fG6", "Example9Key7Shared5Token3Abc"
    texts = [
        f"é token = \"{'ab12' * 10}\" and {live}", "password: short", "PASSWORD='longenough1' x " + "AKIA" + "A1" * 6, "AKIA" + "B" * 11,
        f"{copied} ok", f"again {copied}", "0123456789abcdef" * 2, None, "", "token: token: abcdefgh",
    ]
    rows = [(i, t, "en", f"s{i}", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s0", 1), (None, copied, None, None, 1)]
    found = secrets.find(spark.createDataFrame(rows, DOC).withColumn("base", F.lit(0))).select("doc_id", secrets.listed("base").alias("b"), secrets.listed("spans").alias("s")).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    for i, t in enumerate(texts):
        assert by[i]["b"] == ",".join(f"{k}:{s}:{e}" for k, s, e in slow_base(t or ""))
    start = texts[0].index(live)
    assert f"owned:{start}:{start + len(live)}" in by[0]["s"]
    assert "owned" not in by[4]["s"] and by[6]["b"] == "hex:0:32" and by[3]["b"] == "" == by[9]["b"]
    out = {r["doc_id"]: r["text"] for r in secrets.redacted(spark.createDataFrame(rows, DOC)).collect()}
    assert out[0].endswith("and [owned]") and "ab12" not in out[0] and out[7] is None and out[8] == "" and out[4] == texts[4]
    assert secrets.find(spark.createDataFrame([], DOC)).collect() == []


def test_ownership_counts_values_of_base_spans(spark):
    shared, live = "Zk9Qw3rT7yU1iO5pA2sD4fG6", "Mn8Bv2Cx6Lk4Jh0Gf3Ds7Aq1"
    texts = [f'api_key = "{shared}"', f"token: {shared}.", f"secret={shared}", f"password={shared} x", f"bare {shared} and {live}", "AKIA" + "A1" * 6, "AKIA" + "A1" * 6]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    sign = lambda t: hashlib.blake2b(t.encode(), digest_size=16).digest()
    counted = {bytes(r["hash"]): (r["repositories"], r["owners"]) for r in secrets.ownership(secrets.scan(docs, ["source"]), "source", "source").collect()}
    assert counted[sign(shared)] == (5, 5) and counted[sign(live)] == (1, 1) and counted[sign("AKIA" + "A1" * 6)] == (2, 2)
    spans = {r["doc_id"]: r["s"] for r in secrets.find(docs).select("doc_id", secrets.listed("spans").alias("s")).collect()}
    start = texts[4].index(live)
    assert spans[4] == f"owned:{start}:{start + len(live)}" and spans[0] == f"assign:0:{len(texts[0]) - 1}"


def test_redaction_merges_overlaps():
    assert secrets.redact("aXXXXb", [(1, 0, 4), (2, 2, 5)]) == "a[assign]b"
    assert hashlib.sha256(secrets.redact("plain", []).encode()).hexdigest() == hashlib.sha256(b"plain").hexdigest()


def test_secret_query_counts_kinds_anywhere_in_the_list(spark, tmp_path):
    from brevis.llm.queries import QUERIES

    texts = ["password=abcdefgh1 token: abcdefgh2", "deadbeef" * 4 + " then AKIA" + "A1" * 6, "AKIA" + "A1" * 6 + " " + "0f" * 16, None, ""]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op10_secret_ownership"](spark, str(tmp_path)).orderBy("doc_id")
    assert [(r["n_assign"], r["n_access"], r["n_hex"]) for r in out.collect()] == [(2, 0, 0), (0, 1, 1), (0, 1, 1), (0, 0, 0), (0, 0, 0)]
