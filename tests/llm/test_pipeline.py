"""The corpus pipeline on a small corpus whose right outcome is known stage by stage."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = "token = " + "\"" + "0123abcd" * 5 + "\""


def _corpus():
    rnd = random.Random(6)
    vocab = [f"{a}{b}" for a in ("ra", "le", "mi", "to", "su", "ka") for b in ("na", "rel", "sto", "vim", "pa", "dor", "gle")]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n)) + "."
    rows, toxic = {}, set()
    for i in range(160):
        rows[i] = say(60)
        if i % 4 == 0:
            rows[i] = rows[i].replace(" ", " moronish ", 1)
            toxic.add(i)
    bench = [say(20)[:-1], "one short item"]
    base = say(200)
    rows |= {
        201: base, 202: base, 203: base.replace(base.split()[50], "changed", 1), 204: say(30) + " " + bench[0] + " " + say(20),
        205: say(40) + " " + SECRET + " " + say(5), 206: None, 207: "", 208: say(4000) + " " + bench[0],
    }
    return rows, toxic, bench


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, toxic, bench = _corpus()
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame = [(i, t, "en", f"s{i % 7}", len(t or "")) for i, t in rows.items()] + [(201, rows[201], "en", "s1", 0), (None, "no key at all", None, None, 1)]
    docs = spark.createDataFrame(frame, DOC).withColumn("score", F.lit(0.5)).withColumn("key", F.lit("x"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, toxic


def ids(df):
    return sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_take_effect(spark, corpus):
    folder, rows, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "token_ids"]
    every = ids(docs)
    mild = stages["toxicity"](spark, docs, folder)
    assert mild.columns == docs.columns and ids(mild) == [i for i in every if i not in toxic]
    single = stages["near_duplicates"](spark, docs, folder)
    assert single.columns == docs.columns
    want = [i for i in every if i not in (202, 203)]
    want.remove(201)
    assert ids(single) == want
    clean = stages["decontamination"](spark, docs, folder)
    assert clean.columns == docs.columns and ids(clean) == [i for i in every if i != 204]
    hidden = stages["secrets"](spark, docs, folder)
    assert hidden.columns == docs.columns and ids(hidden) == every
    changed = {r["doc_id"]: r for r in hidden.collect()}
    assert SECRET not in changed[205]["text"] and "[assign]" in changed[205]["text"] and changed[205]["n_chars"] == len(changed[205]["text"])
    assert changed[206]["text"] is None and all(changed[i]["text"] == t for i, t in rows.items() if i != 205)
    coded = stages["token_ids"](spark, docs, folder).collect()
    assert len(coded) == len(every) and all(r["intact"] for r in coded)


def test_near_copies_spare_other_texts_of_a_key(spark):
    say = lambda w: " ".join(f"{w}{i}" for i in range(80))
    rows = [(1, say("a")), (2, say("a") + " end"), (2, say("b")), (2, say("b")), (3, say("b") + " end"), (None, say("a")), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted([(0, say("a")), (1, say("a")), (2, say("b")), (4, ""), (4, "")])


def test_stages_take_empty_tables(spark, corpus):
    folder = corpus[0]
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).collect() == []


def test_run_chains_the_stages(spark, corpus):
    folder, rows, toxic = corpus
    out = corpus_pipeline.run(spark, folder)
    gone = {*toxic, 202, 203, 204}
    assert ids(out) == sorted([i for i in rows if i not in gone] + [-1])
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_numbered_queries_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
