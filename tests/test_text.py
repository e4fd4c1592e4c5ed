"""Golden probes of the text functions and the row-wise strategies."""

import pytest
from pyspark.sql import functions as F

from brevis import constants as K
from brevis.functions import text as T
from brevis.operators import extractive, filters, headlines, shorten, tokens


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def test_punctuation_chain(spark):
    joined = lambda c: T.respace(F.array_join(T.words(c), " "))
    assert one(spark, "rose 5 % , said ( BBC ) .", joined) == "rose 5%, said (BBC)."
    assert one(spark, "up 3.5 today", joined) == "up 3. 5 today"
    # A closing mark is a split point each time, even back to back.
    assert one(spark, "a ] ]c", T.respace) == "a] ] c"


def test_token_counts(spark):
    assert one(spark, "", T.token_count) == 1
    assert one(spark, " a\n b ", T.token_count) == 3
    assert one(spark, " a\n b ", T.tokens) == ["a", "b"]
    assert one(spark, "", T.tokens) == []
    assert one(spark, " a  b\nc d", lambda c: T.lead(c, 3)) == "a b c"
    assert one(spark, "a", lambda c: T.lead(c, 3)) == "a"


def test_runs_and_overlap(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c"], ["b", "b", "b", "a"]), ([], ["x"])], "l array<string>, r array<string>")
    got = df.select(T.runs(F.col("l")).alias("runs"), T.overlap(F.col("l"), F.col("r")).alias("n")).collect()
    assert [(r["word"], r["n"]) for r in got[0]["runs"]] == [("a", 1), ("b", 2), ("c", 1)]
    assert [g["n"] for g in got] == [3, 0]


def test_band_floor():
    assert filters.band_floor(512) == 485
    assert filters.band_floor(1024) == 972
    with pytest.raises(ValueError):
        filters.band_floor(2048)


def test_params():
    filters.check_params("head", "25", 373)
    filters.check_params("stopwords", "all", None)
    for bad in (("unknown", "25", 373), ("head", "26", 373), ("head", "25", 323)):
        with pytest.raises(ValueError):
            filters.check_params(*bad)


@pytest.mark.parametrize("tenths,budget,size", [(2, 373, 373), (5, 373, 373), (5, 512, 513)])
def test_headtail_sizes(spark, tenths, budget, size):
    text = " ".join(f"w{i}" for i in range(1000))
    row = shorten.shorten_headtail(spark.createDataFrame([("1", text)], "id string, document string"), budget, tenths).first()
    assert row["shortened_len"] == size
    kept = row["shortened_document"].split(" ")
    assert len(kept) == size - 1 and kept[0] == "w0" and kept[-1] == "w999"


def test_short_documents_stay_whole(spark):
    df = spark.createDataFrame([("1", "a b c"), ("2", "")], "id string, document string")
    for made in (shorten.shorten_head(df, 10), shorten.shorten_tail(df, 10), shorten.shorten_headtail(df, 10, 2)):
        rows = {r["id"]: (r["shortened_document"], r["shortened_len"]) for r in made.collect()}
        assert rows == {"1": ("a b c", 4), "2": ("", 1)}


def test_stopwords_keep_negations(spark):
    df = spark.createDataFrame([("1", "I do not know this ship")], "id string, document string")
    plain, neg = shorten.shorten_stopwords(df).first(), shorten.shorten_stopwords(df, keep_negations=True).first()
    assert (plain["shortened_document"], plain["removed_words"]) == ("know ship", 4)
    assert (neg["shortened_document"], neg["removed_words"]) == ("not know ship", 3)
    assert len(K.STOPWORDS) == 179 and set(K.NEGATIONS) <= set(K.STOPWORDS)


def test_mod_pick(spark):
    # Sentences of 339, 32 and 8 tokens: candidates of 340, 372 and 380 tokens with the end mark.
    ranked = F.array(*[
        F.struct(F.lit(float(-s)).alias("neg"), F.lit(i).alias("pos"), F.lit(n).alias("len"), F.lit("x").alias("text"))
        for i, (n, s) in enumerate(((339, 3), (32, 2), (8, 1)))
    ])
    mod = spark.range(1).select(extractive._cut(ranked, F.lit(2), F.lit(373), "mod").alias("c")).first()["c"]
    near = spark.range(1).select(extractive._cut(ranked, F.lit(2), F.lit(373), "closest").alias("c")).first()["c"]
    assert (mod["k"], mod["size"]) == (3, 380)
    assert (near["k"], near["size"]) == (2, 372)


def test_keyword_topics(spark):
    df = spark.createDataFrame([("q1 profit rises as retail sales rise",), (None,), ("nothing",)], "h string")
    assert {r["topic"] for r in filters.keyword_topics(df, "h").collect()} == {"stock", "sales", "performance"}


def test_cleaning(spark):
    assert one(spark, "The 2021 ship's engine, was: very-LOUD 12345 ok", tokens.clean_text) == "ships engine veryloud"
    assert one(spark, "the ship was not here", tokens.remove_stopwords) == "ship"


def test_porter():
    # Published examples of the algorithm.
    for word, stem in {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster",
        "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi",
        "relational": "relat", "conditional": "condit", "hopeful": "hope", "goodness": "good",
        "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "probate": "probat",
        "rate": "rate", "controll": "control", "sky": "sky", "was": "was",
    }.items():
        assert tokens.porter_stem(word) == stem, word


def test_mask_words_gives_the_same_rows_for_any_list(spark, monkeypatch):
    rows = [("1", "a b c b"), ("2", "b"), ("3", ""), ("4", None), (None, "b a"), ("1", "c b"), ("2", "b")]
    df = spark.createDataFrame(rows, "id string, document string")
    long = [("b",), (None,), *[(f"t{i}",) for i in range(3000)]]
    want = sorted([("1", "a c"), ("2", ""), ("3", ""), ("4", None), (None, "a"), ("1", "c"), ("2", "")], key=repr)
    for mask in (long[:2], long):
        for parts in (1, 8):
            out = filters.mask_words(df.repartition(parts), spark.createDataFrame(mask, "term string")).collect()
            assert sorted((tuple(r) for r in out), key=repr) == want


def test_null_texts_stay_null(spark):
    df = spark.createDataFrame([("1", None), (None, "One two. Three.")], "id string, document string")
    made = [shorten.shorten_head(df, 5), shorten.shorten_tail(df, 5), shorten.shorten_headtail(df, 5),
            shorten.shorten_stopwords(df), extractive.shorten_ranked(df, "luhn", {"25": 5}),
            extractive.shorten_ranked(df, "lsa", {"25": 5}), extractive.shorten_ranked(df, "textrank", {"25": 5})]
    for out in made:
        got = {r["id"]: (r["shortened_document"], r["shortened_len"]) for r in out.collect()}
        assert got["1"] == (None, None) and got[None][0] and got[None][1], out.columns
