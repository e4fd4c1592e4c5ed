"""Distributed numbering, salted joins, tables on disk, streams."""

import pytest
from pyspark.sql import functions as F

from brevis.functions import scale
from brevis.operators import filters, headlines, shorten
from brevis.sources import corpus, tables
from brevis.streaming import jobs


def test_numbering_is_the_global_order(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("id"))
    want = {k: i for i, k in enumerate(sorted(r["id"] for r in df.collect()))}
    assert {r["id"]: r["position"] for r in scale.number_rows(df, ["id"]).collect()} == want
    assert {r["id"]: r["position"] for r in scale.number_by_digest(df, "id", "id").collect()} == want


def test_numbering_within_groups_with_one_hot_group(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    got = scale.number_rows(df, ["id"], within=("g",)).collect()
    hot = sorted((r["id"], r["position"]) for r in got if r["g"] == "hot")
    assert [p for _, p in hot] == list(range(600))
    assert all(r["position"] == 0 for r in got if r["g"] != "hot")


def test_permutation_ignores_partitioning(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"))
    one = {r["id"]: r["position"] for r in filters.shuffle_seeded(df.coalesce(1)).collect()}
    many = {r["id"]: r["position"] for r in filters.shuffle_seeded(df.repartition(13)).collect()}
    other = {r["id"]: r["position"] for r in filters.shuffle_seeded(df, seed=7).collect()}
    assert one == many != other and sorted(one.values()) == list(range(500))


def test_salted_join_equals_join(spark):
    facts = spark.range(600).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    keyed = facts.select("k").distinct().withColumn("v", F.length("k"))
    plain = sorted(map(tuple, facts.join(keyed, ["k"]).select("k", "id", "v").collect()))
    spark.conf.set("brevis.salts", "8")
    try:
        salted = scale.spread_join(facts, keyed, ["k"])
        assert sorted(map(tuple, salted.select("k", "id", "v").collect())) == plain
        assert scale.spread_join(facts, keyed.limit(0), ["k"], "left").count() == 600
    finally:
        spark.conf.unset("brevis.salts")


def test_steps_must_add_up(spark):
    rows = spark.createDataFrame([("1", "train"), ("2", "test")], "id string, split string")
    good = spark.createDataFrame([("train", 1), ("test", 1)], "split string, n_rows long")
    assert tables.combine_steps(rows, good).count() == 2
    with pytest.raises(ValueError):
        tables.combine_steps(rows, good.where("split = 'train'"))


def test_lookup_needs_exactly_one_length(spark):
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    lengths = spark.createDataFrame([("1", 5), ("2", 6), ("2", 7)], "id string, doc_len int")
    with pytest.raises(Exception, match="exactly one length for id 2"):
        filters.lookup_lengths(ids, lengths).collect()


def test_unequal_id_lists_raise(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("id"))
    with pytest.raises(ValueError):
        tables.attach_ids(df.withColumnRenamed("id", "row"), df.limit(2), ["row"], ["id"])


def test_unknown_corpus_raises(spark):
    with pytest.raises(ValueError):
        corpus.load_pairs(spark.range(1), "other")


def test_pairs_split_at_the_first_sentence(spark):
    rows = [(1, "..First one. Second one.\nThird."), (2, "Only one"), (3, "..."), (4, "a. a. b")]
    got = corpus.pairs_from_texts(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()
    assert {r["id"]: (r["summary"], r["document"]) for r in got} == {
        "1": ("First one.", "Second one.\nThird."), "2": ("Only one", ""), "3": ("", "..."), "4": ("a.", "a. b")}


def test_profile_survives_csv(spark):
    rows = [("1", 'a "quoted"\n line, with comma', ""), ("2", "\n lead ", "x\\")]
    pairs = spark.createDataFrame(rows, "id string, document string, summary string")
    path = scale.fresh_dir(spark, "profile")
    tables.write_length_profile(tables.length_profile(pairs), path)
    back = {r["id"]: (r["doc_text"], r["target_text"]) for r in tables.read_length_profile(spark, path).collect()}
    assert back == {i: (d, s) for i, d, s in rows}


def test_timestamps(spark):
    df = spark.createDataFrame([("Feb. 3, 2022 at 4:05 p.m. ET",), ("Jan. 10, 2022 at 11:59 a.m. ET",), ("?",)], "stamp string")
    shown = lambda d: [r["s"] for r in d.select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("s")).collect()]
    assert shown(headlines.parse_timestamp(df)) == ["2022-02-03 16:05", "2022-01-10 11:59", None]
    assert shown(headlines.parse_timestamp(df, faithful=True))[0] == "2022-02-03 04:05"


def test_headlines(spark):
    html = '<h3 class="x">Up 5%: <b>good</b>, day?\n</h3><h3>Overview</h3><h3>MarketWatch</h3><h33>no</h33>'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    found = headlines.extract_headlines(df)
    assert [r["headline"] for r in found.orderBy("pos").collect()] == ["Up 5%: good, day?\n", "Overview", "MarketWatch"]
    assert [r["headline"] for r in headlines.clean_headline(found).collect()] == ["up 5percent good day"]


def test_stream_takes_each_file_once(spark):
    source, out = scale.fresh_dir(spark, "in"), scale.fresh_dir(spark, "out")
    schema = "id string, document string"
    strategy = lambda d: shorten.shorten_head(d, 3).select("id", "shortened_document")

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, schema)
        jobs.stream_shorten(stream, strategy, out, out + "-state").awaitTermination()
        return sorted((r["id"], r["shortened_document"]) for r in spark.read.parquet(out).collect())

    assert arrive([("1", "a b c d")]) == [("1", "a b c")]
    assert arrive([("2", "e")]) == [("1", "a b c"), ("2", "e")]


def test_closed_windows_are_appended(spark):
    source, out = scale.fresh_dir(spark, "in"), scale.fresh_dir(spark, "out")
    schema = "run string, ts timestamp, value double"
    rows = spark.sql("SELECT 'a' AS run, timestamp '2024-01-01 10:00' + make_dt_interval(id) AS ts, double(id) AS value FROM range(4)")
    rows.write.parquet(source)
    means = jobs.windowed_means(jobs.file_stream(spark, source, schema))
    jobs.write_windows(means, out, out + "-state").awaitTermination()
    got = spark.read.schema("run string, window_start timestamp, mean_value double, n_rows long").parquet(out)
    assert [r["mean_value"] for r in got.orderBy("window_start").collect()] == [0.0, 1.0]


def test_registered_queries_send_small_batches(spark):
    from brevis.plans import queries

    queries.table(spark, "/root/testdata/sf0.001", "documents")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == scale.BATCH_BYTES
    rows = F.pandas_udf(lambda s: s.map(lambda _: len(s)), "long")
    wide = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 1000).alias("t"))  # 20 MB
    assert wide.select(rows("t").alias("n")).agg(F.max("n")).first()[0] < 1000
