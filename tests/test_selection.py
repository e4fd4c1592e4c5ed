"""Heavy-hitter joins, selection of ranks, places in files, quoted CSV by splits: against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import DataFrame, functions as F

from brevis.functions import scale
from brevis.operators import embedding, filters, quality, tokens
from brevis.sources import tables


def skewed(spark, rows=8000):
    """Two thirds of the rows hold one key; null keys as well."""
    key = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, None).otherwise((F.col("id") % 900).cast("string"))
    return spark.range(rows).select("id", key.alias("k"), (F.col("id") * 7).alias("x"))


@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("nulls", [True, False])
def test_heavy_hitter_join_equals_join(spark, known, how, nulls):
    facts = skewed(spark)
    keyed = facts.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("v")).where("k IS NULL OR k != '3'")
    got = scale.spread_join(facts, keyed if known else keyed.drop("n"), ["k"], how, "n" if known else None, nulls, limit=8)
    right = keyed.withColumnRenamed("k", "_k")
    same = facts["k"].eqNullSafe(right["_k"]) if nulls else facts["k"] == right["_k"]
    want = facts.join(right, same, how).select("k", "id", "x", "v")
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_hot_key_is_spread_over_the_tasks(spark):
    """Four tasks: none gets more than twice its share, though one key has two thirds of the rows."""
    facts = skewed(spark)
    keyed = facts.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("v"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for held in ("n", None):
            met = scale.spread_join(facts, keyed if held else keyed.drop("n"), ["k"], held=held, nulls=True)
            sizes = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert len(sizes) == 4 and max(sizes) <= 2 * 8000 / 4 and sum(sizes) == 8000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_heavy_keys_miss_none(spark):
    facts = spark.range(30_000).select(F.when(F.col("id") % 5 == 0, F.lit(1)).when(F.col("id") % 7 == 0, F.lit(2)).otherwise(F.col("id")).alias("a"), F.lit("b").alias("b"))
    heavy = scale.heavy_keys(facts.repartition(5), ["a", "b"], limit=12)
    found = {(r["a"], r["b"]) for r in heavy.collect()}
    assert {(1, "b"), (2, "b")} <= found and len(found) <= 24
    assert scale.heavy_keys(facts.where("false"), ["a"]).collect() == []


VALUES = {
    "ties": [1.0] * 500 + [2.0] * 300 + [-3.5],
    "spread": [random.Random(1).gauss(0, 1) * 10 ** random.Random(i).randrange(-8, 9) for i in range(3000)],
    "far": [0.0, 1e308, -1e308, 5e-324, math.inf, -math.inf] + [i / 7 for i in range(2000)],
    None: [4.0, 2.0],
    "one": [9.25],
}


def test_ranks_are_selected_without_a_sort(spark, monkeypatch):
    rows = [(g, v) for g, vs in VALUES.items() for v in vs] + [("ties", None), ("empty", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    ranks = [(g, r) for g, vs in VALUES.items() for r in {0, len(vs) // 3, len(vs) // 2, len(vs) - 1}]
    wanted = spark.createDataFrame(ranks + [("empty", 0), ("one", 5)], "g string, rank long")

    def never(*_, **__):
        raise AssertionError("a global sort")

    for name in ("repartitionByRange", "orderBy", "sort"):
        monkeypatch.setattr(DataFrame, name, never)
    monkeypatch.setattr(scale, "FEW", 20)  # several passes
    got = {(r["g"], r["rank"]): r["value"] for r in scale.ranked_values(df, "v", wanted, ("g",)).collect()}
    assert got == {(g, r): sorted(VALUES[g])[r] for g, r in ranks}
    whole = [v for g, v in rows if v is not None and not math.isnan(v)]
    one = scale.ranked_values(df, "v", spark.createDataFrame([(r,) for r in (0, 17, 2500)], "rank long")).collect()
    assert {r["rank"]: r["value"] for r in one} == {r: sorted(whole)[r] for r in (0, 17, 2500)}


def test_quantiles_keep_null_groups(spark):
    rows = [("a", float(i), str(i)) for i in range(11)] + [(None, 1.0, "x"), (None, 2.0, "y")]
    df = spark.createDataFrame(rows, "run string, v double, id string")
    out = {r["run"]: (r["low"], r["p10"], r["p50"], r["high"]) for r in quality.score_quantiles(df, "v", "id", ("run",)).collect()}
    assert out == {"a": (0.0, 1.0, 5.0, 10.0), None: (1.0, 1.1, 1.5, 2.0)}
    bins = quality.length_hist(df, "v", 2, ("run",)).groupBy("run").agg(F.sum("n_rows").alias("n")).collect()
    assert {r["run"]: r["n"] for r in bins} == {"a": 11, None: 2}


PAIRS = [("1", "one two two", "a"), (None, "three", "b c"), ("1", "four one", ""), (None, None, "x"), ("2", "", None)]


def test_null_and_repeated_ids_keep_their_rows(spark):
    """Rows in, rows out, for every operator that used to join by id."""
    pairs = spark.createDataFrame(PAIRS, "id string, document string, summary string").coalesce(1)
    texts = sorted((i or "", d or "", s or "") for i, d, s in PAIRS)
    prof = tables.length_profile(pairs).collect()
    assert sorted((r["id"] or "", r["doc_text"] or "", r["target_text"] or "") for r in prof) == texts
    assert sorted(r["index"] for r in prof) == list(range(5)) and [r["id"] for r in sorted(prof, key=lambda r: r["index"])][:2] == [None, None]
    placed = filters.shuffle_seeded(pairs.select("id")).collect()
    assert sorted(r["position"] for r in placed) == list(range(5))
    vocab = tokens.id_vocab(pairs, F.split(F.coalesce("document", F.lit("")), " "))
    ids = tokens.encode_ids(pairs, vocab)
    assert sorted((r["id"] or "", len(r["ids"])) for r in ids.collect()) == sorted((i or "", len((d or "").split()) + 1) for i, d, _ in PAIRS)
    back = tokens.decode_ids(ids, vocab)
    assert sorted((r["id"] or "", r["text"]) for r in back.collect()) == sorted((i or "", d or "") for i, d, _ in PAIRS)
    marked = tokens.encode_ids(pairs.withColumn("document", F.lit("one never")), vocab, unknown=3)
    assert {tuple(r["ids"])[1:] for r in marked.collect()} == {(3, 1)}
    both = tokens.encode_columns(pairs, vocab, {"document": 512, "summary": 36}).withColumnsRenamed({"document": "ids", "summary": "target_ids"})
    assert tokens.pack_features(both, length=8, target_length=4).count() == 5
    lookup = spark.createDataFrame([(w, [1.0, float(i)]) for i, w in enumerate(("one", "two", "three", "four", "a", "b"))], "token string, vector array<double>")
    cut = pairs.select("id", F.split("document", " ").alias("ref"), F.split("summary", " ").alias("hyp"))
    bags = embedding.token_bags(cut, "ref", "hyp", lookup).collect()
    assert sorted((r["id"] or "", sum(x["n"] for x in r["ref"])) for r in bags) == sorted((i or "", len((d or "").split())) for i, d, _ in PAIRS)


def test_places_in_files(spark):
    folder = scale.fresh_dir(spark, "files")
    spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.lit("same")).alias("t")).repartition(7).write.parquet(folder)
    got = tables.file_positions(spark, folder, ["id", "t"]).collect()
    assert sorted(r["position"] for r in got) == list(range(1000)) and sorted(r["id"] for r in got) == list(range(1000))
    again = {r["id"]: r["position"] for r in tables.file_positions(spark, folder, ["id"]).collect()}
    assert again == {r["id"]: r["position"] for r in got}
    first = spark.read.parquet(folder).select("id", "_metadata.file_path", "_metadata.row_index").collect()
    want = {r["id"]: i for i, r in enumerate(sorted(first, key=lambda r: (r["file_path"], r["row_index"])))}
    assert again == want
    plan = tables.file_positions(spark, folder, ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_quoted_csv_is_read_by_many_tasks(spark):
    rnd = random.Random(8)
    bits = ["a", "\n", '"', ",", "\r\n", "\\", "é", " ", "\\N", "\n\n", '""', "word " * 30]
    rows = [(i, str(i), "".join(rnd.choice(bits) for _ in range(rnd.randrange(40))), "x" if i % 5 else None, i, 2) for i in range(2000)]
    rows[700] = (700, "700", "long\n" * 20_000, "one record over many splits", 1, 1)
    df = spark.createDataFrame(rows, tables.PROFILE_SCHEMA)
    path = scale.fresh_dir(spark, "quoted")
    tables.write_length_profile(df.coalesce(2), path)
    plain = spark.read.schema(tables.PROFILE_SCHEMA).options(**tables.CSV_OPTIONS, multiLine=True).csv(path)
    want = Counter(map(tuple, plain.collect()))
    settings = {"spark.sql.files.maxPartitionBytes": "9000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = tables.read_quoted(spark, path, tables.PROFILE_SCHEMA)
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        assert Counter(map(tuple, out.collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert Counter(map(tuple, tables.read_quoted(spark, path, tables.PROFILE_SCHEMA).collect())) == want
    assert sum(want.values()) == 2000
