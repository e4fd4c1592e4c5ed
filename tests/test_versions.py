"""Versions of a table, streams that see files twice, steps in few files, score tables and run summaries."""

import pytest
from pyspark.sql import functions as F

from brevis.functions import scale
from brevis.operators import shorten
from brevis.plans import queries
from brevis.sources import tables, versions
from brevis.streaming import jobs


def values(df):
    return sorted(r["v"] for r in df.collect())


def test_readers_see_the_last_whole_version(spark, monkeypatch):
    path = scale.fresh_dir(spark, "versions")
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    versions.write_version(rows(1, 2), path, 1)
    held = versions.read_version(spark, path)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:  # all files are written, the commit is not
        m.setattr(versions, "commit", fails)
        with pytest.raises(OSError):
            versions.write_version(rows(3), path, 2)
    assert values(versions.read_version(spark, path)) == [1, 2] == values(held)
    broken = rows(4).select(F.raise_error(F.lit("bad row")).cast("long").alias("v"))
    with pytest.raises(Exception, match="bad row"):  # the write itself breaks off
        versions.write_version(broken, path, 2)
    assert values(versions.read_version(spark, path)) == [1, 2]
    versions.write_version(rows(3), path, 2)
    versions.write_version(rows(5), path, 2)  # a replayed batch
    assert values(versions.read_version(spark, path)) == [5] and values(held) == [1, 2]
    versions.write_version(rows(6), path, 3)
    assert versions.committed(spark, path) == [2, 3]
    assert sorted(map(tuple, versions.read_every_version(spark, path).select("v", "version").collect())) == [(5, 2), (6, 3)]


def test_running_means_survive_a_failing_batch(spark, monkeypatch):
    source, path = scale.fresh_dir(spark, "in"), scale.fresh_dir(spark, "means")
    schema = "run string, epoch int, value double"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(source)
        stream = jobs.running_means(jobs.file_stream(spark, source, schema))
        jobs.write_running(stream, path, path + "-state").awaitTermination()
        return {(r["run"], r["epoch"]): (r["mean_value"], r["n_rows"]) for r in versions.read_version(spark, path).collect()}

    assert arrive(("a", 1, 2.0)) == {("a", 1): (2.0, 1)}
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *_: 1 / 0)
        with pytest.raises(Exception):
            arrive(("a", 1, 4.0))
    assert [r["n_rows"] for r in versions.read_version(spark, path).collect()] == [1]
    assert arrive(("b", 1, 1.0)) == {("a", 1): (3.0, 2), ("b", 1): (1.0, 1)}


def test_a_file_delivered_twice_gives_each_id_once(spark):
    source, out = scale.fresh_dir(spark, "in"), scale.fresh_dir(spark, "out")
    schema = "id string, document string"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.once(jobs.file_stream(spark, source, schema), ("id", "document"))
        strategy = lambda d: shorten.shorten_head(d, 3).select("id", "shortened_document")
        jobs.stream_shorten(stream, strategy, out, out + "-state").awaitTermination()
        return sorted((r["id"] or "", r["shortened_document"]) for r in spark.read.parquet(out).collect())

    first = [("1", "a b c d"), ("2", "e"), (None, "n")]
    assert arrive(*first) == [("", "n"), ("1", "a b c"), ("2", "e")]
    assert arrive(*first) == [("", "n"), ("1", "a b c"), ("2", "e")]  # the same rows under another name
    assert arrive(("2", "other"), (None, "m")) == [("", "m"), ("", "n"), ("1", "a b c"), ("2", "e"), ("2", "other")]


def test_a_step_is_read_without_the_others(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"), F.floor(F.col("id") / 128).alias("step"),
        F.sha2(F.col("id").cast("string"), 512).alias("text"), "id")
    path = scale.fresh_dir(spark, "steps")
    tables.write_steps(rows, path, parts=2, row_group=16_384)
    want = {(r["split"], r["step"], r["id"]) for r in rows.select("split", "step", "id").collect()}
    assert {(r["split"], r["step"], r["id"]) for r in tables.read_steps(spark, path).collect()} == want
    one = tables.read_steps(spark, path, "train", 77, 77)
    assert {r["id"] for r in one.collect()} == {i for s, k, i in want if s == "train" and k == 77}
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(files)
    assert listed.getFileCount() <= 6 + 4  # data files of two splits, success mark and checksums aside
    plan = one._jdf.queryExecution().executedPlan()
    one._jdf.queryExecution().toRdd().count()
    read = [x for x in str(plan.toString()).split("\n") if "PushedFilters" in x]
    assert read and "EqualTo(step,77)" in read[0].replace(" ", "") or "GreaterThanOrEqual(step,77)" in read[0]
    metrics = _scan_rows(plan)
    assert 0 < metrics < 3000


def _scan_rows(plan):
    found = plan.collectLeaves()
    return sum(found.apply(i).metrics().apply("numOutputRows").value() for i in range(found.size()))


def test_full_run_summary(spark):
    metrics = [("a", 0, "rouge1", 1.0), ("a", 1, "rouge1", 2.0), ("a", 1, "rouge1", 4.0), ("a", 1, "gen_len", 7.0), (None, 0, "rouge2", 5.0), ("a", 1, "other", 9.0)]
    losses = [("a", 0, "train", 3.0), ("a", 0, "validation", 2.0), ("a", 1, "train", 2.5), ("a", 1, "validation", 1.0), ("a", 2, "validation", 1.0),
              ("a", 3, "train", 0.1), (None, 0, "validation", 4.0), ("b", 0, "train", 1.0)]
    out = tables.full_run_summary(
        spark.createDataFrame(metrics, "run string, epoch int, metric string, value double"),
        spark.createDataFrame(losses, "run string, epoch int, split string, loss double"))
    got = {r["run"]: (r["best_epoch"], r["best_train_loss"], r["best_val_loss"], r["test_rouge1"], r["test_rouge2"], r["test_gen_len"]) for r in out.collect()}
    assert got == {"a": (1, 2.5, 1.0, 3.0, None, 7.0), None: (0, None, 4.0, None, 5.0, None)}


def test_predictions_have_nine_columns(spark):
    p = spark.createDataFrame([("1", "a b c d e", "s t"), (None, "", ""), ("1", "x", None)], "id string, document string, summary string")
    made = shorten.lead_summary(shorten.shorten_head(p, 4))
    out = tables.predictions(made, F.lit("r"), F.lit(0))
    assert out.columns == [*tables.PREDICTION_COLUMNS, "run", "epoch"]
    first = out.where("document_len > 2").first()
    assert (first["shortened_document"], first["document_len"], first["shortened_len"], first["reference_len"], first["generated_len"]) == ("a b c d", 6, 5, 3, 5)
    assert out.count() == 3


def test_parts_deal_rows_out_when_asked(spark):
    folder = scale.fresh_dir(spark, "given")
    spark.range(100).select(F.col("id").alias("doc_id")).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    assert queries.table(spark, folder, "documents").rdd.getNumPartitions() == 1
    spark.conf.set("brevis.parts", "5")
    try:
        dealt = queries.table(spark, folder, "documents")
        assert dealt.rdd.getNumPartitions() == 5 and dealt.count() == 100
    finally:
        spark.conf.unset("brevis.parts")


@pytest.mark.parametrize("name", ["stream_ranked", "stream_shorten", "stream_metrics"])
def test_streams_read_tables_of_several_files(spark, tmp_path, name):
    for t in ("documents", "events"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        rows.repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    run = queries.REGISTRY[name]
    assert run(spark, str(tmp_path)).count() == run(spark, "/root/testdata/sf0.001").count() > 0
