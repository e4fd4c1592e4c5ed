"""Shortened corpora on disk: every document once, every variant a column."""

from pyspark.sql import functions as F

from brevis.functions import scale
from brevis.operators import shorten
from brevis.sources import tables

ROWS = [("1", "a b\nc  d e f g", "s", "train"), (None, "a b", "s", "train"), ("1", "", None, "test"), ("2", None, "x", "test")]


def test_round_trip_without_copies_of_documents(spark):
    df = spark.createDataFrame(ROWS, "id string, document string, summary string, split string").withColumn("document_len", F.lit(3))
    budgets = {"25": 3, "35": 5}
    made = df.withColumn("_toks", shorten.spaced(F.col("document")))
    path = scale.fresh_dir(spark, "shortened")
    tables.write_shortened(made, path, shorten.token_cuts(F.col("_toks"), budgets))
    assert spark.read.parquet(path).count() == len(ROWS)  # rows are not multiplied
    columns = ["id", "document", "summary", "split", "method", "quantity", "shortened_document", "shortened_len"]
    order = lambda rows: sorted(map(repr, (tuple(r) for r in rows)))
    want = shorten.token_grid(df, budgets).select(columns).collect()
    assert order(tables.read_shortened(spark, path).select(columns).collect()) == order(want)
    one = tables.read_shortened(spark, path, "tail", "35", "train").select(columns).collect()
    assert order(one) == order(r for r in want if (r["method"], r["quantity"], r["split"]) == ("tail", "35", "train"))
    assert tables.read_shortened(spark, path, "luhn").count() == 0


def test_runs_with_other_variants_share_a_folder(spark):
    df = spark.createDataFrame(ROWS, "id string, document string, summary string, split string").withColumn("document_len", F.lit(3))
    made = df.withColumn("_toks", shorten.spaced(F.col("document")))
    path = scale.fresh_dir(spark, "shortened")
    for budgets in ({"25": 3}, {"35": 5}):
        tables.write_shortened(made, path, shorten.token_cuts(F.col("_toks"), budgets, ("head",)))
    back = tables.read_shortened(spark, path)
    assert {r["quantity"]: r["count"] for r in back.groupBy("quantity").count().collect()} == {"25": len(ROWS), "35": len(ROWS)}
