"""Reading corpora into the canonical pair table, and the derived pair bindings."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brevis import constants as K
from brevis.functions import text as T

# Corpus name -> (document column, summary column).
CORPUS_COLUMNS = {
    "cnn_dailymail": ("article", "highlights"),
    "xsum": ("document", "summary"),
}


def load_pairs(df: DataFrame, corpus: str = "xsum", id_col: str = "id") -> DataFrame:
    """Map a known corpus's columns to id, document, summary; carry every other column along."""
    if corpus not in CORPUS_COLUMNS:
        raise ValueError(f"unknown corpus {corpus!r}; known: {sorted(CORPUS_COLUMNS)}")
    document, summary = CORPUS_COLUMNS[corpus]
    taken = {document, summary, id_col, "document", "summary", "id"}
    rest = [F.col(c) for c in df.columns if c not in taken]
    return df.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(document).alias("document"),
        F.col(summary).alias("summary"),
        *rest,
    )


def read_corpus(spark: SparkSession, path: str, corpus: str = "xsum", fmt: str = "parquet", **options) -> DataFrame:
    return load_pairs(spark.read.format(fmt).options(**options).load(path), corpus)


def split_name(key: Column) -> Column:
    """One tenth validation, one tenth test, the rest train; fixed by the id alone."""
    tenth = F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") % 10
    return F.when(tenth == 0, "validation").when(tenth == 1, "test").otherwise("train")


def split_assign(df: DataFrame) -> DataFrame:
    return df.withColumn("split", split_name(F.col("id")))


def pairs_from_texts(df: DataFrame, id_col: str, text_col: str, keep: tuple = ()) -> DataFrame:
    """First sentence as summary, the remaining raw text as document; ``keep`` columns are carried along."""
    # Two independent single-pass expressions: a filter on one of them repeats no other.
    return df.select(
        F.col(id_col).cast("string").alias("id"),
        F.trim(F.regexp_replace(text_col, r"^[.!?\n]*" + K.SENTENCE, "")).alias("document"),
        F.trim(F.regexp_extract(text_col, K.SENTENCE, 0)).alias("summary"),
        *keep,
    )


def replies(df: DataFrame) -> DataFrame:
    """User turns as references and the assistant turns right after them as hypotheses.

    Turns are consecutive numbers, so this is an equi-join on (conversation, turn), which a very
    long conversation cannot skew as a per-conversation window would.
    """
    asked = df.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("reference"))
    said = df.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis")
    )
    return asked.join(said, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "reference", "hypothesis"
    )


def run_log(df: DataFrame) -> DataFrame:
    """Event rows as a metric log: type = run, day = epoch, user = sample, value = metric."""
    return df.select(
        F.col("event_type").alias("run"),
        F.dayofmonth("ts").alias("epoch"),
        F.col("user_id").cast("string").alias("sample"),
        F.col("value"),
        F.col("event_id"),
    )


def vectors_for_tokens(n_vectors: Column, token: Column) -> Column:
    """The vector number a token is bound to when no trained vocabulary is supplied."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % n_vectors).alias("vec_id")


def add_lengths(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_len", T.token_count(F.col("document")).cast("int")).withColumn(
        "sum_len", T.token_count(F.col("summary")).cast("int")
    )
