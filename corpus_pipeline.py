"""The corpus pipeline: drop toxic documents, near copies and benchmark passages, redact secrets, encode to token ids.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows as Parquet into the shared folder and
reads them back as the next one's ``docs``. Rows with null texts or keys are never toxic, near
copies or contaminated; they stay. Columns beyond those of ``documents`` are carried along, whatever their names.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from brevis.llm import bpe_words, lsh_forest, secrets, toxic_ssk, winnow
from brevis.llm.common import remainder, store, table, tokenizer_file


def _plain(docs: DataFrame) -> tuple:
    """``docs`` with neutral column names, and the neutral name of each of its columns."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*plain), dict(zip(docs.columns, plain, strict=True))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose strongest sentence the classifier calls toxic go. Labels are learnt from four fifths of the keys."""
    model = toxic_ssk.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    rows, names = _plain(docs)
    scored = toxic_ssk.apply(rows, model, list(names.values()), names["text"])
    return scored.where("score < 0.5").drop("score").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest key stays.

    Rows are judged by key and text: of the texts of a repeated key only those that are near copies go. Rows that
    repeat a key with the same text are copies as well, and one of them stays.
    """
    rows, names = _plain(docs)
    key, text = names["doc_id"], names["text"]
    sign = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    own = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("id"), sign.alias("sign")))
    rows = rows.withColumn("own", own)
    judged = store(lsh_forest.near_duplicates(rows.select("own", text), "own", text, words=5, percent=80).select("key", "kept"), "near")
    gone = judged.where("NOT kept").select("key").distinct()
    stay = rows.join(gone, rows["own"] == gone["key"], "left_anti")
    again = store(judged.where("kept AND key IS NOT NULL").groupBy("key").count().where("count > 1").select("key"), "repeated")
    if again.take(1):
        single = stay.join(again, stay["own"] == again["key"], "left_anti")
        stay = single.unionByName(stay.join(again, stay["own"] == again["key"], "left_semi").dropDuplicates([key, text]))
    return stay.drop("own").toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are words of benchmark windows go."""
    rows, names = _plain(docs)
    judged = winnow.judge(docs, table(spark, sf_dir, "benchmark"))
    hit = judged.where(winnow.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("key").alias("k"), F.col("sign").alias("s")).distinct()
    signed = rows.withColumn("sign", winnow.sign_of(F.col(names["text"])))
    stay = signed.join(hit, signed[names["doc_id"]].eqNullSafe(hit["k"]) & (signed["sign"] == hit["s"]), "left_anti")
    return stay.drop("sign").toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span is replaced by its kind in brackets; ``n_chars`` follows the new text. No document goes."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit), their digests, and whether decoding gives the text back."""
    file = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    named = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    coded = bpe_words.encode(named, file, ["doc_id", "text_sha256"], scanned=True)  # docs come straight from files
    keep = coded.select("doc_id", "text_sha256", F.col("ids").alias("own"), "ids")
    back = bpe_words.decode(keep, bpe_words.token_table(spark, file), ["doc_id", "text_sha256", "own"])
    decoded = F.sha2("decoded", 256)
    return back.select(
        "doc_id", (F.length("own") / 4).cast("long").alias("n_tokens"), F.sha2("own", 256).alias("ids_sha256"),
        decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("intact"), F.col("own").alias("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("token_ids", encode_tokens),
]

#: Training, MinHash and merges are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
