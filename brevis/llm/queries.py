"""The numbered queries: each applies its operator to the whole of its table, with production parameters."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from brevis.llm import (
    bitplanes, bpe_words, chunk_recipes, debruijn, filter_audit, lsh_forest, multi_index, quality_qda, secrets, segment_resample,
    toxic_ssk, url_cascade, winnow,
)
from brevis.llm.common import Query, remainder, store, table, tokenizer_file

QUERIES: dict[str, Query] = {}

#: Host, path, verdict.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxic_ssk(spark: SparkSession, sf: str) -> DataFrame:
    held = remainder(F.col("doc_id"), 5) == 0
    docs = table(spark, sf, "documents")
    model = toxic_ssk.train(docs, table(spark, sf, "labels"), ~held)
    named = docs.select("doc_id", held.alias("held_out"), "text")
    scored = toxic_ssk.apply(named, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op2_url_cascade(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_cascade.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query
def op3_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    judged = winnow.judge(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return judged.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        winnow.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query
def op4_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    coded = store(multi_index.codes(table(spark, sf, "embeddings"), "vec_id", "embedding"), "vectors")
    found = multi_index.search(coded, coded.where("id % 100 = 0"), 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


@query
def op5_bit_planes(spark: SparkSession, sf: str) -> DataFrame:
    read = bitplanes.round_trip(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


@query
def op6_word_bpe(spark: SparkSession, sf: str) -> DataFrame:
    file = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe_words.encode(docs, file, ["doc_id"], scanned=True).select(
        "doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    back = bpe_words.decode(coded, bpe_words.token_table(spark, file), ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_de_bruijn(spark: SparkSession, sf: str) -> DataFrame:
    kept = debruijn.remove(table(spark, sf, "documents"), digest=True)
    return kept.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


@query
def op8_quality_qda(spark: SparkSession, sf: str) -> DataFrame:
    held = remainder(F.col("doc_id"), 4) == 2
    scored = quality_qda.classify(
        table(spark, sf, "documents"), table(spark, sf, "labels"), ~held, extra={"held_out": held})
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op9_lsh_forest(spark: SparkSession, sf: str) -> DataFrame:
    judged = lsh_forest.near_duplicates(table(spark, sf, "documents"), words=3, percent=85)
    return judged.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


@query
def op10_secret_ownership(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.find(table(spark, sf, "documents"))
    # Of one parameter only: Spark hands a second one the place in the array.
    held = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(held(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


@query
def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op12_segment_resample(spark: SparkSession, sf: str) -> DataFrame:
    drawn = segment_resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


@query
def op13_chunk_recipes(spark: SparkSession, sf: str) -> DataFrame:
    judged = chunk_recipes.judge(table(spark, sf, "documents"))
    return judged.select(
        F.col("key").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
