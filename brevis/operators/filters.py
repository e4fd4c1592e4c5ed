"""Row filters, sampling orders and key lookups."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from brevis import constants as K
from brevis.functions import text as T
from brevis.functions.scale import number_by_digest, number_rows, unfold, values_of

METHODS = (
    "full", "head", "tail", "headtail0.2", "headtail0.5", "stopwords", "stopwords_neg",
    "luhn", "textrank", "lsa", "centroid",
)


def ws_normalize(df: DataFrame, column: str = "document") -> DataFrame:
    return df.withColumn(column, T.squash(F.col(column)))


def add_prefix(df: DataFrame, column: str = "document", needed: bool = True) -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(K.PREFIX), F.col(column))) if needed else df


def strip_prefix(df: DataFrame, column: str = "document") -> DataFrame:
    return df.withColumn(column, F.substring(F.col(column), len(K.PREFIX) + 1, 2**31 - 1))


def band_floor(source_class: int) -> int:
    """Lower edge of a length class: 95 % of it (one token less for the 512 class)."""
    if source_class not in K.SOURCE_CLASSES:
        raise ValueError(f"length class must be one of {K.SOURCE_CLASSES}, got {source_class}")
    share = 95 * source_class
    return (share - 100) // 100 if source_class == 512 else share // 100


def length_band(df: DataFrame, low: int | None = None, high: int | None = 512, target: int = K.TARGET_LIMIT) -> DataFrame:
    """Rows whose doc_len lies in [low, high] and sum_len within the target; no ``high``, no filter."""
    if high is None:
        return df
    low = band_floor(high) if low is None else low
    # SQL BETWEEN evaluates its operand once even where doc_len is an expression, not a stored column.
    return df.where(F.expr(f"doc_len BETWEEN {low} AND {high} AND sum_len <= {target}"))


def band_violations(df: DataFrame, low: int = 485, high: int = 512, target: int = K.TARGET_LIMIT) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(~F.col("doc_len").between(low, high)).alias("bad_source"),
        F.count_if(F.col("sum_len") > target).alias("bad_target"),
    )


def check_params(method: str, quantity: str, budget: int | None) -> None:
    """Driver-side parameter check."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {METHODS}")
    if str(quantity) not in K.QUANTITY_BUDGET:
        raise ValueError(f"unknown quantity {quantity!r}; known: {sorted(K.QUANTITY_BUDGET)}")
    if K.QUANTITY_BUDGET[str(quantity)] != budget:
        raise ValueError(f"quantity {quantity} implies budget {K.QUANTITY_BUDGET[str(quantity)]}, got {budget}")


def budget_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.QUANTITY_BUDGET.items()), "quantity string, budget int")


def validate_params(df: DataFrame) -> DataFrame:
    """Rows whose (quantity, budget) contradict the six-row budget table."""
    table = budget_table(df.sparkSession).withColumnRenamed("budget", "implied").withColumn("_known", F.lit(True))
    return (
        df.join(F.broadcast(table), "quantity", "left")  # fixed six rows
        .where(F.col("_known").isNull() | ~F.col("budget").eqNullSafe(F.col("implied")))
        .drop("implied", "_known")
    )


def shuffle_seeded(df: DataFrame, seed: int = 42, name: str = "position") -> DataFrame:
    """A seeded permutation that no partitioning can change: positions in md5(seed, id) order."""
    # A null id has no digest; it comes first and keeps its row.
    keyed = df.withColumn("_digest", F.md5(F.concat(F.lit(str(seed)), F.col("id"))))
    return number_by_digest(keyed, "_digest", "id", name).drop("_digest")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by id (a row cap asked for by the caller)."""
    return df.orderBy("id").limit(n)


def first_fraction(df: DataFrame, parts: int = 6) -> DataFrame:
    """The first 1/parts of the rows by id."""
    placed = number_rows(df.select("id"), ["id"], "_place")
    share = placed.agg(F.floor(F.count("*") / parts)).scalar()
    return df.join(placed.where(F.col("_place") < share).select("id"), "id", "left_semi")


MASK_INLINE_LIMIT = 2000


def mask_words(df: DataFrame, mask: DataFrame, column: str = "document") -> DataFrame:
    """Drop the whitespace tokens found in a mask list; a null text stays null, null entries of the list mean nothing.

    A list of up to MASK_INLINE_LIMIT terms becomes a hashed IN over each row's own token array, so
    nothing is shuffled. A longer list is anti-joined with the exploded tokens, and gives the same rows.
    """
    terms = mask.select("term").where(F.col("term").isNotNull()).distinct()
    listed = [r[0] for r in terms.take(MASK_INLINE_LIMIT + 1)]
    toks = T.tokens(F.col(column))
    if len(listed) <= MASK_INLINE_LIMIT:
        return df.withColumn(column, F.array_join(F.filter(toks, lambda t: ~t.isin(listed)), " "))
    # A row is known by its id and the hash of its text, so null and repeated ids keep their rows.
    signed = df.withColumn("_sign", F.xxhash64(F.col(column)))
    exploded = unfold(signed, ["id", "_sign"], toks, "_pos", "term")
    kept = exploded.join(terms, "term", "left_anti")
    texts = kept.groupBy(F.col("id").alias("_id"), F.col("_sign").alias("_s")).agg(
        F.sort_array(F.collect_set(F.struct("_pos", "term"))).alias("_kept"))
    words = F.transform(F.coalesce("_kept", F.array().cast("array<struct<_pos:int,term:string>>")), lambda x: x["term"])
    met = signed.join(texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_sign") == F.col("_s")), "left")
    return met.withColumn(column, F.when(F.col(column).isNotNull(), F.array_join(words, " "))).select(*df.columns)


def blacklist_filter(df: DataFrame, entries: tuple, column: str = "headline") -> DataFrame:
    """Drop rows whose text equals a listed string; a null text equals none."""
    return df.where(~F.coalesce(F.col(column).isin(list(entries)), F.lit(False)))


def keyword_topics(df: DataFrame, column: str, patterns: dict = K.TOPIC_PATTERNS) -> DataFrame:
    """One row per (row, matching topic); a row may match several topics or none."""
    lowered = F.lower(F.col(column))
    hits = F.array_compact(F.array(*[F.when(lowered.rlike(p), F.lit(n)) for n, p in patterns.items()]))
    return values_of(df, df.columns, hits, "topic")


def topic_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("topic").agg(F.count("*").alias("n_rows"))


def semi_by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose numeric id is in a list of integers."""
    wanted = ids.select(F.col(ids.columns[0]).cast("long").alias("_wanted")).distinct()
    return df.join(wanted, F.col(key).cast("long") == F.col("_wanted"), "left_semi")


def select_by_index(df: DataFrame, positions: DataFrame, index: str = "index") -> DataFrame:
    return df.join(positions.select(index), index, "left_semi")


def lookup_lengths(ids: DataFrame, profile: DataFrame) -> DataFrame:
    """The length of each id; an id with no or several profile rows fails the job."""
    per_id = profile.groupBy("id").agg(F.count("*").alias("_n"), F.first("doc_len").alias("length"))
    joined = ids.join(per_id, "id", "left")
    checked = F.when(F.col("_n") == 1, F.col("length")).otherwise(
        F.raise_error(F.concat(F.lit("expected exactly one length for id "), F.col("id"))).cast("int")
    )
    return joined.withColumn("length", checked).drop("_n")
