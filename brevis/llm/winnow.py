"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words of documents and of benchmark items are hashed, ``GRAM`` words to a k-gram, and of every
window of consecutive k-grams that makes up ``SPAN`` words the smallest hash is kept. Two texts that share a
span of ``SPAN`` words or more therefore share a kept hash; documents and items are joined on those
fingerprints. Every hit is then extended to all the windows of the document that selected it, and these are
compared word by word with the item's windows, so the outcome is exact.

Items shorter than ``SPAN`` words are windows of their own: for each length that occurs among the items
(fewer than ``SPAN`` lengths), all runs of so many words are fingerprints.

The corpus is read once. Only fingerprints that the benchmark holds get past the first join, and one
marker row per document; the benchmark side is broadcast only if its counted rows stay under
``BROADCAST_ROWS``, else both sides are shuffled by fingerprint.

Null texts have no words; null item ids and items without words are left out. Items with one text
count each. Rows that repeat (same key, same text) are judged alike and returned as often as they came; keys
may be null. An empty benchmark leaves every document clean. Extra columns are ignored.
"""

from pyspark.sql import Column, DataFrame, functions as F

from brevis.llm.common import folded, store

SPAN = 13
GRAM = 5
BROADCAST_ROWS = 1_000_000
#: Fixed value: what separates words once A-Z is lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a lower-cased text; none for null."""
    plain = F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), GAPS, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def sign_of(text: Column) -> Column:
    """Hash by which rows of one key are told apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def _grams(hashed: str, size: int) -> Column:
    """64-bit hash of each run of ``size`` words, from the words' own hashes."""
    parts = ", ".join(["x", *[f"get({hashed}, i + {k})" for k in range(1, size)]])
    return F.expr(f"slice(transform({hashed}, (x, i) -> xxhash64({parts})), 1, greatest(size({hashed}) - {size - 1}, 0))")


def _smallest(grams: str, reach: int) -> Column:
    """Minimum of each ``reach`` consecutive grams; windows that do not fit are left out."""
    return F.expr(
        f"transform(sequence(1, greatest(size({grams}) - {reach - 1}, 1)), i -> array_min(slice({grams}, i, {reach})))")


def item_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """item, span, fingerprint and words of every window of the benchmark, each once.

    The steps are stored one by one, as a lambda would otherwise evaluate the step below it once per entry.
    """
    named = benchmark.select(F.col(item).alias("item"), words_of(F.col(text)).alias("words")).where(
        F.col("item").isNotNull() & (F.size("words") > 0))
    hashed = store(named.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w))), "items").withColumn("n", F.size("words"))
    short = sorted(r["n"] for r in hashed.where(F.col("n") < SPAN).select("n").distinct().collect())  # at most SPAN - 1 lengths
    grams = hashed.where(F.col("n") >= SPAN).select("item", "words", F.lit(SPAN).alias("span"), _grams("_h", GRAM).alias("_g"))
    parts = [store(grams, "grams").withColumn("_g", _smallest("_g", SPAN - GRAM + 1))]
    parts += [hashed.where(F.col("n") == n).select("item", "words", F.lit(n).alias("span"), _grams("_h", n).alias("_g")) for n in short]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    opened = store(every, "items").select("item", "span", "words", F.posexplode("_g").alias("at", "_p"))
    return opened.select(
        "item", "span", F.xxhash64("_p", "span").alias("print"),
        F.array_join(F.slice("words", F.col("at") + 1, F.col("span")), " ").alias("window")).distinct()


def _marked(docs: DataFrame, key: str, text: str, short: list) -> DataFrame:
    """One row per fingerprint of a document, and one marker row with its number of words."""
    rows = docs.select(
        F.col(key).alias("key"), sign_of(F.col(text)).alias("sign"),
        words_of(F.col(text)).alias("words"),
    )
    rows = rows.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_g", _grams("_h", GRAM)).withColumn("_m", _smallest("_g", SPAN - GRAM + 1))
    rows = rows.withColumn("_s", F.expr(  # where another gram becomes the smallest
        f"CASE WHEN size(words) >= {SPAN} THEN filter(sequence(0, size(_m) - 1), i -> i = 0 OR get(_m, i) != get(_m, i - 1)) ELSE array() END"))
    # A run of windows lasts until the next one starts; its words reach SPAN - 1 words further.
    last = f"coalesce(get(_s, k + 1), size(words) - {SPAN - 1})"
    runs = F.expr(
        f"transform(_s, (s, k) -> struct(xxhash64(get(_m, s), {SPAN}) AS print, s AS at, {SPAN} AS span, "
        f"array_join(slice(words, s + 1, {last} - s + {SPAN - 1}), ' ') AS around))")
    lists = [F.expr(
        "array(struct(cast(null AS bigint) AS print, -1 AS at, 0 AS span, cast(size(words) AS string) AS around))"), runs]
    for span in short:
        rows = rows.withColumn(f"_g{span}", _grams("_h", span))
        lists.append(F.expr(
            f"transform(_g{span}, (g, i) -> struct(xxhash64(g, {span}) AS print, i AS at, {span} AS span, "
            f"array_join(slice(words, i + 1, {span}), ' ') AS around))"))
    return rows.select("key", "sign", F.explode(F.concat(*lists)).alias("c")).select("key", "sign", "c.*")


def judge(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """key, sign (hash of the text), n_words, n_hit, items (sorted strings) per row of ``docs``."""
    windows = store(item_windows(benchmark, item, item_text), "benchmark")
    small = windows.count() <= BROADCAST_ROWS
    sized = F.broadcast if small else (lambda df: df)
    short = sorted(r["span"] for r in windows.select("span").distinct().collect() if r["span"] < SPAN)
    prints = windows.select(F.col("print").alias("known")).distinct()
    rows = _marked(docs, key, text, short)
    met = rows.join(sized(prints), rows["print"] == prints["known"], "left").where(
        F.col("known").isNotNull() | (F.col("span") == 0))
    # Extend: every window of the run, word by word.
    opened = met.withColumn("_w", F.when(F.col("span") > 0, F.split("around", " "))).select(
        "key", "sign", "print", "span", F.when(F.col("span") == 0, F.col("around")).alias("size"), F.explode(F.expr(
            "CASE WHEN span = 0 THEN array(struct(-1 AS at, cast(null AS string) AS window)) ELSE "
            "transform(sequence(0, size(_w) - span), i -> struct(at + i AS at, array_join(slice(_w, i + 1, span), ' ') AS window)) END"
        )).alias("o")).select("key", "sign", "print", "span", "size", "o.*")
    named = windows.select(F.col("window").alias("w_window"), F.col("span").alias("w_span"), "item")
    per_window = named.groupBy("w_window", "w_span").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = opened.join(sized(per_window), (opened["window"] == F.col("w_window")) & (opened["span"] == F.col("w_span")), "left").where(
        F.col("items").isNotNull() | (F.col("span") == 0))
    grouped = hits.groupBy("key", "sign").agg(
        F.sum((F.col("span") == 0).cast("int")).alias("copies"),
        F.max(F.col("size").cast("long")).alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("span") > 0, F.struct("at", (F.col("at") + F.col("span")).alias("end"))))).alias("spans"),
        F.collect_set("items").alias("_sets"),  # distinct item lists of one document's windows
    )
    covered = F.expr(
        "aggregate(spans, struct(0 AS n, 0 AS upto), (a, s) -> struct(a.n + greatest(s.end - greatest(s.at, a.upto), 0) AS n, "
        "greatest(a.upto, s.end) AS upto), a -> cast(a.n AS bigint))")
    items = F.array_sort(F.array_distinct(F.transform(F.flatten("_sets"), lambda i: i.cast("string"))))
    out = grouped.select("key", "sign", "copies", "n_words", covered.alias("n_hit"), items.alias("items"))
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).drop("copies", "_")


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """Hit words make up a ``share``-th of the document or more."""
    return (n_hit > 0) & (share * n_hit >= n_words)
