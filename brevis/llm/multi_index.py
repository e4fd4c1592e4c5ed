"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code has a bit per dimension: whether the value lies above that dimension's mean. Codes are cut into
``SEGMENTS`` segments, each an index of its own. A query first asks every index for its exact segment, then for
all segment values one bit away, two bits away, and so on. After radius r every code that is still unseen differs in
more than r bits of each segment, hence in at least ``SEGMENTS * (r + 1)`` bits; a query is done as soon as its k-th verified
distance is below that, and later rounds only carry the queries that are not.

Rows with equal codes share one index entry with their ``k + 1`` smallest ids (more cannot be among the answers), and
queries with equal codes one search. Candidates are cut to the best ``k + 1`` per query before they are shuffled (times the
most codes that an id has, where ids repeat), and a code is verified once per query, in the first round and segment that meets it.

Ties of distance go to the smaller id. A row is no answer to itself. Rows whose vector is null, has a null or
not-a-number value or another length are neither indexed nor asked; null ids are left out. A repeated id
is asked once and answers once, with the least distance of its vectors. If fewer than k rows exist, all are returned. Extra columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from brevis.llm.common import store

BITS = 64
SEGMENTS = 4
_WIDTH = BITS // SEGMENTS


def codes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, code of every row with a whole vector."""
    whole = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") == BITS) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    means = whole.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(BITS)]).first()  # one row of BITS means
    if means["m0"] is None:
        return whole.select("id", F.lit(0).cast("long").alias("code"))
    centre = ", ".join(f"{m!r}D" for m in means)
    bits = F.expr(f"transform(v, (x, i) -> CASE WHEN x > get(array({centre}), i) THEN shiftleft(1L, i) ELSE 0L END)")
    return whole.select("id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("code"))


def _segment(code: Column, s: int) -> Column:
    return F.shiftright(code, s * _WIDTH).bitwiseAND((1 << _WIDTH) - 1).cast("int")


def _segments(code: Column) -> Column:
    return F.array(*[_segment(code, s) for s in range(SEGMENTS)])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest per query; the limit applies in every task before the shuffle."""
    order = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k nearest rows of ``index`` (id, code) to each of ``queries`` (id, code)."""
    index, queries = index.select("id", "code").distinct(), queries.select("id", "code").distinct()
    copies = index.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    most = (k + 1) * copies  # rows that hold k + 1 ids in any case
    few = Window.partitionBy("code").orderBy("id")
    members = index.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= k + 1)
    entries = store(members.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    by_segment = store(entries.select("code", "ids", F.posexplode(_segments(F.col("code"))).alias("seg", "part")), "segments")
    asked = store(queries.select(F.col("code").alias("query")).distinct(), "queries")
    active, best = asked, None
    for radius in range(_WIDTH + 1):
        flips = F.expr(f"filter(sequence(0, {(1 << _WIDTH) - 1}), x -> bit_count(x) = {radius})")  # a constant
        probes = active.select("query", F.posexplode(_segments(F.col("query"))).alias("seg", "own")).select(
            "query", "seg", F.explode(flips).alias("_flip"), "own").select(
            "query", "seg", F.col("own").bitwiseXOR(F.col("_flip")).alias("part"))
        # Probes multiply below the join, which size estimates do not see: they must not be broadcast.
        met = probes.hint("merge").join(by_segment, ["seg", "part"])
        # Seen before: some segment is nearer, or an earlier one is as near.
        apart = [F.bit_count(_segment(F.col("query").bitwiseXOR(F.col("code")), s)) for s in range(SEGMENTS)]
        new = ~F.lit(False)
        for s, d in enumerate(apart):
            new = new & ((d > radius) | ((F.col("seg") <= s) & (d == radius)))
        found = met.where(new).select(
            "query", F.explode("ids").alias("id"), F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance"))
        found = found if best is None else found.unionByName(best)
        best = store(_best(found, most), "best")
        proved = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where(
            (F.col("n") >= most) & (F.col("far") < SEGMENTS * (radius + 1)))
        active = store(active.join(proved, "query", "left_anti"), "active")
        if not active.take(1):
            break
    own = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    answers = own.join(best, "query").where("id <> query_id").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "distance")
