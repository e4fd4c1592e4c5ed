"""Building blocks that keep global orders, hot keys and side inputs distributed."""

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def lean(spark: SparkSession) -> None:
    """Arrow batches of a few MB unless the session sets their size: workers hold several batches of whole texts at a time."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Without that setting a private temporary folder serves local mode; on a cluster, whose executors
    could not see it, the job is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="brevis-"))
    return context.getCheckpointDir()


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Rows of many MB, written and read back. Their size is looked at row by row, as Parquet's writer looks
    at every hundredth row only and its readers take thousands of rows of a row group at once."""
    few = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "compression": "zstd"}
    df.write.options(**few).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate rows that nothing reads any more."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def tidy(spark: SparkSession):
    """Shuffles of the jobs inside are removed with their job, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive lost executors and are never recomputed."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def number_rows(df: DataFrame, order: list, name: str = "position", within: tuple = ()) -> DataFrame:
    """0-based row numbers in a total order without a single-task window.

    Rows are range-partitioned and sorted; each partition numbers its own rows; the partition
    sizes (one row per shuffle partition) give the offsets. The range cut is sampled, so the
    numbered rows are pinned before the sizes are read. ``order`` must end in a unique column:
    ties could otherwise pile up in one range. ``within`` restarts the count per group.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in (*within, *order)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    pinned = pin(ranged.withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright("_slot", 33)
    sizes = pinned.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = (
        pinned.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # one row per shuffle partition
        .withColumn(name, F.col("_start") + F.col("_slot").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_slot", "_start")
    )
    if not within:
        return numbered
    firsts = numbered.groupBy(*within).agg(F.min(name).alias("_first"), F.count("*").alias("_held"))
    return spread_join(numbered, firsts, list(within), held="_held", nulls=True).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def number_by_digest(df: DataFrame, digest: str, tie: str, name: str = "position") -> DataFrame:
    """0-based row numbers in the order of a uniform hex digest.

    The first four digits split the rows evenly into 65,536 buckets, so each bucket is sorted on
    its own and only the bucket sizes are summed globally. Rows without a digest come first.
    """
    bucket = F.coalesce(F.substring(digest, 1, 4), F.lit(""))
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy(digest, tie)
    return (
        df.withColumn("_bucket", bucket)
        .join(F.broadcast(starts), "_bucket")  # at most 65,536 rows
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_start")
    )


HOT_KEYS = 4096  # keys that may be broadcast; each holds more than this share of the rows


def heavy_keys(df: DataFrame, on: list, limit: int = HOT_KEYS) -> DataFrame:
    """``on`` and a count for every key that holds a ``limit``-th of the rows or more, and some that hold half of that.

    A Misra-Gries summary: each task keeps 2 * ``limit`` counters, lowering all of them when they run out, and the
    summaries are added up. A key's count is short by at most a 2 * ``limit``-th of the rows, so no heavy key is
    missed and at most 2 * ``limit`` keys come back.
    """
    most = 2 * limit
    slim = df.select(F.struct(*on).alias("k"), F.to_json(F.struct(*on), {"ignoreNullFields": "false"}).alias("name"))

    def run(batches):
        counts, sample, rows = {}, {}, 0
        for b in batches:
            rows += b.num_rows
            coded = b.column("name").dictionary_encode()
            places = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            for name, n in zip(coded.dictionary.to_pylist(), places.tolist(), strict=True):
                counts[name] = counts.get(name, 0) + n
            if len(counts) > most:
                low = sorted(counts.values())[-most - 1]
                counts = {k: n - low for k, n in counts.items() if n > low}
        names = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*names, None], pa.string()), pa.array([*counts.values(), rows], pa.int64())], ["name", "n"])

    summed = pin(slim.select("name").mapInArrow(run, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")))
    total = summed.where("name IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*on).schema)
    heavy = summed.where(F.col("name").isNotNull() & (F.col("n") * most >= total))
    return heavy.select(F.from_json("name", kinds).alias("k"), "n").select("k.*", "n")


def spread_join(
    facts: DataFrame, keyed: DataFrame, on: list, how: str = "inner", held: str | None = None, nulls: bool = False,
    limit: int = HOT_KEYS,
) -> DataFrame:
    """Equi-join of many facts with a side that has one row per key, without a hot key.

    Keys that hold a ``limit``-th of the facts are at most ``limit``: their rows of the keyed side are broadcast, and
    their facts take a salt from their own content, so they are spread over all tasks. All other facts meet the
    keyed side by a shuffle. The facts are computed once. How many facts hold a key is told by the column ``held`` of the keyed side
    (exact or an upper bound; it is dropped) or else measured by ``heavy_keys``, which reads the keys of the facts once more.
    ``nulls`` lets null keys meet each other.
    """
    values = [c for c in keyed.columns if c not in (*on, held)]
    names = {c: f"_k{i}" for i, c in enumerate(on)}
    same = (lambda a, b: a.eqNullSafe(b)) if nulls else (lambda a, b: a == b)

    def meet(left: DataFrame, right: DataFrame, extra=None) -> DataFrame:
        condition = [same(left[c], right[k]) for c, k in names.items()]
        return left.join(right, condition + ([left["_salt"] == right["_s"]] if extra else []), "left")

    if held is None:
        heavy = F.broadcast(heavy_keys(facts, on, limit).select(*[F.col(c).alias(k) for c, k in names.items()]))
        full = keyed.select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(on)], F.struct(*on, *values).alias("_v"))
        found = [same(full[f"_f{i}"], heavy[k]) for i, k in enumerate(names.values())]
        hot, cold = full.join(heavy, found, "left_semi"), full.join(heavy, found, "left_anti")
        hot, cold = (x.select("_v.*") for x in (hot, cold))
    else:
        share = F.col(held) * limit >= keyed.agg(F.coalesce(F.sum(held), F.lit(0))).scalar()
        hot, cold = keyed.where(share), keyed.where(F.coalesce(~share, F.lit(True)))
    hot = F.broadcast(hot.select(*[F.col(c).alias(k) for c, k in names.items()], F.struct(F.lit(True), *values).alias("_hot")))
    # Always 0, but no literal: the optimiser would drop a literal from the join keys, and the salts with it.
    zero = F.pmod(F.xxhash64(*on), F.lit(1).cast("long"))
    cold = cold.select(*[F.col(c).alias(k) for c, k in names.items()], F.struct(F.lit(True), *values).alias("_cold"), zero.alias("_s"))
    others = [c for c in facts.columns if c not in on] or on
    met = meet(facts, hot).drop(*names.values())
    apart = F.col("_hot").isNotNull()
    for c in () if nulls else on:  # null keys meet nothing, but must not gather in one task
        apart = apart | F.col(c).isNull()
    salted = met.withColumn("_salt", F.when(apart, F.xxhash64(*others).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    both = meet(salted, cold, True)
    if how == "inner":
        both = both.where(F.col("_hot").isNotNull() | F.col("_cold").isNotNull())
    rest = [c for c in facts.columns if c not in on]
    return both.select(*on, *rest, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in values])


def unfold(df: DataFrame, keep: list, values: Column, pos: str, value: str) -> DataFrame:
    """One row per array entry with its 0-based place.

    The inner form of posexplode makes the optimiser add size(array) > 0 below the projection,
    which evaluates a costly array (a regex pass, a Python call) a second time. The outer form
    does not; its filler rows are dropped by the place, which is a plain column.
    """
    rows = df.select(*keep, F.posexplode_outer(values).alias(pos, value))
    return rows.where(F.col(pos).isNotNull())


def values_of(df: DataFrame, keep: list, values: Column, name: str) -> DataFrame:
    """One row per non-null array entry, without the repeated evaluation described above."""
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


#: Buckets of one pass over a range of values, rows that are put in order at last, and passes at most.
BUCKETS, FEW, PASSES = 1024, 10_000, 60


def _narrowed(slim: DataFrame, state: DataFrame, by: list) -> DataFrame:
    """One pass: every open range is cut into buckets and becomes those that hold a wanted rank."""
    ranges = state.where("low < high").groupBy(*by).agg(
        F.array_distinct(F.collect_list(F.struct("low", "high", "before"))).alias("_ranges"), F.max("size").alias("_held"))
    placed = spread_join(slim, ranges, by, held="_held", nulls=True)
    mine = placed.withColumn("_r", F.get(F.filter("_ranges", lambda r: F.col("_v").between(r["low"], r["high"])), F.lit(0)))
    low, high = F.greatest(F.col("_r.low"), F.lit(-1.7e308)), F.least(F.col("_r.high"), F.lit(1.7e308))
    part = F.try_divide(F.col("_v") / 2 - low / 2, high / 2 - low / 2)
    bucket = F.when(F.col("_v") <= low, -1).when(F.col("_v") >= high, BUCKETS).otherwise(F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)))
    counted = mine.where(F.col("_r").isNotNull()).groupBy(*by, "_r", bucket.alias("_b")).agg(
        F.count("*").alias("held"), F.min("_v").alias("new_low"), F.max("_v").alias("new_high"))
    earlier = Window.partitionBy(*by, "_r").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS + 2 rows at most
    summed = counted.withColumn("new_before", F.col("_r.before") + F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    right = summed.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_r.low").alias("_low"), "held", "new_low", "new_high", "new_before")
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    inside = (F.col("low") == F.col("_low")) & F.col("rank").between(F.col("new_before"), F.col("new_before") + F.col("held") - 1)
    found = state.where("low < high").drop("held").join(right, [*same, inside])
    cut = found.select(*by, "size", "rank", F.col("new_low").alias("low"), F.col("new_high").alias("high"), F.col("new_before").alias("before"), "held")
    return cut.unionByName(state.where("low = high").select(cut.columns))


def ranked_values(df: DataFrame, value: str, ranks: DataFrame, by: tuple = ()) -> DataFrame:
    """The values that stand at wanted 0-based ranks of each group: by..., rank, value. Nothing is sorted globally.

    Every wanted rank begins with the whole range of its group. A pass counts the rows of each range in
    ``BUCKETS`` equal parts, with partial sums, and narrows the range to the part that holds the rank and to the values
    seen in it. Once a range holds one value it is found; once all hold ``FEW`` rows these are put in order. Null and NaN
    values are left out; null groups are groups.
    """
    by = list(by) or ["_all"]
    v = F.col(value).cast("double")
    named = df if by != ["_all"] else df.withColumn("_all", F.lit(0))
    wanted = ranks if by != ["_all"] else ranks.withColumn("_all", F.lit(0))
    slim = pin(named.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    sized = slim.groupBy(*by).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("size"))
    left = sized.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], "size", "low", "high", F.lit(0).cast("long").alias("before"), F.col("size").alias("held"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    state = pin(wanted.select(*by, "rank").distinct().join(left, [*same, F.col("rank") < F.col("size")]).select(
        *by, "size", "rank", "low", "high", "before", "held"))
    open_ranges = lambda s: s.where(f"low < high AND held > {FEW}")
    for _ in range(PASSES):
        if not open_ranges(state).take(1):
            break
        state = pin(_narrowed(slim, state, by))
    ranges = state.where("low < high").select(*by, "low", "high", "before", "size").distinct()
    grouped = ranges.groupBy(*by).agg(F.collect_list(F.struct("low", "high", "before")).alias("_ranges"), F.max("size").alias("_held"))
    mine = spread_join(slim, grouped, by, held="_held", nulls=True).withColumn(
        "_r", F.get(F.filter("_ranges", lambda r: F.col("_v").between(r["low"], r["high"])), F.lit(0))).where(F.col("_r").isNotNull())
    order = Window.partitionBy(*by, "_r").orderBy("_v")
    placed = mine.select(*by, "_v", (F.col("_r.before") + F.row_number().over(order) - 1).alias("rank"))
    right = placed.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("rank").alias("_rank"), F.col("_v").alias("value"))
    rest = state.where("low < high").select(*by, "rank")
    at = rest.join(right, [*same, F.col("rank") == F.col("_rank")]).select(*by, "rank", "value")
    out = at.unionByName(state.where("low = high").select(*by, "rank", F.col("low").alias("value")))
    return out.drop("_all") if by == ["_all"] else out


def exact_quantiles(df: DataFrame, value: str, tie: str, probs: dict, by: tuple = ()) -> DataFrame:
    """Exact interpolated quantiles as columns, by selection (``ranked_values``) instead of a sort; ``tie`` is not needed.

    A quantile between two ranks is their weighted mean. Null groups are groups; null and NaN values are left out.
    """
    by = list(by)
    real = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sized = real.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 0")
    place = F.col("col.p") * (F.col("_n") - 1)
    spots = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(float(p)).alias("p")) for n, p in probs.items()]))
    wanted = sized.select(*by, spots, "_n").select(
        *by, "col.label", F.floor(place).alias("_low"), (place - F.floor(place)).alias("_part"))
    ends = F.array(
        F.struct(F.col("_low").alias("rank"), (1 - F.col("_part")).alias("w")), F.struct((F.col("_low") + 1).alias("rank"), F.col("_part").alias("w")))
    weighed = pin(wanted.select(*by, "label", F.explode(ends).alias("s")).select(*by, "label", "s.rank", "s.w").where("w > 0"))
    found = ranked_values(real, value, weighed.select(*by, "rank"), tuple(by))
    right = found.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("rank").alias("_rank"), "value")
    hits = weighed.join(right, [F.col("rank") == F.col("_rank"), *[F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]])
    return hits.groupBy(*by).agg(*[F.sum(F.when(F.col("label") == n, F.col("value") * F.col("w"))).alias(n) for n in probs])
