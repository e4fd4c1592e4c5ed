"""Length statistics, histograms, quantile tails."""

from pyspark.sql import DataFrame, functions as F

from brevis.functions.scale import exact_quantiles, spread_join, values_of


def split_counts(before: DataFrame, low: int = 485, high: int = 512, target: int = 36) -> DataFrame:
    inside = F.col("doc_len").between(low, high) & (F.col("sum_len") <= target)
    return before.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_if(inside).alias("n_kept"))


def length_summary(df: DataFrame, limit: int = 512) -> DataFrame:
    """Mean, min, max and share below the limit per split; split null = all splits."""
    return df.rollup("split").agg(
        F.count("*").alias("n_rows"),
        F.avg("doc_len").alias("mean_len"),
        F.min("doc_len").alias("min_len"),
        F.max("doc_len").alias("max_len"),
        (F.count_if(F.col("doc_len") < limit) / F.count("*")).alias("share_below"),
    )


def union_lengths(*frames: DataFrame) -> DataFrame:
    merged = frames[0].select("id", "doc_len")
    for df in frames[1:]:
        merged = merged.unionByName(df.select("id", "doc_len"))
    return merged


def length_hist(df: DataFrame, column: str, bins: int, by: tuple = (), low=None, high=None) -> DataFrame:
    """Equal-width histogram, last bin closed, empty bins included; range from the data if not given.

    Rows are counted per bin before anything else moves, so only by-groups x bins rows are joined.
    """
    value = F.col(column).cast("double")
    data = df.where(value.isNotNull())
    if low is None or high is None:
        limits = data.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_held"))
        ranged = spread_join(data.select(*by, value.alias("_v")), limits, list(by), held="_held", nulls=True) if by else (
            data.select(value.alias("_v"))
            .withColumn("_low", limits.select("_low").scalar())
            .withColumn("_high", limits.select("_high").scalar())
        )
    else:
        ranged = data.select(*by, value.alias("_v")).withColumns({"_low": F.lit(float(low)), "_high": F.lit(float(high))})
        ranged = ranged.where(F.col("_v").between(F.col("_low"), F.col("_high")))
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(bins - 1))).otherwise(0)
    counted = ranged.groupBy(*by, "_low", "_high", place.cast("int").alias("bin")).agg(F.count("*").alias("n_rows"))
    groups = counted.select(*by, "_low", "_high").distinct()
    frame = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    own = counted.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("bin").alias("_bin"), "n_rows")
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    filled = frame.join(own, [*same, F.col("bin") == F.col("_bin")], "left")
    step = (F.col("_high") - F.col("_low")) / bins
    return filled.select(
        *by, "bin", (F.col("_low") + F.col("bin") * step).alias("bin_start"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def score_quantiles(df: DataFrame, value: str, tie: str = "id", by: tuple = ()) -> DataFrame:
    """min, 10 %, 50 %, 90 %, max with linear interpolation, exact at any size."""
    inner = exact_quantiles(df, value, tie, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, by)
    ends = df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    if by:
        named = inner.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(by)})
        same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
        return ends.join(named, same).drop(*[f"_g{i}" for i in range(len(by))])
    # Two one-row frames: each value enters as a scalar.
    for name in ("p10", "p50", "p90"):
        ends = ends.withColumn(name, inner.select(name).scalar())
    return ends


def quantile_tails(df: DataFrame, value: str, tie: str = "id") -> DataFrame:
    """Rows at or below the 10 % quantile (bad) and at or above the 90 % quantile (good)."""
    cuts = exact_quantiles(df, value, tie, {"p10": 0.1, "p90": 0.9})
    low, high = cuts.select("p10").scalar(), cuts.select("p90").scalar()
    sides = F.array_compact(F.array(
        F.when(F.col(value) <= low, F.lit("bad")), F.when(F.col(value) >= high, F.lit("good"))
    ))
    return values_of(df, df.columns, sides, "tail")


def tail_profile(tails: DataFrame, lengths: DataFrame) -> DataFrame:
    """Count and mean length per tail."""
    return tails.join(lengths, "id").groupBy("tail").agg(
        F.count("*").alias("n_rows"), F.avg("length").alias("mean_length"),
        F.min("length").alias("min_length"), F.max("length").alias("max_length"),
    )
