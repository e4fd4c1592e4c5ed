"""Overlap scores between reference and hypothesis texts (F1 on a 0..100 scale).

Input everywhere: id, reference, hypothesis. Rows with a null text are dropped.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType

from brevis.functions import text as T
from brevis.functions.scale import exact_quantiles
from brevis.operators.tokens import stemmed_lines, stems


def usable(df: DataFrame) -> DataFrame:
    """Rows with both texts. Stored columns prune at the scan; the filter is cheap on them."""
    return df.where(F.col("reference").isNotNull() & F.col("hypothesis").isNotNull())


def _tokens(text: Column, stem: bool) -> Column:
    return stems(T.rouge_tokens(text)) if stem else T.rouge_tokens(text)


def _sides(df: DataFrame, stem: bool, keep: tuple = ()) -> DataFrame:
    """Token arrays of both texts; stemming happens inside the row."""
    return usable(df).select(
        "id", *keep, _tokens(F.col("reference"), stem).alias("ref"), _tokens(F.col("hypothesis"), stem).alias("hyp"))


def _order_n(ref: Column, hyp: Column, n: int) -> Column:
    return T.let(T.ngrams(ref, n), lambda r: T.let(T.ngrams(hyp, n), lambda h: T.f1(T.overlap(r, h), F.size(h), F.size(r))))


def rouge_n(df: DataFrame, orders=(1, 2), stem: bool = False, keep: tuple = ()) -> DataFrame:
    """id plus rouge<n> for every n asked for; a row's score needs nothing outside the row.

    This is a projection: no text is exploded or shuffled at any corpus size.
    """
    rows = _sides(df, stem, keep)
    return rows.select("id", *keep, *[_order_n(F.col("ref"), F.col("hyp"), n).alias(f"rouge{n}") for n in orders])


class _CommonRows:
    """Bit rows of the longest-common-subsequence table, one per reference token, asked for from the last to the first.

    Bit j of row i is 0 exactly where the table grows between columns j and j+1, so a whole row is one big-integer step
    however long the hypothesis is. Only every sqrt(n)-th row is kept; the rows between two kept ones are computed
    again when the first of them is asked for, so the table takes sqrt(n) rows of memory and twice the steps.
    """

    def __init__(self, ref: list[str], hyp: list[str]):
        self.ref, self.full, self.where = ref, (1 << len(hyp)) - 1, {}
        for j, token in enumerate(hyp):
            self.where[token] = self.where.get(token, 0) | (1 << j)
        self.stride = max(1, math.isqrt(len(ref)))
        row, self.kept = self.full, []
        for i in range(len(ref)):
            if i % self.stride == 0:
                self.kept.append(row)  # the row before token i
            row = self._next(row, i)
        self.stretch, self.rows = -1, []

    def _next(self, row: int, i: int) -> int:
        hit = row & self.where.get(self.ref[i], 0)
        return ((row + hit) | (row - hit)) & self.full

    def __getitem__(self, i: int) -> int:
        stretch, place = divmod(i, self.stride)
        if stretch != self.stretch:
            row, self.stretch, self.rows = self.kept[stretch], stretch, []
            for k in range(stretch * self.stride, min((stretch + 1) * self.stride, len(self.ref))):
                row = self._next(row, k)
                self.rows.append(row)
        return self.rows[place]


def score_tokens(df: DataFrame, ref: str, hyp: Column, orders=(1,), keep: tuple = ()) -> DataFrame:
    """``keep`` columns and rouge<n> of a text against reference tokens that are there already, as when many texts share them."""
    rows = df.select(*keep, F.col(ref).alias("ref"), T.rouge_tokens(hyp).alias("hyp"))
    return rows.select(*keep, *[_order_n(F.col("ref"), F.col("hyp"), n).alias(f"rouge{n}") for n in orders])


def _common_length(ref: list[str], hyp: list[str]) -> int:
    if not ref or not hyp:
        return 0
    where: dict[str, int] = {}
    for j, token in enumerate(hyp):
        where[token] = where.get(token, 0) | (1 << j)
    full = (1 << len(hyp)) - 1
    row = full
    for token in ref:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(hyp) - row.bit_count()


@F.pandas_udf(IntegerType())
def common_length(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([_common_length(a.split(), b.split()) for a, b in zip(ref, hyp)], dtype="int32")


def rouge_l(df: DataFrame, stem: bool = False) -> DataFrame:
    """id, rougeL: longest-common-subsequence F1 over the whole texts; nothing is shuffled."""
    rows = _sides(df, stem)
    hits = common_length(F.array_join("ref", " "), F.array_join("hyp", " "))
    sized = rows.select("id", hits.alias("_hits"), F.size("ref").alias("_r"), F.size("hyp").alias("_h"))
    return sized.select("id", T.f1(F.col("_hits"), F.col("_h"), F.col("_r")).alias("rougeL"))


def _hit_positions(ref: list[str], hyp: list[str]) -> list[int]:
    """Reference positions on one longest common subsequence, traced from the end."""
    rows = _CommonRows(ref, hyp)

    def cell(i: int, j: int) -> int:
        return 0 if i == 0 else j - (rows[i - 1] & ((1 << j) - 1)).bit_count()

    i, j, found = len(ref), len(hyp), []
    while i and j:
        if ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
            found.append(i)
        elif cell(i, j - 1) > cell(i - 1, j):
            j -= 1
        else:
            i -= 1
    return found


def _union_hits(ref_lines: list[list[str]], hyp_lines: list[list[str]]) -> int:
    left_ref: dict[str, int] = {}
    left_hyp: dict[str, int] = {}
    for held, lines in ((left_ref, ref_lines), (left_hyp, hyp_lines)):
        for line in lines:
            for token in line:
                held[token] = held.get(token, 0) + 1
    hits = 0
    for line in ref_lines:
        positions = sorted({p for other in hyp_lines for p in _hit_positions(line, other)})
        for token in (line[p] for p in positions):
            if left_ref.get(token, 0) > 0 and left_hyp.get(token, 0) > 0:
                hits += 1
                left_ref[token] -= 1
                left_hyp[token] -= 1
    return hits


@F.pandas_udf(IntegerType())
def union_hits(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    cut = lambda text: [line.split() for line in text.split("\n")]
    return pd.Series([_union_hits(cut(a), cut(b)) for a, b in zip(ref, hyp)], dtype="int32")


def _lines(text: Column, stem: bool) -> Column:
    """Tokens of each line joined by spaces, lines kept apart; one flat token array serves the stemmer."""
    cut = F.transform(F.split(text, "\n"), lambda s: F.array_join(T.rouge_tokens(s), " "))
    return stemmed_lines(cut) if stem else cut


def _lsum(a: Column, b: Column) -> Column:
    words = lambda c: F.size(F.filter(F.split(F.array_join(c, " "), " "), lambda w: w != ""))
    return T.f1(union_hits(F.array_join(a, "\n"), F.array_join(b, "\n")), words(b), words(a))


def rouge_lsum(df: DataFrame, stem: bool = False) -> DataFrame:
    """id, rougeLsum: union of the common subsequences of newline-split sentences."""
    rows = usable(df).select("id", _lines(F.col("reference"), stem).alias("_a"), _lines(F.col("hypothesis"), stem).alias("_b"))
    return rows.select("id", _lsum(F.col("_a"), F.col("_b")).alias("rougeLsum"))


def rouge_all(df: DataFrame, stem: bool = False, keep: tuple = ()) -> DataFrame:
    """id, ``keep`` and the four scores in one projection; rows are never joined, so ids may repeat."""
    rows = usable(df).select(
        "id", *keep, _tokens(F.col("reference"), stem).alias("ref"), _tokens(F.col("hypothesis"), stem).alias("hyp"),
        _lines(F.col("reference"), stem).alias("_a"), _lines(F.col("hypothesis"), stem).alias("_b"))
    ref, hyp = F.col("ref"), F.col("hyp")
    hits = common_length(F.array_join("ref", " "), F.array_join("hyp", " "))
    return rows.select(
        "id", *keep, _order_n(ref, hyp, 1).alias("rouge1"), _order_n(ref, hyp, 2).alias("rouge2"),
        T.f1(hits, F.size(hyp), F.size(ref)).alias("rougeL"), _lsum(F.col("_a"), F.col("_b")).alias("rougeLsum"))


def run_score(df: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """One row: middle of the resampled means of the four stemmed scores, four decimals, and ``gen_len``."""
    scores = rouge_all(df, stem=True)
    parts = [rouge_bootstrap(scores, c, resamples, seed).select(F.round("mid", 4).alias(c)) for c in ("rouge1", "rouge2", "rougeL", "rougeLsum")]
    parts.append(gen_len(df))
    one = parts[0]
    for p in parts[1:]:  # single rows each
        one = one.withColumn("_", F.lit(1)).join(p.withColumn("_", F.lit(1)), "_").drop("_")
    return one


def rouge_corpus(scores: DataFrame, columns: list) -> DataFrame:
    """Run-level score: the mean of each column, four decimals."""
    return scores.agg(*[F.round(F.avg(c), 4).alias(c) for c in columns])


def rouge_bootstrap(scores: DataFrame, column: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Low, middle and high of resampled means.

    Every row draws a full Poisson(1) weight per resample from a generator seeded by (seed, id), so the
    draws do not depend on the partitioning. A batch of rows becomes one vector of weighted sums, and
    only those are summed over tasks: no row is copied per resample.
    """
    held = scores.select(F.xxhash64(F.lit(seed), "id").alias("key"), F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total, weight = np.zeros(resamples), np.zeros(resamples)
            for key, value in zip(batch["key"], batch["v"]):
                drawn = np.random.default_rng(key & 0xFFFFFFFFFFFFFFFF).poisson(1.0, resamples)
                total += value * drawn
                weight += drawn
            yield pd.DataFrame({"b": np.arange(resamples), "total": total, "weight": weight})

    sums = held.mapInPandas(run, "b int, total double, weight double").groupBy("b").agg(
        (F.sum("total") / F.sum("weight")).alias("mean"))
    return exact_quantiles(sums, "mean", "b", {"low": 0.025, "mid": 0.5, "high": 0.975})


def mean_scores(scored: DataFrame, columns: list) -> DataFrame:
    return scored.groupBy("run", "epoch").agg(*[F.avg(c).alias(c) for c in columns])


def gen_len(df: DataFrame, column: str = "hypothesis") -> DataFrame:
    return df.agg(F.round(F.avg(F.size(T.tokens(F.col(column)))), 4).alias("gen_len"))
