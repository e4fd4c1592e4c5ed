"""Shortening strategies that work on one row at a time, as column expressions."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from brevis import constants as K
from brevis.functions import text as T

RESULT = ("shortened_document", "shortened_len")


def _joined(toks: Column) -> Column:
    return F.array_join(toks, " ")


def spaced(text: Column) -> Column:
    """(text, n): the tokens with one space between them, and how many there are. Strategies cut this text at its spaces."""
    return T.let(T.tokens(text), lambda toks: F.when(toks.isNotNull(), F.struct(_joined(toks).alias("text"), F.size(toks).alias("n"))))


def _front(toks: Column, n) -> Column:
    return F.substring_index(toks["text"], " ", n)


def head(toks: Column, budget) -> tuple[Column, Column]:
    """The first ``budget`` ids of tokens + end mark; decoded without the mark. ``toks`` is ``spaced`` text, as in all strategies."""
    return _front(toks, budget), F.least(toks["n"] + 1, F.lit(budget))


def tail(toks: Column, budget) -> tuple[Column, Column]:
    """The last ``budget`` ids including the end mark; a shorter document is kept whole."""
    return _front(toks, 1 - budget), F.least(toks["n"], F.lit(budget) - 1) + 1


def headtail(toks: Column, budget: int, tenths: int) -> tuple[Column, Column]:
    """floor(r*B)+1 ids from the front and floor((1-r)*B) from the back, r in whole tenths."""
    front = tenths * budget // 10 + 1
    back = (10 - tenths) * budget // 10
    whole = toks["n"] + 1 <= front + back
    words = max(back - 1, 0)
    # With no ids from the back the end mark is cut off as well.
    ends = F.concat(_front(toks, front), F.lit(" "), _front(toks, -words)) if words else _front(toks, front)
    return (
        F.when(whole, toks["text"]).otherwise(ends),
        F.when(whole, toks["n"] + 1).otherwise(F.lit(front + back)),
    )


def shorten_full(df: DataFrame, limit: int = 512) -> DataFrame:
    """The whole text up to the model's input limit."""
    return shorten_head(df, limit)


def _with(df: DataFrame, made: tuple[Column, Column]) -> DataFrame:
    """A null document has a null result of null length."""
    size = F.when(F.col("_toks").isNotNull(), made[1].cast("int"))
    return df.withColumns({RESULT[0]: made[0], RESULT[1]: size}).drop("_toks")


def _tokenised(df: DataFrame) -> DataFrame:
    return df.withColumn("_toks", spaced(F.col("document")))


def shorten_head(df: DataFrame, budget: int) -> DataFrame:
    return _with(_tokenised(df), head(F.col("_toks"), budget))


def shorten_tail(df: DataFrame, budget: int) -> DataFrame:
    return _with(_tokenised(df), tail(F.col("_toks"), budget))


def shorten_headtail(df: DataFrame, budget: int, tenths: int = 5) -> DataFrame:
    if not 0 <= tenths <= 9:
        raise ValueError("the head share must be 0.0 to 0.9 in whole tenths")
    return _with(_tokenised(df), headtail(F.col("_toks"), budget, tenths))


def stop_list(keep_negations: bool = False) -> list[str]:
    kept = set(K.NEGATIONS) if keep_negations else set()
    return [w for w in K.STOPWORDS if w not in kept]


def without_stopwords(found: Column, keep_negations: bool = False) -> Column:
    """(text, removed) from a word array: stop words dropped, punctuation re-spaced, how many words went."""
    entries = stop_list(keep_negations)
    return T.let(T.without(found, entries), lambda kept: F.struct(
        T.respace(_joined(kept)).alias("text"), (F.size(found) - F.size(kept)).alias("removed")
    ))


def shorten_stopwords(df: DataFrame, keep_negations: bool = False) -> DataFrame:
    bound = T.let(T.words(F.col("document")), lambda found: without_stopwords(found, keep_negations))
    made = df.withColumn("_made", bound)
    return made.withColumns({
        RESULT[0]: F.col("_made.text"),
        RESULT[1]: T.token_count(F.col("_made.text")).cast("int"),
        "removed_words": F.col("_made.removed"),
    }).drop("_made")


def punct_respace(df: DataFrame, column: str = "document") -> DataFrame:
    return df.withColumn(column, T.respace(_joined(T.words(F.col(column)))))


def variant(method: str, quantity: str, text: Column, size: Column) -> Column:
    return F.struct(
        F.lit(method).alias("method"), F.lit(quantity).alias("quantity"),
        text.alias(RESULT[0]), F.when(text.isNotNull(), size.cast("int")).alias(RESULT[1]),
    )


TOKEN_METHODS = {
    "head": head,
    "tail": tail,
    "headtail0.2": lambda toks, budget: headtail(toks, budget, 2),
    "headtail0.5": lambda toks, budget: headtail(toks, budget, 5),
}


def token_cuts(toks: Column, budgets: dict, methods=tuple(TOKEN_METHODS)) -> dict:
    """(method, quantity) -> text and size."""
    return {(m, q): TOKEN_METHODS[m](toks, b) for q, b in budgets.items() for m in methods}


def token_variants(toks: Column, budgets: dict, methods=tuple(TOKEN_METHODS)) -> list[Column]:
    return [variant(m, q, *made) for (m, q), made in token_cuts(toks, budgets, methods).items()]


def one_row_each(df: DataFrame, keep: list, variants: list[Column]) -> DataFrame:
    """One output row per variant of a document, all from the same pass.

    The outer form keeps the optimiser from building the array a second time to test its size.
    """
    rows = df.select(*keep, F.explode_outer(F.array(*variants)).alias("_v"))
    return rows.select(*keep, "_v.method", "_v.quantity", "_v." + RESULT[0], "_v." + RESULT[1])


def token_grid(df: DataFrame, budgets: dict | None = None, methods=tuple(TOKEN_METHODS)) -> DataFrame:
    """Head, tail and both head+tail mixes for every budget from one pass over the documents."""
    budgets = budgets or {q: K.QUANTITY_BUDGET[q] for q in ("25", "35", "45")}
    return one_row_each(_tokenised(df), df.columns, token_variants(F.col("_toks"), budgets, methods))


def compression_stats(shortened: DataFrame) -> DataFrame:
    """Document against shortened length per method and quantity."""
    return shortened.groupBy("method", "quantity").agg(
        F.count("*").alias("n_rows"),
        F.avg("document_len").alias("avg_document_len"),
        F.avg("shortened_len").alias("avg_shortened_len"),
        F.min("shortened_len").alias("min_shortened_len"),
        F.max("shortened_len").alias("max_shortened_len"),
        (F.sum("shortened_len") / F.sum("document_len")).alias("ratio"),
    )


def lead_summary(df: DataFrame, column: str = "shortened_document", limit: int = K.TARGET_LIMIT) -> DataFrame:
    """Baseline summariser: the first ``limit`` tokens."""
    return df.withColumn("generated_summary", T.lead(F.col(column), limit))


def generate_summaries(
    df: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], column: str = "shortened_document"
) -> DataFrame:
    """Batch inference hook: ``make`` loads a model once per task, its result maps texts to summaries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        summarise = make()
        for batch in batches:
            yield batch.assign(generated_summary=summarise(batch[column].tolist()))

    schema = df.withColumn("generated_summary", F.lit("")).schema
    return df.mapInPandas(run, schema)
