"""Vector-matching scores between two bags of vectors per row."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from brevis.functions import blocks, text as T
from brevis.functions.scale import pin, spread_join, values_of

RESULT = StructType([StructField(n, DoubleType()) for n in ("precision", "recall", "f1")])


def token_bags(pairs: DataFrame, ref_tokens: str, hyp_tokens: str, lookup: DataFrame) -> DataFrame:
    """id with two arrays (n, vector): each distinct token's vector and how often it occurs.

    ``lookup`` maps token to vector, one row per token. Every pair comes back: a side without a known
    token has an empty array.
    """
    sides = F.array(
        F.struct(F.lit("ref").alias("side"), F.col(ref_tokens).alias("toks")),
        F.struct(F.lit("hyp").alias("side"), F.col(hyp_tokens).alias("toks")),
    )
    # A row is known by a number, so null and repeated ids keep their own bags.
    rows = pin(pairs.select("id", sides.alias("_sides")).withColumn("_row", F.monotonically_increasing_id()))
    counted = T.runs(F.col("toks"))  # inside the row
    toks = values_of(rows.select("_row", F.inline("_sides")), ["_row", "side"], counted, "t")
    found = spread_join(toks.select("_row", "side", F.col("t.word").alias("token"), F.col("t.n").cast("long").alias("n")), lookup, ["token"])
    entry = F.struct("token", "n", "vector")
    bags = found.groupBy("_row").agg(
        F.collect_list(F.when(F.col("side") == "ref", entry)).alias("ref"),
        F.collect_list(F.when(F.col("side") == "hyp", entry)).alias("hyp"),
    )
    empty = F.array().cast("array<struct<token:string,n:bigint,vector:array<double>>>")
    whole = rows.select("id", "_row").join(bags, "_row", "left")
    return whole.select("id", F.coalesce("ref", empty).alias("ref"), F.coalesce("hyp", empty).alias("hyp"))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _match(ref_n, ref_v, hyp_n, hyp_v) -> tuple[float, float, float]:
    if len(ref_n) == 0 or len(hyp_n) == 0:
        return 0.0, 0.0, 0.0
    return _nearest(np.asarray(ref_n), _unit(np.stack(list(ref_v))), np.asarray(hyp_n), _unit(np.stack(list(hyp_v))))


def _nearest(ref_n: np.ndarray, a: np.ndarray, hyp_n: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Precision, recall and F1 of two bags of unit vectors."""
    if len(ref_n) == 0 or len(hyp_n) == 0:
        return 0.0, 0.0, 0.0
    best_hyp = np.full(len(b), -np.inf)
    best_ref = np.empty(len(a))
    for start in range(0, len(a), 1024):  # bounds the similarity block, not the text
        block = a[start:start + 1024] @ b.T
        best_ref[start:start + 1024] = block.max(axis=1)
        best_hyp = np.maximum(best_hyp, block.max(axis=0))
    recall = float(np.dot(best_ref, ref_n) / ref_n.sum())
    precision = float(np.dot(best_hyp, hyp_n) / hyp_n.sum())
    total = precision + recall
    return precision, recall, 2 * precision * recall / total if total else 0.0


@F.pandas_udf(RESULT)
def _greedy(ref_n: pd.Series, ref_v: pd.Series, hyp_n: pd.Series, hyp_v: pd.Series) -> pd.DataFrame:
    rows = [_match(*row) for row in zip(ref_n, ref_v, hyp_n, hyp_v)]
    return pd.DataFrame(rows, columns=["precision", "recall", "f1"])


def embedding_score(bags: DataFrame, baseline: float = 0.0) -> DataFrame:
    """id, emb_p, emb_r, emb_f1 by greedy matching, optionally rescaled as (x - b) / (1 - b)."""
    scored = bags.withColumn("_m", _greedy("ref.n", "ref.vector", "hyp.n", "hyp.vector"))
    scale = lambda c: (F.col(c) - baseline) / (1.0 - baseline)
    return scored.select(
        "id", scale("_m.precision").alias("emb_p"), scale("_m.recall").alias("emb_r"), scale("_m.f1").alias("emb_f1")
    )


def packed_texts(rows: DataFrame, ref_tokens: str, hyp_tokens: str) -> DataFrame:
    """Blocks (``blocks.pack``) of rows with an id, the tokens of a reference and an array of the tokens of hypotheses; null texts are empty."""
    none = F.array().cast("array<string>")
    hyps = F.transform(hyp_tokens, lambda toks: F.coalesce(toks, none))
    return blocks.pack(rows.select("id", F.concat(F.array(F.coalesce(ref_tokens, none)), hyps).alias("texts")))


def scores_of_blocks(packed: DataFrame, lookup: DataFrame, baseline: float = 0.0) -> DataFrame:
    """id and ``scores``: an array of (emb_p, emb_r, emb_f1), one for each hypothesis of the row, as ``embedding_score`` has them.

    ``lookup`` maps word to vector, one row per word. A block is sent the vectors of its distinct words, so no vector travels for a row.
    """
    kind = packed.schema["ids"].dataType.elementType.simpleString()
    schema = f"id {kind}, scores array<struct<emb_p: double, emb_r: double, emb_f1: double>>"

    def use(block: pa.Table, found: pa.Table) -> pa.Table:
        row_at, text_at, ix = (blocks.numbers(block, c) for c in ("row_at", "text_at", "ix"))
        at = np.full(len(blocks.flat(block, "words")), -1)
        at[found.column("place").to_numpy()] = np.arange(found.num_rows)
        flat = blocks.numbers(found, "vector").astype(float)
        vectors = _unit(flat.reshape(found.num_rows, -1)) if found.num_rows else np.empty((0, 1))

        def bag(t: int) -> tuple:
            words = at[ix[text_at[t] : text_at[t + 1]]]
            kinds, n = np.unique(words[words >= 0], return_counts=True)
            return n, vectors[kinds]

        made = []
        for first, end in zip(row_at[:-1].tolist(), row_at[1:].tolist()):
            ref = bag(first)
            made += [_nearest(*ref, *bag(t)) for t in range(first + 1, end)]
        made = (np.array(made, float).reshape(-1, 3) - baseline) / (1.0 - baseline)
        scores = pa.StructArray.from_arrays([pa.array(made[:, c]) for c in range(3)], ["emb_p", "emb_r", "emb_f1"])
        starts = row_at - np.arange(len(row_at))  # each row's first text is its reference
        return pa.table({"id": blocks.flat(block, "ids"), "scores": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), scores)})

    return blocks.meet(packed, lookup.select("word", "vector"), use, schema)
