"""Blocks of rows that are sent what their own words are looked up for: once a block, not once a row."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from brevis.functions.scale import fresh_dir, written

#: Words of a block, repeats included. A longer row is a block of its own.
BLOCK = 1_000_000


def flat(rows, column: str) -> pa.Array:
    """The entries of a list column, all rows in one array."""
    lists = rows.column(column)
    return (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten()


def numbers(rows, column: str) -> np.ndarray:
    return flat(rows, column).to_numpy(zero_copy_only=False)


def _starts(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def pack(rows: DataFrame) -> DataFrame:
    """Rows (id, texts: array of arrays of words, none of them null) as rows of many: block, ids, the distinct ``words`` of the block and for
    each how often it occurs (``held``) and in how many rows (``docs``).

    Texts from ``row_at[r]`` to ``row_at[r + 1]`` belong to row r; text t holds the words at the places ``ix[text_at[t]:text_at[t + 1]]``.
    Ids may be of any type, null or repeated. Blocks do not reach over tasks, and are stored in the shared folder.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    word = rows.schema["texts"].dataType.elementType.elementType.simpleString()

    def run(batches):
        held, size, made, task = [], 0, 0, TaskContext.get().partitionId()

        def packed():
            ids, texts = (pa.concat_arrays([h[c] for h in held]) for c in range(2))
            lists = texts.flatten()
            row_at, text_at = _starts(texts), _starts(lists)
            coded = lists.flatten().dictionary_encode()
            ix, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            row = np.repeat(np.arange(len(ids)), np.diff(text_at[row_at]))
            places = np.unique(row * max(n, 1) + ix) % max(n, 1)
            columns = [ids, coded.dictionary, pa.array(np.bincount(ix, minlength=n)), pa.array(np.bincount(places, minlength=n)),
                       pa.array(row_at.astype(np.int32)), pa.array(text_at.astype(np.int32)), pa.array(ix.astype(np.int32))]
            whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns]
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task:08x}{made:08x}"]), *whole], ["block", "ids", "words", "held", "docs", "row_at", "text_at", "ix"])

        for b in batches:
            ids, texts = b.column("id"), b.column("texts")
            ends = _starts(texts.flatten())[_starts(texts)][1:]
            start = 0
            while start < b.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = max(int(np.searchsorted(ends, before + BLOCK - size, "right")), start + (not held))
                if stop > start:
                    held.append([ids.slice(start, stop - start), texts.slice(start, stop - start)])
                    size += int(ends[stop - 1]) - before
                start = stop
                if start < b.num_rows or size >= BLOCK:
                    yield packed()
                    held, size, made = [], 0, made + 1
        if held:
            yield packed()

    schema = (f"block string, ids array<{kind}>, words array<{word}>, held array<bigint>, docs array<bigint>, "
              "row_at array<int>, text_at array<int>, ix array<int>")
    path = fresh_dir(spark, "blocks")
    return written(rows.select("id", "texts").mapInArrow(run, schema), path)


def word_counts(packed: DataFrame) -> DataFrame:
    """word, held and docs over all blocks."""
    entries = packed.select(F.explode(F.arrays_zip("words", "held", "docs")).alias("w"))
    return entries.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.held").alias("held"), F.sum("w.docs").alias("docs"))


def meet(packed: DataFrame, lookup: DataFrame, use, schema: str) -> DataFrame:
    """``use(block, found)`` of every block as tables: ``found`` has the columns of ``lookup`` for the block's words, by their ``place``.

    ``lookup`` has one row per ``word``; words it lacks are not found. A word meets it once for each block that holds it.
    """
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = packed.select(F.col("block").alias("key"), F.posexplode("words").alias("place", "word"))
    sent = wanted.join(lookup, "word").drop("word")

    # The number of tasks is named, so that small blocks, which are much work, are not put together by size.
    dealt = packed.repartition(parts, "block").groupBy("block").cogroup(sent.repartition(parts, "key").groupBy("key"))
    return dealt.applyInArrow(use, schema)  # a key is always that of a block


def replaced(packed: DataFrame, lookup: DataFrame, unknown=None) -> DataFrame:
    """id and texts with every word replaced by its ``value`` in ``lookup`` (word, value); words it lacks become ``unknown``, or are left out without one."""
    kind, value = packed.schema["ids"].dataType.elementType.simpleString(), lookup.schema["value"].dataType.simpleString()

    def use(block: pa.Table, found: pa.Table) -> pa.Table:
        row_at, text_at, ix = (numbers(block, c) for c in ("row_at", "text_at", "ix"))
        values = found.column("value").combine_chunks()
        at = np.full(len(flat(block, "words")), -1)
        at[found.column("place").to_numpy()] = np.arange(len(values))
        places = at[ix]
        if unknown is None:
            text_at = np.concatenate([[0], np.cumsum(places >= 0)])[text_at]
            places = places[places >= 0]
        else:
            places[places < 0] = len(values)
            values = pa.concat_arrays([values, pa.array([unknown], values.type)])
        lists = pa.ListArray.from_arrays(pa.array(text_at, pa.int32()), values.take(pa.array(places)))
        return pa.table({"id": flat(block, "ids"), "texts": pa.ListArray.from_arrays(pa.array(row_at, pa.int32()), lists)})

    return meet(packed, lookup.select("word", "value"), use, f"id {kind}, texts array<array<{value}>>")
