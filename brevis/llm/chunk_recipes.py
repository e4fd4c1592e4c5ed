"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes says so, so the cuts follow the content. Each chunk is
named by a fingerprint, and a text is its recipe: the ordered list of its chunks' identifiers. The chunks are
moved once per distinct chunk and task, to verify the identifiers: no two different chunks may share one. If some do, all
are named anew with another salt, so recipes that agree are texts that agree. From then on only recipes
travel: equal texts are grouped by them, and the row that stays goes back to the rows of its group by
``join_counted``, which leaves no hot key for a text that fills the table.

Null texts count as empty; the empty text has the empty recipe and forms a group like any other. Of rows that repeat the
largest key with one text exactly one stays. Null keys are smaller than any other; a group of null keys
only keeps one row. An empty table gives no rows. A long text is cut whole, and its chunks travel one by one.
Extra columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brevis.llm.common import join_counted, pieces, raw_texts, release, store

LEAST, USUAL, MOST = 1 << 10, 1 << 12, 1 << 15  # bytes of a chunk
BITS = 128  # of an identifier
ATTEMPTS = 8
#: A random-looking number for each byte, by rule.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def rolling(data: bytes) -> np.ndarray:
    """Gear hash of the last 32 bytes at each place; windows double in five steps."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for reach in (1, 2, 4, 8, 16):
        h[reach:] += h[:-reach] << np.uint32(reach)  # the right side is computed before it is added
    return h


def cuts(data: bytes) -> list:
    """Ends of the chunks: where the top bits of the rolling hash are zero, with least and most sizes kept."""
    if len(data) <= LEAST:
        return [len(data)] if data else []
    wanted = np.flatnonzero(rolling(data) < np.uint32((1 << 32) // USUAL)) + 1
    out, start = [], 0
    while len(data) - start > LEAST:
        i = int(np.searchsorted(wanted, start + LEAST))
        end = min(int(wanted[i]) if i < len(wanted) else len(data), start + MOST, len(data))
        out.append(end)
        start = end
    return [*out, len(data)] if start < len(data) else out


def chunks(data: bytes) -> Iterator[bytes]:
    start = 0
    for end in cuts(data):
        yield data[start:end]
        start = end


def name_of(chunk: bytes, salt: int, bits: int) -> bytes:
    whole = hashlib.blake2b(chunk, digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return whole if bits == BITS else (int.from_bytes(whole, "little") & ((1 << bits) - 1)).to_bytes(16, "little")


def recipes(docs: DataFrame, key: str, text: str, salt: int, bits: int) -> DataFrame:
    """key, recipe and sha256 of every text."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            for some in pieces(b, "text"):
                texts = raw_texts(some.column("text"))
                yield pa.RecordBatch.from_arrays([
                    some.column("key"), pa.array([b"".join(name_of(c, salt, bits) for c in chunks(t)) for t in texts], pa.binary()),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                ], ["key", "recipe", "sha"])
        release()

    return slim.mapInArrow(run, slim.select("key", F.lit(b"").alias("recipe"), F.lit(b"").alias("sha")).schema)


def dictionary(docs: DataFrame, text: str, salt: int, bits: int) -> DataFrame:
    """name, chunk: every different chunk once; copies within a task never leave it."""

    def run(batches):
        for b in batches:
            for some in pieces(b, "text"):
                unlike = dict.fromkeys(c for t in set(raw_texts(some.column("text"))) for c in chunks(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name_of(c, salt, bits) for c in unlike], pa.binary()), pa.array(unlike, pa.binary())], ["name", "chunk"])
        release()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "name binary, chunk binary").distinct()


def verified(docs: DataFrame, text: str, salt: int, bits: int) -> bool:
    """No identifier stands for two different chunks."""
    shared = dictionary(docs, text, salt, bits).groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    return not shared.take(1)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """key, keep (key of the row that stays), group_size, kept and sha (binary) of every row."""
    salt = next((s for s in range(ATTEMPTS) if verified(docs, text, s, bits)), None)
    if salt is None:
        raise ValueError(f"identifiers of {bits} bits are too short to tell the chunks apart")
    rows = store(recipes(docs, key, text, salt, bits).withColumn("row", F.monotonically_increasing_id()), "recipes")
    groups = rows.groupBy("recipe").agg(F.max(F.struct("key", "row")).alias("stays"), F.count("*").alias("n"))
    met = join_counted(rows, store(groups, "recipe-groups"), "recipe", rows.count())
    return met.select(
        "key", F.col("stays.key").alias("keep"), F.col("n").alias("group_size"), (F.col("row") == F.col("stays.row")).alias("kept"), "sha")
