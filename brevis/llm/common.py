"""What several of the corpus operators share."""

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brevis.functions.scale import fresh_dir, lean

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write rows once into the shared folder and read them back.

    Cuts the lineage and lets several readers share one computation; unlike ``checkpoint`` it
    does not compute the rows twice, and it keeps column pruning for the readers.
    """
    lean(df.sparkSession)
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, keyed: DataFrame, on: str, total: int, how: str = "inner", most: int = 1000) -> DataFrame:
    """Join rows with a side of one row per key whose ``n`` says how many of the ``total`` rows hold the key.

    At most ``most`` keys can hold a ``most``-th of the rows each; these are broadcast, so that no task gets all rows of
    a hot key. The other keys are shuffled. ``rows`` are read twice and should be stored.
    """
    held = F.col("n") * most >= total
    hot, cold = keyed.where(held), keyed.where(~held)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on, how))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def folded(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_bytes(text: bytes) -> bytes:
    """The same on UTF-8: bytes.lower changes ASCII letters only."""
    return text.lower()


def remainder(key: Column, by: int) -> Column:
    """crc32 of a key's text modulo ``by``; null keys count as remainder -1."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(by)), F.lit(-1))


def raw_texts(column: pa.Array) -> list:
    """Arrow strings as UTF-8 bytes; a null text is an empty one."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most_bytes`` of text each; one long text is one slice."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most_bytes:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies; the environment may name another folder."""
    folder = os.environ.get("BREVIS_TOKENIZERS")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def release() -> None:
    """Give freed memory back to the system: a worker is reused by later stages, next to others of its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass
