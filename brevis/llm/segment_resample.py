"""Importance resampling towards a target, with features counted per distinct line.

Texts are cut at newlines. Every distinct line is split into features once: runs of 1 to ``longest`` of its words,
hashed into ``buckets``. The counts of the corpus are those of the lines times their occurrences, plus the
runs that cross a newline, which each document adds by itself. A bucket's gain compares its share of the target with its share of
the corpus; a line's gains are added up once, and a document's weight is the mean over its lines and its crossing runs.
Random noise by key turns weights into scores whose highest make up the draw.

Lines are grouped with partial sums, so a line that fills the corpus is one row per task, and their values go back to the
documents by ``join_counted``. What the driver holds is one number per bucket and the score of the last document drawn.

Null and empty texts have no words: weight 0, never drawn. A null key takes part under the name ``null`` and comes last
among ties; rows that repeat are scored and drawn each, in an order of their own. An empty target has only the
added ones; an empty table gives no rows. A long text is cut whole. Extra columns are ignored.
"""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from brevis.functions.scale import number_rows
from brevis.llm.common import fold_bytes, join_counted, pieces, raw_texts, release, store

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
PERCENT = 10
FEWEST_WORDS = 20
#: Fixed value: words of a folded text, as UTF-8.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_NAME = 16  # bytes by which a line is known


def words_of(text: bytes) -> list:
    return _WORD.findall(fold_bytes(text))


def name_of(line: bytes) -> bytes:
    return hashlib.sha256(line).digest()[:_NAME]


def runs(words: list, longest: int, buckets: int) -> list:
    """Buckets of all runs of 1 to ``longest`` words."""
    out = [zlib.crc32(w) % buckets for w in words]
    for size in range(2, longest + 1):
        out += [zlib.crc32(b" ".join(words[i : i + size])) % buckets for i in range(len(words) - size + 1)]
    return out


def crossing(lines: list, longest: int, buckets: int) -> list:
    """Buckets of the runs that begin in one line and end in another."""
    if longest < 2:
        return []
    words, line = [], []
    for i, own in enumerate(map(words_of, lines)):
        words += own
        line += [i] * len(own)
    return [
        zlib.crc32(b" ".join(words[i : i + size])) % buckets
        for size in range(2, longest + 1) for i in range(len(words) - size + 1) if line[i] != line[i + size - 1]
    ]


def _flat(lists: list) -> pa.Array:
    return pa.array([np.array(x, "<u4").tobytes() for x in lists], pa.binary())


def documents(rows: DataFrame, key: str, text: str, longest: int, buckets: int) -> DataFrame:
    """row, key, names of the lines one after the other, and the buckets of the crossing runs."""
    slim = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            for some in pieces(b, "text"):
                cut = [t.split(b"\n") for t in raw_texts(some.column("text"))]
                yield pa.RecordBatch.from_arrays([
                    some.column("row"), some.column("key"), pa.array([b"".join(map(name_of, x)) for x in cut], pa.binary()),
                    _flat([crossing(x, longest, buckets) for x in cut]),
                ], ["row", "key", "names", "crossing"])
        release()

    return slim.mapInArrow(run, slim.select("row", "key", F.lit(b"").alias("names"), F.lit(b"").alias("crossing")).schema)


def lines(rows: DataFrame, text: str, longest: int, buckets: int) -> DataFrame:
    """name, n (occurrences), n_words and the buckets of every distinct line."""
    found = rows.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line"))
    counted = found.groupBy("line").agg(F.count("*").alias("n"))

    def run(batches):
        for b in batches:
            for some in pieces(b, "line"):
                raw = raw_texts(some.column("line"))
                split = [words_of(x) for x in raw]
                yield pa.RecordBatch.from_arrays([
                    pa.array(map(name_of, raw), pa.binary()), some.column("n"), pa.array(map(len, split), pa.int64()),
                    _flat([runs(x, longest, buckets) for x in split]),
                ], ["name", "n", "n_words", "features"])
        release()

    return counted.mapInArrow(run, "name binary, n long, n_words long, features binary")


def totals(lists: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; ``lists`` has features and n. One row per bucket and task is shuffled."""

    def run(batches):
        sums = np.zeros(buckets)
        for b in batches:
            for some in pieces(b, "features"):
                own = [np.frombuffer(x or b"", "<u4") for x in some.column("features").to_pylist()]
                weight = np.repeat(some.column("n").to_numpy().astype(float), [len(x) for x in own])
                sums += np.bincount(np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int64), weight, buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at].astype(np.int64))], ["bucket", "n"])

    summed = lists.select("features", "n").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():  # one row per bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    size = len(corpus)
    ratio = (target + 1.0) * (corpus.sum() + size) / ((corpus + 1.0) * (target.sum() + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def valued(lists: DataFrame, keep: list, gain: np.ndarray) -> DataFrame:
    """``keep`` columns, n_features and the added-up gains of each list of features."""
    sent = lists.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches):
        for b in batches:
            for some in pieces(b, "features"):
                own = [np.frombuffer(x or b"", "<u4") for x in some.column("features").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[some.column(c) for c in keep], pa.array([len(x) for x in own], pa.int64()),
                     pa.array([int(sent.value[x].sum()) for x in own], pa.int64())], [*keep, "n_features", "gain"])

    none = F.lit(0).cast("long")
    return lists.select(*keep, "features").mapInArrow(run, lists.select(*keep, none.alias("n_features"), none.alias("gain")).schema)


def weights(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = LONGEST, buckets: int = BUCKETS,
) -> DataFrame:
    """row, key, n_words, n_features and weight of every row."""
    rows = store(documents(docs, key, text, longest, buckets), "resample-documents")
    known = store(lines(docs, text, longest, buckets), "resample-lines")
    crossed = rows.select("row", "key", F.col("crossing").alias("features"), F.lit(1).cast("long").alias("n"))
    aims = store(lines(target, target_text, longest, buckets), "resample-target")
    aim_rows = documents(target.withColumn("_none", F.lit(0)), "_none", target_text, longest, buckets)
    aim = totals(aims, buckets)
    corpus = totals(known, buckets)
    if longest > 1:
        corpus = corpus + totals(crossed, buckets)
        aim = aim + totals(aim_rows.select(F.col("crossing").alias("features"), F.lit(1).cast("long").alias("n")), buckets)
    gain = gains(corpus, aim)
    places = F.sequence(F.lit(0), (F.length("names") / _NAME).cast("int") - 1)
    links = rows.select("row", "key", F.explode(F.transform(places, lambda i: F.substring(F.col("names"), i * _NAME + 1, F.lit(_NAME)))).alias("name"))
    values = valued(known, ["name", "n", "n_words"], gain)
    held = known.agg(F.sum("n")).first()[0] or 0
    parts = join_counted(links, store(values, "resample-values"), "name", held).select("row", "key", "n_words", "n_features", "gain")
    if longest > 1:
        parts = parts.unionByName(valued(crossed, ["row", "key"], gain).withColumn("n_words", F.lit(0).cast("long")))
    summed = parts.groupBy("row", "key").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")])
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("gain") / F.col("n_features"))).otherwise(F.lit(0))
    return summed.select("row", "key", "n_words", "n_features", weight.cast("long").alias("weight"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first eight hex digits of a digest of seed and key."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: int = PERCENT, fewest: int = FEWEST_WORDS) -> DataFrame:
    """``scored`` (stored rows with row, key, n_words, score) with the rank of the rows drawn, null for the others.

    Scores are whole thousandths, so their counts are few; they give the last score drawn, and only rows at or
    above it are put in order.
    """
    may = F.col("n_words") >= fewest
    counted = store(scored.where(may).groupBy("score").agg(F.count("*").alias("n")), "resample-scores")
    drawn = (counted.agg(F.sum("n")).first()[0] or 0) * percent // 100
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # some 100,000 scores at most
    last = counted.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before")).where(F.col("before") < drawn)
    cut = last.agg(F.min("score")).first()[0]
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = may & (F.col("score") >= cut)
    placed = number_rows(scored.where(high), [F.desc("score"), F.asc_nulls_last("key"), "row"], "rank")
    place = F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("long")
    return placed.withColumn("rank", place).unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, fewest: int = FEWEST_WORDS,
) -> DataFrame:
    """key, n_words, n_features, weight, score and rank of every row."""
    weighed = weights(docs, target, key, text, target_text, longest, buckets)
    scored = store(weighed.withColumn("score", F.col("weight") + noise(F.col("key"), seed)), "resample-scored")
    return draw(scored, percent, fewest).drop("row")
