"""URL filters by a Bloom filter cascade.

A rule is a host and a path prefix; its key is ``host + path``. Every url asks for the keys
``(host suffix, path prefix)`` that could be rules. Level 0 encodes the listed keys; level 1 encodes the
keys of the corpus that pass level 0 without being listed; level 2 the listed keys that pass level 1;
and so on until a level has no false positive left. Over that complete key universe the depth at
which a key first fails tells exactly whether it is listed, so urls are judged without a join.

Only the key universe's passers (a small share of the distinct keys) are ever shuffled. Bit arrays are
cut into segments of at most ``SEGMENT_BITS`` bits: a key asks one segment only, and urls are judged in
one pass per segment, so what a task holds at once is bounded however many rules there are.

Null urls, and urls without ``://``, have empty host and path and match no rule. Repeated urls are
judged each. An empty rule list lists nothing. Rules with a null host or path are left out; of two
verdicts for one rule, block wins; of two rules of one length, that with the longer host wins. Extra
columns are kept, but for those named host, path, rule or verdict, which are replaced.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brevis.llm.common import folded, store

SEGMENT_BITS = 1 << 26
BITS_PER_KEY = 8
HASHES = 4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(folded(F.regexp_extract(_after(url), r"\A([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def suffixes(host: Column) -> Column:
    """The host and its parents: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def keys_of(host: Column, path: Column, lengths: list) -> Column:
    """Candidate keys of a url: each host suffix with each path prefix as long as some rule's path."""
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    pairs = F.transform(suffixes(host), lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\x00"), p)))
    return F.when(host != "", F.flatten(pairs)).otherwise(F.array().cast("array<string>"))


def hashes(key: Column) -> Column:
    """Two independent 64-bit hashes; the level's positions follow from them."""
    return F.struct(F.xxhash64(key, F.lit(1)).alias("a"), F.xxhash64(key, F.lit(2)).alias("b"))


@dataclass(frozen=True)
class Level:
    """One Bloom filter; a key belongs to the segment its first hash names."""

    seed: int
    segments: int
    bits: int

    @classmethod
    def sized(cls, seed: int, keys: int) -> "Level":
        need = max(64, BITS_PER_KEY * keys)
        segments = -(-need // SEGMENT_BITS)
        return cls(seed, segments, -(-need // (64 * segments)) * 64)

    def segment(self, a: np.ndarray) -> np.ndarray:
        return ((a >> np.uint64(40)) % np.uint64(self.segments)).astype(np.int64)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            start = (a ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
            start ^= start >> np.uint64(33)
            step = (b * np.uint64(2 * self.seed + 3)) | np.uint64(1)
            return np.stack([(start + np.uint64(i) * step) % np.uint64(self.bits) for i in range(HASHES)])


def _encoded(keys: DataFrame, level: Level) -> dict:
    """segment -> bit array. Tasks send set words, combined before the driver sees them."""

    def run(batches):
        for b in batches:
            a, c = (b.column(n).to_numpy().view(np.uint64) for n in ("a", "b"))
            seg, at = level.segment(a), level.places(a, c).astype(np.int64)
            word = np.broadcast_to(seg, at.shape).ravel() * (level.bits // 64) + at.ravel() // 64
            bit = np.uint64(1) << (at.ravel() % 64).astype(np.uint64)
            order = np.argsort(word, kind="stable")
            word, bit = word[order], bit[order]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, int)
            merged = np.bitwise_or.reduceat(bit, first) if len(word) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(merged.view(np.int64))], ["word", "bits"])

    rows = keys.select("a", "b").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    per = level.bits // 64
    out = {s: np.zeros(per, np.uint64) for s in range(level.segments)}
    for r in rows.toLocalIterator():
        out[r["word"] // per][r["word"] % per] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def _passes(level: Level, arrays: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which keys of the held segments pass; keys of other segments fail."""
    at, seg = level.places(a, b), level.segment(a)
    out = np.zeros(len(a), bool)
    for s, words in arrays.items():
        mine = np.flatnonzero(seg == s)
        got = np.ones(len(mine), bool)
        for row in at[:, mine]:
            got &= (words[(row >> np.uint64(6)).astype(np.int64)] >> (row & np.uint64(63)) & np.uint64(1)).astype(bool)
        out[mine] = got
    return out


def _kept(keys: DataFrame, level: Level, arrays: dict) -> DataFrame:
    """The keys that pass a level, one pass per segment."""
    held = keys.sparkSession.sparkContext
    names = keys.columns
    parts = []
    for s, words in arrays.items():
        sent = held.broadcast(words)  # at most SEGMENT_BITS bits

        def run(batches, s=s, sent=sent):
            for b in batches:
                a, c = (b.column(n).to_numpy().view(np.uint64) for n in ("a", "b"))
                yield b.filter(pa.array(_passes(level, {s: sent.value}, a, c)))

        parts.append(keys.select(*names).mapInArrow(run, keys.schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Cascade:
    levels: tuple
    arrays: tuple


def build(listed: DataFrame, universe: DataFrame, most_levels: int = 64) -> Cascade:
    """``listed`` and ``universe`` hold one ``key`` per row; listed keys are distinct."""
    named = store(listed.select("key", hashes(F.col("key")).alias("h")).select("key", "h.*"), "listed")
    count = named.count()
    if not count:
        return Cascade((), ())
    level = Level.sized(0, count)
    levels, arrays = [level], [_encoded(named, level)]
    asked = universe.select("key", hashes(F.col("key")).alias("h")).select("key", "h.*")
    # Passers only are made distinct and held against the list.
    other = store(_kept(asked, level, arrays[0]).distinct().join(named.select("key"), "key", "left_anti"), "passers")
    inside, outside = named, other  # what the next level must let fail, what it must encode
    while (n := outside.count()) and len(levels) < most_levels:
        level = Level.sized(len(levels), n)
        bits = _encoded(outside, level)
        levels.append(level)
        arrays.append(bits)
        inside, outside = outside, store(_kept(inside, level, bits), "passers")
    if n:
        raise RuntimeError(f"{n} keys still collide after {most_levels} levels")
    return Cascade(tuple(levels), tuple(arrays))


def member(df: DataFrame, keys: str, cascade: Cascade, out: str) -> DataFrame:
    """``out``: for each of the ``keys`` array's entries whether it is listed.

    The levels are broadcast when all of them together fit one segment's bound; otherwise each
    level's segments are walked in one pass each, the depth reached so far being carried in a column.
    """
    context = df.sparkSession.sparkContext
    if not cascade.levels:
        return df.withColumn(out, F.transform(keys, lambda _: F.lit(False)))
    rows = df.withColumn("_h", F.transform(keys, hashes)).withColumn("_depth", F.transform(keys, lambda _: F.lit(0).cast("long")))
    whole = sum(x.bits * x.segments for x in cascade.levels) <= SEGMENT_BITS
    passes = [[(i, None) for i in range(len(cascade.levels))]] if whole else [
        [(i, s)] for i, x in enumerate(cascade.levels) for s in range(x.segments)]
    for group in passes:
        sent = [(i, context.broadcast({k: v for k, v in cascade.arrays[i].items() if s in (None, k)})) for i, s in group]

        def run(batches, sent=sent):
            for b in batches:
                at = b.schema.get_field_index("_depth")
                h, depth = b.column("_h"), b.column(at)
                flat = h.flatten()
                a, c = (flat.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
                deep = depth.flatten().to_numpy(zero_copy_only=False).copy()
                for i, words in sent:
                    here = np.flatnonzero(deep == i)
                    deep[here] += _passes(cascade.levels[i], words.value, a[here], c[here])
                ends = np.r_[0, np.cumsum(h.value_lengths().to_numpy(zero_copy_only=False))]
                yield b.set_column(at, "_depth", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(deep)))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.withColumn(out, F.transform("_depth", lambda d: d % 2 == 1)).drop("_h", "_depth")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of the longest fitting rule.

    A key that is in neither list gets the ``otherwise`` verdict and a null rule. Blocked and allowed
    rules have a cascade each, so the verdict too comes from membership.
    """
    clean = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.concat("host", F.lit("\x00"), "path").alias("key"), F.length("path").alias("n"), "verdict",
    ).groupBy("key", "n").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    clean = store(clean, "rules")
    lengths = sorted(r["n"] for r in clean.select("n").distinct().collect())  # bounded by the longest path
    named = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    keyed = named.withColumn("_keys", keys_of(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>"))
    universe = keyed.select(F.explode("_keys").alias("key"))
    for verdict in ("block", "allow"):
        listed = clean.where(F.col("verdict") == verdict).select("key")
        keyed = member(keyed, "_keys", build(listed, universe), f"_{verdict}")
    hits = F.filter(
        F.arrays_zip(F.col("_keys").alias("key"), F.col("_block").alias("block"), F.col("_allow").alias("allow")),
        lambda k: k["block"] | k["allow"])
    longest = F.array_max(F.transform(hits, lambda k: F.struct(
        (F.length(k["key"]) - 1).alias("size"), F.instr(k["key"], "\x00").alias("host"), F.when(k["block"], "block").otherwise("allow").alias("verdict"),
        F.translate(k["key"], "\x00", "").alias("rule"))))
    return keyed.withColumn("_best", longest).withColumn("rule", F.col("_best.rule")).withColumn(
        "verdict", F.coalesce("_best.verdict", F.lit(otherwise))).drop("_keys", "_block", "_allow", "_best")
