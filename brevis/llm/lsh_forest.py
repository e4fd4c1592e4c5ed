"""MinHash near-duplicates by an LSH forest.

A document is its set of distinct word shingles. Documents with equal sets form a class, and one of each class goes
on. Each class gets ``VALUES`` MinHash values and enters ``ORDERS`` sorted orders; an order sorts the classes by the
values from its own starting place on. Candidates are the neighbours in an order: the ``NEAREST`` next rows and the head of
the region, if their common prefix is ``DEPTH`` values or longer. Where a region is dense, sorting by all of ``CODE`` values
makes the neighbours those with the longest common prefix, so depth adapts to the region without any bucket. Where more
than ``NEAREST`` rows share a region and the links found so far leave them in different components, neighbours are not
enough: all sets of such a region are compared, in pairs of blocks of at most about ``BLOCK_ROWS`` rows each.

Candidates whose signatures agree too little are dropped, the others are confirmed on the full sets: first each
document's best candidate, then all candidates that still join different components, then the dense regions. Components are
found by star contraction over the links. Orders are range-partitioned by code and key, so equal
codes spread over tasks; a pair that a range boundary parts in one order is met in the others.

A pair at similarity s shares a prefix of ``DEPTH`` values in at least one order with probability
1 - (1 - s^DEPTH)^ORDERS (0.9999998 at 0.85, 0.99999 at 0.8); the signature filter passes it with more than 0.99999.

Null and empty texts have empty sets and are linked with nothing; rows with a null key are not linked and are
kept. Keys are taken to be unique: of several texts under one key, all take part, and a link of any of them is a link of the key. Very long texts are taken whole. An empty
table gives an empty result. Extra columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brevis.llm.common import pieces, raw_texts, store, width
from brevis.llm.debruijn import Hasher

VALUES = 64
ORDERS = 16
DEPTH = 3
CODE = 12
NEAREST = 3
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 19
SLACK = 0.2  # signatures may agree this much less than the threshold
BROADCAST_KEYS = 1_000_000
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    buffer = np.frombuffer(b" ".join(found) + b" ", np.uint8)
    end = np.flatnonzero(buffer == 32)
    start = np.r_[0, end[:-1] + 1]
    reach = min(words, len(found))
    return np.unique(Hasher(buffer).of(start[: len(start) - reach + 1], end[reach - 1 :]))


def signature(found: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over a set."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, (found[at : at + 4096, None] * _FACTORS + _SHIFTS).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, n (set size), same (digest of the set), sketch of every row."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            for part in pieces(b, "text"):
                sizes, same, signs = [], [], []
                for t in raw_texts(part.column("text")):
                    found = shingles(t, words)
                    sizes.append(len(found))
                    same.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    signs.append(signature(found).tobytes() if len(found) else b"")
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(signs, pa.binary())],
                    ["key", "n", "same", "sketch"])

    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, n long, same binary, sketch binary")


def _ordered(classes: DataFrame, many: int = CODE) -> DataFrame:
    """code, key: every class in every order; the code has the order's number and its first ``many`` values."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            low = np.frombuffer(b"".join(b.column("sketch").to_pylist()), "<u4").reshape(-1, VALUES).astype(">u2")
            for order in range(ORDERS):
                at = (order * (VALUES // ORDERS) + np.arange(many)) % VALUES
                codes = np.ascontiguousarray(low[:, at]).view(np.uint8)
                codes = np.hstack([np.full((len(codes), 1), order, np.uint8), codes])
                flat = pa.py_buffer(np.ascontiguousarray(codes).tobytes())
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, flat])
                yield pa.RecordBatch.from_arrays([fixed.cast(pa.binary()), b.column("key")], ["code", "key"])

    kind = classes.schema["key"].dataType.simpleString()
    return classes.select("key", "sketch").mapInArrow(run, f"code binary, key {kind}")


def candidates(classes: DataFrame) -> DataFrame:
    """a, b: distinct pairs of neighbours, a < b."""
    ordered = _ordered(classes).repartitionByRange(width(classes.sparkSession), "code", "key").sortWithinPartitions("code", "key")
    long = 1 + 2 * DEPTH
    kind = classes.schema["key"].dataType.simpleString()

    def run(batches):
        before = None  # the last rows and their region's head
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            keys = pa.array(b.column("key"))
            if before is not None:
                codes, keys = np.vstack([before[0], codes]), pa.concat_arrays([before[1], keys])
            old = len(codes) - b.num_rows
            region = np.r_[True, (codes[1:, :long] != codes[:-1, :long]).any(1)]
            heads = np.maximum.accumulate(np.where(region, np.arange(len(codes)), 0))
            left, right = [], []
            for shift in range(1, NEAREST + 1):
                at = np.arange(max(old, shift), len(codes))
                at = at[heads[at] <= at - shift]
                left.append(at - shift)
                right.append(at)
            at = np.arange(old, len(codes))
            at = at[heads[at] < at - NEAREST]
            left.append(heads[at])
            right.append(at)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(np.concatenate(left))), keys.take(pa.array(np.concatenate(right)))], ["a", "b"])
            # Carry the head of the last region and the last rows of it.
            last = np.unique(np.r_[heads[-1], np.arange(max(heads[-1], len(codes) - NEAREST), len(codes))])
            before = codes[last], keys.take(pa.array(last))

    met = ordered.mapInArrow(run, f"a {kind}, b {kind}").where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """a, b, agree: the pairs whose signatures agree in at least the threshold less ``SLACK``."""
    signs = classes.select("key", "sketch", "n")
    both = pairs.join(signs.toDF("a", "sa", "na"), "a").join(signs.toDF("b", "sb", "nb"), "b")
    # Sets of too different sizes cannot reach the threshold.
    both = both.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(-1, VALUES) for c in ("sa", "sb"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("a"), b.column("b"), pa.array((x == y).sum(1).astype(np.int32))], ["a", "b", "agree"])

    scored = both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}, agree int")
    return scored.where(F.col("agree") >= int((threshold - SLACK) * VALUES))


def full_sets(docs: DataFrame, needed: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, members: the whole shingle sets of the classes that have a candidate."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    side = F.broadcast(needed) if needed.count() <= BROADCAST_KEYS else needed
    wanted = slim.join(side, "key")

    def run(batches):
        for b in batches:
            for part in pieces(b, "text"):
                found = [shingles(t, words) for t in raw_texts(part.column("text"))]
                ends = np.r_[0, np.cumsum([len(f) for f in found])]
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([
                    part.column("key"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))], ["key", "members"])

    kind = slim.schema["key"].dataType.simpleString()
    return wanted.select("key", "text").mapInArrow(run, f"key {kind}, members array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= percent * union."""
    held = sets.select("key", "members")
    both = pairs.select("a", "b").join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y")).alias("t")).where(
        100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b")


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """key, component (its smallest key) of every linked key, by alternating star contraction."""
    edges = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        # Large star: each key's larger neighbours move to the smallest of its neighbourhood.
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # Small star: each key's smaller neighbours, and itself, move to their smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        new = store(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))).distinct(), "links")
        if not new.exceptAll(edges).take(1) and not edges.exceptAll(new).take(1):
            break
        edges = new
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("key"), F.col("b").alias("component"))
    return stars.unionAll(edges.select(F.col("b").alias("key"), F.col("b").alias("component")).distinct())


def _spanning(marks: tuple, sizes: tuple, flats: tuple, percent: int, one: bool) -> list:
    """(row, row) links that join the components of two blocks: a forest of the pairs that reach ``percent``.

    Intersections are counted exactly, by products of 0/1 matrices over the shingles that both blocks hold.
    """
    owners = [np.repeat(np.arange(len(n)), n) for n in sizes]
    shared = np.intersect1d(*flats)
    inter = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
    places = []
    for flat, owner in zip(flats, owners, strict=True):
        at = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
        held = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[held], kind="stable")
        places.append((at[held][order], owner[held][order]))
    for begin in range(0, len(shared), 4096):
        slabs = []
        for (at, owner), n in zip(places, sizes, strict=True):
            lo, hi = np.searchsorted(at, [begin, begin + 4096])
            slab = np.zeros((len(n), min(4096, len(shared) - begin)), np.float32)
            slab[owner[lo:hi], at[lo:hi] - begin] = 1
            slabs.append(slab)
        inter += slabs[0] @ slabs[1].T
    inter = inter.astype(np.int64)
    near = 100 * inter >= percent * (sizes[0][:, None] + sizes[1][None, :] - inter)
    near &= marks[0][:, None] != marks[1][None, :]
    lead: dict = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            lead[x] = x = lead[lead[x]]
        return x

    out = []
    for i, j in np.argwhere(np.triu(near) if one else near).tolist():
        x, y = find(int(marks[0][i])), find(int(marks[1][j]))
        if x != y:
            lead[x] = y
            out.append((i, j))
    return out


def dense_links(docs: DataFrame, classes: DataFrame, found: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame | None:
    """a, b: links between the components ``found`` inside regions that neighbours do not cover; None without such regions."""
    joined = classes.join(found, "key", "left").select("key", "n", "sketch", F.xxhash64(F.coalesce("component", "key")).alias("mark"))
    marked = store(joined, "marked")
    spots = store(_ordered(marked, DEPTH).toDF("region", "key").join(marked.select("key", "n", "mark"), "key"), "spots")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    dense = spots.groupBy("region").agg(
        F.count("*").alias("rows"), blocks.alias("blocks"), F.min("mark").alias("lo"), F.max("mark").alias("hi"),
    ).where((F.col("rows") > NEAREST + 1) & (F.col("lo") != F.col("hi"))).select("region", "blocks")
    within = store(spots.join(dense, "region").select("region", "key", "mark", "blocks").distinct(), "dense")
    if not within.take(1):
        return None
    sets = store(full_sets(docs, within.select("key").distinct(), key, text, words).where(F.size("members") > 0), "dense-sets")
    own = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int")
    dealt = within.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "region", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "key", "mark")
    ready = dealt.join(sets, "key").select(
        F.concat("region", F.to_binary(F.format_string("%08x%08x", "lo", "hi"), F.lit("hex"))).alias("part"),
        (F.col("own") == F.col("lo")).alias("low"), (F.col("lo") == F.col("hi")).alias("one"), "key", "mark", "members",
    ).repartition(width(docs.sparkSession), "part").sortWithinPartitions("part")
    kind = classes.schema["key"].dataType.simpleString()

    def links(held: list) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        low, one = rows["low"].to_numpy(), rows["one"][0].as_py()
        sides = [np.arange(len(low))] * 2 if one else [np.flatnonzero(low), np.flatnonzero(~low)]
        marks = rows["mark"].to_numpy()
        lists = [rows["members"].take(pa.array(s)).combine_chunks() for s in sides]
        sizes = [x.value_lengths().to_numpy().astype(np.int64) for x in lists]
        flats = [x.flatten().to_numpy() for x in lists]
        pairs = np.array(_spanning(tuple(marks[s] for s in sides), sizes, flats, percent, one), np.int64).reshape(-1, 2)
        keys = rows["key"].combine_chunks()
        return pa.RecordBatch.from_arrays([keys.take(pa.array(s[pairs[:, i]])) for i, s in enumerate(sides)], ["a", "b"])

    def run(batches):
        name, held = None, []
        for b in batches:
            parts = b.column("part").to_pylist()
            cuts = [0, *(i for i in range(1, len(parts)) if parts[i] != parts[i - 1]), len(parts)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if parts[s] != name and held:
                    yield links(held)
                    held = []
                name = parts[s]
                held.append(b.slice(s, e - s))
        if held:
            yield links(held)

    return store(ready.mapInArrow(run, f"a {kind}, b {kind}").distinct(), "dense-links")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
) -> DataFrame:
    """key, n_shingles, component, kept for every row of ``docs``.

    ``component`` is the smallest key reachable by links of similarity ``percent`` or more; ``kept`` tells whether
    the row's key is that one. Rows with a null key have a null component and are kept.
    """
    rows = store(sketches(docs, key, text, words), "sketches")
    filled = rows.where((F.col("n") > 0) & F.col("key").isNotNull())
    classes = store(filled.groupBy("same").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    met = store(likely(candidates(classes), classes, percent / 100), "pairs")
    ends = met.select(F.col("a").alias("key")).unionAll(met.select(F.col("b").alias("key"))).distinct()
    sets = store(full_sets(docs, ends, key, text, words), "sets")
    # First each document's best candidate, then what still joins different components.
    halves = met.select(F.col("a").alias("key"), "a", "b", "agree").unionAll(met.select(F.col("b").alias("key"), "a", "b", "agree"))
    best = halves.groupBy("key").agg(F.max(F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    first = store(confirm(best, sets, percent), "confirmed")
    found = store(components(first), "components")
    rest = (
        met.join(found.toDF("a", "ca"), "a", "left").join(found.toDF("b", "cb"), "b", "left")
        .where(~F.coalesce("ca", "a").eqNullSafe(F.coalesce("cb", "b"))).select("a", "b").join(best, ["a", "b"], "left_anti"))
    second = store(confirm(rest, sets, percent), "confirmed")
    links = found.where("key <> component").select(F.col("key").alias("a"), F.col("component").alias("b")).unionAll(second)
    final = store(components(links), "components")
    dense = dense_links(docs, classes, final, key, text, words, percent)
    if dense is not None and dense.take(1):
        stars = final.where("key <> component").select(F.col("key").alias("a"), F.col("component").alias("b"))
        final = components(stars.unionAll(dense))
    named = classes.select("same", F.col("key").alias("head")).join(final, F.col("head") == final["key"], "left").select(
        "same", F.coalesce("component", "head").alias("component"))
    out = rows.join(named, "same", "left").select(
        "key", F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("key").isNotNull(), F.col("component")).otherwise(F.col("key")).alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("key") == F.col("component"), F.lit(True)))
