"""Filter interaction audit by truth-table survival words.

Every document is tested once by all filters; its failures are a mask of five bits. The mask stands for a 32-bit
word: bit S is set if the document survives the subset S of filters, that is, if it fails none of them. Words are
added up by position with carry-save adders, task by task, for each part and label class; the 32 sums are the
survivors of every subset. What any order of filters keeps, removes and loses are differences of these sums:
no order is ever run over the documents.

A document is a copy (filter E) if a smaller key has the same text anywhere in the table. The smallest key of each text is an
aggregate; it goes back to the documents by ``join_counted``, so a text that fills the table is no hot key.

Null and empty texts are equal to each other, have no words (A holds, B to D do not), and are tested like all others. Null keys
are no smaller than any key and have no smaller one, so E never holds for them; they have no labels. Of rows that repeat a key with
the same text none is a copy of the other. A document with several label rows is good or toxic if any of them says
so. A null part is the empty string. An empty table has no parts and no rows. Long texts are read whole, one at a
time. Extra columns are ignored.
"""

import hashlib
import json
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brevis.llm.common import join_counted, pieces, raw_texts, release, store

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
GOOD, TOXIC = 1, 2
FEWEST_WORDS = 100
DISTINCT_SHARE = 80
CAPITAL_SHARE = 10
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
_BUFFER = 1 << 16  # words added up at once
_PARTS = 4096  # sums held by a task before they are handed on

#: Bit S of WORDS[mask]: a document with these failures survives the subset S.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not mask & s) for mask in range(SUBSETS)], np.uint32)


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails. White space is ASCII's, as bytes.split has it."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.decode("utf-8", "replace"))
    failed = (
        len(words) < FEWEST_WORDS,
        100 * len(set(words)) < DISTINCT_SHARE * len(words),
        100 * capitals > CAPITAL_SHARE * points,
        len(text.translate(None, SIGNS)) < len(text),
    )
    return sum(1 << i for i, f in enumerate(failed) if f)


def measured(docs: DataFrame, key: str, part: str, text: str) -> DataFrame:
    """key, part, digest of the text, and the mask of what it fails by itself."""
    slim = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            for some in pieces(b, "text"):
                texts = raw_texts(some.column("text"))
                yield pa.RecordBatch.from_arrays([
                    some.column("key"), some.column("part"),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(map(failures, texts), pa.int32()),
                ], ["key", "part", "digest", "mask"])
        release()

    out = slim.select("key", "part", F.lit(b"").alias("digest"), F.lit(0).alias("mask")).schema
    return slim.mapInArrow(run, out)


def marked(rows: DataFrame, labels: DataFrame, key: str, good: Column, toxic: Column) -> DataFrame:
    """part, class (GOOD and TOXIC bits) and the whole mask of every document."""
    firsts = rows.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = join_counted(rows, store(firsts, "audit-firsts"), "digest", rows.count(), "left")
    whole = F.col("mask") + F.when(F.col("key") > F.col("first"), F.lit(COPY)).otherwise(0)
    named = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("label_key")).agg(
        F.max(F.when(good, GOOD).otherwise(0)).alias("good"), F.max(F.when(toxic, TOXIC).otherwise(0)).alias("toxic"))
    kind = (F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))).alias("class")
    return met.join(named, F.col("key") == F.col("label_key"), "left").select("part", kind, whole.cast("int").alias("mask"))


# --- sums by position -------------------------------------------------------------------------

def positional(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits set: planes of equal weight are added three to two, without carries to wait for."""
    rows = 15
    filled = np.zeros(-(-len(words) // rows) * rows, np.uint32)
    filled[: len(words)] = words
    planes, weight, out = {1: list(filled.reshape(rows, -1))}, 1, np.zeros(SUBSETS, np.int64)
    while weight in planes:
        here, carried = planes[weight], planes.setdefault(2 * weight, [])
        while len(here) > 1:
            a, b, c = here.pop(), here.pop(), here.pop() if here else np.uint32(0)
            odd = a ^ b
            here.append(odd ^ c)
            carried.append((a & b) | (odd & c))
        bits = np.unpackbits(np.ascontiguousarray(here[0]).astype("<u4").view(np.uint8), bitorder="little").reshape(-1, SUBSETS)
        out += weight * bits.sum(0, dtype=np.int64)
        if not carried:
            break
        weight *= 2
    return out


def survivors(rows: DataFrame) -> DataFrame:
    """part, class, subset, n: survivors of every subset, summed by task."""

    def run(batches):
        waiting, sums = {}, {}

        def add(name):
            sums[name] = sums.get(name, 0) + positional(np.concatenate(waiting.pop(name)))

        def handed():
            for name in list(waiting):
                add(name)
            names = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in names], pa.string()), pa.array([c for _, c in names], pa.int32()),
                 pa.array([sums[x].tolist() for x in names], pa.list_(pa.int64()))], ["part", "class", "n"])
            sums.clear()

        for b in batches:
            coded = b.column("part").dictionary_encode()
            group = coded.indices.to_numpy().astype(np.int64) * 4 + b.column("class").to_numpy()
            order = np.argsort(group, kind="stable")
            words, group = WORDS[b.column("mask").to_numpy()[order]], group[order]
            for s, e in zip(*_bounds(group), strict=True):
                name = coded.dictionary[int(group[s] // 4)].as_py(), int(group[s] % 4)
                waiting.setdefault(name, []).append(words[s:e])
                if sum(map(len, waiting[name])) >= _BUFFER:
                    add(name)
            if len(sums) + len(waiting) > _PARTS:
                yield from handed()
        yield from handed()

    by_task = rows.mapInArrow(run, "part string, class int, n array<long>")
    opened = by_task.select("part", "class", F.posexplode("n").alias("subset", "n"))
    return opened.groupBy("part", "class", "subset").agg(F.sum("n").alias("n"))


def _bounds(group: np.ndarray) -> tuple:
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    return first.tolist(), [*first[1:].tolist(), len(group)] if len(first) else []


# --- orders -----------------------------------------------------------------------------------

def _steps() -> str:
    """All steps of all orders: the subset applied before, and the filter's place and bit."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            place = FILTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "before": before, "place": place, "bit": 1 << place})
            before |= 1 << place
    return json.dumps(out)


def _over_all_orders(place: int) -> str:
    """A filter's removals over all orders: each subset before it, times the orders that have just these before it."""
    bit, last = 1 << place, len(FILTERS) - 1
    terms = [
        f"{factorial(s.bit_count()) * factorial(last - s.bit_count())} * (get(n, {s}).every - get(n, {s | bit}).every)"
        for s in range(SUBSETS) if not s & bit
    ]
    return " + ".join(terms)


def orders(counted: DataFrame) -> DataFrame:
    """One row per part, order and step, from the subset survivors."""
    of = lambda bit: F.sum(F.when(F.col("class").bitwiseAND(bit) > 0, F.col("n")).otherwise(0))
    summed = counted.groupBy("part", "subset").agg(F.sum("n").alias("every"), of(GOOD).alias("good"), of(TOXIC).alias("toxic"))
    # 32 entries per part, in the order of the subsets.
    listed = summed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "every", "good", "toxic"))).alias("n"))
    shares = listed.withColumn("shares", F.array(*[F.expr(_over_all_orders(i)) for i in range(len(FILTERS))]))
    kinds = "array<struct<filter_order: string, step: int, before: int, place: int, bit: int>>"
    opened = shares.select("part", "n", "shares", F.explode(F.from_json(F.lit(_steps()), kinds)).alias("s")).select("part", "n", "shares", "s.*")
    return opened.selectExpr(
        "part", "filter_order", "step",
        "get(n, before | bit).every AS kept",
        "get(n, before).every - get(n, before | bit).every AS removed",
        "get(n, 0).every - get(n, bit).every - get(n, before).every + get(n, before | bit).every AS redundant",
        f"get(n, {SUBSETS - 1} - bit).every - get(n, {SUBSETS - 1}).every AS unique_fails",
        "get(n, before).good - get(n, before | bit).good AS good_lost",
        "get(n, before).toxic - get(n, before | bit).toxic AS toxic_lost",
        "get(shares, place) AS shapley",
    )


def audit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang",
    good: Column | None = None, toxic: Column | None = None,
) -> DataFrame:
    """part, filter_order, step and the counts of each step of each of the 120 orders."""
    good = F.col("quality") == 1 if good is None else good
    toxic = F.col("toxic") == 1 if toxic is None else toxic
    rows = store(measured(docs, key, part, text), "audit")
    return orders(survivors(marked(rows, labels, key, good, toxic)))
