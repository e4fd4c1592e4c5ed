"""Substring deduplication by De Bruijn compaction.

Every run of ``WINDOW`` words is an edge (k-mer) of a De Bruijn graph over word sequences. Edges are handled in pieces:
the consecutive edges of a text that share a minimiser (the smallest hash among their ``SEED``-word runs). Equal edges
have equal minimisers, so only the pieces of a repeated minimiser can hold repeated edges.

1. Texts emit pieces: minimiser, signature of the whole piece, and source coordinates (row, first word, edges).
2. Counting joins compact: where all sources of a minimiser have one signature, the path does not branch and
   each source's piece is one repeated path. Where they differ, the path branches; those pieces are opened into single
   edges from their source coordinates, hashed anew over their full word sequence, and counted.
3. Repeated paths and repeated edges meet per row as spans; the words they cover are repeated.

Only minimisers (about one per twelve words) and the edges of branching pieces are shuffled by content, always behind
map-side counts; hot minimisers are split by the skewed join. Texts are shuffled by row, and never grouped by content.
Sequences are compared by two independent 64-bit hashes (minimiser and piece, or minimiser and edge).

Null texts have no words. Rows with equal key and text are separate rows whose windows repeat each other. Keys may be null.
Texts shorter than a window repeat nothing. Very long texts are cut into overlapping stretches, which changes pieces
but not results. Extra columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brevis.llm.common import pieces, raw_texts, store

WINDOW = 35
SEED = 12
STRETCH = 150_000  # words handled at once
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Hash of any byte range of a buffer from prefix sums; equal ranges hash alike wherever they stand."""

    letters = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    up = down = np.ones(1, np.uint64)

    def __init__(self, buffer: np.ndarray):
        n = len(buffer) + 1
        if len(Hasher.up) < n:
            size = max(n, 1 << 21)
            base, inverse = _ODD, pow(_ODD, -1, 1 << 64)
            for name, step in (("up", base), ("down", inverse)):
                table = np.full(size, step, np.uint64)
                table[0] = 1
                setattr(Hasher, name, np.cumprod(table, dtype=np.uint64))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.letters[buffer] * self.up[: n - 1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _laid_out(stretches: list) -> tuple:
    """Buffer of all words joined by spaces; start and end of each word, and its stretch."""
    buffer = np.frombuffer(b" ".join(w for words in stretches for w in words) + b" ", np.uint8)
    end = np.flatnonzero(buffer == 32)
    start = np.r_[0, end[:-1] + 1]
    sizes = np.array([len(words) for words in stretches])
    return buffer, start, end, np.repeat(np.arange(len(stretches)), sizes), np.r_[0, np.cumsum(sizes)[:-1]]


def _sliding_min(x: np.ndarray, reach: int) -> np.ndarray:
    size = 1
    while size * 2 <= reach:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (reach - size)], x[reach - size :]) if size < reach else x


def pieces_of(stretches: list) -> tuple:
    """minimiser, signature, stretch, first word and number of edges of every piece."""
    none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    stretches = [w if len(w) >= WINDOW else [] for w in stretches]
    if not any(stretches):
        return none
    buffer, start, end, owner, first = _laid_out(stretches)
    n = len(start)
    hashed = Hasher(buffer)
    seeds = hashed.of(start[: n - SEED + 1], end[SEED - 1 :])
    low = np.uint64(0xFFFFFF)  # places; the leftmost of equal seeds wins
    packed = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64)
    least = _sliding_min(packed, WINDOW - SEED + 1)
    at = (least & low).astype(np.int64)
    fits = owner[: n - WINDOW + 1] == owner[WINDOW - 1 :]
    begins = fits & np.r_[True, (at[1:] != at[:-1]) | (owner[1 : len(at)] != owner[: len(at) - 1]) | ~fits[:-1]]
    s = np.flatnonzero(begins)
    if not len(s):
        return none
    # A piece lasts until the next begins or its text has no further window.
    stop = np.r_[s[1:], len(fits)]
    many = np.add.reduceat(fits.astype(np.int64), s)
    many = np.minimum(many, stop - s)
    sign = hashed.of(start[s], end[s + many - 1 + WINDOW - 1])
    return seeds[at[s]], sign, owner[s], s - first[owner[s]], many


def _stretched(texts: list) -> tuple:
    """Words of each text in stretches that overlap by a window less one word; (text, offset) of each."""
    out, where = [], []
    for i, t in enumerate(texts):
        words = t.split()
        for at in range(0, max(1, len(words) - WINDOW + 1), STRETCH):
            out.append(words[at : at + STRETCH + WINDOW - 1])
            where.append((i, at))
    return out, np.array(where, np.int64).reshape(-1, 2)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, sign (hash of the text), text."""
    return docs.select(
        F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(7)).alias("sign"), F.col(text).alias("text"))


def all_pieces(rows: DataFrame) -> DataFrame:
    """least, piece, key, sign, at, many: every piece of every text."""

    def run(batches):
        for b in batches:
            for part in pieces(b, "text", 1 << 20):
                stretches, where = _stretched(raw_texts(part.column("text")))
                if not len(where):
                    continue
                least, sign, owner, at, many = pieces_of(stretches)
                rows_of = pa.array(where[owner, 0])
                yield pa.RecordBatch.from_arrays([
                    pa.array(least.view(np.int64)), pa.array(sign.view(np.int64)), part.column("key").take(rows_of), part.column("sign").take(rows_of),
                    pa.array((at + where[owner, 1]).astype(np.int32)), pa.array(many.astype(np.int32)),
                ], ["least", "piece", "key", "sign", "at", "many"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"least long, piece long, key {kind}, sign long, at int, many int")


def _edges(rows: DataFrame) -> DataFrame:
    """edge, key, sign, at: the single edges of the listed pieces (``spans``) of each text."""

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                words = (b.column("text").slice(row, 1).cast(pa.binary())[0].as_py() or b"").split()
                spans = b.column("spans")[row].as_py()
                at = np.unique(np.concatenate([np.arange(s["at"], s["at"] + s["many"]) for s in spans]))
                edges = np.zeros(len(at), np.uint64)
                for lo in range(0, len(words), STRETCH):
                    mine = (at >= lo) & (at < lo + STRETCH)
                    if mine.any():
                        buffer, start, end, _, _ = _laid_out([words[lo : lo + STRETCH + WINDOW]])
                        edges[mine] = Hasher(buffer).of(start[at[mine] - lo], end[at[mine] - lo + WINDOW - 1])
                where = pa.array(np.zeros(len(at), np.int64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(edges.view(np.int64)), b.column("key").slice(row, 1).take(where), b.column("sign").slice(row, 1).take(where),
                    pa.array(at.astype(np.int32))], ["edge", "key", "sign", "at"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"edge long, key {kind}, sign long, at int")


def _spans(rows: DataFrame, name: str = "spans") -> DataFrame:
    """One row per text row: its pieces (bounded by the text)."""
    return rows.groupBy("key", "sign").agg(F.collect_list(F.struct("at", "many")).alias(name))


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["key"].eqNullSafe(right["key"]) & (left["sign"] == right["sign"])


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sign, text and ``spans`` (at, many): the repeated windows of every row; null where none."""
    rows = _keyed(docs, key, text)
    found = store(all_pieces(rows), "pieces")
    # Counts are stored before they are joined back: a join whose sides both come straight from a shuffle can split hot keys.
    counted = store(found.groupBy("least").agg(
        F.count("*").alias("n"), F.min("piece").alias("low"), F.max("piece").alias("high")).where("n >= 2"), "minimisers")
    met = store(
        found.select("least", "key", "sign", "at", "many")
        .join(counted.select("least", (F.col("low") != F.col("high")).alias("branches")), "least")
        .select("key", "sign", "at", "many", "branches"), "paths")
    opened = _spans(met.where("branches"))
    # Rows that are equal in key and text share one list; each of them emits its own edges.
    branching = store(_edges(
        rows.join(opened, _same_row(rows, opened)).select(rows["key"], rows["sign"], rows["text"], "spans")), "edges")
    twice = store(branching.groupBy("edge").agg(F.count("*").alias("n")).where("n >= 2").select("edge"), "repeated-edges")
    single = branching.join(twice, "edge").select("key", "sign", "at", F.lit(1).alias("many"))
    spans = _spans(met.where("NOT branches").select("key", "sign", "at", "many").unionAll(single))
    return rows.join(spans, _same_row(rows, spans), "left").select(rows["key"], rows["sign"], rows["text"], "spans")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """key, n_words, n_removed and the kept words joined by spaces (``kept``), or their SHA-256."""
    rows = repeated(docs, key, text)

    def run(batches):
        for b in batches:
            count, gone, kept = [], [], []
            for t, spans in zip(raw_texts(b.column("text")), b.column("spans").to_pylist(), strict=True):
                words = t.split()
                removed = 0
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [s["at"] for s in spans], 1)
                    np.add.at(edge, [min(len(words), s["at"] + s["many"] - 1 + WINDOW) for s in spans], -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    removed = len(words) - int(stay.sum())
                    count.append(len(words))
                    words = [words[i] for i in np.flatnonzero(stay)]
                else:
                    count.append(len(words))
                gone.append(removed)
                joined = b" ".join(words)
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             ["key", "n_words", "n_removed", "kept"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "text", "spans").mapInArrow(run, f"key {kind}, n_words long, n_removed long, kept string")
