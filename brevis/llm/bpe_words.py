"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding
    Texts are cut into pre-tokens (words) by the tokenizer's pattern. Words and their positions are exploded per
    block of texts: a block lists its distinct words once and every document as positions in that
    list, so a word that fills the corpus costs one row per block. The rows are shuffled by word, where
    each distinct word is encoded once, and the ids go back to the blocks, whose documents are
    reassembled by position.
Decoding
    A token-byte table maps ids to bytes. It is bounded by the vocabulary (its size is checked), so the join
    is a broadcast one, done as a gather over whole blocks of ids, and the bytes follow in position order.

Any sequence of ids of the vocabulary decodes, any other id is refused; decoded bytes equal the text's UTF-8. Null and empty texts have no
ids. Repeated rows and null keys are kept as they are. Extra columns can be carried along. A text longer than a
block's bound is a block of its own.
"""

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from brevis.llm.common import release, store, width

BLOCK_BYTES = 32 << 20
LARGEST_VOCABULARY = 1_000_000
CACHED_PARTS = 200_000  # split parts remembered by a task
PACKING = 1  # zstandard level of shuffled positions
#: Fixed value: the splitting pattern. White space is Unicode's, as the encoder's own engine has it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
_TOGETHER = regex.compile(r" (?=\s|\Z)")


@lru_cache(maxsize=1)
def ranks(file: str) -> dict:
    """Bytes -> id of a rank file."""
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def token_table(spark: SparkSession, file: str) -> DataFrame:
    """id, bytes of every token."""
    return spark.createDataFrame([(i, b) for b, i in ranks(file).items()], "id int, bytes binary")


# --- words and positions ----------------------------------------------------------------------

class Words:
    """Distinct words of a block in order of appearance; texts as positions among them.

    A text is cut at single spaces first, where the pattern always cuts; each distinct part is
    then split by the pattern once. A space before white space makes the whole text one part.
    """

    def __init__(self):
        self.place: dict = {}
        self.parts: dict = {}
        self.noted: set = set()

    def _positions(self, part: str) -> bytes:
        place = self.place
        return np.array([place.setdefault(w, len(place)) for w in _SPLIT.findall(part)], "<u4").tobytes()

    def note(self, text: str) -> None:
        """Give the text's words their places, the same as ``of`` does, without the positions."""
        place, noted = self.place, self.noted
        if _TOGETHER.search(text):
            new = [text]
        else:
            head, *rest = text.split(" ")
            new = [head, *(" " + p for p in dict.fromkeys(rest) if p not in noted)]
            if len(noted) > CACHED_PARTS:
                noted.clear()
            noted.update(rest)
        for part in new:
            for w in _SPLIT.findall(part):
                place.setdefault(w, len(place))

    def of(self, text: str) -> bytes:
        if _TOGETHER.search(text):
            return self._positions(text)
        head, *rest = text.split(" ")
        known, out = self.parts, [self._positions(head)]
        for part in rest:
            got = known.get(part)
            if got is None:
                if len(known) > CACHED_PARTS:
                    known.clear()
                got = known[part] = self._positions(" " + part)
            out.append(got)
        return b"".join(out)


def _numbered(batches, text: str, most: int):
    """(block, first of its block, batch, texts): stretches of batches, a new block after ``most`` characters."""
    part, number, size, fresh = TaskContext.get().partitionId() << 32, 0, 0, True
    for b in batches:
        texts = [t or "" for t in b.column(text).to_pylist()]
        start = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= most or i + 1 == len(texts):
                yield part | number, fresh, b.slice(start, i + 1 - start), texts[start : i + 1]
                start, fresh = i + 1, False
                if size >= most:
                    number, size, fresh = number + 1, 0, True


def _packed(positions: bytes) -> bytes:
    """Positions as byte planes under zstandard; empty for none."""
    flat = np.frombuffer(positions, np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=PACKING).compress(np.ascontiguousarray(flat.T).tobytes()) if len(flat) else b""


def _unpacked(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view("<u4")


def _listed(block: int, words: dict):
    """block, at, word batches of a block's list, by word: neighbours share prefixes, which shuffles compactly."""
    order = sorted(words)
    for s in range(0, len(order), 50_000):
        some = order[s : s + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block] * len(some), pa.int64()), pa.array([words[w] for w in some], pa.int32()), pa.array(some, pa.string())],
            ["block", "at", "word"])


def block_words(docs: DataFrame, text: str, most: int = BLOCK_BYTES) -> DataFrame:
    """block, at, word: the distinct words of each block of texts."""

    def run(batches):
        words, block = Words(), None
        for here, fresh, _, texts in _numbered(batches, text, most):
            if fresh and block is not None:
                yield from _listed(block, words.place)
                words = Words()
            block = here
            for t in texts:
                words.note(t)
        if block is not None:
            yield from _listed(block, words.place)
        words = None
        release()

    return docs.select(text).mapInArrow(run, "block long, at int, word string")


def block_texts(docs: DataFrame, keep: list, text: str, most: int = BLOCK_BYTES) -> DataFrame:
    """block, ``keep`` columns and packed positions of each document, in the same blocks as ``block_words``."""

    def run(batches):
        words = Words()
        for block, fresh, part, texts in _numbered(batches, text, most):
            if fresh:
                words = Words()
            packed = pa.array([_packed(words.of(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(texts), pa.int64()), *[part.column(c) for c in keep], packed], ["block", *keep, "positions"])
        words = None
        release()

    out = docs.select(F.lit(0).cast("long").alias("block"), *keep, F.lit(b"").alias("positions")).schema
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, out)


# --- encoding ---------------------------------------------------------------------------------

_PIECES: dict = {}


def _encoder(file: str):
    if file not in _PIECES:
        import tiktoken

        _PIECES[file] = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks(file), special_tokens={})
    return _PIECES[file]


def id_type(file: str) -> str:
    """Two bytes per id while the vocabulary allows, for the way back to the blocks."""
    return "<u2" if max(ranks(file).values(), default=0) < 1 << 16 else "<u4"


def word_ids(words: DataFrame, file: str) -> DataFrame:
    """block, at, size, ids: each distinct word is encoded once, where its rows have met.

    The words of a batch go back to a block in one row: their places, their numbers of ids and the ids
    themselves (as ``id_type`` has them), one after the other.
    """
    met = words.repartition(width(words.sparkSession), "word").sortWithinPartitions("word")
    kind = id_type(file)

    def run(batches):
        one = _encoder(file)._encode_single_piece
        last, own = None, np.zeros(0, kind)
        for b in batches:
            found = []
            for word in b.column("word").to_pylist():
                if word != last:
                    last, own = word, np.array(one(word), kind)
                found.append(own)
            blocks = b.column("block").to_numpy()
            order = np.argsort(blocks, kind="stable")
            at = b.column("at").to_numpy()[order].astype("<i4")
            sizes = np.array([len(found[i]) for i in order.tolist()], "<u4")
            first = np.flatnonzero(np.r_[True, np.diff(blocks[order]) != 0]) if len(order) else np.zeros(0, int)
            spans = list(zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True))
            yield pa.RecordBatch.from_arrays([
                pa.array(blocks[order][first]), pa.array([at[s:e].tobytes() for s, e in spans], pa.binary()),
                pa.array([sizes[s:e].tobytes() for s, e in spans], pa.binary()),
                pa.array([np.concatenate([found[i] for i in order[s:e].tolist()]).tobytes() for s, e in spans], pa.binary()),
            ], ["block", "at", "size", "ids"])

    return met.mapInArrow(run, "block long, at binary, size binary, ids binary")


def encode(
    docs: DataFrame, file: str, keep: list, text: str = "text", most: int = BLOCK_BYTES, scanned: bool = False,
) -> DataFrame:
    """``keep`` columns and ``ids`` (little-endian unsigned 32-bit integers) of every row.

    Words and positions are cut from the same blocks in two passes, so both must see the same rows in the
    same order. Rows straight from files (``scanned``) do; others are stored first.
    """
    if not scanned:
        docs = store(docs.select(*dict.fromkeys([*keep, text])), "bpe-texts")
    texts = block_texts(docs, keep, text, most)
    coded = word_ids(block_words(docs, text, most), file)
    out = texts.select(*keep, F.col("positions").alias("ids")).schema
    kind = id_type(file)

    def run(left, right):
        """One block: its documents' positions, its words' ids."""
        at, own, flat = (
            np.frombuffer(b"".join(right.column(c).to_pylist()), t).astype(np.int64)
            for c, t in (("at", "<i4"), ("size", "<u4"), ("ids", kind)))
        sizes = np.zeros(len(at) + 1, np.int64)
        sizes[at + 1] = own
        starts = np.cumsum(sizes)
        table = np.zeros(starts[-1], "<u4")
        begin = starts[at]
        table[np.repeat(begin - np.r_[0, np.cumsum(own)[:-1]], own) + np.arange(len(flat))] = flat if len(flat) else 0
        for batch in left.to_batches(max_chunksize=2000):
            ids = []
            for packed in batch.column("positions").to_pylist():
                p = _unpacked(packed)
                n = sizes[p + 1]
                ids.append(table[np.repeat(starts[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(ids, pa.binary())], [*keep, "ids"])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.Table.from_batches(list(run(left, right)))
        release()
        return out

    return texts.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(block, out)


# --- decoding ---------------------------------------------------------------------------------

def decode(coded: DataFrame, tokens: DataFrame, keep: list, ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``decoded`` bytes; ``tokens`` is the token-byte table (id, bytes). An id outside it fails the job."""
    rows = tokens.orderBy("id").limit(LARGEST_VOCABULARY + 1).collect()
    if len(rows) > LARGEST_VOCABULARY:
        raise ValueError(f"a token table of more than {LARGEST_VOCABULARY} rows is not broadcast")
    by = {r["id"]: r["bytes"] for r in rows}
    sent = coded.sparkSession.sparkContext.broadcast({i: bytes(b) for i, b in by.items()})
    out = coded.select(*keep, F.col(ids).alias("decoded")).schema

    def run(batches):
        get = sent.value.__getitem__
        for b in batches:
            decoded = [b"".join(map(get, np.frombuffer(v or b"", "<u4").tolist())) for v in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(decoded, pa.binary())], [*keep, "decoded"])

    return coded.mapInArrow(run, out)
