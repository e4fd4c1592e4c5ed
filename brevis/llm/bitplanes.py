"""Token ids in bit-plane files.

Texts are encoded with the tokenizers library, an end id closes each document, and the ids of all
documents in key order form one stream. The stream is cut into blocks of ``BLOCK`` ids (the last block of
a part may be shorter); a block is transposed into planes, one per bit or per byte of the ids, and each
plane is compressed by zstandard on its own.

Files
-----
``chunks``: one row per block: ``part``, ``seq`` (number in its part), ``first`` (ids before it in the
part), ``n`` (ids), ``planes`` (compressed planes, lowest first, empty where every bit is zero), and for
the documents that start in the block ``doc_key``, ``doc_start`` (in the part) and ``doc_n``.
``index``: one row per block without the planes and documents: ``part``, ``seq``, ``first``, ``n``,
``bytes``, and ``base``, the ids before its part, so a range of ids is found without reading planes.

Parts are ranges of the key in ascending order; rows with null keys come first. A null text is empty
and has only its end id. Rows that share a key follow each other in the order of their texts. An empty table gives
empty files. Extra columns are ignored. A part is written as a stream of blocks, so a task holds one
batch of texts and one block however large its range is.
"""

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brevis.functions.scale import fresh_dir
from brevis.llm.common import pieces, store, width

BLOCK = 1 << 16
LEVEL = 3
RANGE_CHARACTERS = 16  # of a text that tell rows of one key apart when the rows are dealt out; the order is by the whole text
_WORDS = 1_000_000  # remembered words of a task


# --- planes -----------------------------------------------------------------------------------

def shuffle(ids: np.ndarray, bits: bool = False) -> list:
    """Compressed planes of unsigned 32-bit ids: 4 byte planes, or 32 bit planes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        planes = [np.packbits(raw[:, b // 8] >> (b % 8) & 1, bitorder="little") for b in range(32)]
    else:
        planes = [np.ascontiguousarray(raw[:, b]) for b in range(4)]
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return [pack(p.tobytes()) if p.any() else b"" for p in planes]


def unshuffle(planes: list, n: int) -> np.ndarray:
    """The ids of a block from its planes."""
    raw = np.zeros((n, 4), np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    for b, plane in enumerate(planes):
        if plane and len(planes) == 4:
            raw[:, b] = np.frombuffer(unpack(plane), np.uint8)
        elif plane:
            raw[:, b // 8] |= np.unpackbits(np.frombuffer(unpack(plane), np.uint8), count=n, bitorder="little") << (b % 8)
    return raw.reshape(-1).view("<u4")


# --- encoding ---------------------------------------------------------------------------------

def _byte_letters() -> dict:
    """Byte value -> letter of the byte-level alphabet: visible Latin-1 signs stand for themselves, the others for U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts; each distinct space-separated word is given to the library once.

    The byte-level splitting pattern never joins what a single space followed by a visible character separates,
    so the ids of such a text are those of its words, each with its space. A word of letters, with or without
    closing punctuation, is one or two pre-tokens and goes straight to the library's model; any other word goes through
    the whole tokenizer. A text in which a space is followed by white space, or which holds an added token of the
    tokenizer, is encoded whole.
    """

    _TOGETHER = re.compile(r" (?=\s|\Z)")
    _LETTERS = _byte_letters()
    _PUNCTUATION = ".,;:!?()[]{}|#$%&*+-/<=>@^_~"

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.known: dict = {}
        self.endings: dict = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, text: str) -> bytes:
        """One pre-token by the model alone."""
        if not text.isascii() or text[0] == " ":
            text = text.encode().decode("latin-1").translate(self._LETTERS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word that a space precedes; remembered."""
        got = self.known.get(word)
        if got is None:
            stem = word.rstrip(self._PUNCTUATION)
            if not (stem.isalpha() and max(stem) < "\u0530"):
                got = self._whole(" " + word)
            elif stem == word:
                got = self._letters(" " + word)
            else:
                rest = word[len(stem):]
                if rest not in self.endings:
                    if len(self.endings) > 10_000:
                        self.endings.clear()
                    self.endings[rest] = self._letters(rest)
                got = self.word(stem) + self.endings[rest]
            self.known[word] = got
        return got

    def encode(self, texts: list, end: int | None = 0) -> list:
        """Little-endian 32-bit ids of each text as bytes, closed by ``end``."""
        close = b"" if end is None else int(end).to_bytes(4, "little")
        out = []
        for text in texts:
            if self._TOGETHER.search(text) or (self.added and self.added.search(text)):
                out.append(self._whole(text) + close)
                continue
            if len(self.known) > _WORDS:
                self.known.clear()
            first, *words = text.split(" ")
            ids = list(map(self.known.get, words))
            if None in ids:
                ids = [self.word(w) if i is None else i for w, i in zip(words, ids, strict=True)]
            out.append((self._whole(first) if first else b"") + b"".join(ids) + close)
        return out


_ENCODERS: dict = {}


def encoder(file: str) -> Encoder:
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


# --- files ------------------------------------------------------------------------------------

CHUNK = "part int, seq long, first long, n int, planes array<binary>, doc_key array<{}>, doc_start array<long>, doc_n array<long>"


def write(
    docs: DataFrame, path: str, file: str, key: str = "doc_id", text: str = "text", end: int | None = 0, bits: bool = False,
    block: int = BLOCK,
) -> None:
    """Encode ``docs`` and write ``chunks`` and ``index`` under ``path``."""
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = slim.schema["key"].dataType
    # The ranges are sampled in the driver: by the key and the begin of the text, so that the sample stays small.
    begin = F.substring("text", 1, RANGE_CHARACTERS)
    ordered = slim.repartitionByRange(width(spark), F.col("key").asc_nulls_first(), begin).sortWithinPartitions(
        F.col("key").asc_nulls_first(), "text")
    schema = CHUNK.format(kind.simpleString())

    def run(batches):
        code = encoder(file)
        part = TaskContext.get().partitionId()
        held, size, seq, first, at = [], 0, 0, 0, 0
        starts: list = []  # key, start and size of documents whose block is not written yet

        def chunk(ids: np.ndarray):
            nonlocal seq, first, starts
            upto = first + len(ids)
            here = [s for s in starts if s[1] < upto]
            starts = starts[len(here):]
            columns = [[part], [seq], [first], [len(ids)], [shuffle(ids, bits)], *[[[s[i] for s in here]] for i in range(3)]]
            seq, first = seq + 1, upto
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

        for b in batches:
            types = pa.schema([
                ("part", pa.int32()), ("seq", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("planes", pa.list_(pa.binary())),
                ("doc_key", pa.list_(b.schema.field("key").type)), ("doc_start", pa.list_(pa.int64())), ("doc_n", pa.list_(pa.int64()))])
            for some in pieces(b, "text", 1 << 20):
                for k, ids in zip(some.column("key").to_pylist(), code.encode(some.column("text").to_pylist(), end), strict=True):
                    starts.append((k, at, len(ids) // 4))
                    at += len(ids) // 4
                    held.append(ids)
                    size += len(ids) // 4
                if size >= block:
                    stream = np.frombuffer(b"".join(held), "<u4")
                    full = size - size % block
                    for s in range(0, full, block):
                        yield chunk(stream[s : s + block])
                    held, size = [stream[full:].tobytes()], size % block
        if size:
            yield chunk(np.frombuffer(b"".join(held), "<u4"))

    ordered.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    chunks = spark.read.schema(schema).parquet(f"{path}/chunks")
    sized = chunks.select("part", "seq", "first", "n", F.aggregate(
        "planes", F.lit(0).cast("long"), lambda a, p: a + F.length(p)).alias("bytes"))
    totals = sized.groupBy("part").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per written part
    bases = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base"))
    sized.join(F.broadcast(bases), "part").write.parquet(f"{path}/index")


def _read(spark: SparkSession, path: str) -> tuple:
    """Chunks with their base, and the type of the keys."""
    chunks = spark.read.parquet(f"{path}/chunks")
    bases = spark.read.parquet(f"{path}/index").select("part", "base").distinct()
    return chunks.join(F.broadcast(bases), "part"), chunks.schema["doc_key"].dataType.elementType.simpleString()


def read_pieces(spark: SparkSession, path: str, digest=None, kind: str = "binary") -> DataFrame:
    """One row per block: the documents that start in it, each with its piece of the block.

    ``pieces`` are the ids' bytes, or ``digest`` of them; ``lead`` is the same for the ids before the first
    start, which belong to a document of an earlier block.
    """
    chunks, key = _read(spark, path)
    take = digest or (lambda ids: ids)
    schema = "base long, part int, first long, n int, key array<{0}>, start array<long>, size array<long>, pieces array<{1}>, lead {1}, n_lead long".format(key, kind)

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                ids = unshuffle(r["planes"], r["n"])
                begin = [s - r["first"] for s in r["doc_start"]]
                stop = [min(s + n, r["n"]) for s, n in zip(begin, r["doc_n"], strict=True)]
                lead = min(begin, default=r["n"])
                out.append({
                    "base": r["base"], "part": r["part"], "first": r["first"], "n": r["n"], "key": r["doc_key"], "start": r["doc_start"],
                    "size": r["doc_n"], "pieces": [take(ids[s:e].tobytes()) for s, e in zip(begin, stop, strict=True)],
                    "lead": take(ids[:lead].tobytes()), "n_lead": lead,
                })
            yield pa.RecordBatch.from_pylist(out, schema=types(b))

    def types(b):
        own = pa.binary() if kind == "binary" else pa.int64()
        return pa.schema([
            ("base", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("key", b.schema.field("doc_key").type),
            ("start", pa.list_(pa.int64())), ("size", pa.list_(pa.int64())), ("pieces", pa.list_(own)), ("lead", own), ("n_lead", pa.int64())])

    return chunks.mapInArrow(run, schema)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


def _advance(crc: int, n: int) -> int:
    """A crc register after ``n`` zero bytes, by squaring the one-bit step's matrix over GF(2)."""
    def times(m, v):
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
        return out

    step = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit
    bits = n * 8
    while bits:
        if bits & 1:
            crc = times(step, crc)
        step = [times(step, row) for row in step]
        bits >>= 1
    return crc


def crc32_of(parts: list) -> int:
    """crc32 of a concatenation from (crc32, bytes) of its parts."""
    out = parts[0][0]
    for crc, n in parts[1:]:
        out = _advance(out, n) ^ crc
    return out


def documents(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """key, start, n_tokens, crc32 of every document, from the files."""
    read = store(read_pieces(spark, path, crc32, "long"), "crcs")  # a few numbers per document
    begun = read.select("base", "part", F.explode(F.arrays_zip("key", "start", "size", "pieces")).alias("d"),
                        (F.col("first") + F.col("n")).alias("upto")).select(
        "part", F.col("d.key").alias("key"), F.col("d.start").alias("at"), F.col("d.size").alias("n_tokens"),
        (F.col("base") + F.col("d.start")).alias("start"), F.col("d.pieces").alias("crc"),
        (F.least(F.col("upto"), F.col("d.start") + F.col("d.size")) - F.col("d.start")).alias("have"))
    whole = begun.where("have = n_tokens")
    cut = begun.where("have < n_tokens")
    # What a cut document has in later blocks: every full block between, and the lead of its last one.
    places = cut.withColumn("block", F.explode(F.expr(f"sequence((at + have) div {block}, (at + n_tokens - 1) div {block})")))
    lead = read.where("n_lead > 0").select("part", (F.col("first") / block).cast("long").alias("block"), "lead", "n_lead")
    rest = places.join(lead, ["part", "block"]).groupBy("part", "at").agg(
        F.array_sort(F.collect_list(F.struct("block", "lead", "n_lead"))).alias("rest"))

    @F.udf("long")
    def joined(first, have, rest):  # documents that cross a block only
        return crc32_of([(first, have * 4), *[(r["lead"], r["n_lead"] * 4) for r in rest]])

    mended = cut.join(rest, ["part", "at"]).withColumn("crc", joined("crc", "have", "rest"))
    names = ["key", "start", "n_tokens", "crc"]
    return whole.select(*names).unionAll(mended.select(*names))


def round_trip(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files into the shared folder and read the documents back."""
    spark = docs.sparkSession
    path = fresh_dir(spark, "planes")
    write(docs, path, file, key, text)
    return documents(spark, path)
