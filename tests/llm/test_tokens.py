"""Byte-level BPE and bit-plane files against the public libraries."""

import base64
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brevis.functions.scale import fresh_dir
from brevis.llm import bitplanes, bpe_words
from brevis.llm.common import tokenizer_file

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    "plain words, and more. Don't we'll", "two  spaces   three", " leading", "trailing ", "tab\tand\nline \n end", "x\u00a0y \u2003z", "", "  ", "\n\n a", "naïve Ñandú 12 345 ¿qué?",
    "emoji 🙂🙃 ok", "a" * 300, "<|endoftext|> is text", "\x00\x1c \x1d.", " \t x", "o'clock 's 't",
]


def rows_of(extra=()):
    texts = [*ODD, "repeat of words " * 30_000, *extra]
    return [(i * 3 % 101, t, "x", "y", 1) for i, t in enumerate(texts)] + [(1000, None, None, None, None)]


def test_words_give_the_library_ids(spark):
    file = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*rows_of(), rows_of()[0], (None, "no key", "x", "y", 1)]
    frame = spark.createDataFrame(rows, DOC).withColumn("ids", F.lit(1)).withColumn("block", F.lit("x"))
    coded = bpe_words.encode(frame, file, ["doc_id"], most=200)
    out = bpe_words.decode(coded.select("doc_id", F.col("ids").alias("own"), "ids"), bpe_words.token_table(spark, file), ["doc_id", "own"]).collect()
    assert len(out) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in out:
        assert np.frombuffer(r["own"], "<u4").tolist() == library.encode_ordinary(texts[r["doc_id"]]), texts[r["doc_id"]][:40]
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
    assert bpe_words.encode(frame.where("false"), file, ["doc_id"]).collect() == []


def test_ids_outside_the_table_are_refused(spark):
    file = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    coded = spark.createDataFrame([(1, bytearray(np.array([5, 4_000_000], "<u4").tobytes()))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="KeyError"):
        bpe_words.decode(coded, bpe_words.token_table(spark, file), ["doc_id"]).collect()


def test_words_get_the_same_places_in_both_passes(monkeypatch):
    monkeypatch.setattr(bpe_words, "CACHED_PARTS", 5)
    one, two = bpe_words.Words(), bpe_words.Words()
    for t in [*ODD, *ODD[::-1], "repeat of words " * 50, "b a b a c"]:
        one.of(t)
        two.note(t)
    assert list(one.place.items()) == list(two.place.items())


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(9), rng.integers(0, 50_000, 1001), rng.integers(0, 1 << 32, 77)):
        planes = bitplanes.shuffle(ids.astype("<u4"), bits)
        assert len(planes) == (32 if bits else 4)
        assert (bitplanes.unshuffle(planes, len(ids)) == ids.astype("<u4")).all()


def test_crc_of_parts():
    data = bytes(range(256)) * 40
    cut = [data[:4], data[4:400], data[400:]]
    assert bitplanes.crc32_of([(zlib.crc32(c), len(c)) for c in cut]) == zlib.crc32(data)


@pytest.mark.parametrize("bits,block", [(False, 1 << 16), (True, 64)])
def test_files_hold_the_stream(spark, bits, block):
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = rows_of(["long " * 300 + "text", "ab <|endoftext|> <unk> cd", "x<|endoftext|>", "a <|endof text|> b"])
    frame = spark.createDataFrame(rows, DOC).withColumn("part", F.lit("x"))
    path = fresh_dir(spark, "planes")
    bitplanes.write(frame, path, tokenizer_file("byte_bpe_50k.json"), bits=bits, block=block)
    got = {r["key"]: (r["start"], r["n_tokens"], r["crc"]) for r in bitplanes.documents(spark, path, block).collect()}
    at, want = 0, {}
    for r in sorted(rows):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want[r[0]] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    index = spark.read.parquet(f"{path}/index")
    assert index.agg(F.sum("n")).first()[0] == at and index.agg(F.max(F.col("base") + F.col("first") + F.col("n"))).first()[0] == at


def test_files_of_ties_and_of_nothing(spark):
    file = tokenizer_file("byte_bpe_50k.json")
    rows = [(7, "b", "x", "y", 1), (7, "a", "x", "y", 1), (7, "a", "x", "y", 1), (None, "z", "x", "y", 1)]
    out = bitplanes.round_trip(spark.createDataFrame(rows, DOC), file).orderBy("start").collect()
    assert [(r["key"], r["start"], r["n_tokens"]) for r in out] == [(None, 0, 2), (7, 2, 2), (7, 4, 2), (7, 6, 2)]
    assert out[1]["crc"] == out[2]["crc"] != out[3]["crc"]
    assert bitplanes.round_trip(spark.createDataFrame([], DOC), file).collect() == []
