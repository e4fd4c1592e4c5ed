"""Filter audit, resampling by segments and chunk recipes against slow versions on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from brevis.llm import chunk_recipes, filter_audit, segment_resample

DOC = "doc_id long, text string, lang string, n long, part string, score string, name string"
LONG = " ".join(f"w{i}" for i in range(60_000))


def rows_with_everything():
    rnd = random.Random(11)
    vocab = ["red", "blue", "Green", "ÉTÉ", "straße", "ONE", "a&b", "x", "2024", "#1", "日本"]
    say = lambda n: " ".join(rnd.choice(vocab) + (str(rnd.randrange(40)) if rnd.random() < 0.5 else "") for _ in range(n))
    rows = [(i, say(rnd.choice([3, 30, 99, 100, 140, 300])), rnd.choice(["en", "fr", None, ""])) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1], "en") for i in range(40)]  # copies, many of a few texts
    rows += [(200, None, "en"), (201, "", "fr"), (202, "", None), (203, " \t\n\x0b", "en"), (None, rows[0][1], "en"), (None, None, "de")]
    rows += [(5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (6, "another text of key six", "en"), (204, LONG, "en"), (205, LONG + " z", "en")]
    return rows + [(206, LONG, "en"), (207, "line one\nline two\n\nline one\nline\n", "en"), (208, "x\ny z\n\nx y", "de")]


@pytest.fixture(scope="module")
def rows():
    return rows_with_everything()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns clash with the names that the operators use themselves."""
    return spark.createDataFrame([(i, t, p, 1, "x", "y", "z") for i, t, p in rows], DOC).repartition(3)


def empty(docs):
    return docs.where("false")


# --- filter audit -----------------------------------------------------------------------------

def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
    }


def slow_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    tested = []
    for i, t, p in rows:
        f = fails(t or "") | {"E": i is not None and i > first[t or ""]}
        tested.append((p or "", f, any(q == 1 for k, q, _ in labels if k == i and i is not None), any(x == 1 for k, _, x in labels if k == i and i is not None)))
    out, total = {}, Counter()
    for part in {t[0] for t in tested}:
        mine = [t for t in tested if t[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [t for t in left if t[1][x]]
                left = [t for t in left if not t[1][x]]
                every = sum(t[1][x] for t in mine)
                out[part, "".join(order), step] = (
                    len(left), len(gone), every - len(gone), sum(t[1][x] and sum(t[1].values()) == 1 for t in mine),
                    sum(t[2] for t in gone), sum(t[3] for t in gone))
                total[part, x] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(i, i % 3 and 1, int(i % 4 == 0)) for i in range(0, 110, 2)] + [(4, 1, 0), (4, None, None), (None, 1, 1), (999, 1, 1)]


def test_audit_equals_running_every_order(spark, docs, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(docs, labels).collect()
    got = {(r["part"], r["filter_order"], r["step"]): (
        r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in out}
    assert len(out) == len(got) == 600 * len({p or "" for _, _, p in rows})
    assert got == slow_audit(rows, LABELS)


def test_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty(docs), labels).collect() == []
    alone = filter_audit.audit(docs.where("doc_id = 3"), labels)
    assert alone.count() == 600 and alone.where("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("size", [0, 1, 14, 15, 16, 1000, 70_000])
def test_positional_sums(size):
    words = np.random.default_rng(size).integers(0, 1 << 32, size, dtype=np.uint32)
    want = [int(((words >> np.uint32(b)) & 1).sum()) for b in range(32)]
    assert filter_audit.positional(words).tolist() == want


# --- resampling -------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest, buckets):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]


def slow_resample(rows, target, longest, buckets, percent, fewest):
    own = [(i, *features(t, longest, buckets)) for i, t, _ in rows]
    corpus, aim = Counter(b for _, _, f in own for b in f), Counter(b for t in target for b in features(t, longest, buckets)[1])
    s, t = sum(corpus.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((corpus[b] + 1) * (t + buckets)))) for b in range(buckets)}
    out = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= fewest), key=lambda r: (-r[4], r[0] is None, r[0]))
    return out, [(r[0], r[4]) for r in may[: percent * len(may) // 100]]


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (3, 35), (2, 100), (1, 0)])
def test_resampling_equals_whole_texts(spark, docs, rows, longest, percent):
    target = ["red Blue green 2024", "", None, "straße x\nred blue line\n one", "line one"]
    aim = spark.createDataFrame([(i, t, "e") for i, t in enumerate(target)], "item_id long, text string, line string")
    out = segment_resample.resample(docs, aim, longest=longest, buckets=500, percent=percent).collect()
    want, drawn = slow_resample(rows, target, longest, 500, percent, 20)
    assert Counter((r["key"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in out) == Counter(want)
    ranked = sorted((r["rank"], r["key"], r["score"]) for r in out if r["rank"] is not None)
    assert [(k, s) for _, k, s in ranked] == drawn and [p for p, _, _ in ranked] == list(range(1, len(drawn) + 1))


def test_resampling_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert segment_resample.resample(empty(docs), none).collect() == []
    out = segment_resample.resample(docs.where("doc_id >= 200 AND doc_id < 204"), none).collect()
    assert {(r["n_features"], r["weight"], r["rank"]) for r in out} == {(0, 0, None)}


# --- chunk recipes ----------------------------------------------------------------------------

def test_chunks_follow_the_content():
    rnd = random.Random(3)
    body = bytes(rnd.randrange(256) for _ in range(200_000))
    for data in (b"", b"a", body, bytes(100_000), body[:1024], body[:1025]):
        cut = list(chunk_recipes.chunks(data))
        assert b"".join(cut) == data and all(len(c) <= chunk_recipes.MOST for c in cut)
        assert all(len(c) >= chunk_recipes.LEAST for c in cut[:-1])
    plain, moved = set(chunk_recipes.chunks(body)), set(chunk_recipes.chunks(b"some words first" + body))
    assert len(plain) > 20 and len(plain - moved) <= 2  # an insertion changes only the chunks around it


def test_rolling_hash_sees_32_bytes():
    data = bytes(random.Random(5).randrange(256) for _ in range(100))
    want = [sum(int(chunk_recipes.GEAR[data[i - k]]) << k for k in range(min(i + 1, 32))) % (1 << 32) for i in range(100)]
    assert chunk_recipes.rolling(data).tolist() == want


def judged(out):
    return Counter((r["key"], r["keep"], r["group_size"], r["kept"], bytes(r["sha"])) for r in out.collect())


def slow_groups(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    out = Counter()
    for text, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        for n, k in enumerate(sorted(keys, key=lambda k: (k is not None, k), reverse=True)):
            out[k, keep, len(keys), n == 0, hashlib.sha256(text.encode()).digest()] += 1
    return out


def test_recipes_find_equal_texts(docs, rows):
    assert judged(chunk_recipes.judge(docs)) == slow_groups(rows)


def test_recipes_with_names_that_collide(docs, rows):
    """Short identifiers collide; they are given anew until none does, or refused."""
    short = 13
    tries = [chunk_recipes.verified(docs, "text", s, short) for s in range(chunk_recipes.ATTEMPTS)]
    assert not all(tries)
    if any(tries):
        assert judged(chunk_recipes.judge(docs, bits=short)) == slow_groups(rows)
    with pytest.raises(ValueError, match="too short"):
        chunk_recipes.judge(docs, bits=3)


def test_recipes_of_nothing(docs):
    assert chunk_recipes.judge(empty(docs)).collect() == []


def test_long_texts_share_chunks(spark):
    rnd = random.Random(9)
    base = " ".join(str(rnd.randrange(10**6)) for _ in range(20_000))
    docs = spark.createDataFrame([(i, base + ("" if i % 3 else f" {i}")) for i in range(30)], "doc_id long, text string")
    out = {r["key"]: (r["keep"], r["group_size"]) for r in chunk_recipes.judge(docs).collect()}
    assert all(out[i] == ((29, 20) if i % 3 else (i, 1)) for i in range(30))
    assert chunk_recipes.dictionary(docs, "text", 0, chunk_recipes.BITS).count() < len(chunk_recipes.cuts(base.encode())) + 30
