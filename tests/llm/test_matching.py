"""Urls, decontamination, search, near copies and repeated substrings against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevis.llm import debruijn, lsh_forest, multi_index, url_cascade, winnow

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# --- urls -------------------------------------------------------------------------------------

def slow_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("segment", [1 << 26, 128])
def test_cascade_is_exact(spark, monkeypatch, segment):
    monkeypatch.setattr(url_cascade, "SEGMENT_BITS", segment)
    rnd = random.Random(4)
    name = lambda: ".".join(rnd.choice(["a", "b", "cc", "www", "net", "com"]) for _ in range(rnd.randint(1, 4)))
    rules = sorted({(name(), rnd.choice(["/", "/x/", "/y", "/x/z"])) for _ in range(60)})
    rules = [(h, p, rnd.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{name()}{rnd.choice(['', '/', '/x/1', '/y?q=/x/', '/x/z#f', '?a'])}" for _ in range(600)]
    urls += [None, "", "nothing", "HTTP://WWW.Com/X/", "a://", "http://É.com/x/", "http://a.b/x/://c", "http://com/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, key string")
    out = url_cascade.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(out) == len(urls)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow_verdict(r["url"], rules), r["url"]


def test_cascade_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_cascade.judge(pages, none).first()["verdict"] == "allow"
    rules = spark.createDataFrame([("com", "/", "block"), ("com", "/", "allow"), (None, "/", "block")], none.schema)
    assert url_cascade.judge(pages, rules).first()["verdict"] == "block"
    assert url_cascade.judge(pages.where("false"), rules).collect() == []


# --- decontamination --------------------------------------------------------------------------

def slow_hits(words, items):
    hit, found = set(), set()
    for item, w in items:
        if not w:
            continue
        n = min(winnow.SPAN, len(w))
        for k in range(len(w) - n + 1):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(words), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_winnowing_is_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", limit)
    rnd = random.Random(7)
    some = lambda n: [rnd.choice("ab c dé f1".split()) for _ in range(n)]
    items = [(i, some(n)) for i, n in enumerate([1, 2, 3, 7, 12, 13, 14, 20, 40, 13])] + [(20, []), (21, [])]
    docs = [some(rnd.randint(0, 60)) for _ in range(30)]
    docs += [some(10) + items[8][1][5:25] + some(10), items[6][1], [], items[7][1] * 2]
    text = lambda w: ", ".join(w).upper().replace("É", "é")
    rows = [(i, text(w), "x", "y", 1) for i, w in enumerate(docs)] + [(100, None, None, None, None), (None, text(docs[-1]), "x", "y", 1), (3, text(docs[3]), "x", "y", 1)]
    bench = spark.createDataFrame([(i, text(w)) for i, w in items] + [(None, "zz"), (30, None)], "item_id long, text string")
    out = winnow.judge(spark.createDataFrame(rows, DOC).withColumn("words", F.lit(1)), bench).collect()
    assert len(out) == len(rows) and sum(r["key"] == 3 for r in out) == 2
    for r in out:
        words = docs[-1] if r["key"] is None else docs[r["key"]] if r["key"] < 100 else []
        assert (r["n_words"], r["n_hit"], r["items"]) == slow_hits(words, items), r["key"]
    clean = winnow.judge(spark.createDataFrame(rows, DOC), bench.where("false")).collect()
    assert len(clean) == len(rows) and not any(r["n_hit"] for r in clean)


def test_winnowing_runs_no_python(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = winnow.judge(docs, bench)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(n in plan for n in ("Python", "Arrow", "Pandas"))


# --- search -----------------------------------------------------------------------------------

def test_search_is_exact(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 64))
    x = np.vstack([base[rng.integers(0, 6, 300)] + rng.normal(scale=0.6, size=(300, 64)), np.tile(base[0], (40, 1))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0] * 3), (None, [1.0] * 64), (902, [float("nan")] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumn("code", F.lit("x"))
    coded = multi_index.codes(frame, "vec_id", "v").cache()
    codes = {r["id"]: r["code"] & (1 << 64) - 1 for r in coded.collect()}
    assert set(codes) == set(range(340))
    assert codes[7] == sum(1 << i for i in range(64) if x[7, i] > x[:, i].mean())
    out = multi_index.search(coded, coded.where("id % 20 = 0"), 5).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    for q in range(0, 340, 20):
        want = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, d, i) for n, (d, i) in enumerate(want)]


def test_search_in_few_rows(spark):
    few = spark.createDataFrame([(0, 5), (1, 7)], "id long, code long")
    assert [tuple(r) for r in multi_index.search(few, few, 10).orderBy("query_id").collect()] == [(0, 1, 1, 1), (1, 1, 0, 1)]
    assert multi_index.search(few.where("false"), few.where("false"), 10).collect() == []


def test_search_with_repeated_ids(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.getrandbits(63)) for i in range(30)]
    rows += [rows[0]] * 11 + [rows[1]] + [(2, rnd.getrandbits(63)), (3, rows[0][1])]
    coded = spark.createDataFrame(rows, "id long, code long")
    out = {}
    for r in multi_index.search(coded, coded.where("id < 3"), 10).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    for q in range(3):
        apart = {}
        for i, c in rows:
            for j, d in rows:
                if j == q and i != q:
                    apart[i] = min(apart.get(i, 64), (c ^ d).bit_count())
        want = sorted((d, i) for i, d in apart.items())[:10]
        assert sorted(out[q]) == [(n + 1, d, i) for n, (d, i) in enumerate(want)]


# --- near copies ------------------------------------------------------------------------------

def slow_components(rows, words, percent):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    lead = {k: k for k in sets}

    def find(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                lead[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("words,percent,limit", [(3, 85, 1_000_000), (5, 80, 0)])
def test_forest_finds_all_components(spark, monkeypatch, words, percent, limit):
    monkeypatch.setattr(lsh_forest, "BROADCAST_KEYS", limit)
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([40, 150, 400]))]
        for _ in range(rnd.choice([1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append(" ".join(copy))
    texts += ["One two", "one  TWO", "one", "", None, "É x y z", "é x y z", "a b c d e f " * 3000, "a b c d e f " * 2000]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows] + [(None, texts[0], "x", "y", 1)], DOC).withColumn("key", F.lit(1))
    out = lsh_forest.near_duplicates(frame, words=words, percent=percent).collect()
    assert len(out) == len(rows) + 1
    want = slow_components(rows, words, percent)
    for r in out:
        if r["key"] is None:
            assert r["component"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component"]) == want[r["key"]], r["key"]
            assert r["kept"] == (r["key"] == r["component"])
    assert lsh_forest.near_duplicates(frame.where("false")).collect() == []


def test_forest_finds_partners_in_a_dense_family(spark):
    """A shared template: all pairs lie just below the threshold but the planted ones."""
    rnd = random.Random(13)
    template = [f"t{i}" for i in range(180)]
    texts = []
    for i in range(1500):
        own = [f"d{i}x{j}" for j in range(20)]
        texts.append(" ".join(template + own))
        if i % 15 == 0:
            texts.append(" ".join(template + own[:12] + [f"e{i}x{j}" for j in range(8)]))
    rnd.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    by_own = {}
    for i, t in enumerate(texts):
        by_own.setdefault(t.split()[180], []).append(i)
    want = {i: min(g) for g in by_own.values() for i in g}
    pairs = [g for g in by_own.values() if len(g) == 2]
    assert len(pairs) == 100
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert min(alike(*g) for g in pairs) >= 0.85 > max(alike(0, i) for i in range(1, 400) if want[i] != want[0])
    out = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert {r["key"]: r["component"] for r in out} == want


def test_components_of_a_long_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in lsh_forest.components(links).collect()} == {0}


# --- repeated substrings ----------------------------------------------------------------------

def slow_kept(texts):
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - debruijn.WINDOW + 1):
            k = tuple(w[i : i + debruijn.WINDOW])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - debruijn.WINDOW + 1):
            if seen[tuple(w[i : i + debruijn.WINDOW])] > 1:
                gone[i : i + debruijn.WINDOW] = [True] * debruijn.WINDOW
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


@pytest.mark.parametrize("stretch", [150_000, 64])
def test_repeated_words_are_removed(spark, monkeypatch, stretch):
    monkeypatch.setattr(debruijn, "STRETCH", stretch)  # the driver's own process runs the piece functions in the second test
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(300)] + ["é", "x\u00a0y"]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    shared = [some(n) for n in (34, 35, 36, 60, 120, 200)]
    texts = []
    for _ in range(50):
        parts = some(rnd.randint(0, 50))
        for _ in range(rnd.randint(0, 2)):
            s = rnd.choice(shared)
            at = rnd.randint(0, len(s) - 1)
            parts += s[at : at + rnd.randint(20, 200)] + some(rnd.randint(0, 30))
        texts.append(rnd.choice([" ", "\n ", "\t"]).join(parts))
    texts += ["same " * 90, "a b " * 60, None, "", texts[3], " ".join(shared[5] + shared[5])]
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", "y", 1), (None, texts[5], "x", "y", 1)]
    want = slow_kept([r[1] for r in rows])
    out = debruijn.remove(spark.createDataFrame(rows, DOC).withColumn("spans", F.lit(1)))
    got = sorted([(-1 if r["key"] is None else r["key"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()])
    assert got == sorted((-1 if r[0] is None else r[0], *w) for r, w in zip(rows, want, strict=True))
    assert debruijn.remove(spark.createDataFrame([], DOC)).collect() == []


def test_stretches_give_the_same_edges(monkeypatch):
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(40)}".encode() for _ in range(400)]
    whole = debruijn.pieces_of([words])
    monkeypatch.setattr(debruijn, "STRETCH", 70)
    cut, where = debruijn._stretched([b" ".join(words)])
    parts = debruijn.pieces_of(cut)
    edges = lambda at, many: sorted(e for a, m in zip(at, many, strict=True) for e in range(a, a + m))
    assert edges(whole[3], whole[4]) == list(range(400 - debruijn.WINDOW + 1))
    assert edges(parts[3] + where[parts[2], 1], parts[4]) == edges(whole[3], whole[4])
