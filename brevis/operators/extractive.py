"""Extractive shortening: rank sentences inside each document, keep the best ones in order.

Ranking the sentences of a document needs nothing outside its row, so every ranking here is a column
expression over the document: no word is exploded and no text is shuffled, whatever the corpus size.
"""

import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as Y

from brevis import constants as K
from brevis.functions import text as T
from brevis.functions.scale import unfold

DOUBLES = Y.ArrayType(Y.DoubleType())
SCORE_PLACES = 9  # float sums depend on their order; ranks must not


def sentence_rows(df: DataFrame) -> DataFrame:
    """(id, pos, sentence), positions from 0 in document order."""
    return unfold(df, ["id"], T.sentences(F.col("document")), "pos", "sentence")


def _word_arrays(document: Column) -> Column:
    """The ranking words of every sentence: array of arrays."""
    return F.transform(T.sentences(document), T.rank_words)


def luhn_array(document: Column) -> Column:
    """Each sentence's best cluster of words that occur more than once in the document.

    A cluster runs on until LUHN_GAP words in a row are insignificant; its value is hits^2 / length.
    """
    def closed(state: Column) -> Column:
        value = state["hits"] * state["hits"] / (state["last"] - state["start"] + 1)
        return F.greatest(state["best"], F.when(state["hits"] > 1, value).otherwise(0.0))

    def state(start, last, hits, best) -> Column:
        return F.struct(
            start.cast("int").alias("start"), last.cast("int").alias("last"),
            hits.cast("int").alias("hits"), best.cast("double").alias("best"),
        )

    def step(acc: Column, p: Column) -> Column:
        return F.when(p - acc["last"] > K.LUHN_GAP, state(p, p, F.lit(1), closed(acc))).otherwise(
            state(acc["start"], p, acc["hits"] + 1, acc["best"])
        )

    def best(row_words: Column, often: Column) -> Column:
        marked = T.let(
            F.array_intersect(row_words, often),
            lambda held: F.array_compact(F.transform(row_words, lambda w, i: F.when(F.array_contains(held, w), i))),
        )
        nothing = state(F.lit(0), F.lit(-K.LUHN_GAP - 1), F.lit(0), F.lit(0.0))
        return F.round(F.aggregate(marked, nothing, step, closed), SCORE_PLACES)

    def of_words(rows: Column) -> Column:
        repeated = F.transform(F.filter(T.runs(F.flatten(rows)), lambda r: r["n"] > 1), lambda r: r["word"])
        return T.let(repeated, lambda often: F.transform(rows, lambda row_words: best(row_words, often)))

    return T.let(_word_arrays(document), of_words)


def lsa_array(document: Column) -> Column:
    """Salience of each sentence with all latent dimensions kept.

    With every singular value kept, sqrt(sum sigma^2 v^2) is the length of the sentence's column in
    the smoothed term-frequency matrix, which needs only three sums per sentence and the vocabulary
    size of the document.
    """
    low, high = K.LSA_SMOOTH, 1 - K.LSA_SMOOTH

    def salience(counts: Column, vocab: Column) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
        squares = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n.cast("long") * n)
        top = F.greatest(F.array_max(counts), F.lit(1))
        value = F.lit(low * low) * vocab + F.lit(2 * low * high) * total / top + F.lit(high * high) * squares / (top * top)
        return F.round(F.sqrt(value), SCORE_PLACES)

    def of_words(rows: Column) -> Column:
        counts = lambda ws: F.transform(T.runs(ws), lambda r: r["n"])
        return T.let(
            F.size(F.array_distinct(F.flatten(rows))),
            lambda vocab: F.transform(rows, lambda ws: T.let(counts(ws), lambda c: salience(c, vocab))),
        )

    return T.let(_word_arrays(document), of_words)


#: Sentences, and sentences times words, up to which a document's counts are held as a filled matrix.
DENSE_LINES, DENSE = 1000, 2_000_000


def _coded(lines: list[str]) -> tuple:
    """Number and sentence of every word, number of words of each sentence, number of different words; words by first appearance."""
    codes: dict[str, int] = {}
    split = [line.split() for line in lines]
    word = np.array([codes.setdefault(w, len(codes)) for row in split for w in row], dtype=np.int64)
    sizes = np.array([len(row) for row in split], dtype=np.int64)
    return word, np.repeat(np.arange(len(lines)), sizes), sizes, len(codes)


def _luhn(word: np.ndarray, owner: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """``luhn_array`` of coded sentences."""
    best = np.zeros(len(sizes))
    often = np.flatnonzero(np.bincount(word, minlength=words)[word] > 1)
    if not len(often):
        return best
    line = owner[often]
    begins = np.ones(len(often), dtype=bool)  # a word's place in the text tells gaps within a sentence as well
    begins[1:] = (line[1:] != line[:-1]) | (np.diff(often) > K.LUHN_GAP)
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(often)) - 1
    hits = last - first + 1
    np.maximum.at(best, line[first], np.where(hits > 1, hits * hits / (often[last] - often[first] + 1), 0.0))
    return best


def _salience(word: np.ndarray, owner: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """``lsa_array`` of coded sentences."""
    low, high, size = K.LSA_SMOOTH, 1 - K.LSA_SMOOTH, len(sizes)
    entries, counts = np.unique(owner * max(words, 1) + word, return_counts=True)
    line, top = entries // max(words, 1), np.ones(size, dtype=np.int64)
    np.maximum.at(top, line, counts)
    total, squares = np.bincount(line, counts, size), np.bincount(line, counts * counts, size)
    return np.sqrt(low * low * words + 2 * low * high * total / top + high * high * squares / (top * top))


def _dense_ranks(word: np.ndarray, owner: np.ndarray, sizes: np.ndarray, words: int, damping: float, rounds: int) -> np.ndarray:
    """``_overlap_ranks`` of a document whose counts fit a matrix."""
    total = len(sizes)
    counts = np.bincount(owner * words + word, minlength=total * words).reshape(total, words).astype(float)
    logs = np.log(np.maximum(sizes, 1))
    norm = logs[:, None] + logs[None, :]
    norm[norm == 0] = 1.0
    weight = counts @ counts.T / norm
    out = weight.sum(axis=1)
    out[out == 0] = 1.0
    weight /= out
    ranks = np.full(total, 1.0 / total)
    for _ in range(rounds):
        ranks = (1 - damping) / total * ranks.sum() + damping * (weight @ ranks)
    return ranks


def _overlap_ranks(lines: list[str], damping: float, rounds: int) -> np.ndarray:
    """Damped ranks over the word-overlap graph; of long documents without building the graph.

    The weight of two sentences is (shared word pairs) / (ln a + ln b). The denominator depends on
    the two lengths only, so a round first sums the ranks per (word, sentence length) slot, then
    every sentence reads the slots of its own words: work grows with words x distinct lengths, not
    with sentence pairs.
    """
    return _ranks(*_coded(lines), damping, rounds)


def _ranks(word: np.ndarray, owner: np.ndarray, sizes: np.ndarray, words: int, damping: float, rounds: int) -> np.ndarray:
    total = len(sizes)
    ranks = np.full(total, 1.0 / total)
    if word.size == 0:  # no edges: every round only keeps the undamped share
        return ranks * (1 - damping) ** rounds
    if total <= DENSE_LINES and total * words <= DENSE:
        return _dense_ranks(word, owner, sizes, words, damping, rounds)
    lengths, kind = np.unique(sizes, return_inverse=True)
    logs = np.log(np.maximum(lengths, 1))
    norm = logs[:, None] + logs[None, :]
    norm[norm == 0] = 1.0
    slots, slot = np.unique(word * len(lengths) + kind[owner], return_inverse=True)
    # Slots are sorted by word, so the slots of one word are a run: first[w] .. first[w] + many[w].
    slot_word, slot_kind = np.divmod(slots, len(lengths))
    many = np.bincount(slot_word, minlength=words)
    first = np.cumsum(many) - many
    reads = many[word]
    reader = np.repeat(owner, reads)
    step = np.arange(reads.sum()) - np.repeat(np.cumsum(reads) - reads, reads)
    source = np.repeat(first[word], reads) + step
    weight = 1.0 / norm[kind[reader], slot_kind[source]]

    def spread(values: np.ndarray) -> np.ndarray:
        held = np.bincount(slot, weights=values[owner], minlength=len(slots))
        return np.bincount(reader, weights=weight * held[source], minlength=total)

    out = spread(np.ones(total))
    out[out == 0] = 1.0
    for _ in range(rounds):
        ranks = (1 - damping) / total * ranks.sum() + damping * spread(ranks / out)
    return ranks


@F.pandas_udf(DOUBLES)
def _textrank(lines: pd.Series) -> pd.Series:
    return lines.map(lambda rows: _overlap_ranks(list(rows), K.DAMPING, K.RANK_ROUNDS) if rows is not None and len(rows) else [])


def word_lines(document: Column) -> Column:
    """Each sentence as its ranking words joined by spaces."""
    return F.transform(T.sentences(document), lambda s: F.array_join(T.rank_words(s), " "))


def sentence_text(document: Column) -> Column:
    """The sentences, one a line: none of them holds a line feed."""
    return F.array_join(T.sentences(document), "\n")


def word_text(lines: Column) -> Column:
    """The ranking words of every line, parted by spaces: what lies between words is cut out in one pass, no word is a value of its own.

    A line without words is kept as a space, so that only a text without lines is empty.
    """
    return F.regexp_replace(F.lower(lines), K.RANK_GAP, " ")


def textrank_array(document: Column) -> Column:
    """The rank of every sentence, in sentence order."""
    return F.transform(_textrank(word_lines(document)), lambda r: F.round(r, SCORE_PLACES))


_CODED = {"luhn": _luhn, "lsa": _salience, "textrank": lambda *coded: _ranks(*coded, K.DAMPING, K.RANK_ROUNDS)}


def rankings_of(document: Column, methods: tuple) -> Column:
    """Several of ``RANKINGS`` at once: a struct with the scores of each, from words that are cut and coded once."""

    @F.pandas_udf(Y.StructType([Y.StructField(m, DOUBLES) for m in methods]))
    def of(lines: pd.Series) -> pd.DataFrame:
        coded = [_coded(list(rows)) if rows is not None else None for rows in lines]
        scores = lambda m, c: [] if c is None or not len(c[2]) else _CODED[m](*c)
        return pd.DataFrame({m: [scores(m, c) for c in coded] for m in methods})

    rounded = lambda made: F.struct(*[F.transform(made[m], lambda r: F.round(r, SCORE_PLACES)).alias(m) for m in methods])
    return T.let(of(word_lines(document)), rounded)


def _terms_by_line(lines: list[str]) -> tuple:
    """Sparse term counts of sentences: line, term and count of each entry, ordered by line; number of terms; words by first appearance."""
    split = [line.split() for line in lines]
    flat = list(chain.from_iterable(split))
    codes = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    word = np.fromiter(map(codes.__getitem__, flat), np.int64, len(flat))
    owner = np.repeat(np.arange(len(lines)), [len(row) for row in split]).astype(np.int64)
    entries, counts = np.unique(owner * max(len(codes), 1) + word, return_counts=True)
    line, term = np.divmod(entries, max(len(codes), 1))
    return line, term, counts.astype(float), len(codes)


#: Pairs of sentences times words up to which the products of all pairs are made; sentences up to which these are solved at once;
#: strengths that differ by so little of the largest one count as equal.
PAIRS, FEW, TIED = 1 << 25, 192, 1e-7


def _krylov(apply, size: int, keep: int, tolerance: float = 1e-13, most: int = 60) -> tuple:
    """The ``keep`` largest eigenvalues and eigenvectors of a symmetric positive map, by block Lanczos.

    A block a little larger than ``keep`` finds repeated eigenvalues; every new block is made orthogonal to all before it, so a
    space that fills up gives the exact answer. Memory: ``size`` times the blocks needed.
    """
    width = min(size, keep + 4)
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((size, width)))[0]
    image = apply(basis)
    for _ in range(most):
        power, turn = np.linalg.eigh(basis.T @ image)
        top = slice(max(len(power) - keep, 0), None)
        vectors = basis @ turn[:, top]
        rest = image @ turn[:, top] - vectors * power[top]
        if basis.shape[1] >= size or np.linalg.norm(rest, axis=0).max() <= tolerance * max(power[-1], 1e-300):
            break
        fresh = image[:, -width:]
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        fresh, scale = np.linalg.qr(fresh)
        fresh = fresh[:, np.abs(np.diag(scale)) > 1e-12 * max(power[-1], 1e-300)][:, : size - basis.shape[1]]
        if not fresh.shape[1]:
            break
        basis, image = np.hstack([basis, fresh]), np.hstack([image, apply(fresh)])
    return power[top], vectors


def _reduced(lines: list[str], keep: int) -> np.ndarray:
    """Salience from the strongest singular directions of the smoothed term matrix.

    Few sentences are solved at once, from the products of all their pairs. The matrix of a long document is never filled in: it is
    the smoothing constant everywhere plus a sparse part, so its products take the sparse entries and sums only.
    """
    line, term, counts, words = _terms_by_line(lines)
    if not words:
        return np.zeros(len(lines))
    top = np.ones(len(lines))
    np.maximum.at(top, line, counts)
    value = (1 - K.LSA_SMOOTH) * counts / top[line]

    def product(x: np.ndarray) -> np.ndarray:
        low = np.full((words, x.shape[1]), 0.0) + K.LSA_SMOOTH * x.sum(0)
        for c in range(x.shape[1]):
            low[:, c] += np.bincount(term, value * x[line, c], words)
        out = np.empty_like(x)
        for c in range(x.shape[1]):
            out[:, c] = K.LSA_SMOOTH * low[:, c].sum() + np.bincount(line, value * low[term, c], len(lines))
        return out

    if len(lines) <= FEW and len(lines) ** 2 * words <= PAIRS:
        filled = np.full((len(lines), words), K.LSA_SMOOTH)
        filled[line, term] += value
        power, right = np.linalg.eigh(filled @ filled.T)
        least = TIED * power[-1]
        if len(lines) <= keep or power[-keep] <= least or power[-keep] - power[-keep - 1] > least:
            return np.sqrt((np.maximum(power[-keep:], 0) * right[:, -keep:] ** 2).sum(axis=1))
    # Many sentences, or equal strengths on both sides of the cut, which leave a choice: it stays that of the iteration.
    power, right = _krylov(product, len(lines), min(keep, len(lines)))
    return np.sqrt((np.maximum(power, 0) * right**2).sum(axis=1))


def lsa_reduced_array(keep: int = 3):
    """A ranking from the ``keep`` strongest latent topics of each document."""

    @F.pandas_udf(DOUBLES)
    def salience(words: pd.Series) -> pd.Series:
        return words.map(lambda text: _reduced(text.split("\n"), keep) if text else [])

    return lambda document: F.transform(salience(word_text(sentence_text(document))), lambda r: F.round(r, SCORE_PLACES))


# Document column -> array with the score of every sentence, in sentence order.
RANKINGS = {"luhn": luhn_array, "lsa": lsa_array, "textrank": textrank_array}


def sentence_scores(df: DataFrame, ranking) -> DataFrame:
    """(id, pos, score) rows of a ranking."""
    return unfold(df, ["id"], ranking(F.col("document")), "pos", "score")


def target_sentences(df: DataFrame, budget: int, combo: bool = False) -> DataFrame:
    """How many sentences fit: floor(budget / (tokens / sentences)), in whole numbers."""
    document = F.col("document")
    return df.withColumn("n_sentences", _wanted(marks(document, combo), T.token_count(document), F.lit(budget)))


def marks(document: Column, combo: bool) -> Column:
    return T.period_sentences(document) if combo else T.newline_sentences(document)


def _wanted(marks: Column, size: Column, budget: Column) -> Column:
    return F.floor(budget * marks / size).cast("int")


def laid_out(document: Column, scores: Column) -> Column:
    """The sentences best first: array of (neg, pos, len, text)."""
    def entry(held: Column):
        return lambda s, i: F.struct(
            (-F.get(held, i)).alias("neg"), i.alias("pos"), F.regexp_count(s, F.lit(r"\S+")).alias("len"), s.alias("text")
        )

    return T.let(scores, lambda held: F.sort_array(F.transform(T.sentences(document), entry(held))))


def _cut(ranked: Column, wanted: Column, budget: Column, pick: str) -> Column:
    """The number of sentences to keep among wanted-1, wanted, wanted+1 (at least one)."""
    lens = F.transform(ranked, lambda r: r["len"])

    def offer(k: Column) -> Column:
        count = F.greatest(F.least(k, F.size(ranked)), F.lit(1))
        size = F.aggregate(F.slice(lens, 1, count), F.lit(1), lambda a, x: a + x)
        miss = size % budget if pick == "mod" else F.abs(size - budget)
        return F.struct(miss.alias("miss"), count.alias("k"), size.alias("size"))

    return F.array_min(F.transform(F.array(wanted - 1, wanted, wanted + 1), offer))


def _assembled(ranked: Column, k: Column) -> Column:
    best = F.transform(F.slice(ranked, 1, k), lambda r: F.struct(r["pos"].alias("pos"), r["text"].alias("text")))
    return F.array_join(F.transform(F.sort_array(best), lambda b: b["text"]), " ")


def chosen(ranked: Column, marks: Column, size: Column, budget: int, pick: str) -> Column:
    """(text, size) of the sentences kept for one budget; an empty document stays empty, a null one null."""
    whole = lambda cut: F.struct(_assembled(ranked, cut["k"]).alias("text"), cut["size"].cast("int").alias("size"))
    nothing = F.struct(F.lit("").alias("text"), F.lit(1).alias("size"))
    cut = _cut(ranked, _wanted(marks, size, F.lit(budget)), F.lit(budget), pick)
    return F.when(F.size(ranked) > 0, T.let(cut, whole)).when(size.isNotNull(), nothing)


def shorten_ranked(
    df: DataFrame, method: str, budgets: dict, pick: str = "mod", combo: bool = False
) -> DataFrame:
    """Shorten by one of the rankings, one row per budget.

    ``pick='mod'`` takes the candidate with the smallest token count modulo the budget, fewest
    sentences on ties; ``pick='closest'`` the one nearest to the budget.
    """
    if method not in RANKINGS:
        raise ValueError(f"unknown ranking {method!r}; known: {sorted(RANKINGS)}")
    if pick not in ("mod", "closest"):
        raise ValueError(f"unknown pick rule {pick!r}")
    document = F.col("document")
    laid = df.withColumns({
        "_ranked": laid_out(document, RANKINGS[method](document)),
        "_marks": marks(document, combo),
        "_size": T.token_count(document),
    })
    made = F.array(*[
        F.struct(F.lit(q).alias("quantity"), chosen(F.col("_ranked"), F.col("_marks"), F.col("_size"), b, pick).alias("made"))
        for q, b in budgets.items()
    ])
    # The outer form keeps the optimiser from testing the array, and so building it, a second time.
    rows = laid.select(*df.columns, F.explode_outer(made).alias("_m"))
    return rows.select(
        *df.columns, F.col("_m.quantity").alias("quantity"), F.col("_m.made.text").alias("shortened_document"),
        F.col("_m.made.size").alias("shortened_len"),
    )


def topk_sentences(df: DataFrame, ranking, k: int) -> DataFrame:
    """The k best sentences of each document in document order."""
    laid = df.withColumn("_best", F.slice(laid_out(F.col("document"), ranking(F.col("document"))), 1, k))
    kept = laid.where(F.size("_best") > 0)
    return kept.select(
        "id", F.size("_best").cast("long").alias("n_kept"), _assembled(F.col("_best"), F.lit(k)).alias("shortened_document")
    )


def _line_rows(lines: list[str]) -> tuple:
    """Sparse tf-idf rows of the sentences, length 1 each, inverse frequencies taken within the document: line, term, weight, number of terms."""
    line, term, counts, words = _terms_by_line(lines)
    held = np.bincount(term, minlength=words)
    weight = counts * (np.log((1 + len(lines)) / (1 + held[term])) + 1)
    length = np.sqrt(np.bincount(line, weight * weight, len(lines)))
    return line, term, weight / length[line], words


def _cosines(rows: tuple, size: int, centres: np.ndarray, entries: int = 1 << 20) -> np.ndarray:
    """Cosine of every sentence with every centre, over the entries there are; rounded, so that ties are ties."""
    line, term, weight, _ = rows
    out, columns = np.zeros((size, len(centres))), np.ascontiguousarray(centres.T)
    step = max(1, entries // max(len(centres), 1))
    for at in range(0, len(line), step):
        own = line[at : at + step]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))  # entries are ordered by line: a line is one run of them
        out[own[first]] += np.add.reduceat(weight[at : at + step, None] * columns[term[at : at + step]], first, axis=0)
    return np.round(out, SCORE_PLACES)


def _unit(centres: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(centres, axis=1, keepdims=True)
    return centres / np.where(length == 0, 1, length)


def _by_pairs(rows: tuple, size: int) -> tuple:
    """Cosines and distances of all sentences from one, and the step of the clustering, for a short document: from all its pairs of sentences."""
    line, term, weight, words = rows
    filled = np.zeros((size, words))
    filled[line, term] = weight
    pairs, places = filled @ filled.T, np.arange(size)
    rounded = np.round(pairs, SCORE_PLACES)

    def moved(member: np.ndarray, near: np.ndarray) -> np.ndarray:
        held = np.zeros(near.shape)
        held[places, member] = 1.0
        sums = pairs @ held
        length = np.sqrt(np.bincount(member, sums[places, member], near.shape[1]))
        cosines = np.round(sums / np.where(length == 0, 1, length), SCORE_PLACES)
        return np.where(np.bincount(member, minlength=near.shape[1]) > 0, cosines, near)

    return rounded.__getitem__, np.maximum(1 - rounded, 0).__getitem__, moved


def _by_entries(rows: tuple, size: int) -> tuple:
    """The same for a document of any length, from its sparse rows."""
    line, term, weight, words = rows
    begins = np.searchsorted(line, np.arange(size + 1))

    def likeness(pick: int) -> np.ndarray:
        own = slice(begins[pick], begins[pick + 1])
        centre = np.zeros(words)
        centre[term[own]] = weight[own]
        return np.round(np.bincount(line, weight * centre[term], size), SCORE_PLACES)

    def moved(member: np.ndarray, near: np.ndarray) -> np.ndarray:
        k = near.shape[1]
        sums = np.bincount(member[line] * max(words, 1) + term, weight, k * max(words, 1))[: k * words].reshape(k, words)
        return np.where(np.bincount(member, minlength=k) > 0, _cosines(rows, size, _unit(sums)), near)

    return likeness, lambda pick: np.maximum(1 - likeness(pick), 0), moved


def _seeds(distance, size: int, k: int, rng: np.random.Generator) -> list[int]:
    """k-means++: the first centre by chance, each further one with a chance that grows with its distance from the others.

    A pick depends on those before it only: the seeds of fewer centres are the first of these.
    """
    picks, far = [int(rng.integers(size))], np.full(size, np.inf)
    for chance in rng.random(k - 1).tolist():
        np.minimum(far, distance(picks[-1]), out=far)
        far[picks[-1]] = 0
        chances = far.cumsum()
        if chances[-1] <= 0:  # the others all equal a centre: the first ones left
            held = set(picks)
            return picks + [i for i in range(size) if i not in held][: k - len(picks)]
        picks.append(min(int(chances.searchsorted(chance * chances[-1], side="right")), size - 1))
    return picks


def _started(rows: tuple, size: int, k: int, seed: int) -> tuple:
    """Cosines of all sentences with ``k`` seeds, and the step of the clustering."""
    steps = _by_pairs if size**2 * rows[3] <= PAIRS else _by_entries
    likeness, distance, moved = steps(rows, size)
    return np.array([likeness(p) for p in _seeds(distance, size, k, np.random.default_rng(seed))]).T, moved


def _cluster_picks(near, moved, rounds: int, *drawn: int) -> list[int]:
    """Sentence positions nearest to the centroids of spherical k-means; no sentence stands for two of them.

    ``near`` has the cosine of every sentence with every centre, ``moved`` renews it for centres moved to the mean of their members;
    a centre without members stays. Sparse rows may be given instead, with their number, the centres, the rounds and the seed.
    """
    if drawn:
        rows, size, k, (rounds, seed) = near, moved, rounds, drawn
        near, moved = _started(rows, size, min(k, size), seed)
    member = None
    for _ in range(rounds):
        nearest = near.argmax(axis=1)
        if member is not None and (nearest == member).all():
            break
        member = nearest
        near = moved(member, near)
    first = near.argmax(axis=0).tolist()
    if len(set(first)) == len(first):
        return sorted(first)
    left, picks = near.T.copy(), []
    for own in left:
        picks.append(int(own.argmax()))
        left[:, picks[-1]] = -np.inf
    return sorted(picks)


def _centroid_text(document: str, sentences: str, words: str, budget: int, rounds: int) -> tuple[str, int]:
    """Text and size of the best cut among one sentence less than wanted, the wanted number, and one more.

    Sentences and their words come one a line. Tokens are counted in bytes, which are split where the pattern for spaces matches.
    """
    lines = [row.strip(" ") for row in words.split("\n")]
    seed = zlib.crc32("\n".join(lines).encode())  # by the text: the same wherever the row is
    wanted = budget * (document.count("\n") + 1) // (len(document.encode().split()) + 1)
    rows, lens = _line_rows(lines), [len(s.split()) for s in sentences.encode().split(b"\n")]
    counts = sorted({min(max(wanted + step, 1), len(lines)) for step in (-1, 0, 1)})
    near, moved = _started(rows, len(lines), counts[-1], seed)
    offers = []
    for k in counts:
        picks = _cluster_picks(near[:, :k], moved, rounds)
        kept = sum(lens[p] for p in picks) + 1
        offers.append((kept % budget, k, kept, picks))
    _, _, kept, picks = min(offers)
    texts = sentences.split("\n")
    return " ".join(texts[p] for p in picks), kept


def _centroid_cut(budget: int, rounds: int):
    @F.pandas_udf(Y.StructType([Y.StructField("text", Y.StringType()), Y.StructField("size", Y.LongType())]))
    def of(document: pd.Series, sentences: pd.Series, words: pd.Series) -> pd.DataFrame:
        made = [
            _centroid_text(d, s, w, budget, rounds) if s else ("", 1) for d, s, w in zip(document, sentences, words)
        ]
        return pd.DataFrame(made, columns=["text", "size"])

    return of


def shorten_centroid(df: DataFrame, budget: int, rounds: int = 10) -> DataFrame:
    """Keep the sentences nearest to cluster centres; the cut rule is that of the ranked strategies.

    Sentences are sparse tf-idf rows over the document's whole vocabulary, clustered by cosine in at most ``rounds`` rounds.
    """
    lined = df.withColumn("_lines", sentence_text(F.col("document")))
    cut = lined.withColumn("_cut", _centroid_cut(budget, rounds)(F.col("document"), F.col("_lines"), word_text(F.col("_lines"))))
    return cut.withColumns({
        "shortened_document": F.col("_cut.text"), "shortened_len": F.col("_cut.size").cast("int"),
    }).drop("_lines", "_cut")
