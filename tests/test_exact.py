"""Sparse and small-memory forms against the dense ones."""

import random
import tracemalloc

import numpy as np
import pytest

from brevis import constants as K
from brevis.operators import extractive, rouge


def talk(n, words, seed):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 14))) for _ in range(n)]


WORDS = [f"w{i}" for i in range(30)]


def dense_reduced(lines, keep):
    split = [line.split() for line in lines]
    vocab = sorted({w for s in split for w in s})
    if not vocab:
        return np.zeros(len(lines))
    m = np.array([[s.count(w) for s in split] for w in vocab], float)
    smooth = K.LSA_SMOOTH + (1 - K.LSA_SMOOTH) * m / np.maximum(m.max(0), 1)
    power, right = np.linalg.eigh(smooth.T @ smooth)
    return np.sqrt((np.maximum(power[-keep:], 0) * right[:, -keep:] ** 2).sum(1))


@pytest.mark.parametrize("size", [1, 2, 5, 40, 200])
@pytest.mark.parametrize("keep", [1, 3, 10])
def test_reduced_salience_equals_the_dense_form(size, keep):
    lines = talk(size, WORDS, size)
    assert extractive._reduced(lines, keep) == pytest.approx(dense_reduced(lines, keep), abs=1e-8)
    assert extractive._reduced([""] * size, keep).tolist() == [0.0] * size


def test_repeated_singular_values_are_all_found():
    """Two equal groups without a common word share their values after the first."""
    a = talk(12, WORDS[:6], 1)
    lines = a + [line.replace("w", "v") for line in a]
    assert extractive._reduced(lines, 3) == pytest.approx(dense_reduced(lines, 3), abs=1e-8)


def test_reduced_salience_of_a_very_long_document():
    lines = talk(20_000, [f"w{i}" for i in range(5000)], 3)
    tracemalloc.start()
    out = extractive._reduced(lines, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(out).all() and peak < 400 << 20  # the dense product alone takes 3.2 GB


def dense_picks(lines, k, rounds, seed):
    """The same clustering with whole matrices."""
    split = [line.split() for line in lines]
    vocab = list(dict.fromkeys(w for s in split for w in s))
    tf = np.array([[s.count(w) for w in vocab] for s in split], float).reshape(len(lines), len(vocab))
    x = tf * (np.log((1 + len(lines)) / (1 + (tf > 0).sum(0))) + 1)
    x = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    rng, k = np.random.default_rng(seed), min(k, len(lines))
    picks = [int(rng.integers(len(lines)))]
    while len(picks) < k:
        chance = np.maximum((1 - np.round(x @ x[picks].T, 9)).min(1), 0)
        chance[picks] = 0
        if chance.sum() <= 0:
            picks.append(next(i for i in range(len(lines)) if i not in picks))
        else:
            picks.append(min(int(np.searchsorted(np.cumsum(chance), rng.random() * chance.sum(), side="right")), len(lines) - 1))
    centres, member = x[picks], None
    for _ in range(rounds):
        nearest = np.round(x @ centres.T, 9).argmax(1)
        if member is not None and (nearest == member).all():
            break
        member = nearest
        for c in range(k):
            if (member == c).any():
                s = x[member == c].sum(0)
                centres[c] = s / (np.linalg.norm(s) or 1)
    near, taken = x @ centres.T, set()
    for c in range(k):
        taken.add(max((i for i in range(len(lines)) if i not in taken), key=lambda i: (round(near[i, c], 9), -i)))
    return sorted(taken)


def test_centroid_picks_equal_the_dense_form():
    for seed in range(25):
        lines = [f"{line} own{i}" for i, line in enumerate(talk(3 + seed * 2, WORDS, seed))]
        sparse = extractive._line_rows(lines)
        for k in (1, 2, 5):
            assert extractive._cluster_picks(sparse, len(lines), k, 10, seed) == dense_picks(lines, k, 10, seed), (seed, k)


def test_centroid_rounds_and_degenerate_texts():
    lines = [f"{line} own{i}" for i, line in enumerate(talk(40, WORDS, 4))]
    assert len(extractive._cluster_picks(extractive._line_rows(lines), 40, 6, 0, 1)) == 6
    same = ["a b"] * 5
    assert len(extractive._cluster_picks(extractive._line_rows(same), 5, 3, 10, 1)) == 3
    assert len(extractive._cluster_picks(extractive._line_rows(["", "", ""]), 3, 2, 10, 1)) == 2


def all_rows(ref, hyp):
    where = {}
    for j, t in enumerate(hyp):
        where[t] = where.get(t, 0) | (1 << j)
    full = (1 << len(hyp)) - 1
    row, rows = full, []
    for t in ref:
        hit = row & where.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def test_kept_rows_give_all_rows():
    rnd = random.Random(2)
    for n in (0, 1, 2, 3, 10, 50, 99):
        a, b = [rnd.choice("abcde") for _ in range(n)], [rnd.choice("abcde") for _ in range(37)]
        rows, want = rouge._CommonRows(a, b), all_rows(a, b)
        assert [rows[i] for i in range(n - 1, -1, -1)] == want[::-1]


def test_a_long_pair_takes_little_memory():
    rnd = random.Random(7)
    a = [str(rnd.randrange(3000)) for _ in range(20_000)]
    b = [x for x in a if rnd.random() < 0.9]
    tracemalloc.start()
    found = rouge._hit_positions(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == rouge._common_length(a, b) and peak < 30 << 20  # all rows together take 46 MB and more
