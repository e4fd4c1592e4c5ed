"""Toxicity: a subsequence string kernel SVM with Nystrom landmarks.

A text is a bag of sentences and a sentence a bag of units: words, and runs of single letters joined
into one word. Two units are compared by the gap-weighted subsequence kernel of order 3, normalised and
raised to ``POWER``: shared letters in the same order count even when other letters or signs stand
between them, each step of a span costing ``DECAY``. Landmark units span the Nystrom map; a linear
SVM over it gives a unit's value, and a sentence has the value of its strongest unit. Sentences of a
labelled document inherit its label, and the SVM is trained as a multiple-instance problem: one unit
of a toxic document's sentences, its witness, must be toxic, every unit of the others must not. The first landmark of a
document is its witness, so that every landmark is learnt, not only the strongest one.

Scoring evaluates each distinct word of a task once (in a table of fixed size) and takes the strongest
sentence of the whole text, which a logistic curve turns into a score.

Nulls and texts without any unit of three letters have no evidence and get the score of an empty
sentence. Rows whose label is null are not learnt from. Without training rows of both classes, or without any unit that
speaks for label 1, every score is the share of label 1 among all training labels, but below 0.5: nothing is called toxic
for lack of examples. Repeated rows are scored each. Extra columns are ignored.

Bounds, all parameters of ``train``: at most ``per_class`` labelled documents per class (chosen by hash of
the key), ``landmarks`` units, and the ``per_doc`` units of a training document closest to a toxic landmark.
"""

import hashlib
import math
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brevis.llm.common import pieces, release, store

DECAY = 0.85
POWER = 3
NEAR = 0.0  # every kernel counts, however small
WINDOW = 20  # letters; longer words are judged by overlapping windows of this size
SPAN = WINDOW  # subsequences of a window may stretch over all of it
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_/\\~^+=`"
_SLOTS = 1 << 21  # remembered words of a task
SLICE, CELLS = 2048, 1 << 19  # units whose kernels are computed at once, and letter triples of them
DENSE = 100  # so many times as few shared triples as cells: from there on a dense product is cheaper
CHANCE = 0.2  # share of landmarks that may speak for a class by chance
CLEAN_SHARE = 0.01  # of the clean training documents may lie above the line between the classes
TOLERANCE = 0.15  # of the way from them to the toxic documents the line may at least take
_NONE = 31  # a sign: takes room in a gap, matches nothing


# --- kernel -----------------------------------------------------------------------------------

def _code(char: str) -> int:
    """Letters as 0..30: a-z, other letters in five groups; everything else is a mere gap."""
    return ord(char) - 97 if "a" <= char <= "z" else 26 + ord(char) % 5 if char.isalpha() else _NONE


_LATIN = bytes(_code(chr(c)) for c in range(256))


def _codes(word: str) -> bytes:
    try:
        return word.encode("latin-1").translate(_LATIN)
    except UnicodeEncodeError:
        return bytes(map(_code, word))


def _matrix(words: list) -> np.ndarray:
    """Codes of equally long words, one row per letter place."""
    flat = np.frombuffer(b"".join(map(_codes, words)), np.uint8).reshape(len(words), -1)
    return np.ascontiguousarray(flat.T).astype(np.int32)


def windows(word: str) -> list:
    """Parts of a unit that are compared: itself, its letters alone, and overlapping windows of what is very long."""
    letters = word if word.isalpha() else "".join(c for c in word if c.isalpha())
    out = []
    for form in {word, letters}:
        out += [form] if len(form) <= WINDOW else [form[i : i + WINDOW] for i in range(0, len(form) - WINDOW // 2, WINDOW // 2)]
    return out


@lru_cache
def _places(size: int) -> tuple:
    """Places of all letter triples of a word, and the decay of each."""
    found = [(a, b, c) for a in range(size) for c in range(a + 2, min(size, a + SPAN)) for b in range(a + 1, c)]
    i, j, k = (np.array(x) for x in zip(*found, strict=True))
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


def _triples(codes: np.ndarray) -> tuple:
    """Codes of the letter triples of words (one column each), and the decay of each triple's span."""
    i, j, k, decay = _places(len(codes))
    return codes[i] * np.int32(1024) + codes[j] * np.int32(32) + codes[k], decay


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """Order-3 kernel of each word with itself, by the usual recursion over prefixes; it is symmetric, so half of it is enough."""
    (size, n), step = codes.shape, np.float32(DECAY)
    pairs = [(a, b) for a in range(size) for b in range(a + 1)]
    same = {(a, b): ((codes[a] == codes[b]) & (codes[a] != _NONE)).astype(np.float32) * np.float32(DECAY**2) for a, b in pairs}
    zero = np.zeros(n, np.float32)
    last = None  # all ones
    for _ in range(2):
        here = {(a, 0): zero for a in range(size + 1)}
        for a in range(1, size + 1):
            row = zero
            for b in range(1, a + 1):
                met = same[a - 1, b - 1]
                row = step * row + (met if last is None else met * last[a - 1, b - 1])
                above = here[a - 1, b] if b < a else here[a, a - 1]
                here[a, b] = step * above + row
        last = here
    whole = sum(same[a, b] * last[a, b] for a, b in pairs if b < a) if size > 1 else zero
    return 2 * whole + sum(same[a, a] * last[a, a] for a in range(size))


@dataclass
class Landmarks:
    """Explicit subsequence features of the landmark units, unit length each."""

    units: list
    rows: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        tables = []
        for unit in self.units:
            ids, decay = _triples(_matrix([unit[:WINDOW]]))
            found: dict = {}
            for t, w in zip(ids[:, 0].tolist(), decay.tolist(), strict=True):
                if _NONE not in (t >> 10, t >> 5 & 31, t & 31):
                    found[t] = found.get(t, 0.0) + w
            norm = math.sqrt(sum(v * v for v in found.values())) or 1.0
            tables.append({t: v / norm for t, v in found.items()})
        names = sorted({t for f in tables for t in f})
        place = {t: i + 1 for i, t in enumerate(names)}
        self.rows = np.zeros(32**3, np.int32)
        self.rows[names] = np.arange(1, len(names) + 1)
        self.weights = np.zeros((len(names) + 1, len(self.units)), np.float32)
        for z, f in enumerate(tables):
            for t, v in f.items():
                self.weights[place[t], z] = v

    @staticmethod
    def norms(codes: np.ndarray) -> np.ndarray:
        """Length of each word's feature vector; without a repeated letter it follows from the word's size alone."""
        ordered = np.sort(codes, axis=0)
        twice = ((ordered[1:] == ordered[:-1]) | (ordered[1:] == _NONE)).any(0)
        out = np.full(codes.shape[1], np.sqrt((_places(len(codes))[3].astype(float) ** 2).sum()), np.float32)
        if twice.any():
            out[twice] = np.sqrt(self_kernel(codes[:, twice]))
        return out

    def kernel(self, words: list) -> np.ndarray:
        """Normalised kernel of each word with each landmark, to the power ``POWER``."""
        out = np.zeros((len(words), len(self.units)), np.float32)
        sized: dict = {}
        for i, w in enumerate(words):
            for part in windows(w):
                if len(part) >= 3:
                    sized.setdefault(len(part), []).append((i, part))
        for size, group in sized.items():
            step = max(64, min(SLICE, CELLS // len(_places(size)[0])))
            for at in range(0, len(group), step):
                some = group[at : at + step]
                codes = _matrix([p for _, p in some])
                ids, decay = _triples(codes)
                rows = np.ascontiguousarray(self.rows[ids].T)
                who, where = np.nonzero(rows)
                if not len(who):
                    continue
                mine, at_rows = np.unique(who), rows[who, where]
                if len(who) * DENSE > len(some) * len(self.weights):  # many shared triples: a product of matrices
                    held = np.zeros((len(some), len(self.weights)), np.float32)
                    np.add.at(held.reshape(-1), who * len(self.weights) + at_rows, decay[where])
                    sums = (held if len(mine) == len(some) else held[mine]) @ self.weights
                else:
                    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                    sums = np.add.reduceat(self.weights[at_rows] * decay[where][:, None], first)
                near = np.minimum(sums / np.maximum(self.norms(codes[:, mine]), 1e-15)[:, None], 1)
                power = np.prod([near] * POWER, axis=0) if POWER == int(POWER) else near**POWER
                own = np.array([i for i, _ in some])[mine]
                if size < WINDOW:  # one part of a word has this length at most
                    out[own] = np.maximum(out[own], power)
                else:
                    np.maximum.at(out, own, power)
        return out


# --- sentences --------------------------------------------------------------------------------

def unit_of(token: str) -> str:
    return token.strip(_STRIP)


def sentences(text: str) -> list:
    """Units per sentence: stripped words, and runs of three or more single letters joined."""
    out, here, run = [], [], []
    for token in text.lower().split():
        unit = unit_of(token)
        if len(unit) == 1 and unit.isalpha():
            run.append(unit)
        else:
            if len(run) >= 3:
                here.append("".join(run))
            run = []
            if len(unit) >= 3:
                here.append(unit)
        if token[-1] in ".!?" and len(unit) != 1:
            if here:
                out.append(here)
            here, run = [], []
    if len(run) >= 3:
        here.append("".join(run))
    return [*out, here] if here else out


# --- model ------------------------------------------------------------------------------------

@dataclass
class Model:
    """``unit`` weights over landmarks, bias, and the logistic curve over the strongest sentence."""

    units: list
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    fallback: float | None = None


class Scorer:
    """Scores whole texts; remembers distinct words in a table of fixed size.

    A word's slot follows from its hash and holds the hash and the value; a later word of the same slot
    takes it over, so memory is bounded and frequent words stay at hand.
    """

    def __init__(self, model: Model):
        self.model = model
        self.landmarks = Landmarks(model.units)
        self.tags = np.zeros(_SLOTS, np.int64)
        self.value = np.zeros(_SLOTS, np.float32)
        self.single = np.zeros(_SLOTS, bool)

    def _values(self, units: list) -> np.ndarray:
        """Value of each unit, without holding all kernels at once."""
        parts = [self.landmarks.kernel(units[i : i + 8192]) @ self.model.weights for i in range(0, len(units), 8192)]
        return np.concatenate([np.zeros(0, np.float32), *parts])

    def _learn(self, tokens: list) -> tuple:
        units = [unit_of(t) for t in tokens]
        unlike = sorted({u for u in units if len(u) >= 3})
        place = dict(zip(unlike, range(len(unlike)), strict=True))
        found = np.r_[self._values(unlike), np.float32(0)]
        values = found[[place.get(u, -1) for u in units]]
        return values, np.array([len(u) == 1 and u.isalpha() for u in units], bool)

    def _look_up(self, tokens: list) -> tuple:
        """Value of each token, and whether it is a single letter."""
        tags = np.fromiter(map(hash, tokens), np.int64, len(tokens)) | 1  # an empty slot has tag 0
        slots = (tags >> 1) & (_SLOTS - 1)
        values, single = self.value[slots], self.single[slots]
        missing = np.flatnonzero(self.tags[slots] != tags)
        if len(missing):
            unlike, first, back = np.unique(tags[missing], return_index=True, return_inverse=True)
            v, s = self._learn([tokens[i] for i in missing[first].tolist()])
            values[missing], single[missing] = v[back], s[back]
            self.tags[slots[missing[first]]] = unlike
            at = slots[missing[first]]
            mine = self.tags[at] == unlike  # of several new words in a slot the last one stays
            self.value[at[mine]], self.single[at[mine]] = v[mine], s[mine]
        return values, single

    def strongest(self, texts: list) -> np.ndarray:
        """The value of each text's strongest sentence, 0 at least."""
        split = [t.lower().split() for t in texts]
        out = np.zeros(len(texts))
        filled = [i for i, tokens in enumerate(split) if tokens]
        if not filled:
            return out
        flat = [t for i in filled for t in split[i]]
        begin = np.r_[0, np.cumsum([len(split[i]) for i in filled])[:-1]]
        values, single = self._look_up(flat)
        starts = np.zeros(len(flat), bool)
        starts[begin] = True
        runs = _runs(single, starts)
        if runs:
            joined = ["".join(unit_of(t) for t in flat[s:e]) for s, e in runs]
            places = [s for s, _ in runs]
            # A one-letter word may stand before or after the spelt one.
            for some in (joined, [w[1:] for w in joined], [w[:-1] for w in joined]):
                values[places] = np.maximum(values[places], self._values(some))
        out[filled] = np.maximum(np.maximum.reduceat(values, begin), 0)
        return out

    def scores(self, texts: list) -> np.ndarray:
        m = self.model
        return 1 / (1 + np.exp(-np.clip(m.slope * (self.strongest(texts) + m.bias) + m.shift, -500, 500)))


def _runs(flags: np.ndarray, starts: np.ndarray) -> list:
    """(start, end) of three or more flagged places in a row within one text."""
    before = np.r_[False, flags[:-1]] & ~starts
    opened = np.flatnonzero(flags & ~before)
    after = np.r_[flags[1:] & ~starts[1:], False]
    closed = np.flatnonzero(flags & ~after) + 1
    return [(s, e) for s, e in zip(opened.tolist(), closed.tolist(), strict=True) if e - s >= 3]


_SCORERS: dict = {}  # one model per worker


def apply(docs: DataFrame, model: Model, keep: list, text: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` of every whole text."""
    slim = docs.select(*keep, F.col(text).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and their weights
    name = hashlib.md5(repr((model.units, model.weights.tolist(), model.bias)).encode()).hexdigest()

    def run(batches):
        own = sent.value
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(own) if own.fallback is None else None
        scorer = _SCORERS[name]
        for b in batches:
            for part in pieces(b, "_text", 1 << 20):
                texts = [t or "" for t in part.column("_text").to_pylist()]
                found = np.full(len(texts), own.fallback) if scorer is None else scorer.scores(texts)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(found, pa.float64())], [*keep, "score"])
        release()

    return slim.mapInArrow(run, slim.select(*keep).withColumn("score", F.lit(0.0)).schema)


# --- training ---------------------------------------------------------------------------------

def sample(docs: DataFrame, labels: DataFrame, training: Column, key: str, text: str, per_class: int) -> DataFrame:
    """label and text of at most ``per_class`` labelled documents per class."""
    known = labels.where(F.col("label").isin(0, 1) & training).select(key, "label")
    order = F.xxhash64(F.col(key).cast("string"))
    some = [known.where(F.col("label") == c).orderBy(order, key).limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(some[0].unionAll(some[1]))  # at most 2 * per_class rows of a key and a label
    return docs.select(key, F.col(text).alias("text")).join(chosen, key).select("label", "text", F.col(key).cast("string").alias("doc"))


def _units(rows: DataFrame) -> DataFrame:
    """Distinct units of each sampled document."""

    def run(batches):
        for b in batches:
            for part in pieces(b, "text", 1 << 20):
                labels, units = [], []
                for y, t in zip(part.column("label").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = {u for s in sentences(t or "") for u in s}
                    units += own
                    labels += [y] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(units, pa.string())], ["label", "unit"])
        release()

    return rows.mapInArrow(run, "label int, unit string")


def evidence(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    """Likelihood ratio of document counts against the share of label 1, 0 where they speak for label 0."""
    n = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(pos > 0, pos * np.log(pos / (n * share)), 0.0)
        b = np.where(neg > 0, neg * np.log(neg / (n * (1 - share))), 0.0)
    return np.where(pos > n * share, a + b, 0.0)


def _cover(neg: np.ndarray, held: list, share: float, tested: int, most: int) -> list:
    """Places of units picked one by one, each by its independent evidence for label 1.

    ``held`` has, for each document of label 1, the places of its units and the neighbours each stands between. A unit's
    evidence counts the documents that no earlier pick is in, and of the others only different neighbours: words that
    merely come along with an insult in copies of one document are not taken, while insults that share documents
    are. A pick must be unlikely to be chance among all ``tested`` units, by the bound of a false-discovery rate of ``CHANCE``,
    which adapts to the sample, so a rare insult of a small corpus is taken.
    """
    free, seen, out = np.zeros(len(neg)), [set() for _ in neg], []
    for units, _ in held:
        free[units] += 1
    left = list(held)
    while len(out) < min(most, len(neg)):
        g = evidence(free + [len(s) for s in seen], neg, share)
        g[out] = 0
        best = int(np.argmax(g))
        if math.erfc(math.sqrt(max(g[best], 0.0))) > CHANCE * (len(out) + 1) / max(tested, 1):
            break
        out.append(best)
        still = []
        for units, around in left:
            if best in units:
                free[units] -= 1
                for u, a in zip(units, around, strict=True):
                    seen[u].add(a)
            else:
                still.append((units, around))
        left = still
    return out


def _held(rows: DataFrame, units: list) -> list:
    """For each document of label 1 the places in ``units`` of its units, and a code of each one's neighbours."""
    sent = rows.sparkSession.sparkContext.broadcast({u: i for i, u in enumerate(units)})

    def found(text):
        known, out = sent.value, {}
        for s in sentences(text):
            for before, unit, after in zip([""] + s[:-1], s, s[1:] + [""], strict=True):
                if unit in known:
                    around = zlib.crc32(f"{before} {after}".encode())
                    out[known[unit]] = min(out.get(known[unit], around), around)  # one place of each document
        return sorted(out.items())

    def run(batches):
        for b in batches:
            for part in pieces(b, "text", 1 << 20):
                bags = [found(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([[u for u, _ in bag] for bag in bags], pa.list_(pa.int32())),
                    pa.array([[a for _, a in bag] for bag in bags], pa.list_(pa.int64()))], ["held", "around"])

    toxic = rows.where("label = 1").select("text").mapInArrow(run, "held array<int>, around array<long>")
    return [(r["held"], r["around"]) for r in toxic.collect()]  # bounded by the sample


def choose(rows: DataFrame, landmarks: int) -> list:
    """(unit, toxic) landmarks: units that speak for a class by the documents they are in, beyond what chance allows.

    Those for label 1 cover its documents one after the other (``_cover``), out of the ``4 * landmarks`` of highest likelihood
    ratio; those for label 0, an eighth at most, are taken by that ratio alone.
    """
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counted = _units(rows).groupBy("unit").agg(
        F.sum(F.col("label")).alias("pos"), F.sum(1 - F.col("label")).alias("neg")).where(F.col("pos") + F.col("neg") >= 2)
    share = sizes[1] / (sizes[0] + sizes[1])
    n = F.col("pos") + F.col("neg")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = part(F.col("pos"), n * share) + part(F.col("neg"), n * (1 - share))
    for_toxic = F.col("pos") / n > share
    named = store(counted.where(F.length("unit") <= WINDOW).select("unit", "pos", "neg", ratio.alias("g"), for_toxic.alias("toxic")), "toxic-units")
    tested = named.count()
    toxic = named.where("toxic").orderBy(F.desc("g"), "unit").limit(4 * landmarks).collect()
    clean = named.where("NOT toxic").orderBy(F.desc("g"), "unit").limit(landmarks // 8).collect()
    held = _held(rows, [r["unit"] for r in toxic])
    picked = _cover(np.array([r["neg"] for r in toxic], float), held, share, tested, landmarks - landmarks // 8)
    mild = [r for i, r in enumerate(clean) if math.erfc(math.sqrt(max(r["g"], 0.0))) <= CHANCE * (i + 1) / max(tested, 1)]
    return [(toxic[i]["unit"], True) for i in picked] + [(r["unit"], False) for r in mild]


def _unit_kernels(rows: DataFrame, chosen: list, per_doc: int) -> DataFrame:
    """doc, label and landmark kernels of the units that are closest to a toxic landmark."""
    sent = rows.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        near = Landmarks([u for u, _ in sent.value])
        toxic = np.array([t for _, t in sent.value])
        for b in batches:
            for part in pieces(b, "text", 1 << 20):
                bags = [list(dict.fromkeys(u for s in sentences(t or "") for u in s)) for t in part.column("text").to_pylist()]
                every = sorted({u for bag in bags for u in bag})
                place = {u: i for i, u in enumerate(every)}
                k = near.kernel(every)
                close = k[:, toxic].max(1, initial=0)
                docs, labels, kept = [], [], []
                for y, d, bag in zip(part.column("label").to_pylist(), part.column("doc").to_pylist(), bags, strict=True):
                    at = np.array([place[u] for u in bag], int)
                    best = at[np.argsort(-close[at], kind="stable")[:per_doc]]
                    docs += [d] * len(best)
                    labels += [y] * len(best)
                    kept.append(best)
                flat = k[np.concatenate(kept)] if kept else k[:0]
                rows_of = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(labels, pa.int32()), rows_of], ["doc", "label", "k"])
        release()

    return rows.mapInArrow(run, "doc string, label int, k array<float>")


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 1000.0, rounds: int = 60) -> tuple:
    """Linear SVM with squared hinge, classes weighted evenly, by Newton steps in the primal, summed in slabs of rows."""
    size = x.shape[1] + 1
    w = np.zeros(size)
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost / len(y) * 100
    penalty = np.eye(size)
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        square, side = penalty.copy(), np.zeros(size)
        for at in range(0, len(x), 4096):
            a = np.hstack([x[at : at + 4096], np.ones((len(x[at : at + 4096]), 1))]).astype(float)
            own = y[at : at + 4096]
            active = own * (a @ w) < 1
            a, own, wa = a[active], own[active], weight[at : at + 4096][active]
            square += (a * wa[:, None]).T @ a
            side += a.T @ (wa * own)
        new = np.linalg.solve(square, side)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
    """Slope and shift of a lightly penalised logistic curve."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + 1e-2 * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def train(
    docs: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", key: str = "doc_id", text: str = "text",
    per_class: int = 3000, landmarks: int = 128, per_doc: int = 8,
) -> Model:
    known = labels.select(F.col(key), F.col(label).cast("int").alias("label"))
    rows = store(sample(docs, known, training, key, text, per_class), "toxic-sample")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # The classes are sampled apart: what follows uses their shares among all training labels.
    share = known.where(training & F.col("label").isin(0, 1)).agg(F.avg("label")).first()[0] or 0.0
    unlearnt = Model([], np.zeros(0), 0.0, 0.0, 0.0, min(share, 0.49))
    if len(sizes) < 2:
        return unlearnt
    chosen = choose(rows, landmarks)
    if not any(toxic for _, toxic in chosen):
        return unlearnt
    units = [u for u, _ in chosen]
    # Bounded by the sample: per_doc rows of one number per landmark for each of its documents.
    found = _unit_kernels(rows, chosen, per_doc).toArrow()
    order = np.argsort(found.column("doc").to_numpy().astype(str), kind="stable")
    k = found.column("k").combine_chunks().flatten().to_numpy().reshape(-1, len(units))[order]
    doc, toxic = found.column("doc").to_numpy()[order], found.column("label").to_numpy()[order] == 1
    del found
    near = Landmarks(units).kernel(units).astype(float)
    vals, vecs = np.linalg.eigh((near + near.T) / 2)
    root = vecs / np.sqrt(np.maximum(vals, 1e-3))  # Nystrom map: kernels times the landmarks' inverse root
    strength = k[:, [t for _, t in chosen]].max(1)
    x = k @ root.astype(np.float32)
    del k
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    exact = strength >= 0.999
    for _ in range(4):  # which unit makes a toxic document toxic: its first landmark, else the strongest unit
        witness = np.zeros(len(x), bool)
        for s, e in zip(first, np.r_[first[1:], len(x)], strict=True):
            if toxic[s]:
                witness[s + int(np.argmax(exact[s:e] if exact[s:e].any() else strength[s:e]))] = True
        used = witness | ~toxic
        w, bias = _svm(x[used], np.where(witness[used], 1.0, -1.0))
        strength = x @ w
    best = np.maximum(np.maximum.reduceat(strength, first), 0) + bias
    y = toxic[first].astype(float)
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    slope, shift = _logistic(best, y, weight)
    if slope <= 0:
        return unlearnt
    # Where the classes lie apart, distorted insults fall between them: the line is then drawn near the clean documents.
    high, middle = np.quantile(best[~toxic[first]], 1 - CLEAN_SHARE), np.median(best[toxic[first]])
    line = min(-shift / slope, high + TOLERANCE * max(middle - high, 0.0))
    return Model(units, (root @ w).astype(np.float32), bias, slope, -slope * line)
