"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text is turned into ``NAMES``, transformed so that they are closer to normal. Class means and
covariances come from Spark sums over every labelled training row (nothing is sampled); the driver
only factorises two small matrices. A score is the posterior of label 1, from the difference of two
Gaussian log-densities whose Cholesky factors are computed once and sent with the task.

Nulls and empty texts have all statistics zero and are scored like any text. Rows whose label is
null, and repeated label rows of one id, are left out or count once each. Without any training row
every score is 0.5; with one class only it is that class's smoothed share. Extra columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brevis.llm.common import raw_texts, store

NAMES = (
    "chars", "words", "word_mean", "word_spread", "upper", "digits", "punct", "symbols", "pipes", "bangs",
    "newlines", "new_words", "new_lines", "short_words", "stops", "spaces", "shout_words", "odd_ends",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "punct": b".,;:'\"()-?", "symbols": b"#$%&*+=<>@^~_{}[]\\/`",
    "pipes": b"|", "bangs": b"!", "newlines": b"\n", "stops": b".", "spaces": b" \t\r\x0b\x0c",
}


def _table() -> np.ndarray:
    out = np.zeros((256, len(_CLASSES)))
    for k, members in enumerate(_CLASSES.values()):
        out[list(members), k] = 1
    return out


def statistics(texts: list) -> np.ndarray:
    """One row of transformed statistics per text: logs of sizes, square roots of shares."""
    tally = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), 8))
    for i, text in enumerate(texts):
        if not text:
            continue
        tally[i] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words, lines = text.split(), [x for x in text.split(b"\n") if x]
        sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
        unlike = set(words)
        rest[i] = (
            len(words), sizes.mean(), sizes.std(), len(unlike) / max(1, len(words)), len(set(lines)) / max(1, len(lines)),
            (sizes <= 2).mean(), sum(w.isupper() and len(w) > 3 for w in unlike) / max(1, len(unlike)),
            sum(w[-1] in b"#$%&*!|" for w in unlike) / max(1, len(unlike)),
        )
    chars = tally.sum(1)
    shares = (tally @ _table()) / np.maximum(chars, 1)[:, None]
    by = dict(zip(_CLASSES, np.sqrt(shares).T, strict=True))
    by |= {
        "chars": np.log1p(chars), "words": np.log1p(rest[:, 0]), "word_mean": np.log1p(rest[:, 1]), "word_spread": np.log1p(rest[:, 2]),
        "new_words": rest[:, 3], "new_lines": rest[:, 4], "short_words": np.sqrt(rest[:, 5]), "shout_words": np.sqrt(rest[:, 6]),
        "odd_ends": np.sqrt(rest[:, 7]),
    }
    return np.column_stack([by[n] for n in NAMES])


def with_statistics(docs: DataFrame, keep: list, text: str = "text") -> DataFrame:
    """``keep`` columns and ``stats``, an array of the transformed statistics."""
    slim = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                found = statistics(raw_texts(b.column("_text")))
                stats = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, found.size + 1, len(NAMES)), pa.int32()), pa.array(found.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], stats], [*keep, "stats"])

    schema = slim.drop("_text").withColumn("stats", F.array(F.lit(0.0))).schema
    return slim.mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): mean, inverse Cholesky factor, log-density constant with the prior's logarithm."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    fallback: float | None = None

    def posterior(self, x: np.ndarray) -> np.ndarray:
        if self.fallback is not None:
            return np.full(len(x), self.fallback)
        logs = [
            c - 0.5 * np.square((x - m) @ f.T).sum(1)
            for m, f, c in zip(self.means, self.factors, self.constants, strict=True)
        ]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(labelled: DataFrame, stats: str = "stats", label: str = "label", shrink: float = 0.1, ridge: float = 1e-4) -> Discriminant:
    """Moments by Spark sums over all rows; each covariance is shrunk towards the pooled diagonal."""
    d = len(NAMES)
    x = [F.col(stats)[i] for i in range(d)]
    rows = labelled.where(F.col(label).isin(0, 1)).groupBy(label).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(c) for c in x]).alias("s"),
        F.array(*[F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)]).alias("ss"),
    ).collect()  # two rows at most
    by = {int(r[label]): r for r in rows}
    total = sum(r["n"] for r in rows)
    if len(by) < 2 or min(r["n"] for r in rows) < 2:
        share = (by[1]["n"] + 1 if 1 in by else 1) / (total + 2)
        return Discriminant(np.zeros(0), np.zeros(0), np.zeros(0), share)
    means, covs = [], []
    upper = np.triu_indices(d)
    for c in (0, 1):
        n, mean = by[c]["n"], np.array(by[c]["s"]) / by[c]["n"]
        full = np.zeros((d, d))
        full[upper] = by[c]["ss"]
        full = full + np.triu(full, 1).T
        means.append(mean)
        covs.append(full / n - np.outer(mean, mean))
    share = np.array([by[c]["n"] for c in (0, 1)]) / total
    pooled = np.diag(sum(w * np.diag(v) for w, v in zip(share, covs, strict=True)) + ridge)
    factors, constants = [], []
    for w, v in zip(share, covs, strict=True):
        chol = np.linalg.cholesky((1 - shrink) * v + shrink * pooled)
        factors.append(np.linalg.inv(chol))
        constants.append(np.log(w) - np.log(np.diag(chol)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(constants))


def score(rows: DataFrame, model: Discriminant, keep: list, stats: str = "stats") -> DataFrame:
    d = len(NAMES)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(stats).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(model.posterior(x))], [*keep, "score"])

    slim = rows.select(*keep, stats)
    return slim.mapInArrow(run, slim.select(*keep).withColumn("score", F.lit(0.0)).schema)


def classify(
    docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality", key: str = "doc_id", text: str = "text",
    extra: dict | None = None,
) -> DataFrame:
    """Key, ``extra`` columns and ``score`` of every document; labels are learnt where ``training`` holds.

    The texts are read once: their statistics are stored and serve both the fit and the scores.
    """
    named = {key: F.col(key), **(extra or {}), "_learn": training}
    keep = list(named)
    source = docs.select(*[c.alias(n) for n, c in named.items()], F.col(text).alias("_body"))
    rows = store(with_statistics(source, keep, "_body"), "quality")
    known = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("label"))
    learnt = rows.where("_learn").join(known, F.col(key) == F.col("_id"))
    return score(rows, fit(learnt), keep[:-1])
