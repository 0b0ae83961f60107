"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Each text becomes a few surface figures, each cut into quantile bins; a linear classifier over bins minimises
pi * E_p[loss(g)] + max(0, E_u[loss(-g)] - pi * E_p[loss(-g)]) over trusted positives and unlabelled web text. The
class prior pi is estimated as the least ratio of unlabelled to trusted mass above any score of a first classifier
that tells trusted from unlabelled text, counted over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import map_rows, training_labels, work_table
from threadloom.llm.words import WHITE, distinct, grams, per_text, runs

#: Trusted positives and unlabelled documents that the classifier is fitted on, at most about.
TRUSTED, UNLABELLED = 15_000, 25_000
CUTS = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.995])
#: Quantiles are within one row in so many.
ACCURACY = 5_000
#: Least share of trusted text above a score at which the prior is read.
LEAST = 0.3
BINS = 400

_char = [chr(b) for b in range(128)]
UPPER, LETTER, DIGIT = (np.array([f(c) for c in _char] + [False] * 128) for f in (str.isupper, str.isalpha, str.isdigit))
COMMON = np.array([c in ".,;:!?'\"-()" for c in _char] + [False] * 128)
SYMBOL = np.array([c.isprintable() and not c.isalnum() and c not in " .,;:!?'\"-()" for c in _char] + [False] * 128)
OTHER = np.arange(256) >= 128


def figures(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, figures) for runs of a column's whole texts; an empty text's figures are all 0."""
    for run in runs(column, WHITE):
        n = run.last - run.first
        words = np.maximum(np.diff(run.at), 1)
        size = np.maximum(np.diff(run.texts), 1)
        share = lambda table, of=size: per_text(table[run.raw], run.texts) / of
        word_sum = lambda mask: per_text(mask, run.at) / words
        lengths = run.ends - run.starts
        kinds = np.concatenate([[0], np.cumsum(LETTER[run.raw] | OTHER[run.raw])])
        lines = per_text(run.raw == 10, run.texts) + 1
        same = np.concatenate([run.words[1:] == run.words[:-1], [False]]) if len(run.words) else np.zeros(0, dtype=bool)
        last = run.raw[run.ends - 1]
        repeat = np.zeros((n, 5))
        line_ends = np.flatnonzero(run.raw == 10)
        for i in range(n):
            w = run.words[run.at[i] : run.at[i + 1]]
            if not len(w):
                continue
            found, times = distinct(w)
            three, _ = distinct(grams(w, 3))
            cuts = line_ends[np.searchsorted(line_ends, run.texts[i]) : np.searchsorted(line_ends, run.texts[i + 1])]
            parts = np.split(w, np.searchsorted(run.starts[run.at[i] : run.at[i + 1]], cuts)) if len(cuts) else [w]
            heads = {(int(p[0]), int(p[-1]), len(p)) for p in parts if len(p)}
            repeat[i] = (np.log(len(found)) / np.log(len(w)) if len(w) > 1 else 1, times.max() / len(w), len(three) / max(1, len(w) - 2), len(heads) / max(1, sum(map(bool, map(len, parts)))), len(found) / len(w))
        yield run.first, run.last, np.column_stack([
            np.log1p(np.diff(run.at)), np.log1p(np.diff(run.texts)), per_text(lengths, run.at) / words,
            share(UPPER, np.maximum(per_text(LETTER[run.raw], run.texts), 1)), share(DIGIT), share(COMMON), share(SYMBOL), share(OTHER),
            lines / words, word_sum(same), word_sum(SYMBOL[last]), word_sum(kinds[run.ends] == kinds[run.starts]), share(np.arange(256) == 33, words),
            word_sum(lengths > 20), share(np.arange(256) == 46, words), word_sum(UPPER[run.raw[run.starts]]), share(COMMON, words), repeat,
        ]).astype(np.float32) * (np.diff(run.at) > 0)[:, None]


@dataclass(frozen=True)
class Model:
    """score = logistic(offset + sum of the weights of each figure's bin); shift is added so that 1/2 is even odds."""

    edges: np.ndarray  # figures x cuts
    weights: np.ndarray  # figures x (cuts + 1)
    offset: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = np.full(len(x), self.offset)
        for j in range(len(self.edges)):
            g += self.weights[j][np.searchsorted(self.edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    width = edges.shape[1] + 1
    out = np.zeros((len(x), len(edges) * width), dtype=np.float32)
    for j in range(len(edges)):
        out[np.arange(len(x)), j * width + np.searchsorted(edges[j], x[:, j], side="right")] = 1
    return out


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, rounds: int, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk for a class prior; without one, on the plain risk of telling p from u."""
    d = p.shape[1]
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, rounds + 1):
        gp, gu = p @ w[:d].astype(np.float32) + w[d], u @ w[:d].astype(np.float32) + w[d]
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
        if prior is None:
            cp, cu = (sp - 1) / len(p), su / len(u)
        else:
            rest = np.log1p(np.exp(np.clip(gu, -30, 30))).mean() - prior * np.log1p(np.exp(np.clip(gp, -30, 30))).mean()
            # Below 0 the classifier has begun to fit single texts: its negative part is climbed back up.
            sign = 1.0 if rest >= 0 else -1.0
            cp, cu = prior * (sp - 1) * (rest >= 0) / len(p) - sign * prior * sp / len(p), sign * su / len(u)
        grad = np.append(p.T @ cp.astype(np.float32) + u.T @ cu.astype(np.float32), cp.sum() + cu.sum())
        grad[:d] += ridge * w[:d]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:d], float(w[d])


def features(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, x, key): the figures of every whole text, and the column of documents that names its row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for first, last, x in figures(b.column(1)):
                yield {"doc_id": b.column(0)[first:last], "x": list(x), "key": b.column(2)[first:last]}

    return map_rows(documents.select("doc_id", "text", F.col(key).alias("key")), rows, "doc_id long, x array<float>, key long")


def _matrix(rows: DataFrame) -> np.ndarray:
    return np.array([r[0] for r in rows.select("x").toLocalIterator()], dtype=np.float32)


def learn(measured: DataFrame, labels: DataFrame, column: str = "quality") -> Model | None:
    """A model from `features`' rows and trusted labels (those of 1 alone); None where there are no texts or no positives."""
    spark = measured.sparkSession
    trusted = training_labels(labels, column, TRUSTED).filter("label = 1").select("doc_id")  # at most about TRUSTED ids
    # A doc_id that repeats counts once, by its smallest figures, so that the bound holds for rows too.
    positives = measured.join(F.broadcast(trusted), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).select("x")
    total = measured.count()
    p = _matrix(positives)
    u = _matrix(measured.filter(F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, UNLABELLED / max(1, total)))))
    if not len(p) or not len(u):
        return None
    # The bins are cut by quantiles over all rows.
    cuts = measured.agg(*[F.percentile_approx(F.get("x", F.lit(j)), [float(c) for c in CUTS], ACCURACY).alias(f"e{j}") for j in range(p.shape[1])]).first()
    edges = np.array(cuts, dtype=np.float64)
    bp, bu = _binned(p, edges), _binned(u, edges)
    width = edges.shape[1] + 1
    w, offset = _descend(bp, bu, None, 150)
    telling = Model(edges, w.reshape(-1, width), offset, 0.5)
    shared = spark.sparkContext.broadcast(telling)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = np.zeros(BINS, dtype=np.int64)
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            seen += np.bincount(np.minimum((shared.value.score(x) * BINS).astype(np.int64), BINS - 1), minlength=BINS)
        yield {"bin": np.arange(BINS), "n": seen}

    def histogram(rows: DataFrame) -> np.ndarray:
        out = np.zeros(BINS)
        for r in map_rows(rows.select("x"), place, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
            out[r["bin"]] = r["n"]
        return out

    above = lambda h: np.cumsum(h[::-1]) / max(1, h.sum())
    in_p, in_u = above(histogram(positives)), above(histogram(measured))
    use = in_p >= LEAST
    prior = float(np.clip((in_u[use] / in_p[use]).min(), 0.02, 0.98))
    w, offset = _descend(bp, bu, prior, 250)
    return Model(edges, w.reshape(-1, width), offset, prior)


def score(measured: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for every row of `features`, doc_id being its key; without a model every score is 0."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            yield {"doc_id": b.column(0), "score": shared.value.score(x) if shared.value is not None else np.zeros(b.num_rows)}

    return map_rows(measured.select("key", "x"), rows, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, score) for every row, named by key: learn on bounded rows, score all. Null and empty texts have figures of 0."""
    measured = work_table(features(documents, key), "quality-figures")
    return score(measured, learn(measured, labels))
