"""Toxic passages: maximum-scoring segments over token log-odds with Dirichlet priors.

Tokens and their first letters are features; a feature's log-odds of toxic against other documents is smoothed by a
Dirichlet prior drawn from both, and features within noise are neutral. In a document every maximal scoring segment is
found in one scan over its tokens. Segment scores of clean documents follow an extreme-value law whose lambda solves
sum p(s) exp(lambda s) = 1; in its bits, lengths are comparable, and a logistic curve over bits gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import keep_rows, map_rows, training_labels, work_table
from threadloom.llm.words import NON_WORD, Run, distinct, runs

#: Labelled documents that are learned from, at most about.
LABELLED = 20_000
#: Features kept at most, those of largest |z| first.
FEATURES = 100_000
PREFIXES = (4, 5, 6)
#: Pseudo-documents of the prior; |z| (signed root of the likelihood ratio) below which a feature is neutral; cost of every token; bits of a significant passage.
PRIOR, Z, DRIFT, BITS = 10.0, 4.2, 0.5, 0.0
STEP, SPAN = 0.25, 20.0
#: Tokens over which repeats are counted.
NEAR = 200
PASSAGES = "array<struct<start:int,end:int,bits:double>>"


@dataclass(frozen=True)
class Model:
    """features are sorted; odds and z go with them. score = logistic(slope * bits + offset)."""

    features: np.ndarray
    odds: np.ndarray
    z: np.ndarray
    scale: float  # lambda
    log_k: float
    slope: float
    offset: float

    def bits(self, best: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return np.clip((self.scale * best - self.log_k - np.log(np.maximum(tokens, 1))) / np.log(2), -60, 60)

    def score(self, best: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.bits(best, tokens) + self.offset, -30, 30)))


def repeats(run: Run, places: np.ndarray, near: int = NEAR) -> np.ndarray:
    """How often each of some words (ascending places in run.words) occurs in its text's `near` words up to it, itself included."""
    text = np.searchsorted(run.at, places, side="right")
    order = np.lexsort((places, run.words[places], text))
    at, word, text = places[order], run.words[places[order]], text[order]
    group = np.cumsum(np.concatenate([[0], (word[1:] != word[:-1]) | (text[1:] != text[:-1])])) if len(at) else at
    line = group * (len(run.words) + near + 1) + at  # groups lie so far apart that no reach crosses them
    out = np.empty(len(places))
    out[order] = np.arange(len(at)) - np.searchsorted(line, line - near, side="right") + 1.0
    return out


def token_scores(run: Run, model: Model) -> np.ndarray:
    """Each token's score: the log-odds of its most telling feature, less DRIFT.

    The nth of equal tokens within NEAR tokens counts 1/n², so that one word can't fill a passage, while a passage scores
    the same wherever in its text it stands.
    """
    odds, z = np.zeros(len(run.words)), np.zeros(len(run.words))
    if len(model.features):
        for h in (run.words, *run.prefixes.values()):
            at = np.minimum(np.searchsorted(model.features, h), len(model.features) - 1)
            found = (model.features[at] == h) & (np.abs(model.z[at]) > z)
            odds[found], z[found] = model.odds[at[found]], np.abs(model.z[at[found]])
    hot = np.flatnonzero(odds > 0)
    odds[hot] /= repeats(run, hot) ** 2
    return odds - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by the linear scan of Ruzzo and Tompa."""
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    for i in np.flatnonzero(scores > 0).tolist():
        start, before, after = i, upto[i], upto[i + 1]
        held = (start, i + 1, before, after)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= held[2]:
                j -= 1
            if j < 0 or stack[j][3] >= held[3]:
                stack.append(held)
                break
            held = (stack[j][0], held[1], stack[j][2], held[3])
            del stack[j:]
    return [(s, e, b - a) for s, e, a, b in stack]


def learn(documents: DataFrame, labels: DataFrame, column: str = "toxic", bound: int = LABELLED) -> Model:
    """A model from training_labels' rows (bounded) and their whole texts. Without labels of both kinds it scores 0 or 1 as the only kind is, 0 without any."""
    chosen = training_labels(labels, column, bound)  # at most about `bound` rows of two numbers: broadcast
    # A doc_id that repeats counts once, by its smallest text, so that the bound holds for rows too.
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = work_table(found.select("label", "text"), "toxic-labelled")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    none = np.zeros(0)
    if not n1 or not n0:
        return Model(none.astype(np.uint64), none, none, 1.0, 0.0, 0.0, 30.0 if n1 else -30.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[np.ndarray] = [], []
        size = 0

        def sums() -> dict:
            f, c = zip(*(distinct(np.concatenate(h)) if h else (np.zeros(0, dtype=np.uint64),) * 2 for h in held))
            both = np.union1d(*f)
            out = np.zeros((2, len(both)), dtype=np.int64)
            for k in (0, 1):
                out[k, np.searchsorted(both, f[k])] = c[k]
            for h in held:
                h.clear()
            return {"feature": both.view(np.int64), "n0": out[0], "n1": out[1]}

        for b in batches:
            label = b.column(0).to_numpy()
            for run in runs(b.column(1), NON_WORD, PREFIXES):
                for i in range(run.last - run.first):
                    part = slice(run.at[i], run.at[i + 1])
                    found, _ = distinct(np.concatenate([run.words[part], *(p[part] for p in run.prefixes.values())]))
                    held[label[run.first + i]].append(found)
                    size += len(found)
                if size > 2_000_000:
                    yield sums()
                    size = 0
        yield sums()

    def smooth(c: str, total: int) -> Column:
        prior = (F.col("n0") + F.col("n1")) * (PRIOR / (n0 + n1)) + 0.01
        return F.log(F.col(c) + prior) - F.log(F.lit(total + PRIOR + 1.0) - F.col(c) - prior)

    def surprise(c: Column, total: int, of: int) -> Column:
        """A term of the likelihood ratio: observed times the log of observed over expected."""
        expected = (F.col("n0") + F.col("n1") if of else F.lit(n0 + n1) - F.col("n0") - F.col("n1")) * (total / (n0 + n1))
        return F.when(c > 0, c * F.log(c / expected)).otherwise(0.0)

    counts = map_rows(rows, count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = surprise(F.col("n1"), n1, 1) + surprise(F.col("n0"), n0, 1) + surprise(n1 - F.col("n1"), n1, 0) + surprise(n0 - F.col("n0"), n0, 0)
    telling = counts.withColumn("odds", smooth("n1", n1) - smooth("n0", n0)).withColumn("z", F.sqrt(F.greatest(F.lit(0.0), 2 * ratio)) * F.signum("odds")).filter(F.abs("z") >= Z)
    kept = sorted(tuple(r) for r in telling.orderBy(F.desc(F.abs("z")), "feature").limit(FEATURES).select("feature", "odds", "z").collect())
    features = np.array([r[0] for r in kept], dtype=np.int64).view(np.uint64)
    order = np.argsort(features)
    raw = Model(features[order], np.array([r[1] for r in kept])[order], np.array([r[2] for r in kept])[order], 1.0, 0.0, 1.0, 0.0)

    bins = int(2 * SPAN / STEP) + 1

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = np.zeros(bins, dtype=np.int64)
        for b in batches:
            label = b.column(0).to_numpy()
            for run in runs(b.column(1), NON_WORD, PREFIXES):
                s = token_scores(run, raw)
                own = label[run.first : run.last]
                best = [max((x[2] for x in segments(s[run.at[i] : run.at[i + 1]])), default=0.0) for i in range(len(own))]
                clean = np.repeat(own == 0, np.diff(run.at))
                seen += np.bincount(np.rint((np.clip(s[clean], -SPAN, SPAN) + SPAN) / STEP).astype(np.int64), minlength=bins)
                yield {"label": own, "best": best, "tokens": np.diff(run.at), "seen": [None] * len(own)}
        yield {"label": [None], "best": [None], "tokens": [None], "seen": [seen.tolist()]}

    got = map_rows(rows, measure, "label int, best double, tokens long, seen array<long>").collect()  # the bounded rows' figures
    seen = np.sum([r["seen"] for r in got if r["seen"] is not None], axis=0)
    label, best, tokens = (np.array([r[c] for r in got if r["seen"] is None], dtype=np.float64) for c in ("label", "best", "tokens"))
    scale, log_k = extreme_value(seen, best[label == 0], tokens[label == 0])
    model = Model(raw.features, raw.odds, raw.z, scale, log_k, 1.0, 0.0)
    slope, offset = logistic(model.bits(best, tokens), label)
    return Model(raw.features, raw.odds, raw.z, scale, log_k, slope, offset)


def extreme_value(seen: np.ndarray, best: np.ndarray, tokens: np.ndarray) -> tuple[float, float]:
    """(lambda, log K): lambda from the histogram of token scores in clean documents, K from the mean of their best segments."""
    s = np.arange(len(seen)) * STEP - SPAN
    p = seen / max(1, seen.sum())
    if not (p[s > 0] > 0).any() or (p * s).sum() >= 0:
        return 1.0, 0.0
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 500))).sum() < 1 else (low, mid)
    return low, float((low * best - np.log(np.maximum(tokens, 1))).mean() - np.euler_gamma)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method with a slight ridge; steps are halved until the loss falls, as it need not where the classes lie apart."""
    features, sign, w = np.stack([x / 10, np.ones(len(x))], axis=1), 2 * y - 1, np.zeros(2)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -sign * (features @ w)).sum() + ridge / 2 * w @ w)

    at = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -500, 500)))
        down = features.T @ (y - p) - ridge * w
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(2), down)
        while (new := loss(w + step)) > at - 1e-4 * float(step @ down) and np.abs(step).max() > 1e-9:
            step = step / 2
        if new >= at:
            break
        w, at = w + step, new
    return float(w[0] / 10), float(w[1])


def keep_clean(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """documents whose score is under threshold, in one pass; null and empty texts are judged as `score` does."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most FEATURES features

    def clean(texts: pa.Array) -> np.ndarray:
        out = np.ones(len(texts), dtype=bool)
        for run in runs(texts, NON_WORD, PREFIXES):
            s = token_scores(run, shared.value)
            best = np.array([max((x[2] for x in segments(s[run.at[i] : run.at[i + 1]])), default=0.0) for i in range(run.last - run.first)])
            out[run.first : run.last] = shared.value.score(best, np.diff(run.at)) < threshold
        return out

    return keep_rows(documents, "text", clean)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages): whole texts, every row; passages are the significant segments in characters, with their bits.

    A null or empty text has no passage and the score of the best segment 0. No shuffle: splits are scored where they lie.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most FEATURES features

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = shared.value
        for b in batches:
            ids = b.column(0)
            for run in runs(b.column(1), NON_WORD, PREFIXES):
                s = token_scores(run, model)
                letters = np.concatenate([[0], np.cumsum((run.raw & 0xC0) != 0x80)])
                found = [segments(s[run.at[i] : run.at[i + 1]]) for i in range(run.last - run.first)]
                tokens = np.diff(run.at)
                best = np.array([max((x[2] for x in f), default=0.0) for f in found])
                passages = []
                for i, f in enumerate(found):
                    bits = model.bits(np.array([x[2] for x in f]), np.full(len(f), tokens[i]))
                    place = lambda at, i=i: int(letters[at] - letters[run.texts[i]])
                    passages.append([{"start": place(run.starts[run.at[i] + x[0]]), "end": place(run.ends[run.at[i] + x[1] - 1]), "bits": float(v)} for x, v in zip(f, bits) if v > BITS])
                yield {"doc_id": ids[run.first : run.last], "score": model.score(best, tokens), "passages": passages}

    return map_rows(documents.select("doc_id", "text"), rows, f"doc_id long, score double, passages {PASSAGES}")
