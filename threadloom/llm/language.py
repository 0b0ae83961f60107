"""Language identification by hierarchical discrimination: the family first, then the language within it.

A text is its letters' byte runs of one to three, hashed to a vector whose roots of counts have length one. Families are
told apart one against another by linear support vector machines, and so are the languages of each family; the machines
are fitted as Spark groups, one for each pair, on a bounded sample of labelled texts. Votes are the machines' logistic
margins, and a text's score is its family's vote times its language's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import held_out, map_rows, work_table
from threadloom.llm.words import LOWER, column_bytes

#: Distinct texts of each language that are learned from, at most about; a family has as many of all its languages.
TEXTS = 2_000
#: Languages that are learned at most, those with most texts.
LANGUAGES = 64
DIMS, GRAMS = 1 << 13, (1, 2, 3)
#: Texts are measured in runs of about so many bytes, and at most so many texts.
RUN, RUN_TEXTS = 1 << 18, 256
#: Weight of the losses against the squared weights; steepness of the votes.
COST, STEEP = 10.0, 3.0
UNKNOWN = "und"
#: Families by ISO 639-1 code; a language that isn't named is a family of its own.
FAMILIES = {
    "germanic": "en de nl af fy lb sv da no nb nn is fo yi",
    "romance": "fr es it pt ro ca gl oc an ast la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu se",
    "indic": "hi ur bn pa gu mr ne si",
    "iranian": "fa ku ps tg",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am",
    "malayic": "id ms jv su tl",
    "dravidian": "ta te kn ml",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "bantu": "sw zu xh",
}

_bytes = np.arange(256)
LETTERS = ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
_word = re.compile(r"[^\W\d_]")


def family_of(lang: str, families: dict[str, str] = FAMILIES) -> str:
    base = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, codes in families.items() if base in codes.split()), f"={lang}")


def measure(column: pa.Array, dims: int = DIMS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, has a letter, vectors) for runs of a column's whole texts; a text without letters has zeros, null is empty.

    Case is folded for ASCII and the Latin-1 letters; what isn't a letter's byte is one blank.
    """
    whole, offsets = column_bytes(column)
    first, total = 0, len(column)
    while first < total:
        last = min(total, first + RUN_TEXTS, max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN, side="right")) - 1))
        n = last - first
        data = LOWER[whole[offsets[first] : offsets[last]]]
        texts = offsets[first : last + 1] - offsets[first]
        letter = LETTERS[data]
        plain = np.concatenate([[0], np.cumsum(letter & (data < 128))])
        lettered = plain[texts[1:]] > plain[texts[:-1]]
        for i in np.flatnonzero(~lettered & (np.diff(texts) > 0)):
            part = data[texts[i] : texts[i + 1]]
            lettered[i] = bool((part >= 128).any()) and _word.search(part.tobytes().decode("utf-8", "ignore")) is not None
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        data[upper] += 0x20
        of = np.repeat(np.arange(n, dtype=np.int64), np.diff(texts))
        data = np.where(letter, data, 32).astype(np.uint64)
        kept = letter.copy()
        kept[1:] |= letter[:-1] & (of[1:] == of[:-1])  # one blank after a word
        kept &= lettered[of]
        data, of = data[kept], of[kept]
        x = np.zeros(n * dims)
        code = np.zeros(len(data), dtype=np.uint64)
        for k in range(max(GRAMS)):
            if len(data) <= k:
                break
            # Runs of k + 1 bytes that lie in one text.
            code = (code[: len(data) - k] << np.uint64(8)) | data[k:]
            if k + 1 not in GRAMS:
                continue
            mine = of[: len(data) - k] == of[k:]
            with np.errstate(over="ignore"):
                bucket = ((code + np.uint64((k + 1) << 32)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            x += np.bincount((of[: len(data) - k] * dims + (bucket % np.uint64(dims)).astype(np.int64))[mine], minlength=n * dims)
        x = np.sqrt(x, out=x).astype(np.float32).reshape(n, dims)
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
        yield first, last, lettered, x
        first = last


def fit_machine(x: np.ndarray, side: np.ndarray, cost: float = COST, rounds: int = 15) -> np.ndarray:
    """Weights and offset (last) of a linear support vector machine with squared hinge loss, both sides of equal weight.

    Newton's method, each step solved by conjugate gradients over the rows within the margin, and halved until the loss falls.
    """
    y = np.where(side, 1.0, -1.0).astype(np.float32)
    load = np.where(side, 0.5 / max(1, side.sum()), 0.5 / max(1, (~side).sum())).astype(np.float32) * cost * 100
    x = np.concatenate([x, np.ones((len(x), 1), dtype=np.float32)], axis=1)
    w = np.zeros(x.shape[1], dtype=np.float32)

    def loss(w: np.ndarray, f: np.ndarray) -> float:
        return 0.5 * float(w @ w) + float((load * np.maximum(0, 1 - y * f) ** 2).sum())

    f = x @ w
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * f)
        inner = x[gap > 0]
        own = load[gap > 0]
        grad = w - 2 * (inner.T @ (own * y[gap > 0] * gap[gap > 0]))
        step, r = np.zeros_like(w), -grad
        p, rr = r.copy(), float(r @ r)
        if rr < 1e-10:
            break
        stop = rr * 1e-4
        for _ in range(40):
            hp = p + 2 * (inner.T @ (own * (inner @ p)))
            a = rr / float(p @ hp)
            step += a * p
            r -= a * hp
            new = float(r @ r)
            if new < stop:
                break
            p, rr = r + (new / rr) * p, new
        along, at, size = x @ step, loss(w, f), 1.0
        while loss(w + size * step, f + size * along) > at and size > 1e-4:
            size /= 2
        if size <= 1e-4:
            break
        w, f = w + size * step, f + size * along
    return w


@dataclass(frozen=True)
class Model:
    """machines' columns are pairs of families, then pairs of languages of one family; a positive margin votes for the first."""

    languages: list[str]
    family: list[int]  # of each language
    family_pairs: list[tuple[int, int]]
    language_pairs: list[tuple[int, int]]
    machines: np.ndarray  # (dims + 1, pairs)

    def choose(self, x: np.ndarray, lettered: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, names = len(x), np.array([*self.languages, UNKNOWN], dtype=object)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        votes = 1 / (1 + np.exp(-np.clip(STEEP * (x @ self.machines[:-1] + self.machines[-1]), -30, 30)))
        k = len(self.family_pairs)
        by_family = _tally(votes[:, :k], self.family_pairs, max(self.family) + 1)
        by_language = _tally(votes[:, k:], self.language_pairs, len(self.languages))
        won = by_family.argmax(axis=1)
        inside = np.where(np.array(self.family)[None, :] == won[:, None], by_language, -1.0)
        at = inside.argmax(axis=1)
        row = np.arange(n)
        score = by_family[row, won] * inside[row, at]
        return names[np.where(lettered, at, len(self.languages))].tolist(), np.where(lettered, score, 0.0)


def _tally(votes: np.ndarray, pairs: list[tuple[int, int]], n: int) -> np.ndarray:
    """Mean vote of each of n choices over its pairs; 1 for a choice without any."""
    total, met = np.zeros((len(votes), n)), np.zeros(n)
    for j, (a, b) in enumerate(pairs):
        total[:, a] += votes[:, j]
        total[:, b] += 1 - votes[:, j]
        met[[a, b]] += 1
    return np.where(met > 0, total / np.maximum(met, 1), 1.0)


def learn(documents: DataFrame, families: dict[str, str] = FAMILIES, texts: int = TEXTS) -> Model:
    """A model from text and lang of rows that aren't held out, at most about `texts` distinct texts of each of LANGUAGES languages.

    Rows with a null id, text or lang, and texts without letters, teach nothing. Without any, every text is unknown.
    """
    rows = documents.select("text", "lang", F.xxhash64("text").alias("sign")).filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return Model([], [], [], [], np.zeros((DIMS + 1, 0), dtype=np.float32))
    own = [family_of(lang, families) for lang in languages]
    names = sorted(set(own))
    family = [names.index(f) for f in own]
    family_pairs = list(combinations(range(len(names)), 2))
    language_pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if family[a] == family[b]]

    # A text's sign says whether it is of the sample, so that copies are one text; a family's texts are shared by its languages.
    counts, spark = {r["lang"]: r["n"] for r in found}, documents.sparkSession
    shares = spark.createDataFrame([(lang, min(1.0, texts / counts[lang])) for lang in languages], "lang string, share double")
    part = F.pmod(F.col("sign"), F.lit(1 << 30)) / float(1 << 30)
    few = rows.join(F.broadcast(shares), "lang").filter(part < F.col("share"))  # at most LANGUAGES rows
    texts_of = few.groupBy("lang", "sign", "share").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for first, last, lettered, x in measure(b.column(2)):
                at = [np.flatnonzero(r) for r in x]
                keep = np.flatnonzero(lettered)
                yield {"lang": b.column(0).slice(first, last - first).take(pa.array(keep)), "part": b.column(1).slice(first, last - first).take(pa.array(keep)), "at": [at[i] for i in keep], "x": [x[i, at[i]] for i in keep]}

    # part: uniform within the language's sample.
    sample = work_table(map_rows(texts_of.select("lang", (part / F.col("share")).alias("part"), "text"), vectors, "lang string, part double, at array<int>, x array<float>"), "language-sample")
    pairs = [*[(a, b, family) for a, b in family_pairs], *[(a, b, list(range(len(languages)))) for a, b in language_pairs]]
    roles = []
    for k, (a, b, of) in enumerate(pairs):
        for first, side in ((a, True), (b, False)):
            members = [lang for lang, f in zip(languages, of) if f == first]
            roles += [(k, lang, side, 1.0 / len(members)) for lang in members]
    machines = np.zeros((DIMS + 1, len(pairs)), dtype=np.float32)
    if roles:
        cast = spark.createDataFrame(roles, "pair int, lang string, side boolean, upto double")

        def fit(table: pa.Table) -> pa.Table:
            sizes = pc.list_value_length(table.column("at")).to_numpy()
            x = np.zeros((table.num_rows, DIMS), dtype=np.float32)
            x[np.repeat(np.arange(len(x)), sizes), table.column("at").combine_chunks().flatten().to_numpy()] = table.column("x").combine_chunks().flatten().to_numpy()
            w = fit_machine(x, table.column("side").to_numpy())
            return pa.table({"pair": table.column("pair").slice(0, 1), "w": pa.array([w.tolist()], pa.list_(pa.float32()))})

        # A pair's rows are at most about twice `texts`, whatever the table's size.
        fitted = sample.join(F.broadcast(cast), "lang").filter(F.col("part") < F.col("upto")).groupBy("pair").applyInArrow(fit, "pair int, w array<float>")
        for r in fitted.collect():  # a vector for each pair of at most LANGUAGES languages
            machines[:, r["pair"]] = r["w"]
    return Model(languages, family, family_pairs, language_pairs, machines)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every whole text; null and letterless texts are unknown, with score 0. No shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a vector for each pair of at most LANGUAGES languages

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for first, last, lettered, x in measure(b.column(1)):
                lang, score = shared.value.choose(x, lettered)
                yield {"doc_id": b.column(0).slice(first, last - first), "lang_pred": lang, "score": score}

    return map_rows(documents.select("doc_id", "text"), rows, "doc_id long, lang_pred string, score double")
