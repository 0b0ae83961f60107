"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of rotated vectors are balanced and close to the vectors;
the codes are cut into tables. Two vectors meet where a table's stretch of their codes is equal, and the cosine of the
original vectors decides. Equal vectors are one class before any pair is looked at, and a pair counts in the first
table in which it meets, so that sums over tables are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import map_rows, work_table
from threadloom.llm.components import components

THRESHOLD = 0.93
#: Vectors that the rotations are learned on, at most.
SAMPLE = 20_000
#: Rows of a bucket that one task compares with as many others.
BLOCK = 512
#: Tasks over which the rows of one class of equal vectors are spread.
SALTS = 16
#: Bits of a table's codes at most, and what a row of a table costs, in comparisons.
MOST_BITS, ROW = 24, 64
#: Rows of small buckets that are compared in one call, about.
TOGETHER = 4096
#: Sums in another order may differ by so much.
SLACK = 1e-12
LINKS = "rep long, links long, hook long"
#: Chance to miss a pair right at the threshold in every table, were its code bits independent.
MISS = 0.01


def usable(vector: str) -> Column:
    """Not null, empty or zero, and without null or non-finite components."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def learn_rotations(sample: np.ndarray, n: int, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """n rotations (n, d, d) by iterative quantisation: codes are signs, the rotation is their best orthogonal fit."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    out = []
    for _ in range(n):
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(rounds if len(sample) >= d else 0):
            u, _, w = np.linalg.svd(np.sign(sample @ r).T @ sample)
            r = (u @ w).T
        out.append(r)
    return np.array(out)


def tables_for(bits: int, threshold: float) -> int:
    """So many tables of codes of so many bits that MISS holds."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(MISS) / math.log(1 - same)))


def choose_bits(signs: np.ndarray, labels: np.ndarray, rows: int, threshold: float) -> int:
    """The width at least cost: a comparison for each pair that shares a bucket in a table, by the collisions of the sample's sign bits, and ROW comparisons for each row of a table."""
    n = len(signs)
    pairs = rows / max(1, n)  # pairs grow with the square of rows, the sample's pairs are seen
    costs = []
    for bits in range(min(4, signs.shape[1]), min(MOST_BITS, signs.shape[1]) + 1):
        key = signs[:, :bits] @ (1 << np.arange(bits, dtype=np.int64))
        _, counts = np.unique(np.stack([labels, key]), axis=1, return_counts=True)
        together = float((counts.astype(np.float64) * (counts - 1)).sum()) / 2 * pairs * pairs
        costs.append((tables_for(bits, threshold) * (together + ROW * rows), bits))
    return min(costs)[1]


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """A row per input row: key, n_links, component_id, kept.

    Rows link when their labels are equal and not null and their cosine is at least threshold; vectors that `usable`
    refuses link with nothing, those of different lengths never. Rows that repeat a vector all link with each other.
    component_id is the smallest key reachable; a row with a null key links with nothing and is kept. Keys are taken to
    be unique: rows that share a key share its links. An empty table gives no rows. Other columns are left alone.
    """
    kind = table.select(vector).schema[0].dataType.elementType.typeName()
    numbers = F.col(vector) if kind in ("float", "double") else F.transform(F.col(vector), lambda x: x.cast("double"))
    table = table.select(F.col(key).cast("long").alias("k"), F.col(label).cast("long").alias("label"), numbers.alias("v"))
    good = F.col("k").isNotNull() & F.col("label").isNotNull() & usable("v")
    rows = work_table(table.filter(good), "vectors")
    alone = table.filter(~good).select("k", F.lit(0).cast("long").alias("links"), F.col("k").alias("comp"))
    # Classes of equal vectors: the smallest key stands for them; counts are partial before the shuffle.
    classes = work_table(rows.groupBy("label", "v").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("weight")).withColumn("dim", F.size("v")), "classes")
    sizes = classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n"), F.sum("count").alias("total")).filter("n > 1").orderBy("dim").collect()  # a row for each length of vectors
    found = classes.sparkSession.createDataFrame([], LINKS)
    for s in sizes:
        found = found.unionByName(_links(classes.filter(F.col("dim") == s["dim"]), s["dim"], s["total"], threshold))
    found = work_table(found, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rep").alias("u"), F.col("hook").alias("v")))
    named = classes.join(links, "rep", "left").join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    # Back to rows: classes of several rows are spread over SALTS tasks, as one may hold a third of all rows.
    all_salts = F.array(*[F.lit(x) for x in range(SALTS)])
    own_salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    named = named.select(
        "label", "v", F.explode(F.when(F.col("weight") > 1, all_salts).otherwise(F.array(own_salt("rep")))).alias("salt"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("comp", "rep").alias("comp"),
    )
    joined = rows.withColumn("salt", own_salt("k")).join(named, ["label", "v", "salt"]).select("k", "links", "comp")
    return joined.unionByName(alone).select(
        F.col("k").alias(key), F.col("links").cast("long").alias("n_links"), F.col("comp").alias("component_id"), F.col("k").eqNullSafe(F.col("comp")).alias("kept")
    )


def _links(classes: DataFrame, dim: int, total: int, threshold: float) -> DataFrame:
    """(rep, links, hook): for classes of one length, partial sums of the rows each links with and a class that it hangs together with."""
    take = classes
    if total > SAMPLE:
        take = take.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / total))
    drawn = take.select("v", "label").collect()  # about SAMPLE rows at most
    sample = np.array([r["v"] for r in drawn], dtype=np.float64).reshape(-1, dim)
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else np.zeros((1, dim))
    first = learn_rotations(sample, 1)
    bits = choose_bits((sample @ first[0] > 0).astype(np.int64), np.array([r["label"] for r in drawn] or [0]), total, threshold)
    n_tables, width = tables_for(bits, threshold), max(1, dim // bits)
    needed = math.ceil(n_tables / width)
    rotations = classes.sparkSession.sparkContext.broadcast(np.concatenate([first, learn_rotations(sample, needed - 1, seed=8)]) if needed > 1 else first)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            reps, labels, weights = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            x = b.column(3).flatten().to_numpy().astype(np.float64, copy=False).reshape(-1, dim)
            codes = []
            for r in rotations.value:
                on = (x @ r) > 0
                codes += [on[:, i * bits : (i + 1) * bits] @ powers for i in range(width)]
            codes = np.stack(codes[:n_tables], axis=1).astype(np.int32)
            m = len(reps)
            for t in range(codes.shape[1]):
                yield {"rep": reps, "label": labels, "weight": weights, "tab": np.full(m, t, dtype=np.int32), "code": codes[:, t], "codes": list(codes), "v": b.column(3)}

    kind = classes.schema["v"].dataType.simpleString()
    spread = map_rows(classes.select("rep", "label", "weight", "v"), coded, f"rep long, label long, weight long, tab int, code int, codes array<int>, v {kind}")
    bucket = ["label", "tab", "code"]
    # Buckets of up to BLOCK classes are compared several in one call. Larger ones are cut into blocks by a hash, as many
    # as their counts need, and each pair of blocks is one task's group.
    counts = spread.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    big = F.col("blocks") > 1
    task = F.when(~big, F.pmod(F.xxhash64(*bucket), F.lit(max(1, total * n_tables // TOGETHER))))
    placed = (
        spread.join(work_table(counts, "buckets"), bucket)
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))
        .withColumn("task", task).withColumn("part", F.when(big, F.struct(*bucket, "bi", "bj")))
        .drop("n", "blocks", "other")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64, copy=False)
        x, codes = v / np.linalg.norm(v, axis=1, keepdims=True), np.stack(pdf["codes"].to_numpy())
        reps, weights, tabs, own = (pdf[c].to_numpy() for c in ("rep", "weight", "tab", "own"))
        bi, bj = int(pdf["bi"].iat[0]), int(pdf["bj"].iat[0])
        if bi != bj:
            sides = [(np.flatnonzero(own == bi), np.flatnonzero(own == bj))]
        else:
            order = np.lexsort((pdf["code"].to_numpy(), tabs, pdf["label"].to_numpy()))
            names = np.stack([pdf[c].to_numpy() for c in bucket])[:, order]
            starts = np.flatnonzero(np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(axis=0)]))
            sides = [(s, s) for s in np.split(order, starts[1:])]
        out = []
        for a, b in sides:
            if len(a) and len(b):
                out += _compared(a, b, x, codes, reps, weights, int(tabs[a[0]]), threshold)
        rep, links, hook = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (list(zip(*out)) or [(), (), ()]))
        return pd.DataFrame({"rep": rep, "links": links, "hook": hook})

    return placed.groupBy("task", "part").applyInPandas(compare, LINKS)


def _compared(a: np.ndarray, b: np.ndarray, x: np.ndarray, codes: np.ndarray, reps: np.ndarray, weights: np.ndarray, t: int, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(reps, links, hooks) of the rows a and b of one bucket of table t: pairs that an earlier table has seen don't count again."""
    i, j = np.nonzero(x[a] @ x[b].T >= threshold - SLACK)
    if a is b:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return []
    # A pair's cosine hangs on its two vectors alone, so that it is the same in whatever block they meet.
    fresh = (np.einsum("ij,ij->i", x[a[i]], x[b[j]]) >= threshold) & ~(codes[a[i], :t] == codes[b[j], :t]).any(axis=1)
    u, v = a[i[fresh]], b[j[fresh]]
    if not len(u):
        return []
    rows, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    p, q = places[: len(u)], places[len(u) :]
    links = np.bincount(p, weights[v], len(rows)) + np.bincount(q, weights[u], len(rows))
    name = reps[rows].copy()
    while True:  # rows take the smallest name among their partners until nothing changes
        new = name.copy()
        np.minimum.at(new, p, name[q])
        np.minimum.at(new, q, name[p])
        if (new == name).all():
            return [(reps[rows], links.astype(np.int64), name)]
        name = new
