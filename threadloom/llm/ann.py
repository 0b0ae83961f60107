"""Nearest neighbours by shifted space-filling curves.

Vectors are projected onto random turns of their principal directions, shifted, and ordered along a Hilbert curve,
several times over; Spark range-partitions and sorts each ordering. A query meets the vectors whose rank on a curve is
within a window of its own, and the curves' finds are merged and reranked with the original vectors.

How wide a window has to be depends on the vectors alone: those in clusters need a narrow one, those spread evenly in
many directions nearly the whole table, as no projection keeps their neighbours together. So the width isn't a
constant: SAMPLE queries are compared with all rows, their true neighbours' ranks say how far the windows must reach to
hold RECALL of them, and of two curves, three and so on the cheapest number is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import bounded_join, map_rows, work_table
from threadloom.llm.near_dup import usable

K = 20
#: Orderings tried, dimensions and bits of each.
CURVES, DIMENSIONS, BITS = 4, 6, 10
#: Queries that windows are measured on, the share of their neighbours that windows must hold, and vectors that directions are learned on.
SAMPLE, RECALL, LEARN = 96, 0.96, 10_000
#: Queries of a stretch, about, rows that a window has at least, and tasks that there are at least.
QUERIES, BLOCK, PARTS = 1024, 4096, 16
#: Sums in another order may differ by so much, relative to the largest length squared.
SLACK = 1e-12


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of points with integer coordinates below 2**bits: the standard bit-plane transform."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    m = 1 << (bits - 1)
    q = m
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = m
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64, copy=False).reshape(-1, dim)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more component makes all lengths equal: the largest inner product is then the nearest point."""
    return np.column_stack([x, np.sqrt(np.maximum(0, top**2 - (x * x).sum(axis=1)))]) / top


def learn_curves(sample: np.ndarray, curves: int, dimensions: int = DIMENSIONS, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(directions, centre, spread) of each curve: random turns of the principal directions that hold nine tenths of the variance."""
    rng = np.random.default_rng(seed)
    centre = sample.mean(axis=0)
    values, axes = np.linalg.eigh(np.cov(sample - centre, rowvar=False).reshape(sample.shape[1], -1))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    held = np.cumsum(values) / max(values.sum(), 1e-300)
    useful = min(sample.shape[1], max(dimensions, int(np.searchsorted(held, 0.9)) + 1))
    out = []
    for _ in range(curves):
        turn, _ = np.linalg.qr(rng.standard_normal((useful, useful)))
        d = axes[:, :useful] @ turn[:, :dimensions]
        spread = np.maximum(((sample - centre) @ d).std(axis=0), 1e-12)
        shift = rng.uniform(-0.5, 0.5, d.shape[1])
        out.append((d, centre @ d - shift * spread, spread))
    return out


def curve_keys(x: np.ndarray, curve: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    d, middle, spread = curve
    cells = ((x @ d - middle) / (6 * spread) + 0.5) * (1 << BITS)
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add `rank`, from 0 in this order: range partitions are sorted and counted; only their counts reach the driver."""
    spark = df.sparkSession
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(m, part, dtype=np.int32)), pa.array(np.arange(n, n + m))], names=[*b.schema.names, "part", "nth"])
            n += m

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    numbered = work_table(parts.mapInArrow(number, f"{ddl}, part int, nth long"), name)
    counts = sorted(numbered.groupBy("part").count().collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    offsets = spark.createDataFrame(starts, "part int, before long")
    return numbered.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def _best(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    return scores.groupBy("q", "rep").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")


class Best:
    """The k best rows of each of some queries, while rows come in batches; a score hangs on its two vectors alone, ties go to the smaller rep."""

    def __init__(self, names: np.ndarray, ask: np.ndarray, k: int, slack: float):
        self.names, self.ask, self.k, self.slack = names, ask, k, slack
        self.worst = np.full(len(names), -np.inf)
        self.q, self.rep, self.score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)

    def meet(self, x: np.ndarray, reps: np.ndarray) -> None:
        s = self.ask @ x.T
        least = self.worst
        if s.shape[1] > self.k and np.isinf(least).any():
            least = np.maximum(least, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
        i, j = np.nonzero(s >= least[:, None] - self.slack)
        if not len(i):
            return
        q, rep = np.concatenate([self.q, i]), np.concatenate([self.rep, reps[j]])
        score = np.concatenate([self.score, np.einsum("ij,ij->i", self.ask[i], x[j])])
        order = np.lexsort((rep, -score, q))
        q, rep, score = q[order], rep[order], score[order]
        first = np.searchsorted(q, np.arange(len(self.names)))
        keep = np.arange(len(q)) - first[q] < self.k
        self.q, self.rep, self.score = q[keep], rep[keep], score[keep]
        full = np.bincount(self.q, minlength=len(self.names)) == self.k
        last = np.searchsorted(self.q, np.arange(len(self.names)), side="right") - 1
        self.worst[full] = self.score[last[full]]

    def rows(self) -> dict:
        return {"q": self.names[self.q], "rep": self.rep, "score": self.score}


def _sample_neighbours(points: DataFrame, sample: list, dim: int, k: int, top: float) -> DataFrame:
    """(q, rep, score): the true neighbours of a bounded sample of queries, found in one pass over all points."""
    names, ask = np.array([r["rep"] for r in sample]), np.array([r["v"] for r in sample], dtype=np.float64)
    slack = SLACK * top * top

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        best = Best(names, ask, k + 1, slack)
        for b in batches:
            best.meet(matrix(b.column(1), dim), b.column(0).to_numpy())
        yield best.rows()

    return _best(map_rows(points.select("rep", "v"), rows, "q long, rep long, score double").filter("q <> rep"), k)


def choose_windows(far: np.ndarray, total: int, recall: float, block: int) -> tuple[int, int]:
    """(curves, reach) at least cost: far holds the rank distances of true neighbours, a column for each curve. Windows have block rows at least."""
    if not len(far):
        return min(2, far.shape[1]), block
    choices = []
    for c in range(min(2, far.shape[1]), far.shape[1] + 1):
        reach = int(np.quantile(far[:, :c].min(axis=1), recall, method="higher"))
        choices.append((c * min(total, 2 * reach + block), c, reach))
    _, c, reach = min(choices)
    return c, max(reach, block // 2)


def _pairs(points: DataFrame, ranks: DataFrame, curves: int, reach: int, span: int, total: int, k: int, dim: int, top: float) -> DataFrame:
    """(q, rep, score): the k best of each query in the segments of its stretch's window on each curve.

    Queries of a stretch of `span` ranks meet all rows up to `reach` beyond it. Which rows and stretches meet follows from
    ranks alone, so that rows are copied without a join. A window comes in a few segments; a task holds the queries of
    one stretch and their best rows while the segment's rows pass by, however many they are.
    """
    stretches = max(1, math.ceil(total / span))
    parts = max(2, math.ceil(PARTS / (stretches * curves)))
    placed = points.join(ranks.filter(F.col("curve") < curves), "rep")
    r, wide = F.col("rank"), span + 2 * reach
    chunk = lambda c: F.least(F.greatest(F.floor(c / span), F.lit(0)), F.lit(stretches - 1))
    base = placed.withColumn("chunk", F.explode(F.sequence(chunk(r - reach), chunk(r + reach))))
    base = base.withColumn("part", F.floor((r - F.col("chunk") * span + reach) * parts / wide).cast("int"))
    asking = placed.filter("ask").withColumn("chunk", chunk(r)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    columns, key = ["rep", "v"], ["curve", "chunk", "part"]
    both = asking.select(*key, F.lit(0).alias("base"), *columns).unionByName(base.select(*key, F.lit(1).alias("base"), *columns))
    dealt = both.repartition(*key).sortWithinPartitions(*key, "base")
    slack = SLACK * top * top

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now = best = None
        names, vectors = [], []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            is_base, reps, x = b.column(3).to_numpy() == 1, b.column(4).to_numpy(), matrix(b.column(5), dim)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for at, stop in zip([0, *cuts], [*cuts, len(keys)]):
                if now is None or (keys[at] != now).any():
                    if best is not None:
                        yield best.rows()
                    now, best, names, vectors = keys[at], None, [], []
                some = slice(at, stop)
                asks = ~is_base[some]
                if asks.any():
                    names.append(reps[some][asks])
                    vectors.append(x[some][asks])
                if is_base[stop - 1] and names:
                    if best is None:
                        best = Best(np.concatenate(names), np.concatenate(vectors), k, slack)
                    best.meet(x[some][~asks], reps[some][~asks])
        if best is not None:
            yield best.rows()

    return map_rows(dealt, rows, "q long, rep long, score double")


def nearest(table: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best found other rows by inner product; ties to the smaller key.

    Vectors that are null, empty, zero or hold null or non-finite components and those with a null key take no part;
    vectors of different lengths are searches of their own. Equal vectors are one point of the search with the k + 1
    smallest of its keys, as no result can hold more of them; rows that repeat a key stay apart. Fewer candidates than k
    give fewer rows, an empty table none. Other columns of the table are left alone, whatever their names.
    """
    kind = table.select(vector).schema[0].dataType.elementType.typeName()
    numbers = F.col(vector) if kind in ("float", "double") else F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = table.select(F.col(key).cast("long").alias("id"), numbers.alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    # The limit of k + 1 keys is applied in each task before the shuffle.
    rows = work_table(rows.filter(F.col("id").isNotNull() & usable("v")), "vectors")
    firsts = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    asked = rows.filter("ask").select("v").distinct().withColumn("ask", F.lit(True))
    points = firsts.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"))
    points = work_table(points.join(asked, "v", "left").withColumn("ask", F.coalesce("ask", F.lit(False))).withColumn("dim", F.size("v")), "points")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("ask").alias("asks"), F.max(length).alias("top")).filter("asks > 0").orderBy("dim").collect()
    found = [_search(points.filter(F.col("dim") == s["dim"]), s["dim"], s["n"], s["asks"], s["top"], k, curves, block, recall) for s in sizes]
    if not found:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    # Points stand for all their rows: a query's own row is left out, ties go to smaller keys.
    each = best.join(points.select("rep", "ids"), "rep").withColumn("vec_id", F.explode("ids")).select("q", "score", "vec_id")
    asking = rows.filter("ask").select("id", "v").join(points.filter("ask").select("v", F.col("rep").alias("q")), "v").select(F.col("id").alias("query_id"), "q")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = asking.join(each, "q").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(points: DataFrame, dim: int, total: int, asks: int, top: float, k: int, curves: int, block: int, recall: float) -> DataFrame:
    """(q, rep, score): finds of all asking points of one length."""
    by_hash = lambda rows, n, of: rows if n >= of else rows.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * n / of))
    learned = np.array([r["v"] for r in by_hash(points, LEARN, total).select("v").toLocalIterator()], dtype=np.float64).reshape(-1, dim)
    made = learn_curves(lifted(learned if len(learned) > 1 else np.vstack([np.zeros(dim), np.ones(dim)]), top), curves, min(DIMENSIONS, dim + 1))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            y = lifted(matrix(b.column(1), dim), top)
            for c, curve in enumerate(made):
                yield {"curve": np.full(len(y), c, dtype=np.int32), "place": curve_keys(y, curve), "rep": b.column(0).to_numpy()}

    ordered = _ranked(map_rows(points.select("rep", "v"), keys, "curve int, place long, rep long"), ["curve", "place", "rep"], "curves")
    # Each curve holds every point once, so that ranks within it follow.
    ranks = work_table(ordered.select("curve", "rep", (F.col("rank") - F.col("curve").cast("long") * total).alias("rank")), "ranks")
    sample = by_hash(points.filter("ask"), SAMPLE, asks).select("rep", "v").limit(2 * SAMPLE).collect()
    true = work_table(_sample_neighbours(points, sample, dim, k, top), "sample-neighbours") if sample else None
    far = np.zeros((0, curves))
    if true is not None:
        own = bounded_join(ranks, true.select(F.col("q").alias("rep")).distinct(), ["rep"]).select("curve", F.col("rep").alias("q"), F.col("rank").alias("own"))
        there = bounded_join(ranks, true.select("q", "rep"), ["rep"])
        apart = there.join(own, ["curve", "q"]).select("q", "rep", "curve", F.abs(F.col("rank") - F.col("own")).alias("far"))
        pairs = apart.groupBy("q", "rep").agg(F.array_sort(F.collect_list(F.struct("curve", "far")))["far"].alias("far")).select("far").collect()
        far = np.array([r["far"] for r in pairs], dtype=np.int64).reshape(-1, curves)
    used, reach = choose_windows(far, total, recall, block)
    span = max(1, math.ceil(QUERIES * total / asks))
    return work_table(_best(_pairs(points.select("rep", "v", "ask"), ranks, used, reach, span, total, k + 1, dim, top), k + 1), "found")
