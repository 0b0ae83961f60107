"""Exact Jaccard join of documents' word n-gram sets by vertical partitioning.

The global order of n-grams is that of their hashes; a document's set is cut by it into fragments, as many as its size
class needs for this: two sets that link differ in at most d n-grams, so that of more than d fragments some are equal
in both. Documents with an equal fragment become candidates, in chains rather than pairs. Within a chain's connected
documents, overlaps are counted fragment by fragment of the order, summed per pair, and compared with the threshold.

N-grams of many documents (a shared passage) are left out of the fragments that make candidates where enough others
remain; this changes which pairs are candidates, never which link: with k fragments of which at most k - d - 1 are
empty, some equal fragment isn't empty. Documents that have too few others ("poor") also give fragments of their whole
sets, and empty ones where these are too many: two poor documents meet there, and any other pair has met already.

Of the k fragments the k - d - 1 of the fewest n-grams are left out too, in an order that their content alone gives: of
more fragments that are equal in both sets, no more than these lie below the place where either set begins. A single
n-gram that two texts share by chance thus makes no candidates, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import bounded_join, discard, drop_shuffles, keyed, map_rows, unused, work_table
from threadloom.llm.components import components
from threadloom.llm.words import WHITE, distinct, grams, mix, runs

WORDS = 4
PERCENT = 85
#: An n-gram that so many documents hold (as far as tasks see it repeat) is frequent; so many are known at most.
FREQUENT, KNOWN = 64, 1_000_000
#: N-grams among which a task looks for repeats at once.
CHUNK = 2_000_000
#: Documents of a block, and columns of the overlap count's fragments.
BLOCK, COLUMNS = 256, 4096
#: Small candidate groups that are compared in one call, about.
TOGETHER = 256
SALTS = 16
#: Signatures are met in so many passes over the texts, as they take more room than these.
PASSES = 2
#: Stands for groups too small for blocks of their own.
POOL = -(1 << 63)


@dataclass(frozen=True)
class Sizes:
    """Size classes: two sets can only link within a class or with the next one."""

    percent: int
    starts: np.ndarray  # smallest size of each class

    @classmethod
    def of(cls, percent: int, largest: int = 1 << 40) -> Sizes:
        starts = [1]
        while starts[-1] <= largest:
            # The next class begins beyond all sizes that the smallest of this one can link with.
            starts.append(starts[-1] * 100 // percent + 1)
        return cls(percent, np.array(starts))

    def of_size(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def differ(self, c: int) -> int:
        """The most n-grams in which linked sets differ, the smaller of class c and the other of c or c + 1."""
        small = int(self.starts[c + 1]) - 1
        both = small + min(small * 100 // self.percent, int(self.starts[c + 2]) - 1)
        return (100 - self.percent) * both // (100 + self.percent)

    def fragments(self, c: int) -> int:
        return 1 + self.differ(c) * 13 // 10


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fragment_signatures(found: np.ndarray, k: int, salt: int, room: int, empty: bool) -> tuple[np.ndarray, int]:
    """(signatures of a sorted set's k fragments without the `room` smallest, how many are empty).

    If more than `room` are empty, all others are given; the empty ones too only if asked for.
    """
    place = ((found >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(found), dtype=np.uint64)])
        cuts = np.searchsorted(place, np.arange(k + 1, dtype=np.uint64))
        content = total[cuts[1:]] - total[cuts[:-1]]
        size = np.diff(cuts)
        none = k - int(np.count_nonzero(size))
        key = np.uint64(salt) * np.uint64(0xD6E8FEB86659FD93) + np.arange(k, dtype=np.uint64)
        out = mix(content + mix(key))
    if none > room:
        return (out if empty else out[size > 0]), none
    return out[np.lexsort((out, size))[room:]], none


def signatures(found: np.ndarray, frequent: np.ndarray, sizes: Sizes) -> np.ndarray:
    """All signatures under which a set meets the sets it may link with."""
    n = len(found)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        rare = found[frequent[at] != found]
    else:
        rare = found
    own, out = sizes.of_size(n), []
    for c in (own, own - 1) if own else (own,):
        k, room = sizes.fragments(c), sizes.fragments(c) - sizes.differ(c) - 1
        got, none = fragment_signatures(rare, k, 2 * c, room, False)
        out.append(got)
        if none > room:
            out.append(fragment_signatures(found, k, 2 * c + 1, room, True)[0])
    return np.concatenate(out)


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for run in runs(column, WHITE):
        for i in range(run.last - run.first):
            yield run.first + i, distinct(grams(run.words[run.at[i] : run.at[i + 1]], n))[0]


def _digest(found: np.ndarray) -> int:
    """A number for a whole set."""
    if not len(found):
        return 0
    with np.errstate(over="ignore"):
        return int(signed(mix(np.array([mix(found).sum(dtype=np.uint64) + np.uint64(len(found))])))[0])


def overlaps(a: list[np.ndarray], b: list[np.ndarray], columns: int = COLUMNS) -> np.ndarray:
    """Sizes of all intersections of sets of a with sets of b: partial counts per fragment of the order, summed."""
    both = a if b is a else [*a, *b]
    values = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    held = np.bincount(column)[column] > 1
    values, owner, column = values[held], owner[held], column[held]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for first in range(0, int(column.max()) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [first, first + columns])
        part = np.zeros((len(both), min(columns, int(column[hi - 1]) - first + 1)), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        out += part[: len(a)] @ (part if b is a else part[len(a) :]).T
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    same = overlaps(a, b).astype(np.int64)
    return 100 * same >= percent * (na[:, None] + nb[None, :] - same)


def _names(hit: np.ndarray) -> np.ndarray:
    """The first row connected with each row of a symmetric matrix of links."""
    name = np.arange(len(hit))
    i, j = np.nonzero(hit)
    while True:
        new = name.copy()
        np.minimum.at(new, i, name[j])
        new = new[new]
        if (new == name).all():
            return name
        name = new


def join_sets(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row for every row of documents.

    Words are runs of bytes without ASCII white space, A-Z lower-cased. component_id is the smallest doc_id reachable by
    links. A null or blank text has 0 shingles and is alone; a row with a null doc_id links as others do and lends its
    set no name, so its component_id is null where only such rows hang together. Rows that repeat a doc_id are rows of
    their own. Equal sets link wherever they are; a hot set is one candidate, however many rows have it.
    """
    key = unused(documents, "row_key")
    return _join_rows(keyed(documents, "join-rows", key).select(F.col(key).alias("key"), "doc_id", "text"), words, percent)


def _join_rows(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """join_sets of rows (key, doc_id, text) whose keys are their own."""
    spark, sizes = texts.sparkSession, Sizes.of(percent)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0

        def repeats() -> dict:
            found, times = distinct(np.concatenate(held)) if held else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
            many = times > 1
            held.clear()
            m = int(many.sum())
            return {"key": [None] * m, "doc_id": [None] * m, "n_shingles": times[many], "set": signed(found[many]), "gram": np.ones(m, dtype=bool)}

        for b in batches:
            n, digests = [], []
            for _, found in _sets(b.column(2), words):
                n.append(len(found))
                digests.append(_digest(found))
                held.append(found)
                size += len(found)
                if size > CHUNK:
                    yield repeats()
                    size = 0
            yield {"key": b.column(0), "doc_id": b.column(1), "n_shingles": n, "set": digests, "gram": np.zeros(len(n), dtype=bool)}
        yield repeats()

    profiles = work_table(map_rows(texts, profile, "key long, doc_id long, n_shingles long, set long, gram boolean"), "profiles")
    frequent = profiles.filter("gram").groupBy("set").agg(F.sum("n_shingles").alias("n")).filter(F.col("n") >= FREQUENT)
    known = frequent.orderBy(F.desc("n"), "set").limit(KNOWN).select("set").toPandas()["set"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast(np.sort(known.view(np.uint64)))  # at most KNOWN numbers: 8 MB

    def cut(batches: Iterator[pa.RecordBatch], nth: int) -> Iterator[dict]:
        seen: set[int] = set()
        for b in batches:
            sig, own = [], []
            size = 0
            for _, found in _sets(b.column(1), words):
                name = _digest(found)
                if not len(found) or name in seen:
                    continue
                seen.add(name)
                every = signatures(found, shared.value, sizes)
                sig.append(every[every % np.uint64(PASSES) == nth])
                own.append(np.full(len(sig[-1]), name))
                size += len(sig[-1])
                if size > 200_000:
                    yield {"sig": signed(np.concatenate(sig)), "set": np.concatenate(own)}
                    sig, own, size = [], [], 0
            if sig:
                yield {"sig": signed(np.concatenate(sig)), "set": np.concatenate(own)}

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sig, own = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for b in batches:
            sig, own = np.concatenate([sig[-1:], b.column(0).to_numpy()]), np.concatenate([own[-1:], b.column(1).to_numpy()])
            meet = np.flatnonzero((sig[1:] == sig[:-1]) & (own[1:] != own[:-1]))
            if len(meet):
                u, v = pd.DataFrame({"u": own[meet], "v": own[meet + 1]}).drop_duplicates().to_numpy().T
                yield {"u": u, "v": v}

    met = []
    for nth in range(PASSES):
        cuts = map_rows(texts.select("key", "text"), partial(cut, nth=nth), "sig long, set long").repartition("sig").sortWithinPartitions("sig", "set")
        met.append(work_table(map_rows(cuts, chain, "u long, v long"), "met"))
        drop_shuffles(spark)
    near = components(reduce(DataFrame.unionByName, met))
    discard(*met)

    # Candidates' sets are made anew from the text of one row each.
    sets = profiles.filter("not gram and n_shingles > 0").groupBy("set", "n_shingles").agg(F.min("doc_id").alias("first"), F.min("key").alias("held_by"), F.count(F.lit(1)).alias("rows"))
    sets = work_table(sets, "sets")
    named = work_table(sets.join(near.withColumnRenamed("node", "set"), "set").select("set", "held_by", "n_shingles", F.col("comp").alias("chain")), "candidates")
    counts = named.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    total = named.count()
    at_class = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / percent) * 1.0001)).cast("int")
    placed = work_table(named.join(counts, "chain").withColumn("level", at_class).withColumn("big", F.col("n") > BLOCK), "placed")
    # Chains of up to BLOCK sets are compared several in one call.
    none = F.lit(None).cast("int")
    small = placed.filter("not big").select("set", "chain", F.lit(0).alias("level"), F.lit(0).alias("part"), F.pmod(F.xxhash64("chain"), F.lit(max(1, total // TOGETHER))).alias("task"), none.alias("l2"), none.alias("p2"), F.lit(False).alias("second"))
    # Larger ones come in blocks of one level: sizes of one power of 100 / percent, so that linked sets lie in the same or
    # in neighbouring levels. First every block meets its own sets and the hubs, the smallest sets of its chain's levels
    # in reach: a group of near copies hangs together by then, in time that grows with its size alone.
    large = placed.filter("big")
    parted = large.join(large.groupBy("chain", "level").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"), F.min("set").alias("hub")), ["chain", "level"])
    parted = parted.withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    near_levels = F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1))
    hubs = parted.select("chain", "hub", near_levels.alias("level")).distinct()
    blocks = parted.select("chain", "level", "part").distinct()
    meeting = parted.select("set", "chain", "level", "part").unionByName(blocks.join(hubs, ["chain", "level"]).select(F.col("hub").alias("set"), "chain", "level", "part")).distinct()
    near_hubs = meeting.withColumn("task", F.lit(None).cast("long")).withColumn("l2", none).withColumn("p2", none).withColumn("second", F.lit(False))
    tasks = work_table(small.unionByName(near_hubs), "tasks")
    # One row of each set gives its text, by the row's key. The keys are broadcast only if counted to be few.
    rows = bounded_join(texts, named.select(F.col("held_by").alias("key"), "set"), ["key"], rows=total)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            expected = b.column(2).to_numpy()
            for i, found in _sets(b.column(1), words):
                if _digest(found) == expected[i]:
                    yield {"set": [expected[i]], "grams": [signed(found)]}

    held = work_table(map_rows(rows.select("key", "text", "set"), hashes, "set long, grams array<long>"), "candidate-sets")
    drop_shuffles(spark)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("chain", sort=False):
            own = own.sort_values("set")
            grams_of = [np.asarray(x).view(np.uint64) for x in own["grams"]]
            names, second = own["set"].to_numpy(), own["second"].to_numpy(dtype=bool)
            if second.any() and not second.all():
                a, b = np.flatnonzero(~second), np.flatnonzero(second)
                ga, gb = [grams_of[i] for i in a], [grams_of[i] for i in b]
                hit = linked(ga, gb, percent)
                # One edge joins groups that are linked within their blocks, whatever other links they have.
                ia, ib = _names(linked(ga, ga, percent)), _names(linked(gb, gb, percent))
                i, j = np.nonzero(hit)
                edges = np.unique(np.stack([ia[i], ib[j]]), axis=1)
                out.append(np.stack([names[a][edges[0]], names[b][edges[1]]]))
            elif not second.any():
                first = _names(linked(grams_of, grams_of, percent))
                rest = np.flatnonzero(first != np.arange(len(first)))
                out.append(np.stack([names[first[rest]], names[rest]]))
        u, v = np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.int64)
        return pd.DataFrame({"u": u, "v": v})

    def found(tasks: DataFrame) -> DataFrame:
        work = bounded_join(held, tasks, ["set"], rows=4 * tasks.count()).withColumn("chunk", F.when(F.col("task").isNull(), F.col("chain")))  # of four times the numbers
        return work.groupBy("task", "chunk", "level", "part", "l2", "p2").applyInPandas(compare, "u long, v long")

    first = work_table(found(tasks), "links")
    drop_shuffles(spark)
    if large.isEmpty():
        links = components(first)
    else:
        # What hangs together needs no more comparing: only blocks of different groups meet, so that work is left where
        # a chain holds several groups, or sets that no hub reaches. Groups under BLOCK sets share blocks and meet all.
        known = work_table(components(first), "groups")
        sorted_ = large.join(known.select(F.col("node").alias("set"), "comp"), "set", "left")
        sizes_of = sorted_.groupBy("chain", "comp").agg(F.count(F.lit(1)).alias("k"))
        own = F.when(F.col("k") > BLOCK, F.col("comp")).otherwise(POOL)
        sorted_ = sorted_.join(sizes_of, ["chain", "comp"], "left").withColumn("own", own).select("set", "chain", "level", "own")
        parts = sorted_.groupBy("chain", "level", "own").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
        # Blocks of a chain and level are numbered over their groups.
        offset = F.sum("parts").over(Window.partitionBy("chain", "level").orderBy("own").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.withColumn("before", F.coalesce(offset, F.lit(0)))
        cross = sorted_.join(parts, ["chain", "level", "own"]).withColumn("part", (F.col("before") + F.pmod(F.xxhash64("set"), F.col("parts"))).cast("int"))
        cross = work_table(cross.select("set", "chain", "level", "own", "part"), "cross")
        others = work_table(cross.select("chain", F.col("level").alias("l2"), F.col("own").alias("own2"), F.col("part").alias("p2")).distinct(), "blocks")
        reach = bounded_join(cross, others, ["chain"]).filter((F.abs(F.col("level") - F.col("l2")) <= 1) & ((F.col("own") != F.col("own2")) | (F.col("own") == POOL)))
        low = F.struct("level", "part") <= F.struct("l2", "p2")
        pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
        pairs = work_table(reach.select("set", "chain", pick("level", "l2").alias("level"), pick("part", "p2").alias("part"), F.lit(None).cast("long").alias("task"), pick("l2", "level").alias("l2"), pick("p2", "part").alias("p2"), (~low).alias("second")), "pairs")
        links = components(first.unionByName(found(pairs)))
    discard(held)
    drop_shuffles(spark)

    grouped = sets.join(links.withColumnRenamed("node", "set"), "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    smallest = grouped.groupBy("comp").agg(F.min("first").alias("component_id"))
    grouped = grouped.join(smallest, "comp")
    # A set of many rows is spread over SALTS tasks.
    own_salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    spread = grouped.select("set", "component_id", F.explode(F.when(F.col("rows") > 1, F.array(*[F.lit(i) for i in range(SALTS)])).otherwise(F.array(F.coalesce(own_salt("first"), own_salt(F.lit(None).cast("long")))))).alias("salt"))
    docs = profiles.filter("not gram").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set")).alias("set"), own_salt("doc_id").alias("salt"))
    alone = docs.filter("set is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return docs.filter("set is not null").join(spread, ["set", "salt"]).select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_one(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """documents with one row of each component: that of the smallest doc_id (nulls last), then of the smallest row key."""
    key = unused(documents, "row_key")
    rows = keyed(documents, "rows", key)
    members = work_table(_join_rows(rows.select(F.col(key).alias("key"), F.col(key).alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias(key), "component_id"), "members")
    many = work_table(members.groupBy("component_id").count().filter("count > 1").select("component_id"), "many")
    shared = work_table(bounded_join(members, many, ["component_id"]).join(rows.select(key, "doc_id"), key), "shared")
    kept = shared.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key))[key].alias("kept"))
    gone = work_table(bounded_join(shared, work_table(kept, "kept"), ["component_id"]).filter(F.col(key) != F.col("kept")).select(key), "not-kept")
    return bounded_join(rows, gone, [key], "left_anti").select(*documents.columns)
