"""Repeated passages by their stretches of LEAST words, each known by a hash.

A stretch is looked at only if it may repeat: of every word sequence the GRAM words that hash lowest in some window of
WINDOW places (minimisers) are counted in the corpus, and a stretch can repeat only if the minimisers of all its windows
do. Equal stretches have equal minimisers, so none that repeats is passed over. Spark range-partitions and sorts the
hashes of the others, whatever their number, and each stretch meets the smallest document and place that hold it.

All holders of a stretch but the smallest may lose it; its words are then still held by a smaller document or an earlier
place. Where copies overlap within a text (a line again and again), of each the last word goes alone, so that every
stretch of the passage stays once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import BROADCAST_ROWS, bounded_join, discard, drop_shuffles, keyed, map_rows, unused, work_table
from threadloom.llm.words import WHITE, Run, grams, mix, runs

LEAST = 50
GRAM, WINDOW = 8, 20
SALTS = 16
#: A gram is hot if it holds more than one in so many places.
HOT = 20_000


def _slide(v: np.ndarray, best: np.ufunc, window: int) -> np.ndarray:
    """The best of each window of so many values."""
    size = 1
    while 2 * size <= window:
        v, size = best(v[:-size], v[size:]), 2 * size
    return best(v[: len(v) - (window - size)], v[window - size :]) if size < window else v


def minimisers(x: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places whose value is the least of some window of so many; of stretches of one value the ends and every 8th place."""
    if len(x) < window:
        return np.zeros(0, dtype=np.int64)
    edge = np.zeros(window - 1, dtype=np.uint64)
    chosen = _slide(np.concatenate([edge, _slide(x, np.minimum, window), edge]), np.maximum, window) == x
    same = np.concatenate([[False], x[1:] == x[:-1]])
    inner = same & np.append(same[1:], False) & (np.arange(len(x)) % 8 != 0)
    return np.flatnonzero(chosen & ~inner)


def stretches(w: np.ndarray, repeated: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the stretches of `least` words whose windows' minimisers are all in repeated (sorted)."""
    x = grams(w, GRAM)
    low = _slide(x, np.minimum, WINDOW)
    at = np.minimum(np.searchsorted(repeated, low), len(repeated) - 1)
    once = np.concatenate([[0], np.cumsum(repeated[at] != low)])
    windows = least - GRAM - WINDOW + 2
    at = np.flatnonzero(once[windows:] == once[:-windows])
    key = np.zeros(len(at), dtype=np.uint64)
    for i in (*range(0, least - GRAM, GRAM), least - GRAM):
        key = mix(key ^ x[at + i])
    return at, key.view(np.int64)


def body_of(run: Run, i: int, first: int = 0) -> int:
    """A number for a text's whole word sequence; another `first` gives an independent one."""
    w = run.words[run.at[i] : run.at[i + 1]]
    with np.errstate(over="ignore"):
        total = (w * mix(np.arange(first, first + len(w), dtype=np.uint64))).sum(dtype=np.uint64) + np.uint64(len(w))
    return int(mix(np.array([total])).view(np.int64)[0])


#: Where the places of a text's second number begin.
TWIN = 1 << 60


def spans(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, body, start_word, end_word, source_doc_id, removable): repeated passages of at least `least` words.

    Words are runs of bytes without ASCII white space, A-Z lower-cased; ends are excluded. source_doc_id is a
    smaller document that holds the words, or the document itself. removable spans of a document are disjoint; those not removable are where the passage
    stays. Texts of equal words beyond the first are wholly removable. Texts shorter than `least` and null texts have
    no spans; rows with a null doc_id take no part; rows that repeat a doc_id and its text stand for each other. body
    names the word sequence that a span belongs to, should rows of different texts share a doc_id.
    """
    key = unused(documents, "row_key")
    return _spans(keyed(documents, "dedup-rows", key).select(F.col(key).alias("key"), "doc_id", "text"), least)[0]


def _spans(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(spans of rows (key, doc_id, text) whose keys are their own; (key, doc_id, body) of the rows that are long enough)."""
    texts = documents.filter("doc_id is not null")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()
        for b in batches:
            keys, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            for run in runs(b.column(2), WHITE):
                bodies = [body_of(run, i) for i in range(run.last - run.first)]
                sizes = np.diff(run.at)
                long = np.flatnonzero(sizes >= least)
                twins = np.array([body_of(run, i, TWIN) for i in long], dtype=np.int64)
                yield {"key": keys[run.first : run.last][long], "doc_id": ids[run.first : run.last][long], "body": np.array(bodies, dtype=np.int64)[long], "n": sizes[long], "gram": [None] * len(long), "twin": twins}
                places, grams_, owners = [], [], []
                for i in long:
                    if bodies[i] in seen:
                        continue
                    seen.add(bodies[i])
                    x = grams(run.words[run.at[i] : run.at[i + 1]], GRAM)
                    at = minimisers(x)
                    places.append(at)
                    grams_.append(x[at])
                    owners.append(np.full(len(at), bodies[i]))
                if places:
                    n = np.concatenate(places)
                    yield {"key": [None] * len(n), "doc_id": [None] * len(n), "body": np.concatenate(owners), "n": n, "gram": np.concatenate(grams_).view(np.int64), "twin": [None] * len(n)}

    chosen = work_table(map_rows(texts, select, "key long, doc_id long, body long, n long, gram long, twin long"), "minimisers")
    every = chosen.filter("gram is null")
    rows = every.select("doc_id", "body", "n", "twin")
    # One row of each text stands for all, that of the smallest doc_id; it is met by its key, whatever rows share its doc_id.
    bodies = work_table(every.groupBy("body").agg(F.min(F.struct("doc_id", "key"))["key"].alias("key")), "bodies")
    places = chosen.filter("gram is not null").select("body", F.col("n").alias("pos"), "gram")
    repeated = places.groupBy("gram").agg(*[f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("body", "pos")], F.count(F.lit(1)).alias("n")).filter("minbody <> maxbody or minpos <> maxpos")
    repeated = work_table(repeated.select("gram", "n"), "repeated")
    drop_shuffles(documents.sparkSession)
    # Grams of more than one place in HOT are at most HOT: they are broadcast, so that none gathers in one task.
    hot = F.broadcast(repeated.filter(F.col("n") * HOT > places.count()).select("gram"))
    kept = places.join(hot, "gram", "left_semi").unionByName(places.join(hot, "gram", "left_anti").join(repeated.select("gram"), "gram", "left_semi"))
    wanted = work_table(kept.groupBy("body").agg(F.collect_set("gram").alias("grams")).join(bodies, "body").select("key", "body", "grams"), "wanted")
    drop_shuffles(documents.sparkSession)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        done: set[int] = set()
        for b in batches:
            ids, body, repeats = b.column(0), b.column(2).to_numpy(), b.column(3)
            for run in runs(b.column(1), WHITE):
                for i in range(run.last - run.first):
                    own = body_of(run, i)
                    if own != body[run.first + i] or own in done:
                        continue
                    done.add(own)
                    at, key = stretches(run.words[run.at[i] : run.at[i + 1]], np.sort(repeats[run.first + i].values.to_numpy().view(np.uint64)), least)
                    if len(at):
                        yield {"key": key, "first": np.full(len(at), ids[run.first + i].as_py()), "body": np.full(len(at), own), "pos": at}

    # Texts without repeated grams stay where they are, unless the others are too many to be broadcast by key.
    some = bounded_join(texts, wanted.select("key"), ["key"], "left_semi")
    joined = some.join(wanted, "key").select("doc_id", "text", "body", "grams")
    # Range partitions of the sort are found by a sample of this table, so it is written first. Repeated rows of one text fall together.
    table = work_table(map_rows(joined, hashes, "key long, first long, body long, pos long"), "stretches")
    discard(wanted)
    drop_shuffles(documents.sparkSession)
    order = ["key", "first", "body", "pos"]
    found = work_table(map_rows(table.repartitionByRange(*order).sortWithinPartitions(*order), lambda batches: _holders(batches, least), HOLDERS), "holders")

    discard(table)
    drop_shuffles(documents.sparkSession)
    # A stretch's holders may cross partitions: of each only its first and its last row reach the driver.
    carried, extra = _across(found.filter("edge is not null").collect(), least)
    spark = documents.sparkSession
    carry = spark.createDataFrame(carried, "lead int, carried_source long, carried_body long")  # one row a partition at most
    inner = found.filter("edge is null").join(F.broadcast(carry), "lead", "left")
    inner = inner.withColumn("source", F.coalesce("carried_source", "source")).withColumn("source_body", F.coalesce("carried_body", "source_body"))
    columns = ["body", "first", "pos", "source", "source_body", "near", "removable"]
    held = inner.select(*columns).unionByName(spark.createDataFrame(extra, "body long, first long, pos long, source long, source_body long, near boolean, removable boolean"))
    last_alone = F.col("removable") & F.col("near") & (F.col("source_body") == F.col("body"))
    placed = held.select("body", F.col("first").alias("doc_id"), (F.col("pos") + F.when(last_alone, least - 1).otherwise(0)).alias("start"), (F.col("pos") + least).alias("stop"), F.col("source").alias("source_doc_id"), "removable")
    # Overlapping spans of a text become one.
    by = Window.partitionBy("body", "doc_id", "removable").orderBy("start", "stop")
    fresh = placed.withColumn("new", F.coalesce(F.col("start") > F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    merged = fresh.withColumn("nth", F.sum("new").over(by)).groupBy("body", "doc_id", "removable", "nth").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("source_doc_id").alias("source_doc_id"))
    out = ["doc_id", "body", "start_word", "end_word", "source_doc_id", "removable"]
    # Texts that occur in several documents are wholly repeated: two numbers and the length decide, as the whole text goes.
    same = ["body", "twin", "n"]
    many = rows.groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    copies = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).distinct().join(many.select(*same, "first", "salt"), [*same, "salt"])
    whole = copies.select("doc_id", "body", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), F.col("first").alias("source_doc_id"), (F.col("doc_id") != F.col("first")).alias("removable"))
    return merged.select(*out).unionByName(whole.select(*out)), every.select("key", "doc_id", "body")


HOLDERS = "key long, body long, first long, pos long, source long, source_body long, near boolean, removable boolean, lead int, edge int, part int"


def _holders(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[dict]:
    """The rows of one partition, in order, whose stretch others hold too, with its smallest holder there (not removable itself).

    near says that the row before is of the same text and overlaps. Rows that hold the partition's first stretch name the
    partition in lead, as their smallest holder may lie before it; the first row itself is left to _across, and the first
    and last rows are given as edges (0 and 1, removable if the last isn't its stretch's first, the first if others follow).
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    lead = held = None  # held: the last row, the smallest holder of its stretch, and whether it is that itself
    for b in batches:
        if not b.num_rows:
            continue
        key, first, body, pos = (b.column(i).to_numpy() for i in range(4))
        old = held is not None
        if old:
            key, first, body, pos = (np.concatenate([[h], v]) for h, v in zip(held[0], (key, first, body, pos)))
        else:
            lead = [int(v[0]) for v in (key, first, body, pos)]
            follows = False
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (first[1:] != first[:-1]) | (body[1:] != body[:-1]) | (pos[1:] != pos[:-1])])
        key, first, body, pos = (v[fresh] for v in (key, first, body, pos))
        n = len(key)
        same = np.concatenate([[False], key[1:] == key[:-1]])
        start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        source, source_body = first[start], body[start]
        smallest = ~same
        if old:
            source[start == 0], source_body[start == 0], smallest[0] = held[1], held[2], held[3]
        near = same & np.concatenate([[False], (body[1:] == body[:-1]) & (pos[1:] - pos[:-1] < least)])
        shared = smallest & np.append(same[1:], False)
        if not old or (held[3] and held[0] == lead):  # the partition's first row
            follows, shared[0] = bool(shared[0]), False
        hit = np.flatnonzero(same | shared)
        none = [None] * len(hit)
        if len(hit):
            yield {"key": none, "body": body[hit], "first": first[hit], "pos": pos[hit], "source": source[hit], "source_body": source_body[hit], "near": near[hit], "removable": same[hit],
                   "lead": [part if k == lead[0] else None for k in key[hit].tolist()], "edge": none, "part": none}
        held = [int(v[-1]) for v in (key, first, body, pos)], int(source[-1]), int(source_body[-1]), bool(smallest[-1])
    if held is not None:
        rows = [(0, lead, lead[1], lead[2], follows), (1, held[0], held[1], held[2], not held[3])]
        yield {"key": [r[1][0] for r in rows], "body": [r[1][2] for r in rows], "first": [r[1][1] for r in rows], "pos": [r[1][3] for r in rows], "source": [r[2] for r in rows], "source_body": [r[3] for r in rows],
               "near": [None] * 2, "removable": [r[4] for r in rows], "lead": [None] * 2, "edge": [r[0] for r in rows], "part": [part] * 2}


def _across(edges: list, least: int) -> tuple[list[tuple], list[tuple]]:
    """(partition, smallest holder) of first stretches that go on from partitions before; and the rows that _holders leaves out."""
    carried, out = [], []
    sides = {(e["part"], e["edge"]): e for e in edges}
    key = source = source_body = before = None
    alone = False
    for p in sorted({p for p, _ in sides}):
        lead, last = sides[p, 0], sides[p, 1]
        goes_on = lead["key"] == key
        if goes_on:
            carried.append((p, source, source_body))
            near = before["body"] == lead["body"] and lead["pos"] - before["pos"] < least
            out.append((lead["body"], lead["first"], lead["pos"], source, source_body, near, True))
            if alone:
                out.append((before["body"], before["first"], before["pos"], before["first"], before["body"], False, False))
        elif lead["removable"]:
            out.append((lead["body"], lead["first"], lead["pos"], lead["first"], lead["body"], False, False))
        if goes_on and last["key"] == key:
            alone = False
        else:
            source, source_body, alone = last["source"], last["source_body"], not last["removable"]
        key, before = last["key"], last
    return carried, out


def cut_repeats(documents: DataFrame, least: int = LEAST, key: str | None = None) -> DataFrame:
    """documents with the removable spans of `spans` cut out of their texts; n_chars, where there is one, is made anew for all rows.

    A text that loses every word goes with its row; the texts of rows without removable spans stay as they are. `key`
    names a column that is each row's own, where there is one; it stays.
    """
    own_key = key or unused(documents, "row_key")
    keyed_rows = documents if key else keyed(documents, "cut-rows", own_key)
    found, rows_of = _spans(keyed_rows.select(F.col(own_key).alias("key"), "doc_id", "text"), least)
    gone = found.filter("removable").groupBy("doc_id", "body").agg(F.collect_list(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias("cut"))
    gone = work_table(rows_of.join(gone, ["doc_id", "body"]).select(F.col("key").alias("_cut_key"), "cut"), "cuts")
    drop_shuffles(documents.sparkSession)
    few = (gone.agg(F.sum(F.size("cut"))).first()[0] or 0) <= BROADCAST_ROWS
    names = [f"_{i}" for i in range(len(keyed_rows.columns))]
    text, at = (names[keyed_rows.columns.index(c)] for c in ("text", own_key))
    renamed = keyed_rows.toDF(*names)
    joined = renamed.join(F.broadcast(gone) if few else gone, renamed[at] == gone["_cut_key"], "left").select(*names, "cut")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            cuts = b.column(b.schema.get_field_index("cut")).to_pylist()
            out, keep = texts.to_pylist(), np.ones(b.num_rows, dtype=bool)
            for n in (i for i, c in enumerate(cuts) if c):
                run = next(runs(texts.slice(n, 1), WHITE))
                kept = np.ones(len(run.raw), dtype=bool)
                word = np.ones(len(run.words), dtype=bool)
                for p in cuts[n]:
                    kept[run.starts[p["s"]] : run.starts[p["e"]] if p["e"] < len(run.starts) else len(run.raw)] = False
                    word[p["s"] : p["e"]] = False
                out[n] = run.raw[kept].tobytes().decode()
                keep[n] = word.any()
            columns = [pa.array(out, pa.string()) if name == text else b.column(i) for i, name in enumerate(b.schema.names[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, keyed_rows.schema))
    out = joined.mapInArrow(rows, ddl).toDF(*keyed_rows.columns)
    out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
    return out.select(*documents.columns)
