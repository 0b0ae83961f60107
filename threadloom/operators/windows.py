"""Windows of messages for an external reader, and the intake of what it returns.

Messages of each thread are tiled by whole turns, so that windows are bounded; each carries a few messages of the one
before as context. A window is known by the hash of its transcript, so that windows read once aren't read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ordered import substantive
from threadloom.operators.segments import Segmented, _small, scan, segmented, with_turns
from threadloom.sources.work import kept

MESSAGES, TOKENS, OVERLAP_TURNS, PREFIX = 55, 7000, 3, 12
#: Turns of a thread that one task tiles.
CHUNK = 1 << 14
SCORES = "array<struct<message_id: string, valence: double, warmth: double, tension: double>>"


def tokens(body: Column) -> Column:
    """An estimate: four characters each, and 24 for a line's head."""
    return F.ceil((F.length(body) + 24) / 4)


def _ends(n: np.ndarray, cost: np.ndarray, most: int, budget: int) -> np.ndarray:
    """For each turn as a window's first: the place of the next window's first turn; len + 1 where the window is still open at the end."""
    count, size = (np.concatenate([[0], np.cumsum(x)]) for x in (n, cost))
    return np.minimum(np.searchsorted(count, count[:-1] + most), np.searchsorted(size, size[:-1] + budget))


def window_turns(turns: DataFrame, most: int, budget: int, chunk: int = CHUNK) -> DataFrame:
    """(thread_id, turn, window) of turns (thread_id, turn from 1 without gaps, n, cost).

    Turns are cut into chunks of `chunk`. A window that is open where a chunk begins has begun within the `most` turns
    before, so a chunk tells for each of these beginnings which one is open at its end, and how many windows ended. Only
    these small tables are followed along a thread; then each chunk, told how it begins, numbers its turns' windows.
    """
    chunk = max(chunk, most)
    place = turns.withColumn("chunk", F.floor((F.col("turn") - 1) / chunk)).withColumn("tail", F.lit(False))
    last = place.filter(F.pmod(F.col("turn") - 1, F.lit(chunk)) >= chunk - most).withColumn("chunk", F.col("chunk") + 1).withColumn("tail", F.lit(True))
    chunks = kept(place.unionByName(last))

    def pass_through(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        tail, m = int(pdf["tail"].sum()), len(pdf)
        if tail == m:  # the thread ends before this chunk
            return pd.DataFrame({"thread_id": [], "chunk": [], "open": [], "ended": []}, dtype=object)
        ends = _ends(pdf["n"].to_numpy(), pdf["cost"].to_numpy(), most, budget)
        out, closed = np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
        for i in range(m - 1, -1, -1):
            if ends[i] > m:
                out[i] = m - i
            else:
                out[i], closed[i] = out[ends[i]], closed[ends[i]] + 1
        entries = tail - np.arange(min(tail, most - 1) + 1)
        return pd.DataFrame({"thread_id": pdf["thread_id"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "open": [out[entries].tolist()], "ended": [closed[entries].tolist()]})

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, entry, window, got = pdf.sort_values("chunk"), 0, 0, []
        for began, ended in zip(pdf["open"], pdf["ended"]):
            got.append((entry, window))
            window, entry = window + int(ended[entry]), int(began[entry])
        return pd.DataFrame({"thread_id": pdf["thread_id"], "chunk": pdf["chunk"], "entry": [g[0] for g in got], "first_window": [g[1] for g in got]})

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        tail, m = int(pdf["tail"].sum()), len(pdf)
        ends = _ends(pdf["n"].to_numpy(), pdf["cost"].to_numpy(), most, budget)
        window, at, nth = np.zeros(m, dtype=np.int64), tail - int(pdf["entry"].iloc[0]), int(pdf["first_window"].iloc[0])
        while at < m:
            window[at : ends[at]] = nth
            at, nth = int(ends[at]), nth + 1
        return pd.DataFrame({"thread_id": pdf["thread_id"].iloc[tail:], "turn": pdf["turn"].iloc[tail:], "window": window[tail:]})

    told = chunks.groupBy("thread_id", "chunk").applyInPandas(pass_through, "thread_id long, chunk long, open array<long>, ended array<long>")
    begun = told.groupBy("thread_id").applyInPandas(along, "thread_id long, chunk long, entry long, first_window long")
    return chunks.join(begun, ["thread_id", "chunk"]).groupBy("thread_id", "chunk").applyInPandas(number, "thread_id long, turn long, window long")


def _streamed(rows: DataFrame, most: int, budget: int, overlap: int, prefix: int) -> DataFrame:
    """Tiles of threads that one task may order: each task follows its sorted threads, many in a batch, and holds back one at most."""
    shape = pa.schema([("thread_id", pa.int64()), ("window", pa.int64()), ("id", pa.int64()), ("ms", pa.int64()), ("prefix", pa.bool_())])

    def tiled(t: pa.Table) -> pa.Table:
        thread, me, cost = (t[c].to_numpy() for c in ("thread_id", "me", "cost"))
        row, new = np.arange(len(thread)), np.concatenate([[True], thread[1:] != thread[:-1]])
        begins = new.copy()
        begins[1:] |= (me[1:] != me[:-1]) | (me[1:] < 0) | (me[:-1] < 0)
        turn, first = np.cumsum(begins) - 1, np.flatnonzero(begins)  # first: a turn's first row
        bounds = np.append(turn[new], len(first))  # a thread's first turn
        ends = _ends(np.diff(np.append(first, len(thread))), np.add.reduceat(cost, first), most, budget)
        ends = np.minimum(ends, np.repeat(bounds[1:], np.diff(bounds))).tolist()
        starts, at = [], 0
        while at < len(ends):
            starts.append(at)
            at = ends[at]
        begun = np.zeros(len(first), dtype=np.int64)
        begun[starts] = 1
        nth = (np.cumsum(begun) - 1)[turn]  # windows of all threads counted through
        window = nth - nth[np.flatnonzero(new)][np.cumsum(new) - 1]
        last_turn = np.append(starts[1:], len(first)) - 1
        last_row = np.append(first[starts[1:]], len(thread)) - 1
        followed = np.append(thread[last_row[:-1]] == thread[last_row[:-1] + 1], False)
        context = np.flatnonzero(followed[nth] & (last_turn[nth] - turn < overlap) & (last_row[nth] - row < prefix))
        out = lambda at, windows, own: pa.Table.from_arrays([at["thread_id"], pa.array(windows), at["id"], at["ms"], pa.repeat(own, len(at))], schema=shape)
        return pa.concat_tables([out(t, window, False), out(t.take(context), window[context] + 1, True)])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            thread = b.column(0).to_numpy()
            if not len(thread):
                continue
            cut = int(np.searchsorted(thread, thread[-1]))  # where the batch's last thread begins
            if held and (cut or held[0].column(0)[0].as_py() != thread[0]):
                yield from tiled(pa.Table.from_batches([*held, b.slice(0, cut)])).to_batches()
                held = []
            elif cut:
                yield from tiled(pa.Table.from_batches([b.slice(0, cut)])).to_batches()
            held.append(b.slice(cut))
        if held:
            yield from tiled(pa.Table.from_batches(held)).to_batches()

    side = F.coalesce(F.col("me").cast("int"), F.lit(-1)).alias("me")
    own = rows.filter("thread_id is not null").select("thread_id", "ms", "id", side, tokens(F.col("body")).alias("cost"))
    return own.repartition("thread_id").sortWithinPartitions("thread_id", "ms", "id").mapInArrow(follow, "thread_id long, window long, id long, ms long, prefix boolean")


def _chunked(s: Segmented, most: int, budget: int, overlap: int, prefix: int, chunk: int) -> DataFrame:
    """Tiles of threads of any size: turns are numbered by segmented scans, and windows by `window_turns`."""
    numbered = scan(with_turns(s), total={"rn": F.lit(1)}).plain()
    rows = kept(numbered.select("thread_id", "ms", "id", "turn", "rn", tokens(F.col("body")).alias("cost")))
    turns = rows.groupBy("thread_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
    placed = rows.join(window_turns(turns, most, budget, chunk), ["thread_id", "turn"])
    ends = placed.groupBy("thread_id", "window").agg(F.max("turn").alias("last_turn"), F.max("rn").alias("last_rn"))
    followed = ends.join(ends.select("thread_id", (F.col("window") - 1).alias("window")), ["thread_id", "window"], "left_semi")
    context = placed.join(followed, ["thread_id", "window"]).filter((F.col("last_turn") - F.col("turn") < overlap) & (F.col("last_rn") - F.col("rn") < prefix))
    out = lambda df, shift, own: df.select("thread_id", (F.col("window") + shift).alias("window"), "id", "ms", F.lit(own).alias("prefix"))
    return out(placed, 0, False).unionByName(out(context, 1, True))


def tile(messages: DataFrame, most: int = MESSAGES, budget: int = TOKENS, overlap: int = OVERLAP_TURNS, prefix: int = PREFIX, chunk: int | None = None) -> DataFrame:
    """(thread_id, window, id, ms, prefix): substantive messages by window; a window ends with the turn that reaches `most` messages or `budget` tokens.

    prefix rows are the last messages (at most `prefix`, of the last `overlap` turns) of the window before. Threads of
    over `segments.MOST` messages (or over `chunk`, where that is given) are tiled by chunks of turns, so that no task
    sees one whole; the others are followed one after another by the task that sorts them.
    """
    s = segmented(substantive(messages))
    hot = s.hot
    if chunk is not None:
        hot = kept(s.rows.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk).select("thread_id"))
    if hot is None:
        return _streamed(s.rows, most, budget, overlap, prefix)
    long = Segmented(s.rows.join(_small(hot), "thread_id", "left_semi"), s.hot)
    return _streamed(s.rows.join(_small(hot), "thread_id", "left_anti"), most, budget, overlap, prefix).unionByName(_chunked(long, most, budget, overlap, prefix, chunk or CHUNK))


def transcript_line() -> Column:
    """[m<id>] <minute> <ME|THEM>: <body on one line>."""
    minute = F.date_format(F.timestamp_seconds(F.floor(F.col("ms") / 60_000) * 60), "yyyy-MM-dd HH:mm")
    return F.concat(F.lit("[m"), F.col("id").cast("string"), F.lit("] "), minute, F.when(F.col("me"), " ME: ").otherwise(" THEM: "), F.trim(F.regexp_replace("body", r"\s*\n\s*", " ")))


def jobs(messages: DataFrame, tiles: DataFrame, lens: str) -> DataFrame:
    """(thread_id, window, input_hash, member_ids, prefix_ids, transcript): a job for each window; equal transcripts for one lens have one hash."""
    lines = tiles.join(substantive(messages).select("thread_id", "id", transcript_line().alias("line")), ["thread_id", "id"])
    ordered = F.array_sort(F.collect_list(F.struct((~F.col("prefix")).alias("own"), "ms", "id", "line")))
    grouped = lines.groupBy("thread_id", "window").agg(ordered.alias("m"))
    text = F.array_join(F.transform("m", lambda x: x["line"]), "\n")
    return grouped.select("thread_id", "window", F.sha2(F.to_json(F.struct(F.lit(lens).alias("lens"), text.alias("transcript"))), 256).alias("input_hash"),
                          F.transform("m", lambda x: x["id"]).alias("member_ids"), F.transform(F.filter("m", lambda x: ~x["own"]), lambda x: x["id"]).alias("prefix_ids"), text.alias("transcript"))


def unread_jobs(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs whose input no result stands for yet."""
    return planned.join(done.select("input_hash").distinct(), "input_hash", "left_anti")


def windows_in_range(planned: DataFrame, messages: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Jobs that own (not as context) a message of the range."""
    own = planned.select("thread_id", "window", F.explode(F.array_except("member_ids", "prefix_ids")).alias("id"))
    inside = messages.filter((F.col("ms") >= from_ms) & (F.col("ms") <= to_ms)).select("thread_id", "id")
    return planned.join(own.join(inside, ["thread_id", "id"], "left_semi").select("thread_id", "window").distinct(), ["thread_id", "window"], "left_semi")


def intake(results: DataFrame, planned: DataFrame) -> DataFrame:
    """results with status and reason: done, refused or error.

    Rules, the first that fails naming the reason: the envelope has an input_hash of a planned job and a known status;
    the reader didn't refuse; every score lies in its range (valence -1 to 1, warmth and tension whole numbers 0 to 3);
    no message is scored twice, none of the window's own is missing, none is foreign.
    """
    known = planned.select("input_hash", F.transform("member_ids", lambda i: F.concat(F.lit("m"), i.cast("string"))).alias("_members"), F.transform("prefix_ids", lambda i: F.concat(F.lit("m"), i.cast("string"))).alias("_prefix"))
    r = results.join(known.dropDuplicates(["input_hash"]), "input_hash", "left").withColumn("_ids", F.transform(F.coalesce("messages", F.array().cast(SCORES)), lambda m: m["message_id"]))
    whole = lambda x: (x >= 0) & (x <= 3) & (x == F.floor(x))
    good = F.forall("messages", lambda m: F.coalesce(m["message_id"].rlike("^m[0-9]+$") & (F.abs(m["valence"]) <= 1) & whole(m["warmth"]) & whole(m["tension"]), F.lit(False)))
    reason = (
        F.when(F.col("_members").isNull(), "unknown job").when(~F.coalesce(F.col("status").isin("done", "refused", "error"), F.lit(False)), "envelope")
        .when(F.col("status") == "refused", "refused").when(F.col("status") == "error", "failed").when(F.col("messages").isNull() | ~good, "schema")
        .when(F.size("_ids") != F.size(F.array_distinct("_ids")), "duplicate").when(F.size(F.array_except(F.array_except("_members", "_prefix"), "_ids")) > 0, "missing")
        .when(F.size(F.array_except("_ids", "_members")) > 0, "extra")
    )
    r = r.withColumn("reason", reason)
    return r.withColumn("status", F.when(F.col("reason").isNull(), "done").when(F.col("reason") == "refused", "refused").otherwise("error")).drop("_members", "_prefix", "_ids")


def accepted(taken: DataFrame) -> DataFrame:
    """What later readers see: results that passed, the latest of each input (by read_at)."""
    good = taken.filter("status = 'done'")
    last = good.groupBy("input_hash").agg(F.max("read_at").alias("read_at"))
    return good.join(last, ["input_hash", "read_at"], "left_semi").dropDuplicates(["input_hash"])


def status_counts(taken: DataFrame, planned: DataFrame, per_drain: int = 20) -> DataFrame:
    """(thread_id, done, refused, error, pending, drains): how far each thread's jobs are; drains are calls of per_drain jobs that remain."""
    state = planned.select("thread_id", "input_hash").join(taken.groupBy("input_hash").agg(F.min(F.struct(F.when(F.col("status") == "done", 0).otherwise(1).alias("o"), "status"))["status"].alias("status")), "input_hash", "left")
    out = state.groupBy("thread_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("done", "refused", "error")], F.count_if(F.col("status").isNull()).alias("pending"))
    return out.withColumn("drains", F.ceil(F.col("pending") / per_drain))
