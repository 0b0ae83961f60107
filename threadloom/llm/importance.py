"""Importance resampling towards a target: documents drawn by how much likelier their word runs are in the target's texts.

Texts are cut at word boundaries into chunks of bounded length. A chunk owns the runs that start in it and carries the
next n-1 words to finish them, so that a very long text is many rows like any other. Chunks hold their runs' hash
buckets and are written once; counts over all chunks give each bucket's gain, and gains and counts of chunks are summed
by document. The draw adds noise of an extreme-value law to the mean gains and keeps the highest scores by a range sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import keyed, map_rows, unused, work_table
from threadloom.llm.ranks import placed
from threadloom.llm.sql import crc32_sql
from threadloom.llm.words import LOWER, NON_WORD, column_bytes

#: Words that a chunk owns at most.
CHUNK = 1 << 13
#: Short texts are worked on together, in runs of about so many bytes.
RUN = 1 << 18
#: Bytes of a word that are hashed for all words at once; longer words are hashed one by one.
SHORT = 48


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


CRC = _crc_table()


def _crc_words(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, carried on from the CRC-32 of what stands before it."""
    lengths, out = ends - starts, state ^ np.uint32(0xFFFFFFFF)
    short = np.flatnonzero(lengths <= SHORT)
    order = short[np.argsort(-lengths[short], kind="stable")]
    sizes, now = -lengths[order], out[order]
    for i in range(int(-sizes[0]) if len(order) else 0):
        n = int(np.searchsorted(sizes, -i, side="left"))  # words longer than i bytes
        now[:n] = CRC[(now[:n] ^ data[starts[order[:n]] + i]) & np.uint32(255)] ^ (now[:n] >> np.uint32(8))
    out[order] = now
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > SHORT):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]))
    return out


def run_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stop: np.ndarray, own: int, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, buckets) of all runs of 1 to n words that start at the first `own` words; `stop` is the place past each word's text.

    The words may go on behind those owned, as far as n-1 words.
    """
    state, space = np.zeros(own, dtype=np.uint32), np.array([32], dtype=np.uint8)
    at, places, found = np.arange(own), [], []
    for k in range(n):
        going = np.flatnonzero(at + k < stop[:own])
        last = going + k
        before = state[going]
        if k:
            before = _crc_words(before, space, np.zeros(len(going), dtype=np.int64), np.ones(len(going), dtype=np.int64))
        state = state.copy()
        state[going] = _crc_words(before, data, starts[last], ends[last])
        places.append(going)
        found.append(state[going] % np.uint32(buckets))
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return place[order], np.concatenate(found)[order].astype(np.int32)


def chunks(column: pa.Array, n: int, buckets: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(rows, words, buckets of their runs) of chunks: a text has one for each `chunk` words begun, one without words if it has none."""
    whole, offsets = column_bytes(column)
    first, total = 0, len(column)
    while first < total:
        last = min(total, max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN, side="right")) - 1))
        data = LOWER[whole[offsets[first] : offsets[last]]]
        texts = offsets[first : last + 1] - offsets[first]
        inside = ~NON_WORD[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[texts] = True
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        stop[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        at = np.searchsorted(starts, texts)
        # Chunks of all these texts: where each begins, and whose it is.
        counts = np.maximum(1, -(-np.diff(at) // chunk))
        row = np.repeat(np.arange(last - first), counts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        low = at[row] + nth * chunk
        high = np.minimum(low + chunk, at[row + 1])
        # Hashed as many chunks at a time as `chunk` words, and never more of one text.
        done = 0
        while done < len(row):
            upto = max(done + 1, int(np.searchsorted(high, low[done] + chunk, side="right")))
            a, b = low[done], high[upto - 1]
            carry = min(b + n - 1, len(starts))
            past = np.repeat(at[1:], np.diff(at))[a:carry] - a
            place, found = run_buckets(data, starts[a:carry], ends[a:carry], past, b - a, n, buckets)
            cuts = np.searchsorted(place, high[done:upto] - a)
            yield row[done:upto] + first, high[done:upto] - low[done:upto], np.split(found, cuts[:-1])
            done = upto
        first = last


def chunk_table(rows: DataFrame, key: str, text: str, n: int, buckets: int, name: str) -> DataFrame:
    """(key, words, runs array<int>): the chunks of every row's whole text, written; a null text has one chunk without words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            keys = b.column(0)
            for row, words, found in chunks(b.column(1), n, buckets):
                sizes = np.cumsum([0, *map(len, found)])
                yield {"key": keys.take(pa.array(row)), "words": words, "runs": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(found), pa.int32()))}

    return work_table(map_rows(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), cut, "key long, words long, runs array<int>"), name)


def bucket_counts(chunked: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how often each of all buckets occurs, summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            seen += np.bincount(b.column(0).flatten().to_numpy(), minlength=buckets)
        yield {"bucket": np.arange(buckets)[seen > 0], "n": seen[seen > 0]}

    found = map_rows(chunked.select("runs"), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    every = chunked.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Thousand times the log of how much likelier each bucket is in the target, smoothed by one each, floored."""
    s, t = (c.select("bucket", F.col("n").cast("double").alias(name)) for c, name in ((source, "s"), (target, "t")))
    both = s.join(t, "bucket").toPandas()  # a row for each bucket
    a, b = both["s"].to_numpy(), both["t"].to_numpy()
    out = np.zeros(buckets, dtype=np.int64)
    out[both["bucket"]] = np.floor(1000 * np.log((b + 1) * (a.sum() + buckets) / ((a + 1) * (b.sum() + buckets)))).astype(np.int64)
    return out


def resample(documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_features, weight, score, rank) for every row: features are all runs of 1 to n words, weight the floored mean of their gains.

    Of the rows with at least `least_words` words, `percent` in a hundred (floored) are drawn: the highest scores, ties
    to smaller keys, nulls last; rank is their place from 1, null for the rest. score is weight plus the noise of
    sha256(`seed:key`), a null key written as nothing. Rows whose keys repeat are documents of their own. A null or
    empty text has no features and weight 0; an empty target leaves all to smoothing; an empty table gives no rows.
    """
    row = unused(documents, "row_key")
    rows = keyed(documents, "resample-rows", row)
    chunked = chunk_table(rows, row, text, n, buckets, "chunks")
    aims = chunk_table(target.select(F.lit(0).cast("long").alias("key"), text), "key", text, n, buckets, "target-chunks")
    gain = documents.sparkSession.sparkContext.broadcast(gains(bucket_counts(chunked, buckets), bucket_counts(aims, buckets), buckets))  # a number for each bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            runs = b.column(2)
            size = runs.value_lengths().to_numpy().astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(gain.value[runs.flatten().to_numpy()])])
            ends = np.cumsum(size)
            yield {"key": b.column(0), "words": b.column(1), "n": size, "gain": upto[ends] - upto[ends - size]}

    summed = map_rows(chunked, weigh, "key long, words long, n long, gain long").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("words", "n", "gain")])
    ids = rows.select(F.col(row).alias("key"), F.col(key).alias("id"))
    weight = F.when(F.col("n") > 0, F.expr("(gain - pmod(gain, n)) div n")).otherwise(0)
    chance = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((chance.cast("double") + 0.5) / 4294967296.0)))
    scored = work_table(ids.join(summed, "key").select("key", "id", F.col("n").alias("n_features"), weight.alias("weight"), (weight + noise).alias("score"), (F.col("words") >= least_words).alias("long_enough")), "scores")
    drawn = scored.filter("long_enough").count() * percent // 100
    ranked = placed(scored, ["long_enough"], [F.desc("score"), F.asc_nulls_last("id"), F.col("key")], "place", "ranks")
    rank = F.when(F.col("long_enough") & (F.col("place") < drawn), F.col("place") + 1)
    return ranked.select(F.col("id").alias(key), "n_features", "weight", "score", rank.alias("rank"))


ORACLE = f"""
with words as (
  select 0 as side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
  union all
  select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
runs as (select side, doc_id, unnest(w) as word from words),
known as (select word, {crc32_sql("word")} % 10000 as bucket from (select distinct word from runs)),
counts as (select bucket, count(*) filter (side = 0)::double as s, count(*) filter (side = 1)::double as t from runs join known using (word) group by bucket),
totals as (select sum(s) as ss, sum(t) as tt from counts),
gain as (select bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::bigint as g from counts, totals),
sums as (select doc_id, count(*) as n, sum(g)::bigint as g from runs join known using (word) join gain using (bucket) where side = 0 group by doc_id),
scored as (
  select w.doc_id, len(w.w)::bigint as n_features, coalesce(floor(g::double / n), 0)::bigint as weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as noise
  from words w left join sums using (doc_id) where side = 0),
long_enough as (select doc_id, row_number() over (order by weight + noise desc, doc_id) as place, count(*) over () * 10 // 100 as drawn from scored where n_features >= 20)
select s.doc_id, n_features, weight, weight + noise as score, case when place <= drawn then place end as rank
from scored s left join long_enough using (doc_id)"""
