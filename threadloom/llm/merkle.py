"""Merkle manifest of a table: a digest for each row, a tree for each group of rows, one root, and a proof for each row.

Rows are placed in their tree by a range sort. Aligned blocks of them hold their digests as one contiguous matrix of
64-byte hex digests, which is reshaped by the fanout and hashed row by row, level by level. Blocks' tops are the nodes
of the next blocks, until a tree is one block; subroots make the last tree the same way. A node's siblings follow from
its index and its level's length alone, so proofs are read from the matrices and the blocks' few upper siblings.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import bounded_join, map_rows, small_batches, work_table
from threadloom.llm.ranks import placed
from threadloom.llm.sql import crc32_sql
from threadloom.llm.words import column_bytes

#: Nodes of a block at most, 64 KB of digests.
BLOCK = 1 << 10
#: Blocks in an Arrow batch at most.
BLOCKS = 64
#: Blocks whose upper siblings may be broadcast (some 2 KB each).
PATHS = 10_000
PATH = "array<struct<left:string,right:string>>"


def digest(columns: list[Column]) -> Column:
    """sha256 in lowercase hex of the columns' values, in Spark's own functions: `-` for null, else UTF-8 byte count, `:`, value."""
    parts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in parts]).cast("binary"), 256)


def hash_rows(rows: np.ndarray) -> np.ndarray:
    """(n, 64): digests in hex of the n rows of a byte matrix."""
    raw, width = rows.tobytes(), rows.shape[1]
    return np.frombuffer("".join([sha256(raw[i : i + width]).hexdigest() for i in range(0, len(raw), width)]).encode(), dtype=np.uint8).reshape(-1, 64)


def levels(nodes: np.ndarray, fanout: int, height: int | None = None) -> list[np.ndarray]:
    """Digest matrices from the nodes up: `height` levels more, or until one node is left. The last run of a level may be short, even one node."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        last = out[-1]
        full = len(last) // fanout * fanout
        up = hash_rows(last[:full].reshape(-1, fanout * 64))
        out.append(np.concatenate([up, hash_rows(last[full:].reshape(1, -1))]) if full < len(last) else up)
    return out


def siblings(tree: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """(digests (n, levels * fanout, 64), which of them are siblings): runs of all nodes, level by level, by index arithmetic."""
    i = np.arange(len(tree[0]))
    runs, real = [], []
    for k, level in enumerate(tree[:-1]):
        node = i // fanout**k
        at = (node // fanout * fanout)[:, None] + np.arange(fanout)
        real.append((at != node[:, None]) & (at < len(level)))
        runs.append(level[np.minimum(at, len(level) - 1)])
    if not runs:
        return np.zeros((len(i), 0, 64), dtype=np.uint8), np.zeros((len(i), 0), dtype=bool)
    return np.concatenate(runs, axis=1), np.concatenate(real, axis=1)


def fold(claims: np.ndarray, tree: list[np.ndarray], fanout: int, path: list[dict]) -> np.ndarray:
    """Roots that follow from claimed digests of a block's nodes, their siblings in the block and the block's upper ones."""
    i, now = np.arange(len(claims)), claims
    for k, level in enumerate(tree[:-1]):
        node = i // fanout**k
        first = node // fanout * fanout
        inputs = level[np.minimum(first[:, None] + np.arange(fanout), len(level) - 1)]
        inputs[i, node - first] = now
        width, up = np.minimum(fanout, len(level) - first), np.empty_like(now)
        for w in np.unique(width):
            own = width == w
            up[own] = hash_rows(inputs[own, :w].reshape(-1, w * 64))
        now = up
    for step in path:
        left, right = (np.frombuffer(step[s].encode(), dtype=np.uint8) for s in ("left", "right"))
        now = hash_rows(np.concatenate([np.tile(left, (len(now), 1)), now, np.tile(right, (len(now), 1))], axis=1))
    return now


def _matrices(nodes: pa.Array) -> Iterator[tuple[pa.StructArray, np.ndarray]]:
    """Each block's nodes and their digests as a matrix."""
    for i in range(len(nodes)):
        own = nodes.slice(i, 1).flatten()
        data, at = column_bytes(own.field("digest"))
        yield own, data[at[0] : at[-1]].reshape(-1, 64)


def _wholly(size: int, block: int, height: int) -> int | None:
    """Levels of a block whose level of the tree has `size` nodes: all of a block's, or to one node where there is one block."""
    return height if size > block else None


def _climb(nodes: DataFrame, most: int, fanout: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """(tables of blocks from the leaves up, (tree, root)) of nodes (tree, position, size, digest, more); `most` is the largest size."""
    block, floors, roots = fanout**height, [], None

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            tree, at, size = (b.column(i).to_pylist() for i in range(3))
            top = [levels(m, fanout, _wholly(n, block, height))[-1].tobytes().decode() for n, (_, m) in zip(size, _matrices(b.column(3)))]
            yield {"tree": tree, "block": at, "size": size, "top": top}

    while True:
        inner = [c for c in nodes.columns if c not in ("tree", "size")]
        grouped = nodes.groupBy("tree", F.floor(F.col("position") / block).alias("block"), "size")  # at most `block` rows each
        floor = work_table(grouped.agg(F.array_sort(F.collect_list(F.struct("position", *[c for c in inner if c != "position"]))).alias("nodes")), "blocks")
        floors.append(floor)
        seen = floor.withColumn("nodes", F.transform("nodes", lambda x: F.struct(x["digest"].alias("digest"))))
        with small_batches(nodes.sparkSession, BLOCKS):
            found = work_table(map_rows(seen, tops, "tree long, block long, size long, top string"), "tops")
        ended = found.filter(F.col("size") <= block).select("tree", F.col("top").alias("root"))
        roots = ended if roots is None else roots.unionByName(ended)
        if most <= block:
            return floors, roots
        nodes = found.filter(F.col("size") > block).select("tree", F.col("block").alias("position"), F.ceil(F.col("size") / block).alias("size"), F.col("top").alias("digest"))
        most = -(-most // block)


def _with_paths(floor: DataFrame, paths: DataFrame) -> DataFrame:
    small = paths.limit(PATHS + 1).count() <= PATHS
    return floor.join(F.broadcast(paths) if small else paths, ["tree", "block"])  # at most PATHS paths


def _down(floor: DataFrame, paths: DataFrame, fanout: int, height: int) -> DataFrame:
    """(tree, block, path): for every node of a floor the siblings above it; the node is `block` of the floor below."""
    block = fanout**height

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            tree, size, above = (b.column(i).to_pylist() for i in (0, 1, 3))
            for t, n, over, (own, m) in zip(tree, size, above, _matrices(b.column(2))):
                runs, real = siblings(levels(m, fanout, _wholly(n, block, height)), fanout)
                out = []
                for i in range(len(m)):
                    steps = []
                    for k in range(real.shape[1] // fanout):
                        here, of = slice(k * fanout, (k + 1) * fanout), i // fanout**k % fanout
                        left, right = (runs[i, here][half][real[i, here][half]].tobytes().decode() for half in (slice(0, of), slice(of, fanout)))
                        steps.append({"left": left, "right": right})
                    out.append(steps + over)
                yield {"tree": [t] * len(m), "block": own.field("position"), "path": out}

    seen = _with_paths(floor, paths).select("tree", "size", F.transform("nodes", lambda x: F.struct(x["position"].alias("position"), x["digest"].alias("digest"))).alias("nodes"), "path")
    with small_batches(floor.sparkSession, BLOCKS):
        return work_table(map_rows(seen, rows, f"tree long, block long, path {PATH}"), "paths")


def _descend(floors: list[DataFrame], trees: DataFrame, fanout: int, height: int) -> DataFrame:
    """(tree, block, path) for the blocks of the lowest floor, from trees (tree, n, path), whose paths lead from their roots on."""
    block = fanout**height
    single = lambda k: trees.filter(F.col("n") <= block ** (k + 1)).select("tree", F.lit(0).cast("long").alias("block"), "path")
    paths = single(len(floors) - 1)
    for k in range(len(floors) - 1, 0, -1):
        lower = _down(floors[k], paths, fanout, height)
        paths = lower.unionByName(single(k - 1))
    return paths


def manifest(rows: DataFrame, key: str, fields: list[str], group: str, claim: Column | None = None, fanout: int = 2, proofs: bool = False) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified, and proof if asked for) for every row.

    A row's leaf is `digest` of its fields. The rows of a group (null is one), by key (nulls first), then leaf, are a
    tree; subroots by group (null first, bytewise) are the last tree. A proof is all siblings from leaf to root, level by
    level, left to right. folded_root is what follows from `claim` (a digest of the row as it is now; where null, the
    leaf) and the siblings; verified says whether it is the root. Rows that are wholly equal are leaves of their own,
    with proofs in any order among them. An empty table gives no rows; extra columns are left alone.
    """
    if fanout < 2:
        raise ValueError("a fanout of at least 2")
    spark, height = rows.sparkSession, 1
    while fanout ** (height + 1) <= BLOCK:
        height += 1
    block = fanout**height
    claimed = claim if claim is not None else F.lit(None).cast("string")
    leaves = work_table(rows.select(F.col(group).alias("grp"), F.col(key).alias("key"), digest([F.col(f) for f in fields]).alias("digest"), claimed.alias("claim")), "leaves")
    groups = work_table(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "groups")
    n_trees, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    named = work_table(placed(groups, [], [F.col("grp")], "tree", "trees"), "trees")
    own = named.select(F.col("grp").alias("own_grp"), "tree", F.col("n").alias("size"))
    joined = leaves.join(F.broadcast(own) if n_trees <= PATHS else own, F.col("grp").eqNullSafe(F.col("own_grp")))  # at most PATHS groups
    nodes = placed(work_table(joined.select("tree", "size", "key", "digest", "claim"), "leaves"), ["tree"], [F.col("key"), F.col("digest")], "position", "leaves")
    floors, subroots = _climb(nodes, most or 0, fanout, height)

    crown = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("position"), F.lit(n_trees).cast("long").alias("size"), F.col("root").alias("digest"))
    tops, root = _climb(crown, n_trees, fanout, height)
    start = spark.range(1).select(F.col("id").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.from_json(F.lit("[]"), PATH).alias("path"))
    over = _down(tops[0], _descend(tops, start, fanout, height), fanout, height).select(F.col("block").alias("tree"), "path")
    whole = root.first()
    roots = subroots.select("tree", F.col("root").alias("subroot"), F.lit(whole["root"] if whole else None).cast("string").alias("root"))
    trees = work_table(named.select("tree", "n").join(over, "tree").join(roots, "tree"), "trees")
    paths = _descend(floors, trees.select("tree", "n", "path"), fanout, height)
    ends = trees.select("tree", "subroot", "root")
    seen = bounded_join(_with_paths(floors[0], paths), ends, ["tree"], rows=n_trees).select("size", "nodes", "path", "subroot", "root")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            size, path, subroot, root = (b.column(i).to_pylist() for i in (0, 2, 3, 4))
            for j, (own, m) in enumerate(_matrices(b.column(1))):
                tree = levels(m, fanout, _wholly(size[j], block, height))
                runs, real = siblings(tree, fanout)
                above = "".join(s["left"] + s["right"] for s in path[j]).encode()
                proof = [runs[i][real[i]].tobytes() + above for i in range(len(m))]
                claims = m.copy()
                changed = np.flatnonzero(own.field("claim").is_valid().to_numpy(zero_copy_only=False))
                if len(changed):
                    claims[changed] = np.frombuffer("".join(own.field("claim").drop_null().to_pylist()).encode(), dtype=np.uint8).reshape(-1, 64)
                folded = [x.tobytes().decode() for x in fold(claims, tree, fanout, path[j])]
                out = {key: own.field("key"), "leaf": own.field("digest"), "subroot": [subroot[j]] * len(m), "root": [root[j]] * len(m), "proof_sha256": [sha256(p).hexdigest() for p in proof], "folded_root": folded, "verified": [f == root[j] for f in folded]}
                yield out | ({"proof": [p.decode() for p in proof]} if proofs else {})

    kind = dict(rows.dtypes)[key]
    return map_rows(seen, prove, f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof string" * proofs)


def _field(c: str) -> str:
    return f"case when {c} is null then '-' else octet_length(encode({c}::varchar)) || ':' || {c} end"


#: The query's rows: leaves and trees of two, all levels by recursion; proofs by join; folding step by step.
ORACLE = f"""
with recursive rows as (
  select row_number() over () as rid, doc_id, lang, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) as leaf,
    case when {crc32_sql("doc_id::varchar")} % 7 = 0 then sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "(n_chars::hugeint + 1)", "text")))}) end as claim
  from documents),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from rows),
nodes as (
  select lang, 0 as lvl, pos, n, leaf as h from leaves
  union all
  select lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by lang, lvl, n, pos // 2),
subroots as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
crown as (
  select 0 as lvl, pos, n, subroot as h from subroots
  union all
  select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from crown where n > 1 group by lvl, n, pos // 2),
floors as (select distinct lang, lvl from nodes where n > 1),
upper as (select distinct lvl from crown where n > 1),
steps as (
  select rid, 0 as part, f.lvl, (l.pos >> f.lvl) as place, s.h as sibling from leaves l join floors f on l.lang is not distinct from f.lang
  left join nodes s on s.lang is not distinct from l.lang and s.lvl = f.lvl and s.pos = xor(l.pos >> f.lvl, 1)
  union all
  select rid, 1, u.lvl, (t.pos >> u.lvl), s.h from leaves l join subroots t on t.lang is not distinct from l.lang cross join upper u
  left join crown s on s.lvl = u.lvl and s.pos = xor(t.pos >> u.lvl, 1)),
numbered as (select *, row_number() over (partition by rid order by part, lvl) as step from steps),
proofs as (select rid, string_agg(sibling, '' order by step) as proof from numbered group by rid),
folded as (
  select rid, 0 as step, coalesce(claim, leaf) as h from leaves
  union all
  select f.rid, n.step, sha256(case when sibling is null then h when place % 2 = 1 then sibling || h else h || sibling end) from folded f join numbered n on n.rid = f.rid and n.step = f.step + 1)
select l.doc_id, leaf, subroot, c.h as root, sha256(coalesce(proof, '')) as proof_sha256, f.h as folded_root, f.h = c.h as verified
from leaves l join subroots t on t.lang is not distinct from l.lang join crown c on c.n = 1 left join proofs p on p.rid = l.rid
join (select rid, arg_max(h, step) as h from folded group by rid) f on f.rid = l.rid"""
