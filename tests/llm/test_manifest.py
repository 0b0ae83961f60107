"""Merkle manifest, resampling, language identification and places, against brute force, on odd tables."""

import math
import random
import re
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import importance, language, merkle, queries
from threadloom.llm.common import work_table
from threadloom.llm.ranks import placed

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp string, place long, tree int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def grown(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def way(tree, i, fanout):
    out = []
    for level in tree[:-1]:
        first = i // fanout * fanout
        run = level[first : first + fanout]
        out.append(("".join(run[: i - first]), "".join(run[i - first + 1 :])))
        i //= fanout
    return out


def manifest_by_hand(rows, fanout, changed):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), changed(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [grown([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names]
    crown = grown([t[-1][0] for t in trees], fanout)
    out = []
    for k, g in enumerate(names):
        for i, (_, doc_id, own, claim) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = way(trees[k], i, fanout) + way(crown, k, fanout)
            now = claim or own
            for left, right in steps:
                now = h(left + now + right)
            out.append((doc_id if groups[g] and _ else None, own, trees[k][-1][0], crown[-1][0], h("".join(a + b for a, b in steps)), now, now == crown[-1][0], "".join(a + b for a, b in steps)))
    return out


def odd_rows():
    rng = random.Random(5)
    rows = [{"doc_id": i, "source": rng.choice(["s", None, ""]), "lang": rng.choice(["en"] * 30 + ["fr", "é", None, "ab", "a"]), "n_chars": rng.choice([None, 3, -7, 2**63 - 1]), "text": rng.choice([None, "", "ünï 🙂", "x" * 90_000, "a:b-"])} for i in range(230)]
    rows += [dict(rows[3])] * 40 + [{"doc_id": None, "source": None, "lang": None, "n_chars": None, "text": None}] * 3
    return rows + [{"doc_id": 7, "source": "t", "lang": rows[7]["lang"], "n_chars": 1, "text": "another"}, {"doc_id": -12, "source": "t", "lang": "only", "n_chars": 1, "text": "one leaf"}]


@pytest.mark.parametrize(("fanout", "block"), [(2, 4), (2, 1024), (3, 9), (16, 16), (5, 1024)])
def test_manifest_equals_brute_force(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)  # several floors of blocks
    rows = odd_rows()
    df = spark.createDataFrame([tuple(r[c] for c in FIELDS) + ("x", 1, 2) for r in rows], DOCS).repartition(3)
    more = F.when(F.col("doc_id") % 3 == 0, merkle.digest([(F.col("n_chars").cast("decimal(20,0)") + 1) if c == "n_chars" else F.col(c) for c in FIELDS]))
    changed = lambda r: leaf(r | {"n_chars": None if r["n_chars"] is None else r["n_chars"] + 1}) if r["doc_id"] is not None and r["doc_id"] % 3 == 0 else None
    got = [tuple(r) for r in merkle.manifest(df, "doc_id", FIELDS, "lang", more, fanout, proofs=True).collect()]
    assert sorted(got, key=repr) == sorted(manifest_by_hand(rows, fanout, changed), key=repr)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.manifest(empty, "doc_id", FIELDS, "lang").count() == 0
    one = spark.createDataFrame([(1, None, "en", 2, "t", "x", 1, 2)], DOCS)
    got = merkle.manifest(one, "doc_id", FIELDS, "lang").first()
    assert got["leaf"] == got["subroot"] == got["root"] == got["folded_root"] and got["proof_sha256"] == h("") and got["verified"]
    with pytest.raises(ValueError, match="fanout"):
        merkle.manifest(one, "doc_id", FIELDS, "lang", fanout=1)


@pytest.mark.parametrize("name", ["op11_merkle", "op12_importance"])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_places(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a"] * 9 + ["b", None]), rng.choice([None, 1, 1, 1, 2, 3]), i) for i in range(500)]
    df = work_table(spark.createDataFrame(rows, "g string, v long, id long").repartition(5), "rows")
    got = placed(df, ["g"], [F.desc("v")], "position", "places").collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(sum(x[0] == g for x in rows)))
        assert [r["v"] for r in mine] == sorted((x[1] for x in rows if x[0] == g), key=lambda v: (v is None, -(v or 0)))
    assert len({r["id"] for r in got}) == 500
    assert placed(work_table(df.limit(0), "rows"), ["g"], [F.col("v")], "position", "places").count() == 0


def some_texts():
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdé0") for _ in range(rng.randint(1, 60))) for _ in range(700))
    return [None, "", " .. ", "a", "A b. c", "xÉ9 " * 50, "w" * 200 + " b", long, "the end", long.upper()]


@pytest.mark.parametrize(("n", "chunk"), [(1, 1), (1, 8192), (2, 7), (3, 2), (3, 100)])
def test_chunks_own_their_runs(n, chunk):
    texts = some_texts()
    found, words, count = ([[] for _ in texts], [0] * len(texts), [0] * len(texts))
    for row, own, runs in importance.chunks(pa.array(texts), n, 997, chunk):
        for i, w, r in zip(row, own, runs):
            assert w <= chunk
            found[i] += r.tolist()
            words[i] += w
            count[i] += 1
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").translate(LOW))
        assert sorted(found[i]) == sorted(zlib.crc32(" ".join(w[j : j + k]).encode()) % 997 for j in range(len(w)) for k in range(1, n + 1) if j + k <= len(w))
        assert words[i] == len(w) and count[i] == max(1, -(-len(w) // chunk))


@pytest.mark.parametrize("n", [1, 2])
def test_resampling_equals_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(importance, "CHUNK", 64)
    texts = some_texts() * 6
    ids = [i if i % 9 else (None if i % 2 else 5) for i in range(len(texts))]  # nulls and repeats
    df = spark.createDataFrame([(d, t, 1, 1, "x") for d, t in zip(ids, texts)], "doc_id long, text string, score int, rank int, key string").repartition(3)
    target = ["the end of a", None, "", "w b c"]
    runs = lambda t: [" ".join(w[j : j + k]) for w in [WORD.findall((t or "").translate(LOW))] for j in range(len(w)) for k in range(1, n + 1) if j + k <= len(w)]
    bucket = lambda x: zlib.crc32(x.encode()) % 50
    s, t = [0] * 50, [0] * 50
    for side, of in ((s, texts), (t, target)):
        for x in of:
            for r in runs(x):
                side[bucket(r)] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + 50) / ((s[i] + 1) * (sum(t) + 50)))) for i in range(50)]
    rows = []
    for i, (d, x) in enumerate(zip(ids, texts)):
        own = runs(x)
        weight = sum(gain[bucket(r)] for r in own) // len(own) if own else 0
        chance = int(sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((chance + 0.5) / 4294967296))), None, len(WORD.findall((x or "").translate(LOW)))])
    eligible = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(eligible[: len(eligible) * 30 // 100]):
        r[4] = k + 1
    got = importance.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), n=n, buckets=50, percent=30, seed=7)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == sorted((tuple(r[:4]) for r in rows), key=repr)
    drawn = lambda of: sorted((r[4], r[3], repr(r[0])) for r in of if r[4] is not None)
    assert drawn([tuple(r) for r in got.collect()]) == drawn(rows)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    got = importance.resample(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), none).orderBy("doc_id").collect()
    assert [(r["n_features"], r["rank"]) for r in got] == [(2, None), (0, None)] and got[1]["weight"] == 0


def made(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


PARTS = {"en": ["th", "ing", "er", "wh", "ou"], "de": ["sch", "ung", "ein", "ü", "pf"], "fr": ["eau", "tion", "ou", "é", "ç"], "es": ["ción", "ñ", "ll", "os", "ue"]}


def test_languages_are_told_apart(spark):
    rng = random.Random(4)
    rows = [(i, made(rng, PARTS[lang], rng.randint(3, 60)), lang, 1, "x") for i in range(600) for lang in [rng.choice(list(PARTS))]]
    rows += [(1000 + i, rows[0][1], rows[0][2], 1, "x") for i in range(300)]  # a group of copies
    rows += [(None, rows[1][1], "xx", 1, "x"), (2001, None, "en", 1, "x"), (2002, "", "en", 1, "x"), (2003, "12 34 !! “”", "en", 1, "x"), (2004, rows[2][1].upper() * 4000, None, 1, "x"), (2005, "日本", "en", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, part string").repartition(3)
    model = language.learn(df)
    assert model.languages == ["de", "en", "es", "fr"] and len(model.family_pairs) == 1 and len(model.language_pairs) == 2
    got = language.identify(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [r for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([by[r[0]]["lang_pred"] == r[2] for r in held]) >= 0.98
    assert by[2001]["lang_pred"] == by[2002]["lang_pred"] == by[2003]["lang_pred"] == "und" and by[2003]["score"] == 0
    assert by[2004]["lang_pred"] == rows[2][2] and by[2005]["lang_pred"] in PARTS and by[None]["lang_pred"] == rows[1][2]
    assert len({r["lang_pred"] for r in got if r["doc_id"] is not None and 1000 <= r["doc_id"] < 1300}) == 1


def test_languages_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.learn(empty)
    assert language.identify(empty, model).count() == 0
    assert language.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first()["lang_pred"] == "und"
    one = spark.createDataFrame([(i, f"text {'abc' * i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language.identify(one, language.learn(one)).collect()} == {("en", 1.0)}


def test_vectors_count_letter_runs():
    for first, last, lettered, x in language.measure(pa.array(["ab, B", None, "1", "É" * 2, "é" * 2, "—"])):
        assert (first, last) == (0, 6) and lettered.tolist() == [True, False, False, True, True, False]
        assert np.allclose(np.linalg.norm(x, axis=1), [1, 0, 0, 1, 1, 0]) and np.array_equal(x[3], x[4])


def test_machine_separates_with_a_margin():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    side = x[:, 0] - 0.5 * x[:, 3] > 0.2
    w = language.fit_machine(x, side)
    assert ((x @ w[:-1] + w[-1] > 0) == side).mean() > 0.97
    # A step in any direction doesn't lower the loss.
    y, load = np.where(side, 1, -1), language.COST * 100 * np.where(side, 0.5 / side.sum(), 0.5 / (~side).sum())
    loss = lambda v: 0.5 * v @ v + (load * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum()
    assert all(loss(w + 1e-3 * rng.normal(size=7)) >= loss(w) - 1e-3 * abs(loss(w)) for _ in range(20))
