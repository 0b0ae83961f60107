"""Each operator against a brute-force version, on small tables with nulls, ties, repeats, empty and long texts."""

import base64
import gzip
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import ann, bpe, chat, common, ngram_join, near_dup, packing, quality, suffix_dedup, toxicity, warc
from threadloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chain string, sig long, salt int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made_up(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    passage, hot = made_up(rng, 60), made_up(rng, 55)
    out = [None, "", "  \n ", "one", "Two Words", "two words", "a b c", "A b C d", "ÄÖ ünï 🙂 é", "x" * 5000, "erst, " * 400, "<|endoftext|> it's 'll", made_up(rng, 9000)]
    for _ in range(30):
        base = made_up(rng, rng.randint(20, 300)).split(" ")
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = made_up(rng, 1)
            out.append(" ".join(copy))
    out += [made_up(rng, 40) + " " + passage + "\n" + made_up(rng, 30) for _ in range(5)]
    out += [made_up(rng, 5) + " " + hot + " " + made_up(rng, rng.randint(5, 20)) for _ in range(80)]
    out += [out[20]] * 40 + [out[20].upper()]
    return out


def frame(spark, texts, first=0):
    rows = [(i + first, t, "en", "s", len(t or ""), "x", i, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def shingles(text, n):
    w = WORD.findall((text or "").translate(ASCII))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_bpe_round_trip(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.no_padding(), tok.no_truncation()
    got = {r["doc_id"]: r for r in bpe.round_trip(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(frame(spark, texts).limit(0), path).count() == 0


def test_ngram_join_equals_brute_force(spark, texts):
    for n, percent in ((4, 85), (5, 80)):
        sets = [shingles(t, n) for t in texts]
        name = list(range(len(texts)))

        def find(a, name=name):
            while name[a] != a:
                a = name[a]
            return a

        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    x, y = sorted((find(i), find(j)))
                    name[y] = x
        got = {r["doc_id"]: r for r in ngram_join.join_sets(frame(spark, texts), n, percent).collect()}
        assert len(got) == len(texts)
        assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
        assert [got[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    kept = ngram_join.keep_one(frame(spark, texts), 5, 80)
    assert kept.columns == frame(spark, texts).columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [i for i in range(len(texts)) if find(i) == i]


def test_ngram_join_blocks_and_nulls(spark, monkeypatch):
    rng = random.Random(5)
    base = made_up(rng, 200).split(" ")
    copies = []
    for _ in range(60):
        copy = list(base[: rng.randint(150, 200)])
        copy[rng.randrange(len(copy))] = made_up(rng, 1)
        copies.append(" ".join(copy))
    whole = {r["doc_id"]: r["component_id"] for r in ngram_join.join_sets(frame(spark, copies)).collect()}
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "FREQUENT", 8)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join_sets(frame(spark, copies)).collect()} == whole
    odd = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "q r s t u"), (7, None), (7, "z y x w v"), (7, "z y x w v")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or -1, r["n_shingles"]) for r in ngram_join.join_sets(odd).collect())
    assert got == [(False, 4, 4, 2), (False, 7, 7, 0), (False, 7, 7, 2), (False, 7, 7, 2), (True, 0, -1, 2), (True, 0, 4, 2)]
    assert ngram_join.join_sets(odd.limit(0)).count() == 0


def test_ngram_join_links_through_null_ids(spark):
    w = [f"w{i}" for i in range(260)]
    near = lambda *more: " ".join(w[:200] + list(more))
    got = {r["n_shingles"]: r["component_id"] for r in ngram_join.join_sets(spark.createDataFrame([(1, near()), (None, near("x", "y", "z"))], "doc_id long, text string")).collect()}
    assert got == {197: 1, 200: 1}
    # 1 and 2 hang together only through a row without id; a third pair has no id at all.
    rows = [(1, " ".join(w[:200])), (None, " ".join(w[10:210])), (2, " ".join(w[20:220])), (None, "a b c d e"), (None, "a b c d e"), (4, "p q r s"), (4, " ".join(w[220:])), (4, " ".join(w[221:]))]
    got = sorted((tuple(r) for r in ngram_join.join_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert got == sorted([(1, 197, 1), (None, 197, 1), (2, 197, 1), (None, 2, None), (None, 2, None), (4, 1, 4), (4, 37, 4), (4, 36, 4)], key=repr)


def test_ngram_join_with_null_and_repeated_ids_equals_brute_force(spark, texts):
    rng = random.Random(9)
    ids = [rng.choice([None, rng.randrange(40), 1000 + i]) for i in range(len(texts))]
    sets = [shingles(t, 4) for t in texts]
    name = list(range(len(texts)))

    def find(a):
        while name[a] != a:
            a = name[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                name[find(i)] = find(j)
    smallest = {}
    for i, d in enumerate(ids):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    want = sorted(((d, len(s), smallest.get(find(i)) if s else d) for i, (d, s) in enumerate(zip(ids, sets))), key=repr)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in ngram_join.join_sets(df).collect()), key=repr) == want


def test_suffix_dedup_of_one_id_with_many_texts(spark):
    rng = random.Random(8)
    passage = made_up(rng, 60)
    rows = [(7, made_up(rng, 5) + " " + (passage if i % 2 else made_up(rng, 60)) + " " + made_up(rng, 20), i) for i in range(60)] + [(None, passage, 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, nth int").repartition(3)
    found = suffix_dedup.spans(df).collect()
    assert len({r["body"] for r in found}) == 30 and sum(r["removable"] for r in found) == 29
    kept = {r["nth"]: r["text"] for r in suffix_dedup.cut_repeats(df).collect()}
    assert set(kept) == {r[2] for r in rows}
    assert sum(passage in t for i, t in kept.items() if i != 99) == 1
    assert all(kept[r[2]] == r[1] for r in rows if r[2] % 2 == 0 or r[0] is None)


def test_fragments_never_miss():
    """Sets that differ as much as the threshold allows share a signature, whatever n-grams are frequent."""
    rng, sizes = np.random.default_rng(1), ngram_join.Sizes.of(85)
    for _ in range(400):
        n = int(np.exp(rng.uniform(0, 7)))
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)
        drop = int(rng.integers(0, n * 15 // 100 + 1))
        add = 0
        while 100 * (n - drop) >= 85 * (n + add + 1) and rng.random() < 0.95:
            add += 1
        b = np.sort(np.concatenate([a[drop:], rng.integers(0, 1 << 64, add, dtype=np.uint64, endpoint=False)]))
        frequent = np.sort(rng.permutation(a)[: int(n * rng.random())])
        one, two = (ngram_join.signatures(np.sort(x), frequent, sizes) for x in (a, b))
        assert len(np.intersect1d(one, two))


def test_sets_that_share_a_little_are_no_candidates():
    sizes, rng, frequent = ngram_join.Sizes.of(80), np.random.default_rng(4), np.zeros(0, dtype=np.uint64)
    draw = lambda n: np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    met = 0
    for _ in range(600):
        both = draw(3)
        a, b = (set(ngram_join.signatures(np.sort(np.concatenate([both, draw(300)])), frequent, sizes).tolist()) for _ in range(2))
        met += bool(a & b)
        # As many as linked sets differ in, and one, for the own class and the one below.
        c = sizes.of_size(303)
        assert len(a) == sizes.differ(c) + sizes.differ(c - 1) + 2
    assert met <= 6  # 27, were single n-grams signatures
    # The smallest fragments may be those of one set or of the other: linked sets meet nevertheless, with frequent n-grams or without.
    for n in (12, 40, 90, 303, 900):
        for share in (0, 0.3, 0.8, 1):
            for _ in range(20):
                a = draw(n)
                gone = rng.permutation(n)[: n // 10]
                b = np.sort(np.concatenate([np.delete(a, gone), draw(n // 10)]))
                assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
                known = np.sort(rng.permutation(a)[: int(share * n)])
                assert set(ngram_join.signatures(a, known, sizes).tolist()) & set(ngram_join.signatures(b, known, sizes).tolist())


def test_dedup_leaves_little_on_disk(spark, texts):
    """Work tables that hold n-grams or hashes of texts go once nothing reads them."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    folder = common.shared_dir(spark).removeprefix("file://")
    for make in (lambda: ngram_join.join_sets(docs, 5, 80), lambda: suffix_dedup.spans(docs)):
        before = set(os.listdir(folder))
        rows = make()
        left = {n.rpartition("-")[0] for n in set(os.listdir(folder)) - before}
        assert left and not left & {"met", "candidate-sets", "wanted", "stretches"}
        assert rows.count()


def test_cuts_beyond_a_broadcast(spark, texts, monkeypatch):
    cut = lambda: sorted(map(tuple, suffix_dedup.cut_repeats(frame(spark, texts)).select("doc_id", "text", "n_chars").collect()))
    few = cut()
    for module in (common, suffix_dedup):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert cut() == few and few


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_suffix_dedup(spark, texts):
    rng = random.Random(8)
    seventy = made_up(rng, 70)
    more = [*texts, *(made_up(rng, 60) + " " + seventy + " " + made_up(rng, 60) for _ in range(3)), made_up(rng, 49), made_up(rng, 20) + " " + " ".join(seventy.split()[:49])]
    rows = suffix_dedup.spans(frame(spark, more)).collect()
    words = [WORD.findall((t or "").translate(ASCII)) for t in more]
    held = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 49):
            held.setdefault(tuple(w[p : p + 50]), set()).add(i)
    want = [np.zeros(len(w), dtype=bool) for w in words]
    for key, where in held.items():
        if len(where) > 1:
            for i in where:
                for p in range(len(words[i]) - 49):
                    if tuple(words[i][p : p + 50]) == key:
                        want[i][p : p + 50] = True
    got, gone = ([np.zeros(len(w), dtype=bool) for w in words] for _ in range(2))
    for r in rows:
        got[r["doc_id"]][r["start_word"] : r["end_word"]] = True
        if r["removable"]:
            gone[r["doc_id"]][r["start_word"] : r["end_word"]] = True
    for i, w in enumerate(words):
        assert not (want[i] & ~got[i]).any(), (i, want[i].sum(), got[i].sum())
        assert len(set(w)) < 10 or not (got[i] & ~want[i]).any()
    # Nothing repeats any more, and each 50 words that repeated are still somewhere.
    left = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 49):
            if not gone[i][p : p + 50].any():
                left.setdefault(tuple(w[p : p + 50]), set()).add(i)
    assert all(len(v) == 1 for v in left.values())
    out = suffix_dedup.cut_repeats(frame(spark, more))
    assert out.columns == frame(spark, more).columns
    for r in out.collect():
        w = [x for x, g in zip(words[r["doc_id"]], gone[r["doc_id"]]) if not g]
        assert WORD.findall((r["text"] or "").translate(ASCII)) == w and r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
    null = spark.createDataFrame([(None, seventy), (None, seventy)], "doc_id long, text string")
    assert suffix_dedup.spans(null).count() == 0 and suffix_dedup.cut_repeats(null).count() == 2


def covered(rows, words):
    got, gone = ([np.zeros(len(w), dtype=bool) for w in words] for _ in range(2))
    for r in rows:
        got[r["doc_id"]][r["start_word"] : r["end_word"]] = True
        if r["removable"]:
            gone[r["doc_id"]][r["start_word"] : r["end_word"]] = True
    return got, gone


def repeated(words):
    """By brute force: words in stretches of 50 that several documents hold."""
    held = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 49):
            held.setdefault(tuple(w[p : p + 50]), []).append((i, p))
    want = [np.zeros(len(w), dtype=bool) for w in words]
    for where in held.values():
        if len({i for i, _ in where}) > 1:
            for i, p in where:
                want[i][p : p + 50] = True
    return want, held


def test_suffix_dedup_of_a_repeated_line(spark):
    """Two documents that share a line 100 times: found whole, and each stretch of it stays once."""
    rng = random.Random(11)
    line = made_up(rng, 10)
    texts = [made_up(rng, 30) + " " + " ".join([line] * 100) + " " + made_up(rng, 30) for _ in range(2)]
    words = [t.split() for t in texts]
    want, held = repeated(words)
    got, gone = covered(suffix_dedup.spans(frame(spark, texts)).collect(), words)
    for i in range(2):
        assert not (want[i] & ~got[i]).any()
    assert gone[1][30:-30].all() and not gone[1][:30].any() and not gone[1][-30:].any()
    for where in held.values():
        if len({i for i, _ in where}) > 1:
            assert sum(not gone[i][p : p + 50].any() for i, p in where) == 1


def test_suffix_dedup_of_a_passage_with_a_frequent_tail(spark):
    """The last 38 words of a passage are in many documents, the whole of it in two."""
    import pyarrow as pa

    from threadloom.llm.words import WHITE, grams, runs

    rng = random.Random(12)
    # Its lowest gram is at its beginning, so that few passages have another minimiser before it.
    tail = min((made_up(rng, 38) for _ in range(300)), key=lambda t: grams(next(runs(pa.array([t]), WHITE)).words, 8)[:6].min())
    passages = [made_up(rng, 14) + " " + tail for _ in range(20)]
    texts = [made_up(rng, 20) + " " + made_up(rng, 14) + " " + tail + " " + made_up(rng, 20) for _ in range(400)]
    for p in passages:
        for i in (rng.randrange(400), rng.randrange(400)):
            texts[i] += " " + p + " " + made_up(rng, 20)
    words = [t.split() for t in texts]
    want, _ = repeated(words)
    got, gone = covered(suffix_dedup.spans(frame(spark, texts)).collect(), words)
    assert sum(w.sum() for w in want) >= 2 * 15 * 52
    assert all((w == g).all() for w, g in zip(want, got))
    left = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 49):
            if not gone[i][p : p + 50].any():
                left.setdefault(tuple(w[p : p + 50]), set()).add(i)
    assert all(len(v) == 1 for v in left.values())


def test_suffix_dedup_carries_over_partitions(spark):
    """Holders that cross batches and partitions give what one partition gives."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = sorted({(int(rng.integers(0, 4)), int(f), int(f) + 100, int(p)) for f, p in zip(rng.integers(0, 5, 150), rng.integers(0, 120, 150))})

    def run(cuts, size):
        from unittest import mock

        out, edges = [], []
        for part, own in enumerate(cuts):
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*own[i : i + size])], names=["key", "first", "body", "pos"]) for i in range(0, len(own), size)]
            with mock.patch("pyspark.TaskContext.get", return_value=mock.Mock(partitionId=lambda part=part: part)):
                for d in suffix_dedup._holders(iter(batches), 50):
                    for v in zip(*d.values()):
                        r = dict(zip(d, v))
                        (out if r["edge"] is None else edges).append(r)
        carried, extra = suffix_dedup._across(edges, 50)
        carry = {p: (s, b) for p, s, b in carried}
        got = []
        for r in out:
            s, b = carry.get(r["lead"], (r["source"], r["source_body"]))
            got.append(tuple(int(x) for x in (r["body"], r["first"], r["pos"], s, b, r["near"], r["removable"])))
        return sorted([*got, *(tuple(map(int, x)) for x in extra)])

    whole = run([rows], len(rows))
    want = []
    for n, (k, f, b, p) in enumerate(rows):
        own = [r for r in rows if r[0] == k]
        near = n > 0 and rows[n - 1][0] == k and rows[n - 1][2] == b and p - rows[n - 1][3] < 50
        if len(own) > 1:
            want.append((b, f, p, own[0][1], own[0][2], int(near), int(own[0] != rows[n])))
    assert whole == sorted(want)
    for width, size in ((1, 1), (3, 2), (7, 3), (40, 1), (41, 6)):
        assert run([rows[i : i + width] for i in range(0, len(rows), width)], size) == whole


def vectors(seed=0, n=400, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((25, d))
    x = centres[rng.integers(0, 25, n)] + 0.15 * rng.standard_normal((n, d))
    x[50:60] = x[49]
    rows = [(i, [float(v) for v in r], int(i % 3), "c") for i, r in enumerate(x)]
    rows += [(1000, None, 0, "c"), (1001, [0.0] * d, 0, "c"), (1002, [1.0, None] + [0.0] * (d - 2), 0, "c"), (1003, [float("nan")] * d, 1, "c"), (1004, [1.0] * d, None, "c"), (1005, [], 0, "c"), (None, [1.0] * d, 0, "c")]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int, block string"


def good(rows):
    return {r[0]: np.array(r[1], dtype=np.float32).astype(float) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}


def recall_of(spark, rows, k=20, **how):
    """(share of true neighbours found, rows by query); every row found must have its true score, in order."""
    x = good(rows)
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 20 == 0, k=k, **how).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    found = total = 0
    for q in (q for q in x if q % 20 == 0):
        want = sorted(((-float(x[q] @ v), i) for i, v in x.items() if i != q and len(v) == len(x[q])))[:k]
        own = [got[q][n + 1] for n in range(len(got.get(q, {})))]
        assert len(own) <= len(want) and own == sorted(own, key=lambda t: (-t[1], t[0])) and len({i for i, _ in own}) == len(own)
        assert all(s == pytest.approx(float(x[q] @ x[i])) for i, s in own)
        found, total = found + len({i for i, _ in own} & {i for _, i in want}), total + len(want)
    return found / total, got


def test_nearest_neighbours(spark):
    rows = vectors()
    share, got = recall_of(spark, rows, block=64)
    assert share > 0.95 and sorted(got) == [q for q in sorted(good(rows)) if q % 20 == 0]
    # Of equal vectors the smaller ids come first.
    assert [got[60][r + 1][0] for r in range(3)] != [] and all(a[1] != b[1] or a[0] < b[0] for q in got for a, b in zip([got[q][r] for r in sorted(got[q])], [got[q][r] for r in sorted(got[q])][1:]))
    assert ann.nearest(spark.createDataFrame(rows, VECTORS).limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, "c"), (1, [0.0, 2.0], 0, "c"), (1, [0.0, 2.0], 0, "c"), (20, [3.0], 0, "c")], VECTORS)
    assert sorted(map(tuple, ann.nearest(few, F.col("vec_id") % 20 == 0).collect())) == [(0, 1, 1, 0.0), (0, 2, 1, 0.0)]


def test_nearest_neighbours_recall(spark):
    """Vectors spread evenly over 32 directions, of different lengths, and clusters of them: the bar is 0.9."""
    rng = np.random.default_rng(5)
    even = rng.standard_normal((3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    share, _ = recall_of(spark, [(i, [float(v) for v in r], 0, "c") for i, r in enumerate(even)], block=128)
    assert share >= 0.9
    centres = rng.standard_normal((60, 32))
    near = centres[rng.integers(0, 60, 3000)] + 0.1 * rng.standard_normal((3000, 32))
    share, _ = recall_of(spark, [(i, [float(v) for v in r], 0, "c") for i, r in enumerate(near)], block=128)
    assert share >= 0.9


def test_windows_are_narrow_where_vectors_cluster():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((200, 16))
    x = centres[np.repeat(np.arange(200), 20)] + 0.01 * rng.standard_normal((4000, 16))
    top = float(np.linalg.norm(x, axis=1).max())
    y = ann.lifted(x, top)
    curves = ann.learn_curves(y, 4)
    ranks = [np.argsort(np.argsort(ann.curve_keys(y, c), kind="stable")) for c in curves]
    truth = [(i, j) for i in range(0, 4000, 40) for j in np.argsort(-(x @ x[i]))[:20] if i != j]
    far = np.array([[abs(r[i] - r[j]) for r in ranks] for i, j in truth])
    used, reach = ann.choose_windows(far, 4000, 0.95, 64)
    assert used * (2 * reach + 64) < 4000
    assert (far[:, :used].min(axis=1) <= reach).mean() >= 0.95
    assert ann.choose_windows(np.zeros((0, 4)), 10, 0.95, 64) == (2, 64)


def test_near_duplicate_vectors(spark):
    rows = vectors(1)
    x = good(rows)
    label = {r[0]: r[2] for r in rows}
    ids = [i for i in x if label[i] is not None]
    links, name = {i: 0 for i in label}, {i: i for i in label}

    def find(a):
        while name[a] != a:
            a = name[a]
        return a

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if label[i] == label[j] and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                name[b] = a
    got = {r["vec_id"]: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()}
    assert len(got) == len(rows)
    found, real = sum(r["n_links"] for r in got.values()), sum(links.values())
    assert found <= real and found >= 0.9 * real
    assert all(got[i]["n_links"] <= links[i] for i in label)
    assert np.mean([got[i]["component_id"] == find(i) for i in label if i is not None]) > 0.9
    assert near_dup.near_duplicates(spark.createDataFrame(rows, VECTORS).limit(0)).count() == 0


def test_near_duplicates_close_to_the_threshold(spark):
    """Pairs with cosines from just under to just over the threshold, among many others; vectors of two lengths; a hot bucket."""
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((3000, 48)))
    side = rng.standard_normal((400, 48))
    side = unit(side - (side * base[:400]).sum(1)[:, None] * base[:400])
    cosines = np.linspace(0.925, 0.96, 400)[:, None]
    pairs = cosines * base[:400] + np.sqrt(1 - cosines**2) * side
    crowd = unit(base[3] + 0.05 * unit(rng.standard_normal((700, 48))))
    x = np.concatenate([base, pairs, crowd]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 1, "c") for i, r in enumerate(x)] + [(10_000 + i, [float(v) for v in r[:30]], 1, "c") for i, r in enumerate(x[:50])] + [(20_000 + i, [float(v) for v in r[:30]], 1, "c") for i, r in enumerate(x[:50])]
    got = {r["vec_id"]: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    y = unit(x.astype(float))
    hit = y @ y.T >= 0.93
    np.fill_diagonal(hit, False)
    found, real = np.array([got[i]["n_links"] for i in range(len(x))]), hit.sum(1)
    assert (found <= real).all() and found.sum() >= 0.98 * real.sum()
    near = np.flatnonzero((cosines[:, 0] >= 0.93) & (cosines[:, 0] < 0.94))
    assert np.mean([got[3000 + i]["component_id"] == got[i]["component_id"] for i in near if i != 3]) >= 0.95
    assert all(got[10_000 + i]["n_links"] >= 1 and got[20_000 + i]["component_id"] == got[10_000 + i]["component_id"] for i in range(50))


def test_chat_sql(spark):
    import duckdb

    from threadloom.llm import queries

    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    want, got = con.execute(queries.ORACLE_SQL["op4_chat"]).df(), queries.op4_chat(spark, "/root/testdata/sf0.001").toPandas()
    plain = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).to_numpy().tolist()))
    assert plain(got) == plain(want)


def test_chat_views(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "<|x"), (1, 1, "bot", "<|x"), (1, 300, None, None), (None, 0, "user", ""), (2, None, "a", "t")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 3 * 2 + 1 + 1
    for r in got:
        own = [r["rendered"][s:e] for s, e in zip(r["mask_starts"], r["mask_ends"])]
        assert len(own) == r["n_masked"] and r["rendered"].count("<|assistant|>") == r["n_masked"]
    bot = next(r for r in got if r["conv_id"] == 1 and r["speaker"] == "bot" and r["segment"] == 0)
    assert bot["rendered"] == "<|user name=user|>\nhi\n<|assistant|>\n< |x\n" and bot["n_turns"] == 2


def test_warc_round_trip(spark, tmp_path):
    html = ["<a>", "<a>", None, "", "ü" * 100_000, "<a>", "b\r\n\r\nc"]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h, "d") for i, h in enumerate(html)] + [(None, None, "<a>", "d")], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: r for r in warc.archive(pages).collect()}
    first = {}
    for i, h in enumerate(html):
        body = (h or "").encode()
        origin = first.setdefault(body, i)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if origin == i else ("revisit", origin))
    assert got[None]["record_type"] == "revisit" and got[None]["refers_to"] == 0
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w")
    for r in manifest.collect():
        assert gzip.open(r["path"]).read().count(b"WARC/1.1\r\n") == r["records"]
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_refuses_what_is_broken(spark, tmp_path, monkeypatch):
    import io

    digest = base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    one, two = warc.record(1, "http://x", b"abc", digest, None), warc.record(2, None, b"abc", digest, 1)
    read = lambda data: [warc.parsed(*r) for r in warc.read_records(io.BytesIO(data))]
    got = read(one + two)
    assert [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got] == [(1, "response", None, 3), (2, "revisit", 1, 3)]
    for broken in (one[:-3], one + two[:20], one.replace(b"\x1f", b"\x1e", 1)):
        with pytest.raises((ValueError, zlib.error)):
            read(broken)
    plain = gzip.decompress(one)
    for wrong in (plain.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1", 1), plain.replace(b"abc", b"abd"), plain.replace(b"WARC/1.1", b"HTTP/1.1"), plain + b"x"):
        with pytest.raises(ValueError):
            read(gzip.compress(wrong))
    # Archives are cut where they grow large; pages are dealt by digest where the repeated ones are many.
    pages = spark.createDataFrame([(i, "http://x", "page %d" % (i % 40), "d") for i in range(100)], "page_id long, url string, html string, first string").repartition(2)
    monkeypatch.setattr(warc, "ROLL_BYTES", 2000)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 2)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w")
    assert manifest.count() > 4 and manifest.agg(F.sum("records")).first()[0] == 100
    rows = warc.verify_revisits(warc.read_archives(manifest, f"file://{tmp_path}/w")).collect()
    assert all(r["verified"] for r in rows) and {r["page_id"]: r["refers_to"] for r in rows} == {i: None if i < 40 else i % 40 for i in range(100)}
    alone = warc.read_archives(manifest, f"file://{tmp_path}/w").filter("record_type = 'revisit'")
    assert not any(r["verified"] for r in warc.verify_revisits(alone).collect())


def test_words_are_encoded_as_the_library_does():
    """Random texts of controls, odd white space, specials, accents and other scripts."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, coder, rng = Tokenizer.from_file(path), packing.WordTokenizer(path), random.Random(3)
    pool = [chr(i) for i in range(0x180)] + list("'s't're <|>\n\u2009\u3000‐’…ΣςK日ж🙂\u200d\ufeffﬁⅧ٣\u0301") + ["<|endoftext|>", "<|startoftext|>", "'RE", "e\u0301"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(4000)] + ["x" * 3000, "", "a " * 500]
    for text, ids in zip(texts, coder.encode_all(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_packing(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_padding(), tok.no_truncation()
    got = pd.DataFrame([r.asDict() for r in packing.pack_documents(frame(spark, texts), path).collect()])
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == i].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 2048)) and own.length.sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
    assert packing.pack_documents(frame(spark, texts).limit(0), path).count() == 0


def test_packing_of_many_full_pieces(spark):
    """Two tasks of more than 7919 full pieces each: every full piece is a sequence of its own."""
    rows = [(i, " ".join(["the"] * 40_000)) for i in range(2)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    got = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4).toPandas()
    full = got[got.length == 4]
    assert full.groupby("doc_id").size().min() > 7919
    assert got.groupby("sequence_id").length.sum().max() <= 4 and full.sequence_id.nunique() == len(full)


def test_best_fit_keeps_every_capacity():
    lengths = np.random.default_rng(2).integers(1, 900, 300)
    for choose in ("norm", "dot"):
        bins = packing.best_fit(lengths, 1000, 4, 820_000.0, choose)
        for b in range(bins.max() + 1):
            own = lengths[bins == b]
            assert len(own) and own.sum() <= 1000 and len(own) <= 4 and (own**2).sum() <= 820_000


def test_segments_are_all_maximal():
    rng = np.random.default_rng(4)
    for _ in range(100):
        s = rng.integers(-4, 4, rng.integers(1, 25)).astype(float)

        def split(a, b, s=s):
            """By definition: the best segment (shortest of equals), then both sides."""
            spans = [(-s[i:j].sum(), j - i, i, j) for i in range(a, b) for j in range(i + 1, b + 1) if s[i:j].sum() > 0]
            if not spans:
                return []
            v, _, i, j = min(spans)
            return [*split(a, i), (i, j, -v), *split(j, b)]

        got = toxicity.segments(s)
        assert sum(x[2] for x in got) == pytest.approx(sum(x[2] for x in split(0, len(s))))
        assert max((x[2] for x in got), default=0) == pytest.approx(max((x[2] for x in split(0, len(s))), default=0))


def test_toxicity_and_quality_learn(spark):
    rng = random.Random(6)
    bad = ["blarg", "zonk", "fleep"]
    rows, labels = [], []
    for i in range(700):
        words = made_up(rng, rng.randint(30, 120)).split(" ")
        toxic, junk = i % 5 == 0, i % 7 == 3
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " | ".join(w.upper() + "&&&" for w in words) if junk else " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(700, None), (701, ""), (None, "text"), (3, "again")]
    labels += [(900, None, None), (None, 1, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tox = toxicity.score(docs, toxicity.learn(docs, marks)).collect()
    assert len(tox) == len(rows)
    held = [r for r in tox if r["doc_id"] is not None and r["doc_id"] < 700 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in held]) > 0.95
    text = dict(x for x in rows if x[1])
    spans = [text[r["doc_id"]][p["start"] : p["end"]] for r in held for p in r["passages"]]
    assert spans and all(any(b in s.lower() for b in bad) for s in spans)
    good_ = quality.classify(docs, marks).collect()
    held = [r for r in good_ if r["doc_id"] is not None and r["doc_id"] < 700 and r["doc_id"] != 3 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(good_) == len(rows) and np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 7 != 3) for r in held]) > 0.95
    none = marks.limit(0)
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.0}
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, toxicity.learn(docs, none)).collect())
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), marks)).count() == 0 and quality.classify(docs.limit(0), marks).count() == 0


def test_quality_gradient_and_prior(spark):
    """The descent's step equals a slow difference quotient of the risk, and an estimated prior is near the real one."""
    rng = np.random.default_rng(3)
    p, u = (rng.integers(0, 2, (n, 5)).astype(np.float32) for n in (40, 60))

    def risk(w, prior):
        soft = lambda z: np.log1p(np.exp(z))
        gp, gu = p @ w[:5] + w[5], u @ w[:5] + w[5]
        rest = soft(gu).mean() - prior * soft(gp).mean()
        return prior * soft(-gp).mean() + rest if rest >= 0 else -rest

    w, offset = quality._descend(p, u, 0.3, 4000, rate=0.01, ridge=0.0)
    at = np.append(w, offset)
    nearby = [risk(at + 0.05 * d, 0.3) for d in np.concatenate([np.eye(6), -np.eye(6)])]
    assert risk(at, 0.3) <= min(nearby) + 1e-3
    kinds = {"good": lambda r: made_up(r, 60), "junk": lambda r: " ".join("$$%d" % r.randint(0, 9) for _ in range(60))}
    pick = random.Random(4)
    docs = [(i, kinds["good" if i % 10 < 7 else "junk"](pick)) for i in range(3000)]
    labels = spark.createDataFrame([(i, 1 if i % 10 < 7 else 0) for i in range(0, 3000, 2)], "doc_id long, quality int")
    model = quality.learn(quality.features(spark.createDataFrame(docs, "doc_id long, text string")), labels)
    assert model.prior == pytest.approx(0.7, abs=0.1)


def test_toxicity_calibration():
    """lambda solves E[exp(lambda s)] = 1; the logistic curve fits as slow descent does."""
    rng = np.random.default_rng(7)
    s = np.round(rng.choice([-1.0, 0.5, 1.0], 20_000, p=[0.7, 0.2, 0.1]) / toxicity.STEP) * toxicity.STEP
    seen = np.bincount(np.rint((s + toxicity.SPAN) / toxicity.STEP).astype(int), minlength=int(2 * toxicity.SPAN / toxicity.STEP) + 1)
    scale, log_k = toxicity.extreme_value(seen, np.array([3.0, 4.0]), np.array([100.0, 200.0]))
    assert np.exp(scale * s).mean() == pytest.approx(1, abs=1e-3)
    assert log_k == pytest.approx((scale * np.array([3.0, 4.0]) - np.log([100, 200])).mean() - np.euler_gamma)
    x = rng.normal(0, 8, 300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.4 * x - 1)))).astype(float)
    slope, offset = toxicity.logistic(x, y)
    for lowest in (23.7, 12.0):  # classes apart, but for some
        far = np.concatenate([rng.uniform(lowest, 60, 700), rng.normal(1, 3, 6000), [26.5, 11.0]])
        real = np.concatenate([np.ones(700), np.zeros(6002)])
        a, b = toxicity.logistic(far, real)
        assert a > 0 and np.mean((a * far + b > 0) == (real == 1)) > 0.995
    loss = lambda a, b: np.log1p(np.exp(-(2 * y - 1) * (a * x + b))).mean()
    assert all(loss(slope, offset) <= loss(slope + d, offset + e) + 1e-4 for d in (-0.05, 0, 0.05) for e in (-0.2, 0, 0.2))


def test_rows_are_keyed_and_kept_whatever_their_columns(spark, tmp_path):
    rows = [(i, f"t{i}", 9, "a", [i]) for i in range(50)] + [(None, None, 9, "a", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int, _row_key string, row_nth array<int>").repartition(3)
    docs.write.parquet(f"file://{tmp_path}/t")
    for table in (docs, spark.read.parquet(f"file://{tmp_path}/t"), spark.read.parquet(f"file://{tmp_path}/t").filter("doc_id >= 0 or doc_id is null")):
        key = common.unused(table, "row_key")
        keyed = common.keyed(table, "rows", key)
        assert key == "__row_key" and keyed.columns == [*table.columns, key]
        assert keyed.select(key).distinct().count() == 53 and keyed.filter("text is null").count() == 3
        again = keyed.join(keyed.select(key, F.col("text").alias("other")), key).filter("not (text <=> other)")
        assert again.count() == 0
    kept = common.keep_rows(docs, "text", lambda t: np.array([x.as_py() in (None, "t7") for x in t]))
    assert kept.columns == docs.columns and kept.count() == 4


def test_toxic_rows_go_in_one_pass(spark):
    """keep_clean decides as score does."""
    rng = random.Random(6)
    rows = [(i, made_up(rng, 40) + (" blarg zonk" if i % 3 == 0 else ""), i) for i in range(300)] + [(None, None, 0), (None, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    want = sorted(r["doc_id"] or -1 for r in toxicity.score(docs, model).filter("score < 0.5").collect())
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == want and 150 < len(want) < 250


def test_pipeline_decides_by_row(spark, monkeypatch):
    """Null and repeated ids: each row is judged alone, and one row of equal texts stays."""
    import corpus_pipeline

    rng = random.Random(9)
    good_, bad, third = (made_up(rng, 40) for _ in range(3))
    docs = spark.createDataFrame([(1, good_), (1, bad), (None, bad), (None, third)], "doc_id long, text string")
    flag = lambda rows, low, high: rows.select("doc_id", F.when(F.col("text") == bad, low).otherwise(high).alias("score"))
    monkeypatch.setattr(corpus_pipeline.quality, "classify", lambda rows, _, key="doc_id": flag(rows.withColumn("doc_id", F.col(key)), 0.0, 1.0))
    monkeypatch.setattr(corpus_pipeline.toxicity, "learn", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "keep_clean", lambda rows, *_: rows.filter(F.col("text") != bad))
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.drop_toxic):
        out = stage(spark, docs, "/root/testdata/sf0.001").collect()
        assert sorted(((r[0] is None, r[0], r[1]) for r in out), key=str) == sorted([(False, 1, good_), (True, None, third)], key=str)
    copies = spark.createDataFrame([(5, good_)] * 3 + [(None, good_)] + [(None, third)] * 4 + [(7, bad), (3, bad)], "doc_id long, text string").repartition(3)
    out = ngram_join.keep_one(copies, 5, 80).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(5, good_), (None, third), (3, bad)], key=str)
    seventy = made_up(rng, 70)
    repeats = spark.createDataFrame([(None, made_up(rng, 60) + " " + seventy) for _ in range(3)], "doc_id long, text string")
    out = corpus_pipeline.cut_repeats(spark, repeats, "").collect()
    assert [r[0] for r in out] == [None] * 3 and sum(seventy in r[1] for r in out) == 1


def test_pipeline(spark):
    """Whole run on the small table: each stage keeps its columns, later tables go, every sequence is within its limit."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        nxt = stage(spark, out, folder)
        if name != "packing":
            assert nxt.columns == docs.columns
        out = spark.createDataFrame(nxt.toPandas(), nxt.schema)
        counts.append(out.count())
    assert docs.count() > counts[0] > counts[1] > counts[2] >= counts[3]
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert corpus_pipeline.run(spark, folder).count() == counts[-1]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, nulls, repeated rows and extra columns with names that the stages use themselves."""
    import corpus_pipeline

    rng = random.Random(2)
    text = made_up(rng, 80)
    shape = "doc_id long, text string, lang string, source string, n_chars long, row_key int, set string, component_id long, _cuts int, score double"
    rows = [(1, text, "a", None, 3, 1, "s", 5, 1, 0.1), (1, text, "a", None, 3, 2, "s", 5, 1, 0.1), (None, None, None, None, None, None, None, None, None, None), (None, text + " x", None, "s", None, 3, "t", None, None, None), (2, "", "a", "s", 0, 0, "", 0, 0, 0.0)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    full = spark.createDataFrame(rows, shape)
    for docs in (full, full.limit(0)):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[1:]:
            nxt = stage(spark, kept, f"file://{tmp_path}")
            assert name == "packing" or nxt.columns == full.columns
            kept = spark.createDataFrame(nxt.collect(), nxt.schema)
            if name == "near_copies" and docs is full:
                assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (1, text), (2, "")]
        assert kept.count() == (3 if docs is full else 0)
        # Without trusted labels nothing is known to be good.
        assert corpus_pipeline.keep_good(spark, docs, f"file://{tmp_path}").count() == 0
