"""Versioned tables and the phrase index, against plain lists."""

import os
import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.operators import phrase_index
from threadloom.sources.versions import Conflict, Store


def rows(spark, *made, schema="id long, v string"):
    return spark.createDataFrame(list(made), schema)


def test_versions_change_as_one(spark, tmp_path):
    path = "file://" + str(tmp_path / "store")
    empty = Store(spark, path)
    assert empty.version == 0 and empty.read("a") is None
    one = empty.commit(replace={"a": rows(spark, (1, "x")), "b": rows(spark, (1, "old"))})
    two = one.commit(replace={"a": one.read("a").withColumn("v", F.upper("v"))}, append={"b": rows(spark, (2, "new"))})
    assert [tuple(r) for r in two.read("a").collect()] == [(1, "X")] and sorted(r.id for r in two.read("b").collect()) == [1, 2]
    assert [tuple(r) for r in one.read("a").collect()] == [(1, "x")]  # a version stays as it was
    with pytest.raises(Conflict):
        one.commit(replace={"a": rows(spark, (9, "late"))})
    assert Store(spark, path).version == 2


def test_a_run_killed_before_its_manifest_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = "file://" + str(tmp_path / "store")
    one = Store(spark, path).commit(replace={"a": rows(spark, (1, "x")), "b": rows(spark, (1, "y"))})

    def killed(self, tables):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            one.commit(replace={"a": rows(spark, (2, "z")), "b": rows(spark, (2, "z"))})
    again = Store(spark, path)
    assert again.version == 1 and again.read("a").first()["id"] == again.read("b").first()["id"] == 1
    bad = rows(spark, (3, "w")).withColumn("id", F.expr("assert_true(id < 0)"))
    with pytest.raises(Exception, match="USER_RAISED|assert|is not true"):
        again.commit(replace={"a": rows(spark, (3, "w")), "b": bad})
    assert Store(spark, path).read("a").first()["id"] == 1
    two = again.commit(replace={"a": rows(spark, (4, "v"))})
    assert two.clear_old(1) >= 2 and two.read("a").first()["id"] == 4 and two.read("b").first()["id"] == 1
    assert len(os.listdir(tmp_path / "store" / "a")) == 1


def plain(text):
    return re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn"))


def test_index_equals_scanning(spark, tmp_path):
    rng = random.Random(3)
    words = ["a", "b", "À", "c", "éa", "x_y", "1", "ｂ", "B", "ça"]
    texts = {i: rng.choice([" ", "-", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, 40))) for i in range(80)} | {80: None, 81: "", 82: "a " * 5000, 83: "…"}
    store = phrase_index.upsert(Store(spark, "file://" + str(tmp_path / "i")), rows(spark, *[(i, (t or "") + " a b" if i % 3 == 0 else t) for i, t in texts.items()], (None, "a b"), schema="doc_id long, text string"))
    later = {i: t for i, t in texts.items() if i % 3 == 0} | {100: "b a b A", 7: None}
    store = phrase_index.upsert(store, rows(spark, *later.items(), schema="doc_id long, text string"))
    stand = {i: t for i, t in (texts | later).items() if t is not None}
    tokens = {i: plain(t) for i, t in stand.items()}
    texts_n, words_n = store.read("stats").first()
    assert (texts_n, words_n) == (len(stand), sum(map(len, tokens.values())))
    for phrase in ("a b", "A", "a a", "b à b", "EA ca 1", "x y", "x_y", "zzz", "a zzz", "", "…"):
        want = plain(phrase)
        hits = {i: n for i, w in tokens.items() if want and (n := sum(w[j : j + len(want)] == want for j in range(len(w) - len(want) + 1)))}
        got = phrase_index.phrase_search(store, phrase).collect()
        assert {r.doc_id: r.hits for r in got} == hits, phrase
        assert all(r.length == len(tokens[r.doc_id]) and r.score > 0 for r in got)


def test_a_phrase_reads_its_buckets_only(spark, tmp_path):
    made = [(i, " ".join(f"w{j}" for j in range(i, i + 30))) for i in range(60)]
    store = phrase_index.upsert(Store(spark, "file://" + str(tmp_path / "i")), rows(spark, *made, schema="doc_id long, text string"))
    folders = len({d for _, ds, _ in os.walk(tmp_path / "i" / "postings") for d in ds if d.startswith("bucket=")})
    assert folders > 20
    for phrase in ("w5 w6", "w40", "w7 w8 w9"):
        lists = phrase_index.posting_lists(store, phrase.split())
        read = {re.search(r"bucket=(\d+)", r[0])[1] for r in lists.select(F.input_file_name()).collect()}
        assert len(read) <= len(phrase.split())
        plan = lists._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert phrase_index.phrase_search(Store(spark, "file://" + str(tmp_path / "none")), "w1").count() == 0


def test_lists_have_a_row_for_each_block(spark, tmp_path, monkeypatch):
    """However many texts a block holds; its lengths come with it, and long texts end it."""
    monkeypatch.setattr(phrase_index, "BLOCK", 2_000)
    made = [(i, "of the " * (i % 7 + 1) + "é" * (i % 3)) for i in range(300)] + [(300, "of the end " * 900), (301, ""), (302, None)]
    few = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    store = Store(spark, "file://" + str(tmp_path / "i"))
    block = phrase_index._block
    assert block(pa.array([5, 6, 7], pa.int64()), ["b a b", None, "a"]).to_pylist() == [{"term": "b", "keys": [5], "hits": [2], "places": [0, 2]}, {"term": "a", "keys": [5, 7], "hits": [1, 1], "places": [1, 0]}, {"term": None, "keys": [5, 6, 7], "hits": [3, None, 1], "places": []}]
    assert block(pa.array([5], pa.int64()), [None]).to_pylist() == [{"term": None, "keys": [5], "hits": [None], "places": []}]
    store = phrase_index.upsert(store, few)
    rows = phrase_index.posting_lists(store, ["of"]).count()
    assert 3 < rows < 60
    assert {r.doc_id: r.hits for r in phrase_index.phrase_search(store, "of the").collect()} == {i: t.count("of the") for i, t in made if t}
    assert store.read("stats").first()[0] == 302
