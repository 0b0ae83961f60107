"""Loads of records as one commit."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import load, threads
from threadloom.sources.versions import Store

SHAPE = "id long, ms long, direction string, addresses array<struct<raw: string, role: string>>, contact_name string, body string, lang string"


def record(i, direction, others, body, ms=None, name=None, lang=None):
    me, them = ("+15550100009", "from" if direction == "outgoing" else "to"), [(o, "to" if direction == "outgoing" else "from") for o in others]
    return (i, 60_000 * i if ms is None else ms, direction, [me, *them], name, body, lang)


def test_two_imports(spark, tmp_path, monkeypatch):
    path = "file://" + str(tmp_path / "graph")
    first = spark.createDataFrame([record(1, "incoming", ["+15550100001"], "hello", lang="en"), record(2, "outgoing", ["(555) 010-0001"], "hi", lang="en"), record(3, "outgoing", ["+15550100001", "+15550100002"], "both", lang="fr"), record(9, "outgoing", ["+15550100001"], "hi", ms=120_000, lang="en")], SHAPE)
    store = load.load(Store(spark, path), first, "a.xml", "1", native=None)
    assert store.version == 1
    assert [tuple(r) for r in store.read("files").collect()] == [("a.xml", "1", 4, 3, 1)]
    assert store.read("messages").filter("body = 'hi'").count() == 1  # the copy of id 9 isn't kept
    found = {r.n: r for r in store.read("threads").collect()}
    assert found[2].first_ms == 60_000 and found[2].last_ms == 120_000 and found[2].lang == "en" and found[2].languages == "en:2" and found[1].languages == "fr:1"
    people = store.read("contacts").collect()
    assert len(people) == 3 and sum(p.is_owner for p in people) == 1
    assert store.read("identifiers").count() == 4  # two spellings of one number
    # The same file again changes nothing.
    assert load.load(store, first, "copy.xml", "1", native=None).version == 1
    second = spark.createDataFrame([record(1, "incoming", ["5550100001"], "hello"), record(5, "incoming", ["+15550100003"], "new", lang="es"), record(6, "incoming", ["+15550100001"], "later")], SHAPE)

    def killed(self, tables):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            load.load(store, second, "b.xml", "2", native=None)
    again = Store(spark, path)
    assert again.version == 1 and again.read("files").count() == 1 and again.read("messages").count() == 3
    done = load.load(again, second, "b.xml", "2", native=None)
    assert done.version == 2 and done.read("messages").count() == 5
    assert sorted(tuple(r)[2:] for r in done.read("files").collect()) == [(3, 2, 1), (4, 3, 1)]
    assert sum(r.n for r in done.read("threads").collect()) == 5 and max(r.last_ms for r in done.read("threads").collect()) == 360_000
    ids = {r.raw: r.contact_id for r in done.read("identifiers").collect()}
    assert len(set(ids.values())) == 4 and ids["5550100001"] == ids["+15550100001"]
    assert done.read("contacts").filter("is_owner").count() == 1


def test_of_equal_messages_the_first_is_new(spark):
    rows = spark.createDataFrame([(3, "k", "c"), (1, "k", "a"), (2, "l", "b")], "id long, dedup_key string, body string")
    assert sorted(tuple(r) for r in threads.new_messages(rows, rows.filter("id = 2")).collect()) == [(1, "k", "a")]
    same = spark.createDataFrame([(1, "x", "in", 5, "t"), (2, "x", "in", 5, "t"), (3, "x", "in", 6, "t"), (4, "y", "in", 6, "t")], "id long, who string, direction string, ms long, body string")
    assert [r.occurrence for r in threads.dedup_keys(same, "who").orderBy("id").collect()] == [0, 0, 1, 0]
    assert [r.occurrence for r in threads.dedup_keys(same.withColumn("n", F.col("id")), "who", native="n").orderBy("id").collect()] == [0, 1, 2, 0]


def test_a_load_keeps_records_once(spark, tmp_path, monkeypatch):
    """New messages are written as the store's rows alone: no copies of them, nor of what arrived, lie in the shared folder; sent messages have their senders without a join."""
    made = []
    keep = load.kept
    monkeypatch.setattr(load, "kept", lambda df: made.append(df) or keep(df))
    rows = spark.createDataFrame([record(i, "incoming" if i % 2 else "outgoing", [f"+1555010{i % 3:04d}"], f"text {i // 2}", ms=i // 4 * 60_000, lang="en") for i in range(20)], SHAPE)
    store = load.load(Store(spark, "file://" + str(tmp_path / "graph")), rows, "a", "1")
    assert sum("body" in df.columns for df in made) == 1
    got = {r.body + r.direction: r.sender for r in store.read("messages").collect()}
    assert len(got) == 20 and all(s == "+15550100009" for k, s in got.items() if k.endswith("outgoing"))
    assert sorted(got[f"text {i // 2}incoming"] for i in range(1, 20, 2)) == sorted(f"+1555010{i % 3:04d}" for i in range(1, 20, 2))
    # Where roles disagree, the owner is found by company.
    odd = spark.createDataFrame([(1, 0, "outgoing", [("a", "from"), ("b", "to")], None, "x", "en"), (2, 0, "outgoing", [("b", "from"), ("c", "to")], None, "y", "en"), (3, 0, "outgoing", [("b", "from"), ("d", "to")], None, "z", "en")], SHAPE)
    found = load.load(Store(spark, "file://" + str(tmp_path / "odd")), odd, "o", "1")
    assert [r.raw for r in found.read("identifiers").join(found.read("contacts").filter("is_owner"), "contact_id").collect()] == ["b"]
