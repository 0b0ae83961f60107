"""Files of any kind by content, CSV in blocks, and imports end to end."""

import csv
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from threadloom.sources import anyfile, csv_blocks
from threadloom.sources.versions import Store


def test_csv_in_blocks_equals_one_task(spark, tmp_path):
    rng = random.Random(2)
    value = lambda: rng.choice(["x", "a,b", 'q"q', "two\nlines", "\n\n", "", '""', "é🙂", "l" * 300, "\r\nz", '"\n"'])
    for f in range(2):
        with open(tmp_path / f"f{f}.csv", "w", newline="", encoding="utf-8") as out:
            w = csv.writer(out, lineterminator=["\n", "\r\n"][f])
            w.writerow(["id", "a", "b"])
            w.writerows([f"{f}-{i}", value(), value()] for i in range(600))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert csv_blocks._lines(spark, str(tmp_path)).groupBy("file").agg(F.countDistinct("block").alias("n")).filter("n >= 4").count() == 2  # several tasks a file
        got = csv_blocks.read(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = spark.read.csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"').collect()
    same = lambda rows: sorted(repr([None if v is None else v.replace("\r\n", "\n") for v in r]) for r in rows)  # noqa: E731  (that reader folds line ends)
    assert len(got) == 1200 and same(got) == same(want)
    (tmp_path / "empty.txt").write_text("")
    assert csv_blocks.read(spark, str(tmp_path / "empty.txt")).count() == 0


CHAT = "12/03/2021, 10:00 - Ann: hello\n12/03/2021, 10:01 - Me: hi\nthere\n13/03/2021, 09:00 - Ann: again\n"


def test_kinds():
    kinds = {b"SQLite format 3\0": "phone", b"PK\x03\x04": "chat", b"\xef\xbb\xbf<?xml version": "backup", b"<smses>": "backup", b"[12/03/2021, 10:00:01] Ann: x": "chat", b'[{"a": 1}]': "json", b'{"a": 1}\n{"a": 2}': "lines", b'{\n "messages": [': "json", CHAT.encode(): "chat", b"date,from,text\n1,2,3": "rows", b"date\tfrom\n": "rows"}
    assert {k: anyfile.kind_of(k) for k in kinds} == kinds
    with pytest.raises(anyfile.Refused):
        anyfile.kind_of(b"\x89PNG")


def test_imports_of_every_kind(spark, tmp_path):
    at = lambda name: "file://" + str(tmp_path / name)
    (tmp_path / "chat.dat").write_text(CHAT)
    (tmp_path / "rows.dat").write_text('Date,From,Text\n1615543200,Ann,"a\nb"\n1615543260,Me,c\nsoon,Me,d\n')
    (tmp_path / "list.dat").write_text(json.dumps({"messages": [{"timestamp": 1615543200, "sender": "Bob", "direction": "in", "body": "x"}, {"timestamp": 1615543300, "sender": "Me", "direction": "out", "body": "y"}]}, indent=1))
    (tmp_path / "lines.dat").write_text('{"date": 1615543200, "from": "Ann", "text": "hello again"}\n{"date": 1615543201, "from": "Me", "text": "z"}\n')
    (tmp_path / "b.dat").write_text("<?xml version='1.0'?>\n<smses count='1'>\n<sms address=\"+15550100001\" date=\"1704103200000\" type=\"1\" body=\"yo\" read=\"1\" contact_name=\"Cy\" />\n</smses>")
    with sqlite3.connect(tmp_path / "p.dat") as db:
        db.executescript("""create table handle(id text); create table chat(chat_identifier text); create table chat_handle_join(chat_id, handle_id); create table chat_message_join(chat_id, message_id);
            create table message(guid text, text text, attributedBody blob, handle_id, date, is_from_me, associated_message_guid text, associated_message_type);
            insert into handle values ('dee@x.org'); insert into chat values ('dee@x.org'); insert into chat_handle_join values (1, 1); insert into chat_message_join values (1, 1);
            insert into message values ('g', 'sea', null, 1, 700000000, 0, null, 0)""")
    store = Store(spark, at("graph"))
    for name, owner in (("chat.dat", "Me"), ("rows.dat", "Me"), ("list.dat", "Me"), ("lines.dat", "Me"), ("b.dat", None), ("p.dat", "Me")):
        store = anyfile.import_file(store, at(name), owner)
    assert store.version == 6 and [r.new for r in store.read("files").orderBy(F.element_at(F.split("source_file", "/"), -1)).collect()] == [1, 3, 2, 2, 1, 2]
    bodies = {r.body for r in store.read("messages").collect()}
    assert {"hello", "hi\nthere", "again", "a\nb", "c", "x", "y", "hello again", "z", "yo", "sea"} == bodies
    assert store.read("threads").count() == 4  # Ann's chat, rows and lines are one thread
    (tmp_path / "copy.txt").write_text(CHAT)
    assert anyfile.import_file(store, at("copy.txt"), "Me").version == 6
    for owner, reason in ((None, "owner's name"), ("Nobody", "owner unknown")):
        (tmp_path / "other.txt").write_text(CHAT + "14/03/2021, 09:00 - Ann: more\n")
        with pytest.raises(anyfile.Refused, match=reason):
            anyfile.import_file(store, at("other.txt"), owner)
