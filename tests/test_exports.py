"""Readers of exports, normalization and threads on small hand-written cases."""

import datetime
import json
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from threadloom.functions import normalize as N
from threadloom.operators import threads
from threadloom.sources import exports

BIG = "A" * 1_200_000
XML = f"""<?xml version='1.0' encoding='UTF-8'?>
<smses count="9">
  <sms address="+15550100001" date="1704103200" type="1" body="Liked &quot;see you&quot;" read="1" contact_name="Ann" />
  <sms address="5550100001" date="1704103260000" type="2" body="null" read="0" contact_name="Ann" />
  <sms address="shop" date="bad" type="5" body="the dog and the cat" read="null" contact_name="null" />
  <mms address="+15550100001~+15550100002" date="1704103300000" msg_box="1" m_type="132" m_id="x1" read="1" contact_name="null">
    <parts><part seq="-1" ct="application/smil" text="null"/><part seq="0" ct="text/plain" text="hello "/><part seq="1" ct="text/plain" text="you"/>
      <part seq="2" ct="image/png" name="a.png" text="null" data="{BIG}"/></parts>
    <addrs><addr address="+15550100001" type="137"/><addr address="+15550100009" type="151"/></addrs>
  </mms>
</smses>"""


def test_backup(spark, tmp_path):
    (tmp_path / "b.xml").write_text(XML)
    rows = {(r.kind, r.ms): r for r in exports.backup(spark, str(tmp_path / "b.xml")).collect()}
    liked, sent, odd, mms = rows["sms", 1704103200000], rows["sms", 1704103260000], rows["sms", 0], rows["mms", 1704103300000]
    assert (liked.direction, liked.reaction, liked.is_read) == ("incoming", "liked", True)
    assert (sent.direction, sent.body, sent.is_read) == ("outgoing", None, False)
    assert (odd.direction, odd.is_read, odd.lang) == ("other", None, "en")
    assert (mms.body, mms.native_id, mms.direction) == ("hello you", "x1", "incoming")
    assert [(a.mime, a.name, a.size) for a in mms.attachments] == [("image/png", "a.png", 900_000)]
    assert [(a.raw, a.role) for a in mms.addresses] == [("+15550100001", "from"), ("+15550100009", "to")]


CHAT = "\ufeff[17/03/2019, 06:04:09] Mia: a: b\r\nmore\r\n\r\n[18/03/2019, 23:59:59] Lines are now private. Read: on\r\n[2/4/19, 1:05:00 PM] Otto: <Media omitted>\r\n[31/02/2019, 10:00] Mia: no such day\r\n"


def test_chat_text(spark, tmp_path):
    (tmp_path / "c.txt").write_bytes(CHAT.encode())
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("_chat.txt", "3/28/20, 7:15 PM - Mia: hi\n[not a head\n1/2/20, 12:00 AM - Mia: x - y\n")
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("other.bin", "3/28/20, 7:15 PM - Mia: hi")
    got = {}
    rows = exports.chat_text(spark, str(tmp_path)).cache()
    for r in rows.collect():
        got.setdefault(r.file[-5:], []).append((r.n, r.ms, r.sender, r.body, r.order, r.proven))
    at = lambda *t: int(datetime.datetime(*t, tzinfo=datetime.UTC).timestamp() * 1000)
    assert sorted(got["c.txt"]) == [
        (1, at(2019, 3, 17, 6, 4, 9), "Mia", "a: b\nmore", "dmy", True), (2, at(2019, 3, 18, 23, 59, 59), "Lines are now private. Read", "on", "dmy", True),
        (3, at(2019, 4, 2, 13, 5), "Otto", "", "dmy", True), (4, None, "Mia", "no such day", "dmy", True)]
    assert sorted(got["d.zip"]) == [(1, at(2020, 3, 28, 19, 15), "Mia", "hi\n[not a head", "mdy", True), (2, at(2020, 1, 2), "Mia", "x - y", "mdy", True)]
    scan = {r.file[-5:]: r for r in exports.chat_scan(rows).collect()}
    assert (scan["d.zip"].participants, scan["d.zip"].messages, scan["d.zip"].media, scan["c.txt"].media) == (["Mia"], 2, 0, 1)
    owned = {r.file[-5:]: (r.direction, r.correspondent, r.problem) for r in exports.chat_messages(rows, "Mia").filter("n = 1").collect()}
    assert owned == {"c.txt": ("outgoing", "Lines are now private. Read", "group"), "d.zip": ("outgoing", "Mia", None)}
    assert {r.problem for r in exports.chat_messages(rows, "Nobody").collect()} == {"owner unknown"}


def test_chat_blocks(spark, tmp_path):
    """Messages that begin in one block of a file and go on in the next."""
    (tmp_path / "long.txt").write_text("".join(f"[{i % 28 + 1:02}/05/2021, 10:{i % 60:02}:00] Ann: message {i}\nsecond line {i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = exports.chat_text(spark, str(tmp_path)).orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.n for r in rows] == list(range(1, 2001))
    assert all(r.body == f"message {i}\nsecond line {i}" for i, r in enumerate(rows))


def test_formats():
    assert [exports.format_of(p) for p in ("a.XML", "b.zip", "c.tsv", "d.db")] == ["backup", "chat", "rows", "phone"]
    with pytest.raises(ValueError):
        exports.format_of("x.pdf")


def test_plain_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,From,Dir,Text\n1704103200,Ann,in,"a ""b"",\nc"\n1704103200000,Me,,d\n01/02/2021,Ann,in,e\n2024-01-01T10:00:00Z,Bob,0,f\n')
    rows = [(r.ms, r.direction, r.body, r.problem) for r in exports.plain_rows(spark, str(tmp_path / "a.csv"), owner="me").collect()]
    assert rows == [(1704103200000, "incoming", 'a "b",\nc', None), (1704103200000, "outgoing", "d", None), (None, "incoming", "e", "unclear timestamp: 01/02/2021"), (1704103200000, "incoming", "f", None)]
    (tmp_path / "w.json").write_text(json.dumps({"messages": [{"time": 1704103200, "direction": "sent", "body": "x"}, {"time": None, "direction": "sent", "body": "y"}]}))
    named = exports.with_correspondent(exports.plain_rows(spark, str(tmp_path / "a.csv"), owner="me"), "abc" * 20)
    assert {r.correspondent for r in named.collect()} == {"file:abcabcabcabc"}
    rows = [(r.ms, r.direction, r.problem) for r in exports.plain_rows(spark, str(tmp_path / "w.json")).collect()]
    assert rows == [(1704103200000, "outgoing", None), (None, "outgoing", "no timestamp")]


def test_fields(spark):
    values = [("+1 (555) 010-0001", "+15550100001", "mobile"), ("5550100001", "+15550100001", "mobile"), ("a@b.c", None, "email"), ("72727", None, "shortcode"), ("BANK1", None, "alias"), ("", None, "alias"), (None, None, "alias")]
    for raw, e164, kind in spark.createDataFrame(values, "raw string, e string, k string").select("raw", N.e164(F.col("raw")), N.address_kind(F.col("raw"))).collect():
        assert (raw, e164, kind) in values
    bodies = ["Loved “a\nb”", "loved “a”", "Laughed at \"x\"", "Liked it", None]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(N.reaction_kind(F.col("b"))).collect()]
    assert got == ["loved", None, "laughed", None, None]
    got = spark.createDataFrame([("  é   x\n",), (None,)], "b string").select(N.canonical_body(F.col("b"))).collect()
    assert [r[0] for r in got] == ["é x", ""]


def test_threads_and_dedup(spark):
    rows = [
        (1, 0, "outgoing", "a", [("5550100009", "from"), ("5550100001", "to")], "n1", "Ann"),
        (2, 1, "incoming", "b", [("+15550100001", "from"), ("+15550100009", "to")], None, None),
        (3, 1, "incoming", "b", [("+15550100001", "from"), ("+15550100009", "to")], None, None),
        (4, 2, "incoming", "b", [("+15550100001", "from"), ("+15550100009", "to")], None, None),
        (5, 9, "incoming", "c", [("+15550100001", "from"), ("+15550100002", "to"), ("+15550100009", "to")], None, None),
        (6, 9, "outgoing", "c", [], None, None),
    ]
    m = spark.createDataFrame(rows, "id long, ms long, direction string, body string, addresses array<struct<raw: string, role: string>>, native string, contact_name string")
    owner = threads.owner_key(m)
    assert [r.key for r in owner.collect()] == ["+15550100009"]
    t = threads.assign_threads(m, owner)
    found = {r.id: (r.thread_key, r.is_group) for r in t.collect()}
    assert found[1] == found[2] == found[4] and found[5][1] and not found[1][1] and len({v[0] for v in found.values()}) == 3
    keyed = threads.dedup_keys(t, "thread_key", native="native")
    keys = {r.id: (r.dedup_key, r.occurrence) for r in keyed.collect()}
    assert keys[2] == keys[3] and keys[4][1] == 1 and len(set(keys.values())) == 5
    assert threads.new_messages(keyed, keyed.filter("id = 4")).count() == 4
    assert {r.key: (r.first_ms, r.last_ms) for r in threads.contacts(m).collect()}["+15550100001"] == (0, 9)


def test_bodies_are_composed_without_python(spark):
    """NFC as Python's, of marks in any order, jamo, singletons, characters beyond the first plane and texts that need nothing."""
    bodies = ["plain", "é", "e\u0301", "a\u0323\u0307", "a\u0307\u0323", "\u1100\u1161\u11a8", "\u212b", "\u2126", "\U0001d15e", "\ufb01", "\u0958", "x\u0345\u0301", "", "日本", "\U0001f600\u0301", "\u0301"]
    frame = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", N.canonical_body(F.col("b")).alias("c"))
    assert {r.b: r.c for r in frame.collect()} == {b: unicodedata.normalize("NFC", b) for b in bodies}
    keyed = threads.dedup_keys(spark.createDataFrame([(1, "x", "in", 5, "e\u0301"), (2, "x", "in", 5, "é")], "id long, who string, direction string, ms long, body string"), "who")
    assert keyed.select("dedup_key").distinct().count() == 1
    assert "Python" not in keyed._jdf.queryExecution().executedPlan().toString()
