"""Small cases with known answers: metrics, episodes, eras, findings, windows, people, phone databases and streams."""

import hashlib
import json
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import clock
from threadloom.operators import ambient, conflict, findings, gate, health, identity, metrics, scores, search, segments, windows
from threadloom.operators.ranges import range_join
from threadloom.sources import phone
from threadloom.sources.typed_stream import first_text
from threadloom.streaming import messages as stream

H = 3_600_000
MESSAGE = "thread_id long, id long, ms long, direction string, is_reaction boolean, body string, tension double, warmth double"


def made(spark, rows, **columns):
    """Messages of one thread from (hours, side, tension, warmth, body)."""
    full = [(1, i + 1, int(h * H), "outgoing" if s == "me" else "incoming", False, *(rest[2:] or ["words"]), float(rest[0]), float(rest[1])) for i, (h, s, *rest) in enumerate(rows)]
    return spark.createDataFrame(full, MESSAGE)


def test_clock(spark):
    spring, before = 1710054000000, 1710053999000  # 2024-03-10 07:00 UTC, when New York's clocks leap
    got = spark.createDataFrame([(spring,), (before,)], "ms long").select(clock.local_hour("America/New_York"), clock.local_hour(-5), clock.local_weekday("Asia/Tokyo"), clock.local_month(14)).collect()
    assert [tuple(r) for r in got] == [(3, 2, 0, "2024-03"), (1, 1, 0, "2024-03")]


def test_episodes(spark):
    hot = [(i / 60, "them", 2, 0) for i in range(5)] + [(8 + i / 60, "them", 2, 0) for i in range(4)] + [(30 + i / 60, "me", 2, 0) for i in range(7)]
    assert [r.hostile for r in conflict.episodes(made(spark, hot)).orderBy("start_ms").collect()] == [5, 7]
    sides = [(i / 60, s, t, 0) for i, (t, s) in enumerate(zip((3, 0, 2, 2, 3, 2, 3), ("them", "me", "me", "them", "them", "them", "me")))]
    repair = [(2, "me", 0, 1), (3, "them", 0, 2), (4, "me", 0, 3)]
    e = conflict.episodes(made(spark, sides + repair)).first()
    assert (e.begun_by_me, e.ended_by_me, e.hostile_them, e.hostile_me, e.severe_them, e.severe_me, e.msg_count) == (False, True, 4, 2, 2, 1, 7)
    assert (e.repaired, e.repair_ms, e.repaired_by_me) == (True, 3 * H, False)


def test_era_splits():
    step = np.repeat([[0.0, 1.0], [5.0, 9.0]], 5, axis=0)
    assert conflict.split_points(step) == [0, 5]
    assert conflict.split_points(np.zeros((12, 2))) == [0]
    assert conflict.split_points(np.tile([[0.0], [1.0]], (6, 1))) == [0]
    assert conflict.split_points(step[:7]) == [0]
    assert len(conflict.split_points(np.repeat(np.arange(6.0)[:, None] ** 2, 6, axis=0), most=3)) == 3
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 3)) + (np.arange(30) > 13)[:, None]

    def slow(a):
        best = (0.0, -1)
        for c in range(4, len(a) - 3):
            left, right = a[:c], a[c:]
            within = np.sqrt((((left - left.mean(0)) ** 2).sum(0) + ((right - right.mean(0)) ** 2).sum(0)) / len(a))
            score = (abs(left.mean(0) - right.mean(0)) / np.maximum(within, 1e-6)).mean()
            if score > best[0] + 1e-12:
                best = (score, c)
        return best

    assert conflict.best_split(x, 4) == pytest.approx(slow(x))


def test_eras_of_a_thread(spark):
    rows = [(24 * (14 + 30.4 * m) + i, "them" if i % 2 else "me", 2 if m >= 6 and i % 2 else 0, 0) for m in range(12) for i in range(8)]
    m = made(spark, rows)
    series = conflict.monthly_series(m, conflict.episodes(m, 6 * H, 3))
    got = conflict.eras(series).orderBy("era").collect()
    assert [r.months for r in got] == [6, 6]
    assert got[0].start_ms == 0 and got[1].start_ms == got[0].end_ms + 1 and got[1].hostile_share_them == 1.0


def test_findings(spark):
    block, notice, sorry = r"\bblock you\b", r"\bneed (?:a )?(?:minute|break)\b", r"\bsorry\b"
    rows = [(i / 60, "them", 3, 0) for i in range(5)] + [(0.1, "me", 0, 0, "I need a break"), (2, "me", 0, 0, "sorry"), (2.5, "them", 2, 0, "no"), (5, "them", 0, 0, "Sorry!"), (9, "me", 0, 0, "ok")]
    m = made(spark, sorted(rows))
    e = conflict.episodes(m)
    assert (e.first().hostile, findings.first_repairs(m, e, sorry).first()[1:]) == (6, (0, 1, 0))
    fire = findings.met_with_fire(m, sorry).first()
    assert (fire.total_me, fire.rejected_me, fire.rate_me, fire.total_them, fire.rejected_them) == (1, 1, 1.0, 1, 0)
    assert findings.exits(m, e, block, notice, sorry).first().exit == "softened"
    assert findings.near_by_year(findings.near_mentions(m, e, findings.word_pattern(["O.K", "ok"]))).first().near == 0
    assert findings.near_by_year(findings.near_mentions(m, e, findings.word_pattern(["break"]))).first()[1:6] == (1970, 1, 1, 1.0, 0)
    assert findings.near_mentions(m, e, findings.word_pattern([])).first().near is False
    entries = findings.ledger(m, {"pause": "break", "sorry": "sorry"})
    assert sorted((r.category, r.n_me, r.n_them) for r in findings.ledger_counts(entries).collect()) == [("pause", 1, 0), ("sorry", 1, 1)]


def test_range_join_equals_brute_force(spark):
    rng = random.Random(2)
    spans = [(rng.randint(1, 3), a := rng.randint(-500, 500), a + rng.randint(-10, 300)) for _ in range(60)]
    points = [(rng.randint(1, 3), rng.randint(-600, 900)) for _ in range(200)]
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "n int, thread_id int, a long, b long")
    p = spark.createDataFrame(points, "thread_id int, at long")
    want = sorted((i, at) for i, (t, a, b) in enumerate(spans) for u, at in points if t == u and a <= at <= b)
    assert sorted((r.n, r.at) for r in range_join(s, p, "a", "b", "at", 70).collect()) == want
    left = sorted((r.n, r.at if r.at is not None else 10**6) for r in range_join(s, p, "a", "b", "at", 70, how="left").collect())
    assert left == sorted(want + [(i, 10**6) for i in range(60) if i not in {n for n, _ in want}])


def test_gate(spark):
    totals = [(1, 0, 0, 364 * 24 * H, 9, 1, 0, 9), (1, 1, 0, 729 * 24 * H, 1, 9, 0, 0), (1, 2, 0, 1094 * 24 * H, 1, 9, 9, 1)]
    t = spark.createDataFrame(totals, "thread_id long, era int, start_ms long, end_ms long, severe_them long, severe_me long, coercive_me long, coercive_them long").withColumn("begun_them", F.col("severe_them")).withColumn("begun_me", F.col("severe_me"))
    gates = gate.era_gate(t)
    assert [r.direction for r in gates.orderBy("era").collect()] == ["them", None, "me"]  # without coercive patterns no era leans
    got = gate.stance(gates).first()
    assert got.direction == "me" and got.confidence == pytest.approx((10 - 2.5) / 12.5, abs=1e-3)
    assert gate.framed(gate.stance(gates), False, True).first().frame == "two_readings"
    labels = [("a", i % 2 == 0, float(i % 4), i % 4 >= 2, i % 4) for i in range(40)] + [("b", True, 0.0, False, 0)] * 9
    rows = spark.createDataFrame(labels, "owner string, me boolean, tension double, hostile boolean, severity int")
    assert {r.owner: (r.hostile, r.severe) for r in gate.derive_thresholds(rows).collect()} == {"a": (2, 3), "b": (2, 3)}
    assert {r.owner: (r.verdict, r.bump) for r in gate.self_report_bias(rows).collect()} == {"a": ("balanced", 0.0), "b": ("insufficient", 0.12)}


def test_holdout_is_seeded_and_spread(spark):
    m = made(spark, [(i, "me" if i % 3 else "them", i % 4, 0) for i in range(400)]).withColumn("me", F.col("direction") == "outgoing")
    first = [r.id for r in gate.holdout(m, 40, 1).orderBy("place").collect()]
    assert len(first) == 40 and first == [r.id for r in gate.holdout(m, 40, 1).orderBy("place").collect()]
    assert first != [r.id for r in gate.holdout(m, 40, 2).orderBy("place").collect()]
    counts = gate.holdout(m, 40, 1).groupBy("me", "band").count().collect()
    assert len(counts) == 8 and {r["count"] for r in counts} == {5}


def tiles(rows, most, budget, overlap, prefix):
    """Brute force: whole turns until a window is full."""
    turns, out, window = [], [], 0
    for r in rows:
        if not turns or turns[-1][-1][1] != r[1]:
            turns.append([])
        turns[-1].append(r)
    i, before = 0, []
    while i < len(turns):
        n = size = 0
        own = []
        while i < len(turns):
            own.append(turns[i])
            n, size = n + len(turns[i]), size + sum(-(-(len(r[2]) + 24) // 4) for r in turns[i])
            i += 1
            if n >= most or size >= budget:
                break
        out += [(window, r[0], True) for r in [r for t in before[-overlap:] for r in t][-prefix:]] if window else []
        out += [(window, r[0], False) for t in own for r in t]
        window, before = window + 1, own
    return sorted(out)


def test_windows(spark):
    rng = random.Random(6)
    rows = [(i + 1, rng.choice(["outgoing", "incoming"]), "x" * rng.randint(1, 300)) for i in range(500)]
    m = spark.createDataFrame([(t, i, i * 1000, d, False, b) for t in (1, 2) for i, d, b in rows], "thread_id long, id long, ms long, direction string, is_reaction boolean, body string")
    got = windows.tile(m, 20, 600, 3, 4)
    for t in (1, 2):
        assert sorted((r.window, r.id, r.prefix) for r in got.filter(F.col("thread_id") == t).collect()) == tiles(rows, 20, 600, 3, 4)
    assert windows.tile(m.limit(0)).count() == 0
    jobs = windows.jobs(m, got, "tone").cache()
    one = jobs.filter("thread_id = 1 and window = 1").first()
    lines = one.transcript.split("\n")
    assert len(lines) == len(one.member_ids) and lines[0].startswith(f"[m{one.member_ids[0]}] 1970-01-01 00:0") and one.prefix_ids == one.member_ids[: len(one.prefix_ids)]
    # The second thread's transcripts are the same, so its inputs are known.
    assert jobs.select("input_hash").distinct().count() * 2 == jobs.count()
    assert windows.unread_jobs(jobs, jobs.filter("window < 3")).filter("window < 3").count() == 0
    assert [r.window for r in windows.windows_in_range(jobs.filter("thread_id = 1"), m, 1000, 1000).collect()] == [0]


def test_windows_of_many_threads(spark):
    """Threads are followed in one pass, over batches that end within them; chunks of turns give the same."""
    rng = random.Random(8)
    rows = {t: [(i + 1, rng.choice(["outgoing", "incoming", None]), "x" * rng.randint(1, 300)) for i in range(rng.choice([1, 2, 19, 20, 21, 60]))] for t in range(40)}
    m = spark.createDataFrame([(t, i, i * 1000, d, False, b) for t, own in rows.items() for i, d, b in own] + [(None, 1, 1000, "incoming", False, "lost")], "thread_id long, id long, ms long, direction string, is_reaction boolean, body string")
    found = lambda df: sorted((r.thread_id, r.window, r.id, r.ms, r.prefix) for r in df.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = windows.tile(m, 20, 600, 3, 4)
        assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
        once = found(got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert once == found(windows.tile(m, 20, 600, 3, 4)) == found(windows.tile(m, 20, 600, 3, 4, chunk=20)) == found(windows.tile(m, 20, 600, 3, 4, chunk=0))
    sure = {t: own for t, own in rows.items() if all(d for _, d, _ in own)}
    assert sure and all([x[1:3] + x[4:] for x in once if x[0] == t] == tiles(own, 20, 600, 3, 4) for t, own in sure.items())


def test_intake(spark):
    planned = spark.createDataFrame([(1, 0, "h", [1, 2, 3], [1])], "thread_id long, window long, input_hash string, member_ids array<long>, prefix_ids array<long>")
    s = lambda *ids, w=1.0: [(f"m{i}", 0.5, w, 2.0) for i in ids]
    cases = [("h", "done", s(2, 3), None), ("h", "done", s(1, 2, 3), None), ("h", "done", s(2, 2, 3), "duplicate"), ("h", "done", s(2), "missing"), ("h", "done", s(2, 3, 4), "extra"), ("h", "done", s(2, 3, w=1.5), "schema"), ("h", "done", s(2, 3, w=4.0), "schema"),
             ("h", "done", None, "schema"), ("h", "refused", None, "refused"), ("h", "error", None, "failed"), ("x", "done", s(2, 3), "unknown job"), ("h", "odd", s(2, 3), "envelope")]
    results = spark.createDataFrame([(i, h, st, m) for i, (h, st, m, _) in enumerate(cases)], f"read_at int, input_hash string, status string, messages {windows.SCORES}")
    taken = windows.intake(results, planned)
    assert [r.reason for r in taken.orderBy("read_at").collect()] == [c[3] for c in cases]
    assert [r.read_at for r in windows.accepted(taken).collect()] == [1]
    assert windows.status_counts(taken, planned).first()[1:] == (1, 0, 0, 0, 0)
    assert windows.status_counts(taken.limit(0), planned).first()[1:] == (0, 0, 0, 1, 1)


def test_scores_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"thread_id": 1, "window": 0, "status": "done", "messages": [{"message_id": "m1", "valence": 0.5, "warmth": 1, "tension": 2}, {"message_id": "q", "valence": 0, "warmth": 0, "tension": 0}]}))
    (tmp_path / "b.json").write_text(json.dumps({"thread_id": 1, "window": 1, "status": "done", "messages": [{"message_id": "m1", "valence": -0.5, "warmth": 3, "tension": 0}]}))
    (tmp_path / "c.json").write_text("not json")
    results = scores.read_results(spark, str(tmp_path))
    assert results.count() == 3 and [tuple(r) for r in scores.message_scores(results).collect()] == [(1, 1, 0.0, 2.0, 1.0)]
    m = scores.with_scores(made(spark, [(0, "me", 3, 3), (1, "me", 3, 3)]), scores.message_scores(results)).orderBy("id").collect()
    assert [(r.tension, r.warmth, r.valence, r.scored) for r in m] == [(1.0, 2.0, 0.0, True), (0.0, 0.0, None, False)]


def test_health(spark):
    rows = [(i * 24 * 3, "me", 0, 0) for i in range(200)] + [(24 * 700, "me", 0, 0)]
    m = made(spark, rows).withColumn("att", (F.col("id") < 20).cast("int")).withColumn("smil", F.lit(0)).withColumn("source_kind", F.lit("x")).withColumn("source_file", F.lit(1))
    r = health.report(m, 0, F.max(F.lit(24 * H * 900))).first()
    assert (r.lopsided, r.attachments_stop, r.collapses, r.ends_early, r.level) == (True, True, True, True, "serious")
    assert r.longest_gap == health.gaps(m).first().months and r.absent == r.longest_gap and r.reasons.startswith("absent_months,thin_months")
    files = spark.createDataFrame([(100,), (150,)], "record_count int")
    assert health.collapsed_records(files, m).first()[0] == 250 - 201


def test_search(spark):
    texts = ["Of the of the, of the!", "of  THE", "off the", "the of", None, "the best of the rest is one of the things that people here say of the sea and all of it"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: (r.hits, r.length) for r in search.phrase_search(rows, "of the").collect()}
    assert got == {0: (3, 6), 1: (1, 2), 5: (3, 21)}
    assert search.phrase_search(rows, " ?! ").count() == 0
    m = made(spark, [(i, "me", 0, 0, t or "") for i, t in enumerate(texts)])
    best = search.best_hits(m, "of the", 2).collect()
    assert best[0].snippet.startswith("[Of the]") and len(best) == 2
    asked = search.plan_ask(m.withColumn("scored", F.col("id") > 3), 1, least_warmth=0.0)
    assert [r.id for r in asked.collect()] == [4, 6]
    assert [r.id for r in search.plan_ask(m.withColumn("scored", F.lit(False)), 1, "of the", from_ms=H).collect()] == [2, 6]
    assert search.plan_ask(m.withColumn("scored", F.lit(True)), 1, cap=3).first().label == "3+"
    assert [r.id for r in search.page(m, after_ms=H, limit=2, newest=False).orderBy("id").collect()] == [3, 4]


def test_ambient(spark):
    m = made(spark, [(0, "them", 0, 0, "do you love me?"), (0.1, "me", 0, 0, "i love you 😀😀"), (0.1 + 5 / 60, "them", 0, 0, "I  love\nyou"), (30, "me", 0, 0, "night 👍🏽 👨‍👩‍👧 🇩🇪")])
    lang = {r.me: r for r in ambient.language(m, {"love": r"\bi\s+love\s+you\b"}).collect()}
    assert (lang[True].love, lang[False].love, lang[False].questions) == (1, 1, 50.0)
    assert [(r.emoji, r.n) for r in ambient.top_emoji(m).orderBy("place").collect()] == [("😀", 2), ("🇩🇪", 1), ("👍🏽", 1), ("👨‍👩‍👧", 1)]
    assert metrics.replies_by_side(m).first().median_them == 5.0


def test_people(spark):
    addresses = "id long, ms long, direction string, addresses array<struct<raw: string, role: string>>"
    rows = [(1, 0, "other", [("+15550100001", "to"), ("+15550100002", "to")]), (2, 5, "other", [("5550100001", "to"), ("+15550100003", "to")])]
    m = spark.createDataFrame(rows, addresses)
    assert [r.key for r in identity.find_owner(m).collect()] == ["+15550100001"]
    assert sorted((r.raw, r.key, r.first_ms) for r in identity.identifier_rows(m).collect())[1] == ("+15550100002", "+15550100002", 0)
    got = identity.senders(spark.createDataFrame([(7, 0, "incoming", [("+15550100002", "from"), ("+15550100001", "to"), ("5550100001", "to")]), (8, 0, "outgoing", [("+15550100002", "to")])], addresses), identity.find_owner(m)).orderBy("id").collect()
    assert [(r.sender, [tuple(x) for x in r.recipients]) for r in got] == [("+15550100002", [("+15550100001", "to")]), ("+15550100001", [("+15550100002", "to")])]
    stored = spark.createDataFrame([(5, "a", "+1"), (4, "b", "+1"), (9, "c", None)], "contact_id long, raw string, e164 string")
    arrived = spark.createDataFrame([("p", 1, "zz", "+1"), ("q", 1, "c", None), ("r", 1, "new", None)], "contact string, nth int, raw string, e164 string")
    merged = identity.merge_contacts(arrived, stored)
    assert {r.contact: r.contact_id for r in merged.collect()} == {"p": 4, "q": 9, "r": None}
    people = spark.createDataFrame([(4, None, "+1", False), (9, "Kept", None, True)], "contact_id long, name string, e164 string, is_owner boolean")
    new = spark.createDataFrame([("p", "Pia", "+1", True), ("q", "Other", None, False), ("r", "Rob", None, True)], "contact string, name string, e164 string, is_owner boolean")
    full = {r.name: r.is_owner for r in identity.filled_contacts(people, new, merged).collect()}
    assert full == {"Pia": False, "Kept": True, "Rob": False}
    assert [r.key for r in identity.owner_keys(people, stored).collect()] == ["c"]
    key = lambda *k: hashlib.sha256(json.dumps(sorted(json.dumps(["member", x], separators=(",", ":")) for x in k), separators=(",", ":")).encode()).hexdigest()
    threads = spark.createDataFrame([(1, ["me", "x"], "s1"), (2, ["x"], key("x")), (3, ["me", "y"], "s3"), (4, ["me"], "s4")], "thread_id long, keys array<string>, signature string")
    fixed = {r.thread_id: r.signature for r in identity.repaired_threads(threads, spark.createDataFrame([("me",)], "key string")).collect()}
    assert fixed == {1: "s1", 2: key("x"), 3: key("y"), 4: "s4"}
    eras = identity.refresh_eras(spark.createDataFrame([(1, 5, "Calm", "x")], "thread_id long, start_ms long, name string, summary string"), spark.createDataFrame([(1, 5, 2), (1, 9, 1)], "thread_id long, start_ms long, months int"))
    assert {r.start_ms: r.name for r in eras.collect()} == {5: "Calm", 9: None}
    arrivals = spark.createDataFrame([("a", "k1"), ("a", "k2"), ("b", "k2"), ("b", "k3")], "source_file string, dedup_key string")
    counts = {r.source_file: (r.records, r.new, r.known) for r in identity.import_counts(arrivals, arrivals.filter("dedup_key = 'k1'")).collect()}
    assert counts == {"a": (2, 1, 1), "b": (2, 1, 1)}


def test_files_once_and_replaced_rows(spark, tmp_path):
    for n, text in (("a", "x"), ("b", "y"), ("c", "x")):
        (tmp_path / n).write_text(text)
    files = spark.read.format("binaryFile").load(str(tmp_path / "*"))
    known = spark.createDataFrame([(hashlib.sha256(b"y").hexdigest(),)], "sha256 string")
    assert [r.file[-1] for r in identity.unread_files(files, known).collect()] == ["a"]
    path = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(r, "thread_id int, n int")
    identity.replace_rows(rows((1, 1), (2, 2)), path, "thread_id")
    identity.replace_rows(rows((2, 5)), path, "thread_id")
    assert sorted((r.thread_id, r.n) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 5)]


def archived(text, mutable=False):
    """An attributed string as the archiver writes it: its text, a run, and attributes under a key that is a string too."""
    data = text.encode()
    n = bytes([len(data)]) if len(data) < 128 else b"\x81" + len(data).to_bytes(2, "little") if len(data) < 65536 else b"\x82" + len(data).to_bytes(4, "little")
    name = lambda s: b"\x84" + bytes([len(s)]) + s
    out = b"\x04\x0bstreamtyped\x81\xe8\x03" + name(b"@") + b"\x84\x84" + name(b"NSAttributedString") + b"\x00\x84" + name(b"NSObject") + b"\x00\x85"
    string = b"\x84" + name(b"NSMutableString") + b"\x01\x84" + name(b"NSString") + b"\x01\x94" if mutable else b"\x84" + name(b"NSString") + b"\x01\x94"
    out += b"\x92\x84" + string + name(b"+") + n + data + b"\x86" + name(b"iI") + b"\x01" + bytes([min(127, len(text))])
    klass = b"\x97" if mutable else b"\x96"  # the class of strings, by its number
    plus = b"\x97" if mutable else b"\x96"
    out += b"\x92\x84\x84" + name(b"NSDictionary") + b"\x00\x94" + name(b"i") + b"\x01\x92\x84" + klass + plus + b"\x1d__kIMMessagePartAttributeName\x86"
    return out + b"\x92\x84\x84" + name(b"NSNumber") + b"\x00\x84" + name(b"NSValue") + b"\x00\x94" + name(b"*") + b"\x84\x99\x00\x86\x86\x86"


def test_typed_stream():
    for text in ("hello", "NSString", "__kIMFileTransferGUIDAttributeName", "+", "é" * 200, "x" * 70_000, "a\nb 🙂"):
        assert first_text(archived(text)) == first_text(archived(text, True)) == text
    whole = archived("the words")
    end = whole.index(b"the words") + 9
    assert all(first_text(whole[:i]) is None for i in range(end)) and first_text(whole[:end]) == "the words"
    for junk in (None, b"", b"junk", b"\x04\x0bstreamtyped", b"\x04\x0bstreamtypex\x01", archived(""), whole[:20] + b"\xff" * 40, whole[:18] + b"\x84\x04[99c" + b"a"):
        assert first_text(junk) is None
    nested = b"\x04\x0bstreamtyped\x01\x84\x01@" + b"\x84\x84\x84\x01A\x00\x85" + b"\x92\x84\x93" * 5000
    assert first_text(nested) is None
    codes = b"{s=iqfdc[3c][2i](u=i)#:}"
    numbers = b"\x04\x0bstreamtyped\x01\x84" + bytes([len(codes)]) + codes + b"\x05\x81\x01\x02\x83abcd\x83abcdefgh\xff" + b"abc" + b"\x01\x02" + b"\x07" + b"\x85\x85"
    assert first_text(numbers + whole[18:]) is None  # read to its end without a string
    assert first_text(numbers + b"\x84\x01@\x84\x84\x84\x08NSString\x01\x85\x84\x01+\x02hi\x86") == "hi"


def test_phone_database(spark, tmp_path):
    path = str(tmp_path / "copy.db")
    with sqlite3.connect(path) as db:
        db.executescript("""create table handle(id text); create table chat(chat_identifier text); create table chat_handle_join(chat_id, handle_id); create table chat_message_join(chat_id, message_id);
            create table message(guid text, text text, attributedBody blob, handle_id, date, is_from_me, associated_message_guid text, associated_message_type)""")
        db.executemany("insert into handle values (?)", [("+15550100001",), ("ann@x.org",), ("+15550100002",)])
        db.executemany("insert into chat values (?)", [("+15550100001",), ("+15550100001",), ("group",)])
        db.executemany("insert into chat_handle_join values (?, ?)", [(1, 1), (2, 2), (3, 1), (3, 3)])
        long = "é" * 200
        rows = [("g1", "hello", None, 1, 700_000_000, 0, None, 0), ("g2", None, archived(long), 1, 700_000_001 * 10**9, 1, None, 0), ("g3", None, None, 1, 700_000_002, 0, "p:0/g1", 2000),
                ("g4", None, None, 1, 700_000_003, 0, "bp:g2", 3000), ("g5", None, b"junk", 1, 700_000_004, 0, None, 0), ("g6", "lost", None, 1, 0, 0, None, 0), ("g7", "x", None, 3, 700_000_005, 0, None, 0)]
        db.executemany("insert into message values (?, ?, ?, ?, ?, ?, ?, ?)", rows)
        db.executemany("insert into chat_message_join values (?, ?)", [(1, i) for i in range(1, 7)] + [(2, 1), (3, 7)])
    assert phone.messages(spark, [path]).count() == 0  # two conversations, none chosen
    got = phone.messages(spark, [path], "ann@x.org")
    assert [(r.guid, r.direction, r.body, r.state) for r in got.orderBy("rowid").collect()] == [
        ("g1", "incoming", "hello", "read"), ("g2", "outgoing", long, "read"), ("g3", "incoming", "Loved “hello”", "read"), ("g5", "incoming", phone.UNREADABLE, "unreadable"), ("g6", "incoming", "lost", "undated")]
    assert {r.ms for r in got.filter("guid in ('g1', 'g2')").collect()} == {978_307_200_000 + 700_000_000_000, 978_307_200_000 + 700_000_001_000}
    assert phone.scan(got).first()[2:] == (5, 1, 1, 0, 1)
    assert phone.messages(spark, [path], "group").first().is_group
    with pytest.raises(ValueError):
        phone.read_table(spark, ["/Users/a/Library/Messages/chat.db"], "chat")


def test_streams(spark, tmp_path):
    day = 100 * 24 * H  # what lies at the epoch itself is late from the start

    def write(name, rows):
        rows = [(t, i, day + ms, *rest) for t, i, ms, *rest in rows]
        spark.createDataFrame(rows, "thread_id long, id long, ms long, direction string, is_reaction boolean, tension double").withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    first = [(1, i, i * 60_000, "incoming", False, 3.0) for i in range(6)] + [(1, 9, 3 * H, "outgoing", False, 0.0)]
    write("a", first)
    write("b", first)
    source = lambda: stream.files(spark, str(tmp_path / "in" / "*"), spark.read.parquet(str(tmp_path / "in" / "a")).schema)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream.drain(stream.first_arrivals(source(), ["thread_id", "id"]), out, check)
    assert spark.read.parquet(out).count() == 7
    write("c", [(1, 10, 30 * H, "incoming", False, 0.0), (1, 9, 3 * H, "outgoing", False, 0.0)])
    stream.drain(stream.first_arrivals(source(), ["thread_id", "id"]), out, check)
    assert spark.read.parquet(out).count() == 8
    kept = source().dropDuplicates(["thread_id", "id"])
    stream.drain(stream.sessions(kept), out + "-s", check + "-s")
    assert sorted((r.session_start.hour, r.messages) for r in spark.read.parquet(out + "-s").collect()) == [(0, 6), (3, 1)]
    stream.drain(stream.daily_counts(kept), out + "-d", check + "-d")
    assert spark.read.parquet(out + "-d").count() == 0  # 30 hours in, less than a day beyond the first day's end
    write("d", [(2, 11, 60 * H, "incoming", False, 2.0)])
    stream.drain(stream.daily_counts(source().dropDuplicates(["thread_id", "id"])), out + "-d", check + "-d")
    assert [(r.thread_id, r.sent, r.received) for r in spark.read.parquet(out + "-d").collect()] == [(1, 1, 6)]
    stream.drain(stream.episodes(source().dropDuplicates(["thread_id", "id"]), 6 * H, 5), out + "-e", check + "-e")
    assert [(r.thread_id, r.start_ms, r.end_ms, r.hostile, r.peak) for r in spark.read.parquet(out + "-e").collect()] == [(1, day, day + 5 * 60_000, 6, 3.0)]


def test_stored_and_claims(spark, tmp_path):
    calls = []
    make = lambda n: lambda: calls.append(n) or spark.createDataFrame([(n,)], "n int")
    path = f"file://{tmp_path}/m"
    assert [metrics.stored(spark, path, make(n), anew).first().n for n, anew in ((1, False), (2, False), (3, True))] == [1, 1, 3] and calls == [1, 3]
    readings = spark.createDataFrame([(1, {"a": [1, 2], "b": [3]}), (2, {})], "reading_id int, evidence map<string, array<int>>")
    assert sorted((r.reading_id, r.claim, r.evidence_ids) for r in findings.claims_of(readings).collect()) == [(1, "a", [1, 2]), (1, "b", [3])]


def test_ordered_by_time_and_id(spark):
    m = made(spark, [(0, "me", 0, 0), (0, "them", 2, 0), (0, "me", 0, 0)])
    got = segments.scan(segments.segmented(m), coming={"n": (F.col("tension") >= 2, F.col("id"))}).plain().orderBy("id").collect()
    assert [r.n for r in got] == [2, None, None]
