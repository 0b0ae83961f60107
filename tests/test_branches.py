"""The tables reach the operators' own branches: the queries' SQL, which gives the same rows, shows each at sf0.01."""

import duckdb
import pytest

from threadloom.plans.queries import ORACLE_SQL

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def rows():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return lambda name: con.execute(ORACLE_SQL[name]).df()


def test_suspicions_and_levels(rows):
    r = rows("archive_report")
    assert set(r["level"]) == {"clear", "notable", "serious"}
    for c in ("attachments_stop", "collapses", "ends_early", "lopsided"):
        assert set(r[c]) == {True, False}, c
    told = {w for x in r["reasons"] for w in x.split(",") if w}
    assert told == {"absent_months", "thin_months", "attachments_stop", "collapses", "ends_early", "lopsided"}
    assert set(rows("archive_months")["below"]) == {True, False}


def test_every_thread_s_rows_take_part(rows):
    assert rows("archive_gaps")["thread_id"].nunique() > 15 and rows("span_discontinuity")["gap_months"].max() > 0


def test_gates_and_labels(rows):
    assert set(rows("english_gate")["available"]) == {True, False}
    assert len(set(rows("self_report_bias")["verdict"]) - {"insufficient"}) >= 1 and "insufficient" in set(rows("self_report_bias")["verdict"])
    assert len(set(map(tuple, rows("derived_thresholds")[["hostile", "severe"]].to_numpy()))) >= 2
    language = rows("ambient_language")
    assert language["linking"].sum() > 0 and language["of_it"].sum() > 0
    assert rows("dedup_occurrences")["occurrence"].max() >= 1


def test_eras_hold_the_episodes(rows):
    power, episodes = rows("power_by_era"), rows("episodes_of_orders")
    assert power["episodes"].sum() == len(episodes) and power.groupby("era")["episodes"].sum().min() > 0
    assert set(power["direction"].dropna()) == {"me", "them"} or power["direction"].notna().any()
    assert rows("exit_signature")["era"].notna().all()


def test_sentiment_of_days_without_scored_messages(rows):
    r = rows("lexicon_sentiment")
    none = r[r["scored"] == 0]
    assert len(none) and none["sentiment"].isna().all() and (none["warmth"] == 0).all()
    assert len(set(rows("steadiness")["phrase"])) >= 1
