"""Session tables: leaves that split, versions that commit at once, jobs on them."""

import pytest
from pyspark.sql import functions as F

from kinetable.sources import store as st
from kinetable.streaming import streams


def table(spark, rows, schema="sid long, shot long, outcome string"):
    return spark.createDataFrame(rows, schema)


def test_round_trip_and_splits(spark, tmp_path):
    held = st.SessionStore(spark, str(tmp_path / "shots"), max_rows=100)
    held.replace(table(spark, [(i, k, "made") for i in range(400) for k in range(2)]))
    leaves = held._manifest()["leaves"]
    assert len(leaves) > 8 and all(n <= 100 for _, n in leaves.values()) and sum(n for _, n in leaves.values()) == 800
    assert not any(a != b and b.startswith(a) for a in leaves for b in leaves)
    assert sorted((r["sid"], r["shot"]) for r in held.get(7).collect()) == [(7, 0), (7, 1)] and held.get(9999).count() == 0
    assert len(held.get(7).inputFiles()) == 1  # one leaf
    held.replace(table(spark, [(7, 0, "missed"), (900, 0, "made")]))
    back = held.rows()
    assert back.select("sid").distinct().count() == 401 and back.count() == 800
    assert [(r["shot"], r["outcome"]) for r in held.get(7).collect()] == [(0, "missed")]
    # two sessions were saved: all other leaves still name the first save's files
    after = held._manifest()["leaves"]
    assert sum(after.get(b) != v for b, v in leaves.items()) <= 2


def test_a_session_larger_than_a_leaf_stays_whole(spark, tmp_path):
    held = st.SessionStore(spark, str(tmp_path / "shots"), max_rows=50)
    rows = [(1, k, "made") for k in range(300)] + [(i, 0, "made") for i in range(2, 200)]
    held.replace(table(spark, rows))
    assert held.get(1).count() == 300 and held.rows().count() == len(rows)
    (large,) = [b for b, (_, n) in held._manifest()["leaves"].items() if n > 50]
    assert len(large) < 24
    held.replace(table(spark, [(1, 0, "missed")]))
    assert held.get(1).count() == 1 and held.rows().count() == 199


def test_rows_find_their_leaf_in_place(spark, tmp_path):
    """Rows of few different values used to meet by those values in a few tasks, whatever their number."""
    held = st.SessionStore(spark, str(tmp_path / "shots"), max_rows=10)
    leaves = ["0", "100", "101", "11"]
    placed = held._placed(table(spark, [(i, 0, "made") for i in range(200)]), leaves)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    bits = {r["sid"]: r["b"] for r in placed.select("sid", st._bits([F.col("sid")], 8).alias("b")).collect()}
    got = {r["sid"]: r["_leaf"] for r in placed.collect()}
    assert set(got.values()) == set(leaves) and all(bits[i].startswith(b) for i, b in got.items())
    held.replace(table(spark, [(i, 0, "made") for i in range(4000)]))
    sizes = {b: n for b, (_, n) in held._manifest()["leaves"].items()}
    assert sum(sizes.values()) == held.rows().count() == 4000 and len(sizes) == 64
    parts = held._parts(placed, leaves)
    assert "Sort" not in parts._jdf.queryExecution().executedPlan().toString()
    assert sum(r["n"] for r in parts.collect()) == 200
    held.replace(table(spark, []))  # nothing is touched
    assert held.rows().count() == 4000


def test_a_save_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch):
    held = st.SessionStore(spark, str(tmp_path / "shots"), max_rows=30)
    held.replace(table(spark, [(i, 0, "made") for i in range(100)]))
    monkeypatch.setattr(held, "_commit", lambda manifest: (_ for _ in ()).throw(RuntimeError("killed")))
    for change in (lambda: held.replace(table(spark, [(5, 0, "missed")])), lambda: held.delete(table(spark, [(6,)], "sid long"))):
        with pytest.raises(RuntimeError, match="killed"):
            change()
    monkeypatch.undo()
    assert held.rows().filter("outcome = 'made'").count() == 100
    # a later save goes on from there, and what the dead ones wrote is swept up
    held.replace(table(spark, [(5, 0, "missed")]))
    assert held.vacuum(1) >= 2 and held.rows().count() == 100 and held.get(5).first()["outcome"] == "missed"


def test_of_two_jobs_for_one_version_the_second_fails(spark, tmp_path):
    held = st.SessionStore(spark, str(tmp_path / "shots"))
    held.replace(table(spark, [(1, 0, "made")]))
    manifest = held._manifest() | {"version": 1}
    with pytest.raises(st.Conflict):
        held._commit(manifest)


def test_old_versions_stay_readable_until_vacuum(spark, tmp_path):
    held = st.SessionStore(spark, str(tmp_path / "shots"))
    for outcome in ("made", "missed", "unknown"):
        held.replace(table(spark, [(1, 0, outcome)]))
    assert [held.rows(v).first()["outcome"] for v in (1, 2, 3)] == ["made", "missed", "unknown"]
    assert held.vacuum(2) == 1 and held._versions() == [2, 3] and held.rows(2).first()["outcome"] == "missed"


def test_columns_must_match_and_all_rows_may_go(spark, tmp_path):
    held = st.SessionStore(spark, str(tmp_path / "shots"), max_rows=20)
    held.replace(table(spark, [(i, 0, "made") for i in range(60)]))
    with pytest.raises(Exception, match="(?i)column"):
        held.replace(table(spark, [(1, 0)], "sid long, shot long"))
    assert held.delete(table(spark, [(i,) for i in range(60)], "sid long")) == 60 and held.rows().count() == 0
    held.replace(table(spark, [(3, 1, "made"), (4, 1, None)]))
    assert held.rows().count() == 2 and held.get(4).first()["outcome"] is None


def test_delete_mark_and_reconcile_change_the_tables(spark, tmp_path):
    sessions, attempts = (st.SessionStore(spark, str(tmp_path / n), max_rows=8) for n in ("sessions", "shots"))
    sessions.replace(table(spark, [(i, "processing" if i % 3 == 0 else "completed", None) for i in range(30)], "sid long, status string, error_message string"))
    attempts.replace(table(spark, [(i, k) for i in range(30) for k in range(2)], "sid long, shot long"))
    ids = lambda *v: table(spark, [(i,) for i in v], "sid long")
    assert st.delete_sessions(sessions, attempts, ids(*range(20), 5, 99)) == (20, 40)
    assert st.delete_sessions(sessions, attempts, ids(*range(20))) == (0, 0)
    assert {r["sid"] for r in sessions.rows().collect()} == set(range(20, 30)) == {r["sid"] for r in attempts.rows().collect()}
    assert st.mark_failed(sessions, table(spark, [(21, "b"), (21, "a"), (99, "x")], "sid long, error_message string")) == 1
    assert st.reconcile_table(sessions) == 2 and st.reconcile_table(sessions) == 0
    got = {r["sid"]: (r["status"], r["error_message"]) for r in sessions.rows().collect()}
    assert got[21] == ("failed", "a") and got[24] == got[27] == ("interrupted", st.INTERRUPTED) and len(got) == 10
    assert all(got[i] == ("completed", None) for i in got if i not in (21, 24, 27))


def test_summary_counts_a_retried_batch_once(spark, tmp_path):
    summary = streams.Summary(spark, str(tmp_path / "summary"), ["sid"], {"n": F.sum("n"), "top": F.max("top")}, max_rows=16)
    batch = lambda *rows: table(spark, rows, "sid long, n long, top double")
    summary.update(batch(*[(i, 1, float(i)) for i in range(40)]), 0)
    summary.update(batch((3, 2, 1.0), (77, 5, 2.0)), 1)
    summary.update(batch((3, 2, 1.0), (77, 5, 2.0)), 1)
    for n in range(2, 5):
        summary.update(batch((3, 1, 9.0)), n)
    got = {r["sid"]: (r["n"], r["top"]) for r in summary.rows().collect()}
    assert got[3] == (6, 9.0) and got[77] == (5, 2.0) and got[0] == (1, 0.0) and len(got) == 41
    assert len(summary.store._versions()) == 2
