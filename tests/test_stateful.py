"""Stateful streams: any split into runs, from one checkpoint, gives what a batch gives."""

import json
import random

import pytest

from vaultgrid.streaming import stateful


def runs(spark, tmp_path, rows, schema, parts, operator, result, keys, read=None):
    """The newest rows after feeding the parts one by one to restarted queries."""
    feed, out, check = (f"file://{tmp_path}/{n}" for n in ("feed", "out", "check"))
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if parts > 1 else rows, schema).coalesce(1).write.mode("append").parquet(feed)
        stateful.run_once(operator(spark.readStream.schema(schema).parquet(feed)), out, check).awaitTermination()
    return stateful.latest(spark, out, result, keys).collect()


@pytest.mark.parametrize("parts", [1, 3])
def test_journal(spark, tmp_path, parts):
    draw = random.Random(0)
    rows = sorted(((f"t{draw.randrange(5)}", pos, draw.choice(["apply", "undo", "redo", "undo"])) for pos in range(60)), key=lambda r: r[1])
    cut = [rows[k * 60 // parts : (k + 1) * 60 // parts] for k in range(parts)]
    dealt = [None] * 60
    for k, part in enumerate(cut):  # part k of the runs is the k-th stretch of the journal
        dealt[k::parts] = part
    got = runs(spark, tmp_path, dealt, "tx_id string, pos long, action string", parts, stateful.journals, stateful.JOURNAL, ["tx_id"])
    want = {}
    for tx, pos, action in rows:
        applied, undone, redone, refused, _ = want.get(tx, (True, 0, 0, 0, -1))
        if action == "undo" and applied:
            applied, undone = False, undone + 1
        elif action == "redo" and not applied:
            applied, redone = True, redone + 1
        elif action != "apply":
            refused += 1
        want[tx] = (applied, undone, redone, refused, pos)
    assert {r["tx_id"]: (r["state"] == "APPLIED", r["undone"], r["redone"], r["refused"], r["seen"]) for r in got} == want


def test_journal_rows_that_come_twice(spark, tmp_path):
    rows = [("t", 1, "undo"), ("t", 1, "undo")]
    got = runs(spark, tmp_path, rows, "tx_id string, pos long, action string", 2, stateful.journals, stateful.JOURNAL, ["tx_id"])
    assert [(r["state"], r["undone"], r["refused"]) for r in got] == [("REVERTED", 1, 0)]


@pytest.mark.parametrize("parts", [1, 4])
def test_tail(spark, tmp_path, parts):
    rows = [(f"s{i % 3}", i, f"line {i}") for i in range(400)]
    random.Random(1).shuffle(rows)
    got = runs(spark, tmp_path, rows, "source string, id long, line string", parts, stateful.tails, stateful.TAILS, ["source"])
    assert {r["source"]: [tuple(x) for x in json.loads(r["lines"])] for r in got} == {f"s{k}": [(i, f"line {i}") for i in range(400) if i % 3 == k][-25:] for k in range(3)}


def test_versions_and_silence(spark, tmp_path):
    feed, out, check = (f"file://{tmp_path}/{n}" for n in ("feed", "out", "check"))
    schema = "entity string, ts timestamp, version string"
    told = lambda: {r["entity"]: (r["version"], r["changes"], r["stale"]) for r in stateful.latest(spark, out, stateful.VERSIONS, ["entity"]).collect()}

    def feed_rows(*rows):
        spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{e}', TIMESTAMP '{t}', '{v}')" for e, t, v in rows) + " AS t(entity, ts, version)").coalesce(1).write.mode("append").parquet(feed)
        stateful.run_once(stateful.versions(spark.readStream.schema(schema).parquet(feed)), out, check).awaitTermination()

    feed_rows(("a", "2026-01-01 00:00:00", "1"), ("a", "2026-01-01 01:00:00", "2"), ("b", "2026-01-01 00:30:00", "1"))
    assert told() == {"a": ("2", 1, False), "b": ("1", 0, False)}
    feed_rows(("b", "2026-01-05 00:00:00", "1"))
    feed_rows(("b", "2026-01-05 01:00:00", "3"))
    assert told() == {"a": ("2", 1, True), "b": ("3", 1, False)}
    feed_rows(("a", "2026-01-05 02:00:00", "2"))
    assert told()["a"] == ("2", 1, False)
