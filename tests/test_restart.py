"""Streams that stop and are called again with the same root."""

import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from suitelens.operators import lifecycle as lc
from suitelens.streaming import lifecycle as stream
from suitelens.streaming import logs as stream_logs
from suitelens.streaming import runner
from suitelens.streaming.runner import BatchTable
from tests.test_lifecycle import _t

SCHEMA = "rid long, id long, ts timestamp, status string"


def _write(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(folder, f"in{k}"))
    time.sleep(1.1)


def _rows():
    rng = random.Random(8)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 40), i, _t(rng.randrange(0, 3000)), rng.choice(["BUILD"] * 8 + ["ACTIVE", "ERROR"]))
            for i in range(300)]
    return rows, [rows[k::4] for k in range(4)] + [[(999, 10 ** 6, _t(10 ** 6), "BUILD")]]


class Killed(Exception):
    pass


def _killing(monkeypatch, table, batch):
    """The first write of that table in that batch fails."""
    real, done = BatchTable.write, []

    def write(self, df, b):
        if self.root.endswith(table) and b == batch and not done:
            done.append(b)
            raise Killed()
        real(self, df, b)

    monkeypatch.setattr(BatchTable, "write", write)
    return done


@pytest.mark.parametrize("table", ["fresh", "state"])
def test_readiness_stream_goes_on_after_a_failure(spark, monkeypatch, table):
    monkeypatch.setattr(BatchTable, "MERGE", 2)
    folder, root = (tempfile.mkdtemp(prefix=f"suitelens-test-restart-{x}-") for x in ("in", "root"))
    rows, parts = _rows()
    for k, part in enumerate(parts[:4]):
        _write(spark, folder, k, part)

    def run():
        src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, "in*"))
        return stream.track_readiness_stream(src, "rid", "ts", "status", "id", 300, "2 hours", root=root)

    done = _killing(monkeypatch, table, 2)
    with pytest.raises(Exception):
        run()
    assert done == [2] and runner.last_batch(spark, root) == 1
    run()
    assert runner.last_batch(spark, root) == 3  # batches 0 and 1 were not run again
    _write(spark, folder, 4, parts[4])  # more comes, and a third call goes on
    got = run()
    assert runner.last_batch(spark, root) == 4
    batch = lc.track_readiness(spark.createDataFrame(rows, SCHEMA), resource="rid", tiebreak="id")
    want = sorted((r.rid, r.state, r.decided_at) for r in batch.collect())
    assert sorted((r.resource, r.state, r.decided_at) for r in got.collect()) == want
    again = run()  # nothing new: the same result
    assert sorted((r.resource, r.state, r.decided_at) for r in again.collect()) == want


def test_log_totals_go_on(spark, monkeypatch):
    monkeypatch.setattr(BatchTable, "MERGE", 2)
    folder, root = (tempfile.mkdtemp(prefix=f"suitelens-test-restart-{x}-") for x in ("logs", "root"))
    line = "Tests: succeeded {0}, failed 1, canceled 0, ignored 2, pending 0\n"

    def add(k):
        with open(os.path.join(folder, f"{'ab'[k % 2]}-{k}.txt"), "w") as f:
            f.write(line.format(k))
        time.sleep(0.05)

    def run():
        rows = stream_logs.stream_log_counters(spark, folder, 1)
        out = stream_logs.run_log_totals(rows, spark, "restart", F.regexp_extract("file", "/([ab])-", 1), root=root)
        return sorted((r.log, r.succeeded, r.failed, r.n_counter_lines) for r in out.collect())

    for k in range(5):
        add(k)
    done = _killing(monkeypatch, "parts", 3)
    with pytest.raises(Exception):
        run()
    assert done == [3]
    assert run() == [("a", 6, 3, 3), ("b", 4, 2, 2)]
    add(5)
    assert run() == [("a", 6, 3, 3), ("b", 9, 3, 3)]
    assert run() == [("a", 6, 3, 3), ("b", 9, 3, 3)]


def test_parts_are_merged_in_tiers(spark, monkeypatch):
    monkeypatch.setattr(BatchTable, "MERGE", 3)
    table = BatchTable(tempfile.mkdtemp(prefix="suitelens-test-tiers-") + "/t", "x long")
    for b in range(20):
        table.write(spark.createDataFrame([(b,)], "x long"), b)
        table.merge(spark, b)
        assert sorted(r.x for r in table.upto(spark, b).collect()) == list(range(b + 1))
        assert len(table._cover(b)) <= 2 * 3
    assert table._cover(19) == [(2, 8), (2, 17), (0, 18), (0, 19)]
    assert table.upto(spark, -1).count() == 0
