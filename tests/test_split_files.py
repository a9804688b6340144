"""Files read as several splits: first-line detection and in-file order."""

import os
import tempfile

import pytest

from suitelens.operators.logs import tail_log_lines
from suitelens.sources import inventory as src
from suitelens.sources.logs import scan_log_lines

N = 60000


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _big_file(lines):
    d = tempfile.mkdtemp(prefix="suitelens-test-split-")
    with open(os.path.join(d, "big.txt"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_file_really_splits(spark, small_splits):
    d = _big_file([f"line {i:08d}" for i in range(N)])
    blocks = {r.block for r in scan_log_lines(spark, d).select("block").distinct().collect()}
    assert len(blocks) > 3


def test_header_only_at_true_first_line(spark, small_splits):
    # every 1000th line looks like a header; only the very first line is one
    lines = ["id,ip"] + [("id,ip" if i % 1000 == 0 else f"x{i},1.1.1.1") for i in range(1, N)]
    d = _big_file(lines)
    ids = [r.id for r in src.read_id_list(spark, d).collect()]
    assert len(ids) == N - 1
    assert ids.count("id") == (N - 1) // 1000


def test_tail_in_file_order(spark, small_splits):
    d = _big_file([f"line {i:08d}" for i in range(N)])
    rows = tail_log_lines(scan_log_lines(spark, d), 20).collect()
    got = sorted((r.from_end, r.value) for r in rows)
    assert got == [(k, f"line {N - k:08d}") for k in range(1, 21)]
