"""File sources on hand-written files (FIXTURES A1, A4-A6)."""

import os
import tempfile

from suitelens.operators import suites
from suitelens.sources import inventory as src
from suitelens.sources.reports import scan_artifacts, scan_reports


def _write(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)


def test_scan_reports_name_filter(spark):
    root = tempfile.mkdtemp(prefix="suitelens-test-reports-")
    _write(root, "a/TEST-a.xml", '<testsuite tests="2"/>')
    _write(root, "a/b/TEST-b.xml", '<testsuite tests="3" failures="1"/>')
    _write(root, "other.xml", '<testsuite tests="100"/>')
    _write(root, "test-a.xml", '<testsuite tests="100"/>')
    _write(root, "TEST-a.XML", '<testsuite tests="100"/>')
    _write(root, "a/hs_err_pid1.log", "crash")
    got = sorted(tuple(r) for r in suites.summarize(scan_reports(spark, root)).collect())
    assert got == [("Total", 5, 1, 0), ("a/TEST-a.xml", 2, 0, 0), ("a/b/TEST-b.xml", 3, 1, 0)]
    kinds = sorted((r.path, r.kind, r.size) for r in scan_artifacts(spark, root).collect())
    assert kinds == [("a/TEST-a.xml", "report", 22), ("a/b/TEST-b.xml", "report", 35),
                     ("a/hs_err_pid1.log", "crash", 5)]


def test_empty_folder(spark):
    root = tempfile.mkdtemp(prefix="suitelens-test-empty-")
    _write(root, "x/readme.txt", "nothing")
    assert suites.summarize(scan_reports(spark, root)).count() == 0


def test_read_addresses(spark):
    root = tempfile.mkdtemp(prefix="suitelens-test-addr-")
    _write(root, "ip_info.txt", "ID\tIP\ne1\t1.1.1.1\nshort\ne2\t2.2.2.2\textra\n")
    _write(root, "more.txt", "e3\t3.3.3.3\ne4\t4.4.4.4\n")   # first line skipped even if data
    got = sorted(tuple(r) for r in src.read_addresses(spark, root).collect())
    assert got == [("e1", "1.1.1.1"), ("e2", "2.2.2.2"), ("e4", "4.4.4.4")]


def test_read_id_list(spark):
    root = tempfile.mkdtemp(prefix="suitelens-test-ids-")
    _write(root, "a.txt", "ID\tIP\nx1\t1.1.1.1\n\n  x2,2.2.2.2 \nx3\nx4,y\tz\nid,ip\n")
    _write(root, "b.txt", "x5\nid,ip\n")
    got = sorted(r.id for r in src.read_id_list(spark, root).collect())
    assert got == ["id", "id", "x1", "x2", "x3", "x4,y", "x5"]


def test_read_nodes(spark):
    root = tempfile.mkdtemp(prefix="suitelens-test-nodes-")
    _write(root, "nodes.txt", "node0-t 1.1.1.1 s0 10.0.0.1\n  node1-t  N/A s1 10.0.0.2  \n\nbad line here\n"
                              "a b c d e\n")
    nodes, bad = src.read_nodes(spark, root)
    assert sorted(r.hostname for r in nodes.collect()) == ["node0-t", "node1-t"]
    assert sorted(r.line for r in bad.collect()) == ["a b c d e", "bad line here"]


def test_artifact_counts_none_found(spark):
    from suitelens.sources.reports import artifact_counts
    root = tempfile.mkdtemp(prefix="suitelens-test-none-")
    _write(root, "x/readme.txt", "nothing")
    got = sorted(tuple(r) for r in artifact_counts(scan_artifacts(spark, root)).collect())
    assert got == [("crash", 0), ("report", 0)]


def test_hidden_folders_and_empty_reports_are_seen(spark):
    root = tempfile.mkdtemp(prefix="suitelens-test-gaps-")
    _write(root, "a/TEST-1.xml", '<testsuite tests="1"/>')
    _write(root, ".hidden/TEST-2.xml", '<testsuite tests="2"/>')
    _write(root, "_tmp/.x/TEST-3.xml", '<testsuite tests="3"/>')
    _write(root, "a/TEST-empty.xml", "")
    docs = scan_reports(spark, root)
    assert sorted(r.path for r in docs.collect()) == [".hidden/TEST-2.xml", "_tmp/.x/TEST-3.xml", "a/TEST-1.xml", "a/TEST-empty.xml"]
    assert [r.Path for r in suites.quarantine(docs).collect()] == ["a/TEST-empty.xml"]
    assert [tuple(r) for r in suites.summarize(docs).collect()][-1] == ("Total", 6, 0, 0)


def test_large_report_is_read_in_pieces(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="suitelens-test-big-")
    _write(root, "a/TEST-small.xml", '<testsuite tests="1"/>')
    _write(root, "a/TEST-big.xml", '<testsuite tests="2">' + "<testcase/>\n" * 300_000 + "</testsuite>")
    out = sorted(tuple(r) for r in suites.summarize(scan_reports(spark, root)).collect())
    assert out == [("Total", 3, 0, 0), ("a/TEST-big.xml", 2, 0, 0), ("a/TEST-small.xml", 1, 0, 0)]


def test_paths_relative_or_as_given(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="suitelens-test-rel-")
    _write(root, "data/x/a/TEST-1.xml", '<testsuite tests="1"/>')
    monkeypatch.chdir(root)
    assert [r.path for r in scan_reports(spark, f"{root}/data/x/a").collect()] == ["TEST-1.xml"]
    assert [r.path for r in scan_reports(spark, f"file:{root}/data/").collect()] == ["x/a/TEST-1.xml"]
    assert [r.path for r in scan_reports(spark, f"{root}/data/", relative=False).collect()] == [f"{root}/data/x/a/TEST-1.xml"]


def test_missing_inputs(spark):
    root = tempfile.mkdtemp(prefix="suitelens-test-missing-")
    assert suites.report_rollup(spark, f"{root}/none", out_dir=f"{root}/out") is None and not os.path.exists(f"{root}/out")
    assert src.read_addresses(spark, f"{root}/none").collect() == []
    nodes, bad = src.read_nodes(spark, f"{root}/none")
    assert nodes.collect() == [] and bad.collect() == []


def test_log_lines_end_with_line_feeds_only(spark):
    from suitelens.sources.logs import scan_log_lines
    root = tempfile.mkdtemp(prefix="suitelens-test-lines-")
    _write(root, "a b%+c.txt", "one\rtwo\nthree\n")
    got = scan_log_lines(spark, root).collect()
    assert sorted(r.value for r in got) == ["one\rtwo", "three"]
    assert {r.file.rsplit("/", 1)[1] for r in got} == {"a b%+c.txt"}


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    import suitelens.session as session
    monkeypatch.setattr(session, "_is_local", lambda s: False)

    class Bare:
        class sparkContext:
            @staticmethod
            def getCheckpointDir():
                return None

        class conf:
            @staticmethod
            def get(key, default=None):
                return None
    import pytest
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(Bare)


def test_blank_first_lines_are_first_lines(spark):
    root = tempfile.mkdtemp(prefix="suitelens-test-blank-")
    _write(root, "a.txt", "\nid1\tip1\nid2\tip2\n")
    _write(root, "b.txt", "   \nid3\tip3\n")
    _write(root, "c.txt", "ID\tIP\n\nid4\tip4\n")
    _write(root, "d.txt", "")
    _write(root, "e.txt", "id5\tip5")
    got = sorted(tuple(r) for r in src.read_addresses(spark, root).collect())
    assert got == [("id1", "ip1"), ("id2", "ip2"), ("id3", "ip3"), ("id4", "ip4")]
    ids = sorted(r.id for r in src.read_id_list(spark, root).collect())
    assert ids == ["id1", "id2", "id3", "id4", "id5"]


def test_first_line_flag_of_many_files_and_splits(spark):
    from suitelens.sources.logs import scan_log_lines
    root = tempfile.mkdtemp(prefix="suitelens-test-first-")
    for k in range(30):
        _write(root, f"f{k}.txt", "\n".join(f"{k}-{i}" for i in range(1 + 400 * (k % 3))) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        lines = src.with_first_line_flag(scan_log_lines(spark, root))
        assert sorted(r.value for r in lines.where("is_first").collect()) == sorted(f"{k}-0" for k in range(30))
        assert lines.count() == sum(1 + 400 * (k % 3) for k in range(30)) and lines.select("block").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_huge_folder_is_looked_up_by_many_tasks(spark, monkeypatch):
    from suitelens.sources import listing
    monkeypatch.setattr(listing, "LOOKUPS_PER_TASK", 500)
    monkeypatch.setattr(listing, "_BATCH", 300)
    root = tempfile.mkdtemp(prefix="suitelens-test-huge-")
    for i in range(8000):
        _write(root, f"{'.' if i % 100 == 0 else ''}f{i}.txt", "x" * (i % 7))
    files = listing.list_files(spark, root)
    assert files.count() == 8000 and files.agg({"size": "sum"}).first()[0] == sum(i % 7 for i in range(8000))
    from pyspark.sql import functions as F
    tasks = files.groupBy(F.input_file_name()).count().collect()
    assert len(tasks) >= 8000 // 500 and max(r["count"] for r in tasks) < 1500  # written by as many tasks


def test_unreadable_entries_are_rows_and_the_rest_is_listed(spark, monkeypatch):
    import pandas as pd

    from suitelens.sources import listing
    root = tempfile.mkdtemp(prefix="suitelens-test-unreadable-")
    _write(root, "a/TEST-1.xml", "1")
    _write(root, "b/TEST-2.xml", "2")
    os.symlink(os.path.join(root, "nowhere"), os.path.join(root, "a", "broken"))
    with open(os.path.join(os.fsencode(root), b"a", b"bad\xff.txt"), "w"):
        pass
    real = os.scandir

    def closed(path):
        if str(path).endswith("/b"):
            raise PermissionError(13, "Permission denied", path)
        return real(path)

    monkeypatch.setattr(os, "scandir", closed)
    rows = pd.concat(list(listing._list_batches(iter([pd.DataFrame({"path": ["a", "b", "gone"]})]), root)))
    assert rows.loc[rows.error.isna(), "path"].tolist() == ["a/TEST-1.xml"]
    bad = dict(zip(rows.loc[rows.error.notna(), "path"], rows.loc[rows.error.notna(), "error"]))
    assert sorted(bad) == ["a/bad\\udcff.txt", "b", "gone"] and "Permission denied" in bad["b"]
    seen = pd.concat(list(listing._look_up_batches(iter([pd.DataFrame({"file": ["x", "y"], "path": ["a/TEST-1.xml", "a/gone.xml"]})]), root)))
    assert seen["size"].tolist()[0] == 1 and "gone.xml" in seen["error"].tolist()[1]
    monkeypatch.undo()
    tree = listing.list_tree(spark, root)
    assert sorted(r.path for r in tree.files.collect()) == ["a/TEST-1.xml", "b/TEST-2.xml"]
    assert [r.error for r in tree.errors.collect()] == ["the name is not UTF-8"]
    assert sorted(r.path for r in scan_reports(spark, root).collect()) == ["a/TEST-1.xml", "b/TEST-2.xml"]
