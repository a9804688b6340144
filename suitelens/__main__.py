"""``python -m suitelens <directory>``: roll up the JUnit reports below a folder.

Scans ``<directory>`` recursively for ``TEST*.xml``, writes the ordered summary
with its total row to ``<directory>/test_summary.csv`` (one file; on a store that does
not write at offsets a folder of ordered CSV parts) and prints a short preview plus the total. Bad reports are all listed with their
parse error, and written to ``<directory>/test_summary_bad.csv``. A folder that does not
exist or holds no report writes nothing and exits 0.
"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

PREVIEW_ROWS = 20


def main(argv: list[str]) -> int:
    if len(argv) < 2:
        print("usage: python -m suitelens <directory>")
        return 1
    root = argv[1].rstrip("/")
    from suitelens.operators import suites
    from suitelens.session import get_session
    from suitelens.sinks.files import is_posix

    spark = get_session()
    out, bad_out = f"{root}/test_summary.csv", f"{root}/test_summary_bad.csv"
    summary = suites.report_rollup(spark, root, out_dir=out, bad_dir=bad_out, relative=False, one_file=is_posix(root))
    if summary is None:
        print(f"no TEST*.xml report below {root}; nothing written")
        return 0
    written = spark.read.schema("Path string, NumTests long, NumFails long, NumErrs long") \
        .option("header", True).option("escape", '"').csv(out)
    written.show(PREVIEW_ROWS, truncate=False)          # preview only; the CSV holds every row
    total = written.where(F.col("Path") == "Total").first()
    if total is not None:
        print(f"total: tests={total.NumTests} failures={total.NumFails} errors={total.NumErrs}")
    bad, n_bad = spark.read.schema("Path string, error string").option("header", True).option("escape", '"').csv(bad_out), 0
    for row in bad.toLocalIterator():                   # one part at a time
        print(f"bad report {row.Path}: {row.error}")
        n_bad += 1
    print(f"{n_bad} bad reports, listed in {bad_out}")
    print(f"summary saved to {out}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
