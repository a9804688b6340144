"""ORD-2 on files: the last lines of every file below a folder, read backwards from its end.

``tail_log_lines`` of ``scan_log_lines`` reads whole logs for twenty lines of each. Here a
task opens a file at its end and reads blocks backwards until it has the line feeds it
needs, so what is read depends on the lines asked for and not on the file's size.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitelens.operators.logs import TAIL_LINES
from suitelens.session import default_parallelism
from suitelens.sources.listing import file_system, list_files

TAIL_SCHEMA = "file string, from_end int, value string, error string"
BLOCK_BYTES = 64 << 10
FILES_PER_TASK = 20_000
#: text of lines that a task sends to Spark at once
SEND_BYTES = 8 << 20


def last_lines(f: BinaryIO, size: int, n: int = TAIL_LINES, block: int = BLOCK_BYTES) -> list[bytes]:
    """The last ``n`` lines of an open file of ``size`` bytes, the last one first.

    Only a line feed ends a line, and the last line may lack it. Reads blocks from the end, none before
    the one in which the first of those lines begins.
    """
    pieces, begin, feeds = [], size, 0
    while begin > 0 and feeds <= n:
        length = min(block, begin)
        begin -= length
        f.seek(begin)
        piece = f.read(length)
        if len(piece) != length:
            raise OSError("the file has become shorter")
        if not pieces and not piece.endswith(b"\n"):
            feeds = 1  # the end of the file ends its last line
        feeds += piece.count(b"\n")
        pieces.append(piece)
    lines = b"".join(reversed(pieces)).split(b"\n")
    if lines[-1] == b"":  # behind the last line feed, or of an empty file
        lines.pop()
    return lines[::-1][:max(n, 0)]


def _tail_batches(batches: Iterator[pd.DataFrame], n: int, block: int) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as pafs

    columns = [c.split()[0] for c in TAIL_SCHEMA.split(", ")]
    rows, held = [], 0
    for pdf in batches:
        for file in pdf["file"].tolist():
            try:
                fs, path = file_system(file)
                # the size now, not the listing's: a log may still grow
                size = fs.get_file_info(path).size or 0
                with open(path, "rb") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path) as f:
                    lines = last_lines(f, size, n, block)
            except OSError as e:
                rows.append((file, None, None, str(e)))
                continue
            for k, line in enumerate(lines, start=1):
                rows.append((file, k, line.decode("utf-8", "replace"), None))
                held += len(line)
                if held >= SEND_BYTES:
                    yield _frame(rows, columns)
                    rows, held = [], 0
        if rows:
            yield _frame(rows, columns)
            rows, held = [], 0


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"from_end": "Int32"})


def tail_files(spark: SparkSession, path: str, n: int = TAIL_LINES, glob: str | None = None,
               block: int = BLOCK_BYTES) -> DataFrame:
    """``file, from_end, value, error``: the last ``n`` lines of every file below ``path`` whose name matches
    ``glob``, ``from_end`` = 1 being the last one.

    The lines are those of ``tail_log_lines(scan_log_lines(...))``: only a line feed ends one (a carriage return
    before it stays), an empty file has none, files whose names begin with a dot or an underscore are left out. Bytes
    that are no UTF-8 become replacement characters. A file that can't be opened or read is one row
    with its ``error`` (folders and entries that can't be listed are in ``list_tree``'s errors).
    Files are dealt to tasks by count; a task holds the lines of one file at a time.
    """
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    files = list_files(spark, path).where(~name.rlike(r"\A[._]"))
    if glob:
        files = files.where(name.rlike(_java_pattern(glob)))
    count = files.count()
    tasks = max(1, min(count, 4 * default_parallelism(spark)), -(-count // FILES_PER_TASK))
    dealt = files.select("file").repartition(tasks, "file")
    return dealt.mapInPandas(partial(_tail_batches, n=n, block=block), TAIL_SCHEMA)


def _java_pattern(glob: str) -> str:
    """A shell pattern as a regular expression that both Python and Java read alike."""
    rx = re.sub(r"\\[zZ]\Z", "", fnmatch.translate(glob))
    return rf"\A{rx}\z"
