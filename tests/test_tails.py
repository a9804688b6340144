"""Files read from their end."""

import io
import os
import random
import tempfile

import pytest

from suitelens.operators import logs
from suitelens.sources.logs import scan_log_lines
from suitelens.sources.tails import last_lines, tail_files


class Counting(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


def plain(data: bytes, n: int) -> list[bytes]:
    lines = data.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    return lines[::-1][:n]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_last_lines_like_whole_reads(block):
    rng = random.Random(block)
    for _ in range(400):
        data = bytes(rng.choice(b"ab\r\n\n") for _ in range(rng.randrange(40)))
        n = rng.randrange(0, 6)
        assert last_lines(io.BytesIO(data), len(data), n, block) == plain(data, n), (data, n)


def test_lines_longer_than_a_block():
    data = b"first\n" + b"x" * 1000 + b"\n" + b"y" * 500
    assert last_lines(io.BytesIO(data), len(data), 2, 64) == [b"y" * 500, b"x" * 1000]


def test_reads_what_the_lines_need():
    data = Counting(b"some line of a log\n" * 200_000)
    assert len(last_lines(data, 19 * 200_000, 20)) == 20
    assert data.read_bytes == 64 << 10


def test_ten_gigabytes(spark):
    """A sparse file: 10 GB of which the end alone is written."""
    root = tempfile.mkdtemp(prefix="suitelens-test-tail-")
    end = b"\n" + b"".join(b"line %d\n" % k for k in range(100)) + b"no line feed"
    with open(os.path.join(root, "big.log"), "wb") as f:
        f.truncate(10 << 30)
        f.seek(0, os.SEEK_END)
        f.write(end)
    got = [r.value for r in tail_files(spark, root).orderBy("from_end").collect()]
    assert got == ["no line feed"] + [f"line {k}" for k in range(99, 80, -1)]


def test_same_lines_as_a_scan(spark):
    root = tempfile.mkdtemp(prefix="suitelens-test-tail-")
    contents = {"empty.txt": b"", "feed.txt": b"\n", "crlf.txt": b"a\r\nb\r\n", "open.txt": b"a\nb", "blank.txt": b"a\n\n\n", "+ %20é.txt": "é\n".encode(),
                "many.txt": b"".join(b"%d\n" % k for k in range(50)), "_hidden.txt": b"x\n", ".dot.txt": b"x\n", "other.log": b"x\n", "sub/deep.txt": b"d\n"}
    os.mkdir(os.path.join(root, "sub"))
    for name, data in contents.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(data)

    def rows(df):
        return sorted((r.file[r.file.index(root):], r.from_end, r.value) for r in df.collect())

    got = tail_files(spark, root, 3, glob="*.txt", block=4)
    assert rows(got) == rows(logs.tail_log_lines(scan_log_lines(spark, root, glob="*.txt"), 3))
    assert got.where("error is not null").count() == 0
    assert rows(tail_files(spark, root, 1, glob="[fo]*.*")) == [(f"{root}/feed.txt", 1, ""), (f"{root}/open.txt", 1, "b"), (f"{root}/other.log", 1, "x")]


def test_a_file_that_goes_is_a_row(spark):
    root = tempfile.mkdtemp(prefix="suitelens-test-tail-")
    for name in ("a.txt", "b.txt"):
        with open(os.path.join(root, name), "w") as f:
            f.write("x\n")
    tails = tail_files(spark, root)
    os.rename(os.path.join(root, "b.txt"), os.path.join(tempfile.mkdtemp(prefix="suitelens-test-tail-"), "b.txt"))
    got = {os.path.basename(r.file): r for r in tails.collect()}
    assert got["a.txt"].value == "x" and got["a.txt"].error is None
    assert got["b.txt"].error and got["b.txt"].value is None and got["b.txt"].from_end is None


def test_no_files(spark):
    assert tail_files(spark, tempfile.mkdtemp(prefix="suitelens-test-tail-")).count() == 0
