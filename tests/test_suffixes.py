"""Endings found in one sorted pass, against trying every pair."""

import random

import pandas as pd
import pytest

from suitelens.operators.suffixes import carried, ends_with_any


def found(spark, texts, endings, parts):
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    e = spark.createDataFrame([(x,) for x in endings], "e string")
    return sorted(r.text for r in ends_with_any(t, e, parts).collect())


def every_pair(texts, endings):
    return sorted({t for t in texts if t is not None and any(e is not None and t.endswith(e) for e in endings)})


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_like_every_pair(spark, parts):
    rng = random.Random(parts)

    def word(most):
        return "".join(rng.choice("abé𝄞") for _ in range(rng.randrange(1, most)))

    texts = [word(9) for _ in range(400)] + [None, ""]
    for k in (0, 1, 5, 60):
        endings = [word(6) for _ in range(k)] + [None]
        assert found(spark, texts, endings, parts) == every_pair(texts, endings)


def test_one_ending_for_many_partitions(spark):
    texts = [f"{k:05d}x-node" for k in range(3000)] + [f"{k:05d}y" for k in range(3000)]
    endings = ["node", "x-node", "00000x-node", "1y"]
    assert found(spark, texts, endings, 16) == every_pair(texts, endings)


def test_an_empty_ending_and_none(spark):
    assert found(spark, ["a", "", None], [""], 4) == ["", "a"]
    assert found(spark, ["a", ""], [], 4) == []
    assert found(spark, [], ["a"], 4) == []


def test_carried_over_batches():
    batches = [pd.Series([None, "a", None], dtype=object), pd.Series([], dtype=object), pd.Series(["ab", None, "b", "ba"], dtype=object)]
    assert [x for out in carried(iter(batches)) for x in out] == [None, "a", "a", "a", "a", "b", "b"]


def test_upsert_by_either_way(spark):
    from suitelens.operators import inventory as inv
    rng = random.Random(2)
    lines = [(f"10.0.0.{k}\t" + "".join(rng.choice("ab1-") for _ in range(rng.randrange(6))) + rng.choice(["", " "]),) for k in range(200)]
    reg = spark.createDataFrame(lines + [("",), ("# a",), (None,)], "line string")
    new = spark.createDataFrame([("1.1.1.1", "a1"), ("1.1.1.2", "b-"), ("1.1.1.3", "-b-"), ("1.1.1.4", None)], "private_ip string, hostname string")
    plain, in_order = (sorted(map(tuple, inv.upsert_registry(reg, new, sorted_pass=p).collect())) for p in (False, True))
    assert plain == in_order and 4 < len(plain) < 200
