"""The Python pieces that run inside Spark tasks, tested directly (no JVM needed)."""

import pandas as pd

from suitelens.operators.ranking import places


def _places(*frames):
    return [x for s in places(iter(frames)) for x in s]


def test_places_over_batches():
    assert _places(pd.DataFrame({"k": ["a", "a"]}), pd.DataFrame({"k": []}), pd.DataFrame({"k": ["a", None, None]}),
                   pd.DataFrame({"k": [None, "b"]}), pd.DataFrame({"k": ["b"]}), pd.DataFrame({"k": ["b", "c"]})) == [1, 2, 3, 1, 2, 3, 1, 2, 3, 1]


def test_places_of_several_keys():
    assert _places(pd.DataFrame({"k": [1, 1, 1], "j": ["x", "x", None]}), pd.DataFrame({"k": [1, 2], "j": [None, None]})) == [1, 2, 1, 2, 1]
