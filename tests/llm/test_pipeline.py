"""The corpus pipeline, stage by stage, against plain versions."""

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute


def removed(docs, width=50):
    """Texts without the bytes that a smaller id's document has in a string of ``width``; whole characters only."""
    data = [(d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, b in data:
        for s in range(len(b) - width + 1):
            first[b[s:s + width]] = min(first.get(b[s:s + width], d), d)
    out = {}
    for (d, b), (_, t) in zip(data, docs, strict=True):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if first[b[s:s + width]] < d:
                gone[s:s + width] = True
        kept, at = [], 0
        for c in t or "":
            n = len(c.encode())
            if not gone[at:at + n].all():
                kept.append(c)
            at += n
        out[d] = None if t is None else "".join(kept)
    return out


@pytest.fixture(scope="module")
def steps(spark, tables, tmp_path_factory):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], tables).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "decontamination", "packing"]
    for before, after in zip(steps[:4], steps[1:5]):
        assert after.columns == before.columns


def test_language_stage_drops_only_what_has_no_language(steps):
    before, after = dict(texts(steps[0])), dict(texts(steps[1]))
    gone = set(before) - set(after)
    assert gone >= {d for d, t in before.items() if not any(c.isalpha() for c in t or "")}
    assert len(gone) <= 0.1 * len(before) and all(before[d] == t for d, t in after.items())


def test_join_stage_keeps_one_of_each_class(steps):
    before = texts(steps[1])
    want = {d for d, _, c in brute.op8(before) if d == c}
    after = dict(texts(steps[2]))
    assert set(after) == want and all(dict(before)[d] == t for d, t in after.items())


def test_dedup_stage_cuts_passages(steps):
    assert dict(texts(steps[3])) == removed(texts(steps[2]))
    assert all(r.n_chars == len(r.text or "") for r in steps[3].collect() if r.text is not None)


def test_decontamination_stage(spark, tables, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    before = texts(steps[3])
    clean = {w[0] for w in brute.op7(before, items) if not w[5]}
    assert texts(steps[4]) and dict(texts(steps[4])) == {d: t for d, t in before if d in clean}


def test_packing_stage(steps):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [2] for d, x in texts(steps[4])}
    seen = {}
    for r in steps[5].collect():
        assert brute.crc(ids[r.doc_id][r.start:r.start + r.length]) == r.ids_crc32
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {d: len(i) for d, i in ids.items()}


def test_run_equals_the_stages(spark, tables, steps):
    got = corpus_pipeline.run(spark, tables)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, steps[5].select(key).collect()))
