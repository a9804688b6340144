"""Every registered query against its plain Python version on small odd tables."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from suitelens.llm.queries import QUERIES
from tests.llm import brute


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def encode():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_token_store(spark, tables, doc_rows, encode):
    out = QUERIES["op1_token_store"](spark, tables)
    assert rows(out, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute.op1(doc_rows, encode))


def test_suffix_trees(spark, tables, doc_rows):
    assert rows(QUERIES["op2_suffix_trees"](spark, tables), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.op2(doc_rows)


def test_top_products(spark, tables):
    vecs = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    out = QUERIES["op3_top_products"](spark, tables)
    got = [tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()]
    from suitelens.llm import topk
    import numpy as np
    ok = [(k, i, np.floor(256 * np.pad(np.asarray(v, float), (0, 8 - len(v)))).astype(int)) for k, (i, v) in enumerate(vecs)
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for k, q, v in ok:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for j, i, w in ok if j != k)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    few = spark.createDataFrame([(50, [1.0]), (51, [2.0])], "vec_id long, embedding array<double>")
    assert rows(topk.top_products(few, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score") == [(50, 1, 51, 256 * 512)]


def test_top_products_in_blocks(spark, tables, monkeypatch):
    from suitelens.llm import topk
    vectors = spark.read.parquet(f"{tables}/embeddings.parquet")
    whole = rows(topk.top_products(vectors, F.col("vec_id") % 10 == 0), "query_id", "rank", "vec_id", "score")
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(topk, "HEAD", 3)
    assert rows(topk.top_products(vectors, F.col("vec_id") % 10 == 0), "query_id", "rank", "vec_id", "score") == whole


def test_pack(spark, tables, doc_rows, encode):
    got = QUERIES["op4_pack"](spark, tables).collect()
    ids = {d: encode(t or "") + [2] for d, t in doc_rows}
    pieces, sequences = {}, {}
    for r in got:
        assert brute.crc(ids[r.doc_id][r.start:r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.doc_id, r.start))
    assert set(pieces) == set(ids)
    for d, p in pieces.items():
        assert [s for s, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] and sum(n for _, n in p) == len(ids[d])
    assert sorted(sequences) == list(range(len(sequences)))
    stream = []
    for k in sorted(sequences):
        s = sorted(sequences[k])
        assert [o for o, *_ in s] == [sum(x[1] for x in s[:i]) for i in range(len(s))] and sum(x[1] for x in s) <= 4096
        stream += [(d, a) for _, _, d, a in s]
    assert stream == sorted(stream)  # order of documents and places is kept


def test_prefix_doubling(spark, tables, doc_rows):
    out = QUERIES["op5_prefix_doubling"](spark, tables)
    assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.op5(doc_rows)


def test_langid_columns(spark, tables, doc_rows):
    out = {r.doc_id: r for r in QUERIES["op6_langid"](spark, tables).collect()}
    assert set(out) == {d for d, _ in doc_rows}
    for d, t in doc_rows:
        assert out[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert (out[d].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= out[d].score <= 1
        assert out[d].lang_pred in ("und", "aa", "bb")


def test_decontaminate(spark, tables, doc_rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    out = QUERIES["op7_decontaminate"](spark, tables)
    assert rows(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.op7(doc_rows, items)


def test_shingle_join(spark, tables, doc_rows):
    assert rows(QUERIES["op8_shingle_join"](spark, tables), "doc_id", "n_shingles", "component_id") == brute.op8(doc_rows)


def test_chat_format(spark, tables):
    turns = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").collect()]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    conv = {}
    for c, n, r, t in turns:
        conv.setdefault(c, []).append((-1 if n is None else n, r or "", t or ""))
    flat = [(c, n, r, t) for c, ts in conv.items() for n, r, t in ts]
    out = QUERIES["op9_chat_format"](spark, tables)
    assert rows(out, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == brute.op9(flat)
    flow = {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
    for r in out.collect():
        state = "start"
        for _, role, _ in sorted(conv[r.conv_id]):
            state = flow.get(state, {}).get(role, "error")
        assert r.valid == (state == "assistant")


def test_shard(spark, tables, doc_rows):
    got = QUERIES["op10_shard"](spark, tables).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in doc_rows)
    n = Counter(r.shard for r in got)
    assert set(n) <= set(range(40)) and max(n.values()) - min(n[s] for s in range(40)) <= 1
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(40) for k in range(n[s])]
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op9_chat_format"}))
def test_empty_tables(spark, no_rows, name):
    assert QUERIES[name](spark, no_rows).count() == 0


def test_empty_conversations(spark, no_rows):
    assert [r.conv_id for r in QUERIES["op9_chat_format"](spark, no_rows).collect()] == [-7]
