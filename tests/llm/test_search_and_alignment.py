"""The trie join of fingerprints, the FP-tree search and the alignment of tokenizers, against plain versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from suitelens.llm import alignment, lexical, simhash
from suitelens.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_queries import rows


def by_links(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in links:
        x, y = top(i), top(j)
        up[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]


def near_keys(rng, n):
    base = [int(x) for x in rng.integers(0, 1 << 62, 4)]
    keys = []
    for _ in range(n):
        k = base[rng.integers(0, 4)]
        for _ in range(rng.integers(0, 6)):
            k ^= 1 << int(rng.integers(0, 64))
        keys.append(k)
    return np.unique(np.array(keys, np.uint64))


@pytest.mark.parametrize("step", [3, 1 << 14])
@pytest.mark.parametrize("front", [0, 16])
def test_trie_join(monkeypatch, step, front):
    monkeypatch.setattr(simhash, "STEP_PAIRS", step)
    rng = np.random.default_rng(step + front)
    for _ in range(15):
        keys = near_keys(rng, int(rng.integers(1, 150)))
        mask = rng.integers(0, 2, len(keys)).astype(bool)
        own = simhash.Trie(keys)
        for a, b, join in ((keys, keys, simhash.Join(own, own, 3, front)),
                           (keys[mask], keys[~mask], simhash.Join(simhash.Trie(keys[mask]), simhash.Trie(keys[~mask]), 3, front))):
            near = np.bitwise_count(a[:, None] ^ b[None]) <= 3
            if front:
                near &= (a[:, None] ^ b[None]) >> np.uint64(64 - front) == 0
            n, shift = (len(keys), 0) if a is b else (len(a) + len(b), len(a))
            got = [(int(i), int(j) + shift) for x, y in join.links() for i, j in zip(x, y)]
            assert all(near[i, j - shift] for i, j in got)
            assert by_links(n, got) == by_links(n, [(int(i), int(j) + shift) for i, j in zip(*np.nonzero(near))])


def test_trie_join_of_a_dense_group_is_no_square():
    visited = []
    for bits in (13, 15):
        keys = np.arange(1 << bits, dtype=np.uint64) << np.uint64(9)
        trie = simhash.Trie(keys)
        join = simhash.Join(trie, trie, 3, 0)
        assert sum(len(x) for x, _ in join.links()) == len(keys) - 1
        visited.append(join.visited)
    assert visited[1] < 6 * visited[0] and visited[1] < (1 << 30) / 100  # four times the keys


def test_views_turn_and_cover():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 62, 50).astype(np.uint64)
    for blocks in (4, 5, 7):
        views = simhash.views(blocks)
        for mask, bits in views:
            assert mask.bit_count() == bits and (simhash.turned_back(simhash.turned(keys, mask), mask) == keys).all()
        for _ in range(200):
            differ = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(differ & mask == 0 for mask, _ in views)


def test_simhash(spark, tables, doc_rows):
    assert rows(QUERIES["op12_simhash_trie"](spark, tables), "doc_id", "fingerprint", "component_id") == brute.op12(doc_rows)


def test_simhash_of_hot_fronts_and_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", 3)
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 60)}" for _ in range(200)]
    docs = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(200)] = f"x{rng.random()}"
        docs.append((i, " ".join(words)))
    docs += [(500 + i, "the same text of some words") for i in range(100)] + [(7, "own text"), (7, None), (3, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = simhash.near_duplicates(df, task_prints=10)
    got = sorted((r.doc_id, f"{r.print & (1 << 64) - 1:016x}", r.component_id) for r in out.collect())
    assert got == brute.op12(docs)
    none = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (1, "a b"), (2, "c")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.component_id) for r in none.collect()) == [(0, None), (1, None), (2, 2)]


def test_search(spark, tables, doc_rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op11_fp_tree_search"](spark, tables).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == sorted(brute.op11(doc_rows, items), key=repr)


def test_search_in_blocks_and_small_trees(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 16)
    monkeypatch.setattr(lexical, "TREE_DOCUMENTS", 16)
    rng = random.Random(4)
    words = [f"t{i}" for i in range(40)] + ["Ünd", "日本", "z9"]
    docs = [(rng.randint(0, 40) if i % 3 else i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(150)]
    docs += [(None, "t1 t2 t3"), (5, "t1 T2; t3"), (5, "t1 T2; t3"), (9, None)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 30])))) for i in range(14)] + [(3, "t1"), (None, "t2 t3")]
    out = lexical.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                spark.createDataFrame(items, "item_id long, text string"), k=3)
    got = [tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == sorted(brute.op11(docs, items, 3), key=repr)


def test_tree_leaves_out_what_cannot_win():
    rng = np.random.default_rng(3)
    n, terms, items = 2000, 60, 20
    paths = [np.sort(rng.choice(terms, rng.integers(1, 12), replace=False)) for _ in range(n)]
    tfs = [rng.integers(1, 4, len(p)) for p in paths]
    m = rng.integers(10, 400, n)
    weights = rng.integers(0, 9000, (terms, items)) * (rng.random((terms, items)) < 0.1)
    later = np.zeros((terms + 1, items), np.int64)
    later[:-1] = np.cumsum(weights[::-1], axis=0)[::-1]
    best = lexical.Best(items, 5)
    tree = lexical.Tree(np.arange(n), m, paths, tfs, 5)
    visited = lexical.search(tree, weights, later, best)
    scores = np.array([lexical.part_of_score(t, x) @ weights[p] for p, t, x in zip(paths, tfs, m)])
    want = [(i, int(s[d]), int(d)) for i, s in enumerate(scores.T) for d in np.lexsort((np.arange(n), -s))[:5] if s[d] > 0]
    assert list(best.rows()) == want and visited < len(tree.depth) + len(tree.paths)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.lists(st.integers(1, 9), max_size=200))
def test_galloping(a, b):
    a, b = np.cumsum(np.array(a, np.int64)), np.cumsum(np.array(b, np.int64))
    for x, y in ((a, b), (b, a)):
        at_x, at_y = alignment.common_ends(x, y)
        both = np.intersect1d(x, y)
        assert np.array_equal(x[at_x], both) and np.array_equal(y[at_y], both)
    if len(a):
        assert np.array_equal(alignment.gallop(b, a, np.zeros(len(b), np.int64)), np.searchsorted(a, b))


@pytest.fixture(scope="module")
def plain_tokenizers():
    public, tok, piece = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a = tok.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = piece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in printable)}

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return (lambda t: a.encode(t, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i)), b.encode, bytes_b)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_align(spark, tables, doc_rows, plain_tokenizers):
    assert rows(QUERIES["op13_align"](spark, tables), *COLUMNS) == sorted(brute.op13(doc_rows, *plain_tokenizers))


def test_align_odd_texts(spark, plain_tokenizers, monkeypatch):
    from pyspark.sql import functions as F

    from suitelens.llm.common import tokenizer_path

    public = pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    bits = ["a", " ", "\n", "é", "the", " the", ".", "'s", "　", "\x1f", "\x85", "1", "日", "▁", "\t", "<s>", "<|endoftext|>", "\x00", "ﬁ", "👍🏽"]
    docs = [(i, "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(600)]
    docs += [(1, "the same"), (1, "the same"), (None, "a  b "), (700, None), (701, "x" * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    out = alignment.align(df, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"), public.PATTERN, pass_pairs=40)
    got = out.withColumn("groups_sha256", F.coalesce(F.lower(F.hex("digest")), F.lit(""))).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.op13(docs, *plain_tokenizers), key=repr)
